"""Quality rules as an ordered decision list, learned by sequential covering.

A rule is a conjunction of thresholds on statistics of a text. It grows, one threshold at a time, by
the information it gains about bad documents in one part of the labelled sample, and
is pruned on the other; what it covers is taken out and the next rule is sought. Rules that
are not precise enough on the pruning part end the search. The list becomes one ordered
Spark conditional expression, so applying it needs no Python.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlake.llm.common import plain
from factorlake.llm.words import WordHash, runs_of, words_of

#: Labelled rows that the fit reads at most.
SAMPLE = 20_000
#: Thresholds tried for each statistic, conditions in a rule, rules in a list.
CUTS, CONDITIONS, RULES = 64, 4, 12
#: A rule must be right this often, and cover so many bad rows, where it is pruned.
PRECISION, COVER = 0.9, 3
#: Fixed by the contract.
SYMBOLS = "#*$%&|<>"
REPEAT = 5

STATS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
         "n_repeat_words long, n_lines long, n_distinct long, n_digits long, n_chars long")


def repeat_words(hashes: np.ndarray, width: int) -> int:
    """Words in windows that are found twice or more."""
    runs = runs_of(hashes, width)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    held = runs[order]
    same = held[1:] == held[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(runs), bool)
    again[order] = np.append(same, False) | np.append(False, same)
    covered = np.zeros(len(hashes) + 1, np.int64)
    covered[:len(runs)] += again
    covered[width:width + len(runs)] -= again
    return int((np.cumsum(covered[:-1]) > 0).sum())


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The statistics STATS of every whole text; all 0 for null or empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                raw = text.encode("utf-8", "surrogatepass")
                words = raw.split()
                lines = [line for line in raw.split(b"\n") if line.strip()]
                coded = hashes.of(words)
                rows.append((len(words), len(text) - len(raw) + sum(map(len, words)),
                             sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
                             repeat_words(coded, REPEAT), len(lines), len(set(words)),
                             sum(map(raw.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))),
                             len(text)))
            columns = list(zip(*rows)) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)],
                names=[f.split()[0] for f in STATS.split(", ")])

    return plain(docs, id_col, text_col).mapInArrow(run, STATS)


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


def measures() -> dict[str, Column]:
    """What rules may ask about: numbers that do not grow with the length, and the length."""
    return {
        "words": F.col("n_words").cast("double"),
        "chars_per_word": _share("word_chars", "n_words"),
        "symbols_per_word": _share("n_symbols", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "distinct_share": _share("n_distinct", "n_words"),
        "digits_per_char": _share("n_digits", "n_chars"),
        "words_per_line": _share("n_words", "n_lines"),
    }


class Condition(NamedTuple):
    measure: str
    above: bool
    value: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.measure] > self.value if self.above else of[self.measure] <= self.value


class Rule(NamedTuple):
    conditions: tuple[Condition, ...]
    bad: int  # rows of the pruning part that the rule covers
    good: int


def _holds(x: np.ndarray, names: list[str], conditions: list[Condition] | tuple[Condition, ...]) -> np.ndarray:
    covered = np.ones(len(x), bool)
    for c in conditions:
        column = x[:, names.index(c.measure)]
        covered &= column > c.value if c.above else column <= c.value
    return covered


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[Condition]:
    rule: list[Condition] = []
    covered = np.ones(len(x), bool)
    while len(rule) < CONDITIONS:
        p, n = int(bad[covered].sum()), int((~bad[covered]).sum())
        if not p or not n:
            break
        now = math.log2(p / (p + n))
        best, gain = None, 1e-9
        for k, name in enumerate(names):
            column = x[covered, k]
            cuts = np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 2)))
            cuts = (cuts[1:] + cuts[:-1]) / 2
            if not len(cuts):
                continue
            over = column[:, None] > cuts[None]
            p_over = over[bad[covered]].sum(0)
            n_over = over[~bad[covered]].sum(0)
            for above, ps, ns in ((True, p_over, n_over), (False, p - p_over, n - n_over)):
                worth = ps * (np.log2(np.maximum(ps, 1e-9) / np.maximum(ps + ns, 1e-9)) - now)
                at = int(worth.argmax())
                if worth[at] > gain:
                    best, gain = Condition(name, above, float(cuts[at])), float(worth[at])
        if best is None:
            break
        rule.append(best)
        covered &= _holds(x, names, [best])
    return rule


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], seed: int = 11) -> list[Rule]:
    """Rules for bad rows, in order."""
    rng = np.random.default_rng(seed)
    growing = rng.random(len(x)) < 2 / 3
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < RULES:
        grow, prune = left & growing, left & ~growing
        if not bad[grow].any() or not bad[prune].any():
            break
        conditions = _grow(x[grow], bad[grow], names)

        def counts(part: list[Condition]) -> tuple[int, int]:
            covered = _holds(x[prune], names, part)
            return int((covered & bad[prune]).sum()), int((covered & ~bad[prune]).sum())

        def worth(part: list[Condition]) -> float:
            p, n = counts(part)
            return (p - n) / (p + n) if p + n else -1.0

        # The shortest of the best heads of the rule.
        heads = [conditions[:k] for k in range(1, len(conditions) + 1)]
        if not heads:
            break
        kept = max(heads, key=worth)
        p, n = counts(kept)
        if p < COVER or p < PRECISION * (p + n):
            break
        rules.append(Rule(tuple(kept), p, n))
        left &= ~_holds(x, names, kept)
    return rules


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        sample: int = SAMPLE) -> list[Rule]:
    """Rules from rows with a label (0 bad, 1 good; others are left out), ``sample`` at most.

    The sample holds the labels with the least hash of their identifier. No labels: no rules.
    """
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
              .where("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(sample))
    of = measures()
    names = list(of)
    rows = (stats.join(chosen, F.col("doc_id") == F.col("id")).where(~base_failed())
            .select(*[c.alias(n) for n, c in of.items()], "label")
            # Identifiers that repeat could add rows: of all values alike, not of the least.
            .orderBy(F.xxhash64(*names, "label"), *names, "label").limit(2 * sample).toPandas()
            .sort_values([*names, "label"], ignore_index=True))
    if rows.empty:
        return []
    return learn(rows[names].to_numpy(float), (rows["label"] == 0).to_numpy(), names)


def base_failed() -> Column:
    """Fixed by the contract: too short, or too much of it repeated."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """Is a row with the statistics good? The first rule that holds says no."""
    of = measures()
    out = None
    for rule in rules:
        test = F.lit(True)
        for c in rule.conditions:
            test = test & c.column(of)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fired(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1 on; 0 for none."""
    of = measures()
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        test = F.lit(True)
        for c in rules[k - 1].conditions:
            test = test & c.column(of)
        out = F.when(test, k).otherwise(out)
    return out


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """The statistics with base_failed, kept and the rule that fired."""
    return stats.withColumns({"base_failed": base_failed(), "rule": fired(rules),
                              "kept": ~base_failed() & verdict(rules)})
