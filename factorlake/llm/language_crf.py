"""Languages of words in mixed text by a linear-chain conditional random field.

A word's features are its character runs with the word's borders (so prefixes, suffixes and inner
n-grams) and, if it is in the lexicon, the word itself. Transitions between the languages of
neighbouring words are learned with the feature weights from sequences in which pieces of
documents of different languages follow each other. Forward-backward gives each
word's probabilities; a document's are their mean.

The model is fitted on a bounded sample: at most ``DOCS`` documents of each language and
``DOC_WORDS`` words of each, in runs spread evenly over the whole document. Prediction
reads every word of every text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorlake.llm.common import plain, small_batches
from factorlake.llm.words import MIX, mixed

DOCS = 300
DOC_WORDS = 240
RUN = 12
#: Words of a training sequence.
STEPS = 24
BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
ROUNDS = 40
#: Distinct words remembered by a task before it starts anew, and code points handled at once.
KNOWN = 300_000
CHUNK = 2_000_000

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; none if no character is a letter."""
    found = LETTERS.findall(text.lower())
    return found if any(any(map(str.isalpha, w)) for w in found) else []


class Features(NamedTuple):
    """Hashed character runs of words, position by position; a masked position counts as none."""

    buckets: list[np.ndarray]
    inside: list[np.ndarray]
    starts: np.ndarray
    weights: np.ndarray  # one over the number of runs of each word


def features(words: list[str]) -> Features:
    text = "".join(f"\x02{w}\x03" for w in words)
    points = mixed(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64))
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(points))  # code points to the word's end
    buckets, inside, total = [], [], np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        shifted = np.append(points[n - 1:], np.zeros(min(n - 1, len(points)), np.uint64))
        total = total * MIX[0] + shifted
        if n in GRAMS:
            buckets.append((mixed(total + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32))
            inside.append(left >= n)
    runs = sum(np.maximum(lengths - n + 1, 0) for n in GRAMS)
    return Features(buckets, inside, ends - lengths, 1.0 / runs)


def emissions(f: Features, weights: np.ndarray) -> np.ndarray:
    """Scores (word, language) of the features alone."""
    out = np.zeros((len(f.starts), weights.shape[1]))
    for bucket, inside in zip(f.buckets, f.inside):
        out += np.add.reduceat(weights[bucket] * inside[:, None], f.starts)
    return out * f.weights[:, None]


class Model(NamedTuple):
    labels: list[str]
    weights: np.ndarray  # bucket, language
    lexicon: dict[str, int]
    lexical: np.ndarray  # lexicon word, language
    start: np.ndarray
    moves: np.ndarray  # language, next language

    def scores(self, words: list[str]) -> np.ndarray:
        out = emissions(features(words), self.weights)
        known = [(k, self.lexicon[w]) for k, w in enumerate(words) if w in self.lexicon]
        if known:
            at, row = (np.array(x) for x in zip(*known))
            out[at] += self.lexical[row]
        return out


def sweeps(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray,
           moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages, scaled, and the words' own factors.

    Sequences stand one behind the other. They go in step, the longest first, so those still
    under way are always the first ones.
    """
    chance = np.exp(scores - scores.max(1, keepdims=True))
    step, first = np.exp(moves - moves.max()), np.exp(start - start.max())
    begins = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    alpha, beta = np.empty_like(chance), np.empty_like(chance)
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # lengths above t
    state = None
    for t in range(steps):
        at = begins[:active[t]] + t
        state = chance[at] * (first if t == 0 else state[:len(at)] @ step)
        state /= state.sum(1, keepdims=True)
        alpha[at] = state
    state = np.zeros((0, chance.shape[1]))
    for t in range(steps - 1, -1, -1):
        at = begins[:active[t]] + t
        now = np.ones((len(at), chance.shape[1]))
        if len(state):
            now[:len(state)] = (state * chance[at[:len(state)] + 1]) @ step.T
            now /= now.sum(1, keepdims=True)
        beta[at] = now
        state = now
    return alpha, beta, chance


def forward_backward(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray,
                     moves: np.ndarray) -> np.ndarray:
    """Probabilities (word, language) in sequences that stand one behind the other."""
    alpha, beta, _ = sweeps(scores, lengths, start, moves)
    both = alpha * beta
    return both / both.sum(1, keepdims=True)


def train(samples: list[tuple[str, list[list[str]]]], seed: int = 7) -> Model | None:
    """A model from (language, runs of words) of documents; None without any."""
    labels = sorted({label for label, runs in samples if runs})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    runs = {label: [r for x, rs in samples if x == label for r in rs if r] for label in labels}
    most = max(map(len, runs.values()))
    n = len(labels) * most * RUN // STEPS + 1
    # Sequences of pieces: mostly the language goes on, now and then it changes.
    words: list[str] = []
    truth: list[int] = []
    at = 0
    while len(words) < n * STEPS:
        if rng.random() < 0.5:
            at = int(rng.integers(len(labels)))
        pool = runs[labels[at]]
        piece = pool[int(rng.integers(len(pool)))]
        piece = piece[: int(rng.integers(1, len(piece) + 1))]
        words += piece
        truth += [at] * len(piece)
    words, truth = words[: n * STEPS], np.array(truth[: n * STEPS])

    counts = Counter(words)
    lexicon = {w: k for k, w in enumerate(sorted(w for w, c in counts.items() if c >= 5))}
    index = {w: k for k, w in enumerate(counts)}
    number = np.array([index[w] for w in words])
    f = features(list(index))
    lexical_of = np.array([lexicon.get(w, -1) for w in index])
    known = np.flatnonzero(lexical_of >= 0)
    size = len(labels)
    values = [np.zeros((BUCKETS, size)), np.zeros((len(lexicon), size)), np.zeros(size),
              np.eye(size)]
    slopes = [np.full_like(v, 1e-6) for v in values]
    flat = [np.repeat(np.arange(len(index)), np.diff(np.append(f.starts, len(f.buckets[0]))))]
    lengths = np.full(n, STEPS)
    last = np.arange(len(words)) % STEPS == STEPS - 1
    for _ in range(ROUNDS):
        weights, lexical, start, moves = values
        score = emissions(f, weights)
        score[known] += lexical[lexical_of[known]]
        score = score[number]
        alpha, beta, chance = sweeps(score, lengths, start, moves)
        wrong = alpha * beta
        wrong /= wrong.sum(1, keepdims=True)
        wrong[np.arange(len(words)), truth] -= 1
        # Expected and seen moves between neighbours.
        here = np.flatnonzero(~last)
        there = here + 1
        pair = alpha[here][:, :, None] * np.exp(moves)[None] * (chance * beta)[there][:, None, :]
        pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-12)
        seen = np.zeros((size, size))
        np.add.at(seen, (truth[here], truth[there]), 1)
        by_word = np.stack([np.bincount(number, wrong[:, k], len(index)) for k in range(size)], 1)
        per_run = by_word * f.weights[:, None]
        gradient = np.zeros_like(weights)
        for bucket, inside in zip(f.buckets, f.inside):
            for k in range(size):
                gradient[:, k] += np.bincount(bucket, per_run[flat[0], k] * inside, BUCKETS)
        lex = np.zeros_like(lexical)
        lex[lexical_of[known]] = by_word[known]
        first = wrong[::STEPS].sum(0)
        changes = [gradient + 1e-3 * weights, lex + 1e-2 * lexical, first,
                   pair.sum(0) - seen + 1e-2 * moves]
        for v, g, s, rate in zip(values, changes, slopes, (2.0, 0.3, 0.1, 0.1)):
            s += g * g
            v -= rate * g / np.sqrt(s)
    return Model(labels, values[0].astype(np.float32), lexicon, values[1].astype(np.float32),
                 values[2], values[3])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "lang", docs: int = DOCS, doc_words: int = DOC_WORDS) -> Model | None:
    """A model from documents with a label; None if no document has a label and a letter.

    At most ``docs`` documents of each label, those with the least hash of their identifier, so that
    order and layout of the table do not matter.
    """
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                           F.col(label_col).cast("string").alias("label")).where(
        "label is not null and text is not null")
    # The least hashes in two steps: inside parts of a label, then of what these leave. The limit
    # holds before each shuffle too.
    least = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = rows.select("label", "doc_id", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(64)).alias("part"))
    for by in (["label", "part"], ["label"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*least))
        chosen = chosen.withColumn("place", place).where(F.col("place") <= docs).drop("place")
    chosen = chosen.select(F.col("label").alias("of"), F.col("doc_id").alias("id"))
    picked = rows.join(chosen.distinct(), (F.col("label") == F.col("of"))
                       & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("label", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text in frame.text:
                words = words_of(text)
                pieces = min(doc_words // RUN, -(-len(words) // RUN))
                begins = np.linspace(0, max(0, len(words) - RUN), pieces).astype(int) if pieces else []
                out.append("\n".join(" ".join(words[b:b + RUN]) for b in begins))
            yield pd.DataFrame({"label": frame.label, "runs": out})

    # Repeated identifiers could add rows: the same bound holds again here, for each label.
    again = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("runs"), "runs"))
    sample = picked.mapInPandas(run, "label string, runs string").withColumn("place", again).where(
        F.col("place") <= docs).orderBy(F.xxhash64("runs"), "label").collect()
    return train([(r.label, [x.split(" ") for x in r.runs.split("\n") if x]) for r in sample])


class Labeller:
    """Word probabilities of texts; remembers the scores of words."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = defaultdict(count().__next__)
        self.scores = np.zeros((0, len(self.model.labels)))

    def label(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all words, and the number of words of each text."""
        if len(self.words) > KNOWN:
            self.forget()
        lengths = np.array([len(t) for t in texts], np.int64)
        numbers = np.concatenate([np.zeros(0, np.int64), *(
            np.fromiter(map(self.words.__getitem__, t), np.int64, len(t)) for t in texts)])
        fresh = list(islice(self.words, len(self.scores), None))
        if fresh:
            self.scores = np.concatenate([self.scores, self.model.scores(fresh)])
        some = lengths > 0
        if not some.any():
            return np.zeros((0, self.scores.shape[1])), lengths
        return forward_backward(self.scores[numbers], lengths[some], self.model.start,
                                self.model.moves), lengths


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield begin, k
            begin, size = k, 0
        size += len(text)
    yield begin, len(texts)


def judged(labeller: Labeller | None, texts: list[str]) -> tuple[list[str], list[float]]:
    """The language of each text and its mean probability."""
    best, score = [], []
    for begin, end in _batches(texts):
        if labeller is None:
            best += [UNKNOWN] * (end - begin)
            score += [0.0] * (end - begin)
            continue
        chance, lengths = labeller.label([words_of(t) for t in texts[begin:end]])
        sums = np.zeros((len(lengths), chance.shape[1]))
        some = np.flatnonzero(lengths)
        if len(some):
            starts = np.cumsum(lengths[some]) - lengths[some]
            sums[some] = np.add.reduceat(chance, starts) / lengths[some, None]
        labels = labeller.model.labels
        for k, n in enumerate(lengths):
            top = int(sums[k].argmax())
            best.append(labels[top] if n else UNKNOWN)
            score.append(min(1.0, float(sums[k, top])) if n else 0.0)
    return best, score


def languages(docs: DataFrame, model: Model | None, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row: the language of most of the text, by mean probability.

    ``und`` with score 0 for null texts and texts without a letter, and for all if there is no
    model. Rows that repeat an identifier are labelled one by one; an empty table gives no row.
    """
    # A plain tuple: broadcasts are read where this package may not be installed.
    known = docs.sparkSession.sparkContext.broadcast(tuple(model) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(Model(*known.value)) if known.value else None
        for batch in batches:
            best, score = judged(labeller, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    return plain(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a letter and a language with at least this mean probability.

    Each row is judged by its own text where it stands: rows that repeat an identifier, or have none, do not
    speak for each other, and nothing is shuffled. Texts that are null or have no letter go.
    """
    known = docs.sparkSession.sparkContext.broadcast(tuple(model))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(Model(*known.value))
        for batch in batches:
            best, score = judged(labeller, [t or "" for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array([b != UNKNOWN and s >= least for b, s in zip(best, score)], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


SPANS = "doc_id long, start int, stop int, lang string, n_words int, score double"


def language_spans(docs: DataFrame, model: Model, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, start, stop (code points of the lower-cased text), lang, n_words, score.

    One row for each run of words that are most likely of one language; score is their mean
    probability. Texts without a letter have no row.
    """
    known = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(Model(*known.value))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not words_of(text):
                    continue
                found = list(LETTERS.finditer(text.lower()))
                chance, _ = labeller.label([[m.group() for m in found]])
                top = chance.argmax(1)
                cuts = [0, *(np.flatnonzero(top[1:] != top[:-1]) + 1).tolist(), len(top)]
                rows += [(doc_id, found[a].start(), found[b - 1].end(), labeller.model.labels[top[a]], b - a,
                          float(chance[a:b, top[a]].mean())) for a, b in zip(cuts, cuts[1:])]
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=[f.split()[0] for f in SPANS.split(", ")])

    return plain(docs, id_col, text_col).mapInArrow(run, SPANS)
