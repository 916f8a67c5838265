"""Exact, near and passage copies against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from data import prose, table_of
from factorlake.llm import blocks, components, exact_dedup, setsketch, substring_dedup, voronoi_join


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, keep):
    pick = random.Random(1)
    texts = ["Ab", "aB", "É", "é", "", None, "long " * 2000]
    pairs = [(pick.randrange(1000), pick.choice(texts)) for _ in range(300)]
    groups = defaultdict(list)
    for i, t in pairs:
        groups[lower(t)].append(i)
    best = {"smallest": min, "largest": max}[keep]
    want = sorted((i, best(groups[lower(t)]), len(groups[lower(t)]), i == best(groups[lower(t)]))
                  for i, t in pairs)
    docs = table_of(spark, pairs).repartition(13)
    found = exact_dedup.exact_groups(docs, keep=keep)
    assert sorted(tuple(r)[:4] for r in found.collect()) == want
    assert exact_dedup.drop_copies(docs, keep=keep).count() == len(groups)


@pytest.mark.parametrize("runs", [1, 2, 64])
def test_runs_merge_in_rounds(spark, monkeypatch, runs):
    """One text in every run, others in some; entries of one digest differ in hash or size: these are not merged."""
    monkeypatch.setattr(exact_dedup, "RUNS", runs)
    pick = random.Random(runs)
    rows = [(pick.choice([None, *range(50)]), bytes([d, 7, d]), h, 1, pick.randrange(runs))
            for d, h in [(0, 5)] * 300 + [(d, h) for d in range(40) for h in (5, 6)] * 4]
    want = defaultdict(list)
    for i, sha, h, size, _ in rows:
        want[sha, h, size].append(i)
    table = spark.createDataFrame(rows, "doc_id long, sha binary, hash long, size int, run int").repartition(23)
    for keep, best in (("smallest", min), ("largest", max)):
        found = exact_dedup.tree_merge(table, keep).collect()
        assert len(found) == len(want)
        for r in found:
            ids = want[bytes(r.sha), r.hash, r.size]
            assert r.n == len(ids)
            assert r.keep_id == best([i for i in ids if i is not None], default=None)


def shingles(text, k=5):
    words = lower(text).split()
    if not words:
        return set()
    return {tuple(words[j:j + k]) for j in range(max(1, len(words) - k + 1))}


def brute_components(pairs, percent):
    sets = {i: shingles(t) for i, t in pairs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(ids[a]), find(ids[b])))
                root[hi] = lo
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def near_table(seed, n=160):
    pick = random.Random(seed)
    out = []
    for i in range(n):
        if out and pick.random() < 0.75:
            words = (pick.choice(out)[1] or "x").split()
            for _ in range(pick.randint(0, 4)):
                if words:
                    words[pick.randrange(len(words))] = pick.choice("uvwxyz")
            text = " ".join(words)
            if pick.random() < 0.2:
                text = text.upper()
        else:
            text = prose(seed * 1000 + i, pick.choice([0, 1, 3, 5, 20, 60, 150]))
        out.append((i, text))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    pairs = near_table(percent)
    want, sizes = brute_components(pairs, percent)
    found = {r.doc_id: r for r in setsketch.near_duplicates(table_of(spark, pairs), percent).collect()}
    assert {i: r.component_id for i, r in found.items()} == want
    assert {i: r.n_shingles for i, r in found.items()} == sizes
    assert all(r.kept == (i == r.component_id) for i, r in found.items())


@pytest.mark.parametrize("percent,sizes", [(80, [(15, 12), (20, 16), (55, 44)]), (85, [(20, 17), (40, 34), (100, 85)])])
def test_near_duplicates_at_the_exact_threshold(spark, percent, sizes):
    """Texts and their first words, whose shingle sets have exactly the threshold's ratio."""
    pairs = []
    for more, less in sizes:
        for order in (1, -1):
            words = prose(10_000 + len(pairs), more + 4).split()
            both = [" ".join(f"{w}{len(pairs)}" for w in words[:n + 4]) for n in (more, less)][::order]
            pairs += [(len(pairs) + k, text) for k, text in enumerate(both)]
    want, _ = brute_components(pairs, percent)
    assert len(set(want.values())) == len(pairs) // 2
    found = setsketch.near_duplicates(table_of(spark, pairs), percent).collect()
    assert {r.doc_id: r.component_id for r in found} == want


@pytest.mark.parametrize("percent", [80, 85])
def test_no_exact_pair_is_dropped_before_it_is_verified(spark, percent):
    """Every size up to 1,000, in both orders, with the registers of contained sets."""
    greatest = [n for n in range(1, 1001) if percent * n % 100 == 0]
    rows = []
    for n in greatest:
        values = np.random.default_rng(n).integers(0, 2 ** 63, n).astype(np.uint64)
        least = percent * n // 100
        long, short = (setsketch.fill(v, np.array([0]))[0].tobytes() for v in (values, values[:least]))
        rows += [(b"l", b"s", n, least, long, short), (b"s", b"l", least, n, short, long)]
        rows += [(b"x", b"x", n, least - 1, long, short), (b"x", b"x", least - 1, n, short, long)]
    pairs = spark.createDataFrame(rows, "a binary, b binary, n_a long, n_b long, registers_a binary, registers_b binary")
    found = [bytes(r.a) for r in setsketch._plausible(pairs, percent).collect()]
    assert sorted(found) == [b"l"] * len(greatest) + [b"s"] * len(greatest)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """Chains whose ends are unlike, and buckets of several components, compared in blocks of 3."""
    monkeypatch.setattr(blocks, "FEW", 2)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 3)
    base = prose(5, 100).split()
    pairs = []
    for i in range(30):
        words = list(base)
        words[:3 * (i % 15)] = [f"n{j}" for j in range(3 * (i % 15))]
        pairs.append((i, " ".join(words) + (" end" if i >= 15 else "")))
    want, _ = brute_components(pairs, 80)
    found = setsketch.near_duplicates(table_of(spark, pairs), 80).collect()
    assert {r.doc_id: r.component_id for r in found} == want


@pytest.mark.parametrize("join", [setsketch.near_duplicates, voronoi_join.jaccard_join])
def test_many_null_identifiers(spark, join):
    """Rows without an identifier meet only their own class: linear time, and each text its own set."""
    pairs = [(None, f"alpha beta gamma delta epsilon zeta number {k % 7_000} tail") for k in range(20_000)]
    docs = table_of(spark, pairs).union(table_of(spark, [(5, "one two three four five six")]))
    found = join(docs).collect()
    assert len(found) == 20_001
    assert {(r.doc_id, r.component_id) for r in found} == {(None, None), (5, 5)}


def bridges(percent):
    """Chains, rings around centres and a common passage: what cells, boundaries and far regions are for."""
    pick, pairs = random.Random(percent), []
    passage = prose(77, 60)
    for c in range(4):
        centre = prose(500 + c, 120).split()
        for _ in range(25):
            words = list(centre)
            for _ in range(pick.choice([0, 1, 2, 3, 4, 6, 8])):
                words[pick.randrange(len(words))] = f"n{pick.randrange(50)}"
            pairs.append((len(pairs), " ".join(words)))
    for k in range(60):
        pairs.append((len(pairs), f"{prose(900 + k, pick.choice([5, 12, 300]))} {passage}"))
    return pairs


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("few,rows,rounds", [(1024, 1000, 4), (4, 3, 2), (4, 3, 1)])
def test_voronoi_join(spark, monkeypatch, percent, few, rows, rounds):
    for module in (blocks, voronoi_join):
        monkeypatch.setattr(module, "FEW", few)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", rows)
    monkeypatch.setattr(voronoi_join, "ROUNDS", rounds)
    pairs = bridges(percent) + [(1000 + i, t) for i, t in near_table(percent, 80)] + [(2000, None), (2001, "")]
    want, sizes = brute_components(pairs, percent)
    found = {r.doc_id: r for r in voronoi_join.jaccard_join(table_of(spark, pairs), percent).collect()}
    assert {i: r.component_id for i, r in found.items()} == want
    assert {i: r.n_shingles for i, r in found.items()} == sizes


def test_window_covers_every_overlap():
    """Two sets at the threshold share one of their first shingles, whatever the order."""
    for n in range(1, 200):
        for m in range(-(-80 * n // 100), n + 1):
            # The larger holds the smaller, at best; all that is missing stands first.
            assert voronoi_join.window(n, 80) > n - m
            assert voronoi_join.window(n, 80) <= n


def test_registers_merge():
    one, two = (np.random.default_rng(k).integers(0, 2 ** 63, 500).astype(np.uint64) for k in (1, 2))
    first = np.array([0])
    both = setsketch.fill(np.concatenate([one, two]), first)[0]
    merged = setsketch.merge(setsketch.fill(one, first)[0].tobytes(), setsketch.fill(two, first)[0].tobytes())
    assert both.tobytes() == merged


@pytest.mark.parametrize("values,piece", [(4_000_000, 4_096), (50, 7)])
def test_common_counts(monkeypatch, values, piece):
    monkeypatch.setattr(blocks, "VALUES", values)
    monkeypatch.setattr(blocks, "SLICE", piece)
    draw = np.random.default_rng(6)
    sets = [np.unique(draw.integers(0, 60, draw.integers(1, 50))).astype(np.uint64) for _ in range(12)]
    want = [[len(np.intersect1d(x, y)) for y in sets[5:]] for x in sets[:5]]
    assert blocks.common_counts(sets[:5], sets[5:]).tolist() == want


def test_likelihood_tells_likely_pairs():
    draw = np.random.default_rng(3)
    common, extra = draw.integers(0, 2 ** 63, 900).astype(np.uint64), draw.integers(0, 2 ** 63, 2200).astype(np.uint64)
    near = setsketch.fill(np.concatenate([common, extra[:50]]), np.array([0]))
    base = setsketch.fill(np.concatenate([common, extra[50:100]]), np.array([0]))
    far = setsketch.fill(extra[100:1050], np.array([0]))
    n = np.array([950])
    assert setsketch.likely(near, base, n, n, 0.85)[0]
    assert not setsketch.likely(far, base, n, n, 0.85)[0]


def test_components(spark):
    pick = random.Random(2)
    edges = [(pick.randrange(60), pick.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    want = {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    found = components.components(spark.createDataFrame(edges, "a int, b int"))
    assert {r.node: r.root for r in found.collect()} == want


def passages(seed, n=60):
    pick = random.Random(seed)
    shared = [prose(900 + k, pick.randint(15, 60)) for k in range(4)]
    out = []
    for i in range(n):
        parts = [prose(i, pick.randint(0, 60))]
        for _ in range(pick.randint(0, 2)):
            parts += [pick.choice(shared), prose(i + 500, pick.randint(0, 10))]
        if out and pick.random() < 0.2:
            parts = [pick.choice(out)[1]]
        out.append((i, "\n".join(parts)))
    return out + [(n, "same " * 50), (n + 1, None)]


def brute_repeats(pairs, width):
    words = {i: (t or "").split() for i, t in pairs}
    seen = Counter(tuple(w[k:k + width]) for w in words.values() for k in range(len(w) - width + 1))
    out = {}
    for i, w in words.items():
        gone = {p for k in range(len(w) - width + 1) if seen[tuple(w[k:k + width])] > 1
                for p in range(k, k + width)}
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.mark.parametrize("owner_words", [2_000_000, 100])
@pytest.mark.parametrize("width,gram", [(12, 5), (35, 12)])
def test_remove_repeats(spark, monkeypatch, width, gram, owner_words):
    monkeypatch.setattr(substring_dedup, "OWNER_WORDS", owner_words)
    pairs = passages(width)
    found = substring_dedup.remove_repeats(table_of(spark, pairs), width, gram).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found} == brute_repeats(pairs, width)


def test_shards_and_pieces_are_cut(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 50)
    monkeypatch.setattr(substring_dedup, "PIECE", 7)
    pairs = passages(3)
    found = substring_dedup.remove_repeats(table_of(spark, pairs), 12, 5).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found} == brute_repeats(pairs, 12)


def test_index_against_brute_force():
    pick = random.Random(4)
    for _ in range(60):
        width, vocab = pick.choice([3, 5, 8]), pick.choice([2, 3, 50])
        texts = []
        for _ in range(pick.randint(1, 8)):
            words = [str(pick.randrange(vocab)) for _ in range(pick.randint(width, 40))]
            if texts and pick.random() < 0.6:
                words = pick.choice(texts).split()
                words[pick.randrange(len(words))] = "y"
            texts.append(" ".join(words))
        covered = defaultdict(set)
        for d, _, a, b in substring_dedup.search_shard([(k, k, 0, t) for k, t in enumerate(texts)], width):
            covered[d] |= set(range(a, b))
        for d, (_, n, _) in brute_repeats(list(enumerate(texts)), width).items():
            assert len(covered[d]) == n


def test_profiles_are_never_farther_apart_than_their_sets():
    """Also between sizes that are counted in different numbers of parts."""
    r = np.random.default_rng(3)
    sets = []
    for size in (1, 30, 2_000, 2_048, 2_049, 2_300, 4_096, 4_200, 9_000):
        base = np.unique(r.integers(0, 2 ** 63, size).astype(np.uint64) * np.uint64(2))
        sets += [base, np.unique(np.concatenate([base[len(base) // 10:], r.integers(0, 2 ** 63, 1 + size // 9).astype(np.uint64) * np.uint64(2)]))]
    pairs = [(x, y) for x in sets for y in sets]
    apart = voronoi_join.profiles_apart([voronoi_join.profile_of(x) for x, _ in pairs],
                                        [voronoi_join.profile_of(y) for _, y in pairs])
    for (x, y), a in zip(pairs, apart.tolist()):
        assert a <= len(np.setxor1d(x, y))
        assert a == 0 if x is y else True
    far = [a > (len(x) + len(y)) / 9 for (x, y), a in zip(pairs, apart.tolist()) if len(x) > 100 and len(np.intersect1d(x, y)) < 5]
    assert all(far)
