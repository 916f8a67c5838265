"""Merkle manifests against a brute-force tree."""

import hashlib
import zlib

import pytest
from data import EDGE, edge, empty, rows, table_of
from pyspark.sql import functions as F

from factorlake.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k:k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        out.append((level[at ^ 1] if at ^ 1 < len(level) else "", bool(at & 1)))
        at >>= 1
    return out


def brute(table):
    """Rows (doc_id, text, lang, source, n_chars, ...) to the query's rows."""
    parts = {}
    for i, text, lang, source, n, *_ in table:
        leaf = h(*map(told, (i, source, lang, n, text)))
        hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
        changed = h(*map(told, (i, source, lang, n if n is None else n + 1, text))) if hit else leaf
        parts.setdefault((lang is not None, (lang or "").encode()), []).append((i is not None, i or 0, leaf, changed))
    trees = [tree([r[2] for r in sorted(parts[p])]) for p in sorted(parts)]
    forest = tree([t[-1][0] for t in trees])
    out = []
    for k, p in enumerate(sorted(parts)):
        for at, (known, i, leaf, changed) in enumerate(sorted(parts[p])):
            path = siblings(trees[k], at) + siblings(forest, k)
            folded = changed
            for s, left in path:
                folded = h(s, folded) if left else h(folded, s)
            out.append((i if known else None, leaf, trees[k][-1][0], forest[-1][0], h(*[s for s, _ in path]), folded))
    return sorted(out, key=str)


def found(docs, **kw):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = merkle.tampered_leaf(fields[0], fields[3], fields[1:3], fields[4])
    got = merkle.manifest(docs, fields, F.col("lang"), F.col("doc_id"), changed, **kw)
    return got


@pytest.mark.parametrize("bits", [2, 10])
def test_equals_brute_force(spark, bits):
    table = [(i, f"text {i % 11}", lang, f"s{i % 3}", None if i % 5 == 0 else i, *["x"] * 7)
             for i in range(97) for lang in ([None] if i % 13 == 0 else ["a", "ä"] if i == 5 else ["a" if i < 70 else "b"])]
    docs = table_of(spark, [])
    docs = spark.createDataFrame(table, docs.schema).repartition(7)
    got = found(docs, bits=bits, nodes=True).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == brute(table)
    # A version copies one node for every level above its leaf and ends in its root.
    for r in got:
        assert len(r.copied) == r.n_copied
        assert (r.copied[-1] if r.copied else r.root) == r.folded_root
    assert any(r.copied for r in got) and any(not r.copied for r in got)


def test_edges(spark):
    assert sorted((tuple(r)[:6] for r in found(edge(spark)).collect()), key=str) == brute(EDGE)
    assert found(empty(spark)).collect() == []


def test_one_changed_leaf_is_its_own_root(spark):
    hit = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 0)
    table = [(hit, "alone", "a", "s", 5, *["x"] * 7)]
    got = found(spark.createDataFrame(table, table_of(spark, []).schema)).first()
    assert (got.leaf == got.root) and got.folded_root != got.root and got.n_copied == 0
    assert rows((hit, "alone"))[0][0] == hit


def kept(spark, n=97):
    table = [(i, f"text {i}", None if i % 13 == 0 else "a" if i < 70 else "b", "s", i, *["x"] * 7) for i in range(n)]
    docs = spark.createDataFrame(table, table_of(spark, []).schema).repartition(7)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = merkle.tampered_leaf(fields[0], fields[3], fields[1:3], fields[4])
    return table, merkle.keep(docs, fields, F.col("lang"), F.col("doc_id"), changed, bits=3)


def test_every_version_is_read_from_stored_nodes(spark):
    table, store = kept(spark)
    known = {}
    for trees in (store.trees, store.forest):
        for r in trees.nodes().collect():
            assert r.hash == h(*[c for c in (r.left, r.right) if c is not None])
            known[r.hash] = (r.left, r.right)
    rows_ = merkle.versions(store).collect()
    places = {}
    for i, _, lang, *_ in sorted(table, key=lambda r: (r[2] is not None, r[2] or "", r[0])):
        places[i] = len(places)

    def leaves(node, nodes):
        if node not in nodes:
            return [node]
        return [leaf for child in nodes[node] if child is not None for leaf in leaves(child, nodes)]

    first = leaves(store.root, known)
    assert first == [r.leaf for r in sorted(rows_, key=lambda r: places[r.doc_id])]
    seen = 0
    for r in rows_:
        added = {c.hash: (c.left, c.right) for c in r.copied}
        assert not set(added) & set(known)
        now = leaves(r.folded_root, known | added)
        assert [k for k, (a, b) in enumerate(zip(first, now, strict=True)) if a != b] == ([places[r.doc_id]] if added else [])
        seen += bool(added)
    assert seen == sum(zlib.crc32(str(r[0]).encode()) % 7 == 0 for r in table)


def test_places_of_stored_nodes(spark):
    table, store = kept(spark)
    want = set()
    for lang in {r[2] for r in table}:
        of = [h(*map(told, (i, s, lang_, n, t))) for i, t, lang_, s, n, *_ in table if lang_ == lang]
        for level, nodes in enumerate(tree(of)):
            want |= {("n" if lang is None else f"v{lang}", level, pos, node) for pos, node in enumerate(nodes) if level}
    assert {(r.tree, r.level, r.pos, r.hash) for r in store.trees.nodes().collect()} == want


def test_untouched_leaves_are_folded_too(spark):
    _, store = kept(spark)
    # One stored node of the tree of "a" is damaged: parent of its leaves 0 and 1, so sibling of 2 and 3.
    damaged = F.when((F.col("tree") == "va") & (F.col("block") == 0), F.transform(
        "nodes", lambda level, k: F.when(k == 0, F.concat(F.array(F.lit("0" * 64)), F.slice(level, 2, F.size(level) - 1)))
        .otherwise(level))).otherwise(F.col("nodes"))
    store.trees.tiers[0] = store.trees.tiers[0].withColumn("nodes", damaged)
    off = {r.doc_id for r in merkle.versions(store).collect() if r.folded_root != store.root and not r.copied}
    hit = {i for i in (3, 4) if zlib.crc32(str(i).encode()) % 7 == 0}
    assert off == {3, 4} - hit and off
