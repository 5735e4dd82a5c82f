"""Merkle manifest against a plain recursive tree, with deep butterflies and awkward rows."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from farewatch.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, root string, leaf string, slot int"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fanout):
    """(root, siblings of each node as [(left, right)] by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p // fanout * fanout
            paths[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1:run + fanout])))
        nodes = [h("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [p // fanout for p in at]
    return nodes[0], paths


def brute(rows, fanout=16):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subtrees = {}
    for s, own in by_source.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subtrees[s] = tree([leaf(r) for r in own], fanout)
    root, tops = tree([subtrees[s][0] for s in order], fanout)
    out = []
    for s, top in zip(order, tops):
        subroot, paths = subtrees[s]
        for r, path in zip(by_source[s], paths):
            steps = path + top
            given = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                given = leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            folded = given
            for a, b in steps:
                folded = h(a + folded + b)
            out.append((r[0], leaf(r), subroot, root, h("".join(a + b for a, b in steps)), folded, folded == root))
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS)


def make_rows(sizes, seed=1):
    rng = random.Random(seed)
    rows = []
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((len(rows) * 7 % 5003, s, rng.choice([None, "en", "é"]), rng.choice([None, 3, -4]),
                         rng.choice([None, "", "Abc", "abc", "ÄÖ z", "Q" * rng.randrange(9)])))
    rng.shuffle(rows)
    return rows


def test_manifest_equals_plain_trees(spark):
    rows = make_rows({"a": 1, "b": 2, None: 16, "": 17, "ä": 300, "Z": 5, "z": 33, **{f"s{i}": 1 for i in range(12)}})
    rows += [(None, "b", "en", 1, "A"), (None, "b", "en", 1, "B"), (5, "b", "en", 1, "x"), (5, "b", "en", 2, "x"), (5, "b", "en", 1, "x")]
    rows += [(9, "long", "en", 1, "Wide " * 300_000)] + [(11, "copies", "en", 1, "Same")] * 40
    got = Counter(tuple(r) for r in merkle.verify_tampered(frame(spark, rows).repartition(5)).collect())
    want = brute(rows)
    assert got == want
    assert any(not k[-1] for k in want) and any(k[-1] for k in want)


@pytest.mark.parametrize("fanout, sizes", [(2, {"a": 37, None: 64, "b": 33, "c": 1, "d": 5, "e": 2, "f": 8}),
                                           (3, {"a": 82, "b": 81, "c": 10, "d": 28})])
def test_deep_butterflies(spark, monkeypatch, fanout, sizes):
    """Complete, incomplete and lone subtrees over many rounds, below and above the subroots."""
    monkeypatch.setattr(merkle, "FANOUT", fanout)
    monkeypatch.setattr(merkle, "PART_LEAVES", fanout**2)
    monkeypatch.setattr(merkle, "LANE_PARTS", 3)
    rows = make_rows(sizes, fanout)
    got = Counter(tuple(r) for r in merkle.verify_tampered(frame(spark, rows).repartition(3)).collect())
    assert got == brute(rows, fanout)


def test_groups_of_a_round_stay_small(spark):
    """Every slot of a tree with an incomplete last subtree meets each subtree once, in groups of at most FANOUT."""
    nodes = spark.range(16 * 16 + 3).select(F.lit("t").alias("tree"), F.col("id").alias("slot"), F.lit(16 * 16 + 3).cast("long").alias("slots"),
                                           F.lpad((F.col("id") / 16).cast("long").cast("string"), 64, "0").alias("node"))
    met = merkle.swap_roots(nodes, 16).collect()
    assert sorted(r["slot"] for r in met) == list(range(16 * 16 + 3))
    for r in met:
        digit = r["slot"] // 16 % 16
        want = [f"{d:064d}" for d in range(16)] if r["slot"] < 256 else [f"{16:064d}"]
        assert r["left"] + f"{r['slot'] // 16:064d}" + r["right"] == "".join(want)
        assert len(r["left"]) == 64 * digit


def test_proofs_lead_to_the_root(spark):
    rows = make_rows({"a": 40, "b": 300, None: 3})
    manifest = merkle.build_manifest(frame(spark, rows))
    proofs = manifest.proofs().collect()
    assert len(proofs) == len(rows) and len({r["root"] for r in proofs}) == 1
    assert all(merkle.fold(r["leaf"], list(zip(r["left"], r["right"]))) == r["root"] for r in proofs)
    by_leaf = Counter((r["doc_id"], r["leaf"]) for r in proofs)
    assert by_leaf == Counter((r[0], leaf(r)) for r in rows)


def test_empty_table(spark):
    assert merkle.verify_tampered(frame(spark, [])).collect() == []
