"""Training-data operators on small tables: brute force, round trips, awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from farewatch.llm import (chat, decontaminate, jaccard, mixing, packing, sharding, sketch, substring, texthash, topk,
                           toxicity, warc)
from farewatch.llm.common import shared_folder
from farewatch.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, size int, shard string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def corpus(seed=3, n=60):
    """Texts with copies, near copies, shared passages, repeats, short and empty ones."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Äé", "x y", " "]

    def prose(k):
        return " ".join(rng.choice(vocab) for _ in range(k))

    passage, base = prose(40), prose(80).split()
    texts = [None, "", " \n\t ", "one two", "One two", "a b c d e", "A b c d e"]
    for i in range(n):
        kind = i % 6
        near = list(base)
        near[rng.randrange(80)] = f"edit{i}"
        texts.append([prose(60), prose(20) + " " + passage + "\n" + prose(5), " ".join(near), texts[rng.randrange(len(texts))],
                      "same " * 50, prose(3)][kind])
    texts.append(prose(3000) + " " + passage)
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", 0, "p", 1, "x") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    return corpus() + [(None, "w1 w2 w3 w4 w5 w6"), (8, "w1 w2 w3 w4 w5 w6"), (8, "w1 w2 w3 w4 w5 w6")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# -- hashing and the sketch -------------------------------------------------

def test_text_blocks_split_words_like_the_pattern(monkeypatch):
    monkeypatch.setattr(texthash, "SLICE_BYTES", 64)
    texts = [t for _, t in corpus()] + ["x" * 500, "a " * 100 + "y" * 200]
    hasher, got, known = texthash.Hasher(2), [], {}
    for block in texthash.text_blocks(pa.array(texts, pa.string()), hasher):
        for a, b in itertools.pairwise(block.first):
            got.append([block.data[s:e].tobytes() for s, e in zip(block.starts[a:b], block.ends[a:b])])
            for w, h in zip(got[-1], zip(*(x[a:b].tolist() for x in block.hashes))):
                assert known.setdefault(w, h) == h
    assert got == [words(t) for t in texts]
    assert len(set(known.values())) == len(known)


def test_gap_codes_round_trip():
    rng = np.random.default_rng(1)
    for top, n in ((10, 5), (1 << 22, 3), (1 << 22, 5000), (300, 300), (1 << 22, 1)):
        values = np.sort(rng.integers(0, top, n))
        assert (sketch.decode_gaps(sketch.encode_gaps(values)) == values).all()


def test_sketch_never_underestimates(spark, docs):
    copy = sketch.copy_by_part(docs, "t")
    path, bits = sketch.build(copy, substring._sketch_keys(3), 100, "t")
    hasher, true, parts = texthash.Hasher(1), {}, {}
    batch = copy.toArrow().combine_chunks().to_batches()[0]
    for part, _, block in sketch.part_blocks(batch, hasher):
        (keys,), _, _ = substring._windows(block, hasher, 3)
        parts.setdefault(part, []).append(keys)
        for k in keys.tolist():
            true[k] = true.get(k, 0) + 1
    for part, keys in parts.items():
        keys = np.unique(np.concatenate(keys))
        got = sketch.Estimates(path, part, bits).count(keys)
        assert all(g >= c for g, c in zip(got.tolist(), sketch.count_code(np.array([true[k] for k in keys.tolist()])).tolist()))


def test_count_codes_keep_the_order():
    counts = np.r_[np.arange(1, 5000), 2 ** np.arange(13, 31)]
    codes = sketch.count_code(counts)
    assert codes[0] == 1 and (codes[1:] > 1).all() and (np.diff(codes.astype(int)) >= 0).all()
    assert (codes[:64] == np.arange(1, 65)).all() and sketch.count_code(np.array([300]))[0] < sketch.count_code(np.array([10**8]))[0]


def test_hot_cells_are_merged_and_saturate(monkeypatch):
    """One key holds a third of all occurrences, in many flushes; its count stops at the largest number."""
    monkeypatch.setattr(sketch, "COUNT_CAP", 1000)
    rng, bits = np.random.default_rng(3), 22
    others = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    flushes = [np.concatenate([np.full(1000, 77, dtype=np.uint64), others[i * 1000:i * 1000 + 2000]]) for i in range(3)]
    records = [r for part, keys in enumerate(flushes) for r in sketch.sketch_records(part, keys, bits)]
    assert max(len(r[3]) for r in records) < 2 * 2100
    group = pd.DataFrame([r[1:] for r in records if r[0] == 0], columns=["segment", "part", "gaps", "several"])
    merged = sketch._merge_segment(22)((0, 0), group)
    hot, twice = (int(sketch.cells_of(np.array([k], dtype=np.uint64), 0, bits)[0]) for k in (77, others[1500]))
    for _, row in merged.iterrows():
        codes = dict(zip(sketch.decode_gaps(row["gaps"]).tolist(), np.frombuffer(row["counts"], dtype=np.uint8).tolist()))
        assert codes[hot] == sketch.count_code(np.array([1000]))[0]
        assert row["part"] == 2 or codes[twice] >= 2


def test_segments_grow_with_the_sketch():
    assert [sketch.segment_bits(b) for b in (22, 30, 34, 36, 38, 45)] == [22, 22, 22, 24, 26, 26]


# -- 6 substring ------------------------------------------------------------

def brute_substring(rows, window):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[i:i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i:i + window])] < d for j in range(i, i + window)}
        out.append((d, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [3, 13])
def test_substring_equals_brute_force(docs, rows, window):
    got = sorted((tuple(r) for r in substring.dedup_substrings(docs, window).collect()), key=str)
    assert got == brute_substring(rows, window)


# -- 8 jaccard --------------------------------------------------------------

def brute_classes(rows, threshold=75, k=5):
    sets = []
    for _, t in rows:
        w = [x.lower() if x.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(t)]
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        same = rows[a][0] is not None and rows[a][0] == rows[b][0]
        if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
            continue
        o = len(sets[a] & sets[b])
        if same or 100 * o >= threshold * (len(sets[a]) + len(sets[b]) - o):
            parent[find(a)] = find(b)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[find(i)] = min(smallest.get(find(i), d), d)
    return sorted(((d, len(sets[i]), smallest.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_jaccard_equals_brute_force(docs, rows):
    got = sorted((tuple(r) for r in jaccard.jaccard_classes(docs).collect()), key=str)
    assert got == brute_classes(rows)


def test_one_row_of_a_repeated_representative_stays(spark):
    text, other = "a b c d e f g h", "q r s t u v w x"
    table = [(1, text), (2, text), (1, text), (1, other), (1, text), (2, text), (3, "alone here"), (3, "alone here"),
             (None, text), (None, text), (4, ""), (4, ""), (5, None)]
    kept = jaccard.keep_representatives(frame(spark, table).repartition(3))
    assert kept.columns == frame(spark, []).columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(
        [(1, text), (1, other), (3, "alone here"), (None, text), (None, text), (4, ""), (4, ""), (5, None)])


def several_texts():
    """Documents that have two texts each link through both; the texts lie in any part."""
    rng = random.Random(8)
    a, b, c = (" ".join(f"{x}{rng.randrange(999)}" for _ in range(40)) for x in "abc")
    return [(1, a), (2, a), (2, b), (3, b + " end"), (4, c), (5, c), (5, "short one"), (6, "short one"), (None, a), (7, ""), (7, c + " z")]


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_several_texts_of_a_document(spark, parts):
    rows = several_texts()
    table = frame(spark, rows).repartition(parts)
    want = brute_classes(rows)
    assert {d: c for d, n, c in want if d and n} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4}
    assert sorted((tuple(r) for r in jaccard.jaccard_classes(table).collect()), key=str) == want
    # Every text has a kept row that it links with: no text is lost with its document's other text.
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.keep_representatives(table).collect())
    assert kept == Counter([rows[i] for i in (0, 2, 4, 6, 8, 9)])


def test_representatives_keep_columns_of_any_name(spark):
    table = frame(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")]).withColumn("__part", F.lit("p")).withColumn(
        "row", F.col("doc_id") * 10).withColumn("class", F.lit(1))
    kept = jaccard.keep_representatives(table)
    assert kept.columns == table.columns
    assert sorted((r["doc_id"], r["row"], r["__part"], r["part"]) for r in kept.collect()) == [(1, 10, "p", "p"), (3, 30, "p", "p")]


def test_jaccard_many_overlapping_groups(spark, monkeypatch):
    """Chains of edits: links exist only between some pairs, and lists are cut into grid cells."""
    monkeypatch.setattr(jaccard, "LIST_CELL", 8)
    rng, rows = random.Random(5), []
    for g in range(6):
        text = [f"g{g}_{i}" for i in range(60)] + [f"all{i}" for i in range(30)]
        for _ in range(25):
            text = list(text)
            text[rng.randrange(len(text))] = f"e{rng.random()}"
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    got = sorted((tuple(r) for r in jaccard.jaccard_classes(frame(spark, rows)).collect()), key=str)
    assert got == brute_classes(rows)


def test_list_pairs_skips_only_what_cannot_link():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 60, 300)
    rest = np.array([rng.integers(1, s + 1) for s in sizes])
    ids, groups, sides = np.arange(300), rng.integers(0, 5, 300), np.zeros(300, dtype=int)
    got = {frozenset(p) for p in jaccard.list_pairs(rest, sizes, ids, groups, sides, 75)}
    want = {frozenset((a, b)) for a, b in itertools.combinations(range(300), 2) if groups[a] != groups[b]
            and min(rest[a], rest[b]) * 175 >= (sizes[a] + sizes[b]) * 75 and max(sizes[a], sizes[b]) * 75 <= 100 * min(sizes[a], sizes[b])}
    assert got == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "v long, u long")).collect()))
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for v in sorted(near):
        todo = [v]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = v
                todo += near[x]
    assert got == want
    assert components(spark.createDataFrame([], "v long, u long")).count() == 0


# -- 9 sharding -------------------------------------------------------------

def test_shards_cover_all_rows_and_balance(spark, docs, rows):
    many = [(i, "x" * (i * 7 % 90)) for i in range(3000)] + [(9000 + i, "hot text") for i in range(1500)]
    for table, source in ((docs, rows), (frame(spark, many), many)):
        got = sharding.shard_rows(table, 5).collect()
        assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == sorted(
            (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in source if d is not None)
        assert len(got) == len(source)
        shards = {}
        for r in got:
            shards.setdefault(r["shard"], []).append(r)
        assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in shards.values())
    sizes = [sum(r["size"] for r in rs) for rs in shards.values()]
    assert len(sizes) == 5 and max(sizes) <= 1.02 * min(sizes)


def test_write_shards_keeps_whole_rows(docs, spark):
    back = sharding.write_shards(docs.drop("shard"), 4, shared_folder(spark, "shards"))
    assert back.count() == docs.count()
    assert {tuple(r) for r in back.select("doc_id", "text").collect()} == {tuple(r) for r in docs.select("doc_id", "text").collect()}


def test_sharded_rows_come_from_whole_rows_in_the_shards(spark, rows):
    table = frame(spark, [*rows, rows[5], (9001, None), (None, "no id"), (None, "no id")])
    table = table.withColumn("shard", F.lit("old")).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id"))).coalesce(3)
    got = sharding.shard_rows(table, 4, keep=("lang",))
    folder = got.inputFiles()[0].split("/shard=")[0]
    back = spark.read.parquet(folder)
    names = [{"shard": "input_shard"}.get(c, c) for c in table.columns]
    assert Counter(map(tuple, back.select(*names).collect())) == Counter(map(tuple, table.collect()))
    assert Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()), r["lang"], r["shard"], r["slot"])
                   for r in back.collect()) == Counter(map(tuple, got.collect()))
    shards = {}
    for r in back.collect():
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(shards) == [0, 1, 2, 3] and all(sorted(s) == list(range(len(s))) for s in shards.values())


# -- 1 mixing ---------------------------------------------------------------

def test_raking_meets_targets(spark):
    cells = spark.createDataFrame([(s, l, t, 100 + 37 * i) for i, (s, l, t) in enumerate(
        itertools.product("abc", "xy", "pq"))], "source string, lang string, topic string, tokens long")
    targets = {"source": [("a", .2), ("b", .3), ("c", .5)], "lang": [("x", .6), ("y", .4)], "topic": [("p", .5), ("q", .5)]}
    fitted = mixing.rake(cells, {d: spark.createDataFrame(v, f"{d} string, share double") for d, v in targets.items()},
                         budget=0.3, iterations=10)
    total = 0.3 * cells.agg(F.sum("tokens")).first()[0]
    for d, shares in targets.items():
        now = dict(map(tuple, fitted.groupBy(d).agg(F.sum("weight")).collect()))
        for value, share in shares:
            assert now[value] == pytest.approx(share * total, rel=1e-3)


def test_report_names_targets_out_of_reach(spark):
    """Source a is wanted more than it has: its cells are full and the rest of its target is reported."""
    cells = spark.createDataFrame([("a", "x", "p", 100), ("b", "x", "p", 500), ("c", "y", "p", 400)],
                                  "source string, lang string, topic string, tokens long")
    shares = {"source": [("a", .5), ("b", .3), ("c", .2)], "lang": [("x", .8), ("y", .2)], "topic": [("p", 1.0)]}
    targets = {d: spark.createDataFrame(v, f"{d} string, share double") for d, v in shares.items()}
    got = {(r["dimension"], r["value"]): r for r in mixing.residuals(mixing.rake(cells, targets, 0.5), targets, 0.5).collect()}
    a = got["source", "a"]
    assert a["full"] and a["target"] == 0.5 and a["reached"] == pytest.approx(0.2, abs=1e-6) and a["residual"] == pytest.approx(0.3, abs=1e-6)
    assert not got["source", "b"]["full"] and len(got) == 6
    for d in mixing.DIMENSIONS:
        assert sum(r["reached"] for r in got.values() if r["dimension"] == d) <= 1 + 1e-9


def test_report_covers_the_corpus(docs):
    got = mixing.mixing_report(docs).collect()
    assert {r["dimension"] for r in got} == set(mixing.DIMENSIONS)
    for d in mixing.DIMENSIONS:
        assert sum(r["target"] for r in got if r["dimension"] == d) == pytest.approx(1.0)


def test_drawn_documents_agree_with_the_report(docs):
    report = mixing.mix_sources(docs)
    drawn = mixing.draw_documents(docs)
    assert drawn.columns == docs.columns
    want = sorted(r["doc_id"] for r in report.where("copies > 0 AND doc_id IS NOT NULL").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in drawn.where("doc_id IS NOT NULL").select("doc_id").collect()) == want
    assert report.count() == docs.count()
    assert report.where("n_tokens = 0 AND copies > 0 AND probability = 0").count() == 0


# -- 2 packing --------------------------------------------------------------

def test_best_fit_takes_the_tightest_row():
    rng = random.Random(4)
    for _ in range(50):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 80))]
        rows = packing.best_fit_decreasing(lengths, 64)
        room, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [c for c in room if c >= lengths[i]]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - lengths[i])
            else:
                room.append(64 - lengths[i])
        want = sorted(64 - c for c in room)
        assert sorted(sum(lengths[i] for i in r) for r in rows) == want
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))


@pytest.mark.parametrize("space", [" ", "\n", " \t\u3000", "\x1f"])
def test_long_runs_are_cut_where_the_pattern_would(monkeypatch, space):
    """Equal to the plain encoder, whatever is around the run."""
    monkeypatch.setattr(packing, "_LONG_SPACE", re.compile(packing._LONG_SPACE.pattern.replace(str(packing.LONG_RUN), "4")))
    with open(packing.VOCABULARY, "rb") as f:
        encoding = packing.load_encoding(f.read())
    for n in (1, 3, 4, 5, 40):
        for before, after in itertools.product(["", "x", "1 ", "é\n", "!"], ["", "x", "1", "'s", "\x1f", "中"]):
            text = before + space * n + after + space * 5 + "end" + space * n
            assert packing.encode_text(encoding, text).tolist() == encoding.encode(text, disallowed_special=())


def test_texts_of_millions_of_equal_characters_are_packed(spark):
    texts = ["x" + " " * 3_000_000 + "y", "\n" * 2_000_000, "a" * 1_200_000]
    packed = packing.packed_rows(frame(spark, list(enumerate(texts)))).cache()
    with open(packing.VOCABULARY, "rb") as f:
        encoding = packing.load_encoding(f.read())
    pieces = {}
    for r in packed.collect():
        ids = np.frombuffer(r["input_ids"], dtype="<u2")
        for doc, at, a, b in zip(r["doc_ids"], r["piece_offsets"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:]):
            pieces[doc, at] = ids[a:b]
    for doc, text in enumerate(texts):
        ids = np.concatenate([pieces[k] for k in sorted(pieces) if k[0] == doc])
        assert ids[-1] == packing.END_ID and encoding.decode(ids[:-1].tolist()) == text


def test_packing_is_lossless(docs, rows):
    packed = packing.pack_tokens(docs, row_length=128).collect()
    with open(packing.VOCABULARY, "rb") as f:
        encoding = packing.load_encoding(f.read())
    pieces = {}
    for r in packed:
        ids, places = (np.frombuffer(bytes(r[c]), dtype="<u2") for c in ("input_ids", "position_ids"))
        assert len(ids) == 128 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"]
        for doc, at, a, b in zip(r["doc_ids"], r["piece_offsets"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:]):
            assert places[a:b].tolist() == list(range(b - a))
            pieces.setdefault(doc, []).append((at, ids[a:b].tolist()))
    for doc, text in rows:
        if doc is not None and doc != 8:
            ids = [i for _, own in sorted(pieces[doc]) for i in own]
            assert ids[-1] == packing.END_ID and encoding.decode(ids[:-1]) == (text or "")
    assert sum(len(p) for p in pieces.values()) >= len(rows) and len(pieces[8]) == 2


# -- 3 WARC -----------------------------------------------------------------

def test_warc_round_trip(spark):
    import gzip

    big, huge = "Ä" * 700, "<p>\r\n\r\nWARC/1.1\r\n" * 200_000
    pages = [(1, "http://a/?q=%20 b\n", big), (5, None, big), (3, "http://c", "short"), (4, "http://d", "short"), (6, "u", None),
             (None, "v", "no id"), (8, "h", huge), (9, "h", huge), (9, "h", huge), (10, "e", "")]
    table = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string").repartition(2)
    manifest = warc.normalise(warc.write_archives(warc.plan_records(table), shared_folder(spark, "warc")))
    got = warc.read_archives(manifest, with_payload=True).collect()
    key = lambda r: str((r[0], r[1]))
    want = []
    for p, u, h in pages:
        data = (h or "").encode()
        same = max([q for q, _, g in pages if (g or "") == (h or "") and q is not None], default=None)
        refers = same if len(data) >= 1000 and p is not None and p != same else None
        want.append((p, u, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers,
                     data if refers is None else None))
    assert sorted([(*tuple(r)[:6], None if r["payload"] is None else bytes(r["payload"])) for r in got], key=key) == sorted(want, key=key)
    for r in manifest.collect():  # every index line points at a member that inflates alone
        with open(r["index_path"].removeprefix("file:"), encoding="utf-8") as idx, open(r["path"].removeprefix("file:"), "rb") as f:
            lines = [line.split("\t") for line in idx]
            assert len(lines) == r["records"]
            for offset, length, kind, _ in lines:
                f.seek(int(offset))
                assert gzip.decompress(f.read(int(length))).startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode())


# -- 4 chat -----------------------------------------------------------------

NASTY = ["", "\\", "\\\\<turn", "</turn>\n", "\n</turn>\n<turn role=assistant>\nx", chat.PROBE_TEXT, "<\\turn", "\\<turn role=", "a\\", "é\n\n"]


def test_turns_read_back(spark):
    rows = [(c, i, ["user", "assistant", "odd>role\n%", None][(c + i) % 4], t) for c in range(3) for i, t in enumerate(NASTY)] + [
        (None, 0, "user", None), (50, None, "assistant", "x"), (50, 1, "assistant", "y"), (50, 1, "assistant", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_trees(chat.conversations_as_trees(table))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_reply_tree_branches(spark):
    tree = [("t", 1, None, "user", "q", 1), ("t", 2, 1, "assistant", "bad", 0), ("t", 3, 1, "assistant", "good", 9),
            ("t", 4, 3, "user", "more", 2), ("t", 5, 4, "assistant", "end", 5), ("t", 6, 99, "user", "orphan", 1),
            ("c", 1, 2, "user", "x", 1), ("c", 2, 1, "user", "y", 1), ("c", 3, 1, "user", "z", 1)]
    table = spark.createDataFrame(tree, "tree string, msg long, parent long, role string, text string, score int")
    paths = chat.enumerate_paths(table).collect()
    by_leaf = {}
    for r in paths:
        by_leaf.setdefault((r["tree"], r["leaf"]), []).append((-r["distance"], r["msg"]))
    assert {k: [m for _, m in sorted(v)] for k, v in by_leaf.items()} == {("t", 2): [1, 2], ("t", 5): [1, 3, 4, 5], ("t", 6): [6]}
    best = chat.format_trees(table, branches=2).orderBy("branch").collect()
    assert [(r["leaf"], r["branch"]) for r in best] == [(5, 1), (6, 2)]
    assert best[0]["formatted"].count("<turn role=") == 4


# -- 5 top-k ----------------------------------------------------------------

def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = [(int(i), rng.normal(size=6).round(2).tolist()) for i in range(400)]
    vectors += [(500, [float("nan")] * 6), (550, None), (601, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (650, [1e6] * 6), (None, [1.0] * 6),
                (700, [float("inf")] * 6), (750, [0.5] * 3), (751, [0.25] * 3), (1, vectors[1][1])]
    table = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<double>, label int")
    for sizes in ({}, {"range_rows": 50, "group_rows": 3, "block_rows": 7}):
        got = sorted(map(tuple, topk.exact_top_k(table, **sizes).collect()))
        clean = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors
                 if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
        want = []
        for q, v in clean.items():
            if q % 50 == 0:
                best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in clean.items() if i != q and len(w) == len(v))[:5]
                want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
        assert got == sorted(want)


def test_top_k_of_repeated_ids_equals_sql(spark):
    """Several vectors of one id all take part; repeated rows count once."""
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in (0, 0, 1, 1, 2, 50, 50, 50, 7, 8, 9, 9)]
    rows += [(1, [0.1, 0.0, 0.0]), (1, [9.0, 0.0, 0.0]), rows[2], rows[5], (3, None), (None, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.register("embeddings", table.toArrow())
    want = con.sql(topk.ORACLE_SQL).fetchall()
    for sizes in ({}, {"range_rows": 2, "group_rows": 1, "block_rows": 1}):
        got = [tuple(r) for r in topk.exact_top_k(table, **sizes).select("query_id", "rank", "vec_id", "score").collect()]
        assert sorted(got) == sorted(want) and (50, 1, 1) in {r[:3] for r in got}


def test_blocks_below_the_kth_score_are_not_visited():
    ids = np.arange(4000)
    vectors = np.zeros((4000, 4), dtype=np.int64)
    vectors[:, 0] = np.arange(4000)
    seen = []
    _, found, _ = topk.search_cell(np.array([-1]), np.array([[3, 0, 0, 0]]), ids, vectors, 5, 100, seen)
    assert found.tolist() == [3999, 3998, 3997, 3996, 3995] and seen == [1]


# -- 7 decontamination ------------------------------------------------------

def edits(text, n, rng):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        chars[at:at + rng.randint(0, 1)] = rng.choice(["", "z", "q"])
    return "".join(chars)


def distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row, best = new, min(best, new[-1])
    return best


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(12))) for i in range(6)]
    items += [(6, None), (7, "short"), (8, ""), (3, items[3][1])]
    texts = [None, "", "nothing here"]
    for n in range(30):
        leak = edits(items[n % 6][1], n % 9, rng)
        texts.append("so: " + leak.upper() + "!! and " + ("x " * n) + items[(n + 1) % 6][1][:20])
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_leaks(frame(spark, rows), benchmark).collect())
    want = []
    for d, t in rows:
        for i, p in items:
            p, line = decontaminate.normal_form(p), decontaminate.normal_form(t)
            if len(p) >= decontaminate.MIN_CHARS and distance(p, line) <= int(decontaminate.ERROR_RATE * len(p)):
                want.append((d, i, distance(p, line)))
    assert got == sorted(want) and got
    clean = decontaminate.drop_leaks(frame(spark, rows), benchmark)
    assert clean.count() == len(rows) - len({d for d, _, _ in want}) and clean.columns == frame(spark, rows).columns


def test_short_and_symbol_items_are_found(spark):
    items = [(1, "What is it?"), (2, "42"), (3, "水的沸点是多少度？"), (4, "∑ ≠\n∞"), (5, "x**2+1"), (6, " \t"), (7, "_"), (8, "is it"),
             (9, "capital of peru"), (10, "中国最长的河流是哪一条河请回答")]
    texts = {1: "So: WHAT, is it now", 2: "room 421 or 142", 3: "room 42.", 4: "请问水的沸点是多少度呢", 5: "we know ∑  ≠ ∞.", 6: "x 2 1",
             7: "what is item", 8: "a_b", 9: "the capitol of peru?", 10: "!?", 11: "问:中国最长的河是哪一条河请回答!", 12: "∑≠∞", 13: ""}
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(frame(spark, texts.items()), benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in found) == [
        (1, 1, 0), (1, 8, 0), (3, 2, 0), (4, 3, 0), (5, 4, 0), (6, 5, 0), (8, 7, 0), (9, 9, 1), (11, 10, 1)]
    assert {r["item_id"]: r["match_end"] for r in found if r["doc_id"] in (1, 5)} == {1: 13, 8: 13, 4: 13}
    clean = decontaminate.drop_leaks(frame(spark, texts.items()), benchmark)
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 7, 10, 12, 13]


# -- 10 toxicity ------------------------------------------------------------

def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network(np.array([1, 2, 3], dtype=np.uint64), 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((5, toxicity.WORD_DIM + 2 * toxicity.CHAR_DIM))
    inverse, mask = rng.integers(0, 5, (6, 4)), np.arange(6)[:, None] < np.array([6, 3, 1, 5])
    labels, weights = np.array([1., 0, 1, 0]), np.ones(4)
    _, grad, _ = net.gradients(x, inverse, mask, labels, weights)
    for k, g in grad.items():
        flat = net.p[k].ravel()
        for i in rng.integers(0, len(flat), 3):
            old = flat[i]
            flat[i] = old + 1e-3
            up = net.gradients(x, inverse, mask, labels, weights)[0]
            flat[i] = old - 1e-3
            down = net.gradients(x, inverse, mask, labels, weights)[0]
            flat[i] = old
            assert (up - down) / 2e-3 == pytest.approx(np.asarray(g).ravel()[i], abs=1e-3)


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 96, 97, 500):
        _, starts = toxicity.window_starts(np.array([n]))
        assert {w for s in starts for w in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))


def test_held_out_accuracy(spark):
    """Planted rude words, anywhere in a text, on documents the training did not see."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        if i % 5 == 0:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["grumblefoo", "snarkbar", "vexqux"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(None, None), (9000, ""), (9001, "!!")]
    table = frame(spark, rows)
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    net = toxicity.fit(table, known)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table, net).collect()}
    assert len(got) == len(rows) and got[None] == got[9000] == got[9001] == 0
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    wrong = [i for i in held if (got[i] >= toxicity.THRESHOLD) != (i % 5 == 0)]
    assert len(held) > 100 and len(wrong) <= 0.03 * len(held)
    kept = toxicity.drop_toxic(table, net)
    assert kept.columns == table.columns and kept.count() == sum(s < toxicity.THRESHOLD for s in got.values())
    assert toxicity.fit(table, known.where("toxic = 0")) is None


# -- empty tables -----------------------------------------------------------

def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    outs = [mixing.mix_sources(empty, iterations=1), mixing.draw_documents(empty, iterations=1), packing.pack_tokens(empty),
            warc.archive_pages(pages), chat.conversation_digests(chat.format_trees(chat.conversations_as_trees(turns))),
            topk.exact_top_k(vectors), substring.dedup_substrings(empty), decontaminate.find_leaks(empty, items),
            decontaminate.drop_leaks(empty, items), jaccard.jaccard_classes(empty), jaccard.keep_representatives(empty),
            sharding.shard_rows(empty, 3), toxicity.score(empty, toxicity.fit(empty, labels))]
    assert [o.count() for o in outs] == [0] * len(outs)


# -- pipeline ---------------------------------------------------------------

def test_pipeline_stages_decide_as_their_operators(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "mixing", "token_output"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("text", F.when(F.col("doc_id") != 3, F.col("text")))
    _, near = corpus_pipeline.STAGES[1]
    kept = near(spark, docs, SF_SMALL)
    want = brute_classes([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, c in want if d == c)
    assert kept.columns == docs.columns
    _, leaks = corpus_pipeline.STAGES[2]
    assert set(leaks(spark, kept, SF_SMALL).columns) == set(docs.columns)
