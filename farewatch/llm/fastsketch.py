"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

*Sketch.*  A set's sketch has ``COORDINATES`` bins filled in rounds.  In each of the
first ``COORDINATES`` rounds every item is hashed to one bin with a value of that
round; values of an earlier round are smaller, so a filled bin never changes in
a later one.  As many further rounds offer the whole set to one bin each, so
that no bin stays empty; a set stops at the first round that leaves none empty
(large sets need one or two, a single item all of them).  Two sets agree on a
bin with a probability equal to their similarity, and the share of agreeing
bins is as concentrated as that of independent draws.

*Banding.*  ``BANDS`` keys of ``BAND_ROWS`` bins each put documents into buckets.  A pair
of similarity 0.8 shares none with a probability of (1 - 0.8^4)^32, under 5 in 10^8.

*Verification.*  Equal sets are one class before anything is joined.  In a bucket
each member is paired with the bucket's centre, the member whose buckets are the
fullest; a member's pair with its most frequent centre is checked on the full sets
first, and pairs inside a class that this connects are dropped.  What is left open
in buckets whose other members lie in several classes is narrowed by the members'
rarest shingles (two linked sets share one of them), never by all pairs, and checked
on the full sets.  A bucket's size is not limited.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from farewatch.llm import sketch
from farewatch.llm.common import WORD_PATTERN, save
from farewatch.llm.graph import components
from farewatch.llm.jaccard import least_overlap, linked, remaining_pairs
from farewatch.llm.texthash import Hasher, mix, text_blocks

SHINGLE = 4
# Similarity threshold as a percentage.
THRESHOLD = 80
# Bins of a sketch (a power of two), and how they are cut into bands.
COORDINATES = 128
BAND_ROWS = 4
BANDS = COORDINATES // BAND_ROWS
# Members that are checked against one copy of their centre's set.
CENTRE_SHARE = 1024
# Items of sets held by a task before they are sent.
FLUSH_ITEMS = 200_000
DIGESTS = "row long, doc_id long, n long, d1 long, d2 long, bands array<long>"
SETS = "row long, part long, n int, items array<long>"
POSTINGS = "cid long, n int, pos int, item long"
_EMPTY = np.uint64(2**64 - 1)
_BIN_BITS = COORDINATES.bit_length() - 1
# A coordinate is its round, then as many bits of the item's hash as remain.
_VALUE_BITS = 64 - (2 * COORDINATES).bit_length()
_ROUND_SALT = 0xD1B54A32D192ED03
_BAND_SALT = 0xA0761D6478BD642F


def similarity_sketches(items: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sketches (sets x COORDINATES) of the sets ``items[first[i]:first[i + 1]]`` of 64-bit items; none may be empty."""
    m = len(first) - 1
    out = np.full(m * COORDINATES, _EMPTY, dtype=np.uint64)
    sets, owner = np.arange(m), np.repeat(np.arange(m), np.diff(first))
    for number in range(2 * COORDINATES):
        if not len(sets):
            break
        hashes = mix(items + np.uint64(_ROUND_SALT * (number + 1) % 2**64))
        values = (hashes & np.uint64(2**_VALUE_BITS - 1)) | np.uint64(number << _VALUE_BITS)
        bins = (hashes >> np.uint64(64 - _BIN_BITS)).astype(np.int64) if number < COORDINATES else number - COORDINATES
        np.minimum.at(out, owner * COORDINATES + bins, values)
        open_ = (out.reshape(m, COORDINATES)[sets] == _EMPTY).any(axis=1)
        if not open_.all():
            left = np.zeros(m, dtype=bool)
            left[sets[open_]] = True
            sets, on = sets[open_], left[owner]
            items, owner = items[on], owner[on]
    return out.reshape(m, COORDINATES)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One key a band; keys of different bands differ."""
    rows = sketches.reshape(len(sketches), BANDS, BAND_ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_BAND_SALT), rows.shape[:2])
    for i in range(BAND_ROWS):
        keys = mix(keys ^ rows[:, :, i]) * np.uint64(_BAND_SALT) + np.uint64(i)
    return mix(keys)


def shingle_sets(block, hasher: Hasher, shingle: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct shingles of every text of a block, per seed, and where each text's begin.

    Fewer words than a shingle make one shingle of the whole sequence.
    """
    wide = hasher.windows(block.hashes, shingle)
    parts: list[list[np.ndarray]] = [[] for _ in wide]
    for a, b in zip(block.first[:-1], block.first[1:], strict=True):
        if b - a >= shingle:
            own = [w[a:b - shingle + 1] for w in wide]
        elif b > a:
            own = hasher.windows([h[a:b] for h in block.hashes], int(b - a))
        else:
            own = [w[:0] for w in wide]
        _, at = np.unique(own[0], return_index=True)
        for part, o in zip(parts, own, strict=True):
            part.append(o[at])
    first = np.cumsum([0, *(len(p) for p in parts[0])])
    return [np.concatenate(p) if p else np.zeros(0, dtype=np.uint64) for p in parts], first


def _digest_task(shingle: int):
    def run(batches):
        import pyarrow as pa

        hasher = Hasher(2, fold_case=True)
        for batch in batches:
            for block in text_blocks(batch.column("text"), hasher):
                (items, second), first = shingle_sets(block, hasher, shingle)
                n = np.diff(first)
                sums = [np.diff(np.concatenate([[np.uint64(0)], np.cumsum(x)])[first]) for x in (items, second)]
                some = np.flatnonzero(n)
                keys = np.zeros((len(n), BANDS), dtype=np.uint64)
                if len(some):
                    keys[some] = band_keys(similarity_sketches(items, np.r_[first[some], first[-1]]))
                lists = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * BANDS, keys.reshape(-1).view(np.int64))
                rows = pa.array(block.rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(rows), batch.column("doc_id").take(rows), pa.array(n.astype(np.int64)),
                     *(pa.array(s.view(np.int64)) for s in sums), lists], names=["row", "doc_id", "n", "d1", "d2", "bands"])
    return run


def _set_task(wanted: str, shingle: int):
    """Full sets of the rows that the folder ``wanted`` names, looked up part by part."""
    def run(batches):
        import pyarrow as pa

        hasher, at, rows = Hasher(1, fold_case=True), None, None
        held, size = [], 0

        def flush():
            ids, sizes, items = zip(*held, strict=True)
            lists = pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype(np.int32), np.concatenate(items).view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([i >> 33 for i in ids], pa.int64()),
                                               pa.array(sizes, pa.int32()), lists], names=["row", "part", "n", "items"])

        for batch in batches:
            own = batch.column("row").to_numpy()
            if not len(own):
                continue
            parts = own >> 33
            edges = np.flatnonzero(np.diff(parts, prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if parts[a] != at:
                    table = sketch.read_part(wanted, int(parts[a]))
                    at, rows = parts[a], np.zeros(0, dtype=np.int64) if table is None else table.column("row").to_numpy()
                hit = np.flatnonzero(np.isin(own[a:b], rows)) + a
                if not len(hit):
                    continue
                texts = batch.column("text").take(pa.array(hit))
                for block in text_blocks(texts, hasher):
                    (items,), first = shingle_sets(block, hasher, shingle)
                    for i, (x, y) in enumerate(zip(first[:-1], first[1:], strict=True)):
                        held.append((int(own[hit[block.rows[i]]]), int(y - x), items[x:y]))
                        size += int(y - x)
                    if size >= FLUSH_ITEMS:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()
    return run


def _stored_sets(batch):
    """(row, part, items) of an Arrow batch of SETS."""
    column = batch.column("items")
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
    for row, part, a, b in zip(batch.column("row").to_pylist(), batch.column("part").to_pylist(), offsets[:-1], offsets[1:], strict=True):
        yield row, part, values[a:b]


def _items_by_part(batches):
    for batch in batches:
        for _, part, items in _stored_sets(batch):
            yield part, items


def _posting_task(path: str, bits: int, threshold: int):
    """The rarest shingles of each set, one of which any set linked with it must share; without those that no other set has."""
    def run(batches):
        import pyarrow as pa

        at, estimates = None, None
        for batch in batches:
            out = []
            for row, part, items in _stored_sets(batch):
                if part != at:
                    at, estimates = part, sketch.Estimates(path, part, bits)
                counts = estimates.count(items)
                prefix = len(items) - least_overlap(len(items), threshold) + 1
                once = int((counts == 1).sum())
                if once < prefix:
                    chosen = items[np.lexsort((items, counts))][once:prefix].view(np.int64)
                    out.append((np.full(len(chosen), row), np.full(len(chosen), len(items), dtype=np.int32),
                                np.arange(once, prefix, dtype=np.int32), chosen))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                                 names=["cid", "n", "pos", "item"])
    return run


def bucket_pairs(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of shared buckets (key, row, n, centre) and their distinct pairs with centres (a, b, na, nb, shared, most).

    ``classes`` (row, n, bands) are distinct sets.  ``shared`` counts the buckets in which
    b is a's centre; ``most`` is the size of the largest of them.
    """
    members = classes.select("row", "n", F.explode("bands").alias("key"))
    buckets = save(members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "fastsketch-buckets")
    members = save(members.join(buckets, "key"), "fastsketch-members")
    fullness = members.groupBy("row").agg(F.sum("m").alias("full"))
    centres = (members.join(fullness, "row").groupBy("key")
               .agg(F.max(F.struct("full", (-F.col("row")).alias("row"), "n")).alias("c"))
               .select("key", (-F.col("c.row")).alias("centre"), F.col("c.n").alias("centre_n")))
    members = save(members.join(save(centres, "fastsketch-centres"), "key"), "fastsketch-centred")
    pairs = (members.where("row <> centre").groupBy(F.col("row").alias("a"), F.col("centre").alias("b"))
             .agg(F.first("n").alias("na"), F.first("centre_n").alias("nb"), F.count(F.lit(1)).alias("shared"), F.max("m").alias("most")))
    return members, save(pairs, "fastsketch-pairs")


def possible(pairs: DataFrame, threshold: int) -> DataFrame:
    """Without the pairs whose sizes alone rule a link out."""
    return pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold)


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of the ``pairs`` (a, b, most) that link, by their full sets.

    A centre b of many pairs is copied once for every CENTRE_SHARE members of its largest
    bucket, and its pairs are dealt to the copies.
    """
    share = F.ceil(F.col("most") / CENTRE_SHARE).cast("int")
    left = pairs.withColumn("lane", F.pmod(F.xxhash64("a"), share).cast("int")).join(
        sets.select(F.col("row").alias("a"), F.col("items").alias("sa")), "a")
    right = (pairs.groupBy("b").agg(F.max("most").alias("most"))
             .join(sets.select(F.col("row").alias("b"), F.col("items").alias("sb")), "b")
             .withColumn("lane", F.explode(F.sequence(F.lit(0), share - 1))).drop("most"))
    checked = left.join(right, ["b", "lane"]).select(
        "a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("o"))
    return checked.where(linked(F.col("o"), F.col("na"), F.col("nb"), threshold)).select("a", "b")


def _open_postings(members: DataFrame, placed: DataFrame, sets: DataFrame, threshold: int) -> DataFrame | None:
    """Postings of the rarest shingles of the sets left in buckets whose members other than the centre lie in several classes."""
    others = members.where("row <> centre").join(placed.select(F.col("node").alias("row"), "component"), "row")
    several = (others.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
               .where("lo <> hi").select("key"))
    rows = save(others.join(several, "key", "left_semi").select("row").distinct(), "fastsketch-open")
    if rows.isEmpty():
        return None
    chosen = save(sets.join(rows, "row", "left_semi"), "fastsketch-open-sets")
    n_items = chosen.agg(F.sum("n")).first()[0]
    path, bits = sketch.build(chosen, _items_by_part, n_items, "fastsketch-estimates")
    return save(chosen.mapInArrow(_posting_task(path, bits, threshold), POSTINGS), "fastsketch-postings")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents link when 100 * overlap >= ``threshold`` * union of their shingle
    sets; component_id is the smallest doc_id reachable by links and ``kept``
    says that it is the row's own.  Null and empty texts have empty sets and
    link with nothing.  Rows that share a doc_id are one document of several
    texts: all their links are its own.  Rows with a null doc_id link with
    nothing, have a null component and are kept.  An empty table gives no rows.  Other columns are not read.
    """
    # A row's number holds its part in the upper bits, so later scans find it by part.
    copy = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                            F.monotonically_increasing_id().alias("row")), "fastsketch-copy")
    digests = save(copy.mapInArrow(_digest_task(shingle), DIGESTS), "fastsketch-digests")
    key = ["n", "d1", "d2"]
    valid = digests.where("n > 0 AND doc_id IS NOT NULL")
    # One class for each distinct set: its smallest document, and the row that stands for it.
    classes = save(valid.groupBy(*key).agg(F.min("doc_id").alias("cid"), F.min("row").alias("row"), F.count(F.lit(1)).alias("m"),
                                           F.first("bands").alias("bands")), "fastsketch-classes")
    shared = classes.where("m > 1").select(*key, "cid")
    member = save(digests.select("doc_id", *key).join(shared, key, "left")
                  .select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("cid", "doc_id")).alias("cid")), "fastsketch-member")
    # A document of several texts joins their classes.
    texts = (member.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"))
             .where("lo <> hi").select("doc_id", "lo"))
    own = member.join(texts, "doc_id").where("n > 0").select(F.col("cid").alias("v"), F.col("lo").alias("u"))
    edges = save(own.where("v <> u").distinct(), "fastsketch-own")

    names = classes.select("row", "cid")
    members, pairs = bucket_pairs(classes.select("row", "n", "bands"))
    pairs = save(possible(pairs, threshold), "fastsketch-possible")
    wanted = members.select("row").distinct().withColumn("part", F.shiftright("row", 33))
    sets = save(copy.mapInArrow(_set_task(sketch.write_by_part(wanted, "fastsketch-wanted"), shingle), SETS), "fastsketch-sets")
    best = pairs.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("b"), "most")).alias("x")).select(
        "a", (-F.col("x.b")).alias("b"), F.col("x.most").alias("most"))
    edges = save(edges.unionByName(_as_edges(verified(save(best, "fastsketch-best"), sets, threshold), names)), "fastsketch-edges")
    found = save(components(edges), "fastsketch-found")

    # What the first checks leave: pairs of different classes.
    placed = save(names.join(found, names.cid == found.node, "left")
                  .select(F.col("row").alias("node"), F.coalesce("component", "cid").alias("component")), "fastsketch-placed")
    side = {x: placed.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"}
    rest = pairs.select("a", "b", "most").join(side["a"], "a").join(side["b"], "b").where("ca <> cb").select("a", "b", "most")
    postings = _open_postings(members, placed, sets, threshold)
    if postings is not None:
        more = remaining_pairs(postings, placed, threshold)
        rest = rest.unionByName(more.withColumn("most", F.lit(1).cast("long")))
    rest = save(rest.groupBy("a", "b").agg(F.max("most").alias("most")), "fastsketch-rest")
    if not rest.isEmpty():
        found = components(edges.unionByName(_as_edges(verified(rest, sets, threshold), names)))
    return (member.join(found, member.cid == found.node, "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "cid").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _as_edges(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links between rows as edges between the smallest documents of their classes."""
    return (links.join(names.select(F.col("row").alias("a"), F.col("cid").alias("v")), "a")
            .join(names.select(F.col("row").alias("b"), F.col("cid").alias("u")), "b").where("v <> u").select("v", "u"))


@cache
def oracle_sql(threshold: int = THRESHOLD, shingle: int = SHINGLE) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{WORD_PATTERN}') AS ws
  FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {shingle - 1}], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {shingle - 2}, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= {threshold} * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, c) AS (SELECT a, a FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.c)
SELECT w.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, coalesce(min(reach.c), w.doc_id) AS component_id,
  coalesce(min(reach.c), w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY w.doc_id"""
