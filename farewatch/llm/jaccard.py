"""N-gram Jaccard self-join by set-relation skipping; classes of linked documents.

A document's set is its distinct 5-word shingles (128-bit sums of their hashes
identify a set; equal sets become one class before anything is joined).  Two
relations between sets then save work:

*Index level.*  Shingles are ordered rare first by the counts of the
distributed sketch, so most prefixes hold only shingles that occur once and
are never indexed.  The index lists of the rest are first reduced to stars
(each set with the list's smallest set); lists whose sets already lie in one
class are skipped, and the others are walked in blocks whose size and position
bounds rule out whole blocks.  Long lists are cut into a grid of fixed cells.

*Answer level.*  Each set of a star knows its overlap with the star's centre.
For a remaining candidate pair the overlap of the two centres is computed
once, and bounds the pair's own overlap from both sides: the pair's answer
follows from the centres' answer and the sets' differences.  Only pairs that
the bounds leave open are intersected.

Links inside a class that is already connected are not enumerated.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from farewatch.llm import sketch
from farewatch.llm.common import WORD_PATTERN, save
from farewatch.llm.graph import components
from farewatch.llm.texthash import Hasher

SHINGLE = 5
# Similarity threshold as a percentage.
THRESHOLD = 75
# Lists longer than this are cut into grid cells; rows of one join task; rows of one block.
LIST_CELL = 4096
TASK_ROWS = 100_000
BLOCK = 64
DIGESTS = "row long, doc_id long, part long, n long, d1 long, d2 long"
SETS = "cid long, n int, first int, prefix int, items array<long>"
PAIRS = "a long, b long"


def document_sets(block, hasher: Hasher, shingle: int):
    """(text number, distinct shingle hashes per seed) for every text of a block.

    Fewer words than a shingle make one shingle of the whole sequence.
    """
    wide = hasher.windows(block.hashes, shingle)
    for i in range(len(block.rows)):
        a, b = int(block.first[i]), int(block.first[i + 1])
        if b - a >= shingle:
            first, at = np.unique(wide[0][a:b - shingle + 1], return_index=True)
            yield i, [first, *(w[a:b - shingle + 1][at] for w in wide[1:])]
        elif b > a:
            yield i, hasher.windows([h[a:b] for h in block.hashes], b - a)
        else:
            yield i, [np.zeros(0, dtype=np.uint64) for _ in wide]


def _row_blocks(batch, hasher: Hasher):
    """(part, places of its texts in the batch, block of texts) of an Arrow batch (row, doc_id, text, part)."""
    import pyarrow as pa

    places = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text"), batch.column("part")],
                                        names=["doc_id", "text", "part"])
    return sketch.part_blocks(places, hasher)


def _digest_task(shingle: int):
    def run(batches):
        import pyarrow as pa

        hasher = Hasher(2, fold_case=True)
        for batch in batches:
            for _, places, block in _row_blocks(batch, hasher):
                n, d1, d2 = [], [], []
                for _, (s1, s2) in document_sets(block, hasher, shingle):
                    n.append(len(s1))
                    d1.append(s1.sum(dtype=np.uint64))
                    d2.append(s2.sum(dtype=np.uint64))
                at = pa.array(places)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(at) for c in ("row", "doc_id", "part")), pa.array(np.array(n, dtype=np.int64)),
                     pa.array(np.array(d1, dtype=np.uint64).view(np.int64)), pa.array(np.array(d2, dtype=np.uint64).view(np.int64))],
                    names=["row", "doc_id", "part", "n", "d1", "d2"])
    return run


def _representatives(batches, hasher: Hasher, firsts: str, shingle: int):
    """(part, class, set) of the rows that stand for their class."""
    at, known = None, None
    for batch in batches:
        rows = batch.column("row").to_numpy()
        for part, places, block in _row_blocks(batch, hasher):
            if part != at:
                table = sketch.read_part(firsts, part)
                at, known = part, {} if table is None else dict(zip(table.column("row").to_pylist(), table.column("class").to_pylist(), strict=True))
            for i, (items, *_) in document_sets(block, hasher, shingle):
                name = known.get(int(rows[places[i]]))
                if len(items) and name is not None:
                    yield part, name, items


def _sketch_keys(firsts: str, shingle: int):
    def keys_of(batches):
        for part, _, items in _representatives(batches, Hasher(1, fold_case=True), firsts, shingle):
            yield part, items
    return keys_of


def least_overlap(n: int, threshold: int) -> int:
    """Smallest overlap that a set of ``n`` can have with a set it links to."""
    return -(-threshold * n // 100)


def _set_task(firsts: str, path: str, bits: int, shingle: int, threshold: int):
    """Sets that share a prefix shingle with another, in rare-first order."""
    def run(batches):
        at, estimates, held, size = None, None, [], 0
        for part, doc, items in _representatives(batches, Hasher(1, fold_case=True), firsts, shingle):
            if part != at:
                at, estimates = part, sketch.Estimates(path, part, bits)
            counts = estimates.count(items)
            n = len(items)
            once, prefix = int((counts == 1).sum()), n - least_overlap(n, threshold) + 1
            if once >= prefix:
                continue
            order = np.lexsort((items, counts))
            held.append((doc, n, once, prefix, items[order].view(np.int64)))
            size += n
            if size >= 200_000:
                yield _set_batch(held)
                held, size = [], 0
        if held:
            yield _set_batch(held)
    return run


def _set_batch(held):
    import pyarrow as pa

    ids, sizes, first, prefix, items = zip(*held, strict=True)
    lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, items)]).astype(np.int32), np.concatenate(items))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.int32()) for x in (sizes, first, prefix)), lists],
                                      names=["cid", "n", "first", "prefix", "items"])


def needed(na: Column, nb: Column, threshold: int) -> Column:
    """Overlap from which two sets of these sizes link."""
    return F.ceil((na + nb) * F.lit(threshold) / F.lit(100 + threshold))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, o): exact overlap of each pair."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("items").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("items").alias("sb"))
    return (pairs.join(left, "a").join(right, "b")
            .select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("o")))


def linked(o: Column, na: Column, nb: Column, threshold: int) -> Column:
    return o * 100 >= (na + nb - o) * threshold


def list_pairs(remaining: np.ndarray, sizes: np.ndarray, ids: np.ndarray, groups: np.ndarray, sides: np.ndarray, threshold: int):
    """Index pairs (i, j) of one list that may link and are not yet in one class.

    ``remaining`` is the number of items from the shared shingle on.  The list is
    walked in blocks by size; a block is skipped when its sizes are out of reach
    or the items left in it cannot make up the overlap.  ``sides`` (0: both, 1:
    left, 2: right) keeps a grid cell from pairing rows of one side.
    """
    order = np.argsort(sizes, kind="stable")
    size, rest = sizes[order], remaining[order]
    starts = np.arange(0, len(order), BLOCK)
    block_max = np.maximum.reduceat(rest, starts)
    out = []
    for i in range(len(order) - 1):
        limit = size[i] * 100 // threshold
        end = int(np.searchsorted(size, limit, side="right"))
        # A partner is at least as large, so this overlap is needed at the least.
        least = -(-threshold * 2 * size[i] // (100 + threshold))
        if rest[i] < least:
            continue
        for s in range((i + 1) // BLOCK, -(-end // BLOCK)):
            if block_max[s] < least:
                continue
            j = np.arange(max(i + 1, s * BLOCK), min(end, (s + 1) * BLOCK))
            reach = np.minimum(rest[i], rest[j]) * (100 + threshold) >= (size[i] + size[j]) * threshold
            x, y = order[i], order[j]
            reach &= (groups[x] != groups[y]) & (ids[x] != ids[y]) & ((sides[x] == 0) | (sides[x] != sides[y]))
            out.extend((x, k) for k in y[reach])
    return out


def _list_task(threshold: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = set()
        for _, rows in group.groupby(["item", "ci", "cj"], sort=False):
            ids = rows["cid"].to_numpy()
            for i, j in list_pairs(rows["rest"].to_numpy().astype(np.int64), rows["n"].to_numpy().astype(np.int64), ids,
                                   rows["component"].to_numpy(), rows["side"].to_numpy(), threshold):
                found.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pd.DataFrame(sorted(found), columns=["a", "b"]).astype("int64")
    return run


def remaining_pairs(postings: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Candidate pairs of different classes from the lists that hold more than one class."""
    tagged = save(postings.join(classes, postings.cid == classes.node, "left")
                  .select("item", "cid", "n", (F.col("n") - F.col("pos")).alias("rest"),
                          F.coalesce("component", "cid").alias("component")), "jaccard-tagged")
    open_lists = (tagged.groupBy("item").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                             F.count(F.lit(1)).alias("m"))
                  .where("lo <> hi").select("item", F.ceil(F.col("m") / LIST_CELL).cast("int").alias("cells")))
    rows = tagged.join(open_lists, "item").withColumn("c", F.pmod(F.xxhash64("cid"), F.col("cells")).cast("int"))
    # A list of c cells is dealt to the cell pairs (i, j), i <= j; short lists have one.
    rows = (rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
            .withColumn("ci", F.least("c", "o")).withColumn("cj", F.greatest("c", "o"))
            .withColumn("side", F.when(F.col("ci") == F.col("cj"), 0).when(F.col("c") == F.col("ci"), 1).otherwise(2)))
    rows = save(rows.select("item", "ci", "cj", "side", "cid", "n", "rest", "component"), "jaccard-lists")
    tasks = max(1, rows.count() // TASK_ROWS * 4)
    return (rows.withColumn("t", F.pmod(F.xxhash64("item", "ci", "cj"), F.lit(tasks)))
            .groupBy("t").applyInPandas(_list_task(threshold), PAIRS).distinct())


def link_sets(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Edges (v, u) that connect the sets (SETS) which link, directly or through others."""
    postings = save(sets.select("cid", "n", "first", F.posexplode(F.slice("items", F.col("first") + 1, F.col("prefix") - F.col("first"))))
                    .select("cid", "n", (F.col("first") + F.col("pos")).alias("pos"), F.col("col").alias("item")), "jaccard-postings")
    # Stars: each set with the smallest set of about its size in the list.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / threshold))).cast("int")
    banded = postings.withColumn("band", band)
    centres = (banded.groupBy("item", "band").agg(F.min("cid").alias("b"), F.max("cid").alias("most")).where("b <> most")
               .select("item", "band", "b"))
    stars = banded.join(centres, ["item", "band"]).where("cid <> b").select(F.col("cid").alias("a"), "b").distinct()
    star = save(overlaps(stars, sets), "jaccard-stars")
    links = star.where(linked(F.col("o"), F.col("na"), F.col("nb"), threshold)).select(F.col("a").alias("v"), F.col("b").alias("u"))
    links = save(links, "jaccard-links")
    classes = components(links)
    # Answers of the centres: a set's centre is the one it overlaps most.
    near = (star.where(linked(F.col("o"), F.col("na"), F.col("nb"), threshold)).groupBy("a")
            .agg(F.max(F.struct(F.col("o") - F.greatest("na", "nb"), (-F.col("b")).alias("b"), "o", "nb")).alias("best"))
            .select("a", (-F.col("best.b")).alias("centre"), F.col("best.o").alias("oc"), F.col("best.nb").alias("nc")))
    pairs = save(remaining_pairs(postings, classes, threshold), "jaccard-pairs")
    if pairs.isEmpty():
        return links
    known = sets.select("cid", "n").join(near.withColumnRenamed("a", "cid"), "cid", "left").select(
        "cid", "n", F.coalesce("centre", "cid").alias("centre"), F.coalesce("oc", "n").alias("oc"), F.coalesce("nc", "n").alias("nc"))

    def side(x: str) -> DataFrame:
        return known.select(*(F.col(c).alias(name) for c, name in (
            ("cid", x), ("n", f"n{x}"), ("centre", f"c{x}"), ("oc", f"o{x}"), ("nc", f"nc{x}"))))

    wide = save(pairs.join(side("a"), "a").join(side("b"), "b"), "jaccard-wide")
    centre_pairs = wide.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    answers = save(overlaps(centre_pairs, sets).select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("o").alias("oc")),
                   "jaccard-answers")
    # Overlap of a pair from its centres' overlap: what the sets and their centres do not share moves it at most.
    derived = (wide.join(answers, ["ca", "cb"], "left").withColumn("oc", F.coalesce("oc", "nca"))
               .withColumn("most", F.col("oc") + F.col("na") - F.col("oa") + F.col("nb") - F.col("ob"))
               .withColumn("least", F.col("oc") - (F.col("nca") - F.col("oa")) - (F.col("ncb") - F.col("ob"))))
    derived = derived.withColumn("need", needed(F.col("na"), F.col("nb"), threshold))
    derived = save(derived.where("most >= need").select("a", "b", (F.col("least") >= F.col("need")).alias("sure")), "jaccard-derived")
    checked = (overlaps(derived.where("NOT sure").select("a", "b"), sets)
               .where(linked(F.col("o"), F.col("na"), F.col("nb"), threshold)))
    more = derived.where("sure").select("a", "b").unionByName(checked.select("a", "b"))
    return links.unionByName(more.select(F.col("a").alias("v"), F.col("b").alias("u")))


def jaccard_classes(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Documents link when 100 * overlap >= ``threshold`` * union of their shingle
    sets; component_id is the smallest doc_id reachable by links.  Empty and
    null texts have empty sets, link with nothing and are their own component.
    Rows that share a doc_id are one document of several texts: all their links
    are its own, wherever the rows lie.  Rows with a
    null doc_id link with nothing and have a null component.  An empty table gives no rows.  Other columns are not read.
    """
    copy = save(sketch.keyed(docs, F.spark_partition_id().cast("long")).withColumn("row", F.monotonically_increasing_id()), "jaccard-copy")
    member, links = _linked_classes(copy, threshold, shingle)
    # The classes of a document's several texts are connected, too.
    of_doc = member.where("class IS NOT NULL").groupBy("doc_id").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
    several = of_doc.where("lo <> hi").select("doc_id", "lo")
    own = member.join(several, "doc_id").where("class <> lo").select(F.col("class").alias("v"), F.col("lo").alias("u")).distinct()
    named = _named(member, components(links.unionByName(own)))
    return member.join(named, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("name", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, of which one stands for each class of linked texts: the smallest doc_id, then the first row.

    Classes are of rows: several texts under one doc_id do not connect theirs, so
    no text goes without a kept row that links with it, directly or through
    others.  Rows without a doc_id and texts without words are kept.  Columns of
    any name are kept as they are.  The texts are not shuffled: each part's
    dropped rows are looked up where they are.
    """
    part, row = _free_names(docs.columns, "part", "row")
    copy = save(docs.withColumn(part, F.spark_partition_id().cast("long")).withColumn(row, F.monotonically_increasing_id()), "jaccard-copy")
    keyed = copy.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col(f"`{part}`").alias("part"), F.col(f"`{row}`").alias("row"))
    member, links = _linked_classes(keyed, threshold, shingle)
    # The kept row of a group: of its smallest doc_id the first.
    grouped = member.where("class IS NOT NULL").join(components(links), F.col("class") == F.col("node"), "left").select(
        "row", "part", "doc_id", F.coalesce("component", "class").alias("group"))
    grouped = save(grouped, "jaccard-grouped")
    least = save(grouped.groupBy("group").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1"), "jaccard-least")
    repeated = save(grouped.join(least, "group"), "jaccard-repeated")
    kept = repeated.where("doc_id = least").groupBy("group").agg(F.min("row").alias("row")).select("row")
    dropped = sketch.write_by_part(repeated.join(kept, "row", "left_anti").select("part", "row"), "jaccard-dropped")

    def run(batches):
        import pyarrow as pa

        at, gone = None, None
        for batch in batches:
            stays = []
            for p, r in zip(batch.column(part).to_pylist(), batch.column(row).to_pylist(), strict=True):
                if p != at:
                    table = sketch.read_part(dropped, p)
                    at, gone = p, set() if table is None else set(table.column("row").to_pylist())
                stays.append(r not in gone)
            yield batch.filter(pa.array(stays, pa.bool_()))

    return copy.mapInArrow(run, copy.schema).drop(part, row)


def _free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, with underscores in front until no column has them."""
    known, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name in known:
            name = f"_{name}"
        out.append(name)
    return out


def _named(member: DataFrame, found: DataFrame) -> DataFrame:
    """(class, name): the smallest doc_id of every class's component."""
    classes = member.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    placed = save(classes.join(found, F.col("class") == F.col("node"), "left").select(
        "class", "doc_id", F.coalesce("component", "class").alias("component")), "jaccard-placed")
    names = placed.groupBy("component").agg(F.min("doc_id").alias("name"))
    return save(placed.join(names, "component").select("class", "name"), "jaccard-named")


def _linked_classes(copy: DataFrame, threshold: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, part, n, class) of a copy (doc_id, text, part, row), and edges (v, u) of classes.

    A class is the rows of one set, named by its smallest doc_id; of several classes
    with that doc_id all but one get numbers that no doc_id has.  Rows without a set
    or a doc_id have none.
    """
    digests = save(copy.mapInArrow(_digest_task(shingle), DIGESTS), "jaccard-digests")
    key = ["n", "d1", "d2"]
    valid = digests.where("n > 0 AND doc_id IS NOT NULL")
    equal = save(valid.groupBy(*key).agg(F.min("doc_id").alias("least"), F.min("row").alias("first"), F.count(F.lit(1)).alias("m")), "jaccard-equal")
    same = equal.groupBy("least").agg(F.count(F.lit(1)).alias("k"), F.min("first").alias("one")).where("k > 1").select("least", "one")
    ends = valid.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    free = F.monotonically_increasing_id() + F.lit(1)
    number = F.lit(ends["hi"] or 0) + free if (ends["hi"] or 0) < 2**62 else F.lit(ends["lo"]) - free
    further = save(equal.join(same, "least").where("first <> one").select(*key, number.alias("number")), "jaccard-further")
    # Only classes of several rows, or of several texts of a document, are joined back, from a
    # table of their own: two plain exchanges let Spark split the rows of one large class.
    shared = save(equal.join(further, key, "left").where("m > 1 OR number IS NOT NULL")
                  .select(*key, "first", F.coalesce("number", "least").alias("name")), "jaccard-shared")
    stands = F.coalesce("first", "row") == F.col("row")
    member = digests.join(shared, key, "left").withColumn("named", F.col("doc_id").isNotNull() & (F.col("n") > 0)).select(
        "row", "doc_id", "part", "n", F.when(F.col("named"), F.coalesce("name", "doc_id")).alias("class"), (F.col("named") & stands).alias("stands"))
    member = save(member, "jaccard-members")
    firsts = sketch.write_by_part(member.where("stands").select("part", "row", "class"), "jaccard-firsts")
    n_items = member.where("stands").agg(F.sum("n")).first()[0] or 0
    path, bits = sketch.build(copy, _sketch_keys(firsts, shingle), n_items, "jaccard-estimates")
    sets = save(copy.mapInArrow(_set_task(firsts, path, bits, shingle, threshold), SETS), "jaccard-sets")
    return member, link_sets(sets, threshold)


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
SELECT w.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, coalesce(min(reach.c), w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY w.doc_id"""
