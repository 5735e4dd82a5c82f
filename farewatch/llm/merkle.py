"""Merkle manifest of a dataset: roots per source, one root, and a proof for every row.

A leaf is the hash of a row's length-prefixed fields.  Per source the leaves
ascend by doc_id; every FANOUT consecutive nodes become their hash until one
node, the source's subroot, remains.  The subroots, ordered by source, become
the root likewise.

Rows are numbered within their source (one range exchange of the leaves) and
dealt to aligned partitions of ``PART_LEAVES`` leaves, each hashed to its own
root in one task.  Then a butterfly exchange runs over the partitions: in
round r, groups of FANOUT partitions that differ only in digit r of their
number swap the roots of their subtrees; each of them hashes the next ancestor
itself, so after log(partitions) rounds each knows the siblings of all its
ancestors and nothing is passed down the tree.  A group never has more than
FANOUT members, whatever a source's size.  In a last, incomplete subtree its
partitions also answer for the absent ones, in turn.  Sources differ in their
number of partitions, so above the subroots each source takes part in one
further butterfly as a single member, and its partitions get those upper
siblings by a join in lanes of ``LANE_PARTS`` partitions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, Window, functions as F

from farewatch.llm.common import CRC32_TABLE_SQL, crc32_sql, save

FANOUT = 16
# Levels of the tree inside one partition, and the partition's leaves.
PART_LEVELS = 2
PART_LEAVES = FANOUT**PART_LEVELS
# Partitions of one source that share a copy of the siblings above its subroot.
LANE_PARTS = 1024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_DIVISOR = 5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PARTS = "tree string, slot long, slots long, ids array<long>, leaves binary, given binary, inner binary, node string"
PROOFS = "doc_id long, leaf string, subroot string, root string, left array<string>, right array<string>"
CHECKS = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")
DIGEST_BYTES = 32


def digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Hash of the FIELDS: ``-`` for null, else byte count, ``:``, value."""
    parts = []
    for name in FIELDS:
        value = fields[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def source_key(source: Column) -> Column:
    """A source as a string that is never null: nulls first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` (tree, ...) with ``pos``, the place in their tree by ``order``, and ``total``, the tree's rows.

    One range exchange; only the first places of each (range slice, tree) are added up.
    """
    placed = save(rows.repartitionByRange(F.col("tree"), *order).sortWithinPartitions(F.col("tree"), *order)
                  .withColumn("at", F.monotonically_increasing_id()).withColumn("slice", F.shiftright("at", 33)), "merkle-placed")
    tree = Window.partitionBy("tree")
    starts = (placed.groupBy("slice", "tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
              .withColumn("total", F.sum("n").over(tree))
              .withColumn("before", F.coalesce(F.sum("n").over(
                  tree.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    starts = save(starts.select("slice", "tree", "total", (F.col("before") - F.col("first")).alias("shift")), "merkle-starts")
    return placed.join(starts, ["slice", "tree"]).withColumn("pos", F.col("at") + F.col("shift")).drop("slice", "at", "shift")


def levels_of(leaves: list[str], tree_leaves: int) -> list[list[str]]:
    """Node digests of one partition, level by level up to its root; a small tree ends at its own root."""
    levels, nodes = [leaves], tree_leaves
    for _ in range(PART_LEVELS):
        if nodes == 1:
            break
        below = levels[-1]
        levels.append([digest("".join(below[i:i + FANOUT])) for i in range(0, len(below), FANOUT)])
        nodes = -(-nodes // FANOUT)
    return levels


def _build_part(key, table):
    import pyarrow as pa

    table = table.sort_by("pos")
    total = table.column("total")[0].as_py()
    leaves = table.column("leaf").to_pylist()
    levels = levels_of([x.hex() for x in leaves], total)
    row = {"tree": key[0].as_py(), "slot": key[1].as_py(), "slots": -(-total // PART_LEAVES), "ids": table.column("doc_id").to_pylist(),
           "leaves": b"".join(leaves), "given": b"".join(table.column("given").to_pylist()),
           "inner": bytes.fromhex("".join(levels[1])) if len(levels) > 2 else b"", "node": levels[-1][0]}
    types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.string())
    return pa.table({name: pa.array([value], t) for (name, value), t in zip(row.items(), types, strict=True)})


def swap_roots(nodes: DataFrame, span: int) -> DataFrame:
    """One round of the butterfly: (tree, slot, slots, node, left, right).

    ``nodes`` (tree, slot, slots, node) hold the roots of subtrees of ``span`` slots.
    Members of a group have the same place within their subtree.  The slots of an
    incomplete last subtree answer for its absent places, too.
    """
    wide = span * FANOUT
    subtree = F.expr(f"slot div {span}")
    have = F.least(F.lit(span), F.col("slots") - subtree * span)
    offset = F.col("slot") % span
    # A subtree without an elder sibling has nobody to answer.
    last = F.when(subtree % FANOUT > 0, F.lit(span - 1)).otherwise(offset)
    sent = nodes.select(
        "tree", "slots", "node", F.col("slot").alias("own"), (subtree % FANOUT).alias("digit"),
        F.expr(f"slot div {wide}").alias("group"), offset.alias("offset"),
        F.explode(F.sequence(offset, last, have)).alias("place"))
    member = F.struct("digit", "node", F.when(F.col("place") == F.col("offset"), F.col("own")).alias("slot"), "slots")
    groups = sent.groupBy("tree", "group", "place").agg(F.sort_array(F.collect_list(member)).alias("members"))
    met = groups.select("tree", "members", F.explode("members").alias("m")).where("m.slot IS NOT NULL")

    def siblings(side: str) -> Column:
        return F.expr(f"array_join(transform(filter(members, x -> x.digit {side} m.digit), x -> x.node), '')")

    met = met.select("tree", F.col("m.slot").alias("slot"), F.col("m.slots").alias("slots"), F.col("m.node").alias("own"),
                     siblings("<").alias("left"), siblings(">").alias("right"))
    return met.withColumn("node", F.sha2(F.concat("left", "own", "right").cast("binary"), 256)).drop("own")


def butterfly(nodes: DataFrame) -> DataFrame:
    """(tree, slot, slots, root, levels): every slot's root and the siblings (left, right) of its ancestors.

    ``nodes`` (tree, slot, slots, node): slots 0 to slots - 1 of each tree.
    """
    nodes = save(nodes, "merkle-nodes")
    most = nodes.agg(F.max("slots")).first()[0] or 0
    roots, rounds = nodes.where("slots = 1").select("tree", "slot", "slots", F.col("node").alias("root")), None
    span, number = 1, 0
    while span < most:
        met = save(swap_roots(nodes.where(F.col("slots") > span), span), "merkle-round")
        level = met.select("tree", "slot", F.struct(F.lit(number).alias("round"), "left", "right").alias("level"))
        rounds = level if rounds is None else rounds.unionByName(level)
        span, number = span * FANOUT, number + 1
        roots = roots.unionByName(met.where(F.col("slots") <= span).select("tree", "slot", "slots", F.col("node").alias("root")))
        nodes = met.drop("left", "right")
    if rounds is None:
        rounds = nodes.limit(0).select("tree", "slot", F.struct(
            F.lit(0).alias("round"), F.lit("").alias("left"), F.lit("").alias("right")).alias("level"))
    levels = rounds.groupBy("tree", "slot").agg(F.sort_array(F.collect_list("level")).alias("levels"))
    none = F.lit(None).cast(levels.schema["levels"].dataType)
    return roots.join(levels, ["tree", "slot"], "left").withColumn(
        "levels", F.coalesce("levels", F.filter(F.array(none[0]), lambda x: x.isNotNull())))


def part_levels(row: dict) -> list[list[str]]:
    """The digests that a stored partition holds, by level, without its root."""
    def split(data: bytes) -> list[str]:
        text = data.hex()
        return [text[i:i + 2 * DIGEST_BYTES] for i in range(0, len(text), 2 * DIGEST_BYTES)]

    leaves = split(row["leaves"])
    if len(leaves) == 1 and row["node"] == leaves[0]:
        return []
    return [leaves, split(row["inner"])] if row["inner"] else [leaves]


def paths(row: dict):
    """(number, leaf, lefts, rights) for every leaf of a partition joined with its upper siblings."""
    inside = part_levels(row)
    upper = [(x["left"], x["right"]) for x in (*row["levels"], *row["top"])]
    leaves = inside[0] if inside else [row["node"]]
    for i, leaf in enumerate(leaves):
        steps, at = [], i
        for nodes in inside:
            run = at // FANOUT * FANOUT
            steps.append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + FANOUT])))
            at //= FANOUT
        yield i, leaf, steps + upper


def fold(leaf: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in steps:
        leaf = digest(left + leaf + right)
    return leaf


@dataclass(frozen=True)
class Manifest:
    """Stored partitions with their leaves, subroots, the root and upper siblings."""

    parts: DataFrame

    def _rows(self, schema: str, make) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for row in batch.to_pylist():
                    columns = list(zip(*make(row), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types(pa), strict=True)], names=names)

        names = [f.split()[0] for f in schema.split(", ")]
        arrow = {"long": "int64", "string": "string", "boolean": "bool_"}

        def types(pa):
            return [pa.list_(pa.string()) if t == "array<string>" else getattr(pa, arrow[t])()
                    for t in (f.split()[1] for f in schema.split(", "))]

        return self.parts.mapInArrow(run, schema)

    def proofs(self) -> DataFrame:
        """One row per leaf: doc_id, leaf, subroot, root, and the siblings left and right of its path, level by level."""
        def make(row):
            for i, leaf, steps in paths(row):
                yield row["ids"][i], leaf, row["subroot"], row["root"], [s[0] for s in steps], [s[1] for s in steps]

        return self._rows(PROOFS, make)

    def checks(self) -> DataFrame:
        """One row per leaf: its proof's digest, and the root that the given leaf and its siblings lead to."""
        def make(row):
            for i, leaf, steps in paths(row):
                given = row["given"][i * DIGEST_BYTES:(i + 1) * DIGEST_BYTES].hex()
                folded = fold(given, steps)
                yield (row["ids"][i], leaf, row["subroot"], row["root"], digest("".join(a + b for a, b in steps)), folded,
                       folded == row["root"])

        return self._rows(CHECKS, make)


def build_manifest(docs: DataFrame, given: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs`` (FIELDS); ``given`` replaces fields in the leaf that ``checks`` verifies.

    Nulls are fields of their own; null doc_ids come first and a null source has
    its own subroot, before all others.  Rows that share source and doc_id
    ascend by leaf; repeated rows are a leaf each.  A lone leaf is its source's subroot.
    An empty table has no rows and no root.  Other columns are not read.
    """
    own = {name: F.col(name) for name in FIELDS}
    leaves = save(docs.select(
        source_key(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf_digest(own)).alias("leaf"),
        F.unhex(leaf_digest(own | (given or {}))).alias("given"), F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    # The row number only spreads a frequently repeated row over range slices.
    ordered = numbered(leaves, [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc(), F.col("row").asc()])
    parts = save(ordered.withColumn("slot", F.expr(f"pos div {PART_LEAVES}")).drop("row")
                 .groupBy("tree", "slot").applyInArrow(_build_part, PARTS), "merkle-parts")
    inside = save(butterfly(parts.select("tree", "slot", "slots", "node"))
                  .withColumnRenamed("root", "subroot"), "merkle-inside")
    sources = inside.where("slot = 0").select(F.lit("").alias("tree"), F.col("tree").alias("source"), "slots", "subroot")
    ranked = save(numbered(sources, [F.col("source").asc()]), "merkle-sources")
    top = butterfly(ranked.select("tree", F.col("pos").alias("slot"), F.col("total").alias("slots"), F.col("subroot").alias("node")))
    lanes = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {LANE_PARTS}")))
    above = (ranked.select("source", "slots", "pos")
             .join(top.select(F.col("slot").alias("pos"), "root", F.col("levels").alias("top")), "pos")
             .select(F.col("source").alias("tree"), "root", "top", lanes.alias("lane")))
    upper = (inside.drop("slots").withColumn("lane", F.expr(f"slot div {LANE_PARTS}")).join(above, ["tree", "lane"]).drop("lane"))
    return Manifest(save(parts.join(save(upper, "merkle-upper"), ["tree", "slot"]), "merkle-manifest"))


def tampered(text: Column, doc_id: Column) -> Column:
    """The text with A-Z lower-cased where TAMPER_DIVISOR divides the crc32 of the decimal doc_id."""
    chosen = F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % TAMPER_DIVISOR == 0
    return F.when(chosen, F.translate(text, UPPER, UPPER.lower())).otherwise(text)


def verify_tampered(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: CHECKS, with the stated rows tampered after the manifest was made."""
    return build_manifest(docs, {"text": tampered(F.col("text"), F.col("doc_id"))}).checks()


def _levels_sql(name: str, first: str, tree: str, levels: int) -> str:
    """CTEs name_1 to name_<levels> of nodes and name_path_1 ... of the siblings one level below."""
    out, below = [], first
    for k in range(1, levels + 1):
        run = f"PARTITION BY {tree}, pos // {FANOUT} ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}_path_{k} AS (SELECT {tree}, pos, n,
  CASE WHEN n > 1 THEN coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
  CASE WHEN n > 1 THEN coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {below}),
{name}_{k} AS (SELECT {tree}, pos // {FANOUT} AS pos, (n + {FANOUT - 1}) // {FANOUT} AS n,
  CASE WHEN n > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE min(node) END AS node FROM {below} GROUP BY {tree}, pos // {FANOUT}, n),""")
        below = f"{name}_{k}"
    return "\n".join(out)


def _walk_sql(name: str, first: str, place: str, tree: str, levels: int) -> str:
    """CTEs that append the siblings of each level to the proof and fold the given leaf."""
    out, below = [], first
    for k in range(1, levels + 1):
        step = f"{name}_walk_{k}"
        out.append(f"""{step} AS (SELECT w.* EXCLUDE (proof, folded), proof || l || r AS proof,
  CASE WHEN p.n > 1 THEN sha256(l || folded || r) ELSE folded END AS folded
  FROM {below} w JOIN {name}_path_{k} p ON p.{tree} = w.{tree} AND p.pos = w.{place} // {FANOUT ** (k - 1)}),""")
        below = step
    return "\n".join(out)


@cache
def oracle_sql(levels: int = 6, top_levels: int = 4) -> str:
    """SQL for up to FANOUT ** levels rows a source and FANOUT ** top_levels sources."""
    def leaf(text: str) -> str:
        values = [text if f == "text" else f"CAST({f} AS VARCHAR)" for f in FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    lower = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    return f"""
WITH {CRC32_TABLE_SQL}, leaves AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf('text')} AS leaf,
  CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % {TAMPER_DIVISOR} = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS given FROM documents, crc),
rows_0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY tree) AS n, leaf AS node FROM leaves),
{_levels_sql('s', 'rows_0', 'tree', levels)}
tops AS (SELECT tree AS source, node AS subroot, node, '' AS all_, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos,
  count(*) OVER () AS n FROM s_{levels}),
{_levels_sql('t', 'tops', 'all_', top_levels)}
start AS (SELECT r.doc_id, r.leaf, r.tree, r.pos AS at, t.subroot, t.pos AS rank, t.all_, (SELECT node FROM t_{top_levels}) AS root,
  '' AS proof, r.given AS folded FROM rows_0 r JOIN tops t ON t.source = r.tree),
{_walk_sql('s', 'start', 'at', 'tree', levels)}
{_walk_sql('t', f's_walk_{levels}', 'rank', 'all_', top_levels).rstrip(',')}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM t_walk_{top_levels}"""
