"""Sharding by histogram sort: splitters refined from exact byte counts, one exchange.

Rows are ordered by a 124-bit key: a hash of the text, then a hash of the
document id.  The driver holds, for every splitter still open, one candidate
key interval.  A round cuts each open interval into equal sub-intervals, counts
the exact bytes in each over all partitions (one partial aggregation, at most
``n_shards * FANOUT`` rows come back) and narrows the interval to the
sub-interval that contains the splitter's byte target.  A splitter is settled
when a probe boundary lies within the tolerance of its target.  Equal texts
are neighbours in the key order, so a group of copies is cut only where it is
too large for the tolerance.

Everything is DataFrame expressions; nothing leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from farewatch.llm.common import save, shared_folder

KEY_BITS = 62
FANOUT = 64
# Byte error allowed at each splitter, as a share of one shard's bytes.
TOLERANCE = 0.005
# Rows of one numbering task, and slices a group of equal texts is cut into for numbering.
ROWS_PER_SLICE = 20_000
GROUP_SLICE_BITS = 8


@dataclass(frozen=True)
class Interval:
    """Keys in [lo, hi): of the text hash, or of the id hash under one text hash."""

    lo: int
    hi: int
    text_hash: int | None = None

    @property
    def step(self) -> int:
        return -(-(self.hi - self.lo) // FANOUT)

    def condition(self) -> str:
        if self.text_hash is None:
            return f"__h >= {self.lo}L AND __h < {self.hi}L"
        return f"__h = {self.text_hash}L AND __g >= {self.lo}L AND __g < {self.hi}L"

    def cell(self) -> str:
        column = "__h" if self.text_hash is None else "__g"
        return f"cast(({column} - {self.lo}L) div {self.step}L as int)"


@dataclass(frozen=True)
class Splitter:
    """First key of a shard: rows with a smaller (text hash, id hash) belong to earlier shards."""

    text_hash: int
    id_hash: int = 0

    def above(self) -> str:
        if not self.id_hash:
            return f"__h >= {self.text_hash}L"
        return f"(__h > {self.text_hash}L OR (__h = {self.text_hash}L AND __g >= {self.id_hash}L))"


def add_keys(df: DataFrame, text: Column, doc_id: Column) -> DataFrame:
    """Add the sort key (__h: text hash, __g: id hash), both non-negative longs."""
    shift = 64 - KEY_BITS
    return (df.withColumn("__h", F.shiftrightunsigned(F.xxhash64(text), shift))
            .withColumn("__g", F.shiftrightunsigned(F.xxhash64(doc_id.cast("string"), F.lit(1)), shift)))


def histogram(keyed: DataFrame, intervals: list[Interval]) -> dict[tuple[int, int], int]:
    """Exact bytes in each sub-interval, keyed by (interval number, sub-interval)."""
    branches = " ".join(f"WHEN {v.condition()} THEN {i * FANOUT} + {v.cell()}" for i, v in enumerate(intervals))
    rows = (keyed.select(F.expr(f"CASE {branches} END").alias("cell"), "size")
            .where("cell IS NOT NULL").groupBy("cell").agg(F.sum("size").alias("bytes")).collect())
    return {divmod(r["cell"], FANOUT): r["bytes"] for r in rows}


def find_splitters(keyed: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> list[Splitter]:
    """Splitters of ``keyed`` (__h, __g, size) into ``n_shards`` of near-equal bytes.

    Ends when every splitter is within ``tolerance`` of a shard's bytes, or on
    rows that share one key and cannot be divided (the nearer side is taken).
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    allowed = tolerance * total / n_shards
    targets = {j: j * total / n_shards for j in range(1, n_shards)}
    open_at = {j: (Interval(0, 1 << KEY_BITS), 0) for j in targets}
    found: dict[int, Splitter] = {}
    while open_at:
        intervals = list(dict.fromkeys(v for v, _ in open_at.values()))
        counts = histogram(keyed, intervals)
        narrowed = {}
        for j, (interval, below) in open_at.items():
            i = intervals.index(interval)
            left, cell = below, 0
            while cell < FANOUT - 1 and left + counts.get((i, cell), 0) < targets[j]:
                left += counts.get((i, cell), 0)
                cell += 1
            right = left + counts.get((i, cell), 0)
            lo = interval.lo + cell * interval.step
            hi = min(lo + interval.step, interval.hi)
            before, after = abs(left - targets[j]), abs(right - targets[j])
            divisible = hi - lo > 1 or interval.text_hash is None
            if min(before, after) <= allowed or not divisible:
                at = lo if before <= after else hi
                found[j] = Splitter(at) if interval.text_hash is None else Splitter(interval.text_hash, at)
            elif hi - lo > 1:
                narrowed[j] = (Interval(lo, hi, interval.text_hash), left)
            else:
                narrowed[j] = (Interval(0, 1 << KEY_BITS, lo), left)
        open_at = narrowed
    return [found[j] for j in sorted(found)]


def shard_rows(df: DataFrame, n_shards: int, text: str = "text", doc_id: str = "doc_id",
               overhead: int = 8, tolerance: float = TOLERANCE, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``df``, read back from the shards that ``write_shards`` wrote.

    Columns: doc_id, size, text_crc32, the columns named in ``keep``, shard,
    slot.  Size is the UTF-8 length of the text plus ``overhead``.  A null text
    has size ``overhead`` and the checksum of no bytes; null ids are one id;
    repeated rows each get a slot (ties among them are broken arbitrarily but
    without gaps); an empty table gives no rows.  Columns of the input whose
    names clash with the result are written to the shards but not returned.
    """
    written = write_shards(df, n_shards, shared_folder(df.sparkSession, "shards"), tolerance, text, doc_id, overhead)
    names = written_names(df.columns)
    t = F.coalesce(quoted(names[text]), F.lit(""))
    return written.select(
        quoted(names[doc_id]).alias("doc_id"), row_bytes(t, overhead).alias("size"),
        F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"), *(quoted(names[c]).alias(c) for c in keep), "shard", "slot")


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def row_bytes(text: Column, overhead: int) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + F.lit(overhead)).cast("long")


def written_names(columns: list[str]) -> dict[str, str]:
    """Name in the shards of every input column: its own, or ``input_`` and its own if that is shard or slot."""
    taken, out = {c.lower() for c in columns} | {"shard", "slot"}, {}
    for c in columns:
        name = c
        if c.lower() in ("shard", "slot"):
            while name.lower() in taken:
                name = f"input_{name}"
        out[c] = name
    return out


def write_shards(df: DataFrame, n_shards: int, path: str, tolerance: float = TOLERANCE, text: str = "text",
                 doc_id: str = "doc_id", overhead: int = 8) -> DataFrame:
    """Write the whole rows of ``df`` with their slot as one folder per shard after a single exchange.

    Splitters and the first slot of every slice are found on the keys alone; the
    rows then move once, to tasks that each hold neighbouring slices, and are
    numbered there.  All columns are written, an input column shard or slot as
    input_shard or input_slot.  ``df`` is read more than once and has to give
    the same rows each time.
    """
    names = written_names(df.columns)
    keyed = add_keys(df.select(*(quoted(c).alias(n) for c, n in names.items())), quoted(names[text]), quoted(names[doc_id]))
    keys = save(keyed.select("__h", "__g", row_bytes(quoted(names[text]), overhead).alias("size")), "shard-keys")
    splitters = find_splitters(keys, n_shards, tolerance)
    shard = " + ".join(f"cast({s.above()} AS int)" for s in splitters) or "0"
    # Numbering: fine slices of the key order, so that neither a shard nor a
    # group of copies is numbered in one task.
    slice_bits = max(0, (keys.count() // ROWS_PER_SLICE).bit_length())
    place = ["shard", "__s", "__t"]

    def placed(rows: DataFrame) -> DataFrame:
        return (rows.withColumn("shard", F.expr(shard).cast("int"))
                .withColumn("__s", F.shiftright("__h", KEY_BITS - slice_bits).cast("long") if slice_bits else F.lit(0).cast("long"))
                .withColumn("__t", F.shiftright("__g", KEY_BITS - GROUP_SLICE_BITS).cast("long")))

    starts = (placed(keys).groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("__before", F.coalesce(F.sum("n").over(
                  Window.partitionBy("shard").orderBy("__s", "__t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .drop("n"))
    # A slice's start travels with its rows and sorts before them: no join after the exchange.
    moved = (placed(keyed).unionByName(save(starts, "shard-starts"), allowMissingColumns=True)
             .repartitionByRange(*place))
    order = Window.partitionBy(*place).orderBy(F.col("__before").asc_nulls_last(), "__h", "__g", quoted(names[doc_id]))
    numbered = (moved.withColumn("slot", F.first("__before").over(order) + F.row_number().over(order) - 2)
                .where("__before IS NULL")
                .select(*(quoted(n) for n in names.values()), F.col("slot").cast("long").alias("slot"), "shard"))
    numbered.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(numbered.schema).parquet(path)
