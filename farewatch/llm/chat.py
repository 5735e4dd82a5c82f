"""Reply trees to chat text: enumerate root-to-leaf paths, rank branches, format conversations.

Messages form trees by parent id.  Paths are enumerated by iterated self-joins
that double their reach: after k joins every leaf is paired with its
ancestors up to distance 2^k - 1, so a chain of n messages takes log2(n)
joins.  Only ids take part in the joins; texts are joined to the chosen paths.

Template of one turn (``\\`` escapes control strings inside texts)::

    <turn role=ROLE>
    TEXT
    </turn>

In a text, ``\\`` is doubled and a ``\\`` is put after the ``<`` of every
``<turn`` and ``</turn``; removing one ``\\`` before each following character
restores it.  DataFrame functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, SparkSession, functions as F

from farewatch.llm.common import save

OPEN, CLOSE = "<turn role=", "\n</turn>\n"
# Strings that may not occur bare inside a text.
CONTROL = ("</turn", "<turn")
LOSS_ROLE = "assistant"
ROOT_DISTANCE = 0


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turn(role: Column, text: Column) -> Column:
    """One turn in the template; the role is URL-encoded (letters stay as they are)."""
    return F.concat(F.lit(OPEN), F.url_encode(role), F.lit(">\n"), escape(text), F.lit(CLOSE))


def enumerate_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, msg, distance from the leaf) of every path that reaches a root.

    ``messages``: tree, msg, parent.  A parent that is null or not in the tree
    makes its message a root.  Messages on or below a cycle of parents reach no
    root and give no path.
    """
    nodes = save(messages.select("tree", "msg", "parent").dropDuplicates(["tree", "msg"]), "tree-nodes")
    known = nodes.select("tree", F.col("msg").alias("parent"))
    jump = save(nodes.join(known, ["tree", "parent"]).select("tree", "msg", F.col("parent").alias("up")), "tree-jump")
    roots = nodes.join(jump.select("tree", "msg"), ["tree", "msg"], "left_anti").select("tree", "msg")
    leaves = nodes.join(jump.select("tree", F.col("up").alias("msg")), ["tree", "msg"], "left_anti")
    paths = leaves.select("tree", F.col("msg").alias("leaf"), "msg", F.lit(0).alias("distance"))
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < largest:
        further = (paths.join(jump, ["tree", "msg"])
                   .select("tree", "leaf", F.col("up").alias("msg"), (F.col("distance") + reach).alias("distance")))
        paths = save(paths.unionByName(further), "tree-paths")
        reach *= 2
        if reach >= largest:
            break
        over = jump.select("tree", F.col("msg").alias("up"), F.col("up").alias("top"))
        jump = save(jump.join(over, ["tree", "up"]).select("tree", "msg", F.col("top").alias("up")), "tree-jump")
        if jump.isEmpty():
            break
    whole = paths.join(roots, ["tree", "msg"], "left_semi").select("tree", "leaf")
    return paths.join(whole, ["tree", "leaf"], "left_semi")


def choose_branches(paths: DataFrame, scores: DataFrame, branches: int) -> DataFrame:
    """The ``branches`` best (tree, leaf) of each tree by mean message score, ties to the smaller leaf."""
    ranked = (paths.join(scores, ["tree", "msg"]).groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"))
              .withColumn("branch", F.row_number().over(
                  Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf"))))
    return ranked.where(F.col("branch") <= branches)


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """One formatted conversation per chosen root-to-leaf path.

    ``messages``: tree, msg, parent, role, text, score (tree and msg not null;
    further columns are not read).  Null roles and texts count as empty, null
    scores as 0.  Of rows that repeat a (tree, msg) one is kept.  Columns:
    tree, leaf, branch, branch_score, formatted.
    """
    clean = messages.select(
        "tree", "msg", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).dropDuplicates(["tree", "msg"])
    paths = save(enumerate_paths(clean), "tree-whole-paths")
    chosen = choose_branches(paths, clean.select("tree", "msg", "score"), branches)
    turns = (paths.join(chosen, ["tree", "leaf"]).join(clean.select("tree", "msg", "role", "text"), ["tree", "msg"])
             .withColumn("turn", F.struct((-F.col("distance")).alias("at"),
                                          format_turn(F.col("role"), F.col("text")).alias("part"))))
    return (turns.groupBy("tree", "leaf").agg(
        F.first("branch").alias("branch"), F.first("branch_score").alias("branch_score"),
        F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t["part"]), "").alias("formatted")))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    parts = F.split(formatted, r"\n</turn>\n", -1)

    def turn(part: Column) -> Column:
        role = F.regexp_extract(part, r"^<turn role=([^>]*)>\n", 1)
        text = F.substr(part, F.length(role) + F.lit(len(OPEN) + len(">\n") + 1))
        return F.struct(F.url_decode(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def loss_spans(formatted: Column) -> Column:
    """array<struct<start, length>>: code points of the assistant texts as they stand in ``formatted``."""
    parts = F.split(formatted, r"\n</turn>\n", -1)

    def step(acc: Column, part: Column) -> Column:
        role = F.regexp_extract(part, r"^<turn role=([^>]*)>\n", 1)
        head = F.length(role) + F.lit(len(OPEN) + len(">\n"))
        span = F.struct((acc["at"] + head).alias("start"), (F.length(part) - head).alias("length"))
        grown = F.when(role == LOSS_ROLE, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(part) + F.lit(len(CLOSE))).alias("at"), grown.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))
    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step, lambda acc: acc["spans"])


def conversations_as_trees(rows: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each turn answers the one before.

    Rows are ordered by turn, then role and text (rows that repeat a turn follow
    one another; null turns come first).  Rows without conv_id form one
    conversation of their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn("msg", F.row_number().over(order))
    return numbered.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("<none>")).alias("tree"), "conv_id", "msg",
        (F.col("msg") - 1).alias("parent"), "role", "text", F.length("text").alias("score"))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """The contract's digests, all read back from the formatted text."""
    read = formatted.withColumn("turns", parse_turns(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    spans = loss_spans(F.col("formatted"))
    read = read.withColumn("__loss", F.array_join(F.transform(
        spans, lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"]))), ""))
    return read.select(
        F.when(F.col("tree") != "<none>", F.col("tree").cast("long")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"), F.sha2(F.encode("__loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


# The conversation that the query adds to the table.
PROBE_ID = -7
PROBE_TEXT = r"\### Assistant: </turn> ok"


def probe_turns(spark: SparkSession) -> DataFrame:
    """The stated extra conversation: a user and an assistant turn, made by expressions."""
    return spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))



ORACLE_SQL = rf"""
WITH all_rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}'),
escaped AS (SELECT *, replace(replace(replace(text, '\', '\\'), '</turn', '<\/turn'), '<turn', '<\turn') AS e FROM all_rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
  CAST(sum(length(e) + length(url_encode(role)) + {len(OPEN) + len('>') + 1 + len(CLOSE)}) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id"""
