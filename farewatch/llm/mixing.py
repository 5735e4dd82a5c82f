"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic).  Raking then scales the
cells' token weights in turn to the target share of every source, language
and topic; a cell is never given more than ``max_epochs`` times its tokens.
A document is drawn with its cell's probability (target tokens / tokens); the
draw is a hash of its id, so it is the same in every run and on every engine.

Only the cell table is iterated on, by window sums over each dimension: a
source with a third of all rows is one row per (language, topic) there.
DataFrame functions throughout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from farewatch.llm.common import WORD_PATTERN, save, unit_hash

DIMENSIONS = ("source", "lang", "topic")
# Target share of a category is proportional to its tokens to this power:
# 1 keeps the corpus' own mix, 0 makes all categories equal.
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
# Tokens to draw, as a share of all; rounds of raking; passes over one document.
BUDGET = 0.6
ITERATIONS = 12
MAX_EPOCHS = 1.0
MISSING = "<none>"
SEED = "mix"

# Marks that decide a text's topic, first match wins.
TOPIC_MARKS = (("legal", ("license", "copyright")), ("contact", ("@",)), ("web", ("http", "www.")))
TOPIC_REST = "prose"


def topic_of(text: Column) -> Column:
    """Topic of a text by the first mark that its lower-cased form contains."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for topic, marks in TOPIC_MARKS:
        hit = reduce(Column.__or__, [lowered.contains(m) for m in marks])
        out = F.when(hit, topic) if out is None else out.when(hit, topic)
    return out.otherwise(TOPIC_REST)


def tempered_targets(cells: DataFrame, exponents: dict[str, float]) -> dict[str, DataFrame]:
    """Per dimension a table (value, share); the shares sum to 1."""
    out = {}
    for d in DIMENSIONS:
        sums = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
        sums = sums.withColumn("p", F.pow("t", F.lit(float(exponents[d]))))
        total = sums.agg(F.sum("p")).first()[0] or 1.0
        out[d] = sums.select(d, (F.col("p") / F.lit(total)).alias("share"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], budget: float = BUDGET, iterations: int = ITERATIONS,
         max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Cells (source, lang, topic, tokens) with their raked token weight.

    Each round scales the weights to the source, language and topic targets in
    turn and cuts every cell at ``max_epochs`` times its tokens.  Values
    without a target keep weight 0.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    fitted = cells.withColumn("weight", F.col("tokens").cast("double") * F.lit(float(budget)))
    for d in DIMENSIONS:
        fitted = fitted.join(targets[d].select(d, F.col("share").alias(f"share_{d}")), d, "left")
    most = F.col("tokens") * F.lit(float(max_epochs))
    for _ in range(iterations):
        for d in DIMENSIONS:
            now = F.sum("weight").over(Window.partitionBy(d))
            factor = F.when(now > 0, F.coalesce(f"share_{d}", F.lit(0.0)) * F.lit(budget * total) / now).otherwise(F.lit(0.0))
            fitted = fitted.withColumn("weight", F.least(F.col("weight") * factor, most))
        fitted = save(fitted, "rake")
    return fitted.select(*DIMENSIONS, "tokens", "weight")


def residuals(fitted: DataFrame, targets: dict[str, DataFrame], budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """What raking reached: dimension, value, target, reached, residual, full.

    ``target`` and ``reached`` are shares of the token budget (a value without a
    target has 0); ``residual`` is what is missing (negative: too much).  ``full``
    says that every cell of the value is at its most, so that no weights
    with this ``max_epochs`` give it more.
    """
    total = fitted.agg(F.sum("tokens")).first()[0] or 0
    out = None
    for d in DIMENSIONS:
        at_most = F.bool_and((F.col("tokens") == 0) | (F.col("weight") >= F.col("tokens") * F.lit(max_epochs * (1 - 1e-9))))
        reached = fitted.groupBy(d).agg((F.sum("weight") / F.lit(budget * total or 1.0)).alias("reached"), at_most.alias("full"))
        rows = reached.join(targets[d].select(d, "share"), d, "left").select(
            F.lit(d).alias("dimension"), F.col(d).alias("value"), F.coalesce("share", F.lit(0.0)).alias("target"), "reached", "full")
        out = rows if out is None else out.unionByName(rows)
    return out.select("dimension", "value", "target", "reached", (F.col("target") - F.col("reached")).alias("residual"), "full")


def mixing_report(docs: DataFrame, budget: float = BUDGET, iterations: int = ITERATIONS, max_epochs: float = MAX_EPOCHS,
                  exponents: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None,
                  topic: Column | None = None) -> DataFrame:
    """``residuals`` of the mixture that ``mix_sources`` draws with the same arguments.

    Targets that ``max_epochs`` puts out of reach show as residuals of full values.
    """
    sized = docs.select(*categories(topic), n_tokens().alias("n_tokens"))
    cells = save(sized.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    targets = targets or tempered_targets(cells, exponents or EXPONENTS)
    return residuals(rake(cells, targets, budget, iterations, max_epochs), targets, budget, max_epochs)


def mix_sources(docs: DataFrame, budget: float = BUDGET, iterations: int = ITERATIONS, max_epochs: float = MAX_EPOCHS,
                exponents: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None,
                topic: Column | None = None, seed: str = SEED) -> DataFrame:
    """All documents with the probability and the number of copies drawn of each.

    Columns: doc_id, source, lang, topic, n_tokens (words), probability (rounded
    to 9 places), copies (0: not drawn; more than 1 only if ``max_epochs`` allows).
    ``targets`` gives the wanted shares per dimension; by default they are the
    corpus' token shares to the powers of ``exponents``.  Nulls: a missing
    source, language or topic is the category ``<none>``; a null text has no
    words.  Documents without words have probability 0.  Rows with one doc_id
    get the same draw.  An empty table gives no rows.
    """
    sized = save(docs.select("doc_id", *categories(topic), n_tokens().alias("n_tokens")), "mix-sizes")
    chances = cell_chances(sized, budget, iterations, max_epochs, exponents, targets)
    return sized.join(chances, list(DIMENSIONS)).select(
        "doc_id", *DIMENSIONS, "n_tokens", "probability", copies(seed).cast("int").alias("copies"))


def draw_documents(docs: DataFrame, budget: float = BUDGET, iterations: int = ITERATIONS, max_epochs: float = MAX_EPOCHS,
                   exponents: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None,
                   topic: Column | None = None, seed: str = SEED) -> DataFrame:
    """The drawn rows of ``docs``, all columns, each as often as ``mix_sources`` says.

    Documents meet the cell probabilities where they are; only the cell table moves.
    """
    names = [f"__{d}" for d in DIMENSIONS]
    marked = docs.withColumns(dict(zip(names, categories(topic), strict=True)))
    sized = docs.select(*categories(topic), n_tokens().alias("n_tokens"))
    chances = cell_chances(sized, budget, iterations, max_epochs, exponents, targets).select(
        *(F.col(d).alias(n) for d, n in zip(DIMENSIONS, names, strict=True)), F.col("probability").alias("__p"))
    drawn = (marked.join(chances, names).withColumn("__n", copies(seed, F.col("__p")).cast("int")).where("__n > 0"))
    if max_epochs > 1:
        drawn = drawn.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return drawn.select(*(F.col(f"`{c}`") for c in docs.columns))


def categories(topic: Column | None = None) -> list[Column]:
    """source, lang and topic with the name of missing ones filled in."""
    topic = topic if topic is not None else topic_of(F.col("text"))
    return [*(F.coalesce(F.col(d).cast("string"), F.lit(MISSING)).alias(d) for d in ("source", "lang")),
            F.coalesce(topic, F.lit(MISSING)).alias("topic")]


def n_tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def cell_chances(sized: DataFrame, budget, iterations, max_epochs, exponents, targets) -> DataFrame:
    """(source, lang, topic, probability) of all cells of (source, lang, topic, n_tokens)."""
    cells = save(sized.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    fitted = rake(cells, targets or tempered_targets(cells, exponents or EXPONENTS), budget, iterations, max_epochs)
    return fitted.select(*DIMENSIONS, F.round(F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
                                              .otherwise(F.lit(0.0)), 9).alias("probability"))


def copies(seed: str, probability: Column | None = None) -> Column:
    """Whole copies of a document, and one more with the rest of its probability."""
    p = F.col("probability") if probability is None else probability
    return F.floor(p) + F.when(unit_hash(F.col("doc_id"), seed) < p - F.floor(p), 1).otherwise(0)


def oracle_sql(budget: float = BUDGET, iterations: int = ITERATIONS, max_epochs: float = MAX_EPOCHS,
               exponents: dict[str, float] = EXPONENTS, seed: str = SEED) -> str:
    """DuckDB SQL for ``mix_sources`` over ``documents``, one CTE per raking step."""
    text = "lower(coalesce(text, ''))"
    cases = " ".join(f"WHEN {' OR '.join(f'contains({text}, {m!r})' for m in marks)} THEN {topic!r}"
                     for topic, marks in TOPIC_MARKS)
    steps = [f"""sized AS (SELECT doc_id, coalesce(source, '{MISSING}') AS source, coalesce(lang, '{MISSING}') AS lang,
        CASE {cases} ELSE '{TOPIC_REST}' END AS topic,
        CAST(coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0) AS BIGINT) AS n_tokens FROM documents)""",
             """cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM sized GROUP BY ALL)""",
             "total AS (SELECT CAST(sum(tokens) AS DOUBLE) AS t FROM cells)",
             f"w0 AS MATERIALIZED (SELECT *, CAST(tokens AS DOUBLE) * {budget}::DOUBLE AS weight FROM cells)"]
    for d in DIMENSIONS:
        steps.append(f"""target_{d} AS MATERIALIZED (SELECT {d}, p / sum(p) OVER () AS share FROM
            (SELECT {d}, pow(CAST(sum(tokens) AS DOUBLE), {exponents[d]}::DOUBLE) AS p FROM cells
             GROUP BY {d} HAVING sum(tokens) > 0))""")
    n = 0
    for _ in range(iterations):
        for d in DIMENSIONS:
            steps.append(f"""w{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, least(weight * factor, tokens * {max_epochs}::DOUBLE) AS weight
                FROM w{n} JOIN (SELECT a.{d}, CASE WHEN now > 0 THEN coalesce(share, 0) * ({budget}::DOUBLE * (SELECT t FROM total)) / now
                ELSE 0 END AS factor FROM (SELECT {d}, sum(weight) AS now FROM w{n} GROUP BY {d}) a
                LEFT JOIN target_{d} USING ({d})) USING ({d}))""")
            n += 1
    steps.append(f"""chances AS (SELECT source, lang, topic,
        round(CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END, 9) AS probability FROM w{n})""")
    return "WITH " + ",\n".join(steps) + f"""
    SELECT doc_id, source, lang, topic, n_tokens, probability,
      CAST(floor(probability) + CASE WHEN CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)
        / {float(2**52)}::DOUBLE < probability - floor(probability) THEN 1 ELSE 0 END AS INTEGER) AS copies
    FROM sized JOIN chances USING (source, lang, topic)"""
