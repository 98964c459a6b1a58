"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed into cells (source, language, topic). Rounds of raking scale each cell's weight a
token so that the weighted sums meet the source, the language and the topic targets in turn. A document is
then kept with a probability proportional to its cell's weight, drawn from a hash of its id, so the draw
is repeatable and needs no shuffle. Topic is a surface class of the text (see ``topic``).

Edge cases: null source, language or text count as "" and belong to that class; documents without words
carry no tokens and follow their cell, with probability 0 where the whole cell has no tokens; targets are
shares tempered from the corpus unless given, targets of absent classes are ignored; rows with equal ids
share one draw, null ids draw as ""; targets that no weights meet leave the last round's weights, with a
warning that names the largest deviation; empty tables give empty results; other columns are kept as they are, but for those the operator adds by name.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, spool

MARGINS = ("source", "lang", "topic")
#: Cells beyond this are raked over shuffled partitions and joined, not broadcast.
MOST_BROADCAST = 20_000
EVERY = 4
#: Relative deviation of a margin from its target that passes without a warning.
TOLERANCE = 0.01
HEX = 13


def measured(docs: DataFrame) -> DataFrame:
    """The documents with _source, _lang, _topic and _tokens (words of the whole text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_tokens", F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long"))
    d = d.withColumn("_marks", F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))).withColumn("_upper", F.length(F.regexp_replace(text, "[^A-Z]+", "")))
    return d.withColumns(
        {"_source": F.coalesce("source", F.lit("")), "_lang": F.coalesce("lang", F.lit("")), "_topic": topic(text)}
    ).drop("_marks", "_upper")


def topic(text: Column) -> Column:
    """Surface class: symbols, shout, long, brief or prose."""
    return (
        F.when(20 * F.col("_marks") > F.col("_tokens"), "symbols")
        .when(10 * F.col("_upper") > 3 * F.length(text), "shout")
        .when(F.col("_tokens") >= 2000, "long")
        .when(F.col("_tokens") < 100, "brief")
        .otherwise("prose")
    )


def rake(cells: DataFrame, *, temper: float = 0.7, rounds: int = 12, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Cells (_source, _lang, _topic, tokens) with weight a token and probability; the largest probability is 1.

    Targets by margin default to shares in proportion to tokens ** temper; given ones are scaled to sum 1.
    """
    n = cells.count()
    small = n <= MOST_BROADCAST
    # few cells are one partition, also as read back, so that no margin is shuffled
    held = lambda df, label: spool(df.coalesce(1), label).coalesce(1) if small else spool(df, label)
    cells = held(cells.where("tokens > 0").withColumn("weight", F.lit(1.0)), "op4-cells")
    goal = {}
    for m in MARGINS:
        sums = cells.groupBy(f"_{m}").agg(F.sum("tokens").cast("double").alias("t"))
        given = (targets or {}).get(m)
        if given:
            raw = F.coalesce(F.get(F.array(*[F.lit(float(v)) for v in given.values()]), F.array_position(F.array(*map(F.lit, given)), F.col(f"_{m}")).cast("int") - 1), F.lit(0.0))
        else:
            raw = F.pow("t", F.lit(temper))
        goal[m] = sums.select(f"_{m}", raw.alias(f"raw_{m}"))
    for m in MARGINS:
        total = goal[m].agg(F.sum(f"raw_{m}").alias("_all"))
        goal[m] = goal[m].join(F.broadcast(total)).select(f"_{m}", (F.col(f"raw_{m}") / F.col("_all")).alias(f"goal_{m}"))
        cells = cells.join(goal[m], f"_{m}")
    cells = held(cells, "op4-goals")
    for k in range(rounds):
        for m in MARGINS:
            now = F.sum(F.col("weight") * F.col("tokens")).over(Window.partitionBy(f"_{m}"))
            cells = cells.withColumn("weight", F.col("weight") * F.col(f"goal_{m}") / now)
        if (k + 1) % EVERY == 0 or not small:
            cells = held(cells, "op4-raked")
    if (off := deviation(cells)) > TOLERANCE:
        warnings.warn(f"after {rounds} rounds a margin is still {off:.3g} of its target off", stacklevel=2)
    top = cells.agg(F.max("weight").alias("_top"))
    return cells.join(F.broadcast(top)).select("_source", "_lang", "_topic", "tokens", "weight", (F.col("weight") / F.col("_top")).alias("probability"))


def deviation(cells: DataFrame) -> float:
    """Largest relative difference of a margin's weighted sum to its target."""
    gaps = []
    for m in MARGINS:
        gap = F.abs(F.sum(F.col("weight") * F.col("tokens")) - F.max(f"goal_{m}")) / F.max(f"goal_{m}")
        gaps.append(cells.where(F.col(f"goal_{m}") > 0).groupBy(f"_{m}").agg(gap.alias("gap")).agg(F.max("gap").alias("gap")))
    return gaps[0].union(gaps[1]).union(gaps[2]).agg(F.max("gap")).first()[0] or 0.0


def draw(doc_id: Column, seed: str) -> Column:
    """Uniform number in [0, 1) from the digest of seed and id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, HEX)
    return F.conv(digits, 16, 10).cast("double") / float(16**HEX)


def calibrated(docs: DataFrame, *, seed: str = "mix", **options) -> DataFrame:
    """Measured documents with _probability and _kept."""
    m = measured(docs.drop("_probability", "_kept"))
    cells = m.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens"))
    cells = spool(rake(spool(cells, "op4-counted"), **options), "op4-weights")
    near = cells.select("_source", "_lang", "_topic", F.col("probability").alias("_probability"))
    if near.count() <= MOST_BROADCAST:
        near = F.broadcast(near)
    out = m.join(near, ["_source", "_lang", "_topic"], "left").withColumn("_probability", F.coalesce("_probability", F.lit(0.0)))
    return out.withColumn("_kept", draw(F.col("doc_id"), seed) < F.col("_probability"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document with its cell, calibrated probability in millionths, and whether it is drawn."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return calibrated(docs).select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.round(F.col("_probability") * 1e6).cast("long").alias("probability_ppm"), F.col("_kept").alias("kept"),
    )


def oracle(temper: float = 0.7, rounds: int = 12, seed: str = "mix") -> str:
    """The same rows in DuckDB SQL."""
    parts = [
        """m AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n,
 length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS marks, length(regexp_replace(coalesce(text, ''), '[^A-Z]+', '', 'g')) AS upper_n FROM documents)""",
        """d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CAST(n AS BIGINT) AS n_tokens,
 CASE WHEN 20 * marks > n THEN 'symbols' WHEN 10 * upper_n > 3 * length(coalesce(text, '')) THEN 'shout' WHEN n >= 2000 THEN 'long' WHEN n < 100 THEN 'brief' ELSE 'prose' END AS topic FROM m)""",
        "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(1 AS DOUBLE) AS weight FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for m in MARGINS:
        parts.append(f"g_{m} AS (SELECT {m}, pow(sum(tokens), {temper}) / sum(pow(sum(tokens), {temper})) OVER () AS goal_{m} FROM c GROUP BY {m})")
    parts.append("w0 AS (SELECT * FROM c JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic))")
    k = 0
    for _ in range(rounds):
        for m in MARGINS:
            parts.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (weight * goal_{m} / sum(weight * tokens) OVER (PARTITION BY {m}) AS weight) FROM w{k})")
            k += 1
    parts.append(f"p AS (SELECT source, lang, topic, weight / max(weight) OVER () AS probability FROM w{k})")
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, n_tokens, CAST(round(coalesce(probability, 0) * 1e6) AS BIGINT) AS probability_ppm,
 CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {HEX}) AS BIGINT) / {float(16**HEX)!r} < coalesce(probability, 0) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)"""
    )
