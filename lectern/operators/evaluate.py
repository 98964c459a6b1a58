"""Error rates of transcriptions against references: joins, aggregates, improvement and ablation.

Facts stay long: one row a (stem, profile, method). Predictions that are missing make no row and no zero;
they are listed, and required ones are an error for the caller to raise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics, text

PROFILES = ("strict", "no_whitespace")
METHODS = ("paddleocr_baseline", "ensemble_only", "ensemble_llm")
REQUIRED = ("paddleocr_baseline", "ensemble_llm")
# Ablation settings (id, parent, variant), in report order.
SETTINGS = (
    ("raw_paddleocr", None, None),
    ("document_rectification", "raw_paddleocr", "document"),
    ("blue_ink_extraction", "raw_paddleocr", "blue_ink"),
    ("line_removal", "raw_paddleocr", "line_removed"),
    ("multi_variant_ensemble", "raw_paddleocr", None),
    ("rule_based_normalization", "multi_variant_ensemble", None),
    ("llm_correction", "rule_based_normalization", None),
)


def settings(spark) -> DataFrame:
    return spark.createDataFrame([(k, *s) for k, s in enumerate(SETTINGS)], "ord int, id string, parent_id string, variant string")


def expected(truth: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """Every (stem, method) that should have a prediction."""
    return truth.select("stem", F.explode(F.array(*map(F.lit, methods))).alias("method"))


def missing(truth: DataFrame, predictions: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    return expected(truth, methods).join(predictions.select("stem", "method"), ["stem", "method"], "left_anti")


def keep_stems(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``wanted`` key column is among the wanted ones; each once, however often it is wanted."""
    return rows.join(wanted, wanted.columns, "left_semi")


def check_complete(truth: DataFrame, predictions: DataFrame, required: tuple[str, ...] = REQUIRED) -> None:
    """Raise if a reference is empty or a required prediction is absent."""
    empty = truth.where(F.length(text.normalize_text(F.col("text"), True)) == 0).limit(5).collect()
    if empty:
        raise ValueError(f"Ground truth is empty: {[r['stem'] for r in empty]}")
    lost = missing(truth, predictions, required).limit(5).collect()
    if lost:
        raise FileNotFoundError(f"Missing predictions: {[(r['stem'], r['method']) for r in lost]}")


def edit_statistics(truth: DataFrame, predictions: DataFrame, *, split: bool = False, compose: bool = True) -> DataFrame:
    """One row a (stem, profile, method): lengths, edits, cer and accuracy; with ``split`` also S, D and I.

    Texts are compared whole, both profiles in one pass over a pair.
    """
    pairs = predictions.select("stem", "method", F.col("text").alias("h")).join(truth.select("stem", F.col("text").alias("r")), "stem")
    made = pairs.select("stem", "method", metrics.edit_facts(F.col("r"), F.col("h"), split, compose).alias("f"))
    both = [F.struct(F.lit(p).alias("profile"), f"f.{k}.*") for p, k in zip(PROFILES, ("strict", "bare"), strict=True)]
    facts = made.select("stem", "method", F.inline(F.array(*both)))
    cer = metrics.rate(F.col("edits"), F.col("reference_characters"), F.col("hypothesis_characters"))
    return facts.withColumn("cer", cer).withColumn("character_accuracy", metrics.accuracy(F.col("cer")))


def aggregate(facts: DataFrame) -> DataFrame:
    """Micro and macro rates by profile and method. Counts over nothing are 0 and rates null."""
    extra = [c for c in ("substitutions", "deletions", "insertions") if c in facts.columns]
    sums = ["reference_characters", "hypothesis_characters", *extra, "edits"]
    out = facts.groupBy("profile", "method").agg(
        F.count("*").alias("document_count"), *[F.sum(c).alias(c) for c in sums],
        F.avg("cer").alias("macro_cer"), F.avg("character_accuracy").alias("macro_character_accuracy"),
    )
    micro = F.try_divide(F.col("edits").cast("double"), F.col("reference_characters"))
    return out.withColumn("micro_cer", micro).withColumn("micro_character_accuracy", metrics.accuracy(F.col("micro_cer")))


def scaffolded(aggregates: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """One row for every profile and method, counted ones or not."""
    spark = aggregates.sparkSession
    grid = spark.createDataFrame([(p, m) for p in PROFILES for m in methods], "profile string, method string")
    out = grid.join(aggregates, ["profile", "method"], "left")
    return out.fillna(0, [c for c in aggregates.columns if dict(aggregates.dtypes)[c] == "bigint"])


def improvement(aggregates: DataFrame, base: str, proposed: str) -> DataFrame:
    """Absolute and relative reduction of the micro rate by profile; relative is null where the base is 0."""
    rate = lambda m: F.max(F.when(F.col("method") == m, F.col("micro_cer")))
    out = aggregates.groupBy("profile").agg(rate(base).alias("base_cer"), rate(proposed).alias("proposed_cer"))
    diff = F.col("base_cer") - F.col("proposed_cer")
    return out.withColumn("absolute_reduction", diff).withColumn("relative_reduction", F.try_divide(diff, F.col("base_cer")))


def ablation(aggregates: DataFrame, dimension: DataFrame, baseline: str = "raw_paddleocr") -> DataFrame:
    """Rates by profile and setting with the difference to the baseline and to the setting's parent."""
    a = aggregates.select("profile", F.col("method").alias("setting_id"), "document_count", "reference_characters", "edits", F.col("micro_cer").alias("cer"), F.col("micro_character_accuracy").alias("character_accuracy"))
    # a window over the few aggregates: joins with themselves would count everything once more for each
    a = a.withColumn("_all", F.collect_list(F.struct("setting_id", "cer")).over(Window.partitionBy("profile")))
    rows = a.join(F.broadcast(dimension.select(F.col("id").alias("setting_id"), "parent_id")), "setting_id")
    cer = lambda name: F.get(F.filter("_all", lambda x: x["setting_id"] == name), F.lit(0))["cer"]
    out = rows.withColumn("delta_cer_vs_baseline", F.col("cer") - cer(F.lit(baseline))).withColumn("delta_cer_vs_parent", F.col("cer") - cer(F.col("parent_id")))
    return out.select("profile", "setting_id", "parent_id", *a.columns[2:-1], "delta_cer_vs_baseline", "delta_cer_vs_parent")
