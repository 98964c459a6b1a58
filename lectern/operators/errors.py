"""Typing of recognition and correction errors from opcodes, and their summary.

Opcodes are computed once a pair; spans, insertions and correctness are read off both lists of a row side by
side, so the classification needs no join and no second pass over the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics, script

# Error types in report order, statuses, and what stands for nothing.
MIXED, SIMILAR, LOST, INVENTED = "繁簡混用", "相似字誤認", "缺字", "LLM hallucination"
TYPES = (MIXED, SIMILAR, LOST, INVENTED)
YES, NO, PARTLY, NOT_APPLICABLE, NONE_FOUND, YES_NONE = "是", "否", "部分", "不適用", "未偵測", "是（未偵測）"
EMPTY = "∅"


def _or_empty(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(EMPTY))


def error_details(rows: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """Rows stem, reference, raw, corrected to one row an error, in order ``ord`` within a stem."""
    found = rows.select("stem", F.inline(metrics.error_spans(F.col("reference"), F.col("raw"), F.col("corrected"))))
    mixed = (F.length("r") > 0) & (script.to_traditional(F.col("r"), table) == F.col("g"))
    kind = F.when(F.col("tag") == "insert", INVENTED).when(F.col("tag") == "delete", LOST).when(mixed, MIXED).otherwise(SIMILAR)
    return found.select(
        "stem", "ord", kind.alias("error_type"), F.concat(F.lit("GT「"), _or_empty(F.col("g")), F.lit("」")).alias("example"),
        _or_empty(F.col("r")).alias("raw_ocr"), _or_empty(F.col("c")).alias("corrected"), F.when(F.col("right"), YES).otherwise(NO).alias("success"),
    )


def summarize(details: DataFrame) -> DataFrame:
    """One row an error type in fixed order: the first error found stands for the rest."""
    first = F.min_by(F.struct("stem", "example", "raw_ocr", "corrected"), F.struct("stem", "ord"))
    found = details.groupBy("error_type").agg(first.alias("f"), F.count("*").alias("n"), F.min("success").alias("a"), F.max("success").alias("b"))
    types = details.sparkSession.createDataFrame(list(enumerate(TYPES)), "ord int, error_type string")
    named = F.concat("f.stem", F.lit("："), "f.example", F.lit("（共 "), F.col("n").cast("string"), F.lit(" 筆）"))
    none = F.when(F.col("error_type") == INVENTED, YES_NONE).otherwise(NOT_APPLICABLE)
    return types.join(found, "error_type", "left").select(
        "ord", "error_type", F.coalesce(named, F.lit(NONE_FOUND)).alias("example"), F.coalesce("f.raw_ocr", F.lit("-")).alias("raw_ocr"), F.coalesce("f.corrected", F.lit("-")).alias("corrected"),
        F.when(F.col("n").isNull(), none).when(F.col("a") == F.col("b"), F.col("a")).otherwise(PARTLY).alias("success"),
    )
