"""Report sinks: tables as Parquet, CSV and JSON by Spark; Markdown from small aggregates on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import markdown_cell

# Columns of the report files, in order.
PER_DOCUMENT = (
    "stem", "profile", "method", "reference_characters", "hypothesis_characters", "substitutions", "deletions", "insertions", "edits",
    "cer", "cer_percent", "character_accuracy", "character_accuracy_percent",
)
PER_SETTING = ("profile", "setting", "setting_id", "cer", "cer_percent", "character_accuracy", "character_accuracy_percent", "delta_cer_vs_baseline", "delta_cer_vs_parent", "description")
ERRORS = {"error_type": "Error Type", "example": "Example", "raw_ocr": "Raw OCR", "corrected": "Corrected", "success": "是否成功"}
MARK = "\ufeff"
#: Keys of a summary's document that no later version writes.
OBSOLETE = ("missing_sections", "question_counts", "quiz_preparation", "quiz")


def percentages(facts: DataFrame) -> DataFrame:
    return facts.withColumns({"cer_percent": F.col("cer") * 100, "character_accuracy_percent": F.col("character_accuracy") * 100})


def _write_csv(df: DataFrame, path: str) -> None:
    """CSV whose files each begin with a byte order mark and the header, for spreadsheets."""
    df.toDF(MARK + df.columns[0], *df.columns[1:]).write.mode("overwrite").option("header", True).csv(path)


def write_facts(facts: DataFrame, path: str) -> None:
    """Per-document CSV in fixed column order; infinite rates are written as inf."""
    p = percentages(facts)
    rates = {c: F.when(F.abs(c) == float("inf"), "inf").otherwise(F.col(c).cast("string")) for c in ("cer", "cer_percent")}
    _write_csv(p.withColumns(rates).select(*[c for c in PER_DOCUMENT if c in p.columns]), path)


def write_errors(details: DataFrame, path: str) -> None:
    _write_csv(details.select(*[F.col(a).alias(b) for a, b in ERRORS.items()]), path)


def write_settings(ablation: DataFrame, named: DataFrame, path: str) -> None:
    """CSV of an ablation, a row a profile and setting; ``named``: setting_id, setting (its label), description."""
    rows = percentages(ablation).join(F.broadcast(named), "setting_id")
    _write_csv(rows.select(*PER_SETTING), path)


def stage_documents(rows: DataFrame, key: str = "stem") -> DataFrame:
    """stem and one JSON document of all other columns, which a stage writes beside its text."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key]), {"ignoreNullFields": "false"}).alias("json"))


def write_stage(rows: DataFrame, path: str, text: str) -> None:
    """A stage's texts and documents as two tables under one folder: text (stem, value) and json (stem, json)."""
    rows.select("stem", F.col(text).alias("value")).write.mode("overwrite").parquet(f"{path}/text")
    stage_documents(rows).write.mode("overwrite").parquet(f"{path}/json")


def revalidated(texts: DataFrame, documents: DataFrame, errors, kind: str, into: str) -> DataFrame:
    """stem, json of artifacts checked once more: their documents (stem, json; may be absent) less obsolete keys, with the text,
    its messages (``errors``, a function of the text) and the document's type. A document that is no JSON counts as empty."""
    kept = F.map_filter(F.coalesce(F.from_json("json", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*OBSOLETE, into, "validation_errors", "document_type"))
    own = F.map_from_arrays(F.array(F.lit(into), F.lit("validation_errors"), F.lit("document_type")), F.array(F.col("text"), F.to_json(errors(F.col("text"))), F.lit(kind)))
    return texts.join(documents, "stem", "left").select("stem", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, own))))).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown_table(small: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; more than ``most`` rows are an error, not a cut."""
    rows = small.select(*[markdown_cell(F.coalesce(F.col(c).cast("string"), F.lit("N/A"))).alias(c) for c in small.columns]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a report table")
    lines = ["| " + " | ".join(small.columns) + " |", "|" + "---|" * len(small.columns)]
    return "\n".join([*lines, *["| " + " | ".join(r) + " |" for r in rows]]) + "\n"


def report(aggregates: DataFrame, improvements: DataFrame | None = None, error_summary: DataFrame | None = None) -> str:
    """Markdown of an evaluation: rates, improvement and error types, each a small table."""
    parts = ["# CER report\n\n## Rates\n\n" + markdown_table(aggregates)]
    if improvements is not None:
        parts.append("## Improvement\n\n" + markdown_table(improvements))
    if error_summary is not None:
        parts.append("## Errors\n\n" + markdown_table(error_summary.orderBy("ord").select(*[F.col(a).alias(b) for a, b in ERRORS.items()])))
    return "\n".join(parts)
