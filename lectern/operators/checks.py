"""Checks of a finished run, as a query that returns what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def violations(runs: DataFrame, *, expect_llm: bool = True, expect_quiz: bool = True, count: int = 5) -> DataFrame:
    """stem, problem of every broken expectation; a sound run has no rows.

    ``runs``: stem, ocr_text, clean_region_count, corrected_text, corrected_llm, summary_errors, summary_llm,
    quiz_errors and question_counts (map). What is null counts as empty, zero or false.
    """
    blank = lambda c: text.strip(F.coalesce(F.col(c), F.lit(""))) == ""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    joined = lambda c, t: F.concat(F.lit(t), F.array_join(c, "; "))
    tests = [
        (blank("ocr_text"), F.lit("no recognised text")),
        (F.coalesce("clean_region_count", F.lit(0)) <= 0, F.lit("no clean regions")),
        (blank("corrected_text"), F.lit("no corrected text")),
        (some("summary_errors"), joined("summary_errors", "summary: ")),
    ]
    if expect_llm:
        tests += [(no("corrected_llm"), F.lit("correction without the model")), (no("summary_llm"), F.lit("summary without the model"))]
    if expect_quiz:
        tests.append((some("quiz_errors"), joined("quiz_errors", "quiz: ")))
        for kind in ("multiple_choice", "true_false", "short_answer"):
            n = F.coalesce(F.try_element_at("question_counts", F.lit(kind)), F.lit(0))
            tests.append((n != count, F.concat(F.lit(f"quiz: {kind} has "), n.cast("string"), F.lit(f" of {count} questions"))))
    found = F.array_compact(F.array(*[F.when(bad, said) for bad, said in tests]))
    return runs.select("stem", F.explode(found).alias("problem"))


def overlaps(spans: DataFrame, pieces: DataFrame, band: int = 64) -> DataFrame:
    """stem, id, piece of every pair with max(start) < min(end): spans (stem, id, start, end) and pieces alike.

    Both sides are filed under the bands they touch, which makes an equi-key; a pair counts in the band where its
    shared part begins. Empty spans meet nothing.
    """

    def filed(df, name):
        bands = F.sequence(F.floor(F.col("start") / band), F.floor((F.col("end") - 1) / band))
        return df.where(F.col("end") > F.col("start")).select("stem", F.col("id").alias(name), F.struct("start", "end").alias(f"{name}_at"), F.explode(bands).alias("band"))

    both = filed(spans, "id").join(filed(pieces, "piece"), ["stem", "band"])
    low, high = F.greatest("id_at.start", "piece_at.start"), F.least("id_at.end", "piece_at.end")
    return both.where((low < high) & (F.floor(low / band) == F.col("band"))).select("stem", "id", "piece", low.alias("start"), high.alias("end"))
