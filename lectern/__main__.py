"""Command line: python -m lectern COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from .operators import checks, correction, documents, errors, evaluate
from .sources import files, sinks

SETTING_SUFFIXES = {s: f"_{s}.txt" for s, _, _ in evaluate.SETTINGS}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lectern")
    sub = p.add_subparsers(dest="command", required=True)
    for name, methods in (("evaluate", evaluate.METHODS), ("ablation", tuple(SETTING_SUFFIXES))):
        c = sub.add_parser(name, help="error rates as CSV, JSON and Markdown" if name == "evaluate" else "rates by setting")
        c.add_argument("--ground-truth", required=True)
        for m in methods:
            c.add_argument(f"--{m.replace('_', '-')}", dest=m, metavar="FOLDER")
        c.add_argument("--stem", action="append")
        c.add_argument("--allow-missing", action="store_true")
        c.add_argument("--output", required=True)
    for name in ("correct", "summarize", "quiz"):
        c = sub.add_parser(name)
        c.add_argument("--input", required=True)
        c.add_argument("--suffix", default=".md" if name == "quiz" else ".txt")
        c.add_argument("--output", required=True)
        c.add_argument("--endpoint", help="chat endpoint; without it the rules alone")
        c.add_argument("--model", default="")
        if name != "quiz":
            c.add_argument("--evidence", metavar="FOLDER", help="recognition evidence, *_merged_ocr.json")
        if name == "quiz":
            c.add_argument("--question-count", type=int, default=5)
        if name != "correct":
            c.add_argument("--validate-existing", action="store_true", help="check the texts of the input folder again, without a call")
    c = sub.add_parser("check", help="what is wrong with the artifacts of a run; the exit code says whether anything is")
    c.add_argument("--root", required=True, help="folder of all stages")
    c.add_argument("--no-llm", action="store_true")
    c.add_argument("--no-quiz", action="store_true")
    c.add_argument("--question-count", type=int, default=5)
    c = sub.add_parser("resume", help="pages that lack expected artifacts")
    c.add_argument("--root", required=True)
    c.add_argument("--expect", nargs="+", default=["ocr_text", "corrected_text", "summary_md", "quiz_md"], choices=sorted(files.ARTIFACTS))
    return p


def run_state(spark: SparkSession, root: str, count: int) -> DataFrame:
    """stem and what ``checks.violations`` asks for, from the stage folders; pages are those with recognised text."""
    put = lambda k: f"{root.rstrip('/')}/{files.FOLDERS[k]}"
    texts = lambda k, suffix, name: files.texts(spark, put(k), suffix).select("stem", F.col("text").alias(name))
    used = lambda k, suffix, name: files.json_files(spark, put(k), "used_llm boolean", suffix).select("stem", F.col("doc.used_llm").alias(name))
    seen = files.evidence(spark, put("ensemble_dir")).select("stem", F.size("regions").alias("clean_region_count"))
    summary = texts("summary_dir", "_summary.md", "s").select("stem", documents.validate_summary(F.col("s")).alias("summary_errors"))
    parts = documents.normalize_quiz(F.col("q"), (*documents.QUESTIONS, *documents.ANSWERS))
    counts = F.map_from_arrays(F.array(*map(F.lit, ("multiple_choice", "true_false", "short_answer"))), F.array(*documents.question_counts(F.col("parts")).values()))
    quiz = texts("quiz_dir", "_quiz.md", "q").select("stem", documents.validate_quiz(F.col("q"), count).alias("quiz_errors"), parts.alias("parts")).select("stem", "quiz_errors", counts.alias("question_counts"))
    return files.run_view(texts("ensemble_dir", "_merged_ocr.txt", "ocr_text"), seen, texts("llm_dir", "_corrected.txt", "corrected_text"), used("llm_dir", "_corrected.json", "corrected_llm"), summary, used("summary_dir", "_summary.json", "summary_llm"), quiz)


def rates(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Writes facts and aggregates; returns the aggregates."""
    suffixes = SETTING_SUFFIXES if a.command == "ablation" else files.METHOD_SUFFIXES
    folders = {m: f for m in suffixes if (f := getattr(a, m))}
    truth, preds = files.ground_truth(spark, a.ground_truth, a.stem), files.predictions(spark, folders, suffixes)
    if not a.allow_missing:
        evaluate.check_complete(truth, preds, tuple(suffixes) if a.command == "ablation" else evaluate.REQUIRED)
    facts = evaluate.edit_statistics(truth, preds, split=True)
    sinks.write_facts(facts, f"{a.output}/per_document")
    out = evaluate.aggregate(facts)
    if a.command == "evaluate":
        out = evaluate.scaffolded(out)
        text = lambda m, name: preds.where(F.col("method") == m).select("stem", F.col("text").alias(name))
        rows = truth.withColumnRenamed("text", "reference").join(text("paddleocr_baseline", "raw"), "stem").join(text("ensemble_llm", "corrected"), "stem")
        found = errors.error_details(rows)
        sinks.write_json(found, f"{a.output}/errors")
        sinks.write_errors(errors.summarize(found).orderBy("ord"), f"{a.output}/error_analysis")
    if a.command == "ablation":
        out = evaluate.ablation(out, evaluate.settings(spark))
    sinks.write_json(out, f"{a.output}/aggregate")
    return out


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"lectern {a.command}").getOrCreate()
    if a.command in ("evaluate", "ablation"):
        out = rates(spark, a)
        print(sinks.report(out, evaluate.improvement(out, "paddleocr_baseline", "ensemble_llm") if a.command == "evaluate" else None))
        return
    if a.command == "check":
        wrong = checks.violations(run_state(spark, a.root, a.question_count), expect_llm=not a.no_llm, expect_quiz=not a.no_quiz, count=a.question_count).orderBy("stem", "problem")
        table = sinks.markdown_table(wrong)
        print(table)
        raise SystemExit(int(table.count("\n") > 2))
    if a.command == "resume":
        stems = files.texts(spark, f"{a.root}/{files.FOLDERS['ensemble_dir']}", "_merged_ocr.txt").select("stem")
        print(sinks.markdown_table(files.complete(stems, a.root, files.listing(spark, a.root), tuple(a.expect)).where("not done").select("stem", F.array_join("lacking", ", ").alias("lacking")).orderBy("stem")))
        return
    client = correction.http_client(a.endpoint, a.model) if a.endpoint else None
    pages = files.texts(spark, a.input, a.suffix).select("stem", "text")
    if getattr(a, "validate_existing", False):
        had = files.texts(spark, a.input, ".json").select("stem", F.col("text").alias("json"))
        said = documents.validate_summary if a.command == "summarize" else lambda t: documents.validate_quiz(t, a.question_count)
        sinks.revalidated(pages, had, said, "page_summary" if a.command == "summarize" else "page_quiz", a.command.replace("summarize", "summary")).write.mode("overwrite").parquet(a.output)
        return
    if a.command == "quiz":
        out = correction.quiz(pages.withColumnRenamed("text", "summary"), client, count=a.question_count)
    else:
        out = {"correct": correction.correct, "summarize": correction.summarize}[a.command](pages, client, evidence=files.evidence(spark, a.evidence) if a.evidence else None)
    sinks.write_json(out, a.output)


if __name__ == "__main__":
    main()
