"""Queries over paths, lookups and views of runs, with runs derived from the tables nation, part and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents
from ..sources import files, sinks
from .queries import query, table

_PATHS = """preprocess_dir|01_preprocessing baseline_dir|02_ocr/baseline ablation_dir|02_ocr/ablation ensemble_dir|02_ocr/ensemble llm_dir|03_llm_correction evaluation_dir|04_evaluation/@ summary_dir|05_summary quiz_dir|06_quiz
manifest|01_preprocessing/@_preprocess_manifest.json preprocessed|01_preprocessing/@_preprocessed_input.jpg baseline_text|02_ocr/baseline/@_paddleocr_baseline.txt baseline_json|02_ocr/baseline/@_paddleocr_baseline.json
ablation_document_text|02_ocr/ablation/@_document_rectification.txt ablation_document_json|02_ocr/ablation/@_document_rectification.json ablation_blue_ink_text|02_ocr/ablation/@_blue_ink_extraction.txt
ablation_blue_ink_json|02_ocr/ablation/@_blue_ink_extraction.json ablation_line_removal_text|02_ocr/ablation/@_line_removal.txt ablation_line_removal_json|02_ocr/ablation/@_line_removal.json
ocr_text|02_ocr/ensemble/@_merged_ocr.txt ocr_json|02_ocr/ensemble/@_merged_ocr.json corrected_text|03_llm_correction/@_corrected.txt corrected_json|03_llm_correction/@_corrected.json
rule_based_text|03_llm_correction/@_rule_based.txt rule_based_json|03_llm_correction/@_rule_based.json cer_json|04_evaluation/@/cer_report.json cer_csv|04_evaluation/@/cer_per_document.csv cer_md|04_evaluation/@/cer_report.md
error_analysis_csv|04_evaluation/@/error_analysis.csv ablation_json|04_evaluation/@/ablation_report.json ablation_csv|04_evaluation/@/ablation_report.csv ablation_md|04_evaluation/@/ablation_report.md
summary_md|05_summary/@_summary.md summary_json|05_summary/@_summary.json quiz_md|06_quiz/@_quiz.md quiz_json|06_quiz/@_quiz.json""".split()
_LIST = ", ".join(f"('{k}', '/out/{p}')" for k, p in (x.split("|") for x in _PATHS))


@query(f"SELECT n_name AS stem, key, replace(form, '@', n_name) AS path FROM nation CROSS JOIN (VALUES {_LIST}) t(key, form)")
def artifact_table(spark, sf_dir):
    paths = files.artifact_paths(F.col("stem"), "/out/")
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("stem"))
    return n.select("stem", F.explode(F.map_from_arrays(F.array(*map(F.lit, paths)), F.array(*paths.values()))).alias("key", "path"))


def _found(spark, sf_dir):
    """Files that exist, by part number: under the base, in two later places, or nowhere."""
    k = F.col("p_partkey")
    s = k.cast("string")
    there = F.when(k % 3 == 0, F.array(F.concat(F.lit("/b/pages/p"), s, F.lit(".jpg")), F.concat(F.lit("/d/p"), s, F.lit(".jpg")))).when(k % 3 == 1, F.array(F.concat(F.lit("/d/p"), s, F.lit(".jpg")), F.concat(F.lit("/o/02_ocr/ensemble/p"), s, F.lit(".jpg"))))
    return table(spark, sf_dir, "part").select(F.explode(there).alias("path"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '/b/pages/p' ELSE '/o/02_ocr/ensemble/p' END || CAST(p_partkey AS VARCHAR) || '.jpg' AS path FROM part WHERE p_partkey % 3 < 2")
def existing_paths(spark, sf_dir):
    value = F.concat(F.lit("pages\\p"), F.col("p_partkey").cast("string"), F.lit(".jpg"))
    rows = table(spark, sf_dir, "part").select("p_partkey", files.path_candidates(value, "/b", "/o", "/d").alias("c"))
    return files.first_existing(rows, ["p_partkey"], "c", _found(spark, sf_dir))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS stem, 'blue_gray' AS key, '藍筆灰階' AS label, CASE p_partkey % 3 WHEN 0 THEN '/b/pages/p' ELSE '/o/02_ocr/ensemble/p' END || CAST(p_partkey AS VARCHAR) || '.jpg' AS path FROM part WHERE p_partkey % 3 < 2
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'merged_ocr', 'OCR 框線', '/d/p' || CAST(p_partkey AS VARCHAR) || '.jpg' FROM part WHERE p_partkey % 3 < 2""")
def shown_variants(spark, sf_dir):
    """A known variant, an absolute path that is nowhere, an overlay that exists and one that is a variant already."""
    return _shown(spark, sf_dir)


def _shown(spark, sf_dir):
    s = F.col("p_partkey").cast("string")
    p = table(spark, sf_dir, "part").select(s.alias("stem"))
    m = p.select("stem", F.create_map(F.lit("blue_gray"), F.concat(F.lit("pages/p"), "stem", F.lit(".jpg")), F.lit("odd_one"), F.lit("/x/none.jpg")).alias("variants"))
    d = F.concat(F.lit("/d/p"), "stem", F.lit(".jpg"))
    o = p.select("stem", F.explode(F.array(F.struct(F.lit("merged_ocr").alias("key"), d.alias("path")), F.struct(F.lit("merged_ocr_review").alias("key"), F.lit("/no").alias("path")), F.struct(F.lit("blue_gray").alias("key"), d.alias("path")))).alias("x")).select("stem", "x.*")
    return files.processed_variants(m, o, _found(spark, sf_dir), "/b", "/o", "/d")


def _runs(spark, sf_dir):
    s = F.col("p_partkey").cast("string")
    even = F.col("p_partkey") % 2 == 0
    return table(spark, sf_dir, "part").select(s.alias("stem"), F.concat(F.lit("/o/05_summary/"), s, F.lit("_summary.md")).alias("summary_path"), F.when(even, F.concat(F.lit("/d/"), s, F.lit(".png"))).alias("original"), F.when(even, True).alias("used_llm"), F.when(even, F.col("p_brand")).alias("provider"), F.lit(None).cast("string").alias("model"))


@query("""WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS s, p_partkey % 2 = 0 AS even, p_partkey % 3 < 2 AS shown, CASE p_partkey % 3 WHEN 0 THEN '/b/pages/p' ELSE '/o/02_ocr/ensemble/p' END AS place, p_brand FROM part)
SELECT s AS stem, s AS display_name, s || '_summary.md' AS summary_name, even AS used_llm, CASE WHEN even THEN p_brand ELSE '' END AS provider, '' AS model, CASE WHEN even THEN s || '.png /media/' || s || '/original' END AS original,
 CASE WHEN shown THEN 'blue_gray=p' || s || '.jpg /media/' || s || '/blue_gray,merged_ocr=p' || s || '.jpg /media/' || s || '/merged_ocr' END AS variants, CASE WHEN shown THEN 'blue_gray' ELSE '' END AS default_processed_key FROM r""")
def run_payloads(spark, sf_dir):
    said = F.array_join(F.transform("processed_variants", lambda v: F.concat(v["key"], F.lit("="), v["name"], F.lit(" "), v["url"])), ",")
    r = files.public_runs(_runs(spark, sf_dir), _shown(spark, sf_dir))
    return r.select("stem", "display_name", "summary_name", "used_llm", "provider", "model", F.concat_ws(" ", "original.name", "original.url").alias("o"), said.alias("variants"), "default_processed_key").withColumn("original", F.nullif("o", F.lit(""))).drop("o")


@query("SELECT n_name AS stem, n_nationkey % 3 = 0 AS done, CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'quiz_md' ELSE 'quiz_md,summary_md' END AS lacking FROM nation")
def resume_states(spark, sf_dir):
    """Which pages have all expected artifacts, so that a resumed run skips them."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("stem"), F.col("n_nationkey").alias("k"))
    p = files.artifact_paths(F.col("stem"), "/out")
    found = n.select(F.explode(F.array_compact(F.array(p["ocr_text"], F.when(F.col("k") % 3 < 2, p["summary_md"]), F.when(F.col("k") % 3 == 0, p["quiz_md"])))).alias("path"))
    out = files.complete(n.select("stem"), "/out", found, ("ocr_text", "summary_md", "quiz_md"))
    return out.select("stem", "done", F.array_join("lacking", ",").alias("lacking"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN source END AS raw, CASE WHEN lang = 'en' THEN CAST(doc_id % 7 AS BIGINT) ELSE 0 END AS uncertain, CAST(doc_id AS VARCHAR) || '_corrected.json' AS document FROM documents")
def quality_chain(spark, sf_dir):
    """From a corrected text to its document, from there to the evidence that it names, and to the counts there."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    path = F.concat(F.lit("/e/"), F.col("doc_id").cast("string"), F.lit(".json"))
    corrections = d.select(F.col("doc_id").alias("stem"), F.when(F.col("lang") != "de", path).alias("evidence_path"))
    evidence = d.where("lang = 'en'").select(path.alias("path"), F.create_map(F.lit("raw_candidate_count"), F.col("source")).alias("statistics"), (F.col("doc_id") % 7).alias("uncertain"))
    q = files.quality_evidence(corrections, evidence)
    document = files.sibling(F.concat(F.lit("/a.b/"), F.col("stem").cast("string"), F.lit("_corrected.txt")))
    return q.select(F.col("stem").alias("doc_id"), F.col("statistics")["raw_candidate_count"].alias("raw"), "uncertain", F.regexp_extract(document, "([^/]*)$", 1).alias("document"))


@query("""SELECT doc_id, CASE WHEN lang = 'de' THEN NULL WHEN lang = 'en' THEN source END AS provider, md5(text) AS summary, 'page_summary' AS document_type, len(list_filter(['本頁主題', '重點摘要', '核心概念與定義', '見解比較', '判斷架構', '易混淆重點', '待核對原文'], lambda s: NOT contains(text, s))) AS missing, false AS obsolete FROM documents""")
def revalidated_summaries(spark, sf_dir):
    """Existing summaries checked again; their documents keep what is current and lose old keys; broken ones start anew."""
    d = table(spark, sf_dir, "documents").withColumn("stem", F.col("doc_id").cast("string"))
    had = d.where("lang <> 'fr'").select("stem", F.when(F.col("lang") == "de", "{broken").when(F.col("lang") == "en", F.to_json(F.struct(F.col("source").alias("provider"), F.lit("x").alias("quiz"), F.lit("old").alias("summary")))).otherwise("{}").alias("json"))
    out = sinks.revalidated(d.select("stem", "text"), had, documents.validate_summary, "page_summary", "summary")
    get = lambda k: F.get_json_object("json", f"$.{k}")
    missing = F.size(F.from_json(get("validation_errors"), "array<string>"))
    return out.select(F.col("stem").cast("long").alias("doc_id"), get("provider").alias("provider"), F.md5(get("summary")).alias("summary"), get("document_type").alias("document_type"), missing.cast("long").alias("missing"), get("quiz").isNotNull().alias("obsolete"))
