"""Scans of page images, transcriptions, manifests and evidence, keyed by file stem; artifact paths, lookups and run views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stem_of

# Image extensions, and the suffix of each method's text files.
IMAGE_SUFFIXES = ("bmp", "jpeg", "jpg", "png", "tif", "tiff", "webp")
METHOD_SUFFIXES = {"paddleocr_baseline": "_paddleocr_baseline.txt", "ensemble_only": "_merged_ocr.txt", "ensemble_llm": "_corrected.txt"}
MANIFEST = "input_path string, output_dir string, image_stem string, document_shape struct<height:int,width:int>, variants map<string,string>"
REGION = "struct<id:int,text:string,confidence:double,bbox:array<double>,source:string,alternatives:array<struct<text:string,confidence:double,bbox:array<double>,source:string>>>"
EVIDENCE = f"settings map<string,string>, statistics map<string,string>, clean_results array<{REGION}>, merged_results array<{REGION}>"


def images(spark: SparkSession, folder: str) -> DataFrame:
    """stem, path, content of the images directly in a folder; none is an error."""
    found = spark.read.format("binaryFile").load(folder).where(F.lower("path").rlike(rf"\.({'|'.join(IMAGE_SUFFIXES)})$"))
    if not found.select("path").limit(1).count():
        raise FileNotFoundError(f"no images in {folder}")
    return found.select(stem_of(F.col("path")).alias("stem"), "path", "length", "content").orderBy("path")


def texts(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """stem and whole text of files that end with ``suffix``; a byte order mark goes, bad bytes are replaced."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    body = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", "")
    return raw.select(F.expr(f"substr(regexp_extract(path, '([^/]*)$', 1), 1, length(regexp_extract(path, '([^/]*)$', 1)) - {len(suffix)})").alias("stem"), name.alias("name"), body.alias("text"))


def ground_truth(spark: SparkSession, folder: str, stems: list[str] | None = None) -> DataFrame:
    found = texts(spark, folder).select("stem", "text")
    return found.where(F.col("stem").isin(stems)) if stems else found


def predictions(spark: SparkSession, folders: dict[str, str], suffixes: dict[str, str] | None = None) -> DataFrame:
    """stem, method, text of every method's folder, in one union and without a loop over files."""
    out = None
    for method, folder in folders.items():
        one = texts(spark, folder, (suffixes or METHOD_SUFFIXES).get(method, ".txt")).select("stem", F.lit(method).alias("method"), "text")
        out = one if out is None else out.unionByName(one)
    return out


def json_files(spark: SparkSession, folder: str, schema: str, suffix: str = ".json", strict: bool = False) -> DataFrame:
    """stem and parsed document of each JSON file; unreadable ones are null unless ``strict``."""
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    return texts(spark, folder, suffix).select("stem", F.from_json("text", schema, mode).alias("doc"))


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    return json_files(spark, folder, MANIFEST, "_manifest.json").select("stem", "doc.*")


def variants(manifest: DataFrame, skip: tuple[str, ...] = ("blue_mask",)) -> DataFrame:
    return manifest.select("stem", F.explode("variants").alias("variant", "path")).where(~F.col("variant").isin(list(skip)))


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """stem, statistics, regions (clean results, or merged ones where there are none) and how many clean ones are uncertain."""
    d = json_files(spark, folder, EVIDENCE, "_merged_ocr.json")
    clean = F.col("doc.clean_results")
    unsure = lambda r: (F.coalesce(r["confidence"], F.lit(0.0)) < 0.65) | (F.coalesce(F.size(r["alternatives"]), F.lit(0)) > 1)
    uncertain = F.size(F.filter(F.coalesce(clean, F.array()), unsure))
    return d.select("stem", "doc.statistics", F.when(F.size(clean) > 0, clean).otherwise(F.col("doc.merged_results")).alias("regions"), uncertain.alias("uncertain"))


def preferred(corrected: DataFrame, raw: DataFrame) -> DataFrame:
    """Corrected text of a stem, else its recognised text."""
    both = raw.withColumnRenamed("text", "_raw").join(corrected, "stem", "full")
    return both.select("stem", F.coalesce("text", "_raw").alias("text"))


# Folders of the stages, and each artifact's folder and name around a page's stem.
FOLDERS = {
    "preprocess_dir": "01_preprocessing", "baseline_dir": "02_ocr/baseline", "ablation_dir": "02_ocr/ablation", "ensemble_dir": "02_ocr/ensemble",
    "llm_dir": "03_llm_correction", "evaluation_dir": "04_evaluation/{stem}", "summary_dir": "05_summary", "quiz_dir": "06_quiz",
}
ARTIFACTS = {
    "manifest": ("preprocess_dir", "{stem}_preprocess_manifest.json"), "preprocessed": ("preprocess_dir", "{stem}_preprocessed_input.jpg"),
    "cer_json": ("evaluation_dir", "cer_report.json"), "cer_csv": ("evaluation_dir", "cer_per_document.csv"), "cer_md": ("evaluation_dir", "cer_report.md"), "error_analysis_csv": ("evaluation_dir", "error_analysis.csv"),
    **{f"ablation_{k}": ("evaluation_dir", f"ablation_report.{k}") for k in ("json", "csv", "md")},
    **{f"{name}_{k}": (folder, f"{{stem}}_{file}.{'txt' if k == 'text' else k}") for name, folder, file, kinds in (
        ("baseline", "baseline_dir", "paddleocr_baseline", ("text", "json")), ("ablation_document", "ablation_dir", "document_rectification", ("text", "json")),
        ("ablation_blue_ink", "ablation_dir", "blue_ink_extraction", ("text", "json")), ("ablation_line_removal", "ablation_dir", "line_removal", ("text", "json")),
        ("ocr", "ensemble_dir", "merged_ocr", ("text", "json")), ("corrected", "llm_dir", "corrected", ("text", "json")), ("rule_based", "llm_dir", "rule_based", ("text", "json")),
        ("summary", "summary_dir", "summary", ("md", "json")), ("quiz", "quiz_dir", "quiz", ("md", "json")),
    ) for k in kinds},
}
# Names of the processed variants, and the order in which one is shown first.
LABELS = {
    "document": "文件校正", "enhanced": "光照增強", "sharpened": "銳化", "line_removed": "移除橫線", "clean_document": "乾淨文件", "blue_ink": "藍色筆跡",
    "blue_gray": "藍筆灰階", "blue_binary": "藍筆二值化", "blue_mask": "藍色遮罩", "binary": "二值化 OCR", "merged_ocr": "OCR 框線", "merged_ocr_review": "OCR 候選框線",
}
SHOWN_FIRST = ("binary", "clean_document", "line_removed", "sharpened", "enhanced", "document", "blue_ink", "blue_gray")


def artifact_paths(stem: Column, root: str) -> dict[str, Column]:
    """Folder and file of every artifact of a page, as columns of its stem."""

    def put(form: str) -> Column:
        first, _, rest = form.partition("{stem}")
        return F.concat(F.lit(f"{root.rstrip('/')}/{first}"), stem, F.lit(rest)) if "{stem}" in form else F.lit(f"{root.rstrip('/')}/{form}")

    def file(folder: str, form: str) -> Column:
        return F.concat(put(FOLDERS[folder]), F.lit("/"), *([stem, F.lit(form.removeprefix("{stem}"))] if form.startswith("{stem}") else [F.lit(form)]))

    return {k: put(f) for k, f in FOLDERS.items()} | {k: file(*x) for k, x in ARTIFACTS.items()}


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all files below a folder, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))


def sibling(path: Column, suffix: str = ".json") -> Column:
    """The file of the same name with another extension."""
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit(suffix))


def path_candidates(value: Column, base: str, output: str, dataset: str) -> Column:
    """Where a recorded path may be found now, in order; absolute ones only where they say."""
    raw = F.replace(value, F.lit("\\"), F.lit("/"))
    name = F.regexp_extract(raw, "([^/]*)$", 1)
    stages = [f"{output}/{f}" for f in FOLDERS.values() if "{stem}" not in f]
    near = F.array(F.concat(F.lit(f"{base}/"), raw), F.concat(F.lit(f"{output}/"), raw), *[F.concat(F.lit(f"{d}/"), name) for d in (*stages, dataset, base)])
    return F.when(F.coalesce(raw, F.lit("")) == "", F.array().cast("array<string>")).when(F.startswith(raw, F.lit("/")), F.array(raw)).otherwise(near)


def first_existing(rows: DataFrame, key: list[str], candidates: str, found: DataFrame) -> DataFrame:
    """``key`` and path: of the array ``candidates`` the first one among the found paths; rows without one are absent.

    Paths are merged, never broadcast: sizes are guessed from what arrays come from, and all paths would go through the driver.
    """
    each = rows.select(*key, F.posexplode(candidates).alias("_ord", "path"))
    return each.join(found.select("path").distinct().hint("merge"), "path").groupBy(*key).agg(F.min_by("path", "_ord").alias("path"))


def processed_variants(manifest: DataFrame, overlays: DataFrame, found: DataFrame, base: str, output: str, dataset: str) -> DataFrame:
    """stem, key, label, path of a page's variants that exist, and of overlays (stem, key, path) that are no variant already."""
    named = variants(manifest, ()).select("stem", F.col("variant").alias("key"), path_candidates(F.col("path"), base, output, dataset).alias("c"))
    own = first_existing(named, ["stem", "key"], "c", found)
    more = overlays.join(found.select("path").distinct().hint("merge"), "path").join(own.hint("merge"), ["stem", "key"], "left_anti")
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return own.unionByName(more.select("stem", "key", "path")).withColumn("label", F.coalesce(F.try_element_at(labels, F.col("key")), F.replace("key", F.lit("_"), F.lit(" "))))


def complete(stems: DataFrame, root: str, found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """stem, done, lacking: whether all expected artifacts of a page exist, so that a resumed run skips it, and which do not."""
    paths = artifact_paths(F.col("stem"), root)
    asked = stems.select("stem", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), paths[k].alias("path")) for k in keys])).alias("x")).select("stem", "x.*")
    seen = asked.join(found.select("path", F.lit(True).alias("there")).distinct().hint("merge"), "path", "left")
    return seen.groupBy("stem").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("done"), F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("key")))).alias("lacking"))


def quality_evidence(corrections: DataFrame, evidence: DataFrame) -> DataFrame:
    """stem, statistics, uncertain of each correction (stem, evidence_path) by the evidence (path, statistics, uncertain) it names; unknown where there is none."""
    met = corrections.join(evidence, corrections["evidence_path"] == evidence["path"], "left")
    return met.select("stem", "statistics", F.coalesce("uncertain", F.lit(0)).alias("uncertain"))


def run_view(summaries: DataFrame, *parts: DataFrame) -> DataFrame:
    """Summaries with whatever other documents their stems have."""
    for p in parts:
        summaries = summaries.join(p, "stem", "left")
    return summaries


def public_runs(runs: DataFrame, shown: DataFrame) -> DataFrame:
    """What a viewer may see of each run: names and addresses instead of paths.

    ``runs``: stem, summary_path, original (path or null), used_llm, provider, model; ``shown``: stem, key, label, path.
    """
    name = lambda p: F.regexp_extract(p, r"([^/\\]*)$", 1)
    url = lambda k: F.concat(F.lit("/media/"), F.col("stem"), F.lit("/"), k)
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SHOWN_FIRST)), F.col("key")), F.lit(0)), F.lit(len(SHOWN_FIRST) + 1))
    v = shown.withColumn("rank", rank).groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("key", "label", name(F.col("path")).alias("name"), url(F.col("key")).alias("url")))).alias("processed_variants"), F.min_by("key", F.struct("rank", "key")).alias("default_processed_key"))
    original = F.when(F.col("original").isNotNull(), F.struct(F.lit("original").alias("key"), name(F.col("original")).alias("name"), url(F.lit("original")).alias("url")))
    out = runs.join(v, "stem", "left")
    return out.select("stem", F.replace("stem", F.lit("_"), F.lit(" ")).alias("display_name"), name(F.col("summary_path")).alias("summary_name"), F.coalesce("used_llm", F.lit(False)).alias("used_llm"), F.coalesce("provider", F.lit("")).alias("provider"), F.coalesce("model", F.lit("")).alias("model"), original.alias("original"), "processed_variants", F.coalesce("default_processed_key", F.lit("")).alias("default_processed_key"))


def media(shown: DataFrame, runs: DataFrame, stem: str, key: str) -> DataFrame:
    """path of one run's original or variant."""
    own = runs.where(F.col("stem") == stem).select(F.lit("original").alias("key"), F.col("original").alias("path"))
    return own.unionByName(shown.where(F.col("stem") == stem).select("key", "path")).where((F.col("key") == key) & F.col("path").isNotNull()).select("path")


def is_local(url: str) -> bool:
    """Whether an endpoint is on this machine and needs no key."""
    return any(host in url for host in ("localhost", "127.0.0.1", "0.0.0.0", "::1"))


def installed_models(listed: dict) -> list[str]:
    """Names in a model server's list; the caller fetches it."""
    return sorted({n for x in listed.get("models", []) if (n := x.get("name") or x.get("model"))})


def check_model(model: str, listed: dict) -> None:
    if model not in (names := installed_models(listed)):
        raise RuntimeError(f"model {model!r} is not installed; there are: {', '.join(names) or 'none'}")


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """stem, height, width, channels and raw pixels (blue, green, red) of images, decoded by Spark's own source; undecodable ones are an error."""
    found = spark.read.format("image").option("dropInvalid", "false").load(folder)
    known = F.when(F.col("image.height") > 0, F.col("image.height")).otherwise(F.raise_error(F.concat(F.lit("no image: "), F.col("image.origin"))).cast("int"))
    return found.select(stem_of(F.col("image.origin")).alias("stem"), known.alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
