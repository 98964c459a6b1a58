"""Queries over the driver's tables for the operators, each beside the SQL that gives the same rows.

There are no recognition tables, so inputs are derived: every document, whole, is a reference and edits of it
predictions; events are candidate boxes (page = user), parts give image sizes. Predictions are made by one kind
of edit each, so that SQL knows their distance without an alignment: where one text is a subsequence of the
other it is the difference of the lengths, and where characters are replaced by ones that the rest does not
trade for others, their number (no alignment can have fewer, as so many characters are in surplus). The
queries align all the same. Predictions are written in decomposed form, which normalisation has to undo.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics, text
from ..operators import checks, documents, errors, evaluate, fusion

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, uncut; in many parts, as one file would else be one task."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("doc_id").cast("string").alias("stem"), "text")
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return d.repartition(n, "stem")


#: Accented letters of the documents' languages, for texts in decomposed form.
ACCENTED = "àâäçèéêëîïíñóôöùúûüÀÂÄÇÈÉÊËÎÏÍÑÓÔÖÙÚÛÜ"


def plain(t):
    """Whether a text is ASCII: it has no marks, so that its letters can be edited as they are."""
    return F.octet_length(t) == F.length(t)


def decomposed(t):
    out = t
    for c in ACCENTED:
        out = F.replace(out, F.lit(c), F.lit(unicodedata.normalize("NFD", c)))
    return F.when(plain(t), t).otherwise(out)


def swapped(t, letter, other):
    """Another letter in place of one that has no mark: an edit of decomposed text, which is decomposed once for all edits."""
    return F.regexp_replace(t, f"{letter}(?![\u0300-\u036f])", other)


def predictions(s: DataFrame) -> DataFrame:
    t, apart = F.col("text"), F.col("_apart")
    lost = F.when(plain(t), F.replace(t, F.lit("e"), F.lit(""))).otherwise(swapped(apart, "e", ""))
    read = F.when(plain(t), F.replace(F.replace(t, F.lit("a"), F.lit("@")), F.lit("o"), F.lit("0"))).otherwise(swapped(swapped(apart, "a", "@"), "o", "0"))
    made = F.array(
        F.struct(F.lit("paddleocr_baseline").alias("method"), lost.alias("text")),
        F.when(F.contains(t, F.lit("th")), F.struct(F.lit("ensemble_only").alias("method"), read.alias("text"))),
        F.struct(F.lit("ensemble_llm").alias("method"), F.concat(t, F.lit(" end")).alias("text")),
    )
    keep = [c for c in s.columns if c != "text"]
    return s.withColumn("_apart", decomposed(t)).select(*keep, F.explode(F.array_compact(made)).alias("m")).select(*keep, "m.*")


_W = r"[\t-\r\x1c-\x20\x{85}\pZ]"
_S = r"""s AS (SELECT doc_id, lang, source, CAST(doc_id AS VARCHAR) AS stem, nfc_normalize(text) AS text FROM documents),
p AS (SELECT *, 'paddleocr_baseline' AS method, replace(text, 'e', '') AS hyp, '' AS traded FROM s
 UNION ALL SELECT *, 'ensemble_only', translate(text, 'ao', '@0'), 'ao' FROM s WHERE contains(text, 'th')
 UNION ALL SELECT *, 'ensemble_llm', text || ' end', '' FROM s),
u AS (SELECT doc_id, lang, source, stem, method, traded, regexp_replace(text, '\r\n?', chr(10), 'g') AS r, regexp_replace(hyp, '\r\n?', chr(10), 'g') AS h FROM p),
n AS (SELECT doc_id, lang, source, stem, method, traded, 'strict' AS profile, regexp_replace(r, '^WS+|WS+$', '', 'g') AS r, regexp_replace(h, '^WS+|WS+$', '', 'g') AS h FROM u
 UNION ALL SELECT doc_id, lang, source, stem, method, traded, 'no_whitespace', regexp_replace(r, 'WS+', '', 'g'), regexp_replace(h, 'WS+', '', 'g') FROM u),
f AS (SELECT *, length(r) AS rc, length(h) AS hc, length(r) - length(translate(r, traded, '')) AS subs, greatest(length(r) - length(h), 0) AS dels, greatest(length(h) - length(r), 0) AS ins, subs + dels + ins AS e FROM n),
g AS (SELECT *, CASE WHEN rc > 0 THEN e / rc::DOUBLE WHEN hc = 0 THEN 0 ELSE 'inf'::DOUBLE END AS cer, greatest(0::DOUBLE, 1 - cer) AS acc FROM f)""".replace("WS", _W)
_A = """a AS (SELECT profile, method, count(*) AS document_count, CAST(sum(rc) AS BIGINT) AS reference_characters, CAST(sum(hc) AS BIGINT) AS hypothesis_characters, CAST(sum(e) AS BIGINT) AS edits,
 CAST(sum(subs) AS BIGINT) AS substitutions, CAST(sum(dels) AS BIGINT) AS deletions, CAST(sum(ins) AS BIGINT) AS insertions,
 avg(cer) AS macro_cer, avg(acc) AS macro_character_accuracy, sum(e)::DOUBLE / sum(rc) AS micro_cer, greatest(0::DOUBLE, 1 - sum(e)::DOUBLE / sum(rc)) AS micro_character_accuracy FROM g GROUP BY ALL)"""


def _facts(spark, sf_dir, **options):
    s = whole(spark, sf_dir).select("stem", "text")
    return evaluate.edit_statistics(s, predictions(s), **options)


#: Means of doubles depend on the order of summation; whole millionths of them do not.
_MICRO = ("macro_cer", "macro_character_accuracy", "micro_cer", "micro_character_accuracy")


def _millionths(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) * 1e6).cast("long") for n in names})


def _sql_millionths(*names: str) -> str:
    return ", ".join(f"CAST(round({n} * 1e6) AS BIGINT) AS {n}" for n in names)


@query(f"WITH {_S}, {_A} SELECT profile, method, document_count, reference_characters, hypothesis_characters, edits, {_sql_millionths(*_MICRO)} FROM a")
def cer_micro_macro(spark, sf_dir):
    return _millionths(evaluate.aggregate(_facts(spark, sf_dir)), *_MICRO)


@query(f"WITH {_S} SELECT stem, profile, method, CAST(rc AS INT) AS reference_characters, CAST(hc AS INT) AS hypothesis_characters, CAST(e AS INT) AS edits, {_sql_millionths('cer', 'acc').replace('AS acc', 'AS character_accuracy')} FROM g")
def cer_per_document(spark, sf_dir):
    f = _millionths(_facts(spark, sf_dir), "cer", "character_accuracy")
    return f.select("stem", "profile", "method", "reference_characters", "hypothesis_characters", "edits", "cer", "character_accuracy")


@query(f"WITH {_S} SELECT lang, source, method, count(*) AS document_count, CAST(sum(e) AS BIGINT) AS edits, CAST(sum(rc) AS BIGINT) AS reference_characters FROM g WHERE profile = 'no_whitespace' GROUP BY ALL")
def cer_by_lang_source(spark, sf_dir):
    f = _facts(spark, sf_dir).where("profile = 'no_whitespace'")
    named = f.join(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stem"), "lang", "source"), "stem")
    return named.groupBy("lang", "source", "method").agg(F.count("*").alias("document_count"), F.sum("edits").alias("edits"), F.sum("reference_characters").alias("reference_characters"))


@query(f"""WITH {_S}, {_A}, i AS (SELECT profile, max(micro_cer) FILTER (method = 'paddleocr_baseline') AS base_cer, max(micro_cer) FILTER (method = 'ensemble_llm') AS proposed_cer FROM a GROUP BY profile)
SELECT profile, {_sql_millionths('base_cer', 'proposed_cer')}, CAST(round((base_cer - proposed_cer) * 1e6) AS BIGINT) AS absolute_reduction, CAST(round((base_cer - proposed_cer) / nullif(base_cer, 0) * 1e6) AS BIGINT) AS relative_reduction FROM i""")
def improvement(spark, sf_dir):
    out = evaluate.improvement(evaluate.aggregate(_facts(spark, sf_dir)), "paddleocr_baseline", "ensemble_llm")
    return _millionths(out, "base_cer", "proposed_cer", "absolute_reduction", "relative_reduction")


# each prediction: its setting, the edit of decomposed text, the same in SQL on composed text, and the characters it trades for others
_EDITS = (
    ("raw_paddleocr", lambda t: swapped(t, "e", ""), "replace(text, 'e', '')", ""),
    ("document_rectification", lambda t: F.replace(t, F.lit("th"), F.lit("h")), "replace(text, 'th', 'h')", ""),
    ("blue_ink_extraction", lambda t: swapped(t, "n", "m"), "replace(text, 'n', 'm')", "n"),
    ("line_removal", lambda t: swapped(swapped(t, "a", "@"), "o", "0"), "translate(text, 'ao', '@0')", "ao"),
    ("multi_variant_ensemble", lambda t: swapped(t, "i", ""), "replace(text, 'i', '')", ""),
    ("rule_based_normalization", lambda t: F.replace(t, F.lit(","), F.lit("")), "replace(text, ',', '')", ""),
    ("llm_correction", lambda t: t, "text", ""),
)
_B = _S.split("p AS (")[0] + "p AS (" + " UNION ALL ".join(f"SELECT *, '{n}' AS method, {q} AS hyp, '{c}' AS traded FROM s" for n, _, q, c in _EDITS) + "),\n" + "u AS (" + _S.split("u AS (")[1]
_PARENTS = ", ".join(f"('{a}', {'NULL' if b is None else repr(b)})" for a, b, _ in evaluate.SETTINGS)


@query(f"""WITH {_B}, {_A}, d(setting_id, parent_id) AS (VALUES {_PARENTS})
SELECT c.profile, d.setting_id, d.parent_id, c.document_count, c.reference_characters, c.edits, CAST(round(c.micro_cer * 1e6) AS BIGINT) AS cer, CAST(round(c.micro_character_accuracy * 1e6) AS BIGINT) AS character_accuracy,
 CAST(round((c.micro_cer - b.micro_cer) * 1e6) AS BIGINT) AS delta_cer_vs_baseline, CAST(round((c.micro_cer - p.micro_cer) * 1e6) AS BIGINT) AS delta_cer_vs_parent
FROM a c JOIN d ON d.setting_id = c.method LEFT JOIN a p ON p.method = d.parent_id AND p.profile = c.profile LEFT JOIN a b ON b.method = 'raw_paddleocr' AND b.profile = c.profile""")
def ablation_deltas(spark, sf_dir):
    s = whole(spark, sf_dir).select("stem", "text")
    made = F.array(*[F.struct(F.lit(n).alias("method"), f(F.col("text")).alias("text")) for n, f, _, _ in _EDITS])
    p = s.select("stem", decomposed(F.col("text")).alias("text")).select("stem", F.explode(made).alias("m")).select("stem", "m.*")
    out = evaluate.ablation(evaluate.aggregate(evaluate.edit_statistics(s, p)), evaluate.settings(spark))
    return _millionths(out, "cer", "character_accuracy", "delta_cer_vs_baseline", "delta_cer_vs_parent")


@query(f"WITH {_S} SELECT s.stem, m.method FROM s CROSS JOIN (VALUES ('paddleocr_baseline'), ('ensemble_only'), ('ensemble_llm')) m(method) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.stem = s.stem AND p.method = m.method)")
def missing_predictions(spark, sf_dir):
    s = whole(spark, sf_dir).select("stem", "text")
    return evaluate.missing(s, predictions(s))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def stem_filter(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return evaluate.keep_stems(table(spark, sf_dir, "documents").select("doc_id", "lang"), good)


_NOISE = r"""regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', '\n', 'g'), '[\x{feff}\x{200b}]', '', 'g')"""
_NOISE = f"regexp_replace({_NOISE}, '[\\t\\x0b\\x0c\\r \\x1c-\\x1f\\x{{85}}\\pZ]+', ' ', 'g')"
_NOISE = f"regexp_replace({_NOISE}, ' *\\n *', '\\n', 'g')".replace("'\\n', 'g')", "chr(10), 'g')")
_NOISE = f"regexp_replace({_NOISE}, ' *([{text.PUNCTUATION}]) *', '\\1', 'g')"
_NOISE = f"regexp_replace({_NOISE}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
for _w, _r in text.REPLACEMENTS:
    _NOISE = f"replace({_NOISE}, '{_w}', '{_r}')"
_NOISE = f"regexp_replace({_NOISE}, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')"


@query(f"SELECT doc_id, md5(t) AS digest, length(t) AS n FROM (SELECT doc_id, {_NOISE} AS t FROM documents)")
def normalize_noise(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", text.normalize_noise(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[\s\pZ]|[，。；：、,.!?！？()（）]', '', 'g')) AS digest FROM documents")
def candidate_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.candidate_key(F.col("text"))).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')) AS digest FROM documents")
def strip_artifacts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    wrapped = F.concat(F.lit("<think>a\n"), F.substring("text", 1, 5), F.lit("</think> "), F.col("text"), F.lit("<|channel>thought x\ny<channel|>"))
    return d.select("doc_id", F.md5(text.strip_artifacts(wrapped)).alias("digest"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')) AS digest FROM documents")
def strip_fences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.strip_fences(F.concat(F.lit(" ```Markdown \n"), "text", F.lit("\n```\n")))).alias("digest"))


@query("SELECT doc_id, contains(source, '1') AS noisy FROM documents")
def mojibake_flag(spark, sf_dir):
    t = F.concat("text", F.when(F.contains("source", F.lit("1")), "�").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.has_mojibake(t).alias("noisy"))


_ITEMS = r"regexp_replace(text, '(^|\n)([A-M])', '\1- **Q1.** \2', 'g')"


@query(rf"SELECT doc_id, len(regexp_extract_all({_ITEMS}, '(?m)^\s*(?:[-*]\s*)?(?:\*\*)?(?:Q\s*)?\d+\s*(?:[.、)]|\*\*[.、)]?)\s*')) AS items FROM documents")
def numbered_items(spark, sf_dir):
    t = F.regexp_replace("text", r"(^|\n)([A-M])", "$1- **Q1.** $2")
    return table(spark, sf_dir, "documents").select("doc_id", text.count_numbered(t).cast("long").alias("items"))


_MD = "'# t' || chr(10) || '## 本頁主題' || chr(10) || text || chr(10) || '## 重點摘要' || chr(10) || CASE lang WHEN 'en' THEN '## Quiz 題庫' WHEN 'de' THEN '```' ELSE '## 判斷架構' END"


@query(f"""WITH m AS (SELECT doc_id, {_MD} AS t FROM documents)
SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN NOT regexp_matches(t, '(?m)^##\\s+{s}\\s*$') THEN '缺少摘要章節：{s}' END" for s in documents.SUMMARY_SECTIONS)},
 {', '.join(f"CASE WHEN contains(t, '{x}') THEN '摘要不應包含：{x.lstrip('# ')}' END" for x in documents.FORBIDDEN)}, CASE WHEN contains(t, '```') THEN '摘要含 Markdown code fence' END) AS errors FROM m""")
def required_sections(spark, sf_dir):
    tail = F.when(F.col("lang") == "en", "## Quiz 題庫").when(F.col("lang") == "de", "```").otherwise("## 判斷架構")
    t = F.concat(F.lit("# t\n## 本頁主題\n"), "text", F.lit("\n## 重點摘要\n"), tail)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(documents.validate_summary(t), ",").alias("errors"))


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x, i: x <> '' OR i < len(string_split(text, chr(10)))) AS a FROM documents),
w AS (SELECT doc_id, 1 AS k, 1 AS c, length(a[1]) + 1 AS n, a FROM l WHERE len(a) > 0
 UNION ALL SELECT doc_id, k + 1, CASE WHEN n + length(a[k + 1]) + 1 > 1000 THEN c + 1 ELSE c END, CASE WHEN n + length(a[k + 1]) + 1 > 1000 THEN length(a[k + 1]) + 1 ELSE n + length(a[k + 1]) + 1 END, a FROM w WHERE k < len(a))
SELECT doc_id, c AS chunk, max(n) - 1 AS n FROM w GROUP BY ALL""")
def chunk_pack(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(documents.chunks(F.col("text"))).alias("k", "t"))
    return c.select("doc_id", (F.col("k") + 1).alias("chunk"), F.length("t").cast("long").alias("n"))


@query(r"""WITH l AS (SELECT doc_id, unnest(a) AS x, unnest(range(len(a))) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '(^|\n)(T)', '\1## \2', 'g'), chr(10)) AS a FROM documents)),
h AS (SELECT *, regexp_extract(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^##\s+(.+?)\s*$', 1) AS t FROM l),
g AS (SELECT *, sum(CASE WHEN t <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM h)
SELECT doc_id, 'section-' || CAST(s AS VARCHAR) AS key, max(t) AS title, CAST(length(regexp_replace(string_agg(x, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g')) AS BIGINT) AS n FROM g WHERE s > 0 GROUP BY doc_id, s
UNION ALL SELECT doc_id, 'section-1', '完整摘要', CAST(length(regexp_replace(max(d.text), '^\s+|\s+$', '', 'g')) AS BIGINT) FROM g JOIN documents d USING (doc_id) GROUP BY doc_id HAVING max(s) = 0""")
def section_split(spark, sf_dir):
    t = F.regexp_replace("text", r"(^|\n)(T)", "$1## $2")
    c = table(spark, sf_dir, "documents").select("doc_id", F.explode(documents.level_two_sections(t)).alias("s"))
    return c.select("doc_id", "s.key", "s.title", F.length("s.markdown").cast("long").alias("n"))


def _images(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (200 + F.col("p_size") * 37).alias("width"), (300 + F.col("p_size") * 53).alias("height"))


_D = "i AS (SELECT p_partkey, 200 + p_size * 37 AS width, 300 + p_size * 53 AS height FROM part)"


def _offsets_sql(side: str, tile: int, overlap: int) -> str:
    t = f"least({tile}, {side})"
    return f"list_distinct(list_concat(range(0, greatest({side} - {t}, 0) + 1, greatest(1, {t} - {overlap})), [greatest({side} - {t}, 0)]))"


@query(f"WITH {_D} SELECT p_partkey, CAST(unnest({_offsets_sql('height', 520, 200)}) AS INT) AS y FROM i")
def tile_offsets(spark, sf_dir):
    return _images(spark, sf_dir).select("p_partkey", F.explode(fusion.offsets(F.col("height"), F.lit(520), F.lit(200))).alias("y"))


@query(f"WITH {_D}, y AS (SELECT p_partkey, width, CAST(unnest({_offsets_sql('height', 520, 180)}) AS INT) AS y FROM i) SELECT p_partkey, y, CAST(unnest({_offsets_sql('width', 900, 180)}) AS INT) AS x FROM y")
def grid_tiles(spark, sf_dir):
    return fusion.grid_tiles(_images(spark, sf_dir), 900, 180, 520, 180).select("p_partkey", "y", "x")


def boxes(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    x1, y1 = (e * 13 % 400).cast("double"), (e * 29 % 900).cast("double")
    names = F.array(*map(F.lit, ("document_full", "blue_gray_full", "blue_gray_grid_1", "blue_gray_tile_1", "binary_full")))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stem"), e.alias("id"), e.alias("ord"), F.col("event_type").alias("text"), ((e * 37 % 100).cast("double") / 100).alias("confidence"),
        x1.alias("x1"), y1.alias("y1"), (x1 + 60 + e * 7 % 200).alias("x2"), (y1 + 20 + e * 3 % 30).alias("y2"), F.get(names, (e % 5).cast("int")).alias("source"),
    )


_E = """e AS (SELECT user_id AS stem, event_id AS id, event_type AS text, CAST(event_id * 37 % 100 AS DOUBLE) / 100 AS confidence, CAST(event_id * 13 % 400 AS DOUBLE) AS x1, CAST(event_id * 29 % 900 AS DOUBLE) AS y1,
 CAST(event_id * 13 % 400 + 60 + event_id * 7 % 200 AS DOUBLE) AS x2, CAST(event_id * 29 % 900 + 20 + event_id * 3 % 30 AS DOUBLE) AS y2,
 ['document_full', 'blue_gray_full', 'blue_gray_grid_1', 'blue_gray_tile_1', 'binary_full'][event_id % 5 + 1] AS source FROM events)"""
_Q = "CASE event_id_mod WHEN 0 THEN 0.09 WHEN 1 THEN 0.10 WHEN 2 THEN 0.11 WHEN 3 THEN 0.08 ELSE 0.03 END".replace("event_id_mod", "id % 5")


@query(f"WITH {_E} SELECT id, CAST(round((confidence + least(length(replace(text, ' ', '')), 100) * 0.002::DOUBLE + ({_Q})::DOUBLE) * 1e6) AS BIGINT) AS quality FROM e")
def candidate_quality(spark, sf_dir):
    return boxes(spark, sf_dir).select("id", F.round(fusion.quality() * 1e6).cast("long").alias("quality"))


@query(f"""WITH {_E} SELECT id, round(x1 + id % 3 * 100, 2) AS x1, round(y1 + id % 2 * 300, 2) AS y1, confidence FROM e WHERE confidence >= 0.25
 AND NOT (y1 <= 6 AND id % 2 * 300 > 0 OR y2 >= 900 - 6 AND id % 2 * 300 + 900 < 1200) AND NOT (x1 <= 6 AND id % 3 * 100 > 0 OR x2 >= 500 - 6 AND id % 3 * 100 + 500 < 700)""")
def edge_filter(spark, sf_dir):
    b = boxes(spark, sf_dir)
    one = lambda c: F.array(F.col(c))
    results = b.select(
        "stem", "id", "source", one("text").alias("rec_texts"), one("confidence").alias("rec_scores"), F.array(F.array("x1", "y1", "x2", "y2")).alias("rec_boxes"),
        (F.col("id") % 3 * 100).alias("x_offset"), (F.col("id") % 2 * 300).alias("y_offset"), F.lit(500).alias("tile_width"), F.lit(900).alias("tile_height"), F.lit(700).alias("image_width"), F.lit(1200).alias("image_height"), F.col("id").alias("pass_ord"),
    )
    return fusion.candidate_rows(results).select(F.col("pass_ord").alias("id"), "x1", "y1", "confidence")


@query(f"""WITH {_E} SELECT a.stem, a.id AS a_id, b.id AS b_id FROM e a JOIN e b ON a.stem = b.stem AND a.id < b.id
WHERE least(a.x2 - a.x1, b.x2 - b.x1) / greatest(1, greatest(a.x2 - a.x1, b.x2 - b.x1)) >= 0.42 AND greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / greatest(1, least(a.x2 - a.x1, b.x2 - b.x1)) >= 0.5
 AND abs((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) <= greatest(28, least(a.y2 - a.y1, b.y2 - b.y1) * 0.5)""")
def region_pairs(spark, sf_dir):
    return fusion.region_pairs(boxes(spark, sf_dir))


@query(f"WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY stem, text ORDER BY confidence DESC, id) AS k FROM e) SELECT stem, text, id, confidence FROM r WHERE k = 1")
def region_dedup(spark, sf_dir):
    return fusion.best_by_text(boxes(spark, sf_dir), ("stem",), "id").select("stem", "text", "id", "confidence")


@query(f"WITH {_E} SELECT stem, id, row_number() OVER (PARTITION BY stem ORDER BY (y1 + y2) / 2, x1, id) AS position FROM e")
def reading_order(spark, sf_dir):
    rows = fusion.in_reading_order(boxes(spark, sf_dir), F.col("y1"), F.col("y2"), F.col("x1"), "id", "position")
    return rows.select("stem", "id", F.col("position").cast("long").alias("position"))


@query(f"WITH {_E} SELECT stem, source, CASE WHEN confidence >= 0.65 THEN 'high' WHEN confidence >= 0.40 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM e GROUP BY ALL")
def confidence_bands(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("stem", "source", fusion.band_of(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))


@query(f"""WITH {_E}, r AS (SELECT *, count(DISTINCT source) OVER (PARTITION BY stem, text) AS sources, row_number() OVER (PARTITION BY stem, text ORDER BY confidence DESC, id) AS k FROM e)
SELECT stem, id FROM r WHERE k = 1 AND NOT (length(text) <= 1 AND confidence < 0.65) AND NOT (source = 'binary_full' AND sources < 2) AND (confidence >= 0.4 OR sources >= 2 AND confidence >= 0.3)""")
def clean_filter(spark, sf_dir):
    alt = F.struct(F.col("source"))
    g = boxes(spark, sf_dir).groupBy("stem", "text").agg(F.max_by(F.struct("id", "source", "confidence"), F.struct("confidence", -F.col("id"))).alias("w"), F.collect_list(alt).alias("alternatives"))
    return fusion.clean_regions(g.select("stem", "text", "w.*", "alternatives")).select("stem", "id")


@query(f"WITH {_E} SELECT stem, source, count(*) AS n FROM e GROUP BY ALL")
def source_counts(spark, sf_dir):
    return fusion.source_counts(boxes(spark, sf_dir))


@query("""WITH e AS (SELECT user_id AS stem, event_id AS id, event_id * 11 % 500 AS a, event_id * 11 % 500 + event_id % 90 AS b, event_id % 3 AS k FROM events)
SELECT s.stem, s.id, count(p.id) AS pieces, CAST(coalesce(sum(least(s.b, p.b) - greatest(s.a, p.a)) FILTER (p.id IS NOT NULL), 0) AS BIGINT) AS shared, count(p.id) FILTER (p.k = 1) = 0 AS correct
FROM e s LEFT JOIN e p ON p.stem = s.stem AND p.k > 0 AND greatest(s.a, p.a) < least(s.b, p.b) WHERE s.k = 0 GROUP BY s.stem, s.id""")
def span_overlap(spark, sf_dir):
    e, start = F.col("event_id"), F.col("event_id") * 11 % 500
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stem"), e.alias("id"), start.alias("start"), (start + e % 90).alias("end"))
    spans, met = rows.where("id % 3 = 0"), checks.overlaps(rows.where("id % 3 = 0"), rows.where("id % 3 > 0"))
    met = met.groupBy("stem", "id").agg(F.count("*").alias("pieces"), F.sum(F.col("end") - F.col("start")).alias("shared"), F.count_if(F.col("piece") % 3 == 1).alias("wrong"))
    out = spans.select("stem", "id").join(met, ["stem", "id"], "left").fillna(0)
    return out.select("stem", "id", "pieces", "shared", (F.col("wrong") == 0).alias("correct"))


@query()
def merged_regions(spark, sf_dir):
    return fusion.merge_regions(fusion.group_regions(boxes(spark, sf_dir).drop("id")))


def lines(spark, sf_dir) -> DataFrame:
    """Boxes in seven lines a page, of two texts that share no letter: regions are lines, and SQL can follow the fusion."""
    e = F.col("event_id")
    y1 = (e % 7 * 100 + e * 3 % 5).cast("double")
    return boxes(spark, sf_dir).withColumn("event_id", F.col("id")).select(
        "stem", "ord", F.when(e % 2 == 0, "alpha").otherwise("zzzzyy").alias("text"), "confidence", (e % 4).cast("double").alias("x1"), y1.alias("y1"),
        (e % 4 + 300 + e % 3).cast("double").alias("x2"), (y1 + 30).alias("y2"), "source",
    )


_L = f"""WITH {_E.replace('AS text', 'AS kind', 1)},
l AS (SELECT stem, id AS ord, id % 7 AS line, CASE id % 2 WHEN 0 THEN 'alpha' ELSE 'zzzzyy' END AS text, confidence, source, CAST(id % 4 AS DOUBLE) AS x1, CAST(id % 7 * 100 + id * 3 % 5 AS DOUBLE) AS y1,
 confidence + length(text) * 0.002::DOUBLE + ({_Q})::DOUBLE AS quality FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY quality DESC, ord) AS arrival FROM l),
b AS (SELECT *, row_number() OVER (PARTITION BY stem, line, text ORDER BY confidence DESC, arrival) AS r, min(arrival) OVER (PARTITION BY stem, line, text) AS came, min(arrival) OVER (PARTITION BY stem, line) AS grp FROM o),
d AS (SELECT *, row_number() OVER (PARTITION BY stem, line ORDER BY quality DESC, came) AS pos, confidence >= max(confidence) OVER (PARTITION BY stem, line) - 0.28::DOUBLE AS eligible FROM b WHERE r = 1),
w AS (SELECT *, row_number() OVER (PARTITION BY stem, line ORDER BY CASE WHEN eligible THEN quality END DESC NULLS LAST, confidence DESC, pos) AS win FROM d),
m AS (SELECT stem, line, max(grp) AS grp, max(text) FILTER (win = 1) AS text, max(confidence) FILTER (win = 1) AS confidence, max(source) FILTER (win = 1) AS source, max(x1) FILTER (win = 1) AS x1, max(y1) FILTER (win = 1) AS y1,
 count(*) AS alternatives, count(DISTINCT source) AS sources, string_agg(text || ':' || source, ',' ORDER BY pos) AS said FROM w GROUP BY stem, line),
i AS (SELECT *, CAST(row_number() OVER (PARTITION BY stem ORDER BY y1 + 15, x1, grp) AS INT) AS id FROM m),
c AS (SELECT * FROM i WHERE NOT (source = 'binary_full' AND sources < 2) AND (confidence >= 0.4 OR sources >= 2 AND confidence >= 0.3))"""


@query(f"{_L} SELECT stem, id, text, confidence, source, said, id IN (SELECT id FROM c WHERE c.stem = i.stem) AS clean FROM i")
def merged_lines(spark, sf_dir):
    m = fusion.merge_regions(fusion.group_regions(lines(spark, sf_dir)))
    clean = fusion.clean_regions(m).select("stem", "id", F.lit(True).alias("clean"))
    said = F.array_join(F.transform("alternatives", lambda a: F.concat(a["text"], F.lit(":"), a["source"])), ",")
    return m.withColumn("said", said).join(clean, ["stem", "id"], "left").select("stem", "id", "text", "confidence", "source", "said", F.coalesce("clean", F.lit(False)).alias("clean"))


@query(f"""{_L}, k AS (SELECT stem, string_agg(source || '=' || CAST(n AS VARCHAR), ',' ORDER BY source) AS by_source, CAST(sum(n) AS BIGINT) AS raw FROM (SELECT stem, source, count(*) AS n FROM l GROUP BY ALL) GROUP BY stem)
SELECT k.stem, raw, by_source, (SELECT count(*) FROM i WHERE i.stem = k.stem) AS merged, (SELECT count(*) FROM i WHERE i.stem = k.stem AND confidence >= 0.65) AS high,
 (SELECT count(*) FROM c WHERE c.stem = k.stem) AS clean, (SELECT count(*) FROM c WHERE c.stem = k.stem AND (confidence < 0.65 OR alternatives > 1)) AS uncertain FROM k""")
def line_statistics(spark, sf_dir):
    rows = lines(spark, sf_dir)
    m = fusion.merge_regions(fusion.group_regions(rows))
    s = fusion.statistics(rows, m, fusion.clean_regions(m))
    by = F.array_join(F.transform(F.map_entries("candidate_count_by_source"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.select("stem", F.col("raw_candidate_count").alias("raw"), by.alias("by_source"), F.col("merged_region_count").alias("merged"), F.col("high_confidence_region_count").alias("high"), F.col("clean_region_count").alias("clean"), F.col("uncertain_region_count").alias("uncertain"))


@query()
def region_statistics(spark, sf_dir):
    b = boxes(spark, sf_dir).drop("id")
    m = fusion.merge_regions(fusion.group_regions(b))
    return fusion.statistics(b, m, fusion.clean_regions(m))


def turn_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = c.select("conv_id", "turn", F.col("text").alias("first"))
    return a.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("second")), ["conv_id", "turn"])


#: Marks that no document holds, so that an alignment has to step over them.
_X, _Y = "甲乙", "丙"


@query(f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS stem, doc_id % 3 AS k, CAST(length(text) AS INT) AS n, CAST((length(text) + 1) // 2 AS INT) AS l FROM documents),
o AS (SELECT stem, 0 AS ord, 'equal' AS tag, 0 AS i1, l AS i2, 0 AS j1, l AS j2 FROM d WHERE l > 0
 UNION ALL SELECT stem, 1, CASE k WHEN 0 THEN 'insert' WHEN 1 THEN 'delete' ELSE 'replace' END, l, l + CASE k WHEN 0 THEN 0 ELSE 2 END, l, l + CASE k WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END FROM d
 UNION ALL SELECT stem, 2, 'equal', l + CASE k WHEN 0 THEN 0 ELSE 2 END, n + CASE k WHEN 0 THEN 0 ELSE 2 END, l + CASE k WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END, n + CASE k WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END FROM d WHERE n > l)
SELECT stem, CAST(row_number() OVER (PARTITION BY stem ORDER BY ord) - 1 AS INT) AS ord, tag, i1, i2, j1, j2 FROM o""")
def opcodes(spark, sf_dir):
    """Each document against itself with a mark put in, taken out or changed behind its longer half."""
    t, k = F.col("text"), F.col("doc_id") % 3
    half = F.floor((F.length(t) + 1) / 2).cast("int")
    first, rest = F.substring(t, F.lit(1), half), F.substring(t, half + 1, F.length(t))
    mark = lambda a, b, c: F.when(k == 0, a).when(k == 1, b).otherwise(c)
    ref, hyp = F.concat(first, mark("", _X, _X), rest), F.concat(first, mark(_X, "", _Y), rest)
    p = whole(spark, sf_dir).select("stem", F.posexplode(metrics.opcodes(ref, hyp)).alias("ord", "o"))
    return p.select("stem", "ord", "o.*")


@query()
def opcodes_of_edits(spark, sf_dir):
    """Each document against one with many letters changed: no SQL; the matcher is held against the library's in tests."""
    return whole(spark, sf_dir).select("stem", metrics.opcodes(F.col("text"), F.translate("text", "ao", "@0")).alias("ops"))


@query(f"WITH {_S}, {_A} SELECT profile, method, substitutions, deletions, insertions, edits FROM a")
def edit_split(spark, sf_dir):
    return evaluate.aggregate(_facts(spark, sf_dir, split=True)).select("profile", "method", "substitutions", "deletions", "insertions", "edits")


# reference, raw and corrected ends of a document by its id, and the error that they make
_CASES = (("軟體", "软件", "軟體"), ("法律", "法津", "法律"), ("法律原則", "法律", "法律原則"), ("法律", "法律", "法律新增"), ("法律", "法律", "法津"))
_MADE = "(VALUES (0, '繁簡混用', '軟體', '软件', '軟體', '是'), (1, '相似字誤認', '律', '津', '律', '是'), (2, '缺字', '原則', '∅', '原則', '是'), (3, 'LLM hallucination', '∅', '∅', '新增', '否')) t(k, error_type, g, raw_ocr, corrected, success)"


def _error_rows(spark, sf_dir):
    """Whole documents with an end that is read or corrected wrongly, a case by doc_id."""
    ends = F.array(*[F.struct(*[F.lit(f"【{x}】").alias(c) for c, x in zip("abc", case, strict=True)]) for case in _CASES])
    s = whole(spark, sf_dir).withColumn("e", F.get(ends, (F.col("doc_id") % len(_CASES)).cast("int")))
    return s.select("stem", *[F.concat("text", f"e.{c}").alias(n) for c, n in zip("abc", ("reference", "raw", "corrected"), strict=True)])


@query(f"SELECT CAST(doc_id AS VARCHAR) AS stem, error_type, 'GT「' || g || '」' AS example, raw_ocr, corrected, success FROM documents JOIN {_MADE} ON doc_id % 5 = k")
def error_types(spark, sf_dir):
    return errors.error_details(_error_rows(spark, sf_dir), {"软件": "軟體"}).drop("ord")


@query(f"""WITH f AS (SELECT k, min(CAST(doc_id AS VARCHAR)) AS stem, count(*) AS n FROM documents JOIN {_MADE} ON doc_id % 5 = k GROUP BY k)
SELECT t.k AS ord, error_type, stem || '：GT「' || g || '」（共 ' || CAST(n AS VARCHAR) || ' 筆）' AS example, raw_ocr, corrected, success FROM f JOIN {_MADE} ON t.k = f.k""")
def error_summary(spark, sf_dir):
    return errors.summarize(errors.error_details(_error_rows(spark, sf_dir), {"软件": "軟體"}))


@query()
def error_details(spark, sf_dir):
    """Every error of documents with many letters lost and changed; worked cases and the two queries before hold the rule."""
    s = whole(spark, sf_dir)
    return errors.error_details(s.select("stem", F.col("text").alias("reference"), F.replace("text", F.lit("th"), F.lit("h")).alias("raw"), F.translate("text", "q", "k").alias("corrected")))


@query("""WITH w AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations)
SELECT conv_id, turn, length(CASE WHEN length(b) > 0 AND length(b) / greatest(length(a), 1)::DOUBLE BETWEEN 0.45 AND 1.6 THEN b ELSE 'fallback' END) AS n_chunk, length(CASE WHEN length(b) > 0 AND length(b) / greatest(length(a), 1)::DOUBLE BETWEEN 0.65 AND 1.65 THEN b ELSE a END) AS n_document FROM w WHERE t = turn + 1""")
def length_guard(spark, sf_dir):
    p = turn_pairs(spark, sf_dir)
    a, b = F.col("first"), F.col("second")
    return p.select("conv_id", "turn", F.length(metrics.guarded(b, a, F.lit("fallback"))).cast("long").alias("n_chunk"), F.length(metrics.guarded(b, a, a, 0.65, 1.65)).cast("long").alias("n_document"))


@query("SELECT d.lang, l.quality, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (l.toxic = 1 OR d.n_chars < 100) AS uncertain FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL")
def doc_quality(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("lang", "quality").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_if((F.col("toxic") == 1) | (F.col("n_chars") < 100)).alias("uncertain"))
