"""Queries over Markdown, evidence and run checks, with inputs derived from documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics, text
from ..operators import checks, documents, fusion
from .queries import _E, _NOISE, boxes, query, table

#: A document's cleaned lines, as SQL.
_LINES = f"SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')), lambda x: x <> '') AS a FROM (SELECT doc_id, {_NOISE} AS t FROM documents)"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(f"WITH l AS ({_LINES}) SELECT doc_id, md5(CASE WHEN len(a) = 0 THEN {_quoted(documents.TITLE + chr(10) * 2 + '## 本頁主題' + chr(10) + '無可摘要內容。' + chr(10))} ELSE {_quoted(documents._BEFORE)} || array_to_string(list_transform(a, lambda x: '- ' || x), chr(10)) || {_quoted(documents._AFTER)} END) AS digest FROM l")
def fallback_summaries(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(documents.fallback_summary(F.col("text"))).alias("digest"))


@query(f"""WITH l AS ({_LINES}),
b AS (SELECT doc_id, a[1:5] || ['請依重點摘要整理核心名詞。', '請比較筆記中的實務、學說及其他見解。', '先確認爭議問題，再區分各見解及其判斷標準。', '## 易混淆重點', '注意不同見解的歸屬與適用範圍。'] AS a FROM (SELECT doc_id, list_filter(list_transform(a, lambda x: regexp_replace(x, '^[-* ]+|[-* ]+$', '', 'g')), lambda x: NOT starts_with(x, '|')) AS a FROM l)),
q AS (SELECT doc_id, a[1:5] AS a FROM b)
SELECT doc_id, len(a) AS questions, md5('# 單頁筆記小考' || chr(10) || chr(10) || '## 題目' || chr(10) || chr(10) || '### 簡答題' || chr(10) || array_to_string(list_transform(a, lambda x, i: CAST(i AS VARCHAR) || '. 請說明「' || substr(x, 1, 45) || '」的重點。'), chr(10))
 || chr(10) || chr(10) || '## 答案與解析' || chr(10) || chr(10) || '### 簡答題答案與解析' || chr(10) || array_to_string(list_transform(a, lambda x, i: CAST(i AS VARCHAR) || '. 參考摘要中的相關段落作答。'), chr(10)) || chr(10)) AS digest FROM q""")
def fallback_quizzes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", documents.fallback_quiz(documents.fallback_summary(F.col("text"))).alias("q"))
    return d.select("doc_id", F.regexp_count("q", F.lit("請說明「")).cast("long").alias("questions"), F.md5("q").alias("digest"))


def _one_line(t):
    return text.strip(F.regexp_replace(t, "[\\s#]+", " "))


_ONE = "regexp_replace(regexp_replace(text, '[\\t-\\r #]+', ' ', 'g'), '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')"


@query(f"""SELECT doc_id, md5('{documents.TITLE}' || chr(10) || chr(10) || '## 本頁主題' || chr(10) || source || chr(10) || chr(10) || '## 重點摘要' || chr(10) || {_ONE} || chr(10) || chr(10) || '## 判斷架構' || chr(10) || lang || chr(10)) AS digest FROM documents""")
def normalized_summaries(spark, sf_dir):
    """Sections out of order, under aliases, bold, fenced, empty or twice come back as the canonical summary."""
    d = table(spark, sf_dir, "documents")
    t = F.concat(F.lit("```markdown\n# t\n## **判斷流程**\n"), "lang", F.lit("\n## 摘要\nold\n### 一頁必背：\n"), _one_line(F.col("text")), F.lit("\n## 見解比較\n \n## 主題\n"), "source", F.lit("\n```"))
    return d.select("doc_id", F.md5(documents.normalize_summary(t)).alias("digest"))


@query("""WITH q AS (SELECT doc_id, doc_id % 7 AS n, doc_id % 3 AS m FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN m = 0 THEN '缺少小考章節：簡答題答案與解析' END, CASE WHEN n <> 5 THEN '單選題應為 5 題，目前為 ' || CAST(n AS VARCHAR) || ' 題' END, CASE WHEN m = 1 THEN '小考含 Markdown code fence' END) AS errors FROM q""")
def quiz_checks(spark, sf_dir):
    """A quiz with doc_id % 7 choice questions, without one section or with a fence, by doc_id."""
    n, m = F.col("doc_id") % 7, F.col("doc_id") % 3
    items = lambda k: F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.lit(7)), lambda i: i <= k), lambda i: F.concat(i.cast("string"), F.lit(". x"))), "\n")
    head = lambda name, body: F.concat(F.lit(f"\n### {name}\n"), body)
    t = F.concat(
        head("單選題", F.concat(F.lit("intro\n"), items(n))), head("判斷題 是非題", items(F.lit(5))), head("簡答題", items(F.lit(5))), head("單選題答案與解析", F.lit("a")), head("是非題答案與解析", F.lit("b")),
        F.when(m == 0, "").otherwise(head("簡答題答案與解析", F.lit("c"))), F.when(m == 1, "\n```\nx").otherwise(""),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(documents.validate_quiz(t), ",").alias("errors"))


@query("""WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS stem, doc_id % 4 AS a, doc_id % 5 AS b, doc_id % 6 AS c, lang FROM documents)
SELECT stem, unnest(list_filter([CASE WHEN a = 0 THEN 'no recognised text' END, CASE WHEN b = 0 THEN 'no clean regions' END, CASE WHEN c = 0 THEN 'no corrected text' END, CASE WHEN lang = 'de' THEN 'summary: x; y' END,
 CASE WHEN c = 1 THEN 'correction without the model' END, CASE WHEN a <> 1 THEN 'summary without the model' END, CASE WHEN b <> 5 AND b <> 1 THEN 'quiz: multiple_choice has ' || CAST(b AS VARCHAR) || ' of 1 questions' END, CASE WHEN a <> 1 THEN 'quiz: true_false has ' || CAST(a AS VARCHAR) || ' of 1 questions' END,
 'quiz: short_answer has 0 of 1 questions'], lambda x: x IS NOT NULL)) AS problem FROM r""")
def run_violations(spark, sf_dir):
    a, b, c = (F.col("doc_id") % k for k in (4, 5, 6))
    errors = F.when(F.col("lang") == "de", F.array(F.lit("x"), F.lit("y")))
    runs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("stem"), F.when(a == 0, " \n").otherwise(F.col("text")).alias("ocr_text"), b.alias("clean_region_count"), F.when(c != 0, F.concat(F.lit("x"), "text")).alias("corrected_text"), (c != 1).alias("corrected_llm"),
        errors.alias("summary_errors"), (a == 1).alias("summary_llm"), F.array().cast("array<string>").alias("quiz_errors"), F.create_map(F.lit("multiple_choice"), b.cast("int"), F.lit("true_false"), a.cast("int")).alias("question_counts"),
    )
    return checks.violations(runs, count=1)


_BLOCK = "'[區域 ' || CAST(turn AS VARCHAR) || ']' || chr(10) || '主要候選: ' || text || chr(10) || '主要信心: 0.' || CAST(25 * (1 + turn % 3) AS VARCHAR) || chr(10) || CASE WHEN turn % 2 = 0 THEN '' ELSE '其他候選:' || chr(10) || '- ' || text || 'x (信心 0.50, 來源 s)' || chr(10) || '- y (信心 0.00, 來源 unknown)' END"


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, regexp_replace(text, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g') AS text FROM conversations),
b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, {_BLOCK} AS block, text FROM t WHERE text <> ''),
w AS (SELECT conv_id, k, 1 AS c, length(block) + 2 AS n, block, text FROM b WHERE k = 1
 UNION ALL SELECT b.conv_id, b.k, CASE WHEN w.n + length(b.block) + 2 > 300 THEN c + 1 ELSE c END, CASE WHEN w.n + length(b.block) + 2 > 300 THEN length(b.block) + 2 ELSE w.n + length(b.block) + 2 END, b.block, b.text FROM w JOIN b ON b.conv_id = w.conv_id AND b.k = w.k + 1)
SELECT conv_id, c AS chunk, md5(string_agg(block, chr(10) || chr(10) ORDER BY k)) AS prompt, md5(string_agg(text, chr(10) ORDER BY k)) AS fallback FROM w GROUP BY ALL""")
def evidence_packing(spark, sf_dir):
    """A conversation's turns as regions, odd ones with alternatives that repeat each other and the main text."""
    t = F.col("text")
    alt = lambda x, c, s: F.struct(x.alias("text"), F.lit(c).cast("double").alias("confidence"), F.lit(s).cast("string").alias("source"))
    alternatives = F.when(F.col("turn") % 2 == 1, F.array(alt(F.concat(text.strip(t), F.lit("x ")), 0.5, "s"), alt(t, 0.9, "s"), alt(F.concat(text.strip(t), F.lit("x")), 0.7, "u"), alt(F.lit(" y"), None, None)))
    region = F.struct("turn", F.col("turn").alias("id"), "text", ((1 + F.col("turn") % 3) / 4).alias("confidence"), alternatives.alias("alternatives"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(region), lambda x, y: (x["turn"] - y["turn"]).cast("int")).alias("regions"))
    c = c.select("conv_id", F.posexplode(documents.evidence_chunks(F.col("regions"), 300)).alias("k", "x"))
    return c.select("conv_id", (F.col("k") + 1).alias("chunk"), F.md5("x.prompt_text").alias("prompt"), F.md5("x.fallback_text").alias("fallback"))


@query("""SELECT doc_id, 'OCR 品質資訊：' || chr(10) || '- 原始候選數：' || CAST(n_chars AS VARCHAR) || chr(10) || '- 合併區域數：' || CASE WHEN lang = 'en' THEN '未知' ELSE '1' END || chr(10) || '- 高信心區域數：未知' || chr(10) || '- 低信心或候選分歧區域數：0' AS note,
 CASE WHEN lang = 'en' THEN 'N/A' ELSE CAST(CAST(doc_id % 8 * 12.5 AS DECIMAL(9, 2)) AS VARCHAR) || '%' END AS share, md5(replace(replace(text, '|', chr(92) || '|'), chr(10), '<br>')) AS cell, CAST(doc_id AS VARCHAR) || '.v1' AS stem FROM documents""")
def formatted(spark, sf_dir):
    """Quality note, percentage, Markdown cell and stem of a path."""
    known = F.col("lang") != "en"
    note = text.quality_context(F.col("n_chars"), F.when(known, 1), F.lit(None), F.lit(0))
    path = F.concat(F.lit("a\\b/"), F.col("doc_id").cast("string"), F.lit(".v1_corrected.txt"))
    return table(spark, sf_dir, "documents").select("doc_id", note.alias("note"), text.percent(F.when(known, F.col("doc_id") % 8 / 8)).alias("share"), F.md5(text.markdown_cell(F.col("text"))).alias("cell"), text.stem_of(path, "_merged_ocr", "_corrected").alias("stem"))


@query("""SELECT doc_id, length(q) AS n FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN regexp_replace(text, '[\\s\\pZ]+$', '') WHEN lang = 'de' THEN text || chr(10) || '## 待核對原文' || chr(10) ELSE text END AS q FROM documents)""")
def quiz_sources(spark, sf_dir):
    """What stands after the heading of unchecked text goes, unless that section is empty."""
    t = F.concat("text", F.when(F.col("lang") == "en", F.concat(F.lit("\n## 待核對原文\n- "), "text")).when(F.col("lang") == "de", "\n## 待核對原文\n").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(documents.quiz_source(t)).cast("long").alias("n"))


@query(f"WITH {_E} SELECT stem, id AS ord_id, 0 AS ord, text, confidence FROM e WHERE text <> 'click'")
def baseline_lines(spark, sf_dir):
    """Engine results as parallel arrays, of unequal lengths, to lines; blank texts go."""
    b = boxes(spark, sf_dir)
    said = F.when(F.col("text") == "click", "  ").otherwise(F.concat(F.lit(" "), "text", F.lit("\n")))
    results = b.select(F.concat_ws(":", F.col("stem").cast("string"), F.col("id").cast("string")).alias("stem"), F.array(said, F.lit("lost")).alias("rec_texts"), F.array("confidence").alias("rec_scores"), F.array(F.array("x1", "y1"), F.array("x2")).alias("rec_boxes"))
    out = fusion.lines_of(results)
    return out.select(F.split_part("stem", F.lit(":"), F.lit(1)).cast("long").alias("stem"), F.split_part("stem", F.lit(":"), F.lit(2)).cast("long").alias("ord_id"), "ord", "text", "confidence")


@query(f"WITH {_E} SELECT stem, count(*) FILTER (text <> 'click') AS line_count, CAST(coalesce(sum(length(text)) FILTER (text <> 'click'), 0) AS BIGINT) AS character_count FROM e GROUP BY stem")
def page_counts(spark, sf_dir):
    b = boxes(spark, sf_dir).select("stem", F.when(F.col("text") == "click", F.lit(" ")).otherwise(F.col("text")).alias("text"))
    return fusion.line_counts(b)


_T = "(SELECT CAST(doc_id AS VARCHAR) AS stem, text FROM documents)"


@query(f"SELECT stem, length(regexp_replace(text, '[\\t-\\r \\x1c-\\x1f\\x{{85}}\\pZ]+', '', 'g')) AS n_compact FROM {_T}")
def compact_lengths(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("stem"), F.length(text.normalize_text(F.col("text"), True)).cast("long").alias("n_compact"))


@query("SELECT p_partkey, p_partkey % 9 / 8 AS rate, CASE WHEN p_partkey % 8 = 0 THEN CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE 'inf'::DOUBLE END ELSE (p_partkey % 9) / (p_partkey % 8)::DOUBLE END AS cer FROM part")
def rates(spark, sf_dir):
    """A rate of edits; without a reference 0 where nothing was read and infinite otherwise."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", (k % 9 / 8).alias("rate"), metrics.rate(k % 9, k % 8, k % 9).alias("cer"))
