"""Chunks, sections, structure checks and deterministic fallbacks of Markdown documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text

# Section names and aliases, in document order.
SUMMARY_SECTIONS = ("本頁主題", "重點摘要", "核心概念與定義", "見解比較", "判斷架構", "易混淆重點", "待核對原文")
SUMMARY_ALIASES = {"Quiz 範圍": "本頁主題", "主題": "本頁主題", "一頁必背": "重點摘要", "摘要": "重點摘要", "爭議與見解比較表": "見解比較", "爭議與見解比較": "見解比較", "判斷流程": "判斷架構", "易錯字與易混淆概念": "易混淆重點", "易混淆概念": "易混淆重點", "待核對 OCR": "待核對原文"}
QUESTIONS = ("單選題", "是非題", "簡答題")
ANSWERS = ("單選題答案與解析", "是非題答案與解析", "簡答題答案與解析")
QUIZ_ALIASES = {"判斷題": "是非題", "判斷題答案與解析": "是非題答案與解析", "判斷題解析": "是非題答案與解析", "單選題解析": "單選題答案與解析", "選擇題答案與解析": "單選題答案與解析", "簡答題解析": "簡答題答案與解析", "參考答案與解析": "簡答題答案與解析"}
FORBIDDEN = ("## Quiz 題庫", "## 答案與解析", "### 單選題", "### 是非題")
TITLE, PENDING = "# 單頁筆記摘要", "待核對原文"


def lines_of(t: Column) -> Column:
    """Lines as Python's splitlines gives them; a final line break opens no line."""
    split = F.split(t, "\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85  ]")
    closed = lambda parts: (F.size(parts) > 0) & (F.element_at(parts, -1) == "")
    return text.bound(split, lambda parts: F.when(closed(parts), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def pack(items: Column, extra: int, most: int, joiner: str) -> Column:
    """Greedy packing of an array of strings into joined chunks: a chunk is closed before it would pass ``most``."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def step(a, x):
        size = F.length(x) + extra
        close = a["open"].isNotNull() & (a["n"] + size > most)
        return F.struct(
            F.when(close, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"),
            F.when(close | a["open"].isNull(), x).otherwise(F.concat(a["open"], F.lit(joiner), x)).alias("open"),
            F.when(close, size).otherwise(a["n"] + size).alias("n"),
        )

    return F.aggregate(items, start, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def chunks(t: Column, most: int = 1000) -> Column:
    """Chunks of whole lines; an overlong line stays whole."""
    return pack(lines_of(t), 1, most, "\n")


def evidence_blocks(regions: Column, most_alternatives: int = 3) -> Column:
    """Prompt block and primary text of each region (struct id, text, confidence, alternatives)."""
    two = lambda x: F.format_string("%.2f", F.coalesce(x, F.lit(0.0)))

    def block(r):
        main = text.strip(r["text"])
        # first record of each other text, in order
        trimmed = F.transform(F.coalesce(r["alternatives"], F.array()), lambda a: F.struct(text.strip(a["text"]).alias("t"), a["confidence"].alias("c"), a["source"].alias("s")))
        other = F.filter(trimmed, lambda a: (a["t"] != "") & (a["t"] != main))
        names = F.slice(F.array_distinct(F.transform(other, lambda a: a["t"])), 1, most_alternatives)
        firsts = F.transform(names, lambda n: F.get(F.filter(other, lambda a: a["t"] == n), F.lit(0)))
        said = F.transform(firsts, lambda a: F.concat(F.lit("- "), a["t"], F.lit(" (信心 "), two(a["c"]), F.lit(", 來源 "), F.coalesce(a["s"], F.lit("unknown")), F.lit(")")))
        head = F.concat(F.lit("[區域 "), r["id"].cast("string"), F.lit("]\n主要候選: "), main, F.lit("\n主要信心: "), two(r["confidence"]), F.lit("\n"))
        return F.struct(F.concat(head, F.when(F.size(said) > 0, F.concat(F.lit("其他候選:\n"), F.array_join(said, "\n"))).otherwise("")).alias("block"), main.alias("line"))

    return F.filter(F.transform(regions, block), lambda b: b["line"] != "")


def evidence_chunks(regions: Column, most: int = 3000, most_alternatives: int = 3) -> Column:
    """Array of (prompt_text, fallback_text): blocks packed greedily, with the primary lines of each chunk."""
    blocks = evidence_blocks(regions, most_alternatives)
    start = F.struct(F.array().cast("array<struct<prompt_text:string,fallback_text:string>>").alias("done"), F.lit(None).cast("string").alias("p"), F.lit(None).cast("string").alias("f"), F.lit(0).alias("n"))

    def step(a, b):
        size = F.length(b["block"]) + 2
        close = a["p"].isNotNull() & (a["n"] + size > most)
        fresh = close | a["p"].isNull()
        return F.struct(
            F.when(close, F.concat(a["done"], F.array(F.struct(a["p"].alias("prompt_text"), a["f"].alias("fallback_text"))))).otherwise(a["done"]).alias("done"),
            F.when(fresh, b["block"]).otherwise(F.concat(a["p"], F.lit("\n\n"), b["block"])).alias("p"),
            F.when(fresh, b["line"]).otherwise(F.concat(a["f"], F.lit("\n"), b["line"])).alias("f"),
            F.when(close, size).otherwise(a["n"] + size).alias("n"),
        )

    last = lambda a: F.array(F.struct(a["p"].alias("prompt_text"), a["f"].alias("fallback_text")))
    return F.aggregate(blocks, start, step, lambda a: F.when(a["p"].isNull(), a["done"]).otherwise(F.concat(a["done"], last(a))))


def named_sections(t: Column, names: tuple[str, ...]) -> Column:
    """Map of section name to body. Headings may contain a name, plain lines must be one; longest names first."""
    order = sorted(names, key=len, reverse=True)
    edge = lambda c: F.regexp_replace(c, r"^[*_ ]+|[*_ ]+$", "")

    def label(x):
        head = F.regexp_extract(x, r"(?U)^\s*#{1,6}\s+(.+?)\s*$", 1)
        is_head = head != ""
        own = F.when(is_head, edge(text.strip(head))).otherwise(F.regexp_replace(edge(text.strip(x)), "[：:]+$", ""))
        out = F.lit(None).cast("string")
        for n in reversed(order):
            out = F.when((own == n) | (is_head & F.contains(own, F.lit(n))), n).otherwise(out)
        # a plain line counts only where it is some name; the loop's equality says so
        return out

    def sections(ls):
        marked = F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), label(x).alias("n"))), lambda m: m["n"].isNotNull())

        def bodies(marks):
            def body(m, k):
                end = F.coalesce(F.get(marks, k + 1)["i"], F.size(ls))
                return F.struct(m["n"].alias("key"), text.strip(F.array_join(F.slice(ls, m["i"] + 2, end - m["i"] - 1), "\n")).alias("value"))

            return F.filter(F.transform(marks, body), lambda b: b["value"] != "")

        return _last_of_each(text.bound(marked, bodies))

    return text.bound(lines_of(text.strip_fences(t)), sections)


def _last_of_each(entries: Column) -> Column:
    """Map of (key, value) entries: of equal keys the last value stands, at the place of the first."""

    def of(found):
        keys = F.array_distinct(F.transform(found, lambda p: p["key"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(found, lambda p: p["key"] == k), -1)["value"]))

    return text.bound(entries, of)


def level_two_sections(t: Column) -> Column:
    """Array of (key, title, markdown) of non-empty level-two sections; the whole text if there is none."""
    title = lambda x: F.regexp_extract(text.strip(x), r"(?U)^##\s+(.+?)\s*$", 1)

    def sections(ls):
        marked = F.filter(F.transform(ls, lambda x, i: F.struct(i.alias("i"), title(x).alias("t"))), lambda m: m["t"] != "")

        def bodies(marks):
            def body(m, k):
                end = F.coalesce(F.get(marks, k + 1)["i"], F.size(ls))
                return F.struct(m["t"].alias("title"), text.strip(F.array_join(F.slice(ls, m["i"] + 1, end - m["i"]), "\n")).alias("markdown"))

            return F.filter(F.transform(marks, body), lambda b: b["markdown"] != "")

        return text.bound(marked, bodies)

    def keyed(found):
        named = F.transform(found, lambda b, k: F.struct(F.concat(F.lit("section-"), (k + 1).cast("string")).alias("key"), b["title"].alias("title"), b["markdown"].alias("markdown")))
        whole = F.array(F.struct(F.lit("section-1").alias("key"), F.lit("完整摘要").alias("title"), text.strip(t).alias("markdown")))
        return F.when(F.size(found) > 0, named).otherwise(F.filter(whole, lambda w: w["markdown"] != ""))

    return text.bound(text.bound(F.split(text.unify_newlines(t), "\n"), sections), keyed)


def _canonical(parts: Column, aliases: dict[str, str]) -> Column:
    """Sections under their canonical names; of a name and its aliases the last one found stands."""
    return _last_of_each(F.transform(F.map_entries(parts), lambda p: F.struct(_renamed(p["key"], aliases).alias("key"), p["value"].alias("value"))))


def _renamed(name: Column, aliases: dict[str, str]) -> Column:
    out = name
    for a, n in aliases.items():
        out = F.when(name == a, n).otherwise(out)
    return out


def normalize_summary(t: Column) -> Column:
    """Canonical summary: the title, then the non-empty sections in order."""
    parts = _canonical(named_sections(t, (*SUMMARY_SECTIONS, *SUMMARY_ALIASES)), SUMMARY_ALIASES)
    body = lambda p: F.concat_ws("\n\n", F.lit(TITLE), *[F.concat(F.lit(f"## {s}\n"), F.try_element_at(p, F.lit(s))) for s in SUMMARY_SECTIONS])
    return F.concat(text.strip(text.bound(parts, body)), F.lit("\n"))


def normalize_quiz(t: Column, names: tuple[str, ...]) -> Column:
    """Map of the named quiz sections, aliases resolved."""
    known = {a: n for a, n in QUIZ_ALIASES.items() if n in names}
    return _canonical(named_sections(t, (*names, *known)), known)


def assemble_quiz(objective: Column, short: Column) -> Column:
    part = lambda m, k: F.concat(F.lit(f"### {k}\n"), text.strip(F.try_element_at(m, F.lit(k))))
    return F.concat(F.concat_ws("\n\n", F.lit("# 單頁筆記小考"), F.lit("## 題目"), *[part(m, k) for m, k in zip((objective, objective, short), QUESTIONS, strict=True)], F.lit("## 答案與解析"), *[part(m, k) for m, k in zip((objective, objective, short), ANSWERS, strict=True)]), F.lit("\n"))


def _messages(*tests: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, said) for bad, said in tests]))


def validate_summary(t: Column) -> Column:
    """Messages for missing and forbidden sections, wrongly decoded text and fences, in fixed order."""
    return _messages(
        *[(~t.rlike(rf"(?mU)^##\s+{s}\s*$"), F.lit(f"缺少摘要章節：{s}")) for s in SUMMARY_SECTIONS],
        *[(F.contains(t, F.lit(x)), F.lit(f"摘要不應包含：{x.lstrip('# ')}")) for x in FORBIDDEN],
        (text.has_mojibake(t), F.lit("摘要含疑似 OCR 亂碼")), (F.contains(t, F.lit("```")), F.lit("摘要含 Markdown code fence")),
    )


def question_counts(parts: Column) -> dict[str, Column]:
    return {q: text.count_numbered(F.coalesce(F.try_element_at(parts, F.lit(q)), F.lit(""))) for q in QUESTIONS}


def validate_quiz(t: Column, count: int = 5) -> Column:
    """Messages for missing sections, wrong numbers of questions, wrongly decoded text and fences."""
    return text.bound(named_sections(t, (*QUESTIONS, *ANSWERS)), lambda parts: _quiz_messages(parts, t, count))


def _quiz_messages(parts: Column, t: Column, count: int) -> Column:
    counts = question_counts(parts)
    return _messages(
        *[(F.try_element_at(parts, F.lit(s)).isNull(), F.lit(f"缺少小考章節：{s}")) for s in (*QUESTIONS, *ANSWERS)],
        *[(n != count, F.concat(F.lit(f"{q}應為 {count} 題，目前為 "), n.cast("string"), F.lit(" 題"))) for q, n in counts.items()],
        (text.has_mojibake(t), F.lit("小考含疑似 OCR 亂碼")), (F.contains(t, F.lit("```")), F.lit("小考含 Markdown code fence")),
    )


def quiz_source(t: Column) -> Column:
    """Summary without what follows the heading of unchecked text, where that section has a body."""
    pending = F.try_element_at(named_sections(t, (PENDING,)), F.lit(PENDING)).isNotNull()
    at = F.instr(t, f"## {PENDING}")
    return F.when(pending & (at > 0), F.regexp_replace(F.substring(t, F.lit(1), at - 1), f"{text.WS}+$", "")).otherwise(t)


# Texts of the deterministic summary between its bullets.
_BEFORE = f"{TITLE}\n\n## 本頁主題\n本頁課堂筆記重點整理。\n\n## 重點摘要\n"
_AFTER = "\n\n## 核心概念與定義\n- 請依重點摘要整理核心名詞。\n\n## 見解比較\n- 請比較筆記中的實務、學說及其他見解。\n\n## 判斷架構\n- 先確認爭議問題，再區分各見解及其判斷標準。\n\n## 易混淆重點\n- 注意不同見解的歸屬與適用範圍。\n\n## 待核對原文\n- 法條號碼、專有名詞與低信心 OCR 內容仍建議對照原圖。\n"


def fallback_summary(t: Column, compose: bool = True) -> Column:
    """Seven sections without a model: one bullet a line of the cleaned text."""
    ls = F.filter(F.transform(lines_of(text.normalize_noise(t, compose=compose)), text.strip), lambda x: x != "")
    full = F.concat(F.lit(_BEFORE), F.array_join(F.transform(ls, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit(_AFTER))
    return F.when(F.size(ls) == 0, f"{TITLE}\n\n## 本頁主題\n無可摘要內容。\n").otherwise(full)


def fallback_quiz(t: Column, count: int = 5) -> Column:
    """Short-answer questions from the first lines of four sections that are no table rows."""
    parts = named_sections(t, ("重點摘要", "核心概念與定義", "見解比較", "判斷架構"))
    ls = F.flatten(F.transform(F.map_values(parts), lambda body: text.bound(body, lines_of)))
    ls = F.transform(F.filter(ls, lambda x: text.strip(x) != ""), lambda x: F.regexp_replace(x, "^[-* ]+|[-* ]+$", ""))
    return text.bound(F.slice(F.filter(ls, lambda x: ~F.startswith(x, F.lit("|"))), 1, count), _short_answers)


def _short_answers(ls: Column) -> Column:
    numbered = lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x)
    ask = F.transform(ls, lambda x, k: numbered(F.concat(F.lit("請說明「"), F.substring(x, 1, 45), F.lit("」的重點。")), k))
    reply = F.transform(ls, lambda x, k: numbered(F.lit("參考摘要中的相關段落作答。"), k))
    return F.concat(F.lit("# 單頁筆記小考\n\n## 題目\n\n### 簡答題\n"), F.array_join(ask, "\n"), F.lit("\n\n## 答案與解析\n\n### 簡答題答案與解析\n"), F.array_join(reply, "\n"), F.lit("\n"))
