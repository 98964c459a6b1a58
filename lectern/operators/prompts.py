"""What a model is asked, as columns of messages; wording is this library's own, the demands are the workflow's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .documents import ANSWERS, PENDING, QUESTIONS, SUMMARY_SECTIONS

MESSAGE = "array<struct<role:string,content:string>>"
#: Goes with every call.
SHARED = "\n回覆的中文一律使用臺灣繁體中文，所有中文輸出一律使用臺灣繁體中文，不得出現簡體字。特殊符號、箭頭、公式、編號與英數字照原樣抄錄；看不出代表何字的符號也照抄，不要猜。"
#: Goes with the calls that correct.
GROUNDED = "\n依據只有辨識結果、同一區域的候選與上下文。不得補充、推論或新增證據裡沒有的事實、條文、例子或句段；沒有把握就照抄，也不要加註記。"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _pair(system: Column | str, user: Column) -> Column:
    return F.array(message("system", F.lit(system) if isinstance(system, str) else system), message("user", user)).cast(MESSAGE)


def correction(source: Column, index: Column, count: Column) -> Column:
    """One chunk of recognised text, or of regions with their candidates, to be corrected."""
    rules = (
        "你負責校對法律課堂筆記的文字辨識結果：改正錯字、缺字、繁簡夾雜、標點和斷行。同一區域列有多個候選時，比較候選、信心與前後文後取最可信的寫法。"
        "缺字只在候選或前後文足以證明時補上。意思、編號、層次與術語不變，不得加入原文沒有的內容；無從判斷之處必須原樣保留。一個區域至多輸出一行，除校正後的文字外什麼都不要輸出。"
    )
    return _pair(rules, F.concat(F.lit("第 "), index.cast("string"), F.lit("／"), count.cast("string"), F.lit(" 段辨識文字，請校正：\n\n"), source))


def reconstruction(first_pass: Column) -> Column:
    """The whole first pass, to be mended once more."""
    rules = (
        "你負責法律筆記第二階段的全文整理：在初校文字上保守地修好剩下的錯字、斷句與編號。用字只取自輸入，不得憑常識或專業知識補寫；日期、頁碼、符號、孤立的字與殘句都可能屬於原頁，不得刪除。"
        "整理不了的句子照抄，不得新增說明標記，不得摘要或省略，輸出整理後的完整筆記。"
    )
    return _pair(rules, F.concat(F.lit("整份筆記如下，請整理：\n\n"), first_pass))


def summary(note: Column, source: Column) -> Column:
    """A page's summary; ``note`` is its quality note and may be null."""
    rules = (
        f"你負責把整理好的筆記編成單頁摘要（Markdown）。內容限於來源，不加外部法律知識、試題或解答。明顯的錯漏先改正，不能確定的歸入「{PENDING}」。實務、學說與各家見解的歸屬照舊，不得對調。"
        f"二級標題恰為以下七個並依此順序：{'、'.join(SUMMARY_SECTIONS)}。見解比較以表格為先。不要輸出前言、題庫、表情符號或程式碼框。"
    )
    return _pair(rules, F.concat_ws("\n\n", note, F.concat(F.lit("整理後的筆記：\n"), source)))


_QUIZ = f"你負責為課堂小考命題。題目與答案只取自所附的單頁摘要，不得動用外部知識或改動見解的歸屬，也不得取材於「{PENDING}」。不要輸出總標題、二級標題、前言、表情符號或程式碼框。"
_CHOICE = "單選題恰好 {n} 題，各有 A 到 D 四個選項，答案唯一"
_BINARY = "是非題恰好 {n} 題"
_SHORT = "簡答題恰好 {n} 題"
_KEYS = "簡答題的解答逐題對應並列出得分關鍵字"


def objective_questions(source: Column, count: int) -> Column:
    heads = "、".join((*QUESTIONS[:2], *ANSWERS[:2]))
    return _pair(f"{_QUIZ}三級標題恰為：{heads}。{_CHOICE.format(n=count)}；{_BINARY.format(n=count)}；解答逐題對應，並可由摘要直接得出。", F.concat(F.lit("單頁摘要：\n"), source))


def short_questions(source: Column, count: int) -> Column:
    return _pair(f"{_QUIZ}三級標題恰為：{QUESTIONS[2]}、{ANSWERS[2]}。{_SHORT.format(n=count)}；{_KEYS}。", F.concat(F.lit("單頁摘要：\n"), source))


def quiz_repair(source: Column, lacking: Column, count: int) -> Column:
    """The sections that an earlier answer lacked, and what holds for each of them."""
    demands = {QUESTIONS[2]: _SHORT, ANSWERS[2]: _KEYS, QUESTIONS[0]: _CHOICE, QUESTIONS[1]: _BINARY}
    said = F.array_compact(F.array(*[F.when(F.array_contains(lacking, s), d.format(n=count)) for s, d in demands.items()]))
    rules = F.concat(F.lit(f"{_QUIZ}前一次的輸出不完整，這次只補寫下列三級標題及其內容：{''}"), F.array_join(lacking, "、"), F.lit("。"), F.array_join(said, "；"), F.lit("。"))
    return _pair(rules, F.concat(F.lit("單頁摘要：\n"), source))
