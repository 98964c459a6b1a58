"""Text normalisation, cleaning and formatting as column expressions.

White space is Python's Unicode class, written out for Java. NFC has no built-in, so it is one Arrow
function that passes ASCII text through; everything else stays in generated code.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import script

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WS = r"(?U:[\s\x1c-\x1f])"
# Punctuation that loses the spaces around it.
PUNCTUATION = ",.;:!?，。；：！？、"
# Literal corrections, in the order in which they apply.
REPLACEMENTS = (
    ("行序", "行為"), ("為序", "為"), ("處现", "處理"), ("處理事动", "處理事務"), ("事动", "事務"), ("事静", "事務"), ("財庭", "財產"), ("财庭", "財產"),
    ("财產", "財產"), ("财屋", "財產"), ("財屋", "財產"), ("標华", "標準"), ("标準", "標準"), ("强制", "強制"), ("强盗", "強盜"), ("詐欺", "詐欺"),
)
# Characters that betray wrongly decoded text.
MOJIBAKE = "\ufffd\u929d\u5697\uef3c\u0080\uf5f9\uf697"
# What a model's thinking blocks, an outer Markdown fence and a numbered item look like.
THINKING = (r"(?s)<think>.*?</think>", r"(?s)<\|channel\>thought.*?<channel\|>")
FENCE_OPENS, FENCE_CLOSES = r"(?i)^```(?:markdown|md)?(?U:\s)*", r"(?U:\s)*```(?U:\s)*$"
NUMBERED = r"(?mU)^\s*(?:[-*]\s*)?(?:\*\*)?(?:Q\s*)?\d+\s*(?:[.、)]|\*\*[.、)]?)\s*"
# White space and punctuation that comparison ignores.
IGNORED = rf"{WS}|[，。；：、,.!?！？()（）]"
UNKNOWN = "未知"


@F.pandas_udf(T.StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata

    for s in batches:
        yield s.map(lambda x: x if x.isascii() else unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(text: Column) -> Column:
    return _nfc(text)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row, however often the body or its lambdas name it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def normalize_text(text: Column, remove_whitespace: bool, compose: bool = True) -> Column:
    """Evaluation form: NFC, one newline style, no outer white space, or none at all."""
    t = strip(unify_newlines(nfc(text) if compose else text))
    return without_spaces(t) if remove_whitespace else t


def evaluation_forms(text: str | None, compose: bool = True) -> tuple[str | None, str | None]:
    """A text as ``normalize_text`` gives it, in plain Python: with inner white space and without any."""
    import unicodedata

    if text is None:
        return None, None
    t = text if text.isascii() or not compose else unicodedata.normalize("NFC", text)
    t = t.replace("\r\n", "\n").replace("\r", "\n").strip()
    bare = t.replace(" ", "").replace("\n", "")  # most of it in one go
    return t, "".join(bare.split())


def without_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"{WS}+", "")


def normalize_noise(text: Column, table: dict[str, str] | None = None, compose: bool = True) -> Column:
    """Recognition noise out: newlines, invisible marks, spacing, blank lines, literal corrections, script."""
    t = unify_newlines(nfc(text) if compose else text)
    t = F.regexp_replace(t, "[\ufeff\u200b]", "")
    t = F.regexp_replace(t, r"(?U:(?!\n)[\s\x1c-\x1f])+", " ")
    t = F.regexp_replace(t, r" *\n *", "\n")
    t = F.regexp_replace(t, f" *([{PUNCTUATION}]) *", "$1")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    for wrong, right in REPLACEMENTS:
        if wrong != right:
            t = F.replace(t, F.lit(wrong), F.lit(right))
    return script.to_traditional(strip(t), table)


def candidate_key(text: Column) -> Column:
    """Comparison form of a candidate: no white space, no common punctuation."""
    return F.regexp_replace(text, IGNORED, "")


def strip_artifacts(text: Column) -> Column:
    """Without a model's thinking blocks."""
    for block in THINKING:
        text = F.regexp_replace(text, block, "")
    return strip(text)


def strip_fences(text: Column) -> Column:
    """Without one Markdown fence around the whole."""
    t = F.regexp_replace(strip(text), FENCE_OPENS, "")
    return strip(F.regexp_replace(t, FENCE_CLOSES, ""))


def count_numbered(text: Column) -> Column:
    """Numbered items: an optional bullet, bold mark or Q, digits, and a closing mark."""
    return F.regexp_count(text, F.lit(NUMBERED))


def has_mojibake(text: Column) -> Column:
    return text.rlike(f"[{MOJIBAKE}]")


def quality_context(raw: Column, merged: Column, sure: Column, uncertain: Column) -> Column:
    """Quality note of a page; absent numbers are named unknown."""
    said = lambda c: F.coalesce(c.cast("string"), F.lit(UNKNOWN))
    return F.concat(
        F.lit("OCR 品質資訊：\n- 原始候選數："), said(raw), F.lit("\n- 合併區域數："), said(merged),
        F.lit("\n- 高信心區域數："), said(sure), F.lit("\n- 低信心或候選分歧區域數："), said(uncertain),
    )


def percent(rate: Column) -> Column:
    return F.when(rate.isNull(), "N/A").otherwise(F.format_string("%.2f%%", rate * 100))


def markdown_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def stem_of(path: Column, *suffixes: str) -> Column:
    """File name without folder, extension and one of the stage suffixes."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.regexp_replace(name, f"(?:{'|'.join(suffixes)})$", "") if suffixes else name
