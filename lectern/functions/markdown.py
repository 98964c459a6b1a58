"""Markdown of summaries and quizzes as HTML.

Lines are classed once (blank, table, heading, item, text); every run of like lines is one block.
Inline marks are paired in one scan of a block's text; list tags come from the nesting of neighbouring items.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator
from itertools import accumulate, chain, groupby, islice, pairwise, repeat

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RULE = re.compile(r"\s*\|*\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|*\s*")
HEADING = re.compile(r"(#{1,6})\s+(.+)")
ITEM = re.compile(r"(\s*)(?:([-*+])|\d+\.)\s+(.+)")
# The tags of the inline marks.
TAGS = {
    "`": ("<code>", "</code>"),
    "**": ("<strong>", "</strong>"),
    "$": ('<span class="math">', "</span>"),
}
MARKS = re.compile(r"`|\$|\*+")


def tags(t: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, tag) of the marks that have a partner, found in one scan.

    A mark closes the open one of its kind unless nothing stands between them, and opens the next otherwise. Of a
    run of asterisks the first two may close and the last two open; a lone one ends what was open. Marks of
    different kinds may cross.
    """
    waiting: dict[str, int] = {}
    for run in MARKS.finditer(t):
        lo, hi = run.span()
        mark = "**" if t[lo] == "*" else t[lo]
        opened = waiting.pop(mark, None)
        if opened is not None and hi - lo >= len(mark) and lo - opened > len(mark):
            yield opened, opened + len(mark), TAGS[mark][0]
            yield lo, lo + len(mark), TAGS[mark][1]
            lo += len(mark)
        if hi - lo >= len(mark):
            waiting[mark] = hi - len(mark)


def literal(t: str) -> str:
    return html.escape(t).replace(r"\rightarrow", "→")


def inline(t: str) -> str:
    out, done = [], 0
    for lo, hi, tag in sorted(tags(t)):
        out += literal(t[done:lo]), tag
        done = hi
    return "".join([*out, literal(t[done:])])


def classed(lines: list[str]) -> Iterator[tuple[str, int, str]]:
    """(class, number of its table or heading, line): a table opens above a rule and takes all rows that follow."""
    table = 0  # lines of the open table so far
    for k, line in enumerate(lines):
        bare = line.strip()
        row = bare.startswith("|")
        if table == 1 or (table and row):
            table += 1
            yield "table", start, line
            continue
        table = 0
        if not bare:
            yield "blank", 0, line
        elif row and k + 1 < len(lines) and RULE.fullmatch(lines[k + 1]):
            table, start = 1, k
            yield "table", start, line
        elif HEADING.match(bare):
            yield "heading", k, bare
        elif ITEM.match(line):
            yield "item", 0, line
        else:
            yield "text", 0, bare


def table_row(line: str, tag: str) -> list[str]:
    return [f"<{tag}>{inline(c.strip())}</{tag}>" for c in line.strip().strip("|").split("|")]


def table_block(lines: list[str]) -> str:
    """Rows are filled up or cut to the width of the head; the second line is the rule."""
    head = table_row(lines[0], "th")
    body = ("".join(islice(chain(table_row(line, "td"), repeat("<td></td>")), len(head))) for line in lines[2:])
    return f"<table><thead><tr>{''.join(head)}</tr></thead><tbody>{''.join(f'<tr>{row}</tr>' for row in body)}</tbody></table>"


def nested(above: tuple[str, ...], item: tuple[str, str | None, str]) -> tuple[str, ...]:
    """Kinds of the lists around an item, outermost first, given those around the item above it.

    Four columns of indent are one level; a list of the other kind at its level takes the open one's place.
    """
    indent, bullet, _ = item
    kind, depth = "ul" if bullet else "ol", (len(indent) + 3 * indent.count("\t")) // 4 + 1
    kept = above[: depth - 1] if above[depth - 1 : depth] != (kind,) else above[:depth]
    return kept + (kind,) * (depth - len(kept))


def list_block(lines: list[str]) -> Iterator[str]:
    """Items, with the tags by which the lists around neighbours differ between them."""
    items = [ITEM.match(line).groups() for line in lines]
    around = [*accumulate(items, nested, initial=()), ()]
    for k, (above, here) in enumerate(pairwise(around)):
        same = next((i for i, (a, b) in enumerate(zip(above, here)) if a != b), min(len(above), len(here)))
        yield from (f"</{kind}>" for kind in reversed(above[same:]))
        yield from (f"<{kind}>" for kind in here[same:])
        if k < len(items):
            yield f"<li>{inline(items[k][2])}</li>"


def render(markdown: str) -> str:
    out: list[str] = []
    for (kind, _), run in groupby(classed(re.split(r"\r\n|\r|\n", markdown)), key=lambda x: x[:2]):
        lines = [x[2] for x in run]
        if kind == "table":
            out.append(table_block(lines))
        elif kind == "heading":
            marks, said = HEADING.match(lines[0]).groups()
            out.append(f"<h{len(marks)}>{inline(said)}</h{len(marks)}>")
        elif kind == "item":
            out.extend(list_block(lines))
        elif kind == "text":
            out.append(f"<p>{inline(' '.join(lines))}</p>")
    return "\n".join(out)


def to_html(markdown: Column) -> Column:
    """HTML of a Markdown column; null stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(render, na_action="ignore")

    return run(markdown)
