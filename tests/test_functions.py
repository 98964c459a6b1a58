import random
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import metrics, text
from lectern.operators import documents


def reference_split(a, b):
    """Full matrix and backtrace: match, substitution, deletion, insertion in that order."""
    n, m = len(a), len(b)
    d = [[max(i, j) if not i * j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = d[i - 1][j - 1] if a[i - 1] == b[j - 1] else 1 + min(d[i - 1][j - 1], d[i - 1][j], d[i][j - 1])
    s = x = y = 0
    i, j = n, m
    while i or j:
        if i and j and a[i - 1] == b[j - 1] and d[i][j] == d[i - 1][j - 1]:
            i, j = i - 1, j - 1
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            s, i, j = s + 1, i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            x, i = x + 1, i - 1
        else:
            y, j = y + 1, j - 1
    return s, x, y


def test_split_agrees_with_a_full_matrix():
    rng = random.Random(4)
    pairs = [("".join(rng.choices("ab中", k=rng.randint(0, 9))), "".join(rng.choices("ab中", k=rng.randint(0, 9)))) for _ in range(1500)]
    assert metrics.split_many(*zip(*pairs, strict=True)) == [reference_split(*p) for p in pairs]
    assert metrics.split_edits("abc", "axcd") == (1, 0, 1)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


def test_normalisation(spark):
    t = F.col("t")
    assert one(spark, text.normalize_text(t, False), " a\r\nb　") == "a\nb"
    assert one(spark, text.normalize_text(t, True), "甲 乙 丙\x1c") == "甲乙丙"
    assert one(spark, text.normalize_text(t, True), "ＡＢＣ") == "ＡＢＣ"
    assert one(spark, text.normalize_noise(t), "é ， \r\n x﻿") == "é，\nx"
    assert one(spark, text.normalize_noise(t), None) is None
    assert one(spark, text.count_numbered(t), "1. a\n- **Q2.** b\n3) c\nd 4.") == 3


def test_chunks_and_sections(spark):
    t = F.col("t")
    assert one(spark, documents.chunks(t, 5), "ab\ncd\nefghijk\nl") == ["ab", "cd", "efghijk", "l"]
    assert one(spark, documents.chunks(t, 6), "ab\ncd\n") == ["ab\ncd"]
    assert one(spark, documents.named_sections(t, ("重點摘要", "摘要")), "## 重點摘要\na\n**摘要：**\nb\n## 重點摘要\nc") == {"重點摘要": "c", "摘要": "b"}
    assert [s["title"] for s in one(spark, documents.level_two_sections(t), "x\n## A\n1\n## B\n2")] == ["A", "B"]
    assert one(spark, documents.validate_summary(documents.fallback_summary(t)), "a\nb") == []


@pytest.mark.parametrize(("out", "kept"), [("", "f"), ("x" * 44, "f"), ("x" * 45, "x" * 45), ("x" * 160, "x" * 160), ("x" * 161, "f")])
def test_guard(spark, out, kept):
    assert one(spark, metrics.guarded(F.col("t"), F.lit("s" * 100), F.lit("f")), out) == kept


def test_banded_distance_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choices("abc", k=rng.randint(2, 25)))
        b = list(a)
        for _ in range(rng.randint(0, 7)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "d"])
        a, b = sorted((a, "".join(b)), key=len, reverse=True)
        want = sum(reference_split(a, b))
        assert metrics.distance(a, b) == want
        for most in range(max(1, len(a) - len(b)), len(a)):
            assert metrics._within(a, b, metrics._places(a), most, rng.choice([1, 5, 64])) == (want if want <= most else None)


def test_bounds_that_meet():
    rng = random.Random(8)
    met = 0
    for k in range(3000):
        a = "".join(rng.choices("abc中😀", k=rng.randint(0, 12)))
        b = ["".join(rng.choices("abc中😀", k=rng.randint(0, 12))), a.replace("a", ""), a.replace("b", "d"), a + "x", a[: rng.randint(0, 12)] + a[rng.randint(0, 12) :], a.replace("ab", "b")][k % 6]
        want = reference_split(a, b)
        for x, y, split in ((a, b, want), (b, a, reference_split(b, a))):
            assert metrics._met(x, y) in (None, split) and metrics.distance(x, y) == sum(split) and metrics.split_many([x], [y], 0) == [split]
        met += metrics._met(a, b) is not None
        if k % 6 in (1, 3, 5):
            assert metrics._met(a, b) == want
    assert met > 1500


def test_whole_texts_in_linear_time():
    from unittest import mock

    rng = random.Random(9)
    t = "".join(rng.choices("abcdefghinot ,", k=400_000))
    with mock.patch.object(metrics, "_column", side_effect=AssertionError), mock.patch.object(metrics, "_within", side_effect=AssertionError):
        for b in (t.replace("e", ""), t.replace("th", "h"), t.replace("n", "m"), t.translate(str.maketrans("ao", "@0")), t + " end"):
            s, d, i = metrics.split_edits(t, b)
            assert (s, d, i) == (sum(x != y for x, y in zip(t, b, strict=True)) if len(t) == len(b) else 0, max(0, len(t) - len(b)), max(0, len(b) - len(t)))
            assert metrics.distance(t, b) == s + d + i


def test_forms_in_python_are_those_of_columns(spark):
    texts = [f" {c}a{c}{c} b\r\n\rc{c}" for c in map(chr, (*range(1, 0x3100), 0xFEFF, 0x1F600)) if not 0xD800 <= ord(c) < 0xE000]
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", text.normalize_text(t, False).alias("s"), text.normalize_text(t, True).alias("b"), text.normalize_text(t, False, False).alias("raw")).collect()
    assert all(text.evaluation_forms(r["t"]) == (r["s"], r["b"]) and text.evaluation_forms(r["t"], False)[0] == r["raw"] for r in rows)
    assert len(rows) == len(texts)


def test_facts_of_null_texts(spark):
    rows = spark.createDataFrame([(1, "a b", "ab"), (2, None, "ab"), (3, "ab", None)], "k int, r string, h string")
    got = {r["k"]: r["f"] for r in rows.select("k", metrics.edit_facts(F.col("r"), F.col("h"), True).alias("f")).collect()}
    assert tuple(got[1]["strict"]) == (3, 2, 1, 0, 1, 0) and tuple(got[1]["bare"]) == (2, 2, 0, 0, 0, 0)
    assert tuple(got[2]["bare"]) == (None, 2, None, 0, 0, 2) and tuple(got[3]["strict"]) == (2, None, None, 0, 2, 0)


def test_blocks_are_the_librarys():
    import difflib

    rng = random.Random(12)
    edits = (lambda t: t.translate(str.maketrans("ao", "@0")), lambda t: t.replace("th", "h"), lambda t: t.replace("q", "k"), lambda t: t + "x", lambda t: t[7:] + t[:5], lambda t: t.replace("a", "b", 2), lambda t: t.replace(" ", ""), lambda t: t, lambda t: t[::-1])
    for k in range(700):
        words = ["".join(rng.choices("athok0@b"[: rng.randint(2, 8)], k=rng.randint(1, 9))) for _ in range(rng.randint(1, 30))]
        t = "".join(rng.choices(words, k=rng.randint(0, 60))) + rng.choice(["", "q", "ab" * 40, "軟"])
        for a, b in ((t, edits[k % len(edits)](t)), (edits[k % len(edits)](t), t), (t + "法律", t + "法津新"), (t, "".join(rng.choices(words, k=30)))):
            want = difflib.SequenceMatcher(None, a, b, autojunk=False)
            for cells in (0, 1 << 14):
                got = metrics._Gestalt(a, b, cells)
                assert got.get_matching_blocks() == want.get_matching_blocks() and got.get_opcodes() == want.get_opcodes()


def test_blocks_of_texts_that_lost_a_character():
    """Matched along the runs between losses, without a search of all windows, also where lines and words come again."""
    import difflib
    from unittest import mock

    rng = random.Random(13)
    words = ["".join(rng.choices("abcdefghijklmnopqrsuvwxyz軟", k=rng.randint(1, 9))) for _ in range(400)]
    long = [[*rng.sample(words, 60), rng.choice(["the", "that", "thr"])] for _ in range(60)]
    t = "".join("".join(x) for x in [*long, *long[:20], ["y" * 70]])
    with mock.patch.object(metrics._Gestalt, "_common", side_effect=AssertionError), mock.patch.object(metrics._Gestalt, "find_longest_match", side_effect=AssertionError):
        blocks = metrics._Gestalt(t, t.replace("th", "h")).get_matching_blocks()
    assert blocks == difflib.SequenceMatcher(None, t, t.replace("th", "h"), autojunk=False).get_matching_blocks()
    tried = 0
    for k in range(1500):
        letters = ("th", "the ", "thé軟", "thea😀oscn")[k % 4]
        part = ["".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(rng.randint(1, 8))]
        a, often = "".join(rng.choices(part, k=rng.randint(1, 40))), rng.random() * 0.6
        b = a.replace("th", "h") if k % 3 else "".join(c for c in a if c != "t" or rng.random() > often)
        tried += metrics._Gestalt(a, b)._at_losses() is not None
        for cells, pairs in ((0, 1), (1 << 14, 1 << 18)):
            with mock.patch.object(metrics._Gestalt._at_losses, "__defaults__", (pairs,)):
                assert metrics._Gestalt(a, b, cells).get_opcodes() == difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    assert tried > 400


def test_errors_compare_only_texts_that_differ():
    from unittest import mock

    with mock.patch.object(metrics, "_ops", side_effect=AssertionError):
        assert metrics.errors_of("some text", "some text", "some text") == [] and metrics.errors_of("", "", "") == []
    with mock.patch.object(metrics, "_ops", wraps=metrics._ops) as made:
        assert [(e["tag"], e["g"], e["r"], e["c"], e["right"]) for e in metrics.errors_of("法律", "法津", "法律")] == [("replace", "律", "津", "律", True)]
    assert made.call_count == 1


def test_predictions_edit_plain_texts_as_they_are(spark):
    import unicodedata

    from lectern.plans import queries

    texts = {"1": "the boat eel", "2": "thé bôat è é àa the", "3": "", "4": "no 中 o", "5": "e"}
    s = spark.createDataFrame(list({**texts, "6": None}.items()), "stem string, text string")
    assert {r["stem"]: r["p"] for r in s.select("stem", queries.plain(F.col("text")).alias("p")).collect()} == {"1": True, "2": False, "3": True, "4": False, "5": True, "6": None}
    made = queries.predictions(s)
    got = {(r["stem"], r["method"]): r["text"] and unicodedata.normalize("NFC", r["text"]) for r in made.collect() if r["stem"] != "6"}
    whole = {k: unicodedata.normalize("NFC", t) for k, t in texts.items()}
    want = {(k, "paddleocr_baseline"): t.replace("e", "") for k, t in whole.items()} | {(k, "ensemble_llm"): t + " end" for k, t in whole.items()}
    assert got == want | {(k, "ensemble_only"): t.replace("a", "@").replace("o", "0") for k, t in whole.items() if "th" in t}
