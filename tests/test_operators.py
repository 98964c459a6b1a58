import json
from pathlib import Path
from unittest import mock

import pytest
from pyspark.sql import functions as F

from lectern.functions import metrics
from lectern.operators import correction, documents, errors, evaluate, fusion
from lectern.sources import files, sinks


def test_directories_to_rates(spark, tmp_path):
    for folder, name, body in (("gt", "a.txt", "﻿甲乙丙"), ("b", "a_paddleocr_baseline.txt", "甲丁丙"), ("e", "a_merged_ocr.txt", "甲乙"), ("l", "a_corrected.txt", "甲乙丙\n")):
        (tmp_path / folder).mkdir()
        Path(tmp_path, folder, name).write_text(body, encoding="utf-8")
    truth = files.ground_truth(spark, str(tmp_path / "gt"))
    preds = files.predictions(spark, {"paddleocr_baseline": str(tmp_path / "b"), "ensemble_only": str(tmp_path / "e"), "ensemble_llm": str(tmp_path / "l")})
    evaluate.check_complete(truth, preds)
    agg = evaluate.aggregate(evaluate.edit_statistics(truth, preds, split=True))
    got = {r["method"]: r for r in agg.where("profile = 'strict'").collect()}
    assert got["paddleocr_baseline"]["micro_cer"] == pytest.approx(1 / 3) and got["ensemble_only"]["deletions"] == 1
    assert evaluate.improvement(agg, "paddleocr_baseline", "ensemble_llm").first()["relative_reduction"] == 1
    assert "| strict |" in sinks.markdown_table(agg.select("profile", "method", "edits"))
    with pytest.raises(FileNotFoundError):
        evaluate.check_complete(truth, preds.where("method <> 'ensemble_llm'"))
    with pytest.raises(ValueError, match="empty"):
        evaluate.check_complete(spark.createDataFrame([("x", " \n")], "stem string, text string"), preds)


def test_macro_differs_from_micro_and_clamps(spark):
    truth = spark.createDataFrame([("a", "a"), ("b", "abcdefghij")], "stem string, text string")
    preds = spark.createDataFrame([("a", "m", "abcdef"), ("b", "m", "abcdefghij")], "stem string, method string, text string")
    r = evaluate.aggregate(evaluate.edit_statistics(truth, preds)).where("profile = 'strict'").first()
    assert (r["macro_cer"], r["macro_character_accuracy"]) == (2.5, 0.5) and r["micro_cer"] == pytest.approx(5 / 11)


def test_errors(spark):
    rows = [("a", "軟體", "软件", "軟體"), ("b", "法律", "法津", "法律"), ("c", "法律原則", "法律", "法律原則"), ("d", "法律", "法律", "法律新增"), ("e", "法律", "法律", "法津")]
    got = errors.error_details(spark.createDataFrame(rows, "stem string, reference string, raw string, corrected string"), {"软件": "軟體"})
    assert {(r["stem"], r["error_type"], r["success"]) for r in got.collect()} == {("a", errors.MIXED, "是"), ("b", errors.SIMILAR, "是"), ("c", errors.LOST, "是"), ("d", errors.INVENTED, "否")}
    assert [r["success"] for r in errors.summarize(got.where("stem = 'z'")).orderBy("ord").collect()] == ["不適用"] * 3 + ["是（未偵測）"]


def box(k, text, conf, x1, y1, x2, y2, source="document_full"):
    return ("p", 0, k, text, conf, float(x1), float(y1), float(x2), float(y2), source)


CANDIDATES = "stem string, pass_ord int, ord int, text string, confidence double, x1 double, y1 double, x2 double, y2 double, source string"


def test_fusion(spark):
    rows = [box(0, "abc", 0.9, 0, 0, 100, 20), box(1, "abd", 0.5, 2, 5, 99, 24, "blue_gray_full"), box(2, "abc", 0.7, 1, 1, 100, 20, "binary_full"), box(3, "z", 0.5, 0, 200, 90, 220), box(4, "top", 0.8, 300, 0, 400, 20)]
    merged = fusion.merge_regions(fusion.group_regions(spark.createDataFrame(rows, CANDIDATES)))
    got = [(r["id"], r["text"], len(r["alternatives"])) for r in merged.orderBy("id").collect()]
    assert got == [(1, "abc", 2), (2, "top", 1), (3, "z", 1)]
    assert {r["text"] for r in fusion.clean_regions(merged).collect()} == {"abc", "top"}


def test_extraction_edges(spark):
    schema = "stem string, source string, rec_texts array<string>, rec_scores array<double>, rec_boxes array<array<double>>, x_offset int, y_offset int, tile_width int, tile_height int, image_width int, image_height int"
    boxes = [[10.0, 6.0, 50.0, 30.0], [10.0, 6.01, 50.0, 30.0], [10.0, 40.0, 50.0], [10.0, 40.0, 50.0, 60.0], [9.0, 9.0, 9.0, 20.0]]
    rows = [("p", "s", ["a", " b ", "c", "d", "e", "extra"], [0.9, 0.25, 0.9, 0.249999, 0.9], boxes, 100, 50, 200, 100, 900, 400)]
    got = fusion.candidate_rows(spark.createDataFrame(rows, schema)).collect()
    assert [(r["text"], r["x1"], r["y1"]) for r in got] == [("b", 110.0, 56.01)]


def test_offsets(spark):
    r = spark.range(1).select(*[fusion.offsets(F.lit(h), F.lit(t), F.lit(o)).alias(f"c{k}") for k, (h, t, o) in enumerate([(100, 520, 200), (1160, 520, 200), (700, 520, 200), (5, 2, 9)])]).first()
    assert list(r) == [[0], [0, 320, 640], [0, 180], [0, 1, 2, 3]]


def test_correction_guards_and_summary(spark):
    pages = spark.createDataFrame([("a", "one line\nsecond line"), ("b", None)], "stem string, text string")
    got = {r["stem"]: r for r in correction.correct(pages, lambda m: "x" * 500).collect()}
    assert got["a"]["corrected_text"] == "one line\nsecond line" and not got["a"]["used_llm"]
    got = {r["stem"]: r for r in correction.correct(pages, lambda m: m[-1]["content"].split("\n\n", 1)[1].upper()).collect()}
    assert got["a"]["corrected_text"] == "ONE LINE\nSECOND LINE" and got["a"]["used_llm"]
    assert correction.summarize(pages.where("stem = 'a'"), None).first()["validation_errors"] == []


def test_quiz_is_repaired(spark):
    def client(messages):
        asked = messages[0]["content"].split("三級標題")[-1]
        names = [n for n in (*documents.QUESTIONS, *documents.ANSWERS) if n in asked]
        if len(names) == 2 and "前一次" not in messages[0]["content"]:
            names = names[:1]  # leaves one section for the repair
        return "\n".join(f"## {n}\n" + "\n".join(f"{k}. q" for k in range(1, 6)) for n in names)

    r = correction.quiz(spark.createDataFrame([("a", "## 重點摘要\nx")], "stem string, summary string"), client, repairs=3).first()
    assert r["validation_errors"] == []
    assert all(s in r["quiz"] for s in documents.QUESTIONS)


def test_quiz_asks_once_a_round(spark, tmp_path):
    log = tmp_path / "calls"

    def client(messages):
        with log.open("a") as f:
            f.write("x\n")
        if "壞" in messages[-1]["content"] + messages[0]["content"]:
            raise KeyError("choices")
        return "\n".join(f"## {n}\n" + "\n".join(f"{k}. q" for k in range(1, 6)) for n in (*documents.QUESTIONS, *documents.ANSWERS))

    one = lambda said: correction.quiz(spark.createDataFrame([("a", f"## 重點摘要\n{said}")], "stem string, summary string"), client, repairs=3).collect()
    assert one("x")[0]["validation_errors"] == [] and len(log.read_text().split()) == 1  # all there after the first answer
    log.unlink()
    assert one("壞")[0]["validation_errors"] != [] and len(log.read_text().split()) == 5


def test_correction_sees_evidence_and_rebuilds_the_whole(spark, tmp_path):
    region = {"id": 1, "text": "法津", "confidence": 0.5, "source": "a", "alternatives": [{"text": "法律", "confidence": 0.4, "source": "b"}]}
    (tmp_path / "a_merged_ocr.json").write_text(json.dumps({"statistics": {"raw_candidate_count": 7}, "clean_results": [region]}), encoding="utf-8")
    seen = files.evidence(spark, str(tmp_path))
    pages = spark.createDataFrame([("a", "法津"), ("b", "one line")], "stem string, text string")

    def client(m):
        said = m[-1]["content"].split("\n\n", 1)[1]
        if "第二階段" in m[0]["content"]:
            return {"法律": "法律。", "ONE LINE": "ONE LINE " * 9}[said]
        return "法律" if "- 法律 (信心 0.40, 來源 b)" in said else said.upper()

    got = {r["stem"]: r["corrected_text"] for r in correction.correct(pages, client, evidence=seen).collect()}
    assert got == {"a": "法律。", "b": "ONE LINE"}  # the second rebuilt text is too long
    said = correction.summarize(pages, lambda m: "## 本頁主題\n" + ("noted" if "原始候選數：7" in m[-1]["content"] and "區域數：1" in m[-1]["content"] else "unknown" if "候選數：未知" in m[-1]["content"] else "none"), evidence=seen)
    got = {r["stem"]: r["summary"] for r in said.collect()}
    assert "noted" in got["a"] and "unknown" in got["b"]


def test_splits_of_whole_texts_come_from_bounds(spark):
    """Forced splits beside ones that need an alignment, in one batch; the long text's would need 10 ** 11 cells."""
    t = "the quick bath is not here, " * 12_000
    rows = [("long", "a", t.replace("e", "")), ("long", "b", t.replace("a", "@")), ("short", "a", "axcd"), ("short", "b", "")]
    truth = spark.createDataFrame([("long", t), ("short", "abc")], "stem string, text string")
    f = evaluate.edit_statistics(truth, spark.createDataFrame(rows, "stem string, method string, text string"), split=True).where("profile = 'strict'")
    got = {(r["stem"], r["method"]): (r["substitutions"], r["deletions"], r["insertions"], r["edits"]) for r in f.collect()}
    assert got == {("long", "a"): (0, 36_000, 0, 36_000), ("long", "b"): (12_000, 0, 0, 12_000), ("short", "a"): (1, 0, 1, 2), ("short", "b"): (0, 3, 0, 3)}


def test_errors_of_long_documents(spark):
    """An error at the end of texts that agree otherwise, longer than a search of windows or cells could take."""
    t = "".join(chr(0x4E00 + k * k % 4999) for k in range(30_000))
    rows = [("a", t + "软件", t + "軟體", t + "軟體"), ("b", t + "【法律原則】", t + "【法律】", t + "【法律原則】"), ("c", t, t, t + "新增"), ("d", None, None, None)]
    with mock.patch.object(metrics._Gestalt, "_common", side_effect=AssertionError):
        assert [e["tag"] for _, *texts in rows[:3] for e in metrics.errors_of(*texts)] == ["replace", "delete", "insert"]
    details = errors.error_details(spark.createDataFrame(rows, "stem string, reference string, raw string, corrected string"), {"軟體": "软件"})
    assert sorted(map(tuple, details.drop("ord").collect())) == [
        ("a", "繁簡混用", "GT「软件」", "軟體", "軟體", "否"), ("b", "缺字", "GT「原則」", "∅", "原則", "是"), ("c", "LLM hallucination", "GT「∅」", "∅", "新增", "否"),
    ]
    assert details._jdf.queryExecution().executedPlan().toString().count("_errors(") == 1


def test_summary_reads_each_pair_once(spark, tmp_path):
    from lectern.plans import registry

    rows = [(k, "some text " * 300, "en", "s") for k in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["error_summary"](spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("_errors(") == 1
    assert [(r["ord"], r["example"].split("：")[0], r["success"]) for r in df.orderBy("ord").collect()] == [(0, "0", "是"), (1, "1", "是"), (2, "2", "是"), (3, "3", "否")]
