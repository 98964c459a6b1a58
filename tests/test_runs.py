"""Files, reports, prompts and checks of a run, in small folders."""

import json
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from lectern import __main__ as cli
from lectern.operators import correction, documents, prompts
from lectern.sources import files, sinks


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode() if isinstance(text, str) else text)


def test_reports_of_an_evaluation(spark, tmp_path, capsys):
    for stem, ref, raw, fixed in (("p1", "軟體與法律", "软件與法律", "軟體與法律"), ("p2", "法律", "法津", "法律")):
        put(tmp_path, f"truth/{stem}.txt", "﻿" + ref)
        put(tmp_path, f"base/{stem}_paddleocr_baseline.txt", raw)
        put(tmp_path, f"llm/{stem}_corrected.txt", fixed)
    cli.main(["evaluate", "--ground-truth", str(tmp_path / "truth"), "--paddleocr-baseline", str(tmp_path / "base"), "--ensemble-llm", str(tmp_path / "llm"), "--output", str(tmp_path / "out")])
    said = capsys.readouterr().out
    assert "## Rates" in said and "## Improvement" in said
    part = next(f for f in (tmp_path / "out/per_document").glob("part-*.csv") if b"p1" in f.read_bytes())
    head = part.read_bytes().decode("utf-8").splitlines()[0]
    assert head == "﻿" + ",".join(sinks.PER_DOCUMENT) and len(sinks.PER_DOCUMENT) == 13
    errors = "".join(f.read_text(encoding="utf-8") for f in sorted((tmp_path / "out/error_analysis").glob("part-*.csv")))
    assert "Error Type,Example,Raw OCR,Corrected,是否成功" in errors and "相似字誤認" in errors


def test_setting_columns(spark, tmp_path):
    rows = spark.createDataFrame([("strict", "a", 0.5, 0.5, 0.0, None)], "profile string, setting_id string, cer double, character_accuracy double, delta_cer_vs_baseline double, delta_cer_vs_parent double")
    sinks.write_settings(rows, spark.createDataFrame([("a", "A", "first")], "setting_id string, setting string, description string"), str(tmp_path / "s"))
    text = max((f.read_text(encoding="utf-8-sig") for f in (tmp_path / "s").glob("part-*.csv")), key=len)
    assert text.splitlines() == [",".join(sinks.PER_SETTING), "strict,A,a,0.5,50.0,0.5,50.0,0.0,,first"]


def test_images_are_decoded(spark, tmp_path):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + bytes([255, 0, k]) * 3 for k in range(2))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    put(tmp_path, "i/page.png", png)
    got = files.pixels(spark, str(tmp_path / "i")).first()
    assert (got["stem"], got["height"], got["width"], got["channels"]) == ("page", 2, 3, 3) and bytes(got["data"][:3]) == bytes([0, 0, 255])
    assert files.images(spark, str(tmp_path / "i")).first()["stem"] == "page"
    put(tmp_path, "i/broken.png", "no image")
    with pytest.raises(Exception, match="no image"):
        files.pixels(spark, str(tmp_path / "i")).collect()


QUIZ = "\n".join(f"### {q}\n" + "\n".join(f"{k}. x" for k in range(1, 6)) for q in documents.QUESTIONS) + "\n" + "\n".join(f"### {a}\n1. y" for a in documents.ANSWERS)


def test_checks_and_resume(spark, tmp_path, capsys):
    region = {"id": 1, "text": "x", "confidence": 0.9, "bbox": [0, 0, 1, 1], "source": "s", "alternatives": []}
    for stem in ("good", "bad"):
        put(tmp_path, f"02_ocr/ensemble/{stem}_merged_ocr.txt", "text")
        put(tmp_path, f"02_ocr/ensemble/{stem}_merged_ocr.json", json.dumps({"clean_results": [region]}))
        put(tmp_path, f"03_llm_correction/{stem}_corrected.txt", "text" if stem == "good" else " ")
        put(tmp_path, f"03_llm_correction/{stem}_corrected.json", json.dumps({"used_llm": True}))
        put(tmp_path, f"05_summary/{stem}_summary.md", "\n".join(f"## {s}\nx" for s in documents.SUMMARY_SECTIONS))
        put(tmp_path, f"05_summary/{stem}_summary.json", json.dumps({"used_llm": True}))
    put(tmp_path, "06_quiz/good_quiz.md", QUIZ)
    with pytest.raises(SystemExit) as stop:
        cli.main(["check", "--root", str(tmp_path)])
    said = capsys.readouterr().out
    assert stop.value.code == 1 and "| bad | no corrected text |" in said and "| good |" not in said
    cli.main(["resume", "--root", str(tmp_path)])
    assert capsys.readouterr().out.strip().splitlines()[2:] == ["| bad | quiz_md |"]


def test_models_are_asked_in_full(spark):
    seen = []
    pages = spark.createDataFrame([("p", "第一行\n第二行")], "stem string, text string")
    msgs = pages.select(prompts.correction(F.col("text"), F.lit(1), F.lit(2)).alias("c"), prompts.reconstruction(F.col("text")).alias("r"), prompts.quiz_repair(F.col("text"), F.array(F.lit("簡答題")), 5).alias("q")).first()
    assert "必須原樣保留" in msgs["c"][0]["content"] and "1／2" in msgs["c"][1]["content"] and "不得新增說明標記" in msgs["r"][0]["content"]
    assert "【待核對" not in msgs["c"][0]["content"] + msgs["r"][0]["content"] and "簡答題恰好 5 題" in msgs["q"][0]["content"] and "單選題恰好" not in msgs["q"][0]["content"]

    def client(messages):
        return "软件：" + messages[0]["content"][-60:]

    asked = correction.ask(pages.withColumn("messages", prompts.reconstruction(F.col("text"))), client, grounded=True, table={"软件": "軟體"})
    out = asked.first()["output"]
    assert out.startswith("軟體：") and "不要加註記" not in seen and "不得補充、推論或新增" in prompts.GROUNDED and out.endswith(prompts.GROUNDED[-10:])


def test_lists_of_models():
    files.check_model("a", {"models": [{"name": "a"}, {"model": "b"}, {}]})
    with pytest.raises(RuntimeError, match="a, b"):
        files.check_model("c", {"models": [{"name": "a"}, {"model": "b"}]})
    assert files.is_local("http://127.0.0.1:1/") and not files.is_local("https://example.org")


def test_media_of_a_run(spark):
    shown = spark.createDataFrame([("p", "binary", "x", "/v/b.jpg")], "stem string, key string, label string, path string")
    runs = spark.createDataFrame([("p", "/d/p.png"), ("q", None)], "stem string, original string")
    of = lambda s, k: [r["path"] for r in files.media(shown, runs, s, k).collect()]
    assert of("p", "original") == ["/d/p.png"] and of("p", "binary") == ["/v/b.jpg"] and of("q", "original") == [] == of("p", "none")


def test_sections_take_linear_time(spark):
    def seconds(k):
        text = "\n".join(f"## {documents.SUMMARY_SECTIONS[i % 7]}\nline {i}\n" for i in range(k))
        began = time.time()
        d = spark.createDataFrame([(text,)], "t string")
        got = d.select(F.size(documents.level_two_sections(F.col("t"))).alias("n"), documents.normalize_summary(F.col("t")).alias("s")).first()
        assert got["n"] == k and f"line {k - 1}\n" in got["s"] + "\n"
        return time.time() - began

    seconds(10)
    few, many = seconds(1000), seconds(8000)
    assert many < 16 * few + 4


def test_found_paths_are_not_broadcast(spark):
    rows = spark.range(20).select("id", F.array(F.format_string("/a/%d", "id"), F.format_string("/b/%d", "id")).alias("c"))
    got = files.first_existing(rows, ["id"], "c", spark.range(10).select(F.format_string("/b/%d", "id").alias("path")))
    assert {r["id"]: r["path"] for r in got.collect()} == {k: f"/b/{k}" for k in range(10)}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
