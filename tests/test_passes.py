import difflib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern import __main__ as cli
from lectern.functions import markdown, metrics
from lectern.operators import checks, fusion, passes
from lectern.sources import files
from lectern.streaming import arrivals


def test_markdown():
    said = "# A & b\ntext `x`\nmore **y** $z$\n- one\n    1. deep\n- two\n1. other\nafter\n\n| h | i |\n|---|:---:|\n| 1 |\n|---|\nend \\rightarrow"
    assert markdown.render(said).split("\n") == [
        "<h1>A &amp; b</h1>", '<p>text <code>x</code> more <strong>y</strong> <span class="math">z</span></p>', "<ul>", "<li>one</li>", "<ol>", "<li>deep</li>", "</ol>", "<li>two</li>", "</ul>",
        "<ol>", "<li>other</li>", "</ol>", "<p>after</p>", "<table><thead><tr><th>h</th><th>i</th></tr></thead><tbody><tr><td>1</td><td></td></tr><tr><td>---</td><td></td></tr></tbody></table>", "<p>end →</p>",
    ]
    assert markdown.render("") == "" and markdown.render("| no table |\nx") == "<p>| no table | x</p>" and markdown.render("## a\n## b") == "<h2>a</h2>\n<h2>b</h2>"


def test_inline_marks():
    said = {
        "**a `b** c`": "<strong>a <code>b</strong> c</code>", "``a`": "`<code>a</code>", "***a****b**": "*<strong>a</strong><strong>b</strong>", "**a*b**": "**a*b**",
        "$$x$ < y$": '$<span class="math">x</span> &lt; y$', "** `": "** `", "": "", "`\\rightarrow`": "<code>→</code>",
    }
    assert {t: markdown.inline(t) for t in said} == said


def test_nested_lists():
    said = "    - a\n1. b\n\t\t2. c\n    - d"
    assert markdown.render(said).split("\n") == [
        "<ul>", "<ul>", "<li>a</li>", "</ul>", "</ul>", "<ol>", "<li>b</li>", "<ol>", "<ol>", "<li>c</li>", "</ol>", "</ol>", "<ul>", "<li>d</li>", "</ul>", "</ol>",
    ]


def test_html_column(spark):
    got = spark.createDataFrame([("# a",), (None,), ("",)], "t string").select(markdown.to_html(F.col("t")).alias("h")).collect()
    assert [r["h"] for r in got] == ["<h1>a</h1>", None, ""]


def test_settings_of_passes():
    assert passes.names(None, ("a",)) == ("a",) and passes.names(" x, ,y", ()) == ("x", "y")
    assert passes.sizes("5:2,,7:1", (), 2) == ((5, 2), (7, 1)) and passes.sizes("1:2:3:4", (), 4) == ((1, 2, 3, 4),)
    for bad in ("5", "", "1:2:3"):
        with pytest.raises(ValueError):
            passes.sizes(bad, (), 2)
    with pytest.raises(ValueError):
        passes.names(" ,", ("a",))


def engine(part):
    """Finds bright pixels: one box of ten by ten around each."""
    at = np.argwhere((part if part.ndim == 2 else part[..., 0]) == 255)
    return {"res": {"rec_texts": [f"t{part.shape[0]}" for _ in at], "rec_scores": [0.9] * len(at), "rec_boxes": [[x - 5, y - 5, x + 5, y + 5] for y, x in at.tolist()]}}


def test_passes_cut_tiles_where_the_columns_say(spark):
    page = np.zeros((90, 120), np.uint8)
    page[45, 60] = 255
    images = spark.createDataFrame([("p", v, 90, 120, bytearray(page.tobytes())) for v in ("document", "blue_gray", "blue_mask")], passes.IMAGES)
    plan = passes.Plan(full=("document", "absent"), tiles=((40, 20),), grids=((50, 10, 40, 20),))
    got = passes.recognise(images, engine, plan).collect()
    ys, xs = ([*spark.range(1).select(fusion.offsets(*map(F.lit, a))).first()[0]] for a in ((90, 40, 20), (120, 50, 10)))
    assert [r["y_offset"] for r in got if r["source"] == "blue_gray_tile_40"] == ys
    assert [(r["y_offset"], r["x_offset"]) for r in got if r["source"] == "blue_gray_grid_50x40"] == [(y, x) for y in ys for x in xs]
    found, merged, clean = passes.ensemble(images, engine, plan)
    centres = {((r["x1"] + r["x2"]) / 2, (r["y1"] + r["y2"]) / 2) for r in found.collect()}
    assert centres == {(60.0, 45.0)}
    assert [(r["id"], len(r["alternatives"])) for r in merged.collect()] == [(1, 2)] and clean.count() == 1


def test_single_passes(spark):
    page = np.zeros((20, 20, 3), np.uint8)
    page[10, 10] = 255
    rows = [("p", v, 20, 20, bytearray(page.tobytes())) for v in ("document", "blue_ink", "line_removed")] + [("q", v, 20, 20, bytearray(1200)) for v in ("document", "blue_ink", "line_removed")]
    images = spark.createDataFrame(rows, passes.IMAGES)
    got = {(r["stem"], r["method"]): r["text"] for r in passes.single_pass(images, engine).collect()}
    assert got["p", "line_removal"] == "t20" and got["q", "line_removal"] == "" and len(got) == 6
    with pytest.raises(ValueError, match="missing variants"):
        passes.single_pass(images.where("variant <> 'blue_ink'"), engine)


def test_violations(spark):
    schema = "stem string, ocr_text string, clean_region_count int, corrected_text string, corrected_llm boolean, summary_errors array<string>, summary_llm boolean, quiz_errors array<string>, question_counts map<string,int>"
    full = dict.fromkeys(("multiple_choice", "true_false", "short_answer"), 5)
    runs = spark.createDataFrame([("good", "a", 1, "a", True, [], True, [], full), ("bad", " \n", 0, "a", False, ["x", "y"], True, None, {**full, "true_false": 4}), ("none", *[None] * 8)], schema)
    got = {}
    for r in checks.violations(runs).collect():
        got.setdefault(r["stem"], []).append(r["problem"])
    assert got["bad"] == ["no recognised text", "no clean regions", "summary: x; y", "correction without the model", "quiz: true_false has 4 of 5 questions"]
    assert "good" not in got and len(got["none"]) == 8
    assert checks.violations(runs.where("stem = 'none'"), expect_llm=False, expect_quiz=False).count() == 3


def test_overlaps_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{k % 3}", k, int(a := rng.integers(0, 300)), int(a + rng.integers(0, 150))) for k in range(120)]
    spans = spark.createDataFrame(rows, "stem string, id long, start long, end long")
    got = {(r["id"], r["piece"], r["start"], r["end"]) for r in checks.overlaps(spans, spans, 16).collect()}
    assert got == {(i, j, max(a, c), min(b, d)) for s, i, a, b in rows for t, j, c, d in rows if s == t and max(a, c) < min(b, d)}


def test_opcodes_are_those_of_the_library(spark):
    rng = np.random.default_rng(2)
    rows = [("".join(rng.choice(list("ab中"), 12)), "".join(rng.choice(list("ab中"), 11))) for _ in range(80)] + [("", ""), ("a", "")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", metrics.opcodes(F.col("a"), F.col("b")).alias("o")).collect()
    for r in got:
        assert [tuple(o) for o in r["o"]] == difflib.SequenceMatcher(None, r["a"], r["b"], autojunk=False).get_opcodes()


def test_manifests_evidence_and_arrivals(spark, tmp_path):
    Path(tmp_path, "a_manifest.json").write_text('{"image_stem": "a", "document_shape": {"height": 3, "width": 2}, "variants": {"document": "d.png", "blue_mask": "m.png"}}', encoding="utf-8")
    Path(tmp_path, "b_merged_ocr.json").write_text('{"clean_results": [], "merged_results": [{"id": 1, "text": "x", "confidence": 0.5, "alternatives": []}]}', encoding="utf-8")
    Path(tmp_path, "c_merged_ocr.json").write_text("{ not json", encoding="utf-8")
    m = files.manifests(spark, str(tmp_path))
    assert m.first()["document_shape"]["height"] == 3 and [tuple(r) for r in files.variants(m).collect()] == [("a", "document", "d.png")]
    got = {r["stem"]: r["regions"] for r in files.evidence(spark, str(tmp_path)).collect()}
    assert got["b"][0]["text"] == "x" and got["c"] is None
    q = arrivals.volume_by_window(arrivals.arriving_texts(spark, str(tmp_path), ".json")).writeStream.format("memory").queryName("volume").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("volume").agg(F.sum("pages")).first()[0] == 3


def test_command_line(spark, tmp_path):
    for folder, name, body in (("gt", "a.txt", "abc"), ("b", "a_paddleocr_baseline.txt", "abd"), ("l", "a_corrected.txt", "abc")):
        (tmp_path / folder).mkdir()
        Path(tmp_path, folder, name).write_text(body)
    a = cli.parser().parse_args(["evaluate", "--ground-truth", f"{tmp_path}/gt", "--paddleocr-baseline", f"{tmp_path}/b", "--ensemble-llm", f"{tmp_path}/l", "--output", f"{tmp_path}/out"])
    got = {(r["profile"], r["method"]): r["edits"] for r in cli.rates(spark, a).collect()}
    assert got["strict", "paddleocr_baseline"] == 1 and got["strict", "ensemble_llm"] == 0
    cli.main(["correct", "--input", f"{tmp_path}/gt", "--output", f"{tmp_path}/c"])
    assert spark.read.json(f"{tmp_path}/c").first()["corrected_text"] == "abc"


def test_whole_documents_against_brute_force(spark, tmp_path):
    from lectern.plans import registry
    from tests.test_functions import reference_split

    rng = np.random.default_rng(5)
    texts = [" ".join("".join(rng.choice(list("abehnot中"), 4)) for _ in range(n)) for n in (1, 12, 13, 40, 90)]
    spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    fold = lambda t: t.translate(str.maketrans("ao", "@0"))
    made = {"paddleocr_baseline": lambda t: t.replace("e", ""), "ensemble_only": lambda t: fold(t) if "th" in t else None, "ensemble_llm": lambda t: t + " end"}
    bare = {"strict": str.strip, "no_whitespace": lambda t: "".join(t.split())}
    want = {(str(k), p, m): reference_split(bare[p](t), bare[p](f(t))) for k, t in enumerate(texts) for p in bare for m, f in made.items() if f(t) is not None}
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert {(r["stem"], r["profile"], r["method"]): r["edits"] for r in run("cer_per_document")} == {k: sum(v) for k, v in want.items()}
    totals = {(p, m): tuple(map(sum, zip(*[v for k, v in want.items() if k[1:] == (p, m)], strict=True))) for _, p, m in want}
    assert {(r["profile"], r["method"]): (r["substitutions"], r["deletions"], r["insertions"]) for r in run("edit_split")} == totals
    assert {(r["profile"], r["method"]): (r["document_count"], r["edits"]) for r in run("cer_micro_macro")} == {k: (sum(x[1:] == k for x in want), sum(v)) for k, v in totals.items()}
    assert {(r["lang"], r["source"], r["method"]): r["edits"] for r in run("cer_by_lang_source")} == {("en", "s", m): sum(v) for (p, m), v in totals.items() if p == "no_whitespace"}
    assert {r["stem"]: [tuple(o) for o in r["ops"]] for r in run("opcodes_of_edits")} == {str(k): difflib.SequenceMatcher(None, t, fold(t), autojunk=False).get_opcodes() for k, t in enumerate(texts)}
    assert {(r["stem"], r["method"]) for r in run("missing_predictions")} == {(str(k), "ensemble_only") for k, t in enumerate(texts) if "th" not in t}


def test_long_pairs_against_brute_force():
    from tests.test_functions import reference_split

    rng = np.random.default_rng(6)
    for k in range(300):
        a, b = ("".join(rng.choice(list("ab中 "), rng.integers(0, 25))) for _ in range(2))
        b = a.replace("a", "") if k % 3 == 0 else b
        want = reference_split(a, b)
        assert metrics.distance(a, b) == sum(want) and metrics.split_many([a], [b], 0) == [want]
        assert metrics._Gestalt(a, b, 0).get_opcodes() == difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def test_error_details_reads_the_table(spark, tmp_path):
    from lectern.plans import registry

    spark.createDataFrame([(1, "the quick bath", "en", "s"), (2, "no errors", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["error_details"](spark, str(tmp_path)).orderBy("stem", "ord").collect()
    assert [(r["stem"], r["error_type"], r["example"], r["raw_ocr"], r["corrected"], r["success"]) for r in got] == [("1", "缺字", "GT「t」", "∅", "t", "是"), ("1", "缺字", "GT「t」", "∅", "t", "是")]


def test_ablation_counts_each_pair_once(spark, tmp_path):
    from lectern.plans import registry

    spark.createDataFrame([(1, "the quick é bath", "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["ablation_deltas"](spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {r["setting_id"]: (r["edits"], r["delta_cer_vs_baseline"], r["delta_cer_vs_parent"]) for r in df.where("profile = 'no_whitespace'").collect()}
    each = round(1e6 / 13)
    assert got["raw_paddleocr"] == (1, 0, None) and got["line_removal"] == (1, 0, 0) and got["llm_correction"] == (0, -each, 0) and got["multi_variant_ensemble"] == (1, 0, 0)
