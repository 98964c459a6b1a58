"""Nulls in any column, repeated rows and extra columns whose names the operators use themselves."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import bpe, chat, embeddings, mixing, ngram_join, pii, quality_rules, secrets, sharding, warc

CLASHING = ("row", "key", "node", "n", "id", "ids", "spans", "slot", "shard", "_t", "_w", "_text", "base", "token", "tokens", "score", "mark", "weight", "component", "payload", "pos")
TEXT = "Write to ann@mail.org now, " + " ".join(f"w{k}" for k in range(40))
ROWS = [(1, TEXT, None, "s"), (1, TEXT, None, "s"), (None, TEXT, "en", None), (2, None, "en", "s"), (3, "", None, None), (4, "a\n\n", "de", "s")]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return d.withColumns({c: F.lit("7") for c in CLASHING})


def test_join(docs):
    got = Counter(tuple(r) for r in ngram_join.jaccard_components(docs, words=5, percent=80).collect())
    assert got[1, 40, 1] == 2 and got[None, 40, None] == 1 and got[2, 0, 2] == got[3, 0, 3] == got[4, 1, 4] == 1


def test_join_marks_rows(docs):
    marked = docs.withColumn("mark", F.length("text").cast("long"))
    got = {(r["doc_id"], r["mark"]) for r in ngram_join.jaccard_components(marked, mark="mark").collect()}
    assert got == {(1, len(TEXT)), (None, len(TEXT)), (2, None), (3, 0), (4, 3)}


def test_rules(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, None), (None, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").withColumn("bad", F.lit(1))
    got = quality_rules.judge(docs, labels).collect()
    assert Counter((r["doc_id"], r["base_failed"]) for r in got) == {(1, False): 2, (None, False): 1, (2, True): 1, (3, True): 1, (4, True): 1}


def test_personal_data(docs):
    got = Counter((r["doc_id"], pii_text) for r in pii.find_spans(docs, ["doc_id"]).select("doc_id", pii.spelled(F.col("spans")).alias("s")).collect() for pii_text in [r["s"]])
    assert got == {(1, "email:9:21"): 2, (None, "email:9:21"): 1, (2, ""): 1, (3, ""): 1, (4, ""): 1}


def test_mixing(docs):
    got = mixing.calibrated(docs.withColumns({c: F.lit("x") for c in ("_kept", "_probability", "_tokens", "_topic", "_marks")})).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS)
    assert all(0 <= r["_probability"] <= 1 + 1e-9 for r in got)


def test_tokens(docs):
    got = bpe.encode(docs, bpe.vocabulary_path()).collect()
    assert Counter((r["doc_id"], len(r["ids"]) > 0) for r in got) == {(1, True): 2, (None, True): 1, (2, False): 1, (3, False): 1, (4, True): 1}


def test_secrets(spark, docs):
    assert secrets.scan(docs).count() == 0
    assert secrets.scan(docs.withColumn("text", F.concat("text", F.lit(' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"')))).count() == 5


def test_shards(docs):
    got = sharding.place(docs, "doc_id", ["a", "b"], 101).collect()
    assert len(got) == len(ROWS) and len({r["shard"] for r in got if r["doc_id"] == 1}) == 1


def test_archives(spark, tmp_path):
    rows = [(1, None, "x" * 200), (1, None, "x" * 200), (2, "", None), (3, "u", "x" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("7") for c in CLASHING})
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.captures(warc.transactions(warc.read_archives(spark, str(tmp_path / "w")))).collect()
    assert Counter((r["page_id"], r["payload_bytes"]) for r in got)[2, 0] == 1
    assert {r["refers_to"] for r in got if r["page_id"] == 3} == {1}


def test_conversations(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", None), (2, 0, "user", ""), (2, 1, "assistant", "x" * 9000), (3, None, "user", "a"), (None, 0, "user", "b")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("7") for c in CLASHING})
    stream, leaves = chat.format_forest(c)
    got = {r["conv_id"]: r for r in chat.read_back(stream, leaves).collect()}
    assert [t for _, t in chat.read_turns(got[2]["formatted"])] == ["", "x" * 9000] and len(chat.read_turns(got[1]["formatted"])) == 2


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], None), (1, [1.0, 0.0], "a"), (2, [1.0, 0.1], None), (3, None, "a"), (4, [float("inf"), 1.0], None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").withColumns({c: F.lit("7") for c in CLASHING if c != "id"})
    got = {(r["vec_id"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(v).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)}


def test_plain_archives_are_read_too(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a", "<p>x"), (2, "http://b", "<p>y")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "gz"))
    (tmp_path / "plain").mkdir()
    for k, f in enumerate((tmp_path / "gz").rglob("*.gz")):
        (tmp_path / "plain" / f"{k}.warc").write_bytes(gzip.decompress(f.read_bytes()))
    ids = lambda folder: sorted(r["record_id"] for r in warc.read_archives(spark, str(tmp_path / folder)).select("record_id").collect())
    assert ids("plain") == ids("gz") and len(ids("plain")) > 2
