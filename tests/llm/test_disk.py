"""What the join and mixing stages leave on disk, and shuffles that small tables don't need."""

import os
import random
import re

import pytest

from lectern.llm import bpe, common, mixing, ngram_join

from .test_operators import classes, texts

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def labels(spark):
    there = os.listdir(re.sub("^file:/+", "/", common.shared_dir(spark)))
    return sorted(m[1] for x in there if (m := re.fullmatch(r"(.+)-[0-9a-f]{32}", x)))


def left_by(spark, step):
    before = labels(spark)
    out = step()
    after = labels(spark)
    for x in before:
        after.remove(x)
    return out, set(after) - {"hot-keys"}


def test_join_drops_its_tables(spark):
    rows = [(k, t, "", "", 0) for k, t in enumerate(texts(31, 40))] + [(900 + k, f"{k} " + " ".join(f"s{j}" for j in range(60)), "", "", 0) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    classed, left = left_by(spark, lambda: ngram_join.jaccard_components(docs, words=3, percent=70))
    assert left <= {"op2-profiles", "op2-own"}
    assert {r[0]: (r[1], r[2]) for r in classed.collect()} == classes([r[:2] for r in rows], 3, 70)
    out, left = left_by(spark, lambda: corpus_pipeline.drop_near_copies(spark, docs, ""))
    assert left == {"stage-copies"}
    assert 0 < out.count() < len(rows)


def test_only_spooled_tables_are_dropped(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/given.parquet")
    given = spark.read.parquet(f"{tmp_path}/given.parquet")
    held = common.spool(given, "held")
    common.drop_spooled(spark, given, held)
    assert spark.read.parquet(f"{tmp_path}/given.parquet").count() == 5
    assert not any(os.path.exists(f.removeprefix("file://")) for f in held.inputFiles())


@pytest.mark.parametrize("most", [5, 40, 10_000])
def test_components_of_shares(spark, monkeypatch, most):
    monkeypatch.setattr(common, "FOREST_EDGES", most)
    rng = random.Random(most)
    edges = [(k, k + 1) for k in range(30)] + [(rng.randint(100, 260), rng.randint(100, 260)) for _ in range(110)] + [(500, k) for k in range(400, 430)] + [(7, 7), (None, 3)]
    rng.shuffle(edges)
    low = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in low:
        for a, b in edges:
            if a in low and b in low:
                low[a] = low[b] = min(low[a], low[b])
    got = common.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()
    assert sorted(map(tuple, got)) == sorted(low.items())


def test_small_graphs_and_few_cells_are_not_shuffled(spark, monkeypatch):
    plans = []

    def watched(df, label, spool=common.spool):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return spool(df, label)

    monkeypatch.setattr(common, "spool", watched)
    monkeypatch.setattr(mixing, "spool", watched)
    common.connected_components(common.spool(spark.range(500).selectExpr("id u", "id + 1 v"), "given")).count()
    cells = spark.createDataFrame([(f"s{k % 7}", f"l{k % 3}", f"t{k % 2}", 10 + k) for k in range(42)], "_source string, _lang string, _topic string, tokens long")
    assert mixing.rake(cells).count() == 42
    assert {x for x, _ in plans} == {"given", "cc", "op4-cells", "op4-goals", "op4-raked"}
    assert not [x for x, p in plans if "Exchange hashpartitioning" in p]


def test_encoding_keeps_ids_alone():
    """Encoding gives the ids of the round trip and keeps no decimals beside them; both tables are bounded."""
    c = bpe.Codec(bpe.vocabulary_path(), most_kept=20)
    rng = random.Random(8)
    for _ in range(60):
        text = " ".join("".join(rng.choices("abcdeÉßΣ漢1#<|", k=rng.randint(1, 9))) for _ in range(30)) + rng.choice(["", *c.special])
        ids = c.encode(text)
        assert ids == [i for part, _ in c.parts(text) for i in part]
    c = bpe.Codec(bpe.vocabulary_path(), most_kept=20)
    c.encode("one two three " * 3 + " ".join(f"w{chr(97 + k)}x" for k in range(26)))
    assert not c.kept
    assert 0 < len(c.bare) <= 20
