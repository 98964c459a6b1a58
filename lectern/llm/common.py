"""Shared pieces of the training-data operators: spooled tables, components, word and span rules."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: White space of the word rule, as a Java character class body.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor sees: the session's spark.checkpoint.dir; a temporary one only where that is unset, in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def spool(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_spooled(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the folders of ``spool`` behind tables once no later result reads them; other inputs stay."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        if re.search(r"-[0-9a-f]{32}$", folder):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of few rows for the steps that run inside; the session's own value comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows of one key that a task joins at most; keys beyond that, the most frequent first, are split by a salt.
ROWS_A_KEY = 20_000
MOST_SPLIT = 65_536


def join_hot(many: DataFrame, one: DataFrame, on: str, how: str = "inner", counts: DataFrame | None = None, rows: int = ROWS_A_KEY) -> DataFrame:
    """Join to a side that is unique in ``on``; a key with more than ``rows`` rows is dealt to several tasks.

    ``counts``: (on, n) of the keys where known; else the rows of every key are counted, by partial aggregates.
    The list of split keys is bounded and broadcast; past its end the join is the same, only less even.
    """
    counts = many.groupBy(on).agg(F.count("*").alias("n")) if counts is None else counts
    hot = counts.where((F.col("n") > rows) & F.col(on).isNotNull()).orderBy(F.desc("n"), on).limit(MOST_SPLIT)
    hot = spool(hot.select(on, F.ceil(F.col("n") / rows).cast("int").alias("_parts")), "hot-keys")
    if not hot.limit(1).count():
        return many.join(one, on, how)
    names = many.columns
    parts, salt = F.coalesce("_parts", F.lit(1)), F.pmod(F.xxhash64(*names), F.lit(1 << 30))
    left = many.join(F.broadcast(hot), on, "left").withColumn("_salt", (salt % parts).cast("int")).drop("_parts")
    right = one.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [on, "_salt"], how).drop("_salt")


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


#: Edges that one task holds at most when it contracts its share of a graph.
FOREST_EDGES = 500_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id of the edges but the smallest of its component, and that smallest: roots hook to smaller ones."""
    ids, at = np.unique(np.r_[u, v], return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    low = root != np.arange(len(ids))
    return ids[low], ids[root[low]]


def _forests(most: int):
    """Edges of a task as stars around the smallest ids of what it holds; it holds ``most`` edges and a batch at most."""

    def run(batches):
        u, v, size = [], [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x])) for x in (u, v)], names=["u", "v"])
        for b in batches:
            u.append(b.column(0).to_numpy())
            v.append(b.column(1).to_numpy())
            size += b.num_rows
            if size >= most:
                x, y = forest(np.concatenate(u), np.concatenate(v))
                u, v, size = [x], [y], len(x)
                if 2 * size >= most:
                    yield out()
                    u, v, size = [], [], 0
        if u:
            x, y = forest(np.concatenate(u), np.concatenate(v))
            u, v = [x], [y]
        yield out()

    return run


def connected_components(edges: DataFrame, label: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Smallest id reachable from every id that has an edge.

    ``edges``: columns u, v (long); loops and repeated rows are ignored, an empty table gives an
    empty one. Each task first contracts its share to stars around smallest ids; a graph of one task's share is
    settled by that. Of others large-star and small-star rounds alternate, each a partial aggregate by node and one
    skew-splittable equi-join, spooled so that lineage stays short. Returns id, component.
    """
    spark = edges.sparkSession
    given = spool(edges.where("u <> v").select("u", "v"), label)
    tasks = -(-given.count() // FOREST_EDGES)
    e = spool(given.coalesce(max(tasks, 1)).mapInArrow(_forests(FOREST_EDGES + 1), "u long, v long"), label)
    drop_spooled(spark, given)
    if tasks > 1:
        stars = e
        e = spool(stars.distinct(), label)
        drop_spooled(spark, stars)
        e = _star_rounds(e, label, max_rounds)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _star_rounds(e: DataFrame, label: str, max_rounds: int) -> DataFrame:
    """Distinct edges (larger, smaller) as stars around the smallest id of each component."""
    spark = e.sparkSession
    for _ in range(max_rounds):
        child = e.groupBy("u").agg(F.count("*").alias("n"))
        many = child.where("n > 1").limit(1).count()
        if not many and not e.join(e.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return e
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(low, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(met.select("u", "m"))
        after = spool(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
        drop_spooled(spark, e)
        e = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
