"""Near-duplicate embeddings by int8 tiles with rigorous error bounds.

Equal vectors are one node first, with a number of its own, so that rows which repeat an id with other
vectors stay apart. Nodes are dealt by a hash into blocks of as many vectors as fit ``block_bytes``, so that
few blocks, and few copies of them, are shuffled; every pair of blocks is one tile task, which cuts them
into smaller tiles. A tile quantises its unit vectors to int8, multiplies the codes (exact in float32, as sums of
products stay below 2**24 up to 1,040 dimensions; wider vectors are multiplied in float64) and keeps the
pairs whose approximate cosine plus their error bound reaches the threshold. With x = x' + e, y = y' + f,
|x.y - x'.y'| <= |e||y'| + |x'||f| + |e||f|, and e, f, x', y' are known exactly per vector. Only kept pairs
are computed in double precision. A tile returns link counts and a spanning forest, never its pairs, so a
group of copies costs rows in proportion to its size.

Components are scaled by a power of two before any product, so that no finite vector's norm over- or underflows.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
vectors of different lengths never link; equal vectors link; repeated ids are classed row by row; null ids
have no links and a null component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, join_hot, small_batches, spool

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 1 << 24
LEAST_BLOCKS = 12
COPIES_FROM = 16
#: Groups of copies whose answer is broadcast, the largest first.
MOST_LARGE = 4096
SUB = 1024
PAIRS = 50_000


def quantised(x: np.ndarray):
    """Codes, scale, |error| and |decoded| of unit rows; norms are rounded up a little."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None])
    back = codes * scale[:, None]
    up = 1 + 1e-12
    return codes, scale, np.linalg.norm(x - back, axis=1) * up + 1e-15, np.linalg.norm(back, axis=1) * up


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to [0.5, 1): cosines stay, norms neither over- nor underflow."""
    _, e = np.frexp(np.abs(x).max(1))
    return np.ldexp(np.ldexp(x, -(e // 2)[:, None]), -(e - e // 2)[:, None])


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of each pair; label[i] is the class's smallest member."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not (label == (jump := label[label])).all():
            label[:] = jump


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float):
    """Index pairs (i in x, j in y) with cosine >= threshold, in batches; y None: pairs i < j within x."""
    x, y = scaled(x), None if y is None else scaled(y)
    nx = np.linalg.norm(x, axis=1)
    ux = x / nx[:, None]
    cx, sx, ex, dx = quantised(ux)
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    if y is None:
        vy, ny, cy, sy, ey, dy = x, nx, cx, sx, ex, dx
    else:
        vy, ny = y, np.linalg.norm(y, axis=1)
        cy, sy, ey, dy = quantised(y / ny[:, None])
    cx, cy = cx.astype(kind), cy.astype(kind)
    for a in range(0, len(x), SUB):
        for b in range(a if y is None else 0, len(vy), SUB):
            p, q = slice(a, a + SUB), slice(b, b + SUB)
            near = (cx[p] @ cy[q].T).astype(np.float64) * sx[p, None] * sy[None, q]
            slack = ex[p, None] * dy[None, q] + dx[p, None] * ey[None, q] + ex[p, None] * ey[None, q] + 1e-9
            i, j = np.nonzero(near + slack >= threshold)
            i, j = i + a, j + b
            if y is None:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), PAIRS):
                s, t = i[k : k + PAIRS], j[k : k + PAIRS]
                hit = np.einsum("nd,nd->n", x[s], vy[t]) / (nx[s] * ny[t]) >= threshold
                yield s[hit], t[hit]


def _tile(threshold: float):
    def run(key, table):
        first, second = key[1].as_py(), key[2].as_py()
        ids, copies, block = (table[c].to_numpy() for c in ("nid", "copies", "block"))
        v = table["v"].combine_chunks()
        v = v.values.to_numpy()[v.offsets[0].as_py() :].reshape(len(ids), -1).astype(np.float64)
        left = np.flatnonzero(block == first)
        right = left if first == second else np.flatnonzero(block == second)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j in tile_links(v[left], None if first == second else v[right], threshold):
            i, j = left[i], right[j]
            links += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
            _settle(label, i, j)
        some = links > 0
        return pa.table({"nid": ids[some], "links": links[some], "root": ids[label[some]]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; vectors link at cosine >= threshold.

    component_id is the smallest vec_id that has a vector of the class.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(F.col("vec_id").isNotNull() & fine, F.lit(False)))
    reps = rows.where("fine").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = spool(reps.withColumn("nid", F.monotonically_increasing_id()), "op10-distinct")
    held = reps.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("numbers")).first()
    blocks = max(LEAST_BLOCKS, -(-4 * (held["numbers"] or 0) // block_bytes))
    dealt = reps.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = dealt.withColumn("other", other).select(F.size("v").alias("dim"), F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "nid", "copies", "v")
    with small_batches(vectors.sparkSession):
        found = spool(dealt.groupBy("dim", "first", "second").applyInArrow(_tile(threshold), "nid long, links long, root long"), "op10-tiles")
    links = found.groupBy("nid").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("nid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("id", "nid")
    own = reps.join(links, "nid", "left").join(comps, "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    least = own.groupBy("component").agg(F.min("rep").alias("component_id"))
    own = join_hot(own, least, "component")
    own = spool(own.select("v", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "op10-own")
    # rows find their vector's answer again; a vector that many rows share meets a broadcast table
    large = own.where(F.col("copies") >= COPIES_FROM).orderBy(F.desc("copies"), "component_id").limit(MOST_LARGE)
    large = large.select("v", F.struct("n_links", "component_id").alias("_near"))
    met = rows.where("fine").join(F.broadcast(large), "v", "left")
    out = met.where("_near is null").select("vec_id", "v").join(own, "v").select("vec_id", "n_links", "component_id")
    out = out.union(met.where("_near is not null").select("vec_id", "_near.n_links", "_near.component_id"))
    lone = rows.where("not fine").select("vec_id", F.lit(0).cast("long"), "vec_id")
    return out.union(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: links and classes of all embeddings at a cosine of 0.9."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v),
k AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, k.y FROM r JOIN k ON k.x = r.y)
SELECT x AS vec_id, (SELECT count(*) FROM k WHERE k.x = r.x) AS n_links, min(y) AS component_id, x = min(y) AS kept FROM r GROUP BY x
"""
