"""Candidate extraction and fusion of recognition passes into regions in reading order.

All per-candidate rules are column expressions. Only the greedy first-fit grouping depends on order; it runs
page by page in Arrow groups, and a page's candidates are what bounds one group.
"""

from __future__ import annotations

import sys
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics, script, text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_SCORE = 0.25
EDGE = 6
# Bonus of a pass by its source; grid and tile passes are told by their name.
GRID_BONUS, TILE_BONUS = 0.11, 0.08
SOURCE_BONUS = {
    "document_full": 0.09, "enhanced_full": 0.08, "sharpened_full": 0.08, "clean_document_full": 0.09, "blue_ink_full": 0.08,
    "blue_gray_full": 0.10, "line_removed_full": 0.06, "blue_binary_full": 0.06, "binary_full": 0.03,
}


def candidate_rows(results: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """Engine results (parallel arrays a pass) to candidates on the page; ``results`` may carry pass_ord."""
    # a positional zip stops at the shortest array
    n = F.least(F.size("rec_texts"), F.size("rec_scores"), F.size("rec_boxes"))
    rows = results.withColumn("_z", F.slice(F.arrays_zip("rec_texts", "rec_scores", "rec_boxes"), 1, F.greatest(n, F.lit(0))))
    rows = rows.select(*[c for c in results.columns if not c.startswith("rec_")], F.posexplode("_z").alias("ord", "z"))
    box = [F.get("z.rec_boxes", F.lit(k)).cast("double") for k in range(4)]
    rows = rows.withColumns({"text": script.to_traditional(text.strip(F.col("z.rec_texts")), table), "score": F.col("z.rec_scores").cast("double"), "bx1": box[0], "by1": box[1], "bx2": box[2], "by2": box[3]})
    rows = rows.where((F.col("text") != "") & (F.col("score") >= MIN_SCORE) & (F.size("z.rec_boxes") >= 4))
    rows = rows.where(~F.coalesce(touches_edge("by1", "by2", "y_offset", "tile_height", "image_height"), F.lit(False)))
    rows = rows.where(~F.coalesce(touches_edge("bx1", "bx2", "x_offset", "tile_width", "image_width"), F.lit(False)))
    rows = rows.where("bx2 > bx1 and by2 > by1")
    at = lambda c, off: F.round(F.col(c) + F.coalesce(F.col(off), F.lit(0)), 2)
    first = [c for c in ("stem", "pass_ord") if c in rows.columns]
    return rows.select(*first, "ord", "text", F.round("score", 6).alias("confidence"), at("bx1", "x_offset").alias("x1"), at("by1", "y_offset").alias("y1"), at("bx2", "x_offset").alias("x2"), at("by2", "y_offset").alias("y2"), "source")


def touches_edge(low: str, high: str, offset: str, tile: str, image: str) -> Column:
    """A box at a tile's edge where the image goes on; null without tile or image size."""
    lo, hi, off, t, i = (F.col(c) for c in (low, high, offset, tile, image))
    return F.when(t.isNotNull() & i.isNotNull(), ((lo <= EDGE) & (off > 0)) | ((hi >= t - EDGE) & (off + t < i)))


def lines_of(results: DataFrame) -> DataFrame:
    """Baseline lines: the same zip without score filter, conversion or offsets; empty texts go."""
    n = F.least(F.size("rec_texts"), F.size("rec_scores"), F.size("rec_boxes"))
    z = F.slice(F.arrays_zip("rec_texts", "rec_scores", "rec_boxes"), 1, F.greatest(n, F.lit(0)))
    rows = results.select("stem", F.posexplode(z).alias("ord", "z"))
    return rows.select("stem", "ord", text.strip(F.col("z.rec_texts")).alias("text"), F.col("z.rec_scores").cast("double").alias("confidence"), F.col("z.rec_boxes").alias("bbox")).where("text <> ''")


def line_counts(lines: DataFrame) -> DataFrame:
    """stem, line_count, character_count of a page's lines that are not blank; characters without those around a line."""
    t = text.strip(F.col("text"))
    return lines.groupBy("stem").agg(F.count_if(t != "").alias("line_count"), F.sum(F.length(t)).alias("character_count"))


def quality() -> Column:
    """Confidence, a little for length, and the source's bonus."""
    named = F.lit(0.0)
    for s, b in SOURCE_BONUS.items():
        named = F.when(F.col("source") == s, b).otherwise(named)
    bonus = F.when(F.contains("source", F.lit("_grid_")), GRID_BONUS).when(F.contains("source", F.lit("_tile_")), TILE_BONUS).otherwise(named)
    return F.col("confidence") + F.least(F.length(F.replace("text", F.lit(" "), F.lit(""))), F.lit(100)) * 0.002 + bonus


def same_region(a: str, b: str) -> Column:
    """Boxes of one text region: like widths, shared columns, near lines. Symmetric, not transitive."""
    c = lambda t, k: F.col(f"{t}.{k}")
    w, v = c(a, "x2") - c(a, "x1"), c(b, "x2") - c(b, "x1")
    h, g = c(a, "y2") - c(a, "y1"), c(b, "y2") - c(b, "y1")
    like = F.least(w, v) / F.greatest(F.lit(1.0), F.greatest(w, v)) >= 0.42
    shared = F.greatest(F.lit(0.0), F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1"))) / F.greatest(F.lit(1.0), F.least(w, v)) >= 0.50
    near = F.abs((c(a, "y1") + c(a, "y2")) / 2 - (c(b, "y1") + c(b, "y2")) / 2) <= F.greatest(F.lit(28.0), F.least(h, g) * 0.5)
    return like & shared & near


def region_pairs(boxes: DataFrame, band: float = 64.0) -> DataFrame:
    """Pairs (a, b), a < b by id, of one page that share a region.

    Bands of line centres make an equi-key: a box is filed under every band within its own reach, and a pair
    is kept in the band of the lower centre only, so dense pages do not compare all with all.
    """
    reach = F.greatest(F.lit(28.0), (F.col("y2") - F.col("y1")) * 0.5)
    centre = (F.col("y1") + F.col("y2")) / 2
    rows = boxes.withColumn("_c", centre)
    low, high = F.floor((F.col("_c") - reach) / band), F.floor((F.col("_c") + reach) / band)
    a = rows.withColumn("_b", F.explode(F.sequence(low, high))).alias("a")
    b = rows.withColumn("_b", F.floor(F.col("_c") / band)).alias("b")
    # the centre distance is within the smaller box's reach or 28, hence within a's reach for either order
    met = a.join(b, (F.col("a.stem") == F.col("b.stem")) & (F.col("a._b") == F.col("b._b")) & (F.col("a.id") != F.col("b.id")))
    met = met.where(same_region("a", "b")).select(F.col("a.stem").alias("stem"), F.least("a.id", "b.id").alias("a_id"), F.greatest("a.id", "b.id").alias("b_id"))
    return met.distinct()


def group_regions(candidates: DataFrame) -> DataFrame:
    """Candidates with group and arrival: greedy first fit in quality order, ties by pass_ord and ord."""
    rows = candidates.withColumn("quality", quality())
    if "pass_ord" not in rows.columns:
        rows = rows.withColumn("pass_ord", F.lit(0))
    schema = rows.withColumn("group", F.lit(0)).withColumn("arrival", F.lit(0)).schema

    def fit(page: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        page = page.sort_values(["quality", "pass_ord", "ord"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        x1, y1, x2, y2 = (page[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2"))
        w, h, mid = x2 - x1, y2 - y1, (y1 + y2) / 2
        group, count = np.full(len(page), -1, np.int32), 0
        for k in range(len(page)):
            p = slice(0, k)
            thin = np.minimum(w[p], w[k])
            like = thin / np.maximum(1.0, np.maximum(w[p], w[k])) >= 0.42
            over = np.maximum(0.0, np.minimum(x2[p], x2[k]) - np.maximum(x1[p], x1[k])) / np.maximum(1.0, thin) >= 0.50
            near = np.abs(mid[p] - mid[k]) <= np.maximum(28.0, np.minimum(h[p], h[k]) * 0.5)
            met = group[p][like & over & near]
            if len(met):
                group[k] = met.min()
            else:
                group[k], count = count, count + 1
        return page.assign(group=group, arrival=np.arange(len(page), dtype=np.int32))

    return rows.groupBy("stem").applyInPandas(fit, schema)


def best_by_text(rows: DataFrame, key: tuple[str, ...], *ties: str) -> DataFrame:
    """Of rows with equal key and text the most confident one, first by ``ties``."""
    best = Window.partitionBy(*key, "text").orderBy(F.desc("confidence"), *ties)
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def in_reading_order(rows: DataFrame, top: Column, bottom: Column, left: Column, tie: str, name: str = "id") -> DataFrame:
    """The rows of a page numbered by the middle of their line, then from the left."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("stem").orderBy((top + bottom) / 2, left, tie)))


def source_counts(candidates: DataFrame) -> DataFrame:
    """stem, source, n: candidates of a page by source."""
    return candidates.groupBy("stem", "source").agg(F.count("*").alias("n"))


def merge_regions(grouped: DataFrame) -> DataFrame:
    """Grouped candidates to regions: the winner's fields, alternatives by quality, and id in reading order."""
    key = ["stem", "group"]
    # per text the best record, at the place of the text's first arrival
    rows = best_by_text(grouped.withColumn("_first", F.min("arrival").over(Window.partitionBy(*key, "text"))), ("stem", "group"), "arrival")
    rows = rows.withColumn("alt_pos", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("quality"), "_first")))
    rows = rows.withColumn("eligible", F.col("confidence") >= F.max("confidence").over(Window.partitionBy(*key)) - 0.28).withColumn("_key", text.candidate_key(F.col("text")))
    e = rows.where("eligible").select(*key, "alt_pos", "_key")
    pairs = e.alias("p").join(e.alias("q"), key).where("p.alt_pos <> q.alt_pos")
    agreed = pairs.select(*key, F.col("p.alt_pos").alias("alt_pos"), metrics.similarity(F.col("p._key"), F.col("q._key")).alias("s")).groupBy(*key, "alt_pos").agg(F.avg("s").alias("agreement"))
    rows = rows.join(agreed, [*key, "alt_pos"], "left").withColumn("score", F.when(F.col("eligible"), F.col("quality") + F.coalesce("agreement", F.lit(0.0)) * 0.22))
    win = Window.partitionBy(*key).orderBy(F.desc_nulls_last("score"), F.desc("confidence"), "alt_pos")
    rows = rows.withColumn("_w", F.row_number().over(win))
    bbox = F.array("x1", "y1", "x2", "y2")
    alt = F.struct("alt_pos", "text", "confidence", bbox.alias("bbox"), "source")
    regions = rows.groupBy(*key).agg(F.max(F.when(F.col("_w") == 1, F.struct("text", "confidence", bbox.alias("bbox"), "source"))).alias("w"), F.array_sort(F.collect_list(alt)).alias("alternatives"))
    regions = regions.select("stem", "group", "w.*", F.transform("alternatives", lambda a: F.struct(a["text"].alias("text"), a["confidence"].alias("confidence"), a["bbox"].alias("bbox"), a["source"].alias("source"))).alias("alternatives"))
    return in_reading_order(regions, F.col("bbox")[1], F.col("bbox")[3], F.col("bbox")[0], "group").drop("group")


def clean_regions(regions: DataFrame) -> DataFrame:
    """Regions worth keeping: sure ones, or corroborated ones a little less sure."""
    sources = F.size(F.array_distinct(F.transform("alternatives", lambda a: a["source"])))
    short = (F.length(text.strip(F.col("text"))) <= 1) & (F.col("confidence") < 0.65)
    lone = (F.col("source") == "binary_full") & (sources < 2)
    return regions.where(~short & ~lone & ((F.col("confidence") >= 0.40) | ((sources >= 2) & (F.col("confidence") >= 0.30))))


def band_of(confidence: Column) -> Column:
    return F.when(confidence >= 0.65, "high").when(confidence >= 0.40, "medium").otherwise("low")


def statistics(candidates: DataFrame, merged: DataFrame, clean: DataFrame) -> DataFrame:
    """Counts a page: raw, merged, clean, high confidence, and candidates by source in source order."""
    by = source_counts(candidates).groupBy("stem").agg(F.sum("n").alias("raw_candidate_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("candidate_count_by_source"))
    m = merged.groupBy("stem").agg(F.count("*").alias("merged_region_count"), F.count_if(F.col("confidence") >= 0.65).alias("high_confidence_region_count"))
    c = clean.groupBy("stem").agg(F.count("*").alias("clean_region_count"), uncertain().alias("uncertain_region_count"))
    return by.join(m, "stem", "left").join(c, "stem", "left").fillna(0)


def uncertain() -> Column:
    return F.count_if((F.col("confidence") < 0.65) | (F.size("alternatives") > 1))


def offsets(extent: Column, tile: Column, overlap: Column) -> Column:
    """Offsets of tiles along one side; the last one ends with the image."""
    size = F.least(tile, extent)
    last = F.greatest(F.lit(0), extent - size)
    return F.array_sort(F.array_union(F.sequence(F.lit(0), last, F.greatest(F.lit(1), size - overlap)), F.array(last)))


def grid_tiles(images: DataFrame, tile_width: int, x_overlap: int, tile_height: int, y_overlap: int) -> DataFrame:
    """Rows (x, y) of grid tiles, row by row, for images with width and height."""
    ys = offsets(F.col("height"), F.lit(tile_height), F.lit(y_overlap))
    xs = offsets(F.col("width"), F.lit(tile_width), F.lit(x_overlap))
    rows = images.withColumn("y", F.explode(ys))
    return rows.withColumn("x", F.explode(xs))
