"""Recognition passes over page variants around an engine that the caller injects.

An engine is a picklable function from a height x width (x channels) byte array to a dict with rec_texts,
rec_scores and rec_boxes. One row is one variant's pixels; its tiles are cut where the row lies, so pixels
are never copied into one row a tile and never shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate, fusion

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Variants of each kind of pass; tiles as (height, overlap), grids as (width, overlap, height, overlap).
FULL = ("document", "line_removed", "blue_ink", "blue_gray")
TILED = ("blue_gray",)
GRIDDED = ("blue_gray",)
TILES = ((520, 200), (340, 140), (240, 90))
GRIDS = ((900, 180, 520, 180),)

IMAGES = "stem string, variant string, height int, width int, pixels binary"
RESULTS = (
    "stem string, pass_ord int, tile_ord int, source string, rec_texts array<string>, rec_scores array<double>, rec_boxes array<array<double>>, "
    "x_offset int, y_offset int, tile_width int, tile_height int, image_width int, image_height int"
)


def names(said: str | None, default: tuple[str, ...]) -> tuple[str, ...]:
    """Comma-separated names; none given is the default, none left is an error."""
    if said is None:
        return default
    out = tuple(filter(None, map(str.strip, said.split(","))))
    if not out:
        raise ValueError("empty list of sources")
    return out


def sizes(said: str | None, default: tuple, parts: int) -> tuple[tuple[int, ...], ...]:
    """Comma-separated groups of ``parts`` whole numbers joined by colons; empty tile groups are passed over."""
    if said is None:
        return default
    out = []
    for group in said.split(","):
        if not group.strip() and parts == 2:
            continue
        numbers = group.split(":")
        if len(numbers) != parts:
            raise ValueError(f"{group!r} is not {parts} numbers joined by colons")
        out.append(tuple(map(int, numbers)))
    if not out:
        raise ValueError("empty list of sizes")
    return tuple(out)


@dataclass(frozen=True)
class Plan:
    """Which passes to run; their order is full pages, then tiles, then grids."""

    full: tuple[str, ...] = FULL
    tiled: tuple[str, ...] = TILED
    tiles: tuple[tuple[int, int], ...] = TILES
    gridded: tuple[str, ...] = GRIDDED
    grids: tuple[tuple[int, int, int, int], ...] = GRIDS

    def passes(self) -> list[tuple[str, str, tuple[int, ...]]]:
        """(variant, source, sizes) of every pass in order."""
        whole = [(v, f"{v}_full", ()) for v in self.full]
        tall = [(v, f"{v}_tile_{t[0]}", t) for v in self.tiled for t in self.tiles]
        return whole + tall + [(v, f"{v}_grid_{g[0]}x{g[2]}", g) for v in self.gridded for g in self.grids]


def starts(extent: int, size: int, overlap: int) -> list[int]:
    """Offsets of tiles along one side; the last one ends with the image."""
    size = min(size, extent)
    last = max(0, extent - size)
    return sorted({*range(0, last + 1, max(1, size - overlap)), last})


def pixels_of(row) -> np.ndarray:
    flat = np.frombuffer(row.pixels, np.uint8)
    return flat.reshape(row.height, row.width, -1) if flat.size != row.height * row.width else flat.reshape(row.height, row.width)


def recognise(images: DataFrame, engine: Callable[[np.ndarray], dict], plan: Plan | None = None) -> DataFrame:
    """Engine results of every pass and tile. Variants that no pass names are not read by the engine."""
    todo = list(enumerate((plan or Plan()).passes()))

    def rows(image):
        page = pixels_of(image)
        h, w = page.shape[:2]
        for k, (variant, source, size) in todo:
            if variant != image.variant:
                continue
            if not size:  # whole pages have no tile edges
                yield image.stem, k, 0, source, page, 0, 0, None, None, None, None
            elif len(size) == 2:
                for n, y in enumerate(starts(h, *size)):
                    part = page[y : y + min(size[0], h)]
                    yield image.stem, k, n, source, part, 0, y, None, part.shape[0], None, h
            else:
                places = [(y, x) for y in starts(h, size[2], size[3]) for x in starts(w, size[0], size[1])]
                for n, (y, x) in enumerate(places):
                    part = page[y : y + min(size[2], h), x : x + min(size[0], w)]
                    yield image.stem, k, n, source, part, x, y, part.shape[1], part.shape[0], w, h

    def run(batches):
        for pdf in batches:
            for image in pdf.itertuples(index=False):
                out = []
                for stem, k, n, source, part, *place in rows(image):
                    got = engine(part)
                    got = got.get("res", got)
                    out.append((stem, k, n, source, list(got["rec_texts"]), [float(s) for s in got["rec_scores"]], [[float(c) for c in b] for b in got["rec_boxes"]], *place))
                frame = pd.DataFrame(out, columns=COLUMNS)
                yield frame.astype(dict.fromkeys(COLUMNS[7:], "Int32"))

    wanted = {v for _, (v, _, _) in todo}
    return images.where(F.col("variant").isin(sorted(wanted))).select("stem", "variant", "height", "width", "pixels").mapInPandas(run, RESULTS)


COLUMNS = [c.split(" ")[0] for c in RESULTS.split(", ")]


def ensemble(images: DataFrame, engine: Callable, plan: Plan | None = None, table: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, merged regions and clean regions of every page.

    Candidates of a pass are numbered over its tiles, so that ties fall as the passes ran.
    """
    results = recognise(images, engine, plan).withColumn("pass_ord", F.col("pass_ord") * 1_000_000 + F.col("tile_ord")).drop("tile_ord")
    found = fusion.candidate_rows(results, table)
    merged = fusion.merge_regions(fusion.group_regions(found))
    return found, merged, fusion.clean_regions(merged)


def single_pass(images: DataFrame, engine: Callable, variants: dict[str, str] | None = None) -> DataFrame:
    """stem, method, text of one whole-page pass a variant; by default the variants of the ablation's settings.

    A page without a variant that is asked for is an error. Pages without any line have an empty text.
    """
    wanted = variants or {v: s for s, _, v in evaluate.SETTINGS if v}
    has = images.groupBy("stem").agg(F.collect_set(F.when(F.col("variant").isin(list(wanted)), F.col("variant"))).alias("has"))
    lost = has.select("stem", F.explode(F.array_except(F.array(*map(F.lit, wanted)), "has")).alias("variant")).limit(5).collect()
    if lost:
        raise ValueError(f"missing variants: {[tuple(r) for r in lost]}")
    done = recognise(images, engine, Plan(full=tuple(wanted), tiled=(), gridded=()))
    method = F.coalesce(*[F.when(F.col("source") == f"{v}_full", s) for v, s in wanted.items()])
    done = done.select(F.struct("stem", method.alias("method")).alias("stem"), "rec_texts", "rec_scores", "rec_boxes")
    lines = fusion.lines_of(done).groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("l"))
    said = F.array_join(F.transform("l", lambda x: x["text"]), "\n")
    return done.select("stem").distinct().join(lines, "stem", "left").select("stem.stem", "stem.method", F.coalesce(said, F.lit("")).alias("text"))
