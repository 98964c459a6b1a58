"""Pages as they arrive: an addition, as the reference only scans folders again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import stem_of


def arriving_texts(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """Stream of stem, text for files that appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", f"*{suffix}").load(folder)
    return raw.select(stem_of(F.col("path")).alias("stem"), "modificationTime", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def volume_by_window(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Pages and characters by arrival window; pages later than ``late`` are left out by the watermark."""
    clean = stream.withColumn("n", F.length(text.strip(F.col("text"))))
    return clean.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window)).agg(F.count("*").alias("pages"), F.sum("n").alias("characters"))
