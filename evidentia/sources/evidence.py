"""Evidence files: reading them, telling their format by content, and reading what their headers say."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources.containers import with_parts

#: The first bytes of the accepted formats.
PNG, JPEG, RIFF, WEBP = "89504E470D0A1A0A", "FFD8FF", "52494646", "57454250"


def read_evidence(spark: SparkSession, path: str, glob: str = "*.{png,jpg,jpeg,webp,PNG,JPG,JPEG,WEBP}") -> DataFrame:
    """path, modificationTime, length, content; the glob is applied while files are listed."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def media_type(content: Column) -> Column:
    """The type that the first bytes show; null for others."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith(PNG), "image/png")
        .when(head.startswith(JPEG), "image/jpeg")
        .when(head.startswith(RIFF) & (F.substring(head, 17, 8) == WEBP), "image/webp")
    )


def accepted(files: DataFrame) -> DataFrame:
    return files.withColumn("media_type", media_type(F.col("content"))).filter("media_type is not null")


def file_facts(files: DataFrame) -> DataFrame:
    """Provenance observations of each file. What a file does not carry is unavailable, which proves nothing.

    Text, Exif, XMP and content credentials count where the file's structure has such a part
    (``parts``); ``damaged`` files have one that is cut off or whose checksum does not hold. PNG sizes
    come from the header."""
    content, digits = F.col("content"), F.hex(F.substring("content", 17, 8))
    number = lambda part: F.conv(part, 16, 10).cast("int")
    is_png = media_type(content) == "image/png"
    has = lambda what: F.exists("parts", lambda p: F.coalesce(p["carries"] == what, F.lit(False)))
    facts = with_parts(files).select(
        "path", "length", media_type(content).alias("media_type"), F.sha2(content, 256).alias("digest"),
        F.when(is_png, number(F.substring(digits, 1, 8))).alias("width"), F.when(is_png, number(F.substring(digits, 9, 8))).alias("height"),
        has("exif").alias("has_exif"), has("xmp").alias("has_xmp"), has("credentials").alias("has_credentials"), has("text").alias("has_text_chunk"),
        F.exists("parts", lambda p: p["status"] != "ok").alias("damaged"), "parts",
    )
    carried = F.col("has_exif") | F.col("has_xmp") | F.col("has_credentials") | F.col("has_text_chunk")
    return facts.withColumn("provenance_status", F.when(carried, "completed").otherwise("unavailable"))


def decoded_pixels(spark: SparkSession, path: str) -> DataFrame:
    """path, x, y, v (grey level 0 to 255) of the images that Spark's image source can decode.

    WebP and broken files are dropped by the source; ``decode_results`` reports them."""
    images = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")

    def grey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            for row in batch.itertuples():
                a = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)
                level = a[:, :, : min(3, row.nChannels)].mean(2).round().astype("int32")
                y, x = np.indices(level.shape, dtype="int32")
                yield pd.DataFrame({"img_id": row.origin, "x": x.ravel(), "y": y.ravel(), "v": level.ravel()})

    return images.mapInPandas(grey, "img_id string, x int, y int, v int")


def decode_results(spark: SparkSession, path: str) -> DataFrame:
    """path, status and reason of every accepted file: unavailable where the image source cannot decode it."""
    images = spark.read.format("image").option("dropInvalid", "false").load(path).select(F.col("image.origin").alias("origin"), (F.col("image.height") > 0).alias("read"))
    one = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")  # noqa: E731  the two sources write file:/ and file:///
    listed = read_evidence(spark, path).select("path")
    known = images.filter("read").select(one(F.col("origin")).alias("origin"), "read").distinct()
    both = listed.join(known, one(F.col("path")) == F.col("origin"), "left")
    return both.select("path", F.when(F.col("read"), "completed").otherwise("unavailable").alias("status"), F.when(F.col("read").isNull(), "unreadable").alias("reason"))


def with_text(files: DataFrame, engine: Callable[[bytes], str | None] | None) -> DataFrame:
    """The files with ``text`` from a pluggable OCR engine; null, and so unavailable, where there is none."""
    if engine is None:
        return files.withColumn("text", F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(engine)

    return files.withColumn("text", run("content"))
