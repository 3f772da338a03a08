"""What the corpus operators share: input columns, words, and let-bindings for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, and tab to carriage return.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row.

    A lambda variable stands for the value, so that neither the optimizer nor nested lambdas
    repeat its expression.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """The frame, after limiting Arrow batches to 32 MB in its session, unless its configuration says otherwise.

    Batches are else limited by rows alone, and ten thousand very long texts are too much for a worker."""
    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(32 << 20))
    return df


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    pieces = F.split(F.coalesce(text, F.lit("")), WHITE)
    return F.filter(pieces, lambda w: w != "")


def digits(column: Column) -> Column:
    """A document id as text; null ids as the word null."""
    return F.coalesce(column.cast("string"), F.lit("null"))


#: Bits of a sieve: its size does not grow with the data, so it may be broadcast.
SIEVE_BITS = 1 << 23


def sieve(keys: DataFrame, name: str) -> DataFrame:
    """A bit for each hash in column ``h`` of ``keys``: at most 256 rows of 4 KB.

    What it lets through may still be unwanted, as in any Bloom filter; a join decides. It keeps
    rows that no join will want from being shuffled."""
    from evidentia.plans.staging import staged

    spot = F.pmod(F.col("h"), F.lit(SIEVE_BITS))
    bits = keys.groupBy(F.bitmap_bucket_number(spot).alias("sieve_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("sieve_bits"))
    return staged(bits, name)


def sieved(df: DataFrame, bits: DataFrame, h: Column) -> DataFrame:
    """The rows of ``df`` whose hash has a bit in the sieve, without a shuffle."""
    spot = F.pmod(h, F.lit(SIEVE_BITS))
    place = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring("sieve_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    own = df.columns
    return df.withColumn("sieve_bucket", F.bitmap_bucket_number(spot)).join(F.broadcast(bits), "sieve_bucket").filter(hit).select(*own)
