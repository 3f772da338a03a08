"""Image indicators over 8 by 8 tiles, and regions that repeat within one image.

Tiles are arrays of 64 values, row by row. The indicators are array expressions; the transform's
basis is a constant. Thresholds are for the caller to set: an indicator is an observation.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDE = 8


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dct_coefficient(tile: Column, u: int, v: int) -> Column:
    """The DCT-II coefficient (u down, v across) of a tile, orthonormal."""
    scale = lambda k: math.sqrt((1 if k == 0 else 2) / SIDE)
    basis = [scale(u) * scale(v) * math.cos((2 * y + 1) * u * math.pi / (2 * SIDE)) * math.cos((2 * x + 1) * v * math.pi / (2 * SIDE)) for y in range(SIDE) for x in range(SIDE)]
    return _sum(F.zip_with(tile, F.array(*[F.lit(b) for b in basis]), lambda t, b: t.cast("double") * b))


def high_frequency_share(tile: Column) -> Column:
    """The share of a tile's energy, the mean left out, above the lowest frequencies (u + v >= 4).

    By Parseval the whole energy is the sum of squares, so only ten coefficients are computed."""
    energy = _sum(F.transform(tile, lambda t: t.cast("double") * t.cast("double")))
    low = [dct_coefficient(tile, u, v) for u in range(4) for v in range(4 - u)]
    squares = [c * c for c in low]
    below = squares[0]
    for s in squares[1:]:
        below = below + s
    rest = energy - squares[0]
    return F.when(rest > 1e-12, (energy - below) / rest).otherwise(0.0)


def noise_residual(tile: Column) -> Column:
    """The variance of differences between neighbours in a row."""
    steps = F.filter(F.transform(tile, lambda t, i: F.when(i % SIDE != SIDE - 1, F.get(tile, i + 1).cast("double") - t.cast("double"))), lambda d: d.isNotNull())
    n = F.size(steps)
    mean = _sum(steps) / n
    return _sum(F.transform(steps, lambda d: d * d)) / n - mean * mean


def texture_variance(tile: Column) -> Column:
    n = F.size(tile)
    mean = _sum(F.transform(tile, lambda t: t.cast("double"))) / n
    return _sum(F.transform(tile, lambda t: t.cast("double") * t.cast("double"))) / n - mean * mean


def texture_entropy(tile: Column, low: float, high: float, bins: int = 8) -> Column:
    """The entropy in bits of a histogram of the tile's values between low and high."""
    spot = lambda t: F.least(F.greatest(F.floor((t.cast("double") - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))
    total = F.lit(0.0)
    in_bin = lambda b: lambda t: spot(t) == b
    for b in range(bins):
        share = F.size(F.filter(tile, in_bin(b))) / F.size(tile)
        total = total - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    return total


def blockiness(pixels: DataFrame, block: int = 8) -> DataFrame:
    """How much larger steps across block boundaries are than other steps, for each image.

    pixels: img_id, x, y, v. One window along the rows, one aggregate."""
    step = F.abs(F.col("v") - F.lag("v").over(Window.partitionBy("img_id", "y").orderBy("x")))
    steps = pixels.withColumn("step", step).filter("step is not null")
    edge = F.col("x") % block == 0
    mean = lambda c: F.avg(F.when(c, F.col("step")))
    return steps.groupBy("img_id").agg(mean(edge).alias("edge_step"), mean(~edge).alias("inner_step")).withColumn("ratio", F.col("edge_step") / F.nullif("inner_step", F.lit(0.0)))


def tile_anomalies(tiles: DataFrame, value: str, limit: float = 3.0) -> DataFrame:
    """Tiles with their z-score within the image, and whether it lies beyond the limit."""
    image = Window.partitionBy("img_id")
    spread = F.stddev_pop(value).over(image)
    z = F.when(spread > 0, (F.col(value) - F.avg(value).over(image)) / spread).otherwise(0.0)
    return tiles.withColumn("z", z).withColumn("anomalous", F.abs("z") > limit)


def _offsets(cells: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(dy * (2 * width) + dx, votes) over all pairs of the places ``cells`` (y * width + x, ascending) of one content.

    Few places give their pairs; many are correlated with themselves, which counts all pairs without making them."""
    y, x = np.divmod(cells, width)
    if len(cells) <= 2048:
        i, j = np.triu_indices(len(cells), 1)
        return np.unique((y[j] - y[i]) * (2 * width) + x[j] - x[i], return_counts=True)
    y, x = y - y.min(), x - x.min()
    high, wide = int(y.max()) + 1, int(x.max()) + 1
    grid = np.zeros((high, wide))
    grid[y, x] = 1
    spectrum = np.abs(np.fft.rfft2(grid, (2 * high, 2 * wide))) ** 2
    pairs = np.rint(np.fft.irfft2(spectrum, (2 * high, 2 * wide))).astype(np.int64)
    dy, dx = np.nonzero(pairs)
    votes = pairs[dy, dx]
    dy, dx = np.where(dy >= high, dy - 2 * high, dy), np.where(dx >= wide, dx - 2 * wide, dx)
    ahead = (dy > 0) | (dy == 0) & (dx > 0)
    return dy[ahead] * (2 * width) + dx[ahead], votes[ahead]


def _block_codes(image: np.ndarray, size: int, step: float, near: float | None) -> list[np.ndarray]:
    """For every block a number that equal contents share, -1 for blocks to leave out; two such grids for near copies."""
    windows = np.lib.stride_tricks.sliding_window_view(image, (size, size)).reshape(-1, size * size)
    whole = np.isfinite(windows).all(1)
    flat = np.full(len(windows), True)
    flat[whole] = np.floor(windows[whole] / step).max(1) == np.floor(windows[whole] / step).min(1)
    use = np.flatnonzero(whole & ~flat)

    def numbered(features: np.ndarray) -> np.ndarray:
        codes = np.full(len(windows), -1)
        if len(use):
            codes[use] = np.unique(features, axis=0, return_inverse=True)[1].ravel()
        return codes

    if near is None:
        return [numbered(np.floor(windows[use] / step))]
    # Means of the four quarters, from cumulative sums: noise averages out in them.
    half = size // 2
    sums = np.pad(np.nan_to_num(image).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    y, x = np.divmod(use, image.shape[1] - size + 1)
    quarter = lambda a, b: (sums[y + a + half, x + b + half] - sums[y + a, x + b + half] - sums[y + a + half, x + b] + sums[y + a, x + b]) / half**2
    features = np.stack([quarter(a, b) for a in (0, half) for b in (0, half)], 1)
    return [numbered(np.floor(features / near + shift)) for shift in (0.0, 0.5)]


def _copied(img_id: object, image: np.ndarray, size: int, least_offset: int, step: float, near: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """dx, dy and votes of one image."""
    height, width = image.shape[0] - size + 1, image.shape[1] - size + 1
    found: dict[int, int] = {}
    for codes in _block_codes(image, size, step, near) if height > 0 and width > 0 else []:
        order = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.diff(codes[order], prepend=-2))
        votes: dict[int, int] = {}
        for first, last in zip(cuts, [*cuts[1:], len(order)]):
            if codes[order[first]] >= 0 and last - first > 1:
                for key, n in zip(*(part.tolist() for part in _offsets(order[first:last], width))):
                    votes[key] = votes.get(key, 0) + n
        for key, n in votes.items():
            found[key] = max(found.get(key, 0), n)
    keys, n = np.array(list(found), np.int64), np.array(list(found.values()), np.int64)
    dy = np.floor_divide(keys + width, 2 * width)
    dx = keys - dy * 2 * width
    far = np.maximum(np.abs(dx), np.abs(dy)) >= least_offset
    return dx[far], dy[far], n[far]


def copy_move(pixels: DataFrame, size: int = 4, least_offset: int = 4, step: float = 1, near: float | None = None) -> DataFrame:
    """Offsets at which blocks of an image repeat: img_id, dx, dy, n_blocks.

    pixels: img_id, x, y, v; a null v, or none, leaves its blocks out. Every block of ``size`` by
    ``size`` pixels, at every place, is quantised by ``step``; flat blocks say nothing and are left out.
    All pairs of places with equal content vote for their offset, the later in reading order less the
    earlier, so three equal blocks give three offsets. With ``near``, blocks whose quarters have means in
    one cell of that size (in either of two grids) count as equal, so noise and recompression do not
    hide a copy; a few votes are then expected by chance. A task holds one image at a time."""
    kind = pixels.schema["img_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        key = table.column("img_id").slice(0, 1)
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        image = np.full((int(y.max() - y.min()) + 1, int(x.max() - x.min()) + 1), np.nan)
        image[y - y.min(), x - x.min()] = table.column("v").to_numpy()
        dx, dy, n = _copied(key[0], image, size, least_offset, step, near)
        keys = pa.array(key.to_pylist() * len(dx), key.type)
        return pa.table({"img_id": keys, "dx": pa.array(dx, pa.int64()), "dy": pa.array(dy, pa.int64()), "n_blocks": pa.array(n, pa.int64())})

    rows = pixels.filter("x is not null and y is not null").select("img_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("v").cast("double").alias("v"))
    return rows.groupBy("img_id").applyInArrow(run, f"img_id {kind}, dx long, dy long, n_blocks long")


def coefficient_periods(coefficients: DataFrame, periods: tuple[float, ...] = (2, 3, 4, 5, 6, 7)) -> DataFrame:
    """img_id, u, v, n, period and strength: how periodic each frequency's histogram of quantised coefficients is.

    coefficients: img_id, u, v, q (whole numbers: coefficients over the last quantiser's step). Two
    quantisers, one after the other, leave peaks and gaps at a fixed distance in the histogram, which
    is a strong Fourier coefficient of it; one quantiser leaves it smooth. The distance is the ratio of their
    steps, which need not be whole. Zeros, which any picture has
    most of, do not count. The Fourier sums are added up as the rows are counted, so no histogram is
    gathered; the strength lies between 0 and 1, null where a frequency has zeros only. Strengths alike to
    nine digits are a tie, which the shortest period wins: the last bits depend on the order of the sums."""
    q, turn = F.col("q"), 2 * math.pi
    sums = [g for k, p in enumerate(periods) for g in (F.sum(F.cos(q * (turn / p))).alias(f"c{k}"), F.sum(F.sin(q * (turn / p))).alias(f"s{k}"))]
    summed = coefficients.filter("q <> 0").groupBy("img_id", "u", "v").agg(F.count("*").alias("n"), *sums)
    strengths = [F.sqrt(F.col(f"c{k}") ** 2 + F.col(f"s{k}") ** 2) / F.col("n") for k in range(len(periods))]
    best = F.array_max(F.array(*[F.struct(F.round(s, 9).alias("strength"), F.lit(-p).alias("order")) for s, p in zip(strengths, periods)]))
    return summed.select("img_id", "u", "v", "n", (-best["order"]).alias("period"), F.array_max(F.array(*strengths)).alias("strength"))


def quantised_coefficients(tiles: DataFrame, steps: dict[tuple[int, int], float]) -> DataFrame:
    """img_id, u, v, q of tiles (img_id, tile) for the frequencies in ``steps``, each over its step and rounded."""
    asked = [F.struct(F.lit(u).alias("u"), F.lit(v).alias("v"), F.round(dct_coefficient(F.col("tile"), u, v) / step).cast("long").alias("q")) for (u, v), step in steps.items()]
    return tiles.select("img_id", F.inline_outer(F.array(*asked)))


def repeated_lines(documents: DataFrame, least: int = 30) -> DataFrame:
    """Long lines that occur more than once in a document: doc_id, line, n, first and last place."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.length("line") >= least)
    return rows.groupBy("doc_id", "line").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")).filter("n > 1")
