"""Pixel arithmetic: dequantize, choose bands, normalize, clip, quantize."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANNELS = 128


def checked_bands(bands: Sequence[int], exactly: int | None = None, channels: int | None = None) -> list[int]:
    """Bands as a list; errors are raised here, before any job."""
    bands = list(bands)
    if exactly is not None and len(bands) != exactly:
        raise ValueError(f"{exactly} bands are needed, not {len(bands)}")
    for b in bands:
        if not isinstance(b, int) or b < 0 or channels is not None and b >= channels:
            raise ValueError(f"no band {b!r}")
    return bands


def dequantized(q: Column, scale: Column) -> Column:
    """float32 values of a quantized vector; both sides are cast first, since an integer times a float is a double."""
    return F.transform(q, lambda x: (x.cast("float") * scale.cast("float")).cast("float"))


def band_values(q: Column, scale: Column, bands: Sequence[int]) -> Column:
    """array<struct(band, value)> of some bands alone, in their order, as doubles."""
    return F.array(*(F.struct(F.lit(b).alias("band"), (F.get(q, F.lit(b)).cast("double") * scale.cast("double")).alias("value")) for b in bands))


def exploded(pixels: DataFrame, bands: Sequence[int] | None = None) -> DataFrame:
    """A row for each pixel and band, with ``band`` and ``value``; only the bands asked for leave the vector."""
    keep = [c for c in pixels.columns if c not in ("q", "scale")]
    if bands is None:
        return pixels.select(*keep, "scale", F.posexplode("q").alias("band", "__q")).select(*keep, "band", (F.col("__q").cast("double") * F.col("scale").cast("double")).alias("value"))
    return pixels.select(*keep, F.explode(band_values(F.col("q"), F.col("scale"), checked_bands(bands))).alias("__b")).select(*keep, "__b.band", "__b.value")


def clipped(v: Column) -> Column:
    """Between 0 and 1; NaN stays NaN."""
    return F.when(F.isnan(v), v).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))


def to_u8(v: Column) -> Column:
    """0 to 255 by truncation; NaN becomes 0."""
    return F.when(F.isnan(v), F.lit(0)).otherwise((clipped(v) * 255).cast("int"))


def scaled(v: Column, low: Column, high: Column) -> Column:
    """(v - low) / (high - low) where the band isn't constant; else v."""
    return F.when(high > low, (v - low) / (high - low)).otherwise(v)


def normalized_by_tile(rows: DataFrame, tile: Sequence[str] = ("tile",)) -> DataFrame:
    """Min-max within each tile and band; a band with NaN stays as it is.

    Extremes are aggregated map-side and joined back, so a tile's pixels need
    not meet in one task as they would under a window.
    """
    keys = [*tile, "band"]
    some = F.max(F.isnan("value"))
    ends = rows.groupBy(*keys).agg(F.min("value").alias("__low"), F.max("value").alias("__high"), some.alias("__nan"))
    new = F.when(F.col("__nan"), F.col("value")).otherwise(scaled(F.col("value"), F.col("__low"), F.col("__high")))
    return rows.join(ends, keys).withColumn("value", new).drop("__low", "__high", "__nan")


def normalized_by_window(rows: DataFrame, tile: Sequence[str] = ("tile",)) -> DataFrame:
    """The same by a window: one shuffle of all rows, for tiles that fit a task."""
    w = Window.partitionBy(*tile, "band")
    return rows.withColumn("value", scaled(F.col("value"), F.min("value").over(w), F.max("value").over(w)))


def band_ranges(rows: DataFrame) -> DataFrame:
    """Least and greatest nonzero value of each band; as many rows as bands."""
    data = F.col("value") != 0
    return rows.groupBy("band").agg(F.min(F.when(data, F.col("value"))).alias("__low"), F.max(F.when(data, F.col("value"))).alias("__high"))


def normalized_globally(rows: DataFrame) -> DataFrame:
    """Min-max of each band over all nonzero values; zeros, which are no data, stay zero.

    The ranges are a row for each band, so broadcasting them is bounded by the
    number of bands.
    """
    new = F.when(F.col("value") != 0, scaled(F.col("value"), F.col("__low"), F.col("__high"))).otherwise(F.col("value"))
    return rows.join(F.broadcast(band_ranges(rows)), "band").withColumn("value", new).drop("__low", "__high")


def visible(rows: DataFrame, column: str = "value") -> DataFrame:
    """0/1 masks become 0/255; other value ranges stay."""
    binary = rows.agg((F.min(column) >= 0) & (F.max(column) <= 1)).scalar()
    return rows.withColumn(column, F.when(binary, F.col(column) * 255).otherwise(F.col(column)))
