"""Abundance histograms and the automatic cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values: (steps, width) of the abundance classes; 257 thresholds from 0.
DISCRETE_STEPS = [(70, 1), (15, 2), (40, 10), (25, 20), (40, 100), (25, 200), (40, 1000)]


def histogram(counts: DataFrame, most: int | None = 10_000, col: str = "abundance") -> DataFrame:
    """(idx, abundance): k-mers of each abundance; what is beyond ``most`` is in the last bin. None: a bin for each."""
    idx = F.col(col) if most is None else F.least(F.col(col), F.lit(most))
    return counts.groupBy(idx.cast("bigint").alias("idx")).agg(F.count("*").alias("abundance"))


def histogram_2d(counts: DataFrame, n: int, most: int = 10_000, most_first: int = 255) -> DataFrame:
    """(rest, first, n): by the sum over all banks but the first, and by the first bank."""
    rest = sum((F.col(f"c{i}") for i in range(1, n)), F.lit(0))
    return counts.groupBy(F.least(rest, F.lit(most)).cast("bigint").alias("rest"), F.least(F.col("c0"), F.lit(most_first)).cast("bigint").alias("first")).agg(F.count("*").alias("n"))


def smoothed(hist: DataFrame, by: tuple[str, ...] = (), length: int = 10_000) -> DataFrame:
    """(by.., idx, abundance, smooth): bins 0 to ``length`` + 1, missing ones as zero, with weights .2,
    .6, .2 over neighbouring bins, cut to whole numbers. The first bin has weights .6, .4; bin 0 and the
    bins from ``length`` on are 0."""
    bins = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(length + 1).cast("bigint"))).alias("idx")
    every = hist.select(*by).distinct().select(*by, bins) if by else hist.sparkSession.range(length + 2).select(F.col("id").alias("idx"))
    rows = every.join(hist.select(*by, F.col("idx").cast("bigint").alias("idx"), "abundance"), [*by, "idx"], "left")
    rows = rows.select(*by, "idx", F.coalesce("abundance", F.lit(0)).alias("abundance"))
    w, n = Window.partitionBy(*by).orderBy("idx"), F.col("abundance").cast("double")
    inner = F.lit(0.2) * F.lag(n).over(w) + F.lit(0.6) * n + F.lit(0.2) * F.lead(n).over(w)
    smooth = F.when((F.col("idx") == 0) | (F.col("idx") >= length), 0).when(F.col("idx") == 1, F.lit(0.6) * n + F.lit(0.4) * F.lead(n).over(w)).otherwise(inner)
    return rows.withColumn("smooth", F.floor(smooth).cast("bigint"))


def cutoffs(hist: DataFrame, by: tuple[str, ...] = (), length: int = 10_000, least: int = 3) -> DataFrame:
    """(by.., cutoff, first_peak, nb_solids, weak_volume): the abundance from which k-mers are solid. It
    is the valley before the first peak of the smoothed histogram, but no more than what eliminates a
    quarter of the volume, and ``least`` at least. A histogram that never rises gives ``least`` alone.
    Bins are ``length`` rows a bank, whatever the number of k-mers."""
    key = list(by) or ["_one"]
    keyed = lambda df: df if by else df.withColumn("_one", F.lit(1))
    w = Window.partitionBy(*key).orderBy("idx")
    volume = F.when(F.col("idx") <= length, F.col("idx") * F.col("abundance")).otherwise(0)
    rows = keyed(smoothed(hist, by, length))
    rows = rows.withColumns({"before": F.lag("smooth").over(w), "gone": F.sum(volume).over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum(volume).over(Window.partitionBy(*key))})
    inner = F.col("idx").between(2, length - 1)
    marks = rows.groupBy(*key).agg(F.min(F.when(inner & (F.col("before") < F.col("smooth")), F.col("idx") - 1)).alias("rise"), F.min(F.when((F.col("idx") <= length) & (F.col("gone") / F.nullif("total", F.lit(0)) >= 0.25), F.col("idx") + 1)).alias("cap"))
    rows = rows.join(marks, key)
    peak = rows.where((F.col("idx") > F.col("rise")) & (F.col("idx") < length)).groupBy(*key).agg((-F.max(F.struct("smooth", (-F.col("idx")).alias("i"))).i).alias("first_peak"))
    valley = rows.join(peak, key).where(F.col("idx").between(F.col("rise"), F.col("first_peak"))).groupBy(*key, "first_peak").agg(F.min(F.struct("smooth", "idx")).idx.alias("valley"))
    found = rows.join(valley, key).withColumn("cutoff", F.greatest(F.least("valley", "cap"), F.lit(least)))
    solid = F.sum(F.when(F.col("idx").between(F.col("cutoff"), length), F.col("abundance")).otherwise(0)).alias("nb_solids")
    weak = F.sum(F.when(F.col("idx") < F.col("cutoff"), F.col("idx") * F.col("abundance")).otherwise(0))
    found = found.groupBy(*key, "cutoff", "first_peak").agg(solid, (weak / F.first("total")).alias("weak_volume"))
    out = marks.select(*key).join(found, key, "left")
    return out.select(*by, F.coalesce("cutoff", F.lit(least)).cast("int").alias("cutoff"), "first_peak", "nb_solids", "weak_volume")


def discrete_thresholds() -> list[int]:
    out = [0]
    for steps, width in DISCRETE_STEPS:
        out += [out[-1] + width * (i + 1) for i in range(steps)]
    return [*out, out[-1]][:257]


def discrete_class(abundance: Column) -> Column:
    """Index of the class of an abundance: the last threshold that it reaches, by arithmetic on the
    steps."""
    out, base, index = F.lit(0).cast("bigint"), 0, 0
    for steps, width in DISCRETE_STEPS:
        out = F.when(abundance > base, index + F.least(F.floor((abundance - base) / width), F.lit(steps))).otherwise(out)
        base, index = base + steps * width, index + steps
    return out.cast("bigint")


def discrete_value(abundance: Column) -> Column:
    """The abundance that stands for its class."""
    out, base = F.lit(0).cast("bigint"), 0
    for steps, width in DISCRETE_STEPS:
        out = F.when(abundance > base, base + width * F.least(F.floor((abundance - base) / width), F.lit(steps))).otherwise(out)
        base += steps * width
    return out.cast("bigint")


def cumulative_volume(hist: DataFrame) -> DataFrame:
    """(idx, abundance, volume): volume of all k-mers up to an abundance; as many rows as bins."""
    w = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("volume", F.sum(F.col("idx") * F.col("abundance")).over(w))
