"""Percentiles of very large numeric columns by radix selection; partial results by day can be added."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import checkpointed, small_side

DIGIT_BITS = 16
KEY_BITS = 64
MANTISSA = 1 << 52


def ordered_key(value: Column) -> Column:
    """The long whose order is the order of the finite double ``value``: its bits, reflected where negative.

    Spark SQL can't read a double's bits, so exponent and fraction come from exact operations: a division by a
    power of two and a subtraction in [1, 2). Negative zero equals zero. Null stays null.
    """
    v = value.cast("double")
    a = F.abs(v)
    e0 = F.floor(F.log2(a)).cast("int")
    two = lambda e: F.pow(F.lit(2.0), e)
    e1 = F.when(two(e0) > a, e0 - 1).when(two(e0 + 1) <= a, e0 + 1).otherwise(e0)
    e = F.greatest(F.lit(-1022), F.least(F.lit(1023), e1))
    subnormal = a < F.lit(2.2250738585072014e-308)
    fraction = ((a / two(e) - 1.0) * F.lit(float(MANTISSA))).cast("long")
    bits = F.when(a == 0, F.lit(0).cast("long")).when(subnormal, (a * two(F.lit(537)) * two(F.lit(537))).cast("long"))
    bits = bits.otherwise((e.cast("long") + 1023) * F.lit(MANTISSA) + fraction)
    return F.when(v < 0, -bits - 1).otherwise(bits)


def value_of_key(key: Column) -> Column:
    """The double of ``ordered_key``."""
    bits = F.when(key < 0, -(key + 1)).otherwise(key)
    e = F.shiftright(bits, 52).cast("int")
    fraction = bits.bitwiseAND(F.lit(MANTISSA - 1)).cast("double")
    size = F.when(e == 0, fraction * F.pow(F.lit(2.0), F.lit(-537)) * F.pow(F.lit(2.0), F.lit(-537)))
    size = size.otherwise((F.lit(1.0) + fraction / F.lit(float(MANTISSA))) * F.pow(F.lit(2.0), e - 1023))
    return F.when(key < 0, -size).otherwise(size)


def measurements(df: DataFrame, groups: list[str], metrics: dict[str, Column], day: Column, positive: bool = True) -> DataFrame:
    """(groups..., metric, day, key) of the values that are measurements.

    Null, NaN, infinite and negative values are none; neither is zero, where ``positive``. One scan serves all metrics.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("v")) for n, c in metrics.items()])
    long = df.select(*groups, F.to_date(day).alias("day"), F.explode(pairs).alias("m")).select(*groups, "day", "m.metric", "m.v")
    low = F.col("v") > 0 if positive else F.col("v") >= 0
    real = F.col("v").isNotNull() & ~F.isnan("v") & low & (F.col("v") < F.lit(float("inf")))
    return long.where(real).select(*groups, "metric", "day", ordered_key(F.col("v")).alias("key"))


def daily_histograms(measured: DataFrame, groups: list[str], digits: int = 2) -> DataFrame:
    """Partial results: counts by group, metric, day and the leading ``digits`` digits of the key.

    Histograms of days, partitions or clusters combine by adding counts. Two digits of 16 bits keep 20 bits of
    the fraction, so a percentile read from them is off by at most one part in 2**20.
    """
    shift = KEY_BITS - DIGIT_BITS * digits
    return measured.groupBy(*groups, "metric", "day", F.shiftright("key", shift).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def combine(*partials: DataFrame) -> DataFrame:
    """Add histograms of separate days or partitions; the day is summed away."""
    allrows = reduce(DataFrame.unionByName, partials)
    keys = [c for c in allrows.columns if c not in ("day", "n")]
    return allrows.groupBy(*keys).agg(F.sum("n").alias("n"))


def _followed(hist: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Of each target rank, the digit that contains it and the rank left within that digit.

    ``hist`` is (keys..., prefix, n); the prefix's values under one parent are at most 2**16, so a window over
    (keys..., parent) is bounded however many rows were counted.
    """
    w = Window.partitionBy(*keys, "parent").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("upto", F.sum("n").over(w))
    hit = (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))
    joined = targets.join(cum, [*keys, "parent"]).where(hit)
    return joined.select(*keys, "p", "total", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), F.col("prefix").alias("parent"))


def _start(counts: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """The target ranks of each group, ceil(p * n), with no digit followed yet."""
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    ps = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")
    targets = total.select(*keys, "total", ps).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.round(F.col("p") * F.col("total"), 9))).cast("long"))
    return targets.withColumn("parent", F.lit(0).cast("long"))


def _in_partials(histograms: DataFrame, keys: list[str], probs: list[float], digits: int) -> DataFrame:
    """Target ranks followed through all ``digits`` digits of added partial results."""
    counts = checkpointed(combine(histograms))
    targets = _start(counts, keys, probs)
    for left in reversed(range(digits)):
        # the top digit has no parent; below, only counts under a followed prefix are added up
        parent = F.lit(0).cast("long") if left == digits - 1 else F.shiftright("prefix", DIGIT_BITS * (left + 1))
        live = counts.withColumn("parent", parent)
        if left < digits - 1:
            live = live.join(small_side(targets.select(*keys, "parent").distinct()), [*keys, "parent"], "left_semi")
        hist = live.groupBy(*keys, "parent", F.shiftright("prefix", DIGIT_BITS * left).alias("prefix")).agg(F.sum("n").alias("n"))
        targets = checkpointed(_followed(hist, targets, keys))
    return targets


def _result(targets: DataFrame, keys: list[str], shift: int) -> DataFrame:
    low = F.shiftleft("parent", shift)
    width = value_of_key(low + F.lit((1 << shift) - 1)) - value_of_key(low) if shift else F.lit(0.0)
    return targets.select(*keys, "p", value_of_key(low).alias("value"), F.col("total").alias("n"), width.alias("error_bound"))


def percentiles(histograms: DataFrame, groups: list[str], probs: list[float], digits: int = 2) -> DataFrame:
    """(groups..., metric, p, value, n, error_bound) from partial results of ``daily_histograms``; no raw row is read.

    ``histograms`` holds the counts of any days, partitions or clusters, each once (``combine`` adds them); ``digits``
    is what they were made with. Radix selection over the added counts: digit by digit, only the digit that contains
    the rank ceil(p * n) is followed. The value is the lower end of the last digit and ``error_bound`` its width, so the
    exact percentile lies within [value, value + error_bound]. A group without measurements gives no row.
    """
    keys = [*groups, "metric"]
    return _result(_in_partials(histograms, keys, probs, digits), keys, KEY_BITS - DIGIT_BITS * digits)


def radix_percentiles(measured: DataFrame, groups: list[str], probs: list[float], partials: DataFrame | None = None, digits: int = 2) -> DataFrame:
    """(groups..., metric, p, value, n, error_bound 0.0): the exact value of rank ceil(p * n) of each group.

    The leading ``digits`` digits are followed in the partial results by day (``partials``; made here if not given), the rest
    in the rows: each pass counts the next 16 bits of those keys only that share a followed prefix with some target
    rank, two passes after two digits. Counts combine before the shuffle, so a group with a third of all rows costs
    its distinct digits.

    A group without measurements gives no row. Ties are the same key.
    """
    keys = [*groups, "metric"]
    targets = _in_partials(daily_histograms(measured, groups, digits) if partials is None else partials, keys, probs, digits)
    shift = KEY_BITS - DIGIT_BITS * digits
    while shift:
        parents = small_side(targets.select(*keys, "parent").distinct())
        live = measured.select(*keys, "key", F.shiftright("key", shift).alias("parent")).join(parents, [*keys, "parent"], "left_semi")
        shift -= DIGIT_BITS
        hist = live.groupBy(*keys, "parent", F.shiftright("key", shift).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        targets = checkpointed(_followed(hist, targets, keys))
    return _result(targets, keys, 0)
