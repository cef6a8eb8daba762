"""Exact quantiles and an adaptive equal-width histogram of a money column.

Both work on the counts of distinct amounts. The histogram writes these as a table in
the shared folder, so that the rows are read once however many steps read the counts.
Single figures (bounds, quartiles, bin width) reach the next step as scalar
subqueries, so nothing is collected and nothing is cross joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.functions.text import decimal_text
from basketry.sources.shared import stored

# An amount in cents is split into three digits to this base, which covers
# decimal(18,2): no window below ever sorts more than a million rows at once.
_BASE = 1_000_000
_DIGITS = ("high", "middle", "low")


def amount_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per distinct amount (``amount``, ``weight``); null is one of them."""
    amounts = df.select(F.col(column).cast("decimal(18,2)").alias("amount"))
    return amounts.groupBy("amount").agg(F.count(F.lit(1)).alias("weight"))


def _as_digits(counts: DataFrame) -> DataFrame:
    cents = (F.col("amount") * 100).cast("bigint").alias("cents")
    low = F.pmod("cents", F.lit(_BASE)).alias("low")
    known = counts.where(F.col("amount").isNotNull()).select("amount", "weight", cents)
    known = known.select("*", low).withColumn("rest", F.expr(f"(cents - low) div {_BASE}"))
    known = known.withColumn("middle", F.pmod("rest", F.lit(_BASE)))
    return known.withColumn("high", F.expr(f"(rest - middle) div {_BASE}"))


def rows_before(counts: DataFrame) -> DataFrame:
    """Per distinct amount, the number of rows with a smaller one (``before``).

    A running total in amount order without one task sorting all amounts: totals
    run over the leading digits, over the next digits within each, and so on,
    and are added up.
    """
    digits = _as_digits(counts)
    ranked = None
    for level in reversed(range(len(_DIGITS))):
        prefix, digit = list(_DIGITS[:level]), _DIGITS[level]
        in_order = Window.partitionBy(*prefix).orderBy(digit)
        running = F.sum("weight").over(in_order) - F.col("weight")
        if ranked is None:
            ranked = digits.select("amount", *_DIGITS, "weight", running.alias("before"))
            continue
        totals = digits.groupBy(*prefix, digit).agg(F.sum("weight").alias("weight"))
        offsets = totals.select(*prefix, digit, running.alias("offset"))
        ranked = ranked.join(offsets, [*prefix, digit]).select(
            "amount", *_DIGITS, "weight", (F.col("before") + F.col("offset")).alias("before")
        )
    return ranked.select("amount", "weight", "before")


def exact_quantiles(counts: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """One row with the linearly interpolated quantiles ``q0``, ``q1``, ...

    Null amounts do not take part; all quantiles are null without amounts.
    """
    known = counts.where(F.col("amount").isNotNull())
    total = known.agg(F.sum("weight").alias("n")).scalar()
    ranked = rows_before(counts).withColumn("n", total)

    def amount_at(rank: Column) -> Column:
        here = (F.col("before") <= rank) & (rank < F.col("before") + F.col("weight"))
        return F.max(F.when(here, F.col("amount"))).cast("double")

    positions = [(F.col("n") - 1) * F.lit(float(q)) for q in quantiles]
    ends = ranked.agg(
        F.max("n").alias("n"),
        *[amount_at(F.floor(at)).alias(f"below{i}") for i, at in enumerate(positions)],
        *[amount_at(F.ceil(at)).alias(f"above{i}") for i, at in enumerate(positions)],
    )
    values = []
    for i, at in enumerate(positions):
        below, above = F.col(f"below{i}"), F.col(f"above{i}")
        values.append((below + (above - below) * (at - F.floor(at))).alias(f"q{i}"))
    return ends.select(*values)


def approx_quantiles(df: DataFrame, column: str, quantiles: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """One row with amounts ``q0``, ``q1``, ... of about these quantiles, from one pass.

    Each task keeps a summary that merges with those of others, so one row per task is
    shuffled. The rank of a result is off by at most ``n / accuracy``; it is an amount that
    occurs (the least whose rank reaches the quantile), where :func:`exact_quantiles`
    interpolates. Null amounts do not take part; without amounts all are null.
    """
    amount = F.col(column).cast("decimal(18,2)")
    found = df.agg(F.percentile_approx(amount, [float(q) for q in quantiles], accuracy).alias("found"))
    return found.select(*[F.get("found", F.lit(i)).alias(f"q{i}") for i in range(len(quantiles))])


def _histogram_shape(counts: DataFrame) -> DataFrame:
    """One row: bounds, number of bins, step and the two outer edges.

    The bin width is 2 * IQR / cube root of the number of rows (rows without an
    amount count here), or a fifth of the range where the quartiles coincide.
    """
    quartiles = exact_quantiles(counts, (0.25, 0.75))
    bounds = counts.agg(
        F.min("amount").cast("double").alias("low"),
        F.max("amount").cast("double").alias("high"),
        F.sum("weight").alias("n"),
    ).withColumn("iqr", quartiles.select(F.col("q1") - F.col("q0")).scalar())
    spread = F.col("high") - F.col("low")
    cube_root = F.pow(F.col("n").cast("double"), F.lit(1.0 / 3.0))
    adaptive = (F.col("iqr") > 0) & (F.col("n") > 1)
    width = F.when(adaptive, 2 * F.col("iqr") / cube_root).otherwise(spread / 5)
    # One bin where all amounts are equal: its width would be zero.
    bins = F.when(spread > 0, F.greatest(F.lit(1), F.floor(spread / width)))
    bins = bins.when(spread == 0, F.lit(1)).cast("bigint")

    def margin(amount: Column) -> Column:
        return F.when(amount == 0, F.lit(0.001)).otherwise(0.001 * F.abs(amount))

    flat = spread == 0
    return bounds.withColumn("bins", bins).select(
        "low",
        "high",
        "bins",
        (spread / F.col("bins")).alias("step"),
        F.when(flat, F.col("low") - margin(F.col("low")))
        .otherwise(F.col("low") - spread * 0.001)
        .alias("first_edge"),
        F.when(flat, F.col("high") + margin(F.col("high")))
        .otherwise(F.col("high"))
        .alias("last_edge"),
    )


def _edge(index: Column) -> Column:
    """Upper edge of a bin (bins count from 1; 0 is the lower edge of the first)."""
    shape = F.col("shape")
    inner = shape["low"] + index.cast("double") * shape["step"]
    return (
        F.when(index <= 0, shape["first_edge"])
        .when(index >= shape["bins"], shape["last_edge"])
        .otherwise(inner)
    )


def _bin_of(amount: Column) -> Column:
    """Right-closed bin: edges below the amount, counted with the edges themselves.

    Division gives the bin up to rounding; comparing with the two nearest edges
    settles amounts that lie on an edge.
    """
    shape = F.col("shape")
    guess = F.ceil(F.try_divide(amount - shape["low"], shape["step"]))
    guess = F.greatest(F.lit(1), F.least(shape["bins"], F.coalesce(guess, F.lit(1))))
    return (
        F.when((guess > 1) & (amount <= _edge(guess - 1)), guess - 1)
        .when((guess < shape["bins"]) & (amount > _edge(guess)), guess + 1)
        .otherwise(guess)
    )


def _interval_edge(edge: Column) -> Column:
    """Edge as shown: three decimals, three significant digits below one."""
    size = F.abs(edge)
    return (
        F.when(size < 0.01, F.bround(edge, 5))
        .when(size < 0.1, F.bround(edge, 4))
        .otherwise(F.bround(edge, 3))
    )


def equal_width_histogram(df: DataFrame, column: str) -> DataFrame:
    """Amounts per equal-width bin, empty bins included.

    Columns ``bin``, ``bin_left``, ``bin_right``, ``Price_Range`` (label with a
    lower edge below zero shown as 0) and ``Count``. Rows without an amount are
    in no bin.
    """
    counts = stored(amount_counts(df, column), "amounts")
    shape = stored(_histogram_shape(counts), "histogram-shape")
    as_struct = shape.select(F.struct(*shape.columns)).scalar()

    filled = (
        counts.where(F.col("amount").isNotNull())
        .withColumn("shape", as_struct)
        .select(_bin_of(F.col("amount").cast("double")).alias("bin"), "weight")
        .groupBy("bin")
        .agg(F.sum("weight").alias("Count"))
    )
    left, right = _interval_edge(_edge(F.col("bin") - 1)), _interval_edge(_edge(F.col("bin")))
    bins = (
        shape.select(F.explode(F.sequence(F.lit(1).cast("bigint"), "bins")).alias("bin"),
                     F.struct(*shape.columns).alias("shape"))
        .select("bin", F.greatest(F.lit(0.0), left).alias("bin_left"), right.alias("bin_right"))
    )
    shown_left = F.bround("bin_left", 2)
    label = F.concat(
        F.when(shown_left > 0, decimal_text(shown_left)).otherwise(F.lit("0")),
        F.lit(" - "),
        decimal_text(F.bround("bin_right", 2)),
    )
    return bins.join(filled, "bin", "left").select(
        "bin",
        "bin_left",
        "bin_right",
        label.alias("Price_Range"),
        F.coalesce("Count", F.lit(0)).alias("Count"),
    )
