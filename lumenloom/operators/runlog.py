"""Run-log analytics: running best, streaks, early stop, retention, schedules and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.functions import text as T
from lumenloom.operators.skew import broadcast_small, small


def running_best(df: DataFrame, run: str, order: list[str], metric: str) -> DataFrame:
    """``verdict``: keep if the metric is below every earlier one of its run; a null is discarded."""
    earlier = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(metric).over(earlier)
    keep = F.col(metric).isNotNull() & (best.isNull() | (F.col(metric) < best))
    return df.withColumn("verdict", F.when(keep, "keep").otherwise("discard"))


def failure_streak(df: DataFrame, run: str, order: list[str], failed: Column) -> DataFrame:
    """``streak``: consecutive failures up to each row, zero after a success."""
    window = Window.partitionBy(run).orderBy(*order)
    marked = df.withColumn("_f", F.coalesce(failed.cast("int"), F.lit(0)))
    islands = marked.withColumn("_g", F.sum(1 - F.col("_f")).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(run, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn("streak", F.sum("_f").over(inside)).drop("_f", "_g")


def early_stop(df: DataFrame, run: str, order: list[str], failed: Column, patience: int) -> DataFrame:
    """``run, stop``: the first place in the order at which the streak reaches the patience; null if none."""
    streaks = failure_streak(df, run, order, failed)
    return streaks.groupBy(run).agg(F.min(F.when(F.col("streak") >= patience, F.col(order[0]))).alias("stop"))


def keep_last(names: DataFrame, column: str, most: int) -> DataFrame:
    """The ``most`` names with the largest numeric suffix."""
    return names.withColumn("step", T.numeric_suffix(F.col(column))).where("step is not null").orderBy(F.desc("step")).limit(most)


def shift(length: Column, base: int = 256, most: int = 4096, low: float = 0.5, high: float = 1.15) -> Column:
    """Linear schedule shift of a sequence length."""
    slope = (high - low) / (most - base)
    return length * F.lit(slope) + F.lit(low - slope * base)


def empirical_shift(length: Column, steps: Column) -> Column:
    """Shift by sequence length and number of steps: linear in the steps between two lines in the length,
    the one of 10 and the one of 200 steps; above a length of 4300 the latter alone."""
    # fixed values: slope and intercept of the two lines
    at10 = F.lit(8.73809524e-05) * length + F.lit(1.89833333)
    at200 = F.lit(0.00016927) * length + F.lit(0.45666666)
    return F.when(length > 4300, at200).otherwise(at10 + (at200 - at10) * (steps - 10) / 190.0)


def linear_decay(first: Column, last: Column, total: Column, now: Column) -> Column:
    return F.when(now >= total, last).otherwise(first + (last - first) * now / total)


def schedule(steps: int, shifted: float = 3.0) -> Column:
    """Sigmas 1 to 0 in ``steps`` even steps, shifted, with a closing zero."""
    even = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: 1.0 - i / F.lit(float(max(steps - 1, 1))))
    return F.concat(F.transform(even, lambda s: shifted * s / (1 + (shifted - 1) * s)), F.array(F.lit(0.0)))


def time_shift(mu: Column, power: float, t: Column) -> Column:
    """e^mu / (e^mu + (1/t - 1)^power); 0 at t = 0."""
    return F.when(t <= 0, F.lit(0.0)).otherwise(F.exp(mu) / (F.exp(mu) + F.pow(1 / t - 1, F.lit(power))))


def interpolate(clean: Column, noise: Column, sigma: Column) -> Column:
    return F.zip_with(clean, noise, lambda x, n: (1 - sigma) * x + sigma * n)


def euler(sample: Column, velocity: Column, delta: Column) -> Column:
    return F.zip_with(sample, velocity, lambda x, v: x + delta * v)


def guided(positive: Column, negative: Column, scale: float) -> Column:
    """Classifier-free guidance p + g (p - n)."""
    return F.zip_with(positive, negative, lambda p, n: p + scale * (p - n))


def guided_capped(positive: Column, negative: Column, scale: float, cap: float) -> Column:
    """Guidance whose norm is at most ``cap`` times that of the positive part; no cap if that is 0."""
    from lumenloom.operators.vectors import norm

    out = guided(positive, negative, scale)
    if cap <= 0:
        return out
    most, own = norm(positive) * cap, norm(out)
    return F.when(own > most, F.transform(out, lambda x: x * (most / own))).otherwise(out)


def discrete_logit_normal(normal: Column, steps: int) -> Column:
    """A step of a schedule from a standard normal number: its sigmoid's place among the steps."""
    return F.floor(F.least(F.greatest(steps / (1 + F.exp(-normal)), F.lit(0.0)), F.lit(steps - 1.0)))


def student_step(key: Column, step: Column, timesteps: list[int], warmup: int, seed: int = 42) -> Column:
    """A timestep drawn by weights that depend on the training step: the last two evenly during the warm-up,
    then the first seven times in ten and the others evenly."""
    from lumenloom.operators.sampling import weighted_pick

    n = len(timesteps)
    early = list(zip(timesteps[-2:], [0.5, 0.5][-n:], strict=True))
    late = [(timesteps[0], 0.7), *[(t, 0.3 / max(1, n - 1)) for t in timesteps[1:]]]
    return F.when(step < warmup, weighted_pick(key, early, seed)).otherwise(weighted_pick(key, late, seed))


def relative_l1(now: Column, before: Column) -> Column:
    """The mean absolute difference of two vectors against the mean absolute element of the earlier one."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))) / F.size(v)
    apart = F.zip_with(now, before, lambda a, b: a.cast("double") - b.cast("double"))
    return mean(apart) / (mean(before) + 1e-6)


def polynomial(x: Column, coefficients: list[float]) -> Column:
    """The coefficients from the highest power to the constant, by Horner's rule."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return out


def clip_threshold(norm: Column, most: Column, step: Column, start: int, abnormal: float = 5.0, least: float = 10.0) -> Column:
    """The clipping threshold: beyond the start, a norm abnormally far above it lowers it, by ``least`` times at most."""
    ratio = norm / most
    return F.when((ratio > abnormal) & (step > start), most / F.least(ratio, F.lit(least))).otherwise(most)


def hinge(real: Column, fake: Column) -> Column:
    """Mean hinge loss of a discriminator: an aggregate."""
    return F.avg(F.greatest(F.lit(0.0), 1 - real)) + F.avg(F.greatest(F.lit(0.0), 1 + fake))


def clipped_mse(difference: Column, limit: float = 50.0) -> Column:
    """Mean square of the differences up to the limit, over all elements: an aggregate."""
    return F.avg(F.when(F.abs(difference) <= limit, difference * difference).otherwise(0.0))


def nearest_row(left: DataFrame, right: DataFrame, key: str, other: str, order: str) -> DataFrame:
    """Each left row with the right row whose ``other`` is nearest to ``key``, the first by ``order`` among
    equals. The right side is a schedule, some tens of rows: it travels as one row, nothing is shuffled."""
    row = F.struct(*[F.col(c) for c in right.columns])
    table = right.agg(F.collect_list(F.struct(F.col(other).alias("at"), F.col(order).alias("o"), row.alias("r"))).alias("_rows"))
    apart = F.transform(small(F.col("_rows"), "schedule"), lambda c: F.struct(F.abs(F.col(key) - c["at"]).alias("d"), c["o"].alias("o"), c["r"].alias("r")))
    return left.crossJoin(F.broadcast(table)).withColumn("_best", F.array_min(apart)["r"]).select(*left.columns, "_best.*")


def exact_row(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """``left`` joined with the one row of ``right`` (a schedule, some tens of rows) whose ``other`` equals
    ``key``. A key without such a row, a null one included, or with several is an error, raised when the row is read."""
    table = right.groupBy(F.col(other).alias("_at")).agg(F.count(F.lit(1)).alias("_times"), F.first(F.struct(*[F.col(c) for c in right.columns])).alias("_row"))
    joined = left.join(broadcast_small(table, "schedule"), F.col(key) == F.col("_at"), "left")
    wrong = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    times = F.coalesce(F.col("_times"), F.lit(0))
    guard = F.when(times == 1, F.col("_row")).otherwise(F.raise_error(F.concat(F.lit("schedule rows for "), wrong, F.lit(": "), times.cast("string"))).cast(table.schema["_row"].dataType))
    return joined.withColumn("_row", guard).select(*left.columns, *[F.col(f"_row.{c}").alias(c) for c in right.columns if c not in left.columns])


def fold_threshold(values: Column, threshold: float) -> Column:
    """For each value of an ordered array whether it is skipped: distances add up until they reach the
    threshold, then the step is computed and the sum starts again. The first is always computed."""
    start = F.struct(F.lit(0.0).alias("sum"), F.expr("cast(array() as array<boolean>)").alias("out"), F.lit(True).alias("first"))

    def step(s: Column, v: Column) -> Column:
        total = F.when(s["first"], F.lit(0.0)).otherwise(s["sum"] + v)
        skip = ~s["first"] & (total < threshold)
        return F.struct(F.when(skip, total).otherwise(F.lit(0.0)).alias("sum"), F.concat(s["out"], F.array(skip)).alias("out"), F.lit(False).alias("first"))

    return F.aggregate(values, start, step, lambda s: s["out"])
