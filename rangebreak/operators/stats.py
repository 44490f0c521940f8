"""Exact quantiles, session bootstrap and clustering measures that hold at any size.

No group is ever gathered into one task: quantiles are found by counting, and a bootstrap works on
one pre-aggregated row per session, whose number the calendar bounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangebreak.functions.frames import write_stage
from rangebreak.functions.scalars import hash_pick
from rangebreak.params import Params

_STEP = 32
#: Distinct values of a key that one task puts in order at most.
MOST_ROWS = 20_000


# ---- exact quantiles by counting -------------------------------------------------------


def cut_points(values: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """Approximate cut points of ``value`` per key: a mergeable sketch, at most ``blocks`` numbers.

    They only steer where exact counting looks, so their error changes no result.
    """
    shares = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    cuts = F.array_distinct(F.percentile_approx("value", shares, F.lit(10 * blocks)))
    return (
        values.groupBy(*keys)
        .agg(cuts.alias("cuts"))
        .withColumn("coarse", F.filter("cuts", lambda _, i: (i + 1) % _STEP == 0))
    )


def block_number(value: Column) -> Column:
    """How many cut points lie below the value, by a coarse look and then a fine one."""
    passed = F.size(F.filter("coarse", lambda cut: cut < value)) * _STEP
    rest = F.slice(F.col("cuts"), passed + 1, F.lit(_STEP))
    return passed + F.size(F.filter(rest, lambda cut: cut < value))


def exact_quantiles(
    values: DataFrame, keys: list[str], shares: tuple[float, ...], blocks: int = 256, most: int = MOST_ROWS
) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per key: ``keys, n, lowest, highest, q0, q1, ...``.

    Equal values are merged first. A key with at most ``most`` distinct values is put in order by one task. If
    any has more, values are cut into blocks, counts per block locate the block that holds each wanted rank, and
    that block alone is cut again, until the largest open one has ``most`` values or fewer.
    """
    counted = write_stage(values.groupBy(*keys, "value").agg(F.count("*").alias("copies")), "quantile-values")
    largest = counted.groupBy(*keys).agg(F.count("*").alias("kinds")).agg(F.max("kinds")).first()[0]
    if (largest or 0) <= most:
        return _ordered(counted, keys, shares)
    request = [*keys, "q", "side", "n", "lowest", "highest"]
    rows = open_rows(counted, keys, shares, blocks, most)
    running = W.partitionBy(*request).orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = (
        rows.withColumn("reached", F.sum("copies").over(running))
        .where(F.col("reached") > F.col("rank"))
        .groupBy(*request)
        .agg(F.min("value").alias("value"))
    )

    def pick(i: int, side: str) -> Column:
        return F.max(F.when((F.col("q") == i) & (F.col("side") == side), F.col("value")))

    return found.groupBy(*keys, "n", "lowest", "highest").agg(
        *[_interpolate(i, share, pick).alias(f"q{i}") for i, share in enumerate(shares)]
    )


def _ordered(counted: DataFrame, keys: list[str], shares: tuple[float, ...]) -> DataFrame:
    """Quantiles of keys with few distinct values: one running count along the values of a key."""
    of_key = W.partitionBy(*keys)  # at most MOST_ROWS rows
    along = of_key.orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = counted.withColumns({"reached": F.sum("copies").over(along), "n": F.sum("copies").over(of_key)})

    def pick(i: int, side: str) -> Column:
        rank = _rounding(side)((F.col("n") - 1) * F.lit(shares[i]))
        return F.min(F.when(F.col("reached") > rank, F.col("value")))

    return reached.groupBy(*keys, "n").agg(
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
        *[_interpolate(i, share, pick).alias(f"q{i}") for i, share in enumerate(shares)],
    )


def open_rows(counted: DataFrame, keys: list[str], shares: tuple[float, ...], blocks: int, most: int) -> DataFrame:
    """The distinct values among which each wanted rank lies, at most ``most`` of them: ``keys, q, side, n, lowest,
    highest, rank, value, copies`` with the rank counted from the first of them."""
    placed = counted.join(cut_points(counted, keys, blocks), keys).select(
        *keys, "value", "copies", block_number(F.col("value")).alias("block")
    )
    by_key = W.partitionBy(*keys)  # one row per block
    below = by_key.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    per_block = (
        placed.groupBy(*keys, "block")
        .agg(
            F.sum("copies").alias("size"),
            F.min("value").alias("block_min"),
            F.max("value").alias("block_max"),
        )
        .withColumns(
            {
                "below": F.coalesce(F.sum("size").over(below), F.lit(0)),
                "n": F.sum("size").over(by_key),
                "lowest": F.min("block_min").over(by_key),
                "highest": F.max("block_max").over(by_key),
            }
        )
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("q"),
                F.lit(side).alias("side"),
                _rounding(side)((F.col("n") - 1) * F.lit(share)).cast("bigint").alias("rank"),
            )
            for i, share in enumerate(shares)
            for side in ("lo", "hi")
        ]
    )
    request = [*keys, "q", "side", "n", "lowest", "highest"]
    located = (
        per_block.select(*keys, "block", "n", "lowest", "highest", "below", "size", F.inline(wanted))
        .where(_holds_rank())
        .select(*request, "block", (F.col("rank") - F.col("below")).alias("rank"))
    )
    rows = located.join(placed, [*keys, "block"]).select(*request, "rank", "value", "copies")
    while True:
        rows = write_stage(rows, "quantile-open")
        largest = rows.groupBy(*request).agg(F.count("*").alias("kinds")).agg(F.max("kinds")).first()[0]
        if (largest or 0) <= most:
            return rows
        rows = _narrow(rows, request, blocks)


def _rounding(side: str) -> Callable[[Column], Column]:
    return F.floor if side == "lo" else F.ceil


def _holds_rank() -> Column:
    return (F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("size"))


def _narrow(rows: DataFrame, request: list[str], blocks: int) -> DataFrame:
    """Cut the rows of each request into blocks again and keep the one that holds its rank."""
    placed = rows.join(cut_points(rows, request, blocks), request).select(
        *request, "rank", "value", "copies", block_number(F.col("value")).alias("block")
    )
    below = W.partitionBy(*request).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    holding = (
        placed.groupBy(*request, "rank", "block")
        .agg(F.sum("copies").alias("size"))
        .withColumn("below", F.coalesce(F.sum("size").over(below), F.lit(0)))
        .where(_holds_rank())
        .select(*request, "block", "below")
    )
    return placed.join(holding, [*request, "block"]).select(
        *request, (F.col("rank") - F.col("below")).alias("rank"), "value", "copies"
    )


def _interpolate(i: int, share: float, pick: Callable[[int, str], Column]) -> Column:
    position = (F.col("n") - 1) * F.lit(share)
    fraction = position - F.floor(position)
    return pick(i, "lo") + (pick(i, "hi") - pick(i, "lo")) * fraction


# ---- numbering without one big window --------------------------------------------------


def number_within(df: DataFrame, keys: list[str], name: Column, buckets: int = 64) -> DataFrame:
    """Number rows ``0..m-1`` per key, and add ``m``, without sorting a whole key in one task.

    Rows are numbered inside hash buckets of ``name`` and shifted by the sizes of the earlier
    buckets, so a key that holds a large share of all rows is spread over ``buckets`` groups.
    """
    salted = df.withColumn("bucket", hash_pick([name], F.lit(buckets)))
    inside = W.partitionBy(*keys, "bucket").orderBy(name)
    earlier = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = salted.groupBy(*keys, "bucket").agg(F.count("*").alias("size"))
    shifts = sizes.select(
        *keys,
        "bucket",
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("shift"),
        F.sum("size").over(W.partitionBy(*keys)).alias("m"),
    )
    return (
        salted.withColumn("inside", F.row_number().over(inside) - 1)
        .join(shifts, [*keys, "bucket"])
        .withColumn("number", F.col("shift") + F.col("inside"))
        .drop("bucket", "inside", "shift")
    )


# ---- session bootstrap -----------------------------------------------------------------


def bootstrap_draws(
    rows: DataFrame,
    groups: list[str],
    top: Column,
    bottom: Column,
    p: Params,
    statistic: Callable[[Column, Column], Column] | None = None,
    session: str = "session_date",
) -> DataFrame:
    """One row per group and draw: the statistic over whole sessions drawn with replacement.

    A statistic here is a function of two sums, so one row per session with both sums is enough.
    The pick for draw b, position i is a hash of (seed, b, i); a lost task redraws the same sessions.
    """
    statistic = statistic or mean_statistic
    sums = rows.groupBy(*groups, session).agg(F.sum(top).alias("top"), F.sum(bottom).alias("bottom"))
    in_group = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(1))
    numbered = sums.withColumns(
        {
            "pick": (F.row_number().over(in_group.orderBy(session)) - 1).cast("bigint"),
            "sessions": F.count("*").over(in_group),
        }
    )
    draws = (
        numbered.where("pick = 0")
        .select(
            *groups,
            "sessions",
            F.explode(F.sequence(F.lit(0), F.lit(p.bootstrap_draws - 1))).alias("draw"),
        )
        .select(*groups, "sessions", "draw", F.explode(F.sequence(F.lit(1), "sessions")).alias("i"))
        .select(
            *groups,
            "draw",
            hash_pick([F.lit(str(p.seed)), F.col("draw"), F.col("i") - 1], F.col("sessions")).alias("pick"),
        )
    )
    return (
        draws.join(numbered.drop("sessions", session), [*groups, "pick"])
        .groupBy(*groups, "draw")
        .agg(F.sum("top").alias("top"), F.sum("bottom").alias("bottom"))
        .select(*groups, "draw", statistic(F.col("top"), F.col("bottom")).alias("value"))
    )


def mean_statistic(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def skill_statistic(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, 1 - top / bottom)


def session_bootstrap(
    rows: DataFrame,
    groups: list[str],
    top: Column,
    bottom: Column,
    p: Params,
    statistic: Callable[[Column, Column], Column] | None = None,
    session: str = "session_date",
) -> DataFrame:
    """2.5 and 97.5 percentiles of the drawn statistic per group; undefined draws are left out.

    With fewer than half of the draws defined there is no interval: both ends are NULL.
    """
    draws = bootstrap_draws(rows, groups, top, bottom, p, statistic, session)
    ends = draws.groupBy(*groups).agg(
        F.count("value").alias("defined_draws"),
        # At most `bootstrap_draws` values per group.
        F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("ends"),
    )
    enough = F.col("defined_draws") >= p.min_defined_share * p.bootstrap_draws
    return ends.select(
        *groups,
        "defined_draws",
        F.when(enough, F.col("ends")[0]).alias("ci_low"),
        F.when(enough, F.col("ends")[1]).alias("ci_high"),
    )


def bootstrap_violations(intervals: DataFrame) -> DataFrame:
    return intervals.where("ci_low is null")


# ---- clustering ------------------------------------------------------------------------


def session_variance_share(
    rows: DataFrame, groups: list[str], value: Column, session: str = "session_date"
) -> DataFrame:
    """Share of the variance between session means, and the effective number of rows it leaves."""
    per = rows.groupBy(*groups, session).agg(
        F.count(value).alias("m"), F.avg(value).alias("mean"), F.var_pop(value).alias("spread")
    )
    in_group = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(1))
    # One row per session: the overall mean comes from the session means.
    overall = F.sum(F.col("m") * F.col("mean")).over(in_group) / F.sum("m").over(in_group)
    parts = per.withColumn("overall", overall).groupBy(*groups).agg(
        F.sum("m").alias("n_rows"),
        F.count("*").alias("n_sessions"),
        F.sum(F.col("m") * F.pow(F.col("mean") - F.col("overall"), 2)).alias("between"),
        F.sum(F.col("m") * F.col("spread")).alias("within"),
    )
    total = F.col("between") + F.col("within")
    return parts.select(
        *groups,
        "n_rows",
        "n_sessions",
        F.when(
            F.col("n_rows") >= 2, F.when(total > 0, F.col("between") / total).otherwise(F.lit(0.0))
        ).alias("variance_share"),
    )


def effective_sample_size(shares: DataFrame) -> DataFrame:
    """Rows discounted for clustering: n / (1 + (m - 1) rho) with m rows per session."""
    rho = F.greatest(F.least(F.col("variance_share"), F.lit(1.0)), F.lit(0.0))
    m = F.col("n_rows") / F.col("n_sessions")
    return shares.withColumn(
        "effective_rows",
        F.when((F.col("n_rows") <= 0) | (F.col("n_sessions") <= 0), F.lit(0.0))
        .when(F.col("variance_share").isNull(), F.col("n_rows").cast("double"))
        .otherwise(F.col("n_rows") / (1 + (m - 1) * rho)),
    )
