"""Walk-forward forecasts from expanding thirds, and their scores.

A rule for a session is fitted on all earlier ones. Refitting per session would read the history
once for every session; here the expanding order statistics are found by counting instead. The distinct
values of a feature are the leaves of a balanced tree. Counts per (level, node, session) are summed along the
dates, and every (session, quantile) walks down from the root: at each node it passes the children that
lie below its rank, with their counts on earlier dates. With N values, S sessions and K children to a node
that is about S * K * log(N) / log(K) rows per feature in place of S * N. No task holds more than the sessions
of one child, twice: the calendar bounds it, whatever a feature's share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangebreak.functions.frames import unpivot_features, write_stage
from rangebreak.functions.scalars import count_when, expit, logit, ratio
from rangebreak.operators.stats import (
    session_bootstrap,
    session_variance_share,
    skill_statistic,
)
from rangebreak.operators.study import bucket_bounds, bucket_counts
from rangebreak.params import DIRECTIONAL_FEATURES, OUTCOMES, Params

CLASSES = tuple(o.lower() for o in OUTCOMES)
REFERENCE = "neither"
ROW_KEY = ["symbol", "session_date", "direction"]


def shrink_rate(failures: Column, n: Column, base: Column, k: float) -> Column:
    """Pull a rate towards the base rate until it has earned its distance."""
    return F.when(n + k > 0, (failures + k * base) / (n + k)).otherwise(base)


def _train_totals() -> list[Column]:
    return [
        F.count("*").alias("n_train"),
        *[count_when(F.col("label") == o).alias(f"train_{o.lower()}") for o in OUTCOMES],
    ]


def _with_shares(df: DataFrame) -> DataFrame:
    shares = {f"base_{c}": F.col(f"train_{c}") / F.col("n_train") for c in CLASSES}
    return df.withColumns(shares)


def _rates(buckets: DataFrame, p: Params) -> DataFrame:
    """Raw and shrunk rates of buckets that carry their training shares."""
    return buckets.withColumns(
        {
            "raw_rate": F.col("busted") / F.col("n"),
            **{
                f"rate_{c}": shrink_rate(F.col(c), F.col("n"), F.col(f"base_{c}"), p.shrinkage_k)
                for c in CLASSES
            },
        }
    )


# ---- one training window ---------------------------------------------------------------


def fit_rule(train: DataFrame, p: Params) -> DataFrame:
    """Buckets of every usable feature over the rows given, with raw and shrunk rates."""
    values = unpivot_features(train, DIRECTIONAL_FEATURES, ["label"])
    totals = _with_shares(train.agg(*_train_totals()))
    counts = bucket_counts(values, ["feature"])
    in_feature = W.partitionBy("feature")  # at most three buckets
    usable = counts.withColumns(
        {"feature_n": F.sum("n").over(in_feature), "thinnest": F.min("n").over(in_feature)}
    ).where(
        (F.col("feature_n") >= 3 * p.min_bucket_rows) & (F.col("thinnest") >= p.min_bucket_rows)
    )
    return _rates(usable.drop("feature_n", "thinnest").join(F.broadcast(totals)), p)


def assign_bucket(values: DataFrame, rule: DataFrame, keys: list[str]) -> DataFrame:
    """The bucket of each value; values outside the training range fall in the end buckets.

    An equi-join on the keys with at most three buckets each, so it grows with the values alone.
    """
    inside = (F.col("above").isNull() | (F.col("value") > F.col("above"))) & (
        F.col("through").isNull() | (F.col("value") <= F.col("through"))
    )
    return values.join(rule, keys).where(inside)


# ---- every training window at once -----------------------------------------------------


def training_windows(rows: DataFrame, p: Params) -> DataFrame:
    """Sessions that can be forecast, with the class counts of everything strictly earlier."""
    days = rows.groupBy("session_date").agg(*_train_totals())
    # Windows over dates alone: one row per session date.
    before = W.orderBy("session_date").rowsBetween(W.unboundedPreceding, -1)
    summed = {c: F.sum(c).over(before) for c in ("n_train", *[f"train_{c}" for c in CLASSES])}
    windows = days.withColumns(
        {"number": F.row_number().over(W.orderBy("session_date")), **summed}
    )
    return _with_shares(
        windows.where(
            (F.col("number") > p.min_train_sessions) & (F.col("train_busted") >= p.min_train_failures)
        ).drop("number")
    )


def walk_forward_violations(rows: DataFrame, p: Params) -> DataFrame:
    """A single row when no session can be forecast at all."""
    return (
        training_windows(rows, p)
        .agg(F.count("*").alias("sessions"))
        .where("sessions = 0")
        .select(F.lit("the history is too short to forecast on").alias("violation"))
    )


def _summed_before(counts: DataFrame, keys: list[str], dates: DataFrame, extra=()) -> DataFrame:
    """Class counts of each key strictly before every session date, on a grid of keys and dates.

    ``dates`` is one row with the array of session dates. Both sides of the grid are bounded: keys
    are features or a few distinct values, dates are a calendar.
    """
    grid = (
        counts.select(*keys).distinct().join(F.broadcast(dates)).select(
            *keys, F.explode("dates").alias("session_date")
        )
    )
    earlier = W.partitionBy(*keys).orderBy("session_date").rowsBetween(W.unboundedPreceding, -1)
    return grid.join(counts, [*keys, "session_date"], "left").select(
        *keys,
        "session_date",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in CLASSES],
        *[f(c).over(earlier).alias(c) for c, f in extra],
    )


def _class_sum(prefix: str = "") -> Column:
    return F.col(f"{prefix}busted") + F.col(f"{prefix}neither") + F.col(f"{prefix}sustained")


#: Children of a node of the tree of values at most.
SLOTS = 64


def expanding_buckets(rows: DataFrame, p: Params, slots: int = SLOTS) -> DataFrame:
    """Buckets of every feature for every session, from strictly earlier rows only.

    ``session_date`` is the session a rule is for. The depth of the tree follows the number of values.
    """
    values = unpivot_features(rows, DIRECTIONAL_FEATURES, ["session_date", "label"])
    counted = values.groupBy("feature", "value", "session_date").agg(
        *[count_when(F.col("label") == o).alias(o.lower()) for o in OUTCOMES]
    )
    counted = write_stage(counted, "walk-counts")
    dates = rows.agg(F.sort_array(F.collect_set("session_date")).alias("dates"))

    # Distinct values by first appearance: a feature with two or three so far is cut by value.
    appeared = counted.groupBy("feature", "value").agg(F.min("session_date").alias("first_date"))
    order = W.partitionBy("feature").orderBy("first_date", "value")
    first_four = appeared.withColumn("rank", F.row_number().over(order)).where("rank <= 4")
    # One row per feature: the date on which a fourth value first appeared, if it did.
    fourth = first_four.groupBy("feature").agg(
        F.max(F.when(F.col("rank") == 4, F.col("first_date"))).alias("fourth_date")
    )

    few = _few_values(counted, first_four.where("rank <= 3"), fourth, dates)
    many = _expanding_thirds(counted, fourth, dates, slots)
    buckets = few.unionByName(many)
    in_rule = W.partitionBy("session_date", "feature")  # at most three buckets
    return (
        buckets.withColumn("n", _class_sum())
        .withColumns({"feature_n": F.sum("n").over(in_rule), "thinnest": F.min("n").over(in_rule)})
        .where((F.col("feature_n") >= 3 * p.min_bucket_rows) & (F.col("thinnest") >= p.min_bucket_rows))
        .drop("feature_n", "thinnest")
    )


_BUCKET = ("session_date", "feature", "third", "lower", "upper", "above", "through", *CLASSES)


def _few_values(counted, first_three, fourth, dates) -> DataFrame:
    chosen = counted.join(first_three.select("feature", "value"), ["feature", "value"])
    summed = _summed_before(chosen, ["feature", "value"], dates)
    in_rule = W.partitionBy("feature", "session_date")
    ranked = (
        summed.where(_class_sum() > 0)
        .join(fourth, "feature")
        .where(F.col("fourth_date").isNull() | (F.col("session_date") <= F.col("fourth_date")))
        .withColumns(
            {
                "kinds": F.count("*").over(in_rule),
                "rank": F.row_number().over(in_rule.orderBy("value")),
                "previous": F.lag("value").over(in_rule.orderBy("value")),
            }
        )
        .where("kinds >= 2")
    )
    last = F.col("rank") == F.col("kinds")
    return ranked.select(
        "session_date",
        "feature",
        F.when(F.col("rank") == 1, F.lit("low")).when(last, F.lit("high")).otherwise(F.lit("mid")).alias(
            "third"
        ),
        F.col("value").alias("lower"),
        F.col("value").alias("upper"),
        F.col("previous").alias("above"),
        F.when(~last, F.col("value")).alias("through"),
        *CLASSES,
    )


def value_places(counted: DataFrame) -> DataFrame:
    """``feature, value, place``: the place of each distinct value within its feature, from 0.

    Values are sorted in ranges and numbered inside each; the sizes of the earlier ranges, one row a task, give
    the rest. No window runs over the values of a feature.
    """
    ordered = (
        counted.select("feature", "value")
        .distinct()
        .repartitionByRange("feature", "value")
        .sortWithinPartitions("feature", "value")
        # The task in the upper bits, the row within it in the lower 33.
        .withColumn("at", F.monotonically_increasing_id())
    )
    ordered = write_stage(ordered, "walk-values").select(
        "feature", "value", F.shiftright("at", 33).alias("task"), F.col("at").bitwiseAND((1 << 33) - 1).alias("row")
    )
    earlier = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    sizes = ordered.groupBy("task").agg(F.count("*").alias("size"))
    shifts = sizes.select("task", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("shift"))
    numbered = ordered.join(shifts, "task").select("feature", "value", (F.col("row") + F.col("shift")).alias("number"))
    first = numbered.groupBy("feature").agg(F.min("number").alias("first"))
    return numbered.join(first, "feature").select("feature", "value", (F.col("number") - F.col("first")).alias("place"))


def tree_shape(leaves: int, slots: int) -> tuple[int, int]:
    """Levels and children per node of a tree with so many leaves: as few levels as ``slots`` allows, then as few children."""
    levels = 1
    while slots**levels < leaves:
        levels += 1
    children = 2
    while children**levels < leaves:
        children += 1
    return levels, children


def _descend(requests: DataFrame, cells: DataFrame, children: int, width: int) -> DataFrame:
    """Every request one level down: to the child that holds its rank among the values of earlier sessions.

    ``below_*`` counts what lies below the node, ``own_*`` what lies in it. ``width`` is the number of leaves
    under a child. Counts are summed along the dates by child; the dates at which a node is asked for stand
    among its cells, each before the cell of its own date.
    """
    child = F.floor(F.col("place") / width)
    node = F.floor(child / children)
    visited = requests.select("feature", "node").distinct()
    inside = (
        cells.withColumns({"node": node, "slot": child - node * children})
        .join(visited, ["feature", "node"], "left_semi")
        .groupBy("feature", "node", "slot", "session_date")
        .agg(*[F.sum(c).alias(c) for c in CLASSES])
    )
    asked = requests.select("feature", "node", "session_date").distinct().select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(children - 1).cast("long"))).alias("slot")
    )
    both = inside.withColumn("asked", F.lit(1)).unionByName(
        asked.withColumns({**{c: F.lit(0).cast("long") for c in CLASSES}, "asked": F.lit(0)})
    )
    earlier = W.partitionBy("feature", "node", "slot").orderBy("session_date", "asked").rowsBetween(W.unboundedPreceding, -1)
    summed = both.select(
        "feature", "node", "slot", "session_date", "asked",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in CLASSES],
    ).where((F.col("asked") == 0) & (_class_sum() > 0))
    passed = W.partitionBy("feature", "session_date", "q", "side").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("before_busted") + F.col("before_neither") + F.col("before_sustained")
    return (
        requests.join(summed.drop("asked"), ["feature", "node", "session_date"])
        .withColumns({f"before_{c}": F.coalesce(F.sum(c).over(passed), F.lit(0)) for c in CLASSES})
        .where((F.col("rank") >= before) & (F.col("rank") < before + _class_sum()))
        .select(
            "feature", "session_date", "q", "side",
            (F.col("rank") - before).alias("rank"),
            (F.col("node") * children + F.col("slot")).alias("node"),
            *[(F.col(f"below_{c}") + F.col(f"before_{c}")).alias(f"below_{c}") for c in CLASSES],
            *[F.col(c).alias(f"own_{c}") for c in CLASSES],
        )
    )


def _expanding_thirds(counted: DataFrame, fourth: DataFrame, dates: DataFrame, slots: int) -> DataFrame:
    # One row per feature and session.
    own = counted.groupBy("feature", "session_date").agg(
        *[F.sum(c).alias(c) for c in CLASSES], F.min("value").alias("lowest"), F.max("value").alias("highest")
    )
    days = _summed_before(own, ["feature"], dates, (("lowest", F.min), ("highest", F.max))).select(
        "feature", "session_date", _class_sum().alias("n"), "lowest", "highest", *[F.col(c).alias(f"all_{c}") for c in CLASSES]
    )
    per_rule = ["n", "lowest", "highest", *[f"all_{c}" for c in CLASSES]]
    position = {0: (F.col("n") - 1) * F.lit(1 / 3), 1: (F.col("n") - 1) * F.lit(2 / 3)}
    wanted = F.array(
        *[
            F.struct(
                F.lit(q).alias("q"),
                F.lit(side).alias("side"),
                rounding(position[q]).cast("bigint").alias("rank"),
            )
            for q in (0, 1)
            for side, rounding in (("lo", F.floor), ("hi", F.ceil))
        ]
    )
    zero = F.lit(0).cast("long")
    requests = (
        days.join(fourth, "feature")
        .where(F.col("session_date") > F.col("fourth_date"))
        .select("feature", "session_date", F.inline(wanted))
        .withColumns({"node": zero, **{f"below_{c}": zero for c in CLASSES}})
    )
    places = write_stage(value_places(counted), "walk-places")
    leaves = places.agg(F.max("place")).first()[0]
    levels, children = tree_shape(1 if leaves is None else leaves + 1, slots)
    cells = write_stage(
        counted.join(places, ["feature", "value"]).select("feature", "place", "session_date", *CLASSES), "walk-cells"
    )
    for level in range(levels):
        requests = write_stage(_descend(requests, cells, children, children ** (levels - 1 - level)), "walk-requests")
    stats = (
        requests.join(places.withColumnRenamed("place", "node"), ["feature", "node"])
        .join(days, ["feature", "session_date"])
        .select(
            "feature", "session_date", "q", "side", "value", *per_rule,
            *[(F.col(f"below_{c}") + F.col(f"own_{c}")).alias(f"upto_{c}") for c in CLASSES],
        )
    )

    def pick(q: int, side: str, column: str) -> Column:
        return F.max(F.when((F.col("q") == q) & (F.col("side") == side), F.col(column)))

    def edge(q: int) -> Column:
        fraction = position[q] - F.floor(position[q])
        low = pick(q, "lo", "value")
        return low + (pick(q, "hi", "value") - low) * fraction

    wide = (
        stats.groupBy("feature", "session_date", *per_rule)
        .agg(
            edge(0).alias("edge0"),
            edge(1).alias("edge1"),
            *[pick(q, "lo", f"upto_{c}").alias(f"upto{q}_{c}") for q in (0, 1) for c in CLASSES],
        )
        .where("edge0 <> edge1")
        .withColumn("by_value", F.lit(False))
    )
    parts = {
        "low": {c: F.col(f"upto0_{c}") for c in CLASSES},
        "mid": {c: F.col(f"upto1_{c}") - F.col(f"upto0_{c}") for c in CLASSES},
        "high": {c: F.col(f"all_{c}") - F.col(f"upto1_{c}") for c in CLASSES},
    }
    rows = F.array(
        *[
            F.struct(F.lit(third).alias("third"), *[column.alias(c) for c, column in counts.items()])
            for third, counts in parts.items()
        ]
    )
    return (
        wide.select(
            "session_date", "feature", "by_value", "lowest", "highest", "edge0", "edge1", F.inline(rows)
        )
        .withColumns(bucket_bounds())
        .select(*_BUCKET)
    )


def rule_buckets(rows: DataFrame, p: Params, slots: int = SLOTS) -> DataFrame:
    """The rule of every session that can be forecast."""
    return _rates(expanding_buckets(rows, p, slots).join(training_windows(rows, p), "session_date"), p)


# ---- prediction ------------------------------------------------------------------------


def _class_ratio(rate: Column, reference: Column, p: Params) -> Column:
    floor = F.lit(p.prob_floor)
    return F.log(F.greatest(rate, floor) / F.greatest(reference, floor))


def contributions(rows: DataFrame, rule: DataFrame, p: Params) -> DataFrame:
    """One row per breakout and feature: the bucket it lands in and what that adds."""
    values = unpivot_features(rows, DIRECTIONAL_FEATURES, ROW_KEY)
    hit = assign_bucket(values, rule, ["session_date", "feature"])

    def ratio_of(c: str) -> Column:
        return _class_ratio(F.col(f"rate_{c}"), F.col(f"rate_{REFERENCE}"), p) - _class_ratio(
            F.col(f"base_{c}"), F.col(f"base_{REFERENCE}"), p
        )

    return hit.select(
        *ROW_KEY,
        "feature",
        "third",
        *[f"rate_{c}" for c in CLASSES],
        (
            logit(F.col("rate_busted"), p.prob_floor, p.prob_ceiling)
            - logit(F.col("base_busted"), p.prob_floor, p.prob_ceiling)
        ).alias("log_odds"),
        *[ratio_of(c).alias(f"ratio_{c}") for c in CLASSES],
    )


def _softmax(scores: dict[str, Column]) -> dict[str, Column]:
    top = F.greatest(*scores.values())
    weights = {c: F.exp(s - top) for c, s in scores.items()}
    total = weights["busted"] + weights["neither"] + weights["sustained"]
    return {c: w / total for c, w in weights.items()}


def predict(rows: DataFrame, windows: DataFrame, rule: DataFrame, p: Params) -> DataFrame:
    """Both combinations of both models for every breakout of the forecast sessions."""
    parts = contributions(rows, rule, p)
    summed = parts.groupBy(*ROW_KEY).agg(
        F.count("*").alias("features_used"),
        F.sum("log_odds").alias("log_odds"),
        *[F.avg(f"rate_{c}").alias(f"mean_{c}") for c in CLASSES],
        *[F.sum(f"ratio_{c}").alias(f"ratio_{c}") for c in CLASSES],
    )
    joined = rows.join(windows, "session_date").join(summed, ROW_KEY, "left")
    none = F.col("features_used").isNull()
    base = F.col("base_busted")
    clipped = logit(base, p.prob_floor, p.prob_ceiling)
    scores = {
        c: _class_ratio(F.col(f"base_{c}"), F.col(f"base_{REFERENCE}"), p)
        + p.damping * F.col(f"ratio_{c}")
        for c in CLASSES
    }
    soft = _softmax(scores)
    shares = F.col("base_busted") + F.col("base_neither") + F.col("base_sustained")
    means = F.col("mean_busted") + F.col("mean_neither") + F.col("mean_sustained")
    return joined.select(
        *ROW_KEY,
        "breakout_time",
        expit(clipped + p.damping * F.coalesce("log_odds", F.lit(0.0))).alias("p_fail"),
        F.coalesce("mean_busted", base).alias("p_fail_average"),
        base.alias("base_rate"),
        "n_train",
        F.col("train_busted").alias("train_failures"),
        F.coalesce("features_used", F.lit(0)).cast("bigint").alias("features_used"),
        *[
            F.when(none, F.col(f"base_{c}") / shares).otherwise(soft[c]).alias(f"p_{c}")
            for c in CLASSES
        ],
        *[
            F.when(none, F.col(f"base_{c}") / shares)
            .otherwise(F.col(f"mean_{c}") / means)
            .alias(f"p_{c}_average")
            for c in CLASSES
        ],
        *[f"base_{c}" for c in CLASSES],
        # The outcome is attached after the forecast; nothing above reads it.
        F.col("label").alias("outcome"),
    )


PREDICTION_COLUMNS = (
    *ROW_KEY,
    "breakout_time",
    "p_fail",
    "base_rate",
    "n_train",
    "train_failures",
    "features_used",
    *[f"p_{c}" for c in CLASSES],
    *[f"base_{c}" for c in CLASSES],
    "outcome",
)


def compare_combinations(rows: DataFrame, p: Params, slots: int = SLOTS) -> DataFrame:
    """Walk-forward predictions with both combinations side by side, fitted once."""
    return predict(rows, training_windows(rows, p), rule_buckets(rows, p, slots), p)


def as_combination(predictions: DataFrame, combination: str) -> DataFrame:
    """One combination under the common column names."""
    if combination not in ("logodds", "average"):
        raise ValueError(f"unknown combination {combination!r}")
    if combination == "average":
        averaged = {c: F.col(f"{c}_average") for c in ("p_fail", *[f"p_{c}" for c in CLASSES])}
        predictions = predictions.withColumns(averaged)
    return predictions.select(*PREDICTION_COLUMNS)


def walk_forward(rows: DataFrame, p: Params, combination: str = "logodds", slots: int = SLOTS) -> DataFrame:
    return as_combination(compare_combinations(rows, p, slots), combination)


def prediction_explain(rows: DataFrame, p: Params, slots: int = SLOTS) -> DataFrame:
    """Every number behind a forecast, as maps from feature to contribution."""
    parts = contributions(rows, rule_buckets(rows, p, slots), p)

    def as_map(value: Column) -> Column:
        # At most one entry per directional feature.
        return F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", value.alias("v")))))

    return parts.groupBy(*ROW_KEY).agg(
        as_map(F.col("third")).alias("buckets"),
        as_map(F.col("rate_busted")).alias("contributions"),
        as_map(F.col("log_odds")).alias("log_odds"),
        as_map(F.struct(*[F.col(f"rate_{c}").alias(c) for c in CLASSES])).alias("class_rates"),
    )


# ---- scores ----------------------------------------------------------------------------


def forecast_verdict(n: Column, low: Column, p: Params) -> Column:
    return (
        F.when(n < p.min_sample, F.lit("insufficient_sample"))
        .when(low.isNull(), F.lit(None))  # no interval, no finding
        .when(low > 0, F.lit("informative"))
        .otherwise(F.lit("no_better_than_base_rate"))
    )


def _skill(score: str, base: str) -> Column:
    """One minus the ratio of scores; zero against a perfect base, NULL with nothing to score."""
    gained = F.when(F.col(base) > 0, 1 - F.col(score) / F.col(base)).otherwise(F.lit(0.0))
    return F.when(F.col("n") > 0, gained)


def score_violations(predictions: DataFrame) -> DataFrame:
    """A row when there is nothing to score, and outcomes that are not a known class."""
    empty = predictions.agg(F.count("*").alias("n")).where("n = 0").select(
        F.lit("no predictions to score").alias("violation")
    )
    unknown = predictions.where(~F.col("outcome").isin(*OUTCOMES)).select(
        F.concat(F.lit("unknown outcome "), "outcome").alias("violation")
    )
    return empty.unionByName(unknown)


def brier_score(predictions: DataFrame, p: Params, groups: list[str] | None = None) -> DataFrame:
    """Brier score against the base rate, with a session bootstrap of the skill."""
    groups = groups or []
    actual = (F.col("outcome") == "BUSTED").cast("double")
    error = F.pow(F.col("p_fail") - actual, 2)
    base_error = F.pow(F.col("base_rate") - actual, 2)
    scored = predictions.withColumns({"error": error, "base_error": base_error, "actual": actual})
    totals = scored.groupBy(*groups).agg(
        F.count("*").alias("n"),
        F.sum("actual").cast("bigint").alias("failures"),
        F.avg("error").alias("brier"),
        F.avg("base_error").alias("brier_base"),
    )
    interval = session_bootstrap(
        scored, groups, F.col("error"), F.col("base_error"), p, skill_statistic
    )
    clustering = session_variance_share(scored, groups, F.col("actual"))
    return _attach(_attach(totals, interval, groups), clustering, groups).select(
        *groups,
        "n",
        "n_sessions",
        "failures",
        "variance_share",
        "brier",
        "brier_base",
        _skill("brier", "brier_base").alias("skill"),
        "ci_low",
        "ci_high",
        forecast_verdict(F.col("failures"), F.col("ci_low"), p).alias("verdict"),
    )


def _attach(left: DataFrame, right: DataFrame, groups: list[str]) -> DataFrame:
    """Join two aggregates of the same groups; without groups both are one row."""
    return left.join(right, groups) if groups else left.join(F.broadcast(right))


def calibration(predictions: DataFrame, p: Params) -> DataFrame:
    """Mean forecast against observed rate per probability bin, for the three forecasts."""
    cases = F.array(
        *[
            F.struct(
                F.lit(name).alias("forecast"),
                F.col(column).alias("p"),
                (F.col("outcome") == outcome).cast("double").alias("actual"),
            )
            for name, column, outcome in (
                ("p_fail", "p_fail", "BUSTED"),
                ("p_busted", "p_busted", "BUSTED"),
                ("p_sustained", "p_sustained", "SUSTAINED"),
            )
        ]
    )
    edges = p.calibration_edges
    bin_low = F.lit(None).cast("double")
    bin_high = F.lit(None).cast("double")
    for low, high in zip(edges, edges[1:]):
        inside = (F.col("p") >= low) & (F.col("p") < high)
        bin_low = F.when(inside, F.lit(low)).otherwise(bin_low)
        bin_high = F.when(inside, F.lit(min(high, 1.0))).otherwise(bin_high)
    return (
        predictions.select(F.inline(cases))
        .withColumns({"bin_low": bin_low, "bin_high": bin_high})
        .where("bin_low is not null")
        .groupBy("forecast", "bin_low", "bin_high")
        .agg(
            F.count("*").alias("n"),
            F.avg("p").alias("mean_forecast"),
            F.avg("actual").alias("observed_rate"),
        )
    )


def rps(first: Column, second: Column, outcome: Column) -> Column:
    """Ranked probability score over the ordered classes: squared errors of cumulative forecasts."""
    one = F.when(outcome == OUTCOMES[0], F.lit(1.0)).otherwise(F.lit(0.0))
    two = F.when(outcome == OUTCOMES[2], F.lit(0.0)).otherwise(F.lit(1.0))
    return F.pow(first - one, 2) + F.pow(first + second - two, 2)


def ranked_probability_score(predictions: DataFrame) -> DataFrame:
    outcome = F.col("outcome")
    return predictions.withColumns(
        {
            "rps": rps(F.col("p_busted"), F.col("p_neither"), outcome),
            "rps_base": rps(F.col("base_busted"), F.col("base_neither"), outcome),
        }
    )


def three_way_score(predictions: DataFrame, p: Params) -> DataFrame:
    """RPS against the base shares, with skill, accuracy and a verdict on the rarest class."""
    scored = ranked_probability_score(predictions)
    forecasts = F.array(*[F.col(f"p_{c}") for c in CLASSES])
    named = F.element_at(
        F.array(*[F.lit(o) for o in OUTCOMES]),
        F.array_position(forecasts, F.array_max(forecasts)).cast("int"),
    )
    totals = scored.agg(
        F.count("*").alias("n"),
        *[count_when(F.col("outcome") == o).alias(o.lower()) for o in OUTCOMES],
        F.count_distinct("session_date").alias("n_sessions"),
        F.avg("rps").alias("rps"),
        F.avg("rps_base").alias("rps_base"),
        F.avg((named == F.col("outcome")).cast("double")).alias("accuracy"),
    )
    interval = session_bootstrap(scored, [], F.col("rps"), F.col("rps_base"), p, skill_statistic)
    least = F.least(*CLASSES)
    rarest = F.lit(None).cast("string")
    for c, o in reversed(list(zip(CLASSES, OUTCOMES))):
        rarest = F.when(F.col(c) == least, F.lit(o)).otherwise(rarest)
    return totals.join(F.broadcast(interval)).select(
        "n",
        "n_sessions",
        *CLASSES,
        rarest.alias("rarest_class"),
        least.alias("rarest_count"),
        "rps",
        "rps_base",
        _skill("rps", "rps_base").alias("skill"),
        "ci_low",
        "ci_high",
        "accuracy",
        ratio(F.greatest(*CLASSES), F.col("n")).alias("accuracy_baseline"),
        forecast_verdict(least, F.col("ci_low"), p).alias("verdict"),
    )
