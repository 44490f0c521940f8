import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangebreak.operators import forecast as fc
from rangebreak.operators import stats, study
from rangebreak.operators import summary as sm
from rangebreak.params import DIRECTIONAL_FEATURES, TESTED_FEATURES, Params

P = Params()
FIRST = datetime.date(2025, 1, 1)


@pytest.mark.parametrize("blocks,most", [(64, 20_000), (64, 100), (8, 10), (4, 1)])
def test_exact_quantiles_match_numpy_with_ties_and_skew(spark, blocks, most):
    rng = random.Random(1)
    groups = {
        "uniform": [rng.random() for _ in range(997)],
        "ties": [float(rng.randint(0, 3)) for _ in range(500)],
        "hot": [7.0] * 800 + [rng.gauss(0, 1) for _ in range(200)],
        "one": [3.0],
        "tails": [rng.lognormvariate(0, 3) for _ in range(301)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    table = spark.createDataFrame(rows, "k string, value double")
    shares = (0.0, 1 / 3, 0.5, 2 / 3, 0.975, 1.0)
    for r in stats.exact_quantiles(table, ["k"], shares, blocks, most).collect():
        want = np.quantile(groups[r.k], shares)
        assert [r[f"q{i}"] for i in range(6)] == pytest.approx(list(want), rel=1e-12)
        assert (r.n, r.lowest, r.highest) == (len(groups[r.k]), min(groups[r.k]), max(groups[r.k]))


def test_no_task_orders_more_than_the_bound(spark):
    """A million distinct values of one key, beside a small key."""
    n, most, shares = 1_000_000, 3000, (0.0, 1 / 3, 0.5, 0.9)
    values = spark.range(n).select(
        F.lit("large").alias("k"), F.exp(F.pmod(F.col("id") * 7919, F.lit(n)) / n * 20).alias("value")
    ).unionByName(spark.range(50).select(F.lit("small").alias("k"), F.col("id").cast("double").alias("value")))
    counted = values.groupBy("k", "value").agg(F.count("*").alias("copies"))
    rows = stats.open_rows(counted, ["k"], shares, 64, most)
    sizes = rows.groupBy("k", "q", "side").count().collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) <= most
    got = {r.k: r for r in stats.exact_quantiles(values, ["k"], shares, 64, most).collect()}
    want = np.quantile(np.exp(np.arange(n) / n * 20), shares)
    assert [got["large"][f"q{i}"] for i in range(4)] == pytest.approx(list(want), rel=1e-9)
    assert got["large"].n == n and got["small"].q2 == 24.5


def test_numbering_is_complete_per_key(spark):
    rows = [(d, f"s{i}") for d, n in (("a", 500), ("b", 3)) for i in range(n)]
    numbered = stats.number_within(spark.createDataFrame(rows, "d string, s string"), ["d"], F.col("s"), buckets=8)
    for d, n in (("a", 500), ("b", 3)):
        got = numbered.where(F.col("d") == d).collect()
        assert sorted(r.number for r in got) == list(range(n)) and {r.m for r in got} == {n}


def clustered(seed, sessions=41, per=20, shock=0.6):
    rng = np.random.default_rng(seed)
    return [
        (seed, int(s), float(x))
        for s in range(sessions)
        for x in rng.normal(0, 1, per) + rng.normal(0, shock)
    ]


def test_bootstrap_covers_zero_on_clustered_noise(spark):
    rows = [r for seed in range(20) for r in clustered(seed)]
    table = spark.createDataFrame(rows, "seed int, session_date int, x double")
    got = stats.session_bootstrap(table, ["seed"], F.col("x"), F.lit(1), P.with_(bootstrap_draws=300)).collect()
    misses = sum(not r.ci_low <= 0 <= r.ci_high for r in got)
    assert misses <= 4
    width = np.mean([r.ci_high - r.ci_low for r in got])
    assert width > 1.3 * 2 * 1.96 * np.sqrt(1 / 820)


def test_undefined_draws_leave_no_interval(spark):
    rows = spark.createDataFrame([(1, 1.0, 0.0)], "session_date int, t double, b double")
    got = stats.session_bootstrap(rows, [], F.col("t"), F.col("b"), P.with_(bootstrap_draws=10))
    assert got.first().ci_low is None and stats.bootstrap_violations(got).count() == 1


def test_variance_share_and_effective_rows(spark):
    rows = clustered(3, shock=1.0)
    table = spark.createDataFrame(rows, "seed int, session_date int, x double")
    got = stats.effective_sample_size(stats.session_variance_share(table, [], F.col("x"))).first()
    x = np.array([r[2] for r in rows])
    s = np.array([r[1] for r in rows])
    between = sum((s == g).sum() * (x[s == g].mean() - x.mean()) ** 2 for g in set(s))
    share = between / ((x - x.mean()) ** 2).sum()
    assert got.variance_share == pytest.approx(share)
    assert got.effective_rows == pytest.approx(820 / (1 + 19 * share))


def feature_rows(spark, sessions, per, fail, seed=0, planted=None):
    rng = random.Random(seed)
    rows = []
    for d in range(sessions):
        for i in range(per):
            values = {f: rng.gauss(0, 1) for f in TESTED_FEATURES}
            values["index_or_agrees"] = float(rng.random() < 0.5)
            values["rvol_open_15m"] = values["rvol_open_15m"] if d > sessions // 4 else None
            values["bar_body_ratio"] = min(1.0, abs(values["bar_body_ratio"]))
            chance = fail
            if planted and values[planted] is not None:
                chance = fail + (0.35 if values[planted] < -0.43 else -0.1)
            u = rng.random()
            label = "BUSTED" if u < chance else "SUSTAINED" if u > 0.7 else "NEITHER"
            rows.append(
                (f"S{i}", FIRST + datetime.timedelta(days=d), "long", None, label, *[values[f] for f in TESTED_FEATURES])
            )
    schema = "symbol string, session_date date, direction string, breakout_time timestamp_ntz, label string, " + ", ".join(
        f"{f} double" for f in TESTED_FEATURES
    )
    return spark.createDataFrame(rows, schema)


def test_planted_gap_is_a_signal_and_noise_is_not(spark):
    found = study.study_verdict(feature_rows(spark, 150, 8, 0.25, planted="gap_atr_signed"), P).first()
    assert (found.verdict, found.n_holding) == ("signal", 1)
    assert study.study_verdict(feature_rows(spark, 150, 8, 0.25), P).first().verdict == "no_signal"
    assert study.study_verdict(feature_rows(spark, 20, 4, 0.1), P).first().verdict == "insufficient_sample"


def test_study_refuses_missing_columns_and_unknown_labels(spark):
    rows = feature_rows(spark, 5, 2, 0.5)
    with pytest.raises(ValueError):
        study.study_verdict(rows.drop("is_expiry_day"), P)
    assert study.study_violations(rows.withColumn("label", F.lit("MAYBE"))).count() == 1


def test_places_number_the_values_of_each_feature(spark):
    rng = random.Random(6)
    rows = [(f, float(rng.randrange(-300, 300))) for f in "abc" for _ in range(900)]
    got = fc.value_places(spark.createDataFrame(rows, "feature string, value double")).collect()
    for f in "abc":
        want = {v: k for k, v in enumerate(sorted({v for g, v in rows if g == f}))}
        assert {r.value: r.place for r in got if r.feature == f} == want
    for leaves in (1, 2, 5, 64, 65, 4097):
        for slots in (2, 4, 64):
            levels, children = fc.tree_shape(leaves, slots)
            assert children**levels >= leaves and slots ** (levels - 1) < max(leaves, 2) and children <= slots


@pytest.mark.parametrize("slots", [4, 64])
def test_expanding_rules_equal_a_refit_per_session(spark, slots):
    rows = feature_rows(spark, 60, 6, 0.3, seed=4).cache()
    mine = {
        (r.session_date, r.feature, r.third): r for r in fc.rule_buckets(rows, P, slots=slots).collect()
    }
    targets = [r.session_date for r in fc.training_windows(rows, P).orderBy("session_date").collect()]
    assert targets and {k[0] for k in mine} <= set(targets)
    fields = ("n", "busted", "neither", "sustained", "lower", "upper", "rate_busted", "rate_sustained")
    for target in (targets[0], targets[len(targets) // 2], targets[-1]):
        want = fc.fit_rule(rows.where(F.col("session_date") < target), P).collect()
        assert {(r.feature, r.third) for r in want} == {k[1:] for k in mine if k[0] == target}
        for r in want:
            got = mine[target, r.feature, r.third]
            assert [got[f] for f in fields] == pytest.approx([r[f] for f in fields])


def test_forecast_skill_on_planted_and_on_noise(spark):
    good = fc.walk_forward(feature_rows(spark, 70, 20, 0.25, planted="gap_atr_signed"), P)
    assert fc.brier_score(good, P).first().verdict == "informative"
    assert good.where("p_fail < 0 or p_fail > 1").count() == 0
    total = F.abs(F.col("p_busted") + F.col("p_neither") + F.col("p_sustained") - 1)
    assert good.where(total > 1e-9).count() == 0


def test_short_history_is_reported(spark):
    assert fc.walk_forward_violations(feature_rows(spark, 10, 2, 0.3), P).count() == 1


def test_rps_by_hand(spark):
    rows = spark.createDataFrame(
        [(1.0, 0.0, 0.0, "BUSTED"), (0.0, 0.0, 1.0, "BUSTED"), (0.2, 0.3, 0.5, "NEITHER")],
        "p_busted double, p_neither double, p_sustained double, outcome string",
    ).withColumns({f"base_{c}": F.lit(1 / 3) for c in fc.CLASSES})
    got = [r.rps for r in fc.ranked_probability_score(rows).collect()]
    assert got == pytest.approx([0.0, 2.0, 0.2**2 + 0.5**2])


def test_expectancy_and_its_floor(spark):
    rows = [("a", 2.0 if i % 2 else -1.0, 1.0, FIRST + datetime.timedelta(days=i)) for i in range(40)]
    rows += [("b", 1.0, 0.2, FIRST)] * 29
    table = spark.createDataFrame(rows, "g string, r_net double, mfe_r double, session_date date")
    got = {r.g: r for r in sm.expectancy(table, ["g"], P).collect()}
    assert got["a"].expectancy_r == pytest.approx(0.5) and got["a"].computed
    assert got["b"].n == 29 and not got["b"].computed and got["b"].expectancy_r is None


def test_forecast_features_are_the_directional_ones():
    assert len(DIRECTIONAL_FEATURES) == 6
