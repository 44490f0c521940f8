"""Error rules on clean and faulty input, the research gate, and calendars that follow the data."""

import datetime

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangebreak.functions.frames import InputError, require_none
from rangebreak.operators.audit import audit_poison, audit_truncation, differing_groups, own_cuts, plain_symbol, poison_violations, version_of
from rangebreak.operators.control import pairing_violations
from rangebreak.operators.features import feature_violations
from rangebreak.operators.forecast import forecast_verdict, score_violations
from rangebreak.operators.quality import calendar_violations
from rangebreak.operators.study import study_violations
from rangebreak.operators.summary import expectancy_violations, setup_verdict
from rangebreak.operators.trades import entry_violations, gate_setups, participation_violations
from rangebreak.params import Params
from rangebreak.plans import delivery
from rangebreak.plans.fixtures import Fixture

DAY = datetime.date(2026, 9, 21)


@pytest.mark.parametrize("years", [-28, 56])
def test_calendar_follows_the_data(spark, tmp_path, years):
    """Sessions of 1964 or 2048 keep every breakout. 28 years move no day of a month or week."""
    source = "/root/testdata/sf0.001"
    spark.read.parquet(f"{source}/lineitem.parquet").withColumn(
        "l_shipdate", F.add_months("l_shipdate", 12 * years)
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    moved, kept = Fixture(spark, str(tmp_path), "m", True), Fixture(spark, source, "m", True)
    assert moved.events.count() == kept.events.count() > 0


def both(violations, clean, faulty):
    require_none(violations(*clean), "clean")
    with pytest.raises(InputError, match="faulty"):
        require_none(violations(*faulty), "faulty")


def test_calendar_rule(spark):
    bars = spark.createDataFrame([("A", DAY)], "symbol string, session_date date")
    known = spark.createDataFrame([(DAY, True)], "session_date date, is_trading_day boolean")
    both(calendar_violations, (bars, known), (bars, known.limit(0)))


def test_entry_rule_needs_a_feature_row(spark):
    entries = spark.createDataFrame(
        [("failed_orb", "A", DAY, "short", "long")],
        "setup string, symbol string, session_date date, direction string, feature_direction string",
    )
    features = spark.createDataFrame([("A", DAY, "long")], "symbol string, session_date date, direction string")
    both(entry_violations, (entries, features), (entries, features.withColumn("direction", F.lit("short"))))


def test_pairing_rule(spark):
    side = spark.createDataFrame([("t1", 5, 0.1), ("t1", 10, 0.2)], "trade_id string, slippage_bps int, r_net double")
    both(pairing_violations, (side, side), (side, side.where("slippage_bps = 5")))
    both(pairing_violations, (side, side), (side.where("slippage_bps = 5"), side))


def test_expectancy_rule(spark):
    rows = spark.createDataFrame([("orb", 0.1, 1.0), ("orb", -0.2, 1.0)], "setup string, r_net double, mfe_r double")
    both(expectancy_violations, (rows,), (rows.withColumn("r_net", F.when(F.col("r_net") > 0, F.col("r_net"))),))


def test_study_rule(spark):
    rows = spark.createDataFrame([("BUSTED",), ("NEITHER",)], "label string")
    both(study_violations, (rows,), (rows.withColumn("label", F.lit("LATE")),))


def test_score_rule(spark):
    rows = spark.createDataFrame([("BUSTED",), ("SUSTAINED",)], "outcome string")
    both(score_violations, (rows,), (rows.limit(0),))
    both(score_violations, (rows,), (rows.withColumn("outcome", F.lit("LATE")),))


def test_participation_rule(spark):
    orders = spark.createDataFrame([(5.0, 1000.0)], "base_bps double, order_value double")
    both(participation_violations, (orders,), (orders.withColumn("base_bps", F.lit(-1.0)),))
    both(participation_violations, (orders,), (orders.withColumn("order_value", F.lit(0.0)),))


def test_poison_rule(spark):
    bars = spark.createDataFrame([("A", DAY, 1), ("A", DAY, 9)], "symbol string, session_date date, slot int")
    both(lambda b, s: poison_violations(b, s), (bars, 5), (bars, 10))


def test_feature_rule(spark):
    bars = spark.createDataFrame([("A", DAY, 4, 1)], "symbol string, session_date date, slot int, ts int")
    events = spark.createDataFrame(
        [("A", DAY, "long", 4, 1, 4 * Params().slot_minutes)],
        "symbol string, session_date date, direction string, breakout_slot int, breakout_time int, minutes_since_open int",
    )
    rule = lambda e, b, i: feature_violations(e, b, i, Params())
    both(rule, (events, bars, bars), (events, bars, bars.limit(0)))
    both(rule, (events, bars, bars), (events, bars.withColumn("ts", F.lit(2)), bars))
    both(rule, (events, bars, bars), (events.withColumn("minutes_since_open", F.lit(1)), bars, bars))


def test_no_interval_gives_no_verdict(spark):
    rows = spark.createDataFrame([(100, None), (100, 0.1), (100, -0.1), (2, None)], "n int, ci_low double")
    got = [r[0] for r in rows.select(forecast_verdict(F.col("n"), F.col("ci_low"), Params())).collect()]
    assert got == [None, "informative", "no_better_than_base_rate", "insufficient_sample"]
    table = spark.createDataFrame(
        [("a", "base", True, 0.1, 0.1), ("b", "base", True, None, 0.1), ("c", "base", True, -0.1, 0.1), ("d", "base", False, None, None)],
        "setup string, variant string, has_expectancy boolean, ci_low double, expectancy_ci_low double",
    )
    assert dict(setup_verdict(table).collect()) == {"a": "edge detected", "b": None, "c": "no edge", "d": "insufficient sample"}


@pytest.mark.parametrize("verdict,open_", [("signal", True), ("no_signal", False), ("insufficient_sample", False), (None, False)])
def test_gate_of_the_backtest(spark, verdict, open_):
    rows = spark.createDataFrame([("orb", 1), ("failed_orb", 2)], "setup string, n int")
    study = spark.createDataFrame([(verdict,)], "verdict string")
    assert {r.setup for r in gate_setups(rows, study).collect()} == ({"orb", "failed_orb"} if open_ else {"orb"})
    assert {r.setup for r in gate_setups(rows, study.limit(0)).collect()} == {"orb"}


def crafted_bars(spark):
    rows = [("A", DAY + datetime.timedelta(days=d), k, 100.0 + d + k, 10) for d in range(8) for k in range(6)]
    shape = "symbol string, session_date date, slot int, close double, volume bigint"
    bars = spark.createDataFrame(rows, shape)
    return bars.select("symbol", "session_date", "slot", F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"), "close", "volume")


def test_audits_catch_a_cheat_and_name_its_field(spark):
    bars = crafted_bars(spark)
    session = W.partitionBy("symbol", "session_date").orderBy("slot")
    honest = lambda b: b.select("symbol", "session_date", "slot", F.sum("close").over(session).alias("so_far"))
    cheat = lambda b: b.select(
        "symbol", "session_date", "slot", F.sum("close").over(session).alias("so_far"), F.lead("close").over(session).alias("next_close")
    )
    # A daily row of the same day is a leak as well, although no bar ahead is read directly.
    daily = lambda b: b.select(
        "symbol", "session_date", "slot", F.max("close").over(W.partitionBy("symbol", "session_date")).alias("day_high")
    )
    cuts, keys = own_cuts(bars, (2, 3)), ["symbol", "session_date", "slot"]
    assert [(r.cut_date - DAY).days for r in cuts.orderBy("part").collect()] == [1, 3, 5, 7]
    for transform, field in ((honest, None), (cheat, "next_close"), (daily, "day_high")):
        for report in audit_truncation(transform, bars, cuts, keys, "slot").collect():
            assert (report.leaks > 0) == (field is not None) and report.first_leaking_field == field and report.decisions > 0
        report = audit_poison(transform, bars, 3, keys, "slot").first()
        assert (report.leaks > 0) == (field is not None) and report.first_leaking_field == field


def test_poison_reaches_all_of_the_history_if_a_symbol_ends_early(spark):
    bars = crafted_bars(spark)
    early = bars.where(F.col("session_date") == DAY).withColumn("symbol", F.lit("B"))
    both_symbols, keys = bars.unionByName(early), ["symbol", "session_date", "slot"]
    session = W.partitionBy("symbol", "session_date").orderBy("slot")
    ahead = F.lead("close").over(session)
    late = F.col("session_date") > DAY + datetime.timedelta(days=3)
    pooled = F.avg("close").over(W.partitionBy(version_of(), "session_date", "slot"))
    for value, leaks in ((pooled, False), (F.when(late, ahead), True), (F.when(plain_symbol() == "B", ahead), True)):
        report = audit_poison(lambda b, v=value: b.select(*keys, v.alias("value")), both_symbols, 3, keys, "slot").first()
        assert (report.leaks > 0) == leaks and report.decisions == 7 * 6 + 3 + 6


def test_cuts_follow_each_symbol_and_end_in_its_last_session(spark):
    bars = crafted_bars(spark)
    late = bars.where(F.col("session_date") >= DAY + datetime.timedelta(days=5)).withColumn("symbol", F.lit("C|D"))
    cuts = own_cuts(bars.unionByName(late), (1, 4))
    found = {(r.symbol, r.part): ((r.cut_date - DAY).days, r.cut_slot) for r in cuts.collect()}
    assert found == {
        **{("A", k): (2 * k - 1, (1, 4)[(k - 1) % 2]) for k in range(1, 5)},
        **{("C|D", k): (d, (1, 4)[(k - 1) % 2]) for k, d in ((1, 5), (2, 6), (3, 7), (4, 7))},
    }
    keys, ahead = ["symbol", "session_date", "slot"], F.lead("close").over(W.partitionBy("symbol", "session_date").orderBy("slot"))
    both = bars.unionByName(late)
    cheat = lambda b: b.select(*keys, F.when(F.col("symbol").endswith("C|D"), ahead).alias("value"))
    reports = {r.part: r for r in audit_truncation(cheat, both, cuts, keys, "slot").collect()}
    # Only the bar at the cut itself lacks the bar that the cheat reads: one leak for each part.
    assert {k: r.leaks for k, r in reports.items()} == {1: 1, 2: 1, 3: 1, 4: 1}
    assert reports[4].decisions == (7 * 6 + 5) + (2 * 6 + 5)
    assert audit_truncation(cheat, both.limit(0), own_cuts(both.limit(0), (1, 4)), keys, "slot").collect() == []


def test_one_plan_whatever_the_number_of_cuts(spark):
    bars, keys, seen = crafted_bars(spark), ["symbol", "session_date", "slot"], []

    def transform(b):
        seen.append(b.select("symbol").distinct().count())
        return b.select(*keys, "close")

    for parts in (2, 8):
        reports = audit_truncation(transform, bars, own_cuts(bars, (2,), parts), keys, "slot").collect()
        assert len(reports) == parts and not any(r.leaks for r in reports)
    assert seen == [1 + 2, 1 + 8]  # called once for each audit, with the whole and every version


def test_digests_tell_nulls_apart_and_ignore_order(spark):
    shape = "symbol string, a int, b int"
    left = spark.createDataFrame([("A", 1, None), ("B", 1, 2), ("B", 3, 4), ("C", 1, 1)], shape)
    right = spark.createDataFrame([("A", None, 1), ("B", 3, 4), ("B", 1, 2), ("C", 1, 1), ("C", 1, 1)], shape)
    assert sorted(r.symbol for r in differing_groups(left, right, ["symbol"]).collect()) == ["A", "C"]


def test_audits_of_indicators_detection_and_universe_catch_a_cheat(spark):
    fx = Fixture(spark, "/root/testdata/sf0.001", "m", True)
    bars, session = fx.bars, ["symbol", "session_date"]
    cuts = own_cuts(bars, delivery.CUT_SLOTS)
    cases = (
        (delivery._indicators_of(fx), delivery.BAR_KEY, "slot"),
        (delivery._detection_of(fx), [*session, "direction"], "breakout_slot"),
        (delivery._universe_of(fx), session, "decided_slot"),
    )
    for honest, keys, slot in cases:
        # The cheat knows the last close of the history.
        final = F.max_by("close", F.struct("session_date", "slot")).alias("final")
        peek = lambda b, f=honest, last=final: f(b).join(b.groupBy("symbol").agg(last), "symbol", "left")
        clean = audit_truncation(honest, bars, cuts, keys, slot).collect()
        assert len(clean) == 4 and not any(r.leaks for r in clean) and any(r.decisions for r in clean)
        caught = audit_truncation(peek, bars, cuts, keys, slot).collect()
        assert {r.first_leaking_field for r in caught if r.leaks} == {"final"}
