import re

import pytest
from pyspark.sql import functions as F

from rangebreak.operators import labelling as lab
from rangebreak.operators.features import breakout_context
from rangebreak.params import Params
from rangebreak.plans.fixtures import Fixture
from tests.helpers import bars, flat_session

P = Params()
ATR = 4.0


def labelled(spark, changes, slots=75):
    rows = bars(spark, flat_session(changes, slots))
    events = lab.detect_breakouts(rows, P).withColumn("atr", F.lit(ATR))
    return {
        r.direction: (r.breakout_slot, r.label, r.resolved_slot, r.max_extension_atr)
        for r in lab.resolve_breakouts(events, rows, P).collect()
    }


def test_quiet_session_has_no_breakout(spark):
    assert labelled(spark, {}) == {}


def test_touch_is_not_a_breakout(spark):
    assert labelled(spark, {10: (100.0, 102.0, 99.5, 101.0)}) == {}


def test_sustained_on_the_bar_that_extends_half_an_atr(spark):
    got = labelled(spark, {10: (100.0, 101.4, 100.0, 101.2), 12: (101.0, 103.0, 101.0, 102.0)})
    assert got["long"] == (10, "SUSTAINED", 12, pytest.approx(0.5))


def test_busted_by_a_close_through_the_far_side(spark):
    got = labelled(spark, {10: (100.0, 101.4, 100.0, 101.2), 20: (100.0, 100.0, 98.0, 98.5)})
    assert got["long"][:3] == (10, "BUSTED", 20)
    assert got["short"][0] == 20


def test_no_bust_at_or_after_the_cutoff(spark):
    before = labelled(spark, {10: (100.0, 101.4, 100.0, 101.2), 71: (100.0, 100.0, 98.0, 98.5)})
    after = labelled(spark, {10: (100.0, 101.4, 100.0, 101.2), 72: (100.0, 100.0, 98.0, 98.5)})
    assert before["long"][1] == "BUSTED" and after["long"][1] == "NEITHER"


def test_a_quarter_atr_extension_rules_out_a_bust(spark):
    got = labelled(spark, {10: (100.0, 102.0, 100.0, 101.2), 20: (100.0, 100.0, 98.0, 98.5)})
    assert got["long"][1] == "NEITHER"


def test_extension_is_checked_before_the_close_of_the_same_bar(spark):
    got = labelled(spark, {10: (100.0, 101.4, 100.0, 101.2), 20: (100.0, 103.5, 98.0, 98.5)})
    assert got["long"][1:3] == ("SUSTAINED", 20)


def test_first_close_wins_and_later_ones_are_ignored(spark):
    got = labelled(
        spark,
        {10: (100.0, 101.4, 100.0, 101.2), 11: (100.0, 100.5, 99.5, 100.0), 12: (100.0, 101.4, 100.0, 101.3)},
    )
    assert set(got) == {"long"} and got["long"][0] == 10


def test_incomplete_opening_range_gives_no_breakout(spark):
    rows = [r for r in flat_session({10: (100.0, 105.0, 100.0, 104.0)}) if r[2] != 1]
    assert lab.detect_breakouts(bars(spark, rows), P).count() == 0


def test_one_pass_labelling_equals_detect_then_resolve(spark):
    fx = Fixture(spark, "/root/testdata/sf0.001", "m")
    whole = lab.label_sessions(fx.bars, fx.daily, fx.calendar, fx.params)
    detected = lab.atr_prior_day(
        lab.detect_breakouts(fx.bars, fx.params), fx.daily, fx.calendar, fx.params
    ).where("atr is not null")
    steps = lab.resolve_breakouts(detected, fx.bars, fx.params)
    key = ["symbol", "session_date", "direction", "label", "resolved_slot"]
    assert sorted(map(str, whole.select(*key).collect())) == sorted(map(str, steps.select(*key).collect()))
    assert lab.label_violations(whole).count() == 0


def test_sessions_without_a_breakout_end_before_the_windows(spark, monkeypatch):
    fx, seen, mark = Fixture(spark, "/root/testdata/sf0.001", "m"), [], lab.mark_first_breaks
    monkeypatch.setattr(lab, "mark_first_breaks", lambda rows, p: seen.append(rows) or mark(rows, p))
    events = breakout_context(fx.bars, fx.daily, fx.calendar, fx.params)
    sessions = [set(df.select("symbol", "session_date").distinct().collect()) for df in (seen[0], events, fx.bars)]
    assert sessions[0] == sessions[1] < sessions[2]
    # The sessions are made once: what is left to run reads the trades a single time, for the paths.
    assert events._jdf.queryExecution().analyzed().toString().count("Relation [l_orderkey") == 1


def test_trades_by_supplier_move_once_by_session(spark):
    plan = Fixture(spark, "/root/testdata/sf0.001", "s").bars._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert moved and not any("slot" in keys for keys in moved)


def test_base_rates_round_half_to_even(spark):
    labels = ["BUSTED"] * 1 + ["NEITHER"] * 15
    rows = spark.createDataFrame([("2026-09-21", l) for l in labels], "d string, label string")
    got = lab.base_rates(rows.select(F.to_date("d").alias("session_date"), "label")).where("month = 'all'").first()
    assert (got.busted, got.n, got.busted_pct) == (1, 16, 6.2)
