import pytest
from pyspark.sql import functions as F

from rangebreak.operators import trades as tr
from rangebreak.params import Params
from tests.helpers import DAY, bars, flat_session

P = Params()


def signal(spark, slot=9, direction="long", atr=2.0):
    return spark.createDataFrame(
        [("orb", "AAA", DAY, direction, direction, slot, atr)],
        "setup string, symbol string, session_date date, direction string, feature_direction string, "
        "signal_slot int, atr double",
    )


def exits(spark, changes, **kw):
    rows = tr.build_trades(signal(spark, **kw), bars(spark, flat_session(changes)), P).collect()
    return {r.variant: r for r in rows}


@pytest.mark.parametrize("bps,total", [(5, 103.0226), (10, 153.0226), (20, 253.0226)])
def test_round_trip_costs_of_a_flat_position(spark, bps, total):
    legs = spark.createDataFrame([(50_000.0, 50_000.0, bps)], "buy_turnover double, sell_turnover double, slippage_bps int")
    assert tr.trade_costs(legs).select("costs.total").first()[0] == pytest.approx(total)
    assert tr.cost_violations(legs).count() == 0


def test_brokerage_cap_and_cost_errors(spark):
    legs = spark.createDataFrame([(1e7, 1e7, 5), (0.0, 1.0, 5)], "buy_turnover double, sell_turnover double, slippage_bps int")
    assert tr.trade_costs(legs).first().costs.brokerage_buy == 20.0
    assert tr.cost_violations(legs).count() == 1


@pytest.mark.parametrize("order,bar,bps", [(100.0, 10_000.0, 6.0), (2500.0, 10_000.0, 10.0), (1e9, 1.0, 15.0), (1.0, None, 5.0), (1.0, 0.0, 5.0)])
def test_participation_slippage(spark, order, bar, bps):
    row = spark.createDataFrame([(order, bar, 5.0)], "order_value double, bar_value double, base_bps double")
    assert tr.participation_slippage(row).first().slippage_bps == pytest.approx(bps)


def test_evaluation_of_a_plain_long(spark):
    trade = spark.createDataFrame(
        [("orb", "base", "AAA", DAY, "long", 1000.0, 1010.0, 990.0, 1012.0, 3)],
        "setup string, variant string, symbol string, session_date date, direction string, entry_price double, "
        "exit_price double, stop_price double, mfe_price double, duration_bars int",
    )
    got = tr.evaluate_trades(trade, P).where("slippage_bps = 5").first()
    assert (got.quantity, got.risk, got.r_gross) == (50, 500.0, 1.0)
    assert got.mfe_r == pytest.approx(1.2)
    assert got.net_pnl == pytest.approx(500 - got.costs.total)
    assert tr.evaluation_violations(tr.evaluate_trades(trade, P)).count() == 0
    pricey = trade.withColumn("entry_price", F.lit(60_000.0))
    assert tr.evaluation_violations(tr.evaluate_trades(pricey, P)).count() == 3


def test_end_of_day_exit(spark):
    got = exits(spark, {74: (100.0, 101.0, 99.5, 100.7)})["base"]
    assert (got.entry_slot, got.entry_price, got.exit_price, got.exit_reason) == (10, 100.0, 100.7, "eod")
    assert got.mfe_price == 101.0 and got.duration_bars == 64


def test_stop_fills_at_the_stop_or_at_a_worse_open(spark):
    touched = exits(spark, {20: (100.0, 100.0, 97.0, 97.5)})["base"]
    gapped = exits(spark, {20: (96.0, 97.0, 95.0, 96.5)})["base"]
    assert (touched.exit_price, touched.exit_reason, touched.exit_slot) == (98.0, "stop", 20)
    assert gapped.exit_price == 96.0


def test_stop_on_the_entry_bar(spark):
    got = exits(spark, {10: (100.0, 100.5, 97.0, 99.0)})["base"]
    assert (got.exit_slot, got.duration_bars, got.exit_price) == (10, 0, 98.0)


def test_half_off_at_one_risk_then_breakeven_from_the_next_bar(spark):
    got = exits(spark, {20: (100.5, 102.5, 99.0, 101.0), 25: (101.0, 101.0, 99.8, 100.2)})
    assert got["partial_1r"].exit_price == pytest.approx(0.5 * 102 + 0.5 * 100)
    assert (got["partial_1r"].exit_reason, got["partial_1r"].exit_slot) == ("stop", 21)
    assert got["base"].exit_reason == "eod"


def test_half_off_and_the_rest_at_the_close(spark):
    up = {k: (103.0, 103.5, 102.5, 103.0) for k in range(21, 75)}
    got = exits(spark, {20: (100.5, 103.0, 100.2, 102.8), **up})["partial_1r"]
    assert (got.exit_reason, got.exit_price) == ("target", pytest.approx(0.5 * 102 + 0.5 * 103))


def test_stop_is_taken_first_when_a_bar_reaches_both(spark):
    got = exits(spark, {20: (100.0, 103.0, 97.0, 100.0)})["partial_1r"]
    assert (got.exit_reason, got.exit_price) == ("stop", 98.0)


def test_short_side_mirrors(spark):
    got = exits(spark, {20: (100.0, 103.0, 100.0, 102.0)}, direction="short")["base"]
    assert (got.exit_price, got.exit_reason, got.stop_price) == (102.0, "stop", 102.0)


def test_late_and_missing_entries_are_dropped(spark):
    for slot, n in ((62, 1), (63, 0), (74, 0)):
        assert tr.entry_rule(signal(spark, slot=slot), bars(spark, flat_session()), P).count() == n


def test_gate(spark):
    rows = signal(spark)
    for verdict, n in (("signal", 1), ("no_signal", 0), ("insufficient_sample", 0)):
        study = spark.createDataFrame([(verdict,)], "verdict string")
        assert tr.setup_gate(rows, study).count() == n
