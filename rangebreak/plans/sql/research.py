"""SQL for the study, the forecast, the random control and the summaries."""

from __future__ import annotations

from rangebreak.params import DIRECTIONAL_FEATURES, TESTED_FEATURES, TWO_SIDED_FEATURES
from rangebreak.plans.fixtures import PARAMS
from rangebreak.plans.sql.compose import step
from rangebreak.plans.sql.trading import evaluated

CLASSES = ("busted", "neither", "sustained")


def pick(parts: str, modulus: str) -> str:
    """The first 32 bits of an MD5, reduced."""
    return f"(('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::BIGINT % {modulus})"


def bootstrap(source: str, groups: str, top: str, bottom: str, statistic: str, draws: int = 1000) -> str:
    """Interval over whole sessions drawn with replacement; ``statistic`` reads ``t`` and ``b``."""
    g = f"{groups}, " if groups else ""
    by = f"GROUP BY {groups}" if groups else ""
    same = " AND ".join(f"s.{c.strip()} = d.{c.strip()}" for c in groups.split(",")) + " AND" if groups else ""
    part = f"PARTITION BY {groups} " if groups else ""
    return f"""SELECT {g}count(v) AS defined_draws,
 CASE WHEN count(v) >= {draws // 2} THEN quantile_cont(v, 0.025) END AS ci_low,
 CASE WHEN count(v) >= {draws // 2} THEN quantile_cont(v, 0.975) END AS ci_high FROM (
 SELECT {g}draw, {statistic} AS v FROM (
  SELECT {", ".join("d." + c.strip() for c in groups.split(",")) + "," if groups else ""} d.draw, sum(s.t) AS t, sum(s.b) AS b FROM (
   SELECT {g}draw, {pick("'0', draw, i", "m")} AS p FROM (SELECT {g}m, draw, unnest(range(m)) AS i FROM (
     SELECT {g}count(*) AS m FROM (SELECT DISTINCT {g}session_date FROM {source}) {by}), (SELECT unnest(range({draws})) AS draw))) d
  JOIN (SELECT {g}row_number() OVER ({part}ORDER BY session_date) - 1 AS p, t, b FROM (
    SELECT {g}session_date, sum({top}) AS t, sum({bottom}) AS b FROM {source} GROUP BY {g}session_date)) s
  ON {same} s.p = d.p GROUP BY ALL) ) {by}"""


MEAN = "CASE WHEN b > 0 THEN t / b END"
SKILL = "CASE WHEN b > 0 THEN 1 - t / b END"
LEVEL = "setup, variant, slippage_bps"

for _g, _p in PARAMS.items():
    step(
        f"long_{_g}",
        " UNION ALL ".join(
            f"SELECT symbol, session_date, direction, label, '{f}' AS feature, {f} AS value FROM feat_{_g} WHERE {f} IS NOT NULL"
            for f in TESTED_FEATURES
        ),
    )
    step(
        f"split_{_g}",
        f"""SELECT min(session_date) AS d FROM (SELECT session_date, row_number() OVER (ORDER BY session_date) AS rn,
 sum(n) OVER (ORDER BY session_date) / sum(n) OVER () AS share FROM (SELECT session_date, count(*) AS n FROM feat_{_g}
 GROUP BY session_date)) WHERE rn > 1 AND share >= {_p.train_fraction}""",
    )
    step(
        f"scoped_{_g}",
        f"""SELECT feature, 'all' AS scope, value, label FROM long_{_g}
 UNION ALL SELECT feature, CASE WHEN session_date < d THEN 'first half' ELSE 'second half' END, value, label
 FROM long_{_g}, split_{_g} WHERE d IS NOT NULL""",
    )

    def cut(source: str, keys: str) -> str:
        return f"""SELECT *, CASE WHEN kinds <= 3 THEN vs[1] ELSE q0 END AS e0,
 CASE WHEN kinds = 3 THEN vs[2] WHEN kinds > 3 THEN q1 END AS e1 FROM (
 SELECT {keys}, count(*) AS n, count(DISTINCT value) AS kinds, min(value) AS lo, max(value) AS hi,
 quantile_cont(value, 1/3) AS q0, quantile_cont(value, 2/3) AS q1, list_sort(list_distinct(list(value))) AS vs
 FROM {source} GROUP BY {keys}) WHERE n >= 3 AND kinds >= 2 AND (kinds <= 3 OR q0 <> q1)"""

    def bucketed(source: str, cuts: str, keys: str) -> str:
        on = " AND ".join(f"c.{k.strip()} = v.{k.strip()}" for k in keys.split(","))
        sel = ", ".join(f"v.{k.strip()}" for k in keys.split(","))
        third = "CASE WHEN v.value <= c.e0 THEN 'low' WHEN v.value <= c.e1 THEN 'mid' ELSE 'high' END"
        return f"""SELECT * EXCLUDE (filled, expected) FROM (SELECT {keys}, third, count(*) AS n, count(*) OVER (PARTITION BY {keys}) AS filled,
 CASE WHEN any_value(kinds) = 2 THEN 2 ELSE 3 END AS expected, count(*) FILTER (label = 'BUSTED') AS busted,
 count(*) FILTER (label = 'NEITHER') AS neither, count(*) FILTER (label = 'SUSTAINED') AS sustained,
 any_value(CASE WHEN kinds <= 3 THEN value WHEN third = 'low' THEN lo WHEN third = 'mid' THEN e0 ELSE e1 END) AS lower,
 any_value(CASE WHEN kinds <= 3 THEN value WHEN third = 'low' THEN e0 WHEN third = 'mid' THEN e1 ELSE hi END) AS upper
 FROM (SELECT {sel}, v.value, v.label, c.kinds, c.lo, c.hi, c.e0, c.e1, {third} AS third FROM {source} v JOIN {cuts} c ON {on})
 GROUP BY {keys}, third) WHERE filled = expected"""

    step(f"cuts_{_g}", cut(f"scoped_{_g}", "feature, scope"))
    step(f"thirds_{_g}", bucketed(f"scoped_{_g}", f"cuts_{_g}", "feature, scope"))
    step(
        f"rates_{_g}",
        f"""SELECT *, busted / n * 100 AS failure_pct, sum(n) OVER (PARTITION BY feature, scope) AS table_n,
 sum(busted) OVER (PARTITION BY feature, scope) AS table_failures FROM thirds_{_g}""",
    )
    _names = ", ".join(f"('{f}', {str(f in TWO_SIDED_FEATURES).lower()}, {i})" for i, f in enumerate(TESTED_FEATURES))
    _wide = ", ".join(
        f"""max(failure_pct) FILTER (scope = '{s}' AND third = 'low') - max(failure_pct) FILTER (scope = '{s}' AND third = 'high') AS gap_{n},
 max(table_failures) FILTER (scope = '{s}') AS failures_{n}"""
        for s, n in (("all", "all"), ("first half", "first"), ("second half", "second"))
    )
    step(
        f"find_{_g}",
        f"""SELECT feature, two_sided, place, gap_all IS NOT NULL AS measurable, gap_all,
 CASE WHEN gap_all IS NOT NULL THEN gap_first END AS gap_first, CASE WHEN gap_all IS NOT NULL THEN gap_second END AS gap_second,
 CASE WHEN gap_all IS NOT NULL THEN failures_first END AS failures_first,
 CASE WHEN gap_all IS NOT NULL THEN failures_second END AS failures_second, coalesce(testable, false) AS testable,
 coalesce(testable AND NOT two_sided AND gap_first >= {_p.min_gap_points} AND gap_second >= {_p.min_gap_points}, false) AS holds
 FROM (SELECT f.*, w.* EXCLUDE (feature), gap_all IS NOT NULL AND gap_first IS NOT NULL AND gap_second IS NOT NULL
  AND failures_first >= {_p.min_sample} AND failures_second >= {_p.min_sample} AS testable
  FROM (VALUES {_names}) f(feature, two_sided, place) LEFT JOIN (SELECT feature, {_wide} FROM rates_{_g} GROUP BY feature) w
  ON w.feature = f.feature)""",
    )
    step(
        f"study_{_g}",
        f"""SELECT n_breakouts, base_rate_pct, split_date, second_half_failures, n_tested, n_directional, n_testable, n_holding,
 1 - pow(0.95::DOUBLE, n_directional) AS family_error, CASE WHEN any_testable = 0 THEN 'insufficient_sample'
 WHEN n_holding > 0 THEN 'signal' ELSE 'no_signal' END AS verdict FROM
 (SELECT count(*) AS n_breakouts, avg(CASE WHEN label = 'BUSTED' THEN 1.0::DOUBLE ELSE 0.0 END) * 100 AS base_rate_pct,
  any_value(d) AS split_date, count(*) FILTER (label = 'BUSTED' AND session_date >= d) AS second_half_failures
  FROM feat_{_g}, split_{_g}),
 (SELECT count(*) AS n_tested, count(*) FILTER (NOT two_sided) AS n_directional, count(*) FILTER (testable) AS n_testable,
  count(*) FILTER (holds) AS n_holding, count(*) FILTER (testable AND NOT two_sided) AS any_testable FROM find_{_g})""",
    )

    # ---- forecast: every training window spelled out as a join on earlier dates ----------
    _six = ", ".join(f"'{f}'" for f in DIRECTIONAL_FEATURES)
    _counts = ", ".join(f"count(*) FILTER (label = '{c.upper()}') AS train_{c}" for c in CLASSES)
    _base = ", ".join(f"train_{c} / n_train AS base_{c}" for c in CLASSES)

    def rated(source: str) -> str:
        rates = ", ".join(
            f"({c} + {_p.shrinkage_k} * base_{c}) / (n + {_p.shrinkage_k}) AS rate_{c}" for c in CLASSES
        )
        return f"SELECT *, busted / n AS raw_rate, {rates} FROM {source}"

    step(f"rows6_{_g}", f"SELECT * FROM long_{_g} WHERE feature IN ({_six})")
    step(f"cut6_{_g}", cut(f"rows6_{_g}", "feature"))
    step(f"buck6_{_g}", bucketed(f"rows6_{_g}", f"cut6_{_g}", "feature"))
    step(
        f"rule_{_g}",
        rated(
            f"""(SELECT b.*, t.* FROM (SELECT *, sum(n) OVER (PARTITION BY feature) AS fn, min(n) OVER (PARTITION BY feature) AS mn
 FROM buck6_{_g}) b, (SELECT *, {_base} FROM (SELECT count(*) AS n_train, {_counts} FROM feat_{_g})) t
 WHERE fn >= {3 * _p.min_bucket_rows} AND mn >= {_p.min_bucket_rows})"""
        ),
    )
    step(
        f"wins_{_g}",
        f"""SELECT *, {_base} FROM (SELECT s.session_date AS target, count(*) AS n_train, {_counts} FROM
 (SELECT session_date, row_number() OVER (ORDER BY session_date) AS rn FROM (SELECT DISTINCT session_date FROM feat_{_g})) s
 JOIN feat_{_g} r ON r.session_date < s.session_date WHERE s.rn > {_p.min_train_sessions} GROUP BY s.session_date)
 WHERE train_busted >= {_p.min_train_failures}""",
    )
    step(
        f"train_{_g}",
        f"SELECT w.target, l.feature, l.value, l.label FROM wins_{_g} w JOIN rows6_{_g} l ON l.session_date < w.target",
    )
    step(f"wcut_{_g}", cut(f"train_{_g}", "target, feature"))
    step(f"wbuck_{_g}", bucketed(f"train_{_g}", f"wcut_{_g}", "target, feature"))
    step(
        f"wrule_{_g}",
        rated(
            f"""(SELECT b.*, w.* EXCLUDE (target) FROM (SELECT *, sum(n) OVER (PARTITION BY target, feature) AS fn,
 min(n) OVER (PARTITION BY target, feature) AS mn FROM wbuck_{_g}) b JOIN wins_{_g} w ON w.target = b.target
 WHERE fn >= {3 * _p.min_bucket_rows} AND mn >= {_p.min_bucket_rows})"""
        ),
    )

    def logit(x: str) -> str:
        c = f"least(greatest({x}, {_p.prob_floor}::DOUBLE), {_p.prob_ceiling}::DOUBLE)"
        return f"ln({c} / (1 - {c}))"

    def lr(x: str, y: str) -> str:
        return f"ln(greatest({x}, {_p.prob_floor}::DOUBLE) / greatest({y}, {_p.prob_floor}::DOUBLE))"

    _ratio = ", ".join(
        f"{lr(f'rate_{c}', 'rate_neither')} - {lr(f'base_{c}', 'base_neither')} AS ratio_{c}" for c in CLASSES
    )
    step(
        f"hits_{_g}",
        f"""SELECT l.symbol, l.session_date, l.direction, l.feature, r.third, r.rate_busted, r.rate_neither, r.rate_sustained,
 {logit('rate_busted')} - {logit('base_busted')} AS log_odds, {_ratio}
 FROM rows6_{_g} l JOIN wcut_{_g} c ON c.target = l.session_date AND c.feature = l.feature
 JOIN wrule_{_g} r ON r.target = l.session_date AND r.feature = l.feature
 AND r.third = CASE WHEN l.value <= c.e0 THEN 'low' WHEN l.value <= c.e1 THEN 'mid' ELSE 'high' END""",
    )
    _score = {c: f"{lr(f'base_{c}', 'base_neither')} + {_p.damping} * ratio_{c}" for c in CLASSES}
    _top = "greatest(" + ", ".join(_score.values()) + ")"
    _w = {c: f"exp({s} - {_top})" for c, s in _score.items()}
    step(
        f"pred_{_g}",
        f"""SELECT f.symbol, f.session_date, f.direction, f.breakout_time, f.label AS outcome, w.n_train,
 w.train_busted AS train_failures, w.base_busted AS base_rate, w.base_busted, w.base_neither, w.base_sustained,
 coalesce(k, 0) AS features_used,
 1 / (1 + exp(-({logit('base_busted')} + {_p.damping} * coalesce(lo, 0)))) AS p_fail, coalesce(mean_busted, base_busted) AS p_fail_average,
 {", ".join(f"CASE WHEN k IS NULL THEN base_{c} ELSE {_w[c]} / ({_w['busted']} + {_w['neither']} + {_w['sustained']}) END AS p_{c}" for c in CLASSES)},
 {", ".join(f"CASE WHEN k IS NULL THEN base_{c} ELSE mean_{c} / (mean_busted + mean_neither + mean_sustained) END AS p_{c}_average" for c in CLASSES)}
 FROM feat_{_g} f JOIN wins_{_g} w ON w.target = f.session_date LEFT JOIN (SELECT symbol, session_date, direction, count(*) AS k,
  sum(log_odds) AS lo, {", ".join(f"avg(rate_{c}) AS mean_{c}, sum(ratio_{c}) AS ratio_{c}" for c in CLASSES)}
  FROM hits_{_g} GROUP BY symbol, session_date, direction) h
 ON h.symbol = f.symbol AND h.session_date = f.session_date AND h.direction = f.direction""",
    )
    step(
        f"rps_{_g}",
        f"""SELECT *, pow(p_busted - a, 2) + pow(p_busted + p_neither - b, 2) AS rps,
 pow(base_busted - a, 2) + pow(base_busted + base_neither - b, 2) AS rps_base,
 pow(p_fail - a, 2) AS err, pow(base_rate - a, 2) AS base_err, pow(p_fail_average - a, 2) AS err_average FROM (SELECT *,
 CASE WHEN outcome = 'BUSTED' THEN 1.0::DOUBLE ELSE 0.0 END AS a, CASE WHEN outcome = 'SUSTAINED' THEN 0.0::DOUBLE ELSE 1.0 END AS b FROM pred_{_g})""",
    )

    # ---- random control ------------------------------------------------------------------
    step(
        f"elig_{_g}",
        f"""SELECT b.symbol, b.session_date, p.atr, count(*) AS n_bars, count(*) FILTER (slot < {_p.first_entry_slot}) AS first_pos,
 count(*) FILTER (slot <= {_p.last_entry_slot}) - 1 AS last_pos FROM bars_{_g} b JOIN prior_{_g} p USING (symbol, session_date)
 WHERE p.atr > 0 GROUP BY b.symbol, b.session_date, p.atr""",
    )
    step(
        f"numb_{_g}",
        f"""SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY {pick('symbol', '64')}, symbol) - 1 AS num,
 count(*) OVER (PARTITION BY session_date) AS m FROM elig_{_g}""",
    )
    step(
        f"idtrades_{_g}",
        f"SELECT *, concat_ws('|', setup, variant, symbol, session_date, direction) AS trade_id FROM trades_{_g}",
    )
    step(
        f"twin0_{_g}",
        f"""SELECT t.trade_id, t.setup AS matched_setup, t.variant, t.session_date, n.symbol, n.atr, n.n_bars, t.duration_bars AS held,
 CASE WHEN {pick("'0', t.trade_id, 'direction'", "2")} = 0 THEN 'long' ELSE 'short' END AS direction,
 n.first_pos + CASE WHEN least(n.last_pos, n.n_bars - 1 - t.duration_bars) - n.first_pos + 1 > 0 THEN
  {pick("'0', t.trade_id, 'entry'", "greatest(least(n.last_pos, n.n_bars - 1 - t.duration_bars) - n.first_pos + 1, 1)")} ELSE 0 END AS entry_pos
 FROM idtrades_{_g} t JOIN (SELECT DISTINCT session_date, m FROM numb_{_g}) d ON d.session_date = t.session_date
 JOIN numb_{_g} n ON n.session_date = t.session_date AND n.num = {pick("'0', t.trade_id, 'symbol'", "d.m")}
 WHERE n.last_pos >= n.first_pos""",
    )
    step(
        f"twin1_{_g}",
        f"""SELECT w.*, CASE WHEN w.direction = 'long' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg, e.slot AS entry_slot, e.ts AS entry_time,
 e.open AS entry_price, e.open - CASE WHEN w.direction = 'long' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * {_p.stop_atr}::DOUBLE * w.atr AS stop_price
 FROM twin0_{_g} w JOIN (SELECT b.*, h.pos FROM bars_{_g} b JOIN hist_{_g} h USING (symbol, session_date, slot)) e
 ON e.symbol = w.symbol AND e.session_date = w.session_date AND e.pos = w.entry_pos""",
    )
    step(
        f"twinpath_{_g}",
        f"""SELECT w.trade_id, h.pos, b.slot, b.ts, b.open, b.close, w.sg, w.stop_price,
 w.sg * CASE WHEN w.sg > 0 THEN b.high ELSE b.low END AS gain,
 w.sg * (CASE WHEN w.sg > 0 THEN b.low ELSE b.high END - w.stop_price) <= 0 AS hit
 FROM twin1_{_g} w JOIN hist_{_g} h ON h.symbol = w.symbol AND h.session_date = w.session_date
  AND h.pos BETWEEN w.entry_pos AND w.entry_pos + w.held
 JOIN bars_{_g} b ON b.symbol = h.symbol AND b.session_date = h.session_date AND b.slot = h.slot""",
    )
    step(
        f"twinexit_{_g}",
        f"""SELECT trade_id, min(pos) FILTER (hit) AS stop_pos, coalesce(min(pos) FILTER (hit), max(pos)) AS exit_pos
 FROM twinpath_{_g} GROUP BY trade_id""",
    )
    step(
        f"twins_{_g}",
        f"""SELECT w.trade_id, 'random' AS setup, w.matched_setup, w.variant, w.symbol, w.session_date, w.direction, w.sg, w.atr,
 w.entry_slot, w.entry_time, w.entry_price, w.stop_price, q.slot AS exit_slot, q.ts AS exit_time,
 CASE WHEN x.stop_pos IS NULL THEN q.close WHEN w.sg * (q.open - w.stop_price) <= 0 THEN q.open ELSE w.stop_price END AS exit_price,
 CASE WHEN x.stop_pos IS NOT NULL THEN 'stop' WHEN x.exit_pos = w.n_bars - 1 THEN 'eod' ELSE 'time' END AS exit_reason,
 x.exit_pos - w.entry_pos AS duration_bars,
 w.sg * (SELECT max(g.gain) FROM twinpath_{_g} g WHERE g.trade_id = w.trade_id AND g.pos <= x.exit_pos) AS mfe_price
 FROM twin1_{_g} w JOIN twinexit_{_g} x USING (trade_id) JOIN twinpath_{_g} q ON q.trade_id = w.trade_id AND q.pos = x.exit_pos""",
    )
    step(f"sres_{_g}", evaluated(f"idtrades_{_g}"))
    step(f"rres_{_g}", evaluated(f"twins_{_g}"))
    step(
        f"pairs_{_g}",
        f"""SELECT s.setup, s.variant, s.slippage_bps, s.session_date, s.r_net AS rs, r.r_net AS rr, s.r_net - r.r_net AS diff
 FROM sres_{_g} s JOIN rres_{_g} r ON r.trade_id = s.trade_id AND r.slippage_bps = s.slippage_bps""",
    )
    step(f"pairci_{_g}", bootstrap(f"pairs_{_g}", LEVEL, "diff", "1", MEAN))
    step(
        f"edge_{_g}",
        f"""SELECT m.*, c.ci_low, c.ci_high, c.ci_low <= 0 AND c.ci_high >= 0 AS flat FROM (SELECT {LEVEL}, count(*) AS n,
 avg(rs) AS mean_strategy_r, avg(rr) AS mean_random_r, avg(diff) AS edge_r FROM pairs_{_g} GROUP BY {LEVEL}) m
 JOIN pairci_{_g} c USING ({LEVEL})""",
    )
    step(f"sresci_{_g}", bootstrap(f"sres_{_g}", LEVEL, "r_net", "1", MEAN))

    def expected(source: str, interval: str, groups: str) -> str:
        return f"""SELECT *, ci_low <= 0 AND ci_high >= 0 AS flat FROM (SELECT {groups}, n, n >= {_p.min_sample} AS computed,
 CASE WHEN n >= {_p.min_sample} THEN wins / n END AS win_rate,
 CASE WHEN n >= {_p.min_sample} THEN aw END AS avg_win_r, CASE WHEN n >= {_p.min_sample} THEN al END AS avg_loss_r,
 CASE WHEN n >= {_p.min_sample} THEN wins / n * aw - (1 - wins / n) * abs(al) END AS expectancy_r,
 CASE WHEN n >= {_p.min_sample} THEN c.ci_low END AS ci_low, CASE WHEN n >= {_p.min_sample} THEN c.ci_high END AS ci_high,
 CASE WHEN n >= {_p.min_sample} THEN short / n END AS breakeven_failure_rate
 FROM (SELECT {groups}, count(*) AS n, count(*) FILTER (r_net > 0) AS wins, coalesce(avg(r_net) FILTER (r_net > 0), 0) AS aw,
  coalesce(avg(r_net) FILTER (r_net <= 0), 0) AS al, count(*) FILTER (mfe_r < {_p.breakeven_r}) AS short
  FROM {source} GROUP BY {groups}) e JOIN {interval} c USING ({groups}))"""

    step(f"exp_{_g}", expected(f"sres_{_g}", f"sresci_{_g}", LEVEL))
    step(
        f"joined_{_g}",
        f"""SELECT s.*, f.rvol_breakout_bar, f.or_width_atr FROM sres_{_g} s LEFT JOIN feat_{_g} f ON f.symbol = s.symbol
 AND f.session_date = s.session_date AND f.direction = s.feature_direction""",
    )
    step(
        f"seg_{_g}",
        f"""SELECT j.* , CASE WHEN rvol_breakout_bar IS NULL THEN 'rvol n/a' WHEN rvol_breakout_bar < 1 THEN 'rvol <1.0'
  WHEN rvol_breakout_bar < {_p.rvol_threshold} THEN 'rvol 1.0-{_p.rvol_threshold:g}' ELSE 'rvol >={_p.rvol_threshold:g}' END AS seg_rvol,
 CASE WHEN or_width_atr IS NULL OR q.c < 4 OR q.lo = q.hi THEN 'or_width n/a' ELSE 'or_width Q' || (1 +
  len(list_filter(list_distinct(q.e), lambda x: x > q.lo AND x < or_width_atr))) END AS seg_or_width,
 printf('%02d:%02d', hour(entry_time), minute(entry_time) // 30 * 30) AS seg_half_hour
 FROM joined_{_g} j LEFT JOIN (SELECT {LEVEL}, count(or_width_atr) AS c, min(or_width_atr) AS lo, max(or_width_atr) AS hi,
  quantile_cont(or_width_atr, [0.25, 0.5, 0.75]) AS e FROM joined_{_g} GROUP BY {LEVEL}) q USING ({LEVEL})""",
    )
    _stack = " UNION ALL ".join(
        f"SELECT {LEVEL}, session_date, r_net, mfe_r, '{s}' AS segment, {s} AS segment_value FROM seg_{_g}"
        for s in ("seg_rvol", "seg_or_width", "seg_half_hour")
    )
    step(f"stack_{_g}", _stack)
    step(f"stackci_{_g}", bootstrap(f"stack_{_g}", LEVEL + ", segment, segment_value", "r_net", "1", MEAN))
    step(f"segexp_{_g}", expected(f"stack_{_g}", f"stackci_{_g}", LEVEL + ", segment, segment_value"))
    step(
        f"bt_{_g}",
        f"""SELECT e.*, x.computed AS has_expectancy, x.win_rate, x.avg_win_r, x.avg_loss_r, x.expectancy_r,
 x.ci_low AS expectancy_ci_low, x.ci_high AS expectancy_ci_high, x.breakeven_failure_rate FROM edge_{_g} e
 JOIN exp_{_g} x USING ({LEVEL})""",
    )
    step(
        f"role_{_g}",
        f"""SELECT setup, variant, slippage_bps, 'strategy' AS role, net_pnl, cost_total, r_net, symbol, session_date, direction, trade_id
 FROM sres_{_g} UNION ALL SELECT matched_setup, variant, slippage_bps, 'random', net_pnl, cost_total, r_net, symbol, session_date,
 direction, trade_id FROM rres_{_g}""",
    )
