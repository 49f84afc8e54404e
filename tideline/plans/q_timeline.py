"""Queries over the timeline operators."""

from pyspark.sql import functions as F

from tideline.functions import arrays as A
from tideline.functions.scalars import local_date
from tideline.operators import ordered as O
from tideline.operators import timeline as T
from tideline.plans.catalog import register
from tideline.plans.views import Views

ID = "league, entity, CAST(epoch_us(ts) AS BIGINT) AS ts_us"
NUM = """r AS (SELECT *, row_number() OVER (PARTITION BY league, entity ORDER BY ts, game_id) AS rn,
      lag(ts) OVER (PARTITION BY league, entity ORDER BY ts, game_id) AS prev_ts,
      CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS pts FROM entity_rows)"""
FIRST = "(prev_ts IS NULL OR prev_ts < ts)"


def over(agg: str, n: int, part: str = "league, entity", frame_end: str = "1 PRECEDING") -> str:
    return f"{agg} OVER (PARTITION BY {part} ORDER BY rn ROWS BETWEEN {n} PRECEDING AND {frame_end})"


def us(df, *cols, digits=9):
    """Instants as microseconds and doubles rounded, so that values compare across engines."""
    out = df.withColumn("ts_us", F.unix_micros("ts")).drop("ts") if "ts" in df.columns else df
    doubles = [f.name for f in out.schema if f.dataType.typeName() == "double"]
    return out.withColumns({c: F.round(c, digits) + 0.0 for c in doubles}) if doubles else out


@register("w1_entity_rows", f"SELECT game_id, {ID}, stage, opponent, side, gf, ga, k1, k2, k3 FROM entity_rows")
def _(v: Views):
    return us(v.entity_rows)


FORM_SQL = ", ".join(
    f"ROUND(COALESCE({over(f'avg({e})', n)}, {d}), 9) AS {c}_{n}"
    for n in T.FORM_WINDOWS
    for c, e, d in (("pts", "pts", 1.0), ("gf", "gf", 0.0), ("ga", "ga", 0.0),
                    ("win", "CASE WHEN gf > ga THEN 1 ELSE 0 END", 0.33), ("draw", "CASE WHEN gf = ga THEN 1 ELSE 0 END", 0.33)))
GD_SQL = ", ".join(f"ROUND(COALESCE({over('avg(gf)', n)}, 0.0) - COALESCE({over('avg(ga)', n)}, 0.0), 9) AS gd_{n}" for n in T.FORM_WINDOWS)


@register("w2_rolling_form", f"""WITH {NUM}, f AS (SELECT *, {FORM_SQL}, {GD_SQL} FROM r)
SELECT {ID}, rn - 1 AS matches, {', '.join(f'{c}_{n}' for n in T.FORM_WINDOWS for c in ('pts', 'gf', 'ga', 'gd', 'win', 'draw'))}
FROM f WHERE {FIRST}""")
def _(v: Views):
    return us(T.rolling_form(v.entity_rows))


def _shrunk(n: int) -> str:
    win, draw = (f"COALESCE({over(f'avg(CASE WHEN gf {o} ga THEN 1 ELSE 0 END)', n)}, 0.33)" for o in (">", "="))
    gd = f"(COALESCE({over('avg(gf)', n)}, 0.0) - COALESCE({over('avg(ga)', n)}, 0.0))"
    eff = f"LEAST(rn - 1, {n})"
    return (f"ROUND(({win} * {eff} + 10.0) / ({eff} + 20.0), 9) AS win_shrunk_{n}, "
            f"ROUND({gd} * {eff} / ({eff} + 20.0), 9) + 0.0 AS gd_shrunk_{n}, "
            f"ROUND(({draw} * {eff} + 4.8) / ({eff} + 20.0), 9) AS draw_shrunk_{n}")


@register("w3_shrunk_rate", f"""WITH {NUM}, f AS (SELECT *, {', '.join(map(_shrunk, (3, 5, 10, 20)))} FROM r)
SELECT {ID}, {', '.join(f'{c}_shrunk_{n}' for n in (3, 5, 10, 20) for c in ('win', 'gd', 'draw'))} FROM f WHERE {FIRST}""")
def _(v: Views):
    form = T.shrunk_form(T.rolling_form(v.entity_rows, (3, 5, 10, 20)))
    return us(form.select("league", "entity", "ts", *[c for c in form.columns if "_shrunk_" in c]))


@register("w4_venue_form", f"""WITH r AS (SELECT *, row_number() OVER w AS rn, lag(ts) OVER w AS prev_ts,
  CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS pts FROM entity_rows
  WINDOW w AS (PARTITION BY league, entity, side ORDER BY ts, game_id)),
f AS (SELECT *, ROUND(COALESCE({over('avg(gf)', 10, 'league, entity, side')}, 0.0), 9) AS venue_gf,
  ROUND(COALESCE({over('avg(ga)', 10, 'league, entity, side')}, 0.0), 9) AS venue_ga,
  ROUND(COALESCE(avg(pts) OVER (PARTITION BY league, entity, side ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0), 9)
    AS venue_pts FROM r)
SELECT {ID}, side, venue_gf, venue_ga, venue_pts, rn - 1 AS venue_n FROM f WHERE {FIRST}""")
def _(v: Views):
    return us(T.venue_form(v.entity_rows))


@register("w5_rest_days", f"""WITH d AS (SELECT DISTINCT league, entity, ts FROM entity_rows)
SELECT {ID}, COALESCE(CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY league, entity ORDER BY ts)) AS DOUBLE) / 86400e6, 30.0)
  AS rest_days FROM d""")
def _(v: Views):
    return us(T.rest_days(v.entity_rows))


@register("w6_recent_form", f"""WITH {NUM}
SELECT game_id, {ID}, side, {', '.join(f"ROUND({over('avg(pts)', n)}, 9) AS ppg_{n}, ROUND({over('avg(gf - ga)', n)}, 9) + 0.0 AS form_gd_{n}" for n in (5, 10))}
FROM r""")
def _(v: Views):
    f = T.recent_form(v.entity_rows)
    return us(f.select("game_id", "league", "entity", "ts", "side", "ppg_5", "form_gd_5", "ppg_10", "form_gd_10"))


H2H = """r AS (SELECT *, LEAST(home, away) AS lo, GREATEST(home, away) AS hi,
  CASE WHEN home_score > away_score THEN home WHEN home_score < away_score THEN away END AS winner FROM games),
h AS (SELECT *, count(*) OVER w AS n, COALESCE(SUM(CASE WHEN winner = lo THEN 1 ELSE 0 END) OVER w, 0) AS nlo,
  COALESCE(SUM(CASE WHEN winner = hi THEN 1 ELSE 0 END) OVER w, 0) AS nhi FROM r
  WINDOW w AS (PARTITION BY league, lo, hi ORDER BY ts, game_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
hh AS (SELECT *, n AS h2h_meetings, CASE WHEN n > 0 THEN ROUND(CAST(CASE WHEN home = lo THEN nlo ELSE nhi END AS DOUBLE) / n, 9) END
  AS h2h_home_win_rate, CASE WHEN n > 0 THEN ROUND(CAST(n - nlo - nhi AS DOUBLE) / n, 9) END AS h2h_draw_rate FROM h)"""


@register("w7_head_to_head", f"WITH {H2H} SELECT game_id, h2h_meetings, h2h_home_win_rate, h2h_draw_rate FROM hh")
def _(v: Views):
    out = T.head_to_head(v.games)
    return us(out.select("game_id", "h2h_meetings", "h2h_home_win_rate", "h2h_draw_rate"))


def _shots(games):
    return games.withColumns({
        "shots_home": F.expr("int(k1 % 7)"), "shots_away": F.expr("int(k2 % 7)"),
        "sot_home": F.expr("int(k1 % 3)"), "sot_away": F.expr("int(k2 % 3)")})


SHOTS = """, ROUND(CAST(home_score AS DOUBLE) / NULLIF(k1 % 7, 0), 9) AS home_shot_conversion,
ROUND(CAST(away_score AS DOUBLE) / NULLIF(k2 % 7, 0), 9) AS away_shot_conversion,
ROUND(CAST(k1 % 3 AS DOUBLE) / NULLIF(k1 % 7, 0), 9) AS home_sot_accuracy, ROUND(CAST(k2 % 3 AS DOUBLE) / NULLIF(k2 % 7, 0), 9) AS away_sot_accuracy"""


@register("w8_shot_efficiency", f"SELECT game_id{SHOTS} FROM games")
def _(v: Views):
    out = T.shot_efficiency(_shots(v.games))
    return us(out.select("game_id", "home_shot_conversion", "away_shot_conversion", "home_sot_accuracy", "away_sot_accuracy"))


@register("w9_apply_stages", f"""WITH {H2H},
d AS MATERIALIZED (SELECT *, CAST(FLOOR((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY league, entity ORDER BY ts))) / 86400e6) AS DOUBLE) AS rest
      FROM (SELECT DISTINCT league, entity, ts FROM entity_rows)),
e AS (SELECT game_id, max(CASE WHEN side = 'H' THEN rest END) AS home_rest_days, max(CASE WHEN side = 'A' THEN rest END) AS away_rest_days
      FROM entity_rows JOIN d USING (league, entity, ts) GROUP BY game_id)
SELECT hh.game_id, home_rest_days, away_rest_days, home_rest_days - away_rest_days AS rest_days_diff, h2h_meetings, h2h_home_win_rate,
  h2h_draw_rate{SHOTS} FROM hh JOIN e USING (game_id)""")
def _(v: Views):
    out = T.apply_stages(_shots(v.games), ["rest_days", "head_to_head", "shot_efficiency"])
    keep = ["game_id", "home_rest_days", "away_rest_days", "rest_days_diff", "h2h_meetings", "h2h_home_win_rate", "h2h_draw_rate",
            "home_shot_conversion", "away_shot_conversion", "home_sot_accuracy", "away_sot_accuracy"]
    return us(out.select(*keep))


BAT = {"pa": "30 + k1 % 10", "ab": "25 + k1 % 8", "h": "k2 % 12", "hr": "gf % 3", "bb": "k3 % 5", "so": "k1 % 9",
       "doubles": "k2 % 4", "triples": "k3 % 2"}


def _bat_sql(n: int) -> str:
    return ", ".join(f"COALESCE({over(f'avg({e})', n)}, 0.0) AS m_{c}_{n}" for c, e in BAT.items())


def _bat_rates(n: int) -> str:
    m = lambda c: f"m_{c}_{n}"
    ab, pa = f"GREATEST({m('ab')}, 1.0)", f"GREATEST({m('pa')}, 1.0)"
    power = f"({m('doubles')} + 2 * {m('triples')} + 3 * {m('hr')}) / {ab}"
    cols = {"avg": f"{m('h')} / {ab}", "hr": m("hr"), "bb": m("bb"), "so": m("so"), "bb_rate": f"{m('bb')} / {pa}",
            "so_rate": f"{m('so')} / {pa}", "xbh": f"{m('doubles')} + {m('triples')} + {m('hr')}", "hr_rate": f"{m('hr')} / {ab}",
            "iso_proxy": f"GREATEST(0.0, {power} - {m('h')} / {ab})", "extra_base_rate": f"GREATEST(0.0, {power})"}
    return ", ".join(f"ROUND({e}, 9) AS bat_{c}_{n}" for c, e in cols.items())


@register("w10_batting_windows", f"""WITH {NUM}, f AS (SELECT *, {', '.join(map(_bat_sql, (3, 5, 10, 20, 30)))} FROM r)
SELECT {ID}, {', '.join(map(_bat_rates, (3, 5, 10, 20, 30)))} FROM f WHERE {FIRST}""")
def _(v: Views):
    return us(T.batting_windows(v.entity_rows.withColumns({c: F.expr(e) for c, e in BAT.items()})))


RELIEF = {"er": "CASE WHEN k3 % 3 > 0 THEN k1 % 5 END", "ip": "CASE WHEN k3 % 3 > 0 THEN k2 % 4 END", "h": "k1 % 4", "bb": "k2 % 3",
          "so": "CASE WHEN k3 % 4 > 0 THEN k1 % 6 END", "hr": "k2 % 2"}


def _relief(v: Views):
    return T.event_team_records(v.entity_rows.withColumns({f"relief_{c}": F.expr(e) for c, e in RELIEF.items()}))


RELIEF_SQL = """b AS (SELECT *, CAST(COALESCE(er, GREATEST(0, ga - 3)) AS DOUBLE) AS bp_er, CAST(COALESCE(ip, 0) AS DOUBLE) AS bp_ip,
  CAST(h AS DOUBLE) AS bp_h, CAST(bb AS DOUBLE) AS bp_bb, CAST(COALESCE(so, 0) AS DOUBLE) AS bp_so, CAST(hr AS DOUBLE) AS bp_hr,
  CAST(COALESCE(er, 0) AS DOUBLE) AS bp_actual_er, CASE WHEN ip IS NOT NULL OR er IS NOT NULL OR so IS NOT NULL THEN 1.0 ELSE 0.0 END AS bp_actual
  FROM (SELECT *, """ + ", ".join(f"{e} AS {c}" for c, e in RELIEF.items()) + " FROM r))"


@register("a32_event_team_records", f"""WITH {NUM}, {RELIEF_SQL} SELECT game_id, {ID}, side, pts AS points, bp_er, bp_er AS bp_runs, bp_ip,
bp_h, bp_bb, bp_so, bp_hr, bp_actual_er, CAST(bp_actual AS DOUBLE) AS bp_actual FROM b""")
def _(v: Views):
    return us(_relief(v).select("game_id", "league", "entity", "ts", "side", "points", "bp_er", "bp_runs", "bp_ip", "bp_h", "bp_bb", "bp_so",
                                "bp_hr", "bp_actual_er", "bp_actual"))


@register("w11_bullpen_window", f"""WITH {NUM}, {RELIEF_SQL}, s AS (SELECT *, COALESCE({over('avg(bp_er)', 10)}, 0.0) AS er10,
{', '.join(f"COALESCE({over(f'sum({c})', 10)}, 0.0) AS s_{c}" for c in ('bp_ip', 'bp_actual_er', 'bp_h', 'bp_bb', 'bp_so', 'bp_hr', 'bp_actual'))} FROM b)
SELECT {ID}, ROUND(er10, 9) AS bp_er_10, s_bp_ip AS bp_ip_10,
 {', '.join(f"CASE WHEN s_bp_ip > 0 THEN ROUND(9.0 * {c} / s_bp_ip, 9) ELSE 0.0 END AS {n}" for n, c in (('bp_era_10', 's_bp_actual_er'), ('bp_k9_10', 's_bp_so'), ('bp_bb9_10', 's_bp_bb'), ('bp_hr9_10', 's_bp_hr')))},
 CASE WHEN s_bp_ip > 0 THEN ROUND((s_bp_h + s_bp_bb) / s_bp_ip, 9) ELSE 0.0 END AS bp_whip_10,
 ROUND(CAST(s_bp_actual AS DOUBLE) / GREATEST(LEAST(10.0, rn - 1), 1.0), 9) AS bp_coverage_10 FROM s WHERE {FIRST}""")
def _(v: Views):
    return us(T.bullpen_window(_relief(v)))


@register("w12_decayed_load", f"""WITH {NUM}, l AS (SELECT *, list(CAST(GREATEST(0, ga - 3) AS DOUBLE)) OVER (PARTITION BY league, entity ORDER BY rn
   ROWS BETWEEN 400 PRECEDING AND 1 PRECEDING) AS xs FROM r)
SELECT {ID}, ROUND(COALESCE(list_sum(list_transform(xs, lambda x, i: 0.45 * x * pow(0.65, len(xs) - i))), 0.0) + 1e-11, 8) AS bp3,
 ROUND(COALESCE(list_sum(list_transform(xs, lambda x, i: 0.20 * x * pow(0.88, len(xs) - i))), 0.0) + 1e-11, 8) AS bp7 FROM l WHERE {FIRST}""")
def _(v: Views):
    x = F.greatest(F.lit(0.0), F.col("ga") - 3.0)
    out = T.decayed_load(v.entity_rows, x, {"bp3": (0.65, 0.45), "bp7": (0.88, 0.20)})
    # short decimal expansions fall exactly on rounding ties; the offset (also in the SQL) moves both sides off them
    return us(out.withColumns({c: F.col(c) + 1e-11 for c in ("bp3", "bp7")}), digits=8)


def _vt(m: str) -> str:
    n = over(f"count({m})", 20)
    return (f"ROUND(CASE WHEN {n} >= 2 THEN {over(f'stddev_pop({m})', 20)} ELSE 0.0 END, 6) AS {m}_sd_20, "
            f"ROUND(CASE WHEN {n} >= 4 THEN (count({m}) OVER w * sum(CAST(rn * {m} AS DOUBLE)) OVER w - sum(CAST(rn AS DOUBLE)) OVER w * sum(CAST({m} AS DOUBLE)) OVER w) / "
            f"(count({m}) OVER w * sum(CAST(rn * rn AS DOUBLE)) OVER w - pow(sum(CAST(rn AS DOUBLE)) OVER w, 2)) ELSE 0.0 END, 6) + 0.0 AS {m}_slope_20")


@register("w13_volatility_trend", f"""WITH {NUM}, f AS (SELECT *, {_vt('gf')}, {_vt('ga')} FROM r
WINDOW w AS (PARTITION BY league, entity ORDER BY rn ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT {ID}, gf_sd_20, gf_slope_20, ga_sd_20, ga_slope_20 FROM f WHERE {FIRST}""")
def _(v: Views):
    return us(T.volatility_trend(v.entity_rows, ["gf", "ga"]), digits=6)


STARTER = {"era": "CASE WHEN k3 % 6 > 0 THEN ga * 9.0D / (1 + k2 % 7) END", "k9": "double(k1 % 13)"}
STARTER_SQL = "CASE WHEN k3 % 6 > 0 THEN ga * CAST(9.0 AS DOUBLE) / (1 + k2 % 7) END AS era, CAST(k1 % 13 AS DOUBLE) AS k9"


def _starters(v: Views):
    return v.entity_rows.withColumns({c: F.expr(e) for c, e in STARTER.items()})


def _ew(m: str, empty: float) -> str:
    return (f"ROUND(COALESCE(list_sum(list_transform(x_{m}, lambda x, i: x * exp((i - len(x_{m})) / 18.0))) / "
            f"NULLIF(list_sum(list_transform(x_{m}, lambda x, i: CASE WHEN x IS NOT NULL THEN exp((i - len(x_{m})) / 18.0) END)), 0), {empty}), 8) AS {m}_ew, "
            f"ROUND(COALESCE(a_{m}, {empty}), 8) AS {m}_recent, ROUND(COALESCE(s_{m}, 0.0), 6) AS {m}_recent_sd")


@register("w14_exp_weighted_mean", f"""WITH r AS (SELECT *, {STARTER_SQL}, row_number() OVER w AS rn, lag(ts) OVER w AS prev_ts FROM entity_rows
  WINDOW w AS (PARTITION BY league, entity ORDER BY ts, game_id)),
l AS (SELECT *, {', '.join(f"list({m}) OVER (PARTITION BY league, entity ORDER BY rn ROWS BETWEEN 600 PRECEDING AND 1 PRECEDING) AS x_{m}, {over(f'avg({m})', 5)} AS a_{m}, list_aggregate({over(f'list({m})', 5)}, 'stddev_pop') AS s_{m}" for m in STARTER)} FROM r)
SELECT {ID}, rn - 1 AS n_prior, {_ew('era', 4.0)}, {_ew('k9', 7.5)} FROM l WHERE {FIRST}""")
def _(v: Views):
    out = T.exp_weighted(_starters(v), {"era": 4.0, "k9": 7.5}, 18.0)
    sds = {c: F.round(c, 6) for c in ("era_recent_sd", "k9_recent_sd")}
    return us(out.withColumns(sds), digits=8)


@register("w15_recent_slope", f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY league, entity ORDER BY ts, game_id) AS rn
  FROM (SELECT *, {STARTER_SQL} FROM entity_rows) WHERE era IS NOT NULL),
s AS (SELECT league, entity, ts, rn, CASE WHEN count(*) OVER w >= 3 THEN regr_slope(era, CAST(rn AS DOUBLE)) OVER w ELSE 0.0 END AS slope FROM k
  WINDOW w AS (PARTITION BY league, entity ORDER BY rn ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
z AS (SELECT league, entity, ts, arg_max(slope, rn) AS slope FROM s GROUP BY ALL),
d AS (SELECT DISTINCT league, entity, ts FROM entity_rows)
SELECT d.league, d.entity, CAST(epoch_us(d.ts) AS BIGINT) AS ts_us, ROUND(COALESCE(z.slope, 0.0), 6) + 0.0 AS era_slope
FROM d ASOF LEFT JOIN z ON d.league = z.league AND d.entity = z.entity AND d.ts > z.ts""")
def _(v: Views):
    return us(T.tail_slope(_starters(v), "era"), digits=6)


@register("w16_ew_team_runs", f"""WITH {NUM}, l AS (SELECT *, list(CAST(gf AS DOUBLE)) OVER w AS xf, list(CAST(ga AS DOUBLE)) OVER w AS xa FROM r
  WINDOW w AS (PARTITION BY league, entity ORDER BY rn ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT {ID}, {', '.join(f"ROUND(list_sum(list_transform({x}, lambda v, i: v * exp(-2.2 + CASE WHEN len({x}) > 1 THEN 2.2 / (len({x}) - 1) ELSE 0 END * (i - 1)))) / list_sum(list_transform({x}, lambda v, i: exp(-2.2 + CASE WHEN len({x}) > 1 THEN 2.2 / (len({x}) - 1) ELSE 0 END * (i - 1)))), 9) AS {n}" for x, n in (('xf', 'ew_for'), ('xa', 'ew_against')))}
FROM l WHERE {FIRST}""")
def _(v: Views):
    return us(T.ew_team_runs(v.entity_rows))


@register("w19_lagged_entity_features", f"""WITH {NUM}, l AS (SELECT *, {', '.join(f"ROUND(COALESCE({over(f'avg({m})', 5)}, 0.0), 9) AS lag_{m}" for m in ('gf', 'ga'))} FROM r)
SELECT game_id, {', '.join(f"MAX(CASE WHEN side = '{s}' THEN lag_{m} END) AS {p}_lag_{m}" for s, p in (('H', 'home'), ('A', 'away')) for m in ('gf', 'ga'))},
'UNVERIFIED' AS tracking_pit_status, FALSE AS historical_backtest_eligible FROM l GROUP BY game_id""")
def _(v: Views):
    return us(T.lagged_entity_features(v.entity_rows, ["gf", "ga"]))


@register("w20_match_features", f"""WITH {NUM}, f AS (SELECT *, {', '.join(f"COALESCE({over(f'avg({c})', 10)}, {d}) AS {c}_10" for c, d in (('pts', 1.0), ('gf', 0.0), ('ga', 0.0)))} FROM r),
z AS (SELECT league, entity, ts, pts_10, gf_10, ga_10 FROM f WHERE {FIRST})
SELECT game_id, 1.0::DOUBLE AS home_adv, {', '.join(f"ROUND(h.{c}_10, 9) AS h_{c}_10, ROUND(a.{c}_10, 9) AS a_{c}_10, ROUND(h.{c}_10 - a.{c}_10, 9) + 0.0 AS d_{c}_10" for c in ('pts', 'gf', 'ga'))},
ROUND(GREATEST(0.5, LEAST(12.0, 0.5 * (h.gf_10 + a.gf_10 + h.ga_10 + a.ga_10))), 9) AS expected_env
FROM games g JOIN z h ON h.league = g.league AND h.entity = g.home AND h.ts = g.ts JOIN z a ON a.league = g.league AND a.entity = g.away AND a.ts = g.ts""")
def _(v: Views):
    form = T.rolling_form(v.entity_rows, (10,))
    out = T.match_features(v.games, form, ["pts_10", "gf_10", "ga_10"])
    return us(out.select("game_id", "home_adv", *[f"{p}_{c}_10" for c in ("pts", "gf", "ga") for p in "had"], "expected_env"))


@register("w21_context_gate", """SELECT event_id, COALESCE(source_timestamp <= prediction_cutoff AND available_at <= prediction_cutoff, FALSE) AS context_pit_safe
FROM (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN prediction_cutoff - INTERVAL 20 HOUR ELSE prediction_cutoff END AS prediction_cutoff) FROM ledger)""")
def _(v: Views):
    led = v.ledger.withColumn("prediction_cutoff", F.expr("CASE WHEN event_id % 3 = 0 THEN prediction_cutoff - INTERVAL 20 HOURS ELSE prediction_cutoff END"))
    return T.context_gate(led, "prediction_cutoff", ["source_timestamp", "available_at"]).select("event_id", "context_pit_safe")


@register("w27_team_strength", """WITH l AS (SELECT *, pow(2.0, epoch_us(ts) / 86400e6 / 90.0) AS s FROM entity_rows),
own AS (SELECT league, entity, ts, SUM(SUM(gf * s)) OVER w AS sgf, SUM(SUM(ga * s)) OVER w AS sga, SUM(SUM(s)) OVER w AS sn FROM l GROUP BY league, entity, ts
  WINDOW w AS (PARTITION BY league, entity ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lg AS (SELECT league, ts, SUM(SUM(gf * s)) OVER w AS runs, SUM(SUM(s)) OVER w AS wt FROM l GROUP BY league, ts
  WINDOW w AS (PARTITION BY league ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT own.*, pow(2.0, -(epoch_us(own.ts) / 86400e6 / 90.0)) AS d, CASE WHEN wt > 0 THEN GREATEST(0.1, runs / wt) ELSE 4.0 END AS m FROM own JOIN lg USING (league, ts))
SELECT league, entity, CAST(epoch_us(ts) AS BIGINT) AS ts_us,
 ROUND(GREATEST(0.60, LEAST(1.55, (COALESCE(sgf, 0) * d + 24.0 * m) / (COALESCE(sn, 0) * d + 24.0) / m)), 7) AS offense,
 ROUND(GREATEST(0.60, LEAST(1.55, (COALESCE(sga, 0) * d + 24.0 * m) / (COALESCE(sn, 0) * d + 24.0) / m)), 7) AS defense FROM j""")
def _(v: Views):
    return us(T.team_strength(v.entity_rows), digits=7)


@register("w28_prediction_dynamics", """WITH r AS (SELECT *, row_number() OVER w AS rn, CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 0 WHEN p_draw >= p_away THEN 1 ELSE 2 END AS top,
  lag(p_home) OVER w AS h1, lag(p_draw) OVER w AS d1, lag(p_away) OVER w AS a1, lag(p_home, 2) OVER w AS h2, lag(p_draw, 2) OVER w AS d2, lag(p_away, 2) OVER w AS a2
  FROM probs WINDOW w AS (PARTITION BY league ORDER BY ts, game_id)),
s AS (SELECT *, COALESCE(abs(p_home - h1) + abs(p_draw - d1) + abs(p_away - a1), 0.0) AS velocity,
  COALESCE(abs(h1 - h2) + abs(d1 - d2) + abs(a1 - a2), 0.0) AS pv,
  CASE WHEN rn > 1 AND top <> lag(top) OVER (PARTITION BY league ORDER BY rn) THEN 1.0 ELSE 0.0 END AS flip,
  (p_home - h1) * (h1 - h2) + (p_draw - d1) * (d1 - d2) + (p_away - a1) * (a1 - a2) AS turn FROM r)
SELECT game_id, ROUND(velocity, 8) AS velocity, ROUND(CASE WHEN rn > 2 THEN velocity - pv ELSE 0.0 END, 8) + 0.0 AS acceleration, CAST(flip AS DOUBLE) AS flip,
 CASE WHEN rn > 2 AND turn < 0 THEN 1.0::DOUBLE ELSE 0.0 END AS reversal, ROUND(avg(1.0 - flip) OVER (PARTITION BY league ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 8) AS persistence FROM s""")
def _(v: Views):
    df = v.probs.select("game_id", "ts", "league", A.vec("p_home", "p_draw", "p_away").alias("p"))
    out = T.prediction_dynamics(df, "p", ["league"], ["ts", "game_id"])
    return us(out.select("game_id", "velocity", "acceleration", "flip", "reversal", "persistence"), digits=8)


HOURLY = "h AS (SELECT source, date_trunc('hour', retrieved_at) AS hour, count(*) AS n FROM ledger GROUP BY ALL)"


@register("w29_information_shock", f"""WITH {HOURLY}, o AS (SELECT *, row_number() OVER w AS rn, first_value(n) OVER w AS x0, lag(n) OVER w AS prev FROM h
  WINDOW w AS (PARTITION BY source ORDER BY hour)),
m AS (SELECT *, CASE WHEN count(n) OVER w >= 2 THEN quantile_cont(CAST(n AS DOUBLE), 0.5) OVER w END AS med FROM o
  WINDOW w AS (PARTITION BY source ORDER BY rn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, abs(prev - med) AS dev FROM m),
a AS (SELECT *, CASE WHEN count(dev) OVER w >= 2 THEN quantile_cont(dev, 0.5) OVER w END AS mad FROM d
  WINDOW w AS (PARTITION BY source ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, abs((n - COALESCE(med, x0)) / GREATEST(COALESCE(1.4826 * mad, 1.0), 1e-6)) AS z FROM a)
SELECT source, CAST(epoch_us(hour) AS BIGINT) AS hour_us, n, ROUND(z, 5) AS event_rate_z, ROUND(LEAST(z / 4.0, 1.0), 5) AS shock_score,
 CASE WHEN z >= 4.0 THEN 1 ELSE 0 END AS information_shock FROM z""")
def _(v: Views):
    hourly = v.ledger.groupBy("source", F.date_trunc("hour", "retrieved_at").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    out = us(T.information_shock(hourly, "n", ["source"], ["hour"]), digits=5)
    return out.withColumn("hour_us", F.unix_micros("hour")).drop("hour")


TRANS = """t AS (SELECT event_type AS state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_state FROM events),
s AS (SELECT DISTINCT state FROM t), c AS (SELECT state, next_state, count(*) AS n FROM t WHERE next_state IS NOT NULL GROUP BY ALL),
g AS (SELECT a.state, b.state AS next_state, COALESCE(n, 0) AS n, (SELECT count(*) FROM s) AS k FROM s a CROSS JOIN s b
  LEFT JOIN c ON c.state = a.state AND c.next_state = b.state),
p AS (SELECT state, next_state, n, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY state) AS p, (n + 1.0) / (SUM(n) OVER (PARTITION BY state) + k) AS p_laplace FROM g)"""


def _transitions(v: Views):
    return T.regime_transitions(v.table("events"), "event_type", ["user_id"], ["ts", "event_id"])


@register("w32_regime_transitions", f"WITH {TRANS} SELECT state, next_state, CAST(n AS BIGINT) AS n, ROUND(p, 9) AS p, ROUND(p_laplace, 9) AS p_laplace FROM p")
def _(v: Views):
    return us(_transitions(v))


@register("w32_regime_forecast", f"""WITH {TRANS}, a AS (SELECT next_state AS s, p FROM p WHERE state = 'view'),
b2 AS (SELECT p.next_state AS s, SUM(a.p * p.p) AS p FROM a JOIN p ON p.state = a.s GROUP BY 1),
b3 AS (SELECT p.next_state AS s, SUM(b2.p * p.p) AS p FROM b2 JOIN p ON p.state = b2.s GROUP BY 1)
SELECT s AS state, ROUND(p, 9) AS p FROM b3""")
def _(v: Views):
    return us(T.regime_forecast(_transitions(v), "view", 3))


@register("w33_router_stability", """WITH r AS (SELECT league, ts, game_id, (k1 % 5) + 0.0 AS a, (k2 % 4) + 1.0 AS b, CASE WHEN k3 % 2 = 0 THEN k3 % 3 ELSE 0 END + 0.0 AS c FROM games),
u AS (SELECT league, ts, game_id, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM r),
s AS (SELECT league, CAST(GREATEST(a, b, c) AS DOUBLE) AS top, CAST(0.5 * (abs(a - lag(a) OVER w) + abs(b - lag(b) OVER w) + abs(c - lag(c) OVER w)) AS DOUBLE) AS step FROM u
  WINDOW w AS (PARTITION BY league ORDER BY ts, game_id))
SELECT league, ROUND(avg(step), 9) AS mean_weight_velocity, ROUND(max(step), 9) AS max_weight_velocity, ROUND(avg(top), 9) AS concentration,
 ROUND(GREATEST(0.0, LEAST(1.0, (avg(top) - 0.85) / 0.15)), 9) AS collapse FROM s GROUP BY league""")
def _(v: Views):
    w = F.expr("map_filter(map('a', double(k1 % 5), 'b', k2 % 4 + 1D, 'c', CASE WHEN k3 % 2 = 0 THEN double(k3 % 3) END), (k, x) -> x IS NOT NULL)")
    return us(T.router_stability(v.games.withColumn("w", w), "w", ["league"], ["ts", "game_id"]))


@register("w35_top_draw_per_day", """WITH d AS (SELECT *, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day FROM probs),
r AS (SELECT *, row_number() OVER (PARTITION BY league, day ORDER BY p_draw DESC, game_id DESC) AS rk FROM d)
SELECT league, strftime(day, '%Y-%m-%d') AS day, game_id, ROUND(p_draw, 9) AS p_draw, y FROM r WHERE rk = 1""")
def _(v: Views):
    out = T.top_per_day(v.probs.select("league", "ts", "game_id", "p_draw", "y"), "p_draw", local_date(F.col("ts"), "Asia/Tokyo"), keys=["league"])
    return us(out.select("league", F.col("day").cast("string").alias("day"), "game_id", "p_draw", "y"))


@register("w36_recency_weight", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY ts DESC, game_id DESC) - 1 AS age FROM games)
SELECT game_id, ROUND(GREATEST(0.2, LEAST(1.0, exp(-ln(2.0) * age / 1800.0))), 8) AS weight FROM r""")
def _(v: Views):
    return us(T.recency_weight(v.games, ["ts", "game_id"], 1800.0, ["league"]).select("game_id", "weight"), digits=8)
