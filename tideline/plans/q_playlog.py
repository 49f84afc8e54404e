"""Queries over the play-by-play operators."""

from pyspark.sql import functions as F

from tideline.operators import playlog as P
from tideline.plans.catalog import register
from tideline.plans.q_timeline import us
from tideline.plans.views import Views

SEG = "inning"
ORDER = ["play_order"]
OK = """g AS (SELECT game_id, MAX(CASE WHEN added_runs < 0 OR added_runs > 4 THEN 1 ELSE 0 END) AS bad, arg_min(added_runs, play_order) AS first_runs,
  SUM(CASE WHEN half = 'B' THEN added_runs ELSE 0 END) AS h, SUM(CASE WHEN half = 'T' THEN added_runs ELSE 0 END) AS a,
  arg_max(home_total, play_order) AS fh, arg_max(away_total, play_order) AS fa FROM plays GROUP BY 1),
st AS (SELECT p.*, CAST(SUM(CASE WHEN half = 'B' THEN added_runs ELSE 0 END) OVER w AS BIGINT) AS state_home, CAST(SUM(CASE WHEN half = 'T' THEN added_runs ELSE 0 END) OVER w AS BIGINT) AS state_away
  FROM plays p SEMI JOIN (SELECT game_id FROM g WHERE bad = 0 AND first_runs = 0 AND h = fh AND a = fa) k USING (game_id)
  WINDOW w AS (PARTITION BY game_id ORDER BY play_order ROWS UNBOUNDED PRECEDING))"""


def _states(v: Views):
    return P.state_scores(v.plays, ORDER, F.col(SEG))


@register("w22_state_scores", f"WITH {OK} SELECT game_id, play_order, state_home, state_away FROM st")
def _(v: Views):
    return _states(v).select("game_id", "play_order", "state_home", "state_away")


MOVES = f"""{OK}, l AS (SELECT *, lead(inning) OVER w AS ni, lead(half) OVER w AS nh, lead(outs) OVER w AS no, lead(bases) OVER w AS nb, lead(balls) OVER w AS nbl, lead(strikes) OVER w AS ns,
  lead(state_home) OVER w - state_home AS dh, lead(state_away) OVER w - state_away AS da FROM st WINDOW w AS (PARTITION BY game_id ORDER BY play_order)),
mv AS (SELECT game_id, CASE WHEN inning <= 3 THEN 1 WHEN inning <= 6 THEN 2 WHEN inning <= 9 THEN 3 ELSE 4 END AS band, half, outs, bases,
  CAST(GREATEST(-8, LEAST(8, state_home - state_away)) AS INT) AS diff, balls, strikes,
  concat_ws('|', nh, no, nb, nbl, ns, dh + da, CASE WHEN dh > 0 THEN 'H' WHEN da > 0 THEN 'A' ELSE 'N' END) AS outcome FROM l
  WHERE ni IS NOT NULL AND CASE WHEN ni = inning AND nh = half THEN no - outs BETWEEN 0 AND 2
     WHEN (ni = inning AND half = 'T' AND nh = 'B') OR (half = 'B' AND nh = 'T' AND ni = inning + 1) THEN no = 0 AND nb = 0 ELSE FALSE END
   AND dh BETWEEN 0 AND 4 AND da BETWEEN 0 AND 4 AND NOT (dh > 0 AND da > 0))"""


def _moves(v: Views):
    return P.transitions(_states(v), ORDER, F.col(SEG), dense="play_order")


@register("w23_transitions", f"WITH {MOVES} SELECT * FROM mv")
def _(v: Views):
    return _moves(v)


@register("w24_state_keys", """SELECT game_id, play_order, CASE WHEN inning <= 3 THEN 1 WHEN inning <= 6 THEN 2 WHEN inning <= 9 THEN 3 ELSE 4 END AS band,
 CAST(GREATEST(-8, LEAST(8, home_total - away_total)) AS INT) AS diff, (CASE WHEN k1 % 2 = 1 THEN 1 ELSE 0 END) + (CASE WHEN k1 % 3 > 0 THEN 2 ELSE 0 END) + (CASE WHEN k2 % 2 = 1 THEN 4 ELSE 0 END) AS mask FROM plays""")
def _(v: Views):
    b1 = F.expr("CASE WHEN k1 % 2 = 1 THEN 'runner' ELSE ' 0.0' END")
    b2 = F.expr("CASE WHEN k1 % 3 = 0 THEN 'NaN' WHEN k1 % 3 = 1 THEN '17' ELSE '1.5' END")
    b3 = F.expr("CASE WHEN k2 % 2 = 1 THEN 'true' ELSE 'False' END")
    return v.plays.select("game_id", "play_order", P.inning_band(F.col("inning")).alias("band"), P.score_diff(F.col("home_total"), F.col("away_total")).alias("diff"),
                          P.base_mask(b1, b2, b3).alias("mask"))


GS = " UNION ALL ".join(
    f"SELECT '{k}' AS view, {', '.join(c if c in cols else ('CAST(NULL AS VARCHAR) AS ' if c == 'half' else 'CAST(NULL AS INT) AS ') + c for c in P.STATE)}, outcome, count(*) AS n FROM mv GROUP BY ALL"
    for k, cols in P.VIEWS.items())


@register("a13_transition_counts", f"WITH {MOVES} {GS}")
def _(v: Views):
    return P.transition_counts(_moves(v))


KEY = "view || '|' || " + " || '|' || ".join(f"COALESCE(CAST({c} AS VARCHAR), '*')" for c in P.STATE)

def _kernel_sql() -> str:
    joins, picks, fall = [], [], []
    for i, (name, cols) in enumerate(P.VIEWS.items()):
        key = f"'{name}' || '|' || " + " || '|' || ".join(f"CAST(s.{c} AS VARCHAR)" if c in cols else "'*'" for c in P.STATE)
        joins.append(f"LEFT JOIN e e{i} ON e{i}.key = {key}")
        picks.append((i, name))
    case = lambda f: "CASE " + " ".join(f"WHEN e{i}.support >= 24 THEN {f(i, n)}" for i, n in picks) + " " + " ".join(f"WHEN e{i}.support IS NOT NULL THEN {f(i, n)}" for i, n in picks) + " END"
    return f"""WITH {MOVES}, c AS ({GS}), q AS (SELECT *, {KEY} AS key FROM c), z AS (SELECT key, SUM(n) AS support, count(*) AS outcomes FROM q GROUP BY 1),
e AS (SELECT key, any_value(support) AS support, any_value(outcomes) AS outcomes, SUM(-((n + 0.5) / (support + 0.5 * outcomes)) * ln((n + 0.5) / (support + 0.5 * outcomes))) AS entropy FROM q JOIN z USING (key) GROUP BY 1),
s AS (SELECT DISTINCT {', '.join(P.STATE)} FROM mv)
SELECT {', '.join('s.' + c for c in P.STATE)}, {case(lambda i, n: f"'{n}'")} AS view, CAST({case(lambda i, n: f'e{i}.support')} AS BIGINT) AS support,
CAST({case(lambda i, n: f'e{i}.outcomes')} AS BIGINT) AS outcomes, ROUND({case(lambda i, n: f'e{i}.entropy')}, 8) AS entropy FROM s {' '.join(joins)}"""


@register("a14_kernel_probability", _kernel_sql())
def _(v: Views):
    moves = _moves(v)
    return us(P.kernel_probability(moves.select(*P.STATE).distinct(), P.transition_counts(moves)), digits=8)


HALVES = f"""{OK}, i AS (SELECT *, CASE WHEN lag(inning) OVER w IS NULL OR lag(inning) OVER w <> inning OR lag(half) OVER w <> half THEN 1 ELSE 0 END AS new FROM st WINDOW w AS (PARTITION BY game_id ORDER BY play_order)),
j AS (SELECT *, SUM(new) OVER (PARTITION BY game_id ORDER BY play_order ROWS UNBOUNDED PRECEDING) AS island FROM i),
r AS (SELECT game_id, island, MIN(inning) AS inning, MIN(half) AS half, count(*) AS plays, arg_max(state_home, play_order) AS end_home, arg_max(state_away, play_order) AS end_away FROM j GROUP BY ALL),
hv AS (SELECT *, COALESCE(lag(end_home) OVER (PARTITION BY game_id ORDER BY island), 0) AS start_home, COALESCE(lag(end_away) OVER (PARTITION BY game_id ORDER BY island), 0) AS start_away FROM r),
h AS (SELECT game_id, CAST(island AS BIGINT) AS island, inning, half, plays, start_home, start_away, end_home, end_away, CASE WHEN half = 'T' THEN end_away - start_away ELSE end_home - start_home END AS runs,
 CASE WHEN half = 'T' THEN start_away - start_home ELSE start_home - start_away END AS score_diff_for FROM hv)"""


def _halves(v: Views):
    return P.half_innings(_states(v), ORDER, F.col(SEG), dense="play_order")


@register("w25_half_innings", f"WITH {HALVES} SELECT * FROM h")
def _(v: Views):
    return _halves(v)


@register("w26_game_table", f"""WITH {HALVES}, t AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY inning DESC, half) AS rk FROM h)
SELECT game_id, end_home AS actual_home, end_away AS actual_away, CASE WHEN end_home > end_away THEN 0 WHEN end_home = end_away THEN 1 ELSE 2 END AS actual_class FROM t WHERE rk = 1""")
def _(v: Views):
    return P.game_table(_halves(v))


TEAMS = "x AS (SELECT h.*, CAST(CASE WHEN half = 'T' THEN (game_id * 7 + 3) % 30 ELSE game_id % 30 END AS INT) AS offense, CAST(CASE WHEN half = 'T' THEN game_id % 30 ELSE (game_id * 7 + 3) % 30 END AS INT) AS defense, CAST(GREATEST(-3, LEAST(3, score_diff_for)) AS INT) AS bucket FROM h)"
RATES = f"""{HALVES}, {TEAMS}, mm AS (SELECT avg(runs) AS m FROM x),
rt AS (""" + " UNION ALL ".join(
    f"SELECT '{k}' AS view, {key} AS key, count(*) AS n, {'avg(runs)' if k == 'league' else '(SUM(runs) + 12.0 * (SELECT m FROM mm)) / (count(*) + 12.0)'} AS rate FROM x GROUP BY ALL"
    for k, key in (("inning_half", "inning || ':' || half"), ("offense", "CAST(offense AS VARCHAR)"), ("defense", "CAST(defense AS VARCHAR)"), ("score_state", "CAST(bucket AS VARCHAR)"), ("league", "''"))) + ")"


def _teamed(v: Views):
    home, away = F.expr("int(game_id % 30)"), F.expr("int((game_id * 7 + 3) % 30)")
    top = F.col("half") == "T"
    return _halves(v).withColumns({"offense": F.when(top, away).otherwise(home), "defense": F.when(top, home).otherwise(away)})


@register("a15_shrunk_run_rates", f"WITH {RATES} SELECT view, key, n, ROUND(rate, 9) AS rate FROM rt")
def _(v: Views):
    return us(P.shrunk_run_rates(_teamed(v)))


@register("a29_half_rate", f"""WITH {RATES}, lm AS (SELECT GREATEST(rate, 0.03) AS m, rate AS raw FROM rt WHERE view = 'league')
SELECT game_id, island, ROUND(GREATEST(0.03, LEAST(4.0, GREATEST(COALESCE(a.rate, raw), 0.03) * exp(0.60 * ln(GREATEST(COALESCE(b.rate, m), 0.03) / m) + 0.55 * ln(GREATEST(COALESCE(c.rate, m), 0.03) / m)
 + 0.20 * ln(GREATEST(COALESCE(d.rate, m), 0.03) / m)))), 8) AS half_rate FROM x CROSS JOIN lm LEFT JOIN rt a ON a.view = 'inning_half' AND a.key = inning || ':' || half
LEFT JOIN rt b ON b.view = 'offense' AND b.key = CAST(offense AS VARCHAR) LEFT JOIN rt c ON c.view = 'defense' AND c.key = CAST(defense AS VARCHAR)
LEFT JOIN rt d ON d.view = 'score_state' AND d.key = CAST(bucket AS VARCHAR)""")
def _(v: Views):
    halves = _teamed(v)
    return us(P.half_rate(halves, P.shrunk_run_rates(halves)).select("game_id", "island", "half_rate"), digits=8)


@register("a1_aggregate_games", """WITH p AS (SELECT *, CASE WHEN k1 % 4 = 0 THEN NULL ELSE home_total + position END AS ht FROM plays),
b AS (SELECT game_id, arg_min(home, play_order) AS home, arg_min(away, play_order) AS away, arg_min(game_date, play_order) AS d, arg_max(ht, play_order) FILTER (ht IS NOT NULL) AS home_score, arg_max(away_total, play_order) AS away_score,
  GREATEST(0, count(DISTINCT CASE WHEN half = 'B' THEN pitcher_id END) - 1) AS home_bullpen_apps, GREATEST(0, count(DISTINCT CASE WHEN half = 'T' THEN pitcher_id END) - 1) AS away_bullpen_apps FROM p GROUP BY 1)
SELECT game_id, home, away, CAST(epoch_us(d) AS BIGINT) AS date_us, CAST(COALESCE(home_score, -1) AS INT) AS home_score, away_score, home_bullpen_apps, away_bullpen_apps FROM b""")
def _(v: Views):
    out = P.aggregate_games(v.plays.withColumn("home_total", F.expr("CASE WHEN k1 % 4 = 0 THEN NULL ELSE home_total + position END")), ORDER)
    return out.select("game_id", "home", "away", F.unix_micros("game_date").alias("date_us"), F.coalesce("home_score", F.lit(-1)).alias("home_score"), "away_score",
                      "home_bullpen_apps", "away_bullpen_apps")


@register("a2_reconstruct_score", "SELECT game_id, CAST(SUM(CASE WHEN half = 'B' THEN added_runs ELSE 0 END) AS BIGINT) AS home_score, CAST(SUM(CASE WHEN half = 'T' THEN added_runs ELSE 0 END) AS BIGINT) AS away_score FROM plays GROUP BY 1")
def _(v: Views):
    return P.reconstruct_score(v.plays)


@register("a2_score_from_text", """SELECT game_id, CAST(COALESCE(MAX(CASE WHEN half = 'B' AND k1 % 3 > 0 THEN added_runs END), 0) AS DOUBLE) AS home_score,
 CAST(COALESCE(MAX(CASE WHEN half = 'T' AND k1 % 3 > 0 THEN added_runs END), 0) AS DOUBLE) AS away_score FROM plays GROUP BY 1""")
def _(v: Views):
    text = F.expr("CASE k1 % 3 WHEN 0 THEN concat('no score ', added_runs) WHEN 1 THEN concat('single, RUNS: ', added_runs) ELSE concat('得点=', added_runs) END")
    return P.score_from_text(v.plays.withColumn("text", text), "text", "half")


@register("a3_first_pitchers", "SELECT game_id, arg_min(CASE WHEN half = 'T' THEN pitcher_id END, CASE WHEN half = 'T' THEN play_order END) AS home_first, arg_min(CASE WHEN half = 'B' THEN pitcher_id END, CASE WHEN half = 'B' THEN play_order END) AS away_first FROM plays GROUP BY 1")
def _(v: Views):
    return P.first_pitchers(v.plays, ORDER)


PITCH = "SELECT l_orderkey AS game_id, CASE WHEN l_linenumber % 2 = 0 THEN 'home' ELSE 'away' END AS side, 80 + l_quantity / 2 AS release_speed, CAST(1800 + l_partkey % 900 AS DOUBLE) AS release_spin, l_discount AS pfx_x, l_tax AS pfx_z, CASE WHEN l_partkey % 3 > 0 THEN 60 + l_quantity END AS launch_speed, CAST(l_suppkey % 60 AS DOUBLE) AS launch_angle, l_extendedprice / 190.7 AS hit_distance, CASE WHEN l_partkey % 3 > 0 THEN CAST(1 + l_suppkey % 6 AS INT) END AS launch_speed_angle FROM lineitem"


@register("a4_pitch_game_features", f"""WITH p AS ({PITCH}) SELECT game_id, side, {', '.join(f'ROUND(COALESCE(avg({c}), 0.0), 6) AS {n}_mean' for c, n in (('release_speed', 'velocity'), ('release_spin', 'spin'), ('pfx_x', 'h_break'), ('pfx_z', 'v_break'), ('launch_speed', 'exit_velocity'), ('launch_angle', 'launch_angle'), ('hit_distance', 'hit_distance')))},
 ROUND(COALESCE(SUM(CASE WHEN launch_speed >= 95 THEN 1 ELSE 0 END) / NULLIF(count(launch_speed), 0), 0.0), 6) AS hard_hit_rate, ROUND(COALESCE(SUM(CASE WHEN launch_speed_angle = 6 THEN 1 ELSE 0 END) / NULLIF(count(launch_speed_angle), 0), 0.0), 6) AS barrel_rate,
 CAST(count(*) AS DOUBLE) AS pitch_count FROM p GROUP BY ALL""")
def _(v: Views):
    p = v.table("lineitem").selectExpr(
        "l_orderkey AS game_id", "CASE WHEN l_linenumber % 2 = 0 THEN 'home' ELSE 'away' END AS side", "80 + l_quantity / 2 AS release_speed", "double(1800 + l_partkey % 900) AS release_spin",
        "l_discount AS pfx_x", "l_tax AS pfx_z", "CASE WHEN l_partkey % 3 > 0 THEN 60 + l_quantity END AS launch_speed", "double(l_suppkey % 60) AS launch_angle", "l_extendedprice / 190.7D AS hit_distance",
        "CASE WHEN l_partkey % 3 > 0 THEN int(1 + l_suppkey % 6) END AS launch_speed_angle")
    return us(P.pitch_game_features(p), digits=6)


@register("a16_coverage_counts", "SELECT half, count(*) AS rows, CAST(SUM(CASE WHEN balls < 3 THEN 1 ELSE 0 END) AS BIGINT) AS count_ok, CAST(SUM(CASE WHEN bases > 0 THEN 1 ELSE 0 END) AS BIGINT) AS base_ok FROM plays GROUP BY 1")
def _(v: Views):
    return P.coverage_counts(v.plays, {"count_ok": F.col("balls") < 3, "base_ok": F.col("bases") > 0}, ["half"])


@register("p26_canonicalize_plays", """WITH r AS (SELECT game_id, CASE WHEN k1 % 50 = 0 THEN 13 ELSE inning END AS inning, half, play_order, CASE WHEN k2 % 4 = 0 THEN '' ELSE CAST(play_order // 2 AS VARCHAR) END AS page, added_runs, outs, home_total, away_total, value FROM plays),
v AS (SELECT *, CASE WHEN page <> '' THEN game_id || '|' || page ELSE game_id || '|' || inning || '|' || half || '|' || play_order END AS ident FROM r WHERE inning <= 12),
k AS (SELECT *, row_number() OVER (PARTITION BY game_id, ident ORDER BY inning DESC, half DESC, play_order DESC) AS rk2, row_number() OVER (PARTITION BY game_id, ident ORDER BY inning DESC, CASE WHEN half = 'T' THEN 0 ELSE 1 END DESC, play_order DESC) AS rk FROM v)
SELECT CAST(game_id AS VARCHAR) AS game_id, inning, half, CAST(play_order AS DOUBLE) AS play_order, page, outs, CAST(added_runs AS DOUBLE) AS added_runs FROM k WHERE rk = 1""")
def _(v: Views):
    raw = v.plays.select(
        F.col("game_id").cast("string").alias("GameID"), F.expr("CASE WHEN k1 % 50 = 0 THEN 13 ELSE inning END").alias("Inning"),
        F.expr("CASE WHEN half = 'T' THEN CASE k2 % 3 WHEN 0 THEN 'top' WHEN 1 THEN '表' ELSE ' T ' END ELSE CASE k2 % 3 WHEN 0 THEN 'Bottom' WHEN 1 THEN '裏' ELSE 'bot' END END").alias("Half"),
        F.col("play_order").alias("play_id"), F.expr("CASE WHEN k2 % 4 = 0 THEN ' nan ' ELSE string(play_order div 2) END").alias("fiveDigitSerialNumber"),
        F.col("home").cast("string").alias("H_NameS"), F.col("away").cast("string").alias("V_NameS"), F.col("home_total").alias("H_R"), F.col("away_total").alias("V_R"), F.col("added_runs").alias("addedRuns"), F.col("outs").alias("out"))
    return P.canonicalize_plays(raw).select("game_id", "inning", "half", "play_order", "page", "outs", "added_runs")
