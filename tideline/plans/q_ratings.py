"""Queries over the rating operators."""

from pyspark.sql import functions as F

from tideline.operators import ratings as R
from tideline.plans.catalog import register
from tideline.plans.q_timeline import us
from tideline.plans.views import Views
from tideline.session import stored


def fold_sql(k: float, adv: float, margin: float, keep: float, body: str) -> str:
    """The plain fold, one game of each league a step: x ratings by entity number, fz as frozen at the instant in st."""
    return f"""WITH RECURSIVE n AS (SELECT league, e, row_number() OVER (PARTITION BY league ORDER BY e) AS i FROM (SELECT DISTINCT league, unnest([home, away]) AS e FROM games)),
m AS (SELECT league, CAST(max(i) AS INT) AS m FROM n GROUP BY league),
g AS MATERIALIZED (SELECT games.league, game_id, CAST(row_number() OVER w AS INT) AS r, epoch_us(ts) AS t, h.i AS h, a.i AS a, CASE WHEN home_score > away_score THEN 1.0::DOUBLE WHEN home_score = away_score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS res,
  {k}::DOUBLE * (1.0::DOUBLE + {margin}::DOUBLE * ln(1.0::DOUBLE + abs(home_score - away_score))) AS k, CASE WHEN year(ts) <> lag(year(ts)) OVER w THEN {keep}::DOUBLE ELSE 1.0::DOUBLE END AS keep
  FROM games JOIN n h ON h.league = games.league AND h.e = home JOIN n a ON a.league = games.league AND a.e = away WINDOW w AS (PARTITION BY games.league ORDER BY ts, game_id)),
f(league, r, x, fz, st, game_id, elo_home, elo_away, frozen_home, frozen_away, expected_home) AS (
  SELECT league, 0, list_transform(range(m), lambda z: 1500.0::DOUBLE), list_transform(range(m), lambda z: 1500.0::DOUBLE), list_transform(range(m), lambda z: -9223372036854775807), NULL::VARCHAR, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM m
  UNION ALL
  SELECT league, r, list_transform(x, lambda v, i: CASE WHEN i = h THEN v + k * (res - p) WHEN i = a THEN v - k * (res - p) ELSE v END), fz,
    list_transform(st, lambda v, i: CASE WHEN i = h OR i = a THEN t ELSE v END), game_id, x[h], x[a], fz[h], fz[a], p
  FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + pow(10.0::DOUBLE, -(x[h] + {adv}::DOUBLE - x[a]) / 400.0::DOUBLE)) AS p, list_transform(old, lambda v, i: CASE WHEN (i = h OR i = a) AND st[i] <> t THEN x[i] ELSE v END) AS fz
    FROM (SELECT f.league, g.r, g.game_id, g.t, g.h, g.a, g.res, g.k, f.fz AS old, f.st, CASE WHEN g.keep = 1.0 THEN f.x ELSE list_transform(f.x, lambda v: 1500.0::DOUBLE + g.keep * (v - 1500.0::DOUBLE)) END AS x FROM f JOIN g ON g.league = f.league AND g.r = f.r + 1)))
{body}"""


RATED = ", ".join(f"ROUND({c}, 6) AS {c}" for c in ("elo_home", "elo_away", "frozen_home", "frozen_away", "expected_home"))


@register("w17_elo", fold_sql(20, 25, 0.35, 0.2, f"SELECT game_id, {RATED} FROM f WHERE r > 0"))
def _(v: Views):
    return us(R.elo(v.games), digits=6)


@register("w18_elo_simple", fold_sql(24, 25, 0, 1, "SELECT game_id, ROUND(elo_home, 6) AS elo_home, ROUND(elo_away, 6) AS elo_away, ROUND(expected_home, 6) AS expected_home FROM f WHERE r > 0"))
def _(v: Views):
    return us(R.elo_simple(v.games).select("game_id", "elo_home", "elo_away", "expected_home"), digits=6)


@register("e11_elo_baseline", fold_sql(24, 25, 0, 1, """SELECT league, count(*) AS n_samples, ROUND(avg(hit), 6) AS elo_accuracy, ROUND(avg(win), 6) AS base_rate, ROUND(avg(hit) - avg(win), 6) AS elo_improvement
FROM (SELECT f.league, CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS win, CASE WHEN (expected_home > 0.5) = (home_score > away_score) THEN 1 ELSE 0 END AS hit FROM f JOIN games USING (game_id) WHERE r > 0) GROUP BY league"""))
def _(v: Views):
    from tideline.operators.evaluate import baseline_vs_base_rate

    win = (F.col("home_score") > F.col("away_score")).cast("int")
    rated = R.elo_simple(v.games, carry=("league", "home_score", "away_score")).select("game_id", "league", "expected_home", win.alias("win"))
    # an id that several games share meets each of them; there are few of these, found by their hashes
    same = F.xxhash64("game_id") == F.col("_h")
    shared = stored(v.games.groupBy(F.xxhash64("game_id").alias("_h")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h"), "shared")
    if not shared.isEmpty():
        wins = v.games.join(shared, same, "left_semi").groupBy("game_id").agg(F.collect_list(win).alias("_wins"))
        rated = rated.join(wins, "game_id", "left").withColumn("win", F.explode(F.coalesce("_wins", F.array("win"))))
    return us(baseline_vs_base_rate(rated, F.col("expected_home"), F.col("win"), ["league"]), digits=6)
