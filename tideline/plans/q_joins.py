"""Queries over the join operators."""

from pyspark.sql import functions as F

from tideline.functions.scalars import local_date
from tideline.operators import joins as J
from tideline.operators import ordered as O
from tideline.plans.catalog import register
from tideline.plans.q_pit import micros
from tideline.plans.q_timeline import us
from tideline.plans.views import MODELS, Views


@register("j1_equi_left", """SELECT o_orderkey, o_totalprice, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def _(v: Views):
    cust = v.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    o = v.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return J.equi_left(o, cust, ["o_custkey"]).drop("o_custkey")


RECON = """p AS (SELECT user_id AS k, count(*) AS n_pred FROM events GROUP BY 1), r AS (SELECT c_custkey * 2 AS k, c_acctbal FROM customer),
m AS (SELECT COALESCE(p.k, r.k) AS k, n_pred, c_acctbal, CASE WHEN p.k IS NULL THEN 'RESULT_ONLY' WHEN r.k IS NULL THEN 'PREDICTION_ONLY' ELSE 'MATCHED' END AS match_status
 FROM p FULL JOIN r ON p.k = r.k)"""


def _reconciled(v: Views):
    p = v.table("events").groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("n_pred"))
    r = v.table("customer").select((F.col("c_custkey") * 2).alias("k"), "c_acctbal")
    return J.reconcile(p, r, ["k"])


@register("j2_reconcile_inner", f"WITH {RECON} SELECT k, n_pred, c_acctbal FROM m WHERE match_status = 'MATCHED'")
def _(v: Views):
    return _reconciled(v).filter("match_status = 'MATCHED'").drop("match_status")


@register("j2_reconcile_unmatched", f"WITH {RECON} SELECT match_status, count(*) AS n FROM m GROUP BY 1")
def _(v: Views):
    return _reconciled(v).groupBy("match_status").agg(F.count(F.lit(1)).alias("n"))


@register("j3_semi_official", """WITH s AS (SELECT DISTINCT ts, home, away FROM games WHERE stage = 'F')
SELECT game_id, league FROM games WHERE (ts, home, away) IN (SELECT ts, home, away FROM s)""")
def _(v: Views):
    return J.semi_official(v.games, v.games.filter("stage = 'F'"), ["ts", "home", "away"]).select("game_id", "league")


@register("j4_repair_scores", """SELECT game_id, CASE WHEN k3 % 4 > 0 THEN home_score WHEN k3 % 8 > 0 THEN home_score + 1 ELSE 0 END AS home_score,
 CASE WHEN k3 % 4 > 0 THEN away_score WHEN k3 % 8 > 0 THEN away_score + 1 ELSE 0 END AS away_score,
 CASE WHEN k3 % 4 > 0 THEN 'local' WHEN k3 % 8 > 0 THEN 'official' ELSE 'secondary' END AS score_source FROM games""")
def _(v: Views):
    g = v.games.select("game_id", "k3", "home_score", "away_score")
    keep = lambda cond, d: [F.expr(f"CASE WHEN {cond} THEN {c} {d} END").alias(c) for c in ("home_score", "away_score")]
    local = g.select("game_id", *keep("k3 % 4 > 0", ""))
    official = g.select("game_id", *keep("k3 % 8 > 0", "+ 1"))
    secondary = g.select("game_id", F.lit(0).alias("home_score"), F.lit(0).alias("away_score"))
    return J.repair_scores(local, official, secondary, ["game_id"])


@register("j5_score_conflicts", """SELECT k3 AS order_id, MIN(home_score) AS home_score, MIN(away_score) AS away_score,
 MIN(home_score) <> MAX(home_score) OR MIN(away_score) <> MAX(away_score) AS conflict FROM games GROUP BY 1""")
def _(v: Views):
    return J.score_conflicts(v.games.withColumnRenamed("k3", "order_id"), "order_id", "home_score", "away_score")


@register("j13_weather_join", """WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, arg_max(value, event_id) AS temp FROM events GROUP BY ALL)
SELECT event_id, source, temp FROM ledger LEFT JOIN h ON h.event_type = source AND h.hour = date_trunc('hour', retrieved_at)""")
def _(v: Views):
    hourly = v.table("events").select(F.col("event_type").alias("source"), "ts", "event_id", F.col("value").alias("temp"))
    hourly = hourly.withColumnRenamed("event_id", "_id")
    return J.hour_join(v.ledger.select("event_id", "source", "retrieved_at"), hourly, ["source"], "retrieved_at", "ts", ["_id"]).select("event_id", "source", "temp")


@register("j14_nearest_hour", """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), s AS (SELECT user_id, ts, event_id AS rid, value FROM events WHERE event_type = 'click'),
b AS (SELECT l.*, s.ts AS bt, s.rid AS bid, s.value AS bv FROM l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.ts >= s.ts),
a AS (SELECT b.*, s.ts AS a_ts, s.rid AS aid, s.value AS av FROM b ASOF LEFT JOIN s ON b.user_id = s.user_id AND b.ts <= s.ts),
g AS (SELECT *, epoch_us(ts) - epoch_us(bt) AS gb, epoch_us(a_ts) - epoch_us(ts) AS ga FROM a),
u AS (SELECT *, gb IS NOT NULL AND (ga IS NULL OR gb <= ga) AS ub FROM g)
SELECT event_id, CASE WHEN CASE WHEN ub THEN gb ELSE ga END <= 86400000000 THEN CASE WHEN ub THEN bv ELSE av END END AS value,
 ROUND(CASE WHEN CASE WHEN ub THEN gb ELSE ga END <= 86400000000 THEN CASE WHEN ub THEN gb ELSE ga END / 1e6 END, 6) AS gap_seconds FROM u""")
def _(v: Views):
    e = v.table("events").select("event_id", "user_id", "ts", "event_type", "value")
    left = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("rts"), F.col("event_id").alias("rid"), "value")
    return us(O.nearest(left, right, ["user_id"], "ts", "rts", "rid", ["value"], 86400).select("event_id", "value", "gap_seconds"), digits=6)


@register("j15_matured_history", """WITH c AS (SELECT league, epoch_us(ts) AS p, epoch_us(ts) + 3 * 86400000000 AS m, CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 0 WHEN p_draw >= p_away THEN 1 ELSE 2 END = y AS ok, game_id FROM probs),
f AS (SELECT league, m AS t, count(*) AS n, SUM(CASE WHEN ok THEN 1 ELSE 0 END) AS hits FROM c GROUP BY ALL),
q AS (SELECT league, p AS t, 0 AS n, 0 AS hits FROM c GROUP BY ALL), u AS (SELECT league, t, SUM(n) AS n, SUM(hits) AS hits FROM (SELECT * FROM f UNION ALL SELECT * FROM q) GROUP BY ALL),
s AS (SELECT league, t, SUM(n) OVER w AS n, SUM(hits) OVER w AS hits FROM u WINDOW w AS (PARTITION BY league ORDER BY t))
SELECT c.game_id, CAST(s.n AS BIGINT) AS n, CAST(s.hits AS BIGINT) AS hits FROM c JOIN s ON s.league = c.league AND s.t = c.p""")
def _(v: Views):
    from tideline.functions.arrays import arg_max_cols

    cols = [F.col(c) for c in MODELS["m1"]]
    cases = v.probs.select("league", "game_id", F.col("ts").alias("pt"), F.expr("ts + INTERVAL 3 DAYS").alias("mt"), (arg_max_cols(cols) == F.col("y")).cast("int").alias("ok"))
    out = J.matured_sums(cases.select("league", "game_id", "pt"), cases, ["league"], "pt", "pt", "mt", {"n": F.lit(1), "hits": F.col("ok")})
    return out.select("game_id", F.col("n").cast("bigint").alias("n"), F.col("hits").cast("bigint").alias("hits"))


@register("j18_model_panel", "SELECT game_id, p_home AS m1_p0, p_draw AS m1_p1, q_home AS m2_p0, q_draw AS m2_p1, r_home AS m3_p0, r_draw AS m3_p1 FROM probs")
def _(v: Views):
    return J.model_panel(v.preds, list(MODELS), ["p0", "p1"])


@register("j19_lineup_join", """WITH h AS (SELECT CAST(k1 % 200 AS VARCHAR) AS player_id, ts, SUM(3 + k2 % 3) AS pa, SUM(home_score % 4) AS hits, SUM(away_score % 2) AS walks FROM games GROUP BY ALL),
c AS (SELECT player_id, ts, SUM(pa) OVER w AS pa, SUM(hits) OVER w AS hits, SUM(walks) OVER w AS walks FROM h WINDOW w AS (PARTITION BY player_id ORDER BY ts)),
l AS (SELECT game_id, ts, UNNEST([CAST(k1 % 200 AS VARCHAR), CAST(k2 % 200 AS VARCHAR), CAST(k3 % 250 AS VARCHAR)]) AS player_id FROM games WHERE k3 % 9 > 0),
p AS (SELECT l.*, COALESCE(c.pa, 0) AS pa, c.hits, c.walks FROM l ASOF LEFT JOIN c ON l.player_id = c.player_id AND l.ts > c.ts),
w AS (SELECT game_id, GREATEST(1.0, CAST(pa AS DOUBLE)) AS w, CASE WHEN pa > 0 THEN hits / pa ELSE 0.25 END AS a, CASE WHEN pa > 0 THEN walks / pa ELSE 0.08 END AS b FROM p),
m AS (SELECT game_id, SUM(w * a) / SUM(w) AS a, SUM(w * b) / SUM(w) AS b FROM w GROUP BY 1)
SELECT g.game_id, ROUND(COALESCE(a, 0.25) + 1e-11, 8) AS lineup_avg, ROUND(COALESCE(b, 0.08) + 1e-11, 8) AS lineup_bb_rate FROM games g LEFT JOIN m USING (game_id)""")
def _(v: Views):
    g = v.games
    lineup = g.select("game_id", "ts", F.when(F.expr("k3 % 9 > 0"), F.expr(
        "to_json(array(named_struct('player_id', string(k1 % 200), 'batting_order', 1), named_struct('player_id', string(k2 % 200), 'batting_order', 2), "
        "named_struct('player_id', string(k3 % 250), 'batting_order', 3)))")).alias("lineup_json"))
    hist = g.select(F.expr("string(k1 % 200)").alias("player_id"), "ts", F.expr("3 + k2 % 3").alias("pa"), F.expr("home_score % 4").alias("hits"),
                    F.expr("away_score % 2").alias("walks"))
    out = J.lineup_means(lineup, hist, "game_id", "ts", {"avg": (F.col("hits"), 0.25), "bb_rate": (F.col("walks"), 0.08)})
    # the offset (also in the SQL) keeps short binary fractions off rounding ties
    return us(out.withColumns({c: F.col(c) + 1e-11 for c in ("lineup_avg", "lineup_bb_rate")}), digits=8)


@register("j20_team_key_join", """WITH r AS (SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, home, away, MAX(home_score) AS actual_home, MAX(away_score) AS actual_away FROM games WHERE stage = 'F' GROUP BY ALL)
SELECT game_id, day, actual_home, actual_away FROM (SELECT game_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, home, away FROM probs) JOIN r USING (day, home, away)""")
def _(v: Views):
    day = local_date(F.col("ts"), "Asia/Tokyo").cast("string").alias("day")
    result = v.games.filter("stage = 'F'").groupBy(day, "home", "away").agg(F.max("home_score").alias("actual_home"), F.max("away_score").alias("actual_away"))
    return v.games.select("game_id", day, "home", "away").join(result, ["day", "home", "away"]).select("game_id", "day", "actual_home", "actual_away")


@register("j21_dimension_joins", """SELECT r_name, c_mktsegment, count(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def _(v: Views):
    # no hint: the planner broadcasts a dimension only while its measured size is under the session threshold
    o = v.table("orders").select("o_custkey", "o_totalprice")
    j = (o.join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
         .join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey")))
    return j.groupBy("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("j22_target_rows", """WITH s AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END AS start_at, o_orderdate FROM orders),
t AS (SELECT k3 AS o_orderkey, MIN(k2) AS starter FROM games GROUP BY 1),
j AS (SELECT s.o_orderkey, starter, COALESCE(start_at, CASE WHEN o_orderkey % 2 = 0 AND starter IS NOT NULL THEN o_orderdate END, o_orderdate + INTERVAL 1 DAY) AS start_at FROM s LEFT JOIN t USING (o_orderkey)),
l AS (SELECT o_orderkey, CAST(COALESCE(starter, -1) AS BIGINT) AS starter, (epoch_us(start_at) - epoch_us(TIMESTAMP '1998-01-01')) / 60e6 AS lead_minutes FROM j)
SELECT * FROM l WHERE lead_minutes BETWEEN 30 AND 525600""")
def _(v: Views):
    o = v.table("orders")
    sched = o.select("o_orderkey", F.expr("CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END").alias("start_at"), "o_orderdate")
    named = v.games.groupBy(F.col("k3").alias("o_orderkey")).agg(F.min("k2").alias("starter"))
    starters = named.join(o.select("o_orderkey", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END").alias("start_at")), "o_orderkey")
    out = J.target_rows(sched, starters, ["o_orderkey"], F.expr("TIMESTAMP '1998-01-01 00:00:00 UTC'"), 30, 525600, F.expr("o_orderdate + INTERVAL 1 DAY"))
    return out.select("o_orderkey", F.coalesce("starter", F.lit(-1)).alias("starter"), "lead_minutes")


@register("j23_application_plan", """WITH c AS (SELECT n_regionkey AS scope_id, c_mktsegment AS source_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0 GROUP BY ALL),
f AS (SELECT c_mktsegment AS source_id, n_name AS feature FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 GROUP BY ALL),
k AS (SELECT n_regionkey AS scope_id, n_name AS feature FROM nation)
SELECT c.scope_id, c.source_id, string_agg(f.feature, ',' ORDER BY f.feature) AS features FROM c JOIN f USING (source_id) JOIN k ON k.scope_id = c.scope_id AND k.feature = f.feature GROUP BY ALL""")
def _(v: Views):
    cn = v.table("customer").join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    scopes = cn.groupBy(F.col("n_regionkey").alias("scope_id")).agg(F.collect_set(F.when(F.expr("c_custkey % 2 = 0"), F.col("c_mktsegment"))).alias("source_ids"))
    canon = v.table("nation").groupBy(F.col("n_regionkey").alias("scope_id")).agg(F.collect_set("n_name").alias("canonical"))
    sources = cn.filter("c_acctbal > 5000").groupBy(F.col("c_mktsegment").alias("source_id")).agg(F.collect_set("n_name").alias("features"))
    out = J.application_plan(scopes.join(canon, "scope_id"), sources)
    return out.select("scope_id", "source_id", F.array_join("features", ",").alias("features"))


@register("j24_resolve_names", """WITH n AS (SELECT DISTINCT name FROM (SELECT split_part(p_name, ' ', 1) AS name FROM part UNION ALL SELECT p_name || ' x' FROM part WHERE p_size < 5 UNION ALL SELECT p_name FROM part WHERE p_size > 45)),
i AS (SELECT p_name AS candidate, MIN(p_partkey) AS id FROM part GROUP BY 1 HAVING MIN(p_partkey) % 3 > 0), e AS (SELECT name, count(*) AS c, MIN(id) AS id FROM n JOIN i ON name = candidate GROUP BY 1),
s AS (SELECT name, MIN(id) AS lo, MAX(id) AS hi FROM n JOIN i ON contains(name, candidate) OR contains(candidate, name) GROUP BY 1)
SELECT n.name, CAST(COALESCE(CASE WHEN e.c = 1 THEN e.id WHEN lo = hi THEN lo END, -1) AS BIGINT) AS id, CASE WHEN e.c = 1 THEN 'exact' WHEN lo = hi THEN 'substring' ELSE 'unresolved' END AS how
FROM n LEFT JOIN e USING (name) LEFT JOIN s USING (name)""")
def _(v: Views):
    p = v.table("part")
    names = (p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")).unionByName(p.filter("p_size < 5").select(F.concat("p_name", F.lit(" x")).alias("name")))
             .unionByName(p.filter("p_size > 45").select(F.col("p_name").alias("name"))))
    index = p.groupBy(F.col("p_name").alias("candidate")).agg(F.min("p_partkey").alias("id")).filter("id % 3 > 0")
    return J.resolve_names(names, index).withColumn("id", F.coalesce("id", F.lit(-1)))


@register("j25_starter_line", """WITH r AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE lpad(CAST(p_partkey AS VARCHAR), 8, '0') END AS pid, p_retailprice FROM part),
w AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS pid FROM lineitem)
SELECT w.pid, COALESCE(a.p_retailprice, b.p_retailprice) AS p_retailprice FROM w LEFT JOIN r a ON a.pid = w.pid LEFT JOIN r b ON CAST(b.pid AS BIGINT) = CAST(w.pid AS BIGINT)""")
def _(v: Views):
    rec = v.table("part").select(F.expr("CASE WHEN p_partkey % 2 = 0 THEN string(p_partkey) ELSE lpad(string(p_partkey), 8, '0') END").alias("pid"), "p_retailprice")
    want = v.table("lineitem").select(F.col("l_partkey").cast("string").alias("pid")).distinct()
    return J.starter_line(want, rec, "pid")


@register("j26_actual_starters", """WITH p AS (SELECT l_orderkey AS game_id, CASE WHEN l_linenumber % 2 = 0 THEN 'home' ELSE 'away' END AS side, CAST(l_partkey AS VARCHAR) AS pid,
 MIN(l_suppkey) AS name, bool_or(l_quantity > 20) AS started, MIN(l_linenumber) AS ord FROM lineitem GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY game_id, side ORDER BY ord, pid) AS rk FROM p WHERE started)
SELECT game_id, MAX(CASE WHEN side = 'home' THEN 'P' || name END) AS actual_home_starter, MAX(CASE WHEN side = 'away' THEN 'P' || name END) AS actual_away_starter FROM f WHERE rk = 1 GROUP BY 1""")
def _(v: Views):
    p = v.table("lineitem").groupBy(F.col("l_orderkey").alias("game_id"), F.expr("CASE WHEN l_linenumber % 2 = 0 THEN 'home' ELSE 'away' END").alias("side"), F.col("l_partkey").cast("string").alias("pid")).agg(
        F.min("l_suppkey").alias("s"), F.bool_or(F.col("l_quantity") > 20).alias("started"), F.min("l_linenumber").alias("order"))
    box = p.groupBy("game_id", "side").agg(F.map_from_entries(F.collect_list(F.struct("pid", F.struct(F.concat(F.lit("P"), "s").alias("name"), "started", "order")))).alias("players"))
    return J.actual_starters(box)
