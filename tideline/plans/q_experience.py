"""Queries over the experience operators."""

from pyspark.sql import functions as F

from tideline.operators import evaluate as E
from tideline.operators import experience as X
from tideline.operators import prob as P
from tideline.plans.catalog import register
from tideline.plans.q_evaluate import BRSQL, CAL, CL, FOUR, MEAN, NLLSQL, TOPSQL, M, _conf_sql, bundle
from tideline.plans.q_timeline import us
from tideline.plans.views import Views

PS = M["m2"]


def cases(v: Views):
    s = X.strata(F.col("league"), F.expr("concat('r', k1 % 3)"), F.expr("CASE WHEN k2 % 4 > 0 THEN concat('s', k2 % 2) END"), F.expr("concat('m', k3 % 2)"), F.expr("array(' t1 ', CASE WHEN k1 % 2 = 0 THEN 't2' ELSE '' END)"))
    return v.probs.select("game_id", "ts", "y", *PS, F.col("ts").alias("prediction_time"), F.expr("ts + INTERVAL 2 DAYS").alias("available_at"), s.alias("strata"))


STRATA = """cs AS (SELECT game_id, ts, y, q_home AS p0, q_draw AS p1, q_away AS p2, league AS t, 'r' || k1 % 3 AS r, CASE WHEN k2 % 4 > 0 THEN 's' || k2 % 2 END AS s, 'm' || k3 % 2 AS m, k1 FROM probs),
st AS (SELECT game_id, ts, y, p0, p1, p2, 'global' AS scope, 'GLOBAL' AS key, 1 AS spec FROM cs UNION ALL SELECT game_id, ts, y, p0, p1, p2, 'target', t, 2 FROM cs UNION ALL SELECT game_id, ts, y, p0, p1, p2, 'target_regime', t || '|' || r, 3 FROM cs
 UNION ALL SELECT game_id, ts, y, p0, p1, p2, 'target_score_regime', t || '|' || s, 3 FROM cs WHERE s IS NOT NULL UNION ALL SELECT game_id, ts, y, p0, p1, p2, 'target_regime_score', t || '|' || r || '|' || s, 4 FROM cs WHERE s IS NOT NULL
 UNION ALL SELECT game_id, ts, y, p0, p1, p2, 'target_model', t || '|' || m, 3 FROM cs UNION ALL SELECT game_id, ts, y, p0, p1, p2, 'target_tag', t || '|t1', 3 FROM cs UNION ALL SELECT game_id, ts, y, p0, p1, p2, 'target_tag', t || '|t2', 3 FROM cs WHERE k1 % 2 = 0)"""
PCUT = "TIMESTAMP '1999-06-01'"
AGG = "count(*) AS rows, SUM(p0) AS p0, SUM(p1) AS p1, SUM(p2) AS p2, SUM(CASE WHEN y = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS y0, SUM(CASE WHEN y = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS y1, SUM(CASE WHEN y = 2 THEN 1.0 ELSE 0 END)::DOUBLE AS y2"
NL3, BR3 = NLLSQL.format("p0", "p1", "p2"), BRSQL.format("p0", "p1", "p2")


def _policy_sql(where: str) -> str:
    return f"""pg AS (SELECT scope, key, spec, {AGG}, avg({NL3}) AS ll, avg({BR3}) AS br FROM st WHERE {where} GROUP BY ALL), gg AS (SELECT y0 / rows AS g0, y1 / rows AS g1, y2 / rows AS g2 FROM pg WHERE scope = 'global'),
po AS (SELECT scope, key, spec, rows, ll, br, {', '.join(f'(y{i} + 50.0 * g{i}) / (rows + 50.0) - p{i} / rows AS d{i}' for i in range(3))} FROM pg CROSS JOIN gg WHERE rows >= 30)"""


def _fix(i: int, d: str = "d") -> str:
    return f"p{i} * exp(0.5 * GREATEST(-0.35, LEAST(0.35, ln(GREATEST(0.5, LEAST(2.0, GREATEST(1e-6, LEAST(1.0, p{i} + {d}{i})) / GREATEST(p{i}, 1e-6)))))))"


@register("a21_policy_strata", f"WITH {STRATA} SELECT scope, key, rows, games, {', '.join(f'ROUND(p{i}, 6) AS pred{i}, y{i} AS actual{i}' for i in range(3))} FROM (SELECT scope, key, {AGG}, count(DISTINCT game_id) AS games FROM st GROUP BY ALL)")
def _(v: Views):
    return us(X.policy_strata(cases(v), PS, "y"), digits=6)


@register("d23_policy_build", f"WITH {STRATA}, {_policy_sql(f'ts + INTERVAL 2 DAY <= {PCUT} AND ts < {PCUT}')} SELECT scope, key, spec, rows, ROUND(ll, 8) AS mean_log_loss, ROUND(br, 8) AS mean_brier, ROUND(d0, 8) + 0.0 AS delta0, ROUND(d1, 8) + 0.0 AS delta1, ROUND(d2, 8) + 0.0 AS delta2 FROM po")
def _(v: Views):
    return us(X.policy_build(cases(v), PS, "y", F.expr(PCUT.replace("01'", "01 00:00:00 UTC'"))), digits=8)


APPLY = f"""{STRATA}, {_policy_sql(f'ts + INTERVAL 2 DAY <= {PCUT} AND ts < {PCUT}')}, ch AS (SELECT game_id, arg_min((po.scope, po.key, d0, d1, d2), (-po.spec, -rows, po.scope, po.key)) AS e FROM st JOIN po ON po.scope = st.scope AND po.key = st.key WHERE ts >= {PCUT} GROUP BY 1),
cj AS (SELECT cs.*, e[1] || ':' || e[2] AS src, e[3] AS d0, e[4] AS d1, e[5] AS d2 FROM cs LEFT JOIN ch USING (game_id) WHERE ts >= {PCUT}), co AS (SELECT *, {', '.join(f'{_fix(i)} AS c{i}' for i in range(3))} FROM cj),
cl AS (SELECT game_id, ts, y, p0 AS b0, p1 AS b1, p2 AS b2, src, {', '.join(f'CASE WHEN src IS NULL THEN p{i} ELSE c{i} / (c0 + c1 + c2) END AS p{i}' for i in range(3))} FROM co)"""


@register("d24_policy_apply", f"WITH {APPLY} SELECT game_id, src AS policy_source, ROUND(p0, 8) AS home, ROUND(p1, 8) AS draw, ROUND(p2, 8) AS away FROM cl")
def _(v: Views):
    c = cases(v)
    cut = F.expr(PCUT.replace("01'", "01 00:00:00 UTC'"))
    out = X.policy_apply(c.filter(F.col("ts") >= cut), X.policy_build(c, PS, "y", cut), "game_id", PS)
    return us(out.select("game_id", "policy_source", *[F.col(f"learned_{p}").alias(n) for p, n in zip(PS, ("home", "draw", "away"))]), digits=8)


@register("e38_experience_holdout", f"WITH {APPLY}, {bundle('cl', '')}, hb AS (SELECT b0 AS p0, b1 AS p1, b2 AS p2, y FROM cl), {bundle('hb', '').replace('s AS (', 's2 AS (', 1).replace(chr(10) + 'b AS', chr(10) + 'b2x AS').replace(chr(10) + 'm AS', chr(10) + 'm2 AS').replace('FROM s GROUP', 'FROM s2 GROUP').replace('FROM b ', 'FROM b2x ')} SELECT 'learned' AS variant, rows, {FOUR} FROM m UNION ALL SELECT 'baseline', rows, {FOUR} FROM m2")
def _(v: Views):
    c = cases(v)
    cut = F.expr(PCUT.replace("01'", "01 00:00:00 UTC'"))
    out = X.policy_apply(c.filter(F.col("ts") >= cut), X.policy_build(c, PS, "y", cut), "game_id", PS)
    both = out.select("y", F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), *[F.col(pre + p).alias(f"p{i}") for i, p in enumerate(PS)]) for n, pre in (("learned", "learned_"), ("baseline", ""))])))
    return us(E.classification_metrics(both, ["p0", "p1", "p2"], "y", ["variant"]), digits=8)


@register("d25_policy_replay", f"""WITH {STRATA}, fa AS (SELECT scope, key, ts + INTERVAL 2 DAY AS t, {AGG} FROM st GROUP BY ALL), qa AS (SELECT DISTINCT scope, key, ts AS t FROM st),
un AS (SELECT scope, key, t, SUM(rows) AS rows, {', '.join(f'SUM({c}) AS {c}' for c in ('p0', 'p1', 'p2', 'y0', 'y1', 'y2'))} FROM (SELECT * FROM fa UNION ALL SELECT scope, key, t, 0, 0, 0, 0, 0, 0, 0 FROM qa) GROUP BY ALL),
cu AS (SELECT scope, key, t, SUM(rows) OVER w AS rows, {', '.join(f'SUM({c}) OVER w AS {c}' for c in ('p0', 'p1', 'p2', 'y0', 'y1', 'y2'))} FROM un WINDOW w AS (PARTITION BY scope, key ORDER BY t)),
gl AS (SELECT t, y0 / rows AS g0, y1 / rows AS g1, y2 / rows AS g2 FROM cu WHERE scope = 'global' AND rows > 0),
se AS (SELECT st.game_id, st.spec, cu.scope, cu.key, cu.rows, {', '.join(f'(cu.y{i} + 50.0 * g{i}) / (cu.rows + 50.0) - cu.p{i} / cu.rows AS d{i}' for i in range(3))} FROM st JOIN cu ON cu.scope = st.scope AND cu.key = st.key AND cu.t = st.ts JOIN gl ON gl.t = st.ts WHERE cu.rows >= 30),
ch AS (SELECT game_id, arg_min((scope, key, d0, d1, d2), (-spec, -rows, scope, key)) AS e FROM se GROUP BY 1),
cj AS (SELECT cs.*, e[1] || ':' || e[2] AS src, e[3] AS d0, e[4] AS d1, e[5] AS d2 FROM cs LEFT JOIN ch USING (game_id)), co AS (SELECT *, {', '.join(f'{_fix(i)} AS c{i}' for i in range(3))} FROM cj)
SELECT game_id, src AS policy_source, {', '.join(f'ROUND(CASE WHEN src IS NULL THEN p{i} ELSE c{i} / (c0 + c1 + c2) END, 7) AS {n}' for i, n in enumerate(('home', 'draw', 'away')))} FROM co""")
def _(v: Views):
    out = X.policy_replay(cases(v), "game_id", PS, "y")
    return us(out.select("game_id", "policy_source", *[F.col(f"learned_{p}").alias(n) for p, n in zip(PS, ("home", "draw", "away"))]), digits=7)


SHADOW = """sn AS (SELECT k3 AS game, ts, game_id, k1 % 3 AS method, p_home AS p0, p_draw AS p1, p_away AS p2 FROM probs), rs AS (SELECT o_orderkey AS game, CAST(o_custkey % 3 AS INT) AS y FROM orders WHERE o_orderkey % 10 > 0),
sj AS (SELECT sn.*, rs.y FROM sn LEFT JOIN rs USING (game)), cn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game ORDER BY ts DESC, game_id DESC) AS rk FROM sj) WHERE rk = 1)"""


def _shadow(v: Views):
    sn = v.probs.select(F.col("k3").alias("game"), "ts", "game_id", F.expr("k1 % 3").alias("method"), *M["m1"])
    rs = v.table("orders").filter("o_orderkey % 10 > 0").select(F.col("o_orderkey").alias("game"), F.expr("int(o_custkey % 3)").alias("y"))
    return X.shadow_reconcile(sn, rs, M["m1"], "game", ["ts", "game_id"], {"method": F.col("method")})


@register("e40_shadow_snapshot", f"WITH {SHADOW}, ev AS (SELECT * FROM sj WHERE y IS NOT NULL), {bundle('ev', 'method')}, c AS (SELECT method, count(*) AS snapshots, ROUND(avg(CASE WHEN y IS NULL THEN 0 ELSE 1 END), 8) AS coverage FROM sj GROUP BY 1) SELECT method, snapshots, coverage, rows, {FOUR} FROM c JOIN m USING (method)")
def _(v: Views):
    return us(_shadow(v)[0], digits=8)


@register("e40_shadow_canonical", f"WITH {SHADOW}, ev AS (SELECT * FROM cn WHERE y IS NOT NULL), {bundle('ev', 'method')}, c AS (SELECT method, count(*) AS snapshots, ROUND(avg(CASE WHEN y IS NULL THEN 0 ELSE 1 END), 8) AS coverage FROM cn GROUP BY 1) SELECT method, snapshots, coverage, rows, {FOUR} FROM c JOIN m USING (method)")
def _(v: Views):
    return us(_shadow(v)[1], digits=8)


_OOD45 = " + ".join(f"abs(t.{x} - m_{x}) / (s_{x} + 1e-12)" for x in ("lam_h", "lam_a", "p_home"))
_TOP45 = {m: TOPSQL.format(*(f"{m}_{c}" for c in CL)) for m in "pqr"}
_RUNS = """o AS (SELECT league, y, p_home, p_draw, p_away, CASE WHEN league = 'N' AND k1 % 997 = 0 THEN NULL ELSE ts END AS pt, ts - INTERVAL 1 HOUR + CASE WHEN league = 'A' AND k2 % 97 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS av, NOT (league = 'R' AND k1 % 89 = 0) AS met,
  ts - CASE WHEN league = 'R' THEN CAST(k1 % 3 AS INT) ELSE 0 END * INTERVAL 1 DAY AS delivered, game_id FROM t),
ob AS (SELECT *, lag(pt) OVER (PARTITION BY league ORDER BY delivered, game_id) AS before FROM o),
bl AS (SELECT league, concat_ws(',', CASE WHEN bool_or(NOT met) THEN 'pit_join_incomplete' END, CASE WHEN bool_or(pt IS NULL) THEN 'invalid_prediction_time' END, CASE WHEN bool_or(before > pt) AND NOT bool_or(pt IS NULL) THEN 'oos_not_chronological' END,
  CASE WHEN count(*) < 100 THEN 'insufficient_oos_rows' END, CASE WHEN bool_or(av IS NULL OR pt IS NULL OR av > pt) THEN 'pit_not_verified' END) AS blockers FROM ob GROUP BY league)"""


@register("e45_real_oos_bridge", _conf_sql("'*'", 10**9).replace(", t AS (", ", ct AS (").replace("\nt AS (SELECT", "\nct AS (SELECT").replace("FROM t LEFT JOIN z", "FROM ct t LEFT JOIN z") + f""", t AS (SELECT * FROM probs WHERE ts >= {CAL}), rf AS (SELECT * FROM probs WHERE ts < {CAL}),
sm AS (SELECT {', '.join(f'avg({x}) AS m_{x}, stddev_pop({x}) AS s_{x}' for x in ('lam_h', 'lam_a', 'p_home'))} FROM rf),
g AS (SELECT t.*, 1 - (({_TOP45['p']} = {TOPSQL.format(*MEAN.values())})::INT + ({_TOP45['q']} = {TOPSQL.format(*MEAN.values())})::INT + ({_TOP45['r']} = {TOPSQL.format(*MEAN.values())})::INT)::DOUBLE / 3 AS dis, LEAST(1.0, ({_OOD45}) / 3 / 5) AS ood FROM t CROSS JOIN sm),
e AS (SELECT g.*, GREATEST(0.0, LEAST(1.0, 0.30 * (1 - (-(p_home * ln(p_home) + p_draw * ln(p_draw) + p_away * ln(p_away)) / ln(3.0))) + 0.15 * GREATEST(p_home, p_draw, p_away) + 0.20 * 0.5 + 0.15 + 0.10 + 0.05 * (1 - LEAST(1.0, ood)) + 0.05 * (1 - LEAST(1.0, dis)))) AS pr FROM g),
dr AS (SELECT avg(d) AS drift FROM ({' UNION ALL '.join(f"SELECT GREATEST(0, LEAST(1, abs((SELECT avg({x}) FROM t) - avg({x})) / (stddev_pop({x}) + 1e-12) / 3)) AS d FROM rf" for x in ('lam_h', 'lam_a', 'p_home'))})),
{_RUNS}
SELECT e.league, count(*) AS rows, ROUND(avg(dis), 8) AS disagreement, ROUND(avg(ood), 8) AS ood, ROUND(avg(pr), 8) AS predictability, ROUND(avg(set_size), 8) AS mean_set_size, ROUND(avg(CASE WHEN set_size = 0 THEN 1 ELSE 0 END), 8) AS abstain_rate,
  ROUND(any_value(drift), 8) AS drift, concat_ws(',', NULLIF(any_value(blockers), ''), CASE WHEN any_value(drift) >= 0.33 THEN 'drift' END) AS blockers
FROM e JOIN f USING (game_id) CROSS JOIN dr JOIN bl ON bl.league = e.league GROUP BY e.league""")
def _(v: Views):
    """Disagreement, drift, out-of-distribution share, predictability, conformal size and blockers on one prediction table."""
    from tideline.operators import quality as Q

    cut = F.expr("TIMESTAMP '1999-06-01 00:00:00 UTC'")
    ref, cur = v.probs.filter(F.col("ts") < cut), v.probs.filter(F.col("ts") >= cut)
    cols = ["lam_h", "lam_a", "p_home"]
    d = E.disagreement(cur, M)
    o = Q.ood(cur.select("game_id", *cols), ref, cols).select("game_id", "ood")
    pv = E.prediction_set(E.conformal_pvalues(ref, cur, M["m1"], "y", "game_id"), 3).select("game_id", "set_size", "action")
    j = d.join(o, "game_id").join(pv, "game_id")
    score = E.predictability([F.col(c) for c in M["m1"]], F.lit(0.5), F.lit(1.0), F.lit(1.0), F.col("ood"), F.col("disagreement"))
    out = j.withColumn("predictability", score).groupBy("league").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("disagreement").alias("disagreement"), F.avg("ood").alias("ood"), F.avg("predictability").alias("predictability"), F.avg("set_size").alias("mean_set_size"),
        F.avg((F.col("action") == "ABSTAIN").cast("int")).alias("abstain_rate"))
    drift = Q.drift(ref, cur, cols).agg(F.max("score").alias("drift")).withColumn("_one", F.lit(1))
    oos = cur.withColumns({
        "prediction_time": F.expr("CASE WHEN league = 'N' AND k1 % 997 = 0 THEN NULL ELSE ts END"), "available_at": F.expr("ts - INTERVAL 1 HOUR + CASE WHEN league = 'A' AND k2 % 97 = 0 THEN INTERVAL '1' DAY ELSE INTERVAL '0' DAY END"),
        "pit_matched": F.expr("NOT (league = 'R' AND k1 % 89 = 0)"), "delivered": F.expr("ts - CASE WHEN league = 'R' THEN int(k1 % 3) ELSE 0 END * INTERVAL '1' DAY")})
    blocked = X.oos_blockers(oos, M["m1"], "y", ["delivered", "game_id"]).select("league", "blockers")
    both = out.withColumn("_one", F.lit(1)).join(drift, "_one").drop("_one").join(blocked, "league")
    named = F.concat_ws(",", F.when(F.col("blockers") != "", F.col("blockers")), F.when(F.col("drift") >= 0.33, F.lit("drift")))
    return us(both.withColumn("blockers", named), digits=8)


@register("e46_candidate_replay")
def _(v: Views):
    """Development choice of temperature and draw scale per league, then the locked hold-out with the gate's verdict."""
    split = E.time_split(v.probs, (0.70,), ["ts", "game_id"], ["league"])
    dev, hold = split.filter("window = 0"), split.filter("window = 1")
    temps = P.fit_temperature(dev, M["m2"], "y", ["league"])
    scales = [0.5 * 12 ** (i / 47) for i in range(48)]
    t = dev.join(temps.select("league", "temperature"), "league")
    cal = P.temper_cols([F.col(c) for c in M["m2"]], F.col("temperature"))
    trial = t.select("league", "y", *[c.alias(f"c{i}") for i, c in enumerate(cal)]).select("*", F.explode(F.array(*[F.lit(s) for s in scales])).alias("scale"))
    loss = P.nll_cols(P.class_scale([F.col("c0"), F.col("c1"), F.col("c2")], 1, F.col("scale")), F.col("y"))
    best = trial.groupBy("league", "scale").agg(F.avg(loss).alias("l")).groupBy("league").agg(F.min_by("scale", F.struct("l", "scale")).alias("scale"))
    h = hold.join(temps.select("league", "temperature"), "league").join(best, "league")
    cand = P.class_scale(P.temper_cols([F.col(c) for c in M["m2"]], F.col("temperature")), 1, F.col("scale"))
    base = [F.col(c) for c in M["m2"]]
    long = h.select("league", "y", F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), *[c.alias(f"p{i}") for i, c in enumerate(cs)]) for n, cs in (("base", base), ("cand", cand))])))
    m = E.classification_metrics(long, ["p0", "p1", "p2"], "y", ["league", "variant"])
    wide = m.groupBy("league").agg(F.max("rows").alias("rows"), *[F.max(F.when(F.col("variant") == x, F.col(c))).alias(f"{x}_{c}") for x in ("base", "cand") for c in ("accuracy", "log_loss", "brier", "ece")])
    return us(E.candidate_gate(wide), digits=8)


