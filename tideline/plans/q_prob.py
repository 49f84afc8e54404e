"""Queries over probability tables, blending, calibration and ranking."""

import itertools

from pyspark.sql import functions as F

from tideline.functions import arrays as A
from tideline.functions import poisson as S
from tideline.operators import ordered as O
from tideline.operators import prob as P
from tideline.operators import timeline as T
from tideline.plans.catalog import register
from tideline.plans.q_timeline import FIRST, NUM, over, us
from tideline.plans.views import MODELS, Views

HDA = {m: list(c) for m, c in MODELS.items()}


def pmf(lam: str, k: str) -> str:
    return f"exp(-({lam}) + {k} * ln({lam}) - lgamma({k} + 1))"


GRID = f"""lp AS (SELECT DISTINCT lam_h, lam_a FROM probs), ks AS (SELECT unnest(range(15)) AS k),
ph AS (SELECT lam_h, k AS i, {pmf('lam_h', 'k')} AS p FROM (SELECT DISTINCT lam_h FROM lp) CROSS JOIN ks),
pa AS (SELECT lam_a, k AS j, {pmf('lam_a', 'k')} AS p FROM (SELECT DISTINCT lam_a FROM lp) CROSS JOIN ks),
raw AS (SELECT lp.lam_h, lp.lam_a, i, j, ph.p * pa.p AS p FROM lp JOIN ph USING (lam_h) JOIN pa USING (lam_a)),
gr AS (SELECT lam_h, lam_a, i, j, p / SUM(p) OVER (PARTITION BY lam_h, lam_a) AS p FROM raw)"""
BIV = f"""lp AS (SELECT DISTINCT lam_h, lam_a FROM probs), ks AS (SELECT unnest(range(15)) AS k), lc AS (SELECT *, LEAST(0.3, lam_h, lam_a) AS c FROM lp),
raw AS (SELECT lam_h, lam_a, i.k AS i, j.k AS j, SUM({pmf('GREATEST(lam_h - c, 1e-9)', '(i.k - s.k)')} * {pmf('GREATEST(lam_a - c, 1e-9)', '(j.k - s.k)')} * {pmf('c', 's.k')}) AS p
  FROM lc CROSS JOIN ks i CROSS JOIN ks j JOIN ks s ON s.k <= LEAST(i.k, j.k) GROUP BY ALL),
gr AS (SELECT lam_h, lam_a, i, j, p / SUM(p) OVER (PARTITION BY lam_h, lam_a) AS p FROM raw)"""


def lam(side: str):
    return F.col(f"lam_{side}")


CLS = ("home", "draw", "away")


def _summary(v: Views, shared: float):
    return v.probs.select("game_id", "lam_h", "lam_a").select("game_id", S.grid_summary(lam("h"), lam("a"), F.lit(shared)).alias("s"))


def _expected_cells(v: Views, shared: float):
    width = S.MAX_RUNS + 1
    # games of equal intensities are one grid
    asked = v.probs.groupBy("league", "lam_h", "lam_a").agg(F.count(F.lit(1)).alias("games"))
    cells = asked.select("league", "games", F.posexplode(S.grid_cells(lam("h"), lam("a"), F.lit(shared))).alias("pos", "p"))
    sums = cells.groupBy("league", "pos").agg(F.sum(F.col("p") * F.col("games")).alias("expected_games"))
    return us(sums.select("league", F.expr(f"pos div {width}").cast("int").alias("home_runs"), (F.col("pos") % width).alias("away_runs"), "expected_games"), digits=6)


@register("d1_poisson_grid", f"WITH {GRID} SELECT league, CAST(i AS INT) AS home_runs, CAST(j AS INT) AS away_runs, ROUND(SUM(p), 6) AS expected_games FROM probs JOIN gr USING (lam_h, lam_a) GROUP BY ALL")
def _(v: Views):
    return _expected_cells(v, 0.0)


@register("d2_bivariate_grid", f"WITH {BIV} SELECT league, CAST(i AS INT) AS home_runs, CAST(j AS INT) AS away_runs, ROUND(SUM(p), 6) AS expected_games FROM probs JOIN gr USING (lam_h, lam_a) GROUP BY ALL")
def _(v: Views):
    return _expected_cells(v, 0.3)


@register("d3_low_high", f"""WITH {GRID}, z AS (SELECT lam_h, lam_a, SUM(CASE WHEN i + j <= 6 THEN p ELSE 0 END) AS low, SUM(CASE WHEN i <= 6 AND j <= 6 THEN p ELSE 0 END) AS low_both FROM gr GROUP BY ALL)
SELECT game_id, ROUND(low, 8) AS low, ROUND(1 - low, 8) AS high, ROUND(low_both, 8) AS low_both FROM probs JOIN z USING (lam_h, lam_a)""")
def _(v: Views):
    s = _summary(v, 0.0)
    return us(s.select("game_id", "s.low", (1 - F.col("s.low")).alias("high"), "s.low_both"), digits=8)


@register("d4_outcomes_from_grid", f"""WITH {GRID}, z AS (SELECT lam_h, lam_a, SUM(CASE WHEN i > j THEN p ELSE 0 END) AS h, SUM(CASE WHEN i = j THEN p ELSE 0 END) AS d, SUM(CASE WHEN i < j THEN p ELSE 0 END) AS a FROM gr GROUP BY ALL)
SELECT game_id, ROUND(h, 8) AS home, ROUND(d, 8) AS draw, ROUND(a, 8) AS away FROM probs JOIN z USING (lam_h, lam_a)""")
def _(v: Views):
    return us(_summary(v, 0.0).select("game_id", "s.home", "s.draw", "s.away"), digits=8)


@register("d5_extra_innings_outcomes", f"""WITH {BIV}, z AS (SELECT lam_h, lam_a, SUM(CASE WHEN i > j THEN p ELSE 0 END) AS h, SUM(CASE WHEN i = j THEN p ELSE 0 END) AS d, SUM(CASE WHEN i < j THEN p ELSE 0 END) AS a FROM gr GROUP BY ALL),
kx AS (SELECT unnest(range(13)) AS k), ir AS (SELECT lam_h, lam_a, a.k AS i, b.k AS j, {pmf('(lam_h / 9.0)', 'a.k')} * {pmf('(lam_a / 9.0)', 'b.k')} AS p FROM lp CROSS JOIN kx a CROSS JOIN kx b),
iz AS (SELECT lam_h, lam_a, SUM(CASE WHEN i > j THEN p ELSE 0 END) / SUM(p) AS h, SUM(CASE WHEN i = j THEN p ELSE 0 END) / SUM(p) AS t, SUM(CASE WHEN i < j THEN p ELSE 0 END) / SUM(p) AS a FROM ir GROUP BY ALL),
f AS (SELECT lam_h, lam_a, z.h + z.d * iz.h * (1 + t + t * t) AS h, z.d * t * t * t AS d, z.a + z.d * iz.a * (1 + t + t * t) AS a FROM z JOIN iz USING (lam_h, lam_a))
SELECT game_id, ROUND(h / (h + d + a), 8) AS home, ROUND(d / (h + d + a), 8) AS draw, ROUND(a / (h + d + a), 8) AS away FROM probs JOIN f USING (lam_h, lam_a)""")
def _(v: Views):
    return us(_summary(v, 0.3).select("game_id", *[F.col(f"s.final_{c}").alias(c) for c in CLS]), digits=8)


def residual(name: str, side: str):
    return F.col(f"{name}_score") - lam(side)




@register("d6_shared_lambda", "SELECT league, count(*) AS n, ROUND(CASE WHEN count(*) >= 25 THEN GREATEST(0.0, LEAST(1.25, avg((home_score - lam_h) * (away_score - lam_a)))) ELSE 0.0 END, 8) AS shared_lambda FROM probs GROUP BY 1")
def _(v: Views):
    return us(P.shared_lambda(v.probs, residual("home", "h"), residual("away", "a"), ["league"]), digits=8)


@register("d7_negbin_low", """WITH d AS (SELECT league, CASE WHEN count(*) < 8 OR var_samp(home_score) <= avg(home_score) + 1e-9 THEN 1e6 ELSE GREATEST(0.25, LEAST(1e6, pow(avg(home_score), 2) / (var_samp(home_score) - avg(home_score)))) END AS s,
 avg(home_score) AS mu FROM games GROUP BY 1), ks AS (SELECT unnest(range(7)) AS k)
SELECT league, ROUND(mu, 6) AS mu, ROUND(s, 6) AS size, ROUND(SUM(exp(lgamma(k + s) - lgamma(s) - lgamma(k + 1) + s * ln(s / (s + mu)) + k * ln(mu / (s + mu)))), 6) AS p_low FROM d CROSS JOIN ks GROUP BY ALL""")
def _(v: Views):
    d = P.dispersion(v.games, "home_score", ["league"])
    return us(d.withColumn("p_low", S.negbin_low(F.col("mu"), F.col("size"))), digits=6)


@register("d8_score_outputs", f"""WITH {BIV}, rk AS (SELECT *, row_number() OVER (PARTITION BY lam_h, lam_a ORDER BY ROUND(p, 12) DESC, i, j) AS rk FROM gr),
t AS (SELECT lam_h, lam_a, string_agg(CASE WHEN rk <= 4 THEN i || '-' || j END, ',' ORDER BY rk) AS top4, ROUND(SUM(CASE WHEN rk <= 4 THEN p ELSE 0 END), 8) AS top4_mass, ROUND(SUM(CASE WHEN i + j <= 6 THEN p ELSE 0 END), 8) AS low FROM rk GROUP BY ALL)
SELECT game_id, top4, top4_mass, low FROM probs JOIN t USING (lam_h, lam_a)""")
def _(v: Views):
    s = _summary(v, 0.3)
    return us(s.select("game_id", F.array_join("s.scores", ",").alias("top4"), A.asum(F.col("s.probabilities")).alias("top4_mass"), "s.low"), digits=8)


@register("k2_top_k_scores", f"""WITH {GRID}, rk AS (SELECT *, row_number() OVER (PARTITION BY lam_h, lam_a ORDER BY ROUND(p, 12) DESC, i, j) AS rk FROM gr)
SELECT game_id, CAST(rk AS INT) AS rank, i || '-' || j AS score, ROUND(p, 8) AS probability FROM probs JOIN rk USING (lam_h, lam_a) WHERE rk <= 4""")
def _(v: Views):
    c = _summary(v, 0.0).select("game_id", F.posexplode(F.arrays_zip("s.scores", "s.probabilities")).alias("pos", "c"))
    return us(c.select("game_id", (F.col("pos") + 1).alias("rank"), F.col("c.scores").alias("score"), F.col("c.probabilities").alias("probability")), digits=8)


@register("d9_market_threshold", """WITH l AS (SELECT game_id, home_score + away_score AS total, 5 + (k1 % 13) / 2.0 AS line FROM games)
SELECT game_id, CAST(line AS DOUBLE) AS line, CAST(CASE WHEN line = floor(line) THEN line - 1 ELSE floor(line) END AS DOUBLE) AS low_max, CAST(CASE WHEN line = floor(line) THEN line + 1 ELSE floor(line) + 1 END AS DOUBLE) AS high_min,
 CASE WHEN total = line THEN 'PUSH' WHEN total < line THEN 'LOW' ELSE 'HIGH' END AS result FROM l""")
def _(v: Views):
    g = v.games.select("game_id", (F.col("home_score") + F.col("away_score")).alias("total"), F.expr("5 + (k1 % 13) / 2D").alias("line"))
    low, high = P.market_threshold(F.col("line"))
    return g.select("game_id", "line", low.alias("low_max"), high.alias("high_min"), P.classify_total(F.col("total"), F.col("line")).alias("result"))


@register("d10_line_pit_usable", """WITH m AS (SELECT event_id, status, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 8 = 0 THEN 7.3 ELSE event_id % 240 / 2.0 END AS line, source_timestamp AS observed_at, available_at, prediction_cutoff - INTERVAL 6 HOUR AS c FROM ledger),
r AS (SELECT *, concat_ws(',', CASE WHEN status = 'KNOWN' AND line IS NULL THEN 'line_missing' END, CASE WHEN line < 0 OR line > 100 THEN 'line_out_of_range' END, CASE WHEN abs(line * 2 - round(line * 2)) > 1e-9 THEN 'line_not_half_point' END,
 CASE WHEN status = 'KNOWN' AND available_at IS NULL THEN 'availability_missing' END, CASE WHEN available_at < observed_at THEN 'available_before_observed' END) AS reasons FROM m)
SELECT event_id, reasons, COALESCE(reasons = '' AND status = 'KNOWN' AND line IS NOT NULL AND observed_at <= c AND available_at <= c, FALSE) AS usable FROM r""")
def _(v: Views):
    m = v.ledger.select("event_id", "status", F.expr("CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 8 = 0 THEN 7.3D ELSE event_id % 240 / 2D END").alias("line"),
                        F.col("source_timestamp").alias("observed_at"), "available_at", F.expr("prediction_cutoff - INTERVAL 6 HOURS").alias("c"))
    return P.line_usable(m, F.col("c")).select("event_id", F.array_join("reasons", ",").alias("reasons"), "usable")


@register("d11_low_high_labels", """SELECT game_id, CAST(CASE WHEN home_score + away_score <> 7 THEN CASE WHEN home_score + away_score < 7 THEN 1 ELSE 0 END END AS DOUBLE) AS low,
 CAST(CASE WHEN home_score + away_score <> 7 THEN CASE WHEN home_score + away_score > 7 THEN 1 ELSE 0 END END AS DOUBLE) AS high FROM games""")
def _(v: Views):
    low, high = P.low_high_labels(F.col("home_score") + F.col("away_score"), 7.0)
    return v.games.select("game_id", low.cast("double").alias("low"), high.cast("double").alias("high"))


WTS = (0.5, 0.3, 0.2)


def _mix(kind: str, c: str) -> str:
    if kind == "linear":
        return " + ".join(f"{w} * {m}_{c}" for w, m in zip(WTS, "pqr"))
    return "exp(" + " + ".join(f"{w} * ln({m}_{c})" for w, m in zip(WTS, "pqr")) + ")"


@register("d12_blend", f"""WITH b AS (SELECT game_id, {', '.join(f'{_mix(k, c)} AS {k}_{c}' for k in ('linear', 'log_pool') for c in CLS)} FROM probs)
SELECT game_id, {', '.join(f'ROUND({k}_{c} / ({k}_home + {k}_draw + {k}_away), 8) AS {k}_{c}' for k in ('linear', 'log_pool') for c in CLS)} FROM b""")
def _(v: Views):
    members = [[F.col(f"{m}_{c}") for c in CLS] for m in "pqr"]
    cols = [c.alias(f"{k}_{n}") for k in ("linear", "log_pool") for n, c in zip(CLS, P.blend_cols(members, WTS, k))]
    return us(v.probs.select("game_id", *cols), digits=8)


@register("d12_blend_long", f"""SELECT game_id, {', '.join(f"ROUND({' + '.join(f'{w} * {m}_{c}' for w, m in zip((0.6, 0.3, 0.1), 'pqr'))}, 8) AS p{i}" for i, c in enumerate(CLS))} FROM probs""")
def _(v: Views):
    w = F.expr("CASE model WHEN 'm1' THEN 0.6D WHEN 'm2' THEN 0.3D ELSE 0.1D END")
    return us(P.blend_long(v.preds.withColumn("w", w), "w", ["game_id"], ["p0", "p1", "p2"]), digits=8)


TGRID = "ts AS (SELECT 0.35 * pow(6.0 / 0.35, i / 80.0) AS t FROM (SELECT unnest(range(81)) AS i))"


def _tloss(p: str = "p", src: str = "probs", keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return (f"SELECT {k}t, avg(-ln(CASE y WHEN 0 THEN pow({p}0, 1 / t) WHEN 1 THEN pow({p}1, 1 / t) ELSE pow({p}2, 1 / t) END / (pow({p}0, 1 / t) + pow({p}1, 1 / t) + pow({p}2, 1 / t)))) AS loss "
            f"FROM {src} CROSS JOIN ts GROUP BY {k}t")


@register("d15_fit_temperature", f"""WITH {TGRID}, l AS ({_tloss('p', 'preds', 'model, league')})
SELECT model, league, ROUND(arg_min(t, loss), 8) AS temperature, ROUND(MIN(loss), 8) AS log_loss FROM l GROUP BY ALL""")
def _(v: Views):
    return us(P.fit_temperature(v.preds, ["p0", "p1", "p2"], "y", ["model", "league"]), digits=8)


@register("d14_temperature", "SELECT game_id, " + ", ".join(f"ROUND(pow(p_{c}, 1 / 1.7) / (pow(p_home, 1 / 1.7) + pow(p_draw, 1 / 1.7) + pow(p_away, 1 / 1.7)), 8) AS {c}" for c in CLS) + " FROM probs")
def _(v: Views):
    return us(v.probs.select("game_id", *[c.alias(n) for n, c in zip(CLS, P.temper_cols([F.col(f"p_{c}") for c in CLS], 1.7))]), digits=8)


@register("d16_calibration_report", """WITH l AS (SELECT model, -ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END) AS raw, -ln(CASE y WHEN 0 THEN pow(p0, 1 / 0.8) WHEN 1 THEN pow(p1, 1 / 0.8) ELSE pow(p2, 1 / 0.8) END / (pow(p0, 1 / 0.8) + pow(p1, 1 / 0.8) + pow(p2, 1 / 0.8))) AS cal FROM preds)
SELECT model, ROUND(avg(raw), 8) AS raw_logloss, ROUND(avg(cal), 8) AS calibrated_logloss, ROUND(avg(raw) - avg(cal), 8) AS improvement, count(*) AS rows FROM l GROUP BY 1""")
def _(v: Views):
    return us(P.calibration_report(v.preds, ["p0", "p1", "p2"], "y", F.lit(0.8), ["model"]), digits=8)


COMBOS = [tuple(c / 4 for c in x) for x in itertools.product(range(5), repeat=3) if sum(x) == 4]


@register("d13_weight_grid_losses", f"""WITH w AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)' for a, b, c in COMBOS)}) AS t(w0, w1, w2))
SELECT w0, w1, w2, ROUND(avg(-ln(CASE y WHEN 0 THEN w0 * p_home + w1 * q_home + w2 * r_home WHEN 1 THEN w0 * p_draw + w1 * q_draw + w2 * r_draw ELSE w0 * p_away + w1 * q_away + w2 * r_away END)), 8) AS loss FROM probs CROSS JOIN w GROUP BY ALL""")
def _(v: Views):
    w = F.array(*[F.struct(*[F.lit(x).alias(f"w{i}") for i, x in enumerate(c)]) for c in P.weight_grid(3, 0.25)])
    wide = v.probs.select("y", *[f"{m}_{c}" for m in "pqr" for c in CLS], F.inline(w))
    b = P.blend_cols([[F.col(f"{m}_{c}") for c in CLS] for m in "pqr"], [F.col("w0"), F.col("w1"), F.col("w2")])
    return us(wide.groupBy("w0", "w1", "w2").agg(F.avg(P.nll_cols(b, F.col("y"))).alias("loss")), digits=8)


FITB = f"""{TGRID}, mt AS (SELECT model, arg_min(t, loss) AS t FROM ({_tloss('p', 'preds', 'model')}) GROUP BY 1),
tt AS (SELECT MAX(CASE WHEN model = 'm1' THEN t END) AS t1, MAX(CASE WHEN model = 'm2' THEN t END) AS t2, MAX(CASE WHEN model = 'm3' THEN t END) AS t3 FROM mt),
pw AS (SELECT y, {', '.join(f'pow({m}_{c}, 1 / t{i}) AS {m}{c}' for i, m in enumerate('pqr', 1) for c in CLS)} FROM probs CROSS JOIN tt),
nm AS (SELECT y, {', '.join(f'{m}{c} / ({m}home + {m}draw + {m}away) AS {m}{k}' for m in 'pqr' for k, c in enumerate(CLS))} FROM pw),
w AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)' for a, b, c in COMBOS)}) AS t(w0, w1, w2)),
bl AS (SELECT y, w0, w1, w2, w0 * p0 + w1 * q0 + w2 * r0 AS p0, w0 * p1 + w1 * q1 + w2 * r1 AS p1, w0 * p2 + w1 * q2 + w2 * r2 AS p2 FROM nm CROSS JOIN w),
fl AS (SELECT w0, w1, w2, arg_min(t, loss) AS t, MIN(loss) AS loss FROM ({_tloss('p', 'bl', 'w0, w1, w2')}) GROUP BY ALL)"""


@register("d13_fit_calibrated_blend", f"""WITH {FITB}
SELECT w0, w1, w2, ROUND(t1, 8) AS t1, ROUND(t2, 8) AS t2, ROUND(t3, 8) AS t3, ROUND(t, 8) AS final_temperature, ROUND(loss, 8) AS log_loss FROM fl CROSS JOIN tt
ORDER BY ROUND(loss, 12), pow(w0 - 1.0 / 3, 2) + pow(w1 - 1.0 / 3, 2) + pow(w2 - 1.0 / 3, 2), w0, w1, w2 LIMIT 1""")
def _(v: Views):
    spec = P.fit_blend(v.probs, HDA, "y")
    one = v.probs.agg(F.count(F.lit(1)).alias("_n"))
    names = {**{f"w{i}": x for i, x in enumerate(spec["weights"])}, **{f"t{i}": x for i, x in enumerate(spec["temperatures"], 1)},
             "final_temperature": spec["final_temperature"], "log_loss": spec["log_loss"]}
    return us(one.select(*[F.lit(x).alias(n) for n, x in names.items()]), digits=8)


@register("k3_top_models", "SELECT model, ROUND(avg(-ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 8) AS log_loss FROM preds GROUP BY 1 ORDER BY 2, 1 LIMIT 2")
def _(v: Views):
    return us(P.top_models(v.preds, ["p0", "p1", "p2"], "y", 2), digits=8)


LAMS = {"a": ("lam_h", "lam_a"), "b": ("b_h", "b_a"), "c": ("c_h", "c_a")}


def _lams(v: Views):
    return v.probs.withColumns({"b_h": F.expr("1D + k1 % 6"), "b_a": F.expr("1D + k2 % 6"), "c_h": F.expr("0.9D * home_score + 0.5D"), "c_a": F.expr("0.9D * away_score + 0.5D")})


def _mixsql() -> str:
    inv = {"TOP3_INVLOSS": 1.0, "TOP3_POWER_0.5": 0.5, "TOP3_POWER_1.5": 1.5, "TOP3_POWER_2.0": 2.0}
    arms = []
    for mode in P.MIXES:
        if mode == "TOP1":
            e = "CASE WHEN rk = 1 THEN 1.0 ELSE 0.0 END"
        elif mode == "TOP3_UNIFORM":
            e = "1.0"
        elif mode == "TOP2_INVLOSS":
            e = "CASE WHEN rk <= 2 THEN 1 / loss ELSE 0.0 END"
        else:
            e = f"pow(loss, -{inv[mode]})"
        arms.append(f"SELECT '{mode}' AS model_mix, member, CAST({e} AS DOUBLE) AS raw FROM ls")
    return " UNION ALL ".join(arms)


@register("d17_mix_lambdas", f"""WITH d AS (SELECT *, CAST(1 + k1 % 6 AS DOUBLE) AS b_h, CAST(1 + k2 % 6 AS DOUBLE) AS b_a, 0.9 * home_score + 0.5 AS c_h, 0.9 * away_score + 0.5 AS c_a FROM probs),
lo AS (SELECT UNNEST(['a', 'b', 'c']) AS member, UNNEST([avg((abs(lam_h - home_score) + abs(lam_a - away_score)) / 2), avg((abs(b_h - home_score) + abs(b_a - away_score)) / 2), avg((abs(c_h - home_score) + abs(c_a - away_score)) / 2)]) AS loss FROM d),
ls AS (SELECT *, row_number() OVER (ORDER BY loss, member) AS rk FROM lo), mx AS ({_mixsql()}), mw AS (SELECT model_mix, member, raw / SUM(raw) OVER (PARTITION BY model_mix) AS w FROM mx),
w AS (SELECT model_mix, MAX(CASE WHEN member = 'a' THEN w END) AS wa, MAX(CASE WHEN member = 'b' THEN w END) AS wb, MAX(CASE WHEN member = 'c' THEN w END) AS wc FROM mw GROUP BY 1),
st AS (SELECT avg(home_score) AS mh, avg(away_score) AS ma, GREATEST(0.0, LEAST(1.25, avg((home_score - lam_h) * (away_score - lam_a)))) AS cov FROM d),
sh AS (SELECT unnest([0.0, 0.05, 0.1, 0.2, 0.3]) AS mean_shrink), sc AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0, 1.25]) AS shared_scale),
e AS (SELECT model_mix, mean_shrink, avg((abs((1 - mean_shrink) * (wa * GREATEST(0.05, LEAST(15, lam_h)) + wb * b_h + wc * c_h) + mean_shrink * mh - home_score)
 + abs((1 - mean_shrink) * (wa * GREATEST(0.05, LEAST(15, lam_a)) + wb * b_a + wc * c_a) + mean_shrink * ma - away_score)) / 2) AS mae FROM d CROSS JOIN w CROSS JOIN st CROSS JOIN sh GROUP BY ALL)
SELECT model_mix, CAST(mean_shrink AS DOUBLE) AS mean_shrink, CAST(shared_scale AS DOUBLE) AS shared_scale, ROUND(mae, 7) AS score_mae, ROUND(shared_scale * cov, 7) AS shared FROM e CROSS JOIN sc CROSS JOIN st""")
def _(v: Views):
    return us(P.mix_variants(_lams(v), LAMS), digits=7)


@register("e43_variant_ranking", f"""WITH w AS (SELECT * FROM (VALUES {', '.join(f"('{a}:{b}:{c}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in COMBOS)}) AS t(name, w0, w1, w2)),
l AS (SELECT name, avg(-ln(CASE y WHEN 0 THEN w0 * p_home + w1 * q_home + w2 * r_home WHEN 1 THEN w0 * p_draw + w1 * q_draw + w2 * r_draw ELSE w0 * p_away + w1 * q_away + w2 * r_away END)) AS loss FROM probs CROSS JOIN w GROUP BY 1)
SELECT arg_min(name, (ROUND(loss, 12), name)) AS best_variant, count(*) AS finite_variant_count, ROUND(MAX(loss) - MIN(loss), 8) AS primary_spread FROM l""")
def _(v: Views):
    w = F.array(*[F.struct(F.lit(":".join(map(str, c))).alias("name"), *[F.lit(x).alias(f"w{i}") for i, x in enumerate(c)]) for c in P.weight_grid(3, 0.25)])
    wide = v.probs.select("y", *[f"{m}_{c}" for m in "pqr" for c in CLS], F.inline(w))
    b = P.blend_cols([[F.col(f"{m}_{c}") for c in CLS] for m in "pqr"], [F.col("w0"), F.col("w1"), F.col("w2")])
    losses = wide.groupBy("name").agg(F.avg(P.nll_cols(b, F.col("y"))).alias("loss"))
    return us(P.variant_ranking(losses, "loss", F.col("name")), digits=8)


REG = """tr AS (SELECT * FROM games WHERE ts < TIMESTAMP '1999-01-01'), q AS (SELECT quantile_cont(CAST(home_score - away_score AS DOUBLE), 0.33) AS s1, quantile_cont(CAST(home_score - away_score AS DOUBLE), 0.67) AS s2,
 quantile_cont(CAST(home_score + away_score AS DOUBLE), 0.33) AS e1, quantile_cont(CAST(home_score + away_score AS DOUBLE), 0.67) AS e2, quantile_cont(CAST(k1 % 100 AS DOUBLE), 0.33) AS m1, quantile_cont(CAST(k1 % 100 AS DOUBLE), 0.67) AS m2 FROM tr),
rg AS (SELECT game_id, 's' || CASE WHEN home_score - away_score < s1 THEN 0 WHEN home_score - away_score < s2 THEN 1 ELSE 2 END || '_e' || CASE WHEN home_score + away_score < e1 THEN 0 WHEN home_score + away_score < e2 THEN 1 ELSE 2 END
 || '_m' || CASE WHEN k1 % 100 < m1 THEN 0 WHEN k1 % 100 < m2 THEN 1 ELSE 2 END AS regime FROM games CROSS JOIN q)"""


def _regimes(v: Views):
    g = v.games.select("game_id", "ts", F.expr("double(home_score - away_score)").alias("strength"), F.expr("double(home_score + away_score)").alias("env"), F.expr("double(k1 % 100)").alias("maturity"))
    return P.regime_labels(g.filter("ts < TIMESTAMP '1999-01-01 00:00:00 UTC'"), g, {"s": "strength", "e": "env", "m": "maturity"}).select("game_id", "regime")


@register("d18_regime_labels", f"WITH {REG} SELECT game_id, regime FROM rg")
def _(v: Views):
    return _regimes(v)


NLL3 = "-ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)"


@register("d19_regime_weights", f"""WITH {REG}, pr AS (SELECT regime, model, SUM({NLL3}) AS s, count(*) AS n FROM preds JOIN rg USING (game_id) GROUP BY ALL), g AS (SELECT model, SUM(s) / SUM(n) AS g FROM pr GROUP BY 1),
j AS (SELECT regime, model, n, g, n / (n + 80.0) * s / n + (1 - n / (n + 80.0)) * g AS adj FROM pr JOIN g USING (model)),
u AS (SELECT *, CASE WHEN n >= 35 AND (MIN(g) OVER w - MIN(adj) OVER w) / GREATEST(MIN(g) OVER w, 1e-9) >= 0.03 THEN adj ELSE g END AS used FROM j WINDOW w AS (PARTITION BY regime))
SELECT regime, model, n AS rows, ROUND(1 / used / SUM(1 / used) OVER (PARTITION BY regime), 8) AS weight FROM u""")
def _(v: Views):
    losses = v.preds.select("game_id", "model", P.nll_cols([F.col(c) for c in ("p0", "p1", "p2")], F.col("y")).alias("loss")).join(_regimes(v), "game_id")
    return us(P.regime_weights(losses), digits=8)


def losses():
    return {m: P.nll_cols([F.col(c) for c in cols], F.col("y")) for m, cols in HDA.items()}


LSQL = {m: f"-ln(CASE y WHEN 0 THEN {c[0]} WHEN 1 THEN {c[1]} ELSE {c[2]} END)" for m, c in HDA.items()}
PAIRS = list(itertools.combinations(HDA, 2))
CORR = "c AS (" + " UNION ALL ".join(f"SELECT '{a}::{b}' AS pair, corr({LSQL[a]}, {LSQL[b]}) AS correlation FROM probs" for a, b in PAIRS) + ")"


@register("d20_error_redundancy", f"WITH {CORR} SELECT model, ROUND(GREATEST(0.0, LEAST(1.0, avg(correlation))), 8) AS redundancy FROM (SELECT unnest(string_split(pair, '::')) AS model, correlation FROM c) GROUP BY 1")
def _(v: Views):
    return us(P.error_redundancy(P.member_correlations(v.probs, losses())), digits=8)


def _errsql(c):
    return f"(CASE WHEN CASE WHEN {c[0]} >= {c[1]} AND {c[0]} >= {c[2]} THEN 0 WHEN {c[1]} >= {c[2]} THEN 1 ELSE 2 END <> y THEN 1 ELSE 0 END)"


@register("d20_error_correlation", " UNION ALL ".join(
    f"SELECT '{a}::{b}' AS pair, ROUND(corr({_errsql(HDA[a])}, {_errsql(HDA[b])}), 8) AS correlation, ROUND(avg({_errsql(HDA[a])} * {_errsql(HDA[b])}), 8) AS overlap FROM probs" for a, b in PAIRS))
def _(v: Views):
    errs = {m: (A.arg_max_cols([F.col(x) for x in c]) != F.col("y")).cast("int") for m, c in HDA.items()}
    return us(P.member_correlations(v.probs, errs, overlap=True), digits=8)


@register("d21_routing_weights", f"""WITH m AS (SELECT league, model, avg({NLL3}) AS loss, avg(p1) AS risk, avg(p0) AS fit FROM preds GROUP BY ALL), t AS (SELECT *, (-loss - 1.5 * risk + 0.35 * fit) / ((0.35 + 0.9 * 0.6) * 3.0) AS s FROM m),
e AS (SELECT *, exp(s - MAX(s) OVER (PARTITION BY league)) AS e FROM t)
SELECT league, model, ROUND(0.04 / 3 + (1 - 0.04) * e / SUM(e) OVER (PARTITION BY league), 8) AS weight FROM e""")
def _(v: Views):
    m = v.preds.groupBy("league", "model").agg(F.avg(P.nll_cols([F.col(c) for c in ("p0", "p1", "p2")], F.col("y"))).alias("loss"), F.avg("p1").alias("risk"), F.avg("p0").alias("fit"))
    return us(P.routing_weights(m, ["league"], F.lit(0.4), F.lit(0.2)).select("league", "model", "weight"), digits=8)


@register("d22_blend_run_share", """WITH s AS (SELECT game_id, lam_h + lam_a AS t, GREATEST(0.15, LEAST(0.85, 0.75 * lam_h / (lam_h + lam_a) + 0.25 * p_home / (p_home + p_away))) AS s FROM probs)
SELECT game_id, ROUND(t * s, 8) AS lam_home, ROUND(t * (1 - s), 8) AS lam_away FROM s""")
def _(v: Views):
    h, a = P.blend_run_share(lam("h"), lam("a"), F.col("p_home"), F.col("p_away"))
    return us(v.probs.select("game_id", h.alias("lam_home"), a.alias("lam_away")), digits=8)


@register("d22_structural_lambdas", f"""WITH {NUM}, f AS (SELECT *, {', '.join(f"COALESCE({over(f'avg({c})', 10)}, 0.0) AS {c}_10" for c in ('gf', 'ga'))} FROM r), z AS (SELECT league, entity, ts, gf_10, ga_10 FROM f WHERE {FIRST}),
j AS (SELECT g.game_id, h.gf_10 AS hf, h.ga_10 AS hg, a.gf_10 AS af, a.ga_10 AS ag, 3.0 + g.k1 % 3 AS hfip, 3.0 + g.k2 % 3 AS afip FROM games g JOIN z h ON h.league = g.league AND h.entity = g.home AND h.ts = g.ts JOIN z a ON a.league = g.league AND a.entity = g.away AND a.ts = g.ts)
SELECT game_id, ROUND(GREATEST(0.8, LEAST(6.0, (0.52 * (0.65 * hf + 0.35 * 4.5) + 0.48 * (0.65 * ag + 0.35 * 4.5)) * exp(0.07 * (afip - 4.0)) * 1.035)), 8) AS lam_home,
 ROUND(GREATEST(0.8, LEAST(6.0, (0.52 * (0.65 * af + 0.35 * 4.9) + 0.48 * (0.65 * hg + 0.35 * 4.9)) * exp(0.07 * (hfip - 4.0)))), 8) AS lam_away FROM j""")
def _(v: Views):
    form = T.rolling_form(v.entity_rows, (10,))
    m = T.match_features(v.games, form, ["gf_10", "ga_10"])
    h, a = P.structural_lambdas(F.col("h_gf_10"), F.col("h_ga_10"), F.col("a_gf_10"), F.col("a_ga_10"), F.lit(4.5), F.lit(4.9), F.expr("3D + k1 % 3"), F.expr("3D + k2 % 3"))
    return us(m.select("game_id", h.alias("lam_home"), a.alias("lam_away")), digits=8)


SCEN = {"base": 0.0, "home_up": 0.08, "away_up": -0.30}


def _shiftsql(s: str) -> str:
    h, d, a = f"GREATEST(p_home + {s}, 1e-6)", "GREATEST(p_draw, 1e-6)", f"GREATEST(p_away - ({s}), 1e-6)"
    z = f"({h} + {d} + {a})"
    return ", ".join(f"ROUND({x} / {z}, 8) AS {{0}}{c}" for x, c in ((h, "p_home"), (d, "p_draw"), (a, "p_away")))


@register("d26_scenario_forecast", " UNION ALL ".join(f"SELECT game_id, '{n}' AS scenario, {_shiftsql(str(s)).format('s_')}, ROUND(1.0 / 3, 8) AS weight FROM probs" for n, s in SCEN.items()))
def _(v: Views):
    out = P.scenario_forecast(v.probs.select("game_id", "p_home", "p_draw", "p_away"), ["p_home", "p_draw", "p_away"], SCEN)
    return us(out.drop("p_home", "p_draw", "p_away"), digits=8)


@register("d26_prediction_trajectory", " UNION ALL ".join(f"SELECT game_id, {h} AS horizon, {_shiftsql(f'((k1 % 5 - 2) * 0.1 * (1 - exp(-0.18 * {h})))').format('t_')} FROM probs" for h in (1, 3, 10)))
def _(v: Views):
    src = v.probs.select("game_id", "p_home", "p_draw", "p_away", F.expr("(k1 % 5 - 2) * 0.1D").alias("mom"))
    out = P.prediction_trajectory(src, ["p_home", "p_draw", "p_away"], F.col("mom"), (1, 3, 10))
    return us(out.drop("p_home", "p_draw", "p_away", "mom"), digits=8)


@register("d27_half_inning_baseline", """WITH d AS (SELECT league, ts, SUM(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS c0, SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS c1, SUM(CASE WHEN y = 2 THEN 1 ELSE 0 END) AS c2 FROM probs GROUP BY ALL),
s AS (SELECT league, ts, COALESCE(SUM(c0) OVER w, 0) AS c0, COALESCE(SUM(c1) OVER w, 0) AS c1, COALESCE(SUM(c2) OVER w, 0) AS c2 FROM d WINDOW w AS (PARTITION BY league ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT league, CAST(epoch_us(ts) AS BIGINT) AS ts_us, """ + ", ".join(f"ROUND((c{i} + 4.0) / (c0 + c1 + c2 + 12.0), 9) AS prior_{i}" for i in range(3)) + " FROM s")
def _(v: Views):
    return us(P.half_inning_baseline(v.probs, "y", ["league"]))


@register("d28_class_scale", "SELECT game_id, " + ", ".join(f"ROUND({e} / (p_home + 1.8 * p_draw + p_away), 8) AS {c}" for c, e in (("home", "p_home"), ("draw", "1.8 * p_draw"), ("away", "p_away"))) + " FROM probs")
def _(v: Views):
    return us(v.probs.select("game_id", *[c.alias(n) for n, c in zip(CLS, P.class_scale([F.col(f"p_{c}") for c in CLS], 1, 1.8))]), digits=8)


@register("d29_fallback_lambdas", "SELECT game_id, ROUND(COALESCE(CASE WHEN k1 % 4 > 0 THEN lam_h END, CASE WHEN league = 'N' THEN 2.35::DOUBLE ELSE 4.55::DOUBLE END), 8) AS lam_home, ROUND(COALESCE(CASE WHEN k1 % 4 > 0 THEN lam_a END, CASE WHEN league = 'N' THEN 2.35::DOUBLE ELSE 4.55::DOUBLE END), 8) AS lam_away FROM probs")
def _(v: Views):
    ok = F.expr("k1 % 4 > 0")
    h, a = P.fallback_lambdas(F.when(ok, lam("h")), F.when(ok, lam("a")), F.col("league") == "N")
    return us(v.probs.select("game_id", h.alias("lam_home"), a.alias("lam_away")), digits=8)


@register("a27_run_means", "SELECT league, ROUND(avg(home_score), 9) AS mean_home, ROUND(avg(away_score), 9) AS mean_away FROM games GROUP BY 1")
def _(v: Views):
    return us(P.run_means(v.games, ["league"]))


@register("k1_rank_events", """WITH r AS (SELECT *, CAST(ts AS DATE) AS day, GREATEST(p_home, p_away) AS wp, GREATEST(p_home, p_draw, p_away) AS top, p_home + p_draw + p_away - GREATEST(p_home, p_draw, p_away) - LEAST(p_home, p_draw, p_away) AS second FROM probs)
SELECT game_id, CASE WHEN p_home >= p_away THEN 'home' ELSE 'away' END AS winner, ROUND(wp, 8) AS winner_probability, ROUND(top - second, 8) AS confidence_margin,
 CASE WHEN top >= 0.65 AND ROUND(top - second, 12) >= 0.15 THEN 'HIGH' WHEN top >= 0.55 AND ROUND(top - second, 12) >= 0.08 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_status, row_number() OVER (PARTITION BY league, day ORDER BY wp DESC, game_id) AS winner_rank FROM r""")
def _(v: Views):
    p = v.probs.withColumn("day", F.to_date("ts"))
    out = P.rank_events(p, ["league", "day"], "p_home", "p_draw", "p_away")
    return us(out.select("game_id", "winner", "winner_probability", "confidence_margin", "confidence_status", F.col("winner_rank").cast("bigint").alias("winner_rank")), digits=8)


@register("k4_mom_topk", "SELECT * FROM (SELECT l_orderkey, l_partkey, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS INT) AS rank FROM lineitem) WHERE rank <= 3")
def _(v: Views):
    line = v.table("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    return P.top_k_per_key(line, ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_partkey")], 3)


@register("k5_chronological_sort", "SELECT game_id, row_number() OVER (ORDER BY ts, game_id) AS position FROM games")
def _(v: Views):
    from tideline.operators.ordered import row_numbers

    return row_numbers(v.games.select("game_id", "ts"), [], ["ts", "game_id"], out="position").select("game_id", "position")


@register("k6_fit_window_cap", "SELECT game_id, home_score, away_score FROM games ORDER BY ts DESC, game_id DESC LIMIT 1800")
def _(v: Views):
    return v.games.orderBy(F.desc("ts"), F.desc("game_id")).limit(1800).select("game_id", "home_score", "away_score")


@register("k7_candidate_select", """WITH c AS (SELECT entity_id, source AS name, ROUND(avg(value), 6) / 20 AS gain, CAST(count(*) / 20.0 AS DOUBLE) AS cost, AVG(event_id % 3) AS risk FROM ledger GROUP BY ALL),
v AS (SELECT entity_id, name, gain - cost - 0.5 * risk AS v FROM c)
SELECT entity_id, CASE WHEN MAX(v) > 0 THEN arg_max(name, (v, name)) END AS selected, ROUND(GREATEST(MAX(v), 0.0), 9) AS expected_net_value FROM v GROUP BY 1""")
def _(v: Views):
    c = v.ledger.groupBy("entity_id", F.col("source").alias("name")).agg((F.round(F.avg("value"), 6) / 20).alias("gain"), (F.count(F.lit(1)) / 20.0).alias("cost"), F.avg(F.expr("event_id % 3")).alias("risk"))
    return us(P.candidate_select(c, ["entity_id"]), digits=9)


@register("k8_due_events", """SELECT o_orderkey, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-06-01 06:00:00')) / 60e6 AS lead_minutes FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-01 06:00:00'
 AND (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-06-01 06:00:00')) / 60e6 <= 86400 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)""")
def _(v: Views):
    sched = v.table("orders").select("o_orderkey", F.col("o_orderdate").alias("start_at"))
    archived = v.table("lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return P.due_events(sched, archived, "o_orderkey", F.expr("TIMESTAMP '1998-06-01 06:00:00 UTC'"), 0, 86400).select("o_orderkey", "lead_minutes")
