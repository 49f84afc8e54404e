"""Queries over the evaluation operators."""

import itertools

from pyspark.sql import functions as F

from tideline.functions import arrays as A
from tideline.functions import poisson as S
from tideline.functions.scalars import local_date
from tideline.operators import evaluate as E
from tideline.operators import joins as J
from tideline.operators import ordered as O
from tideline.operators import prob as P
from tideline.operators.retrieval import retrieval_conformal
from tideline.plans.catalog import register
from tideline.plans.q_prob import BIV
from tideline.plans.q_timeline import us
from tideline.plans.views import MODELS, Views

M = {m: list(c) for m, c in MODELS.items()}
P3 = ["p0", "p1", "p2"]
TOPSQL = "CASE WHEN {0} >= {1} AND {0} >= {2} THEN 0 WHEN {1} >= {2} THEN 1 ELSE 2 END"
NLLSQL = "-ln(CASE y WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE {2} END)"
BRSQL = "pow({0} - CASE WHEN y = 0 THEN 1 ELSE 0 END, 2) + pow({1} - CASE WHEN y = 1 THEN 1 ELSE 0 END, 2) + pow({2} - CASE WHEN y = 2 THEN 1 ELSE 0 END, 2)"


def bundle(src: str, keys: str, p=P3, digits: int = 8) -> str:
    k = f"{keys}, " if keys else ""
    conf = f"GREATEST({', '.join(p)})"
    return f"""s AS (SELECT {k}CASE WHEN {TOPSQL.format(*p)} = y THEN 1 ELSE 0 END AS hit, {conf} AS conf, LEAST(floor({conf} * 10), 9) AS bin, {NLLSQL.format(*p)} AS nll, {BRSQL.format(*p)} AS br FROM {src}),
b AS (SELECT {k}bin, count(*) AS n, SUM(hit) AS hit, SUM(conf) AS conf, SUM(nll) AS nll, SUM(br) AS br FROM s GROUP BY ALL),
m AS (SELECT {k}CAST(SUM(n) AS BIGINT) AS rows, SUM(hit) / SUM(n) AS accuracy, SUM(nll) / SUM(n) AS log_loss, SUM(br) / SUM(n) AS brier, SUM(abs(conf - hit)) / SUM(n) AS ece FROM b {'GROUP BY ALL' if keys else ''})"""


def rounded(*cols: str, digits: int = 8) -> str:
    return ", ".join(f"ROUND({c}, {digits}) AS {c}" for c in cols)


FOUR = rounded("accuracy", "log_loss", "brier", "ece")


@register("e1_classification_metrics", f"WITH {bundle('preds', 'model, league')} SELECT model, league, rows, {FOUR} FROM m")
def _(v: Views):
    return us(E.classification_metrics(v.preds, P3, "y", ["model", "league"]), digits=8)


@register("e2_ece", """WITH s AS (SELECT model, LEAST(floor(GREATEST(p0, p1, p2) * 10), 9) AS bin, GREATEST(p0, p1, p2) AS conf, CASE WHEN CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END = y THEN 1 ELSE 0 END AS hit FROM preds)
SELECT model, CAST(bin AS BIGINT) AS bin, count(*) AS n, ROUND(avg(conf), 8) AS mean_confidence, ROUND(avg(hit), 8) AS accuracy FROM s GROUP BY ALL""")
def _(v: Views):
    cols = [F.col(c) for c in P3]
    s = v.preds.select("model", E.bin_of(F.greatest(*cols)).alias("bin"), F.greatest(*cols).alias("c"), (A.arg_max_cols(cols) == F.col("y")).cast("int").alias("h"))
    return us(s.groupBy("model", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("c").alias("mean_confidence"), F.avg("h").alias("accuracy")), digits=8)


@register("a17_group_leaderboard", f"WITH {bundle('preds', 'model')} SELECT model, rows, {FOUR} FROM m")
def _(v: Views):
    return us(E.group_leaderboard(v.preds, P3, "y", "model"), digits=8)


@register("a20_performance_hierarchy", "WITH h AS (SELECT league, stage, CAST(home % 3 AS INT) AS phase, y, p_home AS p0, p_draw AS p1, p_away AS p2 FROM probs), " + ", ".join(
    bundle('h', k).replace("s AS", f"s{i} AS").replace("\nb AS", f"\nb{i} AS").replace("\nm AS", f"\nm{i} AS").replace("FROM s GROUP", f"FROM s{i} GROUP").replace("FROM b ", f"FROM b{i} ")
    for i, k in enumerate(("", "league", "league, stage", "league, stage, phase"))) + " " + " UNION ALL ".join(
    f"SELECT {i} AS level, {l} AS league, {s} AS stage, {ph} AS phase, rows, {FOUR} FROM m{i}" for i, (l, s, ph) in enumerate(
        (("NULL", "NULL", "NULL"), ("league", "NULL", "NULL"), ("league", "stage", "NULL"), ("league", "stage", "phase")))))
def _(v: Views):
    df = v.probs.withColumn("phase", F.expr("int(home % 3)"))
    return us(E.performance_hierarchy(df, M["m1"], "y", ["league", "stage", "phase"]), digits=8)


@register("a22_competition_metrics", f"WITH h AS (SELECT league || '-' || stage AS competition_key, y, p_home AS p0, p_draw AS p1, p_away AS p2 FROM probs), {bundle('h', 'competition_key')} SELECT competition_key, rows, {FOUR} FROM m")
def _(v: Views):
    return us(E.classification_metrics(v.probs.withColumn("competition_key", F.concat_ws("-", "league", "stage")), M["m1"], "y", ["competition_key"]), digits=8)


PH = "(1.0 - 1.0 / (1 + exp(0.2 * (lam_h + lam_a - 6))))"


@register("e3_binary_metrics", f"""WITH b AS (SELECT league, GREATEST(1e-9, LEAST(1 - 1e-9, {PH})) AS p, CASE WHEN home_score + away_score >= 7 THEN 1 ELSE 0 END AS y FROM probs)
SELECT league, count(*) AS rows, ROUND(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1 ELSE 0 END), 8) AS accuracy, ROUND(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 8) AS log_loss, ROUND(avg(pow(p - y, 2)), 8) AS brier, ROUND(avg(y), 8) AS positive_rate FROM b GROUP BY 1""")
def _(v: Views):
    return us(E.binary_metrics(v.probs, F.expr(PH.replace("1.0", "1D").replace("0.2", "0.2D")), F.expr("int(home_score + away_score >= 7)"), ["league"]), digits=8)


@register("e4_score_metrics", """WITH s AS (SELECT league, lam_h AS ph, lam_a AS pa, home_score AS h, away_score AS a FROM probs)
SELECT league, count(*) AS rows, ROUND(avg(abs(ph - h)), 8) AS mae_home, ROUND(avg(abs(pa - a)), 8) AS mae_away, ROUND(avg(abs(ph + pa - h - a)), 8) AS mae_total, ROUND(sqrt(avg(pow(ph + pa - h - a, 2))), 8) AS rmse_total,
 ROUND(avg(CASE WHEN round_even(ph, 0) = h AND round_even(pa, 0) = a THEN 1 ELSE 0 END), 8) AS exact_rate, ROUND(avg(CASE WHEN abs(ph - h) <= 1 AND abs(pa - a) <= 1 THEN 1 ELSE 0 END), 8) AS within_one_rate FROM s GROUP BY 1""")
def _(v: Views):
    return us(E.score_metrics(v.probs, F.col("lam_h"), F.col("lam_a"), F.col("home_score"), F.col("away_score"), ["league"]), digits=8)


BIVTOP = BIV + """, rk AS (SELECT *, row_number() OVER (PARTITION BY lam_h, lam_a ORDER BY ROUND(p, 12) DESC, i, j) AS rk FROM gr),
h AS (SELECT league, probs.lam_h, probs.lam_a, home_score, away_score, MAX(CASE WHEN rk = 1 THEN p END) AS p1, MAX(CASE WHEN rk = 1 AND i = home_score AND j = away_score THEN 1 ELSE 0 END) AS t1,
 MAX(CASE WHEN i = home_score AND j = away_score THEN 1 ELSE 0 END) AS t4, game_id FROM probs JOIN rk ON rk.lam_h = probs.lam_h AND rk.lam_a = probs.lam_a AND rk.rk <= 4 GROUP BY ALL)"""


@register("e5_top4_metrics", f"WITH {BIVTOP} SELECT league, count(*) AS rows, ROUND(avg(t1), 8) AS top1_hit_rate, ROUND(avg(t4), 8) AS top4_hit_rate, ROUND(avg(abs(p1 - t1)), 8) AS top1_probability_mae FROM h GROUP BY 1")
def _(v: Views):
    s = v.probs.select("league", "home_score", "away_score", "lam_h", "lam_a").withColumn("s", S.grid_summary(F.col("lam_h"), F.col("lam_a"), F.lit(0.3)))
    return us(E.top4_metrics(s, F.col("s.scores"), F.col("s.probabilities")[0], F.concat_ws("-", "home_score", "away_score"), ["league"]), digits=8)


@register("e6_row_evaluation", f"""WITH e AS (SELECT *, {TOPSQL.format('p_home', 'p_draw', 'p_away')} AS top, {PH} AS ph FROM probs)
SELECT game_id, ['HOME_WIN', 'DRAW', 'AWAY_WIN'][y + 1] AS actual_outcome, ['HOME_WIN', 'DRAW', 'AWAY_WIN'][top + 1] AS predicted_outcome, CASE WHEN top = y THEN 1 ELSE 0 END AS outcome_correct, ROUND({NLLSQL.format('p_home', 'p_draw', 'p_away')}, 8) AS log_loss,
 ROUND({BRSQL.format('p_home', 'p_draw', 'p_away')}, 8) AS brier, CASE WHEN home_score + away_score >= 7 THEN 1 ELSE 0 END AS low_high_actual, CASE WHEN ph >= 0.5 THEN 1 ELSE 0 END AS low_high_predicted, CASE WHEN (ph >= 0.5) = (home_score + away_score >= 7) THEN 1 ELSE 0 END AS low_high_correct FROM e""")
def _(v: Views):
    out = E.row_evaluation(v.probs, M["m1"], F.expr(PH.replace("1.0", "1D").replace("0.2", "0.2D")))
    return us(out.select("game_id", "actual_outcome", "predicted_outcome", "outcome_correct", "log_loss", "brier", "low_high_actual", "low_high_predicted", "low_high_correct"), digits=8)


@register("e7_target_bundle", "SELECT model, count(*) AS rows, " + ", ".join(
    f"ROUND(avg(CASE WHEN GREATEST(p0, p1, p2) >= {t} THEN 1 ELSE 0 END), 8) AS coverage_{round(t * 100)}, ROUND(avg(CASE WHEN GREATEST(p0, p1, p2) >= {t} THEN CASE WHEN {TOPSQL.format(*P3)} = y THEN 1 ELSE 0 END END), 8) AS accuracy_{round(t * 100)}" for t in (.6, .7, .8, .9)) + " FROM preds GROUP BY 1")
def _(v: Views):
    return us(E.target_bundle(v.preds, P3, "y", ["model"]), digits=8)


@register("e8_selective_prediction", f"SELECT model, ROUND(avg(CASE WHEN 1 - GREATEST(p0, p1, p2) < 0.55 THEN 1 ELSE 0 END), 8) AS coverage, ROUND(avg(CASE WHEN 1 - GREATEST(p0, p1, p2) < 0.55 THEN CASE WHEN {TOPSQL.format(*P3)} = y THEN 1 ELSE 0 END END), 8) AS selective_accuracy FROM preds GROUP BY 1")
def _(v: Views):
    cols = [F.col(c) for c in P3]
    return us(E.selective_prediction(v.preds, A.arg_max_cols(cols) == F.col("y"), 1 - F.greatest(*cols), 0.55, ["model"]), digits=8)


REVS = """rv AS (SELECT event_id, CAST(user_id AS VARCHAR) AS game_id, ts AS cutoff, 1.0 + event_id % 5 AS a, 1.0 + event_id % 3 AS b, 1.0 + event_id % 7 AS c FROM events),
rp AS (SELECT *, 100.0 * a / (a + b + c) AS h, 100.0 * b / (a + b + c) AS d, 100.0 * c / (a + b + c) AS w FROM rv),
rl AS (SELECT *, lag(event_id) OVER win AS pid, lag(h) OVER win AS ph, lag(d) OVER win AS pd, lag(w) OVER win AS pw FROM rp WINDOW win AS (PARTITION BY game_id ORDER BY cutoff, event_id)),
rm AS (SELECT event_id, game_id, CASE WHEN pid IS NULL THEN 'INITIAL' ELSE 'REVISED' END AS revision_status, CAST(COALESCE(pid, -1) AS BIGINT) AS previous_id, abs(h - ph) + abs(d - pd) + abs(w - pw) AS revision_l1,
 GREATEST(abs(h - ph), abs(d - pd), abs(w - pw)) AS revision_max, pid IS NOT NULL AND COALESCE(CASE WHEN h >= d AND h >= w THEN 0 WHEN d >= w THEN 1 ELSE 2 END <> CASE WHEN ph >= pd AND ph >= pw THEN 0 WHEN pd >= pw THEN 1 ELSE 2 END, FALSE) AS revision_outcome_changed FROM rl)"""


def revisions(v: Views):
    from tideline.operators.experience import revision_metadata

    e = v.table("events").select("event_id", F.col("user_id").cast("string").alias("game_id"), F.col("ts").alias("cutoff"),
                                 F.expr("1D + event_id % 5").alias("a"), F.expr("1D + event_id % 3").alias("b"), F.expr("1D + event_id % 7").alias("c"))
    t = F.col("a") + F.col("b") + F.col("c")
    e = e.withColumns({n: 100.0 * F.col(x) / t for n, x in (("h", "a"), ("d", "b"), ("w", "c"))})
    return revision_metadata(e, ["h", "d", "w"], "game_id", "cutoff", "event_id")


@register("w30_revision_metadata", f"WITH {REVS} SELECT event_id, revision_status, previous_id, ROUND(revision_l1, 8) AS revision_l1, ROUND(revision_max, 8) AS revision_max, revision_outcome_changed FROM rm")
def _(v: Views):
    out = revisions(v)
    return us(out.select("event_id", "revision_status", F.coalesce("previous_id", F.lit(-1)).alias("previous_id"), "revision_l1", "revision_max", "revision_outcome_changed"), digits=8)


@register("e9_revision_metrics", f"""WITH {REVS} SELECT count(*) AS eligible_rows, CAST(SUM(CASE WHEN revision_status = 'REVISED' THEN 1 ELSE 0 END) AS BIGINT) AS revised_rows, ROUND(avg(CASE WHEN revision_status = 'REVISED' THEN 1 ELSE 0 END), 8) AS revision_rate,
 ROUND(avg(CASE WHEN revision_status = 'REVISED' THEN CASE WHEN revision_outcome_changed THEN 1 ELSE 0 END END), 8) AS outcome_reversal_rate, ROUND(avg(revision_l1), 6) AS mean_l1, ROUND(MAX(revision_l1), 6) AS maximum_l1, ROUND(quantile_cont(revision_l1, 0.5), 6) AS median_l1 FROM rm""")
def _(v: Views):
    out = us(E.revision_metrics(revisions(v)), digits=8)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_l1", "maximum_l1", "median_l1")})


@register("e9_timing_metrics", """WITH l AS (SELECT source, (epoch_us(prediction_cutoff) - epoch_us(retrieved_at)) / 60e6 AS lead, (epoch_us(prediction_cutoff) - epoch_us(source_timestamp)) / 60e6 AS planned FROM ledger)
SELECT source, count(*) AS eligible_rows, CAST(SUM(CASE WHEN lead >= 60 THEN 1 ELSE 0 END) AS BIGINT) AS on_time_rows, ROUND(avg(CASE WHEN lead >= 60 THEN 1 ELSE 0 END), 8) AS compliance_rate, ROUND(MIN(lead), 6) AS min_lead, ROUND(MAX(lead), 6) AS max_lead,
 CAST(SUM(CASE WHEN planned < 60 THEN 1 ELSE 0 END) AS BIGINT) AS scheduled_below_required, ROUND(quantile_cont(lead, 0.5), 6) AS median_lead FROM l GROUP BY 1""")
def _(v: Views):
    out = E.timing_metrics(v.ledger, "prediction_cutoff", "retrieved_at", "source_timestamp", ["source"], 60)
    return out.withColumns({c: F.round(c, 8 if c == "compliance_rate" else 6) for c in ("compliance_rate", "min_lead", "max_lead", "median_lead")})


@register("e10_audit", f"""WITH r AS (SELECT game_id, home_score, away_score FROM games WHERE k3 % 3 > 0), j AS (SELECT p.*, r.game_id IS NOT NULL AS matched FROM probs p LEFT JOIN r USING (game_id)), x AS (SELECT * FROM j WHERE matched)
SELECT count(*) AS matched_rows, CAST((SELECT count(*) FROM j WHERE NOT matched) AS BIGINT) AS unmatched_predictions, CAST(0 AS BIGINT) AS unmatched_results, ROUND(avg(CASE WHEN {TOPSQL.format('p_home', 'p_draw', 'p_away')} = y THEN 1 ELSE 0 END), 8) AS accuracy, ROUND(avg({NLLSQL.format('p_home', 'p_draw', 'p_away')}), 8) AS log_loss,
 ROUND(SUM(CASE WHEN {TOPSQL.format('p_home', 'p_draw', 'p_away')} = 1 AND y = 1 THEN 1 ELSE 0 END) / GREATEST(1, SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END)), 8) AS draw_recall, ROUND(avg(abs(p_home - CASE WHEN y = 0 THEN 1 ELSE 0 END)), 8) AS home_probability_mae FROM x""")
def _(v: Views):
    pred = v.probs.select("game_id", *M["m1"])
    res = v.probs.filter("k3 % 3 > 0").select("game_id", "y")
    j = J.reconcile(pred, res, ["game_id"])
    cols = [F.col(c) for c in M["m1"]]
    ok = F.col("match_status") == "MATCHED"
    top = A.arg_max_cols(cols)
    out = j.agg(F.sum(ok.cast("int")).alias("matched_rows"), F.sum((F.col("match_status") == "PREDICTION_ONLY").cast("int")).alias("unmatched_predictions"),
                F.sum((F.col("match_status") == "RESULT_ONLY").cast("int")).alias("unmatched_results"), F.avg(F.when(ok, (top == F.col("y")).cast("int"))).alias("accuracy"),
                F.avg(F.when(ok, P.nll_cols(cols, F.col("y")))).alias("log_loss"),
                (F.sum(F.when(ok & (top == 1) & (F.col("y") == 1), 1).otherwise(0)) / F.greatest(F.lit(1), F.sum(F.when(ok & (F.col("y") == 1), 1).otherwise(0)))).alias("draw_recall"),
                F.avg(F.when(ok, F.abs(cols[0] - (F.col("y") == 0).cast("int")))).alias("home_probability_mae"))
    return us(out, digits=8)


@register("e11_baseline_vs_base_rate", "SELECT league, count(*) AS n_samples, ROUND(avg(CASE WHEN (p_home > 0.5) = (y = 0) THEN 1 ELSE 0 END), 8) AS elo_accuracy, ROUND(avg(CASE WHEN y = 0 THEN 1 ELSE 0 END), 8) AS base_rate, ROUND(avg(CASE WHEN (p_home > 0.5) = (y = 0) THEN 1 ELSE 0 END) - avg(CASE WHEN y = 0 THEN 1 ELSE 0 END), 8) AS elo_improvement FROM probs GROUP BY 1")
def _(v: Views):
    return us(E.baseline_vs_base_rate(v.probs, F.col("p_home"), (F.col("y") == 0).cast("int"), ["league"]), digits=8)


DRAWS = """d AS (SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, ROUND(p_draw, 9) AS p, CASE WHEN y = 1 THEN 1 ELSE 0 END AS hit, game_id FROM probs),
dd AS (SELECT day, row_number() OVER (ORDER BY day) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM d)),
sp AS (SELECT day, CASE WHEN rn <= GREATEST(1, LEAST(n - 1, floor(ROUND(n * 0.7, 9)))) THEN 'DEV' ELSE 'HOLDOUT' END AS split FROM dd),
pk AS (SELECT d.day, split, arg_max(p, (p, game_id)) AS p, arg_max(hit, (p, game_id)) AS hit FROM d JOIN sp USING (day) GROUP BY ALL),
th AS (SELECT i / 100.0 AS threshold FROM (SELECT unnest(range(1, 31)) AS i)),
sc AS (SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) AS slates, avg(hit) AS hit_rate, avg(pow(p - hit, 2)) AS brier, avg(p) AS mean_probability FROM pk CROSS JOIN th WHERE split = 'DEV' AND p >= threshold GROUP BY 1)"""


def _draws(v: Views):
    d = v.probs.select(local_date(F.col("ts"), "Asia/Tokyo").cast("string").alias("day"), F.round("p_draw", 9).alias("p"), (F.col("y") == 1).cast("int").alias("hit"), "game_id")
    return E.date_split(d, "day")


@register("e12_draw_threshold_scan", f"WITH {DRAWS} SELECT threshold, slates, {rounded('hit_rate', 'brier', 'mean_probability')} FROM sc")
def _(v: Views):
    return us(E.draw_threshold_scan(_draws(v).filter("split = 'DEV'"), "day", "p", "hit", [i / 100 for i in range(1, 31)]), digits=8)


@register("e12_draw_holdout", f"""WITH {DRAWS}, b AS (SELECT threshold FROM sc ORDER BY ROUND(brier, 12), -ROUND(hit_rate, 12), threshold LIMIT 1)
SELECT b.threshold, count(*) AS slates, ROUND(avg(hit), 8) AS hit_rate, ROUND(avg(pow(p - hit, 2)), 8) AS brier, ROUND(avg(p), 8) AS mean_probability FROM pk JOIN b ON p >= b.threshold WHERE split = 'HOLDOUT' GROUP BY 1""")
def _(v: Views):
    d = _draws(v)
    scan = E.draw_threshold_scan(d.filter("split = 'DEV'"), "day", "p", "hit", [i / 100 for i in range(1, 31)])
    best = scan.orderBy(F.round("brier", 12), -F.round("hit_rate", 12), "threshold").limit(1).select("threshold")
    hold = E.draw_threshold_scan(d.filter("split = 'HOLDOUT'"), "day", "p", "hit", [i / 100 for i in range(1, 31)])
    return us(hold.join(best, "threshold"), digits=8)


@register("e13_time_split", "WITH r AS (SELECT game_id, row_number() OVER (PARTITION BY league ORDER BY ts, game_id) AS rn, count(*) OVER (PARTITION BY league) AS n FROM games) SELECT game_id, " + " + ".join(
    f"CASE WHEN rn > floor(ROUND(n * {f}, 9)) THEN 1 ELSE 0 END" for f in (0.45, 0.65, 0.8)) + ' AS "window" FROM r')
def _(v: Views):
    return E.time_split(v.games.select("league", "ts", "game_id"), (0.45, 0.65, 0.8), ["ts", "game_id"], ["league"]).select("game_id", "window")


@register("e15_validation_splits", "WITH r AS (SELECT game_id, row_number() OVER (ORDER BY ts, game_id) AS rn, count(*) OVER () AS n FROM games) SELECT game_id, rn > floor(ROUND(n * 0.7, 9)) AS in_validation_1, rn > floor(ROUND(n * 0.86, 9)) AS in_validation_2 FROM r")
def _(v: Views):
    w = E.time_split(v.games.select("ts", "game_id"), (0.7, 0.86), ["ts", "game_id"])
    return w.select("game_id", (F.col("window") >= 1).alias("in_validation_1"), (F.col("window") >= 2).alias("in_validation_2"))


@register("e13_date_split", """WITH dd AS (SELECT day, row_number() OVER (ORDER BY day) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM games))
SELECT game_id, CASE WHEN rn <= floor(ROUND(n * 0.7, 9)) THEN 'DEV' ELSE 'HOLDOUT' END AS split FROM games JOIN dd ON dd.day = CAST(ts AS DATE)""")
def _(v: Views):
    return E.date_split(v.games.select("game_id", F.to_date("ts").cast("string").alias("day")), "day").select("game_id", "split")


CAL = "TIMESTAMP '1999-06-01'"


def _conf_sql(group: str, minimum: int) -> str:
    return f"""WITH c AS (SELECT league, stage, home, CAST({group} AS VARCHAR) AS g, 1.0 - CASE y WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END AS s FROM probs WHERE ts < {CAL}),
a AS (SELECT g, s FROM c WHERE g <> '*' UNION ALL SELECT '*', s FROM c), z AS (SELECT g, count(*) AS n FROM a GROUP BY 1), cs AS (SELECT g, s, count(*) AS c FROM a GROUP BY ALL),
t AS (SELECT game_id, CAST({group} AS VARCHAR) AS own, y, p_home, p_draw, p_away FROM probs WHERE ts >= {CAL}), k AS (SELECT t.*, COALESCE(CASE WHEN n >= {minimum} THEN own END, '*') AS g FROM t LEFT JOIN z ON z.g = own),
l AS (SELECT game_id, g, UNNEST([0, 1, 2]) AS cls, UNNEST([1.0 - p_home, 1.0 - p_draw, 1.0 - p_away]) AS th FROM k), dt AS (SELECT DISTINCT g, th FROM l),
u AS (SELECT g, s AS v, c FROM cs UNION ALL SELECT g, th, 0 FROM dt), uu AS (SELECT g, v, SUM(c) AS c FROM u GROUP BY ALL), cu AS (SELECT g, v, SUM(c) OVER (PARTITION BY g ORDER BY v) - c AS below FROM uu),
p AS (SELECT l.game_id, l.cls, (1.0 + n - below) / (n + 1.0) AS p FROM l JOIN cu ON cu.g = l.g AND cu.v = l.th JOIN z ON z.g = l.g),
w AS (SELECT k.game_id, k.y, k.p_home, k.p_draw, k.p_away, k.g = '*' AS fallback, CAST(MAX(CASE WHEN cls = 0 THEN p END) AS DOUBLE) AS pv0, CAST(MAX(CASE WHEN cls = 1 THEN p END) AS DOUBLE) AS pv1, CAST(MAX(CASE WHEN cls = 2 THEN p END) AS DOUBLE) AS pv2 FROM k JOIN p USING (game_id) GROUP BY ALL),
f AS (SELECT *, concat_ws(',', CASE WHEN pv0 > 0.1 THEN '0' END, CASE WHEN pv1 > 0.1 THEN '1' END, CASE WHEN pv2 > 0.1 THEN '2' END) AS "set", (CASE WHEN pv0 > 0.1 THEN 1 ELSE 0 END) + (CASE WHEN pv1 > 0.1 THEN 1 ELSE 0 END) + (CASE WHEN pv2 > 0.1 THEN 1 ELSE 0 END) AS set_size FROM w)"""


ACTION = "CASE set_size WHEN 0 THEN 'ABSTAIN' WHEN 1 THEN 'SINGLE' ELSE 'SET' END AS action"


def _conformal(v: Views, group=None, minimum=30):
    src = v.probs if group is None else v.probs.withColumn("_g", group)
    cut = F.expr(CAL.replace("01'", "01 00:00:00 UTC'"))
    cal, test = src.filter(F.col("ts") < cut), src.filter(F.col("ts") >= cut)
    pv = E.conformal_pvalues(cal, test, M["m1"], "y", "game_id", None if group is None else "_g", minimum)
    return E.prediction_set(pv, 3)


@register("e20_split_conformal", _conf_sql("'*'", 10**9) + f' SELECT game_id, ROUND(pv0, 9) AS pv0, ROUND(pv1, 9) AS pv1, ROUND(pv2, 9) AS pv2, "set", set_size, {ACTION} FROM f')
def _(v: Views):
    return us(_conformal(v).drop("fallback"))


@register("e20_group_split_conformal", _conf_sql("home * 100 + k1 % 20", 40) + f' SELECT game_id, fallback, ROUND(pv0, 9) AS pv0, ROUND(pv1, 9) AS pv1, ROUND(pv2, 9) AS pv2, "set", set_size, {ACTION} FROM f')
def _(v: Views):
    return us(_conformal(v, F.expr("home * 100 + k1 % 20"), 40))


@register("e24_set_metrics", _conf_sql("'*'", 10**9) + f""" SELECT count(*) AS n_test, ROUND(avg(CASE WHEN contains("set", CAST(y AS VARCHAR)) THEN 1 ELSE 0 END), 8) AS set_coverage, ROUND(avg(set_size), 8) AS mean_set_size, ROUND(avg(CASE WHEN set_size = 1 THEN 1 ELSE 0 END), 8) AS singleton_rate,
 ROUND(avg(CASE WHEN set_size = 1 THEN CASE WHEN {TOPSQL.format('p_home', 'p_draw', 'p_away')} = y THEN 1 ELSE 0 END END), 8) AS singleton_accuracy, ROUND(avg(CASE WHEN set_size = 0 THEN 1 ELSE 0 END), 8) AS empty_rate FROM f""")
def _(v: Views):
    sets = _conformal(v).join(v.probs.select("game_id", "y", *M["m1"]), "game_id")
    return us(E.set_metrics(sets, "y", A.arg_max_cols([F.col(c) for c in M["m1"]])), digits=8)


@register("e21_quantile_conformal", f"""WITH s AS (SELECT 1.0 - CASE y WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END AS s FROM probs WHERE ts < {CAL}), o AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS r, count(*) OVER () AS n FROM s),
q AS (SELECT MIN(s) AS th FROM o WHERE r >= ceil(ROUND(LEAST(1.0, ceil((n + 1) * 0.9) / n) * (n - 1), 9))),
t AS (SELECT game_id, (p_home >= 1 - th - 1e-12 OR top = 0) AS i0, (p_draw >= 1 - th - 1e-12 OR top = 1) AS i1, (p_away >= 1 - th - 1e-12 OR top = 2) AS i2 FROM (SELECT *, {TOPSQL.format('p_home', 'p_draw', 'p_away')} AS top FROM probs WHERE ts >= {CAL}) CROSS JOIN q)
SELECT game_id, concat_ws(',', CASE WHEN i0 THEN '0' END, CASE WHEN i1 THEN '1' END, CASE WHEN i2 THEN '2' END) AS "set", CAST(i0 AS INT) + CAST(i1 AS INT) + CAST(i2 AS INT) AS set_size FROM t""")
def _(v: Views):
    cut = F.expr(CAL.replace("01'", "01 00:00:00 UTC'"))
    return E.quantile_conformal(v.probs.filter(F.col("ts") < cut), v.probs.filter(F.col("ts") >= cut), M["m1"], "y").select("game_id", "set", "set_size")


WF = "c AS (SELECT league, game_id, p_home, p_draw, p_away, epoch_us(ts) AS t, epoch_us(ts) + 2 * 86400000000 AS m, 1.0 - CASE y WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END AS s FROM probs)"


@register("e22_walk_forward_conformal", f"""WITH {WF}, f AS (SELECT league, m, s, count(*) AS n FROM c GROUP BY ALL), q AS (SELECT DISTINCT league, t, p_home, p_draw, p_away FROM c),
n AS (SELECT q.*, SUM(f.n) AS n, SUM(CASE WHEN f.s >= 1.0 - p_home THEN f.n ELSE 0 END) AS a0, SUM(CASE WHEN f.s >= 1.0 - p_draw THEN f.n ELSE 0 END) AS a1, SUM(CASE WHEN f.s >= 1.0 - p_away THEN f.n ELSE 0 END) AS a2 FROM q JOIN f ON f.league = q.league AND f.m <= q.t GROUP BY ALL)
SELECT c.game_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS calibration_count, {', '.join(f'ROUND(CASE WHEN n.n >= 30 THEN (1.0 + a{i}) / (n.n + 1.0) END, 9) AS pv{i}' for i in range(3))} FROM c LEFT JOIN n ON n.league = c.league AND n.t = c.t AND n.p_home = c.p_home AND n.p_draw = c.p_draw AND n.p_away = c.p_away""")
def _(v: Views):
    src = v.probs.withColumn("outcome_at", F.expr("ts + INTERVAL 2 DAYS"))
    out = E.walk_forward_conformal(src, M["m1"], "y", "game_id", ["league"], "ts", "outcome_at")
    return us(out.select("game_id", "calibration_count", "pv0", "pv1", "pv2"))


@register("w34_predictability_series", """WITH c AS (SELECT league, game_id, epoch_us(ts) AS t, GREATEST(p_home, p_draw, p_away) AS conf, CASE WHEN CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 0 WHEN p_draw >= p_away THEN 1 ELSE 2 END = y THEN 1 ELSE 0 END AS ok FROM probs),
f AS (SELECT league, t, conf, count(*) AS n, SUM(ok) AS ok FROM c GROUP BY ALL), q AS (SELECT DISTINCT league, t, conf FROM c),
n AS (SELECT q.*, SUM(f.n) AS n, SUM(f.ok) AS h FROM q JOIN f ON f.league = q.league AND f.t < q.t AND f.conf >= q.conf - 0.1 AND f.conf <= q.conf + 0.1 GROUP BY ALL)
SELECT c.game_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS history_count, ROUND((COALESCE(n.h, 0) + 10.0 / 3) / (COALESCE(n.n, 0) + 10.0), 8) AS history_accuracy FROM c LEFT JOIN n USING (league, t, conf)""")
def _(v: Views):
    return us(E.predictability_series(v.probs, M["m1"], "y", "game_id", ["league"], "ts"), digits=8)


@register("e25_check_temporal_contract", f"""SELECT CAST(SUM(CASE WHEN available_at <= TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END) AS BIGINT) AS calibration_rows, CAST(SUM(CASE WHEN available_at > TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END) AS BIGINT) AS test_rows, 'calibration_input_late,outcome_before_prediction' AS violations FROM ledger""")
def _(v: Views):
    base = v.ledger.filter("available_at IS NOT NULL").select(F.col("source_timestamp").alias("prediction_time"), "available_at", F.expr("source_timestamp - INTERVAL 1 MINUTE").alias("outcome_at"))
    cut = F.expr("TIMESTAMP '2024-01-15 00:00:00 UTC'")
    test = base.filter(F.col("available_at") > cut).withColumn("prediction_time", F.col("available_at"))
    return E.check_temporal_contract(base.filter(F.col("available_at") <= cut), test)


_D = [f"{f.format('q_home', 'q_draw', 'q_away')} - ({f.format('p_home', 'p_draw', 'p_away')})" for f in (NLLSQL, BRSQL)]
_D.append(" - ".join(f"CASE WHEN {TOPSQL.format(*(f'{m}_{c}' for c in ('home', 'draw', 'away')))} = y THEN 1 ELSE 0 END" for m in "pq"))
_METRICS = ("LogLoss", "Brier", "Accuracy")


@register("e26_paired_block_bootstrap", f"""WITH s AS (SELECT row_number() OVER (ORDER BY ts, game_id) - 1 AS r, {', '.join(f'{d} AS d{i}' for i, d in enumerate(_D))} FROM probs),
b AS (SELECT r // 30 AS b, count(*) AS n, {', '.join(f'SUM(d{i}) AS d{i}' for i in range(3))} FROM s GROUP BY 1),
u AS (SELECT k, b.*, ('0x' || substr(md5('42:' || k || ':' || b), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM b, range(1, 401) t(k)),
m AS (SELECT *, {' + '.join(f'(u >= {c!r}::DOUBLE)::BIGINT' for c in E.POISSON)} AS m FROM u),
v AS (SELECT k, {', '.join(f'SUM(d{i} * m)::DOUBLE / SUM(n * m) AS v{i}' for i in range(3))} FROM m GROUP BY k),
l AS ({' UNION ALL '.join(f"SELECT '{n}' AS metric, v{i} AS v FROM v" for i, n in enumerate(_METRICS))})
SELECT metric, count(*) AS replications, ROUND(quantile_cont(v, 0.025), 8) AS ci_low, ROUND(quantile_cont(v, 0.975), 8) AS ci_high, ROUND(avg(CASE WHEN v > 0 THEN 1 ELSE 0 END), 8) AS p_improvement_positive FROM l GROUP BY metric""")
def _(v: Views):
    b, c = [F.col(x) for x in M["m2"]], [F.col(x) for x in M["m1"]]
    y = F.col("y")
    src = v.probs.select("game_id", "ts", P.nll_cols(b, y).alias("bl"), P.nll_cols(c, y).alias("cl"), P.brier_cols(b, y).alias("bb"), P.brier_cols(c, y).alias("cb"),
                         (A.arg_max_cols(b) == y).cast("int").alias("bh"), (A.arg_max_cols(c) == y).cast("int").alias("ch"))
    out = E.paired_block_bootstrap(src, {"LogLoss": F.col("bl"), "Brier": F.col("bb"), "Accuracy": F.col("ch")}, {"LogLoss": F.col("cl"), "Brier": F.col("cb"), "Accuracy": F.col("bh")}, ["ts", "game_id"])
    return us(out, digits=8)


PAIRS = list(itertools.combinations("pqr", 2))


def _pair(f):
    return "(" + " + ".join(f(a, b) for a, b in PAIRS) + ") / 3"


CL = ("home", "draw", "away")
MEAN = {c: f"((p_{c} + q_{c} + r_{c}) / 3)" for c in CL}


@register("e29_disagreement", f"""WITH t AS (SELECT *, {TOPSQL.format(*MEAN.values())} AS top, {', '.join(TOPSQL.format(*(f'{m}_{c}' for c in CL)) + f' AS t{m}' for m in 'pqr')} FROM probs)
SELECT game_id, ROUND(((tp = top)::INT + (tq = top)::INT + (tr = top)::INT) / 3.0, 8)::DOUBLE AS class_agreement, ROUND(1 - ((tp = top)::INT + (tq = top)::INT + (tr = top)::INT) / 3.0, 8)::DOUBLE AS disagreement, ROUND(-({' + '.join(f'{m} * ln({m})' for m in MEAN.values())}), 8) AS entropy,
 ROUND({_pair(lambda a, b: '(' + ' + '.join(f'abs({a}_{c} - {b}_{c})' for c in CL) + ') / 2')}, 8) AS pair_l1, ROUND({_pair(lambda a, b: 'sqrt(' + ' + '.join(f'pow({a}_{c} - {b}_{c}, 2)' for c in CL) + ')')}, 8) AS pair_l2,
 ROUND({_pair(lambda a, b: '(' + ' + '.join(f'{a}_{c} * ln({a}_{c} / (({a}_{c} + {b}_{c}) / 2)) + {b}_{c} * ln({b}_{c} / (({a}_{c} + {b}_{c}) / 2))' for c in CL) + ') / 2')}, 8) + 0.0 AS pair_js, ROUND({_pair(lambda a, b: '(' + ' + '.join(f'{a}_{c} * ln({a}_{c} / {b}_{c})' for c in CL) + ')')}, 8) + 0.0 AS pair_kl,
 ROUND({_pair(lambda a, b: '1 - (' + ' + '.join(f'{a}_{c} * {b}_{c}' for c in CL) + ') / (sqrt(' + ' + '.join(f'{a}_{c} * {a}_{c}' for c in CL) + ') * sqrt(' + ' + '.join(f'{b}_{c} * {b}_{c}' for c in CL) + '))')}, 8) + 0.0 AS pair_cosine_distance FROM t""")
def _(v: Views):
    out = E.disagreement(v.probs, M)
    return us(out.select("game_id", "class_agreement", "disagreement", "entropy", "pair_l1", "pair_l2", "pair_js", "pair_kl", "pair_cosine_distance"), digits=8)


@register("e30_uncertainty_decomposition", f"""WITH u AS (SELECT game_id, ({' + '.join(f'(pow(p_{c} - {MEAN[c]}, 2) + pow(q_{c} - {MEAN[c]}, 2) + pow(r_{c} - {MEAN[c]}, 2)) / 3' for c in CL)}) / 3 AS a, -({' + '.join(f'{m} * ln({m})' for m in MEAN.values())}) AS b,
 ({' + '.join(f'abs({x}_{c} - {MEAN[c]})' for c in CL for x in 'pqr')}) / 9 AS c, 1 - (k1 % 10) / 10.0 AS d, (k2 % 5) / 5.0 AS e, (k3 % 4) / 4.0 AS f FROM probs)
SELECT game_id, ROUND(a, 8) AS model_uncertainty, ROUND(b, 8) AS entropy_uncertainty, ROUND(c, 8) AS disagreement_uncertainty, ROUND(CAST(d AS DOUBLE), 8) AS data_uncertainty, ROUND(CAST(e AS DOUBLE), 8) AS shift_uncertainty, ROUND(CAST(f AS DOUBLE), 8) AS information_uncertainty, ROUND(a + b + c + d + e + f, 8) AS total_uncertainty FROM u""")
def _(v: Views):
    out = E.member_spread(v.probs, M, F.expr("k1 % 10 / 10D"), F.expr("k2 % 5 / 5D"), F.expr("k3 % 4 / 4D"))
    return us(out.select("game_id", *[c for c in out.columns if c.endswith("_uncertainty")]), digits=8)


PRED = "GREATEST(0.0, LEAST(1.0, 0.30 * (1 - (-(p_home * ln(p_home) + p_draw * ln(p_draw) + p_away * ln(p_away)) / ln(3.0))) + 0.15 * GREATEST(p_home, p_draw, p_away) + 0.20 * 0.5 + 0.15 * (k1 % 10) / 10.0 + 0.10 + 0.05 * (1 - (k2 % 5) / 5.0) + 0.05))"


def _predictability():
    return E.predictability([F.col(c) for c in M["m1"]], F.lit(0.5), F.expr("k1 % 10 / 10D"), F.lit(1.0), F.expr("k2 % 5 / 5D"), F.lit(0.0))


@register("e31_predictability", f"SELECT game_id, ROUND({PRED}, 8) AS predictability FROM probs")
def _(v: Views):
    return us(v.probs.select("game_id", _predictability().alias("predictability")), digits=8)


@register("e31_predictability_calibration", f"""WITH s AS (SELECT {PRED} AS s, CASE WHEN {TOPSQL.format('p_home', 'p_draw', 'p_away')} = y THEN 1 ELSE 0 END AS c FROM probs)
SELECT CAST(LEAST(floor(s * 5), 4) AS BIGINT) AS bin, count(*) AS n, ROUND(avg(s), 8) AS mean_predictability, ROUND(avg(c), 8) AS empirical_accuracy, ROUND(avg(c) - avg(s), 8) AS calibration_gap, count(*) >= 5 AS eligible FROM s GROUP BY 1""")
def _(v: Views):
    return us(E.predictability_calibration(v.probs, _predictability(), A.arg_max_cols([F.col(c) for c in M["m1"]]) == F.col("y")), digits=8)


VAR = {"baseline": [f"p_{c}" for c in CL], "drop_draw": ["p_home", "p_draw * 0.5", "p_away"], "shock": ["p_away", "p_home", "p_draw"]}
VARSQL = "va AS (" + " UNION ALL ".join(f"SELECT y, '{n}' AS variant, ({a}) / z AS p0, ({b}) / z AS p1, ({c}) / z AS p2 FROM (SELECT *, ({a}) + ({b}) + ({c}) AS z FROM probs)" for n, (a, b, c) in VAR.items()) + ")"


@register("e34_ablation", f"WITH {VARSQL}, {bundle('va', 'variant')}, z AS (SELECT * FROM m WHERE variant = 'baseline') SELECT m.variant, m.rows, {', '.join(f'ROUND(m.{c}, 8) AS {c}, ROUND(m.{c} - z.{c}, 8) + 0.0 AS delta_{c}' for c in ('accuracy', 'log_loss', 'brier', 'ece'))} FROM m CROSS JOIN z")
def _(v: Views):
    variants = {}
    for n, cs in VAR.items():
        raw = [F.expr(c.replace("0.5", "0.5D")) for c in cs]
        variants[n] = [r / A.add(raw) for r in raw]
    return us(E.ablation(v.probs, variants, "y", "baseline"), digits=8)


@register("e35_season_compare", f"""SELECT CAST(year(ts) AS INT) AS season, count(*) AS rows, ROUND(avg({NLLSQL.format('q_home', 'q_draw', 'q_away')}), 8) AS baseline_log_loss, ROUND(avg({NLLSQL.format('p_home', 'p_draw', 'p_away')}), 8) AS candidate_log_loss FROM probs WHERE k3 % 5 > 0 GROUP BY 1""")
def _(v: Views):
    y = F.col("y")
    safe = v.probs.filter("k3 % 5 > 0").withColumn("season", F.year("ts"))
    return us(safe.groupBy("season").agg(F.count(F.lit(1)).alias("rows"), F.avg(P.nll_cols([F.col(c) for c in M["m2"]], y)).alias("baseline_log_loss"), F.avg(P.nll_cols([F.col(c) for c in M["m1"]], y)).alias("candidate_log_loss")), digits=8)


@register("e36_error_attribution", """WITH s AS (SELECT game_id, [('Data', ROUND(1 - (k1 % 10) / 10.0::DOUBLE, 12)), ('Drift', ROUND((k2 % 7) / 7.0::DOUBLE, 12)), ('OOD', ROUND((k3 % 9) / 9.0::DOUBLE, 12))] AS xs FROM games),
u AS (SELECT game_id, unnest(xs) AS x FROM s), r AS (SELECT game_id, x[1] AS n, x[2] AS v, row_number() OVER (PARTITION BY game_id ORDER BY x[2] DESC, x[1] DESC) AS rk FROM u)
SELECT game_id, MAX(CASE WHEN rk = 1 THEN n END) AS "primary", ROUND(MAX(v), 9) AS primary_score, string_agg(n, ',' ORDER BY rk) AS ranking FROM r GROUP BY 1""")
def _(v: Views):
    out = E.error_attribution(v.games, {"Data": F.expr("1 - k1 % 10 / 10D"), "Drift": F.expr("k2 % 7 / 7D"), "OOD": F.expr("k3 % 9 / 9D")})
    return us(out.select("game_id", "primary", "primary_score", "ranking"))


BASE3, CAND3 = ("q_home", "q_draw", "q_away"), ("p_home", "p_draw", "p_away")
GATE = f"""ro AS (SELECT home AS k, year(ts) AS yr, {NLLSQL.format(*BASE3)} AS bl, {NLLSQL.format(*CAND3)} AS cl, {BRSQL.format(*BASE3)} AS bb, {BRSQL.format(*CAND3)} AS cb,
 CASE WHEN {TOPSQL.format(*BASE3)} = y THEN 1 ELSE 0 END AS ba, CASE WHEN {TOPSQL.format(*CAND3)} = y THEN 1 ELSE 0 END AS ca, GREATEST(q_home, q_draw, q_away) AS bt, GREATEST(p_home, p_draw, p_away) AS ct FROM probs),
pe AS (SELECT k, count(*) AS periods, SUM(CASE WHEN cl <= bl THEN 1 ELSE 0 END) AS fine FROM (SELECT k, yr, avg(bl) AS bl, avg(cl) AS cl FROM ro GROUP BY ALL) GROUP BY 1),
sb AS (SELECT k, count(*) AS n, avg(bl) AS bl, avg(cl) AS cl, avg(bb) AS bb, avg(cb) AS cb, avg(ba) AS ba, avg(ca) AS ca, abs(avg(bt) - avg(ba)) AS be, abs(avg(ct) - avg(ca)) AS ce FROM ro GROUP BY 1)"""


@register("e37_candidate_gate", f"""WITH {GATE}, r AS (SELECT k, n, concat_ws(',', CASE WHEN n < 200 THEN 'insufficient_locked_holdout_rows' END, CASE WHEN (bl - cl) / bl < 0.03 THEN 'log_loss_improvement_too_small' END,
 CASE WHEN (bb - cb) / bb < 0.01 THEN 'brier_improvement_too_small' END, CASE WHEN ba - ca > 0.005 THEN 'accuracy_regression' END, CASE WHEN ce > be THEN 'calibration_regression' END,
 CASE WHEN k % 7 = 0 THEN 'baseline_candidate_row_mismatch' END, CASE WHEN periods < 2 THEN 'insufficient_validation_windows' END, CASE WHEN k % 5 = 0 THEN 'holdout_pit_evidence_not_verified' END,
 CASE WHEN k % 3 = 0 THEN 'improvement_interval_failed' END, CASE WHEN k % 4 = 0 THEN 'improvement_probability_failed' END,
 CASE WHEN periods < 2 THEN 'insufficient_evaluation_periods' END, CASE WHEN fine < 0.7 * periods THEN 'too_few_periods_not_worse' END, CASE WHEN cl - bl > 0.005 THEN 'log_loss_regression' END, CASE WHEN cb - bb > 0.005 THEN 'brier_regression' END) AS reasons
 FROM sb JOIN pe USING (k)) SELECT k AS candidate, n AS rows, reasons, reasons = '' AS adopt FROM r""")
def _(v: Views):
    y = F.col("y")
    b, c = [F.col(x) for x in M["m2"]], [F.col(x) for x in M["m1"]]
    scored = v.probs.select(
        F.col("home").alias("candidate"), F.year("ts").alias("year"), P.nll_cols(b, y).alias("bl"), P.nll_cols(c, y).alias("cl"), P.brier_cols(b, y).alias("bb"), P.brier_cols(c, y).alias("cb"),
        (A.arg_max_cols(b) == y).cast("int").alias("ba"), (A.arg_max_cols(c) == y).cast("int").alias("ca"), F.greatest(*b).alias("bt"), F.greatest(*c).alias("ct"))
    periods = scored.groupBy("candidate", "year").agg(F.avg("bl").alias("bl"), F.avg("cl").alias("cl")).groupBy("candidate").agg(
        F.count(F.lit(1)).alias("periods"), F.sum((F.col("cl") <= F.col("bl")).cast("int")).alias("non_worse_periods"))
    rows = scored.groupBy("candidate").agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg(x).alias(n) for x, n in (("bl", "base_log_loss"), ("cl", "cand_log_loss"), ("bb", "base_brier"), ("cb", "cand_brier"), ("ba", "base_accuracy"), ("ca", "cand_accuracy"))],
        F.abs(F.avg("bt") - F.avg("ba")).alias("base_ece"), F.abs(F.avg("ct") - F.avg("ca")).alias("cand_ece")).join(periods, "candidate")
    seen = rows.withColumns({
        "base_rows": F.expr("CASE WHEN candidate % 7 = 0 THEN rows + 1 ELSE rows END"), "validation_windows": F.col("periods"), "development_pit_ok": F.lit(True), "holdout_pit_ok": F.expr("CASE WHEN candidate % 5 > 0 THEN true END"),
        "ci_lower": F.expr("CASE WHEN candidate % 3 = 0 THEN 0D ELSE 0.1D END"), "p_positive": F.expr("CASE WHEN candidate % 4 = 0 THEN 0.9D ELSE 0.97D END")})
    out = E.candidate_gate(seen, evidence=("rows", "windows", "pit", "uncertainty", "periods", "regression"))
    return out.select("candidate", "rows", "reasons", "adopt")


@register("e41_revision_value", f"""WITH l AS (SELECT game_id, {NLLSQL.format('q_home', 'q_draw', 'q_away')} AS o, {NLLSQL.format('p_home', 'p_draw', 'p_away')} AS n, (abs(p_home - q_home) + abs(p_draw - q_draw) + abs(p_away - q_away)) / 2 AS s FROM probs)
SELECT game_id, ROUND(o, 8) AS old_logloss, ROUND(n, 8) AS new_logloss, ROUND(o - n, 8) + 0.0 AS logloss_improvement, ROUND(n, 12) < ROUND(o, 12) AS revision_better, ROUND(s, 8) AS shift FROM l""")
def _(v: Views):
    r = E.revision_value([F.col(c) for c in M["m2"]], [F.col(c) for c in M["m1"]], F.col("y"))
    r["revision_better"] = F.round(r["new_logloss"], 12) < F.round(r["old_logloss"], 12)
    return us(v.probs.select("game_id", *[c.alias(n) for n, c in r.items()]), digits=8)


@register("e42_draw_metrics", f"SELECT model, count(*) AS rows, ROUND(SUM(CASE WHEN {TOPSQL.format(*P3)} = 1 AND y = 1 THEN 1 ELSE 0 END) / GREATEST(1, SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END)), 8) AS recall, ROUND(avg(abs(p1 - CASE WHEN y = 1 THEN 1 ELSE 0 END)), 8) AS probability_mae FROM preds GROUP BY 1")
def _(v: Views):
    return us(E.class_metrics(v.preds, P3, "y", 1, ["model"]), digits=8)


@register("e44_calibration_diagnostics", f"""WITH c AS (SELECT league, y, {', '.join(f'pow(p_{c}, 1 / 0.8) / (pow(p_home, 1 / 0.8) + pow(p_draw, 1 / 0.8) + pow(p_away, 1 / 0.8)) AS p{i}' for i, c in enumerate(CL))} FROM probs), {bundle('c', 'league')} SELECT league, rows, {FOUR} FROM m""")
def _(v: Views):
    t = P.temper_cols([F.col(c) for c in M["m1"]], 0.8)
    return us(E.classification_metrics(v.probs.select("league", "y", *[c.alias(f"p{i}") for i, c in enumerate(t)]), P3, "y", ["league"]), digits=8)


@register("a18_condition_accuracy", f"""WITH c AS (SELECT league, stage, CAST(home AS VARCHAR) AS home, CASE WHEN {TOPSQL.format('p_home', 'p_draw', 'p_away')} = y THEN 1 ELSE 0 END AS c FROM probs)
""" + " UNION ALL ".join(f"SELECT '{k}' AS condition, {k} AS value, count(*) AS samples, ROUND(avg(c), 8) AS accuracy FROM c GROUP BY 2" for k in ("league", "stage", "home")))
def _(v: Views):
    return us(E.condition_accuracy(v.probs, ["league", "stage", "home"], A.arg_max_cols([F.col(c) for c in M["m1"]]) == F.col("y")), digits=8)


@register("a19_weakness_report", f"""WITH c AS (SELECT league, strftime(ts, '%Y-%m') AS month, CAST(home AS VARCHAR) AS home, CASE WHEN {TOPSQL.format('p_home', 'p_draw', 'p_away')} = y THEN 1 ELSE 0 END AS c, {NLLSQL.format('p_home', 'p_draw', 'p_away')} AS l FROM probs),
g AS ({' UNION ALL '.join(f"SELECT '{k}' AS key, {k} AS value, count(*) AS rows, avg(c) AS accuracy, avg(l) AS log_loss FROM c GROUP BY 2 HAVING count(*) >= 30" for k in ('league', 'month', 'home'))}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY ROUND(log_loss, 12) DESC, value) AS INT) AS rank FROM g) SELECT key, value, rows, {rounded('accuracy', 'log_loss')}, rank FROM r WHERE rank <= 10""")
def _(v: Views):
    cols = [F.col(c) for c in M["m1"]]
    src = v.probs.withColumn("month", F.date_format("ts", "yyyy-MM"))
    return us(E.weakness_report(src, ["league", "month", "home"], A.arg_max_cols(cols) == F.col("y"), P.nll_cols(cols, F.col("y"))), digits=8)


@register("a25_distinct_aggregates", "SELECT league, count(DISTINCT home) AS homes, count(DISTINCT ts) AS instants, count(DISTINCT k1) AS parts FROM games GROUP BY 1")
def _(v: Views):
    return v.games.groupBy("league").agg(F.count_distinct("home").alias("homes"), F.count_distinct("ts").alias("instants"), F.count_distinct("k1").alias("parts"))


@register("a28_experience_manifest", f"SELECT model, CAST(epoch_us(MIN(ts)) AS BIGINT) AS first_us, CAST(epoch_us(MAX(ts)) AS BIGINT) AS last_us, count(*) AS rows, ROUND(avg({NLLSQL.format(*P3)}), 8) AS mean_log_loss FROM preds GROUP BY 1")
def _(v: Views):
    return us(v.preds.groupBy("model").agg(F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"), F.count(F.lit(1)).alias("rows"), F.avg(P.nll_cols([F.col(c) for c in P3], F.col("y"))).alias("mean_log_loss")), digits=8)


@register("a30_objective_priorities", f"""WITH s AS (SELECT league, avg(CASE WHEN {TOPSQL.format('p_home', 'p_draw', 'p_away')} = y THEN 1 ELSE 0 END) AS acc, avg(abs(lam_h - home_score)) AS mae, avg({NLLSQL.format('p_home', 'p_draw', 'p_away')}) AS ll FROM probs GROUP BY 1),
r AS (SELECT league, UNNEST(['win', 'score', 'calibration']) AS objective, UNNEST([1 - acc, mae / 5, ll / ln(3.0)]) AS priority FROM s)
SELECT league, objective, ROUND(priority, 8) AS priority, first_value(objective) OVER (PARTITION BY league ORDER BY ROUND(priority, 12) DESC, objective DESC) AS focus FROM r""")
def _(v: Views):
    cols = [F.col(c) for c in M["m1"]]
    s = v.probs.groupBy("league").agg(F.avg((A.arg_max_cols(cols) == F.col("y")).cast("int")).alias("acc"), F.avg(F.abs(F.col("lam_h") - F.col("home_score"))).alias("mae"), F.avg(P.nll_cols(cols, F.col("y"))).alias("ll"))
    return us(E.objective_priorities(s, ["league"], {"win": 1 - F.col("acc"), "score": F.col("mae") / 5, "calibration": F.col("ll") / F.log(F.lit(3.0))}), digits=8)


@register("a31_period_losses", f"""WITH r AS (SELECT league, {NLLSQL.format('q_home', 'q_draw', 'q_away')} AS b, {NLLSQL.format('p_home', 'p_draw', 'p_away')} AS c, row_number() OVER (PARTITION BY league ORDER BY ts, game_id) - 1 AS rn, count(*) OVER (PARTITION BY league) AS n FROM probs)
SELECT league, CAST(rn * 4 // n AS INT) AS period, count(*) AS rows, ROUND(avg(b), 8) AS baseline_log_loss, ROUND(avg(c), 8) AS candidate_log_loss FROM r GROUP BY 1, 2""")
def _(v: Views):
    y = F.col("y")
    src = v.probs.select("league", "ts", "game_id", P.nll_cols([F.col(c) for c in M["m2"]], y).alias("b"), P.nll_cols([F.col(c) for c in M["m1"]], y).alias("c"))
    return us(E.period_losses(src, F.col("b"), F.col("c"), ["league"], ["ts", "game_id"]), digits=8)


@register("e23_retrieval_conformal", """WITH c AS (SELECT league, game_id, epoch_us(ts) AS t, p_home, p_draw, p_away, 1.0 - CASE y WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END AS s,
  CAST(k1 % 11 AS DOUBLE) AS f0, CAST(k2 % 13 AS DOUBLE) AS f1, CAST(k3 AS DOUBLE) AS f2, row_number() OVER (PARTITION BY league ORDER BY ts, game_id) AS rn FROM probs),
w AS (SELECT league, t, SUM(count(*)) OVER (PARTITION BY league ORDER BY t) AS done FROM c GROUP BY league, t),
r AS (SELECT c.*, CAST(COALESCE(w.done, 0) AS BIGINT) AS done FROM c ASOF LEFT JOIN w ON c.league = w.league AND c.t - 2 * 86400000000 >= w.t),
u AS (SELECT *, unnest(range(GREATEST(done - 199, 1), done + 1)) AS at FROM r WHERE done >= 30),
j AS (SELECT u.game_id, u.p_home, u.p_draw, u.p_away, c.rn, c.s, c.f0 - u.f0 AS d0, c.f1 - u.f1 AS d1, c.f2 - u.f2 AS d2, stddev_pop(c.f0) OVER g AS s0, stddev_pop(c.f1) OVER g AS s1, stddev_pop(c.f2) OVER g AS s2
  FROM u JOIN c ON c.league = u.league AND c.rn = u.at WINDOW g AS (PARTITION BY u.game_id)),
z AS (SELECT *, pow(d0 / CASE WHEN s0 > 1e-9 THEN s0 ELSE 1 END, 2) + pow(d1 / CASE WHEN s1 > 1e-9 THEN s1 ELSE 1 END, 2) + pow(d2 / CASE WHEN s2 > 1e-9 THEN s2 ELSE 1 END, 2) AS d FROM j),
n AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY ROUND(d, 9), rn) <= 30),
a AS (SELECT game_id, count(*) AS calibration_count, ROUND(sqrt(min(d)), 6) AS nearest_distance, (1.0 + count(*) FILTER (s >= 1.0 - p_home - 1e-12)) / (count(*) + 1.0) AS pv0,
  (1.0 + count(*) FILTER (s >= 1.0 - p_draw - 1e-12)) / (count(*) + 1.0) AS pv1, (1.0 + count(*) FILTER (s >= 1.0 - p_away - 1e-12)) / (count(*) + 1.0) AS pv2 FROM n GROUP BY game_id)
SELECT r.game_id, LEAST(done, 200) AS pool_count, COALESCE(calibration_count, 0) AS calibration_count, nearest_distance, ROUND(pv0, 6) AS pv0, ROUND(pv1, 6) AS pv1, ROUND(pv2, 6) AS pv2,
  concat_ws(',', CASE WHEN pv0 > 0.1 THEN '0' END, CASE WHEN pv1 > 0.1 THEN '1' END, CASE WHEN pv2 > 0.1 THEN '2' END) AS "set" FROM r LEFT JOIN a USING (game_id)""")
def _(v: Views):
    src = v.probs.withColumns({"outcome_at": F.expr("ts + INTERVAL 2 DAYS"), "f0": F.expr("k1 % 11"), "f1": F.expr("k2 % 13")})
    out = retrieval_conformal(src, M["m1"], "y", ["f0", "f1", "k3"], "game_id", "game_id", "ts", "outcome_at", ["league"])
    return us(out.select(F.col("case").alias("game_id"), "pool_count", "calibration_count", "nearest_distance", "pv0", "pv1", "pv2", "set"), digits=6)
