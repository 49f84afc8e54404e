"""Queries that fit models; results depend on the fit, so they have no SQL twin and are bounded in the tests."""

from pyspark.sql import functions as F

from tideline.functions import arrays as A
from tideline.operators import evaluate as E
from tideline.operators import learners as L
from tideline.operators import prob as P
from tideline.operators import timeline as T
from tideline.plans.catalog import register
from tideline.plans.q_timeline import us
from tideline.plans.views import MODELS, Views
from tideline.session import materialize, stored

FEATURES = [f"{p}_{c}_10" for c in ("pts", "gf", "ga") for p in "ha"]
P3 = ["p0", "p1", "p2"]


def matrix(v: Views):
    """Leak-free form of both sides for every game, staged once because every fit reads it several times."""
    form = T.rolling_form(v.entity_rows, (10,))
    m = T.match_features(v.probs, form, ["pts_10", "gf_10", "ga_10"])
    keep = ["game_id", "ts", "league", "home_score", "away_score", *FEATURES, *[c for cs in MODELS.values() for c in cs]]
    return stored(m.select(*keep, F.col("y").cast("double").alias("y")), "matrix")


def split(m, cut="1999-06-01"):
    at = F.expr(f"TIMESTAMP '{cut} 00:00:00 UTC'")
    return m.filter(F.col("ts") < at), m.filter(F.col("ts") >= at)


@register("e14_walk_forward")
def _(v: Views):
    m = matrix(v)
    out = L.walk_forward(m, FEATURES, "y", ["ts", "game_id"], 4)
    return us(out.select("game_id", "period", *P3), digits=6)


@register("e16_classifiers")
def _(v: Views):
    dev, hold = split(matrix(v))
    out = None
    for kind in ("logistic", "forest", "boosted"):
        scored = L.predict(L.fit_classifier(dev, FEATURES, "y", kind, equal=True), hold, 3)
        row = E.classification_metrics(scored, P3, "y").withColumn("model", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return us(out, digits=6)


@register("e17_hierarchical_draw_model")
def _(v: Views):
    dev, hold = split(matrix(v))
    return us(L.hierarchical_draw_model(dev, hold, FEATURES, "y").select("game_id", *P3), digits=6)


@register("e18_score_models")
def _(v: Views):
    dev, hold = split(matrix(v))
    typed = [d.withColumns({"home_score": F.col("home_score").cast("double"), "away_score": F.col("away_score").cast("double")}) for d in (dev, hold)]
    out = L.fit_score_models(*typed, FEATURES, {"home": "home_score", "away": "away_score"}, "ts")
    return us(out.select("game_id", "lam_home", "lam_away"), digits=6)


@register("e19_stacked_model")
def _(v: Views):
    dev, hold = split(matrix(v))
    out, _ = L.stacked_model(dev, hold, MODELS, "y", "ts")
    return us(out.select("game_id", *P3), digits=6)


@register("e27_permutation_importance")
def _(v: Views):
    m = matrix(v)
    feats = ["p_home", "q_home", "h_gf_10"]
    windows = []
    for name, cut in (("w1", "1998-01-01"), ("w2", "1999-06-01")):
        train, test = split(m, cut)
        windows.append((name, train, test))
    return us(L.permutation_importance(windows, feats, "y"), digits=6)


@register("e28_target_permutation_audit")
def _(v: Views):
    dev, hold = split(matrix(v))
    return us(L.target_permutation_audit(dev, hold, ["p_home", "p_away", "r_home"], "y", repeats=1), digits=6)


@register("e32_walk_forward_logistic")
def _(v: Views):
    cols = [F.col(c) for c in MODELS["m1"]]
    d = v.probs.select("game_id", "ts", F.greatest(*cols).alias("score"), (A.arg_max_cols(cols) == F.col("y")).cast("int").alias("correct"))
    return us(L.walk_forward_logistic(d, "score", "correct", ["ts", "game_id"]).select("game_id", "period", "calibrated"), digits=6)


LOSS = "-ln(CASE y WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END)"


def _failures(v: Views):
    d = v.probs.select("league", "ts", "game_id", P.nll_cols([F.col(c) for c in MODELS["m1"]], F.col("y")).alias("loss"))
    return L.failure_features(d, "loss", ["league"], ["ts", "game_id"])


@register("e33_failure_features", f"""WITH r AS (SELECT league, game_id, {LOSS} AS loss, row_number() OVER (PARTITION BY league ORDER BY ts, game_id) AS rn FROM probs), q AS (SELECT league, quantile_cont(loss, 0.75) AS q75 FROM r GROUP BY 1),
f AS (SELECT *, avg(loss) OVER p AS m, list_aggregate(list(loss) OVER p, 'stddev_pop') AS sd, CASE WHEN count(*) OVER p >= 3 THEN regr_slope(loss, CAST(rn AS DOUBLE)) OVER p ELSE 0.0 END AS sl, avg(loss) OVER n AS fut, count(*) OVER n AS k FROM r
 WINDOW p AS (PARTITION BY league ORDER BY rn ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), n AS (PARTITION BY league ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING))
SELECT game_id, ROUND(loss, 6) AS last_loss, ROUND(m, 6) AS mean_12, ROUND(sd, 6) AS sd_12, ROUND(sl, 6) + 0.0 AS slope_12, CASE WHEN rn > 12 AND k = 8 THEN CASE WHEN fut > GREATEST(q75, m * 1.12) THEN 1.0::DOUBLE ELSE 0.0 END END AS failure FROM f JOIN q USING (league)""")
def _(v: Views):
    return us(_failures(v).select("game_id", *L.FAILURE, "failure"), digits=6)


@register("e33_failure_risk")
def _(v: Views):
    return us(L.failure_risk(materialize(_failures(v))).select("game_id", "failure_risk"), digits=6)


@register("e39_counterfactual_stability")
def _(v: Views):
    dev, hold = split(matrix(v))
    model = L.fit_classifier(dev, FEATURES, "y", equal=True)
    return us(L.counterfactual_stability(model, hold, FEATURES, "game_id", draws=2), digits=6)
