"""Chronological model fits with MLlib: walk-forward, score models, stacking, importance, stability."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import arrays as A
from tideline.operators import ordered as O
from tideline.operators.evaluate import classification_metrics, period_of
from tideline.operators.prob import nll_cols
from tideline.session import materialize, stored

SEED = 42


def fit_classifier(train: DataFrame, features: Sequence[str], label: str, kind: str = "logistic", weight: str | None = None, equal: bool = False) -> PipelineModel:
    """Scaled multiclass model: ``logistic``, ``forest`` or ``boosted`` (one-vs-rest gradient boosting).

    With ``equal``, rows of equal features and label are one for the fits that read their rows in every step and draw none, weighted by their
    number; the scale is that of all rows. A forest draws rows, so it reads them all."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw_x"), StandardScaler(inputCol="_raw_x", outputCol="_x", withMean=True)]
    common = {"featuresCol": "_x", "labelCol": label}
    if weight:
        common["weightCol"] = weight
    if kind == "logistic":
        model = LogisticRegression(**common, maxIter=60, regParam=0.01, family="auto")
    elif kind == "forest":
        model = RandomForestClassifier(**common, numTrees=20, maxDepth=5, seed=SEED)
    elif kind == "boosted":
        base = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=8, maxDepth=3, seed=SEED)
        model = OneVsRest(classifier=base, rawPredictionCol="rawPrediction", **common)
    else:
        raise ValueError(f"unknown model kind: {kind}")
    if not equal or weight or kind == "forest":
        return Pipeline(stages=[*stages, model]).fit(train)
    front = Pipeline(stages=stages).fit(train)
    once = stored(train.groupBy(*features, label).agg(F.count(F.lit(1)).cast("double").alias("_n")), "equal")
    return PipelineModel([*front.stages, model.setWeightCol("_n").fit(front.transform(once))])


def predict(model: PipelineModel, df: DataFrame, k: int, prefix: str = "p") -> DataFrame:
    """Class probabilities as columns ``p0 .. p(k-1)``, floored and renormalised; a class never seen gets the floor."""
    out = model.transform(df)
    if "probability" in out.columns:
        raw = vector_to_array("probability")
    else:
        raw = F.transform(vector_to_array("rawPrediction"), lambda x: 1.0 / (1.0 + F.exp(-2.0 * x)))
    cols = [F.greatest(F.coalesce(F.get(raw, F.lit(i)), F.lit(0.0)), F.lit(1e-9)) for i in range(k)]
    total = A.add(cols)
    return out.select(*df.columns, *[(c / total).alias(f"{prefix}{i}") for i, c in enumerate(cols)])


def walk_forward(df: DataFrame, features: Sequence[str], label: str, order: Sequence[str], blocks: int = 4, kind: str = "logistic", k: int = 3,
                 done: DataFrame | None = None, block_of: str = "period") -> DataFrame:
    """Expanding prefix: every block but the first is predicted by a model fitted on all earlier blocks.

    One fit per block.  With ``done`` (a table of finished blocks), those blocks are not fitted again.
    """
    staged = materialize(period_of(df, [], order, blocks).drop("rn"))
    finished = set() if done is None else {r[0] for r in done.select(block_of).distinct().collect()}
    out = None
    for b in range(1, blocks):
        if b in finished:
            continue
        model = fit_classifier(staged.filter(F.col("period") < b), features, label, kind)
        part = predict(model, staged.filter(F.col("period") == b), k)
        out = part if out is None else out.unionByName(part)
    if done is not None:
        out = done if out is None else done.unionByName(out, allowMissingColumns=True)
    return out


def assert_complete(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """All or nothing: the predictions, or a failed query when a block is partial."""
    missing = expected.select(key).join(got, key, "left_anti").agg(F.count(F.lit(1)).alias("_m")).withColumn("_one", F.lit(1))
    checked = got.withColumn("_one", F.lit(1)).join(missing, "_one")
    return checked.withColumn(key, F.when(F.col("_m") == 0, F.col(key)).otherwise(F.raise_error(F.lit("incomplete block")).cast(got.schema[key].dataType))).drop("_m", "_one")


def hierarchical_draw_model(train: DataFrame, test: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """A draw gate times a home/away model fitted on decided games."""
    gate = fit_classifier(train.withColumn("_draw", (F.col(label) == 1).cast("double")), features, "_draw", "logistic")
    side = fit_classifier(train.filter(F.col(label) != 1).withColumn("_away", (F.col(label) == 2).cast("double")), features, "_away", "logistic")
    both = predict(side, predict(gate, test, 2, "_d"), 2, "_s")
    raw = [(1 - F.col("_d1")) * F.col("_s0"), F.col("_d1"), (1 - F.col("_d1")) * F.col("_s1")]
    raw = [A.clip(c, 1e-9, 1.0) for c in raw]
    total = A.add(raw)
    return both.select(*test.columns, *[(c / total).alias(f"p{i}") for i, c in enumerate(raw)])


def later_part(df: DataFrame, order: str, share: float) -> tuple[DataFrame, DataFrame]:
    """(earlier, later) rows by an instant: the cut is the ``share`` quantile of its distinct values' rows, and equal instants stay together."""
    at = df.agg(F.percentile_approx(F.unix_micros(order), share, 10_000)).first()[0]
    late = F.unix_micros(order) > at
    return df.filter(~late), df.filter(late)


def mean_labels(df: DataFrame, features: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One row for rows of equal features: mean of each label and their number ``_n``, staged because fits read it in every step.

    Enough for models whose estimating equations are linear in the label (exponential families); a label that is missing somewhere stays missing.
    """
    n = F.count(F.lit(1))
    means = [F.when(F.count(y) == n, F.avg(y)).alias(y) for y in labels]
    return materialize(df.groupBy(*features).agg(*means, n.cast("double").alias("_n")))


def fit_score_models(train: DataFrame, test: DataFrame, features: Sequence[str], targets: Mapping[str, str], order: str, top: int = 3,
                     share: float = 0.75) -> DataFrame:
    """Poisson, Tweedie and forest intensities per target, blended by inverse validation error.

    The error is that on the latest rows of ``train`` (after the ``share`` quantile of ``order``) of models fitted on the earlier ones; the
    members are then fitted on all of it. ``targets`` maps an output prefix to its label.  Adds ``lam_<prefix>`` and one column per member.
    The two linear families, which read their rows in every step, are fitted on mean labels of equal features.
    """
    x = VectorAssembler(inputCols=list(features), outputCol="_x")
    tr, te = x.transform(train), x.transform(test)
    early, late = later_part(tr, order, share)
    means = {part: x.transform(mean_labels(d, features, list(targets.values()))) for part, d in (("all", tr), ("early", early))}
    kinds: dict[str, Callable[[str], object]] = {
        "poisson": lambda y: GeneralizedLinearRegression(family="poisson", link="log", featuresCol="_x", labelCol=y, weightCol="_n", regParam=0.15, maxIter=25),
        "tweedie": lambda y: GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, featuresCol="_x", labelCol=y, weightCol="_n", regParam=0.08, maxIter=25),
        "forest": lambda y: RandomForestRegressor(featuresCol="_x", labelCol=y, numTrees=20, maxDepth=5, seed=SEED),
    }
    out = te
    for prefix, y in targets.items():
        errors = {}
        for name, make in kinds.items():
            model = make(y).fit(tr if name == "forest" else means["all"])
            col = f"{name}_{prefix}"
            out = model.transform(out).withColumn(col, A.clip(F.col("prediction"), 0.05, 15.0)).drop("prediction")
            checked = make(y).fit(early if name == "forest" else means["early"]).transform(late)
            errors[name] = checked.agg(F.avg(F.abs(A.clip(F.col("prediction"), 0.05, 15.0) - F.col(y)))).first()[0]
        best = sorted(errors, key=lambda n: (errors[n], n))[:top]
        inverse = {n: 1.0 / max(errors[n], 1e-9) for n in best}
        z = sum(inverse.values())
        out = out.withColumn(f"lam_{prefix}", A.add([F.col(f"{n}_{prefix}") * (w / z) for n, w in inverse.items()]))
    return out.drop("_x")


def stacked_model(dev: DataFrame, hold: DataFrame, members: Mapping[str, Sequence[str]], label: str, order: str, share: float = 0.7) -> tuple[DataFrame, dict]:
    """Multinomial model over member probabilities, fitted on the earlier ``share`` of the dev data and used on the hold-out only where it
    beats the plain mean on the later rest."""
    inputs = [c for cs in members.values() for c in cs]
    k = len(next(iter(members.values())))
    fit_part, check = later_part(dev, order, share)
    model = fit_classifier(fit_part, inputs, label, "logistic")
    mean = [A.add([F.col(c[i]) for c in members.values()]) / len(members) for i in range(k)]
    scored = predict(model, check, k, "_k")
    losses = scored.agg(F.avg(nll_cols([F.col(f"_k{i}") for i in range(k)], F.col(label))).alias("stacked"), F.avg(nll_cols(mean, F.col(label))).alias("mean")).first().asDict()
    adopted = losses["stacked"] < losses["mean"]
    out = predict(model, hold, k) if adopted else hold.select("*", *[c.alias(f"p{i}") for i, c in enumerate(mean)])
    return out, {**losses, "adopted": adopted}


def shuffled(df: DataFrame, column: str, seed: int) -> DataFrame:
    """The frame with one column permuted: values are re-joined by a random rank.

    Ranks come from segmented numbering over hash buckets, so the shuffle is spread evenly.
    """
    a = df.withColumns({"_key": F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns]), "_u": F.monotonically_increasing_id()})
    a = materialize(a)
    left = O.row_numbers(a, [], ["_key", "_u"], seg=F.shiftright("_key", 52), out="_rank")
    right = a.select(F.col(column).alias("_value"), F.xxhash64(F.lit(seed + 1), "_key", "_u").alias("_key2"), "_u")
    right = O.row_numbers(right, [], ["_key2", "_u"], seg=F.shiftright("_key2", 52), out="_rank").select("_rank", "_value")
    return left.join(right, "_rank").withColumn(column, F.col("_value")).select(*df.columns)


def permutation_importance(windows: Sequence[tuple[str, DataFrame, DataFrame]], features: Sequence[str], label: str, k: int = 3, repeats: int = 1) -> DataFrame:
    """Loss increase per shuffled feature in each (name, train, evaluation) window."""
    out = None
    for name, train, test in windows:
        model = fit_classifier(train, features, label)
        loss = lambda d: F.avg(nll_cols([F.col(f"p{i}") for i in range(k)], F.col(label))).alias("loss")  # noqa: E731,ARG005
        base = predict(model, test, k).agg(loss(None)).withColumn("_one", F.lit(1)).withColumnRenamed("loss", "baseline")
        for j, f in enumerate(features):
            for r in range(repeats):
                row = predict(model, shuffled(test.select(*features, label), f, SEED + 100 * j + r), k).agg(loss(None)).withColumns({"_one": F.lit(1), "window": F.lit(name), "feature": F.lit(f)})
                out = row.join(base, "_one") if out is None else out.unionByName(row.join(base, "_one"))
    return out.groupBy("window", "feature").agg((F.avg("loss") - F.first("baseline")).alias("importance"))


def rank_stability(importance: DataFrame) -> DataFrame:
    """Spearman correlation of feature ranks for every pair of windows."""
    from pyspark.sql import Window

    ranked = importance.withColumn("r", F.row_number().over(Window.partitionBy("window").orderBy(F.col("importance").desc(), "feature")).cast("double"))
    a, b = ranked.select(F.col("window").alias("window_a"), "feature", F.col("r").alias("ra")), ranked.select(F.col("window").alias("window_b"), "feature", F.col("r").alias("rb"))
    return a.join(b, "feature").filter("window_a < window_b").groupBy("window_a", "window_b").agg(F.corr("ra", "rb").alias("spearman"))


def target_permutation_audit(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, k: int = 3, repeats: int = 2) -> DataFrame:
    """Loss of the real fit next to refits on shuffled targets, which must be worse."""
    real = predict(fit_classifier(train, features, label), test, k)
    rows = classification_metrics(real, [f"p{i}" for i in range(k)], label).withColumn("run", F.lit("real"))
    for r in range(repeats):
        fake = predict(fit_classifier(shuffled(train.select(*features, label), label, SEED + r), features, label), test, k)
        rows = rows.unionByName(classification_metrics(fake, [f"p{i}" for i in range(k)], label).withColumn("run", F.lit(f"permuted_{r}")))
    return rows


def walk_forward_logistic(df: DataFrame, score: str, correct: str, order: Sequence[str], blocks: int = 4) -> DataFrame:
    """Probability of being right from a score, refitted per block on all earlier blocks."""
    out = walk_forward(df.withColumn("_label", F.col(correct).cast("double")), [score], "_label", order, blocks, "logistic", 2)
    return out.withColumnRenamed("p1", "calibrated").drop("p0", "_label")


FAILURE = ("last_loss", "mean_12", "sd_12", "slope_12")


def failure_features(df: DataFrame, loss: str, keys: Sequence[str], order: Sequence[str], horizon: int = 8) -> DataFrame:
    """Recent loss level, spread and slope, with the label "the next ``horizon`` losses are markedly worse"."""
    q = O.exact_quantiles(df, keys, loss, {"_q75": 0.75})
    spread, w = O.blocks(O.row_numbers(df, keys, order), keys, back=12, ahead=horizon)
    past, ahead = w.rowsBetween(-11, 0), w.rowsBetween(1, horizon)
    n = F.count(F.lit(1)).over(past)
    out = O.drop_halo(spread.withColumns({
        "last_loss": F.col(loss), "mean_12": F.avg(loss).over(past), "sd_12": F.stddev_pop(loss).over(past),
        "slope_12": F.when(n >= 3, F.regr_slope(F.col(loss), F.col("rn").cast("double")).over(past)).otherwise(0.0),
        "_future": F.avg(loss).over(ahead), "_n": F.count(F.lit(1)).over(ahead)}))
    j = O.attach(out, q, keys)
    label = F.when((F.col("rn") > 12) & (F.col("_n") == horizon), (F.col("_future") > F.greatest(F.col("_q75"), F.col("mean_12") * 1.12)).cast("double"))
    return j.withColumn("failure", label).drop("_future", "_n", "_q75", "rn")


def failure_risk(df: DataFrame) -> DataFrame:
    """Probability of failure from a logistic model on :func:`failure_features`."""
    model = fit_classifier(df.filter(F.col("failure").isNotNull()), FAILURE, "failure")
    return predict(model, df, 2).withColumnRenamed("p1", "failure_risk").drop("p0")


def counterfactual_stability(model: PipelineModel, df: DataFrame, features: Sequence[str], key: str, k: int = 3, noise: float = 0.05, draws: int = 4, tail: float = 0.95) -> DataFrame:
    """Mean and p95 change of the probabilities under seeded relative noise on every feature.

    Both sides of a change come from the same row, so rows stay where they are; only the values around the asked quantile are ordered."""
    stats = df.agg(*[F.stddev_pop(c).alias(f"_{c}") for c in features]).withColumn("_one", F.lit(1))
    base = predict(model, df.select(key, *features), k).withColumns({"_one": F.lit(1), "draw": F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))})
    # noise is a hash of the row key, so a recomputed task draws the same numbers
    unit = lambda i, salt: (F.pmod(F.xxhash64((F.lit(SEED + i) + F.lit(31) * F.col("draw")).cast("int"), F.lit(salt), key), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    gauss = lambda i: F.sqrt(-2.0 * F.log(unit(i, "a"))) * F.cos(6.283185307179586 * unit(i, "b"))
    moved = base.join(stats, "_one").withColumns({c: F.col(c) + noise * F.col(f"_{c}") * gauss(i) for i, c in enumerate(features)})
    change = A.add([F.abs(F.col(f"p{i}") - F.col(f"q{i}")) for i in range(k)]) / 2
    out = materialize(predict(model, moved, k, "q").select("draw", change.alias("change")))
    q = O.exact_quantile(out, "change", tail, "p95_change").withColumn("_one", F.lit(1))
    return out.agg(F.avg("change").alias("mean_change"), F.max("change").alias("max_change")).withColumn("_one", F.lit(1)).join(q, "_one").drop("_one")
