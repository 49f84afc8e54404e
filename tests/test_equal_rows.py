"""Equal rows are fitted once, weighted by their number."""

from pyspark.sql import functions as F

from tideline.operators import prob as P


def test_a_blend_of_repeated_rows_unfolds_its_grids_over_distinct_rows(spark, monkeypatch):
    cells = [(0.5, 0.3, 0.2, 0.2, 0.3, 0.5, 0), (0.2, 0.2, 0.6, 0.6, 0.2, 0.2, 2), (0.3, 0.4, 0.3, 0.1, 0.8, 0.1, 1), (0.5, 0.3, 0.2, 0.2, 0.3, 0.5, 2)]
    df = spark.createDataFrame(cells, "a0 double, a1 double, a2 double, b0 double, b1 double, b2 double, y int")
    many = df.withColumn("x", F.explode(F.sequence(F.lit(1), F.when(F.col("y") == 0, 70).otherwise(25)))).drop("x")
    seen, plain = [], P.fit_temperature
    monkeypatch.setattr(P, "fit_temperature", lambda d, *a: seen.append(d.count()) or plain(d, *a))
    members = {"a": ("a0", "a1", "a2"), "b": ("b0", "b1", "b2")}
    spec = P.fit_blend(many, members, "y")
    assert seen == [8, 4 * 5]
    for i, m in enumerate(members):
        one = plain(many, members[m], "y").first()
        assert spec["temperatures"][i] == one["temperature"]
    blend = P.blend_cols([P.temper_cols([F.col(c) for c in members[m]], t) for m, t in zip(members, spec["temperatures"])], spec["weights"])
    whole = plain(many.select("y", *[c.alias(f"p{i}") for i, c in enumerate(blend)]), ["p0", "p1", "p2"], "y").first()
    assert whole["temperature"] == spec["final_temperature"] and abs(whole["log_loss"] - spec["log_loss"]) < 1e-12
