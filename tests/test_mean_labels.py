"""Linear families fitted on mean labels of equal features are those fitted on all rows."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from tideline.operators import learners as L


@pytest.mark.parametrize("family", [{"family": "poisson", "link": "log", "regParam": 0.15}, {"family": "tweedie", "variancePower": 1.5, "linkPower": 0.0, "regParam": 0.08}])
def test_same_coefficients_from_few_rows(spark, family):
    df = spark.range(6000).select((F.col("id") % 7 / 3.0).alias("a"), (F.col("id") % 5 / 2.0).alias("b"), F.pmod(F.xxhash64("id"), F.lit(6)).cast("double").alias("y"))
    few = L.mean_labels(df, ["a", "b"], ["y"])
    assert few.count() == 35 and few.agg(F.sum("_n")).first()[0] == 6000.0
    x, make = VectorAssembler(inputCols=["a", "b"], outputCol="_x"), lambda **kw: GeneralizedLinearRegression(featuresCol="_x", labelCol="y", maxIter=25, **family, **kw)
    one, two = make().fit(x.transform(df)), make(weightCol="_n").fit(x.transform(few))
    assert np.allclose([one.intercept, *one.coefficients], [two.intercept, *two.coefficients], atol=1e-6)
    gap = df.withColumn("y", F.when(F.col("y") > 0, F.col("y")))
    assert L.mean_labels(gap, ["a", "b"], ["y"]).where("y IS NULL").count() > 0
