"""A scorer whose work is Spark's: features of images by expressions, logistic regression over all labelled rows."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.operators.scorer import block_score
from contactloom.session import cut

#: Distances from the diagonal at which bands of an image end.
BANDS = (1, 3, 6, 10, 15, 20)


def image_features(x: Column, side: int = 20) -> Column:
    """An array of doubles: block score, logarithm of all contacts, part of padding, and of each band the part of contacts within and across the middle.

    Padding and null cells count nothing. Null for a null image.
    """
    half = side // 2
    cells = F.transform(x, lambda v: F.greatest(F.coalesce(v, F.lit(0)), F.lit(0)).cast("double"))
    add = lambda total, v: total + v
    total = F.aggregate(cells, F.lit(0.0), add)
    far = lambda i: F.abs(F.floor(i / side) - i % side)
    crosses = lambda i: (i % side < half) != (F.floor(i / side) < half)

    def part(low: int, high: int, across: bool) -> Column:
        inside = F.filter(cells, lambda v, i: (far(i) >= low) & (far(i) < high) & (crosses(i) == F.lit(across)))
        return F.coalesce(F.try_divide(F.aggregate(inside, F.lit(0.0), add), total), F.lit(0.0))

    parts = [part(low, high, across) for low, high in zip((0, *BANDS[:-1]), BANDS, strict=True) for across in (False, True)]
    padded = F.try_divide(F.size(F.filter(x, lambda v: v < 0)).cast("double"), F.size(x).cast("double"))
    whole = F.array(F.coalesce(block_score(x, side), F.lit(0.0)), F.log1p(total), F.coalesce(padded, F.lit(0.0)), *parts)
    return F.when(x.isNotNull(), whole)


def _with_features(images: DataFrame, side: int) -> DataFrame:
    known = images.where(F.col("x").isNotNull() & (F.size("x") == side * side))
    return known.select("sample_id", "y", array_to_vector(image_features(F.col("x"), side)).alias("features"))


def fitted(images: DataFrame, side: int = 20, passes: int = 50) -> LogisticRegressionModel:
    """A model of P(y = 1) from all images (sample_id, y, x) with a label 0 or 1; every pass is one Spark job over them."""
    # every pass reads the features, which are made once
    rows = cut(_with_features(images.where("y in (0, 1)"), side).select(F.col("y").cast("double").alias("label"), "features"))
    return LogisticRegression(maxIter=passes, regParam=1e-3).fit(rows)


def feature_scores(images: DataFrame, model: LogisticRegressionModel, side: int = 20) -> DataFrame:
    """(sample_id, prob) of every image of that side; others and null ones are left out."""
    return model.transform(_with_features(images, side)).select("sample_id", vector_to_array("probability")[1].alias("prob"))
