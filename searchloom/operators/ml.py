"""TF-IDF as a stage of an ML pipeline.

``TextTfIdf`` learns the vocabulary and weights that ``tfidf`` does; what it gives
is a pipeline of Spark ML's own stages (counts in sparse vectors, weights, unit
length), which runs in the JVM and is saved and loaded like any other.  The
vocabulary, at most ``maxFeatures`` terms, is the driver's, as in Spark's own.
"""

from __future__ import annotations

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from .tfidf import MAX_FEATURES


class TextTfIdf(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Of a column of tokens, array<string>, a column of unit TF-IDF vectors; a row without a token of the vocabulary has a zero vector."""

    maxFeatures = Param(Params._dummy(), "maxFeatures", "terms of the vocabulary", TypeConverters.toInt)  # noqa: N815

    def __init__(self, inputCol: str = "tokens", outputCol: str = "vector", maxFeatures: int = MAX_FEATURES):  # noqa: N803
        super().__init__()
        self._setDefault(inputCol="tokens", outputCol="vector", maxFeatures=MAX_FEATURES)
        self._set(inputCol=inputCol, outputCol=outputCol, maxFeatures=maxFeatures)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        """Raises ValueError without a row, or without a token in any."""
        tokens, out = self.getInputCol(), self.getOutputCol()
        rows = dataset.select(F.col(tokens).alias("t"))
        n = rows.count()
        each = rows.select(F.explode("t").alias("term"), F.lit(1).alias("cf"), F.lit(0).alias("df"))
        once = rows.select(F.explode(F.array_distinct("t")).alias("term"), F.lit(0).alias("cf"), F.lit(1).alias("df"))
        terms = each.unionByName(once).groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
        best = terms.orderBy(F.desc("cf"), "term").limit(self.getOrDefault(self.maxFeatures))
        learned = best.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")).collect()  # maxFeatures at most
        if not learned:
            raise ValueError("no tokens to fit on")
        counts, weighted = f"{out}__counts", f"{out}__weighted"
        stages = [
            CountVectorizerModel.from_vocabulary([r.term for r in learned], inputCol=tokens, outputCol=counts),
            ElementwiseProduct(scalingVec=Vectors.dense([r.idf for r in learned]), inputCol=counts, outputCol=weighted),
            Normalizer(p=2.0, inputCol=weighted, outputCol=out),
            SQLTransformer(statement=f"SELECT * EXCEPT (`{counts}`, `{weighted}`) FROM __THIS__"),
        ]
        return PipelineModel(stages)


def entries(rows: DataFrame, vector: str) -> DataFrame:
    """A row (..., i, w) for every component but 0 of a vector; a sparse vector's zeros are never made."""
    v = F.unwrap_udt(F.col(vector))
    own = F.arrays_zip(F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1)).alias("i"), v["values"].alias("w"))
    return rows.where(F.size(v["values"]) > 0).select("*", F.inline(own)).where("w <> 0")
