"""Vectors of texts without a downloaded model: hashed terms, weighted by rarity, of unit length."""

from __future__ import annotations

from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import embedding_text
from tidemark.operators.language import tokens

DIM = 384


def hashed_embeddings(df: DataFrame, key: str, title: str, body: str, dim: int = DIM) -> DataFrame:
    """(id, model, embedding) of each record's title and first words; all zero where there are no terms."""
    text = df.select(F.col(key).alias("id"), tokens(embedding_text(F.col(title), F.col(body))).alias("terms"))
    tf = HashingTF(numFeatures=dim, inputCol="terms", outputCol="tf").transform(text)
    if tf.isEmpty():
        return df.sparkSession.createDataFrame([], f"id {dict(df.dtypes)[key]}, model string, embedding array<float>")
    weighted = IDF(inputCol="tf", outputCol="w").fit(tf).transform(tf)
    unit = Normalizer(p=2.0, inputCol="w", outputCol="u").transform(weighted)
    return unit.select("id", F.lit(f"hashed-idf-{dim}").alias("model"), vector_to_array("u", "float32").alias("embedding"))
