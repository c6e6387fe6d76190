"""The embedder hook: a model of the caller's, loaded once a worker, over batches of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quern.operators.chunking import points

#: Fixed value: texts a model gets at once.
BATCH_SIZE = 32
Model = Callable[[np.ndarray], np.ndarray]


def embedder(load: Callable[[], Model], batch_size: int = BATCH_SIZE) -> Callable[[Column], Column]:
    """Texts to vectors.  load() runs once a Python worker and gives the model, which turns an
    array of texts into a matrix with a row for each; null texts reach it as empty ones."""
    udf = predict_batch_udf(load, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    return lambda text: udf(F.coalesce(text, F.lit("")))


def hash_model(dim: int) -> Callable[[], Model]:
    """A model in place of a real one: functions.vector.hash_embedding for batches."""

    def load() -> Model:
        heads = [f"{i}|".encode() for i in range(dim)]

        def encode(texts: np.ndarray) -> np.ndarray:
            words = [[int(hashlib.md5(h + t).hexdigest()[:8], 16) for h in heads] for t in (str(x).encode("utf-8", "surrogatepass") for x in texts)]
            m = np.array(words, dtype=np.float64).reshape(len(texts), dim) / 2**32 - 0.5
            return m / np.linalg.norm(m, axis=1, keepdims=True)

        return encode

    return load


def embedded_points(chunks: DataFrame, doc_id: Column, embed: Callable[[Column], Column], **kinds) -> DataFrame:
    """chunking.points() with the vector of every point's text."""
    return points(chunks, doc_id, **kinds).withColumn("vector", embed(F.col("text")))
