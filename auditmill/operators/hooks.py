"""Call-outs to models that the caller supplies: an embedder and a detector.

Only the call is Python. A failing call costs its own row and never the task. All call-outs
are of one kind of function, since Spark cannot take apart nested ones of several kinds.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import pyarrow as pa
import pyspark.cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.functions.vectors import vector_or_zero
from auditmill.session import bound_batches

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Detector = Callable[[list[dict]], str]

DETECT_ROWS = 256   # messages that are Python objects at a time
EMPTY_REPLY = '{"findings": []}'


def _embed_batch(embedder: Embedder, texts: list[str]) -> list:
    """Vectors of a batch; if the batch fails, text by text, with None where that fails too."""
    try:
        vectors = list(embedder(texts))
        if len(vectors) == len(texts):
            return vectors
    except Exception:
        pass
    if len(texts) == 1:
        return [None]
    return [vector for text in texts for vector in _embed_batch(embedder, [text])]


def embed(df: DataFrame, text: str, embedder: Embedder, dim: int, batch: int = 32, out: str = "embedding") -> DataFrame:
    """Add a vector column. A text without a usable vector gets the zero vector."""

    @F.arrow_udf("array<float>")
    def call(texts: pa.Array) -> pa.Array:
        values, vectors = texts.to_pylist(), []
        for at in range(0, len(values), batch):
            vectors += _embed_batch(embedder, values[at:at + batch])
        return pa.array([None if v is None else [float(x) for x in v] for v in vectors], pa.list_(pa.float32()))

    return df.withColumn("_vector", call(text)).withColumn(out, vector_or_zero(F.col("_vector"), dim)).drop("_vector")


def detect(prompts: DataFrame, detector: Detector, attempt: int = 1) -> DataFrame:
    """Add `attempt` and `raw`, the reply to `messages`. A failed call is an empty reply.

    Only the messages go to Python. Store the result before it is used twice: a lazy table
    would call the model again for each use."""

    bound_batches(prompts.sparkSession)

    @F.arrow_udf("string")
    def call(batch: pa.Array) -> pa.Array:
        replies = []
        for at in range(0, len(batch), DETECT_ROWS):
            for messages in batch.slice(at, DETECT_ROWS).to_pylist():
                try:
                    replies.append(str(detector(messages)))
                except Exception:
                    replies.append(EMPTY_REPLY)
        return pa.array(replies, pa.string())

    return prompts.withColumn("attempt", F.lit(attempt)).withColumn("raw", call("messages"))


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
