"""Model inference over images or feature vectors.

A backend is a factory that gives a function from a float32 array (n, ...) to
probabilities (n, 3); it is called once a task, so sessions are made on workers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Predict = Callable[[np.ndarray], np.ndarray]
BATCH = 32


def normalise(images: list[bytes], shape: tuple[int, int, int]) -> np.ndarray:
    """(byte - 128) / 128 as float32."""
    flat = np.frombuffer(b"".join(images), np.uint8).astype(np.float32)
    return ((flat - np.float32(128)) / np.float32(128)).reshape(len(images), *shape)


def onnx_backend(path: str) -> Callable[[], Predict]:
    """A model file of onnxruntime; the file is read where the tasks run."""

    def make() -> Predict:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda x: session.run(None, {name: x})[0]

    return make


def load_backend(model: str | Callable[[], Predict]) -> Callable[[], Predict]:
    """By the path's extension, or a factory of one's own."""
    if callable(model):
        return model
    if model.lower().endswith(".onnx"):
        return onnx_backend(model)
    raise ValueError(f"no backend for {model!r}: give a .onnx file, or a callable that makes a predict function")


def predict_images(examples: DataFrame, model: str | Callable[[], Predict], shape: tuple[int, int, int] = (100, 221, 7), batch: int = BATCH, model_id: str = "cnn") -> DataFrame:
    """examples (image, and other columns) with probs and mid instead of image; an image of another size is an error."""
    backend, rest = load_backend(model), [c for c in examples.columns if c != "image"]
    size = int(np.prod(shape))
    checked = examples.withColumn("image", F.when(F.length("image") == size, F.col("image")).otherwise(F.raise_error(F.lit(f"an image has not {size} bytes")).cast("binary")))
    return _predict(checked, backend, "image", rest, lambda x: normalise(list(x), shape), batch).withColumn("mid", F.lit(model_id))


def predict_features(vectors: DataFrame, model: str | Callable[[], Predict], batch: int = 1024, model_id: str = "small") -> DataFrame:
    """vectors (features, and other columns) with probs and mid instead of features."""
    rest = [c for c in vectors.columns if c != "features"]
    return _predict(vectors, load_backend(model), "features", rest, lambda x: np.stack(list(x)).astype(np.float32), batch).withColumn("mid", F.lit(model_id))


def _predict(df: DataFrame, backend: Callable[[], Predict], column: str, rest: list[str], array: Callable, batch: int) -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = backend()
        for part in parts:
            out = [np.asarray(predict(array(part.iloc[at : at + batch])), float) for at in range(0, len(part), batch)]
            yield pd.Series([list(p) for block in out for p in block])

    return df.withColumn("probs", run(column)).select(*rest, "probs")
