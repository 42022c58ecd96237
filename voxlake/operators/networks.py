"""Forward passes of small networks whose weights are a table or a list: frame-context layers, statistics pooling and margin losses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embed(rows: DataFrame, layers: list[tuple[list[int], np.ndarray, np.ndarray]], key: str = "key") -> DataFrame:
    """(key, frames) to (key, embedding). layers: (context offsets, weights, bias); edges repeat the outermost frame; ReLU between
    layers; mean and deviation over the frames are the embedding. Weights travel once with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for frames in b.column(1).to_pylist():
                x = np.array(frames or [[0.0] * (layers[0][1].shape[1] // len(layers[0][0]))], float)
                for context, w, bias in layers:
                    at = np.clip(np.arange(len(x))[:, None] + np.array(context)[None, :], 0, len(x) - 1)
                    x = np.maximum(0.0, x[at].reshape(len(x), -1) @ w.T + bias)
                out.append(np.round(np.concatenate([x.mean(0), x.std(0)]), 6).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], [key, "embedding"])

    return rows.select(key, "frames").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, embedding array<double>")


def margin_logit(cosine: Column, kind: str, margin: float) -> Column:
    """Cosine of the true class under a margin: arc (angle plus margin), cos (cosine less margin) or sphere (angle times margin)."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))
    if kind == "arc":
        return F.cos(F.least(F.pi(), F.acos(c) + margin))
    if kind == "sphere":
        return F.cos(F.least(F.pi(), F.acos(c) * margin))
    return c - margin
