"""Clustered unit vectors for tests and benches, the same for a seed, made where they are used."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def clustered_vectors(spark: SparkSession, n: int, dim: int = 128, clusters: int = 50, spread: float = 0.15, seed: int = 42) -> DataFrame:
    """(id, cluster, embedding): n vectors of length one around so many random directions."""
    centres = np.random.default_rng(seed).normal(size=(clusters, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            rows = np.empty((len(ids), dim), np.float32)
            of = np.empty(len(ids), np.int32)
            for i, x in enumerate(ids.tolist()):
                r = np.random.default_rng((seed, x))
                of[i] = r.integers(clusters)
                v = centres[of[i]] + spread * r.normal(size=dim)
                rows[i] = v / np.linalg.norm(v)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, dim, dtype=np.int32)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(of), flat], ["id", "cluster", "embedding"])

    return spark.range(n).mapInArrow(make, "id long, cluster int, embedding array<float>")
