"""Filling missing vectors with a user-supplied embedder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..config import Embedding
from ..operators import merge
from ..operators.materialize import materialize
from ..operators.merge import write_back_vectors
from ..sources import sinks

Embedder = Callable[[list[str]], list]


def embed_names(names: DataFrame, embed_fn: Embedder, cfg: Embedding = Embedding()) -> DataFrame:
    """Add ``embedding`` and ``embed_error`` to a table with a ``name`` column.

    ``embed_fn`` takes a list of names and returns one vector or None for each. A batch that
    fails is retried name by name, so one bad name costs only itself; what still fails stays
    without a vector and says why. Each row is tried once per run.
    """
    size, dim = cfg.batch, cfg.dim
    schema = T.StructType(names.schema.fields + [
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("embed_error", T.StringType())])
    def one(name):
        try:
            return embed_fn([name])[0], None
        except Exception as error:
            return None, f"{type(error).__name__}"

    def vectors_of(chunk):
        try:
            got = list(embed_fn(chunk))
            if len(got) == len(chunk):
                return [(v, None) for v in got]
        except Exception:
            pass
        return [one(name) for name in chunk]

    def checked(vector, error):
        if vector is None:
            return None, error or "no vector"
        if len(vector) != dim:
            return None, f"expected {dim} values, got {len(vector)}"
        return [float(x) for x in vector], None

    def fill(frames):
        for frame in frames:
            texts = frame["name"].tolist()
            pairs = [
                checked(*pair)
                for lo in range(0, len(texts), size) for pair in vectors_of(texts[lo:lo + size])]
            yield frame.assign(
                embedding=[p[0] for p in pairs], embed_error=[p[1] for p in pairs])

    return names.mapInPandas(fill, schema)


def fill_vectors(employers: DataFrame, embed_fn: Embedder, cfg: Embedding = Embedding()) -> DataFrame:
    """The employer table with vectors for all names that had none and could be embedded."""
    waiting = employers.where(F.col("embedding").isNull()).select(
        F.col("employer_name").alias("name"))
    made = embed_names(waiting, embed_fn, cfg).select(
        F.col("name").alias("employer_name"), "embedding")
    return write_back_vectors(employers, made, cfg.dim, key="employer_name")


def fill_store(
    spark: SparkSession, folder: str, embed_fn: Embedder, run_ts: datetime, cfg: Embedding = Embedding(),
    limit: int | None = None,
) -> str:
    """Fill missing vectors of the newest stored run before ``run_ts`` and write the next run.

    With ``limit`` only the first names that wait are tried. Names are embedded once: what the
    embedder gave is written before it is joined back.
    """
    stored = sinks.read_latest(spark, folder, before=run_ts)
    if stored is None:
        raise FileNotFoundError(f"no finished run before {run_ts} in {folder}")
    waiting = merge.pending(merge.with_vector_column(stored), limit).select(F.col("employer_name").alias("name"))
    made = materialize(embed_names(waiting, embed_fn, cfg), "vectors").select(
        F.col("name").alias("employer_name"), "embedding")
    filled = write_back_vectors(merge.with_vector_column(stored), made, cfg.dim, key="employer_name")
    return sinks.write_run(filled, folder, run_ts)


def hash_embedder(dim: int) -> Embedder:
    """A deterministic embedder for tests: pseudo-random unit vectors seeded by the text."""
    def embed(texts: list[str]) -> list:
        import hashlib

        import numpy as np

        vectors = []
        for t in texts:
            seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")
            v = np.random.default_rng(seed).standard_normal(dim)
            vectors.append((v / np.linalg.norm(v)).tolist())
        return vectors

    return embed
