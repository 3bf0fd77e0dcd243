"""Write an intermediate table once and go on from the written copy.

Used where several later steps start from one costly result. The copy lives in the shared
folder the session names in ``spark.checkpoint.dir``, so it survives lost executors and
cuts the lineage behind it; reading it back also gives the planner true sizes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}
# Paths to delete, per thread of work: a stream's batch never sees another one's copies.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only for a local master."""
    configured = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError(f"set {_KEY} to a folder all executors can reach (master is {master})")
    application = spark.sparkContext.applicationId
    if application not in _local_dirs:
        _local_dirs[application] = tempfile.mkdtemp(prefix="filingmill-")
    return _local_dirs[application]


def materialize(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    scope = _scope.get()
    if scope is not None:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete the copies made inside the block, in this thread, at its end.

    For batches of a stream and for batch jobs alike: write the result inside the block.
    """
    scope: list[str] = []
    token = _scope.set(scope)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in scope:
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
