"""Session helpers: the shared working folder and tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}

#: Bytes of an Arrow batch to Python workers, where the session sets no limit; rows alone don't bound the memory that texts take.
ARROW_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and everything runs in one process
    a temporary folder is made, and removed when Python ends; on a cluster, each machine would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="gaugewright-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Scope:
    """The tables that were written inside one ``with temporary()`` block."""

    def __init__(self) -> None:
        self.paths: dict[str, SparkSession] = {}

    def keep(self, *tables: DataFrame) -> None:
        """Leave these written tables; a block around this one takes them over."""
        for t in tables:
            path = t.__dict__.get("_gw_path")
            if (spark := self.paths.pop(path, None)) is not None and len(_scopes()) > 1:
                _scopes()[-2].paths[path] = spark


_THREAD = threading.local()


def _scopes() -> list[Scope]:
    return _THREAD.__dict__.setdefault("scopes", [])


@contextmanager
def temporary() -> Iterator[Scope]:
    """Tables written inside are deleted at the end, but for those that are kept: what a result still reads must be."""
    scope = Scope()
    _scopes().append(scope)
    try:
        yield scope
    finally:
        _scopes().pop()
        for path, spark in scope.paths.items():
            delete(spark, path)


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches to Python workers, unless the session has a bound of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    The written table survives lost executors and cuts the lineage, which ``localCheckpoint`` doesn't.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = new_path(spark, name)
    if _scopes():
        _scopes()[-1].paths[path] = spark
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._gw_path = path
    return written


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system layer, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
