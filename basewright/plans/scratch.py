"""Tables that a plan writes to the folder which driver and executors share.

Every table belongs to the innermost open ``scope`` of its thread, and goes when
that scope ends; a table written outside any scope stays until the process
ends, because lazy results may still read it. So no run can take away a table
of another.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting: shuffle files of a finished execution go at once, not when the driver collects garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dirs: dict[str, str] = {}
_proven: set[tuple[str, str]] = set()
_lasting: list[tuple[SparkSession, str]] = []
_thread = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master, where both are one machine, may go without that
    setting; it then gets a folder of its own. On other masters a table is
    written and counted once, since a folder that is not shared loses rows silently.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    local = context.master.startswith("local[") or context.master == "local"
    if named:
        named = named.rstrip("/")
        if not local and (context.applicationId, named) not in _proven:
            _prove(spark, named)
            _proven.add((context.applicationId, named))
        return named
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_dirs:
        _own_dirs[context.applicationId] = tempfile.mkdtemp(prefix="basewright-")
    return "file://" + _own_dirs[context.applicationId]


def _prove(spark: SparkSession, folder: str) -> None:
    probe = f"{folder}/basewright/{uuid.uuid4().hex}-probe"
    rows = 4 * max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, rows, 1, rows).write.parquet(probe)
    found = spark.read.schema("id long").parquet(probe).count()
    _delete([(spark, probe)])
    if found != rows:
        raise RuntimeError(f"spark.checkpoint.dir is not shared by all executors: {folder}")


def _scopes() -> list[list[tuple[SparkSession, str]]]:
    if not hasattr(_thread, "scopes"):
        _thread.scopes = []
    return _thread.scopes


@contextmanager
def scope() -> Iterator[list[tuple[SparkSession, str]]]:
    """Tables written inside are deleted at the end; write or collect what is needed before."""
    own: list[tuple[SparkSession, str]] = []
    _scopes().append(own)
    try:
        yield own
    finally:
        _scopes().remove(own)
        _delete(own)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Executions inside remove their shuffle files when they end; nothing reads those again."""
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as the cluster has cores, if it has fewer; a table of few files would leave cores idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes with the scope's tables."""
    path = f"{shared_dir(spark)}/basewright/{uuid.uuid4().hex}-{name}"
    (_scopes()[-1] if _scopes() else _lasting).append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage, so a lost executor costs a re-read and not a
    re-computation, and several later plans share one computation.
    """
    path = new_path(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def distilled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Materialise ``make()`` and delete every table that was written to get there."""
    with scope() as own:
        result = materialise(make(), name)
        kept = own.pop()
    (_scopes()[-1] if _scopes() else _lasting).append(kept)
    return result


def collect_garbage(spark: SparkSession) -> None:
    """Between the rounds of a long iteration: let the driver drop the plans and generated classes of finished ones.

    They only fill the driver's memory; the JVM would else wait until its heap is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(*tables: DataFrame) -> None:
    """Delete materialised tables of this thread that no later plan reads."""
    for table in tables:
        files = set(table.inputFiles())
        for owned in [*_scopes(), _lasting]:
            gone = [x for x in owned if any(x[1].split(":", 1)[-1].lstrip("/") in f for f in files)]
            _delete(gone)
            owned[:] = [x for x in owned if x not in gone]


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _at_exit() -> None:
    try:
        _delete(_lasting)
    except Exception:  # the session is gone; the shared folder's owner clears it
        pass
    for folder in _own_dirs.values():
        shutil.rmtree(folder, ignore_errors=True)
