"""Session set-up, intermediate tables and the limits that every ordered operator shares.

One question decides how a group is worked on, at every size of the input: does it hold more rows
than one task should sort? It is answered by one column-pruned, map-side combined count. The limits
come from the session, so a cluster can raise them and the tests can lower them far enough to force
the split plans on tiny inputs.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from dataclasses import dataclass
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

TASK_ROWS = "spark.freshet.taskRows"
MAX_SLICES = "spark.freshet.maxSlices"
_OWN_FOLDER = "spark.freshet.ownFolder"
_shipped: dict[str, str] = {}


@dataclass(frozen=True)
class Limits:
    """Bounds used by the skew checks.

    ``task_rows``: most rows of one group that one task may sort.
    ``max_slices``: bound on all cut points together, hence on what is broadcast.
    """

    task_rows: int = 2_000_000
    max_slices: int = 20_000

    @classmethod
    def of(cls, spark: SparkSession) -> "Limits":
        conf = spark.conf
        return cls(
            task_rows=int(conf.get(TASK_ROWS, str(cls.task_rows))),
            max_slices=int(conf.get(MAX_SLICES, str(cls.max_slices))),
        )


def local_session(app: str = "freshet", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    Only when that is unset on a local master (tests, laptops) a fresh local folder is chosen, once per
    session. A cluster without the setting is refused: its executors do not see each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = spark.conf.get(_OWN_FOLDER, None) or tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_OWN_FOLDER, named)
    return named.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application: their paths may not hold it."""
    context = spark.sparkContext
    if _shipped.get("to") == context.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(archive)
    _shipped["to"] = context.applicationId


#: Lists of paths written inside nested ``temporary`` blocks, innermost last.
_owners: ContextVar[tuple[list[str], ...]] = ContextVar("owners", default=())


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, owned by the innermost ``temporary`` block."""
    path = f"{shared_folder(spark)}/pinned-{uuid.uuid4().hex}"
    owners = _owners.get()
    if owners:
        owners[-1].append(path)
    return path


def pin(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from its files.

    The lineage ends there, so a lost executor only means reading files again. Unlike a raw
    checkpoint the table is computed once, keeps column pruning and has true size statistics.
    """
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Owns the tables pinned inside, however deep: they are deleted at the end, even after a failure.

    What must outlive the block is handed out by ``keep``. Yields the paths written so far.
    """
    made: list[str] = []
    token = _owners.set((*_owners.get(), made))
    try:
        yield made
    finally:
        _owners.reset(token)
        for path in made:
            _delete(spark, path)


def keep(df: DataFrame) -> DataFrame:
    """Pin a table for the surrounding block of the innermost ``temporary``, or for good if there is none."""
    token = _owners.set(_owners.get()[:-1])
    try:
        return pin(df)
    finally:
        _owners.reset(token)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unpin(df: DataFrame) -> None:
    """Delete a pinned table whose readers are done; anything else is left alone."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("pinned-"):
            _delete(df.sparkSession, folder)


def in_parallel(tasks: Sequence[Callable[[], T]], width: int) -> list[T]:
    """Run driver-side steps that each submit Spark jobs, a few at a time, in order of result."""
    if width <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    carry = inheritable_thread_target(SparkSession.getActiveSession())
    with ThreadPoolExecutor(min(width, len(tasks))) as pool:
        # A copy of the context each, so that what the steps pin has the caller's owner.
        return [f.result() for f in [pool.submit(copy_context().run, carry(t)) for t in tasks]]
