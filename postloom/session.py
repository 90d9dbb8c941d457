"""Session set-up and the places where intermediate tables are cut from their lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the library relies on; everything else stays as the cluster has it.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a repeated JSON key keeps its last value instead of making the line unreadable
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str = "postloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; `conf` uses `_` for `.` in setting names."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package; on a cluster it comes with `--py-files`."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, root]))


def size_shuffles(spark: SparkSession, input_bytes: int, per_task: int = 128 * 1024 * 1024) -> int:
    """Raise the number of shuffle partitions so that none holds much more than `per_task` bytes.

    Adaptive execution merges partitions that turn out small but does not add any for a large
    input. The number is never lowered.
    """
    current = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(current, -(-input_bytes // per_task))
    spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return wanted


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in `spark.checkpoint.dir`. Only a local-mode session without one gets a
    temporary folder, since a machine-local folder is of no use to executors elsewhere.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="postloom-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Compute a small table once into the reliable checkpoint folder and read it from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Compute a large table once into Parquet under the shared checkpoint folder.

    Unlike a checkpoint this is compressed, and later passes read only the columns they need.
    """
    folder = scratch_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name under the shared checkpoint folder; an open scope removes it at its end."""
    folder = f"{checkpoint_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
    owned = _owned.get()
    if owned is not None:
        owned.append(folder)
    return folder


_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the scratch tables made inside once the block has ended, also by an error.

    Nothing that is still to be read may depend on them: results are stored inside the block.
    """
    token, folders = _owned.set([]), []
    try:
        yield
    finally:
        folders = _owned.get() or []
        _owned.reset(token)
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
