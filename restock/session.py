"""Session settings and the shared folder used for checkpoints and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "restock", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with adaptive execution and UTC dates; ``conf`` overrides any setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a missing setting is
    an error, because executors could not read each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="restock-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _staging_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/restock/{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{_staging_root(spark)}/{uuid.uuid4().hex}/{name}"


def staged_once(spark: SparkSession, name: str, build: Callable[[str], None]) -> str:
    """A path below the shared folder that ``build`` fills the first time this application asks for it.

    A mark behind the finished files tells them from those of a failed attempt, and is gone after
    :func:`clear_staging`, so nothing dangles.
    """
    path = f"{_staging_root(spark)}/once/{name}"
    make = spark._jvm.org.apache.hadoop.fs.Path
    mark = make(f"{path}/_DONE")
    files = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(mark):
        files.delete(make(path), True)
        build(f"{path}/data")
        files.create(mark).close()
    return f"{path}/data"


def clear_staging(spark: SparkSession) -> None:
    """Delete the staged files of this application; call it once its results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_staging_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files.

    Iterative jobs call this once per round: plans stay short, a lost executor never restarts the
    whole iteration, and the next join sees the real table size. Unlike a checkpointed plan, the
    files carry no optimizer state that would grow from round to round.
    """
    path = staging_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a superseded round that :func:`cut_lineage` returned.

    Only files below this application's staging folder go; any other table is left alone.
    """
    root = _staging_root(spark)
    for name in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if f"/{root.split('://')[-1].strip('/')}/" in f"/{name.split('://')[-1].split(':')[-1].strip('/')}/":
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
