"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folder of each application that came without one, and the paths of each open `temporary` block.
_own_folder: dict[str, str] = {}
_open_blocks: list[list[str]] = []


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Hadoop resolves it: the same place for Spark and for code on executors."""
    fs, hadoop = _fs(spark, path)
    return fs.makeQualified(hadoop).toString()


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, with its scheme.

    Where it is unset and Spark is local, one folder is made for the
    application and deleted with it; on a cluster an unset folder is an error,
    as a machine's own one would lose rows.
    """
    try:
        root = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # the key has no default in this Spark version
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return qualified(spark, root).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        fs, hadoop = _fs(spark, _own_folder[app])
        fs.deleteOnExit(hadoop)
    return _own_folder[app]


def scratch(spark: SparkSession, name: str, *, keep: bool = False) -> str:
    """A new folder in the shared one; it goes with the `temporary` block it is made in (keep: the one around it), else with the driver."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    fs, hadoop = _fs(spark, path)
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    blocks = _open_blocks[:-1] if keep else _open_blocks
    if blocks:
        blocks[-1].append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    fs, hadoop = _fs(spark, path)
    fs.delete(hadoop, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those written with keep."""
    _open_blocks.append([])
    try:
        yield
    finally:
        for path in _open_blocks.pop():
            drop_path(spark, path)


def written(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder.

    Cuts the lineage: lost executors cost nothing that was written, and what
    is read twice is computed once.
    """
    path = scratch(df.sparkSession, name, keep=keep) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
