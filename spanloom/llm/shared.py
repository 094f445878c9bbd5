"""Folders that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


#: Folders that this process has asked for, by session folder.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, one below the warehouse in a
    local session (tests), while a cluster raises: its machines would not share it."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not said and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (said or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    base = shared_dir(spark)
    _made.setdefault(base, []).append(f"{base}/{what}-{uuid.uuid4().hex}")
    return _made[base][-1]


def clean(spark: SparkSession) -> int:
    """Deletes all that the operators of this process wrote to the shared folder; call it when
    their results have been read or stored, since results are read lazily from it."""
    jvm, conf, paths = spark._jvm, spark._jsc.hadoopConfiguration(), _made.pop(shared_dir(spark), [])
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return len(paths)


def make_room(df: DataFrame, results: Iterable[str], keep: str | None = None) -> DataFrame:
    """df with columns that have a result's name (in any case) renamed by adding "_" until the
    name is free; `keep` (the text that is read) keeps its name, and may not be a result's."""
    taken, out = {c.lower() for c in df.columns} | {r.lower() for r in results}, df
    for r in results:
        for c in [c for c in df.columns if c.lower() == r.lower()]:
            if c == keep:
                raise ValueError(f"the text column {c} has the name of a result")
            new = c + "_"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            out = out.withColumnRenamed(c, new)
    return out


def spare(df: DataFrame, name: str) -> str:
    """A column name that df does not have, for use within an operator."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows that a file of a table has at least, where their number is known.
FILE_ROWS = 10_000


def written(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and kept when executors are lost.

    rows: about how many it has; a small table is written by few tasks, whatever the number of
    shuffle partitions (each file costs its writer a file, a checksum and, on local disks, processes
    that set their permissions)."""
    spark, path = df.sparkSession, fresh(df.sparkSession, what)
    df = df if rows is None else df.coalesce(rows // FILE_ROWS + 1)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str:
    """The mounted path of a file: URI, for code that maps files into memory."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped files need a shared folder that is mounted as a path, not {path}")
    return os.path.abspath(path)


def extended(df: DataFrame, more: str) -> T.StructType:
    """df's schema with more columns, given as DDL."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])
