"""The folder that all executors share, tables written there, and small files that come to be all at once."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, in local mode only."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", made := tempfile.mkdtemp(prefix="lacuna-"))
    return made


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lacuna-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes df and reads it back: what follows is neither computed twice nor lost with an executor."""
    df.write.parquet(path := path or new_path(df.sparkSession, label))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _local(fs, place) -> str | None:
    """The path on this machine, if the folder is a plain one."""
    whole = fs.makeQualified(place).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's files, sorted; none if there is no such folder."""
    fs, place = _file_system(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []


def read_small(spark: SparkSession, path: str) -> str:
    fs, place = _file_system(spark, path)
    stream = fs.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_if_absent(spark: SparkSession, path: str, content: str) -> bool:
    """Makes a small file with its whole content, unless there is one already: of several writers, one succeeds.

    Plain folders link a finished file to the name, others rename it, which Hadoop's file systems refuse where the name is
    taken. Stores whose rename overwrites can't keep writers apart.
    """
    fs, place = _file_system(spark, path)
    if (here := _local(fs, place)) is not None:
        os.makedirs(os.path.dirname(here), exist_ok=True)
        with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(here), prefix=".", encoding="utf-8") as f:
            f.write(content)
            f.flush()
            try:
                os.link(f.name, here)
            except FileExistsError:
                return False
        return True
    _, made = _file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(made, False)
    stream.write(bytearray(content.encode()))
    stream.close()
    if fs.exists(place) or not fs.rename(made, place):
        fs.delete(made, False)
        return False
    return True
