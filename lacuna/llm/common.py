"""What the operators of this subpackage share: table access, the shared folder, materialised tables and free column names."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a slice that Python code works on at a time; keeps the peak memory of a worker near a few texts' size.
SLICE_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a temporary one, in local mode only."""
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


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, label))
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, upper and lower case taken as equal."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_worker(key: tuple, make: Callable):
    """What make() gives, kept for later tasks of the same Python worker; the newest four only."""
    kept = sys.modules.setdefault("lacuna_worker_cache", types.ModuleType("lacuna_worker_cache")).__dict__.setdefault("kept", {})
    if key not in kept:
        while len(kept) >= 4:
            kept.pop(next(iter(kept)))
        kept[key] = make()
    return kept[key]


def ship(spark: SparkSession, thing: object) -> Callable[[], object]:
    """A broadcast of thing, by value with its class; what comes back reads it on a worker."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(thing))
    return lambda: cloudpickle.loads(sent.value)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """df through mapInArrow, slice by slice; make() builds the function once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for part in slices(batches):
            step = step or make()
            yield step(part)

    return df.mapInArrow(run, schema)


def bucket_of(column, modulus: int):
    """crc32 of the id as text, modulo modulus: the fold of a row (null ids: fold null)."""
    return F.crc32(column.cast("string")) % modulus
