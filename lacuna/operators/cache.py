"""A content-addressed response table: keys, lookup, upsert, statistics, and its files.

A cache's folder holds tables of entries and a log. A log file is a numbered list of the tables that hold at that time. A
writer writes its table, then creates the next number with one table more; if another writer was first, it reads that
list and tries again. So no writer's entries are lost, readers see a whole list or the one before, and nothing is
overwritten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.sources.shared import create_if_absent, names_in, read_small

#: Tables in a list, at most, before they are merged into one.
MOST_TABLES = 16


def cache_key(prompt: Column, max_tokens: Column) -> Column:
    """SHA-256 of the token limit and the prompt, joined by U+001F (fixed format)."""
    return F.sha2(F.concat_ws("\x1f", max_tokens.cast("string"), prompt).cast("binary"), 256)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, response of both; equal keys hold equal responses, so which one stays makes no difference."""
    return _distinct(old.select("key", "response").unionByName(new.select("key", "response")))


def _distinct(entries: DataFrame) -> DataFrame:
    return entries.groupBy("key").agg(F.max("response").alias("response"))


def lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (key ..) with response and hit."""
    return requests.join(cache.select("key", "response"), "key", "left").withColumn("hit", F.col("response").isNotNull())


def stats(looked_up: DataFrame) -> DataFrame:
    """hits, misses, hit_rate (n/a without a request)."""
    counts = looked_up.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    total = F.col("hits") + F.col("misses")
    return counts.withColumn("hit_rate", F.when(total > 0, F.format_string("%.3f", F.col("hits") / total)).otherwise("n/a"))


SCHEMA = "key string, response string"


def tables(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """(number, tables) of the last list in the log; (0, none) without a log."""
    numbers = [n for n in names_in(spark, f"{path}/log") if n.endswith(".json") and n[:-5].isdigit()]
    return (int(numbers[-1][:-5]), json.loads(read_small(spark, f"{path}/log/{numbers[-1]}"))) if numbers else (0, [])


def _read(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], SCHEMA)
    found = spark.read.schema(SCHEMA).parquet(*(f"{path}/{n}" for n in names))
    return found if len(names) == 1 else _distinct(found)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the last list; empty, with a warning, if they can't be read."""
    try:
        table = _read(spark, path, tables(spark, path)[1])
        table.limit(1).count()
        return table
    except Exception as e:  # a cache that can't be read costs calls, never the run
        print(f"cache {path} can't be read ({type(e).__name__}); going on with an empty one")
        return spark.createDataFrame([], SCHEMA)


def _write(entries: DataFrame, path: str) -> str:
    name = f"table-{uuid.uuid4().hex}"
    _distinct(entries).write.parquet(f"{path}/{name}")
    return name


def _commit(spark: SparkSession, path: str, own: str, instead_of: tuple[str, ...] = ()) -> list[str]:
    """Puts a table into the next list, in the place of others; the list. Tables that came in between stay."""
    while True:
        number, names = tables(spark, path)
        listed = [n for n in names if n not in instead_of] + [own]
        if create_if_absent(spark, f"{path}/log/{number + 1:012d}.json", json.dumps(listed)):
            return listed


def save(new: DataFrame, path: str) -> DataFrame:
    """Adds entries; what the cache holds then. Many tables are merged into one, whose sources stay for readers that have them."""
    spark = new.sparkSession
    listed = _commit(spark, path, _write(new, path))
    if len(listed) > MOST_TABLES:
        listed = _commit(spark, path, _write(_read(spark, path, listed), path), tuple(listed))
    return _read(spark, path, listed)


def path_for(model: str, folder: str = "cache") -> str:
    """One cache a model, as equal prompts go to all of them."""
    return f"{folder}/responses.{''.join(c if c.isalnum() or c in '-_.' else '_' for c in model)}"
