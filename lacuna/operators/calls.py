"""Calls of a model under a budget that all tasks share, each answer written before it is used.

Requests are asked in waves. Before a wave, each of its requests reserves what it may cost at most (its tries times the
prompt's estimated tokens and the answer's limit); requests beyond what is left of the budget aren't in the wave. The
reserved requests are written as a table, the tasks that read it call the client, and their answers are written; what was
reserved and not spent returns to the budget, and the next wave asks what is still open. A task that runs again, because
its executor was lost, makes no call: how many its first run made isn't known, so its reserve counts as spent, and its
requests come again in the next wave with a reserve of their own. Hence no more calls are made and no more tokens used than
the budget has, whatever fails, as long as the client tells its true usage and a prompt has no more tokens than
estimated.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.operators import cache
from lacuna.sources.shared import new_path, written


class Client(Protocol):
    """last_usage (input tokens, output tokens of the last call) may be missing; then both are estimated."""

    def complete(self, prompt: str, *, max_tokens: int = 1024) -> str: ...


Factory = Callable[[], Client]
#: Characters that count as a token of a prompt; tokens of a run, and the share at which it warns.
CHARACTERS, BUDGET, WARN_AT = 4, 100_000, 0.75
#: Parts that reserves are summed up in; waves, at most.
SLICES, MOST_WAVES = 256, 20
RESULT = "key string, response string, calls int, input_tokens long, output_tokens long, lost boolean, error string"


class Budget(NamedTuple):
    """What all calls together may cost; None: no limit."""

    tokens: int | None = BUDGET
    calls: int | None = None


class Retry(NamedTuple):
    """Calls of one request, at most, and seconds before the second, doubled before each further one."""

    tries: int = 1
    wait: float = 0.5


def estimate(prompt: Column, max_tokens: int) -> Column:
    """Tokens that a call may use: the prompt's, by its length, and the answer's limit."""
    return (F.floor(F.length(prompt) / CHARACTERS) + max_tokens).cast("long")


def answer(client: Client, prompt: str, max_tokens: int, retry: Retry, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """(response or None, calls, input tokens, output tokens, error) of one request. Errors whose retryable is False aren't tried again."""
    calls = taken = given = 0
    error = None
    while calls < retry.tries:
        if calls:
            sleep(retry.wait * 2 ** (calls - 1))
        calls += 1
        try:
            response = client.complete(prompt, max_tokens=max_tokens)
        except Exception as e:
            error, taken = f"{type(e).__name__}: {e}", taken + len(prompt) // CHARACTERS
            if not getattr(e, "retryable", True):
                break
            continue
        used = getattr(client, "last_usage", None) or (len(prompt) // CHARACTERS, min(max_tokens, -(-len(response) // CHARACTERS)))
        return response, calls, taken + used[0], given + used[1], None
    return None, calls, taken, given, error


def _asker(make: Factory, max_tokens: int, retry: Retry):
    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().attemptNumber() == 0
        client = make() if first else None
        for part in parts:
            told = [answer(client, p, max_tokens, retry) if first else (None, 0, 0, 0, None) for p in part["prompt"]]
            columns = dict(zip(("response", "calls", "input_tokens", "output_tokens", "error"), zip(*told, strict=True), strict=True)) if told else {}
            yield pd.DataFrame({"key": part["key"], "lost": not first, **columns}, columns=["key", "response", "calls", "input_tokens", "output_tokens", "lost", "error"])

    return ask


def _granted(rows: DataFrame, left: dict[str, int | None]) -> DataFrame:
    """The rows whose reserves fit into what is left, in order of slices and keys. Sums of slices alone reach the driver."""
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(SLICES)))
    limits = {k: v for k, v in left.items() if v is not None}
    if not limits:
        return rows
    before, sums = dict.fromkeys(limits, 0), []
    for r in sorted(rows.groupBy("slice").agg(*(F.sum(k).alias(k) for k in limits)).collect(), key=lambda r: r["slice"]):
        sums.append((r["slice"], *before.values()))
        before = {k: v + r[k] for k, v in before.items()}
    offsets = rows.sparkSession.createDataFrame(sums, "slice long, " + ", ".join(f"before_{k} long" for k in limits))
    order = Window.partitionBy("slice").orderBy("key")
    fits = F.lit(True)
    for k, limit in limits.items():
        fits = fits & (F.col(f"before_{k}") + F.sum(k).over(order) <= limit)
    return rows.join(F.broadcast(offsets), "slice").withColumn("fits", fits).where("fits").select(rows.columns)


def ask_once(requests: DataFrame, make: Factory, path: str | None = None, max_tokens: int = 512, budget: Budget | None = None, retry: Retry = Retry()) -> tuple[DataFrame, DataFrame]:
    """(requests with response and hit, the ledger: wave, requests, reserved, calls, input_tokens, output_tokens, lost, failed).

    requests: prompt and other columns. Prompts that the cache at path holds cost nothing, equal ones one call. A request
    that fails, or that the budget refuses, has no response and no entry. Entries are in the cache when this returns.
    """
    spark = requests.sparkSession
    path = path or new_path(spark, "responses")
    run, ledger, done = f"{path}/run-{uuid.uuid4().hex}", [], None
    keyed = written(requests.withColumn("key", cache.cache_key(F.col("prompt"), F.lit(max_tokens))), "requests", f"{run}/requests")
    wanted = keyed.select("key", "prompt").dropDuplicates(["key"]).join(cache.load(spark, path), "key", "anti")
    wanted = wanted.withColumn("tokens", retry.tries * estimate(F.col("prompt"), max_tokens)).withColumn("calls", F.lit(retry.tries).cast("long"))
    left = {"tokens": budget.tokens if budget else None, "calls": budget.calls if budget else None}
    open_ = written(wanted, "open", f"{run}/open")
    for wave in range(MOST_WAVES):
        rest = open_ if done is None else open_.join(done, "key", "anti")
        reserved = written(_granted(rest, left), "reserved", f"{run}/reserved-{wave}")
        held = reserved.agg(F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
        if not held["n"]:
            break
        results = written(reserved.select("key", "prompt").mapInPandas(_asker(make, max_tokens, retry), RESULT), "results", f"{run}/results-{wave}")
        cache.save(results.where("response is not null"), path)
        costs = results.join(reserved.select("key", F.col("tokens").alias("most"), F.col("calls").alias("most_calls")), "key")
        spent = costs.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "input_tokens", "output_tokens")), F.count_if("lost").alias("lost"), F.count_if(F.col("response").isNull() & ~F.col("lost")).alias("failed"), *(F.coalesce(F.sum(F.when(F.col("lost"), F.col(c))), F.lit(0)).alias(c) for c in ("most", "most_calls"))).first()
        ledger.append((wave, held["n"], held["tokens"], spent["calls"], spent["input_tokens"], spent["output_tokens"], spent["lost"], spent["failed"]))
        used = {"tokens": spent["input_tokens"] + spent["output_tokens"] + spent["most"], "calls": spent["calls"] + spent["most_calls"]}
        left = {k: None if v is None else v - used[k] for k, v in left.items()}
        _warn(budget, left)
        answered = results.where("not lost").select("key")
        done = answered if done is None else done.unionByName(answered)
    told = spark.createDataFrame(ledger, "wave int, requests long, reserved long, calls long, input_tokens long, output_tokens long, lost long, failed long")
    told = written(told.coalesce(1), "ledger", f"{run}/ledger")
    return cache.lookup(keyed, cache.load(spark, path)).drop("key"), told


def _warn(budget: Budget | None, left: dict[str, int | None]) -> None:
    if budget and budget.tokens and budget.tokens - left["tokens"] >= WARN_AT * budget.tokens:
        print(f"{budget.tokens - left['tokens']} of {budget.tokens} tokens of the budget are used")


def ledgers(spark: SparkSession, path: str) -> DataFrame:
    """The waves of all runs that used the cache at path, as of ask_once."""
    return spark.read.parquet(f"{path}/run-*/ledger")
