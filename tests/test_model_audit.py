"""The audit with a model: codes stay, anchors follow, calls keep to the budget and are made once; the cache's log; the HTTP client."""

import http.server
import json
import os
import re
import subprocess
import sys
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lacuna.functions import text as T
from lacuna.functions.triggers import STARTER_LEXICON
from lacuna.operators import audit, cache, calls, model
from lacuna.operators.profile import study_profiles
from lacuna.plans.pack import STARTER
from lacuna.plans.planted import planted
from lacuna.sources.client import CallError, HttpClient, read_env
from lacuna.sources.shared import create_if_absent, names_in, read_small

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't find the tests' modules


class Counting:
    """Answers with the prompt's number of options; each call is a line of a file."""

    def __init__(self, path, answer="2", fail=0):
        self.path, self.answer, self.fail, self.seen = path, answer, fail, {}

    def complete(self, prompt, *, max_tokens=1024):
        with open(self.path, "a") as f:
            f.write("call\n")
        self.seen[prompt] = self.seen.get(prompt, 0) + 1
        if self.seen[prompt] <= self.fail:
            raise OSError("busy")
        return self.answer


def made(path):
    return len(path.read_text().splitlines()) if path.exists() else 0


@pytest.fixture(scope="module")
def docs(spark):
    return T.canonicalize(planted(spark, "/root/testdata/sf0.001").where("cast(doc_id as int) < 24")).drop("text")


@pytest.fixture(scope="module")
def plain(docs):
    return {(r.doc_id, r.field_id): r for r in audit.findings(docs).collect()}


def test_a_model_moves_anchors_only(spark, docs, plain, tmp_path):
    log, path = tmp_path / "calls", str(tmp_path / "cache")
    found = audit.findings(docs, make=lambda: Counting(str(log)), path=path)
    after = {(r.doc_id, r.field_id): r for r in found.collect()}
    assert {k: (r.code, r.verdict, r.reason) for k, r in plain.items()} == {k: (r.code, r.verdict, r.reason) for k, r in after.items()}
    moved = [k for k, r in after.items() if (r.start, r.end) != (plain[k].start, plain[k].end)]
    hows = {r.detail.get("anchor_detector", "").split(":kw:")[0].split(":head:")[0] for r in after.values()}
    assert moved and any(h.startswith("anchor:det-confident(score=") for h in hows) and any("node:model-2of" in h for h in hows)
    asked = made(log)
    assert asked == cache.load(spark, path).count() > 0
    found.count()  # computed again, not asked again
    again = audit.findings(docs, make=lambda: Counting(str(log)), path=path)
    assert {(r.doc_id, r.field_id): r.finding_id for r in again.collect()} == {k: r.finding_id for k, r in after.items()} and made(log) == asked


def test_a_budget_without_calls_falls_back(spark, docs, plain, tmp_path):
    log = tmp_path / "calls"
    refused = {(r.doc_id, r.field_id): r for r in audit.findings(docs, make=lambda: Counting(str(log)), budget=calls.Budget(None, 0)).collect()}
    assert made(log) == 0 and {k: r.code for k, r in refused.items()} == {k: r.code for k, r in plain.items()}
    errors = [k for k, r in refused.items() if "node:model-error" in r.detail.get("anchor_detector", "")]
    assert errors and all(refused[k].start == plain[k].start for k in errors)


def test_the_plan_keeps_what_is_judged(spark, docs):
    """Spark dropped text_sha beside a generator whose input had pruned structs; such a plan's node is marked by !."""
    judged = audit._judged(study_profiles(docs), STARTER, STARTER_LEXICON, ("in_methods", "in_document"))
    assert "text_sha" in judged.columns and not re.search(r"^[\s:+-]*!", judged._jdf.queryExecution().optimizedPlan().toString(), re.M)


@pytest.mark.parametrize(("budget", "most"), [(calls.Budget(None, 37), 37), (calls.Budget(20 * 520, None), 60), (calls.Budget(10**9, 10**9), 300), (None, 300)])
def test_calls_of_200_tasks_keep_to_the_budget(spark, tmp_path, budget, most):
    log = tmp_path / "calls"
    requests = spark.range(300).select("id", F.concat(F.lit("question number "), F.col("id").cast("string")).alias("prompt")).repartition(200)
    answered, ledger = calls.ask_once(requests, lambda: Counting(str(log)), str(tmp_path / "cache"), budget=budget)
    told = ledger.agg(F.sum("calls").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens")).first()
    assert made(log) == told.calls == answered.where("hit").count() <= (budget.calls if budget and budget.calls else 300)
    assert answered.count() == 300
    if budget and budget.calls == 37:
        assert told.calls == 37
    if budget and budget.tokens == 20 * 520:
        # a reserve is 516 tokens, a call uses 5: what is returned is reserved anew
        assert told.tokens <= budget.tokens and 20 < told.calls and ledger.count() > 2
    if most == 300:
        assert told.calls == 300


def test_tries_are_reserved_and_counted(spark, tmp_path):
    log = tmp_path / "calls"
    requests = spark.range(6).select(F.col("id").cast("string").alias("prompt"))
    answered, ledger = calls.ask_once(requests, lambda: Counting(str(log), fail=2), str(tmp_path / "cache"), budget=calls.Budget(None, 10), retry=calls.Retry(3, 0.0))
    assert answered.where("hit").count() == 3 and made(log) == 9 and ledger.agg(F.sum("calls")).first()[0] == 9


def test_backoff_and_errors_that_are_final():
    class Failing:
        def __init__(self, *errors):
            self.errors = list(errors)

        def complete(self, prompt, *, max_tokens=1024):
            if self.errors:
                raise self.errors.pop(0)
            return "ok"

    waits = []
    assert calls.answer(Failing(OSError("a"), OSError("b")), "x" * 40, 9, calls.Retry(4, 0.5), waits.append) == ("ok", 3, 30, 1, None) and waits == [0.5, 1.0]
    assert calls.answer(Failing(CallError("no key", False)), "x", 9, calls.Retry(4, 0.5), waits.append)[:2] == (None, 1)
    assert calls.answer(Failing(*[OSError("a")] * 9), "x", 9, calls.Retry(2, 0.0), waits.append)[1:2] == (2,)


LOST = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from lacuna.operators import calls
folder = {folder!r}
class Dying:
    def complete(self, prompt, *, max_tokens=1024):
        with open(folder + "/calls", "a") as f:
            f.write(prompt + "\\n")
        if prompt == "7" and not os.path.exists(folder + "/died"):
            open(folder + "/died", "w").close()
            os._exit(1)
        return "1"
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", folder + "/shared").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
answered, ledger = calls.ask_once(spark.range(0, 20, 1, 4).select(F.col("id").cast("string").alias("prompt")), Dying, budget=calls.Budget(None, int(sys.argv[1])))
print("told", answered.where("hit").count(), ledger.agg(F.sum("lost")).first()[0])
"""


@pytest.mark.parametrize("limit", [100, 22])
def test_a_dying_worker_never_breaks_the_budget(tmp_path, limit):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", LOST.format(root=root, folder=str(tmp_path)), str(limit)], capture_output=True, text=True, timeout=300)
    told = [x for x in run.stdout.splitlines() if x.startswith("told")]
    assert told, run.stderr[-2000:]
    hits, lost = map(int, told[0].split()[1:])
    lines = (tmp_path / "calls").read_text().splitlines()
    assert (tmp_path / "died").exists() and lost > 0 and len(lines) <= limit
    assert hits == 20 if limit == 100 else hits < 20
    assert len(lines) - len(set(lines)) <= lost  # only what the dead task had asked is asked again


def test_writers_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "MOST_TABLES", 4)
    path = str(tmp_path / "cache")
    entry = lambda i: spark.createDataFrame([(f"k{i}", f"r{i}")], cache.SCHEMA)
    seen = []

    def write(i):
        cache.save(entry(i), path)
        seen.append(cache.load(spark, path).count())

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(12)))
    assert {tuple(r) for r in cache.load(spark, path).collect()} == {(f"k{i}", f"r{i}") for i in range(12)}
    assert min(seen) >= 1 and len(cache.tables(spark, path)[1]) <= 6 and cache.tables(spark, path)[0] >= 12


@pytest.mark.parametrize("scheme", ["", "viewfs://lacuna/in"])
def test_a_number_is_given_once(spark, tmp_path, scheme):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.lacuna.link./in", f"file://{tmp_path}")
    folder = f"{scheme}/log" if scheme else f"{tmp_path}/log"
    if scheme:
        os.makedirs(tmp_path / "log")
    assert create_if_absent(spark, f"{folder}/1.json", "first") and not create_if_absent(spark, f"{folder}/1.json", "second")
    assert read_small(spark, f"{folder}/1.json") == "first" and [n for n in names_in(spark, folder) if not n.startswith(".")] == ["1.json"]
    assert names_in(spark, f"{folder}/none") == []


def test_http_client(monkeypatch):
    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["content-length"])))
            asked.append((self.headers["x-api-key"], self.headers["workspace"], body))
            code = 200 if len(asked) > 1 else 429
            told = json.dumps({"content": [{"type": "note"}, {"type": "text", "text": "3"}], "usage": {"input_tokens": 11, "output_tokens": 2}}).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(told if code == 200 else b"")

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = HttpClient(f"http://127.0.0.1:{server.server_port}/v1", "some-model", "LACUNA_TEST_KEY", headers={"workspace": "w"})
    with pytest.raises(CallError) as e:
        client.complete("p")
    assert not e.value.retryable
    monkeypatch.setenv("LACUNA_TEST_KEY", "secret-key")
    assert calls.answer(client, "p", 7, calls.Retry(2, 0.0)) == ("3", 2, 11, 2, None)
    assert asked[1] == ("secret-key", "w", {"model": "some-model", "max_tokens": 7, "messages": [{"role": "user", "content": "p"}]})
    server.shutdown()
    with pytest.raises(CallError) as e:
        HttpClient("http://127.0.0.1:9/x", "m", "LACUNA_TEST_KEY", timeout=2).complete("p")
    assert e.value.retryable and "secret-key" not in str(e.value)


def test_env_file(tmp_path, monkeypatch):
    monkeypatch.delenv("LACUNA_X", raising=False)
    monkeypatch.setenv("LACUNA_Y", "kept")
    (tmp_path / ".env").write_text("﻿export LACUNA_X='a=b'\n# no\nLACUNA_Y=other\nbroken\n", encoding="utf-8")
    assert read_env(str(tmp_path / ".env")) == ["LACUNA_X", "LACUNA_Y"] and os.environ["LACUNA_X"] == "a=b" and os.environ["LACUNA_Y"] == "kept"
    assert read_env(str(tmp_path / "none")) == []
    os.environ.pop("LACUNA_X")


def test_prompts_of_one_block_equal_each_fields_own(spark):
    from lacuna.plans.pack import STARTER

    options = F.array(F.struct(F.lit("One").alias("title"), F.lit("body text").alias("body")), F.struct(F.lit("Two").alias("title"), F.lit(" ").alias("body")))
    rows = spark.range(1).select(options.alias("o"))
    for f in STARTER[:3]:
        a, b = rows.select(model.prompt(f, F.col("o")), model.prompts(STARTER, F.lit(f.field_id), model.parts_block(F.col("o")))).first()
        assert a == b and a.endswith("1. One\n   body text\n2. Two\n\nReply with the number only.")


def test_equal_lists_of_parts_are_worked_on_once(spark, monkeypatch, tmp_path):
    seen, ask = [], model.ask_once
    monkeypatch.setattr(model, "ask_once", lambda requests, *more: seen.append(requests.count()) or ask(requests, *more))
    lists = spark.createDataFrame([(f"d{i}", ["One", "Two"], ["a", f"b{i % 2}"]) for i in range(40)], "doc_id string, titles array<string>, bodies array<string>")
    chosen = model.choose_nodes(lists, STARTER, lambda: Counting(str(tmp_path / "calls")), path=str(tmp_path / "cache")).collect()
    assert seen == [2 * len(STARTER)] and made(tmp_path / "calls") == 2 * len(STARTER)
    assert {(r.doc_id, r.field_id) for r in chosen} == {(f"d{i}", f.field_id) for i in range(40) for f in STARTER} and len(chosen) == 40 * len(STARTER)
    assert {(r.node, r.how) for r in chosen} == {(1, "node:model-2of2")}
