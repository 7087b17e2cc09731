"""Checklists, lexicons, settings, caches, sinks, labels and the stand-in model, on small files and rows."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from lacuna.functions import triggers as G
from lacuna.operators import cache, gold, model
from lacuna.plans import planted_queries as Q
from lacuna.plans.pack import STARTER, by_id
from lacuna.sources import checklists, files


def test_checklists_and_lexicons(tmp_path):
    pack = {"version": "9", "fields": [{"field_id": "a.b", "type": "quantity", "dimension": "time", "canonical_unit": "s", "plausible_range": ["1e1", "1e4"], "applies_when": ["has_qpcr"], "provenance": [{"guideline": "G", "item": "2"}]}, {"field_id": "c.d", "type": "text"}]}
    (tmp_path / "p.json").write_text(json.dumps(pack))
    version, fields = checklists.read_checklist(str(tmp_path / "p.json"))
    assert version == "9" and (fields[0].low, fields[0].high, fields[0].all_of) == (10.0, 10000.0, ("has_qpcr",)) and (fields[1].sensitivity, fields[1].low) == ("HIGH", None)
    assert "Quantity of: time, normally reported in s\nRequired by: G item 2" in model.describe(fields[0])
    assert by_id(fields, "c.d") == fields[1] and by_id(fields, "x") is None
    (tmp_path / "l.json").write_text(json.dumps({"qualitative_quantity": ["a bit"], "relative_condition": ["overnight"], "deferred_reference": {"patterns": ["x"]}}))
    lexicon = checklists.read_lexicon(str(tmp_path / "l.json"))
    assert lexicon.fills("qualitative_quantity") == {"a bit": G.ANY} and lexicon.fills("relative_condition") == {"overnight": ("time", "time_or_mass")}
    yaml = pytest.importorskip("yaml")
    (tmp_path / "p.yaml").write_text(yaml.safe_dump(pack))
    assert checklists.read_checklist(str(tmp_path / "p.yaml")) == (version, fields)


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("LACUNA_B", "kept")
    (tmp_path / "s").write_text("﻿# no\nexport LACUNA_A='x y'\nLACUNA_B=2\n\nnonsense\n", encoding="utf-8")
    assert checklists.read_settings(str(tmp_path / "s")) == ["LACUNA_A", "LACUNA_B"] and checklists.read_settings(str(tmp_path / "none")) == []
    import os

    assert (os.environ.pop("LACUNA_A"), os.environ["LACUNA_B"]) == ("x y", "kept")


def test_cache_files(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert cache.load(spark, path).count() == 0
    cache.save(spark.createDataFrame([("a", "1")], cache.SCHEMA), path)
    assert {tuple(r) for r in cache.save(spark.createDataFrame([("b", "2"), ("a", "1")], cache.SCHEMA), path).collect()} == {("a", "1"), ("b", "2")} == {tuple(r) for r in cache.load(spark, path).collect()}
    assert cache.path_for("x/y:1") == "cache/responses.x_y_1"


def test_calls_are_made_once_and_failures_cost_nothing(spark):
    requests = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "a"), (4, "abcd")], "i int, prompt string")
    old = requests.where("i = 4").select(model.cache.cache_key(F.col("prompt"), F.lit(512)).alias("key"), F.lit("old").alias("response"))
    answered, new = model.ask(requests, Q.StandIn, old)
    assert {r.i: r.response for r in answered.collect()} == {1: Q.ANSWERS[2], 2: Q.ANSWERS[2], 3: None, 4: "old"} and new.count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "doc_id string, score double")
    assert files.write_each(rows, str(tmp_path / "each")) == 2 and json.loads((tmp_path / "each" / "b.json").read_text()) == {"doc_id": "b", "score": 0.5}
    files.write_panel(rows.select(F.lit("p").alias("set"), F.col("doc_id").alias("bucket"), "score"), str(tmp_path / "panel.txt"), ["set"])
    assert (tmp_path / "panel.txt").read_text() == "p\nbucket  score\na  1.000\nb  0.500\n"
    (tmp_path / "x.pdf").write_bytes(b"one|two||")
    pages = lambda content: [p or None for p in content.decode().split("|")]
    assert files.read_pages(spark, str(tmp_path), pages).first().raw_text == "one\ntwo\n\n"
    assert files.read_pages(spark, str(tmp_path), pages, skip_empty=True).first().raw_text == "one\ntwo\n"


def test_labels_of_all_kinds(spark):
    docs = spark.createDataFrame([("d", "One two\nthree. Four.", "s")], "doc_id string, canonical_text string, text_sha string")
    labels = spark.createDataFrame([("d", "f", "two three."), ("d", "f", " "), ("d", "f", None), ("d", "f", "five"), ("z", "f", "One"), ("alias", "f", "Four.")], "doc_id string, field_id string, anchor_text string")
    got = [(r.outcome, r.start, r.end) for r in gold.resolve_labels(labels, docs, {"alias": "d"}).collect()]
    assert sorted(got, key=str) == sorted([("resolved", 4, 14), ("no_anchor", None, None), ("no_anchor", None, None), ("unresolved", None, None), ("no_document", None, None), ("resolved", 15, 20)], key=str)


@pytest.mark.parametrize("name", ["planted_labels", "planted_coverage", "planted_changes", "greedy_repeats", "answer_index", "token_usage", "run_configurations", "planted_prompts"])
def test_planted_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(Q.ORACLE_SQL[name])
    order = sorted(want.columns)
    got = Q.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == order
    key = lambda rows: sorted(map(str, rows))
    assert key(tuple(r[c] for c in order) for r in got.collect()) == key(tuple(dict(zip(want.columns, r))[c] for c in order) for r in want.fetchall())
    assert set(Q.QUERIES) == set(Q.ORACLE_SQL) and len(STARTER) == 27


def test_a_failed_task_leaves_no_files(spark, tmp_path):
    """Files come all at once: those of a set that fails in one of its tasks never appear."""
    path = tmp_path / "each"
    rows = spark.range(0, 40, 1, 8).select(F.col("id").cast("string").alias("doc_id"), F.lit("ä").alias("x"))
    assert files.write_each(rows, str(path)) == 40 and (path / "7.json").read_text(encoding="utf-8") == '{\n  "doc_id": "7",\n  "x": "ä"\n}'
    with pytest.raises(Exception, match="can't be a file's name"):
        files.write_each(rows.select(F.when(F.col("doc_id") == "39", "../out").otherwise(F.concat(F.lit("new"), "doc_id")).alias("doc_id"), "x"), str(path))
    assert sorted(p.name for p in path.iterdir()) == sorted(["_SUCCESS", *(f"{i}.json" for i in range(40))]) and not (tmp_path / "out.json").exists()
