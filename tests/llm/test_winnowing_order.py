"""Neighbours by id: null and string ids, ties, repeated rows, one id with most rows, many ranges, a very long text."""

import random

import pytest
from pyspark.sql import functions as F

from lacuna.llm import winnowing as W
from tests.llm.test_operators import brute_prints

R = random.Random(11)


def words(n):
    return " ".join(R.choice(["one", "two", "three", "four", "zwölf", "😀"]) + str(R.randint(0, 99)) for _ in range(n))


def expected(rows, hash_of):
    """(id, text, the next row's text) by falling id, null ids last, ties by falling hash of the text."""
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], hash_of[r[1] or ""]), reverse=True)
    known += sorted((r for r in rows if r[0] is None), key=lambda r: hash_of[r[1] or ""], reverse=True)
    return [(i, t or "", known[(k + 1) % len(known)][1] or "") for k, (i, t) in enumerate(known)]


def likeness(a, b):
    a, b = ({h for _, h in brute_prints(x)} for x in (a, b))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_neighbours(spark, kind, monkeypatch):
    monkeypatch.setattr(W, "RANGES_EACH", 8)
    named = {"long": lambda i: i, "string": lambda i: f"d{i:03d}", "date": lambda i: f"2020-01-{i % 28 + 1:02d}"}[kind]
    rows = [(None if i is None else named(i), words(R.randint(0, 30))) for i in [*range(40), *[7] * 25, None, None]]
    rows += [rows[3], rows[3], (named(5), None), (named(6), "")]
    df = spark.createDataFrame(rows, "doc_id string, text string").select(F.col("doc_id").cast(kind).alias("doc_id"), "text")
    hash_of = {r.text: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    keep = (lambda x: x) if kind != "date" else (lambda x: None if x is None else str(x))
    got = sorted((str(keep(r.doc_id)), r.n_chars, round(r.near_next, 9)) for r in W.edited_likeness_query(df.withColumn("o", F.lit("clash"))).collect())
    assert got == sorted((str(i), len(t), round(likeness(t, after), 9)) for i, t, after in expected(rows, hash_of))


def test_one_id_and_a_long_text(spark):
    long = words(200_000)
    df = spark.createDataFrame([(1, "x"), (2, long)], "doc_id long, text string")
    got = {r.doc_id: r for r in W.edited_likeness_query(df).collect()}
    assert got[2].n_chars == len(long) and 0.6 < got[2].near_edited <= 1.0 and got[1].near_next == 0.0
    one = W.edited_likeness_query(df.where("doc_id = 1")).first()
    assert (one.near_edited, one.near_next) == (1.0, 1.0)
    assert W.range_bounds(df.limit(0).withColumnRenamed("doc_id", "o"), 8).first().bounds == []


def test_bounds_below_a_value(spark):
    bounds = sorted(R.sample(range(5000), 777))
    for some in ([], [4], bounds):
        df = spark.range(-1, 5001).select(F.array(*map(F.lit, some)).cast("array<long>").alias("b"), "id")
        assert all(r.n == sum(x < r.id for x in some) for r in df.select("id", W.below(F.col("b"), F.col("id")).alias("n")).collect())
    assert spark.range(1).select(W.below(F.sequence(F.lit(0), F.lit(2 * W.MAX_RANGES - 2)), F.lit(1 << 30))).first()[0] == 2 * W.MAX_RANGES - 1


def test_texts_beyond_the_position_field_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(W, "_LAST", 50)
    df = spark.createDataFrame([("a" * 50,), ("a" * 51,)], "t string")
    assert len(df.where("length(t) = 50").select(W.winnow(F.col("t"))).collect()) == 1
    with pytest.raises(Exception, match="code points"):
        df.select(W.winnow(F.col("t"))).collect()
