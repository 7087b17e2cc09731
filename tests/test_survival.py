import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lacuna.functions import text as T
from lacuna.operators import perturb, survival
from lacuna.plans import queries as Q
from lacuna.plans.planted import planted

SF = "/root/testdata/sf0.001"
TEXTS = [
    "Intro\n\nEXPERIMENTAL PROCEDURES\nfine qPCR was first.\nImmunohistochemistry at 37 ° and 5 × 3\n next flow\nfinal",
    "\n".join(f"line {i} of fifty, × {i}" for i in range(50)),
    "\n".join(f"{i}. Row" for i in range(23)),
    "one line, no change",
]


def test_places_are_carried_to_the_same_word(spark):
    """Each word that a change leaves alone stands, in the canonical text of the change, where its place is carried to."""
    words = [(t, m.start(), m.group()) for t in TEXTS for m in re.finditer(r"\S+", t)]
    rows = T.canonicalize(spark.createDataFrame(words, "t string, at long, word string").withColumn("text", F.col("t")))
    assert rows.where("t <> canonical_text").isEmpty()
    made, moved = perturb.changes(F.col("t")), perturb.carried(F.col("t"), F.col("at"))
    flat = rows.select("word", "at", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.alias("text"), moved[n].alias("to")) for n, c in made.items()))).alias("x")).select("word", "at", "x.*")
    got = T.canonicalize(flat).collect()
    swapped = {old for pairs in perturb.SWAPS.values() for old, _ in pairs}
    whole = lambda word: word not in perturb.HEADING.split() and not any(s in word for s in swapped)
    for r in got:
        assert not whole(r.word) or r.canonical_text[r.to : r.to + len(r.word)] == r.word, (r.name, r.word, r.at, r.to)
    assert len(got) == len(made) * len(words) and sum(whole(w) for _, _, w in words) > 250


def test_outcomes_of_each_kind(spark):
    """Codes follow from auditing each changed text on its own; ids may be numbers or hold a colon; null and empty texts have no rows."""
    some = [r.text for r in planted(spark, SF).where("doc_id in ('0', '6', '23')").orderBy("doc_id").collect()]
    docs = T.canonicalize(spark.createDataFrame([*((f"a:{i}", t) for i, t in enumerate(some)), ("null", None), ("", ""), ("plain", "nothing")], "doc_id string, text string"))
    rows = survival.survival(docs).collect()
    assert {r.doc_id for r in rows} <= {"a:0", "a:1", "a:2", "plain"} and len({(r.doc_id, r.change, r.field_id) for r in rows}) == len(rows)
    changed = {(r.doc_id, r.name): r.text for r in perturb.perturbed(docs.where("text is not null").withColumn("text", F.col("canonical_text"))).collect()}
    plain = {r.doc_id: r.canonical_text for r in docs.collect()}
    assert {(r.doc_id, r.change) for r in rows} <= {k for k, t in changed.items() if t != plain[k[0]]}
    for r in rows:
        want = "new" if r.code is None else "lost" if r.new_code is None else "recoded" if r.code != r.new_code else "kept" if abs(r.start - r.new_start) <= 20 else "moved"
        assert r.outcome == want and (r.code is not None or r.start is None)
    counts = survival.survival_counts(spark.createDataFrame(rows, "doc_id string, change string, field_id string, outcome string, code string, start long, end long, new_code string, new_start long, new_end long"))
    assert sum(r.kept + r.moved + r.recoded + r.lost + r.new for r in counts.collect()) == len(rows)


@pytest.mark.parametrize("name", ["perturbation_survival", "heading_drift"])
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(Q.ORACLE_SQL[name])
    order = sorted(want.columns)
    rows = Q.QUERIES[name](spark, SF).collect()
    got = sorted(str(tuple(r[c] for c in order)) for r in rows)
    assert got == sorted(str(tuple(dict(zip(want.columns, r))[c] for c in order)) for r in want.fetchall()) and got
    if name == "perturbation_survival":
        assert {r.outcome for r in rows} == set(survival.OUTCOMES)
