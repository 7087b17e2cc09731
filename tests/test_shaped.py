"""Documents of unusual shape and degenerate texts: what decides which lines are headings, and equality with the SQL."""

import duckdb
import pytest

from lacuna.operators import degenerate, model
from lacuna.plans import queries as Q
from lacuna.plans.pack import STARTER

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")

    def run(name):
        want = con.sql(Q.ORACLE_SQL[name])
        order = sorted(want.columns)
        got = Q.QUERIES[name](spark, SF)
        assert sorted(got.columns) == order
        rows = got.collect()
        assert sorted(str(tuple(r[c] for c in order)) for r in rows) == sorted(str(tuple(dict(zip(want.columns, r))[c] for c in order)) for r in want.fetchall()) and rows
        return rows

    return run


def test_heads_furniture_and_clauses_are_no_headings(both):
    titles = {r.title for r in both("shaped_tree")}
    assert {"Protocol and assay", "Drug treatment", "Statistical analysis"} <= titles  # recurring unevenly, or once
    assert not {"Journal of Plain Lines", "Page 1234", "Cells were grown", "Briefly spun down", "After the wash", "ABC Smith lab"} & titles
    assert not any(t.startswith("Cancers 2021") for t in titles)


def test_a_prompt_lists_no_more_parts_than_its_limit(both):
    offered = {int(r.how.rpartition("of")[2]) for r in both("shaped_model_nodes") if "of" in r.how}
    assert max(offered) == model.MOST_OPTIONS and min(offered) == 2


def test_degenerate_texts_keep_the_spans_within(both):
    rows = {r.kind: r for r in both("degenerate_report")}
    assert set(rows) == set(degenerate.KINDS) and all(r.empty_spans == r.outside == 0 for r in rows.values())
    assert rows["empty"].findings == rows["blank"].findings == 0 < rows["line"].findings


def test_degenerate_cases(spark):
    docs = spark.createDataFrame([("a:b", "The first line.\nMethods\nCells were kept at 37 C.", 1), ("n", None, 2), ("e", "", 3)], "doc_id string, text string, kind int")
    rows = degenerate.report(docs).collect()
    assert {r.kind: r.documents for r in rows} == dict.fromkeys(degenerate.KINDS, 2)
    assert degenerate.report(docs.limit(0)).count() == 0


def test_degenerate_texts_are_canonicalized_once(spark):
    """Their sizes come from what was written; before, the report canonicalized all texts again for them."""
    docs = spark.createDataFrame([(1, "Methods\nMice were kept. The plain line.")], "doc_id long, text string")
    plan = degenerate.report(docs, STARTER[:2])._jdf.queryExecution().optimizedPlan().toString()
    assert "canonical_text" in plan and "compose" not in plan
