"""What keeps the work in proportion to the input: each test failed, or took many times as long, before its change."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lacuna.functions import text as T


def test_unsettled_class_asks_bounds_first(spark):
    # every code point of the class, and none besides, with Latin ones turned away by the first bound
    assert re.match(r"\[\\x\{300\}-\\x\{[0-9a-f]+\}&&", T.unsettled_class())
    loose = lambda c: unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c) or unicodedata.category(c)[0] == "M" or 0x1160 <= ord(c) <= 0x11FF
    points = [p for p in range(1, 0x110000) if not 0xD800 <= p <= 0xDFFF]
    rows = spark.createDataFrame([(p, chr(p)) for p in points if p < 0x3400 or 0xA000 <= p < 0xB000 or p >= 0xF900 and p % 7 == 0 or loose(chr(p))], "p int, c string")
    found = {r.p for r in rows.where(F.col("c").rlike(T.unsettled_class())).collect()}
    tried = {r.p for r in rows.collect()}
    assert found == {p for p in tried if p >= 0x300 and loose(chr(p))}


def test_equal_texts_are_audited_once(spark, monkeypatch):
    # 60 documents of 3 texts, one null: what is worked on doesn't grow with the copies, and each has its own findings
    from lacuna.operators import audit, copies

    monkeypatch.setattr(copies, "AT_ONCE", 7)
    body = "Methods\nCells were spun at high speed. " + "A plain line of words. " * 20
    docs = T.canonicalize(spark.createDataFrame([(str(i), (body, body + "Rats were fed.", None)[i % 3]) for i in range(60)], "doc_id string, text string")).drop("text")
    texts, each = copies.once_a_text(docs)
    assert texts.count() == 3
    assert sorted(r.doc_id for r in each(texts).collect()) == sorted(map(str, range(60)))
    worked_on = []
    monkeypatch.setattr(audit, "study_profiles", lambda t, was=audit.study_profiles: worked_on.append(t.count()) or was(t))
    found = audit.findings(docs).collect()
    assert worked_on == [3]
    sets = {}
    for r in found:
        sets.setdefault(r.doc_id, set()).add((r.field_id, r.code, r.start, r.end))
    assert len(sets) == 40 and sets["0"] and all(sets[str(i)] == sets[str(i % 3)] for i in range(60) if i % 3 < 2)
    assert len({r.finding_id for r in found}) == len(found)


def test_stems_miss_no_sign(spark):
    # whatever a sign matches holds a stem of its feature: each sign's text, in other cases and with letters that fold to ASCII
    from lacuna.operators import profile as P

    said = {
        "has_animals": ["mice", "mouse", "rats", "murine"],
        "has_cell_lines": ["reporter T cells", "transfected", "primary rat cultures", "cell lines", "cells were seeded", "cell culture"],
        "has_qpcr": ["qRT-PCR", "RT-qPCR", "real time PCR", "quantitative PCR", "TaqMan", "SYBR"],
        "has_western_blot": ["western blot", "immunoblots"],
        "has_ihc": ["immunohistochemistry", "IHC"],
        "has_flow_cytometry": ["flow cytometry", "FACS", "fluorescence-activated cell", "annexin V", "propidium iodide"],
        "has_xenograft": ["xenografts", "tumor-bearing", "orthotopically implanted", "subcutaneous injection", "injected orthotopically"],
        "has_drug_treatment": ["at the indicated concentrations", "graded concentrations of", "blocking an antibody", "stimulated with", "treatment with an agent", "administered", "dosed with", "IC50", "treated with"],
        "has_wet_lab": ["cultured", "dissected", "extracted", "stained", "purified", "perfused"],
    }
    assert sum(map(len, P.SIGNS.values())) + len(P.ANIMALS) + len(P.DOSING) + 1 + len(P.BENCH_WORK) >= sum(map(len, said.values())) - 2
    odd = lambda t: t.replace("s", "ſ").replace("k", "K").replace("i", "ı")
    rows = [(f"{f}|{i}|{t}", v) for f, texts in said.items() for i, t in enumerate(texts) for v in (t, t.upper(), odd(t), odd(t.upper()))]
    docs = spark.createDataFrame([(n, k, f"We say {v} here.") for n, (k, v) in enumerate(rows)], "doc_id int, k string, canonical_text string")
    # features as they are: a filter on them would copy their whole expression
    found = P.study_profiles(docs.localCheckpoint()).select("k", "features").collect()
    assert [r.k for r in found if not r.features[r.k.split("|")[0]]] == []
    assert all(r.features["has_wet_lab"] for r in found)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_sentence_is_lowered_once_for_all_keywords(spark):
    from lacuna.operators import retrieve

    docs = T.canonicalize(spark.createDataFrame([("1", "Mice were kept. Cells were spun at 5 x g. Nothing.")], "doc_id string, text string"))
    assert _plan(retrieve.ranked_candidates(docs)).count("lower(") <= 2
    plan = _plan(retrieve.absence_anchors(docs, retrieve.STARTER))
    assert plan.count("lower(") <= 2 and "SortAggregate" not in plan  # a sort would take all sentences along
    words = ["cell", "CELL CULTURE at", "excellent", "no such"]
    low = spark.createDataFrame([(w.lower(),) for w in words], "low string")
    got = low.select(retrieve.holds_keyword(F.col("low"), retrieve.STARTER).alias("any"), *(retrieve.keyword_score(F.col("low"), f).alias(f.field_id.replace(".", "_")) for f in retrieve.STARTER)).collect()
    assert all(r["any"] == (sum(r[1:]) > 0) for r in got)


def test_sentences_that_state_no_quantity_are_one(spark):
    from lacuna.functions import verdicts as V
    from lacuna.plans.pack import STARTER

    texts = ["", "Nothing is stated.", "per cent %", "rcf was given", "RCF", "at 5 x g", "\u0663 cells", "12 cells", "at 37 °C", "rpm"]
    fields = [f for f in STARTER if f.type == "quantity"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", V.may_state(F.col("t")).alias("may"), *(V.verdict(F.col("t"), f).alias(f"v{i}") for i, f in enumerate(fields))).collect()
    empty = rows[0][2:]
    assert not rows[0].may and {r.t for r in rows if not r.may} == {"", "Nothing is stated.", "per cent %", "rpm"}
    assert all(r[2:] == empty for r in rows if not r.may)


@pytest.mark.parametrize("query", ["planted_scoping", "planted_counts"])
def test_copies_are_given_results_not_findings(spark, tmp_path, monkeypatch, query):
    """Ids 4620 apart have one text: what is found is worked out for one of them, and each gets its rows."""
    from lacuna.plans import planted_queries

    ids = [*range(1, 9), *range(4621, 4629), *range(9241, 9249)]
    spark.createDataFrame([(i, "") for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    audited, findings = [], planted_queries.audit.findings
    monkeypatch.setattr(planted_queries.audit, "findings", lambda docs: audited.append(docs.count()) or findings(docs))
    rows = [r.asDict() for r in getattr(planted_queries, query)(spark, str(tmp_path)).collect()]
    assert audited == [8] and rows
    of = lambda k: sorted(str({**r, "doc_id": int(r["doc_id"]) - 4620 * k}) for r in rows if (int(r["doc_id"]) - 1) // 4620 == k)
    assert of(0) == of(1) == of(2) and 3 * len(of(0)) == len(rows)


def test_a_text_without_methods_is_split_once_and_gives_one_head_a_scope(spark):
    # the methods of a text without their heading are the whole document: one row stands for both, and only the first
    # substantive sentence of a scope goes to the aggregation, not all of them
    from lacuna.operators import audit, profile

    body = "A plain line of words was written. " * 40
    docs = T.canonicalize(spark.createDataFrame([("a", "Ok. 12. " + body), ("b", "Methods\n" + body + "\nReferences\nSmith."), ("c", "1. 2."), ("d", "")], "doc_id string, text string")).drop("text")
    profiled = profile.study_profiles(docs)
    rows = {(r.doc_id, r.scope): r for r in audit.scopes(profiled, audit.STARTER, once=True).collect()}
    assert {k for k in rows if k[0] != "b"} == {("a", audit.METHODS), ("c", audit.METHODS), ("d", audit.METHODS)} and {("b", audit.METHODS), ("b", audit.DOCUMENT)} <= set(rows)
    assert {k[0]: r.twice for k, r in rows.items() if k[1] == audit.METHODS} == {"a": True, "b": False, "c": True, "d": True}
    texts = spark.createDataFrame([(t,) for t in ("Ok. 12. A plain line of words. Another line here.", "A plain line. B.", "1. 2.", "", "  \n")], "t string")
    assert [r.n for r in texts.select(audit._first_good(F.col("t")).alias("n")).collect()] == [1, 0, -1, -1, -1]
    heads = {(r.doc_id, r.head_of): r["head"].text if r["head"] else None for r in audit._bearing(profiled, audit.STARTER).where("field_id is null").collect()}
    assert heads[("a", audit.METHODS)] == heads[("a", audit.DOCUMENT)] == "A plain line of words was written."
    assert heads[("c", audit.DOCUMENT)] is None and heads[("d", audit.DOCUMENT)] is None and ("c", audit.METHODS) not in heads


def test_folding_visits_only_the_runs_that_change():
    # single blanks, most of a text's white space, stay as they are without a step in Python for each
    from lacuna.operators import anchors

    text = "a b\n c\td  e\u00a0f \r\n\r\n g" + " word" * 50 + "  "
    folded, cuts = anchors.fold(text)
    assert folded == "a b c d e f g" + " word" * 50 + " " and cuts == [(4, 1), (8, 2), (12, 7), (264, 8)]
    assert [m.group() for m in anchors._RUN.finditer(text)] == ["\n ", "\t", "  ", "\u00a0", " \r\n\r\n ", "  "]


def test_only_keys_with_findings_and_labels_are_matched(spark, monkeypatch):
    # most findings have no label of their field and code: they are false positives without being sorted into islands
    from lacuna.operators import score

    schema = "doc_id string, field_id string, code string, start int, ord int"
    pred = spark.createDataFrame([("a", f"f{i}", "C", 10, i) for i in range(20)] + [("b", "f0", "C", 10, 0), ("z", "f0", "C", 10, 0)], schema)
    gold = spark.createDataFrame([("a", "f0", "C", 15, 0), ("a", "f1", "D", 10, 1), ("b", "f0", "C", 99, 0), ("c", "f0", "C", 10, 0)], schema)
    seen = []
    monkeypatch.setattr(score, "islands", lambda rows, was=score.islands: seen.append(rows.count()) or was(rows))
    out = {}
    for r in score.match_greedy(pred, gold).collect():
        out[r.doc_id, r.outcome] = out.get((r.doc_id, r.outcome), 0) + 1
    assert out == {("a", "tp"): 1, ("a", "fp"): 19, ("a", "fn"): 1, ("b", "fp"): 1, ("b", "fn"): 1, ("c", "fn"): 1}
    assert seen == [4]
