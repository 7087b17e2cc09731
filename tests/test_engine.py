import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lacuna.functions import text as T
from lacuna.operators import anchors, cache, retrieve, score
from lacuna.functions import verdicts as V
from lacuna.plans.pack import STARTER, Field, keyword_frame, pack_frame


def canonical(raw):
    t = unicodedata.normalize("NFC", raw).replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"[ \t\xa0]+", " ", t)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" +\n", "\n", t)).strip()


TEXTS = ["", "  \n ", "a  b\t\xa0c \r\n\r\n\r\n\r\nd", "é café. Next (one). 5 end! Z", "x" * 50_000, "One line", "中文。 Ж? A\n\nB. C", "Methods"]


def test_canonical_text(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate([*TEXTS, None])], "doc_id string, text string")
    got = {r.doc_id: (r.canonical_text, r.text_sha) for r in T.canonicalize(df).collect()}
    for i, t in enumerate(TEXTS):
        assert got[str(i)] == (canonical(t), hashlib.sha256(canonical(t).encode()).hexdigest())
    assert got[str(len(TEXTS))] == (None, None)


@pytest.mark.parametrize("pattern", [r"\d+", r"[;:,]", r"(?:ab)+", r"[A-Z]\w*"])
def test_match_spans(spark, pattern):
    texts = ["", "12 ab;abab 7,", "😀1 Zab: é2", "none"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for (t,), row in zip([(t,) for t in texts], df.select(T.match_spans(F.col("t"), "(?U)" + pattern)).collect(), strict=True):
        assert [(s.start, s.end, s.text) for s in row[0]] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, t)]


def test_running_sums_over_many_blocks(spark):
    sizes = [[(7 * i) % 11 for i in range(n)] for n in (0, 1, T.BLOCK, T.BLOCK + 1, 5 * T.BLOCK + 3)]
    df = spark.createDataFrame([(s,) for s in sizes], "s array<int>")
    for s, row in zip(sizes, df.select(T.sums_before(F.col("s"))).collect(), strict=True):
        assert row[0] == [sum(s[:i]) for i in range(len(s))]
    text = "é1 " * (2 * T.BLOCK + 5)
    assert [r.start for r in spark.createDataFrame([(text,)], "t string").select(T.match_spans(F.col("t"), r"\d")).first()[0]] == [m.start() for m in re.finditer(r"\d", text)]


def test_sentences(spark):
    texts = [canonical(t) for t in TEXTS]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, canonical_text string")
    rows = T.sentences(df).orderBy("doc_id", "sent_idx").collect()
    for i, t in enumerate(texts):
        own = [r for r in rows if r.doc_id == i]
        assert [r.sentence for r in own] == re.split(r"(?<=[.!?])\s+(?=[A-Z(])", t)
        assert all(t[r.sent_start : r.sent_end] == r.sentence for r in own)


def test_checklist(spark):
    assert len(STARTER) == 27
    words = {(r.field_id, r.keyword): r.weight for r in keyword_frame(spark).collect()}
    assert words["cellline.name", "cell lines"] == 1 and words["animal.sex", "sex"] == 2
    profiles = spark.createDataFrame([("a", {"has_wet_lab": True, "has_ihc": True}), ("b", {"has_wet_lab": True}), ("c", {})], "doc_id string, features map<string,boolean>")
    got = {(r.doc_id, r.field_id) for r in retrieve.applicable(profiles, pack_frame(spark)).collect()}
    assert ("a", "antibody.identifier") in got and ("b", "antibody.identifier") not in got
    assert {f for d, f in got if d == "c"} == {"stats.replicate_type", "stats.test_named"}


def test_ranking_and_anchor(spark):
    df = spark.createDataFrame([("1", "Intro here. The test was named. Stats test named twice."), ("2", "..")], "doc_id string, canonical_text string")
    always = tuple(f for f in STARTER if not f.all_of)
    ranked = {(r.field_id, r.sent_idx): (r.score, r.rank) for r in retrieve.ranked_candidates(df, always).collect()}
    assert ranked["stats.test_named", 2] == (6, 1) and ranked["stats.test_named", 1] == (4, 2)
    found = {(r.doc_id, r.field_id): (r.detector, r.anchor_start) for r in retrieve.absence_anchors(df, always).collect()}
    assert found["1", "stats.test_named"] == ("anchor:document:keyword", 32)
    assert not any(d == "2" for d, _ in found)


def test_scoring(spark):
    schema = "doc_id string, field_id string, code string, start int, ord int"
    pred = spark.createDataFrame([("d", "f", "GAP_ABSENT", 20, 0), ("d", "f", "GAP_ABSENT", 0, 1), ("d", "g", "GAP_ABSENT", 21, 2), ("e", "f", "GAP_ABSENT", 0, 0), ("d", "h", "GAP_VAGUE", 0, 3)], schema)
    gold = spark.createDataFrame([("d", "f", "GAP_ABSENT", 0, 0), ("d", "g", "GAP_ABSENT", 0, 1), ("d", "h", "GAP_ABSENT", 0, 2), ("x", "f", "GAP_ABSENT", 0, 0)], schema)
    counts = {r.bucket: (r.tp, r.fp, r.fn) for r in score.count_outcomes(score.match_greedy(pred, gold)).collect()}
    assert counts == {"f": (1, 1, 1), "g": (0, 1, 1), "h": (0, 1, 1), "ALL": (1, 3, 3), "code:GAP_ABSENT": (1, 2, 3), "code:GAP_VAGUE": (0, 1, 0)}
    rates = {r.bucket: (r.precision, r.recall, r.f1) for r in score.rates(score.count_outcomes(score.match_greedy(pred, gold))).collect()}
    assert rates["f"] == (0.5, 0.5, 0.5) and rates["g"] == (0.0, 0.0, 0.0)
    bad = pred.withColumn("code", F.lit("GAP_NEW"))
    with pytest.raises(Exception, match="unknown code"):
        score.slices(score.match_single(bad, gold)).collect()


def test_anchors_and_cache(spark):
    df = spark.createDataFrame([("one two\nthree", " two three "), ("abc", ""), ("abc", "zzz"), ("a (b", "(b")], "t string, a string")
    got = [tuple(r[0]) if r[0] else None for r in df.select(anchors.resolve_anchor(F.col("t"), F.col("a"))).collect()]
    assert got == [(4, 13), None, None, (2, 4)]
    key = spark.range(1).select(cache.cache_key(F.lit("p"), F.lit(5))).first()[0]
    assert key == hashlib.sha256(b"5\x1fp").hexdigest()
    empty = spark.createDataFrame([], "key string, response string")
    assert cache.stats(cache.lookup(empty.select("key"), empty)).first().hit_rate == "n/a"


def test_sources(spark, tmp_path):
    import json

    from lacuna.sources import files

    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "p1.txt").write_text("line\nné")
    (tmp_path / "g" / "deep").mkdir(parents=True)
    (tmp_path / "g" / "deep" / "l1.json").write_text(json.dumps({"doc_id": "p1", "labels": [{"field_id": "f", "code": "GAP_ABSENT", "anchor_text": "x"}]}, indent=2))
    (tmp_path / "g" / "other.json").write_text(json.dumps({"note": 1}))
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "p1.json").write_text(json.dumps({"doc_id": "p1", "findings": []}, indent=2))
    assert [tuple(r) for r in files.read_texts(spark, str(tmp_path / "t")).collect()] == [("p1", "line\nné")]
    assert [(r.doc_id, r.stem, r.labels[0].code) for r in files.read_labels(spark, str(tmp_path / "g")).collect()] == [("p1", "l1", "GAP_ABSENT")]
    reports = files.read_reports(spark, str(tmp_path / "r"))
    files.write_reports(reports.drop("stem"), str(tmp_path / "out"))
    assert [(r.doc_id, r.stem) for r in reports.collect()] == [("p1", "p1")] and spark.read.json(str(tmp_path / "out")).count() == 1


QUANTITY_CASES = [
    ("culture.temperature", "cells were maintained at 37 °C", None),
    ("culture.temperature", "incubated at 4 C before lysis", "GAP_OUT_OF_RANGE"),
    ("culture.temperature", "heat-inactivated at 56 °C for 30 min", "GAP_OUT_OF_RANGE"),
    ("culture.co2_fraction", "in a humidified 5% CO2 incubator", None),
    ("centrifugation.force", "spun at 12,000 × g for 10 min", None),
    ("centrifugation.force", "spun at 5 × g", "GAP_OUT_OF_RANGE"),
    ("centrifugation.force", "spun at 5000 rpm", "GAP_DIMENSION_MISMATCH"),
    ("centrifugation.force", "at the rcf of the maker", None),
    ("xenograft.cell_number", "1 × 10^6 cells were injected", None),
    ("xenograft.cell_number", "12 cells were injected", "GAP_OUT_OF_RANGE"),
    ("xenograft.cell_number", "1000-4000 cells were injected", "GAP_RANGE_NOT_POINT"),
    ("xenograft.cell_number", "EC109 cells were injected", "GAP_ABSENT"),
    ("xenograft.cell_number", "MDA-MB-231 cells were injected", "GAP_ABSENT"),
    ("xenograft.cell_number", "5 x 10^6 EC109 cells were injected", None),
    ("xenograft.cell_number", "2 × 10^6 MDA-MB-231 cells were injected", None),
    ("culture.co2_fraction", "grown to 80% confluence in 5% CO2", None),
    ("culture.temperature", "A549 and HCT116 grown at 37 °C", None),
    ("treatment.duration", "treated for 4-6 h", "GAP_RANGE_NOT_POINT"),
    ("treatment.duration", "between 2 and 4 days", "GAP_RANGE_NOT_POINT"),
    ("treatment.concentration", "for 5 min", "GAP_ABSENT"),
    ("treatment.concentration", "with 0, 50, 100, and 150 µM", None),
    ("treatment.concentration", "with 5% serum", "GAP_DIMENSION_MISMATCH"),
    ("animal.age_or_weight", "mice weighing 20-25 g", "GAP_RANGE_NOT_POINT"),
    ("animal.sex", "ten female mice", None),
    ("animal.sex", "ten mice", "GAP_ABSENT"),
    ("qpcr.primer_sequences", "forward ACGTACGTACGTAC", None),
    ("qpcr.primer_sequences", "forward ACGT", "GAP_ABSENT"),
    ("stats.test_named", "by Student's t-test", None),
    ("stats.test_named", "by inspection", "GAP_ABSENT"),
    ("antibody.identifier", "anything", None),
    ("stats.test_named", None, "GAP_ABSENT"),
]


def test_verdicts(spark):
    from lacuna.functions.verdicts import verdict

    by_id = {f.field_id: f for f in STARTER}
    for name in sorted({c[0] for c in QUANTITY_CASES}):
        rows = [(i, t) for i, (n, t, _) in enumerate(QUANTITY_CASES) if n == name]
        df = spark.createDataFrame(rows, "i int, t string").select("i", verdict(F.col("t"), by_id[name]).alias("v"))
        for r in df.collect():
            assert r.v.code == QUANTITY_CASES[r.i][2], QUANTITY_CASES[r.i]


def test_numbers_within_names_and_units_of_other_checklists(spark):
    volume, count, celsius = (Field("x.y", "quantity", d, *r, canonical_unit=u) for d, r, u in (("volume", (), None), ("count", (), None), ("temperature", (20.0, 42.0), "C")))
    cases = [("B1.5 ml tubes", volume, "GAP_ABSENT"), ("A1,000 cells", count, "GAP_ABSENT"), ("a 1.5 ml tube", volume, None), ("kept at 37 °C", celsius, None), ("kept at 900 °C", celsius, None), ("B1.5 ml tubes of 2 ml", volume, None), ("passage number 12 of X", count, None), ("x" * 60 + "5 ml", volume, "GAP_ABSENT")]
    for text, f, code in cases:
        assert spark.createDataFrame([(text,)], "t string").select(V.verdict(F.col("t"), f).alias("v")).first().v.code == code, text
