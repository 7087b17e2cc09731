"""One expression for any field equals each field's own; long checklists plan fast; islands of matches; anchors in one pass."""

import random
import re
import time

from pyspark.sql import functions as F

from lacuna.functions import rules, text as T
from lacuna.functions import triggers as G
from lacuna.functions import verdicts as V
from lacuna.operators import anchors, audit, score
from lacuna.plans.pack import STARTER, Field
from lacuna.plans.planted import SEGMENTS

ODD = (*STARTER, Field("dose.strength", "quantity", "no_such_dimension"), Field("thing.kind", "unheard_of"), Field("culture.warmth", "quantity", "temperature", 1.0, 2.0), Field("any.flag", "boolean"))


def test_rules_equal_each_fields_own(spark):
    lines = sorted({s.strip() for _, choices in SEGMENTS for c in choices for s in re.split(r"(?<=[.!?])\s+|\n", c) if s.strip()}) + ["Between 4 and 8 C it was 5% warm, as indicated.", "From 3 to 5 min at 4 C; 2% of it.", "", None]
    texts = spark.createDataFrame([(x,) for x in lines], "x string").withColumn("spans", G.trigger_spans(F.col("x"))).persist()
    joined = texts.crossJoin(rules.rule_frame(spark, ODD))
    got = {(r.x, r.field_id): (r.v, r.t) for r in joined.select("x", "field_id", rules.verdict_by(F.col("x"), F.col("rule"), ODD).alias("v"), rules.trigger_by(F.col("x"), F.col("rule"), F.col("spans")).alias("t")).collect()}
    for at in range(0, len(ODD), 8):
        some = ODD[at : at + 8]
        own = texts.select("x", *(F.struct(V.verdict(F.col("x"), f), G.trigger_verdict(F.col("x"), f, spans=F.col("spans"))).alias(str(i)) for i, f in enumerate(some))).collect()
        for r in own:
            for i, f in enumerate(some):
                v, t = got[r.x, f.field_id]
                assert tuple(v) == tuple(r[str(i)][0]) and (t and tuple(t)) == (r[str(i)][1] and tuple(r[str(i)][1])), (r.x, f.field_id)


def test_a_judgement_does_not_grow_with_the_checklist(spark):
    many = tuple(Field(f"area{i % 9}.detail_{i}", "quantity" if i % 2 else "text", "temperature" if i % 2 else None) for i in range(500))
    docs = spark.createDataFrame([("The detail was 5 C as indicated.",)], "x string").crossJoin(rules.rule_frame(spark, many))
    began = time.time()
    made = docs.select("field_id", rules.verdict_by(F.col("x"), F.col("rule"), many).alias("v"), rules.trigger_by(F.col("x"), F.col("rule"), G.trigger_spans(F.col("x"))).alias("t"))
    made._jdf.queryExecution().executedPlan()
    assert time.time() - began < 5 and made.count() == 500


def test_each_document_by_its_own_checklist(spark):
    """Two checklists audited apart give the union of both, which a row of rules each makes possible."""
    docs = T.canonicalize(spark.createDataFrame([("a", "Methods\nCells were grown at high speed. Values were compared here. " * 12)], "doc_id string, text string")).drop("text")
    first, second = STARTER[22:24], (Field("culture.warmth", "quantity", "temperature"),)
    told = lambda pack: {(r.field_id, r.code) for r in audit.findings(docs, pack).collect()}
    assert told((*first, *second)) == told(first) | told(second)


def greedy(pred, gold):
    """The plain loop: in order, each finding takes the first free label of its key within the tolerance."""
    labelled = {g[0] for g in gold}
    free, out = sorted(gold, key=lambda g: g[4]), []
    for p in sorted((p for p in pred if p[0] in labelled), key=lambda p: p[4]):
        hit = next((g for g in free if g[:3] == p[:3] and abs(g[3] - p[3]) <= score.TOLERANCE), None)
        if hit:
            free.remove(hit)
        out.append((*p[:3], "tp" if hit else "fp"))
    return sorted(out + [(*g[:3], "fn") for g in free])


def test_greedy_islands_equal_the_plain_loop(spark):
    draw = random.Random(11)
    side = lambda n, spread: [(draw.choice("ab"), draw.choice(["f", "g"]), "C", draw.randrange(spread), i) for i in range(n)]
    schema = "doc_id string, field_id string, code string, start int, ord int"
    for n, spread in ((60, 400), (150, 20_000), (200, 900_000), (0, 5)):
        pred, gold = side(n, spread), side(n // 2, spread)
        pred += [("a", "f", "C", at, 1000 + i) for i, at in enumerate(range(0, 9000, 15))] if n == 150 else []
        got = score.match_greedy(spark.createDataFrame(pred, schema), spark.createDataFrame(gold, schema))
        assert sorted(tuple(r) for r in got.select("doc_id", "field_id", "code", "outcome").collect()) == greedy(pred, gold)


def test_a_key_of_many_findings_goes_to_several_tasks(spark):
    rows = spark.range(40_000).select(F.lit("d").alias("doc_id"), F.lit("f").alias("field_id"), F.lit("C").alias("code"), (F.col("id") * 100).cast("int").alias("start"), F.col("id").cast("int").alias("ord"))
    found = score.match_greedy(rows, rows.where("id % 2 = 0"))
    assert {r.outcome: r["count"] for r in found.groupBy("outcome").count().collect()} == {"tp": 20_000, "fp": 20_000}
    parts = score.islands(rows.withColumn("side", F.lit(0)))
    assert parts.select("island").distinct().count() == 40_000


def place_plainly(text, anchor, loose):
    clean = re.sub(r"^\s+|\s+$", "", anchor or "")
    if not clean or text is None:
        return None
    if (at := text.find(clean)) >= 0:
        return at, at + len(clean)
    hit = loose and re.search(r"\s+".join(map(re.escape, clean.split())), text)
    return hit.span() if hit else None


def test_anchors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(anchors, "BLOCK_CHARS", 40)
    draw = random.Random(2)
    words = ["one", "two", "three\\E", "é😀", "a.b", "(", "one two"]
    gap = lambda: draw.choice([" ", "  ", "\n", " \t ", " "])
    texts = [(f"d{i}", "".join(draw.choice(words) + gap() for _ in range(draw.randint(0, 25)))) for i in range(60)] + [("null", None), ("empty", "")]
    listed = [(i, gap() + gap().join(draw.choice(words) for _ in range(draw.randint(1, 3)))) for i in range(40)] + [(98, "  "), (99, None)]
    docs = spark.createDataFrame(texts, "doc_id string, canonical_text string")
    for loose in (True, False):
        got = {(r.doc_id, r.anchor_id): (r.start, r.end) for r in anchors.resolve_anchors(docs, spark.createDataFrame(listed, "anchor_id int, anchor_text string"), loose=loose).collect()}
        want = {(d, i): p for d, t in texts for i, a in listed if (p := place_plainly(t, a, loose))}
        assert got == want


def test_an_anchor_may_hold_the_quotes_end(spark):
    row = spark.createDataFrame([("x three\\E  two", "three\\E two")], "t string, a string")
    assert tuple(row.select(anchors.resolve_anchor(F.col("t"), F.col("a")).alias("p")).first().p) == (2, 14)


def test_nfc_of_what_it_concerns(spark):
    import unicodedata

    marks = ["e\u0301", "\u212b", "\u2126", "\u1100\u1161\u11a8", "\u2000", "\uf900", "\u0958", "a\u0301\u0316", "a\u0307\u0323"]
    plain = ["\u201ccurly\u201d \u2013 dash \u2014 \u00b0", "\u65e5\u672c", "\u00e9", "\uac01", "\U0001f600", None, ""]
    wanted = spark.createDataFrame([(i, x) for i, x in enumerate(marks + plain)], "i int, x string")
    got = {r.i: (r.hit, r.x) for r in T.to_nfc(wanted.withColumn("hit", F.col("x").rlike(T.unsettled_class())), "x").collect()}
    assert [got[i][0] for i in range(len(marks))] == [True] * len(marks) and not any(got[i][0] for i in range(len(marks), len(got)))
    assert all(got[i][1] == (x and unicodedata.normalize("NFC", x)) for i, x in enumerate(marks + plain))
