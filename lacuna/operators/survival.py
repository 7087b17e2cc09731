"""What an audit's findings become when a text is changed in a way that must not matter.

The texts and their changes are audited as documents of one run, whose findings are written once; a place of the unchanged
text is carried into the changed one before the two are compared. Work and rows grow with the number of texts: a text has
at most 14 changes, and a finding at most a field in each. Equal texts are changed and audited once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import triggers as G
from lacuna.functions.text import canonicalize
from lacuna.operators import audit, perturb
from lacuna.operators.copies import once_a_text
from lacuna.operators.score import TOLERANCE
from lacuna.plans.pack import STARTER, Field
from lacuna.sources.shared import written

UNCHANGED = "unchanged"
# Headings, the first of which that a text holds is renamed once; by what.
KNOWN_HEADINGS = ("EXPERIMENTAL PROCEDURES", "MATERIALS AND METHODS", "Materials and Methods", "Materials and methods")
OTHER_HEADINGS = ("Patients and Methods", "Online Methods", "Materials & Methods")
OUTCOMES = ("kept", "moved", "recoded", "lost", "new")


def _variants(docs: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """canonical_text, text_sha, change, of, doc_id: each text as it is and each change that alters it, under an id of its own made of the change's number and the document's id (of)."""
    rows = [(UNCHANGED, F.col("canonical_text")), *((n, F.when(c != F.col("canonical_text"), c)) for n, c in changed.items())]
    each = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(i).alias("i"), F.lit(n).alias("change"), c.alias("text"))) for i, (n, c) in enumerate(rows))))
    flat = docs.where(F.col("canonical_text").isNotNull()).select(F.col("doc_id").alias("of"), F.explode(each).alias("x"))
    return canonicalize(flat.select("of", "x.change", F.concat_ws(":", "x.i", "of").alias("doc_id"), "x.text")).drop("text")


def _change_of(names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, (UNCHANGED, *names))), F.substring_index("doc_id", ":", 1).cast("int") + 1)


def survival(docs: DataFrame, pack: tuple[Field, ...] = STARTER, lexicon: G.Lexicon = G.STARTER_LEXICON) -> DataFrame:
    """doc_id, change, field_id, outcome, code, start, end, new_code, new_start, new_end: each finding of each document under each change that alters its text.

    docs: doc_id (unique, not null), canonical_text. start and end are where the change takes the finding's span. outcome:
    kept (same code, starts within TOLERANCE), moved (same code, elsewhere), recoded (another code), lost (no finding left),
    new (none before: code, start and end are null). Changes that leave a text as it is, null and empty texts have no rows.
    """
    names = list(perturb.changes(F.col("canonical_text")))
    kind = docs.schema["doc_id"].dataType
    docs, each = once_a_text(docs)
    texts = written(_variants(docs, perturb.changes(F.col("canonical_text"))), "variants")
    found = audit.findings(texts.select("doc_id", "canonical_text", "text_sha"), pack, lexicon).select("doc_id", "field_id", "code", "start", "end")
    found = written(found.withColumn("change", _change_of(names)).withColumn("doc_id", F.expr("substring(doc_id, locate(':', doc_id) + 1)").cast(kind)), "survival")
    base = found.where(F.col("change") == UNCHANGED).drop("change")
    held = texts.where(F.col("change") == UNCHANGED).select(F.col("of").alias("doc_id"), "canonical_text")
    altered = texts.where(F.col("change") != UNCHANGED).groupBy(F.col("of").alias("doc_id")).agg(F.collect_set("change").alias("changes"))  # 14 at most
    rows = base.join(held.join(altered, "doc_id"), "doc_id")
    starts, ends = (perturb.carried(F.col("canonical_text"), F.col(c)) for c in ("start", "end"))
    moved = F.array(*(F.struct(F.lit(n).alias("change"), F.when(F.array_contains("changes", n), F.struct(starts[n].alias("start"), ends[n].alias("end"))).alias("at")) for n in names))
    taken = rows.select("doc_id", "field_id", "code", F.explode(moved).alias("x")).where("x.at is not null").select("doc_id", "x.change", "field_id", "code", "x.at.start", "x.at.end")
    left = found.where(F.col("change") != UNCHANGED).select("doc_id", "change", "field_id", F.col("code").alias("new_code"), F.col("start").cast("long").alias("new_start"), F.col("end").cast("long").alias("new_end"))
    both = taken.join(left, ["doc_id", "change", "field_id"], "full")
    near = F.abs(F.col("start") - F.col("new_start")) <= TOLERANCE
    outcome = F.when(F.col("code").isNull(), "new").when(F.col("new_code").isNull(), "lost").when(F.col("code") != F.col("new_code"), "recoded").when(near, "kept").otherwise("moved")
    both = both.select("doc_id", "change", "field_id", outcome.alias("outcome"), "code", "start", "end", "new_code", "new_start", "new_end")
    return each(written(both, "outcomes"))


def survival_counts(rows: DataFrame) -> DataFrame:
    """change, documents, and the number of each outcome. rows: as of survival(); documents without any finding don't count."""
    return rows.groupBy("change").agg(F.countDistinct("doc_id").alias("documents"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))


def heading_drift(docs: DataFrame, pack: tuple[Field, ...] = STARTER, lexicon: G.Lexicon = G.STARTER_LEXICON) -> DataFrame:
    """doc_id, heading, findings, new_findings, same_profile, stable: documents with a known methods heading, under each other heading.

    docs: doc_id (unique, not null), canonical_text. stable: neither the features nor the number of findings differ.
    """
    text = F.col("canonical_text")
    renamed = lambda new: reduce(lambda rest, old: F.when(F.contains(text, F.lit(old)), perturb.first_replaced(text, old, new)).otherwise(rest), reversed(KNOWN_HEADINGS), text)
    kind = docs.schema["doc_id"].dataType
    docs, each = once_a_text(docs)
    known = docs.where(reduce(lambda a, b: a | b, (F.contains(text, F.lit(h)) for h in KNOWN_HEADINGS)))
    texts = written(_variants(known, {h: renamed(h) for h in OTHER_HEADINGS}), "renamed")
    made = audit.reports(texts.select("doc_id", "canonical_text", "text_sha"), pack, lexicon)
    held = F.array_sort(F.map_keys(F.map_filter("features", lambda k, v: v)))
    made = made.select(F.expr("substring(doc_id, locate(':', doc_id) + 1)").cast(kind).alias("of"), _change_of(list(OTHER_HEADINGS)).alias("heading"), held.alias("held"), F.size("findings").cast("long").alias("n"))
    made = written(made, "drift")
    base = made.where(F.col("heading") == UNCHANGED).select("of", F.col("held").alias("held0"), F.col("n").alias("findings"))
    rows = made.where(F.col("heading") != UNCHANGED).join(base, "of").withColumn("same_profile", F.col("held") == F.col("held0"))
    return each(rows.select(F.col("of").alias("doc_id"), "heading", "findings", F.col("n").alias("new_findings"), "same_profile", (F.col("same_profile") & (F.col("n") == F.col("findings"))).alias("stable")))
