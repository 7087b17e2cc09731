"""Applicability, keyword ranking and absence anchors: documents against a broadcast checklist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.text import sentences, strip, substantive
from lacuna.plans.pack import STARTER, Field


def applicable(profiles: DataFrame, fields: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, field_ordinal, field_id and the columns of keep, where all features of all_of hold and, if any_of isn't empty, one of it.

    profiles: doc_id, features (map<string, boolean>; a missing key is false). The checklist is a few dozen rows.
    """
    has = lambda x: F.coalesce(F.try_element_at("features", x), F.lit(False))
    gate = F.forall("all_of", has) & ((F.size("any_of") == 0) | F.exists("any_of", has))
    return profiles.crossJoin(F.broadcast(fields)).where(gate).select("doc_id", "field_ordinal", "field_id", *keep)


def holds_keyword(low: Column, pack: tuple[Field, ...]) -> Column:
    """Whether a sentence, in lower case, holds a keyword of any field: of words within others only the shortest are asked for."""
    words = {k for f in pack for k, _ in f.keywords()}
    least = sorted(w for w in words if not any(o in w for o in words - {w}))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in least), F.lit(False))


def keyword_score(low: Column, f: Field) -> Column:
    return reduce(lambda a, b: a + b, (F.when(F.contains(low, F.lit(k)), F.lit(w)).otherwise(F.lit(0)) for k, w in f.keywords()))


def ranked_candidates(docs: DataFrame, pack: tuple[Field, ...] = STARTER, text_col: str = "canonical_text") -> DataFrame:
    """doc_id, field_id, score, sent_idx, sent_start, sent_end, rank: sentences by keyword score, ties in document order.

    All fields of a sentence are scored in one projection, so the text is split once and never joined. Sentences without
    a keyword are dropped, and those without a digit where the field is a quantity.
    """
    rows = sentences(docs.select("doc_id", F.col(text_col).alias("canonical_text")))
    # columns of their own, as expressions within an array are computed anew at each use
    rows = rows.withColumns({"low": F.lower("sentence"), "digit": F.col("sentence").rlike(r"(?U)\d")})

    def scored(f: Field):
        score = keyword_score(F.col("low"), f)
        return F.when(F.col("digit"), score).otherwise(0) if f.type == "quantity" else score

    rows = rows.withColumn("scores", F.when(holds_keyword(F.col("low"), pack), F.array(*map(scored, pack))))
    hits = F.filter(F.transform("scores", lambda s, i: F.struct((i + 1).alias("field"), s.alias("score"))), lambda x: x["score"] > 0)
    name = F.element_at(F.array(*(F.lit(f.field_id) for f in pack)), F.col("x.field"))
    flat = rows.select("doc_id", "sent_idx", "sent_start", "sent_end", F.explode(hits).alias("x")).select("doc_id", name.alias("field_id"), "x.score", "sent_idx", "sent_start", "sent_end")
    order = Window.partitionBy("doc_id", "field_id").orderBy(F.desc("score"), "sent_idx")
    return flat.withColumn("rank", F.row_number().over(order))


def absence_anchors(docs: DataFrame, pack: tuple[Field, ...], text_col: str = "canonical_text") -> DataFrame:
    """doc_id, field_id, detector, anchor_start, anchor_end: where a reader should look for what is missing.

    At document level: the earliest sentence of the best keyword score, digits or not; else the first substantive one.
    A document without either has no anchor. One aggregation a document; nothing is joined.
    """
    rows = sentences(docs.select("doc_id", F.col(text_col).alias("canonical_text")))
    rows = rows.withColumns({"low": F.lower("sentence"), "body": strip(F.col("sentence")), "lead": F.length(F.regexp_extract("sentence", r"(?U)^\s*", 0))}).where(F.length("body") > 0)
    start = F.col("sent_start") + F.col("lead")
    # two ints in a long: rows of numbers are aggregated by hash, without a sort of all sentences
    paired = lambda high, low: F.shiftleft(high.cast("long"), 32) + low
    keyed = holds_keyword(F.col("low"), pack)
    scores = F.when(keyed, F.array(*(keyword_score(F.col("low"), f) for f in pack)))
    rows = rows.select("doc_id", "sent_idx", paired(start, start + F.length("body")).alias("span"), substantive(F.col("body")).alias("good"), scores.alias("scores"))
    best = [F.min_by("span", F.when(F.col("scores")[i] > 0, paired(-F.col("scores")[i], F.col("sent_idx")))).alias(f"k{i}") for i in range(len(pack))]
    found = rows.groupBy("doc_id").agg(F.min_by("span", F.when(F.col("good"), F.col("sent_idx"))).alias("first"), *best)
    place = lambda at: F.when(at.isNotNull(), F.struct(F.shiftright(at, 32).cast("int").alias("start"), at.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("end")))
    options = F.array(*(F.struct(F.lit(f.field_id).alias("field_id"), F.when(F.col(f"k{i}").isNotNull(), F.lit("anchor:document:keyword")).otherwise(F.lit("anchor:document:head")).alias("detector"), place(F.coalesce(F.col(f"k{i}"), F.col("first"))).alias("span")) for i, f in enumerate(pack)))
    flat = found.select("doc_id", F.explode(options).alias("x")).where("x.span is not null")
    return flat.select("doc_id", "x.field_id", "x.detector", F.col("x.span.start").alias("anchor_start"), F.col("x.span.end").alias("anchor_end"))
