"""Labels: their documents, the places of their quoted passages, how many could be placed, and scores of report sets against label sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators import score
from lacuna.operators.anchors import resolve_anchor


def with_alias(labels: DataFrame, aliases: dict[str, str], id_col: str = "doc_id") -> DataFrame:
    """labels with the documents' names in place of their own; names that aren't in aliases stay."""
    if not aliases:
        return labels
    names = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return labels.withColumn(id_col, F.coalesce(F.try_element_at(names, F.col(id_col)), F.col(id_col)))


def resolve_labels(labels: DataFrame, docs: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """One row a label: its columns, outcome (resolved, unresolved, no_anchor, no_document), start, end, text_sha.

    labels: doc_id, field_id, anchor_text ..; docs: doc_id (unique), canonical_text, text_sha. Each label is looked for in
    its own document only.
    """
    named = with_alias(labels, aliases or {}).drop("start", "end", "text_sha")
    found = named.join(docs.select("doc_id", "canonical_text", "text_sha"), "doc_id", "left")
    span = resolve_anchor(F.col("canonical_text"), F.col("anchor_text"))
    blank = ~F.coalesce(F.col("anchor_text").rlike(r"(?U)\S"), F.lit(False))
    found = found.withColumn("span", F.when(blank, None).otherwise(span))
    outcome = F.when(F.col("text_sha").isNull(), "no_document").when(blank, "no_anchor").when(F.col("span").isNull(), "unresolved").otherwise("resolved")
    return found.select(*named.columns, outcome.alias("outcome"), F.col("span.start").alias("start"), F.col("span.end").alias("end"), F.when(F.col("span").isNotNull(), F.col("text_sha")).alias("text_sha"))


def coverage(resolved: DataFrame) -> DataFrame:
    """One row: total (labels whose document exists), resolved, unresolved, no_anchor, no_document, blocking (of the resolved), has_blocking (whether any label says)."""
    is_ = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    flag = F.col("blocking")
    return resolved.agg(F.count_if(F.col("outcome") != "no_document").alias("total"), *map(is_, ("resolved", "unresolved", "no_anchor", "no_document")), F.count_if(F.coalesce(flag, F.lit(False)) & (F.col("outcome") == "resolved")).alias("blocking"), F.coalesce(F.bool_or(flag.isNotNull()), F.lit(False)).alias("has_blocking"))


def label_mix(labels: DataFrame) -> DataFrame:
    """code, n: how often each code is given."""
    return labels.groupBy("code").agg(F.count("*").alias("n"))


def unknown_fields(found: DataFrame, fields: DataFrame) -> DataFrame:
    """The findings' fields that the checklist doesn't have, each once."""
    return found.select("field_id").distinct().join(fields.select("field_id"), "field_id", "anti")


def unreported(gold: DataFrame, reports: DataFrame) -> DataFrame:
    """doc_id, missing of each labelled document: whether it has no report. Such a document counts as one without findings."""
    have = reports.select("doc_id").distinct().withColumn("there", F.lit(True))
    return gold.select("doc_id").distinct().join(have, "doc_id", "left").select("doc_id", F.col("there").isNull().alias("missing"))


def panels(predictions: dict[str, DataFrame], references: dict[str, DataFrame]) -> DataFrame:
    """Every report set against every label set: predictions, reference, bucket, counts and rates. The sets are a handful; the loop is over their names."""
    parts = [score.rates(score.count_outcomes(score.match_greedy(p, g))).select(F.lit(a).alias("predictions"), F.lit(b).alias("reference"), "*") for b, g in references.items() for a, p in predictions.items()]
    return reduce(DataFrame.unionByName, parts)
