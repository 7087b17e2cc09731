"""Subsections of the methods window, and which of them belongs to a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.headings import CATEGORIES, category_hits, heading_lines, is_title
from lacuna.functions.text import digits_masked, match_spans, strip
from lacuna.operators.structure import even_repeats

#: Lines that can equal a title once digits are masked; others needn't be counted for running headers.
_TITLE_SHAPED = r"(?mdU)^[^\S\n]*[A-Z][A-Za-z0-9 ,\-/]{2,60}[^\S\n]*$"


def subsections(docs: DataFrame, text_col: str = "canonical_text") -> DataFrame:
    """doc_id, sub_idx, header, start, end: bodies between the headings of the methods window.

    docs: doc_id (unique), the text, m_start, m_end. Only heading lines leave the scan, never text. Headings that recur at
    even distances in the document are running headers; headings with nothing between them are one. Documents without a
    heading, and null texts, have no row.
    """
    whole = F.col(text_col)
    window = F.substring(whole, F.col("m_start") + 1, F.col("m_end") - F.col("m_start"))
    rows = docs.select("doc_id", "m_start", "m_end", F.posexplode(heading_lines(window)).alias("idx", "h")).select("doc_id", "m_start", "m_end", "idx", "h.*")
    rows = rows.where(is_title(F.col("line"), F.col("title"))).withColumn("key", digits_masked(F.col("title")))
    spots = docs.select("doc_id", F.explode(match_spans(whole, _TITLE_SHAPED)).alias("l"))
    running = even_repeats(spots.select("doc_id", digits_masked(strip(F.col("l.text"))).alias("key"), F.col("l.start").alias("line_start")))
    rows = rows.join(running.select("doc_id", "key"), ["doc_id", "key"], "anti")
    order = Window.partitionBy("doc_id").orderBy("idx")
    opens = ~(F.col("joined") & F.coalesce(F.lag("idx").over(order) == F.col("idx") - 1, F.lit(False)))
    rows = rows.withColumn("island", F.sum(opens.cast("int")).over(order) - 1)
    titles = F.array_sort(F.collect_list(F.struct("idx", "title")))
    merged = rows.groupBy("doc_id", "island").agg(F.array_join(F.transform(titles, lambda x: x["title"]), " ").alias("header"), F.min("start").alias("opens"), F.max("end").alias("body"), F.first("m_start").alias("m_start"), F.first("m_end").alias("m_end"))
    follows = F.lead("opens").over(Window.partitionBy("doc_id").orderBy("island"))
    return merged.select("doc_id", F.col("island").cast("int").alias("sub_idx"), "header", (F.col("m_start") + F.col("body")).alias("start"), F.coalesce(F.col("m_start") + follows, F.col("m_end")).alias("end"))


def node_of(subs: Column, category: str) -> Column:
    """struct<sub_idx, title, how> of the subsection where a category's fields should stand; a null sub_idx: none.

    subs: array<struct<sub_idx, header, ..>>. The only one; else the one with most of the category's words, the first on ties.
    """
    ranked = F.array_sort(F.filter(F.transform(subs, lambda s: F.struct((-category_hits(s["header"], category)).alias("n"), s["sub_idx"].alias("i"), s["header"].alias("t"))), lambda x: x["n"] < 0)) if category in CATEGORIES else F.array().cast("array<struct<n:int,i:int,t:string>>")
    node = lambda i, t, how: F.struct(i.alias("sub_idx"), t.alias("title"), how.alias("how"))
    none = lambda how: node(F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(how))
    pick = lambda r: F.when(F.size(r) == 0, none("node:det-none")).when(F.size(r) == 1, node(r[0]["i"], r[0]["t"], F.lit("node:det-unique"))).otherwise(node(r[0]["i"], r[0]["t"], F.concat(F.lit("node:det-first-of-"), F.size(r).cast("string"))))
    chosen = F.transform(F.array(ranked), pick)[0]
    return F.when(F.size(subs) == 0, none("node:no-subsections")).when(F.size(subs) == 1, node(subs[0]["sub_idx"], subs[0]["header"], F.lit("node:only-one"))).otherwise(chosen)


def listed(docs: DataFrame, subs: DataFrame, text_col: str = "canonical_text") -> DataFrame:
    """doc_id, titles, bodies of each document, in document order; empty arrays without subsections. docs: doc_id (unique), the text; subs: as of subsections()."""
    rows = subs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sub_idx", "header", "start", "end"))).alias("subs"))
    found = docs.select("doc_id", F.col(text_col).alias("t")).join(rows, "doc_id", "left")
    body = lambda s: F.substring("t", s["start"] + 1, s["end"] - s["start"])
    none = F.array().cast("array<string>")
    return found.select("doc_id", F.coalesce(F.transform("subs", lambda s: s["header"]), none).alias("titles"), F.coalesce(F.transform("subs", body), none).alias("bodies"))


def tree(docs: DataFrame, subs: DataFrame, text_col: str = "canonical_text") -> DataFrame:
    """doc_id, node_id, parent_id, title, start, end: the document (0), its methods window (0.0) and the subsections (0.0.i).

    docs: doc_id (unique), the text, m_start, m_end. The way up from a node is its id without the last parts.
    """
    node = lambda name, parent, title, a, b: F.struct(F.lit(name).alias("node_id"), F.lit(parent).cast("string").alias("parent_id"), F.lit(title).alias("title"), a.alias("start"), b.alias("end"))
    top = docs.where(F.col(text_col).isNotNull()).select("doc_id", F.explode(F.array(node("0", None, "document", F.lit(0), F.length(text_col)), node("0.0", "0", "methods", F.col("m_start"), F.col("m_end")))).alias("x")).select("doc_id", "x.*")
    return top.unionByName(subs.select("doc_id", F.concat(F.lit("0.0."), F.col("sub_idx").cast("string")).alias("node_id"), F.lit("0.0").alias("parent_id"), F.col("header").alias("title"), "start", "end"))
