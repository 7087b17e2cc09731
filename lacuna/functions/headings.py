"""Headings as Column expressions: the methods window, heading lines, what isn't a heading, and categories of headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.text import match_spans, strip

# Headings that open the window, in order of precedence, those that close it, and its least width.
OPENING = ("experimental procedures?", "materials and methods", "methods and materials", "methods", r"(?:[A-Za-z&][A-Za-z& ]{0,44})?\b(?:methods?|methodology|experimental[ \t]+(?:procedures?|section))\b")
CLOSING = ("results and discussion", "results", "discussion", "references", "bibliography", "acknowledge?ments?", "conflicts? of interest", "author contributions?", "data availability", "supplementary (?:material|information|data)")
LEAST_WIDTH = 400
#: Fixed value: a heading line of its own; group 1 is the title without its number.
HEADING_LINE = r"(?mdU)^(?:\d+(?:\.\d+)*\.?\s+)?([A-Z][A-Za-z0-9 ,\-/]{2,60})$"
# Page furniture (whole line), then titles that are abbreviations, page numbers, clauses or subordinate clauses.
FURNITURE = r"(?U)^\S+\s+\d{4},?\s+\d+,?\s+\d+\s+\d+\s+of\s+\d+$"
NOT_TITLES = (
    r"(?U)^[A-Z]{2,6}\s+[A-Z][a-z]",
    r"(?U)\d{3,}$",
    r"(?iU)\b(?:was|were|is|are|am|be|been|being|has|have|had|do|does|did|will|would|shall|should|can|could|may|might|must)\b",
    r"(?iU)^(?:after|before|when|while|whereas|although|though|because|since|if|unless|thus|hence|therefore|however|moreover|furthermore|then|next|finally|briefly)\b",
)
# Words in headings that belong to a category, the first part of a field's id; they match from a word's start.
CATEGORIES = {
    "animal": ("animal", "mice", "mouse", "rat", "subjects", "in vivo"),
    "cellline": ("cell culture", "cell line", "cells", "cell establishment", "transfect"),
    "culture": ("cell culture", "culture"),
    "treatment": ("treatment", "pharmacologic", "drug", "reagent"),
    "qpcr": ("pcr", "qpcr", "rna", "gene expression"),
    "stats": ("statistic", "analysis"),
    "centrifugation": ("centrifug", "fractionation", "extraction", "lysis", "lysate", "immunoprecipitat", "homogen", "subcellular"),
    "antibody": ("antibod", "western", "immunohistochemistry", "staining"),
    "assay": ("assay", "protocol"),
    "xenograft": ("xenograft", "tumor-bearing", "tumour-bearing", "tumor model", "tumour model", "mouse model", "animal model", "in vivo", "implant"),
}


def alone(words: str) -> str:
    """The words as a line of their own, numbered or not, with a colon or without."""
    return rf"(?imdU)^[ \t]*(?:\d+(?:\.\d+)*\.?[ \t]*)?(?:{words})[ \t]*:?[ \t]*$"


def with_methods(df: DataFrame, text_col: str = "canonical_text") -> DataFrame:
    """df with m_start, m_end: the first wide enough window of the first opening heading that has one; else the whole text."""
    text = F.col(text_col)
    marked = df.withColumn("_stops", F.transform(match_spans(text, alone("|".join(CLOSING))), lambda x: x["start"]))

    def windows(words: str) -> Column:
        end = lambda s: F.coalesce(F.array_min(F.filter("_stops", lambda e: e > s)), F.length(text))
        return F.transform(match_spans(text, alone(words)), lambda x: F.struct(x["start"].alias("start"), end(x["start"]).alias("end")))

    wide = F.filter(F.concat(*map(windows, OPENING)), lambda w: w["end"] - w["start"] >= LEAST_WIDTH)
    marked = marked.withColumn("_window", F.try_element_at(wide, F.lit(1))).drop("_stops")
    return marked.withColumn("m_start", F.coalesce("_window.start", F.lit(0))).withColumn("m_end", F.coalesce("_window.end", F.length(text), F.lit(0))).drop("_window")


def heading_lines(text: Column) -> Column:
    """array<struct<start, end, line, title, joined>> of heading lines; joined: nothing but white space since the heading before."""
    gaps = F.transform(F.split(text, HEADING_LINE, -1), lambda g: F.length(strip(g)) == 0)
    found = F.arrays_zip(match_spans(text, HEADING_LINE).alias("s"), F.regexp_extract_all(text, F.lit(HEADING_LINE), F.lit(1)).alias("t"), gaps.alias("g"))
    kept = F.transform(found, lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["end"].alias("end"), strip(x["s"]["text"]).alias("line"), strip(x["t"]).alias("title"), x["g"].alias("joined")))
    return F.filter(kept, lambda x: x["start"].isNotNull())


def is_title(line: Column, title: Column) -> Column:
    out = ~line.rlike(FURNITURE)
    for pattern in NOT_TITLES:
        out = out & ~title.rlike(pattern)
    return out


def category_hits(title: Column, category: str) -> Column:
    """How many of the category's words the title holds; 0 for an unknown category."""
    return sum((title.rlike(rf"(?iU)\b\Q{w}\E").cast("int") for w in CATEGORIES.get(category, ())), F.lit(0))


def first_place(text: Column, pattern: str | Column) -> Column:
    """struct<start, end> of the first match, in code points; null if there is none."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    start = F.length(F.split(text, pattern, 2)[0])
    return F.when(F.rlike(text, pattern), F.struct(start.alias("start"), (start + F.length(F.regexp_substr(text, pattern))).alias("end")))
