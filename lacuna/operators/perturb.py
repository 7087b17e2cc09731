"""Texts changed in ways that must not change what is found: other headings, page furniture, vocabulary, glyphs, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.text import squeezed

# The heading that is replaced, and what by.
HEADING = "EXPERIMENTAL PROCEDURES"
HEADINGS = ("Patients and Methods", "Online Methods", "Materials & Methods", "METHODS AND MATERIALS", "2. Experimental Section", "Methodology")
FURNITURE = "unseen running header injected"
# Replacements, in order, by name.
SWAPS = {
    "qPCR vocabulary swapped": (("qPCR", "RT-qPCR"),),
    "IHC vocabulary swapped": (("Immunohistochemistry", "Immunolabelling"), ("immunohistochemistry", "immunolabelling")),
    "degree sign -> U+25E6": (("°", "◦"),),
    "multiplication -> glyph name": (("×", "/H11003"),),
    "ligatures introduced": (("fi", "ﬁ"), ("fl", "ﬂ")),
}


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def first_replaced(text: Column, old: str, new: str) -> Column:
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(new), F.substring(text, at + len(old), F.length(text)))).otherwise(text)


def _step(lines: Column) -> Column:
    """Lines from one piece of page furniture to the next."""
    return F.greatest(F.lit(1), F.floor(F.size(lines) / 12).cast("int"))


def _with_furniture(text: Column) -> Column:
    """Two lines of page furniture after each twelfth of the lines."""
    lines = F.split(text, "\n", -1)
    step = _step(lines)
    page = lambda i: F.concat(F.lit("\nNature Protocols "), (F.floor(i / step) + 12).cast("string"), F.lit("(4):210-2"), (i % 10).cast("string"), F.lit("0\nDownloaded from nature.com on 2026-01-01"))
    return F.array_join(F.transform(lines, lambda line, i: F.when((i > 0) & (i % step == 0), F.concat(line, page(i))).otherwise(line)), "\n")


def changes(text: Column) -> dict[str, Column]:
    """name -> the changed text."""
    out = {f"heading -> '{h}'": first_replaced(text, HEADING, h) for h in HEADINGS}
    out[FURNITURE] = _with_furniture(text)
    out |= {name: _replaced(text, pairs) for name, pairs in SWAPS.items()}
    out["all hard-wraps removed"] = F.regexp_replace(text, r"(?<![.\n])\n(?![A-Z\n])", " ")
    out["double-spaced"] = F.replace(text, F.lit("\n"), F.lit("\n\n"))
    return out


def carried(text: Column, at: Column) -> dict[str, Column]:
    """name -> where a place of a canonical text stands in the canonical text of its change.

    What a change does to a text's beginning doesn't depend on what follows, so a place moves to the end of its changed
    beginning; a place inside a replaced string keeps its distance from that string's start. Page furniture goes by the
    number of lines before the place, and has 12 to 34 as its two-digit number, so that all pieces are equally long.
    """
    begun = F.substring(text, F.lit(1), at.cast("int"))
    out = {name: F.length(squeezed(changed)) for name, changed in changes(begun).items()}
    newlines = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    pieces = F.floor(F.greatest(newlines(begun) - 1, F.lit(0)) / _step(F.split(text, "\n", -1)))
    out[FURNITURE] = at + pieces * len("\nNature Protocols 12(4):210-200\nDownloaded from nature.com on 2026-01-01")
    return {name: place.cast("long") for name, place in out.items()}


def perturbed(docs: DataFrame, text_col: str = "text", anchor_col: str | None = None) -> DataFrame:
    """doc_id, name, text of every change of every document; with anchor_col also anchor, the passage as the change leaves it."""
    anchor = lambda name: _replaced(F.col(anchor_col), SWAPS.get(name, ()))
    rows = F.array(*(F.struct(F.lit(n).alias("name"), c.alias("text"), *([anchor(n).alias("anchor")] if anchor_col else [])) for n, c in changes(F.col(text_col)).items()))
    return docs.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*")
