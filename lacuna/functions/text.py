"""Canonical text, pattern spans, sentences and identities as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeezed(text: Column) -> Column:
    """Line ends to newline, runs of blanks to one space, none before a newline, at most one empty line."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t ]+", " ")
    out = F.regexp_replace(out, " +\n", "\n")
    return F.regexp_replace(out, "\n{3,}", "\n\n")


def tidy(text: Column) -> Column:
    """squeezed, and stripped."""
    return strip(squeezed(text))


#: Ranges in a block of the class of code points that NFC concerns.
RANGES = 20


@lru_cache
def unsettled_class() -> str:
    """A pattern of one code point that NFC may change or join with others: from Unicode's data, not only what lies beyond Latin."""
    loose = lambda c: unicodedata.combining(c) or not unicodedata.is_normalized("NFC", c) or unicodedata.category(c)[0] == "M" or 0x1160 <= ord(c) <= 0x11FF
    points = [p for p in range(0x300, 0x110000) if not 0xD800 <= p <= 0xDFFF and loose(chr(p))]
    ranges: list[list[int]] = []
    for p in points:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    # a class tries its ranges one by one, so they stand in blocks whose bounds are asked first: a Latin letter costs one test
    span = lambda low, high: rf"\x{{{low:x}}}-\x{{{high:x}}}"
    blocks = [ranges[i : i + RANGES] for i in range(0, len(ranges), RANGES)]
    parts = "".join(f"[{span(b[0][0], b[-1][1])}&&[{''.join(span(*r) for r in b)}]]" for b in blocks)
    return f"[{span(points[0], points[-1])}&&[{parts}]]"


def to_nfc(df: DataFrame, column: str) -> DataFrame:
    """df with the column in NFC, in one scan. Texts without a code point that NFC concerns stay in the JVM; Python gets a null for them."""

    @F.pandas_udf("string")
    def compose(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.str.normalize("NFC") if part.notna().any() else part

    text = F.col(column)
    return df.withColumn(column, F.coalesce(compose(F.when(text.rlike(unsettled_class()), text)), text))


def canonicalize(df: DataFrame, column: str = "text") -> DataFrame:
    """df with canonical_text and text_sha; a null text stays null."""
    out = to_nfc(df.withColumn("canonical_text", F.col(column)), "canonical_text").withColumn("canonical_text", tidy(F.col("canonical_text")))
    return out.withColumn("text_sha", F.sha2(F.col("canonical_text").cast("binary"), 256))


#: Elements summed at a time: the cost of a running sum grows with this times their number, not with its square.
BLOCK = 256


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sums_before(sizes: Column) -> Column:
    """For each element of an array of ints, the sum of those before it."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    run = lambda part: F.aggregate(part, begin, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda i: run(F.slice(v, i * BLOCK + 1, F.lit(BLOCK))))
    shifted = lambda parts: F.flatten(F.zip_with(parts, run(F.transform(parts, lambda p: p["at"]))["out"], lambda p, base: F.transform(p["out"], lambda n: n + base)))
    return bind(sizes, lambda v: F.when(F.size(v) <= BLOCK, run(v)["out"]).otherwise(bind(blocks(v), shifted)))


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of all matches, in code points; the pattern must not match the empty string."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), F.length(m).alias("n")))
    before = lambda v: sums_before(F.transform(v, lambda p: p["g"] + p["n"]))
    span = lambda p, at: F.struct((at + p["g"]).alias("start"), (at + p["g"] + p["n"]).alias("end"), p["m"].alias("text"))
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return F.when(text.rlike(pattern), bind(pairs, lambda v: F.zip_with(v, before(v), span))).otherwise(none)


#: Where sentences part (fixed value): white space after an end mark, before a capital or a bracket.
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+(?=[A-Z(])"


def sentences(df: DataFrame, column: str = "canonical_text", base: Column | None = None) -> DataFrame:
    """A row for each sentence: df's columns and sent_idx, sentence, sent_start, sent_end (offset by base)."""
    text, base = F.col(column), F.lit(0) if base is None else base
    pieces = F.split(text, SENTENCE_BREAK, -1)
    breaks = F.concat(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE_BREAK), F.lit(0)), lambda s: F.length(s)), F.array(F.lit(0)))
    starts = sums_before(F.zip_with(pieces, breaks, lambda p, b: F.length(p) + b))
    rows = df.select(*df.columns, F.posexplode(F.arrays_zip(pieces.alias("p"), starts.alias("s"))).alias("sent_idx", "x"))
    return rows.select(*df.columns, "sent_idx", F.col("x.p").alias("sentence"), (base + F.col("x.s")).alias("sent_start"), (base + F.col("x.s") + F.length("x.p")).alias("sent_end"))


def finding_id(doc_id: Column, text_sha: Column, start: Column, end: Column, field_id: Column, code: Column) -> Column:
    """First 32 hex digits of the hash of the parts, joined by U+001F (fixed format)."""
    parts = [c.cast("string") for c in (doc_id, text_sha, start, end, field_id, code)]
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256), 1, 32)


def digits_masked(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)\d+", "#")


def substantive(text: Column) -> Column:
    return (F.length(text) >= 10) & text.rlike("[A-Za-z]{3,}")
