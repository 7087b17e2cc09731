"""Wording that takes a value's place without giving it: triggers, the clauses they govern, and the verdict they lead to."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions import verdicts as V
from lacuna.functions.headings import CATEGORIES, first_place
from lacuna.functions.text import bind, match_spans
from lacuna.plans.pack import Field

ANY = ("*",)
# What vague terms stand in for, dimensions or types; first by the term, else by the list it stands in.
TERM_FILLS = {
    "high speed": ("relative_centrifugal_force",),
    "low speed": ("relative_centrifugal_force",),
    "maximum speed": ("relative_centrifugal_force",),
    "full speed": ("relative_centrifugal_force",),
    "briefly": ("time", "time_or_mass"),
    "quickly": ("time", "time_or_mass"),
    "rapidly": ("time", "time_or_mass"),
    "room temperature": ("temperature",),
    "on ice": ("temperature",),
    "gently": ("agitation",),
    "thoroughly": ("agitation",),
    "overnight": ("time", "time_or_mass"),
    "until confluent": ("time", "time_or_mass", "count"),
    "to confluence": ("time", "time_or_mass", "count"),
    "log phase": ("time", "time_or_mass", "count"),
    "logarithmic growth": ("time", "time_or_mass", "count"),
    "exponential phase": ("time", "time_or_mass", "count"),
    "until endpoint": ("time", "volume"),
    "until the desired": ("time", "volume"),
    "when tumours became palpable": ("time", "volume"),
}
LIST_FILLS = {"qualitative_quantity": ANY, "relative_condition": ("time", "time_or_mass", "count", "volume")}
# The starter lexicon's two lists.
QUALITATIVE = ("high speed", "low speed", "maximum speed", "full speed", "briefly", "quickly", "rapidly", "gently", "thoroughly", "as needed", "appropriate", "standard conditions", "routine conditions", "room temperature", "on ice")
RELATIVE = ("overnight", "until confluent", "to confluence", "log phase", "logarithmic growth", "exponential phase", "until the desired", "when tumours became palpable", "until endpoint")
# Deferrals to another text, which can stand for these types, and to a display, which can stand for anything.
TO_REFERENCE = (
    r"as\s+(?:previously\s+)?described",
    r"as\s+described\s+(?:previously|elsewhere|earlier)",
    r"according to (?:the )?manufacturer",
    r"per manufacturer'?s? (?:instructions|protocol)",
    r"manufacturer'?s? (?:instructions|protocol|recommendations)",
    r"as in (?:ref\.?|reference) ?\d+",
    r"following (?:the )?standard protocol",
    r"(?:reported|published|detailed)\s+(?:previously|elsewhere)",
)
REFERENCE_FILLS = ("text", "identifier", "sequence", "boolean", "enum")
TO_DISPLAY = (
    r"(?:the\s+)?indicated (?:times?|concentrations?|doses?|conditions?|amounts?)",
    r"\bas indicated\b",
    r"(?:see|shown in|displayed in|listed in|provided in|given in)\s+(?:Fig|Figure|Table|Suppl|Supplementary|Supporting)",
)
#: Fixed value: what ends a clause.
CLAUSE_END = r"(?iU)[;:,]|\b(?:and|or|but|then|whereas|while|however|although|which|followed by|prior to|before|after)\b"


def _terms(terms) -> str:
    return r"(?iU)\b(?:" + "|".join(rf"\Q{t}\E" for t in sorted(terms, key=len, reverse=True)) + r")\b"


_CODES = {"qualitative_quantity": "GAP_VAGUE", "relative_condition": "GAP_VAGUE", "deferred_reference": "GAP_DEFERRED_TO_REF", "deferred_display": "GAP_DEFERRED_TO_DISPLAY"}


@dataclass(frozen=True)
class Lexicon:
    """The two lists of vague terms; an empty list matches nothing."""

    qualitative_quantity: tuple[str, ...] = QUALITATIVE
    relative_condition: tuple[str, ...] = RELATIVE

    def fills(self, family: str) -> dict[str, tuple[str, ...]]:
        """term, in lower case -> what it stands in for."""
        return {t.lower(): TERM_FILLS.get(t.lower(), LIST_FILLS[family]) for t in getattr(self, family, ())}

    @property
    def patterns(self) -> dict[str, str]:
        lists = {family: _terms(terms) if (terms := getattr(self, family)) else "(?!)" for family in LIST_FILLS}
        return lists | {"deferred_reference": "(?iU)" + "|".join(TO_REFERENCE), "deferred_display": "(?iU)" + "|".join(TO_DISPLAY)}


STARTER_LEXICON = Lexicon()


def _fillable(family: str, f: Field, lexicon: Lexicon) -> list[str] | None:
    """The family's terms that can stand for the field; None: whatever the family matches."""
    slot = {f.dimension, f.type}
    if family == "deferred_display" or (family == "deferred_reference" and slot & set(REFERENCE_FILLS)):
        return None
    return [] if family not in LIST_FILLS else [t for t, fills in lexicon.fills(family).items() if fills == ANY or slot & set(fills)]


def trigger_spans(text: Column, lexicon: Lexicon = STARTER_LEXICON) -> Column:
    """struct of array<struct<start, end, text>>, one for each family of triggers, and breaks, the ends of clauses. The same for every field."""
    some = text.rlike("|".join(f"(?:{p})" for p in lexicon.patterns.values()))
    found = F.struct(*(match_spans(text, p).alias(family) for family, p in lexicon.patterns.items()), match_spans(text, CLAUSE_END).alias("breaks"))
    return F.when(some, found)


def triggers(spans: Column, f: Field, lexicon: Lexicon = STARTER_LEXICON) -> Column:
    """array<struct<start, end, text, family>> of the triggers that can stand for the field, by place; spans: as of trigger_spans."""

    def of(family: str) -> Column | None:
        terms = _fillable(family, f, lexicon)
        if terms == []:
            return None
        found = spans[family] if terms is None else F.filter(spans[family], lambda x: F.lower(x["text"]).isin(terms))
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.lit(family).alias("family")))

    return F.array_sort(F.concat(*(c for c in map(of, _CODES) if c is not None)))


def vague_terms(text: Column, lexicon: Lexicon = STARTER_LEXICON) -> Column:
    """array<string> of the text's vague terms, in lower case. The same for every field."""
    lists = [lexicon.patterns[family] for family in LIST_FILLS]
    found = F.transform(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in lists)), F.lower)
    return F.when(text.rlike("|".join(f"(?:{p})" for p in lists)), found).otherwise(F.array().cast("array<string>"))


def names_slot(terms: Column, f: Field, lexicon: Lexicon = STARTER_LEXICON) -> Column:
    """Whether one of the vague terms stands for the field's own slot, not for any."""
    own = [t for family in LIST_FILLS for t, fills in lexicon.fills(family).items() if fills != ANY and {f.dimension, f.type} & set(fills)]
    return F.arrays_overlap(terms, F.array(*map(F.lit, own))) if own else F.lit(False)


def clause(breaks: Column, length: Column, at: Column) -> Column:
    """struct<low, high>: the clause around a place; breaks: the spans of the clause ends, in order."""
    low = F.coalesce(F.array_max(F.transform(F.filter(breaks, lambda b: b["end"] <= at), lambda b: b["end"])), F.lit(0))
    high = F.coalesce(F.array_min(F.transform(F.filter(breaks, lambda b: b["start"] > at), lambda b: b["start"])), length)
    return F.struct(low.alias("low"), high.alias("high"))


def target_patterns(f: Field) -> list[str]:
    """Patterns of where a text speaks of the field: a value of its dimension, else a word of its category, else a part of its id."""
    out = []
    if f.dimension in V.STATED:
        ways = "|".join(f"{before}{n}{after}" for before, n, after in V.STATED[f.dimension])
        extra = V._UNIT_ONLY.get(f.dimension)
        out.append(V._flags(f.dimension) + (f"{ways}|{extra}" if extra else ways))
    words = CATEGORIES.get(f.field_id.split(".")[0])
    if words:
        out.append(r"(?iU)\b(?:" + "|".join(rf"\Q{w}\E" for w in sorted(words, key=len, reverse=True)) + ")")
    return out + [rf"(?iU)\b\Q{part}\E" for part in re.split("[._]", f.field_id) if len(part) >= 4]


def target(text: Column, f: Field) -> Column:
    """The place of the first of the field's target patterns that the text has; null if none."""
    return F.coalesce(*(first_place(text, p)["start"] for p in target_patterns(f)), F.lit(None).cast("int"))


def trigger_verdict(text: Column, f: Field, lexicon: Lexicon = STARTER_LEXICON, spans: Column | None = None) -> Column:
    """struct<code, low, high, text, family> of the trigger that governs the field's clause, with the clause; null if none does.

    Without a target in the text any trigger governs; out of the target's clause only if one of them is a deferral. spans:
    a column of trigger_spans, for use with many fields.
    """
    spans = trigger_spans(text, lexicon) if spans is None else spans
    return governing(text, spans, F.struct(triggers(spans, f, lexicon).alias("t"), target(text, f).alias("at")))


def governing(text: Column, spans: Column, found: Column) -> Column:
    """As trigger_verdict; found: struct<t: triggers that can stand for the field, at: the place of its target>."""
    none = F.lit(None).cast("struct<code:string,low:int,high:int,text:string,family:string>")

    def choose(z: Column) -> Column:
        around = F.transform(z["t"], lambda t: F.struct(t.alias("t"), clause(spans["breaks"], F.length(text), t["start"]).alias("c")))
        inside = F.filter(around, lambda x: z["at"].isNull() | ((x["c"]["low"] <= z["at"]) & (z["at"] < x["c"]["high"])))
        deferred = F.exists(z["t"], lambda t: t["family"].startswith("deferred"))
        return bind(F.try_element_at(F.when((F.size(inside) == 0) & deferred, around).otherwise(inside), F.lit(1)), lambda x: F.when(x.isNotNull(), F.struct(F.element_at(codes, x["t"]["family"]).alias("code"), x["c"]["low"].alias("low"), x["c"]["high"].alias("high"), x["t"]["text"].alias("text"), x["t"]["family"].alias("family"))))

    codes = F.create_map(*(F.lit(x) for pair in _CODES.items() for x in pair))
    return F.when(spans.isNotNull(), bind(found, choose)).otherwise(none)
