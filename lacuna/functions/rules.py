"""A checklist's fields as rows of rules, so that one expression judges any field: its size doesn't grow with the checklist.

A row of rules holds what verdicts and triggers ask of a field: its type, dimension and plausible range, the patterns of its
evidence, values and targets, and the vague terms that can stand for it. verdict_by and trigger_by equal verdict and
trigger_verdict of each field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import triggers as G
from lacuna.functions import verdicts as V
from lacuna.functions.headings import first_place
from lacuna.plans.pack import Field

RULE = "struct<type:string,dimension:string,category:string,low:double,high:double,shift:double,evidence:array<string>,values:array<struct<value:string,patterns:array<string>>>,targets:array<string>,fills:map<string,array<string>>>"
#: Stands for whatever the family matches.
ANY = "*"


def rule(f: Field, lexicon: G.Lexicon) -> tuple:
    fills = {family: [ANY] if (terms := G._fillable(family, f, lexicon)) is None else terms for family in G._CODES}
    shift = V.TO_UNIT.get((f.dimension, f.canonical_unit)) if f.low is not None else None
    return (f.type, f.dimension, f.field_id.split(".")[0], f.low, f.high, shift, V.evidence_patterns(f.field_id), V.value_patterns(f.enum_values), G.target_patterns(f), {k: v for k, v in fills.items() if v})


def rule_frame(spark: SparkSession, pack: tuple[Field, ...], lexicon: G.Lexicon = G.STARTER_LEXICON) -> DataFrame:
    """field_id, rule: a row for each field of the checklist."""
    return spark.createDataFrame([(f.field_id, rule(f, lexicon)) for f in pack], f"field_id string, rule {RULE}")


def _by_dimension(rule: Column, pack: tuple[Field, ...], make, otherwise: Column) -> Column:
    out = None
    for d in sorted({f.dimension for f in pack if f.type == "quantity" and f.dimension in V.STATED}):
        out = F.when(rule["dimension"] == d, make(d)) if out is None else out.when(rule["dimension"] == d, make(d))
    return otherwise if out is None else out.otherwise(otherwise)


def verdict_by(text: Column, rule: Column, pack: tuple[Field, ...]) -> Column:
    """verdicts.verdict of the row's own field; pack: whose dimensions can occur."""
    wrong = lambda code: V._outcome("FIELD_UNRESOLVED", code)
    dimension = F.coalesce(rule["dimension"], F.lit(""))
    percent = text.rlike(rf"(?U){V.NUMBER}\s*%") & (dimension != "fraction")
    no_range, absent = F.lit(False), V._ABSENT()
    values = _by_dimension(rule, pack, lambda d: V.stated_values(text, d), F.array().cast("array<double>"))
    unit_only = _by_dimension(rule, pack, lambda d: text.rlike("(?iU)" + V._UNIT_ONLY.get(d, r"(?!)")), no_range)
    ranged = _by_dimension(rule, pack, lambda d: V.states_range(text, d), no_range)
    rpm = text.rlike(rf"(?iU){V.NUMBER}\s*rpm\b") & (dimension == "relative_centrifugal_force")

    def stated(z: Column) -> Column:
        fits = lambda v: F.coalesce((v + rule["shift"]).between(rule["low"], rule["high"]), F.lit(False))
        plausible = rule["shift"].isNull() | (F.size(z["values"]) == 0) | F.exists(z["values"], fits)
        found = (F.size(z["values"]) > 0) | z["unit_only"]
        out = F.when(ranged, wrong("GAP_RANGE_NOT_POINT")).when(found & plausible, V._OK("FIELD_OK")).when(found, wrong("GAP_OUT_OF_RANGE"))
        out = out.when(rpm | percent, wrong("GAP_DIMENSION_MISMATCH")).otherwise(absent)
        return F.when(text.rlike(r"(?U)\d"), out).when(z["unit_only"], V._OK("FIELD_OK")).otherwise(absent)

    known = dimension.isin([d for d in V.STATED])
    quantity = F.when(~known, F.when(percent, wrong("GAP_DIMENSION_MISMATCH")).otherwise(wrong("GAP_UNPARSEABLE"))).otherwise(V.bind(F.struct(values.alias("values"), unit_only.alias("unit_only")), stated))
    states = lambda patterns: F.exists(patterns, lambda p: F.rlike(text, p))
    value = F.try_element_at(F.filter(rule["values"], lambda v: states(v["patterns"])), F.lit(1))["value"]
    enum = F.transform(F.array(value), lambda v: F.when(v.isNotNull(), V._OK("FIELD_OK", None, v)).otherwise(absent))[0]
    shown = F.when(rule["evidence"].isNull() | states(rule["evidence"]), V._OK("FIELD_OK")).otherwise(absent)
    sequence = F.when(text.rlike(r"(?U)\b[ACGTUacgtu]{12,}\b"), V._OK("FIELD_OK")).otherwise(absent)
    out = F.when(text.isNull(), absent).when(rule["type"] == "quantity", quantity).when(rule["type"] == "enum", enum).when(rule["type"] == "sequence", sequence)
    return out.when(rule["type"].isin("identifier", "text", "boolean"), shown).otherwise(wrong("GAP_UNPARSEABLE"))


def trigger_by(text: Column, rule: Column, spans: Column) -> Column:
    """triggers.trigger_verdict of the row's own field; spans: as of trigger_spans."""

    def of(family: str) -> Column:
        terms = F.try_element_at(rule["fills"], F.lit(family))
        free = F.array_contains(terms, ANY)
        kept = F.filter(spans[family], lambda x: F.coalesce(free | F.array_contains(terms, F.lower(x["text"])), F.lit(False)))
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.lit(family).alias("family")))

    places = F.filter(F.transform(rule["targets"], lambda p: first_place(text, p)["start"]), lambda at: at.isNotNull())
    found = F.struct(F.array_sort(F.concat(*map(of, G._CODES))).alias("t"), F.try_element_at(places, F.lit(1)).alias("at"))
    return G.governing(text, spans, found)
