"""Typed verdicts on one candidate text for one checklist field, as Column expressions without joins or Python code.

verdict(text, field) gives struct<verdict, code, value>. Triggers (vague or deferred wording) aren't part of it. A null
text is a missing candidate: absent. Meant for sentences: in a long text the look at all that stands before each number
is slow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions.text import bind, match_spans
from lacuna.plans.pack import Field

# How numbers, units and separators are written.
NUMBER = r"\d[\d,]*(?:\.\d+)?"
_POWER = r"\s*[×x✕]\s*10\s*\^?\s*\d+"
_LINE_NAME = r"(?=[A-Za-z0-9./-]*\d)(?=[A-Za-z0-9./-]*[A-Za-z])[A-Za-z0-9./-]+"
_TIME = r"\s*(?:seconds?|secs?|s|minutes?|mins?|min|hours?|hrs?|h|days?|d|weeks?|wks?)\b"
_MASS = r"\s*(?:ng|µg|μg|ug|mg|g|kg)\b"
#: dimension -> (before, number, after) of each way to state it; concentrations alone keep their case.
STATED = {
    "concentration": [("", NUMBER, r"\s*(?:[mµμunpf]?M\b|mol\s*/\s*[Ll]\b|(?i:(?:[nmµμu]?g|U|IU)\s*/\s*[mdc]?[lL]\b))")],
    "temperature": [("", NUMBER, r"\s*(?:°C|C\b|celsius)")],
    "time": [("", NUMBER, _TIME)],
    "fraction": [("", NUMBER, r"\s*%")],
    "volume": [("", NUMBER, r"\s*(?:mm\s*3|mm³|cm\s*3|cm³|nl|µl|μl|ul|ml|mL|l|L)\b")],
    "count": [("", rf"{NUMBER}(?:{_POWER})?", rf"\s*(?:\s{_LINE_NAME})?\s*(?:cells?|passages?|copies)\b"), (r"\bpassage\s*(?:number\s*)?", NUMBER, r"\b")],
    "relative_centrifugal_force": [("", NUMBER, r"\s*[×x✕*]\s*g\b")],
    "time_or_mass": [("", NUMBER, _TIME), ("", NUMBER, _MASS)],
}
# A unit without a number; the two forms of a range.
_UNIT_ONLY = {"relative_centrifugal_force": r"\brcf\b"}
_RANGE_FORMS = (r"({low})\s*(?:–|—|-|\bto\b)\s*", r"\b(?:between|from)\s+({low})\s+(?:and|to)\s+")
# What is added to a stated number of a dimension to have it in a unit. Other pairs aren't checked against a range.
TO_UNIT = {
    ("temperature", "K"): 273.15,
    ("fraction", "percent"): 0.0,
    ("count", "cells"): 0.0,
    ("relative_centrifugal_force", "g_rcf"): 0.0,
}
# Words that state an enumerated value besides the value itself.
SURFACE = {
    "Mus musculus": (r"\bmice\b", r"\bmouse\b", r"\bmurine\b", r"\bMus\s+musculus\b"),
    "Rattus norvegicus": (r"\brats?\b", r"\bRattus\b"),
    "male": (r"\bmales?\b", r"\bmale\s+(?:mice|rats|animals)\b"),
    "female": (r"\bfemales?\b",),
    "both": (r"\bboth\s+sexes\b", r"\bmale\s+and\s+female\b"),
    "subcutaneous_flank": (r"\bsubcutaneous(?:ly)?\b", r"\bs\.?c\.?\b", r"\bflank\b"),
    "orthotopic": (r"\borthotopic(?:ally)?\b",),
    "intravenous": (r"\bintravenous(?:ly)?\b", r"\bi\.?v\.?\b", r"\btail\s+vein\b"),
    "intraperitoneal": (r"\bintraperitoneal(?:ly)?\b", r"\bi\.?p\.?\b"),
    "biological": (r"\bbiological\s+replicates?\b", r"\bindependent\s+experiments?\b"),
    "technical": (r"\btechnical\s+replicates?\b", r"\bin\s+triplicate\b"),
}
SENTINELS = ("not_stated", "other")
# Evidence that a text states the field; each pattern with whether case is ignored.
EVIDENCE = {
    "animal.strain": ((r"[A-Z][a-z]+-[A-Z][a-z]+", False), (r"\b[A-Z]\d+[A-Z]{2,}\b", False), (r"\bBALB/c\b", True), (r"\bC57BL\b", True), (r"\bnude\b", True)),
    "cellline.authentication": (("short tandem repeat", True), (r"\bSTR\b", False), ("karyotyp", True), ("fingerprint", True), ("authenticat", True)),
    "cellline.source_or_rrid": ((r"\bATCC\b", False), (r"\bRRID\b", False), (r"\bCVCL_", False), ("#[A-Z0-9-]{4,}", False), ("purchased from", True), ("obtained from", True), ("provided by", True)),
    "cellline.mycoplasma": (("mycoplasma.{0,40}(test|negative|screen|free|confirm)", True), ("(test|screen).{0,40}mycoplasma", True)),
    "animal.ethics_approval": ((r"\bIACUC\b", False), ("institutional animal care", True), ("animal (?:studies|experiments?|protocols?|research).{0,40}approv", True), ("approv.{0,40}(?:animal|ethic|institutional)", True), ("ethics? (?:committee|approval|board)", True), (r"\b(?:protocol|permit|licen[cs]e)\s*(?:no\.?|number|#)\s*\S+", True)),
    "animal.sample_size_justification": (("power (?:analysis|calculation)", True), ("sample size.{0,40}(?:determin|calculat|justif|estimat|based)", True), ("(?:determin|calculat|estimat).{0,40}sample size", True), ("to (?:achieve|detect).{0,30}power", True)),
    "treatment.vehicle": ((r"\bDMSO\b", False), (r"dimethyl\s*sulf", True), (r"\b(?:ethanol|methanol|chloroform|acetone|corn oil|olive oil)\b", True), (r"\b(?:saline|PBS|HBSS|water)\b.{0,30}(?:vehicle|control|carrier)", True), ("vehicle.{0,40}(?:consist|compris|contain|prepar|dissolv|%)", True), (r"dissolved in\b", True), (r"\b\d+(?:\.\d+)?\s*%\s*(?:DMSO|ethanol|methanol)", True)),
    "stats.test_named": ((r"\b(?:ANOVA|MANOVA|ANCOVA)\b", False), (r"\bt-?test\b", True), ("student'?s? t", True), (r"\bMann-?Whitney\b", True), (r"\bWilcoxon\b", True), (r"\bKruskal-?Wallis\b", True), (r"\bchi-?squared?\b", True), (r"\bFisher'?s? exact\b", True), (r"\blog-?rank\b", True), (r"\bKaplan-?Meier\b", True), (r"\b(?:Tukey|Bonferroni|Dunnett|Sidak|Holm)\b", True), (r"\b(?:linear|logistic|Cox) regression\b", True), (r"\bSpearman\b|\bPearson\b", True)),
    "qpcr.reference_genes": ((r"\b(?:GAPDH|ACTB|B2M|HPRT1?|TBP|RPLP0|PPIA|UBC|18S|28S|5S|U6)\b", False), ("beta[- ]?actin|β[- ]?actin", True), ("housekeeping gene", True), ("(?:normali[sz]ed|normali[sz]ation).{0,40}(?:to|against|using)", True), ("(?:endogenous|internal) (?:control|reference)", True)),
    "xenograft.tumour_measurement_method": ((r"\bcalip", True), (r"(?:length|L)\s*[×x*]\s*(?:width|W)", True), (r"width\s*\^?\s*2|W\s*\^?\s*2|W²", True), ("tumou?r volume.{0,40}(?:calculat|determin|formula|=)", True), (r"\b(?:bioluminescen|IVIS|micro-?CT|MRI|ultrasound)\w*", True)),
    "cellline.name": ((r"\b[A-Z][A-Za-z]{0,6}[- ]?\d{1,4}[A-Za-z]?\b", False), (r"\b(?:HeLa|Jurkat|Vero|Raji|K562|MCF7|A549|PC3|LNCaP)\b", False), (r"cell line[s]?\s+(?:named|designated|called)", True)),
}
#: A letter in the run of letters, digits and hyphens that ends here.
_IN_NAME = r"\p{L}[\p{L}\p{N}-]*\z"


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def evidence_patterns(field_id: str) -> list[str] | None:
    """Patterns of which one shows that a text states the field; None: none are known."""
    return [("(?iUd)" if ci else "(?Ud)") + p for p, ci in EVIDENCE[field_id]] if field_id in EVIDENCE else None


def relevant(text: Column, field_id: str) -> Column:
    """Whether the text holds evidence of the field; true where no evidence is known for it."""
    patterns = evidence_patterns(field_id)
    return F.lit(True) if patterns is None else _any([text.rlike(p) for p in patterns])


def number(token: Column) -> Column:
    """The value of a written number, a power of ten included; null if it is none."""
    power = F.regexp_extract(token, r"10\s*\^?\s*(\d+)$", 1).try_cast("double")
    plain = lambda t: F.regexp_replace(t, ",", "").try_cast("double")
    return F.when(token.rlike(r"[×xX✕]"), plain(F.regexp_extract(token, rf"^({NUMBER})", 1)) * F.pow(F.lit(10.0), power)).otherwise(plain(token))


def _flags(dimension: str) -> str:
    return "(?U)" if dimension == "concentration" else "(?iU)"


def _tokens(text: Column, flags: str, before: str, n: str, after: str) -> Column:
    """array<string> of the numbers of one way to state a dimension, but for those within names such as EC109."""
    pattern = f"{flags}{before}({n}){after}"
    lead = lambda m: F.length(F.regexp_extract(m, f"{flags}^{before}", 0)) if before else F.lit(0)
    found = F.zip_with(match_spans(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x, t: F.struct((x["start"] + lead(x["text"])).alias("at"), t.alias("t")))
    kept = F.filter(found, lambda x: ~F.substring(text, F.lit(1), x["at"]).rlike(_IN_NAME))
    return F.when(text.rlike(pattern), F.transform(kept, lambda x: x["t"])).otherwise(F.array().cast("array<string>"))


def stated_values(text: Column, dimension: str) -> Column:
    """array<double> of what the text states of a dimension; numbers within names such as EC109 or B1.5 don't count."""
    return F.transform(F.concat(*(_tokens(text, _flags(dimension), *way) for way in STATED[dimension])), number)


def states_range(text: Column, dimension: str) -> Column:
    """Whether the text gives an interval with a lower and a higher end; units ignore case here."""
    tests = []
    for before, n, after in STATED[dimension]:
        for form in _RANGE_FORMS:
            pattern = f"(?iU){form.replace('{low}', NUMBER)}(?:{before}({n}){after})"
            ends = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda a, b: F.coalesce(number(a) < number(b), F.lit(False)))
            tests.append(text.rlike(pattern) & F.exists(ends, lambda x: x))
    return _any(tests)


def _outcome(verdict: str, code: str | None = None, value: Column | None = None) -> Column:
    return F.struct(F.lit(verdict).alias("verdict"), F.lit(code).cast("string").alias("code"), (F.lit(None).cast("string") if value is None else value).alias("value"))


_OK, _ABSENT = _outcome, lambda: _outcome("FIELD_ABSENT", "GAP_ABSENT")


def quantity(text: Column, f: Field) -> Column:
    """A range, a value, one out of the plausible range, another dimension, or nothing; the first that holds."""
    wrong = lambda code: _outcome("FIELD_UNRESOLVED", code)
    percent = text.rlike(rf"(?U){NUMBER}\s*%") & F.lit(f.dimension != "fraction")
    if f.dimension not in STATED:
        return F.when(percent, wrong("GAP_DIMENSION_MISMATCH")).otherwise(wrong("GAP_UNPARSEABLE"))
    values = stated_values(text, f.dimension)
    unit_only = text.rlike("(?iU)" + _UNIT_ONLY.get(f.dimension, r"(?!)"))
    found = (F.size(values) > 0) | unit_only
    plausible = F.lit(True)
    if f.low is not None and (f.dimension, f.canonical_unit) in TO_UNIT:
        add = TO_UNIT[f.dimension, f.canonical_unit]
        plausible = (F.size(values) == 0) | F.exists(values, lambda v: F.coalesce((v + add).between(f.low, f.high), F.lit(False)))
    rpm = text.rlike(rf"(?iU){NUMBER}\s*rpm\b") & F.lit(f.dimension == "relative_centrifugal_force")
    out = F.when(states_range(text, f.dimension), wrong("GAP_RANGE_NOT_POINT")).when(found & plausible, _OK("FIELD_OK")).when(found, wrong("GAP_OUT_OF_RANGE"))
    out = out.when(rpm | percent, wrong("GAP_DIMENSION_MISMATCH")).otherwise(_ABSENT())
    # Nothing but a unit of its own can be stated without a digit.
    return F.when(text.rlike(r"(?U)\d"), out).when(unit_only, _OK("FIELD_OK")).otherwise(_ABSENT())


def may_state(text: Column) -> Column:
    """Whether the text has a digit or a unit that states without one; quantity() gives all others what it gives an empty text."""
    return text.rlike(r"(?U)\d") | _any([text.rlike("(?iU)" + p) for p in _UNIT_ONLY.values()])


def value_patterns(values: tuple[str, ...]) -> list[tuple[str, list[str]]]:
    """(value, patterns of which one states it) of the values that can be stated."""
    return [(v, ["(?iU)" + p for p in (rf"\b\Q{v.replace('_', ' ')}\E\b", *SURFACE.get(v, ()))]) for v in values if v not in SENTINELS]


def enum_value(text: Column, values: tuple[str, ...]) -> Column:
    """The first of the values, in the checklist's order, that the text states; null if none."""
    hits = [F.when(_any([text.rlike(p) for p in patterns]), F.lit(v)) for v, patterns in value_patterns(values)]
    return F.coalesce(*hits, F.lit(None).cast("string"))


def verdict(text: Column, f: Field) -> Column:
    """struct<verdict, code, value>, by the field's type; an unknown type can't be read."""
    if f.type == "quantity":
        out = quantity(text, f)
    elif f.type == "enum":
        value = enum_value(text, f.enum_values)
        out = F.when(value.isNotNull(), _OK("FIELD_OK", None, value)).otherwise(_ABSENT())
    elif f.type == "sequence":
        out = F.when(text.rlike(r"(?U)\b[ACGTUacgtu]{12,}\b"), _OK("FIELD_OK")).otherwise(_ABSENT())
    elif f.type in ("identifier", "text", "boolean"):
        out = F.when(relevant(text, f.field_id), _OK("FIELD_OK")).otherwise(_ABSENT())
    else:
        out = _outcome("FIELD_UNRESOLVED", "GAP_UNPARSEABLE")
    return F.when(text.isNull(), _ABSENT()).otherwise(out)
