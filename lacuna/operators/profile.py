"""Study profiles: which features a document's methods show, each with its first evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.headings import first_place, with_methods
from lacuna.functions.text import match_spans

#: Fixed value: a narrower methods window isn't trusted, and the whole text is read instead.
LEAST_SCAN = 800
# Signs of each feature; the first sign in this order that occurs is the evidence.
ANIMALS = (r"\bmice\b", r"\bmouse\b", r"\brats?\b", r"\bmurine\b")
NOT_SUBJECTS = r"anti[-\s]?(?:mouse|rat|murine)|(?:mouse|murine|rat)\s+(?:fibroblast|embryonic\s+fibroblast|feeder|monoclonal|polyclonal|IgG|antibod\w*|serum|origin)"
SIGNS = {
    "has_cell_lines": (r"reporter\s+(?:T\s+)?cells?", r"\btransfect\w*", r"primary\s+\w+\s+cultures?", r"cell\s+lines?", r"cells?\s+were\s+(?:cultured|maintained|grown|seeded|plated)", r"cell\s+culture"),
    "has_qpcr": (r"\bq(?:RT-)?PCR\b", r"\bRT-qPCR\b", r"\breal[- ]?time\s+(?:RT-)?PCR\b", r"\bquantitative\s+(?:real[- ]?time\s+)?PCR\b", r"\bTaqMan\b", r"\bSYBR\b"),
    "has_western_blot": (r"western\s+blot", r"\bimmunoblot\w*"),
    "has_ihc": (r"\bimmunohistochem\w*", r"\bIHC\b"),
    "has_flow_cytometry": (r"flow\s+cytometr\w*", r"\bFACS\b", r"fluorescence[- ]activated\s+cell", r"annexin\s*[- ]?V", r"propidium\s+iodide"),
    "has_xenograft": (r"\bxenograft\w*\b", r"\btumou?r-bearing\b", r"(?:subcutaneous|orthotopic|intraperitoneal)\w*\s+(?:injection|implant\w*)", r"inject\w*\s+(?:subcutaneously|orthotopically)"),
}
DOSING = (r"at\s+(?:the\s+)?indicated\s+concentrations?", r"graded\s+concentrations?\s+of", r"blocking\s+\w+\s+antibody", r"stimulated\s+with", r"treatment\s+with\s+(?:pharmacolog|\w+\s+(?:agent|inhibitor|drug))", r"\b(?:administered|dosed)\s+(?:with\s+)?", r"\b(?:IC50|EC50)\b")
TREATED = r"treated\s+with"
REAGENTS = r"bisulfite|bisulphite|hydroquinone|proteinase\s*K|RNase|DNase|phenol|chloroform|ethanol\s*precipitation|NaOH|sodium\s+hydroxide"
BENCH_WORK = (r"\bcultured\b", r"\bdissected\b", r"\bextracted\b", r"\bstained\b", r"\bpurified\b", r"\bperfused\b")
#: Characters on each side of an animal's name, and after "treated with", that are looked at.
AROUND, AFTER = 30, 60


def _ci(pattern: str) -> str:
    return "(?iU)" + pattern


#: What a text must hold, case ignored, for any of a feature's signs to match (fixed values: a part of each sign).
STEMS = {
    "has_animals": ("mice", "mouse", "rat", "murine"),
    "has_cell_lines": ("reporter", "transfect", "primary", "cell"),
    "has_qpcr": ("pcr", "taqman", "sybr"),
    "has_western_blot": ("western", "immunoblot"),
    "has_ihc": ("immunohistochem", "ihc"),
    "has_flow_cytometry": ("cytometr", "facs", "fluorescence", "annexin", "propidium"),
    "has_xenograft": ("xenograft", "-bearing", "subcutaneous", "orthotopic", "intraperitoneal", "inject"),
    "dosing": ("concentration", "blocking", "stimulated", "treatment", "administered", "dosed", "ic50", "ec50"),
    "treated": ("treated",),
    "bench": ("cultured", "dissected", "extracted", "stained", "purified", "perfused"),
}


def folded(text: Column) -> Column:
    """In lower case, as patterns that ignore case read it: four letters beyond ASCII equal ASCII ones."""
    return F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))


def _holds(low: Column, name: str) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(stem)) for stem in STEMS[name]))


def _first(text: Column, patterns) -> Column:
    return F.coalesce(*(first_place(text, _ci(p)) for p in patterns))


def _bare(spans: Column) -> Column:
    return F.try_element_at(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), F.lit(1))


def study_profiles(docs: DataFrame, text_col: str = "canonical_text") -> DataFrame:
    """docs with m_start, m_end, features (map<string, boolean>) and evidence (map<string, struct<start, end>>, true ones only).

    Read from the methods window, or the whole text if that is narrow; places count from the text's start. Null and empty
    texts have no feature. A projection: nothing is shuffled.
    """
    rows = with_methods(docs, text_col)
    narrow = F.col("m_end") - F.col("m_start") < LEAST_SCAN
    rows = rows.withColumn("_from", F.when(narrow, 0).otherwise(F.col("m_start")))
    rows = rows.withColumn("_scan", F.when(narrow, F.col(text_col)).otherwise(F.substring(F.col(text_col), F.col("m_start") + 1, F.col("m_end") - F.col("m_start"))))
    rows = rows.withColumn("_low", folded(F.col("_scan")))
    text = F.col("_scan")
    # most texts lack most features, which the stems tell without a pattern
    of = lambda name, found: F.when(_holds(F.col("_low"), name), found)

    def is_subject(x: Column) -> Column:
        left = F.greatest(x["start"] - AROUND, F.lit(0))
        return ~F.substring(text, left + 1, x["end"] + AROUND - left).rlike(_ci(NOT_SUBJECTS))

    animals = F.coalesce(*(_bare(F.filter(match_spans(text, _ci(p)), is_subject)) for p in ANIMALS))
    treated = _bare(F.filter(match_spans(text, _ci(TREATED)), lambda x: ~F.substring(text, x["end"] + 1, F.lit(AFTER)).rlike(_ci(REAGENTS))))
    found = {"has_animals": of("has_animals", animals)} | {name: of(name, _first(text, signs)) for name, signs in SIGNS.items()} | {"has_drug_treatment": F.coalesce(of("dosing", _first(text, DOSING)), of("treated", treated))}
    rows = rows.withColumn("_hits", F.struct(*(c.alias(name) for name, c in found.items()), of("bench", _first(text, BENCH_WORK)).alias("bench")))
    wet = F.coalesce(*(F.col(f"_hits.{name}") for name in found), F.col("_hits.bench"))
    rows = rows.withColumn("_all", F.array(*(F.struct(F.lit(name).alias("k"), (F.col(f"_hits.{name}") if name in found else wet).alias("v")) for name in [*found, "has_wet_lab"])))
    moved = lambda v: F.struct((v["start"] + F.col("_from")).alias("start"), (v["end"] + F.col("_from")).alias("end"))
    features = F.map_from_entries(F.transform("_all", lambda e: F.struct(e["k"].alias("k"), e["v"].isNotNull().alias("v"))))
    evidence = F.map_from_entries(F.transform(F.filter("_all", lambda e: e["v"].isNotNull()), lambda e: F.struct(e["k"].alias("k"), moved(e["v"]).alias("v"))))
    return rows.withColumn("features", features).withColumn("evidence", evidence).drop("_from", "_scan", "_low", "_hits", "_all")
