"""Methods windows, profiles, subsections, triggers and the audit on planted documents."""

import pytest
from pyspark.sql import functions as F

from lacuna.functions import text as T
from lacuna.functions import triggers as G
from lacuna.functions.headings import with_methods
from lacuna.operators import audit, profile, sections
from lacuna.plans.pack import STARTER

PAD = " ".join(f"Plain filler prose number {i} is here." for i in range(30))
PAPER = f"""Some Title
Abstract
Mice were not used.
Materials and Methods
Cell culture
HCT116 cells were cultured at 37 °C in 5% CO2. Cells were obtained from ATCC. {PAD}
2.2 Treatment with
Pharmacologic Agents
Cells were stimulated with TNF for treatment at the indicated concentration. Reporter cells were assessed after overnight incubation.
Statistical Analysis
Data were compared by Student's t-test.
Results
Rats were seen."""
SHORT = "Only one sentence here about nothing. And 3."
#: The same line at even distances: furniture, though it looks like a heading.
FURNISHED = "Methods\n" + "\n".join(f"Journal of Things\n{'word ' * 60}end." for _ in range(4)) + "\nReal Heading\nSome text about the work."
PACK = tuple(f for f in STARTER if f.field_id in ("cellline.mycoplasma", "cellline.passage_number", "culture.temperature", "treatment.duration", "treatment.vehicle", "stats.test_named", "centrifugation.force", "animal.sex"))


def field(name):
    return next(f for f in STARTER if f.field_id == name)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("paper", PAPER), ("empty", ""), ("null", None), ("short", SHORT), ("blank", " \n\n "), ("heading", "Methods"), ("long", "x" * 50_000), ("furnished", FURNISHED), ("wide", "😀 " + PAPER)]
    return T.canonicalize(spark.createDataFrame(rows, "doc_id string, text string")).drop("text").cache()


def test_methods_window(docs):
    got = {r.doc_id: (r.t or "").split("\n") for r in with_methods(docs).select("doc_id", F.expr("substring(canonical_text, m_start + 1, m_end - m_start)").alias("t")).collect()}
    assert got["paper"][0] == "Materials and Methods" and got["paper"][-2].startswith("Data were compared") and got["wide"] == got["paper"]
    assert got["short"] == [SHORT] and got["heading"] == ["Methods"] and got["null"] == [""]  # no wide enough window: the whole text


def test_profile_reads_the_window_only(docs):
    rows = {r.doc_id: r for r in profile.study_profiles(docs).collect()}
    paper = rows["paper"]
    assert {k for k, v in paper.features.items() if v} == {"has_cell_lines", "has_drug_treatment", "has_wet_lab"}
    for doc in ("paper", "wide"):
        shown = {k: rows[doc].canonical_text[e.start : e.end] for k, e in rows[doc].evidence.items()}
        assert shown == {"has_cell_lines": "Reporter cells", "has_drug_treatment": "at the indicated concentration", "has_wet_lab": "Reporter cells"}
    assert not any(any(rows[d].features.values()) for d in ("empty", "null", "short", "blank", "long"))


@pytest.mark.parametrize(("text", "feature", "evidence"), [
    ("A goat anti-mouse IgG was used.", "has_animals", None),
    (f"A goat anti-mouse IgG was used. {PAD} Then rats were fed.", "has_animals", "rats"),
    ("DNA was treated with bisulfite overnight.", "has_drug_treatment", None),
    (f"DNA was treated with RNase. {PAD} Rows were treated with TNF.", "has_drug_treatment", "treated with"),
    ("Slices were stained.", "has_wet_lab", "stained"),
    ("We ran RT-PCR on a gel.", "has_qpcr", None),
    ("We ran qRT-PCR.", "has_qpcr", "qRT-PCR"),
])
def test_features(spark, text, feature, evidence):
    row = profile.study_profiles(spark.createDataFrame([("d", text)], "doc_id string, canonical_text string")).first()
    found = row.evidence.get(feature)
    assert (text[found.start : found.end] if found else None) == evidence and row.features[feature] == (evidence is not None)


def test_subsections(docs):
    rows = sections.subsections(with_methods(docs)).join(docs, "doc_id").orderBy("doc_id", "sub_idx").collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.header, r.canonical_text[r.start : r.end].strip()[:20]))
    assert got["paper"] == got["wide"] == [("Materials and Methods Cell culture", "HCT116 cells were cu"), ("Treatment with Pharmacologic Agents", "Cells were stimulate"), ("Statistical Analysis", "Data were compared b")]
    # a document's own heading joins the first; the recurring line is none
    assert [h for h, _ in got["furnished"]] == ["Methods", "Real Heading"]
    assert set(got) == {"paper", "wide", "furnished", "heading"}


@pytest.mark.parametrize(("text", "name", "code", "governed"), [
    ("Cells were assessed after overnight incubation.", "treatment.duration", "GAP_VAGUE", " overnight incubation."),
    ("Cells were assessed after overnight incubation.", "antibody.identifier", None, None),
    ("Antibody was added, and left overnight at 4 °C.", "antibody.identifier", None, None),
    ("Cells were grown as previously described.", "cellline.name", "GAP_DEFERRED_TO_REF", "Cells were grown as previously described."),
    ("Cells were grown as previously described.", "culture.temperature", None, None),
    ("Drug was given at the indicated concentrations.", "treatment.concentration", "GAP_DEFERRED_TO_DISPLAY", "Drug was given at the indicated concentrations."),
    ("Tubes were spun at high speed; then washed.", "centrifugation.force", "GAP_VAGUE", "Tubes were spun at high speed"),
    ("Spun at 500 × g, shaken gently.", "centrifugation.force", None, None),
    ("Spun at 500 × g, then kept at maximum speed.", "centrifugation.force", None, None),
    ("Drug in 5 µM, as previously described.", "treatment.vehicle", "GAP_DEFERRED_TO_REF", " as previously described."),
    ("", "treatment.vehicle", None, None),
])
def test_triggers(spark, text, name, code, governed):
    row = spark.createDataFrame([(text,)], "t string").select(G.trigger_verdict(F.col("t"), field(name)).alias("v")).first().v
    assert ((row.code, text[row.low : row.high]) if row else (None, None)) == (code, governed)


def test_findings(docs):
    rows = audit.findings(docs, PACK).orderBy("doc_id", "field_ordinal").collect()
    text = {r.doc_id: r.canonical_text for r in docs.collect()}
    paper = {r.field_id: r for r in rows if r.doc_id == "paper"}
    # temperature and test are stated; no animals, so no sex
    assert list(paper) == ["cellline.mycoplasma", "cellline.passage_number", "treatment.duration", "treatment.vehicle", "centrifugation.force"]
    assert paper["cellline.mycoplasma"].detail == {"anchor_detector": "anchor:node:det-unique:head:Materials and Methods Cell culture", "anchor_text": "HCT116 cells were cultured at 37 °C in 5% CO2."}
    assert paper["treatment.vehicle"].detail["anchor_detector"] == "anchor:node:det-unique:kw:Treatment with Pharmacologic Agent"
    assert paper["centrifugation.force"].detail["anchor_detector"] == "anchor:node:det-none:head:methods"
    assert paper["treatment.duration"].code == "GAP_DEFERRED_TO_DISPLAY" and paper["treatment.duration"].detail["detector"] == "keyword:fallback-whole-methods"
    for r in rows:
        assert 0 <= r.start < r.end <= len(text[r.doc_id]) and r.verdict in ("FIELD_ABSENT", "FIELD_UNRESOLVED")
        if "anchor_text" in r.detail:
            assert text[r.doc_id][r.start : r.end] == r.detail["anchor_text"] and r.raw_text is None
    strip = lambda d: [(r.field_id, r.code, r.detail) for r in rows if r.doc_id == d]
    assert strip("wide") == strip("paper") and [r.start for r in rows if r.doc_id == "wide"] == [r.start + 2 for r in rows if r.doc_id == "paper"]
    assert {r.doc_id for r in rows} >= {"paper", "wide", "short"} and not {"empty", "null", "blank"} & {r.doc_id for r in rows}
    assert len({r.finding_id for r in rows}) == len(rows)


def test_reports_keep_every_document(docs):
    some = docs.where(F.col("doc_id").isin("paper", "null", "empty"))
    rows = {r.doc_id: r for r in audit.reports(some, PACK).collect()}
    assert [f.field_id for f in rows["paper"].findings] == ["cellline.mycoplasma", "cellline.passage_number", "treatment.duration", "treatment.vehicle", "centrifugation.force"]
    assert rows["null"].findings == rows["empty"].findings == [] and audit.reports(docs.limit(0), PACK).count() == 0


def test_trigger_tier(spark):
    d = T.canonicalize(spark.createDataFrame([("d", "Reporter cells were placed and left overnight. Nothing more was said.")], "doc_id string, text string"))
    rows = audit.candidates(profile.study_profiles(d), (field("treatment.duration"),)).collect()
    assert [(r.detector, r.raw_text) for r in rows] == [("trigger:fills-slot", "Reporter cells were placed and left overnight.")]


def test_legality_and_counts(spark):
    rows = [("a", "FIELD_ABSENT", "GAP_ABSENT", 0, 5), ("a", "FIELD_ABSENT", "GAP_VAGUE", 0, 5), ("b", "FIELD_UNRESOLVED", "GAP_VAGUE", 5, 5), ("c", None, "GAP_ABSENT", 0, 5), ("d", "FIELD_OK", None, 0, 5), ("e", "FIELD_UNRESOLVED", "GAP_VAGUE", 1, 2)]
    found = spark.createDataFrame(rows, "doc_id string, verdict string, code string, start int, end int")
    assert sorted(r.doc_id for r in audit.illegal(found).collect()) == ["a", "b", "c", "d"]
    due = spark.createDataFrame([("a", "x"), ("a", "y"), ("z", "x")], "doc_id string, field_id string")
    got = {r.doc_id: tuple(r)[1:] for r in audit.document_counts(found, due).collect()}
    assert got == {"a": (2, 2, 2, 0), "z": (1, 0, 0, 0)}
