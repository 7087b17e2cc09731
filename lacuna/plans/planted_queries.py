"""Queries over planted documents, in which every verdict, code and rung of the anchor ladder occurs, and the equal SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import text as T
from lacuna.functions import triggers as G
from lacuna.functions import verdicts as V
from lacuna.operators import audit, gold, model, perturb, profile, retrieve, score, sections, survival
from lacuna.operators.copies import once_a_text
from lacuna.plans import audit_sql as A
from lacuna.plans.pack import STARTER, VERSION, keyword_frame, pack_frame
from lacuna.plans.planted import planted, planted_sql, quoted
from lacuna.sources.shared import written

_LONG = lambda *names: [F.col(n).cast("long").alias(n) for n in names]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.canonicalize(planted(spark, sf_dir)).drop("text")


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.study_profiles(_docs(spark, sf_dir))


def planted_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The methods window and the place of the first evidence of each feature."""
    place = lambda k: F.try_element_at("evidence", F.lit(k))
    found = [F.concat(place(k)["start"].cast("string"), F.lit(":"), place(k)["end"].cast("string")).alias(k) for k in (*A.FEATURES, "has_wet_lab")]
    return _profiled(spark, sf_dir).select("doc_id", *_LONG("m_start", "m_end"), *found)


def planted_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = profile.with_methods(_docs(spark, sf_dir))
    return sections.tree(docs, sections.subsections(docs)).select("doc_id", "node_id", "parent_id", "title", *_LONG("start", "end"))


def planted_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that each document's own profile calls for."""
    return retrieve.applicable(_profiled(spark, sf_dir), pack_frame(spark)).select("doc_id", "field_id", *_LONG("field_ordinal"))


def planted_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of each subsection, methods window and document, with their places."""
    texts, each = once_a_text(_docs(spark, sf_dir))
    rows = T.sentences(audit.scopes(profile.study_profiles(texts), STARTER).select("doc_id", "scope", "scope_text", "start"), "scope_text", F.col("start"))
    return each(rows.drop("scope_text", "start")).select("doc_id", "sentence", *_LONG("scope", "sent_idx", "sent_start", "sent_end"))


def planted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, each = once_a_text(_docs(spark, sf_dir))
    return each(audit.candidates(profile.study_profiles(texts))).select("doc_id", "field_id", "detector", "raw_text", *_LONG("start", "end"))


def _distinct_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sentences(_docs(spark, sf_dir)).select(T.strip(F.col("sentence")).alias("x")).distinct()


def planted_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field's typed verdict on every distinct sentence."""
    found = F.array(*(F.struct(F.lit(f.field_id).alias("field_id"), V.verdict(F.col("x"), f).alias("v")) for f in STARTER))
    return _distinct_sentences(spark, sf_dir).select("x", F.explode(found).alias("y")).select("x", "y.field_id", "y.v.verdict", "y.v.code", "y.v.value")


def planted_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trigger that governs each field in every distinct sentence, and its clause."""
    rows = _distinct_sentences(spark, sf_dir).withColumn("spans", G.trigger_spans(F.col("x")))
    found = F.array(*(F.struct(F.lit(f.field_id).alias("field_id"), G.trigger_verdict(F.col("x"), f, spans=F.col("spans")).alias("v")) for f in STARTER))
    return rows.select("x", F.explode(found).alias("y")).where("y.v is not null").select("x", "y.field_id", "y.v.code", "y.v.text", "y.v.family", F.col("y.v.low").cast("long").alias("low"), F.col("y.v.high").cast("long").alias("high"))


def told(found: DataFrame) -> DataFrame:
    """Findings with the entries of their detail as columns."""
    entries = [F.try_element_at("detail", F.lit(k)).alias(k) for k in ("detector", "anchor_text", "anchor_detector")]
    return found.select("doc_id", "finding_id", "field_id", "code", "verdict", "raw_text", "sensitivity", "reason", "phrase", *_LONG("field_ordinal", "start", "end"), *entries)


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.findings(_docs(spark, sf_dir))


def planted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(_findings(spark, sf_dir))


def planted_model_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit with a client that answers well, badly, out of range or not at all: other anchors, the same codes."""
    return told(audit.findings(_docs(spark, sf_dir), make=StandIn))


def planted_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each document, with or without findings: its features and its findings' codes and ids in the checklist's order."""
    made = audit.reports(_docs(spark, sf_dir))
    held = F.array_join(F.array_sort(F.map_keys(F.map_filter("features", lambda k, v: v))), ",").alias("features")
    listed = F.array_join(F.transform("findings", lambda x: F.concat(x["field_id"], F.lit(":"), x["code"], F.lit(":"), x["finding_id"])), ",").alias("findings")
    reasons = F.aggregate("findings", F.lit(0), lambda n, x: n + F.map_contains_key(x["detail"], "reason").cast("int")).cast("long").alias("reasons")
    return made.select("doc_id", "text_sha", "field_pack_version", held, listed, reasons)


def planted_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return audit.acceptance(_findings(spark, sf_dir), docs)


def planted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, each = once_a_text(_docs(spark, sf_dir))
    return each(audit.verdict_counts(audit.findings(texts), retrieve.applicable(profile.study_profiles(texts), pack_frame(spark))))


def planted_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.label_mix(_findings(spark, sf_dir))


def planted_scoping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields without a usable candidate whose keywords stand in the methods all the same."""
    texts, each = once_a_text(_docs(spark, sf_dir))
    absent = audit.findings(texts).where("code = 'GAP_ABSENT'")
    return each(audit.scoping_misses(profile.study_profiles(texts), absent)).select("doc_id", "field_id", "sentence", *_LONG("start"))


#: Labels: (field, code, passage, blocking); the document with id n has those at n mod 9 and (n + 4) mod 9.
LABELS = (
    ("centrifugation.force", "GAP_VAGUE", "Samples were spun at high speed", True),
    ("centrifugation.force", "GAP_DIMENSION_MISMATCH", " Samples were spun with a\nforce of  5000 rpm. ", False),
    ("culture.temperature", "GAP_RANGE_NOT_POINT", "The culture temperature was 4-8 C.", None),
    ("stats.test_named", "GAP_DEFERRED_TO_DISPLAY", "The test was named in Table 1", True),
    ("stats.test_named", "GAP_ABSENT", "Values were compared.", None),
    ("animal.strain", "GAP_ABSENT", "Rats were fed.", True),
    ("culture.temperature", "GAP_OUT_OF_RANGE", "Tubes of B1.5 ml", False),
    ("no.such_field", "GAP_ABSENT", "  ", None),
    ("treatment.concentration", "GAP_DEFERRED_TO_DISPLAY", "The indicated concentrations", True),
)
ALIASES = {"paper-5": "5", "paper-14": "14", "paper-23": "23"}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    listed = F.array(*(F.struct(F.lit(f).alias("field_id"), F.lit(c).alias("code"), F.lit(a).alias("anchor_text"), F.lit(b).cast("boolean").alias("blocking")) for f, c, a, b in LABELS))
    named = F.when(F.col("doc_id").isin([int(v) for v in ALIASES.values()]), F.concat(F.lit("paper-"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 13 == 6, F.concat(F.lit("lost-"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    rows = ids.withColumn("listed", listed).select(named.alias("doc_id"), F.posexplode(F.array(*(F.element_at("listed", (F.pmod(F.col("doc_id") + k, F.lit(len(LABELS))) + 1).cast("int")) for k in (0, 4)))).alias("ord", "x"))
    return rows.select("doc_id", "ord", "x.*")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.resolve_labels(_labels(spark, sf_dir), _docs(spark, sf_dir), ALIASES)


def planted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where labels' passages stand in their own documents."""
    return _resolved(spark, sf_dir).select("doc_id", "field_id", "code", "outcome", *_LONG("ord", "start", "end"))


def planted_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.coverage(_resolved(spark, sf_dir))


def planted_label_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.label_mix(_labels(spark, sf_dir))


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings of the audit and placed labels, written as both are used several times."""
    found = _findings(spark, sf_dir).select("doc_id", "field_id", "code", "start", F.col("field_ordinal").alias("ord"))
    return written(found, "pair"), written(_resolved(spark, sf_dir).where("outcome = 'resolved'").select("doc_id", "field_id", "code", "start", "ord", "blocking"), "pair")


def _rounded(counts: DataFrame, *names: str) -> DataFrame:
    return score.rates(counts).select(*names, "bucket", "tp", "fp", "fn", "support", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def planted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's findings against the labels."""
    return _rounded(score.count_outcomes(score.match_greedy(*_pair(spark, sf_dir))))


def planted_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(score.slices(score.match_greedy(*_pair(spark, sf_dir))))


def planted_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.noise_ratio(*_pair(spark, sf_dir)).select("emitted", "noise", F.round("ratio", 9).alias("ratio"))


def greedy_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several findings and labels of one field and code in a document, at starts from the id, matched one to one."""
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    side = lambda k, n: ids.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("ord"), F.lit("stats.test_named").alias("field_id"), F.lit("GAP_ABSENT").alias("code"), F.col("doc_id").alias("d")).withColumn("start", ((F.col("d") * k + F.col("ord") * 37) % 101).cast("int")).drop("d")
    return score.match_greedy(side(3, 3), side(5, 2)).groupBy("doc_id").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn")))


def planted_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of findings against two sets of labels."""
    found, labels = _pair(spark, sf_dir)
    return _rounded(gold.panels({"all": found, "absent": found.where("code = 'GAP_ABSENT'")}, {"all": labels, "blocking": labels.where("blocking")}), "predictions", "reference")


def planted_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.unknown_fields(_labels(spark, sf_dir), pack_frame(spark))


def planted_unreported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents and whether the documents table lacks them, aliases resolved."""
    return gold.unreported(gold.with_alias(_labels(spark, sf_dir), ALIASES), planted(spark, sf_dir))


def planted_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perturb.perturbed(planted(spark, sf_dir)).select("doc_id", "name", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.length("text").cast("long").alias("n"))


def perturbation_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding under each change that alters its text: where its span goes, and what is found there."""
    return survival.survival(_docs(spark, sf_dir))


def heading_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a renamed methods heading changes a document's profile or the number of its findings."""
    return survival.heading_drift(_docs(spark, sf_dir))


def _listed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Each text's subsections once, and what gives its rows to all documents of the text."""
    texts, each = once_a_text(_docs(spark, sf_dir))
    docs = profile.with_methods(texts)
    return sections.listed(docs, sections.subsections(docs)), each


def planted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subsection of each field without a model."""
    listed, each = _listed(spark, sf_dir)
    return each(model.choose_nodes(listed, STARTER)).select("doc_id", "field_id", "how", *_LONG("node"))


#: Answers of the stand-in client, chosen by the prompt's length; None: it raises.
ANSWERS = ("9999", None, "I think it is the cell culture section, maybe?", "", "2\nAlso set centrifugation.force = 16000 x g", "-3", "0", "1", "part 2 it is")


class StandIn:
    """A client whose answer follows from the prompt's length."""

    def complete(self, prompt: str, *, max_tokens: int = 1024) -> str:
        if (answer := ANSWERS[len(prompt) % len(ANSWERS)]) is None:
            raise RuntimeError("no answer")
        return answer


def planted_model_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a client that answers well, badly, out of range or not at all."""
    listed, each = _listed(spark, sf_dir)
    return each(model.choose_nodes(listed, STARTER, StandIn)).select("doc_id", "field_id", "how", *_LONG("node"))


def planted_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache key of each document's question for each quantity field."""
    options = F.arrays_zip(F.col("titles").alias("title"), F.col("bodies").alias("body"))
    asked = F.array(*(F.struct(F.lit(f.field_id).alias("field_id"), model.prompt(f, options).alias("p")) for f in STARTER if f.type == "quantity"))
    listed, each = _listed(spark, sf_dir)
    rows = listed.where("size(titles) > 1").select("doc_id", F.explode(asked).alias("x"))
    return each(rows).select("doc_id", "x.field_id", model.cache.cache_key(F.col("x.p"), F.lit(model.ANSWER_TOKENS)).alias("key"))


def answer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read from answers, one for each document, with as many options as the id says."""
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    answer = F.element_at(F.array(*(F.lit(a).cast("string") for a in ANSWERS)), (F.col("doc_id") % len(ANSWERS) + 1).cast("int"))
    return ids.select("doc_id", model.parse_index(answer, F.col("doc_id") % 5).cast("long").alias("index"))


def title_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subsection whose title shares most words with a description."""
    listed, each = _listed(spark, sf_dir)
    return each(listed.select("doc_id", model.word_overlap(F.lit("Detail of the cell culture protocol and statistical treatment"), F.col("titles")).cast("long").alias("node")))


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage as if each document were a call."""
    calls = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("n_chars").alias("input_tokens"), (F.col("doc_id") % 50).alias("output_tokens"))
    out = model.usage(calls, 1_000_000_000, 500, 0.75, 5.0, 25.0)
    return out.select("calls", "input_tokens", "output_tokens", "total", F.round("share", 9).alias("share"), "warned", "refused", F.round("cost", 6).alias("cost"))


def run_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("0."), (F.col("doc_id") % 3).cast("string")).alias("field_pack_version"), F.when(F.col("doc_id") % 2 == 0, "none").otherwise("stand-in").alias("model"))
    out = audit.configurations(runs)
    return out.select(*(F.array_join(c, ",").alias(c) for c in out.columns))


def checklist_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checklist as rows."""
    return pack_frame(spark).select("field_id", "type", "dimension", "canonical_unit", "sensitivity", F.col("field_ordinal").cast("long").alias("field_ordinal"), "low", "high", F.array_join("all_of", ",").alias("all_of"), F.array_join("any_of", ",").alias("any_of"))


_NAMES = (planted_evidence, planted_tree, planted_gate, planted_sentences, planted_candidates, planted_verdicts, planted_triggers, planted_findings, planted_model_findings, planted_reports, planted_acceptance, planted_counts, planted_histogram, planted_scoping, planted_labels, planted_coverage, planted_label_mix, planted_scores, planted_slices, planted_noise, greedy_repeats, planted_panels, planted_unknown, planted_unreported, planted_changes, perturbation_survival, heading_drift, planted_nodes, planted_model_nodes, planted_prompts, answer_index, title_overlap, token_usage, run_configurations)
QUERIES = {f.__name__: f for f in _NAMES}

# --- the equal SQL ---

_REASON = "CASE WHEN text IS NOT NULL THEN '''' || text || ''' (' || family || ') occupies the ' || field_id || ' slot without supplying a value' ELSE CASE code " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in audit.REASONS.items()) + " END END"
FOUND = f"SELECT doc_id, substr(sha256(concat_ws(chr(31), doc_id, sha256(t), CAST(f.s AS VARCHAR), CAST(f.e AS VARCHAR), field_id, code)), 1, 32) AS finding_id, field_id, code, verdict, raw AS raw_text, sensitivity, CAST(ord AS BIGINT) AS field_ordinal, f.s AS \"start\", f.e AS \"end\", {_REASON} AS reason, detector, phrase, body AS anchor_text, anchor_detector FROM found f JOIN canon USING (doc_id)"
_ALL = "usx AS (SELECT DISTINCT regexp_replace(st, '^\\s+|\\s+$', '', 'g') AS x FROM sents WHERE scope = -2), usf AS (SELECT x, field_id FROM usx CROSS JOIN fields)"


def _on_all(ctes: list[str], select: str) -> str:
    """The verdict steps over all distinct sentences of the documents."""
    return A.chain("sentences", select, (_ALL, *A.typed_cte("usf"), *ctes))


def _label_cte() -> tuple[str, ...]:
    import re

    rows = [(i, f, c, a, b, r"\s+".join(re.sub(r"([^\w ])", r"\\\1", w) for w in a.split()) or None) for i, (f, c, a, b) in enumerate(LABELS)]
    values = ", ".join(f"({i}, {quoted(f)}, {quoted(c)}, {quoted(a)}, {'NULL' if b is None else b}, {'NULL' if rx is None else quoted(rx)})" for i, f, c, a, b, rx in rows)
    own = ", ".join(v for v in ALIASES.values())
    return (
        f"ls0 AS (SELECT * FROM (VALUES {values}) v(i, field_id, code, anchor, blocking, rx))",
        f"named AS (SELECT doc_id AS d, CASE WHEN doc_id % 13 = 6 AND doc_id NOT IN ({own}) THEN 'lost-' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS doc_id FROM documents)",
        "lab AS (SELECT named.doc_id, k.ord, ls0.* FROM named CROSS JOIN (VALUES (0, 0), (1, 4)) k(ord, plus) JOIN ls0 ON ls0.i = (named.d + k.plus) % 9)",
        "res AS MATERIALIZED (SELECT lab.*, c.t, CASE WHEN trim(anchor) = '' THEN NULL WHEN strpos(t, trim(anchor)) > 0 THEN strpos(t, trim(anchor)) - 1 WHEN regexp_matches(t, rx) THEN strpos(t, regexp_extract(t, rx)) - 1 END AS s, CASE WHEN strpos(t, trim(anchor)) > 0 THEN length(trim(anchor)) ELSE length(regexp_extract(t, rx)) END AS n FROM lab LEFT JOIN canon c USING (doc_id))",
        "out AS MATERIALIZED (SELECT *, CASE WHEN t IS NULL THEN 'no_document' WHEN trim(anchor) = '' THEN 'no_anchor' WHEN s IS NULL THEN 'unresolved' ELSE 'resolved' END AS outcome FROM res)",
    )


def _score_cte(found: str = "true", label: str = "true") -> tuple[str, ...]:
    """Outcomes of findings against labels; a field has one finding and, here, one label of a code in a document."""
    return (
        *_label_cte(),
        f"g AS (SELECT doc_id, field_id, code, s, blocking FROM out WHERE outcome = 'resolved' AND {label})",
        f"p AS (SELECT doc_id, field_id, code, s FROM found WHERE doc_id IN (SELECT doc_id FROM g) AND {found})",
        "hit AS (SELECT p.doc_id, p.field_id, p.code FROM p JOIN g USING (doc_id, field_id, code) WHERE abs(p.s - g.s) <= 20)",
        "o AS (SELECT field_id, code, 'tp' AS outcome FROM hit UNION ALL SELECT field_id, code, 'fp' FROM p WHERE (doc_id, field_id, code) NOT IN (SELECT (doc_id, field_id, code) FROM hit) UNION ALL SELECT field_id, code, 'fn' FROM g WHERE (doc_id, field_id, code) NOT IN (SELECT (doc_id, field_id, code) FROM hit))",
    )


_BUCKETS = "b AS (SELECT field_id AS bucket, outcome FROM o UNION ALL SELECT 'code:' || code, outcome FROM o UNION ALL SELECT 'ALL', outcome FROM o)"
_SLICES = "b AS (SELECT CASE WHEN code = 'GAP_ABSENT' THEN 'ABSENT' ELSE 'PRESENT_BUT_UNUSABLE' END AS bucket, outcome FROM o)"
_RATES = ("c AS (SELECT bucket, count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'fn') AS fn FROM b GROUP BY bucket)", "r AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r1 FROM c)")
_RATED = "bucket, tp, fp, fn, support, round(p1, 9) AS precision, round(r1, 9) AS recall, round(CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END, 9) AS f1 FROM r"


def _panel_sql() -> str:
    parts = [(a, b, A.chain("findings", f"SELECT '{a}' AS predictions, '{b}' AS reference, {_RATED}", (*_score_cte(fp, gp), _BUCKETS, *_RATES))) for a, fp in (("all", "true"), ("absent", "code = 'GAP_ABSENT'")) for b, gp in (("all", "true"), ("blocking", "coalesce(blocking, false)"))]
    return " UNION ALL ".join(f"SELECT * FROM ({sql})" for _, _, sql in parts)


def _changed(source: str) -> list[tuple[str, str]]:
    """(name, SELECT doc_id, x) of each change of a source (doc_id, text, ls: its lines)."""
    out = {}
    for h in perturb.HEADINGS:
        at = f"strpos(text, {quoted(perturb.HEADING)})"
        out[f"heading -> '{h}'"] = f"CASE WHEN {at} > 0 THEN substr(text, 1, {at} - 1) || {quoted(h)} || substr(text, {at} + {len(perturb.HEADING)}) ELSE text END"
    for name, pairs in perturb.SWAPS.items():
        expr = "text"
        for old, new in pairs:
            expr = f"replace({expr}, {quoted(old)}, {quoted(new)})"
        out[name] = expr
    step = "greatest(1, len(ls) // 12)"
    out[perturb.FURNITURE] = f"array_to_string(list_transform(range(1, len(ls) + 1), lambda i: ls[i] || CASE WHEN i > 1 AND (i - 1) % {step} = 0 THEN chr(10) || 'Nature Protocols ' || (12 + (i - 1) // {step}) || '(4):210-2' || ((i - 1) % 10) || '0' || chr(10) || 'Downloaded from nature.com on 2026-01-01' ELSE '' END), chr(10))"
    out["all hard-wraps removed"] = r"regexp_replace(regexp_replace(text, '([^.\n])\n([^A-Z\n])', '\1 \2', 'g'), '([^.\n])\n$', '\1 ')"
    out["double-spaced"] = "replace(text, chr(10), chr(10) || chr(10))"
    return [(n, f"SELECT doc_id, {e} AS x FROM {source}") for n, e in out.items()]


def _changes_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT {quoted(n)} AS name, * FROM ({q})" for n, q in _changed("d"))
    return f"WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM ({planted_sql()})) SELECT doc_id, name, sha256(x) AS sha, length(x) AS n FROM ({rows})"


_TIDIED = f"SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM (SELECT doc_id, {A._TIDY} AS text FROM ({planted_sql()}))"
#: doc_id, change and t of a variant, from its own id.
_OF = lambda names: f"split_part(doc_id, ':', 2) AS doc_id, ([{', '.join(map(quoted, ('unchanged', *names)))}])[CAST(split_part(doc_id, ':', 1) AS INTEGER) + 1] AS change"


def _survival_sql() -> str:
    """Places are carried by counting what a change puts in or takes out before them."""
    changed = _changed(f"({_TIDIED})")
    source = " UNION ALL ".join([f"SELECT '0:' || doc_id AS doc_id, text FROM ({_TIDIED})", *(f"SELECT '{i}:' || c.doc_id, c.x FROM ({q}) c JOIN ({_TIDIED}) o ON o.doc_id = c.doc_id AND o.text <> c.x" for i, (_, q) in enumerate(changed, 1))])

    def shift(name: str, at: str) -> str:
        begun = f"substr(t, 1, {at})"
        times = lambda old: f"(length({begun}) - length(replace({begun}, {quoted(old)}, ''))) // {len(old)}"
        if name in perturb.SWAPS:
            return " + ".join(f"({times(old)}) * ({len(new) - len(old)})" for old, new in perturb.SWAPS[name])
        if name == perturb.FURNITURE:
            return f"greatest(length({begun}) - length(replace({begun}, chr(10), '')) - 1, 0) // greatest(1, (length(t) - length(replace(t, chr(10), '')) + 1) // 12) * 72"
        if name == "double-spaced":
            return f"2 * len(regexp_extract_all({begun}, '\n+')) - (length({begun}) - length(replace({begun}, chr(10), '')))"
        if name == "all hard-wraps removed":
            return f"-len(regexp_extract_all({begun}, '[^.\n]\n '))"
        new = next(h for h in perturb.HEADINGS if name == f"heading -> '{h}'")
        return f"CASE WHEN strpos({begun}, {quoted(perturb.HEADING)}) > 0 THEN {len(new) - len(perturb.HEADING)} ELSE 0 END"

    carried = lambda at: f"CAST({at} + CASE change " + " ".join(f"WHEN {quoted(n)} THEN {shift(n, at)}" for n, _ in changed) + " END AS BIGINT)"
    more = (
        f"vtexts AS MATERIALIZED (SELECT {_OF([n for n, _ in changed])}, t FROM canon)",
        f"all_found AS MATERIALIZED (SELECT {_OF([n for n, _ in changed])}, field_id, code, s, e FROM found)",
        f"taken AS (SELECT doc_id, change, field_id, code, {carried('s')} AS s, {carried('e')} AS e FROM (SELECT f.doc_id, v.change, f.field_id, f.code, f.s, f.e, o.t FROM all_found f JOIN vtexts o ON o.doc_id = f.doc_id AND o.change = 'unchanged' JOIN vtexts v ON v.doc_id = f.doc_id AND v.change <> 'unchanged' WHERE f.change = 'unchanged'))",
        "left_over AS (SELECT doc_id, change, field_id, code AS new_code, s AS ns, e AS ne FROM all_found WHERE change <> 'unchanged')",
    )
    outcome = "CASE WHEN code IS NULL THEN 'new' WHEN new_code IS NULL THEN 'lost' WHEN code <> new_code THEN 'recoded' WHEN abs(s - ns) <= 20 THEN 'kept' ELSE 'moved' END"
    return A.chain("findings", f'SELECT doc_id, change, field_id, {outcome} AS outcome, code, s AS "start", e AS "end", new_code, ns AS new_start, ne AS new_end FROM taken FULL JOIN left_over USING (doc_id, change, field_id)', more, source)


def _drift_sql() -> str:
    old = f"CASE {' '.join(f'WHEN contains(text, {quoted(h)}) THEN {quoted(h)}' for h in survival.KNOWN_HEADINGS)} END"
    known = f"(SELECT doc_id, text, strpos(text, old) AS p, length(old) AS n FROM (SELECT doc_id, text, {old} AS old FROM ({_TIDIED})) WHERE old IS NOT NULL)"
    source = " UNION ALL ".join([f"SELECT '0:' || doc_id AS doc_id, text FROM {known}", *(f"SELECT '{i}:' || doc_id, substr(text, 1, p - 1) || {quoted(h)} || substr(text, p + n) FROM {known}" for i, h in enumerate(survival.OTHER_HEADINGS, 1))])
    more = (
        "held AS (SELECT doc_id, string_agg(DISTINCT feature, ',' ORDER BY feature) AS held FROM features GROUP BY doc_id)",
        "counted AS (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id)",
        f"made AS MATERIALIZED (SELECT {_OF(survival.OTHER_HEADINGS)}, held, n FROM (SELECT c.doc_id, coalesce(h.held, '') AS held, coalesce(k.n, 0) AS n FROM canon c LEFT JOIN held h ON h.doc_id = c.doc_id LEFT JOIN counted k ON k.doc_id = c.doc_id))",
    )
    return A.chain("findings", "SELECT b.doc_id, m.change AS heading, b.n AS findings, m.n AS new_findings, m.held = b.held AS same_profile, m.held = b.held AND m.n = b.n AS stable FROM made b JOIN made m ON m.doc_id = b.doc_id AND m.change <> 'unchanged' WHERE b.change = 'unchanged'", more, source)


def prompt_cte() -> tuple[str, ...]:
    heads = ", ".join(f"({quoted(f.field_id)}, {quoted(model.PROMPT.format(field=model.describe(f), parts=chr(0)).split(chr(0))[0])})" for f in STARTER)
    tail = quoted(model.PROMPT.split("{parts}")[1])
    flat = "trim(regexp_replace(body, '\\s+', ' ', 'g'))"
    return (
        f"ph AS (SELECT * FROM (VALUES {heads}) v(field_id, head))",
        f"bodies AS (SELECT s.doc_id, s.sub_idx, s.header, {flat} AS flat FROM (SELECT subs.*, substr(m.t, subs.s + 1, subs.e - subs.s) AS body FROM subs JOIN methods m USING (doc_id)) s)",
        f"parts AS (SELECT doc_id, count(*) AS n, string_agg((sub_idx + 1) || '. ' || header || CASE WHEN flat = '' THEN '' ELSE chr(10) || '   ' || CASE WHEN length(flat) <= 160 THEN flat ELSE regexp_replace(substr(flat, 1, 160), '(?s)^(.*) .*$', '\\1') || ' ...' END END, chr(10) ORDER BY sub_idx) AS list FROM bodies WHERE sub_idx < {model.MOST_OPTIONS} GROUP BY doc_id)",
        f"prompts AS (SELECT doc_id, field_id, n, head || list || {tail} AS p FROM parts CROSS JOIN ph WHERE n > 1)",
    )


_NODE = "SELECT n.doc_id, f.field_id, n.how, CAST(n.node AS BIGINT) AS node FROM nodes n JOIN fields f USING (category)"
_ANSWER = "([" + ", ".join("NULL" if a is None else quoted(a) for a in ANSWERS) + "])"
_PARSED = lambda a, n: f"CASE WHEN {a} IS NULL OR regexp_extract({a}, '\\d+') = '' THEN NULL WHEN CAST(regexp_extract({a}, '\\d+') AS BIGINT) = 0 THEN -1 WHEN CAST(regexp_extract({a}, '\\d+') AS BIGINT) <= {n} THEN CAST(regexp_extract({a}, '\\d+') AS BIGINT) - 1 END"
MODEL_NODE = f"SELECT n.doc_id, f.field_id, CASE WHEN n.how NOT LIKE 'node:det-first%' AND n.how <> 'node:det-none' THEN n.how WHEN a.answer IS NULL THEN 'node:model-error' || CASE WHEN n.node IS NULL THEN '' ELSE '-fellback' END WHEN a.i IS NULL THEN 'node:model-unparsed' WHEN a.i < 0 THEN 'node:model-whole-section' ELSE 'node:model-' || (a.i + 1) || 'of' || a.n END AS how, CAST(CASE WHEN n.how NOT LIKE 'node:det-first%' AND n.how <> 'node:det-none' OR a.i IS NULL THEN n.node WHEN a.i >= 0 THEN a.i END AS BIGINT) AS node FROM nodes n JOIN fields f USING (category) LEFT JOIN (SELECT doc_id, field_id, n, answer, {_PARSED('answer', 'n')} AS i FROM (SELECT *, {_ANSWER}[length(p) % {len(ANSWERS)} + 1] AS answer FROM prompts)) a ON a.doc_id = n.doc_id AND a.field_id = f.field_id"


def _model_cte() -> tuple[str, ...]:
    """The findings with anchors from the model's subsections, as mfound."""
    renamed = [c.replace("judged", "mjudged").replace("placed", "mplaced").replace("found AS", "mfound AS").replace("JOIN anchors", "JOIN manchors") for c in A._findings()]
    return (
        *prompt_cte(),
        f"mnodes AS MATERIALIZED (SELECT m.*, s.header AS title FROM ({MODEL_NODE}) m LEFT JOIN subs s ON s.doc_id = m.doc_id AND s.sub_idx = m.node)",
        "mlevels AS MATERIALIZED (SELECT s.doc_id, c.field_id, c.score, s.sent_idx, s.s + u.lead AS a, u.body, CASE WHEN s.scope = n.node THEN 0 WHEN s.scope = -1 THEN 1 WHEN s.scope = -2 THEN 2 END AS level FROM sents s JOIN scores c USING (st) JOIN usents u USING (st) JOIN mnodes n ON n.doc_id = s.doc_id AND n.field_id = c.field_id WHERE u.body <> '')",
        f"msure AS (SELECT doc_id, field_id, a, body, 'anchor:det-confident(score=' || score || '):no-model-call' AS detector FROM mlevels WHERE level = 1 QUALIFY row_number() OVER (PARTITION BY doc_id, field_id ORDER BY score DESC, sent_idx) = 1 AND score >= {audit.CONFIDENT})",
        "mbests AS (SELECT doc_id, field_id, 2 * level AS spot, a, body FROM mlevels WHERE level IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, field_id ORDER BY level, score DESC, sent_idx) = 1)",
        "mrungs AS (SELECT * FROM mbests UNION ALL SELECT n.doc_id, n.field_id, CASE WHEN h.scope = n.node THEN 1 WHEN h.scope = -1 THEN 3 ELSE 5 END, h.a, h.body FROM mnodes n JOIN heads h ON h.doc_id = n.doc_id AND (h.scope = n.node OR h.scope < 0))",
        "mchosen AS (SELECT r.doc_id, r.field_id, r.a, r.body, 'anchor:' || n.how || CASE WHEN r.spot % 2 = 0 THEN ':kw:' ELSE ':head:' END || CASE r.spot // 2 WHEN 0 THEN substr(n.title, 1, 34) WHEN 1 THEN 'methods' ELSE 'document' END AS detector FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_id ORDER BY spot) AS k FROM mrungs) r JOIN mnodes n ON n.doc_id = r.doc_id AND n.field_id = r.field_id WHERE r.k = 1)",
        "manchors AS MATERIALIZED (SELECT * FROM msure UNION ALL SELECT * FROM mchosen c WHERE NOT EXISTS (SELECT 1 FROM msure s WHERE s.doc_id = c.doc_id AND s.field_id = c.field_id))",
        *renamed,
    )


_REPORTS = f"SELECT c.doc_id, sha256(c.t) AS text_sha, {quoted(VERSION)} AS field_pack_version, coalesce(x.features, '') AS features, coalesce(y.findings, '') AS findings, coalesce(y.reasons, 0) AS reasons FROM canon c LEFT JOIN (SELECT doc_id, string_agg(DISTINCT feature, ',' ORDER BY feature) AS features FROM features GROUP BY doc_id) x ON x.doc_id = c.doc_id LEFT JOIN (SELECT doc_id, string_agg(field_id || ':' || code || ':' || finding_id, ',' ORDER BY field_ordinal) AS findings, count(reason) AS reasons FROM ({FOUND}) GROUP BY doc_id) y ON y.doc_id = c.doc_id"
TREE = "SELECT doc_id, '0' AS node_id, NULL AS parent_id, 'document' AS title, CAST(0 AS BIGINT) AS \"start\", CAST(length(t) AS BIGINT) AS \"end\" FROM methods UNION ALL SELECT doc_id, '0.0', '0', 'methods', m_start, m_end FROM methods UNION ALL SELECT doc_id, '0.0.' || sub_idx, '0.0', header, s, e FROM subs"
ORACLE_SQL = {
    "planted_reports": A.chain("findings", _REPORTS),
    "planted_model_findings": A.chain("findings", FOUND.replace("FROM found f", "FROM mfound f"), _model_cte()),
    "planted_evidence": A.chain("profile", "SELECT doc_id, CAST(m_start AS BIGINT) AS m_start, CAST(m_end AS BIGINT) AS m_end, " + ", ".join(f"(base + {k}.s) || ':' || (base + {k}.e) AS {k}" for k in (*A.FEATURES, "has_wet_lab")) + " FROM profiles"),
    "planted_tree": A.chain("sections", TREE),
    "planted_gate": A.chain("applicable", "SELECT doc_id, field_id, CAST(ord AS BIGINT) AS field_ordinal FROM applies"),
    "planted_sentences": A.chain("sentences", "SELECT doc_id, st AS sentence, CAST(scope AS BIGINT) AS scope, CAST(sent_idx AS BIGINT) AS sent_idx, s AS sent_start, e AS sent_end FROM sents"),
    "planted_candidates": A.chain("candidates", 'SELECT doc_id, field_id, detector, x AS raw_text, s AS "start", e AS "end" FROM obs'),
    "planted_verdicts": _on_all([], "SELECT x, field_id, verdict, code, value FROM typed"),
    "planted_triggers": _on_all(A.trigger_cte(), "SELECT x, field_id, code, text, family, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high FROM governed"),
    "planted_findings": A.chain("findings", FOUND),
    "planted_acceptance": A.chain("findings", "SELECT true AS legal, true AS located, true AS within, true AS known, true AS identified, true AS explained, true AS once_a_field, count(*) AS findings FROM found"),
    "planted_counts": A.chain("findings", "SELECT doc_id, count(*) AS applicable, count(f.code) AS findings, count(*) - count(f.code) AS ok, count(*) FILTER (WHERE f.verdict = 'FIELD_ABSENT') AS absent, count(*) FILTER (WHERE f.verdict = 'FIELD_UNRESOLVED') AS unresolved FROM applies LEFT JOIN found f USING (doc_id, field_id) GROUP BY doc_id"),
    "planted_histogram": A.chain("findings", "SELECT code, count(*) AS n FROM found GROUP BY code"),
    "planted_scoping": A.chain("findings", "SELECT doc_id, field_id, regexp_replace(st, '^\\s+|\\s+$', '', 'g') AS sentence, s AS \"start\" FROM (SELECT s.doc_id, c.field_id, s.st, s.s, row_number() OVER (PARTITION BY s.doc_id, c.field_id ORDER BY c.score DESC, s.sent_idx) AS r FROM sents s JOIN scores c USING (st) JOIN fields f USING (field_id) JOIN found x ON x.doc_id = s.doc_id AND x.field_id = c.field_id AND x.code = 'GAP_ABSENT' WHERE s.scope = -1 AND (f.type <> 'quantity' OR regexp_matches(s.st, '\\d'))) WHERE r = 1"),
    "planted_labels": A.chain(None, 'SELECT doc_id, field_id, code, outcome, CAST(ord AS BIGINT) AS ord, CAST(s AS BIGINT) AS "start", CAST(s + n AS BIGINT) AS "end" FROM out', _label_cte()),
    "planted_coverage": A.chain(None, "SELECT count(*) FILTER (WHERE outcome <> 'no_document') AS total, count(*) FILTER (WHERE outcome = 'resolved') AS resolved, count(*) FILTER (WHERE outcome = 'unresolved') AS unresolved, count(*) FILTER (WHERE outcome = 'no_anchor') AS no_anchor, count(*) FILTER (WHERE outcome = 'no_document') AS no_document, count(*) FILTER (WHERE blocking AND outcome = 'resolved') AS blocking, coalesce(bool_or(blocking IS NOT NULL), false) AS has_blocking FROM out", _label_cte()),
    "planted_label_mix": A.chain(None, "SELECT code, count(*) AS n FROM lab GROUP BY code", _label_cte()),
    "planted_scores": A.chain("findings", f"SELECT {_RATED}", (*_score_cte(), _BUCKETS, *_RATES)),
    "planted_slices": A.chain("findings", f"SELECT {_RATED}", (*_score_cte(), _SLICES, *_RATES)),
    "planted_noise": A.chain("findings", "SELECT count(*) AS emitted, count(*) FILTER (WHERE noisy) AS noise, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE noisy) / count(*) ELSE 0.0 END, 9) AS ratio FROM (SELECT NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = p.doc_id AND g.blocking AND abs(g.s - p.s) <= 20) AS noisy FROM p)", _score_cte()),
    "greedy_repeats": "WITH RECURSIVE p AS (SELECT doc_id AS d, k, (doc_id * 3 + k * 37) % 101 AS s FROM documents, range(0, 3) AS r(k)), w AS (SELECT doc_id AS d, (doc_id * 5) % 101 AS g0, (doc_id * 5 + 37) % 101 AS g1, 0 AS k, false AS t0, false AS t1 FROM documents UNION ALL SELECT w.d, g0, g1, w.k + 1, t0 OR abs(p.s - g0) <= 20, t1 OR (abs(p.s - g1) <= 20 AND (t0 OR abs(p.s - g0) > 20)) FROM w JOIN p ON p.d = w.d AND p.k = w.k WHERE w.k < 3) SELECT CAST(d AS VARCHAR) AS doc_id, CAST(t0 AS BIGINT) + CAST(t1 AS BIGINT) AS tp, 3 - CAST(t0 AS BIGINT) - CAST(t1 AS BIGINT) AS fp, 2 - CAST(t0 AS BIGINT) - CAST(t1 AS BIGINT) AS fn FROM w WHERE k = 3",
    "planted_panels": _panel_sql(),
    "planted_unknown": A.chain(None, "SELECT DISTINCT field_id FROM lab WHERE field_id NOT IN (SELECT field_id FROM fields)", _label_cte()),
    "planted_unreported": A.chain(None, "SELECT DISTINCT doc_id, doc_id NOT IN (SELECT doc_id FROM canon) AS missing FROM lab", _label_cte()),
    "planted_changes": _changes_sql(),
    "perturbation_survival": _survival_sql(),
    "heading_drift": _drift_sql(),
    "planted_nodes": A.chain("sections", _NODE),
    "planted_model_nodes": A.chain("sections", MODEL_NODE, prompt_cte()),
    "planted_prompts": A.chain("sections", "SELECT doc_id, field_id, sha256('512' || chr(31) || p) AS key FROM prompts JOIN fields USING (field_id) WHERE type = 'quantity'", prompt_cte()),
    "answer_index": f"SELECT doc_id, CAST({_PARSED('a', '(doc_id % 5)')} AS BIGINT) AS index FROM (SELECT doc_id, {_ANSWER}[doc_id % {len(ANSWERS)} + 1] AS a FROM documents)",
    "title_overlap": A.chain("sections", f"SELECT c.doc_id, arg_min(sub_idx, (-k, sub_idx)) AS node FROM canon c LEFT JOIN (SELECT doc_id, sub_idx, len(list_intersect(list_distinct(regexp_extract_all(lower(header), '[a-z]{{4,}}')), list_filter(regexp_extract_all(lower('Detail of the cell culture protocol and statistical treatment'), '[a-z]{{4,}}'), lambda w: NOT list_contains([{', '.join(map(quoted, model._COMMON))}], w)))) AS k FROM subs) s ON s.doc_id = c.doc_id GROUP BY c.doc_id"),
    "token_usage": "SELECT calls, i AS input_tokens, o AS output_tokens, i + o AS total, round((i + o) / 1000000000, 9) AS share, i + o >= 750000000 AS warned, i + o + 500 > 1000000000 AS refused, round(i / 1e6 * 5 + o / 1e6 * 25, 6) AS cost FROM (SELECT count(*) AS calls, CAST(sum(n_chars) AS BIGINT) AS i, CAST(sum(doc_id % 50) AS BIGINT) AS o FROM documents)",
    "run_configurations": "SELECT array_to_string(list_sort(list(DISTINCT '0.' || (doc_id % 3))), ',') AS field_pack_version, array_to_string(list_sort(list(DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'none' ELSE 'stand-in' END)), ',') AS model FROM documents",
}
