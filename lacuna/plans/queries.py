"""The engine's registered queries and the equal DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import text as T
from lacuna.functions import verdicts as V
from lacuna.operators import anchors, audit, cache, profile, retrieve, score, sections, structure
from lacuna.plans import audit_sql as A
from lacuna.plans import planted_queries, shaped
from lacuna.plans.pack import STARTER, keyword_frame, pack_frame
from lacuna.sources.shared import written

ALWAYS = tuple(f for f in STARTER if not f.all_of and not f.any_of)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.canonicalize(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text")).drop("text")


def canonicalize_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "text_sha", F.length("canonical_text").cast("long").alias("n"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sentences(_docs(spark, sf_dir)).select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), "sentence")


def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.running_headers(_docs(spark, sf_dir)).select("doc_id", "key", "hits", F.round("mean_gap", 6).alias("mean_gap"))


def applicable_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles planted by doc_id: features follow from its remainders."""
    n = F.col("doc_id").cast("long")
    features = F.create_map(*(x for name, k in (("has_animals", 2), ("has_cell_lines", 3), ("has_wet_lab", 5), ("has_ihc", 7)) for x in (F.lit(name), n % k == 0)))
    profiles = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id")).withColumn("features", features)
    return retrieve.applicable(profiles, pack_frame(spark)).select("doc_id", F.col("field_ordinal").cast("long").alias("field_ordinal"), "field_id")


def keyword_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.ranked_candidates(_docs(spark, sf_dir)).select("doc_id", "field_id", *(F.col(c).cast("long").alias(c) for c in ("score", "sent_idx", "rank")))


def absence_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Always-on fields without a keyword candidate, anchored and identified."""
    docs = written(_docs(spark, sf_dir), "texts")
    hit = retrieve.ranked_candidates(docs, ALWAYS).where("rank = 1").select("doc_id", "field_id")
    found = retrieve.absence_anchors(docs, ALWAYS).join(hit, ["doc_id", "field_id"], "anti").join(docs.select("doc_id", "text_sha"), "doc_id")
    code = F.lit("GAP_ABSENT")
    return found.select("doc_id", "field_id", code.alias("code"), F.col("anchor_start").cast("long").alias("anchor_start"), F.col("anchor_end").cast("long").alias("anchor_end"), T.finding_id(F.col("doc_id"), F.col("text_sha"), F.col("anchor_start"), F.col("anchor_end"), F.col("field_id"), code).alias("finding_id"))


def finding_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select("doc_id", T.finding_id(F.col("doc_id"), F.col("text_sha"), F.lit(0), F.length("canonical_text"), F.lit("stats.test_named"), F.lit("GAP_ABSENT")).alias("finding_id"))


def anchor_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("anchor_id"), T.tidy(F.col("text")).alias("anchor_text"))
    return anchors.resolve_anchors(_docs(spark, sf_dir), items)


def anchor_resolve_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same items with a line end for each blank, which stand in the texts with other white space."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("anchor_id"), F.regexp_replace(T.tidy(F.col("text")), " ", "\n").alias("anchor_text"))
    return anchors.resolve_anchors(_docs(spark, sf_dir), items, loose=True)


def _planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings and labels planted from doc_id, a pair a document, their starts up to 30 apart."""
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    field = F.when(F.col("doc_id") % 2 == 0, "stats.test_named").otherwise("stats.replicate_type")
    gold = n.where("doc_id % 11 <> 0").select(F.col("doc_id").cast("string").alias("doc_id"), field.alias("field_id"), F.lit("GAP_ABSENT").alias("code"), F.lit(100).alias("start"), F.lit(0).alias("ord"), (F.col("doc_id") % 3 == 0).alias("blocking"))
    pred = n.select(F.col("doc_id").cast("string").alias("doc_id"), field.alias("field_id"), F.when(F.col("doc_id") % 5 == 0, "GAP_VAGUE").otherwise("GAP_ABSENT").alias("code"), (100 + F.col("doc_id") % 31).cast("int").alias("start"), F.lit(0).alias("ord"))
    return pred, gold


def _rounded(df: DataFrame) -> DataFrame:
    return score.rates(df).select("bucket", "tp", "fp", "fn", "support", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def score_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(score.count_outcomes(score.match_single(*_planted(spark, sf_dir))))


def score_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(score.count_outcomes(score.match_greedy(*_planted(spark, sf_dir))))


def score_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(score.slices(score.match_single(*_planted(spark, sf_dir))))


def fpr_nonblocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.noise_ratio(*_planted(spark, sf_dir)).select("emitted", "noise", F.round("ratio", 9).alias("ratio"))


def code_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planted(spark, sf_dir)[0].groupBy("code").agg(F.count("*").alias("n"))


def field_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_frame(spark).groupBy("field_id").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", cache.cache_key(F.coalesce("text", F.lit("")), F.lit(1024)).alias("key"))
    old = rows.where("doc_id % 2 = 0").select("key", F.lit("1").alias("response"))
    merged = cache.upsert(old, rows.where("doc_id % 3 = 0").select("key", F.lit("1").alias("response")))
    return cache.stats(cache.lookup(rows, merged))


def missing_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, gold = _planted(spark, sf_dir)
    return pred.join(gold, "doc_id", "anti").select("doc_id")


def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a named test and of replicates in each document's text."""
    replicates = next(f for f in ALWAYS if f.type == "enum").enum_values
    return _docs(spark, sf_dir).select("doc_id", V.relevant(F.col("canonical_text"), "stats.test_named").alias("test_named"), V.enum_value(F.col("canonical_text"), replicates).alias("replicates"))


def quantity_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quantity field against each sentence: how many sentences have which verdict and code."""
    fields = [f for f in STARTER if f.type == "quantity"]
    found = F.array(*(F.struct(F.lit(f.field_id).alias("field_id"), V.verdict(F.col("sentence"), f).alias("v")) for f in fields))
    # equal sentences are judged once, and so are all that can't state a quantity
    distinct = T.sentences(_docs(spark, sf_dir)).groupBy(F.when(V.may_state(F.col("sentence")), F.col("sentence")).otherwise(F.lit("")).alias("sentence")).agg(F.count("*").alias("n"))
    flat = distinct.select("n", F.explode(found).alias("x")).select("x.field_id", "x.v.verdict", "x.v.code", "n")
    return flat.groupBy("field_id", "verdict", "code").agg(F.sum("n").alias("n"))


def study_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's methods window and its features, with the first evidence of each."""
    found = profile.study_profiles(_docs(spark, sf_dir))
    return found.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("m_start", "m_end")), F.to_json("features").alias("features"), F.to_json("evidence").alias("evidence"))


def subsection_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.subsections(profile.with_methods(_docs(spark, sf_dir))).select("doc_id", "header", *(F.col(c).cast("long").alias(c) for c in ("sub_idx", "start", "end")))


def gap_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole audit by the starter checklist."""
    return planted_queries.told(audit.findings(_docs(spark, sf_dir)))


_NAMES = (study_profile, subsection_tree, gap_findings, relevance_gate, quantity_verdict, canonicalize_sha, sentence_split, running_headers, applicable_fields, keyword_rank, absence_findings, finding_id, anchor_resolve, anchor_resolve_loose, score_buckets, score_greedy, score_slice, fpr_nonblocking, code_histogram, field_keywords, cache_stats, missing_docs)
QUERIES = {f.__name__: f for f in _NAMES} | planted_queries.QUERIES | shaped.QUERIES

_CANON = r"""canon AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), '[ \t\x{00a0}]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)"""
_PLANTED = """p AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 'stats.test_named' ELSE 'stats.replicate_type' END AS field_id, CASE WHEN doc_id % 5 = 0 THEN 'GAP_VAGUE' ELSE 'GAP_ABSENT' END AS code, 100 + doc_id % 31 AS start FROM documents),
g AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 'stats.test_named' ELSE 'stats.replicate_type' END AS field_id, 'GAP_ABSENT' AS code, 100 AS start, doc_id % 3 = 0 AS blocking FROM documents WHERE doc_id % 11 <> 0),
o AS (SELECT coalesce(p.field_id, g.field_id) AS field_id, 'tp' AS outcome, p.code FROM p JOIN g ON p.doc_id = g.doc_id AND p.field_id = g.field_id AND p.code = g.code AND abs(p.start - g.start) <= 20
UNION ALL SELECT p.field_id, 'fp', p.code FROM p JOIN g ON p.doc_id = g.doc_id WHERE NOT (p.code = g.code AND abs(p.start - g.start) <= 20)
UNION ALL SELECT g.field_id, 'fn', g.code FROM p JOIN g ON p.doc_id = g.doc_id WHERE NOT (p.code = g.code AND abs(p.start - g.start) <= 20))"""
_RATES = """, c AS (SELECT bucket, count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'fn') AS fn FROM b GROUP BY bucket),
r AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r1 FROM c)
SELECT bucket, tp, fp, fn, support, round(p1, 9) AS precision, round(r1, 9) AS recall, round(CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END, 9) AS f1 FROM r"""
_BUCKETS = f"WITH {_PLANTED}, b AS (SELECT field_id AS bucket, outcome FROM o UNION ALL SELECT 'code:' || code, outcome FROM o UNION ALL SELECT 'ALL', outcome FROM o){_RATES}"
# RE2 takes the evidence patterns as they are.
_EVIDENCE = " OR ".join(f"regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}', '{'i' if ci else 'c'}')" for p, ci in V.EVIDENCE["stats.test_named"])
_VALUES = " ".join(f"WHEN regexp_matches(t, '\\b{v}\\b', 'i')" + "".join(f" OR regexp_matches(t, '{p}', 'i')" for p in V.SURFACE.get(v, ())) + f" THEN '{v}'" for v in ("biological", "technical", "both"))
ORACLE_SQL = {
    "relevance_gate": f"WITH {_CANON} SELECT doc_id, {_EVIDENCE} AS test_named, CASE {_VALUES} END AS replicates FROM canon",
    "canonicalize_sha": f"WITH {_CANON} SELECT doc_id, sha256(t) AS text_sha, length(t) AS n FROM canon",
    "sentence_split": rf"WITH {_CANON}, s AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?])\s+([A-Z(])', '\1' || chr(30) || '\2', 'g'), chr(30)) AS a FROM canon) SELECT doc_id, CAST(i - 1 AS BIGINT) AS sent_idx, a[i] AS sentence FROM s, unnest(range(1, len(a) + 1)) AS u(i)",
    "finding_id": f"WITH {_CANON} SELECT doc_id, substr(sha256(concat_ws(chr(31), doc_id, sha256(t), '0', CAST(length(t) AS VARCHAR), 'stats.test_named', 'GAP_ABSENT')), 1, 32) AS finding_id FROM canon",
    "score_buckets": _BUCKETS,
    "score_greedy": _BUCKETS,
    "score_slice": f"WITH {_PLANTED}, b AS (SELECT CASE WHEN code = 'GAP_ABSENT' THEN 'ABSENT' ELSE 'PRESENT_BUT_UNUSABLE' END AS bucket, outcome FROM o){_RATES}",
    "fpr_nonblocking": f"WITH {_PLANTED}, e AS (SELECT count(*) AS emitted, count(*) FILTER (WHERE NOT (g.blocking AND abs(p.start - g.start) <= 20)) AS noise FROM p JOIN g ON p.doc_id = g.doc_id) SELECT emitted, noise, round(CASE WHEN emitted > 0 THEN noise / emitted ELSE 0.0 END, 9) AS ratio FROM e",
    "code_histogram": f"WITH {_PLANTED} SELECT code, count(*) AS n FROM p GROUP BY code",
    "missing_docs": f"WITH {_PLANTED} SELECT doc_id FROM p WHERE doc_id NOT IN (SELECT doc_id FROM g)",
    "cache_stats": "WITH k AS (SELECT doc_id, sha256('1024' || chr(31) || coalesce(text, '')) AS key FROM documents), m AS (SELECT DISTINCT key FROM k WHERE doc_id % 2 = 0 OR doc_id % 3 = 0), s AS (SELECT count(*) FILTER (WHERE m.key IS NOT NULL) AS hits, count(*) FILTER (WHERE m.key IS NULL) AS misses FROM k LEFT JOIN m ON k.key = m.key) SELECT hits, misses, CASE WHEN hits + misses > 0 THEN printf('%.3f', hits / (hits + misses)) ELSE 'n/a' END AS hit_rate FROM s",
    "anchor_resolve": f"WITH {_CANON}, q AS (SELECT item_id AS anchor_id, regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS a FROM benchmark) SELECT doc_id, anchor_id, CAST(strpos(t, a) - 1 AS BIGINT) AS start, CAST(strpos(t, a) - 1 + length(a) AS BIGINT) AS \"end\" FROM canon, q WHERE a <> '' AND strpos(t, a) > 0",
    "anchor_resolve_loose": f"WITH {_CANON}, q AS (SELECT item_id AS anchor_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: regexp_escape(w)), '\\s+') AS rx FROM benchmark), h AS (SELECT doc_id, anchor_id, t, regexp_extract(t, rx) AS m FROM canon, q WHERE rx <> '' AND regexp_matches(t, rx)) SELECT doc_id, anchor_id, CAST(strpos(t, m) - 1 AS BIGINT) AS start, CAST(strpos(t, m) - 1 + length(m) AS BIGINT) AS \"end\" FROM h",
    "running_headers": rf"WITH {_CANON}, l AS (SELECT doc_id, string_split(t, chr(10)) AS a FROM canon), x AS (SELECT doc_id, i, a[i] AS line FROM l, unnest(range(1, len(a) + 1)) AS u(i)), y AS (SELECT doc_id, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM x), k AS (SELECT doc_id, regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\d+', '#', 'g') AS key, s FROM y), z AS (SELECT doc_id, key, s - lag(s) OVER (PARTITION BY doc_id, key ORDER BY s) AS gap FROM k WHERE key <> ''), h AS (SELECT doc_id, key, count(*) AS hits, avg(gap) AS m, stddev_pop(gap) AS d FROM z GROUP BY doc_id, key) SELECT doc_id, key, hits, round(m, 6) AS mean_gap FROM h WHERE hits >= 3 AND m > 0 AND d <= 0.35 * m",
}

_ON_DOCS = ("scopes AS (SELECT doc_id, -2 AS scope, 'document' AS header, 0 AS base, t AS body FROM canon)", *A.sentence_cte("scopes"))
_SCORED = (*_ON_DOCS, "low AS MATERIALIZED (SELECT *, lower(st) AS w, regexp_replace(st, '^\\s+|\\s+$', '', 'g') AS body, length(regexp_extract(st, '^\\s*')) AS lead FROM sents)", "scores AS MATERIALIZED (SELECT s.doc_id, k.field_id, s.sent_idx, s.st, s.s, s.body, s.lead, sum(k.weight) AS score FROM low s JOIN keywords k ON contains(s.w, k.kw) GROUP BY ALL)")
_RANKED = "SELECT doc_id, field_id, CAST(score AS BIGINT) AS score, CAST(sent_idx AS BIGINT) AS sent_idx, row_number() OVER (PARTITION BY doc_id, field_id ORDER BY score DESC, sent_idx) AS rank FROM scores JOIN fields USING (field_id) WHERE type <> 'quantity' OR regexp_matches(st, '\\d')"
_SPAN = lambda k: f"'\"{k}\":{{\"start\":' || (base + {k}.s) || ',\"end\":' || (base + {k}.e) || '}}'"
_EVERY = (*A.FEATURES, "has_wet_lab")
_GATES = "features AS (" + " UNION ALL ".join(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, '{name}' AS feature FROM documents WHERE doc_id % {k} = 0" for name, k in (("has_animals", 2), ("has_cell_lines", 3), ("has_wet_lab", 5), ("has_ihc", 7))) + ")"
_ABSENT = (
    "best AS (SELECT doc_id, field_id, s + lead AS a, body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field_id ORDER BY score DESC, sent_idx) AS r FROM scores WHERE body <> '') WHERE r = 1)",
    "head AS (SELECT doc_id, s + lead AS a, body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) AS r FROM low WHERE length(body) >= 10 AND regexp_matches(body, '[A-Za-z]{3,}')) WHERE r = 1)",
    f"ranked AS ({_RANKED})",
    "free AS (SELECT field_id FROM fields WHERE field_id NOT IN (SELECT field_id FROM gates))",
    "looked AS (SELECT c.doc_id, c.t, free.field_id, coalesce(b.a, h.a) AS a, coalesce(b.body, h.body) AS body FROM canon c CROSS JOIN free LEFT JOIN best b ON b.doc_id = c.doc_id AND b.field_id = free.field_id LEFT JOIN head h ON h.doc_id = c.doc_id WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.doc_id = c.doc_id AND r.field_id = free.field_id))",
)
_QUANTITIES = (*_ON_DOCS, "many AS MATERIALIZED (SELECT st AS x, count(*) AS n FROM sents GROUP BY st)", "pairs AS (SELECT x, field_id FROM many CROSS JOIN fields WHERE type = 'quantity')", *A.typed_cte("pairs"))
ORACLE_SQL |= planted_queries.ORACLE_SQL | shaped.ORACLE_SQL | {
    "field_keywords": A.chain(None, "SELECT field_id, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM keywords GROUP BY field_id"),
    "keyword_rank": A.chain(None, _RANKED, _SCORED, A.DOCUMENTS),
    "applicable_fields": A.chain(None, "SELECT doc_id, CAST(ord AS BIGINT) AS field_ordinal, field_id FROM applies", (_GATES, "canon2 AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents)", A.applicable_cte("canon2")), A.DOCUMENTS),
    "absence_findings": A.chain(None, "SELECT doc_id, field_id, 'GAP_ABSENT' AS code, CAST(a AS BIGINT) AS anchor_start, CAST(a + length(body) AS BIGINT) AS anchor_end, substr(sha256(concat_ws(chr(31), doc_id, sha256(t), CAST(CAST(a AS BIGINT) AS VARCHAR), CAST(CAST(a + length(body) AS BIGINT) AS VARCHAR), field_id, 'GAP_ABSENT')), 1, 32) AS finding_id FROM looked WHERE a IS NOT NULL", (*_SCORED, *_ABSENT), A.DOCUMENTS),
    "study_profile": A.chain("profile", "SELECT doc_id, CAST(m_start AS BIGINT) AS m_start, CAST(m_end AS BIGINT) AS m_end, '{' || " + " || ',' || ".join(f"'\"{k}\":' || CASE WHEN {k} IS NULL THEN 'false' ELSE 'true' END" for k in _EVERY) + " || '}' AS features, '{' || concat_ws(',', " + ", ".join(f"CASE WHEN {k} IS NOT NULL THEN {_SPAN(k)} END" for k in _EVERY) + ") || '}' AS evidence FROM profiles", (), A.DOCUMENTS),
    "subsection_tree": A.chain("sections", 'SELECT doc_id, header, sub_idx, s AS "start", e AS "end" FROM subs', (), A.DOCUMENTS),
    "gap_findings": A.chain("findings", planted_queries.FOUND, (), A.DOCUMENTS),
    "quantity_verdict": A.chain(None, "SELECT field_id, verdict, code, CAST(sum(n) AS BIGINT) AS n FROM typed JOIN many USING (x) GROUP BY field_id, verdict, code", _QUANTITIES, A.DOCUMENTS),
}
