"""Queries over documents of unusual shape: running heads, page furniture, clauses that look like headings, more parts than
a prompt lists, ranges in words, and texts that are hardly texts; with the equal SQL.

A shaped document is put together like a planted one, and the document's own whole text follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import text as T
from lacuna.operators import audit, degenerate, model, profile, sections
from lacuna.plans import audit_sql as A
from lacuna.plans import planted_queries as P
from lacuna.plans.pack import STARTER
from lacuna.plans.planted import planted, planted_sql, quoted
from lacuna.sources.shared import written

_LINE = "The plain line of words was written to widen the window. "
_RUNNING = "".join(f"Journal of Plain Lines\n{_LINE * 2}{w}.\n" for w in ("Ants", "Bees", "Cats", "Dogs"))
_UNEVEN = "".join(f"Protocol and assay\n{_LINE * n}\n" for n in (1, 9, 2, 25))
_FURNITURE = f"Cancers 2021, 13, 1234 5 of 20\n{_LINE}\nCell culture\nCells were kept. {_LINE * 4}\nCancers 2021, 13, 1234 16 of 20\n{_LINE * 2}\n"
_CLAUSES = f"ABC Smith lab\n{_LINE}\nPage 1234\n{_LINE}\nCells were grown\n{_LINE}\nBriefly spun down\n{_LINE}\nAfter the wash\n{_LINE}\nDrug treatment\n{_LINE * 2}\n"
_PARTS = "".join(f"{'Cell culture' if i % 7 else 'Antibody'} step {chr(65 + i)}{chr(97 + i % 5)}\nWork {chr(97 + i)} was done. \n" for i in range(26)) + f"Statistical analysis\n{_LINE * 2}\nStatistics and protocol analysis\n{_LINE}\nAssay protocol\n{_LINE}\n"
SEGMENTS = (
    (1, ("A study of shapes\n\n", "")),
    (1, ("Materials and Methods\n", "2. Methods:\n", "Online Methods\n")),
    (1, (_RUNNING, _UNEVEN, _FURNITURE, _CLAUSES, _PARTS)),
    (5, ("Animals\n", "Drug reagents\n", "Cell culture\n", "")),
    (
        1,
        (
            "Samples were spun between 5000 and 6000 × g. Mice were kept from 20 to 25 °C. ",
            "The culture temperature was from 36 to 38 C. Cells were treated between 5 and 10 µM for a duration of 24 h. ",
            "Mice were injected subcutaneously. The tumor volume was between 100 and 50 mm3. ",
            "The culture ran from 2 to 3 days at a temperature of 37 °C. ",
        ),
    ),
    (3, ("\nResults\nMice were seen.\n", "\nReferences\n", "\n\n")),
)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.canonicalize(planted(spark, sf_dir, SEGMENTS, own=True)).drop("text")


def shaped_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of documents whose headings recur evenly or unevenly, or are furniture or clauses and so no headings."""
    docs = profile.with_methods(_docs(spark, sf_dir))
    return sections.tree(docs, sections.subsections(docs)).select("doc_id", "node_id", "parent_id", "title", *(F.col(c).cast("long").alias(c) for c in ("start", "end")))


def shaped_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.told(audit.findings(_docs(spark, sf_dir)))


def shaped_model_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts chosen by the stand-in client; a fifth of the documents has more parts than a prompt lists."""
    docs = written(profile.with_methods(_docs(spark, sf_dir)).select("doc_id", "canonical_text", "m_start", "m_end"), "methods")
    return model.choose_nodes(sections.listed(docs, sections.subsections(docs)), STARTER, P.StandIn).select("doc_id", "field_id", "how", F.col("node").cast("long").alias("node"))


def degenerate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found in each kind of degenerate text made of each document's whole text."""
    return degenerate.report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (shaped_tree, shaped_findings, shaped_model_nodes, degenerate_report)}

_KINDS = {
    "empty": "''",
    "blank": "'   ' || chr(10) || chr(10) || chr(9) || '  ' || chr(10)",
    "heading": "'MATERIALS AND METHODS'",
    "scripts": f"repeat({quoted('МЕТОДЫ 実験方法 ◦µ× ')}, 30)",
    "line": r"'Methods ' || regexp_replace(text, '[\r\n]+', ' ', 'g')",
    "token": r"regexp_replace(text, '\s+', '', 'g')",
}
_DEGENERATE = " UNION ALL ".join(f"SELECT doc_id || ':{kind}' AS doc_id, {made} AS text FROM documents WHERE text IS NOT NULL" for kind, made in _KINDS.items())
_REPORT = (
    'per AS (SELECT c.doc_id, count(f.s) AS findings, count(*) FILTER (WHERE f.e <= f.s) AS empty_spans, count(*) FILTER (WHERE f.s < 0 OR f.e > length(c.t)) AS outside FROM canon c LEFT JOIN found f USING (doc_id) GROUP BY c.doc_id)',
)
_SOURCE = planted_sql(SEGMENTS, own=True)
ORACLE_SQL = {
    "shaped_tree": A.chain("sections", P.TREE, (), _SOURCE),
    "shaped_findings": A.chain("findings", P.FOUND, (), _SOURCE),
    "shaped_model_nodes": A.chain("sections", P.MODEL_NODE, P.prompt_cte(), _SOURCE),
    "degenerate_report": A.chain("findings", "SELECT string_split(doc_id, ':')[2] AS kind, count(*) AS documents, count(*) FILTER (WHERE findings > 0) AS with_findings, CAST(sum(findings) AS BIGINT) AS findings, CAST(sum(empty_spans) AS BIGINT) AS empty_spans, CAST(sum(outside) AS BIGINT) AS outside FROM per GROUP BY 1", _REPORT, _DEGENERATE),
}
