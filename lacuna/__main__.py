"""Command line: audit texts against a checklist, score reports against labels, place labels' passages.

python -m lacuna audit TEXTS OUT [--checklist FILE] [--lexicon FILE] [--each] [--model NAME --url URL [--cache FOLDER] [--budget TOKENS]]
python -m lacuna score REPORTS LABELS
python -m lacuna resolve LABELS TEXTS OUT
"""

from __future__ import annotations

import argparse
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.text import canonicalize
from lacuna.functions.triggers import STARTER_LEXICON
from lacuna.operators import audit, gold, score
from lacuna.operators.cache import path_for
from lacuna.operators.calls import BUDGET, Budget, Retry
from lacuna.plans.pack import STARTER, VERSION
from lacuna.sources import checklists, files
from lacuna.sources.client import HttpClient, read_env


def texts(spark: SparkSession, path: str) -> DataFrame:
    return canonicalize(files.read_texts(spark, path), "raw_text")


def flat(rows: DataFrame, array: str) -> DataFrame:
    """doc_id, field_id, code, start, blocking, ord of nested findings or labels that have a place."""
    listed = rows.select(F.col("stem").alias("doc_id"), F.posexplode(array).alias("ord", "x"))
    blocking = F.col("x.blocking") if array == "labels" else F.lit(None).cast("boolean")
    return listed.select("doc_id", "x.field_id", "x.code", F.col("x.span.start").alias("start"), blocking.alias("blocking"), "ord").where("start is not null")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lacuna", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, places in (("audit", ("texts", "out")), ("score", ("reports", "labels")), ("resolve", ("labels", "texts", "out"))):
        sub = commands.add_parser(name)
        for place in places:
            sub.add_argument(place)
        if name == "audit":
            sub.add_argument("--checklist")
            sub.add_argument("--lexicon")
            sub.add_argument("--each", action="store_true", help="one indented file a document")
            sub.add_argument("--model", help="a model that chooses where absent fields are anchored; its key is read from MODEL_API_KEY")
            sub.add_argument("--url", help="where the model is asked")
            sub.add_argument("--cache", default="cache", help="folder of the answers, shared by all executors")
            sub.add_argument("--budget", type=int, default=BUDGET, help="tokens that all calls may use together")
    args = parser.parse_args(argv)
    if args.command == "audit" and args.model and not args.url:
        parser.error("--model needs --url")
    spark = SparkSession.builder.getOrCreate()
    if args.command == "audit":
        version, pack = checklists.read_checklist(args.checklist) if args.checklist else (VERSION, STARTER)
        lexicon = checklists.read_lexicon(args.lexicon) if args.lexicon else STARTER_LEXICON
        asked = {}
        if args.model:
            read_env()
            asked = {"make": partial(HttpClient, args.url, args.model), "path": path_for(args.model, args.cache), "budget": Budget(args.budget), "retry": Retry(3)}
        made = audit.reports(texts(spark, args.texts), pack, lexicon, version, **asked)
        if args.each:
            files.write_each(made, args.out)
        else:
            files.write_reports(made, args.out)
        done = made if args.each else spark.read.schema(made.schema).json(args.out)
        done.select(F.explode("findings").alias("f")).groupBy("f.code").count().orderBy(F.desc("count"), "code").show(truncate=False)
    elif args.command == "score":
        pred, labels = flat(files.read_reports(spark, args.reports), "findings"), flat(files.read_labels(spark, args.labels), "labels")
        outcomes = score.match_greedy(pred, labels)
        score.rates(score.count_outcomes(outcomes)).orderBy("bucket").show(1000, truncate=False)
        score.rates(score.slices(outcomes)).orderBy("bucket").show(truncate=False)
        score.noise_ratio(pred, labels).show()
        gold.unreported(labels, pred).where("missing").show(1000, truncate=False)
    else:
        rows = files.read_labels(spark, args.labels).select("doc_id", F.explode("labels").alias("x")).select("doc_id", "x.field_id", "x.verdict", "x.code", "x.anchor_text", "x.blocking")
        placed = gold.resolve_labels(rows, texts(spark, args.texts))
        files.write_labels(placed, args.out)
        gold.coverage(spark.read.schema(placed.schema).json(args.out)).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
