"""Readers and writers of texts, labels and reports."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.sources.each import FORMAT, JsonFiles

# The files' JSON forms.
SPAN = "struct<start:int,end:int,text_sha:string>"
FINDING = f"struct<finding_id:string,field_id:string,code:string,span:{SPAN},verdict:string,raw_text:string,canonical_value:string,canonical_unit:string,sensitivity:string,detail:map<string,string>>"
REPORT = f"doc_id string, text_sha string, contract_version string, field_pack_version string, profile struct<features:map<string,boolean>,evidence:map<string,{SPAN}>>, findings array<{FINDING}>"
LABELS = f"doc_id string, text_sha string, profile map<string,boolean>, labels array<struct<field_id:string,verdict:string,code:string,anchor_text:string,span:{SPAN},blocking:boolean>>"


def _stem():
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (file name without its ending), raw_text of every .txt file."""
    return spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(_stem().alias("doc_id"), F.col("value").alias("raw_text"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports, one JSON document a file, with stem (the file's name)."""
    return spark.read.schema(REPORT).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).select("*", _stem().alias("stem"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files below path; files without labels are passed over."""
    read = spark.read.schema(LABELS).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return read.select("*", _stem().alias("stem")).where(F.size("labels") > 0)


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.json(path)


def read_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str | None]], pattern: str = "*.pdf", skip_empty: bool = False) -> DataFrame:
    """doc_id, raw_text of paged files, one a row; extract gives the pages' texts of a file's bytes.

    Pages are joined by line ends, a page without text as an empty one; with skip_empty such pages are left out and each
    page has its own line end. No extractor is built in: PDF libraries aren't part of the environment.
    """

    def texts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            pages = [extract(bytes(content)) for content in part["content"]]
            joined = ["".join(f"{p}\n" for p in ps if p) if skip_empty else "\n".join(p or "" for p in ps) for ps in pages]
            yield pd.DataFrame({"doc_id": part["doc_id"], "raw_text": joined})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(_stem().alias("doc_id"), "content").mapInPandas(texts, "doc_id string, raw_text string")


def write_each(rows: DataFrame, path: str, name: str = "doc_id") -> int:
    """One indented JSON file a row, named by a column, for readers that want files; how many. Tasks write them, see each.py."""
    rows.sparkSession.dataSource.register(JsonFiles)
    rows.select(F.col(name).cast("string").alias("name"), F.to_json(F.struct(*rows.columns)).alias("json")).write.format(FORMAT).mode("append").save(path)
    with open(os.path.join(path, "_SUCCESS"), encoding="utf-8") as f:
        return int(f.read())


def write_labels(labels: DataFrame, path: str) -> None:
    """Labels with their spans, as read_labels reads them."""
    labels.write.json(path)


def write_panel(panel: DataFrame, path: str, titles: list[str]) -> None:
    """A text file of score rows (a few a panel) under their titles, in order of the title columns and bucket."""
    rows = panel.orderBy(*titles, "bucket").collect()
    names = [c for c in panel.columns if c not in titles]
    lines, last = [], None
    for r in rows:
        if (title := tuple(r[t] for t in titles)) != last:
            lines += ["", " / ".join(map(str, title)), "  ".join(names)]
            last = title
        lines.append("  ".join(f"{r[n]:.3f}" if isinstance(r[n], float) else str(r[n]) for n in names))
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines[1:]) + "\n")
