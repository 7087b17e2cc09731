"""WARC derivative builder: responses become linked metadata and plain-text conversion records.

A response record has an identifier (urn:uuid), target URI, date, HTTP header and payload. For each one the builder gives
a conversion record (text/plain, the extracted main text) and a metadata record (application/warc-fields: title, language,
out-links, sizes and the source's HTTP headers). Both carry WARC-Refers-To with the response's identifier, the target URI
and date of the source, and digests of their own; the metadata also lists the source's digests and the conversion's
identifier. Their own date, which every record must have, is a parameter, as the time of a run would make runs differ.
Identifiers are name-based UUIDs of the source's identifier and the record type, so a repeated run gives the same ones.

Cases: a null payload counts as empty; a null URI gives records without WARC-Target-URI; null dates are left out; equal
rows give equal records, once a row; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import arrow_map
from lacuna.llm.html_extract import main_text

_END = "\r\n"
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
_LANG = re.compile(r"<html[^>]*?\slang\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<a\s[^>]*?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Identifiers of all records come from this name space.
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: The derived records' date where none is given.
MADE = "2000-01-01T00:00:00Z"
DERIVED = "doc_id {0}, url string, response_id string, metadata_id string, conversion_id string, refers_to string, source_block_digest string, source_payload_digest string, conversion_digest string, metadata_digest string, conversion_length long, metadata_length long, text string, metadata string, conversion_record string, metadata_record string"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: object) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, '\x1f'.join(map(str, names)))}"


def record(kind: str, identifier: str, block: bytes, content_type: str, more: list[tuple[str, str | None]]) -> str:
    """A whole record without the two line ends that close it."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{identifier}>"), *more, ("WARC-Block-Digest", sha1(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return "WARC/1.1" + _END + "".join(f"{k}: {_line(v)}{_END}" for k, v in head if v is not None) + _END + block.decode("utf-8", "surrogateescape")


def _line(value: str) -> str:
    return " ".join(value.split())


def responses_from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> DataFrame:
    """Response records (doc_id, url, response_id, date, http_header, payload) of stored pages."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    name = F.sha2(F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit("")), payload).cast("binary"), 256)
    uid = F.concat(F.lit("urn:uuid:"), F.concat_ws("-", name.substr(1, 8), name.substr(9, 4), F.concat(F.lit("5"), name.substr(14, 3)), F.concat(F.lit("8"), name.substr(18, 3)), name.substr(21, 12)))
    return pages.select(F.col(id_col).alias("doc_id"), F.col(url_col).alias("url"), uid.alias("response_id"), F.lit(date).cast("string").alias("date"), header.alias("http_header"), payload.alias("payload"))


def derive_row(doc_id, url, response_id, date, http_header, payload, made: str = MADE) -> tuple:
    header, payload = http_header or "", payload or ""
    block_digest, payload_digest = sha1((header + payload).encode()), sha1(payload.encode())
    text = main_text(payload)
    conversion_id, metadata_id = record_id(response_id, "conversion"), record_id(response_id, "metadata")
    source = [("WARC-Target-URI", url), ("WARC-Date", made), ("WARC-Refers-To", f"<{response_id}>"), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date)]
    body = text.encode()
    conversion = record("conversion", conversion_id, body, "text/plain; charset=utf-8", [*source, ("WARC-Payload-Digest", sha1(body))])
    title, lang = _TITLE.search(payload), _LANG.search(payload)
    fields = [("response-block-digest", block_digest), ("response-payload-digest", payload_digest), ("conversion-record-id", f"<{conversion_id}>"), ("title", title and title[1]), ("language", lang and lang[1]), ("payload-bytes", str(len(payload.encode()))), ("text-chars", str(len(text)))]
    fields += [(f"source-{k.strip().lower()}", v.strip()) for k, s, v in (x.partition(":") for x in header.split(_END)[1:]) if s]
    fields += [("outlink", next(filter(None, m.groups()), "")) for m in _LINK.finditer(payload)]
    meta = "".join(f"{k}: {_line(v)}{_END}" for k, v in fields if v is not None)
    metadata = record("metadata", metadata_id, meta.encode(), "application/warc-fields", [*source, ("WARC-Concurrent-To", f"<{conversion_id}>")])
    return doc_id, url, response_id, metadata_id, conversion_id, response_id, block_digest, payload_digest, sha1(body), sha1(meta.encode()), len(body), len(meta.encode()), text, meta, conversion, metadata


def derive(responses: DataFrame, made: str = MADE) -> DataFrame:
    """One row a response, its derived records dated made: identifiers, links, digests, texts and the two records."""
    kind = responses.schema["doc_id"].dataType.simpleString()
    names = [c.split()[0] for c in DERIVED.split(", ")]
    inputs = ["doc_id", "url", "response_id", "date", "http_header", "payload"]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [derive_row(*r, made) for r in zip(*(batch.column(c).to_pylist() for c in inputs), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            kinds = [batch.column("doc_id").type, *(pa.int64() if n.endswith("_length") else pa.string() for n in names[1:])]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        return step

    return arrow_map(responses.select(*inputs), make, DERIVED.format(kind))


def write_warc(derived: DataFrame, path: str, compression: str = "none") -> None:
    """Record files: each conversion followed by its metadata. The line end of Spark's text writer is a record's end.

    Compressed files are one gzip member each, which readers that go from record to record can't enter midway; so the
    default is none.
    """
    records = derived.select(F.explode(F.array("conversion_record", "metadata_record")).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


#: The type given to what is no whole record.
MALFORMED = "malformed"


def parse_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record. One without a version line, a length or all its bytes comes as MALFORMED with its bytes as they are, up to the next version line; header bytes that aren't UTF-8 are replaced."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(end, at)].decode("utf-8", "replace").split(_END)
        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = next((v for k, v in fields.items() if k.lower() == "content-length"), "")
        stop = end + 4 + int(size) if size.isascii() and size.isdigit() else -1
        if lines[0].startswith("WARC/") and at < end < stop + 1 <= len(data) + 1:
            out.append((fields, data[end + 4 : stop]))
            at = stop + 4
        else:
            after = data.find(b"\r\n\r\nWARC/", at)
            rest = data[at : after if after >= 0 else len(data)]
            if rest.strip():
                out.append(({"WARC-Type": MALFORMED}, rest))
            at = after + 4 if after >= 0 else len(data)
    return out


def read_warc(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """type, record_id, refers_to, target_uri, date, content_type, block_digest, block of the records in uncompressed or gzip files (of one member or many); a file is read by one task. Records that can't be read have the type MALFORMED and their bytes as block."""
    import gzip

    fields = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "block_digest": "WARC-Block-Digest"}

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [r for data in batch.column("content").to_pylist() for r in parse_records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)]
            columns = [pa.array([f.get(name) for f, _ in found], pa.string()) for name in fields.values()]
            return pa.RecordBatch.from_arrays([*columns, pa.array([b for _, b in found], pa.binary())], [*fields, "block"])

        return step

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return arrow_map(files.where(~F.col("path").rlike(r"/[_.][^/]*$")).select("content"), make, ", ".join([*(f"{n} string" for n in fields), "block binary"]))


def responses_from_records(records: DataFrame) -> DataFrame:
    """Response records (doc_id: the record's identifier, url, response_id, date, http_header, payload) of read_warc's rows; other types are left out, bytes that aren't UTF-8 replaced."""
    parts = F.split(F.decode("block", "UTF-8"), "\r\n\r\n", 2)
    name = F.regexp_replace("record_id", "^<|>$", "")
    rows = records.where("type = 'response'").select(name.alias("doc_id"), F.col("target_uri").alias("url"), name.alias("response_id"), "date", parts.alias("p"))
    return rows.select("doc_id", "url", "response_id", "date", F.concat(F.col("p")[0], F.lit("\r\n\r\n")).alias("http_header"), F.coalesce(F.try_element_at("p", F.lit(2)), F.lit("")).alias("payload"))


def derivative_query(pages: DataFrame) -> DataFrame:
    """page_id, url, identifiers, links, digests and lengths of the derived records of every page."""
    made = derive(responses_from_pages(pages))
    return made.select(F.col("doc_id").alias("page_id"), "url", "response_id", "metadata_id", "conversion_id", "refers_to", "source_block_digest", "source_payload_digest", "conversion_digest", "metadata_digest", "conversion_length", "metadata_length", F.sha2(F.col("conversion_record").cast("binary"), 256).alias("conversion_sha256"), F.sha2(F.col("metadata_record").cast("binary"), 256).alias("metadata_sha256"))
