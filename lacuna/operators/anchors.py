"""Where quoted passages stand in documents."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.text import strip

#: Characters of anchors in one automaton, at most: larger sets are searched for in blocks.
BLOCK_CHARS = 4_000_000
#: White space as Unicode has it but for the blank, a run of white space that isn't one blank (which stays as it is), and texts at a time.
_OTHER = "\\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RUN, _ROWS = re.compile(f"[{_OTHER}][ {_OTHER}]*| [ {_OTHER}]+"), 64


def fold(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with single blanks for runs of white space, and (place in the folded text, characters left out before it) of each longer run."""
    parts, cuts, at, size, lost = [], [], 0, 0, 0
    for run in _RUN.finditer(text):
        parts += (text[at : run.start()], " ")
        size += run.start() - at + 1
        at = run.end()
        if run.end() - run.start() > 1:
            lost += run.end() - run.start() - 1
            cuts.append((size, lost))
    return "".join([*parts, text[at:]]), cuts


class AnchorIndex:
    """An automaton over anchors whose white space is folded."""

    def __init__(self, ids: list, anchors: list[str]):
        import ahocorasick

        self.automaton, self.ids, self.anchors, by_text = ahocorasick.Automaton(), ids, anchors, {}
        for i, anchor in enumerate(anchors):
            by_text.setdefault(fold(anchor)[0], []).append(i)
        for folded, own in by_text.items():
            self.automaton.add_word(folded, (len(folded), own))
        self.automaton.make_automaton()

    def places(self, text: str, loose: bool) -> Iterator[tuple[int, int, int]]:
        """(anchor, start, end) of each anchor's first exact place, else, if loose, of its first one with other white space."""
        folded, cuts = fold(text)
        edges = [c[0] for c in cuts]
        whole = lambda at: at + (cuts[k - 1][1] if (k := bisect_right(edges, at)) else 0)
        exact, near = {}, {}
        for last, (size, own) in self.automaton.iter(folded):
            start, end = whole(last - size + 1), whole(last) + 1
            for i in own:
                if i not in exact and text[start:end] == self.anchors[i]:
                    exact[i] = (start, end)
                near.setdefault(i, (start, end))
        for i, place in near.items():
            if i in exact or loose:
                yield (i, *exact.get(i, place))


def resolve_anchors(docs: DataFrame, anchors: DataFrame, text_col: str = "canonical_text", loose: bool = False) -> DataFrame:
    """doc_id, anchor_id, start, end of each anchor's first exact place in each document that holds it; if loose, else of its first place with any white space between its words.

    anchors: anchor_id, anchor_text; stripped, blank ones never match. The texts are read once for each BLOCK_CHARS
    characters of anchors, which a broadcast takes to the tasks.
    """
    spark = docs.sparkSession
    quoted = anchors.select("anchor_id", strip(F.col("anchor_text")).alias("anchor")).where("anchor <> ''")
    chars = quoted.agg(F.sum(F.length("anchor"))).first()[0] or 0
    blocks, found = max(1, math.ceil(chars / BLOCK_CHARS)), None
    doc_type, anchor_type = docs.schema["doc_id"].dataType.simpleString(), anchors.schema["anchor_id"].dataType.simpleString()
    for b in range(blocks):
        part = quoted.where(F.pmod(F.xxhash64("anchor_id", "anchor"), F.lit(blocks)) == b).toPandas()
        if part.empty:
            continue
        sent, kind = spark.sparkContext.broadcast((part["anchor_id"].tolist(), part["anchor"].tolist())), pa.Schema.from_pandas(part[["anchor_id"]], preserve_index=False).field(0).type

        def search(batches: Iterator[pa.RecordBatch], sent=sent, kind=kind) -> Iterator[pa.RecordBatch]:
            index = AnchorIndex(*sent.value)
            for batch in batches:
                for at in range(0, batch.num_rows, _ROWS):
                    some = batch.slice(at, _ROWS)
                    hits = [(row, *place) for row, text in enumerate(some.column("t").to_pylist()) if text for place in index.places(text, loose)]
                    rows = pa.array([h[0] for h in hits], pa.int64())
                    yield pa.RecordBatch.from_arrays([some.column("doc_id").take(rows), pa.array([index.ids[h[1]] for h in hits], kind), *(pa.array([h[k] for h in hits], pa.int64()) for k in (2, 3))], ["doc_id", "anchor_id", "start", "end"])

        own = docs.select("doc_id", F.col(text_col).alias("t")).mapInArrow(search, f"doc_id {doc_type}, anchor_id {anchor_type}, start long, end long")
        found = own if found is None else found.unionByName(own)
    return spark.createDataFrame([], f"doc_id {doc_type}, anchor_id {anchor_type}, start long, end long") if found is None else found


def resolve_anchor(text, anchor):
    """struct<start, end> of one anchor in its own document: exact, else with any white space between its words; null if blank or absent."""
    clean = strip(anchor)
    words = F.split(clean, r"(?U)\s+")
    quote = lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    loose = F.array_join(F.transform(words, quote), "\\s+")
    hit = F.regexp_substr(text, F.concat(F.lit("(?U)"), loose))
    found = F.when(F.contains(text, clean), clean).otherwise(hit)
    start = F.position(found, text) - 1
    return F.when((F.length(clean) > 0) & found.isNotNull(), F.struct(start.alias("start"), (start + F.length(found)).alias("end")))
