"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how usual each pair is.

Each byte of a text has a label: no token ends on it, one of A does, one of B does, or both. A regular expression takes
the spans up to each both-label; the labels counted in a span say how many tokens of either side form one group. All
pairs of a group's A and B tokens are links. Texts of one step lie one after another in the label string: a text's last
byte is a both-label, so no span leaves its text.

Links are counted corpus-wide by the number of documents that hold the pair. Counts of the pairs found in more than one
in HEAVY of all rows, of which there are fewer than HEAVY, are broadcast; the others, no key of which has many rows, meet
their counts in a shuffle join.

Cases: null and empty texts, and texts whose tokens don't spell a space and the text (a literal U+2581 is one), have no
tokens: zeros, no links and an empty digest; null ids are carried; repeated rows are documents of their own and counted
so; one group may span a whole text, and links of such a group are counted by its distinct ids, never listed; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.bpe import PATTERN, BytePairCodec
from lacuna.llm.common import arrow_map, materialize, per_worker

#: Pairs whose counts are broadcast, fewer than; bytes of texts aligned at once, a larger text alone; links of a group that are listed, at most.
HEAVY, STEP_BYTES, LISTED = 1 << 17, 1 << 20, 1 << 12
#: What stands for a space in pieces.
_SPACE_PIECE = "▁"
#: Labels of a byte.
A_END, B_END = 1, 2
_SPAN = re.compile(rb"[^\x03]*\x03")


class ByteSide:
    """A byte-level BPE file: ids of a space and a text, its added tokens read as plain text."""

    def __init__(self, path: str):
        self.codec = BytePairCodec(path)
        self.codec.special = None
        self.pieces = self.codec.pieces
        self.whole = None
        if self.codec.native is not None:
            import tiktoken

            self.whole = tiktoken.Encoding("own", pat_str=PATTERN.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"), mergeable_ranks=self.codec.ids, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[list[int]]:
        settled = lambda t: t.isascii() or not self.codec.unsettled.search(t)
        return [self.whole(f" {t}") if self.whole and settled(t) else self.codec.encode(f" {t}") for t in texts]


class PieceSide:
    """A sentencepiece model: ids of a text and the space that it adds."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.pieces = {i: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE_PIECE, " ").encode() for i, p in enumerate(plain)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


def _speller(spelled: bytes, lengths: np.ndarray):
    """A function that gives the bytes of lists of ids; spelled: of all ids, one after another."""
    table, begins = np.frombuffer(spelled, np.uint8), np.cumsum(lengths) - lengths

    def spell(lists: list[list[int]]) -> bytes:
        ids = _flat(lists)
        n = lengths[ids]
        return table[np.repeat(begins[ids] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))].tobytes()

    return spell


class Aligner:
    """Groups, links and digests of whole texts."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = ByteSide(a_path), PieceSide(b_path)
        self.lengths, self.shown, self.spelled, self.width = [], [], [], 1 + max(self.sides[1].pieces)
        for side, first in zip(self.sides, ";|", strict=True):
            size = 1 + max(side.pieces)
            lengths = np.zeros(size, np.int64)
            for i, piece in side.pieces.items():
                lengths[i] = len(piece)
            self.lengths.append(lengths)
            self.spelled.append(_speller(b"".join(side.pieces.get(i, b"") for i in range(size)), lengths))
            # a token as the first of its side in a group, then as a later one
            self.shown += [f"{first}{i}" for i in range(size)] + [f",{i}" for i in range(size)]

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray, np.ndarray]]:
        """A tokens, B tokens, groups, digest of the groups, and a, b, n of the links of each text."""
        at, size = 0, 0
        for i, text in enumerate(texts):
            size += (own := 4 * len(text or ""))
            if size > 4 * STEP_BYTES and i > at:
                yield from self._step(texts[at:i])
                at, size = i, own
        yield from self._step(texts[at:])

    def _tokens(self, texts: list[str | None]) -> tuple[list[int], list[bytes], list[list[list[int]]]]:
        """Which texts have tokens, their bytes with the space, and their ids on both sides."""
        some = [i for i, t in enumerate(texts) if t]
        data = [f" {texts[i]}".encode() for i in some]
        ids = [side.encode([texts[i] for i in some]) for side in self.sides]
        spelled = lambda side, own: b"".join(map(side.pieces.__getitem__, own))
        wrong = {k for side, bytes_of, own in zip(self.sides, self.spelled, ids, strict=True) if bytes_of(own) != b"".join(data) for k, d in enumerate(data) if spelled(side, own[k]) != d}
        good = [k for k in range(len(some)) if k not in wrong]
        return [some[k] for k in good], [data[k] for k in good], [[own[k] for k in good] for own in ids]

    def _step(self, texts: list[str | None]):
        good, data, both = self._tokens(texts)
        none = np.zeros(0, np.int64)
        out = [(0, 0, 0, "", none, none, none) for _ in texts]
        if not good:
            return out
        text_ends = np.cumsum([len(d) for d in data])
        labels = np.zeros(int(text_ends[-1]), np.uint8)
        ids = [_flat(lists) for lists in both]
        for own, lengths, label in zip(ids, self.lengths, (A_END, B_END), strict=True):
            labels[np.cumsum(lengths[own]) - 1] |= label
        spans = _SPAN.findall(labels.tobytes())
        ends = np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans)))
        # tokens of either side up to the end of each span, and in it
        upto = [np.cumsum(labels & label != 0)[ends - 1] for label in (A_END, B_END)]
        counts = [np.diff(u, prepend=0) for u in upto]
        starts = [u - c for u, c in zip(upto, counts, strict=True)]
        of_text = np.searchsorted(text_ends, ends, "left")

        shown, place = np.empty(len(ids[0]) + len(ids[1]), np.int64), 0
        bases = (0, 2 * len(self.lengths[0]))
        for k in (0, 1):
            group = np.repeat(np.arange(len(ends)), counts[k])
            first = np.zeros(len(ids[k]), bool)
            first[starts[k]] = True
            place = np.arange(len(ids[k])) + (starts[1][group] if k == 0 else upto[0][group])
            shown[place] = bases[k] + ids[k] + np.where(first, 0, len(self.lengths[k]))
        codes = shown.tolist()

        text, a, b, n = self._links(ids, counts, starts, of_text)
        edges = np.searchsorted(text, np.arange(len(good) + 1))
        groups = np.searchsorted(of_text, np.arange(len(good) + 1))
        last = [np.concatenate([[0], u])[groups] for u in upto]
        for k, i in enumerate(good):
            (a0, a1), (b0, b1) = last[0][k : k + 2], last[1][k : k + 2]
            digest = hashlib.sha256("".join(map(self.shown.__getitem__, codes[a0 + b0 : a1 + b1]))[1:].encode()).hexdigest()
            part = slice(edges[k], edges[k + 1])
            out[i] = (int(a1 - a0), int(b1 - b0), int(groups[k + 1] - groups[k]), digest, a[part], b[part], n[part])
        return out

    def _links(self, ids, counts, starts, of_text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text, a, b, n of the distinct links of each text, by text."""
        area = len(self.lengths[0]) * self.width
        size = counts[0] * counts[1]
        small = np.flatnonzero(size <= LISTED)
        group = np.repeat(small, size[small])
        off = np.arange(len(group)) - np.repeat(np.cumsum(size[small]) - size[small], size[small])
        a, b = ids[0][starts[0][group] + off // counts[1][group]], ids[1][starts[1][group] + off % counts[1][group]]
        keys, n = [of_text[group] * area + a * self.width + b], [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(size > LISTED):
            (ua, na), (ub, nb) = (np.unique(ids[k][starts[k][g] : starts[k][g] + counts[k][g]], return_counts=True) for k in (0, 1))
            keys.append((of_text[g] * area + ua[:, None] * self.width + ub).ravel())
            n.append((na[:, None] * nb).ravel())
        found, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(n), minlength=len(found)).astype(np.int64)
        return found // area, found % area // self.width, found % self.width, total


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, links (array of a, b, n: how often the document links the two ids)."""
    link = [pa.field("a", pa.int32()), pa.field("b", pa.int32()), pa.field("n", pa.int64())]

    def make():
        aligner = per_worker(("align", a_path, b_path), lambda: Aligner(a_path, b_path))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = list(aligner.align(batch.column("text").to_pylist()))
            ends = np.cumsum([0, *(len(r[4]) for r in rows)])
            parts = [pa.array(np.concatenate([r[k] for r in rows]), f.type) for k, f in zip((4, 5, 6), link, strict=True)]
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=link))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array([r[3] for r in rows], pa.string()), listed], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

        return step

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(source, make, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links array<struct<a:int,b:int,n:bigint>>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, docs (how many documents hold the pair), best (no pair of its A id is in more)."""
    counts = aligned.select(F.explode("links").alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("docs"))
    # an A id has one row for each B id at most
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))


def link_statistics(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose count is their A id's highest), count_sum (of counts over links), groups_sha256."""
    aligned = materialize(align_documents(docs, a_path, b_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialize(pair_counts(aligned), "pairs")
    totals = counts.agg(F.count("*").alias("pairs"), F.sum("docs").alias("rows")).first()
    links = aligned.select("row", F.explode("links").alias("x")).select("row", "x.*")

    def told(rows: DataFrame) -> DataFrame:
        return rows.groupBy("row").agg(F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))

    if totals["pairs"] < HEAVY:
        sums = told(links.join(F.broadcast(counts), ["a", "b"]))
    else:
        usual = F.col("docs") > totals["rows"] / HEAVY  # so there are fewer than HEAVY of them
        heavy, light = counts.where(usual), counts.where(~usual)
        rare = links.join(F.broadcast(heavy.select("a", "b")), ["a", "b"], "anti").join(light.hint("merge"), ["a", "b"])
        sums = told(links.join(F.broadcast(heavy), ["a", "b"])).unionByName(told(rare))
        sums = sums.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.drop("links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
