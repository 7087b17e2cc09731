"""Benchmark decontamination: q-gram lemma filter over diagonal bands, verified by banded alignment.

Texts are lower-cased and each run of white space becomes one space. An item of m characters matches a region of a
document if their edit distance is at most e = floor(rate * m). By the q-gram lemma such a region shares at least
m - q + 1 - q * e positional q-grams with the item, all on e + 1 neighbouring diagonals (document position minus item
position). Hits are counted in bands of 2 (e + 1) diagonals, each overlapping the next by half, so some band holds them
all; bands that reach the bound are verified by alignment within the band. An item whose edits q-grams don't bound is
searched by shorter ones. Items under min_chars have no edits: they match where they stand as they are, and not within
a longer word.

The index of the items goes to every task; it holds at most BLOCK_CHARS characters of items, and larger benchmarks are
searched in blocks of that size.

Cases: null, empty and blank texts match nothing; null, empty and blank items are passed over; repeated items each give rows, repeated documents
too; an empty table on either side gives no match; null ids are carried; other columns are kept by the filter.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import arrow_map, per_worker, ship

GRAM, EDIT_RATE, MIN_CHARS = 8, 0.1, 24
#: The lemma is asked again with shorter q-grams, which bind more tightly, before an alignment.
FINE_GRAM = 4
#: Sizes of q-grams for items whose edits longer ones do not bound.
SHORTER_GRAMS = (4, 2, 1)
#: Characters of items in one index, and characters of documents hashed at once.
BLOCK_CHARS, STREAM_CHARS = 4_000_000, 1_000_000
#: No character.
_NONE = 0xFFFFFFFF
_BASE, _SPREAD, _TABLE_BITS = np.uint64(0x9E3779B1), np.uint64(0x9E3779B97F4A7C15), 22


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _joins(a: str, b: str) -> bool:
    """Whether two neighbouring characters belong to one word; scripts from U+2E80 on don't part words."""
    return a.isalnum() and b.isalnum() and max(a, b) < "\u2e80"


def find_whole(text: str, item: str, start: int, stop: int) -> int:
    """Where the item first stands in the text, from start and up to stop, other than within a longer word; -1: nowhere."""
    at = text.find(item, start, stop)
    while at >= 0 and (at and _joins(text[at - 1], item[0]) or at + len(item) < len(text) and _joins(item[-1], text[at + len(item)])):
        at = text.find(item, at + 1, stop)
    return at


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each q-gram, by doubling for the powers of two in q."""
    with np.errstate(over="ignore"):
        width, power, piece = 1, _BASE, points.astype(np.uint64)
        out, done = None, 0
        rest = gram
        while rest:
            if rest & 1:
                if out is None:
                    out, done = piece, width
                else:
                    n = len(piece) - done
                    out, done = out[:n] * power + piece[done : done + n] if n > 0 else piece[:0], done + width
            rest >>= 1
            if rest:
                n = len(piece) - width
                piece = piece[:n] * power + piece[width:] if n > 0 else piece[:0]
                width, power = 2 * width, power * power
        return (out[: max(0, len(points) - gram + 1)]) * _SPREAD


def alignment(item: np.ndarray, region: np.ndarray, anchored: bool = False) -> tuple[int, int]:
    """(least edit distance of item and a stretch of region, where it ends); anchored: the stretch starts at 0.

    The band holds the diagonals 0 .. len(region) - len(item), or as many as the edits of an anchored one need.
    """
    m, width = len(item), max(1, len(region) - len(item) + 1) if not anchored else 2 * max(1, abs(len(region) - len(item))) + 1
    low = 0 if not anchored else -(width // 2)
    k = np.arange(width)
    padded = np.concatenate([np.zeros(max(0, -low), np.int64) - 1, region.astype(np.int64), np.zeros(m + 2 * width + 2, np.int64) - 1])
    shift = max(0, -low)
    row = np.zeros(width, np.int64) if not anchored else np.where(k + low >= 0, k + low, 1 << 30)
    for i in range(1, m + 1):
        at = i + low + shift - 1
        new = row + (padded[at : at + width] != item[i - 1])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        if anchored:
            new = np.where(i + low + k >= 0, new, 1 << 30)
        row = np.minimum.accumulate(new - k) + k
    end = int(np.argmin(row))
    return int(row[end]), m + low + end


class ItemIndex:
    """q-grams of the items with their postings (item, position)."""

    def __init__(self, ids: list, texts: list[str | None], gram: int, rate: float, min_chars: int):
        self.gram = gram
        self.ids, self.items, self.texts, self.whole, budgets, bounds = [], [], [], [], [], []
        others: dict[int, tuple[list, list]] = {}
        for item_id, text in zip(ids, texts, strict=True):
            text = normalize(text)
            if not text:
                continue
            m, whole = len(text), len(text) < min_chars
            e = 0 if whole else math.floor(rate * m)
            fits = next(g for g in (gram, *SHORTER_GRAMS) if g <= gram and m - g + 1 - g * e > 0 or g == 1)
            if fits < gram:
                of_ids, of_texts = others.setdefault(fits, ([], []))
                of_ids.append(item_id), of_texts.append(text)
                continue
            self.ids.append(item_id)
            self.texts.append(text)
            self.items.append(codes(text))
            self.whole.append(whole)
            budgets.append(e)
            bounds.append(m - gram + 1 - gram * e)
        self.others = [ItemIndex(*listed, fits, rate, min_chars) for fits, listed in others.items()]
        self.budgets, self.bounds = np.array(budgets, np.int64), np.array(bounds, np.int64)
        hashes = [gram_hashes(x, gram) for x in self.items]
        self.fine = [gram_hashes(x, FINE_GRAM) for x in self.items]
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.grams, first, self.counts = np.unique(flat[order], return_index=True, return_counts=True)
        self.first, self.item, self.place = first, item[order], place[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document position, item, item position) of each shared q-gram."""
        at, gram = [], []
        for begin in range(0, len(points), STREAM_CHARS):
            h = gram_hashes(points[begin : begin + STREAM_CHARS + self.gram - 1], self.gram)
            maybe = np.flatnonzero(self.table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            found = np.searchsorted(self.grams, h[maybe])
            found[found == len(self.grams)] = 0
            same = self.grams[found] == h[maybe] if len(self.grams) else np.zeros(len(maybe), bool)
            at.append(begin + maybe[same])
            gram.append(found[same])
        at, gram = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, gram))
        n = self.counts[gram]
        if not len(n):
            return at, at, at
        posting = np.repeat(self.first[gram] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[posting], self.place[posting]

    def search(self, texts: list[str | None]) -> list[tuple[int, object, int, int, int]]:
        """(row, item id, distance, start, end) of the best match of each document and item; offsets in the normalised text."""
        normal = [normalize(t) for t in texts]
        out, at = [hit for index in self.others for hit in index.search(normal)], 0
        while self.items and at < len(normal):
            until, size = at, 0
            while until < len(normal) and (until == at or size + len(normal[until]) <= STREAM_CHARS):
                size += len(normal[until]) + 1
                until += 1
            out += [(at + row, *rest) for row, *rest in self._search(normal[at:until])]
            at = until
        return out

    def _search(self, texts: list[str]) -> list[tuple]:
        stream = codes("\0".join(texts))
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        pos, item, place = self.hits(stream)
        doc = np.searchsorted(begins, pos, side="right") - 1
        pair = doc * len(self.items) + item
        if len(texts) * len(self.items) <= 8_000_000:
            live = np.bincount(pair, minlength=1)[pair] >= self.bounds[item]
        else:
            _, inverse, n = np.unique(pair, return_inverse=True, return_counts=True)
            live = n[inverse] >= self.bounds[item]
        pos, item, place, doc = pos[live], item[live], place[live], doc[live]
        step = self.budgets[item] + 1
        # Diagonals are counted from the document's start, moved up so that none is negative.
        diagonal = pos - begins[doc] - place + 4 * step + np.array([len(x) for x in self.items])[item]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        keys = np.concatenate([np.stack([doc, item, diagonal // step - s]) for s in (0, 1)], axis=1)
        bands, n = np.unique(keys, axis=1, return_counts=True) if keys.shape[1] else (keys, np.zeros(0, int))
        for d, i, b in bands[:, n >= self.bounds[bands[1]]].T.tolist() if keys.shape[1] else []:
            e, m = int(self.budgets[i]), len(self.items[i])
            low = b * (e + 1) - 4 * (e + 1) - m
            known = best.get((d, i))
            if known and known[0] == 0:
                continue
            text = texts[d]
            start, stop = max(0, low - e), min(len(text), low + 2 * (e + 1) + m + e)
            if (exact := find_whole(text, self.texts[i], start, stop) if self.whole[i] else text.find(self.texts[i], start, stop)) >= 0:
                best[d, i] = (0, exact, exact + m)
            if exact >= 0 or self.whole[i]:
                continue
            region, pad = codes(text[start:stop]), np.full(e, _NONE, np.uint32)
            shared = np.isin(self.fine[i], gram_hashes(region, FINE_GRAM)).sum()
            if shared < m - FINE_GRAM + 1 - FINE_GRAM * e:
                continue
            distance, end = alignment(self.items[i], np.concatenate([pad, region, pad]))
            if distance <= e and (known is None or distance < known[0]):
                end = min(max(0, end - e), len(region))
                back = region[:end][::-1][: m + e]
                _, length = alignment(self.items[i][::-1], np.concatenate([back, np.zeros(max(0, m + e - len(back)), back.dtype)]), anchored=True)
                best[d, i] = (distance, start + max(0, end - length), start + end)
        return [(d, self.ids[i], *found) for (d, i), found in sorted(best.items())]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[str, Callable[[], tuple[list, list]]]]:
    """(name, reader of (ids, texts) on a worker) of blocks of about BLOCK_CHARS characters; one for all but very large benchmarks.

    The characters are counted first. A block at a time passes the driver and is broadcast, so neither the driver nor a
    task's closure ever holds the whole benchmark.
    """
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toPandas() if blocks > 1 else items.toPandas()
        yield uuid.uuid4().hex, ship(benchmark.sparkSession, (part["item_id"].tolist(), part["text"].tolist()))


def contaminated(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, rate: float = EDIT_RATE, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, match_start, match_end: the best match of each contaminated document and item."""
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    source, found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), None
    for name, block in _blocks(benchmark, item_col, item_text_col):

        def make(name=name, block=block):
            index = per_worker(("items", name, gram, rate, min_chars), lambda: ItemIndex(*block(), gram, rate, min_chars))

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                hits = index.search(batch.column("text").to_pylist())
                rows = pa.array([h[0] for h in hits], pa.int64())
                rest = [pa.array([h[k] for h in hits], pa.int64()) for k in (2, 3, 4)]
                items = pa.array([h[1] for h in hits], pa.from_numpy_dtype(np.int64) if item_type == "bigint" else None)
                return pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), items, *rest], ["doc_id", "item_id", "distance", "match_start", "match_end"])

            return step

        part = arrow_map(source, make, f"doc_id {id_type}, item_id {item_type}, distance long, match_start long, match_end long")
        found = part if found is None else found.union(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, rate: float = EDIT_RATE, min_chars: int = MIN_CHARS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that match no item, all columns kept."""
    for name, block in _blocks(benchmark, item_col, item_text_col):

        def make(name=name, block=block):
            index = per_worker(("items", name, gram, rate, min_chars), lambda: ItemIndex(*block(), gram, rate, min_chars))

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                keep = np.ones(batch.num_rows, bool)
                keep[[h[0] for h in index.search(batch.column(text_col).to_pylist())]] = False
                return batch.filter(pa.array(keep))

            return step

        docs = arrow_map(docs, make, docs.schema)
    return docs
