"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged across, so the place between its bytes is a
certain cut. A text is split at added tokens, then by the pre-tokenizer's pattern, then at certain cuts; the fragments
are encoded independently (and remembered), and the results are concatenated. Long words thus fall into short pieces.

Cases: null texts count as empty (no ids, empty decoded text); repeated rows are all returned; other columns are not
carried; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import arrow_map, per_worker

#: The pre-tokenizer's pattern for byte-level vocabularies of this kind (fixed value). \p{White_Space} is its \s.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Characters outside the blocks whose classes all Unicode versions agree on; texts with one are split by the library itself.
UNSETTLED = r"[\u0530-\u1fff\u2070-\U0010ffff]"
#: Pre-tokens kept in a worker's memo, at most; beyond that the memo starts anew.
MEMO_PIECES = 500_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in characters of byte-level vocabularies: visible Latin-1 bytes stand for themselves, the others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BytePairCodec:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.pieces = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[as_bytes(left), as_bytes(right)] = rank
        inside = np.zeros(65536, bool)
        for token in self.ids:
            b = np.frombuffer(token, np.uint8).astype(np.int32)
            inside[b[:-1] << 8 | b[1:]] = True
        self.joinable, self.joinable_bytes = inside, inside.tobytes()
        self.pattern, self.unsettled = regex.compile(PATTERN), re.compile(UNSETTLED)
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.memo = _Memo(self._encode_piece)
        self.native = self._native()

    def _native(self):
        """tiktoken's merge of one fragment, if ids follow the order of the merges; else None."""
        order = [self.ids.get(a + b) for a, b in self.ranks]
        if order != sorted(order, key=lambda i: -1 if i is None else i) or len(set(order)) != len(order):
            return None
        try:
            import tiktoken
        except ImportError:
            return None
        return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=self.ids, special_tokens={})._encode_single_piece

    def merge(self, fragment: bytes) -> list[int]:
        """Byte pair merging in its plain form: the pair of the lowest rank first, leftmost among equals."""
        parts = [fragment[i : i + 1] for i in range(len(fragment))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ids[p] for p in parts]

    def cuts(self, data: bytes) -> list[int]:
        """Places in data where no token can reach across."""
        if len(data) < 64:
            joinable = self.joinable_bytes
            return [i for i in range(1, len(data)) if not joinable[data[i - 1] << 8 | data[i]]]
        b = np.frombuffer(data, np.uint8).astype(np.int32)
        return (np.flatnonzero(~self.joinable[b[:-1] << 8 | b[1:]]) + 1).tolist()

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text without added tokens."""
        if text.isascii() or not self.unsettled.search(text):
            return self.pattern.findall(text)
        from tokenizers.pre_tokenizers import ByteLevel

        return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]

    def _encode_piece(self, piece: str) -> list[int]:
        data = piece.encode()
        if (whole := self.ids.get(data)) is not None and self.native is not None:
            return [whole]
        encode, out = self.native or self.merge, []
        if not (cuts := self.cuts(data)):
            return encode(data)
        edges = [0, *cuts, len(data)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            out += encode(data[a:b])
        return out

    def encode(self, text: str) -> list[int]:
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        get, out = self.memo.__getitem__, []
        for at, part in enumerate(self.special.split(text) if self.special else [text]):
            if at % 2:
                out.append(self.added[part])
            elif part:
                out += chain.from_iterable(map(get, self.split(part)))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of every whole text."""

    def make():
        codec = per_worker(("bytes", tokenizer_path), lambda: BytePairCodec(tokenizer_path))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

        return step

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(source, make, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids, text of rows with ids; an unknown id is an error."""

    def make():
        codec = per_worker(("bytes", tokenizer_path), lambda: BytePairCodec(tokenizer_path))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [codec.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

        return step

    return arrow_map(encoded.select("doc_id", "ids"), make, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, from the codec's ids and decoded text."""

    def make():
        codec = per_worker(("bytes", tokenizer_path), lambda: BytePairCodec(tokenizer_path))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, of_ids, of_text = [], [], []
            for text in batch.column("text").to_pylist():
                ids = codec.encode(text or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return arrow_map(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
