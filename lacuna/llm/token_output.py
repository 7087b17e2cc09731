"""Token-ID output: documents as Parquet list columns of token ids, in ascending id order.

File format, per document: doc_id, part (the file's place), part_start (ids of the part before it), n_tokens, tokens
(array<int>). Token ids are dictionary-encoded; the metadata columns are delta-encoded (version-2 pages without a
dictionary); row groups and pages have set sizes, and Parquet's page indexes are written, so that a read of a doc_id
range or of metadata alone skips the other pages.

Cases: null texts count as empty (only the end id); null ids come first, ties of an id are ordered by a hash of the text
and then by length; repeated rows are all written; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.llm.bpe import byte_alphabet
from lacuna.llm.common import arrow_map, new_path, per_worker

#: Pieces kept in a worker's memo, at most; beyond that the memo starts anew. Only pieces that aren't plain words enter it.
MEMO_PIECES = 200_000
#: Bytes of text encoded at a time; a longer text is taken alone.
SLICE_BYTES = 16 << 20
#: Bytes of a row group and of a page, rows of a page at most.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 64 << 20, 256 << 10, 2_000
#: Marks that are encoded apart from the word before them.
_AFTER_WORD = ".,;:!?%*$&#)]}"
#: What a piece of settled letters doesn't hold: code points from U+0250 on, and the one letter below that has two in lower case.
_UNSETTLED = r"[^\x00-\x{24f}]|\x{130}"
#: Bytes of lower-case settled letters in UTF-8, and those of them that end a word with the bytes that stand for these there.
_INNER = frozenset([*range(0x61, 0x7B), *range(0xC2, 0xCA), *range(0x80, 0xC0)])
_CLOSING = {b: b - 0x20 for b in range(0x61, 0x7B)} | {b: b - 0x80 for b in range(0x80, 0xC0)}
_WORD_END = "</w>"


def _word_symbols(token: str, alphabet: dict[str, int]) -> bytes | None:
    """A token of settled letters as bytes, the last one a stand-in if the token ends a word; None for other tokens."""
    ends = token.endswith(_WORD_END)
    data = bytes(alphabet.get(c, 0) for c in token.removesuffix(_WORD_END))
    if not data or not _INNER.issuperset(data) or (ends and data[-1] not in _CLOSING):
        return None
    return data[:-1] + bytes([_CLOSING[data[-1]]]) if ends else data


@lru_cache(maxsize=4)
def word_ranks(path: str) -> dict[bytes, tuple[int, int]] | None:
    """bytes of each token of settled letters -> (rank of its merge, id); None if merging by ranks alone could go astray.

    A pair of neighbours whose bytes make a token may be merged at that token's rank, whatever pair its merge names, if
    each token comes out of its own bytes by the named merges: as long as no merge has crossed the pair's outer ends, its
    inside went as it does alone, so that the pair is the named one.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != _WORD_END:
        return None
    alphabet = byte_alphabet()
    out, pairs = {}, {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        a, b = _word_symbols(left, alphabet), _word_symbols(right, alphabet)
        if a is None or b is None or left.endswith(_WORD_END):
            continue
        if a + b in out:
            return None
        out[a + b], pairs[a, b] = (rank, model["vocab"][left + right]), rank
    for token in out:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min((pairs.get((parts[i], parts[i + 1]), 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    for token, number in model["vocab"].items():
        if (one := _word_symbols(token, alphabet)) is not None and len(one) == 1:
            out[one] = (len(model["merges"]) + len(out), number)
    return out if len(out) - len(pairs) == len(_INNER) + len(_CLOSING) else None


def _expand(flat: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen stretches of flat, one after the other, and where each ends."""
    of_each = sizes[chosen]
    ends = np.cumsum(of_each, dtype=np.int32)
    places = np.repeat(offsets[chosen] - (ends - of_each), of_each)
    places += np.arange(len(places), dtype=np.int32)
    return flat[places], ends


def _ragged(lists: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, offsets, sizes) of lists of integers."""
    sizes = np.fromiter(map(len, lists), np.int32, len(lists))
    flat = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
    return flat, np.cumsum(sizes, dtype=np.int32) - sizes, sizes


def _tails(whole: pa.StringArray, heads: pa.StringArray) -> pa.StringArray:
    """What is left of each string behind its head."""
    sizes = np.asarray(pc.binary_length(whole), np.int32), np.asarray(pc.binary_length(heads), np.int32)
    begin = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole)]
    data, ends = _expand(np.frombuffer(whole.buffers()[2] or b"", np.uint8), begin + sizes[1], sizes[0] - sizes[1], np.arange(len(whole)))
    return pa.StringArray.from_buffers(len(whole), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


class WordEncoder:
    """Encodes whole texts with a tokenizers file whose pre-tokenizer drops white space.

    No token crosses a space, tab or newline, so texts are split there and only the distinct pieces of a slice are encoded.
    A piece that is a word of settled letters and then marks is encoded as these two: the word by tiktoken's merge over
    word_ranks, if the file has them; all else by the library.
    """

    def __init__(self, path: str, ranks: dict[bytes, tuple[int, int]] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.memo: dict[str, list[int]] = {}
        self.merge = None
        if ranks:
            import tiktoken

            self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks={b: rank for b, (rank, _) in ranks.items()}, special_tokens={})._core_bpe.encode_single_piece
            self.of_rank = np.zeros(1 + max(rank for rank, _ in ranks.values()), np.int32)
            for rank, number in ranks.values():
                self.of_rank[rank] = number
            self.closing = np.arange(256, dtype=np.uint8)
            self.closing[[*_CLOSING]] = [*_CLOSING.values()]
            probes = pa.array(["the", "Straße", "niño.", "xqzvw!!", "ÉTÉ,"])
            flat, _, sizes = self._pieces(probes)
            if flat.tolist() != [i for p in probes.to_pylist() for i in self._ids(p)]:
                self.merge = None  # the file treats words in another way

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _known(self, piece: str) -> list[int]:
        if (ids := self.memo.get(piece)) is None:
            if len(self.memo) >= MEMO_PIECES:
                self.memo.clear()
            ids = self.memo[piece] = self._ids(piece)
        return ids

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, offsets, sizes) of lower-case words of settled letters."""
        begin, size = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1], len(words)
        data = np.frombuffer(words.buffers()[2], np.uint8)[begin[0] : begin[-1]].copy()
        last = begin[1:] - 1 - begin[0]
        data[last] = self.closing[data[last]]
        raw = pa.BinaryArray.from_buffers(pa.binary(), size, [None, pa.py_buffer((begin - begin[0]).tobytes()), pa.py_buffer(data.tobytes())])
        flat, offsets, sizes = _ragged(list(map(self.merge, raw.to_pylist())))
        return self.of_rank[flat], offsets, sizes

    def _pieces(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, offsets, sizes) of distinct pieces."""
        if self.merge is None or not len(pieces):
            return _ragged(list(map(self._known, pieces.to_pylist())))
        words = pc.utf8_rtrim(pieces, characters=_AFTER_WORD)
        plain = pc.and_(pc.utf8_is_alpha(words), pc.invert(pc.match_substring_regex(pieces, _UNSETTLED)))
        whole = np.asarray(plain)
        marks = _tails(pieces, words).filter(plain).dictionary_encode()
        words = pc.utf8_lower(words.filter(plain)).dictionary_encode()
        # Units: the distinct words, the distinct marks after words (none: no ids), pieces that aren't plain words.
        flat, offsets, sizes = self._words(words.dictionary)
        others = _ragged([self._known(t) if t else [] for t in [*marks.dictionary.to_pylist(), *pieces.filter(pc.invert(plain)).to_pylist(), ""]])
        units = np.full((len(pieces), 2), len(sizes) + len(others[2]) - 1, np.int64)
        units[whole, 0], units[whole, 1] = np.asarray(words.indices), len(sizes) + np.asarray(marks.indices)
        units[~whole, 0] = len(sizes) + len(marks.dictionary) + np.arange(np.count_nonzero(~whole))
        joined = np.concatenate([flat, others[0]]), np.concatenate([offsets, others[1] + len(flat)]).astype(np.int32), np.concatenate([sizes, others[2]])
        out, ends = _expand(*joined, units.ravel())
        ends = ends[1::2]
        return out, np.concatenate([[0], ends[:-1]]).astype(np.int32), np.diff(ends, prepend=0).astype(np.int32)

    def encode(self, texts: pa.StringArray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, one text after the other, and how many each text has), each text closed by end_id if there is one. texts: without nulls."""
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\t", " "), "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        flat, offsets, sizes = self._pieces(words.dictionary)
        counts = np.diff(np.asarray(lists.offsets)).astype(np.int64)
        chosen = np.asarray(words.indices)
        if end_id is not None:  # one more piece closes each text
            flat, offsets, sizes = np.append(flat, np.int32(end_id)), np.append(offsets, np.int32(len(flat))), np.append(sizes, np.int32(1))
            chosen = np.insert(chosen, np.cumsum(counts), len(sizes) - 1)
            counts += 1
        out, ends = _expand(flat, offsets, sizes, chosen)
        return out, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]).astype(np.int64)


def _by_bytes(batches, column: str):
    """Slices of SLICE_BYTES of the column's text, or of one row."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(column)), np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document, range-partitioned and sorted by id: doc_id, part, part_start, n_tokens, tokens."""
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"), F.length("text"))

    ranks = word_ranks(tokenizer_path)

    def run(batches):
        from pyspark import TaskContext

        encoder, total, part = None, 0, TaskContext.get().partitionId()
        for batch in _by_bytes(batches, "text"):
            encoder = encoder or per_worker(("words", tokenizer_path), lambda: WordEncoder(tokenizer_path, ranks))
            flat, counts = encoder.encode(batch.column("text"), end_id)
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(counts), part, np.int32)), pa.array(total + ends - counts), pa.array(counts), lists], ["doc_id", "part", "part_start", "n_tokens", "tokens"])
            total += int(ends[-1])

    return ordered.mapInArrow(run, f"doc_id {id_type}, part int, part_start long, n_tokens long, tokens array<int>")


def write_tokens(encoded: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    writer = encoded.write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
    writer = writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#tokens.list.element", "true")
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "tokens"), low=None, high=None) -> DataFrame:
    """Selective read: the named columns (start: ids of all documents before) of documents with low <= doc_id <= high."""
    table = spark.read.parquet(path)
    wanted = table
    if low is not None:
        wanted = wanted.where(F.col("doc_id") >= low)
    if high is not None:
        wanted = wanted.where(F.col("doc_id") <= high)
    if "start" in columns:
        # One row a file, so the unpartitioned window and the broadcast are as small as the list of files.
        parts = table.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        bases = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("base"))
        wanted = wanted.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("part_start"))
    return wanted.select(*columns)


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the lists that were read."""
    id_type = tokens.schema["doc_id"].dataType.simpleString()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column("tokens")
            at, flat = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4")
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

        return step

    return arrow_map(tokens, make, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def token_file_query(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    spark = docs.sparkSession
    write_tokens(encode_documents(docs, tokenizer_path), path := new_path(spark, "tokens"))
    return token_digests(read_tokens(spark, path, ("doc_id", "start", "tokens")))
