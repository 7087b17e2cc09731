"""Token files: the encoder against the library on odd texts, sizes of groups and pages, selective reads."""

import json
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lacuna.llm import token_output
from lacuna.llm.queries import tokenizer

PATH = tokenizer("word_bpe_49k.json")
R = random.Random(3)
SYLLABLES = ["th", "er", "an", "sch", "ö", "ß", "é", "ñ", "ing", "qu", "x", "ƀ", "ŀ", "Z", "É", "µ"]
ODD = ["", " ", "\t\n x", "İstanbul ISTANBUL", "don't we'll 'S x's", "日本語 текст", "<|endoftext|> a<|startoftext|>b", "é é ́e", "ẞ ǅ ŉ ªº µ ſ", "a b c", "12 3.5 x9", "???", "word.)]", "ﬁ K Å", "\x00 \x85 ​", "A" * 3000, "x" * 500 + "!" * 50, "ƒoo Ŀ ƀɏ ɐ", "word\rword"]
ODD += [" ".join("".join(R.choice(SYLLABLES) for _ in range(R.randint(1, 6))) + R.choice(["", "", ".", ",", "!!", "***"]) for _ in range(R.randint(1, 200))) for _ in range(60)]


@pytest.mark.parametrize("plain", [True, False])
def test_encoder_equals_the_library(plain):
    from tokenizers import Tokenizer

    lib, ranks = Tokenizer.from_file(PATH), token_output.word_ranks(PATH)
    encoder = token_output.WordEncoder(PATH, ranks if plain else None)
    assert (encoder.merge is not None) == plain
    for texts in (ODD, ODD[7:30], [], [""]):
        flat, counts = encoder.encode(pa.array(["cut off", *texts], pa.string()).slice(1), 2)
        ends = np.cumsum(counts)
        assert [flat[b - n : b].tolist() for b, n in zip(ends, counts)] == [[*lib.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_word_ranks_refuse_files_whose_merges_are_irregular(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    assert len(token_output.word_ranks(PATH)) > 40_000
    spec["model"]["merges"] = spec["model"]["merges"][:500][::-1]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    assert token_output.word_ranks(str(tmp_path / "t.json")) is None
    spec["model"]["end_of_word_suffix"] = None
    (tmp_path / "u.json").write_text(json.dumps(spec))
    assert token_output.word_ranks(str(tmp_path / "u.json")) is None


def test_slices_follow_bytes(monkeypatch):
    monkeypatch.setattr(token_output, "SLICE_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["aaaa", "bbbb", "c" * 50, "", "d", "e" * 9])], ["text"])
    assert [b.column("text").to_pylist() for b in token_output._by_bytes([batch, batch.slice(6)], "text")] == [["aaaa", "bbbb"], ["c" * 50], ["", "d", "e" * 9]]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(i // 2 if i < 20 else i, " ".join(rng.choice(SYLLABLES[:4]) for _ in range(rng.randint(0, 90)))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("n_tokens", F.lit(-1))
    encoded = token_output.encode_documents(docs, PATH)
    token_output.write_tokens(encoded, path := str(tmp_path_factory.mktemp("tokens") / "t"), row_group_bytes=64 << 10, page_bytes=4 << 10, page_rows=100)
    return rows, path


def test_groups_and_pages_have_their_sizes(written):
    rows, path = written
    files = [pq.ParquetFile(p) for p in Path(path).glob("part-*.parquet")]
    groups = [f.metadata.row_group(i) for f in files for i in range(f.metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) == len(rows) and len(groups) > 2 * len(files)
    for g in groups:
        assert g.total_byte_size < 2 * (64 << 10)
        for k in range(g.num_columns):
            column = g.column(k)
            assert column.has_offset_index and column.has_column_index
            name = column.path_in_schema
            assert ("RLE_DICTIONARY" in column.encodings) == (name == "tokens.list.element"), name
            assert ("DELTA_BINARY_PACKED" in column.encodings) == (name != "tokens.list.element"), name


def test_reads_of_metadata_and_starts(spark, written):
    rows, path = written
    metadata = token_output.read_tokens(spark, path, ("doc_id", "start", "n_tokens"), 100, 300)
    plan = metadata._jdf.queryExecution().executedPlan().toString()
    assert ",tokens:" not in plan and "<tokens:" not in plan and "GreaterThanOrEqual(doc_id,100)" in plan and "LessThanOrEqual(doc_id,300)" in plan
    whole = sorted(token_output.read_tokens(spark, path, ("doc_id", "start", "n_tokens", "tokens")).collect(), key=lambda r: r.start)
    at = 0
    for r in whole:
        assert r.start == at and len(r.tokens) == r.n_tokens
        at += r.n_tokens
    assert [r.doc_id for r in whole] == sorted(i for i, _ in rows)
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in metadata.collect()) == sorted((r.doc_id, r.start, r.n_tokens) for r in whole if 100 <= r.doc_id <= 300)
    assert token_output.read_tokens(spark, path, ("n_tokens",)).columns == ["n_tokens"]
