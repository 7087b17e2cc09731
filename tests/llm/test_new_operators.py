"""Ranked search, quality and alignment against brute force, the libraries and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lacuna.llm import alignment, lexical, quality, queries
from lacuna.llm.common import read_table

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOC = "doc_id long, text string, extra int, Score string"


def ranked_plainly(docs, items, k):
    """Every document scored for every item in Python's integers."""
    split = lambda t: [x.translate(LOWER) for x in TERM.findall(t or "")]
    held = [(d, Counter(w)) for d, t in docs if (w := split(t))]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        hits = []
        for d, c in held:
            m, score = 75 + 25 * sum(c.values()) * n_docs // n_terms, 0
            for t in split(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                hits.append((-score, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(hits)[:k], 1)]
    return out


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_search_equals_scoring_every_document(spark):
    found = queries.lexical_top(spark, SF)
    docs = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    assert rows(found, "item_id", "rank", "doc_id", "score") == sorted(ranked_plainly(docs, items, 20))


def test_search_over_small_shards_with_ties(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 60)
    draw = random.Random(3)
    words = ["alpha", "Beta", "gamma", "dÉlta", "日本", "x1", "zeta", "eta"]
    docs = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 9)))) for i in range(300)] + [(1000 + i, "gamma zeta, x1") for i in range(60)]
    items = [(i, " ".join(draw.choice(words) for _ in range(4))) for i in range(12)]
    made = spark.createDataFrame([(d, t, 1, "s") for d, t in docs], DOC).repartition(7)
    found = lexical.ranked_search(made, spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert rows(found, "item_id", "rank", "doc_id", "score") == sorted(ranked_plainly(docs, items, 5))


def test_one_task_searches_shard_after_shard():
    draw = random.Random(8)
    docs = [(i, " ".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 12)))) for i in range(500)]
    q = lexical.Queries([0, 1], ["a b h", "c c d"])
    held = [(d, lexical.terms(t)) for d, t in docs]
    n_terms = sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    weights = np.array([lexical.term_weight(500, df[t]) for t in q.numbers], np.int64)
    for number, item in enumerate(["a b h", "c c d"]):
        heap = []
        for at in range(0, 500, 90):
            part = held[at : at + 90]
            counts = [Counter(q.numbers[t] for t in w if t in q.numbers) for _, w in part]
            flat = lambda f: np.array([x for c in counts for x in f(c)], np.int64)
            m = np.array([75 + 25 * len(w) * 500 // n_terms for _, w in part])
            shard = lexical.Shard([d for d, _ in part], m, np.array([len(c) for c in counts]), flat(Counter.keys), flat(Counter.values), weights)
            heap = sorted(heap + shard.search(q.rows[number], 10, heap[9][0] if len(heap) >= 10 else 1), key=lexical._rank_key)[:10]
        assert [(s, d) for s, d in heap] == [(s, d) for _, _, d, s in ranked_plainly(docs, [(0, item)], 10)]


def test_search_cases(spark):
    docs = spark.createDataFrame([(1, None, 1, "s"), (2, "", 1, "s"), (3, "!? --", 1, "s"), (4, "word", 1, "s"), (4, "word", 1, "s"), (None, "word", 1, "s"), (5, "other " * 5000 + "word", 1, "s")], DOC)
    items = spark.createDataFrame([(1, "Word"), (2, None), (3, " "), (4, "absent")], "item_id long, text string")
    found = lexical.ranked_search(docs, items)
    assert [r.doc_id for r in found.where("item_id = 1").orderBy("rank").collect()] == [4, 4, None, 5]
    assert found.where("item_id <> 1").count() == 0
    assert lexical.ranked_search(docs.limit(0), items).count() == 0
    assert lexical.ranked_search(docs, items.limit(0)).count() == 0


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    scored = quality.score_documents(docs, quality.train(docs, labels)).join(labels.where("quality is not null"), "doc_id").collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in scored)
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)


def test_quality_filters_cover_the_whole_text():
    model = quality.QualityModel()
    draw = np.random.default_rng(4)
    for size in (0, 1, 511, 512, 513, 4000):
        data, n = quality.bytes_of("".join(map(chr, draw.integers(32, 127, size))))
        assert n == size
        maxima, _ = model.blocks(data)
        x = model.w["bytes"][np.concatenate([data, np.zeros(quality.WIDTH, np.uint8)])]
        for b in range(len(maxima)):
            plain = [sum(x[t + j] @ model.w["filters"][j] for j in range(quality.WIDTH)) for t in range(b * 256, b * 256 + 256)]
            assert np.allclose(maxima[b], np.max(plain, 0) + model.w["offset"], atol=1e-4)
        assert np.allclose(model.halves(data), maxima, atol=1e-4)


def test_quality_gradient_is_the_slope():
    model = quality.QualityModel()
    data, size = quality.bytes_of("Some words of a text, some of them twice. " * 30)
    grad = {k: np.zeros_like(v, np.float64) for k, v in model.w.items()}
    model.gradient(data, size, 1, 1.0, grad)
    loss = lambda: float(np.logaddexp(0, -model.head(model.blocks(data)[0], size)[3]))
    for name in ("hidden", "out", "filters", "bytes"):
        at = np.unravel_index(np.argmax(np.abs(grad[name])), grad[name].shape)
        kept, step = model.w[name][at], 1e-3
        model.w[name][at] = kept + step
        up = loss()
        model.w[name][at] = kept - step
        down = loss()
        model.w[name][at] = kept
        assert (up - down) / (2 * step) == pytest.approx(grad[name][at], rel=0.1, abs=1e-3)


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, None, 1, "s"), (2, "", 1, "s"), (2, "", 1, "s"), (None, "x", 1, "s"), (3, "ab " * 200_000, 1, "s")], DOC)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.score_documents(docs, quality.train(docs, none)).collect()] == [0.0] * 5
    model = quality.QualityModel().fit(["good text of words " * 9, "zz zz zz zz " * 20] * 20, [1, 0] * 20)
    made = quality.score_documents(docs, model).collect()
    assert len(made) == 5 and all(0 <= r.score <= 1 for r in made) and made[1].score == made[0].score
    assert quality.score_documents(docs.limit(0), model).count() == 0


def aligned_plainly(text, a, b, alphabet):
    """Groups and links of a text by the libraries' own tokens and sets of end offsets."""
    if not text:
        return 0, 0, 0, "", Counter()
    full = f" {text}"
    own = a.encode(full, add_special_tokens=False)
    sides = [(own.ids, [bytes(alphabet[c] for c in x) for x in own.tokens])]
    ids = b.encode(text)
    sides.append((ids, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids]))
    if any(b"".join(p) != full.encode() for _, p in sides):
        return 0, 0, 0, "", Counter()
    ends = [np.cumsum([len(p) for p in pieces]).tolist() for _, pieces in sides]
    shown, links, at = [], Counter(), [0, 0]
    for cut in sorted(set(ends[0]) & set(ends[1])):
        group = []
        for k in (0, 1):
            to = ends[k].index(cut) + 1
            group.append(sides[k][0][at[k] : to])
            at[k] = to
        shown.append("|".join(",".join(map(str, g)) for g in group))
        links.update((x, y) for x in group[0] for y in group[1])
    return len(sides[0][0]), len(ids), len(shown), hashlib.sha256(";".join(shown).encode()).hexdigest(), links


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    from lacuna.llm.bpe import byte_alphabet

    a = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model")), byte_alphabet()


ODD = ["a", "B", " ", "  ", "\n", "\t", "é", "ﬁ", "日本", "😀", "<|endoftext|>", "<s>", "</s>", "don't", "123", "!!", "▁", "\x00", "\x1c", "\xa0", "　", "\r\n", "ing", "the ", "İ", "​", "é", "<0x0A>", "\x85", "   x"]


def test_alignment_equals_the_libraries(libraries):
    draw = random.Random(5)
    texts = [None, "", "a" * 9000] + ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 12))) for _ in range(1500)]
    aligner = alignment.Aligner(queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model"))
    for text, (*told, a, b, n) in zip(texts, aligner.align(texts), strict=True):
        *plain, links = aligned_plainly(text, *libraries)
        assert told == plain and dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)) == dict(links), text


@pytest.mark.parametrize(("heavy", "listed", "size"), [(1 << 17, 1 << 12, 1 << 20), (40, 2, 3000)])
def test_link_statistics_against_brute_force(spark, libraries, monkeypatch, heavy, listed, size):
    monkeypatch.setattr(alignment, "HEAVY", heavy)
    monkeypatch.setattr(alignment, "LISTED", listed)
    monkeypatch.setattr(alignment, "STEP_BYTES", size)
    texts = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").limit(120).collect()] + [(7, "same text"), (7, "same text"), (None, "same"), (8, None), (9, ""), (10, "a▁b"), (11, "\n")]
    made = spark.createDataFrame([(d, t, 1, "s") for d, t in texts], DOC).withColumnRenamed("extra", "row").repartition(3)
    found = alignment.link_statistics(made, queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model"))
    plain = [(d, *aligned_plainly(t, *libraries)) for d, t in texts]
    docs = Counter(pair for *_, links in plain for pair in links)
    best = Counter()
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    expected = [(d, na, nb, g, sum(links.values()), sum(n for p, n in links.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in links.items()), sha) for d, na, nb, g, sha, links in plain]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=key) == sorted(expected, key=key)


def test_alignment_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOC)
    assert alignment.link_statistics(empty, queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")).count() == 0
