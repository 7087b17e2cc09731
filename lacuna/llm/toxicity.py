"""Toxicity: a convolutional text classifier trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its prefixes. Filters of widths 1, 2 and 3 run over
the whole text, a rectifier and a maximum over time follow, and a logistic unit weighs the maxima. The first embedding
coordinate starts as the shrunken log-odds of its bucket among toxic training texts; all weights are then trained by
stochastic gradient descent, in which a text meets these log-odds as they are without it, the more so
the more positives there are. On a held-back fifth of the training rows, a threshold is chosen for all rows and for each
language (guessed from the text's stop words), which is drawn towards the common one the more the fewer rows it has; a
score is the logistic of the distance from its language's threshold, so 0.5 is the cut.

Training takes a bounded sample of labelled rows, at most 2 * TRAIN_ROWS with TRAIN_BYTES of text in all; every text is
scored whole.

Cases: null and blank texts have no words and get the score of an empty text; rows without a label, null labels and null
ids are not learned from; a repeated text counts once in training; without a positive and a negative label all scores
are 0; an empty table gives an empty result; other columns are ignored by the score and kept by the filter.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import arrow_map, bucket_of, materialize, per_worker, ship

TRAIN_ROWS, TRAIN_BYTES = 6_000, 24_000_000
BUCKETS, DIM, FILTERS, WIDTHS, EPOCHS, RATE = 1 << 18, 8, 6, (1, 2, 3), 4, 0.08
#: Positives at which half of a text's own count is left out of its log-odds.
FEW_POSITIVES = 50
#: The longest step of a text's gradient before the rate.
CLIP = 5.0
#: Texts that the log-odds of a bucket count as beside its own; texts that a bucket needs for log-odds other than 0.
PRIOR, LEAST_TEXTS = 5.0, 3
PREFIXES = (4, 6)
#: Positives that thresholds are chosen on, at least; rows that the common threshold counts as beside a language's own.
LEAST_CALIBRATING, SHRINK = 10, 20
#: Words whose vectors a worker keeps, at most.
MEMO_WORDS = 200_000
_WORD = re.compile(r"[^\W_]+")
#: Frequent words that tell the language of a text for its threshold (fixed values).
LANGUAGES = {
    "en": frozenset("the of and to in is that it for was with as on be at by this from are or an".split()),
    "de": frozenset("der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()),
    "fr": frozenset("de la le et les des en un du une que est pour qui dans par sur au avec pas".split()),
    "es": frozenset("de la que el en y los del se las por un para con una su al lo como es".split()),
}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def language_of(words: list[str]) -> str:
    counts = {name: sum(map(stops.__contains__, words)) for name, stops in LANGUAGES.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def features(word: str) -> list[int]:
    parts = [word, *(f"{word[:k]}\0" for k in PREFIXES if len(word) > k)]
    return [xxhash.xxh32_intdigest(p.encode()) % BUCKETS for p in parts]


class Coded:
    """Texts as numbers of words, with the features of all words side by side: a few bytes a word, where lists take hundreds."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.parts, self.ends = array("i"), array("i", [0])

    def text(self, words: list[str]) -> "Words":
        for w in words:
            if w not in self.numbers:
                self.numbers[w] = len(self.numbers)
                self.parts.extend(features(w))
                self.ends.append(len(self.parts))
        return Words(self, np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))


class Words(Sequence):
    """The features of each word of a coded text."""

    def __init__(self, coded: Coded, numbers: np.ndarray):
        self.coded, self.numbers = coded, numbers

    def __len__(self) -> int:
        return len(self.numbers)

    def __getitem__(self, i: int) -> list[int]:
        n = self.numbers[i]
        return self.coded.parts[self.coded.ends[n] : self.coded.ends[n + 1]].tolist()

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        parts, ends = np.frombuffer(self.coded.parts, np.intc), np.frombuffer(self.coded.ends, np.intc)
        sizes = (ends[self.numbers + 1] - ends[self.numbers]).astype(np.int64)
        edges = np.cumsum(sizes) - sizes
        return parts[np.repeat(ends[self.numbers] - edges, sizes) + np.arange(sizes.sum())].astype(np.int64), edges


def flat_of(ids: Sequence[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all words of a text, and where each word's begin."""
    if isinstance(ids, Words):
        return ids.flat()
    return np.array([f for word in ids for f in word], np.int64), np.cumsum([0, *map(len, ids)])[:-1]


class ToxicityModel:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.table[:, 0] = 0
        self.kernels = [rng.normal(0, 0.1, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.offsets = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        for kernel in self.kernels:
            kernel[:, 0, :2] = [1.0, 0.5]
        self.out = np.full(FILTERS * len(WIDTHS), 0.2, np.float32)
        self.bias, self.thresholds, self.common, self.scale = -2.0, {}, 0.0, 1.0
        self.trained = False

    def maxima(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Per text the maxima of all filters; x holds each text's words and then two zero rows."""
        last, out = starts + sizes, []
        for kernel, offset in zip(self.kernels, self.offsets, strict=True):
            h = x @ kernel[0]
            for j in range(1, len(kernel)):
                h[:-j] += x[j:] @ kernel[j]
            h += offset
            h[last], h[last + 1] = -np.inf, -np.inf
            out.append(np.maximum.reduceat(h, starts, axis=0))
        return np.maximum(np.concatenate(out, 1), 0)

    def _train_one(self, ids: Sequence[list[int]], label: int, weight: float, rate: float, without: np.ndarray) -> None:
        flat, edges = flat_of(ids)
        x = np.zeros((len(ids) + 2, DIM), np.float32)
        x[: len(ids)] = np.add.reduceat(self.table[flat], edges, axis=0)
        x[: len(ids), 0] += np.add.reduceat(without[flat], edges)
        tops, values = [], []
        for kernel, offset in zip(self.kernels, self.offsets, strict=True):
            h = x @ kernel[0]
            for j in range(1, len(kernel)):
                h[:-j] += x[j:] @ kernel[j]
            h = h[: len(ids)] + offset
            tops.append(top := h.argmax(0))
            values.append(h[top, np.arange(FILTERS)])
        z = np.concatenate(values)
        active = z > 0
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.out @ (z * active)) + self.bias))))
        g = np.float32(weight * (p - label))
        back = g * self.out * active
        # A step no longer than CLIP, so that a text of large values can't throw the weights off.
        tall = np.concatenate([sum((x[top + j] ** 2).sum(1) for j in range(k)) for k, top in zip(WIDTHS, tops, strict=True)])
        rate *= min(1.0, CLIP / max(1e-12, float(np.sqrt(((g * z * active) ** 2).sum() + (back**2 * tall).sum()))))
        self.out -= rate * (g * z * active + 1e-4 * self.out)
        self.bias -= rate * float(g)
        for w, (kernel, offset, top) in enumerate(zip(self.kernels, self.offsets, tops, strict=True)):
            d = back[w * FILTERS : (w + 1) * FILTERS]
            for f in np.flatnonzero(d):
                for j in range(len(kernel)):
                    t = int(top[f]) + j
                    if t < len(ids):
                        step = rate * d[f] * kernel[j, :, f]
                        kernel[j, :, f] -= rate * d[f] * x[t]
                        rows = np.array(ids[t])
                        self.table[rows] -= step / len(rows)
            offset -= rate * d

    def fit(self, texts: list[str | None], labels: list[int], seed: int = 1) -> "ToxicityModel":
        seen, coded, docs = dict(zip(texts, labels, strict=True)), Coded(), []
        del texts, labels
        for text in sorted(seen, key=lambda t: zlib.crc32((t or "").encode())):
            y = seen.pop(text)  # one text's words at a time: only their numbers stay
            words = words_of(text)
            docs.append((coded.text(words or [""]), int(y), language_of(words)))
        coded.numbers.clear()
        held, train = docs[::5], [d for i, d in enumerate(docs) if i % 5]
        positive = sum(y for _, y, _ in train)
        if not positive or positive == len(train) or not any(y for _, y, _ in held):
            return self
        # With few positives a neutral word without its own text points the wrong way, so that the less of it is taken.
        without = [w * np.float32(positive / (positive + FEW_POSITIVES)) for w in self._log_odds(train, positive / len(train))]
        rng, weights = np.random.default_rng(seed), (len(train) / 2 / (len(train) - positive), len(train) / 2 / positive)
        for epoch in range(EPOCHS):
            for i in rng.permutation(len(train)):
                ids, y, _ = train[i]
                self._train_one(ids, y, weights[y], RATE / (1 + epoch), without[y])
        self.trained = True
        # Too few positives set no cut; then all rows set it.
        self._calibrate(held if sum(y for _, y, _ in held) >= LEAST_CALIBRATING else train + held)
        return self

    def _log_odds(self, train: list, share: float) -> list[np.ndarray]:
        """First coordinate: log of the toxic share of a bucket's texts over the share of all, shrunk towards 0.

        Returns by label what a text of that label must add to see each of its buckets as if it hadn't been counted.
        """
        n, toxic = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
        for ids, y, _ in train:
            found = np.unique(flat_of(ids)[0])
            n[found] += 1
            toxic[found] += y

        def odds(n: np.ndarray, toxic: np.ndarray) -> np.ndarray:
            return np.clip(np.log((np.maximum(toxic, 0) + PRIOR * share) / (np.maximum(n, 0) + PRIOR) / share), -1, 3) * (n >= LEAST_TEXTS)

        self.table[:, 0] = odds(n, toxic)
        return [(odds(n - 1, toxic - y) - self.table[:, 0]).astype(np.float32) for y in (0, 1)]

    def _calibrate(self, held: list) -> None:
        z = self.logits_of([ids for ids, _, _ in held])
        y = np.array([d[1] for d in held])
        self.common = _threshold(z, y)
        for name in {d[2] for d in held}:
            own = np.array([d[2] == name for d in held])
            if n := min(y[own].sum(), (1 - y[own]).sum()):
                self.thresholds[name] = float((n * _threshold(z[own], y[own]) + SHRINK * self.common) / (n + SHRINK))
        self.scale = 2.0 / max(1e-3, float(np.std(z)))

    def logits_of(self, docs: list[Sequence[list[int]]]) -> np.ndarray:
        out = []
        for ids in docs:
            x = np.zeros((len(ids) + 2, DIM), np.float32)
            flat, edges = flat_of(ids)
            x[: len(ids)] = np.add.reduceat(self.table[flat], edges, axis=0)
            out.append(float(self.maxima(x, np.array([0]), np.array([len(ids)]))[0] @ self.out) + self.bias)
        return np.array(out)


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """Midway between the logits where the F1 score is best."""
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + y.sum())
    f1[:-1][z[order][:-1] == z[order][1:]] = -1
    k = int(np.argmax(f1))
    low = z[order][k + 1] if k + 1 < len(z) else z[order][k] - 1.0
    return float((z[order][k] + low) / 2)


class Scorer:
    """Scores texts with a trained model, remembering word vectors."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.memo: dict[str, int] = {}
        self.vectors = np.zeros((1024, DIM), np.float32)

    def _place(self, word: str) -> int:
        at = self.memo[word] = len(self.memo)
        if at >= len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[at] = self.model.table[features(word)].sum(0)
        return at

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.model.trained or not texts:
            return np.zeros(len(texts))
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.vectors = {}, np.zeros((1024, DIM), np.float32)
        memo, place = self.memo, self._place
        rows = [words_of(t) for t in texts]
        cuts = [self.model.thresholds.get(language_of(r), self.model.common) for r in rows]
        ids = [[memo[w] if w in memo else place(w) for w in r or [""]] for r in rows]
        sizes = np.array([len(r) for r in ids])
        starts = np.cumsum([0, *(sizes + 2)])[:-1]
        x = np.zeros((int(sizes.sum()) + 2 * len(ids), DIM), np.float32)
        for start, r in zip(starts, ids, strict=True):
            x[start : start + len(r)] = self.vectors[r]
        z = self.model.maxima(x, starts, sizes) @ self.model.out + self.model.bias
        return 1 / (1 + np.exp(-np.clip(self.model.scale * (z - np.array(cuts)), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, folds: int = 5, budget: int = TRAIN_BYTES) -> ToxicityModel:
    """Learns from about rows labelled documents, at most twice as many, whose fold isn't 0; they are taken by a hash of the id.

    Texts that would pass the budget of bytes are left out, in the order of that hash.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), folds) != 0)).select("doc_id", "toxic")
    share = min(1.0, rows / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * rows)
    drawn = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").limit(2 * rows)
    drawn = materialize(drawn.withColumn("rank", F.xxhash64("doc_id")).withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0))), "toxic-sample")
    held, left = [], budget
    for r in drawn.select("rank", "bytes").distinct().orderBy("rank", "bytes").collect():  # numbers of 2 * rows documents at most
        if r["bytes"] <= left:
            held.append((r["rank"], r["bytes"]))
            left -= r["bytes"]
    fits = drawn.sparkSession.createDataFrame(held, "rank long, bytes int")
    # A partition at a time, so that the driver never holds the sample's texts as a result, as Arrow and as strings at once.
    taken = [tuple(r) for r in drawn.join(F.broadcast(fits), ["rank", "bytes"], "left_semi").select("doc_id", "text", "toxic").toLocalIterator()]
    taken.sort(key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    return ToxicityModel().fit(*_texts_out_of(taken))


def _texts_out_of(taken: list[tuple]) -> tuple[list[str | None], list[int]]:
    """The texts and labels, which taken and the caller then hold no more, so that training frees each as it is coded."""
    texts, labels = [r[1] for r in taken], [r[2] for r in taken]
    taken.clear()
    return texts, labels


def _scorer(sent, key: str):
    return per_worker(("toxic", key), lambda: Scorer(sent()))


def _ship(docs: DataFrame, model: ToxicityModel):
    """The model as a broadcast; its size is set by its parameters, not by data."""
    name = xxhash.xxh64_hexdigest(model.table.tobytes() + model.out.tobytes())
    return ship(docs.sparkSession, model), name


def score_documents(docs: DataFrame, model: ToxicityModel, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    sent, name = _ship(docs, model)

    def make():
        scorer = _scorer(sent, name)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = scorer.scores(batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return step

    source = docs.select("doc_id", (bucket_of(F.col("doc_id"), folds) == 0).alias("held_out"), "text")
    return arrow_map(source, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The documents with a score under 0.5, all columns kept."""
    sent, name = _ship(docs, model)

    def make():
        scorer = _scorer(sent, name)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array(scorer.scores(batch.column(text_col).to_pylist()) < 0.5))

        return step

    return arrow_map(docs, make, docs.schema)
