"""Quality: a byte-level convolutional network trained in numpy.

Filters run over all bytes of a text. Their activations are max-pooled in overlapping chunks (CHUNK bytes, half of each
shared with the next) that cover the whole text; a hidden layer sees each chunk, and its units' maxima and means over all
chunks are combined into one probability. All weights, byte vectors included, are learned by Adam on whole texts. On a
held-back fifth of the training rows the cut is chosen, and a score is the logistic of the distance from it.

Training takes TRAIN_ROWS labelled rows and TRAIN_BYTES bytes of text at most, in the order of a hash of the id; every
text is scored whole.

Cases: null texts count as empty, empty ones are a chunk of zero bytes; rows without a label, null labels and null ids are
not learned from; without two classes among the training rows all scores are the share of label 1 (0 without a row);
repeated rows are all scored; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import arrow_map, bucket_of, per_worker, ship

TRAIN_ROWS, TRAIN_BYTES = 4_000, 12_000_000
CHUNK, DIM, WIDTH, FILTERS, HIDDEN = 512, 8, 6, 24, 12
EPOCHS, LEAST_SHOWN, BATCH, RATE = 5, 6_000, 8, 0.004
#: Every so many training texts, one is also shown by a short stretch alone, as short texts are few; its bytes, at least and at most.
SHORT_EVERY, SHORT = 8, (24, 400)
#: Bytes scored at once: a longer text goes through in parts of this size.
STEP_BYTES = 1 << 18
_HALF = CHUNK // 2


def bytes_of(text: str | None) -> tuple[np.ndarray, int]:
    """The text's UTF-8 bytes, filled up with zeros to whole halves of a chunk, at least one chunk; and how many they are."""
    data = (text or "").encode()
    size = max(CHUNK, -(-len(data) // _HALF) * _HALF)
    return np.frombuffer(data + bytes(size - len(data)), np.uint8), len(data)


class QualityModel:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.w = {
            "bytes": init(256, DIM, scale=0.5),
            "filters": init(WIDTH, DIM, FILTERS, scale=0.3),
            "offset": np.zeros(FILTERS, np.float32),
            "hidden": init(FILTERS + 1, HIDDEN, scale=0.3),
            "hidden_offset": np.full(HIDDEN, 0.1, np.float32),
            "out": init(2 * HIDDEN, scale=0.3),
            "bias": np.zeros(1, np.float32),
        }
        self.cut, self.constant, self.tables = 0.0, 0.0, None

    def blocks(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(maxima, their places) of all filters in each half chunk; a filter reaches into the next half, at the end into zeros."""
        x = self.w["bytes"][np.concatenate([data, np.zeros(WIDTH - 1, np.uint8)])]
        h = sum(x[j : j + len(data)] @ self.w["filters"][j] for j in range(WIDTH)).reshape(-1, _HALF, FILTERS)
        places = h.argmax(1)
        return np.take_along_axis(h, places[:, None], 1)[:, 0] + self.w["offset"], places

    def head(self, halves: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """Chunks (maxima of the filters, and the share of a chunk that is text), hidden units, pooled units and the logit; size: bytes of the text."""
        filled = np.clip((size - _HALF * np.arange(len(halves) - 1)) / CHUNK, 0, 1).astype(np.float32)
        chunks = np.concatenate([np.maximum(np.maximum(halves[:-1], halves[1:]), 0), filled[:, None]], 1)
        units = np.maximum(chunks @ self.w["hidden"] + self.w["hidden_offset"], 0)
        pooled = np.concatenate([units.max(0), units.mean(0)])
        return chunks, units, pooled, float(pooled @ self.w["out"] + self.w["bias"][0])

    def gradient(self, data: np.ndarray, size: int, label: int, weight: float, grad: dict[str, np.ndarray]) -> None:
        halves, places = self.blocks(data)
        chunks, units, pooled, z = self.head(halves, size)
        g = np.float32(weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label))
        grad["out"] += g * pooled
        grad["bias"] += g
        up = np.zeros_like(units) + g * self.w["out"][HIDDEN:] / len(units)
        up[units.argmax(0), np.arange(HIDDEN)] += g * self.w["out"][:HIDDEN]
        up *= units > 0
        grad["hidden"] += chunks.T @ up
        grad["hidden_offset"] += up.sum(0)
        down = ((up @ self.w["hidden"].T) * (chunks > 0))[:, :FILTERS]
        later = halves[1:] > halves[:-1]
        back = np.zeros_like(halves)
        back[:-1] += down * ~later
        back[1:] += down * later
        grad["offset"] += back.sum(0)
        row, f = np.nonzero(back)
        value, at = back[row, f], row * _HALF + places[row, f]
        padded = np.concatenate([data, np.zeros(WIDTH - 1, np.uint8)])
        for j in range(WIDTH):
            seen = padded[at + j]
            by_filter = np.zeros((256, FILTERS), np.float32)
            np.add.at(by_filter, (seen, f), value)
            grad["filters"][j] += self.w["bytes"].T @ by_filter
            grad["bytes"] += by_filter @ self.w["filters"][j].T

    def fit(self, texts: list[str | None], labels: list[int], seed: int = 7) -> "QualityModel":
        y = np.array(labels, np.int64)
        self.constant = float(y.mean()) if len(y) else 0.0
        held = np.arange(len(y)) % 5 == 0
        if len(set(y[~held].tolist())) < 2:
            return self
        data, rng = [bytes_of(t) for t in texts], np.random.default_rng(seed)
        train = np.flatnonzero(~held)
        for i in train[::SHORT_EVERY]:
            own = (texts[i] or "").encode()
            size = int(rng.integers(*SHORT))
            at = int(rng.integers(0, max(1, len(own) - size)))
            data.append(bytes_of(own[at : at + size].decode("utf-8", "ignore")))
            y = np.append(y, y[i])
        train = np.concatenate([train, np.arange(len(held), len(y))])
        share = y[train].mean()
        weights = (0.5 / (1 - share), 0.5 / share)
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs := max(EPOCHS, -(-LEAST_SHOWN // len(train)))):
            order = rng.permutation(train)
            for at in range(0, len(order), BATCH):
                grad = {k: np.zeros_like(v) for k, v in self.w.items()}
                some = order[at : at + BATCH]
                for i in some:
                    self.gradient(*data[i], int(y[i]), weights[y[i]] / len(some), grad)
                step += 1
                rate = RATE / (1 + EPOCHS * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grad.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.w[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
        self.tables = None
        judged = np.flatnonzero(held)
        judged = judged if len(set(y[judged].tolist())) == 2 else np.arange(len(held))
        self._cut(self.logits([data[i] for i in judged]), y[judged])
        self.constant, self.tables = None, None
        return self

    def _cut(self, z: np.ndarray, y: np.ndarray) -> None:
        """Midway in the gap where most are right."""
        order = np.argsort(z, kind="stable")
        right = np.cumsum(1 - 2 * y[order])
        right[:-1][z[order][:-1] == z[order][1:]] = -len(y)
        k = int(np.argmax(right))
        self.cut = float((z[order][k] + z[order][min(k + 1, len(z) - 1)]) / 2)

    def _pair_tables(self) -> list[np.ndarray]:
        """What each two neighbouring bytes add to each filter, for all but the first two places shared by rows."""
        one = [self.w["bytes"] @ self.w["filters"][j] for j in range(WIDTH)]
        return [(one[j][:, None] + one[j + 1][None]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]

    def halves(self, data: np.ndarray) -> np.ndarray:
        """The maxima of blocks(), by table, a part of the text at a time."""
        self.tables = self.tables or self._pair_tables()
        padded, out = np.concatenate([data, np.zeros(WIDTH, np.uint8)]), []
        for at in range(0, len(data), STEP_BYTES):
            size = min(STEP_BYTES, len(data) - at)
            part = padded[at : at + size + WIDTH].astype(np.int32)
            pairs = part[:-1] << 8 | part[1:]
            h = self.tables[0][pairs[:size]]
            for k in range(1, len(self.tables)):
                h += self.tables[k][pairs[2 * k : 2 * k + size]]
            out.append(h.reshape(-1, _HALF, FILTERS).max(1))
        return np.concatenate(out) + self.w["offset"]

    def logits(self, data: Iterable[tuple[np.ndarray, int]]) -> np.ndarray:
        return np.array([self.head(self.halves(points), size)[3] for points, size in data])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = self.logits(map(bytes_of, texts))
        return 1 / (1 + np.exp(-np.clip(z - self.cut, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES, folds: int = 3, held_out: int = 1) -> QualityModel:
    """Learns from labelled documents whose fold isn't held_out: rows of them and size bytes at most, by a hash of the id."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), folds) != held_out)).select("doc_id", "quality")
    share = min(1.0, 1.1 * rows / max(1, known.count()))
    # twice the rows at most reach the one task that adds their sizes up, and these as ids and lengths alone
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * rows)
    own = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    sizes = own.select("doc_id", "quality", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    order = Window.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id", "bytes").rowsBetween(Window.unboundedPreceding, 0)
    taken = sizes.select("doc_id", F.sum("bytes").over(order).alias("upto"), F.count("*").over(order).alias("n")).where((F.col("upto") <= size) & (F.col("n") <= rows)).select("doc_id").distinct()
    found = own.join(F.broadcast(taken), "doc_id").select("doc_id", "text", "quality").limit(rows).toPandas().sort_values(["doc_id", "text"], na_position="first")
    found = found.iloc[np.argsort([xxhash.xxh32_intdigest(str(i)) for i in found["doc_id"]], kind="stable")]
    return QualityModel().fit(found["text"].where(found["text"].notna(), None).tolist(), found["quality"].tolist())


def score_documents(docs: DataFrame, model: QualityModel, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    sent = ship(docs.sparkSession, model)  # its size is set by the layers' sizes
    name = xxhash.xxh64_hexdigest(b"".join(v.tobytes() for v in model.w.values()) + repr((model.cut, model.constant)).encode())

    def make():
        own = per_worker(("quality", name), sent)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = own.scores(batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return step

    source = docs.select("doc_id", (bucket_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "text")
    return arrow_map(source, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
