"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts is the number of n-grams (n = 1 .. 4, over letters with single spaces
between words) that both hold, over the geometric mean of how many each holds; n-grams are hashed into FEATURES places.
A bounded sample of training texts gives Nyström landmarks, and one-versus-rest kernel ridge regression is solved in
their span. Texts are scored in batches by two matrix products: presence by landmarks, kernel rows by weights.

Training takes at most TRAIN_ROWS texts; every text is scored whole.

Cases: null texts and texts without a letter are `und` with score 0; training rows with a null language are left out;
with no training row at all every text is `und`; with one language every text with a letter gets it; repeated rows are
all returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import arrow_map, bucket_of, per_worker, ship

TRAIN_ROWS, LANDMARKS, RIDGE = 3_000, 128, 1e-3
ORDERS, FEATURES = (1, 2, 3, 4), 1 << 13
#: Texts of a batch of presence rows.
ROWS = 128
_LETTERS = re.compile(r"[^\W\d_]+")


def clean(text: str | None) -> str:
    found = _LETTERS.findall((text or "").lower())
    return f" {' '.join(found)} " if found else ""


def presence(texts: list[str]) -> np.ndarray:
    """A row for each cleaned text: 1 where an n-gram of it is hashed to."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in zip(out, texts, strict=True):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        mixed = np.zeros(len(points), np.uint32)
        for order in ORDERS:
            n = len(points) - order + 1
            if n <= 0:
                break
            mixed = (mixed[:n] ^ points[order - 1 :]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            row[(mixed * np.uint32(0x85EBCA77)) >> np.uint32(19)] = 1
    return out


def normalized(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


class LanguageModel:
    def __init__(self, texts: list[str | None], langs: list[str], seed: int = 3):
        kept = [(c, lang) for c, lang in ((clean(t), lang) for t, lang in zip(texts, langs, strict=True)) if c and lang is not None]
        self.langs = sorted({lang for _, lang in kept})
        if not kept:
            return
        rng = np.random.default_rng(seed)
        marks: list[int] = []
        for lang in self.langs:  # landmarks from each language alike
            own = [i for i, (_, x) in enumerate(kept) if x == lang]
            marks += rng.permutation(own)[: max(1, LANDMARKS // len(self.langs))].tolist()
        self.landmarks = normalized(presence([kept[i][0] for i in sorted(marks)])).T.copy()
        k = np.concatenate([self.kernel([c for c, _ in kept[at : at + ROWS]]) for at in range(0, len(kept), ROWS)]).astype(np.float64)
        y = np.array([[1.0 if lang == x else -1.0 for x in self.langs] for _, lang in kept])
        among = k[sorted(marks)]
        balance = np.sqrt(1 / np.array([sum(x == lang for _, x in kept) for _, lang in kept]))[:, None]
        kb, yb = k * balance, y * balance
        self.weights = np.linalg.lstsq(kb.T @ kb + RIDGE * len(self.langs) * (among + among.T) / 2 + 1e-9 * np.eye(len(marks)), kb.T @ yb, rcond=None)[0].astype(np.float32)

    def kernel(self, texts: list[str]) -> np.ndarray:
        return normalized(presence(texts)) @ self.landmarks

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        cleaned = [clean(t) for t in texts]
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        rows = [i for i, c in enumerate(cleaned) if c] if self.langs else []
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            f = self.kernel([cleaned[i] for i in some]) @ self.weights
            best = f.argmax(1)
            for i, b, v in zip(some, best, f[np.arange(len(some)), best], strict=True):
                langs[i], scores[i] = self.langs[b], min(1.0, max(0.0, (float(v) + 1) / 2))
        return langs, scores


def train(docs: DataFrame, rows: int = TRAIN_ROWS, folds: int = 4, held_out: int = 2) -> LanguageModel:
    """Learns from about rows documents whose fold isn't held_out, taken by a hash of id and text."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(bucket_of(F.col("doc_id"), folds) != held_out, F.lit(False))).select("doc_id", "text", "lang")
    share = min(1.0, rows / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * rows).toPandas()
    some = some.sort_values(["doc_id", "text", "lang"])
    return LanguageModel(some["text"].tolist(), some["lang"].tolist())


def predict_documents(docs: DataFrame, model: LanguageModel, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    sent = ship(docs.sparkSession, model)  # its size is set by LANDMARKS and FEATURES
    name = xxhash.xxh64_hexdigest(model.weights.tobytes() + model.landmarks.tobytes()) if model.langs else "none"

    def make():
        own = per_worker(("language", name), sent)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = own.predict(batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

        return step

    source = docs.select("doc_id", (bucket_of(F.col("doc_id"), folds) == held_out).alias("held_out"), "text")
    return arrow_map(source, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
