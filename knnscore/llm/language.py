"""Language ID by averaged hashed subword embeddings and a linear softmax.

Features are byte 2-, 3- and 4-grams of the lower-cased text with everything that isn't a letter made a
space, hashed into buckets. The model is an embedding a bucket, their average over the text, a linear layer
and a softmax, trained by stochastic gradient descent in numpy on a bounded sample: at most SAMPLE_PER_LANG
labelled rows of each language, those of least hashed identifier, and fewer where more than SAMPLE_ROWS /
SAMPLE_PER_LANG languages share SAMPLE_ROWS. Of each row a window of TRAIN_CHARS characters is read, at a
hashed place. Every label is learned; a class costs 4 * BUCKETS bytes in each task. A
temperature calibrates the probabilities on a part of the sample that isn't trained on, and the rejection
threshold is the score below which only REJECT_SHARE of that part's right predictions fall, at most
MAX_THRESHOLD. Prediction covers every whole text; as the average and the linear layer commute, it sums one
row of class scores a feature.

Null text and text without any letter is `und` with score 0. A null identifier is not held out and not
learned from; nor is a null label. Without any labelled document everything is `und`. Repeated rows are
predicted alike. Empty input gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import documents, fresh

SAMPLE_PER_LANG, SAMPLE_ROWS = 400, 80_000
#: Shares of the input partitions that are cut to the sample's size before a language's rows meet.
SLOTS = 32
BUCKETS, DIM = 1 << 16, 16
GRAMS = (2, 3, 4)
#: A small sample is passed over more often, for STEPS batches at least.
EPOCHS, STEPS, BATCH, RATE = 6, 600, 16, 4.0
TRAIN_CHARS = 3000
REJECT_SHARE, MAX_THRESHOLD = 0.0005, 0.5
UNKNOWN = "und"
#: Bytes at a time, to bound memory on very long texts.
BLOCK = 1 << 20
#: ASCII bytes that aren't letters become spaces; bytes of other characters stay.
_LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint8)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def features(text: str) -> np.ndarray:
    """Bucket of every n-gram of the text."""
    return np.concatenate(list(feature_blocks(text)) or [np.zeros(0, dtype=np.int64)])


def feature_blocks(text: str) -> Iterator[np.ndarray]:
    """features(), a block of the text at a time."""
    raw = b" " + text.lower().encode("utf-8", "surrogatepass") + b" "
    raw = _LETTERS[np.frombuffer(raw, dtype=np.uint8)]
    # runs of spaces carry nothing
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    raw = raw[keep]
    top = max(GRAMS)
    for at in range(0, len(raw), BLOCK):
        b = raw[at : at + BLOCK + top - 1].astype(np.uint32)
        out = []
        for n in GRAMS:
            m = min(BLOCK, len(raw) - at - n + 1, len(b) - n + 1)
            if m <= 0:
                continue
            v = b[:m].copy()
            for k in range(1, n):
                v |= b[k : k + m] << np.uint32(8 * k)
            v ^= np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            v *= np.uint32(0x85EBCA6B)
            v ^= v >> np.uint32(13)
            v *= np.uint32(0xC2B2AE35)
            out.append((v >> np.uint32(16)).astype(np.int64) % BUCKETS)
        if out:
            yield np.concatenate(out)


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # buckets x languages: embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for block in feature_blocks(text):
            total += self.scores[block].sum(axis=0, dtype=np.float64)
            n += len(block)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability, and whether it is rejected."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        p = _softmax(self.logits(text)[None] / self.temperature)[0]
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 42) -> Model:
    """Fit on (text, language) rows; every fifth is kept for calibration."""
    rows = [(t, y) for t, y in rows if has_letter(t)]
    langs = sorted({y for _, y in rows})
    rng = np.random.default_rng(seed)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros(0), 1.0, 0.0)
    order = rng.permutation(len(rows))
    spare, used = order[::5] if len(rows) >= 20 else order[:0], np.array([i for k, i in enumerate(order) if k % 5 or len(rows) < 20])
    emb, out, bias = (rng.normal(0, 0.1, (BUCKETS, DIM))), rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    gold = np.array([langs.index(y) for _, y in rows])
    # training takes one window of a text a step, of varied length, so that short texts are learned too; prediction takes all of it
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(used)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        rng.shuffle(used)
        for at in range(0, len(used), BATCH):
            batch = used[at : at + BATCH]
            feats = []
            for i in batch:
                t = rows[i][0]
                n = min(len(t), int(rng.choice([20, 60, 200, 800, TRAIN_CHARS])))
                s = int(rng.integers(0, len(t) - n + 1))
                feats.append(features(t[s : s + n]))
            avg = np.stack([emb[f].mean(axis=0) if len(f) else np.zeros(DIM) for f in feats])
            g = _softmax(avg @ out + bias)
            g[np.arange(len(batch)), gold[batch]] -= 1
            g /= len(batch)
            back = g @ out.T
            out -= rate * avg.T @ g
            bias -= rate * 0.1 * g.sum(axis=0)
            for f, d in zip(feats, back, strict=True):
                if len(f):
                    np.subtract.at(emb, f, rate * BATCH * d / len(f))
    model = Model(langs, (emb @ out).astype(np.float32), bias, 1.0, 0.0)
    if len(spare):
        z, y = np.stack([model.logits(rows[i][0]) for i in spare]), gold[spare]
        model.temperature = min((float(-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()), t) for t in np.geomspace(0.25, 5, 31))[1]
        p = _softmax(z / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        if len(right):
            model.threshold = float(min(MAX_THRESHOLD, np.quantile(right, REJECT_SHARE)))
    return model


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def least_of_each(rows: DataFrame, each: int, *order: str) -> DataFrame:
    """The first `each` rows of every language. Each of SLOTS shares of the partitions is cut to that many first, so a language's
    last window holds SLOTS * each rows at most, however many partitions there are."""
    slot, k = fresh(rows, "_slot", "_k")
    rows = rows.withColumn(slot, F.spark_partition_id() % SLOTS)
    for by in (["lang", slot], ["lang"]):
        rows = rows.withColumn(k, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(k) <= each).drop(k)
    return rows.drop(slot)


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """The bounded training sample: rows are chosen by identifier and label alone, then windows of their texts are read."""
    ids = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id") & (F.col("lang") != UNKNOWN)
    )
    each = max(1, min(SAMPLE_PER_LANG, SAMPLE_ROWS // max(1, ids.select("lang").distinct().count())))
    hashed = F.xxhash64(F.lit(8), "id")
    chosen = least_of_each(ids.withColumn("h", hashed), each, "h", "id").select("id").distinct()
    # at most SAMPLE_ROWS identifiers, or one a language: a proven bound; rows that share one are counted again
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(chosen), "id", "left_semi")
    rows = rows.where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull())
    spare = F.greatest(F.lit(1), F.char_length("text") - TRAIN_CHARS + 1)
    at = F.pmod(F.xxhash64(F.lit(9), "id"), spare.cast("long")).cast("int") + 1
    rows = rows.select("id", "lang", hashed.alias("h"), F.substr("text", at, F.lit(TRAIN_CHARS)).alias("text"))
    got = least_of_each(rows, each, "h", "id", "text").select("text", "lang", "id").collect()
    return [(r.text, r.lang) for r in sorted(got, key=lambda r: (r.id, r.lang, r.text))]


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred string, score double and rejected boolean; names that docs uses already get a leading underscore."""
    names = fresh(docs, "lang_pred", "score", "rejected")
    added = StructType().add(names[0], "string").add(names[1], "double").add(names[2], "boolean")
    schema = StructType([*docs.schema.fields, *added.fields])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(t.as_py()) for t in b.column(at)]
            cols = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language isn't rejected, with all their columns. The model is trained on docs."""
    out = predict(docs, train(sample(docs, id_col, text_col, lang_col)), text_col)
    return out.where(~F.col(out.columns[-1])).select(*docs.columns)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = predict(docs.select("doc_id", "text"), train(sample(docs)))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
