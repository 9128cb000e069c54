"""Language identification by sparse multinomial logistic regression.

Features are character n-grams (orders 1 to 4 of the lower-cased text, every run of
other characters than letters being one space), hashed to DIM columns, with
sublinear term frequency, inverse document frequency and unit length. Weights come
from follow-the-regularised-leader with L1 and L2 penalties, and a temperature is
then fitted on rows that training did not see.

Document frequencies cover all training rows. The weights are fitted on at most
SAMPLE labelled rows, equally many for each language, those with the smallest hash
of id and text: a fixed bound on what the driver holds. Every whole text is scored.

Defined results: `und` with score 0 for a null text or one without a letter, and for
every text if there is no labelled row; with one language in training, that language
with score 1. Ties of scores go to the language that is first by code point. Repeated
rows count once in the sample and are predicted alike; an empty table gives no rows;
bytes that are no UTF-8 are U+FFFD each; more than SAMPLE languages are an error.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from . import common

DIM = 1 << 15
ORDERS = 4
#: Labelled rows that the weights and the temperature are fitted on, and languages at most.
SAMPLE = 4000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
UNKNOWN = "und"
#: Characters that are hashed at once.
BLOCK = 1 << 18


@cache
def letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)])


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram is in the text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(letters()[c], c, np.uint32(32))
    c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]] if len(c) else c
    out = np.zeros(DIM, np.int64)
    for at in range(0, len(c), BLOCK):
        x = c[at : at + BLOCK + ORDERS - 1]
        h = np.zeros(len(x), np.uint32)
        for n in range(1, ORDERS + 1):
            starts = min(BLOCK, len(x) - n + 1)
            if starts <= 0:
                break
            h = h[:starts] * np.uint32(0x01000193) ^ x[n - 1 : n - 1 + starts] * np.uint32(2 * n + 1)
            out += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15), minlength=DIM)
    return out


def weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of the unit TF-IDF vector with n n-grams in the columns at."""
    x = ((1 + np.log(n)) * idf[at]).astype(np.float32)
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and weights of the text's unit TF-IDF vector."""
    n = counts(text)
    at = np.flatnonzero(n)
    return at, weighted(at, n[at], idf)


def packed(text: str) -> bytes:
    """The text's columns and counts, compressed: a quarter of its vector, because steps between columns and counts are small."""
    n = counts(text)
    at = np.flatnonzero(n)
    return zlib.compress(np.diff(at, prepend=0).astype("<u2").tobytes() + n[at].astype("<i8").tobytes())


class Rows:
    """Vectors of packed texts, each unpacked when it is asked for."""

    def __init__(self, texts: list[bytes], idf: np.ndarray) -> None:
        self.texts, self.idf = texts, idf

    def __len__(self) -> int:
        return len(self.texts)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        raw = zlib.decompress(self.texts[i])
        size = len(raw) // 10
        at = np.cumsum(np.frombuffer(raw, "<u2", size), dtype=np.int64)
        return at.astype("<u2"), weighted(at, np.frombuffer(raw, "<i8", size, 2 * size), self.idf)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        at, x = features(text, self.idf)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]] | Rows, labels: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIM, k) and bias by FTRL-proximal with elastic net, one row at a time."""
    z, n = np.zeros((DIM + 1, k), np.float32), np.zeros((DIM + 1, k), np.float32)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0).astype(np.float32)

    random = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, at.dtype.type(DIM)), np.append(x, np.float32(1))
            w = weights(z[at], n[at])
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = np.outer(x, p)
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    w = weights(z, n)
    return w[:DIM], w[DIM]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search over its logarithm."""

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), labels]).mean())

    low, high, golden = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(train: DataFrame) -> tuple[int, np.ndarray]:
    """Training rows and, for each column, those that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIM, np.int64)
        for b in batches:
            for x in b.column("text").to_pylist():
                df += counts(x.decode(errors="replace")) > 0
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["at", "n"])

    sums = train.select(common.utf8(F.col("text")).alias("text")).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n"))
    n, out = 0, np.zeros(DIM, np.int64)
    for at, x in sums.collect():  # DIM + 1 rows at most
        if at < 0:
            n = x
        else:
            out[at] = x
    return n, out


def fit(docs: DataFrame, held_out: Column, sample: int = SAMPLE, seed: int = 7) -> Model | None:
    """A model from the rows of docs with text and lang that are not held out."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    train = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out)
    n, df = document_frequencies(train)
    if not n:
        return None
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    # rows with one hash are copies and count once; a language's smallest hashes lie below the quantile that has somewhat more than its part
    hashed = train.select("lang", "text", F.xxhash64("doc_id", "text", F.lit(seed)).alias("_hash"))
    sizes = {r[0]: r[1] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("_hash", 0.02)).limit(sample + 1).collect()}
    languages = sorted(sizes)
    if len(languages) > sample:
        raise ValueError(f"more than {sample} languages in the training rows")
    each = max(1, sample // len(languages))
    limits = {k: min(1.0, (1.08 * each + 5 * each**0.5 + 10) / n) for k, n in sizes.items()}
    most = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(min((1 << 63) - 1, int((v - 0.5) * 2.0**64))))])
    taken = hashed.filter(F.col("_hash") <= F.element_at(most, F.col("lang"))).dropDuplicates(["lang", "_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([packed(x.decode(errors="replace")) for x in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("_hash"), got], names=["lang", "_hash", "packed"])

    made = taken.select("lang", "_hash", common.utf8(F.col("text")).alias("text")).mapInArrow(run, "lang string, _hash long, packed binary")
    rows = sorted(made.collect(), key=lambda r: (r[1], r[0]))
    seen: dict[str, int] = {}
    kept = []
    for r in rows:
        seen[r[0]] = seen.get(r[0], 0) + 1
        if seen[r[0]] <= each:
            kept.append(r)
    index = {k: i for i, k in enumerate(languages)}
    y = np.array([index[r[0]] for r in kept])
    apart = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    seen_rows, others = (Rows([bytes(r[2]) for r, a in zip(kept, apart, strict=True) if a == which], idf) for which in (False, True))
    del rows, kept
    weights, bias = follow_the_leader(seen_rows, y[~apart], len(languages), seed)
    model = Model(languages, idf, weights, bias, 1.0)
    if apart.any():
        logits = np.stack([x @ weights[at] + bias for at, x in others])
        model.temperature = fit_temperature(logits, y[apart])
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score, from the text alone; own columns of these names are replaced."""
    spark, docs = docs.sparkSession, docs.drop("lang_pred", "score", "_language")
    common.bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # DIM rows at most

    def run(texts: Iterator[tuple]) -> Iterator:
        own = shared.value
        for text, known in texts:
            found = [own.predict(x.decode(errors="replace")) if k and own else (UNKNOWN, 0.0) for x, k in zip(text.to_pylist(), known.to_pylist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], ["lang_pred", "score"])
        common.give_back()

    udf = F.arrow_udf(run, "lang_pred string, score double", ArrowUDFType.SCALAR_ITER)
    text = F.col("text")
    got = docs.withColumn("_language", udf(common.utf8(text), F.coalesce(text.rlike(r"\p{L}"), F.lit(False))))
    return got.select("*", "_language.lang_pred", "_language.score").drop("_language")


def remainder(n: int) -> Column:
    """crc32 of the id as text modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def report(docs: DataFrame) -> DataFrame:
    held_out = remainder(4) == 2
    rows = docs.select("doc_id", "text", "lang")
    model = fit(rows, held_out)
    return predict(rows.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def recognised(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language the model, fitted on all their labels, knows with a score of at least `least`.

    Without labelled rows there is no language to know, and every row with a letter stays.
    """
    model = fit(docs.select("doc_id", "text", "lang"), F.lit(False))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text")
    found = predict(inner, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select("_doc.*")
