"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is letters, lower-cased, with one blank for everything else; its character runs of length
one to four are hashed into buckets. The mean of the buckets' embeddings goes through a linear
softmax. Embeddings and weights are trained together by stochastic gradient descent in numpy on a
sample of every language's documents, bounded for each of them; a part of the
sample is left out to fit the temperature that makes the scores probabilities. As the mean is
linear, a trained model is one row of logits per bucket.

A softmax is sure of any text, also of one in a language it never saw. So a text is rejected by what
is new in it: the share of its distinct runs of four that no training text of the predicted language
has, in a bitmap of hashed runs. The limit of a language lies between the shares of texts that were
left out of its training and those of texts of the other languages, and is raised where left-out
texts exceed it; short texts need a share further above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ..operators.materialize import materialize
from .common import slices, worker_store

BUCKETS = 1 << 13
RUNS = (1, 2, 3, 4)
DIM = 16
# At most so many documents of each language are sampled; with many languages fewer of each, so that
# all stay within TOTAL, but no fewer than FEWEST. Every language is a class. A sampled document
# takes the task that trains at most 64 KB, a language takes tasks 48 KB.
PER_LANGUAGE, TOTAL, FEWEST = 500, 4_000, 10
EPOCHS, RATE, BATCH = 30, 2.0, 32
# Bits of a language's map of runs; deviations that a short text has to lie above the limit; the share
# of left-out texts that may exceed it; and what a lone language takes for the share of others.
RUN_BITS, DEVIATIONS, REJECT_SHARE, FOREIGN = 1 << 17, 2.0, 0.005, 0.6
UNKNOWN = "und"
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def _letters() -> np.ndarray:
    store = worker_store("letters")
    if "known" not in store:
        store["known"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return store["known"]


def bucket_counts(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and how often each occurs, and the places of its runs in a map; none without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letters[codes]
    if not known.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    keep = known.copy()
    keep[1:] |= known[:-1]  # the first blank after a letter stays
    codes = np.r_[np.uint32(32), np.where(known, codes, 32).astype(np.uint32)[keep], np.uint32(32)]
    total = np.zeros(BUCKETS, np.int64)
    h = np.zeros(len(codes), np.uint32)
    runs = np.empty(0, np.int64)
    for n in RUNS:
        if len(codes) < n:
            break
        h = (h[:len(codes) - n + 1] * np.uint32(0x01000193)) ^ (codes[n - 1:] * _MULTIPLIERS[n - 1])
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        total += np.bincount(mixed >> np.uint32(32 - 13), minlength=BUCKETS)
        if n == RUNS[-1]:
            runs = np.flatnonzero(np.bincount((mixed >> np.uint32(4)) % np.uint32(RUN_BITS), minlength=RUN_BITS))
    at = np.flatnonzero(total)
    return at, total[at], runs


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logits: np.ndarray  # per bucket and language, already divided by the temperature
    bias: np.ndarray
    runs: np.ndarray  # per language, whether training texts have the run at a place
    limits: np.ndarray  # per language, the share of new runs from which a text is rejected

    def scores(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = (n / n.sum()) @ self.logits[at] + self.bias
        e = np.exp(z - z.max())
        return e / e.sum()

    def rejects(self, language: int, runs: np.ndarray) -> bool:
        """Whether too many of a text's distinct runs are new to a language."""
        limit, n = float(self.limits[language]), len(runs)
        new = n - int(self.runs[language][runs].sum())
        return n > 0 and new / n > limit + DEVIATIONS * np.sqrt(limit * (1 - limit) / n)


def sample_ids(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL) -> DataFrame:
    """(doc_id, lang): up to ``per_language`` ids of every language, or fewer if there are many.

    All stay within ``total``; more languages than that has room for are refused.
    """
    known = docs.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang")
    languages = materialize(known.groupBy("lang").count(), "languages")
    count = languages.count()
    if count * FEWEST > total:
        raise ValueError(f"{count} languages with {FEWEST} documents each exceed total={total} sampled documents")
    per_language = min(per_language, total // max(1, count))
    # About four times as many as wanted pass the limit on the hash, and only these are ranked.
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40))
    few = known.join(languages, "lang").where(place < 4 * per_language / F.col("count") * (1 << 40))
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    ranked = few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language)
    return ranked.select("doc_id", "lang").dropDuplicates(["doc_id"])


def _packed(runs: np.ndarray) -> bytes:
    bits = np.zeros(RUN_BITS, bool)
    bits[runs] = True
    return np.packbits(bits).tobytes()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = _letters()
    for batch in slices(batches):
        found = [bucket_counts(t, letters) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([a.astype(np.uint16).tobytes() for a, *_ in found], pa.binary()),
             pa.array([n.astype(np.uint32).tobytes() for _, n, _ in found], pa.binary()),
             pa.array([_packed(r) for *_, r in found], pa.binary())],
            names=["doc_id", "lang", "at", "n", "runs"])


def train(examples: list[tuple[str, np.ndarray, np.ndarray, pa.Buffer]]) -> Model:
    """Fit on (language, buckets, counts, runs); every fifth example of a language fits the calibration."""
    languages = tuple(sorted({e[0] for e in examples}))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros((0, RUN_BITS), bool), np.zeros(0))
    y = np.array([languages.index(e[0]) for e in examples])

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for row, i in zip(x, rows):
            _, at, n, _ = examples[i]
            row[at] = n / n.sum()
        return x

    def parts(rows: np.ndarray) -> list[np.ndarray]:
        return np.array_split(rows, max(1, len(rows) // BATCH))

    rank = np.zeros(len(y), int)
    for c in range(len(languages)):
        rank[y == c] = np.arange((y == c).sum())
    held = rank % 5 == 4
    fit = np.flatnonzero(~held)
    rng = np.random.default_rng(7)
    e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    # Frequent buckets move in every step, so steps are scaled by how much of a text a bucket is.
    scale = 1.0 / (sum(dense(rows).sum(axis=0) for rows in parts(fit)) / len(fit) * BUCKETS + 1.0)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for rows in parts(rng.permutation(fit)):
            xb = dense(rows)
            mean = xb @ e
            z = mean @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = p @ w.T
            w -= rate * (mean.T @ p)
            bias -= 0.1 * rate * p.sum(axis=0)
            e -= rate * BUCKETS * scale[:, None] * (xb.T @ back)
    logits = e @ w
    check = np.flatnonzero(held) if held.any() else fit
    z = np.concatenate([dense(rows) @ logits for rows in parts(check)]) + bias

    def probabilities(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    loss = lambda t: -np.log(probabilities(t)[np.arange(len(check)), y[check]] + 1e-12).mean()
    t = min(np.geomspace(0.2, 20, 60), key=loss)
    runs, limits = _novelty(examples, y, held, len(languages))
    return Model(languages, (logits / t).astype(np.float32), bias / t, runs, limits)


def _novelty(examples: list[tuple], y: np.ndarray, held: np.ndarray, languages: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of every language's training texts, and its limit for the share of new ones."""
    runs = np.zeros((languages, RUN_BITS // 8), np.uint8)
    for i in np.flatnonzero(~held):
        runs[y[i]] |= np.frombuffer(examples[i][3], np.uint8)
    # Shares of new runs of left-out texts in every language, and how many runs they have.
    left = np.flatnonzero(held)
    sizes = np.array([_ones(np.frombuffer(examples[i][3], np.uint8)) for i in left], int)
    share = np.zeros((len(left), languages))
    for row, i in enumerate(left):
        new = np.frombuffer(examples[i][3], np.uint8) & ~runs
        share[row] = [_ones(x) / max(1, sizes[row]) for x in new]
    limits = np.empty(languages)
    for c in range(languages):
        own, other = share[y[left] == c, c], share[y[left] != c, c]
        n = sizes[y[left] == c]
        middle = float(np.median(own)) if len(own) else 0.0
        foreign = float(np.median(other)) if len(other) else FOREIGN
        limit = (middle + max(middle, foreign)) / 2
        # Raised until no more left-out texts exceed it than may.
        for limit in np.linspace(limit, 1, 101):
            over = own > limit + DEVIATIONS * np.sqrt(limit * (1 - limit) / np.maximum(1, n))
            if over.sum() <= REJECT_SHARE * len(own):
                break
        limits[c] = limit
    return np.unpackbits(runs, axis=1).astype(bool), limits


def _ones(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits).sum())


def _trained(rows: pa.Table) -> pa.Table:
    """The model of a sample's features as one row of plain values."""
    order = pc.sort_indices(rows, [(c, "ascending") for c in ("lang", "doc_id", "at", "n")]).to_pylist()
    lang, at, n, runs = (rows.column(c) for c in ("lang", "at", "n", "runs"))
    # Views of the gathered columns, so the sample is held once.
    model = train([(lang[i].as_py(), np.frombuffer(at[i].as_buffer(), np.uint16), np.frombuffer(n[i].as_buffer(), np.uint32),
                    runs[i].as_buffer()) for i in order if at[i].as_buffer().size])
    return pa.table({
        "languages": pa.array([list(model.languages)], pa.list_(pa.string())),
        "logits": pa.array([model.logits.astype(np.float32).tobytes()], pa.binary()),
        "bias": pa.array([model.bias.astype(np.float64).tobytes()], pa.binary()),
        "runs": pa.array([np.packbits(model.runs, axis=1).tobytes()], pa.binary()),
        "limits": pa.array([model.limits.astype(np.float64).tobytes()], pa.binary())})


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL) -> Model:
    """Train on a bounded sample of ``docs`` (doc_id, text, lang) with a language.

    One task trains, as the sample is bounded; the driver gets the model only.
    """
    chosen = F.broadcast(sample_ids(docs, per_language, total))  # at most ``total`` ids
    texts = chosen.join(docs.where("text is not null").select("doc_id", "text"), "doc_id").select("doc_id", "lang", "text")
    rows = texts.mapInArrow(_features, "doc_id long, lang string, at binary, n binary, runs binary")
    found = rows.groupBy().applyInArrow(
        _trained, "languages array<string>, logits binary, bias binary, runs binary, limits binary").collect()
    if not found or not found[0]["languages"]:
        return train([])
    languages = tuple(found[0]["languages"])
    n = len(languages)
    return Model(
        languages, np.frombuffer(found[0]["logits"], np.float32).reshape(BUCKETS, n), np.frombuffer(found[0]["bias"]),
        np.unpackbits(np.frombuffer(found[0]["runs"], np.uint8).reshape(n, -1), axis=1).astype(bool),
        np.frombuffer(found[0]["limits"]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` as (row, lang_pred, score, rejected); ``row`` is the row itself.

    Only ``text`` is looked at. ``lang_pred`` is a learned language, or ``und`` with score 0 if
    the text is null or has no letter, or nothing could be learned. ``score`` is the calibrated
    probability. ``rejected`` holds for ``und`` and for texts with too much that is new to the
    language, as those of languages that were not learned.
    """
    rows = docs.select(F.struct("*").alias("row"))
    # One row of logits per bucket and a map per language; plain values, as workers may not have this package.
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.languages, model.logits, model.bias, np.packbits(model.runs, axis=1), model.limits))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, logits, bias, runs, limits = shared.value
        model = Model(languages, logits, bias, np.unpackbits(runs, axis=1).astype(bool), limits)
        letters = _letters()
        for batch in slices(batches):
            out = []
            for text in batch.column(0).field("text").to_pylist():
                at, n, runs = bucket_counts(text or "", letters)
                if not len(at) or not model.languages:
                    out.append((UNKNOWN, 0.0, True))
                    continue
                p = model.scores(at, n)
                best = int(p.argmax())
                out.append((model.languages[best], float(p[best]), model.rejects(best, runs)))
            lang, score, rejected = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["row", "lang_pred", "score", "rejected"])

    schema = StructType([
        rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType()),
        StructField("rejected", BooleanType())])
    return rows.mapInArrow(judged, schema)


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    return predict(docs, model).where(~F.col("rejected")).select("row.*")
