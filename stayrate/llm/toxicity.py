"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of a few rows of one hashed table (two for the word, two
for its beginnings, so that one shared row alone cannot carry a class). Filters of
several widths slide over the vectors, each keeps its largest response over the whole
text, and a logistic layer turns these into a score. Its weights are kept from falling
below zero: a filter finds evidence, and a long text cannot outweigh it. The model is trained in numpy on
a bounded sample of labelled rows (:class:`Settings`) and scores every row on the
executors; the score at which a text is rejected is calibrated by language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.llm.words import hashed, pieces, plain_words, portions, text_bytes, unused
from stayrate.session import stage

MEMO_WORDS = 50_000
GROUP_WORDS = 1 << 14
PARTS = 4
# Width of a score bin of the calibration, in log odds.
BIN = 0.01


@dataclass(frozen=True)
class Settings:
    """``class_rows`` labelled rows of each class at most are learned from, and
    ``sample_words`` words in all; both are filled in the order of a hash of the id."""

    buckets: int = 1 << 16
    size: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    class_rows: int = 3000
    sample_words: int = 4_000_000
    calibration_share: int = 5
    epochs: int = 6
    batch: int = 32
    rate: float = 0.1
    seed: int = 7


def word_rows(words: list[bytes], buckets: int) -> np.ndarray:
    """Rows of the hashed table that make up each word's vector, (words, PARTS)."""
    whole = hashed(words)
    keys = [whole, whole >> np.uint64(32), hashed([w[:4] for w in words]) >> np.uint64(8), hashed([w[:6] for w in words]) >> np.uint64(16)]
    return np.stack([(k % np.uint64(buckets)).astype(np.int32) for k in keys], axis=1).reshape(-1, PARTS)


@dataclass
class Model:
    """Weights; ``thresholds`` by language, with "" for languages without enough rows."""

    settings: Settings
    table: np.ndarray
    kernels: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    prior: float = 0.5
    trained: bool = False
    thresholds: dict[str, float] = field(default_factory=lambda: {"": 0.5})

    @classmethod
    def fresh(cls, settings: Settings) -> Model:
        rng = np.random.default_rng(settings.seed)
        width = len(settings.widths) * settings.filters
        return cls(
            settings,
            (rng.standard_normal((settings.buckets, settings.size)) * 0.05).astype(np.float32),
            [(rng.standard_normal((w, settings.size, settings.filters)) / np.sqrt(w * settings.size)).astype(np.float32) for w in settings.widths],
            np.zeros(width, np.float32),
            np.full(width, 0.1, np.float32),
            np.full(1, -1, np.float32),
        )

    def responses(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Filter responses at every position but the last ``max(widths) - 1``."""
        count = len(vectors) - max(self.settings.widths) + 1
        found = []
        for kernel in self.kernels:
            total = vectors[:count] @ kernel[0]
            for j in range(1, len(kernel)):
                total += vectors[j : j + count] @ kernel[j]
            found.append(total)
        return found

    def score_pooled(self, pooled: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(pooled), self.prior)
        hidden = np.maximum(pooled + self.bias, 0).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.shift, -30, 30)))


class Reader:
    """Vectors of words, each distinct word hashed once while it is remembered."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}
        self.vectors = np.zeros((1 << 12, model.settings.size), np.float32)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        known = len(self.memo)
        memo = self.memo
        codes = np.fromiter((memo.setdefault(w, len(memo)) for w in words), np.int64, len(words))
        if len(memo) > known:
            fresh = list(islice(reversed(memo), len(memo) - known))[::-1]
            rows = word_rows(fresh, self.model.settings.buckets)
            while len(self.vectors) < len(memo):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            self.vectors[known : len(memo)] = self.model.table[rows].sum(axis=1)
        return self.vectors[codes]


def pooled_texts(model: Model, reader: Reader, texts: list[bytes]) -> np.ndarray:
    """Largest response of each filter over each whole text, (texts, filters)."""
    pad = max(model.settings.widths) - 1
    gap = np.zeros((pad, model.settings.size), np.float32)
    parts, starts, at = [], [], 0
    for text in texts:
        words = reader(plain_words(text)) if text else gap[:0]
        if not len(words):
            words = gap[:1]
        starts.append(at)
        at += len(words) + pad
        parts += [words, gap]
    if not starts:
        return np.zeros((0, len(model.bias)), np.float32)
    vectors = np.concatenate(parts)
    inside = np.ones(at - pad, bool)
    for s in starts[1:]:
        inside[s - pad : s] = False
    low = np.where(inside, np.float32(0), np.float32(-1e30))[:, None]
    return np.concatenate([np.maximum.reduceat(r + low, starts, axis=0) for r in model.responses(vectors)], axis=1)


def pooled_long(model: Model, reader: Reader, text: bytes) -> np.ndarray:
    """The same for one very long text, piece by piece with the overlap of the widest filter."""
    pad, best, tail = max(model.settings.widths) - 1, None, []
    for part in pieces(text, 1 << 17):
        words = tail + plain_words(part)
        found = pooled_texts(model, reader, [b" ".join(words)])
        best = found if best is None else np.maximum(best, found)
        tail = words[-pad:] if pad else []
    return best


def score_batch(model: Model, reader: Reader, texts: list[bytes]) -> np.ndarray:
    scores, group, size = [], [], 0
    for text in texts:
        if len(text) > 1 << 18:
            scores += [model.score_pooled(pooled_texts(model, reader, group)), model.score_pooled(pooled_long(model, reader, text))]
            group, size = [], 0
            continue
        group.append(text)
        size += len(text)
        if size > 6 * GROUP_WORDS:
            scores.append(model.score_pooled(pooled_texts(model, reader, group)))
            group, size = [], 0
    scores.append(model.score_pooled(pooled_texts(model, reader, group)))
    return np.concatenate(scores)


class _Adagrad:
    def __init__(self, model: Model):
        self.rate = model.settings.rate
        self.sums = {id(x): np.full_like(x, 1e-4) for x in (model.table, *model.kernels, model.bias, model.out, model.shift)}

    def step(self, values: np.ndarray, gradient: np.ndarray) -> None:
        sums = self.sums[id(values)]
        sums += gradient**2
        values -= self.rate * gradient / np.sqrt(sums)

    def step_rows(self, values: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
        unique, inverse = np.unique(rows, return_inverse=True)
        total = np.zeros((len(unique), values.shape[1]), np.float32)
        np.add.at(total, inverse, gradient)
        sums = self.sums[id(values)]
        sums[unique] += total**2
        values[unique] -= self.rate * total / np.sqrt(sums[unique])


def train(texts: list[np.ndarray], labels: np.ndarray, settings: Settings) -> Model:
    """Fit on texts given as table rows of their words, (words, PARTS) each."""
    model = Model.fresh(settings)
    ones = int(labels.sum())
    model.prior = (ones + 1) / (len(labels) + 2)
    if ones in (0, len(labels)):
        return model
    model.trained = True
    pad, rng, adagrad = max(settings.widths) - 1, np.random.default_rng(settings.seed), _Adagrad(model)
    weight = np.where(labels == 1, 0.5 / ones, 0.5 / (len(labels) - ones)) * len(labels)
    per = settings.filters
    for _ in range(settings.epochs):
        for chosen in np.array_split(rng.permutation(len(texts)), -(-len(texts) // settings.batch)):
            kernels = [np.zeros_like(k) for k in model.kernels]
            bias, out, shift = np.zeros_like(model.bias), np.zeros_like(model.out), np.zeros_like(model.shift)
            rows, moved = [], []
            for i in chosen:
                ids = texts[i]
                count = max(len(ids), 1)
                vectors = np.zeros((count + pad, settings.size), np.float32)
                vectors[: len(ids)] = model.table[ids].sum(axis=1)
                found = model.responses(vectors)
                places = [r.argmax(axis=0) for r in found]
                pooled = np.concatenate([r[p, np.arange(per)] for r, p in zip(found, places)])
                hidden = np.maximum(pooled + model.bias, 0)
                score = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.shift[0], -30, 30)))
                error = np.float32((score - labels[i]) * weight[i] / len(chosen))
                out += error * hidden
                shift += error
                back = error * model.out * (hidden > 0)
                bias += back
                for k, (kernel, p) in enumerate(zip(model.kernels, places)):
                    part = back[k * per : (k + 1) * per]
                    for j in range(len(kernel)):
                        at = p + j
                        kernels[k][j] += vectors[at].T * part
                        real = (at < len(ids)) & (part != 0)
                        if real.any():
                            step = kernel[j].T[real] * part[real, None]
                            rows.append(ids[at[real]].ravel())
                            moved.append(np.repeat(step, PARTS, axis=0))
            for values, gradient in zip(model.kernels, kernels):
                adagrad.step(values, gradient)
            adagrad.step(model.bias, bias)
            adagrad.step(model.out, out)
            np.maximum(model.out, 0, out=model.out)
            adagrad.step(model.shift, shift)
            if rows:
                adagrad.step_rows(model.table, np.concatenate(rows), np.concatenate(moved))
    return model


def best_threshold(low: np.ndarray, high: np.ndarray, rows: np.ndarray, ones: np.ndarray) -> float:
    """Threshold of the largest F1, in the middle of the gap in which it can lie.

    Scores are given in groups that do not overlap: smallest and largest score, number
    of rows, number of ones.
    """
    order = np.argsort(-low, kind="stable")
    low, high = low[order], high[order]
    f1 = 2 * np.cumsum(ones[order]) / (np.cumsum(rows[order]) + ones.sum())
    at = int(np.flatnonzero(f1 == f1.max())[-1])
    return float((low[at] + (high[at + 1] if at + 1 < len(low) else 0)) / 2)


def thresholds(groups: list[tuple], least: int = 20) -> dict[str, float]:
    """A threshold for each language with at least ``least`` rows of each class.

    ``groups`` are (lang, smallest score, largest score, rows, ones); one for each
    language and score or score bin.
    """
    found = {"": 0.5}
    if not groups:
        return found
    names = np.array([g[0] for g in groups], dtype=object)
    low, high, rows, ones = (np.array([g[i] for g in groups]) for i in range(1, 5))

    def best(own: np.ndarray) -> float:
        bins, at = np.unique(np.floor(_logit(low[own]) / BIN), return_inverse=True)
        lows, highs = np.full(len(bins), np.inf), np.full(len(bins), -np.inf)
        np.minimum.at(lows, at, low[own])
        np.maximum.at(highs, at, high[own])
        return best_threshold(lows, highs, np.bincount(at, rows[own]), np.bincount(at, ones[own]))

    if 0 < ones.sum() < rows.sum():
        found[""] = best(np.ones(len(names), bool))
    for lang in sorted({x for x in names if x}):
        own = names == lang
        if least <= ones[own].sum() <= rows[own].sum() - least:
            found[lang] = best(own)
    return found


def _logit(scores: np.ndarray) -> np.ndarray:
    inside = np.clip(scores, 1e-13, 1 - 1e-13)
    return np.log(inside / (1 - inside))


def calibrate(model: Model, scores: np.ndarray, labels: np.ndarray, langs: list[str], least: int = 20) -> dict[str, float]:
    """:func:`thresholds` from single rows."""
    return thresholds([(x, s, s, 1, int(y)) for x, s, y in zip(langs, scores, labels)], least)


def id_hash(column: Column) -> Column:
    """crc32 of the id as text, a NULL id as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", label_col: str = "toxic", folds: int = 5, held_out: int = 0, settings: Settings | None = None) -> Model:
    """Train on a bounded sample of the labelled rows outside the held-out fold.

    Of the sample, one row in ``calibration_share`` is kept from training, and a text
    that overflows the word budget is passed over. All labelled rows outside the held-out
    fold that were not trained on set the thresholds, or all of them if these lack a
    class. Labels that are NULL are left out; an id labelled twice counts with its
    larger label. Without rows of both classes the score is the share of ones, smoothed.
    """
    settings = settings or Settings()
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col else F.lit("")
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (id_hash(F.col(id_col)) % folds != held_out))
    single = usable.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"), F.xxhash64(F.first(id_col)).alias("__order"))
    ranked = [single.where(F.col("__y") == y).orderBy("__order", "__id").limit(settings.class_rows) for y in (0, 1)]
    sample = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"), lang.alias("__lang")).join(
        F.broadcast(ranked[0].unionByName(ranked[1])), F.col("__doc") == F.col("__id")
    )
    buckets = settings.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(text_bytes(batch.column(0))):
                one = batch.slice(i, 1)
                rows = word_rows(plain_words(text), buckets).tobytes()
                yield pa.RecordBatch.from_arrays([*one.columns[1:], pa.array([rows], pa.binary())], ["lang", "y", "pri", "words"])

    read = stage(
        sample.select("__text", "__lang", "__y", "__order").mapInArrow(run, "lang string, y int, pri long, words binary"), "sample"
    )
    texts, ys, orders, words = [], [], [], 0
    for row in read.orderBy("pri", F.xxhash64("words")).toLocalIterator():
        rows = np.frombuffer(row["words"], np.int32).reshape(-1, PARTS)
        if words + len(rows) > settings.sample_words:
            continue
        words += len(rows)
        texts.append(rows)
        ys.append(row["y"])
        orders.append(row["pri"])
    y, orders = np.array(ys, np.int64), np.array(orders, np.int64)
    out = orders % settings.calibration_share == 0
    if len(set(y[~out])) < 2 or len(set(y[out])) < 2:
        out[:] = False
    model = train([texts[i] for i in np.flatnonzero(~out)], y[~out], settings)
    if model.trained:
        model.thresholds = thresholds(calibration_groups(docs, single, model, orders[~out].tolist(), id_col, text_col, lang))
    return model


def calibration_groups(docs: DataFrame, single: DataFrame, model: Model, fitted: list[int], id_col: str, text_col: str, lang: Column) -> list[tuple]:
    """Score bins by language, for :func:`thresholds`, of the labelled rows not fitted."""
    small = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"), lang.alias("__lang"))
    scores = with_scores(small, model, "__text").select("__doc", "__lang", "__score")
    # An Arrow table is read in the JVM; rows of Python objects would start workers of their own on every executor.
    known = docs.sparkSession.createDataFrame(pa.table({"__order": pa.array(set(fitted), pa.int64())})).withColumn("__fitted", F.lit(True))
    labelled = scores.join(single.join(F.broadcast(known), "__order", "left"), F.col("__doc") == F.col("__id"))
    inside = F.least(F.greatest("__score", F.lit(1e-13)), F.lit(1 - 1e-13))
    rows = (
        labelled.groupBy(F.col("__fitted").isNotNull().alias("fitted"), "__lang", F.floor(F.log(inside / (1 - inside)) / BIN).alias("bin"))
        .agg(F.min("__score"), F.max("__score"), F.count("*"), F.sum("__y"))
        .collect()
    )
    fresh = [tuple(r)[1:2] + tuple(r)[3:] for r in rows if not r["fitted"]]
    if 0 < sum(g[4] for g in fresh) < sum(g[3] for g in fresh):
        return fresh
    return [tuple(r)[1:2] + tuple(r)[3:] for r in rows]


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", name: str = "__score") -> DataFrame:
    """``docs`` with the score of each whole text (NULL as empty) in a further column.

    Only the text goes through Python.
    """

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(model)
        for texts in columns:
            sizes = pc.binary_length(texts).fill_null(0).to_pylist()
            found = [score_batch(model, reader, list(text_bytes(texts.slice(a, b - a)))) for a, b in portions(sizes)]
            yield pa.array(np.concatenate([np.empty(0), *found]), pa.float64())

    return docs.withColumn(name, score(F.col(text_col)))


def threshold_of(model: Model, lang: Column) -> Column:
    """The calibrated threshold of a language, that of all rows for the others."""
    table = F.create_map(*[F.lit(x) for pair in model.thresholds.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(lang.cast("string"), F.lit(""))), F.lit(model.thresholds[""]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", folds: int = 5, settings: Settings | None = None) -> DataFrame:
    """One row per document: id, held_out, score, predicted, threshold, rejected.

    ``predicted`` is 1 from a score of 0.5, ``rejected`` from the language's threshold.
    Empty and NULL texts are scored like any other; a NULL id counts as held out;
    repeated rows give repeated results; other columns are ignored.
    """
    model = fit(docs, labels, id_col, text_col, lang_col, folds=folds, settings=settings)
    lang = F.col(lang_col) if lang_col else F.lit("")
    small = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), lang.alias("__lang"))
    limit = threshold_of(model, F.col("__lang"))
    return with_scores(small, model, "__text").select(
        F.col("__id").alias(id_col),
        (id_hash(F.col("__id")) % folds == 0).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= 0.5).cast("int").alias("predicted"),
        limit.alias("threshold"),
        (F.col("__score") >= limit).alias("rejected"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings | None = None) -> DataFrame:
    """``docs`` without the rows whose score reaches their language's threshold.

    NULL and empty texts are scored like any other, very long ones whole; repeated rows
    stay or go together; a NULL language takes the threshold of all rows; without labels
    of both classes every row has the share of ones as its score. Columns are those of ``docs``, whatever their names.
    """
    model = fit(docs, labels, id_col, text_col, lang_col, settings=settings)
    name = unused("score", docs.columns)
    scored = with_scores(docs, model, text_col, name)
    return scored.where(F.col(name) < threshold_of(model, F.col(lang_col))).select(*[F.col(f"`{c}`") for c in docs.columns])
