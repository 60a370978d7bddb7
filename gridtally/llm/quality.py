"""Quality rules: base counts, and a hashed n-gram logistic regression trained on labelled rows.

Features of a text are hashed word unigrams, word bigrams and four-byte character n-grams, each
kind as shares of the text. The model is fitted on a sample of labelled rows whose size is bounded
by `Settings.per_class`, calibrated on a part of the sample it was not fitted on, and applied to
Arrow batches with a fixed threshold.

Defined results: a null or empty text has no words and fails the base rule; labels that are null or
whose document is missing are not used; a document with several labels is used once for each;
without labels of both classes only the base rule decides (score 1). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtally.llm.common import plainly_named, stored
from gridtally.llm.textbuf import Words, binary_array, buffer_of, encode, line_ranges, per_text, slices, tidied

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Bytes of text worked on at once: its n-grams take some eighty times as much.
SLICE = 1 << 20


@dataclass(frozen=True)
class Settings:
    """per_class: labelled rows, and texts, used of each class at most. sample_bytes: size of these texts
    of a class at most; the driver gets some ten times that as features. bits: size of each hash table."""

    per_class: int = 1500
    sample_bytes: int = 16 << 20
    bits: int = 16
    steps: int = 80
    penalty: float = 1e-5
    min_words: int = 50
    max_repeat_percent: int = 50
    threshold: float = 0.5


@dataclass
class Model:
    """weights: one row per kind of feature. slope, offset: the calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -40, 40)))


SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def base_counts(words: Words, ids: np.ndarray, n_ids: int) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    data, offsets = words.data, words.offsets
    n = len(offsets) - 1
    symbols = per_text(SYMBOLS[data], offsets)
    chars = per_text(words.inside & ((data & 0xC0) != 0x80), offsets)

    starts, ends, text = line_ranges(data, offsets)
    seen = np.concatenate([[0], np.cumsum(words.inside)])
    full = seen[ends] > seen[starts]
    lines, _ = encode_binary(data[data != 10], ends - starts)
    key, distinct = encode(lines[full].astype(np.int64) * n + text[full])
    owner = np.zeros(distinct, dtype=np.int64)
    owner[key] = text[full]
    dup_lines = np.bincount(text[full], minlength=n) - np.bincount(owner, minlength=n)

    repeat = np.zeros(n, dtype=np.int64)
    if len(ids) > 2:
        wide = ids.astype(np.int64)
        at = np.flatnonzero(words.text[:-2] == words.text[2:])
        if n_ids < 1 << 21:
            window, kinds = encode((wide[at] * n_ids + wide[at + 1]) * n_ids + wide[at + 2])
        else:
            pair, _ = encode(wide[at] * n_ids + wide[at + 1])
            window, kinds = encode(pair.astype(np.int64) * n_ids + wide[at + 2])
        own, _ = encode(window.astype(np.int64) * n + words.text[at])
        hit = at[np.bincount(own)[own] > 1] if len(at) else at
        covered = np.zeros(len(ids), dtype=bool)
        for k in range(3):
            covered[hit + k] = True
        repeat = np.bincount(words.text[covered], minlength=n)
    return {"n_words": words.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat}


def encode_binary(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, int]:
    got = binary_array(data, lengths).dictionary_encode()
    return got.indices.to_numpy(), len(got.dictionary)


def features(words: Words, ids: np.ndarray, kinds: pa.Array, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: its hashes in text order, and where each text's begin (n + 1)."""
    shift = np.uint64(64 - bits)
    of_kind = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in kinds.to_pylist()), dtype=np.uint64, count=len(kinds))
    word = of_kind[ids] if len(ids) else np.zeros(0, dtype=np.uint64)
    single = (word >> shift).astype(np.int32)
    inner = words.text[:-1] == words.text[1:]
    pair = (word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    pair = (pair >> shift).astype(np.int32)[inner]
    pair_at = np.concatenate([[0], np.cumsum(np.maximum(words.counts - 1, 0))])

    data, offsets = words.data, words.offsets
    size = np.maximum(np.diff(offsets) - 3, 0)
    if len(data) > 3:
        gram = data[:-3].astype(np.uint32)
        for k in (1, 2, 3):
            gram |= data[k : len(data) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
        gram *= np.uint32(2654435761)
        gram >>= np.uint32(32 - bits)
        real = np.ones(len(data), dtype=bool)
        for k in (1, 2, 3):
            real[np.maximum(offsets[1:] - k, offsets[:-1])[np.diff(offsets) > 0]] = False
        gram = gram[real[: len(gram)]]
    else:
        gram = np.zeros(0, dtype=np.uint32)
    return [(single, words.first), (pair, pair_at), (gram, np.concatenate([[0], np.cumsum(size)]))]


def raw_scores(found: list[tuple[np.ndarray, np.ndarray]], model: Model) -> np.ndarray:
    score = np.full(len(found[0][1]) - 1, model.bias)
    for (hashes, at), weights in zip(found, model.weights, strict=True):
        score += per_text(weights[hashes], at) / np.maximum(np.diff(at), 1)
    return score


def scorer(model: Model | None, settings: Settings):
    """Task: batches of (doc_id, text) to the rows of SCORED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = Words(*buffer_of(part.column("text")))
                ids, kinds = words.encoded()
                got = base_counts(words, ids, max(len(kinds), 1))
                failed = (got["n_words"] < settings.min_words) | (100 * got["n_repeat_words"] > settings.max_repeat_percent * got["n_words"])
                score = model.probability(raw_scores(features(words, ids, kinds, settings.bits), model)) if model else np.ones(len(failed))
                columns = [part.column("doc_id").cast(pa.int64()), *(pa.array(got[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(failed), pa.array(score), pa.array(~failed & (score >= settings.threshold))],
                    names=[c.split()[0] for c in SCORED.split(", ")],
                )

    return run


def sample_of(docs: DataFrame, labels: DataFrame, target: str, per_class: int) -> DataFrame:
    """(doc_id, text, y): at most per_class labelled rows of each class, the same ones on every run."""
    usable = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(target).cast("int").alias("y"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = usable.where("y = 0").orderBy(*order).limit(per_class).unionAll(usable.where("y = 1").orderBy(*order).limit(per_class))
    # Two times per_class rows of twelve bytes at most.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def distinct_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, class_bytes: int) -> DataFrame:
    """(doc_id, text, y): sample_of without repeated rows. Of each class at most per_class texts, if ids
    repeat with other texts, and texts of at most class_bytes together."""
    sample = stored(sample_of(docs, labels, target, per_class).dropDuplicates(["doc_id", "text", "y"]), "labelled-sample")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    if all(r["n"] <= per_class and r["size"] <= class_bytes for r in sample.groupBy("y").agg(F.count("*").alias("n"), F.sum(size).alias("size")).collect()):
        return sample
    # By a hash of the text first, so that no id is taken before another.
    mark = F.xxhash64("doc_id", "text")
    marks = sample.select(mark.alias("mark"), "doc_id", "y", size.alias("size"))
    order = ["mark", "doc_id"]
    some = marks.where("y = 0").orderBy(*order).limit(per_class).unionAll(marks.where("y = 1").orderBy(*order).limit(per_class))
    # Two times per_class narrow rows at most are summed up in order.
    until = F.sum("size").over(Window.partitionBy("y").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    chosen = some.withColumn("until", until).where(F.col("until") <= class_bytes).select("mark", "doc_id", "y")
    return sample.withColumn("mark", mark).join(F.broadcast(chosen), ["mark", "doc_id", "y"], "left_semi").select("doc_id", "text", "y")


def _vectors(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                words = Words(*buffer_of(part.column("text")))
                ids, kinds = words.encoded()
                found = features(words, ids, kinds, settings.bits)
                index, value = [], []
                for i in range(part.num_rows):
                    own = [np.unique(h[at[i] : at[i + 1]], return_counts=True) for h, at in found]
                    index.append(np.concatenate([u.astype(np.int32) + k * (1 << settings.bits) for k, (u, _) in enumerate(own)]))
                    value.append(np.concatenate([(c / max(c.sum(), 1)).astype(np.float32) for _, c in own]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("y"), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))],
                    names=["doc_id", "y", "index", "value"],
                )

    return run


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Fit on the sample; None without rows of both classes. The sample alone reaches the driver."""
    sample = distinct_sample(docs, labels, "quality", settings.per_class, settings.sample_bytes)
    rows = sample.mapInArrow(tidied(_vectors(settings)), "doc_id long, y int, index array<int>, value array<float>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    y = rows.column("y").to_numpy()
    if len(y) == 0 or y.min() == y.max():
        return None
    lists = rows.column("index").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    index, value = lists.flatten().to_numpy(), rows.column("value").combine_chunks().flatten().to_numpy()
    # A quarter of the sample, chosen by id, is kept for the calibration.
    aside = np.array([xxhash.xxh64_intdigest(str(i)) % 4 == 0 for i in rows.column("doc_id").to_pylist()])
    prior = labels.where("quality in (0, 1)").agg(F.avg("quality")).first()[0]
    model = _fit(index, value, size, y, aside, min(max(prior, 1e-3), 1 - 1e-3), settings)
    return model


def _fit(index, value, size, y, aside, prior, s: Settings) -> Model:
    row = np.repeat(np.arange(len(y)), size)
    # Rare features get larger steps: values are scaled by their root mean share.
    share = np.bincount(index, weights=value, minlength=3 << s.bits) / len(y)
    scale = 1 / np.sqrt(share + 1e-4)
    x = value * scale[index]
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    fit = np.where(aside, 0.0, weight)
    fit /= max(fit.sum(), 1e-9)
    w, bias = np.zeros(3 << s.bits), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, s.steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=x * w[index], minlength=len(y)) + bias, -40, 40)))
        error = fit * (p - y)
        slope = np.append(np.bincount(index, weights=x * error[row], minlength=len(w)) + s.penalty * w, error.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    raw = np.bincount(row, weights=x * w[index], minlength=len(y)) + bias
    chosen = aside if aside.any() and 0 < y[aside].mean() < 1 else ~aside
    slope, offset = _platt(raw[chosen], y[chosen], weight[chosen])
    return Model((w * scale).reshape(3, -1), bias, slope, offset)


def _platt(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic curve through the raw scores of rows the model has not seen, by Newton's method."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    center, spread = raw.mean(), raw.std() + 1e-9
    z = np.stack([(raw - center) / spread, np.ones(len(raw))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ z, -40, 40)))
        h = (z * (weight * p * (1 - p))) @ z.T + 1e-6 * np.eye(2)
        beta = beta - np.linalg.solve(h, z @ (weight * (p - target)) + 1e-6 * beta)
        beta[0] = max(beta[0], 1e-3)
    return beta[0] / spread, beta[1] - beta[0] * center / spread


def score(docs: DataFrame, model: Model | None, settings: Settings = Settings()) -> DataFrame:
    """The rows of SCORED, one per document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(scorer(model, settings)), SCORED)


def filtered(docs: DataFrame, model: Model | None, settings: Settings = Settings()) -> DataFrame:
    """The documents that are kept, with their own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = scorer(model, settings)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                kept = next(judge(iter([part.select(["doc_id", "text"])]))).column("kept")
                yield part.filter(kept)

    plain = plainly_named(docs)
    return plain.mapInArrow(tidied(run), plain.schema).toDF(*docs.columns)
