"""Importance resampling towards a target: hashed n-gram weights, and the highest perturbed scores.

Runs of one to three words are hashed into buckets by CRC-32. The buckets of the corpus and of the
target are counted in one pass each; their smoothed log ratio is a bucket's gain, and a document's
weight is the sum of its features' gains, looked up in one array. A Gumbel term from the document's id
is added, so the highest scores are a draw without replacement.

The cutoff is found without sorting the scores: a quantile sketch gives a bracket around it, exact
counts above and inside the bracket validate it or widen it, and only the bracket's rows are put in
order. The drawn rows get their ranks from ranges of scores and their counts (see `ranks`).

Defined results: a null or empty text has no features and weight 0; a null doc_id is an empty text in
the hash and ranks after others of its score; rows with the same doc_id and score are drawn one by
one; an empty table gives no rows; an empty target leaves all gains to the smoothing. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import short_batches, stored, text_of
from gridtally.llm.ranks import ranked
from gridtally.llm.textbuf import Words, buffer_of, slices, tidied

#: Bytes outside words, after A-Z are lower-cased: all ASCII but digits and a-z.
OUTSIDE = np.zeros(256, dtype=bool)
OUTSIDE[:128] = True
OUTSIDE[48:58] = OUTSIDE[97:123] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass(frozen=True)
class Settings:
    """longest: words in a feature at most. share: percent of the documents with `min_words` that are drawn."""

    buckets: int = 10_000
    longest: int = 3
    min_words: int = 20
    share: int = 5
    seed: int = 42


def shift_tables() -> np.ndarray:
    """[k, byte, value]: what 2**k zero bytes after it make of a CRC-32 register, byte by byte.

    A register is the exclusive or of its bytes' parts, so a shift is four look-ups.
    """
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        # Fixed value: the reflected polynomial of CRC-32.
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
    one = np.arange(256, dtype=np.uint32)[None, :] << np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None]
    one = one >> 8 ^ step[one & 255]
    tables = [one]
    for _ in range(31):
        tables.append(_looked_up(tables[-1], tables[-1]))
    return np.stack(tables)


def _looked_up(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


class Crc:
    """CRC-32 of texts put together from parts whose CRC-32 and length are known."""

    #: Lengths with a table of their own; longer ones are made of powers of two.
    DIRECT = 32

    def __init__(self) -> None:
        self.powers = shift_tables()
        by_length = [np.arange(256, dtype=np.uint32)[None, :] << np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None]]
        for _ in range(self.DIRECT):
            by_length.append(_looked_up(self.powers[0], by_length[-1]))
        self.flat = np.ascontiguousarray(np.stack(by_length)).reshape(-1)

    def joined(self, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
        """CRC-32 of left followed by right, which has `size` bytes."""
        base = np.minimum(size, self.DIRECT) << 10
        out = right ^ self.flat[base + (left & 255)] ^ self.flat[base + 256 + (left >> 8 & 255)]
        out ^= self.flat[base + 512 + (left >> 16 & 255)]
        out ^= self.flat[base + 768 + (left >> 24)]
        long = np.flatnonzero(size > self.DIRECT)
        if len(long):
            crc, rest = left[long], size[long]
            for k, table in enumerate(self.powers):
                odd = rest >> k & 1 == 1
                crc[odd] = _looked_up(table, crc[odd])
            out[long] = right[long] ^ crc
        return out


def features(data: np.ndarray, offsets: np.ndarray, crc: Crc, settings: Settings) -> tuple[Words, list[np.ndarray]]:
    """The words of the texts, and the buckets of the runs of 1, 2, ... words that start at each word.

    A run that would leave its text has bucket -1.
    """
    words = Words(LOWER[data], offsets, OUTSIDE)
    index, kinds = words.encoded()
    kinds = kinds.to_pylist()
    own = np.fromiter((zlib.crc32(w) for w in kinds), dtype=np.uint32, count=len(kinds))[index]
    spaced = np.fromiter((zlib.crc32(w + b" ") for w in kinds), dtype=np.uint32, count=len(kinds))[index]
    size = words.ends - words.starts
    found = [own.astype(np.int64) % settings.buckets]
    space, one = np.uint32(zlib.crc32(b" ")), np.ones(len(own), dtype=np.int64)
    before = spaced
    for k in range(1, settings.longest):
        at = np.full(len(own), -1, dtype=np.int64)
        if len(own) > k:
            run = crc.joined(before[:-1], own[k:], size[k:])
            at[:-k] = np.where(words.text[k:] == words.text[:-k], run.astype(np.int64) % settings.buckets, -1)
            before = crc.joined(run, np.full(len(run), space), one[: len(run)])
        found.append(at)
    return words, found


def counter(settings: Settings):
    """Task: texts to (bucket, n), one row for each bucket at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = Crc()
        total = np.zeros(settings.buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for at in features(*buffer_of(part.column("text")), crc, settings)[1]:
                    total += np.bincount(at + 1, minlength=settings.buckets + 1)[1:]
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, settings: Settings) -> np.ndarray:
    """Features of all texts by bucket. The driver gets one row for each bucket, however many texts there are."""
    parts = texts.select(text_of().alias("text")).mapInArrow(tidied(counter(settings)), "bucket long, n long")
    with short_batches(texts.sparkSession):
        found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(settings.buckets, dtype=np.int64)
    total[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return total


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of target and source in each bucket, rounded down."""
    n = len(source)
    of_source, of_target = float(source.sum() + n), float(target.sum() + n)
    ratio = [math.log((t + 1) * of_source / ((s + 1) * of_target)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * r) for r in ratio], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel variate that the id decides, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scorer(gains: np.ndarray, settings: Settings):
    """Task: (doc_id, text) to (doc_id, n_words, n_features, weight, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = Crc()
        # Bucket -1 is the last place: no gain.
        table = np.append(gains, 0)
        for batch in batches:
            for part in slices(batch, "text"):
                words, found = features(*buffer_of(part.column("text")), crc, settings)
                until = np.zeros(len(words.starts) + 1, dtype=np.int64)
                np.cumsum(sum(table[at] for at in found), out=until[1:])
                weight = np.diff(until[words.first])
                n = words.counts.astype(np.int64)
                n_features = sum(np.maximum(n - k, 0) for k in range(settings.longest))
                ids = part.column("doc_id")
                extra = np.array([noise(i, settings.seed) for i in ids.to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n), pa.array(n_features), pa.array(weight), pa.array(weight + extra)],
                    names=["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def scores(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document; both tables have a column text."""
    gains = gains_of(bucket_counts(docs, settings), bucket_counts(target, settings))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(tidied(scorer(gains, settings)), "doc_id long, n_words long, n_features long, weight long, score long")


def cutoff(rows: DataFrame, k: int, n: int, k_sketch: int = 200) -> tuple[int, int | None]:
    """(score, doc_id) of the k-th of the n rows, highest score first and then the smallest doc_id; 0 < k <= n.

    The sketch only proposes the bracket. What lies above and inside it is counted exactly, and a
    bracket that misses the k-th row is widened on both sides until it holds it.
    """
    sketch = rows.agg(F.kll_sketch_agg_bigint("score", k_sketch).alias("s"), F.min("score").alias("low"), F.max("score").alias("high"))
    spread = 2.0 / k_sketch
    while True:
        at = 1 - k / n
        low, high = max(at - spread, 0.0), min(at + spread, 1.0)
        found = sketch.select(F.kll_sketch_get_quantile_bigint("s", F.lit(low)).alias("a"), F.kll_sketch_get_quantile_bigint("s", F.lit(high)).alias("b"), "low", "high").first()
        a = found["low"] if low == 0 else found["a"]
        b = found["high"] if high == 1 else found["b"]
        above, inside = rows.agg(F.count_if(F.col("score") > b), F.count_if(F.col("score").between(a, b))).first()
        if above < k <= above + inside:
            break
        spread *= 4
    bracket = rows.where(F.col("score").between(a, b)).select((-F.col("score")).alias("down"), F.col("doc_id").isNull().alias("none"), "doc_id")
    last = ranked(bracket.withColumn("all", F.lit(0)), ["all"], ["down", "none", "doc_id"], "bracket").where(F.col("pos") == k - above - 1).first()
    return -last["down"], last["doc_id"]


def resampled(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every document with n_features, weight, score and rank: 1, 2, 3... of the drawn ones, else null."""
    table = stored(scores(docs, target, settings), "resampling-scores")
    able = table.where(F.col("n_words") >= settings.min_words)
    n = able.count()
    k = settings.share * n // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return table.select(*columns, F.lit(None).cast("long").alias("rank"))
    score, doc_id = cutoff(able, k, n)
    tied = F.lit(True) if doc_id is None else F.coalesce(F.col("doc_id") <= doc_id, F.lit(False))
    # The drawn rows, and rows that equal the last of them in score and doc_id.
    first = (F.col("n_words") >= settings.min_words) & ((F.col("score") > score) | ((F.col("score") == score) & tied))
    top = table.where(first).select(*columns, (-F.col("score")).alias("down"), F.col("doc_id").isNull().alias("none"), F.lit(0).alias("all"))
    placed = ranked(top, ["all"], ["down", "none", "doc_id"], "drawn")
    rank = F.when(F.col("pos") < k, F.col("pos") + 1)
    return placed.select(*columns, rank.alias("rank")).unionAll(table.where(~first).select(*columns, F.lit(None).cast("long").alias("rank")))
