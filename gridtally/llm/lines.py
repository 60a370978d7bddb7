"""Line dedup: long lines that many documents hold stay only in the largest doc_id.

The hashes of all long lines are range-partitioned by (line, document) and sorted by line, document
(largest first) and position. One pass over each partition streams the lines: the first document of
a line keeps it, later ones lose it once enough documents have been seen. A line that may continue
in another partition is settled from one small record per partition and line, so a line of any
frequency is spread over as many tasks as its rows need. The result is one compressed bitmap per
document that loses something, not its text.

Defined results: a null text is one empty line and stays null only in `deduplicated`; a null doc_id
counts as one document, smaller than all others; rows that share a doc_id count as one document and
each keeps or loses its own lines; a line repeated within one document counts once. Extra columns
are carried by `deduplicated` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import partitions, plainly_named, stored, text_of, unused
from gridtally.llm.textbuf import buffer_of, line_ranges, slices, tidied

STRIPPED = bytes([32, 9, 10, 11, 12, 13])
#: Stands for a null doc_id in the sorted rows.
NO_ID = -(1 << 63)


def line_keys(min_chars: int):
    """Task: (doc_id, row, text) to one (line, doc_id, row, pos) for every line that is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = buffer_of(part.column("text"))
                starts, ends, text = line_ranges(data, offsets)
                first = np.cumsum(np.bincount(text, minlength=part.num_rows)) - np.bincount(text, minlength=part.num_rows)
                pos = np.arange(len(text)) - first[text]
                long = np.flatnonzero(ends - starts >= min_chars)
                raw, hashes, kept = data.tobytes(), [], []
                for i in long:
                    key = raw[starts[i] : ends[i]].strip(STRIPPED).lower()
                    # Code points are the bytes that do not continue a character.
                    if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        kept.append(i)
                if kept:
                    own = text[kept]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes, pa.binary()), part.column("doc_id").take(pa.array(own)), part.column("row").take(pa.array(own)), pa.array(pos[kept].astype(np.int32))],
                        names=["line", "doc_id", "row", "pos"],
                    )

    return run


def stream(min_docs: int):
    """Task: one sorted partition to decisions.

    kind 0: this line of this row goes. kind 1: it depends on other partitions. kind 2: what this
    partition knows of such a line: its largest doc_id, and in `n` its documents here.
    """

    def rows(kind: int, line: bytes, doc, row, pos, n: int = 0) -> dict:
        size = len(doc)
        return {"kind": [kind] * size, "line": [line] * size, "doc_id": doc, "row": row, "pos": pos, "n": [n] * size}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, docs, top, last, whole, held = None, 0, None, None, False, []
        schema = pa.schema([("kind", pa.int32()), ("line", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("n", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[dict] = []
            keys = batch.column("line").to_pylist()
            doc, row, pos = (batch.column(c).to_numpy() for c in ("doc_id", "row", "pos"))
            new = np.flatnonzero(np.concatenate([[True], np.frombuffer(b"".join(keys), dtype="V16")[1:] != np.frombuffer(b"".join(keys), dtype="V16")[:-1]]))
            for a, b in zip(new, [*new[1:], len(keys)], strict=True):
                if keys[a] != line:
                    if line is not None and not whole:  # the first line may have begun in another partition
                        out.append(rows(2, line, [top], [0], [0], docs))
                    # What is held of a line that ended with too few documents stays.
                    whole, line, docs, top, last, held = line is not None, keys[a], 0, doc[a], None, []
                d, r, p = doc[a:b], row[a:b], pos[a:b]
                docs += int(np.count_nonzero(d[1:] != d[:-1])) + int(last is None or d[0] != last)
                last = d[-1]
                if not whole:
                    out.append(rows(1, line, d, r, p))
                    continue
                later = d != top
                if later.any():
                    held.append((d[later], r[later], p[later]))
                if docs >= min_docs and held:
                    out += [rows(0, b"", *x) for x in held]
                    held = []
            yield from _batches(out, schema)
        if line is not None:
            # The last line may go on in the next partition: held rows wait for its record.
            out = [rows(1, line, *x) for x in held]
            yield from _batches([*out, rows(2, line, [top], [0], [0], docs)], schema)

    return run


def _batches(out: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if out:
        columns = [[x for part in out for x in part[name]] for name in schema.names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def identified(docs: DataFrame) -> DataFrame:
    """The documents with `row`: tells rows apart that share a doc_id."""
    return docs.withColumn("row", F.xxhash64(text_of()))


def bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, row, n_dropped, keep): keep is a compressed bitmap of the lines, most significant bit
    first. Lines beyond its end stay, and so do all lines of a document without a bitmap."""
    spark = docs.sparkSession
    narrow = identified(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc_id"), "row", "text")
    keys = stored(narrow.mapInArrow(tidied(line_keys(min_chars)), "line binary, doc_id long, row long, pos int"), "lines")
    ordered = keys.repartitionByRange(partitions(spark), "line", F.desc("doc_id")).sortWithinPartitions("line", F.desc("doc_id"), "row", "pos")
    decided = stored(ordered.mapInArrow(tidied(stream(min_docs)), "kind int, line binary, doc_id long, row long, pos int, n long"), "line-decisions")
    # Two rows per partition at most.
    across = decided.where("kind = 2").groupBy("line").agg(F.max("doc_id").alias("top"), F.sum("n").alias("docs"))
    open_rows = decided.where("kind = 1").join(F.broadcast(across.where(F.col("docs") >= min_docs)), "line").where("doc_id <> top")
    dropped = decided.where("kind = 0").select("doc_id", "row", "pos").unionAll(open_rows.select("doc_id", "row", "pos"))
    # Rows repeated in the input give the same position more than once.
    by_row = dropped.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("pos"))
    packed = by_row.mapInArrow(tidied(_pack), "doc_id long, row long, n_dropped long, keep binary")
    return packed.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, count = [], []
        for positions in batch.column("pos"):
            gone = positions.values.to_numpy()
            bits = np.ones(int(gone.max()) + 1, dtype=bool)
            bits[gone] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes() + bytes([-len(bits) % 8])))
            count.append(len(gone))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(count, pa.int64()), pa.array(keep, pa.binary())], names=["doc_id", "row", "n_dropped", "keep"])


def unpack(keep: bytes) -> np.ndarray:
    """The bits of a bitmap: true where the line stays."""
    raw = zlib.decompress(keep)
    return np.unpackbits(np.frombuffer(raw[:-1], dtype=np.uint8))[: 8 * (len(raw) - 1) - raw[-1]].astype(bool)


def kept_text(text: str, keep: bytes) -> str:
    lines, bits = text.split("\n"), unpack(keep)
    return "\n".join(x for i, x in enumerate(lines) if i >= len(bits) or bits[i])


def _with_bitmaps(docs: DataFrame, keep: str, min_chars: int, min_docs: int) -> DataFrame:
    """The documents with their bitmap, or null, in column `keep`."""
    own, row, doc = (unused(docs, n) for n in ("own_row", "bitmap_row", "bitmap_doc"))
    maps = bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias(doc), F.col("row").alias(row), F.col("keep").alias(keep))
    maps = stored(maps, "bitmaps")
    size = maps.limit(200_001).agg(F.count("*"), F.sum(F.octet_length(keep))).first()
    if size[0] <= 200_000 and (size[1] or 0) <= 16 << 20:
        # Counted to be small, so the texts stay where they are; beyond that both sides are dealt by document.
        maps = F.broadcast(maps)
    left = docs.withColumn(own, F.xxhash64(text_of()))
    return left.join(maps, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(row)), "left").drop(doc, row, own)


def deduplicated(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents with their remaining lines; other columns as they were, but n_chars follows the text."""
    given, docs = docs.columns, plainly_named(docs)
    names, at, keep = docs.columns, docs.columns.index("text"), unused(docs, "bitmap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if k is None or t is None else kept_text(t, k) for t, k in zip(batch.column("text").to_pylist(), batch.column(keep).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field("text").type) if i == at else batch.column(n) for i, n in enumerate(names)], names=names)

    out = _with_bitmaps(docs, keep, min_chars, min_docs).mapInArrow(tidied(run), docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length(text_of()).cast(docs.schema["n_chars"].dataType))
    return out.toDF(*given)


def digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, gone, sha = [], [], []
            for t, k in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True):
                t = t or ""
                lines.append(t.count("\n") + 1)
                gone.append(0 if k is None else int((~unpack(k)).sum()))
                sha.append(hashlib.sha256((t if k is None else kept_text(t, k)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_bitmaps(slim, "keep", min_chars, min_docs).mapInArrow(tidied(run), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
