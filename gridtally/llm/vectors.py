"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

Vectors of one label are compared. Equal vectors are one node from the start. A node's vector is
turned by pseudo-random rotations (sign flips and Hadamard transforms, three times), and each hash
is the axis nearest to it; a bucket is the axes of several rotations together. Every node goes into
its most likely buckets of each table, not only the first. Within a bucket all pairs are checked by
cosine in double precision, block by block; a bucket gives per node the number of its new links and
one link to the first member of its group, never the pairs. A pair that meets in several buckets is
counted in the first of them only. Buckets with very many nodes are dealt as pairs of parts.

Larger tables need more rotations in a bucket, and then two near vectors meet in it more rarely. So
there are as many hash tables as let `recall` of random pairs at the least cosine meet, measured on
such pairs before the run. Links are found with that recall at any size, and none is wrong.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and
those with a null label, link with nothing; so do vectors of different length; repeated rows are
other vectors; a null vec_id is linked but never the smallest. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import small, smallest_reachable, stored


@dataclass(frozen=True)
class Settings:
    """tables: at least so many; more where `recall` needs them. probes: buckets of each table that a
    node goes into. part_rows: nodes of a part of a bucket. number: how components are kept; the hashes
    and cosines are in double precision."""

    tables: int = 4
    recall: float = 0.97
    most_tables: int = 32
    probes: int = 4
    cosine: float = 0.93
    part_rows: int = 10_000
    number: str = "<f8"
    seed: int = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, length a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, d) / math.sqrt(d)


def rotations_for(nodes: int, width: int, probes: int) -> int:
    """Rotations in a hash: as many as keep a random bucket near one node."""
    return max(1, math.ceil(math.log(max(nodes * probes, 2)) / math.log(2 * width)))


def buckets(x: np.ndarray, s: Settings, rotations: int) -> np.ndarray:
    """(rows, tables, probes) bucket numbers, the likeliest first. x: unit rows, padded to a power of two."""
    return np.stack([table_buckets(x, s, rotations, table) for table in range(s.tables)], axis=1)


def table_buckets(x: np.ndarray, s: Settings, rotations: int, table: int) -> np.ndarray:
    """(rows, probes) bucket numbers of one table."""
    n, d = x.shape
    near = min(3, 2 * d)
    out = np.full((n, s.probes), -1, dtype=np.int64)
    axes, cost = [], []
    for k in range(rotations):
        signs = np.random.default_rng([s.seed, table, k, d]).choice([-1.0, 1.0], size=(3, d))
        y = x
        for flips in signs:
            y = hadamard(y * flips)
        both = np.concatenate([y, -y], axis=1)
        best = np.argpartition(-both, near - 1, axis=1)[:, :near] if near < 2 * d else np.tile(np.arange(2 * d), (n, 1))
        value = np.take_along_axis(both, best, axis=1)
        order = np.argsort(-value, axis=1, kind="stable")
        best, value = np.take_along_axis(best, order, axis=1), np.take_along_axis(value, order, axis=1)
        axes.append(best)
        cost.append((value[:, :1] - value) ** 2)
    # Combinations of near axes, the smallest summed loss first.
    code, loss = axes[0].astype(np.int64), cost[0]
    for a, c in zip(axes[1:], cost[1:], strict=True):
        code = (code[:, :, None] * (2 * d) + a[:, None, :]).reshape(n, -1)
        loss = (loss[:, :, None] + c[:, None, :]).reshape(n, -1)
        keep = np.argsort(loss, axis=1, kind="stable")[:, : max(s.probes, 1)]
        code, loss = np.take_along_axis(code, keep, axis=1), np.take_along_axis(loss, keep, axis=1)
    width = min(s.probes, code.shape[1])
    out[:, :width] = code[:, :width]
    return out


def tables_for(rotations: int, width: int, s: Settings) -> int | None:
    """The fewest tables, s.tables at least, in which `recall` of random pairs at the least cosine meet.

    None if s.most_tables are too few.
    """
    width = max(width, 2)
    rng = np.random.default_rng([s.seed, width])
    a, b = rng.normal(size=(2, max(500, min(2000, (1 << 21) // width)), width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (unit_rows([v.tobytes() for v in p]) for p in (a, s.cosine * a + math.sqrt(1 - s.cosine**2) * b))
    met = np.zeros(len(x), dtype=bool)
    for table in range(max(s.tables, s.most_tables)):
        own, other = (table_buckets(v, s, rotations, table) for v in (x, y))
        met |= ((own[:, :, None] == other[:, None, :]) & (own >= 0)[:, :, None]).any(axis=(1, 2))
        if table + 1 >= s.tables and met.mean() >= s.recall:
            return table + 1
    return None


def plan(nodes: int, width: int, s: Settings) -> tuple[Settings, int]:
    """The settings with their number of tables, and the rotations: fewer, in larger buckets, where no tables reach the recall."""
    for rotations in range(rotations_for(nodes, width, s.probes), 0, -1):
        tables = tables_for(rotations, width, s)
        if tables:
            return replace(s, tables=tables), rotations
    raise ValueError(f"{s.most_tables} tables do not find pairs at cosine {s.cosine}")


def unit_rows(raw: list[bytes], number: str = "<f8") -> np.ndarray:
    """Unit vectors in double precision, padded with zeros to a power of two."""
    x = np.frombuffer(b"".join(raw), dtype=number).astype(np.float64).reshape(len(raw), -1)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, d - x.shape[1]))) if d != x.shape[1] else x


def usable(number: str):
    """Task: (vec_id, label, embedding) to (vec_id, node, label, vector); node is null where nothing can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, vectors = [], []
            for label, v in zip(batch.column("label").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                raw = None
                if label is not None and v and None not in v:
                    x = np.array(v, dtype=np.float64) + 0.0  # a negative zero equals zero
                    largest = np.abs(x).max()
                    if np.isfinite(x).all() and largest > 0:
                        # Scaled by a power of two, so that no square overflows or vanishes.
                        x = np.ldexp(x, -int(np.frexp(largest)[1])) if not 1e-100 < largest < 1e100 else x
                        raw = x.astype(number).tobytes()
                vectors.append(raw)
                nodes.append(None if raw is None else hashlib.md5(label.encode() + b"\0" + raw).digest())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nodes, pa.binary()), batch.column("label"), pa.array(vectors, pa.binary())], names=["vec_id", "node", "label", "vector"])

    return run


def hasher(s: Settings, rotations: int):
    """Task: nodes to one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("vector").to_pylist()
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for i in range(0, len(at), 2048):
                    some = at[i : i + 2048]
                    x = unit_rows([raw[k] for k in some], s.number)
                    # A batch for each table: all together could outgrow the memory.
                    for table in range(s.tables):
                        found = table_buckets(x, s, rotations, table)
                        rows, probe = np.nonzero(found >= 0)
                        own = pa.array(some[rows])
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("label").take(own), pa.array(np.full(len(rows), table, np.int32)), pa.array(found[rows, probe]), batch.column("node").take(own)],
                            names=["label", "bank", "bucket", "node"])

    return run


def first_meeting(a: np.ndarray, b: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Whether (table, bucket) is the first the pairs share. a, b: (pairs, tables, probes)."""
    fresh = np.ones(len(a), dtype=bool)
    for t in range(table + 1):
        for p in range(a.shape[2]):
            for q in range(b.shape[2]):
                same = (a[:, t, p] == b[:, t, q]) & (a[:, t, p] >= 0)
                if t == table:
                    same &= a[:, t, p] < bucket
                fresh &= ~same
    return fresh


def checker(s: Settings, rotations: int):
    """Task: rows sorted by bucket to (node, root, links): links counts rows behind newly met nodes."""

    def emit(rows: list[tuple]) -> dict[str, tuple[str, int]]:
        table, bucket, part = rows[0][1:4]
        # Vectors of another length share no bucket by right: each length is its own bucket.
        out: dict = {}
        by_size: dict[int, list[tuple]] = {}
        for r in rows:
            by_size.setdefault(len(r[7]), []).append(r)
        for same in by_size.values():
            out.update(bucket_links(same, table, bucket, part))
        return out

    def bucket_links(rows: list[tuple], table: int, bucket: int, part: int) -> dict:
        if len(rows) < 2:
            return {}
        own = np.array([r[4] for r in rows])
        count = np.array([r[6] for r in rows])
        x = unit_rows([r[7] for r in rows], s.number)
        across = part >= 0 and part >> 32 != part & 0xFFFFFFFF
        links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
        codes: np.ndarray | None = None
        for i in range(0, len(rows), 512):
            a, b = np.nonzero(x[i : i + 512] @ x[i:].T >= s.cosine)
            a, b = a + i, b + i
            ok = a < b
            if across:
                ok &= own[a] != own[b]
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            if codes is None:
                codes = buckets(x, s, rotations)
            for k in range(0, len(a), 100_000):
                p, q = a[k : k + 100_000], b[k : k + 100_000]
                new = first_meeting(codes[p], codes[q], table, bucket)
                np.add.at(links, p[new], count[q[new]])
                np.add.at(links, q[new], count[p[new]])
            while True:  # every node takes the smallest root among its neighbours
                low = np.minimum(root[a], root[b])
                before = root.copy()
                np.minimum.at(root, a, low)
                np.minimum.at(root, b, low)
                root = root[root]
                if (root == before).all():
                    break
        # Roots of earlier blocks may have been lowered by later ones.
        while (root[root] != root).any():
            root = root[root]
        hit = np.flatnonzero((links > 0) | (root != np.arange(len(rows))) | np.isin(np.arange(len(rows)), root[root != np.arange(len(rows))]))
        return {rows[i][5]: (rows[root[i]][5], int(links[i])) for i in hit}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("label", "bank", "bucket", "part", "own", "node", "n", "vector")]
            for row in zip(*columns, strict=True):
                if row[:4] != key:
                    if len(held) > 1:
                        out += [(n, r, c) for n, (r, c) in emit(held).items()]
                    key, held = row[:4], []
                held.append(row)
            yield _links(out)
        if len(held) > 1:
            yield _links([(n, r, c) for n, (r, c) in emit(held).items()])

    return run


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["node", "root", "links"])


def near_vectors(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    # Single precision holds what came in single precision; all other numbers are kept as doubles.
    single = vectors.select("embedding").schema[0].dataType.simpleString() == "array<float>"
    settings = replace(settings, number="<f4" if single else "<f8")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = stored(rows.mapInArrow(usable(settings.number), "vec_id long, node binary, label string, vector binary"), "vectors")
    nodes = stored(rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.min("vec_id").alias("least"), F.count("*").alias("n")), "vector-nodes")
    # One row per label; the largest decides how fine the buckets are.
    width = F.max(F.octet_length("vector")) / np.dtype(settings.number).itemsize
    size = nodes.groupBy("label").agg(F.count("*").alias("k"), width.cast("int").alias("width")).agg(F.max("k"), F.max("width")).first()
    s, rotations = plan(size[0] or 1, size[1] or 2, settings)
    # Hashed once, and dealt without the vectors: most buckets hold one node.
    coded = nodes.select("label", "node", "vector").mapInArrow(hasher(s, rotations), "label string, bank int, bucket long, node binary")
    coded = stored(coded.withColumn("key", F.xxhash64("label", "bank", "bucket")), "vector-buckets")
    # Buckets whose hashes collide are counted together here; they are told apart again below.
    counts = coded.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    crowd = stored(counts.select("key", F.ceil(F.col("k") / s.part_rows).cast("int").alias("parts")), "vector-crowds")
    met = coded.join(crowd.where("parts = 1").select("key"), "key", "left_semi").withColumns({"part": F.lit(-1).cast("long"), "own": F.lit(0)})
    hot = crowd.where("parts > 1")
    if not hot.isEmpty():
        # No more hot buckets than rows by part_rows. Their rows stay spread until they are dealt as pairs of parts.
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.shiftleft(F.least("own", j).cast("long"), 32) + F.greatest("own", j))
        split = coded.join(small(hot), "key").withColumn("own", own).withColumn("part", F.explode(pairs))
        met = met.unionByName(split.select(*met.columns))
    met = met.drop("key").join(nodes.select("node", "n", "vector"), "node")
    key = ["label", "bank", "bucket"]
    dealt = met.select(*key, "part", "own", "node", "n", "vector").repartition(*key, "part").sortWithinPartitions(*key, "part")
    links = stored(dealt.mapInArrow(checker(s, rotations), "node binary, root binary, links long"), "vector-links")
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    reach = smallest_reachable(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component", "top")
    known = nodes.select("node", "least", "n").join(reach, "node", "left").withColumn("top", F.coalesce("top", "node")).join(degree, "node", "left")
    known = stored(known, "vector-known")
    least = known.groupBy("top").agg(F.min("least").alias("component_id"))
    known = known.join(least, "top").select("node", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "node").join(known, "node", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
