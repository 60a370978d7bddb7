"""SimHash near-dedup: segment-popcount embedding, grid join, exact check.

A 64-bit fingerprint is mapped to the bit counts of its 32 segments of two bits. The Manhattan
distance of two such vectors never exceeds the number of differing bits. The segments are grouped
into blocks, and fingerprints within `distance` bits have equal counts in at least `blocks -
distance` of them, so the grid cells are the counts of every choice of that many blocks. Within a
cell the Manhattan distance is the bound that discards most pairs, and the exact distance decides.

Equal fingerprints are one node from the start. A cell gives the links of a spanning star of each
group found in it, never its pairs: the search walks from node to node and compares each only with
those not reached yet, so a cell full of near copies costs about its size. Cells with very many
nodes are dealt as pairs of parts to several tasks, which together compare all of the cell.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like
any other; repeated rows and equal texts share a component; a null doc_id is linked but never
counts as the smallest unless its component has no other. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import quoted, smallest_reachable, stored, text_of, unused
from gridtally.llm.textbuf import Words, buffer_of, slices, tidied

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

EVEN = np.uint64(0x5555555555555555)
THREES = np.uint64(0x3333333333333333)


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int, block: int = 1 << 17) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit integers."""
    words = Words(data, offsets)
    # Words joined with one space each: a shingle is then one byte range.
    lengths = words.ends - words.starts
    joined = np.full(int(lengths.sum()) + len(lengths), 32, dtype=np.uint8)
    starts = np.cumsum(lengths + 1) - lengths - 1
    if len(lengths):
        joined[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = LOWER[data[words.inside]]
    view, ends = memoryview(joined), starts + lengths
    hash_of = xxhash.xxh64_intdigest
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    for i, (first, count) in enumerate(zip(words.first[:-1], words.counts, strict=True)):
        if not count:
            continue
        n = max(count - shingle + 1, 1)
        reach = min(shingle, count) - 1
        a, b = starts[first : first + n].tolist(), ends[first + reach : first + reach + n].tolist()
        ones = np.zeros(64, dtype=np.int64)
        for k in range(0, n, block):
            h = np.fromiter((hash_of(view[x:y], 42) for x, y in zip(a[k : k + block], b[k : k + block], strict=True)), dtype=">u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > n).view(">u8")[0]
    return out


def fingerprinter(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = fingerprints_of(*buffer_of(part.column("text")), shingle)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(found.view(np.int64))], names=["doc_id", "row", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, row, fp): fp is the fingerprint as a signed long; row tells rows apart that share a doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("row"), text_of().alias("text"))
    return rows.mapInArrow(tidied(fingerprinter(shingle)), "doc_id long, row long, fp long")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """The embedding: 32 two-bit fields, each the number of ones of its two bits."""
    return (fp & EVEN) + ((fp >> np.uint64(1)) & EVEN)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of two embeddings."""
    # Fields hold 0 to 2. With 4 added in four-bit fields no difference borrows from its neighbour.
    total = np.zeros(np.broadcast(a, b).shape, dtype=np.int64)
    four = np.uint64(0x4444444444444444)
    for shift in (np.uint64(0), np.uint64(2)):
        diff = ((a >> shift) & THREES) + four - ((b >> shift) & THREES)  # 2 to 6
        # |difference|: 2 and 6 give 2, 3 and 5 give 1, 4 gives 0.
        one = diff & np.uint64(0x1111111111111111)
        two = (~(diff >> np.uint64(2)) | (diff >> np.uint64(1))) & np.uint64(0x1111111111111111) & ~one
        total += np.bitwise_count(one).astype(np.int64) + 2 * np.bitwise_count(two).astype(np.int64)
    return total


def blocks_for(nodes: int, distance: int) -> int:
    """Number of blocks: as few as keep the expected nodes of a random cell near one."""
    wanted = math.log2(max(nodes, 2))
    for blocks in range(distance + 2, 33):
        # A two-bit segment's count holds 1.5 bits; blocks - distance of the blocks are compared.
        if 48 * (blocks - distance) / blocks >= wanted + 1:
            return blocks
    return 32


def masks(blocks: int, distance: int) -> list[int]:
    """For each choice of blocks that must agree: the mask of their segments."""
    edges = [round(32 * i / blocks) for i in range(blocks + 1)]
    block = [sum(3 << (2 * s) for s in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [sum(block[i] for i in chosen) for chosen in itertools.combinations(range(blocks), blocks - distance)]


def stars(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (first member, other member) of every group among the nodes of one cell."""
    counts = segment_counts(fp)
    left = np.arange(len(fp))
    roots, members = [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            x = queue.pop()
            near = manhattan(counts[left], counts[x]) <= distance
            near[near] = np.bitwise_count(fp[left[near]] ^ fp[x]) <= distance
            if near.any():
                hit = left[near]
                roots.append(np.full(len(hit), root))
                members.append(hit)
                queue.extend(hit.tolist())
                left = left[~near]
    if not roots:
        return fp[:0], fp[:0]
    return fp[np.concatenate(roots)], fp[np.concatenate(members)]


def cell_links(distance: int):
    """Task: (cell, fp) sorted by cell to the links (a, b) found in each cell."""

    def emit(cell: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        fp = np.concatenate(cell)
        return [stars(fp.view(np.uint64), distance)] if len(fp) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column("fp").to_numpy()
            key = np.stack([batch.column(c).to_numpy() for c in ("mask", "cell", "part")])
            ends = np.flatnonzero(np.append((key[:, 1:] != key[:, :-1]).any(axis=0), True)) + 1
            out, a = [], 0
            # Most cells hold one node: they are passed over without work.
            sizes = np.diff(ends, prepend=0)
            for b, n in zip(ends.tolist(), sizes.tolist(), strict=True):
                if a == 0:
                    now = tuple(key[:, 0])
                    if now != at and held:
                        out += emit(held)
                        held = []
                    at = now
                    held.append(fp[a:b])
                    if b < len(fp):
                        out += emit(held)
                        held = []
                elif b == len(fp):
                    at, held = tuple(key[:, a]), [fp[a:b]]
                elif n > 1:
                    out += emit([fp[a:b]])
                a = b
            yield from _links(out)
        if held:
            yield from _links(emit(held))

    return run


def _links(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    found = [x for x in found if len(x[0])]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in found]).view(np.int64)) for i in (0, 1)], names=["a", "b"])


def links(nodes: DataFrame, distance: int = 4, part_rows: int = 20_000) -> DataFrame:
    """(a, b) links that join the same fingerprints as all links within `distance` bits do.

    nodes: distinct fingerprints in column fp.
    """
    chosen = masks(blocks_for(nodes.count(), distance), distance)
    # Of each two bits: one set gives 01, both give 10.
    even, right = F.lit(int(EVEN)), F.shiftrightunsigned("fp", 1)
    both = F.shiftleft(F.col("fp").bitwiseAND(right).bitwiseAND(even), 1)
    counts = F.col("fp").bitwiseXOR(right).bitwiseAND(even).bitwiseOR(both)
    wide = nodes.withColumn("counts", counts)
    # A signed literal holds the same bits.
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    cells = wide.select("fp", F.posexplode(F.array(*(F.col("counts").bitwiseAND(F.lit(m)) for m in signed))).alias("mask", "cell"))
    sizes = cells.groupBy("mask", "cell").agg(F.count("*").alias("n")).where(F.col("n") > part_rows)
    hot = stored(sizes.withColumn("parts", F.ceil(F.col("n") / part_rows).cast("int")), "hot-cells")
    cells = cells.withColumn("part", F.lit(0))
    if not hot.isEmpty():
        # Nodes of a hot cell are dealt to parts, and every pair of parts becomes one unit of work.
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        joined = cells.join(hot, ["mask", "cell"], "left").withColumn("own", own)
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least("own", j) * F.col("parts") + F.greatest("own", j))
        cells = joined.select("fp", "mask", "cell", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("part"))
    dealt = cells.select("mask", "cell", "part", "fp").repartition("mask", "cell", "part").sortWithinPartitions("mask", "cell", "part")
    return dealt.mapInArrow(tidied(cell_links(distance)), "a long, b long")


def components(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, row, fp, component, component_id) of every document.

    component is the smallest fingerprint that links reach, component_id the smallest doc_id.
    """
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    reach = smallest_reachable(links(nodes.select("fp"), distance))
    # (fingerprint, component of fingerprints) to the smallest doc_id of the component.
    named = nodes.join(reach.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = stored(named, "fingerprint-components")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "component").select("fp", "component", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "row", "fp", "component", "component_id")


def digest(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), the fingerprint as 16 lowercase hex digits."""
    return components(docs, shingle, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row of each component: that of its smallest doc_id. If several rows share that, one of them.

    Components that share their smallest doc_id, or that all lack one, keep a row each.
    """
    doc, row, whole = (unused(docs, n) for n in ("kept_doc", "kept_row", "kept_whole"))
    chosen = components(docs, shingle, distance).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    none = F.lit(-(1 << 63))
    kept = chosen.groupBy("component").agg(F.first(F.coalesce("component_id", none)).alias(doc), F.min("row").alias(row)).select(doc, row)
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), none), row: F.xxhash64(text_of())})
    # The other columns as text, as not all kinds of column have an order.
    order = F.struct(text_of(), F.to_json(F.struct(F.lit(0).alias("none"), *quoted([c for c in docs.columns if c not in ("doc_id", "text")]))))
    # Equal rows fall into one group, which needs no further shuffle or sort after the join.
    rows = keyed.join(kept, [doc, row], "left_semi").groupBy(doc, row).agg(F.min_by(F.struct(*quoted(docs.columns)), order).alias(whole))
    return rows.select(*(F.col(whole).getField(c).alias(c) for c in docs.columns))
