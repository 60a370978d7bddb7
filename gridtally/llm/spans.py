"""Suffix-array dedup: repeated byte strings are removed from all but the smallest doc_id.

Every byte that lies in a string of `length` bytes which also starts in a document with a smaller
doc_id goes. The work is cut so that equal strings meet without sorting the suffixes of all text:

1. Each window of `length` bytes has an anchor, the 24-gram of least hash in it; equal windows have
   equal anchors. Anchor hashes travel as sorted, packed arrays, one row per slice of text and
   receiver, and those that only one document has are dropped there.
2. The windows of a shared anchor form a snippet of at most 76 bytes around it. Snippets of equal
   anchors meet in one task, which joins them to one text and sorts its suffixes in two stages:
   only suffixes smaller than their successors are sorted directly, the others are induced by one
   scan over the buckets of the first byte. Adjacent common prefixes of at least `length` bytes are
   groups of equal windows, and a group's smallest doc_id decides for all of it.
3. Decisions come back as bit masks per snippet, are gathered per document and cut from its text.

Exact copies of a smaller doc_id's whole text go as a whole and take no part in the search.

A document's shared anchors are gathered by doc_id. Ids that very many rows have (null among them) are
dealt to parts by their texts, each distinct text once, so that a list holds the anchors of few texts.

Anchors that very many documents share are told apart while the text is read (they repeat within
one slice) or when their documents are counted; their snippets are first folded to distinct ones,
and then their windows are compared by grouped minima, so no task ever holds all documents of a
passage.

Defined results: a null text is empty; a null doc_id is smaller than all others; rows that share a
doc_id do not remove from each other and are each judged alone; texts below `length` bytes stay.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtally.llm.common import partitions, small, stored, text_of
from gridtally.llm.textbuf import buffer_of, slices, tidied

GRAM = 24
NO_ID = -(1 << 63)
#: Bits of an anchor hash; the six below hold the place of the least hash in a window.
HASH_BITS = 58
#: Documents of one slice that share an anchor from which on it counts as very common.
COMMON = 32
#: Documents with an anchor from which on it counts as very common wherever they lie.
MANY = 20_000
#: Rows of one doc_id from which on they are dealt to parts of about as many rows.
REPEATS = 64


# --- anchors -------------------------------------------------------------------------------------


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one integer."""
    return np.ndarray((max(len(data) - 7, 0),), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text index, first window, number of windows and anchor hash of every run of windows with one anchor."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none
    eight = words_at(data)
    h = eight[:-16] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += eight[8:-8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(31)
    h += eight[16:] * np.uint64(0x85EBCA77C2B2AE63)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h &= np.uint64(0xFFFFFFFFFFFFFFC0)
    h |= np.arange(len(h), dtype=np.uint64) & np.uint64(63)
    width, covered, least = length - GRAM + 1, 1, h
    while covered * 2 <= width:
        least = np.minimum(least[:-covered], least[covered:])
        covered *= 2
    if covered < width:
        least = np.minimum(least[: len(least) - (width - covered)], least[width - covered :])
    # Windows that lie in one text.
    valid = np.ones(len(least), dtype=bool)
    for end in offsets[1:-1]:
        valid[max(end - length + 1, 0) : end] = False
    start = np.flatnonzero(valid)
    least = least[start]
    place = start + ((least - start.astype(np.uint64)) & np.uint64(63)).astype(np.int64)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    text = np.searchsorted(offsets, start[first], side="right") - 1
    return text, start[first], count, (least[first] >> np.uint64(6)).astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Integers as planes of bytes, which compress well where the high bytes are zero."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def anchors(length: int, receivers: int):
    """Task: (doc_id, part, text) to packed anchors, one row per slice and receiver.

    docs and parts: one entry per text; no parts at all where all are 0. hashes: sorted differences. owners: places in docs, twice, plus one for a stand-in of a common
    anchor. known rows hold common anchors themselves: they need no partner.
    """

    def rows(receiver: int, known: bool, h: np.ndarray, owner: np.ndarray, docs: bytes, parts: bytes) -> tuple:
        return receiver, known, zlib.compress(_packed(np.diff(h, prepend=0)), 1), zlib.compress(_packed(owner), 1), docs, parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, _, _, h = runs(*buffer_of(part.column("text")), length)
                if not len(h):
                    continue
                order = np.lexsort((text, h))
                text, h = text[order], h[order]
                once = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))
                text, h = text[once], h[once]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                count = np.diff(np.append(first, len(h)))
                common = np.repeat(count >= COMMON, count)
                stand_in = np.zeros(len(h), dtype=bool)
                stand_in[first[count >= COMMON]] = True
                docs = zlib.compress(_packed(np.diff(part.column("doc_id").to_numpy(), prepend=0)), 1)
                parts = part.column("part").to_numpy()
                parts = zlib.compress(_packed(parts), 1) if parts.any() else b""
                out = []
                if common.any():
                    out.append(rows(int(h[0] % receivers), True, h[common], text[common], docs, parts))
                test = ~common | stand_in
                h, owner = h[test], 2 * text[test] + stand_in[test]
                # A receiver has a range of hashes, so its part is one stretch.
                to = ((h >> (HASH_BITS - 31)) * receivers) >> 31
                edges = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                for a, b in zip(edges, np.append(edges[1:], len(h)), strict=True):
                    out.append(rows(int(to[a]), False, h[a:b], owner[a:b], docs, parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.bool_()), *(pa.array([r[k] for r in out], pa.binary()) for k in (2, 3, 4, 5))],
                    names=["receiver", "known", "hashes", "owners", "docs", "parts"])

    return run


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the packed anchors of some receivers to (doc_id, part, anchor, common) of the shared ones."""

    def rows(doc: np.ndarray, part: np.ndarray, h: np.ndarray, common: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(h), 1 << 17):
            s = slice(i, i + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(part[s]), pa.array(h[s]), pa.array(common[s])], names=["doc_id", "part", "anchor", "common"])

    def settled(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, doc, stand_in, part = (np.concatenate([x[k] for x in held]) for k in range(4))
        order = np.lexsort((doc, h))
        h, doc, stand_in, part = h[order], doc[order], stand_in[order], part[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        last = np.append(first[1:], len(h)) - 1
        size = last - first + 1
        common = np.repeat(np.logical_or.reduceat(stand_in, first) | (size >= MANY), size)
        take = (np.repeat(doc[first] != doc[last], size) | common) & ~stand_in
        yield from rows(doc[take], part[take], h[take], common[take])

    held, at = [], None
    for batch in batches:
        for receiver, known, hashes, owners, docs, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = np.cumsum(_unpacked(zlib.decompress(docs)))
            of_id = _unpacked(zlib.decompress(parts)).astype(np.int32) if parts else np.zeros(len(ids), dtype=np.int32)
            h, owner = np.cumsum(_unpacked(zlib.decompress(hashes))), _unpacked(zlib.decompress(owners))
            if known:
                yield from rows(ids[owner], of_id[owner], h, np.ones(len(h), dtype=bool))
                continue
            if receiver != at and held:
                yield from settled(held)
                held = []
            at = receiver
            held.append((h, ids[owner >> 1], (owner & 1).astype(bool), of_id[owner >> 1]))
    if held:
        yield from settled(held)


# --- snippets ------------------------------------------------------------------------------------


def snippets(length: int):
    """Task: texts with their shared anchors to one row per run of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, offsets = buffer_of(part.column("text"))
                text, start, count, h = runs(data, offsets, length)
                lists = part.column("anchors")
                size = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                wanted, common = flat.field("anchor").to_numpy(), flat.field("common").to_numpy(zero_copy_only=False)
                # Text and anchor in one number; a chance match only adds a snippet to compare.
                mark = lambda t, a: (a ^ (t * np.int64(0x2545F4914F6CDD1D)))
                with np.errstate(over="ignore"):
                    want, have = mark(np.repeat(np.arange(part.num_rows, dtype=np.int64), size), wanted), mark(text, h)
                hit = np.isin(have, want)
                often = np.isin(have, want[common])[hit]
                text, start, count, h = text[hit], start[hit], count[hit], h[hit]
                long = count + length - 1
                until = np.concatenate([[0], np.cumsum(long)])
                raw = data[np.arange(until[-1]) + np.repeat(start - until[:-1], long)] if len(long) else data[:0]
                own = pa.array(text)
                body = pa.Array.from_buffers(pa.binary(), len(long), [None, pa.py_buffer(until.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(often), body, part.column("doc_id").take(own), part.column("row").take(own), pa.array((start - offsets[text]).astype(np.int64))],
                    names=["anchor", "common", "snippet", "doc_id", "row", "start"])

    return run


# --- suffix array --------------------------------------------------------------------------------


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` bytes, by two-stage sorting.

    Suffixes smaller than their successors are sorted directly, eight bytes at a time and only
    where still tied. All others follow from one scan over the buckets of the first byte: once a
    bucket is in order, the suffixes that begin one byte earlier with a larger byte are appended
    to theirs in that order; those that begin with the same byte extend the bucket itself.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    text = data.astype(np.int16)
    # Smaller than the successor: the next different byte is larger; the end counts as smallest.
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    next_change = np.repeat(change, np.diff(np.append(-1, change)))
    follows = np.append(text, -1)[next_change + 1]
    smaller = follows > text
    eight = words_at(np.concatenate([data, np.zeros(depth + 16, dtype=np.uint8)])).byteswap()
    direct = np.flatnonzero(smaller)
    direct = direct[np.argsort(eight[direct])]
    # same: equal so far to the suffix before.
    same = np.append(False, eight[direct][1:] == eight[direct][:-1]) if len(direct) else np.zeros(0, dtype=bool)
    for at in range(8, depth, 8):
        places = np.flatnonzero(same | np.append(same[1:], False))
        if not len(places):
            break
        group = np.cumsum(~same)[places]
        key = eight[direct[places] + at]
        order = np.lexsort((key, group))
        direct[places], key = direct[places][order], key[order]
        same[places] &= np.append(False, key[1:] == key[:-1])
    # The scan over the buckets, smallest first byte first.
    head = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    last = n - 1  # the last suffix has the empty one before it, the smallest of all
    induced[text[last]].append(np.array([last]))
    done = []
    for byte in range(256):
        sorted_here = direct[head[byte] : head[byte + 1]]
        fresh = np.concatenate(induced[byte]) if induced[byte] else np.zeros(0, dtype=np.int64)
        whole = [fresh]
        while len(fresh):  # runs of one byte: each round prepends it once more
            before = fresh[fresh > 0] - 1
            fresh = before[text[before] == byte]
            whole.append(fresh)
        bucket = np.concatenate([*whole, sorted_here])
        if not len(bucket):
            continue
        done.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > byte]
        if len(before):
            by_byte = np.argsort(text[before], kind="stable")
            before = before[by_byte]
            edges = np.flatnonzero(np.append(True, text[before][1:] != text[before][:-1]))
            for a, b in zip(edges, np.append(edges[1:], len(before)), strict=True):
                induced[text[before[a]]].append(before[a:b])
    return np.concatenate(done)


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it, `depth` at most."""
    eight = words_at(np.concatenate([data, np.zeros(depth + 16, dtype=np.uint8)])).byteswap()
    out = np.zeros(len(order), dtype=np.int64)
    alive = np.arange(1, len(order))
    for at in range(0, depth, 8):
        differ = eight[order[alive] + at] ^ eight[order[alive - 1] + at]
        ends = differ != 0
        # The highest set bit, with the one below it cleared so that no rounding lifts it.
        high = np.frexp((differ[ends] & ~(differ[ends] >> np.uint64(1))).astype(np.float64))[1]
        out[alive[ends]] += (64 - high) >> 3
        alive = alive[~ends]
        out[alive] += 8
    return np.minimum(out, depth)


def decide(snippet: pa.Array, doc: np.ndarray, length: int) -> np.ndarray:
    """For each snippet a mask of its windows that also start in a smaller doc."""
    kinds = snippet.dictionary_encode()
    own, distinct = kinds.indices.to_numpy(), kinds.dictionary
    offsets = np.frombuffer(distinct.buffers()[1], dtype=np.int32, count=len(distinct) + 1).astype(np.int64)
    data = np.frombuffer(distinct.buffers()[2], dtype=np.uint8, count=int(offsets[-1]))
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, own, doc)

    order = suffix_array(data, length)
    group = np.cumsum(common_prefixes(data, order, length) < length) - 1
    # Suffixes too near the end of their snippet are no windows.
    size = np.diff(offsets)
    holder = np.repeat(np.arange(len(distinct)), size)
    real = np.arange(len(data)) <= (offsets[1:] - length)[holder]
    value = np.where(real, least[holder], np.iinfo(np.int64).max)[order]
    smallest = np.minimum.reduceat(value, np.flatnonzero(np.append(True, group[1:] != group[:-1])))
    window = np.empty(len(data), dtype=np.int64)
    window[order] = smallest[group]

    count = (size - length + 1)[own]
    until = np.concatenate([[0], np.cumsum(count)])
    bit = np.arange(until[-1]) - np.repeat(until[:-1], count)
    gone = window[np.repeat(offsets[own], count) + bit] < np.repeat(doc, count)
    return np.add.reduceat(gone.astype(np.int64) << bit, until[:-1])


def decider(length: int, most: int = 1 << 19):
    """Task: snippets sorted by anchor to (doc_id, row, start, mask), whole anchors at a time.

    Folded rows come decided: the smallest doc of each window, and the places that have the snippet.
    """

    def folded(rows: list[str]) -> Iterator[pa.RecordBatch]:
        for row in map(json.loads, rows):
            least = np.array(row["smallest"], dtype=np.int64)
            own = [np.array([p[c] for p in row["places"]], dtype=np.int64) for c in ("doc_id", "row", "start")]
            gone = least[None, :] < own[0][:, None]
            mask = (gone.astype(np.int64) << np.arange(len(least))).sum(axis=1)
            some = mask != 0
            yield pa.RecordBatch.from_arrays([*(pa.array(c[some]) for c in own), pa.array(mask[some])], names=["doc_id", "row", "start", "mask"])

    def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        mask = decide(table.column("snippet").chunk(0), table.column("doc_id").to_numpy(), length)
        some = pa.array(np.flatnonzero(mask))
        return pa.RecordBatch.from_arrays([*(table.column(c).chunk(0).take(some) for c in ("doc_id", "row", "start")), pa.array(mask).take(some)], names=["doc_id", "row", "start", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if batch.column("folded")[0].is_valid:  # folded rows come in partitions of their own
                yield from folded(batch.column("folded").to_pylist())
                continue
            anchor = batch.column("anchor").to_numpy()
            bytes_to = np.cumsum(np.diff(np.frombuffer(batch.column("snippet").cast(pa.large_binary()).buffers()[1], dtype=np.int64, count=batch.num_rows + 1)))
            start = 0
            # Places where an anchor begins; one may have begun in an earlier batch.
            cuts = np.flatnonzero(np.append(not held or anchor[0] != held[-1].column("anchor")[-1].as_py(), anchor[1:] != anchor[:-1]))
            while start < batch.num_rows:
                base = bytes_to[start - 1] if start else 0
                full = int(np.searchsorted(bytes_to, base + most - size))
                ahead = cuts[(cuts > start) & (cuts > full)] if start or held else cuts[cuts > full]
                if start == 0 and held and size >= most and len(cuts):
                    ahead = cuts
                stop = int(ahead[0]) if len(ahead) else batch.num_rows
                if stop > start:
                    held.append(batch.slice(start, stop - start))
                    size += int(bytes_to[stop - 1] - base)
                if len(ahead):
                    yield emit(held)
                    held, size = [], 0
                start = stop
        if held:
            yield emit(held)

    return run


def folded_common(rows: DataFrame, length: int) -> DataFrame:
    """(snippet, folded) of the snippets of very common anchors, by grouped minima.

    folded is JSON: the smallest doc of each window, and the places of the snippet. (Arrays that are
    null in all other rows would cost more on their way to Python than the search itself.)

    Equal snippets are folded first, then equal windows of distinct snippets; both before a shuffle.
    The places of a snippet are dealt to many rows by document.
    """
    deal = partitions(rows.sparkSession)
    distinct = stored(rows.groupBy("snippet").agg(F.min("doc_id").alias("least")), "span-common")
    windows_of = F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("snippet") - (length - 1)), lambda i: F.substring("snippet", i, F.lit(length))))
    windows = distinct.select("snippet", windows_of.alias("bit", "window"), "least")
    least = windows.groupBy("window").agg(F.min("least").alias("smallest"))
    judged = windows.join(least, "window").groupBy("snippet").agg(F.sort_array(F.collect_list(F.struct("bit", "smallest"))).alias("judged"))
    judged = judged.select("snippet", F.transform("judged", lambda w: w["smallest"]).alias("smallest"))
    places = rows.groupBy("snippet", F.pmod(F.xxhash64("doc_id", "row"), F.lit(deal)).alias("dealt")).agg(F.collect_list(F.struct("doc_id", "row", "start")).alias("places"))
    return places.join(judged, "snippet").select("snippet", F.to_json(F.struct("smallest", "places")).alias("folded"))


# --- documents -----------------------------------------------------------------------------------


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): ids with a stand-in for null; row tells rows apart that share one."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text_of()).alias("row"), text_of().alias("text"))


def parted(rows: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """rows and copies with `part`, and whether any id has parts.

    part is 0, or from 1 on where more than REPEATS rows have the doc_id; there, rows of one text are
    one, as what is found for one goes for all of them.
    """
    counted = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > REPEATS)
    often = stored(counted, "span-ids")
    if often.isEmpty():
        return rows.withColumn("part", F.lit(0)), copies.withColumn("part", F.lit(0)), False
    often = small(often)
    part = F.coalesce(1 + F.pmod("row", F.expr("n div %d" % REPEATS)), F.lit(0)).cast("int").alias("part")
    marked = rows.join(often, "doc_id", "left")
    many = marked.where("n IS NOT NULL").groupBy("doc_id", "row", "n").agg(F.first("text").alias("text"))
    many = stored(many.select("doc_id", "row", "text", part), "span-repeated", "zstd")
    few = marked.where("n IS NULL").select("doc_id", "row", "text", part)
    return few.unionAll(many), copies.join(often, "doc_id", "left").select("doc_id", "row", part), True


def masks(docs: DataFrame, copies: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, row, start, mask): of the windows that start at `start` and after, those repeated from a smaller doc_id.

    Rows of `copies` are not looked at: what they hold, a smaller doc_id holds too.
    """
    if not GRAM <= length <= GRAM + 47:
        raise ValueError("the strings must have 24 to 71 bytes")
    spark = docs.sparkSession
    rows = keyed(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About four million anchors a receiver at most.
    receivers = 4 * max(partitions(spark), total // (64 << 20))
    rows, copies, repeated = parted(rows, copies)
    sent = rows.select("doc_id", "part", "text").mapInArrow(tidied(anchors(length, receivers)), "receiver int, known boolean, hashes binary, owners binary, docs binary, parts binary")
    met = sent.repartition(receivers // 4, "receiver").sortWithinPartitions("receiver").mapInArrow(tidied(shared), "doc_id long, part int, anchor long, common boolean")
    if repeated:
        met = stored(met, "span-shared")
        met = met.where("part = 0").unionAll(met.where("part > 0").distinct())
    by_doc = met.groupBy("doc_id", "part").agg(F.collect_list(F.struct("anchor", "common")).alias("anchors"))
    copied = copies.groupBy("doc_id", "part").agg(F.collect_set("row").alias("copied"))
    with_text = rows.join(by_doc.join(copied, ["doc_id", "part"], "left"), ["doc_id", "part"]).where(~F.coalesce(F.array_contains("copied", F.col("row")), F.lit(False)))
    cut = with_text.select("doc_id", "row", "text", "anchors").mapInArrow(tidied(snippets(length)), "anchor long, common boolean, snippet binary, doc_id long, row long, start long")
    cut = stored(cut, "span-snippets", "zstd")
    plain = cut.where("not common").drop("common").repartition("anchor").sortWithinPartitions("anchor")
    folded = folded_common(cut.where("common"), length)
    lacking = {c: F.lit(None).cast(t) for c, t in plain.dtypes if c != "snippet"}
    both = plain.withColumn("folded", F.lit(None).cast("string")).unionByName(folded.withColumns(lacking))
    return both.mapInArrow(tidied(decider(length)), "doc_id long, row long, start long, mask long")


def exact_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, row) of the rows whose whole text a smaller doc_id has too."""
    # Two hashes of different kinds tell texts apart.
    narrow = keyed(docs).select("doc_id", "row", F.unhex(F.md5("text")).alias("key"))
    groups = narrow.groupBy("key", "row").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return stored(narrow.join(groups, ["key", "row"]).where("doc_id > least").select("doc_id", "row").distinct(), "span-copies")


def removed_bytes(size: int, starts: np.ndarray, mask: np.ndarray, length: int) -> np.ndarray:
    """Which bytes of a text the masked windows cover."""
    edge = np.zeros(size + 1, dtype=np.int64)
    for bit in range(length):
        s = starts[(mask >> bit) & 1 == 1] + bit
        np.add.at(edge, s, 1)
        np.add.at(edge, s + length, -1)
    return np.cumsum(edge[:-1]) > 0


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"


def deduplicated(docs: DataFrame, length: int = 50) -> DataFrame:
    """The rows of CUT, one per document; spans are the removed (start, end) byte ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            texts = batch.column("text")
            for i, marks in enumerate(batch.column("marks")):
                raw = (texts[i].as_py() or "").encode()
                if marks.is_valid:
                    start, mask = (marks.values.field(c).to_numpy() for c in ("start", "mask"))
                    whole = (start < 0).any()  # an exact copy
                    gone = np.full(len(raw), len(raw) >= length) if whole else removed_bytes(len(raw), start, mask, length)
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    spans = edges.reshape(-1, 2).tolist()
                    kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                else:
                    spans, kept = [], raw
                out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans))
            types = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([o[k] for o in out], t) for k, t in enumerate(types))], names=[c.split()[0] for c in CUT.split(", ")])

    copies = exact_copies(docs)
    found = stored(masks(docs, copies, length), "span-masks").unionAll(copies.selectExpr("doc_id", "row", "-1L as start", "0L as mask"))
    marks = found.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
    joined = keyed(docs).join(marks, ["doc_id", "row"], "left").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", "marks")
    return joined.mapInArrow(tidied(run), CUT)
