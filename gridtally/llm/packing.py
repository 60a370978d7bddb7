"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Documents become token ids followed by an end id; only documents longer than a sequence are cut.
Pieces are dealt by hash into blocks of a bounded number of pieces. Each block is packed best fit,
longest first, and then improved: pieces are moved, exchanged one for one or two for one between
underfull sequences whenever that raises the sum of squared fills, which drains the emptiest ones
until they vanish, the block has as few sequences as its tokens need, or no such exchange is left. What the blocks leave
underfull is packed once more together, so the total is near the least possible at any size.

Defined results: a null or empty text is its end id alone; repeated rows are packed once each; a
null doc_id stays null. Extra columns are ignored. No tokens are dropped.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
import re
import sys
import types
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridtally.llm.common import stored, text_of
from gridtally.llm.textbuf import Words, buffer_of, slices, tidied

#: Bytes of words and ids that a worker remembers.
REMEMBERED = 96 << 20
#: Longer words are not remembered.
LONGEST = 64
#: Words of letters that have one lower case and one normal form, with the signs that may follow.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


# The rules of vocabularies in which each word between white space stands for itself.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class Memory:
    """A parsed vocabulary and the ids of words met lately, bounded in bytes.

    Words lie in two halves. When the new half is full the old one is forgotten and the halves change
    places; a word found in the old half moves to the new one, so frequent words stay.
    """

    def __init__(self, vocabulary: str, limit: int = REMEMBERED) -> None:
        rules = json.loads(vocabulary)
        self.wordwise = all(rules.get(k) == v for k, v in WORDWISE.items()) and not any(t["content"].split() != [t["content"]] for t in rules["added_tokens"])
        self.key = hashlib.sha256(vocabulary.encode()).hexdigest()
        self.tokenizer, self.signs = Tokenizer.from_str(vocabulary), byte_signs()
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bytes, self.limit = 0, limit

    def get(self, text: str) -> bytes | None:
        """Ids of a word that is not in the new half, if the old one has them."""
        got = self.old.get(text)
        return None if got is None else self.keep(text, got)

    def keep(self, text: str, ids: bytes) -> bytes:
        if len(text) <= LONGEST:
            # A text, its ids, and their place in the dictionary.
            size = 200 + len(text) + len(ids)
            if 2 * (self.bytes + size) > self.limit:
                self.old, self.ids, self.bytes = self.ids, {}, 0
            self.ids[text] = ids
            self.bytes += size
        return ids


def worker_memory(vocabulary: str) -> Memory:
    """The memory of this worker process: tasks are unpickled anew, so it hangs where they all find it."""
    holder = sys.modules.setdefault("_packing_memory", types.ModuleType("_packing_memory"))
    known = getattr(holder, "memory", None)
    if known is None or known.key != hashlib.sha256(vocabulary.encode()).hexdigest():
        known = holder.memory = Memory(vocabulary)
    return known


def _encoder(memory: Memory):
    """Ids of distinct words as unsigned 32-bit numbers, from the worker's memory where possible.

    The vocabulary's rule cuts at white space, letters and signs, and looks at each part alone, so
    the ids of a text are those of its parts. Simple words go straight to the merges; all others
    take the whole way.
    """
    tokenizer, signs, merge = memory.tokenizer, memory.signs, memory.tokenizer.model.tokenize

    def part(text: str) -> bytes:
        got = memory.ids.get(text) or memory.get(text)
        if got is None:
            seen = text if text.isascii() else "".join(signs[b] for b in text.encode())
            got = memory.keep(text, array("I", [t.id for t in merge(seen)]).tobytes())
        return got

    def ids_of(words: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = []
        hard: list[tuple[int, str]] = []
        for raw in words:
            word = raw.decode()
            simple = SIMPLE.fullmatch(word)
            if simple:
                letters, after = simple.groups()
                out.append(part(letters.lower()) + part(after) if after else part(letters.lower()))
            else:
                out.append(memory.ids.get(word) or memory.get(word))
                if out[-1] is None:
                    hard.append((len(out) - 1, word))
        for i in range(0, len(hard), 4096):
            some = hard[i : i + 4096]
            for (k, word), e in zip(some, tokenizer.encode_batch_fast([w for _, w in some], add_special_tokens=False), strict=True):
                out[k] = memory.keep(word, array("I", e.ids).tobytes())
        return out

    return ids_of


def whole_text_ids(texts: list[str], tokenizer: Tokenizer, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """As `text_ids`, for a vocabulary whose rules look across words."""
    ids = [[*e.ids, end_id] for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    at = np.cumsum([0, *map(len, ids)])
    return np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32, count=int(at[-1])), at


def text_ids(data: np.ndarray, offsets: np.ndarray, ids_of, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by the end id, and the n + 1 offsets of the texts in them."""
    words = Words(data, offsets)
    index, kinds = words.encoded()
    of_kind = ids_of(kinds.to_pylist())
    size = np.fromiter(map(len, of_kind), dtype=np.int64, count=len(of_kind)) // 4
    flat = np.frombuffer(b"".join(of_kind), dtype=np.uint32)
    first = np.cumsum(size) - size
    count = size[index] if len(index) else np.zeros(0, np.int64)
    until = np.concatenate([[0], np.cumsum(count)])
    ids = flat[np.arange(until[-1]) + np.repeat(first[index] - until[:-1], count)] if until[-1] else np.zeros(0, np.uint32)
    at = until[words.first]
    return np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))


def cutter(vocabulary: str, length: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_memory(vocabulary)
        ids_of = _encoder(memory)
        for batch in batches:
            for part in slices(batch, "text"):
                if memory.wordwise:
                    ids, at = text_ids(*buffer_of(part.column("text")), ids_of, end_id)
                else:
                    ids, at = whole_text_ids(part.column("text").to_pylist(), memory.tokenizer, end_id)
                n = -(-np.diff(at) // length)
                row = np.repeat(np.arange(part.num_rows), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * length
                a = at[row] + start
                b = np.minimum(a + length, at[row + 1])
                raw = memoryview(ids.astype("<u4")).cast("B")
                columns = [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(b - a),
                           pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[x:y].astype(np.int32) for x, y in zip(a, b, strict=True)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary_path: str, length: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, with their ids if wanted. The vocabulary file is read here and sent along."""
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(tidied(cutter(vocabulary, length, end_id, with_ids)), PIECE + ", ids array<int>" * with_ids)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin it fits."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms: list[int] = []  # the rooms that some bin has, sorted
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect.bisect_left(rooms, sizes[i])
        if at == len(rooms):
            bins.append([])
            target, room = len(bins) - 1, capacity
        else:
            room = rooms[at]
            target = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        bins[target].append(i)
        left = room - sizes[i]
        if left:
            if not by_room[left]:
                bisect.insort(rooms, left)
            by_room[left].append(target)
    return bins


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search: drain the emptiest bin into other underfull ones while squared fill rises.

    An exchange gives the fuller bin more than it takes, so the sum of squared fills rises with each
    and the search ends by itself: at the least possible bins, or where no exchange is left.
    """
    least = -(-sum(sizes) // capacity)
    stuck: set[int] = set()
    moved = False
    kinds: list[tuple | None] = [None] * len(bins)
    takes = None
    fill = [sum(sizes[i] for i in b) for b in bins]
    while len(bins) > least:
        open_bins = [k for k in range(len(bins)) if fill[k] < capacity and k not in stuck]
        if not open_bins:
            if not moved:
                break
            # What was stuck may have a move now that others have changed.
            stuck, moved = set(), False
            continue
        low = min(open_bins, key=lambda k: fill[k])
        while bins[low]:
            takes = takes or _takes(bins, sizes, kinds, fill, capacity)
            move = _best_move(bins, sizes, kinds, takes, fill, low)
            if move is None:
                break
            give, other, take = move
            bins[low] = [i for i in bins[low] if i not in give] + list(take)
            bins[other] = [i for i in bins[other] if i not in take] + list(give)
            kinds[low] = kinds[other] = takes = None
            gain = sum(sizes[i] for i in give) - sum(sizes[i] for i in take)
            fill[other] += gain
            fill[low] -= gain
            moved = True
        if bins[low]:
            stuck.add(low)
        else:
            last = len(bins) - 1
            takes = None
            for table in (bins, kinds, fill):
                table[low] = table[last]
                table.pop()
            stuck = {low if k == last else k for k in stuck if k != low}
    return bins


def _kinds(members: list[int], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct sizes of a bin's pieces, and the distinct sums of two of them.

    Distinct sizes in one bin are few, however many pieces it has: n of them need n * n / 2 tokens.
    """
    found = Counter(sizes[i] for i in members)
    single = sorted(found)
    double = {a + b for k, a in enumerate(single) for b in single[k + 1 :]} | {2 * a for a in single if found[a] > 1}
    return np.array(single, np.int64), np.array(sorted(double), np.int64)


def _takes(bins, sizes, kinds, fill, capacity) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bin, pieces, size, room): all that an underfull bin could give back, none to two pieces."""
    owners = [k for k in range(len(bins)) if fill[k] < capacity]
    for k in owners:
        if kinds[k] is None:
            kinds[k] = _kinds(bins[k], sizes)
    none = np.zeros(1, np.int64)
    parts = [x for k in owners for x in (none, *kinds[k])]
    owner = np.repeat(np.repeat(np.array(owners, np.int64), 3), [len(x) for x in parts])
    count = np.repeat(np.tile(np.arange(3), len(owners)), [len(x) for x in parts])
    return owner, count, np.concatenate(parts), capacity - np.array(fill, np.int64)[owner]


def _members(members: list[int], sizes: list[int], total: int, count: int) -> tuple[int, ...]:
    """`count` pieces (0 to 2) of the bin whose sizes have this sum."""
    if not count:
        return ()
    seen: dict[int, int] = {}
    for i in members:
        if count == 1 and sizes[i] == total:
            return (i,)
        if count == 2 and total - sizes[i] in seen:
            return (seen[total - sizes[i]], i)
        seen[sizes[i]] = i
    raise AssertionError("no such pieces")


def _best_move(bins, sizes, kinds, takes, fill, low):
    """(given, bin, taken) that shifts most tokens into one other bin, or None.

    All choices are looked at: one piece against none, one or two, and two against one.
    """
    owner, count, size, room = takes
    usable = (owner != low) & (np.array(fill, np.int64)[owner] >= fill[low])
    best, gain = None, 0
    for give, options in enumerate(kinds[low], 1):
        at = np.flatnonzero(usable & (count == 1) if give == 2 else usable)
        if not len(options) or not len(at):
            continue
        most = np.searchsorted(options, size[at] + room[at], side="right") - 1
        shift = np.where(most >= 0, options[most] - size[at], 0)
        top = int(shift.argmax())
        if shift[top] > gain:
            gain, k = int(shift[top]), int(owner[at[top]])
            best = (int(options[most[top]]), give, k, int(size[at[top]]), int(count[at[top]]))
    if best is None:
        return None
    given, give, k, taken, taking = best
    return _members(bins[low], sizes, given, give), k, _members(bins[k], sizes, taken, taking)


def packer(length: int, series: int):
    """Task: one block of pieces to its sequences. series: tells the sequences of the rounds apart."""

    def run(table: pa.Table) -> pa.Table:
        # The order must not depend on how rows arrive.
        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32", *(c for c in table.column_names if c == "mark"))])
        sizes = table.column("length").to_pylist()
        bins = improve(best_fit(sizes, length), sizes, length)
        sequence, offset, fill = (np.zeros(len(sizes), np.int64) for _ in range(3))
        for k, members in enumerate(bins):
            at = 0
            for i in members:
                sequence[i], offset[i] = k, at
                at += sizes[i]
            fill[members] = at
        sequence += (table.column("block").to_numpy().astype(np.int64) << 28) + (series << 60)
        columns = {"sequence_id": sequence, "offset": offset, "fill": fill}
        table = table.drop_columns(["block"])
        for name, values in columns.items():
            table = table.append_column(name, pa.array(values))
        return table

    return run


def _round(rows: DataFrame, count: int, length: int, block_rows: int, series: int) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    blocks = max(1, -(-count // block_rows))
    # Equal rows go apart by a number of their own, so no row is too frequent for one block.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    return stored(dealt.groupBy("block").applyInArrow(packer(length, series), schema + ", sequence_id long, offset long, fill long"), "packed")


def pack(found: DataFrame, length: int = 4096, block_rows: int = 5_000) -> DataFrame:
    """Pieces with sequence_id and offset. found: a stored table of pieces without ids.

    The sequences that a block leaves underfull are taken apart and packed once more with those of
    other blocks.
    """
    # A full piece is a sequence of its own; only the others are packed.
    alone = found.where(F.col("length") >= length).withColumns(
        {"sequence_id": -F.monotonically_increasing_id() - 1, "offset": F.lit(0).cast("long")})
    short = found.where(F.col("length") < length)
    first = _round(short, short.count(), length, block_rows, 0)
    rest = first.where(F.col("fill") < length).select(*found.columns)
    second = _round(rest, rest.count(), length, block_rows, 1)
    columns = [*found.columns, "sequence_id", "offset"]
    return first.where(F.col("fill") >= length).select(*columns).unionAll(second.select(*columns)).unionAll(alone.select(*columns))


def packed(docs: DataFrame, vocabulary_path: str, length: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    return pack(stored(pieces(docs, vocabulary_path, length, end_id), "pieces"), length)


def sequences(docs: DataFrame, vocabulary_path: str, length: int = 4096, end_id: int = 1) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, at most `length` ids each."""
    # Pieces that agree in all this hold the same ids, so any of them may lie in any of their places.
    names = ["doc_id", "piece", "length", "ids_crc32", "mark"]
    with_ids = stored(pieces(docs, vocabulary_path, length, end_id, with_ids=True).withColumn("mark", F.xxhash64("ids")), "pieces-ids")
    places = pack(with_ids.drop("ids"), length)
    text = with_ids.select(*names, "ids").dropDuplicates(names)
    keys = [places[c].eqNullSafe(text[c]) for c in names]
    rows = places.join(text, keys).select("sequence_id", F.struct("offset", "ids").alias("part"))
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["ids"])).alias("ids"))
