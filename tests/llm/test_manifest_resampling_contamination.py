"""Merkle manifest, importance resampling and benchmark decontamination against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridtally.llm import contamination, merkle, ranks, resampling
from tests.llm.conftest import DOCS, MESSY, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
ITEMS = "item_id long, text string, row string, words string"


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], ITEMS)


# --- places ---


def test_ranked_numbers_rows_of_every_group(spark):
    rows = [(None if i % 3 == 0 else f"g{i % 4}", None if i % 7 == 0 else i % 5) for i in range(700)]
    got = ranks.ranked(spark.createDataFrame(rows, "g string, v int").repartition(6), ["g"], ["v"]).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["pos"])
        assert [r["pos"] for r in mine] == list(range(len(mine))) and {r["n"] for r in mine} == {len(mine)}
        assert [r["v"] for r in mine] == sorted((v for h, v in rows if h == g), key=lambda v: (v is not None, v or 0))


# --- Merkle manifest ---


def leaf(row, text):
    cells = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in cells))


def levels_of(nodes, width):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + width])) for i in range(0, len(levels[-1]), width)])
    return levels


def siblings(levels, i, width):
    out = []
    for level in levels[:-1]:
        run, k = level[i // width * width : i // width * width + width], i % width
        out.append(("".join(run[:k]), "".join(run[k + 1 :])))
        i //= width
    return out


def brute_manifest(rows, width=16):
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by_source[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = {s: levels_of([leaf(r, r["text"]) for r in by_source[s]], width) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources], width) if rows else []
    out = Counter()
    for k, s in enumerate(sources):
        for i, r in enumerate(by_source[s]):
            steps = siblings(trees[s], i, width) + siblings(top, k, width)
            found = r["text"]
            if found is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                found = found.translate(LOWER)
            node = leaf(r, found)
            for a, b in steps:
                node = sha(a + node + b)
            root = top[-1][0]
            out[r["doc_id"], leaf(r, r["text"]), trees[s][-1][0], root, sha("".join(a + b for a, b in steps)), node, node == root] += 1
    return out


def manifest_rows(df, width=16):
    return Counter(tuple(r) for r in merkle.digest(df, width).collect())


def test_manifest_of_odd_rows(messy, nothing):
    rows = messy.collect()
    assert manifest_rows(messy) == brute_manifest(rows)
    assert manifest_rows(messy, 2) == brute_manifest(rows, 2)
    assert manifest_rows(nothing) == Counter()


def test_manifest_of_sources_of_all_sizes(spark):
    sizes = [1, 2, 16, 17, 255, 256, 257, 4097]
    rows = [(i * 10_000 + j, f"Text {j}" if j % 7 else None, f"s{i}" if i else None) for i, n in enumerate(sizes) for j in range(n)]
    df = spark.createDataFrame(documents(rows), DOCS).repartition(5)
    assert manifest_rows(df) == brute_manifest(df.collect())


def test_manifest_of_one_hot_source_and_many_sources(spark):
    rows = [(None if j % 3 else j, f"Same {j % 4}", f"s{j % 37 if j % 2 else 0}") for j in range(900)]
    df = spark.createDataFrame(documents(rows), DOCS)
    assert manifest_rows(df) == brute_manifest(df.collect())
    assert manifest_rows(df, 3) == brute_manifest(df.collect(), 3)  # five rounds


def test_manifest_tells_changed_rows(spark):
    df = spark.createDataFrame(documents([(i, "All Upper" if i % 2 else "all lower", "a") for i in range(40)]), DOCS)
    for r in merkle.digest(df).collect():
        tampered = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] % 2 == 1
        assert r["verified"] == (not tampered) == (r["folded_root"] == r["root"])


# --- importance resampling ---


def hashed(text):
    w = words_of(text)
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resampled(docs, items):
    found = [(i, *hashed(t)) for i, t in docs]
    s, t = (Counter(b for _, f in rows for b in f) for rows in ([f[1:] for f in found], [hashed(x) for _, x in items]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, f in found:
        h = int(sha(f"42:{'' if i is None else i}")[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def assert_resampled(docs, items):
    got = Counter(tuple(r) for r in resampling.resampled(docs, items).collect())
    assert got == brute_resampled(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))


def test_resampling_of_odd_rows(spark, messy, nothing):
    items = benchmark(spark, [(1, "One two-three! this passage of more"), (2, None), (3, "word " * 30)])
    assert_resampled(messy, items)
    assert_resampled(messy, benchmark(spark, []))
    assert resampling.resampled(nothing, items).count() == 0


def test_resampling_with_ties_and_repeated_rows(spark):
    rows = [(7, "x a-b,c d e f g h i J. k z " * 4, "s")] * 300 + [(None, "é one two THREE four " * 8, "s")] * 150
    rows += [(i, f"{'w' * 100} {'v' * (30 + i % 5)} ünï 漢字 number {i % 9} " * 9, "s") for i in range(200)]
    assert_resampled(spark.createDataFrame(documents(rows), DOCS).repartition(5), benchmark(spark, [(1, "one two three a b c"), (2, "w" * 100)]))


def test_cutoff_widens_a_bracket_that_misses(spark):
    # A coarse sketch of few kinds of scores: the k-th row is found all the same.
    rng = np.random.default_rng(3)
    values = [(int(i), int(v)) for i, v in enumerate(np.where(rng.random(3000) < 0.97, 5, rng.integers(0, 1000, 3000)))]
    df = spark.createDataFrame(values, "doc_id long, score long")
    order = sorted((-v, i) for i, v in values)
    for k in (1, 2, 17, 150, 1500, 3000):
        assert resampling.cutoff(df, k, len(values), k_sketch=8) == (-order[k - 1][0], order[k - 1][1])


def test_crc_of_joined_parts():
    crc, rng = resampling.Crc(), np.random.default_rng(1)
    parts = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in zip(rng.integers(0, 80, 400), rng.integers(0, 5000, 400), strict=True)]
    left, right = (np.array([zlib.crc32(p[k]) for p in parts], dtype=np.uint32) for k in (0, 1))
    got = crc.joined(left, right, np.array([len(p[1]) for p in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


# --- benchmark decontamination ---


def windows_of(items, width=10):
    found = {}
    for i, t in items:
        w = words_of(t)
        for j in range(max(1, len(w) - width + 1) if w else 0):
            found.setdefault(tuple(w[j : j + width]), set()).add(i)
    return found


def brute_contamination(docs, items):
    found, out = windows_of(items), Counter()
    for i, t in docs:
        w, hit, names = words_of(t), set(), set()
        for n in {len(k) for k in found}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in found:
                    hit |= set(range(s, s + n))
                    names |= {str(x) for x in found[tuple(w[s : s + n])] if x is not None}
        out[i, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)] += 1
    return out


ZEROS = " ".join(["0"] * 40)
HELD = [
    (1, "One two-three!"), (2, "A b c d e f g h i j k"), (3, ""), (4, None), (None, "É"), (10, "zero " + ZEROS), (11, ZEROS),
    (12, "same same"), (12, "same word"), (13, "never seen words"), (14, "this passage of more than fifty bytes is shared by several of"),
]
LEAKED = [
    (20, "...one Two three"), (21, "a b c d e f g h i j k l"), (22, ZEROS * 50), (None, "É one two THREE four"), (23, "é ONE"),
    (24, "x a-b,c d e f g h i J. k z"), (24, "x a-b,c d e f g h i J. k z"), (25, "same same same word"), (26, "Same word"),
]


@pytest.fixture(scope="module")
def leaked(spark):
    return spark.createDataFrame(documents(MESSY + [(i, t, "s") for i, t in LEAKED]), DOCS).repartition(3)


def assert_contamination(docs, items):
    got = Counter(tuple(r) for r in contamination.digest(docs, items).collect())
    assert got == brute_contamination(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))


def test_contamination_of_odd_rows(spark, leaked, nothing):
    items = benchmark(spark, HELD)
    assert_contamination(leaked, items)
    assert_contamination(leaked, benchmark(spark, []))
    assert contamination.digest(nothing, items).count() == 0


def test_contamination_where_a_passage_is_frequent(spark):
    passage = "the quick brown fox jumps over the lazy dog while two cats look on"
    rows = [(i, f"w{i} " * (i % 5) + passage.upper() * (i % 3 > 0) + f" t{i % 7}" * 9, "s") for i in range(400)]
    assert_contamination(spark.createDataFrame(documents(rows), DOCS).repartition(7), benchmark(spark, [(1, passage), (2, passage[4:]), (3, "t1 " * 12)]))


def test_index_is_the_same_without_a_broadcast(spark, leaked):
    asked = contamination.phrases(benchmark(spark, HELD))
    a, b = (contamination.build_index(leaked, asked.vocabulary, max_words=n) for n in (500_000, 0))
    for part in ("postings", "documents"):
        x, y = (getattr(i, part) for i in (a, b))
        assert Counter(x.collect()) == Counter(y.collect())
    terms = {r["term"]: r["word"] for r in asked.vocabulary.collect()}
    by_row = {r["row"]: r["n_words"] for r in a.documents.collect()}
    assert sum(by_row.values()) == sum(len(words_of(t)) for _, t in pairs(leaked, "doc_id", "text"))
    want = Counter(w for _, t in pairs(leaked, "doc_id", "text") for w in words_of(t))
    got = Counter(terms[r["term"]] for r in a.postings.collect())
    assert got == Counter({w: n for w, n in want.items() if w in set(terms.values())})


def test_proximity_matches(spark, leaked):
    items = [(1, "lazy fox quick"), (2, "two cats"), (3, "zero"), (4, "one two three four"), (5, "same same word"), (6, "a k z")]
    extra = [(50, "the QUICK brown fox is lazy; cats, all two of them"), (51, "fox " + "x " * 30 + "quick lazy"), (52, "zero cats and one two")]
    docs = spark.createDataFrame(documents(MESSY + [(i, t, "s") for i, t in LEAKED + extra]), DOCS).repartition(3)
    asked = contamination.phrases(benchmark(spark, items))
    index = contamination.build_index(docs, asked.vocabulary)
    rank = {(r["freq"], r["term"]): r["word"] for r in index.postings.groupBy("term").count().withColumnRenamed("count", "freq").join(asked.vocabulary, "term").collect()}
    order = {word: k for k, (_, word) in enumerate(sorted(rank.items()))}
    for within in (0, 4, 20):
        want = Counter()
        for i, t in pairs(docs, "doc_id", "text"):
            w = words_of(t)
            for phrase in windows_of(items):
                if all(p in order for p in phrase):
                    rarest = min(phrase, key=order.get)
                    for at, word in enumerate(w):
                        if word == rarest and set(phrase) <= set(w[max(0, at - within) : at + within + 1]):
                            want[i, phrase, at + 1] += 1
        near = contamination.near_matches(index, asked, within).join(index.documents, "row").join(asked.windows, "wid")
        assert Counter((r["doc_id"], tuple(r["words"]), r["pos"]) for r in near.collect()) == want


def test_contamination_uses_no_python(spark, leaked):
    items = benchmark(spark, HELD)
    for frame in (contamination.digest(leaked, items), contamination.matches(*_indexed(leaked, items))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def _indexed(docs, items):
    asked = contamination.phrases(items)
    return contamination.build_index(docs, asked.vocabulary), asked
