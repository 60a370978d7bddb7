"""Nulls, empty and very long texts, repeated rows, clashing names and empty tables, against plain Python."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from gridtally.llm import lines, mixing, packing, quality, sharding, simhash, spans, toxicity
from tests.llm.conftest import DOCS, MESSY, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowest(i):
    return -(1 << 63) if i is None else i


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- toxicity ---


def test_toxicity_scores_every_row(messy, labels):
    model = toxicity.train(messy, labels)
    rows = toxicity.score(messy, model).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _, _ in MESSY)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_toxicity_without_rows_or_labels(nothing, messy, labels):
    assert toxicity.score(nothing, toxicity.train(nothing, labels)).count() == 0
    assert toxicity.score(messy, toxicity.train(messy, labels.limit(0))).count() == len(MESSY)


def test_toxicity_never_learns_from_held_out_rows(spark, messy, labels):
    turned = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    a, b = toxicity.train(messy, labels), toxicity.train(messy, turned)
    assert a.whole == b.whole and a.start == b.start and (a.curve == b.curve).all()


def clause_score(text):
    from gridtally.llm.textbuf import Words

    data = np.frombuffer(text.encode(), dtype=np.uint8)
    words = Words(data, np.array([0, len(data)]))
    return toxicity.clause_scores(words, toxicity.fixed_lexicon(), toxicity.grammar())[1].sum()


def test_grammar_weighs_clauses():
    plain = clause_score("what an idiot")
    assert clause_score("a fine day") == 0
    assert clause_score("you are an idiot") > plain
    assert clause_score("not an idiot") < plain
    assert clause_score("he said such an idiot") < clause_score("he is such an idiot")
    assert clause_score("i will kill you") > clause_score("kill time")
    assert clause_score("not now. idiot") == clause_score("now. idiot")  # a clause ends the negation


def plain_clause_scores(text, model):
    """Scores of a text's clauses in order: clauses cut word by word, and the four transducers run one beside the other."""
    words = [(w, b) for row in text.split("\n") for k, (w, b) in enumerate([(w, False) for w in WORD.findall(row)] + [("", True)]) if w or b]
    reach = sorted({len(x) for x in model.start}, reverse=True)
    clauses, clause = [], []
    for k, (w, feed) in enumerate(words):
        if feed:
            clauses, clause = [*clauses, clause], []
            continue
        raw = w.encode()
        symbol, weight = toxicity._symbol(toxicity.bare(raw), model, reach)
        clause.append((symbol, weight))
        last = raw.rstrip(b"\"')]*")[-1:]
        closes = len(raw) > 1 and raw.rstrip(b".,;:!?)]*").endswith(toxicity.CLOSING)
        following = words[k + 1][0].encode() if k + 1 < len(words) and not words[k + 1][1] else b""
        stays = last in (b",", b":") and not closes and (symbol == toxicity.REPORTED or following.startswith(toxicity.OPENING))
        if closes or (last in toxicity.ENDING and not stays):
            clauses, clause = [*clauses, clause], []
    clauses.append(clause)
    out = []
    for clause in clauses:
        if any(x in (toxicity.INSULT, toxicity.THREAT) for x, _ in clause):
            tables = [(toxicity.negation(), 0), (toxicity.reported(), 0), (toxicity.targeted(), 0), (toxicity.closing(), (False, ""))]
            states, total = [start for _, start in tables], 0.0
            for symbol, weight in clause:
                for k, (table, _) in enumerate(tables):
                    states[k], factor = table[states[k], symbol]
                    weight *= factor
                total += weight
            out.append(total)
    return out


def test_composed_table_equals_the_transducers_run_apart():
    from gridtally.llm.textbuf import Words

    rng, model, table = np.random.default_rng(6), toxicity.fixed_lexicon(), toxicity.grammar()
    parts = ["you", "idiot", "kill", "not", "said", "time", "the", "idiots,", "said:", '"you', 'scum"', "hurt.", "wrote,", '"idiot"', "them", "never", "moron!", "\n", "«kill", "du»", "said,"]
    texts = [" ".join(rng.choice(parts, size=int(n))) for n in rng.integers(0, 40, 400)]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    text, scores = toxicity.clause_scores(Words(data, np.cumsum([0, *map(len, raw)])), model, table)
    for k, t in enumerate(texts):
        assert np.allclose(scores[text == k], plain_clause_scores(t, model)), t


def test_reported_speech_crosses_what_opens_a_quotation():
    plain = clause_score("you are an idiot")
    for text in ("he said you are an idiot", "he said: you are an idiot.", 'she wrote, "you are an idiot"', "er sagte: „you are an idiot”"):
        assert np.isclose(clause_score(text), plain / 2), text
    # After the quotation the writer speaks again; a comma alone still ends a clause.
    assert np.isclose(clause_score('she wrote "hello there" you are an idiot'), plain)
    assert np.isclose(clause_score("he said so, you are an idiot"), plain)


def test_a_target_after_a_threat_counts():
    assert np.isclose(clause_score("kill you"), clause_score("you will kill"))
    assert np.isclose(clause_score("kill all of them"), clause_score("kill you"))
    assert clause_score("kill some time with a book about them") == clause_score("kill time") < clause_score("kill you")
    assert np.isclose(clause_score("do not kill you"), 0.3 * clause_score("kill you"))


def test_sample_is_bounded_in_texts_and_bytes(spark):
    rows = [(i % 10, f"text {i} " + "x" * 1000) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    whole = quality.distinct_sample(docs, marks, "quality", 1000, 1 << 30)
    assert whole.count() == 400
    few = quality.distinct_sample(docs, marks, "quality", 50, 1 << 30)
    assert {r["y"]: r["count"] for r in few.groupBy("y").count().collect()} == {0: 50, 1: 50}
    small = quality.distinct_sample(docs, marks, "quality", 50, 20_500).collect()
    assert Counter(r["y"] for r in small) == {0: 20, 1: 20} and all(sum(len(r["text"]) for r in small if r["y"] == y) <= 20_500 for y in (0, 1))
    assert sorted(small) == sorted(quality.distinct_sample(docs.repartition(7), marks, "quality", 50, 20_500).collect())


# --- repeated spans ---


def brute_spans(rows, length=50):
    least = {}
    for i, t, _ in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            least[s] = min(least.get(s, lowest(i)), lowest(i))
    out = []
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < lowest(i):
                gone[k : k + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return Counter(out)


def test_spans(messy, nothing):
    got = spans.deduplicated(messy).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute_spans(MESSY)
    assert all(r["n_spans"] == len(r["spans"]) and r["n_removed"] == sum(b - a for a, b in r["spans"]) for r in got)
    assert spans.deduplicated(nothing).count() == 0


def test_spans_of_common_passages(spark):
    # Enough documents in one slice that the passage's anchors count as very common.
    passage = "a passage that very many documents share, surrounded by text that none of them shares; "
    rows = [(i, f"{xxhash.xxh64_hexdigest(str(i)) * 5} {passage * 2}{xxhash.xxh64_hexdigest(str(-i)) * 5}", "s") for i in range(120)]
    rows += [(500 + i, passage * 3, "s") for i in range(3)]
    df = spark.createDataFrame(documents(rows), DOCS)
    assert Counter(tuple(r)[:5] for r in spans.deduplicated(df.coalesce(1)).collect()) == brute_spans(rows)
    assert Counter(tuple(r)[:5] for r in spans.deduplicated(df.repartition(7)).collect()) == brute_spans(rows)


@pytest.mark.parametrize("common", [spans.COMMON, 4])
def test_spans_where_one_id_has_very_many_rows(spark, monkeypatch, common):
    # Ids of many rows are dealt to parts: null ids, and one id whose rows repeat each other and others.
    monkeypatch.setattr(spans, "REPEATS", 5)
    monkeypatch.setattr(spans, "COMMON", common)
    unlike = lambda i: "".join(xxhash.xxh64_hexdigest(f"{i} {k}") for k in range(6))
    passage = [f"a passage number {k} that several of the documents share, {unlike(-k)}; " for k in range(3)]
    rows = [(None, f"{unlike(i)} {passage[0] if i % 2 else ''}{unlike(i % 7)}", "s") for i in range(40)]
    rows += [(9, f"{passage[i % 3]}{unlike(1000 + i % 4)}", "s") for i in range(40)] + [(9, rows[3][1], "s")] * 8
    rows += [(i, f"{unlike(2000 + i)}{passage[i % 3]}{unlike(i)}", "s") for i in range(3, 15)] + [(70, rows[45][1], "s"), (71, None, "s")]
    df = spark.createDataFrame(documents(rows), DOCS)
    for turn in (df.coalesce(1), df.repartition(5)):
        assert Counter(tuple(r)[:5] for r in spans.deduplicated(turn).collect()) == brute_spans(rows)


def test_span_tasks_work_on_short_slices():
    """Memory of the task that cuts snippets, on eight megabytes in one batch."""
    import tracemalloc

    texts = [np.random.default_rng(i).integers(97, 123, 1 << 19).astype(np.uint8).tobytes().decode() for i in range(16)]
    n = len(texts)
    base = {"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts)}
    lists = pa.array([[{"anchor": 1, "common": False}]] * n, pa.list_(pa.struct([("anchor", pa.int64()), ("common", pa.bool_())])))
    tasks = {
        "snippets": (spans.snippets(50), pa.RecordBatch.from_pydict(base | {"row": base["doc_id"], "anchors": lists}), 190),
    }
    for name, (task, batch, most) in tasks.items():
        tracemalloc.start()
        for _ in task(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < most, (name, peak)


def test_parts_hold_few_texts(spark):
    rows = spans.keyed(spark.createDataFrame([(None if i % 3 else i, f"text {i % 2000}") for i in range(6000)], "doc_id long, text string"))
    made, _, any_parts = spans.parted(rows, rows.select("doc_id", "row").limit(0))
    sizes = {(r["doc_id"], r["part"]): r["count"] for r in made.groupBy("doc_id", "part").count().collect()}
    assert any_parts and {n for (i, part), n in sizes.items() if part == 0} == {1} and len(sizes) == 2000 + 62
    assert max(n for (_, part), n in sizes.items() if part) < 2 * spans.REPEATS and sum(n for (_, part), n in sizes.items() if part) == 2000


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(5)
    for letters, n in ((1, 150), (2, 400), (5, 1500), (200, 3000)):
        data = rng.integers(40, 40 + letters, size=n).astype(np.uint8)
        raw, order = data.tobytes(), spans.suffix_array(data, 50)
        assert sorted(order.tolist()) == list(range(n))
        cut = [raw[i : i + 50] for i in order]
        assert cut == sorted(cut)
        prefixes = spans.common_prefixes(data, order, 50)
        for (a, b), got in zip(pairwise(cut), prefixes[1:], strict=True):
            if len(a) == len(b) == 50:
                assert got == next((k for k in range(50) if a[k] != b[k]), 50)


# --- sharding ---


def test_sharding(messy, nothing):
    rows = sharding.sharded(messy, shards=8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in MESSY)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert len({r["shard"] for r in rows if r["text_crc32"] == 0}) == 1
    assert sharding.sharded(nothing).count() == 0


def test_schedule_equals_a_plain_heap():
    rng = np.random.default_rng(8)
    for shards in (1, 3, 8):
        for turn in range(60):
            classes = {int(s): int(n) for s, n in zip(rng.integers(1, 60, 6), rng.integers(1, (5, 60, 3000)[turn % 3], 6), strict=True)}
            heap, want = [(0, k) for k in range(shards)], []
            for size in sorted(classes, reverse=True):
                got = [0] * shards
                for _ in range(classes[size]):
                    load, k = heapq.heappop(heap)
                    heapq.heappush(heap, (load + size, k))
                    got[k] += 1
                want.append((size, got))
            assert sharding.schedule(classes.items(), shards) == want


def test_sharding_with_and_without_hot_groups(spark):
    """A third of all rows are one text; loads are those of a heap over all groups, and groups stay whole."""
    df = spark.range(9_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', repeat('x', cast(1 + id % 97 as int)) || id % 4000) as text").repartition(6)
    groups = Counter()
    for r in df.collect():
        groups[r["text"]] += len(r["text"]) + 1
    heap = [0] * 8
    for size in sorted(groups.values(), reverse=True):
        heapq.heappush(heap, heapq.heappop(heap) + size)
    for hot_share in (10_000, 2):
        places = sharding.assigned(df, 8, hot_share).collect()
        loads, where = Counter(), defaultdict(set)
        for r in places:
            loads[r["shard"]] += r["size"]
            where[r["size"], r["text_crc32"]].add(r["shard"])
        assert len(places) == 9_000 and sorted(loads.values()) == sorted(heap) and all(len(s) == 1 for s in where.values())


# --- SimHash ---


def brute_fingerprint(text, k=4):
    words = WORD.findall(low(text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(len(words) - k + 1, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(values, distance):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_simhash(messy, nothing):
    prints = {t: brute_fingerprint(t) for _, t, _ in MESSY}
    group = groups_of([prints[t] for _, t, _ in MESSY], 4)
    least = {}
    for (i, _, _), g in zip(MESSY, group, strict=True):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    want = Counter((i, f"{prints[t]:016x}", least[g]) for (i, t, _), g in zip(MESSY, group, strict=True))
    assert Counter(tuple(r) for r in simhash.digest(messy).collect()) == want
    assert simhash.digest(nothing).count() == 0
    kept = simhash.one_of_each(messy)
    assert kept.columns == messy.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert simhash.one_of_each(nothing).count() == 0


def test_one_of_each_keeps_unrelated_texts(spark):
    """Components without an id, or with the same smallest one, keep a row each."""
    text = lambda k: " ".join(hashlib.md5(f"{k}-{n}".encode()).hexdigest()[:7] for n in range(60))
    rows = [(None, text(0), "a"), (None, text(1), "a"), (None, text(1), "a"), (7, text(2), "a"), (7, text(3), "b"), (8, text(3), "a"), (None, text(3), "a"), (9, text(4), "a")]
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    assert len(set(groups_of(prints, 4))) == 5
    kept = simhash.one_of_each(spark.createDataFrame(documents(rows), DOCS).repartition(3)).collect()
    want = Counter([(None, text(0)), (None, text(1)), (7, text(2)), (7, text(3)), (9, text(4))])
    assert Counter((r["doc_id"], r["text"]) for r in kept) == want


def test_links_join_what_all_pairs_join(spark):
    rng = np.random.default_rng(2)
    centers = rng.integers(0, 2**63, size=40, dtype=np.uint64)
    made = [int(c) ^ int(sum(1 << int(b) for b in rng.choice(64, size=rng.integers(0, 8), replace=False))) for c in centers for _ in range(12)]
    values = sorted(set(made))
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for part_rows in (20_000, 3):
        edges = simhash.links(df, 4, part_rows)
        from gridtally.llm.common import smallest_reachable

        top = {r["node"]: r["component"] for r in smallest_reachable(edges).collect()}
        got = defaultdict(set)
        for v in values:
            signed = v - (1 << 64) if v >> 63 else v
            got[top.get(signed, signed)].add(v)
        want = defaultdict(set)
        for v, g in zip(values, groups_of(values, 4), strict=True):
            want[g].add(v)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 2**64, size=2000, dtype=np.uint64) for _ in range(2))
    near = simhash.manhattan(simhash.segment_counts(a), simhash.segment_counts(b))
    fields = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * k)) & np.uint64(3)) for k in range(32)]).astype(int)
    assert (near == np.abs(fields(a) - fields(b)).sum(axis=0)).all()
    assert (near <= np.bitwise_count(a ^ b)).all()


# --- mixing ---


def test_mixing(messy, nothing):
    rows = mixing.mix(messy).collect()
    size = defaultdict(int)
    for _, t, s in MESSY:
        size[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in full)) / max(sum(weight[s] for s in order if s not in full), 1)
        more = {s for s in order if s not in full and 3 * size[s] < level * weight[s]}
        if not more:
            break
        full |= more
    target = {s: 3.0 * size[s] if s in full else level * weight[s] for s in order}
    seen = Counter((r["doc_id"], r["size"]) for r in rows)
    assert seen == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in MESSY)
    assert {round(r["target"], 6) for r in rows} == {round(target[s], 6) for s in size}
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(nothing).count() == 0
    taken = Counter()
    for r in mixing.mixed(messy).collect():
        taken[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in sum((Counter({r["doc_id"]: r["taken"]}) for r in rows), Counter()).items()}
    assert mixing.mixed(messy).columns == messy.columns and mixing.mixed(nothing).count() == 0


# --- packing ---


def test_packing(messy, nothing):
    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.packed(messy, PATH).collect()
    want = Counter()
    for i, t, _ in MESSY:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans_ in places.values():
        at = 0
        for offset, length in sorted(spans_):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) == -(-sum(r["length"] for r in rows) // 4096)
    assert packing.packed(nothing, PATH).count() == 0


def test_sequences_hold_the_tokens(messy):
    tokenizer = Tokenizer.from_file(PATH)
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in MESSY)
    sizes = [len(r["ids"]) for r in packing.sequences(messy, PATH).collect()]
    assert sum(sizes) == total and max(sizes) <= 4096


def test_local_search_empties_bins():
    # Best fit opens three bins here; an exchange of one for two makes two do.
    sizes = [6, 5, 4, 4, 1, 3, 3, 4]
    start = [[0, 4], [1, 2], [3, 5], [6, 7]]
    bins = packing.improve([list(b) for b in start], sizes, 10)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 10 for b in bins) and len(bins) == 3


def test_local_search_looks_at_every_pair():
    """The only exchange that empties the last bin takes two pieces beyond the fortieth."""
    # The first bin has 9 tokens of room: 36 fits against 13 and 14 alone, and those fit the second bin.
    sizes = [10] * 41 + [13, 14] + [200, 219] + [36]
    bins = packing.improve([list(range(43)), [43, 44], [45]], sizes, 446)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert [sum(sizes[i] for i in b) for b in bins] == [446, 446]


def test_local_search_is_not_cut_off():
    """Blocks of many short pieces and of pairs end with no exchange left, whatever their number of moves."""
    rng = np.random.default_rng(6)
    for sizes in (rng.integers(1, 60, 3000), rng.integers(900, 1800, 600), rng.integers(1, 4096, 1500)):
        sizes = sizes.tolist()
        # One piece a bin: thousands of moves.
        bins = packing.improve([[i] for i in range(len(sizes))], sizes, 4096)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        fill = [sum(sizes[i] for i in b) for b in bins]
        assert max(fill) <= 4096
        if len(bins) > -(-sum(sizes) // 4096):
            kinds: list = [None] * len(bins)
            takes = packing._takes(bins, sizes, kinds, fill, 4096)
            assert all(packing._best_move(bins, sizes, kinds, takes, fill, low) is None for low in range(len(bins)) if fill[low] < 4096)


# --- lines ---


def test_lines(messy, nothing):
    strip = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for i, t, _ in MESSY:
        for line in (t or "").split("\n"):
            if len(key := low(line.strip(strip))) >= 40:
                holders[key].add(lowest(i))
    for least in (5, 2):
        want, texts = Counter(), Counter()
        for i, t, _ in MESSY:
            all_lines = (t or "").split("\n")
            kept = [x for x in all_lines if not (len(holders.get(k := low(x.strip(strip)), ())) >= least and max(holders[k]) != lowest(i))]
            want[i, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
            texts[i, None if t is None else "\n".join(kept)] += 1
        assert Counter(tuple(r) for r in lines.digest(messy, 40, least).collect()) == want
        assert Counter((r["doc_id"], r["text"]) for r in lines.deduplicated(messy, 40, least).collect()) == texts
    assert lines.deduplicated(messy).columns == messy.columns
    assert lines.digest(nothing).count() == 0 and lines.deduplicated(nothing).count() == 0


def test_a_line_that_spans_partitions(spark):
    line = "the very same line that thousands of the documents here have in common"
    rows = [(i, f"own line of document number {i} which nobody else has\n{line}", "s") for i in range(3000)]
    df = spark.createDataFrame(documents(rows), DOCS).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = lines.digest(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r["doc_id"] for r in got if r["n_dropped"] == 0} == {2999} and all(r["n_dropped"] <= 1 for r in got)


# --- quality ---


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    full = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(covered)


def test_quality_trains_on_a_bounded_sample(spark, monkeypatch):
    """A labelled doc_id that repeats, or has many texts, brings no more rows to the driver than the sample may have."""
    seen = []
    monkeypatch.setattr(quality, "_fit", lambda index, value, size, y, *rest: seen.append(Counter(y.tolist())))
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    few = [(1, "one poor text", "a")] * 300 + [(2, "a good text of some words", "a"), (3, "poor", "a"), (4, "good", "a")]
    quality.train(spark.createDataFrame(documents(few), DOCS), labels, replace(quality.Settings(), per_class=5))
    many = few + [(1, f"poor text number {k}", "a") for k in range(80)]
    quality.train(spark.createDataFrame(documents(many), DOCS), labels, replace(quality.Settings(), per_class=5))
    assert seen == [Counter({0: 2, 1: 2}), Counter({0: 5, 1: 2})]


def test_quality_counts(messy, nothing, labels):
    model = quality.train(messy, labels)
    rows = quality.score(messy, model).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == Counter((i, *brute_counts(t)) for i, t, _ in MESSY)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.score(nothing, quality.train(nothing, labels)).count() == 0
    assert quality.train(messy, labels.limit(0)) is None
    kept = quality.filtered(messy, None)
    assert kept.columns == messy.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.score(messy, None).where("kept").collect()}


# --- memory of packing workers ---


def _words(seed, n=20_000):
    rng = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, 9)).encode() for _ in range(n)]


def test_packing_memory_is_one_per_worker_and_bounded(monkeypatch):
    """A task unpickled time and again finds the same memory, and words never met before do not make it grow."""
    import sys

    from pyspark import cloudpickle

    vocabulary = open(PATH, encoding="utf-8").read()
    sys.modules.pop("_packing_memory", None)
    packed_task = cloudpickle.dumps(packing.cutter(vocabulary, 4096, 1, False))
    seen, first = set(), None
    for turn in range(10):
        task = cloudpickle.loads(packed_task)
        batch = pa.RecordBatch.from_arrays([pa.array([turn]), pa.array([b" ".join(_words(turn)).decode()])], names=["doc_id", "text"])
        assert sum(b.num_rows for b in task(iter([batch]))) > 0
        memory = sys.modules["_packing_memory"].memory
        seen.add(id(memory))
        assert memory.bytes <= memory.limit
        first = first or memory
    assert len(seen) == 1 and len(first.ids) >= 20_000
    small = packing.Memory(vocabulary, limit=1 << 20)
    ids_of, tokenizer = packing._encoder(small), Tokenizer.from_file(PATH)
    for turn in range(5):
        words = _words(100 + turn, 5_000) + [b"Caf\xc3\xa9!", b"x" * 5_000, "漢字".encode(), b"it's"]
        assert [np.frombuffer(x, dtype=np.uint32).tolist() for x in ids_of(words)] == [tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words]
        held = [*small.ids, *small.old]
        assert 200 * len(held) <= 1 << 20 and all(len(w) <= packing.LONGEST for w in held)


def test_packing_with_a_vocabulary_of_other_rules(messy):
    """Rules that look across words are given whole texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not packing.Memory(open(path, encoding="utf-8").read()).wordwise and packing.Memory(open(PATH, encoding="utf-8").read()).wordwise
    tokenizer = Tokenizer.from_file(path)
    got = Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packing.pieces(messy, path).collect())
    want = Counter()
    for i, t, _ in MESSY:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    assert got == want


# --- components ---


def test_components_of_hubs_chains_and_rings(spark, monkeypatch):
    """With few edges for a hub, both ways of joining, and a chain longer than any number of rounds."""
    from gridtally.llm import common

    monkeypatch.setattr(common, "HUB", 5)
    rng = np.random.default_rng(2)
    edges = [(500, 1000 + i) for i in range(300)] + [(3, 500)] + [(2000 + i, 2001 + i) for i in range(150)] + [(4000 + i, 4000 + (i + 1) % 9) for i in range(9)]
    edges += [(int(a), int(b)) for a, b in rng.integers(5000, 5200, (120, 2))] + [(7, 7)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low_, high = sorted((find(a), find(b)))
            root[high] = low_
    want = {(x, find(x)) for x in root}
    df = spark.createDataFrame(edges, "a long, b long")
    for hub_rows in (100_000, 0):
        got = common.smallest_reachable(df, hub_rows)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert common.smallest_reachable(df.limit(0)).count() == 0
