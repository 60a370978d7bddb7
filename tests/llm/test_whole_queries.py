"""Registered queries that SQL cannot express, on whole tables: brute force, exact round trips, held-out accuracy."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridtally.llm import quality, toxicity
from gridtally.llm.queries import QUERIES
from tests.llm.test_edge_cases import PATH, brute_counts, brute_fingerprint, groups_of

SF = "/root/testdata/sf0.001"
LABELLED = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def brute_pieces(tokenizer, rows):
    """Every (doc_id, piece, start, length, ids_crc32) of (doc_id, text) rows."""
    out = Counter()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), 4096):
            out[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    return out


def assert_packed(rows, slack=0.01):
    """Sequences hold their pieces without gaps, and there are hardly more than the tokens need."""
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in places.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(r["length"] for r in rows) // 4096)
    assert len(places) <= least + max(1, slack * least)


def area(score, y):
    """Area under the ROC curve."""
    order = np.argsort(np.argsort(score, kind="stable")) + 1.0
    for s in np.unique(score):
        order[score == s] = order[score == s].mean()
    n1 = int(y.sum())
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_sharding_loads_equal_those_of_a_plain_heap(spark, texts):
    rows = QUERIES["op4_sharding"](spark, SF).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    groups, shard_of = Counter(), defaultdict(set)
    for r in rows:
        groups[texts[r["doc_id"]] or ""] += r["size"]
        shard_of[texts[r["doc_id"]] or ""].add(r["shard"])
    assert all(len(s) == 1 for s in shard_of.values())
    heap = [0] * 8
    for size in sorted(groups.values(), reverse=True):
        heapq.heappush(heap, heapq.heappop(heap) + size)
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert sorted(loads.values()) == sorted(heap)


def test_simhash_against_all_pairs(spark, texts):
    ids = sorted(texts)
    prints = [brute_fingerprint(texts[i]) for i in ids]
    group = groups_of(prints, 4)
    want = {(i, f"{p:016x}", ids[g]) for i, p, g in zip(ids, prints, group, strict=True)}
    assert {tuple(r) for r in QUERIES["op6_simhash"](spark, SF).collect()} == want


def test_packing_of_all_documents(spark, texts):
    rows = QUERIES["op8_packing"](spark, SF).collect()
    assert Counter(tuple(r)[:5] for r in rows) == brute_pieces(Tokenizer.from_file(PATH), texts.items())
    assert_packed(rows)


def test_quality_counts_of_all_documents(spark, texts):
    rows = QUERIES["op10_quality"](spark, SF).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert {(r["doc_id"], *(r[c] for c in names)) for r in rows} == {(i, *brute_counts(t)) for i, t in texts.items()}
    assert all(not (r["base_failed"] and r["kept"]) for r in rows)


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{LABELLED}/labels.parquet").where("toxic in (0, 1)").select("doc_id", "toxic")
    rows = QUERIES["op1_toxicity"](spark, LABELLED).join(labels, "doc_id").where("held_out").collect()
    y = np.array([r["toxic"] for r in rows])
    said = np.array([r["predicted"] for r in rows])
    assert len(y) > 500
    assert area(np.array([r["score"] for r in rows]), y) >= 0.95
    assert said[y == 1].mean() >= 0.85 and said[y == 0].mean() <= 0.03


def test_quality_on_rows_it_was_not_fitted_on(spark):
    docs, labels = (spark.read.parquet(f"{LABELLED}/{t}.parquet") for t in ("documents", "labels"))
    aside = toxicity.held_out()
    model = quality.train(docs, labels.where(~aside))
    rows = quality.score(docs, model).join(labels.where(aside & F.col("quality").isin(0, 1)).select("doc_id", "quality"), "doc_id").where("not base_failed").collect()
    y = np.array([r["quality"] for r in rows])
    kept = np.array([r["kept"] for r in rows])
    assert len(y) > 500
    assert kept[y == 1].mean() >= 0.98 and kept[y == 0].mean() <= 0.1
    # Calibrated: on average the probabilities say how many rows are good.
    assert abs(np.mean([r["score"] for r in rows]) - y.mean()) < 0.05
