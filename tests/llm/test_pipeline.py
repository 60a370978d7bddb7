"""The corpus pipeline against plain Python, stage after stage and as a whole, on the smallest tables."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridtally.llm.queries import QUERIES
from tests.llm.conftest import DOCS, documents
from tests.llm.test_edge_cases import PATH, WORD, brute_fingerprint, groups_of, low
from tests.llm.test_whole_queries import assert_packed, brute_pieces

SF = "/root/testdata/sf0.001"
STRIP = " \t\n\x0b\x0c\r"


def without_lines(rows, min_chars=40, min_docs=5):
    """(doc_id, text, source) rows without the lines that a larger doc_id keeps."""
    key = lambda line: low(line.strip(STRIP))
    holders = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    goes = lambda line, i: len(h := holders.get(key(line), ())) >= min_docs and max(h) != i
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if not goes(x, i)), s) for i, t, s in rows]


def without_near_copies(rows):
    rows = sorted(rows, key=lambda r: r[0])
    group = groups_of([brute_fingerprint(t) for _, t, _ in rows], 4)
    return [r for k, r in enumerate(rows) if group[k] == k]


def mixed(rows, weights=(5, 2, 1), most=3):
    """Each row as often as its source's budget takes it: whole rounds, then those of the smallest hashes."""
    size = lambda t: len(WORD.findall(t or ""))
    held = Counter()
    for _, t, s in rows:
        held[s] += size(t)
    names = sorted((s for s in held if s is not None), key=str.encode) + [None] * (None in held)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    full: set = set()
    while True:
        left = [s for s in names if s not in full]
        level = (sum(held.values()) - sum(most * held[s] for s in full)) / max(sum(weight[s] for s in left), 1)
        if not (over := {s for s in left if most * held[s] < level * weight[s]}):
            break
        full |= over
    out = []
    for s in names:
        if not held[s]:
            continue
        target = most * held[s] if s in full else level * weight[s]
        base = min(int(target // held[s]), most)
        rest = 0 if base == most else target - base * held[s]
        order = []
        for i, t, source in rows:
            if source == s:
                inner = hashlib.md5((t or "").encode()).hexdigest()
                order.append((int(hashlib.md5(f"{i}#{inner}".encode()).hexdigest()[:15], 16), i, t))
        done = 0
        for _, i, t in sorted(order):
            n = size(t)
            more = done + n <= rest or (done <= rest and rest - done > n / 2)
            out += [(i, t, s)] * (base + more)
            done = done + n if more else float("inf")
    return out


def triples(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "simhash", "mixing", "packing"]


def test_pipeline_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in QUERIES["op10_quality"](spark, SF).where("kept").collect()}
    rows = [r for r in triples(docs) if r[0] in kept]
    assert 0 < len(rows) < docs.count()
    expected = [("quality", rows)]
    for name, step in (("lines", without_lines), ("simhash", without_near_copies), ("mixing", mixed)):
        rows = step(rows)
        expected.append((name, rows))
    stage = docs
    for (name, function), (_, want) in zip(corpus_pipeline.STAGES, expected, strict=False):
        stage = function(spark, stage, SF)
        assert stage.columns == docs.columns, name
        assert Counter(triples(stage)) == Counter(want), name
        assert all(r["n_chars"] == len(r["text"] or "") for r in stage.collect()), name
    whole = corpus_pipeline.run(spark, SF).collect()
    assert Counter(tuple(r)[:5] for r in whole) == brute_pieces(Tokenizer.from_file(PATH), [(i, t) for i, t, _ in rows])
    assert_packed(whole)


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, "", "a"), (None, " \n", "a"), (4, "a few words, far too few to stay", "b")]])
def test_pipeline_of_nothing_and_of_rejected_rows(spark, folder, rows):
    spark.createDataFrame(documents(rows), DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_pipeline_carries_odd_rows(spark, folder):
    """Nulls, repeated rows and extra columns of clashing names go through every stage."""
    text = " ".join(f"word{k} of a text that is long enough" for k in range(30))
    rows = [(1, text, None), (1, text, None), (None, "another one. " + text[::-1], "a"), (3, text + " tail", "é"), (4, None, "a")]
    rows += [(10 + k, " ".join(hashlib.md5(f"{k}-{n}".encode()).hexdigest()[:7] for n in range(60 + k)), "b") for k in range(20)]
    spark.createDataFrame(documents(rows), DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in out} <= {i for i, _, _ in rows} and len(out) > 10
    assert_packed(out)


def test_stages_keep_columns_of_any_name_and_kind(spark, folder):
    """Dots and back-ticks in names, maps, arrays and columns of nothing pass every stage."""
    text = lambda k: " ".join(hashlib.md5(f"{k}-{n}".encode()).hexdigest()[:7] for n in range(60 + k))
    base = spark.createDataFrame(documents([(k % 9, text(k % 9), "a") for k in range(12)]), DOCS)
    docs = base.selectExpr("*", "doc_id as `a.b`", "'x' as `tick``ed`", "map('k', doc_id) as m", "array(map(1, text)) as ms", "null as nothing", "struct(text as `c.d`) as s")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        rows = function(spark, rows, folder)
        assert rows.schema.names == docs.schema.names, name
        for r in rows.collect():
            assert r["a.b"] == r["doc_id"] and r["tick`ed"] == "x" and r["m"] == {"k": r["doc_id"]} and r["nothing"] is None, name
    assert corpus_pipeline.STAGES[-1][1](spark, rows, folder).count() == rows.count() > 0
