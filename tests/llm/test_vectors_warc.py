"""Near vectors and WARC archives: odd rows, brute force, round trips."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from gridtally.llm import vectors, warc

VECTORS = "vec_id long, embedding array<float>, label int, node string, bucket string"


def near(rows, cosine=0.93):
    """vec_id -> (links, component) by comparing all pairs."""
    ok = []
    for i, v, label in rows:
        good = label is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))
        ok.append((i, np.array(v, float) / np.linalg.norm(np.array(v, float)) if good else None, label))
    links, root = Counter(), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ok[a][1] is not None and ok[b][1] is not None and ok[a][2] == ok[b][2] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= cosine:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for a, (i, _, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i)
    return Counter((rows[a][0], links[a], least[find(a)]) for a in range(len(rows)))


def made(seed, groups=25, width=16):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        center = rng.normal(size=width)
        for _ in range(rng.integers(1, 9)):
            noise = rng.normal(size=width) * rng.choice([0.0, 0.1, 0.25])
            rows.append((len(rows), np.float32(center + noise).tolist(), g % 3))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS)


@pytest.mark.parametrize("part_rows", [10_000, 2])
def test_links_against_all_pairs(spark, part_rows):
    rows = made(4) + [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 1), (1003, [None] + [1.0] * 15, 1), (1004, [], 1), (1005, [1.0, 2.0], 1), (1006, [2.0, 4.0], 1)]
    rows += [(2000 + k, [1.0] + [0.5] * 15, None) for k in range(3)] + [(3000 + k, [1.0] * 16, 2) for k in range(30)]
    got = vectors.near_vectors(frame(spark, rows).repartition(4), replace(vectors.Settings(), part_rows=part_rows)).collect()
    want = near(rows)
    assert sum(n for _, n, _ in want.elements()) > 500
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert vectors.near_vectors(frame(spark, [])).count() == 0


def test_recall_of_the_tables():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    s = vectors.Settings()
    for rotations in (1, 2, 3):
        x, y = (vectors.buckets(v, s, rotations) for v in (a, 0.93 * a + np.sqrt(1 - 0.93**2) * b))
        met = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean()
        assert met > 0.9, (rotations, met)


@pytest.mark.parametrize("rotations", [3, 4, 5, 6])
def test_near_pairs_are_found_with_many_rotations(spark, monkeypatch, rotations):
    """The rotations of large labels, on 1,000 pairs near the threshold."""
    monkeypatch.setattr(vectors, "rotations_for", lambda nodes, width, probes: rotations)
    rng = np.random.default_rng(21)
    a = rng.normal(size=(1000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near_a = 0.9302 * a + np.sqrt(1 - 0.9302**2) * b
    rows = [(2 * k + side, v.tolist(), 0) for k in range(1000) for side, v in enumerate((a[k], near_a[k]))]
    got = vectors.near_vectors(frame(spark, rows)).collect()
    assert sum(r["n_links"] for r in got) > 0.95 * 2000
    assert sum(not r["kept"] for r in got) > 0.95 * 1000


@pytest.mark.parametrize(("nodes", "width"), [(1, 1), (10**6, 2), (10**9, 8), (10**5, 100), (10**6, 64), (10**8, 64), (10**5, 256), (10**7, 256)])
def test_plan_reaches_the_recall(nodes, width):
    s, rotations = vectors.plan(nodes, width, vectors.Settings())
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 1500, max(width, 2)))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (vectors.buckets(vectors.unit_rows([r.tobytes() for r in v]), s, rotations) for v in (a, 0.93 * a + np.sqrt(1 - 0.93**2) * b))
    assert ((x[:, :, :, None] == y[:, :, None, :]) & (x >= 0)[:, :, :, None]).any(axis=(1, 2, 3)).mean() > 0.95
    assert 1 <= rotations <= vectors.rotations_for(nodes, width, s.probes)


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(vectors.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(vectors.hadamard(vectors.hadamard(x)), x)


PAGES = [
    (1, "http://a/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (3, None, None), (4, "http://d/\r\nX: y", ""), (5, "http://e/", "x" * 3_000_000), (6, "http://é/", "ü\r\n\r\nWARC/1.1\r\n\r\n漢字"),
    (None, "http://g/", "<p>same</p>"), (8, "http://h/", "own"), (8, "http://h/", "own"), (8, "http://h/", "other"),
]


def pages(spark):
    return spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, digest string, record_type string").repartition(3)


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    top = {}
    for i, _, h in PAGES:
        if len((h or "").encode()) >= least:
            top[h or ""] = max([x for x in (top.get(h or ""), i) if x is not None], default=None)
    want = Counter()
    for i, _, h in PAGES:
        raw = (h or "").encode()
        revisit = (h or "") in top and top[h or ""] != i
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top[h or ""] if revisit else None] += 1
    assert Counter(tuple(r) for r in warc.round_trip(pages(spark), least).collect()) == want
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_archives_are_members_with_an_index(spark, folder):
    whole = warc.write_whole(pages(spark), f"{folder}/whole", archive_bytes=1000)
    done = warc.normalise(whole, f"{folder}/whole", f"{folder}/records")
    before = b"".join(sorted(gzip.open(f"{folder}/whole/{r['archive']}").read() for r in whole.collect()))
    after = b"".join(sorted(gzip.open(f"{folder}/records/{r['archive']}").read() for r in done.collect()))
    assert sorted(before) == sorted(after) and sum(r["records"] for r in done.collect()) == len(PAGES)
    for r in done.collect():
        raw = open(f"{folder}/records/{r['archive']}", "rb").read()
        for line in open(f"{folder}/records/{r['index']}"):
            e = json.loads(line)
            assert gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]]).startswith(b"WARC/1.1\r\n")
    assert warc.read_back(done, f"{folder}/records").count() == len(PAGES)


def test_a_stream_cut_short_is_refused(spark, folder):
    raw = gzip.compress(warc.record({"page_id": 1, "url": "u", "html": "h" * 100, "digest": "D", "record_type": "response", "refers_to": None}, "2000-01-01T00:00:00Z")[:-20])
    (path := folder + "/x.warc.gz") and open(path, "wb").write(raw)
    with open(path, "rb") as stream, pytest.raises(ValueError, match="ends inside"):
        list(warc.records_in(stream))
