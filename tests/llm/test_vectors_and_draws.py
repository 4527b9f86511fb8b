"""Operators 11 to 13 against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from geoloom.llm.curve_search import Curves, chosen, nearest_rows, nearest_vectors
from geoloom.llm.importance import drawn, gain_planes, resampled, shifted, sliced_weights, span_crcs, text_features
from geoloom.llm.vector_codes import cover_tree, squares, tree_codes, vector_codes

VECTORS = "vec_id long, embedding array<double>, label string, code string, error long, rank int, q long"
TEXTS = "doc_id long, text string, score string, weight long, n_features int"


def vector_rows(spark, given):
    """Rows with columns that clash with results."""
    return spark.createDataFrame([(i, v, l, "c", 1, 2, 3) for i, v, l in given], VECTORS)


# 11 -----------------------------------------------------------------------------------


def brute_nearest(given, k=10, every=100):
    """``(query, rank) -> distance`` and the vectors by id, for rows whose ids differ."""
    fine = [(i, np.array(v, float)) for i, v in given if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in fine:
        if i % every == 0:
            near = sorted((float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in fine if j != i)[:k]
            out[i] = near
    return out


def found_nearest(df):
    got = collections.defaultdict(list)
    for r in df.collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)), q
    return {q: [(d, v) for _, d, v in rows] for q, rows in got.items()}


def test_search_of_one_block_is_exact(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = found_nearest(nearest_vectors(table))
    assert set(got) == set(want) and len(got) > 3
    for q, near in want.items():
        assert [v for _, v in got[q]] == [v for _, v in near]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in near], rtol=0, atol=1e-12)


@pytest.mark.parametrize("clusters", [60, 0])
def test_search_recall_over_many_blocks(spark, clusters):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6000, 16))
    if clusters:
        v = v * 0.15 + rng.normal(size=(clusters, 16))[rng.integers(0, clusters, 6000)]
    given = [(i, x.tolist()) for i, x in enumerate(v)]
    want = brute_nearest(given, every=50)
    got = found_nearest(nearest_vectors(vector_rows(spark, [(*g, "a") for g in given]), every=50, block_rows=256, chunk=64, asked=64))
    assert all(len(near) == 10 for near in got.values()) and set(got) == set(want)
    hit = sum(len({j for _, j in want[q]} & {j for _, j in got[q]}) for q in want)
    assert hit >= 0.9 * 10 * len(want)


def test_search_of_copies_and_odd_rows(spark):
    """A third of all rows are one vector: each query among them gets the smallest other ids."""
    nan = float("nan")
    given = [(i, [1.0, 2.0], "a") for i in range(0, 400)] + [(1000 + i, [float(i), -0.0], None) for i in range(1, 300)]
    odd = [(None, [1.0, 2.0], "a"), (500, None, "a"), (600, [0.0, 0.0], "a"), (700, [nan, 1.0], "a"), (800, [1.0, None], "a"), (900, [], "b"), (950, [1.0], "b"), (801, [math.inf, 1.0], "b")]
    table = vector_rows(spark, given + odd)
    got = found_nearest(nearest_vectors(table, block_rows=64, chunk=8))
    want = brute_nearest([(i, v) for i, v, _ in given])
    assert set(got) == set(want)
    for q in (0, 100, 300):
        assert got[q] == [(0.0, v) for v in [x for x in range(12) if x != q][:10]]
    for q in (1100, 1200):
        assert got[q] == want[q]


def test_search_of_repeated_and_few_rows(spark):
    table = vector_rows(spark, [(100, [1.0, 0.0], "a"), (100, [1.0, 0.0], "a"), (7, [0.0, 1.0], "a")])
    rows = sorted(map(tuple, nearest_vectors(table).collect()))
    assert rows == [(100, 1, 100, 0.0)] * 2 + [(100, 2, 7, math.sqrt(2))] * 2
    assert nearest_vectors(table.limit(0)).collect() == []
    assert nearest_vectors(vector_rows(spark, [(100, None, "a")])).collect() == []


def test_curve_parts():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(500, 8))
    curves = Curves(v, 3)
    keys = np.stack([curves.keys(v, s) for s in range(3)])
    assert (keys >= 0).all() and (keys < 1 << 60).all() and len(np.unique(keys[0])) > 490
    assert not (np.argsort(keys[0]) == np.argsort(keys[1])).all()
    place = np.argsort(np.argsort(keys[0]))
    near = np.argsort(((v[:, None] - v[None]) ** 2).sum(2), axis=1)[:, 1]
    assert np.abs(place - place[near]).mean() < 0.8 * np.abs(place - place[::-1]).mean()  # neighbours lie nearer along the curve
    i, j, d = nearest_rows(np.zeros((1, 2)), np.array([[1.0, 0], [0, 1], [0, 2]]), np.array([9, 3, 1]), 2)
    assert j.tolist() == [1, 0] and d.tolist() == [1.0, 1.0]
    assert nearest_rows(np.zeros((0, 2)), np.zeros((0, 2)), np.zeros(0, int), 3)[0].tolist() == []
    apart = np.array([[5, 0, 0], [0, 4, 0], [1, 1, 0]])
    assert chosen(apart, 10, 1.0) == (3, 0) and chosen(apart[:, :2], 10, 1.0) == (2, 1)
    assert chosen(np.empty((0, 6), int), 1, 0.97) == (2, 0)


# 12 -----------------------------------------------------------------------------------

SPOKEN = [(1, "The quick Brown-fox " * 9), (2, None), (None, "quick brown fox " * 10), (3, ""), (4, "Ünïcode — ‘quoted’ words İ ß " * 7), (5, "x" * 300 + " y " + "z" * 64 + " w" * 40), (6, "a b"), (6, "the quick brown fox jumps " * 5), (6, "the quick brown fox jumps " * 5), (8, "nothing like it at all " * 300)]


def brute_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def brute_resampled(docs, target, percent=5, least_words=20):
    own = [(i, *brute_features(t)) for i, t in docs]
    s, t = collections.Counter(b for _, _, f in own for b in f), collections.Counter(b for x in target for b in brute_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000.0) / ((s[b] + 1.0) * (T + 10000.0)))) for b in s}
    out = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    most = percent * len(fit) // 100
    marked = collections.Counter()
    ranks = collections.defaultdict(list)
    for k, r in enumerate(fit[:most]):
        ranks[r].append(k + 1)
    for r in out:
        rank = ranks[r].pop(0) if ranks[r] else None
        marked[(r[0], r[2], r[3], r[4], rank)] += 1
    return marked


@pytest.mark.parametrize("percent", [5, 60, 100, 0])
def test_resampled(spark, percent):
    docs = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in SPOKEN], TEXTS).repartition(3)
    target = ["quick brown fox", "fox jumps over the dog", None, ""]
    got = resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent)
    assert got.dtypes == [(n, "bigint") for n in ("doc_id", "n_features", "weight", "score", "rank")]
    assert collections.Counter(map(tuple, got.collect())) == brute_resampled(SPOKEN, target, percent)


def test_resampled_documents(spark, data):
    docs, target = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    want = brute_resampled([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert collections.Counter(map(tuple, resampled(docs, target).collect())) == want
    picked = drawn(docs, target)
    assert picked.columns == docs.columns and {r["doc_id"] for r in picked.collect()} == {r[0] for r in want if r[4]}


def test_resampled_of_nothing(spark):
    docs = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in SPOKEN], TEXTS)
    none = docs.limit(0)
    assert resampled(none, docs).collect() == []
    assert collections.Counter(map(tuple, resampled(docs, none).collect())) == brute_resampled(SPOKEN, [])
    with pytest.raises(ValueError):
        resampled(docs, docs, percent=101)


def test_checksums_of_joined_words():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 2, 5, 63, 64, 65, 200, 4097, 70000)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    crcs = span_crcs(raw, ends - [len(t) for t in texts], ends)
    assert crcs.tolist() == [zlib.crc32(t) for t in texts]
    for a in texts[:5]:
        both = shifted(np.full(len(texts), zlib.crc32(a), np.uint32), np.array([len(t) for t in texts])) ^ crcs
        assert both.tolist() == [zlib.crc32(a + t) for t in texts]
    words, text, bucket = text_features(pa.array([t for _, t in SPOKEN]))
    for d, (_, t) in enumerate(SPOKEN):
        n, f = brute_features(t)
        assert words[d] == n and sorted(bucket[text == d].tolist()) == sorted(f)


def test_sliced_weights_are_products():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.1, (7, 1000)) * rng.integers(0, 5000, (7, 1000))
    for gains in (rng.integers(-9000, 9000, 1000), np.zeros(1000, int), np.full(1000, -1), np.full(1000, 8), np.full(1000, -8)):
        assert (sliced_weights(counts, *gain_planes(gains)) == counts @ gains).all()


# 13 -----------------------------------------------------------------------------------


def brute_codes(given, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * c) for c in v], l) for i, v, l in given if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return []
    x = np.array([v for _, v, _ in kept], np.int64).reshape(len(kept), parts, -1)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = x[first].swapaxes(0, 1).copy()
    far = lambda: np.stack([((x[:, p, None, :] - books[p][None]) ** 2).sum(2) for p in range(parts)], 1)
    for _ in range(rounds):
        near = far().argmin(2)
        for p in range(parts):
            for e in range(len(first)):
                own = x[near[:, p] == e, p]
                if len(own):
                    books[p, e] = [int(s) // len(own) for s in own.sum(0)]
    d = far()
    near, error = d.argmin(2), d.min(2).sum(1)
    total = collections.Counter()
    for (_, _, l), e in zip(kept, error.tolist(), strict=True):
        total[l] += e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c in n), e, total[l], digest) for (i, _, l), n, e in zip(kept, near.tolist(), error.tolist(), strict=True)]


@pytest.mark.parametrize("block_cells", [1 << 20, 700])
def test_codes(spark, block_cells):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 0.2, (700, 32))
    v[100:350] = v[3]
    v[400:500] = np.round(v[400:500] * 8) / 8  # ties
    given = [(i * 7 % 1000, x.tolist(), [None, "", "a", "b"][i % 4]) for i, x in enumerate(v)]
    nan = float("nan")
    given += [(1, None, "a"), (2, [nan] * 32, "a"), (3, [None] + [0.0] * 31, "a"), (4, [math.inf] * 32, "a"), (None, v[5].tolist(), "a"), (5, v[6].tolist(), None), (5, v[6].tolist(), None), (0, [0.0] * 32, "b")]
    got = vector_codes(vector_rows(spark, given).repartition(3), block_cells=block_cells)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute_codes(given))


def test_codes_of_few_rows(spark):
    few = [(3, [float(k) for k in range(16)], "a"), (1, [0.5] * 16, None)]
    assert sorted(map(tuple, vector_codes(vector_rows(spark, few)).collect())) == sorted(brute_codes(few))
    none = vector_rows(spark, few).limit(0)
    assert vector_codes(none).collect() == [] and vector_codes(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    for wrong in ([(1, [1.0] * 16, "a"), (2, [1.0] * 32, "a")], [(1, [1.0] * 15, "a")], [(1, [1e9] * 16, "a")]):
        with pytest.raises(ValueError):
            vector_codes(vector_rows(spark, wrong))


@pytest.mark.parametrize("n, d, spread", [(3000, 4, 60), (2000, 1, 3), (1, 4, 5), (400, 4, 1 << 25), (2000, 8, 2), (500, 2, 0)])
def test_cover_trees(n, d, spread):
    rng = np.random.default_rng(n + d)
    x = rng.normal(0, spread, (n, d)).astype(np.int64)
    order, nodes, radius = tree = cover_tree(x)
    assert sorted(order.tolist()) == list(range(n))
    for (start, stop, centre, child, children), r in zip(nodes.tolist(), radius, strict=True):
        far = np.sqrt(((x[order[start:stop]] - x[centre]) ** 2).sum(1).astype(float))
        assert far.max() <= r and centre in order[start:stop]
        if children:
            own = nodes[child : child + children]
            assert own[0][0] == start and own[-1][1] == stop and (own[1:, 0] == own[:-1, 1]).all() and own[0][2] == centre
            middles = x[own[:, 2]]
            between = np.sqrt(((middles[:, None] - middles[None]) ** 2).sum(2).astype(float)) + np.eye(children) * 1e18
            assert between.min() > r / 2 and (radius[child : child + children] <= r / 2 + 1e-9).all()
    entries = x[:64]
    far = ((x[:, None] - entries[None]) ** 2).sum(2)
    codes, count, sums, single = tree_codes(x, tree, entries)
    assert (squares(x, entries) == far).all() and (codes == far.argmin(1)).all()
    assert (count == np.bincount(codes, minlength=len(entries))).all() and single <= n
    want = np.zeros_like(entries)
    np.add.at(want, codes, x)
    assert (sums == want).all()


def test_whole_subtrees_are_assigned():
    """Tight groups: few rows are compared singly."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.integers(-3, 4, (1000, 4)) + m for m in rng.integers(-5000, 5000, (8, 4))])
    entries = np.stack([x[k * 1000] for k in range(8)])
    codes, _, _, single = tree_codes(x, cover_tree(x), entries)
    assert single == 0 and (codes == np.repeat(np.arange(8), 1000)).all()
