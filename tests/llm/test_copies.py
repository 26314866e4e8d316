"""Near copies of documents and embeddings, repeated passages, nearest neighbours."""

import random

import numpy as np
import pytest

from tidewater.llm import cells, components, knn_graph, repeats, simhash, vector_copies
from tidewater.llm.vectors import normalised
from tidewater.llm.words import Words

from .conftest import SCHEMA, words


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def table(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None if t is None else len(t), 1.0, "k", "g", i) for i, (d, t) in enumerate(rows)], SCHEMA)


def prose(rng, n, vocabulary=4000):
    return [f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary)):04d}" for _ in range(n)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], "a long, b long")
    got = {r.id: r.root for r in components.components(df).collect()}
    want = {x: r for x, r in union_find(e for e in edges if e[0] != e[1]).items() if x != r}
    assert got == want
    assert components.components(df.where("false")).count() == 0


def test_pigeonhole_meets_every_close_pair():
    masks = simhash.choices()
    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for j in rng.sample(range(64), simhash.NEAR):
            b ^= 1 << j
        assert any(a & m == b & m for m in masks)


def test_close_edges_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**64, (120, 4), dtype=np.uint64)
    near = []
    for i in range(80):
        x = fp[i].copy()
        for j in rng.choice(256, rng.integers(1, 60), replace=False):
            x[j // 64] ^= np.uint64(1) << np.uint64(j % 64)
        near.append(x)
    fp = np.concatenate([fp, np.array(near)])
    rows = [(i, *(int(v) for v in f.view(np.int64))) for i, f in enumerate(fp)]
    df = spark.createDataFrame(rows, "node long, f0 long, f1 long, f2 long, f3 long")
    d = np.bitwise_count(fp[:, None] ^ fp[None, :])
    a, b = np.nonzero((d[:, :, 0] <= simhash.NEAR) & (d.sum(axis=2) <= simhash.NEAR_ALL))
    edges = [(int(x), int(y)) for x, y in zip(a, b) if x < y]
    assert len(edges) > 10
    got = union_find((r.a, r.b) for r in simhash.close_edges(df).collect())
    assert got == union_find(edges)


def test_comparisons_do_not_grow_with_the_bucket():
    """Fingerprints of one bucket: random ones, with close pairs and a dense group among them."""
    rng = np.random.default_rng(12)
    each = []
    for n in (2000, 10_000):
        fp = rng.integers(0, 2**64, (n, 4), dtype=np.uint64)
        fp[: n // 50] = fp[n // 2 : n // 2 + n // 50] ^ (np.uint64(1) << rng.integers(0, 64, (n // 50, 4), dtype=np.uint64))
        fp[n // 4 : n // 4 + 150] = fp[0] ^ (np.uint64(1) << rng.integers(0, 64, (150, 4), dtype=np.uint64))
        i, j, compared = simhash.close(fp, np.zeros(n, dtype=np.uint64), simhash.NEAR, simhash.NEAR_ALL)
        a, b = [], []
        for s in range(n):
            near = np.flatnonzero((np.bitwise_count(fp[s] ^ fp[s + 1 :])[:, 0] <= simhash.NEAR) & (np.bitwise_count(fp[s] ^ fp[s + 1 :]).sum(axis=1, dtype=np.int64) <= simhash.NEAR_ALL))
            a += [s] * len(near)
            b += (near + s + 1).tolist()
        assert len(a) > n // 50
        assert union_find(zip(i.tolist(), j.tolist())) == union_find(zip(a, b))
        each.append(compared / n)
    assert each[1] < 1.5 * each[0] + 200


def test_groups_of_copies(spark):
    rng = random.Random(1)
    base = [prose(rng, 300) for _ in range(12)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, " ".join(base[i]).upper() + "!") for i in range(4)]  # the same words
    rows += [(200 + i, " ".join(x if rng.random() > 0.02 else "changed" for x in base[i])) for i in range(4, 8)]
    rows += [(None, " ".join(base[0])), (300, None), (301, ""), (302, "?!"), (303, None), rows[9], (9, "other words altogether"), (304, "other words altogether")]
    df = table(spark, rows)
    got = {r.doc_id: (r.group_id, r.n_docs) for r in simhash.groups(df).collect()}
    want = {i: (i, 2) for i in range(8)} | {100 + i: (i, 2) for i in range(4)} | {200 + i: (i, 2) for i in range(4, 8)} | {9: (9, 2), 304: (9, 2)}
    assert got == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted([*range(12), 9, 9, 300, 301, 302, 303]) and ids.count(None) == 1
    assert simhash.groups(df.where("false")).count() == 0 and simhash.keep_one(df.where("false")).count() == 0


def test_long_text_fingerprint_is_exact():
    rng = random.Random(9)
    text = " ".join(prose(rng, 70_000, 90_000)).encode()
    import hashlib
    from collections import Counter

    sums = np.zeros(256, dtype=np.int64)
    for w, n in Counter(text.split()).items():
        sums += n.bit_length() * (2 * np.unpackbits(np.frombuffer(hashlib.sha256(w).digest(), dtype=np.uint8)).astype(np.int64) - 1)
    fp, has = simhash.fingerprint_batch([b"", text])
    assert has.tolist() == [False, True]
    assert np.unpackbits(fp[1:].astype(">u8").view(np.uint8)).tolist() == (sums > 0).astype(int).tolist()


def brute_spans(rows, n=repeats.LENGTH):
    first, at = {}, []
    for d, t in rows:
        w = words(t) if d is not None else []
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            first[k] = min(first.get(k, d), d)
            at.append((d, s, k))
    covered = {}
    for d, s, k in at:
        if first[k] < d:
            covered.setdefault(d, set()).update(range(s, s + n))
    out = []
    for d, places in covered.items():
        for p in sorted(places):
            if p - 1 not in places:
                start = p
            if p + 1 not in places:
                out.append((d, start, p + 1))
    return sorted(out)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(4)
    shared = [prose(rng, n) for n in (49, 50, 51, 60, 75, 120, 400)]
    rows = []
    for d in range(40):
        w = prose(rng, rng.randrange(0, 150))
        for _ in range(rng.randrange(3)):
            part = rng.choice(shared)
            cut = rng.randrange(max(1, len(part) - 55)) if len(part) > 60 else 0
            w += part[cut:] + prose(rng, rng.randrange(0, 40))
        rows.append((d, "The " + ", ".join(w).capitalize() + "."))
    rows += [(50, "again and " * 200), (51, "again and " * 130), (52, rows[0][1]), (None, rows[1][1]), (53, None), (54, ""), (55, "short"), rows[3], (-1, " ".join(shared[2]))]
    return rows


def test_repeated_passages(spark, passages):
    df = table(spark, passages)
    got = sorted((r.doc_id, r.start_word, r.end_word) for r in repeats.repeated_passages(df).collect())
    want = brute_spans(passages)
    assert len(want) > 20 and got == want
    assert repeats.repeated_passages(df.where("false")).count() == 0


def test_cut_spans(spark, passages):
    df = table(spark, passages)
    spans = {}
    for d, s, e in brute_spans(passages):
        spans.setdefault(d, []).append((s, e))
    want = []
    for d, t in passages:
        left = [w for i, w in enumerate(words(t)) if not any(s <= i < e for s, e in spans.get(d, []))]
        if left or d not in spans or not words(t):
            want.append((d, left))
    got = repeats.cut_spans(df)
    assert got.columns == df.columns
    rows = got.collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, words(r.text)) for r in rows), key=key) == sorted(want, key=key)
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    plain = got.drop("n_chars").columns
    assert repeats.cut_spans(df.drop("n_chars")).columns == plain
    clash = [f"{c} as {c}" for c in ("doc_id", "text")] + ["node as __span_id", "node as id", "node as starts", "keep as ends"]
    other = repeats.cut_spans(df.selectExpr(*clash))
    assert other.columns == ["doc_id", "text", "__span_id", "id", "starts", "ends"]
    assert sorted((r.node, r.text or "") for r in rows) == sorted((r.__getitem__("__span_id"), r.text or "") for r in other.collect())
    assert repeats.cut_spans(df.where("false")).count() == 0


def test_windows_through_the_parse_are_complete():
    """No window of a shared passage is lost, wherever it lies."""
    rng = random.Random(8)
    for _ in range(30):
        passage = prose(rng, 50, 200)
        texts = [" ".join(prose(rng, rng.randrange(60), 200) + passage + prose(rng, rng.randrange(60), 200)).encode() for _ in range(2)]
        names = [repeats.Parse(Words([t])).name for t in texts]
        both = np.intersect1d(*names)
        found = []
        for t in texts:
            _, _, name = repeats._candidates(Words([t]), [both])
            found.append(set(name.tolist()))
        assert found[0] & found[1]


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], 0, 0.5) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cosine double")


ODD = [(900, None, 1, 0.0), (901, [], 1, 0.0), (902, [0.0] * 16, 1, 0.0), (903, [float("nan")] + [1.0] * 15, 1, 0.0), (None, [1.0] * 16, 1, 0.0)]


def test_vector_copies(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 16))
    x[200:240] = x[:40] * 3 + rng.standard_normal((40, 16)) * 0.05
    x[240:300] = x[7]
    df = vectors(spark, x, [*ODD, (904, [1.0, 2.0], 0, 0.0), (905, [2.0, 4.0], 0, 0.0), (3, x[3].tolist(), 0, 0.0)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(u @ u.T >= vector_copies.COSINE)
    edges = [(int(i), int(j)) for i, j in zip(a, b) if i < j] + [(904, 905)]
    root = union_find(edges)
    size = {r: list(root.values()).count(r) for r in root.values()}
    got = {r.vec_id: (r.group_id, r.n_vectors) for r in vector_copies.copies(df).collect()}
    assert got == {i: (i, 1) for i in range(300)} | {i: (r, size[r]) for i, r in root.items()}
    assert vector_copies.copies(df.where("false")).count() == 0


def recall(rows, x, k, queries=None, asked=None):
    """Of the neighbours found for other queries, or for the rows ``asked`` (all by default) among the others."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = list(range(len(x))) if asked is None and queries is None else asked
    q = u[asked] if queries is None else queries / np.linalg.norm(queries, axis=1, keepdims=True)
    c = q @ u.T
    if queries is None:
        c[np.arange(len(asked)), asked] = -2
    place = {d: i for i, d in enumerate(asked)} if asked is not None else {i: i for i in range(len(q))}
    kth = -np.sort(-c, axis=1)[:, k - 1]
    hits = 0
    for r in rows:
        assert r.cosine == pytest.approx(c[place[r.query], r.neighbour], abs=1e-5)
        hits += r.cosine >= kth[place[r.query]] - 1e-6
    return hits / (len(q) * k)


def test_nearest_query(spark, tmp_path):
    """A third of the rows are copies of one vector; the queries are the ids divisible by 50, against all rows."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x[2000:] = x[50]
    vectors(spark, x, [(3001 + i, *r[1:]) for i, r in enumerate(ODD[:4])]).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = knn_graph.op8(spark, str(tmp_path)).collect()
    asked = list(range(0, 3000, 50))
    assert sorted((r.query, r.rank) for r in rows) == [(i, k) for i in asked for k in range(1, 11)]
    assert recall(rows, x.astype(float), 10, asked=asked) >= 0.95
    copies = [50, *range(2000, 3000)]
    for q in (50, 2000, 2950):
        assert [r.neighbour for r in sorted(rows, key=lambda r: r.rank) if r.query == q] == [i for i in copies if i != q][:10]


def test_nearest_query_takes_few_jobs(spark):
    """A graph of all rows, made and searched in rounds, took hundreds."""
    df = vectors(spark, np.random.default_rng(14).standard_normal((2500, 16)))
    spark.sparkContext.setJobGroup("nearest", "few jobs")
    try:
        assert knn_graph.nearest(df).count() == 500
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("nearest")) <= 40


def test_nearest_by_cells_misses_nothing_of_the_cells_it_meets(spark):
    """All rows are measured and none may be missed: the exact answer, with a cell over several shards, copies and two sizes."""
    rng = np.random.default_rng(15)
    x = rng.standard_normal((1300, 12)).astype(np.float32)
    x[700:1100] = x[5] + rng.standard_normal((400, 12)) * 1e-3
    x[1100:1200] = x[6]
    y = rng.standard_normal((90, 7)).astype(np.float32)
    rows = [(i, [float(e) for e in v], 0, 0.5) for i, v in enumerate([*x, *y])]
    df = spark.createDataFrame([*rows, (5000, [1.0], 0, 0.5), *((7000 + i, *r[1:]) for i, r in enumerate(ODD[:4]))], "vec_id long, embedding array<float>, label int, cosine double")
    got = {}
    for r in cells.nearest(df, every=1, k=10, held=1390, target=1.0, shard=8000).collect():
        got.setdefault(r.query, {})[r.rank] = (r.neighbour, r.cosine)
    assert sorted(got) == list(range(1390))
    for first, part in ((0, x), (1300, y)):
        u = (part.astype(float) / np.linalg.norm(part.astype(float), axis=1, keepdims=True)).astype(np.float32).astype(float)
        for i in range(len(u)):
            c = np.clip(u @ u[i], -1, 1)
            c[i] = -2
            want = -np.sort(-c)[:10]
            assert sorted(got[first + i]) == list(range(1, 11))
            found = [got[first + i][k] for k in range(1, 11)]
            assert [f[1] for f in found] == pytest.approx(want, abs=1e-7)
            assert [c[f[0] - first] for f in found] == pytest.approx(want, abs=1e-7)
            assert len({f[0] for f in found}) == 10
    assert [got[1150][k][0] for k in range(1, 11)] == [6, *range(1100, 1109)]


def test_cells_are_packed_whole_or_split(spark):
    places, shards = cells._shards([(0, 64, 10), (1, 64, 2), (2, 64, 100), (3, 64, 1), (-5, 20, 3)], 1000)
    assert (places, shards) == ([(0, 0, 1), (1, 0, 1), (2, 1, 8), (3, 9, 1), (-5, 10, 1)], 11)


def test_nearest_start_is_small_and_the_descent_does_the_work(spark):
    x = np.random.default_rng(3).standard_normal((4000, 32))
    own = normalised(vectors(spark, x))
    begin = knn_graph._start(knn_graph._halves(own), 4000, knn_graph.DEGREE, knn_graph.TREES, knn_graph.CELL)
    assert begin.count() <= 4000 * knn_graph.DEGREE
    first = [r for r in begin.selectExpr("id as query", "other as neighbour", "cosine", "row_number() over (partition by id order by cosine desc) as rank").where("rank <= 10").collect()]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    np.fill_diagonal(c, -2)
    kth = -np.sort(-c, axis=1)[:, 9]
    good = lambda rows: sum(c[r[0], r[1]] >= kth[r[0]] - 1e-6 for r in rows) / 40_000
    graph = knn_graph.build(own).selectExpr("id as query", "other as neighbour", "cosine", "row_number() over (partition by id order by cosine desc) as rank").where("rank <= 10").collect()
    assert good(first) < 0.6 and good(graph) > 0.95


def test_nearest_for_other_queries(spark):
    rng = np.random.default_rng(8)
    x, q = rng.standard_normal((1500, 12)), rng.standard_normal((60, 12))
    own = normalised(vectors(spark, x))
    graph = knn_graph.build(own)
    rows = knn_graph.search(normalised(vectors(spark, q)), own, graph, k=5, beam=24).collect()
    assert recall(rows, x, 5, q) >= 0.9


def test_nearest_of_few_and_of_different_sizes(spark):
    for n, have in ((0, 0), (1, 0), (2, 2), (5, 20)):
        own = normalised(vectors(spark, np.random.default_rng(1).standard_normal((n, 16)), ODD[:4]))
        assert knn_graph.search(own, own, knn_graph.build(own), own=True).count() == have
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((40, 8)), rng.standard_normal((30, 5))
    rows = [(i, [float(v) for v in r], 0, 0.5) for i, r in enumerate([*x, *y])]
    rows = [*rows, rows[3], (3, rows[4][1], 0, 0.1), (70, [1.0], 0, 0.0)]
    got = knn_graph.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, query double"), every=1).collect()
    assert {(r.query < 40, r.neighbour < 40) for r in got} == {(True, True), (False, False)}
    assert len(got) == 700
    y = y / np.linalg.norm(y, axis=1, keepdims=True)
    c = y @ y.T
    np.fill_diagonal(c, -2)
    for q in range(30):
        assert [r.neighbour - 40 for r in sorted((r for r in got if r.query == 40 + q), key=lambda r: r.rank)] == np.argsort(-c[q])[:10].tolist()


def test_nearest_raises_beam_and_degree_to_the_recall(spark):
    x = np.random.default_rng(9).standard_normal((900, 48))
    own = normalised(vectors(spark, x))
    poor = knn_graph.build(own, degree=3)
    assert recall(knn_graph.search(own, own, poor, beam=10, own=True).collect(), x, 10) < 0.9
    graph, beam = knn_graph.tuned(own, degree=3, beam=10, held=200)
    assert recall(knn_graph.search(own, own, graph, beam=beam, own=True).collect(), x, 10) >= 0.9
