"""n-gram scores, toxicity and quality."""

import math
from collections import Counter

import numpy as np
import pytest

from tidewater.llm import ngram_lm, quality, toxicity
from tidewater.llm.words import Words

from .conftest import words

def sorted_scores(rows, alpha=ngram_lm.ALPHA):
    """{doc_id: [words, log-probability, summed context lengths]} from one exact suffix array of all contexts, read backwards."""
    known = {}
    texts = [(d, [known.setdefault(w, len(known)) for w in words(t)]) for d, t in rows]
    # each text backwards and closed by a number of its own: the context of a word is what follows it
    flat, doc = [], []
    for k, (d, t) in enumerate(texts):
        flat += [*reversed(t), len(known) + k]
        doc += [k] * (len(t) + 1)
    flat, doc = np.array(flat, dtype=np.int64), np.array(doc)
    n, total = len(flat), sum(len(t) for _, t in texts)
    ranks = [np.unique(flat, return_inverse=True)[1]]
    while ranks[-1].max() < n - 1:
        step = 1 << (len(ranks) - 1)
        then = np.zeros(n, dtype=np.int64)
        then[: n - step] = ranks[-1][step:] + 1
        ranks.append(np.unique(ranks[-1] * (n + 1) + then, return_inverse=True)[1])
    word = np.flatnonzero(flat < len(known))
    order = word[np.argsort(ranks[-1][word + 1])] + 1  # contexts that a word follows
    m = len(order)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(m)

    def common(a, b):
        length = np.zeros(len(a), dtype=np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
            same = (ranks[k][x] == ranks[k][y]) & (x + (1 << k) <= n) & (y + (1 << k) <= n)
            length += np.where(same, 1 << k, 0)
        return length

    near = np.zeros(m + 1, dtype=np.int64)
    near[1:m] = common(order[:-1], order[1:])
    start = word + 1  # where the context begins
    length = np.maximum(near[place[start]], near[place[start] + 1])

    def edge(sign):
        at = place[start].copy()
        step = 1 << int(n).bit_length()
        while step:
            far = at + sign * step
            ok = (far >= 0) & (far < m)
            ok[ok] = common(order[far[ok]], start[ok]) >= length[ok]
            at = np.where(ok, far, at)
            step //= 2
        return at

    low, high = edge(-1), edge(1)
    alone = high - low + 1
    # occurrences of the word before the context's places, by their rank
    key = np.sort(flat[order - 1] * n + np.arange(m))
    both = np.searchsorted(key, flat[word] * n + high, side="right") - np.searchsorted(key, flat[word] * n + low)
    p = np.bincount(flat[word])[flat[word]] / total
    logp = np.where(length > 0, np.log((both - 1 + alpha * p) / (alone - 1 + alpha)), np.log(p))
    out = {d: [0, 0.0, 0] for d, _ in rows}
    sums = [np.bincount(doc[word], weights=x, minlength=len(texts)) for x in (np.ones(len(word)), logp, length)]
    for k, (d, _) in enumerate(texts):
        for j in range(3):
            out[d][j] += sums[j][k]
    return out


def test_the_two_references_agree():
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, n) % 60)) for i, n in enumerate((0, 1, 5, 60, 200, 300))]
    rows += [(9, rows[4][1]), (10, None), (11, rows[5][1] + " tail")]
    one, other = sorted_scores(rows), brute_longest(rows)
    assert {d: pytest.approx(x) for d, x in one.items()} == other


def test_ngram_query_on_all_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = sorted_scores([(r.doc_id, r.text) for r in rows])
    got = {r.doc_id: r for r in ngram_lm.op3(spark, "/root/testdata/sf0.01").collect()}
    assert got.keys() == want.keys()
    for d, (n, logp, context) in want.items():
        assert got[d].n_words == n
        if n:
            assert got[d].mean_logp == pytest.approx(logp / n, abs=1e-5) and got[d].mean_context == pytest.approx(context / n)


def test_ngram_query(spark, mini):
    got = {r.doc_id: r for r in ngram_lm.op3(spark, mini.dir).collect()}
    want = sorted_scores(mini.docs)
    assert got.keys() == want.keys()
    for d, (n, logp, context) in want.items():
        r = got[d]
        assert r.n_words == n
        if n:
            assert r.mean_logp == pytest.approx(logp / n, abs=1e-5) and r.mean_context == pytest.approx(context / n)
            assert r.perplexity == pytest.approx(math.exp(-logp / n), rel=1e-4)
        else:
            assert r.mean_logp is None and r.perplexity is None and r.mean_context is None


def test_ngram_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_lm.score(none).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.n_words for r in ngram_lm.score(nulls).collect()] == [0, 0]


def term_counts(text):
    found = [w.encode() for w in words(text)]
    return Counter([(0, w) for w in found] + [(1, w[:6]) for w in found if len(w) >= 7])


def brute_toxicity(docs, labels, k=toxicity.NEIGHBOURS):
    """{doc_id: (neighbours, cosines, share of toxic votes)} by plain dictionaries, and {example: toxic}."""
    toxic = {}
    for d, _, t in labels:
        if d is not None and t is not None:
            toxic[d] = toxic.get(d, False) or t != 0
    rate = sum(toxic.values()) / len(toxic)
    unique = {}
    for d, t in docs:
        if d is not None and t is not None:
            unique[d] = max(t, unique.get(d, ""))
    examples = {d: term_counts(unique[d]) for d in toxic if d in unique}
    n1 = sum(toxic[d] for d in examples)
    n0 = len(examples) - n1
    seen, good, bad = Counter(), Counter(), Counter()
    for _, t in docs:
        seen.update(term_counts(t).keys())
    for d, c in examples.items():
        (bad if toxic[d] else good).update(c.keys())
    weight = {}
    for term in good.keys() | bad.keys():
        of_all = (good[term] + bad[term] + 1) / (n1 + n0 + 2)
        z = (bad[term] / n1 - good[term] / n0) / math.sqrt(of_all * (1 - of_all) * (1 / n1 + 1 / n0))
        weight[term] = math.log((1 + len(docs)) / (1 + seen[term])) * max(1, abs(z))

    def vector(counts):
        v = {t: (1 + math.log(n)) * weight[t] for t, n in counts.items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    index = {d: vector(c) for d, c in examples.items()}
    out = {}
    for d, t in unique.items():
        q = vector(term_counts(t))
        cosine = {e: math.fsum(x * v.get(w, 0) for w, x in q.items()) for e, v in index.items() if e != d}
        near = sorted((e for e in cosine if cosine[e] > 1e-12), key=lambda e: (-round(cosine[e], 10), e))[:k]
        votes = [(rate if toxic[e] else 1 - rate) * len(examples) / (n1 if toxic[e] else n0) / (1.05 - min(1, cosine[e])) for e in near]
        out[d] = near, [cosine[e] for e in near], round(sum(v for v, e in zip(votes, near) if toxic[e]) / sum(votes), 9) if near else None
    return out, {d: toxic[d] for d in examples}


@pytest.fixture(scope="module")
def toxic_model(spark, mini):
    return toxicity.fit(mini.df(spark), mini.lab(spark))


def test_toxicity_query_is_exact(spark, mini, toxic_model):
    rows = toxicity.op4(spark, mini.dir).collect()
    assert len(rows) == len(mini.docs)
    got = {r.doc_id: r for r in rows}
    want, examples = brute_toxicity(mini.docs, mini.labels)
    assert len(examples) > 50
    for d, (near, cosine, share) in want.items():
        assert got[d].cosines == pytest.approx(cosine, abs=1e-9)
        # near ties may change places
        assert sorted(got[d].neighbours) == sorted(near) or cosine[-1] == pytest.approx(got[d].cosines[-1], abs=1e-9)
        assert got[d].score == pytest.approx(toxic_model.none if share is None else float(toxic_model.calibrated(np.array(share))), abs=1e-6)
        assert got[d].toxic == (got[d].score >= toxicity.THRESHOLD)
        assert near or not any(term_counts(mini.unique[d]).keys() & term_counts(mini.unique[e]).keys() for e in examples if e != d)
    # the calibration is that of the examples' own shares
    seen = [e for e in examples if want[e][2] is not None]
    n1, rate = sum(examples.values()), sum(t for t in {d: max(t2 for d2, _, t2 in mini.labels if d2 == d and t2 is not None) for d, _, t in mini.labels if d is not None}.values())
    total = len({d for d, _, t in mini.labels if d is not None and t is not None})
    share_of = [(rate / total / (n1 / len(examples)) if examples[e] else (1 - rate / total) / (1 - n1 / len(examples))) for e in seen]
    steps, levels = toxicity.isotonic(np.array([want[e][2] for e in seen]), np.array([float(examples[e]) for e in seen]), np.array(share_of))
    assert steps == pytest.approx(toxic_model.steps, abs=1e-9) and levels == pytest.approx(toxic_model.levels, abs=1e-9)
    kept = toxicity.drop_toxic(mini.df(spark), toxic_model)
    assert kept.columns == mini.df(spark).columns
    clean = [d for d, _ in mini.docs if d is None or not got[d].toxic]
    assert sorted((r.doc_id or -1 for r in kept.collect()), key=int) == sorted(d or -1 for d in clean)


def test_block_bounds_lose_no_neighbour():
    """Many blocks, common and rare terms, ties and repeated examples, against the whole product."""
    rng = np.random.default_rng(2)
    n, v, k = 700, 900, 15
    sets = [np.unique(np.minimum(rng.zipf(1.3, rng.integers(1, 60)) - 1, v - 1)) for _ in range(n)]
    sets[600:] = sets[:100]
    row, term = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets)
    count = rng.integers(1, 5, len(term))
    weight = rng.random(v) + 0.1
    index = toxicity.Index(np.arange(n) * 3, rng.random(n) < 0.5, np.ones(n), weight, row, term, count)
    assert index.blocks > 10 and len(index.dense) and len(index.value)
    x = np.zeros((n, v))
    x[row, term] = (1 + np.log(count)) * weight[term]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = [3 * i if i % 2 else None for i in range(n)]
    text, example, cosine = index.nearest(row, term, count, own)
    full = x @ x.T
    for i in range(n):
        c = full[i].copy()
        if own[i] is not None:
            c[i] = -1
        best = [j for j in np.lexsort((np.arange(n), -np.round(c, 12))) if c[j] > 1e-12][:k]
        at = text == i
        assert cosine[at] == pytest.approx(np.minimum(c[best], 1), abs=1e-9)
        assert sorted(index.doc_id[example[at]]) == sorted(3 * j for j in best) or c[best[-1]] == pytest.approx(cosine[at][-1], abs=1e-9)


def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = toxicity.score(docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "truth"), "doc_id").collect()
    toxic = [r.toxic for r in rows if r.truth]
    clean = [r.toxic for r in rows if not r.truth]
    assert sum(toxic) / len(toxic) > 0.55 and sum(clean) / len(clean) < 0.01


def test_toxicity_without_labels(spark, mini):
    docs = mini.df(spark)
    for labels, rate in ((mini.lab(spark).where("false"), 0.0), (mini.lab(spark).where("toxic = 1"), 1.0), (mini.lab(spark).where("toxic = 0"), 0.0)):
        model = toxicity.fit(docs, labels)
        rows = toxicity.score(docs, model).collect()
        assert len(rows) == len(mini.docs) and {(r.score, r.toxic) for r in rows} == {(rate, False)}
        assert toxicity.drop_toxic(docs, model).count() == len(mini.docs)
    model = toxicity.fit(docs.where("false"), mini.lab(spark))
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_isotonic():
    steps, levels = toxicity.isotonic(np.array([0.1, 0.2, 0.2, 0.3, 0.9]), np.array([0, 1, 0, 0, 1.0]), np.ones(5))
    assert levels.tolist() == [0, pytest.approx(1 / 3), 1] and steps.tolist() == [0.1, 0.2, 0.9]


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(1)
    n, m = 20_000, len(quality.HEURISTICS)
    good = rng.random(n) < 0.8
    right = np.linspace(0.75, 0.98, m)
    votes = np.where(rng.random((n, m)) < right, np.where(good, 2, 0)[:, None], np.where(good, 0, 2)[:, None])
    votes[rng.random((n, m)) < 0.2] = 1
    code, count = np.unique(votes @ 3 ** np.arange(m), return_counts=True)
    share, rates, q = quality.em(code[:, None] // 3 ** np.arange(m) % 3, count)
    assert share == pytest.approx(0.8, abs=0.02)
    model = quality.Model(share, rates, {}, np.zeros(1), 0.0, 0)
    assert list(model.accuracies().values()) == pytest.approx(right, abs=0.02)


def test_quality_query(spark, mini):
    docs = mini.df(spark)
    model = quality.fit(docs)
    got = {}
    for r in quality.op5(spark, mini.dir).collect():
        got.setdefault(r.doc_id, r)
    base = 3 ** np.arange(len(quality.HEURISTICS))
    # posterior by Bayes' rule, and the dot product, text by text
    for d, text in mini.unique.items():
        raw = (text or "").encode()
        if not raw.split():
            assert (got[d].weak_posterior, got[d].score, got[d].keep) == (0.0, 0.0, False)
            continue
        v = quality.votes([raw])[0]
        p = [np.prod([model.rates[c, j, x] for j, x in enumerate(v)]) * w for c, w in enumerate((1 - model.share, model.share))]
        assert got[d].weak_posterior == pytest.approx(p[1] / sum(p), abs=1e-4)
        _, key, value = quality.features([raw])
        z = float(model.weight[key] @ value + model.bias)
        assert got[d].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6) and got[d].keep == (got[d].score >= 0.5)
        assert int(v @ base) in model.posterior
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.where("doc_id is not null").count() == sum(got[d].keep for d, _ in mini.docs if d is not None)


def test_votes_are_the_same_alone_and_in_a_batch(mini):
    texts = [(t or "").encode() for t in mini.unique.values()]
    assert (quality.votes(texts) == np.concatenate([quality.votes([t]) for t in texts])).all()


def test_quality_held_out(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = quality.score(docs, quality.fit(docs)).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    good, bad = ([r.keep for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.1


def test_quality_empty(spark, mini):
    none = mini.df(spark).where("false")
    assert quality.score(none, quality.fit(none)).count() == 0
    blank = mini.df(spark).where("doc_id in (100000, 100001, 100002)")
    assert quality.keep_good(blank, quality.fit(blank)).count() == 0


def brute_longest(rows, alpha=ngram_lm.ALPHA):
    """{doc_id: [words, log-probability, summed context lengths]}, growing contexts word by word."""
    texts = [(d, [hash(w) for w in words(t)]) for d, t in rows]
    uni = Counter(w for _, t in texts for w in t)
    total = sum(uni.values())
    out = {d: [0, 0.0, 0] for d, _ in rows}
    live = [(d, t, i) for d, t in texts for i in range(len(t))]
    best, n = {}, 0
    groups = [list(range(len(live)))]
    while groups:
        n += 1
        after = []
        for g in groups:
            by = {}
            for k in g:
                _, t, i = live[k]
                if i >= n:
                    by.setdefault(t[i - n], []).append(k)
            for own in by.values():
                if len(own) > 1:
                    after.append(own)
                    seen = Counter(live[k][1][live[k][2]] for k in own)
                    for k in own:
                        best[k] = n, len(own), seen[live[k][1][live[k][2]]]
        groups = after
    for k, (d, t, i) in enumerate(live):
        p = uni[t[i]] / total
        length, alone, both = best.get(k, (0, 0, 0))
        out[d][0] += 1
        out[d][1] += math.log((both - 1 + alpha * p) / (alone - 1 + alpha)) if length else math.log(p)
        out[d][2] += length
    return out


@pytest.mark.parametrize("size,heavy", [(65_535, 200_000), (40, 5), (3000, 60)])
def test_ngram_contexts_of_every_length_and_all_counts(spark, size, heavy):
    rng = np.random.default_rng(3)
    made = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % 500) for n in (1, 2, 3, 40, 400, 900)]
    parts = made[5].split()
    made += [" ".join(parts[s:e]) + " z " + made[3] for s, e in ((0, 1), (3, 8), (10, 31), (50, 127), (55, 300), (0, 900), (200, 700))]
    rows = [*enumerate(made), (100, None), (101, ""), (None, made[4]), (3, made[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in ngram_lm.score(docs, size=size, heavy=heavy).collect()}
    want = brute_longest(rows)
    assert got.keys() == want.keys()
    for d, (n, logp, context) in want.items():
        assert got[d].n_words == n
        if n:
            assert got[d].mean_logp == pytest.approx(logp / n, abs=1e-5) and got[d].mean_context == pytest.approx(context / n)
