"""The corpus pipeline and the registered SQL of the subpackage's queries."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tidewater.llm import packing, pieces, quality, repeats, simhash, toxicity
from tidewater.llm.queries import ORACLES, QUERIES

from .conftest import DATA, words
from .test_copies import brute_spans, table, union_find


def test_registered():
    assert [q.partition("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 11)]
    found = entry.queries()
    assert set(QUERIES) <= set(found) and found["pipeline"] is corpus_pipeline.run
    assert set(ORACLES) <= set(entry.oracle_sql()) and "pipeline" not in entry.oracle_sql()
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cur = con.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[columns.index(c)] for c in df.columns)) for r in cur.fetchall())


def test_pipeline_against_its_stages_by_hand(spark, mini):
    """The rows of run(), from the fitted models' verdicts and brute-force groups and passages."""
    docs = mini.df(spark)
    verdict = {r.doc_id: r.toxic for r in toxicity.score(docs, toxicity.fit(docs, mini.lab(spark))).where("doc_id is not null").collect()}
    # texts without an id are judged by their text; none of them is toxic here
    left = [(d, t) for d, t in mini.docs if d is None or not verdict[d]]
    clean = table(spark, left)
    model = quality.fit(clean)
    score = model.score([(t or "").encode() for _, t in left])
    left = [x for x, s in zip(left, score) if s >= quality.THRESHOLD]
    named = [(d, t) for d, t in left if d is not None]
    fp, has = simhash.fingerprint_batch([(t or "").encode() for _, t in named])
    edges = []
    for i in range(len(named)):
        for j in range(i):
            far = [int(a ^ b).bit_count() for a, b in zip(fp[i], fp[j])]
            if has[i] and has[j] and named[i][0] != named[j][0] and far[0] <= simhash.NEAR and sum(far) <= simhash.NEAR_ALL:
                edges.append((named[i][0], named[j][0]))
    root = union_find(edges)
    assert any(root[d] != d for d in root)
    left = [(d, t) for d, t in left if root.get(d, d) == d]
    spans = brute_spans(left)
    cut = []
    for d, t in left:
        own = [(s, e) for x, s, e in spans if x == d]
        kept = [w for i, w in enumerate(words(t)) if not any(s <= i < e for s, e in own)]
        if kept or not own:
            cut.append((d, kept))

    stage = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        stage = step(spark, stage, mini.dir)
        assert stage.columns == docs.columns, name
    have = [(r.doc_id, r.text) for r in stage.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((d, words(t)) for d, t in have), key=key) == sorted(cut, key=key)

    encode = pieces.Encoder(pieces.Vocabulary(pieces.read_model())).encode
    want = {}
    for d, t in have:
        n = len(encode([t.encode()])[0]) if t else 0
        for k in range(0, n, packing.CAPACITY):
            want[d, k, min(packing.CAPACITY, n - k)] = want.get((d, k, min(packing.CAPACITY, n - k)), 0) + 1
    got = {}
    for r in corpus_pipeline.run(spark, mini.dir).collect():
        got[r.doc_id, r.start, r.n_tokens] = got.get((r.doc_id, r.start, r.n_tokens), 0) + 1
    assert got == want


def test_stages_on_empty_tables(spark, mini):
    none = mini.df(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, mini.dir).count() == 0


def test_planted_cases(spark):
    """Copies, passages and toxic documents in the smaller tables are dealt with, clean ones kept."""
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    copies = docs.limit(20).selectExpr("doc_id + 1000000 as doc_id", "text", "lang", "source", "n_chars")
    near = docs.where("length(text) > 800").limit(20).selectExpr("doc_id + 2000000 as doc_id", "concat('Well. ', text, ' End.') as text", "lang", "source", "n_chars")
    both = docs.union(copies).union(near)
    kept = {r.doc_id for r in simhash.keep_one(both).select("doc_id").collect()}
    assert not [d for d in kept if d >= 2_000_000] and not [d for d in kept if d >= 1_000_000 and d < 2_000_000]
    assert len(kept) > 700
    cut = repeats.cut_spans(both.where("doc_id < 1000000"))
    assert cut.count() > 0.8 * docs.count()
