"""Piece ids, shards and packing."""

import struct

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import packing, pieces, token_shards

ODD = ["", " ", "  a", "x\n\ny", "a\0b", "① 　x", "▁a b▁", "a" * 3000, "\n", "hello   ", "🙂é", "İstanbul ﬁ", "\t\t  \t", " " * 40, "The cat, the CAT; 3.14 & co."]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=pieces.read_model())


def test_same_as_the_library(library):
    own = pieces.Encoder(pieces.Vocabulary(pieces.read_model()))
    for _ in range(2):  # from the suffix array, then from the cache
        ids, size = own.encode([t.encode() for t in ODD])
        assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == library.encode(ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abethinr ▁\n.,é🙂0", max_size=40), min_size=1, max_size=6))
def test_same_as_the_library_on_any_text(library, texts):
    ids, size = pieces.Encoder(pieces.encoder(pieces.read_model()).vocabulary).encode([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == library.encode(texts)


def test_cache_may_be_dropped(library):
    own = pieces.Encoder(pieces.encoder(pieces.read_model()).vocabulary, keep=3)
    for t in ODD:
        assert own.encode([t.encode()])[0].tolist() == library.encode(t)


def test_query_encodes_whole_table(spark, mini, library):
    rows = {r.doc_id: r for r in pieces.op7(spark, mini.dir).collect()}
    assert len(rows) == len({d for d, _ in mini.docs})
    for d, text in mini.unique.items():
        if text is None:
            assert rows[d].ids is None and rows[d].n_ids is None and rows[d].round_trip is None
        else:
            assert rows[d].ids == library.encode(text) and rows[d].n_ids == len(rows[d].ids)
            assert rows[d].round_trip == ("▁" not in text)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.op7(spark, mini.dir)).collect()}
    assert all(back[d] == (t and t.replace("▁", " ")) for d, t in mini.unique.items())


def test_shards_round_trip(spark, mini, library, tmp_path):
    made = token_shards.op1(spark, mini.dir)
    found = []
    for r in made.collect():
        reader = token_shards.ShardReader.of_bytes(bytes(r.bytes))
        assert r.n_docs == len(r.doc_ids) and [None if d == token_shards.NO_ID else d for d in reader.doc_ids.tolist()] == r.doc_ids
        found += [(d, None if x is None else x.tolist()) for d, x in reader.read(r.doc_ids)]
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1]))
    assert sorted(found, key=key) == sorted(((d, None if t is None else library.encode(t)) for d, t in mini.docs), key=key)
    files = token_shards.write_files(made, str(tmp_path / "out")).collect()
    some = [r for r in files if 7 in r.doc_ids][0]
    reader = token_shards.ShardReader.of_file(some.path)
    before = reader.fetched
    [(_, ids)] = list(reader.read([7]))
    assert ids.tolist() == library.encode(mini.unique[7])
    assert reader.fetched - before < 10_000 < (tmp_path / "out").joinpath(some.path).stat().st_size


def test_shards_split_and_detect_damage(spark, mini):
    many = token_shards.shards(mini.df(spark), shard_bytes=20_000).collect()
    assert len(many) > 3 and sum(r.n_docs for r in many) == len(mini.docs)
    data = bytearray(many[0].bytes)
    frames, _, _ = struct.unpack("<IBI", data[-9:])
    table = np.frombuffer(bytes(data[-9 - 12 * frames : -9]), dtype="<u4").reshape(-1, 3)
    k = int(np.argmax(table[:-1, 0]))
    data[int(table[:k, 0].sum()) + int(table[k, 0]) // 2] ^= 0xFF
    reader = token_shards.ShardReader.of_bytes(bytes(data))
    with pytest.raises(Exception):
        reader.frame(k)
    assert token_shards.shards(mini.df(spark).where("false")).count() == 0


def brute_assign(lengths, capacity, linear, quadratic):
    load = [[0.0, k, capacity] for k in range(-(-sum(lengths) // capacity))]
    out = []
    for n in lengths:
        fits = [x for x in load if x[2] >= n]
        if not fits:
            load.append([0.0, len(load), capacity])
            fits = load[-1:]
        best = min(fits)
        best[0] += packing.cost(n, linear, quadratic)
        best[2] -= n
        out.append(best[1])
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80), st.sampled_from([(1.0, 1 / 64), (0.0, 1.0), (1.0, 0.0)]))
def test_assign_is_the_greedy_rule(lengths, weights):
    lengths = np.array(sorted(lengths, reverse=True), dtype=np.int64)
    assert packing.assign(lengths, 60, *weights).tolist() == brute_assign(lengths.tolist(), 60, *weights)


def test_packing_query(spark, mini, library):
    got = packing.op2(spark, mini.dir).collect()
    want = {}
    for d, t in mini.docs:
        n = len(library.encode(t)) if t else 0
        for k in range(-(-n // packing.CAPACITY)):
            key = d, k, min(packing.CAPACITY, n - k * packing.CAPACITY)
            want[key] = want.get(key, 0) + 1
    have = {}
    for r in got:
        key = r.doc_id, r.segment, r.n_tokens
        have[key] = have.get(key, 0) + 1
        assert r.start == r.segment * packing.CAPACITY and r.cost == packing.cost(r.n_tokens)
    assert have == want
    # one group here: the whole table by the greedy rule
    order = sorted((-n, d is not None, d or 0, k) for (d, k, n), c in want.items() for _ in range(c))
    sequence = brute_assign([-x[0] for x in order], packing.CAPACITY, packing.LINEAR, packing.QUADRATIC)
    assert sorted((s, -x[0], x[2]) for s, x in zip(sequence, order)) == sorted((r.sequence & 0xFFFFFFFF, r.n_tokens, r.doc_id or 0) for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r.sequence, []).append((r.slot, r.n_tokens))
    assert all(sorted(s for s, _ in x) == list(range(len(x))) and sum(n for _, n in x) <= packing.CAPACITY for x in slots.values())


def test_packing_groups_and_empty(spark, mini):
    got = packing.pack(mini.df(spark), group_size=20).collect()
    assert len({r.sequence >> 32 for r in got}) > 3
    assert packing.pack(mini.df(spark).where("false")).count() == 0


def test_repeated_rows_and_null_ids_are_spread(spark):
    rows = [(None, "the same text")] * 3000 + [(7, "another text")] * 2000 + [(i, f"text {i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = packing.pack(df, capacity=64, group_size=500).collect()
    sizes = {}
    for r in got:
        sizes[r.sequence >> 32] = sizes.get(r.sequence >> 32, 0) + 1
    assert len(got) == 6000 and len(sizes) == 12 and max(sizes.values()) < 650
    room = {}
    for r in got:
        room[r.sequence] = room.get(r.sequence, 0) + r.n_tokens
    assert max(room.values()) <= 64
    again = packing.pack(df.repartition(2), capacity=64, group_size=500).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
