import threading
import time

import pytest
from pyspark.sql import functions as F

from tidewater.errors import DeadlockAbort
from tidewater.functions.visibility import Snapshot, Transactions, latest_per_slot, visible
from tidewater.locks import EXCLUSIVE, SHARED, LockManager
from tidewater.operators.graph import on_cycle


def test_six_visibility_properties():
    m = Transactions()
    t1 = m.begin()
    m.commit(t1)
    t2 = m.begin()
    t3 = m.begin()
    m.commit(t3)
    t4 = m.begin()
    t5 = m.begin()
    m.commit(t5)
    t6 = m.begin()
    t7 = m.begin()
    m.abort(t7)
    t8 = m.begin()
    assert m.snapshot(t2).sees(1, 0)
    assert not m.snapshot(t2).sees(3, 0)
    assert m.snapshot(t4).sees(3, 0)
    assert m.snapshot(t4).sees(1, 5) and not m.snapshot(t6).sees(1, 5)
    assert not m.snapshot(t8).sees(7, 0)
    assert m.snapshot(t8).sees(8, 0) and not m.snapshot(t8).sees(1, 8)
    assert m.reader().sees(3, 0) and not m.reader().sees(2, 0) and not m.reader().sees(7, 0)
    assert m.snapshot(t2) is m.snapshot(t2) and m.state(99) == "COMMITTED"


def test_visible_as_column_agrees(spark):
    versions = [(a, b) for a in range(7) for b in range(7)]
    df = spark.createDataFrame(versions, "xmin int, xmax int")
    for s in (Snapshot(4, frozenset({2}), frozenset({3}), 4), Snapshot(0, frozenset({5}), frozenset(), None), Snapshot(2, frozenset(), frozenset(), 2)):
        got = {tuple(r) for r in df.where(visible(F.col("xmin"), F.col("xmax"), s)).collect()}
        assert got == {v for v in versions if s.sees(*v)}


def test_replay_keeps_the_last_record_of_winners(spark):
    log = spark.createDataFrame([(1, 1, 7, "a"), (2, 2, 7, "b"), (3, 1, 8, "c")], "lsn int, txn int, slot int, op string")
    got = latest_per_slot(log, "slot", "lsn", "txn", [2])
    assert sorted((r.slot, r.op) for r in got.collect()) == [(7, "a"), (8, "c")]


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (3, 5), (6, 6), (None, 1)], "a int, b int")
    assert sorted(r[0] for r in on_cycle(edges, "a", "b").collect()) == [1, 2, 3, 6]
    assert on_cycle(edges.where("false"), "a", "b").count() == 0


def test_shared_locks_and_upgrade():
    m = LockManager()
    m.acquire(1, "r", SHARED)
    m.acquire(2, "r", SHARED)
    m.release_all(2)
    m.acquire(1, "r", EXCLUSIVE)
    m.acquire(1, "r", SHARED)
    assert m.holders("r") == {1: EXCLUSIVE}


def test_exclusive_waits():
    m, order = LockManager(), []
    m.acquire(1, "r", EXCLUSIVE)
    t = threading.Thread(target=lambda: (m.acquire(2, "r", EXCLUSIVE), order.append("second")))
    t.start()
    time.sleep(0.1)
    order.append("first")
    m.release_all(1)
    t.join(5)
    assert order == ["first", "second"]


def test_deadlock_has_a_victim():
    m, victims, ready = LockManager(), [], threading.Barrier(2)

    def work(txn, a, b):
        try:
            m.acquire(txn, a, EXCLUSIVE)
            ready.wait(5)
            m.acquire(txn, b, EXCLUSIVE)
        except DeadlockAbort as e:
            victims.append(str(e))
        finally:
            m.release_all(txn)

    threads = [threading.Thread(target=work, args=x) for x in ((1, "p", "q"), (2, "q", "p"))]
    [t.start() for t in threads]
    [t.join(10) for t in threads]
    assert len(victims) == 1 and "deadlock victim" in victims[0]
    with pytest.raises(DeadlockAbort):
        m.acquire(1, "r", SHARED), m.acquire(2, "r", SHARED), _both(m)


def _both(m):
    t = threading.Thread(target=lambda: m.acquire(1, "r", EXCLUSIVE))
    t.daemon = True
    t.start()
    time.sleep(0.2)
    m.acquire(2, "r", EXCLUSIVE)
