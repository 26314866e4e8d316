"""Which row versions a transaction's snapshot sees, as columns and as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIVE, COMMITTED, ABORTED = "ACTIVE", "COMMITTED", "ABORTED"


@dataclass(frozen=True)
class Snapshot:
    """``xid`` 0 is a reader without a transaction; ``next`` is the first id that came too late, None for no bound."""

    xid: int
    active: frozenset[int] = frozenset()
    aborted: frozenset[int] = frozenset()
    next: int | None = None

    def committed(self, t: int) -> bool:
        if t == 0:
            return False
        if self.xid and t == self.xid:
            return True
        return (self.next is None or t < self.next) and t not in self.active and t not in self.aborted

    def sees(self, xmin: int, xmax: int) -> bool:
        return self.committed(xmin) and not self.committed(xmax)


def committed(t: Column, s: Snapshot) -> Column:
    done = t != 0
    if s.next is not None:
        done = done & (t < s.next)
    hidden = sorted(s.active | s.aborted)
    if hidden:
        done = done & ~t.isin(hidden)
    return (t == s.xid) | done if s.xid else done


def visible(xmin: Column, xmax: Column, s: Snapshot) -> Column:
    """True where a version with these header columns is in the snapshot; no shuffle, no UDF."""
    return committed(xmin, s) & ~committed(xmax, s)


def latest_per_slot(log, slot: str, lsn: str, txn: str, losers: list[int]):
    """The last record of each slot in a log without the losers' records: one shuffle on the slot."""
    last = log.where(~F.col(txn).isin(losers)) if losers else log
    return last.groupBy(slot).agg(F.max_by(F.struct(*last.columns), lsn).alias("r")).select("r.*")


@dataclass
class Transactions:
    """Ids, states and begin-time snapshots."""

    next_id: int = 1
    states: dict[int, str] = field(default_factory=dict)
    snapshots: dict[int, Snapshot] = field(default_factory=dict)

    def begin(self) -> int:
        t, self.next_id = self.next_id, self.next_id + 1
        self.snapshots[t] = Snapshot(t, self._all(ACTIVE), self._all(ABORTED), t)
        self.states[t] = ACTIVE
        return t

    def commit(self, t: int) -> None:
        self.states[t] = COMMITTED

    def abort(self, t: int) -> None:
        self.states[t] = ABORTED

    def state(self, t: int) -> str:
        return self.states.get(t, COMMITTED)

    def snapshot(self, t: int) -> Snapshot:
        """The transaction's begin-time snapshot, however often it is asked for."""
        return self.snapshots[t]

    def reader(self) -> Snapshot:
        return Snapshot(0, self._all(ACTIVE), self._all(ABORTED))

    def _all(self, state: str) -> frozenset[int]:
        return frozenset(t for t, s in self.states.items() if s == state)
