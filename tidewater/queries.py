"""The engine's registered queries, each through ``Engine.sql``, with DuckDB SQL for the same rows.

All run over whole tables.  Those that write do so in a new database each time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ConflictError, EngineError
from .functions.visibility import Snapshot, latest_per_slot, visible
from .operators.graph import on_cycle
from .session import Engine
from .shared import shared_folder

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
Query = Callable[[SparkSession, str], DataFrame]

_READS = {
    "scan_full": "SELECT * FROM orders",
    "project_subset": "SELECT c_custkey, c_name FROM customer",
    "project_reorder": "SELECT c_name, c_custkey FROM customer",
    "filter_int_eq": "SELECT * FROM customer WHERE c_nationkey = 3",
    "filter_int_ne": "SELECT c_custkey FROM customer WHERE c_nationkey <> 3",
    "filter_int_lt": "SELECT p_partkey, p_size FROM part WHERE p_size < 10",
    "filter_int_le": "SELECT p_partkey, p_size FROM part WHERE p_size <= 10",
    "filter_int_gt": "SELECT p_partkey, p_size FROM part WHERE p_size > 40",
    "filter_int_ge": "SELECT p_partkey, p_size FROM part WHERE p_size >= 40",
    "filter_str_eq": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    "filter_str_range": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority >= '3-MEDIUM'",
    "filter_conjunction": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 500 AND o_orderpriority <> '5-LOW'",
    "filter_empty": "SELECT c_custkey FROM customer WHERE c_nationkey > 3 AND c_nationkey < 3",
    "pk_point_external": "SELECT * FROM orders WHERE o_orderkey = 1500",
    "join_inner": "SELECT orders.o_orderkey, customer.c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey",
    "join_on_reversed": "SELECT orders.o_orderkey, customer.c_name FROM orders JOIN customer ON customer.c_custkey = orders.o_custkey",
    "join_filter_left": "SELECT orders.o_orderkey, customer.c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE orders.o_orderstatus = 'F'",
    "join_filter_right": "SELECT orders.o_orderkey, customer.c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE customer.c_mktsegment = 'BUILDING'",
    "join_filter_both": "SELECT orders.o_orderkey, customer.c_name FROM orders JOIN customer ON orders.o_custkey = customer.c_custkey WHERE customer.c_nationkey = 3 AND orders.o_orderstatus = 'F'",
    "join_fact": "SELECT lineitem.l_orderkey, lineitem.l_linenumber, orders.o_custkey FROM lineitem JOIN orders ON lineitem.l_orderkey = orders.o_orderkey WHERE lineitem.l_returnflag = 'R'",
    "join_many_to_many": "SELECT supplier.s_suppkey, customer.c_custkey FROM supplier JOIN customer ON supplier.s_nationkey = customer.c_nationkey",
    "join_star": "SELECT * FROM nation JOIN region ON nation.n_regionkey = region.r_regionkey",
    "join_no_match": "SELECT nation.n_name, region.r_name FROM nation JOIN region ON nation.n_name = region.r_name",
}
#: Statements whose meaning differs from SQL's, with SQL that says what they mean.
_OWN = {
    "cmp_int_col_lt_str": ("SELECT c_custkey FROM customer WHERE c_custkey < 'abc'", "SELECT c_custkey FROM customer"),
    "cmp_int_col_eq_str": ("SELECT c_custkey FROM customer WHERE c_custkey = 'abc'", "SELECT c_custkey FROM customer WHERE FALSE"),
    "cmp_str_col_gt_int": ("SELECT c_name FROM customer WHERE c_name > 5", "SELECT c_name FROM customer"),
    "cmp_str_col_le_int": ("SELECT c_name FROM customer WHERE c_name <= 5", "SELECT c_name FROM customer WHERE FALSE"),
    "bareword_literal": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = F", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
}

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"


def engine(spark: SparkSession, sf_dir: str | None = None) -> Engine:
    """An engine on a new database, with the tables of a folder as external ones."""
    made = Engine(spark, f"{shared_folder(spark)}/db-{uuid.uuid4().hex}")
    for name in TABLES if sf_dir else ():
        made.register_parquet(name, f"{sf_dir}/{name}.parquet")
    return made


def _read(text: str) -> Query:
    return lambda spark, sf_dir: engine(spark, sf_dir).sql(text).df


def _loaded(spark: SparkSession, sf_dir: str, storage: str = "HEAP") -> Engine:
    """The whole orders table's native columns as ``native``."""
    e = engine(spark, sf_dir)
    e.load_table("native", e.sql(_ORDERS).df, "o_orderkey", storage)
    return e


def _native(text: str, *before: str, storage: str = "HEAP") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _loaded(spark, sf_dir, storage)
        for s in before:
            e.sql(s)
        return e.sql(text).df

    return run


def _text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    keys = e.sql("SELECT r_regionkey FROM region").df
    e.load_table("named", keys.select(F.col("r_regionkey").cast("string").alias("name"), F.col("r_regionkey").cast("long").alias("r_regionkey")))
    return e.sql("SELECT nation.n_nationkey, named.r_regionkey FROM nation JOIN named ON nation.n_nationkey = named.name").df


def _string_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.load_table("named", e.sql("SELECT c_name, c_mktsegment FROM customer").df)
    return e.sql("SELECT customer.c_custkey, named.c_mktsegment FROM customer JOIN named ON customer.c_name = named.c_name").df


def _insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation again, by literal INSERTs."""
    e = engine(spark, sf_dir)
    rows = e.sql("SELECT n_nationkey, n_name FROM nation").rows()
    e.sql("CREATE TABLE copy (n_nationkey INT, n_name VARCHAR, PRIMARY KEY (n_nationkey))")
    e.sql("INSERT INTO copy VALUES " + ", ".join(f"({k}, '{n}')" for k, n in rows))
    return e.sql("SELECT n_nationkey, n_name FROM copy").df


def _duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after an INSERT whose last row has a key that is there already."""
    e = _loaded(spark, sf_dir)
    try:
        e.sql("INSERT INTO native VALUES (-1, 1, 'N'), (100, 1, 'N')")
    except EngineError:
        return e.sql("SELECT o_orderkey FROM native").df
    raise AssertionError("a duplicate key was accepted")


def _delete_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _loaded(spark, sf_dir)
    e.sql("DELETE FROM native WHERE o_custkey < 500")
    return e.sql("SELECT o_orderkey, o_custkey FROM native").df


def _old_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An MVCC table in a transaction that began before another session deleted rows."""
    e = _loaded(spark, sf_dir, "MVCC")
    reader = e.session()
    reader.begin()
    e.sql("DELETE FROM native WHERE o_orderstatus = 'F'")
    return reader.execute("SELECT o_orderkey FROM native").df


def _own_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _loaded(spark, sf_dir, "MVCC")
    e.sql("BEGIN")
    e.sql("INSERT INTO native VALUES (-1, 1, 'N')")
    e.sql("DELETE FROM native WHERE o_orderstatus = 'F'")
    return e.sql("SELECT o_orderkey FROM native").df


def _aborted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _loaded(spark, sf_dir, "MVCC")
    other = e.session()
    other.begin()
    other.execute("DELETE FROM native WHERE o_orderstatus = 'F'")
    other.rollback()
    return e.sql("SELECT o_orderkey FROM native").df


def _reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database that is opened again after a crash within a transaction."""
    e = _loaded(spark, sf_dir)
    e.sql("DELETE FROM native WHERE o_orderstatus = 'F'")
    e.sql("BEGIN")
    e.sql("INSERT INTO native VALUES (-1, 1, 'N')")
    return Engine(spark, str(e.root)).sql("SELECT o_orderkey FROM native").df


def _checkpointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _loaded(spark, sf_dir)
    e.sql("DELETE FROM native WHERE o_orderstatus = 'F'")
    e.sql("INSERT INTO native VALUES (-1, 1, 'N')")
    e.checkpoint()
    return e.sql("SELECT o_orderkey FROM native").df


def _versions(snapshot: Snapshot) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
        xmin = 1 + F.col("o_orderkey") % 8
        xmax = F.when(F.col("o_orderkey") % 5 == 0, 2 + F.col("o_orderkey") % 8).otherwise(F.lit(0))
        return o.where(visible(xmin, xmax, snapshot))

    return run


def _versions_sql(xid: int, bound: int) -> str:
    done = lambda t: f"({t} = {xid} AND {xid} <> 0 OR {t} <> 0 AND {t} < {bound} AND {t} NOT IN (2, 3))"
    return f"""SELECT o_orderkey FROM (SELECT o_orderkey, 1 + o_orderkey % 8 AS xmin,
        CASE WHEN o_orderkey % 5 = 0 THEN 2 + o_orderkey % 8 ELSE 0 END AS xmax FROM orders) WHERE {done("xmin")} AND NOT {done("xmax")}"""


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("lsn"), (F.col("user_id") % 7).alias("txn"), F.col("user_id").alias("slot"), F.when(F.col("event_type").isin("error", "click"), "DELETE").otherwise("INSERT").alias("op")
    )
    return latest_per_slot(log, "slot", "lsn", "txn", [0, 3]).where("op = 'INSERT'").select("slot", "lsn")


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations wait for 7n + 1 mod 25, and suppliers, off any cycle, for their nation."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("a"), ((F.col("n_nationkey") * 7 + 1) % 25).cast("long").alias("b"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((1000 + F.col("s_suppkey")).alias("a"), F.col("s_nationkey").cast("long").alias("b"))
    return on_cycle(n.union(s), "a", "b")


def _committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What another session reads after BEGIN ... COMMIT."""
    e = _loaded(spark, sf_dir, "MVCC")
    for text in ("BEGIN", "INSERT INTO native VALUES (-1, 1, 'N')", "DELETE FROM native WHERE o_orderstatus = 'F'", "COMMIT"):
        e.sql(text)
    return e.session().execute("SELECT o_orderkey FROM native").df


def _conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after two transactions that delete rows in common: the second to commit is undone."""
    e = _loaded(spark, sf_dir, "MVCC")
    first, second = e.session(), e.session()
    first.begin(), second.begin()
    first.execute("DELETE FROM native WHERE o_custkey < 500")
    second.execute("DELETE FROM native WHERE o_orderstatus = 'F'")
    first.commit()
    try:
        second.commit()
    except ConflictError:
        return e.sql("SELECT o_orderkey FROM native").df
    raise AssertionError("a row was deleted twice")


def _explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPLAIN's own lines, without Spark's plan, whose numbering differs from run to run."""
    e = _loaded(spark, sf_dir)
    text = e.sql("EXPLAIN SELECT native.o_orderkey, customer.c_name FROM native JOIN customer ON native.o_custkey = customer.c_custkey WHERE o_orderkey = 1500 AND c_nationkey < 3").message
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.splitlines()[:4])], "line int, text string")


QUERIES: dict[str, Query] = {
    **{name: _read(text) for name, text in _READS.items()},
    **{name: _read(text) for name, (text, _) in _OWN.items()},
    "pk_point": _native("SELECT o_orderkey, o_custkey FROM native WHERE o_orderkey = 1500"),
    "pk_point_miss": _native("SELECT o_orderkey FROM native WHERE o_orderkey = -1"),
    "pk_range": _native("SELECT o_orderkey, o_custkey FROM native WHERE o_orderkey >= 100 AND o_orderkey < 200"),
    "join_text_key": _text_key,
    "join_string_key": _string_key,
    "insert_select": _insert_select,
    "pk_duplicate_rejected": _duplicate,
    "delete_survivors": _native("SELECT o_orderkey FROM native", "DELETE FROM native WHERE o_orderstatus = 'F' AND o_custkey < 500"),
    "delete_survivors_mvcc": _native("SELECT o_orderkey FROM native", "DELETE FROM native WHERE o_orderstatus = 'F' AND o_custkey < 500", storage="MVCC"),
    "delete_all": _native("SELECT o_orderkey FROM native", "DELETE FROM native"),
    "delete_anti": _delete_anti,
    "rollback_insert": _native("SELECT o_orderkey FROM native", "BEGIN", "INSERT INTO native VALUES (-1, 1, 'N')", "ROLLBACK"),
    "rollback_delete": _native("SELECT o_orderkey FROM native", "BEGIN", "DELETE FROM native", "ROLLBACK"),
    "mvcc_pinned_reader": _old_snapshot,
    "mvcc_own_writes": _own_writes,
    "mvcc_aborted_invisible": _aborted,
    "mvcc_snapshot_old": _versions(Snapshot(4, frozenset({2}), frozenset({3}), 4)),
    "mvcc_snapshot_new": _versions(Snapshot(0, frozenset({2}), frozenset({3}), 10**9)),
    "wal_replay": _replay,
    "commit_visible": _committed,
    "write_conflict": _conflict,
    "reopen_after_crash": _reopened,
    "checkpoint_rewrite": _checkpointed,
    "waits_for_cycle": _cycles,
    "list_tables": lambda spark, sf_dir: engine(spark, sf_dir).list_tables(),
    "explain_join": _explain,
}

_ALL = "SELECT o_orderkey FROM orders"
_KEPT = "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey < 500)"
_PLUS = "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT -1"

ORACLES: dict[str, str] = {
    **_READS,
    **{name: text for name, (_, text) in _OWN.items()},
    "pk_point": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 1500",
    "pk_point_miss": "SELECT o_orderkey FROM orders WHERE o_orderkey = -1",
    "pk_range": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200",
    "join_text_key": "SELECT n_nationkey, CAST(r_regionkey AS BIGINT) AS r_regionkey FROM nation JOIN region ON CAST(n_nationkey AS VARCHAR) = CAST(r_regionkey AS VARCHAR)",
    "join_string_key": "SELECT a.c_custkey, b.c_mktsegment FROM customer a JOIN customer b ON a.c_name = b.c_name",
    "insert_select": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation",
    "pk_duplicate_rejected": _ALL,
    "delete_survivors": _KEPT,
    "delete_survivors_mvcc": _KEPT,
    "delete_all": "SELECT o_orderkey FROM orders WHERE FALSE",
    "delete_anti": "SELECT o_orderkey, o_custkey FROM orders ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_custkey < 500) USING (o_orderkey)",
    "rollback_insert": _ALL,
    "rollback_delete": _ALL,
    "mvcc_pinned_reader": _ALL,
    "mvcc_own_writes": _PLUS,
    "mvcc_aborted_invisible": _ALL,
    "mvcc_snapshot_old": _versions_sql(4, 4),
    "mvcc_snapshot_new": _versions_sql(0, 10**9),
    "wal_replay": """SELECT slot, lsn FROM (SELECT user_id AS slot, event_id AS lsn, event_type,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE user_id % 7 NOT IN (0, 3)) WHERE r = 1 AND event_type NOT IN ('error', 'click')""",
    "commit_visible": _PLUS,
    "write_conflict": "SELECT o_orderkey FROM orders WHERE NOT o_custkey < 500",
    "explain_join": """WITH n AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM customer) AS c)
        SELECT 0 AS line, 'QUERY PLAN:' AS text
        UNION ALL SELECT 1, printf('  native: scan bounded by the primary key ''o_orderkey'' (cost %.2f < %.2f, ~1 rows)', log2(o + 1) + 1, ceil(o / 64)) FROM n
        UNION ALL SELECT 2, printf('  customer: scan of external Parquet (cost %.2f, ~%d rows)', ceil(c / 64), floor(c / 3)::BIGINT) FROM n
        UNION ALL SELECT 3, '  join: build on native (fewer rows, ~1)'""",
    "reopen_after_crash": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
    "checkpoint_rewrite": _PLUS,
    "waits_for_cycle": """WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS a, ((n_nationkey * 7 + 1) % 25)::BIGINT AS b FROM nation
        UNION ALL SELECT 1000 + s_suppkey, s_nationkey FROM supplier),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node FROM r WHERE a = b""",
    "list_tables": 'SELECT unnest(' + repr(sorted(TABLES)) + ') AS "table"',
}
