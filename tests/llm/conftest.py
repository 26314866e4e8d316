import re
from types import SimpleNamespace

import duckdb
import pytest

FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate(FOLD))


DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, keep string, group_id string, node int"


@pytest.fixture(scope="session")
def mini(spark, tmp_path_factory):
    """The smallest documents with odd rows and clashing columns added, as a folder of tables."""
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()
    long = " ".join(f"word{i * i % 977}" for i in range(30_000))
    odd = [None, "", " ", "...", "one", "Ünï ▁ ① 🙂", "a\0b \n\n  c", long, "same same same " * 40]
    docs += [(100_000 + i, t) for i, t in enumerate(odd)]
    docs += [(None, "a text without an id " * 12), (None, None), docs[3], docs[3], docs[5]]
    folder = tmp_path_factory.mktemp("mini")
    rows = [(d, t, None if i % 5 == 0 else "en", "s", None if t is None else len(t), 0.5, "x", None, i) for i, (d, t) in enumerate(docs)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{DATA}/labels.parquet' ORDER BY doc_id").fetchall()
    labels += [(None, 1, 1), (labels[0][0], 1, None), (labels[1][0], 0, labels[1][2]), (999_999, 1, 1), (100_000, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return SimpleNamespace(dir=str(folder), docs=docs, labels=labels, unique={d: t for d, t in docs if d is not None}, df=lambda s: s.read.parquet(f"{folder}/documents.parquet"), lab=lambda s: s.read.parquet(f"{folder}/labels.parquet"))
