"""The registered queries over the smallest tables: one row a document, the columns of their contracts, and DuckDB's rows where there is SQL."""

import os

import duckdb
import pytest
from vecloom.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the small tables")
COLUMNS = {
    "op1": ["doc_id", "held_out", "lang_pred", "score"],
    "op3": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op9": ["doc_id", "fingerprint", "component_id"],
    "op10": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op11": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op13": ["doc_id", "start", "n_tokens", "ids_crc32"],
}


@pytest.mark.parametrize("name", sorted(set(QUERIES)))
def test_query(spark, name):
    got = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in got.collect()]
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect())
    number = name.split("_")[0]
    assert set(COLUMNS.get(number, [])) <= set(got.columns)
    if number not in ("op4", "op6", "op12"):
        assert sorted(r[got.columns.index("doc_id")] for r in rows) == ids
    if name in SQL:
        con = duckdb.connect()
        for t in ("documents", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        want = con.execute(SQL[name])
        names = [c[0] for c in want.description]
        order = [got.columns.index(c) for c in names]
        assert sorted((tuple(r[i] for i in order) for r in rows), key=repr) == sorted(want.fetchall(), key=repr)
