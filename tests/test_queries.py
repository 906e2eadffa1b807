"""Every query with SQL gives DuckDB's rows on the small tables; the others run."""

import math
import os

import duckdb
import numpy as np
import pytest
from vecloom.plans import QUERIES, SQL

FOLDER = os.environ.get("VECLOOM_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the small tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _key(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(columns, want.fetchall())


#: Queries that cluster every row, without SQL; they run on a planted table, as training takes long on a larger one.
CLUSTERED = sorted(
    "c8_spectral c10_spectral_knn d8_diffused_clusters h1_trained_heads h1_two_layer_heads h2_aligned_heads h2_weighed_heads h3_fused_heads h4_scan_heads h4_trained_linear_head h5_semantic_clusters "
    "h6_taught_head h6_taught_heads h7_rate_reduction_clusters h8_self_expression_clusters h9_aligned_heads i6_interactive_clusters r4_subspace_clusters_omp r5_subspace_clusters_elastic".split()
)
#: Of these, those that must find the planted clusters at their default settings.
FOUND = ("c8_spectral", "c10_spectral_knn", "h7_rate_reduction_clusters", "r5_subspace_clusters_elastic")


@pytest.fixture(scope="module")
def planted_folder(spark, tmp_path_factory):
    """``embeddings`` of 100 rows around ten directions."""
    rng = np.random.default_rng(6)
    label = np.repeat(np.arange(10), 10)
    x = np.eye(64)[label * 3] + 0.05 * rng.normal(size=(100, 64))
    path = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", CLUSTERED)
def test_clusters_every_row(spark, planted_folder, name):
    rows = QUERIES[name](spark, planted_folder).collect()
    heads = {r["head"] if "head" in r else "main" for r in map(lambda r: r.asDict(), rows)}
    ids = sorted(r.id for r in rows)
    assert ids == sorted(list(range(100)) * len(heads)) and "main" in heads and len({r.cluster for r in rows}) > 1
    if name in FOUND:
        of = {}
        for r in rows:
            of.setdefault(r.cluster, []).append(r.id // 10)
        assert sum(max(map(c.count, set(c))) for c in of.values()) > 90


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - set(CLUSTERED)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
