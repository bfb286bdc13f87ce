"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strainlake.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 8) + 0.0
    return str(v)[:10]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=str)
    assert got == want


def test_rows_only_queries(spark):
    assert all(r.same for r in catalog.queries()["codec_round_trip"](spark, DIR).collect())
    scores = catalog.queries()["model_scores"](spark, DIR)
    assert scores.where("Probability < 0 or Probability > 1").count() == 0 and scores.count() > 0


@pytest.mark.parametrize("name", ["one_hot_sums", "one_hot_sums_whole"])
def test_one_hot_of_letters_whose_upper_case_is_longer(spark, tmp_path, name):
    texts = ["ß" * 64 + "acgtACGT" * 8 + "A", "ß" + "a" * 127 + "a", "ŉẚﬀΐ" * 20 + "GATTACAgattaca" * 200, "", None]
    pq.write_table(pa.table({"item_id": list(range(len(texts))), "text": texts}), tmp_path / "benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{tmp_path}/benchmark.parquet')")
    got = sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).select("item_id", "a", "known").collect()))
    assert got == sorted(con.execute(catalog.oracle_sql()[name]).fetchall())
