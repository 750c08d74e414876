"""Every query of the catalogue against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from siltstone.plans import catalogue

QUERIES, SQL = catalogue.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        files = glob.glob(f"{path}/*.parquet") if os.path.isdir(path) else [path]
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files})")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    asked = duck.sql(f'SELECT {", ".join(chr(34) + c + chr(34) for c in df.columns)} FROM ({SQL[name]})').fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(asked, key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_key_lines_refuse_what_the_checksum_lets_pass(spark, tmp_path):
    # changing the first digit of this user's identity leaves the four digits of the checksum as they are
    users = [3286, 104057, 7, None]
    spark.createDataFrame(list(enumerate(users)), "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    asked = duckdb.sql(f"SELECT event_id, line, ok, ok_spoilt FROM ({SQL['key_lines'].replace('FROM events', f"FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")})").fetchall()
    rows = QUERIES["key_lines"](spark, str(tmp_path)).collect()
    assert len(rows) == len(users) and sorted(map(tuple, rows)) == sorted(asked)
