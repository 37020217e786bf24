"""Every registered query against its SQL twin on the smallest data; exact rows."""

import glob
import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import norm

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


#: the corpus operators are compared with brute force in tests/llm, and with their twins there
CORPUS = re.compile(r"op\d+_|pipeline$")


@pytest.mark.parametrize("name", [n for n in entry.queries() if not CORPUS.match(n)])
def test_matches_sql(spark, duck, name):
    assert name in ORACLES, "a query without a twin needs a test of its own"
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = Counter(tuple(norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert ours == theirs


#: what a query is about must happen in the given tables; a condition over the rows of its twin
DECISIVE = {
    "rank_group": "count(*) > 0",
    "rededup": "count_if(flip = 'demoted') > 0 and count_if(flip = 'promoted') > 0",
    "cross_source_match": "count(matched_id) > 0 and count_if(matched_id is null) > 0",
    "upsert_actions": "count(distinct action) = 4",
    "upsert_events": "count_if(status = 'duplicate' and duplicate_of is not null and first_seen_at = last_seen_at) > 0",
    "rescue": "count(distinct action) >= 2",
}


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", DECISIVE)
def test_decisive_branches_are_reached(folder, name):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    assert con.execute(f"select {DECISIVE[name]} from ({ORACLES[name]})").fetchone()[0]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
