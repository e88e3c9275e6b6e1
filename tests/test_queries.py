"""Every registered query of the time-series operators against its SQL, and the driver's contract."""

import datetime
import math
import subprocess
import sys

import duckdb
import pytest

from tidemark.plans import state_queries as P

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", [*P.QUERIES])
def test_query(spark, sf, duck, name):
    df = P.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = [tuple(plain(x) for x in r) for r in df.select(*names).collect()]
    assert got
    if name not in P.SQL:
        return
    result = duck.execute(P.SQL[name])
    assert sorted(d[0] for d in result.description) == names
    at = [[d[0] for d in result.description].index(n) for n in names]
    want = [tuple(plain(r[i]) for i in at) for r in result.fetchall()]
    whole = [i for i in range(len(names)) if not any(isinstance(r[i], float) for r in got + want)]
    key = lambda r: tuple(str(r[i]) for i in [*whole, *(i for i in range(len(r)) if i not in whole)])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 1.1e-6 * max(1, abs(x))) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", ["buffer_resumed", "zmooth_resumed"])
def test_resumed_where_states_turn_out_small(spark, sf, tmp_path, name):
    """The join with the states is planned as a shuffle and becomes a broadcast as it runs, over rows of several tasks."""
    folder, want = str(tmp_path), duckdb.connect()
    rows = spark.read.parquet(f"{sf}/events.parquet")
    rows.repartition(8).write.parquet(f"{folder}/events.parquet")
    want.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    settings = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "10m", "adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in settings.items():
            spark.conf.set(f"spark.sql.{k}", v)
        got = {r["event_id"]: r["out"] for r in P.QUERIES[name](spark, folder).select("event_id", "out").collect()}
    finally:
        for k in settings:
            spark.conf.unset(f"spark.sql.{k}")
    assert got == pytest.approx(dict(want.execute(f"SELECT event_id, out FROM ({P.SQL[name]})").fetchall()), abs=1.1e-6)


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=__file__.rsplit("/tests/", 1)[0])


def test_entry_without_the_training_data_queries():
    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; assert 'ewma' in e.queries() and not any(q.startswith('op1_') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=__file__.rsplit("/tests/", 1)[0])
