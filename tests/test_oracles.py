"""Every query with SQL against DuckDB on the small tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v if math.isinf(v) else float(f"{v:.7g}") + 0.0
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    want = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    if got != want:
        key = [k for k in range(len(names)) if not any(isinstance(r[k], float) for r in want)]
        got.sort(key=lambda r: str([r[k] for k in key]))
        want.sort(key=lambda r: str([r[k] for k in key]))
        assert all(close(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


#: Ticks of price 0 of series of 200 ticks, bars of 20: in a bar, as closes, as whole bars, everywhere; and series of one return. Beside them: no move, a negative close.
ZEROS = {"none": (200, ()), "inside": (200, (30,)), "close": (200, (99,)), "closes": (200, (99, 119)), "first": (200, (19,)), "last": (200, (199,)), "bar": (200, range(80, 100)), "bars": (200, range(80, 140)), "all": (200, range(200)), "one": (45, ()), "one zero": (45, (39,))}


def zero_prices(folder):
    """An events table with ticks of price 0."""
    rows = [(name, k, 0.0 if k in zeros else (k * k * 7919 + 31 * k) % 4999 / 100 + 0.01) for name, (n, zeros) in ZEROS.items() for k in range(n)]
    rows += [("flat", k, 5.0) for k in range(200)] + [("below", k, -1.0 if k == 99 else k % 17 + 1.0) for k in range(200)]
    con = duckdb.connect()
    con.execute("create table t (event_type varchar, k bigint, value double)")
    con.executemany("insert into t values (?, ?, ?)", rows)
    con.sql(f"copy (select row_number() over (order by event_type, k) as event_id, timestamp '2024-01-01' + to_seconds(k) as ts, k % 7 as user_id, event_type, value, '' as props from t) to '{folder}/events.parquet' (format parquet)")
    con.sql(f"create view events as select * from '{folder}/events.parquet'")
    return con


def same_with_nan(spark, folder, name):
    """As SQL has it, NaN told from NULL."""
    con = zero_prices(folder)
    df, rel = QUERIES[name](spark, str(folder)), con.sql(SQL[name])
    assert df.columns == rel.columns
    got, want = ({r[0]: tuple(r)[1:] for r in rows} for rows in (df.collect(), rel.fetchall()))
    assert got.keys() == want.keys()
    for series, row in want.items():
        assert got[series] == pytest.approx(row, rel=1e-9, abs=1e-10, nan_ok=True), series
    return got


def test_amihud_keeps_closes_of_zero(spark, tmp_path):
    got = same_with_nan(spark, tmp_path, "amihud_illiquidity")
    assert got["close"] == (math.inf, math.inf) and got["bar"][1] == math.inf and math.isnan(got["bar"][0]) and math.isnan(got["closes"][0]) and math.isnan(got["all"][0])
    assert math.isfinite(got["inside"][0]) and math.isnan(got["below"][0])


def test_hasbrouck_keeps_closes_of_zero(spark, tmp_path):
    got = same_with_nan(spark, tmp_path, "hasbrouck_lambda")
    assert got["close"][2] == 9 and not math.isfinite(got["close"][0]) and math.isnan(got["all"][0])
    assert got["flat"][0] == 0 and math.isnan(got["flat"][1]) and abs(got["first"][0]) == math.inf and math.isfinite(got["inside"][1]) and math.isnan(got["below"][0])
