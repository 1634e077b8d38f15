"""Streaming forms give the batch results; the RPC front end answers; tables are escaped."""

import io
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import display
from tidemark.agent import server
from tidemark.agent.tools import TOOLS, call_tool
from tidemark.operators import bars, microstructure, stats
from tidemark.sources.tables import ticks
from tidemark.streaming import stateful as S

DATA = "/root/testdata/sf0.001"


def run(stream, name, tmp):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("ticks")
    t = ticks(spark, DATA).toPandas().sort_values(["ts", "seq"])
    for k in range(3):  # three files, three micro-batches, in time order
        spark.createDataFrame(t.iloc[k * len(t) // 3 : (k + 1) * len(t) // 3], "series_id string, ts timestamp_ntz, seq long, price double, volume double").coalesce(1).write.mode("append").parquet(str(out))
    schema = spark.read.parquet(str(out)).schema
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(out))


def _r(df):
    return df.select("series_id", "bucket", F.round("buy", 4).alias("buy"), F.round("vpin", 6).alias("vpin"))


def _signed(t):
    return t.select("series_id", "ts", "seq", F.when(F.col("seq") % 3 == 0, 0.0).otherwise(F.signum(F.col("price") - 100.0)).alias("position"))


def _held(df):
    return df.select("series_id", "ts", F.round("holding_days", 8).alias("holding_days"))


CASES = {
    "rule": (lambda s: S.stream_tick_rule(s), lambda t: microstructure.tick_rule(t), ["series_id", "seq", "sign"]),
    "cusum": (lambda s: S.stream_cusum(s, 300.0), lambda t: bars.cusum_filter(t, 300.0), ["series_id", "seq", "side"]),
    "volume": (lambda s: S.stream_volume_bars(s, 500.0), lambda t: bars.volume_bars(t, 500.0), ["series_id", "bar_id", "close", "ticks"]),
    "imbalance": (lambda s: S.stream_imbalance_bars(s, "volume", 20), lambda t: bars.imbalance_bars(t, "volume", init_T=20), ["series_id", "bar_id", "close", "ticks"]),
    "vpin": (lambda s: _r(S.stream_vpin(s, 500.0, 3)), lambda t: _r(microstructure.vpin(t, 500.0, 3)), ["series_id", "bucket", "buy", "vpin"]),
    "holding": (lambda s: _held(S.stream_holding_period(_signed(s))), lambda t: stats.holding_period(_signed(t)).select("series_id", F.round("holding_days", 8).alias("holding_days")), ["series_id", "holding_days"]),
    "runs": (lambda s: S.stream_run_bars(s, "tick", 20), lambda t: bars.run_bars(t, "tick", init_T=20), ["series_id", "bar_id", "close", "ticks"]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_stream_is_batch(spark, source, tmp_path, name):
    stream, batch, columns = CASES[name]
    run(stream(source()), name, tmp_path)
    found = spark.table(name)
    if name == "holding":  # the last row of each series is its average so far
        found = found.groupBy("series_id").agg(F.max_by("holding_days", "ts").alias("holding_days"))
    got = found.select(columns).toPandas().sort_values(columns).reset_index(drop=True)
    want = batch(ticks(spark, DATA)).select(columns).toPandas().sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_stream_time_bars_hold_back_the_open_bar(spark, source, tmp_path):
    run(S.stream_time_bars(source(), "1 hour", "0 seconds"), "timed", tmp_path)
    got, want = spark.table("timed"), bars.time_bars(ticks(spark, DATA), "1 hour")
    assert 0 < got.count() <= want.count()
    assert got.select("series_id", "close", "ticks").exceptAll(want.select("series_id", "close", "ticks")).count() == 0


ARGUMENTS = {
    "sharpe_ratio": {"returns": [0.01, -0.02, 0.03]}, "probabilistic_sharpe_ratio": {"sr_hat": 0.1, "sr_benchmark": 0.0, "n_obs": 100}, "deflated_sharpe_ratio": {"sr_hat": 0.1, "n_trials": 5, "var_sr": 0.01, "n_obs": 100}, "min_track_record_length": {"sr_hat": 0.2, "sr_benchmark": 0.0},
    "probability_of_backtest_overfitting": {"performance": [[(-1) ** t * 0.01 + k * t * 1e-4 for k in range(3)] for t in range(16)]}, "binomial_sharpe": {"p": 0.55, "freq": 52}, "implied_precision": {"sl": -1, "pt": 1, "freq": 52, "target_sharpe": 1}, "implied_frequency": {"sl": -1, "pt": 1, "p": 0.6, "target_sharpe": 1},
    "probability_of_failure": {"returns": [0.02, -0.01, 0.03, -0.02, 0.01], "freq": 52, "target_sharpe": 1}, "frac_diff_ffd": {"values": [1, 2, 4, 8], "d": 1}, "cusum_filter": {"values": [0, 1, 3, 5], "threshold": 2}, "sadf": {"values": [(k * 7919) % 13 + k * 0.1 for k in range(30)], "min_length": 12},
    "kontoyiannis_entropy": {"message": "0110100110"}, "plug_in_entropy": {"message": "0101"}, "hrp_weights": {"cov": [[1, 0.5], [0.5, 2]]}, "onc_clusters": {"corr": [[1, 0.9, 0.1], [0.9, 1, 0.1], [0.1, 0.1, 1]]}, "bet_size_from_probability": {"prob": 0.7}, "cpcv_split_summary": {"n_samples": 30, "n_groups": 5, "n_test_groups": 2, "horizon": 2},
}


@pytest.mark.parametrize("name", sorted(TOOLS))
def test_tools(spark, name):
    assert set(TOOLS) == set(ARGUMENTS)
    assert "result" in call_tool(spark, name, ARGUMENTS[name])
    assert "error" in call_tool(spark, name, ARGUMENTS[name] | {"zzz": 1})


def test_server_lines(spark):
    lines = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "plug_in_entropy", "arguments": {"message": "01"}}}, {"jsonrpc": "2.0", "id": 4, "method": "nope"}, []]
    out = io.StringIO()
    server.main(io.StringIO("\n".join(map(json.dumps, lines)) + "\nnot json\n"), out, spark)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g.get("id") for g in got] == [1, 2, 3, 4, None, None]
    assert json.loads(got[2]["result"]["content"][0]["text"]) == {"result": 1.0} and got[3]["error"]["code"] == -32601


def test_tables_are_escaped():
    assert "&lt;b&gt;" in display.html_table("<b>", [("x", 1.0)]) and display.format_value(float("nan")) == "-"
