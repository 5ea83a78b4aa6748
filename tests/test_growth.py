"""Results and work that must not hang on the order, the copies or the number of rows."""

import datetime as dt
import os
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.functions.pricing import settlement_kelly
from touchline.operators import enrich as E
from touchline.operators import joins as J
from touchline.operators.models import boosted_outcomes
from touchline.plans import feeds
from touchline.registry import QUERIES
from touchline.streaming.settlement import Settling


def test_a_days_exposure_beside_a_tie_is_one_number_however_rows_come(spark, tmp_path):
    last = F.max("l_shipdate").over(Window.partitionBy("l_orderkey", "l_linenumber"))
    rows = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").withColumn("last", last).where("CAST(last AS DATE) = DATE'1996-04-25'").drop("last")
    copies = rows.crossJoin(spark.range(60).withColumnRenamed("id", "k"))
    shifted = copies.withColumns({"l_orderkey": F.col("l_orderkey") + F.col("k") * 1_000_003, "l_shipdate": F.col("l_shipdate") + F.make_dt_interval(days=F.col("k").cast("int"))})
    shifted.drop("k").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["exposure_by_day"](spark, str(tmp_path)).collect()
    assert len(got) == 60 and {(r.n, r.asked, r.granted) for r in got} == {(17, 0.090062, 0.05)}


def test_many_rows_of_a_day_are_reduced_before_they_meet(spark):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("id", F.lit(3)).cast("int"))
    rows = spark.range(3000).select(F.col("id").alias("match_id"), (F.col("id") % 2).alias("home"), day.alias("match_date"))
    bets = rows.select(F.col("match_id").alias("bet_id"), "home", F.col("match_date").alias("day"))
    found = J.nearest_day(bets, rows, ["home"], "day", "match_date", 1, "bet_id", [F.col("match_id") % 3 == 1, F.abs(F.date_diff("match_date", "day")), F.col("match_id")])
    got = {r.bet_id: r.match_id for r in found.collect()}
    first = {(h, d): min((m for m in range(3000) if m % 2 == h and abs(m % 3 - d) <= 1), key=lambda m: (m % 3 == 1, abs(m % 3 - d), m)) for h in (0, 1) for d in (0, 1, 2)}
    assert got == {m: first[m % 2, m % 3] for m in range(3000)}
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()  # no row number over met pairs


def test_kelly_over_batches_has_the_slopes_root_and_no_higher_order_steps(spark):
    rows = spark.createDataFrame([(0.5, 0.1, 0.1, 0.3, 2.4), (0.2, 0.1, 0.1, 0.6, 2.0), (0.5, 0.0, 0.0, 0.5, None), (None, 0.1, 0.1, 0.3, 2.4), (0.9, 0.0, 0.0, 0.1, 1.5)], "w double, hw double, hl double, lo double, o double")
    asked = rows.select(settlement_kelly(*(F.col(c) for c in ("w", "hw", "hl", "lo", "o"))).alias("f"))
    assert "aggregate(" not in asked._jdf.queryExecution().executedPlan().toString()
    got = [r.f for r in asked.collect()]
    assert got[1:4] == [0.0, None, 0.0] and abs(got[4] - (0.9 * 1.5 - 1) / 0.5) < 1e-9
    f = got[0]
    assert abs(0.5 * 1.4 / (1 + f * 1.4) + 0.1 * 0.7 / (1 + f * 0.7) - 0.1 * 0.5 / (1 - f * 0.5) - 0.3 / (1 - f)) < 1e-9


def test_a_key_settles_many_waiting_bets_as_columns_with_one_timer_at_a_time():
    held, timers = {}, []
    state = SimpleNamespace(get=lambda: held.get("v"), update=lambda v: held.__setitem__("v", v))
    settling = Settling(0, 1000)
    settling.init(SimpleNamespace(getValueState=lambda *_: state, registerTimer=timers.append))
    n = 20_000
    bets = pd.DataFrame({"kind": "bet", "bet_id": range(n), "match_id": [i // 4 for i in range(n)], "known": 0, "kickoff": range(n), "market": "1X2", "selection": "H", "line": None, "odds": 2.0, "stake": 1.0, "status": None, "fthg": None, "ftag": None, "hc": None, "ac": None, "prices": None})
    results = bets.loc[: n // 8 - 1].assign(kind="result", match_id=range(n // 8), known=5, status="FT", fthg=1.0, ftag=0.0)
    (early,) = settling.handleInputRows(("k",), iter([bets, results]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 100))
    ready = (bets.match_id < n // 8) & (bets.kickoff <= 100)
    assert set(early.bet_id) == set(bets.bet_id[ready]) and timers == [101]
    (rest,) = settling.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**6), None)
    assert len(early) + len(rest) == n and timers == [101] and held["v"][0] is None
    assert (rest.status == "VOID").sum() == n - n // 2


def test_many_feed_files_are_written_by_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "EVENTS_A_FILE", 10)
    folder = feeds._feed_folder(spark, "/root/testdata/sf0.001").removeprefix("file:").replace("//", "/")
    names = [n for n in os.listdir(folder) if n.startswith("part-")]
    assert len(names) > 100 and len({n[:10] for n in names}) <= 4 + 1  # a task's number leads its files' names
    assert QUERIES["feed_results"](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_orderkey % 5 <> 0").count()


def test_days_are_enriched_once_and_repeated_bets_keep_their_own_sides(spark):
    day = dt.date(2024, 1, 10)
    frame = spark.createDataFrame([(i, day - dt.timedelta(1 + i // 100), "a", "b", float(i % 100), None) for i in range(300)], "match_id long, match_date date, home string, away string, xh double, xa double")
    bets = spark.createDataFrame([(1, "a", "b", day), (1, "b", "a", day), (2, "c", "a", day)], "bet_id long, home string, away string, day date")
    rows = E.enriched(bets, E.team_history(frame, F.col("xh"), F.col("xa")))
    assert "WindowGroupLimit" in rows._jdf.queryExecution().executedPlan().toString()  # a day's last measured matches only are dealt by team
    got = {(r.bet_id, r.home): (r.home_matches_in_lookback, r.home_rolling_xg, r.away_rolling_xg, r.home_rest_days) for r in rows.collect()}
    assert got == {(1, "a"): (300, 97.0, None, 1), (1, "b"): (300, None, 97.0, 1), (2, "c"): (0, None, 97.0, None)}


def test_boosted_trees_read_their_rows_and_run_no_window_again(spark):
    rows = spark.range(600).select(F.col("id").alias("match_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("match_date"), F.element_at(F.array(*map(F.lit, "HDA")), (F.col("id") % 3 + 1).cast("int")).alias("ftr"))
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(len(b))
            yield b.assign(a=b["match_id"] % 7.0)

    fed = rows.mapInPandas(counted, "match_id long, match_date date, ftr string, a double")
    boosted_outcomes(fed, ["a"], trees=1)
    assert runs.value == 600
