"""Bets settled by a stream of results that may come before them, with them or long after.

Bets, results and closing quotes are one stream, keyed by a hash of the match; a match with very many bets is dealt over slots,
each of which gets its results and quotes.  State of a key: the bets still open, the newest usable result and the nearest closing
quote of each match.  A bet settles once its result is known and ``grace`` has passed since kick-off, whichever comes last; a void
match settles from kick-off on; with ``patience``, a bet without a result is void so long after kick-off.  Timers in event time
wake a key for the last two; ``settled_at`` follows from the rows alone, not from how they came in batches.

Rows carry no event time of their own into the operator, so none is ever late: a copy of each row without its content moves the
clock and goes no further.  A key's rows are settled as whole columns, so ``buckets`` should leave a key some thousands of matches;
it is fixed for a stream's life.  Only pairing is done in Python; settlement, profit and closing-line value are Column expressions over the pairs.

Defined results: results that are not final, or final without scores, wait for a better one, as do bets on corners for corner
counts; of several results of a match the newest known counts; an open bet that is sent again counts once; bets without a
stake or a price above one never settle and are left out; a result that becomes known after ``patience`` finds the bet void.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import pricing as P

#: States of a match that is over, and of one whose bets are void.
FINISHED = ("FINISHED", "FT", "FULL_TIME", "COMPLETE", "COMPLETED", "SETTLED", "CLOSED")
VOIDED = ("POSTPONED", "PST", "ABANDONED", "ABD", "CANCELLED", "CANCELED", "CANC", "VOID")
#: Labels of settled bets by rank, worst first.
LABELS = ("LOST", "HALF_LOSS", "VOID", "HALF_WIN", "WON")
CORNERS = "CORNERS"
BUCKETS, SLOTS = 32, 2
LATENESS = "1 hour"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_BET = {"bet_id": "int64", "match_id": "int64", "placed": "int64", "kickoff": "int64", "market": "object", "selection": "object", "line": "float64", "odds": "float64", "stake": "float64"}
_RESULT = {"match_id": "int64", "known": "int64", "status": "object", "fthg": "float64", "ftag": "float64", "hc": "float64", "ac": "float64"}
_QUOTE = {"match_id": "int64", "market": "object", "line": "float64", "apart": "int64", "known": "int64", "prices": "object"}
PAIRED = "bet_id long, match_id long, market string, selection string, line double, odds double, stake double, status string, fthg long, ftag long, hc long, ac long, settled_ms long, closing string"
_FIELDS = {"kind": "string", "bet_id": "long", "match_id": "long", "known": "long", "kickoff": "long", "market": "string", "selection": "string", "line": "double", "odds": "double", "stake": "double", "status": "string", "fthg": "long", "ftag": "long", "hc": "long", "ac": "long", "prices": "string"}


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes | None, kinds: dict[str, str]) -> pd.DataFrame:
    rows = pd.DataFrame(columns=list(kinds)) if held is None else pa.ipc.open_stream(held).read_pandas()
    return rows.astype(kinds)


def _joined(old: pd.DataFrame, new: pd.DataFrame, kinds: dict[str, str]) -> pd.DataFrame:
    new = new[list(kinds)].astype(kinds)
    return new.reset_index(drop=True) if old.empty else pd.concat([old, new], ignore_index=True)


class Settling(StatefulProcessor):
    """Pairs of bets with what settles them, for the matches of one key; its tables are held as Arrow bytes and treated as columns."""

    def __init__(self, grace_ms: int, patience_ms: int | None):
        self.grace, self.patience = grace_ms, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "open binary, results binary, quotes binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield self._settle(pd.concat(list(rows), ignore_index=True), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settle(None, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _learnt(self, rows: pd.DataFrame, bets: pd.DataFrame, results: pd.DataFrame, quotes: pd.DataFrame) -> tuple[pd.DataFrame, ...]:
        new = rows[rows["kind"] == "result"]
        if len(new):
            new = new.assign(status=new["status"].fillna("").astype(str).str.upper())
            new = new[new["status"].isin(VOIDED) | (new["status"].isin(FINISHED) & new["fthg"].notna() & new["ftag"].notna())]
            results = _joined(results, new, _RESULT)
            tied = results.duplicated(["match_id", "known"], keep=False)
            results["tie"] = ""
            if tied.any():
                whole = lambda v: None if pd.isna(v) else int(v)
                results.loc[tied, "tie"] = [repr((r[2], *map(whole, r[3:7]))) for r in results[tied].itertuples(index=False)]
            results = results.sort_values(["match_id", "known", "tie"]).drop_duplicates("match_id", keep="last")[list(_RESULT)]
        new = rows[rows["kind"] == "quote"]
        if len(new):
            quotes = _joined(quotes, new.assign(apart=(new["known"] - new["kickoff"]).abs()), _QUOTE)
            quotes = quotes.sort_values(["apart", "known"], ascending=[True, False], kind="stable").drop_duplicates(["match_id", "market", "line"])
        new = rows[rows["kind"] == "bet"]
        if len(new):
            bets = _joined(bets, new.assign(placed=new["known"]), _BET).drop_duplicates("bet_id")
        return bets, results, quotes

    def _settle(self, rows: pd.DataFrame | None, watermark: int) -> pd.DataFrame:
        held = self.held.get() or (None, None, None)
        bets, results, quotes = (_unpacked(x, kinds) for x, kinds in zip(held, (_BET, _RESULT, _QUOTE)))
        if rows is not None:
            bets, results, quotes = self._learnt(rows, bets, results, quotes)
        met = bets.merge(results, "left", "match_id")
        void = met["status"].isin(VOIDED)
        # final, but without the counts that a bet on corners needs: as if there were none yet
        there = met["status"].notna() & ~((met["market"] == CORNERS) & ~void & (met["hc"].isna() | met["ac"].isna()))
        ready = met["kickoff"] + np.where(void, 0, self.grace)
        known = met["known"].where(there, 0).astype("int64")
        now = np.maximum(np.maximum(known, met["placed"]), watermark)
        if self.patience is None:
            done = there & (now >= ready)
            asleep = there & ~done
        else:
            due = met["kickoff"] + self.patience
            over = there & (known > due)
            ready, known = ready.where(there, due).where(~over, met["kickoff"]), known.where(there & ~over, due)
            done = (np.maximum(np.maximum(known.where(there, watermark), met["placed"].where(there, watermark)), watermark)) >= ready
            void |= over | ~there
            met.loc[over | ~there, ["fthg", "ftag", "hc", "ac"]] = np.nan
            asleep = ~done
        if asleep.any():  # one timer is enough: it settles all that is ready by then and sets the next one
            self.handle.registerTimer(int(ready[asleep].min()))
        if rows is not None or done.any():
            left = bets[~bets["bet_id"].isin(met.loc[done, "bet_id"])] if done.any() else bets
            self.held.update((_packed(left) if len(left) else None, held[1] if rows is None else _packed(results), held[2] if rows is None else _packed(quotes)))
        met = met.assign(settled_ms=np.maximum(np.maximum(ready, known), met["placed"]), status=np.where(void, "VOID", "FINISHED"))[done]
        met = met.merge(quotes[["match_id", "market", "line", "prices"]], "left", ["match_id", "market", "line"]).rename(columns={"prices": "closing"})
        return met[[c.split()[0] for c in PAIRED.split(", ")]].astype({c: "Int64" for c in ("fthg", "ftag", "hc", "ac")})


def _events(rows: DataFrame, kind: str, known: str, slots: int | None) -> DataFrame:
    """Rows as events: with content for their key, and without any to move the clock."""
    have = {c: F.col(c) for c in rows.columns} | {"kind": F.lit(kind), "known": F.unix_millis(known)}
    if "kickoff" in rows.columns:
        have["kickoff"] = F.unix_millis("kickoff")
    cols = [have.get(c, F.lit(None)).cast(t).alias(c) for c, t in _FIELDS.items()]
    slot = F.pmod(F.xxhash64("bet_id"), F.lit(slots)).cast("int") if kind == "bet" else F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    return rows.select(*cols, slot.alias("slot"), F.col(known).alias("clock"))


def paired(bets: DataFrame, results: DataFrame, quotes: DataFrame | None = None, grace: str = "2 hours", patience: str | None = None, buckets: int = BUCKETS, slots: int = SLOTS) -> DataFrame:
    """Streams of bets (bet_id, match_id, placed_at, kickoff, market, selection, line, odds, stake), results (match_id, known_at,
    status, fthg, ftag, hc, ac) and closing quotes (match_id, observed_at, kickoff, market, line, prices) as settled pairs."""
    sound = bets.where(P.valid_price(F.col("odds")) & (F.col("stake") > 0))
    events = _events(sound, "bet", "placed_at", slots).unionByName(_events(results, "result", "known_at", slots))
    if quotes is not None:
        events = events.unionByName(_events(quotes.withColumn("prices", F.to_json("prices")), "quote", "observed_at", slots))
    empty = [F.lit("clock").alias("kind") if c == "kind" else F.lit(None).cast(t).alias(c) for c, t in _FIELDS.items() if c != "match_id"]
    both = F.explode(F.array(F.struct(*(F.col(c) for c in _FIELDS if c != "match_id"), F.lit(None).cast("timestamp").alias("at")), F.struct(*empty, F.col("clock").alias("at"))))
    timed = events.select("match_id", "slot", both.alias("e")).select("match_id", "slot", "e.*").withWatermark("at", LATENESS)
    timed = timed.where("at IS NULL")  # the copies have moved the clock and need not be dealt
    keyed = timed.withColumn("bucket", F.pmod(F.xxhash64("match_id"), F.lit(buckets)).cast("int"))
    ms = lambda span: None if span is None else int(pd.Timedelta(span).total_seconds() * 1000)
    return keyed.groupBy("bucket", "slot").transformWithStateInPandas(statefulProcessor=Settling(ms(grace), ms(patience)), outputStructType=PAIRED, outputMode="Append", timeMode="EventTime")


def settled(pairs: DataFrame) -> DataFrame:
    """``bet_id, match_id, status, pnl, closing_odds, clv, settled_at`` of settled pairs."""
    c = F.col
    corners = P.rank((c("hc") + c("ac")).cast("double"), c("line"))
    r = F.when(c("market") == CORNERS, F.when(c("selection") == "Over", corners).otherwise(-corners)).otherwise(P.rank_of_bet(c("market"), c("selection"), c("line"), c("fthg"), c("ftag")))
    r = F.when(c("status") == "VOID", 0).otherwise(r)
    prices = F.from_json("closing", "map<string,double>")
    priced = pairs.withColumn("r", r).withColumn("prices", F.map_filter(prices, lambda _, x: x > 1.0))
    closing = F.when(c("status") != "VOID", F.try_element_at("prices", c("selection")))
    total = F.aggregate(F.map_values("prices"), F.lit(0.0), lambda a, x: a + 1.0 / x)
    whole = F.size("prices") >= F.when(c("market") == "1X2", 3).otherwise(2)
    return priced.select("bet_id", "match_id", F.get(F.array(*map(F.lit, LABELS)), c("r") + 2).alias("status"), P.profit(c("r"), c("odds"), c("stake")).alias("pnl"), closing.alias("closing_odds"), P.clv_log(c("odds"), F.when(whole, closing * total).otherwise(closing)).alias("clv"), F.timestamp_millis("settled_ms").alias("settled_at"))


def settle_to(journal: DataFrame, path: str, log: str) -> None:
    """Append what settles of all there is now to the journal at ``path``; run again with the same ``log``, it goes on."""
    spark, key = journal.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)  # keyed state with timers needs this store
    try:
        journal.writeStream.format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(path).awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
