"""Gates and top-k: best leg of a match, daily slots, merged leagues, greedy exposure."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_CAP, LEAGUE_CAP = 0.05, 0.03


def best_per_group(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_k = 1").drop("_k")


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: Column | int) -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes before the shuffle where ``k`` is a number."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def exposure_fold(candidates: DataFrame, day: str, league: str, order: list[str], stake: str, day_cap: float = DAY_CAP, league_cap: float = LEAGUE_CAP) -> DataFrame:
    """Candidates in order against what is left of the day's and the league's cap: an accepted stake uses both up.

    The fold is greedy, so a day is one group.  A day's rows are read in order in batches, keeping only the running sums.
    """
    schema = candidates.drop("accepted").schema.simpleString()[7:-1] + ",accepted:boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total, by_league = None, 0.0, {}
        for rows in batches:
            taken = []
            for d, lg, s in zip(rows[day], rows[league], rows[stake]):
                if d != now:
                    now, total, by_league = d, 0.0, {}
                ok = s > 0 and total + s <= day_cap + 1e-12 and by_league.get(lg, 0.0) + s <= league_cap + 1e-12
                if ok:
                    total += s
                    by_league[lg] = by_league.get(lg, 0.0) + s
                taken.append(bool(ok))
            yield rows.assign(accepted=taken)

    ddl = schema.replace(":", " ")
    return candidates.repartition(day).sortWithinPartitions(day, *order).mapInPandas(run, ddl)
