"""Learner state: ordered folds that keep one state a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.math import adaptive_vote, rnd


def fold(df: DataFrame, key: str | list[str], order: list[str], start: Callable[[], tuple], step: Callable[..., tuple], inputs: list[str], schema: str) -> DataFrame:
    """Folds the rows of each key in order: key and the last state (columns of schema, after the key's). Null keys are passed over.

    Rows are dealt and sorted by key; a task then streams through them and holds only the state of the key at hand,
    so a key with a third of all rows needs no more memory than any other.
    """
    fields = [x.split()[0] for x in schema.split(",")]
    keys = [key] if isinstance(key, str) else key
    k = len(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, done = None, None, []
        for frame in frames:
            for row in frame[[*keys, *inputs]].itertuples(index=False, name=None):
                if state is None or row[:k] != now:
                    if state is not None:
                        done.append((*now, *state))
                    now, state = row[:k], start()
                state = step(state, *row[k:])
            if done:
                yield pd.DataFrame(done, columns=fields)
                done = []
        if state is not None:
            yield pd.DataFrame([(*now, *state)], columns=fields)

    return df.dropna(subset=keys).repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *inputs).mapInPandas(run, schema)


def average(df: DataFrame, by: list[str], order: list[str], outcome: Column, alpha: float = 0.3, weight: Column | None = None) -> DataFrame:
    """Exponential moving average of outcomes, oldest first, the first one taken whole: keys, confidence, evidence.

    With a weight, alpha is multiplied by it (0 to 5) and is at most 0.8. Rows stream through the fold, so a hot key
    is neither buffered nor ranked.
    """
    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)
    step_size = F.lit(float(alpha)) if weight is None else F.least(F.lit(0.8), alpha * F.greatest(F.lit(0.0), F.least(F.lit(5.0), weight)))
    rows = df.select(*by, *[c for c in order if c not in by], outcome.cast("double").alias("_x"), step_size.alias("_a"))

    def step(state: tuple, x: float, a: float) -> tuple:
        c, n = state
        return (x if n == 0 else c * (1 - a) + x * a), n + 1

    made = fold(rows, by, order, lambda: (0.0, 0), step, ["_x", "_a"], f"{kinds}confidence double, evidence long")
    return made.withColumn("confidence", rnd("confidence", 6))


#: The longest interval, the largest long: without an end, some 45 reviews in a row that go well would pass it.
MOST_DAYS = 2**63 - 1


def review(state: tuple, grade: str) -> tuple:
    """One step of spaced repetition (SM-2): interval in days (at most MOST_DAYS), ease, repetitions."""
    interval, ease, reps = state
    if grade == "again":
        return 1, max(1.3, ease - 0.2), 0
    q = {"hard": 3, "good": 4, "easy": 5}[grade]
    ease = max(1.3, ease + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))
    interval = 1 if reps == 0 else 6 if reps == 1 else min(MOST_DAYS, int(interval * ease + 0.5))
    return (max(1, int(interval * 0.6 + 0.5)) if grade == "hard" else interval), ease, reps + 1


def schedule(reviews: DataFrame, key: str, order: list[str], grade: str) -> DataFrame:
    """The scheduling state after all reviews of a key."""
    kind = reviews.schema[key].dataType.simpleString()
    return fold(reviews, key, order, lambda: (0, 2.5, 0), review, [grade], f"{key} {kind}, interval_days long, ease double, repetitions long")


def level_decision(df: DataFrame, rank: str, quiz_avg: str, quiz_n: str, bias: str, votes: str, skill: str, evidence: str) -> DataFrame:
    """next_rank and confidence: the majority of three votes moves one level where there is one."""
    v = F.col("_votes")
    up, down = F.size(F.filter(v, lambda x: x == 1)), F.size(F.filter(v, lambda x: x == -1))
    to = F.col(rank) + F.when(up > down, 1).when(down > up, -1).otherwise(0)
    moves = (up != down) & to.between(0, 5)
    sure: Column = rnd(F.least(F.lit(1.0), 0.5 + 0.3 * F.abs(up - down) / (up + down) + 0.05 * F.greatest(up, down)), 2)
    return df.withColumn("_votes", adaptive_vote(quiz_avg, quiz_n, bias, votes, skill, evidence)).withColumn("next_rank", F.when(moves, to).otherwise(F.col(rank))).withColumn("confidence", F.when(moves, sure).otherwise(0.0)).drop("_votes")
