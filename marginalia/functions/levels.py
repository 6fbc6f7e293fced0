"""Levels: ceilings and orders, changes by quizzes, skills and votes, weak areas, goal paths, tiers of a day's completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.math import clamp, clamp01, col, level_rank, rnd


def at_or_below(level, most) -> Column:
    """Whether a level isn't above another; an unknown level passes."""
    return (level_rank(level) < 0) | (level_rank(level) <= level_rank(most))


def sort_rank(level) -> Column:
    """The level's rank, with unknown levels after all others."""
    return F.when(level_rank(level) < 0, F.lit(99)).otherwise(level_rank(level))


def feedback_bias(easy, fine, hard) -> Column:
    """Between -1 (all too hard) and 1 (all too easy); 0 without votes."""
    total = col(easy) + col(fine) + col(hard)
    return F.when(total > 0, (col(easy) - col(hard)).cast("double") / total).otherwise(0.0)


def quiz_change(df: DataFrame, rank: str, average: str, attempts: str, done: str, least_attempts: int = 5, least_done: int = 5, up: float = 85, down: float = 50) -> DataFrame:
    """suggestion (up, down or hold), target (rank) and confidence by the mean of quiz scores."""
    enough = F.col(average).isNotNull() & (F.col(attempts) >= least_attempts)
    label = F.when(enough & (F.col(average) >= up) & (F.col(rank) < 5), "up").when(enough & (F.col(average) < down) & (F.col(rank) > 0), "down").otherwise("hold")
    rise = F.when(F.col(done) >= least_done, rnd(F.least(F.lit(1.0), (F.col(average) - up) / 15 + 0.7), 2)).otherwise(0.6)
    fall = rnd(F.least(F.lit(1.0), (down - F.col(average)) / 30 + 0.55), 2)
    step = F.when(label == "up", 1).when(label == "down", -1).otherwise(0)
    return df.withColumns({"suggestion": label, "target": F.col(rank) + step, "confidence": F.when(label == "up", rise).when(label == "down", fall).otherwise(0.0)})


def skill_profile(skills: DataFrame, by: list[str], order: list[str], up: float, down: float, least_skills: int, least_evidence: int, rank: str | None = None) -> DataFrame:
    """skills: keys, skill, confidence, evidence. overall (mean of those with evidence), evidence, weakest, strongest (ties by the fixed order) and the suggested change of level."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("skill"))
    known = skills.where("evidence > 0")
    made = known.groupBy(*by).agg(
        F.count("*").alias("skills"), F.sum("evidence").alias("evidence"), F.avg("confidence").alias("overall"), F.count_if(F.col("confidence") < down).alias("_weak"),
        F.min_by("skill", F.struct("confidence", place)).alias("weakest"), F.max_by("skill", F.struct("confidence", -place)).alias("strongest"), *([F.first(rank).alias(rank)] if rank else []),
    )
    room_up, room_down = (F.col(rank) < 5, F.col(rank) > 0) if rank else (F.lit(True), F.lit(True))
    thin = (F.col("skills") < least_skills) | (F.col("evidence") < least_evidence)
    label = F.when(thin, "hold").when((F.col("overall") >= up) & (F.col("_weak") == 0) & room_up, "up").when((F.col("overall") < down) & room_down, "down").otherwise("hold")
    return made.withColumn("suggestion", label).drop("_weak")


def weak_areas(df: DataFrame, weak: str, due: str, saved: str, quiz: str, spoken: str, quiz_bar: float = 70, spoken_bar: float = 75) -> DataFrame:
    """A row for each weak area of a learner with its severity: the largest of the ratios that speak for it."""
    ratio = F.when(F.col(saved) > 0, F.col(weak) / F.col(saved)).otherwise(0.0)
    gap = lambda c, bar: F.when(F.col(c) < bar, (bar - F.col(c)) / bar)
    areas = {
        "vocabulary": F.when((F.col(weak) > 0) | (F.col(due) > 0), clamp01(F.greatest(ratio, F.when(F.col(due) > 0, 0.4).otherwise(0.0)))),
        "comprehension": clamp01(gap(quiz, quiz_bar)),
        "pronunciation": clamp01(gap(spoken, spoken_bar)),
    }
    found = {"vocabulary": (F.col(weak) > 0) | (F.col(due) > 0), "comprehension": F.col(quiz) < quiz_bar, "pronunciation": F.col(spoken) < spoken_bar}
    rows = F.array_compact(F.array(*[F.when(found[k], F.struct(F.lit(k).alias("area"), v.alias("severity"))) for k, v in areas.items()]))
    return df.select("*", F.explode(rows).alias("_w")).select(*df.columns, "_w.area", "_w.severity")


# Of each goal path the longest text in words, the first and last rank of its band, how far above the band is tolerated, and boosts of topics.
GOAL_PATHS = {
    "daily_news": (600, 2, 3, 0.5, {"current_events": 1.3, "news": 1.3}),
    "academic": (1200, 3, 4, 1.0, {}),
    "business": (900, 2, 4, 0.5, {"business": 1.3, "finance": 1.3, "technology": 1.2}),
    "exam": (800, 2, 3, 0.5, {}),
    "extensive": (500, 0, 2, -0.5, {}),
}


def goal_delta(path: str, words, rank, topics) -> Column:
    """The nudge of at most 0.2 that a goal path gives a text by its length, rank (null or negative: unknown) and topics (array)."""
    most, low, high, tolerance, boosts = GOAL_PATHS[path]
    w, r = col(words), col(rank)
    length = F.when(w.isNull() | (w <= 0), 0.0).when(w <= most, 0.05).otherwise(-0.1 * F.least(F.lit(1.0), (w - most) / float(most)))
    band = F.when(r.isNull() | (r < 0), 0.0).when((r >= low) & (r <= high), 0.05).when(r > high, -0.08 * (r - high) / (1 + tolerance)).otherwise(0.0)
    best = F.greatest(F.lit(1.0), *[F.when(F.array_contains(col(topics), k), F.lit(v)).otherwise(1.0) for k, v in boosts.items()]) if boosts else F.lit(1.0)
    return clamp(length + band + (best - 1) * 0.2, -0.2, 0.2)


def goal_in_force(df: DataFrame, by: list[str], delta: str, least: int = 2) -> DataFrame:
    """Keys with at least `least` candidates that fit the goal path (a positive nudge); for others the path is off."""
    return df.groupBy(*by).agg(F.count_if(F.col(delta) > 0).alias("fitting")).withColumn("in_force", F.col("fitting") >= least)


TIERS = ("none", "reading", "comprehension", "full")


def tier_rank(c) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, TIERS)), col(c)), F.lit(1)) - 1


def completion_tier(reading, comprehension, has_words, review) -> Column:
    return F.when(~col(reading), "none").when(~col(comprehension), "reading").when(col(has_words) & col(review), "full").otherwise("comprehension")


def completion(current_tier, status, reading, comprehension, has_words, review) -> Column:
    """tier and status of a day after new facts: a tier never falls, a finished day stays finished, a skipped one is left alone."""
    now = completion_tier(reading, comprehension, has_words, review)
    tier = F.when(tier_rank(now) >= tier_rank(current_tier), now).otherwise(col(current_tier))
    best = col(reading) & col(comprehension) & (~col(has_words) | col(review))
    skipped = col(status) == "skipped"
    return F.struct(F.when(skipped, col(current_tier)).otherwise(tier).alias("tier"), F.when(skipped, "skipped").when((col(status) == "completed") | best, "completed").otherwise(col(status)).alias("status"))


def review_needed(words) -> Column:
    """How many of a day's words must be reviewed: all of up to three, else five."""
    return F.when(col(words) <= 3, col(words)).otherwise(F.least(col(words), F.lit(5)))


def level_evidence(quizzes: DataFrame, by: list[str], newest_first: list, score: str, most: int = 20) -> DataFrame:
    """Mean and number of each key's last `most` scores."""
    from marginalia.operators.sequences import newest

    return newest(quizzes.where(F.col(score).isNotNull()), by, newest_first, most).groupBy(*by).agg(F.avg(score).alias("average"), F.count("*").alias("attempts"))

