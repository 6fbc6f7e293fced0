"""Rounding, ratios and score expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("A1", "A2", "B1", "B2", "C1", "C2")


def col(c: Column | str | float) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once a row, however often it is used."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def rnd(c, digits: int = 0) -> Column:
    """Half up: floor(x * 10 ** digits + 0.5) / 10 ** digits."""
    f = 10.0**digits
    return F.floor(col(c) * f + 0.5) / f


def exact_mean(c) -> Column:
    """The mean of what isn't null, from a decimal sum: the same in whatever order and parts the rows come. Values with over 18 decimals or 20 digits before them, or not finite, give the plain mean."""
    x = col(c).cast("double")
    part = x.try_cast("decimal(38,18)")
    held = F.count_if(part.cast("double") == x)
    return F.when(held == F.count(x), F.try_sum(part).cast("double") / F.count(x)).otherwise(F.avg(x))


def percentage(n, d, digits: int = 1) -> Column:
    """0 where the denominator isn't positive."""
    return F.when(col(d) <= 0, F.lit(0.0)).otherwise(rnd(col(n) / col(d) * 100, digits))


def clamp(c, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col(c)))


def clamp01(c) -> Column:
    """NaN counts as 0."""
    return clamp(F.nanvl(col(c).cast("double"), F.lit(0.0)), 0, 1)


def scale(c, low: float, high: float) -> Column:
    """0 to 100 between two values."""
    return clamp((col(c) - low) / (high - low) * 100, 0, 100)


def level_rank(c) -> Column:
    """0 to 5, -1 for an unknown level."""
    return (F.array_position(F.array(*map(F.lit, LEVELS)), F.coalesce(col(c), F.lit(""))) - 1).cast("int")


def steps(c, cuts: list[tuple[float, float]], rest: float) -> Column:
    """The value of the first cut that c doesn't exceed."""
    out = None
    for bound, value in cuts:
        out = F.when(col(c) <= bound, F.lit(value)) if out is None else out.when(col(c) <= bound, F.lit(value))
    return out.otherwise(F.lit(rest))


def level_points(delta) -> Column:
    """Feed points for a level so many ranks above the reader's; unknown: 5."""
    d = col(delta)
    return F.when(d.isNull(), 5).when(d == 0, 30).when(d == -1, 18).when(d == -2, 10).when(d <= -3, 5).when(d == 1, 12).when(d == 2, 3).otherwise(0)


def level_fit(delta) -> Column:
    """Fit between 0 and 1 of a level so many ranks above the reader's; unknown: 0.5."""
    d = col(delta)
    return F.when(d.isNull(), 0.5).when(d == 0, 1.0).when(d == -1, 0.78).when(d == 1, 0.62).when(d == -2, 0.5).when(d == 2, 0.32).when(d < -2, 0.2).otherwise(0.12)


def age_days(now, then) -> Column:
    return (F.unix_timestamp(col(now).cast("timestamp")) - F.unix_timestamp(col(then).cast("timestamp"))) / 86400.0


def freshness_points(days) -> Column:
    return F.when(col(days).isNull(), 0).otherwise(steps(days, [(7, 10), (30, 7), (90, 4), (180, 2)], 0))


def freshness(days) -> Column:
    return F.when(col(days).isNull(), 0.1).otherwise(steps(days, [(7, 1.0), (30, 0.75), (90, 0.5), (180, 0.3)], 0.1))


def novelty(completed, percent, mastery_age) -> Column:
    """0 completed, 0.45 in progress, then by days since the last activity; 1 if unseen."""
    return F.when(col(completed), 0.0).when(col(percent) > 0, 0.45).when(col(mastery_age).isNull(), 1.0).otherwise(steps(mastery_age, [(3, 0.3), (14, 0.6)], 0.85))


def difficulty_feedback(delta, bias) -> Column:
    d = clamp(delta, -3, 3)
    return F.when(col(delta).isNull(), 0.5).otherwise(clamp01(0.5 + 0.2 * col(bias) * d))


def word_load(delta, familiarity, known) -> Column:
    """How near the expected load of unknown words is to a comfortable one."""
    d = F.coalesce(clamp(delta, -3, 3), F.lit(0.0))
    strength = clamp01(0.5 * clamp01(familiarity) + 0.5 * F.least(F.lit(1.0), col(known) / 200.0))
    load = clamp01(0.35 + 0.18 * d - 0.25 * strength)
    return clamp01(1 - F.abs(load - 0.3) / 0.7)


def mastery_gap(comprehension, delta, weakest) -> Column:
    base = F.coalesce(1 - col(comprehension), F.lit(0.7))
    fits = F.when(col(weakest).isin("reading", "comprehension"), col(delta) <= 0).when(col(weakest).isin("vocabulary", "grammar"), (col(delta) >= 0) & (col(delta) <= 1)).otherwise(F.lit(False))
    return clamp01(base + F.when(fits, 0.15).otherwise(0.0))


def weak_word_points(count) -> Column:
    return rnd(8 * F.least(F.lit(1.0), col(count) / 3.0), 1)


def suitability_delta(score) -> Column:
    """A nudge of at most 0.1 around the medium tier, 0.6."""
    return clamp((col(score) - 0.6) * (0.1 / (1 - 0.6)), -0.1, 0.1)


# Component weights of a recommendation, in the order of its components.
WEIGHTS = {"level_fit": 0.26, "topic": 0.20, "novelty": 0.14, "freshness": 0.12, "mastery_gap": 0.12, "difficulty_feedback": 0.08, "word_load": 0.08}


def recommendation(components: dict[str, Column], goal_delta, suit_delta, points) -> Column:
    """0 to 100 with one decimal: weighted components, then two capped nudges, then points."""
    base = reduce(Column.__add__, (F.lit(w) * components[k] for k, w in WEIGHTS.items()))
    return rnd(F.least(F.lit(100.0), clamp01(clamp01(base + col(goal_delta)) + col(suit_delta)) * 100 + col(points)), 1)


def headline(components: dict[str, Column]) -> Column:
    """The component that weighs most; of equal ones the first in order of weight."""
    items = [F.struct((F.lit(w) * components[k]).alias("x"), F.lit(-i).alias("i"), F.lit(k).alias("name")) for i, (k, w) in enumerate(WEIGHTS.items())]
    return F.greatest(*items)["name"]


def familiarity(exposures, reviews, correct) -> Column:
    e = 1 - F.exp(-col(exposures) / 4.0)
    t = F.least(F.lit(1.0), col(reviews) / 4.0)
    return F.when(col(reviews) == 0, 0.6 * e).otherwise(0.6 * e * (1 - t) + col(correct) / F.greatest(col(reviews), F.lit(1)) * t)


def confidence(n) -> Column:
    return 1 - F.exp(-col(n) / 5.0)


def comprehension(completion, quiz, feedback, lookups) -> Column:
    base = F.when(col(quiz).isNotNull(), 0.5 * col(completion) + 0.5 * col(quiz)).otherwise(0.6 * col(completion))
    base = F.when(col(feedback) == "too_hard", base * 0.85).when(col(feedback) == "too_easy", base * 1.05 + 0.05).otherwise(base)
    return clamp01(F.when(col(lookups) > 0, base * (1 - F.least(F.lit(0.15), 0.02 * col(lookups)))).otherwise(base))


def words_per_minute(words, ms) -> Column:
    """50 to 600; null under five seconds or without words."""
    return F.when((col(ms) >= 5000) & (col(words) > 0), rnd(clamp(col(words) / (col(ms) / 60000.0), 50, 600)))


def heat(n) -> Column:
    return F.when(col(n) <= 0, 0).otherwise(steps(n, [(1, 1), (3, 2), (6, 3)], 4)).cast("int")


def stale_confidence(c, days) -> Column:
    """After 90 days half of the weakness is forgotten."""
    return F.when(col(days) > 90, 1 - (1 - col(c)) * 0.5).otherwise(col(c))


def trend(now, before, band: float = 0.05) -> Column:
    return F.when(col(before).isNull(), "stable").when(col(now) - col(before) >= band, "improving").when(col(now) - col(before) <= -band, "declining").otherwise("stable")


def backoff(attempt, base: float, most: float, jitter) -> Column:
    """Milliseconds before a retry; jitter is a fraction of the smaller of base and the step."""
    step = base * F.pow(F.lit(2.0), col(attempt) - 1)
    return F.least(F.lit(float(most)), step + col(jitter) * F.least(F.lit(float(base)), step))


def adaptive_vote(quiz_avg, quiz_n, bias, votes, skill, evidence) -> Column:
    """-1, 0 or 1 for each signal, as an array."""
    q = F.when(col(quiz_n) < 3, 0).when(col(quiz_avg) >= 85, 1).when(col(quiz_avg) < 50, -1).otherwise(0)
    f = F.when(col(votes) < 3, 0).when(col(bias) >= 0.4, 1).when(col(bias) <= -0.4, -1).otherwise(0)
    s = F.when(col(evidence) < 4, 0).when(col(skill) >= 0.8, 1).when(col(skill) < 0.4, -1).otherwise(0)
    return F.array(q, f, s)


def placement(correct_ratio, lookup_rate) -> Column:
    return F.when((col(correct_ratio) < 0.6) | (col(lookup_rate) >= 0.1), -1).when((col(correct_ratio) >= 0.8) & (col(lookup_rate) < 0.05), 1).otherwise(0)


def crawl_health(failures, empty_runs, error) -> Column:
    return F.when((col(failures) >= 3) | (col(empty_runs) >= 3), "failing").when((col(failures) >= 1) | (col(empty_runs) >= 1) | col(error).isNotNull(), "degraded").otherwise("healthy")


def token_cost(prompt, completion, in_rate, out_rate) -> Column:
    """Dollars at rates for a million tokens, six decimals."""
    return rnd((col(prompt) * col(in_rate) + col(completion) * col(out_rate)) / 1e6, 6)


def reading_minutes(words) -> Column:
    return F.when(col(words) > 0, F.greatest(F.lit(1.0), rnd(col(words) / 200.0))).cast("int")


def lookup_density(saved, words) -> Column:
    """Words looked up for each hundred words read; null without words."""
    return F.when(col(words) > 0, col(saved) * 100.0 / col(words))


def progress_percent(c) -> Column:
    """A whole percentage between 0 and 100; null counts as 0."""
    return rnd(clamp(F.coalesce(col(c).cast("double"), F.lit(0.0)), 0, 100)).cast("int")


def finished(percent, at: float = 95) -> Column:
    return col(percent) >= at


def count_score(correct, total) -> Column:
    """Whole percent of right answers; 0 without any."""
    return F.when(col(total) > 0, rnd(clamp(col(correct) / col(total) * 100, 0, 100))).otherwise(0.0).cast("int")


def onboarding_level(correct, total, chosen) -> Column:
    """A level after a placement test: one below what the reader chose with under half right, two with under a quarter, never below A1."""
    share = F.when(col(total) > 0, col(correct) / col(total)).otherwise(0.0)
    down = F.when(share < 0.25, 2).when(share < 0.5, 1).otherwise(0)
    return F.get(F.array(*map(F.lit, LEVELS)), F.greatest(F.lit(0), level_rank(chosen) - down))


def model_rate(model, rates: dict[str, tuple[float, float]], usual: tuple[float, float]) -> Column:
    """Input and output rates of a model: by its exact name, else by the first name that it contains, else the usual ones."""
    low = F.lower(F.coalesce(col(model), F.lit("")))
    pair = lambda r: F.struct(F.lit(float(r[0])).alias("prompt"), F.lit(float(r[1])).alias("completion"))
    exact = F.coalesce(*[F.when(low == k, pair(r)) for k, r in rates.items()]) if rates else F.lit(None)
    part = F.coalesce(*[F.when(low.contains(k), pair(r)) for k, r in rates.items()]) if rates else F.lit(None)
    return F.coalesce(exact, part, pair(usual)) if rates else pair(usual)


def model_cost(model, prompt, completion, rates: dict[str, tuple[float, float]], usual: tuple[float, float]) -> Column:
    """Dollars at rates for a thousand tokens, six decimals; null where neither count is known, negative counts being unknown."""
    known = lambda c: F.when(col(c) >= 0, F.floor(col(c)))
    r, p, q = model_rate(model, rates, usual), known(prompt), known(completion)
    cost = F.coalesce(p, F.lit(0)) / 1000 * r["prompt"] + F.coalesce(q, F.lit(0)) / 1000 * r["completion"]
    return F.when(p.isNotNull() | q.isNotNull(), rnd(cost, 6))
