"""A work queue as tables: transitions, claims, duplicates, dashboards; pipeline steps and what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.math import backoff, col

ACTIVE, IN_FLIGHT = ("pending", "processing", "failed"), ("processing",)


def stuck(now: Column, status="status", locked="locked_at", ttl_seconds: int = 600) -> Column:
    """In flight with a lock older than the lease."""
    return col(status).isin(*IN_FLIGHT) & (col(locked) < now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def failed(df: DataFrame, now: Column, permanent: Column, attempts: str = "attempts", most: str = "max_attempts", base_ms: float = 1000, most_ms: float = 60_000, jitter=0.0) -> DataFrame:
    """Jobs after a failure: attempts one more; dead_letter for a permanent error or the last attempt, else failed with the time of the next."""
    n = F.col(attempts) + 1
    dead = permanent | (n >= F.col(most))
    wait = backoff(n, base_ms, most_ms, F.lit(jitter) if not isinstance(jitter, Column) else jitter)
    return df.withColumns({attempts: n, "status": F.when(dead, "dead_letter").otherwise("failed"), "run_after": F.when(~dead, F.timestamp_micros((F.unix_micros(now.cast("timestamp")) + wait * 1000).cast("long")))})


def enqueue(requests: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """What a request for each key does: return an active job, reset one that has ended, or create one. Requests of one key count once."""
    asked = requests.groupBy(key).agg(F.count("*").alias("requests"))
    state = jobs.groupBy(key).agg(F.bool_or(F.col("status").isin(*ACTIVE)).alias("_active"))
    return asked.join(state, key, "left").withColumn("action", F.when(F.col("_active"), "return").when(F.col("_active").isNotNull(), "reset").otherwise("create")).drop("_active")


def dashboard(jobs: DataFrame, now: Column, kind: str = "type") -> DataFrame:
    """Counts by status, by kind and of all, with how many are stuck, from one pass."""
    rows = jobs.withColumn("_stuck", F.coalesce(stuck(now), F.lit(False)))
    made = rows.groupingSets([[F.col("status")], [F.col(kind)], []], F.col("status"), F.col(kind)).agg(F.count("*").alias("n"), F.count_if("_stuck").alias("stuck"), F.grouping_id().alias("_g"))
    view = F.when(F.col("_g") == 1, "status").when(F.col("_g") == 2, "type").otherwise("all")
    return made.select(view.alias("view"), F.coalesce("status", kind, F.lit("")).alias("key"), "n", "stuck")


def missing_steps(items: DataFrame, done: DataFrame, steps: list[str], key: str, active: DataFrame | None = None) -> DataFrame:
    """key and step for every step that an item lacks, less those that are already queued. steps are few and fixed, so each item is expanded in place."""
    wanted = items.select(key, F.explode(F.array(*map(F.lit, steps))).alias("step"))
    left = wanted.join(done.select(key, "step"), [key, "step"], "left_anti")
    return left if active is None else left.join(active.select(key, "step"), [key, "step"], "left_anti")


def pipeline_state(runs: DataFrame, key: str, steps: list[str], order: str) -> DataFrame:
    """The last outcome of each step of an item: steps done and failed, the next step to run (done steps are skipped), and whether it may be published."""
    last = runs.groupBy(key, "step").agg(F.max_by("outcome", order).alias("outcome"))
    made = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("step", "outcome"))).alias("_m"))
    todo = F.filter(F.array(*map(F.lit, steps)), lambda s: ~F.coalesce(F.element_at("_m", s) == "done", F.lit(False)))
    failures = F.size(F.filter(F.map_values("_m"), lambda o: o == "failed"))
    return made.select(key, F.size(F.filter(F.map_values("_m"), lambda o: o == "done")).alias("done"), failures.alias("failed"), F.get(todo, F.lit(0)).alias("next_step"), ((F.size(todo) == 0) & (failures == 0)).alias("publish"))


def advance_series(enrolled: DataFrame, read: DataFrame, user: str, items: str = "items", index: str = "next_index") -> DataFrame:
    """A reader's place in an ordered list moves on when the item it points at was read; past the end the series is completed. read: user and item, each pair once."""
    here = enrolled.withColumn("_item", F.get(items, F.col(index)))
    hit = here.join(read.select(user, F.col("item").alias("_item"), F.lit(1).alias("_read")), [user, "_item"], "left")
    moved = F.col(index) + F.coalesce("_read", F.lit(0))
    return hit.withColumns({index: moved, "completed": moved >= F.size(items)}).drop("_item", "_read")


def daily_plan(users: DataFrame, in_progress: DataFrame, picks: DataFrame, key: str) -> DataFrame:
    """One row a user: the text in progress read last, else the best pick, else none."""
    resume = in_progress.groupBy(key).agg(F.max_by("item", F.struct("at", "item")).alias("_resume"))
    best = picks.groupBy(key).agg(F.max_by("item", F.struct("score", -F.col("item"))).alias("_pick"))
    rows = users.select(key).join(resume, key, "left").join(best, key, "left")
    return rows.select(key, F.when(F.col("_resume").isNotNull(), "resume").when(F.col("_pick").isNotNull(), "pick").otherwise("none").alias("source"), F.coalesce("_resume", "_pick").alias("item"))


def budget_checks(requests: DataFrame, dimensions: list[tuple[str, list[str], int]], order: list) -> DataFrame:
    """Requests with outcome: ok, or the first dimension whose counter was full. dimensions: name, keys and limit, in the order in which they are charged.

    A dimension is charged by those that passed the ones before it, so each stage ranks what is left; every task cuts
    its keys at the limit first, so that a dimension with one key doesn't gather all rows.
    """
    from marginalia.operators.sequences import newest

    left, out = requests, None
    id_columns = requests.columns
    for name, keys, limit in dimensions:
        passed = newest(left, keys, order, limit).select(*id_columns) if keys else left.orderBy(*order).limit(limit)
        over = left.join(passed, id_columns, "left_anti").withColumn("outcome", F.lit(name))
        out = over if out is None else out.unionByName(over)
        left = passed
    return left.withColumn("outcome", F.lit("ok")).unionByName(out) if out is not None else left.withColumn("outcome", F.lit("ok"))


def budget_status(used: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """limit, used and remaining of every configured key, unused ones included, and of used keys without a limit (limit null)."""
    rows = limits.select(key, "limit").join(used.select(key, "used"), key, "full")
    n = F.coalesce("used", F.lit(0)).cast("long")
    return rows.select(key, "limit", n.alias("used"), F.greatest(F.col("limit") - n, F.lit(0)).alias("remaining"))


def response_class(status) -> Column:
    """What a response to a queued change means: done (2xx, and 409: it was there before), retry (408, 429, 5xx, none), refused (other 4xx)."""
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s.between(200, 299) | (s == 409), "done").when(s.isin(408, 429), "retry").when(s.between(400, 499), "refused").otherwise("retry")


def replayed(changes: DataFrame, key: list[str], order: list[str], responses: str, tries: int = 5, passes: int | None = None) -> DataFrame:
    """Adds state, sent, began and ended to queued changes whose responses (an array of HTTP statuses, one for each time it is sent) are known.

    Changes of one key go out in order of `order`, each once in a pass over the queue; one that is to be retried holds back those behind it
    until it is done, and one that fails (refused, or retried `tries` times) holds them back for good. A change that runs out of responses isn't answered, which is
    a retry. state: done, failed, pending (its next try comes after `passes`) or held; sent: how often it was sent; began and
    ended: the passes of its first and last try, null if it never went out. Each change needs only the sums over those before it,
    so no state is carried from row to row.
    """
    from pyspark.sql import Window

    first = F.array_position(F.transform(F.slice(responses, 1, tries), lambda s: response_class(s) == "retry"), False).cast("int")
    end = F.when(first > 0, response_class(F.get(responses, first - 1))).otherwise("failed")
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = changes.withColumn("_tries", F.when(first > 0, first).otherwise(tries)).withColumn("_failed", end != "done")
    rows = rows.withColumn("_held", F.coalesce(F.bool_or("_failed").over(before), F.lit(False))).withColumn("began", F.coalesce(F.sum(F.col("_tries") - 1).over(before), F.lit(0)) + 1)
    last = F.col("began") + F.col("_tries") - 1
    most = F.lit(passes) if passes is not None else last
    held = F.col("_held") | (F.col("began") > most)
    state = F.when(F.col("_held"), "held").when(F.col("began") > most, "held").when(last > most, "pending").when(F.col("_failed"), "failed").otherwise("done")
    ended = F.least(last, most)
    rows = rows.withColumns({"state": state, "sent": F.when(held, 0).otherwise(ended - F.col("began") + 1).cast("int"), "ended": F.when(~held, ended).cast("int"), "began": F.when(~held, F.col("began")).cast("int")})
    return rows.drop("_tries", "_failed", "_held")


def alerts(errors: DataFrame, fingerprint: str, order: list[str], threshold: int, fatal: Column) -> DataFrame:
    """Adds occurrences, the number of errors with a row's fingerprint up to and with it in the order given, and alert: at the threshold and above it, and for every fatal error. Errors without a fingerprint are counted together."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(fingerprint).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return errors.withColumn("occurrences", n).withColumn("alert", F.coalesce(fatal, F.lit(False)) | (F.col("occurrences") >= threshold))


def payload_fields(payload, *names: str) -> list[Column]:
    """Texts at the top of a JSON payload; null for other values, other payloads and broken JSON."""
    kept = F.try_parse_json(col(payload))
    typed = lambda n: F.when(F.schema_of_variant(F.try_variant_get(kept, f"$.{n}", "variant")) == "STRING", F.try_variant_get(kept, f"$.{n}", "string"))
    return [typed(n).alias(n) for n in names]
