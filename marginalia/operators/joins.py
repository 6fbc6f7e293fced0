"""Joins with a shape of their own: defaults, expectations, ordered fallbacks, containment, overlap, alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.math import exact_mean, rnd


def with_parent(df: DataFrame, parent: DataFrame, on: list[str], where: Column, columns: list[str]) -> DataFrame:
    """Rows beside columns of their parent, of parents that meet a condition; both are filtered before they meet."""
    return df.join(parent.where(where).select(*on, *columns), on)


def with_default(df: DataFrame, other: DataFrame, on: list[str], defaults: dict[str, Column]) -> DataFrame:
    """A left join in which columns of the other side have defaults where nothing matches."""
    return df.join(other.select(*on, *defaults), on, "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


def mine(df: DataFrame, key: str, owner: str, members: DataFrame, users: DataFrame) -> DataFrame:
    """user and key of the rows that users own or are members of, each pair once. members: key and user; users: user."""
    owned = df.select(F.col(owner).alias("user"), key)
    joined = members.select("user", key).join(df.select(key), key, "left_semi")
    return owned.unionByName(joined).distinct().join(users.select("user"), "user", "left_semi")


def calendar_cells(days: DataFrame, by: str, n: str, last: str, size: int = 365) -> DataFrame:
    """A row for each key and each of the last `size` days, zero where nothing happened. The calendar is a short array in each key's row."""
    first = F.date_sub(F.lit(last).cast("date"), size - 1)
    cells = days.select(by).distinct().select(by, F.explode(F.sequence(first, F.lit(last).cast("date"))).alias("day"))
    return cells.join(days.select(by, "day", n), [by, "day"], "left").withColumn(n, F.coalesce(n, F.lit(0)))


def with_dimension(df: DataFrame, by: list[str], dimension: str, values: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Every value of a fixed dimension for each key, with defaults where a value is missing."""
    every = df.select(*by).distinct().withColumn(dimension, F.explode(F.array(*map(F.lit, values))))
    return with_default(every, df, [*by, dimension], defaults)


def expectation(members: DataFrame, tasks: DataFrame, done: DataFrame, group: str) -> DataFrame:
    """expected (members times tasks, told from counts), completed (by members, of tasks of the group, each pair once) and rate in percent. members: group, user; tasks: group, task; done: user, task."""
    n = members.select(group, "user").distinct().groupBy(group).agg(F.count("*").alias("members"))
    t = tasks.select(group, "task").distinct().groupBy(group).agg(F.count("*").alias("tasks"))
    hit = done.select("user", "task").distinct().join(members.select(group, "user").distinct(), "user").join(tasks.select(group, "task").distinct(), [group, "task"], "left_semi")
    made = n.join(t, group, "left").join(hit.groupBy(group).agg(F.count("*").alias("completed")), group, "left")
    made = made.select(group, "members", (F.col("members") * F.coalesce("tasks", F.lit(0))).alias("expected"), F.coalesce("completed", F.lit(0)).alias("completed"))
    return made.withColumn("rate", F.when(F.col("expected") > 0, rnd(F.col("completed") / F.col("expected") * 100, 1)).otherwise(0.0))


def statuses(members: DataFrame, tasks: DataFrame, done: DataFrame, group: str, hit: str, rest: str) -> DataFrame:
    """group, status and n of every task of every member of a group: hit if the pair is done, else rest. members: group, user; tasks: group, task; done: user, task, each pair once.

    Only done pairs are joined; the others are told from counts, so that members and tasks never meet as pairs.
    """
    given = members.groupBy(group).agg(F.count("*").alias("_m")).join(tasks.groupBy(group).agg(F.count("*").alias("_t")), group)
    made = done.select("user", "task").join(tasks, "task").join(members, [group, "user"]).groupBy(group).agg(F.count("*").alias("_d"))
    both = given.join(made, group, "left").select(group, (F.col("_m") * F.col("_t")).alias("_all"), F.coalesce("_d", F.lit(0)).alias("_d"))
    rows = F.array(F.struct(F.lit(hit).alias("status"), F.col("_d").alias("n")), F.struct(F.lit(rest).alias("status"), (F.col("_all") - F.col("_d")).alias("n")))
    return both.select(group, F.inline(rows)).where("n > 0")


def first_found(df: DataFrame, key: str, candidates: str, table: DataFrame, word: str, columns: list[str]) -> DataFrame:
    """key, position (from 1) and columns of the first of a row's candidates that the table has; rows without one have nulls. table: each word once."""
    tried = df.select(key, F.posexplode(candidates).alias("_at", "_word"))
    hit = tried.join(table.select(F.col(word).alias("_word"), *columns), "_word").groupBy(key).agg(F.min_by(F.struct((F.col("_at") + 1).alias("position"), *columns), "_at").alias("_hit"))
    return df.select(key).join(hit, key, "left").select(key, "_hit.*")


def present(words: DataFrame, texts: DataFrame, word: str, key: str, tokens: Column) -> DataFrame:
    """key and word for each saved word that a text has, each once; the words filter the tokens as they are counted."""
    found = texts.select(key, F.explode(F.array_distinct(tokens)).alias(word))
    return found.join(words.select(word).distinct(), word, "left_semi")


def contained(lists: DataFrame, items: str, candidates: DataFrame, key: str) -> DataFrame:
    """key and n of each candidate: how many lists hold it."""
    hits = lists.select(F.explode(F.array_distinct(items)).alias(key)).groupBy(key).agg(F.count("*").alias("n"))
    return candidates.select(key).join(hits, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def zipped(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, place (from 0), and the elements of two arrays at that place; the shorter one gives nulls."""
    return df.select(key, F.posexplode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).alias("place", "_z")).select(key, "place", "_z.a", "_z.b")


def overlapping(left: DataFrame, right: DataFrame, by: list[str], width: float, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of rows of one key whose half-open ranges overlap; the right side's columns have the prefix r_.

    Ranges are laid on a grid of `width`: each row goes to the cells that it touches, rows meet by cell, and a pair
    counts in the cell where the later of the two starts lies, so that no pair is found twice and none is dropped.
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("long")

    def laid(df: DataFrame) -> DataFrame:
        last = F.greatest(cell(start), F.ceil(F.col(end) / width).cast("long") - 1)
        return df.where(F.col(start) < F.col(end)).withColumn("_cell", F.explode(F.sequence(cell(start), last)))

    r = laid(right)
    r = r.select(*by, "_cell", *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in by])
    both = laid(left).join(r, [*by, "_cell"])
    hit = (F.col(start) < F.col(f"r_{end}")) & (F.col(f"r_{start}") < F.col(end))
    return both.where(hit & (F.floor(F.greatest(F.col(start), F.col(f"r_{start}")) / width) == F.col("_cell"))).drop("_cell")


def chain(a: list[str], b: list[str], band: int) -> list[tuple[int, int]]:
    """The longest chain of equal words, rising in both lists, of places at most `band` apart."""
    where: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        where.setdefault(w, []).append(j)
    tails: list[int] = []
    ends: list[tuple[int, int, int | None]] = []  # place in a, place in b, link to the pair before
    last: list[int] = []
    for i, w in enumerate(a):
        places = where.get(w, [])
        for j in reversed(places[bisect_left(places, i - band) : bisect_left(places, i + band + 1)]):
            k = bisect_left(tails, j)
            ends.append((i, j, last[k - 1] if k else None))
            if k == len(tails):
                tails.append(j)
                last.append(len(ends) - 1)
            else:
                tails[k], last[k] = j, len(ends) - 1
    out, at = [], last[-1] if last else None
    while at is not None:
        i, j, at = ends[at]
        out.append((i, j))
    return out[::-1]


def chain_length(a: list[str], b: list[str], band: int) -> int:
    """The length of chain(a, b, band), without its pairs.

    One bit a place of b tells by a zero where the longest chain up to there grows; a word of a changes all of them by a few operations on
    integers. Only places within the band of a block of words are held: those before it don't change any more, and those behind it are ones.
    """
    length, low, held, places = 0, 0, 0, 0  # chains that grow before the held places; the first held place; their number; their bits
    for at in range(0, len(a), 2 * band + 1):
        block = a[at : at + 2 * band + 1]
        first, end = min(max(0, at - band), len(b)), min(len(b), at + len(block) + band)
        gone = min(first - low, held)
        length += gone - (places & (1 << gone) - 1).bit_count()
        places = places >> gone | (1 << end - first) - (1 << held - gone)
        low, held = first, end - first
        where: dict[str, int] = {}
        for j, w in enumerate(b[first:end]):
            where[w] = where.get(w, 0) | 1 << j
        full, near = (1 << held) - 1, (1 << 2 * band + 1) - 1
        for i, w in enumerate(block, at - band - first):
            found = where.get(w, 0) & (near << i if i > 0 else near >> -i) & places
            if found:
                places = ((places + found) | (places - found)) & full
    return length + held - places.bit_count()


def aligned(df: DataFrame, key: str, a: str, b: str, band: int = 512) -> DataFrame:
    """key, matched and coverage (share of a's words) of the longest common chain of two word arrays within a band."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, x, y in frame.itertuples(index=False, name=None):
                n = chain_length(list(x), list(y), band)
                rows.append((k, n, n / len(x) if len(x) else 1.0))
            yield pd.DataFrame(rows, columns=[key, "matched", "coverage"])

    return df.select(key, a, b).mapInPandas(run, f"{key} {kind}, matched int, coverage double")


def coverage_bucket(c) -> Column:
    return F.when(c >= 0.99, "full").when(c >= 0.9, "high").when(c >= 0.5, "partial").otherwise("low")


def next_readable(df: DataFrame, key: str, items: str, index: str, readable: DataFrame, item: str) -> DataFrame:
    """key, position and item: the first readable element of an ordered list at or after an index."""
    places = df.select(key, index, F.posexplode(items).alias("position", item)).where(F.col("position") >= F.col(index))
    hit = places.join(readable.select(item).distinct(), item, "left_semi")
    first = hit.groupBy(key).agg(F.min(F.struct("position", item)).alias("_f")).select(key, "_f.*")
    return df.select(key).join(first, key, "left")


def relocate(text, quote, start, prefix, suffix) -> Column:
    """Where a quotation is now (from 0; -1 if it is gone): at its old place, else with its context, else anywhere, else with other white space."""
    t, q = F.coalesce(F.col(text), F.lit("")), F.col(quote)
    p, s = F.coalesce(F.col(prefix), F.lit("")), F.coalesce(F.col(suffix), F.lit(""))
    same = F.substring(t, F.col(start) + 1, F.length(q)) == q
    context = F.call_function("locate", F.concat(p, q, s), t)
    anywhere = F.call_function("locate", q, t)
    loose = F.array_join(F.transform(F.split(F.trim(q), r"\s+"), lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), r"\s+")
    found = F.regexp_substr(t, loose)
    flexible = F.call_function("locate", F.coalesce(found, F.lit("\u0000")), t)
    return F.when(F.length(q) == 0, -1).when(same, F.col(start)).when(context > 0, context - 1 + F.length(p)).when(anywhere > 0, anywhere - 1).when(flexible > 0, flexible - 1).otherwise(-1)


def spilled(df: DataFrame, by: str, n: int, other: str = "other") -> DataFrame:
    """Counts of the n commonest values, and of all the rest as one."""
    counts = df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    head = counts.orderBy(F.desc("n"), "value").limit(n)
    rest = counts.join(head.select("value"), "value", "left_anti").agg(F.lit(other).alias("value"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where("n > 0")
    return head.unionByName(rest)


def average_rounded(c) -> Column:
    """The mean of what isn't null, as a whole number; null where nothing is left."""
    return rnd(exact_mean(c)).cast("long")


def page_counts(page: DataFrame, children: DataFrame, key: str, alias: str) -> DataFrame:
    """Counts of children for the keys of one page only: the page's few keys filter the children before they are counted."""
    counts = children.join(F.broadcast(page.select(key)), key, "left_semi").groupBy(key).agg(F.count("*").alias(alias))
    return page.join(counts, key, "left").withColumn(alias, F.coalesce(alias, F.lit(0)))


def prepended(extra: DataFrame, base: DataFrame, order: list, n: int) -> DataFrame:
    """Extra candidates before the base ones, all of them (a multiset), each part in its order; with position."""
    from marginalia.operators.relational import page

    both = extra.withColumn("_part", F.lit(0)).unionByName(base.withColumn("_part", F.lit(1)))
    return page(both, [F.col("_part"), *order], 1, n).drop("_part")
