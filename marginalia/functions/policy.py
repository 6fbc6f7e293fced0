"""Reusable predicates: who may read what, text search, queue and send decisions."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.math import col


def public_listable() -> Column:
    return (F.col("visibility") == "PUBLIC") & (F.col("status") == "published") & F.col("owner_id").isNull()


def readable(user: Column | None = None, operator: bool = False) -> Column:
    """Operators read all; users what is listable and their own private rows; others what is listable."""
    if operator:
        return F.lit(True)
    return public_listable() if user is None else public_listable() | ((F.col("visibility") == "PRIVATE") & (F.col("owner_id") == user))


def editable(user: Column | None = None, operator: bool = False) -> Column:
    return F.lit(True) if operator else F.lit(False) if user is None else F.coalesce(F.col("owner_id") == user, F.lit(False))


def all_of(*predicates: Column) -> Column:
    return reduce(and_, predicates, F.lit(True))


def search_terms(text) -> Column:
    """Lower-cased words of a query: the first eight, then each once."""
    return F.array_distinct(F.slice(F.filter(F.split(F.lower(col(text)), r"[^\p{L}\p{N}]+"), lambda x: x != ""), 1, 8))


def contains(c, value) -> Column:
    """Literal, case-insensitive substring; false for null."""
    return F.coalesce(F.lower(col(c)).contains(F.lower(col(value) if isinstance(value, Column) else F.lit(value))), F.lit(False))


def fields_match(fields: list[str], terms: list[str]) -> Column:
    """Every term in at least one field."""
    return all_of(*[reduce(or_, [contains(f, t) for f in fields]) for t in terms])


def phrase_match(fields: list[str], phrase: str) -> Column:
    return reduce(or_, [contains(f, phrase) for f in fields])


def field_score(c, query: str, terms: list[str], weight: float) -> Column:
    """Twice the weight for the whole query and the weight for each term."""
    hit = F.when(contains(c, query), 2.0 * weight).otherwise(0.0)
    return reduce(Column.__add__, [F.when(contains(c, t), float(weight)).otherwise(0.0) for t in terms], hit)


# Search weights of the fields, and boosts of the sources.
SEARCH_WEIGHTS = {"title": 60, "excerpt": 28, "author": 22, "source": 22, "category": 12, "content": 10}
SOURCE_BOOSTS = {"highlight": 45, "saved_word": 35, "owned": 20}


def search_score(fields: dict[str, str], query: str, terms: list[str]) -> Column:
    """fields: role (a key of SEARCH_WEIGHTS) to column."""
    return reduce(Column.__add__, [field_score(c, query, terms, SEARCH_WEIGHTS[role]) for role, c in fields.items()])


def half_open(ts, since, until) -> Column:
    return (col(ts) >= since) & (col(ts) < until)


def is_due(ts, now) -> Column:
    return col(ts).isNull() | (col(ts) <= now)


def runnable(now, lease_seconds: int = 600) -> Column:
    """Pending or failed jobs whose time has come, and jobs whose lease has run out."""
    expired = F.col("locked_at") < now - F.make_dt_interval(secs=F.lit(lease_seconds))
    return (F.col("status").isin("pending", "failed") & (F.col("run_after") <= now)) | ((F.col("status") == "processing") & expired)


def send_now(enabled, hour, start, end, preferred) -> Column:
    from marginalia.functions.dates import quiet

    return col(enabled) & ~quiet(hour, start, end) & (col(preferred).isNull() | (col(preferred) == col(hour)))


def private_ipv4(ip) -> Column:
    """Loopback, private, link-local, carrier and unspecified ranges, compared as numbers."""
    p = [F.get(F.split(col(ip), r"\."), F.lit(i)).cast("int") for i in range(4)]
    return (p[0].isin(0, 10, 127)) | ((p[0] == 172) & p[1].between(16, 31)) | ((p[0] == 192) & (p[1] == 168)) | ((p[0] == 169) & (p[1] == 254)) | ((p[0] == 100) & p[1].between(64, 127)) | (p[0] >= 224)


def private_ipv6(ip) -> Column:
    """Loopback, unspecified, unique-local, link-local and mapped private addresses, as text in any case, with or without brackets."""
    a = F.lower(F.regexp_replace(col(ip), r"^\[|\]$|%.*$", ""))
    mapped = F.regexp_extract(a, r"^(?:0*:)*:?ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    return a.rlike(r"^(?:::1|::|0*(?::0*){6}:0*1?)$") | a.rlike(r"^f[cd][0-9a-f]{0,2}:") | a.rlike(r"^fe[89ab][0-9a-f]?:") | ((mapped != "") & private_ipv4(mapped))


def private_host(host) -> Column:
    """Whether a host must not be fetched: private addresses of both kinds, and local names."""
    h = F.lower(F.regexp_replace(col(host), r"\.$", ""))
    v4 = h.rlike(r"^\d+\.\d+\.\d+\.\d+$")
    return F.when(v4, private_ipv4(h)).when(h.contains(":"), private_ipv6(h)).otherwise((h == "localhost") | h.endswith(".localhost") | h.endswith(".local") | h.endswith(".internal"))


def merge_notes(server, client, base, between: str) -> Column:
    """text and conflict of a note edited on two sides: the side that changed wins, and where both did they are joined. A blank result is null; a null base is unknown."""
    s, c, b = F.trim(F.coalesce(col(server), F.lit(""))), F.trim(F.coalesce(col(client), F.lit(""))), F.trim(col(base))
    text = F.when(s == c, c).when(s == b, c).when(c == b, s).when(s == "", c).when(c == "", s)
    clash = text.isNull()
    return F.struct(F.nullif(F.coalesce(text, F.concat(c, F.lit(between), s)), F.lit("")).alias("text"), clash.alias("conflict"))


def candidate_take(offset: int, limit: int, most: int = 500) -> int:
    """How many candidates a search page needs: the page, one more and some room."""
    return min(most, max(limit + 1, offset + limit + 1 + 50))


def priority_take(offset: int, limit: int, most: int = 500) -> int:
    return min(most, offset + limit + 1)


# The fields that a search of notes and of saved words looks at.
NOTE_FIELDS, WORD_FIELDS = ("quote", "note"), ("word", "explanation", "example", "context")


def time_range(days: int | None, now: str, usual: int = 30, most: int = 365) -> tuple[Column, Column]:
    """The half-open range of the last so many days (1 to `most`, else the usual number) before a time."""
    n = usual if days is None else min(most, max(1, int(days)))
    end = F.lit(now).cast("timestamp_ntz")
    return end - F.make_dt_interval(F.lit(n)), end


def missing_derivation(measure: str, children: list[str]) -> Column:
    """Rows whose measure is null or one of whose child lists is empty or null."""
    return reduce(or_, [F.coalesce(F.size(c), F.lit(0)) <= 0 for c in children], F.col(measure).isNull())


def in_topics(c, topic: str) -> Column:
    """Membership in a JSON array of strings; anything else holds none."""
    return F.coalesce(F.array_contains(F.from_json(col(c), "array<string>"), topic), F.lit(False))


def saved_words(fields: list[str], terms: list[str], due: Column | None = None) -> Column:
    """Words that match the terms; with a due filter that as well, both must hold."""
    match = fields_match(fields, terms) if terms else F.lit(True)
    return match if due is None else match & due


def access_scope(role, own, same_group) -> Column:
    """What a reader may see of another's data: all, group, own or none."""
    return F.when(col(role).isin("admin", "operator"), "all").when((col(role) == "teacher") & col(same_group), "group").when(col(own), "own").otherwise("none")


def listing_card(df: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """The few columns of a listing, an excerpt in place of the text."""
    from marginalia.functions.text import excerpt

    return df.select("id", "title", excerpt("content").alias("excerpt"), "category", "difficulty", *[v.alias(k) for k, v in (extra or {}).items()])


def masked(allowed, c) -> Column:
    """A column only for those allowed to see single persons."""
    return F.when(col(allowed), col(c))


def http_class(status) -> Column:
    s = col(status)
    return F.when(s.isin(401, 403), "auth").when(s == 429, "rate_limit").when(s.isin(408, 504), "timeout").when(s >= 500, "server").when(s >= 400, "client").otherwise("ok")


def bounded_score(c, low: float = 0, high: float = 100) -> Column:
    return col(c).isNotNull() & ~F.isnan(col(c).cast("double")) & (col(c) >= low) & (col(c) <= high)


def readable_sql(user: int | str | None = None, operator: bool = False, alias: str = "a") -> str:
    """The reading rule as a SQL condition for spark.sql, with the user as the parameter :user. Unlike readable(), it doesn't ask that public rows have no owner."""
    if operator:
        return "TRUE"
    public = f"({alias}.status = 'published' AND {alias}.visibility = 'PUBLIC')"
    return public if user is None else f"({public} OR ({alias}.visibility = 'PRIVATE' AND {alias}.owner_id = :user))"


def manageable(user: Column | None = None, admin: bool = False) -> Column:
    """Rows that may be managed: all for an administrator, else a user's own private ones; none without a user."""
    return F.lit(True) if admin else F.lit(False) if user is None else F.coalesce((F.col("owner_id") == user) & (F.col("visibility") == "PRIVATE"), F.lit(False))


def model_readable(user: Column | None = None) -> Column:
    """What a model may be given: published public rows and, for its owner, private ones."""
    return readable(user) & (F.col("status") == "published")


def text_filter(fields: list[str], text: str | None) -> Column:
    """An administrator's free text over some fields: any field that contains it; a blank one filters nothing."""
    return phrase_match(fields, text.strip()) if text and text.strip() else F.lit(True)
