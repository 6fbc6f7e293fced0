"""Repairs the turn structure of conversations: which turns to keep, rerole, delete or insert, at the least cost.

The repaired roles are an optional system turn and pairs of user and assistant. A dynamic program runs over the retained
subsequence from the last turn to the first: what a turn retained in a role costs with everything behind it is its own cost, the deletions up
to the next retained turn (a difference of prefix sums), the inserts that the two roles need, and that turn's own least cost.
For each role before, the least of those is a running minimum, so a turn takes constant time.
Of edits that cost the same the least in ASCII order wins. Deletes sort first, so the wider gap wins; then more inserts;
then Keep before Rerole: no edits have to be compared as strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import materialise, table
from marginalia.llm.merkle import CRC_TABLE_SQL, crc_sql

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SYSTEM, USER, ASSISTANT, START = range(4)
INITIALS = "sua"
ROLES = ("system", "user", "assistant")
#: Inserts between a role (or the start) and the next retained one: None where no inserts lead there; and after the last role.
BETWEEN = ((None, 0, 1), (None, 1, 0), (None, 0, 1), (0, 0, 1))
AFTER = (2, 1, 0, 0)
SOUND, BLANK, DUPLICATE, CUT, DROPPED = range(5)
NOT_SPACE = r"[^\x20\x09-\x0D]"
ENDS = r"(?s)[.!?][\x20\x09-\x0D]*\z"
LEGAL = frozenset(("su", "ua", "au"))
OPS = "conv_id long, pos long, role string, text string"


def repair(initials: bytes, faults: bytes) -> tuple[int, str]:
    """The least cost and the edits' initials for turns with the given role initials and faults; 2 bytes of memory a turn."""
    n = len(faults)
    least = [(DELETE * n + INSERT * AFTER[r]) for r in range(4)]  # offset by DELETE for each turn before the next retained one
    takes = bytearray(n)  # for each of four roles before, two bits: 0 delete, else the role taken + 1
    for i in range(n - 1, -1, -1):
        fault = faults[i]
        if fault == BLANK or fault == DUPLICATE:
            continue
        own = INITIALS.find(chr(initials[i]))
        extra = (TRUNCATED if fault == CUT else 0) - DELETE
        ways = [(r, least[r] + extra + (0 if r == own else REROLE)) for r in ((SYSTEM, USER, ASSISTANT) if own == SYSTEM else (USER, ASSISTANT))]
        best, take = least[:], 0
        for before in range(4):
            found = None
            for r, cost in ways:
                q = BETWEEN[before][r]
                if q is not None:
                    way = (cost + INSERT * q, -q, r != own, r)
                    if found is None or way < found:
                        found = way
            if found and found[0] < least[before]:
                best[before] = found[0]
                take |= (found[3] + 1) << 2 * before
        least, takes[i] = best, take
    ops, role = [], START
    for i in range(n):
        r = (takes[i] >> 2 * role & 3) - 1
        if r < 0:
            ops.append("D")
        else:
            ops.append("I" * BETWEEN[role][r] + ("K" if INITIALS.find(chr(initials[i])) == r else "R"))
            role = r
    return least[START], "".join(ops) + "I" * AFTER[role]


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage (conv_id, turn, role, text, dropped): null roles and texts are one space; dropped rows stay as marks without text."""
    shown = [F.coalesce(rows[c].cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fate = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    text = F.coalesce(rows["text"], F.lit(" "))
    text = F.when(fate <= 1, F.lit("")).when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(fate == 4, F.lit("user")).otherwise(F.coalesce(rows["role"], F.lit(" ")))
    copies = F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), role.alias("role"), text.alias("text"), (fate == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def faulted(rows: DataFrame) -> DataFrame:
    """Adds pos, the place in the conversation (by turn, nulls first, then role and text), and the first fault of each row; one shuffle by conversation."""
    turn = F.col("turn").asc_nulls_first()
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("dropped", turn, "role", "text")).cast("long")
    nth = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("pos"))
    fault = F.when(F.col("dropped"), DROPPED).when(~F.col("text").rlike(NOT_SPACE), BLANK).when(nth > 1, DUPLICATE).when(~F.col("text").rlike(ENDS), CUT).otherwise(SOUND)
    return rows.withColumn("pos", pos).withColumn("fault", fault.cast("int")).drop("dropped")


class _Turns:
    """What is kept of a conversation while its rows pass by: two bytes a turn and a few numbers."""

    def __init__(self):
        self.initials, self.faults = bytearray(), bytearray()
        self.low = self.high = self.last = None
        self.turns = self.illegal = 0
        self.before = ""

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if fault == DROPPED:
            return
        if self.faults and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        self.initials.append(ord(initial) if initial in INITIALS and initial else 0)
        self.faults.append(fault)
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last
            self.high = self.last = turn

    def row(self) -> dict:
        cost, audit = repair(bytes(self.initials), bytes(self.faults))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, "blank": self.faults.count(BLANK), "duplicate": self.faults.count(DUPLICATE), "truncated": self.faults.count(CUT), "illegal": self.illegal, "cost": cost, "audit": audit}


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
SCHEMA = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])


def _judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from (conv_id, turn, initial, fault) sorted by conversation and pos."""
    now, found, out = None, None, []
    for batch in batches:
        for conv, turn, initial, fault in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if found is None or conv != now:
                if found is not None:
                    out.append({"conv_id": now} | found.row())
                now, found = conv, _Turns()
            found.add(turn, initial, fault)
        if out:
            yield pa.RecordBatch.from_pylist(out, SCHEMA)
            out = []
    if found is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": now} | found.row()], SCHEMA)


class _Written:
    """The repaired conversation as it is written: a running hash and the place in its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.role, self.first, self.hash = audit, 0, START, True, hashlib.sha256()

    def write(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def due(self) -> int:
        return ASSISTANT if self.role == USER else USER

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.role, self.at = self.due(), self.at + 1
            self.write(ROLES[self.role], "")

    def add(self, role: str, text: str) -> None:
        self.inserts()
        op, self.at = self.audit[self.at], self.at + 1
        if op != "D":
            self.role = self.due() if op == "R" else INITIALS.index(role[0])
            self.write(ROLES[self.role] if op == "R" else role, text)

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def _write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id and the repaired hash, from rows sorted by conversation and pos, each led by a row at pos 0 with its audit as text."""
    now, written = None, None
    for batch in batches:
        done: tuple[list, list] = ([], [])
        for conv, pos, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if pos == 0:
                if written:
                    done[0].append(now)
                    done[1].append(written.digest())
                now, written = conv, _Written(text)
            else:
                written.add(role, text)
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.string())], ["conv_id", "repaired_sha256"])
    if written:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([written.digest()])], ["conv_id", "repaired_sha256"])


def sorted_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(*keys)


def repaired(rows: DataFrame) -> DataFrame:
    """One row for every conv_id (null is one): gaps, faults, cost, audit and the hash of the repaired turns.

    Null roles and texts are one space, as are null ids and turns where the damage is drawn. Rows of one turn are
    ordered by role, then text; equal rows are duplicates after the first. A role with another initial than s, u or a
    can't be kept, only reroled or deleted. Texts of any length are passed through; an empty table gives no rows; other columns are passed over.
    A conversation is a sequence: its rows stream through one task, which keeps two bytes a turn (and the audit), never the texts.
    """
    found = materialise(faulted(damaged(rows)), "turns")
    codes = sorted_by(found.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "pos"), "conv_id", "pos").drop("pos")
    judged = materialise(codes.mapInArrow(_judge, f"conv_id long, {SUMMARY}"), "judged")
    led = found.where(F.col("fault") != DROPPED).select("conv_id", "pos", "role", "text").unionByName(judged.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text")))
    hashes = sorted_by(led, "conv_id", "pos").mapInArrow(_write, "conv_id long, repaired_sha256 string")
    return judged.join(hashes, judged["conv_id"].eqNullSafe(hashes["conv_id"])).drop(hashes["conv_id"])


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


def _best(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _emit(state: str, role: str) -> str | None:
    """The automaton over role initials: o nothing yet, s a system turn alone, u, a the last role."""
    return {"os": "s", "ou": "u", "su": "u", "ua": "a", "au": "u"}.get(state + role)


def _row_sql(state: str) -> str:
    """The least (cost, edits) from a turn on without an insert before it, by the states after it."""
    ways = [f"{{'c': n.{state}.c + 4, 'e': 'D' || n.{state}.e}}"]
    for role in INITIALS:
        after = _emit(state, role)
        if after:
            ways.append(f"{{'c': CASE WHEN can AND ini = '{role}' THEN n.{after}.c + cut ELSE 1000000000 END, 'e': 'K' || n.{after}.e}}")
            if role != "s":
                ways.append(f"{{'c': CASE WHEN can THEN n.{after}.c + cut + 3 ELSE 1000000000 END, 'e': 'R' || n.{after}.e}}")
    return _best(*ways)


def _insert_sql(state: str) -> str:
    """The least with up to two inserts before the turn."""
    one = "a" if state == "u" else "u"
    two = "a" if one == "u" else "u"
    return _best(f"m.{state}", f"{{'c': m.{one}.c + 3, 'e': 'I' || m.{one}.e}}", f"{{'c': m.{two}.c + 6, 'e': 'II' || m.{two}.e}}")


#: The plain dynamic program over turns and states, with edits compared as strings.
ORACLE_SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate FROM conversations, crc),
dam AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) copies),
ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
p AS (SELECT c, turn, role, text, left(role, 1) AS ini, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM dam JOIN ids ON dam.conv_id IS NOT DISTINCT FROM ids.conv_id),
f AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault, lag(ini) OVER (PARTITION BY c ORDER BY i) || ini AS pair FROM p),
s AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(i) AS n FROM ids LEFT JOIN f USING (c) GROUP BY c),
n(c, i, o, s, u, a) AS (
  SELECT c, n, {{'c': 0, 'e': ''}}, {{'c': 6, 'e': 'II'}}, {{'c': 3, 'e': 'I'}}, {{'c': 0, 'e': ''}} FROM s UNION ALL
  SELECT c, i, {", ".join(_insert_sql(q) for q in "osua")} FROM (
    SELECT n.c, n.i - 1 AS i, {", ".join(f"{_row_sql(q)} AS {q}" for q in "osua")}
    FROM n JOIN (SELECT *, fault NOT IN ('b', 'd') AS can, CASE fault WHEN 't' THEN 3 ELSE 0 END AS cut FROM f) f ON f.c = n.c AND f.i = n.i) m),
best AS (SELECT c, o.c AS cost, o.e AS audit FROM n WHERE i = 0),
e AS (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS k FROM best),
g AS (SELECT c, k, audit[k] AS op, length(replace(audit[:k], 'I', '')) AS i, length(replace(audit[:k], 'D', '')) AS kept FROM e WHERE audit[k] <> 'D'),
h AS (SELECT g.*, f.role, f.text, coalesce(bool_or(op = 'K' AND ini = 's') OVER (PARTITION BY g.c), false) AS led FROM g LEFT JOIN f ON f.c = g.c AND f.i = g.i AND op <> 'I'),
t AS (
  SELECT c, string_agg(CASE WHEN op = 'K' THEN role WHEN (kept - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE op WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS repaired
  FROM h GROUP BY c)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost::BIGINT AS cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM ids JOIN s USING (c) JOIN best USING (c) LEFT JOIN t USING (c)
"""
