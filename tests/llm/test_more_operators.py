"""Fingerprints, manifests and conversations against brute-force versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marginalia.llm import conversations, golay_simhash, merkle
from tests.llm.test_operators import SPACE, got, lower, sha, want


def components_of(n, pairs):
    top = list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_print(text):
    w = SPACE.findall(lower(text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_keys():
    """A perfect code: each syndrome has one leader, and vectors at distance two or less share a key."""
    assert golay_simhash.KEYS.tolist().count(6) == 1771 and golay_simhash.KEYS.sum() == 2048 + 5 * 1771
    r = np.random.default_rng(5)
    x = r.integers(0, 1 << 23, 3000)
    y = x ^ (1 << r.integers(0, 23, 3000)) ^ (1 << r.integers(0, 23, 3000))
    (a, n), (b, m) = golay_simhash.codes(x), golay_simhash.codes(y)
    assert all(set(a[i, : n[i]]) & set(b[i, : m[i]]) for i in range(len(x)))


def test_buckets_meet_all_links():
    r = np.random.default_rng(6)
    x = r.integers(0, 1 << 64, 4000, np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << r.integers(0, 64, len(y)).astype(np.uint64)
    seen = [set() for _ in x]
    for row, name in zip(*(k.tolist() for k in golay_simhash.buckets(x))):
        seen[row].add(name)
    met = set()
    for row, name in zip(*(k.tolist() for k in golay_simhash.buckets(y))):
        if name in seen[row]:
            met.add(row)
    assert len(met) == len(x)


@pytest.mark.parametrize("seed", range(3))
def test_spread_is_a_forest_of_all_links(seed):
    r = np.random.default_rng(seed)
    layers = [r.integers(0, 1 << 64, 200, np.uint64)]
    for _ in range(5):
        layers.append(layers[-1] ^ np.uint64(1) << r.integers(0, 64, 200).astype(np.uint64) ^ np.uint64(3) << r.integers(0, 62, 200).astype(np.uint64))
    x = np.unique(np.concatenate([*layers, r.integers(0, 1 << 64, 700, np.uint64)]))
    r.shuffle(x)
    all_links = zip(*(k.tolist() for k in np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)))
    at = {v: i for i, v in enumerate(x.tolist())}
    a, b = golay_simhash.spread(x, 4)
    wanted = components_of(len(x), all_links)
    assert components_of(len(x), [(at[u], at[v]) for u, v in zip(a.tolist(), b.tolist())]) == wanted
    assert len(a) == len(x) - len(set(wanted))


@pytest.mark.parametrize("block", [1 << 16, 8])
def test_simhash_components(spark, texts, docs, nothing, block):
    """All rows against all, with buckets whole and with buckets dealt over cells; a chain through a row without an id."""
    prints = [plain_print(t) for _, t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4]
    top = components_of(len(texts), links)
    least = {}
    for (i, _), c in zip(texts, top):
        least[c] = min((k for k in (least.get(c), i) if k is not None), default=None)
    wanted = want([(i, f"{p:016x}", least[c]) for (i, _), p, c in zip(texts, prints, top)])
    found = golay_simhash.cluster(docs, block=block)
    assert got(found, "doc_id", "fingerprint", "component_id") == wanted
    assert any(i is not None and i != least[c] for (i, _), c in zip(texts, top))
    assert golay_simhash.cluster(nothing).count() == 0


def test_cells_of_a_hot_bucket(spark, monkeypatch):
    """Thousands of fingerprints around one: buckets over the block are counted, cut and still connected."""
    monkeypatch.setattr(golay_simhash, "SURVEY", 1)
    r = np.random.default_rng(9)
    x = np.unique(np.concatenate([np.uint64(1) << r.integers(0, 64, 900).astype(np.uint64) | np.uint64(1) << r.integers(0, 64, 900).astype(np.uint64), r.integers(0, 1 << 64, 500, np.uint64)]))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "print long")
    at = {v: i for i, v in enumerate(x.view(np.int64).tolist())}
    pairs = [(at[k["a"]], at[k["b"]]) for k in golay_simhash.links(df, 4, 64).collect()]
    wanted = components_of(len(x), zip(*(k.tolist() for k in np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4))))
    assert components_of(len(x), pairs) == wanted


def plain_manifest(rows):
    """rows: dicts of documents. Builds every tree as lists, and each row's proof by walking them."""
    H = lambda *parts: sha("".join(parts))
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: H(*(enc(r[k]) for k in ("doc_id", "source", "lang", "n_chars")), enc(t))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def climb(levels, i, at):
        proof = ""
        for level in levels[:-1]:
            run = level[i // 16 * 16 : i // 16 * 16 + 16]
            left, right = "".join(run[: i % 16]), "".join(run[i % 16 + 1 :])
            at, proof, i = H(left, at, right), proof + left + right, i // 16
        return at, proof

    first = lambda v: (v is not None, v if v is not None else 0)
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r["source"] == s), key=lambda r: (first(r["doc_id"]), leaf(r, r["text"]))) for s in sources]
    lows = [tree([leaf(r, r["text"]) for r in g]) for g in groups]
    high = tree([low[-1][0] for low in lows])
    out = []
    for k, (g, low) in enumerate(zip(groups, lows)):
        for i, r in enumerate(g):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            start = leaf(r, lower(r["text"]) if hit and r["text"] is not None else r["text"])
            at, proof = climb(low, i, start)
            at, more = climb(high, k, at)
            out.append((r["doc_id"], low[0][i], low[-1][0], high[-1][0], sha(proof + more), at, at == high[-1][0]))
    return out


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (17, 16, 257, 1, 2), (1,) * 40])
def test_manifest(spark, sizes):
    """Sources of one row, whole and broken runs, several levels, many sources; nulls, ties and repeats."""
    r, rows = random.Random(8), []
    for k, n in enumerate(sizes):
        for i in range(n):
            rows.append({"doc_id": len(rows) // 2 if k == 2 else len(rows), "source": None if k == 0 else "" if k == 1 else f"s{k}é", "lang": r.choice(["en", None]), "n_chars": r.choice([7, None]), "text": r.choice(["Some Text", "ÄB c", "", None, "x" * 5000])})
    rows[0]["doc_id"] = None
    rows.append(dict(rows[-1]))
    docs = spark.createDataFrame([(*x.values(), "t", 3) for x in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, i int")
    assert got(merkle.manifest(docs), *MANIFEST) == want(plain_manifest(rows))


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).count() == 0


def plain_repair(turns):
    """Every way to edit: turns are (role, text, fault); returns the least (cost, audit) and its repaired turns."""
    legal = re.compile(r"(s?(ua)+)?").fullmatch
    best, ways = None, []
    for ops in itertools.product("KRD", repeat=len(turns)):
        options, cost = [], 0
        for op, (role, text, fault) in zip(ops, turns):
            if op == "D":
                cost += 4
                options.append([("D", None, None)])
            else:
                if fault in ("b", "d"):
                    break
                cost += 3 * (fault == "t") + 3 * (op == "R")
                options.append([(op, role, text)] if op == "K" else [("R", "user", text), ("R", "assistant", text)])
        else:
            ways.append((cost, options))
    for cost, options in ways:
        for chosen in itertools.product(*options):
            for gaps in itertools.product(range(3), repeat=len(chosen) + 1):
                if cost + 3 * sum(gaps) > (best[0] if best else 99) or sum(gaps) > 3:
                    continue
                for names in itertools.product(("user", "assistant"), repeat=sum(gaps)):
                    names, steps = list(names), []
                    for g, step in zip(gaps, [*chosen, None]):
                        steps += [("I", names.pop(), "") for _ in range(g)] + ([step] if step else [])
                    kept = [(role, text) for op, role, text in steps if op != "D"]
                    if legal("".join(role[:1] or "?" for role, _ in kept)):
                        way = (cost + 3 * sum(gaps), "".join(op for op, _, _ in steps), "\n".join(f"{role}:{text}" for role, text in kept))
                        best = min(best, way) if best else way
    return best


def test_repair_against_every_edit():
    """All conversations of up to three turns, and some of four."""
    r = random.Random(2)
    kinds = [(role, f) for role in ("system", "user", "assistant", "tool") for f in "obt"]
    cases = [c for n in range(3) for c in itertools.product(kinds, repeat=n)] + [tuple(r.choice(kinds) for _ in range(n)) for n in [3] * 60 + [4] * 12]
    codes = {"o": conversations.SOUND, "b": conversations.BLANK, "t": conversations.CUT}
    for case in cases:
        wanted = plain_repair([(role, str(i), f) for i, (role, f) in enumerate(case)])
        cost, audit = conversations.repair(bytes(ord(role[0]) for role, _ in case), bytes(codes[f] for _, f in case))
        assert (cost, audit) == wanted[:2], case
        written = conversations._Written(audit)
        for i, (role, _) in enumerate(case):
            written.add(role, str(i))
        assert written.digest() == sha(wanted[2]), case


def test_conversations(spark):
    """Damage, faults and counts in plain code; the edits by the operator's own program, which the test above holds against every edit."""
    r, rows = random.Random(4), []
    for conv in [*range(60), None]:
        for turn in sorted(r.choice([0, 1, 2, 3, 5, None]) or 0 for _ in range(r.randrange(1, 7))):
            rows.append((conv, r.choice([turn, turn, turn, None]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), r.choice(["Fine.", "Cut", " \n", "", None, "Done! \t", "No?\nmore", "é" * 3000 + "."])))
    rows += rows[:5]
    wanted = []
    for conv in {c for c, *_ in rows}:
        now = []
        for c, turn, role, text in (x for x in rows if x[0] == conv):
            fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            now += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        now.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, faults = set(), []
        for _, role, text in now:
            body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append(conversations.BLANK if not body else conversations.DUPLICATE if (role, text) in seen else conversations.CUT if body[-1] not in ".!?" else conversations.SOUND)
            seen.add((role, text))
        turns = [t for t, *_ in now if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(now, now[1:]))
        cost, audit = conversations.repair(bytes(ord(x[1][0]) if x[1] else 0 for x in now), bytes(faults))
        written = conversations._Written(audit)
        for _, role, text in now:
            written.add(role, text)
        wanted.append((conv, gaps, *(faults.count(k) for k in (conversations.BLANK, conversations.DUPLICATE, conversations.CUT)), illegal, cost, audit, written.digest()))
    df = spark.createDataFrame([(*x, 1, "p") for x in rows], "conv_id long, turn long, role string, text string, pos int, fault string")
    columns = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert got(conversations.repaired(df.repartition(3)), *columns) == want(wanted)
    assert conversations.repaired(df.where("conv_id = -1")).count() == 0
    gone = spark.createDataFrame([(c, 0, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2], "conv_id long, turn long, role string, text string")
    assert [tuple(x)[1:] for x in conversations.repaired(gone).collect()] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] * 2


def test_a_long_conversation(spark):
    """Time and memory in proportion to the turns: one conversation of 30,000."""
    rows = spark.range(30_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("id"), F.lit(".")).alias("text"))
    row = conversations.repaired(rows).first()
    assert len(row["audit"]) >= 25_000 and row["cost"] > 0
