"""Each operator against a brute-force version; nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marginalia.llm import anchors, decontamination, jaccard_join, line_dedup, metric_tree, packing, pii, ppm, quality, suffix_dedup, tokens, wavelet
from marginalia.llm.common import shared_path

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=lambda x: tuple((v is not None, v) if not isinstance(v, list) else (True, str(v)) for v in x))


def want(rows):
    return sorted(rows, key=lambda x: tuple((v is not None, v) for v in x))


@pytest.mark.parametrize("window,gram", [(40, 12), (200, 48)])
def test_suffix_dedup(docs, texts, nothing, window, gram):
    data = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(t[k : k + window] for _, t in data for k in range(len(t) - window + 1))
    rows = []
    for i, t in data:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k : k + window] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        rows.append((i, len(t), int(gone.sum()), spans, sha(kept)))
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    for split_bytes in (suffix_dedup.SPLIT_BYTES, 0):
        assert got(suffix_dedup.dedup(docs, window, gram, keep_first=False, split_bytes=split_bytes), *columns) == want(rows)
    assert suffix_dedup.dedup(nothing, window, gram).count() == 0


def test_suffix_dedup_keeps_the_first(spark):
    passage = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, f"start {passage}"), (2, f"{passage} end")], "doc_id long, text string")
    kept = {r["doc_id"]: bytes(r["kept"]).decode() for r in suffix_dedup.dedup(docs).collect()}
    assert kept[1] == f"start {passage}" and len(kept[2]) < 10


def test_suffix_dedup_of_repeated_rows(spark):
    """Rows that equal the first in id and text are kept with it; an equal text of another id goes."""
    passage = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, passage), (1, passage), (2, f"{passage} end"), (2, f"{passage} end"), (3, passage), (None, "x"), (None, "x")], "doc_id long, text string")
    for split_bytes in (suffix_dedup.SPLIT_BYTES, 0):
        made = got(suffix_dedup.dedup(docs, split_bytes=split_bytes), "doc_id", "n_removed")
        assert made == [(None, 0), (None, 0), (1, 0), (1, 0), (2, len(passage)), (2, len(passage)), (3, len(passage))]
    assert {r["n_removed"] for r in suffix_dedup.dedup(docs.where("doc_id < 3"), keep_first=False).collect()} == {len(passage), len(passage) + 4}


@pytest.mark.parametrize("window,gram,keep_first", [(40, 12, False), (40, 12, True), (200, 48, False)])
def test_suffix_dedup_of_periods(spark, window, gram, keep_first):
    """Lines repeated inside one document, of each period from gram to window + 2."""
    r = np.random.default_rng(11)
    prose = lambda n: bytes(r.integers(97, 123, n, np.uint8)).decode()
    texts = [(p, prose(window) + (prose(p - 1) + "\n") * 5 + prose(window)) for p in range(gram, window + 3)]
    seen = Counter(t[k : k + window] for _, t in texts for k in range(len(t) - window + 1))
    rows, before = [], set()
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - window + 1):
            w = t[k : k + window]
            if w in before if keep_first else seen[w] > 1:
                gone[k : k + window] = True
            before.add(w)
        rows.append((i, int(gone.sum()), sha("".join(c for c, g in zip(t, gone) if not g))))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for split_bytes in (suffix_dedup.SPLIT_BYTES, 0):
        assert got(suffix_dedup.dedup(docs, window, gram, keep_first, split_bytes), "doc_id", "n_removed", "kept_sha256") == want(rows)


@pytest.mark.parametrize("keep_first", [False, True])
def test_suffix_dedup_of_a_common_line(spark, keep_first):
    """One line in all documents, with neighbours that are unlike, alike on one side, or alike on both."""
    r = np.random.default_rng(3)
    prose = lambda n: bytes(r.integers(97, 123, n, np.uint8)).decode()
    line, left, right = prose(180), [prose(60) for _ in range(12)], [prose(60) for _ in range(12)]
    some = lambda known: known[r.integers(len(known))] if r.random() < 0.5 else prose(60)
    texts = [(i, prose(int(r.integers(0, 80))) + some(left) + line + some(right) + prose(20)) for i in range(300)]
    seen, rows, before = Counter(t[k : k + 200] for _, t in texts for k in range(len(t) - 199)), [], set()
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            w = t[k : k + 200]
            if w in before if keep_first else seen[w] > 1:
                gone[k : k + 200] = True
            before.add(w)
        rows.append((i, int(gone.sum()), sha("".join(c for c, g in zip(t, gone) if not g))))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    for split_bytes in (0, 1 << 14):
        assert got(suffix_dedup.dedup(docs, keep_first=keep_first, split_bytes=split_bytes), "doc_id", "n_removed", "kept_sha256") == want(rows)


def test_suffix_dedup_cuts_a_hot_hash():
    """A line of 180 bytes with unlike neighbours: no part meets many others."""
    r = np.random.default_rng(4)
    line = r.integers(97, 123, 180).astype(np.uint8)
    texts = [np.concatenate((r.integers(97, 123, 150), line, r.integers(97, 123, 150))).astype(np.uint8) for _ in range(2000)]
    raw, offsets = np.concatenate(texts), np.arange(2001) * 480
    text, start, count, h, *_ = anchors.runs(raw, offsets, 200, 48)
    names, sizes = np.unique(h, return_counts=True)
    hot = h == names[sizes.argmax()]
    assert sizes.max() > 1500
    owner, at, number, key, _, _ = anchors.parts(raw, start[hot], count[hot] + 199, 200, 48, 16)
    assert np.bincount(owner, number).tolist() == count[hot].tolist() and np.unique(key, return_counts=True)[1].max() < 5


@pytest.mark.parametrize("window", [5, 8, 20, 40])
def test_longest_factors_agree_with_all_pairs(window):
    r = np.random.default_rng(window)
    for letters in (1, 2, 4):
        raw = r.integers(97, 97 + letters, 150, np.uint8)
        raw[90:120] = raw[10:40]
        starts = np.sort(r.choice(150 - window + 1, 90, replace=False))
        order, common = suffix_dedup.suffix_order(raw, starts, window)
        text = raw.tobytes()
        cut = [text[k : k + window] for k in starts.tolist()]
        assert [cut[k] for k in order] == sorted(cut)

        def shared(i, j):
            return next((k for k in range(window) if cut[i][k] != cut[j][k]), window)

        for later in (False, True):
            found = suffix_dedup.longest_factors(order, common, later)
            assert found.tolist() == [max((shared(i, j) for j in (range(i + 1, len(cut)) if later else range(i))), default=0) for i in range(len(cut))]


def test_ppm(docs, texts, nothing):
    found = ppm.score(docs).collect()
    bag, tokens = Counter(), []
    for i, t in texts:
        words = [*SPACE.findall(lower(t or "")), None]
        held = i is None or zlib.crc32(str(i).encode()) % 10 == 0
        tokens.append((i, held, words))
        if not held:
            bag.update(words)
    n, v = sum(bag.values()), len(bag)
    rows = [(i, held, len(w), sum(x in bag for x in w), n, round(sum(math.log10((bag[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)) for i, held, w in tokens]
    assert want([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in found]) == want(rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)
    assert ppm.score(nothing).count() == 0


def brute_ppm(train, text):
    """log10 probability by escape method C with exclusion of the symbols of the longer context, from plain dictionaries."""
    tables = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    for t in train:
        whole = [256] * ppm.ORDER + list(t) + [256]
        for i in range(ppm.ORDER, len(whole)):
            for k in range(ppm.ORDER + 1):
                tables[k][tuple(whole[i - k : i])][whole[i]] += 1
    whole, total = [256] * ppm.ORDER + list(text) + [256], 0.0
    for i in range(ppm.ORDER, len(whole)):
        out = set()
        for k in range(ppm.ORDER, -1, -1):
            seen = tables[k].get(tuple(whole[i - k : i]))
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in out}
            room = sum(left.values()) + len(left)
            if whole[i] in left:
                total += math.log10(left[whole[i]] / room)
                break
            total += math.log10(len(left) / room) if left else 0.0
            out = set(seen)
        else:
            total -= math.log10(257 - len(tables[0].get((), ())))
    return total


def test_ppm_scores_against_plain_dictionaries(docs, texts):
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    train = [(t or "").encode() for i, t in texts if not held(i)]
    found = sorted((str(r["doc_id"]), round(r["score"], 4)) for r in ppm.score(docs).select("doc_id", "score").collect() if r["doc_id"] not in (8, 103))
    assert found == sorted((str(i), round(brute_ppm(train, (t or "").encode()), 4)) for i, t in texts if i not in (8, 103))


def test_ppm_is_a_probability():
    """After any context the probabilities of all symbols add up to one, exclusion included."""
    text = b"abracadabra abracad abrac"
    grams, first, last = ppm.symbols(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    whole = grams[first[0] : last[0]]
    trie = ppm.Trie({k: tuple(np.unique(whole & np.uint64((1 << ppm.BITS * k) - 1), return_counts=True)) for k in range(1, ppm.ORDER + 2)})
    for context in (b"abrac", b"zzzzz", b"cabra", b"zabra"):
        head = 0
        for b in context:
            head = head << ppm.BITS | b
        p = 10 ** trie.log10(np.array([head << ppm.BITS | s for s in range(ppm.SYMBOLS)], np.uint64))
        assert abs(p.sum() - 1) < 1e-9


def test_ppm_keeps_rare_contexts(spark):
    """Scores follow from the counts of all contexts, here 2.6 million grams of 3 to 6 symbols that mostly occur once."""
    letters = np.frombuffer(bytes(range(48, 112)), np.uint8)
    r = np.random.default_rng(7)
    texts = [(i, bytes(letters[r.integers(0, 64, 80_000)]).decode()) for i in range(11)] + [(None, "AB")]
    texts[10] = 10, texts[2][1][:50_000] + texts[3][1][:3000]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts]
    whole = []
    for _, t in texts:
        grams, first, last = ppm.symbols(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        whole.append(grams[first[0] : last[0]])
    learnt = np.concatenate([g for g, out in zip(whole, held) if not out])
    counts = {k: tuple(np.unique(learnt & np.uint64((1 << ppm.BITS * k) - 1), return_counts=True)) for k in range(1, ppm.ORDER + 2)}
    assert sum(len(counts[k][0]) for k in range(3, 7)) > 2_000_000
    trie = ppm.Trie(counts)
    found = {r["doc_id"]: r["score"] for r in ppm.score(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for (i, _), grams in zip(texts, whole):
        assert found[i] == pytest.approx(trie.log10(grams).sum(), rel=1e-9)


def brute_windows(texts, bench):
    wins = defaultdict(set)
    for item, t in bench:
        w = WORD.findall(lower(t or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])].update([str(item)] if item is not None else [])
    rows = []
    for i, t in texts:
        w = WORD.findall(lower(t or ""))
        hit, items = set(), set()
        for win, names in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    items |= names
        rows.append((i, len(w), len(hit), sorted(items)))
    return rows


@pytest.mark.parametrize("most", [decontamination.BROADCAST_WINDOWS, 0])
def test_decontamination(spark, docs, texts, nothing, most):
    by = dict(texts)
    bench = [(1, " ".join(by[20].split()[:15])), (2, "One, TWO"), (3, None), (4, ""), (5, by[6]), (12, "One two"), (None, "aa")]
    table = spark.createDataFrame([(i, t, 3) for i, t in bench], "item_id long, text string, row int")
    found = decontamination.report(docs, table, most=most)
    assert want([(r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in found.collect()]) == want([(i, n, h, ",".join(s)) for i, n, h, s in brute_windows(texts, bench)])
    bad = {i for i, _, h, _ in brute_windows(texts, bench) if h}
    left = decontamination.remove_documents(docs, table)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == ({i for i, _ in texts} - bad) | {None}
    cut = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(docs, table).collect()}
    assert not WORD.findall(lower(cut[15])) and cut[21] == by[21]
    assert decontamination.report(nothing, table, most=most).count() == 0
    assert all(r["n_hit"] == 0 for r in decontamination.report(docs, table.limit(0), most=most - 1).collect())


@pytest.mark.parametrize("most", [decontamination.BROADCAST_WINDOWS, 0])
def test_decontamination_of_a_very_long_text(spark, most):
    """500,000 words with one passage at the end."""
    passage = " ".join(f"p{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "lorem ipsum dolor sit amet " * 100_000 + passage), (2, passage)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, passage)], "item_id long, text string")
    assert got(decontamination.report(docs, bench, most=most), "doc_id", "n_words", "n_hit") == [(1, 500_030, 30), (2, 30, 30)]


def test_decontamination_by_shuffle_grows_in_proportion(spark):
    """Twice the words of a text give twice the bytes shuffled, as no probe carries its text."""
    bench = spark.createDataFrame([(i, " ".join(f"b{i}x{k}" for k in range(20))) for i in range(50)], "item_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    sent = []
    try:
        for words in (20_000, 80_000):
            docs = spark.createDataFrame([(i, " ".join(f"w{i}y{k}" for k in range(words))) for i in range(4)], "doc_id long, text string").repartition(4)
            decontamination.report(docs, bench, most=0).write.format("noop").mode("overwrite").save()
            tracker = spark._jsparkSession.sharedState().statusStore()
            last = max((tracker.executionsList().apply(k) for k in range(tracker.executionsList().size())), key=lambda e: e.executionId())
            values = tracker.executionMetrics(last.executionId())
            names = {m.accumulatorId(): m.name() for m in (last.metrics().apply(k) for k in range(last.metrics().size()))}
            total = 0
            for key, name in names.items():
                if name == "shuffle bytes written" and values.contains(key):
                    size = re.match(r"(?:total.*\n)?([0-9.,]+) (B|KiB|MiB|GiB)", values.apply(key))
                    total += float(size[1].replace(",", "")) * {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30}[size[2]]
            sent.append(total)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sent[0] > 10_000 and sent[1] < 6 * sent[0], sent


def test_decontamination_by_broadcast_takes_time_in_proportion(spark):
    """Twice the words of one text take at most 2.2 times the time, as no probe carries its text."""
    bench = spark.createDataFrame([(i, " ".join(f"b{i}x{k}" for k in range(20))) for i in range(50)], "item_id long, text string")
    took = []
    for words in (1_000, 1_000, 200_000, 400_000):
        docs = spark.createDataFrame([(0, " ".join(f"w{k}" for k in range(words)))], "doc_id long, text string")
        began = time.time()
        decontamination.report(docs, bench).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[3] - took[1] < 2.2 * (took[2] - took[1]) + 2, took


def test_decontamination_checks_the_bytes_it_broadcasts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, "one two three four five six seven eight nine ten") for i in range(200)], "item_id long, text string")
    plain = got(decontamination.report(docs, bench), "doc_id", "n_hit")
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(decontamination, "hits_by_broadcast", None)
    assert got(decontamination.report(docs, bench), "doc_id", "n_hit") == plain == [(1, 10)]


def brute_spans(text):
    def luhn(d):
        return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(int(c) for c in reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]


PRIVATE = [
    "mail a.b+c@x-y.co.uk, d@e, @f.g or h@i..j k@l.m.", "ip 1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8 v1.2.3", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 or 41111111111111111111",
    "call +1 (555) 010-9999. or +44 20 7946 0958 now, +123, (555) 123-4567 too", "++1 234 5678 +1-2-3-4-5-6-7-8 é +33.1.23.45.67.89", None, "", "4111\n1111 1111 1111 1111 1111", "é@ü.de a@b.c퟿",
]


def test_pii(spark, nothing):
    docs = spark.createDataFrame([(i, t, "x") for i, t in [*enumerate(PRIVATE), (None, PRIVATE[0]), (0, PRIVATE[0])]], "doc_id long, text string, spans string")
    assert pii.find(docs).where("doc_id is null or doc_id = 0").select("spans").distinct().count() == 1
    found = {r["doc_id"]: r for r in pii.find(docs).collect()}
    for i, t in enumerate(PRIVATE):
        base = brute_spans(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert found[i]["base_sha256"] == sha(text), (t, text, found[i]["spans"])
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [sum(x == k for x, _, _ in base) for k in pii.KINDS]
        assert set(filter(None, text.split(","))) <= set(found[i]["spans"].split(","))
    assert found[3]["n_added"] >= 1  # a number without a country's code is the model's find
    assert "<email>" in pii.redact(docs).where("doc_id = 0").first()["text"]
    assert pii.find(nothing).count() == 0


def test_base_spans_of_random_texts():
    r = np.random.default_rng(8)
    for alphabet in ("a1.@-_ +", "01.2 -+(", "a@.b", "5.6.7@+"):
        for _ in range(1500):
            text = "".join(r.choice(list(alphabet), int(r.integers(0, 40))))
            assert sorted(pii.base_spans(text)) == sorted((pii.KINDS.index(k), a, b) for k, a, b in brute_spans(text)), text


@pytest.mark.parametrize("text", ["7" * 1_000_000, "a" * 1_000_000 + "@!", "+1" + "(" * 1_000_000, "1.2.3 " * 170_000, "me@x.org, " * 100_000, "a." * 500_000 + "@", "@" * 1_000_000, "+1 555 010 9999; 1.2.3.4 " * 40_000])
def test_pii_takes_time_in_proportion(text):
    """A megabyte takes seconds; a pattern that starts anew at every character would take most of an hour."""
    began = time.time()
    base = pii.base_spans(text)
    assert time.time() - began < 20
    if len(base) < 1000:
        assert pii.base_spans(text[:2000]) == [x for x in base if x[2] <= 1990] or len(base) == 0


def test_pii_of_a_long_table(spark):
    """Known and added spans by the thousand in one text."""
    text = "(555) 123-4567 12, a1@x.org and " * 2000
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_email"] == 2000 and row["n_added"] >= 1990


def test_pii_in_long_runs():
    """A number is found wherever it stands in a run of chunks with digits, however long the run is."""
    model = pii.train(pii.examples())
    phone = "(555) 123-4567"
    for filler in ("12, ", "a1 "):
        for pad in [*range(40, 110), 2000]:
            text = filler * pad + phone + " " + filler * 3
            at = len(filler) * pad
            assert (3, at, at + len(phone)) in pii.added_spans(model, [text], [pii.base_spans(text)])[0], (filler, pad)


def test_viterbi_is_the_best_path():
    model, r = pii.train(pii.examples(each=3), steps=5), np.random.default_rng(2)
    e = r.normal(size=(4, len(pii.LABELS)))
    best, top = None, -np.inf
    for path in np.ndindex(*[len(pii.LABELS)] * 4):
        s = pii.START[path[0]] + sum(e[t, p] for t, p in enumerate(path)) + sum(model.move[a, b] for a, b in zip(path, path[1:]))
        if s > top:
            best, top = path, s
    assert tuple(model.decode([e])[0]) == best


def encoded(texts, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [end]) for i, t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_ids_of_odd_characters():
    """Ids equal the tokenizer's for all characters up to U+2FFF beside others, and for mixes of spaces, controls and symbols."""
    code, plain = tokens.ChunkEncoder(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    r = np.random.default_rng(3)
    texts = [f"{a}{chr(c)}{b}" for c in range(0x3000) for a, b in (("", ""), ("a", "b"), ("!", "1"), ("- ", " x"))]
    odd = [chr(c) for c in [*range(0x30), 0x3C, 0x7C, 0x7F, 0x85, 0xA0, 0xC0, 0xE9, 0x301, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000, 0xFEFF, 0x1F600]] + list("\x1c\x1d\x1e\x1f\x1c\x1d" + "aZ9'sé")
    texts += ["".join(r.choice(odd, int(r.integers(1, 12)))) for _ in range(20_000)] + ["<\x1ca", "!\x1c", "x.\x1f\x1fy", "-\x1d-"]
    ids, edges = code.encode(pa.array(texts, pa.string()))
    for k, found in enumerate(plain.encode_batch(texts, add_special_tokens=False)):
        assert ids[edges[k] : edges[k + 1]].tolist() == found.ids, ascii(texts[k])


def test_wavelet(spark, docs, texts, nothing):
    path = shared_path(spark, "wavelet")
    wavelet.write(docs, path, file_tokens=500)
    rows, at = [], 0
    for i, ids in sorted(encoded(texts, 2), key=lambda x: (x[0] is not None, x[0])):
        rows.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert got(wavelet.read(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == want(rows)
    token = encoded(texts, 2)[14][1][0]
    places = [(i, k) for i, ids in encoded(texts, 2) for k, x in enumerate(ids) if x == token]
    assert got(wavelet.locate(spark, path, token), "doc_id", "place") == want(places)
    wavelet.write(nothing, other := shared_path(spark, "wavelet"))
    assert wavelet.read(spark, other).count() == 0


def test_wavelet_matrix():
    ids = np.random.default_rng(5).integers(0, 37, 1500).astype(np.uint32)
    m = wavelet.WaveletMatrix.build(ids, 6)
    assert (m.decode() == ids).all()
    for i in (0, 1, 511, 512, 513, 1499):
        assert m.access(i) == ids[i] and m.rank(5, i) == (ids[:i] == 5).sum()
    where = np.flatnonzero(ids == 5)
    assert m.count(5) == len(where) and [m.select(5, k) for k in range(len(where))] == where.tolist()


def test_line_dedup(docs, texts, nothing):
    key = lambda line: lower(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = defaultdict(set)
    top = lambda i: 1 << 62 if i is None else i
    for i, t in texts:
        for line in (t or "").split("\n"):
            holders[key(line)].add(top(i))
    rows = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == top(i)]
        rows.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    found = line_dedup.dedup(docs)
    assert found.columns[: len(docs.columns) - 1] == [c for c in docs.columns if c != "kept_sha256"]
    assert got(found, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want(rows)
    assert {r["_group"] for r in found.collect()} == {7}
    assert line_dedup.dedup(nothing).count() == 0


def test_line_dedup_of_a_very_long_line(spark):
    long = "A line of a megabyte " * 50_000
    docs = spark.createDataFrame([(1, long + "\nend of one"), (2, "  " + long.lower() + "\nend of two")], "doc_id long, text string")
    assert got(line_dedup.dedup(docs), "doc_id", "n_lines", "n_dropped", "text") == [(1, 2, 0, long + "\nend of one"), (2, 2, 1, "end of two")]


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    assert sorted(line_dedup.PerfectHash(keys).index(keys).tolist()) == list(range(len(keys)))


def test_line_index_as_a_row():
    """A shard read back from its row knows its keys, and no others; keys that share a half are told apart."""
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 1 << 63, 3000).astype(np.uint64))
    keys = np.concatenate((keys, keys[:3]))
    prints, first = r.integers(0, 1 << 63, len(keys)).astype(np.uint64), r.integers(0, 1 << 40, len(keys))
    counts = np.where(np.arange(len(keys)) % 5 == 0, 1, 2)
    row = line_dedup.LineIndex.build(keys, prints, counts, first).row(7).to_pylist()[0]
    found = line_dedup.LineIndex.from_row(row).probe(keys, prints)
    assert row["shard"] == 7 and (found[0] == counts).all() and (found[1] == first).all()
    other = line_dedup.LineIndex.from_row(row).probe(keys, prints + np.uint64(1))
    assert not other[0].any()
    empty = line_dedup.LineIndex.build(keys[:0], prints[:0], counts[:0], first[:0])
    assert not line_dedup.LineIndex.from_row(empty.row(0).to_pylist()[0]).probe(keys, prints)[0].any()


def test_quality(spark, docs, texts, nothing):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    found = quality.score(docs, model)
    rows = found.collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert [c for c in found.columns if c not in ("score", "predicted")] == [c for c in docs.columns if c not in ("score", "predicted")]
    assert quality.score(nothing, quality.train(nothing, labels.limit(0))).count() == 0
    assert len(quality.score(docs, quality.train(docs, labels.limit(0))).collect()) == len(texts)


def plain_features(text):
    """The features of one text, one by one."""
    n = len(text)
    if not n:
        return [0.0] * len(quality.FEATURES)
    share = lambda chars: sum(b in chars for b in text) / n
    kinds = [bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" \t", b"\n", b".,;:'-?", bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,;:'-?"), bytes(range(128, 256))]
    p = [text.count(bytes([b])) / n for b in set(text)]
    words, lines = text.split(), text.split(b"\n")
    w = len(words)
    row = [math.log1p(n), *map(share, kinds), -sum(x * math.log2(x) for x in p), max(text.count(bytes([b])) for b in kinds[6]) / n, math.log1p(w)]
    if w:
        plain, letters = sum(x[-1] in b".,;:?!" for x in words), sum(x.isalpha() for x in words)
        row += [sum(map(len, words)) / w, len(set(words)) / w, max(Counter(words).values()) / w, sum(a == b for a, b in zip(words, words[1:])) / w, sum(x.isupper() for x in words) / w, (w - letters - plain) / w, words.count(b"|") / w]
    else:
        row += [0.0] * 7
    return [*row, math.log1p(len(lines)), n / len(lines), sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines)]


def test_quality_against_plain_lookups(docs, texts):
    """Features and scores of every text, one feature and one table at a time."""
    data = [(t or "").encode() for _, t in texts]
    x = quality.features(data)
    assert np.allclose(x, [plain_features(t) for t in data])
    model = quality.fit(x, np.arange(len(x)) % 3 == 0)
    plain = []
    for row in x.tolist():
        total = model.base + sum(lut[sum(e <= v for e in edge)] for v, edge, lut in zip(row, model.edges, model.tables))
        total += sum(lut[sum(e <= row[i] for e in ei)][sum(e <= row[j] for e in ej)] for i, j, ei, ej, lut in model.pairs)
        plain.append(1 / (1 + math.exp(-max(-30, min(30, total)))))
    found = [r["score"] for r in quality.score(docs, model).select("score").collect()]
    assert np.allclose(sorted(found), sorted(plain)) and model.pairs


def test_quality_trees_take_the_best_cut():
    r = np.random.default_rng(3)
    for _ in range(50):
        g, h = r.normal(size=9), r.uniform(1, 3, 9)
        gain = [g[:m].sum() ** 2 / (h[:m].sum() + 1) + g[m:].sum() ** 2 / (h[m:].sum() + 1) - g.sum() ** 2 / (h.sum() + 1) if min(h[:m].sum(), h[m:].sum()) >= 2 else 0 for m in range(1, 9)]
        m = int(np.argmax(gain)) + 1
        step = quality._tree(g, h, 2, 2.0)
        if gain[m - 1] > 1e-9:
            assert np.allclose(step, [g[:m].sum() / (h[:m].sum() + 1)] * m + [g[m:].sum() / (h[m:].sum() + 1)] * (9 - m))


def test_quality_on_held_out_labels(spark):
    from marginalia.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = QUERIES["op7_quality"](spark, d).join(labels, "doc_id").where("held_out and quality is not null").select("score", "quality").collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area > 0.9, area


@pytest.mark.parametrize("page_rows,leaf_rows,clusters", [(metric_tree.PAGE_ROWS, metric_tree.LEAF_ROWS, 0), (40, 8, 0), (40, 8, 12)])
def test_metric_tree(spark, monkeypatch, page_rows, leaf_rows, clusters):
    """Against all pairs, in one page and over many, with ties, repeated rows and ids, and rows that take no part."""
    monkeypatch.setattr(metric_tree, "PAGE_ROWS", page_rows)
    monkeypatch.setattr(metric_tree, "LEAF_ROWS", leaf_rows)
    r = np.random.default_rng(4)
    centre = r.normal(size=(max(1, clusters), 6)) * (clusters > 0)
    vectors = [(i, [float(x) for x in centre[i % len(centre)] * 3 + r.normal(size=6) * (0.1 if clusters else 1)]) for i in range(300)]
    vectors += [(300 + i, vectors[20][1]) for i in range(60)] + [(400, None), (401, [None] * 6), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (404, []), (405, [1.0] * 5), (None, [1.0] * 6), (420, [0.0] * 6), (41, vectors[5][1]), (41, vectors[41][1])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, label int, page int")
    rows = metric_tree.quantise(table)
    made = metric_tree.top_k(rows, rows.where("vec_id % 20 = 0"), 20)
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in vectors if i is not None and v and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)]
    brute = []
    for q, a in ok:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:20]
            brute += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got(made, "query_id", "rank", "vec_id", "score") == want(brute)
    assert metric_tree.top_k(rows.limit(0), rows.limit(0)).count() == 0


def test_metric_tree_passes_over_pages():
    """Among clustered vectors the directory's bounds leave a query few pages, and the tree's bounds few distances."""
    r = np.random.default_rng(6)
    v = np.floor(r.normal(size=(40, 16))[r.integers(0, 40, 8000)] * 300 + r.normal(size=(8000, 16)) * 10)
    top = float((v * v).sum(axis=1).max())
    pv, pl = metric_tree.centres(v[:1000], metric_tree.lift(v[:1000], top), 40)
    d = metric_tree.distances(v, metric_tree.lift(v, top), pv, pl)
    owner = d.argmin(axis=1)
    radius = np.array([d[owner == k, k].max(initial=0) for k in range(len(pv))])
    directory = metric_tree.Directory(pv, pl, radius, (np.bincount(owner, minlength=len(pv)) > 0).astype(np.int64), top)
    q, ids = v[::80], np.arange(0, 8000, 80)
    scores = q @ v.T
    bound = np.sort(scores, axis=1)[:, -21]
    who, page = directory.others(q, ids, bound)
    pages = int((directory.splits > 0).sum())
    assert len(who) / len(q) < 0.2 * pages
    visited = {(int(a), int(b) >> 32) for a, b in zip(who, page)} | {(k, int(p) >> 32) for k, p in enumerate(directory.nearest(q, ids))}
    assert all((k, int(owner[j])) in visited for k in range(len(q)) for j in np.flatnonzero(scores[k] >= bound[k]))


def groups_of(sets, num, den):
    """For each set the first one that it is linked with, directly or through others."""
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(sets))]


def brute_components(texts, words, num, den):
    sets = []
    for _, t in texts:
        w = SPACE.findall(lower(t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    root, low = groups_of(sets, num, den), {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            low[root[k]] = min(i, low.get(root[k], i))
    by_id = {i: k for k, (i, _) in enumerate(texts)}
    return [(i, len(sets[by_id[i]]), low.get(root[k]) if sets[k] else i) for k, (i, _) in enumerate(texts)]


@pytest.mark.parametrize("words,num,den,whole", [(3, 90, 100, 1 << 18), (5, 80, 100, 1 << 18), (2, 50, 100, 1 << 18), (5, 80, 100, 60), (2, 50, 100, 100)])
def test_jaccard_join(docs, texts, nothing, words, num, den, whole):
    assert got(jaccard_join.cluster(docs, words, num, den, whole=whole), "doc_id", "n_shingles", "component_id") == want(brute_components(texts, words, num, den))
    assert jaccard_join.cluster(nothing, words, num, den, whole=whole).count() == 0


def edited(seed, copies, words=60, most=12, vocabulary=3):
    """Near copies of two passages, with up to `most` words of each changed."""
    r = np.random.default_rng(seed)
    out = []
    for p in range(2):
        base = [f"w{x}" for x in r.integers(0, 1 << 40, words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(int(r.integers(0, most))):
                w[int(r.integers(0, words))] = f"e{int(r.integers(0, vocabulary if vocabulary else 1 << 40))}"
            out.append(" ".join(w))
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("vocabulary", [0, 3])
@pytest.mark.parametrize("whole", [500, 1 << 18])
def test_jaccard_join_of_near_copies(spark, monkeypatch, whole, vocabulary):
    """Many varied near copies, whether a component is decided in a task or dealt over several; blocks of a few sets."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rows = edited(5, 70, vocabulary=vocabulary)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_join.cluster(docs, 5, 80, 100, whole=whole), "doc_id", "n_shingles", "component_id") == want(brute_components(rows, 5, 80, 100))


@pytest.mark.parametrize("edits", [3, 12])
@pytest.mark.parametrize("num", [50, 80, 90])
def test_linked_agrees_with_all_pairs(num, edits):
    for vocabulary in (0, 3):
        texts = edited(num + edits, 60, most=edits, vocabulary=vocabulary)
        sets = [{hash(x) & (1 << 63) - 1 for x in zip(*(t.split()[k:] for k in range(5)))} for _, t in texts]
        made = [np.array(sorted(s), np.uint64) for s in sets]
        assert jaccard_join.linked(made, num, 100).tolist() == groups_of(sets, num, 100)


def test_linked_takes_thousands_of_varied_copies():
    """8,000 sets of 296 shingles, each with five words changed: two seconds where a look at each pair took minutes."""
    r, n = np.random.default_rng(1), 300
    base, sets = r.integers(1, 1 << 62, n), []
    for _ in range(8000):
        w = base.copy()
        w[r.integers(0, n, 5)] = r.integers(1, 1 << 62, 5)
        sets.append(np.unique(sum(w[k : n - 4 + k] * (2 * k + 3) for k in range(5)).view(np.uint64)))
    began = time.time()
    assert len(np.unique(jaccard_join.linked(sets, 80, 100))) > 1
    assert time.time() - began < 40


def test_packing(docs, texts, nothing):
    rows = [r.asDict() for r in packing.pack(docs).collect()]
    ids = defaultdict(list)
    for i, x in encoded(texts, 1):
        ids[i].append(x)
    for i in ids:
        pieces = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == i)
        copies = ids[i]
        assert sum(p[1] for p in pieces) == sum(map(len, copies))
        for start, length, c, total in pieces:
            assert any(total == len(x) and crc(x[start : start + length]) == c for x in copies)
    per = defaultdict(list)
    for r in rows:
        per[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_tokens"]))
    for pieces in per.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at == pieces[0][2] <= 2048 and at & (at - 1) == 0
    assert packing.pack(nothing).count() == 0
