"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for other ways to write it."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import clean, slices, table

KINDS = ("email", "ip", "card", "phone")
#: What may stand before the @ of an address, and the pattern of what must follow it.
LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A leftmost address begins where its first digits do, so no other start is tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
HIT = re.compile(r"[0-9@]")
BREAK = re.compile(r"\s")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Features are turned into emissions so many tokens at a time; a run of chunks is decoded as a whole, however long.
BATCH_TOKENS = 4096


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that don't overlap: each @ is looked at once, with what stands before it since the last."""
    at, low = text.find("@"), 0
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns: leftmost matches that don't overlap within a kind; a match that fails its test is dropped. Takes time in proportion to the text."""
    found = [(0, s, e) for s, e in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                found.append((1, m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append((3, m.start(), m.end()))
    return found


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of neighbouring chunks that all hold a digit or @. Other chunks can't be personal data of these kinds, so the chain is cut there without a change to the best path."""
    pos, n = 0, len(text)
    begin = last = -1
    while m := HIT.search(text, pos):
        start = m.start()
        while start > pos and not text[start - 1].isspace():
            start -= 1
        gap = BREAK.search(text, m.end())
        end = gap.start() if gap else n
        if begin < 0:
            begin = start
        elif start - last > 1 or text[last] != " ":
            yield begin, last
            begin = start
        last, pos = end, end
    if begin >= 0:
        yield begin, last


def tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text, start, end)]


def shape(token: str) -> str:
    if token[0].isdigit():
        return f"d{len(token)}" if len(token) < 7 else "d7-12" if len(token) < 13 else "d13-15" if len(token) < 16 else "d16-19" if len(token) < 20 else "d20"
    if token[0].isalpha():
        return ("x" if token.islower() else "X" if token.isupper() else "Xx") + ("1" if len(token) == 1 else "4" if len(token) < 5 else "9")
    return token


def token_features(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[str, ...]]:
    """The shapes of a token and its neighbours, whether they are joined or stand apart, and small facts on its chunk."""
    words = [text[a:b] for a, b in spans]
    shapes = ["<s>", "<s>", *map(shape, words), "</s>", "</s>"]
    glue = [*(i > 0 and spans[i - 1][1] == a for i, (a, _) in enumerate(spans)), False]
    chunk, n = [0] * len(words), 0
    inside: dict[int, list[str]] = {}
    for i in range(len(words)):
        n += not glue[i]
        chunk[i] = n
        inside.setdefault(n, []).append(shapes[i + 2])
    facts: dict[int, str] = {}
    for c, kinds in inside.items():
        facts[c] = f"{'@' in kinds}{any(k[0] in 'xX' for k in kinds)}{min(kinds.count('.'), 4)}{min(kinds.count('-'), 3)}"
    digits = sum(len(w) for w in words if w[0].isdigit())
    for i, w in enumerate(words):
        s = shapes[i : i + 5]
        byte = w[0].isdigit() and len(w) <= 3 and int(w) <= 255
        yield (f"s{s[2]}", f"p{s[1]}{glue[i]}", f"n{s[3]}{glue[i + 1]}", f"ps{s[1]}{glue[i]}{s[2]}", f"sn{s[2]}{glue[i + 1]}{s[3]}", f"pp{s[0]}{s[1]}{s[2]}", f"nn{s[2]}{s[3]}{s[4]}", f"f{facts[chunk[i]]}", f"sf{s[2]}{facts[chunk[i]]}", f"b{byte}{facts[chunk[i]]}", f"t{min(digits, 20)}{s[2]}")


@dataclass
class Crf:
    index: dict[str, int]
    weight: np.ndarray
    move: np.ndarray

    def emissions(self, rows: list[tuple[str, ...]]) -> np.ndarray:
        none = len(self.weight) - 1  # a row of zeros, for features not seen in training
        return self.weight[[[self.index.get(f, none) for f in row] for row in rows]].sum(axis=1)

    def decode(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Best paths by Viterbi, all sequences of one padded length at a time."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sequences)
        groups: dict[int, list[int]] = {}
        for i, s in enumerate(sequences):
            groups.setdefault(1 << (len(s) - 1).bit_length(), []).append(i)
        k = len(LABELS)
        for width, members in groups.items():
            length = np.array([len(sequences[i]) for i in members])
            e = np.zeros((len(members), width, k))
            for row, i in enumerate(members):
                e[row, : length[row]] = sequences[i]
            best = e[:, 0] + START
            back = np.zeros((len(members), width, k), np.int64)
            for t in range(1, width):
                step = best[:, :, None] + self.move
                back[:, t] = step.argmax(axis=1)
                live = (t < length)[:, None]
                best = np.where(live, step.max(axis=1) + e[:, t], best)
                back[:, t] = np.where(live, back[:, t], np.arange(k))
            path = np.zeros((len(members), width), np.int64)
            path[:, -1] = best.argmax(axis=1)
            for t in range(width - 1, 0, -1):
                path[:, t - 1] = np.take_along_axis(back[:, t], path[:, t : t + 1], 1)[:, 0]
            for row, i in enumerate(members):
                out[i] = path[row, : length[row]]
        return out


#: I-k may only follow B-k or I-k.
FORBIDDEN = np.array([[b[0] == "I" and a[2:] != b[2:] for b in LABELS] for a in LABELS])
START = np.where([b[0] == "I" for b in LABELS], -1e9, 0.0)


def examples(seed: int = 7, each: int = 40) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The small labelled table: texts with (kind, start, end), made by rules; also look-alikes without a label."""
    r = random.Random(seed)
    num = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randrange(2, 9)))

    def card(sep: str) -> str:
        head = num(15)
        digits = next(head + str(c) for c in range(10) if luhn(head + str(c)))
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4))

    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    byte = lambda: str(r.randrange(256))
    forms = {
        "email": [lambda: f"{word()}@{word()}.com", lambda: f"{word()}.{num(2)}@{word()}{num(1)}.{word()}.org", lambda: f"{word()}_{num(3)}@{word()}-{word()}.net"],
        "ip": [lambda: ".".join((byte(), byte(), byte(), byte()))],
        "card": [lambda: card(""), lambda: card(" "), lambda: card("-")],
        "phone": [lambda: f"+1 ({num(3)}) 555-{num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"+{num(2)} {num(3)} {num(3)} {num(3)}", lambda: f"({num(3)}){num(3)}-{num(4)}"],
        "": [lambda: num(r.randrange(1, 7)), lambda: f"{r.randrange(1900, 2030)}-{num(2)}-{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: f"{num(1)}.{num(1)}.{num(2)}", lambda: f'"{hexes(r.choice((20, 32, 40)))}"', lambda: f"password={hexes(18)}", lambda: f"@{word()}", lambda: f"@{word()}{num(2)}", lambda: f"${num(2)}.{num(2)}", lambda: f"{num(3)},{num(3)}", lambda: f"{word()}{num(3)}", lambda: f"{num(4)}-{num(4)}", lambda: f"{num(1)}-{num(2)}", lambda: f"[{num(2)}]", lambda: f"({r.randrange(1900, 2030)})", lambda: f"{num(3)}-{num(4)}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"{num(8)}", lambda: f"{num(11)}", lambda: f"{word()} {num(3)} {num(3)} {num(4)}", lambda: f"{num(2)}%", lambda: hexes(12), lambda: f"{num(3)}.{num(3)}"],
    }
    out = []
    for kind, makers in forms.items():
        for make in makers:
            for _ in range(each if kind else each // 2):
                body, tail, head = make(), r.choice(("", "", ".", ",", ";", "&&&", "***", "!!", ")")), r.choice(("", "", "", "(", '"'))
                near = r.choice(("", "", f" {num(2)}")) if not kind else ""
                text = f"{word()} {head}{body}{tail}{near} {word()}"
                start = len(text.split(" ")[0]) + 1 + len(head)
                out.append((text, [(kind, start, start + len(body))] if kind else []))
    return out


def train(labelled: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 60, rate: float = 0.15, decay: float = 1e-3) -> Crf:
    """Maximum likelihood by full-batch Adam with forward-backward; the table is small and lives on the driver."""
    rows, tags = [], []
    for text, spans in labelled:
        for a, b in runs(text):
            at = tokens(text, a, b)
            rows.append(list(token_features(text, at)))
            tag = np.zeros(len(at), np.int64)
            for kind, s, e in spans:
                inside = [i for i, (x, y) in enumerate(at) if x >= s and y <= e]
                for n, i in enumerate(inside):
                    tag[i] = LABELS.index(f"{'I' if n else 'B'}-{kind}")
            tags.append(tag)
    names = sorted({f for row in rows for token in row for f in token})
    index = {f: i for i, f in enumerate(names)}
    n, k, width = len(rows), len(LABELS), max(map(len, rows))
    deep = len(rows[0][0])
    feat = np.full((n, width, deep), len(names))
    mask, gold = np.zeros((n, width), bool), np.zeros((n, width), np.int64)
    for i, row in enumerate(rows):
        feat[i, : len(row)] = [[index[f] for f in token] for token in row]
        mask[i, : len(row)], gold[i, : len(row)] = True, tags[i]
    w, t = np.zeros((len(names) + 1, k)), np.where(FORBIDDEN, -1e9, 0.0)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    one = np.eye(k)
    flat = feat[mask]
    order = np.argsort(flat.ravel(), kind="stable")
    held, edge = np.unique(flat.ravel()[order], return_index=True)
    for step in range(1, steps + 1):
        e = np.zeros((n, width, k))
        e[mask] = w[flat].sum(axis=1)
        alpha, beta = np.zeros((n, width, k)), np.zeros((n, width, k))
        alpha[:, 0] = e[:, 0] + START
        for i in range(1, width):
            alpha[:, i] = np.where(mask[:, i, None], lse(alpha[:, i - 1, :, None] + t, 1) + e[:, i], alpha[:, i - 1])
        for i in range(width - 2, -1, -1):
            beta[:, i] = np.where(mask[:, i + 1, None], lse(t + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0.0)
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        ge = (p - one[gold]) * mask[..., None]
        gw = np.zeros_like(w)
        gw[held] = np.add.reduceat(ge[mask][order // deep], edge)
        gt = np.zeros_like(t)
        for i in range(width - 1):
            live = mask[:, i + 1, None, None]
            pair = np.exp(alpha[:, i, :, None] + t + (e[:, i + 1] + beta[:, i + 1])[:, None, :] - z[:, None, None])
            gt += ((pair - one[gold[:, i]][:, :, None] * one[gold[:, i + 1]][:, None, :]) * live).sum(axis=0)
        gw = gw / n + decay * w / 10
        gt = np.where(FORBIDDEN, 0.0, gt / n + decay * np.where(FORBIDDEN, 0, t) / 10)
        for x, g, m, v in ((w, gw, state[0], state[1]), (t, gt, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w[-1] = 0
    return Crf(index, w, t)


class Spans:
    """Known spans by start, with the greatest end so far, so that those in reach of a range are found by bisection."""

    def __init__(self, known: list[tuple[int, int, int]]):
        self.spans = sorted((s, e) for _, s, e in known)
        self.starts = [s for s, _ in self.spans]
        self.ends = list(itertools.accumulate((e for _, e in self.spans), max))

    def touching(self, a: int, b: int) -> list[tuple[int, int]]:
        return [x for x in self.spans[bisect.bisect_right(self.ends, a) : bisect.bisect_left(self.starts, b)] if x[1] > a]


def added_spans(model: Crf, texts: list[str], known: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What the model finds beside the known spans; a span that touches a known one is dropped."""
    where, spans, feats = [], [], []
    spans_of = [Spans(k) for k in known]
    for d, text in enumerate(texts):
        for a, b in runs(text):
            taken = spans_of[d].touching(a, b)
            if len(taken) == 1 and b - a <= taken[0][1] - taken[0][0] + 4:
                continue  # nothing but a known span and its punctuation
            at = tokens(text, a, b)
            if at:
                where.append(d)
                spans.append(at)
                feats.append(token_features(text, at))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not feats:
        return out
    ends = np.cumsum([len(at) for at in spans])
    rows = itertools.chain.from_iterable(feats)
    e = np.concatenate([model.emissions(list(itertools.islice(rows, BATCH_TOKENS))) for _ in range(0, int(ends[-1]), BATCH_TOKENS)])
    for d, at, path in zip(where, spans, model.decode(np.split(e, ends[:-1])), strict=True):
        i = 0
        while i < len(path):
            if path[i] % 2 == 1:
                j = i + 1
                while j < len(path) and path[j] == path[i] + 1:
                    j += 1
                start, end, kind = at[i][0], at[j - 1][1], int(path[i]) // 2
                if not spans_of[d].touching(start, end) and whole(texts[d][start:end], kind):
                    out[d].append((kind, start, end))
                i = j
            else:
                i += 1
    return out


def whole(found: str, kind: int) -> bool:
    """Whether a decoded span can be of its kind at all: a chain may stop short of a whole address or number."""
    digits = sum(c.isdigit() for c in found)
    return (0 < found.find("@") < len(found) - 3 and "." in found.split("@")[-1], found.count(".") == 3 and all(p.isdigit() and int(p) < 256 for p in found.split(".") if len(p) < 5), 16 <= digits <= 19 and luhn("".join(c for c in found if c.isdigit())), 10 <= digits <= 15)[kind]


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, counts and a digest of the base spans, and all spans as a string.

    The n_ columns and base_sha256 tell of the fixed patterns; spans has also what the model adds, of which n_added
    is the count. Offsets are code points. A null text is empty and has no spans; a null doc_id stays null; repeated
    rows are searched one by one; an empty table gives no rows. Only doc_id and text are read.
    """
    chain = model or train(examples())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            more = added_spans(chain, texts, base)
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b in base], pa.int64()) for kind in range(4)]
            sums = pa.array([hashlib.sha256(digest(b).encode()).hexdigest() for b in base])
            spans = pa.array([digest(b + m) for b, m in zip(base, more, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sums, spans, pa.array(list(map(len, more)), pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return clean(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """doc_id and text with every span replaced by its kind in angle brackets."""
    chain = model or train(examples())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            more = added_spans(chain, texts, base)
            out = []
            for text, spans in zip(texts, (b + m for b, m in zip(base, more, strict=True)), strict=True):
                last, parts = 0, []
                for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
                    if s >= last:
                        parts += [text[last:s], f"<{KINDS[kind]}>"]
                        last = e
                    else:
                        last = max(last, e)
                out.append("".join([*parts, text[last:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return clean(docs).mapInArrow(run, "doc_id long, text string")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
