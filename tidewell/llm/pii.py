"""Personal data by patterns, and by a linear-chain conditional random field.

Patterns find the base spans. The field labels tokens by the shapes of the token
and its neighbours; it is trained on a small labelled table and decoded by
Viterbi over all lines of a batch at once. Its spans add what the patterns don't
express, such as numbers without a country code or addresses spelled out.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow

# The kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def holds(kind: str, text: str) -> bool:
    """Whether a match of a kind's pattern is of that kind."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    if kind == "card":
        d = digits_of(text)
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(digits_of(text)) <= 15
    return True


def _emails(text: str) -> list[tuple[int, int]]:
    """As the e-mail pattern's matches from the left, found from each @ so that long words cost no more than their length."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    return found


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start and then kind; code points, end exclusive."""
    if not text:
        return []
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        if kind != "phone" or "+" in text:
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if holds(kind, m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Signs that may stand around a word without being part of it.
AROUND = ".,;:!?\"'#*$%&|<>"
# Words that the field tells from other plain words: those of spelled-out addresses, and those that name a number.
MARKS = frozenset("at dot punkt punto tel phone call fax mobile cell telefon whatsapp mail email ip host card visa order ref id invoice isbn version no nr".split())
#: A line without a digit, such a sign or a spelled-out dot holds no span that fits its kind, so it is not decoded.
_SIGN = re.compile(r"[\d_]|[^\w\s.,;:!?\"']|\b(?:dot|punkt|punto)\b", re.I)
#: Longer lines are cut where PLAIN words lie on both sides, as no span has so many in a row; LONG_RUN tokens without
#: such a place are cut anywhere, and the stretches overlap by SPAN tokens on both sides of the cut.
LINE_TOKENS, PLAIN, LONG_RUN, SPAN = 64, 4, 1024, 24
SEED, TRAIN_LINES = 7, 640


@lru_cache(maxsize=50_000)
def shape(token: str) -> str:
    """A word's shape: ``word`` for letters alone, but the word itself if it is a mark; else runs of letters as a or A, of digits by their length up to five."""
    core = token.strip(AROUND)
    if core.isalpha():
        return f"={core.lower()}" if core.lower() in MARKS else "word"
    s = re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub(r"[^\x21-\x7e]", "x", core)))
    return re.sub("[0-9]+", lambda m: "0" if len(m[0]) < 3 else "0" * min(len(m[0]), 5), s)[:24]


def features(before: str, own: str, after: str) -> list[str]:
    return [f"0{own}", f"-{before}", f"+{after}", f"-0{before} {own}", f"0+{own} {after}"]


def labelled_table(n: int = TRAIN_LINES, seed: int = SEED) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: lines of tokens and their labels, made by rule from a seed.

    Half of the lines hold one value in one of several forms among made-up
    words, some after a word that names it; the others hold none, but numbers
    and words that are no personal data.
    """
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "th", "lo", "que", "sch", "ti", "on"]) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ",", "."])
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    number, release = lambda: num(r.randint(1, 3)), lambda: f"v{num(r.randint(1, 4))}.{num(1)}"
    name = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8)))
    forms = {
        "email": [lambda: [f"{name()}.{num(2)}@mail{num(1)}.example.com"], lambda: [f"{name()}@{name()}.org"], lambda: [name(), "(at)", name(), "(dot)", "com"], lambda: [name(), "[at]", name(), "[dot]", "org"], lambda: [f"{name()}[at]{name()}.com"], lambda: [f"{name()}(at){name()}.net"],
                  lambda: [name(), "at", name(), "dot", "com"], lambda: [name(), "at", name(), "dot", "co", "dot", "uk"], lambda: [name(), "(at)", f"{name()}.org"], lambda: [name(), "at", name(), "punkt", "de"]],
        "ip": [lambda: [f"{num(2)}.{num(3)}.{num(2)}.{num(1)}"], lambda: [f"{num(1)}.{num(2)}.{num(3)}.{num(3)}"]],
        "card": [lambda: [num(16)], lambda: [num(4), num(4), num(4), num(4)], lambda: [f"{num(4)}-{num(4)}-{num(4)}-{num(4)}"], lambda: [f"{num(4)}.{num(4)}.{num(4)}.{num(4)}"]],
        "phone": [lambda: [f"+{num(1)}", f"({num(3)})", f"{num(3)}-{num(4)}"], lambda: [f"({num(3)})", f"{num(3)}-{num(4)}"], lambda: [f"{num(3)}-{num(3)}-{num(4)}"], lambda: [f"{num(3)}.{num(3)}.{num(4)}"], lambda: [f"+{num(2)}", num(3), num(3), num(4)],
                  lambda: [f"00{num(2)}", num(2), num(7)], lambda: [f"00{num(2)}", num(3), num(3), num(4)], lambda: [f"0{num(2)}/{num(7)}"], lambda: [f"0{num(3)}/{num(7)}"], lambda: [f"0{num(3)}-{num(7)}"], lambda: [f"0{num(2)}", num(8)]],
    }
    # Numbers that only the word before them tells.
    named = [lambda: [num(10)], lambda: [num(3), num(3), num(4)], lambda: [num(11)], lambda: [f"{num(3)}/{num(7)}"]]
    leads = ["tel", "phone", "call", "fax", "mobile", "cell", "telefon", "whatsapp", "Tel:", "Phone:"]
    others = ["order", "ref", "id", "invoice", "isbn", "version", "no", "nr", "card", "Order:"]
    other = [lambda: [num(r.randint(1, 6))], lambda: [f"{num(2)}/{num(2)}/{num(4)}"], lambda: [f"{num(4)}-{num(2)}-{num(2)}"], lambda: [f"{num(2)}:{num(2)}"], lambda: [f"{num(1)}.{num(2)}"], lambda: [f"v{num(1)}.{num(1)}.{num(2)}"], lambda: ["token", "=", f'"{name()}{num(8)}{name()}{num(6)}"'], lambda: [f"({num(4)})"], lambda: ["look", "at", word()], lambda: [f"{name()}###"], lambda: [f"{name()}-{name()}"], lambda: [num(r.randint(20, 24))], lambda: [f"§{num(3)}"], lambda: [f"{num(3)}-{num(4)}"],
             lambda: [num(10)], lambda: [r.choice(others), *r.choice(named)()], lambda: [r.choice(others), *r.choice(named)()], lambda: ["look", "at", f"{name()}.com"], lambda: ["at", num(2)], lambda: ["the", "dot", "at", "the", word()], lambda: [r.choice(leads), word()], lambda: [num(3), num(3)]]
    rows = []
    for i in range(n):
        kind = KINDS[i // 2 % len(KINDS)]
        value, tags = (forms[kind][i // 8 % len(forms[kind])](), True) if i % 2 else (other[i // 2 % len(other)](), False)
        before, after = ([r.choice([word, word, word, word, word, word, number, release])() for _ in range(r.randint(0, 6))] for _ in range(2))
        if tags and kind == "phone" and i // 8 % 2 == 0:
            value = r.choice(named)()
            before.append(r.choice(leads))
        rows.append((before + value + after, ["O"] * len(before) + ([f"{'I' if k else 'B'}-{kind}" if tags else "O" for k in range(len(value))]) + ["O"] * len(after)))
    return rows


class Field:
    """Weights of a linear-chain conditional random field: label scores by feature, and label transitions."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move
        self.rows: dict[tuple, np.ndarray] = {}

    def scores(self, shapes: list[str]) -> np.ndarray:
        """Label scores of each token; a row depends on three shapes and is kept by them."""
        out, pad = np.empty((len(shapes), len(LABELS))), ["<", *shapes, ">"]
        for i, key in enumerate(zip(pad, shapes, pad[2:])):
            row = self.rows.get(key)
            if row is None:
                on = [self.index[f] for f in features(*key) if f in self.index]
                row = self.emit[on].sum(0) if on else np.zeros(len(LABELS))
                if len(self.rows) > 100_000:
                    self.rows.clear()
                self.rows[key] = row
            out[i] = row
        return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    """The logarithm of a sum of exponentials over the last axis but one."""
    m = x.max(-2)
    safe = np.where(np.isfinite(m), m, 0)
    return np.where(np.isfinite(m), m + np.log(np.exp(x - safe[..., None, :]).sum(-2) + 1e-300), -np.inf)


def forward_backward(scores: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log sums over all labellings up to each token and label, after it, and over all of a line.

    ``scores`` is (token, label), or (line, token, label) for lines of a length.
    """
    n = scores.shape[-2]
    fwd, bwd = np.empty_like(scores), np.zeros_like(scores)
    fwd[..., 0, :] = scores[..., 0, :]
    for i in range(1, n):
        fwd[..., i, :] = _log_sum(fwd[..., i - 1, :, None] + move) + scores[..., i, :]
    for i in range(n - 2, -1, -1):
        bwd[..., i, :] = _log_sum(np.swapaxes(move + (scores[..., i + 1, :] + bwd[..., i + 1, :])[..., None, :], -1, -2))
    return fwd, bwd, _log_sum(fwd[..., -1, :, None])[..., 0]


def train_field(table: list[tuple[list[str], list[str]]], rounds: int = 60, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Maximum likelihood with a quadratic penalty by gradient ascent (Adagrad); lines of a length take a step together."""
    index: dict[str, int] = {}
    groups: dict[int, list[tuple[list, list]]] = {}
    for tokens, labels in table:
        if tokens:
            s = [shape(t) for t in tokens]
            on = [[index.setdefault(f, len(index)) for f in features(*key)] for key in zip(["<", *s], s, [*s[1:], ">"])]
            groups.setdefault(len(s), []).append((on, [LABELS.index(x) for x in labels]))
    lines = [(np.array([f for f, _ in g]), np.array([y for _, y in g])) for g in groups.values()]
    k = len(LABELS)
    legal = np.array([[not b.startswith("I") or a[1:] == b[1:] for b in LABELS] for a in LABELS])
    start = np.array([not b.startswith("I") for b in LABELS])
    emit, move = np.zeros((len(index), k)), np.zeros((k, k))
    g_emit, g_move = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    one = np.eye(k)
    for _ in range(rounds):
        d_emit, d_move = -decay * emit, -decay * move
        mv = np.where(legal, move, -np.inf)
        for fs, y in lines:
            e = emit[fs].sum(2)
            e[:, 0] = np.where(start, e[:, 0], -np.inf)
            fwd, bwd, z = forward_backward(e, mv)
            gap = one[y] - np.exp(fwd + bwd - z[:, None, None])
            np.add.at(d_emit, fs, gap[:, :, None, :])
            both = np.exp(fwd[:, :-1, :, None] + mv + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
            d_move -= both.sum((0, 1))
            np.add.at(d_move, (y[:, :-1], y[:, 1:]), 1)
        g_emit += d_emit**2
        g_move += d_move**2
        emit += rate * d_emit / np.sqrt(g_emit)
        move += rate * d_move / np.sqrt(g_move)
    return Field(index, emit, np.where(legal, move, -1e9))


def viterbi(scores: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """The best labels of each line: all lines of a batch take a step together, the longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lens = np.array([len(scores[i]) for i in order])
    if not len(lens):
        return []
    k = move.shape[0]
    grid = np.zeros((lens[0], len(order), k))
    for j, i in enumerate(order):
        grid[: lens[j], j] = scores[i]
    begin = np.array([-1e9 if x.startswith("I") else 0.0 for x in LABELS])
    best, back = grid[0] + begin, np.zeros((lens[0], len(order), k), np.int8)
    last = np.zeros((len(order), k))
    for t in range(1, lens[0] + 1):
        live = int((lens > t - 1).sum())
        more = int((lens > t).sum()) if t < lens[0] else 0
        last[more:live] = best[more:live]
        if not more:
            break
        step = best[:more, :, None] + move
        back[t, :more] = step.argmax(1)
        best[:more] = step.max(1) + grid[t, :more]
    label = last.argmax(1)
    out = np.zeros((lens[0], len(order)), np.int8)
    for t in range(lens[0] - 1, -1, -1):
        live = int((lens > t).sum())
        ends = lens[:live] == t + 1
        label[:live] = np.where(ends, label[:live], back[t + 1, np.arange(live), label[:live]] if t + 1 < lens[0] else label[:live])
        out[t, :live] = label[:live]
    found: list[np.ndarray] = [np.zeros(0, np.int8)] * len(order)
    for j, i in enumerate(order):
        found[i] = out[: lens[j], j]
    return found


@lru_cache(maxsize=1)
def field() -> Field:
    """The field of the small labelled table; a process trains it once."""
    return train_field(labelled_table())


_TOKEN = re.compile(r"\S+")


def _lines(text: str):
    """(tokens, shapes, lo, hi) of each stretch of text that may hold personal data; tokens as (start, end). Spans from tokens lo to hi - 1 are the stretch's own."""
    at = 0
    for line in text.split("\n"):
        if _SIGN.search(line):
            tokens, shapes, lo, plain = [], [], 0, 0
            for m in _TOKEN.finditer(line):
                tokens.append((at + m.start(), at + m.end()))
                shapes.append(shape(m[0]) if len(m[0]) <= 64 else "long")
                plain = plain + 1 if shapes[-1] == "word" else 0
                cut = len(tokens) - PLAIN
                if plain >= 2 * PLAIN and cut >= LINE_TOKENS:
                    if any(s != "word" for s in shapes):
                        yield tokens[:cut], shapes[:cut], lo, cut
                    tokens, shapes, lo, plain = tokens[cut:], shapes[cut:], 0, PLAIN
                elif len(tokens) >= LONG_RUN + 2 * SPAN:
                    yield tokens, shapes, lo, len(tokens) - SPAN
                    tokens, shapes, lo = tokens[-2 * SPAN :], shapes[-2 * SPAN :], SPAN
            if any(s != "word" for s in shapes):
                yield tokens, shapes, lo, len(tokens)
        at += len(line) + 1


def _fits(kind: str, text: str) -> bool:
    """Whether a span that the field found can be of its kind."""
    if kind == "email":
        return bool(re.search(r"@|[(\[]at[)\]]|\bat\b", text, re.I) and re.search(r"\.|[(\[]dot[)\]]|\b(?:dot|punkt|punto)\b", text, re.I))
    if kind == "ip":
        return text.count(".") == 3 and not re.search("[^0-9.]", text) and all(text.split(".")) and holds("ip", text)
    return not re.search("[A-Za-z]", text) and holds(kind, text)


def all_spans(texts: list[str | None], model: Field, cells: int = 200_000) -> list[tuple[list, list]]:
    """Base spans, and these with the field's, for each text. The field's must be of their kind and apart from all base spans."""
    base = [base_spans(t) for t in texts]
    found = [list(b) for b in base]
    lines = [(i, *line) for i, t in enumerate(texts) if t for line in _lines(t)]
    lines.sort(key=lambda x: -len(x[1]))
    lo = 0
    while lo < len(lines):
        hi = lo + max(1, cells // len(lines[lo][1]))
        part = lines[lo:hi]
        for (i, tokens, _, first, after), labels in zip(part, viterbi([model.scores(x[2]) for x in part], model.move)):
            for a in np.flatnonzero(labels % 2 == 1).tolist():
                if not first <= a < after:
                    continue
                b = a + 1
                while b < len(labels) and labels[b] == labels[a] + 1:
                    b += 1
                kind, start, end = LABELS[labels[a]][2:], tokens[a][0], tokens[b - 1][1]
                while start < end and texts[i][start] in AROUND:
                    start += 1
                while start < end and texts[i][end - 1] in AROUND:
                    end -= 1
                if _fits(kind, texts[i][start:end]) and all(end <= x or y <= start for _, x, y in found[i]):
                    found[i].append((kind, start, end))
        lo = hi
    return [(b, sorted(f, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))) for b, f in zip(base, found)]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, base and spans, arrays of (kind, start, end) by start and kind.

    Offsets are code points, ends exclusive. ``base`` has the patterns' spans,
    ``spans`` these and the field's. A text's lines are decoded in batches of a
    fixed size; nothing is shuffled. A null text is empty and has no spans; null
    and repeated identifiers come back row by row.
    """
    model = field()
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    as_rows = lambda spans: [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in spans]

    def find(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                piece = batch.slice(lo, 200)
                base, spans = zip(*all_spans(piece.column(1).to_pylist(), model))
                cols = [piece.column(0), pa.array(as_rows(base), kind), pa.array(as_rows(spans), kind)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "base", "spans"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return in_arrow(rows, find, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("base", span), T.StructField("spans", span)]))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in capitals and brackets; overlapping spans are one, of the first's kind.

    Other columns, null texts and the order of columns stay.
    """
    model, at = field(), docs.columns.index(text_col)

    def clean(text: str, spans) -> str:
        out, end = [], 0
        for kind, a, b in spans:
            if a >= end:
                out += [text[end:a], f"[{kind.upper()}]"]
            end = max(end, b)
        return "".join(out) + text[end:]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                piece = batch.slice(lo, 200)
                texts = piece.column(at).to_pylist()
                new = [clean(t, s) if s else t for t, (_, s) in zip(texts, all_spans(texts, model))]
                yield piece.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    # Columns go by their places, so that any name will do.
    places = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*places)
    return in_arrow(plain, run, plain.schema).toDF(*docs.columns)
