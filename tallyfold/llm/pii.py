"""Personal data in texts: patterns, and a skip-chain conditional random field that labels similar tokens alike."""

from __future__ import annotations

import hashlib
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import arrow_schema, as_bytes, batches, fields

#: Labels of tokens: none, then the kinds in the order in which spans at one place are listed.
KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
EMAIL, IP, CARD, PHONE = range(1, LABELS)
#: Digits that similar numbers have in common at their end, letters of a name before `@`, and characters of a repeated token.
TAIL, NAME, REPEAT = 7, 3, 5
#: Rounds of message passing at most, the share of an old message that a new one keeps, and the change below which they end.
ROUNDS, DAMPING, SETTLED = 50, 0.3, 1e-4
#: Steps of the fit, their size, and the weight of the penalty.
STEPS, RATE, PENALTY = 400, 0.5, 1e-3

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])++")
_DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_SIGNAL = re.compile(r"[0-9@]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def digits_of(text: str) -> str:
    return _NOT_DIGITS.sub("", text)


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # no local part holds an @, so each @ is tried once, with all that may stand before it
    end, at = 0, text.find("@")
    while at >= 0:
        between = text[end:at]
        name = len(between) - len(between.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at) if name else None
        if found:
            yield at - name, found.end()
        end = found.end() if found else at + 1
        at = text.find("@", end)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for chain in _DOTTED.finditer(text):
        parts, start = chain.group().split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield start, end
            start = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _NUMBER.finditer(text):
        digits = digits_of(found.group())
        if 14 <= len(digits) <= 19 and passes_luhn(digits):
            yield found.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _DIALLED.finditer(text):
        if 10 <= len(digits_of(found.group())) <= 15:
            yield found.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """`(start, kind, end)` of what the patterns match, by start, then by kind. Linear in the length of the text."""
    if not _SIGNAL.search(text):
        return []
    return sorted((a, kind, b) for kind, find in enumerate((_emails, _ips, _cards, _phones), 1) for a, b in find(text))


#: What a token looks like; the first class that fits.
SHAPES = ("email", "name and place", "ip", "other dotted", "card", "dialled", "in brackets", "seven digits with a mark", "ten digits with marks",
          "digits, up to 3", "digits, 4", "digits, 5 to 9", "digits, 10 to 13", "digits, 14 to 19", "digits, more", "letters and digits", "other")


def shape_of(core: str) -> int:
    digits = len(number := digits_of(core))
    if "@" in core:
        return 0 if list(_emails(core)) == [(0, len(core))] else 1
    if core.count(".") >= 2 and _DOTTED.fullmatch(core):
        if list(_ips(core)) == [(0, len(core))]:
            return 2
        if digits < 13:
            return 3
    if 14 <= digits <= 19 and _NUMBER.fullmatch(core) and passes_luhn(number):
        return 4
    if core.startswith("+"):
        return 5
    if core.startswith("("):
        return 6
    if core.isdigit():
        return 9 + int(np.searchsorted((3, 4, 9, 13, 19), digits))
    if not any(c.isalpha() for c in core):
        return 7 if digits == 7 else 8 if digits >= 10 else 16
    return 15 if digits else 16


_OF_SHAPE = {0: EMAIL, 2: IP, 4: CARD}


@dataclass
class Tokens:
    """Tokens of a text that hold a digit or an `@`: places, shapes, labels by the patterns (-1: open) and edges.

    `chain` joins neighbours in the text, `skip` similar tokens wherever they
    are. Of many similar tokens each is joined with the one before and the one
    after it, so edges grow with the tokens and not with their square.
    """

    spans: list[tuple[int, int]] = field(default_factory=list)
    cores: list[str] = field(default_factory=list)
    shapes: list[int] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    allowed: list[set[int]] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    """A token without the marks around it; brackets and a plus sign before it stay."""
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    last = ")" if "(" in text[start:end] else ""
    while end > start and not (text[end - 1].isalnum() or text[end - 1] in last):
        end -= 1
    return start, end


def _likeness(core: str) -> Iterator[tuple]:
    digits = digits_of(core)
    if len(digits) >= TAIL and "@" not in core:
        yield "digits", digits[-TAIL:]
    if "@" in core and len(name := core.split("@")[0].lower()) >= NAME:
        yield "name", name
    if len(core) >= REPEAT:
        yield "token", core.lower()


def tokens_of(text: str, base: list[tuple[int, int, int]]) -> Tokens:
    """Tokens with their labels: the kind of the first pattern that covers part of a token; none, or open, for others.

    A token is open where it may be personal data although no pattern has taken
    it: it looks like a whole e-mail address, IP or card number, or is similar,
    directly or through others, to a token under a pattern.
    """
    t = Tokens()
    before, at, words = -2, 0, 0
    for word, found in enumerate(_TOKEN.finditer(text)):
        if not _SIGNAL.search(found.group()):
            continue
        a, b = _core(text, *found.span())
        if a == b:
            continue
        while at < len(base) and base[at][2] <= found.start():
            at += 1
        over = [k for s, k, e in base[at:at + LABELS * 2] if s < found.end() and e > found.start()]
        i = len(t.spans)
        if word == before + 1:
            t.chain.append((i - 1, i))
        before = word
        core = text[a:b]
        t.spans.append((a, b))
        t.cores.append(core)
        t.shapes.append(shape_of(core))
        t.labels.append(over[0] if over else 0)
    last: dict[tuple, int] = {}
    edges = set()
    for i, core in enumerate(t.cores):
        for key in _likeness(core):
            if key in last:
                edges.add((last[key], i))
            last[key] = i
    t.skip = sorted(edges)
    t.allowed = [{0} for _ in t.spans]
    group = _groups(len(t.spans), t.skip)
    kinds: dict[int, set[int]] = {}
    for i, label in enumerate(t.labels):
        if label:
            kinds.setdefault(group[i], set()).add(label)
    for i, label in enumerate(t.labels):
        if not label:
            own = _OF_SHAPE.get(t.shapes[i])
            t.allowed[i] |= kinds.get(group[i], set()) | ({own} if own else set())
            if len(t.allowed[i]) > 1:
                t.labels[i] = -1
    return t


def _groups(n: int, edges: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@dataclass
class Field:
    """Log potentials: of a label for each shape, of neighbours in the text and of similar tokens.

    Those of similar tokens tell no kind from another, so what repeated addresses teach holds for cards.
    """

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, t: Tokens) -> np.ndarray:
        """Probabilities of the labels of each token, by loopy message passing over both kinds of edges.

        Tokens under a pattern keep its label and others theirs; open tokens
        take one of those allowed to them.
        """
        belief = self.unary[t.shapes].copy()
        for i, label in enumerate(t.labels):
            allowed = [label] if label >= 0 else list(t.allowed[i])
            shut = np.ones(LABELS, bool)
            shut[allowed] = False
            belief[i, shut] = -1e6
        edges = np.array(t.chain + t.skip, np.int64).reshape(-1, 2)
        pair = np.concatenate([np.broadcast_to(p, (n, LABELS, LABELS)) for p, n in ((self.chain, len(t.chain)), (self.skip, len(t.skip)))])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        sent = np.zeros((len(source), LABELS))
        for _ in range(ROUNDS if len(edges) else 0):
            whole = belief.copy()
            np.add.at(whole, target, sent)
            fresh = _log_sum((whole[source] - sent[back])[:, :, None] + pair, 1)
            fresh = DAMPING * sent + (1 - DAMPING) * (fresh - _log_sum(fresh, 1)[:, None])
            change, sent = float(np.abs(fresh - sent).max()), fresh
            if change < SETTLED:
                break
        np.add.at(belief, target, sent)
        return np.exp(belief - _log_sum(belief, 1)[:, None])


#: Pairs of labels of similar tokens that share a potential: both none, one kind, two kinds, none and a kind.
_TIES = np.array([[0 if a == b == 0 else 1 if a == b else 2 if a and b else 3 for a in range(LABELS)] for b in range(LABELS)])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.squeeze(most, axis) + np.log(np.exp(x - most).sum(axis=axis))


def situations(text: str) -> Iterator[tuple]:
    """`(shape, left, right, similar, label)` of each token with a label: those of its neighbours, `none` as -1.

    `similar` counts the labels of similar tokens. Open tokens, whose label is
    not known, are neither listed nor seen as neighbours. Few situations are
    possible (a token has at most six similar ones), however large the corpus.
    """
    t = tokens_of(text, base_spans(text))
    left, right = [-1] * len(t.spans), [-1] * len(t.spans)
    alike = [[0] * LABELS for _ in t.spans]
    for a, b in t.chain:
        left[b], right[a] = t.labels[a], t.labels[b]
    for a, b in t.skip:
        for i, j in ((a, b), (b, a)):
            if t.labels[j] >= 0:
                alike[i][t.labels[j]] += 1
    for i, label in enumerate(t.labels):
        if label >= 0:
            yield t.shapes[i], left[i], right[i], "".join(map(str, alike[i])), label


def fit(rows: list[tuple], steps: int = STEPS) -> Field:
    """Potentials under which the labels are likeliest given their neighbours, from `(*situation, n)` rows.

    The pseudo-likelihood is concave; it is climbed by steps of the whole
    gradient, each component by its own history. No rows leave all at zero.
    """
    f = Field(np.zeros((len(SHAPES), LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    if not rows:
        return f
    shape, left, right, label = (np.array([r[i] for r in rows]) for i in (0, 1, 2, 4))
    alike = np.array([[int(c) for c in r[3]] for r in rows], float)
    weight = np.log1p(np.array([r[5] for r in rows], float))
    weight /= weight.sum()
    one = np.eye(LABELS)
    shapes = np.eye(len(SHAPES))[shape]
    lefts, rights = (np.where((x >= 0)[:, None], one[np.maximum(x, 0)], 0.0) for x in (left, right))
    history = [np.full(p.shape, 1e-8) for p in (f.unary, f.chain, f.skip)]
    for _ in range(steps):
        s = f.unary[shape] + lefts @ f.chain + rights @ f.chain.T + alike @ f.skip
        off = (one[label] - np.exp(s - _log_sum(s, 1)[:, None])) * weight[:, None]
        skip = alike.T @ off
        skip = np.bincount(_TIES.ravel(), (skip + skip.T).ravel())[_TIES]
        for p, g, seen in zip((f.unary, f.chain, f.skip), (shapes.T @ off, lefts.T @ off + off.T @ rights, skip), history):
            g = g - PENALTY * p
            seen += g * g
            p += RATE * g / np.sqrt(seen)
    return f


def added_spans(t: Tokens, field_: Field) -> list[tuple[int, int, int]]:
    """`(start, kind, end)` of open tokens that are personal data with a probability above one half.

    Neighbouring pieces of a phone number are one span, up to 15 digits; any other token is a span of its own.
    """
    if -1 not in t.labels:
        return []
    likely = field_.marginals(t)
    found, size, before = [], 0, -2
    chained = {b for _, b in t.chain}
    for i, label in enumerate(t.labels):
        if label >= 0 or likely[i].max() <= 0.5 or not (kind := int(likely[i].argmax())):
            continue
        (a, b), digits = t.spans[i], len(digits_of(t.cores[i]))
        if kind == PHONE and found and found[-1][1] == PHONE and before == i - 1 and i in chained and size + digits <= 15:
            found[-1] = found[-1][0], kind, b
            size += digits
        else:
            found.append((a, kind, b))
            size = digits
        before = i
    return found


def _texts(df: DataFrame, text_col: str):
    """The text as bytes, null where it holds neither a digit nor an `@`, so that only others are read in Python."""
    return F.when(F.col(text_col).rlike("[0-9@]"), as_bytes(text_col)).alias("_text")


def _decoded(value: pa.Scalar) -> str:
    return (value.as_py() or b"").decode("utf-8", "replace")


def train(df: DataFrame, text_col: str = "text") -> Field:
    """A field learnt from all texts, with the patterns as teacher.

    Each text is cut into situations; equal ones are counted, in the tasks
    first, and the counts, a table of limited size, are what the fit needs to
    know of the corpus.
    """
    schema = pa.schema([("shape", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("similar", pa.string()), ("label", pa.int32()), ("n", pa.int64())])

    def rows(source) -> Iterator[tuple]:
        seen: Counter = Counter()
        for batch in source:
            for text in batch.column(0):
                seen.update(situations(_decoded(text)))
        for situation, n in seen.items():
            yield *situation, n

    texts = df.select(_texts(df, text_col)).where("_text IS NOT NULL")
    counted = texts.mapInArrow(lambda s: batches(schema, rows(s)), "shape int, left int, right int, similar string, label int, n long")
    table = counted.groupBy("shape", "left", "right", "similar", "label").agg(F.sum("n").alias("n")).toArrow()
    return fit(sorted(zip(*(c.to_pylist() for c in table.columns))))


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k - 1]}:{a}:{b}" for a, k, b in spans)


def find(df: DataFrame, field_: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, base_email, base_ip, base_card, base_phone)` for each whole text.

    `spans` lists what the patterns match and what the field adds, as
    `kind:start:end` in code points; the counts `n_*` are those of `spans`,
    `n_added` is the number that the field added, and the hash and the counts
    `base_*` are those of the patterns' spans alone. What a pattern matches always stays. A text without a digit or
    an `@`, also null and empty ones, has no spans. Every row stays, also
    repeated ones and those without an id; other columns are not read. One text
    is held at a time; time and memory grow with its length.
    """
    counts, base_counts = ([StructField(f"{of}_{k}", LongType()) for k in KINDS] for of in ("n", "base"))
    schema = StructType([*fields(df, id_col), *counts, StructField("base_sha256", StringType()),
                         StructField("spans", StringType()), StructField("n_added", LongType()), *base_counts])
    out = arrow_schema(schema)
    none = (0,) * len(KINDS)
    nothing = *none, hashlib.sha256(b"").hexdigest(), "", 0, *none
    shared = df.sparkSession.sparkContext.broadcast(field_)

    def rows(source) -> Iterator[tuple]:
        for batch in source:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    yield key, *nothing
                    continue
                text = _decoded(text)
                base = base_spans(text)
                more = added_spans(tokens_of(text, base), shared.value)
                spans = sorted(base + more)
                kinds, of_base = (Counter(k for _, k, _ in found) for found in (spans, base))
                yield (key, *(kinds[k] for k in range(1, LABELS)), hashlib.sha256(spelled(base).encode()).hexdigest(),
                       spelled(spans), len(more), *(of_base[k] for k in range(1, LABELS)))

    return df.select(id_col, _texts(df, text_col)).mapInArrow(lambda s: batches(out, rows(s), lambda r: 250 + len(r[6])), schema)
