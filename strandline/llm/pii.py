"""Personal data: base patterns, then a skip-chain conditional random field that finds what the patterns miss.

Base spans come from the four patterns alone and are never changed. The field's variables are the tokens (runs of other
characters than white space) that could be personal data at all: those with a digit, an ``@`` or a ``+``, and those
that equal, without their punctuation, the local part of an address in the same text. Every other token is a known
``none``. Labels are the four kinds and none.

* Nodes have weights by label for marks of a token's form: how many digits and dots, an ``@``, a ``+``, letters, and
  whether it looks like a card, address or phone but fails that kind's check.
* Chain edges join neighbouring tokens, skip edges tokens that name the same thing: equal letters and digits, an equal
  local part, or equal last ten digits, however they are written. A token is linked with the one before it and with the
  first of its thing that a base span covers, so a text has no more than two skip edges for each token.

All weights are fitted together by conditional pseudo-likelihood: each labelled token's probability given its form and its
neighbours' labels, over all documents. Tokens under base spans have their kind, tokens that share nothing with one are
none; a token that names the same thing as a base span without being covered is what the field is asked for, so its label is
unknown in training. Tokens are counted by form and neighbours first; there are at most 448 forms and 900 neighbourhoods,
so the table that the driver fits is bounded whatever the corpus.

Tokens under a base span are fixed to its kind; loopy belief propagation passes messages along chains and skip links until
they no longer change, and a token is added as a span where a kind's belief reaches ``least``. The field carries labels on from base
spans: only tokens that name the same thing as a base span are added, and a text without base spans gets none.

Edge cases: a null text is an empty one and has no spans; a null doc_id stays null, ids do not matter to what is found;
ties of belief keep none; rows that repeat are treated alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match can only begin at the first of a run of digits, so possessive runs find what the plain patterns find
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\s]+")
_CORE = re.compile(r"[^A-Za-z0-9@]+")
#: Marks around a token that are not part of it.
_EDGE = ".,;:!?()[]<>\"'"
Span = tuple[int, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start."""
    out: list[Span] = []
    if "@" in text:
        free = 0
        at = text.find("@")
        while at >= 0:
            before = text[free:at]
            n = len(before) - len(before.rstrip(LOCAL))
            m = _DOMAIN.match(text, at + 1) if n else None
            if m:
                out.append((0, at - n, m.end()))
                free = m.end()
            else:
                free = at + 1
            at = text.find("@", free)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((3, *m.span()))
    return out


#: Least digits of each class of a token's number of digits, and of dots.
DIGITS, DOTS = (1, 3, 4, 9, 13, 20), (1, 3, 4)
MARKS = len(DIGITS) + len(DOTS) + 7
UNKNOWN = NONE + 1
#: Characters that a name has at least.
LEAST_NAME = 4


def _fails(token: str, digits: str) -> bool:
    """Whether a token looks like a card, an address or a phone, but fails the check."""
    if token.startswith("+"):
        return not 9 <= len(digits) <= 15
    parts = token.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        return any(len(p.lstrip("0")) > 3 or int(p.lstrip("0") or 0) > 255 for p in parts)
    return 13 <= len(digits) <= 19 and not _luhn(digits)


def form(token: str) -> int:
    """The marks of a token's form, packed."""
    bare = token.strip(_EDGE)
    digits = "".join(_DIGIT.findall(token))
    letters = any(c.isalpha() for c in token)
    flags = [("@" in token), ("+" in token), letters, not letters and _fails(bare, digits)]
    code = bisect_right(DIGITS, len(digits)) * (len(DOTS) + 1) + bisect_right(DOTS, bare.count("."))
    for f in flags:
        code = 2 * code + int(f)
    return code


def marks(code: int) -> np.ndarray:
    out = np.zeros(MARKS)
    out[0] = 1
    for k in range(4):
        out[4 - k] = code >> k & 1
    digits, dots = divmod(code >> 4, len(DOTS) + 1)
    out[5 + digits] = 1
    if dots:
        out[5 + len(DIGITS) + dots] = 1
    return out


def variables(text: str, spans: list[Span]) -> tuple[list[tuple[int, int, int, int, str]], list[int | None]]:
    """Tokens that may be personal data: (index of the token, start, end, form, what it names), and the kind of the base span
    that each lies under (most specific kind first), if any."""
    locals_ = {text[s:e].partition("@")[0].lower() for k, s, e in spans if k == 0}
    by_kind = [sorted((s, e) for k, s, e in spans if k == kind) for kind in range(NONE)]
    own: list[tuple[int, int, int, int, str]] = []
    known: list[int | None] = []
    for i, m in enumerate(_TOKEN.finditer(text)):
        t = m[0]
        bare = t.strip(_EDGE).lower()
        local = bare.partition("@")[0]
        if not (bare in locals_ or "@" in t or "+" in t or _DIGIT.search(t)):
            continue
        kind, covered = None, t
        for k, found in enumerate(by_kind):  # spans of a kind do not overlap
            j = bisect_left(found, (m.end(),)) - 1
            if j >= 0 and found[j][1] > m.start():
                kind, covered = k, text[slice(*found[j])]
                break
        digits = "".join(_DIGIT.findall(covered if kind else t))
        if kind == 0 or local in locals_:
            name = local if kind is None or local in locals_ else covered.partition("@")[0].lower()
        elif kind or len(digits) >= 7 and not any(c.isalpha() for c in t):
            name = "#" + digits[-10:]
        else:
            name = _CORE.sub("", t).lower()
        if len(name) < LEAST_NAME:  # too short to tell one thing from another
            name = ""
        own.append((i, m.start(), m.end(), form(t), name))
        known.append(kind)
    return own, known


def _skips(own: list[tuple]) -> list[tuple[int, int]]:
    """Links of each token with the one before it that names the same."""
    last: dict[str, int] = {}
    out = []
    for j, (*_, name) in enumerate(own):
        if name:
            if name in last:
                out.append((last[name], j))
            last[name] = j
    return out


def _links(own: list[tuple], known: list[int | None]) -> list[tuple[int, int]]:
    """These, and of each token with the first that a base span covers."""
    out = _skips(own)
    first: dict[str, int] = {}
    for j, (v, y) in enumerate(zip(own, known)):
        if y is not None and v[4]:
            first.setdefault(v[4], j)
    had = set(out)
    more = [(min(first[v[4]], j), max(first[v[4]], j)) for j, v in enumerate(own) if v[4] in first and first[v[4]] != j]
    return out + [x for x in more if x not in had]


def _candidate(text: str) -> bool:
    return "@" in text or "+" in text or _DIGIT.search(text) is not None


def train(docs: DataFrame) -> DataFrame:
    """form, around, label, n: how often tokens of each form have each label beside these labels (left, right, similar before and after, packed)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for x in b.column("text"):
                text = x.as_py() or ""
                if not _candidate(text):
                    continue
                own, known = variables(text, base_spans(text))
                named = {v[4] for v, y in zip(own, known) if y is not None}
                label = [y if y is not None else UNKNOWN if v[4] in named else NONE for v, y in zip(own, known)]
                at = {v[0]: y for v, y in zip(own, label)}
                before, after = [UNKNOWN] * len(own), [UNKNOWN] * len(own)
                for a, c in _skips(own):
                    before[c], after[a] = label[a], label[c]
                for v, y, s, t in zip(own, label, before, after):
                    if y != UNKNOWN:
                        seen[v[3], ((at.get(v[0] - 1, NONE) * 6 + at.get(v[0] + 1, NONE)) * 6 + s) * 6 + t, y] += 1
        rows = [(*k, n) for k, n in seen.items()]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["form", "around", "label", "n"])

    return docs.select("text").mapInArrow(task, "form int, around int, label int, n long").groupBy("form", "around", "label").agg(F.sum("n").alias("n"))


class Model:
    """Weights of marks by label (node), of neighbouring labels (chain) and of similar tokens that agree (skip, one weight for all kinds and one for none)."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.node, self.chain, self.skip = node, chain, skip


def _design(form_: int, around: int) -> np.ndarray:
    """For each label, how often each weight counts in its score."""
    k = NONE + 1
    around, t = divmod(around, 6)
    around, s = divmod(around, 6)
    left, right = divmod(around, 6)
    out = np.zeros((k, MARKS * k + k * k + 2))
    x = marks(form_)
    for y in range(k):
        out[y, y * MARKS : (y + 1) * MARKS] = x
        if left < k:
            out[y, MARKS * k + left * k + y] += 1
        if right < k:
            out[y, MARKS * k + y * k + right] += 1
        for o in (s, t):
            if o == y:  # agreement on a kind, whichever, or on none
                out[y, MARKS * k + k * k + int(y == NONE)] += 1
    return out


def fit(counted: DataFrame, ridge: float = 0.1, rounds: int = 50) -> Model:
    """The weights of greatest conditional pseudo-likelihood, less ``ridge`` / 2 times their squares, by Newton's method."""
    k = NONE + 1
    rows = counted.orderBy("form", "around", "label").collect()  # 448 x 900 x 5 at most, whatever the corpus
    width = MARKS * k + k * k + 2
    w = np.zeros(width)
    design: dict[tuple[int, int], np.ndarray] = {}
    last = -np.inf
    step = np.zeros(width)
    for _ in range(rounds):
        value, slope, curve = -ridge / 2 * w @ w, -ridge * w, ridge * np.eye(width)
        for code, around, label, n in rows:
            d = design.setdefault((code, around), _design(code, around)) if len(design) < 4096 else design.get((code, around), _design(code, around))
            score = d @ w
            top = score.max()
            p = np.exp(score - top)
            p /= p.sum()
            value += n * (score[label] - top - np.log(np.exp(score - top).sum()))
            mean = p @ d
            slope += n * (d[label] - mean)
            curve += n * ((d * p[:, None]).T @ d - np.outer(mean, mean))
        if value < last:  # too far: half of it back
            step = step / 2
            w = w - step
            continue
        if value - last < 1e-6 * max(1.0, abs(value)):
            break
        last = value
        step = np.linalg.solve(curve, slope)
        w = w + step
    return Model(w[: MARKS * k].reshape(k, MARKS), w[MARKS * k : -2].reshape(k, k), np.diag([*[w[-2]] * NONE, w[-1]]))


#: A message that changes by less is still.
STILL = 1e-5


def beliefs(own: list[tuple], known: list[int | None], model: Model) -> np.ndarray:
    """Loopy belief propagation until messages no longer change: a row of label probabilities for each variable."""
    n, labels = len(own), NONE + 1
    nodes: dict[int, np.ndarray] = {}
    unary = np.stack([nodes.setdefault(v[3], model.node @ marks(v[3])) for v in own])
    place = np.array([v[0] for v in own])
    unary[np.append(True, np.diff(place) > 1)] += model.chain[NONE]  # beside a token that is none for sure
    unary[np.append(np.diff(place) > 1, True)] += model.chain[:, NONE]
    for j, y in enumerate(known):
        if y is not None:
            unary[j] = -1e3
            unary[j, y] = 0
    chain = [(j - 1, j) for j in np.flatnonzero(np.diff(place) == 1) + 1]
    links = _links(own, known)
    if not chain and not links:
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    a, b = np.array([*chain, *links]).T
    src, dst = np.concatenate((a, b)), np.concatenate((b, a))
    pots = np.stack([model.chain, model.chain.T, model.skip])
    which = np.concatenate((np.repeat([0, 2], [len(chain), len(links)]), np.repeat([1, 2], [len(chain), len(links)])))
    back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
    # messages by their source, so that what leaves a variable is found at once
    order = np.argsort(src, kind="stable")
    first = np.searchsorted(src[order], np.arange(n + 1))
    msg, total, now = np.zeros((len(src), labels)), unary.copy(), np.arange(len(src))
    for _ in range(max(50, len(a))):  # news travels a link a round, and only where there is news is anything computed
        out = (total[src[now]] - msg[back[now]])[:, :, None] + pots[which[now]]
        top = out.max(1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
        new = 0.5 * msg[now] + 0.5 * (new - new.max(1, keepdims=True))
        step = new - msg[now]
        msg[now] = new
        np.add.at(total, dst[now], step)
        moved = now[np.abs(step).max(1) >= STILL]
        if not len(moved):
            break
        heard = np.unique(dst[moved])
        size = first[heard + 1] - first[heard]
        leaving = order[np.repeat(first[heard] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())]
        now = np.union1d(moved, leaving)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[Span], model: Model, least: float) -> list[Span]:
    own, known = variables(text, base)
    named = {v[4] for v, y in zip(own, known) if y is not None and v[4]}
    asked = [j for j, v in enumerate(own) if known[j] is None and v[4] in named]
    if not asked:
        return []
    p = beliefs(own, known, model)
    out: list[Span] = []
    last = -2
    for j in asked:
        v = own[j]
        y = int(p[j].argmax())
        if y < NONE and p[j, y] >= least:
            t = text[v[1] : v[2]]
            s, e = v[1] + len(t) - len(t.lstrip(_EDGE)), v[2] - (len(t) - len(t.rstrip(_EDGE)))
            if s >= e:
                continue
            if out and out[-1][0] == y and v[0] == last + 1 and own[j - 1][4] == v[4]:
                out[-1] = (y, out[-1][1], e)  # neighbours that name the same are one span
            else:
                out.append((y, s, e))
            last = v[0]
    return out


def find(docs: DataFrame, model, least: float = 0.9) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end) in code points, by kind, then start."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("kind", pa.int32()), ("s", pa.int64()), ("e", pa.int64())]))
    names = ("kind", "s", "e")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, spans = [], []
            for x in b.column("text"):
                text = x.as_py() or ""
                own = base_spans(text) if _candidate(text) else []
                more = added_spans(text, own, shared.value, least) if own else []
                base.append([dict(zip(names, s)) for s in own])
                spans.append([dict(zip(names, s)) for s in sorted([*own, *more])])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, span), pa.array(spans, span)], ["doc_id", "base", "spans"])

    made = "array<struct<kind:int,s:bigint,e:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id long, base {made}, spans {made}")


def detect(docs: DataFrame, least: float = 0.9) -> DataFrame:
    return find(docs, fit(train(docs)), least)


def digest(spans: str) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    name = lambda x: F.get(F.array(*[F.lit(k) for k in KINDS]), x["kind"])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")
