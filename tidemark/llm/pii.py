"""Personal data by a skip-chain conditional random field over pattern matches.

Exact patterns give the base spans: e-mail addresses, IPv4 addresses, card numbers
with a valid check digit, and international phone numbers.  They always stay.  The
field decides about the other strings that look alike: digit strings that no pattern
takes, addresses without a top-level domain or written with "at", and account names
that belong to an address.

Nodes are base spans (observed) and candidates, in text order.  A node's own
potential comes from its shape and from what stands before it; neighbours share chain
potentials; nodes with the same key (digits without a country code, the account name)
share skip potentials, and nodes with a similar one (the last seven digits, the account
name without its separators) weaker ones.  Each occurrence is linked to the next one
and to the first base span of its key, so a string that repeats n times has 2 n edges
at most and no occurrence is far from what is known.  Loopy message passing runs until
messages settle, for up to ``ROUNDS`` rounds and one for each node; a candidate whose
most likely label isn't "none" becomes a span.

Training is piecewise, from counts over all documents.  A match is masked where it
stands, a phone number without its country code or an account name without its
domain, and the node's potential is a logistic model that tells masked matches, in
their contexts, from candidates that are no matches.  Pair potentials are the log of
how much more often two labels meet than by chance.  Penalties, smoothing and the
weight of each kind of pair are those with the best likelihood on a tenth of the
documents that is held out.  A shape is up to six group lengths and its separators, and
a context is one of about a hundred, so the counts that reach the driver are bounded by
the format and not by the corpus.

Defined cases: null and empty texts have no spans; a null id stays null; a number that
fails its check digit or range never becomes a span of that kind; spans of the field
never overlap base spans, and of candidates that overlap the first and then the longest
counts; documents that repeat get the same spans; an empty table trains a field that
adds nothing; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from tidemark.llm.common import bounded, struct_of, texts_of, with_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
ROUNDS, DAMPING = 30, 0.5
#: Buckets of the word before a node; and one document in so many is held out from training.
CONTEXTS, HELD_OUT = 64, 10
#: What is tried for the penalty of the node potentials, and for the smoothing and the weight of pairs.
PENALTIES, EQUALS, WEIGHTS = (0.1, 1.0, 10.0), (1.0, 5.0, 20.0), (0.0, 0.25, 0.5, 1.0)
PAIRS = ("chain", "skip", "similar")
CLIP = 4.0

ANY = re.compile("[0-9@]|\\bat\\b")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-".decode())
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

DIGITS = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[ ().-]{0,2}[0-9])*+(?![0-9A-Za-z])")
LOOSE_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\s?[\[(]at[\])]\s?)[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,8}+")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z]{1,64}+[._][0-9]{1,10}+(?![A-Za-z0-9@])")
GROUP = re.compile("[0-9]+")
NOT_DIGIT = re.compile("[^0-9]+")
WORD_BEFORE = re.compile(r"[^\W_]+$")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; each ``@`` is looked at once, so no run of letters is tried again."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind as listed, then by start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if _octets(m[0])]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


@dataclass
class Node:
    start: int
    end: int
    shape: str
    keys: tuple[str, ...]
    label: str | None = None  # of a base span
    context: str = ""
    similar: tuple[str, ...] = ()


def digit_shape(text: str) -> str:
    """Lengths of the digit groups and what separates them, with the checks that a kind has."""
    groups = GROUP.findall(text)
    digits = "".join(groups)
    shape = "-".join(str(min(len(g), 20)) for g in groups[:6]) + ("+" if len(groups) > 6 else "")
    separators = "".join(sorted(set(re.sub("[0-9]", "", text))))
    if 16 <= len(digits) <= 19:
        shape += ":luhn" if luhn(digits) else ":bad"
    elif separators == "." and len(groups) == 4:
        shape += ":ip" if _octets(text) else ":bad"
    return f"d{shape}{separators}"


def _keys(label: str, text: str) -> tuple[str, ...]:
    if label == "email":
        local = re.split(r"@|\s?[\[(]at[\])]\s?", text)[0].lower()
        return ("a" + local,)
    digits = NOT_DIGIT.sub("", text)
    if label == "ip":
        return ("i" + digits,)
    # a phone number is the same with and without its country code
    return ("n" + digits, "n" + digits[-10:]) if len(digits) > 10 and label != "card" and len(digits) < 16 else ("n" + digits,)


def _similar(label: str, text: str) -> tuple[str, ...]:
    """Keys that spellings of one string share."""
    if label == "email":
        return ("b" + re.sub(r"[._%+-]", "", re.split(r"@|\s?[\[(]at[\])]\s?", text)[0].lower()),)
    digits = NOT_DIGIT.sub("", text)
    return ("m" + digits[-7:],) if label != "ip" and len(digits) >= 7 else ()


def context_of(text: str, start: int) -> str:
    """What stands before a place: a mark, one of ``CONTEXTS`` buckets of words, or the text's start."""
    before = text[max(0, start - 30) : start].rstrip()
    if not before:
        return "start"
    if not before[-1].isalnum():
        return before[-1] if before[-1] in ".,:;()[]<>=|*#/+-" else "other"
    return f"w{xxh32_intdigest(WORD_BEFORE.search(before)[0].lower().encode('utf-8', 'surrogatepass')) % CONTEXTS}"


def _masked(kind: str, text: str) -> list[str]:
    """Shapes of a match without what its pattern hangs on."""
    if kind == "phone":
        digits = GROUP.search(text)
        rest = text[digits.end() :].lstrip(" .-") if digits else ""
        return [digit_shape(rest)] if sum(map(len, GROUP.findall(rest))) >= 7 else []
    if kind == "email":
        local, _, domain = text.partition("@")
        return ["a:at", "a:loose" if "." not in domain.rstrip(".") else "a:full", *(["a:account"] if ACCOUNT.fullmatch(local) else [])]
    return [digit_shape(text)]


def nodes_of(text: str, base: list[tuple[str, int, int]]) -> list[Node]:
    """Base spans and candidates that don't overlap them, in text order."""
    out = [Node(a, b, k, _keys(k, text[a:b]), k, context_of(text, a), _similar(k, text[a:b])) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    found: list[Node] = []
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 7:
            a, b = m.start(), m.end()
            if text[a] == "(" and ")" not in text[a:b]:
                a += 1
            if 7 <= len(NOT_DIGIT.sub("", text[a:b])) <= 19:
                shape = digit_shape(text[a:b])
                found.append(Node(a, b, shape, _keys("ip" if ":ip" in shape else "none", text[a:b]), None, context_of(text, a), _similar("ip" if ":ip" in shape else "none", text[a:b])))
    if "@" in text or "at" in text and ("[at]" in text or "(at)" in text):
        found += [Node(m.start(), m.end(), "a:at" if "@" not in m[0] else "a:loose", _keys("email", m[0]), None, context_of(text, m.start()), _similar("email", m[0])) for m in LOOSE_AT.finditer(text)]
    accounts = {k for n in out if n.label == "email" for k in (*n.keys, *n.similar)}
    if accounts:
        found += [Node(m.start(), m.end(), "a:account", ("a" + m[0].lower(),), None, context_of(text, m.start()), _similar("email", m[0])) for m in ACCOUNT.finditer(text) if {"a" + m[0].lower(), *_similar("email", m[0])} & accounts]
    found.sort(key=lambda n: (n.start, -n.end))
    i = last = 0
    for n in found:
        while i < len(taken) and taken[i][1] <= n.start:
            i += 1
        if n.start >= last and (i == len(taken) or taken[i][0] >= n.end):
            out.append(n)
            last = n.end
    return sorted(out, key=lambda n: (n.start, n.end))


def _table() -> list[list[float]]:
    return [[0.0] * len(LABELS) for _ in LABELS]


@dataclass
class Crf:
    """Log potentials: of a node's shape and context, and of the labels of two nodes."""

    shapes: dict[str, list[float]] = field(default_factory=dict)
    contexts: dict[str, list[float]] = field(default_factory=dict)
    bias: list[float] = field(default_factory=lambda: [2.0, 0.0, 0.0, 0.0, 0.0])
    chain: list[list[float]] = field(default_factory=_table)
    skip: list[list[float]] = field(default_factory=_table)
    similar: list[list[float]] = field(default_factory=_table)

    def unary(self, node: Node) -> list[float]:
        if node.label:
            return [0.0 if x == node.label else -50.0 for x in LABELS]
        shape, context = (t.get(k, [0.0] * len(LABELS)) for t, k in ((self.shapes, node.shape), (self.contexts, node.context)))
        own = [sum(x) for x in zip(self.bias, shape, context, strict=True)]
        if ":bad" in node.shape:  # of which a check has ruled kinds out
            own = [x if label in ("none", "phone") else -50.0 for x, label in zip(own, LABELS, strict=True)]
        return own


def edges_of(nodes: list[Node]) -> dict[str, list[tuple[int, int]]]:
    """Chain edges, and skip edges of each occurrence of a key with the next one and with its first base span."""
    seen: set[tuple[int, int]] = set()
    out = {"chain": [(i, i + 1) for i in range(len(nodes) - 1)]}
    for name, keys_of in (("skip", lambda n: n.keys), ("similar", lambda n: n.similar)):
        last: dict[str, int] = {}
        known: dict[str, int] = {}
        found = set()
        for j, n in enumerate(nodes):
            for k in keys_of(n):
                found |= {(t[k], j) for t in (last, known) if k in t and t[k] != j}
                last[k] = j
                if n.label:
                    known.setdefault(k, j)
        out[name] = sorted(found - seen)  # equal strings aren't only similar
        seen |= found
    return out


def marginals(model: Crf, nodes: list[Node]) -> np.ndarray:
    """Beliefs of loopy sum-product message passing; all messages of a round are one array."""
    belief = unary = np.array([model.unary(n) for n in nodes])
    edges = edges_of(nodes)
    pairs = np.array([e for name in PAIRS for e in edges[name]], int).reshape(-1, 2)
    if len(pairs):
        power = np.exp(np.concatenate([np.broadcast_to(getattr(model, name), (len(edges[name]), 5, 5)) for name in PAIRS]))
        # forward messages, then backward ones
        source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        power, n = np.concatenate([power, power.transpose(0, 2, 1)]), len(pairs)
        message = np.zeros((2 * n, 5))
        for _ in range(ROUNDS + len(nodes)):
            # what a node believes, but for what the other end told it
            own = belief[source] - np.roll(message, n, 0)
            own = np.exp(own - own.max(1, keepdims=True))
            new = np.log(np.einsum("ex,exy->ey", own, power) + 1e-300)
            new = DAMPING * message + (1 - DAMPING) * (new - new.max(1, keepdims=True))
            change = np.abs(new - message).max()
            message, belief = new, unary.copy()
            np.add.at(belief, target, message)
            if change < 1e-4:
                break
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def spans_of(model: Crf, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), both by kind as listed, then by start."""
    if not ANY.search(text):
        return [], []
    base = base_spans(text)
    nodes = nodes_of(text, base)
    if len(nodes) == len(base):
        return base, base
    added = []
    for n, best in zip(nodes, marginals(model, nodes).argmax(1).tolist(), strict=True):
        if n.label is None and best:
            added.append((LABELS[best], n.start, n.end))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _count(text: str, counts: Counter) -> None:
    held = int(xxh32_intdigest(text.encode("utf-8", "surrogatepass")) % HELD_OUT == 0)
    nodes = nodes_of(text, base_spans(text))
    for n in nodes:
        for shape in _masked(n.label, text[n.start : n.end]) if n.label else [n.shape]:
            counts["node", shape, n.context, n.label or "none", held] += 1
    for name, edges in edges_of(nodes).items():
        for i, j in edges:
            counts[name, nodes[i].label or "none", "", nodes[j].label or "none", held] += 1


def fit(documents: DataFrame, *, text_col: str = "text") -> Crf:
    """Potentials from counts over all documents, added up in each task before they are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in bounded(batches, "text"):
            for text in texts_of(batch, "text"):
                if ANY.search(text):
                    _count(text, counts)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*((*k, n) for k, n in counts.items()), strict=True)], names=["what", "a", "b", "label", "held", "n"])

    keys = ["what", "a", "b", "label", "held"]
    counted = documents.select(F.col(text_col).alias("text")).mapInArrow(run, "what string, a string, b string, label string, held long, n long").groupBy(*keys).agg(F.sum("n").alias("n")).collect()
    return from_counts({tuple(r[k] for k in keys): r["n"] for r in counted})


Counts = dict[tuple[str, str, str, str, int], int]


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def node_potentials(counts: Counts) -> tuple[list[float], dict[str, list[float]], dict[str, list[float]]]:
    """(bias, of shapes, of contexts): a logistic model of labels, its penalty by held-out likelihood."""
    places = sorted({(a, b) for what, a, b, _, _ in counts if what == "node"})
    shapes, contexts = (sorted({p[i] for p in places}) for i in (0, 1))
    if not places:
        return Crf().bias, {}, {}
    of_shape, of_context = np.array([shapes.index(a) for a, _ in places]), np.array([contexts.index(b) for _, b in places])
    seen, held = (np.array([[counts.get(("node", a, b, x, h), 0) for x in LABELS] for a, b in places], float) for h in (0, 1))
    total = max(seen.sum(), 1.0)
    best = None
    for penalty in PENALTIES:
        weights = [np.zeros((1, 5)), np.zeros((len(shapes), 5)), np.zeros((len(contexts), 5))]
        at = [np.zeros(len(places), int), of_shape, of_context]
        squares = [np.full_like(w, 1e-8) for w in weights]
        for _ in range(400):  # by steps that shrink with the gradients so far
            scores = sum(w[i] for w, i in zip(weights, at, strict=True))
            wrong = seen - seen.sum(1, keepdims=True) * np.exp(_log_softmax(scores))
            for w, i, q in zip(weights, at, squares, strict=True):
                slope = np.zeros_like(w)
                np.add.at(slope, i, wrong)
                slope = (slope - penalty * w) / total
                q += slope**2
                w += 0.5 * slope / np.sqrt(q)
        fits = float((held * _log_softmax(sum(w[i] for w, i in zip(weights, at, strict=True)))).sum())
        if best is None or fits > best[0]:
            best = (fits, weights)
    bias, own, context = best[1]
    return bias[0].tolist(), dict(zip(shapes, own.tolist(), strict=True)), dict(zip(contexts, context.tolist(), strict=True))


def pair_potentials(counts: Counts, name: str) -> list[list[float]]:
    """How much more often two labels meet than by chance; smoothing and weight by held-out likelihood."""
    seen, held = (np.array([[counts.get((name, a, "", b, h), 0) for b in LABELS] for a in LABELS], float) for h in (0, 1))
    best = None
    for equal in EQUALS if name != "chain" else (0.0,):
        both = seen + 1.0 + equal * np.eye(5)
        rows, columns = both.sum(1, keepdims=True), both.sum(0, keepdims=True)
        meets = np.clip(np.log(both * both.sum() / (rows * columns)), -CLIP, CLIP)
        for weight in WEIGHTS:
            forth, back = (_log_softmax(np.log(prior / prior.sum()) + weight * m) for prior, m in ((columns, meets), (rows.T, meets.T)))
            fits = float((held * forth).sum() + (held.T * back).sum())
            # without held-out pairs of its kind: the last, which trusts equal strings most
            if best is None or fits > best[0] or not held.any() and name == "skip":
                best = (fits, weight * meets)
    return best[1].tolist()


def from_counts(counts: Counts) -> Crf:
    bias, shapes, contexts = node_potentials(counts)
    return Crf(shapes, contexts, bias, *(pair_potentials(counts, name) for name in PAIRS))


RESULT = struct_of("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(documents: DataFrame, model: Crf, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Numbers of base spans by kind, their digest, and all spans, in code points."""
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in bounded(batches, "text"):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
                base, every = spans_of(model, text)
                if not every:
                    out.append((doc, 0, 0, 0, 0, nothing, ""))
                    continue
                n = Counter(k for k, *_ in base)
                out.append((doc, *(n[k] for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=RESULT.names)

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, RESULT)


def masked_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, and each stretch of spans that overlap, as its first kind in brackets."""
    out, last = [], 0
    stretches: list[list] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if stretches and a < stretches[-1][2]:
            stretches[-1][2] = max(stretches[-1][2], b)
        else:
            stretches.append([k, a, b])
    for k, a, b in stretches:
        out += [text[last:a], f"[{k.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


def mask(documents: DataFrame, model: Crf, *, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns and masked texts; ``n_chars`` follows the text."""
    return with_text(documents, text_col, lambda texts: [masked_text(t, spans_of(model, t)[1]) for t in texts])
