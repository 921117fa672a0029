"""Toxic passages by maximum-scoring segment search.

The score of a word is its log-odds between toxic passages and clean text, with a
Dirichlet prior, learned from labelled documents.  Words of toxic documents that no
clean one shares are the lexicon; a word outside it falls back on the longest prefix
(3 to 6 characters) that is in it, so inflected forms of a stem are seen.  Every other
word has the log-odds of "no word of the lexicon", which is negative: in a passage a
share of the words is toxic, the density, and in clean text next to none is.  The
density is that of the passages themselves: hits belong to one passage while the
words between them cost less than a hit gains, and the density of those passages sets
that cost.  Where toxic words are strewn over whole documents that density is low, and
``LEAST_DENSITY`` keeps passages short.

A linear-time scan finds all maximal scoring segments (Ruzzo and Tompa, 1999).  Their
significance follows the extreme-value law of Karlin and Altschul (1990): lambda solves
sum p(s) exp(lambda s) = 1 over the scores of clean text, and K exp(-lambda x) bounds
the rate of segments of at least x.  A clean text of n words has Poisson(K n
exp(-lambda x)) of them, so the chance of r or more is a Poisson tail; a text's
evidence is -ln of the least of these chances over its r highest segments, each r paid
for with r (r + 1), which makes it a valid bound whatever r is best.  A logistic fit on
a part of the labelled rows that gave no counts turns the evidence into a probability.

Defined cases: a null or empty text has no words and gets the score of a text
without evidence; a null id is never learned from and counts as held out; repeated
rows are scored alike, and near copies are learned once; without labelled rows of both
kinds every score is the share of toxic labels (0.0 without labels); other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Memo, arrow_schema, bounded, crc_of_id, struct_of, texts_of
from tidemark.llm.ngram_join import shingles, word_memo

WORD = re.compile(r"\w+")
#: The classifier is fitted on at most so many labelled rows of each label, taken in the order of a hash of the id.
MAX_FIT_ROWS = 12_000
#: The Dirichlet prior of a token: this share of its count in both classes together.
PRIOR = 0.2
#: A toxic token's z-score, and its log-odds as a share of those of a token that no clean text has.
MIN_Z, MIN_SHARE = 3.0, 0.7
MIN_TOXIC_DOCUMENTS = 3
PREFIXES = (6, 5, 4, 3)
#: What each entry of the lexicon adds to its counts among the words of clean text and of passages.
UNSEEN = 0.5
#: The least share of toxic words in a passage: thinner ones fall apart into passages of their own.
LEAST_DENSITY = 1 / 3
#: Words between two hits are counted up to so many.
MAX_GAP = 1_000
#: Minima that near copies have in common.
COPY_MINIMA = 4
#: A prefix counts as a stem if words go on from it in so many toxic ways; with fewer, the longer forms speak for themselves.
MIN_BRANCHES = 3
FOLDS = 5


@dataclass
class ToxicModel:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    base: float = -0.05
    lam: float = 1.0
    k: float = 0.1
    slope: float = 0.0
    bias: float = 0.0

    def entry(self, word: str) -> str | None:
        """The lexicon's entry for a word; a stem's ends with a star."""
        if word in self.words:
            return word
        for n in PREFIXES:
            if len(word) > n and word[:n] in self.stems:
                return word[:n] + "*"
        return None

    def memo(self) -> Memo:
        words, stems, base = self.words, self.stems, self.base

        def score(word: str) -> float:
            if (own := words.get(word)) is not None:
                return own
            for n in PREFIXES:
                if len(word) > n and (stem := stems.get(word[:n])) is not None:
                    return stem
            return base

        return Memo(score)

    def probability(self, evidence: float) -> float:
        x = self.slope * min(evidence, 50.0) + self.bias
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, score), end exclusive, in linear time.

    Only positions with a positive score can open a segment; ``back`` links each
    candidate to the nearest earlier one with a smaller left sum, so no candidate
    is looked at twice.
    """
    total = 0.0
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    back: list[int] = []
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, end, left, right = i, i + 1, before, total
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = back[j]
            if j < 0 or found[j][3] >= right:
                break
            start, left = found[j][0], found[j][2]
            del found[j:], back[j:]
            j = len(found) - 1
        found.append((start, end, left, right))
        back.append(j)
    return [(a, b, r - l) for a, b, l, r in found]


def log_tail(mean: float, r: int) -> float:
    """ln of the chance that a Poisson variable is at least ``r``."""
    if mean <= 0:
        return -math.inf
    if mean >= r:  # no evidence there; the chance is over a third
        return 0.0
    total = term = 1.0
    j = 1
    while term > 1e-12 * total:
        term *= mean / (r + j)
        total += term
        j += 1
    return min(0.0, r * math.log(mean) - mean - math.lgamma(r + 1) + math.log(total))


def evidence_in(scores: list[float], n: int, lam: float, k: float) -> float:
    """-ln of the chance of segments as high as the highest ones among ``n`` clean words (0: none)."""
    best = 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        best = max(best, -log_tail(k * n * math.exp(-lam * s), r) - math.log(r * (r + 1)))
        if r >= 64:  # the evidence is far beyond any threshold by then
            break
    return best


def law_of(scores: list[tuple[float, float]]) -> tuple[float, float]:
    """(lambda, K) of clean text, given as (score, share of the words).

    Lambda is the positive root of sum p exp(lambda s) = 1.  From a positive score s a
    walk reaches x with a chance of exp(-lambda (x - s)) at most, since exp(lambda S)
    is a martingale; so segments of at least x start at a rate of K exp(-lambda x) at
    most, with K the sum of p exp(lambda s) over the positive scores.
    """
    value = lambda lam: sum(p * math.exp(min(lam * s, 600.0)) for s, p in scores) - 1
    if not any(s > 0 and p > 0 for s, p in scores) or sum(s * p for s, p in scores) >= 0:
        return 1.0, 1.0
    low, high = 0.0, 1.0
    while value(high) < 0:
        low, high = high, 2 * high
    if not low:  # the sum dips under one right after zero
        low = high
        while value(low) >= 0 and low > 1e-9:
            high, low = low, low / 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high, min(1.0, sum(p * math.exp(high * s) for s, p in scores if s > 0))


def density_of(gaps: np.ndarray, gain: float, clean: float) -> float:
    """The share of hits among the words of toxic passages.

    ``gaps[g]``: how many neighbouring hits have g other words between them; ``gain``:
    a hit's log-odds but for the density; ``clean``: the share of hits in clean text.
    Gaps belong to a passage while they cost less than a hit gains at the density of
    the passages so far, from half of the words on downwards.
    """
    density = 0.5
    for _ in range(50):
        cost = math.log1p(-clean) - math.log1p(-density)
        widest = int(min((gain + math.log(density)) / max(cost, 1e-9), len(gaps) - 1)) if gain + math.log(density) > 0 else 0
        inside = gaps[: widest + 1]
        hits, others = float(inside.sum()), float((inside * np.arange(len(inside))).sum())
        # a passage ends where the next hit is too far: that is one gap of a word at least
        new = min(0.5, (hits + 1) / (hits + others + 2))
        if new >= density - 1e-6:
            break
        density = new
    return density


def evidence_of(text: str, memo: Memo, model: ToxicModel) -> tuple[float, list[tuple[int, int, float]]]:
    """Evidence and segments, in words, of a whole text."""
    words = WORD.findall(text.lower())
    scores = list(map(memo.__getitem__, words))
    if not scores or max(scores) <= 0:
        return 0.0, []
    segments = maximal_segments(scores)
    return evidence_in([s for _, _, s in segments], len(scores), model.lam, model.k), segments


def features_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in (PREFIXES[0] + 1, *PREFIXES) if len(w) > n}


_COPY_TIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _with_copy_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a key of several minima, which unlike texts don't share."""
    memo = word_memo()
    for batch in bounded(batches, "_text"):
        keys = []
        for text in texts_of(batch, "_text"):
            h = shingles(text, memo)
            keys.append(((h[:, None] * _COPY_TIMES) >> np.uint64(1)).min(0).tobytes() if len(h) else b"")
        yield pa.RecordBatch.from_arrays([batch.column("_text").cast(pa.string()), batch.column("_y"), batch.column("_fold").cast(pa.int32()), pa.array(keys, pa.binary())], names=["_text", "_y", "_fold", "_h"])


def _hits(text: str, entry: Memo) -> tuple[list[str], list[int], int]:
    """(entries hit, numbers of words between neighbouring hits, words) of a text."""
    words = list(map(entry.__getitem__, WORD.findall(text.lower())))
    at = [i for i, e in enumerate(words) if e]
    return [words[i] for i in at], [min(b - a - 1, MAX_GAP) for a, b in zip(at, at[1:], strict=False)], len(words)


def fit(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_fit_rows: int = MAX_FIT_ROWS) -> ToxicModel:
    """Learn from labelled rows whose crc32(id) mod 5 is 1 to 4; 4 calibrates, 1 to 3 give counts."""
    fold = F.pmod(crc_of_id(id_col), F.lit(FOLDS))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y"), fold.alias("_fold")).where("_fold > 0").groupBy("_id", "_fold").agg(F.max("_y").alias("_y"))
    picked = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_fit_rows) for y in (0, 1)]
    # at most 2 * max_fit_rows ids of 24 bytes: small enough to broadcast at any input size
    rows = documents.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked[0].unionByName(picked[1])), "_id").select("_text", "_y", "_fold")
    # near copies are learned once: always the same one, also when a lost part is computed again
    counted = None
    rows = rows.mapInArrow(_with_copy_key, "_text string, _y int, _fold int, _h binary").groupBy("_h", "_y").agg(F.min(F.struct(F.xxhash64("_text", "_fold"), "_text", "_fold")).alias("x")).select("x._text", "_y", "x._fold").persist()
    try:
        sizes = {(r["_y"], r["c"]): r["n"] for r in rows.groupBy("_y", (F.col("_fold") == FOLDS - 1).alias("c")).agg(F.count("*").alias("n")).collect()}
        toxic, clean = (sum(n for (y, _), n in sizes.items() if y == v) for v in (1, 0))
        if not all(sizes.get((y, c), 0) for y in (0, 1) for c in (False, True)):
            share = toxic / (toxic + clean) if toxic + clean else 0.0
            return ToxicModel(bias=math.log((share + 1e-9) / (1 - share + 1e-9)) if share else -800.0)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = {0: Counter(), 1: Counter()}
            for batch in bounded(batches, "_text"):
                for text, y in zip(texts_of(batch, "_text"), batch.column("_y").to_pylist(), strict=True):
                    seen[y].update(features_of(text))
            names = [*seen[1], *(w for w in seen[0] if w not in seen[1])]
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                yield pa.RecordBatch.from_pydict({"w": part, "t": [seen[1][w] for w in part], "c": [seen[0][w] for w in part]}, pa.schema([("w", pa.string()), ("t", pa.int64()), ("c", pa.int64())]))

        learned = rows.where(F.col("_fold") < FOLDS - 1)
        counted = learned.mapInArrow(count, "w string, t long, c long").groupBy("w").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).persist()
        model = ToxicModel()
        _choose(model, counted)
        _score(model, learned)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo = model.memo()
            for batch in bounded(batches, "_text"):
                x = [min(evidence_of(t, memo, model)[0], 50.0) for t in texts_of(batch, "_text")]
                yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array(x, pa.float64())], names=["y", "x"])

        sample = rows.where(F.col("_fold") == FOLDS - 1).mapInArrow(measure, "y int, x double").collect()
    finally:
        for table in (rows, counted):
            if table is not None:
                table.unpersist()
    model.slope, model.bias = logistic(np.array([r["x"] for r in sample]), np.array([r["y"] for r in sample], float))
    return model


def _choose(model: ToxicModel, counted: DataFrame) -> None:
    """The lexicon: words and stems ``(w, t, c)`` whose log-odds between labels are high and sure."""
    totals = counted.groupBy(F.col("w").endswith("*").alias("stem")).agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()
    t_all, c_all = {r["stem"]: (r["t"], r["c"]) for r in totals}.get(False, (0, 0))
    prior = PRIOR * (t_all + c_all)
    t_sum, c_sum = t_all + prior, c_all + prior
    a, b = (F.col(x) + PRIOR * (F.col("t") + F.col("c")) for x in ("t", "c"))
    delta = F.log(a / (F.lit(t_sum) - a)) - F.log(b / (F.lit(c_sum) - b))
    most = math.log((1 + PRIOR) / PRIOR) + math.log(c_sum / t_sum) if t_all and c_all else math.inf
    odds = counted.select("w", "t", "c", delta.alias("d"), F.sqrt(1 / a + 1 / b).alias("sd")).where(F.col("d") >= MIN_SHARE * most)
    branches = odds.where(F.col("w").endswith("*")).groupBy(F.expr("concat(substring(w, 1, length(w) - 2), '*')").alias("w")).agg(F.count("*").alias("branches"))
    significant = odds.where((F.col("t") >= MIN_TOXIC_DOCUMENTS) & (F.col("d") >= MIN_Z * F.col("sd")) & (F.col("d") > 0)).join(branches, "w", "left")
    # from a bounded sample
    strong = significant.where(~F.col("w").endswith("*") | (F.col("branches") >= MIN_BRANCHES)).select("w").collect()
    model.words = {r["w"]: 0.0 for r in strong if not r["w"].endswith("*")}
    model.stems = {r["w"][:-1]: 0.0 for r in strong if r["w"].endswith("*")}


def _score(model: ToxicModel, learned: DataFrame) -> None:
    """Scores of the lexicon, the drift, and the law of clean text, from counts of words."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry, seen = Memo(model.entry), Counter()
        for batch in bounded(batches, "_text"):
            for text, y in zip(texts_of(batch, "_text"), batch.column("_y").to_pylist(), strict=True):
                hits, gaps, n = _hits(text, entry)
                seen[y, "n", ""] += n
                seen.update((y, "hit", e) for e in hits)
                seen.update((y, "gap", str(g)) for g in gaps)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*((*key, n) for key, n in seen.items()), strict=True), (pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["y", "what", "key", "n"])

    # the lexicon, two totals and MAX_GAP gaps: bounded by the sample
    found = {(r["y"], r["what"], r["key"]): r["n"] for r in learned.mapInArrow(tally, "y int, what string, key string, n long").groupBy("y", "what", "key").agg(F.sum("n").alias("n")).collect()}
    entries = [*model.words, *(x + "*" for x in model.stems)]
    if not entries:
        return
    toxic = {e: found.get((1, "hit", e), 0) + UNSEEN for e in entries}
    clean = {e: found.get((0, "hit", e), 0) + UNSEEN for e in entries}
    words, hits = found.get((0, "n", ""), 0) + UNSEEN * len(entries) + 1, sum(toxic.values())
    share = sum(clean.values()) / words
    gaps = np.zeros(MAX_GAP + 1)
    for (y, what, key), n in found.items():
        if y == 1 and what == "gap":
            gaps[int(key)] += n
    gain = sum(n * math.log(n / hits * words / clean[e]) for e, n in toxic.items()) / hits
    density = max(LEAST_DENSITY, density_of(gaps[:-1], gain, share))
    odds = {e: math.log(density * toxic[e] / hits * words / clean[e]) for e in entries}
    model.words = {e: odds[e] for e in model.words if odds[e] > 0}
    model.stems = {e: odds[e + "*"] for e in model.stems if odds[e + "*"] > 0}
    model.base = math.log1p(-density) - math.log1p(-share)
    known = [(odds[e], clean[e] / words) for e in entries if odds[e] > 0]
    model.lam, model.k = law_of([*known, (model.base, 1 - sum(p for _, p in known))])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and bias of a logistic fit by damped Newton steps."""
    design, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + ridge * w * [1, 0]
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([ridge, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


PASSAGE = struct_of("start long, end long, score double")
RESULT = struct_of("doc_id long, held_out boolean, score double, predicted int, evidence double, n_words long").add("passages", T.ArrayType(PASSAGE))


def score_documents(documents: DataFrame, model: ToxicModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document with its score and its toxic passages, as code points of the lower-cased text."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.pmod(crc_of_id(id_col), F.lit(FOLDS)) == 0, F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
    schema = arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = model.memo()
        for batch in bounded(batches, "text"):
            scores, evidences, counts, passages = [], [], [], []
            for text in texts_of(batch, "text"):
                evidence, segments = evidence_of(text, memo, model)
                spans = [(m.start(), m.end()) for m in WORD.finditer(text.lower())] if segments else []
                evidences.append(evidence)
                scores.append(model.probability(evidence))
                counts.append(len(spans) if segments else None)
                passages.append([{"start": spans[a][0], "end": spans[b - 1][1], "score": s} for a, b, s in segments])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidences, pa.float64()), pa.array(counts, pa.int64()), pa.array(passages, schema.field("passages").type)], schema=schema)

    return rows.mapInArrow(run, RESULT)


def drop_toxic(documents: DataFrame, model: ToxicModel, *, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose texts score below 0.5; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = model.memo()
        for batch in bounded(batches, text_col):
            keep = [model.probability(evidence_of(t, memo, model)[0]) < 0.5 for t in texts_of(batch, text_col)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
