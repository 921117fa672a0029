import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity as X


def brute_segments(scores):
    """Maximal segments by their recursive definition: the best segment, then both sides of it."""
    if not scores or max(scores) <= 0:
        return []
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            total = sum(scores[i:j])
            if best is None or total > best[0] + 1e-9 or abs(total - best[0]) < 1e-9 and j - i < best[2] - best[1]:
                best = (total, i, j)
    total, i, j = best
    left = [(a, b, s) for a, b, s in brute_segments(scores[:i])]
    right = [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]
    return [*left, (i, j, total), *right]


def test_segments_against_brute_force():
    draw = random.Random(5)
    for _ in range(400):
        # distinct weights, so that no two segments tie
        scores = [draw.choice([-1, 1]) * draw.random() * 4 for _ in range(draw.randint(0, 14))]
        got = X.maximal_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores)], scores
        assert all(abs(s - sum(scores[a:b])) < 1e-9 for a, b, s in got)


def test_segments_are_linear():
    assert len(X.maximal_segments([1.0, -2.0] * 200_000)) == 200_000


def test_evidence_grows_with_segments_and_falls_with_length():
    assert X.evidence_in([], 100, 1, 0.1) == 0
    assert X.evidence_in([9, 9], 100, 1, 0.1) > X.evidence_in([9], 100, 1, 0.1) > X.evidence_in([9], 1000, 1, 0.1)
    assert X.evidence_in([0.1] * 60, 27_000, 1, 0.1) == 0


def test_poisson_tail():
    for mean in (0.001, 0.3, 2.0, 9.0):
        for r in (1, 2, 5, 12):
            if mean < r:
                left = sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(r))
                # one less the sum of the others loses digits
                assert math.exp(X.log_tail(mean, r)) == pytest.approx(1 - left, rel=1e-6, abs=1e-14)


def test_law_of_log_odds():
    """Scores that are log-odds of a passage against clean text have a lambda of one."""
    clean, passage = [0.01, 0.002, 0.988], [0.2, 0.1, 0.7]
    lam, k = X.law_of([(math.log(q / p), p) for p, q in zip(clean, passage, strict=True)])
    assert lam == pytest.approx(1, abs=1e-6) and k == pytest.approx(0.3, abs=1e-6)
    # scores of twice the size have half the lambda
    lam, k = X.law_of([(2 * math.log(q / p), p) for p, q in zip(clean, passage, strict=True)])
    assert lam == pytest.approx(0.5, abs=1e-6) and k == pytest.approx(0.3, abs=1e-6)


def test_density_of_passages():
    """Hits three words apart inside passages, passages two hundred words apart."""
    gaps = np.zeros(1_000)
    gaps[3], gaps[200] = 900, 100
    assert X.density_of(gaps, 9.0, 1e-5) == pytest.approx(0.25, abs=0.01)


@pytest.mark.parametrize("n", [40, 400, 4_000])
def test_evidence_bounds_the_chance_in_shuffled_clean_text(n):
    """Among shuffled clean texts, evidence of x or more is no more frequent than exp(-x)."""
    draw = np.random.default_rng(n)
    scores, clean = np.array([3.0, 5.0, -0.35]), np.array([0.004, 0.0005, 0.9955])
    lam, k = X.law_of(list(zip(scores.tolist(), clean.tolist(), strict=True)))
    found = []
    for _ in range(1_500):
        text = scores[draw.choice(3, n, p=clean)].tolist()
        found.append(X.evidence_in([s for *_, s in X.maximal_segments(text)], n, lam, k))
    for x in (1.0, 2.0, 3.0, 4.0):
        share = np.mean([e >= x for e in found])
        assert share <= math.exp(-x) + 3 * math.sqrt(math.exp(-x) / len(found)), x


@pytest.fixture(scope="module")
def planted(spark):
    """600 texts; a tenth is toxic by one of three words, or by a stem with a different ending each time."""
    draw = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        words = [f"v{draw.randint(0, 400)}" for _ in range(draw.randint(5, 80))]
        toxic = i % 10 == 0
        if toxic:
            for _ in range(3):
                words.insert(draw.randint(0, len(words)), draw.choice(["vile", "foul", "rotten", f"sludg{i}"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(planted):
    docs, labels = planted
    found = X.score_documents(docs, X.fit(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert len(found) > 80
    assert (found.predicted == found.toxic).mean() > 0.95
    assert set(found[found.toxic == 1].predicted) == {1}


def test_labels_of_held_out_rows_are_not_used(planted):
    docs, labels = planted
    turned = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert X.fit(docs, labels) == X.fit(docs, turned)


def test_bound_on_fitted_rows(planted):
    docs, labels = planted
    model = X.fit(docs, labels, max_fit_rows=40)
    assert set(X.score_documents(docs, model).toPandas().predicted) <= {0, 1}


def test_passages_are_where_the_words_are(planted):
    docs, labels = planted
    model = X.fit(docs, labels)
    text = "v1 v2 v3 vile foul v4 v5"
    _, segments = X.evidence_of(text, model.memo(), model)
    assert segments and segments[0][0] == 3 and segments[-1][1] == 5


def test_odd_rows(spark, odd, nothing, planted):
    docs, labels = planted
    model = X.fit(docs, labels)
    found = X.score_documents(odd, model).toPandas()
    assert len(found) == odd.count()
    assert found[found.doc_id.isna()].held_out.all()
    assert found[found.doc_id.isin([3, 4, 7])].score.nunique() == 1
    assert found[found.doc_id == 5].score.nunique() == 1
    assert X.score_documents(nothing, model).count() == 0
    kept = X.drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert X.drop_toxic(nothing, model).count() == 0
    # no labels, labels of one kind, null labels
    for rows in ([], [(1, 1, 0), (2, 1, 0)], [(1, 1, None), (None, 1, 1)]):
        some = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert X.score_documents(odd, X.fit(odd, some)).toPandas().score.max() < 0.5


def test_toxic_rows_go(planted):
    docs, labels = planted
    kept = X.drop_toxic(docs, X.fit(docs, labels)).join(labels, "doc_id").groupBy("toxic").count().collect()
    counts = {r["toxic"]: r["count"] for r in kept}
    assert counts[0] >= 538 and counts.get(1, 0) <= 3


def brute_score(model, text):
    """A text's score from the definitions: the recursive segments, summed Poisson terms, the logistic curve."""
    scores = []
    for word in re.findall(r"\w+", text.lower()):
        own = [model.words[word]] if word in model.words else [model.stems[word[:n]] for n in (6, 5, 4, 3) if len(word) > n and word[:n] in model.stems]
        scores.append(own[0] if own else model.base)
    # stretches of words without a hit are one word: a segment never ends inside
    merged = []
    for s in scores:
        if merged and s < 0 and merged[-1] < 0:
            merged[-1] += s
        else:
            merged.append(s)
    evidence = 0.0
    for r, (*_, s) in enumerate(sorted(brute_segments(merged), key=lambda x: -x[2]), 1):
        mean = model.k * len(scores) * math.exp(-model.lam * s)
        if mean < r:
            terms = [-mean + i * math.log(mean) - math.lgamma(i + 1) for i in range(r, r + 60)]
            evidence = max(evidence, -(terms[0] + math.log(sum(math.exp(t - terms[0]) for t in terms))) - math.log(r * (r + 1)))
    return 1 / (1 + math.exp(-(model.slope * min(evidence, 50.0) + model.bias)))


def test_query_against_brute_force(spark, data):
    """Every score of the query on whole tables, from the definitions."""
    from tidemark.llm.queries import QUERIES

    documents, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = X.fit(documents, labels)
    found = {r["doc_id"]: r["score"] for r in QUERIES["op1_toxicity"](spark, data).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    assert found.keys() == texts.keys()
    for d, text in texts.items():
        assert found[d] == pytest.approx(brute_score(model, text), abs=1e-9), d


def test_held_out_rows_of_given_documents(spark):
    """Labels are wrong now and then; a toxic word that no fitted row has can't be known."""
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = X.score_documents(documents, X.fit(documents, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert (found[found.toxic == 0].predicted == 0).mean() > 0.98
    assert (found[found.toxic == 1].predicted == 1).mean() > 0.6


def test_query(spark, data):
    from tidemark.llm.queries import QUERIES

    found = QUERIES["op1_toxicity"](spark, data)
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = found.toPandas()
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5).astype(int) == rows.predicted).all()
