import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ngram_join as N
from tidemark.llm.graph import components


def brute(rows):
    """Class by union-find over all pairs, and numbers of other similar texts."""
    memo = N.word_memo()
    sets, texts = {}, {}
    for d, t in rows:
        h = N.shingles(t or "", memo)
        if d is not None and len(h) and d not in sets:
            sets[d], texts[d] = set(h.tolist()), t
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = {d: set() for d in root}
    for a, b in combinations(sorted(sets), 2):
        inter = len(sets[a] & sets[b])
        if 5 * inter >= 4 * (len(sets[a]) + len(sets[b]) - inter):
            x, y = sorted((find(a), find(b)))
            root[y] = x
            if texts[a] != texts[b]:
                links[a].add(texts[b])
                links[b].add(texts[a])
    return {d: (find(d), len(links[d])) for d in root}


def got(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in N.similarity_classes(df).collect()}


def families(n, seed):
    """Texts with near copies of every closeness, exact copies and short texts."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        kind = draw.random()
        if rows and kind < 0.35:
            words = draw.choice(rows)[1].split(" ")
            for _ in range(draw.randint(0, 1 + len(words) // 12)):
                words[draw.randrange(len(words))] = f"e{draw.randint(0, 99)}"
            rows.append((i, " ".join(words)))
        elif rows and kind < 0.5:
            rows.append((i, draw.choice(rows)[1]))
        else:
            rows.append((i, " ".join(f"w{draw.randint(0, 300)}" for _ in range(draw.choice([1, 3, 5, 9, 40, 120, 300])))))
    return rows


def test_against_all_pairs(spark):
    rows = families(400, 11)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_given_documents_against_all_pairs(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert got(documents) == brute(rows)


def test_groups_of_many_blocks(spark, monkeypatch):
    """A group of more classes than a block has the same links, block by block."""
    monkeypatch.setattr(N, "BLOCK", 7)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(60)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_large_groups_of_several_sizes(spark, monkeypatch):
    """Blocks by size and by number of shingles; base sets larger and smaller than the others."""
    monkeypatch.setattr(N, "BLOCK", 5)
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 900)
    draw = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(70):
        words = base[: draw.randint(60, 400)]
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_neighbours_are_those_of_the_sorted_tries(spark):
    draw = np.random.default_rng(8)
    labels = draw.integers(0, 2, (300, N.TREES, N.DEPTH)).astype(">u2")
    classes = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(labels)], "cid long, sig binary")
    turn = {(r["cid"], r["t"]): r["h"] for r in classes.select("cid", F.explode(F.sequence(F.lit(0), F.lit(N.TREES - 1))).alias("t")).select("cid", "t", F.xxhash64("cid", "t").alias("h")).collect()}
    want = set()
    for t in range(N.TREES):
        order = sorted(range(300), key=lambda c: (labels[c, t].tobytes(), turn[c, t]))
        for i, u in enumerate(order):
            for v in order[max(0, i - N.REACH) : i]:
                depth = next((d for d in range(N.DEPTH) if labels[u, t, d] != labels[v, t, d]), N.DEPTH)
                if depth >= N.LEAST_DEPTH:
                    want.add((u, v, depth))
    found = {(r["u"], r["v"], r["depth"]) for r in N.neighbours(classes.repartition(7), 300).collect()}
    assert found >= want
    # a seam may also pair rows that are a few places apart
    assert len(found - want) <= 4 * N.REACH**2 * 4


def test_recall_over_many_documents(spark):
    """Every link that an index of all shingles finds."""
    draw, rows = random.Random(23), []
    for i in range(4_000):
        words = [f"w{draw.randint(0, 3_000)}" for _ in range(draw.randint(30, 300))]
        if rows and draw.random() < 0.6:
            words = draw.choice(rows[-400:])[1].split(" ")
            for _ in range(draw.randint(1, 1 + len(words) // 30)):
                words[draw.randrange(len(words))] = f"e{draw.randint(0, 99)}"
        rows.append((i, " ".join(words)))
    memo, owners, sets = N.word_memo(), {}, {}
    for d, t in rows:
        sets[d] = N.shingles(t, memo).tolist()
    together = {}
    for d, own in sets.items():
        shared = {}
        for h in own:
            for e in owners.get(h, ()):
                shared[e] = shared.get(e, 0) + 1
            owners.setdefault(h, []).append(d)
        together[d] = [e for e, n in shared.items() if 9 * n >= 4 * (len(own) + len(sets[e]))]
    texts = dict(rows)
    links = {d: set() for d in sets}
    for d, others in together.items():
        for e in others:
            if texts[d] != texts[e]:
                links[d].add(texts[e])
                links[e].add(texts[d])
    found = got(spark.createDataFrame(rows, "doc_id long, text string"))
    total = sum(map(len, links.values()))
    assert total > 2_000
    assert sum(found[d][1] for d in sets) >= 0.999 * total
    assert all(found[d][1] <= len(links[d]) for d in sets)


def test_exact_links_in_column_chunks(monkeypatch):
    monkeypatch.setattr(N, "COLUMNS", 5)
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 30, draw.integers(1, 25))).astype(np.uint64) for _ in range(30)]
    want = [[i != j and 9 * len(set(a) & set(b)) >= 4 * (len(a) + len(b)) for j, b in enumerate(sets)] for i, a in enumerate(map(list, sets))]
    assert (N.exact_links(sets, None) == np.array(want)).all()
    assert (N.exact_links(sets[:10], sets[10:]) == np.array(want)[:10, 10:]).all()


def test_prefix_reaches_the_target():
    depth = N.shortest_prefix()
    assert N.expected_recall(N.SIMILARITY, depth) >= N.TARGET_RECALL
    assert depth == N.DEPTH or N.expected_recall(N.SIMILARITY, depth + 1) < N.TARGET_RECALL


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(1)
    a = draw.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], draw.integers(0, 2**63, 100, dtype=np.uint64)])
    x, y = (np.frombuffer(N.signature(v), ">u2") for v in (a, b))
    assert abs((x == y).mean() - 800 / 1100) < 0.15


def test_components(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [tuple(draw.sample(range(200, 260), 2)) for _ in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for x in list(root) if find(x) != x}
    assert {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(odd, nothing):
    found = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in N.similarity_classes(odd).collect()}
    assert found == {1: (1, 0, 2), 2: (1, 0, 2), 3: (3, 0, 1), 4: (4, 0, 1), 5: (5, 0, 1), 6: (6, 0, 1), 7: (7, 0, 1)}
    assert N.similarity_classes(nothing).count() == 0
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, x) for x in (1, 3, 4, 5, 6, 7)] + [(True, None)]
    assert N.keep_one(nothing).count() == 0


def test_repeated_ids_in_groups(spark):
    """Repeated rows count once, and a text that was not picked forms no link and isn't kept."""
    base = [f"w{i}" for i in range(100)]
    near = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in (0, 99)]
    far = [" ".join(f"{c}{i}" for i in range(100)) for c in "abcdefgh"]
    rows = [(1, near[0], 0), (1, near[0], 1), (1, "", 2), (2, near[1], 3), (2, near[1], 4)]
    # ids with two texts, each near that of another document: only the picked one links
    for k, text in enumerate(far):
        words = text.split()
        rows += [(10 + k, text, 5), (10 + k, f"other {k} " + text[::-1], 6)]
        rows += [(100 + k, " ".join([*words[:-1], "y"]), 7), (200 + k, f"other {k} " + text[::-1] + " y", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    key = {r["text"]: bytes(r["k"]) for r in df.select("text", N.text_key(F.col("text")).alias("k")).collect()}
    want, texts = {1: (1, 1), 2: (1, 1)}, {1: near[0]}
    for k, text in enumerate(far):
        other = f"other {k} " + text[::-1]
        picked, linked, alone = (text, 100 + k, 200 + k) if key[text] < key[other] else (other, 200 + k, 100 + k)
        want |= {10 + k: (10 + k, 1), linked: (10 + k, 1), alone: (alone, 0)}
        texts |= {10 + k: picked, alone: next(t for d, t, _ in rows if d == alone)}
    assert got(df) == want
    kept = N.keep_one(df).collect()
    assert len(kept) == len(texts) and {r["doc_id"]: r["text"] for r in kept} == texts


@pytest.mark.parametrize("n", [1, 4, 5, 6])
def test_short_texts(spark, n):
    text = " ".join(f"w{i}" for i in range(n))
    found = got(spark.createDataFrame([(1, text), (2, text.upper()), (3, "other words")], "doc_id long, text string"))
    assert found == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
