import random
import time

import pytest

from tidemark.llm import decontaminate as D
from tidemark.llm import mapped as M


def corpus(seed, items, texts):
    draw = random.Random(seed)
    word = lambda: draw.choice(["a", "b", "C", "é", "中", "x1", "d", "e"])
    benchmark = [(str(i), " ".join(word() for _ in range(draw.choice([0, 1, 2, 5, 9, 10, 11, 25])))) for i in range(items)]
    out = []
    for _ in range(texts):
        words = [word() for _ in range(draw.randint(0, 40))]
        if draw.random() < 0.7:
            w = draw.choice(benchmark)[1].split(" ")
            at, cut = draw.randint(0, len(words)), draw.randint(0, 3)
            words[at:at] = w[cut:]
        out.append(draw.choice([" ", "--", "!\n"]).join(words).replace("a", draw.choice("aA")))
    return benchmark, out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("window", [1, 3, 10])
def test_against_brute_force(seed, window):
    benchmark, texts = corpus(seed, 12, 60)
    if seed % 2:
        benchmark = [x for x in benchmark if len(D.words_of(x[1])) >= 5]
    patterns = D.Patterns(D.build(benchmark, window))
    for text in texts:
        n, spans, items = D.find_in(text, [patterns])
        want = D.brute_force(text, benchmark, window)
        assert (n, sum(b - a for a, b in spans), sorted(items)) == want[:3]


def test_shifts_skip_positions():
    benchmark = [("1", " ".join(f"p{i}" for i in range(10)))]
    search = D.Patterns(D.build(benchmark)).searches[0]
    assert set(search.shift) == set(range(10))
    ids = list(range(1, 11))
    assert search.ends([*ids, *[0] * 50, *ids[:9], 0, *ids]) == [10, 80]


def test_many_patterns_of_one_block():
    """Patterns that share their last words are told apart by their first ones; a full slice is quick to search."""
    benchmark = [(str(i), f"a{i % 500} b{i} " + "the same ending of all these many items") for i in range(20_000)]
    arrays = D.build(benchmark)
    patterns = D.Patterns(arrays)
    text = " ".join(t for _, t in benchmark[:1_000]) + " " + "the same ending of all these many items " * 500
    began = time.monotonic()
    _, _, items = D.find_in(text, [patterns])
    assert items >= {str(i) for i in range(1_000)} and time.monotonic() - began < 20
    assert sum(v.nbytes for v in arrays.values()) < 400 * sum(len(v) for k, v in arrays.items() if k.endswith(".keys") and k[0].isdigit())


def test_tables_lie_in_a_mapped_file(spark, tmp_path):
    benchmark, texts = corpus(2, 12, 30)
    arrays = D.build(benchmark)
    (tmp_path / "tables").write_bytes(M.packed(arrays))
    found = M.opened(str(tmp_path / "tables"))
    assert found.keys() == arrays.keys() and all((found[k] == v).all() and not found[k].flags.owndata for k, v in arrays.items())
    for t in texts:
        assert D.find_in(t, [D.Patterns(found)]) == D.find_in(t, [D.Patterns(arrays)]) == D.find_in(t, [D.Patterns(arrays, held=0)])
    assert M.share(spark, arrays) == M.share(spark, arrays)


def test_words():
    assert D.words_of("Ab-c É_1\x7f2 ４") == ["ab".encode(), b"c", "É".encode(), b"1", b"2", "４".encode()]


@pytest.mark.parametrize("most", [D.MAX_PATTERNS, 60])
def test_rows(spark, odd, nothing, most):
    """Slices of the benchmark give the same as the whole."""
    benchmark, texts = corpus(3, 12, 40)
    items = spark.createDataFrame([*((int(i), t) for i, t in benchmark), (None, "a b"), (99, None)], "item_id long, text string")
    docs = spark.createDataFrame([*enumerate(texts), (1000, None), (None, texts[0])], "doc_id long, text string")
    found = {r["doc_id"]: r for r in D.digest(D.find(docs, items, most=most)).collect()}
    for i, t in [*enumerate(texts), (1000, ""), (None, texts[0])]:
        n, hit, names, digest = D.brute_force(t, benchmark)
        r = found[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(names), digest, hit > 0)
    kept = {r["doc_id"] for r in D.drop_contaminated(docs, items, most=most).collect()}
    assert kept == {i for i, r in found.items() if not r["contaminated"]}
    none = items.limit(0)
    assert not any(r["contaminated"] for r in D.digest(D.find(odd, none)).collect())
    clean = D.drop_contaminated(odd, none)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert D.find(nothing, items).count() == 0 and D.drop_contaminated(nothing, items).count() == 0
