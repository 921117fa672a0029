import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import pytest

from tidemark.llm import pii as P

# the contract's patterns, as they are
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                doubled = [int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(digits[::-1])]
                if not 16 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@pytest.mark.parametrize("alphabet", ["ab1@.- +", "0123456789-. +()a", "1.2 -@x+", "4- 0\n", "@.a"])
def test_base_against_the_patterns(alphabet):
    draw = random.Random(alphabet)
    for _ in range(8000):
        text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60)))
        assert P.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    began = time.monotonic()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1(" * 100_000, "a.1" * 100_000, "1 " * 100_000, "a@b." * 50_000):
        P.spans_of(P.Crf(), text)
    assert time.monotonic() - began < 60


TEXT = "call +1 (988) 555-2485 or (988) 555-2485, x bosbt.42@mail8.example.com, then bosbt.42; 4539578763621486 and 10.20.30.40"


@pytest.fixture(scope="module")
def model(spark):
    draw = random.Random(9)
    rows = []
    for i in range(400):
        digits = "".join(draw.choice("0123456789") for _ in range(10))
        kind = draw.choice(["+1 (%s) %s-%s" % (digits[:3], digits[3:6], digits[6:]), f"ab.{digits[:2]}@mail.example.com", "10.2.3.4", "20240506 1234567", "total 12 of 345,678"])
        rows.append((i, f"some words {kind} and more"))
    return P.fit(spark.createDataFrame(rows, "doc_id long, text string"))


def test_repeats_become_spans(model):
    base, every = P.spans_of(model, TEXT)
    assert set(base) <= set(every)
    assert [TEXT[a:b] for k, a, b in every if k == "phone"] == ["+1 (988) 555-2485", "(988) 555-2485"]
    assert [TEXT[a:b] for k, a, b in every if k == "email"] == ["bosbt.42@mail8.example.com", "bosbt.42"]


def test_other_numbers_stay(model):
    text = "20240506 1234567, 4539578763621487 and 999.1.1.1"
    assert P.spans_of(model, text) == ([], [])


def exact(model, nodes):
    """Marginals by summing over all labelings."""
    edges = P.edges_of(nodes)
    scores = {}
    for labels in itertools.product(range(5), repeat=len(nodes)):
        own = sum(model.unary(n)[x] for n, x in zip(nodes, labels, strict=True))
        scores[labels] = math.exp(own + sum(getattr(model, name)[labels[i]][labels[j]] for name in P.PAIRS for i, j in edges[name]))
    total = sum(scores.values())
    return np.array([[sum(v for k, v in scores.items() if k[i] == x) / total for x in range(5)] for i in range(len(nodes))])


def test_messages_agree_with_exact_sums(model):
    """On a chain without loops the beliefs are the exact marginals."""
    nodes = [P.Node(i, i + 1, s, (f"k{i}",)) for i, s in enumerate(["d3-3-4 ()-", "nothing", "a:account"])]
    assert np.abs(P.marginals(model, nodes) - exact(model, nodes)).max() < 1e-3


def test_messages_on_loops_agree_with_exact_sums(model):
    """Repeats and similar strings close loops: beliefs are near the exact marginals, and their labels are the same."""
    draw = np.random.default_rng(6)
    for _ in range(40):
        n = int(draw.integers(3, 6))
        field = P.Crf({f"s{i}": draw.normal(0, 1.5, 5).tolist() for i in range(n)}, {}, [0.0] * 5, *(draw.normal(0, 0.4, (5, 5)).tolist() for _ in P.PAIRS))
        nodes = [P.Node(i, i + 1, f"s{i}", (f"k{draw.integers(0, 2)}",), "phone" if draw.random() < 0.2 else None, "", (f"m{draw.integers(0, 2)}",)) for i in range(n)]
        found, want = P.marginals(field, nodes), exact(field, nodes)
        assert np.abs(found - want).max() < 0.12
        sure = np.sort(want, 1)
        clear = sure[:, -1] - sure[:, -2] > 0.15
        assert (found.argmax(1) == want.argmax(1))[clear].all()


def test_what_is_known_reaches_distant_repeats(model):
    """An unclear string is what its far-off base span is, however many others lie between."""
    text = "+1 (988) 555-2485 " + "and some words " * 200 + " ".join(f"20{i:06d}" for i in range(150)) + " call 988-555-2485 or 988 5552485"
    base, every = P.spans_of(model, text)
    assert [text[a:b] for k, a, b in every if k == "phone"][:3] == ["+1 (988) 555-2485", "988-555-2485", "988 5552485"]


def test_similar_strings_share_potentials(model):
    nodes = P.nodes_of(text := "john.doe.77@mail.example.com, then johndoe.77 and (988) 555-2485", P.base_spans(text))
    edges = P.edges_of(nodes)
    assert (0, 1) in edges["similar"] and not edges["skip"]


def test_training_prefers_what_the_held_out_documents_say(spark):
    """Shapes that are personal data after one word, and other numbers after another."""
    draw = random.Random(2)
    rows = []
    for i in range(1_500):
        n = "".join(draw.choice("0123456789") for _ in range(10))
        phone = draw.random() < 0.5
        rows.append((i, f"call +1 {n[:3]}-{n[3:6]}-{n[6:]} now" if phone else f"item {n[:3]}-{n[3:6]}-{n[6:]} here"))
    field = P.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert P.spans_of(field, "call 123-456-7890 now")[1] == [("phone", 5, 17)]
    assert P.spans_of(field, "item 123-456-7890 here")[1] == []


def brute_spans(field, text):
    """All spans by exact sums over all labelings, for texts with few candidates."""
    base = brute(text)
    nodes = P.nodes_of(text, base)
    if all(n.label for n in nodes):
        return base
    # nodes that nothing links hang on nothing: only the candidates and their neighbours are summed
    assert len(nodes) <= 7
    best = exact(field, nodes).argmax(1).tolist()
    added = [(P.LABELS[x], n.start, n.end) for n, x in zip(nodes, best, strict=True) if n.label is None and x]
    return sorted(base + added, key=lambda s: (P.KINDS.index(s[0]), s[1], s[2]))


def test_query_against_exact_sums(spark, data, documents):
    from tidemark.llm.queries import QUERIES

    field = P.fit(documents)
    found = {r["doc_id"]: r["spans"] for r in QUERIES["op7_pii"](spark, data).collect()}
    for d in documents.collect():
        if len(P.nodes_of(d["text"], P.base_spans(d["text"]))) <= 7:
            assert found[d["doc_id"]] == P.written(brute_spans(field, d["text"])), d["doc_id"]


def test_rows(model, odd, nothing):
    found = {r["doc_id"]: r for r in P.find(odd, model).collect()}
    assert len(P.find(odd, model).collect()) == odd.count()
    assert found[3]["spans"] == "" and found[3]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert found[None]["n_email"] == 1 and found[None]["spans"] == "email:21:40"
    assert P.find(nothing, model).count() == 0
    masked = P.mask(odd, model)
    assert masked.columns == odd.columns and masked.count() == odd.count()
    row = masked.where("doc_id IS NULL").first()
    assert row["text"] == "No id here, but mail [EMAIL] please." and row["n_chars"] == len(row["text"])
    assert masked.where("doc_id = 3").first()["text"] is None
    assert P.mask(nothing, model).count() == 0 and P.fit(nothing).shapes == {}


def test_overlaps_are_masked_once():
    assert P.masked_text("ab 12345 cd", [("card", 3, 6), ("phone", 5, 8)]) == "ab [CARD] cd"


def test_query_against_the_patterns(spark, data, documents):
    from tidemark.llm.queries import QUERIES

    found = {r["doc_id"]: r for r in QUERIES["op7_pii"](spark, data).collect()}
    for d in documents.collect():
        base = brute(d["text"])
        r = found[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(P.written(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(x == k for x, *_ in base) for k in P.KINDS]
        assert set(P.written(base).split(",")) <= {*r["spans"].split(","), ""}
