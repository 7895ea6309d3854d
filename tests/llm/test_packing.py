"""Packing: nothing lost, nothing split, nothing over the capacity, little room left."""

import random
from collections import Counter

from quarry.llm import packing as P


def test_plans_hold_exactly_the_histogram():
    rng = random.Random(2)
    for lengths in ([rng.randrange(1, 2049) for _ in range(3000)], [700] * 1000 + [rng.randrange(20, 400) for _ in range(2000)], [2048] * 5 + [1] * 7, [1500] * 50, [5]):
        made = P.plan(list(Counter(lengths).items()))
        held = Counter()
        for pattern, repeats, _ in made:
            assert sum(pattern) <= 2048
            for x in pattern:
                held[x] += repeats
        assert held == Counter(lengths)
        used = sum(n for _, n, _ in made)
        if lengths[0] not in (1500, 5, 2048):
            assert used <= 1.04 * sum(lengths) / 2048 + 1
    assert P.plan([]) == []


def test_every_document_is_placed_once(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 900))) for _ in range(120)] + ["same words again"] * 60 + ["big " * 6000, "", None, "😀 ü"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "x", 1)], "doc_id long, text string, size int")
    rows = P.packed(docs).collect()
    coder = P.encoding(open(P.VOCABULARY, 'rb').read())
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(range(len(texts)))
    for i, t in enumerate(texts):
        assert sum(r.tokens for r in by[i]) == max(1, len(coder.encode_ordinary(t)) if t else 1)
        assert len(by[i]) == 1 or i == 180
    containers = {}
    for r in rows:
        containers.setdefault(r.container, []).append(r)
    for held in containers.values():
        total = sum(r.tokens for r in held)
        assert total <= 2048 and sorted(r.position for r in held) == list(range(len(held))) and all(r.container_tokens == total for r in held)
    summary = P.summary(P.packed(docs)).first()
    assert summary.containers == len(containers) and summary.containers <= summary.least_containers + 2
    assert P.packed(docs.limit(0)).count() == 0


def test_most_items_lie_in_fitted_patterns():
    rng = random.Random(6)
    sizes = [min(2048, int(rng.lognormvariate(4.8, 0.9)) + 8) for _ in range(4000)]
    made = P.plan(list(Counter(sizes).items()))
    assert sum(len(p) * n for p, n, fitted in made if fitted) > 0.9 * len(sizes)
    assert sum(n for _, n, _ in made) <= -(-sum(sizes) // 2048) + 1


def test_stretches_have_the_tokens_of_the_whole():
    rng = random.Random(8)
    coder = P.encoding(open(P.VOCABULARY, "rb").read())
    text = "".join(rng.choice(["word", "x1", " ", "\n", "\n\n", "\t", "...", "é", "  \n", "\r\n", "'s"]) for _ in range(40_000))
    parts = list(P.runs(text, 500))
    assert "".join(parts) == text and len(parts) > 50
    assert sum(len(coder.encode_ordinary(x)) for x in parts) == len(coder.encode_ordinary(text))
    assert list(P.runs("")) == [""] and list(P.runs("a" * 3000, 500)) == ["a" * 3000]
