"""Subjects: held-out accuracy on made texts, gradients, and odd tables."""

import dataclasses
import random

import numpy as np

from quarry.llm import subjects as S

TERMS = {"law": "statute docket appeal tribunal verdict plaintiff".split(), "music": "chord octave melody tempo rehearsal album".split(), "software": "parser linter compiler cache branch thread".split()}
SETTINGS = dataclasses.replace(S.DEFAULT, buckets=4096, steps=25, blocks=3)


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        own = rng.sample(["law", "music"], rng.choice([1, 1, 2])) if rng.random() < 0.75 else ["software"]
        words = [rng.choice(TERMS[rng.choice(own)]) if rng.random() < 0.4 else rng.choice("the of is a when each every must hold before".split()) for _ in range(rng.randrange(30, 90))]
        out.append((i, " ".join(words), sorted(own)))
    return out


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    settings = dataclasses.replace(SETTINGS, buckets=64, dim=3)
    block = S.Block.of([S.word_counts(t) for _, t, _ in texts(5, 1)], np.ones(64), S.Features(settings))
    truth = rng.integers(0, 2, (5, 2)).astype(float)
    model = S.Model(rng.normal(0, 1, (64, 3)).astype(np.float64), rng.normal(0, 1, (3, 2)), np.zeros(2), 4.0, ["a", "b"], np.full(2, 0.5))

    def loss():
        p = model.scores(block)
        return -(truth * np.log(p) + (1 - truth) * np.log(1 - p)).sum() / 5

    grads = model.gradient(block, truth, 5)
    for param, grad in zip((model.embedding, model.output, model.bias), grads, strict=True):
        at = tuple(rng.integers(0, s) for s in param.shape) if param is not model.embedding else (int(block.bucket[0]), 1)
        before = param[at]
        param[at] = before + 1e-3
        up = loss()
        param[at] = before - 1e-3
        down = loss()
        param[at] = before
        assert abs((up - down) / 2e-3 - grad[at]) < 2e-3


def test_held_out_accuracy_and_odd_rows(spark):
    rows = texts(500, 2)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (None, "chord", "x"), (1, rows[1][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, s) for i, _, own in rows[:300] for s in own] + [(1, "unknown"), (7777, "law"), (None, "law"), (2, None)], "doc_id long, subject string")
    names = spark.createDataFrame([(s,) for s in TERMS] + [(None,)], "subject string")
    got = {}
    for r in S.classified(docs, labels, names, SETTINGS).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert set(got) == {i for i, _, _ in rows} | {900, 901}
    hits = [got[i] == set(own) for i, _, own in rows[300:]]
    assert sum(hits) >= 0.85 * len(hits)
    shares = {r.subject: r.share for r in S.shares(S.classified(docs, labels, names, SETTINGS)).collect()}
    assert abs(shares["software"] - 0.25) < 0.08
    assert S.classified(docs.limit(0), labels, names, SETTINGS).count() == 0
    assert S.classified(docs, labels.limit(0), names, SETTINGS).select("doc_id").distinct().count() == 502
    assert S.classified(docs, labels, names.limit(0), SETTINGS).count() == 0
