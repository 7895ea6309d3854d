"""Problem 9: subject area of each document.

Method: averaged embeddings of words and their subwords with one independent logistic output a
subject. The labelled documents lie in blocks on the workers; every step each block returns its
gradient, the driver adds them up, steps, and sends the parameters out again. A held-out part of
the labels decides when to stop and where each output's threshold lies. Then every document is
scored. Parameters, gradients and document frequencies are hashed into tables of fixed size, so
what passes the driver is bounded whatever the corpus.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.runtime import cut

WORD = re.compile(r"[^\W\d_]{2,}")


@dataclass(frozen=True)
class Settings:
    """Parameters of the classifier. ``labelled`` bounds the documents that it is fitted on: of
    more labelled documents a hash of the id chooses that many; counts and scores take all."""

    buckets: int = 1 << 15
    dim: int = 12
    subword: float = 0.3
    grams: tuple[int, ...] = (4, 5)
    steps: int = 40
    patience: int = 6
    rate: float = 0.05
    labelled: int = 20_000
    blocks: int = 12
    held_out: float = 0.12
    scale: float = 10.0


DEFAULT = Settings()


def word_counts(text: str | None) -> Counter:
    """Lower-case words of letters, identifiers taken apart at underscores and capitals kept
    together; none for null or empty texts."""
    return Counter(WORD.findall(text.lower())) if text else Counter()


def word_bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode()) % buckets


class Features:
    """Buckets and shares of a word: itself and its character n-grams."""

    def __init__(self, settings: Settings) -> None:
        self.settings = settings
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def __call__(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.known.get(word)
        if found is None:
            s = self.settings
            edged = f"<{word}>"
            parts = [f"{n}:{edged[i : i + n]}" for n in s.grams for i in range(len(edged) - n + 1)]
            at = np.array([word_bucket("w:" + word, s.buckets)] + [word_bucket(p, s.buckets) for p in parts])
            share = np.array([1 - s.subword] + [s.subword / max(1, len(parts))] * len(parts), np.float32)
            if len(self.known) > 300_000:
                self.known.clear()
            found = self.known[word] = (at, share)
        return found


@dataclass
class Block:
    """Documents as sparse rows over the block's own words, and words as sparse rows over buckets."""

    doc: np.ndarray
    word: np.ndarray
    weight: np.ndarray
    owner: np.ndarray
    bucket: np.ndarray
    share: np.ndarray
    docs: int
    words: int

    @classmethod
    def of(cls, counts: list[Counter], rarity: np.ndarray, features: Features) -> Block:
        index: dict[str, int] = {}
        doc, word, weight = [], [], []
        size = len(rarity)
        for k, count in enumerate(counts):
            weights = {w: n**0.5 * rarity[word_bucket(w, size)] for w, n in count.items()}
            total = sum(weights.values())
            for w, x in weights.items():
                if x > 0:
                    doc.append(k)
                    word.append(index.setdefault(w, len(index)))
                    weight.append(x / total)
        owner, bucket, share = [], [], []
        for w, i in index.items():
            at, part = features(w)
            owner.append(np.full(len(at), i))
            bucket.append(at)
            share.append(part)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return cls(np.array(doc, np.int64), np.array(word, np.int64), np.array(weight, np.float32), join(owner, np.int64), join(bucket, np.int64), join(share, np.float32), len(counts), len(index))


def spread(at: np.ndarray, rows: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Sum of ``weight * rows`` by ``at``, one column after another."""
    return np.stack([np.bincount(at, weights=weight * rows[:, k], minlength=size) for k in range(rows.shape[1])], axis=1).astype(np.float32)


@dataclass
class Model:
    """Embeddings of buckets, output weights and biases; ``threshold`` by subject."""

    embedding: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    scale: float
    subjects: list[str]
    threshold: np.ndarray

    def hidden(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        words = spread(block.owner, self.embedding[block.bucket], block.share, block.words)
        return words, spread(block.doc, words[block.word], block.weight, block.docs) * self.scale

    def scores(self, block: Block) -> np.ndarray:
        if not block.words:
            return np.tile(1 / (1 + np.exp(-self.bias)), (block.docs, 1))
        return 1 / (1 + np.exp(-(self.hidden(block)[1] @ self.output + self.bias)))

    def gradient(self, block: Block, truth: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the mean cross entropy over ``total`` documents, with respect to each parameter."""
        if not block.words:
            return np.zeros_like(self.embedding), np.zeros_like(self.output), np.zeros_like(self.bias)
        _, hidden = self.hidden(block)
        error = ((1 / (1 + np.exp(-(hidden @ self.output + self.bias)))) - truth) / total
        back = (error @ self.output.T).astype(np.float32) * self.scale
        words = spread(block.word, back[block.doc], block.weight, block.words)
        return spread(block.bucket, words[block.owner], block.share, len(self.embedding)), hidden.T @ error, error.sum(0)


class Adam:
    """Steps of the usual adaptive moments over a list of arrays."""

    def __init__(self, params: list[np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.first = [np.zeros_like(p) for p in params]
        self.second = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def best_thresholds(scores: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Threshold of each output by the held-out F1, in the middle of its plateau and drawn towards one half where few say so."""
    out = np.full(scores.shape[1], 0.5)
    for k in range(scores.shape[1]):
        grid = np.arange(0.2, 0.81, 0.05)
        positives = truth[:, k].sum()
        f1 = [2 * (hit := float(((scores[:, k] >= x) & (truth[:, k] > 0)).sum())) / max(1.0, (scores[:, k] >= x).sum() + positives) for x in grid]
        if positives >= 20:
            near = grid[np.array(f1) >= max(f1) - 0.003].mean()
            pull = 20 / positives
            out[k] = (1 - pull) * near + pull * 0.5
    return out


def rarities(documents: DataFrame, settings: Settings) -> np.ndarray:
    """Inverse document frequency of every word bucket, counted over all documents. Counts are
    summed in each task first and shuffled by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(settings.buckets, np.int64)
        docs = 0
        buckets: dict[str, int] = {}
        for batch in batches:
            for text in batch["text"]:
                docs += 1
                if text:
                    for w in set(WORD.findall(text.lower())):
                        b = buckets.get(w)
                        if b is None:
                            if len(buckets) > 300_000:
                                buckets.clear()
                            b = buckets[w] = word_bucket(w, settings.buckets)
                        seen[b] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(seen[at], docs)})

    counts = documents.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most buckets + 1 rows
    out = np.zeros(settings.buckets)
    docs = int(counts.loc[counts["bucket"] == -1, "n"].sum())
    rest = counts[counts["bucket"] >= 0]
    out[rest["bucket"].to_numpy()] = rest["n"].to_numpy()
    return np.maximum(0.0, np.log((docs + 1) / np.maximum(1, out)))


def fitted(documents: DataFrame, labels: DataFrame, names: list[str], rarity: np.ndarray, settings: Settings = DEFAULT) -> Model:
    """The model after training on the labelled documents."""
    spark = documents.sparkSession
    context = spark.sparkContext
    wanted = labels.where("doc_id is not null").where(F.col("subject").isin(names)).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    sample = documents.where("doc_id is not null and text is not null").select("doc_id", "text").join(wanted, "doc_id").dropDuplicates(["doc_id"])
    n = sample.count()
    if n > settings.labelled:
        sample = sample.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * settings.labelled / n))
    model = Model(np.random.default_rng(7).normal(0, 0.1, (settings.buckets, settings.dim)).astype(np.float32), np.random.default_rng(8).normal(0, 0.1, (settings.dim, len(names))), np.full(len(names), -2.0), settings.scale, names, np.full(len(names), 0.5))
    if n == 0:
        return model
    shared_rarity = context.broadcast(rarity)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features(settings)
        kept: dict[bool, tuple[list[Counter], list[list[float]]]] = {False: ([], []), True: ([], [])}
        for batch in batches:
            for doc, text, mine in zip(batch["doc_id"], batch["text"], batch["subjects"], strict=True):
                counts, truth = kept[zlib.crc32(str(doc).encode()) % 1000 < settings.held_out * 1000]
                counts.append(word_counts(text))
                truth.append([float(s in set(mine)) for s in names])
        rows = [pickle.dumps((Block.of(c, shared_rarity.value, features), np.array(t, np.float32).reshape(len(c), len(names)))) for c, t in (kept[False], kept[True])]
        yield pd.DataFrame({"train": [rows[0]], "held": [rows[1]], "docs": [len(kept[False][0])]})

    blocks = cut(sample.repartition(settings.blocks, "doc_id").mapInPandas(pack, "train binary, held binary, docs long"))
    total = max(1, int(blocks.agg(F.sum("docs")).first()[0] or 0))
    optimiser = Adam([model.embedding, model.output, model.bias], settings.rate)
    best = (np.inf, None, None, None)
    since = 0
    for _ in range(settings.steps):
        sent = context.broadcast(model)

        def gradient(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            m = sent.value
            for batch in batches:
                for train, held in zip(batch["train"], batch["held"], strict=True):
                    block, truth = pickle.loads(train)
                    side, side_truth = pickle.loads(held)
                    grads = m.gradient(block, truth, total)
                    scores = m.scores(side)
                    yield pd.DataFrame({"grads": [pickle.dumps([g.astype(np.float32) for g in grads])], "held": [pickle.dumps((scores, side_truth))]})

        rows = blocks.mapInPandas(gradient, "grads binary, held binary").collect()  # one row a block, of the parameters' size
        sent.unpersist()
        held = [pickle.loads(r["held"]) for r in rows]
        scores, truth = np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
        clipped = np.clip(scores, 1e-6, 1 - 1e-6)
        loss = float(-(truth * np.log(clipped) + (1 - truth) * np.log(1 - clipped)).mean()) if len(truth) else 0.0
        if len(truth) < 30 or loss < best[0]:
            best = (loss, [p.copy() for p in optimiser.params], scores, truth)
            since = 0
        else:
            since += 1
            if since >= settings.patience:
                break
        sums = [sum(parts) for parts in zip(*(pickle.loads(r["grads"]) for r in rows), strict=True)]
        optimiser.step(sums)
    _, (model.embedding, model.output, model.bias), scores, truth = best
    if len(truth):
        model.threshold = best_thresholds(scores, truth)
    return model


def classified(documents: DataFrame, labels: DataFrame, subjects: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(doc_id, subject, score) for each subject a document is about; at least one a document.

    The subject list is closed and small. A document gets every subject whose score reaches its
    threshold, or else the best one. ``software`` gives way to any other subject. Null and empty
    texts are scored by the biases alone; null ids are left out; repeated rows give equal rows,
    which come once. Labels of unknown subjects or documents are not used."""
    spark = documents.sparkSession
    names = sorted(r[0] for r in subjects.where("subject is not null").select("subject").distinct().collect())
    if not names:
        return spark.createDataFrame([], "doc_id long, subject string, score double")
    rarity = rarities(documents, settings)
    model = fitted(documents, labels, names, rarity, settings)
    shared = spark.sparkContext.broadcast((model, rarity))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, rarity = shared.value
        features = Features(settings)
        general = model.subjects.index("software") if "software" in model.subjects else -1
        for batch in batches:
            scores = model.scores(Block.of([word_counts(t) for t in batch["text"]], rarity, features))
            rows = []
            for doc, s in zip(batch["doc_id"], scores, strict=True):
                chosen = np.flatnonzero(s >= model.threshold)
                if general in chosen and len(chosen) > 1:
                    others = [k for k in chosen if k != general]
                    chosen = others if max(s[others]) >= s[general] or s[general] < 0.9 else [general]
                if not len(chosen):
                    chosen = [int(np.argmax(s / model.threshold))]
                rows += [(doc, model.subjects[k], round(float(s[k]), 6)) for k in chosen]
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "score"])

    out = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, subject string, score double")
    return out.groupBy("doc_id", "subject").agg(F.max("score").alias("score"))


def shares(assigned: DataFrame) -> DataFrame:
    """(subject, documents, share): the part of all documents that each subject has; a document
    of several subjects counts for each."""
    total = assigned.agg(F.countDistinct("doc_id").alias("total"))
    counts = assigned.groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"))
    return counts.join(F.broadcast(total)).select("subject", "documents", F.round(F.col("documents") / F.col("total"), 6).alias("share"))  # one row is broadcast
