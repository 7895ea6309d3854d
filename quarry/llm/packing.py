"""Problem 7: filling fixed-capacity containers with whole texts.

Method: pattern packing. The histogram of lengths (at most as many rows as the capacity) goes to
the driver; patterns of a few lengths that fill a container are enumerated there; non-negative
least squares fits how often each pattern repeats; the counts are rounded down, what is left is
fitted again, and the last residuals are packed largest first. The plan that comes out is bounded by the
capacity, not by the data. Documents are ranked within their length in parallel and find their
container by rank.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.runtime import cut

CAPACITY = 2048
VOCABULARY = os.environ.get("QUARRY_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this family split texts.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of a length are ranked in this many independent buckets.
BUCKETS = 64


_CODERS: dict[int, object] = {}


def encoding(vocabulary: bytes):
    """The public tokenizer whose vocabulary file holds these bytes; built once in a process."""
    import tiktoken

    key = hash(vocabulary)
    if key not in _CODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _CODERS[key] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _CODERS[key]


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of each document. A null, empty or unencodable text takes one token, as
    the end mark of an empty document would. The driver reads the vocabulary, a file of some two
    megabytes, and sends it to the workers."""
    with open(vocabulary, "rb") as file:
        shared = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoding(shared.value)
        for batch in batches:
            sizes = [max(1, sum(len(coder.encode_ordinary(x)) for x in runs(t))) if t else 1 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": sizes})

    return documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, tokens long")


LINE_BREAK = re.compile(r"(?<=\S)\n(?=\S)")


def runs(text: str, least: int = 100_000) -> Iterator[str]:
    """The whole text in stretches of at least ``least`` characters. They end at a line break between
    two marks, which no token spans, so the tokens are those of the whole."""
    at = 0
    while len(text) - at > least and (m := LINE_BREAK.search(text, at + least)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


#: Patterns that are drawn for each length, most documents that a pattern draws, and the drawing's seed.
DRAWS, DRAWN, SEED = 24, 12, 7


def patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Combinations of a few lengths, as indices, that fill a container: each length alone and repeated,
    with the lengths that leave least room for it, alone and in pairs, and with lengths drawn as often
    as they occur until one or two can fill what is left."""
    size = lengths.tolist()
    fits = (np.searchsorted(lengths, np.arange(capacity + 1), side="right") - 1).tolist()  # the longest length within a room
    share = counts / counts.sum()
    out: set[tuple[int, ...]] = set()

    def finished(base: tuple[int, ...], left: int) -> None:
        k = fits[left]
        if k < 0 or left - size[k] <= capacity // 256:
            out.add(tuple(sorted((*base, k) if k >= 0 else base)))
        half = fits[left // 2]
        if half >= 0 and (m := fits[left - size[half]]) >= 0:
            out.add(tuple(sorted((*base, half, m))))

    picked = np.random.default_rng(SEED).choice(len(size), size=(len(size), DRAWS, DRAWN), p=share).tolist()
    for i, length in enumerate(size):
        out.add((i,))
        repeat = min(8, capacity // length, int(counts[i]))
        if repeat >= 2:
            out.add((i,) * repeat)
        finished((i,), capacity - length)
        for draw in picked[i]:
            base, left = [i], capacity - length
            for k in draw:
                if left < size[k] or left <= 2 * size[-1] and fits[left] >= 0 and left - size[fits[left]] == 0:
                    break
                base.append(k)
                left -= size[k]
            finished(tuple(base), left)
    return sorted(out)


def fit(columns: list[tuple[int, ...]], lengths: np.ndarray, counts: np.ndarray, capacity: int, steps: int = 600) -> np.ndarray:
    """Repeat counts by non-negative least squares: accelerated projected gradient on the misfit
    of the histogram plus a small price for the room that a pattern leaves."""
    item = np.concatenate([np.array(c) for c in columns])
    column = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    target = counts.astype(float)
    scale = max(1.0, float(target.max()))
    target = target / scale
    waste = 1 - np.bincount(column, weights=lengths[item], minlength=len(columns)) / capacity
    forward = lambda x: np.bincount(item, weights=x[column], minlength=len(lengths))
    back = lambda r: np.bincount(column, weights=r[item], minlength=len(columns))
    probe = np.ones(len(columns))
    for _ in range(30):
        probe = back(forward(probe))
        norm = float(np.linalg.norm(probe))
        probe /= norm
    step = 1.0 / (norm * 1.05)
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(steps):
        after = np.maximum(0, y - step * (back(forward(y) - target) + 0.02 * waste * target.mean()))
        t_after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x * scale


def plan(histogram: list[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int, bool]]:
    """(pattern of lengths, repeats, whether fitted) that together hold exactly the histogram's items;
    those that aren't fitted hold what rounding left.

    What rounding leaves is fitted again, with patterns of the lengths that are left, as long as that
    places a twentieth of it; only then the rest is packed, the largest first."""
    histogram = sorted((int(a), int(b)) for a, b in histogram if b > 0)
    if not histogram:
        return []
    lengths = np.array([a for a, _ in histogram])
    left = np.array([b for _, b in histogram])
    if lengths[0] < 1 or lengths[-1] > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    out: dict[tuple[tuple[int, ...], bool], int] = {}

    def take(column: tuple[int, ...], most: int, fitted: bool) -> None:
        used, need = np.unique(column, return_counts=True)
        n = min(most, int((left[used] // need).min()))
        if n > 0:
            left[used] -= n * need
            out[column, fitted] = out.get((column, fitted), 0) + n

    before = -1
    while left.any() and (before < 0 or left.sum() <= 0.95 * before):
        before = left.sum()
        here = np.flatnonzero(left)
        local = patterns(lengths[here], left[here], capacity)
        repeats = fit(local, lengths[here], left[here], capacity)
        columns = [tuple(here[list(c)].tolist()) for c in local]
        room = np.array([capacity - int(lengths[list(c)].sum()) for c in columns])
        for j in np.lexsort((-repeats, room)):
            if repeats[j] >= 1 and room[j] <= capacity // 64:
                take(columns[j], int(repeats[j]), True)
        for j in np.lexsort((-repeats, room)):  # what rounding left of patterns without waste
            if room[j] == 0 and repeats[j] > 0:
                take(columns[j], int(repeats[j]) + 1, True)
    while left.any():  # residuals: the largest first, with whatever fits best beside it
        filled: list[int] = []
        space = capacity
        remaining = left.copy()
        while True:
            k = int(np.searchsorted(lengths, space, side="right")) - 1
            while k >= 0 and remaining[k] == 0:
                k -= 1
            if k < 0:
                break
            filled.append(k)
            remaining[k] -= 1
            space -= int(lengths[k])
        take(tuple(sorted(filled)), int(left.max()), False)
    return [(tuple(int(lengths[i]) for i in c), n, fitted) for (c, fitted), n in sorted(out.items())]


def packed(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, part_no, container, position, tokens, container_tokens, fill, fitted) for every
    document; ``fitted`` tells containers of the fitted patterns from those of the residuals.

    A text within the capacity has one part; a larger one fills containers of its own with all
    parts but the last, which is packed like any text. Positions count from 0 in a container.
    Rows that occur twice are packed twice; null ids are left out; of no documents no rows come.

    A length that a third of all rows share is ranked in buckets, with prefix sums over the
    buckets' counts, so no task holds a length."""
    spark = documents.sparkSession
    counted = token_counts(documents, vocabulary)
    whole = (F.col("tokens") / capacity).cast("long")
    last = F.col("tokens") - whole * capacity
    parts = F.concat(F.array_repeat(F.lit(capacity).cast("long"), whole.cast("int")), F.when(last > 0, F.array(last)).otherwise(F.array().cast("array<long>")))
    parts = counted.select("doc_id", F.posexplode(parts).alias("part_no", "size")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(BUCKETS)).cast("int"))
    parts = cut(parts)
    counts = parts.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    histogram = [(r["size"], r["n"]) for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()]  # at most `capacity` rows
    made = plan(histogram, capacity)

    # Slots of each length in rank order: first rank, pattern's first container, place, copies in a pattern.
    slots: list[tuple[int, int, int, int, int, int, int]] = []
    taken: dict[int, int] = {}
    base = 0
    for pattern, repeats, fitted in made:
        place = 0
        total = sum(pattern)
        for size in sorted(set(pattern), reverse=True):
            copies = pattern.count(size)
            slots.append((size, taken.get(size, 0), base, place, copies, total, int(fitted)))
            taken[size] = taken.get(size, 0) + copies * repeats
            place += copies
        base += repeats
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 7)
    sizes, starts = np.unique(table[:, 0], return_index=True)
    bounds = {int(s): (int(a), int(b)) for s, (a, b) in zip(sizes, pairwise([*starts.tolist(), len(table)]), strict=True)}
    shared = spark.sparkContext.broadcast((table, bounds))  # bounded by the capacity: the plan's slots

    def place_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, bounds = shared.value
        for batch in batches:
            at = np.zeros(len(batch), np.int64)
            size, rank = batch["size"].to_numpy(), batch["rank"].to_numpy()
            for s in np.unique(size):
                a, b = bounds[int(s)]
                mine = size == s
                at[mine] = a + np.searchsorted(table[a:b, 1], rank[mine], side="right") - 1
            slot = table[at]
            within = rank - slot[:, 1]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"], "part_no": batch["part_no"].astype("int64"), "container": slot[:, 2] + within // slot[:, 4],
                    "position": slot[:, 3] + within % slot[:, 4], "tokens": size, "container_tokens": slot[:, 5], "fill": slot[:, 5] / capacity, "fitted": slot[:, 6] == 1,
                }
            )

    rank = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "part_no")) - 1 + F.col("offset")
    ranked = parts.join(offsets.select("size", "bucket", "offset"), ["size", "bucket"]).withColumn("rank", rank.cast("long")).select("doc_id", "part_no", "size", "rank")
    return ranked.mapInPandas(place_rows, "doc_id long, part_no long, container long, position long, tokens long, container_tokens long, fill double, fitted boolean")


def summary(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, parts, tokens, least_containers, mean_fill, fitted_share): what the packing used
    against the number that no packing can go below, and the share of parts in fitted patterns."""
    total = F.sum("tokens")
    made = placed.agg(F.countDistinct("container").alias("containers"), F.count("*").alias("parts"), total.alias("tokens"), F.ceil(total / capacity).cast("long").alias("least_containers"), F.round(F.avg(F.col("fitted").cast("double")), 6).alias("fitted_share"))
    return made.withColumn("mean_fill", F.round(F.col("tokens") / (F.col("containers") * capacity), 6))
