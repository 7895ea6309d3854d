"""Problem 8: evaluation texts leaking into training text.

Method: a generalised suffix automaton of the normalised test items streams over each document's
words and tracks the longest match at every word; items that share enough of them are taken up, and
each one's own automaton gives its longest matches. Matches that follow one diagonal of an item are
joined over single changed words into passages; an item has leaked when one passage, or two in its
order, cover half of its words. The passages are given as spans of the document and removed. Wording
that many items share, counted over all items, counts for none of them.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest match, in words, that is followed up; most words that may differ at one place inside a
#: passage; share of an item's words that must be found word for word (half of them, less the few
#: that may differ); smallest share of one of two passages.
SHORTEST, SLIP, COVERAGE, HALF = 3, 4, 0.42, 0.18
#: An item is taken up when passages of at least so many words cover this share of it. Half of an
#: item in which only a few single words differ always has such stretches.
ANCHOR, ANCHORED = 6, 0.2
#: An n-gram of this many words in this share of the items, and in three of them, is common to them.
COMMON_WORDS, COMMON_SHARE, COMMON_LEAST = 8, 0.02, 3
#: Characters of items in one automaton, which bounds what is broadcast and what a worker holds; more
#: items make more automata and passes over the documents, never fewer items.
BLOCK_CHARS = 2_000_000

ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[nrtbf0abv])")
CODED = re.compile(ESCAPE.pattern + r"|&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?")
WORD = re.compile(r"[^\W_]+")


def decoded(m: re.Match) -> str:
    return " " if m.group()[0] == "\\" else html.unescape(m.group())


def normalised(text: str | None) -> list[str]:
    """Lower-case words without punctuation, quoting, escapes, entities and comment marks. A null
    text has none."""
    if not text:
        return []
    if "&" in text or "\\" in text:
        text = CODED.sub(decoded, text)
    return WORD.findall(text.lower())


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end in ``text`` of each word that ``normalised`` gives."""
    parts: list[str] = []
    starts: list[int] = []  # of each part in the decoded text, and where it comes from
    source: list[tuple[int, int, bool]] = []
    at = made = 0

    def add(piece: str, begin: int, end: int, coded: bool) -> None:
        nonlocal made
        if piece:
            parts.append(piece)
            starts.append(made)
            source.append((begin, end, coded))
            made += len(piece)

    for m in CODED.finditer(text):
        add(text[at : m.start()], at, m.start(), False)
        add(decoded(m), m.start(), m.end(), True)
        at = m.end()
    add(text[at:], at, len(text), False)
    plain = "".join(parts)
    low = plain.lower()
    wide = [i for i, c in enumerate(plain) for _ in c.lower()] if len(low) != len(plain) else None  # a few letters become two

    def place(i: int) -> tuple[int, int]:
        i = wide[i] if wide else i
        k = bisect_right(starts, i) - 1
        begin, end, coded = source[k]
        return (begin, end) if coded else (begin + i - starts[k], begin + i - starts[k] + 1)

    return [(place(m.start())[0], place(m.end() - 1)[1]) for m in WORD.finditer(low)]


class Automaton:
    """Suffix automaton of several word sequences; every state knows one position at which its
    words end, and through the suffix tree all of them."""

    def __init__(self, items: list[tuple[int, list[str]]]) -> None:
        self.ids: dict[str, int] = {}
        self.items = items
        self.known: dict[int, frozenset[int]] = {}
        self.length, self.link, self.next = [0], [-1], [{}]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for k, (_, words) in enumerate(items):
            last = 0
            for i, w in enumerate(words):
                last = self.extend(last, self.ids.setdefault(w, len(self.ids)))
                self.ends[last].append((k, i))
        self.children: list[list[int]] = [[] for _ in self.length]
        for state, parent in enumerate(self.link):
            if parent >= 0:
                self.children[parent].append(state)

    def state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        self.ends.append([])
        return len(self.length) - 1

    def extend(self, last: int, c: int) -> int:
        length, link, nxt = self.length, self.link, self.next
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            clone = self.state(length[last] + 1, link[q], dict(nxt[q]))
            link[q] = clone
            p = last
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            return clone
        cur = self.state(length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = self.state(length[p] + 1, link[q], dict(nxt[q]))
                link[q] = link[cur] = clone
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
        return cur

    def occurrences(self, state: int) -> list[tuple[int, int]]:
        """(item, index of the last word) of every occurrence of a state's words."""
        out, stack = [], [state]
        while stack:
            s = stack.pop()
            out += self.ends[s]
            stack += self.children[s]
        return out

    def held(self, words: list[str], least: int) -> Iterator[frozenset[int]]:
        """At each word, the items that hold the last ``least`` words, where any does."""
        ids, nxt, link, length, known = self.ids, self.next, self.link, self.length, self.known
        v = n = 0
        for w in words:
            c = ids.get(w)
            if c is None:
                v = n = 0
                continue
            while v >= 0 and c not in nxt[v]:
                v = link[v]
                n = length[v] if v >= 0 else 0
            if v < 0:
                v = n = 0
                continue
            v, n = nxt[v][c], n + 1
            if n >= least:
                u = v
                while length[link[u]] >= least:
                    u = link[u]
                if u not in known:
                    known[u] = frozenset(i for i, _ in self.occurrences(u))
                yield known[u]

    def matches(self, words: list[str], shortest: int) -> list[tuple[int, int, int]]:
        """(index of the last word, length, state) of each match that can't be made longer."""
        ids, nxt, link, length = self.ids, self.next, self.link, self.length
        out = []
        v = n = 0
        for i, w in enumerate(words):
            c = ids.get(w)
            if c is None:
                if n >= shortest:
                    out.append((i - 1, n, v))
                v = n = 0
                continue
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
                continue
            if n >= shortest:
                out.append((i - 1, n, v))
            while v >= 0 and c not in nxt[v]:
                v = link[v]
            if v < 0:
                v = n = 0
            else:
                n = length[v] + 1
                v = nxt[v][c]
        if n >= shortest:
            out.append((len(words) - 1, n, v))
        return out


def grams(words: list[str]) -> list[str]:
    return [" ".join(words[a : a + COMMON_WORDS]) for a in range(len(words) - COMMON_WORDS + 1)]


class Detector:
    """Finds leaked items in documents. ``common`` are the n-grams that many items share."""

    def __init__(self, items: list[tuple[int, str]], common: frozenset[str] = frozenset()) -> None:
        worded = [(i, normalised(t)) for i, t in items]
        self.own: list[list[bool]] = []
        for _, words in worded:
            own = [True] * len(words)
            for a, gram in enumerate(grams(words)):
                if gram in common:
                    own[a : a + COMMON_WORDS] = [False] * COMMON_WORDS
            self.own.append(own)
        self.need = [sum(own) for own in self.own]
        self.items = [i for i, _ in worded]
        self.automaton = Automaton(worded)
        self.alone = lru_cache(maxsize=1000)(lambda k: Automaton([(0, worded[k][1])]))

    def passages(self, words: list[str]) -> dict[int, list[tuple[int, int, int, int, int]]]:
        """Item to (first word, last word in the document, first, last in the item, own words
        covered) of its passages: matches chained in both orders over at most ``SLIP`` words."""
        anchored: Counter = Counter()
        for items in self.automaton.held(words, ANCHOR):
            anchored.update(items)
        out: dict[int, list[tuple[int, int, int, int, int]]] = {}
        for item, n in anchored.items():
            own, need = self.own[item], self.need[item]
            if need == 0 or n + ANCHOR - 1 < ANCHORED * need:
                continue
            alone = self.alone(item)
            found = sorted((end - n + 1, at - n + 1, n) for end, n, state in alone.matches(words, SHORTEST) for _, at in alone.occurrences(state))
            if sum(n for _, _, n in found) < COVERAGE * need * 0.8:
                continue
            passages = []
            for chain in chained(found):
                covered = {a + k for _, a, n in chain for k in range(n) if own[a + k]}
                if covered:
                    d, a, n = chain[-1]
                    passages.append((chain[0][0], d + n - 1, min(covered), max(covered), len(covered)))
            if passages:
                out[item] = passages
        return out

    def leaks(self, text: str | None) -> list[tuple[int, float, list[tuple[int, int]]]]:
        """(item id, share of its words found, spans of the leak in the document's characters)."""
        words = normalised(text)
        if len(words) < SHORTEST:
            return []
        out, at = [], None
        for item, passages in self.passages(words).items():
            need = self.need[item]
            one = max(passages, key=lambda p: p[4])
            share, taken = one[4] / need, [one]
            if share < COVERAGE:
                large = sorted(p for p in passages if p[4] >= HALF * need)
                for i, p in enumerate(large):
                    for r in large[i + 1 :]:
                        if r[2] > p[3] - SLIP and (p[4] + r[4]) / need > share:
                            share, taken = (p[4] + r[4]) / need, [p, r]
            if share >= COVERAGE:
                at = at or word_spans(text)
                out.append((self.items[item], min(1.0, share), [(at[p[0]][0], at[p[1]][1]) for p in taken]))
        return out


def chained(found: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Matches (place in the document, place in the item, words), sorted, joined to chains: each
    goes on the open chain nearest to its diagonal. Chains are looked up by the diagonals within
    ``SLIP``, and one is closed once its end is too far behind for anything to follow."""
    chains: list[list[tuple[int, int, int]]] = []
    on: dict[int, list[int]] = defaultdict(list)
    for doc, at, n in found:
        best = None
        for diagonal in range(doc - at - SLIP, doc - at + SLIP + 1):
            if diagonal not in on:
                continue
            on[diagonal] = [k for k in on[diagonal] if doc - sum(chains[k][-1][::2]) <= SLIP * 3]
            for k in on[diagonal]:
                d, a, m = chains[k][-1]
                gap, skip = doc - (d + m), at - (a + m)
                if -m < gap and -m < skip <= SLIP * 3 and at > a:
                    key = (abs(gap - skip) + max(0, gap), -k)
                    if best is None or key < best[0]:
                        best = (key, k, diagonal)
        if best:
            on[best[2]].remove(best[1])
            k = best[1]
            chains[k].append((doc, at, n))
        else:
            k = len(chains)
            chains.append([(doc, at, n)])
        on[doc - at].append(k)
    return chains


_DETECTORS: dict[str, Detector] = {}


def detector_of(key: str, block: list[tuple[int, str]], common: frozenset[str]) -> Detector:
    """The detector of a block, built once in a worker process and kept for its next tasks."""
    if key not in _DETECTORS:
        _DETECTORS.clear()
        _DETECTORS[key] = Detector(block, common)
    return _DETECTORS[key]


def common_grams(items: DataFrame) -> frozenset[str]:
    """The n-grams that at least a share of all items (item_id, text) hold. Of an item with w words
    at most w n-grams count, so there are at most w / share of them for a mean of w words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"gram": [g for t in batch["text"] for g in set(grams(normalised(t)))]}, dtype=object)

    least = max(COMMON_LEAST, COMMON_SHARE * items.count())
    counts = items.select("text").mapInPandas(run, "gram string").groupBy("gram").agg(F.count("*").alias("n"))
    return frozenset(r["gram"] for r in counts.where(F.col("n") >= least).collect())


def leaked(documents: DataFrame, eval_items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, doc_id, share, spans) of each item that a document repeats; ``spans`` are the
    passages as [first_char, last_char) of the document's text.

    The items are a closed set that does not grow with the corpus; beyond ``block_chars`` of them
    they are taken in several blocks, with the same result. Null ids and null or empty texts give
    no row; rows that occur twice give one."""
    spark = documents.sparkSession
    listed = eval_items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    common = common_grams(listed)
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for r in listed.orderBy("item_id", "text").toLocalIterator():
        if size > block_chars:
            blocks.append([])
            size = 0
        blocks[-1].append((r[0], r[1]))
        size += len(r[1])
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "item_id long, doc_id long, share double, spans array<struct<first_char long, last_char long>>"
    parts = []
    for block in blocks:
        shared = spark.sparkContext.broadcast((uuid4().hex, block, common))  # at most block_chars and the common n-grams

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            detector = detector_of(*shared.value)
            for batch in batches:
                rows = [(item, doc, share, [{"first_char": a, "last_char": b} for a, b in spans]) for doc, text in zip(batch["doc_id"], batch["text"], strict=True) for item, share, spans in detector.leaks(text)]
                yield pd.DataFrame(rows, columns=["item_id", "doc_id", "share", "spans"]).astype({"item_id": "int64", "doc_id": "int64", "share": "float64"})

        parts.append(texts.mapInPandas(run, schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("item_id", "doc_id").agg(F.max(F.struct("share", "spans")).alias("x")).select("item_id", "doc_id", "x.share", "x.spans")


def cleaned(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """(doc_id, items, removed_chars, text) of each document that repeats an item: its text without
    the spans of its leaks, which may overlap; other documents stay as they are and give no row.

    Only spans are aggregated. They meet the texts by doc_id, where Spark broadcasts them if they
    are small."""
    spans = leaks.select("doc_id", "item_id", F.explode("spans").alias("x")).groupBy("doc_id").agg(F.countDistinct("item_id").alias("items"), F.array_sort(F.collect_set("x")).alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))

    def keep(done: F.Column, x: F.Column) -> F.Column:
        between = F.substring("text", (done["at"] + 1).cast("int"), F.greatest(F.lit(0), x["first_char"] - done["at"]).cast("int"))
        return F.struct(F.greatest(done["at"], x["last_char"]).alias("at"), F.concat(done["text"], between).alias("text"))

    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(spans, "doc_id").dropDuplicates(["doc_id"])
    kept = F.aggregate("spans", start, keep, lambda done: F.concat(done["text"], F.substring("text", (done["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return texts.select("doc_id", "items", "text", kept.alias("kept")).select("doc_id", "items", (F.length("text") - F.length("kept")).cast("long").alias("removed_chars"), F.col("kept").alias("text"))
