"""Problem 5: splitting oversized items at natural boundaries.

Method: the cut that follows a cut depends only on the text within one piece of it. Every text,
whatever its length, is read as ranges with halos, sliced by offset where it is scanned. Each
worker tabulates where a chain of cuts that enters its range leaves it and how many pieces it makes;
the tables of a text are stitched in order (prefix sums of the pieces), and every range emits its
pieces by offset. No Python worker holds more of a text than a range, and the pieces are the same
for every range length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a token, as in the estimate used throughout; limit and overlap in tokens.
CHARS, LIMIT, OVERLAP = 4, 512, 64
#: Characters of a range.
RANGE = 8_192

SCHEMA = "chunk_id long, piece_no long, start_char long, end_char long, overlap_chars long, tokens long, piece string"


# What a character is: line feed, end of a word, end of a sentence, white space, mark before a blank.
LINE, WORD, END, SPACE, STOP, RETURN = 1, 2, 4, 8, 16, 32
ASCII = np.zeros(129, np.uint8)  # the last for all beyond
for _marks, _bit in (("\n", LINE), (" \t,", WORD), ("};", END), (" \t\n\r\v\f\x1c\x1d\x1e\x1f", SPACE), (".;!?", STOP), ("\r", RETURN)):
    for _c in _marks:
        ASCII[ord(_c)] |= _bit
OTHER_SPACES = np.array([c for c in range(128, 0x3001) if chr(c).isspace()], np.uint32)


class Cutter:
    """Finds cuts in a text of which ``text`` is the part from offset ``base`` on; ``total`` is
    the length of the whole. Where marks end is looked up once for the part, so a cut costs a few
    searches in sorted arrays."""

    def __init__(self, text: str, base: int, total: int, limit: int = LIMIT, overlap: int = OVERLAP) -> None:
        self.text, self.base, self.total = text, base, total
        self.size, self.back = limit * CHARS, overlap * CHARS
        self.known: dict[int, int] = {}
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        what = ASCII[np.minimum(code, 128)]
        line, word, white = (what & LINE) > 0, (what & WORD) > 0, (what & SPACE) > 0
        if not text.isascii():
            white |= np.isin(code, OTHER_SPACES)
        blank, sentence = line.copy(), (what & END) > 0
        if len(code):
            blank[0] = False
        blank[1:] &= line[:-1] | (what[:-1] & RETURN > 0) & np.concatenate([[False], line[:-2]])[: len(code) - 1]
        sentence[1:] |= (code[1:] == 32) & ((what[:-1] & STOP) > 0)
        ends = lambda found: (np.flatnonzero(found) + 1).tolist()
        self.blanks, self.lines, self.sentences, self.words = ends(blank), ends(line), ends(sentence), ends(word)
        self.marks = ends(line | word | sentence)
        self.spaces = ends(white)

    def begin(self, cut: int) -> int:
        """Where the piece after ``cut`` begins: at the first line within the overlap, else at
        the first word, else a full overlap back."""
        if cut == 0:
            return 0
        at = cut - self.base
        low = max(0, at - self.back)
        if low + self.base == 0 and at <= self.back:
            return 0
        for ends in (self.lines, self.spaces):
            k = bisect_right(ends, low)
            if k < len(ends) and ends[k] < at:
                return ends[k] + self.base
        return low + self.base

    def next(self, cut: int) -> int:
        """The cut after ``cut``: the last blank line, line end, sentence end or space that still
        fits, in that order, first in the upper half of the piece and then below it; without any,
        the limit, but never between a carriage return and its line feed."""
        if cut in self.known:
            return self.known[cut]
        start = self.begin(cut)
        if self.total - start <= self.size:
            found = self.total
        else:
            high = start + self.size - self.base
            half = max(cut + 1, start + self.size // 2) - self.base
            least = cut + 1 - self.base
            for low, ends in ((half, self.blanks), (half, self.lines), (least, self.blanks), (least, self.lines), (half, self.sentences), (half, self.words), (least, self.words)):
                k = bisect_right(ends, high) - 1
                if k >= 0 and ends[k] >= low:
                    found = ends[k]
                    break
            else:
                found = high
                if self.text[found - 1] == "\r" and self.text[found : found + 1] == "\n":
                    found -= 1
            found += self.base
        self.known[cut] = found
        return found

    def leap(self, cut: int, stop: int) -> tuple[int, int]:
        """(cut, pieces): how far full pieces go on from ``cut`` through a stretch without marks,
        at most to the first cut at or after ``stop``."""
        at, step = cut - self.base, self.size - self.back
        k = bisect_right(self.spaces, max(0, at - self.back))
        if at < self.back or k < len(self.spaces) and self.spaces[k] < at:
            return cut, 0
        k = bisect_right(self.marks, at)
        free = (self.marks[k] if k < len(self.marks) else len(self.text)) - 2
        pieces = min((free - at - step) // step, -(-(stop - cut) // step), (self.total - self.size - 1 - cut) // step)
        return (cut + pieces * step, pieces) if pieces > 0 else (cut, 0)

    def piece(self, cut: int) -> tuple[int, int, str]:
        """(begin, end, text) of the piece after ``cut``."""
        start, end = self.begin(cut), self.next(cut)
        return start, end, self.text[start - self.base : end - self.base]


def emit(cutter: Cutter, chunk_id: int, cut: int, number: int, stop: int) -> list[tuple]:
    """Pieces whose preceding cut lies before ``stop``."""
    rows = []
    while cut < stop and cut < cutter.total:
        start, end, text = cutter.piece(cut)
        rows.append((chunk_id, number, start, end, cut - start, max(1, len(text) // CHARS), text))
        cut, number = end, number + 1
    return rows


def frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({n: "int64" for n in names[:-1]})


def entries(cutter: Cutter, first: int, stop: int) -> list[int]:
    """Every offset from ``first`` to ``stop`` at which a chain of cuts can enter: line ends; in
    lines too long for a piece to end with one, ends of words and sentences; and in stretches too
    long even for those, any place. Stretches whose ends aren't seen count as long."""
    long, top = cutter.size - cutter.back - 2, len(cutter.text)

    def stretches(ends: list[int], low: int, high: int) -> list[tuple[int, int]]:
        a, b = bisect_right(ends, low), bisect_right(ends, high - 1)
        bounds = [low, *ends[a:b], high]
        return [(x, y) for x, y in pairwise(bounds) if y - x >= long or x == 0 or y == top]

    def within(ends: list[int], low: int, high: int) -> list[int]:
        return ends[bisect_left(ends, low) : bisect_left(ends, high)]

    low, high = first - cutter.base, stop - cutter.base
    out = set(within(cutter.lines, low, high))
    for x, y in stretches(cutter.lines, 0, top):
        if x < high and y > low:
            out.update(within(cutter.words, max(x, low), min(y, high)), within(cutter.sentences, max(x, low), min(y, high)))
            for u, v in stretches(cutter.words, x, y):
                out.update(range(max(u, low), min(v, high)))
    return [x + cutter.base for x in sorted(out)]


def tabulated(cutter: Cutter, at: list[int], stop: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """(entries, exits, counts, slopes) of runs of entries: from an entry of a run with slope 0 a chain
    leaves the range at the run's exit, with slope 1 as much later as it enters later, after as many
    pieces."""
    rows: list[list[int]] = []
    leave: dict[int, tuple[int, int]] = {}
    for entry in at:
        chain, cut = [], entry
        while cut < stop and cut not in leave:
            further, pieces = cutter.leap(cut, stop)
            if not pieces:
                further, pieces = cutter.next(cut), 1
            chain.append((cut, pieces))
            cut = further
        out, n = leave.get(cut, (cut, 0))
        for cut, pieces in reversed(chain):
            n += pieces
            leave[cut] = (out, n)
        if rows and rows[-1][2] == n:
            start, exit, _, slope, last = rows[-1]
            if slope <= 0 and out == exit or slope and out - exit == entry - start:
                rows[-1][3:] = [0 if out == exit else 1, entry]
                continue
        rows.append([entry, out, n, -1, entry])
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [max(0, r[3]) for r in rows]


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE) -> DataFrame:
    """(chunk_id, piece_no, start_char, end_char, overlap_chars, tokens, piece) of every chunk
    whose full_body has more than ``limit`` tokens, whatever its recorded counts say.

    Pieces of a chunk are numbered from 0, have at most ``limit`` tokens, and without their
    overlaps they join to the text. Chunks with a null id or text and those within the limit give
    no row; of rows with the same id one is taken. Ranges are exchanged once; a text of the 2 GB
    that a cell can hold has 262,144 of them, whose tables meet where they are stitched."""
    size, back = limit * CHARS, overlap * CHARS
    if back >= size // 2:
        raise ValueError("the overlap must be below half of the limit")
    large = chunks.where("chunk_id is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), "full_body", F.length("full_body").cast("long").alias("total"))
    large = large.where(F.greatest(F.lit(1), F.expr(f"total div {CHARS}")) > limit)
    # One pass cuts a text into ranges; a halo is what the ranges beside one end and begin with.
    before, after = -(-(back + 2) // range_chars), -(-(size + 2) // range_chars)
    shelf = large.select("chunk_id", "total", F.xxhash64("full_body").alias("version"), F.regexp_extract_all("full_body", F.lit("(?s).{1,%d}" % range_chars), F.lit(0)).alias("s"))
    number = F.col("range_no").cast("int")
    left = F.array_join(F.slice("s", F.greatest(F.lit(0), number - before) + 1, F.least(number, F.lit(before))), "")
    right = F.array_join(F.slice("s", number + 2, F.lit(after)), "")
    halo = F.least(F.col("range_no") * range_chars, F.lit(back + 2))
    part = F.concat(F.expr(f"right(left_part, {back + 2})"), F.get("s", number), F.expr(f"left(right_part, {size + 2})"))
    key = ["chunk_id", "version", "range_no"]
    numbered = shelf.select("chunk_id", "version", "total", "s", F.explode(F.expr(f"sequence(0L, (total - 1) div {range_chars})")).alias("range_no"))
    sliced = numbered.select(*key, "total", "s", left.alias("left_part"), right.alias("right_part"))
    ranges = sliced.select(*key, (F.col("range_no") * range_chars - halo).alias("base"), "total", part.alias("part")).repartition(*key).dropDuplicates(key)

    def tabulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, version, number, base, total, part in batch[[*key, "base", "total", "part"]].itertuples(index=False):
                cutter = Cutter(part, base, total, limit, overlap)
                a, b = number * range_chars, min(total, (number + 1) * range_chars)
                rows.append((i, version, number, b, *tabulated(cutter, [0] if number == 0 else entries(cutter, a, min(b, a + size + 1)), b)))
            yield pd.DataFrame(rows, columns=[*key, "range_end", "entries", "exits", "counts", "slopes"])

    tables = ranges.mapInPandas(tabulate, "chunk_id long, version long, range_no long, range_end long, entries array<long>, exits array<long>, counts array<long>, slopes array<long>")

    def stitch(table: pd.DataFrame) -> pd.DataFrame:
        rows, cut, number = [], 0, 0
        for row in table[table["version"] == table["version"].min()].sort_values("range_no").itertuples(index=False):
            if cut < row.range_end:
                k = int(np.searchsorted(row.entries, cut, side="right")) - 1
                rows.append((row.chunk_id, row.version, row.range_no, cut, number))
                cut, number = int(row.exits[k]) + int(row.slopes[k]) * (cut - int(row.entries[k])), number + int(row.counts[k])
        return pd.DataFrame(rows, columns=[*key, "cut", "first_no"])

    stitched = tables.groupBy("chunk_id").applyInPandas(stitch, "chunk_id long, version long, range_no long, cut long, first_no long")

    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                cutter = Cutter(row.part, row.base, row.total, limit, overlap)
                yield frame(emit(cutter, row.chunk_id, row.cut, row.first_no, min(row.total, (row.range_no + 1) * range_chars)))

    return ranges.join(stitched, key).mapInPandas(give, SCHEMA)


def oversized(chunks: DataFrame) -> DataFrame:
    """chunk_id of every chunk that had to be cut: those that have a first piece."""
    return pieces(chunks).where("piece_no = 0").select("chunk_id")
