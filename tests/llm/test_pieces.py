"""Splitting: a round trip, the limits, and the same pieces for every range length."""

import random

from quarry.llm import pieces as P

SCHEMA = "chunk_id long, full_body string, tokens int"


def text(rng, n):
    words = ["alpha", "beta", "{", "}", "gamma;", "delta.", "äöü", "=", "x"]
    out = []
    while sum(map(len, out)) < n:
        out.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 14))) + rng.choice(["\n", "\n", "\r\n", "\n\n", " "]))
    return "".join(out)[:n]


def check(rows, texts, size=2048, back=256):
    by = {}
    for r in rows:
        by.setdefault(r.chunk_id, []).append(r)
    for i, body in texts.items():
        got = sorted(by[i], key=lambda r: r.piece_no)
        assert [r.piece_no for r in got] == list(range(len(got)))
        assert "".join(r.piece[r.overlap_chars :] for r in got) == body
        for r in got:
            assert len(r.piece) <= size and r.tokens <= size // 4 and 0 <= r.overlap_chars <= back and body[r.start_char : r.end_char] == r.piece
    return by


def test_pieces_join_to_the_text_for_every_range(spark):
    rng = random.Random(5)
    texts = {1: text(rng, 2052), 2: text(rng, 30_000), 3: "x" * 9000, 4: text(rng, 9000) + "y" * 7000 + "\r\n" * 3000, 5: "\n" * 5000}
    rows = [(i, t, 1) for i, t in texts.items()] + [(6, "x" * 2051, 9999), (7, None, 5), (8, "", 5), (None, "x" * 9000, 1), (2, texts[2], 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = P.pieces(frame).collect()
    by = check(whole, texts)
    assert set(by) == set(texts)
    for length in (700, 3000, 5000, 1_000_000):
        ranged = P.pieces(frame, range_chars=length).collect()
        assert sorted(map(tuple, ranged)) == sorted(map(tuple, whole))
    assert {r.chunk_id for r in P.oversized(frame).collect()} == set(texts)
    assert P.pieces(frame.limit(0)).count() == 0


def test_cuts_are_natural_where_they_can_be():
    rng = random.Random(6)
    body = text(rng, 20_000)
    ends = [r[6][-1] for r in P.emit(P.Cutter(body, 0, len(body)), 1, 0, 0, len(body))[:-1]]
    assert all(c == "\n" for c in ends)
    prose = "word " * 3000
    assert all(r[6].endswith(" ") for r in P.emit(P.Cutter(prose, 0, len(prose)), 1, 0, 0, len(prose))[:-1])


def test_a_text_of_many_megabytes_goes_by_ranges(spark):
    rng = random.Random(8)
    body = text(rng, 60_000) * 150 + "z" * 1_500_000 + "word " * 100_000 + text(rng, 60_000) * 20
    want = [r[2:5] for r in P.emit(P.Cutter(body, 0, len(body)), 1, 0, 0, len(body))]
    frame = spark.createDataFrame([(1, body, 1)], SCHEMA)
    for length in (P.RANGE, 100_000):
        got = P.pieces(frame, range_chars=length).drop("piece").orderBy("piece_no").collect()
        assert [(r.start_char, r.end_char, r.overlap_chars) for r in got] == want
    assert len(body) > 10_000_000


def test_an_unbroken_stretch_takes_one_run_a_range():
    body = "x" * 40_000
    a, b = 8192, 16_384
    cutter = P.Cutter(body[a - 258 : b + 2050], a - 258, len(body))
    at = P.entries(cutter, a, a + 2049)
    found, exits, counts, slopes = P.tabulated(cutter, at, b)
    assert len(at) == 2049 and len(found) <= 4 and set(slopes) == {1}
    for entry in (a, a + 1, a + 777, a + 2048):
        cut, n = entry, 0
        while cut < b:
            cut, n = cutter.next(cut), n + 1
        k = max(i for i, x in enumerate(found) if x <= entry)
        assert (exits[k] + slopes[k] * (entry - found[k]), counts[k]) == (cut, n)


def test_the_same_id_with_two_texts_gives_the_pieces_of_one(spark):
    rng = random.Random(9)
    texts = [text(rng, 20_000), text(rng, 12_000)]
    rows = P.pieces(spark.createDataFrame([(1, t, 0) for t in texts] * 2, SCHEMA)).orderBy("piece_no").collect()
    assert "".join(r.piece[r.overlap_chars :] for r in rows) in texts
