"""Leaks: planted passages in disguise against texts that only sound alike."""

import random

from quarry.llm import leakage as L

NOUNS = "ledger invoice broker orbit comet clinic dosage statute docket orchard silo ferry junction octave chord syllabus pupil striker referee parser linter".split()
VERBS = "sorts loads merges checks ranks splits flushes records".split()


def sentence(rng):
    return f"The {rng.choice(NOUNS)} {rng.choice(VERBS)} every {rng.choice(NOUNS)} before the {rng.choice(NOUNS)} of {rng.choice(NOUNS)} {rng.randrange(1000)} is {rng.choice(VERBS)}."


def corpus():
    rng = random.Random(7)
    opening = "Read the following passage from a project and answer the question with one short phrase taken from it. "
    items = {i: (opening if i % 2 else "") + " ".join(sentence(rng) for _ in range(8)) for i in range(1, 31)}
    plain = {100 + i: " ".join(sentence(rng) for _ in range(40)) for i in range(30)}
    words = items[4].split()
    planted = {
        1: (3, "before " + items[3].upper().replace(" ", " \n// ") + " after"),
        2: (4, "x " + " ".join(words[: len(words) // 2 + 3]) + " y"),
        3: (4, " ".join(words[: len(words) // 3]) + " " + plain[100] + " " + " ".join(words[len(words) * 2 // 3 - 2 :])),
        4: (5, '"' + items[5].replace(opening, "").replace(" ", "\\n") + '"'),
        5: (6, " ".join("other" if i % 17 == 8 else w for i, w in enumerate(items[6].split()))),
    }
    return opening, items, plain, planted


def test_planted_passages_are_found_and_nothing_else(spark):
    opening, items, plain, planted = corpus()
    docs = {**plain, **{d: t for d, (_, t) in planted.items()}, 50: opening * 3, 51: " ".join(items[7].split()[:20]), 52: None, 53: ""}
    rows = [(d, t) for d, t in docs.items()] + [(1, planted[1][1]), (None, planted[1][1])]
    frame = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, share int")
    given = spark.createDataFrame([*items.items(), (99, None), (98, ""), (None, "x y z")], "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in L.leaked(frame, given).collect()}
    assert got == {(item, doc) for doc, (item, _) in planted.items()}
    assert L.leaked(frame.limit(0), given).count() == 0 and L.leaked(frame, given.limit(0)).count() == 0


def test_blocks_of_items_change_nothing(spark):
    opening, items, plain, planted = corpus()
    docs = {**{d: t for d, (_, t) in planted.items()}, 50: opening * 3, 51: opening + plain[100]}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    given = spark.createDataFrame(list(items.items()), "item_id long, text string")
    whole = sorted(map(str, L.leaked(frame, given).collect()))
    assert sorted(map(str, L.leaked(frame, given, block_chars=900).collect())) == whole and len(whole) == len(planted)


def test_spans_are_those_of_the_text_and_are_removed(spark):
    _, items, plain, planted = corpus()
    docs = {d: t for d, (_, t) in planted.items()} | {60: "İstanbul &amp; \\n " + planted[1][1] + " &eacute;t\u00e9 end", 61: plain[101]}
    frame = spark.createDataFrame([(d, t, 7) for d, t in [*docs.items(), (1, docs[1])]], "doc_id long, text string, items int")
    leaks = L.leaked(frame, spark.createDataFrame(list(items.items()), "item_id long, text string"))
    spans = {r.doc_id: [(x.first_char, x.last_char) for x in r.spans] for r in leaks.collect()}
    own = docs[1][spans[1][0][0] : spans[1][0][1]]
    assert "before" not in own and "after" not in own and L.normalised(own) == L.normalised(items[3].replace(" ", " // "))
    assert L.normalised(docs[60][spans[60][0][0] : spans[60][0][1]]) == L.normalised(own) and len(spans[3]) == 2
    rest = {r.doc_id: (r.removed_chars, r.text) for r in L.cleaned(frame, leaks).collect()}
    assert set(rest) == set(spans) and rest[1][1].split() == ["before", ".", "after"] and plain[100] in rest[3][1]
    assert all(n == len(docs[d]) - len(t) for d, (n, t) in rest.items())


def test_word_spans():
    text = "a&amp;b \\u0041x &lt;tag&gt; caf&eacute; İz \\nend"
    assert [text[a:b].replace("İ", "i") for a, b in L.word_spans(text)] == ["a", "b", "x", "tag", "caf&eacute;", "i̇"[0], "z", "end"]
    assert len(L.word_spans(text)) == len(L.normalised(text)) and L.word_spans("") == []


def test_an_item_inside_a_longer_match_of_another_counts():
    rng = random.Random(3)
    long = [rng.choice(NOUNS) + str(rng.randrange(99)) for _ in range(60)]
    detector = L.Detector([(1, " ".join(long)), (2, " ".join(long[20:50]))])
    assert {item for item, _, _ in detector.leaks("x y " + " ".join(long) + " z")} == {1, 2}


def test_repeated_wording_does_not_hide_the_true_chain():
    phrase = "one two three four five six seven "
    item = " ".join(f"{phrase}w{i}" for i in range(60))
    words = L.normalised(item)
    words[200:201] = ["changed", "twice"]
    (_, share, spans), = L.Detector([(1, item)]).leaks(" ".join(words))
    assert share > 0.95 and len(spans) == 1


def test_automaton_matches_a_naive_search():
    rng = random.Random(1)
    items = [(i, [rng.choice("abc") for _ in range(12)]) for i in range(4)]
    automaton = L.Automaton(items)
    words = [rng.choice("abcd") for _ in range(60)]
    grams = {tuple(w[a:b]) for _, w in items for a in range(12) for b in range(a + 1, 13)}
    for end, n, state in automaton.matches(words, 1):
        assert tuple(words[end - n + 1 : end + 1]) in grams
        assert end - n < 0 or tuple(words[end - n : end + 1]) not in grams
        want = {(k, i) for k, (_, w) in enumerate(items) for i in range(n - 1, 12) if w[i - n + 1 : i + 1] == words[end - n + 1 : end + 1]}
        assert set(automaton.occurrences(state)) == want
