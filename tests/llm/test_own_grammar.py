"""What a file's own grammar decides: generated code by reuse, blobs by literals that no rule shortens."""

import base64

import numpy as np

from quarry.llm import handwritten as H

ACCESSORS = "class Row:\n" + "".join(f"    def get_f{i}(self):\n        return self._f{i}\n\n    def set_f{i}(self, value):\n        self._f{i} = value\n\n" for i in range(40))
ROUTES = "".join(f"app.get('/x{i}', handler{i});\n" for i in range(300))
SETTINGS = "".join(f"export const LIMIT_{i} = {i * 7};\n" for i in range(300))
CUT_OFF = "def f():\n    table = {\n" + "".join(f"        'load_{i}': ({i * 7}, 'credit'),\n" for i in range(300))
WORDS = "the clerk who opened this ledger wrote down every delivery with its weight and price so that a later reader could find each one again without asking anybody".split()
PROSE = " ".join(WORDS[(i * i + 3 * i) % len(WORDS)] for i in range(90))
PATTERN = "X = '(?:" + "|".join(rf"{w}\d+\.(?:{v})" for w, v in zip(WORDS, WORDS[3:])) + ")'\n"
QUERY = '"""Loads what was delivered."""\nimport logging\n\nQUERY = "select ' + ", ".join(f"{w}_{v}" for w, v in zip(WORDS, WORDS[5:])) + ' from ledger"\nSTEP_PLAN = 951\n'


def verdict(text, path="a.py"):
    return H.own_grammar(text, path, H.tokenised([text])[1])


def test_reuse_flags_generated_code_without_a_notice():
    assert verdict(ACCESSORS) == "generated" and verdict(ACCESSORS, "a.md") == ""


def test_lists_tables_and_settings_are_not_generated():
    assert [verdict(ROUTES, "a.js"), verdict(SETTINGS, "a.ts"), verdict(CUT_OFF), verdict("# a comment\n"), verdict("")] == [""] * 5


def test_a_written_literal_is_no_blob_whatever_its_shape():
    assert len(PATTERN) > 300 and " " not in PATTERN[4:] and verdict(PATTERN) == ""
    assert verdict(QUERY) == ""
    assert not any(H.blob([f"'{PROSE[:n]}'"]) for n in (260, 300, 400))


def test_blobs_of_random_bytes_and_of_encoded_text():
    noise = np.random.default_rng(5).bytes(3000)
    for n in (240, 3000):
        assert all(H.blob([f"'{f(noise[:n]).decode()}'"]) for f in (base64.b64encode, base64.b32encode, base64.b85encode, base64.b16encode))
        assert H.blob(["b'" + "".join(f"\\x{x:02x}" for x in noise[: max(n, 300)]) + "'"])
    for f in (base64.b64encode, base64.b32encode, base64.b85encode, base64.b16encode):
        assert verdict(f"TEXT = '{f(PROSE.encode()).decode()}'\n") == "data"
    assert not H.blob([]) and not H.blob(["'abc'"])


def test_reuse_of_many_files_is_that_of_each():
    texts = [H.structure(H.bare_code(x, "a.py")) for x in (ACCESSORS, "", QUERY, ROUTES)]
    assert np.allclose(H.structural_reuse(texts), [H.structural_reuse([x])[0] for x in texts], atol=0.02) and H.structural_reuse([]).tolist() == []
    at = [H.own_grammar(ACCESSORS, "a.py", H.tokenised([ACCESSORS])[1], None, x) for x in (0.86, 0.95, None)]
    assert at == ["generated"] * 3


def test_deep_and_long_tables_end():
    assert H.structure("x = " + "[" * 20000 + "0" + "]" * 20000).count("0") == 1 and H.structure("x = [" + "(0, 0), " * 100000) != ""


def test_generated_code_in_the_table_of_verdicts(spark, make_nodes):
    rows = [{"id": 1, "kind": "FILE", "repo": "r", "file_path": "a/rows.py", "full_body": ACCESSORS}, {"id": 2, "kind": "FILE", "repo": "r", "file_path": "a/routes.js", "full_body": ROUTES}]
    files = spark.createDataFrame([(x["repo"], x["file_path"]) for x in rows], "repo string, relative_path string")
    assert [tuple(x) for x in H.not_handwritten(files, make_nodes(rows)).collect()] == [("r", "a/rows.py", "generated", "own grammar")]
