"""Generated, minified, vendored and data files against hand-written ones."""

import numpy as np

from quarry.llm import handwritten as H

CODE = "".join(f"def step_{i}(rows, limit):\n    total = {i}\n    for row in rows:\n        if row.{w} > limit:\n            total += row.{w} * {i + 3}\n    return total\n\n" for i, w in enumerate(["price", "weight", "size", "level", "speed", "depth", "width", "angle"]))
TABLE = "_tab = {" + ", ".join(f"{i}: ({i * 7 % 397}, -{i % 83})" for i in range(200)) + "}\n"
BLOB = "PAYLOAD = '" + "".join(chr(33 + (i * i * 31 + i * 7) % 5 + 65 - 33 + (i * 17) % 26) for i in range(3000)).replace("'", "x").replace("\\", "y") + "'\n"
MINI = "!function(a){" + "".join(f"a.x{i}=function(b,c){{return b?b.y(c):{{t:{i},e:!0}}}};" for i in range(60)) + "}(this);"


DIGITS = np.random.default_rng(7).integers(0, 90000, 900)
NUMBERS = "DATA = [\n" + ",\n".join(", ".join(str(x) for x in row) for row in DIGITS.reshape(-1, 10)) + "]\n"
ORDERED = "TABLE = {\n" + "".join(f"    'load_record_{i}': ({i * 7 % 90}, 'credit'),\n" for i in range(200)) + "}\n"


def test_repair_finds_repetition():
    hashes, classes, owner = H.tokenised([TABLE, "a b c d e f g h i j k l m", "", "x x x x x x x x"])
    rules, left = H.repair(classes, owner, 4)
    sizes = np.bincount(owner, minlength=4)
    assert (2 * rules + left)[0] < 0.05 * sizes[0] and rules[1] == 0 and left[1] == 13 and left[2] == 0 and left[3] <= 4
    assert len(hashes) == sizes.sum()


def test_repair_of_one_sequence_is_that_of_many():
    owner = np.array([0] * 64 + [1] * 50)
    symbols = np.array([i % 7 for i in range(64)] + [i % 3 for i in range(50)], np.uint64)
    rules, left = H.repair(symbols, owner, 2)
    assert (rules[0], left[0]) == tuple(x[0] for x in H.repair(symbols[:64], owner[:64], 1))


def final_rules(texts):
    hashes, _, owner = H.tokenised(texts)
    for rule, own, span, _ in H.content_rules(hashes, owner):
        pass
    return owner, rule, own, span


def test_equal_passages_make_equal_rules_after_an_edit():
    owner, rule, own, span = final_rules([CODE, "# a line that only the copy has\n" + CODE + "\nprint(1)\n"])
    first = dict(zip(rule[own == 0].tolist(), span[own == 0].tolist(), strict=True))
    shared = sum(s for r, s in zip(rule[own == 1].tolist(), span[own == 1].tolist(), strict=True) if r in first)
    assert shared > 0.55 * (owner == 1).sum() and span[own == 0].sum() == (owner == 0).sum()


def test_only_literals_that_no_rule_shortens_are_blobs():
    classes = lambda t: H.tokenised([t])[1]
    assert H.own_grammar(NUMBERS, "a.py", classes(NUMBERS)) == H.own_grammar(TABLE, "a.py", classes(TABLE)) == "data"
    assert H.own_grammar(ORDERED, "a.py", classes(ORDERED)) == ""
    assert H.own_grammar(NUMBERS, "a.json", classes(NUMBERS)) == ""
    assert H.own_grammar("X = 'abc'\n", "a.py", classes("X = 'abc'\n")) == ""
    assert not H.incompressible("") and not H.incompressible("ab" * 4000)


def test_comment_lines_of_any_length_and_place():
    licence = "".join(f" * Line {i} of the terms under which this text may be used.\n" for i in range(200))
    lines = H.outer_lines(f"/*\n{licence} * Code generated by protoc. DO NOT EDIT.\n */\nint a;\n  // inner\n// outer {'x ' * 500}\n")
    assert "code generated by protoc do not edit" in lines and "line 0 of the terms under which this text may be used" in lines
    assert "inner" not in lines and any(x.startswith("outer x") and len(x) > 1000 for x in lines)
    assert H.outer_lines("") == [] and H.line_rules([]) == []


def verdicts(spark, make_nodes, texts, listed=None):
    rows = [{"id": i, "kind": "FILE", "repo": r, "file_path": p, "full_body": t} for i, ((r, p), t) in enumerate(texts.items())]
    files = spark.createDataFrame(list(texts) + [(None, "x"), ("r", None)] + list(texts)[:2], "repo string, relative_path string") if listed is None else listed
    return {(r.repo, r.relative_path): (r.verdict, r.decided_by) for r in H.not_handwritten(files, make_nodes(rows + rows[:3])).collect()}


def test_verdicts(spark, make_nodes):
    own = CODE.replace("step", "walk").replace("rows", "items").replace("limit", "bound").replace("total", "whole")
    texts = {
        ("r", "a/own.py"): own, ("r", "a/gen.py"): "# Code generated by tool v1. DO NOT EDIT.\nx = 1\n", ("q", "b/gen.py"): "# Code generated by tool v2. DO NOT EDIT.\nz = 1\n",
        ("r", "a/foot.ts"): "const a = 1;\n\n// automatically emitted by tool on each build\n", ("q", "foot.ts"): "const c = 1;\n// automatically emitted by tool on each build\n",
        ("r", "a/notice.py"): "BANNER = '# @generated'\n# The rows below are generated at run time, not stored.\ny = 2\n", ("q", "notice.py"): "# The rows below are generated at run time, not stored.\nw = 2\n",
        ("r", "a/doc.py"): 'def f():\n    """Auto-generated stub."""\n    return 1\n', ("r", "a/stub.js"): "// Auto-generated stub.\nf();\n", ("q", "stub.js"): "// Auto-generated stub.\ng();\n",
        ("r", "a/table.py"): TABLE, ("r", "a/ordered.py"): ORDERED, ("r", "a/blob.py"): BLOB, ("r", "a/app.js"): MINI, ("r", "node_modules/x/y.js"): "let a = 1;\n", ("r", "vendors/x.js"): "let b = 1;\n",
        ("r", "a/copy.py"): CODE, ("other", "lib.py"): "# gridfold v2 | (c) the gridfold contributors | licence\n" + CODE, ("q", "gridfold/x.py"): "# gridfold v1 | (c) the gridfold contributors | licence\na = 3\n",
        ("s", "deep/gridfold/plain.js"): "let q = 7;\n", ("gridfold", "gridfold/own.js"): "let q = 8;\n", ("gridfold", "own.py"): "# gridfold v1 | (c) the gridfold contributors | licence\nb = 3\n",
        ("r", "a/empty.py"): "", ("r", "a/conf.json"): '{"a": [1, 2, 3]}',
    }
    assert verdicts(spark, make_nodes, texts) == {
        ("r", "a/gen.py"): ("generated", "notice"), ("q", "b/gen.py"): ("generated", "notice"), ("r", "a/foot.ts"): ("generated", "notice"), ("q", "foot.ts"): ("generated", "notice"),
        ("r", "a/table.py"): ("data", "own grammar"), ("r", "a/blob.py"): ("data", "own grammar"), ("r", "a/app.js"): ("minified", "own grammar"), ("r", "node_modules/x/y.js"): ("vendored", "folder"),
        ("r", "a/copy.py"): ("vendored", "copy"), ("other", "lib.py"): ("vendored", "notice"), ("q", "gridfold/x.py"): ("vendored", "notice"), ("s", "deep/gridfold/plain.js"): ("vendored", "publisher"),
    }


def test_a_line_of_one_repository_is_no_boilerplate(spark, make_nodes):
    texts = {("r", "a.py"): "# Code generated by tool v1. DO NOT EDIT.\nx = 1\n", ("r", "b.py"): "# Code generated by tool v1. DO NOT EDIT.\ny = 1\n", ("q", "c.py"): "z = 1\n"}
    assert verdicts(spark, make_nodes, texts) == {}


def test_nothing(spark, make_nodes):
    none = spark.createDataFrame([], "repo string, relative_path string, verdict int")
    assert verdicts(spark, make_nodes, {("r", "a.py"): NUMBERS}, none) == {}
    assert H.not_handwritten(none, make_nodes([])).count() == 0
    rows = make_nodes([{"id": 1, "kind": "FILE", "repo": "r", "file_path": None, "full_body": CODE}, {"id": 2, "kind": "FILE", "repo": "r", "file_path": "n.py"}, {"id": 3, "kind": "FILE", "file_path": "n.py", "full_body": CODE}])
    assert H.not_handwritten(spark.createDataFrame([("r", "n.py")], "repo string, relative_path string"), rows).count() == 0
