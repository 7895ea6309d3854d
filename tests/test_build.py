"""From a source tree to the graph and back: a small project of our own."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.functions import parse, text
from quarry.plans import build
from quarry.sources import scan
from quarry.streaming import incremental

PROJECT = {
    "shop/__init__.py": "",
    "shop/cart.py": 'from .price import total\nimport json\n\n\nclass Cart:\n    """Holds lines."""\n\n    def __init__(self, lines=None):\n        self.lines = lines or []\n\n    @property\n    def sum(self):\n        """Add up all lines of the cart."""\n        return total(self.lines)\n\n\nclass Guest(Cart):\n    def __init__(self):\n        super().__init__()\n',
    "shop/price.py": "from ..tools.round import near\n\n\ndef total(lines):\n    def one(x):\n        return near(x)\n    return sum(one(x) for x in lines)\n",
    "tools/round.py": "def near(x):\n    return round(x, 2)\n",
    "web/app.ts": "import { show } from './view';\n\ninterface Page {\n  name: string;\n}\n\nexport class App {\n  /** Draws one page. */\n  draw(page: Page): void {\n    show(page, { deep: '}' });\n  }\n}\n",
    "web/view.js": "export const show = (page) => {\n  // Puts the page on the screen.\n  return page;\n};\n\nfunction hide() { return /[{]/.test('x'); }\n",
    "broken.py": "class Half:\n    def one(self):\n        return (\n",
    "__pycache__/x.py": "x = 1\n",
    "notes.md": "# notes\n",
}


@pytest.fixture
def project(tmp_path):
    for name, body in PROJECT.items():
        path = tmp_path / "p" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    (tmp_path / "p" / "bad.py").write_bytes(b"def f():\n    return '\xff'\n")
    return str(tmp_path / "p")


def test_scan_finds_languages_hashes_and_ignores(spark, project):
    files = {r.relative_path: r for r in scan.scanned(spark, project, "demo").collect()}
    assert "__pycache__/x.py" not in files and len(files) == len(PROJECT) - 1  # and no empty file
    assert files["web/app.ts"].language == "typescript" and files["notes.md"].language == "markdown"
    assert len(files["shop/cart.py"].content_hash) == 64 and "�" in files["bad.py"].content


def test_chunks_of_both_languages(spark, project):
    found = {(r.file_path, r.kind, r.name, r.enclosing_scope) for r in parse.chunks_of(scan.scanned(spark, project, "demo")).collect()}
    assert {("shop/cart.py", "CLASS", "Cart", None), ("shop/cart.py", "METHOD", "sum", "Cart"), ("shop/price.py", "FUNCTION", "one", None), ("web/app.ts", "INTERFACE", "Page", None),
            ("web/app.ts", "CLASS", "App", None), ("web/app.ts", "METHOD", "draw", "App"), ("web/view.js", "FUNCTION", "show", None), ("web/view.js", "FUNCTION", "hide", None),
            ("broken.py", "CLASS", "Half", None), ("broken.py", "METHOD", "one", "Half")} <= found
    docs = {r.name: r for r in parse.chunks_of(scan.scanned(spark, project, "demo")).collect()}
    assert docs["sum"].docstring == "Add up all lines of the cart." and docs["sum"].signature == "def sum(self):"
    assert docs["draw"].docstring == "Draws one page." and "..." in docs["sum"].skeleton


def edge_names(nodes, edges):
    a, b = nodes.select(F.col("id").alias("source_id"), F.col("name").alias("s")), nodes.select(F.col("id").alias("target_id"), F.col("name").alias("t"))
    return {(r.kind, r.s, r.t) for r in edges.join(a, "source_id").join(b, "target_id").collect()}


def test_build_links_files_symbols_and_calls(spark, project):
    nodes, edges = build.built(scan.scanned(spark, project, "demo"))
    found = edge_names(nodes, edges)
    assert {("DECLARES", "cart.py", "Cart"), ("CONTAINS", "Cart", "sum"), ("IMPORTS", "cart.py", "price.py"), ("IMPORTS", "price.py", "round.py"), ("IMPORTS", "app.ts", "view.js"), ("CALLS", "sum", "total"), ("CALLS", "draw", "show")} <= found
    assert not any(k == "CONTAINS" and s == "Guest" and t == "sum" for k, s, t in found)
    assert nodes.count() == nodes.select("id").distinct().count()


def test_incremental_rebuild_equals_a_whole_build(spark, project, tmp_path):
    scan.scanned(spark, project, "demo").write.parquet(str(tmp_path / "before"))
    before = spark.read.parquet(str(tmp_path / "before"))
    build.built(before)[0].write.parquet(str(tmp_path / "nodes"))
    old_nodes = spark.read.parquet(str(tmp_path / "nodes"))
    with open(f"{project}/shop/price.py", "a") as f:
        f.write("\n\ndef extra(x):\n    return total([x])\n")
    os.remove(f"{project}/tools/round.py")
    now = scan.scanned(spark, project, "demo")
    status = scan.snapshot_diff(before, now)
    assert {r.relative_path: r.status for r in status.where("status <> 'unchanged'").collect()} == {"shop/price.py": "changed", "tools/round.py": "deleted"}
    a_nodes, a_edges = build.rebuilt(old_nodes, now, status)
    b_nodes, b_edges = build.built(now)
    assert {tuple(r) for r in a_nodes.select("id", "name", "full_body").collect()} == {tuple(r) for r in b_nodes.select("id", "name", "full_body").collect()}
    assert {tuple(r) for r in a_edges.collect()} == {tuple(r) for r in b_edges.collect()}


def test_store_and_stream(spark, project, tmp_path):
    store = scan.GraphStore(spark, str(tmp_path / "graph"))
    assert store.nodes().count() == 0
    files = scan.scanned(spark, project, "demo").withColumn("scanned_at", F.lit("2025-01-01").cast("timestamp"))
    files.write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in" / "*"))
    incremental.keep_indexed(incremental.changed_files(stream), store, str(tmp_path / "cp")).awaitTermination()
    whole, _ = build.built(files)
    assert {r.id for r in store.nodes().select("id").collect()} == {r.id for r in whole.select("id").collect()}
    assert store.edges().count() > 10
    store.clear()
    assert store.nodes().count() == 0 and store.edges().count() == 0


def test_expressions_on_odd_input(spark):
    frame = spark.createDataFrame([("a/.bashrc",), ("x/Y.PY",), ("",), (None,), ("build/x.js",), ("re/builder.js",), ("a/b.egg-info/c",)], "relative_path string")
    got = [(r[0], r[1]) for r in frame.select(text.language("relative_path"), text.ignored("relative_path")).collect()]
    assert got == [(None, False), ("python", False), (None, False), (None, False), ("javascript", True), ("javascript", False), (None, True)]
    row = spark.sql("select 'getHTTPResponse __init__ A user_id' as t, '' as e, cast(null as string) as n").select(text.code_tokens("t"), text.code_tokens("e"), text.code_tokens("n")).first()
    assert row[0] == sorted(["get", "http", "response", "gethttpresponse", "__init__", "init", "user_id", "user", "id"]) and row[1] == [] and row[2] is None


def test_name_rules_count_what_they_would_link(spark, project):
    files = scan.scanned(spark, project, "demo")
    nodes, edges = build.built(files)
    pairs = {(r.scope, r.name): r.n_edges for r in build.named_contains(nodes).collect()}
    assert pairs["Cart", "__init__"] == 2 and pairs["Guest", "__init__"] == 2 and pairs["Cart", "sum"] == 1
    ids = nodes.where("kind = 'FILE'").select("id", "repo", F.col("file_path").alias("relative_path"))
    found = {(r.module_key, r.relative_path): r.importers for r in build.named_imports(ids, parse.imported(files)).join(ids.withColumnRenamed("id", "target_id").drop("repo"), "target_id").collect()}
    assert found["price", "shop/price.py"] == 1 and found["tools/round", "tools/round.py"] == 1 and found["web/view", "web/view.js"] == 1 and not any(k == "json" for k, _ in found)
    calls = {(r.caller, r.callee): r.n_edges for r in build.named_calls(nodes).collect()}
    assert calls["sum", "total"] == 1 and calls["draw", "show"] == 1 and ("__init__", "__init__") not in calls and ("total", "total") not in calls
    counted = build.counted_calls(nodes).agg(F.sum("n_targets")).first()[0]
    assert counted == edges.where("kind = 'CALLS'").count()


def test_snapshots_are_kept(spark, project, tmp_path):
    files = scan.scanned(spark, project, "demo")
    assert scan.load_snapshot(spark, str(tmp_path / "none")).count() == 0
    scan.save_snapshot(files, str(tmp_path / "snap"))
    assert {r.status for r in scan.snapshot_diff(scan.load_snapshot(spark, str(tmp_path / "snap")), files).collect()} == {"unchanged"}


def test_methods_without_a_scope_belong_to_the_class_around_them(spark, make_nodes):
    rows = [{"id": 1, "kind": "CLASS", "name": "A", "repo": "r", "file_path": "a.py", "start_line": 1, "end_line": 30}, {"id": 2, "kind": "CLASS", "name": "B", "repo": "r", "file_path": "a.py", "start_line": 5, "end_line": 12}]
    rows += [{"id": 3, "kind": "METHOD", "name": "m", "repo": "r", "file_path": "a.py", "start_line": 6}, {"id": 4, "kind": "METHOD", "name": "n", "repo": "r", "file_path": "a.py", "start_line": 20}, {"id": 5, "kind": "METHOD", "name": "o", "repo": "r", "file_path": "b.py", "start_line": 6}]
    assert {(r.source_id, r.target_id) for r in build.contains(make_nodes(rows)).collect()} == {(2, 3), (1, 4)}
