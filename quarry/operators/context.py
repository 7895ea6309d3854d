"""Context assembly: maps, outlines, contracts, slices and prompts as ordered string aggregates.

Every collection is sorted, and every group is what a reader is shown at once: a folder, a file or
a symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import filled, folder, tokens
from quarry.operators.graph import SYMBOLS, resolved_symbols


def lines_of(order: list[str], text: str) -> F.Column:
    """Texts of a group in an order, a line each."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text")))), lambda x: x["_text"]), "\n")


def architecture_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """L0: (repo, folder, files, dependencies, symbols): names of imported files and of declared
    classes, functions and methods, sorted and joined, by folder."""
    files = nodes.where("kind = 'FILE'").select("id", "repo", folder("file_path").alias("folder"))
    imports = edges.where("kind = 'IMPORTS'").join(files.withColumnRenamed("id", "source_id"), "source_id").join(nodes.select(F.col("id").alias("target_id"), F.col("name").alias("dep")), "target_id")
    deps = imports.groupBy("repo", "folder").agg(F.array_join(F.array_sort(F.collect_set("dep")), ", ").alias("dependencies"))
    held = edges.where("kind in ('DECLARES', 'CONTAINS')").join(files.withColumnRenamed("id", "source_id"), "source_id").join(nodes.where(F.col("kind").isin(*SYMBOLS)).select(F.col("id").alias("target_id"), F.col("name").alias("symbol")), "target_id")
    symbols = held.groupBy("repo", "folder").agg(F.array_join(F.array_sort(F.collect_set("symbol")), ", ").alias("symbols"))
    counts = files.groupBy("repo", "folder").agg(F.count("*").alias("files"))
    return counts.join(deps, ["repo", "folder"], "left").join(symbols, ["repo", "folder"], "left").select("repo", "folder", "files", F.coalesce("dependencies", F.lit("")).alias("dependencies"), F.coalesce("symbols", F.lit("")).alias("symbols"))


def outlines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """L1: (id, outline, tokens) of each file: its name, then skeleton or signature of everything
    it declares or contains, by id."""
    shown = nodes.select(F.col("id").alias("target_id"), filled("skeleton", "signature").alias("shown")).where("shown is not null")
    parts = edges.where("kind in ('DECLARES', 'CONTAINS')").select("source_id", "target_id").distinct().join(shown, "target_id")
    bodies = parts.groupBy(F.col("source_id").alias("id")).agg(lines_of(["target_id"], "shown").alias("body"))
    head = F.concat(F.lit("── "), F.col("name"), F.lit(" ──"))
    out = nodes.where("kind = 'FILE'").select("id", "name").join(bodies, "id", "left")
    return out.select("id", F.when(F.col("body").isNull(), head).otherwise(F.concat(head, F.lit("\n"), F.col("body"))).alias("outline")).withColumn("tokens", tokens(F.col("outline")))


def contracts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """L2: (name, id, contract, tokens): a name's symbol with the interfaces of what it calls."""
    shown = nodes.select("id", filled("skeleton", "signature", "name").alias("shown"), "signature", "docstring")
    called = edges.where("kind = 'CALLS'").select(F.col("source_id").alias("id"), "target_id").distinct().join(shown.select(F.col("id").alias("target_id"), F.col("shown").alias("callee")), "target_id")
    callee = called.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("callee")), "\n").alias("callees"))
    full = F.concat(F.col("signature"), F.lit('\n    """'), F.col("docstring"), F.lit('"""\n    ...'))
    documented = (F.coalesce("docstring", F.lit("")) != "") & (F.coalesce("signature", F.lit("")) != "") & ~F.col("shown").contains(F.col("docstring"))
    base = resolved_symbols(nodes).select("name", "id").join(shown, "id").select("name", "id", F.when(documented, full).otherwise(F.col("shown")).alias("base")).join(callee, "id", "left")
    text = F.when(F.col("callees").isNull(), F.col("base")).otherwise(F.concat("base", F.lit("\n\n# Callee interfaces:\n"), F.col("callees")))
    return base.select("name", "id", text.alias("contract")).withColumn("tokens", tokens(F.col("contract")))


def implementations(nodes: DataFrame) -> DataFrame:
    """L3: (name, id, implementation, tokens) of the symbol that a name stands for."""
    body = nodes.select("id", filled("full_body", "skeleton", "name").alias("implementation"))
    return resolved_symbols(nodes).select("name", "id").join(body, "id").select("name", "id", "implementation", tokens(F.col("implementation")).alias("tokens"))


def cut_slices(lines: DataFrame, budget: int = 800) -> DataFrame:
    """L4: (repo, file_path, kept, dropped, tokens): of each file's slice lines (repo, file_path,
    line, text) those before the budget less twenty runs out, a true prefix. Lines with a seed are
    cut for each (seed, repo, file_path)."""
    keys = ["seed"] * ("seed" in lines.columns) + ["repo", "file_path"]
    run = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    cost = lines.withColumn("cost", tokens(F.col("text"))).withColumn("used", F.sum("cost").over(run))
    fits = F.col("used") <= budget - 20
    return cost.groupBy(*keys).agg(
        F.sum(F.when(fits, 1).otherwise(0)).alias("kept"), F.sum(F.when(fits, 0).otherwise(1)).alias("dropped"), (F.coalesce(F.sum(F.when(fits, F.col("cost"))), F.lit(0)) + 10).alias("tokens")
    )


def prompts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, prompt, tokens) of each function, class or method: its body, at most eight interfaces
    and five classes that its calls reach, by id."""
    focus = nodes.where(F.col("kind").isin(*SYMBOLS)).select("id", "name", "file_path", "start_line", "end_line", filled("full_body", "skeleton", "signature").alias("body"))
    near = edges.where("kind = 'CALLS'").select(F.col("source_id").alias("id"), "target_id").where("id <> target_id").distinct()
    shown = nodes.where(F.col("kind").isin(*SYMBOLS)).select(F.col("id").alias("target_id"), F.when(F.col("kind") == "CLASS", "m").otherwise("i").alias("part"), filled("signature", "skeleton", "name").alias("shown"))
    joined = near.join(shown, "target_id")
    order = Window.partitionBy("id", "part").orderBy("target_id")
    kept = joined.withColumn("n", F.row_number().over(order)).where("(part = 'i' and n <= 8) or (part = 'm' and n <= 5)")
    sides = kept.groupBy("id").pivot("part", ["i", "m"]).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("target_id", "shown"))), lambda x: x["shown"]), "\n\n"))
    head = F.concat(F.lit("--- FOCUS: "), F.col("name"), F.lit(" ["), F.coalesce("file_path", F.lit("unknown")), F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("")), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.lit("")), F.lit("] ---\n"), F.coalesce("body", F.lit("")))
    text = F.concat(head, F.when(F.col("i").isNotNull(), F.concat(F.lit("\n--- CONNECTED INTERFACES ---\n"), F.col("i"))).otherwise(F.lit("")), F.when(F.col("m").isNotNull(), F.concat(F.lit("\n--- DATA TYPES ---\n"), F.col("m"))).otherwise(F.lit("")))
    return focus.join(sides, "id", "left").select("id", text.alias("prompt")).withColumn("tokens", tokens(F.col("prompt")))


# First and last level and token budget by task.
STRATEGIES = {"EXPLORE": (0, 1, 1024, 0), "UNDERSTAND": (1, 2, 2048, 1), "EDIT": (2, 3, 4096, 1), "DEBUG": (3, 4, 2048, 2), "REFACTOR": (1, 3, 8192, 2), "REVIEW": (2, 4, 4096, 1)}


def adapted(requests: DataFrame, tasks: F.Column) -> DataFrame:
    """``requests`` with task, first_level, last_level, token_budget and hops by its task."""
    rows = F.create_map(*[x for t, s in STRATEGIES.items() for x in (F.lit(t), F.array(*[F.lit(v) for v in s]))])
    chosen = requests.withColumn("task", tasks).withColumn("_s", rows[F.col("task")])
    return chosen.select(*requests.columns, "task", *[F.col("_s")[i].alias(n) for i, n in enumerate(("first_level", "last_level", "token_budget", "hops"))])


def first_lines(frame: DataFrame, key: str, order: list[str], line: F.Column, most: int, name: str) -> DataFrame:
    """(key, name, name_lines): how many rows a key has and a line for each of the first ``most`` in an
    order. A key may hold a third of all rows: counts are combined map-side, and rows are ranked first
    within parts of a key, of which only the first go on."""
    counts = frame.groupBy(key).agg(F.count("*").alias(name))
    part = frame.select(key, *order, line.alias("_line")).withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(64)))
    few = part.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))).where(F.col("_n") <= most)
    best = few.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most)
    shown = best.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\n").alias(name + "_lines"))
    return counts.join(shown, key, "left")


def place_line() -> F.Column:
    return F.concat(F.lit("- `"), F.col("name"), F.lit("` ("), F.coalesce("file_path", F.lit("")), F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("")), F.lit(")"))


def delta_report(symbols: DataFrame, callers: DataFrame, repo: str = "repo") -> DataFrame:
    """(repo, symbols, callers, report): by repository the first ten changed symbols and the first
    ten callers to verify, a line each, by id."""
    joined = first_lines(symbols, repo, ["id"], place_line(), 10, "symbols").join(first_lines(callers, repo, ["id"], place_line(), 10, "callers"), repo, "full_outer")
    report = F.concat(F.lit("**Directly Modified Symbols:**\n"), F.coalesce("symbols_lines", F.lit("")), F.lit("\n**Impacted Callers Requiring Verification ("), F.coalesce("callers", F.lit(0)), F.lit("):**\n"), F.coalesce("callers_lines", F.lit("")))
    return joined.select(repo, F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("callers", F.lit(0)).alias("callers"), report.alias("report"))


def impact_report(nodes: DataFrame, reached: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, changed, impacted, files, report): by repository the first ten changed symbols, fifteen
    symbols that reach them by calls and ten files that import changed ones."""
    known = reached.join(nodes, "id")
    a = first_lines(known.where("depth = 0"), "repo", ["id"], place_line(), 10, "changed")
    b = first_lines(known.where("depth > 0"), "repo", ["depth", "id"], place_line(), 15, "impacted")
    c = first_lines(files, "repo", ["file_path"], F.concat(F.lit("- "), F.col("file_path")), 10, "files")
    joined = a.join(b, "repo", "full_outer").join(c, "repo", "full_outer")
    part = lambda title, name: F.concat(F.lit(f"**{title} ("), F.coalesce(name, F.lit(0)), F.lit("):**\n"), F.coalesce(name + "_lines", F.lit("")))
    report = F.concat(part("Changed Symbols", "changed"), F.lit("\n"), part("Impacted Functions", "impacted"), F.lit("\n"), part("Importing Files", "files"))
    return joined.select("repo", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("changed", "impacted", "files")], report.alias("report"))
