"""From scanned files to the graph's tables, whole or by the files that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.parse import chunks_of, imported

EDGE_COLUMNS = ("source_id", "target_id", "kind", "weight")


def node_table(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """FILE nodes and symbol nodes with ids that depend on repository, path and place alone, so
    that a rebuild of one file leaves all other ids as they are."""
    key = lambda *parts: F.abs(F.xxhash64(*parts)) % F.lit(2**53)
    null = lambda kind: F.lit(None).cast(kind)
    file_nodes = files.select(
        key("repo", "relative_path", F.lit("FILE")).alias("id"), F.lit("FILE").alias("kind"), F.element_at(F.split("relative_path", "/"), -1).alias("name"), "repo", F.col("relative_path").alias("file_path"),
        F.lit(1).alias("start_line"), (F.size(F.split("content", "\n"))).alias("end_line"), null("string").alias("signature"), null("string").alias("skeleton"), F.col("content").alias("full_body"), null("string").alias("docstring"),
        "language", null("string").alias("enclosing_scope"), null("string").alias("symbol_kind"), null("int").alias("token_count_skeleton"), F.greatest(F.lit(1), F.expr("length(content) div 4")).cast("int").alias("token_count_full"),
        F.create_map(F.lit("content_hash"), F.col("content_hash"), F.lit("size"), F.col("size").cast("string")).alias("metadata"),
    )
    symbol_nodes = chunks.select(
        key("repo", "file_path", "kind", "name", "start_line", "end_line").alias("id"), F.when(F.col("kind") == "INTERFACE", "CHUNK").otherwise(F.col("kind")).alias("kind"), "name", "repo", "file_path", "start_line", "end_line", "signature", "skeleton",
        "full_body", "docstring", "language", "enclosing_scope", F.col("kind").alias("symbol_kind"), "token_count_skeleton", "token_count_full", F.create_map().cast("map<string,string>").alias("metadata"),
    )
    return file_nodes.unionByName(symbol_nodes)


def declares(nodes: DataFrame) -> DataFrame:
    """From each file to everything in it: an equi-join on the file."""
    files = nodes.where("kind = 'FILE'").select(F.col("id").alias("source_id"), "repo", "file_path")
    return nodes.where("kind <> 'FILE' and kind <> 'PACKAGE'").select(F.col("id").alias("target_id"), "repo", "file_path").join(files, ["repo", "file_path"]).select("source_id", "target_id", F.lit("DECLARES").alias("kind"), F.lit(1.0).alias("weight"))


def contains(nodes: DataFrame) -> DataFrame:
    """From each class to the methods that name it as their scope in the same file; a method without
    a scope belongs to the innermost class of its file whose lines enclose it."""
    edge = lambda frame: frame.select("source_id", "target_id", F.lit("CONTAINS").alias("kind"), F.lit(1.0).alias("weight"))
    classes = nodes.where("kind = 'CLASS'").select(F.col("id").alias("source_id"), "repo", "file_path", F.col("name").alias("enclosing_scope"), F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    methods = nodes.where("kind = 'METHOD'").select(F.col("id").alias("target_id"), "repo", "file_path", "enclosing_scope", "start_line")
    named = edge(methods.join(classes.drop("first", "last"), ["repo", "file_path", "enclosing_scope"]))
    around = methods.where("enclosing_scope is null").join(classes.drop("enclosing_scope"), ["repo", "file_path"]).where(F.col("start_line").between(F.col("first"), F.col("last")))
    inner = around.groupBy("target_id").agg(F.min(F.struct(F.col("last") - F.col("first"), "source_id")).alias("x")).select("x.source_id", "target_id")
    return named.unionByName(edge(inner)).distinct()


def named_contains(nodes: DataFrame) -> DataFrame:
    """(repo, scope, name, n_sources, n_targets, n_edges): the rule by names alone, where a scope's
    name leads from every node of that name to every node of the method's name in the repository. One
    row for a pair of names; the nodes of a name are its members."""
    sizes = nodes.where("name is not null").groupBy("repo", "name").agg(F.count("*").alias("n"))
    pairs = nodes.where("kind = 'METHOD' and enclosing_scope is not null and name is not null").select("repo", F.col("enclosing_scope").alias("scope"), "name").distinct()
    joined = pairs.join(sizes.withColumnsRenamed({"name": "scope", "n": "n_sources"}), ["repo", "scope"]).join(sizes.withColumnRenamed("n", "n_targets"), ["repo", "name"])
    return joined.select("repo", "scope", "name", "n_sources", "n_targets", (F.col("n_sources") * F.col("n_targets")).alias("n_edges"))


def module_key(module: str | F.Column) -> F.Column:
    """A module as the end of a path: leading dots and slashes gone, dots as slashes."""
    bare = F.regexp_replace(module, r"^(?:\.+/)*\.*/?", "")
    return F.when(bare.contains("/"), F.regexp_replace(bare, r"\.\w+$", "")).otherwise(F.regexp_replace(bare, r"\.", "/"))


def imports(files: DataFrame, modules: DataFrame) -> DataFrame:
    """From each file (id, repo, relative_path) to the files and, where given, packages of its
    repository whose path without suffix ends with an imported module (repo, relative_path, module), at a folder's boundary. The
    substring test becomes an equi-join on the ends of paths."""
    stem = F.regexp_replace("relative_path", r"\.[^./]*$", "")
    parts = F.split(stem, "/")
    ends = files.select(F.col("id").alias("target_id"), "repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, -i, i), "/"))).alias("module_key"))
    asked = modules.withColumn("module_key", module_key("module")).where("module_key <> ''").join(files.select(F.col("id").alias("source_id"), "repo", "relative_path"), ["repo", "relative_path"])
    return asked.join(ends, ["repo", "module_key"]).where("source_id <> target_id").select("source_id", "target_id", F.lit("IMPORTS").alias("kind"), F.lit(1.0).alias("weight")).distinct()


#: Lengths of the pieces of a path by which a module's name is looked up in it.
GRAMS = (8, 4, 3, 2, 1)


def module_path(module: str, path: str) -> F.Column:
    """What an import says as a piece of a path: dots and backslashes as slashes, Python's leading dots
    gone; a script's relative path from the folder of the file that imports it."""
    place = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    up = lambda done: F.regexp_replace(done, r"/?[^/]*$", "")
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", up(done)).when(done == "", x).otherwise(F.concat(done, F.lit("/"), x))
    resolved = F.aggregate(F.split(F.concat(place, F.lit("/"), F.col(module)), "/"), F.lit(""), step)
    python = F.lower(F.col(path)).endswith(".py")
    return F.when(python, F.translate(F.regexp_replace(module, r"^\.+", ""), ".\\", "//")).when(F.col(module).startswith("."), resolved).otherwise(F.translate(module, ".\\", "//"))


def held_in(asked: DataFrame, files: DataFrame, text: str) -> DataFrame:
    """The rows of ``asked`` (repo, ``text``, ...) with each file (id as target_id, repo, relative_path) of
    the repository whose path holds the text anywhere.

    The substring test is an equi-join: paths are cut into pieces of a few lengths, a text is looked
    up by the longest that it begins with, and only what that gives is compared."""
    size = F.length(text)
    long = F.when(size >= 8, 8).when(size >= 4, 4).otherwise(size)
    cut_up = lambda g: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("relative_path") - (g - 1))), lambda i: F.substring("relative_path", i, F.lit(g)))
    pieces = F.array_distinct(F.flatten(F.array(*[cut_up(g) for g in GRAMS])))
    held = files.select(F.col("id").alias("target_id"), "repo", "relative_path", F.explode(pieces).alias("piece"))
    return asked.withColumn("piece", F.substring(text, F.lit(1), long)).join(held, ["repo", "piece"]).where(F.col("relative_path").contains(F.col(text))).drop("piece")


def named_imports(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo, module_key, target_id, importers): the rule by text alone, where a module leads to every
    file of the repository (id, repo, relative_path) whose path holds it anywhere. One row for a
    module and a file, with the number of other files that import it."""
    asked = modules.select("repo", "relative_path", module_path("module", "relative_path").alias("module_key")).where("module_key <> ''").distinct()
    found = held_in(asked.groupBy("repo", "module_key").agg(F.count("*").alias("n")), files, "module_key")
    own = asked.withColumn("own", F.lit(1))
    return found.join(own, ["repo", "module_key", "relative_path"], "left").select("repo", "module_key", "target_id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("importers")).where("importers > 0")


def found_files(files: DataFrame, asked: DataFrame) -> DataFrame:
    """(repo, text, id): the first file whose path holds a text (repo, text), by id."""
    return held_in(asked.where("text <> ''").distinct(), files, "text").groupBy("repo", "text").agg(F.min("target_id").alias("id"))


def from_chunks(chunks: DataFrame) -> DataFrame:
    """Nodes of parsed chunks alone, without a scan: each is a CHUNK, whatever its kind; ids are the
    chunks' own, null ids are left out and rows that repeat come once."""
    columns = ["name", "repo", "file_path", "start_line", "end_line", "signature", "skeleton", "full_body", "docstring", "language", "enclosing_scope"]
    return chunks.where("chunk_id is not null").select(F.col("chunk_id").alias("id"), F.lit("CHUNK").alias("kind"), *columns, F.col("kind").alias("symbol_kind"), "token_count_skeleton", "token_count_full").dropDuplicates(["id"])


def references(nodes: DataFrame) -> DataFrame:
    """(repo, source_id, name): names of functions, classes and methods of the repository that occur
    as a word in a symbol's body, other than its own. Words are exploded once and joined by
    equality; only distinct words of a body are shuffled."""
    symbols = nodes.where(F.col("kind").isin("FUNCTION", "CLASS", "METHOD"))
    names = symbols.select("repo", F.col("name").alias("word")).where("word is not null").distinct()
    words = symbols.where("full_body is not null").select("repo", F.col("id").alias("source_id"), "name", F.explode(F.array_distinct(F.regexp_extract_all("full_body", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))).alias("word"))
    return words.where(~F.col("word").eqNullSafe(F.col("name"))).join(names, ["repo", "word"]).select("repo", "source_id", F.col("word").alias("name"))


def calls(nodes: DataFrame) -> DataFrame:
    """From each referring symbol to every symbol of the name in its repository, but itself."""
    targets = nodes.where(F.col("kind").isin("FUNCTION", "CLASS", "METHOD")).select("repo", "name", F.col("id").alias("target_id"))
    return references(nodes).join(targets, ["repo", "name"]).where("source_id <> target_id").select("source_id", "target_id", F.lit("CALLS").alias("kind"), F.lit(1.0).alias("weight")).distinct()


def counted_calls(nodes: DataFrame) -> DataFrame:
    """(repo, source_id, name, n_targets): the edges of ``calls``, one row for a symbol and a name with
    the number of symbols that have it, so that a common name does not multiply."""
    sizes = nodes.where(F.col("kind").isin("FUNCTION", "CLASS", "METHOD")).groupBy("repo", "name").agg(F.count("*").alias("n_targets"))
    return references(nodes).join(sizes, ["repo", "name"]).select("repo", "source_id", "name", "n_targets")


def named_calls(nodes: DataFrame) -> DataFrame:
    """(repo, caller, callee, n_callers, n_callees, n_edges): the rule by names alone, where a name
    whose symbols mention another leads from every symbol of the one to every symbol of the other.
    One row for a pair of names. A symbol that mentions its own name counts unless it stands in the
    file of the last symbol of that name; nothing leads to itself."""
    symbols = nodes.where(F.col("kind").isin("FUNCTION", "CLASS", "METHOD", "CHUNK") & F.col("name").isNotNull())
    names = symbols.groupBy("repo", "name").agg(F.count("*").alias("n"), F.max(F.struct("id", "file_path")).alias("x")).select("repo", "name", "n", F.col("x.file_path").alias("last_file"))
    words = symbols.where("full_body is not null").select("repo", F.col("name").alias("caller"), "file_path", F.explode(F.array_distinct(F.regexp_extract_all("full_body", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("callee"))
    met = words.join(names.where("name <> 'unknown'").withColumnsRenamed({"name": "callee", "n": "n_callees"}), ["repo", "callee"])
    pairs = met.where(~((F.col("caller") == F.col("callee")) & F.col("file_path").eqNullSafe(F.col("last_file")))).select("repo", "caller", "callee", "n_callees").distinct()
    edges = F.col("n_callers") * F.col("n_callees") - F.when(F.col("caller") == F.col("callee"), F.col("n_callers")).otherwise(0)
    return pairs.join(names.select("repo", F.col("name").alias("caller"), F.col("n").alias("n_callers")), ["repo", "caller"]).select("repo", "caller", "callee", "n_callers", "n_callees", edges.alias("n_edges")).where("n_edges > 0")


def built(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of scanned files."""
    nodes = node_table(files, chunks_of(files))
    return nodes, edges_from(nodes, files)


def edges_from(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """All edges that a build derives from its nodes and texts."""
    ids = nodes.where("kind = 'FILE'").select("id", "repo", F.col("file_path").alias("relative_path"))
    return declares(nodes).unionByName(contains(nodes)).unionByName(imports(ids, imported(files))).unionByName(calls(nodes))


def rebuilt(old_nodes: DataFrame, files: DataFrame, status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after some files changed: nodes of new and changed files (status from a
    snapshot diff) are parsed anew, those of unchanged files are kept, edges are derived from
    both, so the result is that of a whole build. ``files`` holds the files that exist now."""
    stale = status.where("status in ('new', 'changed')").select("repo", "relative_path")
    fresh = files.join(stale, ["repo", "relative_path"], "left_semi")
    kept = old_nodes.join(status.where("status = 'unchanged'").select("repo", F.col("relative_path").alias("file_path")), ["repo", "file_path"], "left_semi")
    nodes = kept.unionByName(node_table(fresh, chunks_of(fresh)))
    return nodes, edges_from(nodes, files)
