"""Registered queries of the core operators over the given tables.

Lookups that the operators answer for one name, file or node are asked for all of them at once.
Searches ask for every row whose id is divisible by a hundred, traversals start from that set:
as one set, or, in the queries that end in _each, from each of its nodes on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import parse, text
from quarry.operators import context, graph, hierarchy, metrics, rank, search, traverse
from quarry.plans import build
from quarry.plans.oracles import SQL as SQL
from quarry.runtime import table
from quarry.sources import scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return graph.nodes_of(table(spark, d, "nodes"), *columns)


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges_of(table(spark, d, "edges"), table(spark, d, "nodes").select("id"))


def changed(spark: SparkSession, d: str) -> DataFrame:
    """Files that a scan reported as changed."""
    return table(spark, d, "files").where("is_changed").select("repo", F.col("relative_path").alias("file_path")).distinct()


def contents(spark: SparkSession, d: str) -> DataFrame:
    """The FILE nodes as scanned files."""
    files = nodes(spark, d, "id", "kind", "repo", "file_path", "full_body").where("kind = 'FILE'")
    return files.select("id", "repo", F.col("file_path").alias("relative_path"), text.language("file_path").alias("language"), F.col("full_body").alias("content"))


def hundredth(frame: DataFrame, column: str = "id") -> DataFrame:
    return frame.where(F.col(column) % 100 == 0)


# --- hierarchies ---


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "edges"), table(spark, d, "nodes"))


@query
def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(table(spark, d, "edges"), table(spark, d, "nodes"))


@query
def p2_descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendant_totals(table(spark, d, "edges"), table(spark, d, "nodes"))


@query
def p2_tours(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.tours(table(spark, d, "edges"), table(spark, d, "nodes"))


@query
def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.paths(table(spark, d, "edges"), table(spark, d, "nodes"))
    return found.select("kind", "node_id", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


# --- scans and files ---


@query
def q_ignore_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("repo", "relative_path").distinct().withColumn("ignored", text.ignored("relative_path"))


@query
def q_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").select("repo", "relative_path").distinct().withColumn("language", text.language("relative_path"))


@query
def q_hash(spark: SparkSession, d: str) -> DataFrame:
    return contents(spark, d).select("id", F.sha2("content", 256).alias("content_hash"))


@query
def q_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    middle = files.agg(((F.min(F.unix_micros(F.col("scanned_at").cast("timestamp"))) + F.max(F.unix_micros(F.col("scanned_at").cast("timestamp")))) / 2).alias("middle"))
    before = files.crossJoin(F.broadcast(middle)).where(F.unix_micros(F.col("scanned_at").cast("timestamp")) <= F.col("middle"))  # one row is broadcast
    return scan.snapshot_diff(scan.latest(before), scan.latest(files))


@query
def q_ext_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.extensions(table(spark, d, "files"))


# --- edges ---


@query
def q_edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    return graph.upserted(table(spark, d, "edges"))


@query
def q_referential_filter(spark: SparkSession, d: str) -> DataFrame:
    every = graph.upserted(table(spark, d, "edges")).groupBy("kind").agg(F.count("*").alias("n_all"))
    kept = edges(spark, d).groupBy("kind").agg(F.count("*").alias("n_kept"))
    return every.join(kept, "kind", "left").select("kind", "n_all", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


@query
def q_edges_filter(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("source_id").agg(F.count("*").alias("n_out"), F.countDistinct("kind").alias("n_kinds"), F.round(F.sum("weight"), 6).alias("weight_sum"))


# --- lookups ---


@query
def q_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.counts(nodes(spark, d, "id", "kind"), edges(spark, d))


@query
def q_nodes_by_kind(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "id", "kind", "repo", "file_path", "start_line", "end_line")
    return n.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("repo", "file_path").alias("files"), F.coalesce(F.sum(F.col("end_line") - F.col("start_line") + 1), F.lit(0)).alias("lines"))


@query
def q_nodes_by_file(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "id", "kind", "repo", "file_path", "start_line", "end_line").where("kind not in ('FILE', 'PACKAGE')")
    return n.groupBy("repo", "file_path").agg(F.count("*").alias("n_symbols"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))


@query
def q_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(edges(spark, d))


@query
def q_neighbor_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbour_pairs(edges(spark, d))


@query
def q_resolve_symbol(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolved_symbols(nodes(spark, d, "id", "kind", "name"))


@query
def q_resolve_file(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d, "id", "kind", "name").where("kind = 'FILE'").groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("candidates"))


@query
def q_find_file(spark: SparkSession, d: str) -> DataFrame:
    files = contents(spark, d).select("id", "repo", "relative_path")
    asked = hundredth(files).select("repo", F.regexp_replace(F.element_at(F.split("relative_path", "/"), -1), r"[._].*$", "").alias("text"))
    return build.found_files(files, asked)


@query
def q_edge_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return e.where((F.col("source_id") % 100 == 0) & (F.col("target_id") % 10 == 0))


@query
def q_from_chunks(spark: SparkSession, d: str) -> DataFrame:
    return build.from_chunks(table(spark, d, "chunks")).select("id", "kind", "name", "repo", "file_path", "symbol_kind", F.md5("full_body").alias("digest"))


@query
def q_node_at_line(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "id", "kind", "repo", "file_path", "start_line", "end_line")
    asked = hundredth(n).where("kind not in ('FILE', 'PACKAGE') and start_line is not null").select(F.col("id").alias("target"), "repo", "file_path", (F.col("start_line") + 2).alias("line"))
    return graph.nodes_at(n, asked)


@query
def q_classify_task(spark: SparkSession, d: str) -> DataFrame:
    task, score = text.task(F.col("text"))
    return table(spark, d, "documents").select("doc_id", task.alias("task"), score.alias("score"))


@query
def q_complexity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.complexity(F.col("text")).alias("complexity"))


@query
def q_budget_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", text.complexity(F.col("text")).alias("level"))
    return docs.select("doc_id", *text.budget_shares(F.col("n_chars"), F.col("level")))


@query
def q_parse_target(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "id", "kind", "file_path", "start_line", "name").where("kind <> 'PACKAGE'")
    target = F.concat_ws(":", "file_path", F.col("start_line").cast("string"), "name")
    parts = F.split(target, ":")
    line = F.expr("try_cast(parts[1] as int)")
    return n.select("id", target.alias("target"), parts.alias("parts")).select("id", F.col("parts")[0].alias("file"), line.alias("line"), F.get("parts", F.lit(2)).alias("variable"))


@query
def q_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "id", "kind", "full_body", "skeleton", "token_count_full").where("full_body is not null")
    made = n.select("kind", text.tokens(F.col("full_body")).alias("estimate"), F.col("token_count_full").alias("recorded"))
    return made.groupBy("kind").agg(F.count("*").alias("n"), F.sum("estimate").alias("tokens"), F.sum(F.when(~F.col("estimate").eqNullSafe(F.col("recorded").cast("long")), 1).otherwise(0)).alias("off"))


# --- building ---


@query
def q_links(spark: SparkSession, d: str) -> DataFrame:
    return parse.imported(contents(spark, d))


@query
def q_imports_theta(spark: SparkSession, d: str) -> DataFrame:
    files = contents(spark, d)
    places = nodes(spark, d, "id", "kind", "repo", "file_path").where("kind in ('FILE', 'PACKAGE')").select("id", "repo", F.col("file_path").alias("relative_path"))
    return build.imports(places, parse.imported(files)).select("source_id", "target_id")


@query
def q_contains_join(spark: SparkSession, d: str) -> DataFrame:
    return build.contains(nodes(spark, d, "id", "kind", "name", "repo", "file_path", "enclosing_scope", "start_line", "end_line")).select("source_id", "target_id")


@query
def q_contains_names(spark: SparkSession, d: str) -> DataFrame:
    return build.named_contains(nodes(spark, d, "id", "kind", "name", "repo", "enclosing_scope"))


@query
def q_imports_names(spark: SparkSession, d: str) -> DataFrame:
    files = contents(spark, d)
    return build.named_imports(files.select("id", "repo", "relative_path"), parse.imported(files))


@query
def q_declares(spark: SparkSession, d: str) -> DataFrame:
    made = build.declares(nodes(spark, d, "id", "kind", "repo", "file_path")).groupBy("source_id").agg(F.count("*").alias("n_derived"))
    given = edges(spark, d).where("kind = 'DECLARES'").groupBy("source_id").agg(F.count("*").alias("n_given"))
    return made.join(given, "source_id", "full_outer").select("source_id", F.coalesce("n_derived", F.lit(0)).alias("n_derived"), F.coalesce("n_given", F.lit(0)).alias("n_given"))


@query
def q_refs_equi(spark: SparkSession, d: str) -> DataFrame:
    found = build.references(nodes(spark, d, "id", "kind", "name", "repo", "full_body"))
    return found.groupBy("repo", "name").agg(F.count("*").alias("n_refs"), F.min("source_id").alias("first_ref"))


@query
def q_calls(spark: SparkSession, d: str) -> DataFrame:
    return build.counted_calls(nodes(spark, d, "id", "kind", "name", "repo", "full_body"))


@query
def q_calls_names(spark: SparkSession, d: str) -> DataFrame:
    return build.named_calls(nodes(spark, d, "id", "kind", "name", "repo", "file_path", "full_body"))


@query
def q_py_chunks(spark: SparkSession, d: str) -> DataFrame:
    return parse.chunks_of(contents(spark, d).where("language = 'python'")).select("repo", "file_path", "start_line", "end_line", "kind", "name", "enclosing_scope", "signature", "token_count_skeleton", "token_count_full")


@query
def q_js_chunks(spark: SparkSession, d: str) -> DataFrame:
    return parse.chunks_of(contents(spark, d).where("language in ('javascript', 'typescript')")).select("repo", "file_path", "start_line", "end_line", "kind", "name", "enclosing_scope", "signature", "token_count_skeleton", "token_count_full")


# --- one hop ---


@query
def q_callers(spark: SparkSession, d: str) -> DataFrame:
    return graph.callers(nodes(spark, d, "id", "kind", "name"), edges(spark, d))


@query
def q_callees(spark: SparkSession, d: str) -> DataFrame:
    return graph.callees(nodes(spark, d, "id", "kind", "name"), edges(spark, d))


@query
def q_dependents(spark: SparkSession, d: str) -> DataFrame:
    return graph.file_dependencies(nodes(spark, d, "id", "kind"), edges(spark, d))


@query
def q_dependent_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.dependency_pairs(nodes(spark, d, "id", "kind"), edges(spark, d))


@query
def q_class_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return graph.class_hierarchy(nodes(spark, d, "id", "kind", "name"), edges(spark, d))


# --- traversals ---


@query
def q_ego(spark: SparkSession, d: str) -> DataFrame:
    return traverse.ego(edges(spark, d), hundredth(nodes(spark, d, "id")))


@query
def q_ego_each(spark: SparkSession, d: str) -> DataFrame:
    return traverse.ego_each(edges(spark, d), hundredth(nodes(spark, d, "id")))


def sliced(spark: SparkSession, d: str, backward: bool, each: bool = False) -> DataFrame:
    n = nodes(spark, d, "id", "kind")
    return traverse.sliced(n, edges(spark, d), hundredth(n).where("kind in ('FUNCTION', 'METHOD', 'CLASS')"), backward, each)


@query
def q_backward_slice(spark: SparkSession, d: str) -> DataFrame:
    return sliced(spark, d, True)


@query
def q_forward_slice(spark: SparkSession, d: str) -> DataFrame:
    return sliced(spark, d, False)


@query
def q_backward_slice_each(spark: SparkSession, d: str) -> DataFrame:
    return sliced(spark, d, True, each=True)


@query
def q_forward_slice_each(spark: SparkSession, d: str) -> DataFrame:
    return sliced(spark, d, False, each=True)


@query
def q_slice_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = traverse.slice_lines(nodes(spark, d, "id", "repo", "file_path", "start_line", "full_body"), sliced(spark, d, False))
    return lines.groupBy("repo", "file_path").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("chars"), F.min("line").alias("first_line"))


@query
def q_slice_l4(spark: SparkSession, d: str) -> DataFrame:
    return context.cut_slices(traverse.slice_lines(nodes(spark, d, "id", "repo", "file_path", "start_line", "full_body"), sliced(spark, d, False)))


def lines_each(spark: SparkSession, d: str) -> DataFrame:
    return traverse.slice_lines(nodes(spark, d, "id", "repo", "file_path", "start_line", "full_body"), sliced(spark, d, False, each=True))


@query
def q_slice_lines_each(spark: SparkSession, d: str) -> DataFrame:
    return lines_each(spark, d).groupBy("seed", "repo", "file_path").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("chars"), F.min("line").alias("first_line"))


@query
def q_slice_l4_each(spark: SparkSession, d: str) -> DataFrame:
    return context.cut_slices(lines_each(spark, d))


@query
def q_impact(spark: SparkSession, d: str) -> DataFrame:
    return traverse.impacted(nodes(spark, d, "id", "kind", "repo", "file_path"), edges(spark, d), changed(spark, d))


@query
def q_impact_lines(spark: SparkSession, d: str) -> DataFrame:
    ranges = hundredth(table(spark, d, "chunks"), "chunk_id").select("repo", "file_path", F.col("start_line").alias("first_line"), F.col("end_line").alias("last_line"))
    return traverse.impacted(nodes(spark, d, "id", "kind", "repo", "file_path", "start_line", "end_line"), edges(spark, d), ranges)


@query
def q_impact_report(spark: SparkSession, d: str) -> DataFrame:
    n, e, files = nodes(spark, d, "id", "kind", "name", "repo", "file_path", "start_line"), edges(spark, d), changed(spark, d)
    return context.impact_report(n, traverse.impacted(n, e, files), traverse.importing_files(n, e, files))


@query
def q_impact_files(spark: SparkSession, d: str) -> DataFrame:
    return traverse.importing_files(nodes(spark, d, "id", "kind", "repo", "file_path"), edges(spark, d), changed(spark, d))


@query
def q_delta(spark: SparkSession, d: str) -> DataFrame:
    return traverse.delta_callers(nodes(spark, d, "id", "kind", "name", "repo", "file_path"), edges(spark, d), changed(spark, d)).select("id")


@query
def q_delta_markdown(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "id", "kind", "name", "repo", "file_path", "start_line")
    files = changed(spark, d)
    return context.delta_report(traverse.changed_symbols(n, files), traverse.delta_callers(n, edges(spark, d), files))


@query
def q_flow_layers(spark: SparkSession, d: str) -> DataFrame:
    return traverse.flow_layers(edges(spark, d), hundredth(nodes(spark, d, "id", "kind")).where("kind = 'FUNCTION'"))


@query
def q_flow_edges(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    layers = traverse.flow_layers(e, hundredth(nodes(spark, d, "id", "kind")).where("kind = 'FUNCTION'"))
    return traverse.flow_edges(e, layers).groupBy("kind", "layer").agg(F.count("*").alias("n"))


@query
def q_flow_layers_each(spark: SparkSession, d: str) -> DataFrame:
    return traverse.flow_layers(edges(spark, d), hundredth(nodes(spark, d, "id", "kind")).where("kind = 'FUNCTION'"), each=True)


@query
def q_flow_edges_each(spark: SparkSession, d: str) -> DataFrame:
    return traverse.flow_edges_each(edges(spark, d), hundredth(nodes(spark, d, "id", "kind")).where("kind = 'FUNCTION'"))


# --- analytics ---


@query
def q_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(nodes(spark, d, "id"), edges(spark, d))


@query
def q_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return rank.pagerank(nodes(spark, d, "id"), edges(spark, d))


@query
def q_ppr(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "id")
    return rank.pagerank(n, edges(spark, d), hundredth(n))


@query
def q_percentile(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "id", "kind")
    return rank.percentiles(n, q_pagerank(spark, d))


@query
def q_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return rank.fingerprints(nodes(spark, d, "id", "kind", "name", "signature", "file_path"), edges(spark, d), q_pagerank(spark, d))


@query
def q_clusters(spark: SparkSession, d: str) -> DataFrame:
    return graph.clusters(nodes(spark, d, "id", "kind", "name", "file_path"))


@query
def q_expand(spark: SparkSession, d: str) -> DataFrame:
    return rank.expanded(nodes(spark, d, "id", "kind", "name", "skeleton", "token_count_skeleton"), q_ppr(spark, d))


@query
def q_budget_fit(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "id", "kind", "name", "repo", "file_path", "skeleton", "token_count_skeleton").where("kind in ('FUNCTION', 'CLASS', 'METHOD')")
    ranked = n.join(graph.degrees(nodes(spark, d, "id"), edges(spark, d)), "id").select("repo", "file_path", F.struct((-F.col("out_degree")).alias("order"), "id", graph.skeleton_tokens().alias("cost")).alias("item"))
    fitted = ranked.groupBy("repo", "file_path").agg(rank.greedy_fit(F.array_sort(F.collect_list("item")), 200).alias("taken"))
    return fitted.select("repo", "file_path", F.size("taken").alias("n_taken"), F.array_join(F.transform("taken", lambda x: x.cast("string")), ",").alias("taken"))


# --- search ---


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")


@query
def q_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.code_tokens("text").alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query
def q_bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(documents(spark, d), table(spark, d, "eval_items").select(F.col("item_id").alias("query"), "text"))


@query
def q_cosine(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    return search.cosine(vectors, hundredth(vectors, "doc").select(F.col("doc").alias("query"), "vector"))


def two_lists(spark: SparkSession, d: str) -> list[DataFrame]:
    docs = documents(spark, d)
    words = search.bm25(docs, hundredth(docs, "doc").select(F.col("doc").alias("query"), "text"), 30)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    return [words, search.cosine(vectors, hundredth(vectors, "doc").select(F.col("doc").alias("query"), "vector"), 30)]


@query
def q_rrf(spark: SparkSession, d: str) -> DataFrame:
    return search.fused(two_lists(spark, d))


@query
def q_hybrid(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d, "id", "kind", "name", "skeleton", "full_body").where("kind in ('CHUNK', 'FUNCTION', 'CLASS', 'METHOD')")
    corpus = n.select(F.col("id").alias("doc"), text.filled("skeleton", "full_body", "name").alias("text"))
    asked = hundredth(n).where("name is not null").select(F.col("id").alias("query"), F.col("name").alias("text"))
    words = search.bm25(corpus, asked, 30)
    dense = search.cosine(search.word_vectors(corpus), search.word_vectors(asked), 30)
    merged = search.fused([words, dense], 30)
    return search.boosted(merged, asked, n, graph.degrees(nodes(spark, d, "id"), edges(spark, d)))


# --- context ---


@query
def q_map_l0(spark: SparkSession, d: str) -> DataFrame:
    return context.architecture_map(nodes(spark, d, "id", "kind", "name", "repo", "file_path"), edges(spark, d))


@query
def q_outline_l1(spark: SparkSession, d: str) -> DataFrame:
    return context.outlines(nodes(spark, d, "id", "kind", "name", "skeleton", "signature"), edges(spark, d)).select("id", "tokens", F.md5("outline").alias("digest"))


@query
def q_contract_l2(spark: SparkSession, d: str) -> DataFrame:
    return context.contracts(nodes(spark, d, "id", "kind", "name", "skeleton", "signature", "docstring"), edges(spark, d)).select("name", "id", "tokens", F.md5("contract").alias("digest"))


@query
def q_impl_l3(spark: SparkSession, d: str) -> DataFrame:
    return context.implementations(nodes(spark, d, "id", "kind", "name", "skeleton", "full_body")).select("name", "id", "tokens", F.md5("implementation").alias("digest"))


@query
def q_prompt(spark: SparkSession, d: str) -> DataFrame:
    return context.prompts(nodes(spark, d, "id", "kind", "name", "file_path", "start_line", "end_line", "signature", "skeleton", "full_body"), edges(spark, d))


@query
def q_adaptive(spark: SparkSession, d: str) -> DataFrame:
    return context.adapted(table(spark, d, "documents").select("doc_id", "text"), text.task(F.col("text"))[0]).drop("text")


# --- metrics ---


@query
def q_token_savings(spark: SparkSession, d: str) -> DataFrame:
    return metrics.token_savings(nodes(spark, d, "id", "kind", "name", "skeleton", "full_body", "token_count_skeleton", "token_count_full"))


@query
def q_top_symbols(spark: SparkSession, d: str) -> DataFrame:
    return metrics.largest_symbols(nodes(spark, d, "id", "kind", "name", "full_body", "token_count_full"))


@query
def q_zoom_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.zoom_metrics(nodes(spark, d, "id", "kind", "name", "skeleton", "full_body", "token_count_skeleton", "token_count_full"), edges(spark, d))


@query
def q_graph_export(spark: SparkSession, d: str) -> DataFrame:
    return metrics.export_nodes(nodes(spark, d, "id", "kind", "name", "file_path", "start_line", "full_body", "token_count_full"))


@query
def q_graph_export_edges(spark: SparkSession, d: str) -> DataFrame:
    return metrics.export_edges(nodes(spark, d, "id", "kind"), edges(spark, d))


@query
def q_benchmark_ratio(spark: SparkSession, d: str) -> DataFrame:
    return metrics.reading_cost(nodes(spark, d, "id", "kind", "repo", "file_path", "full_body", "skeleton"))
