"""The core queries as SQL for DuckDB, on the same whole tables."""

from __future__ import annotations

from quarry.functions.text import COMPLEX, IGNORED, LANGUAGES, MIDDLING, SHARES, SPLITS, TASKS
from quarry.operators.metrics import COLOURS, SIZES
from quarry.operators.search import DIMENSIONS
from quarry.operators.rank import ALPHA, LOOK, MOST, SETTLED, TOLERANCE

N = """n AS (SELECT DISTINCT id, kind, name, repo, file_path, start_line, end_line, signature, skeleton, full_body, docstring, enclosing_scope, token_count_skeleton, token_count_full FROM nodes WHERE id IS NOT NULL)"""
E = """e AS (SELECT source_id, target_id, upper(trim(kind)) AS kind, coalesce(max(weight), 1.0) AS weight FROM edges
 WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes) GROUP BY 1, 2, 3)"""
G = f"WITH RECURSIVE {N}, {E}"
SYM = "kind IN ('FUNCTION', 'CLASS', 'METHOD')"
RANK = "CASE kind WHEN 'FUNCTION' THEN 0 WHEN 'CLASS' THEN 1 WHEN 'METHOD' THEN 2 ELSE 3 END"
SKEL = "coalesce(CASE WHEN token_count_skeleton > 0 THEN token_count_skeleton END, greatest(1, length(coalesce(nullif(skeleton, ''), nullif(name, ''))) // 4), 1)"
FULL = "coalesce(CASE WHEN token_count_full > 0 THEN token_count_full END, greatest(1, length(coalesce(nullif(full_body, ''), nullif(name, ''))) // 4), 1)"
SUFFIX = r"lower(regexp_extract(relative_path, '[^/.][^/]*?(\.[^./]+)$', 1))"
FOLDER = r"CASE WHEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) <> '' THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) ELSE '.' END"
CLUSTER = f"CASE WHEN ({FOLDER}) = '.' THEN 'core' ELSE split_part({FOLDER}, '/', -1) END"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def hits(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(text), {quoted(w)}) AS INT)" for w in words) + ")"


def ignore_pattern() -> str:
    made = "|".join("".join("[^/]*" if c == "*" else "\\" + c if not c.isalnum() and c != "_" else c for c in g) for g in IGNORED)
    return f"(^|/)({made})(/|$)"


def code_tokens(column: str) -> str:
    """Distinct tokens of a text, sorted, as a list expression."""
    spaced = r"regexp_replace(regexp_replace(r, '([A-Z]+)', ' \1', 'g'), '([A-Z][a-z]+)', ' \1', 'g')"
    return (
        f"list_sort(list_distinct(flatten(list_transform(list_filter(regexp_split_to_array({column}, '[^a-zA-Z0-9_]+'), lambda r: r <> ''), lambda r: list_concat("
        f"CASE WHEN length(r) > 1 AND len(regexp_split_to_array(trim({spaced}), '\\s+|_')) > 1 THEN [lower(r)] ELSE [] END, "
        f"list_filter(list_transform(regexp_split_to_array({spaced}, '\\s+|_'), lambda x: lower(x)), lambda x: length(x) >= 2 OR x IN ('i', 'j', 'k', 'n', 'x', 'y')))))))"
    )


def bm25(texts: str, asked: str, name: str, k: int) -> str:
    """CTEs that end in ``name`` (query, doc, score, place), of subqueries (doc, text) and (query, text)."""
    p = name
    return f"""{p}_t AS (SELECT doc, {code_tokens("text")} AS terms FROM ({texts}) WHERE text IS NOT NULL),
{p}_i AS (SELECT doc, len(terms) AS length, unnest(terms) AS term FROM {p}_t),
{p}_s AS (SELECT (SELECT count(*) FROM ({texts})) AS docs, (SELECT sum(len(terms)) FROM {p}_t WHERE len(terms) > 0) AS total),
{p}_r AS (SELECT term, count(*) AS n, ln(any_value(docs) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM {p}_i, {p}_s GROUP BY term),
{p}_w AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM {p}_r) ELSE raw END AS idf FROM {p}_r),
{p}_q AS (SELECT query, unnest({code_tokens("text")}) AS term FROM ({asked}) WHERE text IS NOT NULL),
{p}_x AS (SELECT query, doc, round(sum(idf * 2.5::DOUBLE / (1 + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / ((SELECT total FROM {p}_s) / (SELECT docs FROM {p}_s))))), 6) AS score
 FROM {p}_q JOIN {p}_w USING (term) JOIN {p}_i USING (term) GROUP BY query, doc),
{p} AS (SELECT query, doc, score, place FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM {p}_x) WHERE place <= {k} AND score > 0)"""


def word_vector(column: str) -> str:
    digit = lambda i: f"(instr('0123456789abcdef', substr(md5(t), {i}, 1)) - 1)"
    place = f"(CASE WHEN {digit(3)} < 8 THEN 1 ELSE -1 END) * (({digit(1)} * 16 + {digit(2)}) % {DIMENSIONS} + 1)"
    return f"list_transform(range(1, {DIMENSIONS} + 1), lambda i: (len(list_filter(p, lambda x: x = i)) - len(list_filter(p, lambda x: x = -i)))::DOUBLE) AS v FROM (SELECT *, list_transform({code_tokens(column)}, lambda t: {place}) AS p"


def dense(texts: str, asked: str, name: str, k: int) -> str:
    """CTEs that end in ``name`` (query, doc, score, place) over vectors made from words."""
    return f"""{name}_d AS MATERIALIZED (SELECT doc, {word_vector("text")} FROM ({texts})) WHERE len(p) > 0), {name}_q AS MATERIALIZED (SELECT query, {word_vector("text")} FROM ({asked})) WHERE len(p) > 0),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM (SELECT query, doc, round(list_dot_product(q.v, d.v) / (greatest(sqrt(list_dot_product(q.v, q.v)), 1e-10) * greatest(sqrt(list_dot_product(d.v, d.v)), 1e-10)), 6) AS score FROM {name}_q q, {name}_d d)) WHERE place <= {k})"""


def cosine(name: str, k: int) -> str:
    return f"""{name} AS (SELECT query, doc, score, place FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM (
 SELECT q.vec_id AS query, v.vec_id AS doc, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)) WHERE place <= {k})"""


def pagerank(seeded: bool) -> str:
    """CTEs that end in ``scores`` (id, score): rounds until they change by less than the tolerance."""
    jump = "CASE WHEN n.id % 100 = 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM n WHERE id % 100 = 0) ELSE 0::DOUBLE END" if seeded else "1.0::DOUBLE / (SELECT count(*) FROM n)"
    return f"""b AS MATERIALIZED (SELECT n.id, {jump} AS p FROM n), l AS MATERIALIZED (SELECT source_id, target_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY source_id) AS w FROM e),
x AS (SELECT 0 AS k, id, p AS x, p AS seen, 1e9::DOUBLE AS moved FROM b UNION ALL
 SELECT k, id, x, CASE WHEN k % {LOOK} = 0 THEN x ELSE seen END, sum(abs(x - seen)) OVER () FROM (SELECT y.k + 1 AS k, y.id, {ALPHA}::DOUBLE * coalesce(c.came, 0) + (1 - {ALPHA}::DOUBLE) * b.p AS x, y.seen
 FROM x y JOIN b ON b.id = y.id LEFT JOIN (SELECT target_id, sum(z.x * l.w) AS came FROM l JOIN x z ON z.id = l.source_id GROUP BY 1) c ON c.target_id = y.id
 WHERE y.k < {MOST} AND (y.k % {LOOK} <> 0 OR y.moved >= least({TOLERANCE}::DOUBLE * (SELECT count(*) FROM n), {SETTLED}::DOUBLE)))),
last AS (SELECT id, x FROM x WHERE k = (SELECT max(k) FROM x)),
scores AS (SELECT id, round(x / (SELECT sum(x) FROM last) * (SELECT count(*) FROM n), 6) / (SELECT count(*) FROM n)::DOUBLE AS score FROM last)"""


def reach(links: str, seeds: str, hops: int, later: str = "TRUE") -> str:
    """CTEs that end in ``found`` (id, depth): layers of a breadth-first search, unrolled."""
    parts = [f"links AS MATERIALIZED ({links})", f"d0 AS MATERIALIZED (SELECT DISTINCT id, 0 AS depth FROM ({seeds}))"]
    for h in range(1, hops + 1):
        rule = "TRUE" if h == 1 else later
        parts.append(f"d{h} AS MATERIALIZED (SELECT id, depth FROM d{h - 1} UNION ALL SELECT DISTINCT links.other, {h} FROM d{h - 1} JOIN links USING (id) WHERE d{h - 1}.depth = {h - 1} AND {rule} AND links.other NOT IN (SELECT id FROM d{h - 1}))")
    return ", ".join([*parts, f"found AS (SELECT id, depth FROM d{hops})"])


BOTH = "SELECT source_id AS id, target_id AS other, kind FROM e UNION ALL SELECT target_id, source_id, kind FROM e"
CHANGED = "changed AS (SELECT DISTINCT repo, relative_path AS file_path FROM files WHERE is_changed)"
SLICE_SEEDS = f"SELECT id FROM n WHERE id % 100 = 0 AND {SYM}"
BACK = reach("SELECT target_id AS id, source_id AS other, kind FROM e WHERE source_id IN (SELECT id FROM n WHERE kind <> 'FILE')", SLICE_SEEDS, 4, "kind IN ('CALLS', 'REFERENCES', 'CONTAINS')")
FORTH = reach("SELECT source_id AS id, target_id AS other, kind FROM e WHERE target_id IN (SELECT id FROM n WHERE kind <> 'FILE')", SLICE_SEEDS, 4, "kind IN ('CALLS', 'CALLED_BY', 'DEF_USE', 'REFERENCES')")
LINES = """raw_lines AS (SELECT repo, file_path, depth, id, start_line + pos - 1 AS line, parts[pos] AS text FROM (SELECT n.repo, n.file_path, found.depth, n.id, n.start_line, string_split(n.full_body, chr(10)) AS parts, unnest(range(1, len(string_split(n.full_body, chr(10))) + 1)) AS pos
 FROM found JOIN n USING (id) WHERE full_body IS NOT NULL AND start_line IS NOT NULL)),
slice_lines AS (SELECT repo, file_path, line, text FROM raw_lines QUALIFY row_number() OVER (PARTITION BY repo, file_path, line ORDER BY depth, id) = 1)"""
RESOLVED = f"resolved AS (SELECT name, id, kind FROM n WHERE {SYM} AND name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY {RANK}, id) = 1)"
DELTA = """delta AS (SELECT * FROM n WHERE id IN (SELECT source_id FROM e WHERE kind = 'CALLS' AND target_id IN (SELECT id FROM n WHERE kind IN ('FUNCTION', 'METHOD', 'CHUNK') AND name IN (SELECT name FROM n SEMI JOIN changed USING (repo, file_path) WHERE kind IN ('FUNCTION', 'CLASS', 'METHOD'))))
 AND NOT EXISTS (SELECT 1 FROM changed c WHERE c.repo = n.repo AND c.file_path = n.file_path))"""
LANGUAGE = f"map_extract_value(MAP {{{', '.join(f'{quoted(a)}: {quoted(b)}' for a, b in LANGUAGES.items())}}}, {SUFFIX})"
FILES = f"""f AS (SELECT id, repo, file_path AS relative_path, {LANGUAGE.replace('relative_path', 'file_path')} AS language, full_body AS content FROM n WHERE kind = 'FILE'),
modules AS (SELECT DISTINCT repo, relative_path, module FROM (SELECT repo, relative_path, unnest(CASE WHEN language = 'python' THEN list_concat(regexp_extract_all(content, '(?m)^[ \\t]*from[ \\t]+([.\\w]+)[ \\t]+import', 1), regexp_extract_all(content, '(?m)^[ \\t]*import[ \\t]+([\\w.]+)', 1))
 WHEN language IN ('javascript', 'typescript') THEN regexp_extract_all(content, '(?:import|export)\\s+[^''";]*?\\s*from\\s+[''"]([^''"]+)[''"]', 1) END) AS module FROM f WHERE content IS NOT NULL))"""


def shares() -> str:
    out = []
    for i, name in enumerate(SHARES):
        cases = " ".join(f"WHEN level < {bound} THEN CAST(floor(n_chars * {parts[i]}::DOUBLE) AS BIGINT)" for bound, parts in SPLITS)
        out.append(f"CASE {cases} END AS {name}")
    return ", ".join(out)


def best_task() -> str:
    scores = [f"{hits(w)} AS {t.lower()}" for t, w in TASKS.items()]
    names = [t.lower() for t in TASKS]
    best = f"greatest({', '.join(names)})"
    cases = " ".join(f"WHEN {t.lower()} = {best} THEN '{t}'" for t in TASKS)
    return f"SELECT doc_id, CASE WHEN {best} = 0 THEN 'UNDERSTAND' {cases} END AS task, {best} AS score FROM (SELECT doc_id, {', '.join(scores)} FROM documents)"


COMPLEXITY = f"CASE WHEN {hits(COMPLEX)} > 0 THEN 0.8::DOUBLE WHEN {hits(MIDDLING)} > 0 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END"
TREE = f"""{G}, l AS (SELECT kind, CASE kind WHEN 'CONTAINS' THEN target_id ELSE source_id END AS id, min(CASE kind WHEN 'CONTAINS' THEN source_id ELSE target_id END) AS parent FROM e WHERE kind IN ('CONTAINS', 'INHERITS') GROUP BY 1, 2),
v AS (SELECT kind, id FROM l UNION SELECT kind, parent FROM l), roots AS (SELECT kind, id FROM v ANTI JOIN l USING (kind, id)),
down AS (SELECT kind, id, id AS root_id, 0 AS depth, CAST(id AS VARCHAR) AS path FROM roots UNION ALL SELECT l.kind, l.id, down.root_id, down.depth + 1, down.path || '/' || l.id FROM l JOIN down ON l.kind = down.kind AND l.parent = down.id),
lost AS (SELECT kind, id FROM v ANTI JOIN down USING (kind, id)),
walk AS (SELECT kind, id AS start, id, [id] AS seen, FALSE AS closed FROM lost UNION ALL
 SELECT w.kind, w.start, l.parent, list_append(w.seen, l.parent), list_contains(w.seen, l.parent) FROM walk w JOIN l ON l.kind = w.kind AND l.id = w.id WHERE NOT w.closed),
ring AS (SELECT kind, start AS id, list_min(seen[list_position(seen, id):]) AS root_id, id = start AS on_cycle, seen FROM walk WHERE closed)"""

SQL: dict[str, str] = {
    "p2_found": f"{TREE} SELECT kind, id AS node_id, root_id, CAST(depth AS BIGINT) AS depth FROM down UNION ALL SELECT kind, id, root_id, CASE WHEN on_cycle THEN -1 ELSE -2 END FROM ring",
    "q_ignore_filter": f"SELECT DISTINCT repo, relative_path, regexp_matches(relative_path, {quoted(ignore_pattern())}) AS ignored FROM files",
    "q_language": f"SELECT DISTINCT repo, relative_path, {LANGUAGE} AS language FROM files",
    "q_hash": f"{G} SELECT id, sha256(full_body) AS content_hash FROM n WHERE kind = 'FILE'",
    "q_snapshot_diff": """WITH m AS (SELECT (epoch_us(min(scanned_at)) + epoch_us(max(scanned_at))) / 2 AS middle FROM files),
 a AS (SELECT repo, relative_path, arg_max(content_hash, (scanned_at, content_hash)) AS h FROM files, m WHERE epoch_us(scanned_at) <= middle GROUP BY 1, 2), b AS (SELECT repo, relative_path, arg_max(content_hash, (scanned_at, content_hash)) AS h FROM files GROUP BY 1, 2)
 SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.relative_path, b.relative_path) AS relative_path, CASE WHEN a.repo IS NULL THEN 'new' WHEN b.repo IS NULL THEN 'deleted' WHEN a.h IS DISTINCT FROM b.h THEN 'changed' ELSE 'unchanged' END AS status
 FROM a FULL JOIN b ON a.repo = b.repo AND a.relative_path = b.relative_path""",
    "q_ext_counts": f"SELECT CASE WHEN {SUFFIX} = '' THEN '(no ext)' ELSE {SUFFIX} END AS extension, count(*) AS n FROM (SELECT DISTINCT repo, relative_path FROM files) GROUP BY 1",
    "q_edge_upsert": "SELECT source_id, target_id, upper(trim(kind)) AS kind, max(weight) AS weight FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1, 2, 3",
    "q_referential_filter": f"{G}, a AS (SELECT DISTINCT source_id, target_id, upper(trim(kind)) AS kind FROM edges) SELECT a.kind, count(*) AS n_all, (SELECT count(*) FROM e WHERE e.kind = a.kind) AS n_kept FROM a GROUP BY a.kind",
    "q_edges_filter": f"{G} SELECT source_id, count(*) AS n_out, count(DISTINCT kind) AS n_kinds, round(sum(weight), 6) AS weight_sum FROM e GROUP BY 1",
    "q_counts": f"{G} SELECT 'nodes' AS what, kind, count(*) AS n FROM n GROUP BY kind UNION ALL SELECT 'nodes', '*', count(*) FROM n UNION ALL SELECT 'edges', kind, count(*) FROM e GROUP BY kind UNION ALL SELECT 'edges', '*', count(*) FROM e",
    "q_nodes_by_kind": f"{G} SELECT kind, count(*) AS n, count(DISTINCT CASE WHEN repo IS NOT NULL AND file_path IS NOT NULL THEN (repo, file_path) END) AS files, coalesce(sum(end_line - start_line + 1), 0) AS lines FROM n GROUP BY kind",
    "q_nodes_by_file": f"{G} SELECT repo, file_path, count(*) AS n_symbols, min(start_line) AS first_line, max(end_line) AS last_line FROM n WHERE kind NOT IN ('FILE', 'PACKAGE') GROUP BY 1, 2",
    "q_neighbors": f"{G}, p AS (SELECT id, other, max(o) AS o, max(i) AS i FROM (SELECT source_id AS id, target_id AS other, 1 AS o, 0 AS i FROM e UNION ALL SELECT target_id, source_id, 0, 1 FROM e) GROUP BY 1, 2) SELECT id, sum(o) AS outgoing, sum(i) AS incoming, count(*) AS neighbours FROM p GROUP BY id",
    "q_resolve_symbol": f"{G}, {RESOLVED} SELECT name, id, kind FROM resolved",
    "q_resolve_file": f"{G} SELECT name, min(id) AS id, count(*) AS candidates FROM n WHERE kind = 'FILE' GROUP BY name",
    "q_find_file": f"{G}, f AS (SELECT id, repo, file_path FROM n WHERE kind = 'FILE'), a AS (SELECT DISTINCT repo, regexp_replace(split_part(file_path, '/', -1), '[._].*$', '') AS text FROM f WHERE id % 100 = 0) SELECT a.repo, a.text, min(f.id) AS id FROM a JOIN f ON f.repo = a.repo AND contains(f.file_path, a.text) WHERE a.text <> '' GROUP BY 1, 2",
    "q_edge_lookup": f"{G} SELECT source_id, target_id, kind, weight FROM e WHERE source_id % 100 = 0 AND target_id % 10 = 0",
    "q_from_chunks": "SELECT DISTINCT chunk_id AS id, 'CHUNK' AS kind, name, repo, file_path, kind AS symbol_kind, md5(full_body) AS digest FROM chunks WHERE chunk_id IS NOT NULL",
    "q_node_at_line": f"""{G}, t AS (SELECT id AS target, repo, file_path, start_line + 2 AS line FROM n WHERE id % 100 = 0 AND kind NOT IN ('FILE', 'PACKAGE') AND start_line IS NOT NULL)
 SELECT target, id FROM (SELECT t.target, c.id, c.kind, t.line BETWEEN c.start_line AND c.end_line AS inside, abs(c.start_line - t.line) AS far FROM t JOIN n c USING (repo, file_path) WHERE c.kind IN ('FUNCTION', 'CLASS', 'METHOD', 'CHUNK') AND c.start_line IS NOT NULL)
 WHERE inside OR kind <> 'CHUNK' QUALIFY row_number() OVER (PARTITION BY target ORDER BY inside DESC, far, {RANK}, id) = 1""",
    "q_classify_task": best_task(),
    "q_complexity": f"SELECT doc_id, {COMPLEXITY} AS complexity FROM documents",
    "q_budget_split": f"SELECT doc_id, {shares()} FROM (SELECT doc_id, n_chars, {COMPLEXITY} AS level FROM documents)",
    "q_parse_target": f"{G}, t AS (SELECT id, string_split(concat_ws(':', file_path, start_line, name), ':') AS parts FROM n WHERE kind <> 'PACKAGE') SELECT id, parts[1] AS file, try_cast(parts[2] AS INT) AS line, parts[3] AS variable FROM t",
    "q_token_estimate": f"{G} SELECT kind, count(*) AS n, sum(greatest(1, length(full_body) // 4)) AS tokens, sum(CASE WHEN greatest(1, length(full_body) // 4) IS DISTINCT FROM token_count_full THEN 1 ELSE 0 END) AS off FROM n WHERE full_body IS NOT NULL GROUP BY kind",
    "q_links": f"{G}, {FILES} SELECT repo, relative_path, module FROM modules",
    "q_imports_theta": f"""{G}, {FILES}, stems AS (SELECT id, repo, string_split(regexp_replace(file_path, '\\.[^./]*$', ''), '/') AS parts FROM n WHERE kind IN ('FILE', 'PACKAGE')),
 ends AS (SELECT id AS target_id, repo, array_to_string(parts[i:], '/') AS key FROM (SELECT id, repo, parts, unnest(range(1, len(parts) + 1)) AS i FROM stems)),
 asked AS (SELECT f.id AS source_id, m.repo, CASE WHEN contains(bare, '/') THEN regexp_replace(bare, '\\.\\w+$', '') ELSE replace(bare, '.', '/') END AS key FROM (SELECT *, regexp_replace(module, '^(?:\\.+/)*\\.*/?', '') AS bare FROM modules) m JOIN f USING (repo, relative_path))
 SELECT DISTINCT source_id, target_id FROM asked JOIN ends USING (repo, key) WHERE key <> '' AND source_id <> target_id""",
    "q_contains_join": f"""{G}, c AS (SELECT * FROM n WHERE kind = 'CLASS'), m AS (SELECT * FROM n WHERE kind = 'METHOD')
 SELECT DISTINCT c.id AS source_id, m.id AS target_id FROM m JOIN c ON c.repo = m.repo AND c.file_path = m.file_path AND c.name = m.enclosing_scope
 UNION SELECT source_id, target_id FROM (SELECT c.id AS source_id, m.id AS target_id, row_number() OVER (PARTITION BY m.id ORDER BY c.end_line - c.start_line, c.id) AS k FROM m JOIN c ON c.repo = m.repo AND c.file_path = m.file_path WHERE m.enclosing_scope IS NULL AND m.start_line BETWEEN c.start_line AND c.end_line) WHERE k = 1""",
    "q_contains_names": f"{G}, z AS (SELECT repo, name, count(*) AS n FROM n WHERE name IS NOT NULL GROUP BY 1, 2), p AS (SELECT DISTINCT repo, enclosing_scope AS scope, name FROM n WHERE kind = 'METHOD' AND enclosing_scope IS NOT NULL) SELECT p.repo, p.scope, p.name, a.n AS n_sources, b.n AS n_targets, a.n * b.n AS n_edges FROM p JOIN z a ON a.repo = p.repo AND a.name = p.scope JOIN z b ON b.repo = p.repo AND b.name = p.name",
    "q_imports_names": f"""{G}, {FILES}, asked AS (SELECT DISTINCT repo, relative_path, CASE WHEN ends_with(lower(relative_path), '.py') THEN translate(regexp_replace(module, '^\\.+', ''), '.\\', '//') WHEN starts_with(module, '.') THEN
  list_reduce(string_split(regexp_extract(relative_path, '^(.*)/[^/]*$', 1) || '/' || module, '/'), lambda done, x: CASE WHEN x IN ('', '.') THEN done WHEN x = '..' THEN regexp_replace(done, '/?[^/]*$', '') WHEN done = '' THEN x ELSE done || '/' || x END, '')
  ELSE translate(module, '.\\', '//') END AS module_key FROM modules)
 SELECT asked.repo, module_key, f.id AS target_id, count(*) AS importers FROM asked JOIN f ON f.repo = asked.repo AND contains(f.relative_path, module_key) AND f.relative_path <> asked.relative_path WHERE module_key <> '' GROUP BY 1, 2, 3""",
    "q_calls": f"""{G}, s AS (SELECT * FROM n WHERE {SYM}), w AS (SELECT repo, id, name, unnest(list_distinct(regexp_extract_all(full_body, '[A-Za-z_][A-Za-z0-9_]*'))) AS word FROM s WHERE full_body IS NOT NULL)
 SELECT w.repo, w.id AS source_id, w.word AS name, count(*) AS n_targets FROM w JOIN s ON s.repo = w.repo AND s.name = w.word WHERE w.word IS DISTINCT FROM w.name GROUP BY 1, 2, 3""",
    "q_calls_names": f"""{G}, s AS (SELECT * FROM n WHERE ({SYM} OR kind = 'CHUNK') AND name IS NOT NULL), z AS (SELECT repo, name, count(*) AS n, arg_max(file_path, id) AS last_file FROM s GROUP BY 1, 2),
 w AS (SELECT repo, name AS caller, file_path, unnest(list_distinct(regexp_extract_all(full_body, '[\\p{{L}}\\p{{N}}_]+'))) AS callee FROM s WHERE full_body IS NOT NULL),
 p AS (SELECT DISTINCT w.repo, caller, callee, z.n AS n_callees FROM w JOIN z ON z.repo = w.repo AND z.name = w.callee WHERE callee <> 'unknown' AND NOT (caller = callee AND w.file_path IS NOT DISTINCT FROM z.last_file))
 SELECT * FROM (SELECT p.repo, caller, callee, z.n AS n_callers, n_callees, z.n * n_callees - CASE WHEN caller = callee THEN z.n ELSE 0 END AS n_edges FROM p JOIN z ON z.repo = p.repo AND z.name = p.caller) WHERE n_edges > 0""",
    "q_declares": f"""{G}, a AS (SELECT f.id AS source_id, count(*) AS n_derived FROM n s JOIN n f ON f.repo = s.repo AND f.file_path = s.file_path WHERE f.kind = 'FILE' AND s.kind NOT IN ('FILE', 'PACKAGE') GROUP BY 1), b AS (SELECT source_id, count(*) AS n_given FROM e WHERE kind = 'DECLARES' GROUP BY 1)
 SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(n_derived, 0) AS n_derived, coalesce(n_given, 0) AS n_given FROM a FULL JOIN b ON a.source_id = b.source_id""",
    "q_refs_equi": f"""{G}, s AS (SELECT * FROM n WHERE {SYM}), w AS (SELECT repo, id, name, unnest(list_distinct(regexp_extract_all(full_body, '[A-Za-z_][A-Za-z0-9_]*'))) AS word FROM s WHERE full_body IS NOT NULL)
 SELECT w.repo, w.word AS name, count(*) AS n_refs, min(w.id) AS first_ref FROM w SEMI JOIN s ON s.repo = w.repo AND s.name = w.word WHERE w.word IS DISTINCT FROM w.name GROUP BY 1, 2""",
    "q_callers": f"{G} SELECT DISTINCT n.name, e.source_id AS caller_id FROM e JOIN n ON n.id = e.target_id WHERE e.kind = 'CALLS' AND n.kind IN ('FUNCTION', 'METHOD', 'CHUNK')",
    "q_callees": f"{G} SELECT DISTINCT n.name, e.target_id AS callee_id FROM e JOIN n ON n.id = e.source_id WHERE e.kind = 'CALLS' AND n.kind IN ('FUNCTION', 'METHOD', 'CHUNK')",
    "q_dependents": f"{G}, i AS (SELECT * FROM e WHERE kind = 'IMPORTS') SELECT n.id, coalesce(o.c, 0) AS dependencies, coalesce(b.c, 0) AS dependents FROM n LEFT JOIN (SELECT source_id, count(DISTINCT target_id) AS c FROM i GROUP BY 1) o ON o.source_id = n.id LEFT JOIN (SELECT target_id, count(DISTINCT source_id) AS c FROM i GROUP BY 1) b ON b.target_id = n.id WHERE n.kind = 'FILE'",
    "q_class_hierarchy": f"""{G}, i AS (SELECT * FROM e WHERE kind = 'INHERITS'), u AS (SELECT i.source_id AS id, string_agg(DISTINCT n.name, ',' ORDER BY n.name) AS names FROM i JOIN n ON n.id = i.target_id GROUP BY 1), d AS (SELECT i.target_id AS id, string_agg(DISTINCT n.name, ',' ORDER BY n.name) AS names FROM i JOIN n ON n.id = i.source_id GROUP BY 1)
 SELECT n.id, coalesce(u.names, '') AS bases, coalesce(d.names, '') AS subclasses FROM n LEFT JOIN u USING (id) LEFT JOIN d USING (id) WHERE n.kind = 'CLASS'""",
    "q_ego": f"{G}, {reach(BOTH, 'SELECT id FROM n WHERE id % 100 = 0', 2)} SELECT id, depth FROM found",
    "q_backward_slice": f"{G}, {BACK} SELECT id, depth FROM found",
    "q_forward_slice": f"{G}, {FORTH} SELECT id, depth FROM found",
    "q_slice_lines": f"{G}, {FORTH}, {LINES} SELECT repo, file_path, count(*) AS n_lines, sum(length(text)) AS chars, min(line) AS first_line FROM slice_lines GROUP BY 1, 2",
    "q_slice_l4": f"""{G}, {FORTH}, {LINES}, c AS (SELECT repo, file_path, line, greatest(1, length(text) // 4) AS cost FROM slice_lines), u AS (SELECT *, sum(cost) OVER (PARTITION BY repo, file_path ORDER BY line) <= 780 AS fits FROM c)
 SELECT repo, file_path, count(*) FILTER (fits) AS kept, count(*) FILTER (NOT fits) AS dropped, coalesce(sum(cost) FILTER (fits), 0) + 10 AS tokens FROM u GROUP BY 1, 2""",
    "q_impact": f"{G}, {CHANGED}, " + reach("SELECT target_id AS id, source_id AS other, kind FROM e WHERE kind = 'CALLS'", f"SELECT id FROM n SEMI JOIN changed USING (repo, file_path) WHERE {SYM}", 4) + " SELECT id, depth FROM found",
    "q_impact_lines": f"{G}, " + reach("SELECT target_id AS id, source_id AS other, kind FROM e WHERE kind = 'CALLS'", f"SELECT n.id FROM n JOIN chunks c ON c.repo = n.repo AND c.file_path = n.file_path AND n.start_line <= c.end_line AND n.end_line >= c.start_line WHERE c.chunk_id % 100 = 0 AND n.{SYM}", 4) + " SELECT id, depth FROM found",
    "q_impact_report": f"{G}, {CHANGED}, " + reach("SELECT target_id AS id, source_id AS other, kind FROM e WHERE kind = 'CALLS'", f"SELECT id FROM n SEMI JOIN changed USING (repo, file_path) WHERE {SYM}", 4) + f""", line AS (SELECT n.id, repo, depth, '- `' || name || '` (' || coalesce(file_path, '') || ':' || coalesce(CAST(start_line AS VARCHAR), '') || ')' AS line FROM n JOIN found USING (id)),
 hit AS (SELECT id FROM n SEMI JOIN changed USING (repo, file_path) WHERE kind = 'FILE'), i AS (SELECT DISTINCT repo, file_path FROM n ANTI JOIN changed USING (repo, file_path) WHERE kind = 'FILE' AND id IN (SELECT source_id FROM e WHERE kind = 'IMPORTS' AND target_id IN (SELECT id FROM hit))),
 a AS (SELECT repo, count(*) AS c, string_agg(line, chr(10) ORDER BY id) FILTER (k <= 10) AS t FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY id) AS k FROM line WHERE depth = 0) GROUP BY repo),
 b AS (SELECT repo, count(*) AS c, string_agg(line, chr(10) ORDER BY depth, id) FILTER (k <= 15) AS t FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY depth, id) AS k FROM line WHERE depth > 0) GROUP BY repo),
 f AS (SELECT repo, count(*) AS c, string_agg('- ' || file_path, chr(10) ORDER BY file_path) FILTER (k <= 10) AS t FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file_path) AS k FROM i) GROUP BY repo), r AS (SELECT repo FROM a UNION SELECT repo FROM b UNION SELECT repo FROM f)
 SELECT r.repo, coalesce(a.c, 0) AS changed, coalesce(b.c, 0) AS impacted, coalesce(f.c, 0) AS files, '**Changed Symbols (' || coalesce(a.c, 0) || '):**' || chr(10) || coalesce(a.t, '') || chr(10) || '**Impacted Functions (' || coalesce(b.c, 0) || '):**' || chr(10) || coalesce(b.t, '') || chr(10) || '**Importing Files (' || coalesce(f.c, 0) || '):**' || chr(10) || coalesce(f.t, '') AS report
 FROM r LEFT JOIN a USING (repo) LEFT JOIN b USING (repo) LEFT JOIN f USING (repo)""",
    "q_impact_files": f"{G}, {CHANGED}, hit AS (SELECT id FROM n SEMI JOIN changed USING (repo, file_path) WHERE kind = 'FILE') SELECT DISTINCT repo, file_path FROM n ANTI JOIN changed USING (repo, file_path) WHERE kind = 'FILE' AND id IN (SELECT source_id FROM e WHERE kind = 'IMPORTS' AND target_id IN (SELECT id FROM hit))",
    "q_delta": f"{G}, {CHANGED}, {DELTA} SELECT id FROM delta",
    "q_delta_markdown": f"""{G}, {CHANGED}, {DELTA}, line AS (SELECT id, '- `' || name || '` (' || coalesce(file_path, '') || ':' || coalesce(CAST(start_line AS VARCHAR), '') || ')' AS line FROM n),
 s AS (SELECT repo, count(*) AS symbols, string_agg(line, chr(10) ORDER BY id) FILTER (k <= 10) AS body FROM (SELECT n.repo, n.id, line.line, row_number() OVER (PARTITION BY n.repo ORDER BY n.id) AS k FROM n SEMI JOIN changed USING (repo, file_path) JOIN line USING (id) WHERE {SYM}) GROUP BY repo),
 c AS (SELECT repo, count(*) AS callers, string_agg(line, chr(10) ORDER BY id) FILTER (k <= 10) AS body FROM (SELECT delta.repo, delta.id, line.line, row_number() OVER (PARTITION BY delta.repo ORDER BY delta.id) AS k FROM delta JOIN line USING (id)) GROUP BY repo)
 SELECT coalesce(s.repo, c.repo) AS repo, coalesce(symbols, 0) AS symbols, coalesce(callers, 0) AS callers, '**Directly Modified Symbols:**' || chr(10) || coalesce(s.body, '') || chr(10) || '**Impacted Callers Requiring Verification (' || coalesce(callers, 0) || '):**' || chr(10) || coalesce(c.body, '') AS report FROM s FULL JOIN c ON s.repo = c.repo""",
    "q_flow_layers": f"{G}, {reach(BOTH.replace('FROM e', 'FROM e WHERE kind = $$CALLS$$'), 'SELECT id FROM n WHERE id % 100 = 0 AND kind = $$FUNCTION$$', 4)} SELECT id, depth FROM found",
    "q_flow_edges": f"{G}, {reach(BOTH.replace('FROM e', 'FROM e WHERE kind = $$CALLS$$'), 'SELECT id FROM n WHERE id % 100 = 0 AND kind = $$FUNCTION$$', 4)} SELECT e.kind, least(a.depth, b.depth) AS layer, count(*) AS n FROM e JOIN found a ON a.id = e.source_id JOIN found b ON b.id = e.target_id WHERE abs(a.depth - b.depth) = 1 GROUP BY 1, 2",
    "q_degree": f"{G} SELECT n.id, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree FROM n LEFT JOIN (SELECT target_id, count(*) AS c FROM e GROUP BY 1) i ON i.target_id = n.id LEFT JOIN (SELECT source_id, count(*) AS c FROM e GROUP BY 1) o ON o.source_id = n.id",
    "q_pagerank": f"{G}, {pagerank(False)} SELECT id, score FROM scores",
    "q_ppr": f"{G}, {pagerank(True)} SELECT id, score FROM scores",
    "q_percentile": f"{G}, {pagerank(False)}, r AS (SELECT id, round(rank() OVER (ORDER BY score) / (SELECT count(*) FROM scores), 6) AS percentile FROM scores) SELECT id, percentile FROM r JOIN n USING (id) WHERE {SYM}",
    "q_fingerprint": f"""{G}, {pagerank(False)}, r AS (SELECT id, round(rank() OVER (ORDER BY score) / (SELECT count(*) FROM scores), 6) AS percentile FROM scores), i AS (SELECT target_id AS id, count(*) AS c FROM e GROUP BY 1), u AS (SELECT source_id AS id, count(*) AS c FROM e GROUP BY 1)
 SELECT n.id, {CLUSTER} AS cluster, percentile, n.kind || ' ' || n.name || CASE WHEN coalesce(signature, '') <> '' THEN ' [' || signature || ']' ELSE '' END || ' [in:' || coalesce(i.c, 0) || ' out:' || coalesce(u.c, 0) || ' rank:' || CAST(round_even(percentile * 100, 0) AS INT) || '%]' AS fingerprint FROM r JOIN n USING (id) LEFT JOIN i USING (id) LEFT JOIN u USING (id) WHERE {SYM}""",
    "q_clusters": f"""{G}, m AS (SELECT *, {CLUSTER.replace("'core'", "'root'")} AS cluster FROM n WHERE kind IN ('FILE', 'FUNCTION', 'CLASS', 'METHOD', 'CHUNK') AND file_path IS NOT NULL), c AS (SELECT cluster, count(*) AS member_count FROM m GROUP BY 1),
 t AS (SELECT cluster, string_agg(name, ',' ORDER BY id) AS names FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY id) AS k FROM m WHERE kind IN ('CLASS', 'FUNCTION')) WHERE k <= 6 GROUP BY 1),
 l AS (SELECT cluster, string_agg(file_path, ',' ORDER BY file_path) AS names FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY file_path) AS k FROM (SELECT DISTINCT cluster, file_path FROM m)) WHERE k <= 4 GROUP BY 1)
 SELECT cluster, row_number() OVER (ORDER BY cluster) AS cluster_id, member_count, coalesce(t.names, '') AS top_symbols, coalesce(l.names, '') AS lead_files FROM c LEFT JOIN t USING (cluster) LEFT JOIN l USING (cluster)""",
    "q_expand": f"""{G}, {pagerank(True)}, top AS (SELECT id, score, cost, row_number() OVER (ORDER BY score DESC, id) AS k FROM (SELECT id, score, {SKEL} AS cost FROM scores JOIN n USING (id) WHERE kind <> 'FILE') ORDER BY score DESC, id LIMIT 20),
 fit AS (SELECT 0::BIGINT AS k, 0::BIGINT AS used, NULL::BIGINT AS id, FALSE AS taken UNION ALL SELECT top.k, CASE WHEN used + cost <= 2048 THEN used + cost ELSE used END, top.id, used + cost <= 2048 FROM fit JOIN top ON top.k = fit.k + 1)
 SELECT row_number() OVER (ORDER BY top.k) - 1 AS place, top.id, score, cost FROM fit JOIN top USING (id) WHERE taken""",
    "q_budget_fit": f"""{G}, u AS (SELECT source_id AS id, count(*) AS c FROM e GROUP BY 1), s AS (SELECT n.repo, n.file_path, n.id, {SKEL} AS cost, row_number() OVER (PARTITION BY n.repo, n.file_path ORDER BY coalesce(u.c, 0) DESC, n.id) AS k FROM n LEFT JOIN u USING (id) WHERE {SYM}),
 fit AS (SELECT repo, file_path, 0::BIGINT AS k, 0::BIGINT AS used, []::BIGINT[] AS taken FROM (SELECT DISTINCT repo, file_path FROM s) UNION ALL
 SELECT s.repo, s.file_path, s.k, CASE WHEN used + cost <= 200 THEN used + cost ELSE used END, CASE WHEN used + cost <= 200 THEN list_append(taken, s.id) ELSE taken END FROM fit JOIN s ON s.repo = fit.repo AND s.file_path = fit.file_path AND s.k = fit.k + 1)
 SELECT repo, file_path, len(taken) AS n_taken, array_to_string(taken, ',') AS taken FROM fit QUALIFY row_number() OVER (PARTITION BY repo, file_path ORDER BY k DESC) = 1""",
    "q_tokenize": f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {code_tokens('text')} AS t FROM documents)",
    "q_bm25": f"WITH {bm25('SELECT doc_id AS doc, text FROM documents', 'SELECT item_id AS query, text FROM eval_items', 'b', 10)} SELECT query, doc, score, place FROM b",
    "q_cosine": f"WITH {cosine('c', 10)} SELECT query, doc, score, place FROM c",
    "q_rrf": f"""WITH {bm25('SELECT doc_id AS doc, text FROM documents', 'SELECT doc_id AS query, text FROM documents WHERE doc_id % 100 = 0', 'b', 30)}, {cosine('c', 30)},
 s AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + place)), 9) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY 1, 2) SELECT query, doc, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM s) WHERE place <= 10""",
    "q_hybrid": f"""{G}, s AS (SELECT * FROM n WHERE kind IN ('CHUNK', 'FUNCTION', 'CLASS', 'METHOD')), asked AS (SELECT id AS query, name AS text FROM s WHERE id % 100 = 0 AND name IS NOT NULL),
 {bm25("SELECT id AS doc, coalesce(nullif(skeleton, $$$$), nullif(full_body, $$$$), nullif(name, $$$$)) AS text FROM s", "SELECT query, text FROM asked", "a", 30)}, {dense("SELECT id AS doc, coalesce(nullif(skeleton, $$$$), nullif(full_body, $$$$), nullif(name, $$$$)) AS text FROM s", "SELECT query, text FROM asked", "b", 30)},
 m AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + place)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2), k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 30),
 u AS (SELECT source_id AS id, count(*) AS c FROM e GROUP BY 1),
 w AS (SELECT k.query, k.doc, round(k.score * CASE WHEN s.{SYM} AND len(list_filter(regexp_split_to_array(lower(asked.text), '\\s+'), lambda x: x <> '' AND contains(lower(s.name), x))) > 0 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END * (1 + least(coalesce(u.c, 0), 10) * 0.05::DOUBLE), 9) AS score FROM k JOIN asked USING (query) JOIN s ON s.id = k.doc LEFT JOIN u ON u.id = k.doc)
 SELECT query, doc, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM w) WHERE place <= 10""",
    "q_map_l0": f"""{G}, f AS (SELECT id, repo, {FOLDER} AS folder FROM n WHERE kind = 'FILE'), d AS (SELECT f.repo, f.folder, string_agg(DISTINCT t.name, ', ' ORDER BY t.name) AS names FROM e JOIN f ON f.id = e.source_id JOIN n t ON t.id = e.target_id WHERE e.kind = 'IMPORTS' GROUP BY 1, 2),
 s AS (SELECT f.repo, f.folder, string_agg(DISTINCT t.name, ', ' ORDER BY t.name) AS names FROM e JOIN f ON f.id = e.source_id JOIN n t ON t.id = e.target_id WHERE e.kind IN ('DECLARES', 'CONTAINS') AND t.{SYM} GROUP BY 1, 2), c AS (SELECT repo, folder, count(*) AS files FROM f GROUP BY 1, 2)
 SELECT c.repo, c.folder, files, coalesce(d.names, '') AS dependencies, coalesce(s.names, '') AS symbols FROM c LEFT JOIN d USING (repo, folder) LEFT JOIN s USING (repo, folder)""",
    "q_outline_l1": f"""{G}, p AS (SELECT x.source_id AS id, string_agg(shown, chr(10) ORDER BY x.target_id) AS body FROM (SELECT DISTINCT source_id, target_id FROM e WHERE kind IN ('DECLARES', 'CONTAINS')) x JOIN (SELECT id, coalesce(nullif(skeleton, ''), nullif(signature, '')) AS shown FROM n) t ON t.id = x.target_id WHERE shown IS NOT NULL GROUP BY 1),
 o AS (SELECT n.id, '── ' || n.name || ' ──' || CASE WHEN p.body IS NULL THEN '' ELSE chr(10) || p.body END AS outline FROM n LEFT JOIN p USING (id) WHERE n.kind = 'FILE') SELECT id, greatest(1, length(outline) // 4) AS tokens, md5(outline) AS digest FROM o""",
    "q_contract_l2": f"""{G}, {RESOLVED}, shown AS (SELECT id, coalesce(nullif(skeleton, ''), nullif(signature, ''), nullif(name, '')) AS shown, signature, docstring FROM n),
 c AS (SELECT x.source_id AS id, string_agg(DISTINCT shown, chr(10) ORDER BY shown) AS names FROM e x JOIN shown ON shown.id = x.target_id WHERE x.kind = 'CALLS' GROUP BY 1),
 b AS (SELECT r.name, r.id, CASE WHEN coalesce(docstring, '') <> '' AND coalesce(signature, '') <> '' AND NOT contains(shown, docstring) THEN signature || chr(10) || '    \"\"\"' || docstring || '\"\"\"' || chr(10) || '    ...' ELSE shown END AS base FROM resolved r JOIN shown USING (id)),
 o AS (SELECT b.name, b.id, base || CASE WHEN c.names IS NULL THEN '' ELSE chr(10) || chr(10) || '# Callee interfaces:' || chr(10) || c.names END AS contract FROM b LEFT JOIN c USING (id)) SELECT name, id, greatest(1, length(contract) // 4) AS tokens, md5(contract) AS digest FROM o""",
    "q_impl_l3": f"{G}, {RESOLVED}, b AS (SELECT r.name, r.id, coalesce(nullif(full_body, ''), nullif(skeleton, ''), nullif(n.name, '')) AS body FROM resolved r JOIN n ON n.id = r.id) SELECT name, id, greatest(1, length(body) // 4) AS tokens, md5(body) AS digest FROM b",
    "q_token_savings": f"{G} SELECT kind, sum({SKEL}) AS skeleton_tokens, sum({FULL}) AS full_tokens, CAST(floor((1 - sum({SKEL}) / sum({FULL})) * 100) AS BIGINT) AS saved_percent FROM n WHERE {SYM} GROUP BY kind",
    "q_top_symbols": f"{G} SELECT id, kind, name, {FULL} AS full_tokens FROM n WHERE {SYM} ORDER BY full_tokens DESC, {RANK}, id LIMIT 5",
    "q_zoom_metrics": f"{G} SELECT count(*) FILTER (kind = 'FILE') AS files, count(*) FILTER ({SYM}) AS symbols, sum({FULL}) FILTER ({SYM}) AS total_implementation_tokens, sum({SKEL}) FILTER ({SYM}) // greatest(1, count(*) FILTER ({SYM})) AS l2_average, sum({FULL}) FILTER ({SYM}) // greatest(1, count(*) FILTER ({SYM})) AS l3_average FROM n",
    "q_graph_export": f"{G} SELECT id, name, kind, CASE kind {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in COLOURS.items())} END AS color, CASE kind {' '.join(f'WHEN {quoted(k)} THEN {v}::DOUBLE' for k, v in SIZES.items())} END AS size, {FULL} AS tokens, coalesce(file_path, '') AS file_path, CASE WHEN kind = 'FILE' THEN 0 ELSE coalesce(start_line, 0) END AS line FROM n WHERE kind IN ('FILE', 'CLASS', 'FUNCTION', 'METHOD')",
    "q_graph_export_edges": f"{G} SELECT e.source_id, e.target_id, e.kind FROM e JOIN n ON n.id = e.source_id WHERE n.kind IN ('FILE', 'CLASS', 'FUNCTION', 'METHOD') AND (e.kind IN ('DECLARES', 'CALLS', 'CONTAINS', 'INHERITS') OR e.kind = 'IMPORTS' AND n.kind = 'FILE')",
    "q_benchmark_ratio": f"""{G}, s AS (SELECT repo, greatest(1, coalesce(sum(CASE WHEN kind = 'FILE' AND ends_with(lower(file_path), '.py') THEN length(full_body) ELSE 0 END), 0) // 4) AS read_tokens, coalesce(sum(CASE WHEN {SYM} AND ends_with(lower(file_path), '.py') THEN length(coalesce(skeleton, '')) ELSE 0 END), 0) // 4 AS outline_tokens FROM n WHERE repo IS NOT NULL GROUP BY repo)
 SELECT repo, read_tokens, outline_tokens, round((read_tokens - outline_tokens) / read_tokens * 100, 3) AS saved_percent FROM s""",
}
