"""Column expressions over names, paths and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language of each suffix.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust",
    ".java": "java", ".rb": "ruby", ".md": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml",
}

# Names and globs that a scan leaves out.
IGNORED = (".git", "__pycache__", "node_modules", ".venv", "venv", ".env", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache", "*.pyc", "*.pyo", "*.so", "*.dylib", "*.egg-info")

# Words that hint at a task, in the order in which ties are decided.
TASKS = {
    "EXPLORE": ("explore", "overview", "map", "structure", "what does", "show me"),
    "UNDERSTAND": ("understand", "how does", "explain", "what is", "why", "read"),
    "EDIT": ("edit", "change", "modify", "update", "fix", "implement", "add"),
    "DEBUG": ("debug", "error", "bug", "crash", "trace", "stack", "exception", "fail"),
    "REFACTOR": ("refactor", "reorganize", "move", "extract", "split", "migrate", "rename"),
    "REVIEW": ("review", "diff", "change", "pr", "pull request", "commit"),
}

# Words of complex and of middling requests, and the shares of a budget below each complexity.
COMPLEX = ("refactor", "migrate", "all", "across", "architecture", "design")
MIDDLING = ("fix", "bug", "error", "issue", "update", "change", "how does")
SHARES = ("architectural_map", "target_skeletons", "target_bodies", "neighbor_interfaces", "data_flow_context", "reserved")
SPLITS = ((0.3, (0.05, 0.30, 0.40, 0.15, 0.05, 0.05)), (0.7, (0.10, 0.25, 0.35, 0.20, 0.05, 0.05)), (2.0, (0.20, 0.30, 0.20, 0.15, 0.10, 0.05)))


def tokens(text: Column) -> Column:
    """Estimated tokens of a text: a quarter of its characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def filled(*columns: str | Column) -> Column:
    """The first of the columns that is neither null nor empty."""
    as_column = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.coalesce(*[F.when(c != "", c) for c in as_column])


def suffix(path: str | Column) -> Column:
    """Lower-cased suffix of a path with its dot, or an empty text. A name that only begins with
    a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def language(path: str | Column) -> Column:
    """Language by suffix, or null."""
    pairs = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return pairs[suffix(path)]


def ignored(path: str | Column, extra: tuple[str, ...] = ()) -> Column:
    """Whether any folder or the name of a relative path matches an ignore pattern. A trailing
    slash of a pattern is dropped; patterns that begin with ``!`` are not understood and skipped."""
    globs = [g.strip("/") for g in (*IGNORED, *extra) if g.strip("/") and not g.startswith(("!", "#"))]
    made = "|".join("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c for c in g) for g in globs)
    return F.coalesce(F.col(path) if isinstance(path, str) else path, F.lit("")).rlike(f"(^|/)({made})(/|$)")


def folder(path: str | Column) -> Column:
    """Folder of a path, ``.`` at the top."""
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(found != "", found).otherwise(F.lit("."))


def code_tokens(column: str) -> Column:
    """Distinct lower-case tokens of code: words split at case changes and underscores, compound
    words also as a whole, short parts only where they are usual names. Sorted."""
    parts = r"split(regexp_replace(regexp_replace(r,'([A-Z]+)',' $1'),'([A-Z][a-z]+)',' $1'),'\\s+|_')"
    whole = r"split(trim(regexp_replace(regexp_replace(r,'([A-Z]+)',' $1'),'([A-Z][a-z]+)',' $1')),'\\s+|_')"
    return F.expr(
        f"array_sort(array_distinct(flatten(transform(filter(split({column},'[^a-zA-Z0-9_]+'), r -> r<>''), r -> concat("
        f"if(length(r)>1 and size({whole})>1, array(lower(r)), cast(array() as array<string>)),"
        f"filter(transform({parts}, x -> lower(x)), x -> length(x)>=2 or x in ('i','j','k','n','x','y')))))))"
    )


def matched(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur in a text."""
    total = F.lit(0)
    for w in words:
        total = total + F.when(text.contains(w), 1).otherwise(0)
    return total


def task(text: Column) -> tuple[Column, Column]:
    """(task, score) of a request by the words that occur in it; the earlier task wins a tie and
    UNDERSTAND a request that names none."""
    low = F.lower(text)
    scores = {t: matched(low, w) for t, w in TASKS.items()}
    best = F.greatest(*scores.values())
    chosen = F.when(best == 0, "UNDERSTAND")
    for t, s in scores.items():
        chosen = chosen.when(s == best, t)
    return chosen, best


def complexity(text: Column) -> Column:
    """0.8, 0.5 or 0.2 by the words of a request."""
    low = F.lower(text)
    return F.when(matched(low, COMPLEX) > 0, F.lit(0.8)).when(matched(low, MIDDLING) > 0, F.lit(0.5)).otherwise(F.lit(0.2))


def budget_shares(total: Column, level: Column) -> list[Column]:
    """The six shares of a token budget, each cut to whole tokens."""
    out = []
    for i, name in enumerate(SHARES):
        share = None
        for bound, parts in SPLITS:
            value = F.floor(total * F.lit(parts[i])).cast("long")
            share = F.when(level < bound, value) if share is None else share.when(level < bound, value)
        out.append(share.alias(name))
    return out
