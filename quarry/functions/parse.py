"""Symbols and imports of source texts: small per-row helpers behind ``mapInPandas``."""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_SCHEMA = (
    "repo string, file_path string, start_line int, end_line int, kind string, name string, language string, signature string, skeleton string, full_body string, "
    "enclosing_scope string, docstring string, token_count_skeleton int, token_count_full int"
)
IMPORT_SCHEMA = "repo string, file_path string, imported_module string, imported_names array<string>, is_relative boolean"
COLUMNS = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]


def estimate(text: str) -> int:
    return max(1, len(text) // 4)


def chunk(kind: str, name: str, lines: list[str], first: int, last: int, scope: str | None, signature: str, doc: str, skeleton: str | None = None) -> tuple:
    """(start, end, kind, name, signature, skeleton, body, scope, doc) of one symbol."""
    made = skeleton if skeleton is not None else signature + (f'\n    """{doc}"""' if doc else "") + "\n    ..."
    return first, last, kind, name, signature, made, "\n".join(lines[first - 1 : last]), scope, doc


def python_chunks(text: str) -> list[tuple]:
    """Classes, functions and methods in order. A function below any class is a METHOD of the
    nearest one. Where the text does not parse, definitions are found by indentation."""
    lines = text.replace("\r\n", "\n").split("\n")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return indented_chunks(lines)
    out: list[tuple] = []

    def walk(body: list[ast.stmt], scope: str | None) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                start = node.body[0].lineno
                head = "\n".join(lines[node.lineno - 1 : max(node.lineno, start - (start > node.lineno))])
                signature = head[: head.rfind(":") + 1].strip() if ":" in head else head.strip()
                doc = ast.get_docstring(node, clean=False) or ""
                kind = "CLASS" if isinstance(node, ast.ClassDef) else "METHOD" if scope else "FUNCTION"
                out.append(chunk(kind, node.name, lines, node.lineno, node.end_lineno or node.lineno, scope, one_head(signature), doc))
                walk(node.body, node.name if kind == "CLASS" else scope)
            else:
                for field in ("body", "orelse", "finalbody", "handlers"):
                    inner = getattr(node, field, None)
                    if isinstance(inner, list):
                        walk([x for x in inner if isinstance(x, ast.stmt)] or [y for x in inner if isinstance(x, ast.ExceptHandler) for y in x.body], scope)

    walk(tree.body, None)
    return out


def one_head(signature: str) -> str:
    """A header up to the colon that ends it, leaving out a body on the same line."""
    depth = 0
    for i, c in enumerate(signature):
        depth += (c in "([{") - (c in ")]}")
        if c == ":" and depth == 0:
            return signature[: i + 1].strip()
    return signature.strip()


DEFINITION = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)")


def indented_chunks(lines: list[str]) -> list[tuple]:
    """Definitions of a text that does not parse, each up to the next line that is indented no
    deeper."""
    out, classes = [], []
    for i, line in enumerate(lines):
        m = DEFINITION.match(line)
        if not m:
            continue
        width = len(m.group(1).expandtabs())
        end = i + 1
        while end < len(lines) and (not lines[end].strip() or len(lines[end].expandtabs()) - len(lines[end].expandtabs().lstrip()) > width):
            end += 1
        while end > i + 1 and not lines[end - 1].strip():
            end -= 1
        classes = [c for c in classes if c[0] < width]
        scope = classes[-1][1] if classes else None
        kind = "CLASS" if m.group(2) == "class" else "METHOD" if scope else "FUNCTION"
        out.append(chunk(kind, m.group(3), lines, i + 1, end, scope, one_head(line.strip()), ""))
        if kind == "CLASS":
            classes.append((width, m.group(3)))
    return out


SCRIPT_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?|(?<=[=(,:\[!&|?{};])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*", re.S)
SCRIPT_HEAD = re.compile(
    r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:(?P<class>(?:abstract[ \t]+)?class)[ \t]+(?P<cname>[\w$]+)|(?P<interface>interface)[ \t]+(?P<iname>[\w$]+)|(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<fname>[\w$]+)"
    r"|(?:const|let)[ \t]+(?P<vname>[\w$]+)[^=\n]*=[ \t]*(?:async[ \t]*)?(?:function\b|\([^\n]*\)[^=\n]*=>|[\w$]+[ \t]*=>)"
    r"|(?:(?:public|private|protected|static|async|get|set|readonly|override)[ \t]+)*\*?(?P<mname>[\w$#]+)[ \t]*\([^\n;]*\)[^;\n=]*\{)",
    re.M,
)
NOT_METHODS = frozenset("if for while switch catch function return with do else try".split())


def script_chunks(text: str, typed: bool) -> list[tuple]:
    """Classes, functions, arrow constants, methods and (typed) interfaces, found on a copy in which
    strings, comments and regular expressions are blanked, and delimited by matching braces."""
    text = text.replace("\r\n", "\n")
    documentation: list[tuple[int, int]] = []

    def blank(m: re.Match) -> str:
        if len(m.group()) > 4 and m.group().startswith("/**") and m.group().endswith("*/"):
            documentation.append(m.span())
        return re.sub(r"[^\n]", " ", m.group())

    bare = SCRIPT_TOKEN.sub(blank, text)
    lines = text.split("\n")
    out, classes = [], []
    for m in SCRIPT_HEAD.finditer(bare):
        name = m.group("cname") or m.group("iname") or m.group("fname") or m.group("vname") or m.group("mname")
        opening = bare.find("{", m.end() - 1 if m.group("mname") else m.end())
        line_end = bare.find("\n", m.end())
        arrow_value = m.group("vname") and (opening < 0 or (0 <= line_end < opening))
        if arrow_value:
            end = len(text) if line_end < 0 else line_end
            opening = end
        elif opening < 0:
            continue
        else:
            depth, end = 0, len(bare)
            for b in re.finditer(r"[{}]", bare[opening:]):
                depth += 1 if b.group() == "{" else -1
                if depth == 0:
                    end = opening + b.end()
                    break
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        first, last = bare.count("\n", 0, start) + 1, bare.count("\n", 0, max(start, end - 1)) + 1
        classes = [c for c in classes if c[1] >= start]
        scope = classes[-1][0] if classes else None
        if m.group("mname") and (name in NOT_METHODS or not scope):
            continue
        if m.group("iname") and not typed:
            continue
        signature = text[start:opening].strip().removesuffix("=>").strip()
        doc = leading_comment(text, opening + 1, start, documentation)
        kind = "CLASS" if m.group("cname") else "INTERFACE" if m.group("iname") else "METHOD" if m.group("mname") else "FUNCTION"
        skeleton = signature + ((" {\n    /** " + doc + " */\n    ...") if doc else " {\n    ...") if kind != "INTERFACE" else signature + " {\n    ..."
        out.append(chunk(kind, name, lines, first, last, scope if kind == "METHOD" else None, signature, doc, skeleton))
        if kind == "CLASS":
            classes.append((name, end))
    return out


def leading_comment(text: str, inside: int, before: int, documentation: list[tuple[int, int]]) -> str:
    """The first comment of a body, else the block comment right before it, without its marks.
    ``documentation`` has the spans of the text's documentation comments in order."""
    m = re.match(r"\s*(?:/\*\*(.*?)\*/|//([^\n]*))", text[inside:], re.S)
    if m:
        found = next(g for g in m.groups() if g is not None)
    else:
        last = bisect_right(documentation, before, key=lambda span: span[1]) - 1
        if last < 0 or not re.fullmatch(r"\s*(?:export\s+)?(?:default\s+)?", text[documentation[last][1] : before]):
            return ""
        found = text[documentation[last][0] + 3 : documentation[last][1] - 2]
    return "\n".join(x.strip().lstrip("*").strip() for x in found.strip().split("\n")).strip()


def chunks_of(files: DataFrame) -> DataFrame:
    """Symbols of files (repo, relative_path, language, content). Blank texts and languages other
    than Python, JavaScript and TypeScript give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for repo, path, language, text in zip(batch["repo"], batch["relative_path"], batch["language"], batch["content"], strict=True):
                found = python_chunks(text) if language == "python" else script_chunks(text, language == "typescript")
                rows += [(repo, path, a, b, kind, name, language, sig, skel, body, scope, doc, estimate(skel), estimate(body)) for a, b, kind, name, sig, skel, body, scope, doc in found]
            yield pd.DataFrame(rows, columns=COLUMNS).astype({c: "int32" for c in ("start_line", "end_line", "token_count_skeleton", "token_count_full")})

    wanted = files.where(F.col("language").isin("python", "javascript", "typescript") & (F.trim("content") != "")).select("repo", "relative_path", "language", "content")
    return wanted.mapInPandas(run, CHUNK_SCHEMA)


PY_FROM = r"(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import"
PY_IMPORT = r"(?m)^[ \t]*import[ \t]+([\w.]+)"
JS_IMPORT = r"""(?:import|export)\s+[^'";]*?\s*from\s+['"]([^'"]+)['"]"""


def imported(files: DataFrame) -> DataFrame:
    """(repo, relative_path, module) of import statements, each once, by pattern: the language
    decides which. Texts stay in the JVM."""
    python = F.array_union(F.regexp_extract_all("content", F.lit(PY_FROM), F.lit(1)), F.regexp_extract_all("content", F.lit(PY_IMPORT), F.lit(1)))
    script = F.array_distinct(F.regexp_extract_all("content", F.lit(JS_IMPORT), F.lit(1)))
    modules = F.when(F.col("language") == "python", python).when(F.col("language").isin("javascript", "typescript"), script)
    return files.where("content is not null").select("repo", "relative_path", F.explode(modules).alias("module")).distinct()
