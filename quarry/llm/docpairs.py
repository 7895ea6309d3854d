"""Problem 4: functions paired with their documentation.

Method: a lexer that knows strings, templates, regular expressions and comments walks each
function's text, matches brackets to find where its body begins and ends, and takes as its
documentation the comment right before it, the first comment of its body (JavaScript and
TypeScript) or its docstring (Python). A comment that stands before a function only in the
text of its file is found by lexing the file and joined by line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRACED = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".java", ".go")
NEXT = re.compile(r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)|(?P<template>`)|(?P<slash>/)|(?P<mark>[{}()\[\]]|=>)", re.S)
INSIDE_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+", re.S)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
WORD_BEFORE = re.compile(r"[\w$]+$")
OPERATORS = frozenset("return typeof case in of do else void delete throw new instanceof yield await".split())


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


def script_tokens(text: str, at: int = 0) -> Iterator[Token]:
    """Comments, strings, templates (whole, whatever their expressions hold), regular expressions,
    brackets and arrows of a brace language from an offset on. A slash begins a regular expression
    unless an operand stands before it; an unclosed template ends with the text."""
    templates: list[int] = []  # depth of braces in each open template's expression
    began = 0
    while m := NEXT.search(text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "slash":
            before = text[max(0, m.start() - 200) : m.start()].rstrip()
            word = WORD_BEFORE.search(before)
            operand = word.group() not in OPERATORS if word else before[-1:] in (")", "]", "}", '"', "'", "`")
            found = None if operand else REGEX.match(text, m.start())
            if found:
                at = found.end()
                if not templates:
                    yield Token("regex", found.group(), m.start(), at)
            continue
        closing = False
        if kind == "mark" and templates:
            c = m.group()
            templates[-1] += (c == "{") - (c == "}")
            closing = templates[-1] < 0
        if kind == "template" or closing:
            if closing:
                templates.pop()
            elif not templates:
                began = m.start()
            at = INSIDE_TEMPLATE.match(text, at).end()
            if text.startswith("${", at):
                templates.append(0)
                at += 2
                continue
            at = min(len(text), at + 1)
            if not templates:
                yield Token("string", text[began:at], began, at)
        elif not templates:
            yield Token(kind, m.group(), m.start(), at)


PYTHON = re.compile(
    r"(?P<comment>\#[^\n]*)"
    r"|(?P<string>(?P<prefix>[rRuUbBfF]{0,2})(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'))"
    r"|(?P<mark>[{}()\[\]:])",
    re.S,
)
PYTHON_HEAD = re.compile(r"\b(?:def|class)\b")
PYTHON_DOC = re.compile(r"(?:[ \t\r]*+(?:\#[^\n]*+)?\n)*+[ \t]*+([rRuU]?)(\"\"\"(.*?)\"\"\"|'''(.*?)'''|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)')", re.S)


def python_docstring(text: str) -> tuple[str, int]:
    """The docstring of the first function in a text, and the offset at which its body begins."""
    head = PYTHON_HEAD.search(text)
    if not head:
        return "", 0
    depth = 0
    for m in PYTHON.finditer(text, head.end()):
        c = m.group("mark")
        if c in ("(", "[", "{"):
            depth += 1
        elif c in (")", "]", "}"):
            depth -= 1
        elif c == ":" and depth == 0:
            doc = PYTHON_DOC.match(text, m.end())
            return (next((g for g in doc.groups()[2:] if g is not None), "") if doc else ""), m.end()
    return "", len(text)


def script_comments(text: str) -> tuple[str, str, int, int]:
    """Of a brace-delimited function: the comment before it, the first comment of its body, and
    the offsets of its body's braces. An unclosed body ends with the text."""
    before: list[str] = []
    depth, body, inner, arrow, last = 0, -1, [], False, 0
    for m in script_tokens(text):
        gap = text[last : m.start].strip()
        first_token, last = last == 0 and not gap, m.end
        if m.kind == "comment":
            if body >= 0 and not gap and depth == 1 and inner is not None:
                inner.append(m.text)
            elif body < 0 and first_token or (body < 0 and before and not gap and depth == 0 and not arrow):
                before.append(m.text)
            continue
        if body >= 0:
            if gap or inner is not None:
                first, inner = inner, None
                if first:
                    doc = first
                    return "\n".join(before), "\n".join(doc), body, closing(text, body)
            return "\n".join(before), "", body, closing(text, body)
        c = m.text if m.kind == "mark" else None
        if c == "=>":
            arrow = True
        elif c in ("(", "["):
            depth += 1
        elif c in (")", "]"):
            depth -= 1
        elif c == "{":
            before_brace = text[: m.start].rstrip()
            if depth == 0 and (before_brace.endswith((")", "=>")) or not before_brace.endswith((":", "=", "<", ",", "|", "&"))):
                body, depth, inner = m.start, 1, []
            else:
                depth += 1
        elif c == "}":
            depth -= 1
    return "\n".join(before), "\n".join(inner or []), body, len(text)


def closing(text: str, opening: int) -> int:
    """Offset after the brace that matches the one at ``opening``; the text's end if none does."""
    depth = 0
    for m in script_tokens(text, opening):
        if m.text == "{":
            depth += 1
        elif m.text == "}":
            depth -= 1
            if depth == 0:
                return m.end
    return len(text)


# Wording of tool directives, fillers and promises.
DIRECTIVE = re.compile(r"(?i)^(?:eslint|tslint|jshint|jslint|prettier|istanbul|c8|webpack|@ts-|ts-|@flow|@jsx|noqa|type:\s*ignore|pylint|flake8|mypy|pragma|fmt:|isort|yapf|nosec|nolint|go:|sourceMappingURL|#?region|#?endregion|global\s|globals\s|!?/)")
FILLER = re.compile(
    r"(?i)(?:(?:todo|fixme|xxx|tbd|tba|hack|wip|n/?a|none|null|see above|see below|ditto|description|constructor|destructor|summary|docstring|placeholder|missing|empty|undocumented"
    r"|no (?:doc|docs|documentation|description|docstring|comment)s?(?: yet| available)?)[\s.!]*+$|to be (?:done|documented|added|written)|lorem ipsum|auto[- ]?generated (?:stub|method|function|doc|comment)|(?:todo|fixme|xxx|tbd|hack)\b|(?:coming|more) (?:soon|later))"
)
# Promises of later documentation: what begins them, and what must follow.
PROMISES = tuple(
    (re.compile("(?i)" + a), re.compile("(?i)" + b))
    for a, b in (
        (r"(?:the )?(?:documentation|docs?|description|docstring|comment)s?\b", r"\b(?:will|shall|to|soon|later|follow\w*|pending|missing)\b"),
        (r"(?:please )?(?:fill|write|add|insert|put)\b", r"\b(?:description|documentation|docs?|docstring|comment|here)\b"),
    )
)
LATER = re.compile(r"(?i)\bfill in the description\b|\bwill be (?:added|documented|written|described)\b(?=[^\n]*\b(?:later|soon|release|future|version)\b)")
#: Most words of a promise; a longer text says more than that documentation will come.
PROMISED = 40


def filler(line: str) -> bool:
    """Whether a line says nothing, or only that documentation is to come."""
    if FILLER.match(line):
        return True
    if len(WORDS.findall(line)) > PROMISED:
        return False
    return bool(LATER.search(line)) or any((m := begin.match(line)) and then.search(line, m.end()) for begin, then in PROMISES)


TAG = re.compile(r"^(?:[@\\](?:param|arg|argument|returns?|type|throws|exception|template|property|prop|yields?|see|since|author|deprecated|private|public|protected|override|static|async|function|method|class|constructor|memberof|name|example)\b|:(?:param|parameter|arg|type|returns?|rtype|raises?|yields?|var)\b[^:]*:)", re.I)
SECTION = re.compile(r"^(?:args|arguments|params|parameters|returns?|raises|yields|throws|attributes|examples?|usage)\s*:?\s*$", re.I)
SECTION_LINE = re.compile(r"^(?:args|arguments|params|parameters|returns?|raises|yields|throws)\s*:", re.I)
COMMAND = re.compile(r"(?:curl|wget|pip|npm|\$)\s")
STATEMENT = re.compile(r"(?:const|let|var|return|import|from|def|class|if|for|while|elif|else|try|except|export|function|async|await|del|assert|raise|throw|print)\b(?=[^\n]*[()\[\]{}=:;])")
PLAIN_CODE = re.compile(r"[\w.\[\]'\"]++\s*+[-+*/|&]?=\s*+\S|[\w.]++\([^()]*+\);?\s*+$|[\])}]++[,;]?$")


def code(line: str) -> bool:
    """Whether a line is a statement that was commented out, however long."""
    return line.rstrip()[-1:] in (";", "{", "}") and bool(line.strip()) or bool(COMMAND.match(line) or STATEMENT.match(line) or PLAIN_CODE.match(line))


WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
HOLLOW = frozenset("this is the a an function method class constructor of for it its that procedure routine helper does do".split())


def clean(raw: str | None) -> str:
    """Documentation without comment marks, directives, fillers, commented-out code and
    parameter lists; empty for null, blank or trivial text. Sentences keep their line breaks."""
    if not raw or not raw.strip():
        return ""
    lines, skipping, example = [], False, False
    for line in raw.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        was_code_comment = line.lstrip().startswith("//")
        line = re.sub(r"^\s*(?:/\*+!?|\*+/|//+!?|\#+|\*(?!\*))?", "", line)
        line = re.sub(r"\*+/\s*$", "", line).strip()
        line = re.sub(r"^[rRuU]?(?:\"\"\"|''')|(?:\"\"\"|''')$", "", line).strip()
        bare = line.strip("-=*_#~. \t")
        if not bare:
            if skipping and not line:
                skipping = False
            continue
        if TAG.match(line) or SECTION.match(line) or SECTION_LINE.match(line):
            skipping = True
            continue
        if skipping or DIRECTIVE.match(line) or filler(bare):
            continue
        if code(line) and (was_code_comment or not line.endswith(".")):
            continue
        lines.append(line)
    return "\n".join(lines)


def substantial(doc: str, name: str | None) -> bool:
    """Whether some sentence says at least three words more than the function's name."""
    own = {p.lower() for p in PARTS.findall(name or "")} | {(name or "").lower()}
    for sentence in re.split(r"(?<=[.!?:])\s+|\n\n", doc):
        words = [w.lower() for w in WORDS.findall(sentence)]
        if sum(w not in own and w not in HOLLOW for w in words) >= 3:
            return True
    return False


def documentation(path: str | None, name: str | None, body: str | None, docstring: str | None) -> str:
    """The clean documentation of one function, or an empty text."""
    body = body or ""
    if (path or "").lower().endswith(BRACED):
        before, first, _, _ = script_comments(body)
        sources = (before, first, docstring)
    else:
        sources = (python_docstring(body)[0], docstring)
    for raw in sources:
        doc = clean(raw)
        if doc and substantial(doc, name):
            return doc
    return ""


def comment_blocks(text: str) -> list[tuple[int, str]]:
    """(line after it, comment) of each run of comments in a brace language that a line of code
    follows at once."""
    out: list[tuple[int, str]] = []
    run: list[str] = []
    line, at, last = 1, 0, 0
    for m in script_tokens(text):
        if m.kind != "comment":
            if run:
                out.append((line, "\n".join(run)))
                run = []
            continue
        if run and text[last : m.start].strip():
            out.append((line, "\n".join(run)))
            run = []
        alone = not text[text.rfind("\n", 0, m.start) + 1 : m.start].strip()
        line += text.count("\n", at, m.end) + 1
        at = m.end
        # the break that ends the comment's own line was counted in advance
        nl = text.find("\n", m.end)
        at = len(text) if nl < 0 else nl + 1
        last = m.end
        if alone:
            run.append(m.text)
    if run:
        out.append((line, "\n".join(run)))
    return out


def suffix_is(column: str, suffixes: tuple[str, ...]) -> F.Column:
    """Whether a path ends with one of the suffixes, whatever its case."""
    return F.lower(F.col(column)).rlike(r"\.(?:" + "|".join(s[1:] for s in suffixes) + ")$")


def documented(nodes: DataFrame, with_code: bool = True) -> DataFrame:
    """(node_id, signature, documentation[, full_body]) of each FUNCTION and METHOD node whose
    documentation has substance; one row an id.

    Null texts count as empty, a null name as no words, a null path as Python; nodes with a null
    id are left out. Most nodes are settled from their own row. Those of brace languages without
    a comment of their own are joined, by repository, path and line, with the comments that stand
    before that line in the FILE node's text; only comments are shuffled, never texts of files."""
    own = ["id", "name", "repo", "file_path", "start_line", "signature", "full_body", "docstring"]
    functions = nodes.where("kind in ('FUNCTION', 'METHOD') and id is not null").select(*own)
    keep = ["id", "name", "repo", "file_path", "start_line", "signature"] + (["full_body"] if with_code else [])
    schema = "id long, name string, repo string, file_path string, start_line int, signature string" + (", full_body string" if with_code else "") + ", documentation string"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keep].copy()
            out["documentation"] = [documentation(*row) for row in zip(batch["file_path"], batch["name"], batch["full_body"], batch["docstring"], strict=True)]
            out["start_line"] = out["start_line"].astype("Int32")
            yield out

    read_rows = functions.mapInPandas(read, schema)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (repo, path, line, doc)
                for repo, path, text in zip(batch["repo"], batch["file_path"], batch["full_body"], strict=True)
                for line, raw in comment_blocks(text)
                if (doc := clean(raw)).count(" ") >= 2
            ]
            yield pd.DataFrame(rows, columns=["repo", "file_path", "start_line", "doc_before"]).astype({"start_line": "int32"})

    files = nodes.where("kind = 'FILE' and full_body is not null").where(suffix_is("file_path", BRACED)).select("repo", "file_path", "full_body")
    before = files.mapInPandas(blocks, "repo string, file_path string, start_line int, doc_before string")
    before = before.groupBy("repo", "file_path", "start_line").agg(F.min("doc_before").alias("doc_before"))
    open_rows = F.when((F.col("documentation") == "") & suffix_is("file_path", BRACED), F.col("start_line"))
    joined = read_rows.withColumn("start_line", open_rows).join(before, ["repo", "file_path", "start_line"], "left")

    @F.pandas_udf("boolean")
    def has_substance(docs: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([bool(d) and substantial(d, n) for d, n in zip(docs, names, strict=True)])

    settled = joined.withColumn("documentation", F.when(F.col("documentation") != "", F.col("documentation")).otherwise(F.col("doc_before")))
    settled = settled.where("documentation is not null").where((F.col("doc_before").isNull()) | has_substance("documentation", "name"))
    out = ["signature", "documentation"] + (["full_body"] if with_code else [])
    if not with_code:
        return settled.select(F.col("id").alias("node_id"), *out).dropDuplicates(["node_id"])
    return settled.select(F.col("id").alias("node_id"), *out).dropDuplicates(["node_id"])


def documented_ids(nodes: DataFrame) -> DataFrame:
    """Distinct node_id of the nodes that ``documented`` gives."""
    return documented(nodes, with_code=False).select("node_id")
