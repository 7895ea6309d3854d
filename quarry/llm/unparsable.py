"""Problem 6: source files that do not parse in the language of their suffix.

Method: bundled grammars become predictive parse tables; each file's token stream is parsed
fully and the line of the first error it can't get past is reported. Python, JSON and TOML files
that the tables reject are read once more by the standard library's parser, which may acquit.
"""

from __future__ import annotations

import ast
import json
import tomllib
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.syntax import grammars, lexers
from quarry.llm.syntax.table import Grammar, Parser

# The language of each suffix.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".go": "go", ".java": "java", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml",
}
GRAMMARS = {
    "python": grammars.PYTHON, "javascript": grammars.JAVASCRIPT, "typescript": grammars.TYPESCRIPT, "go": grammars.GO,
    "java": grammars.JAVA, "json": grammars.JSON, "yaml": grammars.YAML, "toml": grammars.TOML,
}
COMMENT_ONLY_EMPTY = frozenset({"go", "java", "json"})


def strict_python(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
    return True


def strict_json(text: str) -> bool:
    def refuse(_: str) -> None:
        raise ValueError

    try:
        json.loads(text.lstrip("﻿"), parse_constant=refuse)
    except (ValueError, RecursionError):
        return False
    return True


def strict_toml(text: str) -> bool:
    try:
        tomllib.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


TOKENS = {
    "javascript": (lexers.JS_TOKEN, lexers.JS_KINDS), "typescript": (lexers.TS_TOKEN, lexers.JS_KINDS),
    "go": (lexers.GO_TOKEN, lexers.GO_KINDS), "java": (lexers.JAVA_TOKEN, lexers.JAVA_KINDS),
}
STRICT = {"python": strict_python, "json": strict_json, "toml": strict_toml}


class Checker:
    """Parsers of all languages; one a process."""

    def __init__(self) -> None:
        self.parsers: dict[str, Parser] = {}
        self.broken = lru_cache(maxsize=200_000)(lexers.broken_rule)

    def parser(self, language: str) -> Parser:
        if language not in self.parsers:
            self.parsers[language] = Parser(Grammar(GRAMMARS[language]))
        return self.parsers[language]

    def lines(self, text: str, suffix: str, language: str) -> tuple[list[str], list[int] | None]:
        if language == "python":
            return lexers.python_lines(text)
        if language in ("javascript", "typescript"):
            return lexers.script_lines(text, language == "typescript", suffix != ".ts"), None
        return {"go": lexers.go_lines, "java": lexers.java_lines, "json": lexers.json_lines, "toml": lexers.toml_lines, "yaml": lexers.yaml_lines}[language](text), None

    def first_error(self, text: str | None, suffix: str) -> int:
        """Line, from 1, of the first error; 0 for a valid text. Null, empty, blank and
        comment-only texts are valid; suffixes of no known language are never judged."""
        language = LANGUAGES.get(suffix)
        if language is None or not text or not text.strip("﻿ \t\r\n"):
            return 0
        lines, numbers = self.lines(text, suffix, language)
        if language in COMMENT_ONLY_EMPTY and not any(x.strip(" ;") for x in lines[:-1]) and lines[-1].strip() == "EOF":
            return 0
        at = self.parser(language).parse(lines)
        if at < 0 and language == "python":
            at = next((i for i, line in enumerate(lines) if ("=" in line or "AUG" in line or "**" in line) and self.broken(line)), -1)
        if at < 0:
            return 0
        if language in ("javascript", "typescript") and lexers.AFTER_CONDITION.search(text):
            if self.parser(language).parse(lexers.script_lines(text, language == "typescript", suffix != ".ts", patterns_follow=True)) < 0:
                return 0
        if language in STRICT and STRICT[language](text):
            return 0
        if language in TOKENS:
            return lexers.source_line(*TOKENS[language], text, at)
        return min(text.count("\n") + 1, max(1, numbers[at] if numbers else at + 1))


def judged(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, relative_path, language, error_line) for each distinct file; error_line is 0 where
    the file is valid or of no known language (language null). A file whose FILE node is missing
    or has a null text counts as empty. Files of a null repo or path are left out.

    Texts are parsed where they lie; only keys and verdicts are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        checker = Checker()
        for batch in batches:
            lines = [checker.first_error(text, suffix) for text, suffix in zip(batch["full_body"], batch["suffix"], strict=True)]
            yield pd.DataFrame({"repo": batch["repo"], "relative_path": batch["relative_path"], "error_line": lines})

    suffix = F.lower(F.regexp_extract("relative_path", r"(\.[^./\\]+)$", 1))
    texts = (
        nodes.where("kind = 'FILE' and repo is not null and file_path is not null and full_body is not null")
        .select("repo", F.col("file_path").alias("relative_path"), "full_body")
        .withColumn("suffix", suffix)
        .where(F.col("suffix").isin(list(LANGUAGES)))
    )
    wrong = texts.mapInPandas(run, "repo string, relative_path string, error_line long").where("error_line > 0").groupBy("repo", "relative_path").agg(F.max("error_line").alias("error_line"))
    language = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    listed = files.where("repo is not null and relative_path is not null").select("repo", "relative_path").distinct()
    return listed.join(wrong, ["repo", "relative_path"], "left").select("repo", "relative_path", language[suffix].alias("language"), F.coalesce("error_line", F.lit(0)).alias("error_line"))


def unparsable(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, relative_path) of the files that do not parse."""
    return judged(files, nodes).where("error_line > 0").select("repo", "relative_path")


def rates(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, language, files, unparsable, rate) over the files of known languages."""
    bad = F.sum(F.when(F.col("error_line") > 0, 1).otherwise(0))
    return judged(files, nodes).where("language is not null").groupBy("repo", "language").agg(F.count("*").alias("files"), bad.alias("unparsable"), F.round(bad / F.count("*"), 6).alias("rate"))
