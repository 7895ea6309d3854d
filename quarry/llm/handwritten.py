"""Problem 3: generated, minified or vendored source files.

Method: Re-Pair grammars over token sequences, at three scopes.

* A file's own grammar over classed tokens. Its rules tell files that are one table; the grammar
  of its literals' characters, against that of the same characters shuffled, tells literals that
  no rule shortens (blobs); a grammar that needs neither layout nor names tells minified code; one
  of the code's structure that is a tenth of the code or less tells generated code without a notice.
* The corpus's grammar of comment lines at the outer level. A line that holds a rule used in
  several repositories is boilerplate; what a boilerplate line says (a tool's notice or a
  publisher's) is read once a line of that dictionary, not once a file. The names that publishers'
  lines give are symbols; a file that stands under such a symbol is the publisher's as well.
* The corpus's grammar of code. Ties are broken by content, so copies make the same rules wherever
  they stand; a file most of whose tokens lie under rules of other repositories is a copy.

Folders that package managers alone write are the only rule beside the grammars; README.md gives
the share of files that each cause decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.runtime import cut

TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|[^\w\s]")
WORD = re.compile(r"[A-Za-z_$][\w$]*")
LITERAL = re.compile(r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|(?<![\w.])-?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w.])", re.S)
COMMENT = re.compile(r"/\*.*?\*/|//[^\n]*|^[ \t]*#[^\n]*", re.S | re.M)
PYTHON_COMMENT = re.compile(r"(?m)^[ \t]*#[^\n]*")
NOTATION = re.compile(r"(?<![\w.])0[xX]|\\x|\\u00|[\s\"'`]")  # what writing a byte or a text as a literal adds
#: Encodings: what stands behind one may be as ordered as any text, so no grammar of its characters tells it from writing.
ENCODED = tuple(
    re.compile(r"(?:data:[^,]*,)?" + x)
    for x in (
        r"(?=.*\d)(?=.*[a-fA-F])(?:[0-9a-f]+|[0-9A-F]+)",
        r"(?=.*\d)(?=.*[A-Z])[A-Z2-7]+=*",
        r"(?=.*\d)(?=.*[a-z])(?=.*[A-Z])(?:[A-Za-z0-9+/]+=*|[A-Za-z0-9_-]+=*|[0-9A-Za-z!#$%&()*+;<=>?@^_`{|}~-]+)",
    )
)
NUMBER = re.compile(r"\d[\w.]*")
TABLE = re.compile(r"[\[({](?=[n:,]*0)[n0:,]*[\])}]")  # of a file's structure: a bracket of literals and names
ENTRY = re.compile(r"(?:n[n:]*=|[n0]:)0[;,]?")  # a name or key that is given a literal
OPENING = re.compile(r"\A(?:\ufeff|\s|#![^\n]*\n|'use strict';?|\"use strict\";?|/\*.*?\*/|//[^\n]*(?:\n|\Z)|#[^\n]*(?:\n|\Z)|--[^\n]*(?:\n|\Z)|<!--.*?-->)*", re.S)
OUTER = re.compile(r"^(?:#|//|<!--)[^\n]*|^/\*(?!\*).*?\*/", re.M | re.S)
SAID = re.compile(r"[^\W\d_]+|\d+|[@!©]")

# What lines of tools and publishers say, as lower-case words with every number as 0.
TOOL_LINE = re.compile(
    r"@ generated|\bauto generated\b(?! stub)|\b(?:this (?:file|code|module|source) (?:is|was|has been) |(?:file|code|source|machine|automatically) )(?:automatically |auto |machine )?(?:generated|created|emitted|produced|written)\b"
    r"|\b(?:generated|emitted) (?:by|from|with|using)\b|\bdo not (?:edit|modify|change)\b|\b(?:edits?|changes) (?:will be|are) (?:lost|overwritten)\b"
    r"|\b(?:maschinell|automatisch) (?:erzeugt|generiert|erstellt)\b|\bnicht (?:bearbeiten|von hand ändern|ändern)\b|\b(?:generado|creado|generada) (?:automáticamente|por)\b|\bno (?:editar|modificar)\b|\bg[ée]n[ée]r[ée] automatiquement\b|\bne pas modifier\b"
)
PUBLISHER_LINE = re.compile(
    r"\b(?:copied|taken|adapted|imported|mirrored|forked|vendored) from\b|\bupstream\b|\bvendored\b|\bredistribution (?:is )?permitted\b|(?:\b(?:c|copyright)|©) (?:0 )*(?:by )?(?:the )?[^\W\d]+ (?:project|authors|contributors|foundation|developers)\b|^! [^\W\d]+ (?:v )?0\b"
)
PUBLISHED_NAME = re.compile(r"^!? ?(?P<a>[^\W\d]{3,}) (?:v |version |release )?0\b|(?:\b(?:c|copyright)|©) (?:0 )*(?:by )?(?:the )?(?P<b>[^\W\d]{3,}) (?:project|authors|contributors|foundation|developers)\b")
MANAGED_FOLDER = re.compile(r"(?i)(?:^|/)(?:_?vendor|third[-_]?party|node_modules|bower_components|externs?|externals?|jspm_packages|pods|site-packages|(?:static|public|assets|www)/libs?)/")
#: Suffixes of documents and settings, which are not source: literals and density say nothing there.
DOCUMENTS = (".json", ".yaml", ".yml", ".toml", ".md", ".txt", ".cfg", ".ini", ".mk", ".rst", ".lock", ".csv", ".xml", ".html")

#: Evidence of a copy: tokens that must lie under shared rules, and their share of the file's.
COPIED_TOKENS, COPIED_PART = 64, 0.68
#: Shortest rule of code, in tokens, that counts as evidence; shorter ones are idioms.
CODE_SPAN = 12
#: Levels of a content-ordered grammar: rules span about 2.5 ** LEVELS tokens.
LEVELS = 4
#: Characters of literals from which their grammar can tell random from ordered ones.
LITERAL_CHARS = 256
#: A literal is near-incompressible when its grammar is at least this share of a shuffled one's. Of
#: 256 to 4,000 characters, random ones measure 0.98 or more, prose, lists and patterns 0.93 or less.
RANDOM = 0.95
#: Reuse from which code or a literal counts as written by a tool: its grammar is a tenth of it.
REPEATED = 0.9
#: Tokens that repeat side by side in units up to CODE_SPAN: lists of statements, which people write.
RUN = re.compile(rf"(.{{1,{CODE_SPAN}}}?)\1+")


def mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of pairs."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) if isinstance(b, np.ndarray) else a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b)
        x ^= x >> np.uint64(29)
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def alternate(chosen: np.ndarray, same_as_next: np.ndarray) -> np.ndarray:
    """Of runs of equal neighbouring pairs (aaaa), every other one."""
    if not len(chosen):
        return chosen
    start = np.ones(len(chosen), bool)
    start[1:] = ~same_as_next[:-1]
    at = np.arange(len(chosen))
    run = at - np.maximum.accumulate(np.where(start, at, 0))
    return chosen & (run % 2 == 0)


def repair(symbols: np.ndarray, owner: np.ndarray, files: int) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair over many sequences at once: (rules, symbols left) of each.

    A round counts the pairs of each sequence, takes those that occur twice or more and are at
    least as frequent as the pairs they overlap, and replaces them all. A sequence in which no pair
    was replaced is finished and leaves; the rounds end with the last one."""
    seq, own = symbols.astype(np.uint64), owner
    rules, left_over = np.zeros(files, np.int64), np.bincount(owner, minlength=files)
    while len(seq) > 1:
        inside = own[:-1] == own[1:]
        key = mix(mix(seq[:-1], seq[1:]), own[:-1].astype(np.uint64))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        often = np.where(inside, count[inverse], 0)
        rank = often.astype(np.float64) + (key >> np.uint64(12)).astype(np.float64) / 2.0**53
        left = np.concatenate([[-1.0], rank[:-1]])
        right = np.concatenate([rank[1:], [-1.0]])
        same = np.concatenate([key[:-1] == key[1:], [False]])
        chosen = alternate((often >= 2) & (rank >= left) & (rank >= right), same)
        chosen[1:] &= ~chosen[:-1]
        at = np.flatnonzero(chosen)
        used = np.bincount(inverse[at], minlength=len(count))
        at = at[used[inverse[at]] >= 2]
        if not len(at):
            break
        new_rules = np.unique(inverse[at], return_index=True)[1]
        rules += np.bincount(own[at[new_rules]], minlength=files)
        left_over -= np.bincount(own[at], minlength=files)
        going = np.zeros(files, bool)
        going[own[at]] = True
        seq = seq.copy()
        seq[at] = key[at]
        keep = going[own]
        keep[at + 1] = False
        seq, own = seq[keep], own[keep]
    return rules, left_over


def shortened(symbols: np.ndarray, owner: np.ndarray, files: int) -> np.ndarray:
    """Share of each sequence that its Re-Pair grammar saves: its rules' reuse."""
    rules, left = repair(symbols, owner, files)
    return 1 - (2 * rules + left) / np.maximum(np.bincount(owner, minlength=files), 1)


def content_rules(hashes: np.ndarray, owner: np.ndarray, levels: int = LEVELS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, owner, tokens spanned, which are new rules) after each round of a pair grammar in
    which the pair whose hash is a local minimum is replaced: equal passages make equal rules in any
    file, and an edit changes only the rules around it."""
    seq, own, span = hashes, owner, np.ones(len(hashes), np.int64)
    for turn in range(2 * levels):
        if len(seq) < 2:
            return
        key = mix(seq[:-1], seq[1:])
        order = np.where(own[:-1] == own[1:], mix(key, turn + 1) >> np.uint64(1), np.uint64(2**63))
        left = np.concatenate([[np.uint64(2**64 - 1)], order[:-1]])
        right = np.concatenate([order[1:], [np.uint64(2**64 - 1)]])
        same = np.concatenate([order[:-1] == order[1:], [False]])
        chosen = alternate((order < np.uint64(2**63)) & (order <= left) & (order <= right), same)
        chosen[1:] &= ~chosen[:-1]
        at = np.flatnonzero(chosen)
        seq, span, new = seq.copy(), span.copy(), np.zeros(len(seq), bool)
        seq[at] = key[at]
        span[at] += span[at + 1]
        new[at] = True
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, own, span, new = seq[keep], own[keep], span[keep], new[keep]
        yield seq, own, span, new


def portions(batches: Iterator[pd.DataFrame], column: str, most: int = 3_000_000) -> Iterator[pd.DataFrame]:
    """The batches in parts of about ``most`` characters, so that arrays over all tokens of a part
    stay small however long the texts of a batch are."""
    for batch in batches:
        start = total = 0
        for i, n in enumerate(batch[column].str.len()):
            if total and total + n > most:
                yield batch.iloc[start:i]
                start, total = i, 0
            total += n
        if start < len(batch):
            yield batch.iloc[start:]


def outer_lines(text: str) -> list[str]:
    """The comment lines before the first code and at the outer level, as words: lower case, every
    number as 0. Each once."""
    head = OPENING.match(text)
    found = head.group() + "\n" + "\n".join(m.group() for m in OUTER.finditer(text, head.end()))
    said = (SAID.findall(line) for line in found.lower().split("\n"))
    return list(dict.fromkeys(" ".join("0" if w.isdigit() else w for w in words) for words in said if words))


def line_rules(lines: list[str]) -> list[list[int]]:
    """The rules of each comment line: its pairs and what they join to, and the line as a whole."""
    words = [line.split(" ") for line in lines]
    owner = np.repeat(np.arange(len(lines)), [len(w) for w in words])
    out = [[int(x)] for x in pd.util.hash_array(np.array(lines, dtype=object)).view(np.int64)] if lines else []
    if len(owner):
        for seq, own, _, new in content_rules(pd.util.hash_array(np.array([w for x in words for w in x], dtype=object)), owner):
            for rule, line in zip(seq[new].view(np.int64).tolist(), own[new].tolist(), strict=True):
                out[line].append(rule)
    return out


def characters(text: str) -> np.ndarray:
    """The characters of a text as symbols of a grammar."""
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def literal_grammar(literal: str) -> np.ndarray:
    """Sizes of the Re-Pair grammars of a literal's characters and of the same in a random order."""
    codes = characters(literal)
    mixed = np.random.default_rng(0).permutation(codes)
    rules, left = repair(np.concatenate([codes, mixed]), np.repeat([0, 1], len(codes)), 2)
    return 2 * rules + left


def incompressible(literal: str) -> bool:
    """Whether the Re-Pair grammar of a literal's characters is about as large as that of the same
    characters in a random order."""
    size = literal_grammar(literal)
    return len(literal) >= LITERAL_CHARS and bool(size[0] >= RANDOM * size[1])


def blob(literals: list[str]) -> bool:
    """Whether literals are bytes or encoded text: their grammar is near-incompressible, or it is that
    of one literal without white space and a tenth of it, or they are all of one encoding."""
    body = NOTATION.sub("", " ".join(literals))
    if len(body) < LITERAL_CHARS:
        return False
    size = literal_grammar(body)
    whole = len(literals) == 1 and not any(c.isspace() for c in literals[0])
    return bool(size[0] >= RANDOM * size[1] or whole and size[0] <= (1 - REPEATED) * len(body)) or any(x.fullmatch(body) for x in ENCODED)


def bare_code(text: str, path: str) -> str:
    """A file's code without comments, every literal as 0; nothing of documents."""
    if path.lower().endswith(DOCUMENTS):
        return ""
    return (PYTHON_COMMENT if path.lower().endswith(".py") else COMMENT).sub("", LITERAL.sub("0", text))


def structure(code: str) -> str:
    """A character for each token of code: n for names, 0 for literals, marks as they are. Tables of
    literals are one literal, and what only gives a name a literal is left out: people write both."""
    kinds = "".join(NUMBER.sub("0", WORD.sub("n", code)).split())
    while len(less := TABLE.sub("0", kinds)) < 0.99 * len(kinds):  # a level of brackets each time; what deeper ones save doesn't weigh
        kinds = less
    return ENTRY.sub("", less)


def structural_reuse(structures: list[str]) -> np.ndarray:
    """Share of each structure that its Re-Pair grammar saves; 0 of an empty one."""
    sizes = np.array([len(x) for x in structures], np.int64)
    return np.where(sizes > 0, shortened(characters("".join(structures)), np.repeat(np.arange(len(sizes)), sizes), len(sizes)), 0.0)


def written_over(code: str, reuse: float) -> bool:
    """Whether a file's code is written over and over: its structure's grammar is a tenth of it, also
    when runs of short units, such as lists of calls, count once. ``reuse`` is that measured among
    other files, where ties fall otherwise; what comes near is measured again alone."""
    if reuse < REPEATED - 0.05:
        return False
    kinds = structure(code)
    return all(structural_reuse([x])[0] >= REPEATED for x in (kinds, RUN.sub(r"\1", kinds)))


def own_grammar(text: str, path: str, classes: np.ndarray, code: str | None = None, built: float | None = None) -> str:
    """``minified``, ``data`` or ``generated`` by the file's own grammar, or nothing. The file's bare
    code and its structure's reuse are measured here unless given."""
    if path.lower().endswith(DOCUMENTS) or not len(classes):
        return ""
    code = bare_code(text, path) if code is None else code
    built = structural_reuse([structure(code)])[0] if built is None else built
    words = WORD.findall(code)
    few = len(set(words)) <= 14
    short = len(words) >= 12 and sum(map(len, words)) <= 5 * len(words)
    if few:
        found = LITERAL.findall(text)
        size = lambda parts: sum(len("".join(x.split())) for x in parts)
        enough = 0.45 * size([text])
        reuse = shortened(classes, np.zeros(len(classes), np.int64), 1)[0]
        if size(x for x in found if x[0] not in "\"'`") >= enough and reuse >= 0.6:
            return "data"  # numbers only: a table is few rules, used over and over
        if size(found) >= enough and (len(words) <= 14 or reuse >= 0.6) and blob(found):
            return "data"
    if short and sum(c.isspace() for c in code) <= 0.12 * len(code) and sum(len(x) for x in code.split("\n") if len(x) > 120) >= 0.5 * len(code):
        names = np.array([c for c in TOKEN.findall(code)], dtype=object)
        kinds = pd.util.hash_array(np.array(["n" if WORD.fullmatch(x) else "0" if x[0].isdigit() else x for x in names], dtype=object))
        if shortened(kinds, np.zeros(len(kinds), np.int64), 1)[0] >= 0.3:
            return "minified"
    return "generated" if written_over(code, built) else ""


def tokenised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content hash, class for Re-Pair, owner) of every token of a batch of texts. Numbers and
    strings share a class each, so that tables repeat whatever their values."""
    flat: list[str] = []
    sizes = []
    for text in texts:
        found = TOKEN.findall(text)
        flat += found
        sizes.append(len(found))
    owner = np.repeat(np.arange(len(texts)), sizes)
    if not flat:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), owner
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    hashes = pd.util.hash_array(distinct)
    first = np.array([x[0] for x in distinct])
    classes = np.where(np.char.isdigit(first.astype(str)), np.uint64(1), np.where(np.isin(first, ['"', "'", "`"]), np.uint64(2), hashes))
    return hashes[codes], classes[codes], owner


FEATURES = (
    "repo string, relative_path string, verdict string, tokens long, rules array<long>, spans array<long>, "
    "lines array<struct<said string, rules array<long>>>, places array<string>"
)


def features(nodes: DataFrame) -> DataFrame:
    """(repo, relative_path, verdict, tokens, rules, spans, lines, places) of each FILE node: the
    verdict of its own grammar (empty where only others can tell), its rules of code with the tokens
    they span, its outer comment lines with their rules, and the names it stands under. Rows without
    repo, path or text are left out; a text of no tokens has no rules."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in portions(batches, "full_body"):
            texts, paths = batch["full_body"].tolist(), batch["file_path"].tolist()
            hashes, classes, owner = tokenised(texts)
            sizes = np.bincount(owner, minlength=len(texts))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            rule, own, span = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for rule, own, span, _ in content_rules(hashes, owner):  # noqa: B007
                pass
            big = span >= CODE_SPAN
            rule, own, span = rule[big].view(np.int64), own[big], span[big]
            cuts = np.searchsorted(own, np.arange(len(texts) + 1))
            codes = [bare_code(t, p) for t, p in zip(texts, paths, strict=True)]
            built = structural_reuse([structure(c) for c in codes])
            said = [outer_lines(t) for t in texts]
            flat = line_rules([x for lines in said for x in lines])
            at = np.concatenate([[0], np.cumsum([len(x) for x in said])]).astype(int)
            yield pd.DataFrame(
                {
                    "repo": batch["repo"].tolist(),
                    "relative_path": paths,
                    "verdict": [own_grammar(t, p, classes[a:b], c, r) for t, p, a, b, c, r in zip(texts, paths, ends[:-1], ends[1:], codes, built, strict=True)],
                    "tokens": sizes.astype("int64"),
                    "rules": [rule[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                    "spans": [span[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                    "lines": [[{"said": s, "rules": r} for s, r in zip(lines, flat[a:b], strict=True)] for lines, a, b in zip(said, at[:-1], at[1:], strict=True)],
                    "places": [list(dict.fromkeys(x.split(".")[0].lower() for x in p.split("/"))) for p in paths],
                }
            )

    files = nodes.where("kind = 'FILE' and repo is not null and file_path is not null and full_body is not null").select("repo", "file_path", "full_body")
    return files.mapInPandas(run, FEATURES)


KEY = ["repo", "relative_path"]


def shared(rules: DataFrame) -> DataFrame:
    """The rules (repo, rule) that occur in more than one repository. A rule that stands in very many
    files is combined map-side, two repository names a rule."""
    return rules.groupBy("rule").agg(F.min("repo").alias("first"), F.max("repo").alias("last")).where("first <> last").select("rule")


def boilerplate(seen: DataFrame) -> DataFrame:
    """(said, label, name): the dictionary of outer comment lines under a rule that several
    repositories share, with what a line says (``tool``, ``publisher``) and the name it gives."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            labels = ["tool" if TOOL_LINE.search(s) else "publisher" if PUBLISHER_LINE.search(s) else "" for s in batch["said"]]
            names = [(m.group("a") or m.group("b")) if x == "publisher" and (m := PUBLISHED_NAME.search(s)) else None for s, x in zip(batch["said"], labels, strict=True)]
            yield pd.DataFrame({"said": batch["said"].tolist(), "label": labels, "name": names})

    line = seen.select("repo", F.explode("lines").alias("x")).select("repo", F.col("x.said").alias("said"), F.col("x.rules").alias("rules"))
    entries = line.groupBy("said").agg(F.first("rules").alias("rules"))  # equal lines have equal rules
    common = shared(line.select("repo", F.explode("rules").alias("rule")))
    held = entries.select("said", F.explode("rules").alias("rule")).join(common, "rule", "left_semi").select("said").distinct()
    return held.mapInPandas(read, "said string, label string, name string").where("label <> ''")


def not_handwritten(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, relative_path, verdict, decided_by) of each file of ``files`` that nobody wrote by
    hand; where several causes hold, the first of: the file's own grammar, a notice, the publisher's
    name, rules of other repositories, a package manager's folder.

    Distinct files; a file without a FILE node or with a null key is left out. Of a rule only
    partial aggregates and keys are exchanged, and rows are joined back by rule or line, where AQE
    splits hot keys."""
    seen = cut(features(nodes))  # read by each scope below
    own = seen.where("verdict <> ''").select(*KEY, "verdict", F.lit("1 own grammar").alias("by"))

    words = F.split(F.lower("repo"), "[^a-z0-9]+")
    labelled = cut(seen.select(*KEY, F.explode("lines.said").alias("said")).join(boilerplate(seen), "said").where(F.col("name").isNull() | ~F.array_contains(words, F.col("name"))))
    notices = labelled.select(*KEY, F.when(F.col("label") == "tool", "generated").otherwise("vendored").alias("verdict"), F.lit("2 notice").alias("by"))

    under = seen.select(*KEY, F.explode("places").alias("name")).where(~F.array_contains(words, F.col("name")))
    named = labelled.where("name is not null").select("repo", "name").distinct()
    known = named.withColumn("given", F.lit(1)).unionByName(under.select("repo", "name").withColumn("given", F.lit(0)))
    symbols = known.groupBy("name").agg(F.max("given").alias("given"), F.min("repo").alias("first"), F.max("repo").alias("last")).where("given = 1 and first <> last").select("name")
    placed = under.join(symbols, "name", "left_semi").select(*KEY, F.lit("vendored").alias("verdict"), F.lit("3 publisher").alias("by"))

    rules = seen.select(*KEY, F.explode(F.arrays_zip("rules", "spans")).alias("x")).select(*KEY, F.col("x.rules").alias("rule"), F.col("x.spans").alias("span"))
    per_file = rules.groupBy("rule", *KEY).agg(F.sum("span").alias("span"))
    covered = per_file.join(shared(rules), "rule", "left_semi").groupBy(*KEY).agg(F.sum("span").alias("covered")).where(F.col("covered") >= COPIED_TOKENS)
    copies = covered.join(seen.select(*KEY, "tokens"), KEY).where(F.col("covered") >= COPIED_PART * F.col("tokens")).select(*KEY, F.lit("vendored").alias("verdict"), F.lit("4 copy").alias("by"))

    managed = seen.where(F.col("relative_path").rlike(MANAGED_FOLDER.pattern)).select(*KEY, F.lit("vendored").alias("verdict"), F.lit("5 folder").alias("by"))
    every = own.unionByName(notices).unionByName(placed).unionByName(copies).unionByName(managed)
    first = every.groupBy(*KEY).agg(F.min(F.struct("by", "verdict")).alias("x")).select(*KEY, F.col("x.verdict").alias("verdict"), F.substring("x.by", 3, 20).alias("decided_by"))
    return first.join(files.select(*KEY).distinct(), KEY, "left_semi")
