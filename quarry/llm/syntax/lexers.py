"""Lexers: a text becomes lines of token kinds for the table parsers.

Each language has one regular expression whose matches are all tokens; kinds are looked up by
the token's text. A character that begins no token becomes the kind ERR, which no grammar takes.
"""

from __future__ import annotations

import re

STRING = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'"
NUMBER = r"(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)"
WORD = r"[^\W\d][\w]*"


class Kinds(dict):
    """Kind by token text, filled as texts are met and emptied when it grows large."""

    def __init__(self, classify) -> None:
        super().__init__()
        self.classify = classify

    def __missing__(self, text: str) -> str:
        kind = self.classify(text)
        if len(text) < 60 and len(self) < 200_000:
            self[text] = kind
        return kind


def words(text: str) -> dict[str, str]:
    return {w: w for w in text.split()}


# --- Python -----------------------------------------------------------------------------------

HOLE = r"\{(?:[^{}\n]|\{[^{}\n]*\})*\}"  # an expression in a formatted string may use its quotes again
FORMATTED = "(?:[fFtT][rR]?|[rR][fFtT])(?:" + "|".join(rf"{q}(?!{q}{q})(?:[^{q}\\\n{{}}]|\\[\s\S]|\{{\{{|\}}\}}|{HOLE})*{q}" for q in "\"'") + ")"
PY_TOKEN = re.compile(
    r"\#[^\n]*|\\\r?\n|\r?\n[ \t\f]*|" + FORMATTED + r"|(?:[rRuUbBfFtT]{0,2})(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|" + STRING + r")"
    r"|" + WORD + r"|" + NUMBER + r"[jJ]?(?:\w+)?|\.\.\.|:=|->|\*\*=|//=|>>=|<<=|[-+*/%@&|^]=|==|!=|<=|>=|\*\*|//|<<|>>|[-+*/%@&|^~<>=.,:;()\[\]{}]|[^\s]",
)
PY_KEYWORDS = words("pass break continue del return raise from global nonlocal import as assert yield lambda if else or and not in is for async await while try except with def class finally elif") | {
    "None": "lit", "True": "lit", "False": "lit", "or": "or_", "else": "else",
}
PY_OPS = {op: op for op in "... := -> * / - + ** ~ . , : ; ( ) [ ] { } = @ |".split()} | {op: "BIN" for op in "// % << >> & ^ == != <= >= < >".split()} | {
    op: "AUG" for op in "**= //= >>= <<= -= += *= /= %= @= &= |= ^=".split()
}
PY_BAD_NUMBER = re.compile(NUMBER + r"[jJ]?(?:(?=(?:and|or|in|is|if|else|for|not)$))?")


def py_kind(t: str) -> str:
    c = t[0]
    if t in PY_KEYWORDS:
        return PY_KEYWORDS[t]
    if t in PY_OPS:
        return PY_OPS[t]
    if c in "\r\n":
        return "\n" + str(len(t.lstrip("\r\n").expandtabs(8)))
    if c == "#" or c == "\\" and len(t) > 1:
        return ""
    if t[-1] in "\"'" and len(t) > 1 and (c in "\"'" or t.rstrip("\"'") != t):
        return "str"
    if c.isdigit() or c == "." and len(t) > 1:
        return "num" if PY_BAD_NUMBER.fullmatch(t) and not re.match(r"0\d*[1-9]", t) else "ERR"
    if c.isidentifier():
        return "w:" + t if t in ("match", "case", "type") else "n"
    return "ERR"


PY_KINDS = Kinds(py_kind)
DEPTH = {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}


def python_lines(text: str) -> tuple[list[str], list[int]]:
    """Logical lines with their indentation turned into IN and DE, and their first line numbers."""
    flat = " ".join(map(PY_KINDS.__getitem__, PY_TOKEN.findall("\n" + text.lstrip("﻿") + "\n")))
    out: list[str] = []
    numbers: list[int] = []
    levels = [0]
    held, depth, line, began = "", 0, 0, 1
    for raw in flat.split("\n")[1:]:
        line += 1
        indent, _, body = raw.partition(" ")
        body = body.strip()
        if depth > 0:
            held += " " + body
        else:
            if not body:
                continue
            held, began = body, line
            width = int(indent)
            prefix = ""
            if width > levels[-1]:
                levels.append(width)
                prefix = "IN "
            else:
                while width < levels[-1]:
                    levels.pop()
                    prefix += "DE "
                if width != levels[-1]:
                    prefix += "ERR "
            out.append(prefix)
            numbers.append(began)
        if "(" in body or "[" in body or "{" in body or ")" in body or "]" in body or "}" in body:
            for t in body.split():
                depth += DEPTH.get(t, 0)
            if depth < 0:
                held += " ERR"
                depth = 0
        if depth == 0 and held:
            out[-1] += soft(held) + " NL"
            held = ""
    if held and out:
        out[-1] += held
    out.append("DE " * (len(levels) - 1) + "EOF")
    numbers.append(line)
    return out, numbers


OPENS, CLOSES = frozenset("([{"), frozenset(")]}")
NO_TARGET = frozenset("BIN - + / ~ ** and or_ or not in is if else yield await | @ := lambda num str lit ...".split())
PLAIN_STATEMENT = frozenset("n ( [ { * num str lit ... - + ~ yield".split())


def split_at(tokens: list[str], mark: str) -> list[list[str]]:
    """Parts of tokens between the marks outside of all brackets."""
    out: list[list[str]] = [[]]
    depth = 0
    for t in tokens:
        depth += DEPTH.get(t, 0)
        if t == mark and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return out


def assignable(tokens: list[str]) -> bool:
    """Whether something can be assigned to what the tokens say: names, attributes, items, and lists
    of such."""
    for part in split_at(tokens, ","):
        part = part[1:] if part[:1] == ["*"] else part
        if not part:
            continue
        top, depth = [], 0
        for t in part:
            depth -= t in CLOSES
            if depth == 0:
                top.append(t)
            depth += t in OPENS
        if top in (["(", ")"], ["[", "]"]):
            if not assignable(part[1:-1]):
                return False
        elif top[-1] in (")", "}") or top[-1] in NO_TARGET or len(top) > 1 and any(t in NO_TARGET and t not in ("num", "str", "lit", "...", "await") for t in top) or top[-1] == "]" and len(top) == 2:
            return False
    return True


def broken_rule(line: str) -> bool:
    """Whether a logical line of Python breaks a rule that its grammar leaves open: what can be
    assigned to, positional after named arguments, parameters without a default after such with one."""
    tokens = [t for t in line.split() if t not in ("IN", "DE", "NL")]
    if "=" in tokens or "AUG" in tokens:
        for part in split_at(tokens, ";"):
            while ":" in part and part[0] in ("if", "elif", "else", "for", "while", "try", "except", "finally", "with", "def", "class", "async", "CASE", "MATCH"):
                head = split_at(part, ":")
                part = [] if "lambda" in head[0] else part[len(head[0]) + 1 :]
            if part and part[0] in PLAIN_STATEMENT and "lambda" not in part:
                sides = split_at([("=" if t == "AUG" else t) for t in part], "=")
                sides = [split_at(sides[0], ":")[0], *sides[1:]]
                if not all(assignable(x) for x in sides[:-1]):
                    return True
    stack: list[tuple[str, int]] = []
    if "(" in tokens and ("=" in tokens or "**" in tokens):
        for i, t in enumerate(tokens):
            if t in OPENS:
                kind = ""
                if t == "(" and i:
                    named = tokens[i - 1] == "n" and i > 1 and tokens[i - 2] == "def"
                    kind = "params" if named else "args" if tokens[i - 1] in ("n", ")", "]") else ""
                stack.append((kind, i + 1))
            elif t in CLOSES and stack:
                kind, begin = stack.pop()
                if kind and bad_order(split_at(tokens[begin:i], ","), kind == "params"):
                    return True
    return False


def bad_order(parts: list[list[str]], parameters: bool) -> bool:
    given = False
    for part in parts:
        if not part or part[0] == "/":
            continue
        if part[0] in ("*", "**"):
            if parameters:
                return False  # after a star any order is right
            given = given or part[0] == "**"
        elif parameters and "=" in part or not parameters and part[:2] == ["n", "="]:
            given = True
        elif given:
            return True
    return False


NOT_SUBJECT = frozenset(": = . , ; ) ] } BIN AUG := @ | in is and or_ if".split())


def soft(line: str) -> str:
    """Settle the words that are keywords only where a statement begins with them."""
    if "w:" not in line:
        return line
    first, _, rest = line.partition(" ")
    second, _, after = rest.partition(" ")
    if first == "w:match" and rest.endswith(" :") and second not in NOT_SUBJECT:
        first = "MATCH"
    elif first == "w:case" and " :" in rest and second not in NOT_SUBJECT:
        first = "CASE"
    elif first == "w:type" and second in ("n", "w:match", "w:case") and after[:1] in ("=", "["):
        first = "TYPE"
    return (first + " " + rest if rest else first).replace("w:match", "n").replace("w:case", "n").replace("w:type", "n")


# --- JavaScript and TypeScript ----------------------------------------------------------------

JS_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`'\"]|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\[\s\S])*`|\{(?:[^{}]|\{[^{}]*\})*\})*\})*`"
JS_REGEX = r"(?:(?<=[(=,:\[!&|?{};+\n])|(?<=[(=,:\[!&|?{};+>] )|(?<=return )|(?<=[\n ]{2}))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
JS_TOKEN = re.compile(
    r"\A\#![^\n]*|//[^\n]*|/\*[\s\S]*?\*/|\n|" + STRING + "|" + JS_TEMPLATE + "|" + JS_REGEX + r"|\#?[^\W\d][\w$]*|\$[\w$]*|" + NUMBER + r"n?\w*"
    r"|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[-+*/%&|^]=|\*\*|<<|[-+*/%&|^~<>=.,:;()\[\]{}?!@]|[^\s]",
)
# Where a pattern after a closing parenthesis is not read as a division, as after a condition.
AFTER_CONDITION = re.compile(r"\)[ \t]*/(?![*/])")
TS_TOKEN = re.compile(JS_TOKEN.pattern.replace(r">>>=|", "").replace(r"|>>=", "").replace("|>=", ""))
JSX_TOKEN, TSX_TOKEN = (re.compile(p.pattern.replace("/(?![*/])", "/(?![*/>])")) for p in (JS_TOKEN, TS_TOKEN))
JS_KEYWORDS = words("if else for while do return throw break continue switch case default try catch finally debugger function class var const let new typeof void delete await yield in instanceof this super import export extends async") | {
    "null": "lit", "true": "lit", "false": "lit",
}
JS_OPS = {op: op for op in "... => * - + / % | & < > = ++ -- . , : ; ( ) [ ] { } ? ! ~ @ ?.".split()} | {
    op: "BIN" for op in "=== !== == != <= >= && || ?? ** << ^".split()
} | {op: "ASSIGN" for op in ">>>= **= <<= >>= &&= ||= ??= -= += *= /= %= &= |= ^=".split()}
JS_NUMBER = re.compile(NUMBER + "n?")


def js_kind(t: str) -> str:
    if t in JS_KEYWORDS:
        return JS_KEYWORDS[t]
    if t in JS_OPS:
        return JS_OPS[t]
    c = t[0]
    if c == "\n":
        return "\n"
    if c in "\"'" and len(t) > 1:
        return "str"
    if c == "`" and len(t) > 1:
        return "tmpl"
    if c == "/":
        if t[1] == "*":
            return "\n" if "\n" in t else ""
        return "" if t[1] == "/" else "regex"
    if c == "#":
        return "" if t[1:2] == "!" else "PRIV" if len(t) > 1 else "ERR"
    if c.isdigit() or c == "." and len(t) > 1:
        return "num" if JS_NUMBER.fullmatch(t) else "ERR"
    if c == "$" or c.isidentifier():
        return CONTEXT.get(t, "n")
    return "ERR"


# Words that are keywords only where the language expects them; settled by their neighbours.
CONTEXT = {w: "w:" + w for w in "of as from with is satisfies interface type enum declare namespace module abstract implements keyof readonly infer unique asserts get set static".split()}
JS_KINDS = Kinds(js_kind)
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
TYPE_TOKENS = frozenset("n . , [ ] | & str num lit { } : ; void this typeof => ( ) ? - w:keyof w:readonly w:is tmpl = extends w:infer w:unique new".split())


ENDS_OPERAND = frozenset("n num str tmpl regex lit this super ) ] } PRIV".split())


def settle_scripts(kinds: list[str], typed: bool) -> None:
    """An increment on a line of its own begins a statement; a constant without a value and a value
    assigned to a literal become errors, where no type or class can make them something else."""
    classes = typed or "class" in kinds
    last = ""
    for i, k in enumerate(kinds):
        if k in ("++", "--") and i and kinds[i - 1] == "\n" and last in ENDS_OPERAND:
            kinds[i] = "; " + k
        elif not typed and k == "const" and i + 1 < len(kinds) and kinds[i + 1] == "n" and following(kinds, i + 1) not in ("=", "of", "in", "w:of"):
            kinds[i] = "ERR"
        elif not classes and k == "=" and last in ("num", "str", "tmpl", "lit") and (i < 2 or kinds[i - 2] in ("\n", ";", "{", "}")):
            kinds[i] = "ERR"
        if k != "\n":
            last = k


def script_lines(text: str, typed: bool, embedded: bool, patterns_follow: bool = False) -> list[str]:
    """Physical lines of token kinds. Parentheses of arrow parameters, type arguments of calls
    and words that are keywords only in places are told apart by what stands around them. With
    ``patterns_follow`` a slash after a closing parenthesis begins a regular expression."""
    pattern = (TSX_TOKEN if typed else JSX_TOKEN) if embedded and "/>" in text else TS_TOKEN if typed else JS_TOKEN
    if patterns_follow:
        text = AFTER_CONDITION.sub(lambda m: ")\f  /", text)  # two blanks before a slash read as the start of one
    tokens = pattern.findall(text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿"))
    kinds = [k for k in map(JS_KINDS.__getitem__, tokens) if k]
    settle_scripts(kinds, typed)
    if "=>" in kinds:
        arrows(kinds, typed)
    if any(k[0] == "w" and k[:2] == "w:" for k in kinds):
        contextual(kinds, typed)
    if "<" in kinds:
        if embedded:
            markup(kinds)
        if typed:
            type_arguments(kinds)
    kinds.append("EOF")
    return " ".join(kinds).split("\n")


def following(kinds: list[str], i: int) -> str:
    i += 1
    while i < len(kinds) and kinds[i] == "\n":
        i += 1
    return kinds[i] if i < len(kinds) else "EOF"


def arrows(kinds: list[str], typed: bool) -> None:
    """Mark the parentheses whose closing one an arrow follows, with a return type between them
    in typed code."""
    ends = closers(kinds) if typed else {}
    stack: list[int] = []
    for i, k in enumerate(kinds):
        if k == "(":
            stack.append(i)
        elif k == ")" and stack:
            at = stack.pop()
            nxt = following(kinds, i)
            if nxt == "=>" or typed and nxt == ":" and returns_arrow(kinds, i + 1, ends):
                before = kinds[at - 1] if at else ""
                if before not in ("n", ")", "]") or before == "async":
                    kinds[at], kinds[i] = "(A", ")A"


def closers(kinds: list[str]) -> dict[int, int]:
    """Index of the closing bracket of each bracket that has one."""
    ends: dict[int, int] = {}
    stack: list[int] = []
    for i, k in enumerate(kinds):
        if k in ("(", "(A", "[", "{"):
            stack.append(i)
        elif k in (")", ")A", "]", "}") and stack:
            ends[stack.pop()] = i
    return ends


def returns_arrow(kinds: list[str], i: int, ends: dict[int, int]) -> bool:
    """Whether a return type follows the colon at ``i`` and then an arrow; what stands in brackets
    is passed over, however long."""
    depth, j = 0, i + 1
    while j < len(kinds):
        k = kinds[j]
        if k in ("(", "(A", "[", "{"):
            if j not in ends:
                return False
            j = ends[j]
        elif k == "<":
            depth += 1
        elif k in (")", ")A", "]", "}", ">"):
            depth -= 1
            if depth < 0:
                return False
        elif depth == 0 and k == "=>":
            return True
        elif k == ";" or depth == 0 and (k in ("=", ",", "EOF") or k not in TYPE_TOKENS and k != "\n"):
            return False
        j += 1
    return False


def contextual(kinds: list[str], typed: bool) -> None:
    n = len(kinds)
    for i, k in enumerate(kinds):
        if not k.startswith("w:"):
            continue
        word = k[2:]
        before = kinds[i - 1] if i else "\n"
        nxt = following(kinds, i)
        plain = nxt == "n" or nxt.startswith("w:")
        start = before in ("\n", ";", "{", "}", "export", "default", "DECLARE", "")
        new = "n"
        if word == "of" and before not in (".", "(", ",", "=") and (plain or nxt in ("[", "(", "{", "this", "new", "str", "lit", "tmpl", "await", "async")) and before in ("n", "]", "}", ">T", ">"):
            new = "of"
        elif word == "as" and before in ("n", ")", "]", "}", "str", "num", "*", "lit", "tmpl", "this", "default", ">T", "!") and (plain or nxt in ("{", "[", "const", "(", "lit", "str", "typeof", "void", "default", "w:keyof", "num", "any")):
            new = "as"
        elif word == "from" and nxt == "str":
            new = "from"
        elif word == "with" and before == "str":
            new = "with"
        elif typed:
            if word == "is" and before in ("n", "this") and (plain or nxt in ("lit", "{", "(", "str", "void")):
                new = "IS"
            elif word == "satisfies" and before in ("n", ")", "]", "}", "str", "num"):
                new = "SATISFIES"
            elif word == "interface" and start and plain:
                new = "INTERFACE"
            elif word == "type" and start and plain:
                new = "TYPE"
            elif word == "type" and (before in ("import", "{", ",", "export") and (plain or nxt == "{")):
                new = "TYPEWORD" if before != "import" else "n"
                if before == "import":
                    new = ""
            elif word == "enum" and (start or before == "const") and plain:
                new = "ENUM"
                if before == "const":
                    kinds[i - 1] = "SKIP"
            elif word == "declare" and start and (plain or nxt in ("function", "const", "let", "var", "class", "{")):
                new = "DECLARE"
            elif word in ("namespace", "module") and start and (plain or nxt == "str"):
                new = "NAMESPACE"
            elif word == "abstract" and start and nxt == "class":
                new = "ABS"
            elif word == "implements" and plain:
                new = "IMPL"
            elif word in ("keyof", "infer", "unique") and (plain or nxt in ("typeof", "(", "this")):
                new = "KEYOF"
            elif word == "readonly" and (nxt == "[" or plain) and before in (":", "|", "&", "<", ",", "(", "=", "=>"):
                new = "READONLY"
            elif word == "asserts" and plain:
                new = "KEYOF"
        kinds[i] = new if new else "n"
        if not new:  # import type {…}
            kinds[i] = "SKIP"
    if "SKIP" in kinds:
        kinds[:] = [k for k in kinds if k != "SKIP"]
    for i in range(n if n < len(kinds) else len(kinds)):
        if kinds[i] == "as" and following(kinds, i) == "const":
            j = i + 1
            while kinds[j] == "\n":
                j += 1
            kinds[j] = "n"


def type_arguments(kinds: list[str]) -> None:
    """Mark ``<…>`` after a name as type arguments of a call where only type tokens stand inside
    and a call, template or end of expression follows."""
    angles: dict[int, int] = {}
    stack: list[int] = []
    for j, t in enumerate(kinds):
        if t in ("<", "(", "(A", "[", "{"):
            stack.append(j)
        elif t == ">":
            if stack and kinds[stack[-1]] == "<":
                angles[stack.pop()] = j
        elif t in (")", ")A", "]", "}"):
            while stack and kinds[stack[-1]] == "<":
                stack.pop()
            if stack:
                stack.pop()
        elif t == ";":
            while stack and kinds[stack[-1]] == "<":
                stack.pop()
        elif t not in TYPE_TOKENS and t != "\n":
            stack.clear()
    ends = closers(kinds) if angles else {}
    for i, j in sorted(angles.items()):
        if i and kinds[i - 1] == "n" and following(kinds, j) in ("(", "tmpl") and not declares(kinds, i, j, ends):
            kinds[i], kinds[j] = "<T", ">T"


def declares(kinds: list[str], i: int, j: int, ends: dict[int, int]) -> bool:
    """Whether the name before ``<`` at ``i``, closed at ``j``, is that of a function, method or
    type being declared."""
    if i >= 2 and kinds[i - 2] in ("function", "*", "INTERFACE", "TYPE", "class"):
        return True
    at = j + 1  # a method: name<T>(…) { or name<T>(…): type {
    while at < len(kinds) and kinds[at] == "\n":
        at += 1
    if at not in ends:
        return False
    return kinds[i - 2 : i - 1] != ["."] and following(kinds, ends[at]) in ("{", ":") and (i < 2 or kinds[i - 2] in ("\n", "{", "}", ";", "async", "n"))


def markup(kinds: list[str]) -> None:
    """Replace an element of embedded markup in operand position by one token, if its tags match."""
    i = 0
    while i < len(kinds):
        if kinds[i] == "<" and (i == 0 or kinds[i - 1] in ("(", "=", "return", "=>", ",", ":", "?", "&&", "BIN", "[", "{", "\n", "default")) and following(kinds, i) in ("n", ">"):
            end = element(kinds, i)
            if end > i:
                breaks = kinds[i:end].count("\n")
                kinds[i:end] = ["\n"] * breaks + ["jsx"]
                i += breaks
        i += 1


def element(kinds: list[str], i: int) -> int:
    """Index after the element that begins at ``i``, or ``i`` if its tags don't match."""
    depth, j, n = 0, i, len(kinds)
    while j < n:
        if kinds[j] == "<":
            closing = following(kinds, j) == "/"
            k = j + 1
            braces = 0
            while k < n and not (kinds[k] == ">" and braces == 0):
                braces += (kinds[k] == "{") - (kinds[k] == "}")
                k += 1
            if k >= n:
                return i
            alone = kinds[k - 1] == "/" and not closing
            depth += 0 if alone else -1 if closing else 1
            j = k + 1
            if depth == 0:
                return j
        else:
            j += 1
    return i


def source_line(pattern: re.Pattern, kinds: Kinds, text: str, at: int) -> int:
    """The line, from 1, in ``text`` of the ``at``-th line of kinds; comments hide line breaks."""
    line, seen = 1, 0
    for token in pattern.findall(text.replace("\r\n", "\n").lstrip("\ufeff")):
        if seen == at:
            break
        line += token.count("\n")
        seen += kinds[token][:1] == "\n"
    return line


# --- Go ---------------------------------------------------------------------------------------

GO_TOKEN = re.compile(
    r"//[^\n]*|/\*[\s\S]*?\*/|\n|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]+?)'|" + WORD + "|" + NUMBER + r"i?\w*"
    r"|\.\.\.|<<=|>>=|&\^=|:=|<-|\+\+|--|&&|\|\||==|!=|<=|>=|[-+*/%&|^]=|<<|>>|&\^|[-+*/%&|^~<>=.,:;()\[\]{}!]|[^\s]",
)
GO_KEYWORDS = words("package import func var const map chan struct interface if else for range switch select case default return go defer break continue goto fallthrough") | {"type": "type_"}
GO_OPS = {op: op for op in "... := <- ++ -- - + * & ^ | ~ = . , : ; ( ) [ ] { } !".split()} | {op: "BIN" for op in "&& || == != <= >= << >> &^ / % < >".split()} | {
    op: "ASSIGN" for op in "<<= >>= &^= -= += *= /= %= &= |= ^=".split()
}
GO_NUMBER = re.compile(NUMBER + "i?")
GO_ENDS = frozenset("n num str char return break continue fallthrough ++ -- ) ] }".split())


def go_kind(t: str) -> str:
    if t in GO_KEYWORDS:
        return GO_KEYWORDS[t]
    if t in GO_OPS:
        return GO_OPS[t]
    c = t[0]
    if c == "\n":
        return "\n"
    if c in "\"`" and len(t) > 1:
        return "str"
    if c == "'" and len(t) > 1:
        return "char"
    if c == "/":
        return "\n" if t[1] == "*" and "\n" in t else ""
    if c.isdigit() or c == "." and len(t) > 1:
        return "num" if GO_NUMBER.fullmatch(t) else "ERR"
    return "n" if c.isidentifier() else "ERR"


GO_KINDS = Kinds(go_kind)


def go_lines(text: str) -> list[str]:
    """Lines of token kinds with the semicolons that line ends stand for."""
    flat = " ".join(k for k in map(GO_KINDS.__getitem__, GO_TOKEN.findall(text.replace("\r\n", "\n").lstrip("﻿") + "\n")) if k)
    lines = [x.strip() for x in flat.split("\n")]
    out = [x + " ;" if x and x[x.rfind(" ") + 1 :] in GO_ENDS else x for x in lines]
    return out + ["EOF"]


# --- Java -------------------------------------------------------------------------------------

JAVA_TOKEN = re.compile(
    r"//[^\n]*|/\*[\s\S]*?\*/|\n|\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\[^\n]+?)'|[^\W\d][\w$]*|\$[\w$]*|" + NUMBER + r"[lLfFdD]?\w*"
    r"|\.\.\.|->|::|>>>=|<<=|>>=|\+\+|--|&&|\|\||==|!=|<=|>=|[-+*/%&|^]=|<<|[-+*/%&|^~<>=.,:;()\[\]{}!?@]|[^\s]",
)
JAVA_KEYWORDS = words("package import static class interface enum extends implements throws if else for while do switch case default try catch finally return throw break continue synchronized assert new instanceof this super final") | {
    w: "MOD" for w in "public private protected abstract native transient volatile strictfp sealed".split()
} | {w: "prim" for w in "int long short byte char boolean float double void".split()} | {"true": "lit", "false": "lit", "null": "lit", "throws": "throws_"}
JAVA_OPS = {op: op for op in "... -> :: ++ -- - + * & | < > = . , : ; ( ) [ ] { } ! ~ ? @".split()} | {op: "BIN" for op in "&& || == != <= >= << / % ^".split()} | {
    op: "ASSIGN" for op in ">>>= <<= >>= -= += *= /= %= &= |= ^=".split()
}
JAVA_NUMBER = re.compile(NUMBER + "[lLfFdD]?")


def java_kind(t: str) -> str:
    if t in JAVA_KEYWORDS:
        return JAVA_KEYWORDS[t]
    if t in JAVA_OPS:
        return JAVA_OPS[t]
    c = t[0]
    if c == "\n":
        return "\n"
    if c == '"' and len(t) > 1:
        return "str"
    if c == "'" and len(t) > 1:
        return "char"
    if c == "/":
        return "\n" if t[1] == "*" and "\n" in t else ""
    if c.isdigit() or c == "." and len(t) > 1:
        return "num" if JAVA_NUMBER.fullmatch(t) else "ERR"
    if t in ("yield", "record", "permits"):
        return "w:" + t
    return "n" if c == "$" or c.isidentifier() else "ERR"


JAVA_KINDS = Kinds(java_kind)
JAVA_TYPE = frozenset("n . , ? extends super & [ ] prim < > @".split())


def java_lines(text: str) -> list[str]:
    kinds = [k for k in map(JAVA_KINDS.__getitem__, JAVA_TOKEN.findall(text.replace("\r\n", "\n").lstrip("﻿"))) if k]
    for i, k in enumerate(kinds):
        if k == "w:yield":
            kinds[i] = "yieldx" if (i and kinds[i - 1] in (";", "{", "}", ":", "->", "\n")) and following(kinds, i) in ("n", "num", "str", "char", "lit", "new", "this", "!", "-", "switch", "w:yield", "w:record") else "n"
        elif k == "w:permits":
            kinds[i] = "permits" if i and kinds[i - 1] in ("n", ">", ">T", ")") and following(kinds, i) == "n" else "n"
        elif k == "w:record":
            kinds[i] = "RECORD" if following(kinds, i) == "n" and (not i or kinds[i - 1] in (";", "{", "}", "\n", "MOD", "static", "final", ")")) else "n"
        if k == "<" and i and kinds[i - 1] in ("n", ".", "MOD", "static", "final", "\n", "new"):
            stack = []
            for j in range(i, len(kinds)):
                t = kinds[j]
                if t == "<":
                    stack.append(j)
                elif t == ">":
                    stack.pop()
                    if not stack:
                        if following(kinds, j) in ("n", "(", ")", ">", ",", "{", "::", ".", "[", "...", "prim", ";", "&", "=", "implements", "extends", "permits"):
                            kinds[i], kinds[j] = "<T", ">T"
                            inner = [x for x in range(i + 1, j) if kinds[x] in ("<", ">")]
                            for x in inner:
                                kinds[x] += "T"
                        break
                elif t not in JAVA_TYPE and t != "\n":
                    break
    kinds.append("EOF")
    return " ".join(kinds).split("\n")


# --- JSON, TOML, YAML -------------------------------------------------------------------------

JSON_TOKEN = re.compile(r'\n|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[A-Za-z]+|[{}\[\]:,]|[^ \t\r]')


def json_kind(t: str) -> str:
    c = t[0]
    if c == '"' and len(t) > 1:
        return "str"
    if c in "{}[]:,\n":
        return c
    if t in ("true", "false", "null"):
        return "lit"
    return "num" if c.isdigit() or c == "-" and len(t) > 1 else "ERR"


JSON_KINDS = Kinds(json_kind)


def json_lines(text: str) -> list[str]:
    return (" ".join(map(JSON_KINDS.__getitem__, JSON_TOKEN.findall(text))) + " EOF").split("\n")


TOML_TOKEN = re.compile(
    r"\#[^\n]*|\n|\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\(?:[btnfre\"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}))*\"|'[^'\n]*'"
    r"|\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?|[+-]?(?:0[xob][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?|inf|nan)(?![\w-])|[A-Za-z0-9_-]+|[=.,\[\]{}]|[^ \t\r]"
)


def toml_kind(t: str) -> str:
    c = t[0]
    if t in "=.,[]{}":
        return t
    if c == "\n":
        return "\n"
    if c == "#":
        return ""
    if t[:3] in ('"""', "'''") and len(t) >= 6:
        return "mstr"
    if c in "\"'" and len(t) > 1:
        return "str"
    if t in ("true", "false"):
        return "lit"
    if re.fullmatch(r"\d{4}-.*|\d\d:.*", t) and re.fullmatch(r"\d{4}-\d\d-\d\d.*|\d\d:\d\d.*", t):
        return "date"
    if re.fullmatch(r"[+-]?(?:0[xob][\da-fA-F_]+|(?:0|[1-9][\d_]*)(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?|inf|nan)", t):
        return "num"
    return "n" if re.fullmatch(r"[A-Za-z0-9_-]+", t) else "ERR"


TOML_KINDS = Kinds(toml_kind)


def toml_lines(text: str) -> list[str]:
    flat = " ".join(k for k in map(TOML_KINDS.__getitem__, TOML_TOKEN.findall(text.replace("\r\n", "\n").lstrip("﻿") + "\n")) if k)
    return [x + " NL" for x in flat.split("\n")[:-1]] + ["EOF"]


YAML_KEY = re.compile(r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s\#&*!|>%@`\"'\[\]{},?:-][^:\#\n]*?(?:(?::(?=\S)|(?<=\S)\#)[^:\#\n]*?)*|[-?:](?=[^\s,\[\]{}])[^:\#\n]*?)\s*:(?=\s|$)")
YAML_FLOW = re.compile(r"\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^']|'')*'|[{}\[\],]|:(?=[\s,\[\]{}]|$)|\s\#[^\n]*|[&*!][^\s,\[\]{}]*|[^\s,\[\]{}:\"'#&*!][^,\[\]{}:\n#]*(?:(?::(?=[^\s,\[\]{}])|(?<=\S)\#)[^,\[\]{}:\n#]*)*|\S")
YAML_VALUE = re.compile(r"^(?:[|>][-+]?\d?[-+]?\s*(?:\#.*)?)$")


def yaml_value(text: str) -> tuple[str, int]:
    """(kinds, open brackets) of what follows a key or a dash, on its line."""
    text = text.strip()
    kinds = ""
    while m := re.match(r"([&!])[^\s,\[\]{}]*(?:\s+|$)", text):
        kinds += "anchor " if m.group(1) == "&" else "tag "
        text = text[m.end() :]
    if not text or text[0] == "#":
        return kinds.strip(), 0
    if text[0] == "*":
        return kinds + "alias" if re.fullmatch(r"\*\S+(?:\s+\#.*)?", text) else "ERR", 0
    if text[0] in "[{":
        return flow(kinds, text)
    if text[0] == '"':
        return kinds + ("str" if re.fullmatch(r'"(?:[^"\\]|\\.)*"(?:\s+\#.*)?', text) else "ERR"), 0
    if text[0] == "'":
        return kinds + ("str" if re.fullmatch(r"'(?:[^']|'')*'(?:\s+\#.*)?", text) else "ERR"), 0
    if text[0] in "@`%" or text[0] in "]},":
        return "ERR", 0
    plain = re.split(r"\s\#", text)[0]
    if re.search(r":(?:\s|$)", plain):
        return "ERR", 0
    return kinds + "plain", 0


def flow(kinds: str, text: str) -> tuple[str, int]:
    depth = 0
    parts = []
    for t in YAML_FLOW.findall(text):
        c = t[0]
        if t in ("{", "[", "}", "]", ",", ":"):
            depth += (t in "{[") - (t in "}]")
            parts.append(t)
        elif t.lstrip()[:1] == "#":
            continue
        elif c in "\"'":
            parts.append("str" if len(t) > 1 and t[-1] == c else "ERR")
        elif c in "&!":
            parts.append("anchor" if c == "&" else "tag")
        elif c == "*":
            parts.append("alias")
        else:
            parts.append("plain" if t.strip() else "ERR")
    return kinds + " ".join(parts), depth


YAML_REST = {'"': re.compile(r'(?:[^"\\]|\\(?:.|$))*+"'), "'": re.compile(r"(?:[^']|'')*+'")}
YAML_TAGS = re.compile(r"(?:[&!]\S*\s+)*")


def open_quote(value: str) -> str:
    """The quote of a scalar that begins in a value and does not end on its line, or nothing."""
    value = value.strip()
    value = value[YAML_TAGS.match(value).end() :]
    return value[0] if value[:1] in YAML_REST and not YAML_REST[value[0]].match(value, 1) else ""


def yaml_lines(text: str) -> list[str]:
    """Lines of kinds: IN and DE for deeper and shallower blocks, SUB and BUS around the pairs of
    an item that begin on the line of its dash, NL at line ends. A document marker becomes DOC."""
    out: list[str] = []
    levels: list[tuple[int, str]] = [(0, "IN")]
    pending_flow, literal, opened = 0, -1, 0
    lines = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿").split("\n")
    quote = ""
    for raw in lines:
        stripped = raw.strip()
        if quote:  # a quoted scalar over several lines
            m = YAML_REST[quote].match(raw)
            if m:
                quote = ""
                out.append("str NL" if re.fullmatch(r"\s*|\s+\#.*", raw[m.end() :]) else "ERR NL")
            else:
                out.append("ERR" if re.match(r"(?:---|\.\.\.)(?:\s|$)", raw) else "")
            continue
        indent = len(raw) - len(raw.lstrip(" "))
        if literal >= 0:
            if not stripped or indent > literal:
                out.append("")
                continue
            literal = -1
        if pending_flow:
            kinds, depth = flow("", raw)
            pending_flow += depth
            out.append("NL " + kinds + (" NL" if pending_flow <= 0 else ""))
            pending_flow = max(pending_flow, 0)
            continue
        if not stripped or stripped[0] == "#":
            out.append("")
            continue
        if raw.startswith("---") and (len(raw) == 3 or raw[3] in " \t") or raw.rstrip() == "...":
            prefix = "".join("DE " if k == "IN" else "BUS " for _, k in levels[:0:-1])
            levels = [(0, "IN")]
            out.append(prefix + ("DOC" if any(x for x in out) else ""))
            continue
        if raw.startswith("%") and not any(out):
            out.append("")
            continue
        if "\t" in raw[: len(raw) - len(raw.lstrip())]:
            out.append("ERR")
            continue
        prefix = ""
        if indent > levels[-1][0]:
            levels.append((indent, "IN"))
            prefix = "IN "
        else:
            while indent < levels[-1][0]:
                prefix += "DE " if levels.pop()[1] == "IN" else "BUS "
            if indent != levels[-1][0]:
                prefix += "ERR "
        body, at, parts = raw[indent:], indent, []
        while re.match(r"-(?:\s|$)", body):
            if parts:
                levels.append((at, "SUB"))
                parts.append("SUB")
            parts.append("-")
            step = len(body[1:]) - len(body[1:].lstrip(" ")) + 1
            body, at = body[step:], at + step
        rest = body.strip()
        m = YAML_KEY.match(body)
        if m:
            key_kind = "key"
            value = body[m.end() :]
            if parts:
                levels.append((at, "SUB"))
                parts.append("SUB")
            if YAML_VALUE.match(value.strip()):
                parts += [key_kind, "blockscalar", "NL"]
                literal = levels[-1][0]
            else:
                kinds, depth = yaml_value(value)
                if kinds.endswith("ERR") and open_quote(value):
                    quote, opened = open_quote(value), len(out)
                    out.append(prefix + " ".join([*parts, key_kind, *kinds.split()[:-1]]))
                    continue
                parts += [key_kind, kinds] if kinds else [key_kind]
                if depth > 0:
                    pending_flow = depth
                else:
                    parts.append("NL")
        elif YAML_VALUE.match(rest) and parts:
            parts += ["blockscalar", "NL"]
            literal = levels[-1][0]
        else:
            kinds, depth = yaml_value(rest)
            if kinds.endswith("ERR") and open_quote(rest):
                quote, opened = open_quote(rest), len(out)
                out.append(prefix + " ".join([*parts, *kinds.split()[:-1]]))
                continue
            if kinds:
                parts.append(kinds)
            if depth > 0:
                pending_flow = depth
            else:
                parts.append("NL")
        out.append(prefix + " ".join(parts))
    if quote:
        out[opened] += " ERR"
    out.append(("ERR " if pending_flow or quote else "") + "".join("DE " if k == "IN" else "BUS " for _, k in levels[:0:-1]) + "EOF")
    return out
