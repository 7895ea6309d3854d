"""Predictive parse tables from grammars, and a pushdown parser that remembers whole lines.

A grammar is text: ``name: alternatives`` with ``( ) * + ? |``; names that have no rule are
terminals. Where two alternatives can begin with the same token the earlier one wins and the
table lists the conflict; an alternative that may be empty is taken when no other fits.

The parser's state is its stack, kept as interned linked nodes, so a state is one number. What a
line of token kinds does to a state is remembered; code repeats its line shapes, so most lines
cost one lookup, and the parse stays exact.
"""

from __future__ import annotations

import re

META = re.compile(r"'[^']+'|\*\*|\+\+|\?\.|[()*+?|]|[^\s()*+?|]+")
ERROR = -1


class Grammar:
    """Tables of one grammar: ``table[nonterminal][token]`` is the list of symbols to push."""

    def __init__(self, text: str, start: str = "file") -> None:
        self.rules: dict[str, list[list[str]]] = {}
        rules = re.split(r"\n(?=\w+:)", re.sub(r"\n[ \t]+", " ", "\n" + text.strip()))
        heads = [r.split(":", 1) for r in rules if r.strip()]
        self.names = {h.strip() for h, _ in heads}
        for head, body in heads:
            self.head = head.strip()
            self.made = 0
            tokens = META.findall(body)
            alternatives, rest = self.alternatives(tokens, 0)
            if rest != len(tokens):
                raise ValueError(f"unbalanced rule {head}")
            self.rules[self.head] = alternatives
        self.start = start
        self.build()

    def fresh(self, alternatives: list[list[str]]) -> str:
        self.made += 1
        name = f"{self.head}~{self.made}"
        self.rules[name] = alternatives
        return name

    def alternatives(self, tokens: list[str], at: int) -> tuple[list[list[str]], int]:
        out, current = [], []
        while at < len(tokens):
            t = tokens[at]
            if t == ")":
                break
            if t == "|":
                out.append(current)
                current = []
                at += 1
                continue
            if t == "(":
                inner, at = self.alternatives(tokens, at + 1)
                symbol = self.fresh(inner) if len(inner) > 1 or len(inner[0]) != 1 else inner[0][0]
                at += 1
            else:
                symbol = t[1:-1] if t[0] == "'" else t
                at += 1
            if at < len(tokens) and tokens[at] in ("*", "+", "?"):
                mark = tokens[at]
                at += 1
                if mark == "?":
                    symbol = self.fresh([[symbol], []])
                else:
                    loop = self.fresh([])
                    self.rules[loop] = [[symbol, loop], []]
                    if mark == "+":
                        current.append(symbol)
                    symbol = loop
            current.append(symbol)
        return out + [current], at

    def build(self) -> None:
        nullable: set[str] = set()
        first: dict[str, set[str]] = {n: set() for n in self.rules}
        changed = True
        while changed:
            changed = False
            for n, alternatives in self.rules.items():
                for alternative in alternatives:
                    before = len(first[n])
                    for s in alternative:
                        first[n] |= first[s] if s in self.rules else {";"} if s == "SEMI" else {s}
                        if s not in nullable and s != "SEMI":
                            break
                    else:
                        if n not in nullable:
                            nullable.add(n)
                            changed = True
                    changed |= len(first[n]) != before
        self.table: dict[str, dict[str, list[str]]] = {}
        #: Where two alternatives begin with the same token: (rule, token), settled by their order.
        self.conflicts: list[tuple[str, str]] = []
        self.default: dict[str, list[str] | None] = {}
        for n, alternatives in self.rules.items():
            row: dict[str, list[str]] = {}
            empty = None
            for alternative in alternatives:
                starts: set[str] = set()
                for s in alternative:
                    starts |= first[s] if s in self.rules else {";"} if s == "SEMI" else {s}
                    if s not in nullable and s != "SEMI":
                        break
                else:
                    empty = alternative if empty is None else empty
                for t in starts:
                    if t in row:
                        self.conflicts.append((n, t))
                    row.setdefault(t, alternative[::-1])
            self.table[n] = row
            self.default[n] = empty[::-1] if empty is not None else None


class Parser:
    """Runs a grammar over lines of token kinds. ``semi`` is a symbol that a semicolon, a closing
    brace, the end or the start of a line satisfies, for languages that insert semicolons."""

    LIMIT = 400_000

    def __init__(self, grammar: Grammar, semi: str = "SEMI") -> None:
        self.grammar, self.semi = grammar, semi
        self.reset()

    def reset(self) -> None:
        self.nodes: dict[tuple[str, int], int] = {}
        self.symbol: list[str] = [""]
        self.parent: list[int] = [0]
        self.memo: dict[tuple[int, str], int] = {}
        self.initial = self.push(0, ["EOF", self.grammar.start])

    def push(self, state: int, symbols: list[str]) -> int:
        nodes = self.nodes
        for s in symbols:
            key = (s, state)
            node = nodes.get(key)
            if node is None:
                node = nodes[key] = len(self.symbol)
                self.symbol.append(s)
                self.parent.append(state)
            state = node
        return state

    def step(self, state: int, tokens: list[str]) -> int:
        table, default, symbol, parent, semi = self.grammar.table, self.grammar.default, self.symbol, self.parent, self.semi
        fresh_line = True
        for t in tokens:
            while True:
                s = symbol[state]
                state = parent[state]
                row = table.get(s)
                if row is None:
                    if s == t:
                        break
                    if s == semi:
                        if t == ";":
                            break
                        if fresh_line or t in ("}", "EOF"):
                            continue
                    return ERROR
                body = row.get(t)
                if body is None:
                    body = default[s]
                    if body is None:
                        return ERROR
                state = self.push(state, body)
            fresh_line = False
        return state

    def parse(self, lines: list[str]) -> int:
        """Index of the first line that can't be parsed, or -1; the last line must end in EOF."""
        if len(self.memo) > self.LIMIT or len(self.symbol) > 4 * self.LIMIT:
            self.reset()
        state, memo = self.initial, self.memo
        for i, line in enumerate(lines):
            key = (state, line)
            after = memo.get(key)
            if after is None:
                after = memo[key] = self.step(state, line.split())
            if after == ERROR:
                return i
            state = after
        return -1
