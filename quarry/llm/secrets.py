"""Problem 1: credentials embedded in source code.

Method: an Aho-Corasick automaton over key words picks the lines worth looking at; on those,
issuer formats are matched by regular expression, JSON web tokens are checked by decoding their
header, private keys by the base64 line that follows, GitHub's and npm's check digits confirm a
token, and values that carry no issuer format by
the name they are bound to and their character structure. Matches are replaced by placeholders
of the same length and alphabet, so the text still parses.
"""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words one of which stands on or before every line that can hold a credential.
KEYWORDS = (
    "passw", "passphrase", "pwd", "pw", "secret", "token", "apikey", "api_key",
    "api-key", "accesskey", "access_key", "access-key", "credential", "auth", "bearer ", "basic ",
    "private key", "client(", "curl", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_",
    "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-", "sk_live_", "sk_test_",
    "rk_live_", "aiza", "eyj", "npm_", "pypi-", "sg.", "hooks.slack", "_pat_", "_srv_", "://", "dsn",
    "account_key", "accountkey", "connectionstring", "connection_string", "encryption_key", "signing_key",
    "_live_", "_test_", "_prod_", "_key_", "_tok_", "pass", "account-key", "signingkey", "signing-key", "encryptionkey", "encryption-key", "private_key", "privatekey", "private-key", "--user",
)

# Formats that issuers document or that follow their pattern.
ISSUERS = (
    r"gh[pousr]_[A-Za-z0-9]{36}",
    r"github_pat_[A-Za-z0-9_]{50,}",
    r"glpat-[A-Za-z0-9_\-]{20,}",
    r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    r"xox[abprs]-[A-Za-z0-9\-]{20,}",
    r"[srp]k_(?:live|test)_[A-Za-z0-9]{16,}",
    r"AIza[A-Za-z0-9_\-]{35}",
    r"npm_[A-Za-z0-9]{36}",
    r"pypi-[A-Za-z0-9_\-]{50,}",
    r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}",
    r"[a-z]{2,6}_(?:pat|srv|live|prod|key|tok)_[A-Za-z0-9]{20,}",
)
ISSUER = re.compile(r"(?<![A-Za-z0-9_\-])(?:" + "|".join(ISSUERS) + r")(?![A-Za-z0-9_])")
WEB_TOKEN = re.compile(r"(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{10,}(?:\.[A-Za-z0-9_\-]{8,}){1,2}")
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
USERINFO = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]{1,15}://[^\s/:@\"'`<>]*:([^\s/@\"'`<>]{3,})@[\w\[]")
CURL_USER = re.compile(r"(?:-u|--user)[\"'\s,=]+[\w.\-]+:([^\s\"'`]{6,})")
HEADER = re.compile(r"(?i)\b(?:bearer|basic|token)\s+([A-Za-z0-9+/=_.\-~!@#$%^&*]{8,})")

KEY_NAME = re.compile(
    r"(?i)(?:pass(?:word|wd|phrase|w)?|pwd|(?<![a-z])pw|(?<=[a-z])Pw|secret|token|api[_-]?key|access[_-]?key|account[_-]?key"
    r"|signing[_-]?key|encryption[_-]?key|private[_-]?key|credentials?|auth|authorization|dsn)$"
)
BENIGN_NAME = re.compile(
    r"(?i)(?:hash|sha\d*|sum|etag|digest|integrity|commit|request_?id|(?<![a-z])id|uuid|guid|icon|png|image|font|cert|certificate|fingerprint"
    r"|pem|public_?key|path|file|label|url|uri|host|name|re|regex|pattern|prompt|placeholder|count|len|length|size|budget|type|field|version|user)s?$"
)
PLACEHOLDER = re.compile(
    r"(?i)^(?:[x*.\-_#?0]+|<.*>|\$\{?.*|\{\{.*|\{[\w.]*\}|%.*%|%\(.*|.*(?:your|my)[-_ ]?(?:api|token|key|secret|password|own).*|change[-_ ]?(?:me|it|this).*"
    r"|replace.*|redact.*|mask.*|hidden|removed|examples?(?:[-_].*)?|dummy.*|sample.*|fake.*|test|testing|placeholder.*|todo.*|tbd|none|null|nil|undefined|true|false"
    r"|insert.*|enter.*|secret|password|passwd|token|vault:.*|env:.*|ssm:.*|arn:.*|op://.*|secretref:.*|file:.*|.*\.\.\.|.*(?:xxxx|\*\*\*\*).*|process\.env.*|os\.environ.*)$"
)
NAME = re.compile(r"[A-Za-z_][\w\-]*")
LITERAL = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`([^`\n]*)`')
JOINED = re.compile(r"""(["'])([^"'\n]+)\1\s*\+\s*(["'])([^"'\n]+)\3""")
BARE = re.compile(r"(?<![\w\"'`/+.\-])[A-Za-z0-9+/_\-!@#$%^&*.~]{8,}={0,2}(?![\w\"'`(=])")
PLAIN_ID = re.compile(r"^(?:[a-z]+(?:[_\-.][a-z]+)*|[A-Z]+(?:_[A-Z]+)*|[a-z]+(?:[A-Z][a-z]+)*|(?:[A-Z][a-z]+)+)(?:[_\-]?\d{1,3})?$")
HOST = re.compile(r"^[a-z0-9\-]+(?:\.[a-z0-9\-]+)*\.[a-z]{2,}(?::\d+)?(?:/\S*)?$")
UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
REPEATED = re.compile(r"^(.)\1*$")
SETTING = re.compile(r"^\s*(?:export\s+|set\s+|-\s+)?[\w.\-]+(?:=|:\s+)$")
BASE64_LINE = re.compile(r"^[^A-Za-z0-9+/]*[A-Za-z0-9+/]{24,}")


KEY_MARKS = re.compile(r"^(?:(?://|#|\*)\s+)?[\s\"'`+,\\]*")
KEY_HEADER = re.compile(r"[A-Z][A-Za-z\-]*:(?:\s|$)")


def key_body(text: str) -> bool:
    """Whether base64 follows the first line of a private key, past header lines, quotes and signs
    that join literals."""
    for line in re.split(r"\n|(?:\\r)?\\n", text):
        line = line[KEY_MARKS.match(line).end() :].rstrip("\"'`+,\\ \t\r")
        if line and not KEY_HEADER.match(line):
            return bool(BASE64_LINE.match(line)) and not placeholder(line)
    return False


BREAK = re.compile(r"\n|(?:\\r)?\\n")
BASE64 = re.compile(r"[A-Za-z0-9+/]+={0,2}")


def key_end(text: str, at: int) -> int:
    """Offset at which the body of a private key ends whose BEGIN mark ends at ``at``: before its END
    mark, or after the last line that is base64. Code that follows a key cut short is no part of it."""
    begin = last = at
    while at < len(text):
        m = BREAK.search(text, at)
        stop = m.start() if m else len(text)
        mark = text.find("-----END", at, stop)
        if mark >= 0:
            return mark
        line = text[at:stop]
        core = line[KEY_MARKS.match(line).end() :].rstrip("\"'`+,\\ \t\r")
        if BASE64.fullmatch(core) and (len(core) >= 24 or last > begin and (core[-1] == "=" or sum(bool(re.search(x, core)) for x in ("[a-z]", "[A-Z]", "[0-9]")) == 3)):
            last = stop
        elif core and not KEY_HEADER.match(core):
            break
        at = m.end() if m else len(text)
    return last


DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})")


def check_digits(value: str) -> bool | None:
    """Whether the check digits of a value agree: the last six of a GitHub or npm token are the CRC32 of
    the thirty before them, in base 62. Formats without documented check digits give None."""
    m = CHECKED.fullmatch(value)
    if not m:
        return None
    number = 0
    for c in m.group(2):
        number = number * 62 + DIGITS62.index(c)
    return number == zlib.crc32(m.group(1).encode())


def entropy(value: str) -> float:
    """Shannon entropy of the characters in bits."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def placeholder(value: str) -> bool:
    """Whether a value stands for a credential without being one; masked values count."""
    return bool(PLACEHOLDER.match(value)) or not value.strip("xX0*-_.") or len(set(value)) < 5


def web_token(value: str) -> bool:
    """Whether the first part of a dotted value decodes to a JSON object with an algorithm."""
    head = value.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except ValueError:
        return False


def secret_like(value: str, loose: bool) -> bool:
    """Whether a value bound to a credential's name has the structure of one.

    Random strings need length and entropy; chosen passwords need three of the four character
    classes. Identifiers, hosts, paths and UUIDs are never taken. ``loose`` is for values that
    stand in quotes."""
    n = len(value)
    if n < 8 or placeholder(value) or any(c.isspace() for c in value):
        return False
    if PLAIN_ID.match(value) or HOST.match(value) or UUID.match(value) or value[0] in "/.$<{(" or "://" in value:
        return False
    classes = sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value), re.search("[0-9]", value), re.search(r"[^A-Za-z0-9]", value))))
    if re.fullmatch(r"[0-9a-fA-F]{16,}", value):
        return entropy(value) > 2.5 and not value.isdigit()
    if n >= 16 and classes >= 2 and entropy(value) >= 3.2 and re.search(r"\d", value):
        return loose or classes >= 3 or n >= 24
    return loose and classes >= 3 and not re.fullmatch(r"[\w.\-]+\(.*", value)


def spans_of_line(line: str, following: str = "", named_before: str = "") -> list[tuple[int, int]]:
    """Start and end of every credential value that begins on ``line``.

    ``following`` is what a private key's first line is followed by (it must be base64, which may
    come after headers), ``named_before`` the credential's name when an assignment on the line
    before was left open."""
    found: list[tuple[int, int]] = []
    free = lambda a, b: not any(a < y and x < b for x, y in found)
    for m in PRIVATE_KEY.finditer(line):
        rest = line[m.end() :]
        body = rest.replace("\\n", "").strip()
        if BASE64_LINE.match(body) and not placeholder(body) or key_body(rest + "\n" + following):
            found.append(m.span())
    for m in ISSUER.finditer(line):
        if check_digits(m.group()) or not placeholder(m.group().split("_")[-1].split("-")[-1]) and entropy(m.group()) > 2.8:
            found.append(m.span())
    for m in WEB_TOKEN.finditer(line):
        if free(*m.span()) and web_token(m.group()):
            found.append(m.span())
    for pattern in (USERINFO, CURL_USER):
        for m in pattern.finditer(line):
            if free(*m.span(1)) and not placeholder(m.group(1)) and not m.group(1).startswith(("$", "{", "<", "%")):
                found.append(m.span(1))
    for m in HEADER.finditer(line):
        if free(*m.span(1)) and secret_like(m.group(1), loose=m.group()[0] in "Bb"):
            found.append(m.span(1))

    names = [m for m in NAME.finditer(line) if len(m.group()) > 1]
    keyed = [m for m in names if KEY_NAME.search(m.group()) and not BENIGN_NAME.search(m.group())]
    if not keyed and not named_before and "Client(" not in line:
        return sorted(found)
    comment = re.search(r"(?:^|\s)(?:#|//|--|\*|/\*)\s", line)
    candidates = [(m.start(m.lastindex), m.end(m.lastindex), True) for m in LITERAL.finditer(line) if m.lastindex]
    candidates += [(*m.span(), False) for m in BARE.finditer(line) if not any(a <= m.start() < b for a, b, _ in candidates)]
    for m in JOINED.finditer(line):  # one value written as the sum of two literals
        whole = m.group(2) + m.group(4)
        near = [x for x in names if x.end() <= m.start()]
        if near and KEY_NAME.search(near[-1].group()) and not BENIGN_NAME.search(near[-1].group()):
            if secret_like(whole, True) or ISSUER.fullmatch(whole) or WEB_TOKEN.fullmatch(whole):
                found[:] = [x for x in found if x[1] <= m.start(2) or x[0] >= m.end(4)]
                found += [m.span(2), m.span(4)]
    for a, b, quoted in candidates:
        value = line[a:b]
        bare_value = not quoted and SETTING.match(line[:a]) and not line[b:].strip() and re.search(r"[^\w.]", value)
        if not free(a, b) or not secret_like(value, quoted or bool(bare_value)):
            continue
        before = [m for m in names if m.end() <= a and not any(x <= m.start() < y for x, y, q in candidates if q and line[y + 1 : y + 2] not in (":", "]", ",", " ") and y < a)]
        near = before[-1].group() if before else named_before
        after_key = line[b + 1 : b + 3].strip().startswith((":", "=>")) if quoted else False
        if after_key:
            continue
        if near and BENIGN_NAME.search(near) and not KEY_NAME.search(near) and near not in ("user", "name"):
            continue
        call = "Client(" in line[line.rfind(";", 0, a) + 1 : a] and (entropy(value) >= 3.0 and len(value) >= 12)
        close = [m for m in keyed if m.end() <= a and ";" not in line[m.end() : a]]
        trailing = [m for m in keyed if m.start() >= b and comment and m.start() > comment.start() and not any(BENIGN_NAME.search(x.group()) for x in before[-1:])]
        opened = named_before and not keyed
        if not quoted and not (comment and comment.start() < a) and not re.search(r"[:=]\s*$", line[:a]):
            continue
        if close or trailing or call or opened or (keyed and keyed[-1].end() <= a and re.search(r"return\s+[\"'`]$", line[:a])):
            found.append((a, b))
    return sorted(found)


class Scanner:
    """Finds credentials in texts; one automaton a process."""

    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for word in KEYWORDS:
            self.automaton.add_word(word, len(word))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> list[tuple[int, int, int]]:
        """(line number from 1, start, end) of each credential; null and empty texts have none."""
        if not text:
            return []
        lowered = text.lower()
        if len(lowered) != len(text):  # a few letters change length when lowered
            lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        starts: set[int] = set()
        done = -1
        for end, _ in self.automaton.iter(lowered):
            if end > done:
                start = text.rfind("\n", 0, end) + 1
                starts.add(start)
                done = text.find("\n", end)
                if done < 0:
                    done = len(text)
                if text[start:done].rstrip()[-1:] in "=:(,\\[{+" and done < len(text):
                    starts.add(done + 1)  # the value may stand on the next line
        out = []
        line_no, at = 1, 0
        for start in sorted(starts):
            line_no += text.count("\n", at, start)
            at = start
            end = text.find("\n", start)
            end = len(text) if end < 0 else end
            following = ""
            if end < len(text) and PRIVATE_KEY.search(text, start, end):
                stop = text.find("-----", end)  # the key's end, or the next one's beginning
                following = text[end + 1 : len(text) if stop < 0 else stop]
            name = ""
            if start:
                previous = text[text.rfind("\n", 0, start - 1) + 1 : start - 1].rstrip()
                if previous[-1:] in ("=", ":", "(", ",", "\\", "[", "{", "+"):
                    last = [m.group() for m in NAME.finditer(re.sub(r"\b(?:str|string|final|const|var|let|os|environ|get|setdefault)\b", "", previous))]
                    if last and KEY_NAME.search(last[-1]) and not BENIGN_NAME.search(last[-1]):
                        name = last[-1]
            for a, b in spans_of_line(text[start:end], following, name):
                out.append((line_no, start + a, start + b))
        return out

    def masked(self, text: str | None) -> tuple[str | None, int]:
        """(text, credentials): the text with each credential masked by as many characters of the same
        alphabet; of a private key its base64 lines. Null stays null."""
        if not text:
            return text, 0
        parts, at, found = [], 0, self.scan(text)
        for _, start, end in found:
            if start < at:
                continue
            if text.startswith("-----BEGIN", start):
                start, end = end, key_end(text, end)
                parts += [text[at:start], LETTERS.sub(like, text[start:end])]
            else:
                parts += [text[at:start], mask(text[start:end])]
            at = end
        return "".join(parts) + text[at:], len(found)

    def redact(self, text: str | None) -> str | None:
        return self.masked(text)[0]


LETTERS = re.compile(r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)|[A-Z]+|[a-z]+|[0-9]+", re.S)
MARKS = re.compile(r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)|[^\w.\-=\\]", re.S)


def like(m: re.Match, letter: str = "x") -> str:
    s = m.group()
    return s if s[0] == "\\" else ("0" if s[0].isdigit() else letter.upper() if s[0].isupper() else letter) * len(s)


def mask(value: str) -> str:
    """As many characters of the same alphabet: capitals to X, letters to x, digits to 0, or to A, a
    and 0 where all are hexadecimal; marks to ``+`` in base64 and to ``-`` elsewhere. Escapes and the
    marks that part a value (``. - _ =``) stay."""
    letter = "a" if re.fullmatch(r"[0-9a-fA-F\-]+", value) else "x"
    mark = "+" if re.fullmatch(r"[A-Za-z0-9+/]+=*", value) else "-"
    return MARKS.sub(lambda m: m.group() if m.group()[0] == "\\" else mark, LETTERS.sub(lambda m: like(m, letter), value))


FIELDS = ("full_body", "skeleton")


def credential_lines(nodes: DataFrame) -> DataFrame:
    """(node_id, field, line_no) for each line on which a credential's value starts.

    One pass without a shuffle over the texts; only the rows found are made distinct, since a
    node may occur twice. Null ids, null texts and empty texts give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for batch in batches:
            rows = [
                (i, field, line)
                for field in FIELDS
                for i, text in zip(batch["node_id"], batch[field], strict=True)
                if text
                for line in dict.fromkeys(x[0] for x in scanner.scan(text))
            ]
            yield pd.DataFrame(rows, columns=["node_id", "field", "line_no"]).astype({"node_id": "int64", "line_no": "int64"})

    texts = nodes.select(F.col("id").cast("long").alias("node_id"), *FIELDS).where("node_id is not null and (full_body is not null or skeleton is not null)")
    return texts.mapInPandas(run, "node_id long, field string, line_no long").distinct()


def redacted(nodes: DataFrame) -> DataFrame:
    """(node_id, field, masked_count, masked_text) of every text that held a credential.

    Other texts need no change and are left out; rows equal in all columns come once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for batch in batches:
            rows = []
            for field in FIELDS:
                for i, text in zip(batch["node_id"], batch[field], strict=True):
                    changed, n = scanner.masked(text)
                    if n:
                        rows.append((i, field, n, changed))
            yield pd.DataFrame(rows, columns=["node_id", "field", "masked_count", "masked_text"]).astype({"node_id": "int64", "masked_count": "int64"})

    texts = nodes.select(F.col("id").cast("long").alias("node_id"), *FIELDS).where("node_id is not null and (full_body is not null or skeleton is not null)")
    return texts.mapInPandas(run, "node_id long, field string, masked_count long, masked_text string").distinct()
