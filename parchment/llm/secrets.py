"""Secret scans by assignment-aware lexing.

Three base patterns are always reported. Besides, texts that have a sensitive
word are lexed once from left to right (strings, words, brackets, operators, line
ends) and parsed into name-literal pairs: assignments, mappings, lists, arguments
of setting calls, elements of mark-up. Names that stand for constants, and sums of
literals, are followed to what they hold; a pair scores by how sensitive its target
name is and how random its literal looks. Time is linear in the text: a constant
refers to places and to other constants, and is measured and reported once.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_batches

KINDS = ("assign", "access", "hex", "pair")  # in the order of listing

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}

#: Part of a name, after camel case and separators are parted: how sensitive it is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "secrets": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "authkey": 1.0, "bearer": 0.8, "pass": 0.7,
}
#: Words that make "key" sensitive.
KEY_OWNERS = {"api", "private", "access", "secret", "auth", "encryption", "signing", "master"}
HOLDERS = re.compile(r"(?i)^(?:change_?me|example|placeholder|your[_-].*|x+|\*+|null|none|true|false|undefined|todo.*|<.*>|\$\{?\w+\}?)$")

#: What the lexer tells apart; white space but line ends lies between tokens. Nothing is ever given back, so time is linear.
TOKEN = re.compile(
    r"""(?P<word>[A-Za-z0-9_$][A-Za-z0-9_$.@/!%^*~-]*+)|(?P<quote>["'`])"""
    r"""|(?P<op>===?|!==?|<=|>=|=>|[:+?.|&]=|::|[=:+,;()\[\]{}<>&\n])|(?P<joined>\\[^\S\n]*+\n)|(?P<other>[^\s\x00-\x7F]++|\S)"""
)
MARKS = {"=", ":", "=>", ":=", "+=", "?=", ".=", "|=", "&="}
QUOTED = {q: re.compile(rf"{q}((?:[^{q}\\\n]++|\\[\s\S])*+){q}") for q in "\"'"} | {"`": re.compile(r"`((?:[^`\\]++|\\[\s\S])*+)`")}
PREFIX = re.compile(r"""[rRbBuUfF]{1,2}(?=["'])""")
NAME = re.compile(r"[A-Za-z_$][\w.$-]*+\Z", re.ASCII)
VARIABLE = re.compile(r"\$\{?([A-Za-z_]\w*+)\}?", re.ASCII)
BARE = re.compile(r"[A-Za-z0-9+/_.@!#%^*~$-]++")
PADDING = re.compile(r"={1,2}(?=[\s,;)\]}&<]|\Z)")
ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*+)>([^<>\n]++)</\1>")

#: Calls that take a secret under their own name, by their first word; a call that is only named by a sensitive word counts too.
SETTERS = {"set", "put", "with", "add", "use", "update", "change", "store", "save", "configure", "init"}
#: Names that give the name, and names that give the value, of a pair written as two.
LABELS, VALUES = {"key", "name", "id", "field"}, {"value", "val", "content", "default"}
#: A text without any of these has no sensitive name.
STEMS = tuple(sorted(a for a in {*SENSITIVE, "key"} if not any(b != a and b in a for b in {*SENSITIVE, "key"})))

ACCEPT = 0.8


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, end, kind, value start, value end) of the base patterns."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(*m.span(), 0, *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), 1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(*m.span(), 2, *m.span()) for m in HEX.finditer(text)]
    return found


def parts_of(name: str) -> list[str]:
    return [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def sensitivity(name: str) -> float:
    parts = parts_of(name)
    joined = {a + b for a, b in zip(parts, parts[1:])}
    best = max((SENSITIVE.get(p, 0.0) for p in {*parts, *joined}), default=0.0)
    if "key" in parts and KEY_OWNERS & set(parts):
        best = 1.0
    return best


_CLASSES = (re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"[0-9]"), re.compile(r"[^A-Za-z0-9]"))
_MOST = 1e300  # lengths of repeatedly doubled constants stop here
_SHORT = 200  # values up to here are compared with the placeholders as they are


class Value:
    """What a name stands for: places of literals, and other values, in order. Nothing is copied from the text.

    Counts of characters are summed when they are first asked for, each value once.
    """

    __slots__ = ("parts", "counts", "length", "classes", "blank", "short", "told")

    def __init__(self, parts: tuple):
        self.parts, self.counts, self.told = parts, None, False

    def measure(self, text: str) -> None:
        stack = [self]
        while stack:
            v = stack[-1]
            if v.counts is not None:
                stack.pop()
                continue
            waiting = [p for p in v.parts if isinstance(p, Value) and p.counts is None]
            if waiting:
                stack += waiting
                continue
            stack.pop()
            counts: dict[str, float] = {}
            v.length, v.classes, v.blank, v.short = 0.0, set(), False, ""
            for p in v.parts:
                if isinstance(p, Value):
                    own, length, classes, blank, short = p.counts, p.length, p.classes, p.blank, p.short
                else:
                    piece = text[p[0] : p[1]]
                    own, length, short = Counter(piece), len(piece), piece if len(piece) <= _SHORT else None
                    classes, blank = {k for k, c in enumerate(_CLASSES) if c.search(piece)}, any(map(str.isspace, own))
                for c, n in own.items():
                    counts[c] = min(_MOST, counts.get(c, 0.0) + n)
                v.length, v.classes, v.blank = min(_MOST, v.length + length), v.classes | classes, v.blank or blank
                v.short = v.short + short if v.short is not None and short is not None and len(v.short) + len(short) <= _SHORT else None
            v.counts = counts

    def randomness(self, text: str) -> float:
        """0 to 1: few classes of characters and little entropy look like words."""
        self.measure(text)
        if self.length < 6 or self.blank or (self.short is not None and HOLDERS.match(self.short)) or self.counts.keys() <= {"x", "X"} or self.counts.keys() == {"*"}:
            return 0.0
        total = sum(self.counts.values())
        entropy = -sum(n / total * math.log2(n / total) for n in self.counts.values() if n)
        return min(1.0, (len(self.classes) - 1) / 2 * 0.6 + min(entropy, 4.0) / 4.0 * 0.4)

    def places(self):
        """Places not told before, of this value and those it is made of."""
        stack = [self]
        while stack:
            v = stack.pop()
            if not v.told:
                v.told = True
                for p in v.parts:
                    if isinstance(p, Value):
                        stack.append(p)
                    else:
                        yield p


_PLAIN = ("(", None)


class Parser:
    """Name-literal pairs of a text, read once from left to right.

    A mark (= : => := += and so on) gives the name before it a value: literals,
    names of held constants, and sums of these, over line ends where brackets,
    a backslash or a + say so. Elements of a list and arguments of a setting call
    are values of the list's or call's name; an argument that is a sensitive name
    names the next ones. A value with anything else in it isn't known.
    """

    def __init__(self, text: str):
        self.text = text
        self.held: dict[str, Value] = {}
        self.found: list[tuple[str, Value, bool]] = []
        self.frames: list[tuple] = []  # (bracket, name of its elements)
        self.name: str | None = None  # what a mark or bracket right here would refer to
        self.label: str | None = None
        self.dead = {'"': -1, "'": -1, "`": -1}  # no string of this kind opens before that place
        self.begin(None)
        self.state = ""

    # An expression: its name, its parts, whether a literal is quoted, whether all of it is known.
    def begin(self, target: str | None, *parts) -> None:
        self.target, self.parts, self.quoted, self.known, self.annotation, self.holds = target, list(parts), False, True, False, False
        self.state = "operand" if target is not None else ""

    def finish(self) -> None:
        if self.target and self.known and self.parts:
            value = Value(tuple(self.parts))
            last = self.target.split(".")[-1].lower()
            if self.holds:
                self.held[self.target.split(".")[-1]] = value
            self.found.append((self.target, value, self.quoted))
            if last in LABELS and self.parts and not isinstance(self.parts[0], Value):
                a, b = self.parts[0]
                self.label = self.text[a:b] if b - a <= _SHORT else None
            elif last in VALUES and self.label:
                self.found.append((self.label, value, self.quoted))
                self.label = None
        self.begin(None)

    def string(self, i: int) -> tuple[int, int, int] | None:
        """Start, end of a literal's characters and where it closes, if one opens at i."""
        text, q = self.text, self.text[i]
        if text.startswith(q * 3, i) and q != "`":
            j = text.find(q * 3, i + 3) if self.dead.get(q * 3, 0) <= i else -1
            if j >= 0:
                return i + 3, j, j + 3
            self.dead[q * 3] = len(text)
        if i < self.dead[q]:
            return None
        m = QUOTED[q].match(text, i)
        if m:
            return m.start(1), m.end(1), m.end()
        end = text.find("\n", i) if q != "`" else -1
        self.dead[q] = end if end >= 0 else len(text)
        return None

    def run(self) -> list[tuple[str, Value, bool]]:
        text, i, n = self.text, 0, len(self.text)
        while i < n:
            if self.state == "operand":
                i = self.operand(i)
                continue
            m = TOKEN.search(text, i)
            if not m:
                break
            i = self.token(m)
        self.finish()
        return self.found

    def operand(self, i: int) -> int:
        text = self.text
        while i < len(text) and text[i] in " \t\r\f\v":
            i += 1
        if i == len(text):
            return i
        c = text[i]
        at = PREFIX.match(text, i)
        if at or c in "\"'`":
            s = self.string(at.end() if at else i)
            if s:
                self.parts.append(s[:2])
                self.quoted, self.state = True, "after"
                self.name = text[s[0] : s[1]] if s[1] - s[0] <= _SHORT else None
                self.literal(s[0], s[1])
                return s[2]
            if not at:
                self.known, self.state = False, "after"
                return i + 1
        if c == "\n":
            if self.parts or self.frames and self.frames[-1][0] != "{":
                return i + 1
            k = i + 1
            while k < len(text) and text[k] in " \t\r":
                k += 1
            if k < len(text) and text[k] in "\"'" and not self.annotated(k):
                return k
            self.begin(None)
            return i
        if c == "\\" and (m := TOKEN.match(text, i)) and m.lastgroup == "joined":
            return m.end()
        if c in "([":
            self.frames.append((c, self.target))
            self.holds = self.holds and c == "("
            return i + 1
        if c == "{":
            self.begin(None)
            return i
        if (m := VARIABLE.match(text, i)) and m[1] in self.held:
            self.parts.append(self.held[m[1]])
            self.quoted, self.state, self.name = True, "after", None
            return m.end()
        m = BARE.match(text, i)
        if not m:
            self.known, self.state, self.name = False, "after", None
            return i if c in ",;)]}<>&" else i + 1
        word, end = m[0], m.end()
        if len(word) > 8 and (pad := PADDING.match(text, end)) and (pad.end() - i) % 4 == 0:
            word, end = word + pad[0], pad.end()
        own = word.split("+", 1)[0]
        if own != word and own.split(".")[-1] in self.held:  # a + of the expression
            word, end = own, i + len(own)
        self.name, self.state = word if NAME.match(word) else None, "after"
        if text[end : end + 1] in ("(", "["):
            self.known = False
        elif word.split(".")[-1] in self.held and not self.annotation:
            self.parts.append(self.held[word.split(".")[-1]])
            self.quoted = True
        elif self.parts:
            self.known = False
        else:
            self.annotation = True
            self.parts.append((i, i + len(word.rstrip(".,"))))
        return end

    def annotated(self, k: int) -> bool:
        """Whether the string at k is itself a name, as in the next line of a mapping."""
        s = self.string(k)
        if not s:
            return True
        e = s[2]
        while e < len(self.text) and self.text[e] in " \t":
            e += 1
        return self.text[e : e + 1] in (":", "=")

    def literal(self, a: int, b: int) -> None:
        """A first argument that is a sensitive name names the arguments that follow."""
        if self.frames and self.frames[-1][0] == "call" and self.frames[-1][1] in (None, "") and b - a <= _SHORT and NAME.match(self.text[a:b]) and sensitivity(self.text[a:b]) >= 0.7:
            self.frames[-1] = ("call", self.text[a:b])

    def token(self, m: re.Match) -> int:
        text, kind, end = self.text, m.lastgroup, m.end()
        if kind == "joined":
            return end
        if kind == "quote":
            i = m.start()
            before = text[i - 1 : i]
            s = self.string(i) if not before.isalnum() or (self.name and len(self.name) <= 2 and PREFIX.match(text, i - len(self.name))) else None
            if not s:
                self.finish()
                self.name = None
                return end
            if self.state == "after" and self.known and self.quoted:  # literals side by side are one
                self.parts.append(s[:2])
                return s[2]
            self.finish()
            self.name = text[s[0] : s[1]]
            if self.frames and self.frames[-1][0] == "index":
                self.frames[-1] = ("index", self.name)
            return s[2]
        if kind == "word":
            self.finish()
            word = NAME.search(m[0]) if NAME.match(m[0]) is None else NAME.match(m[0])
            self.name = word[0] if word else None
            return end
        if kind == "other":
            self.finish()
            self.name = None
            return end
        return self.operator(m[0], end)

    def operator(self, op: str, end: int) -> int:
        frame = self.frames[-1] if self.frames else None
        if op in MARKS:
            target = self.name
            if op == "=" and self.annotation and self.target and self.name and sensitivity(self.name) < 0.7:
                target = self.target  # a type stood between name and value
                self.parts = []
            if op in (":", "=>") and self.state == "after" and self.quoted and len(self.parts) == 1:
                self.parts = []  # a key of a mapping
            held = self.held.get(target.split(".")[-1]) if target and op in ("+=", ".=") else None
            self.finish()
            self.name = None
            if target:
                self.begin(target, *([held] if held else []))
                self.holds = op not in (":", "=>")  # keys of mappings aren't constants
        elif op == "+" and self.state == "after":
            self.state = "operand"
            self.annotation = False
        elif op == "\n":
            if self.state == "after" and not (frame and frame[0] != "{"):
                k = end
                while k < len(self.text) and self.text[k] in " \t\r":
                    k += 1
                if self.text[k : k + 1] == "+" and self.quoted:
                    return k
                self.finish()
            self.name = None
        elif op in "([{":
            name, was = self.name, self.state
            self.finish()
            self.name = None
            if op == "(" and name:
                words = parts_of(name.split(".")[-1])
                sets = sensitivity(name.split(".")[-1]) >= 0.7 and (words[:1] and words[0] in SETTERS or all(w in SENSITIVE or w in KEY_OWNERS or w == "key" for w in words))
                self.frames.append(("call", name.split(".")[-1] if sets else ""))
                self.begin(self.frames[-1][1])
            elif op == "[" and name and was != "operand":
                self.frames.append(("index", None))
            else:
                self.frames.append(_PLAIN if op != "{" else ("{", None))
        elif op in ")]}":
            if op == ")" and frame and frame[0] == "(" and self.state == "after":
                self.frames.pop()  # a group: the expression goes on
                return end
            self.finish()
            self.name = None
            if frame:
                self.frames.pop()
                if op == "]" and frame[0] == "index":
                    self.name = frame[1]
                elif frame[0] == "[" and frame[1]:  # a list is no constant
                    self.held.pop(frame[1].split(".")[-1], None)
            if op == "}":
                self.label = None
        elif op == ",":
            self.finish()
            self.name = None
            if frame and frame[0] in ("(", "[", "call") and frame[1] is not None:
                self.begin(frame[1])
        else:
            self.finish()
            self.name = None
        return end


def pairs(text: str) -> list[tuple[str, Value, bool]]:
    """(name, value, quoted) of every assignment, constants followed."""
    found = Parser(text).run()
    if "</" in text:
        found += [(m[1], Value((m.span(2),)), False) for m in ELEMENT.finditer(text)]
    return found


def outside(spans: set, base: list) -> list:
    """spans that no base span covers whole."""
    reach, kept, k = -1, [], 0
    for s in sorted(spans):
        while k < len(base) and base[k][0] <= s[0]:
            reach, k = max(reach, base[k][1]), k + 1
        if s[1] > reach:
            kept.append(s)
    return kept


def scan_text(text: str | None) -> tuple[list, list]:
    """Base spans, and all spans, each (start, end, kind, value start, value end) in order."""
    text = text or ""
    base = sorted(base_spans(text), key=lambda s: (s[0], s[2]))
    more = set()
    low = text.lower()
    if any(stem in low for stem in STEMS):
        for name, value, quoted in pairs(text):
            s = sensitivity(name)
            if s >= 0.7 and not value.told and 0.6 * s + 0.3 * value.randomness(text) + 0.1 * quoted >= ACCEPT:
                more |= {(a, b, 3, a, b) for a, b in value.places() if b > a}
    more = outside(more, base)
    return base, sorted([*base, *more], key=lambda s: (s[0], s[2]))


def listed(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k, *_ in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end in code points, by start and then kind.

    Defined cases: a null or empty text has no spans, and base_sha256 is that
    of the empty string; a literal reached by several names, or that a base span
    covers whole, is reported once; a quote that closes nowhere opens no string,
    nor do others of its kind up to the end of its line; repeated rows each get
    their row; an empty table gives no rows; columns beyond doc_id and text are
    not read.
    """

    @F.pandas_udf(SCHEMA)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, every = scan_text(t)
            n = [sum(s[2] == k for s in base) for k in range(3)]
            rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    text_batches(docs.sparkSession)
    return docs.select("doc_id", scan("text").alias("r")).select("doc_id", "r.*")


def redact(text: str | None, by: str = "[REDACTED]") -> str | None:
    """text with the value of every span replaced; null stays null."""
    if not text:
        return text
    spans = sorted((a, b) for *_, a, b in scan_text(text)[1])
    out, at = [], 0
    for a, b in spans:
        if b > at:
            out += [text[at:a], by] if a >= at else []
            at = b
    return "".join([*out, text[at:]]) if spans else text


def redacted(text: str = "text") -> Column:
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redact, na_action="ignore")

    return clean(text)
