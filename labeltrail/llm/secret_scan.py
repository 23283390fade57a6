"""Secret scan: fixed patterns, and an assignment-aware reading of source and configuration text.

Lines that assign something are lexed into names, literals and signs. Their
name-literal pairs are collected (``name = "x"``, ``"name": "x"``, ``name: x``, ``NAME=x``, ``obj["name"] = "x"``,
``name: type = "x"``, ``f(name="x")``, ``a => 'x'``, ``"x" + "y"``, ``name += "x"``, ``name ||= "x"``, ``y or "x"``,
``y ? "x" : "z"``, ``new String("x")``, ``getenv("NAME", "x")``), besides ``set("name", "x")`` and ``<name>x</name>``. A value may start on the next line, be a string
with a prefix or in three quotes, go over lines, stand in brackets or be a YAML block or list; of a bracket that is never closed,
only the strings right after it are taken. Constants are followed
to the names that get them later, and a literal is scored by the name it ends up
under and by its own look. Those that reach the threshold are reported besides the patterns' matches.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltrail.llm.common import Batches, ddl, map_arrow, numbered, place, record_batch, slices, table, whole_text

KINDS = ("assign", "access", "hex", "lex")
#: Fixed patterns and least lengths of what they find.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the same as the runs of [0-9a-f]+ that have 24 characters or more
_LEAST_ASSIGN, _LEAST_ACCESS = 6, 20

THRESHOLD = 4.0
#: What a word in a target name says about its value.
_NAME_WORDS = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "secrets": 2, "token": 3, "apikey": 3,
    "credential": 3, "credentials": 3, "auth": 1, "bearer": 2, "private": 1, "access": 1, "api": 1, "key": 1, "signing": 1,
    "encryption": 1, "client": 0, "pwds": 3, "passwords": 3, "passphrases": 3,
}
_HARMLESS_WORDS = {
    "name": -2, "file": -2, "path": -2, "url": -2, "uri": -2, "count": -3, "counts": -3, "length": -3, "size": -3, "type": -2,
    "field": -2, "label": -2, "hint": -2, "prompt": -2, "policy": -2, "expires": -3, "expiry": -3, "ttl": -3, "limit": -3,
    "public": -2, "max": -2, "min": -2, "id": -1,
}
_PLACEHOLDER = re.compile(r"^(?:<.*>|\$\{?.*|%.*%|\{\{.*|x{4,}|\*{3,}|\.{3,}|none|null|true|false)$|change_?me|example|your[_-]|placeholder|redacted", re.IGNORECASE)
_SENSITIVE = re.compile(r"pass|pwd|secret|token|key|credential|bearer|auth", re.IGNORECASE)
_SIGN = re.compile("[:=]")
_TOKEN = re.compile(
    r"""(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"""
    r"""|(?P<name>[^\W\d][\w.$-]*)|(?P<sign>:=|=>|\|\|=|\?\?=|\?=|\+=|[=!<>]=|[=:,;+(){}\[\]<>])"""
    r"""|(?P<other>\|\|(?!=)|\?\?(?!=)|(?:(?!\|\||\?\?|\?=)[^\s"'`=:,;+(){}\[\]<>])+|["'`])"""
)
_BARE = re.compile(r"[^\s,;\"'`(){}\[\]<>]+")
_STRING = re.compile(r"""(?:[rbuf]{1,2}(?=["']))?("(?!"")(?:[^"\\\n]|\\.)*"|'(?!'')(?:[^'\\\n]|\\.)*'|`[^`\n]*`)""", re.IGNORECASE)
_QUOTE = re.compile(r"""(?:[rbuf]{1,2}(?=["']))?(\"{3}|'{3}|["'`])""", re.IGNORECASE)
_PREFIX = re.compile(r"[rbuf]{1,2}", re.IGNORECASE)
_PLUS = re.compile(r"\s*\+\s*")
_KEY = re.compile(r"\s*(?:[:=])")
_BLOCK = re.compile(r"[|>][-+0-9]*[^\S\n]*(?:#[^\n]*)?(?:\n|$)")
_SPACE = re.compile(r"[^\S\n]*")
_ROW = re.compile(r"([^\S\n]*)([^\n]*)(?:\n|$)")
_LONE = re.compile(r"(?![\w.$-]+[:=]+[^\s=])[^\s,;#\"'`(){}\[\]<>][^\s,;\"'`(){}\[\]<>]*(?<!:)")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_ASSIGNS = ("=", ":", ":=", "=>", "+=", "||=", "??=", "?=")
_CHOICE = ("or", "and", "if", "else", "||", "&&", "??", "?")  # what joins the operands of an expression
_PASSED = re.compile(r"""\(\s*(["'])([\w.-]{1,100})\1\s*,\s*(["'])([^"'\n]{1,1000})\3\s*\)""")  # set("name", "value")
_ELEMENT = re.compile(r"<([A-Za-z][\w.:-]{0,100})>([^<>\n]{1,1000})</\1>")
_LOOKUP = re.compile(r"env|get|read|load|prompt|input", re.IGNORECASE)
MOST_PARTS = 64  # a value made of more literals is not joined with all behind it: each of them is scored by itself


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``start, kind, end, start of the value`` of the fixed patterns' matches, leftmost and not overlapping within a kind."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST_ASSIGN]
    found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if len(m[0]) >= _LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(found)


# --- assignments ----------------------------------------------------------------------


@dataclass
class Assignment:
    name: str
    at: int
    literals: list[tuple[int, int]] = field(default_factory=list)  # places of literal parts
    uses: list[str] = field(default_factory=list)  # names that the value is built from
    bare: bool = False  # the value is one word, which is a literal if it is no known name


def _inside(m: re.Match) -> tuple[int, int]:
    return (m.start() + 1, m.end() - 1) if m.lastgroup == "string" else (m.start(), m.end())


def assigning_lines(text: str) -> list[tuple[int, int]]:
    """Begin and end of the lines that have a colon or an equals sign."""
    found, at = [], 0
    while sign := _SIGN.search(text, at):
        begin = max(at, text.rfind("\n", at, sign.start()) + 1)
        end = text.find("\n", sign.start())
        at = len(text) if end < 0 else end
        found.append((begin, at))
    return found


def _stripped(text: str, begin: int, end: int) -> tuple[int, int]:
    inner = text[begin:end]
    return begin + len(inner) - len(inner.lstrip()), begin + len(inner.rstrip())


class Brackets:
    """Closing places of a text's brackets, found once when asked for."""

    def __init__(self, text: str):
        self.text, self.ends = text, None

    def end(self, at: int) -> int | None:
        if self.ends is None:
            self.ends, open_ = {}, []
            for m in _TOKEN.finditer(self.text):
                if m.lastgroup == "sign" and m[0] in "([{":
                    open_.append(m)
                elif m.lastgroup == "sign" and m[0] in ")]}" and open_ and "([{".index(open_[-1][0]) == ")]}".index(m[0]):
                    self.ends[open_.pop().start()] = m.start()
        return self.ends.get(at)

    def strings(self, at: int) -> list[tuple[int, int]]:
        """Strings in the bracket, but for keys and what is assigned to them."""
        found, end, before = [], self.end(at), ""
        at += 1
        if end is None:
            return _strings(self.text, at)
        while at < end:
            quote = _QUOTE.match(self.text, at)
            string = quote and (_STRING.match(self.text, at) if len(quote[1]) == 1 else None)
            if quote and len(quote[1]) == 3:
                close = self.text.find(quote[1], quote.end(), end)
                inside, after = (quote.end(), close), close + 3
                if close < 0:
                    break
            elif string:
                inside, after = (string.start(1) + 1, string.end() - 1), string.end()
            else:
                word = _TOKEN.match(self.text, at, end)
                if word and word[0] in "([{" and before in (":", "=", ":=", "=>") and self.end(at) is not None:  # of another name
                    before, at = "", self.end(at) + 1
                    continue
                before = word[0] if word else before
                at = word.end() if word else at + 1
                continue
            if before not in (":", "=", ":=", "=>") and not _KEY.match(self.text, after, end):
                found.append(_stripped(self.text, *inside))
            before, at = "", after
        return found


def _strings(text: str, at: int) -> list[tuple[int, int]]:
    """Strings joined by +, over lines; none if the first is a key."""
    found = []
    while m := _STRING.match(text, at):
        found.append((m.start(1) + 1, m.end() - 1))
        plus = _PLUS.match(text, m.end())
        if not plus:
            return [] if len(found) == 1 and _KEY.match(text, m.end()) else found
        at = plus.end()
    return found


def _rows(text: str, at: int, least: int) -> Iterator[tuple[int, int]]:
    """Lines from ``at`` on that are indented by ``least`` or more."""
    while at < len(text):
        m = _ROW.match(text, at)
        if m[2].strip():
            if len(m[1]) < least:
                return
            yield _stripped(text, *m.span(2))
        at = m.end()


def _beyond(text: str, sign: str, at: int, indent: int, key: int, end: int, brackets: Brackets) -> list[tuple[int, int]]:
    """Literals of a value that one line does not hold, or that stands in brackets.

    ``indent`` is that of the line, ``key`` that of what the line has after the dashes of a list.
    """
    while at < len(text) and text[at].isspace():
        at += 1
    if at >= len(text):
        return []
    if text[at] in "([{":
        return brackets.strings(at)
    quote = _QUOTE.match(text, at)
    if quote and (len(quote[1]) == 3 or not _STRING.match(text, at)):
        close = text.find(quote[1], quote.end())
        if close < 0:
            return []
        return [_stripped(text, quote.end(), close)]
    if at < end:
        block = _BLOCK.match(text, at)
        return list(_rows(text, block.end(), indent + 1)) if block else []
    if quote:
        return _strings(text, at)
    row = text.rfind("\n", 0, at) + 1
    if text.startswith("- ", at):
        found = []
        if at - row < key:  # the next item of the list that the line is in
            return found
        for a, b in _rows(text, row, at - row):
            if not text.startswith("- ", a):
                break
            a, b = _stripped(text, a + 1, b)
            found += _strings(text, a) or ([(a, b)] if _LONE.fullmatch(text, a, b) else [])
        return found
    a, b = next(_rows(text, row, 0))
    deep = at - row > indent or sign == ":"
    return [(a, b)] if deep and _LONE.fullmatch(text, a, b) else []


def assignments(text: str, lines: list[tuple[int, int]]) -> Iterator[Assignment]:
    """Name-literal and name-name pairs of the lines, in order."""
    brackets = Brackets(text)
    for begin, end in lines:
        tokens = list(_TOKEN.finditer(text, begin, end))
        indent = key = _SPACE.match(text, begin, end).end() - begin
        while text.startswith("- ", begin + key):
            key += 2
        k = 0
        while k < len(tokens):
            target = _target(text, tokens, k)
            if target is None:
                k += 1
                continue
            name, value = target
            made, k = _value(text, tokens, value, end, brackets)
            last = tokens[k - 1]
            if more := _beyond(text, tokens[value - 1][0], tokens[value - 1].end(), indent, key, end, brackets):
                made, k = Assignment("", 0, more), max(value, k if k >= len(tokens) else value)
            elif k >= len(tokens) and last[0] == "+" and k > value:
                at = _PLUS.match(text, last.start()).end()
                made.literals += _strings(text, at)
            if made.literals or made.uses:
                made.name, made.at = name, tokens[value - 1].start()
                yield made


def _target(text: str, tokens: list[re.Match], k: int) -> tuple[str, int] | None:
    """If token ``k`` assigns: the target's name, and the first token of the value."""
    sign = tokens[k][0]
    if tokens[k].lastgroup != "sign" or sign not in _ASSIGNS or k == 0:
        return None
    before = k - 1
    if tokens[before][0] == "]" and before >= 2:  # obj["name"] = ...
        before -= 1
    if tokens[before].lastgroup not in ("string", "name"):
        return None
    if sign == ":" and k + 2 < len(tokens) and tokens[k + 1].lastgroup == "name" and tokens[k + 2][0] == "=":
        k += 2  # name: type = ...
    a, b = _inside(tokens[before])
    return text[a:b], k + 1


def _operands(tokens: list[re.Match], k: int) -> tuple[list[tuple[int, int]], int]:
    """Strings of the rest of an expression, up to a comma, a semicolon or the bracket around it; and the token after it."""
    found, depth = [], 0
    while k < len(tokens):
        sign = tokens[k][0] if tokens[k].lastgroup == "sign" else ""
        depth += (sign in ("(", "[", "{")) - (sign in (")", "]", "}"))
        if depth < 0 or (depth == 0 and sign in (",", ";", "=", ":=", "=>")):
            break
        compared = tokens[k - 1][0] in ("==", "!=") or (k + 1 < len(tokens) and tokens[k + 1][0] in ("==", "!="))
        if tokens[k].lastgroup == "string" and depth == 0 and not compared:
            found.append(_inside(tokens[k]))
        k += 1
    return found, k


def _arguments(text: str, name: str, open_: re.Match, brackets: Brackets) -> list[tuple[int, int]]:
    """Strings that a call is given as values; the first of several is a key, and one alone is a key of a look-up."""
    found, end = [], brackets.end(open_.start())
    at = open_.end()
    while end is not None and at < end:
        word = _TOKEN.match(text, at, end)
        if word is None:
            at += 1
            continue
        if word[0] in ("(", "[", "{") and brackets.end(word.start()) is not None:
            return []  # calls of calls are no constants
        if word.lastgroup == "string":
            found.append(_inside(word))
        at = word.end()
    return found[1:] if len(found) > 1 else [] if _LOOKUP.search(name) else found


def _value(text: str, tokens: list[re.Match], k: int, line_end: int, brackets: Brackets) -> tuple[Assignment, int]:
    """Literals and names joined by +, other operands of the expression, strings of a call, or one bare word; and the token after it."""
    made = Assignment("", 0)
    first = k
    if k < len(tokens) and tokens[k][0] == "new" and k + 1 < len(tokens) and tokens[k + 1].lastgroup == "name":
        k += 1
    if k + 1 < len(tokens) and tokens[k].lastgroup == "name" and tokens[k + 1][0] == "(" and tokens[k + 1].start() == tokens[k].end():
        made.literals += _arguments(text, tokens[k][0], tokens[k + 1], brackets)
        end = brackets.end(tokens[k + 1].start())
        while end is not None and k < len(tokens) and tokens[k].start() <= end:
            k += 1
        if end is not None:
            if k < len(tokens) and tokens[k][0] in _CHOICE:
                more, k = _operands(tokens, k)
                made.literals += more
            return made, max(k, first)
        k = first
    while k < len(tokens):
        token = tokens[k]
        following = tokens[k + 1] if k + 1 < len(tokens) else None
        if token.lastgroup == "name" and following and following.lastgroup == "string" and following.start() == token.end() and _PREFIX.fullmatch(token[0]):
            a, b = _inside(following)
            if not ("f" in token[0].lower() and re.fullmatch(r"\{[^{}]*\}", text[a:b])):
                made.literals.append((a, b))
            k += 1
        elif token.lastgroup == "string":
            made.literals.append(_inside(token))
        elif token.lastgroup == "name" or (token.lastgroup == "other" and k == first):
            bare = _BARE.match(text, token.start(), line_end)
            joined = k + 1 < len(tokens) and tokens[k + 1][0] == "+"
            if token.lastgroup == "name" and (bare is None or bare.end() == token.end() or joined):
                made.uses.append(token[0])
                indexed = following is not None and following[0] == "[" and following.start() == token.end()
                if k == first and not joined and not indexed:
                    made.literals.append((token.start(), token.end()))
                    made.bare = True
            elif bare is not None:
                made.literals.append((bare.start(), bare.end()))
                while k + 1 < len(tokens) and tokens[k + 1].start() < bare.end():
                    k += 1
        else:
            break
        k += 1
        if k < len(tokens) and tokens[k][0] == "+":
            k += 1
        elif k < len(tokens) and tokens[k][0] in _CHOICE and tokens[k].start() > tokens[k - 1].end() and made.uses + made.literals:
            if made.bare:
                made.literals.clear()  # an operand is a name, not a word
                made.bare = False
            more, k = _operands(tokens, k)
            made.literals += more
            break
        elif not (k < len(tokens) and tokens[k].lastgroup == tokens[k - 1].lastgroup == "string"):
            break
    return made, max(k, first)


class Constants:
    """The assignments of a text by name, to follow a name to the literals behind it.

    Each assignment is settled once: those that refer to each other in a circle share what any of them reaches.
    The literals of a value are held together up to ``MOST_PARTS``. Of a larger one, ``large``, those at its own place
    are, so that the work is linear, and ``scored`` hands each literal that it reaches the best name above it.
    """

    def __init__(self, made: list[Assignment]):
        self.made = made
        self.by_name: dict[str, list[int]] = {}
        for k, a in enumerate(made):
            self.by_name.setdefault(a.name, []).append(k)
        self.settled: list[frozenset | None] = [None] * len(made)
        self.parts: list[tuple[list[int], set[int], list[tuple[int, int]]]] = []  # members, what they use, own literals
        self.part_of = [0] * len(made)
        self.large: set[int] = set()  # parts that reach more literals than are held together
        for k in range(len(made)):
            if self.settled[k] is None:
                self._settle(k)

    def _behind(self, name: str, k: int) -> int | None:
        """The last assignment of the name before, or else the first after."""
        own = self.by_name.get(name)
        if not own:
            return None
        before = bisect_left(own, k)
        return own[before - 1] if before else own[0]

    def _reached(self, k: int) -> list[int]:
        found = (self._behind(u, k) for u in self.made[k].uses)
        return [b for b in found if b is not None and b != k]

    def _own(self, k: int, behind: list[int]) -> list[tuple[int, int]]:
        return [] if self.made[k].bare and behind else self.made[k].literals

    def _settle(self, start: int) -> None:
        """Strongly connected parts in depth-first order, without recursion."""
        order: dict[int, int] = {start: 0}
        low, open_, held = {start: 0}, [start], {start}
        behind = {start: self._reached(start)}
        path = [(start, iter(behind[start]))]
        while path:
            k, rest = path[-1]
            for b in rest:
                if self.settled[b] is not None:
                    continue
                if b not in order:
                    order[b] = low[b] = len(order)
                    open_.append(b)
                    held.add(b)
                    behind[b] = self._reached(b)
                    path.append((b, iter(behind[b])))
                    break
                if b in held:
                    low[k] = min(low[k], order[b])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[k])
                if low[k] == order[k]:
                    part = []
                    while not part or part[-1] != k:
                        part.append(open_.pop())
                        held.discard(part[-1])
                    self._share(part, behind)

    def _share(self, part: list[int], behind: dict[int, list[int]]) -> None:
        inside = set(part)
        outer = {b for k in part for b in behind[k] if b not in inside}
        own = [x for k in part for x in self._own(k, behind[k])]
        number = len(self.parts)
        self.parts.append((part, {self.part_of[b] for b in outer}, own))
        for k in part:
            self.part_of[k] = number
        sets = {self.settled[b] for b in outer}
        if len(sets) == 1 and not own:
            one = next(iter(sets))
        elif any(len(s) > MOST_PARTS for s in sets):
            one = None
        else:
            one = frozenset(own).union(*sets)
            one = one if len(one) <= MOST_PARTS else None
        if one is None or any(p in self.large for p in self.parts[number][1]):
            self.large.add(number)
        for k in part:
            self.settled[k] = frozenset(self._own(k, behind[k])) if one is None else one

    def scored(self, scores: list[float]) -> dict[tuple[int, int], float]:
        """Every literal that a large value reaches, with the best of the scores of the large values it ends up in.

        Parts come after all that they use, so one pass from the last to the first hands the scores down.
        """
        best = [-math.inf] * len(self.parts)
        found: dict[tuple[int, int], float] = {}
        for number in range(len(self.parts) - 1, -1, -1):
            members, used, own = self.parts[number]
            if number in self.large:
                best[number] = max(best[number], *(scores[k] for k in members))
            if best[number] == -math.inf:
                continue
            for p in used:
                best[p] = max(best[p], best[number])
            for x in own:
                found[x] = max(found.get(x, -math.inf), best[number])
        return found


def name_score(name: str) -> float:
    words = [w.lower() for w in _WORD.findall(name)]
    return sum(_NAME_WORDS.get(w, 0) + _HARMLESS_WORDS.get(w, 0) for w in dict.fromkeys(words))


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: length, kinds of characters, entropy; no placeholder, no sentence."""
    if len(value) < 6 or _PLACEHOLDER.search(value):
        return -4.0
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^\w\s]"))
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    return (kinds >= 2) * 1.0 + (bool(re.search("[0-9]", value))) * 1.0 + (entropy >= 3) * 1.0 - 2.0 * bool(re.search(r"\s", value)) - 2.0 * (kinds < 2)


def _tells(name: str, value: str, threshold: float) -> bool:
    by_name = name_score(name)
    return by_name >= 2 and by_name + literal_score(value) >= threshold


def lexed_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """``start, kind, end, start`` of the literals that end up under sensitive names."""
    if not _SENSITIVE.search(text):
        return []
    found = {m.span(part) for pattern, name, part in ((_PASSED, 2, 4), (_ELEMENT, 1, 2)) for m in pattern.finditer(text) if _tells(m[name], m[part], threshold)}
    lines = assigning_lines(text)
    made = list(assignments(text, lines)) if any(_SENSITIVE.search(text, *line) for line in lines) else []
    constants = Constants(made)
    scores = [name_score(a.name) for a in made]
    for (s, e), by_name in constants.scored(scores).items() if constants.large else ():
        if by_name >= 2 and by_name + literal_score(text[s:e]) >= threshold:
            found.add((s, e))
    looks: dict[frozenset, float] = {}
    told: set[frozenset] = set()
    for k, by_name in enumerate(scores):
        parts = constants.settled[k]
        if by_name < 2 or not parts:
            continue
        if parts not in looks:
            looks[parts] = literal_score("".join(text[s:e] for s, e in sorted(parts)))
        if by_name + looks[parts] >= threshold and parts not in told:
            told.add(parts)
            found.update(parts)
    return sorted((s, 3, e, s) for s, e in found if e > s)


def spans_of(text: str) -> list[tuple[int, int, int, int]]:
    """All spans, base and lexed, by start, then kind, then end."""
    return sorted({*base_spans(text), *lexed_spans(text)})


def written(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


def redacted(text: str, spans: list[tuple[int, int, int, int]], mark: str = "[secret]") -> str:
    """The text with the values of all spans replaced; overlapping ones by one mark."""
    out, at = [], 0
    for start, end in sorted((value, end) for _, _, end, value in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


# --- Spark ----------------------------------------------------------------------------

_FOUND = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:3]], ("base_sha256", pa.string()), ("spans", pa.string())])


def _scan_part(batches: Batches) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            spans = spans_of(text)
            base = [s for s in spans if s[1] < 3]
            kinds = Counter(s[1] for s in base)
            digest = hashlib.sha256(written(base).encode()).hexdigest()
            rows.append((doc, *(kinds[k] for k in range(3)), digest, written(spans)))
        yield record_batch(_FOUND, [list(c) for c in zip(*rows)] if rows else [[]] * len(_FOUND))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row.

    Counts and digest are those of the fixed patterns, ``spans`` has the lexed literals too (kind ``lex``).
    A null text is empty and has no span; repeated rows give repeated rows, null ids stay; other columns are not looked at.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return map_arrow(own, _scan_part, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redact_part(batches: Batches, where: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [None if t is None else redacted(t, spans_of(t)) for t in batch.column(0).to_pylist()]
        columns = [*batch.columns]
        columns[1 + where] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The same rows and columns with secrets in ``text`` replaced; ``n_chars``, where it is there, follows a changed text. A null text stays null."""
    own = numbered(docs)
    where = place(docs, text)
    changed = map_arrow(
        own.select(F.col(where).alias("before"), *own.columns), _redact_part, f"before string, {ddl(own)}", own.columns.index(where)
    )
    if n_chars in docs.columns:
        count = place(docs, n_chars)
        length = F.length(where).cast(docs.schema[n_chars].dataType)
        changed = changed.withColumn(count, F.when(F.col(where) == F.col("before"), F.col(count)).when(F.col(where).isNull(), F.col(count)).otherwise(length))
    return changed.select(*own.columns).toDF(*docs.columns)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return scan(table(spark, sf_dir, "documents"))
