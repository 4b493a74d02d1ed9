"""Declarations of languages with braces, by one pass over their tokens.

A token is a name, a number, a string, or a sign; comments and white space are
none, so nothing in a string or comment opens or ends a body and a hash over
tokens does not change with the layout.  Brackets are paired first; regions
between them are then read for declarations, each with the scope it stands in.
Every token is in one region, heads end at the next keyword of their kind, and
unclosed brackets end with the text, so the time is linear in its length.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

_NAME = r"[A-Za-z_$\u0080-\U0010ffff][\w$]*"
_STRINGS = {
    "go": r"`[^`]*`?|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?",
    "rust": r"b?r(?P<raw>#*)\".*?(?:\"(?P=raw)|\Z)|b?\"(?:[^\"\\]|\\.)*\"?|b?'(?:[^'\\\n]|\\[^\n][^'\n]{0,10})'|'\w+",
    "java": r"\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*(?:\"\"\")?|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?",
    "javascript": r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?",
}
_STRINGS["typescript"] = _STRINGS["javascript"]
_TOKEN = {
    k: re.compile(rf"(?P<blank>[^\S\n]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*)|(?P<string>{v})|(?P<name>{_NAME})|(?P<number>\d[\w.]*)|(?P<sign>=>|.)", re.DOTALL) for k, v in _STRINGS.items()
}
_REGEX = re.compile(r"/(?![/*])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n]){0,200}\]){1,1000}/\w*")
_TEMPLATE = re.compile(r"(?:[^`\\$]++|\\.?|\$(?!\{))*+(`|\$\{|\Z)", re.DOTALL)
_NESTED = re.compile(r"/\*|\*/")
#: Names after which a slash begins a regular expression rather than a division.
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do".split())

Token = NamedTuple("Token", [("text", str), ("line", int), ("kind", str)])


def tokens(text: str, language: str) -> list[Token]:
    """Tokens with the line that each begins on; a line's end is one where the language can end a statement by it."""
    pattern, out, at, line, open_ = _TOKEN[language], [], 0, 1, []
    script, ends = language in ("javascript", "typescript"), language in ("go", "javascript", "typescript")

    def template(at: int, line: int) -> int:
        m = _TEMPLATE.match(text, at)
        out.append(Token("`" + m[0], line, "string"))
        if m[1] == "${":
            open_.append("`")
        return m.end()

    while at < len(text):
        if script and text[at] == "`" or open_ and open_[-1] == "`" and text[at] == "}":
            if text[at] == "}":
                open_.pop()
            start, at = at, template(at + 1, line)
            line += text.count("\n", start, at)
            continue
        last = next((t for t in reversed(out[-2:]) if t.kind != "line"), None)
        if script and text[at] == "/" and (last is None or last.kind == "sign" and last.text not in (")", "]", "}") or last.text in _BEFORE_VALUE):
            m = _REGEX.match(text, at)
            if m:
                out.append(Token(m[0], line, "string"))
                at = m.end()
                continue
        m = pattern.match(text, at)
        at, kind = m.end(), m.lastgroup if m.lastgroup != "raw" else "string"
        if kind == "comment" and m[0] == "/*" and language != "rust":
            end = text.find("*/", at)
            at = end + 2 if end >= 0 else len(text)
        elif kind == "comment" and m[0] == "/*":
            depth = 1
            while depth:
                n = _NESTED.search(text, at)
                if n is None:
                    at = len(text)
                    break
                depth += 1 if n[0] == "/*" else -1
                at = n.end()
        elif kind == "line":
            if ends and out and out[-1].kind != "line":
                out.append(Token("\n", line, "line"))
        elif kind not in ("blank", "comment"):
            out.append(Token(m[0], line, kind))
            if open_ and m[0] in "{}":
                open_.append("{") if m[0] == "{" else open_.pop()
        line += text.count("\n", m.start(), at)
    return out


class Symbol(NamedTuple):
    kind: str
    name: str  # after the names of what encloses it, dots between
    s: int
    e: int
    hash: str


#: Scopes within so many others add nothing to a name, which would grow with the square of the depth.
DEEPEST = 100
_MOD, _BASE = (1 << 127) - 1, 0x5DEECE66D1234567F
_OPEN = {"(": ")", "[": "]", "{": "}"}


def _paired(toks: list[Token]) -> list[int]:
    """For each opening bracket the index of its end, the last token for one that stays open; closing ones without a partner are passed over."""
    pair, open_, counts = [0] * len(toks), [], dict.fromkeys(_OPEN.values(), 0)
    for i, t in enumerate(toks):
        if t.kind == "sign" and t.text in _OPEN:
            open_.append(i)
            counts[_OPEN[t.text]] += 1
        elif t.kind == "sign" and counts.get(t.text):
            while True:
                k = open_.pop()
                counts[_OPEN[toks[k].text]] -= 1
                pair[k] = i
                if _OPEN[toks[k].text] == t.text:
                    break
                pair[k] = i - 1
    for k in open_:
        pair[k] = len(toks) - 1
    return pair


class _Reader:
    """The tokens of one text; a language's method tries a declaration at a place.

    It gives (kind, name, first, last, region to read on, its scope's names, what that region is) or None.
    """

    def __init__(self, toks: list[Token], language: str):
        self.toks, self.pair, self.language = toks, _paired(toks), language
        self.keywords = _KEYWORDS[language]
        self.at = {"go": self.go, "rust": self.rust, "java": self.java, "javascript": self.script, "typescript": self.script}[language]

    def text(self, i: int) -> str:
        return self.toks[i].text if 0 <= i < len(self.toks) and self.toks[i].kind != "string" else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i].kind == "name"

    def upto(self, i: int, end: int, stops: tuple[str, ...], passed=lambda i: False) -> int:
        """The next of ``stops`` outside of brackets, or of the keywords that begin another head, or ``end``.

        ``passed`` says which braces are part of a type.
        """
        while i < end:
            t = self.text(i)
            if t in stops and not (t == "{" and passed(i)) or t in self.keywords and self.text(i - 1) != ".":
                return i
            i = self.pair[i] + 1 if t in _OPEN and self.toks[i].kind == "sign" else i + 1
        return end

    def back(self, i: int, least: int, words: frozenset) -> int:
        while i > least and (self.text(i - 1) in words):
            i -= 1
        return i

    def go(self, i: int, begin: int, end: int, names, where):
        if where == "types" or self.text(i) == "type" and where == "top" and i == begin:
            k = i if where == "types" else i + 1
            if where != "types" and self.text(k) == "(":
                return None, "", i, self.pair[k], (k + 1, self.pair[k]), names, "types"
            body = k + 1
            while self.text(body) == "[":
                body = self.pair[body] + 1
            if k == i and i != begin or not self.is_name(k) or self.text(body) not in ("struct", "interface") or self.text(body + 1) != "{":
                return None
            return self.text(body), self.text(k), k, self.pair[body + 1], None, names, ""
        if self.text(i) != "func" or where != "top" or i != begin:
            return None
        k, owner = i + 1, ()
        if self.text(k) == "(":
            inner = self.upto(k + 1, self.pair[k], ("[",))
            owner = tuple(t.text for t in self.toks[k + 1 : inner] if t.kind == "name")[-1:]
            k = self.pair[k] + 1
            kind = "method"
        else:
            kind = "function"
        if not self.is_name(k):
            return None
        body = self.upto(k + 1, end, ("{", "\n", ";", "func"), lambda j: self.text(j - 1) in ("interface", "struct"))
        last = self.pair[body] if self.text(body) == "{" else body - 1
        return kind, ".".join((*owner, self.text(k))), i, last, None, names, ""

    def rust(self, i: int, begin: int, end: int, names, where):
        word = self.text(i)
        if word == "!" and self.is_name(i - 1):
            k = i + 1 + self.is_name(i + 1)
            return (None, "", i, self.pair[k], None, names, "") if self.text(k) in _OPEN else None
        if word == "fn" and self.is_name(i + 1):
            params = self.upto(i + 2, end, ("(", "{", ";", "fn"))
            body = self.upto(self.pair[params] + 1, end, ("{", ";", "}", "fn")) if self.text(params) == "(" else params
            if self.text(body) == "{":
                return "method" if names else "function", self.text(i + 1), self.back(i, begin, _RUST_BEFORE), self.pair[body], None, names, ""
        elif word == "impl" and i == begin or word == "impl" and self.text(i - 1) == "unsafe":
            body = self.upto(i + 1, end, ("{", ";", "}", "fn", "struct"))
            if self.text(body) == "{":
                name = self.implemented(i + 1, body)
                return "impl", name, i, self.pair[body], (body + 1, self.pair[body]), (*names, name), "impl"
        elif word in ("struct", "enum", "trait") and self.is_name(i + 1):
            body = self.upto(i + 2, end, ("{", ";", "}", "fn", "struct", "enum", "trait"))
            if self.text(body) in ("{", ";"):
                last = self.pair[body] if self.text(body) == "{" else body
                inner = (body + 1, last) if word == "trait" and last > body else None
                return word, self.text(i + 1), self.back(i, begin, _RUST_BEFORE), last, inner, (self.text(i + 1),), "impl"
        return None

    def implemented(self, i: int, body: int) -> str:
        """The type after ``for``, else after the generics of ``impl``: its last name before its own generics."""
        depth, start, first = 0, i, ""
        for k in range(i, body):
            t = self.text(k)
            depth += (t == "<") - (t == ">" and self.text(k - 1) != "-")
            if depth == 0 and t == "for" and self.text(k + 1) != "<":
                start, first = k + 1, ""
            elif depth == 0 and t == "where":
                break
            elif depth == 0 and self.is_name(k) and k >= start and t not in ("mut", "dyn", "for"):
                first = t if not first or self.text(k - 1) == ":" else first
        return first or "?"

    def java(self, i: int, begin: int, end: int, names, where):
        word = self.text(i)
        if word == "=" and where == "class":
            return None, "", i, self.upto(i + 1, end, (";",)) - 1, None, names, ""
        if word == "@" and self.is_name(i + 1) and self.text(i + 1) != "interface":
            k = i + 2
            while self.text(k) == "." and self.is_name(k + 1):
                k += 2
            return None, "", i, self.pair[k] if self.text(k) == "(" else k - 1, None, names, "@"
        if word == "@":
            body = self.upto(i + 2, end, ("{", ";", "}"))
            return (None, "", i, self.pair[body], (body + 1, self.pair[body]), names, "block") if self.text(body) == "{" else None
        if word in ("class", "interface", "enum") and self.is_name(i + 1) and self.text(i - 1) != ".":
            body = self.upto(i + 2, end, ("{", ";", "}", "class", "interface", "enum"))
            if self.text(body) == "{":
                return word, self.text(i + 1), begin, self.pair[body], (body + 1, self.pair[body]), (*names, self.text(i + 1)), "class"
        elif word == "record" and self.is_name(i + 1) and self.text(i + 2) in ("(", "<"):
            body = self.upto(i + 2, end, ("{", ";", "}"))
            if self.text(body) == "{":
                return None, "", i, self.pair[body], (body + 1, self.pair[body]), names, "class"
        elif where == "class" and self.is_name(i) and self.text(i + 1) == "(":
            own = bool(names) and word == names[-1] and (i == begin or self.text(i - 1) in _MODIFIERS or self.text(i - 1) in (">", ")") or self.is_name(i - 1) and self.text(i - 2) == "@")
            if own or i > begin and (self.is_name(i - 1) or self.text(i - 1) in ("]", ">")) and self.text(i - 1) != "new":
                last = self.upto(self.pair[i + 1] + 1, end, ("{", ";", "}", "class", "="))
                if self.text(last) in ("{", ";"):
                    return "constructor" if own else "method", word, begin, self.pair[last] if self.text(last) == "{" else last, None, names, ""
        return None

    def script(self, i: int, begin: int, end: int, names, where):
        word, before = self.text(i), self.text(i - 1) if i > 0 else ""
        typed = self.language == "typescript"
        value = self.toks[i - 1].kind == "sign" and before not in (";", "{", "}", ")", "*") or before in _BEFORE_VALUE if i > 0 else False
        in_type = lambda j: self.text(j - 1) in (":", "|", "&", "=>", "<", ",", "is", "keyof")
        if word == "function" and not value:
            k = i + 1 + (self.text(i + 1) == "*")
            if self.is_name(k):
                body = self.upto(k + 1, end, ("{", ";", "}", "function"), in_type)
                if self.text(body) == "{":
                    return "function", self.text(k), self.back(i, begin, frozenset(("async",))), self.pair[body], (body + 1, self.pair[body]), (*names, self.text(k)), "body"
        elif word == "class" and self.text(i - 1) != ".":
            named = self.is_name(i + 1) and self.text(i + 1) not in ("extends", "implements")
            # A type parameter may extend an object type.
            body = self.upto(i + 1, end, ("{", ";", "}", "class"), lambda j: in_type(j) or self.text(j - 1) == "extends")
            if self.text(body) == "{":
                inner = (body + 1, self.pair[body])
                if not value and (named or before == "default"):
                    name = self.text(i + 1) if named else "<anonymous>"
                    return "class", name, self.back(i, begin, frozenset(("abstract",))), self.pair[body], inner, (*names, name), "class"
                return None, "", i, self.pair[body], inner, names, "class"
        elif typed and word in ("interface", "enum", "namespace", "module") and self.is_name(i + 1) and not value:
            body = self.upto(i + 2, end, ("{", ";", "}", "interface", "enum"), in_type)
            if self.text(body) == "{":
                inner = (body + 1, self.pair[body])
                if word in ("interface", "enum"):
                    return word, self.text(i + 1), self.back(i, begin, frozenset(("const", "declare"))), self.pair[body], None, names, ""
                return None, "", i, self.pair[body], inner, (*names, self.text(i + 1)), "body"
        elif typed and word == "type" and self.is_name(i + 1) and self.text(i + 2) in ("=", "<") and not value:
            last = self.statement_end(self.upto(i + 2, end, ("=", ";", "\n")) + 1, end)
            return "type_alias", self.text(i + 1), i, last, None, names, ""
        elif word in ("const", "let") and self.is_name(i + 1):
            return self.arrow(i + 1, end, names)
        elif (where == "class" or before in ("{", ",") or before in _MODIFIERS) and self.text(i + 1) == "(" and word not in _CONTROL and (self.is_name(i) or self.toks[i].kind in ("string", "number")):
            first = self.back(i, begin, _MODIFIERS)
            lead = self.text(first - 1) if first > 0 and self.toks[first - 1].kind != "line" else ""
            if lead in ("", ";", "{", "}", ",", "#", ")") or lead == "]" or self.toks[first - 1].kind == "string" and where == "class":
                body = self.upto(self.pair[i + 1] + 1, end, ("{", ";", "}", ",", "\n", "="), in_type)
                if self.text(body) == "{":
                    name = self.toks[i].text
                    return "method", name, first - (lead == "#"), self.pair[body], (body + 1, self.pair[body]), (*names, name), "body"
        return None

    def arrow(self, k: int, end: int, names):
        """``name = (...) => ...`` at a declarator."""
        equal = self.upto(k + 1, end, ("=", ";", "\n", ",")) if self.text(k + 1) == ":" else k + 1
        if self.text(equal) != "=":
            return None
        at = equal + 1 + (self.text(equal + 1) == "async")
        if self.text(at) == "<":
            at = self.upto(at, end, ("(", ";", "\n"))
        at = self.pair[at] + 1 if self.text(at) == "(" else at + 1 if self.is_name(at) else end
        if self.text(at) == ":":
            at = self.upto(at, end, ("=>", ";", "\n"))
        if self.text(at) != "=>":
            return None
        while at + 1 < end and self.toks[at + 1].kind == "line":
            at += 1
        last = self.pair[at + 1] if self.text(at + 1) == "{" else self.statement_end(at + 1, end)
        return "function", self.text(k), k, last, (at + 1, last + 1), (*names, self.text(k)), "body"

    def statement_end(self, i: int, end: int) -> int:
        """The last token of an expression or type: before ``;``, ``,`` or a line's end that no sign carries on."""
        while i < end:
            t = self.text(i)
            if t in (";", ",", "}") and self.toks[i].kind == "sign":
                break
            if self.toks[i].kind == "line" and not (self.carries(i - 1) or self.carries(i + 1)):
                break
            i = self.pair[i] + 1 if t in _OPEN and self.toks[i].kind == "sign" else i + 1
        i = min(i, end) - 1
        while i > 0 and self.toks[i].kind == "line":
            i -= 1
        return i

    def carries(self, i: int) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i].kind == "sign" and self.text(i) not in (")", "]", "}", "{", "(", "[", ";")


_KEYWORDS = {
    "go": frozenset(("func",)), "rust": frozenset("fn struct enum trait".split()), "java": frozenset("class interface enum record @".split()),
    "javascript": frozenset("const let class function".split()), "typescript": frozenset("const let class function interface enum namespace module".split()),
}
_MODIFIERS = frozenset("async static get set public private protected readonly abstract override final synchronized native default strictfp * accessor".split())
_CONTROL = frozenset("if for while switch catch with function return new do else try super".split())
_RUST_BEFORE = frozenset("pub async const unsafe extern".split())
#: What ends a statement, so that the next token begins one.
_BOUNDS = frozenset((";", "{", "}", "\n"))


def declarations(text: str, language: str) -> list[Symbol]:
    """Declared symbols of a text in document order, with the names and kinds of the language's grammar."""
    toks = tokens(text, language)
    reader = _Reader(toks, language)
    prefix, seen = [0], [0]
    for t in toks:
        h = 0 if t.kind == "line" else int.from_bytes(hashlib.blake2b(t.text.encode("utf-8", "replace"), digest_size=15).digest()) + 1
        prefix.append((prefix[-1] * _BASE + h) % _MOD if h else prefix[-1])
        seen.append(seen[-1] + (t.kind != "line"))
    found, regions = [], [(0, len(toks), (), "top")]
    while regions:
        i, end, names, where = regions.pop()
        begin = i
        while i < end:
            t = toks[i]
            if t.kind == "line" or t.kind == "sign" and t.text in (";", "}"):
                i += 1
                begin = i
                continue
            got = reader.at(i, begin, end, names, where)
            if got:
                kind, name, first, last, inner, own, what = got
                last = min(max(last, i), len(toks) - 1)
                if kind:
                    h = (prefix[last + 1] - prefix[first] * pow(_BASE, seen[last + 1] - seen[first], _MOD)) % _MOD
                    found.append((first, Symbol(kind, ".".join((*names, name)), toks[first].line, toks[last].line + toks[last].text.rstrip("\n").count("\n"), f"{h:032x}")))
                if inner and inner[0] < inner[1]:
                    regions.append((*inner, own[:DEEPEST], what))
                i = last + 1
                if what != "@" and (kind or inner):
                    begin = i
                continue
            if t.kind == "sign" and t.text in _OPEN and reader.pair[i] > i:
                if language != "go" and (t.text == "{" or language != "java"):
                    regions.append((i + 1, reader.pair[i], names, where if language == "java" and where == "class" and toks[begin].text not in ("static", "{") else "top" if language == "rust" else "block"))
                brace = t.text == "{"
                i = reader.pair[i] + 1
                begin = i if brace and language != "go" else begin
                continue
            i += 1
    return [s for _, s in sorted(found, key=lambda x: (x[0], -x[1].e))]
