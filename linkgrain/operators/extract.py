"""Text to rows: marker lines, marker fields, Markdown blocks, YAML sections, symbols.

Files come a row each and are bounded in size by the scan.  Line work is
built-in; the stateful grammars are small helpers in Arrow batches.
"""

from __future__ import annotations

import ast
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ids import ID_PATTERN, type_of, valid_id
from ..functions.lexing import declarations
from ..schema import NODE_TYPES, OBSERVED, SEMANTIC, STRUCTURAL

KEYS = frozenset(("id", "type", "title", "policy", "expects", "plan", *SEMANTIC))
DERIVED = frozenset((*STRUCTURAL, *OBSERVED))


def marker_lines(files: DataFrame) -> DataFrame:
    """(path, line, payload) of the marker lines in ``files`` (path, text)."""
    hit = files.filter(F.col("text").contains(tx.MARKER)).select("path", F.posexplode(tx.lines(F.col("text"))).alias("n", "l")).filter(F.col("l").contains(tx.MARKER))
    return hit.select("path", (F.col("n") + 1).alias("line"), tx.marker_payload(F.col("l")).alias("payload")).filter("payload is not null")


def targets(value):
    """Ids of a comma list, blanks left out."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def declared_edges(markers: DataFrame) -> DataFrame:
    """(path, line, f, p, t) of the well-formed fields, by built-in expressions alone."""
    own = markers.withColumn("f", tx.field(F.col("payload"), "id")).filter(valid_id(F.col("f")))
    each = F.array(*[F.struct(F.lit("implements" if k == "plan" else k).alias("p"), tx.field(F.col("payload"), k).alias("v")) for k in (*SEMANTIC, "plan")])
    rows = own.select("path", "line", "f", F.explode(F.filter(each, lambda x: x["v"].isNotNull())).alias("x"))
    return rows.select("path", "line", "f", "x.p", F.explode(targets(F.col("x.v"))).alias("t")).filter(valid_id(F.col("t"))).distinct()


_KEY = re.compile(r"\s*([A-Za-z][A-Za-z0-9_]*)[ \t]*=[ \t]*")
_BARE = re.compile(r"[^\s\"=]+")


def fields(payload: str) -> tuple[list[tuple[str, str, bool]], str | None]:
    """Fields (key, value, quoted) in order, and what stopped the reading: null at the end of a sound payload."""
    out, at = [], 0
    while payload[at:].strip():
        m = _KEY.match(payload, at)
        if not m:
            return out, f"malformed field at {at}"
        at = m.end()
        if payload[at : at + 1] == '"':
            value, i = [], at + 1
            while i < len(payload) and payload[i] != '"':
                if payload[i] == "\\" and i + 1 < len(payload):
                    value.append({"n": "\n", "t": "\t"}.get(payload[i + 1], payload[i + 1]))
                    i += 2
                else:
                    value.append(payload[i])
                    i += 1
            if i >= len(payload):
                return out, "unterminated quote"
            out.append((m[1], "".join(value), True))
            at = i + 1
        else:
            v = _BARE.match(payload, at)
            if not v:
                return out, f"missing value of {m[1]}"
            out.append((m[1], v[0], False))
            at = v.end()
    return out, None


def quoted(value: str) -> str:
    if value and re.fullmatch(r"[A-Za-z0-9._:/,\-]+", value):
        return value
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'


def rendered(pairs: list[tuple[str, str]]) -> str:
    """A marker line with its fields in the canonical order."""
    order = {k: n for n, k in enumerate(("id", "type", "title", "policy", "expects", *SEMANTIC))}
    return tx.MARKER + "".join(f" {k}={quoted(v)}" for k, v in sorted(pairs, key=lambda x: order.get(x[0], 99)))


def parse(payload: str) -> dict:
    """id, type, title, edges and problems (rule, message) of one payload; of a repeated key the first counts."""
    got, problem = fields(payload)
    first: dict[str, tuple[str, bool]] = {}
    problems = [("TL004", problem)] if problem else []
    for k, v, q in got:
        if k in first:
            problems.append(("TL006", f"repeated {k}"))
        elif k in DERIVED:
            problems.append(("TL040", f"derived {k}"))
        elif k not in KEYS:
            problems.append(("TL040", f"unknown {k}"))
        else:
            first[k] = (v, q)
    own = first.get("id", ("", False))[0]
    if not re.match(ID_PATTERN, own):
        problems.append(("TL005", f"bad id {own}"))
    kind = first.get("type", (None, False))[0]
    if kind is not None and kind not in NODE_TYPES:
        problems.append(("TL007", f"bad type {kind}"))
    edges = []
    for k in (*SEMANTIC, "plan"):
        if k in first:
            v, q = first[k]
            for t in [v] if q else [x.strip() for x in v.split(",") if x.strip()]:
                if re.match(ID_PATTERN, t):
                    edges.append(("implements" if k == "plan" else k, t))
                else:
                    problems.append(("TL005", f"bad target {t}"))
    expects = [x for x in first.get("expects", ("", False))[0].split(",") if x]
    return {"id": own or None, "type": kind, "title": first.get("title", (None, False))[0], "edges": edges, "expects": expects, "problems": problems}


PARSED = "path string, line int, trace_id string, type string, title string, expects array<string>, edges array<struct<p: string, t: string>>, problems array<struct<rule: string, message: string>>"


def parsed_markers(markers: DataFrame) -> DataFrame:
    """One row a marker line with everything that its grammar gives."""

    def run(frames):
        for frame in frames:
            rows = []
            for path, line, payload in frame[["path", "line", "payload"]].itertuples(index=False):
                m = parse(payload)
                rows.append((path, line, m["id"], m["type"], m["title"], m["expects"], [{"p": p, "t": t} for p, t in m["edges"]], [{"rule": r, "message": x} for r, x in m["problems"]]))
            yield pd.DataFrame(rows, columns=["path", "line", "trace_id", "type", "title", "expects", "edges", "problems"])

    return markers.mapInPandas(run, PARSED).withColumn("type", F.coalesce("type", type_of(F.col("trace_id"))))


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")


def code_mask(lines: list[str]) -> list[bool]:
    """Which lines of a Markdown text are code: inside fences, or indented after a blank line."""
    out, fence, blank, indented = [], None, True, False
    for line in lines:
        m = _FENCE.match(line)
        if fence:
            out.append(True)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = None
        elif m:
            fence = m[1]
            out.append(True)
        else:
            indented = line.startswith(("    ", "\t")) and (blank or indented) and bool(line.strip())
            out.append(indented)
        blank = not line.strip()
    return out


def markdown_headings(text: str) -> list[tuple[int, int, int, str]]:
    """(level, first line, last line, title) of headings; a body ends before the next heading of its level or above."""
    lines = text.splitlines()
    mask = code_mask(lines)
    heads = []
    for n, line in enumerate(lines, 1):
        m = re.match(r"^(#{1,6})\s+(.*?)\s*#*$", line)
        if m and not mask[n - 1]:
            heads.append((len(m[1]), n, m[2]))
    out = []
    for k, (level, n, title) in enumerate(heads):
        end = next((x[1] - 1 for x in heads[k + 1 :] if x[0] <= level), len(lines))
        out.append((level, n, end, title))
    return out


def yaml_sections(text: str) -> list[tuple[str, int, int]]:
    """(key path, first line, last line) of top-level keys and of mappings one level below; none for a bad text."""
    import yaml

    try:
        root = yaml.compose(text)
    except yaml.YAMLError:
        return []
    out = []
    for k, v in getattr(root, "value", None) or [] if isinstance(root, yaml.MappingNode) else []:
        end = v.end_mark.line + (v.end_mark.column > 0)
        out.append((str(k.value), k.start_mark.line + 1, max(end, k.start_mark.line + 1)))
        if isinstance(v, yaml.MappingNode):
            for k2, v2 in v.value:
                end = v2.end_mark.line + (v2.end_mark.column > 0)
                out.append((f"{k.value}.{k2.value}", k2.start_mark.line + 1, max(end, k2.start_mark.line + 1)))
    return out


def python_symbols(text: str) -> list[tuple[str, str, int, int, str]]:
    """(kind, qualified name, first line, last line, hash of the syntax tree); decorators belong to a symbol."""
    try:
        module = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out, todo = [], [(module, "", False)]
    while todo:
        node, prefix, in_class = todo.pop()
        for child in reversed(list(ast.iter_child_nodes(node))):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = f"{prefix}.{child.name}" if prefix else child.name
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if in_class else "function"
                start = min([child.lineno, *[d.lineno for d in child.decorator_list]])
                out.append((kind, name, start, child.end_lineno, hashlib.sha256(ast.dump(child).encode()).hexdigest()))
                todo.append((child, name, isinstance(child, ast.ClassDef)))
            else:
                todo.append((child, prefix, in_class))
    return sorted(out, key=lambda x: (x[2], x[1]))


SYMBOLS = "path string, kind string, name string, s int, e int, hash string, parser string, block string"
NEAR = ", language string, near array<string>"


def _block_hash(lines: list[str], s: int, e: int) -> str:
    """``tx.fingerprint`` of the lines ``s`` to ``e``."""
    own = [x.rstrip(" \t\v\f") for x in lines[s - 1 : e]]
    while own and not own[-1]:
        own.pop()
    first = next((k for k, x in enumerate(own) if x), 0)
    return hashlib.sha256("\n".join(own[first:]).encode("utf-8", "replace")).hexdigest()


def _around(text: str, first: int, last: int):
    """The lines of ``tx.lines`` at the offsets from a line, null beyond the text."""
    lines = text.splitlines()
    return lambda s: [lines[k - 1] if 0 < k <= len(lines) else None for k in range(s + first, s + last + 1)]


def _tokens_of(language: str):
    return lambda text: [(*x, "tokens") for x in declarations(text, language)]


#: Parsers by language: each gives (kind, name, first line, last line, hash, parser) of a text; ``register`` adds one.
PARSERS = {
    "python": lambda text: [(*x, "ast") for x in python_symbols(text)],
    "markdown": lambda text: [("heading", t, a, b, None, "markdown") for _, a, b, t in markdown_headings(text)],
    "yaml": lambda text: [("key", k, a, b, None, "yaml") for k, a, b in yaml_sections(text)],
    **{language: _tokens_of(language) for language in ("go", "rust", "java", "javascript", "typescript")},
}


def register(language: str, parser) -> None:
    """Adds a parser, or puts it in place of the one before; jobs planned from here on use it."""
    PARSERS[language] = parser


def symbols(files: DataFrame, near=None) -> DataFrame:
    """Symbols and sections of ``files`` (path, language, text); ``parser`` says what read them.

    ``name`` holds the names of what encloses a symbol; ``qualified`` the
    module's before them.  ``hash`` does not change with the layout of a symbol's
    code, ``block`` does: it is the fingerprint of its lines.  With ``near``, which
    gives a language's first and last offset, also ``language`` and ``near``: the
    lines at these offsets from a symbol's first, null beyond the file.
    """
    parsers = dict(PARSERS)
    more = ["language", "near"] if near else []

    def run(frames):
        for frame in frames:
            rows = []
            for path, language, text in frame[["path", "language", "text"]].itertuples(index=False):
                found = parsers[language](text or "") if language in parsers else []
                if found:
                    lines = re.split("\r\n|\r|\n", text) if "\r" in text else text.split("\n")
                    around = _around(text, *near(language)) if near else None
                    rows += [(path, *x, _block_hash(lines, x[2], x[3]), *((language, around(x[2])) if near else ())) for x in found]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "s", "e", "hash", "parser", "block", *more])

    module = F.translate(F.regexp_replace("path", r"(?<=[^/.])[.][^./]*$", ""), "/", ".")
    return files.select("path", "language", "text").mapInPandas(run, SYMBOLS + (NEAR if near else "")).withColumn("qualified", F.concat(module, F.lit("."), "name"))


BLOCKS = "path string, trace_id string, node_type string, title string, s int, e int, body string, edges array<struct<p: string, t: string>>"


def markdown_blocks(text: str) -> list[tuple]:
    """(id, title, first line, last line, body, edges) of headings whose first word is an id; markers within five lines with that id add their edges, each once."""
    lines, out = text.splitlines(), []
    marks = [(n, parse(p)) for n, line in enumerate(lines, 1) if tx.MARKER in line and (p := _payload(line)) is not None]
    for _, a, b, title in markdown_headings(text):
        own = title.split(None, 1)[0].rstrip(":") if title else ""
        if re.match(ID_PATTERN, own):
            edges = list(dict.fromkeys(e for n, m in marks if a <= n <= a + 5 and m["id"] == own for e in m["edges"]))
            rest = title.split(None, 1)
            out.append((own, rest[1] if len(rest) > 1 else own, a, b, "\n".join(lines[a - 1 : b]), edges))
    return out


def _payload(line: str) -> str | None:
    m = re.match(r"^\s*(?:<!--|/\*|//|#|--|%|;|\*)?\s*" + re.escape(tx.MARKER) + r"(?:\s+(.*?))?\s*(?:-->|\*/)?\s*$", line)
    return (m[1] or "") if m else None


def blocks(files: DataFrame) -> DataFrame:
    """Typed Markdown blocks of ``files`` (path, text): those whose id has a known type; ``fingerprint`` is the body's."""

    def run(frames):
        for frame in frames:
            rows = [(path, i, None, t, a, b, body, [{"p": p, "t": x} for p, x in edges]) for path, text in frame[["path", "text"]].itertuples(index=False) for i, t, a, b, body, edges in markdown_blocks(text or "")]
            yield pd.DataFrame(rows, columns=["path", "trace_id", "node_type", "title", "s", "e", "body", "edges"])

    rows = files.select("path", "text").mapInPandas(run, BLOCKS).withColumn("node_type", type_of(F.col("trace_id"))).filter("node_type is not null")
    return rows.withColumn("fingerprint", tx.fingerprint(F.col("body")))


def legacy_fields(files: DataFrame, marker: str = "codeops:trace") -> DataFrame:
    """(path, line, key, value) of an older annotation's fields; a text with a NUL in its first 8192 characters is binary."""
    rows = files.filter(F.col("text").contains(marker) & ~F.substring("text", 1, 8192).contains("\0")).select("path", F.posexplode(tx.lines(F.col("text"))).alias("n", "l")).filter(F.col("l").contains(marker))
    rest = F.substring_index("l", marker, -1)
    pairs = F.regexp_extract_all(rest, F.lit(r"([A-Za-z_]\w*)=(\S*)"), 0)
    return rows.select("path", (F.col("n") + 1).alias("line"), F.explode(pairs).alias("x")).select("path", "line", F.substring_index("x", "=", 1).alias("key"), F.expr("substring(x, locate('=', x) + 1)").alias("value"))


def first_tag(files: DataFrame, pattern: str = r"scry:([a-z]+)") -> DataFrame:
    rows = files.select("path", F.posexplode(tx.lines(F.col("text"))).alias("n", "l"))
    return rows.select("path", (F.col("n") + 1).alias("line"), F.regexp_extract("l", pattern, 1).alias("kind")).filter("kind <> ''")
