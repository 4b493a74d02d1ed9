"""Text expressions: globs, normalised blocks, fingerprints, markers, tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = "trace:v1"
OPENERS = ("<!--", "/*", "//", "#", "--", "%", ";", "*")
LINES = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def path_glob(pattern: str) -> str:
    """Anchored regex of a path glob: ``**`` crosses ``/``, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(pattern):
        rest = pattern[i:]
        if rest.startswith("**/"):
            out, i = out + "(?:.*/)?", i + 3
        elif rest.startswith("**"):
            out, i = out + ".*", i + 2
        elif rest[0] == "*":
            out, i = out + "[^/]*", i + 1
        elif rest[0] == "?":
            out, i = out + "[^/]", i + 1
        elif rest[0] == "[" and "]" in rest[2:]:
            end = rest.index("]", 2)
            body = rest[1:end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", i + end + 1
        else:
            out, i = out + re.escape(rest[0]), i + 1
    return f"^{out}$"


def loose_glob(pattern: str) -> str:
    """Anchored regex of a policy glob, in which ``*`` crosses ``/`` too."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def any_glob(path: Column, patterns, translate=path_glob) -> Column:
    """Whether one of the globs fits; one regex for all of them."""
    return path.rlike("|".join(f"(?:{translate(p)})" for p in patterns)) if patterns else F.lit(False)


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty line does not count."""
    parts = F.split(text, LINES)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def normalized(text: Column) -> Column:
    """Line feeds only, no white space at line ends, no blank lines at either end."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t\u000b\f]+(?=\n|$)", "")
    return F.regexp_replace(out, "^\n+|\n+$", "")


def fingerprint(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def marker_payload(line: Column) -> Column:
    """What follows the marker on a line, without a comment's end; null where a line has none.

    Text before the marker must be empty or begin with a comment opener.
    """
    stripped = F.trim(line)
    before = F.trim(F.substring_index(stripped, MARKER, 1))
    after = F.regexp_extract(stripped, r"trace:v1(?:\s+(.*))?$", 1)
    opened = F.lit(False)
    for o in OPENERS:
        opened = opened | before.startswith(o)
    after = F.when(opened, F.substring_index(F.substring_index(after, "-->", 1), "*/", 1)).otherwise(after)
    return F.when(stripped.rlike(r"trace:v1(?=\s|$)") & ((before == "") | opened), F.trim(after))


def field(payload: Column, key: str) -> Column:
    """A field's value, quoted or not; null where it is missing."""
    pattern = r'(?:^|\s)' + key + r'\s*=\s*(?:"((?:[^"\\]|\\.)*)"|([^\s"]+))'
    value = F.coalesce(F.nullif(F.regexp_extract(payload, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(payload, pattern, 2), F.lit("")))
    return value


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def sanitized(text: Column, most: int) -> Column:
    """One line without control characters, cut at ``most`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"[\x00-\x1f\x7f]", ""))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 1), F.lit("…")))
