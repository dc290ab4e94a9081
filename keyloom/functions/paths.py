"""Paths of trees: parents, ancestors, depth, storage layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent(path: Column | str) -> Column:
    """'' for a name at the root."""
    p = F.col(path) if isinstance(path, str) else path
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit(""))


def name(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def depth(path: Column | str) -> Column:
    """0 for the root '', else the number of names."""
    p = F.col(path) if isinstance(path, str) else path
    return F.when(p == "", 0).otherwise(F.size(F.split(p, "/")))


def deeper(a: Column | str, b: Column | str) -> Column:
    """Whether directory a lies strictly deeper than b."""
    return depth(a) > depth(b)


def ancestors(path: Column | str, itself: bool = False) -> Column:
    """Array of the ancestors, the root '' first."""
    parts = F.split(path, "/")
    upto = F.size(parts) - (0 if itself else 1)
    return F.array_distinct(F.transform(F.sequence(F.lit(0), upto), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def fan_out(digest: Column | str) -> Column:
    """Storage path of a hash: two digits, then all."""
    return F.concat_ws("/", F.substring(digest, 1, 2), digest)


def object_path(codec: str, prefix: str, ns: Column | str, digest: Column | str) -> Column:
    """<codec><prefix>obj/<hex of the namespace>/<hash>"""
    return F.concat(F.lit(f"{codec}{prefix}obj/"), F.lower(F.hex(F.encode(ns, "UTF-8"))), F.lit("/"), digest)


def drive_path(path: Column | str) -> Column:
    """A path without the characters that file drives forbid; each becomes '='."""
    return F.regexp_replace(path, r'["*:<>?\\|#%]', "=")


def ignore_pattern(line: str) -> str | None:
    """A regular expression of one line of an ignore file, for whole paths; None for blank lines, comments and negations (which have no effect)."""
    line = line.rstrip()
    if not line or line[0] in "#!":
        return None
    folder = line.endswith("/")
    body = line.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif body[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" if body[i] in ".+^$()[]{}|\\" else "") + body[i], i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$")


def ignored(path: Column | str, lines: list[str]) -> Column:
    """Whether any line of an ignore file excludes the path or an ancestor of it."""
    p = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for pattern in filter(None, map(ignore_pattern, lines)):
        out = out | p.rlike(pattern)
    return out
