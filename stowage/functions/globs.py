"""File-name globs as one anchored regular expression."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(patterns: Sequence[str]) -> str:
    """Alternation over all patterns, in the dialect the JVM reads."""
    bodies = []
    for pattern in patterns:
        body = fnmatch.translate(pattern.lower())
        for end in (r"\Z", r"\z"):
            body = body.removesuffix(end)
        bodies.append(_escape_nested(body))
    return r"\A(?:" + "|".join(bodies) + r")\z"


def _escape_nested(regex: str) -> str:
    """Escape ``[`` inside character classes, where the JVM would open another class."""
    out, at, inside = [], 0, False
    while at < len(regex):
        c = regex[at]
        if c == "\\":
            out.append(regex[at : at + 2])
            at += 2
            continue
        if inside and c == "[":
            c = "\\["
        elif c == "[":
            inside = True
            if regex[at + 1 : at + 2] == "^":
                c += "^"
                at += 1
            if regex[at + 1 : at + 2] == "]":  # the first one stands for itself
                c += "\\]"
                at += 1
        elif c == "]":
            inside = False
        out.append(c)
        at += 1
    return "".join(out)


def matches_any(name: Column, patterns: Sequence[str]) -> Column:
    """The name, in any case, matches at least one pattern."""
    return F.lower(name).rlike(glob_regex(patterns))
