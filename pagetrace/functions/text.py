"""Column functions over paths, symbols and text; all but glob_regex stay in the JVM."""

from __future__ import annotations

import fnmatch

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _java(regex: str) -> str:
    """A translated glob as Java reads it, where brackets within a set mean sets of their own."""
    out, first, i = [], None, 0  # first: place of the set's first member
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            out.append(regex[i : i + 2])
            i += 1
        elif first is None:
            out.append(c)
            if c == "[":
                first = i + 1 + (regex[i + 1 : i + 2] == "^")
        elif c == "[" or (c == "]" and i == first):
            out.append("\\" + c)
        else:
            out.append(c)
            if c == "]":
                first = None
        i += 1
    return "".join(out)


def glob_regex(pattern: Column | str) -> Column:
    """Regular expression of a shell glob: * crosses /, ? is one character, [..] and [!..] are sets.

    A [ without a closing ] stands for itself.  Sets can't be rewritten by
    regular expressions alone, so this runs in Python, on the few rows of rules.
    """

    @F.pandas_udf("string")
    def translated(globs: pd.Series) -> pd.Series:
        return globs.map(lambda g: _java(fnmatch.translate(g).removesuffix(r"\Z").removesuffix(r"\z")) + r"\z", na_action="ignore")

    return F.concat(F.lit(r"\A"), translated(_col(pattern)))


def literal_prefix(pattern: Column | str) -> Column:
    """What a glob's matches all begin with: its text up to the first * ? or [."""
    return F.regexp_extract(_col(pattern), r"\A[^*?\[]*", 0)


def is_literal(pattern: Column | str) -> Column:
    return ~_col(pattern).rlike(r"[*?\[]")


def symbol_matches(symbol: Column | str, pattern: Column | str) -> Column:
    """Equal, or beginning alike if the pattern ends in *."""
    s, p = _col(symbol), _col(pattern)
    return F.when(p.endswith("*"), F.startswith(s, F.substring(p, F.lit(1), F.length(p) - 1))).otherwise(s == p)


def repo_key(repo: Column | str) -> Column:
    """Last part of a repository's address in lower case, without .git."""
    last = F.element_at(F.split(F.regexp_replace(_col(repo), r"/+\z", ""), "/"), -1)
    return F.lower(F.regexp_replace(last, r"\.git\z", ""))


def under(path: Column | str, root: str) -> Column:
    """Whether a path is root or lies below it; false for null, and for the roots '' and '.'."""
    root = root.strip("/")
    if root in ("", "."):
        return F.lit(False)
    p = _col(path)
    return F.coalesce((p == root) | p.startswith(root + "/"), F.lit(False))


def stem(path: Column | str) -> Column:
    """Base name up to its last dot (empty for .name)."""
    base = F.element_at(F.split(_col(path), "/"), -1)
    return F.regexp_replace(base, r"\.[^.]*\z", "")


def occurrences(text: Column | str, needle: Column | str) -> Column:
    """How often a non-empty needle occurs, not overlapping."""
    t, n = _col(text), _col(needle)
    return F.floor((F.length(t) - F.length(F.replace(t, n, F.lit("")))) / F.length(n)).cast("long")


def line_count(text: Column | str) -> Column:
    """Lines of a text; a final line feed doesn't begin another."""
    t = _col(text)
    return (F.size(F.split(F.regexp_replace(t, r"\n\z", ""), "\n")) * F.when(t == "", 0).otherwise(1)).cast("long")


def l2_norm(vector: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; a zero vector is treated as one of norm 1e-12."""
    return dot(a, b) / (F.greatest(l2_norm(a), F.lit(1e-12)) * F.greatest(l2_norm(b), F.lit(1e-12)))


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def url_host(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"^[a-z]+://([^/?#]*)", 1)


def html_escape(text: Column | str) -> Column:
    t = F.replace(_col(text), F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(raw), F.lit(safe))
    return t
