"""Paths as columns: containment, exclusion, admission, folding."""

from __future__ import annotations

import os
import posixpath
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_SUFFIXES = (".md", ".markdown", ".txt")


def within(path: Column, root: Column | str) -> Column:
    """Equal to ``root`` or beneath it; ``/`` holds everything, ``/foo`` does not hold ``/foobar``."""
    r = F.lit(root) if isinstance(root, str) else root
    return (path == r) | ((r == "/") & path.isNotNull()) | path.startswith(F.concat(r, F.lit("/")))


def within_any(path: Column, roots: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (within(path, r) for r in roots), F.lit(False))


def ancestors(path: Column) -> Column:
    """All strict ancestors of an absolute path, ``/`` first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def strictly_under(df: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """The rows beneath any of ``roots``, not those equal to one: an equi-join on exploded ancestors instead of all pairs."""
    keys = df.select(path).distinct().select(F.col(path), F.explode(ancestors(F.col(path))).alias(root))
    under = keys.where(F.col(root) != F.col(path)).join(roots.select(root).distinct(), root, "left_semi").select(path).distinct()
    return df.join(under, path, "left_semi")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a shell pattern of one path component: ``*``, ``?``, classes and ``\\``."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            j = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] in ("^", "]") else i + 1)
            if j < 0:
                raise ValueError(f"unclosed class in {pattern!r}")
            out.append(pattern[i : j + 1])
            i = j
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def excluded(path: Column, prefixes: list[str], basenames: list[str]) -> Column:
    """Within an excluded prefix, or with a component that matches one of the ``basenames`` patterns."""
    hit = within_any(path, prefixes)
    if basenames:
        any_of = "|".join(glob_regex(b) for b in basenames)
        hit = hit | F.exists(F.split(path, "/"), lambda c: c.rlike(any_of))
    return hit


def is_text_file(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(md|markdown|txt)$")


def fold_data_volume(path: Column) -> Column:
    """Without the data volume's prefix, where it ends at a component."""
    return F.regexp_replace(path, "^/System/Volumes/Data(?=/)", "")


def same_stat(size: Column, mtime: Column, size2: Column, mtime2: Column) -> Column:
    return (size == size2) & (mtime == mtime2)


def tilde_path(path: Column, home: str) -> Column:
    return F.when(path == home, F.lit("~")).when(path.startswith(home.rstrip("/") + "/"), F.concat(F.lit("~"), F.substring(path, len(home.rstrip("/")) + 1, 1 << 30))).otherwise(path)


def is_confined(path: Column, root: str) -> Column:
    """:func:`confined` as a column: relative, and beneath ``root`` once ``.`` and ``..`` are resolved."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda a: (F.size(a) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), a), -1) != "..")
    clean = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when((p == "..") & up(a), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return ~path.startswith("/") & (F.size(clean) > 1) & (F.get(clean, F.lit(0)) == root)


# -- on the driver -------------------------------------------------------------
def normalize_roots(roots: list[str]) -> list[str]:
    """Clean, without repeats and without roots inside others, in byte order."""
    kept: list[str] = []
    for r in sorted({posixpath.normpath(x) for x in roots if x}, key=lambda p: p.encode()):
        if not any(r == k or k == "/" or r.startswith(k + "/") for k in kept):
            kept.append(r)
    return kept


def on_disk(path: str) -> str:
    """The path as the disk spells it, without the data volume's prefix; what does not exist stays as it is.

    On file systems that do not mind case, a name is looked up by what it leads to.
    """
    done = "/"
    for part in [p for p in path.split("/") if p]:
        here = os.path.join(done, part)
        try:
            if part not in os.listdir(done) and os.path.lexists(here):
                own = os.lstat(here)
                part = next((e.name for e in os.scandir(done) if os.path.samestat(e.stat(follow_symlinks=False), own)), part)
        except OSError:
            pass
        done = os.path.join(done, part)
    return re.sub("^/System/Volumes/Data(?=/)", "", done)


def confined(path: str, root: str = "corpus") -> bool:
    """Relative, and beneath ``root`` when cleaned."""
    return not path.startswith("/") and posixpath.normpath(path).startswith(root + "/")
