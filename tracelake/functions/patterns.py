"""Include and exclude patterns: regular expressions, wildcards or plain parts of names."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column


def _valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def compiled(pattern: str) -> str:
    """The regular expression of a pattern.  * and ? count as wildcards, then as regular expression, then as text."""
    wild = pattern.replace("*", ".*").replace("?", ".")
    out = next((p for p in (wild, pattern) if _valid(p)), re.escape(pattern))
    if "(?P" in out:
        raise ValueError(f"named groups aren't supported: {pattern}")
    return out


def parsed(text: str | None) -> list[str]:
    """The patterns of a comma-separated list."""
    return [p for p in (x.strip() for x in (text or "").split(",")) if p]


def any_of(name: Column, patterns: Sequence[str]) -> Column:
    return reduce(or_, (name.rlike(compiled(p)) for p in patterns))


def chosen(name: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column | None:
    """A row stays if one of include matches and none of exclude does; None if neither is given."""
    keep = any_of(name, include) if include else None
    drop = ~any_of(name, exclude) if exclude else None
    if keep is None or drop is None:
        return drop if keep is None else keep
    return keep & drop
