"""parse the keys of an author-id map without ``eval``.

A key is the text of a Python tuple. Two shapes occur::

    nested  ("('a0',)", 'HRS1.1')    -> first element is itself a tuple text
    plain   ('a0', 'HRS2.0')

Dialect ``nested``: the canonical id is the first element of the tuple written
inside the first element. Dialect ``mixed``: when the second element starts
with :data:`NESTED_SOURCE_PREFIX` the key is nested, otherwise the first element is the id.
A key that does not parse gives NULL; callers count those rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value (must equal the input format): the source tag prefix that marks
# a nested key in the mixed dialect.
NESTED_SOURCE_PREFIX = "HRS1"

# A Python string literal in single or double quotes. Quotes and backslashes
# inside may be escaped; a key with another escape does not parse.
_SQ = r"'([^'\\]*+(?:\\['\"\\][^'\\]*+)*+)'"
_DQ = r'"([^"\\]*+(?:\\[\'"\\][^"\\]*+)*+)"'
_STR = rf"(?:{_SQ}|{_DQ})"
_END = r"(?:,.*)?[\)\]]\s*$"
#: A tuple or list of any length that starts with one string, or with two.
_FIRST = rf"^\s*(?:\[\s*{_STR}\s*\]\s*$|[\(\[]\s*{_STR}\s*,.*[\)\]]\s*$)"
_SECOND = rf"^\s*[\(\[]\s*{_STR}\s*,\s*{_STR}\s*{_END}"
_INNER = rf"^\s*[\(\[]\s*{_STR}\s*{_END}"


def _pick(c: Column, pattern: str, *groups: int) -> Column:
    """The one of the groups that matched, unescaped; NULL without a match."""
    text = F.concat(*[F.regexp_extract(c, pattern, g) for g in groups])
    return F.when(c.rlike(pattern), F.regexp_replace(text, r"\\(.)", "$1"))


def outer_first(key) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return _pick(k, _FIRST, 1, 2, 3, 4)


def outer_second(key) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return _pick(k, _SECOND, 3, 4)


def inner_first(text: Column) -> Column:
    return _pick(text, _INNER, 1, 2)


def parse_author_key(key, dialect: str = "nested") -> Column:
    """Canonical author id of a map key, or NULL when it does not parse."""
    first = outer_first(key)
    if dialect == "nested":
        return inner_first(first)
    if dialect == "mixed":
        second = outer_second(key)
        # without a second string the dialect cannot be told
        plain = F.when(second.isNotNull(), first)
        return F.when(second.startswith(NESTED_SOURCE_PREFIX), inner_first(first)).otherwise(plain)
    raise ValueError(f"unknown id-map dialect {dialect!r}")
