"""Linear-time helpers over arrays in one row, with built-in functions.

Spark evaluates an expression that stands inside a lambda once per element,
so :func:`let` binds a value to a lambda variable first. :func:`running` gives
running results without copying the array for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose running results are made by appending one by one.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative ``op`` over an array of longs: inside
    blocks, over the blocks' last results, then both together."""
    none = F.array().cast("array<bigint>")

    def grown(a: Column) -> Column:
        return F.aggregate(a, none, lambda s, x: F.concat(s, F.array(F.when(F.size(s) > 0, op(F.try_element_at(s, F.lit(-1)), x)).otherwise(x))))

    def over(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(BLOCK))
        return let(F.transform(starts, lambda b: grown(F.slice(v, b, BLOCK))), joined)

    def joined(local: Column) -> Column:
        lasts = F.transform(local, lambda b: F.try_element_at(b, F.lit(-1)))
        return let(grown(lasts), lambda up: F.flatten(F.transform(local, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: op(F.get(up, i - 1), x))))))

    return let(values.cast("array<bigint>"), over)


def cut(text: Column, borders: Column, size: int = 16384) -> Column:
    """The pieces of ``text`` between neighbouring positions (code points, in
    order, from 0); each is read from the fixed blocks that it touches."""

    def pieces(blocks: Column, at: Column) -> Column:
        spans = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

        def piece(x: Column) -> Column:
            first = F.floor(x["a"] / size).cast("int")
            touched = F.slice(blocks, first + 1, F.floor((x["b"] - 1) / size).cast("int") - first + 1)
            return F.when(x["b"] > x["a"], F.substring(F.array_join(touched, ""), (x["a"] - first * size + 1).cast("int"), (x["b"] - x["a"]).cast("int"))).otherwise("")

        return F.transform(spans, piece)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), 0)
    return let(blocks, lambda bl: let(borders, lambda at: pieces(bl, at)))
