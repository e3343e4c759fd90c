"""Where matches stand in a text, and what stands around them; built-in functions only.

Regular expressions give matches but no places. A text is also split by the same expression, and places are
the sums of the lengths before them. Contexts are cut from blocks of the text, so that each costs a
block and not the text before it. Places count code points from 0; ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .text import let

#: Code points of a block.
BLOCK = 512
MATCH = "struct<s:int,e:int,v:string,line:int>"


def _chunked(items: Column) -> Column:
    """An array in chunks of about the root of its size, at least 32."""
    each = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(items))).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / each).cast("int")), lambda k: F.slice(items, k * each + 1, each))


def along(items: Column, start: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Goes along an array with a state: ``step(state, item)`` gives the next state and one value (of type ``kind``); the array of all values.

    Arrays can't be appended to, only copied, so items are taken in chunks: an item costs the copy of a chunk at most.
    """

    def both(state: Column, values: Column) -> Column:
        return F.struct(state.alias("state"), values.alias("values"))

    def one(acc: Column, item: Column) -> Column:
        return let(F.struct(*[x.alias(n) for n, x in zip(("state", "value"), step(acc["state"], item))]), lambda y: both(y["state"], F.concat(acc["values"], F.array(y["value"]))))

    def chunk(acc: Column, some: Column) -> Column:
        return let(F.aggregate(some, both(acc["state"], F.array().cast(f"array<{kind}>")), one), lambda y: both(y["state"], F.concat(acc["values"], F.array(y["values"]))))

    return F.aggregate(_chunked(items), both(start, F.array().cast(f"array<array<{kind}>>")), chunk, lambda acc: F.flatten(acc["values"]))


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern, which holds no groups that capture and no line ends, as (s, e, v, line): place, text and number of the line."""
    either = rf"(?:{pattern})|\n"
    pairs = F.zip_with(F.split(text, either, -1), F.regexp_extract_all(text, F.lit(f"({either})"), 1), lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        following = F.struct(end.cast("int").alias("at"), (state["line"] + (x["hit"] == "\n").cast("int")).cast("int").alias("line"))
        return following, F.struct(start.cast("int").alias("s"), end.cast("int").alias("e"), x["hit"].alias("v"), state["line"].alias("line"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("line"))
    found = let(F.filter(pairs, lambda x: x["hit"].isNotNull()), lambda p: along(p, start, MATCH, step))
    return F.filter(found, lambda m: m["v"] != "\n")


def lines(text: Column) -> Column:
    """The lines of a text, to which ``line`` of a match points."""
    return F.split(text, "\n", -1)


def blocks(text: Column) -> Column:
    """The text in blocks, for ``between``."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), 0)


def between(pieces: Column, start: Column, end: Column) -> Column:
    """The text between two places, as far as there is any, from the blocks of the text."""
    first = F.floor(F.greatest(start, F.lit(0)) / BLOCK).cast("int")
    some = F.slice(pieces, first + 1, F.greatest(F.floor((end - 1) / BLOCK).cast("int") - first + 1, F.lit(0)))
    return F.substring(F.array_join(some, ""), F.greatest(start, F.lit(0)) - first * BLOCK + 1, F.greatest(end - F.greatest(start, F.lit(0)), F.lit(0)))
