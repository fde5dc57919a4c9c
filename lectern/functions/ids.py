"""Identifiers and repeatable random numbers in 32-bit arithmetic, and JSON found in answers.

Spark's numbers are signed and 64 bits wide and overflow is an error, so products are made of
halves and kept below 2**49.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

WORD = 0xFFFFFFFF
# Seeds and multipliers of the public hash cyrb53 and of the generator mulberry32.
SEEDS = (0xDEADBEEF, 0x41C6CE57)
ROUND = (2654435761, 1597334677)
FINAL = (2246822507, 3266489909)
STRIDE = 0x6D2B79F5


def low(c: Column) -> Column:
    """The lowest 32 bits."""
    return c.bitwiseAND(F.lit(WORD))


def times(a: Column, b) -> Column:
    """The lowest 32 bits of a product of two numbers of 32 bits."""
    b = b if isinstance(b, Column) else F.lit(b)
    upper = F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(F.lit(0xFFFF)), 16)
    return low(upper + a.bitwiseAND(F.lit(0xFFFF)) * b)


def _folded(c: Column, bits: int) -> Column:
    return c.bitwiseXOR(F.shiftright(c, bits))


def code_units(c: Column) -> Column:
    """The 16-bit units of a text, as numbers; signs beyond the first plane are two."""
    at = lambda coded, i: F.conv(F.substring(coded, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
    units = lambda coded: F.transform(F.sequence(F.lit(0), (F.length(coded) / 4).cast("int") - 1), lambda i: at(coded, i))
    # the text is made and coded once, not for each unit
    return let(F.hex(F.encode(c, "UTF-16BE")), lambda coded: F.when(coded == "", F.array().cast("array<bigint>")).otherwise(units(coded)))


def short_hash(c: Column, seed: int = 0) -> Column:
    """The 53-bit hash of a text in base 36; null stays null."""
    start = F.struct(*[F.lit(s ^ seed).cast("long").alias(n) for s, n in zip(SEEDS, "ab")])
    mixed = lambda h, u: F.struct(times(h["a"].bitwiseXOR(u), ROUND[0]).alias("a"), times(h["b"].bitwiseXOR(u), ROUND[1]).alias("b"))
    stir = lambda own, other: low(times(_folded(own, 16), FINAL[0]).bitwiseXOR(times(_folded(other, 13), FINAL[1])))

    def last(h: Column) -> Column:
        return let(F.struct(stir(h["a"], h["b"]).alias("a"), h["b"].alias("b")), lambda g: F.lit(1 << 32) * stir(g["b"], g["a"]).bitwiseAND(F.lit(0x1FFFFF)) + g["a"])

    return F.lower(F.conv(F.aggregate(code_units(c), start, mixed, last).cast("string"), 10, 36))


def seeded(seed: Column, n: Column) -> Column:
    """The n-th number (from 0) of the generator with a seed, in [0, 1). The state moves by a fixed
    stride, so any number is found without those before it."""
    state = low(low(seed.cast("long")) + times(low(n.cast("long") + 1), STRIDE))

    def made(a: Column) -> Column:
        first = times(_folded(a, 15), a.bitwiseOR(F.lit(1)))
        return let(first, lambda t: let(t.bitwiseXOR(low(t + times(_folded(t, 7), t.bitwiseOR(F.lit(61))))), lambda u: _folded(u, 14) / float(1 << 32)))

    return let(state, made)


def salvaged_json(answer: Column) -> Column:
    """The JSON in an answer, as its text; null without any. Thoughts go, a fenced block counts
    before what is around it, and a text that is JSON as a whole is taken so; else the first
    balanced bracket that holds JSON. An answer that breaks off within a bracket gives nothing from
    inside it. Characters are read once, left to right."""
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?is)<think>.*?</think>", "")
    text = F.trim(F.element_at(F.split(text, "(?i)</think>", 2), -1))
    fences = F.split(text, "```")
    block = F.when(F.size(fences) > 2, F.ltrim(F.get(fences, F.lit(1))))
    block = F.when(F.startswith(F.lower(block), F.lit("json")), F.substring(block, F.lit(5), F.length(block))).otherwise(block)
    text = F.btrim(F.coalesce(F.nullif(block, F.lit("")), text), F.lit(" \t\r\n"))
    valid = lambda t: F.try_parse_json(t).isNotNull()
    # the reader stops behind a value, so the text must be one within either bracket
    whole = lambda t: valid(F.concat(F.lit("["), t, F.lit("]"))) & valid(F.concat(F.lit('{"a":'), t, F.lit("}")))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("from"), F.lit("").alias("open"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.array().cast("array<struct<from:int,to:int>>").alias("found"))

    def step(s: Column, c: Column) -> Column:
        at = s["at"] + 1
        inside, quoted = s["depth"] > 0, s["quoted"]
        opens = c.isin("[", "{")
        own = F.when(s["open"] == "{", c == "}").otherwise(c == "]")
        up = ~inside & opens | inside & ~quoted & (c == s["open"])
        down = inside & ~quoted & own
        depth = s["depth"] + F.when(up, 1).when(down, -1).otherwise(0)
        return F.struct(
            at.alias("at"),
            F.when(~inside & opens, at).otherwise(s["from"]).alias("from"),
            F.when(~inside & opens, c).otherwise(s["open"]).alias("open"),
            depth.alias("depth"),
            (inside & F.when(quoted, (c != '"') | s["escaped"]).otherwise(c == '"') & (depth > 0)).alias("quoted"),
            (quoted & ~s["escaped"] & (c == "\\")).alias("escaped"),
            F.when(down & (depth == 0), F.array_append(s["found"], F.struct(s["from"].alias("from"), at.alias("to")))).otherwise(s["found"]).alias("found"),
        )

    spans = lambda t: F.aggregate(F.split(t, ""), start, step, lambda s: s["found"])
    parts = lambda t: F.transform(spans(t), lambda p: F.substring(t, p["from"], p["to"] - p["from"] + 1))
    first = lambda t: F.get(F.filter(parts(t), valid), F.lit(0))
    return let(text, lambda t: F.when(whole(t), t).otherwise(first(t)))
