"""Z-order arithmetic as column expressions: 31 bits an axis, x in the higher of each pair of bits.

Bits are spread and gathered by look-ups of eight bits, so the size of an expression grows with its input's alone: where
Spark puts a key's expression into a filter, the generated method stays small enough for the JVM to compile.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MAX_BITS = 31
#: Every 8 bits with bit i moved to bit 2i, and the even ones of every 8 bits moved together.
SPREAD_8 = [sum((b >> i & 1) << 2 * i for i in range(8)) for b in range(256)]
GATHER_8 = [sum((b >> 2 * i & 1) << i for i in range(4)) for b in range(256)]
#: The same spreading on whole numbers for the checking SQL: shift and mask of each step.
SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def _long(v: int | Column) -> Column:
    return (F.lit(v) if isinstance(v, int) else v).cast("long")


def _looked_up(c: Column, table: list[int], count: int, step: int) -> Column:
    """Each 8 bits of a number looked up and moved to their place, ``step`` bits for eight."""
    known = F.expr(f"array({', '.join(f'{v}L' for v in table)})")
    parts = [F.shiftleft(F.get(known, F.shiftright(c, 8 * i).bitwiseAND(_long(255)).cast("int")), step * i) for i in range(count)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def spread(c: Column) -> Column:
    """Bit i of a 31-bit value moves to bit 2i."""
    return _looked_up(_long(c).bitwiseAND(_long(0x7FFFFFFF)), SPREAD_8, 4, 16)


def gather(c: Column) -> Column:
    """Bit 2i moves to bit i; odd bits are dropped."""
    return _looked_up(_long(c).bitwiseAND(_long((1 << 62) - 1)), GATHER_8, 8, 4)


def morton_encode(x: Column, y: Column) -> Column:
    return F.shiftleft(spread(x), 1) + spread(y)


def morton_x(k: Column) -> Column:
    return gather(F.shiftright(_long(k), 1))


def morton_y(k: Column) -> Column:
    return gather(k)


def morton_real(part: Column, scale: float, offset: int = 0) -> Column:
    """Real coordinate of a decoded axis value: (raw + global offset) x scale."""
    return (part + F.lit(offset)) * F.lit(scale)


def quad_cell(k: Column, level: int) -> Column:
    """Cell of a code at a level: its top 2 x level of 62 bits."""
    return _long(k).bitwiseAND(_long(((1 << 2 * level) - 1) << (2 * MAX_BITS - 2 * level)))


def quad_range(code: Column, level: int, bits: int) -> tuple[Column, Column]:
    """First and last Morton code of quad ``code`` of a level in a domain of ``bits`` bits an axis."""
    d = 2 * (bits - level)
    return F.shiftleft(_long(code), d), F.shiftleft(_long(code) + 1, d) - 1


def range_box(low: Column, high: Column) -> list[Column]:
    return [morton_x(low).alias("minx"), morton_y(low).alias("miny"), (morton_x(high) + 1).alias("maxx"), (morton_y(high) + 1).alias("maxy")]


def sql_spread(x: str) -> str:
    out = f"(CAST({x} AS BIGINT) & 2147483647)"
    for shift, mask in SPREAD:
        out = f"(({out} | ({out} << {shift})) & {mask})"
    return out


def sql_gather(x: str) -> str:
    out = f"(CAST({x} AS BIGINT) & {SPREAD[-1][1]})"
    for shift, mask in [*((s, m) for s, (_, m) in zip((1, 2, 4, 8), reversed(SPREAD[:-1]))), (16, 0x7FFFFFFF)]:
        out = f"(({out} | ({out} >> {shift})) & {mask})"
    return out


def sql_encode(x: str, y: str) -> str:
    return f"(({sql_spread(x)} << 1) + {sql_spread(y)})"


def _sql_looked_up(c: str, table: list[int], count: int, step: int) -> str:
    known = f"array({', '.join(f'{v}L' for v in table)})"
    return " | ".join(f"shiftleft(get({known}, CAST(shiftright(CAST({c} AS BIGINT), {8 * i}) & 255 AS INT)), {step * i})" for i in range(count))


def register(spark: SparkSession) -> None:
    """SQL functions of the session: morton_encode, morton_decode_x, morton_decode_y, quad_cell."""
    make = lambda name, result: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS BIGINT RETURN {result}")
    make("morton_spread(v BIGINT)", _sql_looked_up("v & 2147483647L", SPREAD_8, 4, 16))
    make("morton_encode(x INT, y INT)", "shiftleft(morton_spread(x), 1) + morton_spread(y)")
    make("morton_decode_y(k BIGINT)", _sql_looked_up("k & 4611686018427387903L", GATHER_8, 8, 4))
    make("morton_decode_x(k BIGINT)", "morton_decode_y(shiftright(k, 1))")
    make("quad_cell(k BIGINT, level INT)", "((shiftleft(CAST(1 AS BIGINT), 2 * level) - 1) << (62 - 2 * level)) & k")
