"""Arithmetic with this engine's result types, rounding rules and domain errors, as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relquill.functions.strings import _same, col

#: Result of + and * over integer types: the operands' widths add up.
_WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8}


def promoted(a: str, b: str) -> str:
    """Spark type of ``a + b`` and ``a * b`` for integer types: smallint and smallint make int, int and int bigint, beyond that decimal(38,0)."""
    width = _WIDTH[a] + _WIDTH[b]
    return "smallint" if width <= 2 else "int" if width <= 4 else "bigint" if width <= 8 else "decimal(38,0)"


def add(a: Column, b: Column, kind: str = "bigint") -> Column:
    """Sum in ``kind`` (see ``promoted``), so that it cannot overflow the operands' type."""
    return a.cast(kind) + b.cast(kind)


def multiply(a: Column, b: Column, kind: str = "bigint") -> Column:
    return a.cast(kind) * b.cast(kind)


def int_divide(a, b) -> Column:
    """Integer division, towards zero; a zero divisor raises."""
    return F.call_function("div", col(a), col(b))


def decimal_divide(a, b, scale: int) -> Column:
    """Quotient cut (not rounded) to ``scale`` digits."""
    wide = col(a).cast("decimal(38,18)") / col(b).cast("decimal(38,18)")
    return truncate(wide, scale).cast(f"decimal(38,{scale})")


def truncate(x, digits: int = 0) -> Column:
    """Towards zero at ``digits`` decimal places (before the point if negative)."""
    x = col(x)
    size = F.abs(x).cast("decimal(26,12)")
    unit = F.lit(10 ** abs(digits)).cast("decimal(10,0)")
    if digits >= 0:
        back = (F.floor(size * unit).cast("decimal(27,0)") / unit).cast(f"decimal(38,{digits})")
    else:
        back = (F.floor(size / unit).cast("decimal(27,0)") * unit).cast("decimal(38,0)")
    return F.when(x < 0, -back).otherwise(back)


def round_number(x, digits: int = 0, double: bool = False) -> Column:
    """Half up for decimals and integers, half to even for doubles."""
    return F.bround(col(x), digits) if double else F.round(col(x), digits)


def _domain(bad: Column, good: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit("2201E data exception: invalid argument"))).otherwise(good)


def ln(x) -> Column:
    return _domain(col(x) <= 0, F.ln(col(x)))


def log10(x) -> Column:
    return _domain(col(x) <= 0, F.log10(col(x)))


def sqrt(x) -> Column:
    return _domain(col(x) < 0, F.sqrt(col(x)))


def keep_type(name: str):
    """``name`` with its result cast to ``kind``, the argument's type."""
    def made(x, kind: str = "double") -> Column:
        return F.call_function(name, col(x)).cast(kind)

    return made


def sign(x) -> Column:
    return F.signum(col(x)).cast("int")


def cot(x) -> Column:
    return F.cot(col(x))


def bit_and_not(a, b) -> Column:
    return col(a).bitwiseAND(F.bitwise_not(col(b)))


#: SQL name -> column builder.
FUNCTIONS = {
    "ABS": _same("abs"), "ACOS": _same("acos"), "ASIN": _same("asin"), "ATAN": _same("atan"), "ATAN2": _same("atan2"),
    "BITAND": lambda a, b: col(a).bitwiseAND(col(b)), "BITANDNOT": bit_and_not, "BITNOT": lambda a: F.bitwise_not(col(a)),
    "BITOR": lambda a, b: col(a).bitwiseOR(col(b)), "BITXOR": lambda a, b: col(a).bitwiseXOR(col(b)),
    "CEILING": keep_type("ceil"), "CEIL": keep_type("ceil"), "FLOOR": keep_type("floor"), "COS": _same("cos"), "COSH": _same("cosh"), "COT": cot,
    "DEGREES": _same("degrees"), "EXP": _same("exp"), "LN": ln, "LOG": ln, "LOG10": log10, "MOD": _same("mod"), "NANVL": _same("nanvl"),
    "PI": _same("pi"), "POWER": _same("power"), "RADIANS": _same("radians"), "RAND": _same("rand"), "ROUND": round_number, "ROUNDMAGIC": round_number,
    "SIGN": sign, "SIN": _same("sin"), "SINH": _same("sinh"), "SQRT": sqrt, "TAN": _same("tan"), "TANH": _same("tanh"),
    "TO_NUMBER": lambda s, p=38, d=10: col(s).cast(f"decimal({p},{d})"), "TRUNC": truncate, "TRUNCATE": truncate, "WIDTH_BUCKET": _same("width_bucket"),
}
