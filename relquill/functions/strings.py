"""String and binary functions with this engine's SQL rules, as column builders that stay inside Spark's code generation.

Arguments are columns; anything else is a literal. Lengths are bigint, characters count two octets,
hexadecimal digits are lower case, positions start at 1, and every function of a null is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value) -> Column:
    """A column as it is, anything else as a literal."""
    return value if isinstance(value, Column) else F.lit(value)


def ascii_code(s) -> Column:
    """Code of the first character (its UTF-16 unit); null for the empty string."""
    s = col(s)
    code = F.ascii(s)
    unit = F.when(code > 0xFFFF, F.lit(0xD800) + F.shiftright(code - 0x10000, 10)).otherwise(code)
    return F.when(F.char_length(s) > 0, unit.cast("int"))


def asciistr(s) -> Column:
    r"""Every character outside ASCII as ``\XXXX``, a backslash doubled by its own escape."""
    def one(c: Column) -> Column:
        escaped = F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "(.{4})", r"\\$1")
        return F.when(F.ascii(c) < 128, c).otherwise(escaped)

    return F.array_join(F.transform(F.split(col(s), ""), one), "")


def unistr(s) -> Column:
    r"""``\XXXX`` and ``\+XXXXXX`` as the characters they stand for."""
    def one(p: Column) -> Column:
        units = F.decode(F.unhex(F.regexp_replace(p, r"\\", "")), "UTF-16BE")
        point = F.decode(F.unhex(F.concat(F.lit("00"), F.substring(p, 3, 6))), "UTF-32")
        plain = F.when(p == "\\\\", F.lit("\\")).otherwise(p)
        return F.when(p.rlike(r"^(?:\\[0-9A-Fa-f]{4})+$"), units).when(p.rlike(r"^\\\+[0-9A-Fa-f]{6}$"), point).otherwise(plain)

    pieces = F.regexp_extract_all(col(s), F.lit(r"(?s)(?:\\[0-9A-Fa-f]{4})+|\\\+[0-9A-Fa-f]{6}|\\\\|[^\\]+|\\"), 0)
    return F.array_join(F.transform(pieces, one), "")


def char(n) -> Column:
    """The character with code point ``n``, not taken modulo 256."""
    return F.decode(F.unhex(F.lpad(F.hex(col(n).cast("long")), 8, "0")), "UTF-32")


def char_length(s) -> Column:
    return F.char_length(col(s)).cast("long")


def octet_length(s) -> Column:
    """Two octets a character."""
    return (F.char_length(col(s)) * 2).cast("long")


def bit_length(s) -> Column:
    return (F.char_length(col(s)) * 16).cast("long")


def binary_octet_length(b) -> Column:
    return F.octet_length(col(b)).cast("long")


def binary_bit_length(b) -> Column:
    return F.bit_length(col(b)).cast("long")


def difference(a, b) -> Column:
    """0 to 4: how much two soundex codes agree, first letters and then digits in order."""
    x, y = F.soundex(col(a)), F.soundex(col(b))
    hits = (F.substring(x, 1, 1) == F.substring(y, 1, 1)).cast("int")
    start: Column = F.lit(2)
    for i in (2, 3, 4):
        place = F.call_function("locate", F.substring(y, i, 1), x, start)
        hits = hits + (place > 0).cast("int")
        start = F.when(place > 0, place + 1).otherwise(start)
    return hits


def soundex(s) -> Column:
    """Four characters; letters alone count, and a string without one gives 0000."""
    letters = F.regexp_replace(col(s), "[^A-Za-z]", "")
    return F.when(letters == "", F.lit("0000")).otherwise(F.soundex(letters))


def hex_number(n) -> Column:
    return F.lower(F.hex(col(n).cast("long")))


def rawtohex(b) -> Column:
    return F.lower(F.hex(col(b)))


def insert(s, start, length, new) -> Column:
    """``new`` in place of ``length`` characters from ``start``."""
    return F.overlay(col(s), col(new), col(start), col(length))


def overlay(s, new, start, length=None) -> Column:
    new = col(new)
    return F.overlay(col(s), new, col(start), F.char_length(new) if length is None else col(length))


def position(sub, s, start=1) -> Column:
    """First place of ``sub`` at or after ``start``; 0 if there is none."""
    return F.call_function("locate", col(sub), col(s), col(start)).cast("long")


def instr(s, sub, start=1) -> Column:
    return position(sub, s, start)


def substring(s, start, length=None) -> Column:
    """The window [start, start + length) clipped to the string: places before 1 use up its length."""
    s, start = col(s), col(start).cast("long")
    n = F.char_length(s).cast("long")
    end = n + 1 if length is None else F.least(start + col(length).cast("long"), n + 1)
    first = F.greatest(start, F.lit(1))
    taken = F.when(end > first, F.substring(s, first.cast("int"), (end - first).cast("int"))).otherwise(F.lit(""))
    out = F.when(s.isNotNull() & start.isNotNull(), taken)
    if length is None:
        return out
    wrong = col(length).cast("long") < 0
    return F.when(wrong, F.raise_error(F.lit("22011 data exception: substring error"))).otherwise(F.when(col(length).isNotNull(), out))


def left(s, n) -> Column:
    return F.when(col(n) < 0, F.raise_error(F.lit("22011 data exception: substring error"))).otherwise(substring(s, 1, n))


def right(s, n) -> Column:
    s = col(s)
    n = col(n)
    wrong = F.raise_error(F.lit("22011 data exception: substring error"))
    return F.when(n < 0, wrong).otherwise(substring(s, F.greatest(F.char_length(s) - n + 1, F.lit(1)), F.char_length(s)))


def lpad(s, n, pad=" ") -> Column:
    """Blanks at both ends go first, then the string is padded or cut to ``n``."""
    return F.call_function("lpad", F.trim(col(s)), col(n), col(pad))


def rpad(s, n, pad=" ") -> Column:
    return F.call_function("rpad", F.trim(col(s)), col(n), col(pad))


def trim(s, chars=" ", side: str = "both") -> Column:
    chars = col(chars)
    if side == "leading":
        return F.ltrim(col(s), chars)
    return F.rtrim(col(s), chars) if side == "trailing" else F.trim(col(s), chars)


def regexp_like(s, pattern) -> Column:
    """Whether the whole string matches."""
    return F.rlike(col(s), F.concat(F.lit("^(?:"), col(pattern), F.lit(")$")))


def regexp_replace(s, pattern, new="", first_only: bool = False) -> Column:
    """All matches (or the first alone) replaced; ``new`` may refer to groups as $1 ... $9."""
    if not first_only:
        return F.regexp_replace(col(s), col(pattern), col(new))
    place = F.regexp_instr(col(s), col(pattern))
    found = F.regexp_substr(col(s), col(pattern))
    swapped = F.regexp_replace(found, col(pattern), col(new))
    return F.when(place > 0, F.overlay(col(s), swapped, place, F.char_length(found))).otherwise(col(s))


def concat_ws(separator, *parts) -> Column:
    return F.call_function("concat_ws", col(separator), *[col(p).cast("string") for p in parts])


def uuid_text(b) -> Column:
    """16 bytes as the canonical text."""
    return F.regexp_replace(F.lower(F.hex(col(b))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def uuid_bytes(s) -> Column:
    return F.unhex(F.regexp_replace(col(s), "-", ""))


def blank_padded_equal(a, b) -> Column:
    """Equality under PAD SPACE: blanks at the end do not count."""
    return F.rtrim(col(a)) == F.rtrim(col(b))


def _same(name: str):
    def made(*args) -> Column:
        return F.call_function(name, *[col(a) for a in args])

    return made


#: SQL name -> column builder.
FUNCTIONS = {
    "ASCII": ascii_code, "ASCIISTR": asciistr, "BITLENGTH": bit_length, "BIT_LENGTH": bit_length, "CHAR": char, "CHR": char,
    "CHARACTER_LENGTH": char_length, "CHAR_LENGTH": char_length, "LENGTH": char_length, "CONCAT": _same("concat"), "CONCAT_WS": concat_ws,
    "DIFFERENCE": difference, "FROM_BASE64": _same("unbase64"), "TO_BASE64": _same("base64"), "HEX": hex_number, "HEXTORAW": _same("unhex"),
    "UNHEX": _same("unhex"), "RAWTOHEX": rawtohex, "INSERT": insert, "OVERLAY": overlay, "INSTR": instr, "LOCATE": position, "POSITION": position,
    "LCASE": _same("lower"), "LOWER": _same("lower"), "UCASE": _same("upper"), "UPPER": _same("upper"), "LEFT": left, "RIGHT": right,
    "LPAD": lpad, "RPAD": rpad, "LTRIM": lambda s: trim(s, side="leading"), "RTRIM": lambda s: trim(s, side="trailing"), "TRIM": trim,
    "NEWID": _same("uuid"), "SYS_GUID": lambda: uuid_bytes(F.expr("uuid()")), "UUID": lambda *a: uuid_text(*a) if a else F.expr("uuid()"),
    "OCTETLENGTH": octet_length, "OCTET_LENGTH": octet_length, "REGEXP_COUNT": _same("regexp_count"), "REGEXP_INSTR": _same("regexp_instr"),
    "REGEXP_LIKE": regexp_like, "REGEXP_MATCHES": regexp_like, "REGEXP_REPLACE": regexp_replace, "REGEXP_SUBSTR": _same("regexp_substr"),
    "REGEXP_SUBSTRING": _same("regexp_substr"), "REGEXP_SUBSTRING_ARRAY": lambda s, p: F.regexp_extract_all(col(s), col(p), 0),
    "REPEAT": _same("repeat"), "REPLACE": _same("replace"), "REVERSE": _same("reverse"), "SOUNDEX": soundex, "SPACE": _same("space"),
    "SUBSTR": substring, "SUBSTRING": substring, "TRANSLATE": _same("translate"), "UNISTR": unistr,
}
