"""Delimited text tables: a declared schema over a file, with the source string's settings, and import and export.

``fs``, ``vs`` and ``lvs`` separate fields in general, after VARCHAR and after LONGVARCHAR columns. With one
separator Spark's CSV reader does the work; with several the lines are split by one regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of separators in a source string.
ESCAPES = {r"\semi": ";", r"\quote": '"', r"\space": " ", r"\apos": "'", r"\t": "\t", r"\n": "\n", r"\r": "\r", r"\\": "\\"}


@dataclass(frozen=True)
class TextSettings:
    path: str
    fs: str = ","
    vs: str | None = None
    lvs: str | None = None
    qc: str = '"'
    quoted: bool = True
    all_quoted: bool = False
    ignore_first: bool = False
    null_def: str = ""
    encoding: str = "UTF-8"

    @staticmethod
    def parse(source: str) -> TextSettings:
        """From ``path;key=value;..``; separators may be written by name (``\\semi``, ``\\t``)."""
        path, *rest = re.split(r"(?<!\\);", source)
        out: dict[str, object] = {}
        for part in rest:
            if not part.strip():
                continue
            key, _, value = part.partition("=")
            key = key.strip().lower()
            if key in ("fs", "vs", "lvs", "qc", "null_def"):
                out[key] = re.sub(r"\\(?:semi|quote|space|apos|t|n|r|\\)", lambda m: ESCAPES[m[0]], value)
            elif key in ("quoted", "all_quoted", "ignore_first"):
                out[key] = value.strip().lower() == "true"
            elif key == "encoding":
                out[key] = value.strip()
            elif key not in ("cache_rows", "cache_size", "cache_scale", "cache_size_scale"):
                raise ValueError(f"no such text source setting: {key}")
        return TextSettings(path.strip(), **out)


def read_text_table(spark: SparkSession, schema: T.StructType | str, settings: TextSettings, long_columns: tuple[str, ...] = (), on_error: str = "STOP") -> DataFrame:
    """The file as a table. ``on_error``: STOP raises at a bad line, CONTINUE leaves bad lines out, CHECK reads their bad fields as null."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    mode = {"STOP": "FAILFAST", "CONTINUE": "DROPMALFORMED", "CHECK": "PERMISSIVE"}[on_error.upper()]
    s = settings
    after = [s.lvs if f.name in long_columns and s.lvs else s.vs if isinstance(f.dataType, T.StringType) and s.vs else s.fs for f in schema]
    if len(set(after[:-1])) <= 1:
        reader = spark.read.schema(schema).option("sep", (after or [s.fs])[0]).option("header", s.ignore_first).option("mode", mode)
        reader = reader.option("encoding", s.encoding).option("nullValue", s.null_def).option("enforceSchema", True)
        return reader.option("quote", s.qc if s.quoted else "").option("escape", s.qc).csv(s.path)
    lines = spark.read.option("encoding", s.encoding).text(s.path)
    q = re.escape(s.qc)
    field = lambda sep: f"({q}(?:[^{q}]|{q}{q})*{q}|(?:(?!{re.escape(sep)}).)*)" if s.quoted else f"((?:(?!{re.escape(sep)}).)*)"
    pattern = "^" + re.escape("").join(field(a) + re.escape(a) for a in after[:-1]) + "(.*)$"
    cols = []
    for i, f in enumerate(schema):
        raw = F.regexp_extract("value", pattern, i + 1)
        if s.quoted:
            inner = F.replace(F.substring(raw, F.lit(2), F.char_length(raw) - 2), F.lit(s.qc * 2), F.lit(s.qc))
            raw = F.when(raw.startswith(s.qc), inner).otherwise(raw)
        text = F.when(raw != s.null_def, raw)
        cols.append((text.cast(f.dataType) if on_error.upper() == "STOP" else text.try_cast(f.dataType)).alias(f.name))
    good = lines.where(F.col("value").rlike(pattern)) if on_error.upper() == "CONTINUE" else lines
    return good.select(*cols)


def write_text_table(df: DataFrame, settings: TextSettings) -> None:
    """EXPORT DATA: a folder of delimited files, one for each partition."""
    s = settings
    out = df.write.option("sep", s.fs).option("header", s.ignore_first).option("quoteAll", s.all_quoted).option("nullValue", s.null_def)
    out.option("emptyValue", s.qc * 2).option("quote", s.qc).option("escape", s.qc).option("encoding", s.encoding).csv(s.path)
