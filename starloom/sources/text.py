"""Text formats: delimited tables, pipe tables with typed headers, VOTable XML, typed-struct parameter files, ephemerides."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT_NULL = -1000000


def text_table(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True, null_values: Sequence[str] = ("", "NaN", "null"), int_null: int | None = None) -> DataFrame:
    """Delimited text with a schema; comment lines and lines of the wrong arity are left out.

    Null tokens become SQL nulls, or ``int_null`` in whole-number columns where the sentinel is asked for.
    """
    # lines are parsed whole whatever columns are asked for: a pruned parser cannot tell their arity
    df = spark.read.option("columnPruning", "false").csv(path, schema=schema, sep=sep, header=header, comment="#", mode="DROPMALFORMED", nullValue=null_values[0], nanValue="NaN", enforceSchema=True)
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(~c.isin(*null_values), c)
        elif isinstance(f.dataType, T.FractionalType):
            c = F.when(~F.isnan(c), c)
        elif int_null is not None and isinstance(f.dataType, T.IntegralType):
            c = F.coalesce(c, F.lit(int_null).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def pipe_table(spark: SparkSession, path: str) -> DataFrame:
    """A table whose header lines hold names and types between pipes; backslash lines are comments."""
    lines = spark.read.text(path)
    head = [r[0] for r in lines.where(F.col("value").startswith("|")).limit(2).collect()]
    names = [p.strip() for p in head[0].strip().strip("|").split("|")]
    kinds = [p.strip().lower() for p in head[1].strip().strip("|").split("|")]
    ends, at = [], 0
    for p in head[0].rstrip("\n")[1:].split("|")[: len(names)]:
        ends.append((at, len(p) + 1))
        at += len(p) + 1
    kind = lambda k: "bigint" if k.startswith(("int", "long")) else "double" if k.startswith(("double", "float", "real")) else "string"
    data = lines.where(~F.col("value").startswith("|") & ~F.col("value").startswith("\\") & (F.trim("value") != ""))
    cell = lambda a, n: F.trim(F.substring("value", a + 1, n))
    return data.select(*[F.when(~cell(a, n).isin("null", ""), cell(a, n)).cast(kind(k)).alias(name) for name, k, (a, n) in zip(names, kinds, ends, strict=True)])


VOTABLE_TYPES = {"short": "smallint", "int": "int", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean", "char": "string", "unicodeChar": "string"}


def parse_votable(text: str) -> tuple[list[tuple[str, str]], list[list[str | None]]]:
    """Fields (name, Spark type) and rows of the first table."""
    root = ET.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    table = next(root.iter("TABLE"))
    fields = [(f.get("name"), VOTABLE_TYPES.get(f.get("datatype"), "string") if f.get("arraysize") in (None, "1") or f.get("datatype") == "char" else "string") for f in table.iter("FIELD")]
    return fields, [[(td.text or "").strip() or None for td in tr.iter("TD")] for tr in table.iter("TR")]


def votable(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the VOTable files under ``path``; the first file gives the schema."""
    files = spark.read.text(path, wholetext=True)
    fields, _ = parse_votable(files.first()[0])

    def run(batches):
        for pdf in batches:
            for text in pdf["value"]:
                yield pd.DataFrame(parse_votable(text)[1], columns=[n for n, _ in fields], dtype=object)

    df = files.mapInPandas(run, ", ".join(f"`{n}` string" for n, _ in fields))
    return df.select(*[F.col(n).cast(k).alias(n) for n, k in fields])


STRUCT = re.compile(r"typedef\s+struct\s*\{(.*?)\}\s*(\w+)\s*;", re.S)
ENUM = re.compile(r"typedef\s+enum\s*\{(.*?)\}\s*(\w+)\s*;", re.S)
MEMBER = re.compile(r"(\w+)\s+(\w+)((?:\[\d*\])*)\s*;")
STRUCT_TYPES = {"short": "smallint", "int": "int", "long": "bigint", "float": "float", "double": "double", "char": "string"}


def parse_parameters(text: str) -> tuple[dict[str, str], dict[str, tuple[list[tuple[str, str]], list[list]]]]:
    """(keyword values, tables) of a parameter file: typed structs and enums, then rows that begin with a struct's name."""
    enums = {m[2] for m in ENUM.finditer(text)}
    tables: dict[str, tuple[list[tuple[str, str]], list[list]]] = {}
    for m in STRUCT.finditer(text):
        cols = []
        for kind, name, dims in MEMBER.findall(m[1]):
            base = "string" if kind in enums else STRUCT_TYPES.get(kind, "string")
            sizes = re.findall(r"\[(\d*)\]", dims)
            cols.append((name, f"array<{base}>" if len(sizes) > (base == "string" and kind == "char") else base))
        tables[m[2].upper()] = (cols, [])
    body = ENUM.sub("", STRUCT.sub("", text))
    keys: dict[str, str] = {}
    for line in re.sub(r"\\\s*\n", " ", body).splitlines():
        line = re.sub(r'^((?:[^"#]|"[^"]*")*)#.*$', r"\1", line).strip()
        if not line:
            continue
        words = [w[0] or w[1] or w[2] for w in re.findall(r'"([^"]*)"|(\{[^}]*\})|([^\s"]+)', line)]
        name = words[0].upper()
        if name not in tables:
            keys[words[0]] = line[len(words[0]) :].strip()
            continue
        row, at = [], 1
        for _, kind in tables[name][0]:
            word = words[at] if at < len(words) else ""
            row.append(re.findall(r'"[^"]*"|[^\s{}"]+', word) if kind.startswith("array") else word)
            at += 1
        tables[name][1].append(row)
    return keys, tables


def parameters(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table of the parameter files under ``path``."""
    files = spark.read.text(path, wholetext=True)
    cols, _ = parse_parameters(files.first()[0])[1][table.upper()]

    def run(batches):
        for pdf in batches:
            for text in pdf["value"]:
                rows = parse_parameters(text)[1].get(table.upper(), ([], []))[1]
                yield pd.DataFrame(rows, columns=[n for n, _ in cols], dtype=object)

    df = files.mapInPandas(run, ", ".join(f"`{n}` {'array<string>' if k.startswith('array') else 'string'}" for n, k in cols))
    return df.select(*[F.col(n).cast(k).alias(n) for n, k in cols])


def write_parameters(pdf: pd.DataFrame, name: str, keys: dict[str, str] | None = None, append: bool = False) -> str:
    """A parameter file of one table, or only its rows to append."""
    kind = lambda v: "char" if v.dtype == object else {"i2": "short", "i4": "int", "i8": "long", "f4": "float", "f8": "double"}[v.dtype.str[1:]]
    lines = []
    if not append:
        lines += [f"{k} {v}" for k, v in (keys or {}).items()]
        lines += ["typedef struct {", *[f"  {kind(pdf[c])} {c}{'[' + str(int(pdf[c].str.len().max()) + 1) + ']' if pdf[c].dtype == object else ''};" for c in pdf.columns], f"}} {name.upper()};", ""]
    quoted = lambda v: f'"{v}"' if isinstance(v, str) else repr(v)
    lines += [" ".join([name.upper(), *map(quoted, r)]) for r in pdf.itertuples(index=False)]
    return "\n".join(lines) + "\n"


# --- ephemerides ------------------------------------------------------------------------------------------------

EPHEMERIS = r"^\s*(\d{4}-[A-Za-z]{3}-\d{2} \d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)\s+\S*\s*(\d{2}) (\d{2}) (\d{2}\.?\d*)\s+([+-]\d{2}) (\d{2}) (\d{2}\.?\d*)"


def parse_ephemerides(lines: DataFrame, col: str = "value") -> DataFrame:
    """(at, ra, dec) of ephemeris lines between the start and end marks' kind of rows."""
    part = lambda i: F.regexp_extract(col, EPHEMERIS, i)
    num = lambda i: part(i).cast("double")
    sign = F.when(part(5).startswith("-"), -1.0).otherwise(1.0)
    rows = lines.where(F.col(col).rlike(EPHEMERIS))
    return rows.select(part(1).alias("at"), (15.0 * (num(2) + num(3) / 60 + num(4) / 3600)).alias("ra"), (sign * (F.abs(num(5)) + num(6) / 60 + num(7) / 3600)).alias("dec"))


def elements(text: Column) -> dict[str, Column]:
    """Orbital elements by key from ``KEY= value`` text."""
    return {k.lower(): F.regexp_extract(text, rf"\b{k}\s*=\s*([-+0-9.Ee]+)", 1).cast("double") for k in ("EC", "QR", "IN", "OM", "W", "MA", "TA", "A", "N")}


# --- files ------------------------------------------------------------------------------------------------------

# fixed values: leading bytes of file formats
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpeg"), (b"GIF8", "gif"), (b"SIMPLE  =", "fits"), (b"II*\x00", "tiff"), (b"MM\x00*", "tiff"), (b"BM", "bmp"), (b"P5", "pgm"), (b"P6", "ppm"), (b"P4", "pbm"),
    (b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"PK\x03\x04", "zip"), (b"%PDF", "pdf"), (b"\xfd7zXZ", "xz"), (b"<?xml", "xml"),
]


def file_kind(content: Column) -> Column:
    """Format by leading bytes; null if unknown."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.lit(None).cast("string")
    for magic, kind in reversed(MAGIC):
        out = F.when(head.startswith(magic.hex().upper()), F.lit(kind)).otherwise(out)
    return out


def discover(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length, kind) of the files under a folder that match a pattern; contents are read for the kind only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", file_kind(F.col("content")).alias("kind"))
