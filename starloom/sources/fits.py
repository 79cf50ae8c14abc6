"""FITS binary tables: header cards, a decoder on ``binaryFile`` rows, and an encoder.

The decoder runs where the files are read: one task a file, each record block turned into columns by a numpy dtype.
Atoms follow the standard; unsigned bytes become shorts, logicals booleans, characters strings, complex numbers structs;
floats keep NaN, which ``nulls`` turns into SQL nulls.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, CARD = 2880, 80
# fixed values: atoms of the standard with their big-endian numpy codes and Spark types
ATOMS = {
    "L": ("S1", "boolean"), "X": ("u1", "binary"), "B": ("u1", "smallint"), "I": (">i2", "smallint"), "J": (">i4", "int"), "K": (">i8", "bigint"),
    "E": (">f4", "float"), "D": (">f8", "double"), "A": ("S", "string"), "C": (">c8", "struct<re:float,im:float>"), "M": (">c16", "struct<re:double,im:double>"),
}


def parse_value(text: str):
    """Value of a card: quoted text, logical, whole number, real number or None."""
    text = text.strip()
    if text.startswith("'"):
        body, i = [], 1
        while i < len(text):
            if text[i] == "'":
                if text[i + 1 : i + 2] != "'":
                    break
                i += 1
            body.append(text[i])
            i += 1
        return "".join(body).rstrip()
    text = text.split("/", 1)[0].strip()
    if text in ("T", "F"):
        return text == "T"
    for kind in (int, lambda v: float(v.replace("D", "E").replace("d", "e"))):
        try:
            return kind(text)
        except ValueError:
            continue
    return text or None


def read_header(data: bytes, at: int) -> tuple[dict[str, object], list[str], int]:
    """(values, cards, offset of the data) of the header that begins at ``at``."""
    values: dict[str, object] = {}
    cards: list[str] = []
    while at < len(data):
        block = data[at : at + BLOCK].decode("latin-1")
        at += BLOCK
        for i in range(0, len(block), CARD):
            card = block[i : i + CARD]
            key = card[:8].strip()
            if key == "END":
                return values, cards, at
            cards.append(card.rstrip())
            if card[8:10] == "= ":
                values.setdefault(key, parse_value(card[10:]))
    raise ValueError("header without END")


def data_size(h: dict[str, object]) -> int:
    if not h.get("NAXIS"):
        return 0
    n = abs(int(h["BITPIX"])) // 8
    for i in range(1, int(h["NAXIS"]) + 1):
        n *= int(h[f"NAXIS{i}"])
    return -(-(n + int(h.get("PCOUNT", 0) or 0)) // BLOCK) * BLOCK


def extensions(data: bytes) -> Iterator[tuple[int, dict[str, object], list[str], int]]:
    at, ext = 0, 0
    while at < len(data):
        h, cards, body = read_header(data, at)
        yield ext, h, cards, body
        at, ext = body + data_size(h), ext + 1


def columns(h: dict[str, object]) -> list[tuple[str, int, str]]:
    """(name, repeat, atom) of every column."""
    found = []
    for i in range(1, int(h["TFIELDS"]) + 1):
        m = re.match(r"\s*(\d*)([LXBIJKEDACM])", str(h[f"TFORM{i}"]))
        if not m:
            raise ValueError(f"column format {h[f'TFORM{i}']!r} is not supported")
        found.append((str(h.get(f"TTYPE{i}", f"col{i}")), int(m[1]) if m[1] else 1, m[2]))
    return found


def spark_schema(cols: Sequence[tuple[str, int, str]], lower: bool = True) -> str:
    parts = []
    for name, n, atom in cols:
        kind = ATOMS[atom][1]
        kind = kind if atom in "AX" or n == 1 else f"array<{kind}>"
        parts.append(f"`{name.lower() if lower else name}` {kind}")
    return ", ".join(parts)


def decode(h: dict[str, object], data: bytes, at: int, wanted: Sequence[str] | None = None, rows: tuple[int, int] | None = None, lower: bool = True, mask: np.ndarray | None = None) -> pd.DataFrame:
    """Columns of one table extension; ``wanted`` names, a row range and a mask of its rows are honoured before any conversion."""
    cols = columns(h)
    fields = []
    for i, (_, n, atom) in enumerate(cols):
        code = ATOMS[atom][0]
        fields.append((f"f{i}", f"S{n}") if atom == "A" else (f"f{i}", "u1", ((n + 7) // 8,)) if atom == "X" else (f"f{i}", code) if n == 1 else (f"f{i}", code, (n,)))
    dtype = np.dtype(fields)
    if dtype.itemsize != int(h["NAXIS1"]):
        raise ValueError(f"rows of {h['NAXIS1']} bytes, columns of {dtype.itemsize}")
    table = np.frombuffer(data, dtype, int(h["NAXIS2"]), at)
    if rows:
        table = table[rows[0] : rows[1]]
    if mask is not None:
        table = table[mask]
    out = {}
    for i, (name, n, atom) in enumerate(cols):
        key = name.lower() if lower else name
        if wanted is not None and key not in wanted:
            continue
        v = table[f"f{i}"]
        if atom == "L":
            v = v == b"T"
        elif atom == "A":
            out[key] = [b.decode("latin-1").rstrip("\x00 ") for b in v]
            continue
        elif atom == "X":
            out[key] = [bytes(b) for b in v]
            continue
        elif atom in "CM":
            out[key] = [{"re": float(z.real), "im": float(z.imag)} for z in v] if n == 1 else [[{"re": float(z.real), "im": float(z.imag)} for z in r] for r in v]
            continue
        elif atom == "B":
            v = v.astype(np.int16)
        else:
            v = v.astype(v.dtype.newbyteorder("="))
        out[key] = v if v.ndim == 1 else list(v)
    return pd.DataFrame(out)


def read(spark: SparkSession, path: str, ext: int = 1, columns_: Sequence[str] | None = None, rows: tuple[int, int] | None = None, lower: bool = True, nulls: bool = False) -> DataFrame:
    """One extension of all files under ``path`` as a DataFrame; the first file's header gives the schema."""
    files = spark.read.format("binaryFile").load(path).select("content")
    first = bytes(files.first()["content"])
    head = next(h for e, h, _, _ in extensions(first) if e == ext)
    cols = [c for c in columns(head) if columns_ is None or (c[0].lower() if lower else c[0]) in columns_]

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                data = bytes(content)
                for e, h, _, at in extensions(data):
                    if e == ext:
                        yield decode(h, data, at, [c[0].lower() if lower else c[0] for c in cols], rows, lower)

    df = files.mapInPandas(run, spark_schema(cols, lower))
    if nulls:
        df = df.select(*[F.when(F.isnan(f.name), None).otherwise(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("float", "double") else F.col(f.name) for f in df.schema.fields])
    return df


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, ext, key, value) of every header card with a value."""

    def run(batches):
        for pdf in batches:
            for path_, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(path_, e, k, None if v is None else str(v)) for e, h, _, _ in extensions(bytes(content)) for k, v in h.items()]
                yield pd.DataFrame(rows, columns=["path", "ext", "key", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, ext int, key string, value string")


# --- writing ----------------------------------------------------------------------------------------------------


def card(key: str, value, comment: str = "") -> str:
    if isinstance(value, bool):
        body = f"{'T' if value else 'F':>20}"
    elif isinstance(value, int | float | np.number):
        body = f"{value!r:>20}" if not isinstance(value, np.number) else f"{value.item()!r:>20}"
    else:
        body = "'" + str(value).replace("'", "''").ljust(8) + "'"
    return (f"{key:<8}= {body}" + (f" / {comment}" if comment else ""))[:CARD].ljust(CARD)


def _padded(cards: list[str]) -> bytes:
    text = "".join(c.ljust(CARD) for c in [*cards, "END"])
    return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode("latin-1")


PRIMARY = _padded([card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0), card("EXTEND", True)])


def encode(pdf: pd.DataFrame, extra: Sequence[str] = ()) -> bytes:
    """One table extension from a pandas frame of numbers, booleans, strings and equal-length arrays."""
    dtype, forms, arrays = [], [], []
    for i, name in enumerate(pdf.columns):
        v = pdf[name]
        if v.dtype == object and len(v) and isinstance(v.iloc[0], str):
            width = max(1, int(v.str.len().max()))
            arrays.append(v.str.encode("latin-1", "replace").to_numpy().astype(f"S{width}"))
            forms.append(f"{width}A")
        else:
            a = np.stack(v.to_numpy()) if v.dtype == object and len(v) else v.to_numpy()
            atom = {"b": "L", "u1": "B", "i2": "I", "i4": "J", "i8": "K", "f4": "E", "f8": "D"}[a.dtype.kind if a.dtype.kind == "b" else a.dtype.str[1:]]
            a = np.where(a, b"T", b"F").astype("S1") if atom == "L" else a.astype(ATOMS[atom][0])
            arrays.append(a)
            forms.append(f"{1 if a.ndim == 1 else a.shape[1]}{atom}")
        a = arrays[-1]
        dtype.append((f"f{i}", a.dtype, a.shape[1:]))
    table = np.zeros(len(pdf), np.dtype(dtype))
    for i, a in enumerate(arrays):
        table[f"f{i}"] = a
    cards = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", table.dtype.itemsize), card("NAXIS2", len(pdf)), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(forms))]
    for i, (name, form) in enumerate(zip(pdf.columns, forms, strict=True), 1):
        cards += [card(f"TTYPE{i}", name), card(f"TFORM{i}", form)]
    body = table.tobytes()
    return _padded([*cards, *extra]) + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def merge_wcs(cards: dict[str, str], wcs: dict[str, str]) -> dict[str, str]:
    """Header with another header's coordinate cards: old ones, and their comments, leave first."""
    drop = re.compile(r"^(CTYPE|CRVAL|CRPIX|CDELT|CROTA|CUNIT|LONPOLE|LATPOLE|EQUINOX|WCSAXES|PC\d+_|CD\d+_|PV\d+_|A_|B_|AP_|BP_|IMAGEW|IMAGEH)")
    return {k: v for k, v in cards.items() if not drop.match(k)} | {k: v for k, v in wcs.items() if drop.match(k)}
