"""FITS binary tables as a data source of the session: ``spark.read.format("fits_table")`` and ``df.write.format("fits_table")``.

Headers alone are read to plan: a file is cut into ranges of rows, each a task that reads just its bytes. Columns that
the schema does not name are never converted, and comparisons of number and boolean columns are tested on the raw
records before anything else is. A task writes its rows into files of its own, which get their names when the whole
write has succeeded.

Options: ``path`` (a file or a folder of them), ``ext`` (1), ``rows`` (1,000,000 a range or file), ``lower`` (true: column
names in lower case). Paths are those that Arrow's file systems open; other stores are read by ``fits.read``, which lets
Spark read the files.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from starloom.sources import fits

NAME = "fits_table"
HELD = 1 << 16


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FitsTable)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path)) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    store, inner = _store(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    hidden = lambda p: any(part.startswith(("_", ".")) for part in p[len(inner) :].split("/"))
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and not hidden(f.path))


def _header(path: str, ext: int) -> tuple[dict[str, object], int]:
    """Header values of an extension and where its data begin; only headers are read."""
    store, inner = _store(path)
    with store.open_input_file(inner) as f:
        at, size = 0, f.size()
        for k in range(ext + 1):
            raw = b""
            while at + len(raw) < size:
                raw += f.read_at(fits.BLOCK, at + len(raw))
                try:
                    h, _, used = fits.read_header(raw, 0)
                    break
                except ValueError:
                    continue
            else:
                raise ValueError(f"{path}: no extension {ext}")
            if k == ext:
                return h, at + used
            at += used + fits.data_size(h)
    raise ValueError(f"{path}: no extension {ext}")


@dataclass
class Rows(ds.InputPartition):
    """Rows lo to hi of the table whose records begin at byte ``at``."""

    path: str
    header: dict
    at: int
    lo: int
    hi: int


def _test(f: ds.Filter) -> Callable[[np.ndarray], np.ndarray] | None:
    """A pushed comparison on raw values, with NaN above all numbers and equal to itself; None where Spark has to decide."""
    value = getattr(f, "value", None)
    if isinstance(f, ds.In):
        if all(isinstance(v, int | float | bool) and v == v for v in f.value):
            return lambda a: np.isin(a, np.array(f.value))
        return None
    if not isinstance(value, int | float | bool) or value != value:
        return None
    above = lambda a: np.isnan(a) if a.dtype.kind == "f" else np.zeros(len(a), bool)
    kinds: dict[type, Callable[[np.ndarray], np.ndarray]] = {
        ds.EqualTo: lambda a: a == value, ds.GreaterThan: lambda a: (a > value) | above(a), ds.GreaterThanOrEqual: lambda a: (a >= value) | above(a), ds.LessThan: lambda a: a < value, ds.LessThanOrEqual: lambda a: a <= value,
    }
    return kinds.get(type(f))


class FitsReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.ext, self.rows = options["path"], int(options.get("ext", 1)), int(options.get("rows", 1_000_000))
        self.lower = str(options.get("lower", "true")).lower() == "true"
        self.schema = schema
        self.tests: list[tuple[str, Callable[[np.ndarray], np.ndarray]]] = []

    def _name(self, name: str) -> str:
        return name.lower() if self.lower else name

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        plain = {f.name for f in self.schema.fields if f.dataType.typeName() in ("short", "integer", "long", "float", "double", "boolean")}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            test = _test(f) if column in plain else None
            if test is not None:
                self.tests.append((column, test))
            elif not (isinstance(f, ds.IsNotNull) and column in plain):  # numbers in these tables are never null
                yield f

    def partitions(self) -> list[Rows]:
        found, shape = [], None
        for path in _files(self.path):
            h, at = _header(path, self.ext)
            # texts may be of different lengths from file to file
            own = {self._name(c[0]): fits.spark_schema([c]) for c in fits.columns(h)}
            missing = set(self.schema.names) - set(own)
            if missing or shape is not None and {n: own[n] for n in self.schema.names} != shape:
                raise ValueError(f"{path}: columns differ from those asked for: {sorted(missing) or list(own.values())}")
            shape = {n: own[n] for n in self.schema.names}
            n = int(h["NAXIS2"])
            found += [Rows(path, h, at, lo, min(n, lo + self.rows)) for lo in range(0, n, self.rows)]
        return found

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        width = int(part.header["NAXIS1"])
        store, inner = _store(part.path)
        arrow = to_arrow_schema(self.schema)
        with store.open_input_file(inner) as f:
            for lo in range(part.lo, part.hi, HELD):
                n = min(part.hi, lo + HELD) - lo
                data, h = f.read_at(n * width, part.at + lo * width), part.header | {"NAXIS2": n}
                keep = np.ones(n, bool)
                if self.tests:
                    looked = fits.decode(h, data, 0, [c for c, _ in self.tests], None, self.lower)
                    for column, test in self.tests:
                        keep &= test(looked[column].to_numpy())
                if keep.any():
                    out = fits.decode(h, data, 0, self.schema.names, None, self.lower, keep)
                    yield pa.RecordBatch.from_arrays([pa.array(out[c].tolist() if out[c].dtype == object else out[c].to_numpy(), arrow.field(c).type, from_pandas=False) for c in self.schema.names], schema=arrow)


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[tuple[str, str]]


class FitsWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.rows, self.overwrite = options["path"], int(options.get("rows", 1_000_000)), overwrite
        self.attempt = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, inner = _store(self.path)
        held: list[pd.DataFrame] = []
        done: list[tuple[str, str]] = []

        def drain() -> None:
            name = f"part-{uuid.uuid4().hex}.fits"
            at = f"{inner}/_writing-{self.attempt}/{name}"
            store.create_dir(f"{inner}/_writing-{self.attempt}", recursive=True)
            with store.open_output_stream(at) as out:
                out.write(fits.PRIMARY + fits.encode(pd.concat(held, ignore_index=True)))
            done.append((at, f"{inner}/{name}"))
            held.clear()

        for batch in iterator:
            for lo in range(0, batch.num_rows, self.rows):
                held.append(batch.slice(lo, self.rows).to_pandas())
                if sum(map(len, held)) >= self.rows:
                    drain()
        if any(map(len, held)):
            drain()
        return Written(done)

    def commit(self, messages: list) -> None:
        store, inner = _store(self.path)
        old = [f.path for f in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if f.type == fs.FileType.File] if self.overwrite else []
        for m in messages:
            for at, to in m.files if m else ():
                store.move(at, to)
        for f in old:
            store.delete_file(f)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, inner = _store(self.path)
        if store.get_file_info(f"{inner}/_writing-{self.attempt}").type == fs.FileType.Directory:
            store.delete_dir(f"{inner}/_writing-{self.attempt}")


class FitsTable(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"{self.options['path']}: no files")
        h, _ = _header(files[0], int(self.options.get("ext", 1)))
        return fits.spark_schema(fits.columns(h), str(self.options.get("lower", "true")).lower() == "true")

    def reader(self, schema: StructType) -> FitsReader:
        return FitsReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> FitsWriter:
        return FitsWriter(self.options, overwrite)

