"""The table source: planning by headers, pruning, pushed comparisons, writing."""

import glob
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starloom.sources import fits
from starloom.sources import fits_source as src


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 500
    flux = rng.normal(0, 10, n)
    flux[::50] = np.nan
    return pd.DataFrame({"ID": np.arange(n), "Flux": flux, "mag": rng.normal(20, 2, n).astype(np.float32), "good": rng.random(n) < 0.5, "name": [f"star {i % 7}" for i in range(n)], "pos": [list(map(float, rng.normal(0, 1, 3))) for _ in range(n)]})


@pytest.fixture(scope="module")
def folder(spark, frame, tmp_path_factory):
    src.register(spark)
    path = tmp_path_factory.mktemp("fits")
    for k in range(2):
        other = fits.encode(pd.DataFrame({"x": [1, 2]}))
        (path / f"t{k}.fits").write_bytes(fits.PRIMARY + fits.encode(frame.iloc[250 * k : 250 * k + 250]) + other)
    (path / "_ignored").write_text("no table")
    return str(path)


def test_two_ranges_a_file(spark, folder, frame):
    df = spark.read.format(src.NAME).option("rows", 130).load(folder)
    assert df.columns == ["id", "flux", "mag", "good", "name", "pos"] and df.rdd.getNumPartitions() == 4
    got = df.orderBy("id").toPandas()
    for c, own in zip(got.columns, frame.columns, strict=True):
        want = frame[own].tolist()
        assert all(a == b or a != a and b != b or np.allclose(a, b) for a, b in zip(got[c].tolist(), want, strict=True)), c
    upper = spark.read.format(src.NAME).option("lower", "false").load(f"{folder}/t0.fits")
    assert upper.columns[:2] == ["ID", "Flux"] and upper.count() == 250
    assert [r.x for r in spark.read.format(src.NAME).option("ext", 2).load(f"file://{folder}/t1.fits").collect()] == [1, 2]


def test_only_the_bytes_of_the_rows_are_read(spark, folder, monkeypatch):
    reader = src.FitsReader({"path": folder, "rows": "100"}, StructType.fromDDL("id long, mag float"))
    parts = reader.partitions()
    assert [(p.lo, p.hi) for p in parts] == [(0, 100), (100, 200), (200, 250)] * 2
    # a file whose other rows are gone
    p = parts[1]
    data = bytearray(open(p.path, "rb").read())
    width = int(p.header["NAXIS1"])
    data[p.at : p.at + 100 * width] = b"\xff" * (100 * width)
    broken = f"{folder}/_broken"
    with open(broken, "wb") as f:
        f.write(data)
    p.path = broken
    (batch,) = reader.read(p)
    assert batch.schema.names == ["id", "mag"] and batch.column(0).to_pylist() == list(range(100, 200))


@pytest.mark.parametrize("where", ["id >= 240 AND id < 260", "flux > 5", "flux <= -3.5", "flux = 'NaN'", "isnan(flux)", "good", "NOT good AND mag > 20", "name = 'star 3'", "name LIKE 'star%' AND id IN (1, 2, 499)", "id = 3 OR flux > 20", "id IS NOT NULL", "flux IS NULL", "mag BETWEEN 19 AND 19.5", "flux > mag - 20", "id <> 4 AND id <=> 5"])
def test_filters_give_what_spark_gives(spark, folder, frame, where):
    plain = spark.createDataFrame(frame.drop(columns="pos").rename(columns=str.lower))
    got = spark.read.format(src.NAME).option("rows", 99).load(folder).where(where)
    assert sorted(r.id for r in got.select("id").collect()) == sorted(r.id for r in plain.where(where).collect())


def test_pushed_comparisons_leave_the_rest_to_spark(folder, frame):
    reader = src.FitsReader({"path": folder}, StructType.fromDDL("id long, flux double, name string"))
    pushed = [ds.GreaterThan(("flux",), 5.0), ds.In(("id",), tuple(range(60))), ds.IsNotNull(("id",))]
    left = [ds.EqualTo(("name",), "x"), ds.IsNull(("flux",)), ds.Not(ds.EqualTo(("id",), 3)), ds.LessThan(("flux",), float("nan")), ds.IsNotNull(("name",))]
    assert list(reader.pushFilters([*pushed, *left])) == left and [c for c, _ in reader.tests] == ["flux", "id"]
    (batch,) = (b for p in reader.partitions() for b in reader.read(p))
    assert batch.column(0).to_pylist() == [i for i in range(60) if not frame["Flux"][i] <= 5]


def test_columns_that_differ(spark, folder, tmp_path):
    for k, c in enumerate(("a", "b")):
        (tmp_path / f"{k}.fits").write_bytes(fits.PRIMARY + fits.encode(pd.DataFrame({c: [1]})))
    with pytest.raises(Exception, match="columns differ"):
        spark.read.format(src.NAME).load(str(tmp_path)).count()
    with pytest.raises(Exception, match="no files"):
        spark.read.format(src.NAME).load(str(tmp_path / "none")).count()


def test_written_and_read_again(spark, folder, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(1000).select("id", (F.col("id") * 0.5).alias("half"), F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 2 == 0).alias("even"))
    df.repartition(3).write.format(src.NAME).mode("append").option("rows", 200).save(path)
    files = glob.glob(f"{path}/*.fits")
    assert len(files) == 6 and not glob.glob(f"{path}/_*")
    assert sorted(map(tuple, spark.read.format(src.NAME).load(path).collect())) == sorted(map(tuple, df.collect()))
    df.limit(5).write.format(src.NAME).mode("append").save(path)
    assert spark.read.format(src.NAME).load(path).count() == 1005
    df.limit(7).write.format(src.NAME).mode("overwrite").save(path)
    assert spark.read.format(src.NAME).load(path).count() == 7 and not set(files) & set(glob.glob(f"{path}/*.fits"))


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = spark.range(100).select(F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("no"))).alias("id"))
    with pytest.raises(Exception, match="no"):
        bad.repartition(2).write.format(src.NAME).mode("append").save(path)
    assert not glob.glob(f"{path}/*.fits") and not any(os.scandir(path) if os.path.isdir(path) else ())
