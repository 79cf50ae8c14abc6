import struct

import numpy as np
import pandas as pd
import pytest

from starloom.sources import catalogs as cat
from starloom.sources import fits, text


def test_fits_round_trip(spark, tmp_path):
    n = 7
    pdf = pd.DataFrame({"RA": np.arange(n) * 1.5, "I16": np.arange(n).astype(np.int16), "ID": np.arange(n) * 2**40, "Flag": np.arange(n) % 2 == 0, "Name": [f"s{i}" for i in range(n)], "F": np.array([0.5, np.nan] * 3 + [1.5], np.float32), "V": list(np.arange(3 * n).reshape(n, 3).astype(np.int32))})
    (tmp_path / "t.fits").write_bytes(fits.PRIMARY + fits.encode(pdf, [fits.card("HELLO", "it's"), fits.card("N", 3), fits.card("X", 2.5)]) + fits.encode(pdf[["RA"]]))
    df = fits.read(spark, str(tmp_path / "t.fits"), nulls=True)
    rows = df.orderBy("id").collect()
    assert df.columns == ["ra", "i16", "id", "flag", "name", "f", "v"] and len(rows) == n
    assert [r.ra for r in rows] == pdf.RA.tolist() and rows[1].f is None and rows[0].f == 0.5 and rows[2].v == [6, 7, 8] and rows[3].name == "s3" and rows[0].flag
    assert fits.read(spark, str(tmp_path / "t.fits"), columns_=["name", "ra"], rows=(2, 4)).count() == 2
    assert fits.read(spark, str(tmp_path / "t.fits"), ext=2).columns == ["ra"]
    h = {(r.ext, r.key): r.value for r in fits.headers(spark, str(tmp_path / "t.fits")).collect()}
    assert h[(1, "HELLO")] == "it's" and h[(1, "N")] == "3" and h[(1, "TFIELDS")] == "7"
    assert fits.merge_wcs({"CRVAL1": "1", "OBJECT": "x", "CD1_1": "2"}, {"CRVAL1": "9", "EXTRA": "no"}) == {"OBJECT": "x", "CRVAL1": "9"}


@pytest.mark.parametrize(("layout", "size"), [(cat.NOMAD, 88), (cat.UCAC3, 84), (cat.UCAC4, 78), (cat.UCAC5, 52)])
def test_record_sizes(layout, size):
    assert np.dtype([(n, c) for n, c, *_ in layout]).itemsize == size


def test_binary_catalogues(spark, tmp_path):
    rec = struct.pack("<IIIIiiIIIIiiiiiiIIIIII", 648000000, 324000000, 10, 20, -5000, 6000, 1, 2, 2000000, 2000500, 12000, -1500, *[11000] * 4, *[7] * 5, 0b1000001 | 1 << 25)
    (tmp_path / "n.cat").write_bytes(rec * 3)
    df = cat.read(spark, str(tmp_path / "n.cat"), cat.NOMAD)
    r = df.select("*", *cat.nomad_flags(df["flags"])).first()
    assert df.count() == 3 and abs(r.ra - 180) < 1e-9 and abs(r.dec) < 1e-9 and r.pm_racosdec == -0.5 and r.mag_v == -1.5 and r.position_src == 1 and r.visual_src == 1 and r.diffraction == 1 and r.standard == 0
    u = np.zeros(20, "<u4")
    u[0], u[1], u[2], u[3], u[4], u[5], u[10] = 36000 * 1000, 32400000, 1350104990, 213004007, 321005006, 1123451234, 351004900
    (tmp_path / "u.cat").write_bytes(u.tobytes() * 2)
    r = cat.read_usnob(spark, str(tmp_path / "u.cat")).where(cat.usnob_cuts()).first()
    assert abs(r.ra - 100) < 1e-9 and abs(r.dec) < 1e-9 and abs(r.pm_ra + 0.02) < 1e-9 and abs(r.pm_dec - 0.02) < 1e-9 and r.ndetections == 2 and r.mag_0 == 12.34 and r.field_0 == 345 and r.survey_0 == 2 and r.star_galaxy_0 == 11 and abs(r.xi_0 * 3600 + 1) < 1e-9


def test_text_catalogues(spark):
    line = [" "] * 206
    for name, value in {"tyc1": "0001", "tyc2": "00008", "tyc3": "1", "mean_ra": "  2.31750494", "mean_dec": "  2.23184345", "pm_ra": "  -16.3", "nobs": " 4", "mag_bt": "12.146", "prox": "999", "ra": "2.31754222", "dec": "2.23186444", "epoch_ra": "1.67", "sigma_ra": "88.0"}.items():
        at, n, _ = cat.TYCHO2[name]
        line[at : at + n] = value.rjust(n)[:n]
    r = cat.parse_tycho2(spark.createDataFrame([("".join(line),), ("short",)], "value string")).collect()
    assert len(r) == 1 and r[0].mean_dec == 2.23184345 and abs(r[0].pm_ra + 0.0163) < 1e-12 and r[0].nobs == 4 and r[0].prox is None and r[0].epoch_ra == 1991.67 and r[0].mag_vt is None
    parts = ["\\N"] * len(cat.TWOMASS)
    for n, v in {"ra": "1.119851", "dec": "-89.91861", "designation": "00042876-8955069 ", "j_m": "12.467", "ph_qual": "AAA", "cc_flg": "000", "gal_contam": "0", "mp_flg": "0"}.items():
        parts[cat.TWOMASS.index(n)] = v
    r = cat.parse_twomass(spark.createDataFrame([("|".join(parts),)], "value string")).where(cat.twomass_cuts()).first()
    assert r.ra == 1.119851 and r.dec == -89.91861 and r.j_m == 12.467 and r.designation == "00042876-8955069 " and r.h_m is None


def test_text_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,name\n# comment\n1,2.5,a\n2,NaN,null\n3\n,4.5,b\n")
    got = text.text_table(spark, str(tmp_path / "a.csv"), "id int, x double, name string", int_null=text.INT_NULL).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2.5, "a"), (2, None, None), (text.INT_NULL, 4.5, "b")], key=str)
    whole = text.text_table(spark, str(tmp_path / "a.csv"), "id int, x double, name string")
    assert whole.count() == whole.select("x").count() == len(whole.select("id").collect()) == 3
    (tmp_path / "g.tbl").write_text("\\ comment\n|  ra    | n  | name |\n| double |int | char |\n   1.5     3    abc  \n   null    4    null \n")
    assert sorted(map(tuple, text.pipe_table(spark, str(tmp_path / "g.tbl")).collect()), key=str) == [(1.5, 3, "abc"), (None, 4, None)]
    (tmp_path / "v.xml").write_text('<VOTABLE><RESOURCE><TABLE><FIELD name="a" datatype="int"/><FIELD name="b" datatype="char" arraysize="*"/><DATA><TABLEDATA><TR><TD>1</TD><TD>x</TD></TR><TR><TD></TD><TD>y</TD></TR></TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>')
    assert [tuple(r) for r in text.votable(spark, str(tmp_path / "v.xml")).collect()] == [(1, "x"), (None, "y")]


def test_parameter_files(spark, tmp_path):
    source = 'mjd 54579 # epoch\ntypedef enum { A, B } KIND;\ntypedef struct {\n float mag[3];\n char name[20];\n int id;\n KIND k;\n} STAR;\n\nSTAR { 1.5 2.5 3.5 } "a b" 7 A\nstar { 4 5 6 } c 8 B\n'
    keys, tables = text.parse_parameters(source)
    assert keys == {"mjd": "54579"} and tables["STAR"][0] == [("mag", "array<float>"), ("name", "string"), ("id", "int"), ("k", "string")]
    (tmp_path / "p.par").write_text(source)
    assert [tuple(r) for r in text.parameters(spark, str(tmp_path / "p.par"), "star").collect()] == [([1.5, 2.5, 3.5], "a b", 7, "A"), ([4.0, 5.0, 6.0], "c", 8, "B")]
    pdf = pd.DataFrame({"id": [1, 2], "name": ["x y", "z"], "v": [0.5, 1.5]})
    whole = text.write_parameters(pdf, "obs") + text.write_parameters(pdf, "obs", append=True)
    assert len(text.parse_parameters(whole)[1]["OBS"][1]) == 4


def test_ephemerides_and_files(spark, tmp_path):
    lines = spark.createDataFrame([(" 2008-Jan-01 00:00     18 51 12.5 -22 30 36.0",), ("$$SOE",)], "value string")
    r = text.parse_ephemerides(lines).first()
    assert abs(r.ra - 15 * (18 + 51 / 60 + 12.5 / 3600)) < 1e-9 and abs(r.dec + 22.51) < 1e-9
    (tmp_path / "x.png").write_bytes(b"\x89PNG\r\n\x1a\n....")
    (tmp_path / "y.fits").write_bytes(fits.PRIMARY)
    (tmp_path / "z").write_bytes(b"??")
    assert {r.path.rsplit("/", 1)[1]: r.kind for r in text.discover(spark, str(tmp_path)).collect()} == {"x.png": "png", "y.fits": "fits", "z": None}
