"""Star-catalogue records: packed binary formats as field tables, and column-aligned text as expressions.

A binary format is a list of (name, code, scale, offset): the stored number times the scale plus the offset. Decoding
is one numpy view a file, so records are never looped over.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAS, DMAS = 0.001 / 3600, 0.0001 / 3600

# --- fixed values: record layouts of the published catalogues, in the order of the bytes --------------------------

NOMAD = [
    ("ra", "<u4", MAS, 0), ("dec", "<u4", MAS, -90), ("sigma_racosdec", "<u4", MAS, 0), ("sigma_dec", "<u4", MAS, 0), ("pm_racosdec", "<i4", 1e-4, 0), ("pm_dec", "<i4", 1e-4, 0),
    ("sigma_pm_racosdec", "<u4", 1e-4, 0), ("sigma_pm_dec", "<u4", 1e-4, 0), ("epoch_ra", "<u4", 1e-3, 0), ("epoch_dec", "<u4", 1e-3, 0), ("mag_b", "<i4", 1e-3, 0), ("mag_v", "<i4", 1e-3, 0),
    ("mag_r", "<i4", 1e-3, 0), ("mag_j", "<i4", 1e-3, 0), ("mag_h", "<i4", 1e-3, 0), ("mag_k", "<i4", 1e-3, 0), ("usnob_id", "<u4", 1, 0), ("twomass_id", "<u4", 1, 0), ("yb6_id", "<u4", 1, 0),
    ("ucac2_id", "<u4", 1, 0), ("tycho2_id", "<u4", 1, 0), ("flags", "<u4", 1, 0),
]
NOMAD_FLAGS = {
    "position_src": (0, 3), "blue_src": (3, 3), "visual_src": (6, 3), "red_src": (9, 3), "usnob_fail": (12, 1), "twomass_fail": (13, 1), "tycho_position": (16, 1), "alt_radec": (17, 1), "alt_ucac": (19, 1),
    "alt_tycho": (20, 1), "blue_o": (21, 1), "red_e": (22, 1), "twomass_only": (23, 1), "hipp_position": (24, 1), "diffraction": (25, 1), "confusion": (26, 1), "bright_confusion": (27, 1), "bright_artifact": (28, 1), "standard": (29, 1),
}
UCAC3 = [
    ("ra", "<u4", MAS, 0), ("dec", "<u4", MAS, -90), ("mag", "<i2", 1e-3, 0), ("apmag", "<i2", 1e-3, 0), ("mag_err", "<i2", 1e-3, 0), ("objtype", "i1", 1, 0), ("doublestar", "i1", 1, 0), ("sigma_ra", "<u2", MAS, 0), ("sigma_dec", "<u2", MAS, 0),
    ("navail", "i1", 1, 0), ("nused", "i1", 1, 0), ("npm", "i1", 1, 0), ("nmatch", "i1", 1, 0), ("epoch_ra", "<u2", 0.01, 1900), ("epoch_dec", "<u2", 0.01, 1900), ("pm_ra", "<i4", 1e-4, 0), ("pm_dec", "<i4", 1e-4, 0),
    ("sigma_pm_ra", "<u2", 1e-4, 0), ("sigma_pm_dec", "<u2", 1e-4, 0), ("twomass_id", "<u4", 1, 0), ("jmag", "<i2", 1e-3, 0), ("hmag", "<i2", 1e-3, 0), ("kmag", "<i2", 1e-3, 0), ("twomass_jflags", "u1", 1, 0), ("twomass_hflags", "u1", 1, 0),
    ("twomass_kflags", "u1", 1, 0), ("jmag_err", "u1", 0.01, 0), ("hmag_err", "u1", 0.01, 0), ("kmag_err", "u1", 0.01, 0), ("bmag", "<i2", 1e-3, 0), ("r2mag", "<i2", 1e-3, 0), ("imag", "<i2", 1e-3, 0), ("clbl", "u1", 1, 0),
    ("bquality", "u1", 1, 0), ("r2quality", "u1", 1, 0), ("iquality", "u1", 1, 0), ("matchflags", "V10", 1, 0), ("yale_gflag", "u1", 1, 0), ("yale_cflag", "u1", 1, 0), ("leda_flag", "u1", 1, 0), ("twomass_extsource_flag", "u1", 1, 0), ("mpos", "<u4", 1, 0),
]
UCAC4 = [
    ("ra", "<u4", MAS, 0), ("dec", "<u4", MAS, -90), ("mag", "<i2", 1e-3, 0), ("apmag", "<i2", 1e-3, 0), ("mag_err", "u1", 0.01, 0), ("objtype", "u1", 1, 0), ("doublestar", "u1", 1, 0), ("sigma_ra", "i1", MAS, 128 * MAS), ("sigma_dec", "i1", MAS, 128 * MAS),
    ("navail", "u1", 1, 0), ("nused", "u1", 1, 0), ("nmatch", "u1", 1, 0), ("epoch_ra", "<u2", 0.01, 1900), ("epoch_dec", "<u2", 0.01, 1900), ("pm_rac", "<i2", 1e-4, 0), ("pm_dec", "<i2", 1e-4, 0), ("sigma_pm_ra", "u1", 1e-4, 128e-4),
    ("sigma_pm_dec", "u1", 1e-4, 128e-4), ("twomass_id", "<u4", 1, 0), ("jmag", "<i2", 1e-3, 0), ("hmag", "<i2", 1e-3, 0), ("kmag", "<i2", 1e-3, 0), ("twomass_jflags", "u1", 1, 0), ("twomass_hflags", "u1", 1, 0), ("twomass_kflags", "u1", 1, 0),
    ("jmag_err", "u1", 0.01, 0), ("hmag_err", "u1", 0.01, 0), ("kmag_err", "u1", 0.01, 0), ("bmag", "<i2", 1e-3, 0), ("vmag", "<i2", 1e-3, 0), ("gmag", "<i2", 1e-3, 0), ("rmag", "<i2", 1e-3, 0), ("imag", "<i2", 1e-3, 0), ("bmag_err", "u1", 0.01, 0),
    ("vmag_err", "u1", 0.01, 0), ("gmag_err", "u1", 0.01, 0), ("rmag_err", "u1", 0.01, 0), ("imag_err", "u1", 0.01, 0), ("yale_gc_flag", "u1", 1, 0), ("catalog_flags", "<i4", 1, 0), ("leda_flag", "u1", 1, 0), ("twomass_extsource_flag", "u1", 1, 0),
    ("mpos", "<u4", 1, 0), ("ucac2_zone", "<u2", 1, 0), ("ucac2_number", "<u4", 1, 0),
]
UCAC5 = [
    ("srcid", "<i8", 1, 0), ("rag", "<u4", MAS, 0), ("dcg", "<i4", MAS, 0), ("erg", "<u2", DMAS, 0), ("edg", "<u2", DMAS, 0), ("flg", "u1", 1, 0), ("nu", "u1", 1, 0), ("epu", "<i2", 1e-3, 1997), ("ira", "<u4", MAS, 0), ("idc", "<i4", MAS, 0),
    ("pmur", "<i2", DMAS, 0), ("pmud", "<i2", DMAS, 0), ("pmer", "<u2", DMAS, 0), ("pmed", "<u2", DMAS, 0), ("gmag", "<i2", 1e-3, 0), ("umag", "<i2", 1e-3, 0), ("rmag", "<i2", 1e-3, 0), ("jmag", "<i2", 1e-3, 0), ("hmag", "<i2", 1e-3, 0), ("kmag", "<i2", 1e-3, 0),
]
#: Tycho-2 main records: name -> (first character from 0, length, scale)
TYCHO2 = {
    "tyc1": (0, 4, None), "tyc2": (5, 5, None), "tyc3": (11, 1, None), "mean_ra": (15, 12, 1), "mean_dec": (28, 12, 1), "pm_ra": (41, 7, 1e-3), "pm_dec": (49, 7, 1e-3), "sigma_mean_ra": (57, 3, MAS), "sigma_mean_dec": (61, 3, MAS),
    "sigma_pm_ra": (65, 4, 1e-3), "sigma_pm_dec": (70, 4, 1e-3), "epoch_mean_ra": (75, 7, 1), "epoch_mean_dec": (83, 7, 1), "nobs": (91, 2, None), "goodness_mean_ra": (94, 3, 1), "goodness_mean_dec": (98, 3, 1), "goodness_pm_ra": (102, 3, 1),
    "goodness_pm_dec": (106, 3, 1), "mag_bt": (110, 6, 1), "sigma_bt": (117, 5, 1), "mag_vt": (123, 6, 1), "sigma_vt": (130, 5, 1), "prox": (136, 3, None), "hipparcos_id": (142, 6, None), "ra": (152, 12, 1), "dec": (165, 12, 1),
    "epoch_ra": (178, 4, 1), "epoch_dec": (183, 4, 1), "sigma_ra": (188, 5, MAS), "sigma_dec": (194, 5, MAS), "correlation": (202, 4, 1),
}
TWOMASS = (
    "ra dec err_maj err_min err_ang designation j_m j_cmsig j_msigcom j_snr h_m h_cmsig h_msigcom h_snr k_m k_cmsig k_msigcom k_snr ph_qual rd_flg bl_flg cc_flg ndet prox pxpa pxcntr gal_contam mp_flg pts_key hemis date scan glon glat x_scan jdate "
    "j_psfchi h_psfchi k_psfchi j_m_stdap j_msig_stdap h_m_stdap h_msig_stdap k_m_stdap k_msig_stdap dist_edge_ns dist_edge_ew dist_edge_flg dup_src use_src a dist_opt phi_opt b_m_opt vr_m_opt nopt_mchs ext_key scan_key coadd_key coadd"
).split()
TWOMASS_TEXT = frozenset("designation ph_qual rd_flg bl_flg cc_flg ndet hemis date dist_edge_flg a".split())
#: surveys of USNO-B observations: number -> (band, epoch); None: the epoch follows the slot
USNOB_SURVEYS = {0: ("O", 1), 1: ("E", 1), 2: ("J", 2), 3: ("F", 2), 4: ("J", 2), 5: ("F", None), 6: ("F", 2), 7: ("N", 2), 8: ("N", 2), 9: ("N", 2)}


def decode(data: bytes, layout: list[tuple[str, str, float, float]]) -> pd.DataFrame:
    table = np.frombuffer(data, np.dtype([(name, code) for name, code, _, _ in layout]))
    out = {}
    for name, code, scale, offset in layout:
        v = table[name]
        out[name] = [bytes(b) for b in v] if code[0] == "V" else v.astype(np.int64) if (scale, offset) == (1, 0) else v * scale + offset
    return pd.DataFrame(out)


def schema(layout: list[tuple[str, str, float, float]]) -> str:
    return ", ".join(f"{n} {'binary' if c[0] == 'V' else 'bigint' if (s, o) == (1, 0) else 'double'}" for n, c, s, o in layout)


def read(spark: SparkSession, path: str, layout: list[tuple[str, str, float, float]]) -> DataFrame:
    """Records of all files under ``path``."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                yield decode(bytes(content), layout)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema(layout))


def nomad_flags(flags: Column) -> list[Column]:
    return [F.shiftrightunsigned(flags, at).bitwiseAND(F.lit((1 << width) - 1).cast("long")).cast("int").alias(name) for name, (at, width) in NOMAD_FLAGS.items()]


def ucac5_at_epoch(epoch: float) -> tuple[Column, Column]:
    """Position moved to an epoch, over the pole if need be."""
    dt = F.lit(epoch) - F.col("epu")
    cos = F.cos(F.radians("idc"))
    ra = F.col("ira") + F.col("pmur") * F.when(cos != 0, dt / cos).otherwise(dt)
    dec = F.col("idc") + F.col("pmud") * dt
    over = F.abs(dec) > 90
    return F.pmod(F.when(over, ra + 180).otherwise(ra), F.lit(360.0)), F.when(dec > 90, 180 - dec).when(dec < -90, -180 - dec).otherwise(dec)


def decode_usnob(data: bytes) -> pd.DataFrame:
    """80-byte records of 20 unsigned integers that pack decimal digits."""
    u = np.frombuffer(data, "<u4").reshape(-1, 20).astype(np.int64)
    digit = lambda col, low, n: u[:, col] // 10**low % 10**n
    out = {
        "ra": u[:, 0] * 0.01 / 3600, "dec": u[:, 1] * 0.01 / 3600 - 90, "pm_ra": 0.002 * (digit(2, 0, 4) - 5000), "pm_dec": 0.002 * (digit(2, 4, 4) - 5000), "pm_prob": 0.1 * digit(2, 8, 1), "motion_catalog": digit(2, 9, 1) == 1,
        "sigma_pm_ra": 0.001 * digit(3, 0, 3), "sigma_pm_dec": 0.001 * digit(3, 3, 3), "sigma_ra_fit": 0.1 * digit(3, 6, 1) / 3600, "sigma_dec_fit": 0.1 * digit(3, 7, 1) / 3600, "ndetections": digit(3, 8, 1), "diffraction_spike": digit(3, 9, 1) == 1,
        "sigma_ra": 0.001 * digit(4, 0, 3) / 3600, "sigma_dec": 0.001 * digit(4, 3, 3) / 3600, "epoch": 1950 + 0.1 * digit(4, 6, 3), "ys4": digit(4, 9, 1) == 1,
    }
    for k in range(5):
        a, b = 5 + k, 10 + k
        empty = (out["ndetections"] >= 2) & (digit(a, 4, 3) == 0)
        out |= {f"mag_{k}": 0.01 * digit(a, 0, 4), f"field_{k}": digit(a, 4, 3), f"survey_{k}": digit(a, 7, 1), f"star_galaxy_{k}": digit(a, 8, 2), f"calibration_{k}": digit(b, 8, 1), f"pmmscan_{k}": u[:, 15 + k]}
        out |= {f"xi_{k}": np.where(empty, 0.0, 0.01 * (digit(b, 0, 4) - 5000) / 3600), f"eta_{k}": np.where(empty, 0.0, 0.01 * (digit(b, 4, 4) - 5000) / 3600)}
    return pd.DataFrame(out)


def read_usnob(spark: SparkSession, path: str) -> DataFrame:
    kinds = decode_usnob(b"\0" * 80).dtypes
    ddl = ", ".join(f"{n} {'boolean' if t.kind == 'b' else 'bigint' if t.kind == 'i' else 'double'}" for n, t in kinds.items())

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                yield decode_usnob(bytes(content))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ddl)


def usnob_band(survey: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for k, (b, _) in USNOB_SURVEYS.items() for v in (k, b)]), survey.cast("int"))


def usnob_epoch(survey: Column, slot: int) -> Column:
    known = F.element_at(F.create_map(*[F.lit(v) for k, (_, e) in USNOB_SURVEYS.items() if e for v in (k, e)]), survey.cast("int"))
    return F.when(survey == 5, F.lit({1: 1, 3: 2}.get(slot))).otherwise(known)


def usnob_cuts() -> Column:
    """Sources with two detections at least and no diffraction spike."""
    return (F.col("ndetections") >= 2) & ~F.col("diffraction_spike")


def parse_tycho2(lines: DataFrame, col: str = "value") -> DataFrame:
    """Records of column-aligned text; blank fields are null."""
    out = []
    for name, (at, n, scale) in TYCHO2.items():
        text = F.trim(F.substring(col, at + 1, n))
        number = F.when(text != "", text.cast("double" if scale else "int"))
        if name == "prox":
            number = F.when(number != 999, number * 0.1 / 3600)
        elif name in ("epoch_ra", "epoch_dec"):
            number = number + 1990.0
        elif scale:
            number = number * scale
        out.append(number.alias(name))
    flag = lambda at, c, name: (F.substring(col, at + 1, 1) == c).alias(name)
    return lines.where(F.length(col) >= 206).select(*out, flag(13, "P", "photo_center"), flag(13, "X", "no_motion"), flag(140, "T", "tycho1_star"), flag(200, "D", "double_star"), flag(200, "P", "photo_center_treatment"), F.trim(F.substring(col, 149, 3)).alias("ccdm"))


def parse_twomass(lines: DataFrame, col: str = "value") -> DataFrame:
    """Records of pipe-delimited text; the null token gives null."""
    parts = F.split(col, r"\|")
    value = lambda i: F.when(~parts[i].isin("\\N", "null", ""), parts[i])
    return lines.where(F.size(parts) >= len(TWOMASS)).select(*[(value(i) if n in TWOMASS_TEXT else value(i).cast("double")).alias(n) for i, n in enumerate(TWOMASS)])


def twomass_cuts() -> Column:
    """Best quality in every band and no contamination."""
    return F.col("ph_qual").rlike("^[ABC]{3}$") & (F.col("cc_flg") == "000") & (F.col("gal_contam") == 0) & (F.col("mp_flg") == 0)
