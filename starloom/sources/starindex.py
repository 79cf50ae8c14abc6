"""A saved star index: files clustered along the sky, a manifest of their bounding boxes, and a reader that drops files.

Stars are sorted along a hierarchical cell curve and cut into files of nearly equal size, so that a file covers a small
patch of the sky. The manifest has one row a file: its path, its number of stars and the least and greatest unit-vector
coordinates in it, that is, the node of a search tree whose leaves are files. A search computes the bounds of the
distance to every node from the manifest alone, opens only the files that can hold an answer, pushes the box of the
search down to the scan of those, and ends with the exact distance. Further columns of the stars are stored along and
read only if asked for.

Several indexes are merged by their manifests; no star is moved. The manifest is written last, so files of a save that
did not end are never seen. ``star`` numbers the stars along the curve from 0, which is the order of quads' star lists;
``permutation`` leads back to the ids.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions import healpix as hp
from starloom.functions.sphere import distsq_between, radec_to_xyz
from starloom.operators.spatial import box_point_distsq
from starloom.operators.tables import row_index

AXES = ("x", "y", "z")
#: rounding of coordinates and distances, in units of the sphere's radius
SLACK = 1e-12

Cone = tuple[float, float, float]


def chord(degrees: float) -> float:
    """Straight distance on the unit sphere for an angle; that of the antipode beyond 180 degrees."""
    return 2.0 * math.sin(math.radians(min(degrees, 180.0)) / 2.0)


def unit(ra: float, dec: float) -> list[float]:
    a, d = math.radians(ra), math.radians(dec)
    return [math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)]


def save(stars: DataFrame, path: str, rows_per_file: int = 1_000_000, nside: int = 1024) -> StarIndex:
    """Write ``stars`` (id, ra, dec and any further columns) as an index; null positions are left out."""
    clash = [c for c in stars.columns if c.lower() in (*AXES, "star", "part", "curve")]
    if clash:
        raise ValueError(f"an index makes these columns itself: {clash}")
    x, y, z = radec_to_xyz("ra", "dec")
    curve = hp.xy_to_nested(hp.radec_to_cell("ra", "dec", nside), nside)
    placed = stars.where("ra IS NOT NULL AND dec IS NOT NULL").withColumns({"x": x, "y": y, "z": z, "curve": curve})
    numbered = row_index(placed, ["curve", "id"], "star").drop("curve")
    files = max(1, -(-numbered.count() // rows_per_file))
    numbered.repartitionByRange(files, "star").sortWithinPartitions("star").write.parquet(f"{path}/stars")
    spark = stars.sparkSession
    written = spark.read.parquet(f"{path}/stars").select(*AXES, "star", F.col("_metadata.file_path").alias("file"))
    bounds = [f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]
    nodes = written.groupBy("file").agg(F.count("*").alias("n"), F.min("star").alias("first_star"), *bounds)
    if not numbered.take(1):  # one file without stars stands for the columns; it has no box, so no search opens it
        none = spark.createDataFrame([(written.inputFiles()[0],)], "file string")
        nodes = none.select("file", *[F.lit(0 if f.name == "n" else None).cast(f.dataType).alias(f.name) for f in nodes.schema.fields[1:]])
    nodes.withColumn("part", F.lit(0)).coalesce(1).write.parquet(f"{path}/manifest")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> StarIndex:
    return StarIndex(spark, path, spark.read.parquet(f"{path}/manifest"))


def merge(spark: SparkSession, paths: Sequence[str], out: str) -> StarIndex:
    """One index of several, by their manifests; ``part`` tells where a star came from, numbered through all the inputs."""
    parts, base = [], 0
    for p in paths:
        m = open_index(spark, p).manifest
        parts.append(m.withColumn("part", F.col("part") + base))
        base += (m.agg(F.max("part")).first()[0] or 0) + 1
    reduce(DataFrame.unionByName, parts).coalesce(1).write.parquet(f"{out}/manifest")
    return open_index(spark, out)


class StarIndex:
    """An opened index; only its manifest, a row a file, has been looked at."""

    def __init__(self, spark: SparkSession, path: str, manifest: DataFrame):
        self.spark, self.path, self.manifest = spark, path, manifest

    @property
    def n(self) -> int:
        """Number of stars, by the manifest."""
        return self.manifest.agg(F.sum("n")).first()[0] or 0

    def box(self) -> dict[str, tuple[float, float]]:
        """Bounding box of all stars, by the manifest."""
        r = self.manifest.agg(*[f(f"{n}_{a}").alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))]).first()
        return {a: (r[f"min_{a}"], r[f"max_{a}"]) for a in AXES}

    def nodes(self, ra: float, dec: float) -> DataFrame:
        """The manifest with the least and the greatest distance (chord) of each file's box from a position."""
        low, high = box_point_distsq(list(AXES), unit(ra, dec))
        return self.manifest.select("*", F.sqrt(low).alias("nearest"), F.sqrt(high).alias("farthest"))

    def read(self, nodes: DataFrame | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """Stars of the files of ``nodes`` (all without it), with ``part``; ``columns`` are read along with id, ra and dec."""
        rows = (self.manifest if nodes is None else nodes).select("part", "file").collect()
        keep = None if columns is None else list(dict.fromkeys(["id", "star", "ra", "dec", *AXES, *columns]))
        frames = []
        for part in sorted({r["part"] for r in rows}):
            own = self.spark.read.parquet(*[r["file"] for r in rows if r["part"] == part])
            frames.append((own if keep is None else own.select(*keep)).withColumn("part", F.lit(part)))
        if not frames:
            none = self.spark.read.parquet(self.manifest.select("file").first()["file"]).where(F.lit(False))
            return (none if keep is None else none.select(*keep)).withColumn("part", F.lit(0))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def cones(self, cones: Sequence[Cone], columns: Sequence[str] = ()) -> DataFrame:
        """Stars in any of a few cones (ra, dec, radius in degrees), each once: id, star, part, ra, dec and ``columns``.

        Files are dropped by their boxes before the scan, row groups by the boxes of the cones in it.
        """
        near, boxed, inside = F.lit(False), F.lit(False), F.lit(False)
        for ra, dec, radius in cones:
            r, p = chord(radius), unit(ra, dec)
            low, _ = box_point_distsq(list(AXES), p)
            near = near | (low <= r * r + SLACK)
            box = F.lit(True)
            for a, v in zip(AXES, p, strict=True):
                box = box & (F.col(a) >= v - r - SLACK) & (F.col(a) <= v + r + SLACK)
            boxed = boxed | box
            inside = inside | (distsq_between("ra", "dec", F.lit(float(ra)), F.lit(float(dec))) <= r * r)
        found = self.read(self.manifest.where(near), columns).where(boxed).where(inside)
        return found.select("id", "star", "part", "ra", "dec", *columns)

    def cone(self, ra: float, dec: float, radius: float, columns: Sequence[str] = ()) -> DataFrame:
        """Stars of one cone with ``sep``, their distance from its axis in degrees."""
        d2 = distsq_between("ra", "dec", F.lit(float(ra)), F.lit(float(dec)))
        sep = F.degrees(2.0 * F.asin(F.least(F.sqrt(d2) / 2.0, F.lit(1.0))))
        return self.cones([(ra, dec, radius)], columns).withColumn("sep", sep)

    def nearest(self, ra: float, dec: float, k: int = 1, columns: Sequence[str] = (), within: float = 180.0) -> DataFrame:
        """The ``k`` nearest stars within a radius, nearest first, ties by id.

        Files taken in the order of their greatest distance hold k stars at some point; no file whose least distance
        is beyond that can hold an answer. The window runs over the manifest.
        """
        from pyspark.sql import Window

        upto = Window.orderBy("farthest", "file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        enough = self.nodes(ra, dec).withColumn("held", F.sum("n").over(upto)).where(F.col("held") >= k).agg(F.min("farthest")).first()[0]
        reach = min(chord(within), enough + SLACK if enough is not None else 2.0)
        degrees = math.degrees(2.0 * math.asin(min(reach / 2.0, 1.0)))
        found = self.cone(ra, dec, min(degrees * (1 + 1e-9) + 1e-9, 180.0), columns).where(F.col("sep") <= within)
        return found.orderBy("sep", "id").limit(k)

    def permutation(self) -> DataFrame:
        """(part, star, id): the ids along the curve."""
        return self.read(columns=()).select("part", "star", "id")
