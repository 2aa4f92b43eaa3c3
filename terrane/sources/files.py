"""CSV, edge lists, JSON and reports. Schemas are given, never guessed."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping, Sequence
from contextlib import closing
from datetime import date
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import adjacency_wide, canonical
from ..schema import assert_count


def csv_table(spark: SparkSession, path: str, schema: str, rename: Mapping[str, str] | None = None) -> DataFrame:
    """A CSV file with a header; rename comes first where names differ only by case from columns that are added later."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path).withColumnsRenamed(dict(rename or {}))


def edge_list(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Undirected edges i < j of a CSV with columns i and j among others; n is their number, if it is known."""
    head = spark.read.option("header", True).csv(path)
    edges = canonical(head.select(F.col(column_named(head, "i")).cast("long").alias("i"), F.col(column_named(head, "j")).cast("long").alias("j")))
    return edges if n is None else assert_count(edges, n, "edges")


def chunked_csv(spark: SparkSession, folder: str, schema: str, pattern: str = "mc_*_chunk*.csv") -> DataFrame:
    """All CSV files under a folder whose names match; scenario and source_file come from the name."""
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(folder)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return rows.withColumn("source_file", name).withColumn("scenario", F.regexp_extract("source_file", r"^mc_(.*)_chunk[^_]*\.csv$", 1))


def json_objects(spark: SparkSession, folder: str, pattern: str = "scenario_*.json", n: int | None = None) -> DataFrame:
    """One row a file that holds one JSON object; n is their number, if it is known."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(folder)
    return rows if n is None else assert_count(rows, n, "objects")


def _at(path: str | Path):
    """A path in the session's file systems, and its file system."""
    context = SparkSession.active().sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(str(path))
    return where, where.getFileSystem(context._jsc.hadoopConfiguration())


def _write_text(path: str | Path, text: str) -> None:
    where, fs = _at(path)
    with closing(fs.create(where, True)) as out:
        out.write(bytearray(text.encode()))


def artifact(path: str | Path, *keys: str) -> object | None:
    """A value within a small JSON file, read by the driver; None if the file or a key is missing."""
    where, fs = _at(path)
    if not fs.exists(where):
        return None
    with closing(fs.open(where)) as file:
        value = json.loads(SparkSession.active()._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
    for k in keys:
        value = value.get(k) if isinstance(value, dict) else None
    return value


#: The code of polygons in shapefiles, with and without further coordinates.
POLYGONS = (5, 15, 25)


#: Records of a shapefile or its table that one task reads at a time.
RECORDS = 4096
_VERTICES = "file string, area long, ring long, seq long, vx double, vy double"


def _rings(body: bytes) -> Iterator[np.ndarray]:
    """Points of each ring of a shapefile's record; none of what is no polygon."""
    if len(body) >= 44 and int.from_bytes(body[:4], "little") in POLYGONS:
        rings, points = np.frombuffer(body, "<i4", 2, 36)
        starts = [*np.frombuffer(body, "<i4", rings, 44).tolist(), int(points)]
        xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * rings).reshape(-1, 2)
        yield from (xy[a:b] for a, b in zip(starts, starts[1:]))


def _outlines(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(number from 0, body) of the records of a whole shapefile."""
    at, record = 100, 0
    while at + 8 <= len(raw):
        size = 2 * int.from_bytes(raw[at + 4 : at + 8], "big")
        yield record, raw[at + 8 : at + 8 + size]
        at, record = at + 8 + size, record + 1


def _vertices(name: str, area: int, body: bytes) -> Iterator[pa.RecordBatch]:
    for ring, xy in enumerate(_rings(body)):
        n = len(xy)
        yield pa.RecordBatch.from_pydict({"file": [name] * n, "area": np.full(n, area), "ring": np.full(n, ring), "seq": np.arange(n), "vx": xy[:, 0], "vy": xy[:, 1]})


def _open(uri: str):
    """A file for reading at any place, in a task."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _sizes(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length) of files under a path, and stem and name of each; nothing of them is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"), F.element_at(F.split("path", "/"), -1).alias("name"))


def _ranges(files: DataFrame, n: Column) -> DataFrame:
    """files with first and count, for each RECORDS of their n records; dealt out."""
    some = files.withColumn("n", n.cast("long")).where("n > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RECORDS).cast("long"))))
    return some.withColumn("count", F.least(F.lit(RECORDS).cast("long"), F.col("n") - F.col("first"))).repartition("path", "first")


def shapefile_vertices(spark: SparkSession, path: str, pattern: str = "*.shp") -> DataFrame:
    """(file, area, ring, seq, vx, vy) of the polygons of shapefiles under a path; area is the number of a record from 0.

    Where an index (.shx) lies beside a file, ranges of its records are read by tasks, a record at a time, so that a file may have any
    size; a file without one is read whole by one task."""
    shapes = _sizes(spark, path, pattern)
    index = _sizes(spark, path, "*.shx").select("stem", F.col("path").alias("index"), F.col("length").alias("index_length"))

    def by_range(batches):
        for batch in batches:
            for uri, index, name, first, count in zip(*(batch.column(c).to_pylist() for c in ("path", "index", "name", "first", "count"))):
                with _open(index) as places, _open(uri) as file:
                    places.seek(100 + 8 * first)
                    for k, (offset, words) in enumerate(np.frombuffer(places.read(8 * count), ">i4").reshape(-1, 2).tolist()):
                        file.seek(2 * (offset & 0xFFFFFFFF) + 8)
                        yield from _vertices(name, first + k, file.read(2 * words))

    def whole(batches):
        for batch in batches:
            for uri, name in zip(batch.column("path").to_pylist(), batch.column("name").to_pylist()):
                with _open(uri) as file:
                    for area, body in _outlines(file.read()):
                        yield from _vertices(name, area, body)

    indexed = _ranges(shapes.join(index, "stem"), (F.col("index_length") - 100) / 8)
    return indexed.mapInArrow(by_range, _VERTICES).unionByName(shapes.join(index, "stem", "left_anti").mapInArrow(whole, _VERTICES))


def _fields(head: bytes) -> list[tuple[str, str, int, int, int]]:
    """(name, kind, place in a record, width, digits after the point) of the fields that the head of a table (.dbf) describes."""
    out, at, place = [], 32, 1
    while at + 32 <= len(head) and head[at] != 13:
        out.append((head[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), chr(head[at + 11]), place, head[at + 16], head[at + 17]))
        at, place = at + 32, place + head[at + 16]
    return out


def _value(kind: str, digits: int, raw: str):
    raw = raw.strip(" \0")
    if kind in "NF":
        number = raw if raw and not raw.startswith("*") else None
        return number and (int(number) if kind == "N" and not digits and "." not in number else float(number))
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(raw.upper())
    if kind == "D":
        return date(int(raw[:4]), int(raw[4:6]), int(raw[6:8])) if raw.isdigit() and len(raw) == 8 and int(raw) else None
    return raw


def shapefile_attributes(spark: SparkSession, path: str, pattern: str = "*.dbf", encoding: str = "latin-1") -> DataFrame:
    """(file, area and the fields) of the tables beside shapefiles under a path: area is the number of a record from 0, file the name of the
    shapefile. All have the fields of the first. Ranges of records are read by tasks; the driver reads one head. Deleted records are left out, blanks are null but in texts."""
    files = _sizes(spark, path, pattern)
    one = files.select(F.min("path")).first()[0]
    if one is None:
        raise FileNotFoundError(f"no {pattern} under {path}")
    where, fs = _at(one)
    with closing(fs.open(where)) as file:
        head = bytes(SparkSession.active()._jvm.org.apache.commons.io.IOUtils.toByteArray(file, min(65535, fs.getFileStatus(where).getLen())))
    size = int.from_bytes(head[8:10], "little")
    fields, width = _fields(head[:size]), int.from_bytes(head[10:12], "little")
    kinds = {"L": "boolean", "D": "date", "F": "double"}
    kind = lambda k, digits: ("double" if digits else "long") if k == "N" else kinds.get(k, "string")
    arrow = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32(), "string": pa.string()}
    names = ["file", "area", *(f[0] for f in fields)]
    types = [pa.string(), pa.int64(), *(arrow[kind(k, n)] for _, k, _, _, n in fields)]

    def run(batches):
        for batch in batches:
            for uri, name, first, count in zip(*(batch.column(c).to_pylist() for c in ("path", "name", "first", "count"))):
                with _open(uri) as file:
                    if [f[:4] for f in _fields(file.read(size))] != [f[:4] for f in fields]:
                        raise ValueError(f"{name} has other fields")
                    file.seek(size + width * first)
                    raw = file.read(width * count)
                rows = [(k, raw[k * width : (k + 1) * width]) for k in range(len(raw) // width)]
                rows = [(k, r) for k, r in rows if r[:1] != b"*"]
                shape = name.rpartition(".")[0] + ".shp"
                columns = [[shape] * len(rows), [first + k for k, _ in rows], *([_value(t, n, r[at : at + w].decode(encoding)) for _, r in rows] for _, t, at, w, n in fields)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, ("string", "long", *(kind(k, n) for _, k, _, _, n in fields))))
    return _ranges(files, F.floor((F.col("length") - size) / width)).mapInArrow(run, schema)


def shapefile_areas(spark: SparkSession, path: str) -> DataFrame:
    """The vertices of shapefiles under a path with the fields of their areas (AreaKey, Name ..) beside them; areas without a row in a table have nulls."""
    return shapefile_vertices(spark, path).join(shapefile_attributes(spark, path), ["file", "area"], "left")


def vertex_table(df: DataFrame, area: str, rings: str) -> DataFrame:
    """(area, seq, vx, vy) of polygons held as arrays of points with fields x and y."""
    flat = df.select(F.col(area).alias("area"), F.posexplode(rings).alias("seq", "v"))
    return flat.select("area", "seq", F.col("v.x").alias("vx"), F.col("v.y").alias("vy"))


def column_named(df: DataFrame, name: str) -> str:
    """The column of that name, whatever its case."""
    found = [c for c in df.columns if c.lower() == name.lower()]
    if len(found) != 1:
        raise KeyError(f"{len(found)} columns are named {name}")
    return found[0]


def resolve(*candidates: str | Path) -> str | Path:
    """The first of the paths that exists in the session's file systems."""
    for p in candidates:
        where, fs = _at(p)
        if fs.exists(where):
            return p
    raise FileNotFoundError(", ".join(map(str, candidates)))


def write_csv(df: DataFrame, path: str, files: int | None = None) -> None:
    """CSV with a header; NaN becomes empty. files: how many, for small tables."""
    clean = df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))
    (clean if files is None else clean.coalesce(files)).write.mode("overwrite").option("header", True).csv(path)


def write_matrix(edges: DataFrame, keys: Sequence[int], path: str) -> None:
    write_csv(adjacency_wide(edges, keys).orderBy("i"), path, 1)


def _plain(value: object) -> object:
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, Mapping):
        return {str(k): _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def write_json(summary: Mapping | DataFrame, path: str | Path) -> None:
    """A nested summary, or the one row of a DataFrame, as JSON; numbers that aren't finite become null."""
    if isinstance(summary, DataFrame):
        (row,) = summary.limit(2).collect()
        summary = row.asDict(recursive=True)
    _write_text(path, json.dumps(_plain(summary), indent=2) + "\n")


def write_report(df: DataFrame, path: str | Path, title: str, most: int = 1000) -> None:
    """A small table as Markdown. One of more than `most` rows is refused: write it as CSV."""
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    _write_text(path, "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)]) + "\n")
