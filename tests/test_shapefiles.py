"""Shapefiles by ranges of records, with the table of their areas."""

import datetime
import struct

import numpy as np
import pytest

from terrane import sources
from terrane.operators import graph
from terrane.sources import files


def shape(square):
    x, y = square
    ring = [(x, y), (x, y + 1), (x + 1, y + 1), (x + 1, y), (x, y)]
    return struct.pack("<i4d2i", 5, x, y, x + 1, y + 1, 1, len(ring)) + struct.pack("<i", 0) + np.array(ring, "<f8").tobytes()


def written(folder, name, squares, rows=None, index=True):
    out, places, at = b"", b"", 100
    for k, s in enumerate(squares):
        body = shape(s) if s else struct.pack("<i", 0)
        places += struct.pack(">2i", at // 2, len(body) // 2)
        out += struct.pack(">2i", k + 1, len(body) // 2) + body
        at += 8 + len(body)
    (folder / f"{name}.shp").write_bytes(bytes(100) + out)
    if index:
        (folder / f"{name}.shx").write_bytes(bytes(100) + places)
    if rows is not None:
        fields = [("AreaKey", "N", 9, 0), ("Name", "C", 12, 0), ("Rate", "N", 8, 3), ("Seat", "L", 1, 0), ("Since", "D", 8, 0)]
        head = b"".join(n.encode().ljust(11, b"\0") + t.encode() + bytes(4) + bytes([w, d]) + bytes(14) for n, t, w, d in fields)
        body = b"".join((b"*" if gone else b" ") + b"".join(str(v).encode("latin-1").rjust(w) if t == "N" else str(v).encode("latin-1").ljust(w) for v, (_, t, w, _) in zip(row, fields)) for gone, *row in rows)
        (folder / f"{name}.dbf").write_bytes(struct.pack("<4BIHH", 3, 1, 1, 1, len(rows), 33 + len(head), 1 + 38) + bytes(20) + head + b"\r" + body + b"\x1a")


def test_areas_with_their_fields(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "RECORDS", 2)
    written(tmp_path, "counties", [(0, 0), (1, 0), None, (5, 5), (6, 6)], [(0, 13001, "Appling", "0.125", "T", "18181215"), (0, 13003, "Été", "", "?", ""), (0, 13005, "Bacon", "1.5", "F", "19140727"), (1, 13007, "Baker", "2", "N", "18250101"), (0, 13009, "", "-3.25", "y", "00000000")])
    vertices = sources.shapefile_vertices(spark, str(tmp_path))
    assert {(r.area, r.n) for r in vertices.groupBy("area").count().withColumnRenamed("count", "n").collect()} == {(0, 5), (1, 5), (3, 5), (4, 5)}
    assert {tuple(r) for r in graph.contiguity_edges(vertices, "area").collect()} == {(0, 1), (3, 4)}
    rows = {r.area: tuple(r)[2:] for r in sources.shapefile_attributes(spark, str(tmp_path)).collect()}
    assert rows == {0: (13001, "Appling", 0.125, True, datetime.date(1818, 12, 15)), 1: (13003, "Été", None, None, None), 2: (13005, "Bacon", 1.5, False, datetime.date(1914, 7, 27)), 4: (13009, "", -3.25, True, None)}
    both = sources.shapefile_areas(spark, str(tmp_path))
    key = sources.column_named(both, "areakey")
    assert {(r.area, r[key], r.file) for r in both.select("area", key, "file").distinct().collect()} == {(0, 13001, "counties.shp"), (1, 13003, "counties.shp"), (3, None, "counties.shp"), (4, 13009, "counties.shp")}


def test_ranges_read_what_whole_files_have(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "RECORDS", 7)
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    squares = [(k % 10, k // 10) for k in range(50)]
    written(a, "grid", squares)
    written(b, "grid", squares, index=False)
    table = lambda p: sorted(tuple(r) for r in sources.shapefile_vertices(spark, str(p)).collect())
    assert table(a) == table(b) and len(table(a)) == 250


def test_tables_that_differ_are_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sources.shapefile_attributes(spark, str(tmp_path))
    written(tmp_path, "one", [(0, 0)], [(0, 1, "x", "1", "T", "20000101")])
    data = bytearray((tmp_path / "one.dbf").read_bytes())
    data[32:35] = b"Key"
    (tmp_path / "two.dbf").write_bytes(bytes(data))
    with pytest.raises(Exception, match="other fields"):
        sources.shapefile_attributes(spark, str(tmp_path)).collect()
