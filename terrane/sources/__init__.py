"""Readers and writers of the file formats that studies use."""

from .files import artifact, chunked_csv, column_named, csv_table, edge_list, json_objects, resolve, shapefile_areas, shapefile_attributes, shapefile_vertices, vertex_table, write_csv, write_json, write_matrix, write_report

__all__ = ["artifact", "chunked_csv", "column_named", "csv_table", "edge_list", "json_objects", "resolve", "shapefile_areas", "shapefile_attributes", "shapefile_vertices", "vertex_table", "write_csv", "write_json", "write_matrix", "write_report"]
