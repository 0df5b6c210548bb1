"""quadloom: annotated tables and RDF quads as Spark DataFrames."""

import importlib

_PUBLIC = {
    "quadloom.api": ["ConversionOptions", "infer_descriptor", "load_group", "table_header", "to_quads", "to_tables", "validate"],
    "quadloom.issues": ["Issues", "ValidationError"],
    "quadloom.operators.r2c": ["extraction_issues", "table_rows"],
    "quadloom.operators.serialize": ["format_of", "prefix_candidates", "write"],
    "quadloom.plans.descriptor": ["Loader", "Table", "TableGroup"],
    "quadloom.sources.rdf": ["as_set", "parse_nquads", "read_rdf"],
    "quadloom.sources.tables": ["read_csv", "scan_csv", "write_csv"],
    "quadloom.streaming.extract": ["convert_windows", "row_stream", "window_changes", "window_rows"],
    "quadloom.streaming.schema": ["schema_stream"],
}
_PLACES = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    """Public names are imported when they are asked for: executors import little."""
    if name in _PLACES:
        return getattr(importlib.import_module(_PLACES[name]), name)
    raise AttributeError(f"module 'quadloom' has no attribute {name!r}")
