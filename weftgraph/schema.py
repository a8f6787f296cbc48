"""Shape of a property graph: one wide table of nodes and one of edges.

An edge's identity is (src, type, dst, kind); ``edge_id`` is its hash, for paths that may not repeat an edge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE_FIELDS = {
    "node_id": "string", "labels": "array<string>", "kind_label": "string", "full_name": "string", "name": "string", "kind": "string", "path": "string",
    "file_path": "string", "line": "int", "end_line": "int", "language": "string", "signature": "string", "type_name": "string", "attributes": "string",
    "external_bases": "string", "is_abstract": "boolean", "is_static": "boolean", "is_classmethod": "boolean", "is_async": "boolean", "stub": "boolean",
    "library": "boolean", "route": "string", "http_method": "string", "languages": "array<string>", "last_indexed": "timestamp",
    "last_indexed_commit": "string", "summary": "string", "summary_updated_at": "timestamp",
}
EDGE_FIELDS = {"src": "string", "dst": "string", "type": "string", "kind": "string", "call_sites": "array<struct<line:int,col:int>>", "edge_id": "bigint"}

# Order in which a label stands for a node that has several, and the types of edges.
LABEL_ORDER = ("Class", "Interface", "Method", "Property", "Field", "Package", "File", "Endpoint", "Directory", "Repository")
EDGE_TYPES = ("CONTAINS", "CALLS", "INHERITS", "IMPLEMENTS", "DISPATCHES_TO", "OVERRIDES", "IMPORTS", "REFERENCES", "TESTS", "SERVES", "HTTP_CALLS")
SEARCHABLE_KINDS = ("Class", "Interface", "Method", "Property", "Field", "Namespace", "File", "Directory", "Repository")
REFERENCE_KINDS = ("parameter", "return_type", "property_type", "field_type")

NODE_DDL = ", ".join(f"{k} {v}" for k, v in NODE_FIELDS.items())
EDGE_DDL = ", ".join(f"{k} {v}" for k, v in EDGE_FIELDS.items())


def node_columns(**given: Column) -> list[Column]:
    """All node columns in order; those not given are null. labels and node_id follow from kind_label and the key."""
    return [given.get(k, F.lit(None)).cast(t).alias(k) for k, t in NODE_FIELDS.items()]


def edge_columns(src: Column, dst: Column, type_: str, kind: Column | None = None, call_sites: Column | None = None) -> list[Column]:
    kind = F.lit(None).cast("string") if kind is None else kind
    sites = F.lit(None) if call_sites is None else call_sites
    edge_id = F.xxhash64(src, F.lit(type_), dst, F.coalesce(kind, F.lit("")))
    return [src.alias("src"), dst.alias("dst"), F.lit(type_).alias("type"), kind.alias("kind"), sites.cast(EDGE_FIELDS["call_sites"]).alias("call_sites"), edge_id.alias("edge_id")]


def node_id(label: str, key: Column) -> Column:
    return F.concat(F.lit(f"{label}:"), key)
