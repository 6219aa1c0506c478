"""Text formats: edge lists, assignments, features, embeddings, event logs."""

from corepart.sources.eventlog import read_stage_events, stage_bytes, shuffle_bytes
from corepart.sources.text import (
    clean_edges,
    edge_lines,
    format_embeddings,
    line_index,
    parse_assignment,
    parse_edges,
    parse_embeddings,
    parse_features,
    named_manifest,
    part_manifest,
    read_assignment,
    read_core,
    read_edges,
    read_features,
    read_named_features,
    read_named_parts,
    read_parts,
    write_core,
    write_edges,
    write_named_features,
    write_named_parts,
    write_part_features,
    write_parts,
)

__all__ = [
    "clean_edges",
    "edge_lines",
    "format_embeddings",
    "line_index",
    "parse_assignment",
    "parse_edges",
    "parse_embeddings",
    "parse_features",
    "named_manifest",
    "part_manifest",
    "read_assignment",
    "read_core",
    "read_edges",
    "read_features",
    "read_named_features",
    "read_named_parts",
    "read_parts",
    "read_stage_events",
    "shuffle_bytes",
    "stage_bytes",
    "write_core",
    "write_edges",
    "write_named_features",
    "write_named_parts",
    "write_part_features",
    "write_parts",
]
