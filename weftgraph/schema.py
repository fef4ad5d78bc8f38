"""Explicit table schemas. Nothing in the library relies on inference."""

FILES = (
    "project_id string, path string, size_bytes bigint, is_symlink boolean, content string"
)
IMPORT_STRUCT = "struct<specifier:string,level:int,type:string,symbols:array<string>>"
EDGES = "project_id string, source string, target string, type string, symbols array<string>"
NODES = "project_id string, node_id string, name string, language string, lines_of_code int"
MANIFEST = "archive string, seq bigint, name string, size bigint, type string"
HITS = "bucket string, client string, hit_id bigint, ts_us bigint"
SNAPSHOTS = (
    "snapshot_id string, source_type string, source_label string, created_at timestamp_ntz, "
    "is_private boolean, owner string"
)
