"""Schemas of the symbol graph's tables and its closed vocabularies."""

from __future__ import annotations

SOURCES = "generation long, source_id long, root_id long, uri string, path string, rel_path string, anchor string, language string, srcset string, text string"
SYMBOLS = (
    "symbol_id long, source_id long, parent_id long, identity string, name string, kind string, shape string, visibility string, "
    "srcset string, start_line int, end_line int, depth int, navigable boolean, path string"
)
REFERENCES = (
    "reference_id long, source_symbol_id long, source_id long, target_identity string, kind string, status string, target_id long, "
    "candidate_id long, evidence string, reason string"
)
DEPS = "manifest_uri string, manifest_kind string, package_identity string, name string, import_root string, version string, dep_kind string, path string"
CHANGES = "change_id long, generation long, status string, identity string, kind string, file_path string"
NOTES = "note_id string, moniker string, kind string, status string, title string, body string, created_by string, created_at string, updated_at string"
EVENTS = "cursor long, command_id string, scope_uri string, kind string, generation long, at timestamp"

#: Six shapes and the kinds that have them; any other kind is a reference's.
SHAPES = {
    "namespace": ("module", "namespace", "package", "region", "nation", "schema"),
    "type": ("class", "interface", "struct", "enum", "trait", "type", "record", "customer", "supplier", "brand", "part", "table", "view"),
    "callable": ("function", "method", "constructor", "procedure", "order", "test"),
    "value": ("field", "const", "static", "param", "local", "property", "line", "enum_constant"),
    "annotation": ("comment", "annotation", "decorator"),
}
SHAPE_OF = {kind: shape for shape, kinds in SHAPES.items() for kind in kinds}
#: How sure a binding is, best first.
EVIDENCE_RANK = {"exact": 0, "import": 1, "scope": 2, "receiver": 3, "name_match": 4}
STATUSES = ("resolved", "candidate", "external", "dynamic", "blocked", "unresolved")
DECIDED = ("resolved", "external")
