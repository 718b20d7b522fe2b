"""Schemas of the fingerprint tables.  `side` is L or R, `ord` the canonical order within a side."""

FILES = "side string, ord long, path string, module string, category string, size long, sha256 string, semantic_hash string, features array<string>, origin string, source_path string"
METHODS = "side string, ord long, identifier string, module string, dex_path string, class_name string, method_name string, descriptor string, instruction_count long, canonical_hash string, opcode_tokens array<string>, api_calls array<string>, constants array<string>, block_signature array<string>, third_party boolean, origin string, source_path string"
IMAGES = "side string, ord long, path string, module string, size long, sha256 string, perceptual_hash string, width int, height int, origin string, source_path string"
MANIFEST_ENTRIES = "side string, value string, origin string, source_path string"
VALUES = "side string, value string"
DIMENSIONS = "key string, score double, left_coverage double, right_coverage double, confidence double, warnings array<string>"
FINDINGS = "dimension string, rank int, similarity double, left string, right string, details string"
ENTRIES = "archive string, path string, size long, compressed_size long, crc long, mode int, position int"
OWNERS = "identifier string, category string, origin string, source_path string, module string"
EDGES = "l long, r long, tier int, pref long, sim double"
