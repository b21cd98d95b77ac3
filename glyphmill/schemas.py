"""Declared schemas; nothing is inferred."""

FINDING = "code string, message string, suggestion string, severity string, file string, line int, plugin string"
CHANGE = "project string, file string, line int, start int, end int, before string, after string, reason string, change_id string, applied boolean"
CANDIDATE = "doc string, part string, paragraph_index int, start int, end int, source string, normalized string, kind string, display boolean, confidence double, repairs array<string>, candidate_id string, enabled boolean"
PARAGRAPH = "path string, part string, paragraph_index int, text string"
MEMBER = "path string, name string, size long, csize long, flags int, crc long"
ADAPTER = "name string, version string, api_version string, profile string, engine string, required_files array<string>, required_commands array<string>"
