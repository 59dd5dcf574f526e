"""JSON and JSONL sources with exact positions, and their sinks."""
