"""Scans (CSV / Parquet), fixtures derived from the given tables, result sinks."""
