"""Registered query plans (Spark side), their DuckDB oracles, and the study compositions."""
