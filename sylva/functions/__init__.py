"""Column-level helpers (hash randomness, null-safe statistics, naming rules)."""
