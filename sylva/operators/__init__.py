"""DataFrame -> DataFrame operators: profile, prepare, importance, muting,
combine, metrics and result-table analytics."""
