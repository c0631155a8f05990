"""Operators of a training-data pipeline, each a Spark job over whole tables.

Nothing else in the library imports this subpackage; ``queries.py`` registers the
``opN_<name>`` queries and ``oracle.py`` the SQL of those that SQL can express.
"""
