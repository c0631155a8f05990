"""Analysis frames derived from the given tables (FIXTURES.md part B).

Each fixture exists twice: as a Spark builder and as a DuckDB CTE body, so an
operator can be checked against an oracle on exactly the same rows.  Keys are
stable hashes of row content, never positions, so every derived random choice
is independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.frame import Frame
from sylva.functions.hashing import hash_key
from sylva.sources.tables import load

LINE_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
# Fixed values of the error-table fixture: the p grid of the reference's simulations.
P_GRID = (200, 500, 1000)


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


def line_base(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    rid = hash_key("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", _cents("l_quantity"),
                   _cents("l_extendedprice"), _cents("l_discount"), _cents("l_tax"), "l_returnflag",
                   "l_linestatus", F.col("l_shipdate").cast("date"))
    return li.withColumn("row_id", rid)


def line_reg(spark, sf) -> Frame:
    df = line_base(spark, sf).select(
        "row_id", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return Frame(df, LINE_FEATURES, "revenue", ("row_id",), "regression")


def line_bin(spark, sf) -> Frame:
    df = line_base(spark, sf).select(
        "row_id", *LINE_FEATURES,
        ((F.col("l_extendedprice") * (1 - F.col("l_discount"))) > 50000).cast("int").alias("big"))
    return Frame(df, LINE_FEATURES, "big", ("row_id",), "classification")


def line_multi(spark, sf) -> Frame:
    df = line_base(spark, sf).select("row_id", *LINE_FEATURES, "l_linestatus", "l_returnflag")
    return Frame(df, LINE_FEATURES + ("l_linestatus",), "l_returnflag", ("row_id",), "classification")


def order_cat(spark, sf) -> Frame:
    df = load(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("row_id"), "o_totalprice", "o_orderpriority", "o_orderstatus")
    return Frame(df, ("o_totalprice", "o_orderpriority"), "o_orderstatus", ("row_id",), "classification")


def line_null(spark, sf) -> Frame:
    fr = line_reg(spark, sf)
    df = fr.df.withColumn("l_discount", F.expr("nullif(l_discount, 0.0)"))
    return fr.with_df(df)


def order_null(spark, sf) -> Frame:
    fr = order_cat(spark, sf)
    df = fr.df.withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '1-URGENT')"))
    return fr.with_df(df)


def line_dup(spark, sf) -> DataFrame:
    return load(spark, sf, "lineitem").select("l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")


def emb_names(dim: int) -> tuple[str, ...]:
    return tuple(f"e{i:02d}" for i in range(dim))


def emb_wide(spark, sf) -> Frame:
    """A column per entry of ``embedding``, as many as the longest has."""
    e = load(spark, sf, "embeddings")
    dim = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    df = e.select(F.col("vec_id").cast("string").alias("row_id"),
                  *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(emb_names(dim))],
                  F.col("label").cast("string").alias("label"))
    return Frame(df, emb_names(dim), "label", ("row_id",), "classification")


def emb_long(spark, sf) -> DataFrame:
    """Long form (row_id, feature, value, label) straight from the array column."""
    e = load(spark, sf, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("row_id"),
                    F.posexplode("embedding").alias("pos", "v"),
                    F.col("label").cast("string").alias("label")).select(
        "row_id", F.format_string("e%02d", F.col("pos")).alias("feature"),
        F.col("v").cast("double").alias("value"), "label")


def event_errors(spark, sf) -> DataFrame:
    """B-9: (scenario, p, model, rep, error) from ``events``; a third of models are RLT variants."""
    ev = load(spark, sf, "events")
    p = F.element_at(F.array(*[F.lit(x) for x in P_GRID]), (F.col("event_id") % 3 + 1).cast("int"))
    model = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("RLT-"), F.col("event_type"))).otherwise(
        F.col("event_type"))
    return ev.select(
        F.concat(F.lit("S"), (F.col("user_id") % 4 + 1).cast("string")).alias("scenario"),
        p.cast("int").alias("p"), model.alias("model"),
        (F.col("event_id") % 10).cast("int").alias("rep"), F.col("value").alias("error"))


def doc_quality(spark, sf) -> Frame:
    d = load(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = load(spark, sf, "labels").select("doc_id", "quality")
    df = d.join(lab, "doc_id").select(F.col("doc_id").cast("string").alias("row_id"),
                                      "n_chars", "lang", "source", "quality")
    return Frame(df, ("n_chars", "lang", "source"), "quality", ("row_id",), "classification")


def const_col(spark, sf) -> Frame:
    fr = line_reg(spark, sf)
    df = fr.df.select("row_id", *fr.feature_cols, F.lit(1.0).alias("const_one"), "revenue")
    return Frame(df, fr.feature_cols + ("const_one",), "revenue", ("row_id",), "regression")


def pred_pairs(spark, sf, seed: int = 42) -> DataFrame:
    """B-12: label = encoded l_returnflag, prediction = md5(row_id|seed) mod 3, plus class scores."""
    df = line_base(spark, sf).select("row_id", "l_returnflag")
    lab = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    h = F.conv(F.substring(hash_key("row_id", F.lit(seed)), 1, 8), 16, 10).cast("bigint")
    return df.select("row_id", lab.cast("double").alias("label"), (h % 3).cast("double").alias("prediction"))


# ---------------------------------------------------------------- SQL twins
def _sql_cents(c: str) -> str:
    return f"CAST(CAST(round({c} * 100) AS BIGINT) AS VARCHAR)"


SQL_ROW_ID = ("md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), "
              "CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
              f"{_sql_cents('l_quantity')}, {_sql_cents('l_extendedprice')}, {_sql_cents('l_discount')}, "
              f"{_sql_cents('l_tax')}, l_returnflag, l_linestatus, CAST(CAST(l_shipdate AS DATE) AS VARCHAR)))")

SQL = {
    "line_base": f"SELECT *, {SQL_ROW_ID} AS row_id FROM lineitem",
    "line_reg": (f"SELECT {SQL_ROW_ID} AS row_id, l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, "
                 "l_extendedprice * (1 - l_discount) AS revenue FROM lineitem"),
    "line_bin": (f"SELECT {SQL_ROW_ID} AS row_id, l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, "
                 "CAST(l_extendedprice * (1 - l_discount) > 50000 AS INTEGER) AS big FROM lineitem"),
    "line_multi": (f"SELECT {SQL_ROW_ID} AS row_id, l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, "
                   "l_linestatus, l_returnflag FROM lineitem"),
    "order_cat": ("SELECT CAST(o_orderkey AS VARCHAR) AS row_id, o_totalprice, o_orderpriority, o_orderstatus "
                  "FROM orders"),
    "line_null": (f"SELECT {SQL_ROW_ID} AS row_id, l_quantity, l_extendedprice, nullif(l_discount, 0.0) AS l_discount, "
                  "l_tax, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem"),
    "order_null": ("SELECT CAST(o_orderkey AS VARCHAR) AS row_id, o_totalprice, "
                   "nullif(o_orderpriority, '1-URGENT') AS o_orderpriority, o_orderstatus FROM orders"),
    "line_dup": "SELECT l_linenumber, l_returnflag, l_linestatus, l_quantity FROM lineitem",
    "emb_long": ("SELECT CAST(vec_id AS VARCHAR) AS row_id, printf('e%02d', CAST(g.i - 1 AS INTEGER)) AS feature, "
                 "CAST(embedding[g.i] AS DOUBLE) AS value, CAST(label AS VARCHAR) AS label "
                 "FROM embeddings, range(1, len(embedding) + 1) AS g(i)"),
    "event_errors": ("SELECT 'S' || CAST(user_id % 4 + 1 AS VARCHAR) AS scenario, "
                     "CAST(CASE event_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 500 ELSE 1000 END AS INTEGER) AS p, "
                     "CASE WHEN user_id % 3 = 0 THEN 'RLT-' || event_type ELSE event_type END AS model, "
                     "CAST(event_id % 10 AS INTEGER) AS rep, value AS error FROM events"),
    "pred_pairs": (f"SELECT row_id, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS DOUBLE) AS label, "
                   "CAST(CAST(('0x' || substr(md5(row_id || '|42'), 1, 8)) AS BIGINT) % 3 AS DOUBLE) AS prediction "
                   f"FROM (SELECT {SQL_ROW_ID} AS row_id, l_returnflag FROM lineitem)"),
}
SQL["const_col"] = ("SELECT row_id, l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, "
                    "1.0 AS const_one, revenue FROM (" + SQL["line_reg"] + ")")
SQL["doc_quality"] = ("SELECT CAST(d.doc_id AS VARCHAR) AS row_id, d.n_chars, d.lang, d.source, l.quality "
                      "FROM documents d JOIN labels l ON d.doc_id = l.doc_id")


def with_fixtures(body: str, *names: str) -> str:
    """Prefix a query with ``WITH name AS (...)`` for each named fixture."""
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {ctes}\n{body}"
