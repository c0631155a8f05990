"""DuckDB oracles: for each registered query, the same result in plain SQL.

Views ``lineitem orders events embeddings documents labels ...`` are assumed
registered.  Fixtures are inlined as CTEs from ``sylva.sources.fixtures.SQL``.
"""

from __future__ import annotations

from sylva.sources.fixtures import LINE_FEATURES, with_fixtures

R = 6  # rounding digits (same as the Spark side)


def r(x: str, digits: int = R) -> str:
    """The oracle twin of ``sylva.plans.common.snap``."""
    scale = float(10 ** digits)
    return f"(floor(({x}) * {scale} + 0.5) / {scale})"


LINE_REG_COLS = list(LINE_FEATURES) + ["revenue"]

# ---------------------------------------------------------------- reusable CTE text
EMB_VI_CTES = f"""
emb_g AS (SELECT feature, label, count(value) AS n, avg(value) AS m, var_pop(value) * count(value) AS ssw
          FROM emb_long WHERE value IS NOT NULL AND label IS NOT NULL GROUP BY feature, label),
emb_g2 AS (SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS gm FROM emb_g),
emb_anova AS (SELECT feature,
          (sum(n * (m - gm) * (m - gm)) / nullif(count(*) - 1, 0))
          / nullif(sum(ssw) / nullif(sum(n) - count(*), 0), 0) AS f_stat
          FROM emb_g2 GROUP BY feature),
emb_idx AS (SELECT printf('e%02d', CAST(i AS INTEGER)) AS feature, CAST(i AS INTEGER) AS idx
            FROM (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS i)),
emb_stat AS (SELECT x.feature, x.idx, coalesce(a.f_stat / 1000.0, 0.0) AS raw
             FROM emb_idx x LEFT JOIN emb_anova a ON x.feature = a.feature),
emb_vi1 AS (SELECT feature, idx, 0.0 AS vi_model,
            CASE WHEN sum(raw) OVER () > 0 THEN raw / sum(raw) OVER () ELSE raw END AS vi_stat FROM emb_stat),
vi AS (SELECT feature, idx, vi_model, vi_stat, vi_stat AS vi,
       CAST(row_number() OVER (ORDER BY vi_stat DESC, idx) AS INTEGER) AS rank FROM emb_vi1)"""


def line_multi_vi_ctes() -> str:
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    unions = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, l_returnflag AS label FROM line_multi" for c in feats)
    idx = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({i} AS INTEGER) AS idx" for i, c in enumerate(feats))
    return f"""
lm_long AS ({unions}),
lm_g AS (SELECT feature, label, count(value) AS n, avg(value) AS m, var_pop(value) * count(value) AS ssw
         FROM lm_long WHERE value IS NOT NULL GROUP BY feature, label),
lm_g2 AS (SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS gm FROM lm_g),
lm_anova AS (SELECT feature, (sum(n * (m - gm) * (m - gm)) / nullif(count(*) - 1, 0))
             / nullif(sum(ssw) / nullif(sum(n) - count(*), 0), 0) AS f_stat FROM lm_g2 GROUP BY feature),
lm_idx AS ({idx}),
lm_stat AS (SELECT x.feature, x.idx, coalesce(a.f_stat / 1000.0, 0.0) AS raw
            FROM lm_idx x LEFT JOIN lm_anova a ON x.feature = a.feature),
lm_vi1 AS (SELECT feature, idx, 0.0 AS vi_model,
           CASE WHEN sum(raw) OVER () > 0 THEN raw / sum(raw) OVER () ELSE raw END AS vi_stat FROM lm_stat),
vi AS (SELECT feature, idx, vi_model, vi_stat, vi_stat AS vi,
       CAST(row_number() OVER (ORDER BY vi_stat DESC, idx) AS INTEGER) AS rank FROM lm_vi1)"""


def mute_ctes(src: str = "vi", level: str = "moderate", name: str = "muted", min_features: int = 5,
              fallback_all: bool = False) -> str:
    base = {"no": "0.0", "moderate": f"greatest(0.01, avg(vi) OVER ())",
            "aggressive": f"greatest(0.01, median(vi) OVER ())"}[level]
    kept = f"CASE WHEN n_pass < {min_features} THEN rank <= {min_features} ELSE vi >= t0 END"
    thr = f"CASE WHEN n_pass < {min_features} AND n_all > 0 AND {str(min_features > 0).upper()} THEN fifth ELSE t0 END"
    if fallback_all:
        kept = f"CASE WHEN n_pass = 0 THEN TRUE ELSE {kept} END"
        thr = f"CASE WHEN n_pass = 0 THEN t0 ELSE {thr} END"
    return f"""
{name}_a AS (SELECT *, {base} AS t0 FROM {src}),
{name}_b AS (SELECT *, sum(CASE WHEN vi >= t0 THEN 1 ELSE 0 END) OVER () AS n_pass, count(*) OVER () AS n_all,
             min(CASE WHEN rank <= {min_features} THEN vi END) OVER () AS fifth FROM {name}_a),
{name} AS (SELECT feature, idx, vi_model, vi_stat, vi, rank, {kept} AS kept, {thr} AS threshold FROM {name}_b)"""


def banded_ctes(src: str = "muted", order: str = "desc", top_n: int = 10, cap: str | None = None,
                positional: bool = False, name: str = "plan", prefix: str = "LC") -> str:
    posexpr = "pos_desc" if order == "desc" else "(k - 1 - pos_desc)"
    w = ("CASE WHEN a_w + b_w > 0 THEN a_w / (a_w + b_w) ELSE 0.5 END",
         "CASE WHEN a_w + b_w > 0 THEN b_w / (a_w + b_w) ELSE 0.5 END")
    if positional:
        weights_src = f"""
{name}_pv AS (SELECT vi AS pvi, row_number() OVER (ORDER BY idx) - 1 AS ppos FROM {src} WHERE kept),
{name}_pw AS (SELECT p.*, coalesce(pa.pvi, 0.0) AS a_w, coalesce(pb.pvi, 0.0) AS b_w FROM {name}_p p
              LEFT JOIN {name}_pv pa ON pa.ppos = p.i LEFT JOIN {name}_pv pb ON pb.ppos = p.j)"""
    else:
        weights_src = f"""
{name}_pw AS (SELECT p.*, a_vi AS a_w, b_vi AS b_w FROM {name}_p p)"""
    capped = f"WHERE seq <= {cap}" if cap is not None else ""
    return f"""
{name}_r0 AS (SELECT feature, idx, vi, row_number() OVER (ORDER BY vi DESC, idx) - 1 AS pos_desc FROM {src} WHERE kept),
{name}_r1 AS (SELECT *, count(*) OVER () AS k FROM {name}_r0 WHERE pos_desc < {top_n}),
{name}_r AS (SELECT feature, idx, vi, k, CAST({posexpr} AS INTEGER) AS pos FROM {name}_r1),
{name}_p AS (SELECT a.pos AS i, b.pos AS j, a.feature AS f1, b.feature AS f2, a.vi AS a_vi, b.vi AS b_vi
             FROM {name}_r a JOIN {name}_r b
             ON a.pos < least(5, a.k - 1) AND b.pos > a.pos AND b.pos < least(a.pos + 3, a.k)),{weights_src},
{name}_s AS (SELECT printf('{prefix}_%d_%d', i, j) AS name, i, j, f1, f2, {w[0]} AS w1, {w[1]} AS w2,
             row_number() OVER (ORDER BY i, j) AS seq FROM {name}_pw),
{name} AS (SELECT name, i, j, f1, f2, w1, w2 FROM {name}_s {capped})"""


def all_pairs_ctes(src: str = "muted", top_n: int = 15, name: str = "plan") -> str:
    return f"""
{name}_r AS (SELECT feature, vi, kept, CAST(row_number() OVER (ORDER BY vi DESC, idx) - 1 AS INTEGER) AS pos FROM {src}),
{name} AS (SELECT printf('LC_opt_%d_%d', a.pos, b.pos) AS name, a.pos AS i, b.pos AS j, a.feature AS f1, b.feature AS f2,
           CASE WHEN a.vi + b.vi > 0 THEN a.vi / (a.vi + b.vi) ELSE 0.5 END AS w1,
           CASE WHEN a.vi + b.vi > 0 THEN b.vi / (a.vi + b.vi) ELSE 0.5 END AS w2
           FROM {name}_r a JOIN {name}_r b ON a.pos < b.pos
           WHERE a.pos < {top_n} AND b.pos < {top_n} AND a.kept AND b.kept)"""


def _wrap(ctes: str, body: str, *fixtures: str) -> str:
    """Fixtures first, then the extra CTEs, then the body."""
    q = with_fixtures("SELECT 1", *fixtures)
    head = q[: -len("SELECT 1")].rstrip()
    return f"{head},{ctes}\n{body}" if ctes.strip() else f"{head}\n{body}"


# ---------------------------------------------------------------- queries
ORACLE: dict[str, str] = {}

ORACLE["scan_shape"] = ("SELECT count(*) AS n_rows, CAST(5 AS INTEGER) AS n_features, 'revenue' AS target "
                        "FROM lineitem")
ORACLE["scan_preview"] = with_fixtures(
    "SELECT row_id, " + ", ".join(r(c) + f" AS {c}" if c != "l_linenumber" else c for c in LINE_REG_COLS)
    + " FROM line_reg ORDER BY row_id LIMIT 5", "line_reg")

_LM_COLS = [("row_id", "string"), ("l_quantity", "double"), ("l_extendedprice", "double"),
            ("l_discount", "double"), ("l_tax", "double"), ("l_linenumber", "int"), ("l_linestatus", "string"),
            ("l_returnflag", "string")]
ORACLE["scan_column_info"] = with_fixtures(" UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS pos, '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null FROM line_multi"
    for i, (c, t) in enumerate(_LM_COLS)), "line_multi")

ORACLE["results_name"] = ("SELECT source, 'results_' || replace(source || '.csv', '.csv', '') || '.csv' AS file "
                          "FROM (SELECT DISTINCT source FROM documents)")


def _type_sql(table: str, col: str, dtype: str, is_string: bool) -> str:
    v = col if is_string else f"CAST({col} AS DOUBLE)"
    kind = "'classification'" if is_string else \
        "CASE WHEN count(DISTINCT {c}) < 10 THEN 'classification' ELSE 'regression' END".format(c=col)
    return (f"SELECT '{col}' AS target, '{dtype}' AS dtype, count(DISTINCT {col}) AS n_distinct, "
            f"CAST(min({v}) AS VARCHAR) AS min_value, CAST(max({v}) AS VARCHAR) AS max_value, "
            f"{kind} AS problem_type FROM {table}")


ORACLE["detect_type"] = " UNION ALL ".join([
    _type_sql("lineitem", "l_returnflag", "string", True), _type_sql("lineitem", "l_linenumber", "int", False),
    _type_sql("lineitem", "l_quantity", "double", False), _type_sql("embeddings", "label", "int", False)])


def exact_mean(x: str) -> str:
    """The oracle twin of ``sylva.functions.stats.exact_mean``."""
    d = f"TRY_CAST({x} AS DECIMAL(30, 10))"
    return (f"(CASE WHEN coalesce(bool_and(CAST({d} AS DOUBLE) = {x}), FALSE) AND count({d}) = count({x}) "
            f"THEN CAST(sum({d}) AS DOUBLE) / count({x}) ELSE avg({x}) END)")


def _describe_sql(src: str, cols: list[str], start: int = 0) -> str:
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT CAST({i + start} AS INTEGER) AS idx, '{c}' AS feature, count({x}) AS n, {r(exact_mean(x))} AS mean, "
            f"{r(f'stddev_samp({x})')} AS std, {r(f'min({x})')} AS min, {r(f'quantile_cont({x}, 0.25)')} AS q25, "
            f"{r(f'quantile_cont({x}, 0.5)')} AS q50, {r(f'quantile_cont({x}, 0.75)')} AS q75, "
            f"{r(f'max({x})')} AS max FROM {src}")
    return " UNION ALL ".join(parts)


ORACLE["profile_describe"] = with_fixtures(_describe_sql("line_reg", LINE_REG_COLS), "line_reg")
ORACLE["profile_target"] = with_fixtures(_describe_sql("line_reg", ["revenue"]), "line_reg")
ORACLE["target_distribution"] = with_fixtures(
    "SELECT value, count, " + r("count / sum(count) OVER ()") + " AS share FROM "
    "(SELECT l_returnflag AS value, count(*) AS count FROM line_multi WHERE l_returnflag IS NOT NULL GROUP BY 1)",
    "line_multi")


def _missing_sql(src: str, cols: list[tuple[str, bool]]) -> str:
    parts = []
    for c, is_double in cols:
        cond = f"{c} IS NULL OR isnan({c})" if is_double else f"{c} IS NULL"
        parts.append(f"SELECT '{c}' AS \"column\", CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS missing, "
                     f"count(*) AS n FROM {src}")
    return ("SELECT \"column\", missing, " + r("missing / n * 100.0") + " AS percentage FROM ("
            + " UNION ALL ".join(parts) + ") WHERE missing > 0")


ORACLE["profile_missing"] = with_fixtures(_missing_sql("line_null", [
    ("row_id", False), ("l_quantity", True), ("l_extendedprice", True), ("l_discount", True), ("l_tax", True),
    ("l_linenumber", False), ("revenue", True)]), "line_null")
ORACLE["profile_missing_orders"] = with_fixtures(_missing_sql("order_null", [
    ("row_id", False), ("o_totalprice", True), ("o_orderpriority", False), ("o_orderstatus", False)]), "order_null")
ORACLE["profile_duplicates"] = with_fixtures(
    "SELECT sum(c) AS n_rows, count(*) AS n_distinct, sum(c) - count(*) AS duplicates, "
    + r("(sum(c) - count(*)) / sum(c) * 100.0") + " AS percentage FROM "
    "(SELECT count(*) AS c FROM line_dup GROUP BY ALL_COLS)".replace(
        "ALL_COLS", "l_linenumber, l_returnflag, l_linestatus, l_quantity"), "line_dup")


def _corr_expr(a: str, b: str) -> str:
    a2 = f"CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
    b2 = f"CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
    return f"covar_pop({a2}, {b2}) / nullif(stddev_pop({a2}) * stddev_pop({b2}), 0)"


def _corr_sql(src: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        parts.append(f"SELECT '{a}' AS a, '{a}' AS b, CASE WHEN stddev_pop(CAST({a} AS DOUBLE)) > 0 THEN 1.0 END "
                     f"AS corr FROM {src}")
        for b in cols[i + 1:]:
            e = r(_corr_expr(a, b))
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, {e} AS corr FROM {src}")
            parts.append(f"SELECT '{b}' AS a, '{a}' AS b, {e} AS corr FROM {src}")
    return " UNION ALL ".join(parts)


ORACLE["profile_corr"] = with_fixtures(_corr_sql("line_reg", LINE_REG_COLS), "line_reg")
ORACLE["profile_target_corr"] = with_fixtures(
    "SELECT feature, corr FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(_corr_expr(c, 'revenue'))} AS corr FROM line_reg" for c in LINE_FEATURES)
    + ") ORDER BY corr DESC NULLS LAST, feature LIMIT 10", "line_reg")
ORACLE["profile_hist"] = with_fixtures("""
SELECT CAST(g.b AS INTEGER) AS bin, """ + r("rg.lo + g.b * rg.w") + " AS lower, " + r("rg.lo + (g.b + 1) * rg.w")
    + """ AS upper, coalesce(c.cnt, 0) AS count
FROM range(30) g(b)
CROSS JOIN (SELECT min(revenue) AS lo, max(revenue) AS hi, (max(revenue) - min(revenue)) / 30 AS w FROM line_reg) rg
LEFT JOIN (SELECT CASE WHEN rg2.hi = rg2.lo THEN 0 ELSE CAST(least(floor((revenue - rg2.lo) / rg2.w), 29) AS INTEGER) END AS b,
                  count(*) AS cnt
           FROM line_reg, (SELECT min(revenue) AS lo, max(revenue) AS hi, (max(revenue) - min(revenue)) / 30 AS w
                           FROM line_reg) rg2
           WHERE revenue IS NOT NULL GROUP BY 1) c ON c.b = g.b""", "line_reg")
ORACLE["profile_box"] = with_fixtures("""
, q AS (SELECT quantile_cont(revenue, 0.25) AS q1, quantile_cont(revenue, 0.5) AS q2,
              quantile_cont(revenue, 0.75) AS q3 FROM line_reg)
SELECT """ + ", ".join([r("q1") + " AS q1", r("q2") + " AS median", r("q3") + " AS q3", r("q3 - q1") + " AS iqr",
                        r("min(CASE WHEN revenue BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN revenue END)")
                        + " AS lower_whisker",
                        r("max(CASE WHEN revenue BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN revenue END)")
                        + " AS upper_whisker",
                        "CAST(sum(CASE WHEN revenue IS NOT NULL AND NOT (revenue BETWEEN q1 - 1.5 * (q3 - q1) "
                        "AND q3 + 1.5 * (q3 - q1)) THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers"])
    + " FROM line_reg, q GROUP BY q1, q2, q3", "line_reg").replace("\n, q AS", ", q AS", 1)


# ---------------------------------------------------------------- D: preparation
def _cols(cols, src_alias=""):
    return ", ".join(cols)


ORACLE["prep_dedupe"] = with_fixtures(
    "SELECT l_linenumber, l_returnflag, l_linestatus, " + r("l_quantity") + " AS l_quantity, count(*) - 1 AS removed FROM line_dup GROUP BY ALL",
    "line_dup")
ORACLE["prep_impute_num"] = with_fixtures(
    "SELECT row_id, " + r("l_quantity") + " AS l_quantity, " + r("l_extendedprice") + " AS l_extendedprice, "
    + r("coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM line_null))") + " AS l_discount, "
    + r("l_tax") + " AS l_tax, l_linenumber, " + r("revenue") + " AS revenue FROM line_null", "line_null")
ORACLE["prep_impute_cat"] = with_fixtures(
    "SELECT row_id, " + r("o_totalprice") + " AS o_totalprice, "
    "coalesce(o_orderpriority, (SELECT o_orderpriority FROM order_null WHERE o_orderpriority IS NOT NULL "
    "GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority, "
    "coalesce(o_orderstatus, (SELECT o_orderstatus FROM order_null WHERE o_orderstatus IS NOT NULL "
    "GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderstatus FROM order_null", "order_null")
# TPC-H order priorities (fixed values of the data generator); the first sorted one is dropped.
_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
ORACLE["prep_onehot"] = with_fixtures(
    "SELECT row_id, " + r("o_totalprice") + " AS o_totalprice, "
    + ", ".join(f"CAST(o_orderpriority = '{v}' AS DOUBLE) AS \"o_orderpriority_{v}\"" for v in _PRIORITIES[1:])
    + ", o_orderstatus FROM order_cat", "order_cat")
ORACLE["prep_label"] = with_fixtures(
    "SELECT row_id, " + ", ".join(r(c) + f" AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    + ", l_linenumber, l_linestatus, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS label "
    "FROM line_multi", "line_multi")
ORACLE["prep_scale"] = with_fixtures(
    "SELECT row_id, " + ", ".join(
        r(f"(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / "
          f"coalesce(nullif(stddev_pop(CAST({c} AS DOUBLE)) OVER (), 0), 1.0)") + f" AS {c}" for c in LINE_FEATURES)
    + ", " + r("revenue") + " AS revenue FROM line_reg", "line_reg")


def _h52(key: str, seed: int = 42) -> str:
    return f"CAST(('0x' || substr(md5({key} || '|{seed}'), 1, 13)) AS BIGINT)"


ORACLE["prep_split"] = with_fixtures(
    f"SELECT row_id, row_number() OVER (ORDER BY {_h52('row_id')}, row_id) <= ceil(0.2 * count(*) OVER ()) AS is_test "
    "FROM line_reg", "line_reg")
ORACLE["prep_stratified"] = with_fixtures(
    f"SELECT row_id, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY {_h52('row_id')}, row_id) "
    "<= floor(0.2 * count(*) OVER (PARTITION BY l_returnflag) + 0.5) AS is_test FROM line_multi", "line_multi")
ORACLE["prep_sample_anti"] = with_fixtures(
    f"SELECT row_id, row_number() OVER (ORDER BY {_h52('row_id')}, row_id) <= "
    "least(150, floor(0.7 * count(*) OVER ())) AS is_train FROM line_reg", "line_reg")


def _noise_sql(p: int = 5, target_p: int = 500, seed: int = 42, weight: float = 0.5) -> str:
    from sylva.functions.hashing import sql_hash_u32, sql_stream_gaussian
    src = f"CAST(('0x' || substr(md5('{seed}|' || CAST(j AS VARCHAR)), 1, 8)) AS BIGINT) % {p}"
    feat = "CASE src " + " ".join(f"WHEN {i} THEN CAST({c} AS DOUBLE)" for i, c in enumerate(LINE_FEATURES)) + " END"
    g = sql_stream_gaussian("rk", "js.j")
    return with_fixtures(f"""
, js AS (SELECT CAST(j AS BIGINT) AS j, CAST({src} AS INTEGER) AS src FROM range({p}, {target_p}) t(j)),
lr AS (SELECT *, {sql_hash_u32("concat_ws('|', row_id, '" + str(seed) + "')")} AS rk FROM line_reg),
nz AS (SELECT printf('nz%04d', js.j) AS feature, js.src, {weight} * {feat} + {1.0 - weight} * {g} AS value
       FROM lr CROSS JOIN js)
SELECT feature, count(value) AS n, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std, src
FROM nz GROUP BY feature, src""", "line_reg").replace("\n, js AS", ", js AS", 1)


ORACLE["prep_noise"] = _noise_sql()

# ---------------------------------------------------------------- E: importance
ORACLE["vi_anova"] = _wrap(EMB_VI_CTES, f"SELECT feature, {r('f_stat')} AS f_stat FROM emb_anova", "emb_long")
ORACLE["vi_anova_line"] = _wrap(line_multi_vi_ctes(), f"SELECT feature, {r('f_stat')} AS f_stat FROM lm_anova",
                                "line_multi")
ORACLE["vi_pearson"] = with_fixtures(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r('abs(' + _corr_expr(c, 'revenue') + ')')} AS abs_corr FROM line_reg"
    for c in LINE_FEATURES), "line_reg")
_VI_COLS = f"feature, idx, {r('vi_model')} AS vi_model, {r('vi_stat')} AS vi_stat, {r('vi')} AS vi, rank"
ORACLE["vi_blend"] = _wrap(EMB_VI_CTES, f"SELECT {_VI_COLS} FROM vi", "emb_long")
ORACLE["vi_stats"] = _wrap(EMB_VI_CTES, f"SELECT {r('median(vi)')} AS median, {r('avg(vi)')} AS mean, "
                                        f"{r('stddev_pop(vi)')} AS std, count(*) AS n FROM vi", "emb_long")
ORACLE["vi_top"] = _wrap(EMB_VI_CTES, f"SELECT {_VI_COLS} FROM vi WHERE rank <= 15", "emb_long")

# ---------------------------------------------------------------- M: muting
ORACLE["mute_levels"] = _wrap(
    EMB_VI_CTES + "," + mute_ctes(level="no", name="m_no") + "," + mute_ctes(level="moderate", name="m_mod") + ","
    + mute_ctes(level="aggressive", name="m_agg"),
    " UNION ALL ".join(f"SELECT feature, '{lv}' AS level, kept, {r('threshold')} AS threshold FROM {n}"
                       for lv, n in (("no", "m_no"), ("moderate", "m_mod"), ("aggressive", "m_agg"))), "emb_long")
ORACLE["mute_floor"] = _wrap(line_multi_vi_ctes() + "," + mute_ctes(),
                             f"SELECT feature, rank, {r('vi')} AS vi, kept, {r('threshold')} AS threshold FROM muted",
                             "line_multi")
ORACLE["mute_nofloor"] = _wrap(EMB_VI_CTES + "," + mute_ctes(min_features=0, fallback_all=True),
                               f"SELECT feature, kept, {r('threshold')} AS threshold FROM muted", "emb_long")
ORACLE["mute_report"] = _wrap(
    EMB_VI_CTES + "," + mute_ctes(),
    "SELECT count(*) AS n_total, CAST(sum(CAST(kept AS INTEGER)) AS BIGINT) AS n_kept, "
    "count(*) - CAST(sum(CAST(kept AS INTEGER)) AS BIGINT) AS n_muted, "
    + r("sum(CAST(kept AS INTEGER)) / count(*) * 100.0") + " AS pct_kept, "
    + r("(count(*) - sum(CAST(kept AS INTEGER))) / count(*) * 100.0") + " AS pct_muted, "
    + r("max(threshold)") + " AS threshold FROM muted", "emb_long")
ORACLE["mute_schedule"] = _wrap(
    EMB_VI_CTES, f"SELECT feature, idx, {r('vi')} AS vi, row_number() OVER (ORDER BY vi, idx DESC) AS last_step, "
                 "count(*) OVER () AS n_features FROM vi", "emb_long")

# ---------------------------------------------------------------- G: combinations
_PLAN_COLS = f"name, i, j, f1, f2, {r('w1')} AS w1, {r('w2')} AS w2"
_EMB_MUTED = EMB_VI_CTES + "," + mute_ctes()
ORACLE["pairs_banded"] = _wrap(_EMB_MUTED + "," + banded_ctes(), f"SELECT {_PLAN_COLS} FROM plan", "emb_long")
ORACLE["pairs_capped"] = _wrap(
    _EMB_MUTED + "," + banded_ctes(order="asc", cap="(SELECT count(*) FROM muted WHERE kept)"),
    f"SELECT {_PLAN_COLS} FROM plan", "emb_long")
ORACLE["pairs_positional"] = _wrap(_EMB_MUTED + "," + banded_ctes(order="asc", positional=True),
                                   f"SELECT {_PLAN_COLS} FROM plan", "emb_long")
ORACLE["pairs_all"] = _wrap(_EMB_MUTED + "," + all_pairs_ctes(), f"SELECT {_PLAN_COLS} FROM plan", "emb_long")
ORACLE["lc_columns"] = _wrap(
    _EMB_MUTED + "," + banded_ctes(),
    "SELECT e1.row_id, p.name, " + r("p.w1 * e1.value + p.w2 * e2.value") + " AS value FROM plan p "
    "JOIN emb_long e1 ON e1.feature = p.f1 JOIN emb_long e2 ON e2.row_id = e1.row_id AND e2.feature = p.f2",
    "emb_long")
ORACLE["flagship"] = _wrap(
    _EMB_MUTED, f"SELECT feature, idx, {r('vi')} AS vi, rank, kept, {r('threshold')} AS threshold FROM muted",
    "emb_long")

# ---------------------------------------------------------------- I: metrics
_CLF_METRICS = """
conf AS (SELECT {g}label AS y, prediction AS p, count(*) AS c FROM {src} GROUP BY ALL),
by_true AS (SELECT {g}y AS cls, sum(c) AS support, sum(CASE WHEN y = p THEN c ELSE 0 END) AS tp FROM conf GROUP BY ALL),
by_pred AS (SELECT {g}p AS cls, sum(c) AS npred FROM conf GROUP BY ALL),
per AS (SELECT {gt}t.support, t.tp, coalesce(t.tp / nullif(pr.npred, 0), 0.0) AS prec, t.tp / t.support AS rec
        FROM by_true t LEFT JOIN by_pred pr ON t.cls = pr.cls {gj}),
per2 AS (SELECT *, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0.0) AS f1 FROM per),
agg AS (SELECT {g}sum(support) AS n, sum(tp) AS correct, sum(support * prec) AS wp, sum(support * rec) AS wr,
        sum(support * f1) AS wf FROM per2 GROUP BY ALL)"""


def _clf_sql(src: str, group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    gt = f"t.{group}, " if group else ""
    gj = f"AND t.{group} = pr.{group}" if group else ""
    return _CLF_METRICS.format(g=g, gt=gt, gj=gj, src=src)


ORACLE["metrics_clf"] = _wrap(
    _clf_sql("pred_pairs"),
    f"SELECT n, {r('correct / n')} AS accuracy, {r('1 - correct / n')} AS error, {r('wp / n')} AS precision, "
    f"{r('wr / n')} AS recall, {r('wf / n')} AS f1_score FROM agg", "pred_pairs")


def _u32(expr: str) -> str:
    return f"CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT)"


ORACLE["metrics_auc"] = with_fixtures(f"""
, sc AS (SELECT p.row_id, p.label, CAST(c.k AS DOUBLE) AS cls,
                {_u32("p.row_id || '|auc|' || CAST(c.k AS VARCHAR)")} / 4294967296.0 AS score
         FROM pred_pairs p CROSS JOIN range(3) c(k)),
rk AS (SELECT cls, label, score, rank() OVER (PARTITION BY cls ORDER BY score) AS r0,
              count(*) OVER (PARTITION BY cls, score) AS tie FROM sc),
per AS (SELECT cls, (sum(CASE WHEN label = cls THEN r0 + (tie - 1) / 2.0 END)
                     - sum(CASE WHEN label = cls THEN 1 ELSE 0 END) * (sum(CASE WHEN label = cls THEN 1 ELSE 0 END) + 1) / 2.0)
                    / nullif(sum(CASE WHEN label = cls THEN 1 ELSE 0 END) * sum(CASE WHEN label <> cls THEN 1 ELSE 0 END), 0)
                    AS auc FROM rk GROUP BY cls)
SELECT cls, {r('auc')} AS auc FROM per UNION ALL SELECT -1.0 AS cls, {r('avg(auc)')} AS auc FROM per""",
                                      "pred_pairs").replace("\n, sc AS", ", sc AS", 1)
_REG = ("count(*) AS n, {mse} AS mse, {rmse} AS rmse, {mae} AS mae, {r2} AS r2")


def _reg_cols(y: str, p: str) -> str:
    res = f"({y} - {p})"
    return _REG.format(mse=r(f"avg({res} * {res})"), rmse=r(f"sqrt(avg({res} * {res}))"), mae=r(f"avg(abs({res}))"),
                       r2=r(f"1 - sum({res} * {res}) / nullif(var_pop({y}) * count({y}), 0)"))


ORACLE["metrics_reg"] = with_fixtures(
    f"SELECT {_reg_cols('revenue', 'l_extendedprice * 0.95')} FROM line_reg", "line_reg")
ORACLE["metrics_grouped"] = (
    f"SELECT l_linestatus, {_reg_cols('l_extendedprice * (1 - l_discount)', 'l_extendedprice * 0.95')} "
    "FROM lineitem GROUP BY l_linestatus")

# ---------------------------------------------------------------- J: result tables
_BOARD = """
board AS (SELECT model, CAST(count(DISTINCT rep) AS INTEGER) AS features,
                 avg(CASE WHEN error < 150 THEN 1.0 ELSE 0.0 END) AS train_accuracy,
                 avg(CASE WHEN error < 100 THEN 1.0 ELSE 0.0 END) AS test_accuracy,
                 sum(error) / 1000.0 AS train_time,
                 CASE WHEN contains(model, 'RLT') THEN 'RLT' ELSE 'Baseline' END AS type
          FROM event_errors GROUP BY model),
lb AS (SELECT *, row_number() OVER (ORDER BY test_accuracy DESC, model) AS rank FROM board)"""
_BOARD_COLS = (f"model, features, {r('train_accuracy')} AS train_accuracy, {r('test_accuracy')} AS test_accuracy, "
               f"{r('train_time')} AS train_time, type")
ORACLE["board_rank"] = _wrap(_BOARD, f"SELECT {_BOARD_COLS}, rank FROM lb", "event_errors")
ORACLE["board_best"] = _wrap(_BOARD, f"SELECT {_BOARD_COLS}, rank FROM lb WHERE rank = 1", "event_errors")
ORACLE["board_position"] = _wrap(_BOARD + """,
pa AS (SELECT count(*) AS n_models, min(CASE WHEN contains(model, 'RLT') THEN rank END) AS pos FROM lb),
pp AS (SELECT CAST(coalesce(pa.pos, pa.n_models) AS INTEGER) AS position, pa.n_models,
              coalesce(lb.test_accuracy, 0.0) AS score FROM pa LEFT JOIN lb ON lb.rank = pa.pos)""",
    f"SELECT position, n_models, {r('score')} AS score, CASE WHEN position = 1 THEN 'winner' "
    "WHEN position <= 3 THEN 'top3' ELSE 'other' END AS tier FROM pp", "event_errors")
ORACLE["board_stats"] = _wrap(_BOARD, f"SELECT {r('max(test_accuracy)')} AS best, {r('min(test_accuracy)')} AS worst, "
                                      f"{r('avg(test_accuracy)')} AS mean, {r('stddev_samp(test_accuracy)')} AS std "
                                      "FROM board", "event_errors")
ORACLE["board_improvement"] = _wrap(_BOARD + """,
ia AS (SELECT max(CASE WHEN contains(model, 'RLT') THEN test_accuracy END) AS rlt_score,
              max(CASE WHEN NOT contains(model, 'RLT') THEN test_accuracy END) AS best_other FROM board)""",
    f"SELECT {r('rlt_score')} AS rlt_score, {r('best_other')} AS best_other, "
    f"{r('(rlt_score - best_other) / nullif(best_other, 0) * 100.0')} AS improvement_pct, "
    "CASE WHEN rlt_score > best_other THEN 'better' WHEN abs(rlt_score - best_other) < 0.01 THEN 'equivalent' "
    "ELSE 'worse' END AS verdict FROM ia", "event_errors")
_RANKED = """
me AS (SELECT model, """ + exact_mean("error") + """ AS error FROM event_errors GROUP BY model),
rel AS (SELECT model, error, error / min(error) OVER () AS relative_error FROM me),
ranked AS (SELECT *, row_number() OVER (ORDER BY relative_error, model) AS rank FROM rel),
ranked2 AS (SELECT *, CASE rank WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' END AS medal,
                   count(*) OVER () AS n_all FROM ranked)"""
_RANKED_COLS = f"model, {r('error')} AS error, {r('relative_error')} AS relative_error, rank, medal"
ORACLE["rel_error"] = _wrap(_RANKED, f"SELECT {_RANKED_COLS} FROM ranked2", "event_errors")
ORACLE["rel_head_tail"] = _wrap(_RANKED, f"SELECT {_RANKED_COLS} FROM ranked2 WHERE rank <= 3 OR rank > n_all - 2",
                                "event_errors")
ORACLE["top5_relative"] = _wrap(_RANKED, f"SELECT {_RANKED_COLS} FROM ranked2 WHERE rank <= 5", "event_errors")
ORACLE["family_summary"] = _wrap(
    _RANKED, "SELECT CASE WHEN starts_with(model, 'RLT-') AND model <> 'RLT-naive' THEN 'RLT variants' "
             f"ELSE 'Baseline' END AS family, count(*) AS n, {r('min(relative_error)')} AS best, "
             f"{r('max(relative_error)')} AS worst, {r('avg(relative_error)')} AS mean FROM ranked2 GROUP BY 1",
    "event_errors")


def _best_per_type_sql(src_ctes: str, src: str, metric: str, higher: bool) -> str:
    order = f"{metric} DESC, model" if higher else f"{metric}, model"
    imp = ("(r.score - b.score) / nullif(b.score, 0)" if higher else "(b.score - r.score) / nullif(b.score, 0)")
    return _wrap(src_ctes + f""",
typed AS (SELECT model, {metric} AS score, CASE WHEN contains(model, 'RLT') THEN 'RLT' ELSE 'Baseline' END AS type,
                 row_number() OVER (PARTITION BY CASE WHEN contains(model, 'RLT') THEN 'RLT' ELSE 'Baseline' END
                                    ORDER BY {order}) AS rn FROM {src}),
b AS (SELECT * FROM typed WHERE type = 'Baseline' AND rn = 1),
rr AS (SELECT * FROM typed WHERE type = 'RLT' AND rn = 1),
one AS (SELECT 1 AS k)""",
                 f"SELECT b.model AS best_baseline, {r('b.score')} AS baseline_score, r.model AS best_rlt, "
                 f"{r('r.score')} AS rlt_score, {r(imp + ' * 100.0')} AS improvement_pct "
                 "FROM one LEFT JOIN b ON TRUE LEFT JOIN rr r ON TRUE", "event_errors")


ORACLE["best_per_type"] = _best_per_type_sql(_BOARD, "board", "test_accuracy", True)
ORACLE["best_per_type_error"] = _best_per_type_sql(
    "\nme AS (SELECT model, " + exact_mean("error") + " AS error FROM event_errors GROUP BY model)", "me", "error", False)
_REP = """
rs AS (SELECT scenario, p, model, """ + exact_mean("error") + """ AS mean, stddev_pop(error) AS std, count(*) AS n_reps
       FROM event_errors GROUP BY scenario, p, model)"""
ORACLE["rep_summary"] = _wrap(_REP, f"SELECT scenario, p, model, {r('mean')} AS mean, {r('std')} AS std, n_reps FROM rs",
                              "event_errors")


def _cell(p: int) -> str:
    m, s = r("mean", 3), r("std", 3)
    return f"max(CASE WHEN p = {p} THEN printf('%.3f (%.3f)', {m}, {s}) END) AS p_{p}"


ORACLE["rep_matrix"] = _wrap(_REP, "SELECT scenario, model, " + ", ".join(_cell(p) for p in (200, 500, 1000))
                             + " FROM rs GROUP BY scenario, model", "event_errors")
ORACLE["best_per_scenario"] = _wrap(
    _REP, f"SELECT scenario, arg_min(model, (mean, model)) AS best_model, {r('min(mean)')} AS best_error "
          "FROM rs WHERE p = 200 GROUP BY scenario", "event_errors")
ORACLE["best_per_scenario_p"] = _wrap(
    _REP, f"SELECT scenario, p, arg_min(model, (mean, model)) AS best_model, {r('min(mean)')} AS best_error "
          "FROM rs GROUP BY scenario, p", "event_errors")
ORACLE["top3_auto"] = _wrap(
    _BOARD + ",\nlb_train AS (SELECT *, row_number() OVER (ORDER BY train_accuracy DESC, model) AS rank FROM board)",
    f"SELECT model, type, features, {r('train_accuracy')} AS train_accuracy, {r('test_accuracy')} AS test_accuracy, "
    f"{r('train_time')} AS train_time, rank FROM lb_train WHERE rank <= 3", "event_errors")
ORACLE["time_totals"] = _wrap(
    _BOARD, f"SELECT coalesce(type, 'ALL') AS type, {r('sum(train_time)')} AS seconds, "
            f"{r('sum(train_time) / 60.0')} AS minutes FROM board GROUP BY ROLLUP (type)", "event_errors")
ORACLE["parts_completed"] = _wrap(
    _BOARD + ",\n" + _RANKED.strip() + "," + _REP,
    "SELECT CAST((SELECT count(*) FROM board) > 0 AS BIGINT) + CAST((SELECT count(*) FROM rs) > 0 AS BIGINT) "
    "+ CAST((SELECT count(*) FROM ranked2) > 0 AS BIGINT) AS parts_completed, 3 AS parts_total", "event_errors")
ORACLE["feature_report"] = _wrap(
    _EMB_MUTED + "," + banded_ctes() + """,
fr AS (SELECT count(*) AS n_original, sum(CAST(kept AS INTEGER)) AS n_kept, (SELECT count(*) FROM plan) AS n_pairs
       FROM muted)""",
    "SELECT n_original, CAST(n_kept AS BIGINT) AS n_kept, CAST(n_pairs AS BIGINT) AS n_pairs, "
    "CAST(n_kept + n_pairs AS BIGINT) AS n_final, " + r("n_kept / n_original * 100.0") + " AS pct_kept, "
    + r("(1 - n_kept / n_original) * 100.0") + " AS pct_reduction FROM fr", "emb_long")


def _grid_sql() -> str:
    levels = (("no", "m_no", 0), ("moderate", "m_mod", 1), ("aggressive", "m_agg", 2))
    ctes = EMB_VI_CTES + "," + ",".join(mute_ctes(level=lv, name=n) for lv, n, _ in levels)
    per = " UNION ALL ".join(
        f"SELECT '{lv}' AS level, CAST(count(*) AS INTEGER) AS n_kept, md5(string_agg(feature, ',' ORDER BY feature)) "
        f"AS kept_sig FROM {n} WHERE kept" for lv, n, _ in levels)
    ctes += f""",
per_level AS ({per}),
ntr AS (SELECT least(150, floor(0.7 * count(*))) AS n_train FROM embeddings),
nm AS (SELECT 'nmin=2' AS nmin_label, 2 AS nmin
       UNION ALL SELECT 'nmin=n^1/3=' || CAST(CAST(greatest(2, floor(pow(n_train, 1.0 / 3.0))) AS INTEGER) AS VARCHAR),
                        CAST(greatest(2, floor(pow(n_train, 1.0 / 3.0))) AS INTEGER) FROM ntr),
g0 AS (SELECT l.level, CAST(c.n_comb AS INTEGER) AS n_comb, nm.nmin_label, CAST(nm.nmin AS INTEGER) AS nmin,
              l.n_kept, l.kept_sig
       FROM per_level l CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS n_comb) c CROSS JOIN nm),
g1 AS (SELECT *, CAST(least(CASE WHEN least(n_kept, 10) >= 7 THEN 10 WHEN least(n_kept, 10) <= 1 THEN 0
                                 ELSE 2 * least(n_kept, 10) - 3 END, n_comb * n_kept) AS INTEGER) AS n_pairs FROM g0)"""
    body = ("SELECT 'RLT-' || upper(substr(level, 1, 1)) || substr(level, 2, 2) || '-LC' || CAST(n_comb AS VARCHAR) "
            "|| '-' || nmin_label AS model, level, n_comb, nmin_label, nmin, n_kept, n_pairs, "
            "n_kept + n_pairs AS n_features, "
            "md5(concat_ws('|', kept_sig, CAST(n_pairs AS VARCHAR), CAST(nmin AS VARCHAR))) AS fit_key FROM g1")
    return _wrap(ctes, body, "emb_long")


ORACLE["variant_grid"] = _grid_sql()

ORACLE["model_mtry"] = (
    "SELECT CAST(p AS INTEGER) AS p, CAST(greatest(1, floor(sqrt(p))) AS INTEGER) AS mtry_sqrt, "
    "CAST(greatest(1, floor(ln(p))) AS INTEGER) AS mtry_log FROM "
    "(SELECT DISTINCT len(embedding) AS p FROM embeddings UNION SELECT count(DISTINCT o_orderpriority) FROM orders "
    "UNION SELECT count(DISTINCT source) FROM documents UNION SELECT count(DISTINCT lang) FROM documents "
    "UNION SELECT count(DISTINCT p_brand) FROM part)")

ORACLE["variant_grid_3x3"] = _wrap(
    EMB_VI_CTES + "," + ",".join(mute_ctes(level=lv, name=n) for lv, n in (("no", "m_no"), ("moderate", "m_mod"), ("aggressive", "m_agg"))) + """,
per_level AS (SELECT 'no' AS level, count(*) AS n_kept FROM m_no WHERE kept UNION ALL SELECT 'moderate', count(*) FROM m_mod WHERE kept
              UNION ALL SELECT 'aggressive', count(*) FROM m_agg WHERE kept),
g AS (SELECT level, CAST(c AS INTEGER) AS n_comb, CAST(n_kept AS INTEGER) AS n_kept,
             CAST(least(CASE WHEN n_kept >= 7 THEN 10 WHEN n_kept <= 1 THEN 0 ELSE 2 * n_kept - 3 END, c * n_kept) AS INTEGER) AS n_pairs
      FROM per_level, (SELECT unnest([1, 2, 5]) AS c))""",
    "SELECT 'RLT-' || upper(substr(level, 1, 1)) || substr(level, 2) || '-LC' || n_comb AS model, level, n_comb, n_kept, n_pairs, "
    "CAST(n_kept + n_pairs AS INTEGER) AS n_features FROM g", "emb_long")

ORACLE["study_plan"] = """
WITH n AS (SELECT CAST(least(150, floor(0.7 * count(*))) AS BIGINT) AS n_train FROM lineitem),
c AS (SELECT n_train, CAST(greatest(2, floor(pow(n_train, 1.0 / 3.0))) AS INTEGER) AS cube FROM n),
m AS (SELECT n_train, 'nmin=2' AS label, 2 AS nmin FROM c UNION ALL SELECT n_train, 'nmin=n^1/3=' || cube, cube FROM c)
SELECT 'RLT-' || level || '-LC' || k || '-' || label AS model, CAST(nmin AS INTEGER) AS nmin, n_train
FROM m, (SELECT unnest(['No', 'Mod', 'Agg']) AS level), (SELECT unnest([1, 2, 3, 4, 5]) AS k)
UNION ALL SELECT unnest(['RF', 'RF- √p', 'RF-log(p)', 'ET', 'BART', 'Lasso', 'Boosting', 'RLT-naive']), 1, n_train FROM n"""

ORACLE["prep_dedupe_ids"] = "SELECT min(o_orderkey) AS o_orderkey, o_custkey, o_orderstatus FROM orders GROUP BY o_custkey, o_orderstatus"


def _level1_sql(trees: int = 10, seed: int = 42) -> str:
    """Depth-1 Extra-Trees: per tree and feature one threshold, uniform in the feature's range; the largest Gini decrease wins.

    The uniform numbers and the order that breaks ties are the forest's draws for its root nodes, as literals."""
    import numpy as np

    from sylva.models.extra_trees import draws, root_key
    order, u = draws(np.array([root_key(seed, t) for t in range(trees)]), len(LINE_FEATURES))
    rank = np.argsort(np.argsort(order, axis=1, kind="stable"), axis=1)
    rows = ", ".join(f"({t}, '{c}', {float(u[t, i])!r}, {int(rank[t, i])})" for t in range(trees) for i, c in enumerate(LINE_FEATURES))
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, big FROM line_bin" for c in LINE_FEATURES)
    return _wrap(f"""
draw(tree, feature, u, place) AS (VALUES {rows}),
long AS ({long}),
span AS (SELECT feature, min(v) AS lo, max(v) AS hi, count(*) AS n, sum(big) AS pos FROM long GROUP BY feature),
cand AS (SELECT tree, draw.feature, place, lo + u * (hi - lo) AS threshold, n, pos FROM draw JOIN span ON draw.feature = span.feature),
side AS (SELECT tree, cand.feature, place, threshold, any_value(n) AS n, any_value(pos) AS pos, count(*) FILTER (v <= threshold) AS nl,
                coalesce(sum(big) FILTER (v <= threshold), 0) AS pl
         FROM cand JOIN long ON cand.feature = long.feature GROUP BY ALL),
gained AS (SELECT *, 2.0 * pos * (n - pos) / n - 2.0 * pl * (nl - pl) / nl - 2.0 * (pos - pl) * (n - nl - pos + pl) / (n - nl) AS gain
           FROM side WHERE nl > 0 AND nl < n),
best AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY gain DESC, place) AS k FROM gained)""",
                 f"SELECT CAST(tree AS INTEGER) AS tree, feature, {r('threshold')} AS threshold, {r('gain')} AS gain, nl AS n_left, "
                 "n - nl AS n_right FROM best WHERE k = 1", "line_bin")


ORACLE["model_et_level1"] = _level1_sql()


def _sample_ctes(fixture: str, target: str, seed: int = 42) -> str:
    """The training rows of Part 3, long by feature, with their 32-bit keys."""
    from sylva.functions.hashing import sql_hash_u32
    key = sql_hash_u32(f"concat_ws('|', row_id, '{seed}')")
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS f, CAST({c} AS DOUBLE) AS v, y, rk FROM sample" for i, c in enumerate(LINE_FEATURES))
    return f"""
sample AS (SELECT *, {key} AS rk, CAST({target} AS DOUBLE) AS y FROM {fixture}
           QUALIFY row_number() OVER (ORDER BY {_h52('row_id')}, row_id) <= least(150, floor(0.7 * count(*) OVER ()))),
long AS ({long})"""


def _rf_level1_sql(trees: int = 100) -> str:
    """Depth-1 forest: Poisson weights from the rows' keys, every threshold between neighbouring drawn values, largest Gini decrease."""
    from sylva.functions.hashing import MASK32, STRIDE, sql_mix32
    from sylva.models.bounded import POISSON_CDF
    u = "((" + sql_mix32(f"((rk + tree * {STRIDE}) & {MASK32})") + ") + 0.5) / 4294967296.0"
    weight = " + ".join(f"CAST(u >= {float(c)!r} AS INTEGER)" for c in POISSON_CDF)
    square = "({p} * {p} + ({n} - {p}) * ({n} - {p})) / {n}"
    return _wrap(_sample_ctes("line_bin", "big") + f""",
drawn AS (SELECT tree, feature, f, v, y, {u} AS u FROM long, (SELECT unnest(range({trees})) AS tree)),
weighed AS (SELECT tree, feature, f, v, sum({weight}) AS n, sum(({weight}) * y) AS p FROM drawn GROUP BY ALL),
found AS (SELECT tree, feature, f, v, CAST(n AS DOUBLE) AS n, p FROM weighed WHERE n > 0),
side AS (SELECT *, sum(n) OVER w AS nl, sum(p) OVER w AS pl, lead(v) OVER w AS nxt, sum(n) OVER (PARTITION BY tree, f) AS n0, sum(p) OVER (PARTITION BY tree, f) AS p0
         FROM found WINDOW w AS (PARTITION BY tree, f ORDER BY v)),
gained AS (SELECT *, {square.format(p='pl', n='nl')} + {square.format(p='(p0 - pl)', n='(n0 - nl)')} - {square.format(p='p0', n='n0')} AS gain FROM side WHERE nxt IS NOT NULL),
top AS (SELECT *, max(gain) OVER (PARTITION BY tree) AS most FROM gained),
best AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY f, v) AS k FROM top WHERE gain >= most - 1e-9 * n0 AND most > 1e-9 * n0)""",
                 f"SELECT CAST(tree AS INTEGER) AS tree, feature, {r('v + (nxt - v) / 2')} AS threshold, {r('most')} AS gain FROM best WHERE k = 1", "line_bin")


def _boost_level1_sql() -> str:
    """First stump of second-order boosting on residuals from the mean: weight of a leaf is sum / (rows + penalty), times the rate."""
    return _wrap(_sample_ctes("line_reg", "revenue / 100000.0") + """,
model AS (SELECT * FROM (VALUES ('XGBoost', 0.3, 1.0), ('Gradient Boosting', 0.1, 0.0)) AS t(model, rate, l2)),
base AS (SELECT avg(y) AS m FROM sample),
sums AS (SELECT feature, f, v, CAST(count(*) AS DOUBLE) AS n, sum(y - m) AS g FROM long, base GROUP BY ALL),
side AS (SELECT *, sum(n) OVER w AS nl, sum(g) OVER w AS gl, lead(v) OVER w AS nxt, sum(n) OVER (PARTITION BY f) AS n0, sum(g) OVER (PARTITION BY f) AS g0
         FROM sums WINDOW w AS (PARTITION BY f ORDER BY v)),
gained AS (SELECT *, gl * gl / (nl + l2) + (g0 - gl) * (g0 - gl) / (n0 - nl + l2) - g0 * g0 / (n0 + l2) AS gain FROM side, model WHERE nxt IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY gain DESC, f, v) AS k FROM gained)""",
                 f"SELECT model, feature, {r('v + (nxt - v) / 2')} AS threshold, {r('gain')} AS gain, {r('rate * gl / (nl + l2)')} AS left_leaf, "
                 f"{r('rate * (g0 - gl) / (n0 - nl + l2)')} AS right_leaf FROM best WHERE k = 1", "line_reg")


ORACLE["model_rf_level1"] = _rf_level1_sql()
ORACLE["model_boost_level1"] = _boost_level1_sql()


def _ada_sql(rounds: int = 3, rate: float = 0.1, cuts: int = 63, sample: int = 10_000) -> str:
    """Boosting rounds of stumps: cuts are quantiles of the rows with the smallest hashes; a round's weights follow from the rounds before."""
    probs = "[" + ", ".join(f"{(i + 1) / (cuts + 1)!r}" for i in range(cuts)) + "]"
    cols = ", ".join(LINE_FEATURES)

    def chain(name: str, k: int, source: str) -> str:
        listed = " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS f, CAST({c} AS DOUBLE) AS v, row_id, y, w FROM {name}_w{{r}}" for i, c in enumerate(LINE_FEATURES))
        taken = " UNION ALL ".join(f"SELECT {i} AS f, CAST({c} AS DOUBLE) AS v FROM {name}_s" for i, c in enumerate(LINE_FEATURES))
        out = f"""
{name}_w1 AS ({source}),
{name}_s AS (SELECT * FROM {name}_w1 QUALIFY row_number() OVER (ORDER BY {_h52('row_id')}, row_id) <= {sample}),
{name}_c AS (SELECT DISTINCT f, cut FROM (SELECT f, max(v) AS top, unnest(quantile_cont(v, {probs})) AS cut FROM ({taken}) GROUP BY f) WHERE cut < top)"""
        for r_ in range(1, rounds + 1):
            out += f""",
{name}_l{r_} AS ({listed.format(r=r_)}),
{name}_h{r_} AS (SELECT feature, l.f, cut, y, coalesce(sum(w) FILTER (v <= cut), 0) AS a, sum(w) AS t FROM {name}_l{r_} l JOIN {name}_c c ON l.f = c.f GROUP BY ALL),
{name}_g{r_} AS (SELECT feature, f, cut, sum(t) AS whole, sum(a * a) / sum(a) + sum((t - a) * (t - a)) / sum(t - a) - sum(t * t) / sum(t) AS gain, max(a) AS ma, max(t - a) AS mb,
                        -max(struct_pack(n := a, c := -y)).c AS lc, -max(struct_pack(n := t - a, c := -y)).c AS rc FROM {name}_h{r_} GROUP BY ALL HAVING sum(a) > 0 AND sum(t - a) > 0),
{name}_b{r_} AS (SELECT *, 1 - (ma + mb) / whole AS e FROM {name}_g{r_} WHERE gain >= (SELECT max(gain) FROM {name}_g{r_}) - 1e-9 * whole ORDER BY f, cut LIMIT 1),
{name}_a{r_} AS (SELECT *, {rate} * (ln((1 - e) / e) + ln({k} - 1)) AS alpha FROM {name}_b{r_}),
{name}_w{r_ + 1} AS (SELECT row_id, {cols}, y, w * exp(CASE WHEN (CASE WHEN v <= cut THEN lc ELSE rc END) <> y THEN alpha ELSE 0 END) AS w
                     FROM (SELECT x.*, l.v, a.cut, a.lc, a.rc, a.alpha FROM {name}_w{r_} x JOIN {name}_l{r_} l ON x.row_id = l.row_id JOIN {name}_a{r_} a ON l.f = a.f))"""
        return out

    shown = " UNION ALL ".join(
        f"SELECT CAST({k} AS INTEGER) AS classes, CAST({i} AS INTEGER) AS round, feature, {r('cut')} AS threshold, CAST(lc AS INTEGER) AS left_class, CAST(rc AS INTEGER) AS right_class, "
        f"{r('e')} AS error, {r('alpha')} AS alpha FROM {n}_a{i}" for n, k in (("two", 2), ("three", 3)) for i in range(1, rounds + 1))
    return with_fixtures("," + chain("two", 2, f"SELECT row_id, {cols}, big AS y, 1.0::DOUBLE AS w FROM line_bin") + ","
                         + chain("three", 3, f"SELECT row_id, {cols}, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS y, 1.0::DOUBLE AS w FROM line_multi") + shown, "line_bin", "line_multi")


ORACLE["model_ada_rounds"] = _ada_sql()
# the test part is ceil(0.2 n) rows, and a model that is kept and loaded gives every one the same shares
ORACLE["rlt_saved"] = "SELECT CAST(ceil(0.2 * count(*)) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM lineitem"
ORACLE["prep_label_wide"] = "SELECT p_partkey, p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS label FROM part"
ORACLE["prep_onehot_wide"] = """
WITH c AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS code FROM orders)
SELECT o_orderkey, (SELECT max(code) FROM c) AS size, CASE WHEN code > 0 THEN code - 1 END AS hot_index, CAST(code > 0 AS BIGINT) AS n_hot FROM c"""
