"""Missing data."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortal.catalog.registry import names_table, query, r, rounded, rs
from cohortal.catalog.views_sql import IMPRESSIONS
from cohortal.operators import missing
from cohortal.sources.views import impressions

GAPPY = ("row_id", "dev_os", "dev_osv", "carrier", "wifi_ratio", "weeks_since_first_seen", "value", "cpm_seen", "brand_encoded")


def gappy(spark, sf_dir):
    """Impression columns with nulls, 'None' texts and one column per strategy."""
    k = F.col("k")
    return impressions(spark, sf_dir).select(
        *GAPPY[:7],
        F.when(k % 4 != 0, F.col("value")).alias("cpm_seen"),
        F.when(k % 13 != 0, k.cast("double")).alias("brand_encoded"),
        F.when(k % 17 != 0, k % 6).alias("zip_code_digit"),
    )


GAPPY_SQL = (
    IMPRESSIONS
    + """,
gappy AS (SELECT row_id, dev_os, dev_osv, carrier, wifi_ratio, weeks_since_first_seen, value,
  CASE WHEN k % 4 <> 0 THEN value END AS cpm_seen,
  CASE WHEN k % 13 <> 0 THEN CAST(k AS DOUBLE) END AS brand_encoded,
  CASE WHEN k % 17 <> 0 THEN k % 6 END AS zip_code_digit FROM imp)"""
)
# Fixed values: (column, Spark type, strategy by name rule or type).
KINDS = (
    ("dev_os", "string", "mode"), ("carrier", "string", "mode"), ("wifi_ratio", "double", "median"),
    ("weeks_since_first_seen", "double", "large_value"), ("cpm_seen", "double", "zero"),
    ("brand_encoded", "double", "special_value"), ("zip_code_digit", "int", "median"),
)
ABSENT = {"dev_os": "dev_os IS NULL OR dev_os = 'None'", "carrier": "carrier IS NULL OR carrier = 'None'"}


def _absent(c: str) -> str:
    return ABSENT.get(c, f"{c} IS NULL")


@query(
    "missing_profile",
    f"WITH {GAPPY_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE {_absent(c)}) AS n_missing,
        round(100.0 * count(*) FILTER (WHERE {_absent(c)}) / count(*), 6) + 0 AS pct_missing, '{kind}' AS dtype FROM gappy"""
        for c, kind, _ in KINDS
    ),
)
def missing_profile(spark, sf_dir):
    return rounded(missing.missing_profile(gappy(spark, sf_dir)))


@query(
    "most_missing",
    f"WITH {GAPPY_SQL}, m AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {_absent(c)}) AS n_missing, count(*) AS n, '{kind}' AS dtype FROM gappy"
        for c, kind, _ in KINDS
    )
    + ") SELECT column_name, n_missing, round(100.0 * n_missing / n, 6) + 0 AS pct_missing, dtype FROM m WHERE n_missing > 0"
    " ORDER BY n_missing DESC, column_name LIMIT 3",
)
def most_missing(spark, sf_dir):
    return rounded(missing.most_missing(gappy(spark, sf_dir), 3))


FILLS_SQL = """fills AS (
  SELECT (SELECT dev_os FROM gappy WHERE dev_os NOT IN ('None', '') GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS dev_os,
    (SELECT carrier FROM gappy WHERE carrier NOT IN ('None', '') GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS carrier,
    (SELECT quantile_cont(wifi_ratio, 0.5) FROM gappy) AS wifi_ratio,
    (SELECT quantile_cont(zip_code_digit, 0.5) FROM gappy) AS zip_code_digit)"""


@query(
    "impute_fit",
    f"""WITH {GAPPY_SQL}, {FILLS_SQL}
    SELECT 'dev_os' AS column_name, 'mode' AS strategy, dev_os AS fill FROM fills
    UNION ALL SELECT 'carrier', 'mode', carrier FROM fills
    UNION ALL SELECT 'wifi_ratio', 'median', CAST(CAST(wifi_ratio AS DOUBLE) AS VARCHAR) FROM fills
    UNION ALL SELECT 'zip_code_digit', 'median', CAST(CAST(zip_code_digit AS DOUBLE) AS VARCHAR) FROM fills
    UNION ALL SELECT 'weeks_since_first_seen', 'large_value', '9999'
    UNION ALL SELECT 'cpm_seen', 'zero', '0' UNION ALL SELECT 'brand_encoded', 'special_value', '-1'""",
)
def impute_fit(spark, sf_dir):
    return missing.fit_imputer(gappy(spark, sf_dir)).table(spark)


@query(
    "impute_apply",
    f"""WITH {GAPPY_SQL}, {FILLS_SQL}
    SELECT g.row_id, coalesce(nullif(g.dev_os, 'None'), f.dev_os) AS dev_os, g.dev_osv,
      coalesce(g.carrier, f.carrier) AS carrier, coalesce(g.wifi_ratio, f.wifi_ratio) AS wifi_ratio,
      coalesce(g.weeks_since_first_seen, 9999) AS weeks_since_first_seen, g.value,
      coalesce(g.cpm_seen, 0) AS cpm_seen, coalesce(g.brand_encoded, -1) AS brand_encoded,
      CAST(coalesce(g.zip_code_digit, f.zip_code_digit) AS DOUBLE) AS zip_code_digit
    FROM gappy g, fills f""",
)
def impute_apply(spark, sf_dir):
    df = gappy(spark, sf_dir)
    filled = missing.apply_imputer(df, missing.fit_imputer(df))
    return filled.withColumn("zip_code_digit", F.col("zip_code_digit").cast("double"))


@query(
    "impute_summary",
    "SELECT strategy, CAST(n AS BIGINT) AS n_columns FROM (VALUES ('mode', 2), ('median', 2), ('large_value', 1), "
    "('zero', 1), ('special_value', 1)) t(strategy, n)",
)
def impute_summary(spark, sf_dir):
    return missing.fit_imputer(gappy(spark, sf_dir)).summary(spark)


@query(
    "missing_indicators",
    f"""WITH {GAPPY_SQL} SELECT row_id, """
    + ", ".join(
        f"CAST({c} IS NULL AS INTEGER) AS {c}_is_missing"
        for c in ("carrier", "wifi_ratio", "weeks_since_first_seen", "cpm_seen", "brand_encoded", "zip_code_digit")
    )
    + " FROM gappy",
)
def missing_indicators(spark, sf_dir):
    df = gappy(spark, sf_dir)
    columns = missing.fit_indicators(df, 0.05)
    return missing.add_indicators(df, columns).select("row_id", *[f"{c}_is_missing" for c in columns])


GAPPY_COLUMNS = [*GAPPY, "zip_code_digit"]
NULLS = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in GAPPY_COLUMNS)
WITH_NULLS = " + ".join(f"CAST(count(*) > count({c}) AS BIGINT)" for c in GAPPY_COLUMNS)


@query(
    "missing_summary",
    f"""WITH {GAPPY_SQL} SELECT count(*) AS n_rows, {len(GAPPY_COLUMNS)}::BIGINT AS n_columns,
      count(*) * {len(GAPPY_COLUMNS)} AS total_cells, {NULLS} AS missing_cells,
      {r(f"100.0 * ({NULLS}) / (count(*) * {len(GAPPY_COLUMNS)})", 'missing_pct')},
      {WITH_NULLS} AS columns_with_missing FROM gappy""",
)
def missing_summary(spark, sf_dir):
    return rounded(missing.missing_summary(gappy(spark, sf_dir)))


@query(
    "sparse_columns",
    f"""WITH {GAPPY_SQL}, shares AS ("""
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, 1 - count({c}) / count(*) AS s FROM gappy" for c in GAPPY_COLUMNS)
    + ") SELECT column_name FROM shares WHERE s > 0.15",
)
def sparse_columns(spark, sf_dir):
    return names_table(spark, missing.sparse_columns(gappy(spark, sf_dir), 0.15), "column_name")


@query(
    "all_null_drop",
    f"""WITH {IMPRESSIONS} SELECT row_id, carrier, value FROM imp""",
)
def all_null_drop(spark, sf_dir):
    df = impressions(spark, sf_dir).select("row_id", "carrier", "value")
    return missing.drop_all_null(df.withColumn("empty", F.when(F.col("value") < 0, F.col("value"))))


@query(
    "constant_fill",
    f"""WITH {IMPRESSIONS} SELECT row_id, coalesce(carrier, 'UNK') AS carrier, country FROM imp""",
)
def constant_fill(spark, sf_dir):
    df = impressions(spark, sf_dir).select("row_id", "carrier", "country")
    return missing.fill_categories(df, ["carrier", "country", "absent"])


@query(
    "matrix_align",
    f"""WITH {IMPRESSIONS} SELECT row_id, coalesce(wifi_ratio, 0) AS wifi_ratio, 0::DOUBLE AS never_seen,
      coalesce(weeks_since_first_seen, 0) AS weeks_since_first_seen, CAST(hour AS DOUBLE) AS hour FROM imp""",
)
def matrix_align(spark, sf_dir):
    wanted = ["wifi_ratio", "never_seen", "weeks_since_first_seen", "hour"]
    return missing.align_matrix(impressions(spark, sf_dir), wanted, keep=["row_id"])
