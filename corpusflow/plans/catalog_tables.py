"""Registered table queries: coercion, pruning, profiles, labels.

``loans`` is an all-text table derived from the whole of ``lineitem``, with the
dirt the cleaning steps are for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators import cleaning, labels, profile, sketches
from corpusflow.plans.registry import query
from corpusflow.session import scratch_path
from corpusflow.sources.tables import table, table_columns

EMPLOYMENT = {
    1: "< 1 year", 2: "1 year", 3: "2 years", 4: "5 years", 5: "10+ years", 6: "n/a", 7: "9 years",
}


def loans(spark, folder) -> DataFrame:
    item = table_columns(
        spark, folder, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount", "l_tax",
        "l_quantity", "l_linenumber",
    )
    percent = F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%"))
    years = F.create_map(*[F.lit(v) for pair in EMPLOYMENT.items() for v in pair])
    return item.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_suppkey").cast("string").alias("id"),
        F.col("l_returnflag").alias("grade"),
        F.col("l_linestatus").alias("loan_status"),
        F.when(F.col("l_tax") == 0, "none").otherwise(percent).alias("int_rate"),
        F.when(F.col("l_returnflag") == "A", "none").otherwise(percent).alias("some_rate"),
        F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(" months")).alias("term"),
        years[F.col("l_linenumber")].alias("emp_length"),
        F.when(F.col("l_tax") == 0, "n/a").otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".5"))).alias("amount"),
        F.when(F.col("l_returnflag") == "A", F.col("l_linestatus")).alias("note"),
        F.lit("fixed").alias("purpose"),
        F.col("l_linestatus").alias("desc"),
    )


LOANS_SQL = """
loans AS (SELECT l_orderkey AS order_key, l_suppkey::VARCHAR AS id, l_returnflag AS grade, l_linestatus AS loan_status,
  CASE WHEN l_tax = 0 THEN 'none' ELSE round(l_discount * 100)::INT || '%' END AS int_rate,
  CASE WHEN l_returnflag = 'A' THEN 'none' ELSE round(l_discount * 100)::INT || '%' END AS some_rate,
  ' ' || l_quantity::INT || ' months' AS term,
  CASE l_linenumber WHEN 1 THEN '< 1 year' WHEN 2 THEN '1 year' WHEN 3 THEN '2 years' WHEN 4 THEN '5 years'
    WHEN 5 THEN '10+ years' WHEN 6 THEN 'n/a' WHEN 7 THEN '9 years' END AS emp_length,
  CASE WHEN l_tax = 0 THEN 'n/a' ELSE l_quantity::INT || '.5' END AS amount,
  CASE WHEN l_returnflag = 'A' THEN l_linestatus END AS note, 'fixed' AS purpose, l_linestatus AS "desc"
  FROM lineitem)
"""
YEARS_SQL = """CASE emp_length WHEN '< 1 year' THEN 0 WHEN '1 year' THEN 1 WHEN '2 years' THEN 2 WHEN '5 years' THEN 5
  WHEN '9 years' THEN 9 WHEN '10+ years' THEN 10 END::DOUBLE"""


def gappy_orders(spark, folder) -> DataFrame:
    """Orders with NULLs made out of one status and one priority, and a constant column."""
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
        F.lit("web").alias("channel"),
        F.when(F.col("o_orderpriority") != "1-URGENT", "std").alias("handling"),
    )


GAPPY_SQL = """
gappy AS (SELECT o_orderkey, o_totalprice, nullif(o_orderstatus, 'P') AS status,
  nullif(o_orderpriority, '5-LOW') AS priority, 'web' AS channel,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN 'std' END AS handling FROM orders)
"""


@query(
    f"""WITH {LOANS_SQL} SELECT order_key, TRY_CAST(rtrim(int_rate, '%') AS DOUBLE) AS int_rate, some_rate
    FROM loans"""
)
def parse_percent(spark, folder):
    """int_rate is mostly percentages and becomes a number; some_rate stays text."""
    return cleaning.parse_percent(loans(spark, folder).select("order_key", "int_rate", "some_rate"))


@query(f"WITH {LOANS_SQL} SELECT order_key, {YEARS_SQL} AS emp_length FROM loans")
def map_emp_length(spark, folder):
    return cleaning.map_employment(loans(spark, folder).select("order_key", "emp_length"))


@query(f"WITH {LOANS_SQL} SELECT order_key, TRY_CAST(regexp_extract(trim(term), '([0-9]+)', 1) AS DOUBLE) AS term FROM loans")
def parse_term(spark, folder):
    return cleaning.parse_term(loans(spark, folder).select("order_key", "term"))


@query(f"WITH {LOANS_SQL} SELECT order_key, TRY_CAST(amount AS DOUBLE) AS amount, some_rate FROM loans")
def coerce_numeric(spark, folder):
    return cleaning.coerce_numeric(loans(spark, folder).select("order_key", "amount", "some_rate"))


DUPLICATE_COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


@query(f"SELECT DISTINCT {', '.join(DUPLICATE_COLUMNS)} FROM lineitem")
def drop_duplicates(spark, folder):
    return cleaning.drop_duplicates(table(spark, folder, "lineitem").select(*DUPLICATE_COLUMNS))


@query("SELECT DISTINCT * FROM lineitem")
def drop_duplicate_rows(spark, folder):
    """Whole rows: the table twice, with every copy removed."""
    rows = table(spark, folder, "lineitem")
    return cleaning.drop_duplicates(rows.unionAll(rows))


@query(
    f"""WITH d AS (SELECT DISTINCT {', '.join(DUPLICATE_COLUMNS)} FROM lineitem)
    SELECT (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) FROM d) AS n_distinct,
           (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM d) AS n_duplicates"""
)
def duplicate_count(spark, folder):
    return cleaning.duplicate_count(table(spark, folder, "lineitem").select(*DUPLICATE_COLUMNS))


@query(f"WITH {GAPPY_SQL} SELECT o_orderkey, o_totalprice, priority, channel, handling FROM gappy")
def drop_high_missing(spark, folder):
    """A third of ``status`` is NULL, so it is dropped; a fifth of ``priority`` is, so it stays."""
    return cleaning.drop_high_missing(gappy_orders(spark, folder))


@query(f"WITH {GAPPY_SQL} SELECT o_orderkey, o_totalprice, status, priority, handling FROM gappy")
def drop_single_valued(spark, folder):
    """``channel`` is constant; ``handling`` has one value and NULL, which makes two."""
    return cleaning.drop_single_valued(gappy_orders(spark, folder))


@query(
    f"""WITH {GAPPY_SQL}, n AS (SELECT count(*) AS rows, count(*) - count(status) AS s, count(*) - count(priority) AS p,
      count(*) - count(handling) AS h FROM gappy),
    l AS (SELECT 'status' AS "column", s AS n_missing, rows FROM n UNION ALL SELECT 'priority', p, rows FROM n
      UNION ALL SELECT 'handling', h, rows FROM n)
    SELECT "column", n_missing, round(n_missing / rows * 100, 2) AS missing_rate,
      CASE WHEN n_missing / rows * 100 > 10 THEN 'red' WHEN n_missing / rows * 100 > 5 THEN 'orange' ELSE 'green' END AS severity
    FROM l WHERE n_missing > 0"""
)
def missing_report(spark, folder):
    return profile.missing_report(gappy_orders(spark, folder)).orderBy(F.desc("n_missing"), "column")


@query(
    f"WITH {GAPPY_SQL}, n AS (SELECT count(*) AS rows FROM gappy) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n_present, round(count({c}) / any_value(rows), 6) AS present_share,
        round(1 - count({c}) / any_value(rows), 6) AS null_rate FROM gappy, n"""
        for c in ["o_orderkey", "o_totalprice", "status", "priority", "channel", "handling"]
    )
)
def completeness(spark, folder):
    chart = profile.completeness(gappy_orders(spark, folder))
    return chart.select(
        "column", "n_present", F.round("present_share", 6).alias("present_share"), F.round("null_rate", 6).alias("null_rate")
    ).orderBy("null_rate", "column")


LINEITEM_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]
LINEITEM_NUMBERS = LINEITEM_COLUMNS[:8]


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CASE WHEN count(DISTINCT {c}) > 10 THEN 'continuous' ELSE 'categorical' END AS class FROM lineitem"""
        if c in LINEITEM_NUMBERS
        else f"""SELECT '{c}' AS "column", 'categorical' AS class"""
        for c in LINEITEM_COLUMNS
    )
)
def column_classes(spark, folder):
    return profile.column_classes(table(spark, folder, "lineitem"))


@query(
    "WITH filled AS ("
    + " UNION ALL ".join(f"""SELECT '{c}' AS column_name, count({c}) AS n_values FROM lineitem""" for c in LINEITEM_COLUMNS)
    + """) SELECT column_name AS "column", CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
      WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp' END AS dtype, ordinal_position - 1 AS position, n_values
    FROM information_schema.columns JOIN filled USING (column_name) WHERE table_name = 'lineitem'"""
)
def column_schema(spark, folder):
    """Type, place and number of values of every column; the counts come from one pass over the table."""
    rows = table(spark, folder, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    filled = profile.completeness(rows).select("column", F.col("n_present").alias("n_values"))
    return profile.column_schema(rows).join(filled, "column")


def _duck_type(column: str) -> str:
    if column in ("l_orderkey", "l_partkey", "l_suppkey"):
        return "bigint"
    return "int" if column == "l_linenumber" else "double"


@query(
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{_duck_type(c)}' AS dtype, count({c}) AS count, round(1 - count({c}) / count(*), 4) AS null_rate,
        round(round(avg({c}), 11), 6) AS mean, round(round(stddev_samp({c}), 11), 6) AS std, min({c})::DOUBLE AS min, quantile_cont({c}::DOUBLE, 0.25) AS q25,
        quantile_cont({c}::DOUBLE, 0.5) AS q50, quantile_cont({c}::DOUBLE, 0.75) AS q75, max({c})::DOUBLE AS max
        FROM lineitem HAVING count(DISTINCT {c}) > 10"""
        for c in LINEITEM_NUMBERS
    )
    + ")"
)
def profile_continuous(spark, folder):
    report = profile.profile_continuous(table_columns(spark, folder, "lineitem"))
    return report.withColumns({q: F.round(q, 6) for q in ("q25", "q50", "q75")})


CATEGORICAL_TYPES = {"l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp"}


@query(
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT "column", dtype, count, null_rate, n_unique, top_value, round(n / count, 4) AS top_freq FROM (
        SELECT '{c}' AS "column", '{CATEGORICAL_TYPES.get(c) or _duck_type(c)}' AS dtype, sum(n)::BIGINT AS count,
          0.0::DOUBLE AS null_rate, count(*) AS n_unique, arg_min(v, (-n, v)) AS top_value, max(n) AS n
        FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM lineitem GROUP BY 1)) WHERE {'n_unique <= 10' if c in LINEITEM_NUMBERS else 'true'}"""
        for c in LINEITEM_COLUMNS
    )
    + ")"
)
def profile_categorical(spark, folder):
    items = table_columns(spark, folder, "lineitem")
    return profile.profile_categorical(items.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")))


@query("SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL")
def unique_values(spark, folder):
    return profile.unique_values(table(spark, folder, "customer"), "c_mktsegment")


GOOD, BAD = ["F"], ["P"]


@query(
    """SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS target
    FROM orders WHERE o_orderstatus IN ('F', 'P')"""
)
def label_good_bad(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return labels.label_rows(orders, "o_orderstatus", GOOD, BAD)


@query(
    """SELECT count(*) AS n_total, count(*) FILTER (o_orderstatus = 'F') AS n_good, count(*) FILTER (o_orderstatus = 'P') AS n_bad,
      round(count(*) FILTER (o_orderstatus = 'F') / count(*) * 100, 2) AS good_ratio,
      round(count(*) FILTER (o_orderstatus = 'P') / count(*) * 100, 2) AS bad_ratio
    FROM orders WHERE o_orderstatus IN ('F', 'P')"""
)
def label_summary(spark, folder):
    return labels.label_summary(table(spark, folder, "orders"), "o_orderstatus", GOOD, BAD)


def labelled_orders(spark, folder) -> DataFrame:
    orders = labels.label_rows(table(spark, folder, "orders"), "o_orderstatus", GOOD, BAD)
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        "target", "o_totalprice", "c_acctbal", "o_orderpriority", "c_mktsegment"
    )


LABELLED_SQL = """
lab AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS target, o_totalprice, c_acctbal, o_orderpriority, c_mktsegment
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'P')),
num AS (SELECT 'o_totalprice' AS "column", target, o_totalprice AS value FROM lab
  UNION ALL SELECT 'c_acctbal', target, c_acctbal FROM lab),
txt AS (SELECT 'o_orderpriority' AS "column", target, o_orderpriority AS value FROM lab
  UNION ALL SELECT 'c_mktsegment', target, c_mktsegment FROM lab)
"""
NUMERIC = ["o_totalprice", "c_acctbal"]
TEXTUAL = ["o_orderpriority", "c_mktsegment"]


@query(
    f"""WITH {LABELLED_SQL} SELECT "column", round(count(value) / count(*) * 100, 2) AS valid_rate,
      round(avg(value) FILTER (target = 0), 2) AS good_mean, round(avg(value) FILTER (target = 1), 2) AS bad_mean,
      round(stddev_samp(value) FILTER (target = 0), 2) AS good_std, round(stddev_samp(value) FILTER (target = 1), 2) AS bad_std
    FROM num GROUP BY "column" """
)
def numeric_by_class(spark, folder):
    return labels.numeric_by_class(labelled_orders(spark, folder), NUMERIC)


@query(
    f"""WITH {LABELLED_SQL},
    r AS (SELECT "column", target, count(*) AS n, min(value) AS lo, max(value) AS hi FROM num GROUP BY ALL),
    b AS (SELECT *, least(50, greatest(10, floor(sqrt(sum(n) OVER (PARTITION BY "column")))))::INT AS bins FROM r)
    SELECT "column", target, least(floor((value - lo) / (hi - lo) * bins)::INT, bins - 1) AS bin, count(*) AS n,
      round(lo + least(floor((value - lo) / (hi - lo) * bins)::INT, bins - 1) * ((hi - lo) / bins), 6) AS bin_start
    FROM num JOIN b USING ("column", target) GROUP BY "column", target, bin, bin_start"""
)
def histogram_by_class(spark, folder):
    return labels.histogram_by_class(labelled_orders(spark, folder), NUMERIC)


@query(
    f"""WITH {LABELLED_SQL}, c AS (SELECT "column", value, count(*) AS bin_count, sum(target)::BIGINT AS bad_count FROM txt GROUP BY ALL)
    SELECT "column", value, bin_count, bad_count, round(bin_count / sum(bin_count) OVER (PARTITION BY "column"), 6) AS bin_rate,
      round(bad_count / bin_count, 6) AS bad_rate FROM c"""
)
def bad_rate_by_category(spark, folder):
    rates = labels.bad_rate_by_category(labelled_orders(spark, folder), TEXTUAL)
    return rates.select(
        "column", "value", "bin_count", "bad_count", F.round("bin_rate", 6).alias("bin_rate"), F.round("bad_rate", 6).alias("bad_rate")
    ).orderBy("column", F.desc("bad_rate"), "value")


CONTINUOUS_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]


@query(
    " UNION ALL ".join(
        f"""(WITH b AS (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS median, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {t})
        SELECT '{c}' AS "column", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
          min({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))::DOUBLE AS whisker_low,
          max({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))::DOUBLE AS whisker_high,
          count(*) FILTER ({c} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
        FROM {t}, b GROUP BY q1, median, q3)"""
        for c, t in [(c, "lineitem") for c in CONTINUOUS_COLUMNS]
    )
)
def boxplot_stats(spark, folder):
    boxes = profile.boxplot_stats(table_columns(spark, folder, "lineitem", *CONTINUOUS_COLUMNS), CONTINUOUS_COLUMNS)
    return boxes.withColumns({q: F.round(q, 6) for q in ("q1", "median", "q3")})


@query(
    f"""WITH {LOANS_SQL}, d AS (SELECT DISTINCT id, grade, loan_status, int_rate, some_rate, term, emp_length, amount, note, purpose, "desc" FROM loans)
    SELECT grade, loan_status, TRY_CAST(rtrim(int_rate, '%') AS DOUBLE) AS int_rate, some_rate,
      TRY_CAST(regexp_extract(trim(term), '([0-9]+)', 1) AS DOUBLE) AS term, {YEARS_SQL} AS emp_length,
      TRY_CAST(amount AS DOUBLE) AS amount FROM d"""
)
def cleaned_loans(spark, folder):
    """The whole cleaning: id and text columns, a two-thirds empty and a constant column go."""
    return cleaning.clean(loans(spark, folder).drop("order_key"))


@query(
    f"""WITH {LOANS_SQL}, d AS (SELECT DISTINCT id, grade, loan_status, int_rate, some_rate, term, emp_length, amount, note, purpose, "desc" FROM loans)
    SELECT (SELECT count(*) FROM loans) AS n_raw_rows, (SELECT count(*) FROM d) AS n_clean_rows, 11 AS n_raw_cols,
      7 AS n_clean_cols, 4 AS n_dropped_cols,
      (SELECT (count(DISTINCT int_rate) > 11)::INT + (count(DISTINCT term) > 10)::INT + (count(DISTINCT amount) > 11)::INT FROM d) AS n_continuous,
      7 - (SELECT (count(DISTINCT int_rate) > 11)::INT + (count(DISTINCT term) > 10)::INT + (count(DISTINCT amount) > 11)::INT FROM d) AS n_categorical,
      3 AS n_missing_cols"""
)
def cleaning_summary(spark, folder):
    raw = loans(spark, folder).drop("order_key")
    return profile.cleaning_summary(raw, cleaning.clean(raw))


@query(
    f"""WITH {LOANS_SQL}, d AS (SELECT DISTINCT id, grade, loan_status, int_rate, some_rate, term, emp_length, amount, note, purpose, "desc" FROM loans),
    s AS (SELECT count(*) AS n, count(*) FILTER (loan_status = 'F') AS g, count(*) FILTER (loan_status = 'O') AS b FROM d)
    SELECT format('数据清洗完成：原始 {{:,}} 行 11 列 → 清洗后 {{:,}} 行 7 列（删除 4 列）。好坏样本分析：{{:,}} 个有效样本中，'
      '好样本(M0) {{:,}}（{{}}%），坏样本(M1+) {{:,}}（{{}}%）。已生成 3 张连续特征分布图 + 3 张类别特征分布图。',
      (SELECT count(*) FROM loans), n, n, g, round(g / n * 100, 2), b, round(b / n * 100, 2)) AS summary FROM s"""
)
def run_summary(spark, folder):
    raw = loans(spark, folder).drop("order_key")
    cleaned = cleaning.clean(raw)
    labelled = labels.label_summary(cleaned, "loan_status", ["F"], ["O"])
    features = cleaned.drop("loan_status")
    continuous, categorical = profile.column_types(features)
    return labels.run_summary(profile.cleaning_summary(raw, cleaned), labelled, len(continuous), len(categorical))


SKETCHED = ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"]
SKETCH_SHARES = [0.01, 0.25, 0.5, 0.75, 0.95, 0.99]


@query(
    " UNION ALL ".join(
        f"""(SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high,
          round(avg({c}), 4) AS mean, TRUE AS ranks_hold, TRUE AS distinct_holds FROM lineitem)"""
        for c in SKETCHED
    )
)
def profile_incremental(spark, folder):
    """A profile merged from the sketches of three batches, and whether it keeps its bounds against the whole table."""
    rows = table_columns(spark, folder, "lineitem", "l_returnflag", *SKETCHED)
    store = sketches.ProfileStore(spark, scratch_path(spark, "profile"))
    for batch, flag in enumerate(["A", "N", "R"]):
        store.add(batch, rows.filter(F.col("l_returnflag") == flag), SKETCHED)
    report = {r.column: r for r in store.report(SKETCH_SHARES).collect()}  # one row per column
    checks = []
    for c in SKETCHED:
        n, held = F.count(c), report[c]
        ranks = F.lit(True)
        for share, q in zip(SKETCH_SHARES, held.quantiles):
            below, upto = F.count_if(F.col(c) < q) / n, F.count_if(F.col(c) <= q) / n
            ranks = ranks & (below - sketches.RANK_ERROR <= share) & (upto + sketches.RANK_ERROR >= share)
        distinct = F.count_distinct(c)
        near = F.abs(distinct - held.n_distinct) <= F.greatest(F.lit(1.0), distinct * sketches.DISTINCT_ERROR)
        checks.append(F.struct(F.lit(c).alias("column"), ranks.alias("ranks_hold"), near.alias("distinct_holds")))
    checked = rows.agg(F.array(*checks).alias("all")).select(F.inline("all"))
    exact = store.report(SKETCH_SHARES).select("column", "rows", "missing", "low", "high", F.round("mean", 4).alias("mean"))
    return exact.join(checked, "column")
