"""SQL building blocks: the same tables, panel and features as common table expressions."""

from __future__ import annotations

PANEL = """
panel AS (
  SELECT CAST(l_shipdate AS DATE) AS period, n_name AS respondent,
         n_nationkey AS nationkey, n_regionkey AS regionkey,
         ROUND(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) / 100) AS demand,
         ROUND(SUM(CAST(ROUND(l_quantity * 100) AS BIGINT)
                   * CAST(ROUND(p_retailprice * 100) AS BIGINT)) / 10000) AS demand_forecast,
         ROUND(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)
                   * (100 - CAST(ROUND(l_discount * 100) AS BIGINT))) / 10000) AS net_generation,
         ROUND(SUM(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END
                   * CAST(ROUND(l_extendedprice * 100) AS BIGINT)) / 100) AS interchange
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2, 3, 4
)"""

OBS = (
    PANEL
    + """,
obs AS (
  SELECT period, respondent, LOWER(respondent) AS respondent_name, type, LOWER(type) AS type_name,
         value, 'currency' AS value_units, 'UTC' AS timezone
  FROM (
    SELECT period, respondent, 'D' AS type, demand AS value FROM panel
    UNION ALL SELECT period, respondent, 'DF', demand_forecast FROM panel
    UNION ALL SELECT period, respondent, 'NG', net_generation FROM panel
    UNION ALL SELECT period, respondent, 'TI', interchange FROM panel
  )
)"""
)

REGION_OBS = (
    PANEL
    + """,
both_levels AS (
  SELECT period, respondent, demand, demand_forecast, net_generation, interchange FROM panel
  UNION ALL
  SELECT period, r_name, SUM(demand), SUM(demand_forecast), SUM(net_generation), SUM(interchange)
  FROM panel JOIN region ON regionkey = r_regionkey GROUP BY 1, 2
),
obs AS (
  SELECT period, respondent, LOWER(respondent) AS respondent_name, type, value
  FROM (
    SELECT period, respondent, 'D' AS type, demand AS value FROM both_levels
    UNION ALL SELECT period, respondent, 'DF', demand_forecast FROM both_levels
    UNION ALL SELECT period, respondent, 'NG', net_generation FROM both_levels
    UNION ALL SELECT period, respondent, 'TI', interchange FROM both_levels
  )
)"""
)

COVERAGE = (
    REGION_OBS
    + """,
span AS (SELECT MAX(period) - MIN(period) + 1 AS days FROM obs),
coverage AS (
  SELECT respondent, MIN(respondent_name) AS name, COUNT(DISTINCT period) AS days,
         MIN(period) AS first_day, MAX(period) AS last_day,
         CAST(COUNT(*) FILTER (WHERE value IS NULL) AS BIGINT) AS n_missing,
         ROUND(COUNT(DISTINCT period) / (SELECT days FROM span) * 100, 2) AS coverage_pct,
         GREATEST(MAX(period) - MIN(period) + 1 - COUNT(DISTINCT period), 0) AS interior_gaps,
         CASE WHEN respondent IN (SELECT r_name FROM region) THEN 'aggregate'
              ELSE 'balancing_authority' END AS role
  FROM obs WHERE type = 'D' GROUP BY respondent
)"""
)

DAILY = (
    PANEL
    + """,
days AS (
  SELECT respondent, CAST(UNNEST(GENERATE_SERIES(MIN(period), MAX(period), INTERVAL 1 DAY)) AS DATE) AS period
  FROM panel GROUP BY respondent
),
daily AS (
  SELECT d.respondent, d.period, demand, demand_forecast, net_generation, interchange
  FROM days d LEFT JOIN panel p ON d.respondent = p.respondent AND d.period = p.period
)"""
)

TIER_CASE = "CASE WHEN n_nationkey <= 5 THEN 'Large' WHEN n_nationkey <= 15 THEN 'Medium' ELSE 'Small' END"

# Holidays as dates generated per year, then looked up.
HOLIDAYS = """
years AS (
  SELECT UNNEST(RANGE(CAST(a AS BIGINT) - 1, CAST(b AS BIGINT) + 2)) AS y FROM holiday_range
),
floating AS (
  SELECT y, holiday, DATE_TRUNC('month', MAKE_DATE(y, m, 1)) AS first_day, wd, nth
  FROM years, (VALUES ('martin_luther_king_day', 1, 0, 3), ('washingtons_birthday', 2, 0, 3),
                      ('labor_day', 9, 0, 1), ('columbus_day', 10, 0, 2),
                      ('thanksgiving_day', 11, 3, 4)) AS rule(holiday, m, wd, nth)
),
fixed_days AS (
  SELECT holiday, MAKE_DATE(y, m, d) AS day
  FROM years, (VALUES ('new_years_day', 1, 1), ('juneteenth', 6, 19), ('independence_day', 7, 4),
                      ('veterans_day', 11, 11), ('christmas_day', 12, 25)) AS rule(holiday, m, d)
),
holidays AS (
  SELECT holiday,
         CAST(first_day + INTERVAL 1 DAY * CAST((wd - (ISODOW(first_day) - 1) + 7) % 7 + 7 * (nth - 1) AS INTEGER) AS DATE) AS day
  FROM floating
  UNION ALL
  SELECT 'memorial_day', CAST(MAKE_DATE(y, 5, 31) - INTERVAL 1 DAY * CAST(ISODOW(MAKE_DATE(y, 5, 31)) - 1 AS INTEGER) AS DATE)
  FROM years
  UNION ALL
  SELECT holiday, CASE ISODOW(day) WHEN 6 THEN day - 1 WHEN 7 THEN day + 1 ELSE day END FROM fixed_days
)"""


def holiday_flags(day: str) -> str:
    def hit(offset: str) -> str:
        return f"({day} {offset}) IN (SELECT day FROM holidays)"

    friday, monday = f"ISODOW({day}) = 5", f"ISODOW({day}) = 1"
    return f"""
    CAST({hit('+ 0')} AS INTEGER) AS is_holiday,
    CAST({hit('+ 1')} AS INTEGER) AS is_day_before_holiday,
    CAST({hit('- 1')} AS INTEGER) AS is_day_after_holiday,
    CAST(({friday} AND {hit('+ 3')}) OR ({monday} AND {hit('- 3')})
      OR ({friday} AND {hit('- 1')}) OR ({monday} AND {hit('+ 1')}) AS INTEGER) AS is_bridge_day"""


def lags(column: str, ks: list[int], prefix: str) -> str:
    return ",\n".join(f"LAG({column}, {k}) OVER w AS {prefix}_lag_{k}" for k in ks)


def rolling(fn: str, name: str, days: int, least: int, digits: int, arguments: str = "demand") -> str:
    frame = f"(PARTITION BY respondent ORDER BY period ROWS BETWEEN {days - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"CASE WHEN COUNT(demand) OVER {frame} >= {least} "
        f"THEN ROUND({fn}({arguments}) OVER {frame}, {digits}) END AS {name}"
    )


DAY_NUMBER = "CAST(DATEDIFF('day', DATE '1970-01-01', period) AS DOUBLE)"
ROLLING = ",\n".join(
    [
        rolling("AVG", "demand_rolling_mean_7", 7, 4, 4),
        rolling("STDDEV_SAMP", "demand_rolling_std_7", 7, 4, 2),
        rolling("AVG", "demand_rolling_mean_14", 14, 7, 4),
        rolling("AVG", "demand_rolling_mean_30", 30, 15, 4),
        rolling("STDDEV_SAMP", "demand_rolling_std_30", 30, 15, 2),
    ]
)
TRENDS = ",\n".join(
    rolling("REGR_SLOPE", f"demand_trend_{k}", k, k, 2, f"demand, {DAY_NUMBER}") for k in (7, 30)
)
CALENDAR = """
    CAST(ISODOW(target_date) - 1 AS INTEGER) AS target_dayofweek,
    CAST(ISODOW(target_date) >= 6 AS INTEGER) AS target_is_weekend,
    CAST(MONTH(target_date) AS INTEGER) AS target_month,
    CAST(DAYOFYEAR(target_date) AS INTEGER) AS target_dayofyear"""
CYCLICAL = """
    ROUND(SIN(2 * PI() * (ISODOW(target_date) - 1) / 7.0), 6) AS sin_dayofweek,
    ROUND(COS(2 * PI() * (ISODOW(target_date) - 1) / 7.0), 6) AS cos_dayofweek,
    ROUND(SIN(2 * PI() * DAYOFYEAR(target_date) / CAST(365.25 AS DOUBLE)), 6) AS sin_dayofyear,
    ROUND(COS(2 * PI() * DAYOFYEAR(target_date) / CAST(365.25 AS DOUBLE)), 6) AS cos_dayofyear"""

# The columns most queries need; the whole matrix is FEATURE_MATRIX.
FEATURES = (
    DAILY
    + f""",
tiers AS (SELECT n_name AS respondent, {TIER_CASE} AS tier FROM nation),
shifted AS (
  SELECT period, respondent, demand,
         LEAD(demand) OVER w AS target, LEAD(demand_forecast) OVER w AS benchmark_forecast,
         demand AS naive_persistence, demand AS demand_t,
         LAG(demand, 6) OVER w AS demand_lag_6, LAG(demand, 1) OVER w AS demand_lag_1
  FROM daily WINDOW w AS (PARTITION BY respondent ORDER BY period)
),
features AS (
  SELECT period AS forecast_date, period + 1 AS target_date, s.respondent, tier, target, benchmark_forecast,
         naive_persistence, demand_t, demand_lag_1, demand_lag_6, (demand_t + demand_lag_6) / 2 AS prediction
  FROM shifted s JOIN tiers t ON s.respondent = t.respondent
  WHERE target IS NOT NULL
)"""
)

SPLITS = (
    FEATURES
    + """,
dates AS (SELECT target_date AS d, ROW_NUMBER() OVER (ORDER BY target_date) AS i, COUNT(*) OVER () AS n
          FROM (SELECT DISTINCT target_date FROM features)),
cuts AS (
  SELECT MAX(d) FILTER (WHERE i <= FLOOR(CAST(n AS DOUBLE) * CAST(0.70 AS DOUBLE))) AS train_end,
         MAX(d) FILTER (WHERE i <= FLOOR(CAST(n AS DOUBLE) * (CAST(0.70 AS DOUBLE) + CAST(0.15 AS DOUBLE)))) AS val_end
  FROM dates
),
split_features AS (
  SELECT f.*, CASE WHEN target_date <= train_end THEN 'train' WHEN target_date <= val_end THEN 'val' ELSE 'test' END AS split
  FROM features f, cuts
)"""
)

FALLBACK = (
    SPLITS
    + """,
by_lag AS (SELECT * REPLACE (demand_lag_6 AS prediction) FROM split_features),
guard AS (
  SELECT tier, respondent, AVG(ABS(target - prediction)) AS model_mae, AVG(ABS(target - naive_persistence)) AS naive_mae
  FROM by_lag WHERE split = 'val' AND prediction IS NOT NULL AND naive_persistence IS NOT NULL
  GROUP BY 1, 2
),
scored AS (
  SELECT f.* REPLACE (CASE WHEN g.respondent IS NOT NULL THEN naive_persistence ELSE prediction END AS prediction)
  FROM by_lag f
  LEFT JOIN (SELECT respondent FROM guard WHERE model_mae > naive_mae) g ON f.respondent = g.respondent
)"""
)


def metrics(truth: str, prediction: str) -> str:
    y, p = truth, prediction
    ok = f"FILTER (WHERE {y} IS NOT NULL AND {p} IS NOT NULL)"
    return f"""
    ROUND(AVG(ABS({y} - {p})) {ok}, 2) AS mae,
    ROUND(AVG(200.0 * ABS({y} - {p}) / (ABS({y}) + ABS({p}) + 1e-8)) {ok}, 2) AS smape,
    ROUND(100.0 * SUM(ABS({y} - {p})) {ok} / (SUM(ABS({y})) {ok} + 1e-8), 2) AS wmape,
    ROUND(CASE WHEN COUNT(*) {ok} = 0 THEN NULL WHEN COUNT(*) {ok} < 2 THEN 0.0
               WHEN VAR_POP({y}) {ok} > 0
               THEN 1 - SUM(({y} - {p}) * ({y} - {p})) {ok} / (COUNT(*) {ok} * VAR_POP({y}) {ok})
               WHEN SUM(({y} - {p}) * ({y} - {p})) {ok} = 0 THEN 1.0 ELSE 0.0 END, 4) AS r2,
    COUNT(*) {ok} AS n_samples"""


def comparison(source: str, approaches: dict[str, str]) -> str:
    parts = [
        f"""SELECT '{name}' AS approach, CASE WHEN GROUPING(tier) = 1 THEN 'Overall' ELSE tier END AS tier,
        {metrics('target', column)} FROM {source} GROUP BY GROUPING SETS ((tier), ())"""
        for name, column in approaches.items()
    ]
    return "\nUNION ALL\n".join(parts)


WINDOWS = (
    FEATURES
    + """,
bounds AS (SELECT MAX(target_date) - 30 AS split, MAX(target_date) - 120 AS start FROM features),
windowed AS (
  SELECT f.*, CASE WHEN target_date >= split THEN 'current' ELSE 'reference' END AS win
  FROM features f, bounds WHERE target_date >= start
)"""
)


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"
