"""Ready-made statements for the ad hoc SQL surface.

Rates are written with the double literal ``100e0``: a plain ``100.0`` is a
decimal in Spark. Ties in a ranking are broken by name.
"""

from __future__ import annotations

RATE = "round(100e0 * sum({0}TARGET) / count(*), 2) AS default_rate_pct"

EXAMPLE_QUERIES = {
    "Portfolio Default Rate": f"""
SELECT count(*) AS total_borrowers, sum(TARGET) AS total_defaults, {RATE.format('')}
FROM applications""",
    "Default Rate by Gender": f"""
SELECT CODE_GENDER, count(*) AS count, {RATE.format('')}
FROM applications
WHERE CODE_GENDER <> 'XNA'
GROUP BY CODE_GENDER
ORDER BY default_rate_pct DESC, CODE_GENDER""",
    "Top 10 Income Types by Default Rate": f"""
SELECT NAME_INCOME_TYPE, count(*) AS borrower_count, round(avg(AMT_INCOME_TOTAL), 0) AS avg_income,
  {RATE.format('')}
FROM applications
GROUP BY NAME_INCOME_TYPE
HAVING count(*) > 100
ORDER BY default_rate_pct DESC, NAME_INCOME_TYPE
LIMIT 10""",
    "Bureau Data JOIN": f"""
WITH loans AS (SELECT SK_ID_CURR, count(*) AS loan_count FROM bureau GROUP BY SK_ID_CURR)
SELECT CODE_GENDER, count(DISTINCT a.SK_ID_CURR) AS borrowers,
  round(avg(loan_count), 1) AS avg_bureau_loans, {RATE.format('a.')}
FROM applications AS a LEFT JOIN loans ON loans.SK_ID_CURR = a.SK_ID_CURR
WHERE CODE_GENDER <> 'XNA'
GROUP BY CODE_GENDER""",
    "Previous Applications Analysis": f"""
WITH history AS (
  SELECT SK_ID_CURR, NAME_CONTRACT_STATUS, count(*) AS n
  FROM previous_application
  GROUP BY SK_ID_CURR, NAME_CONTRACT_STATUS)
SELECT NAME_CONTRACT_STATUS, sum(n) AS count,
  round(sum(n * AMT_INCOME_TOTAL) / sum(CASE WHEN AMT_INCOME_TOTAL IS NOT NULL THEN n END), 0) AS avg_income,
  round(100e0 * sum(n * TARGET) / sum(n), 2) AS default_rate_pct
FROM applications AS a JOIN history ON history.SK_ID_CURR = a.SK_ID_CURR
GROUP BY NAME_CONTRACT_STATUS
ORDER BY default_rate_pct DESC, NAME_CONTRACT_STATUS""",
    "Age Analysis (Derived)": f"""
WITH aged AS (SELECT TARGET, DAYS_BIRTH / -365 AS years FROM applications)
SELECT CASE WHEN years < 25 THEN '18-24' WHEN years < 35 THEN '25-34'
    WHEN years < 45 THEN '35-44' WHEN years < 55 THEN '45-54' ELSE '55+' END AS age_group,
  count(*) AS borrower_count, {RATE.format('')}
FROM aged
GROUP BY age_group
ORDER BY age_group""",
}


def rate_by_column(column: str) -> str:
    """Default rate by any column of the applications."""
    quoted = "`" + column.replace("`", "``") + "`"
    return (
        f"SELECT {quoted}, count(*) AS count, {RATE.format('')} FROM applications "
        f"GROUP BY {quoted} ORDER BY default_rate_pct DESC, {quoted}"
    )


QUERY_TIPS = {
    "Default rate by any categorical column": rate_by_column("NAME_CONTRACT_TYPE"),
    "Age analysis": "SELECT SK_ID_CURR, DAYS_BIRTH / -365 AS age_years, TARGET FROM applications",
    "Join with bureau data": """
WITH records AS (SELECT SK_ID_CURR, count(SK_ID_BUREAU) AS n FROM bureau GROUP BY SK_ID_CURR)
SELECT a.SK_ID_CURR, a.TARGET, sum(coalesce(n, 0)) AS bureau_count
FROM applications AS a LEFT JOIN records ON records.SK_ID_CURR = a.SK_ID_CURR
GROUP BY a.SK_ID_CURR, a.TARGET""",
}
