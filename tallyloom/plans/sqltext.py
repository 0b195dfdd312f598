"""Common table expressions that the DuckDB texts share: the same panels in long form."""

NATIVE, HIDE, ANCHOR, TRAIN, POOL, ORDER = (k * 1_000_003 for k in range(1, 7))


def u(e: str, days: str, t: str, seed: int | str) -> str:
    """The shared uniform."""
    inner = f"(CAST({e} AS BIGINT) * 7919 + CAST({days} AS BIGINT) * 104729 + CAST({t} AS BIGINT) * 1299709 + {seed})"
    second = f"(({inner} % 2147483647) * 48271 % 2147483647)"
    return f"(({second} * ({second} % 39989 + 1) % 2147483647) / 2147483647.0::DOUBLE)"


ORDERS = f"""
op AS (
  SELECT n_nationkey::BIGINT AS e, n_name AS entity, r_name AS grp,
         date_diff('day', DATE '1995-01-01', CAST(date_trunc('month', o_orderdate) AS DATE))::BIGINT AS days,
         count(*)::DOUBLE AS n,
         (count(*) FILTER (o_orderpriority = '1-URGENT'))::DOUBLE AS c0, (count(*) FILTER (o_orderpriority = '2-HIGH'))::DOUBLE AS c1,
         (count(*) FILTER (o_orderpriority = '3-MEDIUM'))::DOUBLE AS c2, (count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED'))::DOUBLE AS c3
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL
), full_cells AS (
  SELECT e * 100000 + days AS row_id, e, entity, grp, days, n, t, [c0, c1, c2, c3][t + 1] AS truth
  FROM op, (SELECT unnest([0, 1, 2, 3]) AS t)
), cells AS (
  SELECT *, CASE WHEN {u("e", "days", "t", NATIVE)} < 0.2 THEN NULL ELSE truth END AS c FROM full_cells
)"""

EVENTS = f"""
ep AS (
  SELECT user_id AS e, user_id::VARCHAR AS entity, (user_id % 5)::VARCHAR AS grp, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))::BIGINT AS days,
         count(*)::DOUBLE AS n, (count(*) FILTER (event_type = 'click'))::DOUBLE AS c0, (count(*) FILTER (event_type = 'error'))::DOUBLE AS c1,
         (count(*) FILTER (event_type = 'purchase'))::DOUBLE AS c2, (count(*) FILTER (event_type = 'signup'))::DOUBLE AS c3
  FROM events GROUP BY ALL
), full_cells AS (
  SELECT e * 100000 + days AS row_id, e, entity, grp, days, n, t, [c0, c1, c2, c3][t + 1] AS truth
  FROM ep, (SELECT unnest([0, 1, 2, 3]) AS t)
), cells AS (
  SELECT *, CASE WHEN {u("e", "days", "t", NATIVE)} < 0.2 THEN NULL ELSE truth END AS c FROM full_cells
)"""

#: Row sums, residual and the part Other beside each cell; then shares with their half least positive.
ROWS = """
rows_ AS (
  SELECT row_id, any_value(e) AS e, any_value(entity) AS entity, any_value(grp) AS grp, any_value(days) AS days, any_value(n) AS n,
         coalesce(sum(c), 0) AS known, count(c) AS seen, any_value(n) - coalesce(sum(c), 0) AS resid FROM cells GROUP BY row_id
), parts AS (
  SELECT row_id, t, c / n AS p FROM cells
  UNION ALL
  SELECT row_id, 4, CASE WHEN seen = 4 THEN resid / n END FROM rows_
), delta AS (
  SELECT min(p) FILTER (p > 0) / 2 AS delta FROM parts
), x AS (
  SELECT row_id, t, CASE WHEN p = 0 THEN delta ELSE p END AS x FROM parts, delta
)"""
