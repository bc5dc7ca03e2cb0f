"""Common table expressions of the oracle statements."""

from __future__ import annotations

from checks import views as V

EV = """ev AS (
  SELECT l_orderkey AS machine_id, p_partkey AS device_code, p_type AS attachment,
         p_brand AS sc_name, p_name AS phenomenon, l_returnflag AS location,
         l_linestatus = 'O' AS is_em, CAST(l_shipdate AS DATE) AS event_date,
         l_quantity AS work_hours
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

EVD = """evd AS (
  SELECT ev.*, CAST(o_orderdate AS DATE) AS due_date
  FROM ev JOIN orders ON machine_id = o_orderkey)"""

ROUTING = "routing(attachment, location, family, ord) AS (VALUES " + ", ".join(
    f"('{a}', '{loc}', '{f}', {o})" for a, loc, f, o in V.ROUTES
) + ")"

TOKENS = "tokens(series, token) AS (VALUES " + ", ".join(
    f"('{s}', '{t}')" for s, t in V.TOKENS.items()
) + ")"

SERIES = "fam(series) AS (VALUES " + ", ".join(f"('{s}')" for s in V.FAMILIES) + ")"

COUNTS = """counts AS (
  SELECT family AS series, event_date AS date, count(*) AS em
  FROM ev JOIN routing USING (attachment, location) GROUP BY 1, 2)"""

BASE = """base AS (
  SELECT series, CAST(o_orderdate AS DATE) AS date, count(*) AS n
  FROM orders JOIN tokens
    ON contains(lower(o_orderpriority || '_' || o_orderstatus), lower(token))
  GROUP BY 1, 2)"""

DATES = f"""dates AS (
  SELECT CAST(d AS DATE) AS date
  FROM (SELECT unnest(generate_series(TIMESTAMP '{V.CALENDAR_START}',
          (SELECT CAST(max(CAST(l_shipdate AS DATE)) AS TIMESTAMP) FROM lineitem),
          INTERVAL 1 DAY)) AS d))"""

PANEL = """panel AS (
  SELECT fam.series, dates.date, CAST(coalesce(em, 0) AS BIGINT) AS em,
         CAST(sum(coalesce(n, 0)) OVER (PARTITION BY fam.series ORDER BY dates.date
              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS mif_cum
  FROM dates CROSS JOIN fam
  LEFT JOIN counts ON counts.series = fam.series AND counts.date = dates.date
  LEFT JOIN base ON base.series = fam.series AND base.date = dates.date)"""

DRAWS = """dr AS (
  SELECT CAST(vec_id % 4 + 1 AS INTEGER) AS chain, CAST(vec_id // 4 AS INTEGER) AS iteration,
         CAST(vec_id AS INTEGER) AS draw, CAST(i AS INTEGER) AS i1,
         CAST(embedding[i] AS DOUBLE) AS value
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"""

PARAMS = """dp AS (
  SELECT CAST(vec_id AS INTEGER) AS draw, CAST(n + 1 AS INTEGER) AS series,
         e[o + 1] AS intercept, e[o + 2] AS b_ar, abs(e[o + 3]) AS s_z, abs(e[o + 4]) AS s_s,
         abs(e[o + 5]) AS s_r, abs(e[o + 6]) AS s_t, e[o + 7] AS mu_prev, e[o + 8] AS mu_last,
         e[o + 9] AS b_last, e[o + 10] AS g1, e[o + 11] AS g2, e[o + 12] AS g3, e[o + 13] AS g4,
         e[o + 14] AS g5, e[o + 15] AS g6, 1.0 + abs(e[o + 16]) AS num_last
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, n, n * 16 AS o
        FROM embeddings, range(0, 4) AS s(n)))"""


def lane(text: str, index: int = 0) -> str:
    start = 1 + 12 * index
    return (
        f"((CAST(CAST(('0x' || substr(md5({text}), {start}, 12)) AS BIGINT) AS DOUBLE)"
        " + 0.5) / 281474976710656.0)"
    )


def normal(text: str) -> str:
    return f"(sqrt(-2.0 * ln({lane(text)})) * cos(2.0 * pi() * {lane(text, 1)}))"


def noise(params: str, steps: int, seed: int = V.SEED) -> str:
    def z(component: str) -> str:
        return normal(f"'{seed}|' || draw || '|' || series || '|{component}|' || i")

    return f"""noise AS (
  SELECT draw, series, CAST(i AS INTEGER) AS step, {z('mu')} AS zmu, {z('b')} AS zb,
         {z('g')} AS zg, {z('r')} AS zr
  FROM {params}, range(1, {steps + 1}) AS s(i))"""


def horizon(params: str, steps: int, gain: str) -> str:
    """Recursive simulation of the horizon; needs ``noise``."""
    return f"""path AS (
  SELECT draw, series, 0 AS step, mu_last AS mu, mu_prev AS m2, b_last AS b,
         g1, g2, g3, g4, g5, g6, num_last AS num, CAST(0 AS DOUBLE) AS r,
         CAST(0 AS DOUBLE) AS lam, CAST(0 AS DOUBLE) AS delta
  FROM {params}
  UNION ALL
  SELECT draw, series, step, mu, m2, b, g1, g2, g3, g4, g5, g6, num, r,
         mu + g6 + b * num + r AS lam, mu - m2 AS delta
  FROM (
    SELECT p.draw, p.series, p.step + 1 AS step,
           q.intercept + q.b_ar * (2.0 * p.mu - p.m2) + q.s_z * z.zmu AS mu,
           p.mu AS m2, p.b + q.s_t * z.zb AS b,
           p.g2 AS g1, p.g3 AS g2, p.g4 AS g3, p.g5 AS g4, p.g6 AS g5,
           -(p.g1 + p.g2 + p.g3 + p.g4 + p.g5 + p.g6) + q.s_s * z.zg AS g6,
           p.num + {gain} AS num, q.s_r * z.zr AS r
    FROM path p JOIN {params} q ON p.draw = q.draw AND p.series = q.series
    JOIN noise z ON z.draw = p.draw AND z.series = p.series AND z.step = p.step + 1
    WHERE p.step < {steps}))"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


PANEL_CTES = (EV, ROUTING, TOKENS, SERIES, COUNTS, BASE, DATES, PANEL)
