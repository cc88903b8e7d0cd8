"""Named queries over the driver's tables, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: SQL of the views in leadflow.plans.views and of the sample companies below.
LEADS = """leads AS (
  SELECT c_custkey AS company_id, c_name AS name, n_name AS city, r_name AS region, c_mktsegment AS segment, c_acctbal AS balance,
         greatest(0, floor(c_acctbal / 100))::BIGINT AS score
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
TOUCHES = """touches AS (
  SELECT o_orderkey AS touch_id, o_custkey AS company_id, o_orderdate AS tm, o_orderpriority AS channel, o_orderstatus AS status, o_totalprice AS value FROM orders)"""
EVENTS = """ev AS (
  SELECT event_id, user_id AS company_id, ts AS tm, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
COMPANIES = (
    LEADS
    + """, companies AS (
  SELECT company_id AS id, name, city, region, segment, score,
    CASE WHEN company_id % 4 <> 0 THEN 'https://www.s' || (company_id % 3) || '.site' || (company_id % 97) || CASE company_id % 5 WHEN 0 THEN '.com' WHEN 1 THEN '.net' ELSE '.ru' END || '/about' END AS website,
    CASE company_id % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['+7' || (9031000000 + (company_id * 7919) % 99999)]
      ELSE ['+7' || (9031000000 + (company_id * 7919) % 99999), '8495' || lpad(((company_id * 31) % 10000000)::VARCHAR, 7, '0')] END AS phones,
    CASE WHEN company_id % 2 = 0 THEN []::VARCHAR[] WHEN company_id % 6 = 1 THEN ['info' || (company_id % 50) || '@site' || (company_id % 97) || '.ru', 'user' || company_id || '@mail.ru']
      ELSE ['info' || (company_id % 50) || '@site' || (company_id % 97) || '.ru'] END AS emails,
    CASE WHEN company_id % 5 = 0 THEN 'https://t.me/u' || company_id END AS telegram, CASE WHEN company_id % 7 = 0 THEN 'https://wa.me/7' || company_id END AS whatsapp,
    CASE WHEN company_id % 4 = 1 THEN '' ELSE 'ul. Street' || (company_id % 20) || ', ' || (company_id % 100) END AS address,
    CASE company_id % 6 WHEN 0 THEN 'bitrix' WHEN 1 THEN 'wordpress' WHEN 2 THEN 'tilda' ELSE 'unknown' END AS cms,
    company_id % 11 = 0 AS has_marquiz, company_id % 17 = 0 AS deleted, company_id % 13 = 0 AS is_network
  FROM leads)"""
)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add
