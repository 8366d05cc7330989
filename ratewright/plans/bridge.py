"""The charge model's tables as views over the analytic tables (customers, orders, line items, parts, ...).

Each view is one portable SQL statement, so that Spark and the SQL that checks a query define their inputs alike. Views inject
the NULLs and rule violations that the analytic tables lack, by moduli of their keys.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: View name to SQL; ``{name}`` is an analytic table or an earlier view.
VIEWS: dict[str, str] = {
    "charge_item": """
        SELECT p_partkey AS item_id, p_name AS description,
          CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size AS DECIMAL(38,10)) END AS drug_unit,
          CASE p_size % 5 WHEN 0 THEN 'ML' WHEN 1 THEN 'UN' WHEN 2 THEN 'EA' WHEN 3 THEN 'XX' ELSE NULL END AS drug_type
        FROM {part}""",
    "charge_code": """
        SELECT p_partkey AS item_id, CAST(0 AS BIGINT) AS code_ordinal, p_brand AS code, CASE WHEN p_partkey % 13 = 0 THEN 'LOKAL' ELSE 'LOCAL' END AS code_type FROM {part} WHERE p_partkey % 17 <> 0
        UNION ALL
        SELECT p_partkey, CAST(CASE WHEN p_partkey % 19 = 0 THEN 2 ELSE 1 END AS BIGINT), p_type, CASE WHEN p_partkey % 5 = 0 THEN 'NDC' ELSE 'CDM' END FROM {part}""",
    "order_range": """
        SELECT l_orderkey, min(l_partkey) AS item_id, min(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(38,10))) AS low, max(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(38,10))) AS high
        FROM {lineitem} GROUP BY l_orderkey""",
    "charge_group": """
        SELECT o_orderkey AS charge_group_id, coalesce(r.item_id, CAST(-1 AS BIGINT)) AS item_id,
          CASE o_orderstatus WHEN 'F' THEN 'inpatient' WHEN 'O' THEN 'outpatient' ELSE CASE WHEN o_orderkey % 10 = 0 THEN 'telehealth' ELSE 'both' END END AS setting,
          CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS billing_class,
          CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN CAST(0 AS DECIMAL(38,10)) ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,10)) END AS gross_charge,
          CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,10)) END AS discounted_cash,
          CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE r.low END AS minimum_amount, r.high AS maximum_amount
        FROM {orders} o LEFT JOIN {order_range} r ON r.l_orderkey = o.o_orderkey""",
    "payer_line": """
        SELECT l_orderkey AS charge_group_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS BIGINT) AS payer_ordinal,
          l_suppkey, l_partkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate,
          CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(38,10)) AS price, CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DECIMAL(38,10)) AS quantity
        FROM {lineitem}""",
    "payer_rate": """
        SELECT concat(CAST(charge_group_id AS VARCHAR(20)), ':', CAST(payer_ordinal AS VARCHAR(20))) AS payer_rate_id, charge_group_id, payer_ordinal, s_name AS payer_name, concat(l_returnflag, l_linestatus) AS plan_name,
          concat(lower(s_name), '|', lower(l_returnflag), lower(l_linestatus)) AS canonical_payer_plan_key,
          CASE WHEN l_linenumber % 3 = 0 THEN 'fee schedule' WHEN l_linenumber % 3 = 1 THEN 'percent of total billed charges' WHEN l_partkey % 50 = 0 THEN 'barter' ELSE 'other' END AS methodology,
          CASE WHEN l_linenumber % 3 = 0 OR l_partkey % 9 = 0 THEN CASE WHEN l_partkey % 211 = 0 THEN CAST(0 AS DECIMAL(38,10)) ELSE price END ELSE NULL END AS standard_charge_dollar,
          CASE WHEN l_linenumber % 3 = 1 AND l_partkey % 31 <> 0 THEN quantity ELSE NULL END AS standard_charge_percentage,
          CASE WHEN l_linenumber % 3 = 2 THEN CASE WHEN l_partkey % 97 = 0 THEN '  ' ELSE concat('price of ', CAST(l_partkey AS VARCHAR(20))) END ELSE NULL END AS standard_charge_algorithm,
          CASE l_partkey % 6 WHEN 0 THEN '0' WHEN 1 THEN '1 through 10' WHEN 2 THEN '11' WHEN 3 THEN '7' WHEN 4 THEN CAST(l_partkey + 100 AS VARCHAR(20)) ELSE NULL END AS allowed_count,
          CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE price END AS median_amount, CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE price END AS p10_amount, price AS p90_amount
        FROM {payer_line} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey""",
    "modifier": """
        SELECT CAST(n_nationkey AS BIGINT) AS modifier_id, CAST(n_nationkey AS BIGINT) AS modifier_ordinal, n_name AS description, concat('M', CAST(n_nationkey % 9 AS VARCHAR(20))) AS code, concat('m', CAST(n_nationkey % 9 AS VARCHAR(20))) AS canonical_code,
          CASE WHEN n_nationkey < 9 THEN CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'inpatient' WHEN 2 THEN 'outpatient' ELSE 'both' END WHEN n_nationkey % 9 IN (1, 2) THEN 'outpatient' WHEN n_nationkey = 24 THEN 'abroad' ELSE 'inpatient' END AS setting
        FROM {nation}""",
    "charge_modifier": """
        SELECT o_orderkey AS charge_group_id, CAST(0 AS BIGINT) AS modifier_ordinal, concat('M', CAST(o_orderkey % 12 AS VARCHAR(20))) AS modifier_code, concat('m', CAST(o_orderkey % 12 AS VARCHAR(20))) AS canonical_modifier_code FROM {orders} WHERE o_orderkey % 3 = 0
        UNION ALL
        SELECT o_orderkey, CAST(1 AS BIGINT), concat('m', CAST(o_orderkey % 5 AS VARCHAR(20))), concat('m', CAST(o_orderkey % 5 AS VARCHAR(20))) FROM {orders} WHERE o_orderkey % 6 = 0""",
    "modifier_payer": """
        SELECT m.modifier_id * 1000000 + s.s_suppkey AS modifier_payer_id, CASE WHEN s.s_suppkey % 29 = 0 THEN CAST(999 AS BIGINT) ELSE m.modifier_id END AS modifier_id, s.s_name AS payer_name, 'AF' AS plan_name, concat(lower(s.s_name), '|af') AS canonical_payer_plan_key, concat('maps ', s.s_name) AS description
        FROM {modifier} m JOIN {supplier} s ON s.s_nationkey = m.modifier_id""",
    "observation": """
        SELECT concat(p.payer_rate_id, ':', k.rate_kind) AS rate_observation_id, p.payer_rate_id, p.charge_group_id, p.payer_name, p.plan_name, p.methodology, g.setting, g.billing_class, k.rate_kind,
          CASE k.rate_kind WHEN 'dollar' THEN p.standard_charge_dollar WHEN 'percentage' THEN p.standard_charge_percentage END AS rate_numeric,
          CASE k.rate_kind WHEN 'algorithm' THEN p.standard_charge_algorithm END AS rate_algorithm, k.rate_kind = 'dollar' AS eligible_for_segmented_comparison
        FROM {payer_rate} p JOIN {charge_group} g ON g.charge_group_id = p.charge_group_id
        JOIN (SELECT 'dollar' AS rate_kind UNION ALL SELECT 'percentage' UNION ALL SELECT 'algorithm') k
          ON (k.rate_kind = 'dollar' AND p.standard_charge_dollar IS NOT NULL) OR (k.rate_kind = 'percentage' AND p.standard_charge_percentage IS NOT NULL) OR (k.rate_kind = 'algorithm' AND p.standard_charge_algorithm IS NOT NULL)""",
    # the model again with rows that break every rule of a contract that the views above keep
    "faulty_charge_item": """
        SELECT * FROM {charge_item} UNION ALL SELECT * FROM {charge_item} WHERE item_id % 43 = 0
        UNION ALL SELECT -item_id AS item_id, description, drug_unit, drug_type FROM {charge_item} WHERE item_id % 47 = 0""",
    "faulty_charge_code": """
        SELECT * FROM {charge_code} UNION ALL SELECT * FROM {charge_code} WHERE item_id % 53 = 0
        UNION ALL SELECT item_id + 100000000 AS item_id, code_ordinal, code, code_type FROM {charge_code} WHERE item_id % 59 = 0 AND code_ordinal = 0""",
    "faulty_charge_group": "SELECT * FROM {charge_group} UNION ALL SELECT * FROM {charge_group} WHERE charge_group_id % 61 = 0",
    "faulty_payer_rate": """
        SELECT payer_rate_id, charge_group_id, payer_ordinal, payer_name, plan_name, CASE WHEN charge_group_id % 73 = 0 THEN '' ELSE canonical_payer_plan_key END AS canonical_payer_plan_key, methodology,
          standard_charge_dollar, standard_charge_percentage, standard_charge_algorithm, allowed_count, median_amount, p10_amount, p90_amount FROM {payer_rate}
        UNION ALL SELECT * FROM {payer_rate} WHERE charge_group_id % 67 = 0 AND payer_ordinal = 0
        UNION ALL SELECT concat('orphan of ', payer_rate_id) AS payer_rate_id, charge_group_id + 100000000 AS charge_group_id, payer_ordinal, payer_name, plan_name, canonical_payer_plan_key, methodology,
          standard_charge_dollar, standard_charge_percentage, standard_charge_algorithm, allowed_count, median_amount, p10_amount, p90_amount FROM {payer_rate} WHERE charge_group_id % 71 = 0 AND payer_ordinal = 0""",
    "faulty_modifier": "SELECT * FROM {modifier} UNION ALL SELECT * FROM {modifier} WHERE modifier_id = 4",
    "faulty_modifier_payer": "SELECT * FROM {modifier_payer} UNION ALL SELECT * FROM {modifier_payer} WHERE modifier_payer_id % 5 = 0",
    "faulty_charge_modifier": """
        SELECT * FROM {charge_modifier} UNION ALL SELECT * FROM {charge_modifier} WHERE charge_group_id % 89 = 0
        UNION ALL SELECT charge_group_id + 100000000 AS charge_group_id, modifier_ordinal, modifier_code, canonical_modifier_code FROM {charge_modifier} WHERE charge_group_id % 97 = 0""",
    "faulty_observation": """
        SELECT rate_observation_id, CASE WHEN payer_rate_id LIKE '%3:2' THEN concat('gone ', payer_rate_id) ELSE payer_rate_id END AS payer_rate_id, methodology,
          CASE WHEN payer_rate_id LIKE '%9:0' THEN 'barter' ELSE rate_kind END AS rate_kind, CASE WHEN payer_rate_id LIKE '%1:0' THEN NULL ELSE rate_numeric END AS rate_numeric, rate_algorithm,
          CASE WHEN payer_rate_id LIKE '%9:1' THEN NOT eligible_for_segmented_comparison ELSE eligible_for_segmented_comparison END AS eligible_for_segmented_comparison
        FROM {observation} WHERE payer_rate_id NOT LIKE '%7:0'
        UNION ALL SELECT rate_observation_id, payer_rate_id, methodology, rate_kind, rate_numeric, rate_algorithm, eligible_for_segmented_comparison FROM {observation} WHERE payer_rate_id LIKE '%3:1'""",
    "inspected": """
        SELECT event_id AS file_id, user_id AS publisher_id, CAST(ts AS DATE) AS day, event_type,
          CASE event_type WHEN 'click' THEN 'fetched' WHEN 'view' THEN 'not_modified' WHEN 'purchase' THEN 'http_error' WHEN 'signup' THEN 'too_large' ELSE 'network_error' END AS status,
          CASE WHEN event_type = 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 404 ELSE 500 END END AS http_status,
          event_id % 9 <> 0 AS scan_completed, event_id % 15 AS items
        FROM {events}""",
    "finding": """
        SELECT event_id AS file_id, CASE event_id % 5 WHEN 0 THEN 'CONFORMANCE_A' WHEN 1 THEN 'COMPLETENESS_B' WHEN 2 THEN 'INTERPRETABILITY_C' WHEN 3 THEN 'FRESHNESS_D' ELSE 'CONFORMANCE_E' END AS code,
          CASE event_id % 5 WHEN 0 THEN 'conformance' WHEN 1 THEN 'completeness' WHEN 2 THEN 'interpretability' WHEN 3 THEN 'freshness' ELSE 'conformance' END AS dimension,
          CASE event_id % 3 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS severity, event_id * 2 AS position, concat('seen at ', CAST(event_id AS VARCHAR(20))) AS message
        FROM {events} WHERE event_id % 2 = 0
        UNION ALL
        SELECT event_id, 'COMPLETENESS_B', 'completeness', 'ERROR', event_id * 2 + 1, concat('again at ', CAST(event_id AS VARCHAR(20))) FROM {events} WHERE event_id % 6 = 1
        UNION ALL
        SELECT event_id, 'COMPLETENESS_B', 'completeness', 'ERROR', event_id * 2, concat('first at ', CAST(event_id AS VARCHAR(20))) FROM {events} WHERE event_id % 12 = 1""",
    "retrieval": """
        SELECT file_id, publisher_id, concat('loc', CAST(file_id % 7 AS VARCHAR(20))) AS location_id, requested_url, CASE WHEN file_id % 53 = 0 THEN 'https://other.example/x' ELSE requested_url END AS url, day,
          CASE WHEN file_id % 59 = 0 THEN 'yesterday' ELSE concat(CAST(day AS VARCHAR(20)), CASE file_id % 4 WHEN 0 THEN 'T23:30:00-02:00' WHEN 1 THEN 'T01:15:30+03:00' WHEN 2 THEN 'T12:00:00Z' ELSE 'T12:00:00.250+00:00' END) END AS attempted_at,
          status, CASE WHEN status = 'http_error' THEN CASE file_id % 3 WHEN 0 THEN 401 WHEN 1 THEN 403 ELSE 500 END WHEN status IN ('fetched', 'not_modified') THEN 200 END AS http_status,
          CASE WHEN status = 'invalid_url' THEN file_id % 2 WHEN status IN ('cache_miss', 'cache_error') THEN 0 ELSE 1 + file_id % 3 END AS attempts,
          CASE WHEN status = 'invalid_url' AND file_id % 4 = 1 THEN 'unsafe redirect target: a host within' WHEN status = 'network_error' THEN 'timed out' END AS error,
          CASE WHEN status IN ('fetched', 'not_modified') AND file_id % 79 <> 0 THEN concat('bytes-', CAST(file_id AS VARCHAR(20))) END AS content_sha256, CASE WHEN status IN ('fetched', 'not_modified') THEN file_id * 3 END AS size_bytes,
          CASE file_id % 3 WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN 'application/json' END AS content_type, CASE WHEN file_id % 83 = 0 THEN 'could not read it again' END AS problem
        FROM (SELECT event_id AS file_id, user_id AS publisher_id, CAST(ts AS DATE) AS day, concat('https://files.example/', CAST(event_id AS VARCHAR(20)), '.json?key=', CAST(user_id AS VARCHAR(20))) AS requested_url,
            CASE WHEN event_id % 26 < 14 THEN 'fetched' WHEN event_id % 26 < 16 THEN 'not_modified' WHEN event_id % 26 < 18 THEN 'http_error' WHEN event_id % 26 = 18 THEN 'network_error' WHEN event_id % 26 = 19 THEN 'content_error' WHEN event_id % 26 < 22 THEN 'invalid_url'
              WHEN event_id % 26 = 22 THEN 'too_large' WHEN event_id % 26 = 23 THEN 'cache_miss' WHEN event_id % 26 = 24 THEN CASE WHEN event_id % 4 = 0 THEN 'cache_error' ELSE 'robots_disallowed' END ELSE 'tls_verification_failed' END AS status
          FROM {events}) x""",
    "inspection": """
        SELECT file_id, CASE WHEN file_id % 61 = 0 THEN 'bytes-of-another' ELSE content_sha256 END AS source_sha256, CASE WHEN file_id % 67 = 0 THEN size_bytes + 1 ELSE size_bytes END AS source_size,
          CASE WHEN file_id % 71 = 0 THEN day + 5 WHEN file_id % 4 = 0 THEN day + 1 WHEN file_id % 4 = 1 THEN day - 1 ELSE day END AS inspected_as_of, CASE WHEN file_id % 73 = 0 THEN publisher_id + 1 ELSE publisher_id END AS inspected_publisher,
          file_id % 9 <> 0 AS scan_completed, file_id % 15 AS items, CAST(day AS VARCHAR(20)) AS last_updated_on, '3.0.0' AS version
        FROM {retrieval} WHERE (status IN ('fetched', 'not_modified') AND file_id % 17 <> 0) OR file_id % 89 = 0""",
}

_NAME = re.compile(r"\{(\w+)\}")


def needs(sql: str) -> list[str]:
    """The views that a statement reads, directly or not, in the order of their definition."""
    seen: set[str] = set()
    todo = [sql]
    while todo:
        for name in _NAME.findall(todo.pop()):
            if name in VIEWS and name not in seen:
                seen.add(name)
                todo.append(VIEWS[name])
    return [v for v in VIEWS if v in seen]


def oracle(sql: str) -> str:
    """Plain SQL: the views that ``sql`` needs as common table expressions, then ``sql``."""
    ctes = ", ".join(f"{v} AS ({_NAME.sub(r'\1', VIEWS[v])})" for v in needs(sql))
    body = _NAME.sub(r"\1", sql).strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


class Tables:
    """Analytic tables and views of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder, self._found = spark, folder, {}

    def given(self, **tables: DataFrame) -> Tables:
        """The same with these tables instead of those of the folder: views are made of them."""
        out = Tables(self._spark, self._folder)
        out._found |= tables
        return out

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._found:
            if name in VIEWS:
                sql = VIEWS[name]
                self._found[name] = self._spark.sql(sql, **{t: getattr(self, t) for t in dict.fromkeys(_NAME.findall(sql))})
            else:
                self._found[name] = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self._found[name]
