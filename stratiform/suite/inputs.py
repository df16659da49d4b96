"""Inputs derived from the test tables, written once for both engines.

Table names stand in braces: Spark fills in the frames, the SQL twin the bare names.
"""

from __future__ import annotations

import re


def plain(sql: str) -> str:
    """The same text for the other engine."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


# Customers with the faults the rules look for: blank, missing and untrimmed names, nations
# that do not exist, missing nations.
DIRTY = """
SELECT c_custkey AS custkey,
  CASE WHEN c_acctbal < 0 AND c_mktsegment = 'FURNITURE' THEN ''
       WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN NULL
       WHEN c_acctbal < 0 AND c_mktsegment = 'MACHINERY' THEN concat(' ', c_name)
       ELSE c_name END AS name,
  CASE WHEN c_acctbal > 9000 THEN c_nationkey + 100
       WHEN c_acctbal > 8900 THEN NULL
       ELSE c_nationkey END AS nationkey,
  c_acctbal AS balance,
  CASE WHEN c_acctbal > 9500 THEN NULL ELSE c_mktsegment END AS segment
FROM {customer}
"""

# The next delivery of the customer table: some balances changed, some customers gone,
# some new.
NEXT = """
SELECT c_custkey, c_name, c_nationkey,
  CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal,
  c_mktsegment
FROM {customer} WHERE c_acctbal >= -500
UNION ALL
SELECT c_custkey + 1000000000, c_name, c_nationkey, c_acctbal, c_mktsegment
FROM {customer} WHERE c_acctbal > 9000
"""

# A change feed: user profiles, operation by event type, ordered by event id.
CHANGES = """
SELECT user_id, event_id AS _seq,
  CASE event_type WHEN 'signup' THEN 2 WHEN 'view' THEN 3 WHEN 'error' THEN 1 ELSE 4 END AS _op,
  event_type AS last_event, value AS amount, 'ACTIVE' AS status
FROM {events}
"""

# The table the feed applies to: users below the median id, before any change.
PROFILES = """
SELECT user_id, 'none' AS last_event, CAST(0 AS DOUBLE) AS amount, 'ACTIVE' AS status
FROM {events} GROUP BY user_id HAVING MIN(value) < 0.5
"""

FIRST_DAY = "2024-01-01"
NEXT_DAY = "2024-02-01"
VERSION = "rules-v1"
