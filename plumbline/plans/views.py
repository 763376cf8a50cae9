"""Tables with known defects, derived from the given tables by arithmetic on their columns.

The same text serves both engines, so a query and its check read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table

# view -> (base table, select list)
VIEWS = {
    "lineitem_q": ("lineitem", """l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN (l_orderkey * 7 + l_linenumber) % 13 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN (l_orderkey + l_partkey) % 97 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END AS l_extendedprice,
  CASE WHEN l_quantity < 15 AND l_partkey % 3 = 0 THEN NULL ELSE l_discount END AS l_discount,
  l_tax,
  CASE WHEN l_suppkey % 29 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag,
  l_linestatus, l_shipdate"""),
    "orders_q": ("orders", """o_orderkey,
  CASE WHEN o_orderkey % 41 = 0 THEN o_custkey + 1000000 WHEN o_orderkey % 43 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  o_orderstatus,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_totalprice * (1e0 + CAST(o_orderkey % 5 AS DOUBLE) / 100e0) END AS o_totalprice,
  o_orderdate,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderkey % 31 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS STRING) END AS o_ref"""),
    "customer_q": ("customer", """c_custkey, c_nationkey, c_acctbal, c_mktsegment,
  CASE WHEN c_custkey % 5 = 0 THEN 'invalid' WHEN c_custkey % 11 = 0 THEN NULL
       ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS email,
  CASE WHEN c_custkey % 7 = 0 THEN 'bad' ELSE '555-' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '-0000' END AS phone,
  CASE WHEN c_custkey % 13 = 0 THEN 16 ELSE 18 + c_custkey % 50 END AS age,
  CASE WHEN c_custkey % 3 = 0 THEN 'inactive' ELSE 'active' END AS status"""),
    "events_q": ("events", """event_id, ts, user_id, event_type,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' THEN value * 1.5e0 ELSE value END AS value,
  props"""),
}

NOW = "2024-02-01 00:00:00"
DRIFT_FROM = "2024-01-16 00:00:00"
# The measures of lineitem_q that the bins and the index work on.
FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view over one."""
    if name not in VIEWS:
        return read_table(spark, f"{sf_dir}/{name}.parquet")
    base, items = VIEWS[name]
    return spark.sql(f"SELECT {items} FROM {{base}}", base=read_table(spark, f"{sf_dir}/{base}.parquet"))


def with_views(*names: str) -> str:
    """WITH clause that defines the views for a check query."""
    return "WITH " + ",\n".join(f"{n} AS (SELECT {VIEWS[n][1]} FROM {VIEWS[n][0]})" for n in names) + "\n"
