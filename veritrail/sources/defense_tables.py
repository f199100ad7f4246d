"""Chargeback-defense cases, claims, evidence and labels derived from orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.sources.driver_tables import lookup, table

EXPECTED = {
    "1-URGENT": "SUPPORTED", "2-HIGH": "CONTRADICTED", "3-MEDIUM": "INSUFFICIENT_EVIDENCE", "4-NOT SPECIFIED": "UNKNOWN",
    "5-LOW": "SUPPORTED",
}
SOURCE_OF = {
    0: "CARRIER_API", 1: "MERCHANT_DOCUMENT", 2: "PROVIDER_WEBHOOK", 3: "PROVIDER_API", 4: "INTERNAL_SYSTEM",
    5: "CUSTOMER_COMMUNICATION", 6: "UNVERIFIED_FEED",
}
DESCRIPTION = """concat('The parcel was ', IF(o_orderkey % 3 = 0, 'delivered', 'sent'), ' to the buyer.',
  IF(o_orderkey % 5 = 0, ' The customer signed for it.', ''), IF(o_orderkey % 4 = 1, ' Goods received in full.', ''),
  IF(o_orderkey % 7 = 0, concat(' Arrival on ', date_format(o_orderdate, 'yyyy-MM-dd'), '.'), ''))"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return o.select(
        "o_orderkey", F.expr("concat('case_', o_orderkey)").alias("case_id"),
        F.expr("concat('pay_o', o_orderkey)").alias("payment_reference"),
        F.expr("IF(o_orderkey % 13 = 0, NULL, concat('order_', o_orderkey))").alias("order_reference"),
        F.expr(DESCRIPTION).alias("description"), lookup("o_orderpriority", EXPECTED).alias("expected_label"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ordered_us"),
    )


def claims(cases_df: DataFrame) -> DataFrame:
    """One claim per case, two for every fourth; every 17th case has none."""
    n = F.expr("CASE WHEN o_orderkey % 17 = 0 THEN array() WHEN o_orderkey % 4 = 0 THEN array(1, 2) ELSE array(1) END")
    return cases_df.withColumn("c", F.explode(n)).select(
        F.expr("concat(case_id, '_c', c)").alias("claim_id"), "case_id", "payment_reference", "order_reference", "o_orderkey", "c", "ordered_us")


def delivery_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_linestatus", "l_returnflag", "l_quantity", "l_shipdate")
    observed = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    return li.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("evidence_id"), "l_orderkey",
        F.expr("IF(l_orderkey % 4 = 0, 1 + l_linenumber % 2, 1)").alias("c"), F.lit("DELIVERY_PROOF").alias("evidence_type"),
        F.expr("CASE WHEN l_linenumber % 5 = 0 THEN 'left near door' WHEN l_linestatus = 'F' THEN 'delivered' ELSE 'in_transit' END").alias("value"),
        F.expr("IF(l_returnflag = 'R' AND l_quantity > 45, 'CONTRADICTING', 'SUPPORTING')").alias("link_type"),
        lookup("l_suppkey % 7", SOURCE_OF).alias("source_type"),
        F.expr("IF(l_suppkey % 11 = 0, NULL, CAST(l_suppkey AS STRING))").alias("source_reference"),
        observed.alias("observed_us"), F.when(F.col("l_partkey") % 6 == 0, observed + 400 * 86_400_000_000).alias("valid_until_us"),
    )


def match_evidence(claims_df: DataFrame) -> DataFrame:
    """Payment and order match documents; some missing, some naming another entity, some shared."""
    k = "o_orderkey"
    items = F.expr(f"""array_compact(array(
      IF({k} % 10 = 3, NULL, named_struct('slot', 50, 'evidence_type', 'PAYMENT_ID_MATCH', 'value', IF({k} % 9 = 0, 'pay_other', payment_reference),
        'source_reference', concat(IF({k} % 15 = 0, 'doc_', 'pm_'), {k}))),
      IF({k} % 14 = 1, NULL, named_struct('slot', 60, 'evidence_type', 'ORDER_ID_MATCH', 'value', IF({k} % 12 = 5, 'order_other', concat('order_', {k})),
        'source_reference', concat(IF({k} % 15 = 0, 'doc_', 'om_'), {k})))))""")
    return claims_df.withColumn("e", F.explode(items)).select(
        (F.col(k) * 100 + F.col("e.slot") + F.col("c")).alias("evidence_id"), F.col(k).alias("l_orderkey"), "c", "e.evidence_type", "e.value",
        F.lit("SUPPORTING").alias("link_type"), F.lit("MERCHANT_DOCUMENT").alias("source_type"), "e.source_reference",
        F.col("ordered_us").alias("observed_us"), F.lit(None).cast("bigint").alias("valid_until_us"))


def evidence(spark: SparkSession, sf_dir: str, claims_df: DataFrame) -> DataFrame:
    """All linked evidence, keyed by claim; link_id orders links of a claim."""
    return delivery_evidence(spark, sf_dir).unionByName(match_evidence(claims_df)).withColumn(
        "claim_id", F.expr("concat('case_', l_orderkey, '_c', c)"))
