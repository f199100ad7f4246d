"""Chargeback-defense verdicts: claims against their linked evidence, set at a time."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import vocab as V
from veritrail.sources.driver_tables import lookup


def evidence_valid(at_us: int) -> Column:
    """Observed by then and not expired; evidence expiring exactly then still counts."""
    return F.coalesce(F.col("observed_us") <= at_us, F.lit(True)) & F.coalesce(F.col("valid_until_us") >= at_us, F.lit(True))


def provenance_valid() -> Column:
    return F.coalesce(F.col("source_type").isin(*V.DEFENSE_SOURCES) & (F.col("source_reference") != ""), F.lit(False))


def entity_match() -> Column:
    """Named entity equals the case's; a case without that reference accepts any name."""
    value = F.lower(F.trim(F.coalesce("value", F.lit(""))))
    expected = F.lower(F.trim(F.coalesce(
        F.when(F.col("evidence_type") == "PAYMENT_ID_MATCH", F.col("payment_reference")).otherwise(F.col("order_reference")), F.lit(""))))
    return F.when(value == "", False).when(expected == "", True).otherwise(value == expected)


def delivery_status() -> Column:
    v = F.lower(F.trim(F.coalesce("value", F.lit(""))))
    starts = reduce(lambda a, b: a | b, [v.startswith(p) for p in V.DELIVERY_COMPLETE_PREFIXES])
    tokens = reduce(lambda a, b: a | b, [v.contains(t) for t in V.DELIVERY_INCOMPLETE_TOKENS])
    return F.when(v == "", "AMBIGUOUS").when(starts, "COMPLETE").when(tokens, "INCOMPLETE").otherwise("AMBIGUOUS")


def surviving_sources(links: DataFrame, at_us: int) -> DataFrame:
    """First valid supporting link per (claim, source type, reference): a partial aggregate."""
    valid = links.filter((F.col("link_type") == "SUPPORTING") & evidence_valid(at_us))
    return valid.groupBy("claim_id", "source_type", "source_reference").agg(
        F.min(F.struct("evidence_id", "evidence_type", "value")).alias("x")).select("claim_id", "x.*", "source_type", "source_reference")


def claim_verdicts(claims: DataFrame, links: DataFrame, at_us: int) -> DataFrame:
    """`claims`: claim_id, case_id, payment_reference, order_reference; `links`: evidence per claim."""
    totals = links.groupBy("claim_id").agg(
        F.count("*").alias("n_links"),
        F.count_if((F.col("link_type") == "CONTRADICTING") & evidence_valid(at_us)).alias("n_contradicting"))
    refs = claims.select("claim_id", "payment_reference", "order_reference")
    items = surviving_sources(links, at_us).join(refs, "claim_id")
    etype = F.col("evidence_type")
    clean = provenance_valid()
    status = delivery_status()
    is_entity, is_delivery = etype.isin(*V.ENTITY_MATCH_TYPES), etype.isin(*V.DELIVERY_TYPES)
    usable = clean & F.when(is_entity, entity_match()).when(is_delivery, status == "COMPLETE").otherwise(True)
    flags = items.groupBy("claim_id").agg(
        F.count_if(usable).alias("n_supporting"), F.count_if(clean & is_delivery & (status != "COMPLETE")).alias("n_inconclusive"),
        F.count_if(clean & is_entity & ~entity_match()).alias("n_mismatch"),
        *[F.count_if(usable & (etype == t)).alias(f"has_{t}") for t in V.REQUIRED_DEFENSE_TYPES])
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    j = claims.select("claim_id", "case_id").join(totals, "claim_id", "left").join(flags, "claim_id", "left")
    missing = F.array_compact(F.array(*[F.when(n(f"has_{t}") == 0, F.lit(t)) for t in V.REQUIRED_DEFENSE_TYPES]))
    only_delivery = (F.size("m") == 1) & (F.col("m")[0] == "DELIVERY_PROOF")
    label = (
        F.when(n("n_links") == 0, "UNKNOWN").when(n("n_contradicting") > 0, "CONTRADICTED")
        .when(only_delivery & (n("n_inconclusive") > 0), "UNKNOWN")
        .when(F.size("m") > 0, "INSUFFICIENT_EVIDENCE").otherwise("SUPPORTED"))
    return j.withColumn("m", missing).select(
        "claim_id", "case_id", label.alias("label"), F.array_join("m", ",").alias("missing_types"), n("n_links").alias("n_links"),
        n("n_contradicting").alias("n_contradicting"), n("n_supporting").alias("n_supporting"), n("n_mismatch").alias("n_mismatch"))


def case_verdicts(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Most decisive claim label per case; a case without claims is UNKNOWN."""
    best = verdicts.groupBy("case_id").agg(
        F.min_by("label", lookup("label", V.LABEL_PRECEDENCE, 99)).alias("label"), F.count("*").alias("n_claims"))
    return cases.select("case_id", "expected_label").join(best, "case_id", "left").select(
        "case_id", "expected_label", F.coalesce("label", F.lit("UNKNOWN")).alias("predicted"), F.coalesce("n_claims", F.lit(0).cast("bigint")).alias("n_claims"))


# --- claims from free text ------------------------------------------------------------------------

def _date_in(text: Column) -> Column:
    """ISO date anywhere in the text, else the first month of the year named with a day."""
    out = F.when(text.rlike(r"\d{4}-\d{2}-\d{2}"), F.regexp_extract(text, r"(\d{4})-(\d{2})-(\d{2})", 0))
    for i, month in enumerate(V.MONTHS):
        p = month + r"\w*\s+(\d{1,2})(?:st|nd|rd|th)?(?:\s*,?\s*(\d{4}))?"
        year = F.regexp_extract(text, p, 2)
        out = out.when(text.rlike(p), F.concat(
            F.when(year == "", V.DEFAULT_CLAIM_YEAR).otherwise(year), F.lit(f"-{i + 1:02d}-"),
            F.lpad(F.regexp_extract(text, p, 1), 2, "0")))
    return out


def extract_claims(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Claims named in each text, over the whole text; a text without any yields one UNPARSEABLE row."""
    low = F.lower(text_col)
    rows = texts.select(id_col, low.alias("t"))
    items = []
    for kind, pattern in V.CLAIM_PATTERNS:
        at = F.regexp_instr("t", F.lit(pattern))
        word = F.regexp_extract("t", pattern, 0)
        before = F.substring_index(F.substring("t", F.lit(1), at - 1), ".", -1)
        after = F.substring_index(F.substring("t", at + F.length(word), F.length("t")), ".", 1)
        sentence = F.regexp_replace(F.concat(before, word, after), r"^\s+|\s+$", "")
        items.append(F.when(F.col("t").rlike(pattern), F.struct(
            F.lit(kind).alias("claim_type"), F.substring(sentence, 1, 200).alias("claim_text"),
            F.lit(V.CLAIM_CONFIDENCE).alias("confidence"), F.lit(None).cast("string").alias("normalized_value"))))
    date = _date_in(F.col("t"))
    items.append(F.when(F.col("d").isNotNull(), F.struct(
        F.lit("DELIVERY_DATE").alias("claim_type"), F.concat(F.lit("Delivery date: "), F.col("d")).alias("claim_text"),
        F.lit(V.DATE_CONFIDENCE).alias("confidence"), F.col("d").alias("normalized_value"))))
    found = rows.withColumn("d", date).select(id_col, F.array_compact(F.array(*items)).alias("c"))
    return found.select(id_col, F.explode_outer("c").alias("c")).select(
        id_col, "c.*", F.when(F.col("c").isNull(), "UNPARSEABLE").otherwise("OK").alias("semantic_status"))


def extract_with(texts: DataFrame, provider: Callable, schema: str) -> DataFrame:
    """Hook for another extractor: `provider` maps an iterator of pandas batches to claim batches."""
    return texts.mapInPandas(provider, schema)


def match_claims(claims: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each extracted claim against the evidence of its case's payment.

    Claim types are a closed list, so every candidate meets a handful of claims.
    """
    delivered = F.col("claim_type").isin("DELIVERY_COMPLETED", "CUSTOMER_RECEIVED_GOODS")
    v = F.lower(F.coalesce("value", F.lit("")))
    etype = F.col("evidence_type")
    relevant = (
        (delivered & (etype.isin(*V.DELIVERY_TYPES, *V.ENTITY_MATCH_TYPES) | v.contains("delivered") | v.contains("received")))
        | ((F.col("claim_type") == "DELIVERY_DATE") & etype.isin(*V.DELIVERY_TYPES))
        | ((F.col("claim_type") == "CUSTOMER_ACKNOWLEDGED_RECEIPT") & (etype == "CUSTOMER_ACKNOWLEDGMENT")))
    return claims.join(candidates, "payment_reference").select(
        "*", F.when(relevant, "RELEVANT").otherwise("UNCERTAIN").alias("relationship"),
        F.when(relevant, V.MATCH_RELEVANT).otherwise(V.MATCH_UNCERTAIN).alias("match_confidence"))


def validate_references(proposed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Proposed matches whose evidence exists among the candidates and whose relationship is known."""
    known = proposed.filter(F.col("relationship").isin("RELEVANT", "UNCERTAIN", "IRRELEVANT"))
    return known.join(candidates.select("evidence_id"), "evidence_id", "left_semi")


def rejected_references(proposed: DataFrame, candidates: DataFrame) -> DataFrame:
    return proposed.join(candidates.select("evidence_id"), "evidence_id", "left_anti")


def defense_verify(cases: DataFrame, candidates: DataFrame, at_us: int) -> DataFrame:
    """Text -> claims -> matches -> validated links -> verdict per case."""
    found = extract_claims(cases, "case_id", "description").filter("claim_type IS NOT NULL")
    claims = found.join(cases.select("case_id", "payment_reference", "order_reference", "expected_label"), "case_id").withColumn(
        "claim_id", F.concat_ws(":", "case_id", "claim_type"))
    matched = match_claims(claims.select("claim_id", "claim_type", "payment_reference"), candidates)
    links = validate_references(matched, candidates).filter("relationship = 'RELEVANT'").withColumn("link_type", F.lit("SUPPORTING"))
    verdicts = claim_verdicts(claims, links, at_us)
    return case_verdicts(cases, verdicts)
