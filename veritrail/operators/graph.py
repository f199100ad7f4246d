"""Bounded graph questions over typed edges, for all payments at once.

Edges carry the payment they belong to and traversals never leave it, so shared nodes (a source
type, a customer) do not connect everything with everything. Each hop is one equi-join of the nodes of
the last hop with the edges that can begin at their types, and one aggregate; its nodes are written once.
Which types an edge type connects is known (KINDS), so a hop only makes the edges it can use, and an edge
moves about once in a search, not once a hop. Where it is not given from which type a search starts, every
hop looks at all edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.functions.skew import shuffled
from veritrail.operators.canonical import FIRST_ORDER_SLOT, slots_of
from veritrail.session import cut_lineage
from veritrail.sources.driver_tables import lookup

MAX_DEPTH = 5


def edge(df: DataFrame, src: Column, dst: Column, kind: str) -> DataFrame:
    rows = df.select("payment_id", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"))
    return rows.filter("src IS NOT NULL AND dst IS NOT NULL")


def edges_of(df: DataFrame, *edges: tuple[Column, Column, str]) -> DataFrame:
    """Several edges (from, to, type) of each row in one pass; rows that are not cheap to make are made once."""
    each = F.array(*[F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type")) for src, dst, kind in edges])
    rows = df.select("payment_id", F.explode(each).alias("e")).select("payment_id", "e.*")
    return rows.filter("src IS NOT NULL AND dst IS NOT NULL")


def node(prefix: str, col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.lit(prefix + ":"), c.cast("string"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def investigation_edges(payments: DataFrame, payment_events: DataFrame, payment_obs: DataFrame, claim_rows: DataFrame,
                        status_conflicts: DataFrame, members: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Typed edges around each payment. Conflict sets are one node with their members around it."""
    pay = node("pay", "payment_id")
    pc = claim_rows.filter("subject_type = 'payment'").withColumn("payment_id", F.col("subject_id"))
    status = status_conflicts.withColumn("c", F.concat_ws("-", "claim_a_id", "claim_b_id"))
    sets = members.withColumn("c", F.concat_ws("-", "payment_id", "claim_type"))
    ev = node("ev", "evidence_id")
    return union([
        edge(payments, pay, node("ord", "order_id"), "HAS_ORDER"), edge(payments, pay, node("cust", "customer_id"), "HAS_CUSTOMER"),
        edges_of(payment_events, (pay, node("evt", "payment_event_id"), "HAS_EVENT"),
                 (node("evt", "payment_event_id"), node("hook", "webhook_event_id"), "DERIVED_FROM_WEBHOOK")),
        edges_of(payment_obs, (node("evt", "payment_event_id"), ev, "PRODUCED_EVIDENCE"), (ev, node("src", "source_type"), "FROM_SOURCE"),
                 (ev, node("hook", "webhook_event_id"), "DERIVED_FROM_WEBHOOK")),
        edge(pc, ev, node("claim", "claim_id"), "SUPPORTS_CLAIM"),
        edges_of(status, (pay, node("conf", "c"), "HAS_CONFLICT"), (node("conf", "c"), node("claim", "claim_a_id"), "INVOLVES_CLAIM"),
                 (node("conf", "c"), node("claim", "claim_b_id"), "INVOLVES_CLAIM")),
        edge(sets.select("payment_id", "c").distinct(), pay, node("conf", "c"), "HAS_CONFLICT"),
        edge(sets, node("conf", "c"), node("claim", "claim_id"), "INVOLVES_CLAIM"),
        edge(snapshots, pay, node("snap", "eval_us"), "HAS_INTEGRITY_SNAPSHOT"),
    ])


#: What each edge type connects, by the prefixes of nodes.
KINDS = {
    "HAS_ORDER": [("pay", "ord")], "HAS_CUSTOMER": [("pay", "cust")], "HAS_EVENT": [("pay", "evt")],
    "DERIVED_FROM_WEBHOOK": [("evt", "hook"), ("ev", "hook")], "PRODUCED_EVIDENCE": [("evt", "ev")], "FROM_SOURCE": [("ev", "src")],
    "SUPPORTS_CLAIM": [("ev", "claim")], "HAS_CONFLICT": [("pay", "conf")], "INVOLVES_CLAIM": [("conf", "claim")],
    "HAS_INTEGRITY_SNAPSHOT": [("pay", "snap")],
    "TRIGGERED": [("hook", "evt")], "PRODUCED": [("hook", "obs")], "REPRESENTS": [("obs", "fact")], "MEASURED_BY": [("obs", "quality")],
    "SUPPORTS": [("obs", "claim")], "CORROBORATED_BY": [("claim", "corr")], "CONFLICTED_BY": [("claim", "conf")],
    "EVALUATED_BY": [("integrity", "trace")], "MIRRORS": [("state", "integrity")], "STATE_TRANSITION": [("state", "chg"), ("chg", "state")],
    "CAUSED_STATE_CHANGE": [("obs", "chg")], "RECONCILED_INTO": [("rec", "fact")],
}
INVESTIGATION = ("HAS_ORDER", "HAS_CUSTOMER", "HAS_EVENT", "DERIVED_FROM_WEBHOOK", "PRODUCED_EVIDENCE", "FROM_SOURCE", "SUPPORTS_CLAIM",
                 "HAS_CONFLICT", "INVOLVES_CLAIM", "HAS_INTEGRITY_SNAPSHOT")
LINEAGE = tuple(k for k in KINDS if k not in INVESTIGATION)


def ways_of(kinds: tuple[str, ...], both: bool = True) -> list[tuple[str, str, str, bool]]:
    """(edge type, from, to, whether against the edge) of the given edge types, in both directions if asked."""
    there = [(k, a, b, False) for k in kinds for a, b in KINDS[k]]
    return there + [(k, b, a, True) for k, a, b, _ in there if both]


def hops_to(ways: list[tuple[str, str, str, bool]], target: str) -> dict[str, int]:
    """Least number of hops from each type of node to the target type."""
    far, front, hops = {target: 0}, {target}, 0
    while front:
        hops += 1
        front = {a for _, a, b, _ in ways if b in front and a not in far}
        far |= dict.fromkeys(front, hops)
    return far


def steps_along(edges: DataFrame, ways: list[tuple[str, str, str, bool]], key: list[str]) -> DataFrame:
    """key, src, dst: the edges of the given ways, each turned so that it goes along its way."""
    found = []
    for a, b, against in (("src", "dst", False), ("dst", "src", True)):
        these = [w for w in ways if w[3] == against]
        if these:
            typed = reduce(lambda x, y: x | y, [
                F.col(a).startswith(x + ":") & F.col(b).startswith(y + ":") for x, y in sorted({w[1:3] for w in these})])
            of = edges.where(F.col("edge_type").isin(*sorted({w[0] for w in these}))).where(typed)
            found.append(of.select(*key, F.col(a).alias("src"), F.col(b).alias("dst")))
    return union(found)


def undirected(edges: DataFrame) -> DataFrame:
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select("payment_id", F.explode(both).alias("e")).select("payment_id", "e.*")


def reach(edges: DataFrame, roots: DataFrame, depth: int, key: list[str], start: str | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Nodes within `depth` hops of each root, with their distance. `roots`: key, root, node.

    `start`: the type of the root nodes, if the edges (with their edge_type) are of the given `kinds`.
    """
    steps = None if start else cut_lineage(edges.select(*key, "src", "dst").distinct())
    front = roots.select(*key, "root", "node").distinct()
    levels = [front.withColumn("depth", F.lit(0))]
    types, ways = {start}, ways_of(kinds, False)
    for hop in range(1, depth + 1):
        if start:
            used = [w for w in ways if w[1] in types]
            if not used:
                break  # no edge goes on from here
            types = {w[2] for w in used}
            steps = steps_along(edges, used, key)
        front = front.withColumnRenamed("node", "src").join(shuffled(steps), [*key, "src"]).select(*key, "root", F.col("dst").alias("node")).distinct()
        if hop < depth and not (start and not any(w[1] in types for w in ways)):
            front = cut_lineage(front)
        levels.append(front.withColumn("depth", F.lit(hop)))
    return union(levels).groupBy(*key, "root", "node").agg(F.min("depth").alias("depth"))


def reach_in_place(edges: DataFrame, roots: DataFrame, depth: int, key: list[str], start: str, kinds: tuple[str, ...]) -> DataFrame:
    """`reach` where the edges and roots of a key lie in one task, which is for keys of few edges.

    At each hop the nodes reached and the edges from them meet in a window, so nothing is moved or written.
    """
    reached = roots.select(*key, "root", "node").distinct().withColumn("depth", F.lit(0))
    types, ways = {start}, ways_of(kinds, False)
    for hop in range(1, depth + 1):
        used = [w for w in ways if w[1] in types]
        if not used:
            break
        types = {w[2] for w in used}
        both = reached.withColumnRenamed("node", "src").unionByName(steps_along(edges, used, key), allowMissingColumns=True)
        front = F.collect_set(F.when(F.col("depth") == hop - 1, F.struct("root"))).over(Window.partitionBy(*key, "src"))
        made = lambda root, node, at: F.struct(root.alias("root"), node.alias("node"), at.alias("depth"))
        new = F.transform("front", lambda r: made(r["root"], F.col("dst"), F.lit(hop)))
        old = F.array(made(F.col("root"), F.col("src"), F.col("depth")))
        rows = both.withColumn("front", front).select(*key, F.explode(F.when(F.col("dst").isNull(), old).otherwise(new)).alias("x"))
        reached = rows.select(*key, "x.*").groupBy(*key, "root", "node").agg(F.min("depth").alias("depth"))
    return reached


def paths(edges: DataFrame, roots: DataFrame, depth: int, ends: str = "true", start: str | None = None, target: str | None = None,
          kinds: tuple[str, ...] = ()) -> DataFrame:
    """Shortest path text from each payment's root to every node within `depth` hops that fulfils `ends`.

    Among equally short paths the alphabetically first is kept, so the answer is deterministic. `start` and
    `target`: the types of the roots and of all nodes that fulfil `ends`, if the edges are of the given `kinds`;
    then a hop only goes to types from which the target can still be reached in the hops that are left.
    """
    steps = None if start else cut_lineage(undirected(edges).distinct())
    front = roots.select("payment_id", "node", F.col("node").alias("path")).distinct()
    levels = [front.withColumn("depth", F.lit(0))]
    types, ways = {start}, ways_of(kinds)
    far = hops_to(ways, target) if start else {}
    for hop in range(1, depth + 1):
        if start:
            used = [w for w in ways if w[1] in types and far.get(w[2], depth) <= depth - hop]
            if not used:
                break
            types = {w[2] for w in used}
            steps = steps_along(edges, used, ["payment_id"])
        if hop == depth:
            steps = steps.where(F.expr(ends.replace("node", "dst")))
        front = front.withColumnRenamed("node", "src").join(shuffled(steps), ["payment_id", "src"]).select(
            "payment_id", F.col("dst").alias("node"), F.concat_ws(" > ", "path", "dst").alias("path")).groupBy("payment_id", "node").agg(F.min("path").alias("path"))
        if hop < depth:
            front = cut_lineage(front)
        levels.append(front.withColumn("depth", F.lit(hop)))
    best = union(levels).where(ends).groupBy("payment_id", "node").agg(F.min(F.struct("depth", "path")).alias("best"))
    return best.select("payment_id", "node", "best.depth", "best.path")


PAIR = ["payment_id", "source", "target"]


def path_between(edges: DataFrame, pairs: DataFrame, depth: int = MAX_DEPTH, types: tuple[str, str] | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Shortest path between two given nodes of a payment: depth, path and exhausted for each of `pairs`.

    `pairs`: payment_id, source, target. The search goes out from both ends in turn, one hop at a time and only from
    the nodes that were new in the last one, and a pair is done where its two sides meet or one side has no new nodes;
    so each side is half as deep as the path. Of equally short paths the alphabetically first is given. Where there is none of at most
    `depth` hops, depth and path are null, and `exhausted` tells whether that is final: one side has run out of new
    nodes. Nothing is cut off but by `depth`. `types`: those of all sources and of all targets, if the edges are of
    the given `kinds`.
    """
    steps = None if types else cut_lineage(undirected(edges).distinct())
    at, ways = [{t} for t in types or ()], ways_of(kinds)
    pairs = cut_lineage(pairs.select(*PAIR).distinct())
    sides = [
        pairs.select(*PAIR, F.col(end).alias("node"), text.alias("text")) for end, text in (("source", F.col("source")), ("target", F.lit("")))]
    seen, front = list(sides), list(sides)
    found, open_pairs = None, pairs
    for hop in range(depth + 1):
        i = (hop + 1) % 2  # hop 0 only looks for pairs of a node and itself
        if hop:
            onward = F.concat_ws(" > ", "text", "dst") if i == 0 else F.concat(F.lit(" > "), F.col("node"), F.col("text"))
            if types:
                used = [w for w in ways if w[1] in at[i]]
                at[i] = {w[2] for w in used}
                steps = steps_along(edges, used, ["payment_id"])
            new = front[i].join(open_pairs, PAIR, "left_semi").withColumnRenamed("node", "src").join(shuffled(steps), ["payment_id", "src"]).withColumnRenamed("src", "node").select(
                *PAIR, F.col("dst").alias("to"), onward.alias("text")).withColumnRenamed("to", "node")
            new = new.groupBy(*PAIR, "node").agg(F.min("text").alias("text")).join(seen[i].select(*PAIR, "node"), [*PAIR, "node"], "left_anti")
            front[i] = cut_lineage(new)
            seen[i] = seen[i].unionByName(front[i])
        other = seen[1 - i].select(*PAIR, "node", F.col("text").alias("rest"))
        whole = F.concat("text", "rest") if i == 0 else F.concat("rest", "text")
        met = cut_lineage(front[i].join(other, [*PAIR, "node"]).groupBy(*PAIR).agg(F.min(whole).alias("path")).withColumn("depth", F.lit(hop).cast("bigint")))
        found = met if found is None else found.unionByName(met)
        open_pairs = open_pairs.join(met, PAIR, "left_anti")
        if hop:  # a side without new nodes has none in later hops either
            open_pairs = open_pairs.join(front[i], PAIR, "left_semi")
        open_pairs = cut_lineage(open_pairs)
        if open_pairs.isEmpty() or hop and front[i].isEmpty():
            break
    alive = reduce(lambda a, b: a.join(b, PAIR, "left_semi"), [f.select(*PAIR).distinct() for f in front])
    return pairs.join(found, PAIR, "left").join(alive.withColumn("alive", F.lit(True)), PAIR, "left").select(
        *PAIR, "depth", "path", (F.col("depth").isNull() & F.col("alive").isNull()).alias("exhausted"))


def edges_for_payment(relationships: DataFrame, observations: DataFrame) -> DataFrame:
    """Relationships with either end in the payment's evidence; two equi-joins instead of an OR."""
    own = observations.filter("subject_type = 'payment'").select(F.col("subject_id").alias("payment_id"), "evidence_id")
    cols = ["payment_id", "source_id", "target_id", "relationship_type"]
    a = relationships.join(shuffled(own.withColumnRenamed("evidence_id", "source_id")), "source_id").select(*cols)
    b = relationships.join(shuffled(own.withColumnRenamed("evidence_id", "target_id")), "target_id").select(*cols)
    return a.unionByName(b).distinct()


def with_owners(events: DataFrame) -> DataFrame:
    """Adds `owners`: the payments of an event id with their observations; one, unless different events share the id."""
    own = F.filter("slots", lambda x: x < FIRST_ORDER_SLOT)
    owner = F.when(F.col("payment_id") != "", F.struct("payment_id", F.transform(own, lambda x: F.col("event_id") * 16 + x).alias("evidence")))
    return slots_of(events).withColumn("owners", F.collect_set(owner).over(Window.partitionBy("event_id"))).drop("slots")


def edges_of_owners(relationships: DataFrame) -> DataFrame:
    """`edges_for_payment` for relationships with the event_id and `owners` of their event, where the rows of an event id lie in one task."""
    each = relationships.select("event_id", "source_id", "target_id", "relationship_type", F.explode("owners").alias("o"))
    mine = each.where(F.array_contains("o.evidence", F.col("source_id")) | F.array_contains("o.evidence", F.col("target_id")))
    return mine.select("event_id", "o.payment_id", "source_id", "target_id", "relationship_type").distinct().drop("event_id")


#: Observations of one delivery have ids of one block of so many.
BLOCK = 16


def dependencies(relationships: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Direct and indirect dependencies of every observation, over at most 1 + depth hops.

    Dependencies stay inside one delivery, whose observations have at most BLOCK ids. So the targets of each are
    bits of one number, edges are added up before they move, and a delivery is searched in one row. An edge that
    leaves its delivery fails the job.
    """
    rel = relationships.filter(F.col("relationship_type").isin("DEPENDS_ON", "DERIVED_FROM", "SAME_EVENT", "SAME_SOURCE"))
    block = lambda c: F.expr(f"{c} - pmod({c}, {BLOCK})")
    bit = F.when(block("source_id") == block("target_id"), F.expr(f"shiftleft(1, cast(pmod(target_id, {BLOCK}) as int))")).otherwise(
        F.raise_error(F.lit("a dependency leaves its delivery")).cast("int"))
    direct = rel.where("source_id IS NOT NULL AND target_id IS NOT NULL").groupBy(F.col("source_id").alias("evidence_id")).agg(
        F.count("*").alias("direct_edges"), F.bit_or(bit).alias("near"))
    per = direct.groupBy(block("evidence_id").alias("g")).agg(F.collect_list(F.struct(
        F.expr(f"cast(pmod(evidence_id, {BLOCK}) as int)").alias("at"), "direct_edges", "near", F.col("near").alias("far"))).alias("m"))
    # each round is one hop more: the targets of all that is reached so far; one expression, since nested ones multiply
    per = per.select("g", F.expr(f"""aggregate(array_repeat(0, {int(depth)}), m, (all, i) -> transform(all, a -> named_struct(
        'at', a.at, 'direct_edges', a.direct_edges, 'near', a.near,
        'far', aggregate(all, a.far, (seen, b) -> IF(shiftright(a.far, b.at) & 1 = 1, seen | b.near, seen)))))""").alias("m"))
    found = per.select("g", F.explode("m").alias("x")).select(
        (F.col("g") + F.col("x.at")).alias("evidence_id"), "x.direct_edges", F.bit_count("x.near").cast("bigint").alias("direct_targets"),
        # an observation is not reachable from itself
        F.expr("cast(bit_count(x.far & ~shiftleft(1, x.at)) as bigint)").alias("reachable"))
    return found.where("reachable > 0").select(
        "evidence_id", "direct_edges", "direct_targets", (F.col("reachable") - F.col("direct_targets")).alias("indirect_targets"))


def provenance_steps(payment_obs: DataFrame, payment_events: DataFrame, events: DataFrame) -> DataFrame:
    """Evidence -> event -> webhook -> payment, one row per existing step."""
    pe = payment_events.select("payment_event_id", "event_type")
    we = events.select(F.col("event_id").alias("webhook_event_id"), "provider_event_id")
    j = payment_obs.select("payment_id", "evidence_id", "evidence_type", "payment_event_id", "webhook_event_id").join(
        pe, "payment_event_id", "left").join(we, "webhook_event_id", "left")
    step = lambda i, kind, ref: F.when(ref.isNotNull(), F.struct(F.lit(i).alias("step"), F.lit(kind).alias("kind"), ref.cast("string").alias("reference")))
    steps = F.array_compact(F.array(
        step(1, "EVIDENCE", F.col("evidence_type")), step(2, "PAYMENT_EVENT", F.col("event_type")),
        step(3, "WEBHOOK", F.col("provider_event_id")), step(4, "PAYMENT", F.col("payment_id"))))
    return j.select("evidence_id", F.explode(steps).alias("s")).select("evidence_id", "s.*")


def conflict_paths(status_conflicts: DataFrame, claim_rows: DataFrame) -> DataFrame:
    """Conflict -> each of its claims -> supporting evidence."""
    sides = status_conflicts.select(
        "payment_id", F.concat_ws("-", "claim_a_id", "claim_b_id").alias("conflict_id"),
        F.explode(F.array(F.struct(F.lit("A").alias("side"), F.col("claim_a_id").alias("claim_id")),
                          F.struct(F.lit("B").alias("side"), F.col("claim_b_id").alias("claim_id")))).alias("x"))
    return sides.select("payment_id", "conflict_id", "x.*").join(shuffled(claim_rows.select("claim_id", "evidence_id")), "claim_id")


# --- lineage -----------------------------------------------------------------------------------------

ROLES = {
    "TRIGGERED": "DIRECT_CAUSE", "PRODUCED": "DIRECT_CAUSE", "REPRESENTS": "DERIVED_FROM", "SUPPORTS": "CONTRIBUTING_INPUT",
    "MEASURED_BY": "CONTEXT", "CORROBORATED_BY": "CORROBORATION_INPUT", "CONFLICTED_BY": "CONFLICT_INPUT",
    "EVALUATED_BY": "CONTRIBUTING_INPUT", "MIRRORS": "DERIVED_FROM", "STATE_TRANSITION": "CONTRIBUTING_INPUT",
    "CAUSED_STATE_CHANGE": "DIRECT_CAUSE", "RECONCILED_INTO": "DERIVED_FROM",
}


def lineage_edges(payment_events: DataFrame, fact_rows: DataFrame, claim_rows: DataFrame, decisions: DataFrame,
                  status_conflicts: DataFrame, members: DataFrame, snapshots: DataFrame, changes: DataFrame) -> DataFrame:
    """Forward lineage from deliveries to traces, one projection or join per edge type.

    `decisions`: payment_id, fact_hash with at least one SAME_FACT decision; `snapshots`:
    payment_id, eval_us, trace_id (NULL where none was recorded); `changes`: payment_id, eval_us,
    p_eval_us, dimension, direct_cause, causality.
    """
    pc = claim_rows.filter("subject_type = 'payment'").withColumn("payment_id", F.col("subject_id"))
    obs, fact, claim = node("obs", "evidence_id"), node("fact", "fact_hash"), node("claim", "claim_id")
    status = status_conflicts.withColumn("c", F.concat_ws("-", "claim_a_id", "claim_b_id"))
    sets = members.withColumn("c", F.concat_ws("-", "payment_id", "claim_type"))
    at = lambda prefix, col="eval_us": node(prefix, F.concat_ws("@", "payment_id", F.col(col).cast("string")))
    change = node("chg", F.concat_ws("@", "payment_id", F.col("eval_us").cast("string"), "dimension"))
    # an observation causes the one evidence change whose interval it falls into
    caused = fact_rows.select("payment_id", "evidence_id", "observed_us").join(
        shuffled(changes.filter("dimension = 'EVIDENCE' AND direct_cause = 'NEW_EVIDENCE' AND causality = 'DIRECT'")), "payment_id").filter(
        "observed_us > p_eval_us AND observed_us <= eval_us")
    edges = union([
        edge(payment_events, node("hook", "webhook_event_id"), node("evt", "payment_event_id"), "TRIGGERED"),
        edges_of(fact_rows, (node("hook", "webhook_event_id"), obs, "PRODUCED"), (obs, fact, "REPRESENTS"),
                 (obs, node("quality", "evidence_id"), "MEASURED_BY")),
        edge(pc, obs, claim, "SUPPORTS"),
        edge(pc.select("payment_id", "claim_id").distinct(), claim, node("corr", "claim_id"), "CORROBORATED_BY"),
        edges_of(status, (node("claim", "claim_a_id"), node("conf", "c"), "CONFLICTED_BY"), (node("claim", "claim_b_id"), node("conf", "c"), "CONFLICTED_BY")),
        edge(sets, claim, node("conf", "c"), "CONFLICTED_BY"),
        edges_of(snapshots, (at("integrity"), node("trace", "trace_id"), "EVALUATED_BY"), (at("state"), at("integrity"), "MIRRORS")),
        edges_of(changes, (at("state", "p_eval_us"), change, "STATE_TRANSITION"), (change, at("state"), "STATE_TRANSITION")),
        edge(caused, obs, change, "CAUSED_STATE_CHANGE"), edge(decisions, node("rec", "fact_hash"), fact, "RECONCILED_INTO"),
    ])
    return edges.select("*", lookup("edge_type", ROLES).alias("causal_role"), F.lit("FOREIGN_KEY").alias("linkage_type"))


def ends(edges: DataFrame) -> DataFrame:
    """Both ends of every edge in one pass over the edges."""
    return edges.select("payment_id", F.explode(F.array("src", "dst")).alias("node"))


def lineage_nodes(edges: DataFrame) -> DataFrame:
    return ends(edges).distinct().withColumn("node_type", F.substring_index("node", ":", 1))


def lineage_completeness(payments: DataFrame, evidence: DataFrame, facts: DataFrame, claims: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Which links of the chain exist per payment, from one count per layer."""
    c = lambda df, name: df.groupBy("payment_id").agg(F.count("*").alias(name))
    s = snapshots.groupBy("payment_id").agg(F.count("*").alias("n_integrity"), F.count("trace_id").alias("n_trace"))
    n = lambda x: F.coalesce(F.col(x), F.lit(0).cast("bigint"))
    j = payments.select("payment_id").join(evidence.select("payment_id", F.col("evidence_count").alias("n_obs")), "payment_id", "left").join(
        c(facts, "n_facts"), "payment_id", "left").join(c(claims, "n_claims"), "payment_id", "left").join(s, "payment_id", "left")
    cols = ("n_obs", "n_facts", "n_claims", "n_integrity", "n_trace")
    gaps = n("n_integrity") - n("n_trace")
    return j.select(
        "payment_id", *[n(x).alias(x) for x in cols], F.when(n("n_integrity") == 0, 1).otherwise(gaps).alias("gaps"),
        F.when((n("n_obs") == 0) | (n("n_integrity") == 0), "BROKEN")
        .when((n("n_facts") == 0) | (n("n_claims") == 0) | (n("n_trace") == 0) | (gaps > 0), "PARTIAL").otherwise("COMPLETE").alias("completeness"))
