"""Role projections, row policies, schema drift and policy decisions over tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import signals

#: Rows up to which a configuration table is broadcast.
MOST_RULES = 100_000


def project_for_role(df: DataFrame, classes: dict[str, str], role: str, grants: dict[str, tuple[str, ...]]) -> DataFrame:
    """The columns whose class the role may see; unclassified columns are hidden."""
    allowed = grants.get(role, ())
    return df.select(*(c for c in df.columns if classes.get(c) in allowed))


def rows_for_role(df: DataFrame, policy: DataFrame, role: str) -> DataFrame:
    """Rows whose content_domain the policy (role, content_domain) opens to the role;
    no entry, no row."""
    return df.join(policy.where(F.col("role") == role).select("content_domain"), "content_domain", "left_semi")


def schema_drift(observed: DataFrame, declared: DataFrame, exempt: DataFrame) -> DataFrame:
    """observed (batch, relation, column) against declared (relation, column): MISSING
    or UNDECLARED, or EXEMPT where a glob (relation, pattern) fits an undeclared one."""
    relations = observed.select("batch", "relation").distinct()
    wanted = relations.join(declared.select("relation", "column").distinct(), "relation").withColumn("declared", F.lit(True))
    seen = observed.distinct().withColumn("seen", F.lit(True))
    both = wanted.join(seen, ["batch", "relation", "column"], "full_outer")
    drift = both.where("declared is null or seen is null")
    globs = exempt.select("relation", F.concat(F.lit("^"), F.replace(F.replace("pattern", F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$")).alias("regex"))
    fits = drift.where("declared is null").join(globs, "relation").where("`column` rlike regex").select("batch", "relation", "column").distinct().withColumn("free", F.lit(True))
    out = drift.join(fits, ["batch", "relation", "column"], "left")
    return out.select("batch", "relation", "column", F.when(F.col("free"), "EXEMPT").when(F.col("seen").isNull(), "MISSING").otherwise("UNDECLARED").alias("drift"))


def decide(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """requests (id, role, action, resource, attributes map) x rules (place, role, action,
    resource, obligations, required map): ALLOW by the first rule by place whose required
    attributes have the request's values; else DENY, with UNDECLARED for a role, action
    or resource that no rule names, or NO_RULE. Rules are a configuration table."""
    small = rules.count() <= MOST_RULES
    near = F.broadcast if small else lambda table: table
    for c in ("role", "action", "resource"):
        requests = requests.join(near(rules.select(c).distinct().withColumn(f"_{c}", F.lit(True))), c, "left")
    declared = F.col("_role").isNotNull() & F.col("_action").isNotNull() & F.col("_resource").isNotNull()
    joined = requests.withColumn("declared", declared).join(near(rules), ["role", "action", "resource"], "left")
    joined = joined.withColumn("ok", F.expr("place is not null and forall(map_entries(required), e -> coalesce(attributes[e.key] = e.value, false))"))
    best = joined.groupBy("id").agg(F.min_by("obligations", F.when(F.col("ok"), F.col("place"))).alias("obligations"), F.bool_or("ok").alias("ok"), F.first("declared").alias("declared"))
    reason = F.when(~F.col("declared"), "UNDECLARED").when(F.col("ok"), "RULE").otherwise("NO_RULE")
    return best.select("id", F.when(F.col("ok"), "ALLOW").otherwise("DENY").alias("decision"), reason.alias("reason"), "obligations")


def allowed_tools(requests: DataFrame, tools: DataFrame) -> DataFrame:
    """requests (id, role, query_class, question) x tools (tool, role, query_class,
    aggregate_only): tools open to each request, sorted; aggregate-only ones need an
    aggregation word anywhere in the question; out of scope or of an unknown class, none.
    Tools are a configuration table."""
    text = F.lower(F.coalesce("question", F.lit("")))
    asks = functools.reduce(lambda a, b: a | b, (text.contains(w) for w in signals.AGGREGATION))
    open_ = requests.where("query_class not in ('OUT_OF_SCOPE', 'UNKNOWN')").withColumn("asks", asks)
    fit = open_.join(F.broadcast(tools) if tools.count() <= MOST_RULES else tools, ["role", "query_class"]).where("asks or not aggregate_only")
    found = fit.groupBy("id").agg(F.array_sort(F.collect_set("tool")).alias("tools"))
    return requests.select("id").join(found, "id", "left").withColumn("tools", F.coalesce("tools", F.array().cast("array<string>")))
