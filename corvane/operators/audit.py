"""Audit events: classes, payload rules, canonical hashes, chains, anchors, replay."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Payload keys that may be kept.
PAYLOAD_KEYS = ("requestId", "traceId", "policyVersion", "reasonCode", "entityType", "entityCount", "resultCode", "obligation", "contentDomain", "durationMs")
GENESIS = ""


def classify_event(df: DataFrame) -> DataFrame:
    """category from words in action and resource_type; the first that fits counts."""
    action, resource = F.upper("action"), F.upper("resource_type")
    auth = F.when(action.contains("Z") | action.contains("POLICY"), "AUTHORIZATION").otherwise("AUTHENTICATION")
    category = (
        F.when(action.contains("AUTH"), auth).when(action.contains("EXPORT") | action.contains("DEID"), "PHI_SAFETY").when(resource.contains("AUDIT") | resource.contains("POLICY"), "GOVERNANCE")
        .when(resource.contains("DATA") | resource.contains("DOCUMENT") | resource.contains("VIEW"), "DATA_ACCESS").otherwise("SYSTEM")
    )
    return df.withColumn("category", category)


def validate_payload(df: DataFrame, keys: tuple[str, ...] = PAYLOAD_KEYS) -> DataFrame:
    """payload (map): kept is the part with allowed keys; valid if nothing else was
    there and each value is non-blank, one line and at most 256 characters."""
    allowed = ", ".join(f"'{k}'" for k in keys)
    out = df.withColumn("kept", F.expr(f"map_filter(payload, (k, v) -> k in ({allowed}))"))
    safe = (
        "coalesce(trim(e.value) <> '' and length(e.value) <= 256 and not contains(e.value, chr(10)) and not contains(e.value, "
        "chr(13)), false)"
    )
    return out.withColumn("valid", F.expr(f"size(kept) = size(payload) and forall(map_entries(payload), e -> {safe})"))


def _json(value: str) -> str:
    """SQL for a JSON string of a column: short escapes where there are any, hex ones for
    other control characters."""
    escapes = [("\\\\", "\\\\\\\\"), ('"', '\\\\"')]
    out = value
    for a, b in escapes:
        out = f"replace({out}, '{a}', '{b}')"
    for code in range(32):
        short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}.get(code, f"u{code:04x}")
        out = f"replace({out}, chr({code}), '\\\\{short}')"
    return f"concat('\"', if({value} rlike '[\\\\x00-\\\\x1F\"\\\\\\\\]', {out}, {value}), '\"')"


_FIELDS = (("eventId", "event_id"), ("timestamp", "occurred_at"), ("actor", "actor"), ("category", "category"), ("role", "role"), ("action", "action"), ("resourceType", "resource_type"), ("resourceId", "resource_id"), ("outcome", "outcome"))


def canonical_hash(df: DataFrame) -> DataFrame:
    """payload_json with sorted keys, payload_hash, unsealed (all fields in their fixed
    order as JSON, up to the payload's hash; no comma stands before the payload) and
    event_hash: the SHA-256 of the event that follows prev_hash, a column or none."""
    payload = f"concat('{{', array_join(transform(array_sort(map_entries(payload)), e -> concat({_json('e.key')}, ':', {_json('e.value')})), ','), '}}')"
    out = df.withColumn("payload_json", F.expr(payload)).withColumn("payload_hash", F.sha2("payload_json", 256))
    fields = ", ',', ".join(f"'\"{name}\":', {_json(f'cast({c} as string)')}" for name, c in _FIELDS)
    out = out.withColumn("unsealed", F.expr(f"concat('{{', {fields}, '\"payload\":', payload_json, ',\"payloadHash\":\"', payload_hash, '\"')"))
    before = F.coalesce("prev_hash", F.lit(GENESIS)) if "prev_hash" in df.columns else F.lit(GENESIS)
    return out.withColumn("event_hash", F.sha2(sealed_text(before), 256))


def sealed_text(previous: Column) -> Column:
    """The canonical event with the hash of the event before it."""
    return F.concat("unsealed", F.lit(',"previousHash":"'), previous, F.lit('"}'))


def transport_check(df: DataFrame) -> DataFrame:
    """reason (null if accepted): the payload hash must be the sent one, and no chain
    field may be set yet."""
    return df.withColumn("reason", F.when(F.col("payload_hash") != F.col("sent_hash"), "PAYLOAD_HASH").when((F.coalesce("prev_hash", F.lit("")) != "") | (F.coalesce("hash", F.lit("")) != ""), "CHAIN_FIELDS"))


def dedupe_events(df: DataFrame, key: str = "event_id", order: tuple[str, ...] = ("occurred_at",)) -> DataFrame:
    """The first row of each key. Works as a partial aggregate, so a key that repeats
    often is reduced before the shuffle."""
    rest = [c for c in df.columns if c != key and c not in order]
    least = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return least.select(key, *(F.col(f"_first.{c}").alias(c) for c in (*order, *rest))).select(*df.columns)


def seal_chain(df: DataFrame, chain_key: str, order: str = "seq") -> DataFrame:
    """prev_hash and hash of each event (with its unsealed text) of a chain, in order. A
    chain is a sequence by its nature; its rows stream through one task in batches of
    which only the last hash is kept, so its length costs no memory. Chains run in parallel."""

    def seal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, prev = None, GENESIS
        for rows in batches:
            before, after = [], []
            for own, text in zip(rows[chain_key].tolist(), rows["unsealed"], strict=True):
                if own != chain:
                    chain, prev = own, GENESIS
                before.append(prev)
                prev = hashlib.sha256(f'{text},"previousHash":"{prev}"}}'.encode()).hexdigest()
                after.append(prev)
            yield rows.assign(prev_hash=before, hash=after)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", prev_hash string, hash string"
    return df.repartition(chain_key).sortWithinPartitions(chain_key, order).mapInPandas(seal, schema)


def chain_breaks(df: DataFrame, chain_key: str, order: str = "seq") -> DataFrame:
    """Each event with expected values beside it; fully parallel over a chain's rows."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(chain_key).orderBy(order)), F.lit(GENESIS))
    out = df.withColumn("expected_prev", before)
    own = F.sha2(sealed_text(F.col("prev_hash")), 256)
    return out.withColumn("problem", F.when(F.col("prev_hash") != F.col("expected_prev"), "PREVIOUS_HASH").when(F.col("hash") != own, "HASH"))


def verify_chain(df: DataFrame, chain_key: str, order: str = "seq") -> DataFrame:
    """Per chain: rows checked, and the first broken row's order and reason."""
    broken = F.col("problem").isNotNull()
    return chain_breaks(df, chain_key, order).groupBy(chain_key).agg(F.count("*").alias("checked"), F.min(F.when(broken, F.col(order))).alias("broken_at"), F.min_by("problem", F.when(broken, F.col(order))).alias("reason"))


def anchors(df: DataFrame, chain_key: str, order: str = "seq") -> DataFrame:
    """Per chain: last hash and length."""
    return df.groupBy(chain_key).agg(F.max_by("hash", order).alias("last_hash"), F.count("*").alias("length"))


def integrity_edges(checks: DataFrame) -> DataFrame:
    """Checks (chain, checked_at, ok) at which a failure is new."""
    before = F.lag("ok").over(Window.partitionBy("chain").orderBy("checked_at"))
    return checks.withColumn("alert", ~F.col("ok") & F.coalesce(before, F.lit(True))).where("alert").drop("alert")


def transport_metrics(df: DataFrame, width: str = "1 hour") -> DataFrame:
    """Per window of event time: processed, duplicates (a repeated id within the
    window), dead letters, largest lag in seconds."""
    out = df.groupBy(F.window("ts", width).alias("w")).agg(
        F.count_if(F.col("reason").isNull()).alias("processed"), (F.count("event_id") - F.countDistinct("event_id")).alias("duplicates"),
        F.count_if(F.col("reason").isNotNull()).alias("dead_letters"), F.max("lag_s").alias("max_lag_s"),
    )
    return out.select(F.col("w.start").alias("window_start"), "processed", "duplicates", "dead_letters", "max_lag_s")


def replay_after(df: DataFrame, last: DataFrame, n: int, max_bytes: int) -> DataFrame:
    """Events (session, event_id, bytes) behind each session's last seen id: at most
    n, and as long as their bytes add up to no more than max_bytes."""
    w = Window.partitionBy("session").orderBy("event_id")
    behind = df.join(last, "session").where("event_id > last_id")
    counted = behind.withColumn("place", F.row_number().over(w)).withColumn("total", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return counted.where((F.col("place") <= n) & (F.col("total") <= max_bytes)).select("session", "event_id", "place")
