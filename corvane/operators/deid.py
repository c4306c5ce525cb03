"""De-identification and content scanning."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One pattern for each entity type.
PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "URL": r"(?i)\bhttps?://[^\s<>\"]+",
    "PHONE": r"\b(?:\+?1[-.\s]?)?(?:\(\d{3}\)|\d{3})[-.\s]\d{3}[-.\s]\d{4}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "IP_ADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "MRN": r"(?i)\b(?:MRN|MR#|Medical Record (?:Number|No)|Patient (?:ID|Number)|Pt\.?\s*ID)[:#\s-]*[A-Za-z0-9][A-Za-z0-9-]{3,}\b",
    "ACCOUNT_NUMBER": r"(?i)\b(?:account|acct|FIN)\s*(?:number|no\.?|#)?\s*[:#-]?\s*[A-Za-z0-9-]{4,}\b",
    "ENCOUNTER_ID": r"(?i)\b(?:encounter|visit|CSN)\s*(?:number|no\.?|#)?\s*[:#-]?\s*[A-Za-z0-9-]{4,}\b",
    "DEVICE_ID": r"(?i)\b(?:device|serial|UDI)\s*(?:serial|number|no\.?|id|#)?\s*[:#-]?\s*[A-Za-z0-9-]{5,}\b",
    "FACILITY": r"\b(?:[A-Z][A-Za-z0-9&'/-]*\s+){0,6}(?:Hospital|Medical Center|Clinic|Health System|Healthcare)\b",
    "ZIP": r"\b\d{5}(?:-\d{4})?\b",
    "DATE": r"(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}|(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2},\s+\d{4})\b",
    "AGE": r"(?i)\b(?:age\s*[:=]?\s*)?\d{1,3}(?:\s*[- ]?year[- ]old|\s*y/o|\s*years?\s*old)\b",
}
#: Names of types that have another name here.
_ALIASES = {"EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "US_SSN": "SSN", "US_ZIP_CODE": "ZIP", "DATE_TIME": "DATE"}
#: Three-digit zip areas with few residents.
SMALL_ZIPS = ("036", "059", "063", "102", "203", "556", "692", "821", "823", "878", "879", "884")
SCORE = 0.95
#: What a text must hold for a pattern to fit, so that most texts are searched for few.
_NEEDS = {
    "EMAIL": ("@",), "URL": ("://",), "MRN": ("mr", "medical record", "patient", "pt"), "ACCOUNT_NUMBER": ("acc", "fin"), "ENCOUNTER_ID": ("encounter", "vi\u017fit", "visit", "csn"),
    "DEVICE_ID": ("device", "\u017ferial", "serial", "udi"), "FACILITY": ("hospital", "medical center", "clinic", "health system", "healthcare"),
}
_DIGITS = ("PHONE", "SSN", "IP_ADDRESS", "ZIP", "DATE", "AGE")
SPANS = "array<struct<entity_type:string,start:int,stop:int,score:double,text:string>>"


def resolve(spans: list[tuple]) -> list[tuple]:
    """Of overlapping spans the earliest, then longest, then best, then by type."""
    out, end = [], -1
    for s in sorted(spans, key=lambda s: (s[1], -(s[2] - s[1]), -s[3], s[0])):
        if s[2] > s[1] and s[1] >= end:
            out.append(s)
            end = s[2]
    return out


def detect_entities(df: DataFrame, column: str, overlaps: bool = False) -> DataFrame:
    """spans of all pattern types, in code points; overlaps resolved unless kept."""
    patterns = {k: re.compile(p) for k, p in PATTERNS.items()}

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        def one(text):
            low = (text or "").lower()
            digits = re.search(r"\d", low) is not None
            fit = [k for k in patterns if (digits if k in _DIGITS else any(x in low for x in _NEEDS[k]))]
            found = [(k, m.start(), m.end(), SCORE, m[0]) for k in fit for m in patterns[k].finditer(text)]
            found = found if overlaps else resolve(found)
            return [dict(zip(("entity_type", "start", "stop", "score", "text"), s, strict=True)) for s in found]

        return texts.map(one)

    return df.withColumn("spans", find(column))


def resolve_overlaps(df: DataFrame) -> DataFrame:
    """The same rule on a column of spans, without Python."""
    order = (
        "(a, b) -> case when a.start <> b.start then sign(a.start - b.start) when a.stop <> b.stop then sign(b.stop - a.stop) "
        "when a.score <> b.score then sign(b.score - a.score) when a.entity_type < b.entity_type then -1 when a.entity_type > "
        "b.entity_type then 1 else 0 end"
    )
    order = order.replace("sign(", "int(sign(")
    order = re.sub(r"int\(sign\(([^()]*)\)", r"int(sign(\1))", order)
    return df.withColumn("spans", F.expr(f"aggregate(array_sort(filter(spans, s -> s.stop > s.start), {order}), struct(cast(array() as {SPANS}) as kept, -1 as last), (acc, s) -> if(s.start >= acc.last, struct(concat(acc.kept, array(s)) as kept, s.stop as last), acc), acc -> acc.kept)"))


def canonical_type(column: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for p in _ALIASES.items() for x in p))[F.upper(column)], F.upper(column))


def _rebuild(text: str, value: str) -> Column:
    """text with each span replaced by an expression of s."""
    step = f"struct(concat(acc.done, substring({text}, acc.at + 1, s.start - acc.at), {value}) as done, s.stop as at)"
    return F.expr(f"aggregate(spans, struct('' as done, 0 as at), (acc, s) -> {step}, acc -> concat(acc.done, substring({text}, acc.at + 1)))")


def redact(df: DataFrame, column: str = "text") -> DataFrame:
    """Spans become [TYPE]."""
    return df.withColumn(column, _rebuild(column, "'[', s.entity_type, ']'"))


def hmac_sha256(message: str, key: bytes) -> str:
    """SQL for the hex HMAC of a message; the pads are literals."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in key).hex() for x in (0x36, 0x5C))
    return f"sha2(concat(unhex('{outer}'), unhex(sha2(concat(unhex('{inner}'), encode({message}, 'UTF-8')), 256))), 256)"


#: Month names.
_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def date_sql(text: str, key: str, salt: bytes) -> str:
    """SQL: a date moved by -365 to 365 days that the key fixes, in its own style (month
    and day first or year first with slashes or dashes, two- or four-digit years, long or
    short month names, May being long); without a key its year; what is no date gives its first
    four-digit year, or [DATE]."""
    names = "|".join([*_MONTHS, *(m[:3] for m in _MONTHS)])
    american = r"'^(\\d{1,2})([/-])(\\d{1,2})([/-])(\\d{4}|\\d{2})$'"
    iso, worded = r"'^(\\d{4})([/-])(\\d{1,2})([/-])(\\d{1,2})$'", rf"'(?i)^({names})\\s+(\\d{{1,2}}),\\s+(\\d{{4}})$'"
    part = lambda pattern, i: f"regexp_extract({text}, {pattern}, {i})"
    month = "element_at(map(" + ", ".join(f"'{m[:3].lower()}', '{i + 1:02d}'" for i, m in enumerate(_MONTHS)) + f"), lower(substring({part(worded, 1)}, 1, 3)))"
    year = f"case when length({part(american, 5)}) = 4 then {part(american, 5)} when {part(american, 5)} >= '69' then concat('19', {part(american, 5)}) else concat('20', {part(american, 5)}) end"
    parsed = (
        f"try_to_date(case when {part(american, 2)} <> '' and {part(american, 2)} = {part(american, 4)} then concat({year}, '-', lpad({part(american, 1)}, 2, '0'), '-', lpad({part(american, 3)}, 2, '0')) "
        f"when {part(iso, 2)} <> '' and {part(iso, 2)} = {part(iso, 4)} then concat({part(iso, 1)}, '-', lpad({part(iso, 3)}, 2, '0'), '-', lpad({part(iso, 5)}, 2, '0')) "
        f"when {part(worded, 1)} <> '' then concat({part(worded, 3)}, '-', {month}, '-', lpad({part(worded, 2)}, 2, '0')) end, 'yyyy-MM-dd')"
    )
    days = f"cast(cast(conv(substring({hmac_sha256(f"concat('date-shift:', {key})", salt)}, 1, 8), 16, 10) as bigint) % 731 - 365 as int)"
    moved = f"date_add({parsed}, {days})"
    shown = (
        f"case when {part(american, 2)} <> '' then date_format({moved}, concat('MM', {part(american, 2)}, 'dd', {part(american, 2)}, if(length({part(american, 5)}) = 4, 'yyyy', 'yy'))) "
        f"when {part(iso, 2)} <> '' then date_format({moved}, concat('yyyy', {part(iso, 2)}, 'MM', {part(iso, 2)}, 'dd')) "
        f"else date_format({moved}, if(length({part(worded, 1)}) = 3 and lower({part(worded, 1)}) <> 'may', 'MMM dd, yyyy', 'MMMM dd, yyyy')) end"
    )
    alone = rf"coalesce(nullif(regexp_extract({text}, '\\b(\\d{{4}})\\b', 1), ''), '[DATE]')"
    return f"case when {parsed} is null then {alone} when {key} is null then lpad(cast(year({parsed}) as string), 4, '0') else {shown} end"


def age_sql(text: str) -> str:
    """SQL: 90+ for a span whose number is over 89, else the span."""
    return rf"if(try_cast(regexp_extract({text}, '\\b(\\d{{1,3}})\\b', 1) as int) > 89, '90+', {text})"


def zip_sql(text: str) -> str:
    """SQL: the first three of five digits; 000 for small areas and without five digits."""
    five = rf"regexp_extract({text}, '\\d{{5}}', 0)"
    return f"if({five} = '' or substring({five}, 1, 3) in ({', '.join(repr(z) for z in SMALL_ZIPS)}), '000', substring({five}, 1, 3))"


def surrogate(df: DataFrame, salt: bytes, column: str = "text", key_column: str | None = None) -> DataFrame:
    """Spans by type: dates moved by the document's key (key_column, else its first
    record-like span), ages over 89 capped, zips cut to their area; all others become TYPE_
    and 16 hex digits that depend on type, value and salt only."""
    given = F.col(key_column) if key_column else F.lit(None).cast("string")
    keyed = context_key(df.withColumn("_given", given), "_given")
    kind = "coalesce(element_at(map(" + ", ".join(f"'{x}'" for p in _ALIASES.items() for x in p) + "), upper(s.entity_type)), upper(s.entity_type))"
    digest = hmac_sha256(f"concat({kind}, ':', s.text)", salt)
    value = (
        f"case {kind} when 'DATE' then {date_sql('s.text', 'context_key', salt)} when 'AGE' then {age_sql('s.text')} when 'ZIP' then {zip_sql('s.text')} "
        f"else concat({kind}, '_', substring({digest}, 1, 16)) end"
    )
    return keyed.withColumn(column, _rebuild(column, value)).drop("_given", "context_key")


def shift_dates(df: DataFrame, column: str, key_column: str, salt: bytes) -> DataFrame:
    """shifted: date_sql of a column; an empty key is none."""
    return df.withColumn("shifted", F.expr(date_sql(column, f"nullif({key_column}, '')", salt)))


def cap_age(column: str) -> Column:
    return F.expr(age_sql(column))


def zip3(column: str) -> Column:
    return F.expr(zip_sql(column))


def context_key(df: DataFrame, key_column: str = "document_key") -> DataFrame:
    """The document's key, else the text of its first record-like span."""
    first = F.try_element_at(F.filter("spans", lambda s: s["entity_type"].isin("MRN", "ACCOUNT_NUMBER", "ENCOUNTER_ID", "PATIENT_ID")), F.lit(1))
    return df.withColumn("context_key", F.coalesce(F.nullif(F.trim(key_column), F.lit("")), first["text"]))


def deidentify_documents(fields: DataFrame, salt: bytes, policy: str = "v1") -> tuple[DataFrame, DataFrame]:
    """fields (document_id, field, text, and policy if it varies): surrogates in every field
    of a document, all under the document's id as their key and one policy version. A
    document with a null text or with several policy versions goes to quarantine, whole
    and without text."""
    fields = fields if "policy" in fields.columns else fields.withColumn("policy", F.lit(policy))
    told = fields.groupBy("document_id").agg(F.bool_or(F.col("text").isNull()).alias("empty"), F.min("policy").alias("policy"), F.max("policy").alias("_other"))
    several = F.col("policy") != F.col("_other")
    reason = F.when(F.col("empty"), "field without text").when(F.coalesce(several, F.lit(True)), "inconsistent policy version")
    told = told.select("document_id", "policy", reason.alias("reason"))
    kept = fields.drop("policy").join(told.where("reason is null").drop("reason"), "document_id")
    keyed = kept.withColumn("_key", F.col("document_id").cast("string"))
    good = surrogate(detect_entities(keyed, "text"), salt, key_column="_key").select("document_id", "field", "text", "spans", "policy")
    return good, told.where("reason is not null").select("document_id", F.lit("DEIDENTIFY").alias("stage"), "reason")


#: A document taken apart: sections (path, heading, level, text), tables (section_path,
#: caption, headers, rows of cells) and metadata. Addresses of its fields, in that order.
_FIELDS = """concat(
  flatten(transform(sections, (s, i) -> array(struct(concat('heading/', i) as field, s.heading as text), struct(concat('text/', i) as field, s.text as text)))),
  flatten(transform(tables, (t, i) -> concat(
    array(struct(concat('caption/', i) as field, t.caption as text)),
    transform(t.headers, (h, j) -> struct(concat('header/', i, '/', j) as field, h as text)),
    flatten(transform(t.rows, (r, j) -> transform(r, (c, k) -> struct(concat('cell/', i, '/', j, '/', k) as field, c as text))))))),
  transform(map_entries(metadata), e -> struct(concat('meta/', e.key) as field, e.value as text)))"""
_SECTIONS = (
    "transform(sections, (s, i) -> struct(s.path as path, told[concat('heading/', i)] as heading, s.level as level, "
    "told[concat('text/', i)] as text))"
)
_TABLES = """transform(tables, (t, i) -> struct(t.section_path as section_path, told[concat('caption/', i)] as caption,
  transform(t.headers, (h, j) -> told[concat('header/', i, '/', j)]) as headers,
  transform(t.rows, (r, j) -> transform(r, (c, k) -> told[concat('cell/', i, '/', j, '/', k)])) as rows))"""


def deidentify_nested(documents: DataFrame, salt: bytes, policy: str = "v1") -> tuple[DataFrame, DataFrame]:
    """documents (document_id, sections, tables, metadata, and policy if it varies) ->
    (the same documents with surrogates in every heading, text, caption, header, cell and
    metadata value, with policy and counts by entity type; quarantine).

    Fields are taken apart, de-identified under the document's id, and put back where they
    were: dates of all fields move alike. Empty arrays and maps stay; null ones are empty.
    A document with a null field is quarantined, as is an id that occurs twice, for its
    fields could not be told apart."""
    whole = documents.withColumns({"sections": F.expr("coalesce(sections, array())"), "tables": F.expr("coalesce(tables, array())"), "metadata": F.expr("coalesce(metadata, map())")})
    whole = whole if "policy" in documents.columns else whole.withColumn("policy", F.lit(policy))
    repeated = whole.groupBy("document_id").count().where("count > 1").select("document_id")
    single = whole.join(repeated, "document_id", "left_anti")
    fields = single.select("document_id", "policy", F.explode(F.expr(_FIELDS)).alias("f")).select("document_id", "policy", "f.*")
    good, bad = deidentify_documents(fields, salt)
    told = good.groupBy("document_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "text"))).alias("told"),
        F.flatten(F.collect_list(F.transform("spans", lambda s: s["entity_type"]))).alias("types"),
    )  # one document's own fields
    back = single.join(told, "document_id", "left").join(bad.select("document_id"), "document_id", "left_anti")
    told_or_none = F.coalesce("told", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    back = back.withColumn("told", told_or_none).withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    counts = F.expr("map_from_entries(transform(array_sort(array_distinct(types)), x -> struct(x, size(filter(types, y -> y = x)))))")
    rebuilt = back.select(
        "document_id", F.expr(_SECTIONS).alias("sections"), F.expr(_TABLES).alias("tables"),
        F.transform_values("metadata", lambda k, v: F.col("told")[F.concat(F.lit("meta/"), k)]).alias("metadata"), "policy", counts.alias("counts"),
    )
    twice = repeated.select("document_id", F.lit("DEIDENTIFY").alias("stage"), F.lit("repeated id").alias("reason"))
    return rebuilt, bad.union(twice)


def build_range_map(df: DataFrame) -> DataFrame:
    """segments (ts, te, ss, se): how the redacted text maps to the source, from spans
    and the length of each replacement ([TYPE])."""
    plain = (
        "if(s.start > acc.at, array(struct(acc.out as ts, acc.out + s.start - acc.at as te, acc.at as ss, s.start as se)), "
        "cast(array() as array<struct<ts:int,te:int,ss:int,se:int>>))"
    )
    own = (
        "array(struct(acc.out + s.start - acc.at as ts, acc.out + s.start - acc.at + length(s.entity_type) + 2 as te, s.start "
        "as ss, s.stop as se))"
    )
    step = f"struct(concat(acc.segments, {plain}, {own}) as segments, s.stop as at, acc.out + s.start - acc.at + length(s.entity_type) + 2 as out)"
    start = "struct(cast(array() as array<struct<ts:int,te:int,ss:int,se:int>>) as segments, 0 as at, 0 as out)"
    rest = (
        "if(length(text) > acc.at, concat(acc.segments, array(struct(acc.out as ts, acc.out + length(text) - acc.at as te, "
        "acc.at as ss, length(text) as se))), acc.segments)"
    )
    return df.withColumn("segments", F.expr(f"aggregate(spans, {start}, (acc, s) -> {step}, acc -> {rest})"))


def map_range(df: DataFrame) -> DataFrame:
    """Source range of a transformed range (ts, te): from the first to the last segment
    that overlaps it."""
    hit = F.filter("segments", lambda s: (s["ts"] < F.col("te")) & (F.col("ts") < s["te"]))
    return df.withColumn("source_start", F.try_element_at(hit, F.lit(1))["ss"]).withColumn("source_stop", F.try_element_at(hit, F.lit(-1))["se"])


def phi_log(df: DataFrame, keys: tuple[str, ...] = ("version_id",), recognizer: str = "pattern", policy: str = "v1") -> DataFrame:
    """Counts per version, type, recognizer and policy; never a value."""
    return df.select(*keys, F.explode("spans.entity_type").alias("entity_type")).groupBy(*keys, "entity_type").agg(F.count("*").alias("n")).withColumns({"recognizer": F.lit(recognizer), "policy": F.lit(policy)})


def scan_residual(df: DataFrame, types: tuple[str, ...] = ("EMAIL", "PHONE", "SSN", "IP_ADDRESS")) -> DataFrame:
    """Types left in text or context prefix -> CLEAN, SUSPECT; FAILED without text."""
    both = F.concat_ws("\n", "context_prefix", "text")
    found = F.array_compact(F.array(*(F.when(both.rlike(_java(PATTERNS[t])), F.lit(t)) for t in types)))
    return df.withColumn("phi_entity_types", found).withColumn("phi_scan_status", F.when(F.col("text").isNull(), "FAILED").when(F.size("phi_entity_types") > 0, "SUSPECT").otherwise("CLEAN"))


def _java(pattern: str) -> str:
    return "(?U)" + pattern


#: Categories of sensitive content.
SENSITIVE = {
    "PHI_MARKER": r"(?i)\b(?:phi|protected health information|personal health information)\b",
    "PATIENT_ID": r"(?i)\b(?:patient|pt|mrn|medical record|patient[-_ ]?(?:id|number|no))\s*[:=#-]?\s*[A-Z0-9][A-Z0-9-]{2,}\b",
    "NAME": r"(?i:\b(?:patient|name|mr|mrs|ms)\b)\s*[:=]?\s+\b\p{Lu}\p{Ll}{2,}\b|\b\p{Lu}\p{Ll}{2,}\s+\p{Lu}\p{Ll}{2,}\b",
    "EXACT_DATE": r"\b(?:19|20)\d{2}[-/.]\d{1,2}[-/.]\d{1,2}\b|\b\d{1,2}[-/.]\d{1,2}[-/.](?:19|20)?\d{2}\b|(?i)\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2}(?:st|nd|rd|th)?[,]?\s+(?:19|20)\d{2}\b",
    "FULL_ADDRESS": r"(?i)\b(?:full\s+)?address\s*[:=]\s*[^,;\n]{6,}|\b\d{1,6}\s+\p{L}[\p{L}.'-]*(?:\s+\p{L}[\p{L}.'-]*){0,5}\s+(?:street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|drive|dr)\b",
    "EMAIL": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "PHONE": r"(?<!\d)(?:\+?\d[\d ()-]{7,}\d)(?!\d)",
    "SOCIAL_SECURITY_NUMBER": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
}
#: Categories of attempts to steer a model; several patterns may serve one.
INJECTION = (
    ("INSTRUCTION_HIJACK", r"(?ius)\b(?:ignore|disregard|forget|override|do not follow)\b.{0,80}\b(?:previous|prior|above|system|developer|all)\b.{0,40}\b(?:instruction|prompt|rule|message)s?\b"),
    ("INSTRUCTION_HIJACK", r"(?ius)\b(?:you must|you should|do not|never|always)\b.{0,100}\b(?:ignore|reveal|follow|send|call|execute|delete|disclose|output)\b"),
    ("PROMPT_EXFILTRATION", r"(?ius)\b(?:reveal|show|print|output|display|leak|disclose|share)\b.{0,80}\b(?:system|hidden|original|developer|full|internal)?\s*(?:prompt|instruction|secret|api\s*key|token|credential)s?\b"),
    ("SAFETY_BYPASS", r"(?ius)\b(?:bypass|disable|override|evade|circumvent|remove|turn\s+off)\b.{0,80}\b(?:safety|security|guardrail|policy|restriction|filter|validation)s?\b"),
    ("ROLE_HIJACK", r"(?iu)\b(?:you are now|act as|pretend to be|roleplay as|developer mode|unrestricted assistant|jailbreak)\b"),
    ("TOOL_ABUSE", r"(?ius)\b(?:call|use|invoke|run|execute)\b.{0,80}\b(?:tool|sql|structured\s+query|database|query)\b"),
    ("BOUNDARY_SPOOFING", r"(?iu)(?:<\s*/?\s*(?:system|developer|assistant|instructions?)\s*>|\[\s*(?:system|developer|assistant)\s*\]|#{2,}\s*(?:system|developer|instructions?))"),
    ("ENCODING_OBFUSCATION", r"(?ius)\b(?:decode|decipher|decrypt|base64|rot13|hex)\b.{0,80}\b(?:instruction|prompt|command|secret)s?\b|\b[A-Za-z0-9+/]{96,}={0,2}\b"),
)


def _categories(column: Column, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*(F.when(column.rlike(p), F.lit(k)) for k, p in patterns.items())))


def sensitive_findings(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("findings", _categories(F.col(column), SENSITIVE))


def injection_findings(df: DataFrame, column: str = "text") -> DataFrame:
    """Categories on NFKC text without format characters; no text is INVALID_INPUT."""
    from .search import nfkc

    clean = F.trim(F.regexp_replace(F.regexp_replace(nfkc(F.col(column)), r"\p{Cf}", ""), r"\s+", " "))
    found = F.array_distinct(F.array_compact(F.array(*(F.when(clean.rlike(p), F.lit(k)) for k, p in INJECTION))))
    return df.withColumn("findings", F.when(F.coalesce(F.trim(column), F.lit("")) == "", F.array(F.lit("INVALID_INPUT"))).otherwise(found))


def egress_decisions(df: DataFrame, destinations: dict[str, bool], classes: dict[str, bool]) -> DataFrame:
    """df (id, destination, data_class, payload, is_raw_question): first reason to stop a
    payload, or ALLOW; the payload is kept as a digest only."""
    known = lambda c, m: F.create_map(*(F.lit(x) for p in m.items() for x in p))[F.col(c)]
    d, k = known("destination", destinations), known("data_class", classes)
    reason = (
        F.when(d.isNull(), "UNKNOWN_DESTINATION").when(~d, "DESTINATION_BLOCKED").when(k.isNull(), "UNKNOWN_CLASS").when(~k, "CLASS_BLOCKED")
        .when(F.coalesce(F.trim("payload"), F.lit("")) == "", "NO_PAYLOAD").when(F.col("is_raw_question"), "RAW_QUESTION").when(F.size(_categories(F.col("payload"), SENSITIVE)) > 0, "SENSITIVE_CONTENT")
    )
    return df.select("id", F.when(reason.isNull(), "ALLOW").otherwise("DENY").alias("decision"), reason.alias("reason"), F.sha2("payload", 256).alias("payload_sha256"))


def scan_lines(df: DataFrame, patterns: dict[str, str], column: str = "text") -> DataFrame:
    """(id columns, line from 1, rule) for lines that match a pattern."""
    lines = df.select(*(c for c in df.columns if c != column), F.posexplode(F.split(column, "\n")).alias("line", "content"))
    hits = lines.select("*", F.explode(_categories(F.col("content"), patterns)).alias("rule"))
    return hits.withColumn("line", F.col("line") + 1).drop("content")
