"""Clinical bundles (nested JSON) to flat, de-identified rows, and research aggregates."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import keep

_CODING = "array<struct<system:string,code:string,display:string>>"
RESOURCE = (
    f"struct<resourceType:string,id:string,meta:struct<profile:array<string>>,birthDate:string,gender:string,address:array<struct<postalCode:string>>,extension:array<struct<url:string,valueString:string>>,status:string,"
    f"class:struct<system:string,code:string>,clinicalStatus:struct<coding:{_CODING}>,medicationReference:struct<reference:string>,effectivePeriod:struct<start:string>,"
    f"valueCodeableConcept:struct<coding:{_CODING}>,valueString:string,valueBoolean:boolean,valueInteger:bigint,valueDateTime:string,"
    f"subject:struct<reference:string>,code:struct<coding:{_CODING}>,type:array<struct<coding:{_CODING}>>,medicationCodeableConcept:struct<coding:{_CODING}>,"
    "period:struct<start:string>,onsetDateTime:string,authoredOn:string,effectiveDateTime:string,valueQuantity:struct<value:double,unit:string>>"
)
BUNDLE = f"resourceType string, type string, fhirVersion string, entry array<struct<resource:{RESOURCE}>>"


def explode_bundles(df: DataFrame) -> DataFrame:
    """df (source_id, content) -> one row per resource (source_id, position, resource);
    content that is no bundle gives one row with error PARSE_FAILED."""
    parsed = df.withColumn("bundle", F.from_json("content", BUNDLE))
    ok = F.col("bundle.resourceType") == "Bundle"
    out = parsed.select("source_id", F.when(ok, F.lit(None)).when(ok.isNull() | ~ok, "PARSE_FAILED").alias("error"), F.posexplode_outer(F.when(ok, F.col("bundle.entry"))).alias("position", "entry"))
    return out.select("source_id", "position", F.col("entry.resource").alias("resource"), "error")


#: What validate_bundles looks at; the rest of a bundle is passed over.
_CHECKED = "resourceType string, type string, fhirVersion string, entry array<struct<resource:struct<resourceType:string,id:string>>>"


def validate_bundles(df: DataFrame) -> DataFrame:
    """Error rows (source_id, code) per bundle: no bundle, wrong type or version, no
    entries; and patient ids that are missing or occur in several bundles. Bundles are parsed
    once, for the checked fields alone; what they say is written, as two jobs read it."""
    b = df.select("source_id", F.from_json("content", _CHECKED).alias("b"))
    checks = [("NOT_A_BUNDLE", F.coalesce(F.col("b.resourceType"), F.lit("")) != "Bundle"), ("TYPE", ~F.coalesce(F.col("b.type"), F.lit("")).isin("transaction", "collection")), ("VERSION", ~F.coalesce(F.col("b.fhirVersion"), F.lit("")).startswith("4.0")), ("NO_ENTRIES", F.coalesce(F.size("b.entry"), F.lit(0)) <= 0)]
    patients = F.expr("if(b.resourceType = 'Bundle', transform(filter(b.entry, e -> e.resource.resourceType = 'Patient'), e -> e.resource.id), null)")
    codes = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in checks)))
    told = keep(b.select("source_id", codes.alias("codes"), F.array_distinct(patients).alias("ids")), "bundles")
    missing = F.expr("if(exists(ids, i -> i is null), array('PATIENT_WITHOUT_ID'), array())")
    found = told.select("source_id", F.explode("codes").alias("code"))
    without = told.select("source_id", F.explode(missing).alias("code")).distinct()
    named = told.select("source_id", F.explode("ids").alias("id")).where("id is not null")
    several = named.groupBy("id").agg(F.min("source_id").alias("a"), F.max("source_id").alias("z")).where("a < z").select("id")
    return found.union(without).union(named.join(several, "id").selectExpr("source_id", "'DUPLICATE_PATIENT' as code").distinct())


def _coded(path: str) -> str:
    return f"exists({path}.coding, c -> c.code <> '')"


_SUBJECT = ("subject", "resource.subject is not null")
_MEDICATION = ("medication", "resource.medicationCodeableConcept is not null or resource.medicationReference is not null")
_EFFECTIVE = ("effective", "resource.effectiveDateTime <> '' or resource.effectivePeriod is not null")
_MEDICATION_CODE = ("medicationCodeableConcept.coding.code", _coded("resource.medicationCodeableConcept"))
_CODE = (("code", "resource.code is not null"), ("code.coding.code", _coded("resource.code")))
#: What a resource of each type must have, and when it has it, in the order of the issues.
_REQUIRED = {
    "Patient": (("birthDate", "resource.birthDate <> ''"), ("gender", "resource.gender <> ''")),
    "Encounter": (("status", "resource.status <> ''"), ("class", "resource.class is not null"), _SUBJECT, ("period.start", "resource.period.start <> ''")),
    "Condition": (_SUBJECT, *_CODE, ("clinicalStatus", "resource.clinicalStatus is not null")),
    "MedicationRequest": (_SUBJECT, _MEDICATION, ("authoredOn", "resource.authoredOn <> ''"), _MEDICATION_CODE),
    "MedicationStatement": (_SUBJECT, _MEDICATION, _EFFECTIVE, _MEDICATION_CODE),
    "Observation": (
        _SUBJECT, *_CODE, _EFFECTIVE,
        ("value[x]", "coalesce(resource.valueQuantity is not null or resource.valueCodeableConcept is not null or resource.valueString <> "
            "'' or resource.valueBoolean is not null or resource.valueInteger is not null or resource.valueDateTime <> '', false)"),
    ),
}


def _lacking(name: str, fields: tuple[tuple[str, str], ...]) -> Column:
    return F.array(*(F.when(~F.coalesce(F.expr(there), F.lit(False)), F.lit(f"{name}.{field} is required")) for field, there in fields))


def validate_resources(df: DataFrame, profile_base: str | None = None) -> DataFrame:
    """issues of a resource, joined by '; ': an unknown type is the only one; else the id,
    the profile (where a base is given, meta.profile must include base + type in lower
    case) and what its type must have. Empty if valid."""
    kind = F.col("resource.resourceType")
    known = F.coalesce(kind.isin(*_REQUIRED), F.lit(False))
    profiles = F.coalesce("resource.meta.profile", F.array().cast("array<string>"))
    tests = [F.when(~F.coalesce(F.col("resource.id") != "", F.lit(False)), F.concat(kind, F.lit(".id is required")))]
    if profile_base is not None:
        expected = F.concat(F.lit(profile_base), F.lower(kind))
        missing = F.concat(kind, F.lit(".meta.profile is required; expected "), expected)
        tests.append(F.when(F.size(profiles) == 0, missing).when(~F.array_contains(profiles, expected), F.concat(kind, F.lit(".meta.profile must include "), expected)))
    own = functools.reduce(lambda out, x: out.when(kind == x[0], _lacking(*x)), _REQUIRED.items(), F)
    found = F.concat_ws("; ", *tests, own)
    return df.withColumn("issues", F.when(known, found).otherwise(F.concat(F.lit("resource type is not importable: "), F.coalesce(kind, F.lit("")))))


def safe_zip3(zip_code: Column) -> Column:
    """The first three digits; null with fewer."""
    digits = F.substring(F.regexp_replace(zip_code, r"[^0-9]", ""), 1, 3)
    return F.when(F.length(digits) == 3, digits)


def _reference(column: str) -> Column:
    return F.nullif(F.regexp_extract(column, r"([^/]+)$", 1), F.lit(""))


def map_patients(df: DataFrame, asof: str) -> DataFrame:
    """Birth year (none from 90 on), age with its cap as text, gender, race extension,
    three-digit area."""
    r = F.col("resource")
    born = F.expr("try_to_date(resource.birthDate, 'yyyy-MM-dd')")
    age = F.greatest(F.floor(F.months_between(F.lit(asof).cast("date"), born) / 12), F.lit(0))
    race = F.element_at(F.filter(r["extension"], lambda e: e["url"].endswith("race")), 1)
    one = df.where("resource.resourceType = 'Patient'")
    return one.select("source_id", r["id"].alias("patient_id"), F.when(age < 90, F.year(born)).alias("birth_year"), F.when(age >= 90, "90+").otherwise(age.cast("string")).alias("age"), r["gender"].alias("gender"), F.when(F.size(F.filter(r["extension"], lambda e: e["url"].endswith("race"))) > 0, race["valueString"]).alias("race"), safe_zip3(F.try_element_at(r["address"], F.lit(1))["postalCode"]).alias("zip3"))


def map_events(df: DataFrame, kind: str, coding: str, date: str) -> DataFrame:
    """Rows of one resource type: ids, first coding, year, status; `coding` and `date`
    are paths within the resource."""
    first = F.try_element_at(F.col(f"resource.{coding}"), F.lit(1))
    one = df.where(F.col("resource.resourceType") == kind)
    return one.select("source_id", F.col("resource.id").alias("resource_id"), _reference("resource.subject.reference").alias("patient_id"), first["system"].alias("code_system"), first["code"].alias("code"), F.expr(f"year(try_to_date(substring(resource.{date}, 1, 10), 'yyyy-MM-dd'))").alias("year"), F.col("resource.status").alias("status"))


def map_encounters(df: DataFrame) -> DataFrame:
    typed = df.where("resource.resourceType = 'Encounter'").withColumn("t", F.try_element_at(F.col("resource.type"), F.lit(1)))
    first = F.try_element_at(F.col("t.coding"), F.lit(1))
    return typed.select("source_id", F.col("resource.id").alias("resource_id"), _reference("resource.subject.reference").alias("patient_id"), first["system"].alias("type_system"), first["code"].alias("type_code"), F.expr("year(try_to_date(substring(resource.period.start, 1, 10), 'yyyy-MM-dd'))").alias("start_year"), F.col("resource.status").alias("status"))


def map_conditions(df: DataFrame) -> DataFrame:
    return map_events(df, "Condition", "code.coding", "onsetDateTime")


def map_medications(df: DataFrame) -> DataFrame:
    return map_events(df, "MedicationRequest", "medicationCodeableConcept.coding", "authoredOn").union(map_events(df, "MedicationStatement", "medicationCodeableConcept.coding", "effectiveDateTime"))


def map_observations(df: DataFrame) -> DataFrame:
    out = map_events(df, "Observation", "code.coding", "effectiveDateTime")
    values = df.where("resource.resourceType = 'Observation'").select("source_id", F.col("resource.id").alias("resource_id"), F.col("resource.valueQuantity.value").alias("value"), F.col("resource.valueQuantity.unit").alias("unit"))
    return out.join(values, ["source_id", "resource_id"])


def clinical_quarantine(df: DataFrame) -> DataFrame:
    """Rejected rows of validate_resources(explode_bundles(...)) with their stage."""
    stage = F.when(F.col("error").isNotNull(), "PARSE").when(F.col("issues") != "", "PROFILE_VALIDATION").when((F.col("resource.resourceType") != "Patient") & _reference("resource.subject.reference").isNull(), "MAPPING")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).otherwise(F.col("issues"))
    # a filter on the stage would work the issues out once more
    told = F.filter(F.array(F.struct(stage.alias("stage"), reason.alias("reason"))), lambda x: x["stage"].isNotNull())
    return df.select("source_id", "position", F.inline(told))


def import_run(accepted: DataFrame, existing: DataFrame, quarantined: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that an insert-if-absent adds, rows already there, rows in quarantine."""
    new = accepted.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti").agg(F.count("*").alias("inserted"))
    seen = accepted.agg(F.count("*").alias("accepted"))
    return new.join(seen).join(quarantined.agg(F.count("*").alias("quarantined")))  # three rows of counts


def patient_counts(df: DataFrame, dims: list[str], k: int = 5) -> DataFrame:
    """Distinct patients and rows by dims, groups under k patients left out."""
    return df.groupBy(*dims).agg(F.countDistinct("source_id", "patient_id").alias("patient_count"), F.count("*").alias("row_count")).where(F.col("patient_count") >= k)


def condition_counts(df: DataFrame, k: int = 5) -> DataFrame:
    return patient_counts(df, ["code_system", "code", "status"], k)


def observation_counts(df: DataFrame, k: int = 5) -> DataFrame:
    return patient_counts(df, ["code_system", "code", "unit", "year"], k)


def encounter_counts(df: DataFrame, k: int = 5) -> DataFrame:
    return patient_counts(df, ["type_system", "type_code", "start_year"], k)


def research_view(view: DataFrame, filters: dict[str, str], allowed: tuple[str, ...], n: int) -> DataFrame:
    """The n largest groups under filters on allowed dimensions, ties by dimension."""
    if bad := set(filters) - set(allowed):
        raise ValueError(f"dimensions not allowed: {sorted(bad)}")
    for name, value in filters.items():
        view = view.where(F.col(name) == value)
    return view.orderBy(F.col("patient_count").desc(), *allowed).limit(n)


def k_anonymise(df: DataFrame, k: int, role: str, exempt_reason: str | None = None, max_rows: int = 1000) -> DataFrame:
    """Groups of at least k patients, with how many were suppressed and whether the
    rest was cut to max_rows. A clinician is exempt with a reason; ADMIN may not ask."""
    if role == "ADMIN":
        raise PermissionError("ADMIN has no research access")
    exempt = role == "CLINICIAN" and bool((exempt_reason or "").strip())
    small = F.lit(False) if exempt else F.col("patient_count") < k
    totals = df.agg(F.count_if(small).alias("suppressed"), (F.count_if(~small) > max_rows).alias("truncated"))
    kept = df.where(~small).orderBy(F.col("patient_count").desc(), *[c for c in df.columns if c != "patient_count"]).limit(max_rows)
    return kept.join(F.broadcast(totals))  # one row


def strip_identifiers(df: DataFrame) -> DataFrame:
    """Without columns named id or ending in _id; a count column must be there."""
    if "patient_count" not in df.columns:
        raise ValueError("patient_count is required")
    return df.drop(*(c for c in df.columns if c.lower() == "id" or c.lower().endswith("_id")))
