"""L: a bundle per order; the patient is the customer, line items are observations."""

from pyspark.sql import functions as F

from corvane.operators import clinical as op

from .base import query

ORDERS = (
    "select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, cast(o_orderdate as date) as d, year(o_orderdate) as y "
    "from {orders}"
)
LINES = (
    "select l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, year(l_shipdate) as y, cast(l_shipdate as "
    "date) as d from {lineitem}"
)


def bundles(orders, lines):
    """JSON bundles from orders and line items; every 40th is broken."""
    ref = "named_struct('reference', concat('Patient/', cast(o_custkey as string)))"
    # the lines alone are dealt and gathered; their resources are made of them afterwards
    observations = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "d")).alias("obs"))
    made = (
        "transform(obs, x -> named_struct('resource', named_struct('resourceType', 'Observation', 'id', concat(o_orderkey, '-', x.l_linenumber), "
        "'status', if(x.l_linenumber = 7, cast(null as string), 'final'), 'gender', cast(null as string), 'birthDate', cast(null "
        "as string), 'subject', named_struct('reference', 'Patient/0'), 'code', named_struct('coding', "
        "array(named_struct('system', 'flag', 'code', x.l_returnflag))), 'effectiveDateTime', cast(x.d as string), "
        "'onsetDateTime', cast(null as string), 'address', cast(null as array<struct<postalCode:string>>), 'valueQuantity', "
        "named_struct('value', x.l_quantity, 'unit', x.l_linestatus))))"
    )
    joined = orders.join(observations, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    patient = (
        "named_struct('resource', named_struct('resourceType', 'Patient', 'id', cast(o_custkey as string), 'status', cast(null "
        "as string), 'gender', if(o_custkey % 9 = 0, cast(null as string), 'other'), 'birthDate', concat(cast(1900 + o_custkey "
        "% 100 as string), '-05-17'), 'subject', cast(null as struct<reference:string>), 'code', cast(null as "
        "struct<coding:array<struct<system:string,code:string>>>), 'effectiveDateTime', cast(null as string), 'onsetDateTime', "
        "cast(null as string), 'address', array(named_struct('postalCode', cast(3600 + o_custkey as string))), "
        "'valueQuantity', cast(null as struct<value:double,unit:string>)))"
    )
    condition = f"named_struct('resource', named_struct('resourceType', 'Condition', 'id', concat('c', o_orderkey), 'status', o_orderstatus, 'gender', cast(null as string), 'birthDate', cast(null as string), 'subject', {ref}, 'code', named_struct('coding', array(named_struct('system', 'prio', 'code', o_orderpriority))), 'effectiveDateTime', cast(null as string), 'onsetDateTime', cast(d as string), 'address', cast(null as array<struct<postalCode:string>>), 'valueQuantity', cast(null as struct<value:double,unit:string>)))"
    entry = f"concat(array({patient}, {condition}), coalesce({made}, array()))"
    body = F.expr(f"to_json(named_struct('resourceType', 'Bundle', 'type', if(o_orderkey % 30 = 0, 'batch', 'collection'), 'fhirVersion', if(o_orderkey % 35 = 0, '3.0', '4.0.1'), 'entry', {entry}))")
    return joined.select(F.col("o_orderkey").alias("source_id"), F.when(F.col("o_orderkey") % 40 == 0, "{broken").otherwise(body).alias("content"))


_OK = "select * from o where o_orderkey % 40 <> 0"


@query("l01_explode_bundles", f"with ok as ({_OK}), r as (select o_orderkey as source_id, 'Patient' as kind from ok union all select o_orderkey, 'Condition' from ok union all select l_orderkey, 'Observation' from l join ok on l_orderkey = o_orderkey) select source_id, kind, count(*) as n, null::varchar as error from r group by 1, 2 union all select o_orderkey, null, 1, 'PARSE_FAILED' from o where o_orderkey % 40 = 0", o=ORDERS, l=LINES)
def _(o, l):  # noqa: E741
    return op.explode_bundles(bundles(o, l)).groupBy("source_id", F.col("resource.resourceType").alias("kind"), "error").agg(F.count("*").alias("n")).select("source_id", "kind", "n", "error")


@query("l02_validate_bundles", f"""with ok as ({_OK}), b as (select o_orderkey as source_id from o where o_orderkey % 40 = 0)
select source_id, 'NOT_A_BUNDLE' as code from b union all select source_id, 'TYPE' from b union all select o_orderkey, 'TYPE' from ok where o_orderkey % 30 = 0 union all select source_id, 'VERSION' from b union all select o_orderkey, 'VERSION' from ok where o_orderkey % 35 = 0
union all select source_id, 'NO_ENTRIES' from b union all select o_orderkey, 'DUPLICATE_PATIENT' from ok where o_custkey in (select o_custkey from ok group by 1 having count(*) > 1)""", o=ORDERS, l=LINES)
def _(o, l):  # noqa: E741
    return op.validate_bundles(bundles(o, l))


def _resources(o, l):  # noqa: E741
    return op.validate_resources(op.explode_bundles(bundles(o, l)))


@query(
    "l03_validate_resources",
    f"""with ok as ({_OK})
select issues, count(*) as n from (
  select case when o_custkey % 9 = 0 then 'Patient.gender is required' else '' end as issues from ok
  union all select 'Condition.clinicalStatus is required' from ok
  union all select '' from l join ok on l_orderkey = o_orderkey
  union all select 'resource type is not importable: ' from o where o_orderkey % 40 = 0) group by 1""",
    o=ORDERS,
    l=LINES,
)
def _(o, l):  # noqa: E741
    return _resources(o, l).groupBy("issues").agg(F.count("*").alias("n"))


#: One resource an order: its type by order, and what it lacks by customer.
_KINDS = ("Patient", "Encounter", "Condition", "MedicationRequest", "MedicationStatement", "Observation", "Device")
_FIELDS = {
    "Patient": (('"birthDate":"1950-01-02"', "Patient.birthDate is required"), ('"gender":"other"', "Patient.gender is required")),
    "Encounter": (
        ('"status":"finished"', "Encounter.status is required"), ('"class":{"code":"AMB"}', "Encounter.class is required"), ('"subject":{"reference":"Patient/1"}', "Encounter.subject is required"),
        ('"period":{"start":"2020-01-01"}', "Encounter.period.start is required"),
    ),
    "Condition": (
        ('"subject":{"reference":"Patient/1"}', "Condition.subject is required"), ('"code":{"coding":[{"code":"x"}]}', "Condition.code is required; Condition.code.coding.code is required"),
        ('"clinicalStatus":{"coding":[{"code":"active"}]}', "Condition.clinicalStatus is required"),
    ),
    "MedicationRequest": (
        ('"subject":{"reference":"Patient/1"}', "MedicationRequest.subject is required"), ('"authoredOn":"2020-01-01"', "MedicationRequest.authoredOn is required"),
        ('"medicationCodeableConcept":{"coding":[{"code":"x"}]},"medicationReference":{"reference":"Medication/1"}', "MedicationRequest.medication is required; MedicationRequest.medicationCodeableConcept.coding.code is required"),
    ),
    "MedicationStatement": (
        ('"subject":{"reference":"Patient/1"}', "MedicationStatement.subject is required"), ('"effectivePeriod":{"start":"2020-01-01"}', "MedicationStatement.effective is required"),
        ('"medicationCodeableConcept":{"coding":[{"code":"x"}]}', "MedicationStatement.medication is required; MedicationStatement.medicationCodeableConcept.coding.code is required"),
    ),
    "Observation": (
        ('"subject":{"reference":"Patient/1"}', "Observation.subject is required"), ('"code":{"coding":[{"display":"no code"},{"code":"x"}]}', "Observation.code is required; Observation.code.coding.code is required"),
        ('"effectiveDateTime":"2020-01-01"', "Observation.effective is required"), ('"valueString":"high"', "Observation.value[x] is required"),
    ),
    "Device": (),
}
_PROFILE = "https://profiles.example/"


def _planted() -> tuple[str, str]:
    """The resource of an order as JSON, and its issues: a field is lacking where its place
    is the customer's key modulo five, the id and the profile in every seventh and third."""
    body, issues = [], []
    for i, kind in enumerate(_KINDS):
        fields = _FIELDS[kind]
        parts = "".join(f", case when o_custkey % 5 = {j} then '' else ',{text}' end" for j, (text, _) in enumerate(fields))
        start = f"'{{{{\"resourceType\":\"{kind}\"', case when o_orderkey % 7 = 0 then '' else ',\"id\":\"r1\"' end"
        wanted = _PROFILE + kind.lower()
        meta = f", case o_orderkey % 3 when 0 then '' when 1 then ',\"meta\":{{{{\"profile\":[\"other\"]}}}}' else ',\"meta\":{{{{\"profile\":[\"other\",\"{wanted}\"]}}}}' end"
        body.append(f"when {i} then concat({start}{meta}{parts.replace('{', '{{').replace('}', '}}')}, '}}}}')")
        if kind == "Device":
            issues.append(f"when {i} then 'resource type is not importable: Device'")
            continue
        order = sorted(range(len(fields)), key=lambda j: _ORDERED[kind].index(fields[j][1]))
        lacking = "".join(f", case when o_custkey % 5 = {j} then '{fields[j][1]}' end" for j in order)
        told = f"case o_orderkey % 3 when 0 then '{kind}.meta.profile is required; expected {wanted}' when 1 then '{kind}.meta.profile must include {wanted}' end"
        issues.append(f"when {i} then concat_ws('; ', case when o_orderkey % 7 = 0 then '{kind}.id is required' end, {told}{lacking})")
    return f"case o_orderkey % 7 {' '.join(body)} end", f"case o_orderkey % 7 {' '.join(issues)} end"


_ORDERED = {kind: [message for _, message in fields] for kind, fields in _FIELDS.items()}
_BODY, _ISSUES = _planted()


@query(
    "l03_validate_planted",
    f"select o_orderkey as id, {_ISSUES.replace('{{', '{').replace('}}', '}')} as issues from t",
    t=(f"select o_orderkey as id, {_BODY} as content from {{orders}}", "select o_orderkey, o_custkey from {orders}"),
)
def _(t):
    parsed = t.select("id", F.from_json("content", op.RESOURCE).alias("resource"))
    return op.validate_resources(parsed, _PROFILE).select("id", "issues")


@query("l04_map_patients", f"with ok as ({_OK}), a as (select *, 2000 - (1900 + o_custkey % 100) as age, left(cast(3600 + o_custkey as varchar), 3) as z from ok) select o_orderkey as source_id, cast(o_custkey as varchar) as patient_id, case when age < 90 then 1900 + o_custkey % 100 end as birth_year, case when age >= 90 then '90+' else cast(age as varchar) end as age, case when o_custkey % 9 > 0 then 'other' end as gender, z as zip3 from a", o=ORDERS, l=LINES)
def _(o, l):  # noqa: E741
    return op.map_patients(op.explode_bundles(bundles(o, l)), "2000-06-01").select("source_id", "patient_id", "birth_year", "age", "gender", "zip3")


@query("l05_map_conditions", f"with ok as ({_OK}) select o_orderkey as source_id, concat('c', o_orderkey) as resource_id, cast(o_custkey as varchar) as patient_id, 'prio' as code_system, o_orderpriority as code, y as year, o_orderstatus as status from ok", o=ORDERS, l=LINES)
def _(o, l):  # noqa: E741
    return op.map_conditions(op.explode_bundles(bundles(o, l)))


@query("l05_map_observations", f"with ok as ({_OK}) select l_orderkey as source_id, concat(l_orderkey, '-', l_linenumber) as resource_id, l_returnflag as code, year(l.d) as year, l_quantity as value, l_linestatus as unit from l join ok on l_orderkey = o_orderkey where (l_orderkey, l_linenumber) in (select l_orderkey, l_linenumber from l group by 1, 2 having count(*) = 1)", o=ORDERS, l=LINES)
def _(o, l):  # noqa: E741
    once = l.groupBy("l_orderkey", "l_linenumber").count().where("count = 1").drop("count")
    return op.map_observations(op.explode_bundles(bundles(o, l.join(once, ["l_orderkey", "l_linenumber"])))).select("source_id", "resource_id", "code", "year", "value", "unit")


#: The bundles' patients may lack a gender, and their conditions have no clinical status.
@query(
    "l06_clinical_quarantine",
    f"""with ok as ({_OK}), q as (
  select 'PARSE' as stage, 'PARSE_FAILED' as reason from o where o_orderkey % 40 = 0
  union all select 'PROFILE_VALIDATION', 'Patient.gender is required' from ok where o_custkey % 9 = 0
  union all select 'PROFILE_VALIDATION', 'Condition.clinicalStatus is required' from ok)
select stage, reason, count(*) as n from q group by 1, 2""",
    o=ORDERS,
    l=LINES,
)
def _(o, l):  # noqa: E741
    return op.clinical_quarantine(_resources(o, l)).groupBy("stage", "reason").agg(F.count("*").alias("n"))


@query("l07_import_run", "select (select count(distinct o_custkey) from o where o_orderkey % 2 = 1 and o_custkey not in (select o_custkey from "
    "o where o_orderkey % 2 = 0)) as inserted, (select count(*) from o where o_orderkey % 2 = 1) as accepted, (select "
    "count(*) from o where o_orderkey % 40 = 0) as quarantined", o=ORDERS)
def _(o):
    return op.import_run(o.where("o_orderkey % 2 = 1"), o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 40 = 0"), ["o_custkey"])


COND = (
    "select o_orderkey % 3 as source_id, o_custkey as patient_id, 'prio' as code_system, o_orderpriority as code, "
    "o_orderstatus as status, year(o_orderdate) as year, o_orderstatus as unit, 'dept' as type_system, "
    "substr(o_orderpriority, 1, 1) as type_code, year(o_orderdate) as start_year from {orders}"
)


def _counts_sql(dims: str, k: int) -> str:
    return f"select {dims}, count(distinct (source_id, patient_id)) as patient_count, count(*) as row_count from c group by {dims} having count(distinct (source_id, patient_id)) >= {k}"


@query("l08_condition_counts", _counts_sql("code_system, code, status", 5), c=COND)
def _(c):
    return op.condition_counts(c)


@query("l09_observation_counts", _counts_sql("code_system, code, unit, year", 5), c=COND)
def _(c):
    return op.observation_counts(c)


@query("l10_encounter_counts", _counts_sql("type_system, type_code, start_year", 5), c=COND)
def _(c):
    return op.encounter_counts(c)


@query("l11_research_view", f"with v as ({_counts_sql('code_system, code, unit, year', 1)}) select * from v where unit = 'F' order by patient_count desc, code_system, code, unit, year limit 12", c=COND)
def _(c):
    return op.research_view(op.observation_counts(c, 1), {"unit": "F"}, ("code_system", "code", "unit", "year"), 12)


@query("l12_k_anonymise", "with v as (select patient_id % 400 as code, count(distinct (source_id, patient_id)) as patient_count from c group by "
    "1) select code, patient_count, (select count(*) from v where patient_count < 9) as suppressed, (select count(*) from "
    "v where patient_count >= 9) > 100 as truncated from v where patient_count >= 9 order by patient_count desc, code "
    "limit 100", c=COND)
def _(c):
    small = op.patient_counts(c.withColumn("code", F.col("patient_id") % 400), ["code"], 1).drop("row_count")
    return op.k_anonymise(small, 9, "RESEARCHER", max_rows=100)


@query("l13_strip_identifiers", "select code, count(distinct (source_id, patient_id)) as patient_count from c group by source_id, code", c=COND)
def _(c):
    return op.strip_identifiers(op.patient_counts(c, ["source_id", "code"], 1).drop("row_count"))
