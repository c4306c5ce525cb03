"""G: policy tables are literal rows; requests are events."""

from pyspark.sql import functions as F

from corvane.operators import governance as op

from .base import query

CLASSES = {"c_custkey": "PUBLIC", "c_mktsegment": "CLINICAL", "c_nationkey": "PHI_QUASI", "c_name": "PHI_DIRECT", "c_acctbal": "FINANCIAL"}
GRANTS = {"CLINICIAN": ("PUBLIC", "CLINICAL", "PHI_QUASI"), "RESEARCHER": ("PUBLIC", "CLINICAL")}


@query("g01_project_for_role", "select c_custkey, c_mktsegment, c_nationkey from rows_", rows_="select * from {customer}")
def _(rows_):
    return op.project_for_role(rows_, CLASSES, "CLINICIAN", GRANTS)


@query("g02_rows_for_role", "select doc_id, content_domain from rows_ where content_domain in ('src1', 'src2')", rows_="select doc_id, source as content_domain from {documents}",
       policy="select * from (values ('CLINICIAN', 'src1'), ('CLINICIAN', 'src2'), ('ADMIN', 'src3')) as p(role, content_domain)")
def _(rows_, policy):
    return op.rows_for_role(rows_, policy, "CLINICIAN").select("doc_id", "content_domain")


@query("g06_schema_drift", """with s as (select distinct * from observed), r as (select distinct batch, relation
  from s), w as (select distinct batch, r.relation, d."column" from r join declared d using (relation)),
x as (select batch, relation, "column", w.batch as wb, s.batch as sb from (select *, true as w1 from w) w full
  join (select *, true as s1 from s) s using (batch, relation, "column"))
select batch, relation, "column", case when sb is null then 'MISSING' when "column" like 'err%'
  and relation = 'rel1' then 'EXEMPT' else 'UNDECLARED' end as drift from x where wb is null or sb is null""".replace("w.batch as wb, s.batch as sb", "w1 as wb, s1 as sb"),
       observed=("select user_id % 20 as batch, concat('rel', cast(user_id % 3 as varchar(3))) as relation, event_type as `column` from "
           "{events} where value > 100", 'select user_id % 20 as batch, concat(\'rel\', cast(user_id % 3 as varchar(3))) as relation, event_type as "column" from {events} where value > 100'),
       declared=("select * from (values ('rel0', 'click'), ('rel0', 'view'), ('rel0', 'ghost'), ('rel1', 'view'), ('rel1', 'click')) as "
           "d(relation, `column`)", 'select * from (values (\'rel0\', \'click\'), (\'rel0\', \'view\'), (\'rel0\', \'ghost\'), (\'rel1\', \'view\'), (\'rel1\', \'click\')) as d(relation, "column")'),
       exempt="select * from (values ('rel1', 'err*')) as x(relation, pattern)")
def _(observed, declared, exempt):
    return op.schema_drift(observed, declared, exempt)


REQUESTS = (
    "select event_id as id, user_id % 3 as role, event_type as action, case when event_id % 2 = 0 then 'doc' else 'chart' "
        "end as resource, map('reason', case when event_id % 5 = 0 then 'care' else 'other' end, 'unit', 'u1') as attributes "
        "from {events}",
    "select event_id as id, user_id % 3 as role, event_type as action, case when event_id % 2 = 0 then 'doc' else 'chart' "
        "end as resource, event_id % 5 = 0 as care from {events}",
)
_VALUES = (
    "(1, 0, 'view', 'doc', 'none', {none}), (2, 1, 'view', 'doc', 'mask', {reason}), (3, 1, 'view', 'doc', 'log', {unit}), "
    "(4, 2, 'click', 'chart', 'never', {both}), (5, 2, 'purchase', 'chart', 'log', {reason})"
)
RULES = (
    "select * from (values " + _VALUES.replace("{none}", "cast(map() as map<string, string>)").replace("{reason}", "map('reason', 'care')").replace("{unit}", "map('unit', 'u1')").replace("{both}", "map('reason', 'care', 'ticket', 't')") + ") as r(place, role, action, resource, obligations, required)",
    "select * from (values " + _VALUES.replace("{none}", "0").replace("{reason}", "1").replace("{unit}", "0").replace("{both}", "2") + ") as r(place, role, action, resource, obligations, need)",
)


@query("g07_decide", """with j as (select id, place, obligations, place is not null and (need = 0 or need = 1
  and care) as ok, action in ('view', 'click', 'purchase') as declared from requests left join rules using (role, action, resource)),
b as (select id, arg_min(obligations, place) filter (ok) as obligations, bool_or(ok) as ok, bool_and(declared) as declared from j group by 1)
select id, case when ok then 'ALLOW' else 'DENY' end as decision, case when not declared then 'UNDECLARED'
  when ok then 'RULE' else 'NO_RULE' end as reason, obligations from b""", requests=REQUESTS, rules=RULES)
def _(requests, rules):
    return op.decide(requests, rules)


#: Questions by turn, and whether the rules take them for an aggregate.
_QUESTIONS = (("How many ", True), ("Average ", True), ("", False), ("The MEDIAN of ", True), ("Discount for ", True), ("Name the ", False), ("Cohorts of ", True), ("Number one ", False))
_ASK = "case (conv_id + turn) % 8 " + " ".join(f"when {i} then '{q}'" for i, (q, _) in enumerate(_QUESTIONS)) + " end"
_AGGREGATE = ", ".join(str(i) for i, (_, yes) in enumerate(_QUESTIONS) if yes)
ASKS = (
    "select conv_id * 100 + turn as id, conv_id % 3 as role, (conv_id + turn) % 8 as kind, case turn % 5 when 0 then "
        "'CLINICAL' when 1 then 'STRUCTURED'"
    f" when 2 then 'OUT_OF_SCOPE' when 3 then 'UNKNOWN' else 'POLICY' end as query_class, concat({_ASK}, role) as question from {{conversations}}"
)
TOOLS = (
    "select * from (values ('search', 0, 'CLINICAL', false), ('search', 1, 'CLINICAL', false), ('aggregate', 0, "
        "'STRUCTURED', true), ('lookup', 0, 'STRUCTURED', false),"
    " ('policy', 2, 'POLICY', false), ('aggregate', 2, 'STRUCTURED', true), ('aggregate', 1, 'STRUCTURED', true), "
        "('search', 0, 'UNKNOWN', false)) as t(tool, role, query_class, aggregate_only)"
)


@query(
    "g09_allowed_tools",
    f"""with f as (
  select distinct id, tool from requests join tools using (role, query_class)
  where query_class not in ('OUT_OF_SCOPE', 'UNKNOWN') and (not aggregate_only or kind in ({_AGGREGATE}))),
t as (select id, string_agg(tool, ',' order by tool) as tools from f group by 1)
select id, coalesce(tools, '') as tools from requests left join t using (id)""",
    requests=ASKS,
    tools=TOOLS,
)
def _(requests, tools):
    return op.allowed_tools(requests, tools).withColumn("tools", F.array_join("tools", ","))
