"""F and B: events are feedback, costs and requests."""

from pyspark.sql import functions as F

from corvane.operators import budget as op

from .base import query

FEEDBACK = (
    "select event_id as id, case when event_type = 'error' then 'SAFETY_CONCERN' else 'GENERAL' end as kind, case user_id "
    "% 4 when 0 then 'LOW' when 1 then 'MEDIUM' when 2 then 'HIGH' else 'CRITICAL' end as severity, case when event_id % 3 "
    "= 0 then 'REVIEWED' else 'PENDING' end as status, ts as created_at from {events}"
)
REVIEWS = (
    "select event_id * 2 as id, case when user_id % 5 = 0 then 'CLINICIAN' else 'ADMIN' end as role, case when event_id % "
    "4 = 0 then 'PROMOTE' else 'CLOSE' end as verdict from {events}"
)
COSTS = (
    "select event_id as id, ts, cast(ts as date) as day, cast(date_trunc('month', ts) as date) as month, concat('r', "
    "cast(user_id % 3 as varchar(3))) as role, concat('u', cast(user_id as varchar(9))) as user_, cast(floor(value) as "
    "bigint) as cost from {events}"
)
COSTS = (COSTS.replace("user_,", "user,"), COSTS)


@query("f01_feedback_queue", "select id, row_number() over (order by case when kind = 'SAFETY_CONCERN' then 0 else 1 end, list_position(['LOW', "
    "'MEDIUM', 'HIGH', 'CRITICAL'], severity) desc, created_at, id) as place from feedback where status = 'PENDING'", feedback=FEEDBACK)
def _(feedback):
    return op.feedback_queue(feedback).select("id", "place")


@query("f02_apply_reviews", "select r.id, role, verdict, case when role <> 'ADMIN' then 'FORBIDDEN' when f.id is null then 'UNKNOWN' when f.status "
    "<> 'PENDING' then 'NOT_PENDING' when verdict = 'PROMOTE' then 'CANDIDATE' else 'REVIEWED' end as outcome from reviews "
    "r left join feedback f on f.id = r.id", feedback=FEEDBACK, reviews=REVIEWS)
def _(feedback, reviews):
    return op.apply_reviews(feedback, reviews)


@query("f03_validate_feedback", "select id, coalesce(regexp_full_match(trace_id, '[A-Za-z0-9._:-]{1,128}'), false) as valid from rows_", rows_="select doc_id as id, case when doc_id % 9 = 0 then null when doc_id % 5 = 0 then left(text, 12) when doc_id % 7 = 0 "
    "then repeat('a', cast(100 + doc_id % 60 as int)) else concat('t-', cast(doc_id as varchar(20))) end as trace_id from "
    "{documents}")
def _(rows_):
    return op.validate_feedback(rows_).select("id", "valid")


@query("f04_trajectory_projection", "select trace_id, string_agg(node, ',' order by seq) as nodes, coalesce(string_agg(candidate_id, ',' order by seq), "
    "'') as candidates, coalesce(string_agg(degradation, ',' order by seq), '') as degradations from t group by 1", t="select user_id as trace_id, event_id as seq, event_type as node, case when event_id % 5 = 0 then concat('c', "
    "cast(event_id as varchar(20))) end as candidate_id, case when event_type = 'error' then 'LEXICAL_DOWN' end as "
    "degradation from {events}")
def _(t):
    return op.trajectory_projection(t).select("trace_id", *(F.array_join(c, ",").alias(c) for c in ("nodes", "candidates", "degradations")))


@query("b01_spend_rollup", " union all ".join(f"select '{g}' as grain, {c} as period, case grouping_id(role, user_) when 3 then 'GLOBAL' when 1 then 'ROLE' else 'USER' end as scope, role, user_ as \"user\", cast(sum(cost) as bigint) as spend from costs group by grouping sets (({c}), ({c}, role), ({c}, role, user_))" for g, c in (("day", "day"), ("month", "month"))), costs=COSTS)
def _(costs):
    return op.spend_rollup(costs)


@query("b02_admit", costs=COSTS)
def _(costs):
    return op.admit(costs, {"day_global": 5000, "day_user": 150, "month_role": 60000, "month_user": 1500})


@query("b02_demand_totals", "select id, cast(sum(cost) over (partition by day order by ts, id rows unbounded preceding) as bigint) as day_total, "
    "cast(sum(cost) over (partition by day, role order by ts, id rows unbounded preceding) as bigint) as role_total, "
    "cast(sum(cost) over (partition by day, user_ order by ts, id rows unbounded preceding) as bigint) as user_total from "
    "costs", costs=COSTS)
def _(costs):
    return op.demand_totals(costs).select("id", "day_total", "role_total", "user_total")


@query("b03_settle", "select user_ as \"user\", cast(sum(estimate) as bigint) as reserved, cast(greatest(sum(estimate) + sum(case outcome "
    "when 'COMMIT' then actual - estimate when 'RELEASE' then -estimate else 0 end), 0) as bigint) as settled from r left "
    "join o using (id) group by 1",
       r=("select event_id as id, user_id as user, cast(floor(value) as bigint) as estimate from {events}", "select event_id as id, user_id as user_, cast(floor(value) as bigint) as estimate from {events}"), o="select event_id as id, case when event_id % 3 = 0 then 'RELEASE' else 'COMMIT' end as outcome, event_id % 40 as "
           "actual from {events} where event_id % 5 > 0")
def _(r, o):
    return op.settle(r, o)


@query("b04_budget_status", "with j as (select period, scope, key, round(spend / lim, 4) as ratio from spend join limits using (scope)), t as "
    "(select period, max((ratio, scope, key)) as t from j group by 1) select period, struct_extract_at(t, 2) as scope, "
    "struct_extract_at(t, 3) as key, struct_extract_at(t, 1) as ratio, struct_extract_at(t, 1) >= 0.8 as warning from t",
       spend="select cast(ts as date) as period, case when user_id % 2 = 0 then 'ROLE' else 'USER' end as scope, cast(user_id % 10 "
           "as varchar(9)) as key, sum(floor(value)) as spend from {events} group by 1, 2, 3", limits=("select * from (values ('ROLE', 2500.0D), ('USER', 2000.0D)) as l(scope, limit)", "select * from (values ('ROLE', 2500.0::double), ('USER', 2000.0::double)) as l(scope, lim)"))
def _(spend, limits):
    return op.budget_status(spend, limits)


REQ = (
    "select event_id as id, cast(floor(epoch_) as bigint) as epoch, user_id as user_, user_id % 20 as ip, event_type as "
    "endpoint from {events}"
)
REQ = (REQ.replace("floor(epoch_)", "unix_timestamp(cast(ts as timestamp))").replace("user_,", "user,"), REQ.replace("epoch_", "epoch(ts)"))


@query("b05_rate_limit_report", "with c as (select *, epoch - epoch % 3600 as w, row_number() over (partition by user_, epoch - epoch % 3600 order by "
    "epoch, id) as a, row_number() over (partition by ip, epoch - epoch % 3600 order by epoch, id) as b, row_number() over "
    "(partition by endpoint, epoch - epoch % 3600 order by epoch, id) as e from req) select id, w + 3600 - epoch as "
    "retry_after from c where a > 1 or b > 3 or e > 6", req=REQ)
def _(req):
    return op.rate_limit_report(req, {"user": 1, "ip": 3, "endpoint": 6}, 3600)
