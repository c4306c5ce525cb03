"""N: versions are orders, documents customers, chunks line items."""

from corvane.operators import versions as op

from .base import query

VERSIONS = """select o_custkey as document_id, o_orderkey as version_id, o_orderpriority as version,
 case when o_orderkey % 13 = 0 then null else cast(o_orderdate as date) end as effective_date, cast(o_orderdate as date) as retrieved_at,
 case when o_orderstatus = 'P' then 'WITHDRAWN' when o_orderkey % 13 = 0 then 'UNKNOWN' else 'CONFIRMED' end as status from {orders}"""
RAW = """select o_orderkey as version_id, case when o_orderkey % 7 = 0 then ' ' else concat('pub', cast(o_custkey % 5 as varchar(9))) end as publisher,
 case when o_orderkey % 11 = 0 then null else o_orderpriority end as version,
 case when o_orderkey % 13 = 0 then null when o_orderkey % 17 = 0 then '2020-02-31'
  when o_orderkey % 19 = 0 then '1/2/2020' else cast(cast(o_orderdate as date) as varchar(10)) end as effective_date from {orders}"""
_CHAIN_SQL = """with c as (select *, row_number() over w as rn, lag(version_id) over w as before from (select *, {test} as chosen from versions)
 window w as (partition by document_id, chosen order by {order}))
select document_id, version_id, case when not chosen then status when rn = 1 then 'ACTIVE' else 'SUPERSEDED' end as new_status,
 case when chosen then before end as superseded_by from c"""
_COLUMNS = ("document_id", "version_id", "new_status", "superseded_by")
_META_SQL = """with m as (select *, coalesce(trim(publisher), '') = '' as bp, coalesce(trim(version), '') = '' as bv, coalesce(trim(effective_date), '') = '' as bd,
  regexp_matches(effective_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') and try_cast(effective_date as date) is not null as dated from raw),
r as (select version_id, concat_ws(',', case when bp then 'publisher' end, case when bv then 'version' end, case
  when bd then 'effective_date' end) as missing,
  case when not bd and not dated then 'effective_date' else '' end as invalid,
  case when bd or not dated then 'EFFECTIVE_DATE' when bv then 'VERSION' when bp then 'PUBLISHER' end as reason from m)
"""


@query("n01_version_metadata", _META_SQL + "select version_id, missing, invalid, case when missing = '' and invalid = '' then 'CONFIRMED' else 'UNKNOWN' end as "
    "status from r", raw=RAW)
def _(raw):
    return op.version_metadata(raw).selectExpr("version_id", "array_join(missing, ',') as missing", "array_join(invalid, ',') as invalid", "status")


@query("n02_version_chain", _CHAIN_SQL.replace("{test}", "status = 'CONFIRMED'").replace("{order}", "effective_date desc nulls last, version desc, version_id"), versions=VERSIONS)
def _(versions):
    return op.version_chain(versions).select(*_COLUMNS)


@query("n03_reconcile_chain", _CHAIN_SQL.replace("{test}", "status = 'CONFIRMED' and effective_date is not null").replace("{order}", "effective_date desc, version desc, retrieved_at desc, version_id"), versions=VERSIONS)
def _(versions):
    return op.reconcile_chain(versions).select(*_COLUMNS)


@query(
    "n04_chain_checks",
    "select version_id, count(*) as n, count(distinct document_id) as documents, case when count(distinct document_id) > 1 "
        "then 'SEVERAL_DOCUMENTS' else 'DUPLICATE_VERSION' end as problem from rows_ group by version_id having count(*) > 1",
    rows_="select l_partkey as document_id, l_orderkey * 10 + l_linenumber % 3 as version_id from {lineitem}",
)
def _(rows_):
    return op.chain_checks(rows_)


@query("n05_metadata_review", _META_SQL + "select version_id, reason from r where missing <> '' or invalid <> ''", raw=RAW)
def _(raw):
    return op.metadata_review(raw).select("version_id", "reason")


@query(
    "n06_version_history",
    "select document_id, version_id, row_number() over (partition by document_id order by effective_date desc nulls last, "
        "version desc, version_id) as position, effective_date < date '1997-06-30' as stale from versions",
    versions=VERSIONS,
)
def _(versions):
    return op.version_history(versions, "2000-06-30").select("document_id", "version_id", "position", "stale")


@query(
    "n07_chunk_diff",
    """select document_id, ordinal, case when o.text is null then 'ADDED'
  when n.text is null then 'REMOVED' else 'CHANGED' end as change, left(coalesce(n.text, o.text), 240) as summary
from older o full join newer n using (document_id, ordinal) where o.text is null or n.text is null or o.text <> n.text or o.section <> n.section""",
    older="select l_orderkey as document_id, l_linenumber as ordinal, min(l_returnflag) as section, min(concat('part ', "
        "cast(l_partkey as varchar(20)))) as text from {lineitem} where l_linenumber % 5 <> 4 group by 1, 2",
    newer="select l_orderkey as document_id, l_linenumber as ordinal, min(l_returnflag) as section, min(concat('part ', "
        "cast(l_partkey + case when l_partkey % 7 = 0 then 1 else 0 end as varchar(20)))) as text from {lineitem} where "
        "l_linenumber % 5 <> 3 group by 1, 2",
)
def _(older, newer):
    return op.chunk_diff(older, newer)
