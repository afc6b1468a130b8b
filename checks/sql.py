"""DuckDB SQL for the registered queries.

The facts are summed as decimals here, and totals and breakdowns are separate
legs of a union, so the SQL does not share its method with the Spark side.
"""

from __future__ import annotations

YM_RANGE = "perf_month >= date '1998-03-01' and perf_month < date '1998-04-01'"
YM_BEFORE_RANGE = "perf_month >= date '1998-02-01' and perf_month < date '1998-03-01'"
CUTOVER_DAY = "date '1998-01-01'"
OWNER = "NATION_0"

BASE = """ad_base as (
  select case l_returnflag when 'R' then 'AFFILIATE' when 'A' then 'DIRECT' else 'RECOMMEND' end ad_type,
         cast(date_trunc('month', l_shipdate) as date) perf_month,
         lower(s_name) || case s_suppkey % 3 when 0 then '-th' when 1 then '-ph' else '-my' end account,
         n_name owner,
         p*d spend, p*(1-d) ad_revenue, p*(1+t) store_revenue,
         p*(2*t-d) store_profit, p*t non_ad_profit, p*(t-d) ad_profit,
         cast(l_linenumber as bigint) ad_orders, cast(l_quantity as bigint) clicks, l_orderkey, l_linestatus
  from (select *, cast(l_extendedprice as decimal(12,2)) p,
               cast(l_discount as decimal(4,2)) d, cast(l_tax as decimal(4,2)) t from lineitem) l
  left join supplier on l_suppkey = s_suppkey
  left join nation on s_nationkey = n_nationkey)"""

MONEY = ("spend", "ad_revenue", "store_revenue", "store_profit", "non_ad_profit", "ad_profit")
COUNTS = ("ad_orders", "clicks")
MEASURES = MONEY + COUNTS
MONTH = "strftime(perf_month, '%Y-%m') as perf_month"


def r2(value: str) -> str:
    return f"(sign({value})*floor(abs({value})*100+0.5)/100)"


def quot(num: str, den: str) -> str:
    return f"(cast({num} as double)/nullif(cast({den} as double),0))"


def pct(num: str, den: str) -> str:
    share = r2(f"(100*cast({num} as double)/nullif(cast({den} as double),0))")
    return f"cast(cast({share} as decimal(38,2)) as varchar) || '%'"


def sums(names=MEASURES) -> str:
    return ", ".join(
        f"cast(sum({n}) as double) as {n}" if n in MONEY else f"cast(sum({n}) as bigint) as {n}" for n in names
    )


def rows(names) -> str:
    return ", ".join(f"cast({n} as double) as {n}" if n in MONEY else n for n in names)


def whole(value: str) -> str:
    return f"cast(sign({value})*floor(abs({value})) as bigint)"


def over_base(select: str, more: str = "") -> str:
    return f"with {BASE}{more}\n{select}"


ACOS = f"{pct('spend', 'ad_revenue')} as acos"
SPEND_SHARE = f"{pct('spend', 'store_revenue')} as spend_share"
REVENUE_SHARE = f"{pct('ad_revenue', 'store_revenue')} as ad_revenue_share"
PROFIT_SHARE = f"{pct('ad_profit', 'store_profit')} as ad_profit_share"
CPC = f"{r2(quot('spend', 'clicks'))} as cpc"
ROI = f"{r2(quot('ad_revenue', 'spend'))} as roi"
CR = f"{r2(quot('ad_orders', 'clicks'))} as cr"

CPC_SCOPE = f"((perf_month >= {CUTOVER_DAY} and ad_type <> 'AFFILIATE') or (perf_month < {CUTOVER_DAY} and ad_type = 'CPC'))"


def summary_lines(where: str, label: str) -> str:
    """CTEs that end in ``lines``: total leg and owner leg over separate scans."""
    return f""",
scoped as (select * from ad_base where {where}),
sums as (
  select 1 is_total, 'TOTAL' as ad_type, perf_month, '' as owner, {sums()} from scoped group by perf_month
  union all
  select 0 is_total, '{label}' as ad_type, perf_month, owner, {sums()} from scoped group by perf_month, owner),
lines as (
  select is_total, ad_type, {MONTH}, spend, {ACOS}, ad_revenue, store_revenue, {SPEND_SHARE}, {REVENUE_SHARE},
         store_profit, non_ad_profit, ad_profit, clicks, {CPC}, {ROI}, {CR}, owner
  from sums)"""


def summary(where: str, label: str, tail: str = "", head: str = "* exclude (is_total)") -> str:
    return over_base(
        f"select {head} from lines order by perf_month, is_total desc, owner nulls first {tail}",
        summary_lines(where, label),
    )


def detail_lines(where: str, extra: str = "") -> str:
    columns = f"""{MONTH}, spend, {ACOS}, ad_revenue, store_revenue, {SPEND_SHARE}, store_profit, non_ad_profit,
         ad_profit, {PROFIT_SHARE}, {REVENUE_SHARE}, ad_orders, clicks, owner{extra}"""
    return f""",
scoped as (select * from ad_base where {where}),
lines as (
  select 0 is_total, ad_type, account, {columns}
  from (select ad_type, account, perf_month, owner, {rows(MEASURES)}, l_orderkey, l_linestatus from scoped)
  union all
  select 1 is_total, 'TOTAL' as ad_type, cast(null as varchar) as account, {columns}
  from (select min(perf_month) perf_month, min(owner) as owner, {sums()}, cast(null as bigint) l_orderkey,
               cast(null as varchar) l_linestatus from scoped))"""


DETAIL_ORDER = "is_total desc, account nulls first, perf_month, ad_type"


FURTHER = ", l_orderkey, l_linestatus"


def detail(where: str, extra: str = "") -> str:
    extra += FURTHER
    return over_base(
        f"select * exclude (is_total) from lines order by {DETAIL_ORDER}", detail_lines(where, extra)
    )


def shown(value: str) -> str:
    text = f"cast({value} as varchar)"
    cut = f"cast(cast(trunc(cast({value} as double)) as decimal(38,0)) as varchar)"
    return f"coalesce(case when abs({value}) > 100 then {cut} else {text} end, '')"


BY_SITE_TYPE = "perf_month, account, ad_type"


def site_type(select: str) -> str:
    return over_base(
        f"select {MONTH}, account, ad_type, {select} from sums",
        f", sums as (select {BY_SITE_TYPE}, {sums()} from ad_base group by {BY_SITE_TYPE})",
    )


# Upload ingest.


def ingest_parts(name: str, ad_type: str = "DIRECT", where: str = "true", by: str = "perf_month, account") -> str:
    """CTEs of the report sums and dashboards of one upload."""
    return f""",
{name}_reports as (
  select {by}, case when ad_orders % 2 = 1 then 'Sponsored Search' else 'Sponsored Products' end placement,
         spend, ad_revenue, clicks, clicks * 20 impression, ad_orders, ad_orders + clicks % 3 units
  from ad_base where ad_type = '{ad_type}' and {where}),
{name}_boards as (
  select {by}, cast(sum(store_revenue) as double) account_revenue, cast(sum(clicks) as bigint) visitors,
         count(*) buyers, cast(sum(ad_orders) as bigint) orders
  from ad_base where {where.replace(" and account like '%-th'", "")} group by {by})"""


def report_sums(source: str, by: str, where: str = "true") -> str:
    return f"""select {by}, cast(sum(ad_revenue) as double) revenue, cast(sum(spend) as double) spend,
         cast(sum(clicks) as bigint) clicks, cast(sum(units) as bigint) units,
         cast(sum(impression) as bigint) impression, cast(sum(ad_orders) as bigint) ad_orders
  from {source} where {where} group by {by}"""


def kpis(name: str, by: str = "perf_month, account", where: str = "true") -> str:
    revenue = r2("revenue")
    return f"""select {by}, {revenue} as "Revenue", spend as "Spend", clicks as "Clicks", units as "Units_Sold",
       impression as "Impressions", ad_orders, {r2("account_revenue")} as "account_Revenue",
       visitors as "Product_Visitors", buyers as "Buyers", orders as "Orders", orders * 2 as "br_Units_Sold",
       visitors * 3 as "Pageviews", {r2(quot("units", "clicks"))} as unit_cr, {r2(quot("spend", "clicks"))} as cpc,
       {r2(quot(revenue, "spend"))} as roi, '980405' as update_time
  from (select {by}, s.* exclude ({by}), b.* exclude ({by})
        from ({report_sums(f"{name}_reports", by, where)}) s join {name}_boards b using ({by}))"""


def kpis_by_month(more: str, select: str) -> str:
    return over_base(f"select {MONTH}, * exclude (perf_month) from ({select})", more)


PAGED = "perf_month, account, ad_type, ad_orders, clicks, spend, ad_profit"
PAGED_ROWS = f", paged as (select {MONTH}, account, ad_type, ad_orders, clicks, {rows(('spend', 'ad_profit'))} from ad_base)"


def paged_order(first: str) -> str:
    return ", ".join(f"{c} nulls first" for c in [first, *PAGED.split(", ")])


TREND = """,
channels as (
  select case when ad_type = 'AFFILIATE' then 'AFFILIATE' else 'CPC' end channel, perf_month,
         cast(sum(spend) as double) s, cast(sum(ad_revenue) as double) r from ad_base group by 1, 2),
cut as (select channel, perf_month, {s} s, {r} r from channels),
months as (
  select perf_month, cast(sum(s) as bigint) total_spend, cast(sum(r) as bigint) total_ad_revenue,
         cast(max(s) filter (channel = 'CPC') as bigint) cpc_spend,
         cast(max(r) filter (channel = 'CPC') as bigint) cpc_ad_revenue,
         cast(max(s) filter (channel = 'AFFILIATE') as bigint) affiliate_spend,
         cast(max(r) filter (channel = 'AFFILIATE') as bigint) affiliate_ad_revenue
  from cut group by perf_month)""".format(s=whole("s"), r=whole("r"))


def trend(show) -> str:
    rois = ", ".join(
        f"{show(quot(f'{s}_ad_revenue', f'{s}_spend'))} as {s}_roi" for s in ("total", "cpc", "affiliate")
    )
    return over_base(f"select {MONTH}, * exclude (perf_month), {rois} from months order by 1", TREND)


PAGE_COLUMNS = (
    "ad_type", "perf_month", "spend", "acos", "ad_revenue", "store_revenue", "spend_share", "ad_revenue_share", "store_profit",
    "non_ad_profit", "ad_profit", "cpc", "roi", "cr", "owner",
)


def page_json(offset: int) -> str:
    """One row: all lines counted, and the page's lines as a JSON array."""
    cells = ", ".join(f"{c} := {shown(c) if c in (*MONEY, 'cpc', 'roi', 'cr') else f"coalesce({c}, '')"}" for c in PAGE_COLUMNS)
    order = "perf_month, is_total desc, owner nulls first"
    return over_base(
        f"""select (select count(*) from lines) as total,
  '[' || coalesce(string_agg(cast(to_json(struct_pack({cells})) as varchar), ',' order by {order}), '') || ']' as rows
from (select * from lines order by {order} limit 15 offset {offset})""",
        summary_lines(f"ad_type = 'DIRECT' and {YM_RANGE}", "DIRECT"),
    )


SQL: dict[str, str] = {
    "fact_scan": over_base(f"select {MONTH}, ad_type, account, owner, {rows(MEASURES)} from ad_base"),
    "month_extract": over_base(
        f"select {MONTH}, ad_type, account, owner, {rows(MEASURES)}, l_orderkey, l_linestatus from ad_base where {YM_RANGE}"
    ),
    "filter_month": over_base(f"select {MONTH}, ad_type, {rows(('spend', 'clicks'))} from ad_base where {YM_RANGE}"),
    "filter_ad_type": over_base(
        f"select {MONTH}, ad_type, {rows(('spend', 'clicks'))} from ad_base where ad_type = 'RECOMMEND'"
    ),
    "filter_exclude_type": over_base(
        f"select {MONTH}, ad_type, {rows(('spend', 'clicks'))} from ad_base where ad_type <> 'AFFILIATE'"
    ),
    "filter_owner_like": over_base(
        rf"select owner, {MONTH}, clicks from ad_base where owner like 'NATION\_1%' escape '\'"
    ),
    "filter_account_contains": over_base(
        f"select account, {MONTH}, ad_type, clicks from ad_base where ad_type = 'DIRECT' and contains(account, '7-')"
    ),
    "scope_router": over_base(
        f"""select {MONTH}, ad_type, count(*) as n, cast(sum(clicks) as bigint) as clicks
from ad_base where {CPC_SCOPE} group by ad_base.perf_month, ad_type"""
    ),
    "channel_bucket": over_base(
        """select case when ad_type = 'AFFILIATE' then 'AFFILIATE' else 'CPC' end as channel, count(*) as n,
cast(sum(clicks) as bigint) as clicks from ad_base group by 1"""
    ),
    "site_filter": """select * from (
  select c_custkey, c_name || case c_custkey % 4 when 0 then '-TH' when 1 then '-ph' when 2 then '-My' else '-sg' end as site
  from customer)
where lower(site) like '%-th%' or lower(site) like '%-ph%' or lower(site) like '%-my%'""",
    "site_shop_key": over_base(
        """select account, left(account, length(account) - 3) as shop, cast(sum(clicks) as bigint) as clicks
from ad_base group by account"""
    ),
    "cast_with_rejects": """with cells as (select source, replace(source, 'src1', '') cell from documents)
select source, cast(sum(case when cell = '' then 0 else try_cast(cell as decimal(18,4)) end) as double) as amount,
       cast(sum(try_cast(cell as bigint)) as bigint) as number,
       cast(sum(case when cell <> '' and try_cast(cell as double) is null then 1 else 0 end)
            + sum(case when try_cast(cell as bigint) is null then 1 else 0 end) as bigint) as bad_cells
from cells group by source""",
    "json_envelope_rows": """select event_id, case when event_id % 4 = 2 and place = 2 then null
         else cast(json_extract(props, '$.k') as bigint) end as k
from events join range(1, 4) records(place) on place <= event_id % 4 where event_id % 50 <> 7""",
    "json_envelope_campaign": over_base(
        """select account as account_name, cast(store_revenue as double) as store_revenue,
cast(spend as double) as spend, clicks, ad_orders * 2 as store_units_sold, clicks * 20 as impression,
case when clicks % 10 = 0 then null else ad_orders end as store_orders from ad_base"""
    ),
    "json_envelope_store": over_base(
        """select account as account_name, account_revenue, visitors as product_visitors, buyers, orders,
visitors * 3 as pageviews, orders * 2 as br_units_sold from up_boards""",
        ingest_parts("up"),
    ),
    "channel_month_totals": over_base(
        f"""select case when ad_type = 'AFFILIATE' then 'AFFILIATE' else 'CPC' end as channel, {MONTH},
{sums(("spend", "ad_revenue"))} from ad_base group by 1, ad_base.perf_month order by 2, 1"""
    ),
    "type_month_totals": over_base(
        f"""select ad_type, {MONTH}, {sums(("spend", "ad_revenue"))}
from ad_base group by ad_type, ad_base.perf_month order by 2, 1"""
    ),
    "scope_total": over_base(f"select {MONTH}, {sums()} from ad_base where {CPC_SCOPE} group by ad_base.perf_month"),
    "owner_breakdown": over_base(
        f"select {MONTH}, owner, {sums()} from ad_base where {CPC_SCOPE} group by ad_base.perf_month, owner"
    ),
    "latest_month": over_base("select strftime(max(perf_month), '%Y%m') as latest_month from ad_base"),
    "month_list": over_base(
        "select distinct strftime(perf_month, '%Y-%m') as perf_month from ad_base order by 1 desc"
    ),
    "newest_month_rows": over_base(
        f"""select {MONTH}, ad_type, {rows(("spend", "clicks"))} from ad_base
where perf_month = (select max(perf_month) from ad_base)"""
    ),
    "distinct_accounts": over_base("select count(distinct account) as accounts from ad_base"),
    "global_sums": over_base(
        "\nunion all\n".join(
            f"select '{n}' as measure, cast(sum({n}) as double) as total from ad_base" for n in MEASURES
        )
    ),
    "dedupe_nonnull_counts": """with kept as (
  select * from events qualify row_number() over (partition by user_id order by ts, event_id) = 1)
select count(event_id) as event_id, count(ts) as ts, count(user_id) as user_id, count(event_type) as event_type,
       count(value) as value, count(props) as props from kept""",
    "latest_row_per_key": """select user_id, event_type, event_id, value from events
qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1""",
    "metric_acos": site_type(ACOS),
    "metric_shares": site_type(f"{SPEND_SHARE}, {REVENUE_SHARE}, {PROFIT_SHARE}"),
    "metric_cpc_roi_cr": site_type(f"{CPC}, {ROI}, {CR}"),
    "monthly_trend": trend(lambda roi: roi),
    "monthly_trend_shown": trend(r2),
    "summary_cpc": summary(f"ad_type <> 'AFFILIATE' and {YM_RANGE}", "CPC"),
    "summary_cpc_all_months": summary(CPC_SCOPE, "CPC"),
    "summary_type": summary(f"ad_type = 'RECOMMEND' and {YM_RANGE}", "RECOMMEND"),
    "indexed_summary": summary(
        CPC_SCOPE,
        "CPC",
        head="""row_number() over (partition by perf_month order by is_total desc, owner nulls first) - 1 as idx,
* exclude (is_total)""",
    ),
    "detail_owner": detail(f"ad_type = 'RECOMMEND' and owner = '{OWNER}' and {YM_RANGE}"),
    "detail_owner_cpc": detail(f"ad_type <> 'AFFILIATE' and owner = '{OWNER}' and {YM_RANGE}"),
    "indexed_detail": over_base(
        f"""select row_number() over (order by {DETAIL_ORDER}, spend, acos, ad_revenue, store_revenue, spend_share,
store_profit, non_ad_profit, ad_profit, ad_profit_share, ad_revenue_share, ad_orders, clicks) - 1 as idx,
* exclude (is_total) from lines""",
        detail_lines(f"ad_type <> 'AFFILIATE' and owner = '{OWNER}' and {YM_RANGE}"),
    ),
    "search_summary": summary(f"ad_type = 'DIRECT' and {YM_RANGE}", "DIRECT", head="* exclude (is_total, clicks)"),
    "search_detail": detail(
        f"ad_type = 'DIRECT' and owner = '{OWNER}' and {YM_RANGE}", f", {CPC}, {ROI}, {CR}"
    ),
    "search_page": summary(
        f"ad_type = 'DIRECT' and {YM_RANGE}", "DIRECT", "limit 15 offset 15", "* exclude (is_total, clicks)"
    ),
    "search_newest_page": summary(
        "ad_type = 'DIRECT' and perf_month = (select max(perf_month) from ad_base)",
        "DIRECT",
        "limit 15",
        "* exclude (is_total, clicks)",
    ),
    "page_json_records": page_json(0),
    "page_json_past_the_end": page_json(100_000),
    "sample_fraction": f"""select event_id, user_id, event_type from events
where ('0x' || substr(md5('7:' || event_id), 1, 8))::bigint < {int(0.33 * 2**32)}""",
    "json_values": over_base(
        """select cast(json_array(ad_type, strftime(perf_month, '%Y-%m'), clicks, ad_orders) as varchar) as record
from ad_base"""
    ),
    "display_format": over_base(
        "select perf_month, account, ad_type, "
        + ", ".join(
            f"{shown(c)} as {c}"
            for c in ("spend", "ad_revenue", "ad_profit", "ad_orders", "clicks", "cpc", "roi", "cr")
        )
        + " from metrics",
        f""", sums as (select {BY_SITE_TYPE}, {sums()} from ad_base group by {BY_SITE_TYPE}),
metrics as (select {MONTH}, account, ad_type, spend, ad_revenue, ad_profit, ad_orders, clicks, {CPC}, {ROI}, {CR}
from sums)""",
    ),
    "page_deep": over_base(
        f"select * from paged order by {paged_order('perf_month desc')} limit 15 offset 20000", PAGED_ROWS
    ),
    "page_after_row": over_base(
        f"select * from paged order by {paged_order('perf_month desc')} limit 15 offset 20015", PAGED_ROWS
    ),
    "indexed_rows": over_base(
        f"select row_number() over (order by {paged_order('perf_month')}) - 1 as idx, * from paged", PAGED_ROWS
    ),
    "adjacent_duplicates": """select event_id, key from (
  select event_id, split_part(event_type, ']', 1) as key,
         lead(split_part(event_type, ']', 1)) over (order by ts, event_id) as following from events)
where key = following""",
    "sample_exact_size": """select event_id, user_id, event_type from (
  select *, row_number() over (order by md5('7:' || event_id), event_id) as place, count(*) over () as total from events)
where place <= round_even(0.33 * total, 0)""",
    "unpivot_category_totals": over_base(
        f"""select category, period, cast(sum(cell) as bigint) as total from (
  select coalesce(case when owner not like 'NATION\\_2%' escape '\\' then owner end, 'OTHER') as category,
         'y' || year(perf_month) as period,
         {whole('cast(ad_revenue as double)')} cell
  from ad_base where ad_revenue <> 0)
group by category, period having sum(cell) > 1000 order by category desc, period"""
    ),
    "scalar_strings": """select event_id, replace(substring(strftime(ts, '%Y-%m-%d'), 3, 8), '-', '') as short_period,
       right(strftime(ts, '%Y%m%d'), 6) as load_stamp, split_part(props, ':', 1) as prefix,
       split_part(cast(cast(value as decimal(18,2)) as varchar), '.', 1) as whole_part
from events""",
    "scalar_dates": """select o_orderkey, strftime(o_orderdate, '%Y%m') as month_key,
       strftime(o_orderdate, '%Y-%m') as month_text,
       strftime(o_orderdate - interval 1 month, '%Y%m') as previous_month
from orders""",
    "ingest_site_kpis": kpis_by_month(ingest_parts("up"), kpis("up")),
    "placement_kpis": kpis_by_month(ingest_parts("up"), kpis("up", where="placement = 'Sponsored Search'")),
    "ingest_rejects": over_base(
        f"""select {MONTH}, account, reason from (
  select coalesce(r.perf_month, b.perf_month) perf_month, coalesce(r.account, b.account) account,
    case when r.account is null then 'no ad report' when b.account is null then 'no dashboard'
         when missing > 0 then 'missing column in ad report' when r.bad > 0 then 'bad value in ad report'
         when b.bad > 0 then 'bad value in dashboard' end reason
  from (select perf_month, account, count(*) filter (clicks = 13) bad, count(*) filter (account like '%7-my') missing
        from up_reports group by all) r
  full join (select perf_month, account, cast(orders % 11 = 0 as int) bad from up_boards where account not like '%3-th') b
    on r.perf_month = b.perf_month and r.account = b.account)
where reason is not null""",
        ingest_parts("up"),
    ),
    "kpi_column_rename": kpis_by_month(
        ingest_parts("up"),
        f"""select perf_month, account, revenue as "Revenue", spend as "Spend", clicks as "Clicks",
units as "Units_Sold", impression as "Impressions", ad_orders from ({report_sums("up_reports", "perf_month, account")})""",
    ),
    "site_month_upsert": over_base(
        f"""select * from ({kpis("old", "account")}) where account not in (select account from ({kpis("new", "account")}))
union all by name {kpis("new", "account")}""",
        ingest_parts("old", "DIRECT", YM_BEFORE_RANGE, "account")
        + ingest_parts("new", "DIRECT", f"{YM_RANGE} and account like '%-th'", "account"),
    ),
    "site_upsert_all_months": kpis_by_month(
        ingest_parts("old") + ingest_parts("new", "RECOMMEND", "true and account like '%-th'"),
        f"""select * from ({kpis("old")})
where (perf_month, account) not in (select (perf_month, account) from ({kpis("new")}))
union all by name {kpis("new")}""",
    ),
}

# The same results out of stored tables.
SQL["summary_from_partials"] = SQL["summary_cpc_all_months"]
SQL["trend_from_partials"] = SQL["monthly_trend"]
SQL["landed_replies_nested"] = SQL["json_envelope_campaign"]
SQL["filter_account_indexed"] = SQL["filter_account_contains"]
SQL["ingest_site_kpis_bucketed"] = SQL["ingest_site_kpis"]
SQL["site_bucket_upsert"] = SQL["site_upsert_all_months"]
SQL["distinct_accounts_by_range"] = over_base(
    """select strftime(last_month, '%Y-%m') as last_month, count(distinct account) as accounts, true as is_near
from (select distinct account, unnest(range(perf_month::timestamp, perf_month::timestamp + interval 12 month, interval 1 month)) last_month from ad_base)
group by last_month"""
)
