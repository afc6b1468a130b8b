"""One query per operator, over the order, event, page and document tables.

Ad facts are derived from order lines (``adtally.sources.warehouse``).  Ad
reports are the facts of type DIRECT, store dashboards the sums of all facts
per month and site.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adtally.functions import dates, metrics, money, scope, text
from adtally.functions.casts import cast_cells
from adtally.operators import distinct, display, keyed, ordered, reshape, totals
from adtally.operators.upsert import upsert
from adtally.plans import detail, extract, ingest, search, summary, trend
from adtally.schema import (
    AFFILIATE,
    CAMPAIGN_RECORD,
    CPC,
    DIRECT,
    MEASURES,
    MONEY,
    PAGE_SIZE,
    PLACEMENTS,
    RECOMMEND,
    STORE_RECORD,
)
from adtally.session import scratch_folder
from adtally.sources import bucketed, partials, skipping
from adtally.sources.fact import in_currency, write_fact
from adtally.sources.landed import read_records
from adtally.sources.warehouse import ad_base, table

YM = "199803"
YM_BEFORE = "199802"
CUTOVER = "199801"
OWNER = "NATION_0"
LOAD_DATE = "date'1998-04-05'"
SITE_KEYS = ["perf_month", "account"]
DEEP_OFFSET = 20_000
# Columns of the order lines that the data model doesn't name.
FURTHER = ("l_orderkey", "l_linestatus")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def shown_month(df: DataFrame) -> DataFrame:
    return df.withColumn("perf_month", F.expr(dates.month_text("perf_month")))


# Sources, projections and filters.


@query
def fact_scan(spark, root):
    return shown_month(in_currency(ad_base(spark, root)))


@query
def month_extract(spark, root):
    return extract.month_extract(ad_base(spark, root, ym=YM, further=FURTHER), YM)


@query
def filter_month(spark, root):
    rows = ad_base(spark, root, ["perf_month", "ad_type", "spend", "clicks"], YM)
    return shown_month(in_currency(rows.where(dates.in_month("perf_month", YM))))


@query
def filter_ad_type(spark, root):
    rows = ad_base(spark, root, ["perf_month", "ad_type", "spend", "clicks"])
    return shown_month(in_currency(rows.where(scope.scope_type(RECOMMEND))))


@query
def filter_exclude_type(spark, root):
    rows = ad_base(spark, root, ["perf_month", "ad_type", "spend", "clicks"])
    return shown_month(in_currency(rows.where(F.col("ad_type") != AFFILIATE)))


@query
def filter_owner_like(spark, root):
    rows = ad_base(spark, root, ["owner", "perf_month", "clicks"])
    return shown_month(rows.where(scope.owner_like("NATION\\_1%")))


@query
def filter_account_contains(spark, root):
    rows = ad_base(spark, root, ["account", "perf_month", "ad_type", "clicks"])
    return shown_month(rows.where(scope.in_scope(DIRECT, account="7-")))


@query
def filter_account_indexed(spark, root):
    """The same rows out of stored facts, from the files that an index of n-grams leaves."""
    facts, index = scratch_folder(spark), scratch_folder(spark)
    write_fact(ad_base(spark, root), facts)
    skipping.refresh(spark, facts, index)
    rows = skipping.read(spark, facts, index, {"account": "7-"}).where(scope.in_scope(DIRECT))
    return shown_month(rows.select("account", "perf_month", "ad_type", "clicks"))


@query
def scope_router(spark, root):
    rows = ad_base(spark, root, ["perf_month", "ad_type", "clicks"])
    covered = rows.where(scope.in_scope(CPC, cutover=CUTOVER))
    return shown_month(covered.groupBy("perf_month", "ad_type").agg(F.count("*").alias("n"), F.sum("clicks").alias("clicks")))


@query
def channel_bucket(spark, root):
    rows = ad_base(spark, root, ["ad_type", "clicks"]).selectExpr(f"{scope.CHANNEL} as channel", "clicks")
    return rows.groupBy("channel").agg(F.count("*").alias("n"), F.sum("clicks").alias("clicks"))


@query
def site_filter(spark, root):
    mark = "case c_custkey % 4 when 0 then '-TH' when 1 then '-ph' when 2 then '-My' else '-sg' end"
    sites = table(spark, root, "customer").selectExpr("c_custkey", f"concat(c_name, {mark}) as site")
    return sites.where(text.is_uploaded_site("site"))


@query
def site_shop_key(spark, root):
    rows = ad_base(spark, root, ["account", "clicks"])
    sites = rows.groupBy("account").agg(F.sum("clicks").alias("clicks"))
    return sites.selectExpr("account", f"{text.shop_of_site('account')} as shop", "clicks")


@query
def cast_with_rejects(spark, root):
    cells = table(spark, root, "documents").selectExpr("source", "replace(source, 'src1', '') as cell")
    typed = cast_cells(cells, {"cell": "amount"}, {"cell": "number"}, keep=("source",))
    sums = ["sum(amount) as amount", "sum(number) as number", "sum(bad_cells) as bad_cells"]
    return totals.aggregated(typed, ["source"], sums).withColumn("amount", F.expr(money.in_currency("amount")))


@query
def json_envelope_rows(spark, root):
    """Envelopes with no record, one, one and an empty one, or three; some texts are cut."""
    records = """case event_id % 4 when 0 then '' when 1 then props when 2 then concat(props, ',{}')
        else concat_ws(',', props, props, props) end"""
    envelope = f"""if(event_id % 50 = 7, '{{"data_list":[{{"k"', concat('{{"data_list":[', {records}, ']}}')) as reply"""
    events = table(spark, root, "events").selectExpr("event_id", envelope)
    parsed = reshape.parsed_envelopes(events, "reply", T.StructType([T.StructField("k", T.LongType())]))
    return reshape.envelope_rows(parsed, keep=["event_id"])


@query
def json_envelope_campaign(spark, root):
    """One envelope per order with a record for each of its lines; some records lack a field, some envelopes are empty."""
    needs = ["account", "store_revenue", "spend", "clicks", "ad_orders"]
    facts = in_currency(ad_base(spark, root, needs, further=["l_orderkey"]))
    record = F.expr("""struct(account as account_name, store_revenue, spend, clicks, ad_orders * 2 as store_units_sold,
        clicks * 20 as impression, if(clicks % 10 = 0, null, ad_orders) as store_orders)""")
    lists = facts.groupBy("l_orderkey").agg(F.collect_list(record).alias("data_list"))
    empty = table(spark, root, "supplier").selectExpr("""'{"data_list":[]}' as reply""")
    replies = lists.selectExpr("to_json(struct(data_list)) as reply").unionByName(empty)
    return reshape.envelope_rows(reshape.parsed_envelopes(replies, "reply", CAMPAIGN_RECORD))


RECORDS_PER_REPLY = 20_000


@query
def landed_replies_nested(spark, root):
    """The campaign records as landed files whose records are nested, with arrays before and behind them."""
    needs = ["account", "store_revenue", "spend", "clicks", "ad_orders"]
    facts = in_currency(ad_base(spark, root, needs, further=["l_orderkey"]))
    record = F.expr("""to_json(struct(account as account_name, store_revenue, named_struct('list', array(struct(clicks as x, null as y), struct(null as x, '} ]' as y))) as extra, spend,
        clicks, ad_orders * 2 as store_units_sold, clicks * 20 as impression, if(clicks % 10 = 0, null, ad_orders) as store_orders))""")
    files = facts.count() // RECORDS_PER_REPLY + 1
    lists = facts.groupBy(F.pmod(F.xxhash64("l_orderkey"), F.lit(files)).alias("file")).agg(F.concat_ws(",", F.collect_list(record)).alias("records"))
    path = scratch_folder(spark)
    reply = """concat('{"meta":{"list":[{"account_name":"no"}]},"data_list":[', records, '],"more":[{"spend":1}],"total":{"n":1}}') as reply"""
    lists.selectExpr(reply).write.option("maxRecordsPerFile", 1).text(path)
    return read_records(spark, path, CAMPAIGN_RECORD)


@query
def json_envelope_store(spark, root):
    """One envelope per site with a record for each month."""
    record = F.expr(f"struct(account as account_name, {', '.join(STORE_RECORD.fieldNames()[1:])})")
    lists = dashboards(spark, root).groupBy("account").agg(F.collect_list(record).alias("data_list"))
    replies = lists.selectExpr("to_json(struct(data_list)) as reply")
    return reshape.envelope_rows(reshape.parsed_envelopes(replies, "reply", STORE_RECORD))


# Totals.


@query
def channel_month_totals(spark, root):
    return totals.channel_month_totals(ad_base(spark, root, ["ad_type", "perf_month", "spend", "ad_revenue"]))


@query
def type_month_totals(spark, root):
    return totals.type_month_totals(ad_base(spark, root, ["ad_type", "perf_month", "spend", "ad_revenue"]))


@query
def scope_total(spark, root):
    facts = ad_base(spark, root, ["ad_type", "perf_month", *MEASURES])
    return totals.scope_total(facts.where(scope.in_scope(CPC, cutover=CUTOVER)))


@query
def owner_breakdown(spark, root):
    facts = ad_base(spark, root, ["ad_type", "perf_month", "owner", *MEASURES], summed=True)
    return totals.owner_breakdown(facts.where(scope.in_scope(CPC, cutover=CUTOVER)))


@query
def latest_month(spark, root):
    return totals.latest_month(ad_base(spark, root, ["perf_month"]))


@query
def month_list(spark, root):
    return totals.month_list(ad_base(spark, root, ["perf_month"]))


@query
def newest_month_rows(spark, root):
    rows = ad_base(spark, root, ["ad_type", "perf_month", "spend", "clicks"])
    return shown_month(in_currency(totals.newest_month_rows(rows)))


@query
def distinct_accounts(spark, root):
    return totals.distinct_accounts(ad_base(spark, root, ["account"]))


RANGE_MONTHS = 12
# What estimates may be off by: three standard deviations of a sketch.
ESTIMATE_BOUND = 0.05


@query
def distinct_accounts_by_range(spark, root):
    """Accounts of each twelve months up to a month: the exact number, and whether the united sketches come near it."""
    facts = ad_base(spark, root, ["account", "perf_month"])
    sketches = totals.account_sketches(facts)
    month = "explode(sequence(perf_month, add_months(perf_month, {}), interval 1 month)) as last_month".format(RANGE_MONTHS - 1)
    united = totals.estimated_accounts(sketches.selectExpr(month, "accounts"), ["last_month"]).withColumnRenamed("accounts", "estimate")
    exact = facts.distinct().selectExpr(month, "account").groupBy("last_month").agg(F.count_distinct("account").alias("accounts"))
    near = f"abs(estimate - accounts) <= {ESTIMATE_BOUND} * accounts as is_near"
    return united.join(exact, "last_month").selectExpr(f"{dates.month_text('last_month')} as last_month", "accounts", near)


@query
def global_sums(spark, root):
    return totals.global_sums(ad_base(spark, root, MEASURES))


@query
def dedupe_nonnull_counts(spark, root):
    return distinct.dedupe_counts(table(spark, root, "events"), "user_id", ["ts", "event_id"])


@query
def latest_row_per_key(spark, root):
    events = table(spark, root, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return distinct.last_per_key(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


# Metrics, over every month, site and ad type.

SITE_TYPE = ["account", "ad_type"]


def site_type_totals(spark, root, measures):
    facts = ad_base(spark, root, ["perf_month", *SITE_TYPE, *measures], summed=True)
    return totals.month_totals(facts, SITE_TYPE, measures)


@query
def metric_acos(spark, root):
    rows = site_type_totals(spark, root, ("spend", "ad_revenue"))
    return rows.selectExpr("perf_month", *SITE_TYPE, metrics.ACOS)


@query
def metric_shares(spark, root):
    rows = site_type_totals(spark, root, MONEY)
    shares = (metrics.SPEND_SHARE, metrics.AD_REVENUE_SHARE, metrics.AD_PROFIT_SHARE)
    return rows.selectExpr("perf_month", *SITE_TYPE, *shares)


@query
def metric_cpc_roi_cr(spark, root):
    rows = site_type_totals(spark, root, ("spend", "ad_revenue", "ad_orders", "clicks"))
    return rows.selectExpr("perf_month", *SITE_TYPE, *metrics.CLICK_RATIOS)


# Reports.


@query
def monthly_trend(spark, root):
    return trend.monthly_trend(ad_base(spark, root, ["ad_type", "perf_month", "spend", "ad_revenue"]))


@query
def monthly_trend_shown(spark, root):
    return trend.monthly_trend(ad_base(spark, root, ["ad_type", "perf_month", "spend", "ad_revenue"]), shown=True)


SUMMARY_NEEDS = ["ad_type", "perf_month", "owner", *MEASURES]


@query
def summary_cpc(spark, root):
    return summary.summary(ad_base(spark, root, SUMMARY_NEEDS, YM, summed=True), CPC, YM, CUTOVER)


@query
def summary_cpc_all_months(spark, root):
    return summary.summary(ad_base(spark, root, SUMMARY_NEEDS, summed=True), CPC, None, CUTOVER)


@query
def summary_type(spark, root):
    return summary.summary(ad_base(spark, root, SUMMARY_NEEDS, YM, summed=True), RECOMMEND, YM, CUTOVER)


def stored_partials(spark, root):
    """Facts stored by month, and their partial sums."""
    facts, sums = scratch_folder(spark), scratch_folder(spark)
    write_fact(ad_base(spark, root), facts)
    partials.refresh(spark, facts, sums)
    return partials.read(spark, sums)


@query
def summary_from_partials(spark, root):
    return summary.summary(stored_partials(spark, root), CPC, None, CUTOVER)


@query
def trend_from_partials(spark, root):
    return trend.monthly_trend(stored_partials(spark, root))


@query
def indexed_summary(spark, root):
    return summary.indexed_summary(ad_base(spark, root, SUMMARY_NEEDS, summed=True), CPC, None, CUTOVER)


@query
def detail_owner(spark, root):
    return detail.detail(ad_base(spark, root, ym=YM, further=FURTHER), RECOMMEND, YM, OWNER, CUTOVER)


@query
def detail_owner_cpc(spark, root):
    return detail.detail(ad_base(spark, root, ym=YM, further=FURTHER), CPC, YM, OWNER, CUTOVER)


@query
def indexed_detail(spark, root):
    return detail.indexed_detail(ad_base(spark, root, ym=YM), CPC, YM, OWNER, CUTOVER)


@query
def search_summary(spark, root):
    return search.search_summary(ad_base(spark, root, SUMMARY_NEEDS, YM, summed=True), DIRECT, YM)


@query
def search_detail(spark, root):
    return search.search_detail(ad_base(spark, root, ym=YM, further=FURTHER), DIRECT, YM, OWNER)


@query
def search_page(spark, root):
    facts = ad_base(spark, root, SUMMARY_NEEDS, YM, summed=True)
    return search.search(facts, DIRECT, YM, offset=PAGE_SIZE)


@query
def search_newest_page(spark, root):
    return search.search(ad_base(spark, root, SUMMARY_NEEDS, summed=True))


@query
def page_json_records(spark, root):
    return search.search_json(ad_base(spark, root, SUMMARY_NEEDS, YM, summed=True), DIRECT, YM)


@query
def page_json_past_the_end(spark, root):
    return search.search_json(ad_base(spark, root, SUMMARY_NEEDS, YM, summed=True), DIRECT, YM, offset=100_000)


@query
def json_values(spark, root):
    rows = ad_base(spark, root, ["ad_type", "perf_month", "clicks", "ad_orders"])
    return display.json_values(shown_month(rows))


@query
def display_format(spark, root):
    rows = site_type_totals(spark, root, ("spend", "ad_revenue", "ad_profit", "ad_orders", "clicks"))
    rows = rows.selectExpr("*", *metrics.CLICK_RATIOS)
    return display.display_format(rows, rows.columns[3:])


# Whole-frame order.

PAGED = ["perf_month", "account", "ad_type", "ad_orders", "clicks", "spend", "ad_profit"]


def paged_rows(spark, root):
    return shown_month(in_currency(ad_base(spark, root, PAGED)))


@query
def page_deep(spark, root):
    return ordered.far_page(paged_rows(spark, root), ["perf_month desc"], DEEP_OFFSET, PAGE_SIZE)


@query
def page_after_row(spark, root):
    """The page behind the last row of the far page, by that row's cursor."""
    rows, order = paged_rows(spark, root), ["perf_month desc"]
    last = ordered.page_after(ordered.far_page(rows, order, DEEP_OFFSET, PAGE_SIZE), order, PAGE_SIZE).collect()[-1]
    return ordered.page_after(rows, order, PAGE_SIZE, last["cursor"]).drop("cursor")


@query
def indexed_rows(spark, root):
    return ordered.indexed(paged_rows(spark, root), ["perf_month"])


@query
def adjacent_duplicates(spark, root):
    events = table(spark, root, "events").select("ts", "event_id", "event_type")
    key = F.expr(text.prefix_before("event_type", "]"))
    hits = ordered.adjacent_duplicates(events, key, ["ts", "event_id"])
    return hits.select("event_id", "key")


@query
def sample_exact_size(spark, root):
    events = table(spark, root, "events").select("event_id", "user_id", "event_type")
    return ordered.sample_exact(events, 0.33, ["event_id"], 7)


@query
def sample_fraction(spark, root):
    events = table(spark, root, "events").select("event_id", "user_id", "event_type")
    return ordered.sample(events, 0.33, ["event_id"], 7)


# Reshaping and scalars.


@query
def unpivot_category_totals(spark, root):
    facts = in_currency(ad_base(spark, root, ["owner", "perf_month", "ad_revenue"]))
    # A wide table has a column for each year that it holds.
    held = facts.selectExpr("year(perf_month) as year").distinct().orderBy("year").collect()
    years = {f"y{r.year}_sales": f"if(year(perf_month) = {r.year}, ad_revenue, null)" for r in held}
    # Owners numbered 2x have no category of their own.
    category = r"if(owner like 'NATION\\_2%', null, owner) as category_name"
    wide = facts.selectExpr(category, *[f"{cell} as {name}" for name, cell in years.items()])
    return reshape.unpivot_totals(wide, "category_name", list(years), 1000, suffix="_sales")


@query
def scalar_strings(spark, root):
    events = table(spark, root, "events").selectExpr("*", "cast(ts as date) as day")
    return events.selectExpr(
        "event_id",
        f"{text.short_period('day')} as short_period",
        f"{dates.load_stamp('day')} as load_stamp",
        f"{text.prefix_before('props', ':')} as prefix",
        f"{text.whole_part('cast(cast(value as decimal(18,2)) as string)')} as whole_part",
    )


@query
def scalar_dates(spark, root):
    return table(spark, root, "orders").selectExpr(
        "o_orderkey",
        f"{dates.month_key('o_orderdate')} as month_key",
        f"{dates.month_text('o_orderdate')} as month_text",
        f"{dates.previous_month_key('o_orderdate')} as previous_month",
    )


# Upload ingest.


def reports(spark, root, ad_type=DIRECT, ym=None):
    facts = ad_base(
        spark, root, ["ad_type", "account", "perf_month", "spend", "ad_revenue", "clicks", "ad_orders"], ym
    )
    return facts.where(F.col("ad_type") == ad_type).selectExpr(
        "perf_month",
        "account",
        f"if(ad_orders % 2 = 1, '{PLACEMENTS[0]}', '{PLACEMENTS[1]}') as placement",
        "spend",
        "ad_revenue as store_revenue",
        "clicks * 20 as impression",
        "clicks",
        "ad_orders as store_orders",
        "ad_orders + clicks % 3 as store_units_sold",
    )


def dashboards(spark, root, ym=None):
    facts = ad_base(spark, root, ["account", "perf_month", "store_revenue", "clicks", "ad_orders"], ym)
    measures = ("store_revenue", "clicks", "ad_orders", "rows")
    return totals.group_totals(facts.selectExpr("*", "1 as rows"), SITE_KEYS, measures).selectExpr(
        *SITE_KEYS,
        "store_revenue as account_revenue",
        "clicks as product_visitors",
        "rows as buyers",
        "ad_orders as orders",
        "clicks * 3 as pageviews",
        "ad_orders * 2 as br_units_sold",
    )


@query
def ingest_site_kpis(spark, root):
    kpis = ingest.site_kpis(reports(spark, root), dashboards(spark, root), LOAD_DATE, SITE_KEYS)
    return shown_month(kpis)


@query
def placement_kpis(spark, root):
    kpis = ingest.placement_kpis(
        reports(spark, root), dashboards(spark, root), PLACEMENTS[0], LOAD_DATE, SITE_KEYS
    )
    return shown_month(kpis)


@query
def ingest_rejects(spark, root):
    """Every reason occurs: some reports and boards are left out or spoilt by the numbers in them."""
    given = reports(spark, root).selectExpr("*", "int(clicks = 13) as bad_cells", "int(account like '%7-my') as missing_headers")
    boards = dashboards(spark, root).where("account not like '%3-th'").selectExpr("*", "int(orders % 11 = 0) as bad_cells")
    return shown_month(ingest.rejects(given, boards, SITE_KEYS))


@query
def kpi_column_rename(spark, root):
    sums = ingest.report_sums(reports(spark, root), SITE_KEYS).drop("has_report", "bad_report", "missing_headers")
    return shown_month(ingest.renamed_kpis(sums))


@query
def site_month_upsert(spark, root):
    current = ingest.site_kpis(
        reports(spark, root, ym=YM_BEFORE), dashboards(spark, root, YM_BEFORE).drop("perf_month"), LOAD_DATE
    )
    arriving = reports(spark, root, ym=YM).where(F.col("account").endswith("-th"))
    incoming = ingest.site_kpis(arriving, dashboards(spark, root, YM).drop("perf_month"), LOAD_DATE)
    return upsert(current, incoming)


@query
def site_upsert_all_months(spark, root):
    board = dashboards(spark, root)
    current = ingest.site_kpis(reports(spark, root), board, LOAD_DATE, SITE_KEYS)
    arriving = reports(spark, root, RECOMMEND).where(F.col("account").endswith("-th"))
    incoming = ingest.site_kpis(arriving, board, LOAD_DATE, SITE_KEYS)
    return shown_month(upsert(current, incoming, SITE_KEYS))


@query
def site_bucket_upsert(spark, root):
    """The upsert of all months as a change of a stored keyed table."""
    path, board = scratch_folder(spark), dashboards(spark, root)
    keyed.create(ingest.site_kpis(reports(spark, root), board, LOAD_DATE, SITE_KEYS), path, SITE_KEYS, buckets=16)
    arriving = reports(spark, root, RECOMMEND).where(F.col("account").endswith("-th"))
    keyed.upsert(spark, path, ingest.site_kpis(arriving, board, LOAD_DATE, SITE_KEYS))
    return shown_month(keyed.read(spark, path))


def bucketed_inputs(spark, root):
    """Report sums and dashboards by month and site, stored in buckets of both."""
    sums = ingest.summed_reports(reports(spark, root), SITE_KEYS)
    return bucketed.stored(sums, SITE_KEYS, 16), bucketed.stored(dashboards(spark, root), SITE_KEYS, 16)


@query
def ingest_site_kpis_bucketed(spark, root):
    return shown_month(ingest.site_kpis(*bucketed_inputs(spark, root), LOAD_DATE, SITE_KEYS))
