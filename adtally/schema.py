"""Column names, types and fixed values of the ad-performance data model.

Money is held as fixed-point ``bigint`` in 1/10,000 of the currency unit.
Integer sums are exact in any order and stay inside whole-stage codegen, where
sums of 17-digit decimals fall back to big-number objects.  Reports convert to
currency only after aggregation.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY_SCALE = 4
MONEY_UNITS = 10**MONEY_SCALE

MONEY = ("spend", "ad_revenue", "store_revenue", "store_profit", "non_ad_profit", "ad_profit")
COUNTS = ("ad_orders", "clicks")
MEASURES = MONEY + COUNTS

FACT = T.StructType(
    [
        T.StructField("ad_type", T.StringType()),
        T.StructField("account", T.StringType()),
        T.StructField("perf_month", T.DateType()),
        T.StructField("owner", T.StringType()),
        *[T.StructField(name, T.LongType()) for name in MEASURES],
    ]
)
# Held by some fact tables only.
OPTIONAL_MONEY = ("gross_margin_delta",)

# Ad-type codes and labels of the report lines.
CPC = "CPC"
DIRECT = "DIRECT"
RECOMMEND = "RECOMMEND"
AFFILIATE = "AFFILIATE"
TOTAL_LABEL = "TOTAL"
TOTAL_OWNER = ""
OTHER_CATEGORY = "OTHER"

# Month from which the CPC scope means every type but affiliate.
CPC_CUTOVER = "202103"

# Rows on a page, and the ad type searched when none is given.
PAGE_SIZE = 15
SEARCH_AD_TYPE = DIRECT

# Site suffixes that take part in an upload.
SITE_MARKS = ("-th", "-ph", "-my")

# Column names of the source system's fact table.
SOURCE_COLUMNS = {
    "广告类型": "ad_type",
    "业绩年月": "perf_month",
    "广告花费": "spend",
    "广告销售额": "ad_revenue",
    "站点销售额": "store_revenue",
    "站点实际利润": "store_profit",
    "非广告部分利润": "non_ad_profit",
    "广告利润": "ad_profit",
    "广告订单量": "ad_orders",
    "广告Click": "clicks",
    "广告接手人": "owner",
    "实际总毛利对比(正值为毛利增加)": "gross_margin_delta",
}

# Ad types as the source system spells them.
SOURCE_AD_TYPES = {"直通车": DIRECT, "超级推荐": RECOMMEND, "联盟": AFFILIATE}

# Ad report cells, by header text.
REPORT_MONEY = {"Spend": "spend", "Store Revenue": "store_revenue"}
REPORT_COUNTS = {
    "Impression": "impression",
    "Clicks": "clicks",
    "Store Orders": "store_orders",
    "Store Units Sold": "store_units_sold",
}

# Store dashboard cells, by position in the data row.
DASHBOARD_ROW = 6
DASHBOARD_CELLS = (
    "account_revenue",
    "product_visitors",
    "buyers",
    "orders",
    "pageviews",
    "br_units_sold",
)

# KPI table names of the site columns.  The ad orders and the
# dashboard orders would share one name there, so they are kept apart here.
KPI_NAMES = {
    "store_revenue": "Revenue",
    "spend": "Spend",
    "clicks": "Clicks",
    "store_units_sold": "Units_Sold",
    "impression": "Impressions",
    "store_orders": "ad_orders",
    "account_revenue": "account_Revenue",
    "product_visitors": "Product_Visitors",
    "buyers": "Buyers",
    "orders": "Orders",
    "br_units_sold": "br_Units_Sold",
    "pageviews": "Pageviews",
}

PLACEMENTS = ("Sponsored Search", "Sponsored Products")

# Rows of the two landed API replies.
CAMPAIGN_RECORD = T.StructType(
    [
        T.StructField("account_name", T.StringType()),
        T.StructField("store_revenue", T.DoubleType()),
        T.StructField("spend", T.DoubleType()),
        T.StructField("clicks", T.LongType()),
        T.StructField("store_units_sold", T.LongType()),
        T.StructField("impression", T.LongType()),
        T.StructField("store_orders", T.LongType()),
    ]
)
STORE_RECORD = T.StructType(
    [
        T.StructField("account_name", T.StringType()),
        T.StructField("account_revenue", T.DoubleType()),
        T.StructField("product_visitors", T.LongType()),
        T.StructField("buyers", T.LongType()),
        T.StructField("orders", T.LongType()),
        T.StructField("pageviews", T.LongType()),
        T.StructField("br_units_sold", T.LongType()),
    ]
)
