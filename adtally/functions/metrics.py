"""Advertising ratios over the measure columns of a row, a group or a total line."""

from __future__ import annotations

from .money import percent, ratio, round2

# Ad spend per ad revenue.
ACOS = f"{percent('spend', 'ad_revenue')} as acos"
# Ad spend and ad revenue per store revenue.
SPEND_SHARE = f"{percent('spend', 'store_revenue')} as spend_share"
AD_REVENUE_SHARE = f"{percent('ad_revenue', 'store_revenue')} as ad_revenue_share"
# Ad profit per store profit.
AD_PROFIT_SHARE = f"{percent('ad_profit', 'store_profit')} as ad_profit_share"
# Spend per click, revenue per spend, ad orders per click.
COST_PER_CLICK = f"{round2(ratio('spend', 'clicks'))} as cpc"
RETURN_ON_SPEND = f"{round2(ratio('ad_revenue', 'spend'))} as roi"
CONVERSION_RATE = f"{round2(ratio('ad_orders', 'clicks'))} as cr"

CLICK_RATIOS = (COST_PER_CLICK, RETURN_ON_SPEND, CONVERSION_RATE)
