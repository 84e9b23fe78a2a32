"""Report bundles: the DataFrames of one page of the household app, by name."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..operators import finders, investments, pantry, savings_plans, spending, stock, subscriptions, trends
from ..schema import Ledger
from ..sources.scratch import written


def month_report(L: Ledger, year: int, month: int) -> dict[str, DataFrame]:
    at = (L, year, month)
    return {
        "totals": spending.month_totals(*at), "categories": spending.month_categories(*at),
        "groups": spending.month_groups(*at), "owners": spending.month_owners(*at), "stores": spending.month_stores(*at),
        "statements": spending.statement_presence(*at), "unmatched_receipts": spending.unmatched_receipts(*at),
        "missing_receipts": spending.missing_receipts(*at),
    }


def trend_report(L: Ledger, months: int, end: tuple[int, int], today: dt.date) -> dict[str, DataFrame]:
    return {
        "months": trends.trend_months(L, months, end, today), "by_category": trends.trend_by_category(L, months, end),
        "by_group": trends.trend_by_group(L, months, end), "categories": trends.category_averages(L, months, end, today),
        "averages": trends.trend_averages(L, months, end, today), "movers": trends.spend_movers(L, months, end, today),
    }


def pantry_dashboard(L: Ledger, today: dt.date) -> dict[str, DataFrame]:
    return {
        "staples": pantry.rolling_staples(L, today), "deficits": pantry.pantry_deficits(L, today),
        "essentials": pantry.regular_essentials(L, today), "leakage": pantry.waste_leakage(L, today),
        "inflation": pantry.price_inflation(L),
    }


def stock_report(L: Ledger, today: dt.date) -> dict[str, DataFrame]:
    return {"items": stock.stock_items(L, today), "summary": stock.stock_summary(L, today), "use_first": stock.use_first(L, today)}


def waste_report(L: Ledger, today: dt.date, days: int = 90) -> dict[str, DataFrame]:
    at = (L, today, days)
    return {
        "score": stock.waste_score(*at), "by_reason": stock.waste_by_reason(*at), "by_group": stock.waste_by_group(*at),
        "top": stock.waste_by_product(*at), "repeat": stock.repeat_waste(*at), "rescued": stock.rescued(*at),
        "duplicates": stock.stock_duplicates(L, today), "opinions": stock.product_opinions(L),
        "summary": stock.stock_summary(L, today),
    }


def subscription_report(L: Ledger) -> dict[str, DataFrame]:
    items = written(subscriptions.subscription_items(L, include_hidden=True))
    shown = items.filter("not hidden")
    return {
        "items": subscriptions.sorted_items(shown, L), "hidden": items.filter("hidden").select(*L.keys, "key", "name"),
        "summary": subscriptions.subscription_summary(shown, L),
    }


def investment_report(L: Ledger, today: dt.date, broker: str | None = None) -> dict[str, DataFrame]:
    """`broker` narrows every part to one broker."""
    scoped = L if broker is None else L.with_(
        statements=L.statements.filter(L.statements.bank == broker), plans=L.plans.filter(L.plans.broker == broker)
    )
    named = written(investments.resolve_instruments(scoped, today))
    report = {
        "brokers": investments.broker_totals(L, named), "totals": investments.investment_totals(scoped, named, today),
        "years": investments.investment_years(scoped, named, today), "months": investments.investment_months(scoped, named, today),
        "average": investments.investment_avg12(scoped, named, today), "instruments": investments.instrument_totals(scoped, named),
        "plan_check": investments.plan_check(scoped, today), "known_instruments": investments.known_instruments(L),
        "moved_out": finders.moved_out(L, broker), "side_flows": finders.depot_side_flows(L, broker),
        "plans": savings_plans.plan_view(scoped, today), "plan_summary": savings_plans.plan_summary(scoped, today),
    }
    if broker:
        report["bookings"] = finders.bookings_newest_first(L, broker)
    return report
