"""Connectors to web services as tables: quotes and histories, shop reviews.

A client asks a service for JSON, with a timeout, pauses between calls and
retries, and flattens what it gets. The transport is a function, so tests and
closed networks put their own in its place; nothing here runs where no network
is.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession

from millrace.sources.text import read_json_data

#: What each method asks for: a path, and the modules of the answer.
HISTORY, SUMMARY, SEARCH, OPTIONS = "/v8/finance/chart/{symbol}", "/v10/finance/quoteSummary/{symbol}", "/v1/finance/search", "/v7/finance/options/{symbol}"
METHODS = {
    "history": (HISTORY, None), "dividends": (HISTORY, "dividends"), "splits": (HISTORY, "splits"), "actions": (HISTORY, "dividends,splits"), "options": (OPTIONS, None), "option_chain": (OPTIONS, None), "news": (SEARCH, None),
    "quote": (SUMMARY, "price"), "info": (SUMMARY, "assetProfile,summaryDetail"), "fast_info": (SUMMARY, "summaryDetail"), "calendar": (SUMMARY, "calendarEvents"), "major_holders": (SUMMARY, "majorHoldersBreakdown"), "institutional_holders": (SUMMARY, "institutionOwnership"),
    "mutual_fund_holders": (SUMMARY, "fundOwnership"), "insider_transactions": (SUMMARY, "insiderTransactions"), "earnings_estimate": (SUMMARY, "earningsTrend"), "earnings_history": (SUMMARY, "earningsHistory"), "eps_trend": (SUMMARY, "earningsTrend"), "eps_revisions": (SUMMARY, "earningsTrend"),
    "revenue_estimate": (SUMMARY, "earningsTrend"), "growth_estimates": (SUMMARY, "earningsTrend"), "recommendations": (SUMMARY, "recommendationTrend"), "analyst_price_targets": (SUMMARY, "financialData"),
    "earnings": (SUMMARY, "earnings"), "sustainability": (SUMMARY, "esgScores"), "funds_data": (SUMMARY, "fundProfile,fundPerformance,topHoldings"), "top_holdings": (SUMMARY, "topHoldings"),
    "income_statement": (SUMMARY, "incomeStatementHistory"), "balance_sheet": (SUMMARY, "balanceSheetHistory"), "cash_flow": (SUMMARY, "cashflowStatementHistory"),
}


def fetch(url: str, timeout: float) -> dict:
    with urlopen(Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=timeout) as r:  # noqa: S310
        return json.loads(r.read())


def flatten(value, prefix: str = "") -> dict:
    """Nested objects as dotted keys; a number that comes with a format is the number."""
    if isinstance(value, dict):
        if "raw" in value:
            return {prefix: value["raw"]}
        out: dict = {}
        for k, v in value.items():
            out |= flatten(v, f"{prefix}.{k}" if prefix else k)
        return out
    return {prefix: value if not isinstance(value, list) else json.dumps(value)}


def records(answer: dict) -> list[dict]:
    """Rows of an answer: series by time, lists of objects, or one object."""
    if chart := answer.get("chart"):
        r = chart["result"][0]
        if "timestamp" in r:
            series = {k: v for group in r.get("indicators", {}).values() for block in group for k, v in block.items()}
            return [{"timestamp": t, **{k: v[i] for k, v in series.items()}} for i, t in enumerate(r["timestamp"])]
        return [{"kind": kind, **flatten(e)} for kind, events in (r.get("events") or {}).items() for e in events.values()]
    if news := answer.get("news"):
        return [flatten(x) for x in news]
    result = next(iter(answer.values()), {})
    result = (result.get("result") or [{}])[0] if isinstance(result, dict) else {}
    out = []
    for name, part in result.items():
        lists = [v for v in part.values() if isinstance(v, list) and v and isinstance(v[0], dict)] if isinstance(part, dict) else [part] if isinstance(part, list) and part and isinstance(part[0], dict) else []
        out += [{"module": name, **flatten(x)} for v in lists for x in v] if lists else [{"module": name, **flatten(part)}]
    return out


@dataclass
class Client:
    """Asks for tables of a symbol; several at once with bounded concurrency."""

    spark: SparkSession
    base: str = "https://query2.finance.yahoo.com"
    timeout: float = 15.0
    pause: float = 0.2
    retries: int = 2
    concurrency: int = 6
    transport: Callable[[str, float], dict] = fetch
    last: float = field(default=0.0, repr=False)

    def ask(self, path: str, **params) -> dict:
        url = f"{self.base}{path}" + (f"?{urlencode(params)}" if params else "")
        for attempt in range(self.retries + 1):
            time.sleep(max(0.0, self.last + self.pause - time.time()))
            self.last = time.time()
            try:
                return self.transport(url, self.timeout)
            except OSError:
                if attempt == self.retries:
                    raise
        raise AssertionError

    def rows(self, symbol: str, method: str, *args: str) -> list[dict]:
        if method not in METHODS:
            raise ValueError(f"{method!r} is not available")
        path, what = METHODS[method]
        params = {"modules": what} if path == SUMMARY else {"q": symbol} if path == SEARCH else {"range": args[0] if args else "1mo", "interval": args[1] if len(args) > 1 else "1d", **({"events": what} if what else {})} if path == HISTORY else {"date": args[0]} if args else {}
        return records(self.ask(path.format(symbol=quote(symbol)), **params))

    def table(self, symbol: str, method: str, *args: str) -> DataFrame:
        return read_json_data(self.spark, self.rows(symbol, method, *args))

    def tables(self, symbols: list[str], method: str, *args: str) -> DataFrame:
        """The same table of several symbols, with the symbol as a column."""
        with ThreadPoolExecutor(self.concurrency) as pool:
            found = list(pool.map(lambda s: [{"symbol": s, **r} for r in self.rows(s, method, *args)], symbols))
        return read_json_data(self.spark, [r for rows in found for r in rows])


@dataclass
class Reviews:
    """Search of places and pages of their reviews, from a service that answers by pages."""

    spark: SparkSession
    search_url: str
    reviews_url: str
    timeout: float = 15.0
    transport: Callable[[str, float], dict] = fetch

    def search(self, name: str) -> list[dict]:
        return [flatten(x) for x in self.transport(f"{self.search_url}?{urlencode({'q': name})}", self.timeout).get("places", [])]

    def reviews(self, place: str, pages: int = 1, sort: str = "newest") -> DataFrame:
        rows, token = [], ""
        for _ in range(pages):
            got = self.transport(f"{self.reviews_url}?{urlencode({'place': place, 'sort': sort, 'token': token})}", self.timeout)
            rows += [flatten(x) for x in got.get("reviews", [])]
            token = got.get("next", "")
            if not token:
                break
        return read_json_data(self.spark, rows)
