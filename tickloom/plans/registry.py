"""All registered queries with their SQL counterparts: importing this loads every plan."""

from __future__ import annotations

from tickloom.plans import announcements, bulk, calendar, dashboard, evidence, extended, extras, feeds, filings, gates, headlines, intraday, market, news, placements, portfolio, quant, releases, scalars, screener, snapshots, store  # noqa: F401
from tickloom.plans.register import ORACLES, QUERIES, query  # noqa: F401

FLAGSHIP = "market_concentration"
