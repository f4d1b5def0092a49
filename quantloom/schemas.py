"""Explicit schemas of the sources; nothing is inferred."""

from __future__ import annotations

OHLCV = "date string, open double, high double, low double, close double, volume long, symbol string"
FUND_NAV = "date string, price double, symbol string"
GOLD = "date string, pnj_buy double, pnj_sell double, sjc_buy double, sjc_sell double"
OBSERVATION = (
    "asset_id string, kind string, observation_date date, price decimal(24,6), source_unit string, provider string, "
    "published_at timestamp, price_type string, data_origin string, price_basis string"
)
ENVELOPE = "event_id string, schema_version int, type string, producer string, correlation_id string, occurred_at timestamp, payload string"
