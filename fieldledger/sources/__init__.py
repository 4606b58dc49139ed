"""Readers and writers with explicit schemas."""

from fieldledger.sources.csv import (
    read_county_production,
    read_csv,
    read_market_prices,
    read_promoted_header,
    read_quote_prices,
    read_trailing_header,
    write_csv,
)
from fieldledger.sources.tables import literal_table, read_table, tag_source, union_sources

__all__ = [
    "literal_table",
    "read_county_production",
    "read_csv",
    "read_market_prices",
    "read_promoted_header",
    "read_quote_prices",
    "read_table",
    "read_trailing_header",
    "tag_source",
    "union_sources",
    "write_csv",
]
