"""All queries of the as-of engine and their SQL."""

from __future__ import annotations

from . import availability, design, ensembles, features, ingest, ledger, markets, parsing, registry, simulations, strategy, volatility

flagship = features.flagship
_MODULES = (availability, design, ensembles, features, ingest, ledger, markets, parsing, simulations, strategy, volatility)  # entering their queries


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
