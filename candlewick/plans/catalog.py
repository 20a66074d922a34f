"""All queries of the bars, rules and dimensions."""

from __future__ import annotations

from candlewick.plans import market, reference_data, service, strategy, streams

QUERIES: dict = market.QUERIES | strategy.QUERIES | reference_data.QUERIES | service.QUERIES | streams.QUERIES
ORACLES: dict[str, str] = market.ORACLES | strategy.ORACLES | reference_data.ORACLES | service.ORACLES | streams.ORACLES
