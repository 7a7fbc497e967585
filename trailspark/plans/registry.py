"""All registered queries outside the optional subpackage."""

from __future__ import annotations

from trailspark.plans import collections, files, network, places, relational, roads, streams, tracks

_PLANS = (places, tracks, streams, roads, network, files, collections, relational)

QUERIES: dict = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
