"""Every registered query, and the SQL that must give the same rows."""

from __future__ import annotations

from . import forecasts, models, oracles, priors, quality, series

PARTS = (series, quality, priors, forecasts, models)
QUERIES = {name: f for part in PARTS for name, f in part.Q.items()}
#: SQL written apart from the operators comes before a template that both engines can run.
ORACLES = {name: text for part in (*PARTS, oracles) for name, text in part.O.items() if text and "(select null)" not in text}
