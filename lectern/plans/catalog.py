"""Registered queries of the library and the SQL that states the same results."""

from __future__ import annotations

from lectern.plans import history, ranking, records, retrieval, scoring, texts

QUERIES: dict = {**texts.QUERIES, **history.QUERIES, **ranking.QUERIES, **retrieval.QUERIES, **records.QUERIES, **scoring.QUERIES}
ORACLES: dict = {**texts.ORACLES, **history.ORACLES, **ranking.ORACLES, **retrieval.ORACLES, **records.ORACLES, **scoring.ORACLES}
