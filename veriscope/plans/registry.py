"""Every registered query with its checking SQL, by name."""

from __future__ import annotations

from veriscope.plans import accuracy, failures, learned, measures, selections

AREAS = (failures, accuracy, measures, selections, learned)

QUERIES = {name: query for area in AREAS for name, query in area.QUERIES.items()}
ORACLE = {name: text for area in AREAS for name, text in area.ORACLE.items()}
