"""Queries over the given tables, each with the SQL that must give the same rows.

``roles`` reads the tables in the roles of weather, plants and organs; the other modules register
one query per operator. Importing the package fills ``QUERIES``.
"""

from workload import checks, joins, rollups, rules, scenarios, series, weather
from workload.registry import QUERIES

__all__ = ["QUERIES", "checks", "joins", "rollups", "rules", "scenarios", "series", "weather"]
