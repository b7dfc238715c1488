"""Every registered query and, where SQL can say it, its oracle."""

from paperlode.plans.registered import facts, files, keyword, loads, quality, reports, tables, text_search, vectors

_PARTS = [keyword, vectors, text_search, tables, quality, reports, loads, files, facts]

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
