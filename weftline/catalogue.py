"""All registered queries of the library's own operators, with their SQL."""

from .plans import code, crossed, curation, evaluation, geometry, pools, reports, rows, shards

AREAS = (code, crossed, curation, evaluation, geometry, pools, reports, rows, shards)
QUERIES = {name: query for area in AREAS for name, query in area.QUERIES.items()}
ORACLES = {name: sql for area in AREAS for name, sql in area.ORACLES.items()}
