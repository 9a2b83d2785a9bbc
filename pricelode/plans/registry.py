"""All queries of the library and the SQL that each must equal."""

from . import basic, files, ingest, market, scores
from .catalog import ORACLES, QUERIES

_LOADED = (basic, files, ingest, market, scores)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
