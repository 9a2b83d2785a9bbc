"""A register of queries: a function of the fixtures, and the SQL it must equal."""

from pyspark.sql import functions as F

QUERIES, ORACLES = {}, {}


def query(name, sql=None, hold=False):
    """Register a function of Fixtures under a name, with DuckDB SQL over the fixture views where SQL can express it.

    With hold, tables that the query uses several times are derived once and written to the shared folder.
    """

    def keep(function):
        from .fixtures import Fixtures, with_fixtures

        def run(spark, sf_dir):
            out = function(Fixtures(spark, sf_dir, hold))
            # Decimals are given as doubles, as the SQL has them.
            return out.withColumns({c: F.col(c).cast("double") for c, kind in out.dtypes if kind.startswith("decimal")})

        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_fixtures(sql)
        return function

    return keep
