"""Registry of runnable queries and of the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ratewell.operators.ordered import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_STORED: dict[tuple[str, str, str], tuple] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its check SQL if SQL can express it."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A run table: written to the shared folder on first use in a session, read from there afterwards.

    A rating run writes its metric table and ratings once and serves every report from them.  Tables that change
    under the same folder are a new input: the names, sizes and times of its files belong to the key.
    """
    return kept(spark, folder, name, lambda: written(build(), name))


def stored_or(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The run table if the session has stored it; else its rows unwritten, for a query that reads them once."""
    found = _STORED.get((spark.sparkContext.applicationId, folder, name))
    return found[1] if found and found[0] == _input_state(spark, folder) else build()


def kept(spark: SparkSession, folder: str, name: str, make: Callable[[], object]):
    """What ``make`` gives, made once for the present files of a folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    state = _input_state(spark, folder)
    if key not in _STORED or _STORED[key][0] != state:
        _STORED[key] = state, make()
    return _STORED[key][1]


def _input_state(spark: SparkSession, folder: str) -> tuple:
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    files = []
    while found.hasNext():
        status = found.next()
        files.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(files))
