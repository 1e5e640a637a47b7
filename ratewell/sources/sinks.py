"""Result writers. Each writes one dataset directory, in parallel; a file per entity only where that is asked for."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.operators.schema import quoted


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, order: Sequence[str] = ()) -> None:
    """CSV with a header (also when there are no rows), columns in the given order, optionally sorted."""
    out = df.select(*[quoted(c) for c in (columns or df.columns)])
    if order:
        out = out.orderBy(*[quoted(c) for c in order])
    out.write.mode("overwrite").option("header", True).csv(path)


def write_documents(docs: DataFrame, path: str, run_date: str) -> None:
    """Nested rating documents of one run as JSON lines under run_date=<date>."""
    docs.select("document.*").write.mode("overwrite").json(f"{path}/run_date={run_date}")


def write_entity_documents(docs: DataFrame, path: str, name: str, text: str) -> int:
    """One file per row, named by column ``name``, with the row's ``text`` and a line end; gives the number of files.

    The tasks write the files themselves, into 256 folders by a checksum of the name, so there is no folder per entity
    and nothing is left to move for the driver.  A file appears under its name when it is complete; names are unique.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(path)
        made, files = set(), 0
        for batch in batches:
            for own, body in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                at = f"{folder}/{zlib.crc32(own.encode()) % 256:02x}"
                if at not in made:
                    system.create_dir(at, recursive=True)
                    made.add(at)
                temporary = f"{at}/.{own}.{uuid.uuid4().hex}"
                with system.open_output_stream(temporary) as out:
                    out.write(f"{body or ''}\n".encode())
                system.move(temporary, f"{at}/{own}")
                files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    rows = docs.select(F.col(name).alias("name"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "files long").agg(F.sum("files")).first()[0] or 0


def append_history(rows: DataFrame, path: str, run_date: str | None = None) -> None:
    """Add runs to a history partitioned by run date; a run that is written again takes the place of its first writing.

    Without ``run_date`` the rows bring their own ``run_date``, and all their runs are written at once.
    """
    if run_date is not None:
        rows = rows.withColumn("run_date", F.lit(run_date).cast("date"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)


def recommendation_history(ratings: DataFrame) -> DataFrame:
    return ratings.select("ticker", "recommendation", "confidence", "selection_score", "opportunity_score", "close_price")
