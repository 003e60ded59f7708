"""Row-bounded commits of micro-batches, each whole or not there, that survive a kill between them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import global_position
from ..sources.listing import file_system, write_whole

Write = Callable[[pd.DataFrame], None]


def row_commits(path: str, order: list[Column], write: Write | None = None, rows: int = 500) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that commits a micro-batch in sub-batches of at most ``rows`` rows.

    Rows are placed by ``order`` (a total one). A sub-batch is given to ``write`` (a sink's own insert,
    on the executor), which raises if it refuses; then its rows are tried one by one, and those that
    fail are set aside with the error while the others land. What landed becomes one file
    ``batch=<n>/part=<k>.parquet`` under ``path``, the refused rows one under ``path/_aside``; the file that appears last,
    under ``path/_ledger``, makes the sub-batch count. A batch that is run again after a kill passes over the
    sub-batches in the ledger and writes the others again in place, so ``write`` must bear a sub-batch
    that it has seen (an insert by key does). Sub-batches are dealt over tasks.
    """

    def commit(batch: DataFrame, number: int) -> None:
        placed = global_position(batch, order, "__place").withColumn("__part", F.floor((F.col("__place") - 1) / rows))
        names = batch.columns

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for pdf in frames:
                for part, g in pdf.groupby("__part", sort=True):
                    if held and held[0]["__part"].iloc[0] != part:
                        yield _sub_batch(path, number, pd.concat(held), names, write)
                        held = []
                    held.append(g)
            if held:
                yield _sub_batch(path, number, pd.concat(held), names, write)

        dealt = placed.repartition("__part").sortWithinPartitions("__part", "__place")
        done = dealt.mapInPandas(run, "part long, landed long, refused long, repeated boolean")
        totals = done.agg(F.sum("landed"), F.sum("refused"), F.count_if("repeated"), F.count("*")).first()
        write_whole(f"{path}/_ledger/batch={number}/_done", json.dumps(dict(zip(("landed", "refused", "repeated", "parts"), totals, strict=True))).encode())

    return commit


def _sub_batch(path: str, number: int, pdf: pd.DataFrame, names: list[str], write: Write | None) -> pd.DataFrame:
    part = int(pdf["__part"].iloc[0])
    ledger = f"{path}/_ledger/batch={number}/part={part}"
    fs, at = file_system(ledger)
    if fs.get_file_info(at).type != pafs.FileType.NotFound:
        with fs.open_input_stream(at) as f:
            landed, refused = json.loads(f.read())
        return pd.DataFrame({"part": [part], "landed": [landed], "refused": [refused], "repeated": [True]})
    rows = pdf[names].reset_index(drop=True)
    errors: list[str | None] = [None] * len(rows)
    if write is not None:
        try:
            write(rows)
        except Exception:
            for i in range(len(rows)):
                try:
                    write(rows.iloc[i : i + 1])
                except Exception as e:
                    errors[i] = f"{type(e).__name__}: {e}"[:300]
    bad = pd.Series([e is not None for e in errors], dtype=bool)
    for folder, chosen in ((path, rows[~bad]), (f"{path}/_aside", rows[bad].assign(error=[e for e in errors if e is not None]))):
        if len(chosen):
            sink = pa.BufferOutputStream()
            pq.write_table(pa.Table.from_pandas(chosen, preserve_index=False), sink, coerce_timestamps="us")
            write_whole(f"{folder}/batch={number}/part={part}.parquet", sink.getvalue().to_pybytes())
    write_whole(ledger, json.dumps([int((~bad).sum()), int(bad.sum())]).encode())
    return pd.DataFrame({"part": [part], "landed": [int((~bad).sum())], "refused": [int(bad.sum())], "repeated": [False]})


def landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that landed, with ``batch``."""
    return spark.read.schema(f"{schema}, batch int").option("basePath", path).option("pathGlobFilter", "*.parquet").parquet(path)


def set_aside(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that the sink refused, with ``error`` and ``batch``; none where it refused none."""
    fs, at = file_system(path)
    wide = f"{schema}, error string, batch int"
    if fs.get_file_info(f"{at}/_aside").type == pafs.FileType.NotFound:
        return spark.createDataFrame([], wide)
    return spark.read.schema(wide).option("basePath", f"{path}/_aside").parquet(f"{path}/_aside")
