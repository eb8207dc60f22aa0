"""SRC1: CSV records with line breaks in quotes, read by many tasks.

Whether a line break ends a record depends on every quote before it, so a plain reader gives such a file to one task. Here
lines are read split by split, and a record starts at a line before which the number of quotes is even:

1. a first scan gives each split the parity of its quotes, and how many records start in it for either parity before it;
2. running sums over the splits of a file (one small row each) say in which state a split begins and how many
   records began before it;
3. a second scan numbers the records. A record on one line is ready; only the lines of longer ones are shuffled, to
   their record.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Quotes in quotes are doubled; a field may be of any length.
CSV = {"escape": '"', "maxCharsPerColumn": "-1"}
SPLITS = "file string, start long, odd boolean, if_even long, if_odd long"
LINES = "file string, start long, place long, record long, whole boolean, value string"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, start, first row, row after the last) of the splits in a batch."""
    files, starts = batch.column("file"), batch.column("start").to_numpy()
    codes = files.dictionary_encode().indices.to_numpy()
    cut = np.flatnonzero((np.diff(starts) != 0) | (np.diff(codes) != 0)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(starts)]):
        yield files[a].as_py(), int(starts[a]), a, b


def _quotes(values: pa.Array, quote: str) -> np.ndarray:
    return pc.count_substring(values, quote).to_numpy(zero_copy_only=False).astype(np.int64)


def _summed(quote: str):
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("odd", pa.bool_()), ("if_even", pa.int64()), ("if_odd", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, odd, starts = None, 0, [0, 0]

        def row():
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([*key, bool(odd), *starts], schema)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            n = _quotes(batch.column("value"), quote)
            for file, start, a, b in _runs(batch):
                if (file, start) != key:
                    if key:
                        yield row()
                    key, odd, starts = (file, start), 0, [0, 0]
                before = (odd + np.cumsum(n[a:b]) - n[a:b]) % 2  # quotes of the split before each line
                inside = int(before.sum())
                starts = [starts[0] + (b - a) - inside, starts[1] + inside]
                odd = int((odd + n[a:b].sum()) % 2)
        if key:
            yield row()

    return run


def _numbered(quote: str):
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("record", pa.int64()), ("whole", pa.bool_()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, odd, record, place = None, 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n, opened, begun = _quotes(batch.column("value"), quote), batch.column("opened").to_pylist(), batch.column("begun").to_pylist()
            records, wholes, places = np.empty(len(n), np.int64), np.empty(len(n), bool), np.empty(len(n), np.int64)
            for file, start, a, b in _runs(batch):
                if (file, start) != key:
                    key, odd, record, place = (file, start), int(opened[a]), begun[a] - 1, 0
                first = (odd + np.cumsum(n[a:b]) - n[a:b]) % 2 == 0
                records[a:b] = record + np.cumsum(first)
                wholes[a:b] = first & (n[a:b] % 2 == 0)
                places[a:b] = place + np.arange(b - a)
                odd, record, place = int((odd + n[a:b].sum()) % 2), int(records[b - 1]), place + b - a
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("start"), pa.array(places), pa.array(records), pa.array(wholes), batch.column("value")], schema=schema)

    return run


def read_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(``file``, ``record``, ``value``): every record of the files at ``path``, numbered from 0 in each file.

    A record may span lines and splits. Quotes in quotes are doubled, as the CSV rules have it, so they do not change the
    parity. Lines end in a line feed, with or without a carriage return. A file whose quotes do not close raises an error.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    splits = lines.mapInArrow(_summed(quote), SPLITS)
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.col("odd").cast("int")
    splits = splits.withColumn("opened", F.coalesce(F.sum(odd).over(earlier), F.lit(0)) % 2 == 1)
    begin = F.when(F.col("opened"), F.col("if_odd")).otherwise(F.col("if_even"))
    broken = F.sum(odd).over(Window.partitionBy("file")) % 2 == 1
    fail = F.raise_error(F.concat(F.lit("a quote does not close in "), F.col("file"))).cast("long")
    splits = splits.select("file", "start", "opened", F.when(broken, fail).otherwise(F.coalesce(F.sum(begin).over(earlier), F.lit(0))).alias("begun"))
    # one row a split of the files
    numbered = lines.join(F.broadcast(splits), ["file", "start"]).select("value", "file", "start", "opened", "begun").mapInArrow(_numbered(quote), LINES)
    ready = numbered.where("whole").select("file", "record", "value")
    longer = numbered.where("NOT whole").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "place", "value"))).alias("lines"))
    longer = longer.select("file", "record", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("value"))
    return ready.unionByName(longer).withColumn("value", F.regexp_replace("value", "\r$", ""))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header each, all columns strings, quoted line breaks kept; many tasks a file.

    Column names are those of the first file's header, in its order. Blank lines are skipped, short rows end in nulls.
    """
    records = read_records(spark, path)
    head = records.where("record = 0").orderBy("file").limit(1).collect()
    if not head:
        return spark.createDataFrame([], "value string").drop("value")
    columns = next(csv.reader(head[0]["value"].splitlines(keepends=True)))
    schema = ", ".join(f"c{k} string" for k in range(len(columns)))
    row = F.from_csv("value", schema, CSV)
    return records.where("record > 0 AND value <> ''").select(row.alias("r")).select(*(F.col(f"r.c{k}").alias(c) for k, c in enumerate(columns)))
