"""Sources and sinks (SRC1-9, SNK1-4).

Readers are plain ``spark.read`` scans with explicit schemas; tolerant and
strict JSONL differ only in how malformed lines are treated.  Nothing is
read through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.rules import defaults as D
from sheaf.rules.dialect import java_pattern
from sheaf.sources import collection, quoted

# pandas' default NA tokens that matter for text columns
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

RECORD_SCHEMA = T.StructType([
    T.StructField("instruction", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
])
PREFERENCE_SCHEMA = "prompt string, chosen string, rejected string"
EVAL_SCHEMA = "q string, a string"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_entity_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """SRC1: entity CSV by header name, every column a nullable string, NA tokens -> null, columns renamed.

    Columns may come in any order; absent ones are null, others are ignored. Files are split among tasks, also where
    ``multi_line`` says that quoted fields hold line breaks (``sources.quoted``).
    """
    df = quoted.read_csv(spark, path) if multi_line else spark.read.csv(path, header=True, escape='"', inferSchema=False)
    have = set(df.columns)
    cols = []
    for header, name in D.ENTITY_COLUMNS:
        c = F.col(f"`{header}`") if header in have else F.lit(None).cast("string")
        cols.append(F.when(~c.isin(NA_TOKENS), c).alias(name))
    return df.select(*cols)


def _lines(spark: SparkSession, path: str, line_order: bool) -> DataFrame:
    """``value`` of every line; with ``line_order`` also ``_file``, ``_start``, ``_seq``, by which lines sort in file order."""
    text = spark.read.text(path)
    if not line_order:
        return text
    return text.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                       F.monotonically_increasing_id().alias("_seq"))


def _not_blank() -> Column:
    return F.col("value").rlike(java_pattern(r"\S"))


def _parsed(lines: DataFrame, schema: T.StructType, mode: str = "PERMISSIVE") -> DataFrame:
    full = T.StructType(list(schema.fields) + [T.StructField("_corrupt", T.StringType())])
    return lines.withColumn("j", F.from_json("value", full, {"mode": mode, "columnNameOfCorruptRecord": "_corrupt"}))


def _broken() -> Column:
    return F.col("j").isNull() | F.col("j._corrupt").isNotNull()


def _fields(parsed: DataFrame, schema: T.StructType) -> DataFrame:
    return parsed.select(*[F.col(f"j.{f.name}").alias(f.name) for f in schema.fields],
                         *[c for c in ("_file", "_start", "_seq") if c in parsed.columns])


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA,
                        line_order: bool = False) -> DataFrame:
    """SRC2: malformed or non-object lines are skipped; a missing path raises.

    JSON ``null`` is read as missing (the original would fail on it later).
    """
    if not _exists(spark, path):
        raise FileNotFoundError(f"Data file not found: {path}")
    return _fields(_parsed(_lines(spark, path, line_order), schema).where(~_broken() & _not_blank()), schema)


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA,
                      skip_blank: bool = True, line_order: bool = False) -> DataFrame:
    """SRC3 (blank lines skipped) / SRC4 (``skip_blank=False``: a blank line fails too).

    Blank means nothing but Unicode white space. The check is a filter, so a malformed line fails every action,
    ``count()`` included.
    """
    lines = _lines(spark, path, line_order)
    if skip_blank:
        lines = lines.where(_not_blank())
    wrong = F.raise_error(F.concat(F.lit("malformed line in strict JSONL: "), F.substring("value", 1, 200))).cast("boolean")
    return _fields(_parsed(lines, schema).where(F.when(_broken() | ~_not_blank(), wrong).otherwise(True)), schema)


def numbered_lines(spark: SparkSession, paths: Sequence[str], name: str = "line",
                   reader: Callable[..., DataFrame] = read_jsonl_tolerant) -> DataFrame:
    """SRC6 / WIN1: the records of several JSONL files, numbered from 0 in the order of files and lines.

    All but the first file are optional. A folder counts as its files in the order of their names. What ``reader``
    skips is not numbered. Two scans and no shuffle: the first counts the records of every file split, the second adds
    what lies before its split to a record's place in it. Only the counts, one row a split, are sorted and broadcast.
    """
    out = None
    for source, path in enumerate(paths):
        if source == 0 or _exists(spark, path):
            # made after the reader's filter, so the records of a split have ids without gaps
            part = reader(spark, path, line_order=True).select("*", F.monotonically_increasing_id().alias("_at"), F.lit(source).alias("_source")).drop("_seq")
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    split = ["_source", "_file", "_start"]
    sizes = out.groupBy(*split).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*split, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    placed = out.join(F.broadcast(offsets), split).withColumn(name, F.col("_offset") + F.col("_at"))
    return placed.drop("_file", "_start", "_at", "_offset")


def read_json_dataset(spark: SparkSession, path: str, schema=RECORD_SCHEMA) -> DataFrame:
    """SRC5: JSON lines with a declared schema."""
    return spark.read.schema(schema).json(path)


def union_optional(spark: SparkSession, primary: DataFrame, secondary_path: str,
                   reader: Callable[[SparkSession, str], DataFrame] = read_jsonl_tolerant) -> DataFrame:
    """SRC6 / SET3: append a second source only if it exists; its rows come after the first's.

    A ``_source`` column (0, 1) keeps the order for positional indexing.
    """
    out = primary.withColumn("_source", F.lit(0))
    if _exists(spark, secondary_path):
        out = out.unionByName(reader(spark, secondary_path).withColumn("_source", F.lit(1)),
                              allowMissingColumns=True)
    return out


def _complete(spark: SparkSession, path: str) -> bool:
    """A plain file, or a Spark output directory whose write finished (``_SUCCESS``)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return False
    return fs.isFile(p) or fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS"))


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], schema=PREFERENCE_SCHEMA,
                  writer: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """SRC7: reuse a materialised result when present, else build, write once and read back.

    Only a completed output is reused; a directory left by a failed build is
    rebuilt (overwritten), so a crash mid-write cannot be mistaken for a result.
    """
    if not _complete(spark, path):
        (writer or write_jsonl)(build(), path, mode="overwrite")
    return spark.read.schema(schema).json(path)


def read_eval_set(spark: SparkSession, path: str, schema: str = EVAL_SCHEMA) -> DataFrame:
    """SRC8: evaluation items stored as a JSON array, or as several files of one array each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def open_collection(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """SRC9: the rows of a persisted vector collection; a missing one raises with a hint."""
    return collection.open_version(spark, path, version)


def probe_queries(spark: SparkSession) -> DataFrame:
    """SRC11: the five fixed probe questions as a query table for VEC3."""
    return spark.createDataFrame([(i, q) for i, q in enumerate(D.PROBE_QUESTIONS)], "qid long, question string")


# --------------------------------------------------------------------------- sinks
def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK1-3: JSON lines, UTF-8 unescaped; null fields kept as ``null``."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def _as_array(batches):
    """Lines of one JSON array: a bracket or a comma before each row."""
    import pyarrow as pa

    first = True
    for batch in batches:
        rows = batch.column("value").to_pylist()
        yield pa.RecordBatch.from_pydict({"value": [("[" if first and not k else ",") + row for k, row in enumerate(rows)]})
        first = first and not rows
    yield pa.RecordBatch.from_pydict({"value": ["[]" if first else "]"]})


def write_json_arrays(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The file form of SRC8: each file one JSON array of the rows of a partition, written row by row."""
    lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.mapInArrow(_as_array, "value string").write.mode(mode).text(path)


def write_collection(docs: DataFrame, path: str, mode: str = "replace", id_col: str | None = None) -> int:
    """SNK4: text + vector + metadata into a versioned collection; see ``collection.save`` for ``mode``."""
    return collection.save(docs, path, mode, id_col)
