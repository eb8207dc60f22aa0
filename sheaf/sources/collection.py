"""SNK4 / SRC9: a versioned collection of rows on shared storage, with append, upsert, replace and compaction.

A collection is a folder:

* ``deltas/<name>/rows``: Parquet, one folder per bucket of the id hash; ``deltas/<name>/gone``: ids whose rows in earlier
  deltas no longer count;
* ``manifests/<version>.json``: the deltas of a version, in order. A version exists once its manifest does.

A change writes its delta first and then moves a finished manifest to the next number, which fails if that number is
taken. So readers see a whole version or the one before, a failed or lost job leaves only files that no manifest names, and
of two writers at once one gets ``ConcurrentChange`` and can try again.

The id of a row is given (``id_col``) or the SHA-256 of its content: then a second build from the same input adds nothing.
Reading is a plain scan of the deltas; only where ids were replaced or deleted are rows matched with those (narrow) ids.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sheaf.session import stored

ID, BUCKET, SEQUENCE = "id", "_bucket", "_sequence"


class ConcurrentChange(RuntimeError):
    """Another writer has published the version that this change was to become."""


def content_id(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's content: each column's text with its length in front, null apart from the empty text."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat_ws("|", *parts), 256)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, ascending."""
    folder, fs = _fs(spark, f"{path}/manifests")
    if not fs.exists(folder):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version (default: the latest)."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"Vector collection not found at {path}; build it first (write_collection)" if not known else f"{path} has no version {version}")
    name = f"{path}/manifests/{(known[-1] if version is None else version):012d}.json"
    return json.loads(spark.read.text(name, wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, content: dict) -> int:
    """Move the finished manifest to its number; the number must be free."""
    jvm = spark.sparkContext._jvm
    made, fs = _fs(spark, f"{path}/manifests/_{uuid.uuid4().hex}")
    out = fs.create(made, False)
    out.write(json.dumps(content).encode())
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{content['version']:012d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(made, target, options)
    except Exception as e:
        fs.delete(made, False)
        if fs.exists(target):
            raise ConcurrentChange(f"version {content['version']} of {path} was published by another writer") from e
        raise
    return content["version"]


def _rows(spark: SparkSession, path: str, content: dict, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of a version with ``_bucket`` and ``_sequence``; ``columns`` to read (default: all)."""
    out = None
    for k, delta in enumerate(content["deltas"]):
        if delta["rows"]:
            df = spark.read.schema(content["schema"]).parquet(f"{path}/deltas/{delta['name']}/rows")
            df = df.select(*(columns or df.columns), *([BUCKET] if columns else [])).withColumn(SEQUENCE, F.lit(k))
            out = df if out is None else out.unionByName(df)
    if out is None:
        empty = spark.createDataFrame([], content["schema"])
        return empty.select(*(columns or empty.columns), *([BUCKET] if columns else [])).withColumn(SEQUENCE, F.lit(0))
    gone = [spark.read.parquet(f"{path}/deltas/{d['name']}/gone").select(ID, F.lit(k).alias("_from")) for k, d in enumerate(content["deltas"]) if d["gone"]]
    if gone:
        dead = gone[0]
        for more in gone[1:]:
            dead = dead.unionByName(more)
        dead = dead.groupBy(F.col(ID).alias("_gone")).agg(F.max("_from").alias("_from"))
        out = out.join(dead, (F.col(ID) == F.col("_gone")) & (F.col(SEQUENCE) < F.col("_from")), "left_anti")
    return out


def open_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version (default: the latest), with their ``id``."""
    return _rows(spark, path, manifest(spark, path, version)).drop("_content", BUCKET, SEQUENCE)


def lookup(spark: SparkSession, path: str, ids: Sequence[str], version: int | None = None) -> DataFrame:
    """The rows of a few ids; only their buckets are read."""
    content = manifest(spark, path, version)
    keys = spark.createDataFrame([(i,) for i in ids], f"{ID} string").select(ID, _bucket(content["buckets"]).alias("b"))
    return _rows(spark, path, content).where(F.col(BUCKET).isin([r["b"] for r in keys.distinct().collect()]) & F.col(ID).isin(list(ids))).drop("_content", BUCKET, SEQUENCE)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(ID), F.lit(buckets)).cast("int")


def _write_delta(rows: DataFrame | None, gone: DataFrame | None, path: str) -> dict:
    """Write one delta; its name and counts for the manifest."""
    name, counts = uuid.uuid4().hex, {"rows": 0, "gone": 0}
    for part, df in (("rows", rows), ("gone", gone)):
        if df is None:
            continue
        seen = Observation()
        df = df.observe(seen, F.count(F.lit(1)).alias("n"))
        writer = df.write.mode("error")
        (writer.partitionBy(BUCKET) if part == "rows" else writer).parquet(f"{path}/deltas/{name}/{part}")
        counts[part] = seen.get["n"]
    return {"name": name, **counts}


def save(df: DataFrame, path: str, mode: str = "append", id_col: str | None = None, buckets: int = 16) -> int:
    """Write ``df`` into the collection at ``path``; returns the new version.

    ``append`` adds rows whose id is not there yet, ``upsert`` also replaces the rows of ids that are there with other
    content, ``replace`` makes ``df`` the whole collection (earlier versions stay readable). Without
    ``id_col`` a row's id is the SHA-256 of its content, so ``append`` and ``upsert`` are the same. Of rows in ``df`` that share an id, the one
    of the smallest content hash is kept. Ids are text; rows with a null id are refused. A change that adds nothing still
    makes a version. ``buckets`` counts for a new collection only; the columns of an existing one are fixed.
    """
    if mode not in ("append", "upsert", "replace"):
        raise ValueError(f"unknown mode {mode!r}")
    spark, known = df.sparkSession, versions(df.sparkSession, path)
    before = manifest(spark, path) if known else {"version": 0, "buckets": buckets, "deltas": []}
    kept = [c for c in df.columns if c != id_col]
    if ID in kept:
        raise ValueError(f"a column {ID!r} must be given as id_col")
    digest = content_id(kept)
    ident = F.col(id_col).cast("string") if id_col else digest
    ident = F.when(ident.isNotNull(), ident).otherwise(F.raise_error(F.lit("a row without id")).cast("string"))
    rows = df.select(ident.alias(ID), digest.alias("_content"), *kept)
    # rows of one id: the first by content; equal rows need no order
    rows = rows.groupBy(ID).agg(F.min_by(F.struct("_content", *kept), "_content").alias("r")).select(ID, "r.*")
    rows = rows.withColumn(BUCKET, _bucket(before["buckets"]))
    schema = _ddl(rows)
    if known and mode != "replace" and before["schema"] != schema:
        raise ValueError(f"the collection has the columns {before['schema']}, not {schema}")
    gone = None
    if mode != "replace" and any(d["rows"] for d in before["deltas"]):
        there = _rows(spark, path, before, [ID, "_content"]).select(F.col(ID).alias("_there"), F.col("_content").alias("_old"))
        met = rows.join(there, F.col(ID) == F.col("_there"), "left")
        change = F.col("_there").isNull() | (F.col("_content") != F.col("_old")) if mode == "upsert" and id_col else F.col("_there").isNull()
        rows = stored(met.where(change), "collection-change")  # the delta and the ids it replaces are both read from them
        if mode == "upsert" and id_col:
            gone = rows.where("_there IS NOT NULL").select(ID)
        rows = rows.drop("_there", "_old")
    delta = _write_delta(rows, gone, path)
    deltas = [*([] if mode == "replace" else before["deltas"]), delta]
    return _publish(spark, path, {"version": before["version"] + 1, "buckets": before["buckets"], "schema": schema, "deltas": deltas})


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def delete(spark: SparkSession, path: str, ids: DataFrame, id_col: str = ID) -> int:
    """A version without the rows of ``ids``; unknown ids change nothing."""
    before = manifest(spark, path)
    gone = ids.select(F.col(id_col).cast("string").alias(ID)).where(F.col(ID).isNotNull()).distinct()
    delta = _write_delta(None, gone, path)
    return _publish(spark, path, before | {"version": before["version"] + 1, "deltas": [*before["deltas"], delta]})


def compact(spark: SparkSession, path: str) -> int:
    """A version of one delta with the same rows, so that readers match no ids and open few files."""
    before = manifest(spark, path)
    rows = _rows(spark, path, before).drop(SEQUENCE).repartition(BUCKET)
    delta = _write_delta(rows, None, path)
    return _publish(spark, path, before | {"version": before["version"] + 1, "deltas": [delta]})


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete all but the latest ``keep`` versions and the deltas that only they name; returns the names of those deltas.

    Not while another writer is at work: a delta that is being written is named by no manifest yet.
    """
    known = versions(spark, path)
    stay = {d["name"] for v in known[-keep:] for d in manifest(spark, path, v)["deltas"]}
    for v in known[:-keep]:
        p, fs = _fs(spark, f"{path}/manifests/{v:012d}.json")
        fs.delete(p, False)
    folder, fs = _fs(spark, f"{path}/deltas")
    dead = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName() not in stay)
    for name in dead:
        fs.delete(_fs(spark, f"{path}/deltas/{name}")[0], True)
    return dead
