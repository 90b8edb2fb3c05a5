"""Upserts, deletes and lookups of stored tables. Plain Parquet has no MERGE: a table that is merged into lies in
buckets by key, a merge rewrites the buckets it touches beside the old ones, and a manifest says which hold."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions.ids import document_id, uuid5


def last_of_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def last_rows(rows: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """One row for each key, null keys being equal: the last by ``order``, ties and no order by the other columns."""
    if not [c for c in rows.columns if c not in keys]:
        return rows.distinct()
    plain = [F.col(c) for c in rows.columns if c not in keys and "map<" not in rows.schema[c].dataType.simpleString()]
    return last_of_key(rows, keys, F.struct(*([order.alias("order")] if order is not None else []), *plain, F.lit(0).alias("least"))).select(*rows.columns)


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """The last rows of ``new`` replace those of ``old`` with the same keys; null keys are equal."""
    last = last_rows(new, keys, order)
    if old is None:
        return last
    replaced = new.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).distinct()
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & old[k].eqNullSafe(replaced[f"_{i}"])
    return old.join(replaced, same, "left_anti").unionByName(last, allowMissingColumns=True)


def delete_documents(rows: DataFrame, ids: DataFrame, key: str = "document_id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def path_candidates(names: DataFrame, folders: list[str]) -> DataFrame:
    """``name, priority, path`` of the folders in which a file may lie."""
    return names.select("name", F.posexplode(F.array(*[F.concat(F.lit(f), F.col("name")) for f in folders])).alias("priority", "path"))


def resolve_documents(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """``path, document_id, priority``: by the path in the metadata, else by the hash of the path as document_id."""
    stored = chunks.select(F.col("metadata")["file_path"].alias("path"), "document_id").where("path is not null").distinct()
    by_path = wanted.join(stored, "path").select("path", "document_id", F.lit(1).alias("priority"))
    known = chunks.select("document_id").distinct()
    by_hash = wanted.withColumn("document_id", document_id("path")).join(known, "document_id", "left_semi").select("path", "document_id", F.lit(2).alias("priority"))
    computed = wanted.select("path", document_id("path").alias("document_id"), F.lit(3).alias("priority"))
    every = by_path.union(by_hash).union(computed)
    return every.groupBy("path").agg(F.min(F.struct("priority", "document_id")).alias("m")).select("path", "m.document_id", "m.priority")


def document_uuid(document: Column | str) -> Column:
    return uuid5(document)


def safe_metadata(metadata: Column | str, allowed: list[str]) -> Column:
    """Allowed keys with values."""
    return F.map_filter(metadata, lambda k, v: k.isin(*allowed) & v.isNotNull())


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without output, to resume a run."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the manifest that holds; number 0 if there is no table."""
    fs, at = _files(spark, path)
    folder = at(f"{path}/manifests")
    numbers = [int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json")] if fs.exists(folder) else []
    if not numbers:
        return 0, {}
    stream = fs.open(at(f"{path}/manifests/{max(numbers):09d}.json"))
    try:
        return max(numbers), json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``write_upsert`` keeps at ``path``."""
    number, held = _manifest(spark, path)
    if not number:
        raise FileNotFoundError(path)
    rows = spark.read.schema(held["schema"])
    return rows.parquet(*[f"{path}/{f}" for f in sorted(held["buckets"].values())]) if held["buckets"] else spark.createDataFrame([], held["schema"])


def write_upsert(new: DataFrame, path: str, keys: list[str], order: Column | None = None, buckets: int = 64) -> None:
    """Merge into the table at ``path``. Rows lie in ``buckets`` by the hash of their keys; only buckets that ``new`` has
    keys of are read and written, beside the old ones. A manifest written last puts them in force, so that readers see
    the table before or after, and a failed write leaves it as it was. Buckets of the manifest before last are deleted."""
    spark = new.sparkSession
    fs, at = _files(spark, path)
    number, held = _manifest(spark, path)
    buckets = held.get("count", buckets)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    touched = [r["b"] for r in new.select(bucket.alias("b")).distinct().collect()]
    now = dict(held.get("buckets", {}))
    old_paths = [f"{path}/{now[str(b)]}" for b in touched if str(b) in now]
    old = spark.read.schema(held["schema"]).parquet(*old_paths) if old_paths else None
    merged = upsert(old, new, keys, order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merged.schema)
    folder = f"data/{uuid.uuid4().hex}"
    merged.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    now.update({str(b): f"{folder}/_bucket={b}" for b in touched})
    fs.mkdirs(at(f"{path}/manifests"))
    beside = at(f"{path}/manifests/{number + 1:09d}.new")
    stream = fs.create(beside, True)
    stream.write(bytearray(json.dumps({"count": buckets, "schema": schema, "buckets": now, "before": held.get("buckets", {})}).encode()))
    stream.close()
    fs.rename(beside, at(f"{path}/manifests/{number + 1:09d}.json"))
    for gone in set(held.get("before", {}).values()) - set(held.get("buckets", {}).values()) - set(now.values()):
        fs.delete(at(f"{path}/{gone}"), True)
    fs.delete(at(f"{path}/manifests/{number - 1:09d}.json"), False)


def ensure_table(spark: SparkSession, name: str, schema: str, recreate: bool = False) -> None:
    if recreate:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def drop_tables(spark: SparkSession, names: list[str]) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
