"""Helpers shared by the training-data operators: scratch tables and document keys."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}
#: Scratch tables and kept results of this process that release() has not yet dropped.
_WRITTEN: list[str] = []
_HELD: list[DataFrame] = []

#: Key columns of a document row inside an operator. Whole input rows are held as one struct, so their names can't clash.
DID, THASH = "__did", "__thash"


def scratch_base(spark: SparkSession) -> str:
    """Folder for cut lineage: the shared folder of the cluster, or an own one in local mode.

    On a cluster that names no shared folder this raises, because a folder on one machine
    would lose rows with its executor.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="wattloom-scratch-")
    return _OWN[app]


#: Rows of a batch that goes to Python: texts may be long, and a batch is held whole on both sides.
BATCH_ROWS = 1024
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Settings that let Catalyst filter the large side of a join by a bounded Bloom filter of the small one.
BLOOM = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1TB"}


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after lowering its session's rows per Arrow batch to BATCH_ROWS. Called wherever texts go to Python."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_KEY, "10000")) <= BATCH_ROWS:
        conf.set(_BATCH_KEY, str(BATCH_ROWS))
    return df


def written(df: DataFrame, name: str, *used: DataFrame, conf: dict[str, str] | None = None) -> DataFrame:
    """Write df as Parquet into the scratch folder and read it back: lineage ends here.

    used: scratch tables that only df needed. They are deleted. conf: settings for this write alone.
    The driver's garbage is collected after each write: plans and task metrics of many partitions would else fill its heap, and
    Spark keeps shuffle files and broadcasts until then.
    """
    spark = df.sparkSession
    path = f"{scratch_base(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        df.write.parquet(path)
        _WRITTEN.append(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for one in used:
        _delete(spark, one)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """df, computed once and kept on the executors' disks for its other uses.

    Its lineage stays, so what a lost executor held is computed again. Unlike written() it makes no files in the
    shared folder; release with unpersist().
    """
    kept = df.persist(StorageLevel.DISK_ONLY)
    _HELD.append(kept)
    return kept


def release(spark: SparkSession, *keep: DataFrame) -> None:
    """Drop all scratch tables and kept results so far, but for the tables that keep reads. For use when their results are written."""
    while _HELD:
        _HELD.pop().unpersist()
    jvm = spark.sparkContext._jvm
    path_of = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    kept = {path_of(f).getParent().toUri().getPath() for one in keep for f in one.inputFiles()}
    for one in [x for x in _WRITTEN if path_of(x).toUri().getPath() not in kept]:
        path_of(one).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path_of(one), True)
        _WRITTEN.remove(one)


def _delete(spark: SparkSession, table: DataFrame) -> None:
    """Remove the folder of a scratch table; a path outside the scratch folder is refused."""
    base = scratch_base(spark)
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().toUri().getPath() != jvm.org.apache.hadoop.fs.Path(base).toUri().getPath():
            raise ValueError(f"{folder} is no scratch table")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str):
    """The column of that very name, which may hold dots and back ticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **columns: str) -> DataFrame:
    """doc_id, text (null: empty), a null-free row key, and further columns of docs under the given names.

    Only the named columns are read, so extra columns with clashing names never get in the way.
    Rows that repeat both id and text share a key; every operator gives them the same result.
    """
    body = F.coalesce(quoted(text).cast("string"), F.lit(""))
    ident = quoted(doc_id).cast("long")
    return docs.select(
        ident.alias("doc_id"),
        body.alias("text"),
        F.coalesce(ident, F.lit(-1).cast("long")).alias(DID),
        F.xxhash64(ident, body).alias(THASH),
        *[quoted(c).alias(name) for name, c in columns.items()],
    )


def whole_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **columns: str) -> DataFrame:
    """keyed(), with the whole row of docs as the struct `row`, so that its columns may have any name."""
    every = F.struct(*[quoted(c) for c in docs.columns]).alias("row")
    body = F.coalesce(quoted(text).cast("string"), F.lit(""))
    ident = quoted(doc_id).cast("long")
    keys = F.coalesce(ident, F.lit(-1).cast("long")).alias(DID), F.xxhash64(ident, body).alias(THASH)
    return docs.select(every, ident.alias("doc_id"), body.alias("text"), *keys, *[quoted(c).alias(name) for name, c in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_rows(docs: DataFrame, keep: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of docs, with its columns, whose (doc_id, row hash) is in keep; rows that repeat a key stay once."""
    rows = whole_rows(docs, text, doc_id).select("row", DID, THASH)
    wanted = keep.select(F.coalesce("doc_id", F.lit(-1).cast("long")).alias(DID), THASH).distinct()
    return rows.join(wanted, [DID, THASH], "left_semi").dropDuplicates([DID, THASH]).select("row.*")


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
