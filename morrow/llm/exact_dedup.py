"""Exact deduplication as a stateful stream.

Each text is read once and becomes a narrow stamp: digest of the normalised text, stable
identifiers and the file it lies in.  The stamps are streamed through an aggregation keyed
by digest whose state has no expiry and lies on disk (RocksDB, with its change log in the
shared checkpoint): a text that arrives a year later still meets its first copy.  Digests
only propose copies.  Every text whose digest was hit is read again and compared in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from morrow.llm.support import body, documents_like, shared_path, single_spaced, stored

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # Only changes go to the checkpoint, and no disk is reserved beyond what the state takes.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # One bound on RocksDB's memory for all state partitions of an executor.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def stamp_texts(docs: DataFrame, digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One narrow row per input row; ``locator`` is the file that holds the text."""
    return docs.select(
        "doc_id", single_spaced(body()).alias("norm"), F.input_file_name().alias("locator")
    ).select(
        "doc_id",
        "locator",
        digest(F.col("norm")).alias("digest"),
        F.octet_length("norm").cast("long").alias("n_bytes"),
    )


def _entry() -> list[Column]:
    """Smallest doc_id (null last) with its place, and the number of rows."""
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "locator")
    return [F.min(order).alias("first"), F.count(F.lit(1)).alias("size")]


def stream_digests(
    spark: SparkSession, stamps_path: str, schema: StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Run stamps through the keyed state; returns one row per digest and length.

    Each micro-batch writes the entries that it changed.  An entry only moves to a smaller
    first row and a larger size, so the latest entry is the minimum and the maximum, and a
    micro-batch that is run again changes nothing.
    """
    old = {key: spark.conf.get(key, None) for key in STATE_CONF}
    updates = shared_path(spark, "digest-updates")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    entries = reader.parquet(stamps_path).groupBy("digest", "n_bytes").agg(*_entry())
    spark.createDataFrame([], entries.schema).write.parquet(f"{updates}/batch=none")
    try:
        for key, value in STATE_CONF.items():
            spark.conf.set(key, value)
        entries.writeStream.outputMode("update").option(
            "checkpointLocation", shared_path(spark, "digest-state")
        ).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    found = spark.read.schema(entries.schema).option("recursiveFileLookup", "true").parquet(updates)
    return found.groupBy("digest", "n_bytes").agg(
        F.min("first").alias("first"), F.max("size").alias("size")
    )


def _same_id(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on doc_id, where null equals null."""
    right = right.withColumnRenamed("doc_id", "right_id")
    return left.join(right, left["doc_id"].eqNullSafe(right["right_id"]), how)


def exact_groups(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256_hex,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Group equal texts (equal after replacing each run of white space by one space).

    Returns one row per input row: ``doc_id``, ``keep_id`` (the smallest doc_id of the group,
    whose row stays), ``group_size``, ``kept``, ``digest``, ``locator`` (file of the row that
    stays, empty if the input is not read from files).

    Defined cases: a null text counts as empty; a null doc_id is larger than any other; of
    rows with the same doc_id and text exactly one is ``kept``; texts of any length are
    compared in full; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    key = ["digest", "n_bytes"]
    path = shared_path(spark, "stamps")
    found = stamp_texts(docs, digest)
    found.write.option("compression", "zstd").parquet(path)
    stamps = spark.read.schema(found.schema).parquet(path)
    state = stored(stream_digests(spark, path, stamps.schema, files_per_batch), "digests")
    hits = state.where("size > 1")
    rows = stamps.groupBy("doc_id", *key).agg(
        F.count(F.lit(1)).alias("copies"), F.min("locator").alias("locator")
    )

    # Full comparison of all hits.  The grouping key is the text alone: copies are merged
    # before the shuffle, so a group of any size sends one text per task.
    def texts_of(digests: DataFrame) -> DataFrame:
        ids = stamps.join(digests.select(*key), key, "left_semi").select("doc_id").distinct()
        texts = docs.select("doc_id", body().alias("text"), F.input_file_name().alias("locator"))
        return _same_id(texts, ids, "left_semi").withColumn("norm", single_spaced(F.col("text"))).drop("text")

    length = F.octet_length("norm").cast("long")
    texts = (
        texts_of(hits)
        .groupBy("norm")
        .agg(*_entry())
        .select("*", digest(F.col("norm")).alias("digest"), length.alias("n_bytes"))
    )
    counted = stored(
        texts.groupBy(*key).agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first"), F.sum("size").alias("size")),
        "compared",
    )
    confirmed = hits.select(*key).join(counted.where("texts = 1"), key).drop("texts")
    colliding = counted.join(hits.select(*key), key, "left_semi").where("texts > 1").select(*key)
    clash = not colliding.isEmpty()
    plain = rows.join(colliding, key, "left_anti") if clash else rows
    groups = plain.join(confirmed, key, "left")
    if clash:
        # Different texts share a digest: their rows meet their group by the text itself.
        own = texts.join(colliding, key, "left_semi")
        apart = texts_of(colliding).groupBy("doc_id", "norm").agg(
            F.count(F.lit(1)).alias("copies"), F.min("locator").alias("locator")
        )
        groups = groups.unionByName(apart.join(own, "norm").select(groups.columns))
    alone = F.coalesce("size", "copies") == F.col("copies")
    keep_id = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return groups.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("size", "copies").cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(keep_id)).alias("kept"),
        "digest",
        F.coalesce("first.locator", "locator").alias("locator"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).withColumn("kept", F.col("kept") & (F.col("copy") == 1)).drop("copy")


def group_digest(docs: DataFrame) -> DataFrame:
    """The columns of query op3."""
    return exact_groups(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents without later copies, with the columns of ``documents``."""
    groups = stored(exact_groups(docs), "groups")
    ids = groups.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("kept").cast("long")).alias("kept")
    )
    ids = ids.where("kept > 0")
    marked = _same_id(documents_like(docs), ids, "inner")
    single = documents_like(marked.where("rows = 1"))
    if ids.where("rows > 1").isEmpty():
        return single
    # Several rows bear the same doc_id: the text decides which of them stay.
    kept = groups.where("kept").select("doc_id", "digest")
    several = marked.where("rows > 1").withColumn("digest", sha256_hex(single_spaced(body())))
    kept = kept.select(F.col("doc_id").alias("kept_id"), "digest").distinct()
    stay = several.join(
        kept, several["doc_id"].eqNullSafe(kept["kept_id"]) & (several["digest"] == kept["digest"]), "left_semi"
    )
    return single.unionByName(documents_like(stay.dropDuplicates(["doc_id", "digest"])))
