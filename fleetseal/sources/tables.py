"""Readers of exported tables and event streams. All of them take an explicit schema and work in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetseal import schemas
from fleetseal.functions.registry import BIND_OPCODES, UNBIND_OPCODES, full_key_name, registry_identity, serialise_value
from fleetseal.operators.attribution import AUDIT_EVENT_IDS


def read_table(spark: SparkSession, path: str, schema: str, file_format: str = "parquet", streaming: bool = False,
               **options: str) -> DataFrame:
    """Rows of files with a known schema."""
    reader = spark.readStream if streaming else spark.read
    return reader.format(file_format).schema(schema).options(**options).load(path)


def read_members(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Exported inventory rows with the evidence a path alone cannot give (access lists, streams, attributes, links)."""
    return read_table(spark, path, schemas.MEMBERS, file_format)


def read_notifications(spark: SparkSession, path: str, file_format: str = "json", streaming: bool = True, **options: str) -> DataFrame:
    """Raw file notifications. ``options`` such as maxFilesPerTrigger bound a micro-batch."""
    return read_table(spark, path, schemas.RAW_NOTIFICATIONS, file_format, streaming, **options)


def read_registry_trace(spark: SparkSession, path: str, file_format: str = "json", streaming: bool = True, **options: str) -> DataFrame:
    """Registry trace events, with the opcodes that bind handles to paths among them."""
    return read_table(spark, path, schemas.REGISTRY_TRACE, file_format, streaming, **options)


def handle_operations(trace: DataFrame) -> DataFrame:
    """The trace as (create, delete, use) operations on handles, for handle resolution."""
    opcode = F.col("opcode")
    return trace.withColumn(
        "op", F.when(opcode.isin(*BIND_OPCODES), "create").when(opcode.isin(*UNBIND_OPCODES), "delete").otherwise("use")
    ).withColumn("path", F.col("key_name"))


def registry_names(resolved: DataFrame) -> DataFrame:
    """Full entity name of each resolved trace row."""
    return resolved.withColumn("entity", full_key_name(F.col("resolved_path"), F.col("key_name"), F.col("value_name")))


def read_file_trace(spark: SparkSession, path: str, file_format: str = "json", streaming: bool = True, **options: str) -> DataFrame:
    """File activity and process life cycle events."""
    return read_table(spark, path, schemas.FILE_TRACE, file_format, streaming, **options)


def split_file_trace(trace: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file activity, process starts, rundowns and stops)."""
    return trace.filter(F.upper("task") == "FILEIO"), trace.filter(F.upper("task") == "PROCESS")


def read_audit_records(spark: SparkSession, path: str, file_format: str = "json", streaming: bool = False, **options: str) -> DataFrame:
    """Security audit records of the two object-access events, with their native XML."""
    records = read_table(spark, path, schemas.AUDIT_RECORDS, file_format, streaming, **options)
    return records.filter(F.col("native_event_id").isin(*AUDIT_EVENT_IDS))


def read_settings_layers(spark: SparkSession, policy: str, preference: str, legacy: str, file_format: str = "parquet"):
    """The three settings layers, to be resolved by :func:`fleetseal.operators.settings.effective`."""
    return tuple(read_table(spark, p, schemas.SETTINGS_VALUES, file_format) for p in (policy, preference, legacy))


def registry_members(keys: DataFrame, values: DataFrame) -> DataFrame:
    """Inventory members of exported registry rows: one per key, one per value with its key's access list and state.

    ``keys`` is (host, path, acl_state, acl_evidence), ``values`` is (host, key_path, value_name, kind, text_value,
    int_value, data, items). Values are kept as stored: names of variables inside them are not expanded.
    """
    key_rows = keys.select(
        "host", registry_identity(F.col("path"), F.lit(False)).alias("identity_key"), "path", F.lit(3).alias("node_type"),
        "acl_state", "acl_evidence", F.lit(None).cast("string").alias("registry_value_kind"),
        F.lit(None).cast("binary").alias("registry_value_data"))
    lists = keys.select("host", F.upper("path").alias("__key"), "acl_state", "acl_evidence")
    path = F.concat("key_path", F.lit("\\"), "value_name")
    data = serialise_value(F.col("kind"), F.col("text_value"), F.col("int_value"), F.col("data"), F.col("items"))
    value_rows = values.withColumn("__key", F.upper("key_path")).join(lists, ["host", "__key"]).select(
        "host", registry_identity(path, F.lit(True)).alias("identity_key"), path.alias("path"), F.lit(4).alias("node_type"),
        "acl_state", "acl_evidence", F.col("kind").alias("registry_value_kind"), data.alias("registry_value_data"))
    state = F.lit(schemas.HASH_STATES.index("NotApplicable")).alias("hash_state")
    return key_rows.unionByName(value_rows).select("*", state)
