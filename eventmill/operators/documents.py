"""Export of gold tables as keyed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventmill.functions.scalars import as_column, iso_utc
from eventmill.operators import changes
from eventmill.operators.enrich import content_id
from eventmill.operators.writers import write_table

# Dimension that completes the document id per gold table (fixed values).
DIMENSION = {
    "customer_metrics": None,
    "campaign_metrics": "campaign_id",
    "event_analytics": "event_type",
    "segment_metrics": "segment",
}


def documents(df: DataFrame, table: str) -> DataFrame:
    """Document id from window start and dimension, and every time as ISO text.

    The id is taken before the times become text.
    """
    dimension = DIMENSION[table]
    parts = [F.unix_seconds("window_start").cast("string")]
    if dimension:
        parts.append(F.coalesce(F.col(dimension).cast("string"), F.lit("")))
    with_id = df.withColumn("doc_id", F.concat_ws("_", *parts))
    times = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return with_id.withColumns({c: iso_utc(F.col(c)) for c in times})


def generated_documents(df: DataFrame, ingested_at=None) -> DataFrame:
    """Id from the row's content: a rerun gives the same ids."""
    now = F.current_timestamp() if ingested_at is None else as_column(ingested_at)
    return df.withColumns({"doc_id": content_id(df), "ingestion_timestamp": now})


def append_documents(df: DataFrame, path: str, ingested_at=None) -> None:
    write_table(generated_documents(df, ingested_at), path, "append", "json")


def upsert_documents(df: DataFrame, path: str) -> None:
    changes.upsert(df, path, ["doc_id"])


def read_documents(spark, path: str) -> DataFrame | None:
    return changes.read_merged(spark, path, ["doc_id"])


def replace_documents(df: DataFrame, path: str) -> None:
    write_table(df, path, "overwrite", "json")


def index_options(nodes: str, port: str = "9200", operation: str = "upsert") -> dict[str, str]:
    """Options for the search-index connector, where its jar is on the class path."""
    return {
        "es.nodes": nodes,
        "es.port": port,
        "es.mapping.id": "doc_id",
        "es.write.operation": operation,
        "es.nodes.wan.only": "true",
    }


def write_index(df: DataFrame, index: str, options: dict[str, str], fmt: str = "org.elasticsearch.spark.sql") -> None:
    df.write.format(fmt).options(**options).option("es.resource", index).mode("append").save()


def bulk_lines(df: DataFrame, index: str) -> DataFrame:
    """Action and document lines of a bulk request, built on the executors."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index")).alias("index")))
    document: Column = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    return df.select(F.explode(F.array(action, document)).alias("value"))


def write_bulk(df: DataFrame, index: str, path: str) -> None:
    bulk_lines(df, index).write.mode("overwrite").text(path)
