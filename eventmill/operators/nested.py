"""Nested incident and traffic records to flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.functions.scalars import as_column, epoch_ms, lenient_timestamp

# fixed values: lookup columns of the nested records
INCIDENT_LOOKUPS = ["OffenceType", "SessionIndex", "DeviceIndex", "Vendor", "PrimaryFileName"]
HISTORY_LOOKUPS = ["ServiceName", "ServerName", "FailType"]
HEADER_LOOKUPS = ["SessionIndex", "DeviceIndex", "Location0", "Location1", "Location2"]
PASSAGE_LOOKUPS = ["VehicleClass", *HEADER_LOOKUPS]


def incident_main(incidents: DataFrame) -> DataFrame:
    return incidents.drop("IncidentFiles", "incidentHistories")


def children(incidents: DataFrame, array: str, *parent: str) -> DataFrame:
    """Child rows with their position and the parent columns; a parent without children gives none."""
    return incidents.select(*parent, F.posexplode(array).alias("ordinal", "_child")).select(
        *parent, "ordinal", "_child.*"
    )


def incident_files(incidents: DataFrame) -> DataFrame:
    return children(incidents, "IncidentFiles", "PrimaryFileName", "InsertionTime")


def incident_history(incidents: DataFrame, states: dict[str, tuple[str, str]]) -> DataFrame:
    """History rows with category and process type; an unknown state is marked as unmapped.

    ``states`` is configuration (state -> (category, process type)) and becomes a
    literal map in the plan.
    """
    rows = children(incidents, "incidentHistories", "PrimaryFileName", "InsertionTime")
    return map_states(rows, states)


def map_states(rows: DataFrame, states: dict[str, tuple[str, str]]) -> DataFrame:
    state = F.coalesce("IncidentState", F.lit(""))
    unmapped = F.concat(F.lit("UNMAPPED_"), state)

    def look(i: int) -> Column:
        if not states:
            return unmapped
        table = F.create_map(*[F.lit(x) for s, v in states.items() for x in (s, v[i])])
        return F.coalesce(F.try_element_at(table, state), unmapped)

    return rows.withColumns({"Category": look(0), "ProcessType": look(1)})


def map_states_by_table(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The same against a mapping table (IncidentState, Category, ProcessType).

    No hint: the table is broadcast when its size allows, else joined by key.
    """
    unmapped = F.concat(F.lit("UNMAPPED_"), F.coalesce("IncidentState", F.lit("")))
    return rows.join(table, "IncidentState", "left").withColumns(
        {"Category": F.coalesce("Category", unmapped), "ProcessType": F.coalesce("ProcessType", unmapped)}
    )


def with_insertion_date(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.to_date(F.timestamp_millis("InsertionTime")))


# --- traffic ---------------------------------------------------------------------
def _text_ms(column: Column) -> Column:
    return epoch_ms(lenient_timestamp(column))


def header_sessions(records: DataFrame, inserted_at) -> DataFrame:
    """Session headers with times as epoch milliseconds."""
    flat = records.filter(F.col("headersession").isNotNull()).select("headersession.*")
    return flat.withColumns(
        {
            "SessionStart": _text_ms(F.col("SessionStart")),
            "SessionEnd": _text_ms(F.col("SessionEnd")),
            "InsertionTime": epoch_ms(as_column(inserted_at)),
        }
    )


def passages(records: DataFrame, as_of) -> DataFrame:
    """Passages with their session's columns; the system name is the device.

    A missing or unreadable passage time becomes ``as_of``; the calendar parts
    follow from the result. No join: the explode keeps the parent row.
    """
    rows = records.select(
        F.coalesce("headersession.SessionIndex", F.lit("")).alias("SessionIndex"),
        F.coalesce("headersession.SystemName", F.lit("")).alias("DeviceIndex"),
        *[F.coalesce(f"headersession.{c}", F.lit("")).alias(c) for c in ("Location0", "Location1", "Location2")],
        _text_ms(F.col("headersession.SessionStart")).alias("SessionStart"),
        _text_ms(F.col("headersession.SessionEnd")).alias("SessionEnd"),
        F.explode("trafficDataList").alias("_p"),
    ).select("*", "_p.*").drop("_p")
    now = as_column(as_of).cast("timestamp")
    at = F.coalesce(lenient_timestamp(F.col("PassageTime")), now)
    imported = F.when(F.col("ImportTime").isNotNull(), F.coalesce(_text_ms(F.col("ImportTime")), epoch_ms(now)))
    return (
        rows.withColumn("_at", at)
        .withColumns(
            {
                "PassageTime": epoch_ms(F.col("_at")),
                "year": F.year("_at"),
                "month": F.month("_at"),
                "day": F.dayofmonth("_at"),
                "hour": F.hour("_at"),
                "minute": F.minute("_at"),
                "ImportTime": imported,
                "InsertionTime": epoch_ms(now),
            }
        )
        .drop("_at")
    )


# --- lookups -----------------------------------------------------------------------
def lookup_pairs(rows: DataFrame, columns: list[str], drop_empty: bool = False) -> DataFrame:
    """Distinct (type, value) pairs of the listed columns that exist.

    The pairs are unfolded per row and combined before the shuffle, so the
    shuffle carries distinct pairs only.
    """
    existing = [c for c in columns if c in rows.columns]
    pair = [
        F.struct(F.lit(c).alias("lookupType"), F.col(c).cast("string").alias("lookupValue")) for c in existing
    ]
    flat = rows.select(F.explode(F.array(*pair)).alias("_x")).select("_x.*").filter("lookupValue is not null")
    if drop_empty:
        flat = flat.filter("lookupValue <> ''")
    return flat.distinct()


def merge_lookups(*pairs: DataFrame | None) -> DataFrame:
    """Set union of lookup tables, existing and new."""
    frames = [p.select("lookupType", "lookupValue") for p in pairs if p is not None]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.distinct()


def incident_lookups(incidents: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    history = incidents.select(F.explode("incidentHistories").alias("_h")).select("_h.*")
    return merge_lookups(
        existing,
        lookup_pairs(incidents, INCIDENT_LOOKUPS, drop_empty=True),
        lookup_pairs(history, HISTORY_LOOKUPS, drop_empty=True),
    )


def traffic_lookups(records: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    headers = records.select("headersession.*").withColumnRenamed("SystemName", "DeviceIndex")
    rows = records.select(F.explode("trafficDataList").alias("_p")).select("_p.*")
    return merge_lookups(existing, lookup_pairs(headers, HEADER_LOOKUPS), lookup_pairs(rows, PASSAGE_LOOKUPS))

