"""Message envelopes, probes, query tags and source concatenation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from fleetfold.session import broadcast_if_small

ENVELOPE_FIELDS = ("value", "query_uid", "created_ms", "is_canary")


def wrap(df: DataFrame, key: Column, value: Column, query_uid: Column | None = None,
         created_ms: Column | None = None, is_canary: Column | None = None,
         value_uid: Column | None = None) -> DataFrame:
    """Key and value as JSON texts, each carrying tag, creation time and probe flag, without other columns.

    ``value_uid`` tags the value otherwise than the key, as a faulty sender does.
    """
    return wrap_columns(df, key, value, query_uid, created_ms, is_canary, value_uid).select("key", "value")


def wrap_columns(df: DataFrame, key: Column, value: Column, query_uid: Column | None = None,
                 created_ms: Column | None = None, is_canary: Column | None = None,
                 value_uid: Column | None = None) -> DataFrame:
    """As ``wrap``, beside the frame's other columns."""
    now = (F.unix_micros(F.current_timestamp()) / 1000).cast("bigint")
    key_uid = query_uid if query_uid is not None else F.lit(None).cast("string")
    meta = [
        (created_ms if created_ms is not None else now).alias("created_ms"),
        (is_canary if is_canary is not None else F.lit(False)).alias("is_canary"),
    ]
    of_value = key_uid if value_uid is None else value_uid
    return df.withColumns({
        "key": F.to_json(F.struct(key.alias("value"), key_uid.alias("query_uid"), *meta)),
        "value": F.to_json(F.struct(value.alias("value"), of_value.alias("query_uid"), *meta)),
    })


def envelope_type(value_type: DataType | str) -> str:
    kind = value_type if isinstance(value_type, str) else value_type.simpleString()
    return f"struct<value:{kind},query_uid:string,created_ms:bigint,is_canary:boolean>"


def unwrap(df: DataFrame, key_type: DataType | str, value_type: DataType | str) -> DataFrame:
    """Typed key and value, their two tags, and the key's time and probe flag."""
    k = F.from_json(F.col("key").cast("string"), envelope_type(key_type))
    v = F.from_json(F.col("value").cast("string"), envelope_type(value_type))
    return df.select(k.alias("k"), v.alias("v")).select(
        F.col("k.value").alias("key"),
        F.col("v.value").alias("value"),
        F.col("k.query_uid").alias("key_uid"),
        F.col("v.query_uid").alias("value_uid"),
        F.col("k.created_ms").alias("created_ms"),
        F.col("k.is_canary").alias("is_canary"),
    )


def drop_null_records(df: DataFrame) -> DataFrame:
    return df.where(F.col("value").isNotNull())


def drop_canaries(df: DataFrame, flag: str = "is_canary") -> DataFrame:
    """Probe records never reach a query; an absent flag means a normal record."""
    return df.where(~F.coalesce(F.col(flag), F.lit(False)))


def for_query(df: DataFrame, query_uid: str, key_tag: str = "key_uid",
              value_tag: str = "value_uid", strict: bool = False,
              observation: Observation | str | None = None) -> DataFrame:
    """Records of one query; an untagged record belongs to none.

    Key and value tags must agree. A record on which they differ is left out,
    or raises an error when ``strict``. An ``observation`` gets the numbers of all ``records`` and of those
    with ``clashing`` tags from the pass that filters; on a stream its name appears in every batch's progress.
    """
    agree = F.col(key_tag).eqNullSafe(F.col(value_tag))
    if observation is not None:
        df = df.observe(observation, F.count(F.lit(1)).alias("records"), F.count_if(~agree).alias("clashing"))
    wanted = F.col(key_tag) == F.lit(query_uid)
    if not strict:
        return df.where(wanted & agree)
    clash = F.raise_error(F.concat(F.lit("key and value tags differ: "),
                                   F.coalesce(F.col(key_tag), F.lit("none")), F.lit(", "),
                                   F.coalesce(F.col(value_tag), F.lit("none"))))
    return df.where(F.when(agree, wanted).otherwise(clash.cast("boolean")))


def concat_sources(sources: Mapping[str, DataFrame], label: str = "source") -> DataFrame:
    """All records of all sources, each marked with the source it came from."""
    union = None
    for name, df in sources.items():
        marked = df.withColumn(label, F.lit(name))
        union = marked if union is None else union.unionByName(marked)
    if union is None:
        raise ValueError("no source given")
    return union


def route_by_query(messages: DataFrame, registry: DataFrame,
                   keys: tuple[str, ...] = ("op", "item")) -> DataFrame:
    """Messages whose query is registered."""
    known = registry.select(*keys).distinct()
    return messages.join(broadcast_if_small(known), list(keys), "left_semi")


def unrouted(messages: DataFrame, registry: DataFrame,
             keys: tuple[str, ...] = ("op", "item")) -> DataFrame:
    """Messages for queries nobody registered, including untagged ones."""
    known = registry.select(*keys).distinct()
    return messages.join(broadcast_if_small(known), list(keys), "left_anti")


def first_status(sends: DataFrame, statuses: DataFrame, message: str = "uuid",
                 status: str = "status", order: str = "seq") -> DataFrame:
    """Each send with the first status reported for it; later ones are ignored.

    Statuses collapse to one row per message on the map side before any join,
    and statuses of unknown messages drop out.
    """
    first = statuses.groupBy(message).agg(F.min_by(status, order).alias(status))
    return sends.join(first, message, "left")
