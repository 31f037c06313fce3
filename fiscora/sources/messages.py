"""Rows as keyed JSON messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fiscora.functions.numeric import missing_to_null


# Times keep their microseconds.
JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def to_keyed_json(df: DataFrame, key: str, default: str = "unknown",
                  keep: Sequence[str] = ()) -> DataFrame:
    """(key, value): the row as a JSON object with explicit nulls, NaN as null.

    Rows without a key, and tables without the key column, get ``default``.
    ``keep`` passes columns through, for instance to order the messages.
    """
    floating = {c for c, t in df.dtypes if t in ("double", "float")}
    record = F.struct(*[(missing_to_null(F.col(f"`{c}`")) if c in floating else F.col(f"`{c}`"))
                        .alias(c) for c in df.columns])
    if key in df.columns:
        key_text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(default))
    else:
        key_text = F.lit(default)
    return df.select(key_text.alias("key"),
                     F.to_json(record, JSON).alias("value"), *keep)


def publish(messages: DataFrame, sink: str, topic: str, order: Sequence[str] = (),
            options: dict[str, str] | None = None) -> None:
    """Write (key, value) messages so that each key stays in order.

    ``sink`` is ``kafka`` (topic name; needs the connector jar) or ``files``
    (topic is a folder). Files are range-partitioned by key and ``order``: a
    key is in one file, or for a hot key in consecutive files, in order.
    """
    if sink == "kafka":
        (messages.select("key", "value").write.format("kafka").option("topic", topic)
         .options(**(options or {})).save())
        return
    if sink != "files":
        raise ValueError(f"unknown sink {sink!r}")
    (messages.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
     .select("key", "value").write.mode("append").json(topic))
