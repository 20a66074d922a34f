"""Signals, pages, and rows that are written once: the first of a key stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parsed(rows: DataFrame, payload: str) -> DataFrame:
    """Add direction, price, quantity and event_type from a signal's JSON.

    An action with BUY or LONG is LONG, else with SELL or SHORT is SHORT, else NEUTRAL; numbers that don't parse
    are null; quantity has precedence over qty.
    """
    get = lambda k: F.get_json_object(payload, f"$.{k}")
    action = F.upper(F.coalesce(get("action"), F.lit("")))
    direction = F.when(action.contains("BUY") | action.contains("LONG"), "LONG").when(action.contains("SELL") | action.contains("SHORT"), "SHORT").otherwise("NEUTRAL")
    return rows.withColumns({"direction": direction, "price": get("price").try_cast("double"), "quantity": F.coalesce(get("quantity").try_cast("double"), get("qty").try_cast("double")), "event_type": F.upper(get("event_type"))})


def page(rows: DataFrame, order: list[Column], page: int = 1, size: int = 200) -> DataFrame:
    """One page in a unique order, with the number of all rows as ``total``."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).join(F.broadcast(total))


def fresh(incoming: DataFrame, stored: DataFrame, keys: list[str], arrival: str | None = None) -> DataFrame:
    """Rows of ``incoming`` whose key isn't stored; of several with one key, the first to arrive."""
    new = incoming.join(stored.select(*keys), keys, "left_anti")
    if arrival is None:
        return new.dropDuplicates(keys)
    order = Window.partitionBy(*keys).orderBy(arrival)
    return new.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def system_definitions(incoming: DataFrame, stored: DataFrame, arrival: str) -> DataFrame:
    """Definitions (code, version, ...) that the system lacks, as its own: user_id is 0, whatever the rows say.

    A stored definition is never changed, and other users' with the same code and version don't count.
    """
    own = incoming.withColumn("user_id", F.lit(0).cast("long"))
    return fresh(own, stored.filter("user_id = 0"), ["user_id", "code", "version"], arrival)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key; values are those of ``new`` where it has the key, but for ``keep`` columns those of ``old``."""
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("_old"))
    b = new.select(*keys, F.struct(*values).alias("_new"))
    both = a.join(b, keys, "full")
    pick = lambda c: F.coalesce(F.col(f"_old.{c}"), F.col(f"_new.{c}")) if c in keep else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    return both.select(*keys, *(pick(c).alias(c) for c in values))


def conflicts(stored: DataFrame, computed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, stored, computed) where both the fingerprint and the value of a key differ."""
    a = stored.select(*keys, F.col("value").alias("stored"), F.col("fp").alias("old_fp"))
    b = computed.select(*keys, F.col("value").alias("computed"), F.col("fp").alias("new_fp"))
    return a.join(b, keys).filter((F.col("old_fp") != F.col("new_fp")) & (F.col("stored") != F.col("computed"))).select(*keys, "stored", "computed")
