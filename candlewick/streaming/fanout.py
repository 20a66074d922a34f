"""Closed bars and webhook signals on streams, met with the tables of who wants them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.operators import signals


def subscribers(bars: DataFrame, subscriptions: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Each closed bar of a stream once for every user with enabled subscriptions on its keys, with their config_ids as ``configs``.

    Subscriptions (keys, user_id, config_id, enabled) are grouped by user before the join, so that the stream holds no state.
    """
    grouped = subscriptions.filter("enabled = 1").groupBy(*keys, "user_id").agg(F.array_sort(F.collect_set("config_id")).alias("configs"))
    return bars.join(grouped, list(keys))


def configured(stream: DataFrame, configs: DataFrame, payload: str = "payload", key: str = "signal_key") -> DataFrame:
    """Webhook signals of a stream, parsed, with the signal_config_id and user_id of the enabled configuration of their key.

    Signals without one are kept with nulls, as a signal is recorded before anyone asks who wants it. ``configs`` has
    one row for each key (signal_config_id, user_id, enabled).
    """
    known = configs.filter("enabled = 1").select(key, "signal_config_id", "user_id")
    return signals.parsed(stream, payload).join(known, key, "left")
