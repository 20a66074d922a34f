"""Messages of an exchange: candles, tickers, instruments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.functions.timegrid import align, plus_ms
from candlewick.operators.checks import flat, valid


def is_data(message: str) -> F.Column:
    """Messages with data, not those about the connection."""
    return F.get_json_object(message, "$.event").isNull() & F.get_json_object(message, "$.data").isNotNull()


def channel(message: str) -> F.Column:
    """Where a message goes: ``candle`` or ``ticker`` by its channel, ``system`` for those about the connection, else ``unknown``."""
    name = F.get_json_object(message, "$.arg.channel")
    about = F.get_json_object(message, "$.event").isNotNull()
    return F.when(about, "system").when(name.startswith("candle"), "candle").when(name == "tickers", "ticker").otherwise("unknown")


def candles(messages: DataFrame, message: str = "message", received: str = "received") -> DataFrame:
    """One-minute bars from candle messages ({arg: {instId}, data: [[ms, o, h, l, c, volume, .., .., confirm]]}).

    Confirmed candles stay, and those not confirmed in their last second (59 to 60 seconds old when received);
    invalid and flat ones go, and those with a number that doesn't parse. is_final is false: only the store knows.
    """
    rows = messages.filter(is_data(message)).select("*", F.get_json_object(message, "$.arg.instId").alias("symbol"), F.explode(F.from_json(F.get_json_object(message, "$.data"), "array<array<string>>")).alias("c"))
    at = lambda i: F.get("c", F.lit(i))
    opened = F.timestamp_millis(at(0).try_cast("long"))
    rows = rows.select("symbol", align(opened, 60_000).alias("ts"), *(at(i).try_cast("double").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)), at(8).alias("confirm"), F.col(received).alias("received"))
    age = F.unix_seconds("received") - F.unix_seconds("ts")
    kept = rows.filter((F.coalesce(F.col("confirm") == "1", F.lit(False)) | age.between(59, 59)) & valid() & ~flat() & F.col("ts").isNotNull() & F.col("volume").isNotNull())
    return kept.select("symbol", "ts", plus_ms(F.col("ts"), 60_000).alias("close_time"), "open", "high", "low", "close", "volume", F.lit(False).alias("is_final"))


def tickers(messages: DataFrame, message: str = "message", received: str = "received") -> DataFrame:
    """(symbol, price, ts) from ticker messages; without a time of its own, the time of receipt."""
    get = lambda p: F.get_json_object(message, p)
    rows = messages.filter(is_data(message))
    return rows.select(get("$.arg.instId").alias("symbol"), get("$.data[0].last").try_cast("double").alias("price"), F.coalesce(F.timestamp_millis(get("$.data[0].ts").try_cast("long")), F.col(received)).alias("ts"))


def symbol_key(instrument: F.Column, market: F.Column) -> tuple[F.Column, F.Column, F.Column]:
    """(base symbol, standard key, pair of the first two parts) of an instrument's name."""
    base = F.regexp_replace(instrument, "-(SWAP|FUTURES)$", "")
    parts = F.split(instrument, "-")
    pair = F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "-")).otherwise(instrument)
    return base, F.concat_ws("-", base, market), pair


def instruments(messages: DataFrame, message: str = "message") -> DataFrame:
    """(symbol, base, quote, precision, trading) from an instrument list's JSON ({instId, baseCcy, quoteCcy, tickSz, state})."""
    shape = "array<struct<instId:string,baseCcy:string,quoteCcy:string,tickSz:string,state:string>>"
    rows = messages.select(F.explode(F.from_json(F.get_json_object(message, "$.data"), shape)).alias("i")).select("i.*")
    parts = F.split("instId", "-")
    base, quote = (F.when(F.col(c) != "", F.col(c)) for c in ("baseCcy", "quoteCcy"))
    symbol = F.when(base.isNotNull() & quote.isNotNull(), F.concat_ws("-", base, quote)).otherwise(F.concat_ws("-", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    scale = F.length(F.regexp_extract("tickSz", r"\.(\d*?)0*$", 1))
    return rows.select("instId", symbol.alias("symbol"), F.coalesce(base, F.get(parts, F.lit(0))).alias("base"), F.coalesce(quote, F.get(parts, F.lit(1))).alias("quote"), scale.alias("precision"), (F.col("state") == "live").alias("trading"))


def masked(secret: F.Column) -> F.Column:
    """The first and last four characters of a secret; of a short one nothing."""
    return F.when(F.length(secret) <= 8, "****").otherwise(F.concat(F.substring(secret, 1, 4), F.lit("****"), F.substring(secret, -4, 4)))
