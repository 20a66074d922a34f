"""Dimensions: pairs, rules, subscriptions, strategies."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the subscriptions of a key are dealt to, and tasks that meet them with events: a set number, since rows are small before they meet.
PARTS, TASKS = 64, 192


def targets(configs: DataFrame, pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Enabled configurations with their pair and exchange rule; those without either are left out."""
    return configs.filter("enabled = 1").join(pairs, "pair_id").join(rules, "pair_id")


def with_rules(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """All pairs, with their exchange rule where there is one."""
    return pairs.join(rules, "pair_id", "left")


def with_pair(tasks: DataFrame, pairs: DataFrame) -> DataFrame:
    """All tasks or configurations, with the columns of their pair; nulls where the pair is unknown."""
    return tasks.join(pairs, "pair_id", "left")


def resolved(names: DataFrame, exact: DataFrame, standard: DataFrame) -> DataFrame:
    """Add pair_id to (name): by the exchange's name, else by the standard symbol without a suffix."""
    base = F.regexp_replace("name", "-(SWAP|FUTURES)$", "")
    a = exact.select(F.col("exchange_symbol").alias("name"), F.col("pair_id").alias("_a"))
    b = standard.select(F.col("symbol").alias("_base"), F.col("pair_id").alias("_b"))
    return names.join(a, "name", "left").withColumn("_base", base).join(b, "_base", "left").select("name", F.coalesce("_a", "_b").alias("pair_id"))


def fanned_out(events: DataFrame, subscriptions: DataFrame, keys: list[str], parts: int = PARTS) -> DataFrame:
    """Each event once for every enabled subscription on its keys.

    Keys can be few, with most of the rows. So subscriptions are dealt to ``parts``, each event goes to all of these, and
    what one key gives is spread over ``TASKS`` tasks, whatever the size of either side; nothing is broadcast.
    """
    enabled = subscriptions.filter("enabled = 1").drop("enabled")
    dealt = enabled.withColumn("_part", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c, kind in enabled.dtypes if "map<" not in kind)), F.lit(parts)))
    spread = events.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    by = [*keys, "_part"]
    return spread.repartition(TASKS, *by).join(dealt.repartition(TASKS, *by).hint("merge"), by).drop("_part")


def strategies(definitions: DataFrame, params: DataFrame, symbols: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Enabled strategies with parameters, enabled symbols and subscriptions; without parameters or symbols none."""
    listed = symbols.filter("enabled = 1").groupBy("strategy_id").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    wanted = subscriptions.filter("enabled = 1").groupBy("strategy_id").agg(F.array_sort(F.collect_set("config_id")).alias("configs"))
    return definitions.filter("enabled = 1").join(params, "strategy_id").join(listed, "strategy_id").join(wanted, "strategy_id", "left")


def instances(configs: DataFrame, states: DataFrame) -> DataFrame:
    """One row for each strategy and symbol, with its state or the first one: flat, nothing held, idle."""
    rows = configs.select("strategy_id", F.explode("symbols").alias("symbol"))
    met = rows.join(states, ["strategy_id", "symbol"], "left")
    return met.select("strategy_id", "symbol", F.coalesce("side", F.lit("FLAT")).alias("side"), F.coalesce("qty", F.lit(0.0)).alias("qty"), F.coalesce("phase", F.lit("IDLE")).alias("phase"))


def search(rows: DataFrame, word: str, columns: list[str]) -> DataFrame:
    """Rows with a word in any of the columns."""
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).contains(word)
    return rows.filter(found)


def _given(value: object) -> bool:
    return value is not None and not (isinstance(value, str) and not value.strip())


def matching(rows: DataFrame, equal: Mapping[str, object] | None = None, since: Mapping[str, object] | None = None, until: Mapping[str, object] | None = None) -> DataFrame:
    """Rows that meet the predicates that are given: columns equal to, not below, not above a value. None and blank text ask for nothing."""
    for c, v in (equal or {}).items():
        rows = rows.filter(F.col(c) == F.lit(v)) if _given(v) else rows
    for c, v in (since or {}).items():
        rows = rows.filter(F.col(c) >= F.lit(v).cast(rows.schema[c].dataType)) if _given(v) else rows
    for c, v in (until or {}).items():
        rows = rows.filter(F.col(c) <= F.lit(v).cast(rows.schema[c].dataType)) if _given(v) else rows
    return rows


def lookup(rows: DataFrame, enabled: bool | None = None, order: tuple[str, ...] = (), **keys: object) -> DataFrame:
    """Rows of a dimension by its keys (user_id, strategy_id, pair_id, ...), all of which must be given; only enabled ones if asked."""
    for c, v in keys.items():
        if not _given(v):
            raise ValueError(f"{c} is to be given")
    rows = matching(rows, {**keys, "enabled": None if enabled is None else int(enabled)})
    return rows.orderBy(*order) if order else rows


def pair_info(requests: DataFrame, pairs: DataFrame, listed: DataFrame) -> DataFrame:
    """Each of ``requests`` (pair_id, ...) with its pair's and its listing's columns, and ``error`` where either isn't there."""
    met = requests.join(pairs.withColumn("_pair", F.lit(1)), "pair_id", "left").join(listed.withColumn("_listed", F.lit(1)), "pair_id", "left")
    error = F.when(F.col("_pair").isNull(), F.concat(F.lit("no pair "), F.col("pair_id").cast("string"))).when(F.col("_listed").isNull(), F.concat(F.lit("pair "), F.col("pair_id").cast("string"), F.lit(" isn't listed")))
    return met.withColumn("error", error).drop("_pair", "_listed")
