"""Rule trees in JSON, compiled to columns: PASSED, FAILED or BLOCKED for each row, and what was hit.

Three outcomes, not SQL's null logic: a rule or group that is BLOCKED blocks its tree, unless the tree's mode is
ANY and one before it has passed. Modes other than ANY mean ALL; ALL of nothing passes, ANY of nothing fails.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

PASSED, FAILED, BLOCKED = "PASSED", "FAILED", "BLOCKED"
PREFIXES = ("BAR.", "IND.", "PX.", "SIG.", "STATE.")
NUMBER, STRING, BOOLEAN = "NUMBER", "STRING", "BOOLEAN"
#: Texts that are numbers: no blanks, no separators, neither NaN nor infinity.
DECIMAL = r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


class Value(NamedTuple):
    """A typed column; null where the value is missing. ``literal`` texts are known when compiling."""

    kind: str
    column: Column


class Outcome(NamedTuple):
    """The state of a tree or rule, why it is BLOCKED (else null), and its hits (null for a tree that is BLOCKED).

    A rule's hits are a struct (factor, operator, value, hit, reason); a tree's are (rules, groups) with the rules' structs
    and one (mode, hit, rules) for each group, as far as evaluation went.
    """

    state: Column
    reason: Column
    hits: Column


def factors(code: str = "ind_code", value: str = "ind_value", extra: str = "ind_extra") -> Mapping[str, Value]:
    """Factors of a context row with bar_*, px_last, sig_*, state_* and param columns; IND.<code> is resolved on asking."""
    number = lambda c: Value(NUMBER, c.cast("double"))
    known = {f"BAR.{x.upper()}": number(F.col(f"bar_{x}")) for x in ("open", "high", "low", "close", "volume")}
    known["PX.LAST"] = number(F.when(F.col("px_last") > 0, F.col("px_last")))
    valid = F.coalesce(F.col("sig_valid"), F.lit(False))
    known["SIG.DIRECTION"] = Value(STRING, F.when(valid, F.col("sig_direction")))
    known["SIG.INTENT_ID"] = number(F.when(valid, F.col("sig_intent_id")))
    known["STATE.POSITION_SIDE"] = Value(STRING, F.col("state_side"))
    known["STATE.POSITION_QTY"] = number(F.col("state_qty"))
    # a stop below the entry, whatever the side
    known["STATE.STOP_LOSS_PRICE"] = number(F.col("state_entry") * (1 - F.col("param_stop_loss")))

    class Factors(dict):
        def __missing__(self, key: str) -> Value:
            if key.startswith("IND."):
                name = key[4:]
                return number(F.when(F.col(code) == name, F.col(value)).otherwise(F.element_at(F.col(extra), F.lit(name))))
            return Value(NUMBER, F.lit(None).cast("double"))

    return Factors(known)


def allowed(key: object) -> bool:
    """Whether a factor key has one of the known prefixes."""
    return isinstance(key, str) and key.startswith(PREFIXES)


def _literal(value: object, kind: str) -> Value | None:
    if kind == NUMBER and isinstance(value, (int, float, str)) and not isinstance(value, bool):
        return Value(NUMBER, F.lit(float(value))) if re.fullmatch(DECIMAL, str(value), re.ASCII) else None
    if kind == STRING:
        return Value(STRING, F.lit(str(value).lower() if isinstance(value, bool) else str(value)))
    if kind == BOOLEAN and isinstance(value, bool):
        return Value(BOOLEAN, F.lit(value))
    if kind == BOOLEAN and isinstance(value, str):
        return Value(BOOLEAN, F.lit(value.lower() == "true"))
    return None


_COMPARE = {"GT": lambda a, b: a > b, "LT": lambda a, b: a < b, "GTE": lambda a, b: a >= b, "LTE": lambda a, b: a <= b, "EQ": lambda a, b: a == b, "NEQ": lambda a, b: a != b}
_TEXT = {"EQ": lambda a, b: a == b, "NEQ": lambda a, b: a != b, "CONTAINS": lambda a, b: a.contains(b), "STARTS_WITH": lambda a, b: a.startswith(b), "ENDS_WITH": lambda a, b: a.endswith(b)}
_TRUTH = {"EQ": _COMPARE["EQ"], "NEQ": _COMPARE["NEQ"]}


def _compared(left: Value, operator: str, right: Value) -> Column | None:
    """The comparison, null where it can't be made; None if it never can."""
    kinds = {left.kind, right.kind}
    if kinds == {NUMBER, STRING}:
        text = lambda c: F.when(c.rlike(f"^{DECIMAL}$"), c.try_cast("double"))
        a, b = (text(x.column.cast("string")) if x.kind == STRING else x.column for x in (left, right))
        return _COMPARE[operator](a, b) if operator in _COMPARE else None
    if len(kinds) > 1:
        return None
    table = {NUMBER: _COMPARE, STRING: _TEXT, BOOLEAN: _TRUTH}[left.kind]
    return table[operator](left.column, right.column) if operator in table else None


def rule(spec: Mapping, known: Mapping[str, Value]) -> Outcome:
    """Compile one rule {factor, operator, value, type, nullable}."""
    key, operator, value = spec.get("factor"), str(spec.get("operator", "")), spec.get("value")
    state, reason = F.lit(BLOCKED), F.lit(f"factor not allowed: {key}")
    if allowed(key):
        left = known[key]
        if isinstance(value, str) and "." in value and allowed(value):
            right = known[value]
        else:
            right = None if value is None else _literal(value, spec.get("type", NUMBER))
        made = _compared(left, operator, right) if right is not None else None
        state = reason = F.lit(None).cast("string")
        if right is None:
            state, reason = F.lit(BLOCKED), F.lit(f"no such value: {value}")
        elif made is None:
            state, reason = F.lit(BLOCKED), F.lit(f"can't be compared: {key} {operator}")
        else:
            none, odd = right.column.isNull(), made.isNull()
            state = F.when(none | odd, BLOCKED).when(made, PASSED).otherwise(FAILED)
            reason = F.when(none, f"no such value: {value}").when(odd, f"can't be compared: {key} {operator}")
        gone, nullable = left.column.isNull(), spec.get("nullable") is True
        state = F.when(gone, FAILED if nullable else BLOCKED).otherwise(state)
        reason = F.when(gone, F.lit(None if nullable else f"factor has no value: {key}").cast("string")).otherwise(reason)
    text = F.lit(None if value is None else str(value)).cast("string")
    told = F.coalesce(reason, F.when(state == PASSED, "hit").otherwise("miss"))
    fields = {"factor": F.lit(key).cast("string"), "operator": F.lit(operator), "value": text, "hit": state == PASSED, "reason": told}
    return Outcome(state, reason.cast("string"), F.struct(*(c.alias(n) for n, c in fields.items())))


_RULES = "array<struct<factor:string,operator:string,value:string,hit:boolean,reason:string>>"
_GROUPS = f"array<struct<mode:string,hit:boolean,rules:{_RULES}>>"


def tree(spec: Mapping, known: Mapping[str, Value]) -> Outcome:
    """Compile a tree {mode, rules, groups}: its parts in order, rules before groups.

    Evaluation ends at the first part that is BLOCKED, and where the mode is ANY at the first that passes; what comes
    after it isn't among the hits. A group's hits are its rules, not those of groups inside it.
    """
    rules = [rule(r, known) for r in spec.get("rules") or []]
    groups = [(g.get("mode", "ALL"), tree(g, known)) for g in spec.get("groups") or []]
    parts = rules + [g for _, g in groups]
    any_ = spec.get("mode", "ALL") == "ANY"
    if any_:
        state = F.lit(FAILED)
        for p in reversed(parts):
            state = F.when(p.state != FAILED, p.state).otherwise(state)
    else:
        blocked = failed = F.lit(False)
        for p in parts:
            blocked, failed = blocked | (p.state == BLOCKED), failed | (p.state == FAILED)
        state = F.when(blocked, BLOCKED).when(failed, FAILED).otherwise(PASSED)
    reached, going, reason = [], F.lit(True), F.lit(None).cast("string")
    for p in parts:
        reached.append(going)
        reason = F.coalesce(reason, F.when(going & (p.state == BLOCKED), p.reason))
        going = going & (p.state != BLOCKED) & ((p.state != PASSED) if any_ else F.lit(True))
    shown = [F.when(on, p.hits) for on, p in zip(reached, rules)]
    inner = [F.when(on, F.struct(F.lit(mode).alias("mode"), (g.state == PASSED).alias("hit"), F.coalesce(g.hits["rules"], F.array().cast(_RULES)).alias("rules"))) for on, (mode, g) in zip(reached[len(rules) :], groups)]
    listed = lambda xs, kind: (F.filter(F.array(*xs), lambda x: x.isNotNull()) if xs else F.array()).cast(kind)
    hits = F.when(state != BLOCKED, F.struct(listed(shown, _RULES).alias("rules"), listed(inner, _GROUPS).alias("groups")))
    return Outcome(state, reason, hits)


def compiled(text: str | None, known: Mapping[str, Value]) -> Outcome:
    """Compile a condition's JSON; null, empty or broken JSON is BLOCKED."""
    try:
        spec = json.loads(text) if text else None
    except json.JSONDecodeError:
        spec = None
    if not isinstance(spec, dict) or not spec:
        none = F.lit(None).cast(f"struct<rules:{_RULES},groups:{_GROUPS}>")
        return Outcome(F.lit(BLOCKED), F.lit("no condition"), none)
    return tree(spec, known)
