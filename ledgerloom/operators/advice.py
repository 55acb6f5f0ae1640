"""What an advisor may set up: column roles, matching scenarios, and changes asked for in a chat.

As elsewhere an advisor is a callable from a payload (JSON text) to an answer (JSON text), and what it answers
counts only as far as it makes sense; without an answer the defaults hold.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame

from ledgerloom.config import ROLES, ColumnMap, MatchingConfig, Scenario
from ledgerloom.operators.advisor import Advisor, fenced
from ledgerloom.operators.export import sample_rows, serialized
from ledgerloom.operators.profile import characteristics, chat_facts, column_metadata

#: Fields that a scenario may compare, and those that each must (fixed values).
FIELDS, NEEDED = ("vendor", "amount", "date", "entity", "currency"), ("vendor", "amount")


def asked(advisor: Advisor, payload: dict) -> dict:
    """The advisor's answer as a dictionary; anything else, and a failing call, is an empty one."""
    try:
        answer = json.loads(fenced(advisor(json.dumps(payload, default=str))))
    except Exception:  # noqa: BLE001  whatever an outside service raises, the defaults hold
        return {}
    return answer if isinstance(answer, dict) else {}


def column_roles(df: DataFrame, advisor: Advisor, order: str = "ord") -> dict[str, str]:
    """A role for each column, from the columns' metadata; columns that the answer doesn't list are ignored.

    Of several columns for one role the first one has it.
    """
    columns = [c for c in df.columns if c != order]
    said = asked(advisor, {"columns": [r.asDict() for r in column_metadata(df, order).collect()]}).get("roles", {})
    roles, used = {}, set()
    for c in columns:
        role = said.get(c) if isinstance(said, dict) else None
        known = role in ROLES and role != "ignore" and role not in used
        roles[c] = role if known else "ignore"
        used |= {role} if known else set()
    return roles


def column_map(df: DataFrame, default: ColumnMap, advisor: Advisor, order: str = "ord") -> ColumnMap:
    """The roles that the advisor gives as a map; the default if it leaves a mandatory one open."""
    of = {role: c for c, role in column_roles(df, advisor, order).items() if role != "ignore"}
    said = ColumnMap(**{r: of.get(r) for r in ROLES[:-1]})
    return default if said.problems(df.columns) else said


def scenario_of(said: dict) -> Scenario | None:
    """A scenario from an answer, vendor and amount put in where they are missing; none if it names no known field."""
    named = said.get("match_fields")
    fields = tuple(f for f in FIELDS if isinstance(named, list) and f in named)
    if not fields:
        return None
    number = lambda k, kind: kind(said[k]) if isinstance(said.get(k), (int, float)) and not isinstance(said.get(k), bool) and said[k] >= 0 else None
    return Scenario(tuple(f for f in FIELDS if f in fields or f in NEEDED), str(said.get("description") or ""), number("date_days", int), number("amount_abs", float), number("amount_pct", float), number("confidence", float))


def changed(config: MatchingConfig, said: dict) -> MatchingConfig:
    """config with what the answer changes; scenarios, weights or a threshold that aren't valid leave it as it is."""
    listed = said.get("scenarios")
    scenarios = tuple(s for x in (listed if isinstance(listed, list) else []) if isinstance(x, dict) and (s := scenario_of(x)))
    out = replace(config, scenarios=scenarios) if scenarios else config
    for key in ("weights", "threshold"):
        if said.get(key):
            try:
                out = replace(out, **{key: said[key]})
            except (TypeError, ValueError, AttributeError):
                continue
    return out


def matching_config(gl: DataFrame, sub: DataFrame, advisor: Advisor) -> MatchingConfig:
    """The advisor's scenarios for two sides with these characteristics, else the defaults."""
    facts = {name: characteristics(df).first().asDict() for name, df in (("gl", gl), ("sub", sub))}
    return changed(MatchingConfig(), asked(advisor, facts))


def chat(message: str, gl: DataFrame, sub: DataFrame, config: MatchingConfig, advisor: Advisor) -> tuple[str, MatchingConfig]:
    """The reply to a message and the settings after it; the advisor sees a summary and sample rows of both sides."""
    sides = {name: {"facts": chat_facts(df).first().asDict(), "rows": [r.json for r in serialized(sample_rows(df)).collect()]} for name, df in (("gl", gl), ("sub", sub))}
    said = asked(advisor, {"message": message, **sides})
    update = said.get("config_update")
    return str(said.get("reply") or ""), changed(config, update) if isinstance(update, dict) else config
