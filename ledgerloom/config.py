"""Settings of a reconciliation: column roles, scenarios, weights and tolerances."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of the matching rules.
DATE_TOLERANCES = (30, 60)
SCENARIO_CONFIDENCE = (1.00, 0.95, 0.90)
PROBABLE_DAYS, MAX_GROUP, AMOUNT_PCT, AMOUNT_ABS = 60, 5, 0.10, 5.00
THRESHOLD, VENDOR_LEAST = 0.80, 0.50
FUZZY_VENDOR, ADVISED_VENDOR = 0.90, 0.70
ADVISED_MATCH, ADVISED_ROWS = 0.40, 20
#: Candidates that one question about a vendor shows, and the least similarity of those that are shown first.
ADVISED_CANDIDATES, NEAR_VENDOR = 200, 0.70
WEIGHTS = {"vendor": 0.45, "amount": 0.40, "date": 0.15}
LARGE_AMOUNT = 10_000.0
ROLES = ("id", "vendor", "amount", "date", "entity", "currency", "ignore")
NO_ENTITY = "__no_entity__"


@dataclass(frozen=True)
class ColumnMap:
    """Which column of a side has which role; id, vendor and amount are mandatory."""

    id: str
    vendor: str = "vendor_name"
    amount: str = "amount"
    date: str | None = "transaction_date"
    entity: str | None = "entity"
    currency: str | None = "currency"

    def problems(self, columns: list[str]) -> list[str]:
        """Messages for mandatory roles without a column and for columns that don't exist."""
        out = [f"role {r} has no column" for r in ("id", "vendor", "amount") if not getattr(self, r)]
        return out + [f"column {c} of role {r} does not exist" for r in ROLES[:-1] if (c := getattr(self, r)) and c not in columns]


GL_COLUMNS, SUB_COLUMNS = ColumnMap("gl_id"), ColumnMap("subledger_id")


@dataclass(frozen=True)
class Scenario:
    """One configurable deterministic scenario.

    The date band holds only if "date" is among match_fields, and the amount band is absolute or
    a share of the GL amount; without either the field must be equal.
    """

    match_fields: tuple[str, ...]
    description: str = ""
    date_days: int | None = None
    amount_abs: float | None = None
    amount_pct: float | None = None
    confidence: float | None = None

    def __post_init__(self) -> None:
        if not self.match_fields:
            raise ValueError("a scenario needs match fields")


@dataclass(frozen=True)
class MatchingConfig:
    """Scenarios and the probabilistic layer's weights and threshold."""

    scenarios: tuple[Scenario, ...] = (
        Scenario(("vendor", "amount", "date", "entity"), "exact"),
        Scenario(("vendor", "amount", "entity"), "date within 30 days", 30),
        Scenario(("vendor", "amount", "entity"), "date within 60 days", 60),
    )
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    threshold: float = THRESHOLD

    def __post_init__(self) -> None:
        if abs(sum(self.weights.values()) - 1) > 0.01:
            raise ValueError("weights must sum to 1")
        if not 0 <= self.threshold <= 1:
            raise ValueError("the threshold must lie between 0 and 1")


def resolve(confirmed: MatchingConfig | None, threshold: float | None = None, weights: dict[str, float] | None = None) -> MatchingConfig:
    """Confirmed settings first, then single values, then defaults; zero and empty mean unset."""
    base = confirmed or MatchingConfig()
    if confirmed:
        return base
    return MatchingConfig(base.scenarios, weights or base.weights, threshold or base.threshold)
