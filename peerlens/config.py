"""Parameters of the peer engine. Derived constants (penalty, thresholds, tuned weights) are never stored here: they come from the dev snapshots."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Ratio:
    name: str
    numerator: str
    denominator: str


RATIOS = (
    Ratio("gross_margin", "gross", "revenue"),
    Ratio("operating_margin", "op_income", "revenue"),
    Ratio("inventory_turnover", "cost", "inventory"),
    Ratio("receivables_turnover", "revenue", "receivables"),
)
SCALE_ACCOUNTS = ("revenue", "assets")
SCORED_ACCOUNTS = ("revenue", "cost", "gross", "op_income", "inventory", "receivables")


@dataclass(frozen=True)
class Config:
    snapshot_years: tuple[int, ...] = (1996, 1997, 1998, 1999, 2000, 2001)
    dev_years: tuple[int, ...] = (1996, 1997, 1998, 1999)
    k: int = 5
    k_final: int = 10
    min_peers: int = 3
    prefixes: tuple[int, ...] = (999, 2)
    #: Weights to begin with; the weight search on the dev snapshots finds those that are applied to the holdout.
    weights: dict[str, float] = field(default_factory=lambda: {"industry": 0.25, "scale": 0.25, "mktcap": 0.125, "text": 0.25, "growth": 0.125})
    gram: int = 3
    vocabulary: int = 3000
    within: tuple[int, ...] = (10, 20, 30)
    penalty_quantile: float = 0.9
    ill_quantile: float = 0.1
    seed: int = 42
    replicates: int = 2000
    targets_a_year: int = 250

    @property
    def normal_weights(self) -> dict[str, float]:
        total = sum(self.weights.values())
        return {k: w / total for k, w in self.weights.items()} if total > 0 else dict(self.weights)


DEFAULT = Config()
