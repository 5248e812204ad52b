"""Decisions about data: gates as tables of checks, metrics as aggregates, sealed parameters.

A gate is a row for each check: what is measured, the bound it must keep, the value that someone stated, and what came of recomputing it. Metrics are functions from
tables to a DataFrame of one number, so a decision rests on the tables and not on what was stated. A record is sealed with a key over the text of its fields; every step
seals what it hands on, and a record whose seal doesn't fit is never accepted.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]
Metric = Callable[[Tables], DataFrame]

WAITING, PASSED, FAILED, APPROVED = "waiting", "passed", "failed", "approved"


@dataclass(frozen=True)
class Check:
    metric: str
    relation: str  # at_most, below, at_least, above, equals
    bound: float

    def holds(self, value: float) -> bool:
        x, y = value, self.bound
        return {"at_most": x <= y, "below": x < y, "at_least": x >= y, "above": x > y, "equals": x == y}[self.relation]


@dataclass(frozen=True)
class Outcome:
    """What recomputing a check's metric gave; None where there was no metric or no value."""

    check: Check
    stated: float | None
    recomputed: float | None
    agrees: bool
    holds: bool


@dataclass(frozen=True)
class Gate:
    name: str
    checks: tuple[Check, ...]
    state: str = WAITING
    stated: tuple[tuple[str, float], ...] = ()
    outcomes: tuple[Outcome, ...] = ()
    by: str = ""
    history: tuple[str, ...] = ()  # seals of the records before
    seal: str = field(default="", compare=False)

    def text(self) -> str:
        return _text({k: v for k, v in asdict(self).items() if k != "seal"})

    def sealed(self, key: bytes) -> Gate:
        return replace(self, seal=hmac.digest(key, self.text().encode(), "sha256").hex())

    def authentic(self, key: bytes) -> bool:
        return hmac.compare_digest(self.seal, self.sealed(key).seal)


def _text(value: object) -> str:
    """One text for equal values: keys in order, no spaces."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def open_gate(name: str, checks: list[Check], key: bytes) -> Gate:
    return Gate(name, tuple(checks)).sealed(key)


def state_values(gate: Gate, values: Mapping[str, float], key: bytes) -> Gate:
    """The gate with stated values; it waits again, whatever it was before."""
    return replace(gate, state=WAITING, stated=tuple(sorted(values.items())), outcomes=(), by="", history=(*gate.history, gate.seal)).sealed(key)


def recompute(tables: Tables, metrics: Mapping[str, Metric]) -> dict[str, float | None]:
    """Each metric's number from the tables; None where the tables it needs are missing or it has no value."""
    out: dict[str, float | None] = {}
    for name, metric in metrics.items():
        try:
            row = metric(tables).first()
        except KeyError:  # a table that isn't there
            row = None
        out[name] = None if row is None or row[0] is None else float(row[0])
    return out


def decide(gate: Gate, tables: Tables, metrics: Mapping[str, Metric], key: bytes, by: str, decimals: int = 2) -> Gate:
    """Passed only if the seal fits and every check's metric, recomputed, agrees with what was stated and keeps its bound."""
    real, stated, outcomes = recompute(tables, {c.metric: metrics[c.metric] for c in gate.checks if c.metric in metrics}), dict(gate.stated), []
    for c in gate.checks:
        x, said = real.get(c.metric), stated.get(c.metric)
        outcomes.append(Outcome(c, said, x, x is not None and said is not None and round(x, decimals) == round(said, decimals), x is not None and c.holds(x)))
    fine = gate.authentic(key) and bool(outcomes) and all(o.agrees and o.holds for o in outcomes)
    return replace(gate, state=PASSED if fine else FAILED, outcomes=tuple(outcomes), by=by, history=(*gate.history, gate.seal)).sealed(key)


def approve(gate: Gate, person: str, token: str, tokens: Mapping[str, str], key: bytes) -> Gate:
    """A person's consent to a gate that passed; `tokens` has the SHA-256 of each person's token. No program decides this step by itself."""
    known = hmac.compare_digest(tokens.get(person, ""), hashlib.sha256(token.encode()).hexdigest())
    if not known or gate.state != PASSED or not gate.authentic(key):
        raise PermissionError("only a known person may approve a gate that passed and whose seal fits")
    return replace(gate, state=APPROVED, by=person, history=(*gate.history, gate.seal)).sealed(key)


def amend(gate: Gate, checks: list[Check], reason: str, key: bytes) -> Gate:
    """Checks with new bounds, for a stated reason; the gate has to be decided anew and keeps the seals of what it was."""
    if not reason:
        raise ValueError("an amendment needs a reason")
    new = {c.metric: c for c in checks}
    merged = tuple(new.pop(c.metric, c) for c in gate.checks) + tuple(new.values())
    return replace(gate, checks=merged, state=WAITING, outcomes=(), by=f"amended: {reason}", history=(*gate.history, gate.seal)).sealed(key)


def demand(gate: Gate, key: bytes, *states: str) -> None:
    """Ends the program unless the gate is authentic and in one of the states (passed or approved)."""
    if not gate.authentic(key) or gate.state not in (states or (PASSED, APPROVED)):
        raise SystemExit(1)


def never_moves(metric: Metric, tables: Tables, changes: Mapping[str, Callable[[DataFrame], DataFrame]]) -> bool:
    """Whether a metric stays the same however its tables are changed (each change alone): such a check says nothing."""
    base = metric(tables).first()
    return all(metric({**tables, name: change(tables[name])}).first() == base for name, change in changes.items())


def shared_sides(spark: SparkSession, ratios: list[tuple[str, str, str]], visible: list[str]) -> DataFrame:
    """Ratios (name, numerator, denominator) both of whose sides an engine may see: what is to be predicted would be known."""
    seen = spark.createDataFrame([(v,) for v in sorted(set(visible))], "account string")
    sides = spark.createDataFrame(ratios, "ratio string, numerator string, denominator string").unpivot("ratio", ["numerator", "denominator"], "side", "account").drop("side").distinct()
    hidden = sides.join(seen, "account", "left_anti").select("ratio").distinct()
    return sides.select("ratio").distinct().join(hidden, "ratio", "left_anti")


def scanned(df: DataFrame) -> list[tuple[str, list[str]]]:
    """What a plan reads once the optimizer has cut it: for each scan its description and the columns it hands on. Columns that only a table kept in memory was made from aren't among them."""
    leaves, out = df._jdf.queryExecution().sparkPlan().collectLeaves(), []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        columns = leaf.output()
        out.append((leaf.simpleString(200), [columns.apply(j).name() for j in range(columns.size())]))
    return out


def blind(df: DataFrame, hidden: list[str], paths: tuple[str, ...] = ()) -> DataFrame:
    """df, if none of its scans hands on a hidden column or reads a hidden path; ValueError otherwise: what is to be predicted must not enter what predicts it."""
    for scan, columns in scanned(df):
        seen = sorted(set(columns) & set(hidden))
        if seen or any(p in scan for p in paths):
            raise ValueError(f"the plan reads {seen or 'a hidden table'}: {scan}")
    return df


def seal(parameters: Mapping[str, object]) -> tuple[str, str]:
    """Parameters as text and its SHA-256."""
    text = _text(parameters)
    return text, hashlib.sha256(text.encode()).hexdigest()


def unseal(text: str, digest: str) -> dict:
    """The parameters, if they are those that were sealed."""
    if not hmac.compare_digest(hashlib.sha256(text.encode()).hexdigest(), digest):
        raise ValueError("the parameters aren't those that were sealed")
    return json.loads(text)


def manifest(old: DataFrame, new: DataFrame, key: list[str], accounts: list[str], by: str) -> DataFrame:
    """by, account, changed, old and new digest, same: how many rows of each part have another value than before (a null is a value), and order-free digests of both versions.

    Rows that only one version has count as changed.
    """
    long = lambda d, v: d.unpivot(key, accounts, "account", v)
    j = long(old, "was").join(long(new, "now"), [*key, "account"], "full")
    digest = lambda v: F.concat_ws("-", F.count(v).cast("string"), F.sum(F.xxhash64(*key, v).cast("decimal(38,0)")).cast("string"))
    g = j.groupBy(by, "account").agg(F.count_if(~F.col("was").eqNullSafe(F.col("now"))).alias("changed"), digest("was").alias("old_digest"), digest("now").alias("new_digest"))
    return g.withColumn("same", F.col("old_digest") == F.col("new_digest"))


def label_agrees(df: DataFrame, label: str, key: list[str], values: list[str]) -> bool:
    """Whether a stated digest is that of a table's content."""
    return content_label(df, key, values) == label


def content_label(df: DataFrame, key: list[str], values: list[str]) -> str:
    """Digest of a table's content by key, whatever the order and the files."""
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*key, *values).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{row[0]}:{row[1]}".encode()).hexdigest()
