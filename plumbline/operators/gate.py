"""Regression gate: a project fails if its score falls below last score plus threshold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import one_decimal, round_half_up, round_half_up_py


def evaluate_gate(inputs: DataFrame) -> DataFrame:
    """Add decision, floor and seeded to rows with new_score, last_score and threshold.

    A last score of 0 seeds: it always passes. A null score fails unless seeding.
    """
    floor = F.col("last_score") + F.col("threshold")
    seeded = F.col("last_score") == 0
    return inputs.withColumns(
        {
            "decision": F.when(seeded | F.coalesce(F.col("new_score") >= floor, F.lit(False)), "pass").otherwise("fail"),
            "floor": round_half_up(floor),
            "seeded": seeded,
        }
    )


def evaluate_gate_all(gate: DataFrame) -> DataFrame:
    """One row: the overall decision, and how many projects there are and fail."""
    failed = F.count_if(F.col("decision") == "fail")
    return gate.agg(F.when(failed > 0, "fail").otherwise("pass").alias("decision"), F.count("*").alias("n_projects"), failed.alias("n_failed"))


@dataclass(frozen=True)
class GateResult:
    decision: str
    floor: float
    new_score: float
    last_score: float
    threshold: float
    seeded: bool = False


def gate_one(new_score: float | None, last_score: float, threshold: float) -> GateResult:
    """The gate of one project, for callers without a frame."""
    seeded = last_score == 0
    ok = seeded or (new_score is not None and new_score >= last_score + threshold)
    return GateResult("pass" if ok else "fail", round_half_up_py(last_score + threshold), new_score, last_score, threshold, seeded)


def plain(x: float) -> str:
    """A number without a trailing '.0'."""
    return str(int(x)) if float(x).is_integer() else repr(float(x))


# Fixed formats of the messages below.


def _shown(x: float | None) -> str:
    return "n/a" if x is None else one_decimal(x)


def pass_message(g: GateResult) -> str:
    return f"PASS — score {_shown(g.new_score)} ≥ floor {one_decimal(g.floor)} (last {one_decimal(g.last_score)}, threshold {plain(g.threshold)}). Saved {_shown(g.new_score)}."


def fail_message(g: GateResult) -> str:
    return f"FAIL — score {_shown(g.new_score)} < floor {one_decimal(g.floor)} (last {one_decimal(g.last_score)}, threshold {plain(g.threshold)}). Config not updated."


def pass_all_message(gates: dict[str, GateResult]) -> str:
    n = len(gates)
    return f"PASS — all {n} {'project' if n == 1 else 'projects'} held their floor. Saved {n} baselines."


def fail_all_message(gates: dict[str, GateResult]) -> str:
    failed = {name: g for name, g in gates.items() if g.decision == "fail"}
    n = len(failed)
    out = [f"FAIL — {n} {'project' if n == 1 else 'projects'} regressed beyond {'its floor' if n == 1 else 'their floor'}. Config not updated."]
    for name, g in failed.items():
        delta = None if g.new_score is None else round_half_up_py(g.new_score - g.last_score)
        sign = "+" if delta is not None and delta >= 0 else ""
        out.append(f"  {name} — score {_shown(g.new_score)} < floor {one_decimal(g.floor)} (last {one_decimal(g.last_score)}, threshold {plain(g.threshold)}, delta {sign}{_shown(delta)})")
    return "\n".join(out)


def gate_json(g: GateResult) -> dict:
    return {"decision": g.decision, "floor": g.floor, "lastScore": g.last_score, "threshold": g.threshold}
