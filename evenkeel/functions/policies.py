"""Pure driver-side policies: schedules, budgets and stopping rules.  None touches data."""

from __future__ import annotations

import math
from dataclasses import dataclass


def temperature(step: int, steps: int, low: float = 0.7, high: float = 1.0, kind: str = "cosine") -> float:
    """The sampling temperature of a step: constant, falling linearly, or along a half cosine."""
    if kind == "constant" or steps <= 1:
        return high
    part = min(1.0, step / (steps - 1))
    if kind == "linear":
        return high - (high - low) * part
    if kind == "cosine":
        return low + (high - low) * (1 + math.cos(math.pi * part)) / 2
    raise ValueError(f"unknown schedule {kind!r}")


def batch_size(features: int, wanted: int, context_tokens: int = 131072, large: bool = False, share: float = 0.8) -> int:
    """Rows asked for at once: what fits the context at 18 tokens a feature plus 50, within 5 and 50 unless large."""
    fits = int(context_tokens * share) // (18 * features + 50)
    size = max(5, fits if large else min(50, fits))
    size = max(5, min(size, wanted))
    return max(size, 15) if math.ceil(wanted / size) > 20 else size


def few_shot_count(minority: int) -> int:
    return 10 if minority < 100 else 15 if minority < 1000 else 20


def validation_rate(minority: int, ratio: float, features: int, base: float = 0.12, complexity: float = 0.5) -> float:
    """Expected share of proposals that pass, within 5 and 50 percent."""
    rate = base * (1 + 0.33 * (1 - 2 * complexity))
    rate *= 0.9 if minority < 100 else 1.0
    rate *= 0.9 if ratio > 10 else 1.0
    rate *= 0.85 if features > 30 else 1.0
    return min(0.5, max(0.05, rate))


@dataclass(frozen=True)
class Budget:
    iterations: int
    minutes: float
    expected_rows: int
    capped: bool


def iteration_budget(target: int, rate: float, batch: int, complexity: float, minutes_each: float = 3.5, max_hours: float = 2.0, progress: float = 0.15) -> Budget:
    """Iterations for a target, widened by complexity and capped by the time allowed."""
    wanted = math.ceil(target / max(1e-9, batch * rate * progress) * (1 + 0.5 * complexity))
    allowed = max(1, int(max_hours * 60 / minutes_each))
    n = max(1, min(wanted, allowed))
    return Budget(n, n * minutes_each, min(target, int(n * batch * rate)), wanted > allowed)


def hosted_budget(gap: int, batch: int, rate: float = 0.5, keep: float = 0.7, minutes_each: float = 0.5, hours: float = 8.0, daily_calls: int = 1000) -> int:
    """Iterations on a hosted model: the least of need, time and daily calls, 5 at least."""
    need = math.ceil(min(gap, 10000) / max(1e-9, batch * rate * keep))
    return max(5, min(need, int(hours * 60 / minutes_each), daily_calls))


def converged(history: list[float], all_met: bool, min_rounds: int = 2, max_rounds: int = 10, patience: int = 3, least: float = 0.005, worse: float = -0.02) -> str | None:
    """Why to stop, from the improvements of each round so far, or None."""
    n = len(history)
    if n < min_rounds:
        return None
    if all_met:
        return "targets met"
    if n >= max_rounds:
        return "round limit"
    if history[-1] < worse:
        return "got worse"
    if n >= patience and max(history[-patience:]) < least:
        return "no progress"
    return None


def adjustments(met_share: float) -> dict[str, float | int]:
    """Weights and batch size for the next round, by the share of targets met."""
    weight = 0.6 if met_share >= 0.8 else 0.7 if met_share >= 0.5 else 0.8
    return {"fairness_weight": weight, "diversity_weight": round((1 - weight) / 2, 3), "batch": 25 if met_share >= 0.5 else 50}


def feedback(round_no: int, before: dict[str, float], after: dict[str, float], targets: dict[str, float], stopped: str | None = None) -> tuple[str, float]:
    """(text, share of targets met) of a fairness re-audit: a line per measure with its change, then what to work on, the widest gap first."""
    met = {k: abs(after[k]) <= targets[k] for k in targets if k in after}
    share = sum(met.values()) / len(met) if met else 1.0
    state = "all targets met" if share == 1 else f"stopped: {stopped}" if stopped else "to be continued"
    lines = [f"Round {round_no}: {state}."]
    lines += [f"{k}: {before.get(k, 0.0):.4f} -> {after[k]:.4f} ({abs(before.get(k, 0.0)) - abs(after[k]):+.4f}), {'met' if ok else 'missed'}" for k, ok in met.items()]
    if share < 1 and not stopped:
        missed = sorted((k for k, ok in met.items() if not ok), key=lambda k: (targets[k] - abs(after[k]), k))
        lines.append("Next: " + ", ".join(f"{k} by {abs(after[k]) - targets[k]:.4f}" for k in missed) + f"; settings {adjustments(share)}")
    return "\n".join(lines), share


def strategy(size: str, imbalance: str, features: str, unfair: bool) -> dict[str, object]:
    """Settings recommended for a profile."""
    out: dict[str, object] = {"batch": 20, "temperature": 0.7, "few_shot": 10, "max_iterations": 20, "fairness_weight": 0.4 if unfair else 0.2}
    if size in ("very_small", "small"):
        out |= {"batch": 15, "few_shot": 15}
    if imbalance == "severe":
        out |= {"max_iterations": 40, "temperature": 0.9}
    if features == "high":
        out |= {"batch": 10}
    return out


def warnings(n: int, minority: int, ratio: float, features: int) -> list[str]:
    found = [
        (n < 500, "very few rows: results vary much between seeds"),
        (minority < 50, "fewer than 50 minority rows: neighbours are unreliable"),
        (ratio > 20, "extreme imbalance: many rows must be proposed for each real one"),
        (features > 100, "very many features: distances lose contrast"),
    ]
    return [text for hit, text in found if hit]


#: Q of the Nemenyi test at 0.05 for k methods.
NEMENYI_Q = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}


def critical_difference(methods: int, blocks: int) -> float:
    return NEMENYI_Q[methods] * math.sqrt(methods * (methods + 1) / (6 * blocks))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution, in closed form for whole degrees of freedom."""
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term = total = 1.0
        for k in range(1, df // 2):
            term *= half / k
            total += term
        return math.exp(-half) * total
    total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for k in range(1, (df - 1) // 2 + 1):
        total += term
        term *= half / (k + 0.5)
    return total
