"""Targets of matched masks from JSON, and cut points from a text report."""

from __future__ import annotations

import json
import re
from pathlib import Path

from tallyloom.operators.masking import Target

#: A line such as "N1 <= 12 < N2 <= 40.5 < N3", with the sign for "at most" in either form.
CUT_LINE = re.compile(r"N1\s*(?:≤|<=)\s*(\S+)\s*<\s*N2\s*(?:≤|<=)\s*(\S+)\s*<\s*N3")


def read_target(path: str | Path) -> Target:
    """The target of a JSON file {"n_cuts": [q1, q2], "pi": {stratum: share}}; ValueError names the file."""
    try:
        stated = json.loads(Path(path).read_text(encoding="utf-8"))
        (q1, q2), pi = stated["n_cuts"], stated["pi"]
        return Target(float(q1), float(q2), {str(k): float(v) for k, v in pi.items()})
    except (KeyError, TypeError, AttributeError, ValueError) as wrong:
        raise ValueError(f"{path} holds no mask target: {wrong}") from wrong


def write_target(path: str | Path, target: Target) -> None:
    Path(path).write_text(json.dumps({"n_cuts": [target.q1, target.q2], "pi": dict(sorted(target.pi.items()))}, indent=1), encoding="utf-8")


def read_cuts(path: str | Path) -> tuple[float, float]:
    """The cut points of n that a report states; it must state them once."""
    found = CUT_LINE.findall(Path(path).read_text(encoding="utf-8"))
    if len(found) != 1:
        raise ValueError(f"{path} states the cut points {len(found)} times, not once")
    q1, q2 = map(float, found[0])
    return q1, q2
