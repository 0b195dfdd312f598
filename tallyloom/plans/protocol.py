"""Evaluation protocol on the driver: closed configs, frozen hashes, seeds that were used, verdicts."""

from __future__ import annotations

import hashlib
import json
import subprocess
import tomllib
from pathlib import Path

KEYS = {"masks", "seeds", "rate", "models", "pairs", "hypotheses", "passes", "amendment"}
RULES = {"pair_better", "pair_not_better", "case_table"}


class ProtocolError(ValueError):
    pass


def read_config(path: Path) -> dict:
    """A TOML config with known keys only; models of pairs and hypotheses must be listed."""
    config = tomllib.loads(path.read_text())
    if unknown := set(config) - KEYS:
        raise ProtocolError(f"unknown keys: {sorted(unknown)}")
    if lacking := {"masks", "seeds", "models"} - set(config):
        raise ProtocolError(f"missing keys: {sorted(lacking)}")
    for pair in config.get("pairs", []):
        if not set(pair) <= set(config["models"]):
            raise ProtocolError(f"pair of unknown models: {pair}")
    for h in config.get("hypotheses", []):
        if h.get("rule") not in RULES:
            raise ProtocolError(f"unknown rule: {h.get('rule')}")
    return config


def frozen_hash(config: dict) -> str:
    """Digest of a config without its amendment, whatever the order of its keys."""
    kept = {k: v for k, v in config.items() if k != "amendment"}
    return hashlib.sha256(json.dumps(kept, sort_keys=True).encode()).hexdigest()


def check_frozen(config: dict, stated: str) -> None:
    if frozen_hash(config) != stated and "amendment" not in config:
        raise ProtocolError("the config changed after it was frozen")


def refuse_used(seeds: list[int], used: list[int]) -> None:
    """Confirmation seeds must be new."""
    if again := sorted(set(seeds) & set(used)):
        raise ProtocolError(f"seeds were used before: {again}")


def cases(masks: list[str], seeds: list[int]) -> list[tuple[str, int | None]]:
    """The native pass, then each mask with each seed."""
    return [("none", None), *((m, s) for m in masks for s in seeds)]


def combine(verdicts: list[bool | None]) -> str:
    """Over masks: confirmed if all are, na without any, else not confirmed."""
    known = [v for v in verdicts if v is not None]
    return "na" if not known else "confirmed" if all(known) and len(known) == len(verdicts) else "not confirmed"


def same_runs(a: dict, b: dict, ignore: tuple[str, ...] = ("created", "commit", "seconds")) -> bool:
    """Two manifests agree but for provenance."""
    strip = lambda x: {k: strip(v) for k, v in x.items() if k not in ignore} if isinstance(x, dict) else x
    return strip(a) == strip(b)


def mean_sd(values: list[float | None], digits: int = 4) -> str:
    """Mean and sample deviation as text; NA without values."""
    known = [v for v in values if v is not None]
    if not known:
        return "NA"
    mean = sum(known) / len(known)
    if len(known) < 2:
        return f"{mean:.{digits}f}"
    return f"{mean:.{digits}f} ± {(sum((v - mean) ** 2 for v in known) / (len(known) - 1)) ** 0.5:.{digits}f}"


def update_block(text: str, name: str, block: str) -> str:
    """text with what stands between the marks of `name` replaced."""
    first, last = f"<!-- {name} -->", f"<!-- end {name} -->"
    if first not in text or last not in text:
        raise ProtocolError(f"the report has no block {name}")
    head, rest = text.split(first, 1)
    return f"{head}{first}\n{block}\n{last}{rest.split(last, 1)[1]}"


def provenance(root: Path) -> dict:
    """Commit of the working tree, if there is one, and digests of the package's files."""
    git = subprocess.run(["git", "-C", str(root), "rev-parse", "HEAD"], capture_output=True, text=True)
    files = {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(root.rglob("*.py"))}
    return {"commit": git.stdout.strip() or None, "files": files}
