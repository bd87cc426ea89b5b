"""Locks that bind inputs by digest, one-time evaluation, and the registry of what has been seen."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = ("development", "locked", "fresh")


def table_digest(df: DataFrame, key: str) -> str:
    """A digest of a table's rows whatever their order: the md5s of its rows as JSON, hashed in order of key and summed as numbers."""
    row = F.conv(F.substring(F.md5(F.to_json(F.struct(*sorted(df.columns)))), 1, 12), 16, 10).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("n"), F.sum(row).alias("s"), F.min(key).alias("a"), F.max(key).alias("b")).first()
    return hashlib.sha256(f"{r['n']}|{r['s']}|{r['a']}|{r['b']}".encode()).hexdigest()


def freeze(tables: Mapping[str, tuple[DataFrame, str]], seed: int, replicates: int) -> dict:
    """A lock: each table's digest, the seed and the number of replicates."""
    lock = {"bindings": {n: table_digest(df, key) for n, (df, key) in sorted(tables.items())}, "seed": seed, "replicates": replicates}
    return lock | {"sha256": hashlib.sha256(json.dumps(lock, sort_keys=True).encode()).hexdigest()}


def broken_bindings(lock: dict, tables: Mapping[str, tuple[DataFrame, str]]) -> list[str]:
    return [n for n, h in lock["bindings"].items() if n not in tables or table_digest(*tables[n]) != h]


def evaluate_once(lock: dict, tables: Mapping[str, tuple[DataFrame, str]], done: set[str]) -> None:
    """Raises if an input changed, or if the lock has been evaluated; else notes it in done."""
    if bad := broken_bindings(lock, tables):
        raise ValueError(f"changed since the freeze: {', '.join(bad)}")
    if lock["sha256"] in done:
        raise ValueError("this lock has been evaluated")
    done.add(lock["sha256"])


def may_claim_fresh(registry: Mapping[str, str], cohort: str) -> bool:
    """Only a cohort that was never exposed is fresh."""
    return cohort not in registry


def is_reserved(path: str, reserved: Sequence[str]) -> bool:
    """The path itself or anything inside."""
    p = path.rstrip("/")
    return any(p == r.rstrip("/") or p.startswith(r.rstrip("/") + "/") for r in reserved)


def report_problems(report: Mapping) -> list[str]:
    """What a report lacks: a known tier, a statement, limitations; a lock belongs to fresh and locked reports only."""
    out = []
    if report.get("tier") not in TIERS:
        out.append("tier")
    if not report.get("statement"):
        out.append("statement")
    if not report.get("limitations"):
        out.append("limitations")
    if bool(report.get("lock_sha256")) != (report.get("tier") in ("locked", "fresh")):
        out.append("lock")
    return out


def exposed(registry: Mapping[str, str], cohort: str, status: str) -> dict[str, str]:
    """The registry with a cohort's new status; a locked cohort never becomes anything else."""
    if registry.get(cohort) == "locked" and status != "locked":
        raise ValueError(f"{cohort} is locked")
    return {**registry, cohort: status}
