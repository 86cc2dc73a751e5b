"""Reports of changes, their promotion between environments, and approvals; all are plain JSON values."""

from __future__ import annotations

from dataclasses import asdict
from datetime import datetime

from quern.governance.evolution import diff, fingerprint, state
from quern.governance.migration import action_of
from quern.governance.validation import Step
from quern.spec import Dataset


def report(before: list[Dataset], after: list[Dataset], **policy: bool) -> dict:
    """Each change with its action, strategy and decision, and the fingerprints of both states."""
    found = []
    for c in diff(before, after):
        a = action_of(c, **policy)
        found.append(asdict(c) | {"action": a.action, "strategy": a.strategy, "decision": a.decision})
    counts: dict[str, int] = {}
    for c in found:
        counts[c["decision"]] = counts.get(c["decision"], 0) + 1
    body = {"before": fingerprint(state(before)), "after": fingerprint(state(after)), "changes": found, "counts": counts}
    return body | {"fingerprint": fingerprint(body)}


def promotion(found: dict, source: str, target: str) -> dict:
    """Whether a report's changes may go from one environment to the next, and what stands in their way."""
    if source == target:
        raise ValueError("a promotion needs two environments")
    stops = {"BLOCKED_BY_POLICY": "blocked", "REQUIRES_PREFLIGHT": "preflight"}
    ways = [stops[c["decision"]] for c in found["changes"] if c["decision"] in stops]
    status = "blocked" if "blocked" in ways else "preflight" if ways else "ready" if found["changes"] else "unchanged"
    body = {"report": found["fingerprint"], "source": source, "target": target, "status": status}
    return body | {"fingerprint": fingerprint(body)}


def approval(asked: dict, reviewer: str, approved: bool, at: datetime, note: str = "") -> dict:
    """A reviewer's word on a promotion; a blocked one cannot be approved."""
    if approved and asked["status"] == "blocked":
        raise ValueError("policy blocks this promotion")
    return {"promotion": asked["fingerprint"], "reviewer": reviewer, "approved": approved, "at": at.isoformat(), "note": note}


def review_status(asked: dict, approvals: list[dict], needed: int = 1) -> str:
    """approved, rejected, stale or pending. Of each reviewer's words the last counts; those on other promotions make it stale."""
    last = {a["reviewer"]: a["approved"] for a in sorted(approvals, key=lambda a: a["at"]) if a["promotion"] == asked["fingerprint"]}
    if not last:
        return "stale" if approvals else "pending"
    return "rejected" if not all(last.values()) else "approved" if len(last) >= needed else "pending"


def shadow_compare(expected: list[Step], actual: list[Step]) -> dict[str, list[dict]]:
    """Schema steps that were expected and did not occur, that occurred unexpectedly, and that agree."""
    return {
        "missing": [asdict(s) for s in expected if s not in actual],
        "unexpected": [asdict(s) for s in actual if s not in expected],
        "same": [asdict(s) for s in expected if s in actual],
    }
