"""The order of loads, their execution, lineage, and what is kept of a run."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.governance.evolution import fingerprint
from quern.operators.loads import plan_load
from quern.spec import Dataset


def levels(inputs: Mapping[str, tuple[str, ...]]) -> list[list[str]]:
    """Waves of datasets, each after all its inputs; a cycle is an error."""
    left = {k: {x for x in v if x in inputs} for k, v in inputs.items()}
    out = []
    while left:
        wave = sorted(k for k, v in left.items() if not v)
        if not wave:
            raise ValueError(f"a cycle among {sorted(left)}")
        out.append(wave)
        left = {k: v - set(wave) for k, v in left.items() if k not in wave}
    return out


def lineage(inputs: Mapping[str, tuple[str, ...]], start: str, down: bool = False, depth: int | None = None) -> dict[str, int]:
    """The datasets upstream of start, or downstream, with their distance."""
    edges: dict[str, list[str]] = {}
    for child, parents in inputs.items():
        for parent in parents:
            edges.setdefault(parent if down else child, []).append(child if down else parent)
    found, front, d = {}, [start], 0
    while front and (depth is None or d < depth):
        d += 1
        front = [y for x in front for y in sorted(edges.get(x, ())) if y != start and found.setdefault(y, d) == d]
        front = list(dict.fromkeys(front))
    return found


@dataclass
class Result:
    """kind: load, exception, blocked or aborted. reason is short, for machines; blocked_by names the input that failed."""

    dataset: str
    status: str
    attempts: int = 0
    seconds: float = 0.0
    message: str = ""
    kind: str = "load"
    reason: str = ""
    blocked_by: str = ""
    started: datetime | None = None


def execute(inputs: Mapping[str, tuple[str, ...]], step: Callable[[str], object], retries: int = 0, fail_fast: bool = True, parallel: int = 1) -> list[Result]:
    """Runs the steps in order. A failed one is tried again; what depends on it, however far, is blocked.

    With parallel above 1, as many steps of one wave run at once, each a Spark job of its own; fail_fast then
    lets a wave end before it stops the next.
    """
    out: dict[str, Result] = {}
    stopped = False

    def run(name: str) -> Result:
        nonlocal stopped
        bad = [p for p in inputs[name] if p in out and out[p].status != "success"]
        if stopped or bad:
            kind = "blocked" if bad else "aborted"
            return Result(name, kind, message=", ".join(bad), kind=kind, reason="blocked_by_dependency" if bad else "fail_fast_abort", blocked_by=bad[0] if bad else "")
        r = Result(name, "error", started=datetime.now(timezone.utc))
        while r.status != "success" and r.attempts <= retries:
            r.attempts += 1
            try:
                answer = step(name)
                failed = isinstance(answer, dict) and answer.get("status") == "error"
                r.status, r.message, r.kind = ("error", str(answer.get("message", "")), "load") if failed else ("success", "", "load")
            except Exception as e:  # noqa: BLE001 - whatever a step raises is its result
                r.message, r.kind = f"{type(e).__name__}: {e}", "exception"
        r.seconds = (datetime.now(timezone.utc) - r.started).total_seconds()
        r.reason = "" if r.status == "success" else "retry_exhausted" if retries else "error"
        return r

    for wave in levels(inputs):
        if parallel > 1:
            with ThreadPoolExecutor(parallel) as pool:
                found = list(pool.map(run, wave))
            out |= {r.dataset: r for r in found}
            stopped = stopped or (fail_fast and any(r.status == "error" for r in found))
            continue
        for name in wave:
            out[name] = run(name)
            stopped = stopped or (fail_fast and out[name].status == "error")
    return list(out.values())


def manifest(inputs: Mapping[str, tuple[str, ...]]) -> dict:
    waves = levels(inputs)
    return {"nodes": sorted(inputs), "dependencies": {k: sorted(v) for k, v in sorted(inputs.items())}, "waves": waves, "fingerprint": fingerprint(waves)}


def check_fresh(planned: str, datasets) -> None:
    """Refuses a plan whose specification has changed since."""
    if planned != fingerprint(datasets):
        raise RuntimeError("the plan is stale; plan again")


#: The columns of the run log, and of the log of batches.
RUN_LOG = (
    "batch_run_id string not null, load_run_id string not null, target_schema string not null, target_dataset string not null, target_system string not null, "
    "profile string not null, run_kind string not null, source_system string, source_dataset string, source_object string, ingest_mode string, delta_cutoff timestamp, "
    "rows_extracted int, chunk_size int, mode string not null, handle_deletes boolean not null, historize boolean not null, started_at timestamp not null, "
    "finished_at timestamp, render_ms int, execution_ms int, sql_length int, rows_affected int, status string not null, error_message string, "
    "attempt_no int not null, status_reason string, blocked_by string"
)
BATCH_LOG = (
    "batch_run_id string not null, created_at timestamp not null, root_dataset_key string not null, is_execute boolean not null, continue_on_error boolean not null, "
    "max_retries int not null, had_error boolean, step_count int not null, snapshot_json string not null"
)


def run_rows(batch: str, datasets: Mapping[str, Dataset], results: list[Result], at: datetime, system: str = "spark", profile: str = "dev", details: Mapping[str, dict] | None = None) -> list[tuple]:
    """A row of the run log for each dataset of a run. details: what else a dataset's load knows, by column."""
    names = [c.split()[0] for c in RUN_LOG.split(", ")]
    out = []
    for r in results:
        d = datasets[r.dataset]
        began = r.started or at
        row = dict.fromkeys(names) | {
            "batch_run_id": batch, "load_run_id": f"{batch}:{r.dataset}", "target_schema": d.layer, "target_dataset": d.name, "target_system": system, "profile": profile,
            "run_kind": "ingestion" if d.layer == "raw" else "sql", "mode": plan_load(d), "handle_deletes": d.detect_deletes, "historize": plan_load(d) == "historize",
            "started_at": began, "finished_at": began + timedelta(seconds=r.seconds) if r.started else None, "execution_ms": int(1000 * r.seconds) if r.started else None,
            "status": "skipped" if r.kind in ("blocked", "aborted") else r.status, "error_message": r.message or None, "attempt_no": max(1, r.attempts),
            "status_reason": r.reason or None, "blocked_by": r.blocked_by or None,
        }
        out.append(tuple((row | dict((details or {}).get(r.dataset, {})))[n] for n in names))
    return out


def log_run(spark: SparkSession, table: str, rows: list[tuple]) -> None:
    """Appends rows of run_rows()."""
    spark.createDataFrame(rows, RUN_LOG).write.mode("append").saveAsTable(table)


def log_batch(spark: SparkSession, table: str, batch: str, at: datetime, root: str, text: str, steps: int, retries: int = 0, fail_fast: bool = True, executed: bool = True, failed: bool | None = None) -> None:
    """Appends the snapshot of a batch, or the cursor of a source, under its root."""
    row = (batch, at, root, executed, not fail_fast, retries, failed, steps, text)
    spark.createDataFrame([row], BATCH_LOG).write.mode("append").saveAsTable(table)


def last_snapshot(spark: SparkSession, table: str, root: str) -> str | None:
    """The text last logged under a root."""
    if not spark.catalog.tableExists(table):
        return None
    found = spark.table(table).where(F.col("root_dataset_key") == root).agg(F.max_by("snapshot_json", "created_at")).first()
    return found[0]


def snapshot(run_id: str, results: list[Result], inputs: Mapping[str, tuple[str, ...]] | None = None, retries: int = 0, fail_fast: bool = True, executed: bool = True) -> str:
    """A run as JSON: its plan, its policy, and what came of each dataset."""
    steps = [{"dataset": r.dataset, "inputs": sorted((inputs or {}).get(r.dataset, ()))} for r in results]
    policy = {"continue_on_error": not fail_fast, "max_retries": retries, "execute": executed}
    return json.dumps({"run_id": run_id, "plan": steps, "policy": policy, "results": [asdict(r) for r in results]}, sort_keys=True, default=str)


def snapshot_diff(before: str, after: str) -> dict[str, tuple[str | None, str | None]]:
    """Datasets whose status differs between two snapshots."""
    a, b = ({r["dataset"]: r["status"] for r in json.loads(s)["results"]} for s in (before, after))
    return {k: (a.get(k), b.get(k)) for k in sorted({*a, *b}) if a.get(k) != b.get(k)}


def run_diff(before: str, after: str) -> dict:
    """All that differs between two runs: datasets, their order and inputs, policy, status, kind and attempts."""
    a, b = json.loads(before), json.loads(after)
    plan = [{s["dataset"]: s["inputs"] for s in x["plan"]} for x in (a, b)]
    result = [{r["dataset"]: r for r in x["results"]} for x in (a, b)]
    both = sorted(set(result[0]) & set(result[1]))
    differs = lambda f: {d: [result[0][d][f], result[1][d][f]] for d in both if result[0][d][f] != result[1][d][f]}
    return {
        "added": sorted(set(plan[1]) - set(plan[0])),
        "removed": sorted(set(plan[0]) - set(plan[1])),
        "reordered": list(plan[0]) != list(plan[1]),
        "inputs": {d: [plan[0][d], plan[1][d]] for d in sorted(set(plan[0]) & set(plan[1])) if plan[0][d] != plan[1][d]},
        "policy": {k: [a["policy"][k], b["policy"][k]] for k in sorted(a["policy"]) if a["policy"][k] != b["policy"][k]},
        "status": differs("status"),
        "kind": differs("kind"),
        "attempts": differs("attempts"),
        "newly_blocked": [d for d in both if result[1][d]["kind"] == "blocked" != result[0][d]["kind"]],
        "newly_aborted": [d for d in both if result[1][d]["kind"] == "aborted" != result[0][d]["kind"]],
    }
