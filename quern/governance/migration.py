"""What a change of declarations asks of the tables: a plan of actions, and its execution."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from quern.governance.evolution import Change, decide, diff, migrate
from quern.operators.loads import restored, swap_table
from quern.spec import Dataset

#: Kind of a change of a dataset or of a column, to action and strategy.
ACTIONS = {
    ("rename", False): ("RENAME_DATASET", "RENAME_TABLE"),
    ("add", False): ("CREATE_DATASET", "CREATE_TABLE"),
    ("drop", False): ("DROP_DATASET", "DROP_TABLE"),
    ("change", False): ("REBUILD_DATASET", "REBUILD"),
    ("rename", True): ("RENAME_COLUMN", "RENAME_COLUMN"),
    ("add", True): ("ADD_COLUMN", "ALTER_TABLE"),
    ("drop", True): ("DROP_COLUMN", "ALTER_TABLE"),
    ("change", True): ("ALTER_COLUMN", "ALTER_TABLE"),
    ("retire", True): ("RETIRE_COLUMN", "METADATA_ONLY"),
    ("unretire", True): ("UNRETIRE_COLUMN", "METADATA_ONLY"),
}


@dataclass(frozen=True)
class Action:
    action: str
    strategy: str
    dataset: str
    column: str | None = None
    previous: str | None = None
    decision: str = "ALLOW"


def action_of(change: Change, **policy: bool) -> Action:
    action, strategy = ACTIONS[change.kind, change.column is not None]
    return Action(action, strategy, change.dataset, change.column, change.before if change.kind == "rename" else None, decide(change, **policy))


def plan(before: list[Dataset], after: list[Dataset], only: set[str] | None = None, **policy: bool) -> tuple[Action, ...]:
    """The actions that lead from one state to the next, datasets first; of those named only, with their histories, if so asked."""
    wanted = None if only is None else only | {f"{n}_hist" for n in only}
    found = [action_of(c, **policy) for c in diff(before, after) if wanted is None or c.dataset in wanted]
    return tuple(sorted(found, key=lambda a: a.column is not None))


def _moved(spark: SparkSession, old: str, new: str) -> bool:
    if spark.catalog.tableExists(new) or not restored(spark, old):
        return False
    spark.sql(f"alter table {old} rename to {new}")
    return True


def execute(spark: SparkSession, actions: tuple[Action, ...], before: list[Dataset], after: list[Dataset], allow_lossy: bool = False, allow_drop: bool = False) -> list[str]:
    """Brings the tables to the new state; what was done, in order.

    Blocked actions are an error, and then nothing is done. A table is renamed in place; all changes of
    its columns are one select and one swap. New datasets are created, empty. Dropping needs
    its allowance for columns; datasets are never dropped.
    """
    blocked = [f"{a.action} {a.dataset}{'.' + a.column if a.column else ''}" for a in actions if a.decision == "BLOCKED_BY_POLICY"]
    if blocked:
        raise ValueError(f"policy blocks: {', '.join(blocked)}")
    old, new, done = {d.name: d for d in before}, {d.name: d for d in after}, []
    was = {a.dataset: a.previous for a in actions if a.action == "RENAME_DATASET"}
    rebuilt: dict[str, DataFrame] = {}
    for name in dict.fromkeys(a.dataset for a in actions if a.strategy in ("ALTER_TABLE", "RENAME_COLUMN", "REBUILD")):
        source = was.get(name, name)
        if name in new and source in old and restored(spark, source):  # looked at before anything changes, so that a refusal changes nothing
            rebuilt[name] = migrate(spark.table(source), old[source], replace(new[name], columns=tuple(c for c in new[name].columns if c.active)), allow_lossy, allow_drop)
    for a in actions:
        if a.action == "RENAME_DATASET" and _moved(spark, a.previous, a.dataset):
            done.append(f"{a.action} {a.previous} {a.dataset}")
        elif a.action == "CREATE_DATASET" and not spark.catalog.tableExists(a.dataset):
            spark.createDataFrame([], new[a.dataset].schema()).write.saveAsTable(a.dataset)
            done.append(f"{a.action} {a.dataset}")
    for name in rebuilt:
        source = was.get(name, name)
        swap_table(migrate(spark.table(name), old[source], replace(new[name], columns=tuple(c for c in new[name].columns if c.active)), allow_lossy, allow_drop), name)
        done += [f"{a.action} {name}.{a.column}" if a.column else f"{a.action} {name}" for a in actions if a.dataset == name and a.strategy in ("ALTER_TABLE", "RENAME_COLUMN", "REBUILD")]
    return done
