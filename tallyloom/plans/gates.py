"""Whether a node may run: gates over the states of its predecessors, as one small number a node."""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.plans.definition import Edge

#: A node's state as a number: what is open comes first, then success, then skips without harm, skips that do harm, and failure.
PENDING, WAITING, SUCCEEDED, INACTIVE, NOT_TAKEN, UPSTREAM_FAILED, UPSTREAM_SKIPPED, FAILED = range(8)
#: Status and reason to skip of each number (fixed values).
NAMES = (
    ("pending", None), ("waiting", None), ("succeeded", None), ("skipped", "inactive"), ("skipped", "branch_not_taken"), ("skipped", "upstream_failed"), ("skipped", "upstream_skipped"), ("failed", None),
)
#: What a gate says instead of a skip's number.
READY, BLOCKED = SUCCEEDED, PENDING


@dataclass(frozen=True)
class State:
    """A node's columns; ``code`` is a plain number where the state is the same in every run."""

    code: Column | int
    branch: Column | None
    output: Column
    error: Column | None
    is_json: bool


def status_of(code: Column | int) -> Column:
    if isinstance(code, int):
        return F.lit(NAMES[code][0])
    return F.get(F.array(*[F.lit(status) for status, _ in NAMES]), code)


def reason_of(code: Column | int) -> Column:
    if isinstance(code, int):
        return F.lit(NAMES[code][1]).cast("string")
    return F.get(F.array(*[F.lit(reason).cast("string") for _, reason in NAMES]), code)


def active(edge: Edge, state: State) -> Column | bool:
    """Whether the edge's source succeeded and chose the edge's port."""
    chosen = True if edge.port is None else F.coalesce(state.branch == F.lit(edge.port == "true"), F.lit(False))
    if isinstance(state.code, int):
        return chosen if state.code == SUCCEEDED else False
    done = state.code == SUCCEEDED
    return done if chosen is True else done & chosen


def _kind(edge: Edge, state: State) -> Column | int:
    """Of an edge: 3 open, 2 bad, 1 active, 0 neither; a gate's answer is the largest."""
    on = active(edge, state)
    if isinstance(state.code, int) and on is True:
        return 1
    if isinstance(state.code, int):
        return F.when(on, 1).otherwise(0)
    return F.when(state.code < SUCCEEDED, 3).when(state.code >= UPSTREAM_FAILED, 2).when(on, 1).otherwise(0)


def selected(edges: list[Edge], state: dict[str, State]) -> Column | int:
    """READY, BLOCKED, or the skip's number: any predecessor open blocks, any bad one fails, none active skips."""
    kinds = [_kind(e, state[e.source]) for e in edges]
    columns = [k for k in kinds if not isinstance(k, int)]
    if not columns:
        return READY
    if len(columns) < len(kinds):
        columns.append(F.lit(1))
    worst = columns[0] if len(columns) == 1 else F.greatest(*columns)
    return F.get(F.array(F.lit(INACTIVE), F.lit(READY), F.lit(UPSTREAM_FAILED), F.lit(BLOCKED)), worst)


def every(edges: list[Edge], state: dict[str, State]) -> Column | int:
    """READY, BLOCKED, or the skip's number that the first offending edge gives, even while others are open."""
    reasons, opens = [], []
    for e in edges:
        s, on = state[e.source], active(e, state[e.source])
        if on is True:
            continue
        if isinstance(s.code, int):
            reasons.append(F.when(~on, NOT_TAKEN))
            continue
        reasons.append(F.when((s.code > SUCCEEDED) & (s.code < FAILED), UPSTREAM_SKIPPED).when(s.code == FAILED, UPSTREAM_FAILED).when((s.code == SUCCEEDED) & ~on, NOT_TAKEN))
        opens.append(F.when(s.code < SUCCEEDED, BLOCKED))
    return F.coalesce(*reasons, *opens, F.lit(READY)) if reasons else READY
