"""Definitions of dataflow graphs, and the rules they must keep."""

from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from tallyloom.functions.contracts import check_schema

#: Built-in node types, ids kept from nodes, parameters that must be there, and the longest id (fixed values). Types of the
#: second group act on the outside, and are played from recorded outcomes here.
PURE = ("start", "end", "script", "condition", "delay", "human_task", "input", "sub_workflow")
OUTSIDE = ("http_call", "harness", "email", "llm")
RESERVED = ("run-input", "prepared-params")
REQUIRED = {"script": ("code",), "condition": ("expr",), "delay": ("ms",), "http_call": ("url",), "input": ("fields",), "sub_workflow": ("workflow_id",), "harness": ("prompt",), "email": ("api_key", "from", "to", "subject", "body"), "llm": ("url", "body")}
ID_BYTES, CHILD_DEPTH = 253, 16
JOINS, PORTS = ("all", "selected"), ("true", "false")
#: What a parameter of a node type must be, where it is given; text may hold a template instead of a number.
SHAPES = {
    "script": {"code": str, "timeout_ms": int}, "condition": {"expr": str, "timeout_ms": int}, "delay": {"ms": int}, "http_call": {"url": str, "method": str, "headers": dict},
    "input": {"fields": list}, "sub_workflow": {"workflow_id": str, "input_mapping": dict}, "harness": {"prompt": str}, "email": {"from": str, "subject": str}, "llm": {"url": str, "response_schema": dict},
}
RETRY_MOST = 100


@dataclass(frozen=True)
class Node:
    id: str
    type: str
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    port: str | None = None


@dataclass(frozen=True)
class Definition:
    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...]
    semantics: int = 2
    input_schema: dict | None = None
    output_schema: dict | None = None

    def into(self, node_id: str) -> list[Edge]:
        return [e for e in self.edges if e.target == node_id]

    def levels(self) -> list[list[Node]]:
        """Nodes by the longest way from the start, each level in definition order. Needs a graph without a cycle."""
        sorter = TopologicalSorter({n.id: {e.source for e in self.into(n.id)} for n in self.nodes})
        sorter.prepare()
        out, by_id = [], {n.id: n for n in self.nodes}
        while sorter.is_active():
            ready = set(sorter.get_ready())
            out.append([by_id[n.id] for n in self.nodes if n.id in ready])
            sorter.done(*ready)
        return out


def parse(spec: dict) -> Definition:
    """A definition from its JSON form, edges having from, to and port."""
    nodes = tuple(Node(n["id"], n["type"], n.get("params") or {}) for n in spec["nodes"])
    edges = tuple(Edge(e["from"], e["to"], e.get("port")) for e in spec["edges"])
    return Definition(nodes, edges, spec.get("semantics", 2), spec.get("input_schema"), spec.get("output_schema"))


def _fits(value, kind: type) -> bool:
    if kind is int:
        return type(value) is int and value >= 0 or isinstance(value, str) and "${" in value
    return isinstance(value, kind)


def problems(d: Definition, plugins: frozenset[str] = frozenset()) -> list[tuple[str, str]]:
    """(rule, detail) of every rule broken; none for a sound definition."""
    out: list[tuple[str, str]] = []
    say = lambda rule, detail: out.append((rule, str(detail)))
    kinds = {n.id: n.type for n in d.nodes}
    if d.semantics not in (1, 2):
        say("semantics", d.semantics)
    if sum(n.type == "start" for n in d.nodes) != 1:
        say("one_start", sum(n.type == "start" for n in d.nodes))
    if not any(n.type == "end" for n in d.nodes):
        say("has_end", 0)
    seen: set[str] = set()
    for n in d.nodes:
        if not n.id.strip() or len(n.id.encode()) > ID_BYTES:
            say("node_id", n.id)
        if n.id in RESERVED:
            say("reserved_id", n.id)
        if n.id in seen:
            say("unique_id", n.id)
        seen.add(n.id)
        if n.type not in PURE + OUTSIDE and n.type not in plugins:
            say("node_type", n.type)
        for name in REQUIRED.get(n.type, ()):
            if n.params.get(name) in (None, ""):
                say("param", f"{n.id}.{name}")
        for name, kind in SHAPES.get(n.type, {}).items():
            if n.params.get(name) not in (None, "") and not _fits(n.params[name], kind):
                say("param", f"{n.id}.{name}")
        if n.type == "input" and isinstance(n.params.get("fields"), list):
            keys = [f.get("key") if isinstance(f, dict) else None for f in n.params["fields"]]
            if not all(isinstance(k, str) and k for k in keys) or len(set(keys)) < len(keys):
                say("param", f"{n.id}.fields")
        if n.type == "llm" and isinstance(n.params.get("response_schema"), dict):
            try:
                check_schema(n.params["response_schema"])
            except ValueError as error:
                say("response_schema", f"{n.id}: {error}")
        retry = n.params.get("retry", {})
        if not isinstance(retry, dict) or any(type(retry.get(k, 1)) is not int or retry.get(k, 1) < 0 for k in ("max_attempts", "backoff_ms")):
            say("param", f"{n.id}.retry")
        if n.params.get("join") is not None and n.params["join"] not in JOINS:
            say("join", f"{n.id}: {n.params['join']}")
    drawn: set[tuple] = set()
    for e in d.edges:
        name = f"{e.source}->{e.target}"
        if e.source not in kinds or e.target not in kinds:
            say("edge_end", name)
            continue
        if e.source == e.target:
            say("self_loop", name)
        if (e.source, e.target, e.port) in drawn:
            say("edge_twice", name)
        drawn.add((e.source, e.target, e.port))
        if kinds[e.source] in PURE + OUTSIDE and (e.port in PORTS) != (kinds[e.source] == "condition") or e.port is not None and e.port not in PORTS:
            say("port", f"{name}:{e.port}")
        if d.semantics == 1 and kinds[e.source] == "condition" and sum(o.source == e.source and o.target == e.target for o in d.edges) > 1:
            say("two_ports", name)
        if kinds[e.target] == "start":
            say("into_start", name)
        if kinds[e.source] == "end":
            say("out_of_end", name)
    try:
        tuple(TopologicalSorter({n.id: {e.source for e in d.into(n.id)} for n in d.nodes}).static_order())
    except CycleError as error:
        say("cycle", "->".join(error.args[1]))
    reached = {n.id for n in d.nodes if n.type == "start"}
    front = set(reached)
    while front:
        front = {e.target for e in d.edges if e.source in front} - reached
        reached |= front
    for n in d.nodes:
        if n.id not in reached:
            say("unreachable", n.id)
    for name in ("input_schema", "output_schema"):
        if getattr(d, name) is not None:
            try:
                check_schema(getattr(d, name))
            except ValueError as error:
                say(name, error)
    return out


#: What of a template's nodes and edges is kept (fixed values).
NODE_FIELDS, EDGE_FIELDS = ("id", "type", "name", "position", "params"), ("from", "to", "port")


def normalise_fragment(fragment: dict) -> dict:
    """A template's nodes and edges with the known fields only; an edge to a node outside, a node twice, or one without id or type is an error."""
    nodes = [{k: n[k] for k in NODE_FIELDS if n.get(k) is not None} for n in fragment.get("nodes", ())]
    edges = [{k: e[k] for k in EDGE_FIELDS if e.get(k) is not None} for e in fragment.get("edges", ())]
    if any(not isinstance(n.get(k), str) or not n[k] for n in nodes for k in ("id", "type")):
        raise ValueError("a fragment's nodes need an id and a type")
    names = [n["id"] for n in nodes]
    if len(set(names)) < len(names):
        raise ValueError("a fragment's nodes are named once")
    if any(e.get(k) not in names for e in edges for k in ("from", "to")):
        raise ValueError("a fragment's edges lead from and to its own nodes")
    return {"nodes": nodes, "edges": edges}
