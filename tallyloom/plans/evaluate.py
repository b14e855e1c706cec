"""Evaluating a definition over many runs at once: a run is a row, a node a few columns."""

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.contracts import violation
from tallyloom.functions.values import json_or_text, template, truthy
from tallyloom.plans.definition import CHILD_DEPTH, OUTSIDE, RETRY_MOST, Definition, Node, problems
from tallyloom.plans.gates import FAILED, READY, SUCCEEDED, WAITING, State, active, every, reason_of, selected, status_of

#: A plugin's node: from the node's parameters and its active predecessors' outputs (JSON text) to output (JSON text) and error (null if none).
Plugin = Callable[[dict, dict[str, Column]], tuple[Column, Column]]


def json_of(value: Column) -> Column:
    """A value as JSON text."""
    text = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(text, F.lit(6), F.length(text) - 6)


def _text_of(state: State) -> Column:
    """A node's output as JSON text."""
    return state.output if state.is_json else json_of(state.output)


def _joined(items: list[tuple[str, Column | bool, Column]]) -> Column:
    """(name, counted, JSON text) joined: none is null, one is itself, more are an object with names in order."""
    items = [x for x in sorted(items, key=lambda x: x[0]) if x[1] is not False]
    if not items:
        return F.lit(None).cast("string")
    texts = [F.coalesce(text, F.lit("null")) for _, _, text in items]
    if len(items) == 1:
        return texts[0] if items[0][1] is True else F.when(items[0][1], texts[0])
    named = [F.concat(json_of(F.lit(name)), F.lit(":"), text) for (name, _, _), text in zip(items, texts, strict=True)]
    if all(there is True for _, there, _ in items):
        return F.concat(F.lit("{"), F.concat_ws(",", *named), F.lit("}"))
    number = sum((F.lit(1) if there is True else there.cast("int") for _, there, _ in items), F.lit(0))
    shown = F.concat_ws(",", *[x if there is True else F.when(there, x) for x, (_, there, _) in zip(named, items, strict=True)])
    alone = F.coalesce(*[F.when(F.lit(True) if there is True else there, text) for text, (_, there, _) in zip(texts, items, strict=True)])
    return F.when(number == 1, alone).when(number > 1, F.concat(F.lit("{"), shown, F.lit("}")))


def run_batch(
    definition: Definition, runs: DataFrame, children: Mapping[str, Definition] | None = None, now_ms: int = 0, prefix: str = "node_", depth: int = 0, plugins: Mapping[str, Plugin] | None = None,
) -> DataFrame:
    """``runs`` with a struct column for each node, and run_status, run_output (JSON text) and run_error.

    Columns of ``runs``: input (a struct); started_ms where delays wait; signals, recorded and
    statuses (maps from node id to JSON text, or a number) where people and the outside world
    answer; attempts (a map from node id to attempts made) where nodes retry. Scripts and
    conditions are SQL over ``input.x`` and ``nodes.y``, y being direct predecessors; a script's
    ``fails`` is SQL for an error's message, null where it succeeds. Outputs of scripts are
    values of SQL types; those of other nodes JSON text.

    A node's state is one small number. A level of the graph is one projection, and what is
    the same in every run is no column at all, so graphs of pure nodes are short plans.
    """
    if broken := problems(definition, frozenset(plugins or ())):
        raise ValueError(f"the definition breaks {broken}")
    if depth > CHILD_DEPTH:
        raise ValueError("sub-workflows nest too deep")
    given, state = F.col("input"), {}
    for level in definition.levels():
        columns = {}
        for node in level:
            name = f"{prefix}{node.id}"
            if node.type == "sub_workflow":
                runs = _with_child(definition, node, runs, children or {}, now_ms, name, state, depth, plugins)
            edges = definition.into(node.id)
            mode = node.params.get("join") or ("selected" if definition.semantics >= 2 else "all")
            gate = (selected if mode == "selected" else every)(edges, state)
            done = _outcome(node, runs, given, {e.source: (state[e.source], active(e, state[e.source])) for e in edges}, now_ms, name, prefix, plugins or {})
            code = done.code if isinstance(gate, int) else F.when(gate == READY, F.lit(done.code) if isinstance(done.code, int) else done.code).otherwise(gate)
            fields = {"code": code, "branch": done.branch, "output": done.output, "error": done.error}
            if not (isinstance(code, int) and code == SUCCEEDED):
                ran = F.col(f"`{name}__code`")
                fields |= {"output": F.when(ran == SUCCEEDED, done.output), "branch": None if done.branch is None else F.when(ran == SUCCEEDED, done.branch), "error": None if done.error is None else F.when(ran == FAILED, done.error)}
            columns[node.id] = fields, done.is_json
        codes = {f"{prefix}{i}__code": f["code"] for i, (f, _) in columns.items() if isinstance(f["code"], Column)}
        rest = {f"{prefix}{i}__{k}": f[k] for i, (f, _) in columns.items() for k in ("branch", "output", "error") if f[k] is not None}
        runs = (runs.withColumns(codes) if codes else runs).withColumns(rest)
        held = lambda i, k: F.col(f"`{prefix}{i}__{k}`")
        state |= {
            i: State(f["code"] if isinstance(f["code"], int) else held(i, "code"), None if f["branch"] is None else held(i, "branch"), held(i, "output"), None if f["error"] is None else held(i, "error"), is_json)
            for i, (f, is_json) in columns.items()
        }
    runs = _settled(definition, runs, state)
    none = lambda kind: F.lit(None).cast(kind)
    nodes = {
        f"{prefix}{i}": F.struct(
            status_of(s.code).alias("status"), reason_of(s.code).alias("skip_reason"), (none("boolean") if s.branch is None else s.branch).alias("branch"),
            s.output.alias("output"), (none("string") if s.error is None else s.error).alias("error"),
        ) for i, s in state.items()
    }
    return runs.withColumns(nodes).drop(*[f"{name}__{k}" for name in nodes for k in ("code", "branch", "output", "error", "run")])


def _sql(text: str, node: Node, predecessors: Mapping[str, object], prefix: str) -> Column:
    def of(m: re.Match) -> str:
        if m[1] not in predecessors:
            raise ValueError(f"{node.id} reads {m[1]}, which is no direct predecessor")
        return f"`{prefix}{m[1]}__output`"

    return F.expr(re.sub(r"\bnodes\.(\w+)", of, text))


def _type(runs: DataFrame, value: Column) -> str:
    return runs.select(value.alias("v")).schema["v"].dataType.simpleString()


def _failing(node: Node, runs: DataFrame, error: Column, name: str) -> Column:
    """The number of a node that may fail: waiting for its next attempt while it has any, else failed."""
    most = min(RETRY_MOST, node.params.get("retry", {}).get("max_attempts", 1))
    if most <= 1 or "attempts" not in runs.columns:
        return F.when(error.isNull(), SUCCEEDED).otherwise(FAILED)
    made = F.coalesce(F.try_element_at("attempts", F.lit(node.id)), F.lit(1))
    return F.when(error.isNull(), SUCCEEDED).when(made < most, WAITING).otherwise(FAILED)


def _outcome(node: Node, runs: DataFrame, given: Column, before: dict[str, tuple[State, Column | bool]], now_ms: int, name: str, prefix: str, plugins: Mapping[str, Plugin]) -> State:
    """What a node comes to where its gate is open."""
    p, kind = node.params, node.type
    if kind == "start":
        return State(SUCCEEDED, None, json_of(given), None, True)
    if kind == "end":
        return State(SUCCEEDED, None, _joined([(i, on, _text_of(s)) for i, (s, on) in before.items()]), None, True)
    if kind == "condition":
        value = _sql(p["expr"], node, before, prefix)
        return State(SUCCEEDED, truthy(value, _type(runs, value)), value, None, False)
    if kind == "script":
        value, passed_on = _sql(p["code"], node, before, prefix), re.fullmatch(r"\s*nodes\.(\w+)\s*", p["code"])
        is_json = bool(passed_on) and before[passed_on[1]][0].is_json
        if "fails" not in p:
            return State(SUCCEEDED, None, value, None, is_json)
        error = _sql(p["fails"], node, before, prefix).cast("string")
        return State(_failing(node, runs, error, name), None, value, error, is_json)
    if kind == "delay":
        ms = F.lit(p["ms"]) if isinstance(p["ms"], int) else template(p["ms"], {f"input.{c}": given[c] for c in runs.select(given.alias("i")).schema["i"].dataType.names}).cast("long")
        return State(F.when(F.col("started_ms") + ms <= now_ms, SUCCEEDED).otherwise(WAITING), None, F.to_json(F.struct(ms.cast("long").alias("slept_ms"))), None, True)
    if kind == "human_task":
        answer = F.try_element_at("signals", F.lit(node.id))
        return State(F.when(answer.isNotNull(), SUCCEEDED).otherwise(WAITING), None, _as_json(answer), None, True)
    if kind == "input":
        types = {f.name: f.dataType for f in runs.select(given.alias("i")).schema["i"].dataType}
        held = [(f["key"], given[f["key"]] if f["key"] in types else F.lit(None), f.get("default")) for f in p["fields"]]
        missing = [value.isNull() for _, value, default in held if default is None]
        texts = [F.concat(json_of(F.lit(key)), F.lit(":"), json_of(value) if default is None else F.when(value.isNotNull(), json_of(value)).otherwise(json_of(F.lit(default)))) for key, value, default in held]
        output = F.concat(F.lit("{"), F.concat_ws(",", *texts), F.lit("}"))
        some = missing[0] if missing else None
        for more in missing[1:]:
            some = some | more
        return State(SUCCEEDED if some is None else F.when(some, WAITING).otherwise(SUCCEEDED), None, output, None, True)
    if kind == "sub_workflow":
        child = F.col(f"`{name}__run`")
        return State(F.when(child["status"] == "succeeded", SUCCEEDED).when(child["status"] == "failed", FAILED).otherwise(WAITING), None, child["output"], child["error"], True)
    if kind in OUTSIDE:
        output, error, unknown = _played(node, runs)
        if p.get("effect_policy") == "repeatable":
            return State(F.when(unknown, _failing(node, runs, error, name)).when(error.isNull(), SUCCEEDED).otherwise(FAILED), None, output, error, True)
        return State(F.when(error.isNull(), SUCCEEDED).otherwise(FAILED), None, output, error, True)
    if kind in plugins:
        output, error = plugins[kind](p, {i: F.when(F.lit(True) if on is True else on, _text_of(s)) for i, (s, on) in before.items()})
        return State(F.when(error.isNull(), SUCCEEDED).otherwise(FAILED), None, output, error, True)
    raise ValueError(f"no evaluation of {kind}")


def _as_json(body: Column) -> Column:
    """JSON text as it is written canonically; other text as a JSON string."""
    shape, text = json_or_text(body)
    return F.when(shape == "json", text).otherwise(json_of(body))


def _played(node: Node, runs: DataFrame) -> tuple[Column, Column, Column]:
    """Output, error and whether no outcome is known, of a node that acts on the outside, from what was recorded.

    A status of 400 or more, or an exit code but 0, is a failure. Where ``runs`` has statuses,
    a call's output is an object of status, headers (from reply_headers, a map to JSON
    objects) and body; else it is the body. A command's reply is an
    object of exit_code, stdout and stderr, to which what stdout holds is added as result if
    it is an object or array. A sent mail gives status and id. A model's reply must be JSON
    that keeps the node's response_schema.
    """
    reply = F.try_element_at("recorded", F.lit(node.id))
    status = F.coalesce(F.try_element_at("statuses", F.lit(node.id)).cast("int"), F.lit(200)) if "statuses" in runs.columns else F.lit(200)
    parsed = F.try_parse_json(reply)
    unknown = reply.isNull()
    refused = F.when(unknown, "no recorded outcome").when(status >= 400, F.concat(F.lit("HTTP status "), status.cast("string")))

    def shaped(body: Column) -> Column:
        if "statuses" not in runs.columns:
            return body
        headers = F.try_element_at("reply_headers", F.lit(node.id)) if "reply_headers" in runs.columns else F.lit("{}")
        return F.concat(F.lit('{"status":'), status.cast("string"), F.lit(',"headers":'), F.coalesce(headers, F.lit("{}")), F.lit(',"body":'), body, F.lit("}"))

    if node.type == "harness":
        field = lambda name: F.get_json_object(reply, f"$.{name}")
        code = F.coalesce(field("exit_code").try_cast("int"), F.lit(0))
        result = F.try_parse_json(F.trim(field("stdout")))
        whole = F.schema_of_variant(result).rlike("^(OBJECT|ARRAY)")
        parts = [F.concat(F.lit('"exit_code":'), code.cast("string")), F.concat(F.lit('"stdout":'), json_of(field("stdout"))), F.concat(F.lit('"stderr":'), json_of(field("stderr"))), F.when(whole, F.concat(F.lit('"result":'), F.to_json(result)))]
        error = F.when(unknown, "no recorded outcome").when(code != 0, F.concat(F.lit("exit code "), code.cast("string")))
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), error, unknown
    if node.type == "email":
        error = F.coalesce(refused, F.when(parsed.isNull(), "the reply is no JSON"))
        name = F.coalesce(F.to_json(F.try_variant_get(parsed, "$.id", "variant")), F.lit("null"))
        return F.concat(F.lit('{"status":'), status.cast("string"), F.lit(',"id":'), name, F.lit("}")), error, unknown
    if node.type == "llm":
        error = F.coalesce(refused, F.when(parsed.isNull(), "the reply is no JSON"))
        if node.params.get("response_schema") is not None:
            error = F.coalesce(error, F.concat(F.lit("response contract: "), violation(node.params["response_schema"], parsed)))
        return shaped(F.to_json(parsed)), error, unknown
    return shaped(_as_json(reply)), refused, unknown


def _with_child(definition: Definition, node: Node, runs: DataFrame, children: Mapping[str, Definition], now_ms: int, name: str, state: dict[str, State], depth: int, plugins: Mapping[str, Plugin] | None) -> DataFrame:
    """The child's run evaluated in place, on the mapped input or else the parent's."""
    child, mapping, inner = children[node.params["workflow_id"]], node.params.get("input_mapping"), F.col("input")
    if mapping:
        before = {e.source: state[e.source] for e in definition.into(node.id)}
        inner = F.struct(*[_sql(v, node, before, name[: -len(node.id)]).alias(k) for k, v in mapping.items()])
    outer = [c for c in runs.columns if c not in ("input", "run_status", "run_output", "run_error")]
    inside = run_batch(child, runs.withColumns({f"{name}__outer": F.col("input"), "input": inner}), children, now_ms, f"{name}__", depth + 1, plugins)
    result = F.struct(F.col("run_status").alias("status"), F.col("run_output").alias("output"), F.col("run_error").alias("error")).alias(f"{name}__run")
    return inside.select(*[F.col(f"`{c}`") for c in outer], F.col(f"`{name}__outer`").alias("input"), result)


def _settled(definition: Definition, runs: DataFrame, state: dict[str, State]) -> DataFrame:
    """The run's state: open while any node is; else the first failed node in definition order fails it, else its ends make its output."""
    varied = [n for n in definition.nodes if not isinstance(state[n.id].code, int)]
    least = F.least(*[state[n.id].code for n in varied]) if len(varied) > 1 else state[varied[0].id].code if varied else F.lit(SUCCEEDED)
    failures = [F.when(state[n.id].code == FAILED, F.coalesce(state[n.id].error, F.lit(f"{n.id} failed"))) for n in varied if state[n.id].error is not None]
    ends = [n for n in definition.nodes if n.type == "end"]
    there = lambda n: True if definition.semantics == 1 or isinstance(state[n.id].code, int) else state[n.id].code == SUCCEEDED
    if definition.semantics >= 2 and all(n in varied for n in ends):
        any_end = there(ends[0])
        for n in ends[1:]:
            any_end = any_end | there(n)
        failures.append(F.when(~any_end, "no active end node completed"))
    output = _joined([(n.id, there(n), state[n.id].output) for n in ends])
    if definition.output_schema is not None:
        failures.append(F.concat(F.lit("output contract: "), violation(definition.output_schema, F.try_parse_json(F.coalesce(output, F.lit("null"))))))
    error = F.when(least >= SUCCEEDED, F.coalesce(*failures)) if failures else F.lit(None).cast("string")
    if definition.input_schema is not None:
        error = F.coalesce(F.concat(F.lit("input contract: "), violation(definition.input_schema, F.try_parse_json(json_of(F.col("input"))))), error)
    runs = runs.withColumns({"run_error": error, "_open": least < SUCCEEDED})
    status = F.when(F.col("run_error").isNotNull(), "failed").when(F.col("_open"), "running").otherwise("succeeded")
    runs = runs.withColumn("run_status", status)
    return runs.withColumn("run_output", F.when(F.col("run_status") == "succeeded", output)).drop("_open")
