"""Policies: capabilities matched to requests, layers, and what is granted within what."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import subtree_matches, url_prefix_matches


@dataclass(frozen=True)
class Capability:
    """What is allowed: an action, and by its kind what of it. ``ask`` needs a person's approval; an expired one counts for nothing."""

    id: str
    action: str
    ask: bool = False
    expires_at: str | None = None
    methods: tuple[str, ...] = ()
    url_prefix: str | None = None
    path: str | None = None
    subtree: str | None = None
    names: tuple[str, ...] = ()
    executable: str | None = None
    argv: tuple[str, ...] = ()
    anything: bool = False


@dataclass(frozen=True)
class Layer:
    """Capabilities of which any may match."""

    name: str
    capabilities: tuple[Capability, ...] = field(default=())


def matches(capability: Capability, request: dict[str, Column]) -> Column:
    """Whether a request's columns (action, and url, method, path, name, recipients, executable, argv as its kind has) fall under a capability."""
    same, no = request["action"] == capability.action, F.lit(False)
    if capability.anything:
        return same
    if capability.url_prefix is not None:
        found = F.upper(request["method"]).isin([m.upper() for m in capability.methods]) & url_prefix_matches(F.lit(capability.url_prefix), request["url"])
    elif capability.path is not None:
        found = subtree_matches(request["path"], exact=F.lit(capability.path))
    elif capability.subtree is not None:
        found = subtree_matches(request["path"], directory=F.lit(capability.subtree))
    elif capability.executable is not None:
        base = F.element_at(F.split(request["executable"], "/"), -1) if "/" not in capability.executable else request["executable"]
        found = (base == capability.executable) & request["argv"].eqNullSafe(F.lit(list(capability.argv)))
    elif "recipients" in request:
        found = F.forall(request["recipients"], lambda r: r.isin(*capability.names))
    elif "name" in request:
        found = request["name"].isin(*capability.names)
    else:
        found = no
    return F.coalesce(same & found, no)


def decide(request: dict[str, Column], layers: list[Layer], now: Column | None = None) -> Column:
    """allow, ask or deny: every layer must have a match; one that only asks makes the answer ask; no layer denies."""
    if not layers:
        return F.lit("deny")
    every, asked = F.lit(True), F.lit(False)
    for layer in layers:
        hits = []
        for c in layer.capabilities:
            live = F.lit(True) if c.expires_at is None or now is None else now < F.lit(c.expires_at).cast("timestamp")
            hits.append((c, live & matches(c, request)))
        any_hit = any_ask = F.lit(False)
        for c, hit in hits:
            any_hit = any_hit | hit
            any_ask = any_ask | (hit if c.ask else F.lit(False))
        every, asked = every & any_hit, asked | any_ask
    return F.when(~every, "deny").when(asked, "ask").otherwise("allow")


def covers(needed: Column, granted: Column) -> Column:
    """Whether a set of names is granted whole."""
    return F.size(F.array_except(needed, granted)) == 0


def effective(workflow: DataFrame, node: DataFrame) -> DataFrame:
    """A node's capabilities by action as they come out under its workflow's: auto, requires_approval or not_granted_by_workflow."""
    granted = workflow.groupBy("workflow_id", "action").agg(F.bool_or("ask").alias("_ask"))
    both = node.join(granted, ["workflow_id", "action"], "left")
    derived = F.when(F.col("_ask").isNull(), "not_granted_by_workflow").when(F.col("_ask") | F.col("ask"), "requires_approval").otherwise("auto")
    return both.withColumn("derived", derived).drop("_ask")


def pending_approvals(approvals: DataFrame, runs: DataFrame) -> DataFrame:
    """Pending approvals of runs that go on, the earliest deadline first, those without one last."""
    live = runs.filter(~F.col("status").isin("succeeded", "failed", "cancelled")).select("run_id")
    return approvals.filter(F.col("state") == "pending").join(live, "run_id", "left_semi").orderBy(F.asc_nulls_last("deadline"), "run_id")


#: A rule as a row: its layer and id, what it is about (family), and what of it; unused fields are null.
RULE = (
    "layer string, id string, action string, ask boolean, expires_at timestamp, family string, methods array<string>, url_prefix string, path string, subtree string, "
    "names array<string>, executable string, argv array<string>, script_digest string, providers array<string>, models array<string>"
)
#: A spec, one of the operations a request wants, as a row.
SPEC = (
    "request_id string, spec int, action string, mutating boolean, method string, url string, path string, name string, recipients array<string>, "
    "executable string, argv array<string>, script_digest string, provider string, model string"
)


def _within(values: Column, allowed: Column) -> Column:
    return F.size(F.array_except(values, allowed)) == 0


def _base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def rule_matches(rule: dict[str, Column], spec: dict[str, Column]) -> Column:
    """Whether a spec falls under a rule of its action, by the rule's family; an unknown family holds nothing."""
    r, s = rule, spec
    name_only = F.coalesce(~r["executable"].contains("/"), F.lit(False))
    families = {
        "any": F.lit(True),
        "secret": F.array_contains(r["names"], s["name"]), "setting": F.array_contains(r["names"], s["name"]),
        "exec": F.when(name_only, _base_name(s["executable"]) == r["executable"]).otherwise(s["executable"] == r["executable"]) & r["argv"].eqNullSafe(s["argv"]),
        "shell": (r["executable"].isNull() | (r["executable"] == s["executable"])) & (r["script_digest"] == s["script_digest"]),
        "file": F.when(r["path"].isNotNull(), subtree_matches(s["path"], exact=r["path"])).otherwise(subtree_matches(s["path"], directory=r["subtree"])),
        "net": F.exists(r["methods"], lambda m: F.upper(m) == F.upper(s["method"])) & url_prefix_matches(r["url_prefix"], s["url"]),
        "llm": F.array_contains(r["providers"], s["provider"]) & F.array_contains(r["models"], s["model"]),
        "email": _within(s["recipients"], r["names"]),
    }
    out = F.lit(False)
    for name, holds in families.items():
        out = F.when(r["family"] == name, holds).otherwise(out)
    return F.coalesce(out, F.lit(False))


def rule_covers(outer: dict[str, Column], inner: dict[str, Column]) -> Column:
    """Whether all that the inner rule allows is allowed by the outer one, family by family."""
    a, b = outer, inner
    families = {
        "secret": _within(b["names"], a["names"]), "setting": _within(b["names"], a["names"]), "email": _within(b["names"], a["names"]),
        "exec": a["argv"].eqNullSafe(b["argv"]) & ((a["executable"] == b["executable"]) | (~a["executable"].contains("/") & (_base_name(b["executable"]) == a["executable"]))),
        "shell": (a["executable"].isNull() | a["executable"].eqNullSafe(b["executable"])) & (a["script_digest"] == b["script_digest"]),
        "file": F.when(a["path"].isNotNull(), a["path"].eqNullSafe(b["path"])).otherwise(
            F.coalesce(b["path"], b["subtree"]).isNotNull() & ((a["subtree"] == "") | (F.coalesce(b["path"], b["subtree"]) == a["subtree"]) | F.startswith(F.coalesce(b["path"], b["subtree"]), F.concat(a["subtree"], F.lit("/"))))
        ),
        "net": _within(F.transform(b["methods"], F.upper), F.transform(a["methods"], F.upper)) & url_prefix_matches(a["url_prefix"], b["url_prefix"]),
        "llm": _within(b["providers"], a["providers"]) & _within(b["models"], a["models"]),
    }
    out = F.lit(False)
    for name, holds in families.items():
        out = F.when(a["family"] == name, holds).otherwise(out)
    held = (a["family"] == "any") | ((a["family"] == b["family"]) & out)
    return F.coalesce((a["action"] == b["action"]) & held, F.lit(False))


def check_requests(requests: DataFrame, specs: DataFrame, rules: DataFrame, layers: list[str], mode: str = "normal", legacy: bool = False, now: Column | None = None, approved: DataFrame | None = None) -> DataFrame:
    """request_id, decision (allow, ask, deny) and matched (layer:id, in order) of each request, its specs and the rules being tables.

    Bypass allows all. A request without specs is denied; so is one that changes anything in
    plan mode, and any of a legacy definition. Else every layer must have a live rule for every
    spec, ceilings of plugins and of ancestors being layers like others; a matched rule that
    asks makes it ask, unless the request's id is ``approved``. Specs meet the rules of their
    action only, and a request comes down to counts of (spec, layer) with a hit.
    """
    if mode == "bypass":
        return requests.select("request_id", F.lit("allow").alias("decision"), F.array(F.lit("workflow:bypass")).alias("matched"))
    r = rules.filter(F.col("layer").isin(*layers)).select(*[F.col(c).alias(f"r_{c}") for c in rules.columns])
    met = specs.join(r, specs["action"] == r["r_action"])
    live = F.lit(True) if now is None else F.col("r_expires_at").isNull() | (now < F.col("r_expires_at"))
    hits = met.filter(live & rule_matches({c: F.col(f"r_{c}") for c in rules.columns}, {c: F.col(c) for c in specs.columns}))
    found = hits.groupBy("request_id").agg(
        F.count_distinct("spec", "r_layer").alias("_pairs"), F.bool_or("r_ask").alias("_ask"), F.array_sort(F.collect_set(F.concat_ws(":", "r_layer", "r_id"))).alias("matched"),
    )
    wanted = specs.groupBy("request_id").agg(F.count_distinct("spec").alias("_specs"), F.bool_or("mutating").alias("_mutating"))
    out = requests.select("request_id").join(wanted, "request_id", "left").join(found, "request_id", "left")
    ask = F.coalesce("_ask", F.lit(False))
    if approved is not None:
        out = out.join(approved.select("request_id", F.lit(True).alias("_approved")), "request_id", "left")
        ask = ask & F.col("_approved").isNull()
    denied = F.col("_specs").isNull() | F.lit(legacy) | (F.lit(mode == "plan") & F.coalesce("_mutating", F.lit(False))) | (F.coalesce("_pairs", F.lit(0)) < F.col("_specs") * len(layers))
    none = F.array().cast("array<string>")
    return out.select("request_id", F.when(denied, "deny").when(ask, "ask").otherwise("allow").alias("decision"), F.coalesce("matched", none).alias("matched"))


def uncovered_needs(needs: DataFrame, rules: DataFrame, layers: list[str]) -> DataFrame:
    """(plugin_id, id, layer): a plugin's needs that no rule of a layer covers; none where all its needs may be granted."""
    r = rules.filter(F.col("layer").isin(*layers)).select(*[F.col(c).alias(f"r_{c}") for c in rules.columns])
    columns = [c for c in rules.columns if c not in ("layer", "id")]
    met = needs.join(r, needs["action"] == r["r_action"]).filter(rule_covers({c: F.col(f"r_{c}") for c in columns}, {c: F.col(c) for c in columns}))
    every = needs.select("plugin_id", "id", F.explode(F.array(*[F.lit(x) for x in layers])).alias("layer"))
    return every.join(met.select("plugin_id", "id", F.col("r_layer").alias("layer")).distinct(), ["plugin_id", "id", "layer"], "left_anti")


def freeze_ceilings(rules: DataFrame, parents: DataFrame) -> DataFrame:
    """(run_id, layer, rule columns): each run's own rules and, as layers of their own, those of its ancestors (run_id, ancestor, depth), all of which must agree."""
    own = rules.withColumn("layer", F.lit("own"))
    above = parents.join(rules.withColumnRenamed("run_id", "ancestor"), "ancestor").withColumn("layer", F.concat(F.lit("ceiling:"), F.col("depth").cast("string")))
    return own.unionByName(above.select(*own.columns))


def start_refusals(nodes: DataFrame, permissions: DataFrame, granted: DataFrame, outside: tuple[str, ...]) -> DataFrame:
    """(workflow_id, node_id, reason) of nodes for which a run may not start; a workflow without rows may.

    ``permissions`` has workflow_id and mode. Without a row there, nodes that act on the
    outside, plugins among them, are refused; bypass lets all pass; else a plugin's node
    (plugin_id not null) needs a grant (plugin_id).
    """
    known = nodes.join(permissions.select("workflow_id", "mode"), "workflow_id", "left").join(granted.select("plugin_id", F.lit(True).alias("_granted")).distinct(), "plugin_id", "left")
    acts = F.col("type").isin(*outside) | F.col("plugin_id").isNotNull()
    reason = F.when(F.col("mode").isNull(), F.when(acts, "no permissions")).when(F.col("mode") != "bypass", F.when(F.col("plugin_id").isNotNull() & F.col("_granted").isNull(), "plugin not granted"))
    return known.withColumn("reason", reason).filter("reason is not null").select("workflow_id", "node_id", "reason")
