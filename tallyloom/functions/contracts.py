"""Contracts on JSON values: a closed subset of JSON Schema compiled to one column, the first violation."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keywords of the subset (fixed values).
KEYWORDS = frozenset("type properties required additionalProperties items enum minLength maxLength minimum maximum minItems maxItems title description default".split())
KINDS = {
    "object": "^OBJECT", "array": "^ARRAY", "string": "^STRING", "boolean": "^BOOLEAN", "null": "^VOID",
    "integer": r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\(\d+,0\))", "number": "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|DOUBLE|FLOAT)",
}
MOST_DEEP = 32


#: Reasons that a violation gives (fixed values: callers match on them).
REFUSED, NO_TYPE, NOT_ONE_OF, MISSING, OUTSIDE = "value rejected by schema", "expected {}", "value is outside enum", "required property missing", "number outside bounds"
#: Levels that a value may nest.
VALUE_DEPTH = 64


def check_schema(schema: dict, depth: int = 0) -> None:
    """Raise ValueError for a keyword outside the subset, one of the wrong shape, an unknown type, or nesting beyond 32."""

    def must(holds: bool, what: str) -> None:
        if not holds:
            raise ValueError(f"bad schema: {what}")

    must(depth <= MOST_DEEP, f"more than {MOST_DEEP} levels")
    if isinstance(schema, bool):
        return
    must(isinstance(schema, dict), "neither an object nor true or false")
    must(set(schema) <= KEYWORDS, f"keywords outside the subset, {sorted(set(schema) - KEYWORDS)}")
    must(schema.get("type", "object") in KINDS if isinstance(schema.get("type", ""), str) else False, f"type {schema.get('type')!r}")
    must(isinstance(schema.get("properties", {}), dict), "properties")
    required, options = schema.get("required", []), schema.get("enum", [None])
    must(isinstance(required, list) and all(isinstance(x, str) for x in required), "required is a list of names")
    must(isinstance(options, list) and bool(options), "enum is a list of one value or more")
    for name in ("minLength", "maxLength", "minItems", "maxItems"):
        must(type(schema.get(name, 0)) is int and schema.get(name, 0) >= 0, f"{name} is a whole number from 0 on")
    for name in ("minimum", "maximum"):
        must(type(schema.get(name, 0)) in (int, float), f"{name} is a number")
    for inner in [*schema.get("properties", {}).values(), schema.get("items", True), schema.get("additionalProperties", True)]:
        check_schema(inner, depth + 1)


def too_deep(json_text: Column, most: int = VALUE_DEPTH) -> Column:
    """Whether JSON text nests more than ``most`` levels: the largest running count of brackets outside strings."""
    bare = F.regexp_replace(F.regexp_replace(json_text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', ""), r"[^\[\]{}]+", "")
    step = lambda state, c: F.struct(
        (state["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(state["most"], state["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most")
    )
    deepest = F.aggregate(F.split(bare, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda state, c: F.when(c == "", state).otherwise(step(state, c)), lambda state: state["most"])
    return F.coalesce(F.when(F.length(bare) > 2 * most, deepest > most), F.lit(False))


def _number(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "decimal(38,10)"), F.try_variant_get(value, "$", "double").try_cast("decimal(38,10)"))


def violation(schema: dict, value: Column) -> Column:
    """'path: reason' of the first rule that a VARIANT breaks, null if it keeps all; a SQL null is a missing value.

    Numbers are compared as decimals, never through doubles where they are integers. A
    property is present if its key is, whatever its value; ``default`` fills nothing.
    """
    check_schema(schema)
    return F.coalesce(*_rules(schema, value, F.lit("$"), 0), F.lit(None).cast("string"))


def _rules(schema: dict | bool, value: Column, path: Column, depth: int) -> list[Column]:
    say = lambda broken, reason, at=path: F.when(broken, F.concat(at, F.lit(f": {reason}")))
    if schema is False:
        return [say(value.isNotNull(), REFUSED)]
    if schema is True:
        return []
    kind, rules = F.schema_of_variant(value), []
    is_a = lambda name: F.coalesce(kind.rlike(KINDS[name]), F.lit(False))
    if "type" in schema:
        rules.append(say(~is_a(schema["type"]), NO_TYPE.format(schema["type"])))
    if "enum" in schema:
        wanted = [F.lit(_literal(x)) for x in schema["enum"]]
        rules.append(say(~F.coalesce(F.to_json(value).isin(wanted), F.lit(False)), NOT_ONE_OF))
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    for key in schema.get("required", ()):
        rules.append(F.when(is_a("object") & ~F.coalesce(F.map_contains_key(fields, F.lit(key)), F.lit(False)), F.concat(path, F.lit(f".{key}: {MISSING}"))))
    known = schema.get("properties", {})
    for key in sorted(known):
        inner = F.try_element_at(fields, F.lit(key))
        broken = F.coalesce(*_rules(known[key], inner, F.concat(path, F.lit(f".{key}")), depth + 1), F.lit(None).cast("string"))
        rules.append(F.when(is_a("object") & F.map_contains_key(fields, F.lit(key)), broken))
    extra = schema.get("additionalProperties", True)
    if extra is not True:
        others = F.array_sort(F.map_keys(F.map_filter(fields, lambda k, v: ~k.isin(*known) if known else F.lit(True))))
        broken = F.filter(F.transform(others, lambda k: F.coalesce(*_rules(extra, F.element_at(fields, k), F.concat(path, F.lit("."), k), depth + 1), F.lit(None).cast("string"))), lambda x: x.isNotNull())
        rules.append(F.when(is_a("object"), F.get(broken, F.lit(0))))
    items = F.try_variant_get(value, "$", "array<variant>")
    rules += _bounds(schema, F.size(items), is_a("array"), "minItems", "maxItems", say)
    if schema.get("items", True) is not True:
        broken = F.filter(F.transform(items, lambda x, i: F.coalesce(*_rules(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), depth + 1), F.lit(None).cast("string"))), lambda x: x.isNotNull())
        rules.append(F.when(is_a("array"), F.get(broken, F.lit(0))))
    rules += _bounds(schema, F.length(F.try_variant_get(value, "$", "string")), is_a("string"), "minLength", "maxLength", say)
    for bound, outside in (("minimum", lambda v, b: v < b), ("maximum", lambda v, b: v > b)):
        if bound in schema:
            rules.append(say(is_a("number") & outside(_number(value), F.lit(Decimal(str(schema[bound]))).cast("decimal(38,10)")), OUTSIDE))
    return rules


def _bounds(schema: dict, size: Column, applies: Column, low: str, high: str, say) -> list[Column]:
    out = [say(applies & (size < schema[low]), f"fewer than {low}")] if low in schema else []
    return out + ([say(applies & (size > schema[high]), f"more than {high}")] if high in schema else [])


def _literal(value) -> str:
    import json

    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)
