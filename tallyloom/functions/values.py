"""Dynamic values: truth, templates, canonical text, digests, recorded clocks."""

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(value: Column, kind: str) -> Column:
    """The truth of a value of a Spark type's simple name: null, false, 0, NaN and '' are false, arrays and objects true."""
    if kind == "boolean":
        out = value
    elif kind == "string":
        out = value != ""
    elif kind in ("double", "float"):
        out = (value != 0) & ~F.isnan(value)
    elif kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        out = value != 0
    else:
        out = value.isNotNull()
    return F.coalesce(out, F.lit(False))


def truthy_variant(value: Column) -> Column:
    """The truth of a VARIANT, by the type it holds."""
    kind = F.schema_of_variant(value)
    scalar = lambda t: F.try_variant_get(value, "$", t)
    out = F.when(F.is_variant_null(value), False).when(kind == "BOOLEAN", scalar("boolean")).when(kind == "STRING", scalar("string") != "")
    out = out.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), scalar("double") != 0)
    return F.coalesce(out.otherwise(value.isNotNull()), F.lit(False))


def template(text: str, columns: Mapping[str, Column]) -> Column:
    """A ``${name}`` template over columns: alone it keeps the column's type, within text it is written into it, null as 'null'.

    Within text a string is written as it is, a number as its digits, and an array, map or
    struct as JSON. A name without a column is null; a brace cannot be part of a name.
    """
    whole = re.fullmatch(r"\$\{([^}]*)\}", text)
    if whole:
        return columns.get(whole[1].strip(), F.lit(None))
    parts = re.split(r"\$\{([^}]*)\}", text)
    shown = [F.lit(x) if i % 2 == 0 else F.coalesce(_shown(columns.get(x.strip(), F.lit(None))), F.lit("null")) for i, x in enumerate(parts)]
    return F.concat(*shown)


def _shown(value: Column) -> Column:
    """A value within text: numbers, strings and truth values as they are, all else as JSON."""
    nested = F.typeof(value).rlike("^(array|map|struct|variant)")
    json = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.when(value.isNotNull(), F.when(nested, F.substr(json, F.lit(6), F.length(json) - 6)).otherwise(value.cast("string")))


def template_tree(value, columns: Mapping[str, Column], opaque: tuple[str, ...] = ()) -> Column:
    """A parameter tree with all templates within filled in, objects as structs and arrays as arrays of JSON text; ``opaque`` names are left as they are."""
    if isinstance(value, str):
        return template(value, columns)
    if isinstance(value, dict):
        return F.struct(*[(F.lit(x) if k in opaque and isinstance(x, str) else template_tree(x, columns, opaque)).alias(k) for k, x in value.items()])
    if isinstance(value, list):
        return F.array(*[F.coalesce(_shown(template_tree(x, columns, opaque)), F.lit("null")) for x in value])
    return F.lit(value)


def node_key_path(*parts: Column) -> Column:
    """A node's key within nested runs: the nodes of the sub-workflows on the way and itself, as a JSON array."""
    return F.to_json(F.array(*[p.cast("string") for p in parts]))


def config_patch(document: Column, patch: Column) -> Column:
    """A document (a map) with the patch's keys in their new values."""
    return F.map_concat(F.map_filter(document, lambda k, v: ~F.map_contains_key(patch, k)), patch)


def xorshift32(seed: Column, draws: int) -> Column:
    """The first ``draws`` numbers in [0, 1) of the 32-bit xorshift generator from a seed; a zero seed counts as 1."""
    word = F.lit(0xFFFFFFFF)

    def step(state: Column, _: Column) -> Column:
        x = F.element_at(state, -1)
        x = x.bitwiseXOR(F.shiftleft(x, 13).bitwiseAND(word))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 17))
        return F.array_append(state, x.bitwiseXOR(F.shiftleft(x, 5).bitwiseAND(word)))

    first = F.when(seed.cast("long").bitwiseAND(word) == 0, F.lit(1).cast("long")).otherwise(seed.cast("long").bitwiseAND(word))
    states = F.aggregate(F.sequence(F.lit(1), F.lit(draws)), F.array(first), step)
    return F.transform(F.slice(states, 2, draws), lambda x: x / float(1 << 32))




def json_or_text(body: Column) -> tuple[Column, Column]:
    """A response body as (kind, canonical text): 'json' where it parses, else 'text' and the body itself."""
    parsed = F.try_parse_json(body)
    return F.when(parsed.isNotNull(), "json").otherwise("text"), F.when(parsed.isNotNull(), F.to_json(parsed)).otherwise(body)


def canonical_map(values: Column) -> Column:
    """A map as JSON text with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def canonical_json(text: Column) -> Column:
    """JSON text with the keys of every object in order, at any depth, and no white space; null where it is no JSON.

    A VARIANT holds its objects' keys in order, so parsing and writing is all it takes.
    """
    return F.to_json(F.try_parse_json(text))


def fingerprint(values: Column) -> Column:
    """The SHA-256 of a map's canonical text."""
    return F.sha2(canonical_map(values), 256)


def chain_digest(previous: Column, digest: Column) -> Column:
    return F.sha2(F.concat(previous, digest), 256)


def entity_digest(*parts: Column) -> Column:
    """The SHA-256 of parts, each after its length in bytes as eight bytes, least significant first."""
    size = lambda p: F.unhex(F.concat(*[F.lpad(F.hex(F.pmod(F.shiftright(F.octet_length(p).cast("bigint"), 8 * k), F.lit(256))), 2, "0") for k in range(8)]))
    return F.sha2(F.concat(*[x for p in parts for x in (size(p), F.encode(p, "UTF-8"))]), 256)


def u64(text: Column) -> Column:
    """A counter's canonical decimal text as DECIMAL(20,0); null if it isn't canonical or exceeds 64 bits."""
    value = F.when(text.rlike("^(0|[1-9][0-9]{0,19})$"), text.try_cast("decimal(20,0)"))
    return F.when(value <= F.lit("18446744073709551615").cast("decimal(20,0)"), value)


def instant_key(text: Column) -> Column:
    """RFC 3339 text as UTC text with nine fractional digits, so that text order is time order; '' where it can't be read."""
    parts = r"^(\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?([Zz]|[+-]\d{2}:\d{2})$"
    whole = F.concat(F.regexp_extract(text, parts, 1), F.upper(F.regexp_extract(text, parts, 3)))
    second = F.try_to_timestamp(whole)
    utc = F.date_format(F.to_utc_timestamp(second, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    nanos = F.rpad(F.regexp_extract(text, parts, 2), 9, "0")
    return F.coalesce(F.when(text.rlike(parts), F.concat(utc, F.lit("."), nanos, F.lit("Z"))), F.lit(""))


def finite_number(value: Column) -> Column:
    """A double as a script returns it: NaN and infinities are null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
