"""Secret scanning: patterns for single secrets, and interval joins that link the parts of multipart credentials."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import text_or_empty

#: kind: (pattern, group whose length counts, least length, part). Base kinds first, in the order in which spans of one start are listed.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, "secret"),
    "access": (r"AKIA[A-Z0-9]+", 0, 16, "access"),
    "hex": (r"[0-9a-f]{32,}", 0, 32, "secret"),  # the runs of [0-9a-f]+ that have 32 characters
    "weak_access": (r"""(?<!(?i:secret)[_\x20-]?)(?i:access_?key(?:_?id)?|client_?id|account(?:_?name)?|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 1, 3, "access"),
    "weak_secret": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}+={0,2}+(?![A-Za-z0-9+/=_-])", 0, 32, "secret"),
    "endpoint": (r"""https?://[^\x20\x09-\x0D"'<>]+""", 0, 8, "endpoint"),
}
BASE = ("assign", "access", "hex")
#: Blank lines bound the scopes in which parts are linked.
BREAK = r"\n[\x20\x09\r]*\n"


def _matches(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """An array of (kind, nth, gap, size, good): characters since the match before, characters matched, whether long enough.

    Splitting at a pattern and extracting it see the same leftmost matches, so gaps and
    sizes in turn give every match its place.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    triples = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"), value.alias("value"))
    one = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(x["gap"]).alias("gap"), F.length(x["found"]).alias("size"), (F.length(x["value"]) >= least).alias("good"))
    none = F.array().cast("array<struct<kind:string,nth:int,gap:int,size:int,good:boolean>>")
    return F.when(text.rlike(pattern), F.transform(triples, one)).otherwise(none)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """One row per document: id, spans array<struct<start, rank, end, kind>> sorted by start, then kind.

    Base kinds stand alone. A part is a span of a base kind, or a weak candidate that overlaps
    no base span and, if a secret, no access part's value. Two parts are near within ``reach``
    characters of each other and in one scope (no blank line between). A weak secret is
    reported beside an access part, or an endpoint that doesn't overlap it; a weak access part
    or endpoint beside a secret that is of a base kind or reported itself. So no weak part is
    reported without its complement. The interval joins ask each candidate for the nearest end
    before and the nearest start after it of each part, so a scope's pairs are never listed.

    Places count code points, ends are exclusive. Nulls: a null text is empty, a null id is
    kept. Rows that repeat are reported one by one; an empty table gives no rows. A very long
    text is one task's sort of its matches. Other columns are ignored, whatever their names.
    """
    text = F.col("text")
    weak = F.concat(*[_matches(text, k, p, g, n) for k, (p, g, n, _) in KINDS.items()])
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    found = rows.select("row", "id", "text", weak.alias("found"))
    breaks = _matches(text, "break", BREAK, 0, 1)
    some = F.exists("found", lambda x: ~x["kind"].isin(*BASE))
    found = found.select("row", "id", F.inline_outer(F.when(some, F.concat("found", breaks)).otherwise(F.col("found"))))
    each = Window.partitionBy("row", "kind").orderBy("nth")
    placed = found.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(each)).withColumn("start", F.col("end") - F.col("size"))
    rank, part = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (kind, spec) in enumerate(KINDS.items()):
        rank, part = F.when(F.col("kind") == kind, i).otherwise(rank), F.when(F.col("kind") == kind, spec[3]).otherwise(part)
    placed = placed.filter("good or kind is null").withColumns({"rank": rank, "part": part, "base": F.col("kind").isin(*BASE)})
    placed = placed.withColumn("scope", F.count_if(F.col("kind") == "break").over(Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0)))
    scope = Window.partitionBy("row", "scope")
    before = scope.orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = scope.orderBy(F.desc("start"), F.desc("rank"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)  # backwards: a frame that ends at the last row costs its square
    at_most = lambda far: F.coalesce(far <= reach, F.lit(False))
    ended, begun = lambda c: F.max(F.when(c, F.col("end"))).over(before), lambda c: F.min(F.when(c, F.col("start"))).over(after)
    near = lambda c: at_most(F.col("start") - ended(c)) | at_most(begun(c) - F.col("end"))
    within = lambda c: F.coalesce(ended(c) > F.col("start"), F.lit(False)) | F.coalesce(begun(c) < F.col("end"), F.lit(False))
    placed = placed.withColumns({"taken": (F.col("kind") == "weak_secret") & within(F.col("kind") == "weak_access"), "covered": within(F.col("base"))})
    placed = placed.withColumn("part", F.when(F.col("base") | ~F.coalesce("taken", F.lit(False)) & ~F.col("covered"), F.col("part")))
    access, secret, endpoint = (F.coalesce(F.col("part") == p, F.lit(False)) for p in ("access", "secret", "endpoint"))
    # Endpoints don't overlap, so only the last that begins before a secret can reach into it, and only the first that begins later can begin within it.
    placed = placed.withColumns({"prior": F.when(endpoint, ended(endpoint)), "next": F.when(endpoint, begun(endpoint))})
    left = F.when(ended(endpoint) <= F.col("start"), ended(endpoint)).otherwise(F.max("prior").over(before))
    right = F.when(begun(endpoint) >= F.col("end"), begun(endpoint)).otherwise(F.min("next").over(after))
    endpoint_near = at_most(F.col("start") - left) | at_most(right - F.col("end"))
    placed = placed.withColumn("held", F.col("base") | secret & (near(access) | endpoint_near))
    placed = placed.withColumn("shown", F.col("held") | (access | endpoint) & near(secret & F.col("held")))
    span = F.when(F.col("shown") & (F.col("kind") != "break"), F.struct("start", "rank", "end", "kind"))
    return placed.groupBy("row").agg(F.first("id").alias(id_col), F.array_sort(F.collect_list(span)).alias("spans")).drop("row")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """Counts of the base kinds, the SHA-256 of the base spans' listing, and the listing of all spans, per document."""
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = secret_spans(docs, id_col, text_col, reach)
    return found.select(id_col, *[count(k) for k in BASE], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_linked"))
