"""Exact Jaccard self-join of word n-gram sets, with index lists skipped by position and answers derived from similar sets'."""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyloom.llm.common import forget, if_small, is_small, keep, shingle_set, small_batches
from tallyloom.llm.components import components

#: A shingle in more sets than this comes last in the order of shingles, so that prefixes avoid it.
FREQUENT = 32
#: Bits of the filter that names frequent shingles: 4 MB, whatever the corpus.
FILTER_BITS = 1 << 25
#: Longs that a set's parity map has at least; larger sets have a bit a shingle or more.
PARITY_LONGS = 8
#: A verifying task holds two blocks of at most about so many sets, and shingles, each.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20
#: A list of frequent shingles' sets is joined in so many parts, so that none is one task's.
LIST_PARTS = 32


def _prefix(n: int, percent: int) -> int:
    """Shingles of which a set similar to this one must share at least one, in any fixed order."""
    return n - -(-percent * n // 100) + 1


def _index_prefix(n: int, percent: int) -> int:
    """The same where the other set is at least as large: further positions of two such sets need not meet."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(np.concatenate(values)) if values else np.zeros(0, np.int64)))


def _parity(shingles: np.ndarray) -> np.ndarray:
    """Bit b tells whether an odd number of shingles have the hash b modulo the map's bits, a power of two."""
    longs = max(PARITY_LONGS, 1 << (-(-len(shingles) // 64) - 1).bit_length()) if len(shingles) else PARITY_LONGS
    odd = np.bincount((shingles % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sizes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n (shingles), digest of the set, and the pool: its smallest hashes, in which frequent shingles are counted."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            pools = [s[: 3 * _prefix(len(s), percent) // 2 + 8] if len(s) else s for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), _lists(pools)], ["doc_id", "n", "digest", "pool"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("pool", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(step, schema)


def _frequent(sizes: DataFrame) -> bytes:
    """A bitmap of the places (hash modulo FILTER_BITS) of all shingles that more than FREQUENT pools hold."""
    often = sizes.select(F.explode("pool").alias("shingle")).groupBy("shingle").count().filter(F.col("count") > FREQUENT)
    place = F.pmod("shingle", F.lit(FILTER_BITS))
    words = often.groupBy(F.shiftright(place, 5).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(shingle, {FILTER_BITS}) % 32 as int))")).alias("bits"))
    filled = np.zeros(FILTER_BITS // 32, np.uint32)
    rows = words.toPandas()  # at most FILTER_BITS / 32 rows
    filled[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
    return filled.tobytes()


def _prefixes(docs: DataFrame, words: int, percent: int, bitmap) -> DataFrame:
    """set (the id), n, parity, prefix: the set's first shingles in the order (frequent, hash)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint32)
        for batch in batches:
            sizes, prefixes, parity = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words)
                sizes.append(len(s))
                parity.append(_parity(s))
                if len(s):
                    place = s % np.uint64(FILTER_BITS)
                    often = (bits[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32)) & 1
                    s = np.concatenate([s[often == 0][: (k := _prefix(len(s), percent))], s[often == 1][:k]])[:k]
                prefixes.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), _lists(parity), _lists(prefixes)], ["set", "n", "parity", "prefix"])

    schema = T.StructType([T.StructField("set", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("parity", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(step, schema)


def _families(sets: DataFrame, percent: int) -> DataFrame:
    """(set, family): sets joined, directly or through others, as pairs that may link.

    An index list falls into blocks by position: entries beyond the index prefix never match
    each other, so lists without an entry in the first block are skipped. Of a list of at most
    FREQUENT entries all pairs of fitting sizes are tried, which is at most half FREQUENT an
    entry; a pair stays if the parity maps allow it. Of longer lists, those of frequent
    shingles, only the edges to the least set of two neighbouring size classes are made.
    """
    base = math.log(100 / percent) * (1 + 1e-9)
    n = F.col("n")
    first = n - F.ceil(F.lit(2 * percent) * n / F.lit(100 + percent) - 1e-9) + 1
    entries = sets.select("set", "n", first.alias("first"), F.posexplode("prefix").alias("pos", "shingle"))
    entries = entries.select("shingle", "set", F.when(F.col("pos") < F.col("first"), n).otherwise(-n).alias("n"))  # a size below 0: not in the first block
    lists = entries.groupBy("shingle").agg(F.count("*").alias("held"), F.max("n").alias("front")).filter("held > 1 and front > 0").select("shingle", "held")
    held = keep(entries.join(lists, "shingle"), "entries")
    few = held.filter(F.col("held") <= FREQUENT)
    one, two = few.select("shingle", F.col("set").alias("set1"), F.col("n").alias("n1")), few.select("shingle", F.col("set").alias("set2"), F.col("n").alias("n2"))
    size1, size2 = F.abs("n1"), F.abs("n2")
    fits = (F.col("set1") < F.col("set2")) & ((F.col("n1") > 0) | (F.col("n2") > 0)) & (100 * F.least(size1, size2) >= percent * F.greatest(size1, size2))
    tried = keep(one.join(two, one["shingle"].eqNullSafe(two["shingle"]) & fits).select("set1", "set2").distinct(), "tried")
    k = F.floor(F.log(F.abs("n")) / base).cast("int")
    many = held.filter(F.col("held") > FREQUENT).select("set", "shingle", "n", F.explode(F.array(k, k + 1)).alias("g"))
    heads = many.groupBy("shingle", "g").agg(F.min("set").alias("least"), F.max("n").alias("front"), F.count("*").alias("held")).filter("held > 1 and front > 0")
    heads = heads.select("shingle", "g", "least", F.explode(F.sequence(F.lit(0), F.lit(LIST_PARTS - 1))).alias("part"))
    dealt = many.withColumn("part", F.pmod(F.xxhash64("set"), F.lit(LIST_PARTS)).cast("int"))
    stars = dealt.join(heads, ["shingle", "g", "part"]).filter(F.col("set") != F.col("least")).select("set", "least")
    edges = keep(_by_parity(tried, sets, percent).union(stars).distinct(), "edges")
    for done in (held, tried):
        forget(done)
    families = keep(components(edges).select(F.col("node").alias("set"), F.col("component").alias("family")), "families")
    forget(edges)
    return families


def _by_parity(tried: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that may link by their parity maps: those differ in at most as many bits as the sets do in shingles.

    Linked sets of sizes a and b differ in at most (100 - percent) / (100 + percent) of a + b
    shingles. Sizes of a tried pair differ by less than half, so one map is folded onto the
    other's length at most once.
    """
    side = lambda i: sets.select(F.col("set").alias(f"set{i}"), F.col("n").alias(f"n{i}"), F.col("parity").alias(f"parity{i}"))
    xor = lambda a, b: a.bitwiseXOR(b)

    def folded(mine: str, other: str) -> Column:
        half = (F.size(mine) / 2).cast("int")
        return F.when(F.size(mine) > F.size(other), F.zip_with(F.slice(mine, 1, half), F.slice(mine, half + 1, half), xor)).otherwise(F.col(mine))

    differ = F.aggregate(F.zip_with(folded("parity1", "parity2"), folded("parity2", "parity1"), xor), F.lit(0), lambda total, x: total + F.bit_count(x))
    both = tried.join(side(1), "set1").join(side(2), "set2")
    return both.filter(differ * (100 + percent) <= (F.col("n1") + F.col("n2")) * (100 - percent)).select("set1", "set2")


def _tasks(members: DataFrame) -> DataFrame:
    """Deal each family's sets into blocks by size class, and each set to all pairs of blocks that may hold its partners."""
    units = members.groupBy("family", "k").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    units = keep(units.select("family", "k", "sets", blocks.alias("blocks")), "units")
    up = units.select("family", (F.col("k") - 1).alias("k"), F.col("blocks").alias("up"))
    down = units.select("family", (F.col("k") + 1).alias("k"), F.col("blocks").alias("down"))
    plan = units.join(up, ["family", "k"], "left").join(down, ["family", "k"], "left").filter("sets > 1 or up is not null or down is not null").na.fill(0, ["up", "down"])
    m = members.join(plan, ["family", "k"]).withColumn("b", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    span = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    key = lambda lo, hi, i, j, side: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), i.alias("i"), j.alias("j"), side.alias("side"))
    k, b = F.col("k"), F.col("b")
    own = F.transform(span("blocks"), lambda j: key(k, k, F.least(b, j), F.greatest(b, j), F.when(b <= j, 0).otherwise(1)))
    above = F.transform(span("up"), lambda j: key(k, k + 1, b, j, F.lit(0)))
    below = F.transform(span("down"), lambda i: key(k - 1, k, i, b, F.lit(1)))
    own = F.when(F.col("sets") > 1, own).otherwise(F.array().cast(T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in ("lo", "hi", "i", "j", "side")]))))
    tasks = keep(m.select("set", "weight", "family", F.explode(F.concat(own, above, below)).alias("t")).select("set", "weight", "family", "t.*"), "tasks")
    forget(units)
    return tasks


class _Counts:
    """How many shingles each indexed set shares with one set after the other; a similar one's answer is derived from the last."""

    def __init__(self, sets: list[np.ndarray]):
        self.m = len(sets)
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(tokens, kind="stable")
        self.tokens, starts = np.unique(tokens[order], return_index=True)
        self.owner, self.starts, self.ends = owner[order], starts, np.append(starts[1:], len(order))
        self.last, self.answer = np.zeros(0, np.int64), np.zeros(self.m, np.int64)

    def _scan(self, places: np.ndarray) -> np.ndarray:
        size = self.ends[places] - self.starts[places]
        if not len(size):
            return np.zeros(self.m, np.int64)
        at = np.repeat(self.starts[places] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        return np.bincount(self.owner[at], minlength=self.m)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.tokens, shingles)
        at[at == len(self.tokens)] = 0
        places = at[self.tokens[at] == shingles]
        same = np.intersect1d(places, self.last, assume_unique=True)
        if 2 * len(same) > max(len(places), len(self.last)):
            answer = self.answer + self._scan(np.setdiff1d(places, same, assume_unique=True)) - self._scan(np.setdiff1d(self.last, same, assume_unique=True))
        else:
            answer = self._scan(places)
        self.last, self.answer = places, answer
        return answer


def _verify(left: list[tuple], right: list[tuple] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the sets of one task, left then right, by the weights of their partners; and each one's group, by place. right None: left with itself."""
    rows = left + (right or [])
    sizes, weights, group = np.array([len(r[2]) for r in rows]), np.array([r[1] for r in rows], np.int64), np.arange(len(rows))
    links, index, m = np.zeros(len(rows), np.int64), _Counts([r[2] for r in left]), len(left)
    probes = range(len(left)) if right is None else range(m, len(rows))
    for y in sorted(probes, key=lambda y: rows[y][2][:4].tolist()):
        shared = index.of(rows[y][2])
        hit = 100 * shared >= percent * (sizes[:m] + sizes[y] - shared)
        if right is None:
            hit[y] = False
        found = np.flatnonzero(hit)
        if not len(found):
            continue
        links[y] += weights[found].sum()
        if right is not None:
            links[found] += weights[y]
        joined = np.unique(np.append(group[found], group[y]))
        if len(joined) > 1:
            group[np.isin(group, joined)] = joined[0]
    return links, group


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id, n_links. Exact: all pairs with 100 * shared >= percent * union link.

    A document's set holds the distinct shingles of ``words`` words (A-Z lower-cased; a text
    of fewer words is one shingle), as 64-bit hashes. Equal sets are one, weighted. Sets that
    share a shingle within their prefixes form families, which blocks of bounded size verify:
    each pair of blocks is a task that counts shared shingles along index lists, deriving a
    set's counts from the set before where most shingles are the same, and reports links and
    one edge per set. Pairs are never rows. component_id is the smallest id reachable by
    links, n_links counts the other documents linked directly.

    Nulls: a null or empty text has no shingle and no link; a null id links with nothing and
    has a null component. Rows of one id are one document, whose links are united. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with small_batches(spark):
        pooled = keep(_sizes(texts, words, percent), "sizes")
        bitmap = spark.sparkContext.broadcast(_frequent(pooled))
        sizes = keep(pooled.drop("pool"), "sizes")
        forget(pooled)
        real = sizes.filter("doc_id is not null and n > 0")
        classes = keep(real.groupBy("digest").agg(F.min("doc_id").alias("set"), F.count("*").alias("weight"), F.first("n").alias("n")), "classes")
        copies = keep(real.select("doc_id").join(classes.select("set"), F.col("doc_id") == F.col("set"), "left_anti").distinct(), "copies")
        named = texts.filter("doc_id is not null")
        if is_small(copies):
            prefixes = _prefixes(named.join(F.broadcast(copies), "doc_id", "left_anti"), words, percent, bitmap)
        else:  # their prefixes are shuffled to them rather than their texts
            prefixes = _prefixes(named, words, percent, bitmap).join(copies, F.col("set") == F.col("doc_id"), "left_anti")
        sets = keep(prefixes.filter("n > 0"), "sets")
        forget(copies)
        families = _families(sets, percent)
        forget(sets)
        base = math.log(100 / percent) * (1 + 1e-9)
        member = classes.join(families, "set").select("set", "weight", "family", "n", F.floor(F.log("n") / base).cast("int").alias("k"))
        member = keep(member, "members")
        forget(families)
        tasks = _tasks(member)
        need = keep(tasks.select("set").distinct(), "needed")
        held = texts.join(if_small(need), F.col("doc_id") == F.col("set"), "left_semi")
        out = keep(_run(_dealt(held, tasks, words), docs.schema[id_col].dataType, percent), "links")
        for done in (member, tasks, need):
            forget(done)
        joined = keep(components(out.filter("set <> root").select("set", "root")), "components")
    links = out.groupBy("set").agg(F.sum("links").alias("links"))
    known = classes.join(links, "set", "left").join(joined, F.col("set") == F.col("node"), "left")
    known = known.select("digest", "set", F.coalesce("component", "set").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    rows = sizes.select("doc_id", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("digest")).alias("digest"))
    return rows.join(known, "digest", "left").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def _dealt(held: DataFrame, tasks: DataFrame, words: int) -> DataFrame:
    """The tasks' rows with their sets, those of one task one after the other in one partition."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_set(t, words) for t in batch.column(1).to_pylist()])], ["set", "shingles"])

    schema = T.StructType([T.StructField("set", held.schema["doc_id"].dataType), T.StructField("shingles", T.ArrayType(T.LongType()))])
    key = ["family", "lo", "hi", "i", "j"]
    return held.mapInArrow(step, schema).join(tasks, "set").select("set", "weight", "side", "shingles", F.struct(*key).alias("task"), *key).repartition(*key).sortWithinPartitions(*key, "side", "set").select("set", "weight", "side", "shingles", F.to_json("task").alias("task"))


def _run(dealt: DataFrame, id_type: T.DataType, percent: int) -> DataFrame:
    schema = T.StructType([T.StructField("set", id_type), T.StructField("links", T.LongType()), T.StructField("root", id_type)])
    arrow = to_arrow_schema(schema)

    def answer(rows: list[tuple]) -> pa.RecordBatch:
        left, right = [r for r in rows if r[3] == 0], [r for r in rows if r[3] == 1]
        task = rows[0][4]
        own = task["lo"] == task["hi"] and task["i"] == task["j"]
        if not left or not (own or right):
            return pa.RecordBatch.from_pylist([], schema=arrow)
        links, group = _verify(left, None if own else right, percent)
        rows = left if own else left + right
        least: dict[int, object] = {}
        for r, g in zip(rows, group, strict=True):
            least[g] = min(least.get(g, r[0]), r[0])
        some = [i for i in range(len(rows)) if links[i]]
        return pa.RecordBatch.from_pydict({"set": [rows[i][0] for i in some], "links": [int(links[i]) for i in some], "root": [least[group[i]] for i in some]}, schema=arrow)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        now, rows = None, []
        for batch in batches:
            lists, ends = batch.column(3).values.to_numpy(zero_copy_only=False).view(np.uint64), batch.column(3).offsets.to_numpy()
            for n, (name, weight, side, task) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True)):
                if task != now:
                    if rows:
                        yield answer(rows)
                    now, rows = task, []
                    parsed = json.loads(task)
                rows.append((name, weight, np.array(lists[ends[n] : ends[n + 1]]), side, parsed))
        if rows:
            yield answer(rows)

    return dealt.mapInArrow(step, schema)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay when one of each component does (the smallest id), their columns unchanged; a null id stays."""
    gone = similar_sets(docs, id_col, text_col, words, percent).filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    gone = if_small(keep(gone, "gone"))
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
