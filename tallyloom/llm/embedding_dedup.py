"""Near-duplicate embeddings by product quantisation: inverted lists, residual codes, table distances, exact rerank."""

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyloom.llm.common import forget, keep, small_batches
from tallyloom.llm.components import components

#: Members, and queries, of a list that one task holds at most.
BLOCK = 4096
#: Numbers that the driver's training sample holds at most, and lists there are at most.
SAMPLE_FLOATS, MOST_LISTS = 4_000_000, 2048


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
        if (empty := np.flatnonzero(size == 0)).size:
            centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, at least 0."""
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None])


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[i : i + 1024], centres).argmin(1) for i in range(0, len(x), 1024)])


@dataclass(frozen=True)
class Quantiser:
    """Coarse centres, and for each run of ``width`` dimensions of the residuals a codebook."""

    centres: np.ndarray
    books: np.ndarray  # (subspaces, codes, width)

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int = 8, codes: int = 256, rounds: int = 8, seed: int = 3) -> "Quantiser":
        rng = np.random.default_rng(seed)
        centres = _kmeans(x, lists, rounds, rng)
        rest = cls._cut(x - centres[_nearest(x, centres)], subspaces)
        return cls(centres, np.stack([np.resize(_kmeans(rest[:, s], codes, rounds, rng), (codes, rest.shape[2])) for s in range(subspaces)]))

    @staticmethod
    def _cut(x: np.ndarray, subspaces: int) -> np.ndarray:
        width = -(-x.shape[1] // subspaces)
        return np.pad(x, ((0, 0), (0, width * subspaces - x.shape[1]))).reshape(len(x), subspaces, width)

    def encode(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and, for each vector, how far its reconstruction lies from it."""
        rest = self._cut(x - self.centres[near], len(self.books))
        codes = np.stack([_distances(rest[:, s], book).argmin(1) for s, book in enumerate(self.books)], axis=1)
        back = np.stack([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)
        return codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum((1, 2)))

    @cached_property
    def _apart(self) -> np.ndarray:
        return 2 * np.sqrt(_distances(self.centres, self.centres))

    def probes(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """For each vector its nearest list, and the lists (a boolean matrix) whose border planes lie within ``reach`` of it.

        A vector y in list j is nearer to centre j than to x's centre i; so it lies beyond the
        plane half-way between them, whose distance from x is what is compared.
        """
        near, within = np.zeros(len(x), np.int64), np.zeros((len(x), len(self.centres)), bool)
        for at in range(0, len(x), 256):
            d = _distances(x[at : at + 256], self.centres)
            own = d.argmin(1)
            apart = self._apart[own]
            plane = np.divide(d - d[np.arange(len(d)), own][:, None], apart, out=np.zeros_like(d), where=apart > 0)
            near[at : at + 256], within[at : at + 256] = own, plane <= reach + 1e-9
        return near, within

    def table_distances(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances: of each query to each code's reconstruction, by one table look-up a subspace."""
        rest = self._cut(queries - self.centres[which], len(self.books))
        out = np.zeros((len(queries), len(codes)))
        for s, book in enumerate(self.books):
            out += _distances(rest[:, s], book)[:, codes[:, s]]
        return np.sqrt(out)


def _matched(model: Quantiser, which: int, members: list[tuple], queries: list[tuple], cosine: float, radius: float, stored: type) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member, then query, and the group of each, by place: pairs of cosine or more, a vector and itself apart.

    A query of the list itself meets its members from both sides, so its pairs count for the
    query alone; one of another list is met here only, and its pairs count for both.

    A distance to a reconstruction is off by at most the member's reconstruction error, so
    that no pair within the radius is missed; all others are left to the exact cosine.
    """
    width = model.centres.shape[1]
    x, q = (_units([np.frombuffer(m[1], stored) for m in rows], width) for rows in (members, queries))
    codes, off = np.stack([np.frombuffer(m[2], np.uint8) for m in members]), np.array([m[3] for m in members])
    place = {}
    for i, m in enumerate(members):
        place.setdefault(m[0], []).append(i)
    group, links, own = np.arange(len(members) + len(queries)), np.zeros(len(members) + len(queries), np.int64), np.array([m[4] for m in queries])
    for i, row in enumerate(queries):  # a query that is also a member is one node
        if row[0] in place:
            group[len(members) + i] = group[place[row[0]][0]]
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        maybe = model.table_distances(part, which, codes) <= radius + off + 1e-9
        some = np.flatnonzero(maybe.any(0))
        hits = np.zeros_like(maybe)
        hits[:, some] = maybe[:, some] & (part @ x[some].T >= cosine)
        for i in range(len(part)):
            hits[i, place.get(queries[at + i][0], [])] = False
            found = np.flatnonzero(hits[i])
            links[len(members) + at + i] = len(found)
            if len(found):
                if not own[at + i]:
                    links[found] += 1
                joined = np.unique(np.append(group[found], group[len(members) + at + i]))
                if len(joined) > 1:
                    group[np.isin(group, joined)] = joined[0]
    return links, group


def _units(values: list, width: int) -> np.ndarray:
    """Vectors, shorter ones filled with zeros, at length 1 in double precision."""
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    out /= np.abs(out).max(1)[:, None]  # no overflow in the squares
    return out / np.sqrt((out * out).sum(1))[:, None]


def similar_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, lists: int | None = None, missed: float = 1e-5, seed: int = 3) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept. Pairs of one label with at least this cosine link, no others.

    The quantiser is fitted on a sample of at most SAMPLE_FLOATS numbers, chosen by hash;
    every vector is coded, put in its list, and sent as a query to its own list and all earlier
    ones whose border is near enough; later ones send theirs here. A task takes up to BLOCK
    members and BLOCK queries of a list, so that a list of any size is spread over pairs of
    blocks; it reports counts and one edge a query. Lists grow as the root of the number of
    vectors, so the pairs tried for a vector do too.

    Two vectors just at the cosine lie a radius apart. In d dimensions a neighbour in a
    direction even over the sphere crosses a given plane at ``r`` times the radius with a
    chance below exp(-d r^2 / 2); lists behind planes for which that is below ``missed`` are
    not probed. With ``missed`` 0 none within the radius is left out, and no pair can be lost.

    Vectors that are null, zero, or hold null or non-finite numbers, those of null label or
    null id, and those of unlike length never link; such rows are components of their own (a
    null id's component is null; it is kept). Rows of one id are one vector, and equal vectors
    of other ids link. An empty table gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    raw = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.to_json(F.struct(F.col(label_col).alias("l"))).alias("label"), raw.alias("v"), F.col(label_col).isNotNull().alias("has"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.filter(F.col("has") & F.col("id").isNotNull() & F.col("v").isNotNull()).filter(sound).select("id", "label", "v")
    n, width = good.agg(F.count("*"), F.max(F.size("v"))).first()
    ids = vectors.select(F.col(id_col).alias("id"))
    if not n:
        return ids.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    lists = lists or max(1, min(MOST_LISTS, math.isqrt(n)))
    sample = good.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(max(256, min(64 * lists, SAMPLE_FLOATS // width))).select("v").collect()

    radius = math.sqrt(2 - 2 * cosine)
    reach = radius * (min(1.0, math.sqrt(2 * math.log(1 / missed) / width)) if missed else 1.0)
    model = Quantiser.fit(_units([r[0] for r in sample], width), lists, seed=seed)
    shared, stored = spark.sparkContext.broadcast(model), np.float32 if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else np.float64
    schema = T.StructType([
        T.StructField("id", id_type), T.StructField("label", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("list", T.IntegerType()),
        T.StructField("query", T.BooleanType()), T.StructField("v", T.BinaryType()), T.StructField("codes", T.BinaryType()), T.StructField("off", T.DoubleType()), T.StructField("own", T.BooleanType()),
    ])
    arrow = to_arrow_schema(schema)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if not len(batch):
                continue
            names, labels, values = batch.to_pydict().values()
            x = _units(values, width)
            raw = [np.array(v, stored).tobytes() for v in values]  # as they came: half the bytes of units, where they are floats
            near, probes = model.probes(x, reach)
            codes, off = model.encode(x, near)
            out = [(names[i], labels[i], len(values[i]), int(near[i]), False, raw[i], codes[i].tobytes(), float(off[i]), True) for i in range(len(x))]
            earlier = probes & (np.arange(probes.shape[1])[None] <= near[:, None])  # a pair of two lists is found from the later one
            out += [(names[i], labels[i], len(values[i]), int(j), True, raw[i], None, None, bool(near[i] == j)) for i, j in zip(*np.nonzero(earlier), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    cell = ["label", "width", "list"]
    with small_batches(spark):
        indexed = keep(good.mapInArrow(index, schema), "index")
        size = indexed.groupBy(*cell).agg(F.ceil(F.count_if(~F.col("query")) / BLOCK).cast("int").alias("mb"), F.ceil(F.count_if("query") / BLOCK).cast("int").alias("qb")).filter("mb > 0")
        dealt = indexed.join(size, cell)
        mine = F.pmod(F.xxhash64("id"), F.when(F.col("query"), F.col("qb")).otherwise(F.col("mb"))).cast("int")
        dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("mb")).otherwise(F.col("qb")) - 1)))
        dealt = dealt.withColumns({"m": F.when(F.col("query"), F.col("other")).otherwise(F.col("mine")), "q": F.when(F.col("query"), F.col("mine")).otherwise(F.col("other"))})
        key = [*cell, "m", "q"]
        dealt = dealt.repartition(*key).sortWithinPartitions(*key, "query", "id").select(*key, "query", "id", "v", "codes", "off", "own")
        out_schema = T.StructType([T.StructField("id", id_type), T.StructField("links", T.LongType()), T.StructField("root", id_type)])
        out_arrow = to_arrow_schema(out_schema)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (r for b in batches for r in zip(*b.to_pydict().values(), strict=True))
            for k, task in groupby(rows, key=lambda r: r[:5]):
                parts: dict[bool, list[tuple]] = {False: [], True: []}
                for r in task:
                    parts[r[5]].append(r[6:])
                if parts[False] and parts[True]:
                    links, group = _matched(shared.value, k[2], parts[False], parts[True], cosine, radius, stored)
                    names = [r[0] for r in parts[False] + parts[True]]
                    least: dict[int, object] = {}
                    for name, g in zip(names, group, strict=True):
                        least[g] = min(least.get(g, name), name)
                    some = [i for i, g in enumerate(group) if links[i] or least[g] != names[i]]
                    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in some], out_arrow.types[0]), pa.array(links[some]), pa.array([least[group[i]] for i in some], out_arrow.types[2])], schema=out_arrow)

        found = keep(dealt.mapInArrow(search, out_schema), "matches")
        forget(indexed)
    joined = keep(components(found.filter("id <> root").select("id", "root")), "components")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    out = ids.join(links, "id", "left").join(joined, F.col("id") == F.col("node"), "left")
    out = out.select("id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
