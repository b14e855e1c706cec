"""Document quality by a linear-chain conditional random field over lines."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import by_hash_mod, forget, if_small, keep, mix64, small_batches, text_or_empty, words_of

#: Bytes by kind: capitals, small letters and all beyond ASCII, digits, sentence marks, other marks, white space.
CLASSES = np.full(256, 4, np.uint8)
CLASSES[65:91], CLASSES[97:123], CLASSES[128:], CLASSES[48:58] = 0, 1, 1, 2
CLASSES[[ord(c) for c in ".,;:?'\"-()"]] = 3
CLASSES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 5
FEATURES = 11
#: Bytes of text that are worked on at once; a longer text alone.
GROUP_BYTES = 1 << 20
#: The score that the fitted threshold is mapped to.
CUT = 0.7


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, FEATURES) of the lines that hold a word, and their lengths in bytes."""
    return features_of([text])[:2]


def features_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte lengths of the lines that hold a word, text after text, and how many such lines each text has.

    Texts are worked on in groups of about GROUP_BYTES, put one after the other as lines are.
    """
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raws])
    cuts = [0, *np.flatnonzero(np.diff(ends // GROUP_BYTES)) + 1, len(raws)] if len(raws) else [0]
    parts = [_group_features(raws[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i]
    if not parts:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0), np.zeros(0, np.int64)
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))


def _group_features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = b"\n".join(raws)
    starts, ends, hashes = words_of(raw)
    if not len(starts):
        return np.zeros((0, FEATURES), np.float32), np.zeros(0), np.zeros(len(raws), np.int64)
    data = np.frombuffer(raw, np.uint8)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, starts)
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    words = np.diff(np.append(first, len(line)))
    begin = np.append(0, breaks + 1)[line[first]]
    stop = np.append(breaks, len(data))[line[first]]
    begun = np.cumsum([0, *[len(r) + 1 for r in raws[:-1]]])
    owner = np.searchsorted(begun, begin, side="right") - 1
    kinds = CLASSES[data]
    counts = np.empty((len(first), 6))
    for k in range(6):
        upto = np.append(0, np.cumsum(kinds == k))
        counts[:, k] = upto[stop] - upto[begin]
    size = np.maximum(1, stop - begin)
    upper, lower, digit, mark, other, _ = counts.T
    letters = np.maximum(1, upper + lower)
    again = np.append(False, (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1]))
    order = np.lexsort((hashes, line))
    fresh = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1]))
    per_line = lambda x: np.add.reduceat(x.astype(float), first)
    length = ends - starts
    whole = np.add.reduceat(hashes * (np.arange(len(hashes), dtype=np.uint64) - np.repeat(first, words).astype(np.uint64) + np.uint64(1)), first)
    _, which, seen = np.unique(mix64(whole + mix64(owner.astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)  # lines of one text only
    out = np.stack([
        upper / letters, digit / size, mark / size, other / size, per_line(length) / words, per_line(length == 1) / words,
        per_line(again) / words, np.add.reduceat(fresh.astype(float), first) / words, np.log1p(words), per_line(length > 14) / words, np.log2(seen[which]),
    ], axis=1)
    return out.astype(np.float32), size.astype(float), np.bincount(owner, minlength=len(raws))


def _chains(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The documents' order by falling length, where each begins, in that order, and how many have a line t."""
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    return order, begin, [int(n) for n in len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max()), side="right")]


def _passes(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, forward and backward logarithms of the lines of many documents, one after the other; all documents take a step at once."""
    score = np.zeros((len(emissions), 2))
    score[:, 1] = emissions
    forward, backward = score.copy(), np.zeros_like(score)
    _, begin, alive = _chains(lengths)
    for t in range(1, len(alive)):
        at = begin[: alive[t]] + t
        forward[at] += np.logaddexp(forward[at - 1, :1] + moves[0], forward[at - 1, 1:] + moves[1])
    for t in range(len(alive) - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        ahead = score[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
    return score, forward, backward


def _edges(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a line is its document's first, and its last."""
    first, last = np.zeros(lengths.sum(), bool), np.zeros(lengths.sum(), bool)
    ends = np.cumsum(lengths)
    first[ends - lengths], last[ends - 1] = True, True
    return first, last


@dataclass(frozen=True)
class LineCrf:
    """Two states a line, 1 being good: weights of binned features of a line and its neighbours, and of transitions.

    ``weights`` are those of each feature's thresholds passed by the line, by the line before
    and by the line after, then of being first, of being last, and a constant.
    """

    bins: np.ndarray  # (FEATURES, thresholds), rising
    weights: np.ndarray
    moves: np.ndarray  # (2, 2)
    threshold: float

    def emissions(self, features: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """The score of each line as good: per feature and neighbour one look-up of the sum of the thresholds passed."""
        lengths = np.array([len(features)]) if lengths is None else lengths
        return _emissions(_passed(features, self.bins), lengths, self.weights, self.bins.shape)

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """P(good) of each line of one document, or of documents of these lengths, by the forward-backward recursion in logarithms."""
        lengths = np.array([len(emissions)]) if lengths is None else lengths
        _, forward, backward = _passes(emissions, lengths, self.moves)
        both = forward + backward
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50)))

    def lines(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """P(good) and bytes of the lines that hold a word, text by text."""
        features, sizes, lengths = features_of(texts)
        some = lengths[lengths > 0]
        good = self.marginals(self.emissions(features, some), some) if len(some) else np.zeros(0)
        at = np.cumsum(lengths)[:-1]
        return list(zip(np.split(good, at), np.split(sizes, at), strict=True))

    def scores(self, texts: list[str | None]) -> list[float]:
        """The share of each text's bytes in good lines, mapped so that the threshold is CUT; 0 for a text without words."""
        raw = np.array([size @ good / size.sum() if len(size) else 0.0 for good, size in self.lines(texts)]) if texts else np.zeros(0)
        above = CUT + (1 - CUT) * (raw - self.threshold) / max(1e-9, 1 - self.threshold)
        return np.where(raw < self.threshold, CUT * raw / self.threshold, above).tolist()


def _passed(features: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """How many thresholds of its feature each value passes."""
    return np.stack([np.searchsorted(b, x, side="left") for b, x in zip(bins, features.T, strict=True)], axis=1).astype(np.uint8)


def _emissions(passed: np.ndarray, lengths: np.ndarray, weights: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    size = shape[0] * shape[1]
    sums = np.zeros((3, shape[0], shape[1] + 1))
    np.cumsum(weights[: 3 * size].reshape(3, *shape), axis=2, out=sums[:, :, 1:])
    own, before, after = (sum(sums[part, f][passed[:, f]] for f in range(shape[0])) for part in range(3))
    first, last = _edges(lengths)
    out = own + weights[3 * size + 2] + np.where(first, weights[3 * size], 0) + np.where(last, weights[3 * size + 1], 0)
    out[1:] += np.where(first[1:], 0, before[:-1])
    out[:-1] += np.where(last[:-1], 0, after[1:])
    return out


def _slopes(passed: np.ndarray, lengths: np.ndarray, rest: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """The weights' gradient where ``rest`` is that of the emissions: per feature one histogram, summed from above."""
    first, last = _edges(lengths)
    ahead, behind = np.append(np.where(first, 0, rest)[1:], 0), np.append(0, np.where(last, 0, rest)[:-1])  # what a line gets as the one before, or after, another
    out = [
        np.bincount(passed[:, f], part, shape[1] + 1)[::-1].cumsum()[::-1][1:]
        for part in (rest, ahead, behind) for f in range(shape[0])
    ]
    return np.concatenate([*out, [rest[first].sum(), rest[last].sum(), rest.sum()]])


def _climb(passed: np.ndarray, lengths: np.ndarray, y: np.ndarray, weight: np.ndarray, shape: tuple[int, int], start: tuple[np.ndarray, np.ndarray], steps: int, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves after ``steps`` of gradient ascent (Adam) on the weighted conditional likelihood of the lines' labels ``y``."""
    values = [start[0].copy(), start[1].copy()]
    m, v = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]
    first, last = _edges(lengths)
    at, ends = np.flatnonzero(~first), np.cumsum(lengths) - 1
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), weight[at])
    for step in range(1, steps + 1):
        score, forward, backward = _passes(_emissions(passed, lengths, values[0], shape), lengths, values[1])
        total = np.repeat(np.logaddexp(forward[ends, 0], forward[ends, 1]), lengths)
        good = np.exp(forward[:, 1] + backward[:, 1] - total)
        ahead = (score[at] + backward[at]) - total[at, None]
        pair = np.array([[(np.exp(forward[at - 1, i] + values[1][i, j] + ahead[:, j]) * weight[at]).sum() for j in (0, 1)] for i in (0, 1)])
        for i, slope in enumerate((_slopes(passed, lengths, weight * (y - good), shape) - decay * values[0], seen - pair - decay * values[1])):
            m[i] = 0.9 * m[i] + 0.1 * slope
            v[i] = 0.999 * v[i] + 0.001 * slope**2
            values[i] += rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
    return values[0], values[1]


def fit(documents: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 150, rate: float = 0.1, decay: float = 2e-4, again: int = 50, sure: float = 0.99) -> LineCrf:
    """Fit to (line features, line sizes, label) by gradient ascent on the conditional likelihood.

    At first each line bears its document's label. Then lines that the fitted emissions alone
    hold for the other label by ``sure`` or more are given that one, at most half of a
    document's bytes, and ``again`` more steps follow: so changes of label within a document
    are learned too. Both labels weigh alike. The threshold on the share of good bytes is the
    one that parts the fitted documents best, classes alike. Lines are held as a byte a
    feature, so the driver needs some 100 bytes a line.
    """
    documents = [d for d in documents if len(d[0])]
    labels = np.array([d[2] for d in documents])
    if not len(labels) or labels.min() == labels.max():
        return LineCrf(np.zeros((FEATURES, 1)), np.zeros(3 * FEATURES + 3), np.zeros((2, 2)), 0.5 if not len(labels) or labels.min() == 0 else 0.25)
    lengths = np.array([len(d[0]) for d in documents])
    everything, sizes = np.concatenate([d[0] for d in documents]), np.concatenate([d[1] for d in documents])
    bins = np.quantile(everything, [0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98], axis=0).T.astype(np.float32)
    passed, shape = _passed(everything, bins), bins.shape
    del everything
    weight = np.repeat(np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum()) / lengths, lengths)
    y, start = np.repeat(labels, lengths), (np.zeros(3 * bins.size + 3), np.zeros((2, 2)))
    w, moves = _climb(passed, lengths, y, weight, shape, start, steps, rate, decay)
    if again:
        alone = 1 / (1 + np.exp(-np.clip(_emissions(passed, lengths, w, shape), -50, 50)))
        other = np.where(y == 1, 1 - alone, alone) >= sure
        ends = np.cumsum(lengths)
        share = np.add.reduceat(sizes * other, ends - lengths) / np.add.reduceat(sizes, ends - lengths)
        other &= np.repeat(share <= 0.5, lengths)
        w, moves = _climb(passed, lengths, np.where(other, 1 - y, y), weight, shape, (w, moves), again, rate, decay)
    model = LineCrf(bins, w, moves, 0.5)
    good = model.marginals(_emissions(passed, lengths, w, shape), lengths)
    begin = np.cumsum(lengths) - lengths
    shares = np.add.reduceat(good * sizes, begin) / np.add.reduceat(sizes, begin)
    cuts = np.unique(np.clip(shares, 0.02, 0.98))
    cuts = np.append((cuts[1:] + cuts[:-1]) / 2, 0.5)
    merit = np.array([(shares[labels == 1] >= c).mean() + (shares[labels == 0] < c).mean() for c in cuts])
    best = np.flatnonzero(merit >= merit.max() - 1e-12)
    return LineCrf(bins, w, moves, float(cuts[best[len(best) // 2]]))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = 2000, lines: int = 100, seed: int = 5) -> LineCrf:
    """Fit on at most about ``per_label`` documents of each label, chosen by hash, and ``lines`` lines of each, a run in the middle.

    Both limits bound what the driver gets: the features of 2 * per_label * lines lines.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    marks = marks.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").select("id", "label")
    chosen = [marks.filter(F.col("label") == v).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(per_label) for v in (0, 1)]
    chosen = keep(chosen[0].union(chosen[1]), "labelled")  # of bounded size, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "label", "text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, sizes, lengths = features_of(batch.column(2).to_pylist())
            at = np.cumsum(lengths)[:-1]
            found = list(zip(np.split(features, at), np.split(sizes, at), strict=True)) if len(lengths) else []
            cut = [(f[(k := max(0, len(f) - lines) // 2) : k + lines], s[k : k + lines]) for f, s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.tobytes() for f, _ in cut], pa.binary()), pa.array([s.tobytes() for _, s in cut], pa.binary())], ["id", "label", "features", "sizes"])

    schema = T.StructType([T.StructField("id", marks.schema["id"].dataType), T.StructField("label", T.IntegerType()), T.StructField("features", T.BinaryType()), T.StructField("sizes", T.BinaryType())])
    with small_batches(docs.sparkSession):
        got = sorted(rows.mapInArrow(step, schema).collect(), key=lambda r: r["id"])
    forget(chosen)
    return fit([(np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES), np.frombuffer(r["sizes"]), r["label"]) for r in got])


def with_quality(docs: DataFrame, model: LineCrf, text_col: str = "text", score_as: str = "score") -> DataFrame:
    """The rows of ``docs`` with the quality of each whole text in place of the text."""
    others = [c for c in docs.columns if c != text_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(batch.column(len(others)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*others, score_as])

    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField(score_as, T.DoubleType())])
    with small_batches(docs.sparkSession):
        return keep(docs.select(*[F.col(f"`{c}`") for c in others], F.col(text_col).cast("string").alias(text_col)).mapInArrow(step, schema), "quality")


def label_lines(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per line that holds a word: id, line (from 1, among these lines), n_bytes, p_good, good; learned as in ``score_quality``.

    Nulls, repeated rows and empty tables as there: a null or wordless text has no line.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_learned(docs, labels, id_col, text_col, **options))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.lines(batch.column(1).to_pylist())
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(g) for g, _ in found])))
            good = np.concatenate([g for g, _ in found]) if found else np.zeros(0)
            sizes = np.concatenate([s for _, s in found]) if found else np.zeros(0)
            places = np.concatenate([np.arange(1, len(g) + 1) for g, _ in found]) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(places.astype(np.int64)), pa.array(sizes.astype(np.int64)), pa.array(good), pa.array(good >= 0.5)], [id_col, "line", "n_bytes", "p_good", "good"])

    schema = T.StructType([docs.schema[id_col], T.StructField("line", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("p_good", T.DoubleType()), T.StructField("good", T.BooleanType())])
    with small_batches(docs.sparkSession):
        return keep(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(step, schema), "lines")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 from a score of 0.7); learned from labelled documents not held out.

    Held out are ids whose crc32 modulo 4 is 2. Nulls: a null or wordless text scores 0; a
    null label, a null labelled id and ids labelled both ways are not learned from; a null
    document id is scored like others. Rows that repeat are each scored alike. With labels of
    one value only all texts with a word get one score. An empty table gives no rows.
    """
    held_out = by_hash_mod(id_col) == 2
    rows = docs.select(F.col(id_col), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return _predicted(rows, _learned(docs, labels, id_col, text_col, **options))


def _learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, **options) -> LineCrf:
    """The model fitted on what is not held out."""
    return learn(docs.filter(by_hash_mod(id_col) != 2), labels.filter(by_hash_mod(id_col) != 2), id_col, text_col, **options)


def _predicted(rows: DataFrame, model: LineCrf) -> DataFrame:
    return with_quality(rows, model).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents whose predicted quality is 1, their columns unchanged.

    Each row is judged by its own text: what is bad is named by id and SHA-256 of the text, so
    rows that share an id, or have none, don't bear each other's score.
    """
    digest = F.unhex(F.sha2(text_or_empty(text_col), 256))
    rows = docs.select(F.col(id_col).alias("_bad"), digest.alias("_sha"), F.col(text_col).alias("text"))
    bad = _predicted(rows, _learned(docs, labels, id_col, text_col, **options)).filter("predicted = 0").select("_bad", "_sha").distinct()
    bad = if_small(keep(bad, "bad"))
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("_bad")) & (digest == F.col("_sha")), "left_anti")
