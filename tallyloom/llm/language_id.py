"""Language identification by bit-sliced Bloom filters over character trigrams."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import by_hash_mod, forget, keep, mix64, small_batches

UNDETERMINED = "und"
_letters: dict[str, np.ndarray] = {}


def _is_letter(points: np.ndarray) -> np.ndarray:
    if "table" not in _letters:
        _letters["table"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters["table"][points]


def trigrams(text: str | None) -> tuple[np.ndarray, bool]:
    """The trigrams of a text's letters, lower-cased, any run of other characters being one mark; and whether it has a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter(points)
    if not letter.any():
        return np.zeros(0, np.uint64), False
    stays = letter.copy()
    stays[1:] |= letter[:-1]  # the first of each run of others
    c = np.concatenate(([0], np.where(letter, points, 0)[stays], [0])).astype(np.uint64)
    return c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42), True


@dataclass(frozen=True)
class LanguageFilter:
    """Slot by slot, a bit for each language: an n-gram's slots, and-ed, name the languages that hold it."""

    languages: tuple[str, ...]
    slots: np.ndarray  # uint64, (slots, words of 64 languages)
    hashes: int

    @classmethod
    def of(cls, languages: tuple[str, ...], grams: np.ndarray, masks: np.ndarray, hashes: int = 3, slots: int = 1 << 18) -> "LanguageFilter":
        table = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
        for k in range(hashes):
            np.bitwise_or.at(table, cls._place(grams, k, slots), masks)
        return cls(languages, table, hashes)

    @staticmethod
    def _place(grams: np.ndarray, k: int, slots: int) -> np.ndarray:
        return (mix64(grams + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(slots)).astype(np.int64)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        out = self.slots[self._place(grams, 0, len(self.slots))]
        for k in range(1, self.hashes):
            out &= self.slots[self._place(grams, k, len(self.slots))]
        return out

    def false_rates(self) -> np.ndarray:
        """For each language the chance that an n-gram it lacks seems held: the share of its slots set, to the power of hashes."""
        return np.array([(((self.slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** self.hashes for i in range(len(self.languages))])

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and its share of all corrected counts; ties go to the first in code point order."""
        names, scores, wrong = [], [], self.false_rates()
        for text in texts:
            grams, any_letter = trigrams(text)
            if not any_letter or not self.languages:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            found = self.masks(grams)
            held = np.array([np.count_nonzero(found[:, i // 64] & np.uint64(1 << i % 64)) for i in range(len(self.languages))], float)
            counts = np.maximum(0.0, (held - wrong * len(grams)) / (1 - wrong))
            best, total = int(counts.argmax()), counts.sum()
            names.append(self.languages[best])
            scores.append(float(counts[best] / total) if total else 0.0)
        return names, scores


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, grams: int = 20_000, least: int = 3, share: float = 0.4, seed: int = 11) -> LanguageFilter:
    """Fit the filter on about ``per_language`` texts of each language, chosen by hash.

    A language holds a trigram that makes up at least ``share`` of its share in the language
    where it is most frequent, and was seen ``least`` times; of these its ``grams`` most
    frequent. Both limits bound what the driver gets: ``grams`` rows a language.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h")).filter("lang is not null and text is not null")
    numbers = keep(rows.groupBy("lang").count(), "languages")
    n = numbers.withColumnRenamed("lang", "l")
    place = F.col("h").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    sample = rows.withColumn("place", place).join(n, F.col("lang") == F.col("l")).filter(F.col("place") < F.lit(per_language) / F.col("count")).select("lang", "text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(*batch.to_pydict().values(), strict=True):
                by.setdefault(lang, []).append(trigrams(text)[0])
            for lang, parts in by.items():
                gram, count = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(count.astype(np.int64))], ["lang", "gram", "n"])

    with small_batches(docs.sparkSession):
        counts = keep(sample.mapInArrow(step, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all")).withColumnRenamed("lang", "l")
    part = counts.join(totals, F.col("lang") == F.col("l")).select("lang", "gram", "n", (F.col("n") / F.col("all")).alias("p"))
    most = part.groupBy("gram").agg(F.max("p").alias("most")).withColumnRenamed("gram", "g")
    held = keep(part.join(most, F.col("gram") == F.col("g")).filter((F.col("p") >= share * F.col("most")) & (F.col("n") >= least)).select("lang", "gram", "n"), "held")
    languages = tuple(sorted(r[0] for r in totals.select("l").collect()))
    table: dict[int, np.ndarray] = {}
    for i, lang in enumerate(languages):
        for (gram,) in held.filter(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(grams).select("gram").collect():
            table.setdefault(gram, np.zeros(max(1, -(-len(languages) // 64)), np.uint64))[i // 64] |= np.uint64(1 << i % 64)
    for done in (numbers, counts, held):
        forget(done)
    masks = np.array(list(table.values())) if table else np.zeros((0, max(1, -(-len(languages) // 64))), np.uint64)
    return LanguageFilter.of(languages, np.array(list(table), np.int64).view(np.uint64), masks)


def identify(docs: DataFrame, model: LanguageFilter, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """The rows of ``docs`` with the language and score of each whole text in place of the text."""
    others = [c for c in docs.columns if c != text_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.decide(batch.column(len(others)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*others, lang_as, score_as])

    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())])
    with small_batches(docs.sparkSession):
        return keep(docs.select(*[F.col(f"`{c}`") for c in others], F.col(text_col).cast("string").alias(text_col)).mapInArrow(step, schema), "languages")


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score; learned from the documents that are not held out.

    Held out are ids whose crc32 modulo 4 is 2. Nulls: a null text, or one without a letter,
    is ``und`` with score 0; a null language is not learned from; a null id counts as the
    empty one. Rows that repeat are each decided, and learned from, alike. Without any
    language to learn every text is ``und``. An empty table gives no rows.
    """
    held_out = by_hash_mod(id_col) == 2
    model = learn(docs.filter(~held_out), id_col, text_col, lang_col, **options)
    rows = docs.select(F.col(id_col), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model)
