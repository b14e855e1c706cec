"""Packing tokenised documents into fixed windows: bounded-space online best fit, then a merge of what stays open."""

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyloom.llm.common import keep, text_or_empty

#: The pre-tokenisation of the public byte-level BPE vocabularies (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of white space of so many characters goes to tokenizers: tiktoken's pattern gives up on runs not much longer than ten times this.
LONG_RUN = 50_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(4)
def encoder(path: str, plain: bool = False):
    """A function from a text to its ids as uint32, those that ``tokenizers`` gives without adding special tokens.

    A special token's string in a text is that token, or ordinary text if ``plain``.
    Byte-level BPE files go through tiktoken with the file's own vocabulary, whose ids are its
    merge ranks; any other file, and texts with a run of white space that tiktoken's pattern
    can't step back from, through tokenizers itself.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain
    slow = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = spec.get("added_tokens", ())
    special = {x["content"]: x["id"] for x in added}
    byte_level = spec["model"].get("type", "BPE") == "BPE" and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer")
    if not byte_level or any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
        return slow
    import tiktoken

    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in visible)}
    as_byte = {c: b for b, c in shown.items()}
    ranks = {bytes(as_byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if i not in special.values()}
    fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={} if plain else special)
    read = {"disallowed_special": ()} if plain else {"allowed_special": "all"}
    too_long = re.compile(rf"\s{{{LONG_RUN}}}")

    def encode(text: str) -> np.ndarray:
        if len(text) > LONG_RUN and too_long.search(text):
            return slow(text)
        return fast.encode_to_numpy(text, **read)

    return encode


class Windows:
    """A fixed number of open windows of ``size`` ids; ``done`` gets (sequence, offset, piece) of closed ones.

    A piece is (doc_id, start, ids, doc_tokens). Each goes to the window with the least room
    that takes it. If none does and all windows are open, the fullest is closed; what room
    it has is filled with ids cut from the piece if that is worth a cut, and else padded.
    """

    def __init__(self, size: int, count: int, least_cut: int, first: int):
        self.size, self.count, self.least_cut, self.next = size, count, least_cut, first
        self.open: list[tuple[int, int]] = []  # (room, sequence), in order
        self.held: dict[int, list] = {}
        self.done: list[tuple] = []

    def put(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.size:
            self._close(self._new(), [(0, (doc_id, start, ids[: self.size], total))])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            at = bisect_left(self.open, (len(ids), -1))
            if at < len(self.open):
                return self._add(at, doc_id, start, ids, total)
            if len(self.open) < self.count:
                sequence = self._new()
                self.held[sequence] = []
                insort(self.open, (self.size, sequence))
                return self._add(bisect_left(self.open, (self.size, sequence)), doc_id, start, ids, total)
            room, sequence = self.open[0]
            if room >= self.least_cut:
                self._add(0, doc_id, start, ids[:room], total)
                start, ids = start + room, ids[room:]
            else:
                self.open.pop(0)
                self._close(sequence, self.held.pop(sequence))

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _add(self, at: int, *piece) -> None:
        room, sequence = self.open.pop(at)
        self.held[sequence].append((self.size - room, piece))
        room -= len(piece[2])
        if room:
            insort(self.open, (room, sequence))
        else:
            self._close(sequence, self.held.pop(sequence))

    def _close(self, sequence: int, pieces: list) -> None:
        self.done += [(sequence, offset, piece) for offset, piece in pieces]

    def rest(self) -> list[tuple]:
        out = [(sequence, offset, piece) for sequence, pieces in self.held.items() for offset, piece in pieces]
        self.open, self.held = [], {}
        return out

    def join_rest(self) -> None:
        """End the work: the open windows' pieces one after the other, cut at each ``size`` ids, so that one sequence at most is not full."""
        pieces, self.open, self.held, room, sequence = [p for s in self.held.values() for _, p in s], [], {}, 0, 0
        for doc_id, start, ids, total in pieces:
            while len(ids):
                if not room:
                    room, sequence = self.size, self._new()
                take = ids[:room]
                self.done.append((sequence, self.size - room, (doc_id, start, take, total)))
                start, ids, room = start + len(take), ids[len(take) :], room - len(take)


def _batch(done: list[tuple], still_open: bool, with_ids: bool, schema: pa.Schema) -> pa.RecordBatch:
    raw = [p[2].astype("<u4").tobytes() for _, _, p in done]
    columns = {
        "doc_id": [p[0] for _, _, p in done], "start": [p[1] for _, _, p in done], "length": [len(p[2]) for _, _, p in done],
        "ids_crc32": [zlib.crc32(x) for x in raw], "doc_tokens": [p[3] for _, _, p in done], "sequence_id": [s for s, _, _ in done],
        "offset": [o for _, o, _ in done], "ids": raw if with_ids or still_open else [None] * len(done), "still_open": [still_open] * len(done),
    }
    return pa.RecordBatch.from_pydict(columns, schema=schema)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1,
    size: int = 2048, open_windows: int = 64, least_cut: int = 8, merge: int = 64, with_ids: bool = True, plain: bool = False,
) -> DataFrame:
    """Pieces of the documents' ids, each at its place in a sequence of at most ``size`` ids.

    Columns: id, start (ids of its document before it), length, ids_crc32, doc_tokens,
    sequence_id, offset, and, if asked for, ids (little-endian unsigned 32 bits). A
    document is its ids, then ``end_id``. Every partition packs alone in ``open_windows``
    windows; windows open at its end, a share that shrinks as partitions grow, are packed anew
    by ``merge`` partitions a task, round after round, until one task is left, which holds at
    most ``merge * open_windows`` windows (32 MB of ids as set) and joins what remains. Texts
    are never shuffled. Strings of special tokens are those tokens, or text if ``plain``.

    Nulls: a null text is empty, thus one id; a null document id is kept. Rows that repeat
    are packed each. A very long text is cut into full sequences as it comes. An empty table
    gives no pieces. Other columns are ignored, whatever their names.
    """
    path = tokenizer or default_tokenizer()
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
        T.StructField("ids", T.BinaryType()), T.StructField("still_open", T.BooleanType()),
    ])

    arrow = to_arrow_schema(schema)

    def first_sequence(level: int) -> int:
        from pyspark import TaskContext

        return level << 56 | TaskContext.get().partitionId() << 32

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows = encoder(path, plain), Windows(size, open_windows, least_cut, first_sequence(0))
        for batch in batches:
            for doc_id, text in zip(*batch.to_pydict().values(), strict=True):
                ids = np.append(encode(text), np.uint32(end_id))
                windows.put(doc_id, 0, ids, len(ids))
                if len(windows.done) > 5000:
                    yield _batch(windows.done, False, with_ids, arrow)
                    windows.done = []
        yield _batch(windows.done, False, with_ids, arrow)
        yield _batch(windows.rest(), True, with_ids, arrow)

    def again(level: int, last: bool):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows(size, open_windows, least_cut, first_sequence(level))
            for batch in batches:
                for doc_id, start, ids, total in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
                    windows.put(doc_id, start, np.frombuffer(ids, "<u4"), total)
            if last:
                windows.join_rest()
            yield _batch(windows.done, False, with_ids, arrow)
            yield _batch(windows.rest(), True, with_ids, arrow)

        return step

    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    parts = texts.rdd.getNumPartitions()
    pieces = [keep(texts.mapInArrow(first, schema), "pieces")]
    level = 0
    while parts:
        level, parts = level + 1, -(-parts // merge)
        rest = pieces[-1].filter("still_open").repartition(parts).sortWithinPartitions("sequence_id", "offset")
        pieces.append(keep(rest.mapInArrow(again(level, parts == 1), schema), "pieces"))
        if parts == 1:
            break
    out = pieces[0].filter("not still_open")
    for more in pieces[1:]:
        out = out.unionByName(more.filter("not still_open"))
    out = out.drop("still_open") if with_ids else out.drop("still_open", "ids")
    return out.withColumnRenamed("doc_id", id_col)
