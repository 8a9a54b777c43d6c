"""Best-fit packing by hierarchical residual packing, and the exact tokenization it packs."""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

TOKENS = 1024
END = 2
#: Bins at least this full leave the tree; the rest are packed again as items.
NEARLY = 1016
#: Items that one task packs at once; also the bound on what one task of the tree holds.
LOCAL_ITEMS = 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Characters on which all Unicode versions agree about letters, digits and spaces; other texts go to the library whole.
_SETTLED = re.compile(r"[\t\n\r\x20-\x7e\xa0-\u0377\u0400-\u0527\u05d0-\u05ea\u2010-\u2027\u2030-\u205e\u20a0-\u20b5\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")
#: How the byte-level step of such a tokenizer cuts a text.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Words whose ids a worker keeps.
_CACHE = 300_000


class _Ids(dict):
    """A word's ids as bytes, by the library's own model, kept while there is room."""

    def __init__(self, model):
        super().__init__()
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.model, self.letters = model, {b: b for b in shown} | {b: 256 + n for n, b in enumerate(hidden)}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _CACHE:
            self.clear()
        ids = array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))])
        if sys.byteorder == "big":
            ids.byteswap()
        ids = self[word] = ids.tobytes()
        return ids


class Encoder:
    """Token ids as little-endian uint32 bytes, as the tokenizers library gives them with add_special_tokens=False.

    Where its file describes a plain byte-level BPE, words are cut here and each distinct one is given to the library's
    model once, which is twice as fast and gives equal ids. Texts with a special token's string, or with characters
    outside of _SETTLED, and all texts of other tokenizers go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        step, model = form["pre_tokenizer"] or {}, form["model"]
        plain = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space") and form["normalizer"] is None and form["truncation"] is None and form["padding"] is None
        plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        self.words = _Ids(self.tokenizer.model) if plain else None
        self.special = [t["content"] for t in form["added_tokens"]]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.words is None or not _SETTLED.fullmatch(text) or any(t in text for t in self.special):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, _WORDS.findall(text)))


def encoder(path: str) -> Encoder:
    """One for each worker process and file, kept from task to task."""
    kept = sys.__dict__.setdefault("_lumenfold_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def pieces(length: int, limit: int) -> list[tuple[int, int]]:
    """(start, length): whole if it fits, else full pieces after a first one that takes the remainder."""
    first = length % limit or limit
    return [(0, first), *((s, limit) for s in range(first, length, limit))]


def tokenized_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = TOKENS, end_id: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's ids with the end id. Null text: the end id alone."""
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids, doc = encode(text.as_py() or "") + end, doc.as_py()
                view = memoryview(ids)
                for n, (start, length) in enumerate(pieces(len(ids) // 4, limit)):
                    part = view[4 * start : 4 * (start + length)]
                    for column, value in zip(rows, (doc, n, start, length, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None), strict=True):
                        column.append(value)
            arrays = [pa.array(rows[0], batch.schema.field(0).type), pa.array(rows[1], pa.int32()), *[pa.array(c, pa.int64()) for c in rows[2:5]]]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(rows[5], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best fit, longest first: each item's bin and offset, and each bin's fill."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    fill: list[int] = []
    rooms: list[int] = []  # distinct amounts of room, ascending; the bins that have it
    with_room: dict[int, list[int]] = {}
    for i in order:
        need = int(lengths[i])
        k = bisect_left(rooms, need)
        if k == len(rooms):
            b, room = len(fill), limit
            fill.append(0)
        else:
            room = rooms[k]
            b = with_room[room].pop()
            if not with_room[room]:
                del with_room[room], rooms[k]
        bins[i], offsets[i] = b, fill[b]
        fill[b] += need
        if left := room - need:
            if left not in with_room:
                with_room[left] = []
                insort(rooms, left)
            with_room[left].append(b)
    return bins, offsets, fill


def _local(level: int, limit: int):
    """Packs each task's items by themselves, in lots of at most LOCAL_ITEMS."""

    def pack(items: np.ndarray, lengths: np.ndarray, first: int) -> pa.RecordBatch:
        bins, offsets, fill = best_fit(lengths, limit)
        return pa.RecordBatch.from_arrays([pa.array(items), pa.array(bins + first), pa.array(offsets), pa.array(np.array(fill, dtype=np.int64)[bins])], ["item", "bin", "offset", "fill"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = (level << 57) | (TaskContext.get().partitionId() << 36)
        held: list[pa.RecordBatch] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, held, count
            out = pack(np.concatenate([b.column(0).to_numpy() for b in held]), np.concatenate([b.column(1).to_numpy() for b in held]), first)
            first, held, count = first + count, [], 0
            return out

        for b in batches:
            if b.num_rows:
                held.append(b)
                count += b.num_rows
            if count >= LOCAL_ITEMS:
                yield flush()
        if held:
            yield flush()

    return run


def pack_items(items: DataFrame, limit: int = TOKENS, nearly: int = NEARLY) -> DataFrame:
    """(item, length) to (item, sequence_id, offset), items being distinct longs, lengths from 1 to limit.

    Every task packs its own items best-fit, longest first. Bins nearly full, and those that not even the emptiest
    bin fits into, are final; the others are the items of the next round, over ever fewer tasks, until one task's
    worth is left, or a round joins fewer than one bin in a thousand. Each round is written to the shared folder, so
    that a lost executor can't make half of a round anew with other bins.
    """
    spark = items.sparkSession
    ship(spark)
    schema = "item bigint, bin bigint, offset bigint, fill bigint"
    todo, left, level, tasks, rounds = items.select("item", "length"), None, 0, 0, []
    while True:
        packed = materialize(todo.mapInArrow(_local(level, limit), schema), "pack")
        rounds.append(packed)
        open_ = packed.where(F.col("fill") < nearly).select(F.col("bin").alias("item"), F.col("fill").alias("length")).distinct()
        least = open_.agg(F.min("length")).first()[0]
        open_ = open_.where(F.col("length") + F.lit(least or 0) <= limit)  # the others fit with none
        before, left = left, open_.count()
        # where a round hardly joined bins, the next one mixes over half as many tasks
        tasks = -(-left // LOCAL_ITEMS) if before is None or left <= 0.9 * before else max(1, -(-tasks // 2))
        if level and packed.rdd.getNumPartitions() == 1 or left < 2 or level == 30 or (before is not None and left > 0.999 * before and tasks > 1):
            break
        todo, level = open_.repartition(max(1, tasks), F.xxhash64("item")).sortWithinPartitions("item"), level + 1
        if tasks <= 1:
            rounds.append(materialize(todo.mapInArrow(_local(level, limit), schema), "pack"))
            break
    last = rounds.pop().select(F.col("item"), F.col("bin").alias("sequence_id"), F.col("offset"))
    for r in reversed(rounds):
        upper = last.select(F.col("item").alias("_bin"), F.col("sequence_id"), F.col("offset").alias("_base"))
        last = r.join(upper, r["bin"] == upper["_bin"], "left").select("item", F.coalesce("sequence_id", "bin").alias("sequence_id"), (r["offset"] + F.coalesce("_base", F.lit(0))).alias("offset"))
    return last


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = TOKENS, end_id: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents packed into sequences of at most `limit` tokens, one row per piece.

    Only documents longer than a sequence are cut. Full pieces are sequences by themselves, the others are
    packed hierarchically. Null and empty texts are the end id alone; null ids and repeated rows are packed like
    others, each row's pieces by themselves. Empty table: empty result.
    """
    cut = tokenized_pieces(docs, id_col, text_col, tokenizer, limit, end_id, with_ids)
    cut = materialize(cut.withColumn("_item", F.monotonically_increasing_id()), "pieces")
    packed = pack_items(cut.where(F.col("length") < limit).select(F.col("_item").alias("item"), "length"), limit)
    full = cut.where(F.col("length") == limit).withColumn("sequence_id", F.lit(1 << 62) + F.col("_item")).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.where(F.col("length") < limit)
    rest = rest.join(packed, rest["_item"] == packed["item"]).drop("item")
    return full.unionByName(rest).drop("_item")
