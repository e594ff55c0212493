"""Pack token sequences into windows by Karmarkar-Karp multiway differencing.

Documents are tokenised where they are read. Whole windows are cut from long
documents at once; what is left is cut into pieces, and each group of pieces is
dealt to windows by largest differencing: every piece starts as a partial
partition of the group into m windows, and the two partial partitions of the
largest imbalance are merged, the fullest windows of one with the emptiest of
the other, until one partition is left. Its windows are nearly equal. When the
fullest exceeds the capacity, m rises and the group is dealt again.

A group is a bounded number of pieces that one task read, so packing needs no
shuffle, and memory does not grow with the input.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbmeter.llm.words import give_back_memory

WINDOW = 2048
# The longest piece of a document's rest: four and more pieces share a window, so sums can be evened out.
PIECE = 512
# Pieces that are dealt together: about 350 windows, of which rounding up wastes half a window.
GROUP = 2000
TOKENIZER = "byte_bpe_50k"
END_ID = 1


def public_file(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as ``tokenizers`` gives them for the JSON file, without added special tokens.

    ``tiktoken`` runs the same vocabulary and merges about four times as fast.
    A text that holds a special token's string goes to ``tokenizers`` itself,
    which alone maps that string to one id.
    """

    def __init__(self, name: str = TOKENIZER, place=public_file):
        import json

        import public_tokenizers
        import tiktoken

        self.json = place(f"{name}.json")
        with open(place(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(self.json, encoding="utf-8") as file:
            text = file.read()
        # The list of added tokens alone; the rest is the vocabulary again.
        start = text.index("[", text.index('"added_tokens"'))
        self.special = [token["content"] for token in json.JSONDecoder().raw_decode(text, start)[0]]
        self.slow = None

    def __call__(self, text: str) -> list[int]:
        if any(token in text for token in self.special):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.json)
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@functools.lru_cache(maxsize=1)
def encoder(name: str, place) -> Encoder:
    """The encoder of this process; tasks of one worker share it."""
    made = Encoder(name, place)
    give_back_memory()
    return made


def difference(lengths: list[int], m: int) -> list[list[int]]:
    """Partition the items into ``m`` sets of nearly equal sums; the items' indexes per set.

    A partial partition is kept as its non-empty sets only: ``[(sum, sets), ...]``
    in descending order. Merging pairs the largest sums of one with the
    smallest (often empty) of the other.
    """
    # Heap entries: imbalance first; the counter settles ties and keeps results repeatable.
    heap = [(-length, i, [(length, (i,))]) for i, length in enumerate(lengths)]
    heapq.heapify(heap)
    count = len(lengths)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # Positions of b, counted from its smallest: m - len(b) empty sets come first.
        empty = m - len(b)
        merged = []
        for i, (total, members) in enumerate(a):
            if i < empty:
                merged.append((total, members))
            else:
                other, others = b[len(b) - 1 - (i - empty)]
                merged.append((total + other, (members, others)))
        left = len(b) - max(0, len(a) - empty)
        merged += b[:left]
        merged.sort(key=lambda pair: -pair[0])
        low = merged[-1][0] if len(merged) == m else 0
        heapq.heappush(heap, (low - merged[0][0], count, merged))
        count += 1
    sets = [_flat(members) for _, members in heap[0][2]] if heap else []
    return sets + [[] for _ in range(m - len(sets))]


def _flat(members) -> list[int]:
    """The indexes in nested pairs of tuples."""
    out, todo = [], [members]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo.extend(x)
        else:
            out.append(x)
    return out


def deal(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``: the count rises until the fullest one fits."""
    m = max(1, -(-sum(lengths) // capacity))
    while True:
        windows = difference(lengths, m)
        if max(sum(lengths[i] for i in w) for w in windows) <= capacity:
            return [w for w in windows if w]
        m += 1


def pieces_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    piece: int = PIECE,
    group: int = GROUP,
    tokenizer: str = TOKENIZER,
    place=public_file,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit numbers. Every document ends with
    id 1; a null or empty text has only that. ``start`` counts the document's
    ids before the piece, ``offset`` the sequence's. ``sequence_id`` is unique,
    with the number of the partition in its upper bits. Repeated rows and null
    ids are packed like any other; an empty table gives no rows. Other columns
    are not read, whatever their names.
    """
    schema = pieces_schema(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, place)
        base = TaskContext.get().partitionId() << 33
        used = 0
        done: list[tuple] = []
        waiting: list[tuple] = []

        def deal_out():
            nonlocal used
            for members in deal([len(w[2]) for w in waiting], window):
                offset = 0
                for i in sorted(members):
                    doc, start, ids, total = waiting[i]
                    done.append((doc, start, len(ids), ids.tobytes(), total, base + used, offset))
                    offset += len(ids)
                used += 1
            waiting.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[]] * 7
            done.clear()
            types = [out_id, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=schema.names
            )

        out_id = None
        for batch in batches:
            out_id = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                total, start = len(ids), 0
                while total - start >= window:
                    done.append((doc, start, window, ids[start : start + window].tobytes(), total, base + used, 0))
                    used += 1
                    start += window
                while start < total:
                    waiting.append((doc, start, ids[start : start + piece], total))
                    start += piece
                if len(waiting) >= group:
                    deal_out()
                if len(done) >= group:
                    yield flush()
        if waiting:
            deal_out()
        if done:
            yield flush()
        give_back_memory()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
