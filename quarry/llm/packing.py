"""Operator 3: token ids packed into fixed-length rows by best-fit decreasing, with capacity search in a segment tree.

Texts become byte-level BPE ids; a document longer than a row is split into parts, so every id is written once. Each
task packs bounded runs of parts (longest first, each into the fullest row that still has room) and writes rows of
exactly row_length ids: the id matrix as little-endian 32-bit integers, cumulative segment lengths, and positions
that restart with every segment. Nothing is shuffled, so no key, however frequent, gathers anywhere.

Defined results: a null or empty text has no ids and is in no row; padding ids follow the last segment and belong to
none; repeated rows are packed each; documents without doc_id keep a null id; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import read, text_of

ROW_LENGTH = 2048
#: Ids that are packed together; bounds a worker's memory.
RUN_IDS = 4_000_000


class CapacityTree:
    """Open rows by the room they have left; finds the least room of at least a size in logarithmic time."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(row, room) with the least room >= size, removed; None where no row has it."""
        if size >= len(self.rows):
            return None
        i = self.leaves + size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows as lists of item numbers; every size is in 1..length, ties go by number."""
    tree, rows = CapacityTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = tree.take(sizes[i])
        row, room = got if got else (len(rows), length)
        if not got:
            rows.append([])
        rows[row].append(i)
        if room > sizes[i]:
            tree.put(row, room - sizes[i])
    return rows


class Encoder:
    """Byte-level BPE by ranks, with ids straight into arrays; there are no special tokens."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.bpe = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, disallowed_special=())


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


PACKED = "pack_id string, ids binary, cu_seqlens array<int>, positions binary, segments array<struct<doc_id:bigint,part:int,n_parts:int>>, n_ids int"
_SCHEMA = pa.schema([("pack_id", pa.string()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("positions", pa.binary()), ("segments", pa.list_(pa.struct([("doc_id", pa.int64()), ("part", pa.int32()), ("n_parts", pa.int32())]))), ("n_ids", pa.int32())])


def _pack(path: str, length: int, pad: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, runs = Encoder(path), TaskContext.get().partitionId(), 0
        parts: list[tuple[int | None, int, int, np.ndarray]] = []
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            made = best_fit_decreasing([len(p[3]) for p in parts], length)
            count = np.arange(length, dtype="<u4")
            for at in range(0, len(made), 256):
                out: list[list] = [[] for _ in _SCHEMA]
                for k, members in enumerate(made[at : at + 256], at):
                    ids, pos, ends = np.full(length, pad, "<u4"), np.zeros(length, "<u4"), [0]
                    for i in members:
                        n, start = len(parts[i][3]), ends[-1]
                        ids[start : start + n] = parts[i][3]
                        pos[start : start + n] = count[:n]
                        ends.append(start + n)
                    named = [{"doc_id": d, "part": j, "n_parts": n} for d, j, n, _ in (parts[i] for i in members)]
                    for column, v in zip(out, (f"{task}-{runs}-{k}", ids.tobytes(), ends, pos.tobytes(), named, ends[-1]), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(text)
                n = -(-len(ids) // length)
                parts += [(doc, j, n, ids[j * length : (j + 1) * length]) for j in range(n)]
                held += len(ids)
                if held >= RUN_IDS:
                    yield from rows()
                    parts, held, runs = [], 0, runs + 1
        if parts:
            yield from rows()

    return run


def pack(docs: DataFrame, row_length: int = ROW_LENGTH, ranks: str | None = None, pad_id: int = 0) -> DataFrame:
    """Packed rows of docs (doc_id, text): pack_id, ids, cu_seqlens, positions, segments, n_ids (without padding)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    return texts.mapInArrow(_pack(ranks or default_ranks(), row_length, pad_id), PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet files of fixed-size binary rows: one id matrix row and one position row each."""
    packed.write.mode("error").parquet(path)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
