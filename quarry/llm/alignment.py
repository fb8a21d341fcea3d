"""Operator 13: two tokenizers' tokens of one text held against each other, relationally.

Both vocabularies end a token before a space or a line feed that follows a visible character, and what follows does
not change what stands before. So a text is a sequence of units (a space or line feed with what it leads to), each
tokenized alike wherever it occurs, and no token, group or link crosses a unit: the relations are built once for each
distinct unit of the corpus instead of once for each of its occurrences (134 million against some 5 million in 0.5 GB).

Over the table of distinct units: posexplode tokens; ends are windowed sums of token lengths; an equi-join on (unit,
end) of both sides keeps every end; where both sides end is a cut, and the running count of cuts is the group id;
within a group, an end belongs to the first token of each side that ends there or later, which pairs exactly the
tokens whose ranges overlap (a stretch between neighbouring ends lies in one token of either side), so links need no
range join whose pairs could multiply in a long group. Links are counted by id pair, weighted by how often a unit
occurs, and each B id's highest count is joined to them.

Texts reach the units as operator 6 does it: tasks write documents as positions in their own word lists, the lists are
dealt by a hash of the unit into parts, a part numbers and tokenizes its distinct units, and the values of the units
go back to the lists and from there to the documents. No step holds more than one list or one part.

Defined results: null and empty texts, and texts that one side does not reproduce byte for byte (such as those with
U+2581), have no tokens: zeros and ''; they count in no pair. Repeated rows give repeated rows and count each; a null
doc_id keeps its row; equal highest counts are all best; an empty table gives an empty table; extra columns are
ignored. Texts are read whole; a text without spaces is one unit.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.bpe import _PLAIN, _batch, _byte_symbols, _planes, _unplanes
from quarry.llm.common import broadcast_if_small, read, text_of, written

#: A task's word list closes after so many units, so many different ones, or so many bytes of different ones.
CHUNK_UNITS = 8_000_000
CHUNK_DISTINCT = 250_000
CHUNK_BYTES = 1 << 25
#: Units of the documents that share a row.
BLOCK_UNITS = 1 << 18
#: Documents for each part of the distinct units, and the least and the largest number of parts (powers of two).
PART_DOCS = 1024
PARTS = (64, 1 << 20)
#: Units that are tokenized in one call, and documents that are read at once.
CALL = 2048
READ = 128
#: Units whose values share a row on their way to a part.
VALUES = 1 << 15

_CUTS = re.compile(r"(?<=\S)(?=[ \n])")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Both tokenizers: the bytes of their tokens, and their ids of units."""

    def __init__(self, a: str, b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte = {s: i for i, s in enumerate(_byte_symbols())}
        self.bytes_a = [bytes(byte[c] for c in t) if t and all(c in byte for c in t) else (t or "").encode() for t in map(self.a.id_to_token, range(self.a.get_vocab_size()))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.space = self.b.piece_to_id("▁")

    def ids_a(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]

    def ids_b(self, units: list[str]) -> list[list[int]]:
        """B puts a space in front by itself: the unit's own, or one that is left out again before a line feed."""
        out = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [[self.space] if u == " " else ids if u[0] == " " else ids[1:] for u, ids in zip(units, out, strict=True)]

    def same(self, unit: str) -> bool:
        """Whether both sides' tokens give the unit back."""
        raw = unit.encode()
        return b"".join(self.bytes_a[i] for i in self.ids_a([unit])[0]) == raw == b"".join(self.bytes_b[i] for i in self.ids_b([unit])[0])


def _short(unit: str) -> str:
    """A unit without its one leading space; units that lead with more, or with a line feed, stay as they are."""
    return unit[1:] if unit[0] == " " and unit[1:2] not in (" ", "\n") else unit


def _long(short: str) -> str:
    return short if short[:1] in (" ", "\n") and short else " " + short


def units(text: str) -> list[str]:
    """The units of space + text."""
    return _CUTS.split(" " + text)


def _struct(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(fields))


#: Blocks of documents (doc_ids, sizes, codes) and, with part >= 0, the part of a list's units (codes, lens, counts, data).
_CHUNK = _struct(("chunk", pa.int64()), ("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()), ("lens", pa.binary()), ("counts", pa.binary()), ("data", pa.binary()))
_CHUNK_DDL = "chunk long, part int, doc_ids array<long>, sizes array<int>, codes binary, lens binary, counts binary, data binary"
#: Distinct units (unit, n, a, b) and, with chunk set, which of a part's units a list holds (codes, units).
_UNIT = _struct(("chunk", pa.int64()), ("part", pa.int32()), ("codes", pa.binary()), ("units", pa.binary()), ("unit", pa.int64()), ("n", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())))
_UNIT_DDL = "chunk long, part int, codes binary, units binary, unit long, n long, a array<int>, b array<int>"
#: Values of units by their place in codes: one row of six numbers for each, and the texts of their groups.
_VALUE = _struct(("chunk", pa.int64()), ("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()), ("numbers", pa.binary()), ("groups", pa.binary()))
_VALUE_DDL = "chunk long, part int, doc_ids array<long>, sizes array<int>, codes binary, numbers binary, groups binary"
#: n_a, n_b, n_groups, n_links, n_best, count_sum.
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _packed(table: np.ndarray) -> bytes:
    """Rows of SUMS, by column and significance of their bytes, compressed."""
    return zstandard.compress(np.ascontiguousarray(table, "<i8").view(np.uint8).T.tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8 * len(SUMS), -1).T).view("<i8")


def _chunks(paths: tuple[str, str], parts: int):
    """Documents as positions in word lists, and the lists dealt into parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24
        pair: list[Pair] = []

        class Codes(dict):
            """Codes of units without their space; -1 where the next cut would be none, -2 where a side fails."""

            held = 0
            names: list[str] = []

            def code(self, short: str) -> int:
                if _PLAIN.search(short):
                    if not pair:
                        pair.append(Pair(*paths))
                    if not pair[0].same(_long(short)):
                        return -2
                self.names.append(short)
                self.held += len(short)
                return len(self.names) - 1

            def __missing__(self, short: str) -> int:
                odd = short in ("", "\n") or short[-1].isspace()
                self[short] = out = -1 if odd else self.code(short)
                return out

        slow: dict[str, int] = {}
        codes = Codes()
        codes.names = []

        def of(text: str) -> np.ndarray:
            """A text's codes; none where a side fails."""
            if not text:
                return np.empty(0, np.uint32)
            got = np.array(list(map(codes.__getitem__, text.replace("\n", " \n").split(" "))), np.int64)
            low = got.min()
            if low == -1 or (low < 0 and (got == -1).any()):
                out = []
                for s in map(_short, units(text)):
                    c = codes.get(s, -1)
                    if c == -1:
                        c = slow.get(s, -1)
                        if c == -1:
                            slow[s] = c = codes.code(s)
                    out.append(c)
                got = np.array(out, np.int64)
                low = got.min()
            return got.astype(np.uint32) if low >= 0 else np.empty(0, np.uint32)

        chunk, seen = 0, 0
        ids: list = []
        rows: list[np.ndarray] = []

        def closed() -> Iterator[pa.RecordBatch]:
            """Codes are ranks by frequency: most are small then, and compress well."""
            sizes = [len(r) for r in rows]
            every = np.concatenate(rows)
            rows.clear()
            counts = np.bincount(every, minlength=len(codes.names))
            order = np.argsort(-counts, kind="stable")
            order = order[: np.count_nonzero(counts)]
            rank = np.zeros(len(counts), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            every, ends = rank[every], np.cumsum(sizes)
            at, first = 0, 0
            for i in range(len(sizes)):
                if ends[i] - at >= BLOCK_UNITS or i + 1 - first >= BLOCK_UNITS // 64 or i + 1 == len(sizes):
                    yield _batch([(task | chunk, -1, ids[first : i + 1], sizes[first : i + 1], _planes(every[at : ends[i]]), None, None, None)], _CHUNK)
                    at, first = ends[i], i + 1
            named = [codes.names[i].encode() for i in order.tolist()]
            part = np.fromiter(map(zlib.crc32, named), np.uint32, len(named)) % parts
            by_part = np.argsort(part, kind="stable")
            for mine in np.split(by_part, np.flatnonzero(np.diff(part[by_part])) + 1) if len(named) else []:
                words = [named[i] for i in mine.tolist()]
                lens = np.fromiter(map(len, words), np.uint32, len(words))
                yield _batch([(task | chunk, int(part[mine[0]]), None, None, _planes(np.diff(mine, prepend=0)), _planes(lens), _planes(counts[order[mine]]), zstandard.compress(b"".join(words), 6))], _CHUNK)

        for batch in (b.slice(at, READ) for b in batches for at in range(0, b.num_rows, READ)):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = of(text)
                ids.append(i)
                rows.append(c)
                seen += len(c)
                if seen >= CHUNK_UNITS or len(codes.names) >= CHUNK_DISTINCT or codes.held >= CHUNK_BYTES:
                    yield from closed()
                    codes, slow = Codes(), {}
                    codes.names = []
                    ids, rows, seen, chunk = [], [], 0, chunk + 1
        if ids:
            yield from closed()
        pa.default_memory_pool().release_unused()

    return run


def _numbered(paths: tuple[str, str]):
    """Word lists sorted by part to the part's distinct units, numbered, counted and tokenized, and the lists in these numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(*paths)
        known: dict[bytes, int] = {}
        counts = np.zeros(0, np.int64)
        now = -1

        def told() -> Iterator[pa.RecordBatch]:
            names = list(known)
            for at in range(0, len(names), CALL):
                some = [_long(w.decode()) for w in names[at : at + CALL]]
                n = len(some)
                a, b = pair.ids_a(some), pair.ids_b(some)
                lists = [pa.array(x, pa.list_(pa.int32())) for x in (a, b)]
                unit = (np.int64(now) << 32) + np.arange(at, at + n)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(unit), pa.array(counts[at : at + n]), *lists], schema=_UNIT)

        for batch in (b.slice(at, READ) for b in batches for at in range(0, b.num_rows, READ)):
            for chunk, part, codes, lens, seen, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "part", "codes", "lens", "counts", "data")), strict=True):
                if part != now:
                    yield from told()
                    known, counts, now = {}, np.zeros(0, np.int64), part
                raw, ends = zstandard.decompress(data), np.cumsum(_unplanes(lens).astype(np.int64)).tolist()
                words = [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)]
                at = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
                if len(known) > len(counts):
                    counts = np.concatenate([counts, np.zeros(max(len(known), 2 * len(counts)) - len(counts), np.int64)])
                counts[at] += _unplanes(seen)  # a list holds a unit once
                yield _batch([(chunk, part, codes, _planes(at), None, None, None, None)], _UNIT)
        yield from told()
        pa.default_memory_pool().release_unused()

    return run


def _valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links in order of (unit, end), a unit's rows together, to values in blocks by part."""
    blocks: dict[int, tuple[list[int], list[tuple], list[str]]] = {}
    held = 0

    def packed(part: int) -> pa.RecordBatch:
        numbers, sums, groups = blocks.pop(part)
        return _batch([(None, part, None, None, _planes(np.array(numbers)), _packed(np.array(sums)), zstandard.compress("\n".join(groups).encode(), 3))], _VALUE)

    rest: list[np.ndarray] = []
    columns = ("unit", "a", "b", "g", "ends", "n", "top")

    def take(rows: list[np.ndarray]) -> None:
        nonlocal held
        unit, a, b, g, ends, n, top = rows
        starts = np.flatnonzero(np.diff(unit, prepend=-1))
        sums = np.stack([np.add.reduceat(x, starts) for x in (ends & 1, ends >> 1, (ends == 3).astype(np.int64), np.ones_like(n), (n == top).astype(np.int64), n)], 1)
        texts_a, texts_b = a.astype("U").tolist(), b.astype("U").tolist()
        ends, bounds = ends.tolist(), [*starts.tolist(), len(unit)]
        for k, u in enumerate(unit[starts].tolist()):
            out, xs, ys = [], [], []
            for i in range(bounds[k], bounds[k + 1]):
                e = ends[i]
                if e & 1:
                    xs.append(texts_a[i])
                if e & 2:
                    ys.append(texts_b[i])
                if e == 3:
                    out.append(f"{','.join(xs)}|{','.join(ys)}")
                    xs, ys = [], []
            numbers, all_sums, groups = blocks.setdefault(u >> 32, ([], [], []))
            numbers.append(u & 0xFFFFFFFF)
            all_sums.append(sums[k])
            groups.append(";".join(out))
        held += len(starts)

    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]
        rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)] if rest else rows
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(-(rows[0] != rows[0][-1]).astype(np.int8), 0))  # the last unit may go on
        if cut:
            take([x[:cut] for x in rows])
        rest = [x[cut:] for x in rows]
        if held >= VALUES * 4:
            yield from map(packed, list(blocks))
            held = 0
    if rest:
        take(rest)
    yield from map(packed, list(blocks))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's values, then the lists' units of the part, to the values of each list's units."""
    now = -1
    place: dict[int, int] | np.ndarray = np.zeros(0, np.int64)
    sums: list[np.ndarray] = []
    groups: list[str] = []
    ready = False

    for batch in (b.slice(at, READ) for b in batches for at in range(0, b.num_rows, READ)):
        for chunk, part, codes, numbers, texts, mine in zip(*(batch.column(c).to_pylist() for c in ("chunk", "part", "codes", "numbers", "groups", "units")), strict=True):
            if part != now:
                now, sums, groups, at, ready = part, [], [], [], False
            if chunk is None:
                at.append(_unplanes(codes).astype(np.int64))
                sums.append(_unpacked(numbers))
                groups += zstandard.decompress(texts).decode().split("\n")
                continue
            if not ready:
                every = np.concatenate(at)
                place = np.zeros(len(every), np.int64)
                place[every] = np.arange(len(every))
                table, ready = np.concatenate(sums), True
            got = place[_unplanes(mine).astype(np.int64)]
            yield _batch([(chunk, part, None, None, codes, _packed(table[got]), zstandard.compress("\n".join([groups[i] for i in got.tolist()]).encode(), 3))], _VALUE)


def _told(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """Chunks, each with the values of its list before its documents, to results of documents."""
    now = None
    groups: list[str] = []
    for batch in (b.slice(at, 1) for b in batches for at in range(b.num_rows)):
        for chunk, docs, sizes, codes, numbers, texts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "doc_ids", "sizes", "codes", "numbers", "groups")), strict=True):
            if chunk != now:
                now, groups, table = chunk, [], np.zeros((len(SUMS), 0), np.int64)
            if docs is None:
                at = np.cumsum(_unplanes(codes).astype(np.int64))
                sums = _unpacked(numbers)
                size = max(table.shape[1], int(at[-1]) + 1)
                if size > table.shape[1]:
                    size = max(size, 2 * table.shape[1])
                    table = np.concatenate([table, np.zeros((len(SUMS), size - table.shape[1]), np.int64)], 1)
                    groups += [""] * (size - len(groups))
                table[:, at] = sums.T
                for i, g in zip(at.tolist(), zstandard.decompress(texts).decode().split("\n"), strict=True):
                    groups[i] = g
                continue
            every, lens = _unplanes(codes).astype(np.int64), np.array(sizes, np.int64)
            ends = np.cumsum(lens)
            sums = []
            for row in table:
                total = np.concatenate([[0], np.cumsum(row[every])])
                sums.append(total[ends] - total[ends - lens])
            words, start, said = every.tolist(), 0, []
            for end in ends.tolist():
                text = ";".join(map(groups.__getitem__, words[start:end]))
                said.append(hashlib.sha256(text.encode()).hexdigest() if digest and end > start else text)
                start = end
            names = ["doc_id", *SUMS, "groups_sha256" if digest else "groups"]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *map(pa.array, sums), pa.array(said, pa.string())], names)


@contextmanager
def _by_unit(spark: SparkSession):
    """Within: joins of rows that lie by unit keep their place though they also compare the end, and sorted rows are collected as they come."""
    with _set(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.useObjectHashAggregateExec": "false"}):
        yield


@contextmanager
def _set(spark: SparkSession, wanted: dict[str, str]):
    """Settings that hold within, for tables that are written there."""
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def vocabularies(spark: SparkSession, paths: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """(id, len) in bytes of each side's tokens: two tables of the vocabularies' sizes."""
    pair = Pair(*paths)
    return tuple(spark.createDataFrame([(i, len(t)) for i, t in enumerate(side)], "id int, len int") for side in (pair.bytes_a, pair.bytes_b))


def _side(tokens: DataFrame, ids: str, sizes: DataFrame, *more: str) -> DataFrame:
    """One side's tokens as (unit, end, id): posexplode, lengths of ids, windowed sums."""
    rows = tokens.select("unit", *more, F.posexplode(ids).alias("pos", "id")).join(F.broadcast(sizes), "id")
    order = Window.partitionBy("unit").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("unit", *more, F.col("id").alias(ids), F.sum("len").over(order).alias("end"))


def links(tokens: DataFrame, sizes_a: DataFrame, sizes_b: DataFrame) -> DataFrame:
    """Per unit of tokens (unit, n, a ids, b ids): n and its links in order of ends, array<struct<a, b, g, ends>>.

    a and b are the ids of the tokens that a link joins, g is its group, counted from the last, and ends says whose
    token ends with the link: 1 A's, 2 B's, 3 both, where a group ends.
    """
    tokens = tokens.repartition("unit")
    both = _side(tokens, "a", sizes_a, "n").join(_side(tokens, "b", sizes_b), ["unit", "end"], "full")
    back = Window.partitionBy("unit").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    ends = F.col("a").isNotNull().cast("int") + 2 * F.col("b").isNotNull().cast("int")
    rows = both.select(
        "unit",
        F.col("n"),
        F.last("a", ignorenulls=True).over(back).alias("a"),
        F.last("b", ignorenulls=True).over(back).alias("b"),
        F.sum((ends == 3).cast("int")).over(back).cast("int").alias("g"),
        ends.cast("byte").alias("ends"),
        "end",
    )
    return rows.groupBy("unit").agg(F.max("n").alias("n"), F.collect_list(F.struct("end", "a", "b", "g", "ends")).alias("links")).select("unit", "n", F.array_sort("links").alias("links"))


def pair_counts(linked: DataFrame) -> DataFrame:
    """Per pair of ids that links join: a, b, n (links of the whole corpus) and top, the highest n of the B id."""
    pairs = linked.select("n", F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum("n").alias("n"))
    return pairs.join(pairs.groupBy("b").agg(F.max("n").alias("top")), "b").select("a", "b", "n", "top")


def parts_of(n_docs: int) -> int:
    """Into how many parts the distinct units of so many documents are dealt."""
    return min(PARTS[1], max(PARTS[0], 1 << (n_docs // PART_DOCS).bit_length()))


def align(docs: DataFrame, paths: tuple[str, str] | None = None, digest: bool = False, parts: int | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and the groups, or their digest."""
    spark, paths = docs.sparkSession, paths or default_tokenizers()
    parts = parts or parts_of(docs.count())
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    with _set(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}):
        chunks = written(texts.mapInArrow(_chunks(paths, parts), _CHUNK_DDL), "lists", compression="uncompressed")
    lists = chunks.where("part >= 0").drop("doc_ids", "sizes").repartition("part").sortWithinPartitions("part")
    numbered = written(lists.mapInArrow(_numbered(paths), _UNIT_DDL), "units", compression="zstd")
    with _by_unit(spark):
        linked = written(links(numbered.where("chunk is null").select("unit", "n", "a", "b"), *vocabularies(spark, paths)), "links", compression="zstd")
    pairs = written(pair_counts(linked), "pairs")
    rows = linked.select("unit", F.explode("links").alias("l")).select("unit", "l.*")
    small = broadcast_if_small(pairs)
    rows = rows.join(small, ["a", "b"])
    if small is pairs:  # a shuffled join
        rows = rows.repartition("unit").sortWithinPartitions("unit", "end")
    values = rows.select("unit", "a", "b", "g", "ends", "n", "top").mapInArrow(_valued, _VALUE_DDL)
    none = F.lit(None).cast("binary")
    mine = numbered.where("chunk is not null").select("chunk", "part", "codes", none.alias("numbers"), none.alias("groups"), "units")
    met = values.select("chunk", "part", "codes", "numbers", "groups", none.alias("units")).union(mine).repartition("part").sortWithinPartitions("part", F.col("chunk").isNotNull())
    back = chunks.where("part < 0").select("chunk", "part", "doc_ids", "sizes", "codes", none.alias("numbers"), none.alias("groups")).union(met.mapInArrow(_met, _VALUE_DDL))
    out = back.repartition("chunk").sortWithinPartitions("chunk", F.col("doc_ids").isNotNull())
    return out.mapInArrow(partial(_told, digest=digest), f"doc_id long, {', '.join(f'{s} long' for s in SUMS)}, {'groups_sha256' if digest else 'groups'} string")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents"), digest=True)
