"""Operator 6: BPE encoding and decoding over a table of distinct words.

The first pass splits texts into words and writes each document as positions in its chunk's word list (a chunk is
a bounded run of documents of one task). The lists are dealt by a hash of the word into parts, so that all chunks'
entries of a word meet in one part, which is the table of its distinct words: each is encoded there once. Its ids go
back to the chunks that hold it, and the last pass joins them to the documents by position. The number of parts grows
with the documents, so that a part's table stays small. Decoding looks every id up in the vocabulary's id-to-piece
table, whose size is that of the vocabulary. No step holds more than one chunk or one part, and a frequent word is
one entry for each chunk, so neither hot words nor hot sources gather anywhere. Rows are compressed blocks of
documents or of words, which keeps what is written and shuffled well below the size of the texts: one row for each
word of a chunk would be some 20 bytes in each of three shuffles, beside 270 MB of codes for 0.5 GB of documents.

Texts whose characters are all ASCII or Latin letters are split by fast string methods; any other character sends
a text through the tokenizer's own normaliser and splitter, so both give what the tokenizers library gives.

Defined results: null text is empty and has no tokens; repeated rows give repeated rows; an empty table gives an
empty table; a document longer than a chunk is a chunk of its own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import read, text_of, written

#: A chunk closes after so many words, or so many different ones.
CHUNK_WORDS = 8_000_000
CHUNK_DISTINCT = 500_000
#: Words of the documents that share a row.
BLOCK_WORDS = 1 << 18
#: Documents for each part of the distinct words, and the least and the largest number of parts (powers of two).
PART_DOCS = 4096
PARTS = (64, 1 << 20)

_PLAIN = re.compile("[^\t-\r -~À-ɏ]")
#: The split pattern of word_bpe_49k, for plain texts.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_symbols() -> list[str]:
    """The usual byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Splitter:
    """Texts to byte-level words; special tokens are words that start with NUL."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.symbols = _byte_symbols()
        self.special = [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]
        self.marks = re.compile("|".join(f"({re.escape(s)})" for s in self.special)) if self.special else None

    def level(self, word: str) -> str:
        return word if word.isascii() else "".join([self.symbols[b] for b in word.encode()])

    def plain(self, token: str) -> list[str]:
        """The words of a token without white space, of plain characters and lower case."""
        return [self.level(w) for w in _SPLIT.findall(token)]

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """(is plain, part) for the stretches between special tokens, which come as words."""
        if self.marks is None or "<|" not in text:
            return [(_PLAIN.search(text) is None, text)]
        return [(s in self.special or _PLAIN.search(s) is None, s) for s in self.marks.split(text) if s]

    def other(self, text: str) -> list[str]:
        return [w for w, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))]


def _planes(values: np.ndarray) -> bytes:
    """32-bit values by significance of their bytes, compressed: small values then cost little."""
    return zstandard.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


#: A row is a block of documents (doc_ids, sizes, codes) or the part of a chunk's words that one task encodes (codes, data).
_BLOCK = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()), ("data", pa.binary())])
_BLOCK_DDL = "chunk long, part int, doc_ids array<long>, sizes array<int>, codes binary, data binary"


def _chunks(path: str, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(path)
        task = TaskContext.get().partitionId() << 24
        words: dict[str, int] = {}

        class Codes(dict):
            """Codes of the words of a white-space token."""

            def __missing__(self, token: str) -> tuple[int, ...]:
                self[token] = out = tuple([words.setdefault(w, len(words)) for w in split.plain(token)])
                return out

        codes = Codes()

        def of(text: str) -> np.ndarray:
            out = []
            for plain, part in split.parts(text):
                if part in split.special:
                    out.append([words.setdefault("\0" + part, len(words))])
                elif plain:
                    out.append(chain.from_iterable(map(codes.__getitem__, part.lower().split())))
                else:
                    out.append([words.setdefault(w, len(words)) for w in split.other(part)])
            return np.fromiter(chain.from_iterable(out), np.uint32)

        chunk, seen = 0, 0
        ids: list = []
        rows: list[np.ndarray] = []

        def closed() -> Iterator[pa.RecordBatch]:
            """The chunk's documents in blocks, then its words by the task that encodes them, which depends on the word alone.

            Codes are ranks by frequency: most are small then, and compress well.
            """
            every = np.concatenate(rows)
            order = np.argsort(-np.bincount(every, minlength=len(words)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            every, ends = rank[every], np.cumsum([len(r) for r in rows])
            at, first = 0, 0
            for i in range(len(rows)):
                if ends[i] - at >= BLOCK_WORDS or i + 1 - first >= BLOCK_WORDS // 64 or i + 1 == len(rows):
                    yield _batch([(task | chunk, -1, ids[first : i + 1], [len(r) for r in rows[first : i + 1]], _planes(every[at : ends[i]]), None)], _BLOCK)
                    at, first = ends[i], i + 1
            named = list(words)
            bins: list[list[str]] = [[] for _ in range(parts)]
            codes_of: list[list[int]] = [[] for _ in range(parts)]
            for code, i in enumerate(order.tolist()):
                p = zlib.crc32(named[i].encode()) % parts
                bins[p].append(named[i])
                codes_of[p].append(code)
            for p in range(parts):
                if bins[p]:
                    yield _batch([(task | chunk, p, None, None, _planes(np.diff(np.array(codes_of[p]), prepend=0)), zstandard.compress("\n".join(bins[p]).encode(), 12))], _BLOCK)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = of(text)
                ids.append(i)
                rows.append(c)
                seen += len(c)
                if seen >= CHUNK_WORDS or len(codes) >= CHUNK_DISTINCT or len(words) >= CHUNK_DISTINCT:
                    yield from closed()
                    words.clear()
                    codes.clear()
                    ids, rows, seen, chunk = [], [], 0, chunk + 1
        if ids:
            yield from closed()

    return run


def _encode(path: str):
    """Word lists sorted by part to id lists; the distinct words of one part are held, and each is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        model = tok.model

        class Ids(dict):
            """Ids of the distinct words of a part."""

            def __missing__(self, w: str) -> list[int]:
                self[w] = out = [tok.token_to_id(w[1:])] if w[0] == "\0" else [t.id for t in model.tokenize(w)]
                return out

        ids, now = Ids(), -1
        for batch in batches:
            for chunk, part, codes, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "part", "codes", "data")), strict=True):
                if part != now:
                    ids, now = Ids(), part
                got = list(map(ids.__getitem__, zstandard.decompress(data).decode().split("\n")))
                sizes = np.fromiter(map(len, got), np.uint32, len(got))
                yield _batch([(chunk, 0, None, None, codes, _planes(np.concatenate([sizes, np.fromiter(chain.from_iterable(got), np.uint32)])))], _BLOCK)

    return run


def _joined(path: str, digest: bool):
    """Chunks, each with its words before its documents, to ids and decoded texts (or their digests)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        pieces: list[bytes] = [(tok.id_to_token(i) or "").encode() for i in range(tok.get_vocab_size())]
        now = None
        ids_of: dict[int, bytes] = {}
        pieces_of: dict[int, bytes] = {}

        def learn(codes: bytes, data: bytes) -> None:
            at = np.cumsum(_unplanes(codes).astype(np.int64)).tolist()
            both = _unplanes(data)
            ends = np.cumsum(both[: len(at)].astype(np.int64)).tolist()
            ids = both[len(at) :]
            raw, names, start = ids.astype("<u4").tobytes(), [pieces[i] for i in ids.tolist()], 0
            for code, end in zip(at, ends, strict=True):
                ids_of[code] = raw[4 * start : 4 * end]
                pieces_of[code] = names[start] if end - start == 1 else b" ".join(names[start:end])
                start = end

        for batch in batches:
            out: list[tuple] = []
            size = 0
            for chunk, docs, sizes, codes, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "doc_ids", "sizes", "codes", "data")), strict=True):
                if chunk != now:
                    now = chunk
                    ids_of, pieces_of = {}, {}
                if docs is None:
                    learn(codes, data)
                    continue
                at, start = _unplanes(codes).tolist(), 0
                for d, n in zip(docs, sizes, strict=True):
                    mine = at[start : start + n]
                    start += n
                    a, b = b"".join(map(ids_of.__getitem__, mine)), b" ".join(map(pieces_of.__getitem__, mine))
                    out.append((d, len(a) // 4, hashlib.sha256(a).hexdigest(), hashlib.sha256(b).hexdigest()) if digest else (d, len(a) // 4, a, b.decode()))
                    size += 0 if digest else len(a) + len(b)
                    if size > 1 << 25:
                        yield _rows(out, digest)
                        out, size = [], 0
            if out:
                yield _rows(out, digest)

    return run


def _rows(out: list[tuple], digest: bool) -> pa.RecordBatch:
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "n_tokens", "ids", "decoded"]
    return _batch(out, pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string() if digest else pa.binary(), pa.string()), strict=True))))


def parts_of(n_docs: int) -> int:
    """Into how many parts the distinct words of so many documents are dealt."""
    return min(PARTS[1], max(PARTS[0], 1 << (n_docs // PART_DOCS).bit_length()))


def encode(docs: DataFrame, path: str | None = None, digest: bool = False, parts: int | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, ids (little-endian 32-bit) and decoded text, or their digests.

    parts: into how many parts the distinct words are dealt for encoding; else their number follows that of docs.
    """
    path = path or default_tokenizer()
    parts = parts or parts_of(docs.count())
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    chunks = written(texts.mapInArrow(_chunks(path, parts), _BLOCK_DDL), "chunks", compression="uncompressed")
    words = chunks.where("part >= 0").repartition("part").sortWithinPartitions("part")
    blocks = chunks.where("part < 0").union(words.mapInArrow(_encode(path), _BLOCK_DDL))
    met = blocks.repartition("chunk").sortWithinPartitions("chunk", F.col("doc_ids").isNotNull())
    return met.mapInArrow(_joined(path, digest), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, n_tokens long, ids binary, decoded string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), digest=True)
