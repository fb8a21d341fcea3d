"""Files to inventories: scans, screens, censuses, fingerprints (SRC-1..9, FLT-1..8, AGG-1..4, DQ-5, AGG-23)."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions import text as T
from quarry.settings import Limits

#: Directories without first-party source, suffixes and name parts of files that are not, size limit.
EXCLUDED_DIRS = (
    ".git", ".hg", ".svn", ".idea", ".vscode", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".nox", ".eggs", "build", "dist", "site-packages",
    "venv", ".venv", "env", ".env", "virtualenv", "envs", "node_modules", "bower_components", "vendor", "third_party", "target", "out", ".gradle", "htmlcov", "_build", ".next", ".cache",
)
EXCLUDED_SUFFIXES = (".min.py", ".pyc", ".pyo", ".pyd", ".so", ".dll", ".class", ".jar")
GENERATED_MARKERS = ("_pb2.py", "_pb2_grpc.py", "_generated.py", ".g.py", "_ui.py")
MAX_FILE_BYTES = 4 * 1024 * 1024
SNIFFED_BYTES = 8192
#: Limits of an archive.
ARCHIVE_BYTES, UNPACKED_BYTES, MEMBERS, RATIO = 200 * 2**20, 2**30, 50_000, 120


def _folders(path: Column) -> Column:
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def excluded_folder(path: Column, extra: tuple[str, ...] = ()) -> Column:
    """The first folder on the path that a walk prunes, or null (FLT-1, FLT-23)."""
    skip = lambda d: d.isin(*EXCLUDED_DIRS, *extra) | (d.startswith(".") & ~d.isin(".", "..")) | d.endswith(".egg-info")
    return F.get(F.filter(_folders(path), skip), 0)


def is_test(path: Column) -> Column:
    name = F.lower(T.base_name(path))
    return name.startswith("test_") | name.endswith("_test.py") | F.exists(_folders(path), lambda d: F.lower(d).isin("test", "tests"))


def screen(path: Column, size: Column, include_tests: bool = True, max_bytes: int = MAX_FILE_BYTES, extra_dirs: tuple[str, ...] = (), languages: tuple[str, ...] | None = None) -> Column:
    """struct(reason, detail) of the first test a file fails, or null: folder, suffix, generated, language, test, size (FLT-3)."""
    name, folder = F.lower(T.base_name(path)), excluded_folder(path, extra_dirs)
    no = lambda reason, detail: F.struct(F.lit(reason).alias("reason"), detail.alias("detail"))
    any_of = lambda tests: F.array_contains(F.array(*tests), True)
    out = F.when(folder.isNotNull(), no("excluded_path", F.concat(F.lit("in "), folder, F.lit("/"))))
    out = out.when(any_of([name.endswith(s) for s in EXCLUDED_SUFFIXES]), no("disallowed_suffix", F.lit("")))
    out = out.when(any_of([name.contains(m) for m in GENERATED_MARKERS]), no("excluded_path", F.lit("generated source")))
    if languages is not None:
        out = out.when(~T.language(path).isin(*languages), no("disallowed_suffix", F.concat(F.lit("language "), T.language(path))))
    if not include_tests:
        out = out.when(is_test(path), no("excluded_path", F.lit("test code")))
    return out.when(size > max_bytes, no("member_too_large", F.concat(size.cast("string"), F.lit(f" > {max_bytes}"))))


def looks_binary(content: Column) -> Column:
    """A NUL among the first bytes (FLT-5)."""
    return F.locate("\0", F.decode(F.substring(content, 1, SNIFFED_BYTES), "ISO-8859-1")) > 0


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """UTF-8, and Latin-1 where that fails (SRC-9)."""

    def one(raw: bytes) -> str:
        try:
            return bytes(raw).decode("utf-8")
        except UnicodeDecodeError:
            return bytes(raw).decode("latin-1")

    return content.map(one, na_action="ignore")


def virtualenvs(files: DataFrame) -> DataFrame:
    """Folders that are virtual environments by their files (FLT-2): one column, folder."""
    path = F.col("path")
    cfg = files.where(T.base_name(path) == "pyvenv.cfg").select(F.regexp_replace(path, "/?pyvenv[.]cfg$", "").alias("folder"))
    activate = files.where(path.rlike("(^|/)bin/activate$")).select(F.regexp_replace(path, "/?bin/activate$", "").alias("folder"))
    lib = files.where(path.rlike("(^|/)lib/")).select(F.regexp_replace(path, "/?(?<![^/])lib/.*$", "").alias("folder")).distinct()
    return cfg.union(activate.join(lib, "folder", "left_semi")).distinct()


#: Environments that are looked for in the scan; more are met by a join.
MAX_VIRTUALENVS = 100_000


def _below(path: Column, roots: Column, n: int) -> Column:
    """Whether a path lies below one of n sorted roots that end in / and none of which begins another.

    All strings between a root and a path below it begin with that root, so the last root up to the path decides; it is
    found by halving.
    """
    steps = F.array(*[F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)])
    at = F.aggregate(steps, F.lit(0), lambda k, step: k + F.when(F.get(roots, k + step - 1) <= path, step).otherwise(0))
    return F.coalesce(F.startswith(path, F.get(roots, at - 1)), F.lit(False))


def without_virtualenvs(files: DataFrame) -> DataFrame:
    """Files outside virtual environments, told within the scan: no content is shuffled.

    The environments' folders, a bounded list, are found from paths alone first.
    """
    found = sorted(r["folder"] + "/" for r in virtualenvs(files.select("path")).limit(MAX_VIRTUALENVS + 1).collect())
    if not found:
        return files
    if found[0] == "/":  # the whole tree is one
        return files.where(F.lit(False))
    if len(found) > MAX_VIRTUALENVS:
        folders = F.transform(F.sequence(F.lit(0), F.size(_folders(F.col("path")))), lambda n: F.array_join(F.slice(_folders(F.col("path")), 1, n), "/"))
        inside = files.select("path", F.explode_outer(folders).alias("folder")).join(virtualenvs(files), "folder").select("path").distinct()
        return files.join(inside, "path", "left_anti")
    outer = found[:1]
    for r in found[1:]:
        if not r.startswith(outer[-1]):
            outer.append(r)
    (roots,) = fresh_names(files, "roots")
    table = F.broadcast(files.sparkSession.createDataFrame([(outer,)], f"{roots} array<string>"))
    slashed = F.replace("path", F.lit("\\"), F.lit("/"))
    return files.crossJoin(table).where(~_below(slashed, F.col(roots), len(outer))).drop(roots)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def _left_out(spark: SparkSession, root: str) -> tuple[list[tuple[str, str, int]], list[str]]:
    """((uri, path, size) of files that Spark's reader leaves out, paths of links) below root.

    Spark takes names that begin with an underscore or a dot for its own: packages' __init__ files are among them. Folders
    that begin with a dot stay out, as every walk prunes them. Like Spark's own listing this is a list on the driver.
    """
    base = root.removeprefix("file://").removeprefix("file:").rstrip("/")
    found, links = [], []
    if "://" not in base:
        for at, folders, names in os.walk(base):
            links += [os.path.relpath(os.path.join(at, n), base) for n in (*folders, *names) if os.path.islink(os.path.join(at, n))]
            folders[:] = [d for d in folders if not d.startswith(".") and not os.path.islink(os.path.join(at, d))]
            for n in names:
                path = os.path.relpath(os.path.join(at, n), base)
                if (n.startswith(".") or path.startswith("_") or "/_" in path) and not os.path.islink(os.path.join(at, n)):
                    found.append((os.path.join(base, path), path, os.path.getsize(os.path.join(base, path))))
        return found, links
    where = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    while files.hasNext():
        f = files.next()
        uri = f.getPath().toString()
        parts = uri[len(base) + 1 :].split("/")
        if any(p.startswith("_") for p in parts) or parts[-1].startswith("."):
            if not any(p.startswith(".") for p in parts[:-1]):
                found.append((uri, "/".join(parts), f.getLen()))
    return found, links


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uri, path, size) to (path, size, content), one file at a time."""
    from pyarrow import fs

    for batch in batches:
        for uri, path, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            where, name = fs.FileSystem.from_uri(uri)
            with where.open_input_stream(name) as f:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([f.read()], pa.binary())], ["path", "size", "content"])


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, size, content) of every file below root (SRC-2, SRC-4); links are not followed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    files = found.select(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + _escaped(base.removeprefix("file://").removeprefix("file:")), "").alias("path"), F.col("length").alias("size"), "content")
    more, links = _left_out(spark, root)
    if links:
        names = spark.createDataFrame([(x,) for x in links], "link string")
        files = files.join(F.broadcast(names), (F.col("path") == F.col("link")) | F.col("path").startswith(F.concat("link", F.lit("/"))), "left_anti")
    if more:
        files = files.union(spark.createDataFrame(more, "uri string, path string, size long").mapInArrow(_contents, "path string, size long, content binary"))
    return files


def _escaped(x: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in x)


MEMBER_DDL = "archive string, path string, size long, packed long, kind string, content binary"
_MEMBER = pa.schema([("archive", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("packed", pa.int64()), ("kind", pa.string()), ("content", pa.binary())])
#: Bytes of members that make a batch.
BATCH_BYTES = 1 << 24


def _members(name: str, raw: bytes) -> Iterator[tuple]:
    """(archive, path, size, packed, kind, content) of an archive's members; one of kind corrupt where it cannot be read."""
    budget = UNPACKED_BYTES
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for m in z.infolist():
                mode = m.external_attr >> 16 & 0o170000
                kind = "folder" if m.is_dir() else "symlink" if mode == 0o120000 else "special" if mode not in (0, 0o100000) else "file"
                safe = kind == "file" and not m.filename.startswith(("/", "\\")) and ".." not in m.filename.replace("\\", "/").split("/") and m.file_size <= min(budget, MAX_FILE_BYTES)
                content = None
                if safe:
                    with z.open(m) as f:
                        content = f.read(min(budget, MAX_FILE_BYTES) + 1)
                    budget -= len(content)
                yield name, m.filename, m.file_size, m.compress_size, kind, content
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError, ValueError) as e:
        yield name, type(e).__name__, 0, 0, "corrupt", None


def unpack(archives: DataFrame) -> DataFrame:
    """Members of zip files (path, content); contents of unsafe members and beyond the byte budget stay unread (SRC-3, FLT-8).

    An archive that cannot be read, or breaks off, gives a row of kind corrupt after the members read so far.
    """

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MEMBER, strict=True)], schema=_MEMBER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in _members(name, raw.as_py()):
                    rows.append(row)
                    held += len(row[5] or b"")
                    if held >= BATCH_BYTES or len(rows) >= 4096:
                        yield made(rows)
                        rows, held = [], 0
        if rows:
            yield made(rows)

    return archives.select("path", "content").mapInArrow(run, MEMBER_DDL)


def screen_member(path: Column, size: Column, packed: Column, kind: Column, limits: Limits | None = None) -> Column:
    """Reason to reject an archive member, or null (FLT-6)."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    largest, ratio = (limits.source_file_bytes, limits.ratio) if limits else (MAX_FILE_BYTES, RATIO)
    return (
        F.when(kind == "corrupt", "corrupt_archive")
        .when(F.trim(slashed) == "", "empty_name")
        .when(slashed.startswith("/") | slashed.rlike("^[A-Za-z]:"), "absolute_path")
        .when(F.array_contains(F.split(slashed, "/"), ".."), "path_traversal")
        .when(kind == "symlink", "symlink")
        .when(kind == "special", "special_file")
        .when(size > largest, "member_too_large")
        .when((packed > 0) & (size / F.when(packed > 0, packed) > ratio), "compression_ratio")
    )


def archive_totals(members: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Per archive: members, declared bytes, and which total limit it breaks, or null (FLT-7)."""
    most, largest, ratio = (limits.members, limits.unpacked_bytes, limits.ratio) if limits else (MEMBERS, UNPACKED_BYTES, RATIO)
    totals = members.groupBy("archive").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("declared_bytes"), F.sum("packed").alias("packed_bytes"))
    broken = F.when(F.col("members") > most, "too_many_members").when(F.col("declared_bytes") > largest, "archive_too_large").when((F.col("packed_bytes") > 0) & (F.col("declared_bytes") > ratio * F.col("packed_bytes")), "compression_ratio")
    return totals.withColumn("broken", broken)


def within_budget(files: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Marks the files of a group that fit into its running byte budget, in order (FLT-8)."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return files.withColumn("written_bytes", F.sum(size).over(w)).withColumn("fits", F.col("written_bytes") <= budget)


def inventory(files: DataFrame, max_files: int | None = None, languages: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(source files, rejections) of scanned files (SRC-6); where nothing passes, any text file does (SRC-7).

    Verdicts are taken once; the fallback is a union that reads no content unless no file passed. A cap keeps the first
    files by path.
    """
    judged = without_virtualenvs(files).withColumn("no", F.when(looks_binary(F.col("content")), F.struct(F.lit("binary").alias("reason"), F.lit("").alias("detail"))).otherwise(screen(F.col("path"), F.col("size"), languages=languages)))
    good = judged.where("no is null").drop("no")
    if good.isEmpty():
        good = files.where(~looks_binary(F.col("content")))
    if max_files is not None and good.count() > max_files:
        # the path at which the cap falls; paths alone are ordered
        last = good.select("path").orderBy("path").offset(max_files - 1).limit(1).first()["path"]
        good = good.where(F.col("path") <= last)
    sources = good.withColumn("text", decoded("content")).select("path", T.language(F.col("path")).alias("language"), F.col("size").alias("size_bytes"), T.physical_lines(F.col("text")).alias("line_count"), F.sha2("text", 256).alias("sha256"), T.package_path(F.col("path")).alias("package"), "text")
    return sources, judged.where("no is not null").select("path", "no.reason", "no.detail")


def rejections_in_order(rejected: DataFrame, k: int | None = None) -> DataFrame:
    """Rejections by reason and path (SRT-4); k of them at most (LIM-3)."""
    out = rejected.orderBy("reason", "path")
    return out if k is None else out.limit(k)


def census(files: DataFrame, project: str, language: str, size: str) -> DataFrame:
    """Per project and language: files and bytes (AGG-1)."""
    return files.groupBy(project, language).agg(F.count(F.lit(1)).alias("n_files"), F.sum(size).alias("n_bytes"))


def primary_language(files: DataFrame, project: str, language: str, size: str) -> DataFrame:
    """The language with most bytes, ties by name; unknown does not count (AGG-2)."""
    top = F.min(F.struct((-F.col("n_bytes")).alias("b"), F.col(language).alias("l")))
    known = census(files, project, language, size).withColumn("n_bytes", F.when(F.col(language) != "unknown", F.col("n_bytes")))
    return known.groupBy(project).agg(top.alias("t"), F.max("n_bytes").alias("m")).select(project, F.when(F.col("m").isNull(), "unknown").otherwise(F.col("t.l")).alias("primary_language"))


def totals(files: DataFrame, project: str, size: str, n_lines: str) -> DataFrame:
    return files.groupBy(project).agg(F.count(F.lit(1)).alias("file_count"), F.sum(size).alias("total_bytes"), F.sum(n_lines).alias("total_lines"))


def quality_warnings(totals_: DataFrame, min_files: int = 5, min_lines: int = 200) -> DataFrame:
    """Adds the warnings that a small project gives (DQ-5)."""
    said = F.array_compact(F.array(F.when(F.col("file_count") < min_files, "few_files"), F.when(F.col("total_lines") < min_lines, "few_lines")))
    return totals_.withColumn("warnings", F.array_join(said, ","))


def fingerprint(files: DataFrame, project: str, path: str, sha: str) -> DataFrame:
    """Per project the digest of its files' (path, digest) in path order (AGG-4).

    A project's files pass through one task in sorted order and are hashed as they come, so memory does not grow with
    the project; the digest itself is one sequence by its definition.
    """
    kind = files.schema[project].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, out = None, None, []
        for batch in batches:
            for name, p, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if h is None or name != now:
                    if h is not None:
                        out.append((now, h.hexdigest()))
                    now, h = name, hashlib.sha256()
                h.update(f"{p}\0{s}\0".encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.column(0).type), pa.array([r[1] for r in out], pa.string())], [project, "fingerprint"])
            out, last = [], batch
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], last.column(0).type), pa.array([h.hexdigest()])], [project, "fingerprint"])

    named = files.select(project, F.col(path).cast("string").alias("p"), F.col(sha).alias("s"))
    return named.repartition(project).sortWithinPartitions(project, "p").mapInArrow(run, f"`{project}` {kind}, fingerprint string")
