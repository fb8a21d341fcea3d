"""Sources of any shape to one table of files: folders, zip archives, single files, repositories, uploads (SRC-1, SRC-3..5, SRC-8, SRC-16, SRC-18, SRC-19, FLT-10, AGG-23)."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
import uuid
import zipfile
from dataclasses import dataclass, field
from pathlib import Path
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import QuarryError, require
from quarry.settings import Limits
from quarry.sources import inventory as I

#: Folders that mark a project's root rather than wrap it.
SOURCE_ROOTS = ("src", "source", "sources", "lib", "app", "main", "python", "java")
CLONE_ATTEMPTS = 3
CHUNK = 1 << 20


@dataclass(frozen=True)
class Source:
    """What an intake gives: files (path, size, content), refusals (path, reason, detail), and where it came from."""

    name: str
    kind: str
    origin: str
    files: DataFrame
    rejected: DataFrame
    warnings: tuple[str, ...] = field(default=())


def safe_name(raw: str, limit: int = 80) -> str:
    """A name for paths: runs of other characters become one dash."""
    return re.sub(r"[^A-Za-z0-9._-]+", "-", raw).strip("-.")[:limit] or "project"


def is_address(source: str) -> bool:
    return bool(re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://", source)) and not source.startswith("file://")


def contained(base: str, candidate: str) -> Path:
    """The candidate below base; a path that leaves base is an error (FLT-10)."""
    root = Path(base).resolve()
    path = (root / candidate).resolve()
    require(path == root or root in path.parents, "path_escape", "the path leaves its folder", base=str(root), path=candidate)
    return path


def used_bytes(files: DataFrame) -> int:
    """Size of all files (AGG-23)."""
    return files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def unwrapped(files: DataFrame) -> DataFrame:
    """Files with the one folder that wraps them all taken off their paths, unless it is a source root by name (SRC-8).

    Hidden entries at the top do not count. Three entries at most come to the driver.
    """
    top = files.select(F.split("path", "/").alias("p")).select(F.get("p", 0).alias("entry"), (F.size("p") > 1).alias("folder")).where(~F.col("entry").startswith(".")).distinct().limit(3).collect()
    if len(top) != 1 or not top[0]["folder"] or top[0]["entry"].lower() in SOURCE_ROOTS:
        return files
    prefix = top[0]["entry"] + "/"
    return files.where(F.col("path").startswith(prefix)).withColumn("path", F.substr("path", F.lit(len(prefix) + 1)))


def _refusals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "path string, reason string, detail string")


def placed(spark: SparkSession, path: Path, shared: bool | None = None) -> str:
    """Where executors find what the driver has at a local path: there in a local session, else copied below the folder of
    spark.checkpoint.dir, which driver and executors share."""
    sc = spark.sparkContext
    if shared is None:
        shared = not sc.master.startswith("local") or sc.master.startswith("local-cluster")
    if not shared:
        return str(path)
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    require(where, "workspace_error", "spark.checkpoint.dir must name a folder that driver and executors share")
    to = spark._jvm.org.apache.hadoop.fs.Path
    target = to(f"{where}/intake-{uuid.uuid4().hex}/{path.name}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.setWriteChecksum(False)  # else a shared local folder gets a hidden file beside each
    try:
        fs.copyFromLocalFile(to(path.as_uri()), target)
    finally:
        fs.setWriteChecksum(True)
    return target.toString()


def folder(spark: SparkSession, path: str) -> Source:
    """A folder, read where it is (SRC-2)."""
    require(Path(path).is_dir(), "unsupported_source", "not a folder", path=path)
    root = str(Path(path).resolve())
    return Source(safe_name(Path(root).name), "directory", root, unwrapped(I.scan(spark, root)), _refusals(spark))


def archive(spark: SparkSession, path: str, limits: Limits = Limits()) -> Source:
    """The members of one zip archive (SRC-3). Totals are checked before any member is used; refused members are listed."""
    require(Path(path).suffix.lower() in limits.archive_suffixes, "unsupported_source", "unsupported archive", suffix=Path(path).suffix)
    require(Path(path).stat().st_size <= limits.archive_bytes, "archive_too_large", "the archive is too large", size=Path(path).stat().st_size)
    require(Path(path).stat().st_size > 0, "corrupt_archive", "the archive is empty", archive=Path(path).name)
    members = I.unpack(spark.read.format("binaryFile").load(placed(spark, Path(path).resolve()))).cache()
    broken = members.where("kind = 'corrupt'").select("path").take(1)
    require(not broken, "corrupt_archive", "the archive cannot be read", archive=Path(path).name)
    total = I.archive_totals(members, limits).first()
    require(total is None or total["broken"] is None, "archive_too_large", "the archive breaks a limit", broken=total and total["broken"])
    judged = members.where("kind <> 'folder'").withColumn("why", I.screen_member(F.col("path"), F.col("size"), F.col("packed"), F.col("kind"), limits))
    files = judged.where("why is null and content is not null").select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), "size", "content")
    refused = judged.where("why is not null").select("path", F.col("why").alias("reason"), F.concat(F.col("size").cast("string"), F.lit(" bytes")).alias("detail"))
    require(not files.isEmpty(), "empty_project", "the archive holds no file that may be unpacked", archive=Path(path).name)
    n = refused.count()
    return Source(safe_name(Path(path).stem), "archive", Path(path).name, unwrapped(files), refused, (f"{n} archive members were refused",) if n else ())


def single(spark: SparkSession, path: str) -> Source:
    """One source file (SRC-4)."""
    require(Path(path).is_file(), "unsupported_source", "not a file", path=path)
    name = Path(path).name
    read = spark.read.format("binaryFile").load(placed(spark, Path(path).resolve())).select(F.lit(name).alias("path"), F.col("length").alias("size"), "content")
    return Source(safe_name(Path(path).stem), "single_file", name, read, _refusals(spark))


def clone(url: str, target: str, seconds: float, attempts: int = CLONE_ATTEMPTS) -> str:
    """A shallow clone; the commit that it holds (SRC-5). Prompts, hooks and the user's configuration stay out."""
    quiet = {**os.environ, "GIT_TERMINAL_PROMPT": "0", "GIT_CONFIG_NOSYSTEM": "1", "GIT_CONFIG_GLOBAL": os.devnull, "GIT_LFS_SKIP_SMUDGE": "1"}
    said = ""
    for _ in range(attempts):
        try:
            done = subprocess.run(["git", "clone", "--depth", "1", "--no-tags", "-c", "core.hooksPath=" + os.devnull, "--", url, target], env=quiet, capture_output=True, text=True, timeout=seconds)
        except subprocess.TimeoutExpired as e:
            raise QuarryError("repository_fetch_timeout", "the clone took too long", seconds=seconds) from e
        if done.returncode == 0:
            return subprocess.run(["git", "-C", target, "rev-parse", "HEAD"], env=quiet, capture_output=True, text=True, timeout=60).stdout.strip()
        said = re.sub(r"://[^/@\s]*@", "://", done.stderr)[-400:]
    raise QuarryError("repository_fetch_failed", "the repository cannot be cloned", said=said)


def repository(spark: SparkSession, url: str, work: str, limits: Limits = Limits()) -> Source:
    """A repository by its address, cloned below work, a folder of the driver, and placed where executors find it (SRC-18)."""
    from quarry.sources.manifests import repository as check

    hosts = (re.sub(r"^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+).*$", r"\1", url.strip()),) if limits.any_host else limits.hosts
    verdict = spark.range(1).select(check(F.lit(url), hosts).alias("r")).first()["r"]
    require(verdict["problem"] is None, "invalid_repository_url", "the address is refused", problem=verdict["problem"])
    target = contained(work, "repo-" + uuid.uuid4().hex)
    revision = clone(verdict["normal"], str(target), limits.clone_seconds)
    name = verdict["normal"].rsplit("/", 1)[-1].removesuffix(".git")
    return Source(safe_name(name), "git", f"{verdict['normal']}@{revision[:12]}", unwrapped(I.scan(spark, placed(spark, target))), _refusals(spark))


def open_source(spark: SparkSession, source: str, work: str | None = None, limits: Limits = Limits()) -> Source:
    """A source of any kind by its shape: an address, a folder, an archive or one file (SRC-1)."""
    if is_address(source):
        require(work, "workspace_error", "a repository needs a folder to be cloned to")
        return repository(spark, source, work, limits)
    if Path(source).is_dir():
        return folder(spark, source)
    if Path(source).is_file():
        return archive(spark, source, limits) if Path(source).suffix.lower() in limits.archive_suffixes else single(spark, source)
    raise QuarryError("unsupported_source", "neither a path nor an address", source=source[:200])


@dataclass(frozen=True)
class Upload:
    path: str
    name: str
    sha256: str
    size: int


def store_upload(stream: BinaryIO, name: str, folder_: str, max_bytes: int, suffixes: tuple[str, ...] = (".zip", ".py")) -> Upload:
    """An upload written in chunks under a name of its own; refused ones leave nothing behind (SRC-16)."""
    base, suffix = Path(name or "upload").name, Path(name or "upload").suffix.lower()
    require(suffix in suffixes, "ingestion_error", "this kind of file is not taken", suffix=suffix)
    target, digest, total = contained(folder_, uuid.uuid4().hex + suffix), hashlib.sha256(), 0
    try:
        with open(target, "xb") as out:
            while chunk := stream.read(CHUNK):
                total += len(chunk)
                require(total <= max_bytes, "archive_too_large", "the upload is too large", limit=max_bytes)
                digest.update(chunk)
                out.write(chunk)
        require(total, "ingestion_error", "the upload is empty")
        require(suffix != ".zip" or zipfile.is_zipfile(target), "corrupt_archive", "the upload is no zip archive")
    except QuarryError:
        target.unlink(missing_ok=True)
        raise
    return Upload(str(target), base, digest.hexdigest(), total)


def staged(project: dict) -> str:
    """Where a job finds the source of its project: the stored upload, else the address (SRC-19)."""
    where = project.get("stored_path") if project.get("source_type") != "git" else project.get("source_url")
    require(where, "ingestion_error", "the project has no source", project=project.get("id"))
    return where
