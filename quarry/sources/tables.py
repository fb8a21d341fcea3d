"""Readers and sinks of sheets, rows, reports and models (SRC-10..16, SNK-1..16, ML-12)."""

from __future__ import annotations

import hashlib
import html
import json
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quarry.errors import require
from quarry.operators import query as Q


def read_sheet(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A CSV with exactly these columns as text; quoted fields may span lines; a byte-order mark is dropped."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = [c.lstrip("﻿") for c in raw.columns]
    if missing := [c for c in columns if c not in names]:
        raise ValueError(f"missing columns: {missing}")
    return raw.toDF(*names).select(*columns)


def read_training(spark: SparkSession, path: str, metadata: tuple[str, ...], prefix: str = "feature__", strict: bool = False) -> DataFrame:
    """A training CSV: metadata as text, features as doubles without their prefix (PRJ-4, SRC-11).

    A blank cell is a missing value. A cell that is no finite number is null, or in strict reading an error that names up
    to five such cells.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    features = [c for c in raw.columns if c.startswith(prefix)]
    if missing := [c for c in metadata if c not in raw.columns]:
        raise ValueError(f"missing columns: {missing}")
    if not features:
        raise ValueError("no feature columns")
    number = {c: F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)") for c in features}
    finite = {c: F.when(F.abs(x) < float("inf"), x) for c, x in number.items()}  # not a number is above all numbers
    if strict:
        bad = F.array_compact(F.array(*[F.when((F.trim(F.col(f"`{c}`")) != "") & finite[c].isNull(), F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("cell"))) for c in features]))
        found = raw.select(*[F.col(metadata[0]).alias("row")] if metadata else [F.lit(None).alias("row")], F.explode(bad).alias("b")).select("row", "b.*").limit(5).collect()
        require(not found, "ml_error", "features are finite numbers", cells=[r.asDict() for r in found])
    return raw.select(*metadata, *[finite[c].alias(c.removeprefix(prefix)) for c in features])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def text_schema(columns: tuple[str, ...]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def write_sheet(rows: DataFrame, path: str, columns: tuple[str, ...], overwrite: bool = False) -> None:
    """The named columns as one CSV; others are left out."""
    rows.select(*columns).coalesce(1).write.mode("overwrite" if overwrite else "error").option("header", True).option("escape", '"').csv(path)


def write_report(sections: dict[str, tuple[DataFrame, list[str]]], path: str, limit: int, overwrite: bool = False) -> dict:
    """A CSV for each section, safe for spreadsheets and in a fixed order, and what was left out (SNK-10, LIM-2)."""
    left_out = {}
    for name, (rows, order) in sections.items():
        part, cut = Q.section(rows, order, limit)
        Q.csv_cells(part).coalesce(1).write.mode("overwrite" if overwrite else "error").option("header", True).csv(f"{path}/{name}")
        left_out[name] = cut
    return left_out


def plain_json(value) -> str:
    """JSON with sorted keys and ISO times (SNK-9)."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, default=lambda v: v.isoformat() if isinstance(v, (date, datetime)) else str(v))


def html_table(rows: DataFrame, title: str, limit: int = 200) -> str:
    """A page with the first rows; every cell is escaped (SNK-11, LIM-3)."""
    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values) + "</tr>"
    body = "".join(cells("td", r) for r in rows.limit(limit).collect())
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{cells('th', rows.columns)}{body}</table>"


def page_of(sections: dict[str, list[dict]], title: str, limit: int = 200) -> str:
    """A page with a table for each section's first rows; every cell is escaped (SNK-11, LIM-3)."""
    cell = lambda tag, v: f"<{tag}>{html.escape(v if isinstance(v, str) else plain_json(v))}</{tag}>"
    out = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, rows in sections.items():
        columns = list(dict.fromkeys(k for r in rows[:limit] for k in r))
        body = "".join("<tr>" + "".join(cell("td", r.get(c)) for c in columns) + "</tr>" for r in rows[:limit])
        out.append(f"<h2>{html.escape(name)} ({len(rows)})</h2><table><tr>{''.join(cell('th', c) for c in columns)}</tr>{body}</table>")
    return "".join(out)


def digest(rows: DataFrame, order: list[str]) -> str:
    """Order-independent digest of a table: the digests of its rows, summed; nothing is collected (SNK-2, SNK-12)."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*order)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    r = rows.agg(F.sum(h).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return hashlib.sha256(f"{r['s']}:{r['n']}".encode()).hexdigest()


def _children(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def files_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the names and contents of all files below path, in the order of their names (ML-12).

    Sizes are those of a model; contents are hashed where they are read, and only digests come to the driver.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = _children(spark, path)
    base = root[0].makeQualified(root[1]).toString().rstrip("/") + "/"
    rows = found.select(F.split("path", base.rsplit("/", 2)[-2] + "/", 2)[1].alias("name"), F.sha2("content", 256).alias("sha")).where("not startswith(element_at(split(name, '/'), -1), '_')").collect()
    h = hashlib.sha256()
    for r in sorted(rows):
        h.update(f"{r['name']}\0{r['sha']}\0".encode())
    return h.hexdigest()


def save_model(model, path: str, card: dict, overwrite: bool = False) -> str:
    """A pipeline model beside its card; returns the digest of the model's files, which the card holds too (SNK-5, ML-12)."""
    spark = SparkSession.active()
    (model.write().overwrite() if overwrite else model.write()).save(f"{path}/model")
    sha = files_digest(spark, f"{path}/model")
    text = plain_json({**card, "model_sha256": sha})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "error").text(f"{path}/card")
    return sha


def read_card(path: str) -> dict:
    return json.loads("\n".join(r[0] for r in SparkSession.active().read.text(f"{path}/card").collect()))


def load_model(path: str, features: list[str], sha: str | None = None):
    """(model, card); the files' digest must be that of the card (and sha, where given), the features those asked for (SRC-13)."""
    from pyspark.ml import PipelineModel

    card = read_card(path)
    try:
        now = files_digest(SparkSession.active(), f"{path}/model")
    except Exception:  # files that cannot be read are not those that were saved
        now = None
    require(now == card.get("model_sha256") and sha in (None, now), "ml_error", "the model has changed", path=path)
    require(list(card.get("features", [])) == list(features), "ml_error", "the model was trained on other features")
    return PipelineModel.load(f"{path}/model"), card


def verified(registry: DataFrame) -> list[str]:
    """Digests of registered models whose files are gone or have changed (ML-12); the registry is a short list."""
    spark, bad = registry.sparkSession, []
    for r in registry.select("model_sha256", "path").collect():
        try:
            ok = files_digest(spark, f"{r['path']}/model") == r["model_sha256"]
        except Exception:  # the files cannot be read
            ok = False
        if not ok:
            bad.append(r["model_sha256"])
    return bad


def drop_model(registry: DataFrame, sha: str, predictions: DataFrame | None = None) -> DataFrame:
    """The registry without a model, whose files go; one with predictions stays and is an error (ML-12, DEL-1)."""
    require(predictions is None or predictions.where(F.col("model_id") == sha).isEmpty(), "conflict", "the model has predictions", model=sha)
    for r in registry.where(F.col("model_sha256") == sha).select("path").collect():
        fs, p = _children(registry.sparkSession, r["path"])
        fs.delete(p, True)
    return registry.where(F.col("model_sha256") != sha)


def register(registry: DataFrame, entry: DataFrame, key: str = "model_sha256") -> DataFrame:
    """The registry with an entry added, or put in place of the one with its key (ML-12)."""
    return registry.join(entry.select(key), key, "left_anti").unionByName(entry)
