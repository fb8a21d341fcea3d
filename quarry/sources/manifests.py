"""Build files and repository addresses: tools, dependencies, frameworks, address checks (SRC-17, AGG-24, AGG-26, FLT-9)."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

#: Build tools by file name, framework labels by distribution.
TOOLS = {"Pipfile": "pipenv", "setup.py": "setuptools", "setup.cfg": "setuptools", "environment.yml": "conda", "environment.yaml": "conda", "pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle"}
FRAMEWORKS = {
    "django": "Django", "flask": "Flask", "fastapi": "FastAPI", "pyramid": "Pyramid", "tornado": "Tornado", "aiohttp": "aiohttp", "sqlalchemy": "SQLAlchemy", "pandas": "pandas",
    "numpy": "NumPy", "scikit-learn": "scikit-learn", "torch": "PyTorch", "tensorflow": "TensorFlow", "pytest": "pytest", "celery": "Celery", "scrapy": "Scrapy",
}
HOSTS = ("github.com", "gitlab.com", "bitbucket.org")
_NAME = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)"


#: Tables of pyproject.toml that tell a build tool.
PYPROJECT = {"tool.poetry": "poetry", "tool.pdm": "pdm", "tool.hatch": "hatch"}


def _table(data: dict, path: str):
    """What stands at a dotted path, or None."""
    for key in path.split("."):
        data = data.get(key) if isinstance(data, dict) else None
    return data


def pyproject(text: str) -> tuple[list[str], list[str]]:
    """(build tools, dependencies) of one pyproject.toml; nothing where it does not parse."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return [], []
    tools = [tool for path, tool in PYPROJECT.items() if _table(data, path) is not None]
    listed = {path: _table(data, path) or () for path in ("project.dependencies", "tool.poetry.dependencies")}
    names = [m[1].lower() for path, xs in listed.items() for x in xs if isinstance(x, str) and (m := re.match(_NAME, x)) and (path, m[1].lower()) != ("tool.poetry.dependencies", "python")]
    return tools or ["setuptools"] * ("project" in data), names


def _tools_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([t for text in batch.column(0).to_pylist() for t in pyproject(text or "")[0]], pa.string())], ["tool"])


def requirements(files: DataFrame) -> DataFrame:
    """(path, dependency) of requirements files (path, text), one row for each line that names one."""
    line = F.explode(F.transform(T.lines(F.col("text")), T.stripped)).alias("line")
    rows = files.where(F.lower(T.base_name(F.col("path"))).rlike(r"^requirements.*\.txt$")).select("path", line)
    named = rows.where(~F.col("line").rlike(r"^(?:#|-|\$|http:|https:|$)")).select("path", F.lower(F.regexp_extract("line", _NAME, 1)).alias("dependency"))
    return named.where("dependency <> ''")


def build_tools(files: DataFrame) -> DataFrame:
    """Distinct tool names by marker files among top-level (path, text) rows; unknown where there is none."""
    top = files.where(~F.col("path").contains("/"))
    pairs = [F.lit(x) for kv in TOOLS.items() for x in kv]
    marked = top.select(F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("path")), F.when(F.lower("path").rlike(r"^requirements.*\.txt$"), "pip")).alias("tool")).where("tool is not null")
    more = top.where("path = 'pyproject.toml'").select("text").mapInArrow(_tools_in, "tool string")
    every = marked.union(more).distinct()
    return every if not every.isEmpty() else files.sparkSession.createDataFrame([("unknown",)], "tool string")


def frameworks(dependencies: DataFrame) -> DataFrame:
    pairs = [F.lit(x) for kv in FRAMEWORKS.items() for x in kv]
    return dependencies.select(F.try_element_at(F.create_map(*pairs), F.lower("dependency")).alias("framework")).where("framework is not null").distinct()


def repository(url: Column, hosts: tuple[str, ...] = HOSTS) -> Column:
    """struct(problem, normal): why an address is refused, or its https form."""
    u = F.trim(url)
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    port = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*:([0-9]+)(?:[/?#]|$)", 1)
    parts = F.filter(F.split(F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    problem = (
        F.when(F.coalesce(u, F.lit("")) == "", "empty")
        .when(F.length(u) > 2048, "too long")
        .when(u.rlike(r"[\n\r\x00 ]"), "white space")
        .when(~F.lower(u).startswith("https://"), "not https")
        .when(u.rlike(r"^[A-Za-z]+://[^/?#]*@"), "credentials")
        .when(host == "", "no host")
        .when(~host.isin(*[h.lower() for h in hosts]), "host not allowed")
        .when((port != "") & (port != "443"), "port")
        .when(F.size(parts) < 2, "no owner and repository")
    )
    normal = F.concat(F.lit("https://"), host, F.lit("/"), F.get(parts, 0), F.lit("/"), F.regexp_replace(F.get(parts, 1), r"\.git$", ""), F.lit(".git"))
    return F.struct(problem.alias("problem"), F.when(problem.isNull(), normal).alias("normal"))
