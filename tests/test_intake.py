"""Sources of every shape, uploads, settings, errors and registries."""

import io
import subprocess
import zipfile

import pytest

from quarry import errors, settings
from quarry.plans import analyze as A
from quarry.sources import intake as N
from quarry.sources import inventory as I


def zipped(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return str(path)


def code_of(call):
    with pytest.raises(errors.QuarryError) as e:
        call()
    assert e.value.status == errors.STATUS[e.value.code] and e.value.as_dict()["code"] == e.value.code
    return e.value.code


def paths(source):
    return {r.path for r in source.files.select("path").collect()}


def test_dispatch(spark, tmp_path):
    (tmp_path / "repo-main" / "pkg").mkdir(parents=True)
    (tmp_path / "repo-main" / "pkg" / "a.py").write_text("x = 1")
    (tmp_path / ".hidden").write_text("")
    opened = N.open_source(spark, str(tmp_path))
    assert opened.kind == "directory" and paths(opened) == {"pkg/a.py"}
    (tmp_path / "b.py").write_text("y = 2")
    assert paths(N.open_source(spark, str(tmp_path))) == {"repo-main/pkg/a.py", "b.py", ".hidden"}
    one = N.open_source(spark, str(tmp_path / "b.py"))
    assert (one.kind, one.name, paths(one), N.used_bytes(one.files)) == ("single_file", "b", {"b.py"}, 5)
    assert code_of(lambda: N.open_source(spark, str(tmp_path / "none"))) == "unsupported_source"
    assert code_of(lambda: N.open_source(spark, "https://evil.example/a/b", str(tmp_path))) == "invalid_repository_url"


def test_names_that_the_reader_hides(spark, tmp_path):
    for name in ("p/__init__.py", "p/_private/a.py", "p/b.py", ".dot.py", ".git/x.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1")
    (tmp_path / "p" / "link.py").symlink_to(tmp_path / "p" / "b.py")
    (tmp_path / "loop").symlink_to(tmp_path)
    assert {r.path for r in I.scan(spark, str(tmp_path)).collect()} == {"p/__init__.py", "p/_private/a.py", "p/b.py", ".dot.py"}
    assert set(A.analyze(spark, str(tmp_path))[0].select("package").toPandas()["package"]) >= {"", "_private.a", "b"}


def test_a_source_root_is_no_wrapper(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x")
    assert paths(N.open_source(spark, str(tmp_path))) == {"src/a.py"}


def test_archives(spark, tmp_path):
    good = N.open_source(spark, zipped(tmp_path / "my repo.zip", {"repo-main/a.py": "class A:\n    pass\n", "repo-main/app.js": "class B {\n}\n", "../up.py": "x"}))
    assert good.name == "my-repo" and paths(good) == {"a.py", "app.js"}
    assert [(r.path, r.reason) for r in I.rejections_in_order(good.rejected).collect()] == [("../up.py", "path_traversal")] and good.warnings == ("1 archive members were refused",)
    found = A.analyze(spark, str(tmp_path / "my repo.zip"))[2]
    assert {r.name for r in found.where("entity_type = 'class'").collect()} == {"A", "B"}
    (tmp_path / "bad.zip").write_bytes(b"PK no archive")
    (tmp_path / "empty.zip").write_bytes(b"")
    assert code_of(lambda: N.open_source(spark, str(tmp_path / "bad.zip"))) == "corrupt_archive"
    assert code_of(lambda: N.open_source(spark, str(tmp_path / "empty.zip"))) == "corrupt_archive"
    assert code_of(lambda: N.open_source(spark, zipped(tmp_path / "none.zip", {}))) == "empty_project"
    assert code_of(lambda: N.archive(spark, zipped(tmp_path / "many.zip", {f"{i}.py": "x" for i in range(4)}), settings.Limits(members=3))) == "archive_too_large"
    raw = spark.createDataFrame([("bad", b"junk"), ("ok", (tmp_path / "my repo.zip").read_bytes())], "path string, content binary")
    assert {(r.archive, r.kind) for r in I.unpack(raw).collect()} == {("bad", "corrupt"), ("ok", "file")}


def test_repositories(spark, tmp_path):
    work = tmp_path / "origin"
    work.mkdir()
    (work / "m.py").write_text("x = 1")
    git = ["git", "-C", str(work), "-c", "user.name=a", "-c", "user.email=a@b"]
    for args in (["init", "-q"], ["add", "."], ["commit", "-qm", "one"]):
        subprocess.run([*git, *args], check=True)
    assert len(N.clone(f"file://{work}", str(tmp_path / "copy"), 60)) == 40
    assert (tmp_path / "copy" / "m.py").exists()
    assert code_of(lambda: N.clone(f"file://{work}-none", str(tmp_path / "no"), 60, attempts=1)) == "repository_fetch_failed"


def test_uploads(tmp_path):
    up = N.store_upload(io.BytesIO(b"x = 1"), "../a/b.py", str(tmp_path), 100)
    assert (up.name, up.size, len(up.sha256)) == ("b.py", 5, 64) and up.path.startswith(str(tmp_path))
    for data, name, limit in ((b"x", "a.exe", 9), (b"", "a.py", 9), (b"0123456789", "a.py", 9), (b"PK", "a.zip", 9)):
        code_of(lambda: N.store_upload(io.BytesIO(data), name, str(tmp_path), limit))
    assert len(list(tmp_path.iterdir())) == 1
    assert code_of(lambda: N.contained(str(tmp_path), "../x")) == "path_escape"
    assert N.staged({"source_type": "git", "source_url": "u"}) == "u" and code_of(lambda: N.staged({"source_type": "upload"})) == "ingestion_error"


def test_settings():
    assert settings.Settings(environment="production").limits.members == 50_000
    for wrong in (
        lambda: settings.Settings(environment="production", debug=True),
        lambda: settings.Settings(environment="nowhere"),
        lambda: settings.Limits(member_bytes=2 << 30),
        lambda: settings.Limits(ratio=1.0),
        lambda: settings.Training(models=("svm",)),
        lambda: settings.Training(test_size=1.0),
        lambda: settings.Training(min_projects=1),
        lambda: settings.Sampling(ratio=-1),
    ):
        assert code_of(wrong) == "configuration_error"
    r = settings.Registry("parser")
    assert r.add("a", 1) == 1 and r.get("a") == 1 and list(r) == ["a"]
    assert code_of(lambda: r.add("a", 2)) == "duplicate_registration" and code_of(lambda: r.get("b")) == "unknown_plugin"


def test_what_the_driver_has_is_placed_in_the_shared_folder(spark, tmp_path):
    tree = tmp_path / "clone"
    (tree / "pkg").mkdir(parents=True)
    (tree / "pkg" / "a.py").write_text("x = 1\n")
    assert N.placed(spark, tree) == str(tree)
    where = N.placed(spark, tree, shared=True)
    assert where.rstrip("/").endswith("/clone") and not where.startswith(str(tree))
    assert {r.path for r in I.scan(spark, where).collect()} == {"pkg/a.py"}
    one = N.placed(spark, tree / "pkg" / "a.py", shared=True)
    assert spark.read.text(one).first()[0] == "x = 1"
