"""The source of file trees: what it lists, what it opens, and how plans grow."""

import json

import pytest

from schemasight import api
from schemasight.sources import files
from schemasight.sources import tree as T

FILES = {
    "a/A.java": "@Indexed\n", "a/lib.jar": "x" * 100_000, "a/Big.KT": "class B", "a/.env": "MY_MONGO_DB=x", "a/_h.py": "x.create_index(1)", "a/.git/c.java": "no", "a/.mvn/m.java": "yes",
    "a/target/t.java": "built", "a/target/.hidden.java": "no", "a/__pycache__/p.java": "no", "a/deep/er/D.java": "@Indexed\n@Indexed", "b/B.java": "@Indexed", "b/empty.java": "", "b/sp ace%20é.java": "text",
}


@pytest.fixture
def root(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


WANTED = {k: v for k, v in FILES.items() if v != "no"}


@pytest.mark.parametrize("most", [1, 256])
def test_every_file_once(spark, root, most, monkeypatch):
    monkeypatch.setattr(T, "DIRECTORIES", most)
    monkeypatch.setattr(T, "FILES", 1)
    got = [(r.path, r.content) for r in files.files(spark, root).collect()]
    assert dict(got) == WANTED and len(got) == len(WANTED)


def test_other_stores_give_the_same(spark, root):
    spark.conf.set("schemasight.tree.stores", "none")
    try:
        got = {r.path: r.content for r in files.files(spark, root).collect()}
        java = {r.path for r in files.files(spark, root, endings=[".java", ".kt"]).collect()}
    finally:
        spark.conf.unset("schemasight.tree.stores")
    assert got == {k: v for k, v in WANTED.items() if v}
    assert java | {"b/empty.java"} == {r.path for r in files.files(spark, root, endings=[".java", ".kt"]).collect()} == {k for k in WANTED if k.lower().endswith((".java", ".kt"))}


def test_only_wanted_files_are_opened(root, monkeypatch):
    opened, listed = [], []
    whole, content = T.TreeReader.listed, T.TreeReader.content
    monkeypatch.setattr(T.TreeReader, "content", staticmethod(lambda store, path: opened.append(path) or content(store, path)))
    monkeypatch.setattr(T.TreeReader, "listed", lambda self, store, part: listed.append(part.path) or whole(self, store, part))
    reader = T.TreeReader({"roots": json.dumps([("r", f"file://{root}")]), "endings": '[".JAVA", ".kt"]', "names": '[".env"]'})
    rows = [row for part in reader.partitions() for row in reader.read(part)]
    want = {k for k in WANTED if k.lower().endswith((".java", ".kt", ".env"))}
    assert {r[1] for r in rows} == want and len(opened) == len(want)
    assert sum(len(r[3]) for r in rows) == sum(len(WANTED[k].encode()) for k in want) < 1000
    assert len(listed) == len(set(listed)) and not [p for p in listed if p.endswith((".git", "__pycache__"))]


def test_projects_are_one_plan(spark, root):
    nodes = lambda df: df._jdf.queryExecution().analyzed().toString().count("\n")
    one, many = api.projects(spark, [f"{root}/a"]), api.projects(spark, [f"{root}/a", f"{root}/b", root, f"{root}/a/deep", f"file:{root}/b"])
    assert nodes(one) == nodes(many)
    got = {(r.project, r.type): r.n for r in many.collect()}
    java = next(t for p, t in got if p == f"{root}/b" and t)
    assert {p: n for (p, t), n in got.items() if t == java and p} == {f"{root}/a": 3, f"{root}/b": 1, root: 4, f"{root}/a/deep": 2, f"file:{root}/b": 1}
    assert {r.file_id for r in api.index_lines(spark, root).collect()} == {"a/A.java", "a/deep/er/D.java", "b/B.java", "a/_h.py"}


def test_edges(spark, root, tmp_path):
    assert [r.path for r in files.files(spark, f"{root}/a/A.java").collect()] == ["A.java"]
    (tmp_path / "nothing").mkdir()
    assert files.files(spark, f"{root}/nothing").count() == 0
    assert {r.path for r in files.paths(spark, root).collect()} == set(WANTED)
    assert sorted(r.path for r in files.files(spark, [f"{root}/a/deep", f"{root}/b"], "*.java").collect()) == sorted([f"{root}/a/deep/er/D.java", *[f"{root}/{k}" for k in FILES if k.startswith("b/")]])
    with pytest.raises(Exception, match="nowhere"):
        files.files(spark, f"{root}/nowhere").count()
