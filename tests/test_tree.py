import builtins
import os

import pytest

from tesserae.sources import tree


@pytest.fixture
def root(tmp_path):
    def put(path, data=b"text\n"):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)

    put("a/x.txt", b"hello")
    put("a/bin", b"ab\0c")
    put("a/late", b"x" * 600 + b"\0")
    put("a/y.min.js")
    put("docs/z.md")
    put("node_modules/deep/m.js")
    put("repo/.git/HEAD")
    put("repo/r.txt", b"in repo")
    put("repo/vendor/v.c")
    put("link/.git", b"gitdir: elsewhere")
    put("link/l.txt", b"linked")
    put("a/b/inner/.git/HEAD")
    put("a/b/inner/i.txt")
    put("skipped/.git/HEAD")
    put("empty", b"")
    return tmp_path


WANT = {("a/x.txt", "index"), ("a/bin", "binary"), ("a/late", "index"), ("a/y.min.js", "user"), ("docs", "user"), ("node_modules", "default"), ("repo", "sub_repo"), ("link", "sub_repo"), ("a/b/inner", "nested_repo"), ("skipped", "user"), ("empty", "index")}
GLOBS = ["*.min.js", "docs", "skip*"]


@pytest.mark.parametrize("items", [1, 2, 256])
def test_every_entry_has_its_reason(spark, root, items):
    rows = tree.scan(spark, str(root), GLOBS, items=items).collect()
    assert len(rows) == len(WANT) and {(r.path, r.reason) for r in rows} == WANT
    by = {r.path: r for r in rows}
    assert bytes(by["a/x.txt"].content) == b"hello" and by["a/x.txt"].size == 5 and len(by["a/x.txt"].hash) == 64 and by["a/x.txt"].mtime > 0
    assert by["a/bin"].content is None and by["docs"].size is None and bytes(by["empty"].content) == b""


def test_what_is_pruned_is_never_opened(root, monkeypatch):
    opened, listed = [], []
    plain, scandir = builtins.open, os.scandir

    def opening(path, *a, **k):
        opened.append(os.path.relpath(path, root))
        return plain(path, *a, **k)

    def listing(path):
        listed.append(os.path.relpath(path, root))
        return scandir(path)

    monkeypatch.setattr(builtins, "open", opening)
    monkeypatch.setattr(os, "scandir", listing)
    reader = tree.TreeReader({"roots": f'[["", "file:{root}", ""]]', "excludes": '["*.min.js", "docs", "skip*"]', "items": "1"})
    rows = [r for w in reader.partitions() for r in reader._rows(w)]
    assert {(r[1], r[2]) for r in rows} == WANT
    assert sorted(opened) == ["a/bin", "a/late", "a/x.txt", "empty"] and sorted(set(listed)) == [".", "a", "a/b"]


def test_repositories_are_projects_and_errors_do_not_stop_others(spark, root):
    got = {(r.project, r.path, r.reason) for r in tree.scan_with_repos(spark, str(root), GLOBS).collect()}
    assert {x for x in got if x[0] == ""} == {("", p, r) for p, r in WANT}
    assert {x for x in got if x[0]} == {("repo", "r.txt", "index"), ("repo", ".git", "default"), ("repo", "vendor", "default"), ("link", "l.txt", "index"), ("link", ".git", "default")}
    broken = tree._load(spark, [("gone", str(root / "nowhere"), ""), ("repo", str(root / "repo"), "")], [], 8)
    rows = {(r.project, r.reason): r for r in broken.collect()}
    assert rows["gone", "error"].error == "No such file or directory" and ("repo", "index") in rows
    os.symlink(root / "nowhere", root / "a" / "dangling")
    assert ("a/dangling", "error") in {(r.path, r.reason) for r in tree.scan(spark, str(root), GLOBS).collect()}
    n = {(r.project, r.reason): (r.n, r.bytes) for r in tree.counters(tree.scan_with_repos(spark, str(root), GLOBS)).collect()}
    assert n["", "sub_repo"] == (2, 0) and n["repo", "index"] == (1, 7)


def test_included_folders(spark, root):
    rows = tree.scan(spark, str(root), GLOBS, include=["a/b", "docs"]).collect()
    assert {(r.path, r.reason) for r in rows} == {("a/b/inner", "nested_repo"), ("docs", "user")}
