"""A scan of trees in which some folders and files can't be read."""

import os

from lodestar.sources import crawl


def tree(tmp_path):
    for name in ("a/b/c/one.txt", "a/b/two.txt", "a/node_modules/x/three.txt", "four.txt", "locked/five.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    (tmp_path / "a/loop").symlink_to(tmp_path)
    (tmp_path / "empty").mkdir()
    with open(os.fsencode(tmp_path / "a") + b"/bad\xff.txt", "w") as f:
        f.write("x")
    return str(tmp_path)


def guarded():
    """The plain listing, but one folder may not be read, and another breaks off after its first entry."""
    plain = crawl.list_directory

    def run(path):
        if path.endswith("/locked"):
            raise PermissionError(path)
        for n, entry in enumerate(plain(path)):
            if path.endswith("/b") and n == 1:
                raise TimeoutError(path)
            yield entry

    return run


def test_errors_are_rows_and_all_else_is_listed(spark, tmp_path):
    root = tree(tmp_path)
    rows = crawl.crawl(spark, [root, root + "/", root + "/a/b", "/no/such"]).collect()
    of = lambda kind: sorted(r.path.removeprefix(root) for r in rows if r.kind == kind)
    assert of("file") == ["/a/b/c/one.txt", "/a/b/two.txt", "/a/node_modules/x/three.txt", "/four.txt", "/locked/five.txt"]
    assert of("directory") == ["/a", "/a/b", "/a/b/c", "/a/node_modules", "/a/node_modules/x", "/empty", "/locked"]
    assert of("other") == ["/a/loop"]
    assert sorted((r.path.removeprefix(root), r.operation, r.error) for r in rows if r.kind == "error") == [("/a/bad�.txt", "read_metadata", "UnicodeEncodeError"), ("/no/such", "read_directory", "FileNotFoundError")]
    assert {r.path.removeprefix(root): r.length for r in rows if r.kind == "file"}["/four.txt"] == 8

    some = crawl.crawl(spark, [root], listed_by=guarded()).collect()
    errors = {(r.path.removeprefix(root), r.operation, r.error) for r in some if r.kind == "error"}
    assert errors == {("/a/bad�.txt", "read_metadata", "UnicodeEncodeError"), ("/locked", "read_directory", "PermissionError"), ("/a/b", "read_directory", "TimeoutError")}
    assert {"/four.txt", "/a/node_modules/x/three.txt"} <= {r.path.removeprefix(root) for r in some if r.kind == "file"}


def test_profile_and_no_roots(spark, tmp_path):
    assert crawl.crawl(spark, []).count() == 0
    assert crawl.crawl(spark, ["/no/such"]).first().error == "FileNotFoundError"


def test_discovery_leaves_out_dependencies(spark, tmp_path, monkeypatch):
    # The test's folder lies in a system root, so only the rule for dependencies can be seen in it.
    monkeypatch.setattr("lodestar.sources.files.SYSTEM_ROOTS", ("none",))
    monkeypatch.setattr("lodestar.sources.files.DEPENDENCIES", ("node_modules",))
    root = tree(tmp_path)
    rows = crawl.crawl(spark, [root], "discovery").collect()
    assert [r.path.removeprefix(root) for r in rows if r.kind == "skipped"] == ["/a/node_modules"]
    assert not any("three" in r.path for r in rows)
