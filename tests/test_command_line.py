import json

import pytest

from lorewell import __main__ as cli


def test_commands(spark, tmp_path):
    def call(*argv, store="s"):
        out = []
        cli.run(["--store", str(tmp_path / store), *argv], spark, out.append)
        return [json.loads(x) for x in out]

    call("init", "notes", "--analyzer", "bigram")
    (a,) = call("add", "--text", "the quick brown fox", "--tags", "x,y", "--importance", "0.9")
    (tmp_path / "f.txt").write_text("  a lazy dog\n")
    call("add", "--file", str(tmp_path / "f.txt"), "--skip-known")
    call("add", "--file", str(tmp_path / "f.txt"), "--skip-known")
    assert [r["content"] for r in call("ls")] == ["the quick brown fox", "a lazy dog"]
    assert [r["id"] for r in call("search", "fox", "--mode", "fts", "--scoring", "agent")] == [a]
    assert call("search", "fox", "--mode", "fts", "--type", "episodic") == []
    call("update", a, "--content", "a slow turtle", "--tags", "z")
    got = call("get", a)[0]
    assert got["content"] == "a slow turtle" and json.loads(got["metadata"]) == {"tags": ["z"]}
    call("link", "fox", "is", "animal", "--weight", "2")
    assert call("expand", "animal")[0]["s"] == "fox"
    call("link", "fox", "is", "animal", "--remove")
    assert call("expand", "animal") == []
    assert {r["suggestion"] for r in call("organize")} <= {"untagged", "episodic", "duplicates"}
    b = next(r["id"] for r in call("ls") if r["id"] != a)
    with pytest.raises(ValueError):
        call("merge", a, b, "--summary", "animals")
    (m,) = call("merge", a, b, "--summary", "animals", "--yes")
    call("compact")
    assert call("stats")[0] == {"collection": "default", "memories": 1, "tombstones": 2} and call("info")[0]["collections"] == 2
    assert any(r.get("mode") == "fts" for r in call("metrics"))
    call("metrics", "--reset")
    assert not any(r.get("mode") for r in call("metrics"))
    call("export", str(tmp_path / "x.tar.gz"))
    call("import", str(tmp_path / "x.tar.gz"), store="t")
    assert [r["id"] for r in call("ls", store="t")] == [m]
    call("rm", m, "--hard", store="t")
    assert call("ls", store="t") == []
