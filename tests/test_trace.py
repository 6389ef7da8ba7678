"""Scanners, analysis and reports on small trees."""

import json

import pytest

from specweave.cli import UsageError, main, parse_args
from specweave.functions.refs import canonical, parse_ref, split_lines
from specweave.operators.code_scan import comment_text, parse_code
from specweave.operators.markdown_scan import parse_markdown


def test_scalar_ids():
    assert canonical("req:a/b#02.4") == "req:a/b#2.4.0"
    assert parse_ref("`impl`", "req:a/b#2") == "impl:a/b#2"
    assert parse_ref("impl#2.x", "req:a#1") == "impl:a#2.x"
    assert parse_ref("impl#2.x", "req:a#1", cover=True) is None
    assert split_lines("a\r\nb\rc\n") == ["a", "b\rc"]


def test_comments_only():
    assert comment_text("x = '[impl:a#1]'; // [impl:b#1]", "ts").strip() == "[impl:b#1]"
    assert comment_text("u = http://x/y // [impl:a#1]", "ts").strip() == "[impl:a#1]"
    rows = parse_code("f.rs", "rs", "/* a /* b */ [impl:c#1] */ [impl:d#1]")
    assert [r["id"] for r in rows] == ["impl:c#1"]
    rows = parse_code("f.html", "html", "<script>\n// [impl:a#1]\n</script>\n<!-- [impl:b#1] [>>utest] -->")
    assert [(r["kind"], r.get("ref")) for r in rows] == [("item", None), ("item", None), ("need", "utest:b#1")]


def test_orphan_need_and_forward():
    rows = parse_code("f.ts", "ts", "// [>>utest:x#1] [req:a#1 --> req:b#1]")
    assert {r["kind"] for r in rows} == {"problem", "forward"}


def test_markdown_items_tables_and_titles():
    text = "# Title\n\n`req:a#1`\n\nText\nmore\n\nNeeds: impl, ?bad\nCovers:\n- feat#1\n\nTwo\nlines\n---\n\n`req:b#1`\n\n| Needs | Tags |\n|---|---|\n| impl:b#1 | web |\n"
    rows = parse_markdown("s.md", text)
    items = [r for r in rows if r["kind"] == "item"]
    assert [(r["id"], r["title"]) for r in items] == [("req:a#1", "Title"), ("req:b#1", "Two lines")]
    assert items[0]["description"] == ["Text", "more"] and items[1]["tags"] == ["web"]
    assert [r["ref"] for r in rows if r["kind"] == "need"] == ["impl:a#1", "impl:b#1"]
    assert [r["message"] for r in rows if r["kind"] == "defect"] == ['invalid: "?bad" in the Needs list of req:a#1 is not a valid ID and is ignored']


def test_arguments():
    assert parse_args(["-t", "a, b", "--json", "x"]).tags == ["a", "b"]
    for bad in (["--nope"], ["-t"], ["--json", "-v"], ["--json", "-f", "text"], ["--format=xml"], ["--json=1"]):
        with pytest.raises(UsageError):
            parse_args(bad)


def test_tree_to_report(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / ".gitignore").write_text("skip/\n")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "x.py").write_text("# [impl:skipped#1]\n")
    (tmp_path / "spec.md").write_text("# A\n\n`req:a#1`\n\nNeeds: impl#x\n\n# B\n\n`req:b#1`\n\n`[req:b#1 --> req:c#1]`\n\n# C\n\n`req:c#1`\n\n`[req:c#1 --> req:b#1]`\n")
    (tmp_path / "a.py").write_text("# [impl:a#2.4]\n# [impl:z#1]\n")
    monkeypatch.chdir(tmp_path)
    assert main(["--json"], spark) == 1
    doc = json.loads(capsys.readouterr().out)
    kinds = {i["id"]: (i["status"], [d["kind"] for d in i["defects"]]) for i in doc["items"]}
    assert kinds == {
        "impl:a#2.4": ("deep-covered", []), "impl:z#1": ("defective", ["unwanted-item"]), "req:a#1": ("deep-covered", []),
        "req:b#1": ("defective", ["cyclic-forwarding"]), "req:c#1": ("defective", ["cyclic-forwarding"]),
    }
    assert doc["items"][2]["needs"][0]["resolvedTo"] == ["impl:a#2.4"]
    assert "closing the cycle req:b#1 --> req:c#1 --> req:b#1" in str(doc)


def test_public_names():
    import specweave

    assert all(getattr(specweave, name) for name in specweave.__all__)
    with pytest.raises(AttributeError):
        specweave.nothing
