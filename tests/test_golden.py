"""Whole reports, byte for byte.

``SPECWEAVE_GOLDEN`` may name a folder with example projects (``examples/NAME``) and the
reports expected of them (``tests/e2e-expect/NAME.VARIANT.txt``).
"""

import os
import re
import shutil
from pathlib import Path

import pytest

from specweave.cli import main

GOLDEN = os.environ.get("SPECWEAVE_GOLDEN", "")
VARIANTS = {"default": [], "verbose": ["-v"], "json": ["--json"], "tags": ["--tags", "web,data"]}
CASES = sorted(p.name[:-4] for p in Path(GOLDEN, "tests/e2e-expect").glob("*.txt")) if GOLDEN else []


def plain(text: str) -> str:
    return re.sub(r'(?m)^  "[a-z]+": "[^"]*",\n(?=  "ok")', "", text)


@pytest.mark.skipif(not CASES, reason="SPECWEAVE_GOLDEN names no folder")
@pytest.mark.parametrize("case", CASES or ["none"])
def test_examples(spark, tmp_path, monkeypatch, capsys, case):
    name, _, variant = case.rpartition(".")
    shutil.copytree(Path(GOLDEN, "examples", name), tmp_path / "p")
    if name == "hyperglot" and not list((tmp_path / "p").rglob("*.svg")):
        pytest.skip("this copy of the example lacks a file")
    monkeypatch.chdir(tmp_path / "p")
    code = main(VARIANTS[variant], spark)
    assert plain(capsys.readouterr().out) == plain(Path(GOLDEN, f"tests/e2e-expect/{case}.txt").read_text())
    assert code == (1 if name == "diagnostics" else 0)


SPEC = """# First

`req:a#1`

Needs: impl#1.x, utest, ?
Covers: feat:a#1, feat:none#2

# Top
`feat:a#1.0`

Needs: req#1

Old
---
`req:old#1`
Needs: impl:never#1

`[req:old#1 --> req:a#1]`
`[req:old#1 --> req:b#1]`
[req:ghost#1 --> req:a#1]

`req:b#1`

`[req:b#1 --> req:b#1.0]`
"""
CODE = "// [impl:a#1.2] [>>utest:a#1]\n/* [impl:a#1.1]\n [>>dsn:missing#1] */ [impl:no#1]\n// [impl:a#1.1.0]\n"
TEXT = """\
✘ impl:a#1.2  a.ts:1
    • uncovered: needs utest:a#1, which does not exist

✘ impl:a#1.1  a.ts:2
    • duplicate: ID impl:a#1.1.0 is defined 2 times
    • uncovered: needs dsn:missing#1, which does not exist

✘ impl:a#1.1.0  a.ts:4
    • duplicate: ID impl:a#1.1.0 is defined 2 times

✘ req:a#1 "First"  spec.md:3
    • invalid: "?" in the Needs list of req:a#1 is not a valid ID and is ignored  spec.md:5
    • uncovered: needs utest:a#1, which does not exist
    • orphaned: covers feat:none#2, which does not exist

✘ req:old#1 "Old"  spec.md:15
    • duplicate: forwarding for req:old#1 is declared 2 times  spec.md:18

✘ req:b#1  spec.md:22
    • cyclic: forwards to req:b#1.0, closing the cycle req:b#1 --> req:b#1, so the forwarding has no effect  spec.md:24

⚠ forwarding from req:ghost#1, which does not exist  spec.md:20

Summary
  items       7  (4 from specs, 3 from code)
  ok          1  (0 deep-covered, 1 only shallow-covered)
  defective   6
  problems    1

not ok
"""
VERBOSE = """\
✘ req:a#1 "First"  spec.md:3  [defective]
    needs impl:a#1.x (→ impl:a#1.2)  ✘ a.ts:1
    needs impl:a#1.x (→ impl:a#1.1)  ✘ a.ts:2
    needs utest:a#1  ✘ missing
    covers feat:a#1  ✔ spec.md:9
    covers feat:none#2  ✘ missing
    wanted by feat:a#1.0  spec.md:9
    • invalid: "?" in the Needs list of req:a#1 is not a valid ID and is ignored  spec.md:5
    • uncovered: needs utest:a#1, which does not exist
    • orphaned: covers feat:none#2, which does not exist
~ feat:a#1.0 "Top"  spec.md:9  [shallow-covered]
    needs req:a#1  ✘ spec.md:3
✘ req:old#1 "Old"  spec.md:15  [defective]
    → req:a#1  ✘ spec.md:3
    • duplicate: forwarding for req:old#1 is declared 2 times  spec.md:18
"""


def test_own_project(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "spec.md").write_text(SPEC)
    (tmp_path / "a.ts").write_text(CODE)
    monkeypatch.chdir(tmp_path)
    assert main([], spark) == 1
    text = capsys.readouterr().out
    assert main(["-v"], spark) == 1
    verbose = capsys.readouterr().out
    assert VERBOSE in verbose, verbose
    assert text == TEXT


def test_unreadable_files_end_the_run(spark, tmp_path, monkeypatch, capsys):
    from specweave.sources import tree

    (tmp_path / "spec.md").write_text("x")
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(tree.os.path, "isfile", lambda p: True)
    (tmp_path / "dir.md").mkdir()
    assert main(["dir.md"], spark) == 2
    assert "error: cannot read " in capsys.readouterr().err
