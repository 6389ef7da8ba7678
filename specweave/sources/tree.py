"""Trees of files: ignore-aware listing and decoding.

Listing walks directories on the driver; reading, decoding and parsing run on
the executors, one row a file.
"""

from __future__ import annotations

import fnmatch
import os
import re
from pathlib import Path

from .grammars import CODE_EXTENSIONS, SPEC_EXTENSIONS

PRUNED = {".git", "node_modules"}


class MissingPath(Exception):
    """An input path that does not exist."""


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    return ext.lower() if dot and stem else ""


def absolute(path: str, cwd: str | None = None) -> str:
    """Absolute and lexically normal; links stay."""
    return os.path.normpath(os.path.join(cwd or os.getcwd(), path or ".")).replace("//", "/")


class _Rules:
    """The patterns of one ignore file, for paths below its folder."""

    def __init__(self, folder: str, text: str):
        self.folder, self.rules = folder, []
        for line in text.lstrip("﻿").splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line.removeprefix("\\") if line[:2] in ("\\#", "\\!") else line
            only_dirs, line = line.endswith("/"), line.rstrip("/")
            anchored, line = "/" in line, line.lstrip("/")
            self.rules.append((keep, only_dirs, re.compile(self._regex(line, anchored))))

    @staticmethod
    def _regex(glob: str, anchored: bool) -> str:
        out = "" if anchored else "(?:.*/)?"
        parts = glob.split("/")
        for i, part in enumerate(parts):
            last = i == len(parts) - 1
            if part == "**":
                out += ".*" if last else "(?:.*/)?"
                continue
            one = fnmatch.translate(part).replace("(?s:", "(?s:", 1)
            one = re.sub(r"\\[Zz]$", "", one).replace(".*", "[^/]*").replace("(?>[^/]*?", "(?>[^/]*?")
            out += one + ("" if last else "/")
        return out

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True to ignore, False to keep, None if no pattern fits; the last one wins."""
        if not path.startswith(self.folder.rstrip("/") + "/"):
            return None
        rel, out = path[len(self.folder.rstrip("/")) + 1 :], None
        for keep, only_dirs, pattern in self.rules:
            if (is_dir or not only_dirs) and pattern.fullmatch(rel):
                out = not keep
        return out


def _rules_in(folder: str) -> list[list[_Rules]]:
    """[.ignore, .gitignore, .git/info/exclude] of a folder, as far as they exist."""
    out = []
    for name in (".ignore", ".gitignore", ".git/info/exclude"):
        try:
            out.append([_Rules(folder, Path(folder, name).read_text(errors="replace"))])
        except OSError:
            out.append([])
    return out


def _global_rules(cwd: str) -> list[_Rules]:
    """The user's git excludes, for paths below ``cwd``: the file that the git configuration names, else the usual place."""
    home, named = Path.home(), None
    config = Path(os.environ.get("XDG_CONFIG_HOME") or home / ".config")
    for file in (home / ".gitconfig", config / "git" / "config"):
        try:
            found = re.search(r"(?im)^[ \t]*excludesfile[ \t]*=[ \t]*\"?([^\"\n]+?)\"?[ \t]*$", file.read_text(errors="replace"))
        except OSError:
            continue
        if found and named is None:
            named = Path(found[1]).expanduser()
    try:
        return [_Rules(cwd, (named or config / "git" / "ignore").read_text(errors="replace"))]
    except OSError:
        return []


def _ignored(path: str, is_dir: bool, levels: list[list[list[_Rules]]], last: list[_Rules]) -> bool:
    for kind in range(3):  # .ignore before .gitignore before the repository's excludes
        for level in reversed(levels):  # the nearest folder first
            for rules in level[kind]:
                found = rules.verdict(path, is_dir)
                if found is not None:
                    return found
    for rules in last:
        found = rules.verdict(path, is_dir)
        if found is not None:
            return found
    return False


def collect_files(paths: list[str], cwd: str | None = None) -> list[str]:
    """All supported files below ``paths``, each once, in code-point order of their absolute paths."""
    wanted, found = SPEC_EXTENSIONS | CODE_EXTENSIONS, set()
    everywhere = _global_rules(absolute(".", cwd))
    for raw in paths or ["."]:
        root = absolute(raw, cwd)
        if not os.path.lexists(root):
            raise MissingPath(f"input path does not exist: {raw}")
        if os.path.isfile(root):
            found |= {root} if extension(root) in wanted else set()
            continue
        if os.path.basename(root) in PRUNED:
            continue
        parents = [str(p) for p in reversed(Path(root).parents)]
        stack = [(root, [_rules_in(p) for p in parents])]
        while stack:
            folder, above = stack.pop()
            levels = [*above, _rules_in(folder)]
            try:
                entries = list(os.scandir(folder))
            except OSError:
                continue
            for e in entries:
                is_dir = e.is_dir(follow_symlinks=False)
                if e.is_symlink() or (is_dir and e.name in PRUNED) or _ignored(e.path, is_dir, levels, everywhere):
                    continue
                if is_dir:
                    stack.append((e.path, levels))
                elif extension(e.path) in wanted:
                    found.add(e.path)
    return sorted(found)


def decode(data: bytes) -> str:
    """UTF-8, each bad sequence replaced, one byte order mark dropped."""
    return data.decode("utf-8", "replace").removeprefix("﻿")


def relative(path: str, cwd: str) -> str:
    return os.path.relpath(path, cwd).replace("\\", "/") if path != cwd else path
