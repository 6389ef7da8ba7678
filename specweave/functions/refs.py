"""The same ID rules for text inside the per-file parsers."""

from __future__ import annotations

import re

from .ids import COVER_REF, ID, NEED_REF

#: Unicode White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
WS = f"[{SPACES}]"
NWS = f"[^{SPACES}]"
FORWARD = rf"\[{WS}*({ID}){WS}*-->{WS}*({ID}){WS}*\]"
_NEED, _COVER = re.compile(NEED_REF), re.compile(COVER_REF)


def complete(kind: str, path: str | None, revision: str | None, owner: str) -> str:
    """A full reference; missing parts come from the owner's ID."""
    key, _, own = owner.rpartition("#")
    return f"{kind}:{path or key.split(':', 1)[1]}#{revision or own}"


def parse_ref(entry: str, owner: str, cover: bool = False) -> str | None:
    found = (_COVER if cover else _NEED).fullmatch(entry.replace("`", "").strip(SPACES))
    return complete(found[1], found[2], found[3], owner) if found else None


def canonical(id_: str) -> str:
    key, _, revision = id_.rpartition("#")
    parts = [p.lstrip("0") or "0" for p in revision.split(".")]
    return f"{key}#{'.'.join(parts + ['0'] * (3 - len(parts)))}"


def split_lines(text: str) -> list[str]:
    """Lines end at LF, with one CR before it; a last empty one is none."""
    out = text.split("\n")
    last = out.pop()
    out = [x[:-1] if x.endswith("\r") else x for x in out]
    return out + [last] if last else out
