"""Tags in the comments of one source file.

Each line is masked so that only comment text is left at its place, then tags
are read from the mask.  Block comments and regions of composite files are the
state that goes from line to line.
"""

from __future__ import annotations

import re

from ..functions.ids import ID, NEED_REF
from ..functions.refs import FORWARD, WS, canonical, complete, split_lines
from ..sources.grammars import Composite, Leaf, grammar_for

_URL = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{0,63}://[^\t\n\x0b\x0c\r \x85\xa0  -     　"'`<>\[\]]*""")
_TAG = re.compile(rf"\[(?:{WS}*(?P<src>{ID}){WS}*)?>>{WS}*(?P<ref>{NEED_REF}){WS}*\]|\[{WS}*(?P<item>{ID}){WS}*\]")
_REF = re.compile(NEED_REF)
_FORWARD = re.compile(FORWARD)


def url_spans(line: str) -> list[tuple[int, int]]:
    return [m.span() for m in _URL.finditer(line)] if "://" in line else []


class CommentMask:
    """Masks one line after another; remembers the open block and region."""

    def __init__(self, grammar: Leaf | Composite):
        self.grammar = grammar
        self.block: tuple[str, str, bool] | None = None
        self.depth = 0
        self.region: tuple[re.Pattern, Leaf] | None = None

    @property
    def leaf(self) -> Leaf:
        if self.region:
            return self.region[1]
        return self.grammar.default if isinstance(self.grammar, Composite) else self.grammar

    def _opener(self, line: str, pos: int, urls):
        """(index, -length, rank, what) of the next sign outside comments; ties go to the longest, then by rank."""

        def first(token: str) -> int:
            at = line.find(token, pos)
            while at >= 0 and any(a <= at < b for a, b in urls):
                at = line.find(token, at + 1)
            return at

        found = [(at, -len(t), 0, None) for t in self.leaf.lines if (at := first(t)) >= 0]
        found += [(at, -len(b[0]), 1, b) for b in self.leaf.blocks if (at := first(b[0])) >= 0]
        if self.region:
            if m := self.region[0].search(line, pos):
                found.append((m.start(), m.start() - m.end(), 2, ()))
        elif isinstance(self.grammar, Composite):
            found += [(m.start(), m.start() - m.end(), 2, (exit_, choose(m[0]))) for enter, exit_, choose in self.grammar.regions if (m := enter.search(line, pos))]
        return min(found, key=lambda x: x[:3], default=None)

    def _in_block(self, line: str, pos: int, limit: int) -> tuple[int, int]:
        """(end of the comment's text, where to go on) within the open block."""
        open_, close, nests = self.block
        while pos < limit:
            shut = line.find(close, pos)
            deeper = line.find(open_, pos) if nests else -1
            shut, deeper = (x if 0 <= x < limit else -1 for x in (shut, deeper))
            if deeper >= 0 and (shut < 0 or deeper < shut):
                self.depth, pos = self.depth + 1, deeper + len(open_)
            elif shut >= 0:
                self.depth, pos = self.depth - 1, shut + len(close)
                if not self.depth:
                    self.block = None
                    return shut, pos
            else:
                break
        return limit, limit

    def __call__(self, line: str) -> str:
        urls, kept, pos = url_spans(line), [], 0
        while pos < len(line):
            leave = self.region[0].search(line, pos) if self.region else None
            if self.block:
                end, after = self._in_block(line, pos, leave.start() if leave else len(line))
                kept.append((pos, end))
                if self.block and leave:  # a region's end closes whatever is open
                    self.block, self.region, after = None, None, leave.end()
                pos = after
                continue
            sign = self._opener(line, pos, urls)
            if not sign:
                break
            at, length, rank, what = sign
            pos = at - length
            if rank == 0:
                end = leave.start() if leave else len(line)
                kept.append((pos, end))
                if not leave:
                    break
                self.region, pos = None, leave.end()
            elif rank == 1:
                self.block, self.depth = what, 1
            else:
                self.region = what or None
        out = [" "] * len(line)
        for a, b in kept:
            out[a:b] = line[a:b]
        return "".join(out)


def comment_text(text: str, extension: str) -> str:
    """All lines of ``text`` with everything but comments blanked."""
    mask = CommentMask(grammar_for(extension))
    return "\n".join(map(mask, split_lines(text)))


def parse_code(file: str, extension: str, text: str) -> list[dict]:
    """Rows of kind item, need, forward and problem; needs name their item by its index in the file."""
    mask, rows = CommentMask(grammar_for(extension)), []
    items: list[str] = []
    counts: list[int] = []
    anchors: dict[str, int] = {}
    for n, raw in enumerate(split_lines(text), 1):
        line = mask(raw)
        if "[" not in line:
            continue
        for m in _FORWARD.finditer(line):
            b = [x[0] for x in re.finditer(ID, m[0])]
            rows.append({"kind": "forward", "line": n, "character": m.start() + 1, "id": b[0], "ref": b[1]})
        for m in _TAG.finditer(line):
            place = {"line": n, "character": m.start() + 1}
            if m["item"]:
                anchors[canonical(m["item"])] = len(items)
                items.append(m["item"])
                counts.append(0)
                rows.append({"kind": "item", "item": len(items) - 1, "id": m["item"], "origin": "code", **place})
                continue
            to = anchors.get(canonical(m["src"])) if m["src"] else (len(items) - 1 if items else None)
            if to is None:
                tag = f"[{m['src']} >> {m['ref']}]" if m["src"] else f"[>>{m['ref']}]"
                own = f" [{m['src']}]" if m["src"] else ""
                rows.append({"kind": "problem", "message": f"need tag {tag} has no preceding item tag{own} in this file", **place})
                continue
            ref = _REF.fullmatch(m["ref"])
            rows.append({"kind": "need", "item": to, "ord": counts[to], "ref": complete(ref[1], ref[2], ref[3], items[to]), **place})
            counts[to] += 1
    return rows
