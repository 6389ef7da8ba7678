"""Comment grammars by file extension."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Leaf:
    lines: tuple[str, ...] = ()
    #: (open, close, nestable)
    blocks: tuple[tuple[str, str, bool], ...] = ()


@dataclass(frozen=True)
class Composite:
    default: Leaf
    regions: tuple = field(default=())


#: Comment signs of each family of languages.
LEAVES = {
    "c": Leaf(("//",), (("/*", "*/", False),)),
    "c-nested": Leaf(("//",), (("/*", "*/", True),)),
    "php": Leaf(("//", "#"), (("/*", "*/", False),)),
    "hash": Leaf(("#",)),
    "coffee": Leaf(("#", "####"), (("###", "###", False),)),
    "julia": Leaf(("#",), (("#=", "=#", True),)),
    "nim": Leaf(("#",), (("#[", "]#", True), ("##[", "]##", True))),
    "cmake": Leaf(("#",), (("#[[", "]]", False),)),
    "powershell": Leaf(("#",), (("<#", "#>", False),)),
    "sql": Leaf(("--",), (("/*", "*/", False),)),
    "lua": Leaf(("--",), (("--[[", "]]", False),)),
    "haskell": Leaf(("--",), (("{-", "-}", True),)),
    "css": Leaf((), (("/*", "*/", False),)),
    "xml": Leaf((), (("<!--", "-->", False),)),
    "none": Leaf(),
    "semicolon": Leaf((";",)),
    "scheme": Leaf((";",), (("#|", "|#", True),)),
    "percent": Leaf(("%",)),
    "dash": Leaf(("--",)),
    "ml": Leaf((), (("(*", "*)", True),)),
    "fsharp": Leaf(("//",), (("(*", "*)", True),)),
    "pascal": Leaf(("//",), (("{", "}", False), ("(*", "*)", False))),
    "hcl": Leaf(("#", "//"), (("/*", "*/", False),)),
}
#: Extensions of each family.
EXTENSIONS = {
    "c": "ts js mjs cjs jsx tsx cts mts c h cpp cc hpp cxx hxx ino inl tpp cs java go groovy gradle sol dart proto scss less",
    "c-nested": "rs swift kt kts scala",
    "php": "php",
    "hash": "py rb sh bash zsh yaml yml toml r pm ex exs tcl cr gd awk graphql gql",
    "coffee": "coffee",
    "julia": "jl",
    "nim": "nim",
    "cmake": "cmake",
    "powershell": "ps1 psm1",
    "sql": "sql",
    "lua": "lua",
    "haskell": "hs elm purs",
    "css": "css",
    "xml": "xml svg",
    "semicolon": "clj cljs cljc edn el lisp",
    "scheme": "scm ss rkt",
    "percent": "erl hrl tex sty",
    "dash": "adb ads vhd vhdl",
    "ml": "ml mli",
    "fsharp": "fs fsi fsx",
    "pascal": "pas dpr",
    "hcl": "tf tfvars hcl",
    "html": "vue html htm svelte",
}
SPEC_EXTENSIONS = frozenset({"md", "markdown"})


def _attribute(tag: str, name: str) -> str:
    found = re.search(rf"""(?i)\s{name}\s*=\s*["']?([^"'\s>]+)""", tag)
    return found[1].lower() if found else ""


def script_leaf(tag: str) -> Leaf:
    kind = _attribute(tag, "type")
    if "json" in kind or "importmap" in kind:
        return LEAVES["none"]
    if "template" in kind or "html" in kind:
        return LEAVES["xml"]
    return LEAVES["coffee" if "coffee" in _attribute(tag, "lang") else "c"]


def style_leaf(tag: str) -> Leaf:
    lang = _attribute(tag, "lang")
    return LEAVES["c" if any(x in lang for x in ("sass", "scss", "less", "styl")) else "css"]


HTML = Composite(
    LEAVES["xml"],
    (
        (re.compile(r"(?i)<script\b[^>]*>"), re.compile(r"(?i)</script\s*>"), script_leaf),
        (re.compile(r"(?i)<style\b[^>]*>"), re.compile(r"(?i)</style\s*>"), style_leaf),
    ),
)
_BY_EXTENSION = {e: HTML if name == "html" else LEAVES[name] for name, all_ in EXTENSIONS.items() for e in all_.split()}
CODE_EXTENSIONS = frozenset(_BY_EXTENSION)


def grammar_for(extension: str) -> Leaf | Composite:
    """The grammar of an extension; unknown ones read like C."""
    return _BY_EXTENSION.get(extension, LEAVES["c"])
