"""Column expressions over item IDs ``type:[group/]name#revision``; no UDFs.

A revision has one to three numeric layers of any size, compared by length and
then text.  A wildcard pattern pins a prefix of the three canonical layers, so
``(key, level, prefix)`` turns revision matching into an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT = r"[A-Za-z][A-Za-z0-9_.-]*"
PATH = rf"(?:{SEGMENT}/)*{SEGMENT}"
REVISION = r"[0-9]+(?:\.[0-9]+){0,2}"
WILDCARD = r"(?:[0-9]+\.){0,2}[x*]"
ID = rf"([A-Za-z]+):(?:({PATH})/)?({SEGMENT})#({REVISION})"
NEED_REF = rf"([A-Za-z]+)(?::({PATH}))?(?:#((?:{WILDCARD}|{REVISION})))?"
COVER_REF = rf"([A-Za-z]+)(?::({PATH}))?(?:#({REVISION}))?"
#: Unicode White_Space, as a Java character class.
SPACE = r"[\u0009-\u000D \u0085   -     　]"


def _whole(pattern: str) -> str:
    return rf"\A{pattern}\z"


def is_id(c: Column) -> Column:
    return c.rlike(_whole(ID))


def parse_id(c: Column) -> Column:
    """struct(type, group, name, revision); null for other texts, group null where absent."""
    path = path_of(c)
    name = F.substring_index(path, "/", -1)
    group = F.when(F.contains(path, F.lit("/")), F.left(path, F.length(path) - F.length(name) - 1))
    return F.when(is_id(c), F.struct(F.substring_index(c, ":", 1).alias("type"), group.alias("group"), name.alias("name"), revision_of(c).alias("revision")))


def make_id(kind: Column, group: Column, name: Column, revision: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.coalesce(F.concat(group, F.lit("/")), F.lit("")), name, F.lit("#"), revision)


def key_of(c: Column) -> Column:
    """What stands before the last ``#``."""
    return F.left(c, F.length(c) - F.length(revision_of(c)) - 1)


def revision_of(c: Column) -> Column:
    return F.substring_index(c, "#", -1)


def path_of(c: Column) -> Column:
    """What stands between the first ``:`` and the last ``#``."""
    return F.substr(key_of(c), F.instr(c, ":") + 1)


def canonical_layer(c: Column) -> Column:
    stripped = F.ltrim(c, F.lit("0"))
    return F.when(stripped == "", F.lit("0")).otherwise(stripped)


def layers(revision: Column) -> Column:
    """The three canonical layers."""
    parts = F.split(revision, r"\.")
    return F.array(*(canonical_layer(F.coalesce(F.get(parts, F.lit(i)), F.lit("0"))) for i in range(3)))


def canonical_revision(revision: Column) -> Column:
    return F.array_join(layers(revision), ".")


def canonical_id(c: Column) -> Column:
    return F.concat(key_of(c), F.lit("#"), canonical_revision(revision_of(c)))


def revision_order(revision: Column) -> Column:
    """A sort key of numeric order for layers of any size."""
    return F.transform(layers(revision), lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))


def is_wildcard(revision: Column) -> Column:
    return F.contains(revision, F.lit("x")) | F.contains(revision, F.lit("*"))


def pattern_level(revision: Column) -> Column:
    """How many layers a need's revision pins: 3 if it is concrete."""
    return F.when(is_wildcard(revision), F.size(F.split(revision, r"\.")) - 1).otherwise(3)


def pattern_prefix(revision: Column) -> Column:
    return F.array_join(F.slice(layers(F.regexp_replace(revision, "[x*]", "0")), F.lit(1), pattern_level(revision)), ".")


def prefixes(revision: Column) -> Column:
    """array(struct(level, prefix)): the four patterns that a concrete revision meets."""
    own = layers(revision)
    return F.array(*(F.struct(F.lit(n).alias("level"), F.array_join(F.slice(own, 1, n), ".").alias("prefix")) for n in range(4)))


def revision_matches(pattern: Column, concrete: Column) -> Column:
    return F.array_join(F.slice(layers(concrete), F.lit(1), pattern_level(pattern)), ".") == pattern_prefix(pattern)


def id_matches(pattern: Column, concrete: Column) -> Column:
    return (key_of(pattern) == key_of(concrete)) & revision_matches(revision_of(pattern), revision_of(concrete))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def _complete(entry: Column, owner: Column, pattern: str) -> Column:
    ref = trim(F.regexp_replace(entry, "`", ""))
    part = lambda i: F.nullif(F.regexp_extract(ref, _whole(pattern), i), F.lit(""))
    full = F.concat(part(1), F.lit(":"), F.coalesce(part(2), path_of(owner)), F.lit("#"), F.coalesce(part(3), revision_of(owner)))
    return F.when(ref.rlike(_whole(pattern)), full)


def parse_need(entry: Column, owner: Column) -> Column:
    """The full reference of a need entry, missing parts taken from the owner's ID; null if invalid."""
    return _complete(entry, owner, NEED_REF)


def parse_cover(entry: Column, owner: Column) -> Column:
    """As ``parse_need``, concrete revisions only."""
    return _complete(entry, owner, COVER_REF)
