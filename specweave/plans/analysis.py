"""The trace analysis as DataFrame plans.

Input tables:

* items (item_seq, id, origin, file, line, character, title, tags, description)
* needs, covers (item_seq, ord, ref)
* forwards (fwd_seq, from, to, file, line, character)

``item_seq`` and ``fwd_seq`` carry the order of definition.  A node of the graph
is a canonical ID; several items may share it (duplicates).
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..sessions import discard, staged

PHASES = {
    "invalid-reference": 0, "duplicate-id": 1, "duplicate-forwarding": 2, "cyclic-forwarding": 3, "uncovered-forward": 4,
    "uncovered-need": 4, "orphaned-cover": 5, "unwanted-cover": 5, "unwanted-item": 6,
}
#: Pointer doublings in one job.
DOUBLINGS = 3
LOCATION = ("file", "line", "character")


def _location(prefix: str = "") -> Column:
    return F.struct(*(F.col(prefix + c).alias(c) for c in LOCATION))


def tag_filter(items: DataFrame, tags: list[str] | None) -> DataFrame:
    """Code items, and spec items with a listed tag; ``_`` admits untagged ones.  None keeps all."""
    if tags is None:
        return items
    keep = F.col("origin") == "code"
    if tags:
        keep = keep | F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    if "_" in tags:
        keep = keep | (F.size("tags") == 0)
    return items.where(keep)


class Trace:
    """All derived tables of one trace; each is planned when first asked for, and what others build on is staged once."""

    def __init__(self, items: DataFrame, needs: DataFrame, covers: DataFrame, forwards: DataFrame, parse_defects: DataFrame | None = None, parse_problems: DataFrame | None = None):
        i = F.col("id")
        self.items = items.withColumns({"key": ids.key_of(i), "revision": ids.revision_of(i), "canonical_id": ids.canonical_id(i)})
        self._needs, self._covers = needs, covers
        self.declared = forwards.withColumns({"c_from": ids.canonical_id(F.col("from")), "c_to": ids.canonical_id(F.col("to"))})
        self.parse_defects, self.parse_problems = parse_defects, parse_problems

    # ---- nodes and references

    @cached_property
    def own(self) -> DataFrame:
        """(item_seq, id, key, revision, canonical_id, origin) of all items."""
        return staged(self.items.select("item_seq", "id", "key", "revision", "canonical_id", "origin"), "own")

    @cached_property
    def needs(self) -> DataFrame:
        """(item_seq, ord, ref, node, key, level, prefix): needs with their item's canonical ID and the pattern they ask for."""
        rev = ids.revision_of(F.col("ref"))
        asked = self._needs.withColumns({"key": ids.key_of(F.col("ref")), "level": ids.pattern_level(rev), "prefix": ids.pattern_prefix(rev)})
        return staged(asked.join(self.own.select("item_seq", F.col("canonical_id").alias("node")), "item_seq"), "needs")

    @cached_property
    def covers(self) -> DataFrame:
        """(item_seq, ord, ref, c_ref, node)"""
        asked = self._covers.withColumn("c_ref", ids.canonical_id(F.col("ref")))
        return staged(asked.join(self.own.select("item_seq", F.col("canonical_id").alias("node")), "item_seq"), "covers")

    @cached_property
    def nodes(self) -> DataFrame:
        """(canonical_id, key, n) of each canonical ID; a count needs no sort, as the least of texts would."""
        return staged(self.own.groupBy("canonical_id").agg(F.count("*").alias("n")).withColumn("key", ids.key_of(F.col("canonical_id"))), "nodes")

    @cached_property
    def resolved(self) -> DataFrame:
        """(item_seq, ord, node, ref, target): each need with each canonical ID it means, by an equi-join on pinned layers."""
        have = self.nodes.select("key", F.col("canonical_id").alias("target"), F.inline(ids.prefixes(ids.revision_of(F.col("canonical_id")))))
        return staged(self.needs.join(have, ["key", "level", "prefix"]).select("item_seq", "ord", "node", "ref", "target"), "resolved")

    @cached_property
    def wanted_by(self) -> DataFrame:
        """(target, item_seq): items that need a canonical ID, each once."""
        return self.resolved.select("target", "item_seq").distinct()

    @cached_property
    def revisions(self) -> DataFrame:
        """(key, existing): distinct revisions of a key as written, in numeric order."""
        one = self.own.groupBy("key", "revision").agg(F.min("item_seq").alias("seq"))
        row = F.struct(ids.revision_order(F.col("revision")).alias("o"), F.col("seq"), F.col("revision").alias("r"))
        return one.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["r"]).alias("existing"))

    def _hinted(self, df: DataFrame) -> DataFrame:
        """``df`` (ref) with existing revisions of the reference's key and a hint for messages."""
        out = df.withColumn("key", ids.key_of(F.col("ref"))).join(self.revisions, "key", "left")
        text = F.concat(F.lit(" (revision mismatch: existing revision(s) of "), F.col("key"), F.lit(": "), F.array_join("existing", ", "), F.lit(")"))
        return out.withColumn("hint", F.coalesce(text, F.lit("")))

    # ---- forwards

    @cached_property
    def _judged(self) -> DataFrame:
        """Declared forwards with voided_by for a missing source and for all but the first of a source."""
        known = self.nodes.select(F.col("canonical_id").alias("c_from"), F.lit(True).alias("known"))
        per = Window.partitionBy("c_from").orderBy("fwd_seq")
        all_ = self.declared.join(known, "c_from", "left").withColumns({"nth": F.row_number().over(per), "declared": F.count("*").over(Window.partitionBy("c_from"))})
        why = F.when(F.col("known").isNull(), "missing-source").when(F.col("nth") > 1, "duplicate")
        return staged(all_.withColumn("voided_by", why).drop("known"), "forwards")

    @cached_property
    def cycle_nodes(self) -> DataFrame:
        """(c_from) on forwarding cycles: the image of the next-map after 2^k >= N steps, by pointer doubling."""
        step = staged(self._judged.where("voided_by is null").select(F.col("c_from").alias("a"), F.col("c_to").alias("b")), "step")
        total, done = step.count(), 1
        while total and done < total:
            last = now = step
            for _ in range(DOUBLINGS):
                now = now.alias("x").join(now.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
            step = staged(now, "step")
            discard(last)
            done *= 1 << DOUBLINGS
            if not step.count():
                break
        return step.select(F.col("b").alias("c_from")).distinct()

    @cached_property
    def forwards(self) -> DataFrame:
        """Declared forwards with their final ``effective`` and ``voided_by``."""
        on = self.cycle_nodes.withColumn("on_cycle", F.lit(True))
        out = self._judged.join(on, "c_from", "left")
        why = F.coalesce("voided_by", F.when(F.col("on_cycle"), "cycle"))
        return staged(out.withColumn("voided_by", why).withColumn("effective", F.col("voided_by").isNull()).drop("on_cycle"), "forwards")

    @cached_property
    def effective(self) -> DataFrame:
        """(node, to, c_to): where each forwarded canonical ID leads."""
        return self.forwards.where("effective").select(F.col("c_from").alias("node"), "to", "c_to")

    @staticmethod
    def _doubled(step: DataFrame, combine, changed) -> DataFrame:
        """``step`` (a, b, ...) joined with itself by pointer doubling until ``changed`` finds no row that still moves."""
        while True:
            now = step
            for last in range(DOUBLINGS - 1, -1, -1):
                both = now.alias("x").join(now.alias("y"), F.col("x.b") == F.col("y.a"), "left")
                now = both.select(F.col("x.a").alias("a"), *combine, *([] if last else [changed.alias("moved")]))
            now = staged(now, "doubled")
            moved = now.where("moved").limit(1).count()
            discard(step)
            step = now.drop("moved")
            step.staged_path = now.staged_path
            if not moved:
                return step

    @cached_property
    def _terminals(self) -> DataFrame:
        """(a, b): each forwarded node and the node that its chain of effective forwards ends at, by pointer doubling."""
        x, y = F.col("x.b"), F.col("y.b")
        step = staged(self.effective.select(F.col("node").alias("a"), F.col("c_to").alias("b")), "terminals")
        return self._doubled(step, [F.coalesce(y, x).alias("b")], y.isNotNull())

    @cached_property
    def chains(self) -> DataFrame:
        """(c_from, chain): the cycle's text, from the node that the earliest declared source reaches first.

        Three pointer doublings, each of as many rounds as the longest cycle or tail has binary digits:
        the least node of each cycle, where each source's walk enters one, and the order along it.
        """
        x, y = (lambda c: F.col("x." + c)), (lambda c: F.col("y." + c))
        cyclic = staged(self.forwards.where("voided_by = 'cycle'").select("c_from", "c_to", "fwd_seq", F.col("from").alias("name")), "cyclic")
        ring = staged(cyclic.select(F.col("c_from").alias("a"), F.col("c_to").alias("b"), F.least("c_from", "c_to").alias("root")), "ring")
        root = F.least(x("root"), y("root"))
        ring = self._doubled(ring, [y("b").alias("b"), root.alias("root")], root != x("root"))
        # a walk stops at the first node on a cycle
        loops = cyclic.select(F.col("c_from").alias("a"), F.col("c_from").alias("b"), "fwd_seq")
        tails = self.forwards.where("effective").select(F.col("c_from").alias("a"), F.col("c_to").alias("b"), "fwd_seq")
        walk = staged(loops.unionByName(tails), "walk")
        ends = F.coalesce(y("b"), x("b"))
        walk = self._doubled(walk, [ends.alias("b"), x("fwd_seq").alias("fwd_seq")], ends != x("b"))
        first = walk.join(ring.select(F.col("a").alias("b"), "root"), "b").groupBy("root").agg(F.min(F.struct("fwd_seq", "b"))["b"].alias("entry"))
        members = staged(cyclic.join(ring.select(F.col("a").alias("c_from"), "root"), "c_from").join(first, "root"), "members")
        # the ring is cut before its entry: what remains counts the steps to its end
        cut = F.when(F.col("c_to") != F.col("entry"), F.col("c_to"))
        line = staged(members.select(F.col("c_from").alias("a"), cut.alias("b"), F.when(cut.isNull(), 0).otherwise(1).cast("long").alias("left")), "line")
        line = self._doubled(line, [y("b").alias("b"), (x("left") + F.coalesce(y("left"), F.lit(0))).alias("left")], y("b").isNotNull())
        placed = members.join(line.select(F.col("a").alias("c_from"), "left"), "c_from")
        names = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("at"), "name"))), lambda r: r["name"])
        text = placed.groupBy("root").agg(names.alias("names")).select("root", F.array_join(F.concat("names", F.slice("names", 1, 1)), " --> ").alias("chain"))
        return members.select("c_from", "root").join(text, "root").select("c_from", "chain")

    @cached_property
    def needed(self) -> DataFrame:
        """(canonical_id): what needs and effective forwards ask for."""
        return self.resolved.select(F.col("target").alias("canonical_id")).union(self.effective.select("c_to")).distinct()

    # ---- defects

    def _defect(self, df: DataFrame, kind: str | None, message: Column, ord_: Column, ref: Column, location: Column | None = None, existing: Column | None = None) -> DataFrame:
        """Rows of one kind, or of the kind that each row of ``df`` names."""
        none = "struct<file:string,line:int,character:int>"
        own = F.lit(kind) if kind else F.col("kind")
        phase = F.lit(PHASES[kind]) if kind else F.coalesce(*(F.when(own == k, F.lit(p)) for k, p in PHASES.items()))
        return df.select(
            "item_seq", phase.alias("phase"), ord_.cast("long").alias("ord"), own.alias("kind"), ref.alias("ref"), message.alias("message"),
            (F.lit(None).cast(none) if location is None else location.cast(none)).alias("location"), (F.lit(None).cast("array<string>") if existing is None else existing).alias("existing_revisions"),
        )

    @cached_property
    def duplicates(self) -> DataFrame:
        """Items of one canonical ID; the message shows the spelling that all of them share, else the canonical one."""
        rows = self.own.select("item_seq", "canonical_id", "id").join(self.nodes.where("n > 1").select("canonical_id", "n"), "canonical_id")
        shown = F.when(F.min("id") == F.max("id"), F.min("id")).otherwise(F.col("canonical_id"))
        rows = rows.select("item_seq", "canonical_id", "n").join(rows.groupBy("canonical_id").agg(shown.alias("shown")), "canonical_id")
        return self._defect(rows, "duplicate-id", F.concat(F.lit("duplicate: ID "), "shown", F.lit(" is defined "), "n", F.lit(" times")), F.lit(0), F.col("shown"))

    @cached_property
    def duplicate_forwardings(self) -> DataFrame:
        first = self._judged.where("nth = 1 and declared > 1 and voided_by is null").select(F.col("c_from").alias("canonical_id"), "from", "declared", _location().alias("at"))
        rows = self.own.join(first, "canonical_id")
        return self._defect(rows, "duplicate-forwarding", F.concat(F.lit("duplicate: forwarding for "), "from", F.lit(" is declared "), "declared", F.lit(" times")), F.lit(0), F.col("from"), F.col("at"))

    @cached_property
    def cyclic(self) -> DataFrame:
        on = self.forwards.where("voided_by = 'cycle'").select("c_from", "to", _location().alias("at")).join(self.chains, "c_from")
        rows = self.own.join(on.withColumnRenamed("c_from", "canonical_id"), "canonical_id")
        text = F.concat(F.lit("cyclic: forwards to "), "to", F.lit(", closing the cycle "), "chain", F.lit(", so the forwarding has no effect"))
        return self._defect(rows, "cyclic-forwarding", text, F.lit(0), F.col("to"), F.col("at"))

    def _lost_forwards(self) -> DataFrame:
        ends = self.effective.join(self.nodes.select(F.col("canonical_id").alias("c_to")), "c_to", "left_anti").select(F.col("node").alias("canonical_id"), F.col("to").alias("ref"))
        return self.own.select("item_seq", "canonical_id").join(ends, "canonical_id").withColumn("ord", F.lit(0))

    def _lost_needs(self) -> DataFrame:
        return self.needs.join(self.effective.select("node"), "node", "left_anti").join(self.resolved.select("item_seq", "ord").distinct(), ["item_seq", "ord"], "left_anti")

    def _lost_covers(self) -> DataFrame:
        return self.covers.join(self.nodes.select(F.col("canonical_id").alias("c_ref")), "c_ref", "left_anti")

    def _lost(self, *kinds: str) -> DataFrame:
        """Forwards, needs and covers of what doesn't exist; the revisions that there are instead are looked up once for all ``kinds``."""
        rows = {"uncovered-forward": self._lost_forwards, "uncovered-need": self._lost_needs, "orphaned-cover": self._lost_covers}
        words = {"uncovered-forward": "uncovered: forwards to ", "uncovered-need": "uncovered: needs ", "orphaned-cover": "orphaned: covers "}
        parts = [rows[k]().select("item_seq", F.col("ord").cast("long").alias("ord"), "ref", F.lit(k).alias("kind"), F.lit(words[k]).alias("words")) for k in kinds]
        found = self._hinted(reduce(DataFrame.unionByName, parts))
        return self._defect(found, None, F.concat("words", "ref", F.lit(", which does not exist"), "hint"), F.col("ord"), F.col("ref"), existing=F.col("existing"))

    @cached_property
    def uncovered_forwards(self) -> DataFrame:
        return self._lost("uncovered-forward")

    @cached_property
    def uncovered_needs(self) -> DataFrame:
        return self._lost("uncovered-need")

    @cached_property
    def orphaned_covers(self) -> DataFrame:
        return self._lost("orphaned-cover")

    @cached_property
    def unwanted_covers(self) -> DataFrame:
        there = self.covers.join(self.nodes.select(F.col("canonical_id").alias("c_ref")), "c_ref", "left_semi")
        asked = self.resolved.select(F.col("node").alias("c_ref"), F.col("target").alias("node")).distinct()
        rows = there.join(asked, ["c_ref", "node"], "left_anti").join(self.own.select("item_seq", "id"), "item_seq")
        text = F.concat(F.lit("unwanted: covers "), "ref", F.lit(", but "), "ref", F.lit(" does not need "), "id")
        return self._defect(rows, "unwanted-cover", text, F.col("ord"), F.col("ref"))

    @cached_property
    def unwanted_items(self) -> DataFrame:
        rows = self.own.where("origin = 'code'").join(self.needed, "canonical_id", "left_anti")
        return self._defect(rows, "unwanted-item", F.concat(F.lit("unwanted: no item needs "), "id"), F.lit(0), F.col("id"))

    @cached_property
    def defects(self) -> DataFrame:
        lost = self._lost("uncovered-forward", "uncovered-need", "orphaned-cover")
        parts = [self.duplicates, self.duplicate_forwardings, self.cyclic, lost, self.unwanted_covers, self.unwanted_items]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        if self.parse_defects is not None:
            out = out.unionByName(self.parse_defects.select(*out.columns).join(self.own.select("item_seq"), "item_seq", "left_semi"))
        return staged(out, "defects")

    @cached_property
    def missing_sources(self) -> DataFrame:
        """(fwd_seq, message, location): forwards whose source isn't defined."""
        rows = self._hinted(self._judged.where("voided_by = 'missing-source'").withColumn("ref", F.col("from")))
        return rows.select("fwd_seq", "c_from", F.concat(F.lit("forwarding from "), "from", F.lit(", which does not exist"), "hint").alias("message"), _location().alias("location"))

    # ---- deep coverage

    @cached_property
    def broken(self) -> DataFrame:
        """(node) whose chain of needs breaks somewhere: the least fixpoint, by semi-naive rounds.

        A need breaks when it has no match or all its matches are broken; a node when any of its
        needs, or the target of its effective forward, is.  A round joins only the last round's nodes,
        so rounds are as many as the longest chain of needs.
        """
        # a forwarded node is what its chain of forwards ends at
        ends = self._terminals
        edge = self.resolved.join(ends.withColumnRenamed("a", "target"), "target", "left").select("item_seq", "ord", F.coalesce("b", "target").alias("target"))
        edge = edge.select(F.col("item_seq").alias("o1"), F.col("ord").cast("long").alias("o2"), "target")
        duty = self.needs.join(ends.select(F.col("a").alias("node")), "node", "left_anti").select(F.col("item_seq").alias("o1"), F.col("ord").cast("long").alias("o2"), "node")
        lost = ends.select(F.col("b").alias("node")).join(self.nodes.select(F.col("canonical_id").alias("node")), "node", "left_anti")
        total = edge.groupBy("o1", "o2").agg(F.count("*").alias("n"))
        duty = staged(duty.join(total, ["o1", "o2"], "left").withColumn("n", F.coalesce("n", F.lit(0))), "duties")
        edge = staged(edge.join(duty.where("n > 0"), ["o1", "o2"]), "edges")
        front = staged(duty.where("n = 0").select("node").unionByName(lost).distinct(), "front")
        found, hits = [front], []
        while front.count():
            new = edge.join(front.select(F.col("node").alias("target")), "target")
            # an obligation of several matches waits until its hits add up; only those that were hit are kept
            hits.append(staged(new.where("n > 1").groupBy("o1", "o2", "node", "n").agg(F.count("*").alias("m")), "hits"))
            if len(hits) > 8:
                old, hits = hits, [staged(reduce(DataFrame.unionByName, hits).groupBy("o1", "o2", "node", "n").agg(F.sum("m").alias("m")), "hits")]
                discard(*old)
            full = reduce(DataFrame.unionByName, hits).groupBy("o1", "o2", "node", "n").agg(F.sum("m").alias("m")).where("m >= n")
            now = new.where("n = 1").select("node").unionByName(full.select("node")).distinct()
            front = staged(now.join(reduce(DataFrame.unionByName, found), "node", "left_anti"), "front")
            found.append(front)
            if len(found) > 8:
                old, found = found[:-1], [staged(reduce(DataFrame.unionByName, found[:-1]), "broken"), front]
                discard(*old)
        discard(edge, duty, *hits)
        out = reduce(DataFrame.unionByName, found)
        led = ends.join(out.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"))
        return out.unionByName(led).join(self.nodes.select(F.col("canonical_id").alias("node")), "node", "left_semi")

    # ---- nested lists of the report

    @cached_property
    def resolved_to(self) -> DataFrame:
        """(item_seq, ord, ref, resolved_to): each need's IDs as written, by revision and then in order of definition, each once."""
        spelled = self.own.groupBy("canonical_id", "id").agg(F.min("item_seq").alias("seq"))
        row = F.struct(ids.revision_order(ids.revision_of(F.col("target"))).alias("o"), F.col("target"), F.col("seq"), F.col("id"))
        found = self.resolved.join(spelled.withColumnRenamed("canonical_id", "target"), "target").groupBy("item_seq", "ord").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["id"]).alias("resolved_to"))
        return self.needs.select("item_seq", "ord", "ref").join(found, ["item_seq", "ord"], "left").withColumn("resolved_to", F.coalesce("resolved_to", F.array().cast("array<string>")))

    def _linked_items(self, pairs: DataFrame, name: str) -> DataFrame:
        """(item_seq, ``name``) of pairs (canonical_id, other): other items' (location, id), by location."""
        other = self.items.select(F.col("item_seq").alias("other"), _location().alias("location"), F.col("id").alias("other_id"))
        rows = pairs.join(other, "other").join(self.own.select("item_seq", "canonical_id"), "canonical_id")
        row = F.struct("location", F.col("other").alias("seq"), F.col("other_id").alias("id"))
        return rows.groupBy("item_seq").agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: F.struct(x["id"].alias("id"), x["location"].alias("location"))).alias(name))

    @cached_property
    def wanted_by_lists(self) -> DataFrame:
        """(item_seq, wanted_by): the items that need each item, by location."""
        return self._linked_items(self.wanted_by.select(F.col("target").alias("canonical_id"), F.col("item_seq").alias("other")), "wanted_by")

    @cached_property
    def forwarded_from(self) -> DataFrame:
        """(item_seq, forwarded_from): the items whose effective forward leads to each item, by location."""
        led = self.effective.join(self.own.select(F.col("canonical_id").alias("node"), F.col("item_seq").alias("other")), "node")
        return self._linked_items(led.select(F.col("c_to").alias("canonical_id"), "other"), "forwarded_from")

    @cached_property
    def cover_states(self) -> DataFrame:
        """(item_seq, ord, ref, status): valid, orphaned or unwanted."""
        lost = self.orphaned_covers.select("item_seq", "ord", F.lit("orphaned").alias("status")).unionByName(self.unwanted_covers.select("item_seq", "ord", F.lit("unwanted").alias("status")))
        out = self.covers.select("item_seq", F.col("ord").cast("long").alias("ord"), "ref").join(lost, ["item_seq", "ord"], "left")
        return out.withColumn("status", F.coalesce("status", F.lit("valid")))

    def write_tables(self, path: str, format: str = "parquet") -> None:
        """Items with status, and all edges, defects and problems, as folders of ``path``: reports of any size, without the driver."""
        state = self.statuses.select("item_seq", "defective", "deep_covered", "status")
        tables = {
            "items": self.items.join(state, "item_seq"), "needs": self.resolved_to, "covers": self.cover_states, "wanted_by": self.wanted_by_lists, "forwards": self.forwards,
            "forwarded_from": self.forwarded_from, "defects": self.defects, "problems": self.missing_sources.select("message", "location"), "summary": self.summary,
        }
        if self.parse_problems is not None:
            tables["problems"] = tables["problems"].unionByName(self.parse_problems.select("message", "location"))
        for name, df in tables.items():
            df.write.format(format).save(f"{path}/{name}")

    @cached_property
    def statuses(self) -> DataFrame:
        """(item_seq, id, canonical_id, origin, defective, deep_covered, status)."""
        bad = self.defects.select("item_seq").distinct().withColumn("defective", F.lit(True))
        broken = self.broken.select(F.col("node").alias("canonical_id"), F.lit(True).alias("broken"))
        out = self.own.join(bad, "item_seq", "left").join(broken, "canonical_id", "left")
        out = out.withColumns({"defective": F.coalesce("defective", F.lit(False)), "deep_covered": F.col("broken").isNull()})
        status = F.when(F.col("defective"), "defective").when(F.col("deep_covered"), "deep-covered").otherwise("shallow-covered")
        return out.select("item_seq", "id", "canonical_id", "origin", "defective", "deep_covered", status.alias("status"))

    @cached_property
    def summary(self) -> DataFrame:
        """One row: items, spec_items, code_items, ok_items, defective_items, shallow_covered_items, problems."""
        n = self.missing_sources.agg(F.count("*").alias("p"))
        if self.parse_problems is not None:
            n = n.unionByName(self.parse_problems.agg(F.count("*").alias("p"))).agg(F.sum("p").alias("p"))
        count = lambda c: F.count_if(F.expr(c))
        own = self.statuses.agg(
            F.count("*").alias("items"), count("origin = 'spec'").alias("spec_items"), count("origin = 'code'").alias("code_items"), count("not defective").alias("ok_items"),
            count("defective").alias("defective_items"), count("status = 'shallow-covered'").alias("shallow_covered_items"),
        )
        return own.join(n.withColumnRenamed("p", "problems"), F.lit(True))
