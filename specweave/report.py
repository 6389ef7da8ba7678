"""JSON and text reports of a trace.

The frames are joined on the cluster; the report itself, which spells out every
item, is one ordered document and is assembled on the driver.
"""

from __future__ import annotations

import json
import os
import sys

from .plans.analysis import PHASES, Trace

SCHEMA_VERSION = 0


class Report:
    def __init__(self, trace: Trace):
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        self.items = sorted(rows(trace.items.join(trace.statuses.select("item_seq", "defective", "deep_covered", "status"), "item_seq")), key=lambda r: r["item_seq"])
        self.by_seq = {r["item_seq"]: r for r in self.items}
        self.by_canonical: dict[str, list[dict]] = {}
        for r in self.items:
            r |= {"needs": [], "covers": [], "defects": [], "wanted_by": []}
            self.by_canonical.setdefault(r["canonical_id"], []).append(r)
        matches: dict[tuple, list[str]] = {}
        for r in rows(trace.resolved):
            matches.setdefault((r["item_seq"], r["ord"]), []).append(r["target"])
        for r in sorted(rows(trace.needs), key=lambda r: (r["item_seq"], r["ord"])):
            self.by_seq[r["item_seq"]]["needs"].append((r["ref"], matches.get((r["item_seq"], r["ord"]), [])))
        for r in sorted(rows(trace.covers), key=lambda r: (r["item_seq"], r["ord"])):
            self.by_seq[r["item_seq"]]["covers"].append((r["ref"], r["c_ref"]))
        for r in sorted(rows(trace.wanted_by), key=lambda r: r["item_seq"]):
            for own in self.by_canonical[r["target"]]:
                own["wanted_by"].append(self.by_seq[r["item_seq"]])
        for r in sorted(rows(trace.defects), key=lambda r: (r["phase"], r["ord"])):
            self.by_seq[r["item_seq"]]["defects"].append(r)
        self.effective = {r["node"]: (r["to"], r["c_to"]) for r in rows(trace.effective)}
        self.forwards = sorted(rows(trace.forwards), key=lambda r: r["fwd_seq"])
        late = sorted(rows(trace.missing_sources), key=lambda r: r["fwd_seq"])
        first = {}
        for r in late:
            first.setdefault(r["c_from"], r["fwd_seq"])
        late.sort(key=lambda r: (first[r["c_from"]], r["fwd_seq"]))
        early = sorted(rows(trace.parse_problems), key=lambda r: (r["file_seq"], r["nth"])) if trace.parse_problems is not None else []
        self.problems = early + late
        self.summary = rows(trace.summary)[0]
        self.clean = not self.summary["defective_items"] and not self.summary["problems"]

    # ---- JSON

    @staticmethod
    def _at(r: dict) -> dict:
        return {"file": r["file"], "line": r["line"], "character": r["character"]}

    def document(self, version: str, tool: str = "specweave") -> dict:
        place = lambda r: (r["file"], r["line"], r["character"])
        link = lambda r: {"id": r["id"], "location": self._at(r)}
        order = lambda c: [(len(x), x) for x in c.rpartition("#")[2].split(".")]
        into: dict[str, list[dict]] = {}
        for node, (_, to) in self.effective.items():
            into.setdefault(to, []).extend(self.by_canonical.get(node, []))

        def item(r: dict) -> dict:
            bad = {(d["kind"], d["ref"]) for d in r["defects"]}
            needs = [{"ref": ref, "resolvedTo": list(dict.fromkeys(x["id"] for c in sorted(found, key=order) for x in self.by_canonical[c]))} for ref, found in r["needs"]]
            covers = [{"ref": ref, "status": "orphaned" if ("orphaned-cover", ref) in bad else "unwanted" if ("unwanted-cover", ref) in bad else "valid"} for ref, _ in r["covers"]]
            defects = []
            for d in r["defects"]:
                one = {"kind": d["kind"], "ref": d["ref"]}
                if d["location"]:
                    one["location"] = d["location"]
                if d["existing_revisions"]:
                    one["existingRevisions"] = d["existing_revisions"]
                defects.append(one | {"message": d["message"]})
            return {
                "id": r["id"], "title": r["title"], "origin": r["origin"], "tags": r["tags"], "location": self._at(r), "status": r["status"], "defective": r["defective"], "deepCovered": r["deep_covered"],
                "needs": needs, "covers": covers, "forwardsTo": self.effective.get(r["canonical_id"], (None,))[0], "forwardedFrom": [link(x) for x in sorted(into.get(r["canonical_id"], []), key=place)],
                "defects": defects, "wantedBy": [link(x) for x in sorted(r["wanted_by"], key=place)],
            }

        forwards = [{"from": f["from"], "to": f["to"], "location": self._at(f), "effective": f["effective"]} | ({"voidedBy": f["voided_by"]} if f["voided_by"] else {}) for f in sorted(self.forwards, key=place)]
        problems = [{"location": p["location"], "message": p["message"]} for p in sorted(self.problems, key=lambda p: place(p["location"]))]
        s = self.summary
        counts = {"items": s["items"], "specItems": s["spec_items"], "codeItems": s["code_items"], "okItems": s["ok_items"], "defectiveItems": s["defective_items"], "shallowCoveredItems": s["shallow_covered_items"], "problems": s["problems"]}
        return {"schemaVersion": SCHEMA_VERSION, tool: version, "ok": self.clean, "items": [item(r) for r in sorted(self.items, key=place)], "forwards": forwards, "problems": problems, "summary": counts}

    def json(self, version: str) -> str:
        return json.dumps(self.document(version), indent=2, ensure_ascii=False) + "\n"

    # ---- text

    def text(self, verbose: bool = False, colour: bool = False) -> str:
        paint = (lambda code, x: f"\x1b[{code}m{x}\x1b[0m") if colour else (lambda code, x: x)
        at = lambda r: paint(2, f"{r['file']}:{r['line']}")
        dim, bold = (lambda x: paint(2, x)), (lambda x: paint(1, x))
        title = lambda r: " " + dim(f'"{r["title"]}"') if r["title"] is not None else ""
        looks = {"defective": (31, "✘"), "shallow-covered": (33, "~"), "deep-covered": (32, "✔")}
        mark = lambda r: paint(*looks[r["status"]])
        defects = lambda r: [f"    {paint(31, '•')} {d['message']}" + (f"  {at(d['location'])}" if d["location"] else "") for d in r["defects"]]
        out: list[str] = []

        def edge(word: str, ref: str, canonical: str | None, own_mark: bool = True, arrow: bool = False) -> str:
            """A line for the first item of a canonical ID: its own mark where the edge asks for coverage."""
            group = self.by_canonical.get(canonical or "")
            if not group:
                return f"    {word} {ref}  {paint(31, '✘ missing')}"
            one = group[0]
            shown = " " + dim(f"(→ {one['id']})") if arrow and one["id"] != ref else ""
            return f"    {word} {ref}{shown}  {mark(one) if own_mark else paint(32, '✔')} {at(one)}"

        if verbose:
            file = None
            for r in self.items:
                if file not in (None, r["file"]):
                    out.append("")
                file = r["file"]
                out.append(f"{mark(r)} {bold(r['id'])}{title(r)}  {at(r)}  {paint(looks[r['status']][0], '[' + r['status'] + ']')}")
                if r["canonical_id"] in self.effective:
                    out.append(edge(paint(36, "→"), *self.effective[r["canonical_id"]]))
                elif r["origin"] == "spec":
                    first = lambda c: self.by_canonical[c][0]["item_seq"]
                    for ref, found in r["needs"]:
                        out += [edge(dim("needs"), ref, c, arrow=True) for c in sorted(found, key=first)] or [edge(dim("needs"), ref, None)]
                out += [edge(dim("covers"), ref, c, own_mark=False) for ref, c in r["covers"]]
                out += [f"    {dim('wanted by')} {x['id']}  {at(x)}" for x in r["wanted_by"]]
                out += defects(r)
            if self.items:
                out.append("")
        else:
            for r in self.items:
                if r["defective"]:
                    out += [f"{mark(r)} {bold(r['id'])}{title(r)}  {at(r)}", *defects(r), ""]
        out += [f"{paint(33, '⚠')} {p['message']}  {at(p['location'])}" for p in self.problems]
        if self.problems:
            out.append("")
        s = self.summary
        split = "  " + paint(2, f"({s['ok_items'] - s['shallow_covered_items']} deep-covered, {s['shallow_covered_items']} only shallow-covered)") if s["shallow_covered_items"] else ""
        out.append(paint(1, "Summary"))
        out.append(f"  items       {s['items']}  " + paint(2, f"({s['spec_items']} from specs, {s['code_items']} from code)"))
        out.append(f"  ok          {paint(32, s['ok_items'])}{split}")
        out.append(f"  defective   {paint(31, s['defective_items']) if s['defective_items'] else 0}")
        if s["problems"]:
            out.append(f"  problems    {paint(33, s['problems'])}")
        out += ["", paint(32, paint(1, "ok")) if self.clean else paint(31, paint(1, "not ok"))]
        return "\n".join(out) + "\n"


def use_colour() -> bool:
    return sys.stdout.isatty() and not os.environ.get("NO_COLOR")


__all__ = ["PHASES", "Report", "use_colour"]
