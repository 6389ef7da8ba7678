"""Source trees, source files and Markdown files made from the star-schema tables, and the queries that scan them.

The SQL twins say what the scanners must find from the tables' rows alone.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.refs import split_lines
from ..operators.code_scan import comment_text, url_spans
from ..operators.extract import files_frame, parsed, with_text
from ..sessions import fresh_path
from ..sources.grammars import EXTENSIONS, LEAVES
from ..sources.tree import collect_files, extension


def _grammars() -> list[tuple[int, str, str, str, str, int, int]]:
    """(number, extension, line sign, block opener, closer, whether blocks are there, whether a block within a block is found) of each leaf grammar's forms."""
    out = []
    for name, all_ in EXTENSIONS.items():
        if name == "html":
            continue
        leaf = LEAVES[name]
        for ext in all_.split():
            for v in range(max(len(leaf.lines), len(leaf.blocks))):
                line = leaf.lines[v % len(leaf.lines)] if leaf.lines else ""
                open_, close, nests = leaf.blocks[v % len(leaf.blocks)] if leaf.blocks else ("", "", False)
                out.append((len(out), ext, line, open_, close, int(bool(open_)), int(nests or (bool(open_) and open_ == close))))
    return out


GRAMMARS = _grammars()
_VALUES = ", ".join("({}, '{}', '{}', '{}', '{}', {}, {})".format(*g) for g in GRAMMARS)
#: One source file for each order; k is its key, s and e open and close a comment of one line.
CODE_BASE = f"""
SELECT CAST(o_orderkey AS VARCHAR(20)) AS k, o_orderkey, 'src/o' || o_orderkey || '.' || ext AS file, o, c, blocks, nested,
       CASE WHEN l <> '' THEN l || ' ' ELSE o || ' ' END AS s, CASE WHEN l <> '' THEN '' ELSE ' ' || c END AS e
FROM orders JOIN (SELECT * FROM (VALUES {_VALUES}) AS t(i, ext, l, o, c, blocks, nested)) g ON o_orderkey % {len(GRAMMARS)} = i
"""
_URL = "u = http://h/#;%--/*(*{-"
_CODE_LINES = (
    "s || '[>>utest:early/x' || k || '#1]' || e",
    "'v = \"[impl:no/a' || k || '#1]\"'",
    "s || '[impl:f/a' || k || '#1] [>>utest] [>>dsn:z/y#2.x]' || e",
    f"'{_URL}' || k || ' ' || s || '[impl:f/b' || k || '#1.02]' || e",
    "CASE blocks WHEN 1 THEN o || ' [impl:f/c' || k || '#1] ' || c || ' [impl:no/d' || k || '#1]' ELSE 'x' END",
    "CASE blocks WHEN 1 THEN o || ' open' ELSE 'x' END",
    "CASE blocks WHEN 1 THEN '[impl:f/g' || k || '#1]' ELSE 'x' END",
    "CASE blocks WHEN 1 THEN 'tail ' || c || ' [impl:no/h' || k || '#1]' ELSE 'x' END",
    "CASE blocks WHEN 1 THEN o || ' ' || o || ' x ' || c || ' [impl:f/e' || k || '#1] ' || c || ' y' ELSE 'x' END",
    "s || '[req:a' || k || '#1 --> req:b' || k || '#2]' || e",
    "s || '[impl:f/a' || k || '#1.0.0 >> doc#3]' || e",
    "s || '[impl:gone/x' || k || '#1 >> doc]' || e",
    "s || '[>>late]' || e",
)


def _from(sql: str, *tables: str) -> str:
    """``sql`` with its table names as parameters of spark.sql."""
    for t in tables:
        sql = sql.replace(f"FROM {t} ", f"FROM {{{t}}} ")
    return sql


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_seq, path, file, text): a source file for each order, over all leaf grammars."""
    # braces in texts are doubled for the parameters of spark.sql
    text = " || chr(10) || ".join(_CODE_LINES)
    sql = f"SELECT o_orderkey AS file_seq, file AS path, file, {text} AS text FROM ({CODE_BASE})".replace("{", "{{").replace("}", "}}")
    return spark.sql(_from(sql, "orders"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def _rows(files: DataFrame, kind: str) -> DataFrame:
    return parsed(files).where(F.col("kind") == kind)


def _with_items(files: DataFrame, *kinds: str) -> DataFrame:
    """Rows of ``kinds`` with owner, the id of the item that they belong to, from one parse."""
    rows = parsed(files).where(F.col("kind").isin("item", *kinds))
    # a file's rows come from one task, items before what belongs to them
    both = rows.groupBy("file_seq", "file", "item").agg(F.first(F.when(F.col("kind") == "item", F.col("id")), ignorenulls=True).alias("owner"), F.collect_list(F.when(F.col("kind") != "item", F.struct("kind", "ord", "ref", "line", "character", "message"))).alias("own"))
    return both.select("file", "owner", F.inline("own"))


def code_items(spark, sf_dir):
    return _rows(code_files(spark, sf_dir), "item").select("file", "id", "origin", "line", "character")


def code_needs(spark, sf_dir):
    return _with_items(code_files(spark, sf_dir), "need").select("file", "owner", "ord", "ref", "line", "character")


def code_forwards(spark, sf_dir):
    return _rows(code_files(spark, sf_dir), "forward").select("file", F.col("id").alias("from"), F.col("ref").alias("to"), "line", "character")


def code_problems(spark, sf_dir):
    return _rows(code_files(spark, sf_dir), "problem").select("file", "message", "line", "character")


_CODE = f"WITH f AS ({CODE_BASE}) "
_S = "CAST(length(s) + 1 AS INT)"
CODE_SQL = {
    "code_items": _CODE + f"""SELECT file, 'impl:f/a' || k || '#1' AS id, 'code' AS origin, 3::INT AS line, {_S} AS character FROM f
        UNION ALL SELECT file, 'impl:f/b' || k || '#1.02', 'code', 4::INT, CAST({len(_URL)} + length(k) + length(s) + 2 AS INT) FROM f
        UNION ALL SELECT file, 'impl:f/c' || k || '#1', 'code', 5::INT, CAST(length(o) + 2 AS INT) FROM f WHERE blocks = 1
        UNION ALL SELECT file, 'impl:f/g' || k || '#1', 'code', 7::INT, 1::INT FROM f WHERE blocks = 1
        UNION ALL SELECT file, 'impl:f/e' || k || '#1', 'code', 9::INT, CAST(2 * length(o) + length(c) + 6 AS INT) FROM f WHERE nested = 1""",
    "code_needs": _CODE + f"""SELECT file, 'impl:f/a' || k || '#1' AS owner, 0::BIGINT AS ord, 'utest:f/a' || k || '#1' AS ref, 3::INT AS line, CAST(length(s) + length(k) + 14 AS INT) AS character FROM f
        UNION ALL SELECT file, 'impl:f/a' || k || '#1', 1::BIGINT, 'dsn:z/y#2.x', 3::INT, CAST(length(s) + length(k) + 24 AS INT) FROM f
        UNION ALL SELECT file, 'impl:f/a' || k || '#1', 2::BIGINT, 'doc:f/a' || k || '#3', 11::INT, {_S} FROM f
        UNION ALL SELECT file, 'impl:f/' || w || k || '#' || r, 0::BIGINT, 'late:f/' || w || k || '#' || r, 13::INT, {_S}
          FROM (SELECT *, CASE WHEN nested = 1 THEN 'e' WHEN blocks = 1 THEN 'g' ELSE 'b' END AS w, CASE WHEN blocks = 1 THEN '1' ELSE '1.02' END AS r FROM f)""",
    # an arrow ends the comments of XML
    "code_forwards": _CODE + f"""SELECT file, 'req:a' || k || '#1' AS "from", 'req:b' || k || '#2' AS "to", 10::INT AS line, {_S} AS character FROM f WHERE c <> '-->'""",
    "code_problems": _CODE + f"""SELECT file, 'need tag [>>utest:early/x' || k || '#1] has no preceding item tag in this file' AS message, 1::INT AS line, {_S} AS character FROM f
        UNION ALL SELECT file, 'need tag [impl:gone/x' || k || '#1 >> doc] has no preceding item tag [impl:gone/x' || k || '#1] in this file', 12::INT, {_S} FROM f""",
}

# ---- embedded languages of composite files, comment masks and url spans

#: (number, opening tag, comment with {} for the tag, closing tag, whether the tag in it is found)
REGIONS = (
    ("<script>", "// {}", "</script>", 1), ('<script type="application/json">', "// {}", "</script>", 0), ("<script type=importmap>", "/* {} */", "</script >", 0),
    ('<script type="text/template">', "<!-- {} -->", "</script>", 1), ('<script type="text/x-html">', "// {}", "</script>", 0), ('<SCRIPT lang="coffeescript">', "# {}", "</SCRIPT>", 1),
    ("<style>", "/* {} */", "</style>", 1), ("<style>", "// {}", "</style>", 0), ('<style lang="scss">', "// {}", "</style>", 1), ('<style lang="styl">', "/* {} */", "</style>", 1),
    ("<p>", "<!-- {} -->", "</p>", 1), ("<p>", "// {}", "</p>", 0), ("<scripted>", "// {}", "</scripted>", 0), ('<script data-type="module/json">', "// {}", "</script>", 1),
)


def html_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A composite file for each customer: a region with a tag, then a tag in a comment of the document."""
    k = F.col("c_custkey").cast("string")
    form = F.lit(None).cast("string")
    for i, (enter, body, leave, _) in enumerate(REGIONS):
        head, tail = body.split("{}")
        one = F.concat(F.lit(f"text {enter} x\n{head}[impl:r/a"), k, F.lit(f"#1]{tail}\n{leave} [impl:no/z#1] <!-- [impl:r/b"), k, F.lit("#2] -->\n"))
        form = F.when(F.col("c_custkey") % len(REGIONS) == i, one).otherwise(form)
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS["html"].split())), (F.col("c_custkey") % 4 + 1).cast("int"))
    file = F.concat(F.lit("web/c"), k, F.lit("."), ext)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("file_seq"), file.alias("path"), file.alias("file"), form.alias("text"))


def code_regions(spark, sf_dir):
    return _rows(html_files(spark, sf_dir), "item").select("file", "id", "line", "character")


def _masks(files: DataFrame) -> DataFrame:
    return with_text(files, lambda path, text: [(comment_text(text, extension(path)),)], "masked string")


def comment_mask(spark, sf_dir):
    """Masks of one-line files in all leaf grammars, one for each customer."""
    rows = spark.sql(_from(f"SELECT c_custkey AS file_seq, file AS path, file, text FROM ({MASK_BASE})".replace("{", "{{").replace("}", "}}"), "customer"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return _masks(rows).select("file", "masked")


MASK_BASE = f"""
SELECT c_custkey, 'c' || c_custkey || '.' || ext AS file, l, o, c, c_name, CASE WHEN l <> '' THEN 'x = 1 ' || l || ' ' || c_name ELSE 'x = 1 ' || o || ' ' || c_name || ' ' || c || ' y' END AS text
FROM customer JOIN (SELECT * FROM (VALUES {_VALUES}) AS t(i, ext, l, o, c, blocks, nested)) g ON c_custkey % {len(GRAMMARS)} = i
"""


def page_comments(spark, sf_dir):
    """Whole pages: the lengths of text and mask agree, and outside regions the mask holds the page's own comments."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = pages.select(F.col("page_id").alias("file_seq"), F.lit("p.html").alias("path"), F.col("page_id").cast("string").alias("file"), F.coalesce("html", F.lit("")).alias("text"))
    lost = F.regexp_count("masked", F.lit(r"\bad [0-9]+\b")).cast("long")
    return _masks(files).select(F.col("file_seq").alias("page_id"), F.length("masked").cast("long").alias("n_chars"), lost.alias("n_ads"), F.contains("masked", F.lit("<article>")).alias("has_markup"))


def page_url_spans(spark, sf_dir):
    """Where urls stand in a line around each page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    line = F.concat(F.lit("(see "), F.coalesce("url", F.lit("")), F.lit(" or a+b.c-1://x/'y) "))
    files = pages.select(F.col("page_id").alias("file_seq"), F.lit("x").alias("path"), F.lit("x").alias("file"), line.alias("text"))
    found = with_text(files, lambda path, text: [(a + 1, b) for a, b in url_spans(text)], "first_char int, last_char int")
    return found.select(F.col("file_seq").alias("page_id"), "first_char", "last_char")


def _region_sql() -> str:
    rows = ", ".join(f"({i}, {len(body.split('{}')[0]) + 1}, {len(leave) + 21}, {found})" for i, (_, body, leave, found) in enumerate(REGIONS))
    ext = "list_extract(['" + "', '".join(EXTENSIONS["html"].split()) + "'], CAST(c_custkey % 4 + 1 AS INT))"
    return f"""WITH f AS (SELECT c_custkey AS k, 'web/c' || c_custkey || '.' || {ext} AS file, a, b, found FROM customer JOIN (VALUES {rows}) AS t(i, a, b, found) ON c_custkey % {len(REGIONS)} = i)
        SELECT file, 'impl:r/a' || k || '#1' AS id, 2::INT AS line, CAST(a AS INT) AS character FROM f WHERE found = 1
        UNION ALL SELECT file, 'impl:r/b' || k || '#2', 3::INT, CAST(b AS INT) FROM f"""


SCAN_SQL = {
    "code_regions": _region_sql(),
    "comment_mask": f"SELECT file, CASE WHEN l <> '' THEN repeat(' ', CAST(6 + length(l) AS BIGINT)) || ' ' || c_name ELSE repeat(' ', CAST(6 + length(o) AS BIGINT)) || ' ' || c_name || ' ' || repeat(' ', CAST(length(c) + 2 AS BIGINT)) END AS masked FROM ({MASK_BASE})",
    "page_comments": r"SELECT page_id, CAST(length(html) AS BIGINT) AS n_chars, CAST(len(regexp_extract_all(html, '<!-- ad [0-9]+ -->')) AS BIGINT) AS n_ads, false AS has_markup FROM pages",
    "page_url_spans": "SELECT page_id, 6::INT AS first_char, CAST(5 + length(url) AS INT) AS last_char FROM pages WHERE url LIKE '%://%' UNION ALL SELECT page_id, CAST(length(coalesce(url, '')) + 10 AS INT), CAST(length(coalesce(url, '')) + 21 AS INT) FROM pages",
}

# ---- Markdown

_MARKDOWN_LINES = (
    "# Title {k}", "", "`req:m/a{k}#1`", "", "First line {k}.", "Second line.", "", "Needs: impl, utest#2.x, ?bad", "Covers:", "- feat:top/f{n}#1", "* `feat`", "Tags: {seg}, x", "",
    "Setext title  ", "goes on", "---", "", "  `req:m/b{k}#1.2`  ", "", "| Needs | Covers | Note |", "|---|:-:|---|", "| impl | feat:top/f{n}#2 | text |", "| dsn:q/r#x |  | `req:no/t{k}#1` |", "",
    "[req:m/a{k}#1 --> req:m/b{k}#1.2]", "`[req:m/c{k}#1 --> req:m/a{k}#1]`", "", "`req:no/s{k}#1`", "===", "", "## Tail {k} ##", "`dsn:m/d{k}#3`", "Some words", "Tags:", "- `web`", "",
)


def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A specification for each customer."""
    text = F.lit("\n".join(_MARKDOWN_LINES))
    for name, column in (("{k}", "c_custkey"), ("{n}", "c_nationkey"), ("{seg}", "c_mktsegment")):
        text = F.replace(text, F.lit(name), F.col(column).cast("string"))
    file = F.concat(F.lit("docs/c"), "c_custkey", F.lit(".md"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("file_seq"), file.alias("path"), file.alias("file"), text.alias("text"))


def md_items(spark, sf_dir):
    return _rows(markdown_files(spark, sf_dir), "item").select("file", "id", "origin", "title", F.array_join("description", "|").alias("description"), F.array_join("tags", "|").alias("tags"), "line", "character")


def md_references(spark, sf_dir):
    return _with_items(markdown_files(spark, sf_dir), "need", "cover").select("file", "owner", "kind", "ord", "ref", "line", "character")


def md_defects(spark, sf_dir):
    return _with_items(markdown_files(spark, sf_dir), "defect").select("file", "owner", "ord", "ref", "message", "line", "character")


def md_problems(spark, sf_dir):
    return _rows(markdown_files(spark, sf_dir), "problem").select("file", "message", "line", "character")


def md_forwards(spark, sf_dir):
    return _rows(markdown_files(spark, sf_dir), "forward").select("file", F.col("id").alias("from"), F.col("ref").alias("to"), "line", "character")


_MD = "WITH f AS (SELECT CAST(c_custkey AS VARCHAR) AS k, c_nationkey AS n, c_mktsegment AS seg, 'docs/c' || c_custkey || '.md' AS file FROM customer) "
MARKDOWN_SQL = {
    "md_items": _MD + """SELECT file, 'req:m/a' || k || '#1' AS id, 'spec' AS origin, 'Title ' || k AS title, 'First line ' || k || '.|Second line.' AS description, seg || '|x' AS tags, 3::INT AS line, 1::INT AS character FROM f
        UNION ALL SELECT file, 'req:m/b' || k || '#1.2', 'spec', 'Setext title' || chr(10) || 'goes on', '', '', 18::INT, 3::INT FROM f
        UNION ALL SELECT file, 'dsn:m/d' || k || '#3', 'spec', 'Tail ' || k || ' ##', 'Some words', '`web`', 32::INT, 1::INT FROM f""",
    "md_references": _MD + """SELECT file, 'req:m/a' || k || '#1' AS owner, 'need' AS kind, 0::BIGINT AS ord, 'impl:m/a' || k || '#1' AS ref, 8::INT AS line, 8::INT AS character FROM f
        UNION ALL SELECT file, 'req:m/a' || k || '#1', 'need', 1, 'utest:m/a' || k || '#2.x', 8, 14 FROM f
        UNION ALL SELECT file, 'req:m/a' || k || '#1', 'cover', 0, 'feat:top/f' || n || '#1', 10, 3 FROM f
        UNION ALL SELECT file, 'req:m/a' || k || '#1', 'cover', 1, 'feat:m/a' || k || '#1', 11, 3 FROM f
        UNION ALL SELECT file, 'req:m/b' || k || '#1.2', 'need', 0, 'impl:m/b' || k || '#1.2', 22, 3 FROM f
        UNION ALL SELECT file, 'req:m/b' || k || '#1.2', 'cover', 0, 'feat:top/f' || n || '#2', 22, 10 FROM f
        UNION ALL SELECT file, 'req:m/b' || k || '#1.2', 'need', 1, 'dsn:q/r#x', 23, 3 FROM f""",
    "md_defects": _MD + """SELECT file, 'req:m/a' || k || '#1' AS owner, 0::BIGINT AS ord, '?bad' AS ref, 'invalid: "?bad" in the Needs list of req:m/a' || k || '#1 is not a valid ID and is ignored' AS message, 8::INT AS line, 25::INT AS character FROM f""",
    "md_problems": _MD + """SELECT file, 'item req:no/t' || k || '#1 defined inside a table; a table cell is not an item definition' AS message, 23::INT AS line, 18::INT AS character FROM f
        UNION ALL SELECT file, 'item req:no/s' || k || '#1 defined inside a setext heading; a heading is not an item definition', 28, 1 FROM f""",
    "md_forwards": _MD + """SELECT file, 'req:m/a' || k || '#1' AS "from", 'req:m/b' || k || '#1.2' AS "to", 25::INT AS line, 1::INT AS character FROM f
        UNION ALL SELECT file, 'req:m/c' || k || '#1', 'req:m/a' || k || '#1', 26, 1 FROM f""",
}

# ---- trees


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """A folder for each nation in the shared folder, with files that a scan takes and files that it leaves out."""
    root = Path(fresh_path(spark, "tree").removeprefix("file:"))
    for (n,) in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").collect():  # 25 rows at every size
        files = {
            "spec.md": b"# T\r\n\r\n`req:n#1`\rlone\n", "code.py": b"\xef\xbb\xbf# [impl:n#1] \xff\n", ".hidden.ts": b"\xef\xbb\xbf\xef\xbb\xbfx", "skip.txt": b"", "noext": b"", "node_modules/x.js": b"", ".git/y.js": b"",
            ".gitignore": b"# rules\n*.rs\n!keep.rs\n/top.go\nbuild/\n", "a.rs": b"", "keep.rs": b"\n\n", "top.go": b"", "sub/top.go": b"y", "build/z.py": b"", "sub/build/z.py": b"", "UP.JSON.TS": b"\r\n",
        }
        if n % 2 == 0:
            files[".ignore"] = b"!a.rs\nkeep.rs\n"
        for name, data in files.items():
            path = root / f"n{n}" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(data)
    return str(root)


def source_files(spark, sf_dir):
    """All files of a tree with their place in the global order, extension, decoded text and number of lines."""
    root = _tree(spark, sf_dir)
    # a folder, a file in it named as such, a file that is ignored where it is met but was named, and one of no known kind
    files = files_frame(spark, [".", f"{root}/n0", "n0/spec.md", f"{root}/x/../n1/a.rs", "n0/skip.txt"], root)
    read = with_text(files, lambda path, text: [(extension(path), text, len(split_lines(text)))], "ext string, body string, n_lines int")
    return read.select("file_seq", "file", "ext", F.regexp_replace("body", "\r", "<CR>").alias("body"), "n_lines")


def source_paths(spark, sf_dir):
    """The same listing, made absolute and then relative to another folder."""
    root = _tree(spark, sf_dir)
    found = [os.path.relpath(p, f"{root}/n0/deep").replace(os.sep, "/") for p in collect_files(["n0/./../n0"], root)]
    return spark.createDataFrame([(i, p) for i, p in enumerate(found)], "file_seq long, relative string")


_FILES = r"""('.hidden.ts', 'ts', chr(65279) || 'x', 1), ('UP.JSON.TS', 'ts', '<CR>' || chr(10), 1), ('code.py', 'py', '# [impl:n#1] ' || chr(65533) || chr(10), 1),
    ('spec.md', 'md', '# T<CR>' || chr(10) || '<CR>' || chr(10) || '`req:n#1`<CR>lone' || chr(10), 3), ('sub/top.go', 'go', 'y', 1), ('keep.rs', 'rs', chr(10) || chr(10), 2), ('a.rs', 'rs', '', 0)"""
SOURCE_SQL = {
    "source_files": f"""SELECT row_number() OVER (ORDER BY file) - 1 AS file_seq, * FROM (SELECT 'n' || n_nationkey || '/' || name AS file, ext, body, CAST(n_lines AS INT) AS n_lines
        FROM nation, (VALUES {_FILES}) AS t(name, ext, body, n_lines) WHERE CASE name WHEN 'keep.rs' THEN n_nationkey % 2 = 1 WHEN 'a.rs' THEN n_nationkey % 2 = 0 OR n_nationkey = 1 ELSE true END)""",
    "source_paths": f"SELECT row_number() OVER (ORDER BY name) - 1 AS file_seq, '../' || name AS relative FROM (VALUES {_FILES}) AS t(name, ext, body, n_lines) WHERE name <> 'keep.rs'",
}

QUERIES = {
    "code_items": code_items, "code_needs": code_needs, "code_forwards": code_forwards, "code_problems": code_problems, "code_regions": code_regions, "comment_mask": comment_mask,
    "page_comments": page_comments, "page_url_spans": page_url_spans, "md_items": md_items, "md_references": md_references, "md_defects": md_defects, "md_problems": md_problems,
    "md_forwards": md_forwards, "source_files": source_files, "source_paths": source_paths,
}
SQL = CODE_SQL | SCAN_SQL | MARKDOWN_SQL | SOURCE_SQL
