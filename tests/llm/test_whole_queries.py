"""Whole queries and pipeline stages against plain versions, and the defined odd cases."""

import base64
import gzip
import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from .test_operators import BASE, CASES, DOCS, docs

WORDS = "the house stands by river and people walk there each day while old trees give shade to quiet benches near water".split()
#: Names that operators might use themselves.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, row string, k int, cls string, maybe boolean, block int, w0 long, root long, `a.b` string"


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def prose(rng, n):
    return " ".join(f"{rng.choice(WORDS)}{rng.choice(WORDS)}" for _ in range(n))


# ---- quality


def plain_features(text):
    import math

    raw = (text or "").encode()
    words = [w for w in low(text).replace("\x0b", " ").replace("\x0c", " ").split(" ")]
    words = [x for w in words for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    n, nb = len(words), len(raw)
    count = lambda f: sum(map(f, raw))
    upper, lower, digits = count(lambda b: 65 <= b <= 90), count(lambda b: 97 <= b <= 122), count(lambda b: 48 <= b <= 57)
    stops, symbols = count(lambda b: b in b".,;:'\"()-?"), count(lambda b: b in b"!#$%&*+/<=>@[\\]^_`{|}~")
    lines, wide = raw.count(b"\n"), count(lambda b: b >= 128)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    share = lambda part, whole, usual, more=60.0: math.asin(math.sqrt(min(1.0, max(0.0, (part + usual * more) / (whole + more)))))
    return [
        math.log((nb + 120.0) / (n + 20.0)), share(upper, upper + lower, 0.03), share(digits, nb, 0.002), share(stops, nb, 0.03), share(symbols, nb, 0.0), share(lines, n, 0.02, 20.0),
        share(repeats, n, 0.0, 20.0), math.log(len(set(words)) + 20.0) / math.log(n + 20.0), share(wide, nb, 0.03),
    ]


def plain_quality(rows, labels):
    """{row number: score} by densities from inverses and determinants."""
    x = np.array([plain_features(t) for _, t in rows])
    taught = [(q, x[i]) for i, (d, _) in enumerate(rows) if not held_out(d) for e, q in labels if e == d and q in (0, 1)]
    g = []
    for c in (0, 1):
        own = np.array([v for q, v in taught if q == c])
        mean, cov = own.mean(axis=0), np.cov(own.T, bias=True)
        weight = max(0.1, min(1.0, cov.shape[0] / len(own)))
        cov = (1 - weight) * cov + weight * np.diag(np.diag(cov))
        cov = cov + (1e-4 + 1e-2 * weight * np.trace(cov) / len(cov)) * np.eye(len(cov))
        g.append(np.log(len(own) / len(taught)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean))
    return 1 / (1 + np.exp(np.clip(g[0] - g[1], -500, 500)))


def quality_rows():
    rng = np.random.default_rng(1)
    good = [(i, ". ".join(prose(rng, int(rng.integers(4, 12))).capitalize() for _ in range(int(rng.integers(1, 9)))) + ".") for i in range(80)]
    bad = [(i, " ".join(rng.choice(["BUY!!!", "$$$", "win win", "999", "CLICK", "é!!!é"], int(rng.integers(5, 60))))) for i in range(80, 160)]
    return good + bad


def test_quality_matches_plain_version(spark):
    from specweave.llm import quality

    rows = quality_rows() + [(500, None), (501, ""), (502, "A\n\nB\tc\x0bd"), (503, "long word " * 60000), (1, "repeated id"), (None, "no id")]
    labels = [(i, int(i < 80)) for i in range(160)] + [(3, 0), (4, None), (5, 7), (900, 1)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(5)
    got = quality.QualityClassifier(frame, spark.createDataFrame(labels, "doc_id long, quality int")).scores().collect()
    want = plain_quality(rows, labels)
    key = lambda r: (r[0] is None, r[0] or 0, round(r[2], 6))
    expect = sorted(((d, held_out(d), float(s)) for (d, _), s in zip(rows, want)), key=key)
    have = sorted(((r["doc_id"], r["held_out"], r["score"]) for r in got), key=key)
    assert [e[:2] for e in expect] == [h[:2] for h in have]
    assert np.allclose([e[2] for e in expect], [h[2] for h in have], atol=1e-6)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)


# ---- language


def test_grams_match_plain_count():
    from specweave.llm.langid import gram_counts

    def plain(text):
        s = "".join(c if "a" <= c <= "z" or ord(c) >= 0xAA else " " for c in text.lower())
        s = " " + "".join(c for i, c in enumerate(s) if c != " " or not i or s[i - 1] != " ") + " "
        return sorted(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))

    slot = {}
    for text in ("Hello, World 12 34", "éé ß Ünï", "a", "1 2  3", "中文 字", "x" * 5000):
        grams = plain(text)
        at, n = gram_counts(text)
        assert n.sum() == len(grams)
        for g in set(grams):
            if g not in slot:
                one = {}
                for k in range(1, 4):
                    if len(g) == k:
                        # a slot is known from the counts of the text alone: equal counts must exist for it
                        one[g] = grams.count(g)
                slot[g] = one
        # folding grams by slot can only add counts up, never lose one
        assert len(at) <= len(set(grams)) and n.max() >= max(map(grams.count, set(grams)))


def test_language_predictions_match_plain_products(spark):
    from specweave.llm import langid

    words = {"en": "the of and house river", "de": "der und das haus fluss ist", "fr": "le et la maison rivière est", "xx": "only"}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words[k].split(), 20)), k, "s", 0) for i in range(150) for k in [["en", "de", "fr"][i % 3]]]
    rows += [(1000, "single text of its language qq ww", "xx", "s", 0), (1003, "single text of its language qq ww", "xx", "s", 0), (7, None, "en", "s", 0), (8, "!!", "en", "s", 0), (9, "the house " * 50000, "en", "s", 0)]
    frame = spark.createDataFrame(rows, DOCS)
    model = langid.fit(frame)
    assert "xx" in model.languages  # few rows don't cost a language its place
    got = sorted((r["doc_id"], r["lang_pred"], round(r["score"], 5)) for r in langid.predict(frame.repartition(7), model).collect())
    want = []
    for d, text, *_ in rows:
        if not text or not any(map(str.isalpha, text)):
            want.append((d, "und", 0.0))
            continue
        z = [0.0] * len(model.languages)
        for s, w in zip(*langid.weights_of(text, model.idf)):
            for j in range(len(z)):
                z[j] += float(w) * float(model.weights[s, j])
        p = np.exp((np.array(z) - max(z)) / model.temperature)
        want.append((d, model.languages[int(p.argmax())], round(float(p.max() / p.sum()), 5)))
    assert [w[:2] for w in sorted(want)] == [g[:2] for g in got]
    assert np.allclose([w[2] for w in sorted(want)], [g[2] for g in got], atol=1e-4)
    again = langid.fit(frame.repartition(3))
    assert again.languages == model.languages and np.allclose(again.weights, model.weights, atol=1e-5) and abs(again.floor - model.floor) < 1e-4


def test_many_languages_are_all_learned(spark):
    from specweave.llm import langid

    rows = [(i, f"w{chr(97 + (i // 3) % 26)}{chr(97 + (i // 78) % 26)} " * 8, f"l{i // 3}", "s", 0) for i in range(900)]
    assert len(langid.fit(spark.createDataFrame(rows, DOCS)).languages) > 256


# ---- decontamination


def test_leaks_in_long_texts_blocks_and_copies(spark):
    from specweave.llm import decontaminate

    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 4000, n))
    items = [text(int(n)) for n in (3, 8, 20, 38, 60, 150)]
    n = decontaminate.STRETCH
    parts = [text(n - 20), items[3], text(2 * n - 100), items[5], text(40), items[1], text(10), items[0]]
    rows = [(1, " ".join(parts)), (2, text(500)), (3, None), (4, ""), (5, items[2].upper()), (5, items[2]), (6, items[4] + " end")]
    listed = [(i, t) for i, t in enumerate(items)] + [(102, items[2]), (102, items[2]), (7, None), (8, " ?? ")]
    bench = spark.createDataFrame(listed, "item_id long, text string")
    frame = docs(spark, rows)
    want = sorted([(1, 0), (1, 1), (1, 3), (1, 5), (6, 4)] + [(5, 2), (5, 102), (5, 102)] * 2)
    for block in (2, 4096):
        found = decontaminate.find_leaks(frame, bench, block=block).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in found) == want
        assert {r["kind"] for r in found} == {"copy"}
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(frame, bench).collect()) == [2, 3, 4]
    none = bench.where("false")
    assert decontaminate.find_leaks(frame, none).count() == 0 and decontaminate.keep_clean(frame, none).count() == len(rows)
    assert decontaminate.find_leaks(frame.where("false"), bench).count() == 0


# ---- archives


def test_foreign_archives(spark, tmp_path):
    from specweave.llm import warc

    def record(kind, fields, block, sep=b"\r\n\r\n"):
        head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:uuid:12345678-1234-5678-1234-56781234567" + kind[:1] + b">", *fields, b"Content-Length: " + str(len(block)).encode()]
        return b"\r\n".join(head) + b"\r\n\r\n" + block + sep

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    body = "grüße".encode()
    sha256 = b"WARC-Payload-Digest: sha256:" + hashlib.sha256(body).hexdigest().encode()
    md5 = b"WARC-Block-Digest: md5:" + base64.b32encode(hashlib.md5(http + body).digest())
    member = [
        record(b"warcinfo", [b"Content-Type: application/warc-fields"], b"software: x\r\n"),
        record(b"request", [b"Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\n\r\n"),
        record(b"response", [b"Content-Type: application/http;msgtype=response", sha256, md5, b"WARC-Target-URI: http://x/\xe9", b"X-Folded: a\r\n b"], http + body),
        record(b"metadata", [b"Content-Type: text/plain", b"WARC-Payload-Digest: blake3:zz"], b"note"),
        record(b"resource", [], b""),
    ]
    path = tmp_path / "foreign.warc.gz"
    path.write_bytes(b"".join(gzip.compress(m) for m in member[:3]) + gzip.compress(member[3] + member[4]))
    manifest = spark.createDataFrame([(str(path),)], "path string")
    got = warc.read_archives(spark, manifest, f"file://{tmp_path}").collect()
    assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "metadata", "resource"]
    assert got[2]["record_id"].startswith("<urn:uuid:") and got[2]["page_id"] is None and got[2]["url"] == "http://x/é"
    assert bytes(got[2]["payload"]) == body and got[2]["payload_bytes"] == len(body) and bytes(got[3]["payload"]) == b"note"
    bad = record(b"response", [b"Content-Type: application/http", b"WARC-Block-Digest: sha1:" + hashlib.sha1(b"other").hexdigest().encode()], http + body)
    with pytest.raises(ValueError):
        for pieces in warc.members(io.BytesIO(gzip.compress(bad))):
            list(warc.read_records(pieces))
    # a block that never ends its HTTP header is read in time that follows its length
    endless = record(b"response", [b"Content-Type: application/http"], b"x" * 8_000_000)
    for pieces in warc.members(io.BytesIO(gzip.compress(endless)), 4096):
        assert warc.read_record(pieces)["payload_bytes"] == 0


def test_archive_query_matches_plain_version(spark, tmp_path):
    from specweave.llm import warc

    rng = np.random.default_rng(4)
    rows = [(i, None if i % 11 == 0 else f"http://h/{i}", rng.choice([None, "", "same", "é" * 10, f"own {i}"])) for i in range(300)]
    rows += [(5, "u", "same"), (400, "u", "same"), (400, "u", "same"), (None, "u", "alone"), (None, "u", "alone"), (None, "u", "same"), (401, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(warc.with_revisits(pages), folder, file_bytes=2000)
    assert manifest.count() > 8  # files roll over
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    got = sorted((tuple(r[c] if c != "payload" else r[c] and bytes(r[c]) for c in fields) for r in warc.read_archives(spark, manifest, folder).collect()), key=str)
    keeper = {}
    for i, _, h in rows:
        if i is not None:
            keeper[h or ""] = max(i, keeper.get(h or "", i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = keeper.get(h or "")
        to = None if to == i else to
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to, data if to is None else None))
    strip = lambda rows: sorted((r[:5] + ((r[5] or b""),) for r in rows), key=str)
    assert strip(got) == strip(want)
    none = pages.where("false")
    folder = f"file://{tmp_path}/none"
    assert warc.read_archives(spark, warc.write_archives(warc.with_revisits(none), folder), folder).count() == 0


# ---- urls


def test_url_query_matches_plain_version(spark):
    import re

    from specweave.llm import urlfilter

    rng = np.random.default_rng(5)
    hosts = ["a.com", "EXAMPLE.com", "x.example.net", "net", "b.org", "c.io"]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(['/en/', '/de/', '/es/', '/'])}{rng.integers(0, 90)}{rng.choice(['', '?a=1', '#f', '/en/7'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "http://a.com", urls[0], urls[0]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("c.io/1",), ("c.io/de/5",), (None,), ("c.io/1",)], "canonical string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, listed).collect()}
    for i, url in enumerate(urls):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = low(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0] if rest[len(host) :].startswith("/") else ""
        fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        query = url.partition("?")[2].partition("#")[0] if url and "?" in url else ""
        name = host + path.rstrip("/") + (f"?{query}" if query else "")
        assert got[i] == (host, path, rule, verdict or ("block" if name in ("c.io/1", "c.io/de/5") else "allow")), url
    assert urlfilter.judge(pages.where("false"), listed).count() == 0 and urlfilter.judge(pages, listed.where("false")).where("listed").count() == 0


# ---- ids and packing


ODD_DOCS = [(1, None), (2, ""), (3, "x — y"), (4, "x —, y"), (5, "hello <|endoftext|> world"), (6, BASE), (6, BASE), (None, "null id"), (9, "word " * 30000), (10, "é" * 3000), (11, "a  b\n\n c")]


def plain_ids(name, text):
    from tokenizers import Tokenizer

    from specweave.llm.tokens import default_path

    return [*Tokenizer.from_file(default_path(name)).encode(text or "", add_special_tokens=False).ids, 1]


def test_id_files_match_the_library(spark, tmp_path):
    from specweave.llm import idfiles
    from specweave.llm.tokens import default_path

    folder, path = f"file://{tmp_path}/ids", default_path("word_bpe_49k.json")
    got = idfiles.read_ids(spark, idfiles.write_ids(docs(spark, ODD_DOCS), folder, path), folder).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 6, 6, 9, 10, 11]
    texts, start = dict(ODD_DOCS), 0
    for r in got:
        ids = plain_ids("word_bpe_49k.json", texts[r["doc_id"]])
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids)
        start += len(ids)
    empty = docs(spark, ODD_DOCS).where("false")
    assert idfiles.read_ids(spark, idfiles.write_ids(empty, folder, path), folder).count() == 0


def test_pieces_match_the_library(spark, tmp_path):
    from specweave.llm import packing
    from specweave.llm.tokens import default_path

    pieces = packing.pack(docs(spark, ODD_DOCS), default_path("byte_bpe_50k.json"))
    rows = pieces.collect()
    assert len({p["sequence_id"] for p in rows}) == len(rows) and all(p["offset"] == 0 and p["length"] & (p["length"] - 1) == 0 and p["length"] <= 2048 for p in rows)
    for doc_id, text in {d: t for d, t in ODD_DOCS}.items():
        ids = plain_ids("byte_bpe_50k.json", text)
        copies = sum(d == doc_id for d, _ in ODD_DOCS)
        own = sorted((p for p in rows if p["doc_id"] == doc_id), key=lambda p: p["start"])[::copies]
        at = 0
        for p in own:
            part = ids[at : at + p["length"]]
            assert (p["start"], p["ids"], p["doc_tokens"], p["ids_crc32"]) == (at, part, len(ids), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            at += p["length"]
        assert at == len(ids) and len(own) == len(packing.piece_lengths(len(ids)))
    path = f"{tmp_path}/buckets"
    packing.write_buckets(pieces, path)
    drawn = list(packing.batches(spark, path, 4))
    assert sorted(tuple(s) for b in drawn for s in b) == sorted(tuple(p["ids"]) for p in rows)
    assert all(len({len(s) for s in b}) == 1 and len(b) <= 4 for b in drawn)


# ---- near duplicates


def test_one_document_of_each_component_stays(spark):
    from specweave.llm.minhash import NearDuplicates, keep_one

    words = [f"v{i}" for i in range(100)]
    near = lambda i: " ".join(words[:70] + [f"z{i}"] + words[71:])
    rows = [(1, near(1)), (1, near(2)), (None, near(3)), (None, near(4)), (7, near(5)), (8, "other text that stands alone"), (1, "another one with a used id"), (9, None), (9, "")]
    rows += [(100 + i, near(100 + i)) for i in range(300)]  # one class with many partners
    out = keep_one(docs(spark, rows), 5, 80).collect()
    assert sorted((str(r["doc_id"]), len(r["text"] or "")) for r in out if len(r["text"] or "") < 100) == sorted([("1", 26), ("8", 28), ("9", 0), ("9", 0)])
    assert len([r for r in out if len(r["text"] or "") >= 100]) == 1
    members = NearDuplicates(docs(spark, rows), 5, 80).components().collect()
    assert len({r["component_id"] for r in members if r["doc_id"] and r["doc_id"] >= 100}) == 1


# ---- pipeline


def plain_near(rows, k=5, percent=80):
    """Rows that stay: (doc_id, text) of each component's least doc_id."""

    def shingles(t):
        w = low(t).split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=lambda x: rows[x][0])
                root[b] = a
    return [r for i, r in enumerate(rows) if find(i) == i]


def test_pipeline_matches_plain_stages(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    rows = quality_rows()
    rows = [(i, t) for i, t in rows]
    for i in range(200, 230):  # near copies
        text = rows[int(rng.integers(0, 80))][1].split()
        text[int(rng.integers(0, len(text)))] = "changed"
        rows.append((i, " ".join(text)))
    item = prose(rng, 30)
    rows += [(300, prose(rng, 20).capitalize() + ". " + item + ". " + prose(rng, 20) + "."), (301, prose(rng, 60).capitalize() + "."), (302, ""), (303, None)]
    names = [c.split()[0].strip("`") for c in CLASHING.split(", ")]
    data = [(i, t, "en", "s", 0, 1, "key", "row", 2, "cls", True, 3, 4, 5, "dot") for i, t in rows]
    frame = spark.createDataFrame(data, CLASHING)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 80)) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    pick = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    key = lambda r: (r[0], r[1] or "")

    good = stages["quality"](spark, frame, sf)
    assert good.columns == names
    want = sorted((r for r, s in zip(rows, plain_quality(rows, labels)) if s >= 0.5), key=key)
    assert sorted(((r["doc_id"], r["text"]) for r in good.collect()), key=key) == want
    known = stages["language"](spark, good, sf)
    want = [r for r in want if r[1] and any(map(str.isalpha, r[1]))]
    assert known.columns == names and pick(known) == want  # one language: every text with a letter is in it
    single = stages["near_dedup"](spark, known, sf)
    before, want = len(want), sorted(plain_near(want))
    assert single.columns == names and pick(single) == want and len(want) < before
    clean = stages["decontaminate"](spark, single, sf)
    want = [r for r in want if item.lower() not in r[1].lower()]
    assert clean.columns == names and pick(clean) == want and 300 not in dict(want)
    packed = corpus_pipeline.run(spark, sf)
    got = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in packed.collect())
    plain = []
    for d, t in want:
        ids, at = plain_ids("byte_bpe_50k.json", t), 0
        while at < len(ids):
            length = min(2048, 1 << (len(ids) - at).bit_length() - 1)
            part = ids[at : at + length]
            plain.append((d, at, length, zlib.crc32(struct.pack(f"<{length}I", *part)), len(ids)))
            at += length
    assert got == sorted(plain)


def test_stages_take_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs(spark, CASES).where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
