"""Each training-data operator against a brute-force version or a round trip."""

import zlib

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)


CASES = [(1, None), (2, ""), (3, "  \n "), (4, "a"), (5, "A"), (6, BASE), (7, BASE), (8, BASE + " extra"), (9, "word " * 30000), (None, "null id"), (6, BASE)]


def test_warc_round_trip(spark, tmp_path):
    from specweave.llm import warc

    rows = [(1, "http://a\r\nb", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "ü", "é" * 100000), (None, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_archives(warc.with_revisits(pages), folder)
    got = {r["page_id"]: r for r in warc.read_archives(spark, manifest, folder).collect()}
    assert (got[1]["record_type"], got[1]["refers_to"], got[2]["record_type"], got[3]["refers_to"]) == ("revisit", 2, "response", 4)
    assert got[5]["payload_bytes"] == 200000 and bytes(got[5]["payload"]).decode() == "é" * 100000
    assert got[1]["payload_digest"] == warc.sha1_base32(b"x") and got[None]["refers_to"] == 2


def test_warc_refuses_damage():
    import io

    from specweave.llm import warc

    good = warc.record_bytes(1, "u", b"payload", None)
    raw = zlib.decompress(good, 31).replace(b"payload", b"pay1oad")
    bad = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        for pieces in warc.members(io.BytesIO(bad.compress(raw) + bad.flush())):
            warc.read_record(pieces)


def test_leaks_and_paraphrases(spark):
    from specweave.llm import decontaminate

    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [prose(30) + ". " + prose(8) + "." for _ in range(6)]
    near = items[1].split()
    for i in (3, 11, 19, 25):
        near[i] = "other"
    rows = [(i, prose(300)) for i in range(10, 60)] + [(1, prose(50) + " " + items[0] + " " + prose(70)), (2, prose(40) + " " + " ".join(near)), (3, None), (4, "")]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (10, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs(spark, rows), bench).collect()}
    assert got == {(1, 0), (2, 1)}


def test_common_subsequence_is_exact():
    from specweave.llm.decontaminate import Item, text_words

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (" ".join(rng.choice(list("abcde"), n)) for n in rng.integers(5, 30, 2))
        x, y = a.split(), b.split()
        t = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                t[i + 1, j + 1] = t[i, j] + 1 if p == q else max(t[i, j + 1], t[i + 1, j])
        assert Item(0, a).common(text_words(b).tolist()) == t[-1, -1]


def test_url_verdicts(spark):
    from specweave.llm import urlfilter

    urls = ["http://A.Example.com/en/71", "https://x.com/en/1", "http://net/de/8", "http://www.q.org/de/1?utm_source=a#x", None, "nothing", "http://example.net?x=/de/8"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("q.org/de/1",)], "canonical string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, listed).collect()}
    assert got[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and got[1][2:] == ("com/en/", "block")
    assert got[2][2:] == ("net/de/", "allow") and got[3][2:] == (None, "block") and got[4][:2] == ("", "") and got[5][3] == "allow" and got[6][1] == ""


def test_quality_and_language(spark):
    from specweave.llm import langid, quality

    good = [(i, "The house stands by the river, and people walk there each day. " * (1 + i % 7)) for i in range(0, 60)]
    bad = [(i, "SPAM!! BUY!! " * (3 + i % 9)) for i in range(60, 120)]
    table = docs(spark, good + bad + CASES)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    got = quality.QualityClassifier(table, labels).scores().collect()
    assert len(got) == 131 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["doc_id"] < 60) for r in got if r["doc_id"] is not None and r["doc_id"] > 9)
    words = {"en": "the of and house river", "de": "der und das haus fluss ist", "fr": "le et la maison rivière est"}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words[k].split(), 20)), k, "s", 0) for i in range(150) for k in [list(words)[i % 3]]]
    table = spark.createDataFrame(rows + [(900, None, "en", "s", 0), (901, "12 !?", "de", "s", 0)], DOCS)
    got = {r["doc_id"]: r for r in langid.predict(table, langid.fit(table)).collect()}
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    held = [i for i in range(150) if got[i]["held_out"]]
    assert held and np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.95
    empty = table.where("false")
    assert langid.predict(table, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_near_duplicates_match_brute_force(spark):
    from specweave.llm.minhash import NearDuplicates

    rng = np.random.default_rng(5)
    texts = []
    for g in range(12):
        base = list(rng.choice([f"v{i}" for i in range(500)], 120))
        for _ in range(12):
            own = list(base)
            for i in rng.integers(0, 120, rng.integers(0, 7)):
                own[i] = f"n{rng.integers(1 << 30)}"
            texts.append(" ".join(own))
    rows = list(enumerate(texts, 100)) + CASES[:8]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in NearDuplicates(docs(spark, rows), 3, 85).components().collect()}

    def shingles(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_keep_one(spark):
    from specweave.llm.minhash import keep_one

    out = keep_one(docs(spark, CASES), 5, 80)
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(map(str, [1, 2, 3, 4, 6, 9, None]))


def test_licenses(spark):
    from specweave.llm import licenses

    rows = CASES + [(20, "Released under the MIT License. x\nThis work is licensed under the GNU General Public License, version 3."), (21, "cc by-nc CC BY NC")]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert (got[20]["labels"], got[20]["base_labels"], got[20]["first_word"], got[20]["n_base"]) == ("gpl-3,mit", "mit", 1, 1)
    assert (got[21]["n_base"], got[21]["first_word"], got[21]["last_word"], got[21]["score"]) == (2, 0, 3, 1.0)
    assert (got[1]["n_words"], got[1]["labels"], got[1]["score"], got[9]["n_words"]) == (0, "", 0.0, 30000)


def test_top_k(spark):
    from specweave.llm import topk

    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8))
    x[50:150] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 8)]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_block=4).collect()}
    v = np.floor(64 * x).astype(int)
    want = {}
    for q in range(0, 300, 20):
        best = sorted((-(v[q] @ v[c]), c) for c in range(300) if c != q)[:20]
        want |= {(q, n): (c, -s) for n, (s, c) in enumerate(best, 1)}
    assert got == {k: (int(a), int(b)) for k, (a, b) in want.items()}


def test_simple8b():
    from specweave.llm import simple8b

    rng = np.random.default_rng(0)
    for top in (1, 200, 60000, (1 << 64) - 1):
        v = rng.integers(0, top, 3000, dtype=np.uint64, endpoint=True)
        words, at = simple8b.encode(v)
        assert (simple8b.decode(words) == v).all() and (simple8b.decode(words[at[3] : at[4]]) == v[3 * simple8b.BLOCK : 4 * simple8b.BLOCK]).all()


PIECES = [
    "a", "B", "é", "Σ", "x", "word", "don't", "'s", "'", "1", "²", "%%%", "...", "…", "—", "–", "”", "’", "«", "»", "•", ",", ".", "!", ")", " ", " ", " ", "  ", "\n", "\t", "\x85", "中文",
    "\u0301", "\u200b", "ß", "ª", "İ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", " — ", " ,",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    import random

    from tokenizers import Tokenizer

    from specweave.llm.tokens import Encoder, default_path

    r = random.Random(1)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randrange(30))) for _ in range(4000)]
    texts += ["x — y", "x —, y", "” ”. …) ’, «. », •) –-", "hello <|endoftext|> world", None, ""]
    library = Tokenizer.from_file(default_path(name))
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for order in (range(len(texts)), range(len(texts) - 1, -1, -1), r.sample(range(len(texts)), len(texts))):
        e, order = Encoder(default_path(name)), list(order)
        e.kept = 500
        for lo in range(0, len(order), 50):
            part = order[lo : lo + 50]
            assert e.batch([texts[i] for i in part]) == [want[i] for i in part]


def test_known_words_are_not_encoded_again():
    from tokenizers import Tokenizer

    from specweave.llm.tokens import Encoder, default_path

    path = default_path("word_bpe_49k.json")
    coder, model, asked = Encoder(path), Tokenizer.from_file(path).model, []

    class Counted:
        def tokenize(self, text):
            asked.append(text)
            return model.tokenize(text)

    coder.model = Counted()
    texts = ["a zorblatt stands", "a zorblatt, zorblatt. zorblatt; stands"]
    want = [np.array(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [coder.batch([t])[0] for t in texts] == want
    assert sum("zorblatt" in t for t in asked) == 1


def test_other_operators_free_the_encoder():
    from pyspark import cloudpickle

    from specweave.llm.bytewords import tidy
    from specweave.llm.tokens import Encoder, default_path

    def run(batches):
        return batches

    keeping, freeing = (cloudpickle.loads(cloudpickle.dumps(tidy(run, keep=k))) for k in (True, False))
    Encoder.of(default_path("byte_bpe_50k.json"))
    list(keeping(iter([])))
    assert Encoder._open
    list(freeing(iter([])))
    assert not Encoder._open


def test_empty_tables(spark):
    from specweave.llm import licenses, packing, quality, topk
    from specweave.llm.minhash import NearDuplicates
    from specweave.llm.tokens import default_path

    none = docs(spark, [(1, "x")]).where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert NearDuplicates(none).components().count() == 0 and licenses.scan(none).count() == 0
    assert packing.pack(none, default_path("byte_bpe_50k.json")).count() == 0 and quality.QualityClassifier(none, labels).scores().count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_wrapped_notices(spark):
    from specweave.llm import licenses

    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    gpl = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\r\nLicense, v. 2.0."
    # all words of the notice, but scattered: no block holds enough of them
    apart = mit.replace("\n", "\n" + "filler " * 40 + "\n").replace("charge", "charge" + " filler" * 40)
    rows = [(1, mit), (2, "code();\n" + gpl), (3, bsd), (4, mpl), (5, apart), (6, mit.replace("\n", " "))]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == {1: ("mit", 1.0), 2: ("gpl-3", 1.0), 3: ("bsd", 1.0), 4: ("mpl-2", 1.0), 5: ("", 0.0), 6: ("mit", 1.0)}


def test_licenses_equal_their_sql(spark):
    import duckdb
    import pyarrow as pa

    from specweave.llm import licenses

    rng = np.random.default_rng(8)
    notices = [t.split() for _, t in licenses.TEMPLATES]
    rows = [(-1, None), (-2, ""), (-3, "\n"), (-4, "...\n\nthe")]
    for k in range(200):
        # a notice with some words lost, repeated or moved, wrapped anywhere, between others' words
        words = [w for w in notices[k % len(notices)] for _ in range(rng.choice(3, p=[0.12, 0.8, 0.08]))]
        i, j = rng.integers(0, len(words), 2) if words else (0, 0)
        words = rng.choice(["the", "x", "license", "under"], rng.integers(0, 6)).tolist() + words[: max(i, j)] + ["y"] * int(rng.integers(0, 4)) + words[max(i, j) :] + ["of", "this"]
        rows.append((k, "".join(w + rng.choice([" ", "\n", ", ", "\r\n"], p=[0.7, 0.15, 0.1, 0.05]) for w in words)))
    frame = docs(spark, rows)
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string())})
    with duckdb.connect() as db:
        db.register("documents", documents)
        wanted = sorted(db.sql(licenses.OP7_SQL).fetchall())
    got = sorted(tuple(r) for r in licenses.scan(frame).collect())
    assert got == wanted
    assert 20 < sum(r[6] != "" for r in got) < 200


def test_all_items_teach_the_latent_space(spark):
    from specweave.llm import decontaminate

    # no two items share a word, so an item outside the fit has no place in the space
    items = [" ".join(f"i{k}w{j}" for j in range(32)) for k in range(40)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(k, f"some words stand before {t} and some after it") for k, t in enumerate(items)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs(spark, rows), bench, sample=1, block=16).collect()}
    assert got == {(k, k) for k in range(40)}


def test_all_passages_teach_the_latent_space(spark):
    from specweave.llm import decontaminate

    rng = np.random.default_rng(4)
    prose = lambda most: " ".join(f"w{i}" for i in rng.integers(0, 40, int(rng.integers(1, most))))
    texts, items = [prose(100) for _ in range(3000)] + ["", None], [prose(40) for _ in range(20)] + [None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    space = decontaminate.fit_space(docs(spark, list(enumerate(texts))), bench)

    words = [decontaminate.slots_of(decontaminate.text_words(t)) for t in texts if t is not None]
    n = np.bincount(np.concatenate([np.unique(w) for w in words]), minlength=decontaminate.SLOTS)
    idf = np.log((1 + len(words)) / (1 + n)) + 0.1

    def passages(words):
        parts = [np.bincount(w[a : a + 32], minlength=decontaminate.SLOTS)[n > 0] * idf[n > 0] for w in words for a in range(0, len(w), 32)]
        return np.array([p / np.linalg.norm(p) for p in parts])

    own, other = passages(words), passages([decontaminate.slots_of(decontaminate.text_words(t)) for t in items if t is not None])
    # fewer words than dimensions: the space is that of all passages, not near it
    moments = own.T @ own + len(own) / len(other) * other.T @ other
    want = idf[n > 0, None] * np.linalg.inv(moments) * idf[n > 0]
    got = space.rows[: decontaminate.SLOTS][n > 0].astype(float)
    assert got.shape[1] == (n > 0).sum() and np.allclose(space.idf[:-1], idf)
    assert np.abs(got @ got.T - want).max() < 1e-3 * np.abs(want).max()


def test_unlearned_languages_go(spark):
    import corpus_pipeline

    words = {"en": "the of and house river", "de": "der und das haus fluss ist", "fr": "le et la maison rivière est"}
    rng = np.random.default_rng(2)
    known = [(i, " ".join(rng.choice(words[k].split(), 20)), k, "s", 0) for i in range(150) for k in [list(words)[i % 3]]]
    letters = list("abcdefghijklmnopqrstuvwxyz   ")
    foreign = ["Российский язык является одним из восточнославянских языков", "中文是世界上使用人数最多的语言之一也是联合国的官方语言", *("".join(rng.choice(letters, 300)) for _ in range(5)), "12 !?", None]
    table = spark.createDataFrame(known + [(200 + i, t, None, "s", 0) for i, t in enumerate(foreign)], DOCS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_stage(spark, table, "").collect()) == list(range(150))


def test_verbatim_copies_at_any_place():
    from specweave.llm.decontaminate import RANK, SLOTS, Item, LatentIndex, Space, text_words

    rng = np.random.default_rng(6)
    items = [" ".join(f"i{k}x{j}" for j in range(n)) for k, n in enumerate((1, 2, 3, 4, 5, 24, 26, 46, 55))]
    # every word has a direction of its own, so foreign words beside an item lower its cosine
    index = LatentIndex([Item(k, t) for k, t in enumerate(items)], Space(np.ones(SLOTS), np.ones(RANK), rng.standard_normal((SLOTS, RANK))))
    for k, item in enumerate(items):
        for before in range(40, 44):
            words = text_words(" ".join(f"b{j}" for j in range(before)) + f" {item} " + " ".join(f"a{j}" for j in range(60)))
            got = [(t, i.item_id, common, kind) for t, i, _, common, kind, _ in index.leaks(words, np.array([0, len(words)]))]
            assert got == [(0, k, index.items[k].n, "copy")]
    # the words of a short item must stand together
    words = text_words("before i1x0 between i1x1 after")
    assert not list(index.leaks(words, np.array([0, len(words)])))


def test_paraphrases_match_brute_force(spark):
    from specweave.llm import decontaminate

    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    prose = lambda n: list(rng.choice(vocabulary, n))
    items = [(prose(30), prose(8)) for _ in range(60)]
    rows = {}
    for k, (question, answer) in enumerate(items):
        for there in (True, False):
            own, end = list(question), list(answer)
            for i in rng.choice(30, int(rng.integers(8, 15)) if there else 6, replace=False):
                own[i] = f"o{i}"
            for i in () if there else rng.choice(8, 5, replace=False):
                end[i] = f"o{i}"
            rows[2 * k + (not there)] = prose(int(rng.integers(20, 60))) + own + end + prose(40)
    rows |= {1000 + i: prose(200) for i in range(60)}

    def common(a, b):
        last = [0] * (len(b) + 1)
        for p in a:
            row = [0]
            for j, q in enumerate(b):
                row.append(last[j] + 1 if p == q else max(last[j + 1], row[j]))
            last = row
        return last[-1]

    want = set()
    for d, words in rows.items():
        for k, (question, answer) in enumerate(items):
            item = question + answer
            if len(set(item) & set(words)) < 0.6 * len(set(item)):
                continue
            for i in range(len(words) - 37):
                window = words[i : i + 38]
                lcs = common(item, window)
                if lcs >= 0.8 * 38 or lcs >= 0.6 * 38 and np.isin(answer, window).mean() >= 0.8:
                    want.add((d, k))
    bench = spark.createDataFrame([(k, " ".join(q) + ". " + " ".join(a) + ".") for k, (q, a) in enumerate(items)], "item_id long, text string")
    found = decontaminate.find_leaks(docs(spark, [(d, " ".join(w)) for d, w in rows.items()]), bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert want == {(2 * k, k) for k in range(60)} and got <= want
    assert {r["kind"] for r in found} == {"paraphrase"} and len(got) >= 0.9 * len(want), len(got) / len(want)
