"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams (1 to 3 characters of
the lower-cased text, in ``2 ** BITS`` slots).  Document frequencies are
counted over all rows that may teach.  The weights are trained with follow the
regularised leader (per-coordinate FTRL-Proximal) under L1 and L2 penalties on
a bounded sample of each language (about ``PER_LANGUAGE`` texts, picked by a hash of the
row), of all languages however many; the model holds ``2 ** BITS`` weights a language.  Of
each language the second and every fifth row after it, by that hash, calibrate one
temperature and the rejection threshold and train nothing; a language of one row only trains.
Whole texts are read in training and prediction; the driver gets their n-gram weights, not the texts.

Rejection (``keep_known``) looks at the best language's logit before the
temperature, the evidence: what a text's n-grams say for a language at all.  The
score says only which language is the likeliest of those learned, so random
letters reach scores near 1.  The threshold is the evidence that 99 % of texts of
random letters, as long as the calibrating ones (``NOISE`` characters at most), stay below, and never more than
the least evidence of a calibrating text whose language is recognised.

Defined cases: a null text and one without a letter are ``und`` with score 0;
null languages teach nothing; without any labelled row all predictions are
``und``; with one language all other texts get it, score 1; extra columns are
ignored by ``predict`` and kept by ``keep_known``, whatever their names.  With one language, or without a
calibrating row, the threshold is 0, and texts with a letter are judged by the sign of their evidence.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import mix64, tidy
from .common import filter_texts, held_out, table

BITS = 15
SLOTS = 1 << BITS
PER_LANGUAGE = 500
NOISE = 4096
UND = "und"


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of the hashed n-grams of a whole text; digits and runs of other signs count as one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    letter = ((points >= 97) & (points <= 122)) | (points >= 0xAA)
    points = np.where(letter, points, np.uint64(32))
    keep = np.ones(len(points), bool)
    keep[1:] = letter[1:] | letter[:-1]
    points = np.concatenate(([np.uint64(32)], points[keep], [np.uint64(32)]))
    gram = np.zeros(len(points), np.uint64)
    slots = []
    for n in range(min(3, len(points))):
        gram = gram[: len(points) - n] * np.uint64(0x110000) + points[n:]
        slots.append((mix64(gram + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
    total = np.bincount(np.concatenate(slots), minlength=SLOTS)
    at = np.flatnonzero(total)
    return at, total[at]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def weights_of(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, TF-IDF weights) of length 1."""
    at, n = gram_counts(text)
    w = (1.0 + np.log(n)) * idf[at]
    return at, w / max(np.sqrt((w * w).sum()), 1e-12)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    temperature: float = 1.0
    #: Least evidence of a text in a learned language.
    floor: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        at, w = weights_of(text, self.idf)
        return w @ self.weights[at]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(likeliest language, score, whether the evidence is enough)."""
        if not self.languages or not has_letter(text):
            return UND, 0.0, False
        evidence = self.logits(text)
        z = evidence / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum()), bool(evidence[best] >= self.floor)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def train_ftrl(rows, n_languages: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.05, epochs=3, seed=7) -> np.ndarray:
    """FTRL-Proximal over rows ((slots, weights), class); gives the dense weight table."""
    z = np.zeros((SLOTS, n_languages))
    g2 = np.zeros((SLOTS, n_languages))
    order = np.random.default_rng(seed)

    def current(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(g2[at])) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            (at, x), y = rows[i]
            w = current(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            gg = g * g
            z[at] += g - (np.sqrt(g2[at] + gg) - np.sqrt(g2[at])) / alpha * w
            g2[at] += gg
    return current(np.arange(SLOTS))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search."""

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5.0) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def noise(lengths: list[int], letters: str, seed: int = 11) -> list[str]:
    """Texts of random ``letters``, as long as ``lengths`` tell."""
    rng = np.random.default_rng(seed)
    signs = np.array(sorted(set(letters)) or ["a"])
    return ["".join(np.where(rng.random(n) < 0.15, " ", rng.choice(signs, n))) for n in lengths]


def fit_floor(model: LanguageModel, held, lengths: list[int], letters: str) -> float:
    """The rejection threshold from calibrating rows ((slots, weights), class) and the lengths of their texts."""
    evidence = np.array([x @ model.weights[a] for (a, x), _ in held])
    right = evidence.argmax(axis=1) == np.array([y for _, y in held])
    random = np.quantile([model.logits(t).max() for t in noise(lengths, letters)], 0.99)
    # a little less, for rounding
    return float(min(random, evidence.max(axis=1)[right].min() * 0.999)) if right.any() else 0.0


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(documents with each slot, documents) over all of ``texts`` (text)."""

    def run(batches):
        total = np.zeros(SLOTS + 1, np.int64)
        for batch in batches:
            for t in batch.column("text"):
                total[gram_counts(t.as_py())[0]] += 1
                total[SLOTS] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["slot", "n"])

    got = texts.mapInArrow(tidy(run), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS + 1, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out[:SLOTS], int(out[SLOTS])


def sample_rows(picked: DataFrame, idf: np.ndarray) -> list[dict]:
    """(lang, h, n, letters, slots, weights) of each text of ``picked`` (text, lang, h) that has a letter."""
    schema = "lang string, h long, n long, letters string, slots array<int>, weights array<float>"
    shared = picked.sparkSession.sparkContext.broadcast(idf.astype(np.float32))

    def run(batches):
        for batch in batches:
            for text, lang, h in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in ("lang", "h"))):
                text = text.as_py()
                if not has_letter(text):
                    continue
                at, w = weights_of(text, shared.value)
                letters = "".join(sorted({c for c in set(text.lower()) if c.isalpha()}))
                row = ([lang], [h], [len(text)], [letters], [at.astype(np.int32)], [w.astype(np.float32)])
                types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], ["lang", "h", "n", "letters", "slots", "weights"])

    got = picked.mapInArrow(tidy(run), schema).toArrow()
    shared.destroy()
    out = got.drop_columns(["slots", "weights"]).to_pylist()
    for r, at, w in zip(out, got.column("slots"), got.column("weights")):
        r |= {"slots": at.values.to_numpy().astype(np.int64), "weights": w.values.to_numpy().astype(np.float64)}
    return sorted(out, key=lambda r: (r["lang"], r["h"], r["n"]))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model of ``docs`` (doc_id, text, lang) that may teach; held-out rows never do."""
    taught = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"))
    counts = {r["lang"]: r["n"] for r in taught.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return LanguageModel([], np.ones(SLOTS))
    df, n_docs = document_frequencies(taught.select("text"))
    idf = np.log((1.0 + n_docs) / (1.0 + df)) + 1.0
    # a share of each language's rows that makes per_language of them, by their hash; equal rows count once
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))))
    picked = taught.where((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) < share[F.col("lang")]).distinct()
    names = sorted(counts)
    at = {k: i for i, k in enumerate(names)}
    rows, held, lengths, letters, nth = [], [], [], set(), dict.fromkeys(names, 0)
    for r in sample_rows(picked, idf):
        one = ((r["slots"], r["weights"]), at[r["lang"]])
        if nth[r["lang"]] % 5 == 1:
            held.append(one)
            lengths.append(min(r["n"], NOISE))
            letters |= set(r["letters"])
        else:
            rows.append(one)
        nth[r["lang"]] += 1
    model = LanguageModel(names, idf, train_ftrl(rows, len(names)))
    if held and len(names) > 1:
        model.temperature = fit_temperature(np.array([x @ model.weights[a] for (a, x), _ in held]), np.array([y for _, y in held]))
        model.floor = fit_floor(model, held, lengths, "".join(letters))
    model.idf, model.weights = idf.astype(np.float32), model.weights.astype(np.float32)
    return model


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            both = [shared.value.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([b[0] for b in both], pa.string()), pa.array([b[1] for b in both], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, languages: tuple[str, ...] | None = None, least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns, in a learned language (or one of ``languages``) by evidence, with score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def judge(batches):
        for batch in batches:
            found = [shared.value.judge(t.as_py()) for t in batch.column("text")]
            yield [known and score >= least and (languages is None or name in languages) for name, score, known in found]

    return filter_texts(docs, judge)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
