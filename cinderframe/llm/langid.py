"""Operator 3, language ID: blended-spectrum presence kernels.

A text's feature set is the presence of every byte n-gram of length 1 to ``longest`` in the text with
A-Z folded, hashed to ``1 << bits`` places. The kernel of two texts is the size of the sets' intersection
over the root of the product of their sizes. ``landmarks`` training texts give a Nyström map, on which one
kernel ridge regression per language (one against the rest) is fitted. As the kernel is linear in presence,
landmarks and weights fold into one matrix; texts are scored by batched products with it.

Fitting takes a bounded sample, ``sample`` rows over all languages, by hash of doc_id and text, equal rows
once; predicting covers every whole text, in blocks for very long ones.

The prediction is ``und`` with score 0 if the text is null, empty or has no letter (Unicode category L: neither
digits nor fractions or circled numbers are), or if nothing could be learned. Equal scores go to the language first in order. Copies get equal results. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, release, tune
from .wordhash import LOWER

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


class Spectrum:
    def __init__(self, longest: int = 3, bits: int = 15):
        self.longest, self.bits = longest, bits
        self.odd = np.random.default_rng(3).integers(0, 2**31, longest, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)

    def presence(self, data: np.ndarray, out: np.ndarray, block: int = 1 << 18) -> None:
        """Set the places of all n-grams of a text's bytes; blocks overlap by a gram."""
        for k in range(0, len(data), block):
            part = data[k : k + block + self.longest - 1].astype(np.uint32)
            key = np.zeros(len(part), np.uint32)
            for n in range(1, self.longest + 1):
                m = len(part) - n + 1
                if m <= 0:
                    break
                key = (key[:m] + part[n - 1 :] + np.uint32(1)) * self.odd[n - 1]
                key ^= key >> np.uint32(15)
                out[(key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)] = 1


def text_bytes(text: str) -> np.ndarray:
    return LOWER[np.frombuffer(text.encode(), np.uint8)]


class Model:
    """score(text set) = set @ weights / sqrt(size) + bias, a column for each language."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray):
        self.languages, self.weights, self.bias = languages, weights, bias


def fit_rows(sets: np.ndarray, labels: list[str], landmarks: int, ridge: float, block: int = 256) -> Model:
    """Nyström kernel ridge regression on presence rows of packed bits; unpacked in blocks, so that the driver stays small."""
    languages = sorted(set(labels))

    def unit(packed: np.ndarray) -> np.ndarray:
        x = np.unpackbits(packed, axis=1).astype(np.float32)
        x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return x

    turn = np.argsort(np.concatenate([np.arange(labels.count(g)) for g in languages]), kind="stable")  # languages take turns
    by_language = np.argsort(np.array([languages.index(g) for g in labels]), kind="stable")
    marks = unit(sets[by_language[turn][:landmarks]])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])  # K_mm to the power -1/2, up to a rotation
    phi = np.concatenate([(unit(sets[k : k + block]) @ marks.T).astype(np.float64) for k in range(0, len(sets), block)]) @ root
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None], 1.0, -1.0)
    mean, level = phi.mean(0), y.mean(0)
    # every language weighs the same, else a rare one would drown
    weight = np.array([1.0 / labels.count(g) for g in labels])[:, None] * len(labels) / len(languages)
    w = np.linalg.solve((phi - mean).T @ (weight * (phi - mean)) + ridge * len(labels) * np.eye(phi.shape[1]), (phi - mean).T @ (weight * (y - level)))
    return Model(languages, marks.T.astype(np.float64) @ (root @ w), level - mean @ w)


def fit(labelled: DataFrame, sample: int = 2400, landmarks: int = 240, ridge: float = 1e-3, longest: int = 3, bits: int = 15) -> Model | None:
    """Fit on a sample of (doc_id, text, lang) rows of at most about ``sample`` rows; only feature sets reach the driver.

    Each language gives an equal share of rows, those of smallest hash; so does the bound, if the draw oversteps it.
    """
    spark = labelled.sparkSession
    tune(spark)
    rows = only(labelled, doc_id="long", text="string", lang="string").where("text IS NOT NULL AND lang IS NOT NULL AND text != ''")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not counts:
        return None
    share = max(1, sample // len(counts))
    rate = F.create_map(*(F.lit(v) for g, n in counts.items() for v in (g, min(1.0, share / n))))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    share_of = (place / rate[F.col("lang")]).alias("place")
    picked = rows.select("text", "lang", share_of).where("place < 1").dropDuplicates()
    spectrum = Spectrum(longest, bits)

    def sets(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                mark = np.zeros(1 << bits, np.uint8)
                spectrum.presence(text_bytes(text), mark)
                out.append(np.packbits(mark).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["lang", "place", "bits"])

    got = picked.mapInArrow(sets, "lang string, place double, bits binary").orderBy("place", "lang", "bits").limit(2 * sample + len(counts)).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], r["bits"]))
    x = np.array([np.frombuffer(r["bits"], np.uint8) for r in got])
    return fit_rows(x, [r["lang"] for r in got], landmarks, ridge)


def predict(documents: DataFrame, model: Model | None, longest: int = 3, bits: int = 15, rows: int = 32, into: tuple[str, str, str] = ("lang_pred", "score", "has_letter")) -> DataFrame:
    """The documents' columns with those of ``into`` after them. No shuffle; the model travels with the tasks.

    has_letter, never null, is false for null and empty texts and those without any letter; it needs no model.
    Columns of the documents that bear a name of ``into`` give way to the results.
    """
    tune(documents.sparkSession)
    spectrum = Spectrum(longest, bits)
    documents = documents.drop(*(c for c in documents.columns if c.lower() in into))
    names = documents.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)

    def run(batches):
        release()
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            letter = [bool(t and LETTER.search(t)) for t in texts]
            usable = [k for k, has in enumerate(letter) if has] if model else []
            for a in range(0, len(usable), rows):
                part = usable[a : a + rows]
                sets = np.zeros((len(part), 1 << bits))
                for row, k in zip(sets, part):
                    spectrum.presence(text_bytes(texts[k]), row)
                # rounded, so that a text's place in its batch does not show
                f = np.round(sets @ model.weights / np.sqrt(sets.sum(1, keepdims=True)) + model.bias, 9)
                best = f.argmax(1)
                for k, b, s in zip(part, best.tolist(), f[np.arange(len(part)), best].tolist()):
                    lang[k], score[k] = model.languages[b], min(1.0, max(0.0, (s + 1) / 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(letter, pa.bool_())], [*names, *into])

    return documents.mapInArrow(run, f"{schema}, `{into[0]}` string, `{into[1]}` double, `{into[2]}` boolean")


def held_out() -> Column:
    """The fold that is never learned from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document, learned from the other folds."""
    texts = only(documents, doc_id="long", text="string")
    model = fit(documents.where(~held_out() & F.col("doc_id").isNotNull()))
    return predict(texts, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
