"""The pipeline against plain versions of its stages, and the queries' registration."""

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import regex
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_run(spark):
    rows = list(zip(*(pq.read_table(f"{SF}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text"))))
    rows = [(i, t) for i, t in rows if t and regex.search(r"\p{L}", t)]
    near = brute.near(rows, 80)
    rows = [(i, t) for i, t in rows if near[i][1] == i]
    cut = brute.repeated(rows)
    texts = {i: " ".join(cut[i][2]) if cut[i][1] else t for i, t in rows}
    got = corpus_pipeline.run(spark, SF).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in texts.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame([(1, "some words of a text", "en", "s", 20), (2, None, None, None, None), (3, "1 2 3", "en", "s", 5), (4, "Some words of a text", "en", "s", 20), (None, "more words here", "en", "s", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = out
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1]


def test_stages_survive_clashing_columns(spark):
    """Columns named as the operators' own; repeated rows and ids."""
    long = " ".join(f"k{k}" for k in range(40))
    rows = [(1, long, "en", "s", 9), (1, long, "en", "s", 9), (1, "another text altogether of the same id", "en", "s", 9), (2, long + " more", "en", "s", 9), (3, "begin " + long + " then on", "en", "s", 9), (None, long, "en", "s", 9)]
    more = ("score", "lang_pred", "has_letter", "_told", "_key", "_doc", "_text", "kept", "leads", "component_id", "first", "c", "bucket", "hashes", "text_hash", "DIGEST")
    docs = spark.createDataFrame([(*r, *more) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in more))
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == names
    got = sorted((r.doc_id or 0, r.text) for r in docs.collect())
    assert [i for i, _ in got] == [0, 1, 1] and (1, long) in got and all(r.score == "score" for r in docs.collect())


def test_language_id_keeps_texts_with_letters(spark):
    """Also if no label can be learned from, and if ``und`` is a label itself."""
    texts = {1: "some words of a text", 2: None, 3: "", 4: "1 2 3", 5: "andere Worte", 6: "한국어"}
    for lang in (None, "und"):
        docs = spark.createDataFrame([(i, t, lang, "s", 9) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
        assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()) == [1, 5, 6]


def test_stages_on_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if re.match(r"op\d", n)} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names
