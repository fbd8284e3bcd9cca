"""Operators on texts against the tokenizer library and plain versions; edge cases of every one."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cinderframe.llm import anchors, bpe, edits, langid, licenses, minhash, packing
from tests.llm import brute

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hashes string, root string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def make_docs():
    rnd = random.Random(4)
    vocab = [f"w{k}" for k in range(300)]
    base = [" ".join(rnd.choices(vocab, k=rnd.randint(20, 120))) for _ in range(30)]
    texts = list(base)
    for t in base[:12]:  # near copies of several strengths
        for edits_made in (1, 3, 8):
            w = t.split()
            for _ in range(edits_made):
                w[rnd.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [base[0], base[0].upper(), base[1] + "\n" + base[2]]  # a copy, a copy but for case, a compound
    passage = " ".join(rnd.choices(vocab, k=60))
    texts += [f"start {k} {passage} end {k}" for k in range(6)]
    texts += [None, "", "   \n", "one", "two words", "two words", "a b c d e", "Under the MIT License. Apache License, Version 2.0! CC-BY-NC", "x " * 3000, "y" * 5000]
    texts += ["naïve Σ ΑΣ <|endoftext|>it's 1２3", "ÉCOLE \x1c\x1d z", "12345 678 !!", "한국어 텍스트"]
    return [(k * 7 % 1009, t) for k, t in enumerate(texts)]


DOCS = make_docs()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, "s", len(t or ""), "h", "r") for i, t in DOCS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_is_the_library(docs, library):
    got = {r.doc_id: r for r in bpe.bpe_digests(docs, VOCABULARY).collect()}
    assert len(got) == len(DOCS)
    for i, t in DOCS:
        ids = ids_of(library, t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_random_text(library):
    rnd, coder = random.Random(2), bpe.coder(VOCABULARY)
    letters = ["a", "e", "S", "t", "'", "'s", "'LL", "é", "é", "Σ", "İ", "9", "½", " ", "\n", "\x1c", "\x85", "中", "क्", "🙂", "-", "<|startoftext|>", "the", "ing"]
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 20))) for _ in range(1500)] + ["".join(rnd.choices("abtheinr", k=rnd.randint(1, 200))) for _ in range(300)]
    for t, raw in zip(texts, coder.encode_all(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == ids_of(library, t), t
    for w in ["the", "ofantition", "zzzzzz", "a" * 90]:
        assert coder.word(w) == coder.many([w])[0] == coder._by_rank(w + bpe.END)


def test_packing(docs, empty, library):
    rows = packing.pack(docs, VOCABULARY, capacity=256, window=16).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(DOCS)
    for i, t in DOCS:
        ids, at = np.array([*ids_of(library, t), 1], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 256 or at & (at - 1) == 0  # no padding at all
    assert packing.pack(empty, VOCABULARY).count() == 0


def test_balance_evens_cost():
    lengths = [900, 800, 700, 300, 200, 100] * 50
    pieces, rooms = packing.balance(lengths, 1024, 1.0, 1 / 512)
    load = dict.fromkeys(range(len(rooms)), 0)
    for _, _, n, s, _ in pieces:
        load[s] += n
    assert all(load[s] == room for s, room in enumerate(rooms)) and sum(load.values()) == sum(lengths)


def test_balance_finds_the_lowest_cost_with_room():
    """Over 64 cheaper sequences without room do not hide a dearer one that has it."""
    mixed = random.Random(3)
    for lengths in ([1500] * 100 + [600] * 300 + [500] * 100 + [248] * 119, [mixed.randint(1, 2047) for _ in range(600)]):
        pieces, rooms = packing.balance(lengths, 2048, 1.0, 1 / 1024)
        left, cost, want = rooms[:], [0.0] * len(rooms), {}
        for rest in sorted(range(len(lengths)), key=lambda r: (-lengths[r], r)):
            n = lengths[rest]
            if fits := [(cost[s], s) for s in range(len(rooms)) if left[s] >= n]:
                s = min(fits)[1]
                want[rest] = (n, s, rooms[s] - left[s])
                left[s], cost[s] = left[s] - n, cost[s] + n + n * n / 1024
        whole = {rest: (n, s, offset) for rest, _, n, s, offset in pieces if n == lengths[rest]}
        assert {rest: whole.get(rest) for rest in want} == want
        assert len(rooms) > 64 and sum(p[2] for p in pieces) == sum(lengths)


def test_near_documents(docs, empty, spark):
    for percent in (80, 85):
        want = brute.near(DOCS, percent)
        got = {r.doc_id: r for r in minhash.near_documents(docs, percent=percent, block=8).collect()}
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert minhash.near_documents(empty).count() == 0


def test_near_documents_across_blocks(spark):
    """A chain of versions, each near the next only, in a group of many blocks."""
    rnd = random.Random(8)
    w = [f"k{k}" for k in range(200)]
    rows = []
    for k in range(40):
        rows.append((k, " ".join(w)))
        at = rnd.randrange(200)
        w[at] = f"n{k}"
        w[(at + 57) % 200] = f"m{k}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near(rows, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_documents(df, block=4).collect()}
    assert got == want


def test_near_documents_of_repeated_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, a), (5, b), (8, b + " more"), (9, a), (9, a), (None, a), (None, None), (7, ""), (7, "")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(i, t, "x") for i, t in order], "doc_id long, text string, first string")
        got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in minhash.near_documents(df).collect())
        assert got == [(0, 0, 0, True), (0, 36, 0, True), (5, 36, 5, True), (5, 36, 5, True), (7, 0, 7, True), (7, 0, 7, True), (8, 37, 5, False), (9, 36, 5, False), (9, 36, 5, False)]


def test_near_documents_in_large_buckets(spark):
    """Buckets of more members than meet at a time: near copies of one text, a second lot near only among itself, texts near none."""
    rnd = random.Random(12)
    common = [f"c{k}" for k in range(120)]
    rows = []
    for k in range(60):
        w = common[:]
        w[rnd.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(w)))
    other = common[:60] + [f"d{k}" for k in range(60)]
    for k in range(60, 90):
        w = other[:]
        w[rnd.randrange(120)] = f"y{k}"
        rows.append((k, " ".join(w)))
    rows += [(k, " ".join(common[:70] + [f"z{k}w{n}" for n in range(50)])) for k in range(90, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.near(rows, 80)
    assert len({c for _, c in want.values()}) > 30
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_documents(df, block=16, bucket=8).collect()}
    assert got == want


def test_one_of_exact_repeats_leads(docs):
    out = minhash.near_documents(docs.union(docs)).where("n_shingles > 0").collect()
    lead = {}
    for r in out:
        if r.leads:
            lead.setdefault(r.component_id, set()).add((r.doc_id, r.text_hash))
    assert all(len(v) == 1 for v in lead.values()) and lead.keys() == {r.component_id for r in out}


LONG = ["w " * 300_000, "z" * 1_000_000, " ".join(f"n{k % 50_000}" for k in range(150_000))]


def test_very_long_texts(spark, library):
    """Texts of megabytes and one huge word through every operator on texts, whole."""
    rows = [(k, t) for k, t in enumerate(LONG)] + [(9, LONG[2] + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute.repeated(rows)
    got = {r.doc_id: r for r in anchors.remove_repeats(df).collect()}
    assert {i: (r.n_words, r.n_removed) for i, r in got.items()} == {i: w[:2] for i, w in want.items()}
    near = {r.doc_id: r.component_id for r in minhash.near_documents(df).collect()}
    assert near == {0: 0, 1: 1, 2: 2, 9: 2}
    ids = {i: np.array(ids_of(library, t), "<u4") for i, t in rows}
    for r in bpe.bpe_digests(df, VOCABULARY).collect():
        assert (r.n_tokens, r.ids_sha256) == (len(ids[r.doc_id]), hashlib.sha256(ids[r.doc_id].tobytes()).hexdigest())
    pieces = packing.pack(df, VOCABULARY).groupBy("doc_id").agg(langid.F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == {i: len(x) + 1 for i, x in ids.items()}
    assert {r.doc_id for r in langid.identify(df.withColumn("lang", langid.F.lit("en"))).collect()} == {i for i, _ in rows}


def test_bpe_edges(spark, empty):
    assert bpe.bpe_digests(empty, VOCABULARY).count() == 0
    same = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in bpe.bpe_digests(same, VOCABULARY).collect())
    assert got == [(0, 0), (1, 2), (1, 2)]


def test_automaton_says_the_longest_token_at_every_place(library):
    """One pass of the automaton against trying every token at every place."""
    coder, rnd = bpe.coder(VOCABULARY), random.Random(7)
    whole = {s: i for s, i in ((coder._mark(s), i) for s, i in library.get_vocab().items()) if 0 < i < len(coder.length) and coder.length[i]}
    for _ in range(40):
        text = "".join(rnd.choices("etaoinshrdlu\u0120\u0142", k=60)) + bpe.END
        node, best = 0, [0] * len(text)
        for k in range(len(text) - 1, -1, -1):
            node = coder.step[node, coder.letter.get(text[k], 0)]
            best[k] = coder.says[node]
        want = [next((whole[text[k:e]] for e in range(len(text), k, -1) if text[k:e] in whole), -1) for k in range(len(text))]
        assert best == want


def test_prune_keeps_what_may_be_similar():
    for n, least in minhash.least_matches(192, 32, 0.85, 1e-6):
        assert 0 < least < 0.85 * n  # never prunes at the expected number of matches


def test_repeats(docs, empty):
    want = brute.repeated([(i, t) for i, t in DOCS])
    got = {r.doc_id: r for r in anchors.remove_repeats(docs).collect()}
    assert len(got) == len(DOCS)
    for i, (n, gone, kept) in want.items():
        assert (got[i].n_words, got[i].n_removed) == (n, gone)
        assert got[i].kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    texts = {r.doc_id: r for r in anchors.remove_repeats(docs, digest=False).collect()}
    assert texts[DOCS[0][0]].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "hashes", "root"}
    for i, t in DOCS:
        assert texts[i].text == (" ".join(want[i][2]) if want[i][1] else t)
        assert texts[i].n_chars == (None if texts[i].text is None else len(texts[i].text))
    assert anchors.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("period", [1, 3, 7, 13])
def test_covers_meet(period):
    cover = anchors.COVERS[period]
    assert all(any((i + s) % period in cover and (j + s) % period in cover for s in range(period)) for i in range(period) for j in range(period))


def test_licenses(docs, empty):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert len(got) == len(DOCS)
    r = got[next(i for i, t in DOCS if t and t.startswith("Under the MIT"))]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (12, 3, 0, 9, "apache-2,cc-by-nc,mit")
    assert r.labels == "apache-2,cc-by-nc,mit,mit-notice" and r.score == 1.0
    r = got[next(i for i, t in DOCS if t is None)]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (0, 0, None, None, "", "", 0.0)
    assert licenses.scan_licenses(empty).count() == 0


def test_template_markup():
    a = licenses.Automaton("keep [[ this | that <<1>> ]] wording <<2>> exact")
    for text, fits in (("keep wording x exact", True), ("keep this wording x y exact", True), ("keep that one wording x exact", True), ("keep that wording x exact", False), ("keep wording exact", False), ("keep wording x y z exact", False), ("keep this that wording x exact", False), ("keep keep wording wording x exact", True), ("", False)):
        assert a.holds(text.split()) == fits, text
    for bad in ("open [[ region", "closed ]] region", "[[ nothing mandatory ]]"):
        with pytest.raises(ValueError):
            licenses.Automaton(bad)


def filled(template, rnd):
    """A text that a template accepts, its regions and any-words drawn; now and then one word is changed."""
    tokens, out = licenses.tokens_of(template), []

    def run(k, keep):
        while k < len(tokens) and tokens[k] not in ("]]", "|"):
            t = tokens[k]
            k += 1
            if t == "[[":
                branches, start = 1, k
                deep, at = 0, k
                while deep >= 0:  # how many branches it has
                    deep += (tokens[at] == "[[") - (tokens[at] == "]]")
                    branches += tokens[at] == "|" and not deep
                    at += 1
                chosen, now = rnd.randint(-1, branches - 1), 0
                while True:
                    k = run(k, keep and now == chosen)
                    now += 1
                    k += 1
                    if tokens[k - 1] == "]]":
                        break
            elif keep:
                out.extend(rnd.choices(["jane", "2024", "doe", "the"], k=rnd.randint(1, int(t[2:-2]))) if t.startswith("<<") else [t])
        return k

    run(0, True)
    return out


def test_licenses_are_the_patterns(spark):
    """The operator against plain regular expressions and word lists: overlaps, repeats, changed words, long texts, repeated rows."""
    rnd, rows = random.Random(9), []
    for label, template in licenses.TEMPLATES.items():
        for k in range(8):
            words = filled(template, rnd)
            if k % 3 == 2:
                words[rnd.randrange(len(words))] = "changed"
            if k % 4 == 1:
                del words[rnd.randrange(len(words))]
            words = rnd.choices(["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc"], k=rnd.randint(0, 30)) + words + rnd.choices(["cc", "by", "nc", "sa"], k=12)
            rows.append(rnd.choice([" ", ", ", "\n* "]).join(w.upper() if rnd.random() < 0.2 else w for w in words))
    rows += [None, "", " - ", "under the mit license " * 3, "cc by cc by nc nc", "Ünder the MIT licensE", "é-cc by\tnc", "word " * 200_000 + "Under the MIT License", "y" * 1_000_000]
    rows += rows[:5]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(rows)], "doc_id long, text string, labels string, score int").repartition(3)
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert len(got) == len(rows)
    patterns = {label: brute.pattern(t) for label, t in licenses.TEMPLATES.items()}
    seen = set()
    for k, t in enumerate(rows):
        w = brute.license_words(t)
        places = {label: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p, label in licenses.PHRASES.items()}
        every = sorted(i for x in places.values() for i in x)
        base = {label for label, x in places.items() if x}
        labels = base | {label for label, p in patterns.items() if p.search(" " + " ".join(w) + " ")}
        seen |= labels
        want = (len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if labels else 0.0)
        assert tuple(got[k])[1:] == want, (k, t and t[:200])
    assert seen == set(licenses.TEMPLATES) | set(licenses.PHRASES.values())


def test_counted_edits(spark, library, empty):
    rnd = random.Random(3)
    base = [(k, t, s) for k, (_, t) in enumerate(DOCS) for s in [[(rnd.randint(-2, 500), rnd.randint(-1, 90), rnd.choice(["", " ", "inserted text", "\n", "'s", "ab", " <|endoftext|>", None])) for _ in range(rnd.randint(0, 12))]]]
    docs = spark.createDataFrame([(k, t) for k, t, _ in base], "doc_id long, text string")
    steps = spark.createDataFrame([(k, n, *s) for k, _, ss in base for n, s in enumerate(ss)] + [(9999, 1, 0, 0, "nobody")], "doc_id long, seq long, start long, length long, insertion string")
    got = {r.doc_id: r for r in edits.count_edits(docs, steps, VOCABULARY).collect()}
    assert len(got) == len(base)
    for k, t, ss in base:
        t = t or ""
        assert got[k].tokens_before == len(ids_of(library, t))
        for a, n, x in ss:
            a = min(max(a, 0), len(t))
            t = t[:a] + (x or "") + t[a + max(n, 0) :]
        assert (got[k].n_edits, got[k].tokens_after, got[k].chars_after, got[k].text_crc32) == (len(ss), len(ids_of(library, t)), len(t), zlib.crc32(t.encode()))
    assert edits.count_edits(empty, steps, VOCABULARY).count() == 0


def test_counted_edits_edges(spark, library):
    docs = spark.createDataFrame([(1, "b text", "x"), (1, "a text of more words", "x"), (None, "nobody's", "x"), (2, None, "x"), (3, "z" * 200_000, "x")], "doc_id long, text string, seq string")
    steps = spark.createDataFrame([(1, 1, 0, 1, "the"), (1, 1, 0, 1, "the"), (None, 1, 0, 0, "x"), (2, 1, 5, 5, "new"), (3, 2, 100_000, 1, " ")], "doc_id long, seq long, start long, length long, insertion string")
    got = {r.doc_id: r for r in edits.count_edits(docs, steps, VOCABULARY).collect()}
    assert got.keys() == {1, 2, 3} and (got[1].n_edits, got[2].n_edits) == (2, 1)
    want = {1: "thehe text of more words", 2: "new", 3: "z" * 100_000 + " " + "z" * 99_999}
    assert {i: (r.tokens_after, r.text_crc32) for i, r in got.items()} == {i: (len(ids_of(library, t)), zlib.crc32(t.encode())) for i, t in want.items()}
    assert edits.made_edits(docs).groupBy("doc_id").count().count() == 3


def test_edits_touch_little():
    text = " ".join(f"word{k}" for k in range(20_000))
    tree = edits.CountedText(text, bpe.coder(VOCABULARY))
    tree.edit(60_000, 5, "other")
    assert tree.encoded < 2000 < len(text) and tree.text() == text[:60_000] + "other" + text[60_005:]


def test_language_id(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert got and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert langid.identify(empty).count() == 0


def test_language_id_is_the_exact_kernel(spark):
    """Against kernel ridge regression on true sets of n-grams, all training texts being landmarks: neither hashed nor sampled."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text and langid.LETTER.search(r.text)]
    texts = [t[:400] for _, t, _ in rows]
    learn = [k for k, (i, _, g) in enumerate(rows) if zlib.crc32(str(i).encode()) % 4 != 2 and g]
    langs = sorted({rows[k][2] for k in learn})
    grams = [{b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)} for b in (langid.text_bytes(t).tobytes() for t in texts)]
    kernel = np.array([[len(x & grams[k]) / np.sqrt(len(x) * len(grams[k])) for k in learn] for x in grams])
    y = np.array([[1.0 if rows[k][2] == g else -1.0 for g in langs] for k in learn])
    f = y.mean(0) + (kernel - kernel[learn].mean(0)) @ np.linalg.solve(kernel[learn] - kernel[learn].mean(0) + 0.1 * np.eye(len(learn)), y - y.mean(0))
    want = {i: langs[b] for (i, _, _), b in zip(rows, f.argmax(1).tolist())}
    df = spark.createDataFrame([(i, t, g) for (i, _, g), t in zip(rows, texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}
    assert sum(got[i] == g for i, g in want.items()) / len(want) >= 0.97


def test_letters_are_letters(spark):
    texts = {1: "\u00bd \u2460 \u00b2", 2: "\u00aa", 3: "\u4e2d", 4: "_ 12", 5: "\U00010400", 6: "e\u0301", 7: "\u0301"}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()] + [(100 + k, "plain words here", "en") for k in range(8)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert {i for i in texts if got[i] == "und"} == {1, 4, 7}


def test_language_id_of_repeated_rows(spark):
    """A row that makes up most of the table takes one place of the sample; the bound holds."""
    rows = [(1, "immer wieder dieselben Worte", "de")] * 3000 + [(k, f"some other words {k}", "en") for k in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert got[1] == "de" and sum(g == "en" for g in got.values()) >= 50


def test_language_id_edges(spark, docs):
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 34 !", "de"), (4, "some english text", "en"), (5, "some english text", "en"), (None, "x", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(odd).collect()}
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (1, 2, 3)) and len(got) == 6
    assert (got[4].lang_pred, got[4].score) == (got[5].lang_pred, got[5].score) and 0 <= got[4].score <= 1
    unlabelled = langid.identify(docs.withColumn("lang", langid.F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
