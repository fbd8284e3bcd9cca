"""Operator 2, MinHash near-dedup: banded candidates with sequential Bayesian verification.

1. Each document's distinct word shingles become 64-bit hashes; a MinHash signature and a 64-bit digest
   of the whole set follow (two of 10^9 different sets share one with a probability of 0.03). Documents of equal sets are one class from here on; its first row, by doc_id and
   text, stands for it.
2. Signatures are cut in bands. Classes that share a band's key are candidates of each other. Buckets with the
   same members in several bands count once.
3. In a bucket only signatures meet: they are compared batch by batch, and a pair goes as soon as the posterior
   probability that its similarity reaches the threshold falls below ``miss`` (uniform prior, Beta posterior).
   Members of a bucket beyond ``bucket`` are first compared with its head; those that may be near it form one
   lot, and only the others visit the bucket's blocks. Classes tied by surviving pairs are a group, so texts
   that merely share a band never hang together.
4. Survivors are checked exactly on their full sets, in blocks of a group of bounded size, unless they are already
   joined by checked links; the checked links that span the block's classes are kept. In groups of several blocks,
   members outside the group's largest checked component visit the other blocks, so each candidate pair of
   different components is compared, and pairs of one component never again.

A component reports the smallest doc_id reachable. With 32 bands of 6 rows a pair of similarity 0.8 shares
a band with probability 0.99994, one of 0.85 with 0.9999997.

A text without words (null, empty or blank) has an empty set and links with nothing; one with fewer words
than a shingle is one shingle. Rows of equal sets are copies; of rows that repeat a doc_id with other texts, each
is linked by its own text and reports that text's component.
A row without doc_id links with nothing: its component_id is null and it is kept. Texts are whole, of any
length. Extra columns stay behind. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, only, release, tune
from .components import components
from .streams import by_group
from .wordhash import LOWER, batch_words, grams, mix


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Each text's distinct shingles as ascending 64-bit hashes."""
    words, at = batch_words(texts, LOWER)
    g = grams(words, size)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(g[a : b - size + 1]))
        elif b > a:  # all its words as one
            out.append(grams(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Signer:
    def __init__(self, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.odd = (rng.integers(0, 2**31, size, dtype=np.uint64) * 2 + 1).astype(np.uint32)[:, None]
        self.add = rng.integers(0, 2**32, size, dtype=np.uint64).astype(np.uint32)[:, None]

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        """The smallest value of each permutation of 32-bit integers."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.odd), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(x), 2048):
            np.minimum(low, (self.odd * x[None, k : k + 2048] + self.add).min(1), out=low)
        return low


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.reshape(bands, -1).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def least_matches(total: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(compared, matches): below so many matches among those compared a pair can go.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, total + 1, batch):
        p, m = 0.0, 0
        while m <= n:
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if p >= miss:
                break
            m += 1
        out.append((n, m))
    return out


class Verifier:
    """Joins classes that meet by links that span them; a pair already joined is not compared."""

    def __init__(self, percent: int, plan: list[tuple[int, int]]):
        self.percent, self.plan = percent, plan

    def links(self, sigs: np.ndarray, sizes: np.ndarray, start: np.ndarray, rows: np.ndarray, targets: np.ndarray | None, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
        """Links of ``rows`` with ``targets`` (None: with all rows further down). ``start``: what is joined already has equal numbers.

        Pairs that pruning leaves are links; with ``sets``, if their exact similarity reaches the threshold.
        """
        label, out = np.unique(start, return_inverse=True)[1], []
        everyone = np.arange(len(sizes))
        for i in rows.tolist():
            others = everyone[i + 1 :] if targets is None else targets
            small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
            others = others[(label[others] != label[i]) & (100 * small >= self.percent * large)]
            same, done = np.zeros(len(others), np.int64), 0
            for upto, least in self.plan:
                if not len(others):
                    break
                same += (sigs[others, done:upto] == sigs[i, done:upto]).sum(1)
                keep, done = same >= least, upto
                others, same = others[keep], same[keep]
            for j in others[np.argsort(-same, kind="stable")].tolist():
                if label[j] != label[i] and (sets is None or self.near(sets[i], sets[j])):
                    out.append((i, j))
                    label[label == label[j]] = label[i]
        return out

    def near(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether two ascending sets are linked."""
        short, long = (a, b) if len(a) < len(b) else (b, a)
        at = np.searchsorted(long, short)
        both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
        return 100 * both >= self.percent * (len(short) + len(long) - both)


def pairs_of(ids: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch | None:
    if not found:
        return None
    i, j = np.array(found).T
    return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], ["a", "b"])


def signature_rows(group: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(group.num_rows, -1)


def survivors(classes: DataFrame, verifier: Verifier, bucket: int) -> DataFrame:
    """Links (a, b) that tie classes which share a band and whose signatures leave them possibly near."""
    slots = classes.select("c", F.explode("keys").alias("key"))
    heads = slots.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("head"), F.bit_xor(F.xxhash64("c")).alias("x")).where("n > 1")
    buckets = cut(heads.groupBy("n", "head", "x").agg(F.min("key").alias("key")).select("key", "n", "head"), "buckets")
    met = cut(slots.join(buckets, "key").join(classes.select("c", "n_shingles", "sig"), "c"), "met")

    def tie(group: pa.Table) -> pa.RecordBatch | None:
        """Everyone in a small bucket; in a block of a large one, those unlike its head (``lot`` 1) and visitors (2) with the block's own."""
        lot, ids, sizes = (group.column(c).to_numpy() for c in ("lot", "c", "n_shingles"))
        if (lot == 1).all():  # a small bucket, or a block without a lot of its own
            return pairs_of(ids, verifier.links(signature_rows(group), sizes, ids, np.arange(len(ids)), None))
        start = np.where(lot == 0, -1, np.arange(len(ids)))
        return pairs_of(ids, verifier.links(signature_rows(group), sizes, start, np.flatnonzero(lot > 0), np.flatnonzero(lot < 2)))

    small = met.where(F.col("n") <= bucket).select(F.col("key").alias("g"), F.lit(1).alias("lot"), "c", "n_shingles", "sig")
    links = by_group(small, tie, "a long, b long")
    large = met.where(F.col("n") > bucket)
    if not large.isEmpty():
        to_head = large.join(classes.select(F.col("c").alias("head"), F.col("sig").alias("head_sig"), F.col("n_shingles").alias("head_n")), "head")

        def starred(batches):
            for batch in batches:
                sigs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig", "head_sig")]
                n, head_n = batch.column("n_shingles").to_numpy(), batch.column("head_n").to_numpy()
                near = 100 * np.minimum(n, head_n) >= verifier.percent * np.maximum(n, head_n)
                for upto, least in verifier.plan:
                    near &= (sigs[0][:, :upto] == sigs[1][:, :upto]).sum(1) >= least
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "n", "head", "c", "n_shingles", "sig")), pa.array(near)], ["key", "n", "head", "c", "n_shingles", "sig", "near"])

        lots = cut(to_head.select("key", "n", "head", "c", "n_shingles", "sig", "head_sig", "head_n").mapInArrow(starred, "key long, n long, head long, c long, n_shingles long, sig binary, near boolean"), "lots")
        blocks = F.ceil(F.col("n") / bucket)
        own = F.pmod(F.xxhash64("c"), blocks)
        at = F.explode(F.when(F.col("near"), F.array(own)).otherwise(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        spread = lots.select("key", "near", "c", "n_shingles", "sig", own.alias("own"), at.alias("at"))
        spread = spread.select(F.xxhash64("key", "at").alias("g"), F.when(F.col("near"), 0).when(F.col("at") == F.col("own"), 1).otherwise(2).alias("lot"), "c", "n_shingles", "sig")
        links = links.union(lots.where("near AND c != head").select(F.col("head").alias("a"), F.col("c").alias("b"))).union(by_group(spread, tie, "a long, b long"))
    out = cut(links, "survivors")
    forget(buckets, met)
    return out


def near_documents(documents: DataFrame, percent: int = 80, size: int = 5, bands: int = 32, rows: int = 6, miss: float = 1e-6, block: int = 128, bucket: int = 1024, seed: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash, leads: one row for each document.

    ``percent``: two documents are linked if 100 * intersection >= percent * union of their sets. ``leads``: true for
    rows without words or doc_id, and for the rows of the smallest doc_id and then text_hash of a component.
    """
    spark = documents.sparkSession
    tune(spark)
    texts = only(documents, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))

    def signed(batches):
        release()
        signer = Signer(bands * rows, seed)
        for batch in batches:
            n, c, keys, sigs = [], [], [], []
            for s in shingle_sets(batch.column("text"), size):
                n.append(len(s))
                c.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                sig = signer.sign(s) if len(s) else np.zeros(0, np.uint32)
                keys.append(band_keys(sig, bands) if len(s) else np.zeros(0, np.int64))
                sigs.append((sig & np.uint32(0xFF)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["doc_id", "text_hash", "n_shingles", "c", "keys", "sig"])

    docs = cut(texts.mapInArrow(signed, "doc_id long, text_hash long, n_shingles long, c long, keys array<long>, sig binary"), "signatures")
    takes_part = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    alike = docs.where(takes_part).groupBy("c").agg(F.min(F.struct("doc_id", "text_hash")).alias("lead"), *(F.first(x).alias(x) for x in ("n_shingles", "keys", "sig")))
    classes = cut(alike, "classes")
    mine = cut(docs.select("doc_id", "text_hash", "n_shingles", F.when(takes_part, F.col("c")).alias("c")), "documents")
    forget(docs)
    verifier = Verifier(percent, least_matches(bands * rows, bands, percent / 100, miss))

    tied = survivors(classes, verifier, bucket)
    groups = components(tied)
    blocks = cut(groups.groupBy("root").agg(F.ceil(F.count("*") / block).alias("blocks")), "blocks")
    placed = groups.join(blocks, "root").select(F.col("node").alias("c"), "root", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("own"))
    placed = cut(placed.join(classes.select("c", "lead.doc_id", "lead.text_hash", "sig"), "c"), "placed")
    leads = cut(classes.select("c", "lead"), "leads")
    forget(tied, classes)

    def with_sets(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text"), size)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("c", "root", "blocks", "own", "sig")), pa.array([s.tobytes() for s in sets], pa.binary())], ["c", "root", "blocks", "own", "sig", "shingles"])

    wanted = texts.join(placed, ["doc_id", "text_hash"]).dropDuplicates(["c"]).select("c", "root", "blocks", "own", "sig", "text")
    members = cut(wanted.mapInArrow(with_sets, "c long, root long, blocks long, own long, sig binary, shingles binary"), "members")

    def verify(group: pa.Table) -> pa.RecordBatch | None:
        visiting = group.column("visiting").to_numpy()
        if group.num_rows < 2 or visiting.all():
            return None
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        rows_, targets = (np.flatnonzero(visiting), np.flatnonzero(~visiting)) if visiting.any() else (np.arange(len(sets)), None)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        return pairs_of(group.column("c").to_numpy(), verifier.links(signature_rows(group), sizes, group.column("class").to_numpy(), rows_, targets, sets))

    alone = members.select(F.xxhash64("root", "own").alias("g"), "c", F.lit(False).alias("visiting"), F.col("c").alias("class"), "sig", "shingles")
    links = cut(by_group(alone, verify, "a long, b long"), "checked")
    roots = components(links)

    # groups of several blocks: whoever is not in the largest component visits the other blocks
    large = members.where("blocks > 1")
    if not large.isEmpty():
        light = large.select("c", "root").join(roots.select(F.col("node").alias("c"), F.col("root").alias("class")), "c", "left").select("c", "root", F.coalesce("class", "c").alias("class"))
        light = cut(light, "light")
        per = light.groupBy("root", "class").agg(F.count("*").alias("n"))
        main = cut(per.groupBy("root").agg(F.max(F.struct("n", "class")).alias("m")).select("root", F.col("m.class").alias("main")), "main")
        known = light.join(main, "root").select("c", "class", (F.col("class") != F.col("main")).alias("minor"))
        spread = large.join(known, "c").withColumn("at", F.explode(F.when(F.col("minor"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("own"))))
        spread = spread.select(F.xxhash64("root", "at").alias("g"), "c", (F.col("at") != F.col("own")).alias("visiting"), "class", "sig", "shingles")
        more = cut(by_group(spread, verify, "a long, b long"), "checked")
        roots = components(links.union(more))
        forget(light, main, more)

    rooted = leads.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").select("c", "lead", F.coalesce("root", "c").alias("root"))
    first = rooted.groupBy("root").agg(F.min("lead").alias("first"))
    final = cut(rooted.join(first, "root").select("c", "first"), "near-classes")
    forget(links, blocks, placed, members, leads)
    out = mine.join(final, "c", "left").select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"), "text_hash", "first")
    leading = F.col("first").isNull() | (F.col("first") == F.struct("doc_id", "text_hash"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash", leading.alias("leads"))
