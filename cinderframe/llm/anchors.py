"""Operator 7, substring dedup: difference-cover anchors.

Two equal windows of w words start at places i and j of their documents. With a difference cover of a
period v, some shift below v takes both i and j to cover places, so anchors of w - v + 1 words, hashed at
cover places only, meet for every pair of equal windows. Anchors found in one document only rule out
their windows; what is left is extended to full windows around the shared anchors, which are hashed
and matched in turn. A window is a repeat if its words also start in a document of smaller doc_id.

Anchors meet by 40 bits and their bucket's, as they only preselect; windows by 96 bits, so that none of 10^13 is
likely to be taken for another. Both matchings send packed hashes, bucketed by the hash. A batch first settles what its own documents
share, so a passage in a third of all documents sends one entry a batch, and no pairs are made.

Words of repeated windows go, whole texts are judged, on the input. A null text has no words; texts
shorter than a window lose none. Copies lose all they share with the smallest doc_id; rows that share one
doc_id count as one document to each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, only, release, tasks, tune, unused
from .wordhash import batch_words, grams, mix

#: Periods and difference covers, every residue being a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
#: Bits of an anchor's hash that are kept; anchors only preselect.
ANCHOR = np.uint64((1 << 40) - 1)
#: Makes a second hash of a window from the same words.
MORE = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of a bucket's input, at most about: more input gives more buckets.
BUCKET = 32 << 20


def places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every word of a batch its document's number and its place there."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    return doc, np.arange(len(doc)) - np.repeat(at[:-1], n)


def anchor_places(at: np.ndarray, window: int, period: int) -> np.ndarray:
    """Word numbers at which anchors start, in documents that have a window."""
    doc, place = places(at)
    size = np.diff(at)[doc]
    cover = np.zeros(period, bool)
    cover[list(COVERS[period])] = True
    return np.flatnonzero(cover[place % period] & (place + (window - period + 1) <= size) & (size >= window))


def new_hash(h: np.ndarray, more: np.ndarray | None) -> np.ndarray:
    """Whether each of the sorted hashes differs from the one before."""
    new = h[1:] != h[:-1]
    if more is not None:
        new |= more[1:] != more[:-1]
    return np.concatenate([[True], new])[: len(h)]


def packed(hashes: np.ndarray, docs: np.ndarray, ids: np.ndarray, buckets: int, more: np.ndarray | None = None) -> pa.RecordBatch | None:
    """Rows of one batch, a bucket each, of hashes by document; and what the batch settles by itself.

    ``more``: 32 further bits of every hash, of windows; then only documents above the smallest that has the hash are
    answered, else all if there are two. kind 0 asks the bucket, kind 1 is settled.
    """
    if not len(hashes):
        return None
    smaller = more is not None
    order = np.lexsort((ids[docs], more, hashes) if smaller else (ids[docs], hashes))
    h, d, x = hashes[order], ids[docs[order]], more[order] if smaller else None
    keep = new_hash(h, x)
    keep[1:] |= d[1:] != d[:-1]
    h, d, x = h[keep], d[keep], x[keep] if smaller else None
    first = new_hash(h, x)
    several = ~first | np.concatenate([~first[1:], [False]])
    settled = ~first if smaller else several
    parts = []
    for kind, pick in ((0, first), (1, settled)):
        if pick.any():
            # the bucket is a part of the hash of its own; what is settled goes straight to the document's place
            bucket = (h[pick] >> np.uint64(42)) % np.uint64(buckets) if not kind else owner(d[pick], buckets)
            parts.append(packets(bucket.astype(np.int64), kind, h[pick], d[pick], 8 if smaller else 5, x[pick] if smaller and not kind else None))
    return pa.concat_tables(parts).combine_chunks().to_batches()[0]


def owner(docs: np.ndarray, buckets: int) -> np.ndarray:
    """Where a document's answers meet: half as many places as buckets, as only shared hashes go there.

    Every bucket sends each place at most one row, so their product bounds the rows, whatever the groups' sizes."""
    return mix(docs.astype(np.uint64)) % np.uint64(max(1, buckets // 2))


def packets(bucket: np.ndarray, kind: int, h: np.ndarray, d: np.ndarray, width: int, more: np.ndarray | None = None) -> pa.Table:
    """One row a bucket: its documents, how many hashes each has, and the hashes' lowest ``width`` bytes, ``more`` after them."""
    order = np.lexsort((d, bucket))
    h, d, bucket = h[order], d[order], bucket[order]
    raw = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :width])
    if more is not None:
        raw = np.concatenate([raw, np.ascontiguousarray(more[order]).view(np.uint8).reshape(-1, 4)], 1)
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]).tolist() if len(bucket) else [0]
    docs, counts, hashes = [], [], []
    for a, b in zip(cuts, cuts[1:]):
        own, n = np.unique(d[a:b], return_counts=True)
        docs.append(own.tobytes())
        counts.append(n.astype(np.int32).tobytes())
        hashes.append(raw[a:b].tobytes())
    at = bucket[cuts[:-1]] if len(bucket) else bucket
    return pa.table({"bucket": pa.array(at, pa.int64()), "kind": pa.array(np.full(len(at), kind), pa.int32()), "docs": pa.array(docs, pa.binary()), "counts": pa.array(counts, pa.binary()), "hashes": pa.array(hashes, pa.binary())})


PACKED = "bucket long, kind int, docs binary, counts binary, hashes binary"


def answered(rows: DataFrame, smaller: bool, buckets: int) -> DataFrame:
    """(doc_id, hashes), a row a document: its hashes that others share.

    Buckets of hashes find them; their answers travel packed to buckets of documents, which put each together.
    """
    width = 8 if smaller else 5
    parts = max(tasks(rows.sparkSession), buckets // 2)

    def unpack(table: pa.Table, more: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        docs = np.frombuffer(b"".join(table.column("docs").to_pylist()), np.int64)
        n = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int32)
        raw = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint8).reshape(-1, width + more)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :width] = raw[:, :width]
        return wide.view(np.uint64).ravel(), np.repeat(docs, n), np.ascontiguousarray(raw[:, width:]).view(np.uint32).ravel() if more else None

    def match(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        passed = table.filter(pa.array(kind == 1)).select(["bucket", "kind", "docs", "counts", "hashes"])
        h, d, x = unpack(table.filter(pa.array(kind == 0)), 4 if smaller else 0)
        order = np.lexsort((d, x, h) if smaller else (d, h))
        h, d, x = h[order], d[order], x[order] if smaller else None
        first = new_hash(h, x)
        if smaller:
            told = d > d[np.flatnonzero(first)][np.cumsum(first) - 1] if len(h) else first
        else:
            told = np.concatenate([~first[1:], [False]])[: len(h)] | ~first
        return pa.concat_tables([passed, packets(owner(d[told], buckets).astype(np.int64), 1, h[told], d[told], width)])

    def gather(table: pa.Table) -> pa.Table:
        h, d, _ = unpack(table)
        order = np.argsort(d, kind="stable")
        own, n = np.unique(d, return_counts=True)
        raw = np.ascontiguousarray(h[order].view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
        cuts = (np.concatenate([[0], np.cumsum(n)]) * width).tolist()
        return pa.table({"doc_id": pa.array(own, pa.int64()), "hashes": pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())})

    return rows.repartition(parts, "bucket").groupBy("bucket").applyInArrow(match, PACKED).repartition(parts, "bucket").groupBy("bucket").applyInArrow(gather, "doc_id long, hashes binary")


def known(batch: pa.RecordBatch, column: str, width: int) -> list[np.ndarray]:
    out = []
    for raw in batch.column(column).to_pylist():
        raw = np.frombuffer(raw or b"", np.uint8).reshape(-1, width)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :width] = raw
        out.append(np.unique(wide.view(np.uint64).ravel()))
    return out


def among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def repeats(documents: DataFrame, window: int = 13, period: int = 7) -> DataFrame:
    """(doc_id, hashes): for each document the hashes of its repeated windows."""
    spark = documents.sparkSession
    texts = only(documents, doc_id="long", text="string").where("doc_id IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * tasks(spark), -(-size // BUCKET))
    length = window - period + 1

    def anchored(batches):
        release()
        for batch in batches:
            words, at = batch_words(batch.column("text"))
            start = anchor_places(at, window, period)
            if len(start):
                h = grams(words, length)[start]
                # bucket and kept bits come from different ends of the hash
                rows = packed(h & ~(np.uint64(3) << np.uint64(40)), places(at)[0][start], batch.column("doc_id").to_numpy(), buckets)
                if rows is not None:
                    yield rows

    shared = cut(answered(texts.mapInArrow(anchored, PACKED), False, buckets), "shared-anchors")

    def extended(batches):
        for batch in batches:
            words, at = batch_words(batch.column("text"))
            start = anchor_places(at, window, period)
            if not len(start):
                continue
            doc, place = places(at)
            h = grams(words, length)[start] & ANCHOR
            hit = np.zeros(len(words) + 1, np.int64)
            cuts = np.searchsorted(start, at).tolist()
            for k, own in enumerate(known(batch, "hashes", 5)):
                a, b = cuts[k], cuts[k + 1]
                hit[start[a:b][among(h[a:b], own)]] = 1
            total = np.concatenate([[0], np.cumsum(hit)])
            m = len(words) - window + 1
            i = np.flatnonzero(total[period : m + period] > total[:m]) if m > 0 else np.zeros(0, np.int64)
            i = i[place[i] + window <= np.diff(at)[doc[i]]]
            more = (grams(words ^ MORE, window)[i] >> np.uint64(32)).astype(np.uint32)
            rows = packed(grams(words, window)[i], doc[i], batch.column("doc_id").to_numpy(), buckets, more)
            if rows is not None:
                yield rows

    near = texts.join(shared, "doc_id")
    told = cut(answered(near.mapInArrow(extended, PACKED), True, buckets), "repeated-windows")
    forget(shared)
    return told


def kept_words(text: str, gone: np.ndarray) -> bytes:
    """The text's words without those marked, joined by one space."""
    words = np.array(text.encode().split(), object)
    return b" ".join(words[~gone].tolist())


def remove_repeats(documents: DataFrame, window: int = 13, period: int = 7, digest: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256; or (``digest`` false) the documents' own columns, the
    text without repeated windows' words and n_chars to match. A text that loses nothing stays as it is."""
    tune(documents.sparkSession)
    told = repeats(documents, window, period)
    rows = only(documents, doc_id="long", text="string") if digest else documents
    names, kinds = rows.columns, rows.schema
    key, own_column = unused("_key", names), unused("_told", names)
    joined = rows.withColumn(key, F.col("doc_id").cast("long")).join(told.select(F.col("doc_id").alias(key), F.col("hashes").alias(own_column)), key, "left").drop(key)

    def strip(batches):
        for batch in batches:
            texts = batch.column("text")
            words, at = batch_words(texts)
            h = grams(words, window)
            removed, out = [], []
            for k, (text, own) in enumerate(zip(texts.to_pylist(), known(batch, own_column, 8))):
                n = int(at[k + 1] - at[k])
                gone = np.zeros(n, bool)
                if len(own) and n >= window:
                    step = np.zeros(n + 1, np.int64)
                    i = np.flatnonzero(among(h[at[k] : at[k + 1] - window + 1], own))
                    np.add.at(step, i, 1)
                    np.add.at(step, i + window, -1)
                    gone = np.cumsum(step)[:n] > 0
                removed.append(int(gone.sum()))
                if digest:
                    out.append(hashlib.sha256(kept_words(text or "", gone)).hexdigest())
                else:
                    out.append(kept_words(text or "", gone).decode() if removed[-1] else text)
            if digest:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    if digest:
        return joined.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    kept = joined.mapInArrow(strip, kinds)
    return kept.withColumn("n_chars", F.length("text").cast(kinds["n_chars"].dataType)) if "n_chars" in names else kept
