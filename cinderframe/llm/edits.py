"""Operator 8, token counts: edit-aware counting.

Each document is a balanced tree over stretches of its text, cut where white space ends, so that no
pre-token spans two of them. Leaves keep their text and token count, inner nodes the sums of characters and
tokens below. An edit walks down by character offset, replaces the touched leaves and one leaf of context at
either side, re-encodes only these, and updates the sums on the way up; other leaves' counts stay.

Documents and their edits are dealt by doc_id and met in order of ``seq``, one document in memory at a
time, however many edits it has. Offsets count characters of the text as the edits before left it; those
beyond its end are taken as its end, a null insertion as empty, a negative or null length as 0.
A null text is empty; edits of an unknown document are left out, and so are rows and edits without doc_id; of
repeated doc_ids the smallest text counts, once; repeated edits are all done, those of one seq by start, length and
insertion. Extra columns stay behind. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BpeCoder, coder
from .common import only, tune

#: White space for the tokenizer: without the four controls that Python also counts.
CUT = re.compile("[^\\S\x1c-\x1f](?=\\S)")
BLANK = re.compile("[^\\S\x1c-\x1f]")
SCHEMA = "doc_id long, n_edits long, tokens_before long, tokens_after long, chars_after long, chars_encoded long, text_crc32 long"


class Node:
    __slots__ = ("chars", "tokens", "left", "right", "text")

    def __init__(self, text: str | None = None, tokens: int = 0, left: Node | None = None, right: Node | None = None):
        self.text, self.left, self.right = text, left, right
        if text is None:
            self.total()
        else:
            self.chars, self.tokens = len(text), tokens

    def total(self) -> None:
        self.chars = self.left.chars + self.right.chars
        self.tokens = self.left.tokens + self.right.tokens


class CountedText:
    """A text that knows its number of tokens under edits."""

    def __init__(self, text: str, encoder: BpeCoder, leaf: int = 256):
        self.encoder, self.leaf, self.encoded = encoder, leaf, 0
        self.root = self._build(text)
        self.encoded = 0  # counts edits only

    def _stretches(self, text: str) -> list[str]:
        """Stretches of about ``leaf`` characters that end with white space; longer if there is none."""
        out, at = [], 0
        while len(text) - at > self.leaf:
            m = CUT.search(text, at + self.leaf)
            if not m:
                break
            out.append(text[at : m.end()])
            at = m.end()
        return [*out, text[at:]]

    def _build(self, text: str) -> Node:
        parts = self._stretches(text)
        self.encoded += len(text)
        nodes = [Node(p, len(ids) // 4) for p, ids in zip(parts, self.encoder.encode_all(parts))]
        while len(nodes) > 1:
            nodes = [Node(left=nodes[k], right=nodes[k + 1]) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
        return nodes[0]

    @property
    def tokens(self) -> int:
        return self.root.tokens

    def text(self) -> str:
        out, todo = [], [self.root]
        while todo:
            n = todo.pop()
            if n.text is None:
                todo += [n.right, n.left]
            else:
                out.append(n.text)
        return "".join(out)

    def edit(self, start: int, length: int, insertion: str) -> None:
        size = self.root.chars
        start = min(max(start, 0), size)
        stop = min(start + max(length, 0), size)
        before, touched, after = self._split(self.root, start, stop)
        at = start - sum(n.chars for n in before)
        text = "".join(n.text for n in touched)
        middle = text[:at] + insertion + text[at + stop - start :]
        # context: a neighbour is taken in unless white space parts it from what has changed
        while before and not (BLANK.match(middle[:1]) or self._ends_blank(before[-1])):
            before, last = self._pop(before, -1)
            middle = last + middle
        while after and not BLANK.match(middle[-1:]):
            after, first = self._pop(after, 0)
            middle += first
        self.root = self._join([*before, self._build(middle), *after] if middle or not (before or after) else [*before, *after])

    @staticmethod
    def _ends_blank(node: Node) -> bool:
        while node.text is None:
            node = node.right
        return bool(BLANK.match(node.text[-1:]))

    def _pop(self, nodes: list[Node], end: int) -> tuple[list[Node], str]:
        """Take the outermost leaf's text off a row of subtrees."""
        nodes = nodes[:]
        n = nodes.pop(end)
        while n.text is None:
            if end:
                nodes.append(n.left)
                n = n.right
            else:
                nodes.insert(0, n.right)
                n = n.left
        return nodes, n.text

    def _split(self, root: Node, start: int, stop: int) -> tuple[list[Node], list[Node], list[Node]]:
        """Subtrees before the stretch, leaves that it touches (one at least), subtrees after it."""
        before, touched, after, todo = [], [], [], [(root, 0)]
        while todo:
            n, at = todo.pop()
            end = at + n.chars
            if end < start or end == start and end < root.chars and stop > start:
                before.append(n)
            elif at > stop or at == stop and touched:
                after.append(n)
            elif n.text is not None:
                touched.append(n)
            else:
                todo += [(n.right, at + n.left.chars), (n.left, at)]
        return before, touched, after

    def _join(self, nodes: list[Node]) -> Node:
        """One tree over a row of subtrees: neighbours of the smallest sum first, which keeps it shallow."""
        nodes = nodes[:]
        while len(nodes) > 1:
            k = min(range(len(nodes) - 1), key=lambda x: nodes[x].chars + nodes[x + 1].chars)
            nodes[k : k + 2] = [Node(left=nodes[k], right=nodes[k + 1])]
        return nodes[0]


def count_edits(documents: DataFrame, edits: DataFrame, vocabulary: str) -> DataFrame:
    """Token counts of each document before and after its edits (doc_id, seq, start, length, insertion)."""
    tune(documents.sparkSession)
    texts = only(documents, doc_id="long", text="string").where("doc_id IS NOT NULL")
    texts = texts.select("doc_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.coalesce("text", F.lit("")).alias("text"))
    steps = only(edits, doc_id="long", seq="long", start="long", length="long", insertion="string")
    steps = steps.select("doc_id", F.lit(1).alias("kind"), "seq", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("insertion", F.lit("")).alias("text"))

    def run(batches):
        c, held, rows = coder(vocabulary, 150_000), None, []

        def done():
            doc, tree, first, n = held
            rows.append((doc, n, first, tree.tokens, tree.root.chars, tree.encoded, zlib.crc32(tree.text().encode())))

        def flush():
            arrays = [pa.array(x, pa.int64()) for x in zip(*rows)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_edits", "tokens_before", "tokens_after", "chars_after", "chars_encoded", "text_crc32"])

        for batch in batches:
            c.prepare(batch.column("text").to_pylist())
            for doc, kind, start, length, text in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "kind", "start", "length", "text"))):
                if kind == 0:
                    if held is not None and held[0] == doc:
                        continue
                    if held is not None:
                        done()
                    tree = CountedText(text, c)
                    held = [doc, tree, tree.tokens, 0]
                elif held is not None and held[0] == doc:
                    held[1].edit(start, length, text)
                    held[3] += 1
            if len(rows) >= 2000:
                yield flush()
        if held is not None:
            done()
        c.shrink()
        if rows:
            yield flush()

    order = ["doc_id", "kind", "seq", "start", "length", "text"]
    return texts.union(steps).repartition("doc_id").sortWithinPartitions(*order).mapInArrow(run, SCHEMA)


def made_edits(documents: DataFrame) -> DataFrame:
    """Three edits for every document, from its own length: an insertion, a deletion and a replacement."""
    docs = only(documents, doc_id="long", text="string").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.length(F.coalesce("text", F.lit("")))).cast("long").alias("n"))
    steps = F.array(
        F.struct(F.lit(1).alias("seq"), F.expr("n div 2").alias("start"), F.lit(0).alias("length"), F.lit(" as amended ").alias("insertion")),
        F.struct(F.lit(2).alias("seq"), F.expr("n div 3").alias("start"), F.lit(40).alias("length"), F.lit("").alias("insertion")),
        F.struct(F.lit(3).alias("seq"), F.expr("greatest(n - 20, 0)").alias("start"), F.lit(10).alias("length"), F.lit("re-worded").alias("insertion")),
    )
    return docs.select("doc_id", F.explode(steps).alias("e")).select("doc_id", "e.*")
