"""Operator 10, BPE encoding and decoding: a backtracking encoder and an offset-table decoder.

An Aho-Corasick automaton of the vocabulary's tokens, spelled backwards, runs once over a pre-token from its
end, one step a letter: what it says at a place is the longest token that starts there. Tokens are then
found from left to right; one is taken if it and the one before it are compatible, that is if merging their
joined symbols by rank gives just these two. Where a token does not fit, its next shorter one is tried; where
none fits, the place is marked as dead and the last token gives way to its next shorter one. Each place is
tried once, so the work is linear in the text, and the result is the one that rank-ordered merging gives.
Decoding gathers token texts through a table of offsets.

Null text counts as empty: no ids, and the empty string decoded. Pre-tokens of any length are whole. Rows are
encoded each by itself, repeated ones too; extra columns stay behind; an empty table gives no rows. (A vocabulary
that lacks a byte merges pre-tokens with that byte plainly, which takes time quadratic in their length.)
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import only, tune

END = "\0"
MIX = np.int64(-7046029254386353131)  # an odd multiplier that spreads keys over a table
#: The vocabulary file's pre-token pattern and end mark.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"
#: str.split() also splits at these four, the tokenizer does not.
NOT_SPACE = re.compile("[\x1c-\x1f]")
CHUNK = re.compile("(?:\\S|[\x1c-\x1f])+")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BpeCoder:
    """Encoder and decoder over one vocabulary file; caches are bounded."""

    def __init__(self, path: str, cache: int = 350_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)  # for its normaliser and pre-tokeniser only
        vocab = {self._mark(s): i for s, i in spec["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_ids = {s: np.array([i], "<u4").tobytes() for s, i in special.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.size, self.chunks, self.older, self.words = cache, {}, {}, {}
        # rank: base symbols first, then products in the order of the merges
        self.rank = {i: -1 for i in vocab.values()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for n, (a, b) in enumerate(spec["model"]["merges"]):
            pair, made = (vocab[self._mark(a)], vocab[self._mark(b)]), vocab[self._mark(a + b)]
            self.joined[pair] = made
            if made not in self.parts:
                self.parts[made], self.rank[made] = pair, n
        self.base = {s: i for s, i in vocab.items() if self.rank[i] < 0}
        self.fits: dict[tuple[int, int], bool] = {}
        self.length, self.shorter = [0] * (max(vocab.values()) + 1), [-1] * (max(vocab.values()) + 1)
        # a token that its own text is not merged into never occurs
        whole = {s: i for s, i in vocab.items() if i not in self.parts or self._meet(*self.parts[i], True)}
        for s in whole:
            self.length[whole[s]], self.shorter[whole[s]] = len(s), self._best(s[:-1], whole)
        self._tables(whole)
        # decoding: every token's bytes, each with the blank that parts tokens, and where they start
        texts = {i: s.replace(END, WORD_END) for s, i in vocab.items()} | {i: s for s, i in special.items()}
        blobs = [(texts.get(i, "") + " ").encode() for i in range(max(texts) + 1)]
        self.lengths = np.array([len(b) for b in blobs], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)

    @staticmethod
    def _best(text: str, whole: dict[str, int]) -> int:
        return next((whole[text[:k]] for k in range(len(text), 0, -1) if text[:k] in whole), -1)

    @staticmethod
    def _mark(symbol: str) -> str:
        return symbol[: -len(WORD_END)] + END if symbol.endswith(WORD_END) else symbol

    def _meet(self, a: int, b: int, made: bool) -> bool:
        """Take both tokens apart along their seam, the later merge first.

        A merge across the seam of lower rank than the step just undone would have come first
        (at equal rank the one further left), so the two don't fit. ``made``: the merge of the two
        themselves is wanted and not held against them.
        """
        rank, undone, right = self.rank, float("inf"), True
        while True:
            across = None if made else self.joined.get((a, b))
            if across is not None and (rank[across] < undone or right and rank[across] == undone):
                return False
            made = False
            if rank[a] < 0 and rank[b] < 0:
                return True
            right = rank[a] <= rank[b]
            if right:
                undone, b = rank[b], self.parts[b][0]
            else:
                undone, a = rank[a], self.parts[a][1]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves these two tokens as they are where they meet: a memoised table."""
        fit = self.fits.get((left, right))
        if fit is None:
            if len(self.fits) > 300_000:
                self.fits.clear()
            fit = self.fits[left, right] = self._meet(left, right, False)
        return fit

    def _tables(self, whole: dict[str, int]) -> None:
        """The automaton of tokens spelled backwards: a full table of steps, failure links followed in advance.

        ``step[node, letter]`` is the next node, ``says[node]`` the longest token that the letters read last spell
        backwards, -1 if none. Letters of no token lead to the root.
        """
        self.letter = {c: n for n, c in enumerate(sorted({c for s in whole for c in s}), 1)}
        back = {s[::-1]: i for s, i in whole.items()}
        nodes = {"": 0}
        for s in sorted({r[:k] for r in back for k in range(1, len(r) + 1)}, key=len):
            nodes[s] = len(nodes)
        n = len(nodes)
        depth = np.fromiter(map(len, nodes), np.int64, n)
        parent = np.fromiter((nodes[s[:-1]] for s in nodes), np.int64, n)
        by = np.fromiter((self.letter[s[-1]] if s else 0 for s in nodes), np.int64, n)
        self.says = np.fromiter((back.get(s, -1) for s in nodes), np.int32, n)
        self.step = np.zeros((n, len(self.letter) + 1), np.uint32)
        cuts = np.searchsorted(depth, np.arange(depth[-1] + 2)).tolist()
        self.step[0, by[cuts[1] : cuts[2]]] = np.arange(cuts[1], cuts[2])
        fail = np.zeros(n, np.int64)
        for d in range(1, len(cuts) - 1):
            own = np.arange(cuts[d], cuts[d + 1])
            if d > 1:
                fail[own] = self.step[fail[parent[own]], by[own]]
            self.step[own] = self.step[fail[own]]
            silent = own[self.says[own] < 0]
            self.says[silent] = self.says[fail[silent]]
            if d + 2 < len(cuts):
                deeper = np.arange(cuts[d + 1], cuts[d + 2])
                self.step[parent[deeper], by[deeper]] = deeper
        self.steps, self.said, self.wide = memoryview(self.step).cast("B").cast("I"), self.says.tolist(), self.step.shape[1]
        self.length_of, self.shorter_of = np.array(self.length, np.int32), np.array(self.shorter, np.int32)
        self.pair_key = np.full(1 << 20, -1, np.int64)
        self.pair_fit = np.zeros(1 << 20, bool)

    def word(self, text: str) -> bytes:
        """The ids of one pre-token in byte letters, as little-endian unsigned 32-bit integers."""
        text += END
        n, steps, said, wide, code = len(text), self.steps, self.said, self.wide, self.letter.get
        best, node = array("i", bytes(4 * n)), 0
        for k in range(n - 1, -1, -1):
            node = steps[node * wide + code(text[k], 0)]
            best[k] = said[node]
        fits, length, shorter = self.fits, self.length, self.shorter
        at, last, chosen, dead, token = 0, -1, array("I"), set(), best[0]
        while True:
            while token >= 0:  # a place is reached by one sequence only, so what failed stays failed
                end = at + length[token]
                if end not in dead:
                    if last < 0:
                        break
                    fit = fits.get((last, token))
                    if self.compatible(last, token) if fit is None else fit:
                        break
                token = shorter[token]
            if token >= 0:
                chosen.append(token)
                if end == n:
                    return chosen.tobytes()
                at, last = end, token
                token = best[at]
            elif not chosen:
                return self._by_rank(text)
            else:
                dead.add(at)
                token = chosen.pop()
                at -= length[token]
                last = chosen[-1] if chosen else -1
                token = shorter[token]

    def _fit_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pair compatibility by a table of fixed size; a pair that another one has displaced is worked out anew."""
        key = left.astype(np.int64) << 32 | right
        slot = (key * MIX >> 44) & 0xFFFFF
        fit, unknown = self.pair_fit[slot], np.flatnonzero(self.pair_key[slot] != key)
        if len(unknown):
            new, back = np.unique(key[unknown], return_inverse=True)
            fits = np.array([self._meet(int(k) >> 32, int(k) & 0xFFFFFFFF, False) for k in new])
            fit[unknown] = fits[back]
            slot = (new * MIX >> 44) & 0xFFFFF
            self.pair_key[slot] = new
            self.pair_fit[slot] = fits
            clash = self.pair_key[slot] != new  # two new pairs of one slot: the last stays
            self.pair_key[slot[clash]] = -1
        return fit

    def many(self, words: list[str]) -> list[bytes]:
        """What ``word`` gives, for many short words stepped side by side."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        n, wide = len(words), int(size.max())
        codes = np.frombuffer((END.join(words) + END).encode("utf-32-le"), np.uint32)
        lut = np.zeros(int(codes.max()) + 1, np.int32)
        for c, k in self.letter.items():
            if ord(c) < len(lut):
                lut[ord(c)] = k
        # longest token at each place: the automaton steps all words backwards side by side
        flat, ends = lut[codes], np.cumsum(size)
        base = ends - size
        best = np.empty(len(flat), np.int32)
        longer = np.argsort(-size, kind="stable")
        upto = np.searchsorted(-size[longer], -np.arange(wide), "left")  # words with more letters than steps done
        node = np.zeros(n, np.uint32)
        for step in range(wide):
            live = longer[: upto[step]]
            at = ends[live] - 1 - step
            node[: len(live)] = self.step[node[: len(live)], flat[at]]
            best[at] = self.says[node[: len(live)]]
        # backtracking: one try of one token for every unfinished word in each round
        chosen, depth = np.full((n, wide + 1), -1, np.int32), np.zeros(n, np.int64)
        dead = np.zeros(len(flat) + 1, bool)
        live, at, last = np.arange(n), base.copy(), np.full(n, -1, np.int32)
        token = best[at]
        lost = np.zeros(n, bool)
        while len(live):
            end = at + self.length_of[token]
            fine = token >= 0
            fine &= (end == ends[live]) | ~dead[np.minimum(end, len(flat))]
            check = np.flatnonzero(fine & (last >= 0))
            fine[check] = self._fit_all(last[check], token[check])
            go, back, again = np.flatnonzero(fine), np.flatnonzero(~fine & (token < 0)), np.flatnonzero(~fine & (token >= 0))
            token[again] = self.shorter_of[token[again]]
            w = live[go]
            chosen[w, depth[w]] = token[go]
            depth[w] += 1
            last[go], at[go] = token[go], end[go]
            on = end[go] < ends[w]
            token[go[on]] = best[at[go[on]]]
            w = live[back]
            dead[at[back]] = True
            lost[w[depth[w] == 0]] = True
            depth[w] = np.maximum(depth[w] - 1, 0)
            token[back] = chosen[w, depth[w]]
            at[back] -= np.where(lost[w], 0, self.length_of[token[back]])
            last[back] = np.where(depth[w] > 0, chosen[w, np.maximum(depth[w] - 1, 0)], -1)
            token[back] = np.where(lost[w], -1, self.shorter_of[token[back]])
            keep = ~lost[live]
            keep[go[~on]] = False
            live, at, last, token = live[keep], at[keep], last[keep], token[keep]
        raw = np.ascontiguousarray(chosen[np.arange(wide + 1)[None] < depth[:, None]], "<u4").tobytes()
        cuts = np.concatenate([[0], np.cumsum(depth * 4)]).tolist()
        return [self._by_rank(words[k] + END) if bad else raw[a:b] for k, (a, b, bad) in enumerate(zip(cuts, cuts[1:], lost.tolist()))]

    def _by_rank(self, text: str) -> bytes:
        """Plain merging, for a vocabulary without some byte: symbols that it lacks are left out."""
        symbols = [*text[:-2], text[-2:]]
        ids = [i for s in symbols if (i := self.base.get(s)) is not None]
        while True:
            best = min(((self.rank[m], k) for k, p in enumerate(zip(ids, ids[1:])) if (m := self.joined.get(p)) is not None), default=None)
            if best is None:
                return np.array(ids, "<u4").tobytes()
            k = best[1]
            ids[k : k + 2] = [self.joined[ids[k], ids[k + 1]]]

    def pretokens(self, chunk: str) -> list[str]:
        """Pre-tokens of a stretch without special tokens, normalised, in byte letters."""
        if not chunk.isascii():
            if max(chunk) >= "\u0300":  # there character classes differ between Unicode versions
                chunk = self.tokenizer.normalizer.normalize_str(chunk)
                return [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chunk)]
            chunk = unicodedata.normalize("NFC", chunk)
        chunk = chunk.lower()
        if chunk.isalpha():
            found = [chunk]
        elif chunk[:-1].isalpha() and chunk[-1] in ",.;:!?":
            found = [chunk[:-1], chunk[-1]]
        else:
            found = PRETOKEN.findall(chunk)
        if chunk.isascii():
            return found if chunk.isprintable() else [w.translate(self.letters) for w in found]
        return [w.encode().decode("latin-1").translate(self.letters) for w in found]

    def _learn(self, chunks: list[str]) -> None:
        """Fill the caches with the ids of the given stretches."""
        split = {c: self._split(c) for c in chunks}
        new = list({w for parts in split.values() for w in parts if type(w) is str and w not in self.words})
        side_by_side = len(new) >= 500  # else stepping them together costs more than it saves
        self.words.update((w, self.word(w)) for w in new if len(w) > 64 or not side_by_side)
        short = [w for w in new if len(w) <= 64] if side_by_side else []
        for k in range(0, len(short), 50_000):
            part = short[k : k + 50_000]
            self.words.update(zip(part, self.many(part)))
        words = self.words
        self.chunks.update((c, b"".join([w if type(w) is bytes else words[w] for w in parts])) for c, parts in split.items())

    def _split(self, chunk: str) -> list:
        """Pre-tokens of a stretch without white space; of a special token, its ids."""
        if self.special is not None and "<" in chunk and self.special.search(chunk):
            return [x for s in self.special.split(chunk) if s for x in ([self.special_ids[s]] if s in self.special_ids else self.pretokens(s))]
        return self.pretokens(chunk)

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """Split texts at white space, with all stretches' ids in the cache."""
        split = [CHUNK.findall(t) if NOT_SPACE.search(t) else t.split() for t in texts]
        new = [c for c in set().union(*split) if c not in self.chunks]
        if new:
            if len(self.chunks) + len(new) > self.size:  # the older half goes, what is still in use comes back
                self.older, self.chunks = self.chunks, {}
                new = list(set().union(*split))
            self.chunks.update((c, self.older[c]) for c in new if c in self.older)
            if len(self.words) > self.size:
                self.words.clear()
            self._learn([c for c in new if c not in self.chunks])
        return split

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text as little-endian unsigned 32-bit integers."""
        split = self.prepare(texts)
        known = self.chunks.__getitem__
        return [b"".join(map(known, chunks)) for chunks in split]

    def shrink(self) -> None:
        """Between tasks only the younger half of the stretches stays."""
        self.older = {}
        self.words.clear()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The ids' texts, parted by blanks, in UTF-8."""
        if not len(ids):
            return b""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.repeat(self.offsets[ids] - (ends - n), n)
        at += np.arange(ends[-1])
        return self.blob[at[:-1]].tobytes()


@lru_cache(maxsize=1)
def coder(path: str, cache: int = 350_000) -> BpeCoder:
    """One coder per Python worker."""
    return BpeCoder(path, cache)


def bpe_digests(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode every text; per document the number of ids and both digests.

    ``vocabulary``: path of the vocabulary file, the same on every executor. No shuffle.
    """
    tune(documents.sparkSession)

    def run(batches):
        c = coder(vocabulary)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for raw in c.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                digest = hashlib.sha256()
                ids = np.frombuffer(raw, "<u4")
                for k in range(0, len(ids), 1 << 18):  # pieces bound the memory; a blank parts them
                    digest.update((b" " if k else b"") + c.decode(ids[k : k + (1 << 18)]))
                text_sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.shrink()

    return only(documents, doc_id="long", text="string").mapInArrow(run, SCHEMA)
