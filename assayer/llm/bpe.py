"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

For every word a tree holds, per pair of adjacent symbols, rank * width + place; its root is the leftmost pair of the
lowest rank. A merge takes the root, joins two symbols and updates the pairs beside it, each along one path of the
tree, until the root holds no mergeable pair. The trees of many words of like length lie side by side in arrays, so
one step merges once in each of them. Words met before come from a bounded cache.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

SCHEMA = "id string, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Entries and characters of a worker's word cache; when it is full it starts anew, which changes no result.
CACHE_WORDS, CACHE_CHARS = 400_000, 16 << 20
#: Words of more bytes get a tree of their own in plain lists: alone in an array, each merge would cost many array calls.
WIDE = 1024
NONE = np.int64(2**62)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable in Latin-1, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A tokenizer file of the kind "BPE with word ends": normaliser, word pattern and merges are read from it.

    normalise: NFC, runs of white space to one space, lower case by character. Added tokens are cut out of the raw
    text first. The file has no decoder, so decoding joins the tokens with single spaces.
    """

    def __init__(self, path: str, cache: tuple[int, int] = (CACHE_WORDS, CACHE_CHARS)):
        self.most_words, self.most_chars = cache
        data = json.load(open(path, encoding="utf-8"))
        model = data["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens |= {i: t for t, i in self.added.items()}
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        # Unicode white space, as the file's pattern means it
        white = r"\t-\r \x85\xa0  -     　"
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{white}"))
        alphabet = byte_alphabet()
        self.plain = np.array([self.vocab[c] for c in alphabet], np.int64)
        self.ending = np.array([self.vocab[c + self.suffix] for c in alphabet], np.int64)
        self.size = len(self.tokens)
        pairs, to = [], []
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            pairs.append(self.vocab[a] * self.size + self.vocab[b])
            to.append(self.vocab[a + b])
        order = np.argsort(np.array(pairs, np.int64), kind="stable")
        self.pairs, self.rank, self.to = np.array(pairs, np.int64)[order], np.arange(len(pairs), dtype=np.int64)[order], np.array(to, np.int64)
        self.lookup: dict[int, int] | None = None
        self.held = 0
        self.cache: dict[str, tuple[int, str, str]] = {}

    def _keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """rank * width + place of each pair, NONE where it doesn't merge or an end is missing (-1)."""
        pair = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[at] == pair) & (left >= 0) & (right >= 0), self.rank[at] * width + place, NONE)

    def encode_bytes(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, words of like length together."""
        out: list[list[int]] = [[] for _ in words]
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault(max(2, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, members in groups.items():
            if width > WIDE:
                for i in members:
                    out[i] = self._encode_long(words[i], width)
                continue
            step = max(1, (1 << 19) // width)
            for k in range(0, len(members), step):
                self._encode_group(words, members[k : k + step], width, out)
        return out

    def _encode_long(self, word: bytes, width: int) -> list[int]:
        """The same tree and merges as _encode_group, for one word."""
        n, none = len(word), int(NONE)
        symbol = [*self.plain[np.frombuffer(word, np.uint8)].tolist(), *[-1] * (width - n)]
        symbol[n - 1] = int(self.ending[word[-1]])
        follow, before = [*range(1, n), -1], [*range(-1, n - 1)]
        if self.lookup is None:
            self.lookup = dict(zip(self.pairs.tolist(), self.rank.tolist()))
        lookup, size, to = self.lookup, self.size, self.to

        def key(place):
            right = follow[place]
            rank = lookup.get(symbol[place] * size + symbol[right]) if right >= 0 else None
            return none if rank is None else rank * width + place

        tree = [none] * width + [key(i) if i < n else none for i in range(width)]
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(place, value):
            node = place + width
            tree[node] = value
            while node > 1:
                node >>= 1
                best = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == best:
                    break
                tree[node] = best

        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = follow[at]
            follow[at] = beyond = follow[gone]
            symbol[at], symbol[gone] = int(to[rank]), -1
            if beyond >= 0:
                before[beyond] = at
            update(gone, none)
            update(at, key(at))
            if before[at] >= 0:
                update(before[at], key(before[at]))
        return [x for x in symbol if x >= 0]

    def _encode_group(self, words, members, width, out) -> None:
        n = len(members)
        length = np.array([len(words[i]) for i in members])
        raw = np.frombuffer(b"".join(words[i] for i in members), np.uint8)
        row, starts = np.repeat(np.arange(n), length), np.concatenate([[0], np.cumsum(length)[:-1]])
        col = np.arange(len(raw)) - np.repeat(starts, length)
        symbol = np.full((n, width), -1, np.int64)
        symbol[row, col] = self.plain[raw]
        symbol[np.arange(n), length - 1] = self.ending[raw[starts + length - 1]]
        places = np.arange(width)
        follow = np.where(places + 1 < length[:, None], places + 1, -1)  # the next live symbol's place
        before = np.broadcast_to(places - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE, np.int64)
        tree[:, width : 2 * width - 1] = self._keys(symbol[:, :-1], symbol[:, 1:], places[:-1], width)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.nonzero(tree[:, 1] < NONE)[0]

        def update(rows, leaf, keys):
            node = leaf + width
            tree[rows, node] = keys
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        by_rank = np.empty(len(self.rank), np.int64)
        by_rank[: len(self.to)] = self.to
        while len(live):
            root = tree[live, 1]
            at = root % width
            gone = follow[live, at]
            beyond = follow[live, gone]
            symbol[live, at] = by_rank[root // width]
            symbol[live, gone] = -1
            follow[live, at] = beyond
            has = beyond >= 0
            before[live[has], beyond[has]] = at[has]
            update(live, gone, np.full(len(live), NONE))
            right = np.where(has, symbol[live, np.maximum(beyond, 0)], -1)
            update(live, at, self._keys(symbol[live, at], right, at, width))
            left_at = before[live, at]
            some = left_at >= 0
            if some.any():
                rows, la = live[some], left_at[some]
                update(rows, la, self._keys(symbol[rows, la], symbol[rows, at[some]], la, width))
            live = live[tree[live, 1] < NONE]
        kept = symbol >= 0
        flat, ends = symbol[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        begin = 0
        for i, end in zip(members, ends):
            out[i] = flat[begin:end]
            begin = end

    def normalise(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # by character: no final sigma

    def pieces(self, text: str) -> list[str | int]:
        """Words, and ids of added tokens, in order."""
        if self.split_added is None or not self.split_added.search(text):
            return self.words.findall(self.normalise(text))
        out: list[str | int] = []
        at = 0
        for m in self.split_added.finditer(text):
            out += self.words.findall(self.normalise(text[at : m.start()]))
            out.append(self.added[m[0]])
            at = m.end()
        return out + self.words.findall(self.normalise(text[at:]))

    def learn(self, docs: list[list[str | int]]) -> None:
        """Put every word of docs into the cache: number of ids, ids spelled out, tokens joined."""
        if len(self.cache) > self.most_words or self.held > self.most_chars:
            self.cache.clear()
            self.held = 0
        new = list({w for d in docs for w in d if w not in self.cache})
        ids = self.encode_bytes([w.encode() if isinstance(w, str) else b"!" for w in new])
        for w, x in zip(new, ids):
            x = [w] if isinstance(w, int) else x
            self.cache[w] = (len(x), " ".join(map(str, x)), self.decode(x))
            self.held += len(w) if isinstance(w, str) else 1

    def decode(self, ids) -> str:
        return " ".join(self.tokens[i] for i in ids)

    def encode(self, text: str) -> list[int]:
        docs = [self.pieces(text)]
        self.learn(docs)
        return [int(x) for w in docs[0] for x in self.cache[w][1].split(" ")]


def bpe_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", cache: tuple[int, int] = (CACHE_WORDS, CACHE_CHARS)) -> DataFrame:
    """One row per input row: id, number of tokens, SHA-256 of the ids and of the decoded text.

    tokenizer: the file's path, on every executor; cache: words and characters that a worker keeps. Null texts count as empty (no tokens); repeated rows are each
    encoded; null ids stay null; other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or WordBpe(tokenizer, cache)
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                split = [bpe.pieces(t) for t in part.column(1).to_pylist()]
                bpe.learn(split)
                known = bpe.cache
                n, ids, decoded = [], [], []
                for words in split:
                    found = [known[w] for w in words]
                    n.append(sum(f[0] for f in found))
                    ids.append(hashlib.sha256(" ".join([f[1] for f in found]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(" ".join([f[2] for f in found]).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA.replace("id string", f"id {kind}", 1)).withColumnRenamed("id", id_col)


def bpe_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (array of int) and decoded text; the operator's real output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for batch in batches:
            bpe = bpe or WordBpe(tokenizer)
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                split = [bpe.pieces(t) for t in part.column(1).to_pylist()]
                bpe.learn(split)
                ids = [[int(x) for w in words for x in bpe.cache[w][1].split(" ")] for words in split]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(bpe.decode, ids)), pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
