"""Byte-level BPE by prefix-sharing trie traversal (operator 10).

Texts are cut into words by the public pattern of the vocabulary.  The distinct words of a slice of rows form a trie,
visited depth first in sorted order.  Each node carries one state: the last token of the encoding of its prefix.  A
token t can end a prefix exactly when the state len(t) bytes above and t stay apart under the merges, and just one t
does; so a child's state follows from the states above it, and a prefix that many words share is encoded once.  The
ids of a word are read back along the states from its end.

Defined cases: null and empty texts have no ids and decode to the empty text; the vocabulary's special strings inside
a text become their ids, as in the library; words of any length are encoded whole; rows repeat as they are.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, utf8

#: Fixed value: the vocabulary's public word pattern.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE_BYTES = 2_000_000
#: Words that a worker keeps encoded between slices; beyond it the store starts anew, so memory stays bounded.
KEPT_WORDS = 300_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class TrieEncoder:
    def __init__(self, path: str):
        spec = json.load(open(path))
        symbols = byte_symbols()
        raw = lambda token: bytes(symbols[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in symbols for c in t)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in vocab.items()} | {i: s.encode() for s, i in self.specials.items()}
        self.size = {i: len(t) for t, i in vocab.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            a, b = vocab[raw(a)], vocab[raw(b)]
            t = vocab[self.text_of[a] + self.text_of[b]]
            self.merged[a, b] = r
            if t not in self.halves:
                self.halves[t], self.rank[t] = (a, b), r
        # tokens by their bytes from the last to the first: node -> {byte: node}, and the token that ends at a node
        self.back: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, i in vocab.items():
            node = 0
            for byte in reversed(token):
                if byte not in self.back[node]:
                    self.back.append({})
                    self.token_at.append(-1)
                    self.back[node][byte] = len(self.back) - 1
                node = self.back[node][byte]
            self.token_at[node] = i
        self.apart: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.words = regex.compile(WORDS)

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges leave left and right as they are when they stand side by side.

        Undo the latest merge next to the border again and again; the two would have joined if, at some time, the
        tokens at the border had a merge that comes before the merge undone last (or is the same one, to its left).
        """
        x, y, before = left, right, len(self.merged)
        while True:
            if self.merged.get((x, y), before) < before:
                return False
            rx, ry = self.rank.get(x, -1), self.rank.get(y, -1)
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                x, before = self.halves[x][1], rx
            else:
                y, before = self.halves[y][0], ry + 1

    def stands_alone(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        if token not in self.alone:
            parts = [self.lone(b) for b in self.text_of[token]]
            while len(parts) > 1:
                r, i = min((self.merged.get(p, len(self.merged)), i) for i, p in enumerate(zip(parts, parts[1:])))
                if r == len(self.merged):
                    break
                parts[i : i + 2] = [self.token_of((parts[i], parts[i + 1]))]
            self.alone[token] = parts == [token]
        return self.alone[token]

    def lone(self, byte: int) -> int:
        return self.token_at[self.back[0][byte]]

    def token_of(self, pair: tuple[int, int]) -> int:
        node = 0
        for byte in reversed(self.text_of[pair[0]] + self.text_of[pair[1]]):
            node = self.back[node][byte]
        return self.token_at[node]

    def learn(self, words: list[str]) -> None:
        """Encode distinct words, given in sorted order, by one depth-first visit of their trie."""
        back, token_at, size, apart = self.back, self.token_at, self.size, self.apart
        state: list[int] = [-1]  # of each prefix of the current branch
        branch = b""
        for text in words:
            word = text.encode()
            same, most = 0, min(len(word), len(branch))
            while same < most and word[same] == branch[same]:
                same += 1
            del state[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                node, at, found = 0, end - 1, []
                while at >= 0:
                    node = back[node].get(word[at], -1)
                    if node < 0:
                        break
                    if token_at[node] >= 0:
                        found.append(token_at[node])
                    at -= 1
                for token in reversed(found):
                    above = state[end - size[token]]
                    if above < 0:
                        if self.stands_alone(token):
                            break
                        continue
                    pair = above, token
                    ok = apart.get(pair)
                    if ok is None:
                        if len(apart) > 1_000_000:
                            apart.clear()
                        ok = apart[pair] = self.stay_apart(above, token)
                    if ok:
                        break
                state.append(token)
            branch = word
            ids, end = [], len(word)
            while end:
                ids.append(state[end])
                end -= size[state[end]]
            self.kept[text] = struct.pack(f"<{len(ids)}I", *reversed(ids))

    def forget(self) -> None:
        """Leave nothing but the vocabulary in a worker that waits for its next task."""
        self.kept.clear()
        self.apart.clear()

    def pieces(self, text: str) -> list[str]:
        """Words and special strings of a text in order."""
        if self.split is None or not any(s in text for s in self.specials):
            return self.words.findall(text)
        return [w for part in self.split.split(text) for w in ([part] if part in self.specials else self.words.findall(part))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        seen = set().union(*cut) if cut else set()
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        for s, i in self.specials.items():
            self.kept[s] = struct.pack("<I", i)
        self.learn(sorted(seen - self.kept.keys()))
        return [b"".join(map(self.kept.__getitem__, words)) for words in cut]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.text_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): the encoding as packed little-endian unsigned 32-bit ids, and the text that they decode to.

    vocabulary is the path of the vocabulary file on every executor.
    """
    kind = docs.schema[id_col].dataType

    def run(batches):
        bpe = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            _, offsets = utf8(texts)
            for a, b in text_slices(offsets, SLICE_BYTES):
                ids = bpe.encode(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], ["id", "ids", "decoded"])
        bpe.forget()

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {kind.simpleString()}, ids binary, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(
        id_col,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
