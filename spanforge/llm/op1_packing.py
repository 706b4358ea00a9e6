"""Best-fit packing by linear grouping (operator 1).

Documents become token pieces of at most `capacity` tokens.  Packing needs their lengths only, and a length is one of
`capacity` numbers, so the plan is made from a histogram whose size doesn't depend on the corpus:

1. Linear grouping: large lengths, longest first, fall into groups of equal cardinality; each group's lengths round up
   to its longest.
2. The few sizes are packed by configurations (how many pieces of each size share a sequence), optimised by column
   generation with a knapsack for prices; each configuration is used a whole number of times.
3. Actual pieces take the places of their group, all but the smallest place of a configuration; the real room that is
   left is known for every range of sequences.
4. Pieces that are left, the small ones above all, go longest first into the sequence with the least room that fits.

Plans are made with several numbers of groups, and with step 4 alone; the one of fewest sequences counts.

The plan is a table of ranges: ranks [from, to) of a length go to consecutive sequences.  Pieces find theirs by their
rank within their length, counted in salted parts so that no common length gathers in one task.

Defined cases: a null or empty text is one piece with the closing id alone; longer documents than the capacity are cut;
repeated rows are packed like any other; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import partitions, real_id, sort_id, text_slices, utf8, written

CAPACITY = 2048
CLOSING_ID = 0
#: Fixed value: the vocabulary's public word pattern.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SLICE_BYTES = 2_000_000
#: Words that a worker keeps between slices; beyond it the store starts anew, so memory stays bounded.
KEPT_WORDS = 400_000
#: Group counts that plans are made with; the plan of fewest sequences counts.
GROUPS = (32, 64, 128)
#: Pieces longer than this share of the capacity are large.
LARGE = 1 / 3
#: Column generation ends once the relaxed problem is proven this close to its optimum.
GAP = 2e-3


#: The same words for the faster standard module: of ASCII texts, and of texts without numerals beyond decimal digits.
#: Its blanks include four separators that the vocabulary takes for symbols.
ASCII_WORDS = r"[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|(?:[^a-z0-9\s]|[\x1c-\x1f])+"
PLAIN_WORDS = r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|[_\x1c-\x1f])+"


def other_numerals() -> set[str]:
    """Characters that count as numbers but are neither decimal digits nor letters, such as fractions."""
    return {c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isdecimal() and not c.isalpha()}


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, which sees each distinct word of a task once."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.words, self.plain_words, self.ascii_words = regex.compile(WORDS), re.compile(PLAIN_WORDS), re.compile(ASCII_WORDS)
        self.odd, self.bytes = other_numerals(), byte_characters()
        self.kept: dict[str, bytes] = {}
        self.assigned: set[str] = set()

    def unsure(self, text: str) -> bool:
        """Whether the text has a character that this Python's tables don't assign; the library's may."""
        if text.isascii():
            return False
        new = set(text) - self.assigned
        odd = {c for c in new if unicodedata.category(c) == "Cn"}
        self.assigned |= new - odd
        return bool(odd)

    def pieces(self, text: str) -> list[str]:
        if "<|" in text:
            return [w for part in self.split.split(text) for w in ([part] if part in self.specials else self.plain(part))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        # the library lowers each character by itself, so a last capital sigma is no exception
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return (self.plain_words if self.odd.isdisjoint(set(text)) else self.words).findall(text)

    def forget(self) -> None:
        """Leave nothing in a worker that waits for its next task."""
        self.kept.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if self.unsure(t)}
        cut = [[] if i in whole else self.pieces(t) for i, t in enumerate(texts)]
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        # a word is normalised already, so the library's model can take it by itself
        tokenize = self.library.model.tokenize
        for word in set().union(*cut) - self.kept.keys() if cut else ():
            if word in self.specials:
                self.kept[word] = array("I", [self.specials[word]]).tobytes()
            else:
                self.kept[word] = array("I", [t.id for t in tokenize(word.encode().decode("latin-1").translate(self.bytes))]).tobytes()
        return [array("I", self.library.encode(t, add_special_tokens=False).ids).tobytes() if i in whole else b"".join(map(self.kept.__getitem__, words)) for i, (t, words) in enumerate(zip(texts, cut))]


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(_id, piece, start, length, ids_crc32[, ids]): the pieces of every document."""
    names = ["_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    closing = CLOSING_ID.to_bytes(4, "little")

    def run(batches):
        words = tokenizer(vocabulary)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            _, offsets = utf8(texts)
            ids = batch.column(0).to_pylist()
            for a, b in text_slices(offsets, SLICE_BYTES):
                out = []
                for me, raw in zip(ids[a:b], words.encode(texts.slice(a, b - a).to_pylist())):
                    raw += closing
                    for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[at : at + 4 * capacity]
                        out.append((me, i, at // 4, len(own) // 4, zlib.crc32(own), *[own] * keep_ids))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
        words.forget()

    picked = docs.select(sort_id(id_col).alias("_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest configuration: how many of each size within the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    low = int(sizes.min())
    by_size: dict[int, int] = {}
    for i in np.argsort(prices, kind="stable").tolist():  # of equal sizes the dearest stays
        by_size[int(sizes[i])] = i
    index = np.array(list(by_size.values()))
    size, price = sizes[index], prices[index]
    for room in range(low, capacity + 1):
        fits = size <= room
        value = np.where(fits, best[np.maximum(room - size, 0)] + price, -1.0)
        j = int(value.argmax())
        if value[j] > best[room - 1] + 1e-12:
            best[room], choice[room] = value[j], index[j]
        else:
            best[room] = best[room - 1]
    count, room = np.zeros(len(sizes), np.int64), capacity
    while room >= low:
        if choice[room] < 0:
            room -= 1
        else:
            count[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(best[capacity]), count


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1000) -> list[tuple[np.ndarray, int]]:
    """Configurations and whole numbers of uses that cover no more than the demand, near the optimum of the relaxed problem."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(k))
        value, column = knapsack(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + GAP:
            break
        uses, into = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, column.astype(float))
        ratio = np.where(into > 1e-9, np.maximum(uses, 0) / np.where(into > 1e-9, into, 1), np.inf)
        if not np.isfinite(ratio).any():
            break
        basis[:, int(ratio.argmin())] = column
    uses = np.floor(np.maximum(np.linalg.solve(basis, demand.astype(float)), 0) + 1e-7).astype(np.int64)
    left, out = demand.copy(), []
    for config, times in zip(basis.T.astype(np.int64), uses):
        used = config > 0
        times = min(int(times), int((left[used] // config[used]).min()))
        if times > 0:
            left -= config * times
            out.append((config, times))
    return out


def sequences(moves: pd.DataFrame) -> int:
    return int((moves["sequence"] + moves["last"] - moves["first"]).max()) if len(moves) else 0


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> pd.DataFrame:
    """The grouped plan of fewest sequences over several group counts, and step 4 alone where grouping gains nothing.

    Few groups round lengths up by more, many leave more uses to rounding down; which weighs more depends on the lengths.
    A plan is made from the histogram, so its cost doesn't depend on the corpus.
    """
    bound = -(-sum(n * c for n, c in counts.items()) // capacity)
    best = None
    for n, large in [*((g, LARGE) for g in groups), (1, 1.0)]:
        found = grouped_plan(counts, capacity, n, large)
        if best is None or sequences(found) < sequences(best):
            best = found
        if sequences(best) <= bound:
            break
    return best


def grouped_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS[0], large: float = LARGE) -> pd.DataFrame:
    """Ranges (length, first, last, sequence): the piece of that length and rank r in [first, last) goes to sequence + r - first."""
    moves: list[tuple[int, int, int, int]] = []
    top = 0  # sequences so far
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first sequence, how many)
    big = sorted((n for n in counts if n > large * capacity), reverse=True)
    if big:
        ends = np.cumsum([counts[n] for n in big])
        total = int(ends[-1])
        each = -(-total // groups)
        starts = np.arange(0, total, each)
        demand = np.minimum(each, total - starts)
        length_at = np.array(big)
        sizes = length_at[np.searchsorted(ends, starts, side="right")]  # the longest of each group
        at = starts.copy()
        begins = ends - np.array([counts[n] for n in big])
        used: list[tuple[int, int]] = []
        for config, times in configurations(sizes, demand, capacity):
            slots = [g for g in np.flatnonzero(config) for _ in range(config[g])]
            # the smallest place of several stays open for step 4, which knows the real room that rounding left there
            slots = slots[:-1] or slots
            cuts, runs = {0, times}, []
            for g in slots:
                a, z = int(at[g]), int(at[g]) + times
                at[g] = z
                used.append((a, z))
                i = int(np.searchsorted(ends, a, side="right"))
                while a < z:
                    stop = min(z, int(ends[i]))
                    offset = a - (z - times)
                    moves.append((int(length_at[i]), a - int(begins[i]), stop - int(begins[i]), top + offset))
                    runs.append((offset, stop - (z - times), int(length_at[i])))
                    cuts.update((offset, stop - (z - times)))
                    a, i = stop, i + 1
            marks = sorted(cuts)
            fill = np.zeros(len(marks), np.int64)
            place = {m: i for i, m in enumerate(marks)}
            for a, z, n in runs:
                fill[place[a]] += n
                fill[place[z]] -= n
            for a, z, n in zip(marks, marks[1:], np.cumsum(fill).tolist()):
                rooms.setdefault(capacity - n, []).append((top + a, z - a))
            top += times
        rest = left_over(total, used)
    else:
        rest = []
    waiting: dict[int, list[tuple[int, int]]] = {n: [(0, c)] for n, c in counts.items() if n not in set(big)}
    for a, z in rest:
        i = int(np.searchsorted(ends, a, side="right"))
        while a < z:
            stop = min(z, int(ends[i]))
            waiting.setdefault(int(length_at[i]), []).append((a - int(begins[i]), stop - int(begins[i])))
            a, i = stop, i + 1
    for n in sorted(waiting, reverse=True):
        for a, z in waiting[n]:
            while a < z:
                room = min((r for r in rooms if r >= n), default=None)
                if room is None:
                    fresh = -(-(z - a) // (capacity // n))
                    rooms.setdefault(capacity, []).append((top, fresh))
                    top += fresh
                    continue
                first, many = rooms[room].pop()
                now = min(many, z - a)
                if now < many:
                    rooms[room].append((first + now, many - now))
                if not rooms[room]:
                    del rooms[room]
                moves.append((n, a, a + now, first))
                rooms.setdefault(room - n, []).append((first, now))
                a += now
    return pd.DataFrame(moves, columns=["length", "first", "last", "sequence"]).sort_values(["length", "first"], ignore_index=True)


def left_over(total: int, used: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, at = [], 0
    for a, z in sorted(used):
        if a > at:
            out.append((at, a))
        at = max(at, z)
    return out + [(at, total)] * (at < total)


def packed(pieces: DataFrame, capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """The pieces with their sequence_id and offset; pieces must be a written table (it is read more than once)."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(4 * partitions(spark))))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    moves = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity, groups)
    length, first, start = (moves[c].to_numpy(np.int64) for c in ("length", "first", "sequence"))
    keys = (length << 44) + first

    def place(frames):
        for pdf in frames:
            row = np.searchsorted(keys, (pdf["length"].to_numpy() << 44) + pdf["rank"].to_numpy(), side="right") - 1
            pdf["sequence_id"] = start[row] + pdf["rank"].to_numpy() - first[row]
            yield pdf.drop(columns="rank")

    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "before")
    own = Window.partitionBy("length", "salt").orderBy("_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(own)).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    placed = ranked.select(*pieces.columns, "rank").mapInPandas(place, schema + ", sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "_id", "piece", "ids_crc32")
    return placed.withColumn("offset", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def packed_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, [ids,] sequence_id, offset) of all pieces of docs."""
    pieces = written(token_pieces(docs, vocabulary, id_col, text_col, capacity, keep_ids), "token-pieces")
    found = packed(pieces, capacity, groups)
    return found.select(real_id("_id").alias(id_col), *[c for c in found.columns if c != "_id"])
