"""Byte-level BPE with word ends, read from a tokenizer file: encoding in arrays, and decoding.

Words are encoded together, one a column of a matrix, sorted by length. Each place holds a part and, as one number, the
rank of the pair it begins and its own row, so the smallest number of a column tells which pair merges next. A merged
pair's right place is skipped by links to the places before and after, until no column has a pair left. Ranks are found by
hash. A word above `SHORT` bytes uses a heap over linked parts instead, as scanning would be quadratic there.

Texts are cut at white space first, equal pieces become one, and so do the words that the pieces are cut into. Each distinct
word is encoded once, and the ids of pieces and texts are copied from there in arrays.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import let_go

#: longest word in bytes whose ranks are scanned
SHORT = 64
#: pieces of texts whose words a Python worker keeps encoded at a time
CACHED = 500_000
#: bytes of text that a Python worker encodes together, so that what it holds stays small whatever the texts are
PORTION = 2_000_000
#: rows of ids handled together
ROWS = 1_000
#: words merged together, whose matrices stay in the processor's cache
COLUMNS = 2_048

# fixed values: the pre-tokenizer's pattern, and the characters beyond ASCII that count as white space in it
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_END = "</w>"
MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[]^_`{|}~")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible Latin-1, else the next from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols, spare = {b: chr(b) for b in visible}, 256
    for b in range(256):
        if b not in symbols:
            symbols[b], spare = chr(spare), spare + 1
    return [symbols[b] for b in range(256)]


def runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run, one run after the other."""
    ends = np.cumsum(count)
    out = np.repeat(first - ends + count, count)
    out += np.arange(len(out))
    return out


def portions(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches where another ``most`` bytes of text are passed."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = (np.flatnonzero(np.diff(size // most)) + 1).tolist()
        for low, high in zip([0, *cuts], [*cuts, b.num_rows]):
            yield b.slice(low, high - low)


class Bpe:
    """A vocabulary with its merges. Not thread-safe: one per Python worker."""

    def __init__(self, path: str, short: int = SHORT, cached: int = CACHED):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + WORD_END] for s in symbols], np.int32)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        self.merged = pairs[:, 2].astype(np.int32)
        self.rank_of = dict(zip((pairs[:, 0] << 32 | pairs[:, 1]).tolist(), range(len(pairs))))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max(max(vocab.values()), *self.special.values(), 0) + 1
        self.tokens = [b""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token.encode()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.short, self.cached = short, cached
        self.bits = max(short - 1, 1).bit_length()  # of a row, below the rank
        self.hash_pairs()

    def hash_pairs(self) -> None:
        """Pairs by hash: a slot holds the first of its pairs; the others, few, are sorted, and their slots are marked."""
        kind = np.int32 if (len(self.merged) + 1) << self.bits < 1 << 31 else np.int64
        self.none = kind(np.iinfo(kind).max)
        keys = np.array(list(self.rank_of), np.int64)
        rank = np.array(list(self.rank_of.values()), kind) << self.bits
        self.shift = np.uint64(64 - max(12, (4 * len(keys)).bit_length()))
        slots = 1 << (64 - int(self.shift))
        self.slot_key, self.slot_rank, self.crowded = np.full(slots, -1, np.int64), np.full(slots, self.none), np.zeros(slots, bool)
        at, first = np.unique(self.slot(keys), return_index=True)
        self.slot_key[at], self.slot_rank[at] = keys[first], rank[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        self.crowded[self.slot(keys[rest])] = True
        rest = rest[np.argsort(keys[rest])]
        self.rest_key, self.rest_rank = np.append(keys[rest], 1 << 62), np.append(rank[rest], self.none)
        bytes_ = np.arange(256)
        left, right = np.repeat(self.inner, 256), np.tile(bytes_, 256)
        self.of_bytes = np.concatenate([self.ranks(left, self.inner[right]), self.ranks(left, self.final[right])])  # then those that end a word

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, leaving room for a row below, or the largest number."""
        key = left.astype(np.int64) << 32 | right
        slot = self.slot(key)
        same = self.slot_key[slot] == key
        out = np.where(same, self.slot_rank[slot], self.none)
        unsure = np.flatnonzero(self.crowded[slot] & ~same)
        if len(unsure):
            at = np.searchsorted(self.rest_key, key[unsure])
            out[unsure] = np.where(self.rest_key[at] == key[unsure], self.rest_rank[at], self.none)
        return out

    def merge_columns(self, raw: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words given as columns of bytes: their ids one after the other, and how many each has."""
        height, n = raw.shape
        nothing, column, row = self.size, np.arange(n), np.arange(height)[:, None]
        # the row below the last stands for no place: its part is in no pair
        part = np.full((height + 1, n), nothing, np.int32)
        part[:-1] = np.where(row < length, self.inner[raw], nothing)
        part[length - 1, column] = self.final[raw[length - 1, column]]
        least = np.full((height + 1, n), self.none)
        pair = (raw[:-1].astype(np.int32) << 8 | raw[1:]) + ((row[:-1] == length - 2) << 16)
        least[:-2] = np.where(row[:-1] < length - 1, self.of_bytes[pair] | row[:-1], self.none)
        after, before = np.empty((height + 1, n), np.int32), np.empty((height + 1, n), np.int32)
        after[:] = np.arange(1, height + 2)[:, None]
        after[length - 1, column] = height
        before[:] = np.arange(-1, height)[:, None]
        before[0] = height
        ids, least_, after, before = part.ravel(), least.ravel(), after.ravel(), before.ravel()
        while True:
            best = least[:-1].min(axis=0)
            column = np.flatnonzero(best != self.none)
            if not len(column):
                break
            best = best[column]
            at = best & ((1 << self.bits) - 1)
            left = at * n + column
            right = after[left] * n + column
            new = self.merged[best >> self.bits]
            follows = after[right]
            ids[left], ids[right], least_[right], after[left] = new, nothing, self.none, follows
            next_ = follows * n + column
            before[next_] = at
            leads = before[left]
            last = leads * n + column
            rank = self.ranks(np.concatenate([ids[last], new]), np.concatenate([new, ids[next_]]))
            least_[last] = rank[:len(column)] | leads
            least_[left] = rank[len(column):] | at
        part = part[:-1].T
        there = part != nothing
        return part[there], there.sum(axis=1)

    def merge_long(self, raw: bytes) -> np.ndarray:
        """Ids of one long word: the same merges in the same order, by a heap of (rank, place)."""
        b = np.frombuffer(raw, np.uint8)
        part = self.inner[b].tolist()
        part[-1] = int(self.final[b[-1]])
        n, rank_of, merged = len(part), self.rank_of, self.merged
        after, before, heap = [*range(1, n), -1], [*range(-1, n - 1)], []

        def look(i):
            j = after[i]
            if j >= 0 and (r := rank_of.get(part[i] << 32 | part[j])) is not None:
                heapq.heappush(heap, (r, i))

        for i in range(n):
            look(i)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if part[i] < 0 or j < 0 or rank_of.get(part[i] << 32 | part[j]) != r:
                continue  # one of the two has merged meanwhile
            part[i], part[j] = int(merged[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return np.array([p for p in part if p >= 0], np.int32)

    def merge_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (large_string) one after the other, and how many each has."""
        first = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        first, length = first[:-1], np.diff(first)
        order = np.argsort(length, kind="stable")
        done, count = [], np.zeros(len(words), np.int64)
        brief = order[:np.searchsorted(length[order], self.short, "right")]
        for low in range(0, len(brief), COLUMNS):
            own = brief[low:low + COLUMNS]
            rows = np.arange(length[own[-1]])[:, None]
            ids, count[own] = self.merge_columns(data[np.minimum(first[own] + rows, len(data) - 1)], length[own])
            done.append((own, ids))
        for k in order[len(brief):].tolist():
            ids = self.merge_long(data[first[k]:first[k] + length[k]].tobytes())
            count[k] = len(ids)
            done.append((np.array([k]), ids))
        out, begins = np.empty(int(count.sum()), "<u4"), np.cumsum(count) - count
        for own, ids in done:
            out[runs(begins[own], count[own])] = ids
        return out, count

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Each distinct word's ids as little-endian unsigned 32-bit integers."""
        ids, count = self.merge_words(pa.array(words, pa.large_string()))
        ends = np.cumsum(count)
        return {w: ids[a:b].tobytes() for w, a, b in zip(words, (ends - count).tolist(), ends.tolist())}

    def plain(self, text: str) -> str:
        """The text as its words are read: composed, in small letters, and with no white space but ASCII's."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # lower() would make a last Σ a final sigma
        for c in WIDE_SPACES:
            if c in text:
                text = text.replace(c, " ")
        return text

    def cut_pieces(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words of pieces (large_string), one piece after the other as `order` names them, and how many each has."""
        plain = pc.ascii_is_alpha(pieces).to_numpy(zero_copy_only=False)  # letters only: one word
        rest, words, sizes = np.flatnonzero(~plain), [], []
        for p in pieces.take(pa.array(rest)).to_numpy(zero_copy_only=False).tolist():
            if p.isalpha():
                words.append(p)
                sizes.append(1)
            elif p and p[-1] in MARKS and p[:-1].isalpha():
                words += (p[:-1], p[-1])
                sizes.append(2)
            else:
                own = self.words.findall(p)
                words += own
                sizes.append(len(own))
        single = np.flatnonzero(plain)
        return (pa.concat_arrays([pieces.take(pa.array(single)), pa.array(words, pa.large_string())]), np.concatenate([single, rest]),
                np.concatenate([np.ones(len(single), np.int64), np.array(sizes, np.int64)]))

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other, and how many each has."""
        met = pieces.dictionary_encode()
        words, order, sizes = self.cut_pieces(met.dictionary)
        words = words.dictionary_encode()
        ids, count = self.merge_words(words.dictionary)
        word = words.indices.to_numpy()
        begins, upto = (np.cumsum(count) - count)[word], np.concatenate([[0], np.cumsum(count[word])])
        ids = ids[runs(begins, count[word])]  # now of the distinct pieces, in `order`
        ends = upto[np.cumsum(sizes)]
        first, many = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        many[order] = np.diff(ends, prepend=0)
        first[order] = ends - many[order]
        at = met.indices.to_numpy()
        return ids[runs(first[at], many[at])], many[at]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of texts, one text after the other, and where each ends; null counts as empty. Some texts at a time."""
        parts, ends, special = [], [], []
        for t in texts:
            t = t or ""
            if self.cut and "<|" in t:
                for k, x in enumerate(self.cut.split(t)):
                    if k % 2:
                        special.append((len(parts), self.special[x]))
                    parts.append("" if k % 2 else self.plain(x))
            else:
                parts.append(self.plain(t))
            ends.append(len(parts))
        pieces = pc.ascii_split_whitespace(pa.array(parts, pa.large_string()))
        bounds, special = pieces.offsets.to_numpy(), np.array(special, np.int64).reshape(-1, 2)
        ends = np.array([0, *ends])
        low = 0
        while low < len(texts):  # at least one text, and more up to the number of pieces held
            high = max(low + 1, int(np.searchsorted(bounds[ends], bounds[ends[low]] + self.cached, "right")) - 1)
            a, b = ends[low], ends[high]
            ids, count = self.encode_pieces(pieces.values.slice(bounds[a], bounds[b] - bounds[a]))
            upto = np.concatenate([[0], np.cumsum(count)])[bounds[a:b + 1] - bounds[a]]
            own = special[(special[:, 0] >= a) & (special[:, 0] < b)]
            if len(own):
                ids = np.insert(ids, upto[own[:, 0] - a], own[:, 1])
                upto[1:] += np.cumsum(np.bincount(own[:, 0] - a, minlength=b - a))
            yield ids, upto[ends[low + 1:high + 1] - a]
            low = high

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null counts as empty."""
        out = []
        for ids, ends in self.encode(texts):
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of the ids: the tokens with a space between, as the file names no decoder; special ones too."""
        tokens = self.tokens
        return b" ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """The vocabulary of a file, read once in each Python worker."""
    bpe = Bpe(path)
    let_go()  # what building took
    return bpe


def encode_decode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_tokens, ids_sha256 and decoded_sha256 of the whole text.

    Null and empty texts have no tokens and decode to the empty text; repeated rows give repeated results, a null doc_id
    stays null. Other columns are not read. An empty table gives an empty result.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in portions(batches):
            ids = bpe.encode_batch(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
