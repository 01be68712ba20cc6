"""Byte-level BPE encoding and decoding with a contiguous rank array.

A text is cut at special tokens, then into words by the vocabulary's pattern. A short word is held as
one array of parts and one of the ranks of adjacent pairs: the least rank is found by a scan, its boundary
deleted, and the ranks of the two neighbours refreshed. The new words of some hundred texts are the rows of
common arrays and take each step together. A long word, where repeated scans would be quadratic, takes the
same merges from a heap over linked boundaries. Each worker remembers the ids of words it has met, in a bounded
table."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern by which this family of byte-level vocabularies cuts words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers of Unicode versions after 16, which vocabularies of this family do not know as such.
LATE = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6
187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E
2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
SHORT = 64       # bytes; beyond, the heap form
WIDTHS = [4, 8, 12, 16, 24, 32, 48, SHORT]  # short words up to each share one array
REMEMBER = 1 << 16  # words that a worker remembers, besides those of the chunk at hand
REMEMBER_LEN = 64   # longer words are not remembered
CHUNK = 1 << 18     # characters whose new words are encoded together, about
NONE = np.iinfo(np.int32).max  # the rank of a pair that is no merge
_STEP = np.uint64(0x9E3779B97F4A7C15)
SEEN_BITS = 20      # of the hash by which most pairs that are no merge are told


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself where it is printable Latin-1,
    else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def near_pattern() -> tuple[re.Pattern, re.Pattern]:
    """(texts of code points below U+0250, PATTERN with its classes spelt out for them): the standard
    library's engine cuts those several times faster and at the same places."""
    kind = {c: unicodedata.category(chr(c))[0] for c in range(0x250)}
    spell = lambda cs: "".join(re.escape(chr(c)) for c in cs)
    letters, numbers = spell(c for c, k in kind.items() if k == "L"), spell(c for c, k in kind.items() if k == "N")
    space = r"\t-\r \x85\xa0"
    return re.compile("[\x00-\u024f]*"), re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


def late_pattern() -> tuple[re.Pattern, regex.Pattern]:
    """(a character of LATE, PATTERN with those as neither letters nor numbers)."""
    late = "".join("-".join(chr(int(c, 16)) for c in r.split("-")) for r in LATE.split())
    letters, numbers, other = rf"[\p{{L}}--[{late}]]", rf"[\p{{N}}--[{late}]]", rf"[[^\s\p{{L}}\p{{N}}]||[{late}]]"
    return re.compile(f"[{late}]"), regex.compile(
        PATTERN.replace(r"[^\s\p{L}\p{N}]", other).replace(r"\p{L}+", letters + "+").replace(r"\p{N}+", numbers + "+"), regex.V1)


#: Between two characters that are no white space, a space always begins a word.
SURE_CUT = re.compile(r"(?<=\S) (?=\S)")


class Vocabulary:
    """Merges and ids of a byte-level BPE vocabulary file (JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        ids = {as_bytes(k): v for k, v in spec["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        self.pad = 1 + max(ids.values())  # what fills the rows of shorter words; in no pair
        #: pair of ids as one number -> rank; rank -> id of the merged part
        self.rank = {self.pair(ids[a], ids[b]): k for k, (a, b) in enumerate(pairs)}
        self.merged = [ids[a + b] for a, b in pairs]
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        # the same as arrays; a last pair that never comes ends the sorted ones
        keys, ranks = np.fromiter(self.rank, np.int64), np.fromiter(self.rank.values(), np.int32)
        at = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.append(keys[at], np.iinfo(np.int64).max), np.append(ranks[at], NONE)
        self.seen = np.zeros(1 << SEEN_BITS, bool)
        self.seen[self.slot(keys)] = True
        self.merged_array, self.byte_array = np.array(self.merged, np.int32), np.array(self.byte_id, np.int32)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {v: k for k, v in ids.items()} | {v: k.encode() for k, v in self.special.items()}
        self.digits = {k: str(k) for k in self.bytes_of}
        self.words, (self.near, self.near_words) = regex.compile(PATTERN), near_pattern()
        self.late, self.late_words = late_pattern()
        names = sorted(self.special, key=len, reverse=True)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.mark = re.compile("|".join(map(re.escape, names)) if names else "(?!)")
        self.known: dict[str, bytes] = {}  # word -> its ids, 4 bytes each

    def pair(self, a, b):
        return a * (self.pad + 1) + b

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _STEP) >> np.uint64(64 - SEEN_BITS)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids."""
        keys, out = self.pair(a.astype(np.int64), b), np.full(len(a), NONE, np.int32)
        maybe = np.flatnonzero(self.seen[self.slot(keys)])
        at = np.searchsorted(self.pair_keys, keys[maybe])
        hit = self.pair_keys[at] == keys[maybe]
        out[maybe[hit]] = self.pair_ranks[at[hit]]
        return out

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Contiguous arrays, a row for a word: parts[w, i] is the id between two boundaries, ranks[w, i] that of the pair
        (i, i + 1). Each step takes every row's least rank, the leftmost on ties; rows without one are done."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        inside = np.arange(lens.max()) < lens[:, None]
        parts = np.full(inside.shape, self.pad, np.int32)
        parts[inside] = self.byte_array[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self.ranks_of(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(words), -1)
        out, index = [b""] * len(words), np.arange(len(words))

        def done(rows: np.ndarray, found: np.ndarray):
            some = found != self.pad
            flat, ends = found[some].tobytes(), 4 * np.cumsum(some.sum(1))
            start = 0
            for w, end in zip(rows.tolist(), ends.tolist()):
                out[w] = flat[start:end]
                start = end
        while ranks.shape[1] and len(index):
            best = ranks.argmin(1)
            least = ranks[np.arange(len(best)), best]
            if not (on := least != NONE).all():
                done(index[~on], parts[~on])
                index, parts, ranks, best, least = index[on], parts[on], ranks[on], best[on], least[on]
            row, (n, width) = np.arange(len(index)), parts.shape
            parts[row, best] = self.merged_array[least]
            keep = np.ones((n, width), bool)
            keep[row, best + 1] = False
            parts = parts[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[row, best] = False
            ranks = ranks[keep].reshape(n, width - 2)
            for left in (best - 1, best):
                r = np.flatnonzero((left >= 0) & (left < width - 2))
                i = left[r]
                ranks[r, i] = self.ranks_of(parts[r, i], parts[r, i + 1])
        done(index, parts)
        return out

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges, least rank first and leftmost on ties, from a heap: O(n log n)."""
        pair, rank, n = self.pair, self.rank, len(parts)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get(pair(parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j] = self.merged[best], False
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get(pair(parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (r := rank.get(pair(parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p, on in zip(parts, alive) if on]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, 4 bytes each."""
        raw = [w.encode("utf-8", "replace") for w in words]
        kind = np.searchsorted(WIDTHS, np.fromiter(map(len, raw), np.int64, len(raw)))
        out = [b""] * len(raw)
        for k in np.unique(kind).tolist():
            at = np.flatnonzero(kind == k).tolist()
            some = [raw[w] for w in at]
            ids = self.merge_short(some) if k < len(WIDTHS) else [
                np.array(self.merge_long([self.byte_id[b] for b in w]), np.int32).tobytes() for w in some]
            for w, found in zip(at, ids):
                out[w] = found
        return out

    def cut(self, text: str) -> list[str]:
        if self.near.fullmatch(text):
            return self.near_words.findall(text)
        return (self.late_words if self.late.search(text) else self.words).findall(text)

    def pieces(self, text: str):
        """The text cut at special tokens: strings, and the ids of special tokens."""
        for piece in self.cuts.split(text) if self.cuts and self.mark.search(text) else [text]:
            yield self.special.get(piece, piece)

    def cut_pieces(self, text: str) -> Iterator[list[str] | bytes]:
        """The words of the text, in lists of about CHUNK characters, and the ids of special tokens."""
        for piece in self.pieces(text):
            if isinstance(piece, int):
                yield np.array([piece], np.int32).tobytes()
                continue
            start = 0
            while len(piece) - start > CHUNK and (sure := SURE_CUT.search(piece, start + CHUNK)):
                yield self.cut(piece[start:sure.start()])
                start = sure.start()
            yield self.cut(piece[start:])

    def looked_up(self, lists: list[list[str] | bytes | None]) -> Iterator[bytes | None]:
        """The ids of each list of words; what is no list as it is. New words are encoded together."""
        known, new = self.known, set()
        if len(known) >= REMEMBER:
            for old in list(islice(known, len(known) - REMEMBER // 2)):  # those met first; common words come back at once
                del known[old]
        for words in lists:
            if isinstance(words, list):
                new.update(words)
        fresh = list(new.difference(known))
        known.update(zip(fresh, self.encode_words(fresh)))
        for words in lists:
            yield b"".join(map(known.__getitem__, words)) if isinstance(words, list) else words
        for word in fresh:
            if len(word) > REMEMBER_LEN:
                del known[word]

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text, in order."""
        waiting, held, ids = [], 0, []

        def ended():
            for found in self.looked_up(waiting):
                if found is None:  # the end of a text
                    yield np.frombuffer(b"".join(ids), np.int32).tolist()
                    ids.clear()
                else:
                    ids.append(found)
            waiting.clear()
        for text in texts:
            for words in self.cut_pieces(text):
                waiting.append(words)
                held += sum(map(len, words)) if isinstance(words, list) else 1
                if held >= CHUNK:
                    yield from ended()
                    held = 0
            waiting.append(None)
            held += 1
        yield from ended()

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def encode_digits(self, text: str) -> str:
        """The decimal ids of a text, joined by commas."""
        return self.joined(self.encode(text))

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self.digits.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Bytes of the parts; sequences that are not UTF-8 become U+FFFD; ids without a part are skipped."""
        try:
            found = b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError:
            found = b"".join([self.bytes_of.get(i, b"") for i in ids])
        return found.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process."""
    return Vocabulary(path)


def encode_texts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, ids array<int>, decoded string: each whole text encoded, and decoded from its ids.

    A null or empty text has no ids and decodes to the empty string. Each row is encoded on its own:
    repeated rows stay, no rows give no rows, other columns are not read. ``vocab_path`` must be
    readable on every executor."""
    def run(batches):
        vocab = vocabulary(vocab_path)
        for b in batches:
            for start in range(0, b.num_rows, 64):
                part = b.slice(start, 64)
                ids = list(vocab.encode_all(t or "" for t in part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())),
                     pa.array([vocab.decode(i) for i in ids], pa.string())], ["id", "ids", "decoded"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, n_tokens, ids_sha256, decoded_sha256: ``encode_texts`` reduced to digests where the ids
    are made, so that ids and decoded texts do not travel. Same treatment of nulls, repeats and no rows."""
    def sha(s: str) -> str:
        return hashlib.sha256(s.encode("utf-8")).hexdigest()

    def run(batches):
        vocab = vocabulary(vocab_path)
        for b in batches:
            n, one, two = [], [], []
            for ids in vocab.encode_all(text.as_py() or "" for text in b.column(1)):
                n.append(len(ids))
                one.append(sha(vocab.joined(ids)))
                two.append(sha(vocab.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return (rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("id", id_col))
