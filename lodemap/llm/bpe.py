"""BPE encoding and decoding with a contiguous rank array.

A word is kept as one short array of part ids and one of the ranks of adjacent
pairs.  The encoder scans the ranks for the minimum (leftmost on a tie), merges
that pair, deletes the boundary and refreshes the two neighbouring ranks, until
no adjacent pair has a rank.  For the few words of more than ``LONG`` bytes the
same order of merges comes from a heap, so that one huge word stays cheap.

Texts are encoded in Arrow batches where they lie: no shuffle, nothing is sent
to the driver, and a lost task only repeats its own batch.  Null text counts as
empty.  Repeated rows and repeated ids each give their own row; columns other
than the two named ones are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import slices

#: Word splitting of byte-level BPE vocabularies of the GPT-2 kind (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of more bytes than this take the heap.
LONG = 200
#: A worker forgets its words beyond this number, so that its memory is bounded.
CACHE_WORDS = 50_000
#: Up to this code point all Unicode versions agree on what is a letter, a number or a space.
STABLE = "[^\x00-՗]"
NONE = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


class BytePairs:
    """Ranks, ids and bytes of a byte-level vocabulary in a ``tokenizer.json`` file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = (
                bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
            )
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for text, i in self.special.items():
            self.bytes_of.extend([b""] * (i + 1 - len(self.bytes_of)))
            self.bytes_of[i] = text.encode()
        self.byte_id = [0] * 256
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        self.size = len(self.bytes_of)
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for n, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left] * self.size + vocab[right]] = n
            self.merged.append(vocab[left + right])
        self.text_of = [str(i) for i in range(self.size)]
        self.words = regex.compile(PATTERN)
        self.unstable = re.compile(STABLE)
        self.splits = (
            re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
            if self.special
            else None
        )
        self.cache: dict[str, tuple[int, ...]] = {}
        self.path = path
        self.library = None

    def split(self, text: str) -> list[str]:
        """Words of a text. Above the stable code points the reference library's own Unicode tables decide."""
        if self.unstable.search(text) is None:
            return self.words.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[b:e] for _, (b, e) in self.library.pre_tokenize_str(text)]

    def word(self, word: bytes) -> list[int]:
        if len(word) > LONG:
            return self._long(word)
        size, rank, merged = self.size, self.rank, self.merged
        parts = [self.byte_id[b] for b in word]
        ranks = [rank.get(a * size + b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            parts[i] = merged[best]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] * size + parts[i + 1], NONE)
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] * size + parts[i], NONE)
        return parts

    def _long(self, word: bytes) -> list[int]:
        """The same merges for one long word: a heap of (rank, position) over linked parts."""
        size, rank, merged = self.size, self.rank, self.merged
        parts = [self.byte_id[b] for b in word]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(parts[i] * size + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or rank.get(parts[i] * size + parts[j]) != r:
                continue
            parts[i], parts[j] = merged[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := rank.get(parts[i] * size + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank.get(parts[before[i]] * size + parts[i])) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        pieces = self.splits.split(text) if self.splits else [text]
        for n, piece in enumerate(pieces):
            if n % 2:
                ids.append(self.special[piece])
                continue
            for w in self.split(piece):
                got = cache.get(w)
                if got is None:
                    got = tuple(self.word(w.encode()))
                    if len(w) <= 64:
                        cache[w] = got
                ids += got
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, BytePairs] = {}


def vocabulary(path: str) -> BytePairs:
    """One vocabulary (and word cache) per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = BytePairs(path)
    return _loaded[path]


def encode_decode(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns (id_col, n_tokens long, ids array<int> if ``with_ids``, decoded
    string if ``with_ids``, ids_sha256, decoded_sha256), a row for each row of
    ``docs``.  ``vocabulary_path`` must be readable on the executors.
    """
    kind = dict(docs.dtypes)[id_col]
    more = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = vocabulary(vocabulary_path)
        for batch in slices(batches):
            counts, id_hash, text_hash, all_ids, texts = [], [], [], [], []
            for value in batch.column(1):
                ids = pairs.encode(value.as_py() or "")
                decoded = pairs.decode(ids)
                counts.append(len(ids))
                id_hash.append(hashlib.sha256(",".join(map(pairs.text_of.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    texts.append(decoded)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}"
    )
