"""Token ids of whole texts with a public tokenizer file.

``encode`` of a text equals the ids of its white-space separated chunks in order, for tokenizers that
drop white space (as word-end BPE does). Chunks are cut at ASCII white space only; what else a tokenizer
takes for white space stays inside a chunk and is left to it. Chunks repeat far more often than texts: a
piece of a batch looks each of its distinct chunks up once and gathers the ids with numpy, and each Python
worker keeps the ids of the chunks it met last in a bounded cache.

A piece holds about ``PIECE_BYTES`` of text, or a single longer text; memory is about eight times that.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_WORDS = 150_000  # words after which the cache's generation ends, in each worker
PIECE_BYTES = 4 << 20  # of text encoded at once
GATHER = 1 << 20  # words whose ids are gathered at once
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # behind a letter they are pre-tokens of their own
# One pre-token that normalization only lower-cases, letter by letter.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


_AS_BYTES = {c: "".join(_byte_letters()[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}


class WordEncoder:
    """Little-endian unsigned 32-bit ids of texts, as bytes."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task has one core
        self._tokenizer = Tokenizer.from_file(path)
        self._merge = self._tokenizer.model.tokenize
        self._bytes = [k.to_bytes(4, "little") for k in range(self._tokenizer.get_vocab_size() + 1)]
        self._limit = cache_words
        # whether words may be taken apart as here; any other sort of tokenizer gets them whole
        probe = ["thé", "naïveté", "x", "thé.,", "x%%'", "don't!"]
        self._plain = False
        whole = self._whole(probe)
        self._plain, self._new, self._old = True, {}, {}
        self._plain = self._ids_of(probe) == whole and self._letters("thé") == self._whole(["ThÉ"])[0]
        self._new = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    def _letters(self, word: str) -> bytes:
        """For lower-case words of ``_LETTERS``: straight to the merges."""
        shown = word if word.isascii() else word.lower().translate(_AS_BYTES)
        return b"".join([self._bytes[t.id] for t in self._merge(shown)])

    def _one(self, word: str) -> bytes:
        """Ids of a word from the cache's two generations, or new."""
        ids = self._new.get(word)
        if ids is None:
            ids = self._old.get(word)
            if ids is None:
                if self._plain and (word.isascii() and word.isalpha() or _LETTERS.fullmatch(word)):
                    ids = self._letters(word)
                else:
                    ids = self._whole([word])[0] if word else b""
            self._new[word] = ids
        return ids

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of each word, ASCII letters lower-cased but for special tokens."""
        found = [*map(self._new.get, words)]
        for k in [k for k, ids in enumerate(found) if ids is None]:
            word = words[k]
            core = word.rstrip(_MARKS) if self._plain else word
            if len(core) < len(word) and core and core[-1].isalpha() and "<|" not in word:
                # a letter, then marks: two pre-tokens, whose ids stand side by side; only the parts are kept
                found[k] = self._one(core) + self._one(word[len(core) :])
            else:
                found[k] = self._one(word)
        return found

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (a null one is empty), each followed by ``end_id`` if given, and where each begins."""
        if len(self._new) > self._limit:
            self._old, self._new = self._new, {}
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        firsts = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(split)), dtype=np.int64)])
        coded = split.flatten().dictionary_encode()
        # normalization lower-cases; special tokens are matched before that and are left as they are
        raw = coded.dictionary
        vocabulary = pc.if_else(pc.match_substring(raw, "<|"), raw, pc.ascii_lower(raw)) if self._plain else raw
        # words hold no space, so one string carries them all to Python
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), vocabulary), " ")[0].as_py()
        own = self._ids_of(joined.split(" ") if len(raw) else [])
        number = np.asarray(coded.indices)
        if end_id is not None:
            number = np.insert(number, firsts[1:], len(own))
            own.append(np.asarray([end_id], dtype="<u4").tobytes())
            firsts += np.arange(len(firsts))
        sizes = np.fromiter(map(len, own), dtype=np.int32, count=len(own)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int32) if own else sizes
        flat = np.frombuffer(b"".join(own), dtype="<u4")
        before = np.zeros(len(number) + 1, dtype=np.int64)
        np.cumsum(sizes[number], out=before[1:])
        ids = np.empty(before[-1], dtype="<u4")
        for k in range(0, len(number), GATHER):
            part = number[k : k + GATHER]
            a, b = before[k], before[k + len(part)]
            shift = np.repeat((starts[part] - (before[k : k + len(part)] - a)).astype(np.int32), sizes[part])
            shift += np.arange(b - a, dtype=np.int32)
            ids[a:b] = flat[shift]
        return ids, before[firsts]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker and tokenizer file."""
    return WordEncoder(path)


def encoded(batch: pa.RecordBatch, column: str, path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of a record batch with the ids of a text column and where each row's ids begin (one end more)."""
    texts = batch.column(column)
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    whole = int(ends[-1]) if len(ends) else 0
    most = max(1, whole // max(1, -(-whole // PIECE_BYTES)))  # pieces of about the same size
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        piece = batch.slice(start, stop - start)
        yield piece, *encoder(path).encode(piece.column(column), end_id)
        pa.default_memory_pool().release_unused()  # two workers share an executor's memory with its JVM
        start = stop
