"""Exact token ids through a per-worker cache of white-space chunks.

The word tokenizer never joins characters across white space, so a text's ids are its chunks' ids one after the
other.  Every id still comes from the ``tokenizers`` library: a chunk is encoded once per worker and then looked up.
Texts for which chunks and text could differ (combining marks, control characters that only Python calls white
space, strings of special tokens) are encoded whole.
"""

from __future__ import annotations

import re
import sys
from array import array

#: Characters that Python's ``split`` takes as white space and the tokenizer's pattern does not.
ODD = re.compile("[\x1c-\x1f̀-￿\U00010000-\U0010ffff]|<\\|")
#: Chunks kept by one worker, about 250 bytes each; past this the cache starts again.
CACHE_CHUNKS = 1_000_000
LONGEST_CACHED = 48
#: Marks that the tokenizer keeps apart from the letters before them.
TAIL = ".,;:!?%#$&*"


class ChunkCache(dict):
    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.encode = self.tokenizer.encode
        self.model = self.tokenizer.model
        self.bytes_as_text = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.tails: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = array("I", self.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def word(self, letters: str) -> bytes:
        """Ids of letters alone, which are one word to the tokenizer: its model directly."""
        if not letters.isascii():
            letters = self.bytes_as_text(letters)[0][0]
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        body = chunk.rstrip(TAIL)
        if body.isalpha() and sys.byteorder == "little":
            tail = chunk[len(body) :]
            if tail and tail not in self.tails:
                self.tails[tail] = self.whole(tail)
            got = (self.get(body) or self.word(body)) + (self.tails[tail] if tail else b"")
        else:
            got = self.whole(chunk)
        if len(chunk) <= LONGEST_CACHED:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
                self.tails.clear()
            self[chunk] = got
        return got

    def ids(self, text: str | None) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers; a null text has none."""
        if not text:
            return b""
        if ODD.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.lower().split()))  # the tokenizer lower-cases too


_caches: dict[str, ChunkCache] = {}


def chunk_cache(path: str) -> ChunkCache:
    """The worker's cache for a tokenizer file; workers are reused, so it outlives a task."""
    if path not in _caches:
        _caches[path] = ChunkCache(path)
    return _caches[path]
