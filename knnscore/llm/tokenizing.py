"""Token ids of whole texts by a public tokenizer, several times faster than one call a text.

The tokenizer lower-cases, drops white space and merges within pre-tokens only, so a text's ids are
those of its space-separated chunks one after another, and a chunk's are those of its pre-tokens. Each
Python worker keeps the ids of chunks and pre-tokens that it has seen and asks the library for new
pre-tokens, many at a time. Chunks with characters beyond U+024F and texts with a special token's string
go to the library whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import numpy as np

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: The file's own pre-token pattern with its classes spelled out up to U+024F, after lower-casing.
_LETTER = "a-zªµºß-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_WHOLE = re.compile("[^\x00-ɏ]")
CACHE_ENTRIES = 1_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CachedTokenizer:
    """encode(texts) gives little-endian unsigned 16-bit ids (32-bit for larger vocabularies) of each text as bytes."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        tokenize, dtype, size = self.library.model.tokenize, self.dtype, self.dtype.itemsize
        rest = []
        for w in new:
            if w.isascii() and w.isalnum():  # no normal form or byte mapping to apply: the model alone
                self.known[w] = b"".join([t.id.to_bytes(size, "little") for t in tokenize(w)])
            else:
                rest.append(w)
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            got = self.library.encode(" ".join(part), add_special_tokens=False)
            of = np.array(got.word_ids, dtype=np.int64)
            if not len(of) or of[-1] + 1 != len(part):  # the library splits one of them: ask one by one
                self.known.update((w, self._whole(w)) for w in part)
                continue
            raw, ends = np.array(got.ids, dtype=dtype).tobytes(), (np.searchsorted(of, np.arange(len(part) + 1)) * size).tolist()
            self.known.update((w, raw[ends[j] : ends[j + 1]]) for j, w in enumerate(part))

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _learn_chunks(self, new: set[str]) -> None:
        split = {c: PRETOKEN.findall(unicodedata.normalize("NFC", c).lower()) for c in new if not _WHOLE.search(c)}
        unknown = {w for ws in split.values() for w in ws}.difference(self.known)
        if unknown:
            self._learn(sorted(unknown))
        known = self.known
        for c in new:
            self.chunks[c] = b"".join([known[w] for w in split[c]]) if c in split else self._whole(c)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        out: list[bytes] = []
        for text in texts:
            if "<|" in text:
                out.append(self._whole(text))
                continue
            words = (text.lower() if text.isascii() else text).replace("\n", " ").split(" ")
            new = set(words).difference(self.chunks)
            if new:
                if len(self.chunks) > CACHE_ENTRIES:
                    self.chunks.clear()
                    self.known.clear()
                    new = set(words)
                self._learn_chunks(new)
            get = self.chunks.__getitem__
            out.append(b"".join(map(get, words)))
        return out


_workers: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    """One per Python worker process."""
    if path not in _workers:
        _workers[path] = CachedTokenizer(path)
    return _workers[path]
