"""Vocabulary files and encoding with a bounded memory of chunks.

The files are a parameter (a path); they are found by name through ``public_tokenizers`` and
never copied. A library call per document would spend most of its time on words that were
encoded before, so a task cuts texts at borders that the pre-tokenizer never crosses and asks
the library only for chunks that it has not met lately.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

#: Chunks that a task remembers; beyond, it starts anew.
REMEMBERED = 800_000
#: Longer chunks are encoded each time.
LONGEST = 64
_loaded: dict[str, object] = {}
_encoders: dict[tuple[str, bool], Callable[[str], bytes]] = {}

#: ASCII white space before a chunk, the chunk, or white space at the end. A word of Latin
#: letters is a chunk of its own before a full stop or comma, so that it is met more often.
_CHUNKS = re.compile(
    r"[ \t\n\r\x0b\x0c]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,\s])|[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+\Z"
)
#: White space that is not ASCII (or that only some libraries call white space).
_ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_WORDS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,\s])|[^ \t\n\r\x0b\x0c]+")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizers library's object for a file, one per worker process."""
    if path not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _loaded[path] = found
    return _loaded[path]


def chunk_encoder(path: str, spaced: bool) -> Callable[[str], bytes]:
    """text -> ids as little-endian uint32, equal to the library's for the whole text.

    ``spaced``: a chunk keeps the white space before it (byte-level vocabularies, whose words
    begin with their space); otherwise white space only separates. Texts with a special
    token's string or with unusual white space are encoded whole.
    """
    if (path, spaced) in _encoders:
        return _encoders[path, spaced]
    library = load(path)
    special = [t.content for t in library.get_added_tokens_decoder().values()]
    marks = re.compile("|".join(map(re.escape, special))) if special else None
    cut = (_CHUNKS if spaced else _WORDS).findall
    known: dict[str, bytes] = {}
    get = known.get

    def whole(text: str) -> bytes:
        return array("I", library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if marks is not None and marks.search(text) or _ODD.search(text):
            return whole(text)
        chunks = cut(text)
        found = list(map(get, chunks))
        if None in found:
            if len(known) > REMEMBERED:
                known.clear()
            lacking = list({c for c, f in zip(chunks, found, strict=True) if f is None})
            fresh = dict(
                zip(
                    lacking,
                    (array("I", e.ids).tobytes() for e in library.encode_batch_fast(lacking, add_special_tokens=False)),
                    strict=True
                )
            )
            known.update((c, v) for c, v in fresh.items() if len(c) <= LONGEST)
            found = [fresh[c] if f is None else f for c, f in zip(chunks, found, strict=True)]
        return b"".join(found)

    _encoders[path, spaced] = encode
    return encode
