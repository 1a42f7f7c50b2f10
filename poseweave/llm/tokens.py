"""Token ids of whole texts from a byte-level BPE file, through the tokenizers library.

The library splits a text into words before it merges bytes, so the ids of a text are those of its words one after
the other.  Words are merged by the library's own model.  Each worker keeps the ids of up to ``CACHE_WORDS`` words it has met (a bound on memory, not on results) and
asks the library for all others.  The split below is the file's own, restricted to characters whose classes
are certain; a piece of text with any other character goes to the library whole.
"""

from __future__ import annotations

import os
import re
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from functools import lru_cache

#: Words whose ids a worker keeps.
CACHE_WORDS = 200_000
#: A longer text is encoded in pieces of about this many characters, cut where the split always cuts.
PIECE_CHARS = 1 << 20

# The letters, digits and white space of the code points below U+0250, and the split of byte-level BPE.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
DIGIT = "0-9²³¹¼-¾"
SPACE = " \t\n\r\x0b\x0c"
UNSURE = re.compile("[\x1c-\x1f\x85\xa0]|[^\x00-ɏ]")
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^{SPACE}{LETTER}{DIGIT}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
SAFE_CUT = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")

# The printable sign that stands for each byte in byte-level vocabularies.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
OTHERS = [b for b in range(256) if b not in PRINTED]
BYTE_SIGNS = "".join(chr(b if b in PRINTED else 256 + OTHERS.index(b)) for b in range(256))
UNSURE_BYTES = b"\x1c\x1d\x1e\x1f\x85\xa0"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Known(dict):
    """Ids of the words met so far, at most ``CACHE_WORDS`` of them; those of others are found anew each time."""

    def __init__(self, ids: Callable[[str], bytes]):
        super().__init__()
        self.ids = ids

    def __missing__(self, word: str) -> bytes:
        found = self.ids(word)
        if len(self) < CACHE_WORDS:
            self[word] = found
        return found


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, ready for checksums and arrays."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.encode_special_tokens = True
        self.merge = self.library.model.tokenize
        self.packed = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.known = Known(self._merged)

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self._piece, pieces(text or "")))

    def _piece(self, text: str) -> bytes:
        if not certain(text):
            return b"".join([self.packed[i] for i in self.library.encode(text, add_special_tokens=False).ids])
        return b"".join(map(self.known.__getitem__, SPLIT.findall(text)))

    def _merged(self, word: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.merge(charmap_decode(word.encode(), "strict", BYTE_SIGNS)[0])])


def certain(text: str) -> bool:
    """Whether the classes of all characters are certain."""
    if text.isascii():
        return not any(c in text for c in "\x1c\x1d\x1e\x1f")
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return UNSURE.search(text) is None
    return len(raw.translate(None, UNSURE_BYTES)) == len(raw)


def pieces(text: str) -> Iterator[str]:
    """The text cut at single spaces between letters or digits of ASCII, where every split starts a new word."""
    start = 0
    while len(text) - start > PIECE_CHARS:
        cut = SAFE_CUT.search(text, start + PIECE_CHARS)
        if cut is None:
            break
        yield text[start: cut.start()]
        start = cut.start()
    yield text[start:]


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(vocabulary)
