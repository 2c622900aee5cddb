"""Token ids by the ``tokenizers`` library's models, word by word behind bounded caches.

Both supported pre-tokenizers put a token border wherever a non-space character is followed by white space,
and look at nothing beyond that white space and the characters after it. So a text's ids are those of its
chunks (white space, then non-space characters) put together. A chunk's ids are those of its
pre-tokens, which the library's model merges.

A batch of texts is cut at its blanks and dictionary-encoded by Arrow, so each distinct word is looked up once
a batch, and Python touches no word twice; the ids are then gathered by the words' codes. What was made for a
word, chunk or pre-token is remembered across batches; the caches only save time.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from collections.abc import Callable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: The code points with Unicode's White_Space property, as ranges of a pattern's class.
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNKS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: White space that a blank follows: then blanks are not borders of chunks. Written out for Arrow's expressions.
WIDE = "[" + "".join(chr(c) for c in range(0x3001) if re.match(f"[{WHITE}]", chr(c))) + "] "
#: Entries of a generation of a cache (of words after a blank, of other chunks, of pre-tokens), and the longest text
#: that is remembered: at most about 100 MB for a worker.
SPACED, OTHER, PIECES, HELD_CHARS = 250_000, 40_000, 40_000, 48
#: Bytes of the texts that are encoded at a time (one text at least).
SLICE = 8 << 20
#: The ASCII characters that are no letters, digits or white space; words of letters all of which are
#: whole characters, with one lower-case letter each.
MARKS = string.punctuation
LATIN = re.compile("[A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]+")

_ID = attrgetter("id")
_ENCODERS: dict[str, Encoder] = {}


class Memo:
    """A bounded cache of two generations: what is not asked for while a generation fills is forgotten."""

    def __init__(self, size: int = PIECES):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: str):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value) -> None:
        if len(key) > HELD_CHARS:
            return
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


def class_of_white(pattern: str) -> str:
    r"""A pattern with ``\s`` and ``\S`` as Unicode defines white space; the regex module's own class is wider."""
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """Runs of ``texts`` of at most ``most`` bytes, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(texts):
        held = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, held + most, "right")))
        yield texts.slice(low, high - low)
        low = high


class Chunks:
    """The ids of texts, packed as 32-bit integers.

    ``word`` gives those of a word of letters and the blank before it, ``pieces`` the pre-tokens of any chunk, ``merge``
    the ids of a pre-token. What ``letters`` holds for and the ASCII marks after it must be two pre-tokens.
    """

    def __init__(self, word: Callable[[str], bytes], pieces: Callable[[str], list[str]], merge: Callable[[str], bytes], letters: Callable[[str], bool] = str.isalpha):
        self.word, self.pieces, self.merge, self.letters = word, pieces, merge, letters
        self.spaced, self.other, self.parts = Memo(SPACED), Memo(OTHER), Memo(PIECES)

    def _piece(self, piece: str) -> bytes:
        found = self.parts.get(piece)
        if found is None:
            found = self.merge(piece)
            self.parts.put(piece, found)
        return found

    def _other(self, chunk: str) -> bytes:
        found = self.other.get(chunk)
        if found is None:
            found = b"".join([self._piece(p) for p in self.pieces(chunk)])
            self.other.put(chunk, found)
        return found

    def _spaced(self, word: str) -> bytes:
        """The ids of a blank and what stands up to the next one."""
        found = self.spaced.get(word)
        if found is not None:
            return found
        if word.isalpha():
            found = self.word(word)
            self.spaced.put(word, found)
            return found
        bare = word.rstrip(MARKS)
        if self.letters(bare):
            return self._spaced(bare) + self._piece(word[len(bare) :])
        chunks = CHUNKS.findall(" " + word)
        if len(chunks) == 1:
            return self._other(chunks[0])
        return b"".join([self._spaced(c[1:]) if c[0] == " " and len(c) > 1 and not c[1].isspace() else self._other(c) for c in chunks])

    def whole(self, text: str) -> bytes:
        """The ids of any text, chunk by chunk."""
        return b"".join([self._other(c) for c in CHUNKS.findall(text)])

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of each text, ids of all of them) of runs of ``texts``; null is an empty text."""
        for part in slices(texts.cast(pa.large_string())):
            yield self._run(pc.fill_null(part, ""))

    def _run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        wide = pc.match_substring_regex(texts, WIDE)
        split = pc.split_pattern(pc.if_else(wide, "", texts), " ")
        starts = split.offsets.to_numpy()[: len(texts)] - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        every = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        words = pc.binary_join(every, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ") if len(coded.dictionary) else []
        made = [self._spaced(w) for w in words]
        # The first word of a text has no blank before it; a text with wide white space is one entry.
        firsts = [self.whole(w) for w in pc.list_element(split, 0).to_pylist()]
        for at in np.flatnonzero(wide.to_numpy(zero_copy_only=False)).tolist():
            firsts[at] = self.whole(texts[at].as_py())
        codes = coded.indices.to_numpy().astype(np.int64)
        codes[starts] = len(words) + np.arange(len(texts))
        made += firsts
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        ends = np.concatenate([[0], np.cumsum(sizes)])
        held = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), np.int32)))
        ids = held.take(pa.array(codes)).flatten().to_numpy().view(np.uint32)
        return np.add.reduceat(sizes[codes], starts), ids


def packed(chunks: Chunks, texts: pa.Array) -> Iterator[bytes]:
    """Each text's ids, as little-endian unsigned 32-bit integers."""
    for counts, ids in chunks.encode(texts):
        data, at = ids.tobytes(), 0
        for n in (4 * counts).tolist():
            yield data[at : at + n]
            at += n


def _byte_letters() -> str:
    """The printable character that stands for each byte in byte-level vocabularies, by byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return "".join(chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256))


class Encoder:
    """``encode(text)``: the ids as little-endian unsigned 32-bit integers, without special tokens.

    Strings of special tokens in a text are ordinary text. None encodes as an empty text.
    """

    def __init__(self, path: str):
        import public_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf8") as f:
            stated = json.load(f)["pre_tokenizer"]
        patterns = [p["pattern"]["Regex"] for p in stated.get("pretokenizers", []) if p["type"] == "Split"]
        self.split = regex.compile(class_of_white(patterns[0] if patterns else public_tokenizers.PATTERN)).findall
        self.normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else None
        #: Whether white space is no part of any pre-token; else a blank before a word is.
        self.drops_white = bool(patterns)
        self.letters = _byte_letters()
        self.model = self.tokenizer.model.tokenize
        self.chunks = Chunks(self._word, self._pieces, self._merge, self._stays if self.normal else str.isalpha)

    def _stays(self, word: str) -> bool:
        """Whether a word is letters, normalized too."""
        return word.isalpha() and (word.isascii() or LATIN.fullmatch(word) is not None or self.normal(word).isalpha())

    def _word(self, word: str) -> bytes:
        if self.normal and not word.isascii():
            if not LATIN.fullmatch(word):
                return b"".join(map(self._merge, self._pieces(" " + word)))
            word = word.lower()
        return self._merge(word if self.drops_white else " " + word)

    def _pieces(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk."""
        if self.normal:
            # In ASCII, all that normalizing changes besides white space is case.
            chunk = chunk.lower() if chunk.isascii() else self.normal(chunk)
        return self.split(chunk)

    def _merge(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            return self._ids(piece.replace(" ", self.letters[32]))
        return self._ids(piece.encode().decode("latin-1").translate(self.letters))

    def _ids(self, letters: str) -> bytes:
        return array("I", map(_ID, self.model(letters))).tobytes()

    def encode(self, text: str | None) -> bytes:
        return next(self.batch(pa.array([text], pa.string())))

    def batch(self, texts: pa.Array) -> Iterator[bytes]:
        """``encode`` of each of many texts."""
        return packed(self.chunks, pc.ascii_lower(texts) if self.normal else texts)


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
