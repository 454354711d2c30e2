"""Cutting texts into pieces that a BPE tokenizer encodes independently of each other.

The two vocabularies used here first split a text into words, punctuation and blanks, and then
merge inside each part. A text is cut only where such a split is certain whatever Unicode tables
the tokenizer has:

- before a single blank (space or line feed) that stands between two visible characters,
- after a line feed that stands between two visible characters,
- between a letter and a punctuation mark of ASCII behind it; not an apostrophe, which begins the
  splits of contractions, nor a vertical bar, which stands behind letters in special tokens,
- on either side of Chinese or Japanese punctuation, where it meets a letter of these scripts.

Visible characters are those of printable ASCII and all others from U+00C0 but for blocks that
hold, or once held, blanks or marks without width (U+1680 to U+16BF, U+1800 to U+183F, U+2000 to
U+207F, U+3000 to U+303F, private use, and U+FE00 onwards except full-width forms). So texts of any
script that writes blanks between words are cut into words. Everything else just stays inside a
longer chunk. The texts of a slice are cut as one byte array in numpy, block by block, so that a
block's flags stay in the processor's cache; blocks of ASCII alone are looked at for nothing else.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Last bytes of full-width ! , : ; ? behind EF BC.
_WIDE_STOP = _table((0x81, 0x81), (0x8C, 0x8C), (0x9A, 0x9B), (0x9F, 0x9F))

#: Bytes looked at together, and bytes on either side that can decide about a cut (five at most).
BLOCK = 1 << 16
_AROUND = 8


def _within(data: np.ndarray, low: int, high: int) -> np.ndarray:
    return data - np.uint8(low) <= np.uint8(high - low)


def _flagged(places: np.ndarray, n: int) -> np.ndarray:
    """Flags of ``n`` positions, set at the places among them."""
    flags = np.zeros(n, bool)
    flags[places[places < n]] = True
    return flags


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flags of the bytes where visible characters beyond ASCII begin, where they end, and where
    letters end, and of the cuts between a letter and punctuation of Chinese or Japanese."""
    n = len(data)
    at = np.flatnonzero(data >= 0xC3)
    first, padded = data[at], np.append(data, np.zeros(2, np.uint8))
    second, third = padded[at + 1], padded[at + 2]
    two = first <= 0xDF
    three = (
        (first == 0xE0) | ((first == 0xE1) & (second != 0x9A) & (second != 0xA0))
        | ((first == 0xE2) & (second != 0x80) & (second != 0x81)) | ((first == 0xE3) & (second != 0x80))
        | _within(first, 0xE4, 0xED) | ((first == 0xEF) & ((second == 0xBC) | (second == 0xBD)))
    )
    four = first == 0xF0
    # Multiplication and division signs are no letters; U+0130 is two characters in lower case.
    sign = ((first == 0xC3) & ((second == 0x97) | (second == 0xB7))) | ((first == 0xC4) & (second == 0xB0))
    latin = _within(first, 0xC3, 0xC9) & _within(second, 0x80, 0xBF) & ~sign
    # U+0410 to U+044F.
    cyrillic = ((first == 0xD0) & (second >= 0x90)) | ((first == 0xD1) & (second <= 0x8F))
    east = (
        ((first == 0xE4) & (second >= 0xB8)) | _within(first, 0xE5, 0xE8) | ((first == 0xE9) & (second <= 0xBE))
        | ((first == 0xE3) & (second == 0x81) & (third >= 0x81)) | ((first == 0xE3) & (second == 0x83) & (third <= 0xBA))
    )
    east_stop = (
        ((first == 0xE3) & (second == 0x80) & ((third == 0x81) | (third == 0x82)))
        | ((first == 0xEF) & (second == 0xBC) & _WIDE_STOP[third])
    )
    ends = np.concatenate([at[two] + 1, at[three] + 2, at[four] + 3])
    begins_east, begins_stop = at[east], at[east_stop]
    cut = (
        (_flagged(begins_stop, n) & _flagged(begins_east + 3, n)) | (_flagged(begins_east, n) & _flagged(begins_stop + 3, n))
        if len(begins_stop) else np.zeros(n, bool)
    )
    return _flagged(at[two | three | four], n), _flagged(ends, n), _flagged(at[latin | cyrillic] + 1, n), cut


def _cuts(data: np.ndarray) -> np.ndarray:
    """Flags of the positions where a cut before a byte is certain."""
    ends_letter = _within(data | np.uint8(0x20), 0x61, 0x7A)
    begins_visible = ends_visible = visible = _within(data, 0x21, 0x7E)
    # Punctuation of ASCII but apostrophe and vertical bar.
    mark = visible & ~(ends_letter | _within(data, 0x30, 0x39)) & (data != 0x27) & (data != 0x7C)
    if data.max() < 0x80:
        cut = np.zeros(len(data), bool)
    else:
        begins, ends, letters, cut = _characters(data)
        begins_visible, ends_visible, ends_letter = visible | begins, visible | ends, ends_letter | letters
    feed = data == 0x0A
    blank = feed | (data == 0x20)
    between = np.zeros(len(data), bool)
    between[1:-1] = blank[1:-1] & ends_visible[:-2] & begins_visible[2:]
    cut |= between
    cut[1:] |= between[:-1] & feed[:-1]
    cut[1:] |= mark[1:] & ends_letter[:-1]
    return cut


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where chunks begin, with the end of the data, and each text's first chunk."""
    n = len(data)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.empty(n, bool)
    for at in range(0, n, BLOCK):
        low, after = max(at - _AROUND, 0), min(at + BLOCK, n)
        cut[at:after] = _cuts(data[low : after + _AROUND])[at - low : after - low]
    filled = offsets[:-1] < offsets[1:]
    cut[offsets[:-1][filled]] = True
    starts = np.flatnonzero(cut)
    return np.append(starts, n), np.searchsorted(starts, offsets)


def chunk_dictionary(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct chunks, the number of every chunk in them, and each text's first chunk."""
    starts, first = chunk_starts(data, offsets)
    if len(starts) == 1:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int32), first
    chunks = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts) - 1,
        [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    ).dictionary_encode()
    return chunks.dictionary, chunks.indices.to_numpy(), first


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of ``values[start : start + size]`` for all starts and sizes."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def tokenizer_json(path: str) -> str:
    """The vocabulary file without truncation and padding; bounded, so it can be broadcast."""
    with open(path, encoding="utf-8") as file:
        loaded = json.load(file)
    loaded["truncation"] = loaded["padding"] = None
    return json.dumps(loaded)


class ChunkEncoder:
    """Encodes chunks with the library.

    Where the vocabulary marks the ends of words, chunks of letters only are encoded many at a
    time with blanks between them, and their ids told apart by these marks. If the marks are not
    as many as the chunks, they are encoded one by one as all others are.
    """

    def __init__(self, vocabulary: str) -> None:
        self.tokenizer = Tokenizer.from_str(vocabulary)
        suffix = json.loads(vocabulary)["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:
            words = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(words.values()) + 1, bool)
            self.ends[[i for w, i in words.items() if w.endswith(suffix)]] = True

    def _each(self, chunks: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast([c.decode("utf-8") for c in chunks], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _together(self, chunks: list[bytes]) -> list[bytes]:
        text = b" ".join(chunks).decode("utf-8")
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        after = np.flatnonzero(self.ends[ids]) + 1
        if len(after) != len(chunks) or after[-1] != len(ids):
            return self._each(chunks)
        raw, edges = ids.tobytes(), (4 * after).tolist()
        return [raw[a:b] for a, b in zip([0, *edges], edges)]

    def encode(self, chunks: list[bytes], at_once: int = 2000) -> list[bytes]:
        """Ids of each chunk, as little-endian unsigned 32-bit integers."""
        found: list[bytes] = [b""] * len(chunks)
        alone, words = range(len(chunks)), []
        if self.ends is not None:
            letters = [_LETTERS.fullmatch(c) is not None for c in chunks]
            words = [i for i, own in enumerate(letters) if own]
            alone = [i for i, own in enumerate(letters) if not own]
        for places, run in ((alone, self._each), (words, self._together)):
            for start in range(0, len(places), at_once):
                part = places[start : start + at_once]
                for i, ids in zip(part, run([chunks[i] for i in part])):
                    found[i] = ids
        return found


_LETTERS = re.compile(rb"[ \n]?(?:[A-Za-z]|[\xc3-\xc9][\x80-\xbf])+")

_loaded: dict[int, ChunkEncoder] = {}


def chunk_encoder(vocabulary: str) -> ChunkEncoder:
    """The encoder of a vocabulary, made once per Python worker."""
    key = hash(vocabulary)
    if key not in _loaded:
        _loaded[key] = ChunkEncoder(vocabulary)
    return _loaded[key]
