"""Tokenizer access on the executors.

``UnitEncoder`` drives the *tokenizers* library.  Its byte-level and word-level
models treat each match of a split pattern alone, so a text may be cut wherever
the pattern has to end a match; the library then encodes each distinct piece
once per worker and the rest is look-ups.  Pieces outside a small, well-known
alphabet go to the library whole.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillmark.llm.common import BYTE_VALUE, U64, span_hashes, text_bytes, trim, word_spans, worker_memory

#: Unicode White_Space, which is what ``\\s`` means to the library.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_UNITS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_WORDS = re.compile(f"[^{WHITE}]+")
#: Texts that cannot be cut at every space: a space before white space or at the end.
_UNEVEN = f" [{WHITE}]| $"
#: White space besides the bytes that separate words.
_OTHER_WHITE = "[" + "".join(c for c in WHITE if c > " ") + "]"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[!-~ \n\t\r{_LETTER}]*")
_BYTE_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^ \n\t\r{_LETTER}0-9]+|[ \n\t\r]+(?![^ \n\t\r])|[ \n\t\r]+")
_WORD_LEVEL = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^ \n\t\r{_LETTER}0-9]+")

_IS_STOP = np.zeros(256, bool)
_IS_STOP[list(b".,")] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True

BYTE_LEVEL, WORD_LEVEL = "byte", "word"
#: Shows whether a tokenizer splits as this module does.
_PROBE = "It's 1234 o'clock, isn't it?  She'll say \"Ça va!\"\n\n\tFünf-und_zwanzig 日本語 (a+b)=c... <|endoftext|> x\u00a0y don't."


class UnitEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    ``kind`` BYTE_LEVEL keeps white space in the units (a cut lies before a
    space whose next character is no white space, where the pattern always
    begins a match); WORD_LEVEL drops white space and lower-cases.  A unit's ids
    are remembered under its 64-bit hash in a table of ``places`` rows of
    ``width`` ids, of the units with one row the last; and at most ``entries``
    of the matches that units consist of.  What is forgotten costs time only.
    Special tokens' strings are ordinary text.  A tokenizer file whose ids of a
    probe differ from the library's is not cut at all.
    """

    def __init__(self, path: str, kind: str, places: int = 1 << 21, width: int = 7, entries: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        self.kind, self.entries = kind, entries
        self.pieces: dict[str, bytes] = {}
        self.keys = np.zeros(places, np.uint64)
        self.counts = np.zeros(places, np.uint8)
        self.known = np.zeros((places, width), np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32)
        self.whole = False
        column = pa.array([_PROBE, _PROBE.replace(" ", "  "), _PROBE.upper()], pa.large_string())
        self.whole = self._group(column) != self._by_library(column.to_pylist())

    def _by_library(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 2000):
            done = self.library.encode_batch_fast(texts[i : i + 2000], add_special_tokens=False)
            out += [array("I", x.ids).tobytes() for x in done]
        return out

    def _pieces(self, unit: str) -> list[str] | None:
        """The pattern's matches in ``unit``; None if only the library can tell."""
        word = unit[1:] if unit[0] == " " else unit
        tail = ""
        if word[-1:] in (".", ","):
            word, tail = word[:-1], word[-1]
        if word.isalpha():  # letters are one match, then punctuation another
            if self.kind == WORD_LEVEL:
                word = word.lower() if word.isascii() or max(word) <= "ÿ" else word
            elif unit[0] == " ":
                word = " " + word
            return [word, tail] if tail else [word]
        if not _PLAIN.fullmatch(unit):
            return None
        return (_WORD_LEVEL.findall(unit.lower()) if self.kind == WORD_LEVEL else _BYTE_LEVEL.findall(unit))

    def _values(self, units: list[str]) -> list[bytes]:
        """Ids of each unit."""
        cut = [self._pieces(u) for u in units]
        known = self.pieces
        new = list({p for parts in cut if parts for p in parts if p not in known})
        fresh = dict(zip(new, self._by_library(new)))
        whole = iter(self._by_library([u for u, parts in zip(units, cut) if parts is None]))
        out = [next(whole) if parts is None else b"".join([fresh[p] if p in fresh else known[p] for p in parts]) for parts in cut]
        if len(known) + len(fresh) > self.entries:
            known.clear()
        known.update((k, v) for k, v in fresh.items() if len(k) <= 64)
        return out

    def _one(self, text: str) -> bytes:
        """A text that is not evenly spaced, some thousand units at a time."""
        units, out = (_WORDS if self.kind == WORD_LEVEL else _UNITS).finditer(text), []
        while own := [m[0] for m in islice(units, 50_000)]:
            distinct = list(dict.fromkeys(own))
            known = dict(zip(distinct, self._values(distinct)))
            out.append(b"".join([known[u] for u in own]))
        return b"".join(out)

    def _spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every unit of evenly spaced texts; a full
        stop or comma that ends a unit after a letter is one of its own."""
        if self.kind == WORD_LEVEL:
            starts, ends, doc = word_spans(data, offsets)
        else:
            first = data == 0x20
            first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
            starts = np.flatnonzero(first)
            ends, doc = np.append(starts[1:], len(data)), np.searchsorted(offsets, starts, side="right") - 1
        tail = np.flatnonzero(_IS_STOP[data[ends - 1]] & _IS_LETTER[data[np.maximum(ends - 2, 0)]] & (ends - starts > 1))
        cut = ends[tail] - 1
        starts, doc = np.insert(starts, tail + 1, cut), np.insert(doc, tail + 1, doc[tail])
        inner = ends.copy()
        inner[tail] = cut
        return starts, np.insert(inner, tail + 1, ends[tail]), doc

    def _group(self, column: pa.Array) -> list[bytes]:
        if self.whole:
            return self._by_library(column.to_pylist())
        odd = pc.match_substring_regex(column, _OTHER_WHITE if self.kind == WORD_LEVEL else _UNEVEN).to_numpy(zero_copy_only=False)
        even = np.flatnonzero(~odd)
        out: list[bytes] = [b""] * len(column)
        for i in np.flatnonzero(odd):
            out[i] = self._one(column[int(i)].as_py())
        if not len(even):
            return out
        data, offsets = text_bytes(column.take(pa.array(even)) if len(even) < len(column) else column)
        if not len(data):
            return out
        starts, ends, doc = self._spans(data, offsets)
        hashes = span_hashes(data, starts, ends, BYTE_VALUE)
        place = (hashes & U64(len(self.keys) - 1)).astype(np.int64)
        hit = (self.keys[place] == hashes) & (self.counts[place] > 0)
        count, base = self.counts[place].astype(np.int64), place * self.known.shape[1]
        fresh = np.zeros(0, "<u4")
        new = np.flatnonzero(~hit)
        if len(new):
            distinct, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            raw, at = data.tobytes(), new[first]
            values = self._values([raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            fresh = np.frombuffer(b"".join(values), "<u4")
            size = np.fromiter(map(len, values), np.int64, len(values)) // 4
            begin = np.cumsum(size) - size
            count[new], base[new] = size[back], begin[back]
        last = np.cumsum(count)
        total = int(last[-1]) if len(last) else 0
        source = np.repeat(base - (last - count), count) + np.arange(total)
        held = np.repeat(hit, count)
        ids = np.empty(total, "<u4")
        ids[held] = self.known.reshape(-1)[source[held]]
        ids[~held] = fresh[source[~held]]
        if len(new):  # of new units with one place the last is remembered
            width = self.known.shape[1]
            small = np.flatnonzero((size <= width) & (size > 0))
            slot = place[at[small]]
            column_of = np.minimum(begin[small][:, None] + np.arange(width), len(fresh) - 1) if len(small) else np.zeros((0, width), np.int64)
            self.keys[slot], self.counts[slot], self.known[slot] = distinct[small], size[small], fresh[column_of]
        cuts = np.concatenate([[0], last])[np.searchsorted(doc, np.arange(len(even) + 1))]
        for j, i in enumerate(even):
            out[i] = ids[cuts[j] : cuts[j + 1]].tobytes()
        return out

    def _parts(self, text: str, size: int):
        """A long text in columns of one part each, cut before single spaces;
        whole if it is not evenly spaced."""
        if self.whole or re.search(_OTHER_WHITE if self.kind == WORD_LEVEL else _UNEVEN, text):
            yield pa.array([text], pa.large_string())
            return
        first = 0
        while first < len(text):
            cut = text.find(" ", first + size)
            cut = len(text) if cut < 0 else cut
            yield pa.array([text[first:cut]], pa.large_string())
            first = cut

    def encode(self, texts, group_bytes: int = 1 << 20):
        """Yields the ids of one text after the other; a null is an empty text.

        texts: a list or an Arrow column.  Groups of about ``group_bytes`` are
        cut into pieces, and their distinct pieces looked up, at a time.
        """
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(column):
            begun = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, begun + group_bytes, side="right")))
            own = pc.fill_null(column.slice(first, last - first).cast(pa.large_string()), "")
            if int(ends[first]) - begun > 2 * group_bytes:
                yield b"".join(x for part in self._parts(own[0].as_py(), group_bytes) for x in self._group(part))
            else:
                yield from self._group(own)
            first = last
        trim()


def unit_encoder(path: str, kind: str) -> UnitEncoder:
    """One encoder for each Python worker; its memory outlives a task."""
    return worker_memory(("units", path, kind), lambda: UnitEncoder(path, kind))


def rank_encoding(path: str, pattern: str):
    """A tiktoken encoding from a local rank file, without special tokens."""
    import tiktoken

    def load():
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return worker_memory(("ranks", path, pattern), load)


def safe_parts(text: str, limit: int) -> list[str]:
    """``text`` in parts of about ``limit`` characters, cut where the split
    pattern always begins a match: before a space that follows a character
    other than white space and precedes one.  A stretch without such a place stays whole."""
    if len(text) <= limit:
        return [text]
    parts, first = [], 0
    boundary = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")
    while len(text) - first > limit:
        cut = boundary.search(text, first + limit)
        if not cut:
            break
        parts.append(text[first : cut.start()])
        first = cut.start()
    return [*parts, text[first:]]


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN
