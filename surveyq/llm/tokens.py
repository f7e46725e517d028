"""Exact encodings of whole texts by public tokenizers, in bounded pieces.

Overlap resynchronisation: a long text is encoded in chunks that overlap. In
each overlap the two encodings are compared by offsets, and spliced where both
have a token boundary that provably no context can move: a single space or
line feed between two characters that are not white space, with the tokens on
either side equal in both. Where an overlap has no such place it is widened,
up to the whole chunk, and then the chunk is doubled, up to the whole text.

Both kinds of tokenizer used here split words by a pattern in which such a
place always ends a word, and merge byte pairs inside words only. A file that
differs from them in any part that matters is not spliced: its texts are
encoded whole, however long they are.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

#: Code points encoded at once, code points of overlap, and tokens that have to agree on each side of a splice.
CHUNK, OVERLAP, AGREE = 50_000, 400, 3
_BREAK = re.compile(r"(?<=\S)[ \n](?=\S)")
#: Texts whose characters all libraries class alike; others go to the tokenizers library itself.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ſ]*")
#: Words remembered with their token count by each worker.
MEMO = 600_000

#: Normaliser and pre-tokeniser of the files whose words are known to end at a break.
_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_WORD_FILE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_BYTE_FILE = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
}


def _settled(parts: dict, known: dict) -> bool:
    """Whether a file is byte-pair encoding behind these parts, with added tokens that match by their own characters alone."""
    model = parts["model"]
    return (
        all(parts.get(k) == v for k, v in known.items())
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not any(
            t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in parts["added_tokens"]
        )
    )


@dataclass
class Encoded:
    """Tokens with their code point ranges in the whole text."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def after(self, i: int) -> Encoded:
        return Encoded(self.ids[i:], self.start[i:], self.end[i:])


def splice(
    text: str, encode: Callable[[str, int], Encoded], chunk: int = CHUNK, overlap: int = OVERLAP
) -> Iterator[np.ndarray]:
    """The ids of text in pieces, together equal to encoding it at once. encode(part, where it begins)."""
    n, start = len(text), 0
    end = min(n, chunk)
    left = encode(text[:end], 0)
    while end < n:
        width = overlap
        while True:
            begin = max(start, end - width)
            stop = min(n, max(begin + chunk, end + width))
            right = encode(text[begin:stop], begin)
            cut = _agreed(text, left, right, begin, end)
            if cut or begin == start:
                break
            width *= 2
        if cut is None:  # start is safe, so a longer chunk from there can be encoded alone
            end = min(n, 2 * end - start)
            left = encode(text[start:end], start)
            continue
        i, j, start = cut
        yield left.ids[:i]
        left, end = right.after(j), stop
    yield left.ids


def _agreed(text: str, left: Encoded, right: Encoded, begin: int, end: int) -> tuple[int, int, int] | None:
    """Token places in left and right, and the text position, of a safe boundary nearest the middle of the overlap."""
    places = [m.start() for m in _BREAK.finditer(text, begin + 1, end - 1)]
    for p in sorted(places, key=lambda p: abs(2 * p - begin - end)):
        i, j = (int(np.searchsorted(x.start, p)) for x in (left, right))
        if i < AGREE or j < AGREE or i + AGREE > len(left.ids) or j + AGREE > len(right.ids):
            continue
        if left.end[i - 1] > p or right.end[j - 1] > p:
            continue
        if all(
            np.array_equal(getattr(left, k)[i - AGREE : i + AGREE], getattr(right, k)[j - AGREE : j + AGREE])
            for k in ("ids", "start", "end")
        ):
            return i, j, p
    return None


def _class(kind: str) -> str:
    return "".join(chr(c) for c in range(0x80, 0x180) if unicodedata.category(chr(c))[0] == kind)


def _byte_alphabet() -> dict[str, int]:
    """The published byte-level alphabet: printable bytes are themselves, the rest follow from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Library:
    """A tokenizers file as the library reads it, without added begin or end tokens."""

    #: Code points above which a text is encoded in overlapping chunks, and the parts a file needs for that.
    chunk, known = CHUNK, _BYTE_FILE

    def __init__(self, source: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        parts = json.loads(source)
        self.special = [t["content"] for t in parts["added_tokens"]]
        self.fast = _settled(parts, self.known)

    def encode(self, text: str, at: int = 0) -> Encoded:
        got = self.tokenizer.encode(text, add_special_tokens=False)
        spans = np.array(got.offsets, np.int64).reshape(-1, 2) + at
        return Encoded(np.array(got.ids, np.uint32), spans[:, 0], spans[:, 1])

    def ids(self, text: str) -> Iterator[np.ndarray]:
        if len(text) <= self.chunk or not self.fast:
            yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            yield from splice(text, self.encode, self.chunk)

    def plain(self, text: str) -> bool:
        """Whether the faster paths apply: characters of settled classes and no special token's string."""
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)


class WordCounts(Library):
    """Token counts of a tokenizer that drops white space: a word's count doesn't depend on its context, so it is remembered."""

    chunk, known = 16_000, _WORD_FILE

    def __init__(self, source: str):
        super().__init__(source)
        letter, digit = "a-z" + _class("L"), "0-9" + _class("N")
        #: The word pattern in this file, over lower-cased text and with character classes written out.
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^\s{letter}{digit}]+")
        self.memo: dict[str, int] = {}

    def _remember(self, words: list[str]) -> None:
        """Have the counts of all these words in the memo."""
        if new := set(words).difference(self.memo):
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
                new = set(words)
            new = list(new)
            for word, got in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                self.memo[word] = len(got)

    def words_with_counts(self, text: str, at: int = 0) -> Encoded:
        """The words of a plain text with their places; instead of ids, their numbers of tokens."""
        # lowering keeps the length of every settled character
        found = [(m.group(), m.start(), m.end()) for m in self.words.finditer(text.lower())]
        words = [w for w, _, _ in found]
        self._remember(words)
        places = np.array([f[1:] for f in found], np.int64).reshape(-1, 2) + at
        return Encoded(np.array([self.memo[w] for w in words], np.int64), places[:, 0], places[:, 1])

    def count(self, text: str) -> int:
        if not self.fast or not self.plain(text):
            return sum(len(ids) for ids in self.ids(text))
        if len(text) > self.chunk:
            return sum(int(counts.sum()) for counts in splice(text, self.words_with_counts, self.chunk))
        words = self.words.findall(text.lower())
        self._remember(words)
        return sum(map(self.memo.__getitem__, words))


class ByteIds(Library):
    """Ids of a byte-level BPE file. tiktoken merges by the same ranks where the file's ids follow its merges."""

    def __init__(self, source: str):
        super().__init__(source)
        import public_tokenizers
        import tiktoken

        parts = json.loads(source)
        vocab = parts["model"]["vocab"]
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in parts["model"]["merges"]]
        #: Whether tiktoken gives the same ids.
        self.ranked = self.fast and [vocab[m] for m in merged] == list(range(256, 256 + len(merged)))
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _quick(self, text: str, at: int) -> Encoded:
        ids = np.array(self.quick.encode_ordinary(text), np.uint32)
        ends = np.cumsum(self.size[ids])
        # code points that begin before each byte
        lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        seen = np.concatenate([[0], np.cumsum(lead)]) + at
        return Encoded(ids, seen[ends - self.size[ids]], seen[ends])

    def ids(self, text: str) -> Iterator[np.ndarray]:
        if not self.ranked or not self.plain(text):
            yield from super().ids(text)
        elif len(text) <= self.chunk:
            yield np.array(self.quick.encode_ordinary(text), np.uint32)
        else:
            yield from splice(text, self._quick, self.chunk)


_loaded: dict[tuple[str, str], Library] = {}


def loaded(kind: type[Library], source: str) -> Library:
    """One instance for each worker process and file."""
    key = (kind.__name__, hashlib.sha256(source.encode()).hexdigest())
    if key not in _loaded:
        _loaded[key] = kind(source)
    return _loaded[key]


def read_vocabulary(path: str) -> str:
    """The tokenizer's file, read on the driver; it is a few MB whatever the data, and is broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()
