"""Byte-level and word-level BPE through the tokenizers library, with caches of short strings.

A text is cut at places where no token can cross, each distinct part is encoded once and kept,
and a text's ids are the concatenation. Cuts are exact, so results equal those of the whole text.
Memory is bounded: caches are emptied at CACHE entries, and only an unbroken run is held whole.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from collections.abc import Hashable, Iterable, Iterator

import numpy as np

#: Entries of each cache before it is emptied.
CACHE = 700_000
#: Longer strings are not kept.
KEEP_CHARS = 64

# The pattern, and the parts of a tokenizer file, that the fast ways below are written for. Others take the whole text.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
WORD_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A single space between two characters that are no white space: a token begins there, whatever follows.
CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 ones for themselves, the others from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in own else chr(0x100 + extra))
        extra += b not in own
    return out


BYTE_CHARS = byte_chars()
#: For str.translate: a Latin-1 character as the characters of its UTF-8 bytes.
LATIN_TO_BYTES = {c: "".join(BYTE_CHARS[b] for b in chr(c).encode()) for c in range(256)}


class _Cached:
    """Parts and, within them, pieces of simple characters, each with its ids as little-endian 32-bit numbers.

    A subclass has cut(text): its parts; context(part): the characters that a part stands for; simple(characters):
    whether they may be split in Python; form(characters): what is split then. The defaults take the whole text.
    """

    def __init__(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        self.parts: dict[Hashable, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def cut(self, text: str) -> list:
        return [text]

    def context(self, part) -> str:
        return part

    def simple(self, chars: str) -> object:
        return False

    def form(self, chars: str) -> str:
        return chars

    def split(self, chars: str) -> list[str]:
        return [chars]

    def _learn(self, parts: set) -> dict[Hashable, bytes]:
        """Ids of new parts: all pieces that are new too go through the tokenizer in one batch."""
        known, split = self.pieces, {}
        for p in parts:
            chars = self.context(p)
            split[p] = self.split(self.form(chars)) if self.simple(chars) else None
        new = {x for own in split.values() if own for x in own}.difference(known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = {x for own in split.values() if own for x in own}
        order = list(new)
        for at in range(0, len(order), 2000):
            some = order[at : at + 2000]
            got = self.bare.encode_batch_fast([x.translate(LATIN_TO_BYTES) for x in some], add_special_tokens=False)
            known.update(zip(some, [array("I", e.ids).tobytes() for e in got]))
        out = {}
        for p, own in split.items():
            out[p] = b"".join(map(known.__getitem__, own)) if own is not None else array("I", self.whole.encode(self.context(p), add_special_tokens=False).ids).tobytes()
        for x in order:
            if len(x) > KEEP_CHARS:
                del known[x]
        return out

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Give it texts of about a megabyte together."""
        known, rows, missing = self.parts, [], set()
        for t in texts:
            parts = self.cut(t)
            got = list(map(known.get, parts))
            if None in got:
                missing.update([p for p, g in zip(parts, got) if g is None])
            rows.append((parts, got))
        new = self._learn(missing) if missing else {}
        out = []
        for parts, got in rows:
            if None in got:
                got = [new[p] if g is None else g for p, g in zip(parts, got)]
            out.append(np.frombuffer(b"".join(got), "<u4"))
        if len(known) + len(new) > CACHE:
            known.clear()
        known.update({p: x for p, x in new.items() if len(self.context(p)) <= KEEP_CHARS})
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


def grouped(texts: Iterable[str | None], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Texts, null as empty, in lists of about `chars` characters."""
    now, size = [], 0
    for t in texts:
        now.append(t or "")
        size += len(now[-1])
        if size >= chars:
            yield now
            now, size = [], 0
    if now:
        yield now


class ByteBPE(_Cached):
    """A rank file as a tokenizers model: ids as tiktoken's, each match of the pattern by itself, no special tokens.

    Merges are all splits of a token into two known ones, in the order of the token's rank; a match that is
    itself a token stays whole. Both together give the ids of rank-driven merging.
    """

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__()
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        name = lambda t: "".join(map(BYTE_CHARS.__getitem__, t))
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None and a < rank and b < rank:
                    merges.append((name(token[:k]), name(token[k:])))
        self.model = models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.whole = Tokenizer(self.model)
        self.whole.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        # The byte table reversed: a token's characters back to bytes.
        back = {c: b for b, c in enumerate(BYTE_CHARS)}
        self.bytes_of = {i: bytes(map(back.__getitem__, t)) for t, i in self.whole.get_vocab(with_added_tokens=False).items()}
        self.lengths = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.lengths[i] = len(b)
        if pattern == BYTE_PATTERN:
            self.cut, self.context = self._cut, self._context
            # the pattern for texts of printable ASCII, Latin-1 letters, spaces and line ends, where Python's classes are the same
            self.simple = re.compile("[ \n!-~À-ÖØ-öø-ÿ]*").fullmatch
            self.bare = Tokenizer(self.model)
            self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+").findall

    @staticmethod
    def _cut(text: str) -> list:
        """The first part as a tuple of one, the others without the space that stands before them."""
        parts: list = CUT.split(text)
        parts[0] = (parts[0],)
        return parts

    @staticmethod
    def _context(part) -> str:
        return " " + part if type(part) is str else part[0]

    def offsets(self, ids: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Code points, starts and ends (exclusive), that each token touches; tokens that split a character share it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        if not len(ids):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        char_at = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32) - np.int32(1)
        ends = np.cumsum(self.lengths[ids])
        return char_at[ends - self.lengths[ids]], char_at[ends - 1] + np.int32(1)

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids. Characters that are split over tokens come together here, before anything reads them as UTF-8."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


class WordBPE(_Cached):
    """A tokenizers file. Where its normalizer lower-cases and its pre-tokenizer drops white space, parts between white space are independent.

    A file with another normalizer, pre-tokenizer, post-processor or added tokens that do not begin with `<|` encodes whole texts.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            told = json.load(f)
        pre = {"type": "Sequence", "pretokenizers": [WORD_SPLIT, WORD_BYTES]}
        plain = not any(told.get(k) for k in ("truncation", "padding", "post_processor"))
        if plain and told.get("normalizer") == WORD_NORMALIZER and told.get("pre_tokenizer") == pre and all(t["content"].startswith("<|") for t in told.get("added_tokens") or ()):
            self.cut = self._cut
            self.bare = Tokenizer(self.whole.model)
            self.simple = re.compile(r"(?!.*<\|)[!-~À-ÖØ-öø-ÿ]+").fullmatch
            self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
            self.form = str.lower

    @staticmethod
    def _cut(text: str) -> list[str]:
        # str.split also cuts at U+001C to U+001F, which are no white space to the tokenizer
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [p for p in re.split(r"[\x20\x09-\x0D]+", text) if p]
        return text.split()


_loaded: dict[tuple, object] = {}


def loaded(kind, *args):
    """One instance for each worker process."""
    key = (kind.__name__, *args)
    if key not in _loaded:
        _loaded[key] = kind(*args)
    return _loaded[key]
