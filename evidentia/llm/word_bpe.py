"""What a byte-level BPE file with word ends says: how texts fall into pre-tokens, and the merges.

Supported are files whose normalizer is made of NFC, white-space replacement and lower case, whose
pre-tokenizer is one inverted split followed by the byte alphabet, and whose model marks word ends.
No match of the split crosses white space, and none of the normalizers joins characters across
it, so a text is the sequence of its white-space-separated chunks, and each chunk can be handled
once and remembered.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import regex

#: Characters with Unicode's White_Space property. Python's split() also takes U+001C to U+001F.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPLIT = re.compile(f"[{SPACES}]+")
_ODD = re.compile("[\x1c-\x1f]")
#: A tokenizer file is sent to every executor; a larger one is refused.
MOST_BYTES = 64 << 20


def byte_alphabet() -> list[str]:
    """The character for each byte: itself if printable in Latin-1, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def chunks(text: str) -> list[str]:
    return [c for c in _SPLIT.split(text) if c] if _ODD.search(text) else text.split()


class WordBpe:
    def __init__(self, source: bytes):
        spec = json.loads(source)
        model, split, level = spec["model"], *spec["pre_tokenizer"]["pretokenizers"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if (model["type"], model["end_of_word_suffix"], steps, split["invert"], level["type"], spec["decoder"]) != ("BPE", "</w>", ["NFC", "Replace", "Lowercase"], True, "ByteLevel", None):
            raise ValueError("the tokenizer file has a pipeline that is not supported")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.strings = {i: s for s, i in [*self.vocab.items(), *added.items()]}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        #: (left id, right id) -> (rank, id of both together); an earlier merge of the same pair is not replaced.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        alphabet = byte_alphabet()
        self.byte_id = [self.vocab[c] for c in alphabet]
        self.last_id = [self.vocab[c + "</w>"] for c in alphabet]

    def pre_tokens(self, chunk: str) -> Iterator[int | bytes]:
        """Ids of special strings, and the UTF-8 of every pre-token."""
        for k, part in enumerate(self.special.split(chunk) if self.special and "<" in chunk else [chunk]):
            if k % 2:
                yield self.added[part]
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part)
                # Character by character: lower() of a whole string treats the last sigma apart.
                part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
                for found in self.pattern.findall(part):
                    yield found.encode()

    def symbols(self, token: bytes) -> list[int]:
        """The ids from which merging starts."""
        own = self.byte_id
        return [*[own[b] for b in token[:-1]], self.last_id[token[-1]]]


class Remembered(dict):
    """A dictionary of bounded size: entries not used while ``most`` others came are forgotten."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        """The older entry, moved among the newer ones; None if there is none."""
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


@functools.lru_cache(maxsize=2)
def loaded(source: bytes) -> WordBpe:
    return WordBpe(source)


def read_source(path: str) -> bytes:
    with open(path, "rb") as f:
        source = f.read(MOST_BYTES + 1)
    if len(source) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return source
