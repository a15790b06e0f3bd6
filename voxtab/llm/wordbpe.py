"""Ids of a word-end BPE vocabulary (a `tokenizers` JSON file), cached by white-space-delimited chunk.

No token of such a vocabulary spans white space, so a text's ids are its chunks'
ids one after another. New chunks are encoded together: those of plain Latin
characters through `tiktoken`, over the same merges with the word end written as
one more byte; all others through `tokenizers` itself. Tests hold both against
`tokenizers` over whole texts.
"""

from __future__ import annotations

import json
import os

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Marks a word's end; chunks that hold it go through `tokenizers`.
END = "\0"
PLAIN = regex.compile("[\u0001-ɏ]+")
#: Chunks whose ids a worker remembers; the cache starts anew beyond them.
CACHE_CHUNKS = 250_000


def _byte_letters() -> dict[str, int]:
    """Letter of a byte-level vocabulary -> byte: printable bytes stand for themselves, others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    def __init__(self, path: str):
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        suffix = model["end_of_word_suffix"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.special = tuple(t["content"] for t in spec["added_tokens"])

        def raw(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(letters[c] for c in (token[: -len(suffix)] if end else token)) + END.encode() * end

        vocab = model["vocab"]
        merged = [raw("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        of_bytes = {raw(t): i for t, i in vocab.items() if t not in self.special}
        single = [bytes([b]) for b in range(256)]
        ended = [x + END.encode() for x in single]
        order = list(dict.fromkeys([*single, *ended, *merged]))
        self.id_of = np.array([of_bytes.get(x, -1) for x in order], np.int64)
        self.ends = np.array([x.endswith(END.encode()) for x in order])
        self.fast = tiktoken.Encoding("word-end", pat_str=f"[^{END}]+{END}", mergeable_ranks={x: i for i, x in enumerate(order)}, special_tokens={})
        self.cache: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> None:
        plain, parts, counts, other = [], [], [], []
        for c in chunks:
            body = c[:-1] if c[-1] in ",." else c
            if body.isascii() and body.isalpha():  # most chunks: letters, then perhaps one mark
                parts.append(body.lower())
                if body is not c:
                    parts.append(c[-1])
                plain.append(c)
                counts.append(1 + (body is not c))
            elif PLAIN.fullmatch(c) and "<|" not in c:
                low = self.words(c.lower())
                plain.append(c)
                parts += low
                counts.append(len(low))
            else:
                other.append(c)
        if parts:
            ranks = np.array(self.fast.encode_ordinary(END.join(parts) + END), np.int64)
            stops = np.concatenate([[0], np.flatnonzero(self.ends[ranks]) + 1])
            cuts = stops[np.concatenate([[0], np.cumsum(counts)])] * 4
            ids = self.id_of[ranks]
            if ids.min() < 0:
                raise ValueError("a merge gave a token that the vocabulary lacks")
            data = ids.astype("<u4").tobytes()
            self.cache.update((c, data[a:b]) for c, a, b in zip(plain, cuts[:-1].tolist(), cuts[1:].tolist()))
        else:
            self.cache.update((c, b"") for c in plain)
        for c, e in zip(other, self.slow.encode_batch(other, add_special_tokens=False)):
            self.cache[c] = np.array(e.ids, "<u4").tobytes()

    def encode_bytes(self, texts: list[str | None], together: int = 64) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; none for null."""
        out = []
        for k in range(0, len(texts), together):
            if len(self.cache) > CACHE_CHUNKS:
                self.cache.clear()
            split = [chunks_of(t) if t else [] for t in texts[k : k + together]]
            found = [list(map(self.cache.get, chunks)) for chunks in split]
            lacking = [i for i, x in enumerate(found) if None in x]
            if lacking:
                self._learn(list({c for i in lacking for c, x in zip(split[i], found[i]) if x is None}))
                for i in lacking:
                    found[i] = map(self.cache.__getitem__, split[i])
            out += map(b"".join, found)
        return out


def chunks_of(text: str) -> list[str]:
    """Pieces between white space. str.split() also parts at 0x1C-0x1F, which the vocabulary takes for characters."""
    if any(x in text for x in "\x1c\x1d\x1e\x1f"):
        return regex.split(r"[ \t\r\n]+", text.strip(" \t\r\n"))
    return text.split()


_LOADED: dict[str, WordBpe] = {}


def vocabulary_path(name: str) -> str:
    """A file by its own path, or by its name among the public tokenizers of this machine."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def word_bpe(name: str) -> WordBpe:
    """The encoder of a vocabulary file; a worker loads it once."""
    if name not in _LOADED:
        _LOADED[name] = WordBpe(vocabulary_path(name))
    return _LOADED[name]
