"""Token ids of whole texts from cached units: a word with the space or line break before it.

The byte-level pre-tokenizer never joins characters across the start of such a unit, as long as
every white-space character of a text is one space or line break between two words. Texts of
that form are cut into units, whose ids a worker keeps; all other texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

#: Units after which a worker's newer half becomes the older one; what is not asked for again goes with the next turn.
CACHE_UNITS = 500_000
#: Characters that are encoded together when new units are learned.
_TOGETHER = 500_000
#: A unit of letters, digits and marks whose classes every Unicode version agrees on, without apostrophes, and its
#: runs, which are what the pre-tokenizer cuts it into.
_SIMPLE = re.compile("[!-&(-~ªµºÀ-ÖØ-öø-ÿ]+").fullmatch
_RUNS = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\\[-`{-~]+").findall
#: At the start of a key: the unit opens its text and has nothing before it.
FIRST = "\x00"


def units(text: str) -> list[str] | None:
    """Keys of a text's units: ``w`` stands for a space and ``w``, ``\\nw`` for itself; None where the text has to be encoded whole."""
    if text.replace("\n", " ") != " ".join(text.split()) or FIRST in text or not text.isascii() and ("᠎" in text or "▁" in text):
        return None
    return text.replace("\n", " \n").split(" ")


def portions(keys: list[str]):
    """Keys in lists of about ``_TOGETHER`` characters."""
    out, size = [], 0
    for k in keys:
        out.append(k)
        size += len(k) + 1
        if size >= _TOGETHER:
            yield out
            out, size = [], 0
    if out:
        yield out


def byte_table() -> dict[str, int]:
    """Byte of each character in which a byte-level vocabulary is written: printable ones stand for themselves, the others for 256 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level tokenizer, its entries' bytes, and ids by units. ``plain``: names of special tokens are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain
        self.encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        about = json.loads(self.tok.to_str())
        pre, added = about.get("pre_tokenizer") or {}, [x["content"] for x in about.get("added_tokens", [])]
        self.named = [] if plain else added
        self.by_units = not about.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        vocabulary, to_byte = self.tok.get_vocab(), byte_table()
        self.size = max(vocabulary.values()) + 1
        self.bytes = [b""] * self.size
        for t, i in vocabulary.items():
            self.bytes[i] = t.encode() if t in added else bytes(to_byte[c] for c in t)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.letters = {b: c for c, b in to_byte.items()}  # for str.translate
        self.core, self.space = self.tok.model, self.letters[32]
        self.line = self.whole("\n").tolist() if self.by_units else []

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.encode([text], add_special_tokens=False)[0].ids, np.int64)

    def unit(self, key: str) -> list[int]:
        """Ids of a unit: by the model alone where its runs are plain, else by the whole tokenizer."""
        if key.isascii() and key.isalpha():  # most of them
            return [t.id for t in self.core.tokenize(self.space + key)]
        head, word = (key[0], key[1:]) if key[:1] in ("\n", FIRST) else (" ", key)
        if not _SIMPLE(word):
            # An opening unit stands behind a line break, whose id is then taken off.
            ids = self.whole((head if head == " " else "\n") + word).tolist()
            return ids[len(self.line) :] if head == FIRST else ids
        ids = self.line.copy() if head == "\n" else []
        for run in [word] if word.isalpha() else _RUNS(word):
            run = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
            ids += [t.id for t in self.core.tokenize(self.space + run if head == " " else run)]
            head = ""
        return ids

    def units(self, text: str) -> list[str] | None:
        return None if not self.by_units or any(x in text for x in self.named) else units(text)


class _Learned(dict):
    """Units' ids as little-endian bytes, learned when they are first asked for; frequent ones stay."""

    def __init__(self, unit, code: str):
        super().__init__()
        self.unit, self.older = unit, {}
        self.pack = [struct.Struct(f"<{n}{code}").pack for n in range(64)]
        self.long = lambda ids: struct.pack(f"<{len(ids)}{code}", *ids)

    def __missing__(self, key: str) -> bytes:
        out = self.older.get(key)
        if out is None:
            ids = self.unit(key)
            out = self.pack[len(ids)](*ids) if len(ids) < 64 else self.long(ids)
        self[key] = out
        return out

    def turn(self) -> None:
        if len(self) > CACHE_UNITS:
            self.older = dict(self)
            self.clear()


class UnitIds:
    """Ids of texts as bytes of one integer type, by cached units."""

    def __init__(self, path: str, dtype: str | None = None):
        """``dtype`` is <u4 or <u2, by default the smaller one that the vocabulary allows."""
        self.model = ByteLevel(path)
        self.dtype = np.dtype(dtype or ("<u2" if self.model.size <= 1 << 16 else "<u4"))
        self.cache = _Learned(self.model.unit, {2: "H", 4: "I"}[self.dtype.itemsize])

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: none)."""
        self.cache.turn()
        get, out = self.cache.__getitem__, []
        for t in texts:
            s = self.model.units(t) if t else []
            if s:
                s[0] = FIRST + s[0]
            out.append(self.model.whole(t).astype(self.dtype).tobytes() if s is None else b"".join(map(get, s)))
        return out
