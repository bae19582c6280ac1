"""Token ids of whole texts by a public tokenizer file, with a bounded memo of white-space separated chunks.

A tokenizer is separable if its normalizer only composes, lower-cases and folds white space and its splitter is a
byte-level one that never lets a token span white space or mix letters with marks. For those the ids of a text are the ids of its chunks in order, so a chunk is encoded once per
worker and looked up afterwards. Any other tokenizer file gets whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: Chunks that a worker remembers; beyond, it forgets all and starts again. Bounds its memory, not its input.
MEMO_CHUNKS = 1_000_000

#: Normalizers that act on each chunk alone.
LOCAL_NORMALIZERS = {"NFC", "NFD", "Lowercase"}

#: Letters that composition leaves alone and that lower-case one to one, and marks that never compose nor contract.
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "!-&(-/:-@\\[-`{-~"
WORD_MARKS = re.compile(f"([{LETTERS}]+)([{MARKS}]*)")
#: Bytes of ASCII letters, of U+00C0 to U+00FF, of blanks, full stops and commas.
PLAIN_BYTES = bytes({*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0), *b" \n.,"})


def _plain(raw: bytes) -> bool:
    """Whether a text has nothing but letters of LETTERS, blanks and single full stops and commas."""
    return not raw.translate(None, PLAIN_BYTES) and not any(x in raw for x in (b"..", b",,", b".,", b",.", b"\xc3\x97", b"\xc3\xb7"))


def _byte_letters() -> dict[int, str]:
    """Byte-level splitters write a byte as itself where Latin-1 can print it, else as the next code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class _Memo(dict):
    """Ids by chunk. A run of plain letters goes straight to the library's model, anything odd through its whole chain."""

    def __init__(self, tokenizer):
        self._tokenizer, self._model, self._bytes = tokenizer, tokenizer.model, _byte_letters()
        self[b""] = b""

    def __missing__(self, raw: bytes) -> bytes:
        if len(self) >= MEMO_CHUNKS:
            self.clear()
            self[b""] = b""
        if not (plain := WORD_MARKS.fullmatch(chunk := raw.decode())):
            ids = self._tokenizer.encode(chunk, add_special_tokens=False).ids
        elif plain[2]:
            found = self[plain[1].encode()] + self[b" " + plain[2].encode()]
            if len(self) < MEMO_CHUNKS // 2:
                self[raw] = found
            return found
        elif (low := chunk.lower()) != chunk:
            found = self[raw] = self[low.encode()]
            return found
        else:
            ids = [x.id for x in self._model.tokenize("".join(map(self._bytes.__getitem__, raw)))]
        found = self[raw] = array("I", ids).tobytes()
        return found


def _separable(config: dict) -> bool:
    normalizer, splitter = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}
    parts = normalizer.get("normalizers", [normalizer] if normalizer else [])
    for x in parts:
        folds = x["type"] == "Replace" and x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " "
        if x["type"] not in LOCAL_NORMALIZERS and not folds:
            return False
    kinds = {x["type"] for x in parts} | {x["type"] for x in splitter.get("pretokenizers", [])}
    if not {"Lowercase", "ByteLevel"} <= kinds or config["model"]["type"] != "BPE" or any(x.get("add_prefix_space") for x in splitter.get("pretokenizers", [])):
        return False
    first = (splitter.get("pretokenizers") or [splitter])[0]
    pattern = first.get("pattern", {}).get("Regex", "")
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and pattern.endswith("[^\\s\\p{L}\\p{N}]+") and all(not t["lstrip"] and not t["rstrip"] and " " not in t["content"] for t in config.get("added_tokens", []))


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.separable = _separable(json.load(f))
        self._memo = _Memo(self._tokenizer)

    def raw(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.separable:
            return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        raw = text.encode("utf-8", "replace")
        if _plain(raw):
            raw = raw.replace(b".", b" .").replace(b",", b" ,")
        if b"<|" not in raw:  # else an upper-case one could become a control string
            raw = raw.lower()
        return b"".join(map(self._memo.__getitem__, raw.replace(b"\n", b" ").split(b" ")))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and file, kept over the tasks that the worker runs."""
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
