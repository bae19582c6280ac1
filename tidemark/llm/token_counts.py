"""Operator 11: token counts. Batch encoding in Arrow functions that return lengths only.

A worker takes the texts of an Arrow batch, cuts them into pieces at boundaries that the tokenizer's own splitter makes in
any surroundings, and encodes the different pieces that it doesn't remember in batches of about BATCH_BYTES bytes, so that a
batch costs the same whether it holds a thousand short texts or a part of a long one. Only counts leave the library's batch
and the worker. A text's count is the sum over its pieces.

Safe boundaries, for byte-level BPE files with the usual word pattern and no normalizer: before a blank that follows
anything but white space (no word of the pattern holds a blank after another character); in a piece of more than LONG_CHARS
characters also between a letter or digit and a punctuation mark that can't belong to a special string. A longer run of
letters alone is one word of the model and stays whole. Files of any other make, and sentencepiece models, get whole texts.
Special strings inside texts are handled as the library does by default.

Nulls and empties: a null or empty text has 0 bytes and 0 tokens; a null doc_id stays. Ties and repeated rows: each row is
counted by itself. Very long texts are counted whole. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship, whole_text

#: Bytes (about) of a batch that the library encodes, and characters of the texts that are worked on at a time.
BATCH_BYTES, SLICE_CHARS = 1 << 20, 1 << 23
#: Pieces that a worker remembers; beyond, it forgets all. Only pieces of up to MEMO_CHARS characters are remembered.
MEMO_PIECES, MEMO_CHARS = 1_000_000, 64
#: Pieces above it are cut further.
LONG_CHARS = 1 << 16
LIMIT = 512

_LETTERS = "A-Za-z0-9À-ÖØ-öø-ɏЀ-џぁ-ゖァ-ヺ一-龥가-힣"
_BEFORE_BLANK = re.compile(r"(?<=\S)(?= )")
_BLANK_AFTER_SPACE = re.compile(r"\s ")
_AT_MARK = re.compile(f"(?<=[{_LETTERS}])(?=[.,;:!?()、。，])")


def _cuttable(config: dict) -> bool:
    """Whether the file's splitter makes the boundaries that this module cuts at, and no special string holds any."""
    splitter, added = config.get("pre_tokenizer") or {}, config.get("added_tokens") or []
    plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space") and not config.get("normalizer") and config["model"]["type"] == "BPE" and not config["model"].get("ignore_merges")
    return plain and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"[\s.,;:!?()、。，]", t["content"])) for t in added)


def pieces(text: str) -> list[str]:
    """The parts of a text between safe boundaries; in all but the first, the leading blank is left out."""
    parts = text.split(" ") if not _BLANK_AFTER_SPACE.search(text) else [p if i == 0 else p[1:] for i, p in enumerate(_BEFORE_BLANK.split(text))]
    return parts


def _long(piece: str) -> list[str]:
    """A long piece, cut at marks into parts of about LONG_CHARS characters."""
    if len(piece) <= LONG_CHARS:
        return [piece]
    out, start = [], 0
    for m in _AT_MARK.finditer(piece):
        if m.start() - start >= LONG_CHARS:
            out.append(piece[start : m.start()])
            start = m.start()
    return [*out, piece[start:]]


class Counter:
    """Token counts by one tokenizer file, for a worker process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._starts: dict[str, int] = {}
        self._known: dict[str, int] = {}
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model, self.cuttable = SentencePieceProcessor(model_file=path), False
            self._lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.cuttable = _cuttable(json.load(f))
        self._lengths = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, texts: Iterable[str]) -> Iterator[int]:
        """Lengths of texts, encoded in batches of about BATCH_BYTES."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t) if t.isascii() else len(t.encode())
            if size >= BATCH_BYTES:
                yield from self._lengths(held)
                held, size = [], 0
        if held:
            yield from self._lengths(held)

    def counts(self, texts: list[str]) -> list[int]:
        if not self.cuttable:
            return list(self._encoded(texts))
        cut = [pieces(t) for t in texts]
        starts = [parts.pop(0) for parts in cut]  # the only pieces without a blank before them
        new = [set(starts).difference(self._starts), set().union(*cut).difference(self._known)]
        parts = [[_long(p) for p in new[0]], [_long(" " + p) for p in new[1]]]
        lengths = self._encoded(x for kind in parts for p in kind for x in p)
        for known, keys, kind in zip((self._starts, self._known), new, parts, strict=True):
            known.update((key, sum(next(lengths) for _ in p)) for key, p in zip(keys, kind, strict=True))
        out = [self._starts[s] + sum(map(self._known.__getitem__, c)) for s, c in zip(starts, cut, strict=True)]
        for known, keys in zip((self._starts, self._known), new, strict=True):
            for key in keys:
                if len(key) > MEMO_CHARS:
                    del known[key]
            if len(known) > MEMO_PIECES:
                known.clear()
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per worker process and file, kept over its tasks."""
    return Counter(path)


def _runner(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = counter(path)
        for b in batches:
            out, held, size = [], [], 0
            for t in b.column("text"):
                held.append(t.as_py())
                size += len(held[-1])
                if size >= SLICE_CHARS:
                    out += mine.counts(held)
                    held, size = [], 0
            out += mine.counts(held) if held else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(out, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) of each row; one narrow pass, no shuffle."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.octet_length(whole_text()).cast("long").alias("n_bytes"), whole_text().alias("text"))
    out = rows.mapInArrow(_runner(tokenizer or default_tokenizer()), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
