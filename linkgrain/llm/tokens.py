"""Operator 3: token counts, lengths only, from Arrow batches."""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where a byte-level BPE text may be cut: before white space after anything else, and
#: between a letter and a digit, where a pre-token always begins.
SAFE = re.compile(r"(?<=\S)(?=[ \t\r\n])")
INNER = regex.compile(r"(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
#: Pieces of more characters than this are cut inside words too.
LONG_PIECE = 1 << 14
BATCH_BYTES = 1 << 18
CACHE_BYTES = 32 << 20


def cutter(tokenizer):
    """A function that cuts a text at safe boundaries, none inside a special string; a text stays whole where the vocabulary has other pre-tokens."""
    made = json.loads(tokenizer.to_str())
    before = made["pre_tokenizer"] or {}
    if made["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return lambda text: [text] if text else []
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in made["added_tokens"]):
        return lambda text: [text] if text else []
    special = re.compile("|".join(re.escape(x["content"]) for x in made["added_tokens"])) if made["added_tokens"] else None
    return lambda text: pieces(text, special)


def pieces(text: str, special: re.Pattern | None) -> list[str]:
    out: list[str] = []
    kept = [m.span() for m in special.finditer(text)] if special else []
    at = 0
    for start, end in [*kept, (len(text), len(text))]:
        for piece in SAFE.split(text[at:start]):
            if len(piece) > LONG_PIECE:
                out += [x for x in INNER.split(piece) if x]
            elif piece:
                out.append(piece)
        if end > start:
            out.append(text[start:end])
        at = end
    return out


def _counter(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    cut_up = cutter(tokenizer)
    known: dict[str, int] = {}
    held = 0

    def encode(found: list[str]) -> None:
        """Puts the lengths of ``found`` in ``known``, in batches of about BATCH_BYTES."""
        batch, size = [], 0
        for piece in found:
            n = len(piece.encode())
            if batch and size + n > BATCH_BYTES:
                counted(batch)
                batch, size = [], 0
            batch.append(piece)
            size += n
        if batch:
            counted(batch)

    def counted(batch: list[str]) -> None:
        nonlocal held
        known.update(zip(batch, map(len, tokenizer.encode_batch_fast(batch, add_special_tokens=False)), strict=True))
        held += sum(map(len, batch))

    def count(texts: list[str]) -> list[int]:
        nonlocal held
        cut = [cut_up(text) for text in texts]
        encode(list({x for own in cut for x in own if x not in known}))
        out = [sum(map(known.__getitem__, own)) for own in cut]
        if held > CACHE_BYTES:
            known.clear()
            held = 0
        return out

    return count


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Lengths are those of the ``tokenizers`` library for the file ``vocabulary``
    without added special tokens, special strings inside texts as its default
    has it, without truncation.  Byte-level BPE texts are cut at safe boundaries,
    so of a long text only a run of letters without white space or digits
    reaches the encoder whole; only lengths leave the task.  Pieces are encoded
    in batches of about BATCH_BYTES, and a task remembers their lengths.

    Null or empty texts have 0 bytes and 0 tokens; repeated rows each give a
    row; an empty table gives an empty table; other columns are not read.
    """

    def run(batches):
        count = _counter(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            texts = [x or "" for x in texts]
            n_bytes, n_tokens, at = [len(x.encode()) for x in texts], [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + n_bytes[to] <= 4 * BATCH_BYTES):
                    size += n_bytes[to]
                    to += 1
                n_tokens += count(texts[at:to])
                at = to
            n = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), n, pa.array([x > limit for x in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_tokens")], T.StructField("over_limit", T.BooleanType())])
    return rows.mapInArrow(run, schema)
