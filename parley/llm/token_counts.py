"""Token counts of whole texts, by batches of equal bytes in Arrow functions that return lengths only.

A long text is cut where the tokenizer cannot join what stands on both sides, so its pieces'
counts add up to its own and no call holds more than a piece beyond the batch's bytes:

- word tokenizers (``.json``) drop white space and give every digit a token of its own, so a text
  may be cut before ASCII white space and between a digit and an ASCII letter or digit;
- piece models (``.model``) begin every text with a blank and join nothing across a blank behind
  another sign, so a single blank between two visible ASCII signs may be cut out.

With the default tokenizer the ids of words are remembered, as in packing, so a word goes to the
library again only after it was forgotten. Other tokenizers encode every piece.

A text without such a place, as one word of any length, is one piece.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from parley.llm.common import as_bytes
from parley.llm.packing import WordIds

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Bytes that are encoded in one call, and bytes from which on a text is cut.
BATCH, PIECE = 1 << 20, 1 << 16
#: Bytes of an id as ``WordIds`` gives it.
ID_BYTES = 4
#: A cut ends at the first group, and what follows it begins there.
WORD_CUT = re.compile(rb"(?=[\x09-\x0D ])|(?<=[0-9])(?=[0-9A-Za-z])")
PIECE_CUT = re.compile(rb"(?<=[!-~]) (?=[!-~])")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def counted(documents: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of ``documents``.

    Null and empty texts have no bytes and no tokens. Rows that repeat, or have no doc_id, are each
    counted; other columns are not read, whatever their names. Texts of any length are counted
    whole. Bytes that are no UTF-8 count as U+FFFD. ``tokenizer`` is the path of a ``.json`` or
    ``.model`` file that tasks can read.
    """
    path = tokenizer or tokenizer_path()

    def run(batches):
        lengths, cut = _library(path)
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.zeros(len(texts), np.int64)
            for owners, pieces in _balanced(texts, cut):
                np.add.at(counts, owners, lengths(pieces))
            columns = [batch.column("doc_id"), pa.array(sizes), pa.array(counts), pa.array(counts > limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return documents.select("doc_id", as_bytes("text").alias("text")).mapInArrow(run, schema)


def _library(path: str) -> tuple[Callable[[list[str]], list[int]], re.Pattern]:
    """What counts the tokens of some texts, and where its texts may be cut."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = Tokenizer.from_file(path)
        words.no_truncation()
        words.no_padding()
        _same(lambda text: words.encode(text, add_special_tokens=False).ids, "a 1b", ["a", " 1", "b"], path)
        if os.path.basename(path) == TOKENIZER:
            known = WordIds(path)
            return lambda texts: [len(ids) // ID_BYTES for ids in known.of(texts)], WORD_CUT
        return lambda texts: list(map(len, words.encode_batch_fast(texts, add_special_tokens=False))), WORD_CUT
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if any("▁" in model.id_to_piece(n).lstrip("▁") for n in range(model.vocab_size())):
            raise ValueError(f"{path} has pieces that reach across a blank")
        _same(model.encode, "a a", ["a", "a"], path)
        return lambda texts: list(map(len, model.encode(texts, num_threads=1))), PIECE_CUT
    raise ValueError(f"neither .json nor .model: {path}")


def _same(encode: Callable[[str], list[int]], whole: str, parts: list[str], path: str) -> None:
    """Refuses a tokenizer for which cutting changes the tokens."""
    if encode(whole) != [number for part in parts for number in encode(part)]:
        raise ValueError(f"texts cannot be cut for {path}")


def pieces_of(text: bytes, cut: re.Pattern, most: int = PIECE) -> Iterator[bytes]:
    """A text cut at the first safe place behind every ``most`` bytes."""
    start = 0
    while len(text) - start > most and (found := cut.search(text, start + most)):
        yield text[start : found.start()]
        start = found.end()
    yield text[start:] if start else text


def _balanced(texts: pa.Array, cut: re.Pattern, most: int = BATCH) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces and the rows they come from, in batches of about ``most`` bytes."""
    owners, pieces, size = [], [], 0
    for row, text in enumerate(texts):
        for piece in pieces_of(text.as_py() or b"", cut):
            if not piece:
                continue
            owners.append(row)
            pieces.append(piece.decode(errors="replace"))
            size += len(piece)
            if size >= most:
                yield owners, pieces
                owners, pieces, size = [], [], 0
    if pieces:
        yield owners, pieces
