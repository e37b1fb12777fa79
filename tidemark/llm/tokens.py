"""Token counts of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern that splits text before the merges of these ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Runs of white space that the pattern's look-ahead can't be trusted with: its matcher keeps a stack per character.
_BLANKS = re.compile(r"[ \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{5000,}")


def counter(ranks: str, pattern: str = PATTERN) -> Callable[[str | None], int]:
    """A function text -> number of tokens of a vocabulary, whose rank file is at ``ranks`` on every worker; of very long blank runs too, which are one piece but for their last character."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    encode, piece = encoding.encode_ordinary, encoding.encode_single_piece if hasattr(encoding, "encode_single_piece") else encoding._core_bpe.encode_single_piece

    def count(text: str | None) -> int:
        if not text:
            return 0
        if len(text) < 5000 or not (runs := list(_BLANKS.finditer(text))):
            return len(encode(text))
        n, at = 0, 0
        for m in runs:
            end = m.end() if m.end() == len(text) else m.end() - 1
            n += len(encode(text[at : m.start()])) + len(piece(text[m.start() : end].encode()))
            at = end
        return n + len(encode(text[at:]))

    return count


def token_counts(docs: DataFrame, text: str, ranks: str, pattern: str = PATTERN) -> DataFrame:
    """``docs`` with the text replaced by ``tokens``, a long; null and empty texts have 0.

    Texts are counted whole, in Arrow batches; special tokens in a text are ordinary text.
    """
    rest = [c for c in docs.columns if c != text]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(ranks, pattern)
        for b in batches:
            n = [of(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(n, pa.int64())], names=[*rest, "tokens"])

    kept = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes if c != text)
    return docs.select(*rest, F.col(text)).mapInArrow(count, f"{kept}, tokens long")
