"""Token counts of whole texts, as a tokenizer library gives them.

Texts of more than ``chunk_chars`` characters are encoded in overlapping chunks with offsets, so that
one encoding never holds a huge document.  Neighbours are spliced where both have a boundary between
pre-tokens.  Such a place is proven stable: the pre-tokenizer reads from left to right and looks ahead
only, so from a place where both began a pre-token they agree for good; and the left chunk's boundary is
the true one if it lies before the chunk's end by more than the longest added token.  Where an overlap
holds no common boundary (a run of one kind of character), it is doubled, and beyond a whole chunk the
chunk is doubled, in the worst case up to the whole text.

Shorter texts are summed over segments between blank-led words.  A pre-token holds a space only at its
head or inside a run of white space, so a place between a non-space and a space is always a boundary;
equal segments are encoded once per worker.

Defined results: a null text counts as empty and has 0 bytes and tokens; repeated rows and null ids
stay; an empty table gives no rows; other columns are ignored.  Special strings inside texts are
handled as the library does by default.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm.batches import map_columns, raw_texts

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int, n_widened int"
CHUNK_CHARS, OVERLAP_CHARS = 32_768, 512
KEPT_SEGMENTS = 500_000  # size of a worker's memory of segments; it is emptied when full
_SPACE_RUN = re.compile(r"\s ")


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def boundaries(tokenizer, text: str) -> tuple[dict[int, int], int]:
    """Starts of pre-tokens with the number of tokens before each, and the number of all tokens."""
    encoding = tokenizer.encode(text, add_special_tokens=False)
    starts, last, end = {}, -1, 0
    for n, (word, (a, b)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if (word is None or word != last) and a == end:
            starts[a] = n
        last, end = word, b
    return starts, len(encoding.ids)


def spliced_count(
    tokenizer, text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS
) -> tuple[int, int, int]:
    """Tokens of a huge text, number of chunks encoded, number of overlaps widened."""
    margin = 1 + max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)
    total, chunks, widened = 0, 1, 0
    begin, size = 0, chunk_chars
    left, n_left, before = *boundaries(tokenizer, text[:size]), 0
    left_from = 0  # the chunk is right from here on; `before` of its tokens lie in front
    while begin + size < len(text):
        end, overlap, joint = begin + size, overlap_chars, None
        while joint is None and overlap < size:
            start = end - overlap
            right, n_right = boundaries(tokenizer, text[start : start + chunk_chars])
            chunks += 1
            stable = [p for p in right if left_from < p + start < end - margin and p + start - begin in left]
            if stable:
                joint = max(stable) + start
            else:
                overlap, widened = overlap * 2, widened + 1
        if joint is None:
            size, widened, chunks = size * 2, widened + 1, chunks + 1
            left, n_left = boundaries(tokenizer, text[begin : begin + size])
            before = left[left_from - begin] if left_from else 0
            continue
        total += left[joint - begin] - before
        begin, size, left, n_left = start, chunk_chars, right, n_right
        before, left_from = right[joint - start], joint
    return total + n_left - before, chunks, widened


def segments(text: str) -> list[str]:
    """Pieces that can be encoded on their own: cut before a space that follows no white space."""
    if not _SPACE_RUN.search(text) and not text.startswith(" "):
        first, *rest = text.split(" ")
        return [first, *(" " + r for r in rest)]
    cuts = [m.start() + 1 for m in re.finditer(r"\S ", text)]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]


class SegmentCounts:
    """Tokens by segment, kept across the batches and tasks of one worker."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.known = tokenizer, {}

    def counts(self, split: list[list[str]]) -> list[int]:
        if len(self.known) > KEPT_SEGMENTS:
            self.known.clear()
        missing = list(set().union(*split) - self.known.keys())
        for a in range(0, len(missing), 4096):
            part = missing[a : a + 4096]
            encoded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update(zip(part, map(len, encoded), strict=True))
        return [sum(map(self.known.__getitem__, s)) for s in split]


@lru_cache(maxsize=2)
def segment_counts(path: str) -> SegmentCounts:
    return SegmentCounts(load_tokenizer(path))


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 1024,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``doc_id, text`` to byte and token counts, row for row, without a shuffle."""

    def work(batches: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        tokenizer, memory = load_tokenizer(tokenizer_path), segment_counts(tokenizer_path)
        for batch in batches:
            raw = raw_texts(batch["text"])
            whole = [r.decode() for r in raw]
            short = [i for i, t in enumerate(whole) if len(t) <= chunk_chars]
            tokens, chunks, widened = [0] * len(raw), [1] * len(raw), [0] * len(raw)
            for i, n in zip(short, memory.counts([segments(whole[i]) for i in short]), strict=True):
                tokens[i] = n
            for i in set(range(len(raw))) - set(short):
                tokens[i], chunks[i], widened[i] = spliced_count(
                    tokenizer, whole[i], chunk_chars, overlap_chars
                )
            yield {
                "doc_id": batch["doc_id"],
                "n_bytes": [len(r) for r in raw],
                "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens],
                "n_chunks": chunks,
                "n_widened": widened,
            }

    narrow = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return map_columns(narrow, SCHEMA, work)
