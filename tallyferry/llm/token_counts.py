"""Token counts of whole texts; huge ones in overlapping chunks that are spliced where their tokens provably agree.

A text of more than a chunk is encoded chunk by chunk by the library, with the offsets of its tokens. Tokens near a cut may
be wrong, so chunks overlap and are spliced at a boundary that both have: white space behind RUN tokens that are the same at
the same offsets in both chunks. White space ends every word of this vocabulary's splitter and no merge reaches across it,
so behind such a boundary both encodings go on alike; the agreement before it shows that the left cut has worn off. Where an
overlap has no such boundary (a long run without white space), it is widened until it has, at last to the whole rest of the
text.

Texts of one chunk are counted per word instead: words between ASCII white space are encoded once per process, and the
numbers of their tokens kept in a table of bounded size, which for the same reason gives the library's counts. Null counts
as empty.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyferry.llm.arrays import pieces

MODEL = "word_bpe_49k.json"
CHUNK_CHARS = 1 << 14
OVERLAP_CHARS = 1 << 9
RUN = 3
_WHITE = frozenset(" \t\n\r\x0b\x0c")
_KEPT_WORDS = 1 << 18
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """The library's tokens of chunks, and its numbers of tokens of words, by a table of bounded size."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core only
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kept: dict[bytes, int] = {}

    def counts(self, texts: list[bytes]) -> list[int]:
        """Numbers of tokens of whole texts in UTF-8, from those of their words. A full table keeps the words of these texts."""
        words = [text.split() for text in texts]  # of bytes: at ASCII white space only
        due = set().union(*words)
        new = list(due - self.kept.keys())
        if len(self.kept) + len(new) > _KEPT_WORDS:
            self.kept = {w: self.kept[w] for w in due & self.kept.keys()}
        for k in range(0, len(new), 10_000):
            part = new[k : k + 10_000]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            self.kept.update((word, len(got.ids)) for word, got in zip(part, found, strict=True))
        return [sum(map(self.kept.__getitem__, own)) for own in words]

    def encode(self, text: str, begin: int, end: int) -> Chunk:
        got = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        return Chunk(begin, got.offsets, got.ids)


@dataclass
class Chunk:
    """The tokens of a chunk that begins at character `begin` of its text, and their places in the chunk."""

    begin: int
    offsets: list[tuple[int, int]]
    ids: list[int]

    def end_of(self, k: int) -> int:
        return self.begin + self.offsets[k - 1][1]

    def run(self, k: int) -> list[tuple[int, int, int]]:
        """(start, end, token) in the text of the RUN tokens before the k-th."""
        return [(self.begin + s, self.begin + e, token) for (s, e), token in zip(self.offsets[k - RUN : k], self.ids[k - RUN : k], strict=True)]


def _splice(left: Chunk, first: int, right: Chunk, text: str, end: int) -> tuple[int, int] | None:
    """Indexes in `left` (from its token `first` on) and `right` of the first tokens behind a boundary that both chunks
    prove, if there is one.

    White space is the boundary; the RUN tokens before it must agree and lie off both cuts: right's begin, and left's end.
    """
    for j in range(RUN, len(right.ids) + 1):
        at = right.end_of(j)
        if at >= end:
            break
        # behind white space only, and where a character is several tokens, behind the last of them
        if text[at] not in _WHITE or (j < len(right.ids) and right.begin + right.offsets[j][0] <= at):
            continue
        k = bisect_right(left.offsets, at - left.begin, key=lambda x: x[1])
        if k >= first + RUN and right.offsets[j - RUN][0] > 0 and left.run(k) == right.run(j):
            return k, j
    return None


def spliced(encoder: WordEncoder, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[tuple[int, int, list[int]]]:
    """The tokens of a text of any length, from overlapping chunks: (start, end, tokens) of one part after the other."""
    end = min(chunk, len(text))
    left, first, done = encoder.encode(text, 0, end), 0, 0
    while end < len(text):
        stop, wide = min(len(text), end + chunk), overlap
        while True:
            begin = max(left.begin, end - wide)
            right = encoder.encode(text, begin, stop)
            if begin == left.begin:  # nothing is left to widen: the chunk itself is made longer, behind what is out already
                left, first = right, bisect_left(right.offsets, done - begin, key=lambda x: x[0])
                break
            if joint := _splice(left, first, right, text, end):
                yield done, left.end_of(joint[0]), left.ids[first : joint[0]]
                done = left.end_of(joint[0])
                left, first = right, joint[1]
                break
            wide *= 2
        end = stop
    yield done, len(text), left.ids[first:]


def token_counts(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048, chunk: int = CHUNK_CHARS) -> DataFrame:
    """All columns of `docs`, and: _n_bytes (UTF-8), _n_tokens, _over_limit (more tokens than `limit`).

    Tokens are those of the library for the whole text, without added special tokens. Runs where the rows are.
    """
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(path, WordEncoder(path))
        for batch in batches:
            sizes, counts = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for at, to, data, bounds in pieces(batch.column(batch.schema.names.index(text_col))):
                sizes[at:to] = np.diff(bounds)
                texts = [bytes(data[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                short = []
                for k, raw in enumerate(texts):
                    if len(raw) > chunk and len(text := raw.decode("utf-8", "replace")) > chunk:
                        counts[at + k] = sum(len(ids) for _, _, ids in spliced(encoder, text, chunk))
                    else:
                        short.append(k)
                counts[[at + k for k in short]] = encoder.counts([texts[k] for k in short])
            arrays = [*batch.columns, pa.array(sizes), pa.array(counts), pa.array(counts > limit)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "_n_bytes", "_n_tokens", "_over_limit"])

    return docs.mapInArrow(task, f"{own}, _n_bytes long, _n_tokens long, _over_limit boolean")
