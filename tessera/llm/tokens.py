"""Problem 8: encoding of the whole corpus with a public byte-level BPE tokenizer.

The vocabulary is read on the workers from a path (a parameter); nothing of it is kept in the repository. A piece of
text is encoded by a priority queue of merge ranks over a doubly linked list of symbols; entries that a merge has made
stale are skipped when they come up. Pieces recur, so each worker keeps those it has encoded.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces a worker keeps; when there are more it starts anew. It bounds memory, not results.
KEPT_PIECES = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def default_pattern() -> str:
    """The pattern of the installed public tokenizers that parts a text into pieces."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class Encoder:
    """Byte-level BPE over a file of `base64(token) rank` lines."""

    def __init__(self, path: str, pattern: str | None = None) -> None:
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.strings = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern or default_pattern()).findall
        self.kept: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        ends = list(range(1, n + 1))  # symbol i covers piece[i:ends[i]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        ranks = self.ranks.get
        queue: list[tuple[int, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n and (rank := ranks(piece[left : ends[right]])) is not None:
                heapq.heappush(queue, (rank, left, right, ends[right]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, left, right, end = heapq.heappop(queue)
            if not alive[left] or after[left] != right or ends[right] != end or not alive[right]:
                continue  # stale: one of the two symbols has been merged since
            ends[left], after[left] = end, after[right]
            alive[right] = False
            if after[right] < n:
                before[after[right]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : ends[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; none for an empty or null text."""
        out: list[int] = []
        if text:
            kept = self.kept
            for piece in self.pieces(text):
                ids = kept.get(piece)
                if ids is None:
                    if len(kept) >= KEPT_PIECES:
                        kept.clear()
                    ids = kept[piece] = tuple(self.merge(piece.encode("utf-8", "replace")))
                out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their strings put together."""
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str | None = None) -> Encoder:
    """One encoder for each worker and file."""
    return Encoder(path, pattern)


def _encode(key: str, text: str, path: str, pattern: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for value in batch.column(text).to_pylist():
                flat.extend(encode(value))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(key), ids], names=[key, "ids"])

    return run


def encode_table(texts: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids): the ids of each row's text, one row for each row of the input, in one pass without a shuffle.
    Empty and null texts have an empty list; texts of any length are encoded whole."""
    from pyspark.sql import types as T

    rows = texts.select(F.col(key), F.col(text))
    schema = T.StructType([rows.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_encode(key, text, path or vocabulary_path(), pattern), schema)
