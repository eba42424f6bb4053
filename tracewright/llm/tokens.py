"""Token ids of a public byte-level BPE tokenizer.

Merging uses a rank queue instead of a scan for the lowest pair: positions of a linked list wait in one bucket per merge rank, a hierarchical
bitmap over the ranks tells the next rank by find-first-set, and entries whose pair has changed since are skipped. A pre-token of n bytes
takes O(n) queue steps, so very long ones (a line of thousands of equal signs) do no harm. All merges go through the queue; the new
pre-tokens of neighbouring texts share one, so short ones don't pay for it each. Pre-tokens repeat a lot, so their ids are remembered within a
task, up to ``REMEMBERED`` of them; that saves time and changes no result. A pre-token that is in the vocabulary as a whole needs no merge.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import spread

#: Fixed value: how byte-level BPE splits a text into pre-tokens.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
REMEMBERED = 300_000
#: New pre-tokens of so many characters of text share one queue.
TOGETHER = 400_000


class RankQueue:
    """Positions by rank, lowest rank first; ``size`` is the number of ranks.

    The bitmap has two levels or more: a bit of a level says whether the word of 256 bits below it holds any.
    """

    def __init__(self, size: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.levels: list[dict[int, int]] = []
        while size > 1:
            size = (size + 255) >> 8
            self.levels.append({})
        self.levels = self.levels or [{}]

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        for level in self.levels:
            bit = 1 << (rank & 255)
            rank >>= 8
            old = level.get(rank)
            if old:
                level[rank] = old | bit
                return
            level[rank] = bit

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions in the order of pushing; None if empty."""
        if not self.buckets:
            return None
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = at << 8 | (word & -word).bit_length() - 1
        k = at
        for level in self.levels:
            bit = 1 << (k & 255)
            k >>= 8
            left = level[k] ^ bit
            if left:
                level[k] = left
                break
            del level[k]
        return at, self.buckets.pop(at)


class Encoder:
    """Byte-level BPE by merge ranks: ``ranks`` maps each token's bytes to its id, which is also its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(self.size)
        self.known: dict[str, list[int]] = {}

    @classmethod
    def from_bytes(cls, file: bytes, pattern: str = PATTERN) -> Encoder:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}, pattern)

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one pre-token."""
        return self.merge_all([raw])[0]

    def merge_all(self, raws: list[bytes]) -> list[list[int]]:
        """The ids of each of several pre-tokens. They share one linked list and one queue, but no pair spans two of them."""
        get, push, pop = self.ranks.get, self.queue.push, self.queue.pop
        out: list[list[int] | None] = [None if (whole := get(raw)) is None else [whole] for raw in raws]
        part: list[bytes | None] = []
        for i, raw in enumerate(raws):
            if out[i] is None:
                at = len(part)
                part += [raw[k : k + 1] for k in range(len(raw))]
                part.append(None)  # the end of a pre-token joins nothing
                for k in range(len(raw) - 1):
                    r = get(raw[k : k + 2])
                    if r is not None:
                        push(r, at + k)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        while (top := pop()) is not None:
            rank, positions = top
            if len(positions) > 1:
                positions.sort()
            for i in positions:
                left = part[i]
                if left is None:
                    continue
                j = after[i]
                right = part[j]
                if right is None:
                    continue
                joined = left + right
                if get(joined) != rank:
                    continue  # stale: one of the two has been merged since
                part[i], part[j] = joined, None
                k = after[i] = after[j]
                before[k] = i
                right = part[k]
                if right is not None:
                    r = get(joined + right)
                    if r is not None:
                        push(r, i)
                h = before[i]
                if h >= 0:
                    left = part[h]
                    if left is not None:
                        r = get(left + joined)
                        if r is not None:
                            push(r, h)
        at, ranks = 0, self.ranks
        for i, raw in enumerate(raws):
            if out[i] is None:
                end = at + len(raw)
                out[i] = [ranks[p] for p in part[at:end] if p is not None]
                at = end + 1
        return out

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; null and empty texts have none, lone surrogates count as the replacement character."""
        out: list[list[int]] = []
        at = 0
        while at < len(texts):  # about TOGETHER characters at a time
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= TOGETHER):
                size += len(texts[end] or "")
                end += 1
            out += self._encode_some(texts[at:end])
            at = end
        return out

    def _encode_some(self, texts: list[str | None]) -> list[list[int]]:
        known, pieces = self.known, [self.split(t) if t else [] for t in texts]
        if len(known) >= REMEMBERED:
            known.clear()
        new = list({t for p in pieces for t in p if t not in known})
        known.update(zip(new, self.merge_all([t.encode("utf-8", "replace") for t in new]), strict=True))
        out = []
        for p in pieces:
            ids: list[int] = []
            for t in p:
                ids += known[t]
            out.append(ids)
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        return self.encode_all([text])[0]


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def token_ids(frame: DataFrame, row: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(row, ids): each row's token ids, without special tokens; an empty or null text has an empty list.

    The vocabulary is read once on the driver and travels with the tasks (under 1 MB), so executors need no copy of the file.
    """
    data = _file(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.from_bytes(data, pattern)
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for ids in encoder.encode_all(batch.column(1).to_pylist()):
                flat += ids
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["r", "ids"])

    kind = frame.schema[row].dataType.simpleString()
    read = frame.select(F.col(row).alias("r"), F.col(text).cast("string").alias("t"))
    return spread(read).mapInArrow(run, f"r {kind}, ids array<int>").withColumnRenamed("r", row)


def token_counts(frame: DataFrame, row: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(row, tokens): the number of ids alone."""
    data = _file(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.from_bytes(data, pattern)
        for batch in batches:
            sizes = [len(ids) for ids in encoder.encode_all(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["r", "tokens"])

    kind = frame.schema[row].dataType.simpleString()
    read = frame.select(F.col(row).alias("r"), F.col(text).cast("string").alias("t"))
    return spread(read).mapInArrow(run, f"r {kind}, tokens bigint").withColumnRenamed("r", row)
