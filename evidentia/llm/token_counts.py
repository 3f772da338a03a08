"""Token counts of whole texts, by merging many pre-tokens at once.

The pre-tokens that a batch has and the worker has not counted before lie end to end in one numpy
array of symbols, with an array that says which pre-token each belongs to. In every round each
pre-token's lowest-ranked adjacent pair is found, and all its places are merged in all pre-tokens
simultaneously; of overlapping places every other one, from the left. A merge that uses a symbol
always ranks after the merge that makes it (checked when the file is loaded), so this equals
merging place by place. A pre-token without a mergeable pair leaves; what survives is its count.

No shuffles; a worker remembers a fixed number of chunks. Defined results: a null text is an
empty one with no tokens; n_bytes is the length in UTF-8; a text of any length is counted whole, and
a pre-token of any length too; equal texts and repeated rows get equal counts, and each row, null ids
too, has its own; an empty table gives an empty result; columns other than doc_id and text give way.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidentia.llm.common import bounded_batches
from evidentia.llm.word_bpe import Remembered, WordBpe, chunks, loaded, read_source

REMEMBERED = 400_000
LONG = 64
#: Bytes of pre-tokens that are merged together.
TOGETHER = 1 << 20
NEVER = np.int32(2**31 - 1)


class ArrayMerger:
    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.span = max(bpe.strings) + 1
        made = {}
        for (a, b), (rank, new) in bpe.merges.items():
            made.setdefault(new, rank)
            made[new] = min(made[new], rank)
        if any(made.get(x, -1) >= rank for (a, b), (rank, _) in bpe.merges.items() for x in (a, b)):
            raise ValueError("a merge ranks before the merge that makes one of its symbols")
        keys = np.array([a * self.span + b for a, b in bpe.merges], np.int64)
        values = np.array(list(bpe.merges.values()), np.int32)
        order = np.argsort(keys)
        self.keys, self.rank, self.new = keys[order], values[order, 0], values[order, 1]
        self.first = np.array(bpe.byte_id, np.int64)
        self.last = np.array(bpe.last_id, np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.rank[at], NEVER), self.new[at]

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols of each pre-token that survive all merges. Every pre-token has a byte at least."""
        total = np.zeros(len(tokens), np.int64)
        if not tokens:
            return total
        sizes = np.array([len(t) for t in tokens], np.int64)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        symbol = self.first[raw]
        ends = np.cumsum(sizes) - 1
        symbol[ends] = self.last[raw[ends]]
        owner = np.repeat(np.arange(len(tokens)), sizes)
        while len(symbol):
            inside = owner[1:] == owner[:-1]
            rank, new = self.lookup(symbol[:-1], symbol[1:])
            rank = np.append(np.where(inside, rank, NEVER), NEVER)
            starts = np.flatnonzero(np.append(True, ~inside))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbol)))
            done = lowest == NEVER
            total[owner[starts[done]]] = sizes[done]
            place = np.flatnonzero((rank == np.repeat(lowest, sizes)) & (rank != NEVER))
            if len(place):
                # Places next to each other overlap; the first, third, ... of such a run are merged.
                head = np.append(True, np.diff(place) != 1)
                run_start = place[np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))]
                place = place[(place - run_start) % 2 == 0]
            alive = np.repeat(~done, sizes)
            symbol[place] = new[place]
            alive[place + 1] = False
            symbol, owner = symbol[alive], owner[alive]
        return total


@functools.lru_cache(maxsize=2)
def merger(source: bytes) -> ArrayMerger:
    return ArrayMerger(loaded(source))


class Counter:
    def __init__(self, merging: ArrayMerger):
        self.merging, self.known = merging, Remembered(REMEMBERED)

    def learn(self, fresh: list[str]) -> dict[str, int]:
        """The counts of these chunks, a bounded amount of bytes at a time."""
        counted, group, owners, size = dict.fromkeys(fresh, 0), [], [], 0

        def flush() -> None:
            for chunk, n in zip(owners, self.merging.counts(group).tolist()):
                counted[chunk] += n
            group.clear(), owners.clear()

        for chunk in fresh:
            for token in self.merging.bpe.pre_tokens(chunk):
                if isinstance(token, int):
                    counted[chunk] += 1
                else:
                    group.append(token), owners.append(chunk)
                    size += len(token)
            if size >= TOGETHER:
                flush()
                size = 0
        flush()
        return counted

    def count(self, texts: list[str]) -> list[int]:
        split = [chunks(t) for t in texts]
        known, counted = self.known, {}
        for c in {c for cs in split for c in cs}:
            counted[c] = known[c]
        fresh = self.learn([c for c, n in counted.items() if n is None])
        counted.update(fresh)
        for c, n in fresh.items():
            if len(c) <= LONG:
                known.put(c, n)
        return [sum([counted[c] for c in cs]) for cs in split]


@functools.lru_cache(maxsize=1)
def counter_of(source: bytes) -> Counter:
    """One for each worker, so that what it remembers serves its later tasks too."""
    return Counter(merger(source))


def token_counts(documents: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    source = documents.sparkSession.sparkContext.broadcast(read_source(path))

    def groups(texts: pa.Array, most: int = 4 << 20) -> Iterator[list[str]]:
        group, size = [], 0
        for t in texts:
            text = t.as_py() or ""
            group.append(text)
            size += len(text)
            if size >= most:
                yield group
                group, size = [], 0
        yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(source.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for group in groups(batch.column(1)):
                n_bytes += [len(t.encode()) for t in group]
                n_tokens += counter.count(group)
            over = [n > limit for n in n_tokens]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return bounded_batches(documents.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
