"""BPE encoding and decoding of whole texts.

Encoding keeps the symbols of a pre-token in a doubly linked list and the ranks of its adjacent
pairs in a priority queue; an entry whose symbols have since been merged is stale and skipped.
Each merge costs the logarithm of the length, so a pre-token as long as a document is no trouble.
Decoding looks the ids up in the vocabulary and joins the strings.

Texts are handled row by row in Arrow batches, without shuffles. What a chunk gives is remembered
for a fixed number of chunks, as the texts that the rows are joined from, so a known chunk costs one
look-up. Defined results: a null text is an empty one and has no ids; a text of any length is handled
whole, and a pre-token of any length too; ids, order, repeated rows and other columns never matter to
a row, and columns of the input other than doc_id and text give way; an empty table gives an empty
result.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from evidentia.llm.common import bounded_batches
from evidentia.llm.word_bpe import Remembered, WordBpe, chunks, loaded, read_source

#: Chunks, and pre-tokens, whose ids a worker remembers, twice: the newer and the older half.
REMEMBERED = 300_000
#: Longer ones are not remembered.
LONG = 64
#: The number of ids, the ids, and the decoded text, both joined by spaces.
Piece = tuple[int, str, str]


#: Ids and places in a pre-token are packed into integers, which a heap compares fastest.
_ID, _PLACE = 24, 40


def packed(merges: dict[tuple[int, int], tuple[int, int]]) -> dict[int, int]:
    """(left, right) -> (rank, new) with each of the two pairs as one integer."""
    return {a << _ID | b: rank << _ID | new for (a, b), (rank, new) in merges.items()}


def merge_queue(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """The symbols after all merges, lowest rank first and leftmost among equal ranks.

    An entry of the queue is a rank and the place of the left symbol. It is stale if the pair that
    now begins there, if any, has another rank."""
    n, get = len(symbols), merges.get
    queue = [found >> _ID << _PLACE | i for i in range(n - 1) if (found := get(symbols[i] << _ID | symbols[i + 1])) is not None]
    if not queue:
        return symbols
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heapq.heapify(queue)
    push, pop, at = heapq.heappush, heapq.heappop, (1 << _PLACE) - 1
    while queue:
        entry = pop(queue)
        i = entry & at
        j = after[i]
        if j >= n or symbols[i] < 0:
            continue
        found = get(symbols[i] << _ID | symbols[j])
        if found is None or found >> _ID != entry >> _PLACE:
            continue
        symbols[i] = new = found & ((1 << _ID) - 1)
        symbols[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (found := get(new << _ID | symbols[k])) is not None:
                push(queue, found >> _ID << _PLACE | i)
        h = before[i]
        if h >= 0 and (found := get(symbols[h] << _ID | new)) is not None:
            push(queue, found >> _ID << _PLACE | h)
    return [s for s in symbols if s >= 0]


def joined(pieces: Sequence[Piece]) -> Piece:
    if len(pieces) == 1:
        return pieces[0]
    pieces = [p for p in pieces if p[0]]
    if not pieces:
        return 0, "", ""
    n, ids, strings = zip(*pieces)
    return sum(n), " ".join(ids), " ".join(strings)


class Codec:
    def __init__(self, bpe: WordBpe):
        self.bpe, self.merges = bpe, packed(bpe.merges)
        self.known, self.merged = Remembered(REMEMBERED), Remembered(REMEMBERED)

    def piece(self, ids: Sequence[int]) -> Piece:
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def of_token(self, token: bytes) -> Piece:
        piece = self.merged[token]
        if piece is None:
            piece = self.piece(merge_queue(self.bpe.symbols(token), self.merges))
            if len(token) <= LONG:
                self.merged.put(token, piece)
        return piece

    def of_chunk(self, chunk: str) -> Piece:
        piece = self.known[chunk]
        if piece is None:
            piece = joined([self.piece([t]) if isinstance(t, int) else self.of_token(t) for t in self.bpe.pre_tokens(chunk)])
            if len(chunk) <= LONG:
                self.known.put(chunk, piece)
        return piece

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.texts(text)[1].split()]

    def decode(self, ids: Iterable[int]) -> str:
        strings = self.bpe.strings
        return " ".join([strings[i] for i in ids])

    def texts(self, text: str) -> Piece:
        """The number of ids, the ids and the decoded text."""
        own = chunks(text)
        pieces = [*map(self.known.__getitem__, own)]
        if None in pieces:
            pieces = [p or self.of_chunk(c) for p, c in zip(pieces, own)]
        return joined(pieces)


@functools.lru_cache(maxsize=1)
def codec_of(source: bytes) -> Codec:
    """One for each worker, so that what it remembers serves its later tasks too."""
    return Codec(loaded(source))


def bpe_encode(documents: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, and ids with decoded text, or with ``digests`` their SHA-256 instead."""
    source = documents.sparkSession.sparkContext.broadcast(read_source(path))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if digests:
        names, kinds = ["n_tokens", "ids_sha256", "decoded_sha256"], "n_tokens long, ids_sha256 string, decoded_sha256 string"
    else:
        names, kinds = ["n_tokens", "ids", "decoded"], "n_tokens long, ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(source.value)
        for batch in batches:
            n_tokens, first, second = [], [], []
            for text in batch.column(1).to_pylist():
                n, ids, decoded = codec.texts(text or "")
                n_tokens.append(n)
                first.append(sha(ids) if digests else [int(x) for x in ids.split()])
                second.append(sha(decoded) if digests else decoded)
            arrays = [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(first, pa.string() if digests else pa.list_(pa.int32())), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return bounded_batches(documents.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, {kinds}")
