"""Token counts of a byte-level BPE with a whole-token shortcut.

Offline, on the driver, every vocabulary string is merged by itself; those that
end as one token are proven whole. In a text, a pre-token that is proven whole
counts as one without any merging; only the rest is merged, each distinct string
once per worker while it stays in a bounded memo.

Plan: one Arrow pass over (doc_id, text), no shuffle; the vocabulary, whose size
is fixed, is broadcast once.

Defined results: a null text has null counts, an empty text zeros; very long texts
are read whole, long pre-tokens being merged by a heap; rows are
never merged or dropped, so repeated rows and null ids come out as often as they
went in; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import text_runs

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 1_000_000
NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(left id, right id) -> id of the two merged."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                out[left, right] = rank
    return out


def merge(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """Merge the pair of lowest rank, the leftmost of equals, until none is left."""
    if len(ids) > 100:  # the same result in less time
        return _merge_long(ids, pairs)
    get = pairs.get
    found = [get(p, NONE) for p in zip(ids, ids[1:])]
    while found and (low := min(found)) != NONE:
        i = found.index(low)
        ids[i] = low
        del ids[i + 1], found[i]
        if i:
            found[i - 1] = get((ids[i - 1], low), NONE)
        if i < len(found):
            found[i] = get((low, ids[i + 1]), NONE)
    return ids


def _merge_long(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same by a heap over linked positions, in n log n."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(pairs[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
    heapq.heapify(heap)
    ids = [*ids, -1]
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i] if i < n else n
        if j >= n or ids[i] != left or ids[j] != right:
            continue
        ids[i], ids[j] = rank, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := pairs.get((ids[a], ids[b]))) is not None:
                heapq.heappush(heap, (r, a, ids[a], ids[b]))
    return [x for x in ids[:n] if x >= 0]


def proven_whole(ranks: dict[bytes, int], pairs: dict[tuple[int, int], int]) -> frozenset[str]:
    """The vocabulary strings that merge into exactly their own token."""
    single = [ranks[bytes([b])] for b in range(256)]
    out = set()
    for token, rank in ranks.items():
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        if merge([single[b] for b in token], pairs) == [rank]:
            out.add(text)
    return frozenset(out)


class Counter:
    """Counts tokens of texts; ``whole`` may be empty, for the same totals by merging alone."""

    def __init__(self, ranks: dict[bytes, int], pairs: dict[tuple[int, int], int], whole: frozenset[str], memo: int = MEMO):
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs, self.whole, self.memo_size = pairs, whole, memo
        self.find = regex.compile(PATTERN).findall
        self.memo: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        n = len(merge([self.single[b] for b in piece.encode("utf-8", "surrogatepass")], self.pairs))
        if len(self.memo) >= self.memo_size:
            self.memo.clear()
        if len(piece) <= 64:
            self.memo[piece] = n
        return n

    def count(self, text: str) -> tuple[int, int, int]:
        """(tokens, pre-tokens counted directly, pre-tokens merged)."""
        pieces, whole, get = self.find(text), self.whole, self.memo.get
        rest = [p for p in pieces if p not in whole]
        direct = len(pieces) - len(rest)
        return direct + sum(get(p) or self.merged(p) for p in rest), direct, len(rest)


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_whole, n_merged) for every row."""
    ranks = load_ranks(vocabulary)
    pairs = pair_ranks(ranks)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pairs, proven_whole(ranks, pairs)))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(*shared.value)
        count = _counters[vocabulary].count
        for batch in text_runs(batches):
            rows = [(None, None, None) if t is None else count(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "n_whole", "n_merged"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_whole long, n_merged long")
