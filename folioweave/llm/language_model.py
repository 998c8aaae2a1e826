"""Language-model scores from Brown classes.

Words (lower case, punctuation apart) of the whole corpus are counted. Exchange
clustering gives each of the ``VOCABULARY`` most frequent, the head, one of
``CLASSES`` classes: a word moves to the class in which the class bigrams of the
corpus are likeliest, until a pass moves nothing or ``PASSES`` are done. Text
borders have a class of their own, and so has, at this step, every other word.
Each of those then gets the class under which all its neighbours' classes in the
corpus are likeliest (``tail_classes``), so that the model has every word of the
corpus with its own count. A word's probability is

    P(class | class before) * P(word | class),

both from the whole corpus under the final classes, the transition being
interpolated with the class frequencies by the Witten-Bell rule, the emission
being relative frequency. A document's perplexity is exp of the mean negative
log probability of its words and its end.

``fit`` and ``apply`` are the model of the head alone, in which the other words
are one unknown word, whose share is divided evenly among them and one word
never seen.

Plan: three Arrow passes over the text. The first counts words, which are summed
by one shuffle and written once, as they are asked twice; the second counts
bigrams of the head's word numbers, whose number of distinct rows the head
bounds; the third writes blocks of texts: their classes, a byte a word, and their
distinct other words. These are shuffled by word, each with its contexts in the
block, and their classes and counts come back by block. The driver holds the head, its bigrams and the class
bigrams only; all other words stay a table.

Defined results: a text without a word (null, empty, only punctuation) has 0
words and a null score; very long texts count whole, in runs; rows come out as often as they went in and repeated rows
count repeatedly in the statistics; ties in frequency go by the word, ties
between classes to the lower number; a null doc_id is scored like any other;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_runs

VOCABULARY = 4096
CLASSES = 48
#: Exchange ends where a pass moves no word; this only stops words that ties move to and fro.
PASSES = 40
#: Numbers of the border and of the unknown word; the vocabulary follows.
BORDER, UNKNOWN, FIRST = 0, 1, 2
#: A task's counts are handed on when they have so many entries.
HELD = 400_000
#: Texts are looked up in blocks of about so many words.
BLOCK = 1_200_000

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _clean(word: str) -> str:
    return word.encode("utf-8", "replace").decode()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the whole corpus."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([_clean(w) for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in text_runs(pa.RecordBatch.from_arrays([b.column(0), b.column(0)], ["id", "text"]) for b in batches):
            for text in batch.column(1).to_pylist():
                held.update(words(text))
            if len(held) >= HELD:
                yield out()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, size: int = VOCABULARY) -> tuple[list[str], int, int]:
    """The most frequent words, how many distinct words there are, and how many running words."""
    top = counts.orderBy(F.col("n").desc(), "word").limit(size).toArrow()["word"].to_pylist()
    total = counts.agg(F.count("*").alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    return top, total["types"], total["tokens"]


def numbered(found: list[str], index: dict[str, int]) -> np.ndarray:
    """The words' numbers between two borders."""
    get = index.get
    return np.array([BORDER, *[get(w, UNKNOWN) for w in found], BORDER], np.int64)


def bigram_counts(docs: DataFrame, top: list[str]) -> np.ndarray:
    """(rows, 3): word number, next word number, times; of all texts with a word."""
    shared = docs.sparkSession.sparkContext.broadcast(top)
    base = len(top) + FIRST

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: i + FIRST for i, w in enumerate(shared.value)}
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in text_runs(pa.RecordBatch.from_arrays([b.column(0), b.column(0)], ["id", "text"]) for b in batches):
            parts = []
            for text in batch.column(1).to_pylist():
                if found := words(text):
                    x = numbered(found, index)
                    parts.append(x[:-1] * base + x[1:])
            if parts:
                new, n = np.unique(np.concatenate(parts), return_counts=True)
                keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    got = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pair = got["pair"].to_numpy()
    order = np.argsort(pair)
    pair = pair[order]
    return np.stack([pair // base, pair % base, got["n"].to_numpy()[order]], axis=1)


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """The part of the corpus' log likelihood under the class bigrams that depends on the classes."""
    return float(_plogp(table).sum() - _plogp(table.sum(1)).sum() - _plogp(table.sum(0)).sum())


def class_table(bigrams: np.ndarray, classes: np.ndarray, k: int) -> np.ndarray:
    """(k, k) counts of class bigrams."""
    where = classes[bigrams[:, 0]] * k + classes[bigrams[:, 1]]
    return np.bincount(where, bigrams[:, 2], k * k).reshape(k, k)


def best_class(table: np.ndarray, left: np.ndarray, right: np.ndarray, own: float, fixed: int) -> int:
    """Where a word, taken out of the table, is likeliest: left and right are its neighbours' classes, own its repetitions.

    The first ``fixed`` classes take no words.
    """
    k = len(table)
    rows, columns = table.sum(1), table.sum(0)
    r_n, l_n = right.sum() + own, left.sum() + own
    gain = (_plogp(table + right[None, :]) - _plogp(table)).sum(1) + (_plogp(table + left[:, None]) - _plogp(table)).sum(0)
    i = np.arange(k)
    diagonal = table[i, i]
    gain += _plogp(diagonal + left + right + own) + _plogp(diagonal) - _plogp(diagonal + right) - _plogp(diagonal + left)
    gain -= _plogp(rows + r_n) - _plogp(rows) + _plogp(columns + l_n) - _plogp(columns)
    gain[:fixed] = -np.inf
    return int(gain.argmax())


def exchange(bigrams: np.ndarray, n_words: int, k: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """The class of every word number; border and unknown word keep classes 0 and 1."""
    k = max(k, FIRST + 1)
    classes = np.concatenate([np.arange(FIRST), FIRST + np.arange(n_words) % (k - FIRST)])
    table = class_table(bigrams, classes, k)
    n = n_words + FIRST
    by_left, by_right = bigrams[np.argsort(bigrams[:, 0], kind="stable")], bigrams[np.argsort(bigrams[:, 1], kind="stable")]
    left_at, right_at = np.searchsorted(by_left[:, 0], np.arange(n + 1)), np.searchsorted(by_right[:, 1], np.arange(n + 1))
    for _ in range(passes):
        moved = 0
        for w in range(FIRST, n):
            after = by_left[left_at[w] : left_at[w + 1]]
            before = by_right[right_at[w] : right_at[w + 1]]
            own = float(after[after[:, 1] == w, 2].sum())
            right = np.bincount(classes[after[:, 1]], after[:, 2], k)
            left = np.bincount(classes[before[:, 0]], before[:, 2], k)
            c = classes[w]
            right[c] -= own
            left[c] -= own
            table[c] -= right
            table[:, c] -= left
            table[c, c] -= own
            d = best_class(table, left, right, own, FIRST)
            table[d] += right
            table[:, d] += left
            table[d, d] += own
            moved += d != c
            classes[w] = d
        if not moved:
            break
    return classes


def transitions(table: np.ndarray) -> np.ndarray:
    """Log probabilities of the class after a class, by the Witten-Bell rule."""
    rows, columns = table.sum(1, keepdims=True), table.sum(0)
    kinds = (table > 0).sum(1, keepdims=True)
    back = (columns + 1) / (columns.sum() + len(table))
    return np.log(np.where(rows > 0, (table + kinds * back) / np.maximum(rows + kinds, 1), back))


class Model:
    """Log probabilities of class transitions and of words in their classes."""

    def __init__(self, top: list[str], types: int, bigrams: np.ndarray, classes: np.ndarray):
        k = int(classes.max()) + 1
        table = class_table(bigrams, classes, k)
        columns = table.sum(0)
        self.move = transitions(table)
        times = np.bincount(bigrams[:, 1], bigrams[:, 2], len(classes))
        self.emit = np.log(np.maximum(times, 1) / np.maximum(columns[classes], 1))
        self.emit[UNKNOWN] = -np.log(max(types - len(top), 0) + 1)
        self.emit[BORDER] = 0.0
        self.top, self.classes, self.times, self.columns = top, classes, times, columns

    def score(self, found: list[str], index: dict[str, int]) -> float:
        x = numbered(found, index)
        c = self.classes[x]
        return float(self.move[c[:-1], c[1:]].sum() + self.emit[x[1:]].sum())


def fit(docs: DataFrame, size: int = VOCABULARY, k: int = CLASSES, passes: int = PASSES) -> Model:
    top, types, _ = vocabulary(cut(word_counts(docs)), size)
    bigrams = bigram_counts(docs, top)
    return Model(top, types, bigrams, exchange(bigrams, len(top), k, passes))


def tail_classes(left: np.ndarray, right: np.ndarray, move: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The class of each word, given how often it stood after (left) and before (right) each class.

    It is the class that makes the word's transitions and its own emission likeliest.
    """
    times = left.sum(1, keepdims=True)
    gain = left @ move + right @ move.T - times * np.log(columns + times)
    usable = columns > 0
    usable[:FIRST] = False
    if not usable.any():
        usable[UNKNOWN] = True
    return np.where(usable, np.round(gain, 6), -np.inf).argmax(1)


def _blocks(docs: DataFrame, model: Model) -> DataFrame:
    """Blocks of texts: their ids, numbers of words, the head words' log counts, all classes between borders; the distinct
    other words by blanks, and which of them stand at the unknown places."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        index = {w: i + FIRST for i, w in enumerate(model.top)}
        symbol = np.min_scalar_type(len(model.columns) - 1)
        logs = np.log(np.maximum(model.times, 1))
        logs[:FIRST] = 0
        ids, sizes, known, seqs, places, own, held = [], [], [], [], [], {}, 0
        for batch in text_runs(batches):
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = words(text)
                x = numbered(found, index)
                ids.append(batch.column(0)[i].as_py())
                sizes.append(len(found))
                known.append(float(logs[x].sum()))
                seqs.append(model.classes[x].astype(symbol))
                places.append(np.array([own.setdefault(found[j], len(own)) for j in (np.flatnonzero(x == UNKNOWN) - 1).tolist()], np.int32))
                held += len(x)
                if held >= BLOCK:
                    yield block(batch.column(0).type, ids, sizes, known, seqs, places, own)
                    ids, sizes, known, seqs, places, own, held = [], [], [], [], [], {}, 0
        if ids:
            yield block(batch.column(0).type, ids, sizes, known, seqs, places, own)

    def block(kind: pa.DataType, ids: list, sizes: list, known: list, seqs: list, places: list, own: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64())), pa.array([known], pa.list_(pa.float64())), pa.array([np.concatenate(seqs).tobytes()], pa.binary()),
             pa.array([np.concatenate(places).tobytes()], pa.binary()), pa.array([" ".join(map(_clean, own))], pa.string())],
            ["ids", "sizes", "log_n", "seq", "places", "tail"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", "text").mapInArrow(run, f"ids array<{kind}>, sizes array<long>, log_n array<double>, seq binary, places binary, tail string")
    return cut(found.withColumn("block", F.monotonically_increasing_id()))


def _asked(blocks: DataFrame, k: int) -> DataFrame:
    """(word, block, at, spots): every word outside the head once a block, where it is listed, and all class pairs it stands between."""
    symbol, spot = np.min_scalar_type(k - 1), np.min_scalar_type(k * k - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, seq, places, tail in zip(*(c.to_pylist() for c in batch.columns)):
                x, which = np.frombuffer(seq, symbol).astype(np.int64), np.frombuffer(places, np.int32)
                at = np.flatnonzero(x == UNKNOWN)
                n = len(tail := tail.split())
                spots = (x[at - 1] * k + x[at + 1]).astype(spot)[np.argsort(which, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=n))]).astype(np.int32) * np.int32(spot.itemsize)
                spots = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(spots.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(tail, pa.string()), pa.array(np.full(n, number, np.int64)), pa.array(np.arange(n, dtype=np.int32)), spots], ["word", "block", "at", "spots"])

    return blocks.where("tail != ''").select("block", "seq", "places", "tail").mapInArrow(run, "word string, block long, at int, spots binary")


def whole_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut anew so that the rows of a word stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        word = batch.column(0)
        start = pc.index(word, word[-1]).as_py()
        if start == 0 and held and held[0].column(0)[0] == word[-1]:
            held.append(batch)
            continue
        if held or start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def _answered(asked: DataFrame, model: Model) -> DataFrame:
    """(block, at, class, n): the class and the count in the corpus of each word asked for."""
    shared = asked.sparkSession.sparkContext.broadcast((model.move, model.columns))
    k = len(model.columns)
    spot = np.min_scalar_type(k * k - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_words(batches):
            word = table["word"].combine_chunks()
            group = np.concatenate([[0], np.cumsum(pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False))]).astype(np.int64)
            n = group[-1] + 1
            lengths = pc.binary_length(table["spots"]).to_numpy() // spot.itemsize
            spots = np.frombuffer(b"".join(table["spots"].to_pylist()), spot).astype(np.int64)
            row = np.repeat(group, lengths)
            left = np.bincount(row * k + spots // k, minlength=n * k).reshape(n, k).astype(float)
            right = np.bincount(row * k + spots % k, minlength=n * k).reshape(n, k).astype(float)
            classes, times = tail_classes(left, right, *shared.value), left.sum(1).astype(np.int64)
            out = pa.table([table["block"], table["at"], pa.array(classes[group].astype(np.int32)), pa.array(times[group])], ["block", "at", "class", "n"])
            yield from out.combine_chunks().to_batches()

    return asked.repartition("word").sortWithinPartitions("word").mapInArrow(run, "block long, at int, class int, n long")


def all_classed(docs: DataFrame, model: Model) -> DataFrame:
    """(ids, sizes, log_n, seq) of blocks of all rows: the sums of all log counts, the classes of all words between borders."""
    k = len(model.columns)
    symbol = np.min_scalar_type(k - 1)
    blocks = _blocks(docs, model)

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        x, which = np.frombuffer(own["seq"][0].as_py(), symbol).copy(), np.frombuffer(own["places"][0].as_py(), np.int32)
        n = own["n_tail"][0].as_py()
        at = found["at"].to_numpy()
        assert len(at) == n == len(np.unique(at)), "a word was not found again"
        classes, logs = np.zeros(n, symbol), np.zeros(n)
        classes[at], logs[at] = found["class"].to_numpy(), np.log(found["n"].to_numpy())
        unknown = np.flatnonzero(x == UNKNOWN)
        x[unknown] = classes[which]
        text = np.searchsorted(np.cumsum(np.array(own["sizes"][0].as_py()) + 2), unknown, side="right")
        log_n = np.array(own["log_n"][0].as_py()) + np.bincount(text, logs[which], len(own["log_n"][0]))
        return pa.table([own["ids"], own["sizes"], pa.array([log_n], pa.list_(pa.float64())), pa.array([x.tobytes()], pa.binary())], ["ids", "sizes", "log_n", "seq"])

    answered = _answered(_asked(blocks, k), model)
    kind = dict(docs.dtypes)["doc_id"]
    # the blocks' words stay behind
    n_tail = F.when(F.col("tail") == "", 0).otherwise(F.size(F.split("tail", " "))).alias("n_tail")
    own = blocks.select("block", "ids", "sizes", "log_n", "seq", "places", n_tail)
    return cut(own.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(run, f"ids array<{kind}>, sizes array<long>, log_n array<double>, seq binary"))


def whole_table(classed: DataFrame, k: int) -> np.ndarray:
    """(k, k) counts of class bigrams of all texts with a word."""
    symbol = np.min_scalar_type(k - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for seq in batch.column(0).to_pylist():
                x = np.frombuffer(seq, symbol).astype(np.int64)
                total += np.bincount(x[:-1] * k + x[1:], minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    got = classed.select("seq").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(k * k, np.int64)
    table[got["pair"].to_numpy()] = got["n"].to_numpy()
    table[0] = 0  # two borders meet between texts and in texts without a word only
    return table.reshape(k, k)


def score_documents(docs: DataFrame, size: int = VOCABULARY, k: int = CLASSES, passes: int = PASSES) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every row under the model of all words of all rows."""
    head = fit(docs, size, k, passes)
    classed = all_classed(docs, head)
    n_classes = len(head.columns)
    symbol = np.min_scalar_type(n_classes - 1)
    table = whole_table(classed, n_classes)
    share = -np.log(np.maximum(table.sum(0), 1))
    share[BORDER] = 0.0
    cost = transitions(table) + share
    cost[BORDER, BORDER] = 0.0
    shared = docs.sparkSession.sparkContext.broadcast(cost)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = shared.value
        for batch in batches:
            for i, seq in enumerate(batch.column(3).to_pylist()):
                x, sizes = np.frombuffer(seq, symbol), batch.column(1)[i].values.to_numpy()
                starts = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
                score = np.add.reduceat(np.append(cost[x[:-1], x[1:]], 0.0), starts) + batch.column(2)[i].values.to_numpy()
                none = sizes == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, pa.array(sizes), pa.array(score, mask=none), pa.array(np.exp(-score / (sizes + 1)), mask=none)],
                    ["doc_id", "n_words", "log_prob", "perplexity"],
                )

    return classed.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, log_prob double, perplexity double")


def apply(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        index = {w: i + FIRST for i, w in enumerate(model.top)}
        for batch in text_runs(batches):
            sizes, scores = [], []
            for text in batch.column(1).to_pylist():
                found = words(text)
                sizes.append(len(found))
                scores.append(model.score(found, index) if found else None)
            perplexity = [None if s is None else float(np.exp(-s / (n + 1))) for n, s in zip(sizes, scores)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(scores, pa.float64()), pa.array(perplexity, pa.float64())],
                ["doc_id", "n_words", "log_prob", "perplexity"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, log_prob double, perplexity double")
