"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in windows of ``WINDOW`` bytes, once from either
end, and gives every byte position a distribution over the languages. Its gates
are piecewise linear, which numpy evaluates quickly. It is trained here, in
numpy, by backpropagation through time over the windows. All windows of a text
are read, so every position is labelled; a document's probabilities are the
means over its positions.

The languages are those of the column ``lang``. Training takes at most
``TRAIN_DOCS`` documents a language, those of the lowest hash, each with its whole
text; a batch draws documents, and from each a window. The driver holds the bytes
of these documents. ``fit`` returns a model that ``save`` and ``load`` keep, so
that it need not be trained again.

Plan: the training sample is found by scans, one to count usable rows and one (two
where rows repeat) to rank hashes; one Arrow pass over (doc_id, text) applies the
network; nothing is shuffled but the sample.

Defined results: a null or empty text, and every text where no row has a
language, gets a null language and no positions; very long texts are read whole,
in windows; ties go to the language that is
first in alphabetical order; where only one language exists, every text has it;
rows come out as often as they went in, repeated rows and null ids included;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, text_runs

HIDDEN = 6
WINDOW = 128
TRAIN_DOCS = 250
STEPS = 400
BATCH = 256
RATE = 0.02
#: A document whose best language has a lower probability is rejected by ``known_language``.
MIN_PROBABILITY = 0.4
PAD = 256
SYMBOLS = 257
#: Windows that go through the network together.
LANES = 2048
#: Texts are labelled in runs of about so many characters; a text is never split between runs.
LABEL_CHARS = 2_000_000

Parameters = dict[str, np.ndarray]


def new_parameters(languages: int, hidden: int = HIDDEN, seed: int = 5) -> Parameters:
    """Tables of input by symbol and direction, recurrent matrices of the update, reset and candidate parts, output."""
    rng = np.random.default_rng(seed)
    p = {}
    for part in "zrc":
        p[f"x{part}"] = rng.normal(0, 0.3, (2, SYMBOLS, hidden))
        p[f"u{part}"] = rng.normal(0, 0.5 / np.sqrt(hidden), (2, hidden, hidden))
    p["v"] = rng.normal(0, 0.3, (2, hidden, languages))
    p["b"] = np.zeros(languages)
    return {k: x.astype(np.float32) for k, x in silence_pads(p).items()}


def silence_pads(p: Parameters) -> Parameters:
    """A pad keeps the update gate shut, so that the state stays as it is."""
    p["xz"][:, PAD] = -1e6
    return p


def both_ways(windows: np.ndarray) -> np.ndarray:
    """(T, 2, n) table rows: the windows forwards, and backwards in the second half of the tables."""
    t = windows.T.astype(np.int64)
    return np.stack([t, t[::-1] + SYMBOLS], axis=1)


def states(p: Parameters, rows: np.ndarray) -> np.ndarray:
    """(T, 2, n, H) states after each symbol."""
    steps, _, n = rows.shape
    hidden = p["uz"].shape[1]
    tables = {part: p[f"x{part}"].reshape(-1, hidden) for part in "zrc"}
    uz, ur, uc = p["uz"], p["ur"], p["uc"]
    out = np.empty((steps, 2, n, hidden), p["uz"].dtype)
    h = np.zeros((2, n, hidden), p["uz"].dtype)
    for t in range(steps):
        z, r, c = (tables[part].take(rows[t], axis=0) for part in "zrc")
        z += h @ uz
        z += 0.5
        r += h @ ur
        r += 0.5
        z.clip(0, 1, out=z)
        r.clip(0, 1, out=r)
        r *= h @ uc
        c += r
        c.clip(-1, 1, out=c)
        c -= h
        c *= z
        h = np.add(h, c, out=out[t])
    return out


def position_probabilities(p: Parameters, windows: np.ndarray) -> np.ndarray:
    """(languages, T, n) for (n, T) windows."""
    h = states(p, both_ways(windows))
    steps, _, n, _ = h.shape
    ahead, back = h[:, 0], h[::-1, 1]
    q = np.empty((len(p["b"]), steps, n), h.dtype)
    for k, row in enumerate(q):
        np.add(ahead @ p["v"][0][:, k], back @ p["v"][1][:, k], out=row)
        row += p["b"][k]
    q -= q.max(axis=0)
    np.exp(q, out=q)
    q /= q.sum(axis=0)
    return q


def loss_and_gradient(p: Parameters, windows: np.ndarray, labels: np.ndarray) -> tuple[float, Parameters]:
    """Mean cross entropy of the positions that are no pads, and its gradient by backpropagation through time."""
    rows = both_ways(windows)
    steps, _, n = rows.shape
    hidden = p["uz"].shape[1]
    tables = {part: p[f"x{part}"].reshape(-1, hidden) for part in "zrc"}
    h, tape = np.zeros((2, n, hidden), p["uz"].dtype), []
    after = np.empty((steps, 2, n, hidden), p["uz"].dtype)
    for t in range(steps):
        m = h @ p["uc"]
        az = tables["z"][rows[t]] + h @ p["uz"] + 0.5
        ar = tables["r"][rows[t]] + h @ p["ur"] + 0.5
        z, r = az.clip(0, 1), ar.clip(0, 1)
        ac = tables["c"][rows[t]] + r * m
        c = ac.clip(-1, 1)
        tape.append((h, z, r, c, m, (az > 0) & (az < 1), (ar > 0) & (ar < 1), (ac > -1) & (ac < 1)))
        h = after[t] = h + z * (c - h)
    logits = after[:, 0] @ p["v"][0] + after[::-1, 1] @ p["v"][1] + p["b"]
    logits -= logits.max(axis=2, keepdims=True)
    q = np.exp(logits)
    q /= q.sum(axis=2, keepdims=True)
    real = (windows.T != PAD)[:, :, None]
    count = max(1, int(real.sum()))
    hit = np.arange(q.shape[2]) == labels[None, :, None]
    loss = float(-(np.log(np.maximum(q, 1e-12)) * hit * real).sum() / count)
    d = ((q - hit) * real / count).astype(p["v"].dtype)
    g = {k: np.zeros_like(x) for k, x in p.items()}
    g["b"] = d.sum((0, 1))
    flat = d.reshape(-1, d.shape[2])
    g["v"] = np.stack([after[:, 0].reshape(-1, hidden).T @ flat, after[::-1, 1].reshape(-1, hidden).T @ flat])
    from_output = np.stack([d @ p["v"][0].T, (d @ p["v"][1].T)[::-1]], axis=1)
    dh = np.zeros((2, n, hidden), p["uz"].dtype)
    swap = (0, 2, 1)
    inputs = {part: np.empty((steps, 2, n, hidden), p["uz"].dtype) for part in "zrc"}
    for t in reversed(range(steps)):
        h, z, r, c, m, mz, mr, mc = tape[t]
        dh = dh + from_output[t]
        dac = dh * z * mc
        daz = dh * (c - h) * mz
        dar = dac * m * mr
        dm = dac * r
        dh = dh * (1 - z)
        for part, da, du in (("z", daz, daz), ("r", dar, dar), ("c", dac, dm)):
            inputs[part][t] = da
            g[f"u{part}"] += h.transpose(swap) @ du
            dh = dh + du @ p[f"u{part}"].transpose(swap)
    where = rows.ravel()
    for part in "zrc":
        flat = inputs[part].reshape(-1, hidden)
        g[f"x{part}"] = np.stack([np.bincount(where, flat[:, j], 2 * SYMBOLS) for j in range(hidden)], 1).reshape(2, SYMBOLS, hidden)
        g[f"x{part}"][:, PAD] = 0
    return loss, g


def train(texts: list[bytes], labels: np.ndarray, languages: int, steps: int = STEPS, hidden: int = HIDDEN, window: int = WINDOW) -> Parameters:
    """Adam over random batches in which every language, and every text of it, weighs the same; the rate falls to zero."""
    rng = np.random.default_rng(3)
    p = new_parameters(languages, hidden)
    first, second = ({k: np.zeros(x.shape) for k, x in p.items()} for _ in range(2))
    of = [np.flatnonzero(labels == k) for k in range(languages)]
    for step in range(1, steps + 1):
        picks = np.concatenate([rng.choice(rows, max(1, BATCH // languages)) for rows in of])
        _, g = loss_and_gradient(p, np.stack([_any_window(texts[i], window, rng) for i in picks]), labels[picks])
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k, x in g.items():
            x = x * min(1.0, 1.0 / max(size, 1e-12))
            first[k] = 0.9 * first[k] + 0.1 * x
            second[k] = 0.99 * second[k] + 0.01 * x * x
            move = RATE * (1 - (step - 1) / steps) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            p[k] = (p[k] - move).astype(np.float32)
        silence_pads(p)
    return p


def windows_of(raw: bytes, window: int = WINDOW) -> np.ndarray:
    """(n, window) symbols of all bytes; the last window is padded."""
    n = -(-len(raw) // window)
    out = np.full(n * window, PAD, np.int16)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, window)


def _any_window(raw: bytes, window: int, rng: np.random.Generator) -> np.ndarray:
    """The symbols of one of the windows of the text, each as likely."""
    start = int(rng.integers(-(-len(raw) // window))) * window
    return windows_of(raw[start : start + window], window)[0]


def _utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def training_texts(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], list[bytes], np.ndarray]:
    """Languages, the UTF-8 texts and the labels of the documents of lowest hash in each language.

    Rows are first thinned by the hash; of a language of which too few are left, as where it repeats rows, all are ranked.
    """
    labelled = docs.where("lang is not null and length(text) > 0")
    place = F.xxhash64(F.lit("language-id"), "doc_id", "text").bitwiseAND(F.lit(2**31 - 1))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], [], np.zeros(0, np.int64)

    def sample(shares: dict[str, float]) -> list[tuple[str, bytes]]:
        share = F.lit(0.0)
        for lang, x in shares.items():
            share = F.when(F.col("lang") == lang, F.lit(x)).otherwise(share)
        near = labelled.where(place < share * F.lit(2.0**31)).select("lang", "text", place.alias("place"))
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))).where(F.col("rank") <= train_docs)
        got = ranked.select("lang", F.encode("text", "UTF-8").alias("raw")).toArrow()
        return list(zip(got["lang"].to_pylist(), got["raw"].to_pylist()))

    rows = sample({lang: min(1.0, 2.0 * (train_docs + 50) / n) for lang, n in counts.items()})
    taken = Counter(lang for lang, _ in rows)
    few = {lang: 1.0 for lang, n in counts.items() if taken[lang] < min(train_docs, n)}
    if few:
        rows = [row for row in rows if row[0] not in few] + sample(few)
    rows.sort()
    names = sorted({lang for lang, _ in rows})
    index = {x: i for i, x in enumerate(names)}
    return names, [raw for _, raw in rows], np.array([index[lang] for lang, _ in rows], np.int64)


Model = tuple[list[str], Parameters | None]


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, steps: int = STEPS) -> Model:
    """The languages and the network; no network where there are not two languages."""
    names, texts, labels = training_texts(docs, train_docs)
    return names, train(texts, labels, len(names), steps) if len(names) > 1 else None


def save(model: Model, path: str) -> None:
    np.savez(path, names=np.array(model[0], dtype=str), **(model[1] or {}))


def load(path: str) -> Model:
    with np.load(path) as kept:
        p = {k: kept[k] for k in kept.files if k != "names"}
        return kept["names"].tolist(), p or None


def label(p: Parameters | None, languages: int, texts: list[str | None], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sums of probabilities over its positions, and how many positions have each label."""
    sums, votes = np.zeros((len(texts), languages)), np.zeros((len(texts), languages), np.int64)
    if not languages:
        return sums, votes
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= LABEL_CHARS or i + 1 == len(texts):
            _label_run(p, texts[start : i + 1], window, sums[start : i + 1], votes[start : i + 1])
            start, size = i + 1, 0
    return sums, votes


def _label_run(p: Parameters | None, texts: list[str | None], window: int, sums: np.ndarray, votes: np.ndarray) -> None:
    languages = sums.shape[1]
    parts = [windows_of(_utf8(t), window) for t in texts]
    owners = np.repeat(np.arange(len(texts)), [len(x) for x in parts])
    if not len(owners):
        return
    found = np.concatenate(parts)
    for at in range(0, len(found), LANES):
        block, own = found[at : at + LANES], owners[at : at + LANES]
        q = position_probabilities(p, block) if languages > 1 else np.ones((1, window, len(block)), np.float32)
        best, most = np.zeros(q.shape[1:], np.int32), q[0].copy()
        for k in range(1, languages):
            best[q[k] > most] = k
            np.maximum(most, q[k], out=most)
        ends = (block != PAD).sum(1)
        if ends.min() < window:
            pads = np.arange(window)[:, None] >= ends[None, :]
            q[:, pads] = 0
            best[pads] = -1
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        by_window = q.sum(1, dtype=np.float64).T
        sums[own[starts]] += np.add.reduceat(by_window, starts)
        counts = np.stack([(best == k).sum(0) for k in range(languages)], 1)
        votes[own[starts]] += np.add.reduceat(counts, starts)


def identify(docs: DataFrame, steps: int = STEPS, train_docs: int = TRAIN_DOCS, model: Model | None = None) -> DataFrame:
    """(doc_id, language, probability, n_positions, labels) for every row.

    ``labels`` has, for each language with any, how many positions carry its label.
    """
    names, p = model or fit(docs, train_docs, steps)
    return apply(docs.select("doc_id", "text"), p, names)


def apply(docs: DataFrame, p: Parameters | None, names: list[str]) -> DataFrame:
    """``identify`` with a network that is trained already; ``docs`` has the columns doc_id and text."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches):
            sums, votes = label(p, len(names), batch.column(1).to_pylist())
            total = votes.sum(1)
            have = total > 0
            best = sums.argmax(1) if names else np.zeros(len(sums), int)
            top = sums.max(1) / np.maximum(total, 1) if names else np.zeros(len(sums))
            language = pa.array([names[k] if ok else None for k, ok in zip(best, have)], pa.string())
            counts = [[{"language": names[k], "positions": int(v)} for k, v in enumerate(row) if v] for row in votes]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), language, pa.array(top, mask=~have), pa.array(total), pa.array(counts, _LABELS)],
                ["doc_id", "language", "probability", "n_positions", "labels"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, language string, probability double, n_positions long, labels array<struct<language: string, positions: long>>")


_LABELS = pa.list_(pa.struct([("language", pa.string()), ("positions", pa.int64())]))


def known_language(docs: DataFrame, min_probability: float = MIN_PROBABILITY, steps: int = STEPS, train_docs: int = TRAIN_DOCS, model: Model | None = None) -> DataFrame:
    """The documents whose language is known with the probability at least; all their columns, the order of columns kept.

    Rows are told apart by a number of their own, so repeated and null doc_ids are judged row by row.
    """
    names, p = model or fit(docs, train_docs, steps)
    (verdict,) = fresh(docs, "known")

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        sums, votes = label(p, len(names), [t if isinstance(t, str) else None for t in texts])
        total = votes.sum(1)
        return pd.Series((total > 0) & (sums.max(1, initial=0.0) >= min_probability * total))

    return docs.withColumn(verdict, known("text")).where(F.col(verdict)).select(*(F.col(f"`{c}`") for c in docs.columns))
