"""Line dedup, mixing, packing, token counts, licences, language ID and class-based scores."""

import math
from collections import Counter

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from folioweave.llm import language_id, language_model, licences, line_dedup, mixing, packing, token_counts

# --- line dedup

def brute_dedup(docs):
    """Lines in a pair of neighbours that stood together earlier, or of more than 50 words and seen earlier, go."""
    pairs, alone, out = set(), set(), {}
    for doc_id, text in sorted({(d, t) for d, t in docs}):
        lines = text.split("\n")
        gone = set()
        for i, line in enumerate(lines):
            if len(line.split(" ")) > 50:
                gone |= {i} if line in alone else set()
                alone.add(line)
            if i + 1 < len(lines) and (line + lines[i + 1]).replace(" ", ""):
                gone |= {i, i + 1} if (line, lines[i + 1]) in pairs else set()
                pairs.add((line, lines[i + 1]))
        out[doc_id] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def passages(seed=3):
    """Documents of lines of their own, lines that many have, and whole or cut passages of 2 to 9 lines."""
    rng = np.random.default_rng(seed)
    shared = [[f"passage {p} line {i} " + "word " * int(rng.integers(1, 9)) for i in range(int(rng.integers(2, 10)))] for p in range(12)]
    shared += [["one line of many words " * 11], ["", " ", ""], ["x", "x", "x", "x"]]
    docs = []
    for d in range(60):
        lines = [f"own {d} {i}" for i in range(int(rng.integers(0, 6)))] + ["common line"] * int(rng.integers(0, 2))
        for _ in range(int(rng.integers(0, 4))):
            passage = shared[int(rng.integers(len(shared)))]
            cut = int(rng.integers(0, max(1, len(passage) - 1)))
            at = int(rng.integers(0, len(lines) + 1))
            lines[at:at] = passage[cut:]
        docs.append((d, "\n".join(lines)))
    long = "\n".join(f"line {i % 700} of a long text" for i in range(20_000))
    return docs + [(70, docs[3][1]), (71, docs[3][1]), (80, long), (81, long + "\nend")]


@pytest.mark.parametrize("seed", [3, 4])
def test_line_dedup_equals_brute_force(spark, seed):
    docs = passages(seed)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_dedup(docs)
    assert sum(len(t) for t in got.values()) < sum(len(t) for _, t in docs)
    lines = {x for _, t in docs for x in t.split("\n")}
    assert lines - {""} <= {x for t in got.values() for x in t.split("\n")}, "a line is nowhere any more"


def test_line_dedup_compares_bytes_where_hashes_agree(spark, monkeypatch):
    docs = passages()[:60]
    monkeypatch.setattr(line_dedup, "line_hash", lambda line: F.length(line).cast("long") % 7)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_dedup(docs)


def test_chunk_boundaries_resist_shifts(spark):
    lines = [f"line {i}" for i in range(60)]
    docs = spark.createDataFrame([(0, "\n".join(lines)), (1, "\n".join(["new", *lines]))], "doc_id long, text string").select("doc_id", F.split("text", "\n").alias("l"))
    found = docs.select("doc_id", line_dedup.chunks(F.transform("l", line_dedup.line_hash), F.size("l") - 1).alias("c")).collect()
    ends = {r["doc_id"]: {c["start"] + c["n"] - r["doc_id"] for c in r["c"]} for r in found}
    assert len(ends[0]) > 10 and ends[0] - {1, 2} == ends[1] - {0, 1, 2}


def test_line_dedup_odd_rows(odd, empty):
    out = line_dedup.dedup_lines(odd, report=True)
    assert out.columns == [*odd.columns, "runs_removed", "lines_removed"]
    got = out.collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[100]["text"] is None and by[101]["text"] == "" and by[102]["text"] == "   \n \n"
    assert len({r["text"] for r in got if r["doc_id"] == 5}) == 1
    assert line_dedup.dedup_lines(empty).count() == 0


# --- mixing

def test_mixing_sizes_and_copies(odd, empty, spark):
    docs = spark.createDataFrame([(i, "w" * (1 + i % 50), f"src{i % 5}") for i in range(600)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    assert sum(r["copies"] for r in rows) == 600
    places = Counter()
    for r in rows:
        places[r["source"]] += r["copies"]
    weights = {s: mixing.TARGETS.get(s, 1) for s in places}
    for s, n in places.items():
        assert abs(n - 600 * weights[s] / sum(weights.values())) < 1
    out = mixing.mix(odd)
    assert out.columns == [*odd.columns, "copies_"] and out.count() == odd.count()
    assert all(r["copies_"] == 0 for r in out.collect() if not r["text"])
    assert mixing.sampled(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0 and mixing.sampled(empty).count() == 0


def test_mixing_ties_and_repeated_ids(spark):
    rows = [(7, "same words", "s")] * 3 + [(8, "same words", "s"), (None, "same words", "s"), (None, "same words", "s"), (9, "x" * 3_000_000, "s")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    assert all(len({r["copies"] for r in got if r["doc_id"] == d}) == 1 for d in (7, None))
    assert sum(r["copies"] for r in got) >= len(rows)


# --- packing

def check_windows(rows, capacity):
    windows = {}
    for r in rows:
        windows.setdefault(r["window_id"], []).append((r["position"], r["length"]))
    for parts in windows.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= capacity
    return sorted(sum(n for _, n in parts) for parts in windows.values())


def test_packing_is_a_partition_within_capacity(odd, empty):
    got = packing.pack(odd, capacity=64).collect()
    encoding = packing.encoder(token_counts.load_ranks(token_counts.VOCABULARY))
    total, want = Counter(), Counter()
    for r in odd.collect():
        n = len(encoding.encode_ordinary(r["text"] or ""))
        want[r["doc_id"]] += n + 1 if n else 0
    for r in got:
        total[r["doc_id"]] += r["length"]
    assert total == Counter({d: n for d, n in want.items() if n})
    check_windows(got, 64)
    assert packing.pack(empty).count() == 0


def brute_packing(totals, capacity):
    """The fills of windows, one window at a time: the longest piece left, and of all sums of others the greatest that fits."""
    left = Counter()
    for n in totals:
        left.update([capacity] * (n // capacity) + ([n % capacity] if n % capacity else []))
    out = []
    while left:
        first = max(left)
        left -= Counter([first])
        reach = {0: ()}
        for x in sorted(left.elements()):
            reach |= {s + x: (*how, x) for s, how in list(reach.items()) if s + x <= capacity - first and s + x not in reach}
        best = max(reach)
        left -= Counter(reach[best])
        out.append(first + best)
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_plan_equals_brute_force_where_lengths_are_alike(spark, seed):
    """Of equal fullness several fillings may exist; with one way to fill each window the whole plan is determined."""
    rng = np.random.default_rng(seed)
    capacity = 24
    totals = [int(x) for x in rng.choice([24, 16, 8, 48, 60], 200)]
    rows = spark.createDataFrame([(i, n - 1) for i, n in enumerate(totals)], "doc_id long, tokens long")
    got = packing.pack_lengths(rows, capacity).collect()
    assert check_windows(got, capacity) == brute_packing(totals, capacity)
    pieces = Counter(r["doc_id"] for r in got)
    assert all(pieces[i] == -(-n // capacity) for i, n in enumerate(totals))


def test_every_window_of_the_plan_is_the_fullest_possible():
    rng = np.random.default_rng(5)
    histogram = Counter(int(x) for x in rng.integers(1, 41, 300))
    left = Counter(histogram)
    for filling, times in packing.plan(histogram, 40):
        for _ in range(times):
            first = max(left)
            reach = {first}
            for x in (left - Counter([first])).elements():
                reach |= {s + x for s in reach if s + x <= 40}
            assert sum(k * n for k, n in filling.items()) == max(reach) and first in filling
            left -= Counter(filling)
    assert not left


def test_window_contents_give_the_texts_back(spark, odd):
    docs = odd.where("doc_id is not null and doc_id != 5")
    encoding = packing.encoder(token_counts.load_ranks(token_counts.VOCABULARY))
    placed = {}
    for r in packing.pack(docs, 128).collect():
        placed.setdefault(r["window_id"], []).append((r["position"], r["doc_id"], r["piece"], r["length"]))
    texts = {}
    for r in packing.contents(docs, 128).collect():
        assert len(r["tokens"]) <= 128 and r["doc_ids"] == [d for _, d, _, _ in sorted(placed[r["window_id"]])]
        for at, d, piece, n in placed[r["window_id"]]:
            texts.setdefault(d, {})[piece] = r["tokens"][at : at + n]
    joined = {d: [x for k in sorted(parts) for x in parts[k]] for d, parts in texts.items()}
    assert all(t[-1] == packing.END for t in joined.values())
    assert {d: encoding.decode(t[:-1]) for d, t in joined.items()} == {r["doc_id"]: r["text"] for r in docs.collect() if r["text"]}


def test_filling_is_the_fullest():
    rng = np.random.default_rng(0)
    for _ in range(60):
        capacity = int(rng.integers(5, 40))
        counts = sorted({int(x): int(rng.integers(1, 4)) for x in rng.integers(1, capacity + 1, 5)}.items(), reverse=True)
        filling = packing.fullest(counts, capacity)
        sums = {0}
        for i, (length, n) in enumerate(counts):
            sums = {s + k * length for s in sums for k in range(1 if i == 0 else 0, n + 1) if s + k * length <= capacity}
        assert sum(k * n for k, n in filling.items()) == max(sums)
        assert all(n <= dict(counts)[k] for k, n in filling.items()) and counts[0][0] in filling


# --- token counts

def test_token_counts_equal_full_merging(odd, empty):
    ranks = token_counts.load_ranks(token_counts.VOCABULARY)
    encoding = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r["text"] for r in odd.collect()]
    got = token_counts.count_tokens(odd).collect()
    assert sorted((r["n_tokens"] for r in got), key=str) == sorted((None if t is None else len(encoding.encode_ordinary(t)) for t in texts), key=str)
    assert token_counts.count_tokens(empty).count() == 0


def test_whole_and_merged_pre_tokens_are_counted_apart(odd):
    ranks = token_counts.load_ranks(token_counts.VOCABULARY)
    alone = tiktoken.Encoding("alone", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    import regex

    for r in token_counts.count_tokens(odd).join(odd.select("doc_id", "text").where("doc_id < 20 or doc_id in (102, 103, 105)"), "doc_id").collect():
        pieces = regex.findall(token_counts.PATTERN, r["text"])
        whole = sum(len(alone.encode_ordinary(p)) == 1 for p in pieces)
        assert (r["n_whole"], r["n_merged"]) == (whole, len(pieces) - whole)


def test_every_proven_token_is_whole():
    ranks = token_counts.load_ranks(token_counts.VOCABULARY)
    pairs = token_counts.pair_ranks(ranks)
    whole = token_counts.proven_whole(ranks, pairs)
    encoding = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    sample = sorted(whole)[::50]
    assert len(whole) > 40_000 and all(len(encoding.encode_ordinary(t)) == 1 for t in sample)


# --- licences

@pytest.mark.parametrize(
    ("text", "verdict"),
    [
        ("SPDX-License-Identifier: MIT OR GPL-3.0-only", "allow"),
        ("// SPDX-License-Identifier: MIT AND GPL-3.0-only", "deny"),
        ("License: (MIT OR GPL-2.0) AND Apache-2.0", "allow"),
        ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0", "allow"),
        ("SPDX-License-Identifier: SomethingElse-1.0", "unknown"),
        ("SPDX-License-Identifier: MIT OR", "unknown"),
        ("Released under the\nMIT   License", "allow"),
        ("sublicense: mit", "none"),
        ("", "none"),
        (None, "none"),
    ],
)
def test_licence_verdicts(text, verdict):
    assert licences.scan(text)[2] == verdict


def test_shunting_yard_binds_with_before_and_before_or():
    assert licences.postfix("a or b and c with d".split()) == ["a", "b", "c", "d", "with", "and", "or"]
    assert licences.postfix(["(", "a", "or", "b", ")", "and", "c"]) == ["a", "b", "or", "c", "and"]
    assert licences.postfix(["a", "and"]) is None and licences.postfix(["(", "a"]) is None


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("SPDX-License-Identifier: CC-BY-NC-4.0 WITH Classpath-exception-2.0", (["cc-by-nc-4.0 with classpath-exception-2.0"], "deny")),
        ("SPDX-License-Identifier: LicenseRef-Proprietary WITH LLVM-exception", (["licenseref-proprietary with llvm-exception"], "deny")),
        ("SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", (["apache-2.0 with llvm-exception"], "allow")),
        ("SPDX-License-Identifier: MIT/Apache-2.0", (["mit or apache-2.0"], "allow")),
        ("License: GPL-3.0/MIT\nmore", (["gpl-3.0 or mit"], "allow")),
        ("License: see the file", ([], "none")),
        ("License: MIT, see the file", (["mit"], "allow")),
        ("x" * 300_000 + "\nLicense: AGPL-3.0\n" + "y" * 300_000, (["agpl-3.0"], "deny")),
    ],
)
def test_licence_expressions(text, found):
    expressions, _, verdict = licences.scan(text)
    assert (expressions, verdict) == found


def brute_matches(text, words):
    """All positions times all words, the leftmost, then longest first."""
    out, free = [], 0
    for start in range(len(text)):
        for word in sorted(words, key=len, reverse=True):
            end = start + len(word)
            before = start == 0 or not text[start - 1].isalnum() or not word[0].isalnum()
            after = end == len(text) or not text[end : end + 1].isalnum() or not word[-1].isalnum()
            if start >= free and text[start:end] == word and before and after:
                out.append((start, word))
                free = end
                break
    return out


def brute_value(found):
    """Recursive descent: or, and, with, brackets; None where the tokens are no expression."""
    at = 0

    def side(operator, below, join):
        nonlocal at
        value = below()
        while at < len(found) and found[at] == operator:
            at += 1
            value = join(value, below())
        return value

    def leaf():
        nonlocal at
        t = found[at]
        at += 1
        if t == "(":
            value = side("or", both, lambda a, b: (max(a[0], b[0]), None))
            if found[at] != ")":
                raise ValueError
            at += 1
            return value
        if t in (")", "and", "or", "with"):
            raise ValueError
        return licences.value_of(t), t

    def exception(a, b):
        return (licences.ALLOW if a[1] in licences.EXCEPTIONS.get(b[1], ()) else min(a[0], licences.UNKNOWN)), None

    def both():
        return side("and", lambda: side("with", leaf, exception), lambda a, b: (min(a[0], b[0]), None))

    try:
        value = side("or", both, lambda a, b: (max(a[0], b[0]), None))
    except (IndexError, ValueError):
        return None
    return value[0] if at == len(found) else None


def test_licence_matches_equal_brute_force():
    rng = np.random.default_rng(6)
    words = tuple(licences.NOTICES)
    parts = [*words, *(w[: len(w) // 2] for w in words), *(w[3:] for w in words), " ", "x", ".", "license", "7", "\u00e9"]
    for _ in range(150):
        text = "".join(parts[int(i)] + (" " if rng.random() < 0.5 else "") for i in rng.integers(0, len(parts), 12))
        assert licences.matches(text, words) == brute_matches(text, words)


def test_expressions_equal_recursive_descent():
    rng = np.random.default_rng(7)
    pool = ["mit", "gpl-2.0", "mpl-2.0", "apache-2.0", "foo-1.0", "classpath-exception-2.0", "llvm-exception", "and", "or", "with", "and", "or", "with", "(", ")", "(", ")"]
    parsed = 0
    for _ in range(6000):
        found = [pool[int(i)] for i in rng.integers(0, len(pool), int(rng.integers(1, 9)))]
        form = licences.postfix(found)
        want = brute_value(found)
        assert (None if form is None else licences.evaluate(form)) == want, found
        parsed += want is not None
    assert parsed > 300


def test_licence_scan_odd_rows(odd, empty):
    rows = licences.scan_licences(odd).collect()
    assert len(rows) == odd.count() and all((r["expressions"], r["licences"], r["verdict"]) == ([], [], "none") for r in rows)
    assert licences.scan_licences(empty).count() == 0


# --- language ID

def test_gradient_is_the_numerical_one():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in language_id.new_parameters(3, 4).items()}
    windows = rng.integers(97, 123, (3, 9)).astype(np.int16)
    windows[2, 6:] = language_id.PAD
    labels = np.array([0, 1, 2])
    _, g = language_id.loss_and_gradient(p, windows, labels)
    for name in ("uz", "ur", "uc", "v", "b", "xc", "xr"):
        flat, grad = p[name].reshape(-1), g[name].reshape(-1)
        for i in rng.choice(np.flatnonzero(np.abs(grad) > 1e-7) if (np.abs(grad) > 1e-7).any() else np.arange(len(flat)), 3):
            kept, step = flat[i], 1e-6
            flat[i] = kept + step
            up = language_id.loss_and_gradient(p, windows, labels)[0]
            flat[i] = kept - step
            down = language_id.loss_and_gradient(p, windows, labels)[0]
            flat[i] = kept
            assert abs((up - down) / (2 * step) - grad[i]) < 1e-5


def test_states_equal_a_loop_over_bytes():
    p = language_id.new_parameters(2, 3)
    window = np.array([[104, 105, 33, language_id.PAD]], np.int16)
    got = language_id.states(p, language_id.both_ways(window))
    for way, symbols in enumerate((window[0], window[0][::-1])):
        h = np.zeros(3)
        for t, x in enumerate(symbols):
            z = np.clip(p["xz"][way, x] + h @ p["uz"][way] + 0.5, 0, 1)
            r = np.clip(p["xr"][way, x] + h @ p["ur"][way] + 0.5, 0, 1)
            candidate = np.clip(p["xc"][way, x] + r * (h @ p["uc"][way]), -1, 1)
            h = h + z * (candidate - h)
            assert np.allclose(got[t, way, 0], h, atol=1e-5)


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and length(text) > 40")
    names, texts, labels = language_id.training_texts(train, 60)
    p = language_id.train(texts, labels, len(names), 150)
    found = language_id.apply(test.select("doc_id", "text"), p, names)
    joined = found.join(test.select("doc_id", "lang", F.length(F.encode("text", "UTF-8")).alias("bytes")), "doc_id")
    right, n, whole = joined.agg(F.avg((F.col("language") == F.col("lang")).cast("double")), F.count("*"), F.bool_and(F.col("bytes") == F.col("n_positions"))).first()
    assert n > 300 and right > 0.95 and whole


def test_language_id_odd_rows(odd, empty):
    got = language_id.identify(odd, steps=20, train_docs=5).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[100]["language"] is None and by[101]["language"] is None and by[100]["n_positions"] == 0
    assert by[105]["n_positions"] == 50_000
    assert all(sum(x["positions"] for x in r["labels"]) == r["n_positions"] for r in got)
    kept = language_id.known_language(odd, steps=20, train_docs=5)
    assert kept.columns == odd.columns and not {100, 101} & {r["doc_id"] for r in kept.collect()}
    assert language_id.identify(empty).count() == 0 and language_id.known_language(empty).count() == 0
    assert language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).where("language is not null").count() == 0
    one = language_id.identify(odd.withColumn("lang", F.lit("en"))).where("n_positions > 0")
    assert {(r["language"], r["probability"]) for r in one.collect()} == {("en", 1.0)}


# --- class-based scores

def brute_model(texts, size):
    words = [language_model.words(t) for t in texts]
    counts = Counter(w for ws in words for w in ws)
    top = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]
    index = {w: i + language_model.FIRST for i, w in enumerate(top)}
    grams = Counter()
    for ws in words:
        if ws:
            ids = [0, *[index.get(w, 1) for w in ws], 0]
            grams.update(zip(ids, ids[1:]))
    return counts, top, index, grams


def test_class_scores_equal_brute_force(odd):
    texts = [r["text"] for r in odd.collect()]
    model = language_model.fit(odd, 12, 5, 3)
    counts, top, index, grams = brute_model(texts, 12)
    assert model.top == top
    cls = model.classes
    table, n_of = Counter(), Counter()
    for (a, b), n in grams.items():
        table[cls[a], cls[b]] += n
        n_of[b] += n
    k = max(cls) + 1
    total = sum(table.values())
    column = {d: sum(table[c, d] for c in range(k)) for d in range(k)}

    def log_p(a, b):
        c, d = cls[a], cls[b]
        row, kinds = sum(table[c, x] for x in range(k)), sum(table[c, x] > 0 for x in range(k))
        back = (column[d] + 1) / (total + k)
        move = (table[c, d] + kinds * back) / (row + kinds) if row else back
        emit = 1.0 if b == 0 else 1 / (len(counts) - len(top) + 1) if b == 1 else n_of[b] / column[d]
        return math.log(move) + math.log(emit)

    got = sorted((r["n_words"], -1.0 if r["log_prob"] is None else round(-r["log_prob"], 4)) for r in language_model.apply(odd, model).collect())
    want = []
    for t in texts:
        ws = language_model.words(t)
        ids = [0, *[index.get(w, 1) for w in ws], 0]
        want.append((len(ws), round(-sum(log_p(a, b) for a, b in zip(ids, ids[1:])), 4) if ws else -1.0))
    for (n, a), (m, b) in zip(got, sorted(want)):
        assert n == m and abs(a - b) < 1e-3 * max(1, abs(b))


def test_exchange_never_lowers_likelihood_and_moves_as_recomputed():
    rng = np.random.default_rng(2)
    pairs = Counter((int(a), int(b)) for a, b in rng.zipf(1.4, (4000, 2)) % 30 if (a, b) != (0, 0))
    grams = np.array(sorted((a, b, n) for (a, b), n in pairs.items()))
    k, n_words = 6, 28
    before = None
    for passes in range(4):
        classes = language_model.exchange(grams, n_words, k, passes)
        value = language_model.likelihood(language_model.class_table(grams, classes, k))
        assert before is None or value >= before - 1e-6
        before = value
    classes = language_model.exchange(grams, n_words, k, 1)
    w = 5
    best = []
    for d in range(language_model.FIRST, k):
        moved = classes.copy()
        moved[w] = d
        best.append(language_model.likelihood(language_model.class_table(grams, moved, k)))
    table = language_model.class_table(grams, classes, k).astype(float)
    own = float(sum(n for a, b, n in grams if a == b == w))
    right = np.bincount(classes[grams[grams[:, 0] == w, 1]], grams[grams[:, 0] == w, 2], k).astype(float)
    left = np.bincount(classes[grams[grams[:, 1] == w, 0]], grams[grams[:, 1] == w, 2], k).astype(float)
    c = classes[w]
    right[c] -= own
    left[c] -= own
    table[c] -= right
    table[:, c] -= left
    table[c, c] -= own
    assert language_model.best_class(table, left, right, own, 2) == 2 + int(np.argmax(best))


def test_class_scores_odd_rows(odd, empty):
    got = language_model.score_documents(odd, 50, 6, 2).collect()
    assert len(got) == odd.count()
    assert all((r["perplexity"] is None) == (r["n_words"] == 0) for r in got)
    assert language_model.score_documents(empty).count() == 0


def test_every_word_of_the_corpus_is_scored_by_its_own_count(spark):
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(400)]
    texts = [" ".join(names[int(j) % 400] for j in rng.zipf(1.3, 40)) for _ in range(60)] + ["...", None, "w0 w0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    head = language_model.fit(docs, 20, 6, 3)
    counts, top, index, grams = brute_model(texts, 20)
    cls, k = head.classes, int(max(head.classes)) + 1
    table = np.zeros((k, k))
    for (a, b), n in grams.items():
        table[cls[a], cls[b]] += n
    move, column = language_model.transitions(table), table.sum(0)
    of = {w: int(cls[i]) for w, i in index.items()}
    contexts = {}
    for t in texts:
        ws = language_model.words(t)
        c = [0, *[of.get(w, 1) for w in ws], 0]
        for i, w in enumerate(ws):
            if w not in index:
                contexts.setdefault(w, []).append((c[i], c[i + 2]))
    for w, around in contexts.items():
        gain = [sum(move[a, d] + move[d, b] for a, b in around) - len(around) * math.log(column[d] + len(around)) if column[d] else -math.inf for d in range(2, k)]
        of[w] = 2 + int(np.argmax(np.round(gain, 6)))
    full = np.zeros((k, k))
    for t in texts:
        if ws := language_model.words(t):
            c = [0, *[of[w] for w in ws], 0]
            np.add.at(full, (c[:-1], c[1:]), 1)
    move, column = language_model.transitions(full), full.sum(0)
    got = {r["doc_id"]: r["log_prob"] for r in language_model.score_documents(docs, 20, 6, 3).collect()}
    assert len(contexts) > 50 and max(counts[w] for w in contexts) > min(counts[w] for w in contexts)
    for i, t in enumerate(texts):
        ws = language_model.words(t)
        c = [0, *[of[w] for w in ws], 0]
        want = sum(move[a, b] for a, b in zip(c, c[1:])) + sum(math.log(counts[w] / column[of[w]]) for w in ws)
        assert (got[i] is None) if not ws else abs(got[i] - want) < 1e-6 * abs(want)


def test_language_sample_is_whole_without_ids_and_with_repeated_rows(spark):
    texts = [(None, f"{w} text number {i}", w) for w in ("aa", "bb") for i in range(700)]
    texts += [(i % 2, "the same words again", "cc") for i in range(700)] + [(None, "", "bb")] * 3000
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    names, _, labels = language_id.training_texts(docs, 20)
    assert names == ["aa", "bb", "cc"] and np.bincount(labels).tolist() == [20, 20, 20]


def test_two_hundred_languages_and_a_kept_model(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{chr(0x4E00 + i)} " * 30, f"l{i:03d}") for i in range(200)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, 2, 3)
    language_id.save(model, f"{tmp_path}/m.npz")
    kept = language_id.load(f"{tmp_path}/m.npz")
    assert kept[0] == model[0] and len(kept[0]) == 200
    got, again = (sorted(map(str, language_id.identify(docs, model=m).collect())) for m in (model, kept))
    assert got == again and len(got) == 200
    assert all(sum(x["positions"] for x in r["labels"]) == r["n_positions"] for r in language_id.identify(docs, model=kept).collect())


def test_training_reads_whole_texts():
    texts, labels = [b"a" * 300 + b"z" * 84, b"b" * 20], np.array([0, 1])
    rng = np.random.default_rng(0)
    seen = {language_id._any_window(texts[0], 128, rng).tobytes() for _ in range(60)}
    assert seen == {w.tobytes() for w in language_id.windows_of(texts[0])}
    assert language_id.train(texts, labels, 2, 2)["v"].shape[2] == 2
