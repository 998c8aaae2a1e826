"""SimHash and embedding near-dedup, phrase fingerprints, components and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioweave.llm import embedding_dedup, hamming, links, lz_fingerprint, packing, simhash_dedup
from folioweave.llm.components import components
from folioweave.llm.queries import QUERIES


def near_copies(n=60, copies=4, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(len(text) // 25):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append(" ".join(text))
    rng.shuffle(out)
    return list(enumerate(out)) + [(900, out[0]), (901, out[0])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(near_copies(), "doc_id long, text string").cache()


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components_equal_union_find(spark, one_task):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(200, 240)] + [(3, 3), (None, 4)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {(x, find(x)) for x in root if find(x) != x}
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()} == want


def brute_groups(ids, linked):
    """Lowest id of each id's component under ``linked(i, j)`` on places."""
    root = {x: x for x in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    return {x: find(x) for x in ids}


def test_forest_keeps_components():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.integers(0, 50, (2, 30))
        ids, root = links.lowest(a, b)
        want = brute_groups(sorted({*a.tolist(), *b.tolist()}), lambda i, j: False)
        pairs = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
        names = sorted({*a.tolist(), *b.tolist()})
        want = brute_groups(names, lambda i, j: (names[j], names[i]) in pairs)
        assert dict(zip(ids.tolist(), root.tolist())) == want


@pytest.mark.parametrize("block", [links.BLOCK, 8])
def test_linked_loses_no_link_of_a_shared_cell(spark, monkeypatch, block):
    """Items on a line, linked within 2; all of them share a hot cell, which is split where blocks are small."""
    monkeypatch.setattr(links, "BLOCK", block)
    monkeypatch.setattr(links, "COUNTED", 1)
    rng = random.Random(4)
    at = [rng.randrange(400) for _ in range(150)] + [1000 + i for i in range(60)]
    items = spark.createDataFrame(list(enumerate(at)), "id long, at long")
    near = lambda a, b: F.abs(F.col(f"{a}.at") - F.col(f"{b}.at")) <= 2
    few = lambda rows: rows.withColumn("cells", F.array(F.floor(F.col("at") / 3)))
    many = lambda rows: rows.withColumn("cells", F.array(F.lit(-1).cast("long"), F.floor(F.col("at") / 100)))
    got = {r["node"]: r["root"] for r in links.linked(items, ["at"], near, few, many).collect()}
    want = brute_groups(range(len(at)), lambda i, j: abs(at[i] - at[j]) <= 2)
    assert got == {x: r for x, r in want.items() if x != r} and len(got) > 60


def flipped(rng, base, n):
    out = base.copy()
    out[rng.choice(len(base), n, replace=False)] ^= 1
    return out


def test_grids_lose_nothing_up_to_the_pigeonhole_bound_and_recall_holds_at_the_limit():
    """Share of pairs that meet in a cell, by distance."""
    rng = np.random.default_rng(9)
    dims, most = simhash_dedup.DIMS, simhash_dedup.MAX_DISTANCE
    sure = 2 * len(simhash_dedup._segments(dims, most)) - 1

    def met(distance, n=400):
        x = rng.integers(0, 2, (n, simhash_dedup.BITS)).astype(np.uint8)
        y = np.array([flipped(rng, row, distance) for row in x])
        cells = []
        for bits in (x, y):
            found, sizes = simhash_dedup.cells(bits.reshape(n, -1, simhash_dedup.SEGMENT).sum(2, dtype=np.int64), dims, most)
            cells.append([set(p.tolist()) for p in np.split(found, np.cumsum(sizes)[:-1])])
        return np.mean([bool(a & b) for a, b in zip(*cells)])

    assert sure >= 17 and all(met(d, 150) == 1.0 for d in (1, 8, 16, sure - 1, sure))
    assert met(36) >= 0.97 and met(most, 1500) >= 0.94
    assert abs(met(128, 1500) - len(simhash_dedup._segments(dims, most)) * simhash_dedup.meeting(dims, 128)) < 0.03


def at_distances(distances, seed=21):
    """Fingerprints in pairs (rows 2 i and 2 i + 1) at just these distances."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2, (len(distances), simhash_dedup.BITS)).astype(np.uint8)
    y = np.array([flipped(rng, row, d) for row, d in zip(x, distances)])
    return np.packbits(np.stack([x, y], axis=1).reshape(-1, simhash_dedup.BITS), axis=1).view(">i8").astype(np.int64)


def test_simhash_links_every_pair_at_the_limit_and_none_beyond(spark):
    most = simhash_dedup.MAX_DISTANCE
    words = at_distances([most] * 400 + [most + 1] * 100)
    prints = spark.createDataFrame([(i, *map(int, w)) for i, w in enumerate(words)], "id long, f0 long, f1 long, f2 long, f3 long")
    got = {tuple(r) for r in simhash_dedup.groups(prints).select("node", "root").collect()}
    assert got == {(2 * i + 1, 2 * i) for i in range(400)}


def test_pipeline_drops_one_of_every_pair_at_the_limit(spark, monkeypatch):
    words = at_distances([simhash_dedup.MAX_DISTANCE] * 400, 23)
    prints = spark.createDataFrame([(i, *map(int, w)) for i, w in enumerate(words)], "doc_id long, f0 long, f1 long, f2 long, f3 long")
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda docs: prints)
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(800)], "doc_id long, text string")
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    # equal fingerprints apart, the lower id of each pair stays
    assert sorted(kept) == list(range(0, 800, 2))


@pytest.mark.parametrize("most", [5, 44, 60])
@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("grids_from", [0, 2**40])
def test_blocks_of_fingerprints_lose_no_pair(monkeypatch, grids_from, parts, most):
    """Both ways of searching, within a block and between two, and with one cell full."""
    monkeypatch.setattr(hamming, "GRIDS_FROM", grids_from)
    monkeypatch.setattr(hamming, "STEP", 50)
    monkeypatch.setattr(hamming, "WIDE", 70)
    words = np.concatenate([at_distances([d for d in (0, 1, most - 1, most, most + 1) for _ in range(15)]), np.arange(80)[:, None] * np.ones(4, np.int64)])
    far = np.bitwise_count((words[:, None] ^ words[None]).view(np.uint64)).sum(2, dtype=int)
    same = {(min(p), max(p)) for part in range(parts) for i, j in hamming.pairs(words, words, True, most, part, parts) for p in zip(i.tolist(), j.tolist())}
    assert same == {(i, j) for i, j in zip(*np.nonzero(far <= most)) if i < j}
    left, right = words[::2], words[1::2]
    two = {p for part in range(parts) for i, j in hamming.pairs(left, right, False, most, part, parts) for p in zip(i.tolist(), j.tolist())}
    assert two == set(zip(*np.nonzero(far[::2, 1::2] <= most)))


def test_several_blocks_and_tasks_link_the_same(spark, monkeypatch):
    monkeypatch.setattr(hamming, "BLOCK", 60)
    monkeypatch.setattr(hamming, "PAIRS", 1000)
    words = at_distances([simhash_dedup.MAX_DISTANCE] * 80)
    items = spark.createDataFrame([(i, i, *map(int, w)) for i, w in enumerate(words)], "id long, root long, f0 long, f1 long, f2 long, f3 long")
    got = {(min(r), max(r)) for r in map(tuple, hamming.within(items, simhash_dedup.WORDS, simhash_dedup.MAX_DISTANCE).collect())}
    assert got == {(2 * i, 2 * i + 1) for i in range(80)}


def test_simhash_groups_equal_brute_force(spark, docs):
    rows = docs.collect()
    bits, _ = simhash_dedup.fingerprint_bits([r["text"] for r in rows])
    far = (bits[:, None, :] != bits[None, :, :]).sum(2)
    ids = [r["doc_id"] for r in rows]
    want = brute_groups(ids, lambda i, j: far[i, j] <= simhash_dedup.MAX_DISTANCE)
    want = {x: r for x, r in want.items() if x != r}
    got = {r["doc_id"]: r["kept_doc_id"] for r in simhash_dedup.copies(docs).collect()}
    assert set(got) <= set(want) and len(want) > 40 and sum(got.get(x) == r for x, r in want.items()) >= 0.97 * len(want)
    assert {900, 901} <= set(got) and not set(got) & set(got.values())


def test_rows_of_one_doc_id_link_their_texts(spark, docs):
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(3).collect()]
    rows = [(1, texts[0]), (2, texts[0]), (2, "quite other words stand here"), (9, "quite other words stand here"), (4, None)]
    got = {tuple(r) for r in simhash_dedup.copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, 1), (9, 1)}


def test_popcounts_never_exceed_the_distance():
    rng = np.random.default_rng(0)
    words = rng.integers(-(2**62), 2**62, (50, 4))
    bits = np.unpackbits(words.astype(">i8").view(np.uint8).reshape(50, 32), axis=1)
    counts = simhash_dedup.popcounts(words)
    assert (np.abs(counts[:, None] - counts[None]).sum(2) <= (bits[:, None] != bits[None]).sum(2)).all()


def test_simhash_odd_rows(odd, empty):
    kept = simhash_dedup.dedup_documents(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {100, 101, 102, 103, None} <= set(ids) and not {1, 106} <= set(ids)
    assert simhash_dedup.dedup_documents(empty).count() == 0


def test_phrases_equal_a_dictionary_parse():
    text = "a b a b a b c A, b; c a b c d"
    known, phrase = set(), ()
    for w in lz_fingerprint._WORD.findall(text.lower()):
        phrase = (*phrase, w)
        if phrase not in known:
            known.add(phrase)
            phrase = ()
    assert len(lz_fingerprint.phrases(text)) == len(known)
    assert lz_fingerprint.phrases("one two three one two four") == lz_fingerprint.phrases("One, two three; one two FOUR!")


def test_bands_hold_recall_from_the_threshold_up():
    """Signatures that agree in just as many hashes as the threshold asks, or more, meet in a band."""
    rng = np.random.default_rng(3)
    least = lz_fingerprint.least_equal(lz_fingerprint.MIN_SIMILARITY)
    for rows in (3, 4, 5):
        bands = lz_fingerprint.bands_of(rows)
        for equal in (least, least + 4, least + 10):
            agree = np.array([np.isin(np.arange(lz_fingerprint.HASHES), rng.choice(lz_fingerprint.HASHES, equal, replace=False)) for _ in range(1500)])
            assert agree[:, bands].all(2).any(1).mean() >= 0.94, (rows, equal)
    assert [lz_fingerprint.rows_for(n) for n in (0, 10**6, 10**7, 10**9)] == [3, 3, 4, 6]


def loose_copies(seed=11):
    """Texts of which copies keep from nearly all words down to about half."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(50):
        base = [rng.choice(words) for _ in range(150)]
        rows.append(" ".join(base))
        for share in (0.02, 0.1, 0.2, 0.3, 0.4):
            rows.append(" ".join(rng.choice(words) if rng.random() < share else w for w in base))
    rows += rows[:40] * 2
    rng.shuffle(rows)
    return [(7 * i % 1009, t) for i, t in enumerate(rows)]


def test_fingerprint_classes_equal_brute_force(spark):
    rows = loose_copies()
    ids, signs = [i for i, _ in rows], np.array([lz_fingerprint.minimum_hashes(lz_fingerprint.phrases(t)) & np.uint64(255) for _, t in rows])
    equal = (signs[:, None] == signs[None]).sum(2)
    least = lz_fingerprint.least_equal(lz_fingerprint.MIN_SIMILARITY)
    want = brute_groups(ids, lambda i, j: equal[i, j] >= least)
    got = {r["doc_id"]: r for r in lz_fingerprint.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i]["class_id"] == r for i, r in want.items()]) >= 0.97
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if least <= equal[i, j] < 64]
    assert len(pairs) > 300 and np.mean([got[ids[i]]["class_id"] == got[ids[j]]["class_id"] for i, j in pairs]) >= 0.97
    # numbers of links and similarities hold for the classes found
    for i, r in got.items():
        members = [k for k, x in enumerate(ids) if got[x]["class_id"] == r["class_id"]]
        assert r["n_links"] == len({signs[k].tobytes() for k in members}) - 1
        share = equal[ids.index(i), ids.index(r["class_id"])] / 64
        assert abs(r["similarity"] - max(0.0, (share - 1 / 256) / (1 - 1 / 256))) < 1e-9


def test_fingerprints_link_every_pair_at_the_threshold_and_none_below(spark, monkeypatch):
    """Pairs of signatures that agree in just as many bytes as the threshold asks, or in one byte less."""
    least = lz_fingerprint.least_equal(lz_fingerprint.MIN_SIMILARITY)
    rng = np.random.default_rng(31)
    rows = []
    for i in range(500):
        x = rng.integers(0, 256, lz_fingerprint.HASHES).astype(np.uint8)
        y = x.copy()
        y[rng.choice(len(x), len(x) - least + (i >= 400), replace=False)] ^= rng.integers(1, 256, dtype=np.uint8)
        rows += [x, y]
    texts = {f"t{i}": row for i, row in enumerate(rows)}
    monkeypatch.setattr(lz_fingerprint, "fingerprints", lambda docs: planted(docs, texts))
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(len(rows))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lz_fingerprint.similar_documents(docs).collect()}
    assert sum(r["n_links"] > 0 for r in got.values()) == 800
    assert all(got[2 * i + 1]["class_id"] == 2 * i for i in range(400))


def planted(docs, texts):
    """The fingerprints of ``docs`` with other signatures."""
    signs = np.array([texts[r["text"]] for r in docs.orderBy("doc_id").collect()])
    planes = [np.packbits((signs >> k) & 1, axis=1).view("<i8")[:, 0] for k in range(3)]
    rows = [(i, 9, *map(int, word), *(int(p[i]) for p in planes)) for i, word in enumerate(np.ascontiguousarray(signs).view("<i8"))]
    kinds = [f"{s} long" for s in [*lz_fingerprint.SIGNATURE, "p0", "p1", "p2"]]
    return docs.sparkSession.createDataFrame(rows, ", ".join(["doc_id long", "n_phrases long", *kinds]))


def test_cells_and_lower_bits_hold_every_pair_at_any_threshold(spark):
    rng = np.random.default_rng(32)
    for share in (0.1, 0.3, 0.5, 0.8, 1.0):
        least = lz_fingerprint.least_equal(share)
        x = rng.integers(0, 256, (200, lz_fingerprint.HASHES)).astype(np.uint8)
        y = np.array([np.where(np.isin(np.arange(len(v)), rng.choice(len(v), least, replace=False)), v, v ^ 8) for v in x]).astype(np.uint8)
        words = [np.ascontiguousarray(v).view("<i8") for v in (x, y)]
        rows = [(k, i, *map(int, w)) for k in (0, 1) for i, w in enumerate(words[k])]
        placed = spark.createDataFrame(rows, ", ".join(["side int", "i long", *(f"{s} long" for s in lz_fingerprint.SIGNATURE)])).withColumn("cells", lz_fingerprint.cells(least))
        of = {(r["side"], r["i"]): set(r["cells"]) for r in placed.collect()}
        assert all(of[0, i] & of[1, i] for i in range(200)), share


def signed(rng, n, kinds):
    """Pairs of signatures that agree in just as many bytes as the threshold asks, or in one less, and some with few kinds of bytes in the first groups."""
    least = lz_fingerprint.least_equal(lz_fingerprint.MIN_SIMILARITY)
    x = rng.integers(0, 256, (n, lz_fingerprint.HASHES)).astype(np.uint8)
    x[n // 2 :, :40] = rng.integers(0, kinds, (n - n // 2, 40))
    y = x.copy()
    for i, row in enumerate(y):
        row[rng.choice(len(row), len(row) - least + i % 2, replace=False)] ^= rng.integers(1, 256, dtype=np.uint8)
    return np.concatenate([x, y])


@pytest.mark.parametrize("block, held", [(links.BLOCK, links.HELD), (1, 40), (links.BLOCK, 40)])
def test_routes_lose_no_pair_of_different_classes(spark, monkeypatch, block, held):
    """Also where halves and cells have many rows, and where a task takes its routes in parts."""
    monkeypatch.setattr(links, "BLOCK", block)
    monkeypatch.setattr(links, "COUNTED", 1)
    monkeypatch.setattr(lz_fingerprint, "HELD", held)
    least = lz_fingerprint.least_equal(lz_fingerprint.MIN_SIMILARITY)
    signs = signed(np.random.default_rng(41), 300, 3)
    texts = {f"t{i}": row for i, row in enumerate(signs)}
    prints = planted(spark.createDataFrame([(i, f"t{i}") for i in range(len(signs))], "doc_id long, text string"), texts)
    rooted = prints.withColumnRenamed("doc_id", "id").withColumn("root", F.when(F.col("id") < 20, F.lit(0)).otherwise(F.col("id")).cast("long"))
    got = [tuple(r) for found in lz_fingerprint.meetings(rooted, least) for r in found.collect()]
    equal, low = (signs[:, None] == signs[None]).sum(2), ((signs[:, None] & 7) == (signs[None] & 7)).sum(2)
    want = {(i, j) for j in range(len(signs)) for i in range(j) if equal[i, j] >= least and j >= 20}
    assert len(want) >= 150 and want <= set(got)
    assert all(low[i, j] >= least and i < j and j >= 20 for i, j in got)


def test_fingerprints_shuffle_half_as_many_rows_as_there_are_cells(spark, monkeypatch):
    signs = signed(np.random.default_rng(42), 500, 256)
    texts = {f"t{i}": row for i, row in enumerate(signs)}
    monkeypatch.setattr(lz_fingerprint, "fingerprints", lambda docs: planted(docs, texts))
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(len(signs))], "doc_id long, text string")
    before = set(written(spark))
    assert lz_fingerprint.similar_documents(docs).count() == len(signs)
    rows = sum(n for stage, n in written(spark).items() if stage not in before)
    assert 32 * len(signs) < rows < 75 * len(signs)


def written(spark):
    """Rows that each stage wrote to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._jvm.java.util.ArrayList
    stages = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
    return {(s := stages.apply(i)).stageId(): s.shuffleWriteRecords() for i in range(stages.size())}


def test_signatures_estimate_jaccard(docs):
    rows = docs.collect()
    sets = [lz_fingerprint.phrases(r["text"]) for r in rows]
    signs = np.array([lz_fingerprint.minimum_hashes(s) & np.uint64(255) for s in sets])
    error = [abs((signs[i] == signs[j]).mean() - len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in range(len(sets)) for j in range(i)]
    assert np.mean(error) < 0.08


def test_fingerprints_odd_rows(odd, empty):
    got = lz_fingerprint.similar_documents(odd).collect()
    assert len(got) == odd.count()
    of = {r["doc_id"]: r for r in got}
    assert of[106]["class_id"] == of[1]["class_id"] == 1 and of[1]["similarity"] == 1.0
    assert all(r["class_id"] is None and r["n_links"] == 0 and r["similarity"] is None for r in got if r["doc_id"] in (None, 100, 101, 102, 103))
    assert of[104]["class_id"] == 104
    assert lz_fingerprint.similar_documents(empty).count() == 0


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 48))
    near = base[rng.integers(0, 150, 150)] + rng.normal(size=(150, 48)) * rng.uniform(0.05, 0.5, (150, 1))
    return np.concatenate([base, near])


def test_estimate_is_unbiased_and_bounded(vectors):
    x = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    e = embedding_dedup.encode(x)
    turned = x @ embedding_dedup.rotation(48, embedding_dedup.BITS)
    signs = np.where(turned > 0, 1, -1) / np.sqrt(embedding_dedup.BITS)
    error = (signs @ turned.T) / e["factor"][:, None] - x @ x.T
    assert abs(error.mean()) < 0.003
    factor = e["factor"][:, None]
    bound = embedding_dedup.EPSILON * np.sqrt(1 - factor**2) / factor / np.sqrt(embedding_dedup.BITS - 1)
    assert (np.abs(error) <= bound).mean() > 0.99


def test_bands_hold_recall_at_the_least_cosine():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 64))
    y = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(1)[:, None] * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1)[:, None]
    turn = embedding_dedup.rotation(64, embedding_dedup.BITS)
    agree = (x @ turn > 0) == (y @ turn > 0)
    for n in (1000, 10**5, 10**7):
        assert agree[:, embedding_dedup.bands_of(n)].all(2).any(1).mean() >= 0.93


def test_embedding_classes_equal_brute_force(spark, vectors):
    x = np.concatenate([vectors, vectors[:40], vectors[:20]])
    table = spark.createDataFrame([(37 * i % 1009, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, cosine = [37 * i % 1009 for i in range(len(x))], x @ x.T
    want = brute_groups(ids, lambda i, j: cosine[i, j] >= 0.9)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(table).collect()}
    assert len(got) == len(x) and np.mean([got[i]["class_id"] == r for i, r in want.items()]) >= 0.97
    assert len({r["class_id"] for r in got.values()}) < len(x) - 80
    for i, r in got.items():
        members = [k for k, v in enumerate(ids) if got[v]["class_id"] == r["class_id"]]
        assert r["n_links"] == len({x[k].astype(np.float32).tobytes() for k in members}) - 1
        assert abs(r["cosine"] - cosine[ids.index(i), ids.index(r["class_id"])]) < 1e-6


def test_codes_do_not_depend_on_the_partitioning(spark, vectors):
    x = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    whole, half = embedding_dedup.encode(x), embedding_dedup.encode(x[50:60])
    assert all(np.array_equal(whole[k][50:60], half[k]) for k in whole if k[0] in "cp") and np.array_equal(whole["total"][50:60], half["total"])


def test_embedding_odd_rows(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, None, None), (4, [], "x"), (5, [0.0, 0.0], "x"), (6, [float("nan"), 1.0], "x")]
    rows += [(None, [1.0, 0.0], "x"), (7, [1.0, 0.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (8, [None, 1.0], "x"), (9, [float(i) for i in range(1, 400)], "x"), (10, [float(i) + 0.01 for i in range(1, 400)], "x")]
    schema = "vec_id long, embedding array<float>, band string"
    got = sorted((tuple(r)[:3] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    want = [(1, 1, 0), (1, 1, 0), (2, 1, 0), (7, 7, 0), (9, 9, 1), (10, 9, 1), *((i, None, 0) for i in (3, 4, 5, 6, 8, None))]
    assert got == sorted(want, key=str)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_pipeline_keeps_columns_and_every_decision(spark, odd, empty, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    pieces = {r["doc_id"] for r in last.collect()}
    assert pieces == {r["doc_id"] for r in docs.collect() if r["text"]}
    assert last.agg(F.max("length")).first()[0] <= packing.CAPACITY
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 11)}


def test_run_writes_each_stage_and_leaves_only_the_last_table(spark, odd, tmp_path, monkeypatch):
    from folioweave.llm import language_id

    monkeypatch.setattr(language_id, "STEPS", 10)
    (tmp_path / "shared").mkdir()
    monkeypatch.setattr(corpus_pipeline, "_folder", lambda spark: f"{tmp_path}/shared/one")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and [p.name for p in (tmp_path / "shared/one").iterdir()] == ["3-source_mixing"]
    assert {r["doc_id"] for r in got} <= {r["doc_id"] for r in odd.collect()}


def test_line_stage_lets_emptied_documents_go_and_no_others(spark):
    lines = "\n".join(f"line {i} of it" for i in range(5))
    rows = [(1, lines), (2, lines), (3, ""), (4, None), (5, lines + "\nown end")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == {1: lines, 3: "", 4: None, 5: "own end"}


def test_pipeline_equals_brute_force(spark, tmp_path, monkeypatch):
    """Every stage again, over its predecessor's rows, by slow means."""
    from collections import Counter

    import duckdb
    import tiktoken
    from test_text_operators import brute_dedup

    from folioweave.llm import language_id, mixing, token_counts

    monkeypatch.setattr(language_id, "STEPS", 25)
    shared = "\n".join(f"a line that many documents share {i}" for i in range(9))
    texts = [t for _, t in near_copies(24, 3, 5)]
    rows = [(i, f"{t}\n{shared}\n{t[:30]}" if i % 4 == 0 else t, "ab"[i % 2], f"src{i % 5}", len(t)) for i, t in enumerate(texts)] + [(500, None, "a", "src0", 0), (501, "", "b", "src1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got, docs = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got[name] = [r.asDict() for r in docs.collect()]
        if name == "language_id":
            names, texts_of, labels = language_id.training_texts(before)
            p = language_id.train(texts_of, labels, len(names), 25)
            want = set()
            for r in rows:
                sums, votes = language_id.label(p, len(names), [r[1]])
                if votes.sum() and sums.max() >= language_id.MIN_PROBABILITY * votes.sum():
                    want.add(r[0])
            assert {r["doc_id"] for r in got[name]} == want and len(want) > 10
    first, second, third, fourth, last = got.values()
    assert {r["doc_id"]: r["text"] for r in second} == {d: t for d, t in brute_dedup([(r["doc_id"], r["text"]) for r in first]).items() if t}
    bits, have = simhash_dedup.fingerprint_bits([r["text"] for r in second])
    ids, root = [r["doc_id"] for r in second], {r["doc_id"]: r["doc_id"] for r in second}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(ids)):
        for j in range(i):
            if have[i] and have[j] and (bits[i] != bits[j]).sum() <= simhash_dedup.MAX_DISTANCE:
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    gone, true = set(ids) - {r["doc_id"] for r in third}, {x for x in ids if find(x) != x}
    assert gone <= true and len(gone) >= 0.9 * len(true) > 5
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/simhash_dedup/*.parquet'")
    copies = {d: n for d, _, n in con.sql(mixing.SQL).fetchall() if n}
    assert Counter(r["doc_id"] for r in fourth) == copies
    encode = tiktoken.Encoding("own", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.load_ranks(token_counts.VOCABULARY), special_tokens={}).encode_ordinary
    lengths = Counter(len(encode(r["text"])) + 1 for r in fourth if r["text"])
    windows = Counter()
    for r in last:
        windows[r["window_id"]] += r["length"]
    filled = [sum(k * n for k, n in filling.items()) for filling, times in packing.plan(lengths) for _ in range(times)]
    assert sorted(windows.values()) == sorted(filled)
