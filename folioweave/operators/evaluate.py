"""Evaluation against reviewed truth: statuses, rates, calibration, splits, thresholds."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import interpolate, log_loss, ratio
from .ranks import counted_before, ranked, running_sums

c = F.col


# --- predictions

def normalize_predictions(rows: DataFrame) -> DataFrame:
    """Predictions under their canonical names, with automatic_edge and ``problem`` (null where the row is coherent).

    Rows may name columns in the older ways; columns that are absent get defaults.
    """
    have = set(rows.columns)

    def pick(*names: str, default: Column) -> Column:
        found = next((n for n in names if n in have), None)
        return default if found is None else F.coalesce(c(found), default)

    none = F.lit(None).cast("string")
    a, b = pick("first_image_id", "image_a", "image_id_a", default=none), pick("second_image_id", "image_b", "image_id_b", default=none)
    flag = lambda *names, default=F.lit(False): pick(*names, default=default).cast("boolean")
    out = rows.withColumns({
        "image_a": F.least(a, b),
        "image_b": F.greatest(a, b),
        "_same": flag("same_document", "deterministic_same_document"),
        "hard_contradiction": flag("hard_contradiction"),
        "candidate_flag": flag("occlusion_candidate_flag", "candidate_flag"),
    })
    p = pick("same_document_probability", default=c("_same").cast("double")).cast("double")
    q = pick("occluded_given_same_probability", default=F.lit(0.0)).cast("double")
    out = out.withColumns({
        "automatic_link_eligible": flag("automatic_link_eligible", default=c("_same")),
        "same_document_probability": p,
        "occluded_given_same_probability": q,
    })
    p, q = c("same_document_probability"), c("occluded_given_same_probability")
    out = out.withColumns({
        "same_clean_probability": pick("same_clean_probability", default=p * (1 - q)),
        "same_occluded_probability": pick("same_occluded_probability", default=p * q),
        "different_document_probability": pick("different_document_probability", default=1 - p),
        "automatic_edge": c("_same") & c("automatic_link_eligible") & ~c("hard_contradiction"),
    })
    unit = lambda name: c(name).between(0.0, 1.0)
    sums = (F.abs(c("same_clean_probability") + c("same_occluded_probability") - p) > 1e-6, F.abs(p + c("different_document_probability") - 1) > 1e-6)
    problem = (
        F.when(c("image_a").isNull() | (c("image_a") == c("image_b")), F.lit("needs two images"))
        .when(~(unit("same_document_probability") & unit("occluded_given_same_probability")), F.lit("no probability"))
        .when(sums[0], F.lit("same states do not add up"))
        .when(sums[1], F.lit("same and different do not add up"))
    )
    return out.withColumn("problem", problem).withColumnRenamed("_same", "deterministic_same_document")


def calibrate(rows: DataFrame, identity: Sequence[tuple[float, float]], conditional: Sequence[tuple[float, float]] = ()) -> DataFrame:
    """Probabilities through isotonic knots; the three states are recomputed."""
    p, q = c("same_document_probability"), c("occluded_given_same_probability")
    return (
        rows.withColumn("same_document_probability", interpolate(p, identity))
        .withColumn("occluded_given_same_probability", interpolate(q, conditional))
        .withColumn("same_clean_probability", p * (1 - q))
        .withColumn("same_occluded_probability", p * q)
        .withColumn("different_document_probability", 1 - p)
    )


# --- statuses

def pair_status(accepted: Column, edge: Column, connected: Column, flagged: Column) -> Column:
    return (
        F.when(accepted & edge, "deterministically_linked").when(accepted & connected, "transitively_connected")
        .when(accepted & flagged, "review_only").when(accepted, "missed_entirely")
        .when(edge, "automatic_false_link").when(connected, "contaminated_component")
        .when(flagged, "candidate_only").otherwise("correctly_separated")
    )


def pair_rows(truth: DataFrame, predictions: DataFrame, components: DataFrame) -> DataFrame:
    """Truth (image_a, image_b, truth) with its prediction, or the default of a pair that was not compared, and its status.

    ``components`` (image_id, root) covers all images; filter splits afterwards.
    """
    key = ["image_a", "image_b"]
    root = components.select("image_id", "root")
    keyed = truth.withColumns({"image_a": F.least("image_a", "image_b"), "image_b": F.greatest("image_a", "image_b")})
    predicted = predictions.select(*key, "automatic_edge", "candidate_flag", "hard_contradiction", "same_document_probability", "occluded_given_same_probability", "reason", F.lit(True).alias("prediction_present"))
    no = F.lit(False)
    rows = (
        keyed.join(predicted, key, "left")
        .withColumns({
            "reason": F.when(c("prediction_present"), c("reason")).otherwise("pair_not_compared"),
            "automatic_edge": F.coalesce("automatic_edge", no), "candidate_flag": F.coalesce("candidate_flag", no),
            "hard_contradiction": F.coalesce("hard_contradiction", no), "prediction_present": F.coalesce("prediction_present", no),
            "same_document_probability": F.coalesce("same_document_probability", F.lit(0.0)),
            "occluded_given_same_probability": F.coalesce("occluded_given_same_probability", F.lit(0.0)),
        })
        .join(root.toDF("image_a", "_ra"), "image_a", "left")
        .join(root.toDF("image_b", "_rb"), "image_b", "left")
        .withColumn("same_component", F.coalesce(c("_ra") == c("_rb"), no))
        .drop("_ra", "_rb")
    )
    accepted = c("truth") == "accepted"
    return rows.withColumn("truth_same_document", accepted.cast("int")).withColumn(
        "pair_status", pair_status(accepted, c("automatic_edge"), c("same_component"), c("candidate_flag"))
    )


def group_status(decision: Column, components: Column, size: Column) -> Column:
    accepted = decision == "accepted"
    return F.when(accepted & (components == 1), "recovered").when(accepted, "split").when(components == size, "separated").otherwise("contaminated")


def group_rows(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members (original_cluster_id, review_decision, image_id) rolled up to group_status."""
    return (
        members.join(components.select("image_id", "root"), "image_id", "left")
        .groupBy("original_cluster_id", "review_decision")
        .agg(F.countDistinct(F.coalesce("root", "image_id")).alias("predicted_component_count"), F.countDistinct("image_id").alias("cluster_size"))
        .withColumn("group_status", group_status(c("review_decision"), c("predicted_component_count"), c("cluster_size")))
    )


def failure_category(reason: Column, present: Column, contradiction: Column, truth: Column, status: Column) -> Column:
    says = lambda *words: F.lower(reason).rlike("|".join(words))
    return (
        F.when(~present, "candidate_generation").when(says("registration", "overlap", "match"), "registration")
        .when(says("transform", "reprojection"), "transform_quality").when(says("visibility", "mask"), "visibility_or_occlusion_localization")
        .when(says("outside", "exterior"), "exterior_agreement").when(contradiction & (truth == 1), "incorrect_contradiction")
        .when(status == "contaminated_component", "graph_bridge_behavior").when(says("filename"), "filename_safety_demotion")
        .when(truth == 1, "same_document_probability_or_deterministic_decision").otherwise("suspicious_negative_probability")
    )


# --- rates

def rates(rows: DataFrame, by: str = "split") -> DataFrame:
    """Recall, precision and false-link rate by split and, with a null split, over all; null where nothing is to divide."""
    yes, no = c("truth_same_document") == 1, c("truth_same_document") == 0
    n = lambda condition: F.count_if(condition)
    flag, edge = c("candidate_flag"), c("automatic_edge")
    return rows.groupingSets([[by], []], by).agg(
        F.count("*").alias("pairs"),
        ratio(n(yes & c("same_component")), n(yes)).alias("connected_recall"),
        ratio(n(yes & flag), n(yes)).alias("candidate_recall"),
        ratio(n(yes & flag), n(flag)).alias("candidate_precision"),
        ratio(n(yes & edge), n(yes)).alias("automatic_recall"),
        ratio(n(yes & edge), n(edge)).alias("automatic_precision"),
        ratio(n(no & edge), n(no)).alias("false_link_rate"),
        (n(no & edge) == 0).alias("no_false_links"),
    )


def group_rates(rows: DataFrame, by: str = "split") -> DataFrame:
    accepted, rejected = c("review_decision") == "accepted", c("review_decision") == "rejected"
    status = lambda name: c("group_status") == name
    return rows.groupingSets([[by], []], by).agg(
        F.count("*").alias("groups"),
        ratio(F.count_if(status("recovered")), F.count_if(accepted)).alias("accepted_recovery"),
        ratio(F.count_if(status("separated")), F.count_if(rejected)).alias("rejected_separation"),
        F.count_if(status("contaminated")).alias("contaminated"),
        ratio(F.sum(F.when(status("contaminated"), c("cluster_size")).otherwise(0)), F.sum(F.when(rejected, c("cluster_size")).otherwise(0))).alias("image_contamination"),
    )


def reliability(rows: DataFrame, probability: str, truth: str, bins: int = 10) -> DataFrame:
    """(bin, count, mean_probability, observed_rate, absolute_gap); the last bin includes 1; empty bins are absent."""
    edges = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    place = F.size(F.filter(edges, lambda e: c(probability) >= e))
    gap = F.abs(c("mean_probability") - c("observed_rate"))
    return (
        rows.where(c(probability).between(0.0, 1.0))
        .groupBy(place.alias("bin"))
        .agg(F.count("*").alias("count"), F.avg(probability).alias("mean_probability"), F.avg(c(truth).cast("double")).alias("observed_rate"))
        .withColumn("absolute_gap", gap)
    )


def probability_metrics(rows: DataFrame, probability: str, truth: str) -> DataFrame:
    """One row: count, log_loss, brier_score, expected_calibration_error."""
    t, p = c(truth).cast("double"), c(probability)
    table = reliability(rows, probability, truth)
    error = table.agg(F.coalesce(ratio(F.sum(c("count") * c("absolute_gap")), F.sum("count")), F.lit(0.0)).alias("expected_calibration_error"))
    return rows.agg(F.count("*").alias("count"), F.avg(log_loss(t, p)).alias("log_loss"), F.avg((p - t) * (p - t)).alias("brier_score")).crossJoin(error)


SHARES = tuple(percent / 100 for percent in (0, 1, 2, 5, 10, 20, 25, 50, 100))


def review_budget(rows: DataFrame, score: str, ties: Sequence[Column], truth: str, shares: Sequence[float] = SHARES) -> DataFrame:
    """What reviewing the best-ranked shares of the pairs catches."""
    places = ranked(rows, score, ties).select(c(truth).cast("long").alias("t"), "rank", F.lit(1).alias("_one"))
    total = rows.agg(F.count("*").alias("total"), F.coalesce(F.sum(truth), F.lit(0)).alias("positives"))
    budget = lambda share: F.least(c("total"), F.ceil(c("total") * F.lit(float(share))).cast("long"))
    inside = lambda share: F.coalesce(F.sum(F.when(c("rank") <= budget(share), c("t"))), F.lit(0))
    # one pass: a row of totals meets every ranked row, and a sum is taken for each share
    sums = places.crossJoin(F.broadcast(total)).agg(*(inside(x).alias(f"_{i}") for i, x in enumerate(shares)))
    curve = total.crossJoin(sums).select("total", "positives", F.explode(F.array(*(F.struct(F.lit(float(x)).alias("review_fraction"), budget(x).alias("review_pairs"), c(f"_{i}").alias("positive_pairs_caught")) for i, x in enumerate(shares)))).alias("s"))
    return curve.select(
        "s.*", ratio(c("s.positive_pairs_caught"), c("positives")).alias("recall"), ratio(c("s.positive_pairs_caught"), c("s.review_pairs")).alias("precision"),
    )


def best_threshold(rows: DataFrame, score: str, truth: str, max_share: float) -> DataFrame:
    """One row: the threshold of highest recall, then precision, then least review, then highest score, that keeps the review share."""
    by_score = rows.groupBy(c(score).alias("threshold")).agg(F.count("*").alias("n"), F.sum(truth).alias("t"))
    curve = running_sums(by_score, "threshold", ["n", "t"])
    scored = curve.withColumns({
        "recall": F.when(c("total_t") > 0, c("upto_t") / c("total_t")).otherwise(1.0),
        "precision": c("upto_t") / c("upto_n"),
        "review_fraction": c("upto_n") / c("total_n"),
    }).where(c("review_fraction") <= max_share + 1e-12)
    best = F.max_by(F.struct("threshold", "recall", "precision", "review_fraction"), F.struct("recall", "precision", -c("review_fraction"), "threshold"))
    return scored.agg(best.alias("b")).select("b.*")


# --- isotonic regression

def isotonic_knots(points: Iterable[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """Knots of the pool-adjacent-violators fit to (score, sum of truth, count)."""
    blocks: list[list[float]] = []
    for score, hits, n in sorted(points):
        blocks.append([score, score, float(hits), float(n)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] > blocks[-1][2] * blocks[-2][3]:
            _, high, hits, n = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + hits, blocks[-1][3] + n]
    knots: list[tuple[float, float]] = []
    for low, high, hits, n in blocks:
        for x in (low, high):
            if not knots or knots[-1] != (x, hits / n):
                knots.append((x, hits / n))
    return knots


def pooled(points: Iterable[tuple[float, float, float, float]]) -> list[list[float]]:
    """Blocks [low, high, sum of truth, count] after pooling adjacent violators among blocks in order."""
    blocks: list[list[float]] = []
    for low, high, hits, n in points:
        blocks.append([low, high, float(hits), float(n)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] > blocks[-1][2] * blocks[-2][3]:
            _, high, hits, n = blocks.pop()
            blocks[-1] = [blocks[-1][0], high, blocks[-1][2] + hits, blocks[-1][3] + n]
    return blocks


def fit_isotonic(rows: DataFrame, score: str, truth: str) -> DataFrame:
    """(knot, score, value).

    Pooling may be done piecewise: ranges of scores are pooled in their own tasks, and then their blocks, in which truths
    rise from block to block, by one task. Blocks are few where truths rise with the score at all.
    """

    def in_order(batches):
        # of tied scores the lower truths come first
        points = [x for batch in batches for x in batch[["low", "high", "hits", "n"]].itertuples(index=False)]
        return sorted(points, key=lambda x: (x.low, x.high, x.hits / x.n))

    def pool(batches):
        import pandas as pd

        yield pd.DataFrame(pooled(in_order(batches)), columns=["low", "high", "hits", "n"])

    def fit(batches):
        import pandas as pd

        knots: list[tuple[float, float]] = []
        for low, high, hits, n in pooled(in_order(batches)):
            for knot in ((low, hits / n), (high, hits / n)):
                if knots[-1:] != [knot]:
                    knots.append(knot)
        yield pd.DataFrame({"knot": range(len(knots)), "score": [k[0] for k in knots], "value": [k[1] for k in knots]})

    s, t = c(score).cast("double"), c(truth).cast("double")
    counted = rows.where(s.isNotNull() & t.isNotNull()).groupBy(s.alias("low"), t.alias("truth")).agg(F.count("*").cast("double").alias("n"))
    block = "low double, high double, hits double, n double"
    ranges = counted.select("low", c("low").alias("high"), (c("truth") * c("n")).alias("hits"), "n").repartitionByRange("low").mapInPandas(pool, block)
    return ranges.repartition(1).mapInPandas(fit, "knot int, score double, value double")


# --- splits

TARGETS = dict(zip(("development", "selection", "locked_audit"), (0.6, 0.2, 0.2)))


def stable_hash(text: str) -> int:
    """The first eight bytes of the SHA-256."""
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def assign_families(families: Mapping[str, Mapping[str, int]], version: str = "v1", targets: Mapping[str, float] = TARGETS) -> dict[str, str]:
    """family -> split: largest families first, each where totals and truths then stray least from their targets."""
    if abs(sum(targets.values()) - 1) > 1e-9:
        raise ValueError("the target shares must add up to one")
    truths: Counter[str] = Counter()
    for counts in families.values():
        truths.update(counts)
    n = sum(truths.values())
    held = {s: Counter() for s in targets}
    out = {}
    for family in sorted(families, key=lambda f: (-sum(families[f].values()), stable_hash(f"{version}:{f}"))):
        counts = families[family]

        def cost(split: str) -> tuple[float, int]:
            share, have = targets[split], held[split]
            stray = abs(have.total() + sum(counts.values()) - n * share) / max(n * share, 1)
            for truth, k in counts.items():
                stray += abs(have[truth] + k - truths[truth] * share) / max(truths[truth] * share, 1)
            return stray, stable_hash(f"{family}:{split}")

        out[family] = min(targets, key=cost)
        held[out[family]].update(counts)
    return out


def grouped_splits(groups: DataFrame, family: str, truth: str, version: str = "v1", targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """(family, split): no family lies in two splits. One task sees the counts of families by truth, not their rows."""

    def assign(batches):
        import pandas as pd

        batches = list(batches)
        found = pd.concat(batches) if batches else pd.DataFrame(columns=["family", "truth", "n"])
        families: dict[str, dict[str, int]] = {}
        for f, t, n in found[["family", "truth", "n"]].itertuples(index=False):
            families.setdefault(f, {})[t] = int(n)
        done = assign_families({f: dict(sorted(t.items())) for f, t in sorted(families.items())}, version, targets)
        yield pd.DataFrame({"family": list(done), "split": list(done.values())})

    counts = groups.groupBy(c(family).cast("string").alias("family"), F.coalesce(c(truth).cast("string"), F.lit("")).alias("truth")).agg(F.count("*").alias("n")).where("family is not null")
    return counts.coalesce(1).mapInPandas(assign, "family string, split string")


def leaking_families(rows: DataFrame, family: str, split: str = "split") -> DataFrame:
    """The families that lie in more than one split; none, if the split is sound."""
    return rows.groupBy(family).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def size_distribution(members: DataFrame, group: str) -> DataFrame:
    return members.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def compare_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta) of two tables (metric, value)."""
    return before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), "metric", "full").withColumn("delta", c("after") - c("before"))


# --- replay

def replay_edge(threshold: Column, max_gap: Column, min_alignment: Column, score: Column) -> Column:
    """An automatic edge under supplemental gates; a null gate is open, a null gap passes, a null alignment does not."""
    return (
        c("deterministic_same_document") & c("automatic_link_eligible") & ~c("hard_contradiction") & (score >= threshold)
        & (max_gap.isNull() | c("index_gap").isNull() | (c("index_gap") <= max_gap))
        & (min_alignment.isNull() | F.coalesce(c("registration_alignment_score") >= min_alignment, F.lit(False)))
    )


GATES = ("threshold", "max_gap", "min_alignment")


def _gates(score: str) -> list[str]:
    return [score, "index_gap", "registration_alignment_score"]


def replay_grid(rows: DataFrame, grid: DataFrame, score: str, truth: str) -> DataFrame:
    """The grid's rows (threshold, max_gap, min_alignment) with the confusion of automatic edges.

    Rows are first counted by all that an edge depends on; the grid, a caller's table, meets these counts.
    """
    may = c("deterministic_same_document") & c("automatic_link_eligible") & ~c("hard_contradiction")
    counted = rows.groupBy(*_gates(score), may.alias("_may"), (c(truth) == 1).alias("_yes")).agg(F.count("*").alias("_n"))
    counted = counted.withColumns({"deterministic_same_document": c("_may"), "automatic_link_eligible": F.lit(True), "hard_contradiction": F.lit(False)})
    edge = replay_edge(c("threshold"), c("max_gap"), c("min_alignment"), c(score))
    n = lambda condition: F.sum(F.when(condition, c("_n")).otherwise(0)).alias
    return counted.crossJoin(grid).groupBy(*GATES).agg(n(edge & c("_yes"))("tp"), n(edge & ~c("_yes"))("fp"), n(~edge & c("_yes"))("fn"), n(~edge & ~c("_yes"))("tn"))


REPLAYED = (
    "accepted_groups", "accepted_groups_recovered", "rejected_groups", "rejected_groups_separated", "positive_pairs", "positive_pairs_connected",
    "negative_pairs", "negative_pairs_connected", "automatic_edge_tp", "automatic_edge_fp", "candidate_tp", "candidate_fp", "compared_positive_pairs", "compared_negative_pairs",
)


def _components_of(size: int, edges: frozenset[tuple[int, int]]) -> list[int]:
    """How many members each component has."""
    part = list(range(size))
    for a, b in edges:
        x, y = part[a], part[b]
        if x != y:
            part = [x if p == y else p for p in part]
    return list(Counter(part).values())


def replay_metrics(rows: DataFrame, groups: DataFrame, configs: Sequence[tuple[float, int | None, float | None]], score: str, candidate_threshold: float = 0.5) -> DataFrame:
    """For each (threshold, max_gap, min_alignment): edges, candidates, and what becomes of groups and their pairs.

    ``rows`` are compared pairs (original_cluster_id, first_image_id, second_image_id and what ``replay_edge`` reads);
    ``groups`` are (original_cluster_id, review_decision, image_ids). All pairs of an accepted group are positive, those
    of a rejected one negative, and pairs lie inside their group, so each group is replayed by itself. A batch of groups
    yields one row a configuration; these are summed.
    """
    import pandas as pd

    may = c("deterministic_same_document") & c("automatic_link_eligible") & ~c("hard_contradiction")
    pair = F.struct("first_image_id", "second_image_id", c(score).cast("double").alias("score"), c("index_gap").cast("double").alias("gap"), c("registration_alignment_score").cast("double").alias("alignment"), may.alias("may"))
    gathered = rows.groupBy("original_cluster_id").agg(F.collect_list(pair).alias("pairs"))
    work = groups.join(gathered, "original_cluster_id", "left").select("review_decision", "image_ids", "pairs")
    configs = [tuple(x) for x in configs]

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        sums = [[0] * len(REPLAYED) for _ in configs]
        for batch in batches:
            for decision, images, pairs in batch.itertuples(index=False):
                place = {x: i for i, x in enumerate(images)}
                found = [(place[p["first_image_id"]], place[p["second_image_id"]], p["score"], p["gap"], p["alignment"], bool(p["may"])) for p in (() if pairs is None else pairs)]
                known: dict[frozenset, list[int]] = {}
                n, yes = len(images), decision == "accepted"
                candidates = sum(p[2] >= candidate_threshold for p in found)
                for total, (threshold, gap, alignment) in zip(sums, configs):
                    edges = [
                        (a, b) for a, b, s, g, q, ok in found
                        if ok and s >= threshold and (gap is None or g is None or g != g or g <= gap) and (alignment is None or (q is not None and q >= alignment))
                    ]
                    key = frozenset(edges)
                    if key not in known:
                        known[key] = _components_of(n, key)
                    parts, all_pairs = known[key], n * (n - 1) // 2
                    joined = sum(k * (k - 1) // 2 for k in parts)
                    mine = (1, int(len(parts) == 1), 0, 0, all_pairs, joined, 0, 0) if yes else (0, 0, 1, int(len(parts) == n), 0, 0, all_pairs, joined)
                    rest = (len(edges), 0, candidates, 0, len(found), 0) if yes else (0, len(edges), 0, candidates, 0, len(found))
                    for i, v in enumerate((*mine, *rest)):
                        total[i] += v
        yield pd.DataFrame([(i, *row) for i, row in enumerate(sums)], columns=["config", *REPLAYED])

    parts = work.mapInPandas(run, "config long, " + ", ".join(f"{k} long" for k in REPLAYED))
    summed = parts.groupBy("config").agg(*(F.sum(k).alias(k) for k in REPLAYED))
    named = rows.sparkSession.createDataFrame([(i, float(t), g, None if q is None else float(q)) for i, (t, g, q) in enumerate(configs)], "config long, threshold double, max_gap int, min_alignment double")
    return summed.join(named, "config").select(*GATES, *REPLAYED).withColumns({
        "perfect_group_fit": (c("accepted_groups_recovered") == c("accepted_groups")) & (c("rejected_groups_separated") == c("rejected_groups")),
        "zero_false_links": (c("automatic_edge_fp") == 0) & (c("negative_pairs_connected") == 0),
    })


def best_replay(metrics: DataFrame) -> DataFrame:
    """One row: the best of ``replay_metrics``.

    Configurations without a false link come first, by recovered groups, connected positive pairs and true edges; where
    there is none, the fewest false edges and connected negative pairs count. Last, open gates and the higher threshold win.
    """
    safe = c("zero_false_links")
    rank = F.struct(
        safe.cast("int"), F.when(safe, c("accepted_groups_recovered")).otherwise(-c("automatic_edge_fp")),
        F.when(safe, c("positive_pairs_connected")).otherwise(-c("negative_pairs_connected")), F.when(safe, c("automatic_edge_tp")).otherwise(0),
        -c("automatic_edge_fp"), -c("negative_pairs_connected"), c("max_gap").isNull().cast("int"), c("min_alignment").isNull().cast("int"),
        F.floor(c("threshold") * 1_000_000_000),
    )
    return metrics.agg(F.max_by(F.struct(*metrics.columns), rank).alias("b")).select("b.*")


def replay_configs(rows: DataFrame, score: str, most: int = 24) -> list[tuple[float, int | None, float | None]]:
    """Thresholds and gates to try: at most ``most`` observed scores, and half as many gaps and alignments besides open gates."""
    def spread(column: str, limit: int) -> list:
        # the values at evenly spread places of the sorted distinct ones; only these reach the driver
        distinct = counted_before(rows.where(c(column).isNotNull()).select(c(column).cast("double").alias("v")).distinct(), ["v"], "n")
        total = distinct.count()
        places = range(1, total + 1) if total <= limit else sorted({1 + round(k * (total - 1) / (limit - 1)) for k in range(limit)})
        return sorted(r["v"] for r in distinct.where(c("n").isin(list(places))).collect()) if total else []

    gaps = [None, *(int(v) for v in spread("index_gap", most // 2))]
    return [(t, g, q) for t in spread(score, most) for g in gaps for q in [None, *spread("registration_alignment_score", most // 2)]]


def replayed_predictions(rows: DataFrame, threshold: float, max_gap: int | None, min_alignment: float | None, score: str, candidate_threshold: float) -> DataFrame:
    """The rows as predictions under a configuration: eligible by the gates, flagged by the score, the three states recomputed."""
    p, q = c("same_document_probability"), c("occluded_given_same_probability")
    gate = (
        (c(score) >= threshold)
        & (F.lit(max_gap is None) | c("index_gap").isNull() | (c("index_gap") <= F.lit(max_gap)))
        & (F.lit(min_alignment is None) | F.coalesce(c("registration_alignment_score") >= F.lit(min_alignment), F.lit(False)))
    )
    return rows.withColumns({
        "same_document": c("deterministic_same_document"), "automatic_link_eligible": c("automatic_link_eligible") & F.coalesce(gate, F.lit(False)),
        "occlusion_candidate_flag": c(score) >= candidate_threshold, "same_clean_probability": p * (1 - q), "same_occluded_probability": p * q,
        "different_document_probability": 1 - p, "replay_score_field": F.lit(score), "replay_automatic_threshold": F.lit(float(threshold)),
        "replay_candidate_threshold": F.lit(float(candidate_threshold)),
    })


def spread_values(values: Sequence[float], limit: int = 24) -> list[float]:
    """At most ``limit`` distinct values, evenly spread over the sorted ones, both ends included."""
    found = sorted(set(values))
    if len(found) <= limit:
        return found
    return [found[i] for i in sorted({round(k * (len(found) - 1) / (limit - 1)) for k in range(limit)})]
