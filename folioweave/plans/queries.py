"""Queries over the driver's tables, one or more for every family of operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LinkConfig
from ..functions import geometry, numeric, text
from ..materialize import materialize
from ..operators import decide, evaluate, graph, linkage, pages, pairs, probability, ranking, review
from ..sources import readers, writers
from . import captures, checks
from .captures import images, scored_labels, table

c = F.col
CFG = LinkConfig()


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- sequences and pairs


def seq_index(spark: SparkSession, d: str) -> DataFrame:
    return pairs.sequence_index(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "sequence_index")


def band_pairs_positional(spark: SparkSession, d: str) -> DataFrame:
    near = pairs.neighbour_pairs(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_id"], 3)
    return near.select("user_id", c("a.event_id").alias("a"), c("b.event_id").alias("b"), "gap")


def band_pairs_sparse(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source is not null")
    return pairs.index_pairs(docs, "source", "doc_id", "doc_id", 40).select("source", "a", "b", "gap")


def pair_metrics(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    ids = pairs.neighbour_pairs(docs, "source", ["doc_id"], ["doc_id"], 1).select(c("a.doc_id").alias("a"), c("b.doc_id").alias("b"))
    # the words follow the pairs, so that no sort carries them
    side = lambda x: docs.select(c("doc_id").alias(x), F.array_distinct(F.split(F.lower("text"), " ")).alias(f"{x}w"), F.length("text").alias(f"{x}n"))
    near = ids.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("aw", "bw"))
    either = F.size("aw") + F.size("bw") - both
    return near.select(
        "a", "b", F.round(numeric.ratio(both, either), 6).alias("jaccard"),
        F.round(numeric.ratio(F.least("an", "bn"), F.greatest("an", "bn")), 6).alias("length_ratio"),
    )


def image_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Sequences with their size and first and last capture."""
    return images(spark, d).groupBy("sequence_id").agg(F.count("*").alias("images"), F.min("image_id").alias("first_id"), F.max("image_id").alias("last_id"))


# --- decisions and probabilities


def decision_ladder(spark: SparkSession, d: str) -> DataFrame:
    out = decide.decide(captures.pairs(spark, d), CFG, ("first_path", "second_path"))
    return out.select("first_image_id", "second_image_id", "same_document", "branch", "reason", "hard_contradiction", "automatic_link_eligible", F.round("confidence", 6).alias("confidence"))


def near_duplicate_flag(spark: SparkSession, d: str) -> DataFrame:
    return captures.pairs(spark, d).where(decide.near_duplicate(CFG)).select("first_image_id", "second_image_id")


def safety_reason(spark: SparkSession, d: str) -> DataFrame:
    branch = F.when(c("first_image_id") % 2 == 0, F.lit(decide.OCCLUDED)).otherwise(F.lit(decide.NEAR))
    rows = captures.pairs(spark, d)
    return rows.select("first_image_id", "second_image_id", decide.safety_reason(c("first_path"), c("second_path"), branch, CFG).alias("safety_reason"))


def logistic_probability(spark: SparkSession, d: str) -> DataFrame:
    out = probability.pair_probabilities(captures.pairs(spark, d), CFG)
    names = ("same_document_probability", "raw_occluded_given_same_probability", "same_occluded_probability", "same_clean_probability")
    return _round(out.select("first_image_id", "second_image_id", *names, "occlusion_candidate_flag"), *names)


def evidence_ramps(spark: SparkSession, d: str) -> DataFrame:
    rows = decide.with_rules(captures.pairs(spark, d), CFG)
    return rows.select("first_image_id", "second_image_id", F.round(probability.occlusion_evidence(CFG), 6).alias("evidence"), F.round(probability.identity_support(CFG), 6).alias("identity_support"))


def _decided(spark: SparkSession, d: str) -> DataFrame:
    return probability.pair_probabilities(decide.decide(captures.pairs(spark, d), CFG, ("first_path", "second_path")), CFG)


def _items(spark: SparkSession, d: str) -> DataFrame:
    return pairs.sequence_index(images(spark, d), "sequence_id", ["image_id"]).select("sequence_id", "image_id", "sequence_index")


# --- graph and ranking


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """Decided pairs of which two fifths more are linked, so that groups arise."""
    close = (c("first_image_id") * 31 + c("second_image_id")) % 5 < 2
    out = _decided(spark, d)
    return materialize(out.withColumns({"same_document": c("same_document") | close, "automatic_link_eligible": c("automatic_link_eligible") | close}))


def constrained_clusters(spark: SparkSession, d: str) -> DataFrame:
    linked = _linked(spark, d)
    members = graph.constrained_groups(_items(spark, d), linked)
    return graph.cluster_records(members, linked)


def representative(spark: SparkSession, d: str) -> DataFrame:
    """Groups of four neighbours as given; the best connected member of each."""
    members = _items(spark, d).withColumn("root", F.floor(c("sequence_index") / 4).cast("long"))
    return graph.representatives(members, _linked(spark, d)).select("sequence_id", "root", "representative")


def unconstrained_components(spark: SparkSession, d: str) -> DataFrame:
    """Exact copies within a language, chained, then closed."""
    docs = table(spark, d, "documents").where("text is not null").select(F.coalesce("lang", F.lit("")).alias("sequence_id"), c("doc_id").alias("image_id"), F.md5("text").alias("h"))
    chain = Window.partitionBy("sequence_id", "h").orderBy("image_id")
    edges = docs.select("sequence_id", F.lag("image_id").over(chain).alias("a"), c("image_id").alias("b")).where("a is not null")
    items = pairs.sequence_index(docs, "sequence_id", ["image_id"])
    return graph.link_components(items, edges).select("sequence_id", "image_id", "root")


def symmetric_neighbours(spark: SparkSession, d: str) -> DataFrame:
    edges = _linked(spark, d).where("same_document").select(c("first_image_id").alias("a"), c("second_image_id").alias("b"))
    return pairs.symmetric_neighbours(edges).select("node", F.array_join(c("neighbours").cast("array<string>"), ",").alias("neighbours"))


def review_tiers(spark: SparkSession, d: str) -> DataFrame:
    members = _items(spark, d).withColumn("root", F.concat_ws(":", "sequence_id", F.floor(c("sequence_index") / 4).cast("string")))
    out = ranking.rank_candidates(_linked(spark, d), members, CFG, include_accepted=True, include_unflagged=True)
    return out.select("first_image_id", "second_image_id", "review_tier", F.size("common_accepted_neighbors").cast("long").alias("common"), "same_component", "acceptance_conflict", c("review_rank").cast("long").alias("review_rank"))


def candidate_summary(spark: SparkSession, d: str) -> DataFrame:
    members = _items(spark, d).withColumn("root", F.concat_ws(":", "sequence_id", F.floor(c("sequence_index") / 4).cast("string")))
    return ranking.summarize(ranking.rank_candidates(_linked(spark, d), members, CFG, include_accepted=True, include_unflagged=True))


def cluster_confidence_stats(spark: SparkSession, d: str) -> DataFrame:
    out = _decided(spark, d)
    return out.groupBy("sequence_id").agg(
        F.count("*").alias("pairs"), F.round(F.min("confidence"), 6).alias("min_confidence"), F.round(F.avg("confidence"), 6).alias("mean_confidence"),
        F.round(F.max("confidence"), 6).alias("max_confidence"), F.max("index_gap").alias("largest_gap"), F.count_if("same_document").alias("accepted"),
    )


def run_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _decided(spark, d)
    clusters = images(spark, d).groupBy("sequence_id").agg(F.collect_list("image_id").alias("image_ids"))
    return writers.run_counts(images(spark, d), clusters, rows)


# --- evaluation


def _labelled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Labels as reviewed pairs: truth, flags, edges and statuses."""
    rows = scored_labels(spark, d)
    edge = (c("p") >= 0.7) & ~c("contradiction")
    return rows.withColumns({
        "truth_same_document": c("truth"), "automatic_edge": edge, "candidate_flag": c("p") >= 0.3, "same_component": edge | (c("p") >= 0.6),
    })


def reliability_ece(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluate.reliability(scored_labels(spark, d), "p", "truth"), "mean_probability", "observed_rate", "absolute_gap")


def logloss_brier(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluate.probability_metrics(scored_labels(spark, d), "p", "truth"), "log_loss", "brier_score", "expected_calibration_error")


def metrics_by_split(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluate.rates(_labelled_pairs(spark, d)), "connected_recall", "candidate_recall", "candidate_precision", "automatic_recall", "automatic_precision", "false_link_rate")


def group_metrics(spark: SparkSession, d: str) -> DataFrame:
    groups = _groups(spark, d)
    return _round(evaluate.group_rates(groups), "accepted_recovery", "rejected_separation", "image_contamination")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    """Labels in groups of neighbouring ids, with the components of their scores."""
    rows = scored_labels(spark, d)
    members = rows.select(F.floor(c("doc_id") / 6).alias("original_cluster_id"), c("doc_id").alias("image_id"), "p")
    decision = F.when(c("original_cluster_id") % 3 == 0, "rejected").otherwise("accepted")
    component = F.when(c("p") >= 0.35, c("original_cluster_id") * 1000).otherwise(c("image_id") * 1000 + 1)
    members = members.withColumns({"review_decision": decision, "root": component})
    out = evaluate.group_rows(members.drop("root", "p"), members.select("image_id", "root"))
    return out.withColumn("split", F.element_at(F.array(*map(F.lit, ("development", "selection", "locked_audit"))), (c("original_cluster_id") % 3 + 1).cast("int")))


def group_statuses(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).select("original_cluster_id", "review_decision", "predicted_component_count", "cluster_size", "group_status")


def size_distribution(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.size_distribution(table(spark, d, "lineitem"), "l_orderkey")


def review_budget_curve(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluate.review_budget(scored_labels(spark, d), "p", [c("doc_id")], "truth"), "recall", "precision")


def isotonic_fit(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.fit_isotonic(scored_labels(spark, d), "p", "truth")


KNOTS = [(0.1, 0.05), (0.3, 0.3), (0.3, 0.4), (0.6, 0.5), (0.9, 0.95)]


def isotonic_apply(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_labels(spark, d).withColumns({"same_document_probability": c("p"), "occluded_given_same_probability": c("index_gap") / F.lit(4.0)})
    out = evaluate.calibrate(rows, KNOTS)
    return _round(out.select("doc_id", "same_document_probability", "same_clean_probability", "same_occluded_probability"), "same_document_probability", "same_clean_probability", "same_occluded_probability", digits=9)


def threshold_search(spark: SparkSession, d: str) -> DataFrame:
    return _round(evaluate.best_threshold(scored_labels(spark, d), "p", "truth", 0.5), "recall", "precision", "review_fraction")


def grouped_split(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.grouped_splits(table(spark, d, "documents"), "source", "lang")


def leakage_check(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("split", c("doc_id") % 3)
    return evaluate.leaking_families(docs, "source")


def truth_left_prediction(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of neighbouring labels as truth; only some were compared."""
    rows = scored_labels(spark, d).select("doc_id", "truth", "p", "contradiction")
    nxt = pairs.neighbour_pairs(rows.withColumn("one", c("doc_id") % 16), "one", ["doc_id"], ["doc_id", "truth", "p", "contradiction"], 1)
    truth = nxt.select(c("a.doc_id").alias("image_a"), c("b.doc_id").alias("image_b"), F.when(c("a.truth") == c("b.truth"), "accepted").otherwise("rejected").alias("truth"))
    predicted = nxt.where(c("a.doc_id") % 3 > 0).select(
        c("a.doc_id").alias("image_a"), c("b.doc_id").alias("image_b"), (c("a.p") >= 0.5).alias("same_document"), c("a.contradiction").alias("hard_contradiction"),
        (c("b.p") >= 0.4).alias("candidate_flag"), c("a.p").alias("same_document_probability"), F.lit("compared").alias("reason"),
    )
    predictions = evaluate.normalize_predictions(predicted)
    roots = rows.select(c("doc_id").alias("image_id"), F.floor(c("doc_id") / 64).alias("root"))
    return evaluate.pair_rows(truth, predictions, roots).select("image_a", "image_b", "truth", "pair_status", "automatic_edge", "candidate_flag", "same_component", "prediction_present", "reason")


def replay_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_labels(spark, d).withColumns({"deterministic_same_document": c("p") >= 0.2, "automatic_link_eligible": F.lit(True), "hard_contradiction": c("contradiction")})
    grid = spark.createDataFrame([(t, g, a) for t in (0.3, 0.5, 0.7) for g in (None, 2) for a in (None, 0.25)], "threshold double, max_gap int, min_alignment double")
    return evaluate.replay_grid(rows, grid, "p", "truth")


CONFIGS = [(t, g, q) for t in (0.3, 0.5, 0.7, 0.9) for g in (None, 1, 2) for q in (None, 0.25)]


def _replay(spark: SparkSession, d: str) -> DataFrame:
    """Groups of up to three labels of neighbouring ids, whose neighbours were compared."""
    rows = scored_labels(spark, d).withColumn("original_cluster_id", F.floor(c("doc_id") / 3).cast("long"))
    groups = rows.groupBy("original_cluster_id").agg(F.sort_array(F.collect_list("doc_id")).alias("image_ids")).withColumn("review_decision", F.when(c("original_cluster_id") % 3 == 0, "rejected").otherwise("accepted"))
    near = pairs.neighbour_pairs(rows, "original_cluster_id", ["doc_id"], ["doc_id", "p", "contradiction", "index_gap", "registration_alignment_score"], 2)
    compared = near.select(
        "original_cluster_id", c("a.doc_id").alias("first_image_id"), c("b.doc_id").alias("second_image_id"), F.least("a.p", "b.p").alias("p"),
        (c("a.p") >= 0.2).alias("deterministic_same_document"), F.lit(True).alias("automatic_link_eligible"), (c("a.contradiction") | c("b.contradiction")).alias("hard_contradiction"),
        c("a.index_gap").alias("index_gap"), c("b.registration_alignment_score").alias("registration_alignment_score"),
    )
    return evaluate.replay_metrics(compared, groups, CONFIGS, "p")


def replay_groups(spark: SparkSession, d: str) -> DataFrame:
    return _replay(spark, d)


def replay_best(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.best_replay(_replay(spark, d))


def metric_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Mean price by status, over early and late orders."""
    orders = table(spark, d, "orders")
    mean = lambda df: df.groupBy(c("o_orderstatus").alias("metric")).agg(F.avg("o_totalprice").alias("value"))
    out = evaluate.compare_metrics(mean(orders.where(c("o_orderkey") % 2 == 0)), mean(orders.where(c("o_orderkey") % 2 == 1)))
    return _round(out, "before", "after", "delta", digits=3)


def manifest_contract(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_labels(spark, d).select(
        c("doc_id").cast("int").alias("index"), F.floor(c("doc_id") / 3).alias("original_cluster_id"),
        F.when(F.floor(c("doc_id") / 3) % 3 == 0, "rejected").otherwise("accepted").alias("review_decision"),
    )
    return readers.manifest_problems(rows, {"rows": 1, "groups": 2, "accepted": 3, "rejected": 4})


def failure_categories(spark: SparkSession, d: str) -> DataFrame:
    rows = _decided(spark, d)
    return rows.select(
        "first_image_id", "second_image_id",
        evaluate.failure_category(c("reason"), c("registration_model").isNotNull(), c("hard_contradiction"), c("first_image_id") % 2, F.lit("contaminated_component")).alias("failure_category"),
    )


# --- linkage


def consensus_field(spark: SparkSession, d: str) -> DataFrame:
    """Each part brand's commonest type word, the first seen of equals."""
    parts = table(spark, d, "part")
    return linkage.most_common(parts, "p_brand", text.normalized_ascii(F.element_at(F.split("p_type", " "), -1)), "p_partkey").select("p_brand", "value", "n")


def field_containment(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring parts as records: weight of equal fields against each one's weight."""
    parts = table(spark, d, "part").withColumn("series", c("p_partkey") % 8)
    weights = {"p_brand": 2.25, "p_type": 1.5, "p_size": 0.55}
    near = pairs.neighbour_pairs(parts, "series", ["p_partkey"], ["p_partkey", *weights], 2)
    matched = sum((F.when(c(f"a.{k}") == c(f"b.{k}"), F.lit(w)).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    mass = lambda end: sum((F.when(c(f"{end}.{k}").isNotNull(), F.lit(w)).otherwise(0.0) for k, w in weights.items()), F.lit(0.0))
    return near.select(c("a.p_partkey").alias("a"), c("b.p_partkey").alias("b"), F.round(numeric.ratio(matched, mass("a")), 6).alias("containment"))


def _extractions(spark: SparkSession, d: str) -> DataFrame:
    """Customers as extractions: a series of a nation's customers, each with one or two records."""
    person = lambda key: F.filter(
        F.array(
            F.struct(F.lit("surname").alias("key"), F.concat(F.lit("name "), (c(key) % 5).cast("string")).alias("value")),
            F.struct(F.lit("given_name").alias("key"), F.when(c(key) % 4 > 0, c("c_mktsegment")).alias("value")),
            F.struct(F.lit("birth_year").alias("key"), (F.lit(1880) + c(key) % 3).cast("string").alias("value")),
        ),
        lambda e: e["value"].isNotNull(),
    )
    record = lambda role, key: F.struct(F.lit(role).alias("role"), F.lit("Petition").alias("event_type"), F.map_from_entries(person(key)).alias("fields"))
    rows = table(spark, d, "customer").withColumn("spouse_key", c("c_custkey") + 2)
    records = F.when(c("c_custkey") % 3 == 0, F.array(record("self", "c_custkey"), record("spouse", "spouse_key"))).otherwise(F.array(record("self", "c_custkey")))
    quality = F.create_map(F.lit("occlusion_risk"), F.abs(c("c_acctbal")) % 100 / 100.0)
    indexed = pairs.sequence_index(rows, "c_nationkey", ["c_custkey"])
    return indexed.select(
        F.format_string("i%04d-%06d", "c_nationkey", "sequence_index").alias("image_id"), F.format_string("i%04d", "c_nationkey").alias("sequence_key"),
        c("sequence_index").cast("long").alias("sequence_index"), records.alias("records"), quality.alias("quality"),
    )


def linkage_decision(spark: SparkSession, d: str) -> DataFrame:
    out = linkage.link_pairs(_extractions(spark, d))
    return _round(out.select("image_a", "image_b", "gap", "same_document_score", "link_tier", "possible_occlusion_event", "likely_occluded_image_id", F.array_join("reasons", ",").alias("reasons")), "same_document_score")


def linkage_groups(spark: SparkSession, d: str) -> DataFrame:
    found = _extractions(spark, d)
    out = linkage.link_groups(found, materialize(linkage.link_pairs(found)))
    return _round(out, "group_confidence")


def linkage_flags(spark: SparkSession, d: str) -> DataFrame:
    found = _extractions(spark, d)
    return _round(linkage.image_flags(found, linkage.link_pairs(found)), "role_confidence", "field_mass")


def field_mass(spark: SparkSession, d: str) -> DataFrame:
    out = _extractions(spark, d)
    return out.select("image_id", F.round(linkage.field_mass(c("records")), 6).alias("mass"), F.round(linkage.completeness(c("records"), c("quality")), 6).alias("completeness"))


def record_alignment(spark: SparkSession, d: str) -> DataFrame:
    out = linkage.link_pairs(_extractions(spark, d))
    return _round(out.select("image_a", "image_b", "aligned_records", "identity_similarity", "anchor_score", "conflict_rate"), "identity_similarity", "conflict_rate")


def merged_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over each capture, merged."""
    found = _extractions(spark, d)
    second = found.withColumn("records", F.transform("records", lambda r: r.withField("event_type", F.lit("Oath"))))
    runs = found.withColumn("source", F.lit("run-1")).unionByName(second.withColumn("source", F.lit("run-2")))
    out = linkage.merge_runs(runs)
    return out.select("image_id", "run_count", F.array_join("run_sources", ",").alias("sources"), F.size("records").alias("records"), F.round(F.element_at("quality", "occlusion_risk"), 6).alias("risk"))


def embedding_cosine_band(spark: SparkSession, d: str) -> DataFrame:
    near = pairs.neighbour_pairs(table(spark, d, "embeddings"), "label", ["vec_id"], ["vec_id", "embedding"], 2)
    return near.select(c("a.vec_id").alias("a"), c("b.vec_id").alias("b"), F.round(numeric.cosine(c("a.embedding"), c("b.embedding")), 5).alias("cosine"))


def string_similarity(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").withColumn("series", c("p_partkey") % 16)
    near = pairs.neighbour_pairs(parts, "series", ["p_partkey"], ["p_partkey", "p_name"], 1)
    return near.select(c("a.p_partkey").alias("a"), c("b.p_partkey").alias("b"), F.round(text.similarity("a.p_name", "b.p_name"), 6).alias("ratio"))


# --- positions, statistics, boxes


def gaps_and_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs.sequence_index(table(spark, d, "events"), "user_id", ["ts", "event_id"]).withColumn("on", c("value") > 50)
    return pairs.islands(rows, "user_id", "sequence_index", "on", 1).select("user_id", "first", "last", "n")


def weighted_quantile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", c("l_quantity").cast("long").alias("q"), (F.round(c("l_extendedprice") * 100)).cast("long").alias("w"))
    return pages.weighted_quantile(rows, "l_returnflag", "q", "w", 0.9)


def robust_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Highest price by part and supplier bucket, against the bucket's median and deviation."""
    tiles = table(spark, d, "lineitem").groupBy((c("l_suppkey") % 24).alias("column"), (c("l_partkey") % 180).alias("row")).agg(F.max("l_extendedprice").alias("score"))
    return _round(pages.robust_tiles(tiles, "column", "score").select("column", "row", "score", "z"), "z", digits=4)


def top_residual_tiles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return pages.canonical_pages(rows, "l_orderkey", "l_returnflag", "l_extendedprice", "l_linenumber").select("l_orderkey", "l_returnflag", "l_linenumber", "l_extendedprice")


def _boxes(rows: DataFrame, k: str) -> DataFrame:
    x, y = c(k) % 97, c(k) % 89
    return rows.withColumn("box", geometry.box(x, y, x + c("l_quantity").cast("long"), y + c("l_linenumber") * 7))


def bbox_iou(spark: SparkSession, d: str) -> DataFrame:
    rows = _boxes(table(spark, d, "lineitem"), "l_partkey")
    near = pairs.neighbour_pairs(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], ["l_linenumber", "l_partkey", "l_suppkey", "box"], 1)
    return near.select(
        "l_orderkey", c("a.l_partkey").alias("a"), c("b.l_partkey").alias("b"), F.round(geometry.iou(c("a.box"), c("b.box")), 6).alias("iou"),
        geometry.area(geometry.hull(c("a.box"), c("b.box"))).alias("hull_area"),
    )


def greedy_iou_match(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    flat = lambda key: _boxes(rows, key).select("l_orderkey", c("l_linenumber").alias("n"), "box.x0", "box.y0", "box.x1", "box.y1")
    return _round(pages.match_boxes(flat("l_partkey"), flat("l_suppkey"), ["l_orderkey"]), "iou")


def merged_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = _boxes(table(spark, d, "lineitem"), "l_suppkey").select(
        c("l_orderkey").alias("group_id"), (c("l_linenumber") % 2).cast("string").alias("side"), "box.x0", "box.y0", "box.x1", "box.y1", c("l_extendedprice").alias("confidence")
    )
    return pages.merge_candidates(rows)


def page_completeness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(pages.completeness(c("l_discount") * 10 - 0.2).alias("completeness")).agg(F.count("*").alias("n"))


# --- reviews, labels, inventories


def _review(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders' lines as clusters, the events of users of the same number as decisions on them."""
    members = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("cluster_id")).agg(F.array_distinct(F.sort_array(F.collect_list("l_linenumber"))).alias("m")).select(
        "cluster_id", F.explode("m").alias("image_id")
    ).withColumn("sequence_index", c("image_id"))
    kind = c("event_id") % 11
    action = F.when(kind < 6, "membership").when(kind < 8, "approve").when(kind < 9, "dissolve").when(kind < 10, "irregular").otherwise("reopen")
    events = table(spark, d, "events").select((c("user_id") % 500).alias("cluster_id"), c("event_id").alias("seq"), action.alias("action"), (c("event_id") % 5 + 1).cast("int").alias("image_id"), (c("event_id") % 3 == 0).alias("included"))
    one = events.withColumn("image_id", F.when(c("action") == "membership", c("image_id")))
    return members, one


def corrected_exports(spark: SparkSession, d: str) -> DataFrame:
    members, events = _review(spark, d)
    out = review.corrected_clusters(members, events)
    return out.select("cluster_id", "origin_cluster_id", F.array_join(c("image_ids").cast("array<string>"), ",").alias("image_ids"), "status")


def review_states(spark: SparkSession, d: str) -> DataFrame:
    return review.cluster_states(*_review(spark, d))


def review_progress(spark: SparkSession, d: str) -> DataFrame:
    return review.progress(*_review(spark, d))


def label_upsert_delete(spark: SparkSession, d: str) -> DataFrame:
    """Conversations' first turns as labels, later turns as overrides; every fifth deletes."""
    turns = table(spark, d, "conversations").where("conv_id is not null and turn is not null")
    value = F.struct(c("role").alias("role"), F.length("text").alias("n"))
    per_turn = turns.groupBy(c("conv_id").alias("case_id"), "turn").agg(F.min(value).alias("v")).select("case_id", "turn", "v.*")
    overrides = per_turn.where("turn > 0").select("case_id", "role", "n", c("turn").alias("line"), (c("turn") % 5 == 4).alias("delete"))
    return review.apply_overrides(per_turn.where("turn = 0").select("case_id", "role", "n"), overrides)


def source_set_difference(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    missing = docs.join(labels, "doc_id", "left_anti").distinct().withColumn("side", F.lit("unlabelled"))
    return missing.unionByName(labels.join(docs, "doc_id", "left_anti").distinct().withColumn("side", F.lit("unknown")))


def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


def inventory_counts(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return table(spark, d, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("chars"))


def signature_hash(spark: SparkSession, d: str) -> DataFrame:
    fields = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", F.sha2(fields, 256).alias("signature"), F.substring(F.sha1(fields), 1, 10).alias("short"))


def library_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Files wanted by name, resolved over documents as files whose copies carry numbers."""
    docs = table(spark, d, "documents")
    files = docs.select(F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/d"), (c("doc_id") % 400).cast("string"), F.lit("(1).jpg")).alias("path"), F.sha2(F.coalesce("lang", F.lit("")), 256).alias("sha256"))
    wanted = docs.select(F.concat(F.lit("x/d"), (c("doc_id") % 450).cast("string"), F.lit(".jpg")).alias("source_path"))
    return readers.resolve_library(wanted, files).select("name", "path", "status")


def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("page_id", F.concat("url", F.lit("-"), c("page_id").cast("string"), F.lit("(2).jpg")).alias("path"))
    series, index = text.series_and_index(text.canonical_id(c("path")))
    return rows.select("page_id", text.canonical_id(c("path")).alias("image_id"), series.alias("series"), index.alias("position"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        seq_index, band_pairs_positional, band_pairs_sparse, pair_metrics, image_inventory, decision_ladder, near_duplicate_flag, safety_reason,
        logistic_probability, evidence_ramps, constrained_clusters, representative, unconstrained_components, symmetric_neighbours, review_tiers,
        candidate_summary, cluster_confidence_stats, run_counts, reliability_ece, logloss_brier, metrics_by_split, group_metrics, group_statuses,
        size_distribution, review_budget_curve, isotonic_fit, isotonic_apply, threshold_search, grouped_split, leakage_check, truth_left_prediction,
        replay_grid, replay_groups, replay_best, metric_comparison, manifest_contract, failure_categories, consensus_field, field_containment, linkage_decision,
        linkage_groups, linkage_flags, field_mass, record_alignment, merged_runs, embedding_cosine_band, string_similarity, gaps_and_islands,
        weighted_quantile, robust_tiles, top_residual_tiles, bbox_iou, greedy_iou_match, merged_candidates, page_completeness, corrected_exports,
        review_states, review_progress, label_upsert_delete, source_set_difference, json_flatten, inventory_counts, signature_hash,
        library_resolution, canonical_names,
    )
} | checks.QUERIES
