"""Review decisions as an event log.

An event is (cluster_id, seq, action, image_id, included): membership changes one
image, approve, dissolve and reopen set all members, irregular sets the whole
cluster aside and leaves its members. An event ``restore`` puts a cluster back to
a recorded state: its columns restored_status and restored_excluded (image ids),
of which unknown ids are dropped. A cluster's state is the fold of its events in
order, which runs as one expression over the cluster's own events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import counted_before

c = F.col

STATUSES = ("unreviewed", "approved", "edited", "dissolved", "irregular")


def _after_change(status: Column, members: Column, excluded: Column) -> Column:
    """The status once an image was put in or out: too few left dissolve, any that is out edits; where none is out, irregular and approved stay."""
    return (
        F.when((members >= 2) & (members - F.size(excluded) < 2), "dissolved")
        .when((F.size(excluded) > 0) | ~status.isin("approved", "irregular"), "edited")
        .otherwise(status)
    )


def folded(members: DataFrame, events: DataFrame) -> DataFrame:
    """(cluster_id, images, status, excluded): the state of every cluster; images in order of sequence_index."""
    image = dict(members.dtypes)["image_id"]
    absent = {"restored_status": F.lit(None).cast("string"), "restored_excluded": F.lit(None).cast(f"array<{image}>")}
    events = events.withColumns({k: v for k, v in absent.items() if k not in events.columns})
    log = events.groupBy("cluster_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "action", c("image_id").cast(image).alias("image_id"), "included", *absent))).alias("log")
    )
    whole = members.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("sequence_index", "image_id"))).alias("m")).select("cluster_id", c("m.image_id").alias("images"))
    state = f"struct<status: string, excluded: array<{image}>>"
    nobody = F.array().cast(f"array<{image}>")

    def step(was: Column, e: Column) -> Column:
        change = e["action"] == "membership"
        known = F.array_contains("images", e["image_id"])
        out = (
            F.when(change & ~F.coalesce(known, F.lit(False)), was["excluded"])
            .when(change & e["included"], F.array_remove(was["excluded"], e["image_id"]))
            .when(change, F.array_union(was["excluded"], F.array(e["image_id"])))
            .when(e["action"] == "dissolve", c("images")).when(e["action"].isin("approve", "reopen"), nobody)
            .when(e["action"] == "restore", F.array_intersect("images", F.coalesce(e["restored_excluded"], nobody)))
            .otherwise(was["excluded"])
        )
        status = (
            F.when(change & F.coalesce(known, F.lit(False)), _after_change(was["status"], F.size("images"), out))
            .when(e["action"] == "dissolve", "dissolved").when(e["action"] == "approve", "approved").when(e["action"] == "reopen", "unreviewed")
            .when(e["action"] == "irregular", "irregular")
            .when(e["action"] == "restore", F.when(e["restored_status"].isin(*STATUSES), e["restored_status"]).otherwise(F.raise_error(F.lit("unknown cluster status"))))
            .otherwise(was["status"])
        )
        return F.struct(status.alias("status"), out.alias("excluded")).cast(state)

    start = F.struct(F.lit("unreviewed").alias("status"), nobody.alias("excluded")).cast(state)
    end = F.when(c("log").isNull(), start).otherwise(F.aggregate("log", start, step))
    return whole.join(log, "cluster_id", "left").select("cluster_id", "images", end.alias("s")).select("cluster_id", "images", "s.status", "s.excluded")


def membership(members: DataFrame, events: DataFrame) -> DataFrame:
    """(cluster_id, image_id, sequence_index, included)."""
    out = folded(members, events).select("cluster_id", F.explode("excluded").alias("image_id"), F.lit(True).alias("_out"))
    return members.join(out, ["cluster_id", "image_id"], "left").select("cluster_id", "image_id", "sequence_index", c("_out").isNull().alias("included"))


def cluster_states(members: DataFrame, events: DataFrame) -> DataFrame:
    """(cluster_id, image_count, kept_image_count, status, dissolved, reviewed)."""
    gone = c("status").isin("dissolved", "irregular")
    return folded(members, events).select(
        "cluster_id", F.size("images").cast("long").alias("image_count"),
        F.when(gone, 0).otherwise(F.size("images") - F.size("excluded")).cast("long").alias("kept_image_count"),
        "status", (c("status") == "dissolved").alias("dissolved"), (c("status") != "unreviewed").alias("reviewed"),
    )


def corrected_clusters(members: DataFrame, events: DataFrame) -> DataFrame:
    """(cluster_id, origin_cluster_id, image_ids, status): what stays together, and a record for each image that was taken out.

    Irregular clusters are left out; see ``exclusions``.
    """
    state = folded(members, events).where("status != 'irregular'")
    stays = F.when(c("status") == "dissolved", F.array().cast(state.schema["images"].dataType)).otherwise(F.array_except("images", "excluded"))
    parted = state.withColumn("_in", stays)
    together = parted.where(F.size("_in") > 0).select(c("cluster_id").cast("string").alias("cluster_id"), c("cluster_id").alias("origin_cluster_id"), c("_in").alias("image_ids"), "status")
    alone = counted_before(parted.select("cluster_id", "status", F.posexplode(F.array_except("images", "_in")).alias("_at", "image_id")), ["cluster_id", "_at"], "n")
    return together.unionByName(
        alone.select(F.format_string("%s__separated_%05d", c("cluster_id").cast("string"), "n").alias("cluster_id"), c("cluster_id").alias("origin_cluster_id"), F.array("image_id").alias("image_ids"), "status")
    )


def exclusions(members: DataFrame, events: DataFrame) -> DataFrame:
    """(cluster_id, image_id) of irregular clusters."""
    irregular = cluster_states(members, events).where("status = 'irregular'").select("cluster_id")
    return members.select("cluster_id", "image_id").join(irregular, "cluster_id", "left_semi")


def approve_remaining(members: DataFrame, events: DataFrame) -> DataFrame:
    """The log with an approval of every cluster that no event concerns."""
    most = events.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m"))
    new = members.select("cluster_id").distinct().join(events.select("cluster_id"), "cluster_id", "left_anti").crossJoin(F.broadcast(most))
    return events.unionByName(new.select("cluster_id", (c("m") + 1).alias("seq"), F.lit("approve").alias("action")), allowMissingColumns=True)


def progress(members: DataFrame, events: DataFrame) -> DataFrame:
    return cluster_states(members, events).agg(
        F.count("*").alias("clusters"), F.count_if("reviewed").alias("reviewed"), F.count_if(c("status") == "approved").alias("approved"),
        F.count_if(c("status") == "edited").alias("edited"), F.count_if("dissolved").alias("dissolved"), F.count_if(c("status") == "irregular").alias("irregular"),
    )


def final_boxes(proposed: DataFrame, box_events: DataFrame) -> DataFrame:
    """(image_id, boxes, bbox_status): the latest boxes set and the latest of set, approve and unapprove, apart from membership."""
    latest = box_events.groupBy("image_id").agg(
        F.max_by("boxes", F.when(c("boxes").isNotNull(), c("seq"))).alias("_boxes"), F.max_by("action", "seq").alias("_last")
    )
    return proposed.join(latest, "image_id", "left").select(
        "image_id", F.coalesce("_boxes", "boxes").alias("boxes"),
        F.when(c("_last") == "approve", "approved").when(c("_boxes").isNotNull(), "edited").otherwise("unreviewed").alias("bbox_status"),
    )


def approve_remaining_boxes(proposed: DataFrame, box_events: DataFrame) -> DataFrame:
    """The box log with an approval of every image whose boxes are unreviewed."""
    most = box_events.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m"))
    open_ = final_boxes(proposed, box_events).where("bbox_status = 'unreviewed'").select("image_id").crossJoin(F.broadcast(most))
    return box_events.unionByName(open_.select("image_id", (c("m") + 1).alias("seq"), F.lit("approve").alias("action")), allowMissingColumns=True)


def box_problem(box: Column, width: Column, height: Column) -> Column:
    """What is wrong with a box of four numbers in an image of that size (null: unknown), rounded to whole pixels; null where it is sound."""
    at = lambda i: F.rint(F.get(box, F.lit(i)))
    return (
        F.when(box.isNull() | (F.size(box) != 4) | F.exists(box, lambda v: v.isNull() | F.isnan(v)), F.lit("a box needs four numbers"))
        .when((at(0) < 0) | (at(1) < 0), F.lit("a box starts outside the image"))
        .when((at(2) <= at(0)) | (at(3) <= at(1)), F.lit("a box is empty"))
        .when((at(2) > width) | (at(3) > height), F.lit("a box ends outside the image"))
    )


def confidence_queue(clusters: DataFrame, pairs: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Clusters (cluster_id, image_ids) to review, the weakest first: queue_position, confidence_min, _mean, _max, largest_gap, models.

    Confidences are those of the accepted pairs inside; a cluster without any goes last, as if its least were 2.
    ``sizes`` (image_id, width, height), if given, adds the images with their dimensions.
    """
    members = clusters.select("cluster_id", F.explode("image_ids").alias("image_id"))
    end = lambda side: members.select(c("image_id").alias(f"{side}_image_id"), c("cluster_id").alias(f"_{side}"))
    inside = pairs.where("same_document").join(end("first"), "first_image_id").join(end("second"), "second_image_id").where("_first = _second")
    stats = inside.groupBy(c("_first").alias("cluster_id")).agg(
        F.min("confidence").alias("confidence_min"), F.avg("confidence").alias("confidence_mean"), F.max("confidence").alias("confidence_max"),
        F.max("index_gap").alias("largest_gap"), F.array_sort(F.collect_set("registration_model")).alias("models"),
    )
    rows = clusters.join(stats, "cluster_id", "left").withColumn("_least", F.coalesce("confidence_min", F.lit(2.0)))
    queue = counted_before(rows, ["_least", "cluster_id"], "queue_position").drop("_least")
    if sizes is None:
        return queue
    shown = members.join(sizes, "image_id", "left").groupBy("cluster_id").agg(F.collect_list(F.struct("image_id", "width", "height")).alias("images"))
    return queue.join(shown, "cluster_id")


def review_reasons(rows: DataFrame) -> Column:
    """Why a cropped cluster goes to a person, as an array: by columns submissions, partial, low_content, unresolved, boundary_risk."""
    reasons = {
        "submissions = 0": "no submission recovered", "partial > 0": "a page is only partly visible", "low_content > 0": "a crop shows little content",
        "unresolved > 0": "a side stays unresolved", "boundary_risk > 0": "a crop may cut the sheet",
    }
    return F.filter(F.array(*(F.when(F.expr(k), F.lit(v)) for k, v in reasons.items())), lambda x: x.isNotNull())


# --- labels

RELATIONS = ("exact_duplicate", "near_duplicate", "occlusion_variant", "partial_overlap", "hard_negative", "different_document")


def apply_overrides(cases: DataFrame, overrides: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases after upserts and deletions; overrides have the cases' columns, ``delete`` and ``line``; the last line of a case wins."""
    columns = [x for x in cases.columns if x != key]
    last = overrides.groupBy(key).agg(F.max_by(F.struct("delete", *columns), "line").alias("o"))
    gone = F.coalesce(c("o.delete"), F.lit(False))
    return cases.join(last, key, "full").where(~gone).select(key, *(F.when(c("o").isNotNull(), c(f"o.{x}")).otherwise(c(x)).alias(x) for x in columns))


def case_problems(cases: DataFrame) -> DataFrame:
    """(case_id, problem) for every rule that a label case breaks."""
    images, relation, expected = c("images"), c("relation"), c("expected_cluster")
    rule = lambda broken, text: F.when(F.coalesce(broken, F.lit(True)), F.lit(text))
    different = relation.isin("hard_negative", "different_document")
    rules = F.array(
        rule(c("case_id").isNull() | (F.trim("case_id") == ""), "case_id is empty"),
        rule(F.size(images) < 2, "fewer than two images"),
        rule(F.size(F.array_distinct(images)) != F.size(images), "an image twice"),
        rule(~relation.isin(*RELATIONS), "unknown relation"),
        rule(different == expected, "relation and expected_cluster disagree"),
        F.when(c("expected_min_submissions") < 0, F.lit("negative minimum of submissions")),
    )
    twice = cases.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("case_id twice").alias("problem"))
    return cases.select("case_id", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("problem")).unionByName(twice)
