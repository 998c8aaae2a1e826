"""Groups of captures that belong together.

The constrained union takes accepted edges best first and refuses a merge that a
contradiction forbids, so its result depends on the order of edges. Only accepted
edges can merge, so the plain components of accepted edges are found first, by
distributed stars; each is then united in Python by itself. Tasks thus follow the
components, not the sequences, however few and long these are. The flags that the
rules need are columns.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..materialize import materialize
from .components import components
from .ranks import counted_before

c = F.col


def _measured() -> Column:
    """Whether a pair has content metrics; older rows have the pessimistic defaults."""
    return (
        (c("unmatched_ink_union_fraction") < 1) | (c("ink_mismatch_tiles_fraction") < 1)
        | (c("residual_tiles_changed_fraction") < 1) | (c("occlusion_candidate_count") > 0)
    )


def blocks_merge() -> Column:
    """A rejected pair that keeps its two groups apart. Failed registration alone does not."""
    unmeasured = (
        ~c("same_document") & c("registration_model").isNotNull()
        & (c("valid_fraction") >= 0.65) & (c("feature_overlap") >= 0.06) & (c("changed_fraction") >= 0.65)
    )
    return c("hard_contradiction") | (~_measured() & unmeasured)


def may_be_bridged() -> Column:
    """A contradiction that two sheets in different places could explain."""
    return (
        blocks_merge() & c("registration_model").isNotNull() & (c("occlusion_area_fraction") >= 0.30)
        & (c("occlusion_residual_capture") >= 0.55) & (c("occlusion_material_fraction") >= 0.50) & (c("occlusion_material_median") >= 0.02)
    )


def bridges() -> Column:
    """An accepted occlusion edge whose block is localised well enough to explain a contradiction of its ends' neighbours."""
    clean = (c("outside_unmatched_ink_union_fraction") <= 0.08) & (c("outside_ink_mismatch_tiles_fraction") <= 0.30)
    replaced = (c("inside_unmatched_ink_union_fraction") >= 0.35) | (c("occlusion_material_median") >= 0.02)
    return (
        c("same_document") & c("automatic_link_eligible") & c("branch").eqNullSafe("physical_occlusion")
        & (c("occlusion_evidence") >= 0.45) & (c("occlusion_ink_mismatch_capture") >= 0.35)
        & (c("occlusion_localization_contrast") >= 0.03) & replaced & (clean | (c("full_page_occlusion_count") > 0))
    )


def union_constrained(nodes: list, edges: Iterable[tuple], max_size: int | None = None) -> dict:
    """node -> first node of its group. Edges are (a, b, accepted, confidence, blocks, bridgeable, bridge) in their order."""
    group = {n: {n} for n in nodes}
    accepted: list[tuple] = []
    blocked: dict[object, dict[object, bool]] = {n: {} for n in nodes}
    spans: dict[object, set] = {n: set() for n in nodes}
    for a, b, same, confidence, blocks, bridgeable, bridge in edges:
        # the last row of a pair counts
        for x, y in ((a, b), (b, a)):
            blocked[x].pop(y, None)
            spans[x].discard(y)
            if blocks:
                blocked[x][y] = bridgeable
            if bridge:
                spans[x].add(y)
        if same:
            accepted.append((confidence, a, b))

    def forbidden(left: set, right: set) -> bool:
        if len(left) > len(right):
            left, right = right, left
        for x in left:
            for y, bridgeable in blocked[x].items():
                if y in right and not (bridgeable and any(z in left or z in right for z in spans[x] & spans[y])):
                    return True
        return False

    for _, a, b in sorted(accepted, key=lambda e: -e[0]):
        left, right = group[a], group[b]
        if left is right or (max_size is not None and len(left) + len(right) > max_size) or forbidden(left, right):
            continue
        if len(left) < len(right):
            left, right = right, left
        left |= right
        for n in right:
            group[n] = left
    rank = {n: i for i, n in enumerate(nodes)}
    first = {id(g): min(g, key=rank.__getitem__) for g in {id(g): g for g in group.values()}.values()}
    return {n: first[id(group[n])] for n in nodes}


def constrained_groups(items: DataFrame, pairs: DataFrame, max_size: int | None = None) -> DataFrame:
    """(sequence_id, image_id, sequence_index, root): items (sequence_id, image_id, sequence_index) in their groups.

    ``pairs`` has sequence_id, first_image_id, second_image_id, index_gap and the
    metrics and decisions of the canonical schema. Ties in confidence go by the
    first item's position, then the gap. Pairs without a known end are ignored.
    """
    kinds = dict(items.dtypes)
    accepted = pairs.where("same_document").select("sequence_id", c("first_image_id").alias("a"), c("second_image_id").alias("b"))
    parts = materialize(items.select("sequence_id", "image_id", "sequence_index").join(components(items, accepted, ["sequence_id", "image_id"], "sequence_index"), ["sequence_id", "image_id"]))
    sizes = parts.groupBy("sequence_id", "root").agg(F.count("*").alias("n"))
    joined = parts.join(sizes, ["sequence_id", "root"])
    many = joined.where("n > 1").drop("n")
    end = lambda side: many.select("sequence_id", c("image_id").alias(f"{side}_image_id"), c("root").alias(f"_{side}"))
    flagged = (
        pairs.join(end("first"), ["sequence_id", "first_image_id"]).join(end("second"), ["sequence_id", "second_image_id"]).where("_first = _second")
        .select(
            "sequence_id", c("_first").alias("root"),
            F.struct(
                "first_image_id", "second_image_id", "index_gap", "same_document", "confidence",
                blocks_merge().alias("blocks"), may_be_bridged().alias("bridgeable"), bridges().alias("bridge"),
            ).alias("p"),
        )
    )
    both = many.withColumn("p", F.lit(None).cast(flagged.schema["p"].dataType)).unionByName(
        flagged.withColumns({"image_id": F.lit(None).cast(kinds["image_id"]), "sequence_index": F.lit(None).cast(kinds["sequence_index"])})
    )

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        mine = rows[rows["image_id"].notna()].sort_values("sequence_index", kind="stable")
        nodes = mine["image_id"].tolist()
        place = {n: i for i, n in enumerate(nodes)}
        found = [dict(p) if not hasattr(p, "asDict") else p.asDict() for p in rows.loc[rows["image_id"].isna(), "p"] if p is not None]
        found.sort(key=lambda p: (place[p["first_image_id"]], p["index_gap"]))
        edges = [tuple(p[k] for k in ("first_image_id", "second_image_id", "same_document", "confidence", "blocks", "bridgeable", "bridge")) for p in found]
        roots = union_constrained(nodes, edges, max_size)
        out = mine[["sequence_id", "image_id", "sequence_index"]].copy()
        out["root"] = [roots[n] for n in nodes]
        return out

    schema = f"sequence_id {kinds['sequence_id']}, image_id {kinds['image_id']}, sequence_index {kinds['sequence_index']}, root {kinds['image_id']}"
    alone = joined.where("n = 1").select("sequence_id", "image_id", "sequence_index", "root")
    # records and representatives read the groups several times
    return materialize(both.groupBy("sequence_id", "root").applyInPandas(one, schema).unionByName(alone))


def representatives(members: DataFrame, pairs: DataFrame, group: str = "root") -> DataFrame:
    """(sequence_id, group, representative): the member of largest summed confidence over accepted pairs inside; ties to the earlier.

    A member's confidences are added from the lowest up, so that equal ones give equal sums in whatever order the rows come.
    """
    inside = members.select("sequence_id", "image_id", group)
    ends = (
        pairs.where("same_document")
        .join(inside.withColumnsRenamed({"image_id": "first_image_id", group: "_g1"}), ["sequence_id", "first_image_id"])
        .join(inside.withColumnsRenamed({"image_id": "second_image_id", group: "_g2"}), ["sequence_id", "second_image_id"])
        .where("_g1 = _g2")
        .select("sequence_id", F.explode(F.array("first_image_id", "second_image_id")).alias("image_id"), "confidence")
        .groupBy("sequence_id", "image_id")
        .agg(F.aggregate(F.sort_array(F.collect_list("confidence")), F.lit(0.0), lambda total, x: total + x).alias("degree"))
    )
    best = F.max_by("image_id", F.struct(F.coalesce("degree", F.lit(0.0)).alias("d"), (-c("sequence_index")).alias("i")))
    return members.join(ends, ["sequence_id", "image_id"], "left").groupBy("sequence_id", group).agg(best.alias("representative"))


def cluster_records(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cluster_id, sequence_id, image_ids, representative_image_id): numbered by sequence and first member; single items stay."""
    gathered = members.groupBy("sequence_id", "root").agg(
        F.sort_array(F.collect_list(F.struct("sequence_index", "image_id"))).alias("m")
    )
    # numbers run on over the sequences
    numbered = counted_before(gathered.withColumn("_first", F.get(c("m"), F.lit(0))["sequence_index"]), ["sequence_id", "_first"], "n").drop("_first")
    return numbered.join(representatives(members, pairs), ["sequence_id", "root"]).select(
        F.format_string("cluster_%05d", "n").alias("cluster_id"),
        "sequence_id",
        c("m.image_id").alias("image_ids"),
        c("representative").alias("representative_image_id"),
    )


def link_components(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(sequence_id, image_id, root) over edges (sequence_id, a, b), without constraints: the first item each is connected to."""
    return components(items, edges, ["sequence_id", "image_id"], "sequence_index")


def group_id(image_ids: Column) -> Column:
    return F.concat(F.lit("occ-"), F.substring(F.sha1(F.array_join(image_ids, "|")), 1, 10))


def transforms_to_anchor(edges: pd.DataFrame, anchor: object) -> dict:
    """member -> 3x3 transform to the anchor, composed along the breadth-first path that is found first.

    ``edges`` has a, b and m, which maps b to a; reversed edges use the inverse.
    """
    import numpy as np

    out, queue = {anchor: np.eye(3)}, [anchor]
    for here in queue:
        for a, b, m in edges[["a", "b", "m"]].itertuples(index=False):
            matrix = np.asarray(m, float).reshape(3, 3)
            if a == here and b not in out:
                out[b] = out[here] @ matrix
                queue.append(b)
            elif b == here and a not in out:
                out[a] = out[here] @ np.linalg.inv(matrix)
                queue.append(a)
    return out
