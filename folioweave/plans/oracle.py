"""DuckDB SQL for the queries, written apart from their Spark form."""

from __future__ import annotations

from . import checks
from .captures import IMAGES_SQL, LABELS_SQL, PAIRS_SQL

#: CTEs over ``pairs``: the rules as columns, one step on the next.
_RULES = f"""{PAIRS_SQL}, r1 AS (
  SELECT *, occlusion_area_fraction * greatest(page_count, 1) / greatest(occlusion_candidate_count, 1) AS support,
    CASE WHEN registration_fallback_used THEN registration_alignment_score >= 0.30 ELSE feature_overlap >= 0.10 END AS occ_reg,
    CASE WHEN registration_fallback_used THEN registration_alignment_score >= 0.30 ELSE feature_overlap >= 0.08 END AS dup_reg
  FROM pairs
), r2 AS (
  SELECT *, full_page_occlusion_count > 0 AND support >= 0.75 AND ink_mismatch_tiles_fraction >= 0.55
      AND occlusion_material_median < 0.08 AND inside_unmatched_ink_union_fraction < 0.60 AS page_text,
    dup_reg AND changed_fraction <= 0.35 AND unmatched_ink_fraction <= 0.0025 AND unmatched_ink_union_fraction <= 0.02
      AND ink_mismatch_tiles_fraction <= 0.10 AS near_dup
  FROM r1
), r3 AS (
  SELECT *, NOT page_text AND occlusion_ink_mismatch_capture >= 0.85 AND occlusion_localization_contrast >= 0.35
      AND outside_unmatched_ink_union_fraction <= 0.015 AND outside_ink_mismatch_tiles_fraction <= 0.10 AND support >= 0.30
      AND occlusion_residual_capture >= 0.75 AND occlusion_rectangularity >= 0.20 AS erased
  FROM r2
), r4 AS (
  SELECT *, (unmatched_ink_union_fraction >= 0.45 AND ink_mismatch_tiles_fraction >= 0.75 AND occlusion_material_median < 0.035)
      OR (unmatched_ink_union_fraction >= 0.08 AND ink_mismatch_tiles_fraction >= 0.09 AND inside_unmatched_ink_union_fraction < 0.35
          AND occlusion_material_median < 0.006 AND NOT erased)
      OR (outside_unmatched_ink_union_fraction >= 0.20 AND outside_ink_mismatch_tiles_fraction >= 0.55 AND occlusion_ink_mismatch_capture < 0.60)
      OR page_text AS other_record,
    changed_fraction >= 0.51 AS strong,
    changed_fraction >= 0.65 AND occlusion_residual_capture >= 0.55 AND occlusion_material_median >= 0.020 AS extreme
  FROM r3
), r5 AS (
  SELECT *, occ_reg AND occlusion_candidate_count BETWEEN 1 AND 2 AND NOT other_record AND occlusion_ink_mismatch_capture >= 0.15
      AND occlusion_localization_contrast >= 0.03
      AND (inside_unmatched_ink_union_fraction >= 0.35 OR occlusion_material_median >= 0.006 OR erased)
      AND support >= CASE WHEN strong THEN 0.15 ELSE 0.22 END AND occlusion_rectangularity >= 0.20 AND occlusion_residual_capture >= 0.38
      AND outside_unmatched_ink_union_fraction <= CASE WHEN extreme THEN 0.30 WHEN strong THEN 0.08 ELSE 0.06 END
      AND outside_ink_mismatch_tiles_fraction <= CASE WHEN extreme THEN 0.55 WHEN strong THEN 0.45 ELSE 0.30 END
      AND (strong OR extreme OR erased OR (changed_fraction >= 0.40 AND occlusion_material_median >= 0.024)
        OR (changed_fraction >= 0.34 AND outside_unmatched_ink_union_fraction <= 0.015 AND support >= 0.40)
        OR (support >= 0.30 AND occlusion_residual_capture >= 0.75 AND occlusion_material_median >= 0.020
            AND outside_unmatched_ink_union_fraction <= 0.015 AND outside_ink_mismatch_tiles_fraction <= 0.10)) AS occluded,
    other_record
      OR (unmatched_ink_union_fraction >= 0.08 AND ink_mismatch_tiles_fraction >= 0.09 AND occlusion_material_median <= 0.020)
      OR (NOT (occlusion_candidate_count = 2 AND occlusion_material_fraction >= 0.50 AND outside_unmatched_ink_union_fraction <= 0.04
               AND outside_ink_mismatch_tiles_fraction <= 0.15)
          AND ((ink_mismatch_tiles_fraction >= 0.20 AND unmatched_ink_union_fraction >= 0.06)
            OR (residual_tiles_changed_fraction >= 0.18 AND outside_unmatched_ink_union_fraction >= 0.08 AND outside_ink_mismatch_tiles_fraction >= 0.04)
            OR (ink_mismatch_tiles_fraction >= 0.70 AND unmatched_ink_union_fraction >= 0.25 AND outside_unmatched_ink_union_fraction >= 0.20))) AS raw
  FROM r4
), r6 AS (
  SELECT *, CASE WHEN valid_fraction < 0.65 THEN 'insufficient valid overlap' WHEN near_dup THEN 'ink agrees nearly everywhere'
      WHEN other_record THEN 'same form, different entries' WHEN occluded THEN 'one large block covers part of the page'
      WHEN NOT occ_reg THEN 'weak registration support' WHEN ink_mismatch_tiles_fraction >= 0.20 THEN 'ink disagrees in many places'
      WHEN occlusion_candidate_count = 0 THEN 'no block explains the disagreement'
      WHEN outside_unmatched_ink_union_fraction > 0.06 THEN 'ink disagrees outside the block'
      WHEN raw THEN 'ink or exterior disagrees all over' ELSE 'block support, density or exterior insufficient' END AS why,
    outside_unmatched_ink_union_fraction >= 0.10 AND outside_ink_mismatch_tiles_fraction >= 0.40 AS dirty
  FROM r5
), r7 AS (
  SELECT *, CASE why WHEN 'ink agrees nearly everywhere' THEN 'near_duplicate' WHEN 'one large block covers part of the page' THEN 'physical_occlusion' END AS branch FROM r6
), r8 AS (
  SELECT *, {{safety}} AS safety FROM r7
), decided AS (
  SELECT *, branch IS NOT NULL AND safety IS NULL AS same_document, branch IS NULL AND raw AS hard_contradiction,
    CASE WHEN branch IS NOT NULL AND safety IS NOT NULL THEN 'review only: ' || safety ELSE why END AS reason,
    CASE WHEN registration_fallback_used THEN least(1.0, greatest(0.0, (registration_alignment_score - 0.30) / 0.50))
      ELSE least(1.0, greatest(0.0, (feature_overlap - 0.06) / 0.24)) END AS s
  FROM r8
), confident AS (
  SELECT *, CASE branch
      WHEN 'near_duplicate' THEN 0.45 * s + 0.55 * least(1.0, greatest(0.0, 1 - unmatched_ink_union_fraction / 0.02))
      WHEN 'physical_occlusion' THEN 0.30 * s + 0.40 * least(1.0, greatest(0.0, 1 - outside_unmatched_ink_union_fraction / 0.08))
        + 0.30 * least(1.0, greatest(0.0, occlusion_residual_capture / 0.70))
      ELSE 0.35 * s + 0.15 * (1 - least(1.0, greatest(0.0, ink_mismatch_tiles_fraction / 0.40))) END AS base
  FROM decided
), final AS (
  SELECT *, CASE WHEN same_document THEN greatest(base, 0.50) ELSE least(base, 0.49) END AS confidence FROM confident
)"""

_PLACE = r"regexp_extract(replace({0}, '.jpg', ''), '^(.*?)(\d+)$', {1})"


def _safety(branch: str) -> str:
    p, q = (_PLACE.format(x, 1) for x in ("first_path", "second_path"))
    m, n = (f"CAST({_PLACE.format(x, 2)} AS BIGINT)" for x in ("first_path", "second_path"))
    return f"""CASE WHEN {p} <> {q} THEN 'filename prefixes differ'
      WHEN abs({m} - {n}) > 12 THEN 'filename positions too far apart'
      WHEN registration_fallback_used AND full_page_occlusion_count > 0 THEN 'full page by fallback registration'
      WHEN {branch} = 'physical_occlusion' AND (registration_fallback_used OR feature_overlap < 0.35) THEN 'occlusion without strong overlap'
      WHEN {branch} = 'physical_occlusion' AND dirty AND NOT (feature_overlap >= 0.15 OR registration_alignment_score >= 0.55)
      THEN 'dirty exterior without strong registration support' END"""


_FINAL = "WITH " + _RULES.replace("{safety}", f"CASE WHEN branch IS NOT NULL THEN {_safety('branch')} END")


def _ramp(x: str, low: float, high: float) -> str:
    return f"least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), ({x} - {low!r}) / ({high!r} - {low!r})))"


_INSIDE, _MATERIAL = _ramp("inside_unmatched_ink_union_fraction", 0.35, 0.70), _ramp("occlusion_material_median", 0.006, 0.048)
_AGREE = f"least(1 - {_ramp('outside_unmatched_ink_union_fraction', 0.015, 0.30)}, 1 - {_ramp('outside_ink_mismatch_tiles_fraction', 0.10, 0.55)})"
_EVIDENCE = f"""CASE WHEN occlusion_candidate_count NOT BETWEEN 1 AND 2 THEN 0 ELSE least(1, greatest(0, (
   0.12 * {_ramp('support', 0.099, 0.22)} + 0.22 * {_ramp('occlusion_residual_capture', 0.171, 0.665)}
   + 0.22 * (0.55 * {_ramp('occlusion_ink_mismatch_capture', 0.15, 0.75)} + 0.25 * {_ramp('occlusion_localization_contrast', 0.03, 0.35)} + 0.20 * {_INSIDE})
   + 0.18 * CASE WHEN full_page_occlusion_count > 0 AND support >= 0.70 THEN greatest({_AGREE}, 0.5 * {_MATERIAL}) ELSE {_AGREE} END
   + 0.08 * {_ramp('occlusion_rectangularity', 0.10, 0.60)} + 0.18 * greatest({_INSIDE}, {_MATERIAL}))
   * CASE WHEN (outside_unmatched_ink_union_fraction >= 0.20 AND outside_ink_mismatch_tiles_fraction >= 0.55)
       OR (occlusion_ink_mismatch_capture < 0.15 AND occlusion_residual_capture < 0.38)
       OR (inside_unmatched_ink_union_fraction < 0.35 AND occlusion_material_median < 0.006 AND NOT erased) OR page_text THEN 0.05 ELSE 1 END)) END"""
_IDENTITY = f"""CASE WHEN NOT dirty THEN 1 WHEN registration_fallback_used THEN {_ramp('registration_alignment_score', 0.30, 0.55)} ELSE {_ramp('feature_overlap', 0.06, 0.15)} END"""

_INPUTS = """registration_fallback_used::INT|inlier_ratio|feature_overlap|x_span|y_span|valid_fraction|changed_fraction|unmatched_ink_fraction
unmatched_ink_union_fraction|largest_ink_component_fraction|residual_tiles_changed_fraction|ink_mismatch_tiles_fraction|occlusion_candidate_count
occlusion_area_fraction|occlusion_residual_capture|occlusion_rectangularity|occlusion_material_fraction|occlusion_material_median
outside_unmatched_ink_fraction|outside_unmatched_ink_union_fraction|outside_ink_mismatch_tiles_fraction|(1 - occlusion_area_fraction)""".replace("\n", "|").split("|")


def _logit(which: int) -> str:
    from ..operators.probability import INTERCEPTS, WEIGHTS

    terms = " + ".join(f"CAST({w[which]!r} AS DOUBLE) * {x}" for w, x in zip(WEIGHTS.values(), _INPUTS))
    return f"(1 / (1 + exp(-greatest(-40, least(40, CAST({INTERCEPTS[which]!r} AS DOUBLE) + {terms})))))"


_BINNED = f"WITH {LABELS_SQL}, binned AS (SELECT CASE WHEN p >= 1 THEN 9 ELSE len(list_filter(range(1, 10), lambda i: p >= i / 10.0::DOUBLE)) END AS bin, p, truth FROM scored)"
_TABLE = "SELECT CAST(bin AS INTEGER) AS bin, count(*) AS count, avg(p) AS mean_probability, avg(truth) AS observed_rate, abs(avg(p) - avg(truth)) AS absolute_gap FROM binned GROUP BY bin"
_RATES = f"""WITH {LABELS_SQL}, f AS (
  SELECT *, truth = 1 AS yes, p >= 0.7 AND NOT contradiction AS edge, p >= 0.3 AS flag, (p >= 0.7 AND NOT contradiction) OR p >= 0.6 AS joined FROM scored)"""
_GROUPED = f"""WITH {LABELS_SQL}, m AS (
  SELECT doc_id // 6 AS g, doc_id, CASE WHEN p >= 0.35 THEN (doc_id // 6) * 1000 ELSE doc_id * 1000 + 1 END AS root FROM scored
), groups AS (
  SELECT g AS original_cluster_id, CASE WHEN g % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS review_decision,
         count(DISTINCT root) AS predicted_component_count, count(DISTINCT doc_id) AS cluster_size FROM m GROUP BY g
), stated AS (
  SELECT *, CASE WHEN review_decision = 'accepted' THEN CASE WHEN predicted_component_count = 1 THEN 'recovered' ELSE 'split' END
            WHEN predicted_component_count = cluster_size THEN 'separated' ELSE 'contaminated' END AS group_status,
         ['development', 'selection', 'locked_audit'][original_cluster_id % 3 + 1] AS split FROM groups
)"""
_LINKED = _FINAL + """, linked AS (
  SELECT * REPLACE (same_document OR (first_image_id * 31 + second_image_id) % 5 < 2 AS same_document),
         same_document AND NOT hard_contradiction OR (first_image_id * 31 + second_image_id) % 5 < 2 AS eligible FROM final
), both_ways AS (
  SELECT first_image_id AS node, second_image_id AS other FROM linked WHERE same_document
  UNION SELECT second_image_id, first_image_id FROM linked WHERE same_document
)"""
_QUARTERS = """, member AS (
  SELECT sequence_id, image_id, row_number() OVER (PARTITION BY sequence_id ORDER BY image_id) - 1 AS i FROM images
)"""
_TIERED = _LINKED + _QUARTERS + """, common AS (
  SELECT l.first_image_id AS f, l.second_image_id AS sec, count(*) AS n FROM linked l
  JOIN both_ways x ON x.node = l.first_image_id JOIN both_ways y ON y.node = l.second_image_id AND y.other = x.other GROUP BY ALL
), ranked AS (
  SELECT l.*, coalesce(n, 0) AS common, ma.sequence_id = mb.sequence_id AND ma.i // 4 = mb.i // 4 AS same_component, l.same_document AND raw AS acceptance_conflict
  FROM linked l LEFT JOIN common ON f = first_image_id AND sec = second_image_id
  JOIN member ma ON ma.image_id = first_image_id JOIN member mb ON mb.image_id = second_image_id
), tiers AS (
  SELECT *, CASE WHEN acceptance_conflict THEN 0 WHEN same_document THEN 5 WHEN hard_contradiction THEN 4 WHEN common > 0 THEN 1
            WHEN same_component THEN 2 ELSE 3 END AS review_tier, """ + f"""{_logit(0)} * ({_logit(1)} * (({_EVIDENCE}) * ({_IDENTITY}))) AS so FROM ranked
)"""
_BOX = """boxes AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {k} % 97 AS x0, {k} % 89 AS y0, {k} % 97 + l_quantity::BIGINT AS x1, {k} % 89 + l_linenumber * 7 AS y1 FROM lineitem)"""
_REVIEW = """WITH RECURSIVE member AS (
  SELECT DISTINCT l_orderkey AS cluster_id, l_linenumber AS image_id FROM lineitem
), event AS (
  SELECT user_id % 500 AS cluster_id, event_id AS seq,
    CASE WHEN event_id % 11 < 6 THEN 'membership' WHEN event_id % 11 < 8 THEN 'approve' WHEN event_id % 11 < 9 THEN 'dissolve'
         WHEN event_id % 11 < 10 THEN 'irregular' ELSE 'reopen' END AS action, (event_id % 5 + 1)::INTEGER AS image_id, event_id % 3 = 0 AS included FROM events
), grouped AS (
  SELECT cluster_id, list(image_id ORDER BY image_id) AS images FROM member GROUP BY 1
), ordered AS (
  SELECT e.*, row_number() OVER (PARTITION BY cluster_id ORDER BY seq) AS k FROM event e
), fold AS (
  SELECT cluster_id, images, 0::BIGINT AS k, 'unreviewed' AS status, []::INTEGER[] AS gone FROM grouped
  UNION ALL
  SELECT cluster_id, images, k, CASE action WHEN 'approve' THEN 'approved' WHEN 'dissolve' THEN 'dissolved' WHEN 'irregular' THEN 'irregular' WHEN 'reopen' THEN 'unreviewed'
      ELSE CASE WHEN NOT known THEN status WHEN len(images) >= 2 AND len(images) - len(next) < 2 THEN 'dissolved' WHEN len(next) > 0 THEN 'edited'
           WHEN status IN ('approved', 'irregular') THEN status ELSE 'edited' END END, next
  FROM (
    SELECT f.cluster_id, images, o.k, status, action, list_contains(images, image_id) AS known,
      CASE WHEN action IN ('approve', 'reopen') THEN [] WHEN action = 'dissolve' THEN images WHEN action = 'irregular' OR NOT list_contains(images, image_id) THEN gone
           WHEN included THEN list_filter(gone, lambda x: x <> image_id) WHEN list_contains(gone, image_id) THEN gone ELSE list_append(gone, image_id) END AS next
    FROM fold f JOIN ordered o ON o.cluster_id = f.cluster_id AND o.k = f.k + 1)
), state AS (
  SELECT cluster_id, len(images) AS image_count, len(images) - len(gone) AS kept, status, images, gone FROM fold
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY k DESC) = 1
)"""
_PERSON = """WITH c0 AS (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, c_custkey % 3 = 0 AS two, abs(c_acctbal) % 100 / 100.0::DOUBLE AS risk FROM customer
), c1 AS (
  SELECT *, format('i{:04d}-{:06d}', c_nationkey, i) AS image_id,
    2.25 + 1.1 + CASE WHEN c_custkey % 4 > 0 AND c_mktsegment <> '' THEN 1.5 ELSE 0 END
    + CASE WHEN two THEN 2.25 + 1.1 + CASE WHEN (c_custkey + 2) % 4 > 0 AND c_mktsegment <> '' THEN 1.5 ELSE 0 END ELSE 0 END AS mass,
    CASE WHEN two THEN 2 ELSE 1 END AS n FROM c0
)"""

_REPLAY = f"""WITH {LABELS_SQL}, o AS (
  SELECT *, doc_id // 3 AS g, row_number() OVER (PARTITION BY doc_id // 3 ORDER BY doc_id) AS i FROM scored
), cmp AS (
  SELECT a.g, least(a.p, b.p) AS p, a.p >= 0.2 AND NOT (a.contradiction OR b.contradiction) AS may, a.index_gap, b.registration_alignment_score AS q
  FROM o a JOIN o b ON a.g = b.g AND b.i > a.i
), cfg AS (
  SELECT * FROM (SELECT unnest([0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold), (SELECT unnest([NULL, 1, 2])::INTEGER AS max_gap), (SELECT unnest([NULL, 0.25])::DOUBLE AS min_alignment)
), e AS (
  SELECT g, threshold, max_gap, min_alignment, count(*) AS compared, count(*) FILTER (p >= 0.5) AS flagged,
    count(*) FILTER (may AND p >= threshold AND (max_gap IS NULL OR index_gap <= max_gap) AND (min_alignment IS NULL OR coalesce(q >= min_alignment, false))) AS edges
  FROM cmp, cfg GROUP BY 1, 2, 3, 4
), grp AS (
  SELECT g, count(*) AS n, g % 3 <> 0 AS yes FROM scored JOIN (SELECT doc_id, doc_id // 3 AS g FROM scored) USING (doc_id) GROUP BY g
), st AS (
  -- a group has at most three members: one edge joins two, any two join all
  SELECT cfg.threshold, cfg.max_gap, cfg.min_alignment, yes, n, n * (n - 1) // 2 AS pairs, coalesce(edges, 0) AS edges, coalesce(compared, 0) AS compared, coalesce(flagged, 0) AS flagged,
    CASE WHEN coalesce(edges, 0) = 0 THEN 0 WHEN n = 3 AND edges >= 2 THEN 3 ELSE 1 END AS joined,
    n - CASE WHEN coalesce(edges, 0) = 0 THEN 0 WHEN n = 3 AND edges >= 2 THEN 2 ELSE 1 END AS parts
  FROM grp CROSS JOIN cfg LEFT JOIN e ON e.g = grp.g AND e.threshold = cfg.threshold AND e.max_gap IS NOT DISTINCT FROM cfg.max_gap AND e.min_alignment IS NOT DISTINCT FROM cfg.min_alignment
), replayed AS (
  SELECT threshold, max_gap, min_alignment, count(*) FILTER (yes) AS accepted_groups, count(*) FILTER (yes AND parts = 1) AS accepted_groups_recovered,
    count(*) FILTER (NOT yes) AS rejected_groups, count(*) FILTER (NOT yes AND parts = n) AS rejected_groups_separated,
    coalesce(sum(pairs) FILTER (yes), 0)::BIGINT AS positive_pairs, coalesce(sum(joined) FILTER (yes), 0)::BIGINT AS positive_pairs_connected,
    coalesce(sum(pairs) FILTER (NOT yes), 0)::BIGINT AS negative_pairs, coalesce(sum(joined) FILTER (NOT yes), 0)::BIGINT AS negative_pairs_connected,
    coalesce(sum(edges) FILTER (yes), 0)::BIGINT AS automatic_edge_tp, coalesce(sum(edges) FILTER (NOT yes), 0)::BIGINT AS automatic_edge_fp,
    coalesce(sum(flagged) FILTER (yes), 0)::BIGINT AS candidate_tp, coalesce(sum(flagged) FILTER (NOT yes), 0)::BIGINT AS candidate_fp,
    coalesce(sum(compared) FILTER (yes), 0)::BIGINT AS compared_positive_pairs, coalesce(sum(compared) FILTER (NOT yes), 0)::BIGINT AS compared_negative_pairs
  FROM st GROUP BY 1, 2, 3
), judged AS (
  SELECT *, accepted_groups_recovered = accepted_groups AND rejected_groups_separated = rejected_groups AS perfect_group_fit,
    automatic_edge_fp = 0 AND negative_pairs_connected = 0 AS zero_false_links FROM replayed
)"""

def _box(key: str) -> str:
    return f"""SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS price, {key} % 97 AS x0, {key} % 89 AS y0,
      {key} % 97 + CAST(l_quantity AS BIGINT) AS x1, {key} % 89 + l_linenumber * 7 AS y1 FROM lineitem"""


SQL: dict[str, str] = {
    "seq_index": "SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS sequence_index FROM events",
    "band_pairs_positional": """WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT a.user_id, a.event_id AS a, b.event_id AS b, CAST(b.n - a.n AS INTEGER) AS gap FROM p a JOIN p b ON a.user_id = b.user_id AND b.n > a.n AND b.n <= a.n + 3""",
    "band_pairs_sparse": "SELECT a.source, a.doc_id AS a, b.doc_id AS b, b.doc_id - a.doc_id AS gap FROM documents a JOIN documents b ON a.source = b.source AND b.doc_id > a.doc_id AND b.doc_id <= a.doc_id + 40",
    "pair_metrics": """WITH w AS (SELECT doc_id, source, list_distinct(string_split(lower(text), ' ')) AS w, length(text) AS n,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), j AS (
  SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.w, b.w)) AS x, len(a.w) AS wa, len(b.w) AS wb, a.n AS na, b.n AS nb
  FROM w a JOIN w b ON a.source = b.source AND b.i = a.i + 1)
SELECT a, b, round(x / nullif(wa + wb - x, 0), 6) AS jaccard, round(least(na, nb) / nullif(greatest(na, nb), 0), 6) AS length_ratio FROM j""",
    "image_inventory": f"WITH images AS ({IMAGES_SQL}) SELECT sequence_id, count(*) AS images, min(image_id) AS first_id, max(image_id) AS last_id FROM images GROUP BY 1",
    "decision_ladder": _FINAL + """ SELECT first_image_id, second_image_id, same_document, branch, reason, hard_contradiction,
  same_document AND NOT hard_contradiction AS automatic_link_eligible, round(confidence, 6) AS confidence FROM final""",
    "near_duplicate_flag": _FINAL + " SELECT first_image_id, second_image_id FROM final WHERE near_dup",
    "safety_reason": "WITH " + _RULES.replace("{safety}", _safety("CASE WHEN first_image_id % 2 = 0 THEN 'physical_occlusion' ELSE 'near_duplicate' END"))
    + " SELECT first_image_id, second_image_id, safety AS safety_reason FROM final",
    "evidence_ramps": _FINAL + f" SELECT first_image_id, second_image_id, round({_EVIDENCE}, 6) AS evidence, round({_IDENTITY}, 6) AS identity_support FROM final",
    "logistic_probability": _FINAL + f""", q AS (
  SELECT *, {_logit(0)} AS ps, {_logit(1)} AS po, ({_EVIDENCE}) * ({_IDENTITY}) AS ev FROM final
) SELECT first_image_id, second_image_id, round(ps, 6) AS same_document_probability, round(po, 6) AS raw_occluded_given_same_probability,
  round(ps * (po * ev), 6) AS same_occluded_probability, round(ps * (1 - po * ev), 6) AS same_clean_probability,
  ps * (po * ev) >= 0.04 OR erased
  OR (ps >= 0.90 AND occlusion_candidate_count = 1 AND ev >= 0.75 AND occlusion_ink_mismatch_capture >= 0.90 AND inside_unmatched_ink_union_fraction >= 0.25
      AND outside_unmatched_ink_union_fraction <= 0.03 AND outside_ink_mismatch_tiles_fraction <= 0.10 AND occlusion_material_median >= 0.02)
  OR (ps >= 0.95 AND NOT registration_fallback_used AND feature_overlap >= 0.45 AND occlusion_candidate_count BETWEEN 1 AND 2 AND occlusion_area_fraction >= 0.25
      AND occlusion_residual_capture >= 0.80 AND occlusion_material_median >= 0.01 AND outside_unmatched_ink_union_fraction <= 0.01
      AND outside_ink_mismatch_tiles_fraction <= 0.05 AND inside_unmatched_ink_union_fraction <= 0.05 AND occlusion_localization_contrast <= 0.05) AS occlusion_candidate_flag
FROM q""",
    "representative": _LINKED + _QUARTERS + """, degree AS (
  SELECT node, sum(confidence) AS d FROM (
    SELECT first_image_id AS node, second_image_id AS other, confidence FROM linked WHERE same_document
    UNION ALL SELECT second_image_id, first_image_id, confidence FROM linked WHERE same_document)
  JOIN member a ON a.image_id = node JOIN member b ON b.image_id = other WHERE a.i // 4 = b.i // 4 GROUP BY 1
), best AS (
  SELECT sequence_id, i // 4 AS root, image_id, row_number() OVER (PARTITION BY sequence_id, i // 4 ORDER BY coalesce(d, 0) DESC, i) AS r
  FROM member LEFT JOIN degree ON node = image_id
) SELECT sequence_id, root, image_id AS representative FROM best WHERE r = 1""",
    "unconstrained_components": """SELECT coalesce(lang, '') AS sequence_id, doc_id AS image_id, min(doc_id) OVER (PARTITION BY coalesce(lang, ''), text) AS root
FROM documents WHERE text IS NOT NULL""",
    "symmetric_neighbours": _LINKED + " SELECT node, string_agg(other, ',' ORDER BY other) AS neighbours FROM both_ways GROUP BY 1",
    "review_tiers": _TIERED + """ SELECT first_image_id, second_image_id, CAST(review_tier AS INTEGER) AS review_tier, common, same_component, acceptance_conflict,
  row_number() OVER (ORDER BY review_tier, so DESC, index_gap, first_image_id, second_image_id) AS review_rank FROM tiers""",
    "candidate_summary": _TIERED + """ SELECT CAST(review_tier AS INTEGER) AS review_tier, count(*) AS pairs, count(*) FILTER (acceptance_conflict) AS conflicts,
  count(*) FILTER (hard_contradiction) AS contradictions, count(*) FILTER (common > 0) AS with_common_neighbour, count(*) FILTER (registration_fallback_used) AS by_fallback
FROM tiers GROUP BY GROUPING SETS ((review_tier), ())""",
    "cluster_confidence_stats": _FINAL + """ SELECT sequence_id, count(*) AS pairs, round(min(confidence), 6) AS min_confidence, round(avg(confidence), 6) AS mean_confidence,
  round(max(confidence), 6) AS max_confidence, max(index_gap) AS largest_gap, count(*) FILTER (same_document) AS accepted FROM final GROUP BY 1""",
    "run_counts": _FINAL + """ SELECT (SELECT count(DISTINCT sequence_id) FROM images) AS sequences, (SELECT count(*) FROM images) AS images, count(*) AS pairs,
  count(*) FILTER (same_document) AS accepted_pairs, (SELECT count(DISTINCT sequence_id) FROM images) AS clusters,
  (SELECT count(*) FROM (SELECT 1 FROM images GROUP BY sequence_id HAVING count(*) > 1)) AS multi_image_clusters FROM final""",
    "failure_categories": _FINAL + """ SELECT first_image_id, second_image_id, CASE WHEN registration_model IS NULL THEN 'candidate_generation'
  WHEN regexp_matches(lower(reason), 'registration|overlap|match') THEN 'registration' WHEN regexp_matches(lower(reason), 'transform|reprojection') THEN 'transform_quality'
  WHEN regexp_matches(lower(reason), 'visibility|mask') THEN 'visibility_or_occlusion_localization' WHEN regexp_matches(lower(reason), 'outside|exterior') THEN 'exterior_agreement'
  WHEN hard_contradiction AND first_image_id % 2 = 1 THEN 'incorrect_contradiction' ELSE 'graph_bridge_behavior' END AS failure_category FROM final""",
    "reliability_ece": _BINNED + f" SELECT bin, count, round(mean_probability, 6) AS mean_probability, round(observed_rate, 6) AS observed_rate, round(absolute_gap, 6) AS absolute_gap FROM ({_TABLE})",
    "logloss_brier": _BINNED + f""" SELECT count(*) AS count, round(avg(-(truth * ln(least(greatest(p, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)) + (1 - truth) * ln(1 - least(greatest(p, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)))), 6) AS log_loss,
  round(avg((p - truth) * (p - truth)), 6) AS brier_score, round((SELECT sum(count * absolute_gap) / sum(count) FROM ({_TABLE})), 6) AS expected_calibration_error FROM binned""",
    "metrics_by_split": _RATES + """ SELECT split, count(*) AS pairs, round(count(*) FILTER (yes AND joined) / nullif(count(*) FILTER (yes), 0), 6) AS connected_recall,
  round(count(*) FILTER (yes AND flag) / nullif(count(*) FILTER (yes), 0), 6) AS candidate_recall, round(count(*) FILTER (yes AND flag) / nullif(count(*) FILTER (flag), 0), 6) AS candidate_precision,
  round(count(*) FILTER (yes AND edge) / nullif(count(*) FILTER (yes), 0), 6) AS automatic_recall, round(count(*) FILTER (yes AND edge) / nullif(count(*) FILTER (edge), 0), 6) AS automatic_precision,
  round(count(*) FILTER (NOT yes AND edge) / nullif(count(*) FILTER (NOT yes), 0), 6) AS false_link_rate, count(*) FILTER (NOT yes AND edge) = 0 AS no_false_links
FROM f GROUP BY GROUPING SETS ((split), ())""",
    "group_statuses": _GROUPED + " SELECT original_cluster_id, review_decision, predicted_component_count, cluster_size, group_status FROM stated",
    "group_metrics": _GROUPED + """ SELECT split, count(*) AS groups, round(count(*) FILTER (group_status = 'recovered') / nullif(count(*) FILTER (review_decision = 'accepted'), 0), 6) AS accepted_recovery,
  round(count(*) FILTER (group_status = 'separated') / nullif(count(*) FILTER (review_decision = 'rejected'), 0), 6) AS rejected_separation, count(*) FILTER (group_status = 'contaminated') AS contaminated,
  round(coalesce(sum(cluster_size) FILTER (group_status = 'contaminated'), 0) / nullif(sum(cluster_size) FILTER (review_decision = 'rejected'), 0), 6) AS image_contamination
FROM stated GROUP BY GROUPING SETS ((split), ())""",
    "size_distribution": "SELECT n AS size, count(*) AS groups FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY n",
    "review_budget_curve": f"""WITH {LABELS_SQL}, o AS (SELECT truth, row_number() OVER (ORDER BY p DESC, doc_id) AS r FROM scored),
t AS (SELECT count(*) AS n, sum(truth) AS pos FROM o), s AS (SELECT unnest([0, 1, 2, 5, 10, 20, 25, 50, 100]) / 100.0::DOUBLE AS f),
b AS (SELECT f, least(n, ceil(n * f))::BIGINT AS k, pos FROM s, t), g AS (SELECT f, k, pos, coalesce(sum(truth), 0)::BIGINT AS got FROM b LEFT JOIN o ON r <= k GROUP BY ALL)
SELECT f AS review_fraction, k AS review_pairs, got AS positive_pairs_caught, round(got / nullif(pos, 0), 6) AS recall, round(got / nullif(k, 0), 6) AS precision FROM g""",
    "isotonic_apply": f"""WITH {LABELS_SQL}, k AS (SELECT doc_id, CASE WHEN p <= 0.1 THEN 0.05 WHEN p >= 0.9 THEN 0.95 WHEN p <= 0.3 THEN 0.05 + (p - 0.1) / 0.2 * 0.25
  WHEN p <= 0.6 THEN 0.4 + (p - 0.3) / 0.3 * 0.1 ELSE 0.5 + (p - 0.6) / 0.3 * 0.45 END::DOUBLE AS s, index_gap / 4.0::DOUBLE AS q FROM scored)
SELECT doc_id, round(s, 9) AS same_document_probability, round(s * (1 - q), 9) AS same_clean_probability, round(s * q, 9) AS same_occluded_probability FROM k""",
    "threshold_search": f"""WITH {LABELS_SQL}, t AS (SELECT DISTINCT p AS threshold FROM scored), g AS (
  SELECT threshold, count(*) FILTER (p >= threshold) AS k, sum(truth) FILTER (p >= threshold) AS hit, count(*) AS n, sum(truth) AS pos FROM t, scored GROUP BY 1)
SELECT threshold, round(hit / pos, 6) AS recall, round(hit / k, 6) AS precision, round(k / n, 6) AS review_fraction FROM g WHERE k / n <= 0.5 + 1e-12
ORDER BY hit / pos DESC, hit / k DESC, k / n, threshold DESC LIMIT 1""",
    "leakage_check": "SELECT source, count(DISTINCT doc_id % 3) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1",
    "truth_left_prediction": f"""WITH {LABELS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) AS i FROM scored), t AS (
  SELECT a.doc_id AS image_a, b.doc_id AS image_b, CASE WHEN a.truth = b.truth THEN 'accepted' ELSE 'rejected' END AS truth, a.doc_id % 3 > 0 AS present,
    a.p >= 0.5 AND NOT a.contradiction AS e, b.p >= 0.4 AS f, a.doc_id // 64 = b.doc_id // 64 AS same FROM o a JOIN o b ON a.doc_id % 16 = b.doc_id % 16 AND b.i = a.i + 1)
SELECT image_a, image_b, truth, CASE WHEN truth = 'accepted' THEN CASE WHEN present AND e THEN 'deterministically_linked' WHEN same THEN 'transitively_connected'
    WHEN present AND f THEN 'review_only' ELSE 'missed_entirely' END ELSE CASE WHEN present AND e THEN 'automatic_false_link' WHEN same THEN 'contaminated_component'
    WHEN present AND f THEN 'candidate_only' ELSE 'correctly_separated' END END AS pair_status,
  present AND e AS automatic_edge, present AND f AS candidate_flag, same AS same_component, present AS prediction_present,
  CASE WHEN present THEN 'compared' ELSE 'pair_not_compared' END AS reason FROM t""",
    "replay_grid": f"""WITH {LABELS_SQL}, g AS (SELECT * FROM (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS threshold), (SELECT unnest([NULL, 2])::INTEGER AS max_gap), (SELECT unnest([NULL, 0.25])::DOUBLE AS min_alignment)),
e AS (SELECT g.*, truth = 1 AS y, p >= 0.2 AND NOT contradiction AND p >= threshold AND (max_gap IS NULL OR index_gap <= max_gap)
  AND (min_alignment IS NULL OR coalesce(registration_alignment_score >= min_alignment, false)) AS edge FROM g, scored)
SELECT threshold, max_gap, min_alignment, count(*) FILTER (edge AND y) AS tp, count(*) FILTER (edge AND NOT y) AS fp, count(*) FILTER (NOT edge AND y) AS fn,
  count(*) FILTER (NOT edge AND NOT y) AS tn FROM e GROUP BY 1, 2, 3""",
    "replay_groups": _REPLAY + " SELECT * FROM judged",
    "replay_best": _REPLAY + """ SELECT * FROM judged ORDER BY zero_false_links DESC, CASE WHEN zero_false_links THEN accepted_groups_recovered ELSE -automatic_edge_fp END DESC,
  CASE WHEN zero_false_links THEN positive_pairs_connected ELSE -negative_pairs_connected END DESC, CASE WHEN zero_false_links THEN automatic_edge_tp ELSE 0 END DESC,
  automatic_edge_fp, negative_pairs_connected, max_gap IS NULL DESC, min_alignment IS NULL DESC, threshold DESC LIMIT 1""",
    "metric_comparison": """WITH e AS (SELECT o_orderstatus AS metric, avg(o_totalprice) FILTER (o_orderkey % 2 = 0) AS b, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) AS a FROM orders GROUP BY 1)
SELECT metric, round(b, 3) AS before, round(a, 3) AS after, round(a - b, 3) AS delta FROM e""",
    "manifest_contract": """WITH m AS (SELECT doc_id, doc_id // 3 AS g FROM labels WHERE quality IS NOT NULL), a AS (
  SELECT count(*) AS rows, count(DISTINCT g) AS groups, count(DISTINCT g) FILTER (g % 3 <> 0) AS accepted, count(DISTINCT g) FILTER (g % 3 = 0) AS rejected,
    max(doc_id) - min(doc_id) + 1 - count(DISTINCT doc_id) AS gaps FROM m)
SELECT * FROM (SELECT 'gaps' AS check, 0::BIGINT AS expected, gaps::BIGINT AS actual FROM a UNION ALL SELECT 'rows', 1, rows FROM a UNION ALL SELECT 'groups', 2, groups FROM a
  UNION ALL SELECT 'accepted', 3, accepted FROM a UNION ALL SELECT 'rejected', 4, rejected FROM a) WHERE expected <> actual""",
    "consensus_field": """WITH v AS (SELECT p_brand, trim(regexp_replace(lower(string_split(p_type, ' ')[-1]), '[^a-z0-9]+', ' ', 'g')) AS value, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f) AS k FROM v WHERE value <> '') SELECT p_brand, value, n FROM r WHERE k = 1""",
    "field_containment": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_partkey % 8 ORDER BY p_partkey) AS i FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b, round((CASE WHEN a.p_brand = b.p_brand THEN 2.25 ELSE 0 END + CASE WHEN a.p_type = b.p_type THEN 1.5 ELSE 0 END
  + CASE WHEN a.p_size = b.p_size THEN 0.55 ELSE 0 END)::DOUBLE / 4.3, 6) AS containment FROM p a JOIN p b ON a.p_partkey % 8 = b.p_partkey % 8 AND b.i BETWEEN a.i + 1 AND a.i + 2""",
    "field_mass": _PERSON + """ SELECT image_id, round(mass, 6)::DOUBLE AS mass, round(least(1.0, greatest(0.0, 0.58 * (1 - exp(-mass / 12.0)) + 0.17 * (1 - exp(-n / 3.0)) + 0.25 * 0.5
  - 0.45 * risk)), 6)::DOUBLE AS completeness FROM c1""",
    "merged_runs": _PERSON + " SELECT image_id, 2::BIGINT AS run_count, 'run-1,run-2' AS sources, CAST(n AS INTEGER) AS records, round(risk, 6) AS risk FROM c1",
    "embedding_cosine_band": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM e a JOIN e b ON a.label = b.label AND b.i BETWEEN a.i + 1 AND a.i + 2""",
    "gaps_and_islands": """WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
s AS (SELECT user_id, i, coalesce(i - lag(i) OVER (PARTITION BY user_id ORDER BY i) > 2, false)::INT AS new FROM p WHERE value > 50),
r AS (SELECT user_id, i, sum(new) OVER (PARTITION BY user_id ORDER BY i) AS run FROM s)
SELECT user_id, CAST(min(i) AS INTEGER) AS first, CAST(max(i) AS INTEGER) AS last, count(*) AS n FROM r GROUP BY user_id, run""",
    "weighted_quantile": """WITH v AS (SELECT l_returnflag, l_quantity::BIGINT AS q, sum(round(l_extendedprice * 100)::BIGINT) AS w FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY q) AS c, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM v)
SELECT l_returnflag, min(q) AS quantile FROM r WHERE c >= 0.9 * t GROUP BY 1""",
    "robust_tiles": """WITH t AS (SELECT l_suppkey % 24 AS "column", l_partkey % 180 AS row, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2),
m AS (SELECT "column", median(score) AS m FROM t GROUP BY 1), d AS (SELECT t.*, m, abs(score - m) AS d FROM t JOIN m USING ("column")),
k AS (SELECT "column", median(d) AS k FROM d GROUP BY 1) SELECT "column", row, score, round((score - m) / greatest(1.4826 * k, 1e-9), 4) AS z FROM d JOIN k USING ("column")""",
    "top_residual_tiles": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem)
SELECT l_orderkey, l_returnflag, l_linenumber, l_extendedprice FROM r WHERE k = 1""",
    "bbox_iou": f"WITH {_BOX.format(k='l_partkey')}, o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM boxes), j AS ("
    """SELECT a.l_orderkey, a.l_partkey AS a, b.l_partkey AS b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS x,
  (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s, (greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)) AS h
  FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND b.i = a.i + 1)
SELECT l_orderkey, a, b, round(x / (s - x), 6) AS iou, h AS hull_area FROM j""",
    "page_completeness": "SELECT CASE WHEN l_discount * 10 - 0.2::DOUBLE <= 0.025 THEN 'complete' WHEN l_discount * 10 - 0.2::DOUBLE <= 0.55 THEN 'partial_best_available' END AS completeness, count(*) AS n FROM lineitem GROUP BY 1",
    "review_states": _REVIEW + """ SELECT cluster_id, image_count, CASE WHEN status IN ('dissolved', 'irregular') THEN 0 ELSE kept END AS kept_image_count, status,
  status = 'dissolved' AS dissolved, status <> 'unreviewed' AS reviewed FROM state""",
    "review_progress": _REVIEW + """ SELECT count(*) AS clusters, count(*) FILTER (status <> 'unreviewed') AS reviewed, count(*) FILTER (status = 'approved') AS approved,
  count(*) FILTER (status = 'edited') AS edited, count(*) FILTER (status = 'dissolved') AS dissolved, count(*) FILTER (status = 'irregular') AS irregular FROM state""",
    "corrected_exports": _REVIEW + """, r AS (
  SELECT cluster_id, status, unnest(images) AS image_id, status <> 'dissolved' AND NOT list_contains(gone, unnest(images)) AS stays FROM state WHERE status <> 'irregular')
SELECT cluster_id::VARCHAR AS cluster_id, cluster_id AS origin_cluster_id, string_agg(image_id, ',' ORDER BY image_id) AS image_ids, status FROM r WHERE stays GROUP BY cluster_id, status
UNION ALL SELECT format('{}__separated_{:05d}', cluster_id, row_number() OVER (ORDER BY cluster_id, image_id)), cluster_id, image_id::VARCHAR, status FROM r WHERE NOT stays""",
    "label_upsert_delete": """WITH t AS (SELECT conv_id AS case_id, turn, min(row(role, length(text))) AS v FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
l AS (SELECT case_id, max(turn) AS turn FROM t GROUP BY 1) SELECT case_id, v[1] AS role, v[2]::INTEGER AS n FROM t JOIN l USING (case_id, turn) WHERE turn = 0 OR turn % 5 <> 4""",
    "source_set_difference": """SELECT DISTINCT doc_id, 'unlabelled' AS side FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT DISTINCT doc_id, 'unknown' FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)""",
    "json_flatten": "SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events",
    "inventory_counts": "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS n, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1",
    "signature_hash": """SELECT o_orderkey, sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)) AS signature,
  substr(sha1(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)), 1, 10) AS short FROM orders""",
    "library_resolution": """WITH f AS (SELECT '/' || coalesce(source, 'none') || '/d' || (doc_id % 400) || '(1).jpg' AS path, 'd' || (doc_id % 400) || '.jpg' AS name, coalesce(lang, '') AS h FROM documents),
g AS (SELECT name, min(path) AS path, count(DISTINCT h) AS kinds, count(*) AS n FROM f GROUP BY 1), w AS (SELECT DISTINCT 'd' || (doc_id % 450) || '.jpg' AS name FROM documents)
SELECT w.name, path, CASE WHEN n IS NULL THEN 'missing' WHEN kinds > 1 THEN 'conflict' WHEN n > 1 THEN 'duplicate_same' ELSE 'found' END AS status FROM w LEFT JOIN g ON w.name = g.name""",
    "canonical_names": r"""WITH n AS (SELECT page_id, string_split(url || '-' || page_id, '/')[-1] AS s FROM pages)
SELECT page_id, s AS image_id, nullif(regexp_extract(s, '^(.+)-(\d+)$', 1), '') AS series, TRY_CAST(nullif(regexp_extract(s, '^(.+)-(\d+)$', 2), '') AS BIGINT) AS position FROM n""",
    "greedy_iou_match": f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, x0, y0, x1, y1) AS i FROM ({_box('l_partkey')})),
a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, x0, y0, x1, y1) AS j FROM ({_box('l_suppkey')})),
common AS (
  SELECT e.k, i, j, e.n AS en, a.n AS an, greatest(0, least(e.x1, a.x1) - greatest(e.x0, a.x0)) * greatest(0, least(e.y1, a.y1) - greatest(e.y0, a.y0)) AS shared,
    (e.x1 - e.x0) * (e.y1 - e.y0) + (a.x1 - a.x0) * (a.y1 - a.y0) AS sum FROM e JOIN a ON e.k = a.k
), v AS (SELECT *, shared / CAST(sum - shared AS DOUBLE) AS iou FROM common
), best AS (SELECT k, i, list(j ORDER BY iou DESC, j) AS js FROM v GROUP BY k, i
), taken AS (
  SELECT k, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(0 AS BIGINT) AS j FROM (SELECT DISTINCT k FROM e)
  UNION ALL
  SELECT t.k, b.i, list_append(used, list_filter(js, lambda x: NOT list_contains(used, x))[1]), list_filter(js, lambda x: NOT list_contains(used, x))[1]
  FROM taken t JOIN best b ON b.k = t.k AND b.i = t.i + 1
)
SELECT v.k AS l_orderkey, en AS expected_n, an AS actual_n, round(iou, 6) AS iou FROM taken t JOIN v ON v.k = t.k AND v.i = t.i AND v.j = t.j""",
    "merged_candidates": f"""WITH RECURSIVE c AS (
  SELECT k AS group_id, CAST(n % 2 AS VARCHAR) AS side, x0, y0, x1, y1, price AS confidence,
    row_number() OVER (PARTITION BY k ORDER BY price DESC, CAST(n % 2 AS VARCHAR), x0, y0, x1, y1) AS i FROM ({_box('l_suppkey')})
), clash AS (
  SELECT a.group_id, a.i, list(b.i) AS js FROM c a JOIN c b ON a.group_id = b.group_id AND a.side = b.side AND b.i < a.i
  WHERE greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))
    / CAST(least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS DOUBLE) >= 0.55 GROUP BY 1, 2
), told AS (SELECT c.group_id, c.i, coalesce(js, CAST([] AS BIGINT[])) AS js FROM c LEFT JOIN clash USING (group_id, i)
), seen AS (
  SELECT group_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept, false AS keep FROM (SELECT DISTINCT group_id FROM c)
  UNION ALL
  SELECT s.group_id, t.i, CASE WHEN list_has_any(kept, js) THEN kept ELSE list_append(kept, t.i) END, NOT list_has_any(kept, js) FROM seen s JOIN told t ON t.group_id = s.group_id AND t.i = s.i + 1
)
SELECT c.group_id, side, x0, y0, x1, y1, confidence FROM seen JOIN c USING (group_id, i) WHERE keep""",
} | checks.SQL
