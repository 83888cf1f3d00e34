"""Relational queries of the funnel: joins, aggregates, windows, sorting, set operations.

They are plain SQL that both Catalyst and the checking engine read, over the funnel's views. Correlated
subqueries are written as pre-aggregates and joins, semi and anti joins as such, loops over ranks as windows.
"""

from __future__ import annotations

import re

from loomrank.sources.adapters import NOW

HOUR, DAY = "CAST(3600000 AS BIGINT)", "CAST(86400000 AS BIGINT)"

SQL: dict[str, str] = {
    # scans and filters
    "src1_filtered_scan": "SELECT item_id, source_id, title FROM items WHERE status = 'new'",
    "src16_watermark_pull": "SELECT open_id, item_id, opened_at FROM opens WHERE opened_at > 1704100000000 ORDER BY opened_at, open_id LIMIT 5000",
    "src11_persist_caps": f"""
        SELECT item_id, source_id, least(first_seen_at, {NOW} + 2 * {DAY}) AS first_seen_at, twin FROM (
          SELECT i.*, row_number() OVER (PARTITION BY source_id ORDER BY first_seen_at DESC, item_id) AS rn,
                 row_number() OVER (PARTITION BY title ORDER BY first_seen_at, item_id) > 1 AS twin
          FROM items i WHERE publication_time IS NULL OR publication_time >= {NOW} - 14 * {DAY}) t WHERE rn <= 25""",
    "src12_backoff": """
        SELECT source_id, failures, least(24e0, power(2e0, least(failures, 5))) AS permanent_h, least(12e0, 0.5e0 * power(2e0, least(failures, 5))) AS transient_h
        FROM (SELECT source_id, n % 8 AS failures FROM sources) s""",
    "src8_podcast_sources": """
        SELECT source_id, count(*) AS n, 2 * sum(CASE WHEN item_id % 4 < 2 AND language = 'en' THEN 1 ELSE 0 END) > count(*) AS is_podcast
        FROM items GROUP BY source_id""",
    "src9_discovery_signal": f"""
        SELECT item_id, points, comments, round(points / power(age_h + 2, 0.72e0), 6) AS velocity,
               round(least(1e0, greatest(0e0, 0.35e0 + points / power(age_h + 2, 0.72e0) / 35e0 + least(comments / 300e0, 0.2e0))), 6) AS signal
        FROM (SELECT item_id, item_id % 500 AS points, item_id % 130 AS comments, ({NOW} - first_seen_at) / (1e0 * {HOUR}) + 1 AS age_h FROM items) d
        WHERE points >= 20 AND comments >= 5 AND age_h <= 300
        ORDER BY 5 DESC, item_id LIMIT 50""",
    "src13_config_mirror": """
        SELECT coalesce(s.source_id, o.source_id) AS source_id, coalesce(s.quality_prior, o.quality_prior) AS quality_prior, o.learned
        FROM sources s FULL OUTER JOIN (SELECT source_id, quality_prior, n * 0.01e0 AS learned FROM sources WHERE n < 12) o ON o.source_id = s.source_id""",
    "f18_status_sets": "SELECT status, count(*) AS n FROM items WHERE status IN ('triaged', 'published') AND status NOT IN ('rejected_rules') GROUP BY status",
    "f10_optional_filters": "SELECT item_id, status, source_id FROM items WHERE status = 'triaged' AND source_id = 'src3' AND publication_time IS NOT NULL",
    "f11_in_list": "SELECT item_id, minutes FROM published WHERE item_id IN (8, 18, 28, 38, 48, 99, 109)",
    "f14_reservation": """
        SELECT item_id, category, free_score, (category IN ('ai_product', 'games') AND free_score >= 0.6e0 AND spent < 0.9e0) AS reserved
        FROM (SELECT i.*, item_id % 10 / 1e1 AS spent FROM items i) t""",
    "f15_interest_expiry": f"""
        SELECT item_id, horizon, CASE horizon WHEN 'short' THEN created + 14 * {DAY} WHEN 'medium' THEN created + 60 * {DAY} WHEN 'long' THEN created + 180 * {DAY} ELSE -1 END AS expires_at,
               coalesce(CASE horizon WHEN 'short' THEN created + 14 * {DAY} WHEN 'medium' THEN created + 60 * {DAY} WHEN 'long' THEN created + 180 * {DAY} END < {NOW}, false) AS expired
        FROM (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' WHEN 2 THEN 'long' ELSE 'forever' END AS horizon, first_seen_at - (item_id % 200) * {DAY} AS created FROM items) t""",
    "f16_exploratory": "SELECT item_id, (anchor_distance >= 0.55e0 AND novelty >= 0.55e0) OR item_id % 6 = 5 AS exploratory FROM deep",
    "f19_discovery_domains": "SELECT source_id, count(*) AS n FROM items GROUP BY source_id HAVING count(*) >= 2 AND max(CASE WHEN item_id % 4 = 3 THEN 1 ELSE 0 END) = 1",
    # joins
    "j1_left_join_prefiltered": "SELECT i.item_id, coalesce(v.label, -1) AS label FROM items i LEFT JOIN (SELECT item_id, label FROM vectors WHERE label < 5) v ON v.item_id = i.item_id WHERE i.status = 'triaged'",
    "j2_inner_chain": """
        SELECT d.item_id, i.source_id, s.feed_type, d.expected_attention_value FROM deep d JOIN items i ON i.item_id = d.item_id
        JOIN sources s ON s.source_id = i.source_id WHERE d.ragebait < 0.5e0""",
    "j3_multi_left_defaults": """
        SELECT i.item_id, coalesce(c.action, 'UNCERTAIN') AS action, coalesce(c.triage_score, 0e0) AS triage_score, coalesce(d.novelty, 0.5e0) AS novelty,
               coalesce(s.quality_prior, 0.55e0) AS quality_prior, coalesce(p.feed, '-') AS feed
        FROM items i LEFT JOIN cheap c ON c.item_id = i.item_id LEFT JOIN deep d ON d.item_id = i.item_id
        LEFT JOIN sources s ON s.source_id = i.source_id LEFT JOIN published p ON p.item_id = i.item_id""",
    "j4_compound_key": """
        SELECT a.item_id, a.cluster_id, b.free_score FROM items a LEFT JOIN (SELECT item_id, cluster_id, free_score FROM items WHERE item_id % 2 = 0) b
        ON b.item_id = a.item_id AND b.cluster_id = a.cluster_id""",
    "j5_anti_join": "SELECT d.item_id FROM deep d WHERE NOT EXISTS (SELECT 1 FROM published p WHERE p.item_id = d.item_id)",
    "j6_semi_anti": """
        SELECT i.item_id FROM items i WHERE EXISTS (SELECT 1 FROM published p WHERE p.item_id = i.item_id)
        AND NOT EXISTS (SELECT 1 FROM feedback f WHERE f.item_id = i.item_id)""",
    "j7_existence_flag": """
        SELECT i.item_id, CASE WHEN o.item_id IS NULL THEN 0 ELSE 1 END AS opened FROM items i
        LEFT JOIN (SELECT DISTINCT item_id FROM opens) o ON o.item_id = i.item_id""",
    "j8_shared_clusters": """
        SELECT source_id, count(*) AS items, CAST(sum(CASE WHEN lo <> hi THEN 1 ELSE 0 END) AS BIGINT) AS shared
        FROM (SELECT source_id, min(source_id) OVER (PARTITION BY cluster_id) AS lo, max(source_id) OVER (PARTITION BY cluster_id) AS hi FROM items) t GROUP BY source_id""",
    "j9_source_pairs": """
        SELECT a.source_id AS source_a, b.source_id AS source_b, count(DISTINCT a.cluster_id) AS shared FROM
        (SELECT DISTINCT cluster_id, source_id FROM items) a JOIN (SELECT DISTINCT cluster_id, source_id FROM items) b
        ON b.cluster_id = a.cluster_id AND a.source_id < b.source_id GROUP BY a.source_id, b.source_id""",
    "j10_pair_split": """
        SELECT CAST(sum(n * (n - 1) / 2) AS BIGINT) AS pairs, CAST(sum(same) AS BIGINT) AS same_source, CAST(sum(n * (n - 1) / 2) - sum(same) AS BIGINT) AS cross_source
        FROM (SELECT cluster_id, sum(m) AS n, sum(m * (m - 1) / 2) AS same FROM (SELECT cluster_id, source_id, count(*) AS m FROM items GROUP BY cluster_id, source_id) g GROUP BY cluster_id) t""",
    "j11_cross_source_items": "SELECT count(*) AS n FROM (SELECT item_id, min(source_id) OVER (PARTITION BY cluster_id) AS lo, max(source_id) OVER (PARTITION BY cluster_id) AS hi FROM items) t WHERE lo <> hi",
    "j17_candidates_by_feed": """
        SELECT d.item_id, f.feed, round(d.expected_attention_value * f.w, 6) AS score FROM deep d
        CROSS JOIN (SELECT 'essential' AS feed, 1.0e0 AS w UNION ALL SELECT 'games', 0.6e0 UNION ALL SELECT 'culture', 0.8e0) f WHERE d.ragebait < 0.35e0""",
    "j18_scalar_preaggregates": """
        SELECT s.source_id, coalesce(i.n, 0) AS items, coalesce(p.n, 0) AS published, coalesce(o.n, 0) AS opens, round(coalesce(d.eav, 0e0), 6) AS mean_value
        FROM sources s
        LEFT JOIN (SELECT source_id, count(*) AS n FROM items GROUP BY source_id) i ON i.source_id = s.source_id
        LEFT JOIN (SELECT source_id, count(*) AS n FROM published p JOIN items i ON i.item_id = p.item_id GROUP BY source_id) p ON p.source_id = s.source_id
        LEFT JOIN (SELECT source_id, count(*) AS n FROM opens o JOIN items i ON i.item_id = o.item_id GROUP BY source_id) o ON o.source_id = s.source_id
        LEFT JOIN (SELECT source_id, avg(expected_attention_value) AS eav FROM deep d JOIN items i ON i.item_id = d.item_id GROUP BY source_id) d ON d.source_id = s.source_id""",
    "j19_lookup_subquery": "SELECT p.item_id, p.feed, s.quality_prior FROM published p JOIN items i ON i.item_id = p.item_id LEFT JOIN sources s ON s.source_id = i.source_id",
    "j20_scalar_row": """
        SELECT a.items, b.published, c.opens, d.excellent FROM (SELECT count(*) AS items FROM items) a CROSS JOIN (SELECT count(*) AS published FROM published) b
        CROSS JOIN (SELECT count(*) AS opens FROM opens) c CROSS JOIN (SELECT count(*) AS excellent FROM feedback WHERE kind = 'excellent') d""",
    "j21_derived_distinct": "SELECT i.source_id, count(*) AS n FROM (SELECT DISTINCT item_id FROM published) p JOIN items i ON i.item_id = p.item_id GROUP BY i.source_id",
    "j22_siblings": """
        SELECT item_id, sibling, CAST(rn AS BIGINT) AS rn FROM (SELECT a.item_id, b.item_id AS sibling, row_number() OVER (PARTITION BY a.item_id ORDER BY b.free_score DESC, b.item_id) AS rn
        FROM items a JOIN items b ON b.cluster_id = a.cluster_id AND b.item_id <> a.item_id) t WHERE rn <= 6""",
    "j23_preference_match": """
        SELECT s.source_id, min_by(p.pref, p.ord) AS pref FROM sources s LEFT JOIN
        (SELECT 1 AS ord, 'src1' AS host, 'loved' AS pref UNION ALL SELECT 2, 'src7', 'liked' UNION ALL SELECT 3, '7', 'meh' UNION ALL SELECT 4, 'src12', 'muted') p
        ON s.source_id = p.host OR (length(p.host) = 1 AND substr(s.source_id, length(s.source_id)) = p.host) GROUP BY s.source_id""",
    "j24_in_flight_exclusion": """
        SELECT i.item_id FROM items i WHERE i.status = 'triaged' AND NOT EXISTS
        (SELECT 1 FROM usage_ledger u WHERE u.stage = 'deep' AND u.event_id % 1000 = i.item_id)""",
    # aggregates
    "a1_group_count": "SELECT status, count(*) AS n FROM items GROUP BY status",
    "a2_global_counts": "SELECT count(*) AS n, count(DISTINCT source_id) AS sources, count(DISTINCT cluster_id) AS clusters FROM items",
    "a3_conditional_sums": """
        SELECT boundary, count(*) AS samples, CAST(coalesce(sum(CASE WHEN audit_result = 'KEEP' THEN 1 ELSE 0 END), 0) AS BIGINT) AS keeps,
               CAST(coalesce(sum(CASE WHEN audit_result IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS pending FROM audits GROUP BY boundary""",
    "a4_ledger_rollup": "SELECT stage, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, round(coalesce(sum(cost), 0e0), 6) AS cost FROM usage_ledger GROUP BY stage",
    "a5_distinct_per_group": "SELECT source_id, count(DISTINCT cluster_id) AS clusters FROM items GROUP BY source_id",
    "a6_averages": "SELECT category, round(avg(free_score), 6) AS free_score, round(avg(content_chars), 4) AS chars FROM items GROUP BY category",
    "a7_min_max_band": """
        SELECT band, min(free_score) AS lo, max(free_score) AS hi, count(*) AS n FROM
        (SELECT free_score, CASE WHEN free_score >= 0.396e0 THEN 'A' WHEN free_score >= 0.299e0 THEN 'B' WHEN free_score >= 0.242e0 THEN 'C' ELSE 'D' END AS band FROM items) t GROUP BY band""",
    "a8_having": "SELECT cluster_id, count(*) AS n, min(title) AS topic FROM items GROUP BY cluster_id HAVING count(*) > 2 AND count(DISTINCT source_id) > 1",
    "a9_nested_aggregate": "SELECT CAST(sum(n - 1) AS BIGINT) AS extra FROM (SELECT title, count(*) AS n FROM items GROUP BY title HAVING count(*) > 1) t",
    "a10_max_per_group": """
        SELECT p.item_id, i.title, max(p.final_score) AS best FROM published p JOIN items i ON i.item_id = p.item_id GROUP BY p.item_id, i.title""",
    "a15_smoothing": """
        SELECT source_id, n, round((raw * n + 0.5e0 * 8) / (n + 8), 6) AS uniqueness FROM
        (SELECT source_id, count(*) AS n, avg(CASE WHEN lo = hi THEN 1e0 ELSE 0e0 END) AS raw FROM
         (SELECT source_id, min(source_id) OVER (PARTITION BY cluster_id) AS lo, max(source_id) OVER (PARTITION BY cluster_id) AS hi FROM items) t GROUP BY source_id) s""",
    "a16_learned_value": """
        SELECT i.source_id, count(*) AS events, round(greatest(-0.25e0, least(0.40e0, sum(CASE kind WHEN 'excellent' THEN 1e0 ELSE -1e0 END) / (count(*) + 12) * 0.5e0)), 6) AS learned
        FROM feedback f JOIN items i ON i.item_id = f.item_id GROUP BY i.source_id""",
    "a17_source_category_value": """
        SELECT i.source_id, i.category, count(*) AS n, CAST(sum(CASE WHEN p.item_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS published,
               round((sum(CASE WHEN p.item_id IS NOT NULL THEN 1e0 ELSE 0e0 END) + 4e0) / (count(*) + 8), 6) AS value
        FROM items i LEFT JOIN (SELECT DISTINCT item_id FROM published) p ON p.item_id = i.item_id GROUP BY i.source_id, i.category""",
    "a18_overlap": """
        SELECT ab.source_a, ab.source_b, ab.shared, round(least(1e0, ab.shared / (1e0 * least(a.n, b.n))), 6) AS overlap FROM
        (SELECT a.source_id AS source_a, b.source_id AS source_b, count(DISTINCT a.cluster_id) AS shared FROM (SELECT DISTINCT cluster_id, source_id FROM items) a
         JOIN (SELECT DISTINCT cluster_id, source_id FROM items) b ON b.cluster_id = a.cluster_id AND a.source_id < b.source_id GROUP BY a.source_id, b.source_id) ab
        JOIN (SELECT source_id, count(DISTINCT cluster_id) AS n FROM items GROUP BY source_id) a ON a.source_id = ab.source_a
        JOIN (SELECT source_id, count(DISTINCT cluster_id) AS n FROM items GROUP BY source_id) b ON b.source_id = ab.source_b""",
    "a19_size_distribution": """
        SELECT count(*) AS clusters, round(avg(n), 6) AS mean_size, max(n) AS max_size, round(sum(CASE WHEN n > 1 THEN 1e0 ELSE 0e0 END) / count(*), 6) AS multi_rate
        FROM (SELECT title, count(*) AS n FROM items GROUP BY title) t""",
    "a20_max_over_keys": """
        SELECT d.item_id, max(f.need) AS need FROM deep d JOIN (SELECT 0 AS k, 0.9e0 AS need UNION ALL SELECT 1, 0.4e0 UNION ALL SELECT 2, 0.7e0) f
        ON f.k = d.item_id % 3 OR f.k = d.item_id % 2 GROUP BY d.item_id""",
    "a21_scoped_evidence": """
        SELECT scope, k, CAST(count(*) AS BIGINT) AS events, CAST(sum(v) AS BIGINT) AS total FROM (
          SELECT 'source' AS scope, i.source_id AS k, CASE kind WHEN 'excellent' THEN 1 ELSE -1 END AS v FROM feedback f JOIN items i ON i.item_id = f.item_id UNION ALL
          SELECT 'category', i.category, CASE kind WHEN 'excellent' THEN 1 ELSE -1 END FROM feedback f JOIN items i ON i.item_id = f.item_id UNION ALL
          SELECT 'language', i.language, CASE kind WHEN 'excellent' THEN 1 ELSE -1 END FROM feedback f JOIN items i ON i.item_id = f.item_id) t GROUP BY scope, k""",
    "a22_reason_histogram": "SELECT CASE WHEN length(title) < 8 THEN 'short title' WHEN language <> 'en' THEN 'language' ELSE 'kept' END AS reason, count(*) AS n FROM items GROUP BY 1",
    "a23_daily_mean": f"""
        SELECT count(*) AS days, round(avg(n), 6) AS mean_items FROM (SELECT n, row_number() OVER (ORDER BY d DESC) AS rn FROM
        (SELECT floor(first_seen_at / (1e0 * {DAY})) AS d, count(*) AS n FROM items GROUP BY 1) t) u WHERE rn BETWEEN 2 AND 8""",
    "a24_month_by_stage": f"""
        SELECT round(sum(CASE WHEN stage = 'triage' THEN cost ELSE 0e0 END), 6) AS triage, round(sum(CASE WHEN stage IN ('deep', 'deep_batch') THEN cost ELSE 0e0 END), 6) AS deep,
               round(sum(cost), 6) AS total FROM usage_ledger WHERE created_at >= {NOW} - 30 * {DAY}""",
    "a25_threshold_sweep": """
        SELECT t, tp, fp, fn, round(tp / nullif(1e0 * (tp + fp), 0e0), 6) AS prec, round(tp / nullif(1e0 * (tp + fn), 0e0), 6) AS rec,
               round(2e0 * tp / nullif(2e0 * tp + fp + fn, 0e0), 6) AS f1 FROM (
          SELECT t, CAST(sum(CASE WHEN triage_score >= t AND p.item_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS tp,
                 CAST(sum(CASE WHEN triage_score >= t AND p.item_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS fp,
                 CAST(sum(CASE WHEN triage_score < t AND p.item_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS fn
          FROM cheap c LEFT JOIN published p ON p.item_id = c.item_id CROSS JOIN (SELECT 0.3e0 AS t UNION ALL SELECT 0.42e0 UNION ALL SELECT 0.52e0 UNION ALL SELECT 0.7e0) q GROUP BY t) s""",
    "a26_top_share": """
        SELECT source_id, n, round(n / (1e0 * total), 6) AS share FROM (SELECT source_id, count(*) AS n, sum(count(*)) OVER () AS total,
        row_number() OVER (ORDER BY count(*) DESC, source_id) AS rn FROM items GROUP BY source_id) t WHERE rn = 1""",
    "a27_weakest_categories": """
        SELECT c.category, coalesce(n, 0) AS n FROM (SELECT 'ai_product' AS category UNION ALL SELECT 'games' UNION ALL SELECT 'culture' UNION ALL SELECT 'travel') c
        LEFT JOIN (SELECT category, count(*) AS n FROM items WHERE status = 'published' GROUP BY category) i ON i.category = c.category ORDER BY n, category""",
    # windows
    "w2_best_in_cluster": "SELECT item_id, max(free_score) OVER (PARTITION BY cluster_id) > free_score AS redundant FROM items",
    "w4_capped_hash_sample": """
        SELECT item_id FROM items WHERE free_score < 0.299e0 AND ((item_id * 2654435761) % 100000) / 1e5 < 0.2e0 ORDER BY free_score DESC, item_id LIMIT 20""",
    "w5_cluster_cap": """
        SELECT item_id, q AND base + run <= 3 AS allowed FROM (SELECT item_id, q, base, sum(CASE WHEN q THEN 1 ELSE 0 END)
          OVER (PARTITION BY cluster_id ORDER BY free_score DESC, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (
          SELECT item_id, cluster_id, free_score, base, distinct_angle OR free_score >= 0.9e0 * best OR (rn = 1 AND base = 0) AS q FROM (
            SELECT item_id, cluster_id, free_score, item_id % 2 AS base, item_id % 7 = 0 AS distinct_angle, max(free_score) OVER (PARTITION BY cluster_id) AS best,
                   row_number() OVER (PARTITION BY cluster_id ORDER BY free_score DESC, item_id) AS rn FROM items) a) b) c""",
    "w6_cluster_best": "SELECT cluster_id, max(free_score) AS best, max_by(item_id, free_score * 1e6 - item_id * 1e-6) AS best_item FROM items GROUP BY cluster_id",
    "w8_best_per_type": """
        SELECT item_id, feed, final_score FROM (SELECT item_id % 100 AS item_id, feed, final_score, row_number() OVER (PARTITION BY item_id % 100, feed ORDER BY final_score DESC, item_id) AS rn FROM published) t WHERE rn = 1""",
    "w9_survival": """
        SELECT stage_no, n, round(n / nullif(1e0 * lag(n) OVER (ORDER BY stage_no), 0e0), 6) AS survival FROM (
        SELECT 1 AS stage_no, count(*) AS n FROM items UNION ALL SELECT 2, count(*) FROM cheap UNION ALL SELECT 3, count(*) FROM deep UNION ALL SELECT 4, count(*) FROM published) t""",
    "w10_first_title_wins": "SELECT item_id, row_number() OVER (PARTITION BY title ORDER BY first_seen_at, item_id) > 1 AS duplicate FROM items",
    "w11_latest_snapshot": "SELECT item_id, opened_at FROM (SELECT o.*, max(opened_at) OVER (PARTITION BY item_id) AS last FROM opens o) t WHERE opened_at = last",
    "w12_degradation_ladder": """
        SELECT d.day, round(d.frac, 6) AS frac, max_by(l.stage, l.trig) AS stage FROM (SELECT event_id % 20 AS day, sum(cost) / 3e0 AS frac FROM usage_ledger GROUP BY 1) d
        JOIN (SELECT 'normal' AS stage, 0e0 AS trig UNION ALL SELECT 'careful', 0.70e0 UNION ALL SELECT 'tight', 1.00e0 UNION ALL SELECT 'minimal', 1.35e0) l ON l.trig <= d.frac GROUP BY d.day, d.frac""",
    # sorting and top-k
    "s1_order_by_expression": "SELECT item_id, coalesce(publication_time, first_seen_at) AS t FROM items ORDER BY coalesce(publication_time, first_seen_at) DESC, item_id LIMIT 100",
    "s2_top_k": "SELECT item_id, expected_attention_value FROM deep ORDER BY expected_attention_value DESC, item_id LIMIT 25",
    "s3_nulls_last_top_k": "SELECT item_id, would_have_published, audit_score FROM audits ORDER BY would_have_published DESC NULLS LAST, audit_score DESC, item_id LIMIT 15",
    "s4_multi_key": "SELECT item_id, feed, published_at FROM published WHERE feed = 'games' ORDER BY published_at DESC, final_score DESC, item_id LIMIT 60",
    "s5_deterministic_shuffle": "SELECT item_id FROM items ORDER BY (item_id * 2654435761) % 100000, item_id LIMIT 40",
    "s7_share_limited_backfill": "SELECT item_id FROM deep WHERE item_id % 3 = 0 ORDER BY expected_attention_value DESC, item_id LIMIT 15",
    "s9_distinct_then_sort": "SELECT item_id, max(opened_at) AS last FROM opens GROUP BY item_id ORDER BY last DESC, item_id LIMIT 2000",
    "s10_priority_order": """
        SELECT feed, n, coalesce(CASE feed WHEN 'essential' THEN 1 WHEN 'ai_product' THEN 2 WHEN 'games' THEN 3 END, 999) AS ord FROM (SELECT feed, count(*) AS n FROM published GROUP BY feed) t ORDER BY ord, feed""",
    # sets, de-duplication, merges
    "d1_upsert": """
        SELECT o.item_id, o.triage_score FROM cheap o WHERE o.item_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM cheap n WHERE n.item_id % 2 = 0 AND n.item_id = o.item_id)
        UNION ALL SELECT item_id, triage_score + 1e0 FROM cheap WHERE item_id % 2 = 0""",
    "d2_insert_if_absent": "SELECT item_id, feed FROM published UNION ALL SELECT d.item_id, 'late' FROM deep d WHERE NOT EXISTS (SELECT 1 FROM published p WHERE p.item_id = d.item_id)",
    "d3_conditional_upsert": """
        SELECT coalesce(o.item_id, n.item_id) AS item_id, CASE WHEN o.decision = 'published' THEN o.decision ELSE coalesce(n.decision, o.decision) END AS decision FROM
        (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'published' ELSE 'rejected' END AS decision FROM deep WHERE item_id % 3 <> 0) o FULL OUTER JOIN
        (SELECT item_id, 'held' AS decision FROM deep WHERE item_id % 2 = 0) n ON n.item_id = o.item_id""",
    "d5_idempotent_events": f"SELECT item_id, CAST(floor(opened_at / (1e0 * {DAY})) AS BIGINT) AS day, min(open_id) AS open_id, count(*) AS merged FROM opens GROUP BY item_id, floor(opened_at / (1e0 * {DAY}))",
    "d6_later_wins": "SELECT k, item_id FROM (SELECT lower(substr(title, 1, 6)) AS k, item_id, row_number() OVER (PARTITION BY lower(substr(title, 1, 6)) ORDER BY item_id DESC) AS rn FROM items) t WHERE rn = 1",
    "d7_changed_keys": """
        SELECT n.k FROM (SELECT source_id AS k, md5(CAST(max(item_id) AS VARCHAR(20))) AS h FROM items GROUP BY source_id) n LEFT JOIN
        (SELECT source_id AS k, md5(CAST(max(item_id) AS VARCHAR(20))) AS h FROM items WHERE item_id < 900 GROUP BY source_id) o ON o.k = n.k WHERE o.h IS NULL OR o.h <> n.h""",
    "d10_suppress": "SELECT p.item_id, p.feed FROM published p WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.item_id = p.item_id AND i.language = 'fr')",
    # domain joins over the ledger
    "r22_minutes_spent": """
        SELECT f.feed, coalesce(sum(p.minutes), 0e0) AS spent FROM (SELECT DISTINCT feed FROM published UNION SELECT 'unused') f LEFT JOIN
        (SELECT feed, minutes FROM published WHERE published_at >= 1706659200000 - 86400000) p ON p.feed = f.feed GROUP BY f.feed""",
    "r30_feed_need": """
        SELECT f.feed, greatest(0e0, least(1e0, 1 - (coalesce(p.n, 0) + 0.5e0 * coalesce(q.n, 0)) / f.target)) AS need FROM
        (SELECT 'essential' AS feed, 40e0 AS target UNION ALL SELECT 'games', 30e0 UNION ALL SELECT 'culture', 50e0 UNION ALL SELECT 'serendipity', 20e0) f
        LEFT JOIN (SELECT feed, count(*) AS n FROM published GROUP BY feed) p ON p.feed = f.feed
        LEFT JOIN (SELECT 'games' AS feed, count(*) AS n FROM deep WHERE item_id % 50 = 7) q ON q.feed = f.feed""",
    "r41_partners": """
        SELECT source_id, count(*) AS partners, CAST(sum(shared) AS BIGINT) AS shared, min(partner) AS first_partner FROM (
          SELECT source_a AS source_id, source_b AS partner, shared FROM pairs WHERE shared >= 4 UNION ALL SELECT source_b, source_a, shared FROM pairs WHERE shared >= 4) t GROUP BY source_id""",
    "r42_audit_resolution": """
        SELECT a.item_id, a.boundary, coalesce(a.audit_result, CASE WHEN c.passed THEN 'KEEP' WHEN c.passed = false THEN c.action END) AS resolved,
               coalesce(a.would_have_published, p.item_id IS NOT NULL) AS would_publish
        FROM audits a LEFT JOIN cheap c ON c.item_id = a.item_id LEFT JOIN (SELECT DISTINCT item_id FROM published) p ON p.item_id = a.item_id""",
    "r48_calibration_answers": """
        SELECT i.item_id, CASE a.answer WHEN 2 THEN 'excellent' WHEN 0 THEN 'not_for_me' END AS kind FROM (SELECT event_id % 1000 AS item_id, max(event_id % 3) AS answer FROM events GROUP BY 1) a
        JOIN items i ON i.item_id = a.item_id WHERE a.answer <> 1""",
    "r49_adoptable": "SELECT s.source_id, s.quality_prior FROM sources s WHERE s.access = 'free' AND NOT EXISTS (SELECT 1 FROM items i WHERE i.source_id = s.source_id AND i.item_id % 97 = 5)",
    # reports
    "q1_funnel_counts": f"""
        SELECT line, n FROM (SELECT 'raw' AS line, count(*) AS n FROM items WHERE first_seen_at >= {NOW} - 30 * {DAY} UNION ALL SELECT 'rejected_rules', count(*) FROM items WHERE status = 'rejected_rules'
        UNION ALL SELECT 'triaged', count(*) FROM cheap UNION ALL SELECT 'passed', count(*) FROM cheap WHERE passed UNION ALL SELECT 'audit', count(*) FROM cheap WHERE is_audit_sample
        UNION ALL SELECT 'deep', count(*) FROM deep UNION ALL SELECT 'published', count(DISTINCT item_id) FROM published UNION ALL SELECT 'opened', count(DISTINCT item_id) FROM opens) t""",
    "q2_stage_funnel": """
        SELECT s.stage_no, s.stage, s.n, round(s.n / nullif(1e0 * lag(s.n) OVER (ORDER BY s.stage_no), 0e0), 6) AS survival, round(coalesce(u.cost, 0e0), 6) AS cost FROM (
        SELECT 1 AS stage_no, 'ingest' AS stage, count(*) AS n FROM items UNION ALL SELECT 2, 'triage', count(*) FROM cheap UNION ALL SELECT 3, 'deep', count(*) FROM deep UNION ALL
        SELECT 4, 'publish', count(*) FROM published) s LEFT JOIN (SELECT stage, sum(cost) AS cost FROM usage_ledger GROUP BY stage) u ON u.stage = s.stage""",
    "q3_cost_per_outcome": """
        SELECT round(c.cost / nullif(p.n, 0), 6) AS per_surfaced, round(c.cost / nullif(o.n, 0), 6) AS per_opened, round(c.cost / nullif(f.n, 0), 6) AS per_positive FROM
        (SELECT sum(cost) AS cost FROM usage_ledger) c CROSS JOIN (SELECT count(*) AS n FROM published) p CROSS JOIN (SELECT count(DISTINCT item_id) AS n FROM opens) o
        CROSS JOIN (SELECT count(*) AS n FROM feedback WHERE kind = 'excellent') f""",
    "q4_source_stats": """
        SELECT s.source_id, coalesce(i.n, 0) AS items, coalesce(i.rejected, 0) AS rejected, coalesce(p.n, 0) AS published FROM sources s
        LEFT JOIN (SELECT source_id, count(*) AS n, CAST(sum(CASE WHEN status = 'rejected_rules' THEN 1 ELSE 0 END) AS BIGINT) AS rejected FROM items GROUP BY source_id) i ON i.source_id = s.source_id
        LEFT JOIN (SELECT i.source_id, count(*) AS n FROM published p JOIN items i ON i.item_id = p.item_id GROUP BY i.source_id) p ON p.source_id = s.source_id""",
    "q5_cost_by_model": """
        SELECT stage, model, count(*) AS calls, round(sum(cost), 6) AS cost, round(sum(cached_tokens) / nullif(1e0 * sum(input_tokens), 0e0), 6) AS cache_rate FROM usage_ledger GROUP BY stage, model""",
    "q6_feed_counts": f"SELECT feed, count(*) AS total, CAST(sum(CASE WHEN published_at >= {NOW} - {DAY} THEN 1 ELSE 0 END) AS BIGINT) AS today FROM published GROUP BY feed",
    "q7_audit_summary": """
        SELECT a.boundary, count(*) AS samples, CAST(sum(CASE WHEN p.item_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS published FROM audits a
        LEFT JOIN (SELECT DISTINCT item_id FROM published) p ON p.item_id = a.item_id GROUP BY a.boundary""",
    "q8_category_distribution": "SELECT i.category, count(*) AS n FROM published p JOIN items i ON i.item_id = p.item_id GROUP BY i.category",
    "q11_free_false_negatives": """
        SELECT count(*) AS samples, CAST(sum(CASE WHEN audit_result IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS resolved,
               sum(CASE audit_result WHEN 'KEEP' THEN 1e0 WHEN 'UNCERTAIN' THEN 0.5e0 ELSE 0e0 END) AS misses FROM audits WHERE boundary = 'free_to_triage'""",
    "q14_readiness": "SELECT boundary, CAST(sum(CASE WHEN audit_result IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS resolved, sum(CASE WHEN audit_result IS NOT NULL THEN 1 ELSE 0 END) >= 30 AS ready FROM audits GROUP BY boundary",
    "q15_boundary_audit_top": "SELECT item_id, boundary, band, audit_score, would_have_published FROM audits WHERE audit_result = 'KEEP' ORDER BY would_have_published DESC NULLS LAST, audit_score DESC, item_id LIMIT 15",
    "q16_cluster_health": """
        SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS items, round(avg(n), 6) AS mean_size, CAST(sum(CASE WHEN lo <> hi THEN 1 ELSE 0 END) AS BIGINT) AS cross_source
        FROM (SELECT cluster_id, count(*) AS n, min(source_id) AS lo, max(source_id) AS hi FROM items GROUP BY cluster_id) t""",
    "q18_band_calibration": """
        SELECT band, count(*) AS n, round(count(*) / (1e0 * max(total)), 6) AS share, round(avg(free_score), 6) AS mean_score, min(free_score) AS lo, max(free_score) AS hi FROM
        (SELECT free_score, (SELECT count(*) FROM items) AS total, CASE WHEN free_score >= 0.396e0 THEN 'A' WHEN free_score >= 0.299e0 THEN 'B' WHEN free_score >= 0.242e0 THEN 'C' ELSE 'D' END AS band FROM items) t GROUP BY band""",
    "q19_budget_report": f"""
        SELECT stage, count(*) AS calls, round(sum(cost), 6) AS spent, round(sum(cost) / count(*), 6) AS per_call, CAST(floor(greatest(0e0, 5e0 - sum(cost)) / (sum(cost) / count(*))) AS BIGINT) AS affordable
        FROM usage_ledger WHERE created_at >= {NOW} - 30 * {DAY} GROUP BY stage""",
    "q22_latest_allocation": "SELECT event_id % 1000 AS item_id, stage, created_at FROM usage_ledger WHERE created_at = (SELECT max(created_at) FROM usage_ledger)",
    "q23_multi_clusters": "SELECT cluster_id, count(*) AS n, max(free_score) AS best FROM items GROUP BY cluster_id HAVING count(*) > 1 ORDER BY best DESC, cluster_id LIMIT 50",
    "q24_feedback_view": "SELECT f.event_id, f.kind, i.title FROM feedback f LEFT JOIN items i ON i.item_id = f.item_id ORDER BY f.created_at DESC, f.event_id LIMIT 100",
    "q25_calibration_items": "SELECT i.item_id, i.title, max(p.final_score) AS best FROM published p JOIN items i ON i.item_id = p.item_id GROUP BY i.item_id, i.title ORDER BY best DESC, item_id LIMIT 30",
    "q26_progress": """
        SELECT s.stage, coalesce(n, 0) AS done, CASE WHEN coalesce(n, 0) = 0 THEN 'pending' WHEN n < 400 THEN 'running' ELSE 'done' END AS state FROM
        (SELECT 'new' AS stage UNION ALL SELECT 'triaged' UNION ALL SELECT 'deep_evaluated' UNION ALL SELECT 'published' UNION ALL SELECT 'error') s LEFT JOIN
        (SELECT status, count(*) AS n FROM items GROUP BY status) i ON i.status = s.stage""",
    "q27_health": "SELECT a.n AS items, b.n AS published, c.last_open FROM (SELECT count(*) AS n FROM items) a CROSS JOIN (SELECT count(*) AS n FROM published) b CROSS JOIN (SELECT max(opened_at) AS last_open FROM opens) c",
    "q28_learned_weights": """
        SELECT scope, k, round(v, 6) AS v FROM (SELECT 'source' AS scope, i.source_id AS k, sum(CASE kind WHEN 'excellent' THEN 1e0 ELSE -1e0 END) / count(*) AS v FROM feedback f JOIN items i ON i.item_id = f.item_id GROUP BY i.source_id) t
        ORDER BY abs(v) DESC, k""",
    # further joins, ladders and reports
    "a11_group_concat": "SELECT k AS item_id, listagg(feed, ', ') WITHIN GROUP (ORDER BY feed) AS feeds FROM (SELECT DISTINCT item_id % 100 AS k, feed FROM published) t GROUP BY k",
    "f9_access_eligibility": """
        SELECT item_id, CASE WHEN access = 'free' AND content_chars >= 600 THEN 'readable' WHEN access <> 'free' AND item_id % 2 = 0 AND content_chars >= 600 THEN 'explicit free'
               WHEN content_chars < 600 THEN 'too short' ELSE 'not free' END AS access_state
        FROM items i JOIN sources s ON s.source_id = i.source_id""",
    "j12_prioritised_match": """
        SELECT o.open_id, coalesce(a.item_id, b.item_id, -1) AS item_id, CASE WHEN a.item_id IS NOT NULL THEN 'id' WHEN b.item_id IS NOT NULL THEN 'title' END AS how
        FROM opens o LEFT JOIN published a ON a.item_id = o.item_id LEFT JOIN items t ON t.item_id = o.item_id
        LEFT JOIN (SELECT i.title, min(p.item_id) AS item_id FROM published p JOIN items i ON i.item_id = p.item_id WHERE length(i.title) >= 12 GROUP BY i.title) b
          ON b.title = t.title""",
    "r13_audit_rate": "SELECT mode, rate, round(rate * (0.01e0 / 0.06e0), 9) AS rate_d FROM (SELECT 'lean' AS mode, 0.03e0 AS rate UNION ALL SELECT 'normal', 0.06e0 UNION ALL SELECT 'audit', 0.12e0) t",
    "r33_serendipity_potential": """
        SELECT d.item_id, CASE WHEN d.anchor_distance >= 0.55e0 AND d.novelty >= 0.55e0 THEN 1e0 WHEN d.anchor_distance >= 0.55e0 THEN 0.5e0 ELSE 0e0 END AS potential FROM deep d""",
    "r34_budget_state": f"""
        SELECT m.spent, m.frac, max_by(l.stage, l.trig) AS stage, max(l.bar) AS bar, CAST(floor(greatest(0e0, 5e0 - m.spent) / m.per_call) AS BIGINT) AS affordable FROM
        (SELECT round(sum(cost), 9) AS spent, round(sum(cost) / 5e0, 9) AS frac, avg(cost) AS per_call FROM usage_ledger WHERE created_at >= {NOW} - 30 * {DAY}) m
        JOIN (SELECT 'normal' AS stage, 0e0 AS trig, 0.30e0 AS bar UNION ALL SELECT 'careful', 0.70e0, 0.42e0 UNION ALL SELECT 'tight', 1.00e0, 0.55e0 UNION ALL SELECT 'minimal', 1.35e0, 0.72e0) l
        ON l.trig <= m.frac GROUP BY m.spent, m.frac, m.per_call""",
    "r35_path_cost": """
        SELECT model, round(sum(input_tokens * p) / 1e6, 9) AS sync_cost, round(sum((input_tokens - cached_tokens) * p + cached_tokens * p * 0.1e0) / 1e6, 9) AS cached_cost, round(sum(input_tokens * p) / 2e6, 9) AS batch_cost
        FROM (SELECT u.*, CASE model WHEN 'cheap' THEN 0.2e0 ELSE 2e0 END AS p FROM usage_ledger u) t GROUP BY model""",
    "r38_signals": """
        SELECT i.item_id, coalesce(f.v, 0e0) + CASE WHEN coalesce(d.ragebait, 0e0) > 0.35e0 THEN 0e0 ELSE coalesce(o.n, 0) * 0.15e0 END AS signal FROM items i
        LEFT JOIN (SELECT item_id, CAST(max(CASE kind WHEN 'excellent' THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM feedback GROUP BY item_id) f ON f.item_id = i.item_id
        LEFT JOIN (SELECT item_id, count(*) AS n FROM opens GROUP BY item_id) o ON o.item_id = i.item_id LEFT JOIN deep d ON d.item_id = i.item_id
        WHERE f.item_id IS NOT NULL OR o.item_id IS NOT NULL""",
    "r40_source_value": """
        SELECT s.source_id, round((coalesce(u.raw, 1e0) * coalesce(u.n, 0) + 0.5e0 * 8) / (coalesce(u.n, 0) + 8), 6) AS uniqueness,
               round((coalesce(p.n, 0) + 0.5e0 * 8) / (coalesce(u.n, 0) + 8), 6) AS published_value FROM sources s
        LEFT JOIN (SELECT source_id, count(*) AS n, avg(CASE WHEN lo = hi THEN 1e0 ELSE 0e0 END) AS raw FROM (SELECT source_id, min(source_id) OVER (PARTITION BY cluster_id) AS lo,
          max(source_id) OVER (PARTITION BY cluster_id) AS hi FROM items) t GROUP BY source_id) u ON u.source_id = s.source_id
        LEFT JOIN (SELECT source_id, count(*) AS n FROM published p JOIN items i ON i.item_id = p.item_id GROUP BY source_id) p ON p.source_id = s.source_id""",
    "r47_first_week": """
        SELECT a.n AS surfaced, b.n AS opened, round(b.n / (1e0 * a.n), 6) AS open_rate, c.repeats FROM (SELECT count(DISTINCT item_id) AS n FROM published) a
        CROSS JOIN (SELECT count(DISTINCT p.item_id) AS n FROM published p JOIN opens o ON o.item_id = p.item_id) b
        CROSS JOIN (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS repeats FROM (SELECT i.cluster_id, count(*) AS n FROM published p JOIN items i ON i.item_id = p.item_id GROUP BY i.cluster_id) t) c""",
    "st4_late_lookback": f"SELECT item_id FROM items WHERE coalesce(publication_time, first_seen_at) >= {NOW} - 2 * 96 * {HOUR}",
    "st8_extraction_ttl": f"SELECT i.item_id FROM items i WHERE i.status = 'triaged' AND NOT EXISTS (SELECT 1 FROM published p WHERE p.item_id % 400 = i.item_id % 400 AND p.published_at > {NOW} - 3 * {DAY})",
    "q9_recent_items": """
        SELECT i.item_id, i.title, i.source_id, c.action, d.novelty, f.feeds FROM items i LEFT JOIN cheap c ON c.item_id = i.item_id LEFT JOIN deep d ON d.item_id = i.item_id
        LEFT JOIN (SELECT item_id, listagg(feed, ', ') WITHIN GROUP (ORDER BY feed) AS feeds FROM published GROUP BY item_id) f ON f.item_id = i.item_id
        ORDER BY i.first_seen_at DESC, i.item_id LIMIT 100""",
    "q10_item_detail": "SELECT i.item_id, i.title, i.status, c.action, c.triage_score, d.expected_attention_value, p.feed FROM items i LEFT JOIN cheap c ON c.item_id = i.item_id LEFT JOIN deep d ON d.item_id = i.item_id LEFT JOIN published p ON p.item_id = i.item_id WHERE i.item_id = 8",
    "q13_miss_breakdown": """
        SELECT band, content_type, count(*) AS resolved, round(sum(CASE audit_result WHEN 'KEEP' THEN 1e0 WHEN 'UNCERTAIN' THEN 0.5e0 ELSE 0e0 END) / count(*), 6) AS miss_rate
        FROM audits WHERE audit_result IS NOT NULL GROUP BY GROUPING SETS ((band), (content_type))""",
    "q17_cluster_members": """
        SELECT cluster_id, listagg(title, ' | ') WITHIN GROUP (ORDER BY item_id) AS members FROM items GROUP BY cluster_id HAVING count(*) > 2 AND min(source_id) <> max(source_id)""",
    "q21_pair_sweep": """
        SELECT t, CAST(sum(CASE WHEN audit_score >= t AND would_have_published THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN audit_score >= t AND NOT would_have_published THEN 1 ELSE 0 END) AS BIGINT) AS fp,
               CAST(sum(CASE WHEN audit_score < t AND would_have_published THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM audits CROSS JOIN (SELECT 0.3e0 AS t UNION ALL SELECT 0.42e0 UNION ALL SELECT 0.6e0) q
        WHERE would_have_published IS NOT NULL GROUP BY t""",
}

_PAIRS = """pairs AS (SELECT a.source_id AS source_a, b.source_id AS source_b, count(DISTINCT a.cluster_id) AS shared FROM (SELECT DISTINCT cluster_id, source_id FROM items) a
    JOIN (SELECT DISTINCT cluster_id, source_id FROM items) b ON b.cluster_id = a.cluster_id AND a.source_id < b.source_id GROUP BY a.source_id, b.source_id)"""


def text(name: str) -> str:
    """The whole statement, views included."""
    from loomrank.sources.adapters import WITH

    return f"{WITH},\n{_PAIRS}\n{SQL[name]}"


def oracle_text(name: str) -> str:
    """The same statement in the checking engine's spelling of ordered string aggregation."""
    return re.sub(r"listagg\((.+?), ('[^']*')\) WITHIN GROUP \(ORDER BY (\w+)\)", r"string_agg(\1, \2 ORDER BY \3)", text(name))
