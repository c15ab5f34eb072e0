"""Queries over provider agreement on conversation-derived regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from earwitness.catalog.registry import query
from earwitness.functions.numbers import round_exact_sql
from earwitness.operators import agreement, alignment, draft
from earwitness.operators.rescue import first_red
from earwitness.sources import tables as t


def regions(spark, sf):
    """Given regions: every segment with its three candidates."""
    long = t.region_candidates(spark, sf).select(
        "job_id", F.col("ord").alias("region_no"), "provider", "provider_ord", "missing", "text",
        (F.col("start_ms") / 1000.0).alias("start_sec"), (F.col("end_ms") / 1000.0).alias("end_sec"))
    gathered = alignment.gather_regions(long, ["job_id", "region_no"], t.PROVIDERS, ["text", "start_sec", "end_sec"])
    first = F.col("candidates")[t.PROVIDERS[0]]
    return gathered.select(
        "job_id", "region_no", F.format_string("region-%05d", F.col("region_no") + 1).alias("region_id"),
        first["start_sec"].alias("start_sec"), first["end_sec"].alias("end_sec"), "candidates")


def classified(spark, sf):
    return agreement.classify(regions(spark, sf), t.PROVIDERS)


@query("region_pairs_missing", sql=f"""
WITH {t.REGION_CANDIDATES_SQL}
SELECT l.job_id, l.ord, l.provider AS left_provider, r.provider AS right_provider, l.missing OR r.missing AS missing
FROM region_candidates l JOIN region_candidates r
  ON l.job_id = r.job_id AND l.ord = r.ord AND l.provider_ord < r.provider_ord
""")
def region_pairs_missing(spark, sf):
    pairs = agreement.with_pairwise(regions(spark, sf), t.PROVIDERS)
    return pairs.select("job_id", F.col("region_no").alias("ord"), F.explode_outer("pairwise").alias("p")).select(
        "job_id", "ord", F.col("p.providers")[0].alias("left_provider"), F.col("p.providers")[1].alias("right_provider"),
        F.col("p.missing").alias("missing"))


# Matching blocks by recursion: runs of equal signs along a diagonal are cut to what lies left and right of the best one.
# fm, ft: forms of each candidate; pr: pairs; ask: distinct pairs to compare; rec: blocks found; matched: ratios.
def _classified_sql(pairs: str = "l.provider_ord < r.provider_ord") -> str:
    """``classified`` and the scores it comes from; ``scored_all`` has all pairs asked for, in both orders if so."""
    return _PAIRS_SQL.replace("{pairs}", pairs) + _STATUS_SQL


_PAIRS_SQL = t.REGION_CANDIDATES_SQL + """,
fm AS MATERIALIZED (SELECT job_id, ord, provider, provider_ord, missing, text, replace(lower(text), 'ß', 'ss') AS low FROM region_candidates),
ft AS MATERIALIZED (SELECT *, regexp_replace(low, '[^\\p{L}\\p{N}\\p{M}]', '', 'g') AS c, regexp_extract_all(low, '[\\p{L}\\p{N}\\p{M}]+') AS tk FROM fm),
pr AS MATERIALIZED (SELECT l.job_id, l.ord, l.provider AS lp, r.provider AS rp, l.provider_ord AS lo, r.provider_ord AS ro, l.missing OR r.missing AS missing,
  string_split(l.c, '') AS x, string_split(r.c, '') AS y, l.c AS a, r.c AS b, l.tk AS xt, r.tk AS yt
  FROM ft l JOIN ft r ON l.job_id = r.job_id AND l.ord = r.ord AND {pairs}),
ask AS MATERIALIZED (SELECT row_number() OVER () AS pid, x, y FROM (SELECT x, y FROM pr WHERE NOT missing AND a <> b AND a <> '' AND b <> '' UNION SELECT xt, yt FROM pr WHERE NOT missing AND xt <> yt AND len(xt) > 0 AND len(yt) > 0)),
xs AS (SELECT pid, unnest(x) AS v, unnest(range(len(x))) AS i FROM ask), ys AS (SELECT pid, unnest(y) AS v, unnest(range(len(y))) AS j FROM ask),
eq AS (SELECT pid, i, j, i - row_number() OVER (PARTITION BY pid, i - j ORDER BY i) AS g FROM xs JOIN ys USING (pid, v)),
runs AS (SELECT pid, list([-n, i0, j0]) AS runs FROM (SELECT pid, min(i) AS i0, min(j) AS j0, count(*) AS n FROM eq GROUP BY pid, i - j, g) GROUP BY pid),
rec(pid, hit, runs) AS (
  SELECT pid, 0::BIGINT, runs FROM runs
  UNION ALL
  SELECT pid, unnest([-best[1], 0]), unnest([
      [[greatest(r[1], r[2] - best[2], r[3] - best[3]), r[2], r[3]] for r in runs if r[2] < best[2] AND r[3] < best[3]],
      [[r[1] + greatest(0, best[2] - best[1] - r[2], best[3] - best[1] - r[3]), r[2] + greatest(0, best[2] - best[1] - r[2], best[3] - best[1] - r[3]), r[3] + greatest(0, best[2] - best[1] - r[2], best[3] - best[1] - r[3])]
        for r in runs if greatest(0, best[2] - best[1] - r[2], best[3] - best[1] - r[3]) < -r[1]]])
  FROM (SELECT pid, runs, list_aggregate(runs, 'min') AS best FROM rec WHERE len(runs) > 0)),
matched AS MATERIALIZED (SELECT x, y, 2.0::DOUBLE * coalesce(m, 0) / (len(x) + len(y)) AS q FROM ask LEFT JOIN (SELECT pid, sum(hit) AS m FROM rec GROUP BY pid) USING (pid)),
sc AS MATERIALIZED (SELECT p.*, CASE WHEN a = b THEN 1.0 WHEN a = '' OR b = '' THEN 0.0 ELSE mc.q END::DOUBLE AS ch, CASE WHEN xt = yt THEN 1.0 WHEN len(xt) = 0 OR len(yt) = 0 THEN 0.0 ELSE mt.q END::DOUBLE AS tok,
  CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE least(length(a), length(b))::DOUBLE / greatest(length(a), length(b)) END::DOUBLE AS lr
  FROM pr p LEFT JOIN matched mc ON p.x = mc.x AND p.y = mc.y LEFT JOIN matched mt ON p.xt = mt.x AND p.yt = mt.y),
"""
_STATUS_SQL = f"""
scored_all AS MATERIALIZED (SELECT job_id, ord, lp, lp || '|' || rp AS providers, lo, ro, missing, CASE WHEN NOT missing THEN {round_exact_sql('ch', 6)} END AS character_similarity,
  CASE WHEN NOT missing THEN {round_exact_sql('tok', 6)} END AS token_similarity, CASE WHEN NOT missing THEN {round_exact_sql('lr', 6)} END AS length_ratio,
  CASE WHEN NOT missing THEN {round_exact_sql('0.60::DOUBLE * ch + 0.30::DOUBLE * tok + 0.10::DOUBLE * lr', 6)} END AS derived_similarity FROM sc),
scored AS (SELECT * FROM scored_all WHERE lo < ro),
gathered AS (SELECT job_id, ord, list(derived_similarity ORDER BY lo, ro) FILTER (NOT missing) AS d, min(length_ratio) AS short FROM scored GROUP BY ALL),
heard AS (SELECT job_id, ord, string_agg(provider, ', ' ORDER BY provider_ord) FILTER (missing) AS lost, string_agg(provider, ', ' ORDER BY provider_ord) FILTER (NOT missing AND trim(coalesce(text, '')) = '') AS blank FROM region_candidates GROUP BY ALL),
placed AS (SELECT *, list_min(d) AS low, {round_exact_sql('CASE len(d) WHEN 3 THEN (d[1] + d[2] + d[3]) / 3 ELSE d[1] END', 6)} AS mean FROM gathered JOIN heard USING (job_id, ord)),
status AS (SELECT *, CASE WHEN lost IS NOT NULL THEN 'lost' WHEN blank IS NOT NULL THEN 'blank' WHEN short < 0.45 THEN 'short' WHEN low < 0.32 OR mean < 0.42 THEN 'apart'
  WHEN low >= 0.78 AND mean >= 0.84 THEN 'close' ELSE 'between' END AS why FROM placed),
classified AS (SELECT job_id, ord, format('region-{{:05d}}', ord + 1) AS region_id, CASE why WHEN 'close' THEN 'GREEN' WHEN 'between' THEN 'AMBER' ELSE 'RED' END AS agreement_status,
  CASE WHEN why = 'lost' THEN 0.0 ELSE mean END::DOUBLE AS derived_agreement_score,
  CASE why WHEN 'lost' THEN 'Missing provider candidate: ' || lost || '.' WHEN 'blank' THEN 'Empty provider candidate: ' || blank || '.'
    WHEN 'short' THEN printf('Substantial text-length difference; minimum pair length ratio %.3f.', short)
    ELSE CASE why WHEN 'apart' THEN 'Major derived disagreement' WHEN 'close' THEN 'Substantial derived agreement' ELSE 'Meaningful derived differences' END || printf('; minimum pair %.3f, mean %.3f.', low, mean) END AS reason FROM status)
"""


@query("region_status", sql=f"WITH RECURSIVE {_classified_sql()} SELECT job_id, region_id, agreement_status, derived_agreement_score, reason FROM classified")
def region_status(spark, sf):
    return classified(spark, sf).select(
        "job_id", "region_id", "agreement_status", "derived_agreement_score",
        F.col("agreement_reasons")[0].alias("reason"))


@query("pair_scores", sql=f"""
WITH RECURSIVE {_classified_sql()} SELECT job_id, format('region-{{:05d}}', ord + 1) AS region_id, providers, missing, character_similarity, token_similarity, length_ratio, derived_similarity FROM scored
""")
def pair_scores(spark, sf):
    return classified(spark, sf).select("job_id", "region_id", F.explode_outer("pairwise").alias("p")).select(
        "job_id", "region_id", F.array_join("p.providers", "|").alias("providers"), "p.missing",
        "p.character_similarity", "p.token_similarity", "p.length_ratio", "p.derived_similarity")


@query("status_counts", sql=f"""
WITH RECURSIVE {_classified_sql()} SELECT job_id, count(*) FILTER (agreement_status = 'GREEN') AS green, count(*) FILTER (agreement_status = 'AMBER') AS amber,
  count(*) FILTER (agreement_status = 'RED') AS red, count(*) AS regions FROM classified GROUP BY job_id
""")
def status_counts(spark, sf):
    return agreement.status_counts(classified(spark, sf))


_ALNUM = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]', '', 'g')"


@query("length_ratio_red", sql=f"""
WITH {t.REGION_CANDIDATES_SQL},
forms AS (SELECT job_id, ord, provider_ord, length({_ALNUM.format("replace(text, 'ß', 'ss')")}) AS n FROM region_candidates WHERE NOT missing),
pairs AS (SELECT l.job_id, l.ord, CASE WHEN greatest(l.n, r.n) = 0 THEN 1.0
    ELSE CAST(least(l.n, r.n) AS DOUBLE) / greatest(l.n, r.n) END AS ratio
  FROM forms l JOIN forms r ON l.job_id = r.job_id AND l.ord = r.ord AND l.provider_ord < r.provider_ord)
SELECT job_id, ord, round_even(min(ratio), 6) AS min_length_ratio, min(round_even(ratio, 6)) < 0.45 AS red
FROM pairs GROUP BY 1, 2
""")
def length_ratio_red(spark, sf):
    sized = agreement.with_length_ratio(regions(spark, sf), t.PROVIDERS)
    return sized.select("job_id", F.col("region_no").alias("ord"), "min_length_ratio", (F.col("min_length_ratio") < 0.45).alias("red"))


_DRAFT_SQL = _classified_sql("l.provider_ord <> r.provider_ord") + f"""
, sides AS (SELECT job_id, ord, lp, lo, list(derived_similarity ORDER BY ro) AS d FROM scored_all GROUP BY ALL),
medoid AS (SELECT s.job_id, s.ord, arg_min(lp, (-{round_exact_sql('(d[1] + d[2]) / 2', 6)}, lo)) AS selected FROM sides s JOIN classified c USING (job_id, ord) WHERE agreement_status = 'GREEN' GROUP BY ALL),
draft AS (SELECT c.job_id, c.region_id AS window_id, agreement_status AS derived_status, m.selected AS selected_provider, rc.text AS final_text,
  agreement_status = 'GREEN' AS auto_accepted, agreement_status <> 'GREEN' AS review_required
  FROM classified c LEFT JOIN medoid m USING (job_id, ord) LEFT JOIN region_candidates rc ON rc.job_id = c.job_id AND rc.ord = c.ord AND rc.provider = m.selected)
"""


@query("representative", sql=f"WITH RECURSIVE {_DRAFT_SQL} SELECT * FROM draft")
def representative(spark, sf):
    return draft.final_draft(classified(spark, sf), t.PROVIDERS).select(
        "job_id", "window_id", "derived_status", "selected_provider", "final_text", "auto_accepted", "review_required")


@query("draft_statistics", sql=f"""
WITH RECURSIVE {_classified_sql()} SELECT job_id, count(*) AS total_windows, count(*) FILTER (agreement_status = 'GREEN') AS auto_accepted, count(*) FILTER (agreement_status <> 'GREEN') AS review_required,
  count(*) FILTER (agreement_status = 'GREEN') AS green, count(*) FILTER (agreement_status = 'AMBER') AS amber, count(*) FILTER (agreement_status = 'RED') AS red FROM classified GROUP BY job_id
""")
def draft_statistics(spark, sf):
    return draft.draft_statistics(draft.final_draft(classified(spark, sf), t.PROVIDERS))


@query("first_red", sql=f"""
WITH RECURSIVE {_classified_sql()}, red AS (SELECT job_id, min(ord) AS ord FROM classified WHERE agreement_status = 'RED' GROUP BY job_id)
SELECT r.job_id, format('region-{{:05d}}', r.ord + 1) AS region_id, CAST(start_ms / 1000 AS DOUBLE) AS start_sec, CAST(end_ms / 1000 AS DOUBLE) AS end_sec,
  CASE WHEN NOT end_ms > start_ms THEN 'invalid bounds' END AS error FROM red r JOIN region_candidates c ON c.job_id = r.job_id AND c.ord = r.ord AND c.provider = 'alpha'
""")
def first_red_query(spark, sf):
    return first_red(classified(spark, sf))


def candidates(spark, sf):
    return t.region_candidates(spark, sf).where(~F.col("missing")).select(
        "job_id", "provider", "provider_ord",
        F.concat("provider", F.format_string(":%05d", F.col("ord") + 1)).alias("candidate_id"),
        (F.col("start_ms") / 1000.0).alias("start_sec"), (F.col("end_ms") / 1000.0).alias("end_sec"),
        "missing", "text")


@query("align_regions", sql=f"""
WITH {t.REGION_CANDIDATES_SQL}
SELECT job_id, format('region-{{:05d}}', ord + 1) AS region_id,
  format('{{}}:{{:05d}}', provider, ord + 1) AS candidate_id,
  min(start_ms) OVER w AS region_start_ms, max(end_ms) OVER w AS region_end_ms
FROM region_candidates WHERE NOT missing
WINDOW w AS (PARTITION BY job_id, ord)
""")
def align_regions(spark, sf):
    return alignment.align(candidates(spark, sf)).select(
        "job_id", "region_id", "candidate_id",
        F.round(F.col("region_start_sec") * 1000).cast("long").alias("region_start_ms"),
        F.round(F.col("region_end_sec") * 1000).cast("long").alias("region_end_ms"))


@query("alignment_statistics", sql=f"""
WITH {t.REGION_CANDIDATES_SQL}
SELECT job_id, count(*) FILTER (provider = 'alpha') AS segments_alpha, count(*) FILTER (provider = 'bravo') AS segments_bravo,
  count(*) FILTER (provider = 'charlie') AS segments_charlie, count(*) AS total_source_segments,
  count(DISTINCT ord) AS aligned_regions, 0 AS unaligned_segments
FROM region_candidates WHERE NOT missing GROUP BY 1
""")
def alignment_statistics(spark, sf):
    return alignment.alignment_statistics(alignment.align(candidates(spark, sf)), t.PROVIDERS)
