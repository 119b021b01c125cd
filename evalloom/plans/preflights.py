"""Queries of the checks before a comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions.scalars import WHITE
from evalloom.operators import audit, preflight
from evalloom.plans import frames
from evalloom.plans.frames import SCORED, identity_sql, ranking_sql, table
from evalloom.plans.registry import query
from evalloom.storage import cut

COPY = """CASE page_id % 4 WHEN 0 THEN replace(html, ' ', '~') WHEN 1 THEN replace(replace(html, '.', chr(92) || '.'), ' ', chr(160) || chr(10)) WHEN 2 THEN html || ' x' ELSE html END"""


@query(f"WITH c AS (SELECT page_id, html, CASE WHEN page_id % 11 <> 0 THEN {COPY} END AS copy FROM pages) SELECT page_id, {identity_sql('html')} = {identity_sql('copy')} AS identical FROM c WHERE html IS NOT NULL AND copy IS NOT NULL")
def text_identity(spark, sf_dir):
    """Pages beside copies with other spaces, marks after backslashes, or a word more; some have no copy."""
    p, k = table(spark, sf_dir, "pages").select("page_id", "html"), F.col("page_id")
    changed = F.when(k % 4 == 0, F.replace("html", F.lit(" "), F.lit("~"))).when(k % 4 == 1, F.replace(F.replace("html", F.lit("."), F.lit("\\.")), F.lit(" "), F.lit("\u00a0\n"))).when(k % 4 == 2, F.concat("html", F.lit(" x"))).otherwise(F.col("html"))
    return preflight.text_identity(p, p.select("page_id", F.when(k % 11 != 0, changed).alias("html")), "page_id", "html")


@query("""SELECT lang AS arm, source AS endpoint, count(*) AS n, round(avg(toxic), 9) AS positive_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def arm_balance(spark, sf_dir):
    """Languages as arms, sources as endpoints; documents without a label are rows without one."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("arm"), F.col("source").alias("endpoint"))
    rows = d.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return preflight.arm_balance(rows, "arm", "endpoint", "toxic").withColumn("positive_rate", F.round("positive_rate", 9))


@query(f"""WITH d AS (SELECT lang AS arm, source, n_chars, len(regexp_extract_all(coalesce(text, ''), '[^{WHITE}]+')) AS w FROM documents)
    SELECT arm, 'words' AS what, NULL::VARCHAR AS level, round(median(w), 9) AS value FROM d GROUP BY 1 UNION ALL SELECT arm, 'number', NULL, round(median(n_chars), 9) FROM d GROUP BY 1
    UNION ALL SELECT arm, 'share', source, round(count(*) / sum(count(*)) OVER (PARTITION BY arm), 9) FROM d WHERE source IS NOT NULL GROUP BY 1, source""")
def arm_covariates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("arm"), "text", "n_chars", "source")
    return preflight.arm_covariates(d, "arm", "text", "n_chars", "source").withColumn("value", F.round("value", 9))


HIT = "coalesce(len(list_intersect({0}, {1})) / nullif(len({0}) + len({1}) - len(list_intersect({0}, {1})), 0) > 0.5, false)::BIGINT"


@query(f"""WITH r AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END), '[\\p{{L}}\\p{{N}}_]+')) AS s, list_distinct(regexp_extract_all(lower(p_type), '[\\p{{L}}\\p{{N}}_]+')) AS t, row_number() OVER (ORDER BY sha256('control|' || p_partkey), p_partkey) AS k FROM part),
    c AS (SELECT count(*) AS n, sum({HIT.format('r.s', 'r.t')})::BIGINT AS a, sum({HIT.format('r.s', 'o.t')})::BIGINT AS c FROM r JOIN r o ON o.k = r.k % (SELECT count(*) FROM r) + 1),
    p AS (SELECT i, exp(2 * lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - lgamma(a + c - i + 1) - lgamma(n - a - c + i + 1) - lgamma(2 * n + 1) + lgamma(a + c + 1) + lgamma(2 * n - a - c + 1)) AS p FROM c, unnest(range(greatest(0, a + c - n), least(n, a + c) + 1)) u(i))
    SELECT n, a AS real_hits, c AS shuffled_hits, round((SELECT sum(p) FROM p WHERE p <= (SELECT p FROM p WHERE i = c.a) * (1 + 1e-7)), 6) AS p FROM c""")
def shuffled_control(spark, sf_dir):
    """A third of the parts are given their own type as what was said of them."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("said"), "p_type")
    return preflight.shuffled_control(p, "p_partkey", "said", "p_type", "control").withColumn("p", F.round("p", 6))


@query(f"""WITH {SCORED}, e AS (SELECT list_distinct(quantile_cont(id, [0.2, 0.4, 0.6, 0.8])) AS e FROM scored), s AS (SELECT lang, len(list_filter(e, lambda x: x <= id))::INT AS bin, a, b, id::DOUBLE AS c, y FROM scored, e), l AS (SELECT lang, bin, y, 'full' AS arm, a AS s FROM s UNION ALL SELECT lang, bin, y, 'rival', b FROM s UNION ALL SELECT lang, bin, y, 'confound', c FROM s),
    lw AS (SELECT lang || '#' || arm AS g, s, y FROM l), lp AS (SELECT lang || '#' || arm || '#' || bin AS g, s, y FROM l WHERE arm <> 'confound'), {ranking_sql('lw', 'g', 's', name='w')}, {ranking_sql('lp', 'g', 's', name='p')},
    h AS (SELECT split_part(g, '#', 1) AS lang, max(ap) FILTER (WHERE g LIKE '%#full') AS full_, max(ap) FILTER (WHERE g LIKE '%#rival') AS rival, max(ap) FILTER (WHERE g LIKE '%#confound') AS confound FROM w GROUP BY 1),
    q AS (SELECT split_part(g, '#', 1) AS lang, sum(ap * (n_pos + n_neg)) FILTER (WHERE g LIKE '%#full#%') / sum(n_pos + n_neg) FILTER (WHERE g LIKE '%#full#%') - sum(ap * (n_pos + n_neg)) FILTER (WHERE g LIKE '%#rival#%') / sum(n_pos + n_neg) FILTER (WHERE g LIKE '%#rival#%') AS pm FROM p WHERE n_pos + n_neg >= 5 AND n_pos > 0 AND n_neg > 0 GROUP BY 1),
    f AS (SELECT lang, (count(*) % 7) / 100.0::DOUBLE AS floor FROM scored GROUP BY 1), z AS (SELECT h.*, full_ - rival AS margin, pm, 1 - pm / nullif(full_ - rival, 0) AS shrinkage, floor FROM h LEFT JOIN q USING (lang) LEFT JOIN f USING (lang))
    SELECT lang, round(full_, 9) AS "full", round(rival, 9) AS rival, round(confound, 9) AS confound, round(margin, 9) AS margin, round(pm, 9) AS pooled_margin, round(shrinkage, 6) AS shrinkage, CASE WHEN abs(confound - full_) <= floor THEN 'CUT' WHEN shrinkage > 0.5 THEN 'SOFTENED' ELSE 'CONFIRMED' END AS verdict FROM z""")
def confound_verdicts(spark, sf_dir):
    """The id stands for when a document was made; its fifths are the strata."""
    df = frames.scored(spark, sf_dir).withColumn("c", F.col("id").cast("double"))
    binned = audit.fitted_bins(df, df, "c", 5)
    floors = df.groupBy("lang").agg((F.count(F.lit(1)) % 7 / 100).alias("floor"))
    found = preflight.confound_verdicts(binned, "lang", "bin", ("a", "b", "c"), "y", floors, least=5)
    return found.select("lang", *[F.round(c, 9).alias(c) for c in ("full", "rival", "confound", "margin", "pooled_margin")], F.round("shrinkage", 6).alias("shrinkage"), "verdict")


@query("""WITH o AS (SELECT l_orderkey AS k, list_distinct(list(p_type)) AS terms, list_distinct(list(p_brand)) AS groups FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    s AS (SELECT k, groups[1] AS g, terms[1] AS name, ('0x' || substr(sha256(lower(trim(terms[1]))), 1, 13))::BIGINT AS s FROM o WHERE len(groups) = 1 AND len(terms) = 1), seat AS (SELECT g, s, name, row_number() OVER (PARTITION BY g ORDER BY s DESC, sha256('swap|' || k), k) - 1 AS spot FROM s),
    blk AS (SELECT g, s, min(spot) AS start, count(*) AS n FROM seat GROUP BY ALL), grp AS (SELECT g, sum(n)::BIGINT AS size FROM blk GROUP BY 1), r AS (SELECT k, CASE WHEN k % 11 = 0 THEN [] ELSE groups END AS groups, terms FROM o),
    e AS (SELECT r.k, g, size, row_number() OVER (PARTITION BY r.k ORDER BY g) - 1 AS i, count(*) OVER (PARTITION BY r.k) AS c FROM r, grp WHERE len(groups) > 0 AND NOT list_contains(groups, g)),
    goal AS (SELECT * FROM e WHERE i = ('0x' || substr(sha256('swap|group|' || k), 1, 8))::BIGINT % c), own AS (SELECT k, ('0x' || substr(sha256(lower(trim(t))), 1, 13))::BIGINT AS s FROM (SELECT k, unnest(terms) AS t FROM r)),
    allowed AS (SELECT goal.k, goal.g, seat.name, row_number() OVER (PARTITION BY goal.k ORDER BY seat.spot) - 1 AS j, count(*) OVER (PARTITION BY goal.k) AS free FROM goal JOIN seat ON seat.g = goal.g WHERE (goal.k, seat.s) NOT IN (SELECT k, s FROM own))
    SELECT o.k, a.g AS donor_group, a.name AS donor_name FROM o LEFT JOIN allowed a ON a.k = o.k AND a.j = ('0x' || substr(sha256('swap|row|' || o.k), 1, 8))::BIGINT % free""")
def swap_donors(spark, sf_dir):
    """Orders' part types are terms, brands groups; every eleventh order's groups are unknown. Orders of one type give theirs."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    both = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey").join(p, "l_partkey")
    o = cut(both.groupBy("k").agg(F.collect_set("p_type").alias("terms"), F.collect_set("p_brand").alias("groups")), "orders")
    asked = o.withColumn("groups", F.when(F.col("k") % 11 != 0, F.col("groups")).otherwise(F.array().cast("array<string>")))
    return audit.swap_donors(o, asked, "k", "groups", "terms", "swap")
