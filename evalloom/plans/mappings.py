"""Queries of code mappings, rare and common codes, gains by cell, joint predictions and combiners."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import codes, features, mapping, ranking, runs
from evalloom.plans import frames
from evalloom.plans.frames import RUNS, SCORED, ranking_sql, table
from evalloom.plans.registry import query
from evalloom.storage import cut

#: Eight vectors are a record's terms. A label is a code, its mean vector the code's; a term is mapped to the code that is nearest.
MAPPED = """x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    named AS (SELECT DISTINCT label, chr(65 + ((label // 2) % 3)::INT) || lpad((label // 2)::VARCHAR, 2, '0') || '.' || (label % 2) AS code, label // 2 AS h FROM embeddings WHERE label IS NOT NULL),
    m AS (SELECT label, pos, round(avg(x), 5) AS v FROM x WHERE label IS NOT NULL GROUP BY 1, 2),
    c AS (SELECT vec_id, m.label, sum(x * v) / sqrt(sum(x * x) * sum(v * v)) AS c FROM x JOIN m USING (pos) GROUP BY ALL),
    near AS (SELECT vec_id, c.label FROM c JOIN named USING (label) WHERE isfinite(c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(c, 9) DESC, code) = 1),
    own AS (SELECT DISTINCT vec_id // 8 AS rec, 'first' AS side, code, h FROM embeddings JOIN named USING (label) UNION SELECT vec_id // 8, 'second', code, h FROM near JOIN named USING (label)),
    lev AS (SELECT rec, side, 'full' AS level, code AS term FROM own UNION SELECT rec, side, 'char3', code[1:3] FROM own UNION SELECT rec, side, 'block', 'BL' || (h % 3) FROM own UNION SELECT rec, side, 'chapter', 'CH' || (h % 2) FROM own),
    met AS (SELECT rec, level, term, bool_or(side = 'first') AS a, bool_or(side = 'second') AS b FROM lev GROUP BY ALL),
    agree AS (SELECT rec, level, count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a AND b) / count(*) AS jaccard FROM met GROUP BY ALL)"""


def mapped_levels(spark, sf_dir):
    """(first, second): (rec, level, term) rows of records' own codes and of the codes that their terms are nearest to."""
    e = table(spark, sf_dir, "embeddings")
    half = F.floor(F.col("label") / 2).cast("int")
    code = F.concat(F.chr(half % 3 + 65), F.lpad(half.cast("string"), 2, F.lit("0")), F.lit("."), (F.col("label") % 2).cast("string"))
    named = e.select("label").distinct().where("label is not null").select("label", code.alias("code"), half.alias("h"))
    means = features.pooled_vectors(e.where("label is not null"), "label", "embedding").withColumn("value", F.round("value", 5))
    index = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("s")).join(named, "label").select("code", F.col("s.value").alias("v"))
    near = mapping.nearest_codes(e.select(F.col("vec_id").cast("string").alias("term"), F.col("embedding").cast("array<double>").alias("v")), index, "term", "code", "v")
    heads = named.select(F.substring("code", 1, 3).alias("char3"), F.concat(F.lit("BL"), F.col("h") % 3).alias("block"), F.concat(F.lit("CH"), F.col("h") % 2).alias("chapter")).distinct()
    rec = lambda k: F.floor(k / 8).cast("bigint").alias("rec")
    own = e.join(named, "label").select(rec(F.col("vec_id")), F.array("code").alias("codes"))
    far = near.select(rec(F.col("term").cast("bigint")), F.array("code").alias("codes"))
    return tuple(codes.code_levels(df, "rec", "codes", heads) for df in (own, far))


@query(f"WITH {MAPPED} SELECT level, round(avg(jaccard), 9) AS mean_jaccard, count(*) AS n_scored FROM agree GROUP BY 1")
def mapping_agreement(spark, sf_dir):
    """How far records' own codes and the codes nearest to their terms agree, at every level."""
    found = mapping.mean_agreement(mapping.agreement(*mapped_levels(spark, sf_dir), "rec"), [])
    return found.select("level", F.round("mean_jaccard", 9).alias("mean_jaccard"), "n_scored")


@query(f"""WITH {MAPPED}, t AS (SELECT rec, term FROM lev WHERE side = 'second' AND level = 'char3'), voc AS (SELECT term FROM t WHERE rec % 2 = 0 GROUP BY 1 HAVING count(*) >= 3),
    n AS (SELECT rec, count(term) AS n FROM (SELECT DISTINCT rec FROM lev) LEFT JOIN t USING (rec) GROUP BY 1)
    SELECT rec, 'icd__' || term AS feature, 1.0::DOUBLE AS value FROM t JOIN voc USING (term) UNION ALL SELECT rec, 'n_icd_terms', n::DOUBLE FROM n UNION ALL SELECT rec, 'has_icd', (n > 0)::INT::DOUBLE FROM n""")
def remapped_codes(spark, sf_dir):
    """The code view of the mapped terms in place of records' own codes, its vocabulary fitted on even records."""
    own, far = mapped_levels(spark, sf_dir)
    far = cut(far, "mapped")
    terms = codes.code_terms(far, "rec", "char3")
    view = codes.CodeView("rec", codes.code_blocks("char3"), min_df=3).fit(terms.where("rec % 2 = 0"))
    return view.transform(own.select("rec").union(far.select("rec")), terms).select("rec", "feature", "value")


@query(f"""WITH {MAPPED}, d AS (SELECT rec, round(jaccard, 9) AS jaccard FROM agree WHERE level = 'char3' AND round(jaccard, 9) < 1), e AS (SELECT list_distinct(quantile_cont(jaccard, [0.25, 0.5, 0.75])) AS e FROM d),
    b AS (SELECT d.*, len(list_filter(e, lambda x: x < jaccard))::INT AS bin FROM d, e), p AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY sha256('judge|' || rec), rec) AS place FROM b)
    SELECT rec, jaccard, bin, place FROM p WHERE place <= 5 QUALIFY row_number() OVER (ORDER BY bin, place) <= 20""")
def disagreement_sample(spark, sf_dir):
    """Twenty records whose mapped codes aren't their own, from all quarters of agreement, for people to judge."""
    found = mapping.agreement(*mapped_levels(spark, sf_dir), "rec").where("level = 'char3'").withColumn("jaccard", F.round("jaccard", 9))
    return mapping.disagreement_sample(found, "rec", "jaccard", 20, "judge").select("rec", "jaccard", "bin", "place")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderdate < TIMESTAMP '1996-01-01' AS early FROM orders), t AS (SELECT DISTINCT k, early, l_suppkey AS term FROM o JOIN lineitem ON k = l_orderkey WHERE l_quantity > 25),
    df AS (SELECT term, count(*) AS df FROM t WHERE early GROUP BY 1), r AS (SELECT k, min(coalesce(df, 0))::BIGINT AS rarest FROM t LEFT JOIN df USING (term) WHERE NOT early GROUP BY 1), m AS (SELECT median(rarest) AS m, count(*) AS n FROM r)
    SELECT o.k AS k, rarest, CASE WHEN n < 20 THEN NULL WHEN rarest <= m THEN 'rare' WHEN rarest > m THEN 'common' END AS part FROM o LEFT JOIN r ON o.k = r.k, m WHERE NOT early""")
def rare_common_split(spark, sf_dir):
    """Later orders by how rare their rarest supplier is among earlier ones; orders without large lines have no part."""
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), early.alias("early"))
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("term"))
    terms = o.join(lines, "k")
    return codes.rare_common(terms.where("early").select("k", "term"), terms.where("not early").select("k", "term"), o.where("not early"), "k")


@query(f"""WITH {RUNS}, p AS (SELECT cell, method, stddev_samp(value) AS sd, avg(half) AS hw FROM runs GROUP BY 1, 2), f AS (SELECT cell, greatest(1.96 * sqrt(avg(sd * sd)), avg(hw)) / 20 AS floor FROM p WHERE cell < 8 GROUP BY 1),
    g AS (SELECT a.cell, a.method, avg(a.value - b.value) AS g, count(*) AS n FROM runs a JOIN runs b ON a.method = b.method AND a.cell = b.cell AND a.seed = b.seed + 1 GROUP BY 1, 2), c AS (SELECT cell, avg(g) AS gain, count(*) AS n_methods, sum(n)::BIGINT AS n_pairs FROM g GROUP BY 1)
    SELECT cell, round(gain, 9) AS gain, n_methods, n_pairs, abs(gain) > floor AS exceeds FROM c LEFT JOIN f USING (cell)""")
def gain_by_cell(spark, sf_dir):
    """Each seed beside the one after it, by method and then by cell, against a twentieth of the cell's noise floor; one cell has none."""
    r = frames.runs(spark, sf_dir)
    floors = runs.noise_floor(r, "cell", "method", "value", "half").where("cell < 8").withColumn("floor", F.col("floor") / 20)
    found = runs.gain_by_cell(r, r.withColumn("seed", F.col("seed") - 1), ["cell"], "method", "seed", "value", floors)
    return found.withColumn("gain", F.round("gain", 9))


@query(f"""WITH {RUNS}, w AS (SELECT cell, seed, method, value FROM runs) SELECT cell, seed, {', '.join(f"max(value) FILTER (WHERE method = 'm{k}') AS m{k}" for k in range(7))} FROM w GROUP BY 1, 2 HAVING count(DISTINCT method) = 7""")
def scored_by_all(spark, sf_dir):
    """Cells and seeds that all seven methods have; one method lacks a cell."""
    return runs.scored_by_all(frames.runs(spark, sf_dir), ["cell", "seed"], "method", "value", [f"m{k}" for k in range(7)])


PARTS = "SELECT lang, i, round((i * a + (100 - i) * b) / 100, 9) AS s, y FROM scored, range(0, 101) t(i) WHERE id % 2 ="


@query(f"""WITH {SCORED}, v AS ({PARTS} 1), s AS ({PARTS} 0), {ranking_sql('v', 'lang, i', 's', name='rv')}, {ranking_sql('s', 'lang, i', 's', name='rs')},
    c AS (SELECT rv.lang, rv.i, round(rv.ap, 9) AS v, round(rs.ap, 9) AS t FROM rv JOIN rs ON rv.lang IS NOT DISTINCT FROM rs.lang AND rv.i = rs.i WHERE rv.ap IS NOT NULL AND rs.ap IS NOT NULL), p AS (SELECT lang, max(v) AS top, max(t) AS most, max(t) FILTER (WHERE i IN (0, 100)) AS source, max(t) FILTER (WHERE i = 50) AS half FROM c GROUP BY 1),
    b AS (SELECT c.lang, arg_min(t, i) FILTER (WHERE v = top) AS tuned, (max(i) FILTER (WHERE v >= top - 0.001) - min(i) FILTER (WHERE v >= top - 0.001)) / 100 AS width FROM c JOIN p USING (lang) GROUP BY 1)
    SELECT lang, source, round(half - source, 9) AS fixed, round(tuned - source, 9) AS tuned, round(most - source, 9) AS oracle, round(width, 9) AS width, round(100 * (half - source) / nullif(round(tuned - source, 9), 0), 6) AS captured FROM p JOIN b USING (lang)""")
def combiner_lifts(spark, sf_dir):
    """What equal, tuned and best weights of two scores add to the better one, by language; even ids are the test rows."""
    df = frames.scored(spark, sf_dir)
    found = ranking.combiner_lifts(df.where("id % 2 = 1"), df.where("id % 2 = 0"), ("lang",), "a", "b", "y")
    return found.select("lang", "source", *[F.round(c, 9).alias(c) for c in ("fixed", "tuned", "oracle", "width")], F.round("captured", 6).alias("captured"))
