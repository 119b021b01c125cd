"""Queries over the reference tables, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import scalars as C
from evalloom.operators import audit, bootstrap, features, ranking, registry_tables, runs, splits
from evalloom.plans import (
    extended,  # noqa: F401  registers its queries
    frames,
    further,  # noqa: F401 - registers its queries
    mappings,  # noqa: F401 - registers its queries
    methods,
    preflights,  # noqa: F401 - registers its queries
)
from evalloom.plans.frames import DRAWS, RUNS, SCORED, ranking_sql, table
from evalloom.plans.registry import ORACLES, QUERIES, query
from evalloom.storage import cut

__all__ = ["ORACLES", "QUERIES", "flagship"]


def r9(*names: str) -> list:
    return [F.round(n, 9).alias(n) for n in names]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frames.scored(spark, sf_dir)
    point = ranking.ranking_metrics(df, ["lang"], "a", "y")
    draws = bootstrap.resampled(df, "cluster", "a", "y", 100, "flagship", ["lang"])
    ci = draws.groupBy("lang").agg(F.percentile("ap", 0.025).alias("ap_lo"), F.percentile("ap", 0.975).alias("ap_hi"), F.count("ap").alias("used"))
    return point.join(ci, "lang")


# Scans, joins and labels


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def align_intersection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT event_id, least(greatest(coalesce(trunc(nullif(value, 0) / 40 - 0.5), 0), 0), 1)::INT AS y FROM events")
def label_resolve_clip(spark, sf_dir):
    x = F.nullif(F.col("value"), F.lit(0.0)) / 40 - 0.5
    return table(spark, sf_dir, "events").select("event_id", C.binary_label(x).alias("y"))


@query("""WITH c AS (SELECT o_orderpriority, (row_number() OVER (ORDER BY o_orderpriority) - 1)::INT AS code
    FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderkey % 5 <> 0))
    SELECT o_orderkey, code FROM orders JOIN c USING (o_orderpriority) WHERE o_orderkey % 5 = 0""")
def class_codes_sorted(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    codes = registry_tables.class_codes(o.where("o_orderkey % 5 <> 0"), "o_orderpriority", "code")
    return o.where("o_orderkey % 5 = 0").join(codes, "o_orderpriority").select("o_orderkey", "code")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)")
def semi_join_rows(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(keys, "l_orderkey", "left_semi")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)")
def anti_join_unseen(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(seen, "c_custkey", "left_anti")


@query("""WITH a AS (SELECT user_id, min(ts)::DATE AS first_view FROM events WHERE event_type = 'view' GROUP BY 1),
    b AS (SELECT user_id, min(ts)::DATE AS first_other FROM events WHERE event_type <> 'view' GROUP BY 1)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, first_view::VARCHAR AS first_view, first_other::VARCHAR AS first_other FROM a FULL JOIN b ON a.user_id = b.user_id""")
def outer_date_align(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("d"))
    a = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("d").alias("first_view"))
    b = e.where("event_type <> 'view'").groupBy("user_id").agg(F.min("d").alias("first_other"))
    return a.join(b, "user_id", "full").select("user_id", F.col("first_view").cast("string").alias("first_view"), F.col("first_other").cast("string").alias("first_other"))


@query("""WITH s AS (SELECT l_orderkey, max(l_shipdate)::DATE AS posted FROM lineitem GROUP BY 1),
    d AS (SELECT o_orderkey, o_orderdate::DATE AS reg, posted FROM orders LEFT JOIN s ON o_orderkey = l_orderkey)
    SELECT o_orderkey, CASE WHEN reg < DATE '1995-06-30' THEN 'a' ELSE 'b' END AS slice FROM d
    WHERE posted > DATE '1995-06-30' AND reg <> DATE '1995-06-30'""")
def slice_ab_cutoff(spark, sf_dir):
    posted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("posted"))
    dates = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("reg")).join(posted, "o_orderkey", "left")
    return registry_tables.date_slices(dates, "o_orderkey", "reg", "posted", "1995-06-30")


# Scalars


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_size * 12.0 WHEN 1 THEN p_size * 1.0 WHEN 2 THEN round(p_size / 4.286, 9) WHEN 3 THEN round(p_size / 30.0, 9) ELSE NULL END::DOUBLE AS months FROM part""")
def refine_duration_months(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ("Years", "Months", "Weeks", "Days", "Ages"))), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(C.months(F.concat_ws(" ", F.col("p_size").cast("string"), unit)), 9).alias("months"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '5d' WHEN 1 THEN 'nan' WHEN 2 THEN ' ' || event_id || ' ' WHEN 3 THEN '-1.5e1' ELSE NULL END AS s FROM events)
    SELECT event_id, CASE event_id % 5 WHEN 2 THEN event_id::DOUBLE WHEN 3 THEN -15.0 END::DOUBLE AS x FROM t""")
def to_number_guarded(spark, sf_dir):
    i = F.col("event_id")
    s = F.when(i % 5 == 0, "5d").when(i % 5 == 1, "nan").when(i % 5 == 2, F.concat(F.lit(" "), i.cast("string"), F.lit(" "))).when(i % 5 == 3, "-1.5e1")
    return table(spark, sf_dir, "events").select("event_id", C.to_number(s).alias("x"))


@query("SELECT upper(substr(trim(p_type), 1, 3)) AS code, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1")
def code_prefix_rollup(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(C.code_prefix(F.col("p_type")).alias("code")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_brand").alias("brands"))


@query("SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g')::BIGINT AS num FROM customer")
def id_digits(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", C.id_digits(F.col("c_name")).alias("num"))


@query("SELECT p_partkey, coalesce(p_name, '') || ' ' || coalesce(nullif(p_brand, 'Brand#11'), '') || ' ' || coalesce(p_type, '') AS txt FROM part")
def concat_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.concat_text(F.col("p_name"), F.nullif(F.col("p_brand"), F.lit("Brand#11")), F.col("p_type")).alias("txt"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, 'that', ' ', 'gi'), 'the', ' ', 'gi'), 'on', ' ', 'gi')) AS masked FROM documents""")
def mask_phrases(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(C.mask_phrases(F.col("text"), ["the", "On", "that"], " ").cast("binary")).alias("masked"))


@query("""SELECT p_partkey, 'Name: ' || trim(p_name) || chr(10) || 'Brand: ' || coalesce(nullif(p_brand, 'Brand#11'), 'unknown') || chr(10) || 'Size: ' || p_size AS body FROM part""")
def render_record(spark, sf_dir):
    fields = {"Name": F.col("p_name"), "Brand": F.nullif(F.col("p_brand"), F.lit("Brand#11")), "Size": F.col("p_size")}
    return table(spark, sf_dir, "part").select("p_partkey", C.render_lines(fields).alias("body"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))::INT AS n_words FROM documents")
def unicode_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(C.words(F.col("text"))).alias("n_words"))


@query("""WITH d AS (SELECT doc_id, text, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents), 
    a AS (SELECT d.doc_id, d.w, e.w AS v FROM d JOIN d e ON e.doc_id = d.doc_id + 1)
    SELECT doc_id, round(len(list_intersect(w, v)) / nullif(len(w) + len(v) - len(list_intersect(w, v)), 0), 9) AS jaccard FROM a""")
def token_jaccard(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(C.words(F.col("text"))).alias("w"))
    e = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return d.join(e, "doc_id").select("doc_id", F.round(C.jaccard(F.col("w"), F.col("v")), 9).alias("jaccard"))


@query("""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark),
    bg AS (SELECT DISTINCT item_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM b, unnest(range(1, len(w) - 1)) t(i)),
    d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
    dg AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM d, unnest(range(1, len(w) - 1)) t(i)),
    n AS (SELECT item_id, count(*) AS n FROM bg GROUP BY 1)
    SELECT doc_id, item_id, round(count(*) / n.n, 9) AS recall FROM dg JOIN bg USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n.n HAVING count(*) * 2 >= n.n""")
def ngram_recall_benchmark(spark, sf_dir):
    grams = lambda t, k: table(spark, sf_dir, t).select(k, F.explode(C.ngrams(C.words(F.col("text")), 3)).alias("g"))
    items = grams("benchmark", "item_id")
    sizes = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    hits = grams("documents", "doc_id").join(items, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("c"))
    return hits.join(sizes, "item_id").where("c * 2 >= n").select("doc_id", "item_id", F.round(F.col("c") / F.col("n"), 9).alias("recall"))


@query("""WITH t AS (SELECT conv_id, turn, string_split_regex(trim(text), '\\s+') AS w FROM conversations), 
    c AS (SELECT *, greatest(5, floor(len(w) * 0.6))::INT AS k FROM t)
    SELECT conv_id, turn, md5(array_to_string(w[1:k], ' ')) AS prefix, md5(array_to_string(w[k+1:], ' ')) AS suffix FROM c""")
def prefix_suffix_split(spark, sf_dir):
    a, b = C.prefix_suffix(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(a.cast("binary")).alias("prefix"), F.md5(b.cast("binary")).alias("suffix"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS p FROM events
    WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 0 AND 100""")
def probability_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.probability(F.col("props"), "k").alias("p")).where("p is not null")


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\bno\\b') AND NOT regexp_matches(lower(text), '\\byes\\b') THEN 0
    WHEN regexp_matches(lower(text), '\\byes\\b') AND NOT regexp_matches(lower(text), '\\bno\\b') THEN 1 ELSE -1 END AS answer,
    coalesce(TRY_CAST(replace(nullif(regexp_extract(text, '([0-9][0-9,]*\\.?[0-9]*)', 1), ''), ',', '') AS DOUBLE), -1) AS num FROM conversations""")
def reply_parse(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(C.yes_no(F.col("text")), F.lit(-1)).alias("answer"), F.coalesce(C.first_number(F.col("text")), F.lit(-1.0)).alias("num"))


# Registry aggregations


@query("""SELECT l_orderkey, round(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) / nullif(coalesce(sum(l_quantity), 0), 0), 9) AS rate FROM lineitem GROUP BY 1""")
def pooled_event_rate(spark, sf_dir):
    df = registry_tables.pooled_rate(table(spark, sf_dir, "lineitem"), "l_orderkey", F.when(F.col("l_returnflag") == "R", F.col("l_quantity")), F.col("l_quantity"))
    return df.select("l_orderkey", *r9("rate"))


@query("SELECT l_orderkey, (coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 END), 0) > 0)::INT AS label FROM lineitem GROUP BY 1")
def any_event_label(spark, sf_dir):
    return registry_tables.any_event(table(spark, sf_dir, "lineitem"), "l_orderkey", F.when(F.col("l_returnflag") == "R", 1))


@query("SELECT l_orderkey, (sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) > 0)::INT AS label FROM lineitem GROUP BY 1")
def status_pivot_threshold(spark, sf_dir):
    return registry_tables.status_label(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linestatus", "O", F.col("l_quantity"))


@query("""SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def wide_counts_fixed_pivot(spark, sf_dir):
    return registry_tables.counts_by_type(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query("SELECT l_orderkey, string_agg(DISTINCT p_type, '; ' ORDER BY p_type) AS joined FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def joined_strings(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    return registry_tables.joined_strings(li.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey"), "l_orderkey", "p_type")


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def ordered_list_agg(spark, sf_dir):
    df = registry_tables.ordered_list(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")
    return df.select("conv_id", F.array_join("values", ">").alias("roles"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS r FROM orders) WHERE r = 1 GROUP BY 1")
def first_by_sort(spark, sf_dir):
    return registry_tables.first_by(table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""WITH t AS (SELECT nullif(event_type, 'view') AS event_type, CASE WHEN value > 50 THEN value END AS value, props FROM events)
    SELECT 'event_type' AS column, sum((event_type IS NULL)::INT)::BIGINT AS n_missing, round(avg((event_type IS NULL)::INT), 9) AS rate FROM t
    UNION ALL SELECT 'value', sum((value IS NULL)::INT)::BIGINT, round(avg((value IS NULL)::INT), 9) FROM t
    UNION ALL SELECT 'props', sum((props IS NULL)::INT)::BIGINT, round(avg((props IS NULL)::INT), 9) FROM t""")
def missing_rate_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.nullif(F.col("event_type"), F.lit("view")).alias("event_type"), F.when(F.col("value") > 50, F.col("value")).alias("value"), "props")
    return registry_tables.missing_rates(e, ["event_type", "value", "props"]).select("column", "n_missing", *r9("rate"))


@query("SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 4) AS mean, count(o_totalprice) AS n FROM orders GROUP BY 1, 2")
def crosstab_mean_count(spark, sf_dir):
    df = registry_tables.crosstab(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", F.col("o_totalprice"))
    return df.withColumn("mean", F.round("mean", 4))


@query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY 1")
def value_counts_norm(spark, sf_dir):
    return registry_tables.value_shares(table(spark, sf_dir, "events"), "event_type").select("event_type", "n", *r9("share"))


@query("SELECT least(floor(l_discount * 10), 9)::INT AS bin, count(*) AS n FROM lineitem WHERE l_discount IS NOT NULL GROUP BY 1")
def histogram10(spark, sf_dir):
    return registry_tables.histogram(table(spark, sf_dir, "lineitem"), F.col("l_discount"))


@query("SELECT count(*) AS n_distinct, max(c) AS largest, round(max(c) / sum(c), 9) AS share FROM (SELECT l_quantity, count(*) AS c FROM lineitem GROUP BY 1)")
def tie_profile(spark, sf_dir):
    return registry_tables.tie_profile(table(spark, sf_dir, "lineitem"), "l_quantity").select("n_distinct", "largest", *r9("share"))


@query("SELECT date_trunc('week', ts)::DATE::VARCHAR AS week, count(*) AS n FROM events GROUP BY 1")
def weekly_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).cast("string").alias("week")).agg(F.count(F.lit(1)).alias("n"))


# Features


@query("""WITH t AS (SELECT c_name, c_custkey::VARCHAR AS code, CASE WHEN c_custkey % 10 < 6 THEN NULL ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 10 < 3 THEN NULL ELSE c_acctbal::VARCHAR END AS bal FROM customer)
    SELECT 'c_name' AS column, 0.0::DOUBLE AS missing, 'categorical' AS kind UNION ALL SELECT 'code', 0.0, 'numeric'
    UNION ALL SELECT 'seg', round(avg((seg IS NULL)::INT), 9), 'dropped' FROM t
    UNION ALL SELECT 'bal', round(avg((bal IS NULL)::INT), 9), CASE WHEN avg((bal IS NOT NULL)::INT) >= 0.7 THEN 'numeric' ELSE 'categorical' END FROM t""")
def column_kind_inference(spark, sf_dir):
    key = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select("c_name", key.cast("string").alias("code"), F.when(key % 10 >= 6, F.col("c_mktsegment")).alias("seg"), F.when(key % 10 >= 3, F.col("c_acctbal").cast("string")).alias("bal"))
    return features.column_kinds(t, ["c_name", "code", "seg", "bal"]).select("column", *r9("missing"), "kind")


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events)
    SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM t WHERE event_id % 5 <> 0)), 9) AS value FROM t WHERE event_id % 5 = 0""")
def median_impute(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    fitted = features.medians(t.where("event_id % 5 <> 0"), ["value"])
    return features.impute(t.where("event_id % 5 = 0"), fitted, ["value"]).select("event_id", *r9("value"))


TE = """t AS (SELECT o_orderkey, coalesce(nullif(c_mktsegment, 'BUILDING'), '__nan__') AS level, (o_orderstatus = 'F')::INT AS y FROM orders JOIN customer ON o_custkey = c_custkey),
    tr AS (SELECT * FROM t WHERE o_orderkey % 4 <> 0),
    te AS (SELECT level, count(*) AS n, (sum(y) + 20 * (SELECT avg(y) FROM tr)) / (count(*) + 20) AS encoding FROM tr GROUP BY 1)"""


def encoding_frame(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey").select("o_orderkey", "segment", (F.col("o_orderstatus") == "F").cast("int").alias("y"))


@query(f"WITH {TE} SELECT level, n, round(encoding, 9) AS encoding FROM te")
def target_encode_fit(spark, sf_dir):
    return features.fit_target_encoding(encoding_frame(spark, sf_dir).where("o_orderkey % 4 <> 0"), "segment", "y").select("level", "n", *r9("encoding"))


@query(f"WITH {TE} SELECT o_orderkey, round(coalesce(encoding, (SELECT avg(y) FROM tr)), 9) AS encoding FROM t LEFT JOIN te USING (level) WHERE o_orderkey % 4 = 0")
def target_encode_apply(spark, sf_dir):
    df = encoding_frame(spark, sf_dir)
    fitted = features.fit_target_encoding(df.where("o_orderkey % 4 <> 0"), "segment", "y")
    return features.apply_target_encoding(df.where("o_orderkey % 4 = 0"), fitted, "segment").select("o_orderkey", *r9("encoding"))


@query("""SELECT 'p_brand' AS column, p_brand AS level FROM (SELECT DISTINCT p_brand FROM part) WHERE (SELECT count(DISTINCT p_brand) FROM part) <= 40
    UNION ALL SELECT 'p_type', p_type FROM (SELECT DISTINCT p_type FROM part) WHERE (SELECT count(DISTINCT p_type) FROM part) <= 40
    UNION ALL SELECT 'p_name', p_name FROM (SELECT DISTINCT p_name FROM part) WHERE (SELECT count(DISTINCT p_name) FROM part) <= 40""")
def onehot_capped(spark, sf_dir):
    return features.onehot_levels(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_name"])


TERMS = """terms AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM documents)),
    vocab AS (SELECT t, count(*) AS df FROM terms GROUP BY 1 HAVING count(*) >= 10)"""


def term_frame(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(C.words(F.col("text"))).alias("t"))


@query(f"WITH {TERMS} SELECT t, df, row_number() OVER (ORDER BY encode(t)) - 1 AS place FROM vocab")
def vocab_min_df(spark, sf_dir):
    return features.vocabulary(term_frame(spark, sf_dir), "doc_id", "t")


@query(f"WITH {TERMS}, v AS (SELECT t, row_number() OVER (ORDER BY encode(t)) - 1 AS place FROM vocab) SELECT doc_id, count(*) AS bits, sum(place)::BIGINT AS places FROM terms JOIN v USING (t) GROUP BY 1")
def multihot_long(spark, sf_dir):
    terms = term_frame(spark, sf_dir)
    hot = features.multi_hot(terms, features.vocabulary(terms, "doc_id", "t"), "doc_id", "t")
    return hot.groupBy("doc_id").agg(F.count(F.lit(1)).alias("bits"), F.sum("place").alias("places"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')))::INT AS n_terms, (len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) > 0)::INT AS has_terms FROM documents")
def presence_counts(spark, sf_dir):
    return features.presence(table(spark, sf_dir, "documents").select("doc_id", C.words(F.col("text")).alias("w")), "doc_id", "w")


@query("""SELECT r_name, n_name, count(*) AS suppliers, round(sum(s_acctbal), 4) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def hierarchy_levels(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("suppliers"), F.round(F.sum("s_acctbal"), 4).alias("balance"))


@query("SELECT label, pos::INT AS pos, round(avg(x), 6) AS value FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2")
def embedding_mean_pool(spark, sf_dir):
    return features.pooled_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "pos", F.round("value", 6).alias("value"))


@query("SELECT label, pos::INT AS pos, max(x) AS value FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2")
def embedding_max_pool(spark, sf_dir):
    return features.pooled_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding", "max")


NEAR = """near AS (SELECT q.vec_id, c.vec_id AS other, c.label, round(list_dot_product(q.e, c.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(c.e, c.e)), 9) AS cosine
    FROM (SELECT *, embedding::DOUBLE[] AS e FROM embeddings) q JOIN (SELECT *, embedding::DOUBLE[] AS e FROM embeddings) c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, other) AS rank FROM near)"""


def neighbours(spark, sf_dir, k):
    e = table(spark, sf_dir, "embeddings")
    return audit.nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", k)


@query(f"WITH {NEAR} SELECT vec_id, other, round(cosine, 7) AS cosine, rank::INT AS rank FROM ranked WHERE rank <= 5")
def topk_neighbors(spark, sf_dir):
    return neighbours(spark, sf_dir, 5).select("vec_id", "other", C.half_up(F.col("cosine"), 7).alias("cosine"), "rank")


@query(f"WITH {NEAR}, v AS (SELECT vec_id, label, count(*) AS votes FROM ranked WHERE rank <= 25 GROUP BY 1, 2) SELECT vec_id, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, label) AS r FROM v) WHERE r = 1")
def knn_vote(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("other"), "label")
    votes = neighbours(spark, sf_dir, 25).join(labels, "other").groupBy("vec_id", "label").agg(F.count(F.lit(1)).alias("votes"))
    return registry_tables.first_by(votes, "vec_id", [F.desc("votes"), F.col("label")])


TFIDF = """counts AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM documents) GROUP BY 1, 2),
    idf AS (SELECT t, ln((1 + (SELECT count(*) FROM documents WHERE doc_id % 5 <> 0)) / (1 + count(*))) + 1 AS idf FROM counts WHERE doc_id % 5 <> 0 GROUP BY 1 HAVING count(*) >= 2),
    raw AS (SELECT doc_id, t, (1 + ln(tf)) * idf AS x FROM counts JOIN idf USING (t)),
    w AS (SELECT doc_id, t, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def tfidf_frame(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = features.term_counts(docs, "doc_id", "text")
    idf = features.fit_idf(counts.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 <> 0").count())
    return features.tfidf(counts, idf, "doc_id")


@query(f"WITH {TFIDF} SELECT doc_id, count(*) AS terms, round(max(weight), 9) AS top, round(sum(weight), 6) AS total FROM w GROUP BY 1")
def tfidf_weights(spark, sf_dir):
    return tfidf_frame(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.max("weight"), 9).alias("top"), F.round(F.sum("weight"), 6).alias("total"))


SIMS = f"""{TFIDF}, dots AS (SELECT a.doc_id, b.doc_id AS other, sum(a.weight * b.weight) AS dot FROM w a JOIN w b USING (t) WHERE a.doc_id % 5 = 0 AND b.doc_id % 5 <> 0 GROUP BY 1, 2),
    sims AS (SELECT q.doc_id, coalesce(max(dot), 0) AS sim FROM (SELECT DISTINCT doc_id FROM w WHERE doc_id % 5 = 0) q LEFT JOIN dots USING (doc_id) GROUP BY 1)"""


def similarities(spark, sf_dir, floor=0.0):
    """Weights are made once and lie as arrays: a term's rows are shuffled once to meet its weight and once back to their document."""
    docs = table(spark, sf_dir, "documents")
    corpus = docs.where("doc_id % 5 <> 0")
    seen = corpus.select(F.explode(F.array_distinct(C.words(F.col("text")))).alias("term"), F.lit(1).alias("tf"))
    idf = audit.by_rarity(features.fit_idf(seen, corpus.count()))
    raw = features.term_counts_in_place(docs, "doc_id", "text").join(idf, "term").withColumn("x", (1 + F.log("tf")) * F.col("idf"))
    vectors = cut(audit.packed(raw, "doc_id", "place", "x"), "vectors")
    return audit.highest_cosines(vectors.where("doc_id % 5 = 0"), vectors.where("doc_id % 5 <> 0"), "doc_id", floor)


@query(f"WITH {SIMS} SELECT doc_id, round(sim, 6) AS sim FROM sims")
def neardup_max_cosine(spark, sf_dir):
    return similarities(spark, sf_dir).select("doc_id", F.round("sim", 6).alias("sim"))


@query(f"WITH {SIMS} SELECT th::DOUBLE AS threshold, count(*) FILTER (WHERE sim > th) AS dropped, round(avg((sim > th)::INT), 9) AS rate FROM sims, (VALUES (0.85), (0.9), (0.95), (0.99)) t(th) GROUP BY 1")
def dup_rate_by_threshold(spark, sf_dir):
    at = (0.85, 0.9, 0.95, 0.99)
    each = similarities(spark, sf_dir, min(at)).withColumn("threshold", F.explode(F.array(*map(F.lit, at))))
    above = (F.col("sim") > F.col("threshold")).cast("int")
    return each.groupBy("threshold").agg(F.sum(above).alias("dropped"), F.round(F.avg(above), 9).alias("rate"))


@query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


# Metrics


@query(f"WITH {SCORED}, {ranking_sql('scored', '', 'a')} SELECT round(ap, 9) AS ap, round(auroc, 9) AS auroc, n_pos, n_neg FROM ranked")
def average_precision(spark, sf_dir):
    return ranking.ranking_metrics(frames.scored(spark, sf_dir), [], "a", "y").select(*r9("ap", "auroc"), "n_pos", "n_neg")


@query(f"WITH {SCORED}, {ranking_sql('scored', 'lang', 'a')} SELECT lang, round(ap, 9) AS ap, round(auroc, 9) AS auroc, n_pos, n_neg FROM ranked")
def metrics_by_group(spark, sf_dir):
    return ranking.ranking_metrics(frames.scored(spark, sf_dir), ["lang"], "a", "y").select("lang", *r9("ap", "auroc"), "n_pos", "n_neg")


@query(f"WITH {SCORED}, {ranking_sql('scored', 'lang', 'b')} SELECT lang, round(ap - n_pos / (n_pos + n_neg), 9) AS skill FROM ranked")
def skill_over_base(spark, sf_dir):
    m = ranking.ranking_metrics(frames.scored(spark, sf_dir), ["lang"], "b", "y")
    return m.select("lang", F.round(F.col("ap") - F.col("n_pos") / (F.col("n_pos") + F.col("n_neg")), 9).alias("skill"))


@query(f"""WITH {SCORED}, c AS (SELECT lang, sum((a > 1500)::INT * y) AS tp, sum((a > 1500)::INT * (1 - y)) AS fp, sum((a <= 1500)::INT * y) AS fn, sum((a <= 1500)::INT * (1 - y)) AS tn FROM scored GROUP BY 1)
    SELECT lang, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round(tn / nullif(tn + fp, 0), 9) AS specificity, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 9) AS balanced_accuracy FROM c""")
def binary_threshold_metrics(spark, sf_dir):
    m = ranking.threshold_metrics(frames.scored(spark, sf_dir), ["lang"], (F.col("a") > 1500).cast("int"), "y")
    return m.select("lang", *r9("accuracy", "precision", "recall", "f1", "specificity", "balanced_accuracy"))


@query(f"""WITH e AS (SELECT label % 3 AS klass, embedding::DOUBLE[] AS e FROM embeddings), long AS (SELECT k, e[k + 1] AS s, (klass = k)::INT AS y FROM e, range(0, 3) t(k)),
    {ranking_sql('long', 'k', 's')} SELECT round(avg(ap) FILTER (WHERE n_pos > 0), 9) AS macro_ap, CASE WHEN bool_and(n_pos > 0) THEN round(avg(auroc), 9) END AS macro_auroc, count(*) FILTER (WHERE n_pos > 0) AS n_classes FROM ranked""")
def macro_ovr(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("klass"), *[F.col("embedding")[k].cast("double").alias(f"s{k}") for k in range(3)])
    return ranking.macro_ovr(e, "klass", ["s0", "s1", "s2"]).select(*r9("macro_ap", "macro_auroc"), "n_classes")


PCT = "SELECT id, lang, (rank() OVER (PARTITION BY lang ORDER BY {v}) + (count(*) OVER (PARTITION BY lang, {v}) - 1) / 2 - 1) / greatest(count(*) OVER (PARTITION BY lang) - 1, 1) AS pct FROM scored"


@query(f"WITH {SCORED} SELECT id, round(pct, 9) AS pct FROM ({PCT.format(v='a')})")
def rank_percentile(spark, sf_dir):
    return ranking.rank_percentile(frames.scored(spark, sf_dir), ["lang"], "a").select("id", *r9("pct"))


@query(f"WITH {SCORED} SELECT id, round((x.pct + z.pct) / 2, 9) AS consensus FROM ({PCT.format(v='a')}) x JOIN ({PCT.format(v='b')}) z USING (id)")
def consensus_rank(spark, sf_dir):
    df = frames.scored(spark, sf_dir)
    x = ranking.rank_percentile(df, ["lang"], "a").select("id", F.col("pct").alias("x"))
    return x.join(ranking.rank_percentile(df, ["lang"], "b").select("id", "pct"), "id").select("id", F.round((F.col("x") + F.col("pct")) / 2, 9).alias("consensus"))


@query(f"WITH {SCORED} SELECT x.lang, round(corr(x.pct, z.pct), 9) AS spearman, round(avg(abs(x.pct - z.pct)), 9) AS rank_shift FROM ({PCT.format(v='a')}) x JOIN ({PCT.format(v='b')}) z USING (id) GROUP BY 1")
def spearman_rank_shift(spark, sf_dir):
    df = frames.scored(spark, sf_dir)
    x = ranking.rank_percentile(df, ["lang"], "a").select("id", "lang", F.col("pct").alias("x"))
    both = x.join(ranking.rank_percentile(df, ["lang"], "b").select("id", "pct"), "id")
    return both.groupBy("lang").agg(F.round(F.corr("x", "pct"), 9).alias("spearman"), F.round(F.avg(F.abs(F.col("x") - F.col("pct"))), 9).alias("rank_shift"))


EACH = "SELECT i, round((i * a + (100 - i) * b) / 100, 9) AS s, y FROM scored, range(0, 101) t(i)"


@query(f"WITH {SCORED}, each AS ({EACH}), {ranking_sql('each', 'i', 's')} SELECT i / 100 AS w, round(ap, 9) AS ap FROM ranked")
def blend_curve(spark, sf_dir):
    return ranking.blend_curve(frames.scored(spark, sf_dir), "a", "b", "y").select("w", *r9("ap"))


@query(f"""WITH {SCORED}, v AS ({EACH} WHERE id % 5 = 1), s AS ({EACH} WHERE id % 5 = 0), {ranking_sql('v', 'i', 's', name='rv')}, {ranking_sql('s', 'i', 's', name='rs')},
    c AS (SELECT i, round(ap, 9) AS ap FROM rv), p AS (SELECT min(i) FILTER (WHERE ap = top) AS i, max(top) AS valid_ap, (max(i) FILTER (WHERE ap >= top - 0.001) - min(i) FILTER (WHERE ap >= top - 0.001)) / 100 AS width FROM c, (SELECT max(ap) AS top FROM c))
    SELECT i / 100 AS best_w, valid_ap, round(width, 9) AS width, round(rs.ap, 9) AS test_ap FROM p JOIN rs USING (i)""")
def blend_best_weight(spark, sf_dir):
    df = frames.scored(spark, sf_dir)
    best = ranking.best_weight(df.where("id % 5 = 1"), df.where("id % 5 = 0"), "a", "b", "y")
    return best.select("best_w", "valid_ap", *r9("width", "test_ap"))


BINS = "edges AS (SELECT list_distinct(list_sort(quantile_cont(a, [0.2, 0.4, 0.6, 0.8]))) AS e FROM scored WHERE id % 5 <> 0), binned AS (SELECT s.*, len(list_filter(e, lambda x: x <= a))::INT AS bin FROM scored s, edges)"


@query(f"WITH {SCORED}, {BINS} SELECT bin, count(*) AS n, round(avg(y), 9) AS rate FROM binned WHERE id % 5 = 0 GROUP BY 1")
def quantile_bins_train_only(spark, sf_dir):
    df = frames.scored(spark, sf_dir)
    return audit.fitted_bins(df.where("id % 5 <> 0"), df.where("id % 5 = 0"), "a", 5).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 9).alias("rate"))


@query(f"WITH {SCORED}, {BINS}, {ranking_sql('binned', 'bin', 'b')}, g AS (SELECT *, CASE WHEN n_pos + n_neg >= 20 THEN auroc END AS v FROM ranked) SELECT round(sum(v * (n_pos + n_neg)) / sum(n_pos + n_neg) FILTER (WHERE v IS NOT NULL), 9) AS pooled, count(v) AS n_strata FROM g")
def stratified_pooled_metric(spark, sf_dir):
    df = frames.scored(spark, sf_dir)
    m = ranking.ranking_metrics(audit.fitted_bins(df.where("id % 5 <> 0"), df, "a", 5), ["bin"], "b", "y").withColumn("n", F.col("n_pos") + F.col("n_neg"))
    return audit.stratum_weighted(m.withColumn("auroc", F.when(F.col("n") >= 20, F.col("auroc"))), "auroc", "n").select(*r9("pooled"), "n_strata")


# Splits


@query("""WITH s AS (SELECT lang, count(*) AS n, count(*) * 137 / sum(count(*)) OVER () AS x FROM documents GROUP BY 1), f AS (SELECT *, floor(x) AS f, 137 - sum(floor(x)) OVER () AS short, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, lang) AS r FROM s)
    SELECT lang, n, (f + (r <= short)::INT)::BIGINT AS quota FROM f""")
def largest_remainder_alloc(spark, sf_dir):
    return splits.largest_remainder(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", "n", 137)


@query("""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('split|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)
    SELECT doc_id, CASE WHEN r <= ceil(n * 0.2) THEN 'valid' ELSE 'train' END AS split FROM r""")
def stratified_split_hash(spark, sf_dir):
    return splits.stratified_split(table(spark, sf_dir, "labels"), "doc_id", "quality", 0.2, "split").select("doc_id", "split")


@query("""WITH s AS (SELECT lang, count(*) * 137 / sum(count(*)) OVER () AS x FROM documents GROUP BY 1), f AS (SELECT *, floor(x) AS f, 137 - sum(floor(x)) OVER () AS short, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, lang) AS r FROM s),
    p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('subset|' || doc_id), doc_id) AS r FROM documents)
    SELECT doc_id, p.lang FROM p JOIN f USING (lang) WHERE p.r <= f + (f.r <= short)::INT""")
def fixed_subset(spark, sf_dir):
    return splits.stratified_subset(table(spark, sf_dir, "documents"), "doc_id", "lang", 137, "subset")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY sha256('folds|' || doc_id), doc_id) - 1) % 5)::INT AS fold FROM labels")
def random_folds(spark, sf_dir):
    return splits.random_folds(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 5, "folds")


@query("""WITH RECURSIVE f AS (SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS k FROM part WHERE p_type IS NOT NULL GROUP BY 1),
    deal AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS loads, NULL::VARCHAR AS p_type, NULL::BIGINT AS n, NULL::BIGINT AS fold
        UNION ALL SELECT f.k, list_transform(d.loads, lambda x, i: CASE WHEN i = list_position(d.loads, list_min(d.loads)) THEN x + f.n ELSE x END), f.p_type, f.n, list_position(d.loads, list_min(d.loads)) - 1 FROM deal d JOIN f ON f.k = d.k + 1)
    SELECT p_type, n, fold::INT AS fold FROM deal WHERE k > 0""")
def family_holdout_folds(spark, sf_dir):
    return splits.family_folds(table(spark, sf_dir, "part"), "p_type", 5)


# Resampling


def ci_sql(values: str, column: str) -> str:
    return f"SELECT round(avg({column}), 9) AS mean, round(quantile_cont({column}, 0.025), 9) AS lo, round(quantile_cont({column}, 0.975), 9) AS hi, round(stddev_pop({column}), 9) AS std, count({column}) AS used, count(*) AS requested FROM {values}"


def ci(values, column):
    return bootstrap.interval(values, column).select(*r9("mean", "lo", "hi", "std"), "used", "requested")


W = "weighted AS (SELECT w.draw, w.w, s.* FROM scored s JOIN weights w ON s.cluster = w.cluster)"


@query(f"WITH {SCORED}, {DRAWS.format(seed='boot', draws=50)}, {W}, {ranking_sql('weighted', 'draw', 'a', weight='w')} {ci_sql('ranked', 'ap')}")
def bootstrap_cluster_ci(spark, sf_dir):
    return ci(bootstrap.resampled(frames.scored(spark, sf_dir), "cluster", "a", "y", 50, "boot"), "ap")


@query(f"WITH {SCORED.replace('d.source AS cluster', 'd.doc_id AS cluster')}, {DRAWS.format(seed='row', draws=20)}, {W}, {ranking_sql('weighted', 'draw', 'a', weight='w')} {ci_sql('ranked', 'auroc')}")
def bootstrap_row_ci(spark, sf_dir):
    return ci(bootstrap.resampled(frames.scored(spark, sf_dir), "id", "a", "y", 20, "row"), "auroc")


@query(f"WITH {SCORED}, {DRAWS.format(seed='pair', draws=50)}, {W}, {ranking_sql('weighted', 'draw', 'a', weight='w', name='ra')}, {ranking_sql('weighted', 'draw', 'b', weight='w', name='rb')}, d AS (SELECT ra.ap - rb.ap AS delta FROM ra JOIN rb USING (draw)) {ci_sql('d', 'delta')}")
def bootstrap_paired(spark, sf_dir):
    return ci(bootstrap.paired(frames.scored(spark, sf_dir), "cluster", "a", "b", "y", 50, "pair"), "delta")


@query(f"""WITH {SCORED}, {DRAWS.format(seed='ratio', draws=50)}, {W}, {ranking_sql('weighted', 'draw', 'a', weight='w', name='ra')}, {ranking_sql('weighted', 'draw', 'b', weight='w', name='rb')},
    d AS (SELECT (ra.auroc - 0.5) / nullif(rb.auroc, 0) AS ratio FROM ra JOIN rb USING (draw)) {ci_sql('d', 'ratio')}""")
def bootstrap_ratio(spark, sf_dir):
    p = bootstrap.paired(frames.scored(spark, sf_dir), "cluster", "a", "b", "y", 50, "ratio", "auroc")
    return ci(p.withColumn("ratio", (F.col("a") - 0.5) / F.nullif(F.col("b"), F.lit(0.0))), "ratio")


def half(name: str, source: str, even: int, seed: str, score: str = "a") -> str:
    return f"""{name}u AS (SELECT cluster, row_number() OVER (ORDER BY sha256('unit|' || cluster)) - 1 AS k FROM (SELECT DISTINCT cluster FROM {source} WHERE id % 2 = {even})),
    {name}d AS (SELECT draw, ('0x' || substr(sha256('{seed}|' || draw || '|' || u.k), 1, 8))::BIGINT % (SELECT count(*) FROM {name}u) AS k FROM {name}u u, range(1, 51) t(draw)),
    {name}w AS (SELECT d.draw, u.cluster, count(*) AS w FROM {name}d d JOIN {name}u u ON d.k = u.k GROUP BY ALL),
    {name}s AS (SELECT w.draw, w.w, s.* FROM {source} s JOIN {name}w w ON s.cluster = w.cluster WHERE s.id % 2 = {even})"""


@query(f"WITH {SCORED}, {half('x', 'scored', 0, 's1')}, {half('z', 'scored', 1, 's2')}, {ranking_sql('xs', 'draw', 'a', weight='w', name='rx')}, {ranking_sql('zs', 'draw', 'a', weight='w', name='rz')}, d AS (SELECT rx.ap - rz.ap AS delta FROM rx JOIN rz USING (draw)) {ci_sql('d', 'delta')}")
def bootstrap_two_sample(spark, sf_dir):
    df = frames.scored(spark, sf_dir)
    return ci(bootstrap.two_sample(df.where("id % 2 = 0"), df.where("id % 2 = 1"), "cluster", "a", "y", 50, ("s1", "s2")), "delta")


@query(f"""WITH {SCORED}, {half('x', 'scored', 0, 's1')}, {half('z', 'scored', 1, 's2')}, {ranking_sql('xs', 'draw', 'a', weight='w', name='xa')}, {ranking_sql('xs', 'draw', 'b', weight='w', name='xb')},
    {ranking_sql('zs', 'draw', 'a', weight='w', name='za')}, {ranking_sql('zs', 'draw', 'b', weight='w', name='zb')},
    d AS (SELECT xa.ap - za.ap AS da, xb.ap - zb.ap AS db FROM xa JOIN xb USING (draw) JOIN za USING (draw) JOIN zb USING (draw)) SELECT round(avg(da - db), 9) AS did, round(quantile_cont(da - db, 0.025), 9) AS lo, round(quantile_cont(da - db, 0.975), 9) AS hi, round(corr(da, db), 6) AS rho FROM d""")
def bootstrap_did(spark, sf_dir):
    df = frames.scored(spark, sf_dir)
    x, z = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    arms = [bootstrap.two_sample(x, z, "cluster", s, "y", 50, ("s1", "s2")).select("draw", F.col("delta").alias(f"d{s}")) for s in "ab"]
    gap = F.col("da") - F.col("db")
    return arms[0].join(arms[1], "draw").agg(F.round(F.avg(gap), 9).alias("did"), F.round(F.percentile(gap, 0.025), 9).alias("lo"), F.round(F.percentile(gap, 0.975), 9).alias("hi"), F.round(F.corr("da", "db"), 6).alias("rho"))


@query(f"""WITH {SCORED}, p AS (SELECT cluster, avg(a) AS x, avg(y) AS z FROM scored GROUP BY 1), {DRAWS.format(seed='slope', draws=50)}, s AS (SELECT draw, sum(w) AS n, sum(w*x) AS sx, sum(w*z) AS sz, sum(w*x*x) AS sxx, sum(w*x*z) AS sxz FROM p JOIN weights USING (cluster) GROUP BY 1),
    d AS (SELECT CASE WHEN abs(n*sxx - sx*sx) < 1e-9 THEN 0 ELSE (n*sxz - sx*sz) / (n*sxx - sx*sx) END AS slope FROM s) {ci_sql('d', 'slope')}""")
def ols_slope_bootstrap(spark, sf_dir):
    points = frames.scored(spark, sf_dir).groupBy("cluster").agg(F.avg("a").alias("x"), F.avg("y").alias("z"))
    return ci(bootstrap.slope_draws(points, "cluster", "x", "z", 50, "slope"), "slope")


# Runs


@query(f"WITH {RUNS}, t AS (SELECT seed, count(DISTINCT cell) AS n FROM runs GROUP BY 1) SELECT method, seed, count(DISTINCT cell) || '/' || t.n AS coverage FROM runs JOIN t USING (seed) GROUP BY method, seed, t.n")
def coverage_matrix(spark, sf_dir):
    return runs.coverage(frames.runs(spark, sf_dir), "method", "seed", "cell")


@query(f"""WITH {RUNS}, c AS (SELECT method, cell, avg(value) AS x FROM runs GROUP BY 1, 2), s AS (SELECT cell FROM c GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT method) FROM runs)),
    m AS (SELECT method, avg(x) AS mean, count(*) AS n_cells FROM c WHERE cell IN (SELECT cell FROM s) GROUP BY 1) SELECT method, round(mean, 9) AS mean, n_cells, row_number() OVER (ORDER BY round(mean, 9) DESC, method)::INT AS place FROM m""")
def shared_cells_mean(spark, sf_dir):
    return runs.leaderboard(frames.runs(spark, sf_dir), "method", "cell", "value").select("method", *r9("mean"), "n_cells", "place")


@query(f"WITH {RUNS}, s AS (SELECT method, cell, count(DISTINCT seed) AS k FROM runs GROUP BY 1, 2) SELECT method, bool_and(k >= 5) AS complete FROM s GROUP BY 1")
def completeness_filter(spark, sf_dir):
    return runs.complete_cells(frames.runs(spark, sf_dir), "method", "cell", "seed", 5)


@query(f"WITH {RUNS} SELECT cell, method, value AS valid, half AS test FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value DESC, method) AS r FROM runs WHERE seed = 1) WHERE r = 1")
def argmax_on_valid(spark, sf_dir):
    return runs.best_on_valid(frames.runs(spark, sf_dir).where("seed = 1"), "cell", "method", "value", "half").select("cell", "method", F.col("value").alias("valid"), F.col("half").alias("test"))


@query(f"WITH {RUNS}, p AS (SELECT cell, method, stddev_samp(value) AS sd, avg(half) AS hw FROM runs GROUP BY 1, 2) SELECT cell, round(greatest(1.96 * sqrt(avg(sd * sd)), avg(hw)), 9) AS floor FROM p GROUP BY 1")
def noise_floor(spark, sf_dir):
    return runs.noise_floor(frames.runs(spark, sf_dir), "cell", "method", "value", "half").select("cell", *r9("floor"))


@query(f"WITH {RUNS} SELECT a.method, round(avg(a.value - b.value), 9) AS gain, count(*) AS n FROM runs a JOIN runs b ON a.method = b.method AND a.cell = b.cell WHERE a.seed = 2 AND b.seed = 1 GROUP BY 1")
def paired_gain(spark, sf_dir):
    df = frames.runs(spark, sf_dir)
    return runs.paired_gain(df.where("seed = 1"), df.where("seed = 2"), ["method", "cell"], "value", "method").select("method", *r9("gain"), "n")


@query(f"""WITH {RUNS}, c AS (SELECT cell, avg(value) FILTER (WHERE method = 'm0') AS base, avg(value) FILTER (WHERE method = 'm1') AS better, avg(value) FILTER (WHERE method = 'm2') AS top FROM runs GROUP BY 1)
    SELECT round(quantile_cont((better - base) / nullif(top - base, 0), 0.5), 6) AS median_closure, count((better - base) / nullif(top - base, 0)) AS n FROM c""")
def gap_closure(spark, sf_dir):
    pick = lambda m: F.avg(F.when(F.col("method") == m, F.col("value")))
    cells = frames.runs(spark, sf_dir).groupBy("cell").agg(pick("m0").alias("base"), pick("m1").alias("better"), pick("m2").alias("top"))
    return runs.gap_closure(cells, "base", "better", "top").select(F.round("median_closure", 6).alias("median_closure"), "n")


@query("""SELECT role, sum(length(text))::BIGINT AS tokens_in, sum(turn)::BIGINT AS tokens_out, round(sum(length(text) * CASE role WHEN 'user' THEN 3.0 WHEN 'assistant' THEN 15.0 ELSE 1.0 END + turn * 5.0) / 1e6, 9) AS usd FROM conversations GROUP BY 1""")
def cost_rollup(spark, sf_dir):
    prices = spark.createDataFrame([("user", 3.0, 5.0), ("assistant", 15.0, 5.0), ("system", 1.0, 5.0)], "role string, usd_in double, usd_out double")
    calls = table(spark, sf_dir, "conversations").select("role", F.length("text").cast("bigint").alias("tokens_in"), F.col("turn").alias("tokens_out"))
    return runs.cost(calls, prices, "role", "role").select("role", "tokens_in", "tokens_out", *r9("usd"))


@query("""WITH p AS (SELECT DISTINCT sha256(text) AS k FROM conversations WHERE role = 'user'), c AS (SELECT DISTINCT sha256(text) AS k FROM conversations WHERE role = 'user' AND conv_id % 3 = 0) SELECT k FROM p WHERE k NOT IN (SELECT k FROM c)""")
def cache_miss_set(spark, sf_dir):
    keys = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", F.sha2("text", 256).alias("k"))
    return keys.select("k").distinct().join(keys.where("conv_id % 3 = 0").select("k"), "k", "left_anti")


@query(f"WITH {RUNS}, g AS (SELECT 'm' || m AS method, c::INT AS cell, s::INT AS seed FROM range(0, 7) t(m), range(0, 9) u(c), range(1, 8) v(s)) SELECT g.* FROM g LEFT JOIN runs USING (method, cell, seed) WHERE runs.value IS NULL")
def grid_cross_resume(spark, sf_dir):
    span = lambda a, b, n: spark.range(a, b).select(F.col("id").cast("int").alias(n))
    grid = span(0, 7, "m").crossJoin(span(0, 9, "cell")).crossJoin(span(1, 8, "seed")).select(F.concat(F.lit("m"), "m").alias("method"), "cell", "seed", F.lit("v1").alias("config"))
    done = frames.runs(spark, sf_dir).select("method", "cell", "seed", F.lit("v1").alias("config"))
    return runs.to_run(grid, done, ["method", "cell", "seed"], "config").drop("config")


# Pairing and mapping


@query("""WITH p AS (SELECT a.p_partkey, b.p_partkey AS other, abs(a.p_partkey - b.p_partkey) AS gap, row_number() OVER (PARTITION BY a.p_partkey, lower(trim(b.p_name)) ORDER BY abs(a.p_partkey - b.p_partkey), b.p_partkey) AS of_title
    FROM part a JOIN part b ON a.p_partkey <> b.p_partkey AND lower(trim(a.p_name)) <> lower(trim(b.p_name)))
    SELECT p_partkey, other, gap, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY gap, other) AS rank FROM p WHERE of_title = 1) WHERE rank <= 5""")
def nearest_by_number(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("num"), "p_name")
    return audit.nearest_by_number(p, "p_partkey", "num", "p_name", 5)


@query("""WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS j FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS j FROM orders WHERE o_orderstatus = 'O')
    SELECT a.o_custkey, a.j::INT AS occurrence, a.o_orderkey AS left_key, b.o_orderkey AS right_key FROM a JOIN b USING (o_custkey, j)""")
def occurrence_pairing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    side = lambda s, n: o.where(F.col("o_orderstatus") == s).select("o_custkey", F.col("o_orderkey").alias(n))
    return audit.pair_occurrences(side("F", "left_key"), side("O", "right_key"), "o_custkey", ["left_key"], ["right_key"]).select("o_custkey", "occurrence", "left_key", "right_key")


@query("""WITH h AS (SELECT p_partkey, p_brand, p_name, lower(trim(p_name)) AS t FROM part), g AS (SELECT p_brand, count(*) AS size, row_number() OVER (ORDER BY p_brand) - 1 AS k, count(*) OVER () AS groups FROM h GROUP BY 1),
    placed AS (SELECT p_partkey AS donor, p_brand AS donor_group, p_name AS donor_name, t, row_number() OVER (PARTITION BY p_brand ORDER BY t, sha256('donor|' || p_partkey)) - 1 AS pos FROM h),
    blocks AS (SELECT donor_group, t, min(pos) AS start, count(*) AS c FROM placed GROUP BY 1, 2),
    d AS (SELECT h.*, g.k, ('0x' || substr(sha256('donor|group|' || p_partkey), 1, 8))::BIGINT % (g.groups - 1) AS d FROM h JOIN g USING (p_brand)),
    w AS (SELECT d.p_partkey, g.p_brand AS goal, d.t, coalesce(b.start, 1000000000) AS start, coalesce(b.c, 0) AS c, ('0x' || substr(sha256('donor|row|' || p_partkey), 1, 8))::BIGINT % nullif(g.size - coalesce(b.c, 0), 0) AS p
          FROM d JOIN g ON g.k = d.d + (d.d >= d.k)::INT LEFT JOIN blocks b ON b.donor_group = g.p_brand AND b.t = d.t)
    SELECT w.p_partkey, x.donor, x.donor_group, x.donor_name FROM w LEFT JOIN placed x ON x.donor_group = w.goal AND x.pos = w.p + CASE WHEN w.p >= w.start THEN w.c ELSE 0 END""")
def donor_swap(spark, sf_dir):
    return audit.donors(table(spark, sf_dir, "part"), "p_partkey", "p_brand", "p_name", "donor")


@query("""WITH a AS (SELECT l_suppkey, list_distinct(list(p_brand)) AS x FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_suppkey, list_distinct(list(p_brand)) AS z FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber > 3 GROUP BY 1)
    SELECT l_suppkey, round(len(list_intersect(x, z)) / (len(x) + len(z) - len(list_intersect(x, z))), 9) AS agreement FROM a JOIN b USING (l_suppkey) ORDER BY 2, 1 LIMIT 4""")
def bottom_k_agreement(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    sets = li.groupBy("l_suppkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("p_brand"))).alias("x"), F.collect_set(F.when(F.col("l_linenumber") > 3, F.col("p_brand"))).alias("z"))
    kept = sets.where((F.size("x") > 0) & (F.size("z") > 0)).select("l_suppkey", F.round(C.jaccard(F.col("x"), F.col("z")), 9).alias("agreement"))
    return kept.orderBy("agreement", "l_suppkey").limit(4)


# Methods


def scores_of(name):
    def run(spark, sf_dir):
        return methods.scores(name, frames.scored(spark, sf_dir))

    run.__name__ = f"{name}_scores"
    return run


@query(f"WITH {SCORED} SELECT id, (SELECT avg(y) FROM scored WHERE id % 5 <> 0) AS proba FROM scored WHERE id % 5 = 0")
def majority_scores(spark, sf_dir):
    return methods.scores("majority", frames.scored(spark, sf_dir))


for _name in ("logreg_l2", "logreg_l1", "random_forest", "hist_gbm", "svm_linear"):
    query()(scores_of(_name))
