"""Queries of code trees, cells, probes, decision tables, pooled bits and audits of row sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import audit, bootstrap, cells, codes, decisions, elicitation, features, probes, registry_tables, splits
from evalloom.plans import frames, runner
from evalloom.plans.frames import DRAWS, SCORED, ranking_sql, table
from evalloom.plans.registry import query
from evalloom.sources import stores
from evalloom.storage import new_path

# Code trees

#: Regions, nations, customers and orders as one tree of codes; every seventh customer's nation is missing.
TREE = """tree AS (SELECT 'R' || r_regionkey AS code, NULL AS parent, r_name AS descriptor FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name FROM nation
    UNION ALL SELECT 'C' || c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN 'N' || c_nationkey END, c_name FROM customer UNION ALL SELECT 'O.' || o_orderkey, 'C' || o_custkey, NULL FROM orders)"""


def code_tree(spark, sf_dir):
    t = lambda name, code, parent, said: table(spark, sf_dir, name).select(code.alias("code"), parent.alias("parent"), said.alias("descriptor"))
    c = lambda letter, col: F.concat(F.lit(letter), F.col(col).cast("string"))
    none = F.lit(None).cast("string")
    nation = F.when(F.col("c_custkey") % 7 != 0, c("N", "c_nationkey"))
    return t("region", c("R", "r_regionkey"), none, F.col("r_name")).union(t("nation", c("N", "n_nationkey"), c("R", "n_regionkey"), F.col("n_name"))).union(t("customer", c("C", "c_custkey"), nation, F.col("c_name"))).union(t("orders", c("O.", "o_orderkey"), c("C", "o_custkey"), none))


@query(f"""WITH RECURSIVE {TREE}, walk AS (SELECT code, code AS ancestor, parent, 0 AS up FROM tree UNION ALL SELECT w.code, n.code, n.parent, w.up + 1 FROM walk w JOIN tree n ON w.parent = n.code)
    SELECT code, max(up)::INT AS depth, arg_max(ancestor, up) AS root, string_agg(ancestor, '>' ORDER BY up DESC) AS path FROM walk GROUP BY 1""")
def code_paths(spark, sf_dir):
    return codes.tree_levels(code_tree(spark, sf_dir)).select("code", "depth", "root", F.array_join("path", ">").alias("path"))


@query(f"""WITH {TREE}, asked AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' n' || (o_custkey % 25) || ' ' WHEN 1 THEN 'C.' || o_custkey WHEN 2 THEN 'R' || (o_orderkey % 9) ELSE 'O.' || o_orderkey END AS code FROM orders), names AS (SELECT code, descriptor FROM tree WHERE descriptor IS NOT NULL)
    SELECT o_orderkey, coalesce(x.descriptor, y.descriptor) AS descriptor FROM asked a LEFT JOIN names x ON upper(trim(a.code)) = x.code LEFT JOIN names y ON replace(upper(trim(a.code)), '.', '') = y.code""")
def code_descriptors(spark, sf_dir):
    """Codes in lower case, with blanks, with a point and unknown ones."""
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    code = F.when(k % 4 == 0, F.concat(F.lit(" n"), text(F.col("o_custkey") % 25), F.lit(" "))).when(k % 4 == 1, F.concat(F.lit("C."), F.col("o_custkey"))).when(k % 4 == 2, F.concat(F.lit("R"), text(k % 9))).otherwise(F.concat(F.lit("O."), k))
    names = code_tree(spark, sf_dir).where("descriptor is not null").select("code", "descriptor")
    return codes.described(table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code")), "code", names).select("o_orderkey", "descriptor")


#: An order's codes are those of its parts: three letters of the type, a point and the size; even sizes are in the crosswalk.
CODES = """own AS (SELECT DISTINCT l_orderkey AS k, upper(p_type[1:3]) || '.' || p_size AS code FROM lineitem JOIN part ON l_partkey = p_partkey),
    lev AS (SELECT k, 'full' AS level, code AS term FROM own UNION SELECT k, 'char3', code[1:3] FROM own UNION SELECT k, 'block', code[1:2] || '-B' FROM own WHERE code[1:3] <> 'PRO' UNION SELECT k, 'chapter', code[1:1] || '-Z' FROM own WHERE code[1:3] <> 'PRO'),
    cross_ AS (SELECT DISTINCT replace(code, '.', '') AS code, 'CAT' || (split_part(code, '.', 2)::INT % c) AS term FROM own, (VALUES (3), (5)) v(c) WHERE split_part(code, '.', 2)::INT % 2 = 0),
    terms AS (SELECT 'full' AS g, k, 'icd' AS block, term FROM lev WHERE level = 'full' UNION ALL SELECT 'char3', k, 'icd', term FROM lev WHERE level = 'char3' UNION ALL SELECT 'block', k, 'icd', term FROM lev WHERE level = 'block' UNION ALL SELECT 'chapter', k, 'icd', term FROM lev WHERE level = 'chapter'
        UNION ALL SELECT DISTINCT 'ccsr', k, 'icd', c.term FROM own JOIN cross_ c ON replace(own.code, '.', '') = c.code UNION ALL SELECT DISTINCT 'ancestors', k, 'icd', term FROM lev UNION ALL SELECT 'stack', k, 'icd_' || level, term FROM lev)"""


def order_codes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.upper(F.substring("p_type", 1, 3)), F.lit("."), F.col("p_size").cast("string")).alias("code"))
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("code").alias("codes"))
    each = p.select("code").distinct()
    heads = each.select(F.substring("code", 1, 3).alias("char3")).distinct().where("char3 <> 'PRO'")
    hierarchy = heads.select("char3", F.concat(F.substring("char3", 1, 2), F.lit("-B")).alias("block"), F.concat(F.substring("char3", 1, 1), F.lit("-Z")).alias("chapter"))
    size = F.split_part("code", F.lit("."), F.lit(2)).cast("int")
    category = lambda n: F.concat(F.lit("CAT"), (size % n).cast("string"))
    crosswalk = each.where(size % 2 == 0).select(F.replace("code", F.lit("."), F.lit("")).alias("code"), F.array_distinct(F.array(category(3), category(5))).alias("categories"))
    return codes.code_levels(own, "k", "codes", hierarchy), crosswalk


@query(f"""WITH {CODES}, voc AS (SELECT g, block, term FROM terms WHERE k % 5 <> 0 GROUP BY ALL HAVING count(*) >= 10), blocks AS (SELECT DISTINCT g, block FROM terms UNION SELECT 'stack', 'icd_' || l FROM (VALUES ('full'), ('char3'), ('block'), ('chapter')) v(l)), keys AS (SELECT DISTINCT k FROM own WHERE k % 5 = 0),
    cells AS (SELECT b.g, b.block, keys.k, count(t.term) AS n FROM blocks b CROSS JOIN keys LEFT JOIN terms t ON t.g = b.g AND t.block = b.block AND t.k = keys.k GROUP BY ALL),
    f AS (SELECT t.g, t.block || '__' || t.term AS feature, 1.0 AS value FROM terms t JOIN voc USING (g, block, term) WHERE t.k % 5 = 0 UNION ALL SELECT g, 'n_' || block || '_terms', n FROM cells UNION ALL SELECT g, 'has_' || block, (n > 0)::INT FROM cells)
    SELECT g AS granularity, feature, count(*) AS n, sum(value)::DOUBLE AS total FROM f GROUP BY ALL""")
def code_granularities(spark, sf_dir):
    """Every granularity's view of a fifth of the orders, with a vocabulary fitted on the others."""
    levels, crosswalk = order_codes(spark, sf_dir)
    keys, out = levels.select("k").distinct().where("k % 5 = 0"), None
    for g in codes.GRANULARITIES:
        terms = codes.code_terms(levels, "k", g, crosswalk)
        view = codes.CodeView("k", codes.code_blocks(g)).fit(terms.where("k % 5 <> 0"))
        one = view.transform(keys, terms.where("k % 5 = 0")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).withColumn("granularity", F.lit(g))
        out = one if out is None else out.unionByName(one)
    return out.select("granularity", "feature", "n", "total")


# Cells


@query("""WITH t AS (SELECT o_orderkey, least(greatest(coalesce(try_cast(CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '0' ELSE 'open' END AS INT), 0), 0), 1) AS y FROM orders),
    tr AS (SELECT o_orderkey, y, row_number() OVER (PARTITION BY y ORDER BY sha256('cell|' || o_orderkey), o_orderkey) AS r, count(*) OVER (PARTITION BY y) AS n FROM t WHERE o_orderkey % 4 <> 0)
    SELECT o_orderkey, CASE WHEN r <= ceil(n * 0.2) THEN 'valid' ELSE 'train' END AS part, y::INT AS y, NULL::BIGINT AS pos FROM tr UNION ALL SELECT t.o_orderkey, 'test', t.y::INT, s.pos FROM t JOIN (SELECT o_orderkey, o_orderkey * 7919 % 1000003 AS pos FROM orders WHERE o_orderkey % 8 = 0) s USING (o_orderkey)""")
def cell_loader(spark, sf_dir):
    """A binary cell; the test rows are a list of keys in an order of its own."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "0").otherwise("open").alias("label"))
    wanted = o.where("o_orderkey % 8 = 0").select("o_orderkey", (F.col("o_orderkey") * 7919 % 1000003).alias("_pos"))
    cell = cells.load_cell(o.where("o_orderkey % 4 <> 0"), o.where("o_orderkey % 4 = 0"), "o_orderkey", "label", binary=True, subset=wanted)
    part = lambda df, name, pos: df.select("o_orderkey", F.lit(name).alias("part"), F.col("y").cast("int").alias("y"), pos.alias("pos"))
    none = F.lit(None).cast("long")
    return part(cell.train, "train", none).union(part(cell.valid, "valid", none)).union(part(cell.test, "test", F.col("_pos")))


@query("""WITH keys AS (SELECT c_custkey AS k, c_custkey * 7 % 1000003 AS _pos FROM customer WHERE c_custkey % 3 <> 1), o AS (SELECT o_custkey AS k, * FROM orders),
    oo AS (SELECT k, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low, min(o_orderdate)::DATE::VARCHAR AS first_day, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS priorities, string_agg(CASE WHEN o_totalprice > 300000 THEN o_orderstatus END, '' ORDER BY o_orderkey) AS statuses FROM o GROUP BY 1),
    li AS (SELECT o.k, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_linestatus = 'F') AS shut FROM lineitem JOIN o ON l_orderkey = o.o_orderkey GROUP BY 1), ev AS (SELECT user_id AS k, count(*) FILTER (WHERE event_type = 'error') AS errors, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS kinds, min(ts)::DATE::VARCHAR AS first_seen FROM events GROUP BY 1)
    SELECT keys.k, _pos AS pos, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Yes' WHEN c_mktsegment = 'FURNITURE' THEN 'No' END AS building, n_name AS nation, r_name AS region, coalesce(urgent, 0) AS urgent, coalesce(low, 0) AS low, first_day, priorities, coalesce(statuses, '') AS statuses, coalesce(returned, 0) AS returned, coalesce(shut, 0) AS shut, coalesce(errors, 0) AS errors, kinds, first_seen
    FROM keys JOIN customer ON c_custkey = keys.k LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN oo ON oo.k = keys.k LEFT JOIN li ON li.k = keys.k LEFT JOIN ev ON ev.k = keys.k""")
def wide_records(spark, sf_dir):
    """One row a listed customer from eleven tables: their own, nations, regions, orders six times, lines and events."""
    t = lambda name: table(spark, sf_dir, name)
    c = t("customer").withColumn("k", F.col("c_custkey"))
    nations = c.select("k", F.col("c_nationkey").alias("n_nationkey")).join(t("nation"), "n_nationkey")
    o = t("orders").withColumn("k", F.col("o_custkey"))
    lines = t("lineitem").join(o.select("k", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    ev = t("events").withColumn("k", F.col("user_id"))
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    said = F.when(F.col("c_mktsegment") == "BUILDING", "Yes").when(F.col("c_mktsegment") == "FURNITURE", "No")
    parts = [
        cells.Part(c, {"building": ("one", said)}),
        cells.Part(nations, {"nation": ("one", F.col("n_name"))}),
        cells.Part(nations.join(t("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey"), {"region": ("one", F.col("r_name"))}),
        cells.Part(o, {"urgent": ("count", F.col("o_orderpriority") == "1-URGENT"), "low": ("count", F.col("o_orderpriority") == "5-LOW")}),
        cells.Part(o, {"first_day": ("first", day("o_orderdate"))}),
        cells.Part(o, {"priorities": ("joined", F.col("o_orderpriority"))}),
        cells.Part(o.where("o_totalprice > 300000"), {"statuses": ("listed", F.col("o_orderstatus"))}, F.col("o_orderkey")),
        cells.Part(lines, {"returned": ("count", F.col("l_returnflag") == "R"), "shut": ("count", F.col("l_linestatus") == "F")}),
        cells.Part(ev, {"errors": ("count", F.col("event_type") == "error")}),
        cells.Part(ev, {"kinds": ("joined", F.col("event_type"))}),
        cells.Part(ev, {"first_seen": ("first", day("ts"))}),
    ]
    keys = c.where("k % 3 <> 1").select("k", (F.col("k") * 7 % 1000003).alias("_pos"))
    return cells.assembled(keys, "k", parts).withColumn("statuses", F.array_join("statuses", "")).withColumnRenamed("_pos", "pos")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY sha256('first|' || doc_id), doc_id) - 1) % 5)::INT AS fold FROM labels")
def fold_store(spark, sf_dir):
    """Folds of one seed are stored; a second caller with another seed gets the first one's."""
    ids, path = table(spark, sf_dir, "labels").select("doc_id"), new_path(spark, "folds")
    for seed in ("first", "second"):
        found = stores.once(spark, path, lambda seed=seed: splits.random_folds(ids, "doc_id", 5, seed))
    return found


@query("""WITH p AS (SELECT doc_id, quality, toxic FROM labels) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'again ' || doc_id WHEN doc_id % 3 = 1 THEN 'once ' || doc_id END AS reply FROM p""")
def reply_cache(spark, sf_dir):
    """A third of the prompts was answered, a third twice; the later answer counts, the rest is left to ask."""
    path = new_path(spark, "replies")
    p = table(spark, sf_dir, "labels").select("doc_id", F.lit("m").alias("model"), F.concat(F.lit("rate "), F.col("doc_id").cast("string")).alias("prompt"), F.lit(0.0).alias("temperature"), F.lit("batch").alias("tier"))
    for word, known in (("once", "doc_id % 3 < 2"), ("again", "doc_id % 3 = 0")):
        stores.cache_put(p.where(known).withColumn("reply", F.concat(F.lit(f"{word} "), F.col("doc_id").cast("string"))), path)
    return stores.cache_get(p, path).select("doc_id", "reply")


@query(f"""WITH {SCORED}, m AS (SELECT lang, count(*) AS n, sum((id % 4 = 0)::INT)::BIGINT AS n_test, avg(y) FILTER (WHERE id % 4 = 0) AS prevalence FROM scored WHERE lang IN ('en', 'de') GROUP BY 1)
    SELECT lang AS phase, 'majority' AS method, 'ok' AS status, n_test, round(prevalence, 9) AS prauc FROM m UNION ALL SELECT lang, 'logreg_l2', 'ok', n_test, NULL FROM m WHERE lang = 'de' UNION ALL SELECT lang, 'xgboost', 'skipped', NULL, NULL FROM m UNION ALL SELECT lang, 'broken', 'error', NULL, NULL FROM m
    UNION ALL SELECT 'xx', method, 'no_data', NULL, NULL FROM (VALUES ('majority'), ('xgboost'), ('broken')) v(method)""")
def grid_cells(spark, sf_dir):
    """Three phases, of which one has no table, by four methods, of which one isn't installed and one isn't known; the grid is run twice."""
    df, root = frames.scored(spark, sf_dir), new_path(spark, "grid")

    def load(task, phase, seed):
        if phase == "xx":
            raise FileNotFoundError(f"no table for {phase}")
        rows = df.where(F.col("lang") == phase).drop("lang")
        return cells.load_cell(rows.where("id % 4 <> 0"), rows.where("id % 4 = 0"), "id", "y", binary=True, seed=f"grid{seed}")

    grid = runner.Grid(root, load, draws=20)
    specs = [("quality", phase, method, 1) for phase in ("en", "de", "xx") for method in ("majority", "xgboost", "broken")] + [("quality", "de", "logreg_l2", 1)]
    for _ in range(2):
        grid.run(spark, specs)
    rec = grid.records(spark)
    ap = F.when(F.col("method") == "majority", F.round(F.try_element_at("point", F.lit("prauc")), 9))
    return rec.select("phase", "method", "status", "n_test", ap.alias("prauc"))


SHAPED = """s AS (SELECT c_custkey, c_name AS "name/textblock", CASE c_mktsegment WHEN 'BUILDING' THEN 'Yes' WHEN 'FURNITURE' THEN 'No' END AS segment, NULL::VARCHAR AS added FROM customer)"""


@query(f"WITH {SHAPED} SELECT * FROM s")
def shaped_columns(spark, sf_dir):
    """Columns left out by name and by pattern, renamed, mapped and added, as a slice's columns are made to be those of another table."""
    c = table(spark, sf_dir, "customer").withColumn("smiles_a", F.lit(1)).withColumn("smiles_b", F.lit(2))
    kept = registry_tables.without(c, ["c_nationkey", "absent"], patterns=["smiles_", "acctbal"])
    named = kept.withColumnsRenamed({"c_name": "name/textblock"}).withColumn("segment", registry_tables.mapped(F.col("c_mktsegment"), {"BUILDING": "Yes", "FURNITURE": "No"})).drop("c_mktsegment")
    return registry_tables.with_missing(named, ["added", "segment"])


# Probes


@query(f"""WITH {SCORED}, base AS (SELECT id, a, b, (id % 13)::DOUBLE AS c, y, row_number() OVER (ORDER BY sha256('unit|' || id), id) AS rk FROM scored), dealt AS (SELECT f, r, id, row_number() OVER (PARTITION BY f, r ORDER BY sha256('importance|' || f || '|' || r || '|' || id)) AS rk FROM base, (VALUES ('a'), ('b'), ('c')) v(f), range(1, 6) t(r)),
    e AS (SELECT d.f || '|' || d.r AS g, round((CASE WHEN f = 'a' THEN o.a ELSE x.a END) / 1000 - (CASE WHEN f = 'b' THEN o.b ELSE x.b END) / 50 + (CASE WHEN f = 'c' THEN o.c ELSE x.c END) / 100, 9) AS s, x.y FROM dealt d JOIN base x USING (id) JOIN base o ON d.rk = o.rk),
    o AS (SELECT round(a / 1000 - b / 50 + c / 100, 9) AS s, y FROM base), {ranking_sql('e', 'g', 's', name='shuffled')}, {ranking_sql('o', '', 's', name='plain')}
    SELECT split_part(g, '|', 1) AS feature, round(avg(plain.ap - shuffled.ap), 9) AS importance, round(stddev_pop(plain.ap - shuffled.ap), 9) AS std FROM shuffled, plain GROUP BY 1""")
def permutation_importance(spark, sf_dir):
    df = frames.scored(spark, sf_dir).withColumn("c", (F.col("id") % 13).cast("double"))
    score = lambda x: F.round(x["a"] / 1000 - x["b"] / 50 + x["c"] / 100, 9)
    found = probes.permutation_importance(df, "id", ["a", "b", "c"], "y", score, 5, "importance")
    return found.select("feature", F.round("importance", 9).alias("importance"), F.round("std", 9).alias("std"))


ARM = """u{0} AS (SELECT cluster, row_number() OVER (ORDER BY sha256('unit|' || cluster)) - 1 AS k FROM (SELECT DISTINCT cluster FROM {0})),
    w{0} AS (SELECT draw, x.cluster, count(*) AS w FROM (SELECT draw, ('0x' || substr(sha256('{1}|' || draw || '|' || u.k), 1, 8))::BIGINT % (SELECT count(*) FROM u{0}) AS k FROM u{0} u, range(1, 41) t(draw)) d JOIN u{0} x ON d.k = x.k GROUP BY ALL)"""


@query(f"""WITH {SCORED}, pa AS (SELECT * FROM scored WHERE lang IN ('en', 'de')), pb AS (SELECT * FROM scored WHERE lang NOT IN ('en', 'de')), {ARM.format('pa', 'probe-a')}, {ARM.format('pb', 'probe-b')},
    placed AS (SELECT cluster, y, row_number() OVER (ORDER BY sha256('probe-a-flip|' || id), id) AS r, (SELECT count(*) FROM pa) AS n FROM pa), da AS (SELECT f, draw, sum(w * y) AS pos, sum(w * (1 - y)) AS neg, sum(w * (y = 0 AND r <= round(f * n))::INT) AS missed FROM placed JOIN wpa USING (cluster), (VALUES (0.001::DOUBLE), (0.02), (0.1), (0.3)) v(f) GROUP BY ALL),
    db AS (SELECT draw, sum(w * y) AS p, sum(w * (1 - y)) AS q FROM pb JOIN wpb USING (cluster) GROUP BY 1), d AS (SELECT f, CASE WHEN pos > 0 AND neg > 0 AND p > 0 AND q > 0 THEN (1 - missed / neg) / 2 - 0.5 END AS delta FROM da JOIN db USING (draw)),
    e AS (SELECT f AS fraction, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi, count(delta) AS used FROM d GROUP BY 1)
    SELECT fraction, round(lo, 9) AS lo, round(hi, 9) AS hi, used, coalesce(hi < 0, false) AS clears_zero, coalesce(fraction = (SELECT min(fraction) FROM e WHERE hi < 0), false) AS smallest FROM e""")
def power_probe(spark, sf_dir):
    df = frames.scored(spark, sf_dir)
    first = F.col("lang").isin("en", "de")
    found = probes.power_probe(df.where(first), df.where(~first), "id", "cluster", "y", [0.001, 0.02, 0.1, 0.3], 40, ("probe-a", "probe-b"))
    return found.select("fraction", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "used", "clears_zero", "smallest")


@query(f"""WITH {SCORED}, f AS (SELECT id, cluster, y, ((row_number() OVER (PARTITION BY y ORDER BY sha256('oof|' || id), id) - 1) % 5)::INT AS fold FROM scored), m AS (SELECT k, avg(y) AS mean FROM f, range(0, 5) t(k) WHERE fold <> k GROUP BY 1), e AS (SELECT k, cluster, (sum(y) + 20 * any_value(mean)) / (count(*) + 20) AS e FROM f JOIN m ON f.fold <> m.k GROUP BY ALL)
    SELECT f.id, f.y, f.fold, round(coalesce(e.e, m.mean), 9) AS score FROM f JOIN m ON f.fold = m.k LEFT JOIN e ON e.k = f.fold AND e.cluster = f.cluster""")
def out_of_fold(spark, sf_dir):
    """Each row's score is the smoothed mean of its source over the other four folds."""

    def fit(train):
        means = features.fit_target_encoding(train, "cluster", "y")
        return lambda rows: features.apply_target_encoding(rows, means, "cluster").withColumn("score", F.round("encoding", 9))

    return probes.out_of_fold(frames.scored(spark, sf_dir), "id", "y", 5, "oof", fit)


COLLAPSE = "c AS (SELECT 'o_orderpriority' AS column, o_orderpriority AS level, o_orderkey, o_orderstatus FROM orders UNION ALL SELECT 'customer', CASE WHEN o_custkey % 10 <> 0 THEN o_custkey::VARCHAR ELSE '__nan__' END, o_orderkey, o_orderstatus FROM orders UNION ALL SELECT 'day', o_orderdate::DATE::VARCHAR, o_orderkey, o_orderstatus FROM orders)"


@query(f"""WITH {COLLAPSE}, g AS (SELECT "column", level, count(*) FILTER (WHERE o_orderkey % 4 <> 0) AS n, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS m, coalesce(sum((o_orderstatus = 'F')::INT) FILTER (WHERE o_orderkey % 4 <> 0), 0) AS s FROM c GROUP BY ALL), h AS (SELECT *, sum(s) OVER (PARTITION BY "column") / sum(n) OVER (PARTITION BY "column") AS mean FROM g),
    e AS (SELECT *, CASE WHEN n > 0 THEN (s + 20 * mean) / (n + 20) ELSE mean END AS e FROM h)
    SELECT "column", sum((n > 0)::INT)::BIGINT AS levels, round(sum(n) / sum((n > 0)::INT), 9) AS rows_per_level, round(sum(m) FILTER (WHERE n = 0) / sum(m), 9) AS unseen, round(sqrt(greatest(0, sum(n * e * e) / sum(n) - pow(sum(n * e) / sum(n), 2))), 7) AS std_train, round(sqrt(greatest(0, sum(m * e * e) / sum(m) - pow(sum(m * e) / sum(m), 2))), 7) AS std_test FROM e GROUP BY 1""".replace("round(sum(m) FILTER (WHERE n = 0) / sum(m), 9)", "round(coalesce(sum(m) FILTER (WHERE n = 0), 0) / sum(m), 9)"))
def encoding_collapse(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey").cast("string")).alias("customer"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    found = probes.encoding_collapse(o.where("o_orderkey % 4 <> 0"), o.where("o_orderkey % 4 = 0"), ["o_orderpriority", "customer", "day"], "y")
    return found.select("column", "levels", F.round("rows_per_level", 9).alias("rows_per_level"), F.round("unseen", 9).alias("unseen"), F.round("std_train", 7).alias("std_train"), F.round("std_test", 7).alias("std_test"))


# Decision tables

NUMBERS = """n AS (SELECT p_partkey, (p_size - 25) / 100.0 AS own_a_lo, (p_partkey % 11 - 5) / 50.0 AS own_b_lo, CASE WHEN p_partkey % 13 <> 0 THEN (p_partkey % 17 - 8) / 40.0 END AS reference_a_lo, (p_partkey % 7 - 3) / 30.0 AS difference_lo,
    0.05 / 3 - p_size / 1000.0 AS title_margin, (p_partkey % 5 - 2) / 10.0 AS rate_margin, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 10) / 10.0 END AS outcome_rate FROM part)"""


def verdict_inputs(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    columns = {"own_a_lo": (s - 25) / 100, "own_b_lo": (k % 11 - 5) / 50, "reference_a_lo": F.when(k % 13 != 0, (k % 17 - 8) / 40), "difference_lo": (k % 7 - 3) / 30, "title_margin": F.lit(0.05 / 3) - s / 1000, "rate_margin": (k % 5 - 2) / 10, "outcome_rate": F.when(k % 4 != 0, (k % 10) / 10)}
    return table(spark, sf_dir, "part").select("p_partkey", *[v.alias(c) for c, v in columns.items()])


@query(f"""WITH {NUMBERS} SELECT 'recall' AS asked, p_partkey, CASE WHEN own_a_lo <= 0 THEN 'NO_RECALL_FINDING_CALIBRATION_ARTIFACT' WHEN difference_lo > 0 THEN 'OUTCOME_RECALL_DEMONSTRATED' ELSE 'INCONCLUSIVE' END AS verdict FROM n
    UNION ALL SELECT 'masked', p_partkey, CASE WHEN own_b_lo > 0 AND own_a_lo <= 0 THEN 'MEMORISATION_SIGNATURE' WHEN reference_a_lo <= 0 AND own_a_lo <= 0 THEN 'QUARANTINE_LIFTED_DISEASE_UNINFORMATIVE' WHEN reference_a_lo > 0 AND own_a_lo <= 0 THEN 'NOT_SEPARABLE_ON_ARM_A_ALONE' ELSE 'NORMAL_BEHAVIOUR' END FROM n
    UNION ALL SELECT 'branch', p_partkey, CASE WHEN title_margin > 0 AND rate_margin > 0 THEN CASE WHEN outcome_rate > 0.30 THEN 'SHRINK_TO_UNRECOGNIZED_STRATUM' ELSE 'STRATIFY' END ELSE 'PROCEED_AS_DESIGNED' END FROM n""")
def decision_table(spark, sf_dir):
    """Three tables of rules over the same numbers."""
    n = verdict_inputs(spark, sf_dir)
    asked = {"recall": (n.withColumn("own_lo", F.col("own_a_lo")), decisions.RECALL), "masked": (n, decisions.MASKED_READING), "branch": (n, decisions.branch_rules(0.30))}
    out = [decisions.decide(df, "p_partkey", decisions.rule_table(spark, rules)).select(F.lit(name).alias("asked"), "p_partkey", "verdict") for name, (df, rules) in asked.items()]
    return out[0].union(out[1]).union(out[2])


# Pooled bits


@query("""WITH v AS (SELECT label, embedding AS e, vec_id % 9 <> 0 AS known FROM embeddings), d AS (SELECT max(len(embedding)) AS d FROM embeddings),
    x AS (SELECT label, i, max((known AND e[i + 1] > 0.25)::INT) AS bit, round(avg(CASE WHEN known THEN e[i + 1]::DOUBLE END), 7) AS mean FROM v, d, unnest(range(0, d)) u(i) GROUP BY ALL)
    SELECT x.label, (SELECT count(*) FROM v WHERE v.label IS NOT DISTINCT FROM x.label AND known) AS n, string_agg(bit::VARCHAR, '' ORDER BY i) AS fingerprint, round(sum(mean), 5) AS mean_sum FROM x GROUP BY 1""")
def packed_fingerprint_pool(spark, sf_dir):
    """Components above 0.25 as packed bits, pooled by label; every ninth vector has no fingerprint."""
    e = table(spark, sf_dir, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).first()[0] or 1
    words = features.packed_bits([F.get("embedding", F.lit(k)) > F.lit(0.25).cast("float") for k in range(size)])
    known = F.col("vec_id") % 9 != 0
    rows = e.select("label", "embedding", *[F.when(known, w).alias(f"w{k}") for k, w in enumerate(words)])
    found = features.packed_pool(rows, "label", [f"w{k}" for k in range(len(words))], size, "embedding", size)
    total = F.aggregate("means", F.lit(0.0), lambda acc, x: acc + F.round(F.coalesce(x, F.lit(0.0)), 7))
    return found.select("label", "n", F.array_join(F.col("fingerprint").cast("array<string>"), "").alias("fingerprint"), F.round(total, 5).alias("mean_sum"))


# Intervals, arms and choices


@query(f"""WITH {SCORED}, {DRAWS.format(seed='point', draws=50)}, e AS (SELECT w.draw, w.w, s.a, s.y FROM scored s JOIN weights w USING (cluster)), {ranking_sql('e', 'draw', 'a', weight='w', name='r')}, {ranking_sql('scored', '', 'a', name='p')}
    SELECT round((SELECT auroc FROM p), 9) AS point, round(avg(auroc), 9) AS mean, round(quantile_cont(auroc, 0.025), 9) AS lo, round(quantile_cont(auroc, 0.975), 9) AS hi, round(stddev_pop(auroc), 9) AS std, count(auroc) AS used, count(*) AS requested FROM r""")
def cluster_ci_point(spark, sf_dir):
    found = bootstrap.with_point(frames.scored(spark, sf_dir), "cluster", "a", "y", 50, "point", "auroc")
    return found.select(*[F.round(c, 9).alias(c) for c in ("point", "mean", "lo", "hi", "std")], "used", "requested")


@query(f"""WITH {SCORED}, {DRAWS.format(seed='share', draws=50)}, e AS (SELECT w.draw, w.w, (s.id % 13)::DOUBLE AS c, s.b, s.a, s.y FROM scored s JOIN weights w USING (cluster)), {ranking_sql('e', 'draw', 'c', weight='w', name='rc')}, {ranking_sql('e', 'draw', 'b', weight='w', name='rb')}, {ranking_sql('e', 'draw', 'a', weight='w', name='ra')},
    d AS (SELECT rc.ap AS base, rb.ap AS part, ra.ap AS whole, (rb.ap - rc.ap) / nullif(ra.ap - rc.ap, 0) AS share FROM rc JOIN rb USING (draw) JOIN ra USING (draw))
    SELECT round(avg(base), 9) AS mean_base, round(avg(part), 9) AS mean_part, round(avg(whole), 9) AS mean_full, round(avg(share), 6) AS share, round(quantile_cont(share, 0.025), 6) AS lo, round(quantile_cont(share, 0.975), 6) AS hi, count(share) AS used, (SELECT count(*) FROM scored) AS n_rows, (SELECT count(DISTINCT cluster) FROM scored) AS n_clusters FROM d""")
def disease_share(spark, sf_dir):
    df = frames.scored(spark, sf_dir).withColumn("c", (F.col("id") % 13).cast("double"))
    found = bootstrap.share_of_gain(df, "cluster", "c", "b", "a", "y", 50, "share")
    return found.select(*[F.round(c, 9).alias(c) for c in ("mean_base", "mean_part", "mean_full")], *[F.round(c, 6).alias(c) for c in ("share", "lo", "hi")], "used", "n_rows", "n_clusters")


@query("""WITH p AS (SELECT o_orderkey, e AS endpoint, CASE e WHEN 'filled' THEN (o_orderstatus = 'F')::INT ELSE CASE WHEN o_totalprice > 50000 THEN (o_totalprice > 200000)::INT END END AS y FROM orders, (VALUES ('filled'), ('large')) v(e) WHERE o_orderdate < TIMESTAMP '1997-01-01'),
    s AS (SELECT o_orderkey, endpoint, y, endpoint || '|' || y AS stratum FROM p WHERE y IS NOT NULL), c AS (SELECT stratum, count(*) AS n FROM s GROUP BY 1), x AS (SELECT *, n * 700 / sum(n) OVER () AS x FROM c), f AS (SELECT stratum, floor(x) AS f, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, stratum) AS r, 700 - sum(floor(x)) OVER () AS short FROM x), q AS (SELECT stratum, f + (r <= short)::INT AS quota FROM f),
    r AS (SELECT s.*, row_number() OVER (PARTITION BY stratum ORDER BY sha256('arm|' || endpoint || '|' || o_orderkey), endpoint || '|' || o_orderkey) AS rk FROM s) SELECT o_orderkey, endpoint, y FROM r JOIN q USING (stratum) WHERE rk <= quota""")
def arm_sample(spark, sf_dir):
    """Two endpoints of orders before a cutoff; an order of either may be in both samples."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp"))
    ends = F.array(F.struct(F.lit("filled").alias("endpoint"), (F.col("o_orderstatus") == "F").cast("int").alias("y")), F.struct(F.lit("large").alias("endpoint"), F.when(F.col("o_totalprice") > 50_000, (F.col("o_totalprice") > 200_000).cast("int")).alias("y")))
    return splits.arm_sample(o.select("o_orderkey", F.inline(ends)), "o_orderkey", "endpoint", "y", 700, "arm")


@query(f"""WITH {SCORED}, l AS (SELECT 'a' AS c, a AS x, y FROM scored UNION ALL SELECT 'b', b, y FROM scored UNION ALL SELECT 'c', (id % 13)::DOUBLE, y FROM scored UNION ALL SELECT 'flat', 1, y FROM scored), g AS (SELECT c, y, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY 1, 2), h AS (SELECT *, sum(n * m) OVER (PARTITION BY c) / sum(n) OVER (PARTITION BY c) AS mean FROM g),
    f AS (SELECT c, (sum(n * (m - mean) * (m - mean)) / (count(*) - 1)) / nullif(sum(n * v) / (sum(n) - count(*)), 0) AS f FROM h GROUP BY 1) SELECT row_number() OVER (ORDER BY round(f, 9) DESC NULLS LAST, c)::INT AS place, c AS "column" FROM f QUALIFY place <= 3""")
def select_k_best(spark, sf_dir):
    df = frames.scored(spark, sf_dir).withColumn("c", (F.col("id") % 13).cast("double")).withColumn("flat", F.lit(1.0))
    return features.best_columns(features.anova_f(df.select("a", "b", "c", "flat", "y"), ["a", "b", "c", "flat"], "y"), 3).select("place", "column")


CURVE = "r AS (SELECT p_partkey, (p_size > 25)::INT AS y, string_split(p_name, ' ') AS w, 'Size: ' || p_size || chr(10) || 'Condition: ' AS body, p_type FROM part), d AS (SELECT r.*, r2.p_type AS other FROM r LEFT JOIN r r2 ON r2.p_partkey = r.p_partkey + 1), t AS (SELECT p_partkey, y, 'L1' AS arm, 0 AS place, body || p_type AS text FROM d UNION ALL SELECT p_partkey, y, 'L0', 1, body || '[condition withheld]' FROM d UNION ALL SELECT p_partkey, y, 'swap', 2, body || coalesce(other, 'none') FROM d), c AS (SELECT arm || '#' || place AS g, ('0x' || substr(md5(text), 1, 6))::BIGINT::DOUBLE AS s, y FROM t)"


@query(f"""WITH {CURVE}, {ranking_sql('c', 'g', 's', name='m')} SELECT split_part(g, '#', 1) AS arm, split_part(g, '#', 2)::INT AS place, round(ap, 9) AS ap, round(auroc, 9) AS auroc, round(ap - (SELECT ap FROM m WHERE g = 'L1#0'), 9) AS delta FROM m""")
def masking_curve(spark, sf_dir):
    """Named, masked and swapped texts, ranked by a digest of the text in place of a model; masked bodies are checked first."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type", (F.col("p_size") > 25).cast("int").alias("y"))
    donor = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("other"))
    df = p.join(donor, "p_partkey", "left").withColumn("other", F.coalesce("other", F.lit("none")))
    own = elicitation.body({"Size": F.col("p_size")}, set(), F.array("p_type"))
    masked = F.concat(own, F.lit(elicitation.MASKED))
    elicitation.without_leaks(df, "p_partkey", masked, F.array("p_type"))
    texts = {"L1": F.concat(own, F.col("p_type")), "L0": masked, "swap": F.concat(own, F.col("other"))}
    digest = lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 6), 16, 10)
    found = elicitation.masking_curve(df, texts, digest, "y")
    return found.select("arm", "place", *[F.round(c, 9).alias(c) for c in ("ap", "auroc", "delta")])


# Row sets

KEPT = f"""k AS (SELECT lang, a, b, y, (a % 101)::INT / 100.0::DOUBLE AS sim FROM scored), t AS (SELECT * FROM (VALUES (0.8::DOUBLE), (0.9), (0.95), (0.99), (9)) v(t)),
    s AS (SELECT lang || '#' || t || '#' || arm AS g, CASE arm WHEN 'a' THEN a ELSE b END AS s, y FROM k, t, (VALUES ('a'), ('b')) r(arm) WHERE sim <= t), {ranking_sql('s', 'g', 's', name='m')},
    p AS (SELECT split_part(g, '#', 1) AS lang, split_part(g, '#', 2)::DOUBLE AS t, split_part(g, '#', 3) AS score, ap, n_pos + n_neg AS n FROM m), z AS (SELECT f.lang, t.t AS threshold, f.score, coalesce(p.n, 0) AS n, CASE WHEN p.n >= 30 THEN p.ap END AS ap, f.ap AS fullap FROM p f CROSS JOIN t LEFT JOIN p ON p.lang = f.lang AND p.score = f.score AND p.t = t.t WHERE f.t = 9 AND t.t < 9)"""


def rescored_frame(spark, sf_dir):
    df = frames.scored(spark, sf_dir).withColumn("sim", (F.col("a") % 101).cast("int") / F.lit(100.0))
    return audit.rescored(df, "lang", "sim", ["a", "b"], "y", [0.8, 0.9, 0.95, 0.99], least=30)


@query(f"WITH {SCORED}, {KEPT} SELECT lang, threshold, score AS arm, n, round(ap, 9) AS ap, round(fullap - ap, 9) AS drop FROM z")
def dedup_rescore(spark, sf_dir):
    return rescored_frame(spark, sf_dir).select("lang", "threshold", "arm", "n", F.round("ap", 9).alias("ap"), F.round("drop", 9).alias("drop"))


@query(f"""WITH {SCORED}, {KEPT} SELECT x.lang, CASE WHEN x.ap IS NULL THEN 'UNRESOLVABLE' WHEN x.fullap > w.fullap AND x.fullap - x.ap > 0.002 THEN 'CUT' WHEN x.fullap > w.fullap THEN 'CONFIRMED' ELSE 'N/A' END AS verdict FROM z x JOIN z w ON x.lang = w.lang AND x.threshold = w.threshold WHERE x.score = 'a' AND w.score = 'b' AND x.threshold = 0.95""")
def dedup_verdict(spark, sf_dir):
    return audit.dedup_verdicts(rescored_frame(spark, sf_dir), "lang", "a", "b", 0.95, F.lit(0.002))
