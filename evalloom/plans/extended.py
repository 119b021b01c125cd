"""Further queries over the reference tables: rendered records, codes, tests, resampling, splits, audits and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import scalars as C
from evalloom.operators import audit, bootstrap, codes, elicitation, exact_tests, features, ranking, runs, splits
from evalloom.plans import frames, methods
from evalloom.plans.frames import DRAWS, RUNS, SCORED, identity_sql, ranking_sql, table
from evalloom.plans.registry import query
from evalloom.storage import cut


def r9(*names: str) -> list:
    return [F.round(n, 9).alias(n) for n in names]


# Rendered records

#: A part stands for a record: its type's words are names, its brand a code, its name a summary.
RECORD = """rec AS (SELECT p_partkey, p_name, p_brand, p_size, p_type, list_sort(list_distinct(CASE WHEN p_partkey % 7 = 0 THEN [] ELSE string_split(p_type, ' ') END)) AS names,
    CASE WHEN p_partkey % 5 = 0 THEN [] ELSE [upper(p_brand)] END AS codes, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS summary FROM part)"""
MASK = "[condition withheld]"


def records(spark, sf_dir):
    k = F.col("p_partkey")
    none = F.array().cast("array<string>")
    names = C.sorted_set(F.when(k % 7 == 0, none).otherwise(F.split("p_type", " ")))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", names.alias("names"), F.when(k % 5 == 0, none).otherwise(C.code_set(F.array("p_brand"))).alias("codes"), F.when(k % 3 != 0, F.col("p_name")).alias("summary"))


def slots_of(df=None) -> dict:
    described = F.transform("codes", lambda c: F.concat(c, F.lit(" ("), F.lower(c), F.lit(")")))
    heads = F.slice("names", 1, 1)
    return {arm: elicitation.slot(arm, F.col("names"), F.col("codes"), heads, described, F.col("codes"), F.col("summary")) for arm in elicitation.ARMS}


def body_of() -> F.Column:
    return elicitation.body({"Name": F.col("p_name"), "Size": F.col("p_size")}, {"Name"}, F.col("names"))


@query(f"""WITH {RECORD} SELECT p_partkey, '{MASK}' AS L0, coalesce(nullif(array_to_string(names, '; '), ''), '{MASK}') AS L1, coalesce(nullif(array_to_string(codes, '; '), ''), '{MASK}') AS L2,
    coalesce(nullif(array_to_string(list_transform(codes, lambda c: c || ' (' || lower(c) || ')'), '; '), ''), '{MASK}') AS L3, coalesce(nullif(array_to_string(names[1:1], '; '), ''), '{MASK}') AS L4,
    coalesce(nullif(array_to_string(codes, '; '), ''), '{MASK}') AS L5, coalesce(nullif(array_to_string(names, '; '), ''), '{MASK}') || CASE WHEN summary IS NULL THEN '' ELSE '. ' || trim(summary) END AS L7 FROM rec""")
def arm_slots(spark, sf_dir):
    return records(spark, sf_dir).select("p_partkey", *[x.alias(arm) for arm, x in slots_of().items()])


@query("SELECT p_partkey, p_partkey % 3 = 0 AS broken FROM part")
def body_identity(spark, sf_dir):
    """Of every third part one arm's body isn't like the others'; the check must name just these, and that arm."""
    df, slots = records(spark, sf_dir), slots_of()
    texts = {arm: F.concat(body_of(), s) for arm, s in slots.items()}
    texts["L2"] = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Brand: "), F.col("p_brand"), F.lit("\n"), texts["L2"])).otherwise(texts["L2"])
    broken = elicitation.broken_bodies(df, "p_partkey", texts, slots).where(F.col("arms") == F.array(F.lit("L2"))).select(F.col("p_partkey").alias("_odd"))
    return df.join(broken, F.col("p_partkey") == F.col("_odd"), "left").select("p_partkey", F.col("_odd").isNotNull().alias("broken"))


@query("""WITH t AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS term, p_name, p_brand FROM part) SELECT p_partkey, term FROM t
    WHERE contains('Name: ' || (CASE WHEN p_partkey % 2 = 0 THEN regexp_replace(p_name, string_split(p_name, ' ')[1], ' ', 'gi') ELSE p_name END), term)""")
def slot_leaks(spark, sf_dir):
    """The first word of a part's name is its phrase; every other part's body is scrubbed of it, but never of the second word."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("names"))
    scrubbed = elicitation.body({"Name": F.col("p_name")}, {"Name"}, F.slice("names", 1, 1))
    plain = elicitation.body({"Name": F.col("p_name")}, set(), F.col("names"))
    return elicitation.leaks(p, "p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, scrubbed).otherwise(plain), F.lit(MASK)), F.col("names"))


@query(f"""WITH {RECORD}, d AS (SELECT rec.*, r2.names AS other FROM rec LEFT JOIN rec r2 ON r2.p_partkey = rec.p_partkey + 1)
    SELECT p_partkey, 'Name: ' || CASE WHEN len(names) > 0 THEN regexp_replace(p_name, names[1], ' ', 'gi') ELSE p_name END || chr(10) || 'Size: ' || p_size || chr(10) || 'Condition: ' || coalesce(nullif(array_to_string(coalesce(other, ['none']), '; '), ''), '{MASK}') AS text FROM d""")
def slot_override(spark, sf_dir):
    """A record's own scrubbed body with its neighbour's names in the slot."""
    df = records(spark, sf_dir)
    donor = df.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("names").alias("other"))
    both = df.join(donor, "p_partkey", "left").withColumn("other", F.coalesce("other", F.array(F.lit("none"))))
    return both.select("p_partkey", F.concat(body_of(), elicitation.listed(F.col("other"))).alias("text"))


@query("""SELECT conv_id, turn, sha256('Will it end?' || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '{"probability": 0-100}') AS prompt_key FROM conversations WHERE role = 'user'""")
def prompt_keys(spark, sf_dir):
    text = elicitation.prompt(F.lit("Will it end?"), F.coalesce("text", F.lit("")), '{"probability": 0-100}')
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.sha2(text, 256).alias("prompt_key"))


@query("""WITH r AS (SELECT role, CASE turn % 3 WHEN 0 THEN 'Sorry, I CANNOT say: ' || coalesce(text, '') WHEN 1 THEN text ELSE 'I could, ' || coalesce(text, '') END AS reply FROM conversations)
    SELECT role, count(*) AS n, sum((contains(lower(reply), 'i cannot') OR contains(lower(reply), 'i can''t') OR contains(lower(reply), 'i''m unable') OR contains(lower(reply), 'as an ai') OR contains(lower(reply), 'i won''t') OR contains(lower(reply), 'i will not'))::INT)::BIGINT AS refused FROM r GROUP BY 1""")
def refusal_rate(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Sorry, I CANNOT say: "), text)).when(F.col("turn") % 3 == 1, F.col("text")).otherwise(F.concat(F.lit("I could, "), text))
    c = table(spark, sf_dir, "conversations").select("role", reply.alias("reply"))
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(C.refused(F.col("reply"), elicitation.REFUSALS).cast("long")).alias("refused"))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'error' ELSE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)::VARCHAR END AS v FROM events WHERE event_id % 10 < 8)
    SELECT e.event_id, CASE WHEN r.event_id IS NULL OR e.event_id % 4 = 0 THEN 'missing' WHEN e.event_id % 4 = 1 THEN 'error' WHEN TRY_CAST(v AS DOUBLE) BETWEEN 0 AND 100 THEN 'ok' ELSE 'unparsed' END AS status,
           CASE WHEN e.event_id % 4 > 1 AND TRY_CAST(v AS DOUBLE) BETWEEN 0 AND 100 THEN TRY_CAST(v AS DOUBLE) / 100 ELSE 0.5 END AS proba FROM events e LEFT JOIN r USING (event_id)""")
def reassembled_records(spark, sf_dir):
    """Every third record came twice, once as a failure that was tried again."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    i = F.col("event_id")
    body = F.when(i % 4 > 1, F.to_json(F.struct(F.get_json_object("props", "$.k").alias("probability"))))
    replies = e.where(i % 10 < 8).select("event_id", body.alias("body"), F.when(i % 4 == 1, "throttled").alias("error"))
    again = replies.where(i % 3 == 0).select("event_id", F.lit(None).cast("string").alias("body"), F.lit("timeout").alias("error"))
    return elicitation.reassembled(e, replies.unionByName(again), "event_id", "body", "error")


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE 'r' || event_id END AS reply FROM events""")
def provider_replies(spark, sf_dir):
    i, r = F.col("event_id"), F.concat(F.lit("r"), F.col("event_id").cast("string"))
    shapes = [F.to_json(F.struct(F.array(F.struct(r.alias("text"))).alias("content"))), F.to_json(F.struct(r.alias("generation"))), F.to_json(F.struct(F.array(F.struct(F.struct(r.alias("content")).alias("message"))).alias("choices")))]
    body = F.when(i % 4 == 0, shapes[0]).when(i % 4 == 1, shapes[1]).when(i % 4 == 2, shapes[2]).otherwise("{}")
    paths = ["$.content[0].text", "$.output.message.content[0].text", "$.generation", "$.choices[0].message.content"]
    return table(spark, sf_dir, "events").select("event_id", C.reply_text(body, paths).alias("reply"))


@query("""WITH e AS (SELECT event_id, event_id % 4 AS m, 'say "' || event_type || '" ' || event_id AS prompt, CASE WHEN event_id % 5 <> 0 THEN 'r' || event_id ELSE '' END AS reply FROM events)
    SELECT event_id, CASE m WHEN 0 THEN 'anthropic' WHEN 1 THEN 'amazon_nova' WHEN 2 THEN 'meta_llama' ELSE 'deepseek' END AS provider, md5(CASE WHEN m = 2 THEN '<|begin_of_text|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || prompt || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) ELSE prompt END) AS prompt, 256 AS most,
           CASE WHEN event_id % 7 = 0 THEN '' WHEN m = 0 THEN reply || '!' ELSE reply END AS reply, CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 50 END::BIGINT AS tokens_in, CASE WHEN event_id % 7 = 0 THEN 0 ELSE event_id % 9 END::BIGINT AS tokens_out FROM e""")
def provider_records(spark, sf_dir):
    """Each event asks one of four models and has its record's output read again; every seventh output is of another shape."""
    i = F.col("event_id")
    model = F.element_at(F.array(*map(F.lit, ("eu.anthropic.model-1", "us.amazon.nova-x", "us.meta.llama9", "deepseek.v9"))), (i % 4 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", model.alias("model"), F.concat(F.lit('say "'), "event_type", F.lit('" '), i.cast("string")).alias("prompt"), F.when(i % 5 != 0, F.concat(F.lit("r"), i.cast("string"))).otherwise("").alias("r"))
    e = e.withColumn("provider", elicitation.provider_of(F.col("model")))
    asked = elicitation.request_body(F.col("provider"), F.col("prompt"), F.lit(0.0), F.lit(256))
    said = lambda *paths: F.coalesce(*[F.get_json_object("asked", p) for p in paths])
    text, a, b = F.col("r"), (i % 50).cast("int"), (i % 9).cast("int")
    part = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    outputs = {
        "anthropic": F.to_json(F.struct(F.array(part("text", text), part("note", F.lit("x")), part("text", F.lit("!"))).alias("content"), F.struct(a.alias("input_tokens"), b.alias("output_tokens")).alias("usage"))),
        "amazon_nova": F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("content")).alias("message")).alias("output"), F.struct(a.alias("inputTokens"), b.alias("outputTokens")).alias("usage"))),
        "meta_llama": F.to_json(F.struct(text.alias("generation"), a.alias("prompt_token_count"), b.alias("generation_token_count"))),
        "deepseek": F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("").alias("content")).alias("message"), text.alias("text"))).alias("choices"), F.struct(a.alias("prompt_tokens"), b.alias("completion_tokens")).alias("usage"))),
    }
    e = e.withColumn("asked", asked).withColumn("body", F.when(i % 7 == 0, '{"content": 3}').otherwise(elicitation.by_provider(F.col("provider"), outputs)))
    tokens_in, tokens_out = elicitation.record_usage(F.col("provider"), F.col("body"))
    prompt = said("$.messages[0].content[0].text", "$.prompt", "$.messages[0].content")
    most = said("$.max_tokens", "$.inferenceConfig.maxTokens", "$.max_gen_len").cast("int")
    return e.select("event_id", "provider", F.md5(prompt.cast("binary")).alias("prompt"), most.alias("most"), elicitation.record_text(F.col("provider"), F.col("body")).alias("reply"), tokens_in.alias("tokens_in"), tokens_out.alias("tokens_out"))


@query("""WITH p AS (SELECT conv_id, turn, sha256(coalesce(text, '')) AS key FROM conversations WHERE role = 'user'), c AS (SELECT DISTINCT key FROM p WHERE conv_id % 3 = 0)
    SELECT (c.key IS NOT NULL) AS cached, count(*) AS n FROM p LEFT JOIN c USING (key) GROUP BY 1""")
def cache_split(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    cache = p.where("conv_id % 3 = 0").select("key", F.lit("0.5").alias("reply"))
    return elicitation.cached_or_asked(p, cache, "key").groupBy("cached").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RUNS}, g AS (SELECT method, cell, count(*) AS repeats FROM runs GROUP BY 1, 2) SELECT * FROM g WHERE repeats <> CASE WHEN method IN ('m1', 'm2') THEN 7 ELSE 5 END")
def unregistered_cells(spark, sf_dir):
    """Five repeats are registered, twice, for all but two methods; what isn't named must have seven."""
    grid = frames.runs(spark, sf_dir).groupBy("method", "cell").agg(F.count(F.lit(1)).alias("repeats"))
    plan = grid.where("method not in ('m1', 'm2')").select("method", "cell", F.lit(5).alias("repeats"))
    return elicitation.unregistered(grid, plan.union(plan), ["method", "cell"], "repeats", default=7)


@query("SELECT conv_id, turn FROM conversations WHERE role IS DISTINCT FROM CASE turn % 2 WHEN 0 THEN 'user' ELSE 'assistant' END")
def attribution_check(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("served"), F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("wanted"))
    return elicitation.unattributed(c, "wanted", "served").select("conv_id", "turn")


@query("""WITH o AS (SELECT vec_id, k, abs(embedding[k + 1])::DOUBLE AS x FROM embeddings, range(0, 5) t(k)), r AS (SELECT vec_id, k, (k + r) % 5 AS at, x + ((k + r) % 5) * 0.01 AS p FROM o, range(0, 5) u(r)), m AS (SELECT vec_id, k, avg(p) AS p FROM r GROUP BY 1, 2)
    SELECT vec_id, k::INT AS k, round(p, 7) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) = 1 AS top FROM m""")
def rotated_choice(spark, sf_dir):
    o = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform(F.slice("embedding", 1, 5), lambda x: F.abs(x.cast("double")))).alias("k", "x"))
    said = elicitation.rotated_choices(o, "vec_id", "k", 5).withColumn("p", F.col("x") + F.col("shown_at") * 0.01)
    return elicitation.unrotated(said, "vec_id", "k").select("vec_id", "k", F.round("p", 7).alias("p"), "top")


# Terms and codes


@query("""SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN p_brand || '|' || p_type WHEN 1 THEN p_brand || '|' || p_type WHEN 2 THEN p_brand WHEN 3 THEN 'it''s ' || p_brand WHEN 4 THEN p_brand || '|' || p_type WHEN 5 THEN p_brand WHEN 6 THEN p_size::VARCHAR ELSE '' END AS terms FROM part""")
def nested_terms_parse(spark, sf_dir):
    k, b, t = F.col("p_partkey") % 9, F.col("p_brand"), F.col("p_type")
    flat = F.concat(F.lit("['"), b, F.lit("', '"), t, F.lit("']"))
    text = F.when(k == 0, F.concat(F.lit('["'), flat, F.lit('"]'))).when(k == 1, F.concat(F.lit("["), flat, F.lit("]"))).when(k == 2, b).when(k == 3, F.concat(F.lit('["it\'s '), b, F.lit('"]')))
    text = text.when(k == 4, F.concat(F.lit("('"), b, F.lit("', ('None', '"), t, F.lit("'))"))).when(k == 5, F.concat(F.lit("'"), b, F.lit("'"))).when(k == 6, F.col("p_size").cast("string")).when(k == 7, "None")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.nested_terms(text), "|").alias("terms"))


LEVELS = """lev AS (SELECT p_partkey, 'full' AS level, upper(w) AS term FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part) UNION SELECT p_partkey, 'char3', upper(w[1:3]) FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part)
    UNION SELECT p_partkey, 'block', upper(w[1:2]) FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part) UNION SELECT p_partkey, 'chapter', upper(w[1:1]) FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part))"""


def levels_frame(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").alias("codes"))
    char3 = df.select(F.explode("codes").alias("c")).select(F.upper(F.substring("c", 1, 3)).alias("char3")).distinct()
    return codes.code_levels(df, "p_partkey", "codes", char3.select("char3", F.substring("char3", 1, 2).alias("block"), F.substring("char3", 1, 1).alias("chapter")))


@query(f"WITH {LEVELS} SELECT level, term, count(DISTINCT p_partkey) AS df FROM lev GROUP BY 1, 2 HAVING count(DISTINCT p_partkey) >= 10")
def code_vocabulary(spark, sf_dir):
    return codes.code_vocabulary(levels_frame(spark, sf_dir), "p_partkey")


@query(f"WITH {LEVELS} SELECT p_partkey, string_agg(level || ':' || term, ' ' ORDER BY level || ':' || term) AS terms FROM lev GROUP BY 1")
def code_ancestors(spark, sf_dir):
    return codes.ancestors(levels_frame(spark, sf_dir), "p_partkey").select("p_partkey", F.array_join("terms", " ").alias("terms"))


@query(f"WITH {LEVELS}, v AS (SELECT level, term FROM lev GROUP BY 1, 2 HAVING count(DISTINCT p_partkey) >= 40) SELECT p_partkey, lev.level, count(*) AS n, count(v.term) AS kept FROM lev LEFT JOIN v USING (level, term) GROUP BY 1, 2")
def code_retention(spark, sf_dir):
    lev = levels_frame(spark, sf_dir)
    return codes.retained(lev, codes.code_vocabulary(lev, "p_partkey", 40), "p_partkey")


# Scalars


@query(f"SELECT page_id, md5({identity_sql('html')}) AS plain FROM pages")
def identity_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(C.identity_text(F.col("html")).cast("binary")).alias("plain"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM pages")
def path_safe(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.path_safe(F.col("url")).alias("safe"))


@query("SELECT l_orderkey, l_linenumber, round(greatest(0, 1 - abs(l_tax - l_discount) / nullif(abs(l_discount), 0)), 9) AS score FROM lineitem WHERE l_discount <> 0")
def relative_closeness(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_discount <> 0")
    return li.select("l_orderkey", "l_linenumber", F.round(C.closeness(F.col("l_tax"), F.col("l_discount")), 9).alias("score"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 OR event_id % 4 = 1 OR event_id % 4 = 2 THEN 0 ELSE value END::DOUBLE AS x FROM events")
def finite_values(spark, sf_dir):
    i = F.col("event_id")
    x = F.when(i % 4 == 0, F.lit(float("nan"))).when(i % 4 == 1, F.lit(float("-inf"))).when(i % 4 == 3, F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", C.finite(x).alias("x"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate::DATE::VARCHAR WHEN 1 THEN last_day(o_orderdate::DATE)::VARCHAR END AS day FROM orders""")
def coerced_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", C.coerced_date(text).cast("string").alias("day"))


# Joins and guards


@query("""SELECT a.l_orderkey, a.l_returnflag, a.l_linestatus, a.l_linenumber, a.l_quantity AS quantity_a, b.l_quantity AS quantity_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus WHERE b.l_linenumber = a.l_linenumber + 1""")
def three_key_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    return runs.keyed_pairs(li, li.withColumn("l_linenumber", F.col("l_linenumber") - 1), ["l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber"], ("a", "b")).withColumnsRenamed({"l_quantity_a": "quantity_a", "l_quantity_b": "quantity_b"})


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber = 3), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linenumber = 5)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' ELSE 'left' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def row_alignment(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    return audit.one_sided(li.where("l_linenumber = 3"), li.where("l_linenumber = 5"), ["k"])


@query("SELECT p_partkey FROM part WHERE p_partkey % 5 = 0 AND len(list_intersect(string_split(p_name, ' '), (SELECT list(DISTINCT w) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey % 97 = 1)))) > 0")
def shared_terms_guard(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("terms"))
    return audit.overlapping(p.where("p_partkey % 5 = 0"), p.where("p_partkey % 97 = 1"), "p_partkey", "terms").select("p_partkey")


@query("""WITH o AS (SELECT o_orderkey, o_totalprice AS v FROM orders), l AS (SELECT l_orderkey AS o_orderkey, round(sum(l_extendedprice), 2) AS v FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY 1)
    SELECT count(o.v) FILTER (WHERE l.v IS NOT NULL) AS n, count(*) FILTER (WHERE l.v IS NULL) AS only_first, count(*) FILTER (WHERE o.v IS NULL) AS only_second, round(max(abs(o.v - l.v)), 6) AS most, count(*) FILTER (WHERE abs(o.v - l.v) > 50000) AS apart FROM o FULL JOIN l USING (o_orderkey)""")
def integrity_gap(spark, sf_dir):
    first = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 11 <> 0")
    second = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    return audit.integrity(first, second, "o_orderkey", "v", 50_000.0).withColumn("most", F.round("most", 6))


# Aggregates and features


@query("""WITH m AS (SELECT quantile_cont(value, 0.5) AS med FROM events WHERE event_id % 3 <> 0), f AS (SELECT coalesce(CASE WHEN event_id % 3 <> 0 THEN value END, med) AS value FROM events, m)
    SELECT 'value' AS column, round((SELECT med FROM m), 9) AS median, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std FROM f""")
def column_scales(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return features.column_scales(e, ["value"]).select("column", *r9("median", "mean", "std"))


@query("SELECT o_custkey, mode FROM (SELECT o_custkey, o_orderpriority AS mode, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) WHERE r = 1")
def mode_smallest(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct(-F.col("n"), F.col("o_orderpriority"))).alias("mode"))


@query(f"""WITH {SCORED}, l AS (SELECT 'a' AS c, a AS x, y FROM scored UNION ALL SELECT 'b', b, y FROM scored), g AS (SELECT c, y, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY 1, 2), h AS (SELECT *, sum(n * m) OVER (PARTITION BY c) / sum(n) OVER (PARTITION BY c) AS mean FROM g)
    SELECT c AS "column", round((sum(n * (m - mean) * (m - mean)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) AS f FROM h GROUP BY 1""")
def anova_f(spark, sf_dir):
    return features.anova_f(frames.scored(spark, sf_dir).select("a", "b", "y"), ["a", "b"], "y").select("column", F.round("f", 6).alias("f"))


@query("SELECT doc_id, least(len(w), 256)::INT AS n, round(CASE WHEN len(w) > 0 THEN least(len(w), 256) / len(w) ELSE 1 END, 9) AS kept FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents)")
def truncated_words(spark, sf_dir):
    text, kept = features.truncated("text")
    n = F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("int").alias("n"), F.round(kept, 9).alias("kept"))


GRAMS = """toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents), g AS (SELECT doc_id, unnest(w) AS t FROM toks UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM toks, unnest(range(1, len(w))) u(i)),
    counts AS (SELECT doc_id, t, count(*) AS tf FROM g GROUP BY 1, 2), idf AS (SELECT t, ln((1 + (SELECT count(*) FROM documents WHERE doc_id % 5 <> 0)) / (1 + count(*))) + 1 AS idf FROM counts WHERE doc_id % 5 <> 0 GROUP BY 1 HAVING count(*) >= 2 ORDER BY sum(tf) DESC, encode(t) LIMIT 50000),
    raw AS (SELECT doc_id, t, (1 + ln(tf)) * idf AS x FROM counts JOIN idf USING (t)), w AS (SELECT doc_id, t, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


@query(f"WITH {GRAMS} SELECT doc_id, count(*) AS terms, round(max(weight), 9) AS top FROM w GROUP BY 1")
def tfidf_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = cut(features.gram_counts(docs, "doc_id", "text"), "grams")
    idf = cut(features.fit_idf(counts.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 <> 0").count(), most=50_000), "terms")
    return features.tfidf(counts, idf, "doc_id", bounded=True).groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.round(F.max("weight"), 9).alias("top"))


@query("""WITH t AS (SELECT o_orderkey, o_totalprice AS price, o_orderpriority AS pri, c_name AS cust, (o_orderstatus = 'F')::INT AS y FROM orders JOIN customer ON o_custkey = c_custkey), tr AS (SELECT * FROM t WHERE o_orderkey % 4 <> 0),
    te AS (SELECT cust, (sum(y) + 20 * (SELECT avg(y) FROM tr)) / (count(*) + 20) AS e FROM tr GROUP BY 1), tp AS (SELECT pri, (sum(y) + 20 * (SELECT avg(y) FROM tr)) / (count(*) + 20) AS e FROM tr GROUP BY 1)
    SELECT o_orderkey, price, round(coalesce(te.e, (SELECT avg(y) FROM tr)), 9) AS cust_te, round(coalesce(tp.e, (SELECT avg(y) FROM tr)), 9) AS pri_te FROM t LEFT JOIN te USING (cust) LEFT JOIN tp USING (pri) WHERE o_orderkey % 4 = 0""")
def featurizer(spark, sf_dir):
    df = priced_orders(spark, sf_dir).withColumn("y", (F.col("status") == "F").cast("int")).drop("status")
    out = features.Featurizer("o_orderkey", "y").fit(df.where("o_orderkey % 4 <> 0")).transform(df.where("o_orderkey % 4 = 0"))
    return out.select("o_orderkey", "price", F.round("cust__te", 9).alias("cust_te"), F.round("pri__te", 9).alias("pri_te"))


def priced_orders(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("cust"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("pri"), "cust", F.col("o_orderstatus").alias("status"))


@query("""SELECT o_orderkey, o_totalprice AS price, (o_orderpriority = '1-URGENT')::INT::DOUBLE AS urgent, (o_orderpriority = '5-LOW')::INT::DOUBLE AS low, 1 + (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderkey % 4 <> 0) AS n_features FROM orders WHERE o_orderkey % 4 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)""")
def featurizer_classes(spark, sf_dir):
    """Three classes: few levels are one-hot, the column of customers is left out."""
    df = priced_orders(spark, sf_dir)
    fitted = features.Featurizer("o_orderkey", "status", binary=False).fit(df.where("o_orderkey % 4 <> 0"))
    out = fitted.transform(df.where("o_orderkey % 4 = 0"))
    return out.select("o_orderkey", "price", F.col("`pri__1-URGENT`").alias("urgent"), F.col("`pri__5-LOW`").alias("low"), F.lit(len(fitted.names())).cast("long").alias("n_features"))


# Metrics


@query("""WITH e AS (SELECT label % 3 AS y, CASE WHEN embedding[1] >= embedding[2] AND embedding[1] >= embedding[3] THEN 0 WHEN embedding[2] >= embedding[3] THEN 1 ELSE 2 END AS s FROM embeddings),
    f AS (SELECT k, coalesce(2 * sum((y = k AND s = k)::INT) / nullif(sum((y = k)::INT) + sum((s = k)::INT), 0), 0) AS f1 FROM e, range(0, 3) t(k) GROUP BY 1)
    SELECT round((SELECT avg((y = s)::INT) FROM e), 9) AS accuracy, round(avg(f1), 9) AS macro_f1 FROM f""")
def macro_labels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("klass"), *[F.col("embedding")[k].cast("double").alias(f"s{k}") for k in range(3)])
    return ranking.macro_labels(e, "klass", ["s0", "s1", "s2"]).select(*r9("accuracy", "macro_f1"))


@query("SELECT round(avg(p), 9) AS prevalence FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM embeddings GROUP BY label % 3)")
def macro_prevalence(spark, sf_dir):
    return runs.class_shares(table(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("k")), "k").agg(F.round(F.avg("share"), 9).alias("prevalence"))


PCTS = "p AS (SELECT m, id, (rank() OVER (PARTITION BY m ORDER BY v) + (count(*) OVER (PARTITION BY m, v) - 1) / 2 - 1) / greatest(count(*) OVER (PARTITION BY m) - 1, 1) AS pct FROM (SELECT 'a' AS m, id, a AS v FROM scored UNION ALL SELECT 'b', id, b FROM scored UNION ALL SELECT 'c', id, (id % 101)::DOUBLE FROM scored))"


@query(f"WITH {SCORED}, {PCTS} SELECT x.m AS first, z.m AS second, round(corr(x.pct, z.pct), 9) AS spearman, round(sum((x.pct >= 0.9 AND z.pct >= 0.9)::INT) / nullif(sum((x.pct >= 0.9 OR z.pct >= 0.9)::INT), 0), 9) AS top_jaccard FROM p x JOIN p z ON x.id = z.id AND x.m < z.m GROUP BY 1, 2")
def score_correlation(spark, sf_dir):
    df = frames.scored(spark, sf_dir).withColumn("c", (F.col("id") % 101).cast("double")).unpivot(["id"], ["a", "b", "c"], "m", "v")
    return audit.score_correlation(df, "id", "m", "v").select("first", "second", *r9("spearman", "top_jaccard"))


@query(f"WITH {SCORED}, {ranking_sql('scored', 'lang', 'a', name='ra')}, {ranking_sql('scored', 'lang', 'b', name='rb')} SELECT lang, round(CASE WHEN ra.ap > ra.n_pos / (ra.n_pos + ra.n_neg) THEN (ra.ap - rb.ap) / (ra.ap - ra.n_pos / (ra.n_pos + ra.n_neg)) END, 6) AS lost FROM ra JOIN rb USING (lang)")
def skill_lost(spark, sf_dir):
    df = frames.scored(spark, sf_dir)
    a = ranking.ranking_metrics(df, ["lang"], "a", "y").withColumn("base", F.col("n_pos") / (F.col("n_pos") + F.col("n_neg")))
    b = ranking.ranking_metrics(df, ["lang"], "b", "y").select("lang", F.col("ap").alias("ap_b"))
    return a.join(b, "lang").select("lang", F.round(F.when(F.col("ap") > F.col("base"), (F.col("ap") - F.col("ap_b")) / (F.col("ap") - F.col("base"))), 6).alias("lost"))


# Resampling


def ci_sql(values: str, column: str) -> str:
    return f"SELECT round(avg({column}), 9) AS mean, round(quantile_cont({column}, 0.025), 9) AS lo, round(quantile_cont({column}, 0.975), 9) AS hi, round(stddev_pop({column}), 9) AS std, count({column}) AS used, count(*) AS requested FROM {values}"


def ci(values, column):
    return bootstrap.interval(values, column).select(*r9("mean", "lo", "hi", "std"), "used", "requested")


CELLS = """cu AS (SELECT lang, lang || '|' || cluster AS u, row_number() OVER (PARTITION BY lang ORDER BY sha256('unit|' || lang || '|' || cluster)) AS rk, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT DISTINCT lang, cluster FROM scored)),
    cd AS (SELECT lang, draw, ('0x' || substr(sha256('macro|' || lang || '|' || draw || '|' || rk), 1, 8))::BIGINT % n + 1 AS rk FROM cu, range(1, 31) t(draw)),
    cw AS (SELECT d.lang, d.draw, u.u, count(*) AS w FROM cd d JOIN cu u ON d.lang = u.lang AND d.rk = u.rk GROUP BY ALL),
    cr AS (SELECT s.lang || '#' || w.draw AS g, w.lang, w.draw, w.w, s.a, s.b, s.y FROM scored s JOIN cw w ON s.lang = w.lang AND s.lang || '|' || s.cluster = w.u)"""


@query(f"WITH {SCORED}, {CELLS}, {ranking_sql('cr', 'lang, draw', 'a', weight='w', name='ra')}, {ranking_sql('cr', 'lang, draw', 'b', weight='w', name='rb')}, d AS (SELECT draw, avg(ra.ap - rb.ap) AS delta FROM ra JOIN rb USING (lang, draw) GROUP BY 1) {ci_sql('d', 'delta')}")
def macro_bootstrap(spark, sf_dir):
    return ci(bootstrap.macro_paired(frames.scored(spark, sf_dir), "lang", "cluster", "a", "b", "y", 30, "macro"), "delta")


@query(f"""WITH {SCORED}, {DRAWS.format(seed='seeds', draws=30)}, e AS (SELECT w.draw, k, w.w, (k * s.a + (4 - k) * s.b) / 4 AS blend, s.a, s.y FROM scored s JOIN weights w ON s.cluster = w.cluster, range(1, 4) t(k)),
    {ranking_sql('e', 'draw, k', 'blend', weight='w', name='rx')}, {ranking_sql('e', 'draw, k', 'a', weight='w', name='ra')}, d AS (SELECT draw, avg(rx.ap - ra.ap) AS lift FROM rx JOIN ra USING (draw, k) GROUP BY 1) {ci_sql('d', 'lift')}""")
def multi_seed_lift(spark, sf_dir):
    df = frames.scored(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("blend", (F.col("k") * F.col("a") + (4 - F.col("k")) * F.col("b")) / 4)
    both = [bootstrap.resampled(df, "cluster", s, "y", 30, "seeds", ["k"]).select("k", "draw", F.col("ap").alias(s)) for s in ("blend", "a")]
    return ci(both[0].join(both[1], ["k", "draw"]).groupBy("draw").agg(F.avg(F.col("blend") - F.col("a")).alias("lift")), "lift")


@query(f"WITH {SCORED}, {DRAWS.format(seed='mean', draws=50)}, d AS (SELECT draw, sum(w * a) / sum(w) AS mean FROM scored JOIN weights USING (cluster) GROUP BY 1) {ci_sql('d', 'mean')}")
def mean_interval(spark, sf_dir):
    return ci(bootstrap.mean_draws(frames.scored(spark, sf_dir), "cluster", "a", 50, "mean"), "mean")


@query(f"WITH {SCORED}, {DRAWS.format(seed='mean', draws=50)}, d AS (SELECT draw, sum(w * (a - b)) / sum(w) / 1e5 AS mean FROM scored JOIN weights USING (cluster) GROUP BY 1), i AS (SELECT quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM d) SELECT CASE WHEN hi < 0 THEN 'BELOW' WHEN lo > 0 THEN 'ABOVE' WHEN lo >= -0.03 AND hi <= 0.03 THEN 'EQUIVALENT' ELSE 'UNRESOLVED' END AS reading FROM i")
def equivalence_reading(spark, sf_dir):
    df = frames.scored(spark, sf_dir).withColumn("d", (F.col("a") - F.col("b")) / 1e5)
    got = bootstrap.interval(bootstrap.mean_draws(df, "cluster", "d", 50, "mean"), "mean")
    return got.select(C.reading(F.col("lo"), F.col("hi"), 0.03).alias("reading"))


@query(f"""WITH {SCORED}, src AS (SELECT y AS permuted, row_number() OVER (ORDER BY sha256('unit|' || id)) AS rk FROM scored), dst AS (SELECT draw, id, a, row_number() OVER (PARTITION BY draw ORDER BY sha256('perm|' || draw || '|' || id)) AS rk FROM scored, range(1, 20) t(draw)),
    e AS (SELECT draw, a, permuted AS y FROM dst JOIN src USING (rk)), {ranking_sql('scored', '', 'a', name='obs')}, {ranking_sql('e', 'draw', 'a', name='nul')}
    SELECT round((sum((nul.auroc >= obs.auroc)::INT) + 1) / (count(*) + 1), 9) AS p FROM nul, obs""")
def permutation_null(spark, sf_dir):
    df = frames.scored(spark, sf_dir)
    drawn = bootstrap.permuted_labels(df, "id", "y", 19, "perm").join(df.select("id", "a"), "id")
    null = ranking.ranking_metrics(drawn, ["draw"], "a", "permuted", edges=ranking.score_edges(df, [], "a")).select(F.col("auroc").alias("x"))
    seen = ranking.ranking_metrics(df, [], "a", "y").select("auroc")
    return null.crossJoin(F.broadcast(seen)).agg(F.round(bootstrap.permutation_p(F.col("auroc"), F.col("x")), 9).alias("p"))  # one row


# Tests

RANKS = "r AS (SELECT lang, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS rk, count(*) OVER (PARTITION BY a) AS t FROM scored), g AS (SELECT lang, sum(rk) AS r, count(*) AS k, sum(t * t - 1) AS t FROM r GROUP BY 1)"


def simpson(f: str, low: str, width: str, steps: int = 20_000) -> str:
    """A scalar subquery: the integral of f, in which x is the variable, from low over width."""
    x = f"({low} + i * {width} / {steps})"
    return f"(SELECT sum((CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({f.replace('@x', x)})) * {width} / {steps} / 3 FROM range(0, {steps + 1}) q(i))"


@query(f"""WITH {SCORED}, {RANKS}, k AS (SELECT (12 / (sum(k) * (sum(k) + 1)) * sum(r * r / k) - 3 * (sum(k) + 1)) / (1 - sum(t) / (sum(k)::DOUBLE * sum(k) * sum(k) - sum(k))) AS h, count(*) - 1 AS df FROM g)
    SELECT round(h, 6) AS h, df, round({simpson("pow(@x, df / 2 - 1) * exp(-@x / 2)", "h", "200")} / (pow(2, df / 2) * gamma(df / 2)), 6) AS p FROM k""")
def kruskal_wallis(spark, sf_dir):
    return exact_tests.kruskal(frames.scored(spark, sf_dir), "lang", "a").select(F.round("h", 6).alias("h"), "df", F.round("p", 6).alias("p"))


@query(f"""WITH {SCORED}, d AS (SELECT abs(a - 20 * b) AS s, sign(a - 20 * b) AS g FROM scored WHERE a <> 20 * b), r AS (SELECT g, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk, count(*) OVER (PARTITION BY s) AS t FROM d), n AS (SELECT sum(rk) FILTER (WHERE g > 0) AS w, count(*)::DOUBLE AS n, sum(t * t - 1) AS t FROM r),
    z AS (SELECT w AS w_plus, n::BIGINT AS n, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48) AS z FROM n)
    SELECT w_plus, n, round(z, 6) AS z, round(2 * {simpson("exp(-@x * @x / 2)", "abs(z)", "40")} / sqrt(2 * pi()), 6) AS p FROM z""")
def wilcoxon_signed(spark, sf_dir):
    df = frames.scored(spark, sf_dir).withColumn("b20", 20 * F.col("b"))
    return exact_tests.wilcoxon(df, "a", "b20").select("w_plus", "n", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


@query(f"""WITH {SCORED}, r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM scored),
    c AS (SELECT count(*) AS n, corr(ra, rb) AS rho FROM r), t AS (SELECT n, rho, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t, n - 2 AS v FROM c)
    SELECT n, round(rho, 9) AS rho, round(1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * {simpson("pow(1 + @x * @x / v, -(v + 1) / 2)", "0", "t")}, 6) AS p FROM t""")
def spearman_test(spark, sf_dir):
    return exact_tests.spearman(frames.scored(spark, sf_dir), "a", "b").select("n", F.round("rho", 9).alias("rho"), F.round("p", 6).alias("p"))


TWO = "t AS (SELECT lang, sum((a > 1500 AND y = 1)::INT)::BIGINT AS a, sum((a > 1500 AND y = 0)::INT)::BIGINT AS b, sum((a <= 1500 AND y = 1)::INT)::BIGINT AS c, sum((a <= 1500 AND y = 0)::INT)::BIGINT AS d FROM scored GROUP BY 1)"
TABLES = """e AS (SELECT lang, i, a AS x, exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) + lgamma(c + d + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) AS p FROM t, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) u(i)),
    f AS (SELECT *, max(p) FILTER (WHERE i = x) OVER (PARTITION BY lang) AS p0 FROM e)"""


def two_by_two(spark, sf_dir):
    df, big, y = frames.scored(spark, sf_dir), F.col("a") > 1500, F.col("y") == 1
    n = lambda x: F.sum(x.cast("long"))
    return df.groupBy("lang").agg(n(big & y).alias("a"), n(big & ~y).alias("b"), n(~big & y).alias("c"), n(~big & ~y).alias("d"))


@query(f"""WITH {SCORED}, {TWO}, {TABLES} SELECT lang, round(least(1, sum(p) FILTER (WHERE p <= p0 * (1 + 1e-7))), 6) AS two_sided, round(least(1, sum(p) FILTER (WHERE i >= x)), 6) AS greater FROM f GROUP BY 1""")
def fisher_exact(spark, sf_dir):
    return exact_tests.fisher(two_by_two(spark, sf_dir), ["lang"], "a", "b", "c", "d").select("lang", *[F.round(c, 6).alias(c) for c in ("two_sided", "greater")])


@query(f"""WITH {SCORED}, {TWO}, {TABLES}, p AS (SELECT lang, least(1, sum(p) FILTER (WHERE p <= p0 * (1 + 1e-7))) AS p FROM f GROUP BY 1), v AS (SELECT lang, a + b + c + d AS n, (a / nullif(a + c, 0) + d / nullif(b + d, 0)) / 2 AS acc FROM t)
    SELECT lang, n, round(acc, 9) AS balanced_accuracy, round(CASE WHEN acc IS NOT NULL THEN p END, 6) AS p, coalesce(acc IS NOT NULL AND p < 0.05 / (SELECT count(*) FROM t), false) AS significant FROM v JOIN p USING (lang)""")
def accuracy_tests(spark, sf_dir):
    df = frames.scored(spark, sf_dir).withColumn("said", F.col("a") > 1500)
    return exact_tests.accuracy_tests(df, "lang", "said", "y").select("lang", "n", F.round("balanced_accuracy", 9).alias("balanced_accuracy"), F.round("p", 6).alias("p"), "significant")


@query(f"WITH {SCORED}, {TWO}, e AS (SELECT lang, b, i, exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)) AS p FROM t, unnest(range(0, b + c + 1)) u(i)) SELECT lang, round(coalesce(sum(p) FILTER (WHERE i >= b), 0), 6) AS p FROM e GROUP BY 1")
def mcnemar_exact(spark, sf_dir):
    return two_by_two(spark, sf_dir).select("lang", F.round(exact_tests.mcnemar(F.col("b"), F.col("c")), 6).alias("p"))


@query(f"""WITH RECURSIVE {SCORED}, {TWO}, goal AS (SELECT lang, 'lo' AS side, a AS k, a + b AS n, 0.025 AS goal FROM t UNION ALL SELECT lang, 'hi', a + 1, a + b, 0.975 FROM t),
    bis AS (SELECT lang, side, k, n, goal, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM goal WHERE n > 0 UNION ALL
        SELECT lang, side, k, n, goal, CASE WHEN big THEN lo ELSE (lo + hi) / 2 END, CASE WHEN big THEN (lo + hi) / 2 ELSE hi END, step + 1
        FROM (SELECT *, (SELECT coalesce(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2))), 0) FROM unnest(range(k, n + 1)) u(i)) > goal AS big FROM bis WHERE step < 40))
    SELECT t.lang, round(CASE WHEN t.a + t.b = 0 THEN NULL WHEN t.a = 0 THEN 0 ELSE x.lo END, 6) AS lo, round(CASE WHEN t.a + t.b = 0 THEN NULL WHEN t.b = 0 THEN 1 ELSE y.lo END, 6) AS hi
    FROM t LEFT JOIN bis x ON t.lang = x.lang AND x.side = 'lo' AND x.step = 40 LEFT JOIN bis y ON t.lang = y.lang AND y.side = 'hi' AND y.step = 40""")
def clopper_pearson(spark, sf_dir):
    ends = two_by_two(spark, sf_dir).select("lang", exact_tests.clopper_pearson(F.col("a"), F.col("a") + F.col("b")).alias("e"))
    return ends.select("lang", F.round("e.lo", 6).alias("lo"), F.round("e.hi", 6).alias("hi"))


# Splits


@query("SELECT doc_id, CASE WHEN r <= 100 THEN 0 WHEN r <= 130 THEN 1 END::INT AS fold FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('sized|' || doc_id)) AS r FROM labels)")
def sized_folds(spark, sf_dir):
    return splits.sized_folds(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", [100, 30], "sized")


@query("SELECT doc_id, coalesce(lead(doc_id) OVER o, first(doc_id) OVER o) AS other FROM (SELECT DISTINCT doc_id FROM labels) WINDOW o AS (ORDER BY sha256('shift|' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def derangement(spark, sf_dir):
    return splits.derangement(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "shift")


@query("""WITH c AS (SELECT quality, greatest(1, round(count(*) * least(1, 60 / sum(count(*)) OVER ()))) AS q FROM labels GROUP BY 1), r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('cap|' || doc_id), doc_id) AS r FROM labels)
    SELECT doc_id, r.quality FROM r JOIN c USING (quality) WHERE r <= q""")
def capped_sample(spark, sf_dir):
    return splits.capped_sample(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality", 60, "cap")


@query("""WITH RECURSIVE f AS (SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS k FROM part WHERE p_type IS NOT NULL GROUP BY 1),
    deal AS (SELECT 0::BIGINT AS k, [0, 0, 0]::BIGINT[] AS loads, NULL::VARCHAR AS p_type, NULL::BIGINT AS fold UNION ALL SELECT f.k, list_transform(d.loads, lambda x, i: CASE WHEN i = list_position(d.loads, list_min(d.loads)) THEN x + f.n ELSE x END), f.p_type, list_position(d.loads, list_min(d.loads)) - 1 FROM deal d JOIN f ON f.k = d.k + 1)
    SELECT p_partkey, CASE WHEN fold = 1 THEN 'eval' ELSE 'train' END AS part FROM part LEFT JOIN deal USING (p_type)""")
def holdout_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return splits.holdout_rows(p, "p_partkey", "p_type", splits.family_folds(p, "p_type", 3), 1).select("p_partkey", "part")


# Runs, bins and costs


@query(f"WITH {RUNS}, g AS (SELECT method, CASE WHEN method < 'm3' THEN 'low' ELSE 'high' END AS family, cell, avg(value) - 0.5 AS gain FROM runs GROUP BY 1, 2, 3) SELECT family, round(avg(gain), 9) AS mean, count(*) AS n, sum((abs(gain) > 0.02)::INT)::BIGINT AS exceeds, min(sign(gain)) = max(sign(gain)) AS one_sign FROM g GROUP BY 1")
def family_rollup(spark, sf_dir):
    gains = frames.runs(spark, sf_dir).groupBy("method", "cell").agg((F.avg("value") - 0.5).alias("gain")).withColumn("family", F.when(F.col("method") < "m3", "low").otherwise("high"))
    return runs.family_rollup(gains, "family", "gain", 0.02).withColumn("mean", F.round("mean", 9))


@query("""SELECT role, round(sum((length(text) * 3.0 + turn * 5.0) * CASE WHEN conv_id % 2 = 0 THEN 0.5 ELSE 1 END) / 1e6, 9) AS usd, round(sum(length(text) * 3.0 + turn * 5.0) / 1e6, 9) AS sync_usd, count(DISTINCT conv_id % 2) > 1 AS mixed FROM conversations GROUP BY 1""")
def tier_costs(spark, sf_dir):
    calls = table(spark, sf_dir, "conversations").select("role", F.length("text").cast("bigint").alias("tokens_in"), F.col("turn").alias("tokens_out"), F.when(F.col("conv_id") % 2 == 0, "batch").otherwise("sync").alias("tier"))
    prices = calls.select("role").distinct().select("role", F.lit(3.0).alias("usd_in"), F.lit(5.0).alias("usd_out"), F.lit(0.5).alias("batch"))
    return runs.tier_cost(calls, prices, "role", "tier").select("role", *r9("usd", "sync_usd"), "mixed")


@query(f"WITH {SCORED}, e AS (SELECT list_distinct(quantile_cont(a, [0.25, 0.5, 0.75])) AS e FROM scored WHERE id % 5 <> 0) SELECT len(list_filter(e, lambda x: x < a))::INT AS bin, count(*) AS n FROM scored, e WHERE id % 5 = 0 GROUP BY 1")
def right_closed_bins(spark, sf_dir):
    df = frames.scored(spark, sf_dir)
    return audit.right_closed_bins(df.where("id % 5 <> 0"), df.where("id % 5 = 0"), "a", 4).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RUNS} SELECT method, cell, seed FROM runs WHERE (cell, seed) IN (SELECT cell, seed FROM runs WHERE method = 'm3')")
def shared_pairs(spark, sf_dir):
    df = frames.runs(spark, sf_dir).select("method", "cell", "seed")
    return df.join(df.where("method = 'm3'").select("cell", "seed"), ["cell", "seed"], "left_semi").select("method", "cell", "seed")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
def top_rows(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(15)


@query("""WITH t AS (SELECT 'old' AS frame, nullif(event_type, 'view') AS event_type, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'new', nullif(event_type, 'click'), value FROM events WHERE event_id % 2 = 1)
    SELECT 'event_type' AS column, round(avg((event_type IS NULL)::INT) FILTER (WHERE frame = 'old'), 9) AS before, round(avg((event_type IS NULL)::INT) FILTER (WHERE frame = 'new'), 9) AS after FROM t UNION ALL SELECT 'value', round(avg((value IS NULL)::INT) FILTER (WHERE frame = 'old'), 9), round(avg((value IS NULL)::INT) FILTER (WHERE frame = 'new'), 9) FROM t""")
def missing_rates_compared(spark, sf_dir):
    from evalloom.operators.registry_tables import missing_rates

    e = table(spark, sf_dir, "events")
    one = lambda part, gone, name: missing_rates(e.where(F.col("event_id") % 2 == part).select(F.nullif(F.col("event_type"), F.lit(gone)).alias("event_type"), "value"), ["event_type", "value"]).select("column", F.round("rate", 9).alias(name))
    return one(0, "view", "before").join(one(1, "click", "after"), "column")


@query()
def tfidf_logreg_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return methods.text_scores(docs, "doc_id", "text", "quality")


def phrased_documents(spark, sf_dir):
    """A document's first two words stand for its condition's names."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return docs.withColumn("phrases", F.slice(F.split(F.coalesce("text", F.lit("")), " ", 3), 1, 2))


@query()
def disease_text_only_scores(spark, sf_dir):
    return methods.text_scores(phrased_documents(spark, sf_dir), "doc_id", "text", "quality", "disease_text_only", "phrases")


@query()
def disease_blind_scores(spark, sf_dir):
    return methods.text_scores(phrased_documents(spark, sf_dir), "doc_id", "text", "quality", "disease_blind", "phrases")


@query()
def frozen_reference_scores(spark, sf_dir):
    """One reference, fitted on the labelled documents of all languages, scores benchmark items, another source, without being fitted again."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit(None).cast("int").alias("quality"))
    return methods.text_scores(items, "doc_id", "text", "quality", train=docs).select(F.col("doc_id").alias("item_id"), "proba")


@query(f"""WITH {SCORED}, m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM scored WHERE id % 5 <> 0), z AS (SELECT id, y, (a - ma) / sa AS za, (b - mb) / sb AS zb FROM scored, m),
    d AS (SELECT t.id, r.y, row_number() OVER (PARTITION BY t.id ORDER BY round(pow(t.za - r.za, 2) + pow(t.zb - r.zb, 2), 9), r.id) AS k FROM z t JOIN z r ON t.id % 5 = 0 AND r.id % 5 <> 0) SELECT id, round(avg(y), 9) AS proba FROM d WHERE k <= 25 GROUP BY 1""")
def knn_scores(spark, sf_dir):
    return methods.knn_scores(frames.scored(spark, sf_dir)).select("id", F.round("proba", 9).alias("proba"))


@query()
def tuned_logreg_scores(spark, sf_dir):
    return methods.tuned_scores(frames.scored(spark, sf_dir))
