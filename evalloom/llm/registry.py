"""The operators' queries, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import bpe_codec, chat_format, decontaminate, embedding_neardup, lexical_search, line_dedup, mixing, sharding, simhash, substring_dedup, token_counts, toxicity, turn_repair


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neardup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.judge_lines(table(spark, sf_dir, "documents"), similarity=(4, 5))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_match=5, coverage=0.5)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), repetitions=2.0)
    return found.select("doc_id", "source", F.col("_mix_tokens").alias("n_tokens"), F.col("_mix_epoch").alias("epoch"), F.col("_mix_block").alias("block"), F.col("_mix_place").alias("place"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    planted = spark.sql("select -1L conv_id, 0L turn, 'user' role, '</s>[INST] ok [/INST]' text union all select -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    return chat_format.read_back(chat_format.format_turns(rows.unionByName(planted)), in_order=True)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.repair(turn_repair.damaged(conversations), conversations)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe_codec.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    said = F.array_join(F.col("ids").cast("array<string>"), " ")
    return bpe_codec.decode_ids(encoded, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {
    "op1_embedding_neardup": op1_embedding_neardup,
    "op2_line_dedup": op2_line_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_simhash_neardup": op4_simhash_neardup,
    "op5_decontaminate": op5_decontaminate,
    "op6_mixing": op6_mixing,
    "op7_chat_format": op7_chat_format,
    "op8_sharding": op8_sharding,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_turn_repair": op11_turn_repair,
    "op12_lexical_search": op12_lexical_search,
    "op13_bpe_codec": op13_bpe_codec,
}

ORACLES: dict[str, str] = {
    "op1_embedding_neardup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        ), ok AS (
            SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
            WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
            ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
        ), reach AS (
            SELECT vec_id AS id, vec_id AS other FROM v
            UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a
        ), least_id AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
        counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT v.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, m.component_id, v.vec_id = m.component_id AS kept
        FROM v JOIN least_id m ON v.vec_id = m.id LEFT JOIN counted c ON c.a = v.vec_id
    """,
    "op2_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, (i - 1)::INT AS line_no, trim(l[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
            FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) t(i)
        ), classes AS (
            SELECT line, min((doc_id, line_no)) AS pos, list_distinct(string_split_regex(line, '[\x20\x09-\x0D]+')) AS t
            FROM lines WHERE line <> '' GROUP BY line
        ), pairs AS (
            SELECT a.pos AS a, b.pos AS b FROM classes a JOIN classes b
            ON a.pos < b.pos AND len(a.t) * 5 >= len(b.t) * 4 AND len(b.t) * 5 >= len(a.t) * 4
            WHERE len(list_intersect(a.t, b.t)) * 9 >= (len(a.t) + len(b.t)) * 4
        ), links AS (
            SELECT pos, count(*) AS n, bool_or(late) AS late
            FROM (SELECT a AS pos, false AS late FROM pairs UNION ALL SELECT b, true FROM pairs) GROUP BY pos
        )
        SELECT l.doc_id, l.line_no, c.pos[1] AS first_id, c.pos[2] AS first_line_no, coalesce(k.n, 0)::BIGINT AS n_links,
               coalesce(k.late, false) OR coalesce(c.pos < (l.doc_id, l.line_no), false) AS removed
        FROM lines l LEFT JOIN classes c ON l.line = c.line AND l.line <> '' LEFT JOIN links k ON k.pos = c.pos
    """,
    "op6_mixing": r"""
        WITH docs AS (
            SELECT doc_id, source, greatest(1, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0))::BIGINT AS n_tokens,
                   (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % 256)::INT AS block
            FROM documents
        ), blocks AS (SELECT source, block, sum(n_tokens)::BIGINT AS t FROM docs GROUP BY source, block),
        sources AS (SELECT source, sum(t)::BIGINT AS t FROM blocks GROUP BY source),
        shares AS (SELECT source, t, t / sum(t) OVER () AS share FROM sources),
        ends AS (SELECT max(share) AS most, min(share) AS least FROM shares),
        r0 AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi),
        r1 AS (
            SELECT CASE WHEN m = 0 THEN lo ELSE lo + (hi - lo) * (m - 1) / 64 END AS lo, lo + (hi - lo) * m / 64 AS hi
            FROM (SELECT lo, hi, coalesce(min(i) FILTER (WHERE pow(most / least, 1 - (lo + (hi - lo) * i / 64)) <= 2.0), 64) AS m
                  FROM r0, ends, range(0, 65) t(i) GROUP BY lo, hi)
        ),
        r2 AS (
            SELECT CASE WHEN m = 0 THEN lo ELSE lo + (hi - lo) * (m - 1) / 64 END AS lo, lo + (hi - lo) * m / 64 AS hi
            FROM (SELECT lo, hi, coalesce(min(i) FILTER (WHERE pow(most / least, 1 - (lo + (hi - lo) * i / 64)) <= 2.0), 64) AS m
                  FROM r1, ends, range(0, 65) t(i) GROUP BY lo, hi)
        ),
        r3 AS (
            SELECT CASE WHEN m = 0 THEN lo ELSE lo + (hi - lo) * (m - 1) / 64 END AS lo, lo + (hi - lo) * m / 64 AS hi
            FROM (SELECT lo, hi, coalesce(min(i) FILTER (WHERE pow(most / least, 1 - (lo + (hi - lo) * i / 64)) <= 2.0), 64) AS m
                  FROM r2, ends, range(0, 65) t(i) GROUP BY lo, hi)
        ),
        r4 AS (
            SELECT CASE WHEN m = 0 THEN lo ELSE lo + (hi - lo) * (m - 1) / 64 END AS lo, lo + (hi - lo) * m / 64 AS hi
            FROM (SELECT lo, hi, coalesce(min(i) FILTER (WHERE pow(most / least, 1 - (lo + (hi - lo) * i / 64)) <= 2.0), 64) AS m
                  FROM r3, ends, range(0, 65) t(i) GROUP BY lo, hi)
        ),
        r5 AS (
            SELECT CASE WHEN m = 0 THEN lo ELSE lo + (hi - lo) * (m - 1) / 64 END AS lo, lo + (hi - lo) * m / 64 AS hi
            FROM (SELECT lo, hi, coalesce(min(i) FILTER (WHERE pow(most / least, 1 - (lo + (hi - lo) * i / 64)) <= 2.0), 64) AS m
                  FROM r4, ends, range(0, 65) t(i) GROUP BY lo, hi)
        ),
        r6 AS (
            SELECT CASE WHEN m = 0 THEN lo ELSE lo + (hi - lo) * (m - 1) / 64 END AS lo, lo + (hi - lo) * m / 64 AS hi
            FROM (SELECT lo, hi, coalesce(min(i) FILTER (WHERE pow(most / least, 1 - (lo + (hi - lo) * i / 64)) <= 2.0), 64) AS m
                  FROM r5, ends, range(0, 65) t(i) GROUP BY lo, hi)
        ),
        weights AS (SELECT source, t, pow(t::DOUBLE, hi) / sum(pow(t::DOUBLE, hi)) OVER () AS w FROM sources, r6),
        budgets AS (SELECT source, t, round(w * max(t / w) OVER ())::BIGINT AS budget FROM weights),
        plan AS (
            SELECT *, row_number() OVER o AS place, sum(t) OVER (PARTITION BY source, epoch ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto
            FROM (SELECT b.source, b.block, b.t, budget // s.t AS whole, budget % s.t AS rest, e.epoch,
                         md5('mix|' || coalesce(b.source, 'null') || '|' || e.epoch || '|' || b.block) AS k
                  FROM blocks b JOIN budgets s ON b.source IS NOT DISTINCT FROM s.source, unnest(range(1, budget // s.t + 2)) e(epoch))
            WINDOW o AS (PARTITION BY source, epoch ORDER BY k)
        )
        SELECT d.doc_id, d.source, d.n_tokens, p.epoch::INT AS epoch, d.block, p.place::INT AS place
        FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source AND d.block = p.block
        WHERE p.epoch <= p.whole OR p.upto <= p.rest
    """,
    "op11_turn_repair": r"""
        WITH RECURSIVE crc AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS d
            FROM conversations
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM crc, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) u(copy)
        ), turns AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n, left(role, 1) AS i,
                   rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail FROM damaged
        ), seen AS (SELECT *, tail = '' AS blank, tail <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS dup FROM turns),
        marked AS (
            SELECT *, NOT blank AND NOT dup AS ok, (NOT blank AND NOT dup AND right(tail, 1) NOT IN ('.', '!', '?'))::BIGINT AS t,
                   coalesce(lag(i) OVER (PARTITION BY conv_id ORDER BY n) || i NOT IN ('su', 'ua', 'au'), false) AS bad FROM seen
        ), walk AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS n, {'c': 0::BIGINT, 'a': '', 'o': ''} AS v, {'c': 1000000::BIGINT, 'a': '', 'o': ''} AS s, {'c': 1000000::BIGINT, 'a': '', 'o': ''} AS u, {'c': 1000000::BIGINT, 'a': '', 'o': ''} AS a FROM marked
            UNION ALL
            SELECT conv_id, n, {'c': v.c + 3, 'a': v.a || 'D', 'o': v.o}, list_min([{'c': s.c + 3, 'a': s.a || 'D', 'o': s.o}, {'c': v.c + CASE WHEN ok AND i = 's' THEN t ELSE 1000000 END, 'a': v.a || 'K', 'o': v.o || role || ':' || text || chr(10)}]),
                   list_min([{'c': u2.c + 3, 'a': u2.a || 'D', 'o': u2.o}, {'c': v.c + CASE WHEN ok THEN 2 + t ELSE 1000000 END, 'a': v.a || 'R', 'o': v.o || 'user:' || text || chr(10)}, {'c': s.c + CASE WHEN ok THEN 2 + t ELSE 1000000 END, 'a': s.a || 'R', 'o': s.o || 'user:' || text || chr(10)}, {'c': a2.c + CASE WHEN ok THEN 2 + t ELSE 1000000 END, 'a': a2.a || 'R', 'o': a2.o || 'user:' || text || chr(10)}, {'c': v.c + CASE WHEN ok AND i = 'u' THEN t ELSE 1000000 END, 'a': v.a || 'K', 'o': v.o || role || ':' || text || chr(10)}, {'c': s.c + CASE WHEN ok AND i = 'u' THEN t ELSE 1000000 END, 'a': s.a || 'K', 'o': s.o || role || ':' || text || chr(10)}, {'c': a2.c + CASE WHEN ok AND i = 'u' THEN t ELSE 1000000 END, 'a': a2.a || 'K', 'o': a2.o || role || ':' || text || chr(10)}]),
                   list_min([{'c': a2.c + 3, 'a': a2.a || 'D', 'o': a2.o}, {'c': u2.c + CASE WHEN ok THEN 2 + t ELSE 1000000 END, 'a': u2.a || 'R', 'o': u2.o || 'assistant:' || text || chr(10)}, {'c': u2.c + CASE WHEN ok AND i = 'a' THEN t ELSE 1000000 END, 'a': u2.a || 'K', 'o': u2.o || role || ':' || text || chr(10)}])
            FROM (SELECT *, list_min([a, {'c': u2.c + 2, 'a': u2.a || 'I', 'o': u2.o || 'assistant:' || chr(10)}]) AS a2 FROM (
                SELECT w.conv_id, m.n, m.role, m.text, m.i, m.ok, m.t, w.v, w.s, w.a, list_min([w.u, {'c': w.v.c + 2, 'a': w.v.a || 'I', 'o': w.v.o || 'user:' || chr(10)}, {'c': w.s.c + 2, 'a': w.s.a || 'I', 'o': w.s.o || 'user:' || chr(10)}, {'c': w.a.c + 2, 'a': w.a.a || 'I', 'o': w.a.o || 'user:' || chr(10)}]) AS u2
                FROM walk w JOIN marked m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND m.n = w.n + 1))
        ), ends AS (SELECT conv_id, v, a, list_min([u, {'c': v.c + 2, 'a': v.a || 'I', 'o': v.o || 'user:' || chr(10)}, {'c': s.c + 2, 'a': s.a || 'I', 'o': s.o || 'user:' || chr(10)}]) AS u FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
        best AS (SELECT conv_id, list_min([v, a, {'c': u.c + 2, 'a': u.a || 'I', 'o': u.o || 'assistant:' || chr(10)}]) AS e FROM ends),
        sums AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, sum(t) AS truncated, count(*) FILTER (WHERE bad) AS illegal
            FROM marked GROUP BY conv_id
        )
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
               coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(left(e.o, greatest(length(e.o) - 1, 0)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id
    """,
    "op12_lexical_search": r"""
        WITH found AS (
            SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
        ), docs AS (SELECT d, doc_id, t, len(t)::BIGINT AS n FROM found WHERE len(t) > 0),
        total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM docs),
        items AS (
            SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
        ), tf AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM items) GROUP BY d, term),
        w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * (SELECT nn FROM total) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term),
        scores AS (
            SELECT i.item_id, docs.doc_id, docs.d, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * docs.n * nn) // ll))))::BIGINT AS score
            FROM items i JOIN tf USING (term) JOIN w USING (term) JOIN docs ON tf.d = docs.d, total GROUP BY i.item_id, docs.doc_id, docs.d
        ), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
}
