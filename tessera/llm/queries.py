"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat_format, decontamination, filter_audit, lexical_search, ngram_join, nn_descent, packing, pii, quality_rules, token_binary, token_counts, url_filter, warc_revisits
from tessera.llm.common import once, table
from tessera.sources.storage import new_path

END_ID = 2
#: host, path, action.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Hosts that are blocked where no rule says otherwise.
LISTED = tuple((f"{name}.example.{end}", "/") for name in ("ads-track", "adult-x") for end in ("com", "net", "org"))


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def constants(spark: SparkSession, rows, *names: str) -> DataFrame:
    """A small table of strings."""
    each = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(row, names, strict=True)]) for row in rows])
    return spark.range(1).select(F.inline(each))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return made.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_binary.write(table(spark, sf_dir, "documents"), path, tokenizer("byte_bpe_50k.json"), END_ID)
    return token_binary.read_documents(spark, path)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    back = chat_format.read_back(chat_format.examples(turns.unionByName(probe)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(F.array_join("replies", "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join("replies", ""), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), END_ID, slice_bytes=16_000_000).drop("ids")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = once(table(spark, sf_dir, "documents").select("doc_id", "text"), "s", pii.all_spans(F.col("text")))
    base = [k.name for k in pii.KINDS if k.base]

    def named(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kinds):
        return F.filter("s", lambda s: s["kind"].isin(kinds))

    return found.select(
        "doc_id",
        *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(named(of(base)), 256).alias("base_sha256"),
        named(F.col("s")).alias("spans"),
    )


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc_revisits.resolve(warc_revisits.captures(table(spark, sf_dir, "pages")))
    said = F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    return made.withColumn("headers", F.array_join(said, "\n"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, listed = constants(spark, RULES, "host", "path", "action"), constants(spark, LISTED, "host", "path")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules, listed).select("page_id", "host", "path", "rule", "verdict")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), words=3, percent=90)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.lit(quality_rules.mask(quality_rules.BASE))
    return quality_rules.apply_policy(made, "web-2").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(base) != 0).alias("base_failed"),
        "kept",
        "fail_bits",
    )


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def ablation_of_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of a policy does alone, and what would stay without it."""
    return quality_rules.ablation(quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "web-2")


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_token_binary,
        op3_chat_format,
        op4_packing,
        op5_pii,
        op6_warc_revisits,
        op7_url_filter,
        op8_ngram_join,
        op9_token_counts,
        op10_quality_rules,
        op11_embedding_near_dedup,
        op12_filter_audit,
        op13_lexical_search,
        ablation_of_rules,
    )
}


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_TERMS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_OP10_MASK = quality_rules.mask(quality_rules.POLICIES["web-2"])

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_ITEM_WORDS} AS w FROM benchmark),
 bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
 d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
 dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
 h AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
 p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS q FROM h) GROUP BY 1),
 t AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op3_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
 e AS (SELECT *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\<]', '', 'g')) + 19 AS made, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
 f AS (SELECT *, sum(made) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, (sum(upto) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars FROM f GROUP BY conv_id""",
    "op6_warc_revisits": r"""
WITH p AS (SELECT page_id, url, length(html) AS size, md5(html) AS h, (page_id * 7919) % 1000003 AS t0, page_id % 4 AS turn FROM pages),
 r AS (SELECT page_id * 4 AS record_id, url, t0 AS ts, 'response' AS kind, h AS etag, 'day ' || t0 % 365 AS lm, h AS digest, size FROM p
  UNION ALL SELECT page_id * 4 + 1, url, t0 + 3600, 'revisit', 'W/' || h, 'day ' || t0 % 365, NULL, 0 FROM p
  UNION ALL SELECT page_id * 4 + 2, url, t0 + 7200, 'revisit', CASE turn WHEN 0 THEN h WHEN 1 THEN 'other' END, CASE turn WHEN 2 THEN 'day ' || t0 % 365 END, NULL, 0 FROM p
  UNION ALL SELECT page_id * 4 + 3, url, t0 - 60, 'revisit', h, 'day ' || t0 % 365, h, 0 FROM p),
 k AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.|:(80|443)$', '') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS page,
  list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$'))) AS q FROM r),
 c AS (SELECT * EXCLUDE (page, q), page || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url FROM k),
 b AS (SELECT *, max(CASE WHEN kind = 'response' THEN {'ts': ts, 'id': record_id, 'etag': etag, 'lm': lm, 'digest': digest, 'size': size} END) OVER (PARTITION BY canonical_url ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM c),
 v AS (SELECT *, CASE WHEN kind = 'response' THEN 'response' WHEN base IS NULL THEN 'no_base'
  WHEN etag IS NOT NULL THEN CASE WHEN replace(etag, 'W/', '') = base.etag THEN 'resolved' ELSE 'mismatch' END
  WHEN lm IS NOT NULL THEN CASE WHEN lm = base.lm THEN 'resolved' ELSE 'mismatch' END ELSE 'unverified' END AS verdict FROM b)
SELECT record_id, canonical_url, ts, kind, CASE WHEN kind = 'response' THEN record_id WHEN verdict IN ('resolved', 'unverified') THEN base.id END AS base_id, verdict, CASE WHEN verdict = 'resolved' THEN base.digest ELSE digest END AS digest,
 'content-length: ' || CASE WHEN verdict = 'resolved' THEN base.size ELSE size END || chr(10) || CASE WHEN verdict IN ('response', 'resolved') THEN 'content-type: text/html' || chr(10) ELSE '' END || 'date: ' || ts AS headers
FROM v""",
    "op7_url_filter": f"""
WITH r(host, path, action, is_rule) AS (VALUES {", ".join(f"('{h}', '{p}', '{a}', 1)" for h, p, a in RULES)}, {", ".join(f"('{h}', '{p}', 'block', 0)" for h, p in LISTED)}),
 p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
 c AS (SELECT page_id, host, path, 1 AS is_rule FROM p UNION ALL SELECT page_id, rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.'), CASE WHEN path = '' AND host <> '' THEN '/' ELSE path END, 0 FROM p),
 m AS (SELECT c.page_id, max({{'is_rule': r.is_rule, 'n': length(r.host || r.path), 'h': length(r.host), 'action': r.action, 'key': r.host || r.path}}) AS best FROM c JOIN r ON c.is_rule = r.is_rule AND (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path) GROUP BY 1)
SELECT page_id, host, path, CASE WHEN best.is_rule = 1 THEN best.key END AS rule, coalesce(best.action, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
    "op8_ngram_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
 e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 c(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, c.r FROM c JOIN e ON e.x = c.doc_id WHERE c.r < e.y),
 k AS (SELECT doc_id, min(r) AS component_id FROM c GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN k USING (doc_id)""",
    "op10_quality_rules": rf"""
WITH d AS (SELECT doc_id, text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D\x20]')) AS l FROM documents),
 g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d)),
 r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS q FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
 m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(coalesce(text, ''), '[^!]', '', 'g')) AS n_excl,
  len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_stutter, len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
 f AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_excl > 50 * n_words THEN 8 ELSE 0 END
  + CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END + CASE WHEN n_lines >= 10 AND 100 * n_dup_lines > 70 * n_lines THEN 32 ELSE 0 END + CASE WHEN 100 * n_stutter > 30 * n_words THEN 64 ELSE 0 END + CASE WHEN n_words = 0 THEN 128 ELSE 0 END)::INT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits & {_OP10_MASK} = 0 AS kept, fail_bits FROM f""",
}
ORACLE_SQL |= {
    "op11_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
 c(vec_id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, c.r FROM c JOIN l ON l.x = c.vec_id WHERE c.r < l.y),
 k AS (SELECT vec_id, min(r) AS component_id FROM c GROUP BY 1), n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN k USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op12_filter_audit": rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
 o AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
 q AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
 m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask
  FROM d JOIN o USING (t) LEFT JOIN q USING (doc_id)),
 c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY 1, 2),
 f(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
 p AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
 s AS (SELECT filter_order, step::INT AS step, f.bit AS own, (SELECT coalesce(sum(g.bit), 0)::INT FROM f g WHERE strpos(filter_order, g.f) < step) AS before FROM p, generate_series(1, 5) AS u(step), f WHERE f.f = filter_order[step]),
 r AS (SELECT part, filter_order, step, own, (sum(n) FILTER (mask & (before | own) = 0)) AS kept, (sum(n) FILTER (mask & own <> 0 AND mask & before = 0)) AS removed, (sum(n) FILTER (mask & own <> 0 AND mask & before <> 0)) AS redundant,
  (sum(n) FILTER (mask = own)) AS unique_fails, (sum(good) FILTER (mask & own <> 0 AND mask & before = 0)) AS good_lost, (sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0)) AS toxic_lost FROM s, c GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
 coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r""",
    "op13_lexical_search": rf"""
WITH b AS (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark), q AS (SELECT DISTINCT item_id, t FROM b),
 d AS (SELECT doc_id, {_TERMS} AS w FROM documents), z AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
 f AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2, 3),
 g AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, z GROUP BY t, n_docs),
 s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score FROM f JOIN g USING (t) JOIN q USING (t), z GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
}
_RULES = ", ".join(f"('{r.name}', {1 << i})" for i, r in enumerate(quality_rules.RULES) if _OP10_MASK >> i & 1)
ORACLE_SQL["ablation_of_rules"] = f"""
WITH o AS ({ORACLE_SQL["op10_quality_rules"]}), b AS (SELECT fail_bits & {_OP10_MASK} AS bits FROM o), r(rule, bit) AS (VALUES {_RULES})
SELECT rule, count(*) FILTER (bits & bit <> 0) AS n_failed, count(*) FILTER (bits = bit) AS n_only, count(*) FILTER (bits & ~bit = 0) AS n_kept_without FROM b, r GROUP BY rule"""
