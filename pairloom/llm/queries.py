"""The queries opN_<name> of the thirteen operators, over whole tables, and the SQL that some have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, exact_dedup, language_id, line_dedup, minhash, nbest, packing, pii, quality_rules, sampling, url_filter, vector_codes

#: Demonstration key; a deployment passes its own secret.
PII_KEY = "pairloom-demonstration-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = chat.format_conversations(turns.unionByName(extra))
    read = made.select("conv_id", "n_blocks", F.length("formatted").cast("long").alias("formatted_chars"), chat.parse_formatted(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_blocks")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_classes(table(spark, sf_dir, "documents"), measure=minhash.EITHER)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit_decision_list(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_quality_rules(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return done.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_values"), F.array_join(F.array_sort(F.array_distinct(F.transform("pii_spans", lambda s: s["kind"]))), ",").alias("kinds"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = nbest.encode_nbest(table(spark, sf_dir, "documents"), keep_ids=False)
    best = F.get("segmentations", F.lit(0))
    return coded.select("doc_id", best["n_ids"].alias("n_ids"), best["score"].alias("best_score"), best["ids_crc32"].alias("ids_crc32"), F.transform("segmentations", lambda s: s["score"]).alias("scores"), F.transform("segmentations", lambda s: s["ids_crc32"]).alias("all_crc32"), "decoded_equal")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.resample_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_grams", "log_weight", "sample_key", F.col("selected").alias("kept"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit_languages(docs.filter(F.col("doc_id").isNotNull() & ~language_id.held_out()))
    return language_id.identify_languages(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, model = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    summed = vector_codes.with_label_error(coded)
    return summed.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(model.sha256).alias("codebooks_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_chat_formatting, op2_best_fit_packing, op3_minhash_near_dedup, op4_url_filters, op5_quality_rules, op6_pii, op7_exact_dedup, op8_sentencepiece, op9_quality_classifier, op10_language_id, op11_line_dedup, op12_vector_codes, op13_collocations)
    return {f.__name__: f for f in found}


_OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
ordered AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS n FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, before IS DISTINCT FROM role AS opens,
    length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '<s>|</s>|\[(SEP|SYS|INST|ANS|/SYS|/INST|ROLE|TEXT|/ROLE)\]')) AS chars,
    length(role) + length(role) - length(replace(role, '\', '')) + len(regexp_extract_all(role, '<s>|</s>|\[(SEP|SYS|INST|ANS|/SYS|/INST|ROLE|TEXT|/ROLE)\]')) AS role_chars
  FROM ordered)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars + CASE WHEN NOT opens THEN 5 WHEN role = 'system' THEN 11 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 9 ELSE 19 + role_chars END))::BIGINT AS formatted_chars,
  count(*) FILTER (opens) AS n_blocks
FROM sized GROUP BY conv_id
"""

_OP4 = r"""
WITH RECURSIVE rules(host, path, allow) AS (
  VALUES ('org', '/', true), ('example.org', '/es/', false), ('example.org', '/en/1', false), ('com', '/fr/', true), ('com', '/de/', false)),
spelled AS (
  SELECT page_id, url, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (
  SELECT s.*, (SELECT max_by(struct_pack(rule := r.host || r.path, allow := r.allow), length(r.host || r.path) * 2 + r.allow::INT) FROM rules r
    WHERE (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)) AS hit FROM spelled s),
live AS (
  SELECT url, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS html FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
targets AS (
  SELECT url, trim(regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*["'']?([^"''\s>]+)', 1)) AS target
  FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<link[\s/][^>]*>')) AS tag FROM live)
  WHERE list_contains(regexp_split_to_array(lower(regexp_extract(tag, '(?is)[\s"''/]rel\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)), '["''\s]+'), 'canonical')
  UNION SELECT url, regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)
  FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<meta[\s/][^>]*>')) AS tag FROM live)
  WHERE regexp_matches(tag, '(?is)[\s"''/]http-equiv\s*=\s*["'']?\s*refresh\b')),
urls AS (
  SELECT url FROM pages WHERE contains(url, '://') UNION SELECT target FROM targets),
keys AS (
  SELECT url, '//' || translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || rtrim(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/')
    || CASE WHEN q = '' THEN '' ELSE '?' || q END AS alias
  FROM (SELECT url, array_to_string(list_filter(string_split(regexp_extract(regexp_replace(url, '(?s)#.*$', ''), '(?s)\?(.*)$', 1), '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref')), '&') AS q FROM urls WHERE contains(url, '://'))),
found AS (SELECT url, target FROM targets WHERE contains(url, '://')),
links AS (
  SELECT a.alias AS u, b.alias AS v FROM found f JOIN keys a ON f.url = a.url JOIN keys b ON f.target = b.url WHERE a.alias <> b.alias
  UNION SELECT b.alias, a.alias FROM found f JOIN keys a ON f.url = a.url JOIN keys b ON f.target = b.url WHERE a.alias <> b.alias),
reach(u, v) AS (SELECT DISTINCT alias, alias FROM keys UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
roots AS (SELECT u AS alias, min(v) AS root FROM reach GROUP BY u),
marks AS (
  SELECT o.root FROM ruled p JOIN keys k ON p.url = k.url JOIN roots o ON k.alias = o.alias GROUP BY o.root
  HAVING count(*) FILTER (p.hit IS NOT NULL AND NOT p.hit.allow) > 0)
SELECT p.page_id, p.host, p.path, p.hit.rule AS rule,
  CASE WHEN p.hit IS NOT NULL THEN CASE WHEN p.hit.allow THEN 'allow' ELSE 'block' END WHEN m.root IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN p.hit IS NULL THEN m.root END AS blocked_by
FROM ruled p LEFT JOIN keys k ON p.url = k.url LEFT JOIN roots o ON k.alias = o.alias LEFT JOIN marks m ON o.root = m.root
"""

_OP7 = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

_OP11 = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
found AS (
  SELECT key, min(doc_id) AS low FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT r) >= 2)
SELECT k.doc_id, count(*) AS n_lines,
  count(*) FILTER (f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.low) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL OR k.doc_id IS NOT DISTINCT FROM f.low), '')) AS kept_sha256
FROM keyed k LEFT JOIN found f ON k.key = f.key GROUP BY k.r, k.doc_id
"""

_OP12 = r"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, label, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS x FROM kept, range(16) t(p)),
book0 AS (
  SELECT p, e, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),
near0 AS (
  SELECT vec_id, p, any_value(x) AS x, min(struct_pack(d := list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)])::BIGINT, e := e)) AS hit
  FROM parts JOIN book0 USING (p) GROUP BY vec_id, p),
mean0 AS (
  SELECT p, e, list(m ORDER BY i) AS c
  FROM (SELECT p, hit.e AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM near0, range(1, 4097) t(i) WHERE i <= len(x) GROUP BY ALL) GROUP BY p, e),
book1 AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book0 b LEFT JOIN mean0 m ON b.p = m.p AND b.e = m.e),
near1 AS (
  SELECT vec_id, p, any_value(x) AS x, min(struct_pack(d := list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)])::BIGINT, e := e)) AS hit
  FROM parts JOIN book1 USING (p) GROUP BY vec_id, p),
mean1 AS (
  SELECT p, e, list(m ORDER BY i) AS c
  FROM (SELECT p, hit.e AS e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM near1, range(1, 4097) t(i) WHERE i <= len(x) GROUP BY ALL) GROUP BY p, e),
book2 AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book1 b LEFT JOIN mean1 m ON b.p = m.p AND b.e = m.e),
near2 AS (
  SELECT vec_id, label, p, min(struct_pack(d := list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)])::BIGINT, e := e)) AS hit
  FROM parts JOIN book2 USING (p) GROUP BY vec_id, label, p),
coded AS (
  SELECT vec_id, label, string_agg(format('{:02x}', hit.e), '' ORDER BY p) AS code, sum(hit.d)::BIGINT AS error FROM near2 GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256 FROM coded
"""

_OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
grams AS (
  SELECT lang, m, unnest([array_to_string(words[s:s + m - 1], ' ') FOR s IN range(1, len(words) - m + 2)]) AS phrase
  FROM split, range(1, 5) t(m) WHERE len(words) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE m > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a // (l.f + r.f))::BIGINT AS score
  FROM candidates c, range(1, 4) t(k)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[k + 1:], ' ') WHERE k < c.m),
lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cuts),
spans AS (
  SELECT lang, array_to_string(words[s:s + len - 1], ' ') AS phrase, a
  FROM candidates, range(2, 4) t(len), range(1, 4) u(s) WHERE len < m AND s + len - 1 <= m),
longer AS (SELECT lang, phrase, max(a) AS most FROM spans GROUP BY lang, phrase),
ranked AS (
  SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) AS rank,
    c.phrase, c.a, c.l, c.r, t.n, c.score
  FROM lowest c JOIN totals t ON t.lang = c.lang LEFT JOIN longer g ON g.lang = c.lang AND g.phrase = c.phrase
  WHERE c.nth = 1 AND (g.most IS NULL OR 100::HUGEINT * g.most < 80::HUGEINT * c.a))
SELECT * FROM ranked WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": _OP1, "op4_url_filters": _OP4, "op7_exact_dedup": _OP7, "op11_line_dedup": _OP11, "op12_vector_codes": _OP12, "op13_collocations": _OP13}
