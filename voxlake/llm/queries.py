"""Queries over the whole tables, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import chat, infill, jaccard, mixing, packing, pieces, quality, scoring, sharding, spelling, substrings, vectors, warc
from voxlake.session import table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_documents(table(spark, sf_dir, "documents"))


def op3_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the strings of 400 bytes, passages of fifty words: they are shorter."""
    return substrings.repeat_report(table(spark, sf_dir, "documents"), gram=substrings.PASSAGE_GRAM, passage=substrings.PASSAGE)


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_windows(rows.unionByName(extra)))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(warc.crawl_records(spark, sf_dir))
    lines = F.array_sort(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), F.coalesce(h["value"], F.lit("")))))
    return out.select(F.col("record_id").alias("page_id"), "canonical_url", "verdict", F.col("source_id").alias("source_page"), "source_digest", F.array_join(lines, "\n").alias("headers"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


def op10_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_lm_scores, op3_repeated_substrings, op4_chat_windows, op5_mix_sources, op6_warc_revisits, op7_near_vectors, op8_pack_documents, op9_quality_rules, op10_shard_documents, op11_sentence_pieces, op12_spelling_variants, op13_fill_in_middle)}
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda t: t <> '')"

_JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0) x),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
 reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
 k AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY 1),
 d AS (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (same) AS n_copies, min(b) FILTER (same) AS rep FROM l GROUP BY 1)
 SELECT k.doc_id, class_id, least(k.doc_id, coalesce(rep, k.doc_id)) AS rep_id, coalesce(n_copies, 0) AS n_copies, coalesce(n_links, 0) AS n_links FROM k LEFT JOIN d USING (doc_id)"""

_VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
 u AS (SELECT *, sqrt(list_dot_product(v, v)) AS len FROM v),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.len > 0 AND b.len > 0 AND list_dot_product(a.v, b.v) / (a.len * b.len) >= 0.93),
 reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
 k AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1), d AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
 SELECT k.vec_id, coalesce(n_links, 0) AS n_links, component_id, k.vec_id = component_id AS kept FROM k LEFT JOIN d USING (vec_id)"""

_QUALITY = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
 g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5) x),
 r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) y WHERE c > 1) z GROUP BY 1),
 li AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
 m AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_distinct(w)) AS n_distinct, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7f]'))) AS lettered FROM t JOIN li USING (doc_id) LEFT JOIN r USING (doc_id)),
 b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * n_symbols <= 20 * n_words AND 5 * word_chars >= 6 * n_words AND word_chars <= 100 * n_words
 AND 100 * n_dup_lines <= 30 * n_lines AND 100 * lettered >= 60 * n_words AND NOT (n_words >= 200 AND 100 * n_distinct < 5 * n_words) AS kept FROM b"""

_WARC = f"""WITH p AS (SELECT page_id, url, md5(html) AS digest, strlen(html) AS length, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
 q AS (SELECT *, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www[0-9]*[.]|:(80|443)$', '') AS host, regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
 list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{warc.TRACKING}'))) AS query FROM p),
 c AS (SELECT *, concat(host, path, CASE WHEN len(query) > 0 THEN concat('?', array_to_string(query, '&')) ELSE '' END) AS canonical_url FROM q),
 a AS (SELECT r.page_id, r.canonical_url, r.digest, f.page_id AS source, f.digest AS stored, f.length, row_number() OVER (PARTITION BY r.page_id ORDER BY f.page_id DESC) AS rn FROM c r LEFT JOIN c f ON f.canonical_url = r.canonical_url AND f.page_id <= r.page_id + {warc.LAG} AND f.digest IS NOT NULL)
 SELECT page_id, canonical_url, CASE WHEN source IS NULL THEN 'missing' WHEN digest IS NULL THEN 'unvalidated' WHEN digest = stored THEN 'resolved' ELSE 'mismatch' END AS verdict,
 CASE WHEN digest = stored THEN source END AS source_page, CASE WHEN digest = stored THEN stored END AS source_digest,
 CASE WHEN digest = stored THEN concat('cache-control: max-age=60', chr(10), 'content-length: ', length, chr(10), 'content-type: text/html', chr(10), 'date: ', page_id + {warc.LAG}, chr(10), 'etag: "', digest, '"') END AS headers FROM a WHERE rn = 1"""

_SPELLING = r"""WITH RECURSIVE c(t) AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))),
 r AS (SELECT doc_id, x AS run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS x FROM documents) y WHERE length(x) >= 7 GROUP BY 1, 2),
 b AS (SELECT *, hex(concat(doc_id, ':', run)) AS hx FROM r),
 h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hx) // 2), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT))), lambda v, z: xor(v >> 8, t[(xor(v, z) & 255) + 1])), 4294967295) AS h FROM b, c),
 w AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, k FROM h),
 n AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
 d AS (SELECT word, i, concat(substr(word, 1, i), substr(word, i + 2)) AS s FROM (SELECT word, unnest(range(length(word))) AS i FROM n) z),
 p AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.i = b.i AND a.s = b.s AND a.word <> b.word UNION SELECT word, s FROM d WHERE s IN (SELECT word FROM n) UNION SELECT s, word FROM d WHERE s IN (SELECT word FROM n)),
 g AS (SELECT a AS word, count(*) AS n_near, max(n.n) AS form_n FROM p JOIN n ON n.word = p.b GROUP BY 1),
 f AS (SELECT p.a AS word, min(p.b) AS form, any_value(g.form_n) AS form_n FROM p JOIN n x ON x.word = p.a JOIN n y ON y.word = p.b JOIN g ON g.word = p.a WHERE y.n = g.form_n AND y.n >= 10 * x.n GROUP BY 1),
 l AS (SELECT word, word AS root, 0 AS hops FROM n UNION ALL SELECT l.word, f.form, hops + 1 FROM l JOIN f ON f.word = l.root),
 z AS (SELECT word, arg_max(root, hops) AS root FROM l GROUP BY 1)
 SELECT n.word, n.n, coalesce(g.n_near, 0) AS n_near, f.form, f.form_n, z.root FROM n JOIN z USING (word) LEFT JOIN g USING (word) LEFT JOIN f USING (word)"""

_INFILL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('7:', doc_id)) AS hx FROM documents),
 l AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS ln FROM d),
 h AS (SELECT *, CAST(len(ln) AS BIGINT) AS n, CAST('0x' || substr(hx, 1, 8) AS BIGINT) % (len(ln) + 1) AS x, CAST('0x' || substr(hx, 9, 8) AS BIGINT) % (len(ln) + 1) AS y, CAST('0x' || substr(hx, 25, 8) AS BIGINT) % 100 AS z FROM l),
 p AS (SELECT doc_id, text, n, array_to_string(ln[:least(x, y)], '') AS p, array_to_string(ln[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(ln[greatest(x, y) + 1:], '') AS s,
 CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') THEN 'plain' WHEN z < 50 THEN 'spm' ELSE 'psm' END AS form FROM h)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

ORACLE = {"op1_jaccard_join": _JACCARD, "op6_warc_revisits": _WARC, "op7_near_vectors": _VECTORS, "op9_quality_rules": _QUALITY, "op12_spelling_variants": _SPELLING, "op13_fill_in_middle": _INFILL}
