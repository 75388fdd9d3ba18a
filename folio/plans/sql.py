"""The results of the registered queries as SQL, for the driver's comparison."""

from __future__ import annotations

# helpers, as text that the statements are built from
_STRIP = "regexp_replace(x, '^[\\s]+|[\\s]+$', '', 'g')"


def _words(c: str, pattern: str = "\\p{L}+") -> str:
    return f"regexp_extract_all(lower({c}), '{pattern}')"


def _pieces(c: str, pattern: str) -> str:
    return f"list_filter(list_transform(string_split_regex({c}, '{pattern}'), lambda x: {_STRIP}), lambda x: x <> '')"


def _tokens(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '')"


def _sub(c: str, key: str) -> str:
    key = key.replace("'", "''")
    return f"((length({c}) - length(replace({c}, '{key}', ''))) / {len(key)}.0)"


def _any(c: str, keys) -> str:
    return "(" + " + ".join(_sub(c, k) for k in keys) + ")"


_VOWELS = "[aeiouyàâäáéèêëíîïóôöúùûüœæãõ]+"
_STOPS = "['the', 'of', 'and', 'a', 'to', 'in', 'is', 'was', 'that', 'it', 'for', 'on', 'with', 'he', 'are', 'this', 'be', 'from']"

_COUNTS = f"""
SELECT doc_id, lang, w, length(regexp_replace(text, '\\s+', '', 'g')) AS chars, len(w) AS words, len(s) AS sentences, len(p) AS paragraphs,
  CAST(coalesce(list_sum(sy), 0) AS BIGINT) AS syllables, len(list_filter(sy, lambda x: x >= 3)) AS long
FROM (SELECT doc_id, lang, text, w, s, p, list_transform(w, lambda x: greatest(len(regexp_extract_all(x, '{_VOWELS}')), 1)) AS sy
  FROM (SELECT doc_id, lang, text, {_words("text")} AS w, {_pieces("text", "[.!?]+")} AS s, {_pieces("text", chr(10))} AS p FROM documents))
"""
_READ = f"""
SELECT *, words / greatest(sentences, 1) AS wps, syllables / greatest(words, 1) AS spw, chars / greatest(words, 1) AS cpw, words > 0 AND sentences > 0 AS ok,
  len(list_distinct(w)) / greatest(words, 1) AS diversity, len(list_filter(w, lambda x: list_contains({_STOPS}, x))) / greatest(words, 1) AS stops FROM ({_COUNTS})
"""
_INDEX = f"""
SELECT *, CASE WHEN ok THEN least(greatest(206.835 - 1.015 * wps - 84.6 * spw, 0), 100) ELSE 0 END AS flesch_, CASE WHEN ok THEN greatest(0.39 * wps + 11.8 * spw - 15.59, 0) ELSE 0 END AS fk_,
  CASE WHEN ok AND sentences >= 3 THEN 1.043 * sqrt(30.0 * long / sentences) + 3.1291 ELSE 0 END AS smog_, CASE WHEN ok THEN greatest(4.71 * cpw + 0.5 * wps - 21.43, 0) ELSE 0 END AS ari_,
  CASE WHEN ok THEN greatest(0.0588 * cpw * 100 - 0.296 * (100.0 * sentences / greatest(words, 1)) - 15.8, 0) ELSE 0 END AS cl_ FROM ({_READ})
"""

_CHUNKS = """
SELECT doc_id, i AS chunk_index, total_chunks, i * 1000 AS start_pos, CASE WHEN i = total_chunks - 1 THEN n ELSE least(n, i * 1000 + 1000 + OVER) END AS end_pos, text
FROM (SELECT doc_id, text, length(text) AS n, CAST(ceil(length(text) / 1000.0) AS INT) AS total_chunks FROM documents WHERE length(text) > 0), LATERAL (SELECT unnest(range(0, total_chunks)) AS i)
"""


def _chunks(over: int) -> str:
    return f"SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, total_chunks, start_pos, end_pos, substr(text, CAST(start_pos + 1 AS BIGINT), CAST(end_pos - start_pos AS BIGINT)) AS content FROM ({_CHUNKS.replace('OVER', str(over))})"


_EN = ["the", "of", "and", "that", "with", "from", "was", "are"]
_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2]))"
_COS = f"({_DOT} / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * x)))))"
_PAIRS = f"SELECT a.label, a.vec_id AS text1, b.vec_id AS text2, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id"
_EMO = {"calm": ["the", "and"], "bright": ["tion", "ing"], "dark": ["wh", "th"]}

SQL: dict[str, str] = {
    "readability_by_lang": f"SELECT lang, count(*) AS documents, CAST(sum(words) AS BIGINT) AS words, CAST(sum(sentences) AS BIGINT) AS sentences, CAST(sum(syllables) AS BIGINT) AS syllables, round(avg(wps), 6) AS avg_words_per_sentence, round(avg(flesch_), 6) AS avg_flesch, round(avg(ari_), 6) AS avg_ari FROM ({_INDEX}) GROUP BY lang",
    "readability_counts": f"SELECT doc_id, chars, words, sentences, paragraphs, syllables, round(wps, 6) AS words_per_sentence, round(spw, 6) AS syllables_per_word, round(cpw, 6) AS chars_per_word, round(diversity, 6) AS lexical_diversity, round(stops, 6) AS stop_words_ratio, round(flesch_, 6) AS flesch, round(fk_, 6) AS flesch_kincaid, round(smog_, 6) AS smog, round(ari_, 6) AS ari, round(cl_, 6) AS coleman_liau FROM ({_INDEX})",
    "style": f"""SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS unique_words, len(s) AS sentences, len(p) AS paragraphs, round(len(w) / greatest(len(s), 1), 6) AS words_per_sentence,
      round(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(len(w), 1), 6) AS word_length, round(len(list_filter(w, lambda x: length(x) > 7)) / greatest(len(w), 1), 6) AS long_words_ratio, round(len(list_distinct(w)) / greatest(len(w), 1), 6) AS type_token_ratio
      FROM (SELECT doc_id, {_words("text", "[\\p{L}\\p{M}\\p{N}_]+")} AS w, {_pieces("text", "[.!?]+")} AS s, {_pieces("text", chr(10))} AS p FROM documents)""",
    "emotion": f"""WITH e AS (SELECT doc_id, {", ".join(f"round({_any('c', v)} / greatest(n, 1) * 10, 3) AS {k}" for k, v in _EMO.items())} FROM (SELECT doc_id, lower(left(text, 3000)) AS c, len({_tokens("left(text, 3000)")}) AS n FROM documents))
      SELECT doc_id, CASE WHEN calm >= bright AND calm >= dark THEN 'calm' WHEN bright >= dark THEN 'bright' ELSE 'dark' END AS dominant, bright, dark, CASE WHEN bright > dark * 1.2 THEN 'positive' WHEN dark > bright * 1.2 THEN 'negative' ELSE 'neutral' END AS tone,
      round(least(greatest(CASE WHEN bright > dark * 1.2 THEN 0.6 + (bright - dark) * 0.1 WHEN dark > bright * 1.2 THEN 0.4 - (dark - bright) * 0.1 ELSE 0.5 END, 0), 1), 6) AS tone_score FROM e""",
    "chunks_fixed": f"SELECT doc_id, chunk_index, total_chunks, start_pos, end_pos, md5(content) AS content_md5 FROM ({_chunks(100)})",
    "chunk_statistics": f"SELECT doc_id, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS total_length, round(avg(length(content)), 6) AS avg_length, min(length(content)) AS min_length, max(length(content)) AS max_length FROM ({_chunks(100)}) GROUP BY doc_id",
    "chunk_scores": f"""SELECT doc_id, round(CASE WHEN n = 0 THEN 0 ELSE least(5 * least(20 * {_any("l", _EN)} / greatest(n, 1), 1) + 3 * least({_sub("text", "!")} / 5, 1) + 2 * len(list_filter(parts, lambda x: len({_tokens("x")}) BETWEEN 1 AND 7)) / len(parts), 10) END, 6) AS tension,
      round(CASE WHEN n = 0 THEN 0 ELSE least(greatest(least({_any("l", _EN)} / greatest(n, 1), 1) + 0.3 * ({_any("l", ["ing"])} - {_any("l", ["ed"])}) / greatest(n, 1), 0), 1) END, 6) AS event_density,
      round(least(({_sub("text", "—")} + 2 * {_sub("text", '"')} + {_sub("text", "«")}) / 20, 1), 6) AS dialogue_ratio FROM (SELECT doc_id, text, lower(text) AS l, len({_tokens("text")}) AS n, string_split_regex(text, '[.!?]+') AS parts FROM documents)""",
    "coherence": f"""WITH s AS (SELECT doc_id, {_pieces("text", "[.!?]+")} AS s FROM documents), r AS (SELECT doc_id, i, list_distinct({_words("s[i]")}) AS w FROM s, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)),
      p AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM r), g AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN len(w) > 0 AND len(v) > 0 THEN len(list_intersect(w, v)) / greatest(len(w), len(v)) END) AS s FROM p GROUP BY doc_id)
      SELECT d.doc_id, round(CASE WHEN coalesce(n, 0) < 2 THEN 1 ELSE coalesce(g.s, 0) / (n - 1) END, 6) AS coherence FROM documents d LEFT JOIN g USING (doc_id)""",
    "tfidf_terms": f"""WITH w AS (SELECT doc_id, list_filter({_words("text", "\\p{L}{2,}")}, lambda x: NOT list_contains({_STOPS}, x)) AS w FROM documents),
      t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), c AS (SELECT doc_id, term, count(*) AS c FROM t GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, encode(term)) AS r FROM c QUALIFY r <= 100)
      SELECT doc_id, term, round(score, 6) AS score, CAST(r AS INT) AS rank FROM (SELECT *, c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)) AS score FROM k) WHERE r <= 20""",
    "knn": f"SELECT query_id, vec_id, round(score, 5) AS score, CAST(rank AS INT) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 10",
    "similar_pairs": f"SELECT label, text1, text2, round(score, 5) AS score FROM ({_PAIRS}) WHERE score >= 0.25",
    "label_averages": f"SELECT text, round(avg(score), 5) AS average FROM (SELECT text1 AS text, score FROM ({_PAIRS}) UNION ALL SELECT text2, score FROM ({_PAIRS})) GROUP BY text",
    "mean_vectors": "SELECT label, CAST(i - 1 AS INT) AS place, round(avg(CAST(embedding[i] AS DOUBLE)), 5) AS x FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i",
    "chat_prompts": "SELECT conv_id, turns, prompt, CAST(floor(length(prompt) / 3) AS BIGINT) AS tokens FROM (SELECT conv_id, count(*) AS turns, string_agg('<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) || chr(10) || '<|assistant|>' || chr(10) AS prompt FROM conversations GROUP BY conv_id)",
    "genre_replies": "SELECT event_id, event_type AS main_genre, least(greatest(round(value, 2), 0.0), 1.0) AS confidence FROM events",
    "newest_page": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20",
    "title_search": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a')",
    "size_classes": "SELECT CASE WHEN n_chars < 1000 THEN 'small' WHEN n_chars <= 10000 THEN 'medium' ELSE 'large' END AS size_class, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1",
    "success_by_user": "SELECT user_id, round(CASE WHEN count(*) FILTER (event_type IN ('purchase', 'error')) > 0 THEN 100.0 * count(*) FILTER (event_type = 'purchase') / count(*) FILTER (event_type IN ('purchase', 'error')) ELSE 100 END, 6) AS success_rate, count(*) AS n FROM events GROUP BY user_id",
    "usage_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 5",
    "recent_values": "SELECT round(avg(v), 5) AS avg, min(v) AS min, max(v) AS max, round(median(v), 5) AS median, count(*) AS n FROM (SELECT round(value, 6) AS v FROM events ORDER BY ts DESC, v LIMIT 1000)",
    "value_trends": "SELECT event_type, round(early, 5) AS early, round(late, 5) AS late, CASE WHEN n >= 10 THEN CASE WHEN late - early > 5 THEN 'increasing' WHEN late - early < -5 THEN 'decreasing' ELSE 'stable' END END AS trend FROM (SELECT event_type, avg(value) FILTER (rn > 5) AS early, avg(value) FILTER (rn <= 5) AS late, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS rn FROM events) WHERE rn <= 10 GROUP BY 1)",
    "latency_average": "SELECT user_id, round(sum(value * pow(0.9, n - i) * CASE WHEN i = 1 THEN 1 ELSE 0.1 END), 5) AS ema, max(n) AS n FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY 1",
    "order_progress": "SELECT l_orderkey, CAST(floor(100 * count(*) FILTER (l_linestatus = 'F') / count(*)) AS BIGINT) AS progress FROM lineitem GROUP BY 1",
    "orders_with_lines": "SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n_lines, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS parts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "missing_customers": "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS known FROM customer",
    "duplicate_texts": "SELECT md5(text) AS md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "latest_events": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3",
    "best_suppliers": "SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey DESC) AS rn FROM supplier) WHERE rn = 1",
    "event_counters": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type = 'error') AS bad, round(CASE WHEN count(*) FILTER (event_type IN ('purchase', 'error')) > 0 THEN 100.0 * count(*) FILTER (event_type = 'purchase') / count(*) FILTER (event_type IN ('purchase', 'error')) ELSE 100 END, 6) AS success_rate FROM events GROUP BY 1",
    "metric_snapshots": "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, round(avg(value), 5) AS avg, round(min(value), 5) AS min, round(max(value), 5) AS max, count(*) AS n FROM events GROUP BY 1, 2",
    "user_life_cycles": "SELECT user_id, round(epoch_us(max(ts) FILTER (event_type = 'purchase')) / 1000000.0 - epoch_us(min(ts)) / 1000000.0, 3) AS seconds FROM events GROUP BY 1",
    "metric_alerts": "SELECT event_id, alert, severity FROM (SELECT event_id, 'memory' AS alert, 'critical' AS severity FROM events WHERE value > 90 UNION ALL SELECT event_id, 'temperature', 'warning' FROM events WHERE value > 80 UNION ALL SELECT event_id, 'hit_rate', 'warning' FROM events WHERE value < 30 UNION ALL SELECT event_id, 'success_rate', 'critical' FROM events WHERE value < 70)",
    "fact_density": f"""SELECT doc_id, round(CASE WHEN len(s) = 0 OR n = 0 THEN 0 ELSE (2 * {_any("lower(text)", ["for", "that", "with", "from"])} / greatest(n, 1) + len(list_filter(s, lambda x: regexp_matches(x, '\\d{{4}}|\\d+%|\\d+\\.\\d+|[А-Я][а-я]+ [А-Я][а-я]+'))) / greatest(len(s), 1)) / 3 END, 6) AS information_density,
      CAST(length(text) - length(replace(replace(text, '?', ''), '!', '')) AS DOUBLE) AS marks FROM (SELECT doc_id, text, {_pieces("text", "[.!?]+")} AS s, len({_tokens("text")}) AS n FROM documents)""",
    "chunk_term_sums": f"""WITH w AS (SELECT doc_id, chunk_index, list_filter({_words("content", "\\p{L}{2,}")}, lambda x: NOT list_contains({_STOPS}, x)) AS w FROM ({_chunks(0)})),
      t AS (SELECT doc_id, chunk_index, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), c AS (SELECT doc_id, chunk_index, term, count(*) AS c FROM t GROUP BY ALL),
      s AS (SELECT doc_id, term, sum(s) AS score FROM (SELECT *, c / sqrt(sum(c * c) OVER (PARTITION BY doc_id, chunk_index)) AS s FROM c) GROUP BY ALL)
      SELECT doc_id, term, round(score, 6) AS score, CAST(r AS INT) AS rank, terms FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, encode(term)) AS r, count(*) OVER (PARTITION BY doc_id) AS terms FROM s) WHERE r <= 20""",
}
