"""The results of the text measures as SQL. Helpers build the statements; each statement stands alone."""

from __future__ import annotations

from folio.functions import lexicons as lx
from folio.operators import description as dn
from folio.operators import narrative as nv

BLANK = "\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
WORD = "[\\p{L}\\p{M}\\p{N}_]"
VOWELS = "[aeiouyàâäáéèêëíîïóôöúùûüœæãõ]+"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(keys) -> str:
    return "[" + ", ".join(map(quoted, keys)) + "]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def pieces(c: str, pattern: str) -> str:
    return f"list_filter(list_transform(string_split_regex({c}, {quoted(pattern)}), lambda pz: {strip('pz')}), lambda pz: pz <> '')"


def sentences(c: str) -> str:
    return pieces(c, "[.!?]+")


def tokens(c: str) -> str:
    return f"regexp_extract_all({c}, '[^{BLANK}]+')"


def words(c: str, pattern: str = "\\p{L}+") -> str:
    return f"regexp_extract_all(lower({c}), '{pattern}')"


def sub(c: str, key: str) -> str:
    return f"((length({c}) - length(replace({c}, {quoted(key)}, ''))) / {len(key)}.0)"


def any_of(c: str, keys) -> str:
    """Occurrences of all keys."""
    return f"coalesce(list_sum(list_transform({listed(keys)}, lambda kz: (length({c}) - length(replace({c}, kz, ''))) / length(kz))), 0)"


def has(c: str, keys) -> str:
    return f"(len(list_filter({listed(keys)}, lambda kz: contains({c}, kz))) > 0)"


def within(array: str, keys) -> str:
    return f"len(list_filter({array}, lambda iz: list_contains({listed(keys)}, iz)))"


def total(array: str) -> str:
    return f"coalesce(list_sum({array}), 0)"


def mean(array: str) -> str:
    return f"coalesce(list_avg({array}), 0)"


def variance(array: str) -> str:
    return f"coalesce(list_var_pop({array}), 0)"


def clamp(c: str, low="0", high="1") -> str:
    return f"least(greatest({c}, {low}), {high})"


def ladder(c: str, steps, top: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} < {b} THEN {quoted(n)}" for b, n in steps) + f" ELSE {quoted(top)} END"


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for x in names for n in x.split())


def chunks(over: int = 0) -> str:
    end = f"CASE WHEN i = total_chunks - 1 THEN n ELSE least(n, i * 1000 + 1000 + {over}) END"
    return f"""SELECT doc_id, CAST(i AS INT) AS chunk_index, total_chunks, i * 1000 AS start_pos, {end} AS end_pos, substr(text, CAST(i * 1000 + 1 AS BIGINT), CAST({end} - i * 1000 AS BIGINT)) AS content
FROM (SELECT doc_id, text, length(text) AS n, CAST(ceil(length(text) / 1000.0) AS INT) AS total_chunks FROM documents WHERE length(text) > 0), LATERAL (SELECT unnest(range(0, total_chunks)) AS i)"""


# ---- readability

STOPS = ["the", "of", "and", "a", "to", "in", "is", "was", "that", "it", "for", "on", "with", "he", "are", "this", "be", "from"]
LINKS = ["for", "that", "with", "from"]
SUFFIXES = ["tion", "ing", "ment"]
COMMON = ["the", "of", "and", "that", "with", "from", "was", "are"]


def _readability(rows: str, enumeration: str, conditional: str, subordinate: str, marked: bool) -> str:
    """rows: key columns and text. Adds all measures."""
    stop = f"list_contains({listed(STOPS)}, x)"
    extra = f"len(regexp_extract_all(l, '{subordinate}'))" if marked else "0"
    parallel = f"CAST(regexp_matches(lower(x), '{enumeration}') AS INT) + CAST(regexp_matches(lower(x), '{conditional}') AS INT)" if marked else "0"
    return f"""
WITH r0 AS (SELECT *, lower(text) AS l FROM ({rows})),
r1 AS (SELECT *, {words("text")} AS w, {sentences("text")} AS s, {pieces("text", chr(10))} AS p, string_split(text, chr(10)) AS lines, len({tokens("text")}) AS tok FROM r0),
r2 AS (SELECT *, list_transform(w, lambda x: greatest(len(regexp_extract_all(x, '{VOWELS}')), 1)) AS y, list_transform(w, lambda x: {has("x", SUFFIXES)}) AS f, list_filter(w, lambda x: NOT {stop}) AS content,
  list_transform(s, lambda z: list_filter(list_distinct({words("z")}), lambda x: NOT {stop})) AS sets, list_transform(p, lambda z: len({tokens("z")})) AS pl FROM r1),
r3 AS (SELECT *, length(regexp_replace(text, '[{BLANK}]+', '', 'g')) AS chars, len(w) AS words, len(s) AS sentences, len(p) AS paragraphs, CAST({total("y")} AS BIGINT) AS syllables, len(list_filter(y, lambda x: x >= 3)) AS longs FROM r2),
r4 AS (SELECT *, words / greatest(sentences, 1) AS words_per_sentence, sentences / greatest(paragraphs, 1) AS sentences_per_paragraph, syllables / greatest(words, 1) AS syllables_per_word, chars / greatest(words, 1) AS chars_per_word,
  len(list_distinct(w)) / greatest(words, 1) AS lexical_diversity, (words - len(content)) / greatest(words, 1) AS stop_words_ratio, words > 0 AND sentences > 0 AS ok,
  len(list_filter(range(1, words + 1), lambda i: length(w[i]) > 10 OR f[i] OR y[i] > 4)) / greatest(words, 1) AS complex_words_ratio,
  {mean("list_transform(range(1, words + 1), lambda i: least(length(w[i]) / 15, 1) + CASE WHEN f[i] THEN 0.5 ELSE 0 END)")} AS morphological_complexity,
  (length(text) - length(translate(text, {quoted(',;:!?-—()[]{}«»"')}, ''))) * 1000 / greatest(length(text), 1) AS punctuation_density FROM r3),
r5 AS (SELECT *, CASE WHEN ok THEN {clamp("206.835 - 1.015 * words_per_sentence - 84.6 * syllables_per_word", "0", "100")} ELSE 0 END AS flesch,
  CASE WHEN ok THEN greatest(0.39 * words_per_sentence + 11.8 * syllables_per_word - 15.59, 0) ELSE 0 END AS flesch_kincaid, CASE WHEN ok AND sentences >= 3 THEN 1.043 * sqrt(30.0 * longs / sentences) + 3.1291 ELSE 0 END AS smog,
  CASE WHEN ok THEN greatest(4.71 * chars_per_word + 0.5 * words_per_sentence - 21.43, 0) ELSE 0 END AS ari, CASE WHEN ok THEN greatest(0.0588 * chars_per_word * 100 - 0.296 * (100.0 * sentences / greatest(words, 1)) - 15.8, 0) ELSE 0 END AS coleman_liau,
  least(CASE WHEN len(lines) > 1 THEN 0.3 ELSE 0 END + CASE WHEN len(pl) > 0 THEN 0.3 / (1 + {variance("pl")} / pow(greatest({mean("pl")}, 1e-9), 2)) ELSE 0 END + least({any_of("l", LINKS)} / greatest(tok, 1) * 10, 0.4), 1) AS organization,
  CASE WHEN sentences < 2 THEN 1 ELSE {total("list_transform(range(1, sentences), lambda i: CASE WHEN len(sets[i]) > 0 AND len(sets[i + 1]) > 0 THEN len(list_intersect(sets[i], sets[i + 1])) / greatest(len(sets[i]), len(sets[i + 1])) ELSE 0 END)")} / (sentences - 1) END AS coherence,
  least({total(f"list_transform(s, lambda x: {parallel})")} / greatest(sentences, 1), 1) AS parallel,
  CASE WHEN words = 0 THEN 0 ELSE least((len(content) / words + len(list_distinct(content)) / greatest(len(content), 1)) / 2, 1) END AS information_density,
  CASE WHEN words = 0 THEN 0 ELSE least(5 * ({any_of("l", LINKS)} + len(list_filter(range(1, words + 1), lambda i: length(w[i]) > 8 AND f[i]))) / words, 1) END AS concept_complexity,
  (least(words_per_sentence / 30, 1) + least((len(regexp_extract_all(l, '{WORD}+,[{BLANK}]*{WORD}+,[{BLANK}]*{WORD}+')) + len(regexp_extract_all(l, '\\([^)]+\\)')) + {extra}) / greatest(sentences, 1), 1)) / 2 AS memory_load FROM r4),
r6 AS (SELECT *, {clamp("50 + flesch * 0.25 + 100 * (-0.1 * lexical_diversity - 0.2 * complex_words_ratio + 0.1 * stop_words_ratio + 0.15 * coherence + 0.15 * organization - 0.1 * information_density - 0.15 * (1 - least(abs(words_per_sentence - 17.5) / 17.5, 1)))", "0", "100")} / 100 AS overall FROM r5)
"""


_READ = _readability("SELECT doc_id, text FROM documents", "the|and", "that.*,.*of", "that|from", True)
_RATES = "words_per_sentence sentences_per_paragraph syllables_per_word chars_per_word flesch flesch_kincaid smog ari coleman_liau lexical_diversity complex_words_ratio stop_words_ratio morphological_complexity punctuation_density organization coherence parallel information_density concept_complexity memory_load overall"


def _rollup(rows: str, key: str, names: list[str], consistency: bool = True) -> str:
    cells = ", ".join(f"round(avg({n}), 6) AS avg_{n}, round(min({n}), 6) AS min_{n}, round(max({n}), 6) AS max_{n}, round(CASE WHEN count({n}) > 1 THEN greatest(0, 1 - var_pop({n})) END, 6) AS consistency_{n}" for n in names)
    return f"{rows} SELECT {key}, count(*) AS chunks, {cells} FROM final GROUP BY {key}"


def _final(statement: str, last: str) -> str:
    return f"{statement}, final AS (SELECT * FROM {last})"


# ---- complexity


def _complexity(rows: str) -> str:
    weights = {"flesch": -0.3, "ari": 0.2, "fog": 0.2, "lexical_diversity": 0.15, "rare_words_ratio": 0.15, "conjunction_density": 0.1, "complex_sentence_ratio": 0.1, "lexical_entropy": 0.1}
    top = " + ".join(f"coalesce({n} * {v}, 0)" for n, v in weights.items())
    bottom = " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE {abs(v)} END" for n, v in weights.items())
    return f"""
WITH c0 AS (SELECT *, lower(text) AS l FROM ({rows})),
c1 AS (SELECT *, {words("text")} AS w, {sentences("text")} AS s, {pieces("text", chr(10))} AS p FROM c0),
c2 AS (SELECT *, len(w) AS n, len(s) AS k, len(p) AS paragraphs, list_transform(s, lambda x: len({words("x")})) AS sl, list_transform(w, lambda x: greatest(len(regexp_extract_all(x, '{VOWELS}')), 1)) AS y FROM c1),
c3 AS (SELECT *, n > 0 AND k > 0 AS ok, {total("list_transform(w, lambda x: length(x))")} / greatest(n, 1) AS word_length FROM c2),
c4 AS (SELECT *, CASE WHEN ok THEN n / k ELSE 0 END AS words_per_sentence, CASE WHEN ok THEN {total("y")} / n ELSE 0 END AS syllables_per_word, CASE WHEN ok THEN len(list_filter(y, lambda x: x > 3)) / n ELSE 0 END AS complex_words_ratio FROM c3),
c5 AS (SELECT *, CASE WHEN ok THEN {clamp("206.835 - 1.52 * words_per_sentence - 65.14 * syllables_per_word", "0", "100")} / 100 ELSE 0 END AS flesch, CASE WHEN ok THEN {clamp("4.71 * word_length + 0.5 * words_per_sentence - 21.43", "0", "20")} / 20 ELSE 0 END AS ari,
  CASE WHEN ok THEN {clamp("0.4 * (words_per_sentence + 100 * complex_words_ratio)", "0", "20")} / 20 ELSE 0 END AS fog, {variance("sl")} AS sentence_length_variance,
  CASE WHEN k > 0 THEN (list_max(sl) - list_min(sl)) / greatest(list_max(sl), 1) ELSE 0 END AS sentence_length_ratio, k / greatest(paragraphs, 1) AS sentences_per_paragraph,
  CASE WHEN n > 0 THEN len(list_distinct(w)) / n END AS lexical_diversity, CASE WHEN n > 0 THEN (n - {within("w", COMMON)}) / n END AS rare_words_ratio,
  CASE WHEN n > 0 THEN least((log2(n) - list_sum(list_transform(map_values(list_histogram(w)), lambda x: x * log2(x))) / n) / 10, 1) END AS lexical_entropy,
  {sub("text", ",")} * 1000 / greatest(length(text), 1) AS comma_density, {any_of("l", LINKS)} / greatest(n, 1) AS conjunction_density,
  len(list_filter(s, lambda x: {sub("x", ",")} > 2 OR {has("lower(x)", LINKS)} OR len({words("x")}) > 20)) / greatest(k, 1) AS complex_sentence_ratio, {sub("text", ",")} / greatest(k, 1) AS commas_per_sentence FROM c4),
c6 AS (SELECT *, {clamp(f"abs({top}) / ({bottom})")} AS overall FROM c5)
"""


_COMPLEX = "flesch ari fog words_per_sentence syllables_per_word complex_words_ratio sentences_per_paragraph sentence_length_variance sentence_length_ratio lexical_diversity rare_words_ratio word_length lexical_entropy comma_density conjunction_density complex_sentence_ratio commas_per_sentence overall"

# ---- chunks

_UNIT = {"sentence": f"(?s)(.*?[.!?]+[{BLANK}]+|.+$)", "paragraph": f"(?s)(.*?\\n[{BLANK}]*\\n|.+$)"}


def _units(c: str, unit: str) -> str:
    return f"list_filter(regexp_extract_all({c}, '{_UNIT[unit]}', 1), lambda uz: uz <> '')"


def _packed(lengths: str, base: int, least: int, most: int) -> str:
    full = f"(az.size > 0 AND (az.size >= {base} OR (az.size + xz > {most} AND az.size >= {least})))"
    start = "{'ends': CAST([] AS BIGINT[]), 'pos': 0::BIGINT, 'size': 0::BIGINT}"
    step = f"{{'ends': CASE WHEN {full} THEN list_append(az.ends, az.pos) ELSE az.ends END, 'pos': az.pos + xz, 'size': CASE WHEN {full} THEN xz ELSE az.size + xz END}}"
    return f"list_transform([list_reduce({lengths}, lambda az, xz: {step}, {start})], lambda rz: CASE WHEN rz.size > 0 THEN list_append(rz.ends, rz.pos) ELSE rz.ends END)[1]"


def _from_ends(rows: str, filtered: bool = True) -> str:
    """rows: doc_id, t, n, ends -> chunks."""
    keep = "WHERE regexp_matches(content, '\\S')" if filtered else ""
    return f"""
WITH e AS ({rows}), x AS (SELECT doc_id, i, CASE WHEN i = 1 THEN 0 ELSE ends[i - 1] END AS start_pos, ends[i] AS end_pos, t FROM e, LATERAL (SELECT unnest(range(1, len(ends) + 1)) AS i)),
y AS (SELECT doc_id, i, start_pos, end_pos, substr(t, CAST(start_pos + 1 AS BIGINT), CAST(end_pos - start_pos AS BIGINT)) AS content FROM x), z AS (SELECT * FROM y {keep})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total_chunks, CAST(start_pos AS BIGINT) AS start_pos, CAST(end_pos AS BIGINT) AS end_pos, md5(content) AS content_md5 FROM z
"""


def _by_count(text: str, unit: str, count: int) -> str:
    rows = f"SELECT doc_id, t, length(t) AS n, list_transform({_units('t', unit)}, lambda x: length(x)) AS lens FROM (SELECT doc_id, {text} AS t FROM documents) WHERE length(t) > 0"
    ends = f"list_transform(list_filter(range(1, len(lens) + 1), lambda i: i % {count} = 0 OR i = len(lens)), lambda i: CAST(list_sum(lens[1:i]) AS BIGINT))"
    return _from_ends(f"SELECT doc_id, t, n, {ends} AS ends FROM ({rows})")


_LINES = "replace(text, chr(10), chr(10) || chr(10))"


def _paragraphs(base: int, least: int, most: int) -> str:
    each = f"list_transform({_units('t', 'paragraph')}, lambda u: {{'n': length(u), 'cuts': CASE WHEN length(u) > {most} THEN {_packed(f'list_transform({_units("u", "sentence")}, lambda vz: length(vz))', base, least, most)} END}})"
    start = "{'ends': CAST([] AS BIGINT[]), 'pos': 0::BIGINT, 'size': 0::BIGINT}"
    step = f"""CASE WHEN p.cuts IS NOT NULL THEN {{'ends': list_concat(CASE WHEN b.size > 0 THEN list_append(b.ends, b.pos) ELSE b.ends END, list_transform(p.cuts, lambda c: b.pos + c)), 'pos': b.pos + p.n, 'size': 0::BIGINT}}
      WHEN b.size > 0 AND b.size + p.n > {most} THEN {{'ends': list_append(b.ends, b.pos), 'pos': b.pos + p.n, 'size': p.n}} ELSE {{'ends': b.ends, 'pos': b.pos + p.n, 'size': b.size + p.n}} END"""
    ends = f"list_transform([list_reduce(u, lambda b, p: {step}, {start})], lambda r: CASE WHEN r.size > 0 THEN list_append(r.ends, r.pos) ELSE r.ends END)[1]"
    rows = f"SELECT doc_id, t, length(t) AS n, {each} AS u FROM (SELECT doc_id, {_LINES} AS t FROM documents) WHERE length(t) > 0"
    return _from_ends(f"SELECT doc_id, t, n, CASE WHEN n <= {base} THEN [n] ELSE {ends} END AS ends FROM ({rows})")


_BY_SENTENCE = _from_ends(
    f"SELECT doc_id, t, n, CASE WHEN n <= 1000 THEN [n] ELSE {_packed('lens', 1000, 250, 2000)} END AS ends FROM (SELECT doc_id, text AS t, length(text) AS n, list_transform({_units('text', 'sentence')}, lambda x: length(x)) AS lens FROM documents WHERE length(text) > 0)"
)
_OVERLAPS = """
WITH x AS (SELECT doc_id, text, length(text) AS n, i, CAST(ceil(length(text) / 1000.0) AS INT) AS k FROM documents, LATERAL (SELECT unnest(range(0, CAST(ceil(length(text) / 1000.0) AS INT))) AS i) WHERE length(text) > 0),
y AS (SELECT *, i * 1000 AS a, least(n, i * 1000 + 1000) AS b, CASE WHEN i = 0 THEN 0 ELSE 150 END AS overlap_start, CASE WHEN i = k - 1 THEN 0 ELSE least(150, n - least(n, i * 1000 + 1000)) END AS overlap_end FROM x)
SELECT doc_id, CAST(i AS INT) AS chunk_index, a - overlap_start AS start_pos, b + overlap_end AS end_pos, overlap_start, overlap_end, md5(substr(text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT))) AS own_md5, round((a - overlap_start) / n, 6) AS position FROM y
"""
_PLANS = "SELECT doc_id, CAST(least(greatest(n, 500), 9907) AS INT) AS adaptive, " + ", ".join(
    f"CASE WHEN n <= {size} THEN 1 ELSE CAST(ceil(n / {size - int(size * over)}.0) AS BIGINT) END AS chunks_{k}" for k, size, over in (("default", 2000, 0.1), ("small", 1000, 0.15), ("large", 4000, 0.05))
) + " FROM (SELECT doc_id, length(text) AS n FROM documents)"

# ---- scores of chunks


def _event_density(c: str, n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0 ELSE {clamp(f'least({any_of(c, lx.EVENTS)} / greatest({n}, 1), 1) + 0.3 * ({any_of(c, lx.FAST)} - {any_of(c, lx.SLOW)}) / greatest({n}, 1)')} END"


_CHUNK = f"SELECT doc_id, chunk_index, content, lower(content) AS l, len({tokens('content')}) AS n FROM ({chunks()})"
_MARKS = f"({sub('content', '—')} + {sub('content', chr(34))} + {sub('content', '«')})"
_PACE = f"""
WITH c AS ({_CHUNK}), s AS (SELECT doc_id, {_event_density("l", "n")} AS e, least(({_MARKS} + {sub("content", chr(34))}) / 20, 1) AS d FROM c), p AS (SELECT *, least(10 * (7 * e + 3 * d), 10) AS pace FROM s),
g AS (SELECT doc_id, median(pace) AS median_pace, min(pace) AS min_pace, max(pace) AS max_pace, avg(pace) AS avg_pace, var_pop(pace) AS pace_variance, avg(e) AS avg_event_density, avg(d) AS avg_dialogue_ratio FROM p GROUP BY doc_id)
SELECT doc_id, {rounded("median_pace min_pace max_pace avg_pace pace_variance avg_event_density avg_dialogue_ratio")}, {ladder("median_pace", nv.PACE, "fast")} AS pace_class FROM g
"""
_TENSION = f"""
WITH c AS (SELECT *, string_split_regex(content, '[.!?]+') AS parts FROM ({_CHUNK})),
s AS (SELECT doc_id, chunk_index, CASE WHEN n = 0 THEN 0 ELSE least(5 * least(20 * {any_of("l", lx.TENSION)} / greatest(n, 1), 1) + 3 * least({sub("content", "!")} / 5, 1) + 2 * (len(list_filter(parts, lambda x: len({tokens("x")}) BETWEEN 1 AND 7)) / len(parts)), 10) END AS t FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t < 2, chunk_index) AS k FROM s)
SELECT doc_id, round(avg(t), 6) AS avg_tension, count(*) FILTER (t >= 2) AS peak_count, coalesce(string_agg(CAST(chunk_index AS VARCHAR), ',' ORDER BY chunk_index) FILTER (t >= 2 AND k <= 15), '') AS peaks FROM r GROUP BY doc_id
"""
_RELEVANT = f"""
WITH c AS (SELECT *, regexp_extract_all(regexp_replace(content, '([а-яa-z][{BLANK}])', '\\1¤', 'g'), '¤[А-ЯA-Z][а-яa-z]+') AS names FROM ({_CHUNK})),
s AS (SELECT doc_id, chunk_index, CASE WHEN n = 0 THEN 0 ELSE least(0.4 * least({any_of("l", lx.CHARACTER)} / greatest(n, 1), 1) + 0.4 * least({_MARKS} / 10, 1) + 0.2 * least(len(names) / greatest(n, 1), 1), 1) END AS score FROM c),
w AS (SELECT *, count(*) FILTER (score >= 0.1) OVER (PARTITION BY doc_id) / count(*) OVER (PARTITION BY doc_id) AS coverage FROM s)
SELECT doc_id, chunk_index, round(score, 6) AS score, round(coverage, 6) AS coverage FROM w WHERE score >= 0.1
"""

# ---- repetitions and water

_REPEATS = ["the", "and"]
_KEYS = f"list_filter(list_transform({tokens('l')}, lambda x: regexp_replace(x, '[^\\p{{L}}]', '', 'g')), lambda x: length(x) > 4 AND NOT list_contains({listed(lx.KEYWORD_STOPS)}, x))"
_REPEATED = f"""
k AS (SELECT doc_id, chunk_index, list_distinct({_KEYS}) AS ka, l AS a FROM ({_CHUNK})),
j AS (SELECT *, lead(ka) OVER w AS kb, lead(a) OVER w AS b FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)),
q AS (SELECT *, CASE WHEN len(ka) > 0 AND len(kb) > 0 THEN len(list_intersect(ka, kb)) / len(list_distinct(list_concat(ka, kb))) ELSE 0 END AS similarity, len(list_intersect(ka, kb)) AS shared FROM j WHERE kb IS NOT NULL),
h AS (SELECT doc_id, chunk_index, 'en' AS kind, p AS phrase, similarity FROM q, (SELECT unnest({listed(_REPEATS)}) AS p) WHERE similarity > 0.3 AND (contains(a, p) OR contains(b, p)) UNION ALL SELECT doc_id, chunk_index, 'keywords', NULL, similarity FROM q WHERE shared >= 3)
"""
_REPETITIONS = f"WITH {_REPEATED} SELECT doc_id, chunk_index, kind, phrase, round(similarity, 6) AS similarity FROM h"
_WATER = f"""
WITH {_REPEATED}, c AS ({_CHUNK}), v AS (SELECT doc_id, unnest({tokens("l")}) AS w FROM c), f AS (SELECT doc_id, w, count(*) AS c FROM v WHERE length(w) > 3 GROUP BY ALL), o AS (SELECT doc_id, sum(c) FILTER (c > 5) AS repetitive FROM f GROUP BY doc_id),
s AS (SELECT doc_id, chunks, words, 2 * {any_of("l", ["of the", "in the"])} + {any_of("l", ["that"])} AS phrases FROM (SELECT doc_id, count(*) AS chunks, sum(n) AS words, string_agg(l, ' ' ORDER BY chunk_index) AS l FROM c GROUP BY doc_id)), a AS (SELECT doc_id, count(*) AS repeats FROM h GROUP BY doc_id),
m AS (SELECT doc_id, words, 100 * phrases / greatest(words, 1) AS phrase_water, 100 * coalesce(repetitive, 0) / greatest(words, 1) AS repetition_water, 100 * coalesce(repeats, 0) / greatest(chunks, 1) AS semantic_water FROM s LEFT JOIN o USING (doc_id) LEFT JOIN a USING (doc_id)),
z AS (SELECT *, CASE WHEN words = 0 THEN 50 ELSE least(phrase_water + repetition_water + semantic_water, 100) END AS water FROM m)
SELECT doc_id, {rounded("water phrase_water repetition_water semantic_water")}, round(1 - water / 100, 6) AS info_density, {ladder("water", nv.WATER, "verbose")} AS rating FROM z
"""
_FREQUENT = f"""
WITH f AS (SELECT doc_id, w AS word, count(*) AS n FROM (SELECT doc_id, unnest({tokens("l")}) AS w FROM ({_CHUNK})) WHERE length(w) > 3 GROUP BY ALL HAVING count(*) >= 4)
SELECT doc_id, word, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, encode(word)) AS rank FROM f) WHERE rank <= 10
"""

# ---- transitions, structure

_LISTS = {"a": ["and", "the"], "b": ["for", "from"]}


def _transition(last: str, first: str) -> str:
    content = lambda c: f"list_filter(list_distinct({tokens(c)}), lambda x: NOT list_contains({listed(dn.TRANSITION_STOPS)}, x))"
    linked = " + ".join(f"CASE WHEN len(list_filter({listed(v)}, lambda k: starts_with({first}, k) OR contains({first}, ' ' || k || ' '))) > 0 THEN 0.3 ELSE 0 END" for v in _LISTS.values())
    return f"least(0.5 + {linked} + least(0.1 * len(list_intersect({content(last)}, {content(first)})), 0.2), 1)"


_COHERENCE = f"""
WITH c AS (SELECT doc_id, chunk_index, {sentences("content")} AS s, list_distinct({words("content", WORD + "{4,}")}) AS w FROM ({chunks()})),
n AS (SELECT doc_id, lower(s[-1]) AS last, lower(lead(s[1]) OVER o) AS first, w, lead(w) OVER o AS v FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY chunk_index)),
g AS (SELECT doc_id, count(*) AS n, avg(CASE WHEN last IS NOT NULL AND first IS NOT NULL THEN {_transition("last", "first")} END) AS t, avg(CASE WHEN len(w) > 0 AND len(v) > 0 THEN len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))) END) AS j FROM n GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN n < 2 THEN 1 ELSE coalesce(t, 0) END, 6) AS transitions, round(CASE WHEN n < 2 THEN 1 ELSE coalesce(j, 0) END, 6) AS thematic FROM g
"""

_PARTS = {"first": ["the"], "then": ["and"], "most": ["that"], "last": ["was", "is"]}
_STRUCTURED = f"""
WITH t AS (SELECT *, lower(text) AS l, {pieces("text", chr(10))} AS p, {sentences("text")} AS s, len({tokens("text")}) AS words FROM (ROWS)),
u AS (SELECT *, list_transform(p, lambda x: len({tokens("x")})) AS pl, list_transform(s, lambda x: len({tokens("x")})) AS sl, list_transform(p, lambda x: lower({sentences("x")}[1])) AS firsts, list_transform(p, lambda x: lower({sentences("x")}[-1])) AS lasts,
  {any_of("l", _LISTS["a"])} AS la, {any_of("l", _LISTS["b"])} AS lb, {", ".join(f"{any_of('l', v)} AS p{i}" for i, v in enumerate(_PARTS.values()))},
  {sub("text", ",")} + {sub("text", ";")} + {sub("text", ":")} AS m0, {sub("text", "!")} + {sub("text", "?")} AS m1, {sub("text", "...")} + {sub("text", "—")} + {sub("text", "–")} AS m2,
  {sub("text", "?")} AS kx, {sub("text", "!")} + {sub("text", "the")} AS ky FROM t),
v AS (SELECT *, {mean("pl")} AS mp, {mean("sl")} AS ms, {variance("pl")} AS vp, {variance("sl")} AS vs, len(p) AS paragraphs, len(s) AS sentences, p0 + p1 + p2 + p3 AS whole, la + lb AS link FROM u),
x AS (SELECT *, mp AS paragraph_length, CASE WHEN sentences > 0 THEN words / sentences ELSE 0 END AS sentence_length, vp AS paragraph_variance, vs AS sentence_variance,
  CASE WHEN mp > 0 THEN greatest(0, 1 - {mean("list_transform(pl, lambda y: abs(y - mp))")} / mp) ELSE 0 END AS paragraph_regularity, sentences / greatest(paragraphs, 1) AS sentences_per_paragraph,
  len(list_filter(pl, lambda y: y < 50)) / greatest(paragraphs, 1) AS short_paragraphs, len(list_filter(pl, lambda y: y BETWEEN 50 AND 150)) / greatest(paragraphs, 1) AS medium_paragraphs, len(list_filter(pl, lambda y: y > 150)) / greatest(paragraphs, 1) AS long_paragraphs,
  CASE WHEN paragraphs < 2 THEN 1 ELSE {total("list_transform(range(1, paragraphs), lambda i: coalesce(" + _transition("lasts[i]", "firsts[i + 1]").replace("lambda x:", "lambda wz:").replace("(x,", "(wz,").replace(", x)", ", wz)") + ", 0))")} / (paragraphs - 1) END AS transition_quality,
  link / greatest(sentences, 1) AS connective_density, CASE WHEN sentences > 0 THEN least(link / sentences / 0.3, 1) ELSE 0 END AS logical_flow, (CAST(la > 0 AS INT) + CAST(lb > 0 AS INT)) / 2 AS connective_diversity,
  (CAST(p0 > 0 AS INT) + CAST(p1 > 0 AS INT) + CAST(p2 > 0 AS INT) + CAST(p3 > 0 AS INT)) / 4 AS completeness, CASE WHEN whole > 0 THEN 1 - (pow(p0 / whole - 0.25, 2) + pow(p1 / whole - 0.25, 2) + pow(p2 / whole - 0.25, 2) + pow(p3 / whole - 0.25, 2)) / 4 ELSE 0 END AS composition_balance,
  CASE WHEN p0 > 0 AND p3 > 0 AND p1 > 0 THEN 'linear' WHEN p0 > 0 AND p3 > 0 THEN 'circular' WHEN p1 > p2 + p3 THEN 'parallel' WHEN p0 > 0 AND p1 > 0 AND p2 > 0 AND p3 > 0 THEN 'classical' ELSE 'mosaic' END AS composition_type,
  CASE WHEN ms > 0 THEN sqrt(vs) / ms ELSE 0 END AS variation, 1000 * paragraphs / greatest({total("pl")}, 1) AS pause_frequency, 1000 * m0 / greatest(length(text), 1) AS slow_density, 1000 * m1 / greatest(length(text), 1) AS fast_density, 1000 * m2 / greatest(length(text), 1) AS pause_density,
  m1 / greatest(m0, 1) AS tempo_ratio, CASE WHEN sentences = 0 OR words = 0 THEN 0 ELSE (2 * {any_of("l", ["for", "that"])} / greatest(words, 1) + len(list_filter(s, lambda y: regexp_matches(y, '[0-9]{{4}}|[0-9]+%'))) / greatest(sentences, 1)) / 3 END AS information_density,
  (CAST(kx > 0 AS INT) + CAST(ky > 0 AS INT)) / 3 AS narrative_diversity, CASE WHEN sentences > 0 THEN (kx + ky) / sentences ELSE 0 END AS narrative_density FROM v),
y AS (SELECT *, greatest(medium_paragraphs - 0.5 * short_paragraphs - 0.3 * long_paragraphs, 0) AS paragraph_balance, CASE WHEN sentences > 0 THEN 1 - abs(variation - 0.5) / 0.5 ELSE 0 END AS rhythm FROM x),
z AS (SELECT *, CASE WHEN paragraphs > 0 THEN (paragraph_balance + transition_quality) / 2 ELSE 0 END AS paragraph_structure FROM y),
f AS (SELECT *, 0.2 * paragraph_structure + 0.25 * logical_flow + 0.2 * completeness + 0.15 * rhythm + 0.1 * information_density + 0.1 * narrative_diversity AS overall FROM z)
"""
_STRUCTURE = _STRUCTURED.replace("ROWS", "SELECT doc_id, text FROM documents") + f"""
SELECT doc_id, paragraphs, sentences, composition_type, {rounded("paragraph_length sentence_length paragraph_variance sentence_variance paragraph_regularity sentences_per_paragraph short_paragraphs medium_paragraphs long_paragraphs paragraph_balance transition_quality connective_density logical_flow connective_diversity completeness composition_balance variation rhythm pause_frequency slow_density fast_density pause_density tempo_ratio information_density narrative_diversity narrative_density paragraph_structure overall")}, {ladder("overall", nv.STRUCTURE_GRADES, "отличная")} AS grade FROM f
"""
_STRUCTURE_ROLLUP = (
    _STRUCTURED.replace("ROWS", f"SELECT doc_id, content AS text FROM ({chunks()})").rstrip() + ", final AS (SELECT doc_id, logical_flow, rhythm, connective_density, (0.25 * logical_flow + 0.15 * rhythm) / 0.4 AS overall FROM z), rolled AS ("
    + _rollup("", "doc_id", ["overall", "logical_flow", "rhythm", "connective_density"]) + f") SELECT *, {ladder('avg_overall', nv.STRUCTURE_GRADES, 'отличная')} AS grade FROM rolled"
)

# ---- dialogue

_SAID = {"emotions": [["the"], ["and", "of"], ["zz"]], "features": [["that"], ["is", "in"]], "verbs": ["was", "said", "from"], "colloquial": ["the", "der"], "interjections": ["of"], "natural": ["and", "in"]}


def _dialogue(rows: str) -> str:
    """rows: key, text (dashes in it)."""
    quote = "regexp_extract_all(zl, '[\"«]([^\"»]+)[\"»]', 1)"
    dash = f"regexp_extract_all(zl, '[—–][{BLANK}]*([^—–\\n][^—–\\n.!?]*)[.!?]', 1)"
    colon = f"regexp_extract_all(zl, ':[{BLANK}]*[—–][{BLANK}]*([^—–\\n][^—–\\n.!?]*)[.!?]', 1)"
    per = lambda keys: total(f"list_transform(low, lambda x: {any_of('x', keys)})")
    mark = lambda m: total(f"list_transform(low, lambda x: {sub('x', m)})")
    return f"""
WITH d0 AS (SELECT *, {pieces("text", chr(10))} AS ls FROM ({rows})),
d1 AS (SELECT *, list_transform(ls, lambda zl: list_concat({dash}, {quote}, {colon})) AS ps FROM d0),
d2 AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: len(ps[i]) > 0) AS spot FROM d1),
d3 AS (SELECT *, list_transform(flatten(list_transform(spot, lambda i: ps[i])), lambda x: {strip("x")}) AS parts, {total(f"list_transform(spot, lambda i: len(regexp_extract_all(ls[i], '(?i)({'|'.join(_SAID['verbs'])})')))")} AS author,
  list_reduce(spot, lambda a, i: {{'last': i, 'run': CASE WHEN i = a.last + 1 THEN a.run + 1 ELSE 1 END, 'best': greatest(a.best, CASE WHEN i = a.last + 1 THEN a.run + 1 ELSE 1 END)}}, {{'last': -2::BIGINT, 'run': 0::BIGINT, 'best': 0::BIGINT}}).best AS longest_run FROM d2),
d4 AS (SELECT *, list_transform(parts, lambda x: lower(x)) AS low, list_transform(parts, lambda x: len({tokens("x")})) AS lens, flatten(list_transform(parts, lambda x: {words("x", WORD + "+")})) AS w, len(parts) AS np, len(spot) AS dialogue_count, len({tokens("text")}) AS tw, len(string_split(text, chr(10))) AS blocks FROM d3),
d5 AS (SELECT *, {total("lens")} AS speech_words, {total("list_transform(parts, lambda x: length(x))")} AS speech_chars, greatest(np, 1) AS n, greatest(len(w), 1) AS wn, {", ".join(f"{per(k)} AS e{i}" for i, k in enumerate(_SAID["emotions"]))}, {", ".join(f"{per(k)} AS f{i}" for i, k in enumerate(_SAID["features"]))},
  {mark("?")} AS q, {mark("!")} AS x_, {mark("...")} AS dots, {mark("…")} AS dot FROM d4),
d6 AS (SELECT *, CASE WHEN dialogue_count > 0 THEN speech_words / greatest(tw, 1) ELSE 0 END AS dialogue_ratio, speech_words / n AS avg_speech_length, {variance("lens")} AS speech_length_variance, len(list_distinct(w)) / wn AS speech_diversity,
  CASE WHEN dialogue_count = 0 THEN 0 WHEN blocks > 1 THEN 1 - (spot[-1] - spot[1]) / blocks ELSE 1 END AS spread, CASE WHEN dialogue_count = 0 THEN 0 ELSE greatest(0, 1 - longest_run / 10) END AS alternation, least(author / greatest(dialogue_count, 1) / 2, 1) AS author_integration,
  q / n AS questions_per_utterance, x_ / n AS exclamations_per_utterance, (dots + dot) / n AS ellipses_per_utterance, (CAST(e0 > 0 AS INT) + CAST(e1 > 0 AS INT) + CAST(e2 > 0 AS INT)) / 3 AS emotional_diversity, (e0 + e1 + e2) / n AS emotional_intensity,
  {", ".join(f"CASE WHEN e0 + e1 + e2 > 0 THEN e{i} / (e0 + e1 + e2) ELSE 0 END AS emotion_{i}_share" for i in range(3))}, f0 / n AS feature_0_rate, f1 / n AS feature_1_rate,
  len(list_filter(parts, lambda x: NOT contains(x, ','))) / n AS simple_ratio, len(list_filter(parts, lambda x: regexp_matches(x, '(?i)^[а-я].*[^.!?]$'))) / n AS incomplete_ratio, {within("w", _SAID["colloquial"])} / wn AS colloquial_ratio, {within("w", _SAID["interjections"])} / wn AS interjection_ratio,
  CASE WHEN dialogue_count = 0 THEN 0 ELSE greatest(0, 1 - greatest(0, speech_words / n - 20) / 30) END AS length_authenticity, CASE WHEN dialogue_count = 0 THEN 0 ELSE least({per(_SAID["natural"])} / n, 1) END AS colloquial_authenticity,
  CASE WHEN dialogue_count = 0 THEN 0 ELSE least((x_ + q + dots) / n / 2, 1) END AS emotional_authenticity, CASE WHEN dialogue_count = 0 THEN 0 ELSE least(len(list_filter(parts, lambda x: NOT regexp_matches(x, '[.!?]$'))) / n * 2, 1) END AS structural_authenticity FROM d5),
d7 AS (SELECT *, CASE WHEN dialogue_ratio < 1 THEN dialogue_ratio / (1 - dialogue_ratio) ELSE 'inf'::DOUBLE END AS speech_to_narrative, (spread + alternation + author_integration) / 3 AS structure, (length_authenticity + colloquial_authenticity + emotional_authenticity + structural_authenticity) / 4 AS authenticity,
  greatest(0, 1 - abs(dialogue_ratio - 0.3) / 0.3) AS near FROM d6),
d8 AS (SELECT *, CASE WHEN dialogue_count > 0 THEN 0.25 * structure + 0.2 * speech_diversity + 0.2 * emotional_diversity + 0.25 * authenticity + 0.1 * near ELSE 0 END AS overall, CASE WHEN dialogue_count > 0 THEN (0.2 * speech_diversity + 0.2 * emotional_diversity + 0.1 * near) / 0.5 ELSE 0 END AS chunk_overall FROM d7)
"""


_SPOKEN = _dialogue("SELECT doc_id, replace(text, ', ', ' — ') AS text FROM documents")
_DIALOGUE = "dialogue_ratio speech_to_narrative avg_speech_length speech_length_variance speech_diversity spread alternation author_integration questions_per_utterance exclamations_per_utterance ellipses_per_utterance emotional_diversity emotional_intensity emotion_0_share emotion_1_share emotion_2_share feature_0_rate feature_1_rate simple_ratio incomplete_ratio colloquial_ratio interjection_ratio length_authenticity colloquial_authenticity emotional_authenticity structural_authenticity structure authenticity overall"


def _positive(last: str, count: str, names: dict[str, str], grades, top: str) -> str:
    cells = ", ".join(f"round(avg({c}) FILTER ({c} > 0), 6) AS avg_{n}, round(max({c}) FILTER ({c} > 0), 6) AS max_{n}" for n, c in names.items())
    first = names["overall"]
    return f"SELECT doc_id, count(*) AS chunks, CAST(sum({count}) AS BIGINT) AS total, count(*) FILTER ({count} > 0) AS chunks_with_any, round(count(*) FILTER ({count} > 0) / count(*), 6) AS share, {cells}, {ladder(f'coalesce(avg({first}) FILTER ({first} > 0), 0)', grades, top)} AS grade FROM {last} GROUP BY doc_id"


_DIALOGUE_ROLLUP = _dialogue(f"SELECT doc_id, replace(content, ', ', ' — ') AS text FROM ({chunks()})") + _positive("d8", "dialogue_count", {"overall": "chunk_overall", "dialogue_ratio": "dialogue_ratio", "speech_diversity": "speech_diversity", "emotional_diversity": "emotional_diversity"}, nv.DIALOGUE_GRADES, "отличный")

_VOICES = f"""{_SPOKEN}, v AS (SELECT doc_id, list_transform(parts, lambda x: [CAST(len({tokens("x")}) AS DOUBLE), {any_of("lower(x)", _SAID["features"][0])}, {any_of("lower(x)", _SAID["features"][1])}, {sub("x", "?")}, {sub("x", "!")}, CAST(len(regexp_extract_all(lower(x), 'the|of')) AS DOUBLE)]) AS sig FROM d4)
SELECT doc_id, CAST(len(list_reduce(sig, lambda a, x: CASE WHEN len(list_filter(a, lambda y: list_sum(list_transform(range(1, 7), lambda i: CASE WHEN x[i] = 0 AND y[i] = 0 THEN 1 ELSE 1 - abs(x[i] - y[i]) / greatest(x[i], y[i], 1) END)) / 6 >= 0.7)) > 0 THEN a ELSE list_append(a, x) END, CAST([] AS DOUBLE[][]))) AS INT) AS voices FROM v"""

# ---- descriptions

_MARKERS, _SENSES = {"a": ["the", "of"], "b": ["and", "was"]}, {"c": ["that"], "d": ["with", "from"]}


def _described(rows: str, key: str) -> str:
    tok = tokens("lower(s)")
    score = f"1e-1 * ({' + '.join(within('w', v) for v in _MARKERS.values())}) + 15e-2 * ({' + '.join(within('w', v) for v in _SENSES.values())})"  # doubles, not decimals
    return f"""
WITH b AS (SELECT {key}, text, len({tokens("text")}) AS words, {sentences("text")} AS ss FROM ({rows})), b2 AS (SELECT *, len(ss) AS sentences FROM b),
p AS (SELECT {key}, words, sentences, place, s, {tok} AS w FROM (SELECT {key}, words, sentences, i - 1 AS place, ss[i] AS s FROM b2, LATERAL (SELECT unnest(range(1, len(ss) + 1)) AS i))),
q AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 ELSE least({score}, 1) END AS score, lower(s) AS l, len(w) AS length FROM p),
f AS (SELECT *, {", ".join(f"{has('l', v)} AS k{i}" for i, v in enumerate(_MARKERS.values()))}, {", ".join(f"{any_of('l', v)} AS s{i}" for i, v in enumerate(_SENSES.values()))}, {any_of("l", ["and", "of"])} AS v0, {any_of("l", ["the"])} AS t0, floor(sentences / 5) AS seg FROM q WHERE score > 3e-1),
g AS (SELECT {key}, count(*) AS n, sum(length) AS described, avg(length) AS mean_length, stddev_pop(length) AS sd, avg(score) AS mean_score, count(DISTINCT CASE WHEN seg = 0 THEN 4 ELSE least(floor(place / greatest(seg, 1)), 4) END) AS segments,
  CAST(bool_or(k0) AS INT) + CAST(bool_or(k1) AS INT) AS kinds, CAST(sum(s0) > 0 AS INT) + CAST(sum(s1) > 0 AS INT) AS senses, CAST(sum(v0) > 0 AS INT) AS devices, CAST(sum(t0) > 0 AS INT) AS times FROM f GROUP BY {key}),
w AS (SELECT {key}, place, sentences, greatest(floor(sentences / 10), 1) AS win FROM f), w2 AS (SELECT *, greatest(floor(win / 2), 1) AS step FROM w),
a AS (SELECT {key}, area, count(*) AS c FROM w2, LATERAL (SELECT unnest(range(CAST(greatest(ceil((place - win + 1) / step), 0) AS BIGINT), CAST(floor(place / step) AS BIGINT) + 1)) AS area) WHERE area * step < greatest(sentences - win + 1, 1) GROUP BY ALL HAVING count(*) >= 3),
e AS (SELECT {key}, count(*) AS dense_areas FROM a GROUP BY {key}),
m AS (SELECT {key}, coalesce(n, 0) AS passages, coalesce(described, 0) / greatest(words, 1) AS ratio, coalesce(kinds, 0) / 2 AS type_diversity, coalesce(senses, 0) / 2 AS sensory_diversity, coalesce(devices, 0) / 2 AS literary_diversity, least(coalesce(mean_length, 0) / 20 * coalesce(mean_score, 0), 1) AS detail,
  coalesce(segments, 0) / 5 AS distribution, coalesce(mean_length, 0) AS mean_length, 1000 * coalesce(n, 0) / greatest(words, 1) AS per_thousand_words, CASE WHEN n > 0 THEN greatest(0, 1 - sd / greatest(mean_length, 1)) ELSE 0 END AS consistency, coalesce(dense_areas, 0) AS dense_areas, coalesce(times, 0) / 2 AS time_diversity
  FROM b2 LEFT JOIN g USING ({key}) LEFT JOIN e USING ({key})),
o AS (SELECT *, {clamp("1 - abs(ratio - 0.225) / 0.225")} AS fit FROM m),
z AS (SELECT *, CASE WHEN passages = 0 THEN 0 ELSE 0.15 * fit + 0.2 * type_diversity + 0.2 * sensory_diversity + 0.15 * literary_diversity + 0.15 * detail + 0.15 * distribution END AS overall, CASE WHEN passages > 0 THEN (0.15 * fit + 0.2 * type_diversity + 0.2 * sensory_diversity) / 0.55 ELSE 0 END AS chunk_overall FROM o)
"""


_DESCRIPTION = _described("SELECT doc_id, text FROM documents", "doc_id") + f"SELECT doc_id, passages, dense_areas, {rounded('ratio type_diversity sensory_diversity literary_diversity detail distribution mean_length per_thousand_words consistency time_diversity overall')}, {ladder('overall', dn.DESCRIPTION_GRADES, 'превосходный')} AS grade FROM z"
_DESCRIPTION_ROLLUP = _described(f"SELECT {{'doc_id': doc_id, 'i': chunk_index}} AS kk, content AS text FROM ({chunks()})", "kk") + ", zz AS (SELECT kk.doc_id AS doc_id, * FROM z) " + _positive("zz", "passages", {"overall": "chunk_overall", "ratio": "ratio", "type_diversity": "type_diversity", "sensory_diversity": "sensory_diversity"}, dn.DESCRIPTION_GRADES, "превосходный")

_EMOTIONS = {"calm": ["the", "and"], "bright": ["tion", "ing"], "dark": ["wh", "th"]}

SQL: dict[str, str] = {
    "readability_full": f"{_READ} SELECT doc_id, chars, words, sentences, paragraphs, syllables, {rounded(_RATES)}, {ladder('overall', [(0.2, 'very_difficult'), (0.4, 'difficult'), (0.6, 'medium'), (0.8, 'easy')], 'very_easy')} AS grade FROM r6",
    "readability_rollup": _rollup(_final(_readability(f"SELECT doc_id, content AS text FROM ({chunks()})", "", "", "", False), "r6"), "doc_id", ["overall", "flesch", "words_per_sentence", "lexical_diversity", "complex_words_ratio"]),
    "complexity": f"{_complexity('SELECT doc_id, text FROM documents')} SELECT doc_id, paragraphs, {rounded(_COMPLEX)}, {ladder('overall', [(0.3, 'elementary'), (0.6, 'intermediate'), (0.8, 'advanced')], 'expert')} AS level FROM c6",
    "complexity_rollup": _rollup(_final(_complexity(f"SELECT doc_id, content AS text FROM ({chunks()})"), "c6"), "doc_id", ["overall", "flesch", "lexical_diversity"]),
    "emotion": f"""WITH e AS (SELECT doc_id, {", ".join(f"round({any_of('c', v)} / greatest(n, 1) * 10, 3) AS {k}" for k, v in _EMOTIONS.items())} FROM (SELECT doc_id, lower(text) AS c, len({tokens("text")}) AS n FROM documents))
      SELECT doc_id, CASE WHEN calm >= bright AND calm >= dark THEN 'calm' WHEN bright >= dark THEN 'bright' ELSE 'dark' END AS dominant, bright, dark, CASE WHEN bright > dark * 1.2 THEN 'positive' WHEN dark > bright * 1.2 THEN 'negative' ELSE 'neutral' END AS tone,
      round(least(greatest(CASE WHEN bright > dark * 1.2 THEN 0.6 + (bright - dark) * 0.1 WHEN dark > bright * 1.2 THEN 0.4 - (dark - bright) * 0.1 ELSE 0.5 END, 0), 1), 6) AS tone_score FROM e""",
    "chunks_by_sentence": _BY_SENTENCE,
    "chunks_of_sentences": _by_count("text", "sentence", 5),
    "chunks_of_lines": _by_count(_LINES, "paragraph", 3),
    "chunks_by_paragraph": _paragraphs(400, 100, 600),
    "chunk_overlaps": _OVERLAPS,
    "chunk_plans": _PLANS,
    "pace": _PACE,
    "tension": _TENSION,
    "relevant_chunks": _RELEVANT,
    "repetitions": _REPETITIONS,
    "water": _WATER,
    "frequent_words": _FREQUENT,
    "chunk_coherence": _COHERENCE,
    "structure": _STRUCTURE,
    "structure_rollup": _STRUCTURE_ROLLUP,
    "dialogue": f"{_SPOKEN} SELECT doc_id, dialogue_count, CAST(speech_words AS BIGINT) AS speech_words, CAST(speech_chars AS BIGINT) AS speech_chars, longest_run, {rounded(_DIALOGUE)}, {ladder('overall', nv.DIALOGUE_GRADES, 'отличный')} AS grade FROM d8",
    "dialogue_rollup": _DIALOGUE_ROLLUP,
    "speech_voices": _VOICES,
    "description_measures": _DESCRIPTION,
    "description_rollup": _DESCRIPTION_ROLLUP,
}
