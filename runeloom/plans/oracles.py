"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

from runeloom.functions.english import PARTICIPLES
from runeloom.functions.loan import respell_sql
from runeloom.functions.morphology import open_codas
from runeloom.functions.sounds import DIGRAPHS
from runeloom.operators.tagging import tags_sql
from runeloom.operators.vocabulary import ABSORBED, TARGETS
from runeloom.plans.queries import CAP, CORPORA, GOAL, KS, MIN_WORDS, SHARD, VAL_SHARE

_NORM = r"trim(regexp_replace(lower({0}), '[\t-\r\x1C-\x20\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g'))".format
_SPLIT = "CASE WHEN ('0x' || substr(sha1({0}), 1, 8))::BIGINT % 10000 < {1} * 10000 THEN 'val' ELSE 'train' END".format

_REASON = f"""r AS (SELECT *, {_NORM('en')} AS n, CASE WHEN unknown_n > 0 THEN 'unknown tokens' WHEN 20000 * loans > (20000 * {CAP}::DECIMAL(10,6) + 1) * words THEN 'loan rate' WHEN words < {MIN_WORDS} THEN 'too short' END AS bad FROM SOURCE),
k AS (SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN en IS NOT NULL AND row_number() OVER (PARTITION BY n, bad ORDER BY ordinal) > 1 THEN 'duplicate' END AS reason FROM r)"""
_PACK = "WITH " + _REASON.replace("SOURCE", "(SELECT * FROM parallel_records WHERE en IS NOT NULL AND kz IS NOT NULL)") + f", p AS (SELECT *, {_SPLIT('n', VAL_SHARE)} AS pack_split FROM k WHERE reason IS NULL) "

_ABSORBED = " OR ".join(f"(pos = '{p}' AND lemma IN ({', '.join(repr(w) if chr(39) not in w else chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in ws)}))" for p, ws in ABSORBED.items())
_KNOWN = ", ".join(f"('{a}', '{v}')" for a, v in PARTICIPLES.items())

# candidates (word, place, base) of adverbs and of participles, from a table with the column {0}
_LY = """SELECT {0} AS w, 1 AS k, {0}[:-4] || 'y' AS base FROM {1} WHERE length({0}) >= 5 AND {0} LIKE '%ily'
UNION ALL SELECT {0}, 2, {0}[:-7] || 'ic' FROM {1} WHERE length({0}) >= 5 AND {0} LIKE '%ically'
UNION ALL SELECT {0}, 3, {0}[:-2] || 'e' FROM {1} WHERE length({0}) >= 5 AND regexp_matches({0}, '[bptd]ly$')
UNION ALL SELECT {0}, 4, {0}[:-2] FROM {1} WHERE length({0}) >= 5 AND {0} LIKE '%lly'
UNION ALL SELECT {0}, 5, {0}[:-3] FROM {1} WHERE length({0}) >= 5 AND {0} LIKE '%ly'"""
_PART = f"""SELECT {{0}} AS w, 0 AS k, v AS base, 'PST' AS tag FROM {{1}} JOIN (VALUES {_KNOWN}) x(a, v) ON a = {{0}}
UNION ALL SELECT {{0}}, 1, {{0}}[:-4] || 'y', 'PST' FROM {{1}} WHERE length({{0}}) > 4 AND {{0}} LIKE '%ied'
UNION ALL SELECT {{0}}, 2, {{0}}[:-3], 'PST' FROM {{1}} WHERE length({{0}}) > 4 AND {{0}} LIKE '%ed'
UNION ALL SELECT {{0}}, 3, {{0}}[:-3] || 'e', 'PST' FROM {{1}} WHERE length({{0}}) > 4 AND {{0}} LIKE '%ed'
UNION ALL SELECT {{0}}, 4, {{0}}[:-2], 'PST' FROM {{1}} WHERE length({{0}}) > 4 AND {{0}} LIKE '%ed'
UNION ALL SELECT {{0}}, 5, {{0}}[:-4], 'PST' FROM {{1}} WHERE length({{0}}) > 4 AND {{0}} LIKE '%ed' AND {{0}}[-3] = {{0}}[-4]
UNION ALL SELECT {{0}}, 6, {{0}}[:-4], 'PROG' FROM {{1}} WHERE length({{0}}) > 5 AND {{0}} LIKE '%ing'
UNION ALL SELECT {{0}}, 7, {{0}}[:-4] || 'e', 'PROG' FROM {{1}} WHERE length({{0}}) > 5 AND {{0}} LIKE '%ing'
UNION ALL SELECT {{0}}, 8, {{0}}[:-5], 'PROG' FROM {{1}} WHERE length({{0}}) > 5 AND {{0}} LIKE '%ing' AND {{0}}[-4] = {{0}}[-5]"""


def _coverage(split: str = "") -> str:
    where = f" WHERE split = '{split}'" if split else ""
    return tags_sql(f"SELECT ordinal AS place, en AS text FROM parallel_records{where}") + f""",
cls AS (SELECT t.*, CASE WHEN t.pos = 'NUM' OR like_num THEN 'number' WHEN t.pos = 'PROPN' THEN 'name' WHEN {_ABSORBED.replace('pos =', 't.pos =')} THEN 'absorbed' WHEN f.word IS NOT NULL THEN 'function'
  WHEN t.pos IN ('NOUN', 'VERB', 'ADJ', 'ADV', 'INTJ') THEN 'content' ELSE 'fgap' END AS bucket FROM tagged t LEFT JOIN fidx f ON f.word = lemma AND f.pos = t.pos),
s0 AS (SELECT lemma, pos, sum(n)::BIGINT AS count, min(place) AS place FROM cls WHERE bucket = 'content' GROUP BY ALL),
adv AS (SELECT lemma FROM s0 WHERE pos = 'ADV'),
advc AS (SELECT lemma AS w, 0 AS k, lemma AS base FROM adv UNION ALL {_LY.format('lemma', 'adv')}),
advto AS (SELECT w, arg_min(base, k) AS base FROM advc WHERE base IN (SELECT lemma FROM s0 WHERE pos = 'ADJ') GROUP BY w),
m1 AS (SELECT coalesce(base, lemma) AS lemma, CASE WHEN base IS NULL THEN pos ELSE 'ADJ' END AS pos, count, place, base IS NOT NULL AS moved FROM s0 LEFT JOIN advto ON w = lemma AND pos = 'ADV'),
s1 AS (SELECT lemma, pos, sum(count)::BIGINT AS count, coalesce(min(place) FILTER (NOT moved), min(place)) AS place FROM m1 GROUP BY ALL),
adj AS (SELECT lemma FROM s1 WHERE pos = 'ADJ'),
adjc AS ({_PART.format('lemma', 'adj')}),
adjto AS (SELECT w, arg_min(base, k) AS base FROM adjc WHERE base IN (SELECT lemma FROM s1 WHERE pos = 'VERB') GROUP BY w),
m2 AS (SELECT coalesce(base, lemma) AS lemma, CASE WHEN base IS NULL THEN pos ELSE 'VERB' END AS pos, count, place, base IS NOT NULL AS moved FROM s1 LEFT JOIN adjto ON w = lemma AND pos = 'ADJ'),
s2 AS (SELECT lemma, pos, sum(count)::BIGINT AS count, coalesce(min(place) FILTER (NOT moved), min(place)) AS place FROM m2 GROUP BY ALL),
tot AS (SELECT sum(n)::BIGINT AS words, (sum(n) FILTER (bucket NOT IN ('content', 'fgap')))::BIGINT AS free FROM cls),
wl AS (SELECT row_number() OVER o AS rank, lemma, pos, count, place, count * 1e6::DOUBLE / words AS per_million, (free + sum(count) OVER (o ROWS UNBOUNDED PRECEDING))::BIGINT / words AS cum_coverage FROM s2, tot WINDOW o AS (ORDER BY count DESC, lemma, pos))"""


def _view(split: str) -> str:
    """A corpus' worklist, and the share that needs no entry, as one subquery."""
    return f"(WITH {_coverage(split)} SELECT '{split}' AS corpus, lemma, pos, count, per_million, (SELECT free / words FROM tot) AS free FROM wl)"


_C = "WITH " + _coverage()
_CORPORA = "WITH w AS (" + " UNION ALL ".join(f"FROM {_view(s)}" for s in CORPORA) + "), m AS (SELECT lemma, pos, sum(count)::BIGINT AS count, sum(per_million) / 3 AS per_million FROM w GROUP BY ALL)"
_SENSES = "sense AS (SELECT kz, regexp_extract(s, '^(.*)/', 1) AS lemma, regexp_extract(s, '([^/]*)$', 1) AS pos FROM (SELECT kz, unnest(en) AS s FROM lexicon))"
_TYPES = r"types AS (SELECT DISTINCT lower(unnest(regexp_extract_all(en, '[\p{L}\p{N}]+'))) AS word FROM parallel_records)"
_ROOTS = "roots AS (SELECT DISTINCT kz AS word, lower(origin) AS source FROM (SELECT kz, origin FROM lexicon UNION ALL SELECT kz, origin FROM function_words))"
_NEAR = _ROOTS + ", d AS (SELECT DISTINCT word, unnest(list_append(list_transform(range(1, length(word) + 1), lambda i: word[:i - 1] || word[i + 1:]), word)) AS key FROM roots), near AS (SELECT DISTINCT a.word AS query, b.word AS hit FROM d a JOIN d b USING (key))"
_SEG = f"list_transform(regexp_extract_all(lower(word), '({'|'.join(DIGRAPHS)}|.)'), lambda s: CASE s WHEN 'tch' THEN 'ch' WHEN 'ck' THEN 'k' ELSE s END)"
_TRI = _ROOTS + f""", sg AS (SELECT DISTINCT word, source, list_concat(['<', '<'], {_SEG}, ['>']) AS s FROM roots),
t AS (SELECT word, source, s[i] AS a, s[i + 1] AS b, s[i + 2] AS c FROM (SELECT word, source, s, unnest(range(1, len(s) - 1)) AS i FROM sg))"""


def _coda(form: str) -> str:
    return f"CASE WHEN regexp_matches(kz, '[aeiou]$') OR regexp_extract(kz, '[^aeiou]*$') IN ('', {', '.join(repr(c) for c in sorted(open_codas(form)))}) THEN '' ELSE 'a' END || '{form}'"


_V = "regexp_replace({0}, '[aeiou]$', '')".format
_PL = "kz || CASE WHEN regexp_matches(kz, '[aeiou]$') THEN 'n' ELSE 'i' END"
_RW = respell_sql("word")
_VAT = "CASE WHEN length(r) > 4 THEN regexp_replace(r, 'at$', '') ELSE r END"

ORACLES: dict[str, str] = {
    "norm_text": f"SELECT doc_id, sha1(n) AS norm_sha1, CASE WHEN n = '' THEN 0 ELSE len(string_split(n, ' ')) END AS words FROM (SELECT doc_id, {_NORM('text')} AS n FROM documents)",
    "apostrophes": r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '([A-Za-z])[’‘ʼ]([A-Za-z])', '\1''\2', 'g'), '([A-Za-z])[’‘ʼ]([A-Za-z])', '\1''\2', 'g'), '(^|[^A-Za-z])[’‘]([tT](?:[iI][sS]|[wW][aA][sS]|[wW][iI][lL][lL]))\b', '\1''\2', 'g')) AS text_md5 FROM documents",
    "exact_dedupe_first": f"SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY {_NORM('text')}",
    "hash_split": f"SELECT doc_id, {_SPLIT(_NORM('text'), VAL_SHARE)} AS split FROM documents WHERE text IS NOT NULL",
    "drop_reasons": "WITH " + _REASON.replace("SOURCE", "parallel_records") + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS stories FROM k GROUP BY 1",
    "pack_records": _PACK + "SELECT ordinal, pack_split FROM p",
    "pack_counts": _PACK + "SELECT pack_split, count(*) AS stories, sum(words)::BIGINT AS words, sum(length(kz))::BIGINT AS chars, sum(loans)::BIGINT AS loans FROM p GROUP BY 1",
    "shard_stats": f"SELECT ordinal // {SHARD} AS shard, count(*) AS stories, sum(words)::BIGINT AS words, sum(loans)::BIGINT AS loans, sum(unknown_n)::BIGINT AS unknown FROM parallel_records GROUP BY 1",
    "run_summary": "SELECT count(*) AS stories, sum(words)::BIGINT AS words, sum(loans)::BIGINT AS loans, sum(unknown_n)::BIGINT AS unknown, sum(loans) / greatest(sum(words), 1) AS loan_rate FROM parallel_records",
    "top_loans": "SELECT e.key AS word, sum(e.value)::BIGINT AS n FROM (SELECT unnest(map_entries(loan_words)) AS e FROM text_stats) GROUP BY 1 ORDER BY n DESC, word LIMIT 100",
    "loan_rate_hist": "SELECT least(20, CASE WHEN words > 0 THEN (loans * 200 + words) // (words * 2) ELSE 0 END)::BIGINT AS percent, count(*) AS stories FROM parallel_records GROUP BY 1",
    "loan_bags": "SELECT ordinal, array_to_string(list_sort(flatten(list_transform(map_entries(loan_words), lambda e: list_transform(range(e.value), lambda i: e.key)))), ' ') AS loan_list FROM text_stats",
    "shard_records": "SELECT line_no, l ->> '$.id' AS id, (l ->> '$.words')::INT AS words, (l ->> '$.loans')::INT AS loans, (l ->> '$.loan_rate')::DOUBLE AS loan_rate, (l ->> '$.unknown')::INT AS unknown, (l ->> '$.names')::INT AS names, array_to_string((l -> '$.loan_words')::VARCHAR[], ' ') AS loan_list, md5(l ->> '$.en') AS en_md5 FROM (SELECT line_no, line::JSON AS l FROM shard_lines WHERE json_valid(line)) WHERE json_type(l) = 'OBJECT'",
    "tagged_types": "WITH " + tags_sql("SELECT ordinal AS place, en AS text FROM parallel_records") + " SELECT word, n, place, lemma, pos, like_num FROM tagged",
    "word_freq_rank": r"SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM (SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(en, '[\p{L}\p{N}]+')) AS w FROM parallel_records) GROUP BY 1)",
    "bucket_shares": _C + " SELECT bucket, sum(n)::BIGINT AS tokens, round(sum(n) / any_value(words), 6) AS share FROM cls, tot GROUP BY 1",
    "coverage_worklist": _C + r" SELECT rank, lemma, pos, count, round(per_million, 1) AS per_million, round(cum_coverage, 4) AS cum_coverage, substr(regexp_replace(trim(en), '\n', ' ', 'g'), 1, 120) AS example FROM wl JOIN parallel_records ON ordinal = place",
    "coverage_need": _C + " SELECT target, min(rank) FILTER (cum_coverage >= target) AS needed FROM wl, (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in TARGETS) + ") x(target) GROUP BY 1",
    "coverage_at_k": _C + f" SELECT rank AS k, round(cum_coverage, 6) AS coverage FROM wl WHERE rank IN {KS}",
    "pos_mix": _C + " SELECT pos, count(*) AS senses FROM wl WHERE rank <= 2000 GROUP BY 1",
    "gap_words": _C + " SELECT lemma, pos, sum(n)::BIGINT AS count FROM cls WHERE bucket = 'fgap' GROUP BY ALL ORDER BY count DESC, lemma, pos LIMIT 60",
    "lexicon_status": _C + " SELECT count(*) AS senses, round(sum(per_million) / 1e6 + any_value(free / words), 6) AS covered, round(any_value(free / words), 6) AS free FROM wl, tot WHERE (lemma, pos) IN (SELECT (lemma, pos) FROM sense)",
    "next_uncovered": _C + " SELECT rank, lemma, pos, count FROM wl WHERE (lemma, pos) NOT IN (SELECT (lemma, pos) FROM sense) ORDER BY rank LIMIT 40",
    "merge_worklists": _CORPORA + " SELECT lemma, pos, count, round(per_million, 4) AS per_million FROM m",
    "merged_coverage": _CORPORA + ", r AS (SELECT row_number() OVER o AS rank, lemma, pos, sum(per_million / 1e6) OVER (o ROWS UNBOUNDED PRECEDING) AS s FROM m WINDOW o AS (ORDER BY per_million DESC, lemma, pos)) SELECT rank, lemma, pos, round(s + (SELECT avg(free) FROM (SELECT DISTINCT corpus, free FROM w)), 6) AS cum_coverage FROM r",
    "merge_goal": _CORPORA + f""", {_SENSES}, known AS (SELECT DISTINCT lemma, pos FROM sense),
base AS (SELECT corpus, any_value(free) + coalesce(sum(per_million) FILTER ((lemma, pos) IN (SELECT (lemma, pos) FROM known)), 0) / 1e6 AS start FROM w GROUP BY 1),
todo AS (SELECT lemma, pos, row_number() OVER (ORDER BY per_million DESC, lemma, pos) AS n FROM m WHERE (lemma, pos) NOT IN (SELECT (lemma, pos) FROM known)),
steps AS (SELECT corpus, n, start + sum(per_million / 1e6) OVER (PARTITION BY corpus ORDER BY n) AS got FROM w JOIN todo USING (lemma, pos) JOIN base USING (corpus)),
each AS (SELECT CASE WHEN start >= {GOAL} THEN 0 ELSE (SELECT min(n) FROM steps s WHERE s.corpus = base.corpus AND got >= {GOAL}) END AS n FROM base)
SELECT CASE WHEN count(*) FILTER (n IS NULL) > 0 THEN (SELECT count(*) FROM todo) ELSE max(n) END AS needed, (SELECT count(*) FROM todo) AS senses FROM each""",
    "loan_respell": f"WITH {_TYPES} SELECT word, {_RW} AS respelled FROM types",
    "loan_stem": f"WITH {_TYPES}, x AS (SELECT word, {_RW} AS r FROM types) SELECT word, {_V('r')} || 'uz' AS noun, {_V(f'({_VAT})')} || 'ash' AS verb, r || 'rak' AS adj FROM x",
    "ly_candidates": f"WITH {_TYPES}, c AS ({_LY.format('word', 'types')}) SELECT word, coalesce((SELECT string_agg(base, ' ' ORDER BY k) FROM c WHERE w = word), '') AS bases FROM types WHERE word LIKE '%ly'",
    "participle_candidates": f"WITH {_TYPES}, c AS ({_PART.format('word', 'types')}) SELECT word, coalesce((SELECT string_agg(base || '+' || tag, ' ' ORDER BY k) FROM c WHERE w = word), '') AS verbs FROM types WHERE word LIKE '%ed' OR word LIKE '%ing'",
    "near_pairs": f"WITH {_NEAR} SELECT query, hit FROM near WHERE query < hit",
    "within_one_pairs": f"WITH {_NEAR} SELECT query AS a, hit AS b FROM near WHERE query < hit AND length(query) >= 3 AND length(hit) >= 3 AND damerau_levenshtein(query, hit) = 1",
    "near_hits": f"WITH {_NEAR} SELECT query, array_to_string(list_sort(list(hit))[:3], ',') AS hits FROM near WHERE query <> hit AND length(query) >= 4 GROUP BY query",
    "segment_words": f"WITH {_ROOTS}, s AS (SELECT DISTINCT word, {_SEG} AS s FROM roots) SELECT word, array_to_string(s, '.') AS segments, len(list_filter(range(1, len(s)), lambda i: s[i] = s[i + 1] AND s[i] NOT IN ('a', 'e', 'i', 'o', 'u', 'y'))) > 0 AS doubled FROM s",
    "sound_trigrams": f"WITH {_TRI} SELECT source, a, b, c, count(*) AS n FROM t GROUP BY ALL",
    "ending_percent": f"""WITH {_ROOTS}, c AS (SELECT word[-2:] AS key, count(*) FILTER (source = 'derived') AS d, count(*) FILTER (source = 'invented') AS i FROM roots WHERE source IN ('derived', 'invented') GROUP BY 1)
SELECT key, round(100 * d / sum(d) OVER (), 4) AS derived, round(100 * i / sum(i) OVER (), 4) AS invented, round(100 * (d + i) / sum(d + i) OVER (), 4) AS combined FROM c ORDER BY d + i DESC, key LIMIT 25""",
    "blend_distribution": f"WITH {_ROOTS}, n AS (SELECT source, count(*) AS words FROM roots GROUP BY 1) SELECT word[-2:] AS key, round(sum(CASE source WHEN 'invented' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END / words), 8) AS p FROM roots JOIN n USING (source) WHERE source IN ('invented', 'derived') GROUP BY 1",
    "trigram_logprob": f"""WITH {_TRI}, u AS (SELECT DISTINCT word, s FROM sg), x AS (SELECT word, i, s[i] AS a, s[i + 1] AS b, s[i + 2] AS c FROM (SELECT word, s, unnest(range(1, len(s) - 1)) AS i FROM u)),
n3 AS (SELECT a, b, c, count(*) AS n3 FROM x GROUP BY ALL), n2o AS (SELECT a, b, count(*) AS n2o FROM x GROUP BY ALL), n2 AS (SELECT b, c, count(*) AS n2 FROM x GROUP BY ALL), n1o AS (SELECT b, count(*) AS n1o FROM x GROUP BY ALL), n1 AS (SELECT c, count(*) AS n1 FROM x GROUP BY ALL),
tt AS (SELECT sum(n1) AS total, count(*) + 1 AS v FROM n1)
SELECT word, round(avg(log2(0.6 * n3 / n2o + 0.3 * n2 / n1o + 0.1 * (n1 + 1) / (total + v))), 6) AS logprob FROM x JOIN n3 USING (a, b, c) JOIN n2o USING (a, b) JOIN n2 USING (b, c) JOIN n1o USING (b) JOIN n1 USING (c), tt GROUP BY word""",
    "paradigm_forms": f"""WITH {_SENSES}, p AS (SELECT DISTINCT kz, pos FROM sense) SELECT kz, pos, 'PL' AS tags, {_PL} AS form FROM p WHERE pos = 'NOUN'
UNION ALL SELECT kz, pos, t, {_V('kz')} || f FROM p JOIN (VALUES ('VERB', 'PST', 'ad'), ('VERB', 'PROG', 'en'), ('ADJ', 'CMP', 'ar'), ('ADJ', 'ADV', 'ul')) v(pos, t, f) USING (pos)""",
    "suffixed_words": f"SELECT DISTINCT kz, kz || {_coda('ki')} AS agt, kz || {_coda('rak')} AS like, {_PL} AS pl, {_V('kz')} || 'a' AS poss FROM lexicon".replace(" AS like", ' AS "like"'),
    "sense_lookup": f"WITH {_SENSES} SELECT lemma, pos, min(kz) AS kz FROM sense WHERE lemma <> '' AND pos IN ('NOUN', 'VERB', 'ADJ', 'ADV', 'INTJ') GROUP BY ALL",
    "lexicon_collisions": f"WITH {_SENSES} SELECT 'spelling' AS rule, kz FROM (SELECT kz FROM lexicon UNION ALL SELECT kz FROM function_words) GROUP BY kz HAVING count(*) > 1 UNION SELECT 'sense', array_to_string(list_sort(list(DISTINCT kz)), ', ') FROM sense GROUP BY lemma, pos HAVING count(DISTINCT kz) > 1",
}
