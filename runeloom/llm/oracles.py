"""DuckDB SQL of those queries pN_... that SQL can tell, by the plainest definition."""

from __future__ import annotations

import unicodedata

from runeloom.llm.visual_form import mappings

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')".format
_CANON = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')".format

P4 = f"""WITH t AS (SELECT 'parallel_records' AS table_name, ordinal AS no, {_CANON('en')} AS c FROM parallel_records
UNION ALL SELECT 'shard_lines', line_no, {_CANON("(CASE WHEN json_valid(line) THEN line ->> '$.en' END)")} FROM shard_lines),
g AS (SELECT *, min(no) OVER (PARTITION BY table_name, c) AS first_no FROM t WHERE c <> '')
"""

P6 = f"""WITH w AS (SELECT ordinal, unnest({WORDS('kz')}) AS term FROM parallel_records),
k AS (SELECT 'kz' AS field_name, term, count(*) AS occurrences, count(DISTINCT ordinal) AS records FROM w GROUP BY term),
e AS (SELECT DISTINCT 'loan_words' AS field_name, ordinal, unnest(map_entries(loan_words)) AS e FROM text_stats
  UNION ALL SELECT DISTINCT 'unknown_words', ordinal, unnest(map_entries(unknown_words)) FROM text_stats),
s AS (SELECT field_name, lower(trim(e.key)) AS term, sum(e.value)::BIGINT AS occurrences, count(DISTINCT ordinal) AS records FROM e GROUP BY ALL),
n AS (SELECT 'kz' AS field_name, count(kz) AS total FROM parallel_records UNION ALL SELECT f, count(DISTINCT ordinal) FROM text_stats, (VALUES ('loan_words'), ('unknown_words')) v(f) GROUP BY f),
r AS (SELECT field_name, term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.1 * total THEN 'common' END AS mark FROM (FROM k UNION ALL FROM s) JOIN n USING (field_name) WHERE term <> '')
"""

#: Pairs (a, b), a < b, of records that are alike in a field.
ALIKE = f"""w AS (SELECT ordinal, split, 'en' AS f, {WORDS('en')} AS w FROM parallel_records UNION ALL SELECT ordinal, split, 'kz', {WORDS('kz')} FROM parallel_records),
s AS (SELECT ordinal, split, f, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 8),
x AS (SELECT ordinal, split, f, len(s) AS n, unnest(s) AS g FROM s),
alike AS (SELECT DISTINCT a.ordinal AS a, b.ordinal AS b, any_value(a.split) AS sa, any_value(b.split) AS sb FROM x a JOIN x b ON a.f = b.f AND a.g = b.g AND a.ordinal < b.ordinal
  GROUP BY a.f, a.ordinal, b.ordinal HAVING count(*) * 5 >= 3 * (any_value(a.n) + any_value(b.n) - count(*)))"""


def form_sql(text: str) -> str:
    """The form of a text: characters replaced one for one, dropped, or one for several, then composed."""
    ours = {c: unicodedata.normalize("NFC", f) for c, f in mappings() if unicodedata.normalize("NFC", f) != unicodedata.normalize("NFC", c)}
    one = {c: f for c, f in ours.items() if len(f) == 1}
    gone = [c for c, f in ours.items() if not f]
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"translate({text}, {quoted(''.join(one) + ''.join(gone))}, {quoted(''.join(one.values()))})"
    for c, f in ours.items():
        if len(f) > 1:
            out = f"replace({out}, {quoted(c)}, {quoted(f)})"
    return f"nfc_normalize({out})"


ORACLES: dict[str, str] = {
    "p2_found": f"""WITH RECURSIVE {ALIKE}, e AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
r AS (SELECT DISTINCT a AS node, a AS to_ FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.to_)
SELECT min(to_) AS group_ordinal, node AS ordinal FROM r GROUP BY node HAVING min(to_) < node""",
    "p3_found": f"""WITH t AS (SELECT ordinal, en, {form_sql('en')} AS form FROM parallel_records WHERE NOT regexp_matches(en, '^[\\s\\p{{Z}}]*$'))
SELECT a.ordinal AS ordinal_a, b.ordinal AS ordinal_b FROM t a JOIN t b ON a.form = b.form AND a.ordinal < b.ordinal AND a.en <> b.en""",
    "p4_found": P4 + "SELECT table_name, first_no, no AS copy_no FROM g WHERE no > first_no",
    "p4_counts": P4 + "SELECT table_name, first_no, count(*) AS copies, false AS collided FROM g GROUP BY ALL",
    "p5_found": f"WITH {ALIKE} SELECT DISTINCT a AS ordinal_a, b AS ordinal_b FROM alike WHERE (sa = 'train' AND sb IN ('val', 'test')) OR (sb = 'train' AND sa IN ('val', 'test'))",
    "p5_report": f"""WITH {ALIKE.split('alike AS')[0].rstrip().rstrip(',')}, y AS (SELECT a.ordinal AS t, b.ordinal AS e, count(*) AS shared, any_value(a.n) + any_value(b.n) - count(*) AS either FROM x a JOIN x b ON a.f = b.f AND a.g = b.g AND a.split = 'train' AND b.split IN ('val', 'test') GROUP BY a.f, a.ordinal, b.ordinal),
z AS (SELECT e, max(shared / either) AS best, count(DISTINCT t) AS n FROM y WHERE shared * 5 >= 3 * either GROUP BY e)
SELECT split, source, count(*) AS records, count(n) AS in_train, count(*) FILTER (best = 1) AS exact, coalesce(sum(n), 0)::BIGINT AS pairs FROM parallel_records LEFT JOIN z ON e = ordinal WHERE split IN ('val', 'test') GROUP BY ALL""",
    "p6_found": P6 + "SELECT field_name, term, mark FROM r WHERE mark IS NOT NULL",
    "p6_terms": P6 + "FROM r",
    "p7_checks": "SELECT limit_name, capacity::BIGINT AS capacity, count(*) AS documents, count(*) FILTER (coalesce(text, '') = '') AS without_tokens, 0::BIGINT AS cut_needlessly, 0::BIGINT AS over_tokens, 0::BIGINT AS over_documents, 0::BIGINT AS over_cost FROM documents, size_limits GROUP BY ALL",
    "p8_found": f"""WITH i AS (SELECT item_id, {WORDS('text')} AS w, least(12, len(w)) AS n FROM eval_items),
ig AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM i WHERE n > 0)),
d AS (SELECT doc_id, n, {WORDS('text')} AS w FROM documents, (SELECT DISTINCT n FROM i WHERE n > 0)),
dg AS (SELECT DISTINCT doc_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (n, g)""",
    # texts laid over each other at every shift at which 9 words are equal (all of a shorter item); of each overlay the longest run of equal words and the stretch of the best score
    "p8_report": f"""WITH i AS (SELECT item_id, {WORDS('text')} AS w FROM eval_items), d AS (SELECT doc_id, {WORDS('text')} AS w FROM documents),
iw AS (SELECT item_id, least(len(w), 12) AS need, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS k FROM i), dw AS (SELECT doc_id, len(w) AS m, unnest(w) AS x, unnest(range(len(w))) AS k FROM d),
o AS (SELECT doc_id, item_id, dw.k - iw.k AS shift, any_value(need) AS need, any_value(n) AS n, any_value(m) AS m FROM dw JOIN iw USING (x) GROUP BY ALL HAVING count(*) >= least(9, any_value(n))),
c AS (SELECT *, unnest(range(greatest(0, shift), least(m, n + shift))) AS k FROM o),
e AS (SELECT c.*, (dw.x = iw.x)::INT AS eq FROM c JOIN dw ON dw.doc_id = c.doc_id AND dw.k = c.k JOIN iw ON iw.item_id = c.item_id AND iw.k = c.k - shift),
s AS (SELECT *, 3 * eq - 2 AS v, sum(3 * eq - 2) OVER v AS total, sum(1 - eq) OVER v AS island, sum(eq) OVER v AS ones FROM e WINDOW v AS (PARTITION BY doc_id, item_id, shift ORDER BY k)),
l AS (SELECT *, total - v AS before, min(total - v) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k) AS low FROM s),
t AS (SELECT doc_id, item_id, shift, min(k) AS stop, arg_min(low, k) AS low, arg_min(ones, k) AS ones, any_value(best) AS best FROM (SELECT *, max(total - low) OVER (PARTITION BY doc_id, item_id, shift) AS best FROM l) WHERE total - low = best GROUP BY ALL),
b AS (SELECT doc_id, item_id, shift, stop + 1 - min(k) AS span, any_value(t.ones) - arg_min(l.ones - eq, k) AS equal FROM l JOIN t USING (doc_id, item_id, shift) WHERE before = t.low AND best > 0 GROUP BY doc_id, item_id, shift, stop),
r AS (SELECT doc_id, item_id, shift, any_value(need) AS need, max(c) AS run FROM (SELECT doc_id, item_id, shift, any_value(need) AS need, sum(eq) AS c FROM s GROUP BY doc_id, item_id, shift, island) GROUP BY doc_id, item_id, shift),
p AS (SELECT doc_id, item_id, bool_or(run >= need) AS exact, bool_or(span >= 12 AND equal * 4 >= span * 3) AS near, coalesce(max(equal) FILTER (span >= 12 AND equal * 4 >= span * 3), max(equal)) AS equal FROM r JOIN b USING (doc_id, item_id, shift) GROUP BY ALL),
q AS (SELECT item_id, count(*) FILTER (exact) AS exact_docs, count(*) AS docs, max(equal) AS most_words FROM p WHERE exact OR near GROUP BY ALL)
SELECT item_id, suite, split, coalesce(exact_docs, 0) AS exact_docs, coalesce(docs, 0) AS docs, coalesce(most_words, 0)::BIGINT AS most_words FROM eval_items LEFT JOIN q USING (item_id)""",
}
