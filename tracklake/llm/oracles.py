"""SQL for the queries that SQL can express, over whole tables, in DuckDB's dialect."""

from __future__ import annotations

_SPACE = r"'[\x20\x09-\x0D]+'"
_WORDS = f"list_filter(string_split_regex({{}}, {_SPACE}), lambda x: x <> '')"
_COMPONENTS = """
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
least AS (SELECT a, min(b) AS low FROM reach GROUP BY a)"""

LINES = r"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS rows, length(text) - length(translate(text, ' ' || chr(10), '')) + 1 AS n FROM documents),
each AS (SELECT doc_id, text, n, trim(unnest(rows), ' ') AS line, unnest(range(len(rows))) AS place FROM docs WHERE text IS NOT NULL),
cut AS (SELECT *, string_split(line, ' ') AS words, list_transform(string_split(line, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS masked
    FROM each WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lines AS (SELECT *, len(masked) AS k, list_slice(masked, 1, 3) AS head, len(list_filter(masked, lambda t: t <> '<*>')) AS own, len(list_filter(list_slice(masked, 1, 3), lambda t: t <> '<*>')) AS led FROM cut),
kinds AS (SELECT DISTINCT masked, k, head, own, led FROM lines WHERE own > 0),
held AS (SELECT k, head, pos, token, count(*) AS times FROM (SELECT k, head, unnest(masked) AS token, unnest(range(len(masked))) AS pos FROM lines) WHERE pos >= 3 AND token <> '<*>' GROUP BY ALL),
spread AS (SELECT masked, k, head, own, led, unnest(masked) AS token, unnest(range(len(masked))) AS pos FROM kinds),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY masked ORDER BY times DESC, s.pos) AS rank FROM spread s JOIN held h ON s.k = h.k AND s.head = h.head AND s.pos = h.pos AND s.token = h.token),
chosen AS (SELECT masked, list((pos, token) ORDER BY pos) AS picked FROM ranked WHERE rank <= greatest(ceil(k * 0.6::double), least(k, 4)) - led GROUP BY masked),
shapes AS (SELECT ki.masked, ki.k, ki.head, ki.own, ki.led + coalesce(len(picked), 0) AS constants, picked FROM kinds ki LEFT JOIN chosen c ON ki.masked = c.masked),
seen AS (SELECT l.doc_id, l.text, l.n, l.place, l.line, l.words, l.masked, s.own, s.constants, (s.k, s.head, s.picked)::varchar AS template FROM lines l JOIN shapes s ON l.masked = s.masked),
common AS (SELECT template AS grp, min((doc_id, place)) AS spot FROM seen GROUP BY template HAVING count(DISTINCT text) >= greatest(5, 1 + ceil(24.0::double / min(constants)))),
alone AS (SELECT s.masked::varchar AS grp, min((doc_id, place)) AS spot FROM seen s LEFT JOIN common c ON s.template = c.grp WHERE c.grp IS NULL GROUP BY s.masked HAVING count(DISTINCT text) >= greatest(2, 1 + ceil(24.0::double / min(own)))),
found AS (SELECT s.*, c.grp, c.spot FROM seen s JOIN common c ON s.template = c.grp UNION ALL SELECT s.*, a.grp, a.spot FROM seen s JOIN alone a ON s.masked::varchar = a.grp WHERE s.template NOT IN (SELECT grp FROM common)),
one AS (SELECT grp, text AS text1, place AS place1, n AS n1, words AS words1 FROM found WHERE (doc_id, place) = spot),
marked AS (SELECT f.*, o.text1, o.n1, o.words1, f.text = o.text1 AND f.place = o.place1 AS stays FROM found f JOIN one o ON f.grp = o.grp),
near AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, n, n1, sum(len(words)) AS total, sum(len(list_filter(list_zip(words, words1), lambda x: x[1] = x[2]))) AS same FROM marked WHERE text <> text1 GROUP BY doc_id, n, text1, n1)
    WHERE 2 * total >= greatest(n, n1) AND same >= 0.95::double * total),
per AS (SELECT doc_id, count(DISTINCT place) AS recurring, list(DISTINCT place) FILTER (WHERE NOT stays) AS dropped FROM marked GROUP BY doc_id),
j AS (SELECT d.doc_id, d.text, rows, coalesce(recurring, 0) AS recurring, CASE WHEN d.doc_id IN (SELECT doc_id FROM near) THEN [] ELSE coalesce(dropped, []) END AS gone,
    coalesce(len(list_filter(rows, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))), 0) AS n FROM docs d LEFT JOIN per p ON d.doc_id = p.doc_id)
SELECT doc_id, n::bigint AS n_lines, recurring::bigint AS n_recurring, len(gone)::bigint AS n_dropped,
    CASE WHEN len(gone) = 0 THEN text ELSE array_to_string(list_transform(list_filter(range(len(rows)), lambda i: NOT list_contains(gone, i)), lambda i: rows[i + 1]), chr(10)) END AS text FROM j"""


def _quality() -> str:
    # signal, count, size, what one occurrence counts for: stated here anew, as are all constants below
    signals = (("symbols", "n_symbols", "n_words", 1), ("lines", "n_dup_lines", "n_lines", 1), ("repeats", "n_repeat_words", "n_words", 6), ("upper", "n_upper", "word_chars", 1), ("length", "word_chars", "n_words", 1))
    rows = " UNION ALL ".join(f"SELECT lang, source, '{s}' AS signal, CASE WHEN {b} > 0 THEN {a}::double / {b} ELSE 0.0::double END AS x FROM ok" for s, a, b, _ in signals)
    rows += "".join(f" UNION ALL SELECT lang, source, '{c}', {c}::double FROM ok" for c in ("n_words", "n_lines", "word_chars"))
    unit = "CASE r.signal " + " ".join(f"WHEN '{s}' THEN {u}.0::double / (SELECT any_value(m.median) FROM mid m WHERE m.level = r.level AND m.lang IS NOT DISTINCT FROM r.lang AND m.source IS NOT DISTINCT FROM r.source AND m.signal = '{b}')" for s, _, b, u in signals) + " END"
    over = "coalesce(bool_or(CASE signal " + " ".join(f"WHEN '{s}' THEN {a} > fence * {b} + {2 * u}.0::double" for s, a, b, u in signals) + " END), false)"
    names = ", ".join(f"'{s[0]}'" for s in signals)
    failed = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w, string_split(coalesce(text, ''), chr(10)) AS rows FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
t3 AS (SELECT doc_id, pos, word AS a, lead(word) OVER w AS b, lead(word, 2) OVER w AS c FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
again AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t3 WHERE c IS NOT NULL),
covered AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(rows) AS line, unnest(range(len(rows))) AS pos FROM d),
lines AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE k > 1) AS dup FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS k FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) GROUP BY doc_id),
c AS (SELECT d.doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
    FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN lines ON d.doc_id = lines.doc_id),
ok AS (SELECT * FROM c WHERE NOT {failed}),
x AS ({rows}),
leveled AS (SELECT 0 AS level, lang, source, signal, x FROM x UNION ALL SELECT 1, lang, NULL, signal, x FROM x UNION ALL SELECT 2, NULL, NULL, signal, x FROM x),
b AS (SELECT level, lang, source, signal, CASE WHEN x <= 0.000001::double THEN 0 ELSE ceil(ln(x * 1000000.0::double) / ln(1.02::double))::int END AS bucket, count(*) AS n FROM leveled GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, signal)::bigint AS total, sum(n) OVER (PARTITION BY level, lang, source, signal ORDER BY bucket ROWS UNBOUNDED PRECEDING)::bigint AS upto,
    CASE WHEN bucket = 0 THEN 0.0::double ELSE pow(1.02::double, bucket - 0.5::double) / 1000000.0::double END AS v FROM b),
mid AS (SELECT level, lang, source, signal, min(v) FILTER (WHERE 2 * upto >= total) AS median FROM r GROUP BY ALL),
stops AS (SELECT r.*, m.median, {unit} AS unit FROM r JOIN mid m ON r.level = m.level AND r.lang IS NOT DISTINCT FROM m.lang AND r.source IS NOT DISTINCT FROM m.source AND r.signal = m.signal
    WHERE r.signal IN ({names}) AND v >= m.median AND 200 * upto // total > 200 * (upto - n) // total AND 200 * (upto - n) // total < 199),
reached AS (SELECT *, median + 2.0::double * (v - median + unit + v * (1.02::double - 1.0::double)) AS reach, lead(v) OVER (PARTITION BY level, lang, source, signal ORDER BY bucket) AS next FROM stops),
own AS (SELECT level, lang, source, signal, max(total) AS n, min(reach) AS f FROM reached WHERE next IS NULL OR next > reach GROUP BY ALL),
fence AS (SELECT g.lang, g.source, g.signal, (g.n * g.f + 20 * ((l.n * l.f + 20 * a.f) / (l.n + 20))) / (g.n + 20) AS fence FROM own g JOIN own l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM g.lang AND l.signal = g.signal
    JOIN own a ON a.level = 2 AND a.signal = g.signal WHERE g.level = 0),
v AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, {over} AS far
    FROM c LEFT JOIN fence f ON c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND NOT far AS kept FROM v"""


NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM meet JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
sym AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), {_COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN least ON d.doc_id = least.a"""

VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::double[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
sym AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9::double), {_COMPONENTS},
n AS (SELECT a, count(*) AS n FROM sym GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN least ON vec_id = least.a"""


#: A plain reading of pages whose article is one element of h1 and p, as the driver's are.
PAGES = r"""
WITH body AS (SELECT page_id, url, replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' ') AS body FROM pages),
bare AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS parts FROM body),
plain AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM bare),
made AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM plain)
SELECT page_id, url, text, length(text) AS n_chars FROM made"""


def oracle_sql() -> dict[str, str]:
    return {"op1_html_extraction": PAGES, "op2_line_dedup": LINES, "op3_quality_rules": _quality(), "op4_minhash": NEAR, "op5_embedding_dedup": VECTORS}
