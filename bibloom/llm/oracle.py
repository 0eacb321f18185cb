"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from bibloom.plans import sqltext as X

_KEYED = f"SELECT row_id, 's:' || {X.issn('issn')} AS key FROM journals UNION SELECT row_id, 's:' || {X.issn('eissn')} FROM journals UNION SELECT row_id, 'n:' || journal_key FROM journals WHERE journal_key <> ''"
_WALK = "walk AS (SELECT DISTINCT u, u AS r FROM edge UNION SELECT w.u, e.v FROM walk w JOIN edge e ON e.u = w.r)"
#: Rows of journals with the least row of their group and its size.
_GROUPS = f"""WITH RECURSIVE held AS (SELECT * FROM ({_KEYED}) WHERE key IS NOT NULL), hub AS (SELECT key, min(row_id) AS hub FROM held GROUP BY 1), link AS (SELECT DISTINCT row_id AS u, hub AS v FROM held JOIN hub USING (key)), edge AS (SELECT u, v FROM link UNION SELECT v, u FROM link), {_WALK}, grouped AS (SELECT u AS row_id, min(r) AS group_id, count(*) AS n FROM walk GROUP BY 1) """


def _plain(x: str) -> str:
    """Letters, digits and ideographs in half width and lower case; signs that stand for several letters are spelled out."""
    for sign, letters in (("ⅰ", "i"), ("ⅱ", "ii"), ("ⅲ", "iii"), ("ⅳ", "iv"), ("ⅴ", "v"), ("ⅵ", "vi"), ("Ⅲ", "III"), ("Ⅱ", "II"), ("Ⅰ", "I"), ("Ⅳ", "IV"), ("Ⅵ", "VI"), ("Ⅴ", "V"), ("℃", "C")):
        x = f"replace({x}, '{sign}', '{letters}')"
    return f"regexp_replace(lower({X.narrow(x)}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


_HAN = "length(regexp_replace({}, '[^㐀-䶿一-鿿豈-﫿]', '', 'g'))"
_LATIN = "length(regexp_replace({}, '[^A-Za-zＡ-Ｚａ-ｚ]', '', 'g'))"
#: Titles cut at each sign that may part two forms; an English form that stands first goes behind the Chinese one.
_TITLES = f"""WITH parts AS (SELECT rec_id, title, pub_year, string_split_regex(title, '[|｜=＝;；/／]') AS p FROM chinese_records WHERE pub_year IS NOT NULL AND title IS NOT NULL),
cuts AS (SELECT rec_id, i, array_to_string(p[:i], '') AS a, array_to_string(p[i+1:], '') AS b FROM (SELECT rec_id, p, unnest(range(1, len(p))) AS i FROM parts)),
judged AS (SELECT rec_id, i, a, b, CASE WHEN {_HAN.format('a')} >= 4 AND {_LATIN.format('b')} >= 12 AND {_HAN.format('b')} <= 2 THEN {_HAN.format('a')} + {_LATIN.format('b')} ELSE 0 END AS first_, CASE WHEN {_HAN.format('b')} >= 4 AND {_LATIN.format('a')} >= 12 AND {_HAN.format('a')} <= 2 THEN {_HAN.format('b')} + {_LATIN.format('a')} ELSE 0 END AS second FROM cuts),
best AS (SELECT rec_id, arg_max(CASE WHEN second > first_ THEN b || a END, (greatest(first_, second), -i)) AS turned FROM judged WHERE greatest(first_, second) > 0 GROUP BY 1),
keyed AS (SELECT rec_id, pub_year, {_plain('coalesce(turned, title)')} AS key FROM parts LEFT JOIN best USING (rec_id)),
copies AS (SELECT rec_id, min(rec_id) OVER (PARTITION BY pub_year, key) AS group_id, count(*) OVER (PARTITION BY pub_year, key) AS n FROM keyed WHERE key <> '')
"""

_WORDS = "string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
#: Runs of 30 characters or 16 words of each passage, found by their first 16 characters.
_LEAKS = f"""WITH items AS (SELECT item_id, {_plain('passage')} AS f, {_WORDS.format(X.narrow('passage'))} AS w, lang = 'zh' OR lang IS DISTINCT FROM 'en' AND {_HAN.format('passage')} * 2 > length({_plain('passage')}) AS zh FROM eval_items),
runs AS (SELECT DISTINCT item_id, run FROM (SELECT item_id, f[i:i+29] AS run FROM (SELECT item_id, f, unnest(range(1, length(f) - 28)) AS i FROM items WHERE zh) UNION ALL SELECT item_id, array_to_string(w[i:i+15], '') FROM (SELECT item_id, w, unnest(range(1, len(w) - 14)) AS i FROM items WHERE NOT zh))),
texts AS (SELECT doc_id, {_plain('text')} AS f FROM documents WHERE text IS NOT NULL), places AS (SELECT doc_id, f, i, f[i:i+15] AS head FROM (SELECT doc_id, f, unnest(range(1, length(f) - 14)) AS i FROM texts))
SELECT DISTINCT doc_id, item_id FROM places JOIN runs ON head = run[1:16] WHERE f[i:i+length(run)-1] = run"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _GROUPS + "SELECT group_id, row_id FROM grouped WHERE n > 1",
        "p3_row_groups": _GROUPS + "SELECT row_id, group_id FROM grouped",
        "p4_found": _TITLES + "SELECT group_id, rec_id FROM copies WHERE n > 1",
        "p4_collapsed": _TITLES + """SELECT r.rec_id, r.title, r.pub_year, coalesce(n, 1) AS n_copies FROM chinese_records r LEFT JOIN copies c ON c.rec_id = r.rec_id WHERE c.rec_id IS NULL OR c.group_id = r.rec_id""",
        "p8_found": _LEAKS,
        "p10_rebuilt": "SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL",
        "p3_deep": """WITH RECURSIVE v AS (SELECT o_orderkey * 8 + j AS v FROM orders, range(8) t(j)), edge AS (SELECT v AS c, v * 2 // 3 AS p FROM v), down AS (SELECT c FROM edge WHERE p = 0 UNION SELECT e.c FROM down d JOIN edge e ON e.p = d.c),
            deep AS (SELECT 2 * c AS u FROM down UNION SELECT 0) SELECT u, 0::bigint AS label FROM deep UNION ALL SELECT 2 * v + 1, 2 * (v - v % 10) + 1 FROM (SELECT v FROM v UNION SELECT v - v % 10 FROM v)""",
    }
