"""SQL of the queries that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

from lexspan.llm.repetition import BASE_WINDOW, BASE_WORDS, LIMITS, LINE_LIMIT
from lexspan.llm.url_templates import OP5_SQL

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _words(text: str) -> str:
    return _SPLIT.format(text)


def _shingles(source: str, key: str, words: str = "w") -> str:
    """Distinct five-word shingles of the word lists of a source; fewer words are one shingle."""
    return f"SELECT DISTINCT {key}, array_to_string({words}[i : i + 4], ' ') AS g FROM {source}, unnest(range(1, greatest(len({words}) - 3, 2))) t(i) WHERE len({words}) > 0"


OP2 = f"""WITH d AS (SELECT doc_id, {_words(_LOW)} AS w FROM documents), b AS (SELECT item_id, {_words(_LOW)} AS w FROM benchmark),
dg AS ({_shingles('d', 'doc_id')}), bg AS ({_shingles('b', 'item_id')}), n AS (SELECT item_id, count(*) AS n_item FROM bg GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS n_shared FROM dg JOIN bg USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared::DOUBLE / n_item AS containment FROM s JOIN n USING (item_id) WHERE n_shared >= 0.75::DOUBLE * n_item"""


def _cover(k: int) -> str:
    """Characters inside k-word windows that the text has had before, by document."""
    return f"""g{k} AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1 AS again
  FROM (SELECT doc_id, i, array_to_string(w[i : i + {k - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {k - 2})) t(i))),
v{k} AS (SELECT doc_id, sum(length(w[p])) AS v{k} FROM (SELECT DISTINCT doc_id, i + o AS p FROM g{k}, unnest(range(0, {k})) t(o) WHERE again) JOIN d USING (doc_id) GROUP BY doc_id)"""


OP3 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS w FROM documents),
base AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols FROM d),
l AS (SELECT doc_id, n, string_split(text, chr(10))[n] AS line FROM d, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(n)),
la AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY n) > 1 AS again FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
ld AS (SELECT doc_id, count(*) AS n_dup_lines, sum(list_sum(list_transform({_words('line')}, lambda x: length(x)))) AS dup_chars FROM la WHERE again GROUP BY doc_id),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS twice
  FROM (SELECT doc_id, i, array_to_string(w[i : i + {BASE_WINDOW - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {BASE_WINDOW - 2})) t(i))),
rw AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM r, unnest(range(0, {BASE_WINDOW})) t(o) WHERE twice GROUP BY doc_id),
{", ".join(map(_cover, LIMITS))},
x AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(dup_chars, 0)::DOUBLE / greatest(word_chars, 1) AS line_cover, {", ".join(f"coalesce(v{k}, 0)::DOUBLE / greatest(word_chars, 1) AS cover_{k}" for k in LIMITS)},
  n_words < {BASE_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM base LEFT JOIN ld USING (doc_id) LEFT JOIN rw USING (doc_id) {" ".join(f"LEFT JOIN v{k} USING (doc_id)" for k in LIMITS)})
SELECT *, NOT base_failed AND line_cover <= {LINE_LIMIT}::DOUBLE {" ".join(f"AND cover_{k} <= {m}::DOUBLE" for k, m in LIMITS.items())} AS kept FROM x"""

OP8 = f"""WITH l AS (SELECT doc_id, n - 1 AS line_no, trim(lower(string_split(text, chr(10))[n]), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(n)),
p AS (SELECT * FROM l WHERE line <> ''),
f AS (SELECT line, min((doc_id, line_no)) AS first, regexp_split_to_array(line, '[\\x20\\x09\\x0B\\x0C\\x0D]+') AS w FROM p GROUP BY line),
g AS (SELECT DISTINCT line, unnest(w) AS g FROM f), n AS (SELECT line, count(*) AS n FROM g GROUP BY line),
k AS (SELECT a.line AS a, b.line AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.line <> b.line GROUP BY ALL),
e AS (SELECT a, min(first) AS linked FROM k JOIN n x ON x.line = a JOIN n y ON y.line = b JOIN f ON f.line = b WHERE 4 * k >= 3 * (x.n + y.n - k) GROUP BY a),
t AS (SELECT line, CASE WHEN linked < first THEN linked ELSE first END AS first FROM f LEFT JOIN e ON a = line),
gone AS (SELECT doc_id, line_no, first[1] AS first_doc FROM p JOIN t USING (line) WHERE (doc_id, line_no) > first),
c AS (SELECT doc_id, count(*) AS n_removed, count(DISTINCT first_doc) AS n_first_docs, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(m.n, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_first_docs, 0) AS n_first_docs, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id) m ON m.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id"""

OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOW)} AS w FROM documents), g AS ({_shingles('d', 'doc_id')}),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""

ORACLES = {"op2_benchmark_containment": OP2, "op3_repetition_coverage": OP3, "op5_url_templates": OP5_SQL, "op8_line_dedup": OP8, "op10_lsh_forest": OP10}
