"""SQL (DuckDB) for the queries that SQL can express; the others are held against plain versions in tests/llm."""

from __future__ import annotations

from meshlark.llm import mixing, quality

_WORD = r"[^\x20\x09-\x0D]+"
_DOCS = f"d AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents)"

OP3 = f"""WITH {_DOCS},
sized AS (SELECT rid, doc_id, coalesce(source, '') AS src, source IS NULL AS src_null, CAST(len(w) AS BIGINT) AS size,
  -ln((CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || t), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
  / (1.0 / (1.0 + 20.0 * (length(t) - length(regexp_replace(t, '[#*$%&|<>!]+', '', 'g'))) / greatest(length(t), 1))) AS key FROM d),
per AS (SELECT src_null, src, CAST(sum(size) AS BIGINT) AS source_size,
  CAST([{", ".join(map(str, mixing.WEIGHTS))}][CAST((row_number() OVER (ORDER BY src_null, src) - 1) % {len(mixing.WEIGHTS)} + 1 AS INTEGER)] AS DOUBLE) AS weight FROM sized GROUP BY 1, 2),
caps AS (SELECT *, {float(mixing.MOST_EPOCHS)} * source_size AS cap FROM per),
filled AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
  sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS left_weight, coalesce(sum(cap) OVER before, 0) AS capped
  FROM caps WINDOW before AS (ORDER BY cap / weight, src_null, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT (total - capped) / left_weight AS level FROM filled WHERE (total - capped) / left_weight * weight <= cap ORDER BY capped, level LIMIT 1),
targets AS (SELECT src_null, src, source_size, least(cap, coalesce((SELECT level FROM level) * weight, cap)) AS target FROM filled),
placed AS (SELECT s.*, x.source_size, x.target, CASE WHEN x.source_size > 0 THEN floor(x.target / x.source_size) ELSE 0 END AS epochs,
  sum(s.size) OVER (PARTITION BY s.src_null, s.src ORDER BY s.key, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS prefix
  FROM sized s JOIN targets x ON s.src_null = x.src_null AND s.src = x.src)
SELECT doc_id, size, source_size, target,
  CAST((epochs + CASE WHEN prefix + size / 2.0 <= target - epochs * source_size AND epochs < {mixing.MOST_EPOCHS} THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM placed"""

_COMMON = list(dict.fromkeys(" ".join(quality.COMMON_WORDS).split()))
_CLASSES = ", ".join(f"length(regexp_replace(t, '{keep.replace(chr(39), chr(39) * 2)}', '', 'g'))" for keep in quality.CLASSES.values())


def _distance(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of counts; null if either is empty."""
    half = lambda x, m: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / {m}) ELSE 0 END"
    a, b = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
    terms = f"list_transform(range(1, len({p}) + 1), lambda i: {half(a, f'(({a} + {b}) / 2)')} + {half(b, f'(({a} + {b}) / 2)')})"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(list_sum({terms}) / 2, 0)) END"


OP4 = f"""WITH {_DOCS},
starts AS (SELECT rid, i, md5(array_to_string(w[i : i + {quality.WINDOW - 1}], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM d)),
again AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS next FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, h) AS n FROM starts) WHERE n > 1),
repeated AS (SELECT rid, CAST(sum(least(coalesce(next - i, {quality.WINDOW}), {quality.WINDOW})) AS BIGINT) AS n FROM again GROUP BY rid),
base AS (SELECT d.rid, doc_id, coalesce(lang, '') AS lang, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(r.n, 0) AS n_repeat_words, regexp_extract_all(lower(t), '\\p{{L}}+') AS tokens
  FROM d LEFT JOIN repeated r ON d.rid = r.rid),
judged AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  CAST([{_CLASSES}] AS DOUBLE[]) AS listed, CAST(list_transform({_COMMON}, lambda x: len(list_filter(tokens, lambda y: y = x))) AS DOUBLE[]) AS hits FROM base),
counted AS (SELECT *, list_append(listed, length(t) - list_sum(listed)) AS classes, list_append(hits, len(tokens) - list_sum(hits)) AS common FROM judged),
good AS (SELECT * FROM counted WHERE NOT base_failed AND {quality.REFERENCE_SYMBOLS} * n_symbols <= word_chars),
refs AS (SELECT lang, [{", ".join(f"sum(classes[{k + 1}])" for k in range(len(quality.CLASSES) + 1))}] AS ref_classes, [{", ".join(f"sum(common[{k + 1}])" for k in range(len(_COMMON) + 1))}] AS ref_common FROM good GROUP BY lang),
far AS (SELECT c.*, CASE WHEN length(t) >= {quality.MIN_CHARS} THEN {_distance("classes", "ref_classes")} END AS chars_distance,
  CASE WHEN n_words >= {quality.MIN_WORDS} THEN {_distance("common", "ref_common")} END AS words_distance FROM counted c LEFT JOIN refs r ON c.lang = r.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(chars_distance, 0) > {quality.CHARS_FROM} OR coalesce(words_distance, 0) > {quality.WORDS_FROM}) AS kept FROM far"""

OP8 = f"""WITH {_DOCS},
starts AS (SELECT rid, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS n FROM starts) WHERE n > 1),
gone AS (SELECT DISTINCT rid, i + k AS i FROM again, range(35) r(k)),
kept AS (SELECT x.rid, string_agg(x.word, ' ' ORDER BY x.i) AS t FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) x ANTI JOIN gone g ON x.rid = g.rid AND x.i = g.i GROUP BY x.rid),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.rid = n.rid LEFT JOIN kept ON d.rid = kept.rid"""

OP9 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""

SQL = {"op3_mix_sources": OP3, "op4_quality_rules": OP4, "op8_recurring_words": OP8, "op9_exact_top_k": OP9}
