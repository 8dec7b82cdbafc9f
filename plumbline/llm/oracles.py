"""SQL for DuckDB of the queries that SQL can express over whole tables."""

from __future__ import annotations

from plumbline.llm.quality_rules import CLASSES, COMMON_WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

NGRAM_JOIN = rf"""
WITH RECURSIVE worded AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
texts AS (SELECT text, any_value(w) AS w, min(doc_id) AS rep, count(*) AS copies FROM worded WHERE len(w) > 0 GROUP BY text),
grams AS (SELECT DISTINCT rep, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rep, w, unnest(range(1, len(w) - 3)) AS i FROM texts)),
sizes AS (SELECT rep, count(*) AS n FROM grams GROUP BY rep),
shared AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2),
links AS (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.rep = s.a JOIN sizes y ON y.rep = s.b WHERE 5 * s.n >= 4 * (x.n + y.n - s.n)),
reach AS (SELECT rep AS a, rep AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
linked AS (SELECT t.rep, t.copies, t.copies - 1 + coalesce(sum(o.copies), 0) AS n FROM texts t LEFT JOIN links l ON l.a = t.rep LEFT JOIN texts o ON o.rep = l.b GROUP BY t.rep, t.copies)
SELECT d.doc_id, CASE WHEN len(d.w) > 0 THEN c.class_id ELSE d.doc_id END AS class_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, CAST(coalesce(k.copies, 1) AS BIGINT) AS n_copies
FROM worded d LEFT JOIN texts t ON t.text = d.text LEFT JOIN classes c ON c.rep = t.rep LEFT JOIN linked k ON k.rep = t.rep
"""

HAMMING_SEARCH = """
WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(len(list_filter(range(1, len(q.embedding) + 1), lambda i: (q.embedding[i] > 0) <> (v.embedding[i] > 0))) AS INTEGER) AS distance
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, distance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d) WHERE rank <= 10
"""

#: Each source gives its whole target, of its shuffled documents and, beyond them, of the same again.
MIX_SOURCES = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS key FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2 * source_size AS cap FROM sizes),
ratios AS (SELECT *, row_number() OVER (ORDER BY cap / w::DOUBLE, source NULLS LAST) AS k FROM ranked),
levels AS (SELECT *, ((SELECT sum(source_size) FROM sizes)::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)::DOUBLE) / ((SELECT sum(w) FROM ranked) - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
  FROM ratios WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, CASE WHEN cap / w::DOUBLE < f.level THEN cap::DOUBLE ELSE f.level * w END AS target FROM levels, (SELECT arg_min(level, k) AS level FROM levels WHERE level <= cap / w::DOUBLE) f),
placed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS pos FROM sized)
SELECT doc_id, size, t.source_size, t.target, CAST(greatest(0, least(pos + size, ceil(t.target)::BIGINT) - pos) + greatest(0, least(pos + size + t.source_size, ceil(t.target)::BIGINT) - pos - t.source_size) AS BIGINT) AS taken
FROM placed p JOIN targets t ON t.source IS NOT DISTINCT FROM p.source
"""

LINE_DEDUP = r"""
WITH rows AS (SELECT *, row_number() OVER () AS r FROM documents),
lines AS (SELECT r, doc_id, source, i, l, trim(l, E' \t\x0b\x0c\r') AS line FROM (SELECT r, doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM rows)),
wide AS (SELECT line, min((doc_id, i)) AS first FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce('=' || source, '')) >= 6),
marked AS (SELECT x.*, w.line IS NOT NULL AND (x.doc_id, x.i) <> w.first AS gone FROM lines x LEFT JOIN wide w ON w.line = x.line),
made AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') AS t FROM marked GROUP BY r)
SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE n_lines END::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, length(t)::BIGINT AS n_chars, sha256(t) AS text_sha256
FROM rows d JOIN made USING (r)
"""


def _quality_rules() -> str:
    vocab = "CASE coalesce(lang, '') " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in COMMON_WORDS.items()) + " ELSE []::VARCHAR[] END"
    counts = ", ".join(f"length(t) - length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')) AS c_{c}" for c, p in CLASSES.items())
    js = "sqrt(greatest(list_sum(list_transform(list_zip({a}, {b}), lambda z: j(z[1] / list_sum({a}), z[2] / list_sum({b})))) / 2, 0))"
    js = js.replace("j(z[1] / list_sum({a}), z[2] / list_sum({b}))", "(CASE WHEN z[1] > 0 THEN z[1] / list_sum({a}) * log2(z[1] / list_sum({a}) / ((z[1] / list_sum({a}) + z[2] / list_sum({b})) / 2)) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] / list_sum({b}) * log2(z[2] / list_sum({b}) / ((z[1] / list_sum({a}) + z[2] / list_sum({b})) / 2)) ELSE 0 END)")
    bins = max(map(len, COMMON_WORDS.values())) + 1
    return rf"""
WITH base AS (SELECT *, row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lg, {_WORDS} AS w, {vocab} AS vocab FROM documents),
grams AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM base)),
repeated AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1) GROUP BY r),
counted AS (SELECT *, {counts} FROM base),
f AS (SELECT b.r, doc_id, lg, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, c_symbol::BIGINT AS n_symbols,
  (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(q.n, 0)::BIGINT AS n_repeat_words,
  [length(array_to_string(w, '')) - c_upper - c_digit - c_punct - c_symbol, c_upper, c_digit, c_punct, c_symbol, length(t) - length(array_to_string(w, ''))]::DOUBLE[] AS ch,
  CASE WHEN len(vocab) = 0 THEN []::DOUBLE[] ELSE list_append(list_transform(vocab, lambda v: len(list_filter(w, lambda x: x = v))), len(w) - list_sum(list_transform(vocab, lambda v: len(list_filter(w, lambda x: x = v)))))::DOUBLE[] END AS wh
  FROM counted b LEFT JOIN repeated q ON q.r = b.r),
refs AS (SELECT lg, sum(n_words) AS words, [{", ".join(f"sum(ch[{i + 1}])" for i in range(len(CLASSES) + 2))}] AS rc, [{", ".join(f"coalesce(sum(wh[{i + 1}]), 0)" for i in range(bins))}] AS rw FROM f GROUP BY lg),
far AS (SELECT f.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words >= 50 AND words >= 2000 AS comparable,
  CASE WHEN list_sum(ch) > 0 THEN {js.format(a="ch", b="rc")} ELSE 0 END AS cd,
  CASE WHEN len(wh) > 0 AND list_sum(wh) > 0 THEN {js.format(a="wh", b="rw")} ELSE 0 END AS wd FROM f JOIN refs USING (lg))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (comparable AND (cd > 0.22 OR wd > 0.27)) AS kept FROM far
"""


CHAT_FORMAT = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (SELECT *, [regexp_replace(x, '([<\[])(\\*)(\|im_start\||\|im_sep\||\|im_end\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') FOR x IN [role, text]] AS e FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(e[1]) + length(e[2]) + length('<|im_start|>') + length('<|im_sep|>') + length('<|im_end|>'))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    """The other queries hash words, merge tokens, cut chunks or rest on a battery of tests: they are tested by brute force."""
    return {
        "op1_ngram_join": NGRAM_JOIN,
        "op3_hamming_search": HAMMING_SEARCH,
        "op4_mix_sources": MIX_SOURCES,
        "op6_line_dedup": LINE_DEDUP,
        "op8_quality_rules": _quality_rules(),
        "op10_chat_format": CHAT_FORMAT,
    }
