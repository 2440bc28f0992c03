"""SQL twins of the text queries that SQL can express."""

from __future__ import annotations

from casekit.llm.licenses import LABEL, LICENCE_WORD, NAME, PATTERNS, REFERENCE, RULES, UNKNOWN, all_names, sentence_table
from casekit.llm.repetition import GRAM_LIMITS, LINE_CHARS_LIMIT, LINE_LIMIT

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = r"[\x20\x09-\x0D]"
_GRAM = {n: f"coalesce(max(chars) FILTER (n = {n}), 0)" for n in GRAM_LIMITS}

REPETITION = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
  w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
  g AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
      FROM w, (SELECT unnest([3, {', '.join(map(str, GRAM_LIMITS))}]) AS n), unnest(range(1, len(ws) - n + 2)) u(i)),
  h AS (SELECT r, n, i FROM (SELECT *, count(*) OVER (PARTITION BY r, n, k) AS c FROM g) WHERE c > 1),
  p AS (SELECT DISTINCT r, n, j FROM h, unnest(range(i, i + n)) v(j)),
  c AS (SELECT r, n, count(*) AS words, sum(length(ws[j])) AS chars FROM p JOIN w USING (r) GROUP BY r, n),
  m AS (SELECT r, coalesce(max(words) FILTER (n = 3), 0) AS n_repeat_words,
      {', '.join(f'{sql} AS g{n}' for n, sql in _GRAM.items())} FROM w LEFT JOIN c USING (r) GROUP BY r),
  l AS (SELECT r, CAST(sum(c - 1) AS BIGINT) AS dup, sum(c * length(regexp_replace(x, '{_SPACE}', '', 'g'))) FILTER (c > 1) AS dup_chars
      FROM (SELECT r, x, count(*) AS c FROM w, unnest(ls) q(x) GROUP BY r, x) GROUP BY r),
  a AS (SELECT *, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(ls) AS n_lines,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines
      FROM w JOIN m USING (r) LEFT JOIN l USING (r))
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
      AND {' AND '.join(f'g{n} <= {limit}::DOUBLE * word_chars' for n, limit in GRAM_LIMITS.items())}
      AND n_dup_lines <= {LINE_LIMIT}::DOUBLE * n_lines AND coalesce(dup_chars, 0) <= {LINE_CHARS_LIMIT}::DOUBLE * word_chars AS kept
  FROM a"""


def _words(source: str, key: str) -> str:
    lowered = f"translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}')"
    return rf"SELECT {key}, regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM {source}"


CONTAMINATION = f"""WITH d AS ({_words('documents', 'row_number() OVER () AS r, doc_id')}),
  b AS ({_words('benchmark', 'CAST(item_id AS VARCHAR) AS item')}),
  bw AS (SELECT DISTINCT item, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS x
      FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) u(i) WHERE len(ws) > 0),
  dw AS (SELECT r, i, k, array_to_string(ws[i:i + k - 1], ' ') AS x FROM d, (SELECT DISTINCT k FROM bw), unnest(range(1, len(ws) - k + 2)) u(i)),
  h AS (SELECT r, i, k, item FROM dw JOIN bw USING (k, x)),
  p AS (SELECT r, count(DISTINCT j) AS n FROM h, unnest(range(i, i + k)) v(j) GROUP BY r),
  s AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
  SELECT doc_id, len(ws) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(s.n, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
  FROM d LEFT JOIN p USING (r) LEFT JOIN s USING (r)"""


def _sentences(source: str) -> str:
    """Normalised sentences of a text column in order."""
    cut = rf"""string_split(regexp_replace({source}, '([.!?;:])["'')\]]*\s+', '\1' || chr(10), 'g'), chr(10))"""
    return rf"list_transform({cut}, lambda s: trim(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _marks(kind: str) -> str:
    """CTE of the identifiers of one kind of sentence list, in order; `?` for a sentence that is not known."""
    patterns = " ".join(f"WHEN regexp_matches(s, {_text(p)}) THEN {'[]' if mark == '+' else f'[{_text(mark)}]'}" for p, mark in PATTERNS)
    return f"""{kind}_marks AS (SELECT r, s, CASE WHEN id IS NOT NULL THEN [id] WHEN s = '' THEN [] WHEN regexp_matches(s, {_text(REFERENCE)})
        THEN list_transform(regexp_extract_all(s, {_text(NAME)}), lambda n: names[n]) {patterns} ELSE ['?'] END AS marks, o
      FROM (SELECT r, unnest({kind}) AS s, generate_subscripts({kind}, 1) AS o FROM cut) LEFT JOIN known USING (s), named),
    {kind}_ids AS (SELECT r, flatten(list(marks ORDER BY o)) AS ids FROM {kind}_marks GROUP BY r)"""


def _found(kind: str) -> str:
    """CTE of the licences of a sequence of identifiers: what a rule matches is taken out before the next one."""
    steps = ["',' || array_to_string(ids, ',') || ',' AS rest_0"]
    for i, (sequence, _) in enumerate(RULES):
        meant = "," + sequence.replace("+", ",") + ","
        steps.append(f"contains(rest_{i}, '{meant}') AS hit_{i}, replace(rest_{i}, '{meant}', ',?,') AS rest_{i + 1}")
    hits = ", ".join(f"CASE WHEN hit_{i} THEN '{licence}' END" for i, (_, licence) in enumerate(RULES))
    return f"""{kind}_found AS (SELECT r, ids, unnest(list_concat([{hits}],
      list_transform(list_filter(ids, lambda i: starts_with(i, 'ref:')), lambda i: substr(i, 5)))) AS licence
      FROM (SELECT *, {', '.join(steps)} FROM {kind}_ids))"""


_KNOWN = ", ".join(f"({_text(s)}, '{i}')" for s, i in sentence_table().items())
_NAMED = ", ".join(f"{_text(n)}: 'ref:{x}'" for n, x in all_names().items())
_BARE = r"(?m)^[ \t]*(?://+|/\*+|\*+/|\*+|#+|;+|--+|<!--|%+|>+|\d+\.|-)[ \t]+"
LICENSES = rf"""WITH known(s, id) AS (VALUES {_KNOWN}), named AS (SELECT MAP {{{_NAMED}}} AS names),
  d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(regexp_replace(text, '{_BARE}', '', 'g'), {_text(LABEL)}, '\1 ', 'g') AS t,
      coalesce(regexp_matches(text, {_text(LICENCE_WORD)}), false) AS speaks FROM documents),
  p AS (SELECT *, replace(regexp_replace(regexp_replace(t, '\n\s*\n', chr(1), 'g'), '[ \t]*\r?\n[ \t]*', ' ', 'g'), chr(1), chr(10)) AS whole FROM d),
  cut AS (SELECT r, {_sentences('t')} AS lines, {_sentences('whole')} AS joined FROM p WHERE speaks),
  {_marks('lines')}, {_marks('joined')}, {_found('lines')}, {_found('joined')},
  l AS (SELECT r, string_agg(licence, ',' ORDER BY licence) AS licenses FROM (SELECT r, licence FROM lines_found WHERE licence IS NOT NULL
      UNION SELECT r, licence FROM joined_found WHERE licence IS NOT NULL) GROUP BY r),
  u AS (SELECT r, count(*) AS n FROM lines_marks WHERE list_contains(marks, '?') AND regexp_matches(s, '{UNKNOWN}') GROUP BY r),
  k AS (SELECT r, list_filter(coalesce(a.ids, []), lambda i: i <> '?') AS a, list_filter(coalesce(b.ids, []), lambda i: i <> '?') AS b
      FROM d LEFT JOIN lines_ids a USING (r) LEFT JOIN joined_ids b USING (r))
  SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(array_to_string(CASE WHEN len(b) > len(a) THEN b ELSE a END, ','), '') AS sentence_ids,
      coalesce(n, 0) AS n_unknown
  FROM d JOIN k USING (r) LEFT JOIN l USING (r) LEFT JOIN u USING (r)"""

URLS = rf"""WITH rules(host, path, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
      ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
  u AS (SELECT row_number() OVER () AS r, page_id,
      CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
  h AS (SELECT r, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
  p AS (SELECT r, page_id, translate(raw, '{_CAPITALS}', '{_CAPITALS.lower()}') AS host,
      regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
  f AS (SELECT r, rules.host || rules.path AS rule, action,
      row_number() OVER (PARTITION BY r ORDER BY length(rules.host || rules.path) DESC, length(rules.host) DESC) AS o
      FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path))
  SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN f ON p.r = f.r AND o = 1"""

_POLYNOMIAL = 0xEDB88320  # fixed: of CRC-32
SPELLING = rf"""WITH RECURSIVE t AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor({_POLYNOMIAL}, c >> 1) ELSE c >> 1 END, i) ORDER BY i)
      AS crcs FROM range(256) u(i)),
  w AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}'),
      '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
  g AS (SELECT id, run, count(*) AS n FROM w WHERE length(run) >= 6 GROUP BY id, run),
  b AS (SELECT *, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
      ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END)) AS bytes FROM g),
  h AS (SELECT run, n, xor(4294967295, list_reduce(bytes, lambda c, x: xor(crcs[(xor(c, x) & 255) + 1], c >> 8), 4294967295)) AS h FROM b, t),
  s AS (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
  v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
  d AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS cut FROM v, unnest(range(length(word))) u(i)),
  p AS (SELECT a.word, v.word AS other FROM d a JOIN v ON v.word = cut UNION SELECT v.word, a.word FROM d a JOIN v ON v.word = cut
      UNION SELECT a.word, b.word FROM d a JOIN d b USING (cut, i) WHERE a.word <> b.word AND length(a.word) = length(b.word)),
  o AS (SELECT p.word, other, v.n, count(*) OVER (PARTITION BY p.word) AS n_near,
      row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, other) AS k FROM p JOIN v ON v.word = other),
  f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN o.n >= 5 * v.n THEN other END AS form,
      CASE WHEN o.n >= 5 * v.n THEN o.n END AS form_n FROM v LEFT JOIN o ON o.word = v.word AND k = 1),
  r(word, leaf) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.leaf WHERE f.form IS NOT NULL)
  SELECT f.word, f.form, r.leaf AS root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f AS last ON last.word = r.leaf AND last.form IS NULL"""

ORACLE: dict[str, str] = {"op11_spelling": SPELLING, "op12_urls": URLS, "op2_licenses": LICENSES, "op3_decontamination": CONTAMINATION, "op9_repetition": REPETITION}
