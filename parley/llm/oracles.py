"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from parley.llm.license_scan import BASE, NOTICES
from parley.llm.queries import BLOCKED_NAMES
from parley.llm.spelling_variants import HOLED, RAREST, SHORTEST, TIMES
from parley.llm.url_filter import RULES

#: Texts with A-Z lower-cased; a null text is empty.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"


def _places(phrase: str) -> str:
    """Starts of a phrase in the word list ``w``, from 0."""
    words = phrase.split()
    listed = "[" + ", ".join(f"'{word}'" for word in words) + "]"
    return (
        f"list_filter(range(0, len(w) - {len(words) - 1}), "
        f"lambda i: w[i + 1] = '{words[0]}' AND w[i + 1:i + {len(words)}] = {listed})"
    )


def _present(phrase: str) -> str:
    return f"contains(line, ' {phrase} ')"


def _labels(licences) -> str:
    found = ", ".join(
        f"CASE WHEN {' AND '.join(map(_present, one.mandatory))} THEN '{one.label}' END"
        for one in sorted(licences, key=lambda one: one.label)
    )
    return f"array_to_string(list_filter([{found}], lambda x: x IS NOT NULL), ',')"


def _score(one) -> str:
    phrases = one.mandatory + one.others
    share = " + ".join(f"{_present(p)}::INT" for p in phrases)
    return f"CASE WHEN {' AND '.join(map(_present, one.mandatory))} THEN ({share})::DOUBLE / {len(phrases)} ELSE 0 END"


OP1 = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), lines AS (
  SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line,
    list_concat({", ".join(_places(p) for one in BASE for p in one.mandatory)}) AS starts
  FROM words
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(starts)::BIGINT AS n_base,
  list_min(starts)::BIGINT AS first_word, list_max(starts)::BIGINT AS last_word,
  {_labels(BASE)} AS base_labels, {_labels(BASE + NOTICES)} AS labels,
  greatest({", ".join(_score(one) for one in BASE + NOTICES)})::DOUBLE AS score
FROM lines
"""

OP4 = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) AS w FROM documents
), numbered AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM words
), windows AS (
  SELECT doc_id, i, hash(w[i:i + 34]) AS low, md5(array_to_string(w[i:i + 34], ' ')) AS high FROM numbered
), repeated AS (
  SELECT low, high FROM windows GROUP BY low, high HAVING count(*) > 1
), marks AS (
  SELECT DISTINCT doc_id, i + d AS p
  FROM windows SEMI JOIN repeated USING (low, high), (SELECT unnest(range(0, 35)) AS d)
), flat AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS line
  FROM flat ANTI JOIN marks USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(line, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

OP5 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWER}, {SPACED}) AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1),
    lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(node, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen
), least AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least ON node = doc_id
"""


def _rule_cases(values: str) -> str:
    cases = "".join(
        f" WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        f" THEN '{r.text if values == 'rule' else r.verdict}'"
        for r in sorted(RULES, key=lambda r: -len(r.text))
    )
    return f"CASE{cases} END"


OP7 = rf"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), flagged AS (
  SELECT *, regexp_matches(host, '{"|".join(BLOCKED_NAMES)}') AS listed FROM parts
)
SELECT page_id, host, path, {_rule_cases("rule")} AS rule,
  coalesce({_rule_cases("verdict")}, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM flagged
"""

OP9 = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {SPACED}) AS w FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM texts)
), twice AS (
  SELECT doc_id, gram FROM grams GROUP BY doc_id, gram HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n
  FROM grams SEMI JOIN twice USING (doc_id, gram), (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id
), measures AS (
  SELECT doc_id, t, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM texts LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM measures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 10 * n_dup_lines > 3 * len(lines)
    OR 10 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 4 * word_chars
    OR 10 * length(regexp_replace(t, '[^!?]', '', 'g')) > 3 * n_words) AS kept
FROM judged
"""



def _crc32_table() -> str:
    """What each byte changes the unsigned CRC-32 by, from its polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return f"{table}::BIGINT[]"


OP12 = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL
), lettered AS (
  SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END))::BIGINT[] AS bytes,
    {_crc32_table()} AS crcs
  FROM counted
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, bytes),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))) AS h
  FROM lettered
), holed AS (
  SELECT CASE WHEN h % {HOLED} = 0
    THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, n
  FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM holed WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {RAREST}
), shorter AS (
  SELECT word, i, word[:i - 1] || word[i + 1:] AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), lacking AS (
  SELECT DISTINCT s.word AS a, w.word AS b FROM shorter s JOIN words w ON s.rest = w.word
), near AS (
  SELECT a.word AS a, b.word AS b FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a, b FROM lacking UNION SELECT b, a FROM lacking
), best AS (
  SELECT a AS word, count(*)::BIGINT AS n_near, arg_min(b, (-n, encode(b))) AS form, max(n) AS form_n
  FROM near JOIN words ON words.word = b GROUP BY a
), formed AS (
  SELECT word, CASE WHEN form_n >= {TIMES} * n THEN form END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN form_n >= {TIMES} * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), walked AS (
  SELECT word, word AS root, form AS further FROM formed
  UNION ALL
  SELECT walked.word, formed.word, formed.form FROM walked JOIN formed ON formed.word = walked.further
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM walked WHERE further IS NULL) USING (word)
"""

ORACLES: dict[str, str] = {
    "op1_license_scan": OP1,
    "op4_substring_dedup": OP4,
    "op5_minhash": OP5,
    "op7_url_filter": OP7,
    "op9_quality_rules": OP9,
    "op12_spelling_variants": OP12,
}
