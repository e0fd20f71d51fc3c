"""DuckDB SQL for those of this folder's queries that SQL can state."""

from __future__ import annotations

#: op12: every window of every item against every place of every document.
DECONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
v AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
found AS (SELECT r, i, n, item FROM places JOIN v USING (n, words)),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


def crc32(bytes_: str) -> str:
    """The unsigned crc32 of a list of bytes, a bit at a time."""
    bit = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, CAST({bytes_} AS BIGINT[])), lambda c, b: {bit}))"


#: op13: each rebuilt conversation as a text of turn digests of 32 characters; nodes are its prefixes, subtrees are joined by prefix.
PREFIX_TRIE = r"""
WITH t AS (
  SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_md5, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS ord
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, count(*) AS n, """ + crc32("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: ascii(s))") + r""" % 4 AS h FROM t GROUP BY conv_id),
turns AS (
  SELECT i.conv_id, t.ord AS pos, turn_md5, words FROM ids i JOIN t ON t.conv_id = i.base AND t.ord <= i.h
  UNION ALL
  SELECT i.conv_id, least(i.h, coalesce(b.n, 0)) + t.ord - i.h, turn_md5, words FROM ids i JOIN t ON t.conv_id = i.conv_id AND t.ord > i.h LEFT JOIN ids b ON b.conv_id = i.base),
seqs AS (SELECT i.conv_id, coalesce(string_agg(turn_md5, '' ORDER BY pos), '') AS s, coalesce(list(words ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS w FROM ids i LEFT JOIN turns USING (conv_id) GROUP BY i.conv_id),
nodes AS (
  SELECT left(s, 32 * d) AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(CASE WHEN d = 0 THEN 0 ELSE w[d] END) AS words
  FROM (SELECT conv_id, s, w, unnest(range(0, length(s) // 32 + 1)) AS d FROM seqs) GROUP BY 1, 2),
children AS (SELECT left(p, 32 * (d - 1)) AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
each AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (p)),
below AS (
  SELECT left(p, 32 * a) AS p, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT p, n_children, n_convs, words, unnest(range(0, d + 1)) AS a FROM each) GROUP BY 1),
ends AS (SELECT s AS p, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM seqs GROUP BY s)
SELECT e.conv_id, CAST(e.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(e.n_convs AS BIGINT) AS n_convs, CAST(e.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM each e JOIN below USING (p) LEFT JOIN ends USING (p) LEFT JOIN nodes u ON e.d > 0 AND u.p = left(e.p, 32 * (e.d - 1))
"""

#: op11: words that become equal without a code point at the same place, or one of which becomes the other, differ by one.
SPELLING = r"""
WITH RECURSIVE runs AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
coded AS (SELECT run, count(*) AS times, coalesce(id, '') || ':' || run AS s FROM runs GROUP BY run, id),
summed AS (
  SELECT run, times, """ + crc32("list_concat(list_transform(string_split(split_part(s, ':', 1) || ':', ''), lambda c: ascii(c)), flatten(list_transform(string_split(run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, 128 + unicode(c) - 192] END)))") + r""" AS h FROM coded),
v AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (SELECT times, CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM summed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
judged AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form, CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
steps AS (SELECT word, form AS at FROM judged WHERE form IS NOT NULL UNION ALL SELECT s.word, j.form FROM steps s JOIN judged j ON j.word = s.at WHERE j.form IS NOT NULL),
roots AS (SELECT s.word, s.at AS root FROM steps s JOIN judged j ON j.word = s.at WHERE j.form IS NULL)
SELECT word, n, n_near, form, form_n, coalesce(root, word) AS root FROM judged LEFT JOIN roots USING (word)
"""
