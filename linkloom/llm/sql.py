"""SQL twins of the later queries."""

from __future__ import annotations

#: crc32 of a text of ASCII characters, worked out bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(KEY, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte:
  list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, bit: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)"""


#: Repair from the last row to the first: the best end of a repair from each state, as cost, audit and text.
REPAIR = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         (coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k
  FROM conversations
), kinds AS (
  SELECT *, CRC % 20 AS kind FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS place,
         count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS letter,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
                 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
         lag(letter) OVER (PARTITION BY conv_id ORDER BY place) || letter AS pair
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), walk(conv_id, place, w0, w1, w2, w3) AS (
  SELECT DISTINCT conv_id, n + 1, {'c': 0, 'a': '', 't': ''}, {'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'},
         {'c': 3, 'a': 'I', 't': chr(10) || 'assistant:'}, {'c': 0, 'a': '', 't': ''}
  FROM faulty
  UNION ALL
  SELECT conv_id, place,
         least(v0, {'c': 3 + v2.c, 'a': 'I' || v2.a, 't': chr(10) || 'user:' || v2.t}, {'c': 6 + v3.c, 'a': 'II' || v3.a, 't': chr(10) || 'user:' || chr(10) || 'assistant:' || v3.t}),
         least(v1, {'c': 3 + v2.c, 'a': 'I' || v2.a, 't': chr(10) || 'user:' || v2.t}, {'c': 6 + v3.c, 'a': 'II' || v3.a, 't': chr(10) || 'user:' || chr(10) || 'assistant:' || v3.t}),
         least(v2, {'c': 3 + v3.c, 'a': 'I' || v3.a, 't': chr(10) || 'assistant:' || v3.t}),
         least(v3, {'c': 3 + v2.c, 'a': 'I' || v2.a, 't': chr(10) || 'user:' || v2.t})
  FROM (
    SELECT conv_id, place,
           least({'c': 4 + w0.c, 'a': 'D' || w0.a, 't': w0.t}, {'c': same + CASE letter WHEN 's' THEN w1.c WHEN 'u' THEN w2.c ELSE 100000 END, 'a': 'K' || CASE letter WHEN 's' THEN w1.a ELSE w2.a END, 't': said || CASE letter WHEN 's' THEN w1.t ELSE w2.t END},
                 {'c': 3 + same + w2.c, 'a': 'R' || w2.a, 't': chr(10) || 'user:' || text || w2.t}) AS v0,
           least({'c': 4 + w1.c, 'a': 'D' || w1.a, 't': w1.t}, {'c': same + CASE letter WHEN 'u' THEN w2.c ELSE 100000 END, 'a': 'K' || w2.a, 't': said || w2.t},
                 {'c': 3 + same + w2.c, 'a': 'R' || w2.a, 't': chr(10) || 'user:' || text || w2.t}) AS v1,
           least({'c': 4 + w2.c, 'a': 'D' || w2.a, 't': w2.t}, {'c': same + CASE letter WHEN 'a' THEN w3.c ELSE 100000 END, 'a': 'K' || w3.a, 't': said || w3.t},
                 {'c': 3 + same + w3.c, 'a': 'R' || w3.a, 't': chr(10) || 'assistant:' || text || w3.t}) AS v2,
           least({'c': 4 + w3.c, 'a': 'D' || w3.a, 't': w3.t}, {'c': same + CASE letter WHEN 'u' THEN w2.c ELSE 100000 END, 'a': 'K' || w2.a, 't': said || w2.t},
                 {'c': 3 + same + w2.c, 'a': 'R' || w2.a, 't': chr(10) || 'user:' || text || w2.t}) AS v3
    FROM (
      SELECT f.conv_id, f.place, f.letter, f.text, chr(10) || f.role || ':' || f.text AS said,
             CASE f.fault WHEN 'blank' THEN 100000 WHEN 'duplicate' THEN 100000 WHEN 'truncated' THEN 3 ELSE 0 END AS same, w.w0, w.w1, w.w2, w.w3
      FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.place = w.place - 1
    )
  )
), best AS (
  SELECT conv_id, w0 FROM walk WHERE place = 1
)
SELECT e.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
       coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(b.w0.c, 0)::BIGINT AS cost,
       coalesce(b.w0.a, '') AS audit, sha256(substr(coalesce(b.w0.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id
""".replace("CRC", CRC32.replace("KEY", "k"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" if isinstance(v, str) else str(v) for v in values) + "]"


def _standing(words) -> str:
    """Places from 0 at which words stand one after another, from a plain look at every place."""
    same = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(words, 1))
    return f"list_filter(range(len(w)), lambda i: {same})"


def licence_scan(index, anchors: int) -> str:
    """Notices of the index in ``documents``: agreeing beginnings of the rarest words that a text and a notice share."""
    base = ", ".join(f"{_standing(words)} AS b{k}" for k, (_, words) in enumerate(index.base))
    shared, begins, accepted, shares = [], [], [], []
    for k, notice in enumerate(index.notices):
        most = min(anchors, len(notice.ranked))
        shared.append(f"list_filter({_list(notice.ranked)}, lambda x: list_contains(w, x)) AS s{k}")
        starts = [
            f"list_distinct(flatten(list_transform(list_filter(range(len(w)), lambda i: w[i + 1] = s{k}[{a}]), "
            f"lambda i: list_transform(p{k}[s{k}[{a}]], lambda p: i - p))))"
            for a in range(1, most + 1)
        ]
        agreed = starts[0]
        for other in starts[1:]:
            agreed = f"list_intersect({agreed}, {other})"
        begins.append(f"CASE WHEN len(s{k}) >= {most} THEN {agreed} ELSE [] END AS g{k}")
        keys = " AND ".join(f"len({_standing(p)}) > 0" for p in notice.phrases)
        accepted.append(f"CASE WHEN len(g{k}) > 0 AND {keys} THEN '{notice.label}' END AS l{k}")
        shares.append(f"CASE WHEN l{k} IS NOT NULL THEN len(s{k}) / {len(notice.ranked)}::DOUBLE END")
    postings = ", ".join(
        "MAP {" + ", ".join(f"'{w}': {_list(n.postings[w])}" for w in n.ranked) + "}" + f" AS p{k}" for k, n in enumerate(index.notices)
    )
    bases = ", ".join(f"CASE WHEN len(b{k}) > 0 THEN '{label}' END" for k, (label, _) in enumerate(index.base))
    owns = ", ".join(f"l{k}" for k in range(len(index.notices)))
    places = " || ".join(f"b{k}" for k in range(len(index.base)))
    sorted_labels = "array_to_string(list_sort(list_distinct(list_filter([{0}], lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w, {postings} FROM documents
), shared AS (SELECT *, {base}, {", ".join(shared)} FROM cut
), agreed AS (SELECT *, {places} AS places, {", ".join(begins)} FROM shared
), accepted AS (SELECT *, {", ".join(accepted)} FROM agreed)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word,
       list_max(places)::BIGINT AS last_word, {sorted_labels.format(bases)} AS base_labels,
       {sorted_labels.format(bases + ", " + owns)} AS labels,
       CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(greatest({", ".join(shares)}), 0)::DOUBLE END AS score
FROM accepted
"""
