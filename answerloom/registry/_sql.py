"""SQL fragments the comparison queries share."""

from __future__ import annotations

SENTENCE = r"(?s)\S.*?(?:[.!?]+(?:\s+|\z)|\z)"
BLANKS = r"' ' || chr(9) || chr(10) || chr(13) || chr(12)"


def sentence_list(text: str) -> str:
    return (
        f"list_transform(regexp_extract_all({text}, '{SENTENCE}'), "
        f"lambda s: rtrim(s, {BLANKS}))"
    )


def first_sentence(text: str) -> str:
    return f"rtrim(regexp_extract({text}, '{SENTENCE}', 0), {BLANKS})"


def covering(text: str) -> str:
    """The sentence with the most distinct words, the first of equal ones."""
    return (
        f"(SELECT coalesce(list_extract(ss, list_position(ns, list_max(ns))), '') FROM "
        f"(SELECT ss, list_transform(ss, lambda x: len(list_distinct({tokens('x')}))) AS ns "
        f"FROM (SELECT {sentence_list(text)} AS ss)))"
    )


def best_sentences(name: str, passages: str, questions: str) -> str:
    """CTE ``name(query, answer)`` of ``passages(query, rk, text)`` and ``questions(query, question)``."""
    return f"""
    {name} AS (
      SELECT query, first(sent ORDER BY 2.0::DOUBLE * len(list_intersect(own, asked)) / (len(own) + len(asked)) DESC,
                                        rk, ix) AS answer
      FROM (SELECT query, rk, ix, sent, list_distinct({tokens('sent')}) AS own,
                   list_distinct({tokens('question')}) AS asked
            FROM (SELECT query, rk, generate_subscripts(ss, 1) AS ix, unnest(ss) AS sent
                  FROM (SELECT query, rk, {sentence_list('text')} AS ss FROM {passages}))
            JOIN {questions} USING (query))
      GROUP BY query)"""


def tokens(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '\S+')"


def chunks(source: str, key: str, text: str, size: int = 500, overlap: int = 10) -> str:
    """CTEs ending in ``chunk(key, chunk_ix, content)``; needs WITH RECURSIVE.

    One step per sentence piece; the state is the slice of pieces in the open
    chunk (``s`` to ``i``) and its token total.
    """
    return rf"""
    chunk_sentences AS (
      SELECT {key} AS key, generate_subscripts(ss, 1) AS six, unnest(ss) AS sentence
      FROM (SELECT {key}, {sentence_list(text)} AS ss FROM {source})
    ),
    chunk_words AS (
      SELECT key, six, sentence, regexp_extract_all(sentence, '\S+') AS w FROM chunk_sentences
    ),
    chunk_pieces AS (
      SELECT key, six, 0 AS pix, len(w) AS n, sentence AS piece FROM chunk_words WHERE len(w) <= {size}
      UNION ALL
      SELECT key, six, p AS pix, len(w[p * {size} + 1 : (p + 1) * {size}]) AS n,
             array_to_string(w[p * {size} + 1 : (p + 1) * {size}], ' ') AS piece
      FROM (SELECT *, unnest(range((len(w) + {size} - 1) // {size})) AS p
            FROM chunk_words WHERE len(w) > {size})
    ),
    chunk_lists AS (
      SELECT key, list(n ORDER BY six, pix) AS ns, list(piece ORDER BY six, pix) AS ps
      FROM chunk_pieces GROUP BY key
    ),
    chunk_state AS (
      SELECT key, 1::BIGINT AS i, 1::BIGINT AS s, ns[1]::BIGINT AS total, 0::BIGINT AS c
      FROM chunk_lists
      UNION ALL
      SELECT key, i + 1,
             CASE WHEN total + m <= {size} THEN s WHEN os + m > {size} THEN i + 1 ELSE i + 1 - x END,
             CASE WHEN total + m <= {size} THEN total + m WHEN os + m > {size} THEN m ELSE os + m END,
             CASE WHEN total + m <= {size} THEN c ELSE c + 1 END
      FROM (
        SELECT *, coalesce(list_sum(ns[i - x + 1 : i]), 0)::BIGINT AS os
        FROM (
          SELECT st.*, l.ns, l.ns[st.i + 1]::BIGINT AS m,
                 list_max(list_filter(range(0, least({overlap}, st.i - st.s + 1) + 1),
                   lambda y: coalesce(list_sum(l.ns[st.i - y + 1 : st.i]), 0) <= {overlap})) AS x
          FROM chunk_state st JOIN chunk_lists l ON l.key = st.key
          WHERE st.i < len(l.ns)
        )
      )
    ),
    chunk AS (
      SELECT e.key, e.c AS chunk_ix, array_to_string(l.ps[e.s : e.i], ' ') AS content
      FROM (SELECT key, c, max(i) AS i, arg_max(s, i) AS s FROM chunk_state GROUP BY key, c) e
      JOIN chunk_lists l ON l.key = e.key
    )"""


def embedded(name: str, source: str, key: str, text: str, dim: int = 64) -> str:
    """CTE ``name(key, b, v)``: the non-zero entries of each row's embedding."""
    return rf"""
    {name}_counts AS (
      SELECT key, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS b, count(*)::DOUBLE AS c
      FROM (SELECT {key} AS key, unnest({tokens(text)}) AS t FROM {source})
      GROUP BY ALL
    ),
    {name} AS (
      SELECT key, b, (c / sqrt(sum(c * c) OVER (PARTITION BY key)))::FLOAT::DOUBLE AS v
      FROM {name}_counts
    )"""


def ranked(queries: str, corpus: str, k: int, name: str = "hits") -> str:
    """CTE ``name(query, rk, key, score)`` of the top ``k`` by dot product."""
    return f"""
    {name} AS (
      SELECT query, rk, key, score FROM (
        SELECT query, key, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rk
        FROM (
          SELECT query, key, round(coalesce(dot, 0), 6) AS score
          FROM (SELECT q.key AS query, c.key AS key
                FROM (SELECT DISTINCT key FROM {queries}) q, (SELECT DISTINCT key FROM {corpus}) c)
          LEFT JOIN (SELECT q.key AS query, c.key AS key, sum(q.v * c.v) AS dot
                     FROM {queries} q JOIN {corpus} c ON c.b = q.b GROUP BY ALL) USING (query, key)
        )
      ) WHERE rk <= {k}
    )"""
