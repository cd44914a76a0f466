"""SQL of the text queries that SQL can express, for DuckDB."""

from __future__ import annotations

# Bytewise CRC-32 of ``word`` by a table made from its rule.
CRC_SQL = """crc_steps AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    ORDER BY b) AS steps FROM range(256) AS t(b))"""


def crc_sql(source: str, column: str) -> str:
    """SELECT (column, crc) of the distinct strings of a relation."""
    return f"""SELECT {column}, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
        list_transform(range(1, strlen({column}) + 1), lambda i: CAST('0x' || substr(hex(encode({column})), 2 * i - 1, 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS crc
      FROM (SELECT DISTINCT {column} FROM {source}), crc_steps"""


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS_SQL = f"regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

RESAMPLE_SQL = f"""WITH {CRC_SQL},
docs AS (SELECT row_number() OVER () AS row_id, doc_id, {WORDS_SQL} AS words FROM documents),
dw AS (SELECT row_id, unnest(words) AS word FROM docs),
bw AS (SELECT unnest({WORDS_SQL}) AS word FROM benchmark),
hashed AS ({crc_sql('(SELECT word FROM dw UNION SELECT word FROM bw)', 'word')}),
s AS (SELECT crc % 10000 AS bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY 1),
t AS (SELECT crc % 10000 AS bucket, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY 1),
size AS (SELECT CAST((SELECT coalesce(sum(n), 0) FROM s) AS DOUBLE) AS s_all, CAST((SELECT coalesce(sum(n), 0) FROM t) AS DOUBLE) AS t_all),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * (s_all + 10000)
    / ((CAST(s.n AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), size),
weighed AS (SELECT row_id, count(*) AS n_features, sum(gain) AS weight FROM dw JOIN hashed USING (word)
  JOIN gain ON bucket = crc % 10000 GROUP BY 1),
scored AS (SELECT row_id, doc_id, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5)
      / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM docs LEFT JOIN weighed USING (row_id)),
ranked AS (SELECT row_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20 AND doc_id IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (row_id)"""

SHARDS_SQL = f"""WITH {CRC_SQL},
texts AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS body,
    coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS key FROM documents),
drawn AS (SELECT row_id, shard, -1.0::DOUBLE / ln((CAST(CAST('0x' || substr(md5(shard || ':' || key), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
    / CAST(4503599627370496 AS DOUBLE)) AS number FROM texts, range(17) AS r(shard)),
own AS (SELECT row_id, arg_max(shard, number) FILTER (shard < 16) AS shard, arg_max(shard, number) AS grown FROM drawn GROUP BY 1),
sums AS ({crc_sql('texts', 'body')}),
rows_ AS (SELECT row_id, doc_id, strlen(body) + 1 AS size, crc AS text_crc32, own.shard, grown
  FROM texts JOIN own USING (row_id) JOIN sums USING (body))
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  CAST(grown AS INTEGER) AS grown_shard FROM rows_"""


def phrases_sql(longest: int, least: int, top: int) -> str:
    """Phrases of 2 to ``longest`` words of every language with their lowest-scoring cut."""
    return f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array({LOWER_SQL}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
total AS (SELECT lang, sum(len(words)) AS n FROM split GROUP BY 1),
runs AS (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i
  FROM split, range(1, {longest} + 1) AS t(m) WHERE len(words) >= m),
counted AS (SELECT lang, m, array_to_string(words[i:i + m - 1], ' ') AS text, count(*) AS n FROM runs GROUP BY ALL
  HAVING count(*) >= {least}),
f AS (SELECT lang, m, string_split(text, ' ') AS phrase, CAST(n AS HUGEINT) AS f FROM counted),
cuts AS (SELECT c.lang, c.m, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, CAST(n AS HUGEINT) AS n,
    1000 * c.f * CAST(n AS HUGEINT) // (l.f * r.f) AS score
  FROM f c, range(1, {longest}) AS t(k), f l, f r, total WHERE k < c.m AND total.lang = c.lang
    AND l.lang = c.lang AND l.phrase = c.phrase[1:k] AND r.lang = c.lang AND r.phrase = c.phrase[k + 1:c.m]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, f, phrase, unnest(range(2, m)) AS size FROM f WHERE m > 2),
placed AS (SELECT lang, f, phrase, size, unnest(range(1, len(phrase) - size + 2)) AS i FROM inner_),
around AS (SELECT lang, phrase[i:i + size - 1] AS phrase, max(f) AS around FROM placed GROUP BY ALL),
kept AS (SELECT best.lang, array_to_string(best.phrase, ' ') AS phrase, a, l, r, n, score
  FROM best LEFT JOIN around ON around.lang = best.lang AND around.phrase = best.phrase
  WHERE around IS NULL OR around < a)
SELECT lang, row_number() OVER w AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM kept
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= {top}"""


COLLOCATIONS_SQL = phrases_sql(5, 100, 2000)
