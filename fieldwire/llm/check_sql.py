"""DuckDB SQL for the queries that SQL can express."""


def _kmeans(k: int, rounds: int) -> str:
    """Lloyd rounds as a chain of steps over (vector, component) rows."""
    steps = [f"""
        WITH vecs AS MATERIALIZED (
            SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        parts AS MATERIALIZED (SELECT row_id, unnest(range(1, 65)) AS i, unnest(v) AS x FROM vecs),
        c0 AS MATERIALIZED (
            SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS y
            FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM vecs QUALIFY c < {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""
        a{r} AS MATERIALIZED (
            SELECT row_id, c, d FROM (SELECT row_id, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM parts JOIN c{r} USING (i) GROUP BY 1, 2)
            QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY d, c) = 1)""")
        if r < rounds:
            steps.append(f"""
        m{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN parts USING (row_id) GROUP BY 1, 2),
        c{r + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN y ELSE (s - (s % n + n) % n) // n END AS y FROM c{r} LEFT JOIN m{r} USING (c, i))""")
    return ",".join(steps) + f"""
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
        FROM a{rounds} JOIN vecs USING (row_id) JOIN (SELECT c, sha256(string_agg(y, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) USING (c)"""


KMEANS = _kmeans(40, 5)


def _crc_of_nibbles() -> str:
    """What each half byte does to a CRC-32, as a list."""
    out = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ 0xEDB88320 * (x & 1)
        out.append(x)
    return f"CAST({out} AS BIGINT[])"


SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op8_mixing": """
        WITH have AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
        rate AS (SELECT s, pow(n, 0.5) / sum(pow(n, 0.5)) OVER () * sum(n) OVER () / n AS r FROM have),
        grid AS (SELECT s, r, unnest(range(0, CAST(ceil(r + 12 * sqrt(r) + 30) AS BIGINT) + 1)) AS k FROM rate),
        terms AS (SELECT s, k, exp(coalesce(list_sum(list_transform(range(1, k + 1), lambda i: ln(r) - ln(i))), 0) - r) AS p FROM grid),
        cdf AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM terms),
        drawn AS (SELECT *, CAST('0x' || substr(md5('mix|count|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
                  FROM documents),
        counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) AS copies
                    FROM drawn d JOIN cdf ON coalesce(d.source, '') = s AND c <= u GROUP BY ALL),
        copies AS (SELECT *, unnest(range(1, copies + 1)) AS n FROM counted)
        SELECT doc_id, text, lang, source, n_chars, CAST(n AS INTEGER) AS copy_no,
               md5('mix|place|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || n) AS mix_key
        FROM copies""",
    "op11_collocations": r"""
        WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        pieces AS (SELECT d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
        worded AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
        placed AS (SELECT pid, lang, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM worded),
        ahead AS (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM placed WINDOW o AS (PARTITION BY pid ORDER BY i)),
        grams AS (SELECT lang, 1 AS m, w AS phrase FROM ahead UNION ALL SELECT lang, 2, w || ' ' || w2 FROM ahead WHERE w2 IS NOT NULL
                  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM ahead WHERE w3 IS NOT NULL),
        f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS c FROM grams GROUP BY ALL),
        size AS (SELECT lang, sum(c) AS n FROM f WHERE m = 1 GROUP BY 1),
        cand AS (SELECT lang, m, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND c >= 10),
        cuts AS (SELECT cand.*, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:m], ' ') AS rp FROM cand, (VALUES (1), (2)) v(k) WHERE k < m),
        scored AS (SELECT cuts.lang, cuts.phrase, a, k, x.c AS l, y.c AS r, CAST(1000000 AS HUGEINT) * a * a // (CAST(x.c AS HUGEINT) * y.c) AS score
                   FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inner_ AS (SELECT lang, a, array_to_string(w[s:s + 1], ' ') AS phrase FROM cand, (VALUES (1), (2)) v(s) WHERE m = 3),
        longer AS (SELECT lang, phrase, max(a) AS b FROM inner_ GROUP BY 1, 2),
        kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE b IS NULL OR 100 * b < 50 * a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
               CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM kept JOIN size USING (lang) QUALIFY rank <= 2000""",
    "op12_clustering": KMEANS,
    "op13_sharding": r"""
        WITH base AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, encode(coalesce(text, '')) AS b FROM documents),
        nibbles AS (SELECT *, list_transform(string_split(regexp_replace(hex(b), '(.)(.)', '\2\1', 'g'), ''), lambda h: CAST('0x' || h AS BIGINT)) AS h FROM base),
        summed AS (SELECT row_id, doc_id, k, octet_length(b) + 16 AS size,
                          xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), h), lambda acc, x: xor(acc >> 4, CRC_NIBBLES[(xor(acc, x) & 15) + 1])), 4294967295) AS text_crc32
                   FROM nibbles),
        bids AS (SELECT k, j, -ln(CAST('0x' || substr(md5('shard|' || j || '|' || k), 1, 13) AS BIGINT) / 4503599627370496.0 + pow(2.0, -53)) AS h
                 FROM (SELECT DISTINCT k FROM base), range(41) s(j)),
        won AS (SELECT k, arg_min(j, h) FILTER (j < 40) AS shard, arg_min(j, h) AS grown_shard,
                       CAST('0x' || substr(md5('shard|cell|' || k), 1, 3) AS INTEGER) AS cell FROM bids GROUP BY k)
        SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
        FROM summed JOIN won USING (k)""".replace("CRC_NIBBLES", _crc_of_nibbles()),
}
