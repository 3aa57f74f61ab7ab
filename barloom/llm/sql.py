"""SQL of the queries that it can express on whole tables, written from their contracts, not from the operators."""

_CLASS = r"[^\x20\x09-\x0D]+"

#: Smallest node reached over ``links`` (a, b, both ways) from each of ``nodes`` (id).
_REACHED = """
    reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
    comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

NEAR_VECTORS = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
    v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
          WHERE label IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
              ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.98),
    {_REACHED}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM comp
"""


def _words(text: str) -> str:
    return f"""
    lists AS (SELECT doc_id, regexp_extract_all({text}, '{_CLASS}') AS ws FROM documents WHERE text IS NOT NULL),
    words AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM lists)"""


def _windows(n: int) -> str:
    return f"""
    win AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER w AS s, count(*) OVER w AS n FROM words
            WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING))"""


JACCARD = f"""
WITH RECURSIVE {_words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, {_windows(5)},
    sets AS (SELECT DISTINCT doc_id, s FROM win WHERE n = 5
             UNION ALL SELECT doc_id, string_agg(word, ' ' ORDER BY i) FROM words GROUP BY doc_id HAVING count(*) < 5),
    size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM shared JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
    nodes AS (SELECT doc_id AS id FROM documents), {_REACHED}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM comp LEFT JOIN size ON doc_id = id
"""

SUBSTRINGS = f"""
WITH {_words("text")}, {_windows(35)},
    often AS (SELECT s FROM win WHERE n = 35 GROUP BY s HAVING count(*) > 1),
    starts AS (SELECT win.doc_id, i, word, often.s IS NOT NULL AS hit FROM win LEFT JOIN often ON win.n = 35 AND win.s = often.s),
    marked AS (SELECT doc_id, i, word, max(CAST(hit AS INTEGER)) OVER
                   (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM starts),
    done AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed,
                 string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN done USING (doc_id)
"""


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of assignment one after the other: every part against every entry of its codebook."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
    near{r} AS MATERIALIZED (
        SELECT vec_id, label, p, part, d.d AS d, d.e AS e FROM (
            SELECT vec_id, label, s.p, part, min({{'d': list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS d
            FROM pieces s JOIN book{r} b ON b.p = s.p GROUP BY ALL))""")
        if r < rounds:
            steps.append(f"""
    means{r} AS (SELECT p, e, list(m ORDER BY i) AS entry FROM (
        SELECT p, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m
        FROM (SELECT p, e, unnest(part) AS x, unnest(range(len(part))) AS i FROM near{r}) GROUP BY ALL) GROUP BY ALL),
    book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.entry, b.entry) AS entry FROM book{r} b LEFT JOIN means{r} m ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH kept AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    pieces AS MATERIALIZED (
        SELECT vec_id, label, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] AS part FROM kept, (SELECT unnest(range({parts})) AS p)),
    book0 AS MATERIALIZED (
        SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, part AS entry FROM pieces
        QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries}),{",".join(steps)},
    whole AS (SELECT vec_id, label, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY ALL),
    numbers AS (SELECT p, e, unnest(entry) AS x, unnest(range(len(entry))) AS i FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM numbers) AS codebooks_sha256
FROM whole
"""


VECTOR_CODES = _vector_codes()

MIXING = f"""
WITH docs AS (
        SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_CLASS}')), 0) AS BIGINT) AS size,
            md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')) AS key FROM documents),
    sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM docs GROUP BY source),
    weighed AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM sources),
    scarce AS (SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, place) AS k FROM weighed),
    sums AS (SELECT *, sum(2 * source_size) OVER (ORDER BY k) - 2 * source_size AS full_before, sum(weight) OVER (ORDER BY k DESC) AS weight_left,
        1.5 * sum(source_size) OVER () AS budget FROM scarce),
    free AS (SELECT * FROM sums WHERE weight * CAST(budget - full_before AS DOUBLE) / weight_left <= 2 * source_size ORDER BY k LIMIT 1),
    targets AS (SELECT s.source, s.source_size, CASE WHEN s.k < f.k THEN CAST(2 * s.source_size AS DOUBLE)
        ELSE s.weight * CAST(f.budget - f.full_before AS DOUBLE) / f.weight_left END AS target FROM sums s, free f),
    rest AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM targets),
    upto AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size AS budget,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held
        FROM docs d JOIN rest r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
    CAST(size * (whole + CASE WHEN budget > 0 AND (held <= budget OR held - size < budget AND held - budget < budget - (held - size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM upto
"""

#: crc32 of the decimal doc_id, a bit at a time: every eighth step takes in a byte.
_CRC = """
    crc AS (SELECT doc_id, xor(list_reduce(list_transform(range(8 * len(CAST(doc_id AS VARCHAR))), lambda k:
            CASE WHEN k % 8 = 0 THEN CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(k // 8 + 1 AS BIGINT), 1)) AS BIGINT) ELSE 0 END),
        lambda acc, x: xor(xor(acc, x) >> 1, 3988292384 * (xor(acc, x) & 1)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS h
        FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL))"""

PERIODIC_RUNS = f"""
WITH {_CRC},
    lists AS (SELECT d.doc_id, coalesce(regexp_extract_all(text, '{_CLASS}'), []) AS ws, h, h // 10 AS g FROM documents d LEFT JOIN crc ON crc.doc_id = d.doc_id),
    sizes AS (SELECT *, len(ws) AS n, coalesce(h % 10 = 0 AND len(ws) > 0, false) AS looped FROM lists),
    begins AS (SELECT *, CASE WHEN looped THEN g % n END AS a FROM sizes),
    loops AS (SELECT *, CASE WHEN looped THEN 1 + (n - a) // (3 + g % 8) END AS p FROM begins),
    words AS MATERIALIZED (
        SELECT doc_id, i, CASE WHEN looped AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS w FROM (SELECT *, unnest(range(n)) AS i FROM loops)),
    pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i),
    islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
    stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) >= greatest(q, 12 - q)),
    runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY ALL),
    best AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': period}}, {{'l': -length, 's': start, 'p': period}}) AS r,
        sha256(string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY doc_id),
    edges AS (SELECT doc_id, i, sum(step) AS step FROM (
        SELECT doc_id, start + period AS i, 1 AS step FROM runs UNION ALL SELECT doc_id, start + length, -1 FROM runs) GROUP BY ALL),
    marked AS (SELECT w.doc_id, w.i, w.w, sum(coalesce(step, 0)) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS inside
        FROM words w LEFT JOIN edges e ON e.doc_id = w.doc_id AND e.i = w.i),
    kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) FILTER (inside = 0) AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(r.start AS BIGINT) AS start, CAST(r.length AS BIGINT) AS length, CAST(r.period AS BIGINT) AS period,
    CAST(floor(r.length * 1000 / r.period) AS BIGINT) AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
