"""SQL that must give the same rows as the queries, where SQL can say it."""

from __future__ import annotations

from .lexical import LOWER, TERM, UPPER
from .lm import BIGRAM, LEAST, UNIFORM, UNIGRAM
from .mixing import MOST_COPIES, SEED
from .quality import GRAM_LIMITS, LEAST_WORDS, LINE_LIMIT, REPEAT_LIMIT
from .secrets import ACCESS, ASSIGN, HEX, LEAST_VALUE, MOST_OWNERS, TOKEN

SQL: dict[str, str] = {}


def _runs(n: int) -> str:
    """Words that lie in a run of n words found twice or more in the document, by document and place."""
    return f"""
    runs_{n} AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS times FROM (
            SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS run
            FROM spoken) WHERE len(run) = {n}),
    covered_{n} AS (
        SELECT doc_id, count(*) AS n_words, sum(length(word)) AS chars FROM (
            SELECT s.doc_id, s.word, max(coalesce(r.times, 1)) OVER (
                PARTITION BY s.doc_id ORDER BY s.i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS times
            FROM spoken s LEFT JOIN runs_{n} r USING (doc_id, i))
        WHERE times > 1 GROUP BY doc_id)"""


def quality_sql() -> str:
    lengths = sorted(GRAM_LIMITS)
    bad = " OR ".join([f"100 * line_chars > {LINE_LIMIT} * word_chars",
                       *(f"100 * chars_{n} > {m} * word_chars" for n, m in GRAM_LIMITS.items())])
    return rf"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    listed AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
    spoken AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM listed),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM texts),
    again AS (
        SELECT doc_id, count(*) AS n_dup_lines, sum(list_sum(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda w: length(w)))) AS line_chars
        FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth FROM lines
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]'))
        WHERE nth > 1 GROUP BY doc_id),
    {", ".join(_runs(n) for n in (3, *lengths))},
    figures AS (
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
            CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
            CAST(coalesce(covered_3.n_words, 0) AS BIGINT) AS n_repeat_words,
            {", ".join(f"CAST(coalesce(covered_{n}.chars, 0) AS BIGINT) AS chars_{n}" for n in lengths)},
            CAST(coalesce(line_chars, 0) AS BIGINT) AS line_chars
        FROM listed LEFT JOIN again USING (doc_id)
        {" ".join(f"LEFT JOIN covered_{n} USING (doc_id)" for n in (3, *lengths))}),
    judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_LIMIT} * n_words AS base_failed FROM figures)
    SELECT *, NOT base_failed AND NOT ({bad}) AS kept FROM judged"""


SQL["op8_quality_rules"] = quality_sql()


SQL["op2_mixing"] = rf"""
    WITH sized AS (
        SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
    sources AS (
        SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
        FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
    ordered AS (
        SELECT *, row_number() OVER fill AS k, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
            sum(source_size) OVER fill AS full_size, sum(weight) OVER fill AS full_weight
        FROM sources WINDOW fill AS (ORDER BY source_size / weight, source ROWS UNBOUNDED PRECEDING)),
    shares AS (
        SELECT 0 AS k, CAST(any_value(total) AS DOUBLE) / any_value(weights) AS share FROM ordered
        UNION ALL
        SELECT k, CAST(total - {MOST_COPIES} * full_size AS DOUBLE) / (weights - full_weight) FROM ordered WHERE full_weight < weights),
    chosen AS (
        SELECT s.share FROM shares s LEFT JOIN ordered o ON o.k = s.k + 1
        WHERE o.k IS NULL OR s.share * o.weight < {MOST_COPIES} * o.source_size ORDER BY s.k LIMIT 1),
    targets AS (
        SELECT source, source_size, least((SELECT share FROM chosen) * weight, CAST({MOST_COPIES} * source_size AS DOUBLE)) AS target
        FROM sources),
    rates AS (
        SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, {float(MOST_COPIES)}) ELSE 0.0 END AS rate FROM targets),
    taken AS (
        SELECT doc_id, size, source_size, target, CAST(floor(rate) AS INTEGER) + CASE WHEN
            CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0 < rate - floor(rate)
            THEN 1 ELSE 0 END AS copies
        FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source)
    SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM taken"""


def _spans(kind: str, rank: int, pattern: str, group: int, condition: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start, start + length(hit) AS stop, value FROM (
        SELECT doc_id, hit, value, sum(length(gap)) OVER w + sum(length(hit)) OVER w - length(hit) AS start
        FROM (
            SELECT doc_id, unnest(hits) AS hit, unnest(vals) AS value, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i
            FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS hits, regexp_extract_all(text, '{quoted}', {group}) AS vals,
                  string_split_regex(text, '{quoted}') AS gaps FROM texts))
        WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING))
    WHERE {condition}"""


TOKEN_RULE = rf"""(regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]'))
    OR (regexp_full_match(value, '[A-Z0-9]+|[a-z0-9]+') AND regexp_matches(value, '[A-Za-z]') AND length(regexp_replace(value, '[^0-9]', '', 'g')) >= 4)"""


SQL["op7_secret_scans"] = rf"""
    WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
    base AS ({_spans("assign", 0, ASSIGN, 2, f"length(value) >= {LEAST_VALUE}")}
        UNION ALL {_spans("access", 1, ACCESS, 1, "true")} UNION ALL {_spans("hex", 2, HEX, 1, "true")}),
    tokens AS (
        SELECT * FROM ({_spans("token", 3, TOKEN, 1, TOKEN_RULE)}) t
        WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.start <= t.start AND t.stop <= b.stop)),
    every AS (SELECT *, true AS is_base FROM base UNION ALL SELECT *, false FROM tokens),
    owned AS (SELECT value FROM every JOIN texts USING (doc_id) GROUP BY value HAVING count(DISTINCT coalesce('s' || source, '')) <= {MOST_OWNERS}),
    both_kinds AS (SELECT every.*, owned.value IS NOT NULL AS live FROM every LEFT JOIN owned USING (value)),
    said AS (
        SELECT doc_id, count(*) FILTER (is_base AND rank = 0) AS n_assign, count(*) FILTER (is_base AND rank = 1) AS n_access,
            count(*) FILTER (is_base AND rank = 2) AS n_hex, count(*) FILTER (live) AS n_live, count(*) FILTER (is_base AND NOT live) AS n_copied,
            string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank, stop) FILTER (is_base) AS base,
            string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank, stop) FILTER (is_base OR live) AS spans
        FROM both_kinds GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
    FROM texts LEFT JOIN said USING (doc_id)"""


SQL["op5_exact_topk"] = """
    WITH whole AS (
        SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.row, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
        FROM whole q JOIN whole d ON q.row <> d.row AND len(q.v) = len(d.v) WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20"""


SQL["op4_minhash_near_dedup"] = r"""
    WITH RECURSIVE listed AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
        FROM documents),
    shingled AS (
        SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
            ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
        FROM listed),
    each AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM shingled),
    links AS (
        SELECT a.doc_id AS u, b.doc_id AS v FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
    reached(doc_id, low) USING KEY (doc_id) AS (
        SELECT doc_id, doc_id AS low FROM documents
        UNION
        SELECT l.u, min(r.low) FROM reached r JOIN links l ON l.v = r.doc_id JOIN recurring.reached o ON o.doc_id = l.u
        WHERE r.low < o.low GROUP BY l.u)
    SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, low AS component_id, low = doc_id AS kept
    FROM shingled JOIN reached USING (doc_id)"""


SQL["op6_lm_scoring"] = rf"""
    WITH listed AS (
        SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS wanted,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
        FROM documents),
    spoken AS (SELECT doc_id, wanted, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM listed),
    totals AS (SELECT count(*) AS n, count(*) FILTER (wanted) AS t FROM spoken),
    texts AS (SELECT count(*) AS n, count(*) FILTER (wanted) AS t FROM listed WHERE len(words) > 0),
    unigrams AS (SELECT word, count(*) AS n, count(*) FILTER (wanted) AS t FROM spoken GROUP BY word HAVING count(*) >= {LEAST}),
    size AS (SELECT count(*) + 1 AS v, coalesce(sum(n), 0) AS n, coalesce(sum(t), 0) AS t FROM unigrams),
    contexts AS (SELECT word AS before, n, t FROM unigrams UNION ALL SELECT NULL, n, t FROM texts),
    tokens AS (SELECT doc_id, wanted, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM spoken),
    bigrams AS (SELECT before, word, count(*) AS n, count(*) FILTER (wanted) AS t FROM tokens GROUP BY before, word HAVING count(*) >= {LEAST}),
    rates AS (
        SELECT b.before, b.word, b.n / c.n AS n, CASE WHEN c.t > 0 THEN b.t / c.t ELSE 0 END AS t
        FROM bigrams b JOIN contexts c ON b.before IS NOT DISTINCT FROM c.before),
    losses AS (
        SELECT doc_id,
            -ln({BIGRAM} * coalesce(r.t, 0) + {UNIGRAM} * (coalesce(u.t, totals.t - size.t) / greatest(totals.t, 1)) + {UNIFORM} / v) AS target,
            -ln({BIGRAM} * coalesce(r.n, 0) + {UNIGRAM} * (coalesce(u.n, totals.n - size.n) / totals.n) + {UNIFORM} / v) AS background
        FROM tokens k CROSS JOIN totals CROSS JOIN size LEFT JOIN unigrams u ON k.word = u.word
            LEFT JOIN rates r ON k.word = r.word AND k.before IS NOT DISTINCT FROM r.before)
    SELECT doc_id, len(any_value(words)) AS n_tokens, round(coalesce(avg(target), 0), 6) AS target_loss,
        round(coalesce(avg(background), 0), 6) AS background_loss, round(coalesce(avg(target - background), 0), 6) AS score
    FROM listed LEFT JOIN losses USING (doc_id) GROUP BY doc_id"""


SQL["op12_lexical_search"] = rf"""
WITH spoken AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM documents),
asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM spoken GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
counted AS (SELECT doc_id, term, count(*) AS tf FROM spoken SEMI JOIN asked USING (term) GROUP BY doc_id, term),
weighed AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM counted, whole GROUP BY term, docs),
held AS (
    SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // words)))) AS value
    FROM counted JOIN weighed USING (term) JOIN sizes USING (doc_id), whole),
scored AS (
    SELECT item_id, doc_id, sum(value)::BIGINT AS score FROM asked JOIN held USING (term) GROUP BY item_id, doc_id),
placed AS (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
"""

# crc32 by its table of bytes, which follows from the polynomial
SQL["op13_spelling_variants"] = r"""
WITH RECURSIVE steps AS (
    SELECT range AS byte, range::UBIGINT AS c, 0 AS i FROM range(256)
    UNION ALL
    SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, i + 1 FROM steps WHERE i < 8),
crc AS (SELECT list(c ORDER BY byte) AS of_byte FROM steps WHERE i = 8),
runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
spoken AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
coded AS (
    SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''),
        lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::UBIGINT] ELSE [195::UBIGINT, (unicode(x) - 64)::UBIGINT] END)) AS bytes
    FROM spoken),
hashed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes),
        lambda c, b: xor(c >> 8, of_byte[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS h
    FROM coded, crc),
said AS (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n
    FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM said WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS (
    SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
        CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
    FROM words LEFT JOIN best USING (word)),
climbed AS (
    SELECT word, word AS top, 0 AS step FROM formed
    UNION ALL
    SELECT c.word, f.form, step + 1 FROM climbed c JOIN formed f ON c.top = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(top, step) AS root FROM climbed GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
