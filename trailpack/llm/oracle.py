"""DuckDB SQL for the queries that SQL can express."""

ORACLE: dict[str, str] = {}

# A conversation as the list of its turns in order; a prefix of it as the shorter list.
ORACLE["op4_chat_formatting"] = """
WITH convs AS (
    SELECT conv_id, count(*) AS n_turns,
           list({'turn': turn, 'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
    FROM conversations GROUP BY conv_id
), bare AS (
    SELECT conv_id, n_turns, list_transform(turns, lambda t: {'role': t.role, 'text': t.text}) AS turns FROM convs
), classes AS (
    SELECT turns, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM bare GROUP BY turns, n_turns
), prefixes AS (
    SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM classes)
)
SELECT conv_id, n_turns, n_copies,
       list_aggregate(list_transform(turns, lambda t: '<|im_start|>' || coalesce(t.role, '') || chr(10) || coalesce(t.text, '') || '<|im_end|>' || chr(10)), 'string_agg', '') AS rendered
FROM classes ANTI JOIN prefixes USING (turns)
"""

# A line's key and the documents that hold it; a repeated key's lines stay in the largest doc_id.
ORACLE["op1_line_dedup"] = """
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
    SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS n FROM split
), keyed AS (
    SELECT doc_id, n, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), repeated AS (
    SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT k.doc_id, k.n, k.line, coalesce(r.holder <> k.doc_id, false) AS dropped FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

# Base32 of a SHA-1: every five hex digits are 20 bits, that is four base32 digits.
ORACLE["op5_warc"] = """
WITH read AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digits FROM pages
), digests AS (
    SELECT page_id, html, list_aggregate(list_transform(range(1, 41, 5), lambda i: list_aggregate(list_transform([32768, 1024, 32, 1],
               lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                                ((('0x' || substr(digits, i, 5))::BIGINT // d) % 32 + 1)::BIGINT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest
    FROM read
), held AS (
    SELECT *, min(page_id) OVER (PARTITION BY html) AS holder FROM digests
)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM held
"""

# Distinct shingles of five words, on both sides.
_SHINGLES = """
    SELECT {id}, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
    FROM (SELECT {id}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
          FROM {table})
    WHERE len(w) > 0
"""
ORACLE["op2_decontamination"] = f"""
WITH items AS (SELECT DISTINCT item_id, shingle FROM ({_SHINGLES.format(id="item_id", table="benchmark")})),
docs AS (SELECT DISTINCT doc_id, shingle FROM ({_SHINGLES.format(id="doc_id", table="documents")})),
sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM docs JOIN items USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM shared JOIN sizes USING (item_id) WHERE 5 * n_shared >= 4 * n_item
"""

# Anchors with their rows by score: the first five of the label, then the first ten of other labels in each one's window.
ORACLE["op11_hard_negatives"] = """
WITH base AS (
    SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
           list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label,
           CAST(list_sum(list_transform(list_zip(a.x, r.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM base a JOIN base r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
    SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
    SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
           CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM positives JOIN scored USING (anchor_id)
    WHERE scored.label <> positives.own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
