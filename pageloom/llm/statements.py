"""DuckDB statements of the conversation trie and the quality rules, from the raw tables."""

from pageloom.llm.quality_rules import (CLASS_LEAST, CLASS_LIMIT, LANG_SHARE, LEAST_WORDS, REPEAT_PERCENT, WORD_LEAST,
                                        WORD_LIMIT, WORD_SHARE)

# crc32 of an ASCII string, bit by bit.
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda c: unicode(c)::BIGINT)),
    lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))))"""

TRIE = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(text, '') AS x,
        substr(sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 1, 32)
            || printf('%08x', length(coalesce(text, ''))) AS k
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS ks, list(length(x)::BIGINT ORDER BY turn NULLS FIRST, k) AS ns
    FROM turns GROUP BY conv_id
), headed AS (
    SELECT o.conv_id, o.ks, o.ns, ({_CRC.format("o.conv_id::VARCHAR")} % 6)::BIGINT AS h,
        coalesce(b.ks, []) AS bk, coalesce(b.ns, []) AS bn
    FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), paths AS (
    SELECT conv_id, list_concat(bk[1:h], ks[h + 1:]) AS ks, list_concat(bn[1:h], ns[h + 1:]) AS ns FROM headed
), steps AS (
    SELECT conv_id, d, len(ks) = d AS ends, array_to_string(ks[1:d], '') AS node, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n
    FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM paths)
), nodes AS (
    SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM steps GROUP BY node
), children AS (
    SELECT substr(node, 1, 40 * (depth - 1)::BIGINT) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
    SELECT substr(n.node, 1, (40 * i)::BIGINT) AS node, sum((c.node IS NULL)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT *, unnest(range(0, depth + 1)) AS i FROM nodes) n LEFT JOIN children c USING (node) GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
    coalesce(c.n_children, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (node) LEFT JOIN children c USING (node)
LEFT JOIN nodes p ON n.depth > 0 AND p.node = substr(n.node, 1, 40 * (n.depth - 1)::BIGINT)
"""

_CLASSES = (r"a-z", r"A-Z", r"0-9", r"\x09-\x0D\x20", r".,;:!?''\x22()\-", r"#*$%&|<>+/=@\[\x5C\]^_\x60{}~", r"\x00-\x08\x0E-\x1F\x7F",
            r"\x{80}-\x{BF}", r"\x{C0}-\x{2BF}", r"\x{2C0}-\x{7FF}", r"\x{800}-\x{2FFF}", r"\x{3000}-\x{FFFF}", r"\x{10000}-\x{10FFFF}")
_COUNTS = ", ".join(f"length(regexp_replace(text, '[^{c}]', '', 'g'))::DOUBLE" for c in _CLASSES)
_DIVERGENCE = """sqrt(greatest(0, least(1, sum(
    CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END / 2 + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END / 2))))"""

RULES = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, lang, text IS NULL AS gone, coalesce(text, '') AS text FROM documents
), split AS (
    SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM docs
), spots AS (
    SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split)
), repeats AS (
    SELECT r, count(DISTINCT k) AS n FROM (
        SELECT r, unnest(range(i, i + 3)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM spots) WHERE c > 1) GROUP BY r
), base AS (
    SELECT r, doc_id, lang, text, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n, 0) AS n_repeat_words, len(w) < {LEAST_WORDS} OR 100 * coalesce(n, 0) > {REPEAT_PERCENT} * len(w) AS base_failed
    FROM split LEFT JOIN repeats USING (r)
), sizes AS (
    SELECT lang, sum(n_words) AS total FROM base WHERE lang IS NOT NULL GROUP BY lang
), langs AS (
    SELECT * FROM sizes WHERE total > 0 AND total >= {LANG_SHARE} * (SELECT sum(total) FROM sizes)
), plain AS (
    SELECT r, lang, CASE WHEN regexp_matches(v, '[a-z\\x{{80}}-\\x{{10FFFF}}]') THEN v ELSE '' END AS v FROM (
        SELECT r, lang, translate(trim(unnest(w), '.,;:!?''"()-'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS v FROM split)
), common AS (
    SELECT lang, v, count(*) AS n, any_value(total) AS total FROM plain JOIN langs USING (lang)
    GROUP BY lang, v HAVING count(*) >= {WORD_SHARE} * any_value(total) OR v = ''
), bins AS (
    SELECT lang, v, n / total AS q FROM common
    UNION ALL SELECT lang, NULL, (any_value(total) - sum(coalesce(n, 0))) / any_value(total)
    FROM (SELECT l.lang, l.total, c.n FROM langs l LEFT JOIN common c USING (lang)) GROUP BY lang
), own AS (
    SELECT r, v, count(*) AS n FROM plain GROUP BY r, v
), met AS (
    SELECT o.r, c.lang, c.v, o.n FROM own o JOIN common c USING (v)
), rest AS (
    SELECT b.r, l.lang, NULL AS v, b.n_words - coalesce(sum(m.n), 0) AS n, any_value(b.n_words) AS size
    FROM base b CROSS JOIN langs l LEFT JOIN met m ON m.r = b.r AND m.lang = l.lang WHERE n_words > 0 GROUP BY b.r, l.lang, b.n_words
), shares AS (
    SELECT s.r, s.lang, CASE WHEN x.v IS NULL THEN s.n ELSE coalesce(m.n, 0) END / s.size AS p, x.q
    FROM rest s JOIN bins x USING (lang) LEFT JOIN met m ON m.r = s.r AND m.lang = s.lang AND m.v = x.v
), word_far AS (
    SELECT r, lang, {_DIVERGENCE} AS far FROM shares GROUP BY r, lang
), classes AS (
    SELECT r, lang, gone, [{_COUNTS}] AS c FROM docs
), lang_classes AS (
    SELECT lang, list(q ORDER BY k) AS q FROM (
        SELECT lang, k, sum(c[k]) / greatest(1, sum(list_sum(c))) AS q FROM (SELECT lang, c, unnest(range(1, {len(_CLASSES) + 1})) AS k FROM classes
            WHERE NOT gone AND lang IN (SELECT lang FROM langs)) GROUP BY lang, k) GROUP BY lang
), class_far AS (
    SELECT r, lang, any_value(size) AS chars, {_DIVERGENCE} AS far FROM (
        SELECT r, l.lang, list_sum(c) AS size, c[k] / list_sum(c) AS p, l.q[k] AS q
        FROM (SELECT r, c, unnest(range(1, {len(_CLASSES) + 1})) AS k FROM classes WHERE list_sum(c) > 0) CROSS JOIN lang_classes l)
    GROUP BY r, lang
), nearest AS (
    SELECT r, min_by({{'lang': lang, 'chars': chars, 'class_far': class_far, 'word_far': word_far}}, (total, lang)) AS best FROM (
        SELECT b.r, l.lang, coalesce(c.chars, 0) AS chars, coalesce(c.far, 0) AS class_far, coalesce(w.far, 0) AS word_far,
            coalesce(c.far, 0) + coalesce(w.far, 0) AS total
        FROM base b CROSS JOIN langs l LEFT JOIN class_far c ON c.r = b.r AND c.lang = l.lang LEFT JOIN word_far w ON w.r = b.r AND w.lang = l.lang)
    GROUP BY r
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, base_failed, best.lang AS nearest,
    NOT base_failed AND (best IS NULL OR (b.lang IS NOT NULL AND b.lang NOT IN (SELECT lang FROM langs)) OR NOT (
        (best.class_far > {CLASS_LIMIT} AND best.chars >= {CLASS_LEAST}) OR (best.word_far > {WORD_LIMIT} AND n_words >= {WORD_LEAST}))) AS kept
FROM base b LEFT JOIN nearest USING (r)
"""

SQL = {"op11_prefix_trie": TRIE, "op13_quality_rules": RULES}
