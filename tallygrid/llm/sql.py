"""SQL that states the results of those queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

LEDGER = rf"""
numbered AS (SELECT row_number() OVER () AS rn, doc_id, source, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
grams AS (SELECT rn, i, ws[i:i + 2] AS gram FROM (SELECT rn, ws, unnest(range(1, len(ws) - 1)) AS i FROM numbered)),
again AS (SELECT rn, i FROM grams QUALIFY count(*) OVER (PARTITION BY rn, gram) > 1),
covered AS (SELECT rn, count(DISTINCT i + shift) AS n FROM again, (SELECT unnest([0, 1, 2]) AS shift) GROUP BY rn),
lines AS (
    SELECT rn, count(*) AS n, count(DISTINCT line) AS n_distinct
    FROM (SELECT rn, unnest(string_split(t, chr(10))) AS line FROM numbered)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rn),
measured AS (
    SELECT doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0) AS n_lines,
           coalesce(l.n - l.n_distinct, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
           len(list_filter(ws, lambda w: regexp_matches(w, '\p{{L}}')))::BIGINT AS n_letter_words,
           coalesce(list_max(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS longest_word
    FROM numbered LEFT JOIN lines l USING (rn) LEFT JOIN covered c USING (rn)),
ledger AS (
    SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
        + CASE WHEN 10 * n_letter_words < 7 * n_words THEN 64 ELSE 0 END + CASE WHEN longest_word > 1000 THEN 128 ELSE 0 END)::BIGINT AS failed
    FROM measured)"""

SQL: dict[str, str] = {
    "op1_quality_rules": f"""
WITH {LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed & 127 = 0 AS kept, failed
FROM ledger""",
    "quality_rule_ablations": f"""
WITH {LEDGER},
rules(policy, rule, mask, bit) AS (
    SELECT p.policy, r.rule, p.mask, r.bit
    FROM (VALUES ('base', 3), ('v1', 127), ('v2_strict', 255)) p(policy, mask),
         (VALUES ('few_words', 1), ('repeated_words', 2), ('symbol_rate', 4), ('duplicate_lines', 8), ('short_words', 16),
                 ('long_words', 32), ('few_letter_words', 64), ('giant_word', 128)) r(rule, bit)
    WHERE p.mask & r.bit <> 0)
SELECT policy, rule, count(*) FILTER (failed & mask = 0) AS kept, count(*) FILTER (failed & (mask - bit) = 0) AS kept_without,
       count(*) FILTER (failed & mask = bit) AS dropped_alone, count(*) FILTER (failed & bit <> 0) AS failed_rule
FROM ledger, rules GROUP BY policy, rule""",
    "quality_rule_sources": f"""
WITH {LEDGER}
SELECT source, count(*) AS n, bit_or(failed) AS any_failed, bit_and(failed) AS all_failed, avg(bit_count(failed)) AS mean_failures
FROM ledger GROUP BY source""",
    "op7_chat_format": r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, n, who, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, who))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|>' || '<|says|>' || '<|end|>')
           + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op6_pii": rf"""
WITH RECURSIVE kinds(place, kind, pattern, whole, needs) AS (VALUES
    (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', '.*', '@'), (2, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)', '.*', '[0-9]\.[0-9]'),
    (3, 'card', '[0-9](?:[ -]?[0-9])+', '.*', '[0-9]'), (4, 'phone', '\+[0-9][ ().0-9-]+[0-9]', '.*', '\+'),
    -- beginnings; how far a number goes is decided below
    (5, 'iban', '(?:^|[^A-Za-z0-9_])[A-Z]{{2}}[0-9]{{2}}', '.*', '[A-Z]{{2}}[0-9]{{2}}'),
    -- runs between which the pattern cannot match: one matches as a whole or not at all
    (6, 'national_id', '[0-9-]+', '[0-8][0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}', '[0-9]-[0-9]{{2}}-[0-9]'), (7, 'secret', '[A-Za-z0-9]+', '[A-Fa-f0-9]{{32,64}}', '[A-Fa-f0-9]{{32}}')),
numbered AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT rn, t, place, kind, whole, regexp_extract_all(t, pattern) AS found, string_split_regex(t, pattern) AS pieces FROM numbered, kinds
        WHERE regexp_matches(t, needs)),
each AS (
    SELECT rn, t, place, kind, whole, found[i] AS v,
           (list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda m: length(m))), 0))::BIGINT AS s
    FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM cut)),
heads AS (SELECT rn, t, CASE WHEN length(v) > 4 THEN s + 1 ELSE s END AS s FROM each WHERE kind = 'iban'),
-- the longest part of what may be a number that ends before no letter, digit or underscore and passes the check
ibans AS (
    SELECT rn, s, s + max(n) AS e
    FROM (SELECT rn, t, s, n, substr(t, s + 1, n) AS v, upper(regexp_replace(substr(t, s + 1, n), '[^A-Za-z0-9]', '', 'g')) AS plain
          FROM (SELECT *, unnest(range(15, 65)) AS n FROM heads) WHERE s + n <= length(t))
    WHERE regexp_full_match(v, '[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}') AND NOT regexp_matches(substr(t, s + n + 1, 1), '[A-Za-z0-9_]')
      AND list_reduce(list_prepend(0, list_transform(string_split(plain[5:] || plain[1:4], ''), lambda c:
            CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1
    GROUP BY rn, s),
chain AS (
    SELECT rn, min(s) AS s, arg_min(e, s) AS e FROM ibans GROUP BY rn
    UNION ALL SELECT i.rn, min(i.s), arg_min(i.e, i.s) FROM chain c JOIN ibans i ON i.rn = c.rn AND i.s >= c.e GROUP BY i.rn),
matched AS (
    SELECT *, s + length(v) AS e, regexp_replace(v, '[^0-9]', '', 'g') AS digits
    FROM each WHERE kind <> 'iban' AND regexp_full_match(v, whole) AND NOT (kind = 'national_id' AND regexp_matches(v, '^000|^666|-00-|-0000$'))),
passed AS (
    SELECT rn, 5 AS place, 'iban' AS kind, s, e FROM chain
    UNION ALL
    SELECT rn, place, kind, s, e FROM matched
    WHERE CASE kind WHEN 'email' THEN true WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
        WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR TRY_CAST(right('000' || p, 3) AS INTEGER) > 255)) = 0
        WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
            CASE WHEN i % 2 = 1 THEN CAST(reverse(digits)[i] AS INTEGER) ELSE CAST(reverse(digits)[i] AS INTEGER) * 2 % 10 + CAST(reverse(digits)[i] AS INTEGER) * 2 // 10 END)) % 10 = 0
        ELSE regexp_matches(lower(substr(t, greatest(s - 40, 0) + 1, least(s, 40)) || ' ' || substr(t, e + 1, 20)),
            CASE kind WHEN 'secret' THEN 'token|secret|key|passw|credential|auth' ELSE 'ssn|social security|insurance|national' END) END),
summed AS (
    SELECT rn, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone", "iban", "national_id", "secret"))},
           string_agg(kind || ':' || s || ':' || e, ',' ORDER BY place, s) FILTER (place <= 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY place, s) AS spans
    FROM passed GROUP BY rn)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("email", "ip", "card", "phone", "iban", "national_id", "secret"))},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM numbered LEFT JOIN summed USING (rn)""",
    "op8_chosen_path": f"""
WITH RECURSIVE worded AS (SELECT doc_id, {WORDS} AS ws FROM documents),
shingled AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS shingles
    FROM worded WHERE len(ws) > 0),
keyed AS (SELECT doc_id, md5(array_to_string(shingles, chr(10))) AS sid, shingles FROM shingled),
nodes AS (SELECT sid, count(*) AS copies, min(doc_id) AS first_id, any_value(shingles) AS shingles, len(any_value(shingles)) AS n FROM keyed GROUP BY sid),
parts AS (SELECT sid, n, unnest(shingles) AS shingle FROM nodes),
links AS (SELECT a.sid AS a, b.sid AS b FROM parts a JOIN parts b ON a.shingle = b.shingle AND a.sid <> b.sid
          GROUP BY a.sid, b.sid, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
reached AS (SELECT sid AS a, sid AS b FROM nodes UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
classes AS (SELECT r.a AS sid, min(first_id) AS class_id, sum(copies)::BIGINT AS class_size FROM reached r JOIN nodes n ON n.sid = r.b GROUP BY r.a),
counted AS (SELECT nodes.sid, (copies - 1 + coalesce((SELECT sum(o.copies) FROM links JOIN nodes o ON o.sid = links.b WHERE links.a = nodes.sid), 0))::BIGINT AS n_links FROM nodes)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(class_size, 1) AS class_size
FROM documents d LEFT JOIN keyed k USING (doc_id) LEFT JOIN classes USING (sid) LEFT JOIN counted USING (sid)""",
    "op11_phrase_mining": r"""
WITH lowered AS (SELECT row_number() OVER () AS rn, coalesce(lang, 'und') AS lang,
                        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM lowered),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM worded GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
          FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM worded, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k)),
counted AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counted WHERE k > 1),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS first, array_to_string(ws[cut + 1:], ' ') AS rest
         FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)),
scored AS (SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.a * n // (x.f::HUGEINT * y.f))::BIGINT AS score
           FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.first JOIN counted y ON y.lang = c.lang AND y.phrase = c.rest
           JOIN totals t ON t.lang = c.lang
           QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.cut) = 1),
holds AS (SELECT DISTINCT lang, array_to_string(ws[i:i + w - 1], ' ') AS phrase, a
          FROM (SELECT *, unnest(range(1, k - w + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS w FROM candidates))),
free AS (SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM holds h WHERE h.lang = s.lang AND h.phrase = s.phrase AND 100 * h.a >= 100 * s.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM free QUALIFY rank <= 2000""",
    "op12_importance_resampling": r"""
WITH lowered AS (SELECT row_number() OVER () AS rn, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
worded AS (SELECT rn, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lowered),
target AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
spoken AS (SELECT rn, w, count(*) AS times FROM (SELECT rn, unnest(ws) AS w FROM worded) GROUP BY rn, w),
corpus_words AS (SELECT w, sum(times) AS times FROM spoken GROUP BY w),
target_words AS (SELECT w, count(*) AS times FROM target GROUP BY w),
-- the CRC table by its polynomial, then one step a byte
crc_table AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY b) AS tab
              FROM (SELECT unnest(range(256))::BIGINT AS b)),
coded AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM corpus_words UNION SELECT w FROM target_words)),
hashed AS (SELECT w, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
                      lambda c, x: xor(tab[xor(c, x) % 256 + 1], c >> 8)), 4294967295::BIGINT) % 10000)::BIGINT AS bucket FROM coded, crc_table),
summed AS (SELECT bucket, sum(coalesce(c.times, 0))::BIGINT AS s, sum(coalesce(t.times, 0))::BIGINT AS t
           FROM hashed LEFT JOIN corpus_words c USING (w) LEFT JOIN target_words t USING (w) GROUP BY bucket),
gained AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM summed) + 10000)::DOUBLE
                                          / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM summed) + 10000)::DOUBLE)))::BIGINT AS gain FROM summed),
weighed AS (SELECT rn, sum(times * gain)::BIGINT AS weight FROM spoken JOIN hashed USING (w) JOIN gained USING (bucket) GROUP BY rn),
scored AS (SELECT rn, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
           FROM worded LEFT JOIN weighed USING (rn)),
ordered AS (SELECT rn, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM ordered) * 10 // 100 THEN place END AS rank
FROM scored LEFT JOIN ordered USING (rn)""",
    "op13_segment_search": """
WITH vectors AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
                 WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
           FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20""",
}
