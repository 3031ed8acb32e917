"""DuckDB SQL for the registered queries, each under the query's name."""

op5_url_filters = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), r(rule_host, rule_path, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), d AS (SELECT DISTINCT host, path FROM u),
m AS (
  SELECT host, path, rule_host || rule_path AS rule, v,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, v DESC) AS k
  FROM d JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM u LEFT JOIN m ON m.host = u.host AND m.path = u.path AND m.k = 1
"""

op7_quality_rules = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), p AS (
  SELECT k, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5
), g AS (
  SELECT k, i, array_to_string(w[i:i + 4], ' ') AS s FROM p
), again AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM g) WHERE c > 1
), cover AS (
  SELECT k, count(DISTINCT i + o) AS n FROM again, (SELECT unnest(range(0, 5)) AS o) GROUP BY k
), m AS (
  SELECT d.k, doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cover ON cover.k = d.k
), j AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 12 * n_words AS soft_failed
  FROM m
), h AS (
  SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed OR soft_failed) AS f FROM j GROUP BY host
), prior AS (
  SELECT sum(f) / sum(n) AS mean, var_pop(f / n) AS v FROM h
), bad AS (
  SELECT host FROM h, (SELECT mean, CASE WHEN v > 0 THEN least(1000.0, greatest(2.0, mean * (1 - mean) / v - 1)) ELSE 1000.0 END AS s FROM prior)
  WHERE (f + mean * s) / (n + s) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR (soft_failed AND host IN (SELECT host FROM bad))) AS kept
FROM j
"""

op1_top_k = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_ESCAPED = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'), '[SYS]', '[\\SYS]'), '[/SYS]', '[\\/SYS]'), '[BOT]', '[\\BOT]'), '[ROLE]', '[\\ROLE]'), '[/ROLE]', '[\\/ROLE]')"

op9_chat_format = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, length({_ESCAPED}) + CASE r WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 WHEN 'system' THEN 13 ELSE 18 + length({_ESCAPED.replace('(t,', '(r,')}) END AS n
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
       (3 + sum(n))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

op10_substring_dedup = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT k, doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50
), g AS (
  SELECT k, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS s FROM p
), again AS (
  SELECT k, i FROM (SELECT k, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM g) WHERE m < doc_id
), gone AS (
  SELECT k, list(DISTINCT j) AS g FROM (SELECT k, unnest(range(i, i + 50)) AS j FROM again) GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ') ELSE array_to_string([x FOR x, j IN w IF NOT list_contains(g, j)], ' ') END) AS kept_sha256
FROM d LEFT JOIN gone ON gone.k = d.k
"""

op4_minhash_near_dedup = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT k, doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT k, doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (
  SELECT k, doc_id, count(*) AS n FROM s GROUP BY k, doc_id
), common AS (
  SELECT a.k AS x, b.k AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.k < b.k GROUP BY a.k, b.k
), link AS MATERIALIZED (
  SELECT nx.doc_id AS a, ny.doc_id AS b FROM common JOIN n nx ON nx.k = x JOIN n ny ON ny.k = y
  WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), edge AS MATERIALIZED (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least.b, d.doc_id) AS component_id, coalesce(least.b, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.k = d.k LEFT JOIN least ON least.a = d.doc_id AND n.k IS NOT NULL
"""

op3_license_scan = r"""
WITH t(name, label, notice) AS (
  VALUES ('gpl short', 'gpl', 'This work is licensed under the GNU General Public License, version 3.'),
  ('gpl notice', 'gpl', 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation'),
  ('apache short', 'apache', 'Licensed under the Apache License, Version 2.0.'),
  ('apache notice', 'apache', 'Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License'),
  ('mit short', 'mit', 'Released under the MIT License.'),
  ('mit grant', 'mit', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files'),
  ('cc-by notice', 'cc-by', 'This work is licensed under a Creative Commons Attribution 4.0 International License'),
  ('cc-by-nc short', 'cc-by-nc', 'Licensed under CC BY-NC 4.0.'),
  ('bsd conditions', 'bsd', 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met')
), tw AS (
  SELECT name, label, list_distinct(regexp_extract_all(lower(notice), '[a-z0-9]+')) AS w FROM t
), ph(phrase, label) AS (
  VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')
), d AS (
  SELECT row_number() OVER () AS k, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), p AS (
  SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d
), places AS (
  SELECT k, i - 1 AS place, label FROM p JOIN ph ON w[i:i + len(phrase) - 1] = phrase
), base AS (
  SELECT k, count(*) AS n, min(place) AS a, max(place) AS b, list(DISTINCT label) AS l FROM places GROUP BY k
), blocks AS (
  SELECT k, w[i:i + 63] AS w FROM p WHERE i % 32 = 1
), met AS (
  SELECT k, label, len(list_intersect(tw.w, blocks.w)) / len(tw.w) AS c FROM blocks, tw
  WHERE len(list_intersect(tw.w, blocks.w)) >= ceil(0.9 * len(tw.w) - 1e-9)
), more AS (
  SELECT k, list(DISTINCT label) AS l, max(c) AS c FROM met GROUP BY k
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.a::BIGINT AS first_word, base.b::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(base.l, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.l, []), coalesce(more.l, [])))), ',') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(more.c, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN base ON base.k = d.k LEFT JOIN more ON more.k = d.k
"""

#: CRC-32 of decimal ids, a byte at a time, from a table made by its polynomial.
op11_prefix_trie = """
WITH RECURSIVE crc_table AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list({'d': d, 'n': n} ORDER BY turn NULLS FIRST, role, d, n) AS turns FROM (
        SELECT conv_id, turn, role, md5(length(role) || ':' || role || text) AS d, length(text) AS n FROM turns) GROUP BY conv_id
), heads AS (
    SELECT conv_id, turns, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 6 AS h FROM own, crc_table
), rebuilt AS (
    SELECT a.conv_id, coalesce(b.turns[1:a.h], []) || a.turns[a.h + 1:] AS turns FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100
), members AS (
    SELECT conv_id, d, len(turns) AS size, array_to_string(list_transform(turns[1:d], lambda x: x.d), '') AS key, array_to_string(list_transform(turns[1:d - 1], lambda x: x.d), '') AS above,
        CASE WHEN d = 0 THEN 0 ELSE turns[d].n END AS n
    FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT d, key, any_value(above) AS above, min(conv_id) AS low, count(*) AS n_convs, any_value(n) AS n, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE size = d) AS ends FROM members GROUP BY d, key
), kids AS (
    SELECT d - 1 AS d, above AS key, count(*) AS kids FROM nodes WHERE d > 0 GROUP BY 1, 2
), counted AS (
    SELECT a.*, coalesce(k.kids, 0) AS kids FROM nodes a LEFT JOIN kids k USING (d, key)
), sums AS (
    SELECT m.d, m.key, sum(CASE WHEN w.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((w.n_convs - 1) * w.n) AS saved FROM counted w JOIN members m ON m.conv_id = w.low AND m.d <= w.d GROUP BY 1, 2
)
SELECT a.low AS conv_id, a.d AS depth, p.low AS parent_conv_id, a.n_convs, a.kids AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM counted a JOIN sums s USING (d, key) LEFT JOIN nodes p ON p.d = a.d - 1 AND p.key = a.above AND a.d > 0
"""

op12_phrase_mining = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), f AS MATERIALIZED (
    SELECT lang, words, phrase, count(*)::HUGEINT AS n FROM (
        SELECT lang, 1 AS words, unnest(w) AS phrase FROM w
        UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM w
        UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM w)
    GROUP BY 1, 2, 3
), totals AS (
    SELECT lang, sum(n)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang
), c AS (
    SELECT lang, words, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND n >= 10
), cuts AS (
    SELECT lang, words, phrase, a, w, unnest(range(1, words)) AS k FROM c
), heads AS MATERIALIZED (
    SELECT t.*, f.n AS l FROM cuts t JOIN f ON f.lang = t.lang AND f.phrase = array_to_string(t.w[1:t.k], ' ')
), scored AS MATERIALIZED (
    SELECT t.lang, t.words, t.phrase, t.a, t.k, t.l, f.n AS r, (1000000 * t.a * t.a) // (t.l * f.n) AS score FROM heads t JOIN f ON f.lang = t.lang AND f.phrase = array_to_string(t.w[t.k + 1:], ' ')
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), covers AS (
    SELECT lang, phrase, max(a) AS more FROM (
        SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE words = 3) GROUP BY 1, 2
), kept AS (
    SELECT b.* FROM best b LEFT JOIN covers v USING (lang, phrase) WHERE v.more IS NULL OR 100 * v.more < 50 * b.a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, totals.n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
