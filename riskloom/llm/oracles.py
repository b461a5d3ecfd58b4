"""SQL counterparts, where SQL can express the whole result on whole tables."""

ORACLES = {
    "op5_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h,
                     min(page_id) OVER (PARTITION BY payload) AS first FROM p),
        five AS (SELECT page_id, i, CAST('0x' || substr(h, 1 + 5 * i, 5) AS BIGINT) AS v FROM d, range(8) AS r(i)),
        digest AS (SELECT page_id, string_agg(
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 15) & 31 AS BIGINT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 10) & 31 AS BIGINT) + 1, 1)
            || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> 5) & 31 AS BIGINT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v & 31 AS BIGINT) + 1, 1),
            '' ORDER BY i) AS payload_digest FROM five GROUP BY page_id)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d JOIN digest USING (page_id)""",
    "op12_hard_negatives": r"""
        WITH v AS (
            SELECT row_number() OVER () AS key, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.key AS anchor, a.vec_id AS anchor_id, a.label = r.label AS same, r.key, r.vec_id, CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
            FROM v AS a JOIN v AS r ON a.vec_id % 100 = 0 AND a.key <> r.key AND len(a.x) = len(r.x)),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, key) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id,
               CAST(row_number() OVER (PARTITION BY p.anchor, p.key ORDER BY n.score DESC, n.vec_id, n.key) AS INTEGER) AS rank,
               n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s AS n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
        QUALIFY rank <= 5""",
    "op13_merkle": r"""
        WITH RECURSIVE byte AS (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
            FROM range(256) AS r(i)),
        d AS (
            SELECT doc_id, lang, n_chars, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                   || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
                   coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
                   coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
                       lambda i: CAST(unicode(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
                       lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 7 = 0, false) AS hit
            FROM documents, byte),
        h AS (
            SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') || tail) AS leaf,
                   sha256(head || coalesce(octet_length(encode(CAST(n_chars + 1 AS VARCHAR))) || ':' || (n_chars + 1), '-') || tail) AS altered, hit
            FROM d),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
                   dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM h),
        trees AS (SELECT tree, count(*) AS n FROM leaves GROUP BY tree),
        low AS (
            SELECT 0 AS level, l.tree, l.place, l.leaf AS digest, n AS size FROM leaves AS l JOIN trees USING (tree)
            UNION ALL
            SELECT level + 1, tree, place // 2, sha256(digest || coalesce(beside, '')), (size + 1) // 2
            FROM (SELECT *, lead(digest) OVER (PARTITION BY tree ORDER BY place) AS beside FROM low) WHERE size > 1 AND place % 2 = 0),
        subroots AS (SELECT tree, digest AS subroot, level AS height FROM low WHERE size = 1),
        high AS (
            SELECT 0 AS level, tree AS place, subroot AS digest, (SELECT count(*) FROM trees) AS size FROM subroots
            UNION ALL
            SELECT level + 1, place // 2, sha256(digest || coalesce(beside, '')), (size + 1) // 2
            FROM (SELECT *, lead(digest) OVER (ORDER BY place) AS beside FROM high) WHERE size > 1 AND place % 2 = 0),
        nodes AS (
            SELECT tree, level, place, digest FROM low
            UNION ALL
            SELECT tree, height + 1 + h.level, h.place, h.digest FROM subroots, high AS h),
        climb AS (
            SELECT row_number() OVER () AS k, tree, 0 AS level, place, CASE WHEN hit THEN altered ELSE leaf END AS folded, '' AS proof, doc_id, leaf FROM leaves
            UNION ALL
            SELECT k, c.tree, c.level + 1,
                   CASE WHEN c.level = height THEN c.tree ELSE c.place // 2 END,
                   CASE WHEN c.level = height THEN folded WHEN n.digest IS NULL THEN sha256(folded)
                        WHEN c.place % 2 = 1 THEN sha256(n.digest || folded) ELSE sha256(folded || n.digest) END,
                   CASE WHEN c.level = height THEN proof ELSE proof || coalesce(n.digest, '') END, doc_id, leaf
            FROM climb AS c JOIN subroots AS s ON s.tree = c.tree
            LEFT JOIN nodes AS n ON n.tree = c.tree AND n.level = c.level AND n.place = xor(c.place, 1)
            WHERE c.level < height + 1 + (SELECT max(level) FROM high))
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
        FROM climb AS c JOIN subroots AS s USING (tree), (SELECT digest AS root FROM high WHERE size = 1)
        WHERE c.level = height + 1 + (SELECT max(level) FROM high)""",
}
