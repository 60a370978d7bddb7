"""The operators over their whole tables, as registered queries."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridtally.llm import contamination, lines, merkle, mixing, packing, quality, resampling, sharding, simhash, spans, toxicity, vectors, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels))


def op2_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.deduplicated(table(spark, sf_dir, "documents"), length=50).drop("spans")


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), vectors.Settings(cosine=0.93))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=8)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score(docs, quality.train(docs, labels))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"), width=16)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_spans, op3_vectors, op4_sharding, op5_warc, op6_simhash, op7_mixing, op8_packing, op9_lines, op10_quality,
              op11_merkle, op12_resampling, op13_contamination)
}

#: CRC-32 in SQL: `crc` has one list, the table of the 256 bytes; a text's bytes are folded over it.
CRC_TABLE = """
        crc AS (
            SELECT list(c ORDER BY i) AS t
            FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
                  FROM range(256) AS r(i))
        )"""


def crc32_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text's UTF-8 bytes, where `crc` is joined."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(length({digits}) // 2), lambda i: CAST('0x' || substr({digits}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c // 256, t[1 + (xor(c, b) & 255)])))"


WORDS_SQL = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

# Trained models (1, 10), a heap over groups (4), a hash that SQL lacks (6) and tokens (8) are no SQL.
ORACLES = {
    "op2_spans": """
        WITH texts AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), windows AS (
            SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, length(h) // 2 - 49)) AS i FROM texts)
        ), first AS (
            SELECT s, min(doc_id) AS least FROM windows GROUP BY s HAVING count(*) > 1
        ), hits AS (
            SELECT w.doc_id, w.i FROM windows w JOIN first f USING (s) WHERE w.doc_id > f.least
        ), bytes AS (
            SELECT doc_id, substr(h, 2 * b + 1, 2) AS v, b FROM (SELECT *, unnest(range(0, length(h) // 2)) AS b FROM texts)
        ), covered AS (
            SELECT b.doc_id, b.b, b.v, coalesce(max(h.i) OVER (PARTITION BY b.doc_id ORDER BY b.b) > b.b - 50, false) AS gone
            FROM bytes b LEFT JOIN hits h ON h.doc_id = b.doc_id AND h.i = b.b
        ), edges AS (
            SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY b), false) AS opens FROM covered
        ), cut AS (
            SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
                   string_agg(v, '' ORDER BY b) FILTER (WHERE NOT gone) AS kept
            FROM edges GROUP BY doc_id
        )
        SELECT t.doc_id, CAST(length(t.h) // 2 AS BIGINT) AS n_bytes, coalesce(c.n_removed, 0) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(c.kept, ''))) AS kept_sha256
        FROM texts t LEFT JOIN cut c USING (doc_id)
    """,
    "op3_vectors": """
        WITH RECURSIVE usable AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93
        ), reach(a, b) AS (
            SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), least AS (
            SELECT a, min(b) AS b FROM reach GROUP BY a
        )
        SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
               least(e.vec_id, coalesce(m.b, e.vec_id)) AS component_id, least(e.vec_id, coalesce(m.b, e.vec_id)) = e.vec_id AS kept
        FROM embeddings e LEFT JOIN least m ON m.a = e.vec_id
    """,
    "op5_warc": """
        WITH payloads AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
        ), coded AS (
            SELECT page_id, html, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
                   translate(concat(to_base(CAST('0x' || substr(hex, 1, 10) AS BIGINT), 32, 8), to_base(CAST('0x' || substr(hex, 11, 10) AS BIGINT), 32, 8),
                                    to_base(CAST('0x' || substr(hex, 21, 10) AS BIGINT), 32, 8), to_base(CAST('0x' || substr(hex, 31, 10) AS BIGINT), 32, 8)),
                             '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
            FROM payloads
        ), judged AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM coded
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> top THEN top END AS refers_to
        FROM judged
    """,
    "op9_lines": """
        WITH lines AS (
            SELECT doc_id, i AS pos, string_split(coalesce(text, ''), chr(10))[i] AS line
            FROM documents, range(1, 1 + len(string_split(coalesce(text, ''), chr(10)))) AS r(i)
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), common AS (
            SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ), judged AS (
            SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> c.top, false) AS gone FROM keyed k LEFT JOIN common c USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op7_mixing": """
        WITH sized AS (
            SELECT doc_id, source,
                   CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS hash
            FROM documents
        ), sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS s,
                   ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
            FROM sized GROUP BY source
        ), ranked AS (
            SELECT *, row_number() OVER o AS k, sum(3 * s) OVER o AS held, sum(w) OVER o AS gone,
                   sum(s) OVER () AS total, sum(w) OVER () AS all_w
            FROM sources WINDOW o AS (ORDER BY CAST(s AS DOUBLE) / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
        ), levels AS (
            SELECT k, s, w, CAST(total - (held - 3 * s) AS DOUBLE) / CAST(all_w - (gone - w) AS DOUBLE) AS level FROM ranked
        ), level AS (
            SELECT level FROM levels WHERE 3 * s >= level * w ORDER BY k LIMIT 1
        ), goals AS (
            SELECT source, s AS source_size, w,
                   CASE WHEN 3 * s < level * w THEN CAST(3 * s AS DOUBLE) ELSE level * w END AS target
            FROM sources, level
        ), based AS (
            SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS base FROM goals
        ), rest AS (
            SELECT *, CASE WHEN base >= 3 THEN 0 ELSE target - base * source_size END AS rest FROM based
        ), atoms AS (
            SELECT source, hash, sum(size) AS size FROM sized GROUP BY source, hash
        ), summed AS (
            SELECT source, hash, size, sum(size) OVER (PARTITION BY source ORDER BY hash ROWS UNBOUNDED PRECEDING) AS until FROM atoms
        ), cut AS (
            SELECT s.source, coalesce(min(s.hash + CASE WHEN r.rest - (s.until - s.size) > s.size / 2.0 THEN 0 ELSE -1 END)
                                      FILTER (WHERE s.until > r.rest), max(s.hash)) AS threshold
            FROM summed s JOIN rest r ON s.source IS NOT DISTINCT FROM r.source GROUP BY s.source
        )
        SELECT d.doc_id, d.size, r.source_size, CAST(r.target AS DOUBLE) AS target,
               CAST(d.size * (r.base + CASE WHEN r.source_size > 0 AND d.hash <= c.threshold THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM sized d JOIN rest r ON d.source IS NOT DISTINCT FROM r.source JOIN cut c ON d.source IS NOT DISTINCT FROM c.source
    """,
    "op11_merkle": f"""
        WITH RECURSIVE {CRC_TABLE}, cells AS (
            SELECT row_number() OVER () AS r, doc_id, text, coalesce('1' || source, '0') AS g,
                   coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                   || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head
            FROM documents
        ), texts AS (
            SELECT *, CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0
                           THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS found
            FROM cells, crc
        ), leaves AS (
            SELECT r, doc_id, g, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                   sha256(head || coalesce(octet_length(encode(found)) || ':' || found, '-')) AS changed
            FROM texts
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves
        ), tree(lvl, g, pos, n, node) AS (
            SELECT 0, g, pos, n, leaf FROM placed
            UNION ALL
            SELECT lvl + 1, g, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lvl, g, pos // 16, n
        ), subroots AS (
            SELECT g, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
        ), top(lvl, pos, n, node) AS (
            SELECT 0, pos, n, subroot FROM subroots
            UNION ALL
            SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 16, n
        ), nodes AS (
            SELECT p.r, t.lvl, t.pos, t.node, CAST(p.pos // CAST(pow(16, t.lvl) AS BIGINT) AS BIGINT) AS own
            FROM placed p JOIN tree t ON t.g = p.g AND t.n > 1 AND t.pos // 16 = p.pos // CAST(pow(16, t.lvl + 1) AS BIGINT)
            UNION ALL
            SELECT p.r, 100 + t.lvl, t.pos, t.node, CAST(s.pos // CAST(pow(16, t.lvl) AS BIGINT) AS BIGINT) AS own
            FROM placed p JOIN subroots s ON s.g = p.g JOIN top t ON t.n > 1 AND t.pos // 16 = s.pos // CAST(pow(16, t.lvl + 1) AS BIGINT)
        ), steps AS (
            SELECT r, row_number() OVER (PARTITION BY r ORDER BY lvl) AS step, coalesce(string_agg(node, '' ORDER BY pos) FILTER (WHERE pos < own), '') AS l,
                   coalesce(string_agg(node, '' ORDER BY pos) FILTER (WHERE pos > own), '') AS r_
            FROM nodes GROUP BY r, lvl
        ), proofs AS (
            SELECT r, sha256(string_agg(l || r_, '' ORDER BY step)) AS proof, max(step) AS last FROM steps GROUP BY r
        ), fold(r, step, node) AS (
            SELECT r, CAST(0 AS BIGINT), changed FROM leaves
            UNION ALL
            SELECT f.r, s.step, sha256(s.l || f.node || s.r_) FROM fold f JOIN steps s ON s.r = f.r AND s.step = f.step + 1
        )
        SELECT p.doc_id, p.leaf, s.subroot, (SELECT node FROM top WHERE n = 1) AS root, coalesce(q.proof, sha256('')) AS proof_sha256, f.node AS folded_root,
               f.node = (SELECT node FROM top WHERE n = 1) AS verified
        FROM placed p JOIN subroots s USING (g) LEFT JOIN proofs q ON q.r = p.r JOIN fold f ON f.r = p.r AND f.step = coalesce(q.last, 0)
    """,
    "op12_resampling": f"""
        WITH {CRC_TABLE}, docs AS (
            SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents
        ), items AS (
            SELECT {WORDS_SQL} AS w FROM benchmark
        ), doc_features AS (
            SELECT r, array_to_string(w[i : i + k - 1], ' ') AS f
            FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
        ), item_features AS (
            SELECT array_to_string(w[i : i + k - 1], ' ') AS f
            FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
        ), hashed AS (
            SELECT f, {crc32_sql("f")} % 10000 AS bucket FROM (SELECT f FROM doc_features UNION SELECT f FROM item_features), crc
        ), buckets AS (
            SELECT b.bucket, coalesce(s.n, 0) AS s, coalesce(t.n, 0) AS t
            FROM (SELECT unnest(range(10000)) AS bucket) b
            LEFT JOIN (SELECT bucket, count(*) AS n FROM doc_features JOIN hashed USING (f) GROUP BY bucket) s USING (bucket)
            LEFT JOIN (SELECT bucket, count(*) AS n FROM item_features JOIN hashed USING (f) GROUP BY bucket) t USING (bucket)
        ), gains AS (
            SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE)
                                                / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain
            FROM buckets
        ), weights AS (
            SELECT r, count(*) AS n, sum(gain) AS weight FROM doc_features JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY r
        ), scored AS (
            SELECT d.r, d.doc_id, len(d.w) AS n_words, coalesce(w.n, 0) AS n_features, CAST(coalesce(w.weight, 0) AS BIGINT) AS weight,
                   CAST(coalesce(w.weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5)
                                                                    / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
            FROM docs d LEFT JOIN weights w USING (r)
        ), ranked AS (
            SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20
        )
        SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN k.rank <= 5 * k.n // 100 THEN k.rank END AS rank
        FROM scored s LEFT JOIN ranked k USING (r)
    """,
    "op13_contamination": f"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents
        ), items AS (
            SELECT item_id, {WORDS_SQL} AS w FROM benchmark
        ), phrases AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[j : j + 9], ' ') AS phrase
            FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS j FROM items WHERE len(w) > 0)
        ), runs AS (
            SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase
            FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM docs, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n)
        ), found AS (
            SELECT DISTINCT u.r, u.s, u.n, p.item_id FROM runs u JOIN phrases p ON p.n = u.n AND p.phrase = u.phrase
        ), hit AS (
            SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS pos FROM found) GROUP BY r
        ), named AS (
            SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r
        )
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
               sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
        FROM docs d LEFT JOIN hit h USING (r) LEFT JOIN named i USING (r)
    """,
}
