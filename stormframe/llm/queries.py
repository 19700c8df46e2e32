"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from stormframe.llm import decontam, line_dedup, lm, merkle, mixing, ngram_join, phrases, pii, shards, suffix, topk, toxicity, warc
from stormframe.llm.common import scratch
from stormframe.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@query(
    "op2_warc_index",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    m AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id, strlen(html) AS n FROM p)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
           CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM m
    """,
)
def _warc(table):
    pages = table("pages")
    index = warc.capture_index(pages, scratch(pages.sparkSession, "archives"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op4_pivot_topk",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
               CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def _topk(table):
    return topk.top_k(table("embeddings"), F.col("vec_id") % 50 == 0, 5)


@query("op7_training_order")
def _shards(table):
    index, _ = shards.materialise(table("documents"))
    return index


@query("op8_toxicity")
def _toxicity(table):
    return toxicity.toxicity(table("documents"), table("labels"))


@query("op9_decontamination")
def _decontaminate(table):
    return decontam.contaminated(table("documents"), table("benchmark"))


@query("op10_mixing")
def _mix(table):
    mixed = mixing.mix_weights(table("documents").select("doc_id", "text", "lang", "source"))
    return mixed.select(
        "doc_id",
        F.col("_source").alias("source_class"),
        F.col("_lang").alias("lang_class"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"),
        F.col("_probability").alias("probability"),
        F.col("_sampled").alias("sampled"),
    )


@query("op3_ngram_jaccard")
def _ngram_jaccard(table):
    return ngram_join.near_copies(table("documents"))


@query("op6_suffix_array")
def _suffix_array(table):
    return suffix.deduplicate(table("documents")).withColumn("repeats", F.col("n_removed") > 0)


@query("op5_lm_scoring")
def _lm(table):
    return lm.score(table("documents"))


@query("op1_line_dedup")
def _lines(table):
    return line_dedup.deduplicate_lines(table("documents"))


@query(
    "op11_merkle_manifest",
    """
    WITH RECURSIVE bits AS (
        SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
               lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
    ), rows_ AS (
        SELECT doc_id, source, text, n_chars, lang, xor(list_reduce(
                   list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
                   lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 AS tampered
        FROM documents, bits
    ), texts AS (SELECT *, text AS as_read FROM rows_ UNION ALL SELECT *, replace(text, chr(10), '') FROM rows_ WHERE tampered),
    hashed AS (
        SELECT doc_id, source, text, as_read, tampered, sha256(
                   coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')
                   || coalesce(strlen(as_read) || ':' || as_read, '-')) AS h
        FROM texts
    ), leaves AS (
        SELECT r.doc_id, dense_rank() OVER (ORDER BY r.source NULLS FIRST) - 1 AS tree,
               row_number() OVER (PARTITION BY r.source ORDER BY r.doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY r.source) AS n,
               r.h AS leaf, coalesce(t.h, r.h) AS shown
        FROM (SELECT DISTINCT doc_id, source, h FROM hashed WHERE text IS NOT DISTINCT FROM as_read) r
        LEFT JOIN (SELECT DISTINCT doc_id, h FROM hashed WHERE text <> as_read) t ON t.doc_id = r.doc_id
    ), nodes AS (
        SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM leaves
        UNION ALL SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY ALL
    ), tops AS (
        SELECT 0 AS lvl, tree AS pos, count(*) OVER () AS n, h FROM nodes WHERE n = 1
        UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY ALL
    ), every_node AS (SELECT * FROM nodes UNION ALL SELECT -1, * FROM tops),
    beside AS (
        SELECT tree, lvl, pos,
               coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
               coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM every_node WHERE n > 1
    ), ways AS (
        SELECT tree AS home, pos AS place, tree, 0 AS lvl, pos, n, shown AS h, '' AS proof FROM leaves
        UNION ALL
        SELECT home, place, CASE WHEN up.n = 1 THEN -1 ELSE w.tree END, CASE WHEN up.n = 1 THEN 0 ELSE w.lvl + 1 END,
               CASE WHEN up.n = 1 THEN home ELSE w.pos // 3 END, CASE WHEN up.n = 1 THEN (SELECT max(n) FROM tops) ELSE up.n END,
               sha256(b.l || w.h || b.r), w.proof || b.l || b.r
        FROM (SELECT home, place, CASE WHEN n = 1 AND tree >= 0 THEN -1 ELSE tree END AS tree, CASE WHEN n = 1 AND tree >= 0 THEN 0 ELSE lvl END AS lvl,
                     CASE WHEN n = 1 AND tree >= 0 THEN home ELSE pos END AS pos, h, proof FROM ways) w
        JOIN beside b ON b.tree = w.tree AND b.lvl = w.lvl AND b.pos = w.pos
        JOIN (SELECT tree, lvl, pos, CASE WHEN tree = -1 AND n = 1 THEN 0 ELSE n END AS n FROM every_node) up
          ON up.tree = w.tree AND up.lvl = w.lvl + 1 AND up.pos = w.pos // 3
    ), done AS (SELECT home, place, arg_max(h, strlen(proof)) AS h, max(proof) AS p, arg_max(proof, strlen(proof)) AS proof FROM ways GROUP BY ALL)
    SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(d.proof) AS proof_sha256, d.h AS folded_root, d.h = t.h AS verified
    FROM leaves v JOIN done d ON d.home = v.tree AND d.place = v.pos JOIN nodes s ON s.tree = v.tree AND s.n = 1 JOIN tops t ON t.n = 1
    """,
)
def _merkle(table):
    docs = table("documents")
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    shown = F.when(tampered & F.col("text").contains("\n"), merkle.leaf(text=F.replace("text", F.lit("\n"), F.lit(""))))
    proved = merkle.proofs(merkle.build(docs, {"shown": shown}), ["shown"])
    proved = proved.withColumn("folded_root", merkle.fold(F.coalesce("shown", "leaf"), F.col("proof")))
    digest = merkle.digest(F.array_join(merkle.siblings(F.col("proof")), ""))
    return proved.select(
        "doc_id", "leaf", "subroot", "root", digest.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


@query(
    "op13_phrases",
    """
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w
        FROM documents
    ), sizes AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM pieces GROUP BY lang),
    spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
    grams AS (
        SELECT lang, w[i:i + k - 1] AS g, k, count(*) AS a
        FROM spots, (VALUES (1), (2), (3), (4), (5)) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
    ), cuts AS (
        SELECT c.lang, c.g, c.k, c.a, s.n, x.k AS cut, x.a AS l, y.a AS r, (1000 * CAST(c.a AS HUGEINT) * s.n) // (CAST(x.a AS HUGEINT) * y.a) AS score
        FROM grams c JOIN sizes s USING (lang) JOIN grams x ON x.lang = c.lang AND x.k < c.k AND x.g = c.g[1:x.k]
        JOIN grams y ON y.lang = c.lang AND y.k = c.k - x.k AND y.g = c.g[x.k + 1:c.k]
    ), lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS i FROM cuts),
    longer AS (
        SELECT DISTINCT lang, g[j:j + k - 1] AS g, a FROM (SELECT lang, g, a, k AS whole, unnest(range(2, k)) AS k FROM grams) x, (VALUES (1), (2), (3), (4)) t(j)
        WHERE j + k - 1 <= whole
    ), kept AS (
        SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score
        FROM lowest c WHERE i = 1 AND NOT EXISTS (SELECT 1 FROM longer y WHERE y.lang = c.lang AND y.g = c.g AND y.a >= c.a)
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM ranked WHERE rank <= 2000
    """,
)
def _phrases(table):
    return phrases.collocations(table("documents"))


@query("op12_personal_data")
def _personal_data(table):
    found = pii.detect(table("documents"))
    opened = F.filter("spans", lambda s: s["open"])

    def listed(spans):
        one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(one, ",")

    def count(kind: str):
        return F.size(F.filter(opened, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.KINDS],
        F.sha2(listed(opened), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["open"])).cast("long").alias("n_disguised"),
    )
