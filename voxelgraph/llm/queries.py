"""The numbered queries over documents: each applies one operator, with production parameters, to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgraph.llm import cover_tree, exact_dedup, language, mixing, packing, prefix_trie, quality, repeats, rules, simhash, toxicity, wand

#: Target shares of the mixture.
WEIGHTS = {"clean": 0.94, "low": 0.03, "toxic": 0.03}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), added=packing.added_tokens())


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, docs)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.substring_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_documents(read(spark, sf_dir, "documents"), mixing.quality_domains(read(spark, sf_dir, "labels")), WEIGHTS)
    return mix.rates.select("doc_id", "tokens", "p", "rate", "n_taken")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wand.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(read(spark, sf_dir, "embeddings"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_factorization_toxicity": op1,
        "op2_chunk_recipes": op2,
        "op3_simhash_variants": op3,
        "op4_sum_of_squares_packing": op4,
        "op5_winnowed_lines": op5,
        "op6_subword_quality": op6,
        "op7_isolation_rules": op7,
        "op8_kernel_language": op8,
        "op9_seed_and_extend": op9,
        "op10_soft_mixing": op10,
        "op11_wand_shards": op11,
        "op12_cover_tree": op12,
        "op13_family_first_trie": op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chunk_recipes": """
            WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
            g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
            SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
            FROM t JOIN g USING (text)""",
        "op5_winnowed_lines": r"""
            WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
            l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
            w AS (SELECT doc_id, pos, 2 AS span, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM l
                  UNION ALL SELECT doc_id, pos, 1, line FROM l WHERE length(line) >= 80),
            f AS (SELECT *, row_number() OVER (PARTITION BY span, run ORDER BY doc_id, pos) AS n FROM w WHERE regexp_matches(run, '[^\x20\x09-\x0D]')),
            c AS (SELECT DISTINCT doc_id, pos + k AS pos FROM f, range(2) AS r(k) WHERE n > 1 AND k < span)
            SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
                   sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '')) AS kept_sha256
            FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id""",
        "op9_seed_and_extend": r"""
            WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
            w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
            f AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g),
            c AS (SELECT DISTINCT w.doc_id, w.i + k AS pos FROM w JOIN f USING (g), range(13) AS r(k) WHERE w.doc_id > f.low),
            x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
            k AS (SELECT x.doc_id, count(*) AS n_words, count(c.pos) AS n_removed,
                         string_agg(x.word, ' ' ORDER BY x.pos) FILTER (WHERE c.pos IS NULL) AS kept
                  FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.pos = c.pos GROUP BY x.doc_id)
            SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
            FROM d LEFT JOIN k USING (doc_id)""",
        "op11_wand_shards": r"""
            WITH q AS (SELECT row_number() OVER () AS item, item_id, coalesce(text, '') AS text FROM benchmark), d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
            a AS (SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM q),
            t AS (SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
            n AS (SELECT rid, count(*) AS n FROM t GROUP BY rid), s AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM n),
            f AS (SELECT rid, doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM a) GROUP BY ALL),
            w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
            i AS (SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt))) AS impact FROM f JOIN n USING (rid) JOIN w USING (term), s),
            r AS (SELECT item, item_id, rid, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM a JOIN i USING (term) GROUP BY ALL HAVING sum(impact) > 0)
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r
            QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) <= 10""",
        "op12_cover_tree": """
            WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
            u AS (SELECT vec_id, x FROM v WHERE len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_inner_product(x, x) > 0),
            l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
            r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
            c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
            SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c USING (vec_id)""",
        "op13_family_first_trie": r"""
            WITH t AS (SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn,
                              len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
            o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i FROM t),
            c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, conv_id::VARCHAR AS s FROM (SELECT DISTINCT conv_id FROM o)),
            h AS (SELECT conv_id, base, xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: ord(substr(s, i, 1))::BIGINT),
                      lambda a, b: list_reduce(range(8), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, b)), 4294967295::BIGINT), 4294967295) % 4 AS h FROM c),
            b AS (SELECT h.*, (SELECT count(*) FROM o WHERE o.conv_id = h.base AND o.i <= h.h) AS taken FROM h),
            r AS (SELECT b.conv_id, o.i AS d, o.digest, o.words FROM b JOIN o ON o.conv_id = b.base AND o.i <= b.h
                  UNION ALL SELECT b.conv_id, b.taken + o.i - b.h, o.digest, o.words FROM b JOIN o ON o.conv_id = b.conv_id AND o.i > b.h),
            p AS (SELECT conv_id, d, words, list(digest) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r
                  UNION ALL SELECT conv_id, 0, 0, CAST([] AS VARCHAR[]) FROM b),
            e AS (SELECT conv_id, max_by(path, d) AS path FROM p GROUP BY conv_id),
            n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY path, d),
            k AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
            m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
            s AS (SELECT v.path, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved FROM m v JOIN m u ON u.d >= v.d AND u.path[1:v.d] = v.path GROUP BY v.path),
            z AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM e GROUP BY path)
            SELECT m.conv_id, m.d::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(z.ends, '')) AS ends_sha256
            FROM m JOIN s USING (path) LEFT JOIN z USING (path) LEFT JOIN m q ON m.d > 0 AND q.d = m.d - 1 AND q.path = m.path[1:m.d - 1]""",
    }
