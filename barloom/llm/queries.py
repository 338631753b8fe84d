"""The registered queries of this package, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    alignment, exact_dedup, fingerprints, kd_search, lexical, mixing, ngram_join, pii, quality, secret_scan, sentence_pieces, sharding, token_counts)

# Target weights of the production mix; sources without one share OTHER_WEIGHT.
WEIGHTS = {"src0": 0.16, "src1": 0.08, "src2": 0.08, "src3": 0.08, "src4": 0.06, "src5": 0.06, "src6": 0.06, "src7": 0.06}
OTHER_WEIGHT = 0.36
BLOCK_CHARS = 16_384
SHARDS = 24
TOP = 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.interleave(documents(spark, sf_dir), WEIGHTS, OTHER_WEIGHT, BLOCK_CHARS, carry=["doc_id", "source"])
    return placed.select("row.*", "mix_source", "size", "block", "slot", F.col("release").alias("release_slot"),
                         F.col("due").alias("due_slot"), F.col("at").alias("offset_in_block"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir)).drop("text_tag")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir)).drop("findings")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar_sets(documents(spark, sf_dir), width=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after four edits: a passage replaced by the document's beginning, a word put
    in, the first characters removed, and a line added at the end."""
    n = F.length("text")
    edits = F.array(*[F.struct(F.expr(at).cast("int").alias("at"), F.lit(removed).alias("removed"), text.alias("inserted")) for at, removed, text in (
        ("length(text) div 3", 40, F.substring("text", 1, 24)), ("length(text) * 2 div 3", 0, F.lit(" inserted")),
        ("0", 5, F.lit("")), ("length(text) + 1000", 0, F.lit("\nThe last line.")))])
    return token_counts.count_tokens(documents(spark, sf_dir), token_counts.load(token_counts.VOCABULARY), F.when(n > 0, edits))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir), SHARDS)


def op9_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ranking = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs, ranking)


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(documents(spark, sf_dir), sentence_pieces.load(sentence_pieces.MODEL))


def op11_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return kd_search.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), TOP)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, model = (sentence_pieces.load(path) for path in (alignment.VOCABULARY, sentence_pieces.MODEL))
    return alignment.align_tokenizers(documents(spark, sf_dir), vocabulary, model)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), TOP)


QUERIES = {f.__name__: f for f in (
    op1_source_mixing, op2_exact_dedup, op3_secret_scan, op4_ngram_jaccard_join, op5_personal_data, op6_token_counts,
    op7_fingerprints, op8_sharding, op9_quality_ranking, op10_sentence_pieces, op11_top_k_search, op12_tokenizer_alignment,
    op13_lexical_search)}

ORACLES = {
    "op2_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
                   FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op4_ngram_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END) AS shingle FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
        sets AS (SELECT md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS class, doc_id FROM s GROUP BY doc_id),
        reps AS (SELECT min(doc_id) AS doc_id FROM sets GROUP BY class),
        r AS (SELECT * FROM s WHERE doc_id IN (SELECT doc_id FROM reps)),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM r a JOIN r b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
                 UNION SELECT min(doc_id) OVER (PARTITION BY class), doc_id FROM sets),
        edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, q.component_id,
               CASE WHEN n.n IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY coalesce(sets.class, d.doc_id::VARCHAR)) END AS class_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN sets USING (doc_id)
        JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) q USING (doc_id)""",
    "op11_top_k_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 20""",
    "op13_lexical_search": """
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM documents),
        f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
        l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY ALL),
        c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM l),
        m AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // terms AS m FROM l, c),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark),
        s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
              FROM q JOIN f USING (term) JOIN m USING (doc_id) JOIN w USING (term) GROUP BY ALL)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 20""",
}
