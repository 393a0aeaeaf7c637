"""Queries of the training-data operators and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import lines, minhash, packing, paragraphs, pieces, quality, rules, suffixes, tokens, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ids=False)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.digests(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.quality_rules(docs, rules.fitted(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_line_dedup": op3_line_dedup,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_quality_rules": op10_quality_rules,
}

_REACHED = """, r as (select doc as id, doc as c from n union select l.b, r.c from r join l on l.a = r.id), m as (select id, min(c) as component_id from r group by 1)"""

ORACLE_SQL: dict[str, str] = {
    "op4_minhash_near_dedup": r"""with recursive w as (select doc_id as doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from w),
n as (select w.doc, count(s.s) as n from w left join s using (doc) group by 1),
o as (select x.doc as a, y.doc as b, count(*) as k from s x join s y on x.s = y.s and x.doc <> y.doc group by 1, 2),
l as (select o.a, o.b from o join n x on x.doc = o.a join n y on y.doc = o.b where 100 * o.k >= 75 * (x.n + y.n - o.k))""" + _REACHED + """
select n.doc as doc_id, n.n as n_shingles, m.component_id, n.doc = m.component_id as kept from n join m on m.id = n.doc""",
    "op9_embedding_near_dedup": """with recursive n as (select vec_id as doc from embeddings), v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings where label is not null and embedding is not null),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93)""" + _REACHED + """
select n.doc as vec_id, (select count(*) from l where l.a = n.doc) as n_links, m.component_id, n.doc = m.component_id as kept from n join m on m.id = n.doc""",
}
