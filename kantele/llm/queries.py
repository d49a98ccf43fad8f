"""Queries opN_<name> over the driver's tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .simhash_sql import simhash_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy longest-match token counts of every document."""
    from .tokencount import LongestMatch, token_counts, vocabulary

    automaton = LongestMatch(vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    return token_counts(table(spark, sf_dir, "documents"), automaton)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    from .toxicity import fit, score_documents

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document: benchmark passages against all documents."""
    from .lmscore import Difference, score_documents

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, Difference.fit(table(spark, sf_dir, "benchmark"), docs))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids, their decoding and spans of every document, as digests."""
    from .spm import digest_documents

    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to a store and read back."""
    from .tokenfile import write_store

    return write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).documents()


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from .html import extract

    return extract(table(spark, sf_dir, "pages"))

# The pages of the table hold their main text in one article of headings and paragraphs.
OP7_SQL = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') as inside from pages),
b as (select page_id, url, list_transform(regexp_split_to_array(inside, '</?(p|h1)>'),
    lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))) as blocks from a),
t as (select page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) as raw from b),
d as (select page_id, url, regexp_replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g') as text from t)
select page_id, url, text, length(text)::bigint as n_chars from d
"""


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector against all."""
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", repeats=True)


OP8_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x)
  where q.vec_id % 50 = 0
)
select query_id, cast(rank as int) as rank, vec_id, cast(score as bigint) as score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 5
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    from .quality import fit, judge

    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op9_quality_rules: all columns but the trees' verdict."""
    return op9_quality_rules(spark, sf_dir).drop("kept", "quality")


WORD = r"[^\x20\x09-\x0D]"
QUALITY_BASE_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}+') as w from documents),
u as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
t as (select doc_id, i, word as a, lead(word, 1) over o as b, lead(word, 2) over o as c from u window o as (partition by doc_id order by i)),
r as (select doc_id, unnest(list(i)) as i from t where c is not null group by doc_id, a, b, c having count(*) > 1),
p as (select doc_id, count(distinct i + k) as n from r, (values (0), (1), (2)) as s(k) group by doc_id),
b as (select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines, coalesce(p.n, 0)::bigint as n_repeat_words
  from d left join p on p.doc_id = d.doc_id)
select doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
from b
"""


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op1_token_counts: the words of every document."""
    return op1_token_counts(spark, sf_dir).select("doc_id", "n_words")


WORD_COUNTS_SQL = f"""
select doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}+'))::bigint as n_words from documents
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_toxicity, op3_packing, op4_lm_scores, op5_sentencepiece, op6_token_files, op7_main_text, op8_top_k, op9_quality_rules, op10_simhash, quality_base, word_counts)
}
ORACLE_SQL: dict[str, str] = {"op7_main_text": OP7_SQL, "op8_top_k": OP8_SQL, "op10_simhash": simhash_sql(), "quality_base": QUALITY_BASE_SQL, "word_counts": WORD_COUNTS_SQL}
