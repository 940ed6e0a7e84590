"""The registered queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossframe.llm import oracle_sql as O
from lossframe.llm.bpe_fragments import round_trip_digests
from lossframe.llm.collocations import collocations
from lossframe.llm.common import table
from lossframe.llm.digests import span_digest
from lossframe.llm.hard_negatives import hard_negatives
from lossframe.llm.line_dedup import line_report
from lossframe.llm.near_dedup import near_duplicates
from lossframe.llm.packing import pack_documents
from lossframe.llm.pii_crf import BASE_KINDS, FIELD_KINDS, find_pii, train_from
from lossframe.llm.quality_crf import judge, train_line_model
from lossframe.llm.secret_scan import BASE_RULES, MORE_RULES, scan_secrets
from lossframe.llm.substring_dedup import removal_digest, remove_repeats
from lossframe.llm.toxicity import held_out, score_toxicity, train_toxicity
from lossframe.llm.url_filter import SiteRule, Vocabulary, filter_urls
from lossframe.llm.vp_search import nearest

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed rules of the url query, and its vocabulary.
SITE_RULES = (
    SiteRule("org", "/", "allow"),
    SiteRule("example.org", "/es/", "block"),
    SiteRule("example.org", "/en/1", "block"),
    SiteRule("com", "/fr/", "allow"),
    SiteRule("com", "/de/", "block"),
)
VOCABULARY = Vocabulary(
    strict=("casino", "escort", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx"),
    soft=("adult", "bet", "bonus", "cheap", "click", "download", "free", "loan", "offer", "pills", "poker", "prize",
          "promo", "win"),
    soft_limit=2)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return span_digest(found, [r.kind for r in BASE_RULES], [r.kind for r in MORE_RULES])


def op2_parse_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(remove_repeats(table(spark, sf_dir, "documents"), length=100))


def op3_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return span_digest(find_pii(docs, train_from(docs)), BASE_KINDS, FIELD_KINDS)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), SITE_RULES, VOCABULARY)


def op5_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=5, percent=75)


def op6_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"), percent=90, min_words=1)


#: Pruning factor of the search (1 is exact). Recall on the larger check table (64 dimensions): 1.0 up to 2,
#: 0.9998 at 4, 0.979 at 6, 0.909 at 8; vectors of few dimensions lose neighbours sooner, so it is kept low.
RELAX = 1.5


def op7_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10, relax=RELAX)


def op8_bpe_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train_line_model(docs, table(spark, sf_dir, "labels")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", capacity=1024)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 50 == 0, positives=5, negatives=3,
                          low_percent=50, high_percent=95, scale=256.0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), min_count=100, top=2000)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                              (F.col("score") >= 0.7).cast("int").alias("predicted"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_secret_scan, op2_parse_dedup, op3_pii_crf, op4_url_filter, op5_minmax_dedup, op6_line_join, op7_vp_search, op8_bpe_fragments,
                                    op9_quality_crf, op10_packing, op11_hard_negatives, op12_collocations, op13_toxicity)}


def oracle() -> dict[str, str]:
    return {"op4_url_filter": O.URL_FILTER, "op11_hard_negatives": O.HARD_NEGATIVES, "op12_collocations": O.COLLOCATIONS}
