"""Queries of the text problems."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm import boilerplate, markup, mix, pieces, stuffing, terms, tokens
from skeinflow.operators.pruning import pruned_semi
from skeinflow.sources.tables import crawled_bodies, table

MIN_TF, MAX_PAGES = 4, 5


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Of all terms of a page, scored without limits, those that score at least as a repeated rare term can; then the
    exact limits."""
    bodies = crawled_bodies(table(spark, folder, "crawl"))
    scored = terms.distinctive_terms(bodies)
    # a term that occurs twice in a page has a neighbour; with pages <= 5 its score is at least ln(1 + all / 5) >= ln 2
    return scored.where((F.col("score") >= math.log(2) - 1e-9) & (F.col("tf") >= MIN_TF) & (F.col("pages") <= MAX_PAGES)).select("page_id", "term")


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    scores = terms.distinctive_terms(crawled_bodies(table(spark, folder, "crawl")))
    return scores.withColumn("score", F.round("score", 6))


def p1_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most distinctive terms of each page."""
    return terms.keywords(terms.distinctive_terms(crawled_bodies(table(spark, folder, "crawl"))))


def _term_counts(spark: SparkSession, folder: str, *lengths: int) -> DataFrame:
    """Counts of n-grams, from suffix arrays two terms deep."""
    return terms.marked(terms.gram_counts(crawled_bodies(table(spark, folder, "crawl")), max_n=2, lengths=lengths))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _term_counts(spark, folder, 1).where("mark is not null").select("term", "mark")


def p3_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _term_counts(spark, folder, 1).select("term", "occurrences", "pages", "mark")


def p3_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    return _term_counts(spark, folder, 1, 2).select("n", "term", "occurrences", "pages", "mark")


def _addressed_bodies(pages: DataFrame) -> DataFrame:
    """(page_id, page, url) of every crawled page: as crawled_bodies, with the page's least url."""
    return pages.where("page is not null").groupBy("page_id").agg(F.min("page").alias("page"), F.min("url").alias("url"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    shares = stuffing.stuffed_shares(table(spark, folder, "crawl").where("page is not null"))
    return shares.where(F.col("share") > stuffing.MOST).select("page_id")


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.stuffed_shares(table(spark, folder, "crawl").where("page is not null"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "crawl").select("page_id", "page", "url").where("page is not null")
    wanted = pruned_semi(pages, table(spark, folder, "body_queue"), "page_id")
    return boilerplate.main_bodies(_addressed_bodies(wanted), pages)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Content and frame alike."""
    return markup.page_elements(table(spark, folder, "crawl")).select("page_id", "elem_no", "kind", "content")


def p7_main_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Without the elements of site frames, as the tag-path ratios tell them."""
    return markup.page_elements(table(spark, folder, "crawl")).where("main").drop("main")


def p7_texts(spark: SparkSession, folder: str) -> DataFrame:
    return markup.clean_texts(crawled_bodies(table(spark, folder, "crawl")))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"))


def p8_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.decode(tokens.encode(table(spark, folder, "documents")))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return mix.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_oversized(table(spark, folder, "documents"), table(spark, folder, "piece_limits"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_scores, p1_keywords, p3_found, p3_term_counts, p3_bigrams, p4_found, p4_shares, p6_found, p7_found, p7_main_elements, p7_texts, p8_ids, p8_round_trip, p9_mix, p9_report, p10_pieces)
}
