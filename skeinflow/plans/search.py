"""Inverted index, scoring and the search itself."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions.urls import passes_language, url_parts
from skeinflow.functions.words import SKIPPED, STOP_WORDS, indexed_text, stem, stem_lists, stems_of, stripped, tokens, with_stems, word_positions
from skeinflow.operators.ranking import ranked, threshold_set
from skeinflow.sources.tables import table

RESULTS = 200


Limits = dict[str, int]


def indexed_pages(spark: SparkSession, folder: str, done: DataFrame | None = None, english_only: bool = False, limits: Limits | None = None) -> DataFrame:
    """(url, text) of the crawl's pages to index; see ``pages_of``."""
    return pages_of(table(spark, folder, "crawl"), done, english_only, limits)


def pages_of(crawl: DataFrame, done: DataFrame | None = None, english_only: bool = False, limits: Limits | None = None) -> DataFrame:
    """(url, text) of pages to index: of several fetches of an address the last, and none that ``done`` has.

    Pages are whole, and addresses of any length, but where ``limits`` (``words.LIMITS``) are given.
    """
    limits = limits or {}
    crawl = crawl.where("page is not null and url is not null")
    if "url" in limits:
        crawl = crawl.where(F.length("url") <= limits["url"])
    if english_only:
        crawl = crawl.where(passes_language(F.col("url")))
    if done is not None:
        crawl = crawl.join(done.select("url").distinct(), "url", "left_anti")
    last = crawl.groupBy("url").agg(F.max(F.struct("fetched_at", "page_id", "page")).alias("f"))
    parts = url_parts(F.col("url"))
    return last.select("url", stripped(indexed_text(parts["host"], parts["path"], F.col("f.page"), limits.get("page"))).alias("text"))


def _wanted(term: Column, limits: Limits | None) -> Column:
    keep = ~term.isin(*SKIPPED)
    return keep & (F.length(term) <= limits["word"]) if limits and "word" in limits else keep


def word_postings(pages: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(term, url, n, positions) of the words of each page, without skipped ones (and, with limits, very long ones)."""
    each = word_positions(pages, "url", F.col("text"))
    return each.where(_wanted(F.col("term"), limits)).select("term", "url", "n", "positions")


def postings(pages: DataFrame) -> DataFrame:
    """Postings under the word and under its stem; two words of a page with one stem give two postings for it."""
    words = with_stems(word_postings(pages))
    stems = words.where("stem <> term").select(F.col("stem").alias("term"), "url", "n", "positions")
    return words.select("term", "url", "n", "positions").unionByName(stems)


def stem_postings(pages: DataFrame, stems: list[str]) -> DataFrame:
    """The rows of ``postings`` under these terms, without an index of all others.

    The words of a stem begin with all of it but its last two letters, so most tokens are dropped inside the pages, before
    anything is exploded, grouped or stemmed; the exact stems of the words that are left are compared then.
    """
    if not stems:
        return word_postings(pages.limit(0))
    begins = sorted({s[: max(1, len(s) - 2)] for s in stems})

    def near(word: Column) -> Column:
        found = word.startswith(begins[0])
        for b in begins[1:]:
            found = found | word.startswith(b)
        return found

    numbered = F.transform(tokens(F.col("text")), lambda w, i: F.struct(w.alias("term"), (i + 1).cast("int").alias("p")))
    each = pages.select("url", F.inline(F.filter(numbered, lambda x: near(x["term"])))).where(~F.col("term").isin(*SKIPPED))
    words = each.groupBy("term", "url").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("p")).alias("positions"))
    # few words are left, so each is stemmed in place: a join with the stems of the distinct ones would read the pages again
    under = F.array(F.col("term"), stems_of(F.col("term")))
    asked = F.filter(F.array_distinct(under), lambda t: t.isin(*stems))
    return words.select(F.explode(asked).alias("term"), "url", "n", "positions")


def merged_postings(old: DataFrame, new: DataFrame, fetched: DataFrame) -> DataFrame:
    """An old index (term, url, n, positions) with the postings of the pages ``fetched`` (url) replaced by new ones."""
    kept = old.join(fetched.select("url").distinct(), "url", "left_anti")
    return kept.select("term", "url", "n", "positions").unionByName(new.select("term", "url", "n", "positions"))


def rendered(index: DataFrame) -> DataFrame:
    """(key, url): the stored text of a term's postings, each ``url^n p1 p2 ...``, joined by ``~``."""
    one = F.concat_ws("^", "url", F.concat(F.col("n").cast("string"), F.lit(" "), F.array_join(F.col("positions").cast("array<string>"), " ")))
    return index.select(F.col("term").alias("key"), one.alias("p")).groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("p")), "~").alias("url"))


def url_index(spark: SparkSession, folder: str, stemmed: bool = True) -> DataFrame:
    """(term, url): words of the address, host and path, each address once for a term."""
    crawl = table(spark, folder, "crawl").where("url is not null").select("url").distinct()
    parts = url_parts(F.col("url"))
    words = crawl.select("url", F.explode(F.array_distinct(tokens(F.concat_ws(" ", parts["host"], parts["path"])))).alias("term"))
    words = words.where(_wanted(F.col("term"), None))
    if not stemmed:
        return words.select("term", "url")
    return with_stems(words).select(F.col("stem").alias("term"), "url").distinct()


def tokenised(query: str) -> list[str]:
    return re.findall("[a-z0-9]+", query.lower())


def query_words(query: str, stemmed: bool = True) -> list[str]:
    """Words of a query, stemmed; stop words only where there are no others."""
    words = tokenised(query)
    if not all(w in STOP_WORDS for w in words):
        words = [w for w in words if w not in STOP_WORDS]
    return [stem(w) for w in words] if stemmed else words


def scored(index: DataFrame, words: list[str], n_pages: Column, n_words: float, floor: bool = False, stemmed: bool = False) -> DataFrame:
    """(url, tf_idf): over the words of the query, tf * ln(pages / pages with the word) / words.

    ``floor`` has the current job's formula: tf is at least 25, and a word in the address adds 0.1 to it; with ``stemmed``
    the address is compared by the stems of its words.
    """
    asked = sorted(set(words))
    hits = index.where(F.col("term").isin(*asked)).groupBy("term", "url").agg(F.sum("n").alias("tf"))
    # every tf is positive; that it is asked for lets both sides of the join share one exchange
    df = hits.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    both = hits.join(F.broadcast(df), "term")  # as many rows as the query has words
    if floor:
        in_url = url_contains(F.col("url"), F.col("term"), stemmed).cast("int")
        tf = F.greatest(F.col("tf") + in_url * 0.1, F.lit(25.0))
        weight = tf * F.ln(n_pages / 5 * F.col("df")) / n_words
    else:
        weight = F.col("tf") * F.ln(n_pages / F.col("df")) / n_words
    return both.groupBy("url").agg(F.sum(weight).alias("tf_idf"))


def url_contains(url: Column, term: Column | str, stemmed: bool = False) -> Column:
    """Whether an address has the word; with ``stemmed``, whether one of its words has the stem ``term``."""
    words = tokens(url)
    return F.array_contains(stem_lists(words) if stemmed else words, term)


def final_ranks(pageranks: DataFrame) -> DataFrame:
    """(url, pr): the last rank of each address that is not null."""
    return pageranks.where("pr is not null").groupBy("url").agg(F.max_by("pr", "computed_at").alias("pr"))


#: Ways to combine the two scores, by the job that has them; a null score is no result.
COMBINED = {
    "sum": lambda t, p: F.coalesce(p, F.lit(0.0)) + t,
    "weighted": lambda t, p: F.coalesce(p, F.lit(0.0)) * 0.9 + t * 0.1,
    "logs": lambda t, p: F.when(t > 0, F.ln(t)) + F.ln(F.coalesce(p, F.lit(0.1))) * 0.0,
    "search": lambda t, p: F.when(t > 0, F.ln(t)) * 0.95 + F.ln(F.greatest(F.coalesce(p, F.lit(0.1)), F.lit(1e-9))) * 0.05,
}


def combined(scores: DataFrame, ranks: DataFrame, way: str) -> DataFrame:
    both = scores.join(ranks, "url", "left")
    score = COMBINED[way](F.col("tf_idf"), F.col("pr"))
    return both.select("url", "tf_idf", F.coalesce("pr", F.lit(0.0)).alias("pagerank"), score.alias("score")).where("score is not null")


def search(spark: SparkSession, folder: str, query: str, way: str = "search", results: int = RESULTS, index: DataFrame | None = None) -> DataFrame:
    """(rank, url, tf_idf, pagerank, score) of the best pages for a query of words; an ``index`` is one of plain words."""
    words = query_words(query, stemmed=index is None)
    if index is None:
        index = stem_postings(indexed_pages(spark, folder), sorted(set(words)))
    scores = scored(index, words, page_number(spark, folder), max(1.0, float(len(words))))
    return ranked(combined(scores, final_ranks(table(spark, folder, "pageranks")), way), results).select("rank", "url", "tf_idf", "pagerank", "score")


def page_number(spark: SparkSession, folder: str) -> Column:
    """How many pages the index has, from their addresses alone."""
    crawl = table(spark, folder, "crawl").where("page is not null and url is not null")
    return crawl.agg(F.count_distinct("url").cast("double")).scalar()


def in_subset(index: DataFrame, words: list[str], size: int = RESULTS) -> tuple[DataFrame, Column]:
    """The postings of the pages of a threshold set (those where the words occur most), and the number of these pages."""
    hits = index.where(F.col("term").isin(*sorted(set(words))))
    subset = threshold_set(hits.groupBy("url").agg(F.sum("n").alias("n")), size)
    return hits.join(subset.select("url"), "url", "left_semi"), subset.agg(F.count(F.lit(1)).cast("double")).scalar()


def page_title(page: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def response(results: DataFrame, pages: DataFrame) -> DataFrame:
    """(rank, result): one JSON object for each result with domain, url and title."""
    titled = results.join(pages.select("url", "title"), "url", "left")
    item = F.to_json(F.struct(url_parts(F.col("url"))["host"].alias("domain"), "url", F.coalesce("title", F.lit("")).alias("title")))
    return titled.select("rank", item.alias("result"))


def corrected(spark: SparkSession, folder: str, query: str) -> list[str]:
    """The words of a query in their order, each that no page has replaced by its suggestion where there is one; stop words
    stay."""
    words = tokenised(query)
    asked = sorted({*words} - {*STOP_WORDS})
    if not asked:
        return words
    # of the vocabulary only what a suggestion can be: same first letter, at most two letters more or less
    first, sizes = sorted({w[0] for w in asked}), sorted({n for w in asked for n in range(len(w) - 2, len(w) + 3)})
    near = F.filter(tokens(F.col("text")), lambda w: F.substring(w, 1, 1).isin(*first) & F.length(w).isin(*sizes))
    each = indexed_pages(spark, folder).select(F.explode(near).alias("term")).where(_wanted(F.col("term"), None))
    given = spark.createDataFrame([(w,) for w in asked], "word string")
    suggested = {r["word"]: r["suggestion"] for r in spelling(given, each.groupBy("term").agg(F.count(F.lit(1)).alias("n"))).collect()}
    return [suggested.get(w) or w for w in words]


def answer(spark: SparkSession, folder: str, query: str, way: str = "search", results: int = RESULTS) -> DataFrame:
    """(json): the whole response to a query, one row.

    The words are corrected first and ``spellcheck`` has them where they changed; stop words count where there are no
    others; ``results`` has domain, url and title of at most ``results`` pages in their order.
    """
    words = corrected(spark, folder, query)
    best = search(spark, folder, " ".join(words), way, results)
    crawl = table(spark, folder, "crawl").where("page is not null and url is not null")
    pages = crawl.join(best.select("url"), "url", "left_semi")  # titles of the results only
    titles = pages.groupBy("url").agg(F.max(F.struct("fetched_at", "page_id", page_title(F.col("page")).alias("title"))).alias("f")).select("url", F.col("f.title").alias("title"))
    item = F.struct(url_parts(F.col("url"))["host"].alias("domain"), "url", F.coalesce("title", F.lit("")).alias("title"))
    listed = best.join(titles, "url", "left").agg(F.sort_array(F.collect_list(F.struct("rank", item.alias("item")))).alias("l"))
    changed = F.array(*map(F.lit, words)) if " ".join(words) != " ".join(tokenised(query)) else F.lit(None).cast("array<string>")
    return listed.select(F.to_json(F.struct(changed.alias("spellcheck"), F.transform("l", lambda x: x["item"]).alias("results"))).alias("json"))


def spelling(words: DataFrame, vocabulary: DataFrame, most: int = 2) -> DataFrame:
    """(word, suggestion): the word itself where the vocabulary (term, n) has it, else the most frequent term within
    ``most`` edits of the same first letter and a length that allows it; null where there is none."""
    w, v = words.select("word").distinct(), vocabulary.select("term", "n")
    known = w.join(v, w["word"] == v["term"], "left").select("word", "term")
    unknown = known.where("term is null").select("word")
    keys = unknown.select("word", F.substring("word", 1, 1).alias("c"), F.explode(F.sequence(F.length("word") - most, F.length("word") + most)).alias("l"))
    near = keys.join(v.select("term", "n", F.substring("term", 1, 1).alias("c"), F.length("term").alias("l")), ["c", "l"])
    near = near.withColumn("d", F.levenshtein("word", "term", most)).where("d >= 0")
    best = near.groupBy("word").agg(F.min(F.struct("d", -F.col("n"), "term")).alias("b")).select("word", F.col("b.term").alias("best"))
    return known.join(best, "word", "left").select("word", F.coalesce("term", "best").alias("suggestion"))
