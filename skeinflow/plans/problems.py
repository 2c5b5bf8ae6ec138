"""Queries of the general training-data problems (2 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.operators.hotkeys import body_results, heavy, link_results, with_first_url
from skeinflow.operators.packed import unpack_links
from skeinflow.sources.tables import table

HEAVY_PERCENT = 2


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    links = heavy(link_results(table(spark, folder, "pageranks_temp")), HEAVY_PERCENT)
    bodies = heavy(body_results(table(spark, folder, "crawl")), HEAVY_PERCENT)
    one = links.select(F.lit("pageranks_temp.url").alias("field_name"), "key_value")
    return one.unionByName(bodies.select(F.lit("crawl.page").alias("field_name"), "key_value"))


def p2_link_keys(spark: SparkSession, folder: str) -> DataFrame:
    state = table(spark, folder, "pageranks_temp")
    return with_first_url(link_results(state), state, "seq", "src")


def p2_body_keys(spark: SparkSession, folder: str) -> DataFrame:
    crawl = table(spark, folder, "crawl")
    return with_first_url(body_results(crawl), crawl, "page_id", "url")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return unpack_links(table(spark, folder, "pageranks_temp"))


QUERIES = {f.__name__: f for f in (p2_found, p2_link_keys, p2_body_keys, p5_found)}

#: The links of each distinct seq as SQL: separators before a link become one mark, the parts between marks are trimmed
#: and rid of their quotes.  It holds for fields in which no quoted link has a separator before a slash or a protocol.
LINKS_SQL = r"""
    fields AS (SELECT seq, min(url) AS u FROM pageranks_temp WHERE url IS NOT NULL GROUP BY seq),
    plain AS (SELECT seq, chr(10) || CASE WHEN starts_with(trim(u), '[') THEN replace(u, '\/', '/') ELSE u END AS u FROM fields),
    parts AS (SELECT seq, string_split(regexp_replace(u, '[\s,;|^~\[\]]+(["'']?(https?://|/))', chr(1) || '\1', 'g'), chr(1))[2:] AS p FROM plain),
    each AS (SELECT seq, unnest(range(1, len(p) + 1)) AS pos, regexp_replace(unnest(p), '[\s,;|^~\[\]]+$', '') AS v FROM parts),
    links AS (SELECT seq, CAST(pos AS INTEGER) AS pos, CASE WHEN v[1] IN ('"', '''') THEN replace(replace(v[2:-2], v[1] || v[1], v[1]), '\"', '"') ELSE v END AS link FROM each)"""

SQL = {
    "p5_found": f"WITH {LINKS_SQL} SELECT seq, pos, link FROM links",
    "p2_found": f"""
        WITH {LINKS_SQL},
        pages AS (SELECT DISTINCT page_id, md5(page) AS body FROM crawl WHERE page IS NOT NULL)
        SELECT 'pageranks_temp.url' AS field_name, link AS key_value FROM links GROUP BY link HAVING count(*) * 50 >= (SELECT count(*) FROM links)
        UNION ALL
        SELECT 'crawl.page', body FROM pages GROUP BY body HAVING count(*) * 50 >= (SELECT count(*) FROM pages)""",
    "p2_link_keys": f"""
        WITH {LINKS_SQL}, sources AS (SELECT seq, min(src) AS src FROM pageranks_temp GROUP BY seq)
        SELECT link AS key_value, count(*) AS n, min_by(src, seq) AS first_url FROM links JOIN sources USING (seq) GROUP BY link""",
    "p2_body_keys": """
        WITH pages AS (SELECT DISTINCT page_id, url, md5(page) AS body FROM crawl WHERE page IS NOT NULL)
        SELECT body AS key_value, count(*) AS n, min_by(url, page_id) AS first_url FROM pages GROUP BY body""",
}
