"""SQL for DuckDB that gives the rows of queries of the text problems."""

_TERMS = r"""
    pages AS (SELECT DISTINCT page_id, page FROM crawl WHERE page IS NOT NULL),
    terms AS (
        SELECT page_id, unnest(regexp_extract_all(lower(regexp_replace(page, '<[^<>]*(>|\z)', ' ', 'g')), '[a-z0-9]+')) AS term
        FROM pages)"""

#: Graph of words: distinct neighbours within three places to either side.
_SCORES = r"""
    pages AS (SELECT DISTINCT page_id, page FROM crawl WHERE page IS NOT NULL),
    lists AS (SELECT page_id, regexp_extract_all(lower(regexp_replace(page, '<[^<>]*(>|\z)', ' ', 'g')), '[a-z0-9]+') AS t FROM pages),
    terms AS (SELECT page_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS p FROM lists),
    near AS (
        SELECT a.page_id, a.term, count(DISTINCT b.term) AS degree
        FROM terms a JOIN (SELECT page_id, term, p + unnest([-3, -2, -1, 1, 2, 3]) AS p FROM terms) b USING (page_id, p) GROUP BY ALL),
    tf AS (SELECT page_id, term, count(*) AS tf FROM terms GROUP BY ALL),
    df AS (SELECT term, count(*) AS pages FROM tf GROUP BY term),
    scores AS (
        SELECT page_id, term, CAST(tf AS INTEGER) AS tf, CAST(coalesce(degree, 0) AS INTEGER) AS degree, pages,
            round(coalesce(degree, 0) * ln(1 + (SELECT count(*) FROM pages)::DOUBLE / pages), 6) AS score
        FROM tf JOIN df USING (term) LEFT JOIN near USING (page_id, term))"""

SQL = {
    "p1_scores": f"WITH {_SCORES} SELECT page_id, term, tf, degree, pages, score FROM scores",
    "p1_keywords": f"""
        WITH {_SCORES}
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, term) AS INTEGER) AS rank, term, score
        FROM scores QUALIFY rank <= 10""",
    "p1_found": f"""
        WITH {_TERMS},
        tf AS (SELECT page_id, term, count(*) AS n FROM terms GROUP BY page_id, term),
        df AS (SELECT term, count(*) AS d FROM tf GROUP BY term)
        SELECT page_id, term FROM tf JOIN df USING (term) WHERE n >= 4 AND d <= 5""",
    "p3_found": f"""
        WITH {_TERMS},
        df AS (SELECT term, count(DISTINCT page_id) AS d FROM terms GROUP BY term),
        marks AS (
            SELECT term, CASE WHEN d = 1 THEN 'rare' WHEN d * 100 > 40 * (SELECT count(*) FROM pages) THEN 'common' END AS mark
            FROM df)
        SELECT term, mark FROM marks WHERE mark IS NOT NULL""",
    "p3_term_counts": f"""
        WITH {_TERMS},
        df AS (SELECT term, count(*) AS occurrences, count(DISTINCT page_id) AS pages FROM terms GROUP BY term)
        SELECT term, occurrences, pages,
            CASE WHEN pages = 1 THEN 'rare' WHEN pages * 100 > 40 * (SELECT count(*) FROM pages) THEN 'common' END AS mark
        FROM df""",
    "p3_bigrams": f"""
        WITH pages AS (SELECT DISTINCT page_id, page FROM crawl WHERE page IS NOT NULL),
        lists AS (
            SELECT page_id, regexp_extract_all(lower(regexp_replace(page, '<[^<>]*(>|\\z)', ' ', 'g')), '[a-z0-9]+') AS t
            FROM pages),
        grams AS (
            SELECT page_id, 1 AS n, unnest(t) AS term FROM lists
            UNION ALL
            SELECT page_id, 2, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM lists WHERE len(t) > 1),
        df AS (SELECT n, term, count(*) AS occurrences, count(DISTINCT page_id) AS pages FROM grams GROUP BY n, term)
        SELECT n, term, occurrences, pages,
            CASE WHEN pages = 1 THEN 'rare' WHEN pages * 100 > 40 * (SELECT count(*) FROM pages) THEN 'common' END AS mark
        FROM df""",
    "p8_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
