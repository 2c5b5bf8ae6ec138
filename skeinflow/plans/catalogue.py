"""One query for each operator of the keyed tables, bags, pairs, functions and jobs, with SQL for DuckDB beside it.

The SQL gives the same rows from the same tables.  Queries without SQL are random, iterate to convergence or need the
stemmer; tests check those against brute force.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinflow.functions import urls as U
from skeinflow.functions import words as W
from skeinflow.operators import keyed as K
from skeinflow.operators import ranking as R
from skeinflow.operators import crawling as C
from skeinflow.operators.collections import Bag, Context, Pairs
from skeinflow.operators.packed import unpack_links
from skeinflow.plans import graph as G
from skeinflow.plans import search as S
from skeinflow.plans.problems import LINKS_SQL
from skeinflow.plans.stem_sql import stem_ctes
from skeinflow.session import shared_folder
from skeinflow.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _writes(s: SparkSession, d: str) -> DataFrame:
    """events as writes: row user_id, column event_type, last by event_id."""
    return table(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("col"), "value", F.col("event_id").alias("seq"))


def _types(s: SparkSession, d: str) -> Bag:
    return Bag(table(s, d, "events").select("event_type"))


def _orders(s: SparkSession, d: str) -> Pairs:
    return Pairs(table(s, d, "orders").select("o_custkey", "o_orderpriority"))


def _segments(s: SparkSession, d: str) -> Pairs:
    return Pairs(table(s, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment"))


# ---------------------------------------------------------------- keyed tables


@query("SELECT c_custkey AS key, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def k1_scan(s, d):
    return K.scan(table(s, d, "customer").withColumnRenamed("c_custkey", "key"))


@query("SELECT row_key AS key, url FROM crawl WHERE row_key >= 'g' AND row_key < 'n'")
def k2_range_scan(s, d):
    return K.scan(table(s, d, "crawl").select(F.col("row_key").alias("key"), "url"), "g", "n")


@query("SELECT * FROM orders WHERE o_orderkey = 7")
def k3_get_row(s, d):
    return K.get_row(table(s, d, "orders"), 7, "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def k4_get_cell(s, d):
    return K.get_cell(table(s, d, "orders"), 7, "o_totalprice", "o_orderkey")


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def k5_exists(s, d):
    rich = table(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("key"))
    return K.existing(table(s, d, "customer").select(F.col("c_custkey").alias("key")), rich)


@query("SELECT user_id AS key, event_type AS col, max_by(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def k6_put(s, d):
    return K.last_writes(_writes(s, d))


@query("""SELECT n_nationkey AS key, CASE WHEN n_regionkey = 1 THEN upper(n_name) ELSE n_name END AS name FROM nation""")
def k7_put_row(s, d):
    old = table(s, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    new = table(s, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("key"), F.upper("n_name").alias("name"))
    return K.put_rows(old, new)


@query("SELECT count(DISTINCT user_id) AS n FROM events")
def k8_count(s, d):
    return K.count_keys(_writes(s, d))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def k9_persist(s, d):
    store = K.Store(s, f"{shared_folder(s)}/store-{uuid.uuid4().hex}", prefix="k9_")
    store.put_table("supplier", table(s, d, "supplier"))
    store.persist("supplier")
    return store.scan("supplier")


@query("""SELECT src AS key, rank1, n FROM pageranks_temp WHERE src IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY src ORDER BY seq DESC) = 1""")
def k10_recovery(s, d):
    log = table(s, d, "pageranks_temp").where("src is not null").select(F.col("src").alias("key"), "rank1", "n", F.col("seq").alias("pos"))
    return K.recovered(log)


@query("SELECT 'renamed' AS name, count(DISTINCT r_regionkey) AS n_keys, false AS persistent FROM region")
def k11_rename(s, d):
    store = K.Store(s, prefix="k11_")
    store.put_table("first", table(s, d, "region").withColumnRenamed("r_regionkey", "key"))
    store.delete("renamed")
    store.rename("first", "renamed")
    return store.described()


@query("SELECT 'kept' AS name, count(DISTINCT r_regionkey) AS n_keys, false AS persistent FROM region")
def k12_delete(s, d):
    store = K.Store(s, prefix="k12_")
    for name in ("gone", "kept"):
        store.put_table(name, table(s, d, "region").withColumnRenamed("r_regionkey", "key"))
    store.delete("gone")
    return store.described()


@query("""SELECT 'nations' AS name, count(DISTINCT n_nationkey) AS n_keys, false AS persistent FROM nation UNION ALL
    SELECT 'regions', count(DISTINCT r_regionkey), true FROM region""")
def k13_list_tables(s, d):
    store = K.Store(s, f"{shared_folder(s)}/store-{uuid.uuid4().hex}", prefix="k13_")
    store.put_table("nations", table(s, d, "nation").withColumnRenamed("n_nationkey", "key"))
    store.put_table("regions", table(s, d, "region").withColumnRenamed("r_regionkey", "key"))
    store.persist("regions")
    return store.described()


@query("""SELECT CAST(c_custkey AS VARCHAR) AS key, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 20""")
def k14_view_page(s, d):
    return K.viewed_page(table(s, d, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_mktsegment"), 2)


@query("""WITH last AS (SELECT user_id AS key, event_type AS col, max_by(value, event_id) AS value FROM events GROUP BY ALL),
    p AS (SELECT DISTINCT key FROM last ORDER BY key LIMIT 10 OFFSET 10)
    SELECT CAST(key AS VARCHAR) AS key, coalesce(round(max(value) FILTER (col = 'click'), 6), -1) AS click, coalesce(round(max(value) FILTER (col = 'purchase'), 6), -1) AS purchase,
        coalesce(round(max(value) FILTER (col = 'view'), 6), -1) AS view FROM last WHERE key IN (SELECT key FROM p) GROUP BY key""")
def k14_view_cells(s, d):
    """A page of rows that have different columns."""
    shown = K.viewed_cells(_writes(s, d), 1)
    cell = lambda c: F.coalesce(F.round(F.expr(f"try_cast({c} as double)"), 6), F.lit(-1.0)).alias(c)
    return shown.select("key", cell("click"), cell("purchase"), cell("view"))


@query("SELECT n_nationkey AS key, n_name FROM nation UNION SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation)")
def k16_copy(s, d):
    store = K.Store(s, prefix="k16_")
    store.put_table("a", table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), "n_name"))
    store.put_table("b", table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("n_name")))
    store.copy("a", "b")
    return store.scan("b")


@query("""WITH last AS (SELECT user_id AS key, event_type AS col, max_by(value, event_id) AS value FROM events GROUP BY ALL)
    SELECT key, max(CASE WHEN col = 'click' THEN value END) AS click, max(CASE WHEN col = 'purchase' THEN value END) AS purchase
    FROM last GROUP BY key""")
def k17_rows(s, d):
    return K.wide(_writes(s, d), ["click", "purchase"])


# ---------------------------------------------------------------- sources, sinks, actions


@query("SELECT unnest(['b', 'a', 'b', 'c']) AS value")
def d1_parallelize(s, d):
    return Context(s).parallelize(["b", "a", "b", "c"]).df


@query("SELECT canonical_url AS value FROM crawl WHERE canonical_url IS NOT NULL")
def d2_from_table(s, d):
    return Context(s).from_table(table(s, d, "crawl"), F.col("canonical_url")).df


@query("SELECT response_code || ' ' || canonical_url AS value FROM crawl WHERE canonical_url IS NOT NULL")
def d2_from_table_python(s, d):
    rows = table(s, d, "crawl").select("response_code", "canonical_url")
    return Context(s).from_table(rows, lambda r: None if r["canonical_url"] is None else f"{r['response_code']} {r['canonical_url']}", python=True).df


@query("SELECT count(*) AS n FROM events")
def d3_count(s, d):
    return _types(s, d).count()


@query("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def d4_count_keys(s, d):
    return _orders(s, d).count_keys()


@query("SELECT count(*) AS n FROM orders")
def d4_count_pairs(s, d):
    return _orders(s, d).count_pairs()


@query("SELECT DISTINCT event_type AS value FROM events")
def d5_collect(s, d):
    """The few distinct texts at the driver, and back."""
    return s.createDataFrame([(v,) for v in _types(s, d).distinct().collect()], "value string")


@query("SELECT 25 AS n, true AS known")
def d6_take(s, d):
    """Any 25 texts: how many they are, and whether all are in the bag."""
    bag = Bag(table(s, d, "part").select("p_name"))
    taken = bag.take(25)
    rest = Bag(taken).difference(bag).df
    return taken.agg(F.count(F.lit(1)).cast("int").alias("n")).select("n", (F.lit(0) == rest.agg(F.count(F.lit(1))).scalar()).alias("known"))


@query("SELECT p_name AS value FROM part ORDER BY p_name LIMIT 25")
def d6_top(s, d):
    return Bag(table(s, d, "part").select("p_name")).top(25)


@query("SELECT CAST(sum(p_size) AS VARCHAR) AS value FROM part")
def d7_fold(s, d):
    return Bag(table(s, d, "part").select("p_size")).fold("0", aggregate=F.sum(F.col("value").cast("long")))


@query("SELECT max(p_name) AS value FROM part")
def d7_fold_python(s, d):
    return Bag(table(s, d, "part").select("p_name")).fold("", lambda a, b: max(a, b))


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, list_sort(list(o_orderpriority)) AS values FROM orders GROUP BY o_custkey")
def d8_save_as_table(s, d):
    store = K.Store(s, prefix="d8_")
    _orders(s, d).save_as_table(store, "orders")
    return store.scan("orders")


@query("SELECT 'rows: ' || count(*) AS said FROM nation")
def d9_output(s, d):
    job = Context(s)
    job.output("rows: ")
    job.output(str(Bag(table(s, d, "nation").select("n_name")).count().first()[0]))
    return s.createDataFrame([(job.said(),)], "said string")


@query("SELECT l_returnflag AS key, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def d11_concurrency(s, d):
    """Spread over as many partitions as the level says, three texts or not; counted where they are, then by text."""
    before = s.conf.get("spark.sql.shuffle.partitions")
    job = Context(s)
    job.set_concurrency_level(12)
    spread = job.with_concurrency(Bag(table(s, d, "lineitem").select("l_returnflag")))
    s.conf.set("spark.sql.shuffle.partitions", before)
    return spread.df.groupBy(F.col("value").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey AS key, upper(s_name) AS name FROM supplier")
def d10_job_store(s, d):
    """A job puts a table into its store and reads it there."""
    job = Context(s, K.Store(s, prefix="d10_"))
    job.store.put_table("names", table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.upper("s_name").alias("name")))
    return job.store.scan("names")


# ---------------------------------------------------------------- maps and filters


@query("SELECT unnest(string_split(p_name, ' ')) AS value FROM part")
def t1_flat_map(s, d):
    return Bag(table(s, d, "part").select("p_name")).flat_map(lambda v: F.split(v, " ")).df


@query("SELECT unnest(string_split(p_name, ' ')) AS value FROM part")
def t1_flat_map_python(s, d):
    return Bag(table(s, d, "part").select("p_name")).flat_map(lambda v: v.split(" "), python=True).df


@query("SELECT p_brand AS key, p_name AS value FROM part")
def t2_map_to_pair(s, d):
    parts = table(s, d, "part").select(F.concat_ws("|", "p_brand", "p_name"))
    return Bag(parts).map_to_pair(lambda v: (F.substring_index(v, "|", 1), F.substring_index(v, "|", -1))).df


@query("SELECT w AS key, p_name AS value FROM (SELECT p_name, unnest(string_split(p_name, ' ')) AS w FROM part)")
def t3_flat_map_to_pair(s, d):
    return Bag(table(s, d, "part").select("p_name")).flat_map_to_pair(lambda v: F.transform(F.split(v, " "), lambda w: F.struct(w.alias("key"), v.alias("value")))).df


@query("SELECT o_custkey || ':' || unnest([o_orderpriority, lower(o_orderpriority)]) AS value FROM orders")
def t4_pair_flat_map(s, d):
    return _orders(s, d).flat_map(lambda k, v: F.array(F.concat_ws(":", k, v), F.concat_ws(":", k, F.lower(v)))).df


@query("SELECT o_orderpriority AS key, CAST(o_custkey AS VARCHAR) AS value FROM orders")
def t5_pair_flat_map_to_pair(s, d):
    return _orders(s, d).flat_map_to_pair(lambda k, v: F.array(F.struct(v.alias("key"), k.alias("value")))).df


@query("SELECT event_type AS value FROM events WHERE event_type LIKE '%c%'")
def t6_filter(s, d):
    return _types(s, d).filter(lambda v: v.contains("c")).df


@query("SELECT event_type AS value FROM events WHERE event_type LIKE '%c%'")
def t6_filter_python(s, d):
    return _types(s, d).filter(lambda v: "c" in v, python=True).df


@query("SELECT upper(event_type) AS value FROM events UNION ALL SELECT event_type FROM events")
def t7_map_partitions(s, d):
    return _types(s, d).map_partitions(lambda vs: (x for v in vs for x in (v.upper(), v))).df


@query()
def t8_sample(s, d):
    return _types(s, d).sample(0.1, seed=3).df


@query()
def t8_hash_sample(s, d):
    return Bag(table(s, d, "part").select("p_name")).hash_sample(0.1, seed=3).df


# ---------------------------------------------------------------- joins


@query("""SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderpriority || ',' || c_mktsegment AS value
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0""")
def j1_join(s, d):
    return _orders(s, d).join(_segments(s, d)).df


@query("""WITH a AS (SELECT url AS k, string_agg(CAST(response_code AS VARCHAR), ',' ORDER BY CAST(response_code AS VARCHAR)) AS l FROM crawl WHERE url IS NOT NULL GROUP BY 1),
    b AS (SELECT src AS k, string_agg(n, ',' ORDER BY n) AS r FROM pageranks_temp WHERE src IS NOT NULL GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS key, '[' || coalesce(l, '') || '],[' || coalesce(r, '') || ']' AS value FROM a FULL JOIN b ON a.k = b.k""")
def j2_cogroup(s, d):
    """Fetches and rank states of the addresses; some have only one of them."""
    fetched = table(s, d, "crawl").where("url is not null").select("url", "response_code")
    return Pairs(fetched).cogroup(Pairs(table(s, d, "pageranks_temp").where("src is not null").select("src", "n"))).df


@query("SELECT url, pr FROM pageranks WHERE url IN (SELECT src FROM pageranks_temp)")
def j3_semi(s, d):
    return table(s, d, "pageranks").join(table(s, d, "pageranks_temp").select(F.col("src").alias("url")), "url", "left_semi").select("url", "pr")


@query("SELECT DISTINCT url FROM crawl WHERE url NOT IN (SELECT url FROM pageranks WHERE url IS NOT NULL)")
def j4_anti(s, d):
    return table(s, d, "crawl").where("url is not null").select("url").distinct().join(table(s, d, "pageranks").select("url"), "url", "left_anti")


@query("""SELECT page_id, coalesce(pr, 0.1) AS pr FROM crawl LEFT JOIN
    (SELECT url, max_by(pr, computed_at) AS pr FROM pageranks WHERE pr IS NOT NULL GROUP BY url) USING (url)""")
def j5_lookup_default(s, d):
    ranks = S.final_ranks(table(s, d, "pageranks"))
    return table(s, d, "crawl").select("page_id", "url").join(ranks, "url", "left").select("page_id", F.coalesce("pr", F.lit(0.1)).alias("pr"))


@query("SELECT DISTINCT doc_id FROM documents WHERE host IN (SELECT host FROM hosts)")
def j6_retain(s, d):
    return table(s, d, "documents").join(table(s, d, "hosts").select("host"), "host", "left_semi").select("doc_id").distinct()


# ---------------------------------------------------------------- aggregations


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, max(o_orderpriority) AS value FROM orders GROUP BY o_custkey")
def a1_fold_by_key(s, d):
    return _orders(s, d).fold_by_key(F.max("value")).df


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS value FROM orders GROUP BY o_custkey")
def a1_fold_by_key_python(s, d):
    """Counted by a function: accumulators start from zero, and those of the tasks are added."""
    return _orders(s, d).fold_by_key("0", lambda n, _: str(int(n) + 1), combine=lambda a, b: str(int(a) + int(b)), python=True).df


@query("SELECT upper(left(n_name, 1)) AS key, string_agg(n_name, ',' ORDER BY n_name) AS value FROM nation GROUP BY 1")
def a2_group_by(s, d):
    return Bag(table(s, d, "nation").select("n_name")).group_by(lambda v: F.upper(F.substring(v, 1, 1))).df


@query("SELECT upper(left(n_name, 1)) AS key, string_agg(n_name, ',' ORDER BY n_name) AS value FROM nation GROUP BY 1")
def a2_group_by_python(s, d):
    return Bag(table(s, d, "nation").select("n_name")).group_by(lambda v: v[:1].upper(), python=True).df


@query("SELECT DISTINCT event_type AS value FROM events")
def a3_distinct(s, d):
    return _types(s, d).distinct().df


@query("SELECT CAST(count(*) AS VARCHAR) AS value FROM events")
def a4_fold(s, d):
    return _types(s, d).fold("0", aggregate=F.count(F.lit(1)))


@query("SELECT l_partkey AS key, sum(l_quantity) AS value FROM lineitem GROUP BY l_partkey")
def a5_sum_fold(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.sum("l_quantity").alias("value"))


@query("SELECT host AS key, count(*) AS value FROM documents WHERE host IS NOT NULL GROUP BY host")
def a6_count_fold(s, d):
    return table(s, d, "documents").where("host is not null").groupBy(F.col("host").alias("key")).agg(F.count(F.lit(1)).alias("value"))


@query("SELECT c_mktsegment AS key, string_agg(c_name, ',' ORDER BY c_name) AS value FROM customer GROUP BY 1")
def a7_concat_fold(s, d):
    named = Pairs(table(s, d, "customer").select("c_mktsegment", "c_name"))
    return named.fold_by_key(F.array_join(F.array_sort(F.collect_list("value")), ",")).df


_STATE = """SELECT * FROM (SELECT DISTINCT seq, src, TRY_CAST(trim(rank0) AS DOUBLE) AS r0, TRY_CAST(trim(rank1) AS DOUBLE) AS r1 FROM pageranks_temp)
    WHERE isfinite(r0) AND isfinite(r1)"""


@query(f"SELECT count(*) FILTER (abs(r1 - r0) < 0.01) AS done, count(*) AS n FROM ({_STATE})")
def a8_converged(s, d):
    number = lambda c: F.expr(f"try_cast(trim({c}) as double)")
    state = table(s, d, "pageranks_temp").select("seq", "src", number("rank0").alias("rank0"), number("rank1").alias("rank1")).distinct()
    finite = F.abs(F.col("rank0") + F.col("rank1")) < float("inf")  # neither null, NaN nor infinite
    return G.settled(state.where(finite), 0.01)


# ---------------------------------------------------------------- words and addresses in SQL

_PAGES = """last AS (SELECT url, arg_max(page, (fetched_at, page_id)) AS page FROM crawl
        WHERE page IS NOT NULL AND url IS NOT NULL GROUP BY url),
    pages AS (SELECT url, regexp_replace(concat_ws(' ', regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:]*)', 1),
        coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/:]*(?::[^/]*)?(/.*)$', 1), ''), '/'), page), '<[^<>]*(>|\\z)', ' ', 'g') AS text FROM last),
    lists AS (SELECT url, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM pages),
    words AS (SELECT url, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS p FROM lists),
    skipped AS (SELECT unnest(['http', 'https', 'com', 'net', 'edu', 'org', 'gov', 'www', 'xml', 'ttl', 'xmlj', 'rdf']) AS w),
    idx AS (SELECT term, url, count(*) AS n, list(CAST(p AS INTEGER) ORDER BY p) AS positions FROM words
        WHERE term NOT IN (SELECT w FROM skipped) GROUP BY term, url)"""

#: The same with the limits of the described indexer: addresses of at most 100 characters, words of 20, pages of 10,000, and
#: of host, path and page together again 10,000.
_LIMITED = (
    _PAGES.replace("url IS NOT NULL GROUP BY", "url IS NOT NULL AND length(url) <= 100 GROUP BY")
    .replace("regexp_replace(concat_ws", "regexp_replace(left(concat_ws")
    .replace("'/'), page), '<", "'/'), left(page, 10000)), 10000), '<")
    .replace("WHERE term NOT IN", "WHERE length(term) <= 20 AND term NOT IN")
)


@query(f"WITH {_PAGES} SELECT term, count(DISTINCT url) AS df FROM idx GROUP BY term")
def a9_document_frequency(s, d):
    # one posting for each page of a term
    return S.word_postings(S.indexed_pages(s, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


QUERY = "the harbour market and the river were counted"
_ASKED = "term IN ('harbour', 'market', 'river', 'counted')"


@query(f"WITH {_PAGES} SELECT count(DISTINCT url) AS n FROM idx WHERE {_ASKED}")
def a10_union_size(s, d):
    words = S.query_words(QUERY, stemmed=False)
    return S.word_postings(S.indexed_pages(s, d)).where(F.col("term").isin(*words)).agg(F.count_distinct("url").alias("n"))


@query(f"""WITH {_PAGES}, freq AS (SELECT url, sum(n) AS n FROM idx WHERE {_ASKED} GROUP BY url),
    h AS (SELECT n, count(*) AS k FROM freq GROUP BY n), c AS (SELECT n, sum(k) OVER (ORDER BY n DESC) AS kept FROM h)
    SELECT url, CAST(n AS BIGINT) AS n FROM freq WHERE n >= coalesce((SELECT max(n) FROM c WHERE kept >= 200), 0)""")
def a11_threshold_set(s, d):
    words = S.query_words(QUERY, stemmed=False)
    freq = S.word_postings(S.indexed_pages(s, d)).where(F.col("term").isin(*words)).groupBy("url").agg(F.sum("n").alias("n"))
    return R.threshold_set(freq, 200)


# ---------------------------------------------------------------- orders and limits

_RANKED = "SELECT url, max_by(pr, computed_at) AS pr FROM pageranks WHERE pr IS NOT NULL GROUP BY url"


def _final(s, d):
    return S.final_ranks(table(s, d, "pageranks")).withColumnRenamed("pr", "score")


@query("SELECT value FROM (SELECT p_brand AS value FROM part ORDER BY p_brand LIMIT 7)")
def s1_take(s, d):
    return Bag(table(s, d, "part").select("p_brand")).top(7)


@query(f"SELECT DISTINCT pr AS score FROM ({_RANKED}) ORDER BY pr DESC LIMIT 20")
def s2_top_scores(s, d):
    return R.top_distinct_scores(_final(s, d), 20)


@query(f"SELECT url, pr AS score, CAST(dense_rank() OVER (ORDER BY pr DESC) AS INTEGER) AS place FROM ({_RANKED}) ORDER BY pr DESC, url LIMIT 50")
def s5_tied(s, d):
    return R.tied_groups(_final(s, d), 50).select("url", "score", "place")


@query(f"SELECT url, pr AS score FROM ({_RANKED})")
def s6_sort(s, d):
    return _final(s, d).orderBy(F.desc("score"), "url").select("url", "score")


@query(f"SELECT CAST(row_number() OVER (ORDER BY pr DESC, url) AS INTEGER) AS rank, url, pr AS score FROM ({_RANKED}) QUALIFY rank <= 200")
def s7_rank_cap(s, d):
    return R.ranked(_final(s, d), 200).select("rank", "url", "score")


@query(f"SELECT CAST(row_number() OVER (ORDER BY pr DESC, url) AS INTEGER) AS rank, url, pr AS score FROM ({_RANKED}) QUALIFY rank BETWEEN 21 AND 30")
def s9_result_page(s, d):
    return R.result_page(_final(s, d), 3).select("rank", "url", "score")


# ---------------------------------------------------------------- sets


@query("SELECT url AS value FROM crawl WHERE url IS NOT NULL INTERSECT SELECT url FROM pageranks")
def x1_intersection(s, d):
    return Bag(table(s, d, "crawl").where("url is not null").select("url")).intersection(Bag(table(s, d, "pageranks").select("url"))).df


@query("SELECT DISTINCT host AS value FROM documents")
def x2_distinct(s, d):
    return Bag(table(s, d, "documents").select("host")).distinct().df


@query("SELECT url AS value FROM crawl UNION SELECT url FROM pageranks")
def x3_union(s, d):
    return Bag(table(s, d, "crawl").select("url")).union(Bag(table(s, d, "pageranks").select("url"))).distinct().df


@query("SELECT src AS value FROM pageranks_temp EXCEPT SELECT url FROM crawl")
def x4_difference(s, d):
    return Bag(table(s, d, "pageranks_temp").select("src")).difference(Bag(table(s, d, "crawl").select("url"))).df


# ---------------------------------------------------------------- functions


@query("""SELECT page_id, list_aggregate(list_transform(list_transform(range(0, 20), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER)),
        lambda b: chr(CAST((CASE WHEN b = 0 THEN 255 WHEN b > 127 THEN b - 1 ELSE b END) % 26 + 97 AS INTEGER))
            || chr(CAST((CASE WHEN b = 0 THEN 255 WHEN b > 127 THEN b - 1 ELSE b END) // 26 * 2 + 97 AS INTEGER))), 'string_agg', '') AS key
    FROM (SELECT page_id, sha1(url) AS h FROM crawl WHERE url IS NOT NULL)""")
def f1_row_key(s, d):
    return table(s, d, "crawl").where("url is not null").select("page_id", U.row_key(F.col("url")).alias("key"))


_URL = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/:]*)(?::([^/]*))?(/.*)?$'"


@query(f"""SELECT page_id, nullif(regexp_extract(url, {_URL}, 1), '') AS protocol, nullif(regexp_extract(url, {_URL}, 2), '') AS host,
    nullif(regexp_extract(url, {_URL}, 3), '') AS port, coalesce(nullif(regexp_extract(url, {_URL}, 4), ''), '/') AS path FROM crawl WHERE url LIKE 'http%://%'""")
def f2_parse_url(s, d):
    rows = table(s, d, "crawl").where("url like 'http%://%'").select("page_id", U.url_parts(F.col("url")).alias("p"))
    return rows.select("page_id", "p.protocol", "p.host", "p.port", "p.path")


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^[a-z]+://[^/]+$') THEN url || '/' ELSE url END AS url FROM crawl")
def f3_compose_url(s, d):
    return table(s, d, "crawl").select("page_id", U.composed(U.url_parts(F.col("url"))).alias("url"))


@query("SELECT page_id, CASE WHEN NOT starts_with(url, '#') THEN split_part(url, '#', 1) END AS url FROM crawl")
def f4_without_fragment(s, d):
    return table(s, d, "crawl").select("page_id", U.without_fragment(F.col("url")).alias("url"))


_LINES = "SELECT page_id, url, unnest(string_split(page, chr(10))) AS line FROM (SELECT DISTINCT page_id, url, page FROM crawl WHERE page IS NOT NULL)"
_HREFS = f"""SELECT page_id, url, unnest(regexp_extract_all(line, '(?i)(?:^| )href=[^" ]*"([^" ]*)', 1)) AS link FROM ({_LINES})
    WHERE contains(line, '<') AND contains(line, '>')"""
_LINKS = f"SELECT * FROM ({_HREFS}) WHERE NOT regexp_matches(link, '[.](jpg|jpeg|png|gif|txt)$')"


@query(f"SELECT page_id, link FROM ({_LINKS})")
def f7_page_links(s, d):
    pages = table(s, d, "crawl").where("page is not null").select("page_id", "url", "page").distinct()
    return pages.select("page_id", F.explode(U.page_links(F.col("page"))).alias("link"))


@query(f"""WITH l AS (SELECT page_id, split_part(link, '#', 1) AS t, url AS b FROM ({_LINKS}) WHERE NOT starts_with(link, '#')),
    p AS (SELECT *, regexp_matches(t, {_URL}) AS abs FROM l),
    q AS (SELECT page_id, t, abs, lower(CASE WHEN abs THEN regexp_extract(t, {_URL}, 1) ELSE regexp_extract(b, {_URL}, 1) END) AS proto,
        CASE WHEN abs THEN regexp_extract(t, {_URL}, 2) ELSE regexp_extract(b, {_URL}, 2) END AS host,
        nullif(CASE WHEN abs THEN regexp_extract(t, {_URL}, 3) ELSE regexp_extract(b, {_URL}, 3) END, '') AS port,
        coalesce(nullif(regexp_extract(t, {_URL}, 4), ''), '/') AS tpath, coalesce(nullif(regexp_extract(b, {_URL}, 4), ''), '/') AS bpath FROM p),
    r AS (SELECT *, CASE WHEN abs THEN tpath WHEN starts_with(t, '/') THEN t WHEN t = '' THEN bpath
        ELSE regexp_replace(split_part(bpath, '?', 1), '[^/]*$', '') || t END AS path FROM q)
    SELECT page_id, proto || '://' || host || ':' || coalesce(port, CASE WHEN proto = 'https' THEN '443' ELSE '80' END) ||
        list_reduce(list_prepend('', string_split(regexp_replace(path, '^/', ''), '/')),
            lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN x = '.' THEN a ELSE a || '/' || x END) AS url
    FROM r WHERE proto IN ('http', 'https') AND NOT (NOT abs AND regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:'))""")
def f5_normalize_links(s, d):
    pages = table(s, d, "crawl").where("page is not null").select("page_id", "url", "page").distinct()
    each = pages.select("page_id", "url", F.explode(U.page_links(F.col("page"))).alias("link"))
    return each.select("page_id", U.normalized(F.col("url"), F.col("link")).alias("n")).where("n is not null").select("page_id", F.col("n").alias("url"))


@query(f"""WITH l AS (SELECT page_id, split_part(link, '#', 1) AS t, url AS b FROM ({_LINKS}) WHERE NOT starts_with(link, '#')),
    q AS (SELECT page_id, t, b, regexp_matches(t, {_URL}) AS abs FROM l),
    r AS (SELECT page_id, abs, lower(CASE WHEN abs THEN regexp_extract(t, {_URL}, 1) ELSE regexp_extract(b, {_URL}, 1) END) AS proto,
        CASE WHEN abs THEN regexp_extract(t, {_URL}, 2) ELSE regexp_extract(b, {_URL}, 2) END AS host,
        CASE WHEN abs THEN coalesce(nullif(regexp_extract(t, {_URL}, 4), ''), '/') WHEN starts_with(t, '/') THEN t WHEN t = '' THEN coalesce(nullif(regexp_extract(b, {_URL}, 4), ''), '/')
            ELSE regexp_replace(split_part(coalesce(nullif(regexp_extract(b, {_URL}, 4), ''), '/'), '?', 1), '[^/]*$', '') || regexp_replace(t, '^[.][.]/?', '') END AS path
        FROM q WHERE abs OR NOT regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:'))
    SELECT page_id, proto || '://' || host || ':' || CASE WHEN proto = 'https' THEN '443' ELSE '80' END || path AS url FROM r WHERE proto IN ('http', 'https')""")
def f6_normalize_as_described(s, d):
    """The rank job's own way: ports are overwritten, and a leading .. is cut."""
    pages = table(s, d, "crawl").where("page is not null").select("page_id", "url", "page").distinct()
    each = pages.select("page_id", "url", F.explode(U.page_links(F.col("page"))).alias("link"))
    return each.select("page_id", U.normalized(F.col("url"), F.col("link"), as_described=True).alias("url")).where("url is not null")


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_CODED = f"list_has_any(regexp_extract_all(link, '[A-Za-z0-9]+'), [{_quoted(sorted({*U.COUNTRY_CODES, *U.LANGUAGE_CODES}))}])"


@query(f"WITH {LINKS_SQL} SELECT seq, pos, link FROM links WHERE NOT {_CODED}")
def f8_language_filter(s, d):
    """Of the links of the rank states."""
    return unpack_links(table(s, d, "pageranks_temp")).where(U.passes_language(F.col("link")))


@query(f"WITH {LINKS_SQL} SELECT seq, coalesce(list(link ORDER BY pos) FILTER (NOT {_CODED}), []) AS urls FROM links GROUP BY seq")
def f9_language_filter_list(s, d):
    """The filter over the list of links of each state."""
    lists = unpack_links(table(s, d, "pageranks_temp")).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "link"))).alias("l"))
    return lists.select("seq", F.filter(F.transform("l", lambda x: x["link"]), lambda x: U.passes_language(x)).alias("urls"))


@query("SELECT page_id, regexp_replace(page, '<[^<>]*(>|\\z)', ' ', 'g') AS text FROM crawl WHERE page IS NOT NULL")
def f10_strip_tags(s, d):
    return table(s, d, "crawl").where("page is not null").select("page_id", W.stripped(F.col("page")).alias("text"))


@query("""SELECT doc_id, w AS word, CASE WHEN t = '' AND w <> '' THEN left(w, 1) ELSE t END AS trimmed
    FROM (SELECT doc_id, w, regexp_replace(w, '^[^0-9A-Za-z]+|[^0-9A-Za-z]+$', '', 'g') AS t FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents))""")
def f11_trim_words(s, d):
    words = table(s, d, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    return words.select("doc_id", "word", W.trimmed_word(F.col("word")).alias("trimmed"))


@query("""SELECT page_id, unnest(list_distinct(regexp_extract_all(lower(regexp_replace(page, '<[^<>]*(>|\\z)', ' ', 'g')), '[a-z0-9]+'))) AS word
    FROM (SELECT DISTINCT page_id, page FROM crawl WHERE page IS NOT NULL)""")
def f12_word_set(s, d):
    return table(s, d, "crawl").where("page is not null").select("page_id", "page").distinct().select("page_id", F.explode(W.word_set(F.col("page"))).alias("word"))


@query(f"WITH {_PAGES} SELECT url, term, count(*) AS n, list(CAST(p AS INTEGER) ORDER BY p) AS positions FROM words GROUP BY url, term")
def f13_positions(s, d):
    return W.word_positions(S.indexed_pages(s, d), "url", F.col("text"))


@query("""SELECT doc_id, w AS term, count(*) AS n, list(CAST(p AS INTEGER) ORDER BY p) AS positions FROM
    (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS p FROM documents WHERE text IS NOT NULL)
    WHERE w <> '' GROUP BY doc_id, w""")
def f13_positions_by_space(s, d):
    """Positions of the older index: texts split at single spaces only."""
    docs = table(s, d, "documents").where("text is not null")
    each = docs.select("doc_id", F.posexplode(F.split(F.lower("text"), " ")).alias("p", "term")).where("term <> ''")
    return each.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list((F.col("p") + 1).cast("int"))).alias("positions"))


_STEMS = f"{_PAGES},\n{stem_ctes('(SELECT DISTINCT term AS word FROM idx)')}"
#: The index under words and stems.
_STEMMED = f"""{_STEMS},
    stemmed AS (SELECT term, url, n, positions FROM idx UNION ALL SELECT stem, url, n, positions FROM idx JOIN stems ON word = term WHERE stem <> term)"""


@query(f"WITH {_STEMS} SELECT word AS term, stem FROM stems")
def f14_stems(s, d):
    return W.with_stems(S.word_postings(S.indexed_pages(s, d)).select("term").distinct())


@query(f"""WITH q AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL AND lower(trim(source)) = 'queries'),
    each AS (SELECT doc_id, unnest(w) AS word, CAST(unnest(range(0, len(w))) AS INTEGER) AS place FROM q),
    {stem_ctes("each")} SELECT doc_id, place, word, stem FROM each JOIN stems USING (word)""")
def f15_query_words(s, d):
    queries = table(s, d, "documents").where("text is not null and lower(trim(source)) = 'queries'")
    words = queries.select("doc_id", F.posexplode(W.tokens(F.col("text"))).alias("place", "word"))
    return W.with_stems(words, "word")


_STOPS = _quoted(W.STOP_WORDS)
_QUERIES = "SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL AND lower(trim(source)) = 'queries'"


@query(f"SELECT doc_id, len(list_filter(w, lambda x: x NOT IN ({_STOPS}))) = 0 AS only_stop_words FROM ({_QUERIES})")
def f16_stop_words(s, d):
    queries = table(s, d, "documents").where("text is not null and lower(trim(source)) = 'queries'")
    return queries.select("doc_id", W.all_stop_words(W.tokens(F.col("text"))).alias("only_stop_words"))


@query(f"""SELECT doc_id, round(CAST(len(list_filter(w, lambda x: x NOT IN ({_STOPS}))) + 0.05 * len(list_filter(w, lambda x: x IN ({_STOPS}))) AS DOUBLE), 6) AS weight FROM ({_QUERIES})""")
def f17_query_weight(s, d):
    queries = table(s, d, "documents").where("text is not null and lower(trim(source)) = 'queries'")
    return queries.select("doc_id", F.round(W.word_weight(W.tokens(F.col("text")), True), 6).alias("weight"))


@query("SELECT page_id, list_contains(regexp_extract_all(lower(url), '[a-z0-9]+'), 'harbour') AS has FROM crawl WHERE url IS NOT NULL")
def f18_url_contains(s, d):
    return table(s, d, "crawl").where("url is not null").select("page_id", S.url_contains(F.col("url"), "harbour").alias("has"))


@query(f"""WITH u AS (SELECT page_id, unnest(regexp_extract_all(lower(url), '[a-z0-9]+')) AS word FROM crawl WHERE url IS NOT NULL), {stem_ctes("u")},
    hit AS (SELECT DISTINCT page_id FROM u JOIN stems USING (word) WHERE stem = 'describ')
    SELECT page_id, page_id IN (SELECT page_id FROM hit) AS has FROM crawl WHERE url IS NOT NULL""")
def f18_url_contains_stem(s, d):
    return table(s, d, "crawl").where("url is not null").select("page_id", S.url_contains(F.col("url"), F.lit("describ"), stemmed=True).alias("has"))


@query(f"WITH {_LIMITED} SELECT term, url, n FROM idx")
def f19_limits(s, d):
    return S.word_postings(S.indexed_pages(s, d, limits=W.LIMITS), W.LIMITS).select("term", "url", "n")


@query("""SELECT page_id FROM crawl WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT trim(pattern) AS p FROM blacklist WHERE pattern IS NOT NULL)
    WHERE crawl.url LIKE replace(replace(replace(p, '%', '\\%'), '_', '\\_'), '*', '%') ESCAPE '\\')""")
def f20_blacklist(s, d):
    patterns = table(s, d, "blacklist").select(U.like_pattern(F.trim("pattern")).alias("pattern"))
    return K.matching(table(s, d, "crawl").select("page_id", "url"), "url", patterns, "pattern").select("page_id")


_ROBOT_LINES = """SELECT doc_id, i, lower(trim(split_part(line, ':', 1))) AS header, trim(substr(line, strpos(line, ':') + 1)) AS body
    FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents
        WHERE text IS NOT NULL AND replace(lower(trim(source)), '-', '_') = 'robots')) WHERE contains(line, ':')"""


_RULES = f"""g AS (SELECT *, CASE WHEN header = 'user-agent' AND coalesce(lag(header) OVER w, '') <> 'user-agent' THEN 1 ELSE 0 END AS b
        FROM ({_ROBOT_LINES}) WHERE header IN ('user-agent', 'allow', 'disallow', 'crawl-delay') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    n AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM g),
    a AS (SELECT DISTINCT doc_id, g, lower(body) AS agent FROM n WHERE header = 'user-agent')
    SELECT doc_id, agent, header AS rule, CASE WHEN header <> 'crawl-delay' THEN body END AS route, CASE WHEN header = 'crawl-delay' THEN TRY_CAST(body AS DOUBLE) END AS delay
    FROM n JOIN a USING (doc_id, g) WHERE header <> 'user-agent'"""


def _robots_files(s, d):
    return table(s, d, "documents").where("text is not null and replace(lower(trim(source)), '-', '_') = 'robots'")


@query(f"WITH {_RULES} AND agent = '*'")
def f21_robots(s, d):
    """Rules that hold for every agent."""
    return C.robots_rules(_robots_files(s, d), "doc_id", "text")


_AGENT = "examplecrawler"


@query(f"WITH {_RULES} AND agent IN ('*', '{_AGENT}')")
def f21_robots_of_agent(s, d):
    """Rules for every agent and for one of that name."""
    return C.robots_rules(_robots_files(s, d), "doc_id", "text", ["*", _AGENT])


_ROUTES = """rules AS (SELECT DISTINCT host, unnest(string_split(forbidden_routes, ' ')) AS r FROM hosts WHERE forbidden_routes IS NOT NULL),
    pages AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]*(/.*)$', 1), ''), '/') AS path FROM crawl WHERE url IS NOT NULL)"""


@query(f"""WITH {_ROUTES} SELECT DISTINCT page_id FROM pages JOIN rules USING (host) WHERE r <> ''
    AND path LIKE replace(replace(replace(r, '%', '\\%'), '_', '\\_'), '*', '%') || '%' ESCAPE '\\'""")
def f22_forbidden_routes(s, d):
    """Pages whose route a rule of their host forbids: a prefix, with * for any run of characters."""
    rules = table(s, d, "hosts").where("forbidden_routes is not null").select("host", F.explode(F.split("forbidden_routes", " ")).alias("route"))
    url = F.col("url")
    path = F.coalesce(F.nullif(F.regexp_extract(url, "^[a-z]+://[^/]*(/.*)$", 1), F.lit("")), F.lit("/"))
    pages = table(s, d, "crawl").where("url is not null").select("page_id", F.regexp_extract(url, "^[a-z]+://([^/]*)", 1).alias("host"), path.alias("path"))
    return C.forbidden(pages, rules).select("page_id").distinct()


@query("""SELECT page_id, first_url AS canonical FROM (SELECT DISTINCT page_id, md5(page) AS h FROM crawl WHERE page IS NOT NULL)
    JOIN (SELECT md5(page) AS h, min_by(url, (fetched_at, page_id)) AS first_url, min((fetched_at, page_id)) AS f FROM crawl WHERE page IS NOT NULL GROUP BY 1) USING (h) WHERE page_id <> f[2]""")
def f23_content_seen(s, d):
    """Pages with a body that was fetched before, and the address that it was fetched from first."""
    return C.seen_before(table(s, d, "crawl").where("page is not null"), F.col("page"), ["fetched_at", "page_id"])


@query(r"""SELECT page_id, trim(regexp_replace(regexp_extract(page, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title
    FROM (SELECT DISTINCT page_id, page FROM crawl WHERE page IS NOT NULL)""")
def f24_titles(s, d):
    return table(s, d, "crawl").where("page is not null").select("page_id", "page").distinct().select("page_id", S.page_title(F.col("page")).alias("title"))


@query(f"""WITH {_PAGES}, v AS (SELECT term, sum(n) AS n FROM idx GROUP BY term),
    w AS (SELECT DISTINCT unnest(w) AS word FROM ({_QUERIES})), u AS (SELECT word FROM w WHERE word NOT IN (SELECT term FROM v)),
    c AS (SELECT word, term, n, levenshtein(word, term) AS d FROM u JOIN v ON left(word, 1) = left(term, 1) AND abs(len(word) - len(term)) <= 2),
    b AS (SELECT word, arg_min(term, (d, -n, term)) AS best FROM c WHERE d <= 2 GROUP BY word)
    SELECT word, CASE WHEN word IN (SELECT term FROM v) THEN word ELSE best END AS suggestion FROM w LEFT JOIN b USING (word)""")
def f25_spelling(s, d):
    vocabulary = S.word_postings(S.indexed_pages(s, d)).groupBy("term").agg(F.sum("n").alias("n"))
    queries = table(s, d, "documents").where("text is not null and lower(trim(source)) = 'queries'")
    return S.spelling(queries.select(F.explode(W.tokens(F.col("text"))).alias("word")), vocabulary)


@query(f"""WITH {_PAGES} SELECT term AS key, string_agg(p, '~' ORDER BY p) AS url FROM
    (SELECT term, url || '^' || n || ' ' || array_to_string(positions, ' ') AS p FROM idx) GROUP BY term""")
def f26_rendered_index(s, d):
    return S.rendered(S.word_postings(S.indexed_pages(s, d)))


# ---------------------------------------------------------------- jobs


@query(f"WITH {_PAGES} SELECT term, url, n, positions FROM idx")
def q1_word_index(s, d):
    return S.word_postings(S.indexed_pages(s, d))


@query(f"WITH {_STEMMED} SELECT term, url, n, positions FROM stemmed")
def q1_index(s, d):
    return S.postings(S.indexed_pages(s, d))


@query(f"WITH {_PAGES} SELECT term, url, n, positions FROM idx")
def q1_merged_index(s, d):
    """An index of what was fetched early, with all that was fetched later merged into it: the index of all pages."""
    crawl = table(s, d, "crawl").where("page is not null and url is not null")
    at = F.unix_micros(F.col("fetched_at").cast("timestamp"))
    middle = crawl.agg(F.avg(at)).scalar()
    late = crawl.where(at > middle)
    old = S.word_postings(S.pages_of(crawl.where(at <= middle)))
    return S.merged_postings(old, S.word_postings(S.pages_of(late)), late)


@query(f"WITH {_PAGES.replace('url IS NOT NULL GROUP BY', 'url IS NOT NULL AND url NOT IN (SELECT url FROM pageranks WHERE url IS NOT NULL) GROUP BY')} SELECT term, url, n, positions FROM idx")
def q1_incremental_index(s, d):
    return S.word_postings(S.indexed_pages(s, d, done=table(s, d, "pageranks").where("url is not null")))


#: Ranks after few rounds are short decimals; what is added keeps them off the ties of rounding.
def _pagerank_sql(rounds: int, share: float | None = None, linked: bool = False) -> str:
    """After so many rounds; with a share, after the first round in which that share of the ranks settled; of all pages,
    or of those with links only."""
    norm = f"""lower(regexp_extract(u, {_URL}, 1)) || '://' || regexp_extract(u, {_URL}, 2) || ':' || coalesce(nullif(regexp_extract(u, {_URL}, 3), ''),
        CASE WHEN regexp_extract(u, {_URL}, 1) = 'https' THEN '443' ELSE '80' END) || coalesce(nullif(regexp_extract(u, {_URL}, 4), ''), '/')"""
    ctes = [
        f"p0 AS (SELECT page_id, fetched_at, lower(page) AS page, split_part(lower(url), '#', 1) AS u FROM crawl WHERE page IS NOT NULL AND url IS NOT NULL)",
        f"p1 AS (SELECT {norm} AS url, page, fetched_at, page_id FROM p0)",
        "p AS (SELECT url, arg_max(page, (fetched_at, page_id)) AS page FROM p1 GROUP BY url)",
        "ln AS (SELECT url, unnest(string_split(page, chr(10))) AS line FROM p)",
        """h AS (SELECT url AS src, unnest(regexp_extract_all(line, '(?i)(?:^| )href=[^" ]*"([^" ]*)', 1)) AS link FROM ln WHERE contains(line, '<') AND contains(line, '>'))""",
        f"u AS (SELECT src, split_part(link, '#', 1) AS u FROM h WHERE NOT regexp_matches(link, '[.](jpg|jpeg|png|gif|txt)$') AND regexp_matches(split_part(link, '#', 1), '^https?://'))",
        f"e0 AS (SELECT src, {norm} AS dst FROM u)",
        """rel AS (SELECT src, regexp_extract(src, '^(https?://[^/]*)', 1) || split_part(link, '#', 1) AS dst FROM h
            WHERE starts_with(link, '/') AND NOT regexp_matches(link, '[.](jpg|jpeg|png|gif|txt)$'))""",
        "links AS (SELECT * FROM e0 UNION ALL SELECT * FROM rel)",
        f"r0 AS (SELECT DISTINCT {'src AS id, 1.0 AS r FROM links' if linked else 'url AS id, 1.0 AS r FROM p'})",
        "e AS (SELECT src, dst, count(*) AS n FROM links WHERE dst IN (SELECT id FROM r0) GROUP BY ALL)",
        "s AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM e)",
    ]
    for k in range(rounds):
        ctes.append(f"r{k + 1} AS MATERIALIZED (SELECT id, 0.15 + coalesce(val, 0) AS r FROM r{k} LEFT JOIN (SELECT dst AS id, sum(r * share * 0.85) AS val FROM s JOIN r{k} ON r{k}.id = src GROUP BY dst) USING (id))")
    head = "WITH " + ",\n".join(ctes)
    if share is None:
        return head + f" SELECT id AS url, round(r + 3e-11, 9) AS rank FROM r{rounds}"
    steps = " UNION ALL ".join(f"SELECT {k} AS k, b.id, b.r, abs(b.r - a.r) < 0.01 AS done FROM r{k - 1} a JOIN r{k} b USING (id)" for k in range(1, rounds + 1))
    return head + f""", steps AS ({steps}), shares AS (SELECT k, count(*) FILTER (done) AS done, count(*) AS n FROM steps GROUP BY k)
        SELECT id AS url, round(r + 3e-11, 9) AS rank FROM steps WHERE k = (SELECT min(k) FROM shares WHERE done >= {share} * n)"""


@query(_pagerank_sql(3))
def q2_pagerank_rounds(s, d):
    pages = G.fetched_pages(s, d)
    ranks = G.pagerank(pages.select(F.col("url").alias("id")), G.links(pages), rounds=3)
    return ranks.select(F.col("id").alias("url"), F.round(F.col("rank1") + 3e-11, 9).alias("rank"))


@query(_pagerank_sql(24, 0.8))
def q2_pagerank(s, d):
    pages = G.fetched_pages(s, d)
    ranks = G.pagerank(pages.select(F.col("url").alias("id")), G.links(pages))
    return ranks.select(F.col("id").alias("url"), F.round(F.col("rank1") + 3e-11, 9).alias("rank"))


@query(_pagerank_sql(60, 1.0))
def q2_pagerank_strict(s, d):
    """Until every rank has settled."""
    pages = G.fetched_pages(s, d)
    ranks = G.pagerank(pages.select(F.col("url").alias("id")), G.links(pages), share=1.0, settle=True)
    return ranks.select(F.col("id").alias("url"), F.round(F.col("rank1") + 3e-11, 9).alias("rank"))


@query(_pagerank_sql(24, 0.95, linked=True))
def q2_pagerank_linked(s, d):
    """Of pages that have links only, until 95 % of the ranks have settled, at most 100 rounds."""
    pages = G.fetched_pages(s, d)
    edges = G.links(pages)
    linked = edges.select(F.col("src").alias("id")).distinct()
    ranks = G.pagerank(linked, edges, share=0.95, most=100)
    return ranks.select(F.col("id").alias("url"), F.round(F.col("rank1") + 3e-11, 9).alias("rank"))


def _score_sql(score: str, weight: str = "tf * ln(np / df) / 4", extra: str = "") -> str:
    return f"""WITH {_PAGES}, np AS (SELECT CAST(count(*) AS DOUBLE) AS np FROM pages),
        hits AS (SELECT term, url, n AS tf FROM idx WHERE {_ASKED}), {extra} dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
        t AS (SELECT url, sum({weight}) AS t FROM hits JOIN dfs USING (term), np GROUP BY url),
        r AS ({_RANKED}), b AS (SELECT url, t, pr FROM t LEFT JOIN r USING (url)),
        c AS (SELECT url, t, coalesce(pr, 0) AS pr, {score} AS score FROM b)
        SELECT CAST(row_number() OVER (ORDER BY round(score, 9) DESC, url) AS INTEGER) AS rank, url, round(t, 6) AS tf_idf, pr AS pagerank, round(score, 6) AS score
        FROM c WHERE score IS NOT NULL QUALIFY rank <= 200"""


def _ranking(s, d, way: str, floor: bool = False) -> DataFrame:
    words = S.query_words(QUERY, stemmed=False)
    scores = S.scored(S.word_postings(S.indexed_pages(s, d)), words, S.page_number(s, d), float(len(words)), floor)
    return _ranked_scores(s, d, scores, way)


def _ranked_scores(s, d, scores: DataFrame, way: str) -> DataFrame:
    both = S.combined(scores, S.final_ranks(table(s, d, "pageranks")), way).withColumn("order", F.round("score", 9))
    out = R.ranked(both, 200, "order")
    return out.select("rank", "url", F.round("tf_idf", 6).alias("tf_idf"), "pagerank", F.round("score", 6).alias("score"))


@query(_score_sql("coalesce(pr, 0) + t"))
def q3_rank_sum(s, d):
    return _ranking(s, d, "sum")


@query(_score_sql("0.9 * coalesce(pr, 0) + 0.1 * t"))
def q3_rank_weighted(s, d):
    return _ranking(s, d, "weighted")


@query(_score_sql("CASE WHEN t > 0 THEN ln(t) END + 0 * ln(coalesce(pr, 0.1))"))
def q3_rank_logs(s, d):
    return _ranking(s, d, "logs")


@query(
    _score_sql(
        "0.95 * CASE WHEN t > 0 THEN ln(t) END + 0.05 * ln(greatest(coalesce(pr, 0.1), 1e-9))",
        "greatest(tf + 0.1 * CAST(list_contains(regexp_extract_all(lower(url), '[a-z0-9]+'), term) AS INTEGER), 25) * ln(np / 5 * df) / 4",
    )
)
def q3_rank_search(s, d):
    return _ranking(s, d, "search", floor=True)


@query(
    _score_sql(
        "0.9 * coalesce(pr, 0) + 0.1 * t",
        "tf * ln((SELECT count(*) FROM sub)::DOUBLE / df) / 4",
        extra="""freq AS (SELECT url, sum(tf) AS n FROM hits GROUP BY url), h AS (SELECT n, count(*) AS k FROM freq GROUP BY n),
            cum AS (SELECT n, sum(k) OVER (ORDER BY n DESC) AS kept FROM h),
            sub AS (SELECT url FROM freq WHERE n >= coalesce((SELECT max(n) FROM cum WHERE kept >= 200), 0)),""",
    ).replace("dfs AS (SELECT term, count(*) AS df FROM hits", "dfs AS (SELECT term, count(*) AS df FROM hits SEMI JOIN sub USING (url)").replace("FROM hits JOIN dfs", "FROM hits SEMI JOIN sub USING (url) JOIN dfs")
)
def q3_rank_subset(s, d):
    """Over the pages of a threshold set only, which is also what counts as all pages."""
    words = S.query_words(QUERY, stemmed=False)
    hits, n = S.in_subset(S.word_postings(S.indexed_pages(s, d)), words)
    return _ranked_scores(s, d, S.scored(hits, words, n, float(len(words))), "weighted")


#: Stems of the query's words, asked of the index under words and stems.
_SEARCH = (
    _score_sql("0.95 * CASE WHEN t > 0 THEN ln(t) END + 0.05 * ln(greatest(coalesce(pr, 0.1), 1e-9))")
    .replace(_PAGES, _STEMMED)
    .replace(f"n AS tf FROM idx WHERE {_ASKED}", f"sum(n) AS tf FROM stemmed WHERE term IN ({_quoted(S.query_words(QUERY))}) GROUP BY term, url")
)


@query(_SEARCH)
def q4_search(s, d):
    best = S.search(s, d, QUERY)
    return best.select("rank", "url", F.round("tf_idf", 6).alias("tf_idf"), "pagerank", F.round("score", 6).alias("score"))


_TITLES = r"""titles AS (SELECT url, arg_max(trim(regexp_replace(regexp_extract(page, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), (fetched_at, page_id)) AS title
    FROM crawl WHERE page IS NOT NULL AND url IS NOT NULL GROUP BY url)"""


@query(f"""WITH best AS ({_SEARCH}), {_TITLES}
    SELECT rank, regexp_extract(url, {_URL}, 2) AS domain, url, coalesce(title, '') AS title FROM best LEFT JOIN titles USING (url)""")
def q4_response(s, d):
    """The results of a whole response, taken out of its JSON."""
    found = F.from_json("json", "spellcheck array<string>, results array<struct<domain string, url string, title string>>")
    one = S.answer(s, d, QUERY).select(found.alias("j")).where("j.spellcheck is null")
    each = one.select(F.posexplode("j.results").alias("rank", "r"))
    return each.select((F.col("rank") + 1).cast("int").alias("rank"), "r.domain", "r.url", "r.title")


@query(f"SELECT ['{"', '".join(S.tokenised(QUERY))}'] AS spellcheck")
def q4_spellcheck(s, d):
    """What a response to misspelt words says: the query as it was meant."""
    found = F.from_json("json", "spellcheck array<string>")
    return S.answer(s, d, QUERY.replace("harbour", "harbuor").replace("counted", "countde")).select(found["spellcheck"].alias("spellcheck"))


@query(r"""SELECT term, url FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(regexp_extract(url, '^[a-z]+://([^/:]*)', 1) || ' ' || regexp_replace(url, '^[a-z]+://[^/]*', '')), '[a-z0-9]+')) AS term, url
    FROM crawl WHERE url LIKE 'http%') WHERE term NOT IN ('http', 'https', 'com', 'net', 'edu', 'org', 'gov', 'www', 'xml', 'ttl', 'xmlj', 'rdf')""")
def q5_url_words(s, d):
    return S.url_index(s, d, stemmed=False)


@query(rf"""WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(lower(regexp_extract(url, '^[a-z]+://([^/:]*)', 1) || ' ' || regexp_replace(url, '^[a-z]+://[^/]*', '')), '[a-z0-9]+')) AS word, url
        FROM crawl WHERE url LIKE 'http%'), {stem_ctes("u")}
    SELECT DISTINCT stem AS term, url FROM u JOIN stems USING (word) WHERE word NOT IN ({_quoted(W.SKIPPED)})""")
def q5_url_index(s, d):
    return S.url_index(s, d)


@query(f"""WITH RECURSIVE {LINKS_SQL},
    edges AS (SELECT DISTINCT s.src, l.link AS dst FROM links l JOIN (SELECT DISTINCT seq, src FROM pageranks_temp) s USING (seq) WHERE s.src IS NOT NULL),
    seed AS (SELECT src FROM pageranks_temp WHERE src IS NOT NULL GROUP BY src ORDER BY count(DISTINCT seq) DESC, src LIMIT 1),
    reached(url, depth) USING KEY (url) AS (SELECT src, 0 FROM seed UNION
        SELECT e.dst, min(r.depth) + 1 FROM reached r JOIN edges e ON e.src = r.url
        WHERE NOT EXISTS (SELECT 1 FROM recurring.reached k WHERE k.url = e.dst) GROUP BY e.dst)
    SELECT url, CAST(depth AS INTEGER) AS depth FROM reached""")
def q6_crawl_replay(s, d):
    """Addresses and depths of a crawl over the stored link lists, from the most frequent source."""
    state = table(s, d, "pageranks_temp")
    edges = unpack_links(state).join(state.select("seq", F.col("src")).distinct(), "seq").select("src", F.col("link").alias("dst")).where("src is not null")
    seeds = state.where("src is not null").groupBy("src").agg(F.count_distinct("seq").alias("n")).orderBy(F.desc("n"), "src").limit(1).select(F.col("src").alias("url"))
    return G.crawl_order(edges, seeds)


@query(_score_sql("0.9 * coalesce(pr, 0) + 0.1 * t").replace("round(t, 6) AS tf_idf, pr AS pagerank, round(score, 6) AS score", "format('{:.2f}', round(pr, 6)) AS pagerank, format('{:.2f}', round(t, 6)) AS tf_idf, format('{:.2f}', round(score, 6)) AS score"))
def q7_result_table(s, d):
    """Ranks with all their figures as text."""
    figures = [F.format_string("%.2f", F.round(c, 6)).alias(c) for c in ("pagerank", "tf_idf", "score")]
    return _ranking(s, d, "weighted").select("rank", "url", *figures)


# ---------------------------------------------------------------- streams


@query("""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def st_hourly_events(s, d):
    from skeinflow.streaming.jobs import hourly_counts

    return hourly_counts(s, f"{d}/events.parquet").withColumn("value", F.round("value", 4))


@query(f"WITH {_PAGES} SELECT term, count(*) AS df FROM idx GROUP BY term")
def st_incremental_index(s, d):
    """The index built by a stream of the pages, one increment after the other."""
    from skeinflow.streaming.jobs import index_stream

    return index_stream(s, f"{d}/crawl.parquet").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
