"""Link graph of the crawl: edges, PageRank, replay of a crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions.urls import normalized, page_links, passes_language, without_fragment
from skeinflow.session import bucketed, discard, written
from skeinflow.sources.tables import table

DAMPING, FLOOR = 0.85, 0.15


def fetched_pages(spark: SparkSession, folder: str, english_only: bool = False) -> DataFrame:
    """(url, links): normal form of the address and the links of its body; of several fetches of a page the last.

    Both are lower-cased, as the rank job does.  Links are taken out where pages are read, so no body moves.
    """
    crawl = table(spark, folder, "crawl").where("page is not null and url is not null")
    if english_only:
        crawl = crawl.where(passes_language(F.col("url")))
    low = F.lower(F.col("url"))
    address = normalized(low, without_fragment(low))
    pages = crawl.select(address.alias("url"), F.struct("fetched_at", "page_id", page_links(F.lower(F.col("page"))).alias("links")).alias("f")).where("url is not null")
    return pages.groupBy("url").agg(F.max("f").alias("f")).select("url", F.col("f.links").alias("links"))


def links(pages: DataFrame) -> DataFrame:
    """(src, dst) for each link of each page, with repeats."""
    each = pages.select(F.col("url").alias("src"), F.explode("links").alias("link"))
    return each.select("src", normalized(F.col("src"), F.col("link")).alias("dst")).where("dst is not null")


def known_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(src, dst, n): edges between vertices, parallel ones as one with their number.

    Parallel edges are counted first, so a target that most links have moves once for each source.
    """
    each = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return each.join(vertices.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "n")


def shared_out(counted: DataFrame) -> DataFrame:
    """(src, dst, share): the share of the source's links that an edge is."""
    out = counted.groupBy("src").agg(F.sum("n").alias("out"))
    return counted.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share"))


def inner_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(src, dst, share): edges between vertices, parallel ones as one, with the share of the source's links they are."""
    return shared_out(known_edges(edges, vertices))


class SpreadEdges:
    """(src, part, dst, share) in buckets of src and part: written once, and read by every round without a shuffle.

    The edges of a source that has more than a bucket's share of them are spread over PARTS parts by their target, and its
    rank is sent to each part.  Each such source has more than 1/buckets of the edges, so there are fewer of them than
    buckets; their list is all that reaches the driver.
    """

    PARTS = 64

    def __init__(self, edges: DataFrame, at_least: int = 10_000):
        spark = edges.sparkSession
        edges = written(edges, "edges")
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        most = max(at_least, edges.count() // buckets)
        self.hot = [r["src"] for r in edges.groupBy("src").count().where(F.col("count") > most).select("src").collect()]
        part = F.when(F.col("src").isin(self.hot), F.pmod(F.xxhash64("dst"), F.lit(self.PARTS)).cast("int")).otherwise(0) if self.hot else F.lit(0)
        self.edges, self.table = bucketed(edges.withColumn("part", part), "src", "part", name="edges")
        discard(edges)

    def drop(self) -> None:
        """Forgets the table and deletes its files, once no round reads it any more."""
        files = self.edges.select("*")
        discard(files)
        files.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")

    def sent(self, ranks: DataFrame) -> DataFrame:
        """(src, part, r): each rank for each part of its edges."""
        parts = F.sequence(F.lit(0), F.when(F.col("id").isin(self.hot), self.PARTS - 1).otherwise(0)) if self.hot else F.array(F.lit(0))
        return ranks.select(F.col("id").alias("src"), F.explode(parts).alias("part"), F.col("rank1").alias("r"))


def rank_round(ranks: DataFrame, spread: SpreadEdges) -> DataFrame:
    """(id, rank0, rank1): the ranks before and after one round.  Vertices without links give nothing to others."""
    moved = spread.edges.join(spread.sent(ranks), ["src", "part"])
    received = moved.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("share") * DAMPING).alias("val"))
    new = F.coalesce(F.col("val"), F.lit(0.0)) + FLOOR
    return ranks.join(received, "id", "left").select("id", F.col("rank1").alias("rank0"), new.alias("rank1"))


def start_ranks(vertices: DataFrame) -> DataFrame:
    return vertices.select("id", F.lit(1.0).alias("rank0"), F.lit(1.0).alias("rank1"))


def converged(ranks: DataFrame, eps: float) -> tuple[int, int]:
    """(vertices whose rank moved by less than eps, all vertices)."""
    row = settled(ranks, eps).first()
    return row["done"], row["n"]


def settled(ranks: DataFrame, eps: float) -> DataFrame:
    """(done, n), one row: the vertices whose rank moved by less than eps, and all."""
    return ranks.agg(F.count_if(F.abs(F.col("rank1") - F.col("rank0")) < eps).alias("done"), F.count(F.lit(1)).alias("n"))


def pagerank(vertices: DataFrame, edges: DataFrame, rounds: int | None = None, eps: float = 0.01, share: float = 0.8, most: int = 1000, hot_source: int = 10_000, settle: bool = False) -> DataFrame:
    """(id, rank0, rank1) after ``rounds`` rounds; without a number, when ``share`` of the vertices moved by less than
    eps in a round, or after ``most``; with ``settle``, reaching ``most`` before that is an error.

    ``edges`` are (src, dst) with repeats; a source with more than ``hot_source`` of them may be spread.  Edges are put
    into buckets once, so a round shuffles ranks and what they send, added up on the map side, but no edges.  Each round
    is written to the shared folder, so a lost executor costs one round and lineage stays short.
    """
    vertices = written(vertices.select("id").distinct(), "vertices")
    counted = written(known_edges(edges, vertices), "counted")  # read twice: pages are parsed once
    spread = SpreadEdges(shared_out(counted), hot_source)
    discard(counted)
    ranks = written(start_ranks(vertices), "ranks")
    for k in range(rounds if rounds is not None else most):
        before, ranks = ranks, written(rank_round(ranks, spread), "ranks")
        discard(before)  # a round reads the last one only
        if rounds is None:
            done, n = converged(ranks, eps)
            if done >= share * n:
                break
    else:
        if rounds is None and settle:
            raise RuntimeError(f"ranks haven't settled after {most} rounds")
    spread.drop()
    return ranks


def crawl_order(edges: DataFrame, seeds: DataFrame, every: int = 20) -> DataFrame:
    """(url, depth) of a crawl's replay from the seeds over (src, dst): each address at its first depth.

    The frontier of a step is what the last one links to, without what was visited before; it ends when there is none, which
    it does, as each step visits an address anew.  Edges are in buckets of their source, written once, so a step moves its
    frontier and what it reaches only.  What was visited is one table for every ``every`` steps, besides the frontiers since.
    """
    spark = edges.sparkSession
    links, name = bucketed(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "src", name="links")
    frontier = written(seeds.select("url").where("url is not null").distinct().withColumn("depth", F.lit(0)), "frontier")
    parts, depth = [frontier], 0
    while True:
        depth += 1
        visited = _union(parts)
        reached = links.join(frontier.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        frontier = written(reached.join(visited.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            discard(frontier)
            break
        parts.append(frontier)
        if len(parts) > every:
            whole = written(_union(parts), "visited")
            for p in parts[:-1]:  # the last is the frontier of the next step
                discard(p)
            last, parts = frontier, [whole]
            frontier = whole.where(F.col("depth") == depth)
            discard(last)
    discard(links)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
