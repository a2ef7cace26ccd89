"""Operator 9: n-gram Jaccard join in the metric space of shingle sets.

Two documents link when the Jaccard similarity of their distinct five-word shingles is at
least 0.8 (distance 0.2, tested in whole numbers: 9 * common >= 4 * (n1 + n2)).  The result
is every document's component under these links.

1. Documents with the same shingle set are one node (their smallest id), so copies never meet each other.
2. Voronoi cells, first level.  Distances between most documents are 1, so documents as pivots would tell
   nothing there and every window would hold all documents.  The pivots are single shingles, ordered: a
   set lies nearest the pivots it contains, the first of them in the order being its cell.  By the triangle
   inequality a partner lacks at most n / 5 of the set's n shingles, so its cell is one of the set's first
   n // 5 + 1 pivots: the set is replicated to just these cells, and every linked pair meets in one.  Any
   order is right; frequent shingles (found in a part of the corpus, kept in a Bloom filter of fixed size) come
   last, so a passage that many documents share makes no cell of its own unless it makes up most of a text.
3. Inside a cell the pivot document is the member whose prefix meets most other members on average (ties by the content's
   signature, never by id), and each member is compared with it: linear in the cell.  Then components are formed.  In
   cells that still hold several, the most central member outside the pivot's component is the next pivot, and so on as
   long as a round finds links (STARS rounds at most; what they leave is joined by the next step, so nothing is lost).
4. Small cells compare the pairs that are in different components.  Large cells with the same pivot document are
   one region, that document's.  A region that is still large is cut again: its members' distances to a new pivot
   document make rings of width 0.2, a member is replicated from its ring to the next (the triangle-inequality
   window), and the parts are joined in the same way.

Pairs are sifted by size, then by the prefixes' common part (an upper bound of the overlap), and only then
compared exactly; pairs inside one component are never compared, as they cannot change the result.

Defined cases: a document without words (or with a null text) has no shingles and links with nothing; fewer than
five words are one shingle; rows with the same id are one node whose links are those of all its rows; a row with
a null id has component null unless it is a copy of a document with an id; an empty table gives no rows; extra
columns are ignored.  Shingles are compared as 64-bit hashes, whole sets as 128 bits and size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import Scratch, prepare, shared_table, table
from .components import components
from .shingles import distinct_per_row, list_column, mix, shingle_hashes

LINK = "9 * common >= 4 * (na + nb)"
NEAR_SIZE = "5 * least(na, nb) >= 4 * greatest(na, nb)"
HOT_PART, HOT_COUNT = 16, 3  # shingles of 3 texts in one sixteenth of the corpus count as frequent
HOT_KEYS = 2_000_000  # the count is doubled until no more shingles than this are frequent
LARGE = 128  # members of a cell above which its pivot document's region takes its place
TASK_PAIRS = 20_000  # pairs that one task compares
CUT = 4096  # members of a region above which it is cut into rings
STARS = 2  # further rounds of pivot documents before pairs are made; each reads the texts of its members once more


def _pick(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as id", f"`{text_col}` as t")


def shingle_sets(picked: DataFrame, frequent: np.ndarray | None, whole: bool = False) -> DataFrame:
    """id, n, s1, s2 (signature of the set) and its first n // 5 + 1 shingles (all, if ``whole``) in the order
    (frequent, hash); last_often and last give the place of the prefix's last shingle in that order."""
    hot = picked.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = hot.value
        for b in batches:
            rows = len(b.column("t"))
            h, r = distinct_per_row(*shingle_hashes(b.column("t")))
            n = np.bincount(r, minlength=rows).astype(np.int64)
            s1, s2 = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            last_often, last = np.zeros(rows, bool), np.zeros(rows, np.uint64)
            if len(h):
                has = np.flatnonzero(n)
                at = (np.cumsum(n) - n)[has]
                s1[has] = np.add.reduceat(mix(h ^ np.uint64(0x1F83D9ABFB41BD6B)), at)
                s2[has] = np.add.reduceat(mix(h + np.uint64(0x5BE0CD19137E2179)), at)
                often = np.zeros(len(h), bool)
                if words is not None:
                    often = bloom.contains(words, h)
                    order = np.lexsort((often, r))  # stable: by row, then frequent last, then hash
                    h, often = h[order], often[order]
                if not whole:
                    keep = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) < (n // 5 + 1)[r]
                    h, r, often = h[keep], r[keep], often[keep]
                ends = np.append(np.flatnonzero(r[1:] != r[:-1]), len(r) - 1)
                last_often[r[ends]], last[r[ends]] = often[ends], h[ends]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), list_column(h, r, rows),
                 pa.array(last_often), pa.array((last ^ np.uint64(1 << 63)).view(np.int64))],
                ["id", "n", "s1", "s2", "prefix", "last_often", "last"])

    return picked.mapInArrow(run, "id long, n long, s1 long, s2 long, prefix array<long>, last_often boolean, last long")


def frequent_shingles(picked: DataFrame) -> np.ndarray | None:
    """Bloom filter of shingles that come often; it only orders the pivots and cannot change the result."""
    part = picked.where(F.pmod(F.xxhash64("id"), F.lit(HOT_PART)) == 0)
    sets = shingle_sets(part, None, whole=True).where("n > 0").dropDuplicates(["s1", "s2", "n"])
    often = sets.select(F.explode("prefix").alias("cell")).groupBy("cell").count().where(F.col("count") >= HOT_COUNT)
    often = shared_table(often, "frequent")
    least = HOT_COUNT
    while (keys := often.where(F.col("count") >= least).count()) > HOT_KEYS:
        least *= 2
    return bloom.build(often.where(F.col("count") >= least), "cell", keys) if keys else None


def whole_sets(picked: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """(id, h) with all shingles of the documents in ``ids``, and perhaps a few more: a Bloom filter picks them in the
    scan as long as one can hold the ids, a semi-join beyond."""
    n = ids.count()
    if n > bloom.MOST_KEYS:
        picked, n = picked.join(ids.select(F.col(col).alias("id")), "id", "left_semi"), 0
    wanted = picked.sparkSession.sparkContext.broadcast(bloom.build(ids, col, n) if n else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = wanted.value
        for b in batches:
            b = b.filter(pa.array(b.column("id").is_valid()))
            if words is not None:
                ids = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                b = b.filter(pa.array(bloom.contains(words, ids)))
            if b.num_rows:
                h, r = distinct_per_row(*shingle_hashes(b.column("t")))
                yield pa.RecordBatch.from_arrays([b.column("id"), list_column(h, r, b.num_rows)], ["id", "h"])

    return picked.mapInArrow(run, "id long, h array<long>")


def _both(pairs: DataFrame, of: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Joins the columns of node table ``of`` to both ends of (a, b)."""
    for end in ("a", "b"):
        pairs = pairs.join(of.select(F.col("node").alias(end), *[F.col(c).alias(f"{s}{end}") for c, s in cols.items()]), end)
    return pairs


def _may_link() -> Column:
    """Whether the prefixes' common part allows a link.  Common shingles up to the lesser of the two prefix ends are in
    both prefixes, and that end's set has few others."""
    lesser = F.struct("oa", "la") <= F.struct(F.col("ob").alias("oa"), F.col("lb").alias("la"))
    rest = F.when(lesser, F.col("na") - F.size("pa")).otherwise(F.col("nb") - F.size("pb"))
    return 9 * (F.size(F.array_intersect("pa", "pb")) + rest) >= 4 * (F.col("na") + F.col("nb"))


def _sift(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs that sizes and prefixes allow to link, with the common part of the prefixes."""
    sized = _both(pairs, nodes, {"n": "n"}).where(NEAR_SIZE).select("a", "b")
    both = _both(sized, nodes, {"n": "n", "prefix": "p", "last_often": "o", "last": "l"})
    return both.where(_may_link()).select("a", "b", F.size(F.array_intersect("pa", "pb")).alias("k"))


def _few(df: DataFrame, rows: int) -> DataFrame:
    """As many tasks as the rows are worth: the tables of late rounds are small."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // TASK_PAIRS))


def _compare(picked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b) -> a, b, na, nb, common, by whole sets."""
    n = pairs.count()
    ends = shared_table(_few(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), n), "ends")
    sets = shared_table(whole_sets(picked, ends, "id").withColumnRenamed("id", "node").withColumn("n", F.size("h").cast("long")), "sets")
    both = _both(pairs.select("a", "b"), sets, {"n": "n", "h": "h"})
    return shared_table(_few(both.select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("common")), n), "compared")


def _labelled(df: DataFrame, labels: DataFrame | None, node: str, name: str) -> DataFrame:
    if labels is None:
        return df.withColumn(name, F.col(node))
    return (df.join(labels.select(F.col("node").alias(node), F.col("component").alias("__c")), node, "left")
            .withColumn(name, F.coalesce("__c", node)).drop("__c"))


def _open_pairs(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs whose ends are in different components."""
    return _labelled(_labelled(pairs, labels, "a", "la"), labels, "b", "lb").where("la != lb").drop("la", "lb")


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.where(LINK).select("a", "b")


def _mixed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of regions that still hold several components, with their label."""
    named = _labelled(members, labels, "node", "label")
    several = (named.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"))
               .where("lo != hi").select("region", "size"))
    return named.join(several, "region")


def _cut(picked: DataFrame, large: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Rings round a new pivot document per region (the same one in overlapping regions): (links found, members of the parts)."""
    pivots = large.groupBy("region").agg(F.min_by("node", F.xxhash64(F.lit(depth), "node")).alias("pivot"))
    at = large.join(pivots, "region")
    pairs = at.where("node != pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    seen = _compare(picked, pairs)
    found = seen.groupBy("a", "b").agg(F.max(F.expr("common / (na + nb - common)")).alias("j"), F.max(F.expr(LINK)).alias("link"))
    at = (at.withColumns({"a": F.least("node", "pivot"), "b": F.greatest("node", "pivot")}).join(found, ["a", "b"], "left")
          .where("node != pivot"))
    ring = F.floor((1 - F.coalesce("j", F.lit(0.0))) * 5 + F.lit(1e-9)).cast("int")
    parts = (at.withColumn("ring", F.explode(F.array(ring, ring + 1)))
             .select(F.xxhash64("region", "ring").alias("region"), "node").distinct())
    return found.where("link").select("a", "b"), parts


def _cell_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of different components inside the same small cell that sizes and prefixes allow to link."""
    side = lambda x: members.select("region", F.col("node").alias(x), F.col("label").alias(f"c{x}"))
    pairs = side("a").join(side("b"), "region").where("a < b and ca != cb").select("a", "b").distinct()
    return _sift(pairs, nodes).select("a", "b")


def _region_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same for large regions, of which there are few.

    The bounds are part of the join's condition, so of the pairs looked at only the promising ones become rows."""
    full = members.select("region", "node", "label").join(nodes, "node")
    ring = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + F.lit(1e-9)).cast("int")

    def side(x: str) -> DataFrame:
        return full.select("region", F.col("node").alias(x), F.col("label").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("prefix").alias(f"p{x}"),
                           F.col("last_often").alias(f"o{x}"), F.col("last").alias(f"l{x}"), ring.alias("ring"))

    left = side("a").withColumn("ring", F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)))
    pairs = left.join(side("b"), ["region", "ring"]).where("a < b and ca != cb").where(NEAR_SIZE).where(_may_link())
    return pairs.select("a", "b").distinct()


def _pivots(members: DataFrame) -> DataFrame:
    """region, pivot, last: of the members (region, node, weight, sign) the one with the greatest weight, and another if there is one."""
    rank = F.struct("weight", "sign", "node")
    return members.groupBy("region").agg(F.max(rank).alias("p"), F.min(rank).alias("l")).where("p.node != l.node").select("region", F.col("p.node").alias("pivot"))


def _star(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, k): pivots of the regions with the members that sizes and prefixes allow to link."""
    pairs = members.join(_pivots(members), "region").where("node != pivot")
    return shared_table(_sift(pairs.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), nodes), "star")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    with Scratch(docs.sparkSession) as scratch:
        return scratch.keep(_near_components(_pick(docs, id_col, text_col), rounds), "near-components")


def _near_components(picked: DataFrame, rounds: int) -> DataFrame:
    sets = shared_table(shingle_sets(picked, frequent_shingles(picked)), "shingle-sets")
    key = ["s1", "s2", "n"]
    classes = sets.where("n > 0").groupBy(*key).agg(F.min("id").alias("node"))
    classes = shared_table(classes, "classes")
    nodes = (sets.where("n > 0").withColumnRenamed("id", "node").join(classes, [*key, "node"], "left_semi")
             .select("node", "n", "prefix", "last_often", "last", F.col("s1").alias("sign")))
    nodes = shared_table(nodes, "nodes")

    # a row per shingle of every prefix: only its two numbers are dealt out by shingle, the node's own columns come later
    cells = nodes.select("node", F.explode("prefix").alias("region"))
    sizes = cells.groupBy("region").agg(F.count(F.lit(1)).alias("others")).where("others > 1").withColumn("others", F.col("others") - 1)
    members = shared_table(cells.join(sizes, "region"), "cells")
    # how many other members each pivot shingle of a node meets, on average over its window
    weight = members.groupBy("node").agg(F.sum("others").alias("others"))
    of = nodes.groupBy("node").agg(F.min("n").alias("n"), F.min("sign").alias("sign"))
    weight = weight.join(of, "node").select("node", (F.col("others") / F.expr("n div 5 + 1")).alias("weight"), "sign")
    members = shared_table(members.drop("others").join(weight, "node").select("region", "node", "weight", "sign"), "members")
    star = _star(members, nodes)

    # each node's most promising pivot first; what these links join needs no further comparison
    best = star.groupBy("b").agg(F.max_by("a", "k").alias("a")).select("a", "b")
    links = _links(_compare(picked, best))
    labels = components(links)

    def compare_open(found: DataFrame, links: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
        pairs = shared_table(found, "pairs")
        if pairs.isEmpty():
            return links, labels, False
        new = _links(_compare(picked, pairs))
        links = links.unionByName(new)
        return links, components(links), not new.isEmpty()

    links, labels, _ = compare_open(_open_pairs(star.join(best, ["a", "b"], "left_anti").select("a", "b"), labels), links, labels)

    # cells whose members are in different components: the next pivot is the most central member outside its component
    pivots = _pivots(members)
    mixed = shared_table(_mixed(members.join(pivots, "region"), labels), "mixed")
    left, more, round_ = mixed, not mixed.isEmpty(), 0
    while more and round_ < STARS:
        of = _labelled(left.select("region", "node", "weight", "sign", "pivot"), labels, "node", "label")
        of = _labelled(of, labels, "pivot", "own").where("label != own").select("region", "node", "weight", "sign")
        left = shared_table(of.join(_pivots(of), "region"), "open")
        rest = left.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
        links, labels, more = compare_open(_open_pairs(_sift(rest, nodes).select("a", "b"), labels), links, labels)
        round_ += 1

    # what is left: small cells compare their open pairs, large ones with the same pivot document become its region
    mixed = shared_table(_mixed(mixed.where("node != pivot").select("region", "node", "pivot"), labels), "mixed")
    large = mixed.where(F.col("size") > LARGE)
    regions = shared_table(large.select(F.col("pivot").alias("region"), "node").distinct(), "regions")
    links, labels, _ = compare_open(_cell_pairs(mixed.where(F.col("size") <= LARGE), nodes), links, labels)
    depth = 0
    while not regions.isEmpty():
        mixed = shared_table(_mixed(regions, labels), "mixed")
        cut = mixed.where(F.col("size") > CUT).select("region", "node") if depth < rounds else mixed.limit(0)
        again = not cut.isEmpty()
        links, labels, _ = compare_open(_region_pairs(mixed.where(F.col("size") <= CUT) if depth < rounds else mixed, nodes), links, labels)
        if not again:
            break
        found, regions = _cut(picked, cut, depth)
        links, regions = links.unionByName(found), shared_table(regions, "regions")
        labels = components(links)
        depth += 1

    named = _labelled(classes, labels, "node", "component_id")
    full = sets.where("n > 0").select("id", *key).join(named.select(*key, "component_id"), key)
    none = sets.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.select("id", "n", "component_id").unionByName(none).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and component."""
    prepare(spark)
    return near_components(table(spark, sf_dir, "documents"))


# All pairs that share a shingle, in DuckDB, then reachability.
ORACLE_OP9 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
r AS (SELECT doc_id, doc_id AS reach FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
