"""Property graphs as node and edge tables: upserts, deletes, constraint checks, bounded neighbourhoods, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.shared import settled

MAX_DEPTH = 8


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, label, properties): the union of the properties, new values winning."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    flat = both.select("id", "label", "_v", F.explode_outer("properties").alias("k", "x"))
    last = flat.groupBy("id", "label", "k").agg(F.max_by("x", "_v").alias("x"))
    pairs = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "x")))
    return last.groupBy("id", "label").agg(F.map_from_entries(F.array_sort(pairs)).alias("properties"))


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src_id, dst_id, relationship): new edges join the old if both ends are there; each key once."""
    ids = nodes.select("id").distinct()
    known = new.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    keys = ["src_id", "dst_id", "relationship"]
    return old.select(keys).unionByName(known.select(keys)).distinct()


def delete_node(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without these nodes and the edges at them."""
    gone = ids.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "src_id"), "src_id", "left_anti").join(gone.withColumnRenamed("id", "dst_id"), "dst_id", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left


def reset(nodes: DataFrame, label_prefix: str | None = None) -> DataFrame:
    """What a reset leaves: nothing, or the nodes whose label lacks the prefix."""
    return nodes.limit(0) if label_prefix is None else nodes.filter(~F.col("label").startswith(label_prefix))


def uniqueness_violations(nodes: DataFrame, label: str, key: Column | str) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return nodes.filter(F.col("label") == label).groupBy(key.alias("value")).count().filter("value is not null and count > 1")


def existence_violations(nodes: DataFrame, label: str, key: Column | str) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return nodes.filter((F.col("label") == label) & key.isNull()).select("id")


def _both_ways(edges: DataFrame) -> DataFrame:
    out = edges.select("edge_id", F.col("src_id").alias("at"), F.col("dst_id").alias("to"), "relationship")
    return out.union(edges.filter("src_id != dst_id").select("edge_id", "dst_id", "src_id", "relationship"))


def _starts(start: DataFrame) -> DataFrame:
    return start.select(F.col("id").alias("start"), F.col("id"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("types"), F.array().cast("array<bigint>").alias("edges")).distinct()


def _longer(front: DataFrame, both: DataFrame) -> DataFrame:
    """The paths with one more edge, none twice: an equi-join of the frontier with the edges."""
    step = front.join(both, front["id"] == both["at"]).filter(~F.array_contains("edges", F.col("edge_id")))
    return step.select("start", F.col("to").alias("id"), (F.col("depth") + 1).alias("depth"), F.concat("types", F.array("relationship")).alias("types"), F.concat("edges", F.array(F.col("edge_id").cast("bigint"))).alias("edges"))


def paths(edges: DataFrame, start: DataFrame, depth: int = 1) -> DataFrame:
    """Paths of 1 to depth edges, in either direction, from each start id, no edge twice: start, id, depth, types, edges.

    edges: edge_id, src_id, dst_id, relationship. All paths are listed; for the nodes alone see neighbor_nodes().
    """
    both, front, found = _both_ways(edges), _starts(start), None
    for _ in range(max(1, min(MAX_DEPTH, depth))):
        front = _longer(front, both)
        found = front if found is None else found.unionAll(front)
    return found


def neighbors(edges: DataFrame, start: DataFrame, depth: int = 1, limit: int = 50) -> DataFrame:
    """The first `limit` paths by depth, then id, then edges, so the answer is always the same. Paths are only made longer while those there are do not fill the limit, so at most `limit` of them are."""
    both, front, found, n = _both_ways(edges), _starts(start), None, 0
    for d in range(1, max(1, min(MAX_DEPTH, depth)) + 1):
        front = _longer(front, both)
        if d < depth:
            front = settled(front)
            n += front.count()
        found = front if found is None else found.unionAll(front)
        if n >= limit:
            break
    return found.orderBy("depth", "id", "edges").limit(limit)


def neighbor_nodes(edges: DataFrame, start: DataFrame, depth: int = 1) -> DataFrame:
    """Each node that a path of at most depth edges, none twice, reaches, once, with the least depth: start, id, depth.

    A search by frontier, so work grows with the edges, not with the paths. A node keeps at most two ways to it that leave the start by different
    edges: one gives its depth, and two are what the shortest way back to the start needs, which must end with another edge than it began with.
    """
    depth = max(1, min(MAX_DEPTH, depth))
    both = _both_ways(edges)
    ids = start.select(F.col("id").alias("start")).distinct()
    step = ids.join(both, ids["start"] == both["at"]).select("start", F.col("to").alias("id"), F.col("edge_id").alias("first"))
    back = step.filter("id = start").select("start", "id", F.lit(1).alias("depth"))
    front = seen = _two_ways(step.filter("id != start")).withColumn("depth", F.lit(1))
    for d in range(2, depth + 1):
        if d > 2:
            front, seen = settled(front), settled(seen)
        step = front.select("start", F.col("id").alias("from"), "first").join(both, F.col("from") == F.col("at")).filter("not (to = start and edge_id = first)").select("start", F.col("to").alias("id"), "first")
        back = back.union(step.filter("id = start").select("start", "id", F.lit(d).alias("depth")))
        known = seen.groupBy("start", "id").agg(F.count("*").alias("n"), F.min("first").alias("k"))
        new = _two_ways(step.filter("id != start").distinct().join(known, ["start", "id"], "left").filter("n is null or (n = 1 and first != k)"), F.coalesce("n", F.lit(0)))
        front = new.withColumn("depth", F.lit(d))
        seen = seen.unionAll(front)
    return seen.select("start", "id", "depth").unionAll(back).groupBy("start", "id").agg(F.min("depth").alias("depth"))


def _two_ways(step: DataFrame, known: Column | None = None) -> DataFrame:
    """start, id, first: two of the first edges to each node, or one where one is known."""
    known = F.lit(0) if known is None else known
    ends = step.groupBy("start", "id").agg(F.min("first").alias("a"), F.max("first").alias("b"), F.max(known).alias("n"))
    return ends.select("start", "id", F.explode(F.when((F.col("n") == 0) & (F.col("a") != F.col("b")), F.array("a", "b")).otherwise(F.array("a"))).alias("first"))


def nearest_nodes(edges: DataFrame, start: DataFrame, depth: int = 1, limit: int = 50) -> DataFrame:
    """start, id, depth: of each start the first `limit` other nodes by depth, then id, within `depth` edges in either direction.

    For many starts, all nodes among them. A start goes on from the nodes of its last step until it has `limit`. It has seen fewer then, so of a
    node's neighbours the first 2 * limit + 1 are enough: they hold `limit` new ones, or are all. So a hub costs its starts that many rows and
    not its edges, and a step makes limit * (2 * limit + 1) rows for a start at most.
    """
    ways = _both_ways(edges).filter("at != to").select("at", "to").distinct()
    near = settled(_first(ways, "at", "to", 2 * limit + 1).drop("_n"))
    seen = settled(start.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct())
    front = seen
    for d in range(1, max(1, min(MAX_DEPTH, depth)) + 1):
        step = front.select("start", F.col("id").alias("at")).join(near, "at").select("start", F.col("to").alias("id")).distinct()
        new = _first(step.join(seen, ["start", "id"], "left_anti"), "start", "id", limit)
        have = seen.groupBy("start").agg((F.count("*") - 1).alias("have"))
        kept = settled(new.join(have, "start").filter(F.col("_n") + F.col("have") <= limit).select("start", "id", F.lit(d).alias("depth")))
        seen = settled(seen.unionAll(kept))
        if d < depth:
            more = seen.groupBy("start").agg(F.count("*").alias("n")).filter(F.col("n") <= limit)
            front = settled(kept.join(more.select("start"), "start", "left_semi"))
            if front.isEmpty():
                break
    return seen.filter("depth > 0")


def _first(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows of each key, with their number _n; tasks leave the others out before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_n") <= n)


def context(edges: DataFrame, entity: DataFrame, undirected: bool = False) -> DataFrame:
    """direction, id, relationship at one entity."""
    ids = entity.select(F.col("id").alias("_e")).distinct()
    incoming = edges.join(ids, edges["dst_id"] == ids["_e"]).select(F.lit("incoming").alias("direction"), F.col("src_id").alias("id"), "relationship")
    outgoing = edges.join(ids, edges["src_id"] == ids["_e"]).select(F.lit("outgoing").alias("direction"), F.col("dst_id").alias("id"), "relationship")
    both = incoming.unionAll(outgoing)
    return both.select(F.explode(F.array(F.lit("incoming"), F.lit("outgoing"))).alias("direction"), "id", "relationship").distinct() if undirected else both


def impact_candidates(target: str) -> list[str]:
    found = [f"file:{target}", f"crate:{target}", target]
    return list(dict.fromkeys(found))


def impact(nodes: DataFrame, edges: DataFrame, candidates: DataFrame, depth: int = 2, limit: int = 50) -> DataFrame:
    """What lies near the candidates (id, rank), each node once by the first candidate that reaches it, as test, doc or component."""
    near = neighbor_nodes(edges, candidates.select("id"), depth).join(candidates.select(F.col("id").alias("start"), "rank"), "start")
    first = near.groupBy("id").agg(F.min(F.struct("rank", "depth")).alias("_f")).select("id", "_f.rank", "_f.depth")
    named = first.join(nodes.select("id", "label"), "id", "left")
    label, key = F.lower(F.coalesce("label", F.lit(""))), F.lower("id")
    section = F.when(label.contains("test") | key.contains("/test"), "tests").when(label.contains("doc") | F.col("id").startswith("doc:"), "docs").otherwise("components")
    w = Window.partitionBy("section").orderBy("rank", "depth", "id")
    return named.withColumn("section", section).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def project_files(files: DataFrame, unit: Column, file_label: str = "File", unit_label: str = "Crate") -> tuple[DataFrame, DataFrame]:
    """Nodes and CONTAINS edges of files (path, language) and the unit that holds each."""
    own = files.select("path", "language", unit.alias("unit"))
    file_nodes = own.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit(file_label).alias("label"), F.create_map(F.lit("path"), F.col("path"), F.lit("language"), F.col("language")).alias("properties"))
    units = own.select("unit").distinct().select(F.concat(F.lit("crate:"), "unit").alias("id"), F.lit(unit_label).alias("label"), F.create_map(F.lit("name"), F.col("unit")).alias("properties"))
    edges = own.select(F.concat(F.lit("crate:"), "unit").alias("src_id"), F.concat(F.lit("file:"), "path").alias("dst_id"), F.lit("CONTAINS").alias("relationship"))
    return file_nodes.unionByName(units), edges
