"""Knowledge-graph operators over tables: entities (id, name, type, description, chunks), edges (src, dst, type, weight, chunks).

A multigraph: two relations between the same pair are two rows.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..functions import text as tx
from ..session import Workspace
from .retrieval import top

# Order of entity types in titles.
TYPE_PRIORITY = {"Concept": 0, "Organization": 1, "Person": 2, "Technology": 3}


def _union(c: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))


def merge_entities(rows: DataFrame, by_type: bool = True) -> DataFrame:
    """Entities (name, type, description, chunks, ord) merged by lower-cased name and type (or name only): chunks united,
    the longest description, name and type of the first by ord."""
    keys = [F.lower("name").alias("name_key")] + ([F.lower("type").alias("type_key")] if by_type else [])
    return rows.groupBy(*keys).agg(F.min_by("name", "ord").alias("name"), F.min_by("type", "ord").alias("type"), F.max_by("description", F.struct(F.length("description"), -F.col("ord"))).alias("description"), _union("chunks").alias("chunks"), F.count(F.lit(1)).alias("mentions"))


def merge_edges(rows: DataFrame) -> DataFrame:
    """Edges (src, dst, type, weight, chunks, ord) merged by lower-cased ends and type: the first weight plus one for every other."""
    keys = [F.lower(c).alias(f"{c}_key") for c in ("src", "dst", "type")]
    return rows.groupBy(*keys).agg((F.min_by("weight", "ord") + F.count(F.lit(1)) - 1).alias("weight"), _union("chunks").alias("chunks"))


def resolve(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose both ends are known, with src_id and dst_id; names match case-insensitively."""
    s = entities.select(F.lower("name").alias("__s"), F.col("id").alias("src_id"))
    d = entities.select(F.lower("name").alias("__d"), F.col("id").alias("dst_id"))
    return edges.join(s, F.lower("src") == F.col("__s")).join(d, F.lower("dst") == F.col("__d")).drop("__s", "__d")


def validate(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of a chunk both of whose ends were extracted from the same chunk."""
    names = entities.select("chunk_id", F.lower("name").alias("n"))
    out = edges
    for c in ("src", "dst"):
        out = out.join(names.select(F.col("chunk_id").alias("__c"), F.col("n").alias("__n")), (F.col("chunk_id") == F.col("__c")) & (F.lower(c) == F.col("__n")), "left_semi")
    return out


# Types an extractor may give; others become Other.
ENTITY_TYPES = ("Person", "Organization", "Location", "Concept", "Technology", "Event", "Product", "Date", "Other")


def _run(k: int, at: Column) -> Column:
    return F.array_join(F.slice("__t", at, k), " ")


def dictionary_entities(docs: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 200_000) -> DataFrame:
    """(doc_id, name, type, mentions): names of a dictionary (name, type: lower case, one to three tokens) in the documents' tokens.

    Runs of up to three tokens are cut inside a document's row and met with the dictionary: broadcast if it has at most
    `most` names, else shuffled.
    """
    longest = dictionary.agg(F.max(F.size(tx.tokens(F.col("name")))).alias("k"), F.count(F.lit(1)).alias("n")).first()
    names = dictionary.select(F.array_join(tx.tokens(F.col("name")), " ").alias("__key"), "name", "type")
    names = F.broadcast(names) if longest["n"] <= most else names
    rows = docs.select(F.col(id_col).alias("doc_id"), tx.tokens(F.col(text_col)).alias("__t"))
    runs = [F.col("__t")]
    for k in range(2, min(3, longest["k"] or 1) + 1):
        starts = F.when(F.size("__t") >= k, F.sequence(F.lit(1), F.size("__t") - k + 1)).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(starts, partial(_run, k)))
    rows = rows.select("doc_id", F.explode(F.concat(*runs)).alias("__key"))
    return rows.join(names, "__key").groupBy("doc_id", "name", "type").agg(F.count(F.lit(1)).alias("mentions"))


def mention_list(asked: DataFrame, held: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): documents by how often they mention the entities that a query mentions; asked
    (query_id, name), held (doc_id, name, mentions)."""
    rows = held.join(asked.select("query_id", "name").distinct(), "name")
    return top(rows.groupBy("query_id", "doc_id").agg(F.sum("mentions").cast("double").alias("score")), k)


_EXTRACTION = "entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,target:string,type:string,description:string>>"


def parsed_entities(responses: DataFrame, key: str, most: int = 50) -> DataFrame:
    """(key, name, type, description) of model answers (column response) with a JSON object; at most `most` an answer."""
    rows = responses.select(key, F.explode(F.slice(parse.json_object(F.col("response"), _EXTRACTION)["entities"], 1, most)).alias("e"))
    kind = F.when(F.col("e.type").isin(*ENTITY_TYPES), F.col("e.type")).otherwise("Other")
    return rows.where("length(trim(e.name)) > 0").select(key, F.trim("e.name").alias("name"), kind.alias("type"), F.col("e.description").alias("description"))


def parsed_relationships(responses: DataFrame, key: str) -> DataFrame:
    """(key, src, dst, type, description) of the same answers."""
    rows = responses.select(key, F.explode(parse.json_object(F.col("response"), _EXTRACTION)["relationships"]).alias("r"))
    return rows.where("r.source is not null and r.target is not null").select(key, F.col("r.source").alias("src"), F.col("r.target").alias("dst"), F.coalesce("r.type", F.lit("RELATED_TO")).alias("type"), F.col("r.description").alias("description"))


def internal_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges both of whose ends are members (id, component) of the same community."""
    a = members.select(F.col("id").alias("src_id"), "component")
    b = members.select(F.col("id").alias("dst_id"), "component")
    return edges.join(a, "src_id").join(b, ["dst_id", "component"])


def communities_of(members: DataFrame, entities: DataFrame) -> DataFrame:
    """The communities of entities (id), over all levels that members lists."""
    return members.join(entities.select("id"), "id", "left_semi").distinct()


def incident(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Out-edges and in-edges of each node (a self-loop appears twice)."""
    out = edges.join(nodes.select(F.col("id").alias("src_id")), "src_id").withColumn("node", F.col("src_id"))
    into = edges.join(nodes.select(F.col("id").alias("dst_id")), "dst_id").withColumn("node", F.col("dst_id"))
    return out.unionByName(into)


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, node, distance) within `depth` undirected steps, without the seed itself."""
    both = edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).unionByName(edges.select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"))).distinct()
    seen = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("distance"))
    frontier = seen
    for d in range(1, depth + 1):
        frontier = frontier.join(both, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("distance", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("id").alias("src_id")), "src_id", "left_semi").join(nodes.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")


def stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: entities, edges, average degree."""
    return entities.agg(F.count(F.lit(1)).alias("entities")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"))).withColumn("avg_degree", F.try_divide(2 * F.col("edges"), F.col("entities")))


def type_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def search(entities: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """Name hits count 2, description hits 1."""
    t = term.lower()
    score = 2 * F.lower("name").contains(t).cast("int") + F.coalesce(F.lower("description").contains(t).cast("int"), F.lit(0))
    return entities.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def components(edges: DataFrame, nodes: DataFrame, work: Workspace, least: int = 1) -> DataFrame:
    """(id, component): the least id reachable, of nodes in components of `least` nodes at least.

    Least labels and pointer jumping; every round is a written table.
    """
    both = edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).unionByName(edges.select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"))).where("a <> b").distinct()
    both = work.table("both", both)
    labels, i = work.table("labels0", nodes.select("id", F.col("id").alias("component"))), 0
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id", "left").select("id", "component", F.least("component", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("component").alias("far"))
        step = work.table(f"labels{i + 1}", step.join(jump, "new", "left").select("id", "component", F.least("new", "far").alias("new")))
        work.drop(f"labels{i}")
        i += 1
        labels = step.select("id", F.col("new").alias("component"))
        if step.where("new <> component").isEmpty():
            break
    if least > 1:
        big = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("component")
        labels = labels.join(big, "component", "left_semi").select("id", "component")
    return labels


def modularity_communities(edges: DataFrame, nodes: DataFrame, work: Workspace, rounds: int = 10) -> DataFrame:
    """(id, component) by weighted modularity moves: in turn halves of the nodes go to the neighbouring community with the
    greatest gain (ties: the least id). Every round is a written table; nothing is gathered."""
    both = edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), "weight").unionByName(edges.select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"), "weight")).where("a <> b").groupBy("a", "b").agg(F.sum("weight").alias("w"))
    both = work.table("weighted", both)
    degree = work.table("degree", both.groupBy("a").agg(F.sum("w").alias("k")))
    total = degree.agg(F.sum("k").alias("m2"))
    labels = work.table("m0", nodes.select("id", F.col("id").alias("component")))
    for i in range(rounds):
        mass = labels.join(degree, F.col("id") == F.col("a")).groupBy("component").agg(F.sum("k").alias("mass"))
        pull = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("to")), "b").groupBy("a", "to").agg(F.sum("w").alias("into"))
        own = labels.select(F.col("id").alias("a"), F.col("component").alias("own"))
        move = pull.join(own, "a").join(degree, "a").join(mass.withColumnRenamed("component", "to"), "to").crossJoin(F.broadcast(total))
        gain = F.col("into") - F.col("k") * (F.col("mass") - F.when(F.col("to") == F.col("own"), F.col("k")).otherwise(0)) / F.col("m2")
        best = move.withColumn("gain", F.round(gain, 9)).groupBy("a").agg(F.max_by("to", F.struct("gain", -F.col("to").cast("long"))).alias("to"), F.max("gain").alias("gain"))
        turn = F.pmod(F.xxhash64("id"), F.lit(2)) == i % 2
        step = labels.join(best.withColumnRenamed("a", "id"), "id", "left").select("id", F.when(turn & (F.col("gain") > 0), F.coalesce("to", "component")).otherwise(F.col("component")).alias("new"), "component")
        step = work.table(f"m{i + 1}", step)
        done = i and step.where("new <> component").isEmpty()
        labels = step.select("id", F.col("new").alias("component"))
        if done:
            break
    return labels


def hierarchy(communities: DataFrame, levels: int = 3) -> DataFrame:
    """(level, community, parent): consecutive communities (column idx from 0) are paired level by level, up to `levels`."""
    rows = communities.select(F.lit(0).alias("level"), F.col("idx").alias("community"), F.floor(F.col("idx") / 2).alias("parent"))
    out, level = rows, rows
    for i in range(1, levels):
        level = level.select("parent").distinct().select(F.lit(i).alias("level"), F.col("parent").alias("community"), F.floor(F.col("parent") / 2).alias("parent"))
        out = out.unionByName(level)
    return out


def titles(members: DataFrame) -> DataFrame:
    """(component, title): its three first members by type priority, then longest description, then name."""
    order = F.lit(5)
    for t, p in TYPE_PRIORITY.items():
        order = F.when(F.col("type") == t, p).otherwise(order)
    w = Window.partitionBy("component").orderBy(order, F.length("description").desc(), "name")
    best = members.withColumn("__r", F.row_number().over(w)).where("__r <= 3")
    return best.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "name"))), lambda x: x["name"]), ", ").alias("title"))


def local_search(entities: DataFrame, edges: DataFrame, members: DataFrame, term: str) -> DataFrame:
    """Seeds (5 at most), their neighbours (10 at most each), the distinct edges among them and the communities (5) they touch:
    rows (kind, key, detail)."""
    seeds = search(entities, term, 5)
    near = neighbours(edges, seeds, 1).withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("node"))).where("n <= 10")
    ids = seeds.select("id").unionByName(near.select(F.col("node").alias("id"))).distinct()
    rel = induced(edges, ids).select("src_id", "dst_id", "type").distinct()
    comms = members.join(ids, "id").select("component").distinct().orderBy("component").limit(5)
    text = lambda c: F.col(c).cast("string")
    return (
        seeds.select(F.lit("seed").alias("kind"), text("id").alias("key"), F.col("name").alias("detail"))
        .unionByName(near.select(F.lit("neighbour").alias("kind"), text("node").alias("key"), text("seed").alias("detail")))
        .unionByName(rel.select(F.lit("relation").alias("kind"), F.concat_ws("->", text("src_id"), text("dst_id")).alias("key"), F.col("type").alias("detail")))
        .unionByName(comms.select(F.lit("community").alias("kind"), text("component").alias("key"), F.lit(None).cast("string").alias("detail")))
    )


def global_context(communities: DataFrame, level: int = 0) -> DataFrame:
    """One text of all summaries at a level (columns level, community, summary); level 0 if that level has none."""
    at = communities.where(F.col("level") == level)
    rows = at if level == 0 or not at.isEmpty() else communities.where("level = 0")
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("community", "summary"))), lambda x: x["summary"]), "\n\n").alias("context"))
