"""The engine's operators on small frames whose results are worked out by hand, and queries against SQL."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.catalogue import all_queries, graphs
from lodestone.config import EngineConfig
from lodestone.functions import parse, rules
from lodestone.functions import text as tx
from lodestone.functions import vector as vec
from lodestone.operators import caching, chunking, cluster, evaluate, graph, metrics, rerank, retrieval
from lodestone.plans import agents, providers
from lodestone.plans.pipeline import PipelineBuilder
from lodestone.session import Workspace
from lodestone.sources import files
from lodestone.sources.vector_table import VectorTable
from lodestone.streaming import streams

from .conftest import DATA


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_sentences_and_tokens(spark):
    t = F.lit("One. Two!  Élan vital?\nfour_4 x")
    r = one(spark, tx.sentences(t), tx.tokens(t), tx.estimate_tokens(t), tx.long_sentences(t, 5))
    assert r.c0 == ["One.", "Two!", "Élan vital?", "four_4 x"] and r.c1 == ["one", "two", "élan", "vital", "four_4", "x"] and r.c2 == 7 and r.c3 == ["Élan vital?", "four_4 x"]


def test_vectors(spark):
    z, a, b = (F.array(*map(F.lit, v)) for v in ([0.0, 0.0], [3.0, 4.0], [4.0, -3.0]))
    r = one(spark, vec.cosine(z, a), vec.cosine(a, a), vec.cosine(a, b), vec.norm(a), vec.cosine(z, a, "none"), vec.euclidean(a, b), vec.max_sim(F.array(a, b), F.array(a, z)), vec.normalize(z), vec.pool(F.array(a, b), "max"), vec.pool(F.array(a, b)))
    assert r.c0 == 0 and abs(r.c1 - 1) < 1e-12 and r.c2 == 0 and r.c3 == 5 and r.c4 is None and abs(r.c5 - 50**0.5) < 1e-12
    assert r.c6 == 25 and r.c7 == [0, 0] and r.c8 == [4, 4] and r.c9 == [3.5, 0.5]


@pytest.mark.parametrize(("text", "verdict", "score"), [("VERDICT: fully supported", "fully", 0.9), ("VERDICT: not supported\nSCORE: 0.4", "not", 0.4), ("VERDICT: unsupported", "not", 0.1), ("nothing", "partially", 0.5), ("SCORE: 7", "partially", 1.0), ("SCORE: x", "partially", 0.5)])
def test_verdicts(spark, text, verdict, score):
    r = one(spark, parse.verdict(F.lit(text)), parse.verdict_score(F.lit(text)))
    assert (r.c0, r.c1) == (verdict, score)


def test_other_parsers(spark):
    r = one(
        spark,
        parse.citations(F.lit("see [1][3] and [9], [1]"), F.lit(3)),
        parse.support(F.lit("Unsupported")),
        parse.support(F.lit(" Supported: yes")),
        parse.json_object(F.lit('Sure: {"a": 1, "b": [2]} ok'), "a int, b array<int>"),
        parse.json_object(F.lit("{broken"), "a int"),
        parse.claims(F.lit("1. The first claim here\n- short\n2) Another claim is here")),
        parse.variations(F.lit("What is it?"), F.lit("1. \"Tell me of it\"\nHere are rewrites\n- what is it?\nabc"), 4),
        parse.score_list(F.lit("7, 12 and 3"), 4),
        parse.follow_ups(F.lit("x\nFollow-up: why?\n")),
        parse.reasoning_and_answer(F.lit("since a. Therefore b")),
    )
    assert r.c0 == [0, 2] and r.c1 == "neutral" and r.c2 == "supported" and r.c3.a == 1 and r.c3.b == [2] and (r.c4 is None or r.c4.a is None)
    assert r.c5 == ["The first claim here", "Another claim is here"] and r.c6 == ["What is it?", "Tell me of it", "What is it?", "Define it?"][:1] + ["Tell me of it", "Define it?", "Explain it?"] and r.c7 == [7, 10, 3, 5]
    assert r.c8 == ["why?"] and r.c9.answer == "Therefore b"


def test_rules(spark):
    q = F.lit
    r = one(spark, rules.route(q("Hi there")), rules.route(q("difference of a and b")), rules.use_hypothetical(q("why does it rain so")), rules.use_hypothetical(q("what is the capital of it all")), rules.crag_level(q(0.8)), rules.retrieval_quality(q(0.7), q(0.2)), rules.feature_similarity(rules.query_features(q("a b")), rules.query_features(q("what b"))))
    assert r.c0.type == "conversational" and r.c1.strategy == "multi_query" and r.c2 and not r.c3 and r.c4 == "correct" and r.c5 == "good" and r.c6 == 0.75


EDGES = [(1, None), (2, ""), (3, "  "), (4, "No boundary " * 60), (5, "A. B. C."), (6, "Same one. " * 80), (7, "x\n\ny" * 200), (8, "Élan. Über uns. Ça va? " * 30)]


def test_chunkers_cover_texts(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string")
    for f in (chunking.fixed_chunks, chunking.soft_chunks, chunking.recursive_chunks, chunking.token_chunks, chunking.fallback_chunks):
        rows = f(docs).collect()
        assert all(len(r.content) <= 1500 for r in rows) and {r.doc_id for r in rows} >= {4, 6, 7, 8}, f
        assert len({r.chunk_id for r in rows}) == len(rows)
    parts = chunking.split_recursively("aa bb. cc dd\n\nee " * 50, 40, 0)
    assert "".join(parts).replace(" ", "").replace("\n", "") == ("aa bb. cc dd\n\nee " * 50).replace(" ", "").replace("\n", "") and max(map(len, parts)) <= 40


def plain_packs(sentences, size=512, overlap=1, least=100):
    out, cur, n = [], [], 0
    for s in sentences:
        if n + len(s) > size and cur:
            out.append(" ".join(cur))
            cur = [*(cur[-overlap:] if overlap else []), s]
            n = sum(map(len, cur))
        else:
            cur.append(s)
            n += len(s)
    return out + ([" ".join(cur)] if len(" ".join(cur)) >= least else [])


@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_sentence_packs(spark, overlap):
    docs = spark.createDataFrame([r for r in EDGES if r[1]], "doc_id long, text string")
    rows = docs.select("doc_id", tx.sentences(F.col("text")).alias("s"), chunking.sentence_packs(tx.sentences(F.col("text")), 120, overlap, 20).alias("p")).collect()
    assert all(r.p == plain_packs(r.s, 120, overlap, 20) for r in rows)


def test_markdown_and_hierarchy(spark):
    md = "# A\nfirst text that is long enough\n## B\nsecond text that is long enough\n# C\n## D\n### E\nthird text that is long enough\n# F\nno"
    rows = chunking.markdown_chunks(spark.createDataFrame([(1, md)], "doc_id long, text string"), least=10).orderBy("position").collect()
    assert [r.header_path for r in rows] == ["A", "A > B", "C > D > E"]
    tree = chunking.hierarchical_chunks(spark.createDataFrame(EDGES[4:], "doc_id long, text string"), sizes=(300, 100)).collect()
    ids = {r.chunk_id for r in tree}
    assert all(r.parent_id in ids for r in tree if r.level == 1) and all(r.parent_id is None for r in tree if r.level == 0)


def test_breakpoints_restart(spark):
    sims, lens = F.array(*map(F.lit, [0.1, 0.9, 0.1, 0.9])), F.array(*map(F.lit, [60, 60, 60, 60, 60]))
    assert one(spark, chunking.breakpoints(sims, lens, F.lit(0.5), 1000, 100)).c0 == [0, 3]
    assert one(spark, chunking.smooth(F.array(*map(F.lit, [1.0, 2.0, 3.0, 6.0])))).c0 == pytest.approx([1.5, 2, 11 / 3, 4.5])


LISTS = [("q", "a", 1, 3.0, 1), ("q", "a", 2, 1.0, 2), ("q", "b", 2, 5.0, 1), ("q", "b", 3, 5.0, 2)]


def test_fusion(spark):
    lists = spark.createDataFrame(LISTS, "query_id string, list string, chunk_id long, score double, rank long")
    rrf = {r.chunk_id: r.score for r in retrieval.rrf(lists).collect()}
    assert rrf[2] == pytest.approx(1 / 62 + 1 / 61)
    lin = {r.chunk_id: r.score for r in retrieval.linear(lists).collect()}
    assert lin == {1: 0.5, 2: 0.0, 3: 0.0}
    assert {r.norm for r in retrieval.normalize(lists.where("list = 'b'")).collect()} == {1.0}
    weights = spark.createDataFrame([("a", 1.0)], "list string, weight double")
    with pytest.raises(Exception, match="no weight"):
        retrieval.rrf(lists, weights=weights).collect()


def test_reorderings(spark):
    hits = spark.createDataFrame([("q", i, i, "s" + "aabbc"[i - 1]) for i in range(1, 6)], "query_id string, chunk_id long, rank long, source string")
    assert [r.chunk_id for r in rerank.lost_in_middle(hits).orderBy("position").collect()] == [1, 3, 5, 4, 2]
    assert [r.chunk_id for r in rerank.interleave(hits).orderBy("position").collect()] == [1, 3, 5, 2, 4]


def test_greedy_budget(spark):
    items = F.array(*(F.struct(F.lit(n).alias("tokens"), F.lit(k).alias("k")) for k, n in enumerate([5, 9, 3, 2])))
    assert [x.k for x in one(spark, rerank.greedy_budget(items, 10)).c0] == [0, 2, 3]
    assert [x.k for x in one(spark, rerank.greedy_budget(items, 1, 2)).c0] == [0, 1]


def test_graph(spark):
    ent = spark.createDataFrame([(i, f"N{i}", "T", None) for i in range(1, 7)], "id long, name string, type string, description string")
    edges = spark.createDataFrame([(1, 2, "x", 1.0), (2, 1, "x", 1.0), (2, 3, "y", 1.0), (3, 3, "z", 1.0), (4, 5, "x", 1.0)], "src_id long, dst_id long, type string, weight double")
    comp = {r.id: r.component for r in graph.components(edges, ent, Workspace(spark, "t")).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    near = {(r.seed, r.node): r.distance for r in graph.neighbours(edges, ent.where("id = 1"), 2).collect()}
    assert near == {(1, 2): 1, (1, 3): 2}
    assert graph.incident(edges, ent.where("id = 3")).count() == 3
    names = spark.createDataFrame([("Acme", "org", "a", [1], 1), ("ACME", "Org", "longer", [2, 1], 2), ("acme", "x", None, [3], 3)], "name string, type string, description string, chunks array<int>, ord int")
    merged = {r.type_key: r for r in graph.merge_entities(names).collect()}
    assert merged["org"].name == "Acme" and merged["org"].description == "longer" and merged["org"].chunks == [1, 2] and len(merged) == 2
    labels = graph.modularity_communities(edges, ent, Workspace(spark, "m"), 3).collect()
    assert len(labels) == 6


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id long, doc_id long, rank int")
    truth = spark.createDataFrame([(1, 11), (2, 99), (1, 55)], "query_id long, doc_id long")
    r = evaluate.rank_metrics(hits, truth).first()
    assert (r.hit_rate, r.mrr, r.recall) == (0.5, 0.25, 0.25)
    ev = spark.createDataFrame([(i, 1, f"2024-01-01 00:00:0{i}") for i in range(5)], "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [x.allowed for x in metrics.sliding_limit(ev, "user_id", "ts", 3, 2).orderBy("event_id").collect()] == [True, True, False, False, False]
    assert metrics.token_bucket(ev, "user_id", "ts", 0.5, 1.0).first().accepted == 3
    assert one(spark, evaluate.token_f1(F.lit("a b"), F.lit("b c d"))).c0 == 0.4


def test_cache(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "entry_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, [-1.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r.query_id, r.entry_id) for r in caching.probe(c, q).collect()] == [(7, 1)]


def test_vector_table(spark, tmp_path):
    v = VectorTable(spark, str(tmp_path / "c"))
    row = lambda *r: spark.createDataFrame(list(r), "chunk_id long, embedding array<double>, lang string")
    assert not v.exists()
    v.create(row((1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b")))
    v.upsert(row((2, [1.0, 1.0], "c"), (3, [0.5, 0.5], "a")))
    assert v.count() == 3 and v.info()["dimension"] == 2 and v.lookup("lang", "c").first().chunk_id == 2
    with pytest.raises(ValueError, match="without embedding"):
        v.upsert(row((4, None, "a")))
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [r.chunk_id for r in v.search(q, 5, filters={"lang": ["a"]}).collect()] == [1, 3]
    v.delete(row((1, [0.0], "")))
    assert [r.chunk_id for r in v.get(row((1, [0.0], ""), (3, [0.0], ""))).collect()] == [3]
    from lodestone.sources.vector_table import collections

    assert collections(spark, str(tmp_path)) == ["c"] and len(v.versions()) == 3
    assert v.copy_to(str(tmp_path / "d")).count() == 2
    v.drop()
    assert not v.exists()


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("plain é")
    (tmp_path / "in" / "b.html").write_text("<title>T</title><script>x</script><p>one</p><p>two  three</p>")
    (tmp_path / "in" / "c.docx").write_bytes(b"no zip")
    (tmp_path / "in" / "d.bin").write_bytes(b"x")
    (tmp_path / "in" / "e.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "in" / "f.html").write_bytes(b"<p>\xff</p>")
    rows = {r.filename: r for r in files.load(spark, str(tmp_path / "in")).collect()}
    assert set(rows) == {"a.txt", "b.html", "c.docx", "e.txt", "f.html"} and all(rows[k].text is None and rows[k].error for k in ("c.docx", "e.txt", "f.html")) and rows["a.txt"].error is None and rows["a.txt"].text == "plain é" and rows["b.html"].text == "T\none\ntwo\nthree" and rows["c.docx"].error


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 00:05:00", 1, "a", 1.0), (1, "2024-01-01 00:05:00", 1, "a", 1.0), (2, "2024-01-01 00:50:00", 1, "a", 2.0), (3, "2024-01-01 09:00:00", 2, "b", 1.0)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "e"))
    stream = streams.event_stream(spark, str(tmp_path / "e"), e.schema)
    assert streams.drain(streams.distinct_events(stream), "d1").count() == 3
    got = streams.drain(streams.tumbling(stream), "d2", "complete").collect()
    want = streams.tumbling(e).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    docs = spark.createDataFrame([(1, "One sentence that is here. " * 40)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    table = VectorTable(spark, str(tmp_path / "out"))
    for text in ("One sentence that is here. " * 40, "A shorter text that comes later, long enough to be a chunk of its own, as it should be here. " * 2):
        new = spark.createDataFrame([(1, text)], "doc_id long, text string")
        new.write.mode("append").parquet(str(tmp_path / "docs2"))
        q = streams.ingest(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs2")), table, str(tmp_path / "cp"), cluster.hash_embed).trigger(availableNow=True).start()
        q.awaitTermination()
        want = {r.content for r in chunking.sentence_chunks(new).collect()}
        assert {r.content for r in table.scan().collect()} == want  # a document that comes again replaces its chunks


def test_stateful_streams(spark, tmp_path):
    t = spark.createDataFrame([(1, k, "user", f"m{k}") for k in range(14)], "conv_id long, turn long, role string, text string")
    t.write.parquet(str(tmp_path / "t"))
    got = streams.drain(streams.chat_history(spark.readStream.schema(t.schema).parquet(str(tmp_path / "t")), idle_ms=None), "d3", "append").collect()
    assert got[-1].history == [f"user: m{k}" for k in range(4, 14)]
    e = spark.createDataFrame([(i, 1 + i % 2, f"2024-01-01 00:00:0{i}") for i in range(8)], "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "e"))
    got = streams.drain(streams.limited(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), 0.25, 1.0, None), "d4", "append").collect()
    assert sorted((r.user_id, r.accepted, r.refused) for r in got) == sorted((r.user_id, r.accepted, r.refused) for r in metrics.token_bucket(e, "user_id", "ts", 0.25, 1.0).collect())


def test_pipeline(spark):
    docs = spark.createDataFrame([(k, f"Topic{k} is about thing{k}. " * 12) for k in range(12)], "doc_id long, text string")
    p = PipelineBuilder().with_config(top_k=3).with_options(compress=True).build()
    chunks = p.ingest(docs).cache()
    asked = spark.createDataFrame([(1, "what is topic5 about thing5"), (2, "topic7 thing7 please")], "query_id long, query string")
    got = {r.query_id: r for r in p.query(chunks, asked).collect()}
    assert "Topic5" in got[1].response and "Topic7" in got[2].response and got[1].citations
    assert p.corrective(chunks, asked).count() == 2
    recorded = PipelineBuilder().with_generator(providers.RecordedGenerator(spark.createDataFrame([(1, "said [1]")], "query_id long, response string"))).build()
    assert [r.citations for r in recorded.query(chunks, asked).collect()] == [[0]]
    with pytest.raises(ValueError, match="unknown"):
        PipelineBuilder().with_options(nonsense=1)
    with pytest.raises(ValueError):
        EngineConfig(top_k=0)


def test_agents():
    plan = agents.Plan([agents.Step("c", lambda r: r["a"] + r["b"], ("a", "b")), agents.Step("a", lambda r: 1), agents.Step("b", lambda r: 1 / 0), agents.Step("d", lambda r: r["a"] * 5, ("a",))])
    out = plan.execute()
    assert out["d"] == 5 and isinstance(out["b"], ZeroDivisionError) and isinstance(out["c"], RuntimeError)
    with pytest.raises(ValueError, match="unmet"):
        agents.Plan([agents.Step("x", lambda r: 0, ("y",))]).order()
    assert agents.reflect("a", {"len": lambda s: min(len(s) / 4, 1)}, lambda s, _: s + "a", 0.9) == ("aaaa", {"len": 1.0}, 3)
    asked = []
    out = agents.orchestrate("q", lambda q: "hybrid", lambda q, s: asked.append(q) or [q], lambda q, h: "refine_query" if q == "q" else "proceed", lambda q: q + "!", lambda q, h: "ans", lambda q, a: 0.9)
    assert asked == ["q", "q!"] and out["rounds"] == 2 and out["score"] == 0.9
    assert providers.create("embedder", "hash", 8).dims == 8


def test_clusters(spark):
    rows = spark.createDataFrame([("d", k, [float(k % 2) * 10 + k * 0.01, 0.0]) for k in range(12)], "doc string, id long, embedding array<double>")
    label = {r.id: r.cluster for r in cluster.kmeans_groups(rows, "doc").collect()}
    assert len({label[k] for k in range(0, 12, 2)}) == 1 and label[0] != label[1]
    assert cluster.mixture_groups(rows, "doc").count() == 12


def test_communities_and_local_search_take_the_whole_graph(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    o = spark.read.parquet(f"{DATA}/orders.parquet")
    li = spark.read.parquet(f"{DATA}/lineitem.parquet").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    want = {r[0] for r in li.select("o_custkey").distinct().collect()} | {r[0] + 10_000_000 for r in li.select("l_partkey").distinct().collect()}
    assert {r["id"] for r in all_queries.QUERIES["a13_modularity"](spark, DATA).collect()} == want
    n = {x: spark.read.parquet(f"{DATA}/{x}.parquet").count() for x in ("region", "nation", "customer", "supplier")}
    ent, edges = graphs._graph(spark, DATA)
    assert ent.count() == sum(n.values()) and edges.count() == sum(n.values()) - n["region"]


def test_trees_and_mixtures_take_whole_documents_and_vectors(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    want = {r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").where("trim(BOTH ' \\t\\n\\r' FROM text) <> ''").select("doc_id").collect()}
    got = {r["doc_id"] for r in all_queries.QUERIES["q10_summary_tree"](spark, DATA).select("doc_id").distinct().collect()}
    assert got == want
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").select("label", F.col("vec_id").alias("id"), "embedding")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(all_queries.QUERIES["a17_mixture"](spark, DATA)) == rows(cluster.mixture_groups(e, "label"))


def test_ingester(spark, tmp_path):
    from lodestone.plans.ingest import BatchIngester

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("A text that is long enough to be a chunk. " * 5)
    (tmp_path / "in" / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "in" / "c.md").write_text("  ")
    ingester = BatchIngester(VectorTable(spark, str(tmp_path / "t")))
    status = lambda: {r.source.split("/")[-1]: (r.status, r.chunks) for r in ingester.ingest_folder(spark, str(tmp_path / "in")).collect()}
    assert status() == {"a.txt": ("ingested", 1), "b.txt": ("failed", 0), "c.md": ("failed", 0)}
    assert status()["a.txt"] == ("known", 0)
    (tmp_path / "in" / "a.txt").write_text("Another text that is long enough to be a chunk. " * 5)
    rows = ingester.ingest_folder(spark, str(tmp_path / "in"))
    assert ingester.summary(rows).first()[:4] == (3, 1, 0, 2) and ingester.table.count() == 1


def test_index_is_rebuilt_when_files_change(spark, tmp_path):
    from lodestone.operators.lexical_index import for_table

    path = str(tmp_path / "docs.parquet")
    ask = spark.createDataFrame([(1, "red apple")], "query_id long, query string")
    write = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(path)
    write("a red apple", "a green pear", "red red wine")
    found = lambda: [(r.doc_id, round(r.score, 9)) for r in for_table(spark, path).search(ask).orderBy("rank").collect()]
    plain = lambda: [(r.doc_id, round(r.score, 9)) for r in retrieval.bm25(spark.read.parquet(path), ask).orderBy("rank").collect()]
    assert found() == plain() and found()[0][0] == 0
    index = for_table(spark, path)
    assert index is for_table(spark, path)
    write("nothing here", "an apple", "red apple, red apple", "")
    assert found() == plain() and found()[0][0] == 2
    docs = spark.read.parquet(path)
    held = spark.createDataFrame([(1, "apple, red"), (2, "an"), (3, "missing words here"), (4, "red apple, red apple")], "query_id long, query string")
    assert sorted(map(tuple, for_table(spark, path).containing(docs, held).collect())) == [(1, 2), (2, 1), (4, 2)]


def test_eviction_is_exact(spark):
    c = spark.createDataFrame([(i, (i * 7) % 10) for i in range(100)], "entry_id long, created_at long")
    want = sorted(((i * 7) % 10, i) for i in range(100))[23:]
    assert sorted((r.created_at, r.entry_id) for r in caching.evict_oldest(c, 0.23).collect()) == want


def test_tracing_events_and_retries(spark, tmp_path):
    from lodestone.plans.answers import MicroBatcher, answer_events, as_sse
    from lodestone.plans.retry import gathered, retried
    from lodestone.plans.tracing import EventBus, Tracer

    tracer, bus, seen = Tracer(), EventBus(), []
    with pytest.raises(ZeroDivisionError), tracer.span("outer", k=1), tracer.span("inner"):
        1 / 0
    assert tracer.flush(spark, str(tmp_path / "spans")) == 2
    spans = {r.name: r for r in spark.read.parquet(str(tmp_path / "spans")).collect()}
    assert spans["inner"].parent_id == spans["outer"].span_id and "ZeroDivision" in spans["outer"].error
    stop = bus.subscribe("a", lambda k, p: seen.append((k, p)))
    bus.subscribe("*", lambda k, p: 1 / 0)
    bus.emit("a", x=1)
    stop()
    bus.emit("a", x=2)
    assert seen == [("a", {"x": 1})] and len(bus.errors) == 2 and bus.table(spark).count() == 2
    waits, calls = [], []

    def shaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("no")
        return x + 1

    assert retried(shaky, 3, 1.0, 60.0, 7, waits.append)(1) == 2 and 0.5 <= waits[0] <= 1.5 and 1 <= waits[1] <= 3
    assert [type(x) for x in gathered(lambda x: 1 / x, [1, 0])] == [float, ZeroDivisionError]
    events = list(answer_events("q", [("retrieve", list)], lambda: [1], lambda: "one two three four"))
    assert [e["type"] for e in events] == ["query", "step", "sources", "chunk", "chunk", "done"] and "".join(e["content"] for e in events if e["type"] == "chunk") == "one two three four"
    assert list(answer_events("q", [], lambda: 1 / 0, str))[-1]["type"] == "error" and next(as_sse(events)).startswith("event: query\n")
    clock = iter([0.0, 0.0, 0.0, 5.0, 9.0]).__next__
    m = MicroBatcher(lambda b: [sum(b)], 2, 1.0, clock)
    assert m.add(1) == [] and m.add(2) == [3] and m.flush() == []


def test_critics_and_react():
    v = agents.criticise("abc", {"long": lambda a: len(a) / 10, "bad": lambda a: 1 / 0, "high": lambda a: 7}, {"long": "Say more."})
    assert v.scores == {"long": 0.3, "bad": 0.5, "high": 1.0} and v.feedback == ["Say more."] and not v.passed
    out = agents.react("q", lambda q, t: {"answer": t[-1]["observation"]} if len(t) == 3 else [{"action": "none"}, {"action": "boom"}, {"action": "add", "input": {"a": 2, "b": 3}}][len(t)], {"add": lambda a, b: a + b, "boom": lambda: 1 / 0})
    assert out["answer"] == 5 and "no tool" in out["trace"][0]["observation"] and "ZeroDivision" in out["trace"][1]["observation"]
    assert agents.react("q", lambda q, t: {"action": "x"}, {}, 2)["answer"] is None


def test_calls_that_fail_give_no_answer(spark):
    prompts = spark.createDataFrame([(1, "good", "c"), (2, "bad", "c")], "query_id long, query string, context string")

    def client():
        def call(p):
            if "bad" in p:
                raise OSError("down")
            return p.upper()

        return call

    got = {r.query_id: r for r in providers.CallGenerator(client, 2, 0.0).generate(prompts).collect()}
    assert "GOOD" in got[1].response and got[2].response is None and "down" in got[2].error


def test_graph_building(spark):
    docs = spark.createDataFrame([(1, "The Acme Corp of Torvik. ACME corp!"), (2, "torvik torvik"), (3, None)], "doc_id long, text string")
    names = spark.createDataFrame([("acme corp", "Organization"), ("torvik", "Location"), ("absent one", "Other")], "name string, type string")
    found = graph.dictionary_entities(docs, names)
    assert sorted(map(tuple, found.collect())) == [(1, "acme corp", "Organization", 2), (1, "torvik", "Location", 1), (2, "torvik", "Location", 2)]
    answer = 'ok {"entities": [{"name": " A ", "type": "Person"}, {"name": "B", "type": "Thing"}, {"name": " "}], "relationships": [{"source": "A", "target": "B"}, {"source": "A"}]}'
    rows = spark.createDataFrame([(1, answer), (2, "none")], "chunk_id long, response string")
    assert [(r.name, r.type) for r in graph.parsed_entities(rows, "chunk_id").orderBy("name").collect()] == [("A", "Person"), ("B", "Other")]
    assert [(r.src, r.dst, r.type) for r in graph.parsed_relationships(rows, "chunk_id").collect()] == [("A", "B", "RELATED_TO")]


def test_registries(spark):
    docs = spark.createDataFrame([(1, "red apple. " * 30), (2, "green pear. " * 30)], "doc_id long, text string")
    ask = spark.createDataFrame([(7, "red apple")], "query_id long, query string")
    for name in ("fixed", "sentence", "soft", "recursive"):
        assert providers.create("chunker", name, size=100)(docs).count() > 2
    hits = providers.create("retriever", "bm25", docs)(ask, 5).join(docs.select("doc_id", F.col("text").alias("content")), "doc_id").withColumnRenamed("doc_id", "chunk_id")
    assert [r.chunk_id for r in providers.create("reranker", "overlap")(hits, ask).collect()] == [1]
    assert providers.create("reranker", "middle_last", providers.by_overlap)(hits, ask).first().position == 0
    with pytest.raises(ValueError, match="no chunker named"):
        providers.create("chunker", "none")


def test_summary_tree(spark):
    rows = [(d, k, f"First of {d}{k % 2}. Second {'ab'[k % 2] * 5} {k}.") for d in (1, 2) for k in range(9)] + [(3, 0, "Alone. Here.")]
    tree = cluster.build_tree(spark.createDataFrame(rows, "doc_id long, position int, content string"), 2).collect()
    nodes = {r.node_id: r for r in tree}
    children: dict = {}
    for r in tree:
        if r.parent_id:
            children.setdefault(r.parent_id, []).append(r)
    assert len(nodes) == len(tree) and sum(r.level == 0 for r in tree) == len(rows)
    for parent, own in children.items():
        up = nodes[parent]
        assert len(own) >= 2 and up.is_summary and {r.level for r in own} == {up.level - 1} and {r.doc_id for r in own} == {up.doc_id}
        assert up.content == " ".join(r.content.split(". ")[0] + "." if ". " in r.content else r.content for r in sorted(own, key=lambda r: r.node_id)[:3])
    assert nodes["0:3:0"].parent_id is None


def test_json_documents_and_header_cache(spark, tmp_path):
    from lodestone.operators import contextual

    (tmp_path / "d.json").write_text('{"id": "a", "content": "x", "metadata": {"k": "v"}}\n{"content": "y"}\n')
    rows = {r.content: r for r in files.json_documents(spark, str(tmp_path / "d.json")).collect()}
    assert rows["x"].id == "a" and rows["x"].metadata == {"k": "v"} and rows["y"].id.startswith("doc_")
    chunks = spark.createDataFrame([(1, 0, "s", "one"), (1, 1, "s", "two"), (2, 0, "s", "one")], "doc_id long, position int, source string, content string")
    cache = spark.createDataFrame([], "key string, header string")
    made, fresh = contextual.cached_headers(chunks, cache, lambda m: m.select("doc_id", "position", F.concat(F.lit("h "), "content").alias("header")))
    assert made.count() == 3 and fresh.count() == 2
    again, none = contextual.cached_headers(chunks, fresh, lambda m: m.select("doc_id", "position", F.lit("new").alias("header")))
    assert {r.header for r in again.collect()} == {"h one", "h two"} and none.count() == 0


def test_modularity_finds_two_cliques(spark):
    pairs = [(a, b) for c in (0, 10) for a in range(c, c + 5) for b in range(a + 1, c + 5)] + [(4, 10)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src_id long, dst_id long, weight double")
    nodes = spark.createDataFrame([(i,) for i in [*range(5), *range(10, 15)]], "id long")
    label = {r.id: r.component for r in graph.modularity_communities(edges, nodes, Workspace(spark, "cliques"), 10).collect()}
    assert len({label[i] for i in range(5)}) == 1 and len({label[i] for i in range(10, 15)}) == 1 and label[0] != label[10]


QUICK = ["f1_tokens", "a2_document_frequency", "s_bm25_topk", "j1_dense_cosine", "a5_rrf", "f6_sentence_chunks", "f13_markdown_chunks", "a9_merge_entities", "j10_neighbours", "f32_verdicts", "t10_sessions", "rel_windows", "q4_multi_query", "q8_adaptive", "f9_semantic_chunks", "f11_hierarchical_chunks", "s11_upsert", "s15_batch_ingest", "q15_compress", "f33_nli_batch", "q14_graph_hybrid"]


@pytest.mark.parametrize("name", QUICK)
def test_queries_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = f"{DATA}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got, want = all_queries.QUERIES[name](spark, DATA).toPandas(), con.sql(all_queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(got) == rows(want)
