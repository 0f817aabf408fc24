"""Hand-worked cases of retrieval, evaluation, chunking, lifecycle and files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.functions import text as X
from rankspark.functions.stem import stem, taken_apart, word_overlap
from rankspark.operators import chunking, evaluation, ingest, querygen, retrieval
from rankspark.operators.engine import Engine, encode_with_retries, lookup_in_order
from rankspark.sources.files import Store, append_json_lines, file_hashes, read_csv, read_json_lines, subset
from rankspark.sources.ledger import RunLedger, provenance, query_set_hash, stale, write_report
from rankspark.streaming.incremental import follow


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<bigint>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()[0]


def test_fusion_order_and_equivalence(spark):
    a = spark.createDataFrame([(1, k, r) for r, k in enumerate([1, 2, 3], 1)], "query_id long, key long, rank int")
    b = spark.createDataFrame([(1, k, r) for r, k in enumerate([3, 4], 1)], "query_id long, key long, rank int")
    assert [r.key for r in retrieval.fused(a, b).orderBy("rank").collect()] == [3, 1, 2, 4]
    x = {(r.key, r.score) for r in retrieval.rrf([a, b]).collect()}
    assert x == {(r.key, r.score) for r in retrieval.rrf_joined(a, b).collect()}


def test_rerank_keeps_prior_order_on_ties(spark):
    rows = spark.createDataFrame([(1, 9, 1, "a b", "a"), (1, 5, 2, "a b", "b a"), (1, 7, 3, "a b", "b"), (1, 8, 4, None, None)], "query_id long, key long, rank int, query_text string, content string")
    assert [r.key for r in retrieval.rerank(rows).orderBy("rank").collect()] == [5, 9, 7, 8]


def test_dense_matches_numpy_and_ivf_recall(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 8)).round(3)
    rows = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(600)] + [(999, None)], "id long, v array<double>")
    queries = rows.filter("id % 20 = 0")
    exact = {(r.query_id, r["rank"]): r.key for r in retrieval.dense(rows, queries, "id", "v", 5).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 600, 20):
        s = np.round(u @ u[q], 6)
        assert [exact[q, r] for r in range(1, 6)] == sorted(range(600), key=lambda i: (-s[i], i))[:5]
    indexed, centroids = retrieval.ivf_index(rows, "id", "v", 8)
    found = {(r.query_id, r.key) for r in retrieval.ivf_search(indexed, centroids, queries, "id", "v", 5, 0.5).collect()}
    assert len(found & {(q, k) for (q, _), k in exact.items()}) / len(exact) >= 0.9
    whole = {(r.query_id, r["rank"]): r.key for r in retrieval.ivf_search(indexed, centroids, queries, "id", "v", 5, 1.0).collect()}
    assert whole == exact


def test_ivf_recall_on_the_test_vectors(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    queries = rows.filter("vec_id % 20 = 0")
    indexed, centroids = retrieval.ivf_index(rows, "vec_id", "embedding")
    near = lambda df: {(r.query_id, r.key) for r in df.collect()}
    exact = near(retrieval.dense(rows, queries, "vec_id", "embedding"))
    assert len(exact & near(retrieval.ivf_search(indexed, centroids, queries, "vec_id", "embedding"))) / len(exact) >= 0.9


def test_bm25_filter_keeps_statistics_and_blank_queries(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a a c", "y"), (3, None, "x"), (4, "", "x")], "id long, t string, lang string")
    queries = spark.createDataFrame([(1, "a z"), (2, "  "), (3, None)], "q long, t string")
    every = {r.key: r.score for r in retrieval.sparse(docs, queries, "id", "t", "q", "t").collect()}
    only = {r.key: r.score for r in retrieval.sparse(docs, queries, "id", "t", "q", "t", keep=retrieval.where(["x"])).collect()}
    assert set(every) == {1, 2} and only == {1: every[1]}
    filled = retrieval.with_zero(retrieval.sparse(docs, queries, "id", "t", "q", "t", k=3), docs, queries, "id", "q", 3)
    assert [r.key for r in filled.filter("query_id = 1").orderBy("rank").collect()] == [2, 1, 3] and filled.filter("query_id = 2").count() == 3
    with pytest.raises(ValueError):
        retrieval.check_request("x", 51, {}, set())


def test_metrics(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, evaluation.recall_at(a, b, 2), a=[1, 2, 3], b=[2, 9]) == 0.5 and one(spark, evaluation.reciprocal_rank(a, b), a=[1, 2], b=[2]) == 0.5
    assert one(spark, evaluation.recall_at(a, b, 2), a=[1], b=[]) == 0 and one(spark, evaluation.ndcg_at(a, b, 10), a=[5, 2], b=[5]) == 1.0
    run = spark.createDataFrame([("c", 1, r, o) for o, r in enumerate([7, 7, 8] + list(range(100, 125)))], "config string, query_id long, recipe_id long, o int")
    lists = evaluation.unique_depth(run, ["config", "query_id"], "recipe_id", "o")
    assert lists.count() == 20 and [r.recipe_id for r in lists.orderBy("rank").limit(2).collect()] == [7, 8]
    every = spark.createDataFrame([("c", 1), ("c", 2)], "config string, query_id long")
    firsts = evaluation.first_ranks(lists, spark.createDataFrame([(1, 8), (2, 8)], "query_id long, recipe_id long"), every)
    row = evaluation.metrics_table(firsts, ["config"]).first()
    assert (row.queries, row.recall_5, row.mrr) == (2, 0.5, 0.25)


def test_latency_statistics_and_failures(spark):
    rows = spark.createDataFrame([("a", float(n)) for n in range(1, 101)] + [("b", None)], "k string, ms double")
    got = {r.k: (r.p50, r.p95, r.p95_at) for r in evaluation.latency(rows, ["k"], "ms").collect()}
    assert got == {"a": (50.5, 95.05, 96.0), "b": (0, 0, 0)}
    tests = spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p double")
    assert [r.p_holm for r in evaluation.holm(tests).orderBy("p").collect()] == [0.03, 0.06, 0.06]
    ranks = spark.createDataFrame([(1, 10, 11), (2, None, 3), (3, 1, 1)], "query_id long, s int, d int")
    assert {(r.query_id, r.bucket) for r in evaluation.failure_buckets(ranks, "s", "d").collect()} == {(1, "s_win"), (2, "d_win")}
    assert evaluation.paired_bootstrap(np.ones(5), np.ones(5)) == (0, 0, 0, 1) and evaluation.paired_bootstrap(np.ones(30), np.zeros(30))[3] == 0.0
    assert evaluation.bootstrap_interval(np.array([])) == (0, 0, 0)
    a, b = spark.createDataFrame([(1, 2), (2, None)], "q long, r int"), spark.createDataFrame([(1, 3), (3, 1)], "q long, r int")
    assert {(r.q, r.kind) for r in evaluation.rank_mismatches(a, b, ["q"], "r").collect()} == {(1, "differs"), (2, "missing"), (3, "extra")}


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, X.minutes_of(t), t="1 hr 20 mins") == 80 and one(spark, X.minutes_of(t), t="soon") is None
    assert one(spark, X.plain_fractions(t), t="1½ cups, ¾ tsp") == "1 1/2 cups, 3/4 tsp"
    assert one(spark, X.sentences(t), t='One. two! Three? (Four)  ') == ["One. two!", "Three?", "(Four)"]
    assert [one(spark, X.singular(t), t=w) for w in ("berries", "tomatoes", "eggs", "glass", "gas", "asparagus")] == ["berry", "tomato", "egg", "glass", "gas", "asparagus"]
    assert one(spark, X.clean_generated(t), t='\nSearch: "quick soup."') == "quick soup" and one(spark, X.clean_generated(t), t="Search:\n`clam soup`") == "clam soup"
    assert one(spark, word_overlap(t, F.lit("red soup")), t="red Soup soup dish") == 0.75 and one(spark, X.word_overlap_unstemmed(t, F.lit("red soup")), t="red Soups soup dish") == 0.5


def test_stems_overlap_and_rejections(spark):
    t, title = F.col("t"), F.lit("Baked Honey Sriracha Salmon")
    recipe = F.lit("Garlic Butter Shrimp. Pink shrimp, cook until done, with noodles")
    assert one(spark, word_overlap(t, recipe), t="the shrimp cooked with pink noodle dish") == 0.8 and one(spark, word_overlap(t, recipe), t="the of with") == 0
    assert one(spark, word_overlap(t, F.lit("Corn dip with 1 jalapeno pepper")), t="jalapeño dip") == 1
    cases = {"": "empty", "word " * 13: "too long", "baked honey-sriracha SALMON": "same as title", "baked honey sriracha salmons flavorful": "repeats the title", "sweet sriracha salmon": None}
    assert {q: one(spark, X.generated_problem(t, title), t=q) for q in cases} == cases
    assert one(spark, X.generated_problem(t, F.lit("Chicken and Olives")), t="chicken in olive herb sauce") is None
    published = "consign:consign consistency:consist knackeries:knackeri knitting:knit skies:sky dying:die generously:generous happy:happi by:by hopping:hop hoped:hope agreed:agre ponies:poni ties:tie gas:gas kiwis:kiwi relational:relat rational:ration digitizer:digit hopefulness:hope triplicate:triplic formalize:formal adoption:adopt roll:roll proceed:proceed"
    assert [p for p in published.split() if stem(p.split(":")[0]) != p.split(":")[1]] == []


def test_ingredient_terms_keywords_and_substitutions(spark):
    lines = ["2 cloves garlic, crushed", "1 (2 inch) piece fresh ginger, peeled", "300g/10oz sweet shortcrust pastry", "Dressing:", "½ cup red peppers", "salt to taste", "3 ginger", "red pepper", "one two three four five six words here", "12"]
    rows = spark.createDataFrame([(lines,), (None,), ([],)], "l array<string>").select(taken_apart(F.col("l")).alias("l")).select(X.ingredient_terms(F.col("l")).alias("t")).collect()
    assert [r.t for r in rows] == [["garlic", "ginger", "sweet shortcrust pastry", "red peppers", "salt"], None, []]
    assert one(spark, X.keywords(F.col("t")), t="Grandma's Best Chili (spicy) II with Mixed-up Dill XIV a") == ["grandma's", "chili", "mixed-up", "dill"]
    terms = spark.createDataFrame([(["heavy cream", "ground beef", "beet salad"], "Beef with doubled cream and beetroots")], "t array<string>, s string")
    new, made = X.substitute_words(F.col("t"), {"heavy": "double", "ground": "minced", "beet": "beetroot"}, F.col("s"))
    assert tuple(terms.select(new.alias("a"), made.alias("b")).first()) == (["heavy cream", "minced beef", "beet salad"], ["ground -> minced"])


def test_chunkers(spark):
    t = F.col("t")
    assert one(spark, chunking.sentence_groups(t, 3), t="A. B. C. D. E.") == ["A. B. C.", "D. E."]
    text = " ".join(["word"] * 50 + ["x" * 300] + ["tail"] * 3)
    cut = one(spark, chunking.word_budget(t, 10), t=text)
    assert " ".join(cut) == text and "x" * 300 in cut
    sentences = [f"Sentence number {i} about {'soup' if i < 4 else 'cake'} and more words here." for i in range(8)]
    pieces = chunking.semantic_pieces(sentences, chunking.sentence_vectors(sentences))
    assert " ".join(pieces) == " ".join(sentences) and all(len(p) >= 80 for p in pieces) and chunking.semantic_pieces([], np.zeros((0, 4))) == []


def test_lifecycle(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "k long, v string")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(ingest.upsert(old, new, ["k"])) == {(1, "a"), (2, "c"), (3, None)} and rows(ingest.insert_absent(old, new, ["k"])) == {(1, "a"), (2, "b"), (3, None)}
    assert rows(ingest.delete_stale(old, new, ["k"])) == {(2, "b")} and rows(ingest.differing(old, new, ["k"], ["v"])) == {(2,)}
    assert rows(ingest.dense_ids(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "v string"), "v")) == {("a", 1), ("b", 2)}
    assert rows(querygen.stratified_quotas(spark.createDataFrame([("x",)] * 60 + [("y",)] * 30 + [("z",)] * 10, "s string"), "s", 30).select("s", "quota")) == {("x", 18), ("y", 9), ("z", 3)}


def test_files_store_and_stream(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"two\nlines, ""quoted"""\n')
    assert read_csv(spark, str(tmp_path / "a.csv"), "id int, t string").first().t == 'two\nlines, "quoted"'
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a"')
    assert sorted(r.a for r in read_json_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a"\n{"a": 2}\n')
    with pytest.raises(ValueError):
        read_json_lines(spark, str(tmp_path / "b.jsonl"), "a int")
    assert len(file_hashes(spark, str(tmp_path / "a.csv")).first().sha256) == 64
    store, rows = Store(spark, str(tmp_path / "store")), spark.range(3)
    with pytest.raises(ValueError, match="too few"):
        store.publish("x", rows, lambda df: ["too few"] if df.count() < 9 else [])
    assert store.names() == []
    store.publish("x", rows)
    assert store.names() == ["x"] and store.table("x").count() == 3
    for bad in (lambda: store.publish("x", rows), lambda: store.discard("x"), lambda: store.table("y")):
        with pytest.raises(ValueError):
            bad()
    store.discard("x", sure=True)
    assert store.names() == []
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in ([1, 2], [2, 3]):
        spark.createDataFrame([(i,) for i in part], "k long").write.mode("append").parquet(source)
        follow(spark, source, "k long", target, state, ["k"], lambda df: df.withColumn("done", F.lit(True)))
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_plans_push_down_and_limit_groups(spark, small):
    plan = spark.read.parquet(f"{small}/recipe_chunks.parquet").filter(retrieval.where(ranges={"token_count": (5, None)})).select("chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(token_count,5)" in plan and "chunk_text" not in plan.split("ReadSchema")[1]
    hits = spark.createDataFrame([(1, 2, 0.5)], "query_id long, key long, score double")
    assert "WindowGroupLimit" in retrieval.top_k(hits, "query_id", [F.desc("score")], 3)._jdf.queryExecution().executedPlan().toString()


def test_engine_validates_and_ranks(spark):
    rows = [(1, 10, "lemon cake with sugar", "name", 0), (2, 10, "bake the cake", "step", 1), (3, 20, "tomato soup", "name", 0), (4, 30, None, "name", 0), (5, 30, " ", "step", 1)]
    chunks = spark.createDataFrame(rows, "chunk_id long, item_id long, content string, kind string, position int")
    engine = Engine({"a": chunks, "b": None})
    queries = spark.createDataFrame([(1, "lemon cake"), (2, " "), (3, None), (4, "soup")], "query_id long, text string")
    for mode in ("sparse", "dense", "fusion", "hybrid"):
        best = {r.query_id: r.item_id for r in engine.search("a", queries, mode, 2, level="item").filter("rank = 1").collect()}
        assert best == {1: 10, 4: 20}
    found = engine.search("a", queries, "sparse", 5, {"kind": ["step"], "min_position": 1})
    assert found.columns == ["query_id", "rank", "chunk_id", "item_id", "kind", "position", "content", "score"] and [r.chunk_id for r in found.collect()] == [2]
    for bad in (lambda: engine.search("b", queries), lambda: engine.search("c", queries), lambda: engine.search("a", queries, k=51), lambda: engine.search("a", queries, filters={"color": 1}), lambda: engine.search("a", queries, filters={"kind": ["x"]}, kinds={"step"})):
        with pytest.raises(ValueError):
            bad()
    assert [(r.place, r.item_id) for r in lookup_in_order(chunks.select("chunk_id", "item_id"), "chunk_id", [3, 1, 3, 99]).collect()] == [(0, 20), (1, 10), (2, 20)]


def test_encoder_is_tried_again_and_in_halves():
    calls = []

    def fails_on_many(texts):
        calls.append(len(texts))
        if len(texts) > 1:
            raise OSError("too many")
        return np.ones((1, 3))

    assert encode_with_retries(["a", "b", "c"], fails_on_many, 2, 0).shape == (3, 3) and calls[:2] == [3, 3]
    with pytest.raises(OSError):
        encode_with_retries(["a"], lambda t: (_ for _ in ()).throw(OSError("down")), 2, 0)


def test_many_torn_files_append_and_subset(spark, tmp_path):
    folder = tmp_path / "torn"
    folder.mkdir()
    for i in range(1200):
        (folder / f"{i}.jsonl").write_text(f'{{"a": {i}}}\n{{"a"')
    assert read_json_lines(spark, str(folder), "a int").count() == 1200
    (folder / "0.jsonl").write_text('{"a": 0}\n{"a"\n')
    with pytest.raises(ValueError):
        read_json_lines(spark, str(folder), "a int")
    log = tmp_path / "log.jsonl"
    log.write_text('{"a": 1}\n{"a": 2')
    append_json_lines(str(log), [{"a": 3}])
    assert log.read_text() == '{"a": 1}\n{"a": 3}\n'
    rows = spark.createDataFrame([(i, None if i % 3 else "x") for i in range(50)], "k long, t string")
    one, two = (sorted((r.recipe_idx, r.k, r.t) for r in subset(rows, "k", 10, 42, str(tmp_path / "sub")).collect()) for _ in range(2))
    assert one == two and [r[0] for r in one] == list(range(10)) and all(r[2] in ("", "x") for r in one)


def test_ledger_hash_and_report(spark, tmp_path):
    ledger = RunLedger(str(tmp_path / "ledger.jsonl"))
    ledger.start("r1", seed=42)
    with pytest.raises(ValueError):
        ledger.start("r1")
    ledger.fail("r1", "x" * 9000)
    with pytest.raises(ValueError):
        ledger.finish("r1")
    assert ledger.runs()["r1"]["status"] == "failed" and len(ledger.runs()["r1"]["message"]) == 4000
    a, b = {"id": 1, "t": "x"}, {"t": "y", "id": 2}
    assert query_set_hash([a, b]) == query_set_hash([{"id": 2, "t": "y"}, a]) and query_set_hash([a]) != query_set_hash([b]) and len(query_set_hash([a])) == 16
    write_report(spark.createDataFrame([(1, "a|b", 0.5)], "k int, t string, x double"), str(tmp_path / "out"), "table")
    assert (tmp_path / "out" / "table.md").read_text() == "|k|t|x|\n|-|-|-|\n|1|a\\|b|0.500|\n" and (tmp_path / "out" / "table.csv").read_text().splitlines() == ["k,t,x", "1,a|b,0.5"]
    stamp = provenance([str(tmp_path / "out" / "table.csv")], seed=42)
    assert stale(stamp) == []
    (tmp_path / "out" / "table.csv").write_text("other")
    assert stale(stamp) == [str(tmp_path / "out" / "table.csv")]


def test_counted_bootstrap_and_rerank_losses(spark):
    d, n = np.array([-0.5, 0.0, 1.0]), np.array([10, 70, 40])
    whole = np.repeat(d, n)
    a, b = evaluation.counted_bootstrap(d, n), evaluation.paired_bootstrap(whole, np.zeros(120))
    assert abs(a[0] - b[0]) < 1e-12 and max(abs(x - y) for x, y in zip(a, b)) < 0.02 and evaluation.counted_bootstrap(np.zeros(1), np.array([9])) == (0, 0, 0, 1)
    ranks = spark.createDataFrame([(1, 3, None), (2, 7, 2), (3, None, 4), (4, 2, 2)], "query_id long, before int, after int")
    row = evaluation.net_effect(ranks, "before", "after").first()
    assert (row.hurt, row.help, row.same, row.top5_left, row.top5_entered, row.top5_net, row.median_drop, row.top20_left, row.top20_entered) == (1, 2, 1, 1, 2, 1, 18.0, 1, 1)
