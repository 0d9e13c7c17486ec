import json

from pyspark.sql import functions as F

from quillmatch import schemas
from quillmatch.plans import matching
from quillmatch.sources import readers, writers
from quillmatch.streaming import ingest


def offer(i, **props):
    cluster = props.pop("cluster", "c1")
    return {
        "nodeID": f"n{i}", "url": f"http://www.shop{i}.com/x", "cluster_id": cluster, "identifiers": [{"/mpn": f"[m{i % 2}]"}, {"/gtin13": "[13]"}, {"/gtin8": "[8]"}],
        "schema.org_properties": [{f"/{k}": f"[{v}]"} for k, v in props.items()], "parent_schema.org_properties": [{"/title": "[Parent title]"}, {"/price": "[USD 9]"}],
        "parent_NodeID": "p", "relationToParent": "offers", "availability": "x",
    }


def test_corpus_to_features(spark, tmp_path):
    offers = [offer(1, name="Red, null", price="USD 10 50", description="descriptionThe red camera lens"), offer(2, name="red", price="12", description="A red camera"), offer(3, name="none")]
    (tmp_path / "offers.json").write_text("\n".join(map(json.dumps, offers)))
    (tmp_path / "clusters.json").write_text(json.dumps({"id": "c1", "category": "Camera_and_Photo", "id_values": "v"}))
    ids = [f"{o['nodeID']} {o['url']}" for o in offers]
    (tmp_path / "pairs").mkdir()
    (tmp_path / "pairs" / "cameras_train.txt").write_text(f"{ids[0]}#####{ids[1]}#####1\n{ids[0]}#####{ids[1]}#####1\n")
    (tmp_path / "pairs" / "gs_cameras.txt").write_text(f'{ids[1]}#####{ids[0]}#####0\n"odd#####y#####x\n')

    pairs = readers.read_pairs(spark, str(tmp_path / "pairs"))
    assert pairs.filter("offer_id_1 = '\"odd'").first()["label"] is None
    pairs = matching.clean_pairs(pairs, bad=[(ids[2], ids[0], 1)]).filter("label IS NOT NULL")
    assert pairs.count() == 2 and {r["dataset"] for r in pairs.collect()} == {"train", "test"}

    wanted = matching.relational.distinct_offers(pairs)
    flat = matching.with_categories(matching.flat_offers(readers.read_offers(spark, str(tmp_path / "offers.json")), wanted), readers.read_clusters(spark, str(tmp_path / "clusters.json")))
    got = {r["offer_id"]: r for r in flat.collect()}
    assert set(got) == set(ids[:2])
    one = got[ids[0]]
    assert (one["name"], one["price"], one["gtin"], one["description"], one["domain"], one["category"]) == ("Red", 10.5, "13", "The red camera lens", "www.shop1.com", "Camera_and_Photo")

    table = matching.pair_table(pairs, flat)
    assert table.columns[0] == "label" and table.count() == 2
    normal = matching.normalised(flat)
    feats = {r["dataset"]: r for r in matching.attribute_features(pairs, normal).collect()}
    assert feats["train"]["name"] == 1.0 and feats["train"]["category"] == 1 and 0 < feats["train"]["description"] < 1
    assert abs(feats["train"]["description"] + feats["train"]["description_distance_compat"] - 1) < 1e-9
    assert feats["train"]["brand"] == 0
    docs = matching.document_features(pairs, normal, 2)
    assert docs.columns == [*schemas.PAIR_KEY, "v"] and docs.count() == 2


def test_train_and_score(spark):
    rows = [("train" if i % 3 else "test", i % 2, float(i % 2) + i / 1000) for i in range(90)]
    made, scores = matching.train_and_score(spark.createDataFrame(rows, "dataset string, label int, x double"), ["x"], ["nb", "rf"])
    assert set(made) == {"nb", "rf"} and all(r["f1"] == 1 for r in scores.collect())


def test_pairs_stay_in_each_file_they_are_in(spark):
    rows = [("a", "b", 1, "x_train", "train", "shoes"), ("a", "b", 1, "x_train", "train", "shoes"), ("a", "b", 1, "y_train", "train", "shoes"), ("a", "b", 1, "gs_x", "test", "shoes"), ("c", None, 0, "gs_x", "test", None)]
    df = spark.createDataFrame(rows, schemas.PAIR)
    got = sorted([tuple(r) for r in matching.clean_pairs(df.limit(3), df, bad=[("c", "d", 0)]).collect()], key=str)
    assert got == sorted(set(rows), key=str)


def test_every_key_of_an_offer_is_kept(spark):
    rows = [{"nodeID": "n", "url": "u", "cluster_id": "c", "identifiers": [{"/gtin8": "[8]"}, {"/isbn": "[i]"}], "schema.org_properties": [{"/color": "[red]"}, {"/offers": {"/sku": "[s]", "deep": {"er": "1"}}}, {"/sku": "[other]"}],
             "parent_schema.org_properties": [{"/color": "[blue]"}, {"/material": "[wood]"}], "parent_NodeID": None, "availability": None}]
    raw = spark.read.schema(schemas.OFFER_RAW).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    one = matching.flat_offers(raw, spark.createDataFrame([("n u",)], "offer_id string"), ["color", "isbn", "offers_deep_er"]).first().asDict()
    assert (one["gtin"], one["isbn"], one["color"], one["offers_deep_er"], one["sku"]) == ("8", "i", "red", "1", "other")
    assert one["others"] == {"offers_sku": "s", "material": "wood"}


def test_search_refit_and_results_in_files(spark, tmp_path):
    rows = [("train" if i % 3 else "test", i, i % 2, float(i % 2) + i / 1000) for i in range(90)]
    df = spark.createDataFrame(rows, "dataset string, id long, label int, x double")
    points = {"nb": [], "rf": [{"numTrees": 3, "maxDepth": 2}]}
    made, scores = matching.train_and_score(df, ["x"], points=points, key="id")
    assert set(made) == {"nb", "rf"} and {r["model"]: r["f1"] for r in scores.collect()} == {"nb": 1.0, "rf": 1.0}
    v = matching.models.assembled(df, ["x"])
    made, told = matching.models.search_refit_predict(v.filter("dataset = 'train'"), v.filter("dataset = 'test'"), points, "id")
    writers.write_results(made, told, str(tmp_path / "r"))
    again, predictions, counts = readers.exists(spark, str(tmp_path / "r")) and writers.read_results(spark, str(tmp_path / "r"))
    key = lambda d: sorted((r["model"], r["id"], r["prediction"], round(r["score"], 9)) for r in d.collect())
    assert key(predictions) == key(told) and counts.count() == 4
    test = v.filter("dataset = 'test'")
    assert {n: sorted(r["prediction"] for r in m.transform(test).collect()) for n, m in again.items()} == {n: sorted(r["prediction"] for r in m.transform(test).collect()) for n, m in made.items()}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    p = str(tmp_path / "t")
    calls = []
    for _ in range(2):
        assert readers.read_or_make(spark, p, lambda: calls.append(1) or df).count() == 2
    assert len(calls) == 1
    writers.write_csv(df, str(tmp_path / "c"))
    assert readers.read_csv(spark, str(tmp_path / "c"), "id int, s string").orderBy("id").collect() == df.collect()
    writers.write_json(df, str(tmp_path / "j"))
    assert readers.parse_lines(spark.read.text(str(tmp_path / "j")), "id int, s string").orderBy("id").collect() == df.collect()
    writers.write_table(df, str(tmp_path / "p"), ["s"])
    assert writers.results_path("/a/features-9.csv") == "/a/results/features-9-results"
    assert "<table" in writers.html_table(df, 1)


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    keys = spark.createDataFrame([(1,)], "k int")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(src)
    for expected in (1, 2):
        s = ingest.ingest(ingest.stream_files(spark, src, "k int, v string"), keys, "k", lambda x: x.withColumn("v", F.upper("v")))
        ingest.run_available(s, out, str(tmp_path / "cp"))
        assert spark.read.parquet(out).count() == expected
        spark.createDataFrame([(1, "c")], "k int, v string").write.mode("append").parquet(src)


def test_scratch_lies_in_the_shared_folder(spark):
    from types import SimpleNamespace

    import pytest

    from quillmatch.sources import scratch

    unset = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    assert scratch.shared_dir(unset("local[8]")).startswith("file:///tmp/")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            scratch.shared_dir(unset(master))
    path = scratch.scratch(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and spark.sparkContext.applicationId in path
    df = scratch.written(spark.range(3), "x")
    assert df.count() == 3 and readers.exists(spark, df.written_to)
    scratch.drop_table(df)
    assert not readers.exists(spark, df.written_to)


def test_vectors_go_with_parts_and_pairs_are_not_shuffled(spark):
    """document_path's rows are those of pairs joined with both offers, and no exchange has a pair."""
    from quillmatch.plans import matching_queries
    from quillmatch.plans.catalog import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    v = spark.createDataFrame([(f"o{i}", [float(i), i % 7.0]) for i in range(1, 150)], "offer_id string, v array<double>")
    made = matching_queries.part_offer_pairs(t, v).select("offer_id_1", "offer_id_2", matching.vector_difference())
    pairs = matching.relational.pair_up(matching_queries.part_offer_pairs(t), v, "offer_id", "offer_id_1", "offer_id_2")
    key = lambda df: sorted((r["offer_id_1"], r["offer_id_2"], tuple(r["v"])) for r in df.collect())
    assert key(made) == key(pairs.select("offer_id_1", "offer_id_2", matching.vector_difference())) != []
    lines = made._jdf.queryExecution().executedPlan().toString().splitlines()
    join = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
    assert not any("Exchange" in x for x in lines[:join])
