"""Queries of sources, sinks and small relational steps: each writes rows of a table and reads them back, or takes one step."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmatch.functions import jsonflat, similarity, text
from quillmatch.operators import relational, vectors
from quillmatch.plans import matching
from quillmatch.plans.catalog import query
from quillmatch.sources import readers, writers
from quillmatch.sources.scratch import scratch


def named_files(df, folder, name):
    """df's one text column as files name-0.txt, name-1.txt, ..., one for each task."""
    df.write.text(f"{folder}.{name}.made")
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf)
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(folder))
    for i, made in enumerate(fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}.{name}.made/part-*"))):
        fs.rename(made.getPath(), jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}-{i}.txt"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS offer_id_1, '"' || p_name AS offer_id_2, p_size % 2 AS label, CASE WHEN p_size % 3 = 0 THEN 'gs_shoes.txt' ELSE 'cameras_train.txt' END AS filename,
CASE WHEN p_size % 3 = 0 THEN 'test' ELSE 'train' END AS dataset, CASE WHEN p_size % 3 = 0 THEN 'shoes' ELSE 'cameras' END AS file_category FROM part""")
def pair_files(t):
    folder = scratch(t._spark, "pairs")
    line = F.concat(F.col("p_partkey"), F.lit('#####"'), F.col("p_name"), F.lit("#####"), F.col("p_size") % 2).alias("value")
    named_files(t.part.filter("p_size % 3 = 0").select(line), folder, "gs_shoes")
    named_files(t.part.filter("p_size % 3 <> 0").select(line), folder, "cameras_train")
    return readers.read_pairs(t._spark, folder).withColumns({"label": F.col("label").cast("int"), "filename": F.regexp_replace("filename", r"-\d+", "")})


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def json_lines(t):
    folder = scratch(t._spark, "json")
    writers.write_json(t.part.select("p_partkey", "p_name", "p_retailprice"), folder)
    return readers.read_json_lines(t._spark, folder, "p_partkey long, p_name string, p_retailprice double")


@query("SELECT p_partkey, p_name, p_size FROM part")
def csv_with_key(t):
    folder = scratch(t._spark, "csv")
    writers.write_csv(t.part.select("p_partkey", "p_name", "p_size"), folder)
    return readers.read_csv(t._spark, folder, "p_partkey long, p_name string, p_size int")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 0 THEN s_name END AS s_name FROM supplier")
def json_by_line(t):
    whole = F.to_json(F.struct("s_suppkey", "s_name"))
    lines = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 5 > 0, whole).otherwise("{broken").alias("value"))
    return readers.parse_lines(lines, "s_name string", keep=["s_suppkey"])


@query("SELECT n_nationkey, n_name FROM nation")
def made_once(t):
    path, calls = scratch(t._spark, "made"), []
    make = lambda: calls.append(1) or t.nation.select("n_nationkey", "n_name")
    readers.read_or_make(t._spark, path, make)
    again = readers.read_or_make(t._spark, path, make)
    return again if len(calls) == 1 else again.limit(0)


@query("SELECT 'u' || p_partkey AS url, 1 AS entries FROM part WHERE p_size % 2 = 0")
def specs_with_entries(t):
    folder = scratch(t._spark, "specs")
    pairs = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("size"), F.col("p_size").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    writers.write_json(t.part.select(F.concat(F.lit("u"), "p_partkey").alias("url"), pairs.alias("keyValuePairs")), folder)
    return readers.read_specs(t._spark, folder).select("url", F.size("keyValuePairs").alias("entries"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS cluster_id, 'Shoes' AS category, p_name AS id_values FROM part WHERE p_size % 2 = 0")
def clusters_of_interest(t):
    folder = scratch(t._spark, "clusters")
    category = F.when(F.col("p_size") % 2 == 0, "Shoes").otherwise("Toys_and_Games")
    writers.write_json(t.part.select(F.col("p_partkey").cast("string").alias("id"), category.alias("category"), F.col("p_name").alias("id_values")), folder)
    return readers.read_clusters(t._spark, folder, ["Shoes", "Jewelry"])


@query("""SELECT 'nation' AS "table", '/a/results/nation-' || count(*) || '-results' AS path, least(count(*), 10) AS cells, min(n_name) AS first FROM nation
UNION ALL SELECT 'region', '/a/results/region-' || count(*) || '-results', least(count(*), 10), min(r_name) FROM region""")
def named_results(t):
    """Where results of a table go, named after it and its rows, and what a rendering of its first ten rows shows."""
    told = []
    for name, column in (("nation", "n_name"), ("region", "r_name")):
        df = getattr(t, name).select(column)
        shown = writers.html_table(df.orderBy(column), 10).split("<td>")[1:]
        told.append((name, writers.results_path(f"/a/{name}-{df.count()}.csv"), len(shown), shown[0].split("</td>")[0]))
    return t._spark.createDataFrame(told, "`table` string, path string, cells long, first string")


@query("SELECT n_nationkey AS key_1, n_name AS name_1, n_regionkey AS n_regionkey FROM nation")
def suffixed_names(t):
    df = t.nation.select(F.col("n_nationkey").alias("/key"), F.col("n_name").alias("name/"), "n_regionkey")
    return relational.suffixed(relational.clean_names(df), "_1", keep=("n_regionkey",))


@query("SELECT n_nationkey AS l_n_nationkey, n_name AS l_n_name, n_regionkey FROM nation")
def prefixed_names(t):
    return relational.prefixed(t.nation.select("n_nationkey", "n_name", "n_regionkey"), "l_", keep=("n_regionkey",))


@query("SELECT l_returnflag AS label, l_orderkey, l_tax FROM lineitem")
def label_first(t):
    rows = t.lineitem.select("l_tax", "l_orderkey", F.col("l_returnflag").alias("label"))
    return relational.sort_columns(rows)


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(quality = 0 AND toxic = 1, false)")
def without_bad_rows(t):
    both = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return relational.without(both, (F.col("quality") == 0) & (F.col("toxic") == 1)).select("doc_id", "quality")


@query("SELECT DISTINCT o_custkey, c_name, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey")
def joined_complete(t):
    a = t.orders.select("o_custkey", "o_orderpriority", F.lit(None).cast("string").alias("nothing"))
    b = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return relational.join_complete(a, b, "o_custkey")


@query("SELECT l_orderkey, l_linenumber, a.p_name AS name_1, b.p_name AS name_2 FROM lineitem LEFT JOIN part a ON a.p_partkey = l_partkey LEFT JOIN part b ON b.p_partkey = l_suppkey + 1")
def pairs_with_attributes(t):
    pairs = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("id_1"), (F.col("l_suppkey") + 1).alias("id_2"))
    items = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return relational.pair_up(pairs, items, "id", "id_1", "id_2", "left").select("l_orderkey", "l_linenumber", "name_1", "name_2")


@query("""SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))), 6) AS apart, len(a.embedding) AS k
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def pairs_with_vectors(t):
    """The double join of pairs with vectors, each one array column."""
    ids = t.embeddings.select("vec_id")
    pairs = ids.select("vec_id", F.col("vec_id").alias("id_1"), (F.col("vec_id") + 1).alias("id_2"))
    both = relational.pair_up(pairs, t.embeddings.select(F.col("vec_id").alias("id"), similarity.doubles(F.col("embedding")).alias("v")), "id", "id_1", "id_2")
    d = similarity.abs_difference(F.col("v_1"), F.col("v_2"))
    return both.select("vec_id", F.round(similarity.norm(d), 6).alias("apart"), F.size("v_1").cast("long").alias("k"))


CLEAN = r"regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({}, '<.*?>', '', 'g')), '[^a-z0-9 ]{{2,}}', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), '\W(en|enus)\W', '', 'g')"


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS offer_id, {CLEAN.format('p_name')} AS name, {CLEAN.format('p_brand')} AS brand, {CLEAN.format('p_type')} AS manufacturer, p_retailprice AS price FROM part")
def normalised_offers(t):
    """The cleaning of all text columns of an offer at once."""
    none = {c: F.lit(None).cast("string").alias(c) for c in ("gtin", "mpn", "sku", "identifier", "productID", "category", "description")}
    offers = t.part.select(F.col("p_partkey").cast("string").alias("offer_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("manufacturer"), F.col("p_retailprice").alias("price"), *none.values())
    return matching.normalised(offers, stemmed=False).select("offer_id", "name", "brand", "manufacturer", "price")


@query("SELECT p_partkey, TRY_CAST(p_size || '.50' AS DOUBLE) AS price FROM part")
def price_with_spaces(t):
    return t.part.select("p_partkey", text.parse_price_spaced(F.concat(F.lit("USD"), F.col("p_size"), F.lit(" 50"))).alias("price"))


@query("SELECT doc_id, CASE WHEN source <> 'web' THEN source END AS source FROM documents")
def null_words(t):
    value = F.when(F.col("source") == "web", "null").otherwise(F.col("source"))
    array = jsonflat.maps(F.concat(F.lit('[{"/source": "['), value, F.lit(']"}]')))
    return jsonflat.flatten(t.documents.select("doc_id", array.alias("a")), "a", ["source"])


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 3")
def first_rows(t):
    return t.part.select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(3)


@query("SELECT k, round(share, 6) AS share, round(sum(share) OVER (ORDER BY k), 6) AS cumulative, sum(share) OVER (ORDER BY k) <= 0.999 AS kept FROM (SELECT n_nationkey AS k, (n_nationkey + 1) / (SELECT sum(n_nationkey + 1) FROM nation) AS share FROM nation)")
def components_kept(t):
    total = t.nation.agg(F.sum(F.col("n_nationkey") + 1)).scalar()
    out = vectors.cumulative_shares(t.nation.select(F.col("n_nationkey").alias("k"), ((F.col("n_nationkey") + 1) / total).alias("share")), "k", "share")
    return out.withColumns({c: F.round(c, 6) for c in ("share", "cumulative")})


@query("""SELECT 'x' || i AS feature, round(avg(x), 6) + 0.0 AS mean, round(var_pop(x), 6) AS variance FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY i""")
def merged_by_feature(t):
    """Two tables of features, merged by their shared column."""
    long = t.embeddings.select(F.posexplode("embedding").alias("i", "x")).select(F.concat(F.lit("x"), F.col("i") + 1).alias("feature"), F.col("x").cast("double").alias("x"))
    means, spread = long.groupBy("feature").agg((F.round(F.avg("x"), 6) + F.lit(0.0)).alias("mean")), long.groupBy("feature").agg(F.round(F.var_pop("x"), 6).alias("variance"))
    return means.join(spread, "feature")
