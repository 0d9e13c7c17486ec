"""Queries of profiling, evaluation and models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quillmatch.functions import text
from quillmatch.operators import boosting, evaluate, models, relational, stats
from quillmatch.plans import matching
from quillmatch.plans.catalog import query
from quillmatch.sources import writers
from quillmatch.sources.scratch import scratch

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LABELLED = "documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def labelled(t):
    """documents with their labels, null where there are none."""
    return t.documents.select("doc_id", "text", "lang", "source", "n_chars").join(t.labels, "doc_id", "left")


def judged(t):
    """label (quality), a rule's score and prediction, and what a row of evaluation is grouped by."""
    d = t.labels.join(t.documents.select("doc_id", "lang", "n_chars", F.size(F.split("text", " ")).alias("n")), "doc_id")
    score = F.round(F.col("n") / (F.col("n_chars") + 1), 4)
    return d.select("doc_id", "lang", "toxic", "n_chars", F.col("quality").alias("label"), score.alias("score"), (score > 0.15).cast("int").alias("prediction"))


JUDGED = "j AS (SELECT *, CAST(score > 0.15 AS INTEGER) AS prediction FROM (SELECT l.doc_id, lang, toxic, n_chars, quality AS label, round(len(string_split(text, ' ')) / (n_chars + 1), 4) AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id))"


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def value_counts(t):
    return stats.value_counts(t.events, "event_type")


@query("SELECT lang, source, quality, count(*) AS n FROM " + LABELLED + " WHERE quality IS NOT NULL GROUP BY ALL")
def group_counts(t):
    return stats.group_counts(labelled(t), ["lang", "source", "quality"])


@query("""SELECT unnest(['doc_id', 'lang', 'quality', 'toxic']) AS "column", round(unnest([100 * (count(*) - count(d.doc_id)) / count(*), 100 * (count(*) - count(lang)) / count(*), 100 * (count(*) - count(quality)) / count(*), 100 * (count(*) - count(toxic)) / count(*)]), 6) AS percent_null FROM """ + LABELLED)
def percent_nulls(t):
    return stats.percent_nulls(labelled(t), ["doc_id", "lang", "quality", "toxic"]).withColumn("percent_null", F.round("percent_null", 6))


@query("""SELECT 'quality' AS a, 'toxic' AS b, round(corr(CAST(quality IS NULL AS INTEGER), CAST(toxic IS NULL AS INTEGER)), 6) AS value FROM (SELECT quality, nullif(toxic, 1) AS toxic FROM """ + LABELLED + ")")
def nullity_corr(t):
    d = labelled(t).withColumn("toxic", F.nullif("toxic", F.lit(1)))
    return stats.null_correlations(d, ["quality", "toxic"]).withColumn("value", F.round("value", 6))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS value FROM lineitem" for i, a in enumerate(sorted(MEASURES)) for b in sorted(MEASURES)[i + 1 :]))
def feature_corr(t):
    return stats.correlations(t.lineitem, MEASURES).withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("""SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, max(l_extendedprice) AS max FROM lineitem GROUP BY ALL""")
def boxplot_stats(t):
    out = stats.five_numbers(t.lineitem, "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


BOX = "SELECT lang, count(x) AS n, min(x) AS min, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, max(x) AS max FROM ({}) GROUP BY lang"


@query(BOX.format(r"SELECT lang, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS x FROM documents"))
def word_counts(t):
    d = t.documents.select("lang", text.word_count(F.col("text")).cast("long").alias("x"))
    return stats.five_numbers(d, "x", ["lang"])


@query(BOX.format("SELECT lang, length(text) AS x FROM documents"))
def char_counts(t):
    return stats.five_numbers(t.documents.select("lang", text.char_count(F.col("text")).cast("long").alias("x")), "x", ["lang"])


@query("""SELECT 'l_discount' AS "column", round(median(l_discount), 6) AS median FROM lineitem UNION ALL SELECT 'l_quantity', round(median(l_quantity), 6) FROM lineitem""")
def column_medians(t):
    return stats.medians(t.lineitem, ["l_quantity", "l_discount"]).withColumn("median", F.round("median", 6))


@query("""SELECT variable, substr(value, 1, 25) AS value, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY variable ORDER BY n DESC, value) AS INTEGER) AS rank FROM (
SELECT variable, value, count(*) AS n FROM (SELECT 'p_brand' AS variable, p_brand AS value FROM part UNION ALL SELECT 'p_name', p_name FROM part UNION ALL SELECT 'p_type', p_type FROM part) GROUP BY ALL)) WHERE rank <= 10""")
def top_values_per_group(t):
    long = relational.melt(t.part, [], ["p_brand", "p_name", "p_type"]).dropna()
    counts = long.groupBy("variable", "value").agg(F.count("*").alias("n"))
    return relational.top_per_group(counts, ["variable"], [F.desc("n"), "value"], 10).withColumn("value", text.prefix(F.col("value")))


@query("SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY 1")
def relative_frequency(t):
    return stats.shares(t.documents, "lang").withColumn("share", F.round("share", 6))


@query(""" UNION ALL """.join(f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, CAST(max({c}) AS DOUBLE) AS max FROM orders""" for c in ("o_totalprice", "o_custkey")))
def summary_stats(t):
    out = stats.summary(t.orders, ["o_totalprice", "o_custkey"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "q1", "median", "q3")})


@query("SELECT DISTINCT o_orderpriority AS o_orderpriority FROM orders")
def unique_values(t):
    return stats.unique_values(t.orders, "o_orderpriority")


def _kind(c):
    return f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, CASE WHEN sum(abs(CAST({c} AS DOUBLE) % 1)) > 0 OR count({c}) < count(*) THEN 'double'
WHEN min({c}) >= 0 THEN CASE WHEN max({c}) < 255 THEN 'uint8' WHEN max({c}) < 65535 THEN 'uint16' WHEN max({c}) < 4294967295 THEN 'uint32' ELSE 'uint64' END
ELSE CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'int8' WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'int16' ELSE 'int32' END END AS kind FROM lineitem"""


@query(" UNION ALL ".join(map(_kind, ("l_orderkey", "l_linenumber", "l_quantity", "l_tax"))))
def dtype_profile(t):
    return stats.narrow_types(t.lineitem, ["l_orderkey", "l_linenumber", "l_quantity", "l_tax"])


@query("""SELECT 'l_orderkey' AS "column", round(count(DISTINCT l_orderkey) / count(*), 6) AS ratio FROM lineitem UNION ALL SELECT 'l_returnflag', round(count(DISTINCT l_returnflag) / count(*), 6) FROM lineitem""")
def distinct_ratio(t):
    return stats.distinct_ratio(t.lineitem, ["l_orderkey", "l_returnflag"]).withColumn("ratio", F.round("ratio", 6))


@query("SELECT l_partkey AS id FROM lineitem UNION SELECT l_suppkey FROM lineitem UNION SELECT p_partkey FROM part UNION SELECT s_suppkey FROM supplier")
def rbind_distinct_ids(t):
    return relational.distinct_ids((t.lineitem, "l_partkey"), (t.lineitem, "l_suppkey"), (t.part, "p_partkey"), (t.supplier, "s_suppkey"))


@query("SELECT c_custkey, c_name, s_suppkey, s_name FROM customer FULL JOIN supplier ON false")
def union_missing_cols(t):
    return relational.union_all(t.customer.select("c_custkey", "c_name"), t.supplier.select("s_suppkey", "s_name"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def dedup_keep_first(t):
    return relational.keep_first(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) > 1 AS is_duplicate FROM documents")
def mark_duplicates(t):
    return relational.mark_duplicates(t.documents.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h")), ["h"]).drop("h")


@query("SELECT DISTINCT p_brand, p_type FROM part")
def drop_duplicate_rows(t):
    return t.part.select("p_brand", "p_type").dropDuplicates()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def semi_join_ids(t):
    wanted = t.lineitem.filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.semi_join(t.orders.select("o_orderkey", "o_totalprice"), wanted, "o_orderkey")


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_name <> 'ASIA'")
def left_join_category(t):
    """Nations stand for clusters, and their regions for the clusters of these."""
    clusters = lambda df, key, name, values: df.select(F.col(key).alias("cluster_id"), F.col(name).alias("category"), F.col(values).alias("id_values"))
    offers = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("cluster_id"))
    s = matching.with_categories(offers, clusters(t.nation, "n_nationkey", "n_name", "n_regionkey"))
    s = s.select("s_suppkey", F.col("category").alias("n_name"), F.col("id_values").alias("cluster_id"))
    region = clusters(t.region.filter("r_name <> 'ASIA'"), "r_regionkey", "r_name", "r_name")
    return matching.with_categories(s, region).select("s_suppkey", "n_name", F.col("category").alias("r_name"))


@query("""WITH a AS (SELECT l_suppkey, l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY ALL)
SELECT a.*, n FROM a JOIN b USING (l_suppkey, l_returnflag, l_linestatus)""")
def composite_key_join(t):
    key = ["l_suppkey", "l_returnflag", "l_linestatus"]
    a = t.lineitem.groupBy(*key).agg(F.sum("l_quantity").alias("q"))
    return a.join(t.lineitem.filter("l_discount > 0.05").groupBy(*key).agg(F.count("*").alias("n")), key)


@query("""WITH p AS (SELECT a.p_partkey AS k1, b.p_partkey AS k2, a.p_brand FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)
SELECT p_brand, count(DISTINCT id) AS n FROM (SELECT p_brand, k1 AS id FROM p UNION ALL SELECT p_brand, k2 FROM p) GROUP BY 1""")
def unique_by_dataset(t):
    # every part of a block of two or more is in a pair, so the blocks' sizes tell
    blocks = t.part.groupBy("p_brand", "p_size").agg(F.count("*").alias("n")).filter("n > 1")
    return blocks.groupBy("p_brand").agg(F.sum("n").alias("n"))


@query("""SELECT p_partkey, 'p_retailprice' AS variable, p_retailprice AS value FROM part UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS DOUBLE) FROM part""")
def melt_values(t):
    wide = t.part.select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    return relational.melt(wide, ["p_partkey"], ["p_retailprice", "p_size"])


@query("SELECT c_custkey, c_name FROM customer")
def drop_all_null(t):
    return relational.drop_all_null(t.customer.select("c_custkey", "c_name", F.lit(None).cast("string").alias("empty")))


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality = 1 ORDER BY md5(doc_id || '|42'), doc_id LIMIT 4")
def sampled_pairs(t):
    return relational.sample_rows(t.labels.filter("quality = 1"), ["doc_id"], 4, 42)


@query(f"WITH {JUDGED} SELECT label, count(*) FILTER (prediction = 0) AS predicted_0, count(*) FILTER (prediction = 1) AS predicted_1 FROM j GROUP BY 1")
def confusion(t):
    return evaluate.confusion(judged(t))


SCORES = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"
COUNTS = "count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label <> 1 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction <> 1) AS fn"


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"WITH {JUDGED} SELECT {SCORES} FROM (SELECT {COUNTS} FROM j)")
def prf(t):
    return _rounded(evaluate.scores(judged(t)))


@query(f"WITH {JUDGED} SELECT lang, {SCORES} FROM (SELECT lang, {COUNTS} FROM j GROUP BY lang)")
def prf_by_category(t):
    return _rounded(evaluate.scores(judged(t), ["lang"]))


@query(f"""WITH {JUDGED}, o AS (SELECT 1 - label AS label, 1 - prediction AS prediction FROM j), e AS (
SELECT '1' AS class, {SCORES.replace('round(', '(').replace(', 6)', ')')}, (SELECT count(*) FROM j WHERE label = 1) AS support FROM (SELECT {COUNTS} FROM j)
UNION ALL SELECT '0', {SCORES.replace('round(', '(').replace(', 6)', ')')}, (SELECT count(*) FROM j WHERE label = 0) FROM (SELECT {COUNTS} FROM o))
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (
SELECT * FROM e UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM e
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM e)""")
def classification_report(t):
    return _rounded(evaluate.report(judged(t)))


CURVE = f"""WITH {JUDGED}, s AS (SELECT score AS threshold, count(*) FILTER (label = 1) AS p, count(*) AS n FROM j GROUP BY 1),
c AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) / sum(n) OVER (ORDER BY threshold DESC) AS precision, sum(p) OVER (ORDER BY threshold DESC) / (SELECT sum(p) FROM s) AS recall FROM s)"""


@query(f"{CURVE} SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM c")
def pr_curve(t):
    return evaluate.pr_curve(judged(t)).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(f"""{CURVE}, e AS (SELECT * FROM c UNION ALL SELECT 'infinity'::DOUBLE, 1, 0)
SELECT round(sum((recall - r0) * (precision + p0) / 2), 6) AS auc FROM (SELECT *, lag(recall) OVER (ORDER BY threshold DESC) AS r0, lag(precision) OVER (ORDER BY threshold DESC) AS p0 FROM e)""")
def pr_auc(t):
    return evaluate.pr_area(evaluate.pr_curve(judged(t))).withColumn("auc", F.round("auc", 6))


@query(f"""{CURVE} SELECT pick, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM (
SELECT 'precision_1' AS pick, threshold, precision, recall, row_number() OVER (ORDER BY threshold) AS n FROM c WHERE precision = 1
UNION ALL SELECT 'recall_1', threshold, precision, recall, row_number() OVER (ORDER BY threshold) FROM c WHERE recall = 1
UNION ALL SELECT 'balanced', threshold, precision, recall, row_number() OVER (ORDER BY abs(precision - recall), threshold) FROM c) WHERE n = 1""")
def pr_threshold_picks(t):
    out = evaluate.threshold_picks(evaluate.pr_curve(judged(t))).dropna(subset=["threshold"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(f"""WITH {JUDGED}, k AS (SELECT CASE WHEN label = 1 AND prediction = 1 THEN 'TP' WHEN label = 0 AND prediction = 0 THEN 'TN' WHEN label = 0 AND prediction = 1 THEN 'FP' ELSE 'FN' END AS outcome,
CAST(toxic = 0 AS INTEGER) + CAST(label = 0 AS INTEGER) + CAST(n_chars = 0 AS INTEGER) AS zeros FROM j)
SELECT outcome, count(zeros) AS n, min(zeros) AS min, quantile_cont(zeros, 0.25) AS q1, quantile_cont(zeros, 0.5) AS median, quantile_cont(zeros, 0.75) AS q3, max(zeros) AS max FROM k GROUP BY 1""")
def classification_type_nulls(t):
    j = judged(t).select(evaluate.outcome(F.col("label"), F.col("prediction")).alias("outcome"), stats.count_zeros(["toxic", "label", "n_chars"]).alias("zeros"))
    return stats.five_numbers(j, "zeros", ["outcome"])


@query("SELECT lang, count(*) AS n, count(quality) AS present, round(count(quality) / count(*), 6) AS share FROM " + LABELLED + " GROUP BY lang")
def share_present(t):
    return labelled(t).groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("present"), F.round(F.count("quality") / F.count("*"), 6).alias("share"))


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 4) + 0.0 AS l_quantity FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)""")
def standard_scale(t):
    out = models.standard_scale(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"])
    return out.withColumn("l_quantity", F.round("l_quantity", 4) + F.lit(0.0))


@query("SELECT quality AS label, round((SELECT count(*) FROM labels) / (2 * count(*)), 6) AS weight FROM labels GROUP BY 1")
def class_weights(t):
    return models.class_weights(t.labels.select(F.col("quality").alias("label"))).withColumn("weight", F.round("weight", 6))


@query("""SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY ('0x' || md5(CAST(doc_id AS VARCHAR))[1:4])::INTEGER % 256, md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 3 AS INTEGER) AS fold FROM labels""")
def stratified_folds(t):
    return models.stratified_folds(t.labels.select("doc_id", "quality"), "quality", "doc_id", 3)


WIDTH = 64
COLUMNS = [f"x{i}" for i in range(1, WIDTH + 1)]


def vectors_of(t):
    """label (class below 5), vec_id and all components of each embedding as columns."""
    return t.embeddings.select("vec_id", (F.col("label") < 5).cast("int").alias("label"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COLUMNS)])


LONG = f"SELECT vec_id, CAST(label < 5 AS INTEGER) AS label, unnest(embedding)::DOUBLE AS x, unnest(range(1, {WIDTH + 1})) AS i FROM embeddings"


@query(f"""SELECT label, 'x' || i AS "column", round(count(*) / (SELECT count(*) FROM embeddings), 6) AS prior, round(avg(x), 6) + 0.0 AS mean, round(var_pop(x), 6) AS variance FROM ({LONG}) GROUP BY label, i""")
def gaussian_nb_sql(t):
    out = models.gaussian_parameters(vectors_of(t), COLUMNS)
    return out.withColumns({"prior": F.round("prior", 6), "mean": F.round("mean", 6) + F.lit(0.0), "variance": F.round("variance", 6)})


#: Values of each axis of the searches, one after the other, and folds.
AXES = {"svc": "4 2 2", "rf": "2 2 2 2 2", "gbt": "2 2 2 2 2 2", "rf fine": "2 2 2 2 2 2 3", "gbt fine": "2 2 2 2 2 2 2 3 2 2 3"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS model, CAST(list_product([{', '.join(v.split())}]) AS INTEGER) AS fits, CAST(list_product([{', '.join(v.split()[:-1])}]) * {int(v.split()[-1]) - 1} * (SELECT count(*) FROM labels) AS BIGINT) AS rows" for k, v in AXES.items()))
def grid_size(t):
    """Fits of each search, and the rows that all of them read of these labels: each fit all folds but one."""
    rows = [(k, models.grid_size(g, models.FOLDS[k]), len(models.grid_rows(g)) * (models.FOLDS[k] - 1)) for k, g in models.GRIDS.items()]
    n = t.labels.agg(F.count("*").alias("n"))
    return t._spark.createDataFrame(rows, "model string, fits int, times long").crossJoin(F.broadcast(n)).select("model", "fits", (F.col("times") * F.col("n")).alias("rows"))


def _split(t):
    """Train rows with weights that balance their own classes, and test rows."""
    train, test = models.random_split(models.assembled(vectors_of(t), COLUMNS), "vec_id", 70, 3)
    return models.with_weights(train), test


def _predicted(t, name):
    train, test = _split(t)
    return models.fit_predict(train, test, models.classifiers()[name]).select("vec_id", "label", "prediction")


SPLIT = "('0x' || md5(vec_id || '|3')[1:8])::BIGINT % 100 < 70"


@query(f"SELECT vec_id, label, CASE WHEN {SPLIT} THEN 'train' ELSE 'test' END AS part FROM embeddings")
def random_split(t):
    parts = models.random_split(t.embeddings.select("vec_id", "label"), "vec_id", 70, 3)
    return parts[0].withColumn("part", F.lit("train")).unionByName(parts[1].withColumn("part", F.lit("test")))


#: Balanced weights make the priors equal, so they cancel.
@query(f"""WITH v AS ({LONG}), p AS (SELECT label AS c, i, avg(x) AS m, var_pop(x) AS s FROM v WHERE {SPLIT} GROUP BY ALL),
f AS (SELECT vec_id, v.label, c, sum(-0.5 * ln(s) - (x - m) * (x - m) / (2 * s)) AS f FROM v JOIN p ON p.i = v.i WHERE NOT {SPLIT} GROUP BY ALL)
SELECT vec_id, label, CAST(arg_max(c, f) AS DOUBLE) AS prediction FROM f GROUP BY ALL""")
def nb_predict(t):
    return _predicted(t, "nb")


@query()
def rf_predict(t):
    return _predicted(t, "rf")


@query()
def gbt_predict(t):
    return _predicted(t, "gbt")


@query()
def svc_predict(t):
    train, test = models.random_split(models.fourier_features(vectors_of(t), COLUMNS, gamma=1.0, n=64), "vec_id", 70, 3)
    return models.fit_predict(models.with_weights(train), test, models.classifiers()["svc"]).select("vec_id", "label", "prediction")


@query()
def lr_search(t):
    """Both elastic-net searches on the train part, over five folds dealt three times, and the test part's predictions."""
    train, test = models.random_split(vectors_of(t), "vec_id", 70, 3)
    model, _, _ = models.elastic_net_refined(models.with_weights(train), COLUMNS)
    return model.transform(models.assembled(test, COLUMNS)).select("vec_id", "label", "prediction")


@query()
def lr_coefficients(t):
    train, _ = _split(t)
    model = models.classifiers()["lr"].fit(train)
    return models.coefficients(t._spark, model, COLUMNS)


@query()
def rf_grid_search(t):
    """The search on the train part, and the test part's predictions."""
    train, test = models.random_split(models.assembled(vectors_of(t), COLUMNS), "vec_id", 70, 3)
    v = models.stratified_folds(train, "label", "vec_id", models.FOLDS["rf"])
    model = models.grid_search(v, models.classifiers(weight=None)["rf"], models.spark_points(models.GRIDS["rf"]), folds=models.FOLDS["rf"], key="vec_id")
    return model.transform(test).select("vec_id", "label", "prediction")


@query()
def svc_search(t):
    """The kernel machine's search over all costs and widths on the train part, and the test part's predictions."""
    train, test = models.random_split(vectors_of(t), "vec_id", 70, 3)
    gamma, made = models.kernel_search(models.stratified_folds(models.with_weights(train), "label", "vec_id", models.FOLDS["svc"]), COLUMNS)
    return made.transform(models.fourier_features(test, COLUMNS, gamma)).select("vec_id", "label", "prediction")


@query()
def search_refit_test(t):
    """Search on the train part, scores on the dev part, refit on both, and the test part's predictions, through the
    files that results are kept in."""
    x = F.transform(F.slice("embedding", 1, WIDTH), lambda v: F.coalesce(v.cast("double"), F.lit(float("nan"))))
    x = F.coalesce(x, F.array_repeat(F.lit(float("nan")), WIDTH))  # as assembled() has it, but not by a column for each component
    v = t.embeddings.select("vec_id", (F.col("label") < 5).cast("int").alias("label"), array_to_vector(x).alias("features"))
    train, test = models.random_split(v, "vec_id", 70, 3)
    train, dev = models.random_split(train, "vec_id", 80, 7)
    points = {"nb": [], "rf": models.spark_points(models.GRIDS["rf"])}
    made, told = models.search_refit_predict(train, test, points, "vec_id", dev=dev)
    path = scratch(t._spark, "results")
    writers.write_results(made, told, path)
    again, predictions, _ = writers.read_results(t._spark, path)
    return predictions.select("model", "part", "vec_id", "label", "prediction", "score")


@query()
def gbt_early_stop(t):
    train, test = _split(t)
    fit_on, watch = models.random_split(train, "vec_id", 80, 5)
    model = models.boosted_with_stop(fit_on, watch, max_iter=60, patience=30, maxDepth=4)
    return model.transform(test).select("vec_id", "label", "prediction")


def _dealt(t):
    """The train part in the folds of the boosted trees' search, and the test part."""
    train, test = models.random_split(vectors_of(t), "vec_id", 70, 3)
    return models.stratified_folds(train, "label", "vec_id", models.FOLDS["gbt"]), test


@query()
def gbt_leaf_wise(t):
    """Trees of ten leaves, grown best first, until a fold that is not fitted has not gained for 30 rounds."""
    train, test = _dealt(t)
    model = boosting.fit(train, COLUMNS, [boosting.Booster(depth=None, leaves=10, rounds=40, patience=30, fold=0)], "vec_id", fold="fold")[0]
    return model.transform(test).select("vec_id", "label", "prediction", "score")


@query()
def gbt_search(t):
    """The boosted trees' search over all points and folds, each number of trees a prefix of one fit, and the test part's predictions."""
    train, test = _dealt(t)
    _, model, _ = boosting.search(train, COLUMNS, models.grid_rows(models.GRIDS["gbt"]), "vec_id", folds=models.FOLDS["gbt"])
    return model.transform(test).select("vec_id", "label", "prediction", "score")


@query()
def gbt_importances(t):
    train, _ = _split(t)
    rows = models.importances(models.classifiers()["gbt"].fit(train), COLUMNS)
    return t._spark.createDataFrame(rows, "feature string, importance double")


@query()
def informative_features(t):
    """Of all components and near copies of two of them."""
    v = vectors_of(t).withColumns({"y1": F.col("x1") + F.col("x2") * 0.01, "y2": F.col("x3") * 2, "z": F.lit(1.0)})
    return t._spark.createDataFrame([(c,) for c in models.informative(v, [*COLUMNS, "y1", "y2", "z"])], "feature string")


def scored_rules(t):
    """model (a threshold), feature_set (a language), precision, recall, f1."""
    j = judged(t).select("lang", "label", "score", F.explode(F.array(*[F.lit(x) for x in (0.14, 0.15, 0.16)])).alias("at"))
    j = j.select(F.concat(F.lit("at "), F.format_number("at", 2)).alias("model"), F.col("lang").alias("feature_set"), "label", (F.col("score") > F.col("at")).cast("int").alias("prediction"))
    return evaluate.scores(j, ["model", "feature_set"])


RULES = f"WITH {JUDGED}, r AS (SELECT 'at ' || a AS model, lang AS feature_set, label, CAST(score > a::DOUBLE AS INTEGER) AS prediction FROM j, (VALUES ('0.14'), ('0.15'), ('0.16')) x(a)), c AS (SELECT model, feature_set, {{counts}} FROM r GROUP BY ALL), s AS (SELECT model, feature_set, {{scores}} FROM c)"
MEANS = " UNION ALL ".join(f"SELECT {{by}}, '{m}' AS metric, round(avg({m}), 6) AS score FROM s GROUP BY 1" for m in ("precision", "recall", "f1"))


def means_sql(by):
    scores = "coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"
    counts = "count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label <> 1 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction <> 1) AS fn"
    return RULES.format(counts=counts, scores=scores) + " " + MEANS.format(by=by)


@query(means_sql("model"))
def mean_scores_by_model(t):
    return evaluate.mean_scores(scored_rules(t), "model").withColumn("score", F.round("score", 6))


@query(means_sql("feature_set"))
def mean_scores_by_feature_set(t):
    return evaluate.mean_scores(scored_rules(t), "feature_set").withColumn("score", F.round("score", 6))


DESCRIBED = ["o_orderstatus", "o_orderpriority", "o_custkey"]


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS n, count(DISTINCT {c}) AS "distinct", (SELECT CAST({c} AS VARCHAR) FROM orders GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1) AS top,
(SELECT count(*) FROM orders GROUP BY {c} ORDER BY 1 DESC LIMIT 1) AS freq, min(CAST({c} AS VARCHAR)) AS low, max(CAST({c} AS VARCHAR)) AS high FROM orders""" for c in DESCRIBED))
def describe_all(t):
    return stats.described(t.orders, DESCRIBED)


@query()
def rf_importances(t):
    train, _ = _split(t)
    rows = models.importances(models.classifiers()["rf"].fit(train), COLUMNS)
    return t._spark.createDataFrame(rows, "feature string, importance double")


#: The correlation matrix beside the unit matrix, and Gauss-Jordan steps until it is the unit matrix.
@query(f"""WITH RECURSIVE v AS ({LONG}), r AS (
  SELECT a.i, b.i AS j, corr(a.x, b.x) AS r FROM v a JOIN v b ON b.vec_id = a.vec_id GROUP BY ALL
), rows AS (SELECT i, list_concat(list(r ORDER BY j), list_transform(range(1, {WIDTH + 1}), lambda j: CASE WHEN j = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS row FROM r GROUP BY i
), g AS (
  SELECT 0 AS k, (SELECT list(row ORDER BY i) FROM rows) AS m
  UNION ALL
  SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda x: x / m[k + 1][k + 1])
    ELSE list_transform(list_zip(row, m[k + 1]), lambda p: p[1] - row[k + 1] * p[2] / m[k + 1][k + 1]) END) FROM g WHERE k < {WIDTH}
)
SELECT 'x' || i AS feature, round(m[i][{WIDTH} + i], 6) AS vif FROM (SELECT m, unnest(range(1, {WIDTH + 1})) AS i FROM g WHERE k = {WIDTH})""")
def vif(t):
    rows = sorted(models.inflation_factors(vectors_of(t), COLUMNS).items())
    return t._spark.createDataFrame(rows, "feature string, vif double").withColumn("vif", F.round("vif", 6))


@query()
def glm_stepwise(t):
    left, bic = models.stepwise_glm(vectors_of(t), COLUMNS)
    return t._spark.createDataFrame([(c, bic) for c in left], "feature string, bic double")


@query("SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings")
def running_number(t):
    return relational.numbered(t.embeddings.select("vec_id", "label"), ["label"], "vec_id").select("vec_id", "n")
