import math

import pytest
from pyspark.sql import functions as F

from quillmatch.functions import jsonflat, planning, similarity, stem, text


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (text.clean_text, "foo en bar enus baz", "foobarbaz"),
        (text.clean_text, "a<b\nc>d", "abcd"),
        (text.clean_text, "<b>Big</b> -- Deal!", "big   deal"),
        (text.clean_text, None, None),
        (text.parse_price, "USD 1,234 50", 1234.5),
        (text.parse_price, "12,50", 1250.0),
        (text.parse_price, "$12", None),
        (text.parse_price, None, None),
        (text.parse_price_spaced, "USD 1,234 50", None),
        (text.parse_price_spaced, "usd12 50", 12.5),
        (text.fix_name, "foo, null", "foo"),
        (text.fix_name, "null,foo", "foo"),
        (text.fix_description, "descriptiondescription x", "description x"),
        (text.domain, "http://u:p@h.com:80/x", "u:p@h.com:80"),
        (text.domain, "nourl", ""),
        (text.pretty_domain, "trade.com", "tracom"),
        (text.pretty_domain, "www.a.www.b", "a.b"),
        (text.file_category, "train_computers_shoes.txt", "shoes"),
        (text.file_category, "x", None),
        (text.dataset_of, "gs_train", "train"),
        (text.dataset_of, "gs_x", "test"),
        (text.dataset_of, "x", None),
        (text.word_count, "a  b ", 2),
        (text.word_count, None, 0),
        (text.url_of, "node http://a b", "http://a b"),
        (text.url_of, "node", None),
        (text.null_word, "null", None),
    ],
)
def test_text(one, f, given, expected):
    assert one(f(F.col("x")), x=given) == expected


def test_numbers_in_documents(one):
    assert one(text.number_text(F.col("x")), x=12345678.0) == "12345678.0"
    assert one(text.number_text(F.col("x")), x=1.5) == "1.5"
    assert one(text.joined_document([F.col("a"), F.col("b")], F.col("c").cast("double")), a="x", b=None, c=2.0) == "x 2.0"


def test_ngrams(one):
    assert one(text.ngrams(text.tokens(F.col("x"))), x="A cat sat on") == ["cat", "sat", "on", "cat sat", "sat on", "cat sat on"]
    assert one(text.ngrams(text.tokens(F.col("x"))), x=None) == []


@pytest.mark.parametrize(
    ("a", "b", "expected"), [(None, "x", 0.0), ("kitten", "sitting", 1 - 3 / 7), ("", "", 0.0), ("é", "e", 0.0), ("ab", "ab", 1.0)]
)
def test_levenshtein(one, a, b, expected):
    assert one(similarity.levenshtein_similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(expected)
    assert one(similarity.levenshtein_at_least(F.col("a"), F.col("b"), 0.5), a=a, b=b) == (expected >= 0.5)


def test_differences(one):
    f = similarity.percent_difference(F.col("a").cast("double"), F.col("b").cast("double"))
    assert one(f, a=100.0, b=80.0) == pytest.approx(0.2)
    assert one(f, a=None, b=80.0) == 0
    assert one(f, a=0.0, b=0.0) == 0
    assert one(f, a=-1.0, b=0.0) > 1e308
    assert one(similarity.exact_match(F.col("a"), F.col("b")), a=None, b=None) == 0
    assert one(similarity.exact_match(F.col("a"), F.col("b")), a="x", b="x") == 1


def test_vectors(one):
    a, b = F.col("a"), F.col("b")
    assert one(similarity.cosine_similarity(a, b), a=[1.0, 2.0], b=[2.0, 4.0]) == pytest.approx(1)
    assert one(similarity.cosine_similarity(a, b), a=[0.0, 0.0], b=[2.0, 4.0]) == 0
    assert one(similarity.cosine_distance_compat(a, b), a=[0.0, 0.0], b=[2.0, 4.0]) == 0
    # components that cancel out are a vector like any other
    assert one(similarity.cosine_similarity(a, b), a=[1.0, -1.0], b=[1.0, -1.0]) == pytest.approx(1)
    assert one(similarity.clipped_cosine(a, b), a=[1.0, 0.0], b=[-1.0, 0.0]) == 0
    assert one(similarity.abs_difference(a, b), a=[1.0, -1.0], b=[3.0, 1.0]) == [2.0, 2.0]


def test_json(spark):
    rows = [(1, '[{"/mpn":"[ x ]"},{"/sku":"[null]"},{"/mpn":"[y]"}]'), (2, "[]"), (3, None), (4, "broken")]
    df = spark.createDataFrame(rows, "id int, j string").select("id", jsonflat.maps(F.col("j")).alias("j"))
    got = {r["id"]: (r["mpn"], r["sku"]) for r in jsonflat.flatten(df, "j", ["mpn", "sku"]).collect()}
    assert got == {1: ("y", None), 2: (None, None), 3: (None, None), 4: (None, None)}
    m = spark.createDataFrame([([{"/schema.name/": "v"}],)], "m array<map<string,string>>")
    assert m.select(jsonflat.clean_keys(F.col("m"))).first()[0] == [{"schema_name": "v"}]


def test_gtin_and_parents(spark):
    df = spark.createDataFrame([("8", "13", None, "p")], "gtin8 string, gtin13 string, name string, parent_x_name string")
    assert jsonflat.coalesce_gtin(df).first()["gtin"] == "13"
    out = jsonflat.fill_from_parents(df)
    assert out.first()["name"] == "p"
    assert "parent_x_name" not in out.columns
    both = spark.createDataFrame([(None, None, "p")], "name string, x_name string, parent_x_name string")
    assert jsonflat.fill_from_parents(both).first().asDict() == {"name": "p", "x_name": "p"}


@pytest.mark.parametrize(
    ("word", "expected"),
    [
        ("consign", "consign"), ("consigned", "consign"), ("consistency", "consist"), ("consolation", "consol"), ("knightly", "knight"),
        ("knots", "knot"), ("generate", "generat"), ("generously", "generous"), ("skies", "sky"), ("dying", "die"), ("news", "news"),
        ("hopping", "hop"), ("hoping", "hope"), ("luxuriating", "luxuri"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("gaps", "gap"),
        ("by", "by"), ("say", "say"), ("cry", "cri"), ("bled", "bled"), ("agreed", "agre"), ("rational", "ration"), ("hopefulness", "hope"),
        ("electricity", "electr"), ("adjustment", "adjust"), ("controlling", "control"), ("proceed", "proceed"), ("communism", "communism"),
    ],
)
def test_stem(word, expected):
    assert stem.stem(word) == expected


def test_stem_text(spark):
    assert stem.stem_text("the cats are running and cannot stop") == "cat run stop"
    assert stem.stem_text(None) is None
    assert stem.stem_text("gonna cannot the  wanna runs") == "gon na wan na run"
    df = spark.createDataFrame([("the cats",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(stem.stemmed(F.col("x"))).collect()] == ["cat", None, ""]
    assert math.isclose(len(stem.STOP_WORDS), 179, abs_tol=5)


def test_shredded_json_of_any_depth_and_number_of_keys(spark):
    deep = '"[x]"'
    for i in reversed(range(30)):
        deep = f'{{"/k{i}": {deep}}}'
    many = "{" + ",".join(f'"n{i}": "[{i}]"' for i in range(7000)) + "}"
    rows = [(1, f'[{{"/deep": {deep}}}]'), (2, f'[{{"many": {many}}}]'), (3, None), (4, "[]"), (5, "broken"), (6, '[{"a.b": "[1]"}, {"a": {"b": "[2]"}}, {"a_b": "null"}, {"c": "{not json"}, {"d": {}}, {"e": null}]')]
    rows.append((7, '[{"o": [{"/s": "[1]"}, {"/s": "[3]", "t": "null"}, {"/s": "[2]"}]}, {"p": "[red]"}, {"q": "[]"}]'))
    df = spark.createDataFrame(rows, "id int, j string").select("id", jsonflat.maps(F.col("j")).alias("j"))
    out = jsonflat.shredded(df, ["j"])
    got = {r["id"]: r["j"] for r in out.collect()}
    assert got[1] == {"deep_" + "_".join(f"k{i}" for i in range(30)): "x"}
    assert got[2] == {f"many_n{i}": str(i) for i in range(7000)}
    assert got[3] == got[4] == got[5] == {}
    assert got[6] == {"a_b": "2", "c": "{not json"}
    assert got[7] == {"o_s": "3", "p": "red", "q": ""}
    counts = {r["name"]: r["n"] for r in jsonflat.key_counts(out, ["j"]).collect()}
    assert len(counts) == 1 + 7000 + 2 + 3 and set(counts.values()) == {1}


def test_clean_text_is_its_five_steps(spark):
    from functools import reduce

    texts = [None, "", "a en b", "x -en- y", " EN en enus en ", "a<b>c<d\ne>f", "<<a>>b", "Ünï çode_en_ 12", "it's a b--c..d", "a\n en\u2028enus z", "<\r>x", "one. Two! (three)", "a e'n b", "\t\ten\t\t"]
    steps = [("(?d)<.*?>", ""), (None, None), ("[^a-z0-9 ]{2,}", " "), ("[^a-z0-9 ]", ""), (r"\W(en|enus)\W", "")]
    plain = reduce(lambda x, s: F.lower(x) if s[0] is None else F.regexp_replace(x, *s), steps, F.col("t"))
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert df.filter(~text.clean_text(F.col("t")).eqNullSafe(plain)).count() == 0


def test_spread_uses_all_cores(spark):
    assert planning.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() >= 4
