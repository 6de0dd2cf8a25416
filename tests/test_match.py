"""Golden values and properties of matching and lookup."""

import pytest

from quillmatch.functions import text as tx
from quillmatch.operators import lookup as lk
from quillmatch.operators import block_search
from quillmatch.operators.match import MatchIndex, fit, fit_stored, top_k
from pyspark.sql import functions as F

BRANDED = [
    (1, "Alphacet 500 Tablet", "10.5", "FALSE", "Maker A", "allopathy", "strip of 15 tablets", "Paracetamol (500mg)", ""),
    (2, "Alphacet 650 Tablet", "14", "FALSE", "Maker A", "allopathy", "strip of 15 tablets", "Paracetamol (650mg)", ""),
    (3, "Betamox Clav 625 Tablet", "120", "FALSE", "Maker B", "allopathy", "strip of 10 tablets", "Amoxycillin (500mg)", "Clavulanic Acid (125mg)"),
    (4, "Gammapan 40 Tablet", "60", "TRUE", "Maker C", "allopathy", "strip of 10 tablets", "Pantoprazole (40mg)", ""),
    (5, "Deltacough Syrup", "85", "FALSE", "Maker D", "allopathy", "bottle of 100 ml", "Dextromethorphan (10mg)", ""),
]
GENERICS = [
    (1, "Paracetamol Tablets IP 500mg", "10's", "7", "Analgesic"),
    (2, "Paracetamol Tablets IP 650mg", "15's", "15", "Analgesic"),
    (3, "Amoxycillin and Potassium Clavulanate Tablets IP", "10's", "70", "Antibiotic"),
    (4, "Pantoprazole Gastro-resistant Tablets IP 40mg", "10's", "22", "Gastro"),
    (5, "Dextromethorphan Syrup", "100 ml", "33", "Respiratory"),
]
MASTER = [
    (1, "Alphacet Tab", "alphacet", "paracetamol", "10.5", "12", "ok", "0.875"),
    (2, "Betamox-Clav", "betamox clav", "amoxicillin + clavulanic acid", "120", "100", "overpriced", "1.2"),
    (3, "Gammapan", "gammapan", "pantoprazole", "60", "", "missing", ""),
    (4, "Deltacough", "deltacough", "dextromethorphan", "85", "", "missing", ""),
]


@pytest.fixture(scope="module")
def parts(spark):
    b = spark.createDataFrame(BRANDED, "doc_id long, name string, `price(₹)` string, Is_discontinued string, manufacturer_name string, type string, pack_size_label string, short_composition1 string, short_composition2 string")
    g = spark.createDataFrame(GENERICS, "doc_id long, `Generic Name` string, `Unit Size` string, MRP string, `Group Name` string")
    m = spark.createDataFrame(MASTER, "doc_id long, brand_raw string, brand_clean string, canonical_inn string, product_price string, nppa_price string, price_flag string, ratio_market_to_nppa string")
    return lk.branded(b), lk.generics(g), lk.master(m)


def ask(spark, part, text, k, name):
    got = part.search(spark.createDataFrame([(1, text)], "qid long, query string"), k).orderBy("rank").collect()
    return [(r[name], r["match_score"]) for r in got]


def test_golden_branded(spark, parts):
    b = parts[0]
    assert ask(spark, b, "alphacet", 3, "name") == [("Alphacet 650 Tablet", 0.743), ("Alphacet 500 Tablet", 0.738)]
    assert ask(spark, b, "Alphacet 650", 3, "name") == [("Alphacet 650 Tablet", 0.901), ("Alphacet 500 Tablet", 0.638)]
    assert ask(spark, b, "AlphacetTablets500mg", 3, "name") == [("Alphacet 500 Tablet", 0.819), ("Alphacet 650 Tablet", 0.742), ("Betamox Clav 625 Tablet", 0.160)]
    for nothing in ("zzz", "", "अल्फा", None):
        assert ask(spark, b, nothing, 3, "name") == []


def test_golden_generics_and_master(spark, parts):
    assert ask(spark, parts[1], "Paracetamol (500mg)", 5, "generic_name") == [("Paracetamol Tablets IP 500mg", 0.888), ("Paracetamol Tablets IP 650mg", 0.658), ("Pantoprazole Gastro-resistant Tablets IP 40mg", 0.104)]
    assert ask(spark, parts[2], "Betamox Clav 625", 3, "brand_name") == [("betamox clav", 1.0)]


def test_lookup(spark, parts):
    asked = spark.createDataFrame([(1, "Betamox"), (2, "zzz")], "qid long, query string")
    got = {r["qid"]: r for r in lk.lookup(asked, *parts).collect()}
    assert [g["generic_name"] for g in got[1]["generic_alternatives"]][0] == "Amoxycillin and Potassium Clavulanate Tablets IP"
    assert got[1]["price_info"]["nppa_ceiling_price"] == "100" and got[1]["branded_matches"][0]["match_score"] == 0.66
    assert got[2]["branded_matches"] == [] and got[2]["generic_alternatives"] == [] and got[2]["price_info"] is None
    alt = lk.lookup(asked, *parts).select(F.explode(lk.alternatives(F.col("generic_alternatives"))).alias("a")).select("a.*").first()
    assert alt.asDict() == {"name": "Amoxycillin and Potassium Clavulanate Tablets IP", "price": "₹70 for 10's", "source": "jan_aushadhi", "drug_code": ""}


def test_missing_headers_are_a_choice_of_the_plan(spark):
    df = spark.createDataFrame([(1, "x", "5")], "doc_id long, name string, price string")
    row = lk.project(df, lk.BRANDED).first()
    assert (row["price"], row["is_discontinued"], row["manufacturer"]) == ("5", "FALSE", "")


def test_properties(spark, tmp_path):
    rows = [(i, f"name {i % 7} of {'xyz'[i % 3]}") for i in range(60)]
    corpus = spark.createDataFrame(rows, "id long, t string")
    index = fit(corpus, "id", "t", keep=4)
    asked = spark.createDataFrame([(i, t) for i, t in rows[:21]], "qid long, query string")
    got = top_k(index, asked, 4).collect()
    for q, t in rows[:21]:
        own = sorted((r["rank"], r["doc_id"], r["match_score"]) for r in got if r["qid"] == q)
        same = [i for i, x in rows if x == t]
        assert [d for _, d, _ in own][: len(same)] == same[:4] and own[0][2] == 1.0 and len(own) <= 4
    index.save(str(tmp_path))
    again = top_k(MatchIndex.load(spark, str(tmp_path)), asked, 4).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    noisy = top_k(index, asked.withColumn("query", F.concat("query", F.lit(" qqqq wwww"))), 1).collect()
    plain = {r["qid"]: r["match_score"] for r in got if r["rank"] == 1}
    assert all(r["match_score"] == plain[r["qid"]] for r in noisy)  # unknown n-grams do not count
    with pytest.raises(ValueError):
        top_k(index, asked, 5)


def test_plan_broadcasts_only_the_vocabulary(spark, parts):
    asked = spark.createDataFrame([(1, "a")], "qid long, query string")
    plan = parts[0].search(asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" in plan  # the row count is the one cross join


def test_stacked_catalogues_answer_as_each_alone(spark, parts):
    b, g, m = (spark.createDataFrame(rows) for rows in (BRANDED, GENERICS, MASTER))
    b = b.toDF("doc_id", "name", "price(₹)", "Is_discontinued", "manufacturer_name", "type", "pack_size_label", "short_composition1", "short_composition2")
    g = g.toDF("doc_id", "Generic Name", "Unit Size", "MRP", "Group Name")
    m = m.toDF("doc_id", "brand_raw", "brand_clean", "canonical_inn", "product_price", "nppa_price", "price_flag", "ratio_market_to_nppa")
    asked = spark.createDataFrame([(1, "Betamox"), (2, "zzz"), (3, "alphacet 650"), (4, None)], "qid long, query string")
    alone = {r["qid"]: r for r in lk.lookup(asked, *parts).collect()}
    for stored in (False, True):
        together = lk.catalogues(stored=stored, branded=b, generics=g, master=m)
        assert {r["qid"]: r for r in lk.lookup(asked, *together).collect()} == alone


def test_a_saved_index_is_read_without_an_exchange(spark, tmp_path):
    corpus = spark.createDataFrame([(i, f"name {i % 7} of {'xyz'[i % 3]}") for i in range(60)], "id long, t string")
    made = fit_stored({"": (corpus, "id", "t")}, str(tmp_path / "index"), keep=4, buckets=4)
    asked = spark.createDataFrame([(1, "name 3 of y"), (2, "nam")], "qid long, query string")
    assert sorted(map(str, top_k(made, asked, 4).collect())) == sorted(map(str, top_k(fit(corpus, "id", "t", 4), asked, 4).collect()))
    unit = spark.createDataFrame([("", "na", 1.0)], "cat string, gram string, wq double").hint("merge")
    plan = unit.join(made.postings, ["cat", "gram"])._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1  # the queries' own
    again = MatchIndex.load(spark, str(tmp_path / "index"))
    assert again.keep == 4 and again.postings.count() == made.postings.count()


def test_documents_in_blocks_as_by_postings(spark, monkeypatch, tmp_path):
    words = ["alpha", "beta", "a", "gamma9", "de"]
    texts = [(i, " ".join(words[(i * k) % 5] for k in range(1, i % 9 + 1))) for i in range(80)] + [(100, None), (101, "..."), (102, "Été alpha"), (103, "beta " * 3000)]
    corpus = spark.createDataFrame(texts, "id long, t string")
    asked = spark.createDataFrame([(i, t) for i, t in texts[:30]] + [(200, "alpha zzqq"), (201, ""), (202, None)], "qid long, query string")
    want = sorted(map(str, top_k(fit(corpus, "id", "t", 5), asked, 5).collect()))
    index = block_search.fit(corpus, "id", "t", path=str(tmp_path / "docs"))
    assert sorted(map(str, block_search.top_k(index, asked, 5).collect())) == want
    monkeypatch.setattr(block_search, "PART", 100)  # several passes,
    monkeypatch.setattr(block_search, "CELLS", 200)  # each of several blocks
    assert sorted(map(str, block_search.top_k(block_search.DocumentIndex.load(spark, str(tmp_path / "docs")), asked, 5).collect())) == want


def test_counts_of_very_long_texts_in_steps(monkeypatch):
    texts = ["ab cd a", "", "xyz " * 50, "b"]
    whole = [x.tolist() for x in block_search.counted(texts)]
    monkeypatch.setattr(block_search, "BATCH_CHARS", 7)
    assert [x.tolist() for x in block_search.counted(texts)] == whole


def test_text_functions(spark):
    one = lambda c, v, kind="string": spark.createDataFrame([(v,)], f"v {kind}").select(c(F.col("v")).alias("x")).first()["x"]
    for raw, clean in [("Paracetamol Tablets IP 500 mg", "ParacetamolTabletsIP500mg"), ("a b c", "a"), ("x | y", ""), ("Dolo-650 { tab }", "Dolo650 tab"), ("foo, bar", "foo, bar"), (None, "")]:
        assert one(tx.clean_ocr, raw) == clean
    assert sorted(one(tx.grams, "mg")) == sorted([" m", "mg", "g ", " mg", "mg ", " mg "]) and sorted(one(tx.grams, "a")) == sorted([" a", "a ", " a "])
    assert [one(tx.round3, v, "double") for v in (0.0625, 0.1225, 0.1235)] == [0.062, 0.122, 0.124]
    assert [one(lambda c: tx.leading_int(c, 20), v) for v in ("12abc", "-3", "1.9", "abc", "0", None)] == [12, -3, 1, 20, 20, 20]
    assert one(lambda c: tx.chunks(c, 4), "abcdefghij") == ["abcd", "efgh", "ij"] and one(tx.chunks, "") == []
    assert one(tx.extension, "a.b/c.PNG") == ".png" and one(tx.percent, 0.257, "double") == "26%" and one(tx.percent, 0.0, "double") is None
