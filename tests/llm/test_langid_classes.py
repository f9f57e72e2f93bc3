from mnemospark.llm import langid

FIELDS = "id long, text string, declared string"


def test_rare_languages_are_classes(spark):
    rows = [(k, "the quick brown fox", "en") for k in range(400)] + [(1000 + k, "der schnelle braune fuchs", "de") for k in range(3)] + [(2000, "il gatto nero", "it")]
    names, table = langid.learn(spark.createDataFrame(rows, FIELDS).repartition(3), sample=4)
    assert names == ["de", "en", "it"] and table.shape == (3, langid.BUCKETS)


def test_sample_has_its_bound_for_each_language(spark):
    rows = spark.createDataFrame([(k, "x", "en" if k % 10 else "fr") for k in range(3000)], FIELDS)
    got = langid.lowest_of_each(rows.select("id", "declared"), 50).collect()
    place = dict(rows.selectExpr("id", "pmod(xxhash64(id), 1099511627776) AS p").collect())
    for name in ("en", "fr"):
        ids = sorted((k for k in range(3000) if (name == "en") == bool(k % 10)), key=lambda k: (place[k], k))[:50]
        assert sorted(r.id for r in got if r.declared == name) == sorted(ids)
