"""One key with most rows, and bounds on what is gathered."""

import numpy as np

from mnemospark.llm import common, langid, quality, tokenfile

from .helpers import docs


def test_rows_of_one_id_are_dealt_to_several_shards(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_DOCS", 1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would all go to one task
    rows = spark.range(8000).selectExpr("if(id % 4 < 3, null, id) AS doc_id", "array(cast(id AS int)) AS a").selectExpr("doc_id", "unhex(lpad(hex(a[0]), 8, '0')) AS ids").repartition(4)
    manifest = tokenfile.write_shards(rows, 2).orderBy("shard").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.n_docs for r in manifest) == 8000 and max(r.n_docs for r in manifest) <= 1000
    tasks = {}
    for r in manifest:
        tasks[r.shard >> 32] = tasks.get(r.shard >> 32, 0) + r.n_docs
    assert len(tasks) > 1 and max(tasks.values()) < 6000  # the null id alone has 6000
    back = tokenfile.read_shards(tokenfile.write_shards(rows, 2)).collect()
    back.sort(key=lambda r: r.start)
    assert [r.doc_id for r in back] == [None] * 6000 + list(range(3, 8000, 4))
    assert [r.start for r in back] == list(range(0, 16000, 2))


def test_lookup_over_the_border_of_shards(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_DOCS", 3)
    rows = spark.createDataFrame([(k // 4, bytes([k, 0])) for k in range(20)], "doc_id long, ids binary").repartition(2)
    manifest = tokenfile.write_shards(rows, 2)
    got = sorted((r.doc_id, r.ids[0]) for r in tokenfile.lookup(manifest, spark.createDataFrame([(1,), (3,), (9,)], "doc_id long")).collect())
    assert got == [(k // 4, k) for k in range(20) if k // 4 in (1, 3)]


def test_a_repeated_labelled_id_is_gathered_once(spark, monkeypatch):
    table = docs(spark, [(k, f"good plain words here {k}") for k in range(1, 60, 2)] + [(k, "BAD!! ### $$$" * (k + 1)) for k in range(0, 60, 2)])
    many = table.unionByName(docs(spark, [(1, f"good text again {k}") for k in range(3000)] + [(2, "BAD!! ###")] * 3000))
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] * 3, "doc_id long, quality int")
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, **kw: seen.append(len(y)) or fit(x, y, **kw))
    quality.train(many, labels, sample=10)
    assert seen[0] <= 20


def test_quantile_is_that_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "BIN_ROWS", 20)
    monkeypatch.setattr(quality, "BINS", 8)
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=501), np.repeat([1.0, 2.0, 2.0, 5.0], 60), np.array([3.0]), rng.exponential(size=300) ** 4):
        table = spark.createDataFrame([(float(v),) for v in values], "s double").repartition(3)
        ordered = np.sort(values)
        for share in (0.0, 0.25, 0.5, 0.9, 1.0):
            place = min(max(int(np.ceil(share * len(values))) - 1, 0), len(values) - 1)
            want = (ordered[place] + ordered[min(place + 1, len(values) - 1)]) / 2
            assert abs(quality.quantile(table, "s", share) - want) < 1e-12
    assert quality.quantile(table.limit(0), "s", 0.5) == 0.0


def test_samples_are_never_short(spark):
    rows = spark.range(200).select("id")
    for n in (1, 3, 7, 150, 200, 500):
        assert common.lowest_hashed(rows, "id", n).count() == min(n, 200)


def test_tags_become_languages(spark):
    rows = spark.createDataFrame([("en",), ("en-US",), ("EN_gb",), (" English ",), ("Français",), ("zh-Hant-TW",), ("???",), ("",), (None,), ("klingonese",)], "tag string")
    assert [r[0] for r in rows.select(langid.primary_tag(rows.tag)).collect()] == ["en", "en", "en", "en", "fr", "zh", None, None, None, None]


def test_many_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    rows = [(k, "the quick brown fox", "en") for k in range(50)] + [(100 + k, "der braune fuchs", "de") for k in range(40)] + [(200 + k, "le renard brun", "fr") for k in range(30)] + [(300 + k, "xyz abc", f"{chr(97 + k)}q") for k in range(20)]
    names, table = langid.learn(spark.createDataFrame(rows, "id long, text string, declared string"))
    assert names == ["de", "en", "fr"] and table.shape == (3, langid.BUCKETS)
