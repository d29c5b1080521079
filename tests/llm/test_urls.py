import re

import numpy as np
from pyspark.sql import functions as F

from walkmoments.llm import urls


def brute(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fits)[1:]) if fits else (None, None)))


ODD = [None, "", "nothing", "http://", "http://com/en/1", "x://A.Example.COM/en/77?x=1", "http://example.com/en/8#a", "https://xexample.com/en/7", "ftp://É.net/de/8/x",
       "http://example.net/de/8", "http://example.net?u=http://y.org/es/", "http://b.org/es/\n2", "http://a.com//en/", "http://h.net:80/de/9", "http://h.NET/de/9"]


def test_rules_and_verdicts(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(ODD)] + [(None, ODD[5], "h", "r")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = urls.judge(pages).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for i, u in enumerate(ODD):
        host, path, rule, verdict = brute(u)
        r = by_id[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert urls.judge(pages.limit(0)).count() == 0


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    for r in pages.select("page_id", "url").collect():
        host, path, rule, verdict = brute(r.url)
        g = got.pop(r.page_id)
        assert (g.host, g.path, g.rule) == (host, path, rule)
        assert verdict in (None, g.verdict)
    assert not got


def test_trees_on_held_out_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    name, verdict = urls.decide(urls.RULES)
    rows = urls.split_url(pages.select("page_id", "url")).withColumn("v", verdict).filter("v is not null").withColumn("__u_label", (F.col("v") == "block").cast("int"))
    held = F.pmod(F.xxhash64("page_id"), F.lit(4)) == 0
    model = urls.fit(rows.filter(~held))
    assert model.trees
    scored = model.with_features(rows.filter(held), F.col("url")).select("__u_features", model.log_odds().alias("s"), "__u_label").collect()
    y, s = np.array([r[2] for r in scored]), np.array([r.s for r in scored])
    assert ((s > 0) == y).mean() > 0.85 > max(y.mean(), 1 - y.mean()) - 0.05
    x = np.array([tuple(r[0]) for r in scored])
    own = model.bias + sum(t.predict(x) for t in model.trees)
    assert np.allclose(own, s)


def test_rare_suffixes_keep_their_rates(spark):
    hosts = [(i, f"http://a.h{i % 700}.net{i % 7}/x/{i}", int(i % 700 < 350)) for i in range(7000)]
    df = urls.split_url(spark.createDataFrame(hosts, "page_id long, url string, __u_label int"))
    model = urls.fit(df)
    rows = model.with_features(df, F.col("url")).select("page_id", "__u_label", "__u_features.last_labels").collect()
    assert len(rows) == 7000 and len({r.page_id for r in rows}) == 7000
    assert all(abs(r.last_labels - (10 * r[1] + 4 * 0.5) / 14) < 1e-12 for r in rows)
    other = urls.split_url(spark.createDataFrame([(1, "http://q.h3.net3/y/1"), (2, "http://q.h353.net3/y/1"), (3, "http://q.never/y")], "page_id long, url string"))
    seen = {r[0]: r[1] for r in model.with_features(other, F.col("url")).select("page_id", "__u_features.last_labels").collect()}
    assert seen[1] > 0.8 and seen[2] < 0.2 and seen[3] == 0.5


def test_a_hot_suffix_without_labels_is_not_joined_by_key(spark):
    known = [(i, f"http://a.h{i % 700}.net{i % 7}/x/{i}", int(i % 700 < 350)) for i in range(7000)]
    model = urls.fit(urls.split_url(spark.createDataFrame(known, "page_id long, url string, __u_label int")))
    assert model.rare is not None
    hot = [(i, f"http://w{i}.hot.never/z/{i}") for i in range(9000)] + [(9000 + i, f"http://a.h{i}.net{i % 7}/x/q") for i in range(700)]
    hot += [(20000 + i, f"http://b{i}.h3.net3/x/{i}") for i in range(300)] + [(None, None), (30000, "http://" + "l" * 300_000 + ".long/" + "p/" * 100_000)]
    df = urls.split_url(spark.createDataFrame(hot, "page_id long, url string"))
    found = model.hot_rates(df)
    assert found["last_label"]["never"] is None and found["last_labels"]["hot.never"] is None
    assert abs(found["last_labels"]["h3.net3"] - 12 / 14) < 1e-12  # rare among labels, hot here
    assert all(len(v) <= urls.SUFFIXES for v in found.values())
    got = {r.page_id: r[1] for r in model.with_features(df, F.col("url")).select("page_id", "__u_features.last_labels").collect()}
    assert len(got) == len(hot) and got[5] == 0.5 and got[30000] == 0.5 and got[None] == 0.5
    assert all(abs(got[9000 + i] - (12 / 14 if i < 350 else 2 / 14)) < 1e-12 for i in range(700))
    assert all(abs(got[20000 + i] - 12 / 14) < 1e-12 for i in range(300))
