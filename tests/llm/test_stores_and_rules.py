"""Resuming by fingerprint, schemas of a store, and one precedence of url rules."""

import time

import pytest

from plumbline.llm import sharding, token_output, url_filter
from plumbline.llm.common import shared_folder
from plumbline.llm.queries import VOCABULARY

# -- token output --------------------------------------------------------------


def texts(spark, n, word="w"):
    return spark.createDataFrame([(i, f"{word}{i} some text to cut " * 3) for i in range(n)], "doc_id long, text string")


def test_only_the_same_work_goes_on(spark):
    path = shared_folder(spark, "resume")
    options = {"length": 16, "rows_per_shard": 4, "waves": 2}
    first = token_output.write_shards(texts(spark, 30), path, VOCABULARY, **options)
    rows = sorted(map(str, first.slots().collect()))
    for other in ({"length": 32}, {"key": 7}, {"rows_per_shard": 8}, {"end_token": 5}, {"waves": 3}):
        with pytest.raises(ValueError, match=f"other work: .*{next(iter(other))}"):
            token_output.write_shards(texts(spark, 30), path, VOCABULARY, **options | other)
    for docs in (texts(spark, 29), texts(spark, 30, "x"), texts(spark, 30).selectExpr("doc_id + 1 AS doc_id", "text"), texts(spark, 30).selectExpr("cast(doc_id AS int) AS doc_id", "text")):
        with pytest.raises(ValueError, match="of other work"):
            token_output.write_shards(docs, path, VOCABULARY, **options)
    again = token_output.write_shards(texts(spark, 30).repartition(3), path, VOCABULARY, **options)  # in another order
    assert again.total == first.total and sorted(map(str, again.slots().collect())) == rows


def test_what_was_not_ended_goes_on(spark):
    path = shared_folder(spark, "resume")
    options = {"length": 16, "rows_per_shard": 4, "waves": 3}
    whole = token_output.write_shards(texts(spark, 30), path, VOCABULARY, **options)
    rows = sorted(map(str, whole.slots().collect()))
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shards/wave=1/_SUCCESS"), False)
    assert sorted(map(str, token_output.write_shards(texts(spark, 30), path, VOCABULARY, **options).slots().collect())) == rows
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/fingerprint"), True)
    with pytest.raises(ValueError, match="unknown origin"):
        token_output.write_shards(texts(spark, 30), path, VOCABULARY, **options)


# -- shards --------------------------------------------------------------------


def test_columns_and_values_outlive_three_compactions(spark):
    store = sharding.ShardStore(spark, shared_folder(spark, "schema"), target_bytes=1 << 20)
    arrivals = [
        ("a int, b string", [(1, "x"), (2, None)]),
        ("a int", [(3,)]),
        ("a bigint, C double, f int", [(1 << 40, 0.5, 7)]),
        ("b string, f float", [("y", None)]),
        ("A smallint, c float", [(9, 0.25)]),
        ("d array<string>, path string, run int", [(["p", None], "q", 4)]),
    ]
    expected = []
    for i, (schema, rows) in enumerate(arrivals[:3]):
        store.append(spark.createDataFrame(rows, schema))
        expected += [dict(zip([f.split()[0].lower() for f in schema.split(", ")], r)) for r in rows]
    assert store.schema().simpleString() == "struct<a:bigint,b:string,C:double,f:int>"

    def held(version=None):
        return sorted(str({k.lower(): v for k, v in r.asDict().items() if v is not None}) for r in store.read(version).collect())

    def wanted():
        return sorted(str({k: r[k] for k in (c.lower() for c in store.read().columns) if r.get(k) is not None}) for r in expected)

    assert held() == wanted()
    store.compact()
    assert held() == wanted() and store.manifest().count() == 1
    with pytest.raises(TypeError, match="f: the store has int, the arrivals float"):
        store.append(spark.createDataFrame(arrivals[3][1], arrivals[3][0]))
    with pytest.raises(TypeError, match="b: the store has string, the arrivals int"):
        store.append(spark.createDataFrame([(5,)], "b int"))
    version = store.versions()[-1]
    assert held() == wanted()
    for schema, rows in arrivals[4:]:
        store.append(spark.createDataFrame(rows, schema))
        expected += [dict(zip([f.split()[0].lower() for f in schema.split(", ")], r)) for r in rows]
        store.compact()
        assert held() == wanted()
    assert store.schema(version).names == ["a", "b", "C", "f"] and store.read().columns == ["a", "b", "C", "f", "d", "path", "run"]
    store.append(spark.createDataFrame([], "z int"))
    assert store.read().columns[-1] == "z" and held() == wanted()


def test_a_merge_keeps_the_columns_that_came_meanwhile(spark, monkeypatch):
    path = shared_folder(spark, "schema")
    store, other = (sharding.ShardStore(spark, path, target_bytes=1 << 20) for _ in range(2))
    for i in range(2):
        store.append(spark.createDataFrame([(i,)], "a int"))
    listed, late = sharding.ShardStore._listed, []

    def slow(self, *args):
        if self is store and not late:
            late.append(other.append(spark.createDataFrame([("new",)], "b string")))
        return listed(self, *args)

    monkeypatch.setattr(sharding.ShardStore, "_listed", slow)
    store.compact()
    assert late and sorted(map(tuple, store.read().select("a", "b").collect()), key=str) == [(0, None), (1, None), (None, "new")]
    # An append whose columns don't go with those that came meanwhile commits nothing.
    late.clear()

    def against(self, *args):
        if self is store and not late:
            late.append(other.append(spark.createDataFrame([(1.5,)], "c double")))
        return listed(self, *args)

    monkeypatch.setattr(sharding.ShardStore, "_listed", against)
    with pytest.raises(TypeError, match="c: the store has double, the arrivals string"):
        store.append(spark.createDataFrame([("s",)], "c string"))
    assert store.read().count() == 4


# -- url rules -----------------------------------------------------------------


def fits(rule, host, path):
    return bool(host) and (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)


def verdicts(urls, rules):
    out = []
    for i, url in urls:
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = rest.split("#")[0].split("?")[0].partition("/")[0]
        path = rest.split("#")[0].split("?")[0][len(host) :]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        best = max(((len(r.text), r.text, r.verdict) for r in rules if fits(r, host, path)), default=(0, None, "allow"))
        out.append((i, host, path, best[1], best[2]))
    return sorted(out, key=repr)


def test_both_ways_have_one_precedence(spark):
    rules = [("block", "ééé.com/"), ("allow", "com/abcde"), ("block", "com/abcd"), ("allow", "com/abcd"), ("allow", "net/é"), ("block", "net/z"), ("block", "x.net/"), ("allow", "net/x/"), ("block", "a.b.c.d.e/p"), ("allow", "e/"), ("block", "日本.jp/ニ"), ("allow", "jp/")]
    rules = [url_filter.Rule.parse(*r) for r in rules]
    hosts = ["ééé.com", "www.ééé.com", "com", "x.net", "y.x.net", "net", "a.b.c.d.e", "q.a.b.c.d.e", "b.c.d.e", "日本.jp", "e", ".com", "com.", "a..com", ""]
    paths = ["", "/", "/abcdef", "/abcd", "/é", "/z", "/x/", "/p", "/ニュース", "/abc?x=/abcde", "#/"]
    urls = list(enumerate([f"http://{h}{p}" for h in hosts for p in paths] + [None, "com/abcde", "HTTP://WWW.ÉÉÉ.COM/ABC", "x://://com/abcde"]))
    df = spark.createDataFrame(urls, "page_id long, url string").repartition(3)
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    wanted = verdicts(urls, rules)
    for found in (url_filter.apply_rules(df, rules), url_filter.apply_rules(df, rules[::-1]), url_filter.join_rules(df, table), url_filter.apply_rule_table(df, table)):
        assert sorted(map(tuple, found.collect()), key=repr) == wanted
    nothing = table.limit(0)
    assert {r.verdict for r in url_filter.join_rules(df, nothing).collect()} == {"allow"}


def test_a_long_host_costs_what_the_rules_ask_for(spark):
    rules = [url_filter.Rule.parse("block", "a.bad.org/x"), url_filter.Rule.parse("allow", "org/")]
    shapes = sorted({(3, 2), (1, 1)})
    host = "l." * 500_000 + "a.bad.org"
    began = time.monotonic()
    assert url_filter.candidate_keys(host, "/x" * 500_000, shapes) == ["org/", "a.bad.org/x"]
    assert time.monotonic() - began < 0.1
    df = spark.createDataFrame([(1, f"http://{host}/x{'/y' * 300_000}"), (2, "http://" + "l." * 300_000 + "org/")], "page_id long, url string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    for found in (url_filter.apply_rules(df, rules), url_filter.join_rules(df, table)):
        assert [(r.page_id, r.rule, r.verdict) for r in found.orderBy("page_id").collect()] == [(1, "a.bad.org/x", "block"), (2, "org/", "allow")]


def test_a_worker_maps_an_index_once():
    class Sent:
        reads = 0

        @property
        def value(self):
            self.reads += 1
            return url_filter.build_index([url_filter.Rule.parse("block", "a/")])

    sent = Sent()
    assert url_filter._index("one", sent) is url_filter._index("one", sent) and sent.reads == 1
    for i in range(url_filter.KEPT_MAPS):
        url_filter._index(str(i), sent)
    assert len(url_filter._maps) == url_filter.KEPT_MAPS and "one" not in url_filter._maps
