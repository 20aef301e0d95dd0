"""Extraction that keeps calls in flight and makes each durable, and a cache that survives damage."""

import glob
import json
import os
import threading
import time
from types import SimpleNamespace

import pandas as pd
import pytest

from plumbline.config import ExtractionSettings
from plumbline.operators import graph
from plumbline.operators.cache import GraphCache, Portions, line
from plumbline.sources.store import Store


def backend(folder, wait=0.0, die_at=None):
    """Notes each call that begins and ends; dies once, without a word, at the given one."""

    class Backend:
        def generate(self, input_data, cluster, chunk_size=None):
            with open(f"{folder}/begun", "a") as f:
                f.write(input_data + "\n")
            if die_at is not None and not os.path.exists(f"{folder}/died") and len(open(f"{folder}/begun").readlines()) >= die_at:
                open(f"{folder}/died", "w").close()
                os._exit(9)
            time.sleep(wait)
            with open(f"{folder}/ended", "a") as f:
                f.write(input_data + "\n")
            return SimpleNamespace(entities={input_data}, relations={(input_data, "is", "x")})

    return Backend


def calls(folder, which="ended"):
    path = f"{folder}/{which}"
    return sorted(open(path).read().split("\n")[:-1]) if os.path.exists(path) else []


def texts(spark, n):
    return spark.createDataFrame([(f"o{i}", f"text {i}") for i in range(n)], "owner string, text string")


def test_a_window_of_calls_in_flight():
    now, most, lock = 0, 0, threading.Lock()

    def work(x):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.01)
        with lock:
            now -= 1
        return x

    taken = []
    items = (taken.append(i) or i for i in range(40))
    results = graph.in_flight(items, work, 5)
    next(results)
    assert len(taken) <= 10  # no more are begun than the window lets
    assert sorted([0, *results])[1:] and len(taken) == 40 and most == 5


def test_calls_in_flight_are_as_many_times_faster(tmp_path):
    pairs = [(str(i), f"t{i}") for i in range(48)]
    took = {}
    for n in (1, 8):
        (tmp_path / str(n)).mkdir()
        extractor = graph.BackendExtractor(backend(tmp_path / str(n), wait=0.03), ExtractionSettings(concurrency=n))
        began = time.monotonic()
        rows = list(extractor.rows(pairs))
        took[n] = time.monotonic() - began
        assert sorted(r["cache_key"] for r in rows) == sorted(k for k, _ in pairs)
    assert took[1] > 4 * took[8]


def test_a_task_that_runs_again_repeats_no_finished_call(tmp_path):
    pairs = [(str(i), f"t{i}") for i in range(10)]
    quick = ExtractionSettings(concurrency=1)
    first = graph.BackendExtractor(backend(tmp_path), quick).rows(pairs, Portions(str(tmp_path / "cache"), "run", 0))
    for _ in range(4):
        next(first)
    first.close()  # the worker is gone: 4 or 5 calls had ended
    before = calls(tmp_path)
    again = list(graph.BackendExtractor(backend(tmp_path), quick).rows(pairs, Portions(str(tmp_path / "cache"), "run", 0)))
    assert sorted(r["cache_key"] for r in again) == sorted(k for k, _ in pairs)
    assert len(before) in (4, 5) and len(calls(tmp_path)) - len(set(calls(tmp_path))) <= 1
    third = list(graph.BackendExtractor(backend(tmp_path), quick).rows(pairs, Portions(str(tmp_path / "cache"), "run", 0)))
    assert sorted(r["cache_key"] for r in third) == sorted(k for k, _ in pairs) and len(calls(tmp_path)) <= 11


def test_a_job_that_dies_loses_the_calls_in_flight_only(spark, tmp_path):
    settings = ExtractionSettings(concurrency=1, partitions=1)
    cache = str(tmp_path / "cache")
    with pytest.raises(Exception, match="(?i)worker|crash|exit|job"):
        graph.extract(texts(spark, 12), graph.BackendExtractor(backend(tmp_path, die_at=6), settings), settings, cache)
    paid = calls(tmp_path)
    assert len(paid) == 5
    graphs, log = graph.extract(texts(spark, 12), graph.BackendExtractor(backend(tmp_path), settings), settings, cache)
    assert {r.owner: r.entities for r in graphs.collect()} == {f"o{i}": [f"text {i}"] for i in range(12)}
    assert calls(tmp_path) == sorted(f"text {i}" for i in range(12))  # each ended once
    assert log.filter("cached").count() == 5
    again, log = graph.extract(texts(spark, 12), graph.BackendExtractor(backend(tmp_path), settings), settings, cache)
    assert again.count() == 12 and log.filter("not cached").count() == 0 and len(calls(tmp_path)) == 12


def test_damaged_files_are_misses_and_put_aside(spark, tmp_path):
    settings = ExtractionSettings(partitions=2)
    path = str(tmp_path / "cache")
    run = lambda n: graph.extract(texts(spark, n), graph.BackendExtractor(backend(tmp_path), settings), settings, path)
    graphs, _ = run(8)
    assert graphs.count() == 8
    files = sorted(glob.glob(f"{path}/log/*/*/*.jsonl"))
    assert len(files) == 8
    with open(files[0], "r+b") as f:
        f.write(b"\xff\x00\xfe{]")
    with open(files[1], "a") as f:  # a line of another writer that was cut off
        f.write('{"cache_key": "abc", "bo')
    good = open(files[2]).read()
    with open(files[2], "w") as f:  # still JSON, with another text
        f.write(good.replace("text", "test"))
    for crc in glob.glob(f"{path}/log/*/*/.*.crc"):
        os.remove(crc)
    cache = GraphCache(spark, path, graph.STORED)
    assert {os.path.basename(r.file): r.n_damaged for r in cache.damaged().collect()} == {os.path.basename(f): 1 for f in files[:3]}
    graphs, log = run(8)
    assert graphs.count() == 8 and log.filter("not cached").count() == 2 and len(calls(tmp_path)) == 10
    cache.compact()
    assert sorted(x.rpartition("-")[2] for x in Store(spark, path).files("quarantine")) == sorted(os.path.basename(f) for f in files[:3])
    assert Store(spark, path).files("log") == [] and cache.damaged().count() == 0
    assert graph.read_cache(spark, path).count() == 8
    graphs, log = run(9)
    assert {r.owner: r.entities for r in graphs.collect()} == {f"o{i}": [f"text {i}"] for i in range(9)}
    assert log.filter("not cached").count() == 1
    base = sorted(f for f in glob.glob(f"{path}/base/0/part-*") if os.path.getsize(f))[0]
    with open(base, "w") as f:
        f.write("no line\n")
    for crc in glob.glob(f"{path}/base/0/.*.crc"):
        os.remove(crc)
    lost = 9 - graph.read_cache(spark, path).count()
    assert 0 < lost <= 8
    assert cache.compact() == 1 and graph.read_cache(spark, path).count() == 9 - lost
    assert any("part-" in f for f in Store(spark, path).files("quarantine/1"))


def test_two_writers_leave_one_row_a_key(spark, tmp_path):
    path = str(tmp_path / "cache")
    row = lambda key, said, at, error=None: line(key, json.dumps({"entities": [said], "relations": [], "error": error, "seconds": 1.0, "finished": at, "prompt_tokens": 0, "completion_tokens": 0, "cost_usd": 0.0, "run": "r"}))
    Portions(path, "r1", 0).commit([row("a", "first", 1.0), row("b", "only", 5.0)])
    Portions(path, "r2", 0).commit([row("a", "second", 2.0), row("c", "", 1.0, "failed")])
    Portions(path, "r2", 1).commit([row("a", "first", 1.0)])
    cache = GraphCache(spark, path, graph.STORED)
    for _ in range(2):
        assert {r.cache_key: r.entities for r in graph.read_cache(spark, path).collect()} == {"a": ["first"], "b": ["only"]}
        assert graph.read_cache(spark, path).count() == 2
        cache.compact()
    # A run that goes on while others compact adds to what is there.
    Portions(path, "r3", 0).commit([row("d", "late", 9.0)])
    assert {r.cache_key for r in graph.read_cache(spark, path).collect()} == {"a", "b", "d"}


def test_other_extractors_are_cached_by_stage(spark, tmp_path):
    path = str(tmp_path / "cache")
    one, log = graph.extract(texts(spark, 5), graph.OfflineExtractor(), None, path)
    assert one.count() == 5 and log.filter("cached").count() == 0
    two, log = graph.extract(texts(spark, 7), graph.OfflineExtractor(), None, path)
    assert sorted(map(str, two.filter("owner < 'o5'").collect())) == sorted(map(str, one.collect()))
    assert log.filter("cached").count() == 5 and log.filter("not cached").count() == 2


def test_store(spark, tmp_path):
    store = Store(spark, f"file:{tmp_path}/a b")
    assert store.files() == [] and store.names("x") == []
    store.write_text("x/one.txt", "first")
    store.write_text("x/one.txt", "ünd")
    assert store.files() == ["x/one.txt"] and (tmp_path / "a b/x/one.txt").read_text() == "ünd"
    store.move("x/one.txt", "y/two.txt")
    store.move("x/gone.txt", "y/three.txt")
    assert store.files() == ["y/two.txt"] and store.names() == ["x", "y"]
    store.delete("y")
    assert store.files() == []


def test_rows_have_the_columns_of_the_cache():
    made = list(graph.BackendExtractor(lambda: SimpleNamespace(generate=lambda **_: 1 / 0), ExtractionSettings(max_retries=2, backoff_base_s=0)).rows([("k", "t")]))
    assert list(pd.DataFrame(made, columns=graph.COLUMNS).columns) == list(made[0]) or set(made[0]) == set(graph.COLUMNS)
    assert made[0]["error"].startswith("ZeroDivisionError")
