"""Bad lines, writers on the run's own store, vectors that are embedded once, and graphs of dialogs."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.config import EvalSettings, Settings
from plumbline.functions.embed import ModelEmbedder, StoredEmbedder
from plumbline.operators import dialog, graph
from plumbline.plans import pipeline
from plumbline.sources import records, sinks
from plumbline.sources.store import Store


@pytest.fixture
def folder(tmp_path):
    sources = [{"source_id": f"s{i}", "task_type": "Summary", "source_info": f"alpha beta gamma number{i}"} for i in range(3)]
    objects = [{"source_id": "d", "task_type": "Data2txt", "source_info": {"name": "N", "z": 3.0, "a": [1e20, {"q": None}]}}]
    answers = [{"id": str(i), "source_id": f"s{i % 3}", "model": "m", "split": "train", "temperature": "warm" if i == 1 else 0.5, "response": f"alpha {i}"} for i in range(6)]
    (tmp_path / "source_info.jsonl").write_text("\n\n".join(json.dumps(x) for x in sources + objects) + "\n")
    lines = [json.dumps(x) for x in answers]
    (tmp_path / "whole.jsonl").write_text("\n".join(lines))
    (tmp_path / "response.jsonl").write_text("\n".join([*lines[:2], '{"id": "7", "source_id": "s0", "resp', "  ", *lines[2:4], '["no", "object"]', "7", *lines[4:], "{not json}"]) + "\n")
    return tmp_path


def test_a_bad_line_in_the_middle(spark, folder):
    with pytest.raises(Exception, match="no JSON object in .*response.jsonl"):
        records.load_instances(spark, str(folder)).collect()
    kept = {r.response_id: r.response for r in records.load_instances(spark, str(folder), on_bad="aside").collect()}
    assert kept == {str(i): f"alpha {i}" for i in range(6)}  # a field of another type is no bad line
    bad = records.bad_records(spark, str(folder)).collect()
    assert len(bad) == 4 and {r.stage for r in bad} == {"read"} and all(r.id.endswith("response.jsonl") for r in bad)
    assert any('"resp' in r.error for r in bad)
    first = {r.response_id for r in records.load_instances(spark, str(folder), on_bad="aside", limit=3).collect()}
    assert first == {"0", "1", "2"}
    with pytest.raises(ValueError, match="on_bad"):
        records.read_responses(spark, str(folder / "response.jsonl"), on_bad="skip")
    with pytest.raises(FileNotFoundError, match="source_info.jsonl and response.jsonl"):
        records.read_responses(spark, str(folder / "nothing.jsonl"))


def test_objects_keep_their_text(spark, folder):
    found = {r.source_id: r.source_info for r in records.read_sources(spark, str(folder / "source_info.jsonl")).collect()}
    assert found["d"].replace(" ", "") == '{"name":"N","z":3.0,"a":[1e+20,{"q":null}]}' and found["s1"] == "alpha beta gamma number1"


def test_bad_lines_stand_with_the_failures(spark, folder, tmp_path):
    instances = records.load_instances(spark, str(folder), on_bad="aside")
    pipeline.run(instances, str(tmp_path / "out"), stage="extract", bad=records.bad_records(spark, str(folder)))
    assert spark.read.json(str(tmp_path / "out/failures")).filter("stage = 'read'").count() == 4


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_report_and_audit_files_are_on_the_store(spark, tmp_path, scheme, monkeypatch):
    monkeypatch.chdir(tmp_path)
    root = f"{scheme}{tmp_path}/run"
    sinks.write_report(spark, "# ünd\n", f"{root}/report.md")
    assert (tmp_path / "run/report.md").read_text() == "# ünd\n"
    ids = ["a", "b/c", "d e", "é" * 200, "..", "x.y", "é" * 199 + "f"]
    rows = spark.createDataFrame([(i, n, None) for n, i in enumerate(ids)], "response_id string, n int, x double").repartition(3)
    for _ in range(2):  # again over what is there
        sinks.write_audit(rows, f"{root}/audit", one_file_each=True)
    names = os.listdir(tmp_path / "run/audit")
    assert sorted(names) == sorted(f"{sinks.file_name(i)}.json" for i in ids) and all((tmp_path / "run/audit" / n).is_file() for n in names)
    assert json.loads((tmp_path / "run/audit" / f"{sinks.file_name('b/c')}.json").read_text()) == {"response_id": "b/c", "n": 1, "x": None}
    assert Store(spark, root).names() == ["audit", "report.md"] and sorted(os.listdir(tmp_path)) == ["run"]


def test_an_address_that_tasks_cannot_reach(spark):
    rows = spark.createDataFrame([("a",)], "response_id string")
    with pytest.raises(ValueError, match="can't be written from tasks"):
        sinks.write_audit(rows, "viewfs://store/audit", one_file_each=True)


# -- vectors -------------------------------------------------------------------


def counting(log):
    def load():
        def encode(texts):
            with open(log, "a") as f:
                f.writelines(t + "\n" for t in texts)
            return np.array([[len(t), t.count("a") + 1.0, 1.0] for t in texts])

        return encode

    return ModelEmbedder(load)


def test_each_text_is_embedded_once(spark, tmp_path):
    log = tmp_path / "log"
    stored = StoredEmbedder(counting(log), str(tmp_path / "vectors"))
    some = spark.createDataFrame([("alpha",), ("beta",), ("alpha",), (None,)], "text string")
    plain = {r.text: r.embedding for r in counting(tmp_path / "other").embed(some.filter("text is not null").distinct()).collect()}
    for _ in range(2):
        got = stored.embed(some)
        assert {r.text: r.embedding for r in got.collect()} == plain and got.count() == 2
    more = stored.embed(spark.createDataFrame([("beta",), ("gamma",)], "text string"))
    assert sorted(r.text for r in more.collect()) == ["beta", "gamma"]
    assert sorted(log.read_text().split()) == ["alpha", "beta", "gamma"]
    assert stored.embed(some.limit(0)).count() == 0


def test_scoring_and_sweep_of_a_run_share_their_vectors(spark, folder, tmp_path):
    (folder / "response.jsonl").write_text((folder / "whole.jsonl").read_text())
    instances = records.load_instances(spark, str(folder)).filter("task = 'Summary'")
    settings = Settings(eval=EvalSettings(alpha_grid=(0.5,), tau_e_sweep=(0.9,), tau_r_sweep=(0.75,)))
    named = counting(tmp_path / "log")
    named.name = "toy"
    for stage in ("score", "tune"):
        pipeline.run(instances, str(tmp_path / "out"), settings, embedder=named, stage=stage)
    told = (tmp_path / "log").read_text().splitlines()
    assert len(told) == len(set(told)) > 3


# -- dialogs -------------------------------------------------------------------


def test_running_references_are_those_of_joined_texts(spark):
    rng = random.Random(6)
    vocabulary = [f"word{chr(97 + i)}" for i in range(26)]
    rows = []
    for conv in range(12):
        n = 60 if conv == 0 else rng.randrange(1, 9)
        rows += [(f"c{conv}", t * (100 if conv == 1 else 1), rng.choice(["user", "assistant", "assistant"]), rng.choice([None, "", " ".join(rng.choices(vocabulary, k=rng.randrange(1, 8)))])) for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").repartition(4)
    sources, answers = dialog.dialog_graphs(turns)
    expected = {}
    for conv, turn, role, text in rows:
        if role == "assistant":
            earlier = sorted((t, r, x) for c, t, r, x in rows if c == conv and t < turn and x is not None)
            asked = [x for _, r, x in earlier if r == "user"]
            expected[f"{conv}-{turn}"] = ("\n".join(x for *_, x in earlier), asked[-1] if asked else "", text or "")

    def plain(text):
        return graph.OfflineExtractor().extract(spark.createDataFrame([(k, v) for k, v in text.items()], "owner string, text string")).select("owner", "entities", "relations").collect()

    for kind, at in (("context", 0), ("query", 1)):
        wanted = {r.owner: (r.entities, r.relations) for r in plain({k: v[at] for k, v in expected.items()})}
        assert {r.source_id: (r.entities, r.relations) for r in sources.filter(F.col("kind") == kind).collect()} == wanted
    wanted = {r.owner: (r.entities, r.relations) for r in plain({k: v[2] for k, v in expected.items()})}
    assert {r.response_id: (r.entities, r.relations) for r in answers.collect()} == wanted
    assert dialog.dialog_graphs(turns.limit(0))[0].count() == 0


def test_last_values_are_carried_from_part_to_part(spark):
    rows = [("a", t, t % 7 == 0) for t in range(50)] + [("b", 3, False), ("b", 2000, False)]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, mark boolean")
    got = {(r.conv_id, r.turn): r.last for r in dialog.before(turns, F.when(F.col("mark"), F.col("turn")), "last", part_turns=4).collect()}
    assert got == {(c, t): max((x for d, x, m in rows if d == c and m and x < t), default=None) for c, t, _ in rows}
