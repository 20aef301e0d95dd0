import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from plumbline.config import EvalSettings, MatchSettings, MetricSettings, Settings
from plumbline.functions.embed import HashEmbedder
from plumbline.operators import graph, match, score
from plumbline.plans import evaluate, pipeline
from plumbline.sources import records, sinks
from plumbline.streaming.score import score_stream

T = "array<struct<s:string,p:string,o:string>>"


def run_score(spark, answer, context, settings=None, embedder=None, query=((), ())):
    answers = spark.createDataFrame([("r", "s", list(answer[0]), list(answer[1]))], f"response_id string, source_id string, entities array<string>, relations {T}")
    rows = [("s", "context", list(context[0]), list(context[1])), ("s", "query", list(query[0]), list(query[1]))]
    sources = spark.createDataFrame(rows, f"source_id string, kind string, entities array<string>, relations {T}")
    return score.score(answers, sources, settings, embedder).first()


def test_exact_substring_and_ungrounded(spark):
    got = run_score(spark, (["The Moon", "Moon rock", "the", "it", "Mars"], []), (["moon", "it was"], []))
    assert {tuple(m) for m in got.matched_entities} == {("moon", "moon", "exact"), ("moon rock", "moon", "substring")}
    assert got.ungrounded_entities == ["mars", "it", "the"] and got.EG == pytest.approx(0.4) and got.RP is None and not got.RP_defined


def test_relation_needs_predicate_ends_and_direction(spark):
    context = (["a1", "b1"], [("a1", "likes", "b1")])
    assert run_score(spark, (["a1"], [("a1", "likes", "b1"), ("b1", "likes", "a1"), ("a1", "hates", "b1")]), context).RP == pytest.approx(1 / 3)
    assert run_score(spark, (["a1"], [("b1", "likes", "a1")]), context, MatchSettings(inverse_edges=True)).RP == 1.0
    # the ends must match entities of the reference, even if a triple has them
    assert run_score(spark, (["x"], [("a1", "likes", "b1")]), (["a1"], [("a1", "likes", "b1")])).RP == 0.0


def test_gate_normalises_twice(spark):
    context = (["the cat", "dog"], [("the the cat", "sees", "dog")])
    assert run_score(spark, (["dog"], [("the the cat", "sees", "dog")]), context, MatchSettings(allow_substring=False)).RP == 1.0


def test_embeddings_match_entities_and_predicates(spark):
    known = {"car": [1, 0], "auto": [0.99, 0.1], "drives": [0, 1], "steers": [0.1, 0.99], "bob": [1, 1]}
    e = HashEmbedder(known, dim=2)
    context = (["auto", "bob"], [("bob", "steers", "auto")])
    got = run_score(spark, (["car"], [("bob", "drives", "car")]), context, embedder=e)
    assert [tuple(m) for m in got.matched_entities] == [("car", "auto", "embedding")] and got.RP == 1.0
    assert run_score(spark, (["car"], [("bob", "drives", "car")]), context).EG == 0.0


def test_degenerate_graphs(spark):
    none = run_score(spark, ([], []), (["a"], []))
    assert none.unscorable and none.EG is None and none.Va == 0
    empty = run_score(spark, (["a"], []), ([], []))
    assert empty.ref_empty and empty.EG == 0.0
    both = run_score(spark, (["q1"], []), (["c1"], []), query=(["q1"], []))
    assert both.EG == 1.0 and (both.Vc, both.Vq) == (1, 1)


def test_row_and_table_matching_agree(spark):
    names = [("s", n) for n in ("moon", "moon rock", "rock band", "the", "mars", "§§")]
    refs = [("s", r) for r in ("moon", "big rock", "x §§ b", "theatre")]
    n, r = spark.createDataFrame(names, "source_id string, norm string"), spark.createDataFrame(refs, "source_id string, ref string")
    tables = {(x.norm, x.ref, x.method) for x in match.match_entities(n, r).collect()}
    row = run_score(spark, ([n for _, n in names], []), ([r for _, r in refs], []))
    assert tables == {tuple(m) for m in row.matched_entities} == {("moon", "moon", "exact"), ("moon rock", "moon", "substring"), ("§§", "x §§ b", "substring")}


@pytest.fixture
def folder(tmp_path):
    with open(tmp_path / "source_info.jsonl", "w") as f:
        infos = {"QA": {"question": "who wrote alpha", "passages": "alpha was written by beta in gamma"}, "Data2txt": {"name": "Delta", "city": "Epsilon"}, "Summary": "zeta theta kappa sigma"}
        for task, info in infos.items():
            for i in range(2):
                f.write(json.dumps({"source_id": f"{task}{i}", "task_type": task, "source": "x", "source_info": info, "prompt": "p"}) + "\n\n")
    with open(tmp_path / "response.jsonl", "w") as f:
        for task in infos:
            for i in range(2):
                for j, text in enumerate(("alpha beta gamma named delta city zeta theta kappa", "unrelated invented words here")):
                    spans = [{"start": 0, "end": 3, "text": "x", "label_type": "Evident", "implicit_true": "yes" if i else False}] if j else []
                    f.write(json.dumps({"id": f"{task}{i}{j}", "source_id": f"{task}{i}", "model": f"m{j}", "labels": spans, "split": "test" if i else "train", "response": text}) + "\n")
        f.write(json.dumps({"id": "orphan", "source_id": "none", "response": "x"}) + "\n")
    return tmp_path


def test_instances(spark, folder):
    rows = {r.response_id: r for r in records.load_instances(spark, str(folder)).collect()}
    assert len(rows) == 12 and rows["QA00"].query == "who wrote alpha" and rows["Summary00"].context.startswith("zeta") and rows["Data2txt00"].query is None
    assert rows["Data2txt00"].context == "The business is named Delta.\nDelta has city = Epsilon."
    assert rows["QA01"].y == 1 and rows["QA01"].gt_span_types == ["Evident"] and rows["QA00"].y == 0
    strict = {r.response_id: r.y for r in records.load_instances(spark, str(folder), ["test"], exclude_implicit_true=True).collect()}
    assert len(strict) == 6 and set(strict.values()) == {0}


def test_whole_job(spark, folder, tmp_path):
    instances = records.load_instances(spark, str(folder))
    out = str(tmp_path / "out")
    settings = Settings(eval=EvalSettings(n_bootstrap=20, tau_e_sweep=(0.9,), tau_r_sweep=(0.75,)))
    result = pipeline.run(instances, out, settings, cache_path=str(tmp_path / "cache"))
    summary = result.summary.first()
    assert summary.overall_AUC == 1.0 and summary.overall_F1 == 1.0 and summary.n_test == 6
    report = open(f"{out}/report.md").read()
    assert "AUC by task" in report and "OVERALL" in report
    assert sinks.read_scored(spark, f"{out}/scored").count() == 12
    assert spark.read.json(f"{out}/audit").filter("H > 0.9").count() == 6


def test_stages_one_by_one_are_the_whole_job(spark, folder, tmp_path):
    instances = records.load_instances(spark, str(folder))
    settings = Settings(eval=EvalSettings(n_bootstrap=20, tau_e_sweep=(0.8, 0.9), tau_r_sweep=(0.75,)))
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    expected = pipeline.run(instances, whole, settings)
    with pytest.raises(AnalysisException):
        pipeline.run(instances, parts, settings, stage="evaluate")
    for stage in pipeline.STAGES[:3]:
        assert pipeline.run(instances, parts, settings, stage=stage) is None
    found = pipeline.run(instances, parts, settings, stage="evaluate")
    assert evaluate.short(found.summary).collect() == evaluate.short(expected.summary).collect()
    assert set(evaluate.short(found.summary).columns) >= {"alpha", "theta", "overall_AUC_exclude_unscorable", "overall_AUC_impute"}
    a, b = (sinks.read_tuning(spark, f"{x}/tuning").first() for x in (whole, parts))
    assert a == b and len(a.alpha_cv) == 11 and [(t.tau_e, t.tau_r) for t in a.tau_sweep] == [(0.8, 0.75), (0.9, 0.75)]
    fixed = Settings(metrics=MetricSettings(alpha=0.3), eval=settings.eval)
    pipeline.run(instances, parts, fixed, stage="tune", with_sweep=False)
    again = sinks.read_tuning(spark, f"{parts}/tuning").first()
    assert again.alpha == 0.3 and {t.AUC for t in again.alpha_cv} == {None} and again.tau_sweep == []
    with pytest.raises(ValueError):
        pipeline.run(instances, parts, settings, stage="other")


def test_limit_takes_the_first_in_the_file(spark, tmp_path):
    with open(tmp_path / "source_info.jsonl", "w") as f:
        f.write(json.dumps({"source_id": "s", "task_type": "Summary", "source_info": "text"}) + "\n")
    with open(tmp_path / "response.jsonl", "w") as f:
        for i in ("9", "x", "1", "5", "0"):
            f.write(json.dumps({"id": i, "source_id": "none" if i == "x" else "s", "split": "test" if i == "1" else "train", "response": "r"}) + "\n")

    def first(n, **more):
        return {r.response_id for r in records.load_instances(spark, str(tmp_path), limit=n, **more).collect()}

    assert first(2) == {"9", "1"} and first(2, splits=["train"]) == {"9", "5"} and first(99) == {"9", "1", "5", "0"}


def test_thresholds_as_rows_are_scores_one_by_one(spark):
    words = [f"word{i}" for i in range(12)]
    answers = spark.createDataFrame([("r", "s", words[:6], [(a, "p", b) for a, b in zip(words[:6], words[1:6])])], f"response_id string, source_id string, entities array<string>, relations {T}")
    sources = spark.createDataFrame([("s", "context", words[5:], [(a, "q", b) for a, b in zip(words[5:], words[6:])])], f"source_id string, kind string, entities array<string>, relations {T}")
    pairs = [(e, r) for e in (0.1, 0.4) for r in (-1.0, 0.9)]
    got = {(r.tau_e, r.tau_r): (r.EG, r.RP) for r in score.score(answers, sources, None, HashEmbedder(), pairs).collect()}
    assert got == {(e, r): tuple(score.score(answers, sources, MatchSettings(entity_threshold=e, relation_threshold=r), HashEmbedder()).select("EG", "RP").first()) for e, r in pairs}
    assert len(set(got.values())) > 1


def test_tokens_and_cost_run_up(spark, tmp_path):
    class Backend:
        def generate(self, input_data, cluster):
            usage = type("U", (), {"prompt_tokens": len(input_data), "completion_tokens": 2, "cost_usd": 0.5})
            return type("G", (), {"entities": {input_data}, "relations": (), "usage": usage})

    texts = spark.createDataFrame([("1", "one"), ("2", " one "), ("3", "three"), ("4", " ")], "owner string, text string")
    path = str(tmp_path / "cache")
    _, log = graph.extract(texts, graph.BackendExtractor(Backend), None, path)
    total = graph.usage(log).first()
    assert (total.calls, total.cache_hits, total.prompt_tokens, total.completion_tokens, total.cost_usd) == (2, 1, 8, 4, 1.0)
    rows = sinks.running_calls(log).orderBy("cum_calls", "owner").collect()
    assert [r.cum_calls for r in rows][-1] == 2 and max(r.cum_prompt_tokens for r in rows) == 8 and max(r.cum_cost_usd for r in rows) == 1.0
    _, log = graph.extract(texts, graph.BackendExtractor(Backend), None, path)
    assert tuple(graph.usage(log).first()) == (0, 3, 0.0, 0, 0, 0.0)


def test_cache_is_used_and_failures_are_listed(spark, tmp_path):
    class Backend:
        def generate(self, input_data, cluster):
            if "bad" in input_data:
                raise ValueError("no")
            return type("G", (), {"entities": {input_data}, "relations": {("a", "b")}})

    from plumbline.config import ExtractionSettings

    quick = ExtractionSettings(max_retries=1)
    texts = spark.createDataFrame([("1", "one"), ("2", " one "), ("3", "bad"), ("4", "  "), ("5", None)], "owner string, text string")
    path = str(tmp_path / "cache")
    extractor = graph.BackendExtractor(Backend, quick)
    graphs, log = graph.extract(texts, extractor, quick, path)
    got = {r.owner: (r.entities, r.error) for r in graphs.collect()}
    assert got["1"] == got["2"] == (["one"], None) and got["4"] == got["5"] == ([], None) and got["3"][1] == "ValueError: no"
    _, log = graph.extract(texts, extractor, quick, path)
    assert {r.owner for r in log.filter("cached").collect()} == {"1", "2"}
    assert graph.usage(log).first().calls == 1


def test_stream_equals_batch(spark, tmp_path):
    answers = spark.createDataFrame([(str(i), "s", f"alpha beta{i % 3} gamma") for i in range(6)], "response_id string, source_id string, response string")
    answers.write.json(str(tmp_path / "in"))
    sources = spark.createDataFrame([("s", "context", ["alpha", "beta1"], [])], f"source_id string, kind string, entities array<string>, relations {T}")
    stream = spark.readStream.schema(answers.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    score_stream(stream, lambda: sources, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    texts = answers.select(F.col("response_id").alias("owner"), F.col("response").alias("text"))
    graphs, _ = graph.extract(texts, graph.OfflineExtractor())
    batch = score.score(graphs.withColumnRenamed("owner", "response_id").join(answers.select("response_id", "source_id"), "response_id").drop("error"), sources)
    streamed = {r.response_id: r.EG for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert streamed == {r.response_id: r.EG for r in batch.collect()} and len(streamed) == 6
