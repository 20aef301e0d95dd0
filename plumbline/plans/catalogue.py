"""Named queries over the given tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import EvalSettings, ExtractionSettings, MatchSettings, Settings
from plumbline.functions import text
from plumbline.functions.embed import HashEmbedder
from plumbline.functions.serialize import business_text, flat_facts
from plumbline.operators import dialog, graph, match, score, stats
from plumbline.plans import evaluate, pipeline, tune
from plumbline.sources import records, sinks
from plumbline.sources.store import written
from plumbline.sources.views import split_documents, table

Query = Callable[[SparkSession, str], DataFrame]

ALPHA, THETA, TAU = 0.7, 0.8, 0.40

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- shared parts -------------------------------------------------------------

_RESP = """
resp AS (SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS response_id, d.lang AS task, d.source AS gen_model, CASE WHEN d.doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
  substr(d.text, 1, length(d.text) // 2) AS context, substr(d.text, length(d.text) // 2 + 1) AS response, CAST(1 - l.quality AS INTEGER) AS y
  FROM documents d JOIN labels l USING (doc_id))"""

_GRAPH = (
    _RESP
    + """,
kinds AS (SELECT response_id, 'context' AS kind, context AS text FROM resp UNION ALL SELECT response_id, 'answer', response FROM resp),
words AS (SELECT response_id, kind, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]+'), lambda w: length(w) >= 4) AS w FROM kinds),
firsts AS (SELECT response_id, kind, w, min(p) AS p FROM (SELECT response_id, kind, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM words) GROUP BY response_id, kind, w),
ent AS (SELECT response_id, kind, w AS entity, row_number() OVER (PARTITION BY response_id, kind ORDER BY p) AS rn FROM firsts QUALIFY rn <= 12),
rel AS (SELECT * FROM (SELECT response_id, kind, entity AS s, lead(entity) OVER (PARTITION BY response_id, kind ORDER BY rn) AS o FROM ent) WHERE o IS NOT NULL)"""
)

_SCORES = (
    _GRAPH
    + """,
va AS (SELECT a.response_id, count(*) AS va, count(c.entity) AS nm FROM ent a LEFT JOIN ent c ON c.response_id = a.response_id AND c.kind = 'context' AND c.entity = a.entity WHERE a.kind = 'answer' GROUP BY a.response_id),
ea AS (SELECT a.response_id, count(*) AS ea, count(c.s) AS ns FROM rel a LEFT JOIN rel c ON c.response_id = a.response_id AND c.kind = 'context' AND c.s = a.s AND c.o = a.o WHERE a.kind = 'answer' GROUP BY a.response_id),
vc AS (SELECT response_id, count(*) AS vc FROM ent WHERE kind = 'context' GROUP BY response_id),
sc AS (SELECT resp.*, length(context) AS context_len, coalesce(vc, 0) AS "Vc", greatest(coalesce(vc, 0) - 1, 0) AS "Ec", coalesce(va, 0) AS "Va", coalesce(ea, 0) AS "Ea",
  CAST(nm AS DOUBLE) / va AS "EG", CAST(ns AS DOUBLE) / ea AS "RP", coalesce(va, 0) = 0 AS unscorable, coalesce(vc, 0) = 0 AS ref_empty
  FROM resp LEFT JOIN va USING (response_id) LEFT JOIN ea USING (response_id) LEFT JOIN vc USING (response_id)),
ev AS (SELECT *, 1 - (CASE WHEN "RP" IS NULL THEN "EG" ELSE CAST(0.7 AS DOUBLE) * "EG" + (1 - CAST(0.7 AS DOUBLE)) * "RP" END) AS "H", 1 - "EG" AS "H_eg", 1 - "RP" AS "H_rp" FROM sc)"""
)

_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[\t\n\x0B\f\r\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'), '^[!-/:-@\[-`{{-~ ]+|[!-/:-@\[-`{{-~ ]+$', '', 'g'), '^(a|an|the) (.)', '\2'))"""

_PHRASES = (
    _RESP
    + rf""",
ph AS (SELECT DISTINCT response_id, kind, {_NORM.format(x="part")} AS norm FROM (
  SELECT response_id, 'context' AS kind, unnest(regexp_split_to_array(context, '[.,|\n]')) AS part FROM resp UNION ALL SELECT response_id, 'answer', unnest(regexp_split_to_array(response, '[.,|\n]')) FROM resp)),
refs AS (SELECT response_id, norm AS ref FROM ph WHERE kind = 'context' AND norm <> ''),
names AS (SELECT response_id, norm FROM ph WHERE kind = 'answer' AND norm <> ''),
exact AS (SELECT n.response_id, n.norm FROM names n JOIN refs r ON r.response_id = n.response_id AND r.ref = n.norm),
pairs AS (SELECT n.response_id, norm, ref, CASE WHEN length(norm) <= length(ref) THEN norm ELSE ref END AS short, CASE WHEN length(norm) <= length(ref) THEN ref ELSE norm END AS long
  FROM (SELECT * FROM names ANTI JOIN exact USING (response_id, norm)) n JOIN refs r ON r.response_id = n.response_id),
held AS (SELECT response_id, norm, ref FROM pairs WHERE contains(long, short) AND length(short) >= 2
  AND short NOT IN ({", ".join(f"'{w}'" for w in MatchSettings().stopwords)})
  AND regexp_matches(long, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(short) || '($|[^\p{{L}}\p{{N}}_])'))"""
)


def _unlabelled(sql: str) -> str:
    """The same over all documents: y is null where there is no label."""
    return sql.replace("FROM documents d JOIN labels", "FROM documents d LEFT JOIN labels")


_ALL_GRAPH, _ALL_SCORES, _PHRASES = _unlabelled(_GRAPH), _unlabelled(_SCORES), _unlabelled(_PHRASES)


def _graphs(spark: SparkSession, sf_dir: str, labelled: bool = False) -> tuple[DataFrame, pipeline.Graphs]:
    instances = split_documents(spark, sf_dir, labelled)
    return instances, pipeline.extract_graphs(instances)


def _scores(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    instances, graphs = _graphs(spark, sf_dir, labelled)
    return pipeline.scores(instances, graphs)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances, graphs = _graphs(spark, sf_dir, labelled=True)
    return score.evaluation_rows(instances, score.score(graphs.answers, graphs.sources), ALPHA)


def _test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).filter("split = 'test' and not unscorable")


def _phrases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names of answers and references of sources: texts cut at punctuation, each once in its text."""
    instances = split_documents(spark, sf_dir, labelled=False)

    def parts(column: str, name: str) -> DataFrame:
        own = F.array_remove(F.array_distinct(F.transform(F.split(column, r"[.,|\n]"), text.normalize)), "")
        # Outer, as Spark else works out the arrays once more to see whether they are empty.
        return instances.select("source_id", F.explode_outer(own).alias(name)).filter(f"{name} IS NOT NULL")

    return parts("response", "norm"), parts("context", "ref")


def _as_response(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("source_id", "response_id")


# -- text ---------------------------------------------------------------------


@query("""
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, array_to_string(w, ' ') AS tokens
FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]+'), lambda w: length(w) >= 4) AS w FROM documents)
""")
def tokens_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return found.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


@query(rf"""
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, md5(array_to_string(list_transform(l, lambda x: {_NORM.format(x="x")}), '|')) AS norms_md5
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
""")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    return lines.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.md5(F.array_join(F.transform("l", text.normalize), "|")).alias("norms_md5"))


@query("""
SELECT doc_id, sha256('{"chunk_chars": 6000, "cluster": true, "model": "offline", "temperature": 0.0, "v": 1}' || chr(0) || text) AS cache_key FROM documents
""")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.cache_key(F.col("text"), ExtractionSettings()).alias("cache_key"))


@query("""
SELECT event_id, array_to_string(list_transform(json_keys(props), lambda k: k || ' = ' || json_extract_string(props, '$."' || k || '"')), '; ') AS facts FROM events
""")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.array_join(flat_facts(F.col("props")), "; ").alias("facts"))


@query("""
SELECT event_id, array_to_string(list_transform(json_keys(props), lambda k: 'The business has ' || k || ' = ' || json_extract_string(props, '$."' || k || '"') || '.'), chr(10)) AS text FROM events
""")
def business_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", business_text(F.col("props")).alias("text"))


@query("""
SELECT doc_id, CAST(CASE WHEN quality = 0 AND doc_id % 4 NOT IN (0, 1) OR toxic = 1 THEN 1 ELSE 0 END AS INTEGER) AS y,
  concat_ws(',', CASE WHEN quality = 0 AND doc_id % 4 NOT IN (0, 1) THEN 'low' END, CASE WHEN toxic = 1 THEN 'Unknown' END) AS types
FROM labels
""")
def label_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.element_at(F.array(F.lit("true"), F.lit(" Yes "), F.lit("0"), F.lit(None).cast("string")), (F.col("doc_id") % 4 + 1).cast("int"))

    def span(kind, implicit):
        empty = F.lit(None)
        return F.struct(empty.cast("int"), empty.cast("int"), empty.cast("string"), kind.cast("string"), empty.cast("string"), F.lit("true"), implicit.cast("string")).cast(records.SPAN)

    spans = F.array_compact(F.array(F.when(F.col("quality") == 0, span(F.lit("low"), flag)), F.when(F.col("toxic") == 1, span(F.lit(None), F.lit(None)))))
    types = records.span_types(spans, exclude_implicit_true=True)
    return table(spark, sf_dir, "labels").select("doc_id", (F.size(types) > 0).cast("int").alias("y"), F.array_join(types, ",").alias("types"))


# -- graphs -------------------------------------------------------------------


@query(f"WITH {_ALL_GRAPH} SELECT response_id, kind, entity FROM ent")
def graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, g = _graphs(spark, sf_dir)
    both = g.sources.filter("kind = 'context'").select(F.col("source_id").alias("response_id"), "kind", "entities").unionByName(g.answers.select("response_id", F.lit("answer").alias("kind"), "entities"))
    return both.select("response_id", "kind", F.explode("entities").alias("entity"))


@query(f"WITH {_ALL_GRAPH} SELECT response_id, kind, s, 'co_occurs_with' AS p, o FROM rel")
def graph_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, g = _graphs(spark, sf_dir)
    both = g.sources.filter("kind = 'context'").select(F.col("source_id").alias("response_id"), "kind", "relations").unionByName(g.answers.select("response_id", F.lit("answer").alias("kind"), "relations"))
    return both.select("response_id", "kind", F.explode("relations").alias("r")).select("response_id", "kind", "r.s", "r.p", "r.o")


_DIALOG = """
said AS (SELECT conv_id || '-' || turn AS source_id, role, text AS response,
  string_agg(text, chr(10)) OVER w AS context, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS query
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kinds AS (SELECT source_id, k.kind, k.text FROM (SELECT source_id, unnest([{'kind': 'context', 'text': context}, {'kind': 'query', 'text': query}, {'kind': 'answer', 'text': response}]) AS k FROM said WHERE role = 'assistant')),
words AS (SELECT source_id, kind, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]+'), lambda w: length(w) >= 4) AS w FROM kinds WHERE text IS NOT NULL),
firsts AS (SELECT source_id, kind, w, min(p) AS p FROM (SELECT source_id, kind, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM words) GROUP BY source_id, kind, w),
ent AS (SELECT source_id, kind, w AS entity, row_number() OVER (PARTITION BY source_id, kind ORDER BY p) AS rn FROM firsts QUALIFY rn <= 12)"""


@query(f"WITH {_DIALOG} SELECT DISTINCT source_id, entity FROM ent WHERE kind <> 'answer'")
def graph_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = dialog.dialog_graphs(table(spark, sf_dir, "conversations"))[0].select("kind", F.col("source_id").alias("owner"), "entities", "relations")
    both = graph.union(graph.entities_of(g.filter("kind = 'context'")), graph.entities_of(g.filter("kind = 'query'")))
    return both.withColumnRenamed("owner", "source_id")


@query(f"""
WITH {_DIALOG}, refs AS (SELECT DISTINCT source_id, entity FROM ent WHERE kind <> 'answer'),
s AS (SELECT a.source_id, count(*) AS va, count(r.entity) AS n FROM ent a LEFT JOIN refs r USING (source_id, entity) WHERE kind = 'answer' GROUP BY a.source_id)
SELECT k.source_id AS response_id, coalesce(va, 0) AS "Va", CAST(n AS DOUBLE) / va AS "EG" FROM (SELECT source_id FROM kinds WHERE kind = 'answer') k LEFT JOIN s USING (source_id)
""")
def dialog_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, answers = dialog.dialog_graphs(table(spark, sf_dir, "conversations"))
    return score.score(answers, sources).select("response_id", "Va", "EG")


# -- matching -----------------------------------------------------------------


@query(f"WITH {_PHRASES} SELECT response_id, ref FROM refs")
def ref_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_response(_phrases(spark, sf_dir)[1].distinct())


@query(f"WITH {_PHRASES} SELECT response_id, norm FROM exact")
def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, refs = _phrases(spark, sf_dir)
    return _as_response(match.match_exact(names.distinct(), refs))


@query(f"WITH {_PHRASES} SELECT response_id, norm, ref FROM held")
def match_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, refs = _phrases(spark, sf_dir)
    refs = written(refs, "references")
    rest = names.join(refs.withColumnRenamed("ref", "norm"), ["source_id", "norm"], "left_anti")
    return _as_response(match.match_contained(rest, refs, MatchSettings()))


@query(f"""
WITH {_PHRASES} SELECT response_id, norm, norm AS ref, 'exact' AS method FROM exact
UNION ALL SELECT response_id, norm, min(ref), 'substring' FROM held GROUP BY response_id, norm
""")
def match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_response(match.match_entities(*_phrases(spark, sf_dir)))


def _aligned(spark: SparkSession, sf_dir: str, settings: MatchSettings) -> DataFrame:
    _, g = _graphs(spark, sf_dir)
    aligned = score.align(g.answers, g.sources, settings)
    return _as_response(aligned.select("source_id", "s", "p", "o", "method"))


@query(f"""
WITH {_ALL_GRAPH} SELECT a.response_id, a.s, 'co_occurs_with' AS p, a.o, 'forward' AS method
FROM rel a JOIN rel c ON c.response_id = a.response_id AND c.kind = 'context' AND c.s = a.s AND c.o = a.o WHERE a.kind = 'answer'
""")
def align_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, MatchSettings())


@query(f"""
WITH {_ALL_GRAPH}, h AS (SELECT a.response_id, a.s, a.o, min(struct_pack(s2 := c.s, o2 := c.o, way := CASE WHEN c.s = a.s AND c.o = a.o THEN 0 ELSE 1 END)) AS b
FROM rel a JOIN rel c ON c.response_id = a.response_id AND c.kind = 'context' AND (c.s = a.s AND c.o = a.o OR c.s = a.o AND c.o = a.s) WHERE a.kind = 'answer' GROUP BY a.response_id, a.s, a.o)
SELECT response_id, s, 'co_occurs_with' AS p, o, CASE WHEN b.way = 0 THEN 'forward' ELSE 'inverse' END AS method FROM h
""")
def align_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir, MatchSettings(inverse_edges=True))


_TOP = """
v AS (SELECT CAST(vec_id AS VARCHAR) AS id, vec_id, CAST(label AS VARCHAR) AS source_id, embedding FROM embeddings),
sims AS (SELECT a.source_id, a.id AS norm, r.id AS ref, round(list_sum(list_transform(list_zip(a.embedding, r.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])), 6) AS sim
  FROM v a JOIN v r ON a.source_id = r.source_id WHERE a.vec_id % 5 = 0 AND r.vec_id % 5 <> 0),
top AS (SELECT source_id, norm, max(sim) AS sim FROM sims GROUP BY source_id, norm)"""


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("text"), (F.col("vec_id") % 5 == 0).alias("asks"), F.col("label").cast("string").alias("source_id"), "embedding")
    names, refs = v.filter("asks").select("source_id", F.col("text").alias("norm")), v.filter("not asks").select("source_id", F.col("text").alias("ref"))
    return match.nearest(names, refs, v.select("text", "embedding"))


@query(f"WITH {_TOP} SELECT source_id, norm, sim FROM top")
def cosine_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("source_id", "norm", F.round("sim", 6).alias("sim"))


@query(f"WITH {_TOP} SELECT source_id, count(*) AS n, count(*) FILTER (sim >= 0.40) AS n_matched FROM top GROUP BY source_id")
def embedding_match_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _nearest(spark, sf_dir)
    return found.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("sim") >= TAU).alias("n_matched"))


# -- scores -------------------------------------------------------------------


@query(f'WITH {_ALL_SCORES} SELECT response_id, "Va", "EG" FROM sc')
def entity_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, labelled=False).select("response_id", "Va", "EG")


@query(f'WITH {_ALL_SCORES} SELECT response_id, "Ea", "RP" FROM sc')
def relation_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, labelled=False).select("response_id", "Ea", "RP")


@query(f'WITH {_SCORES} SELECT response_id, y, 1 - "H" AS "CFI", "H", "H_eg", "H_rp" FROM ev')
def score_cfi_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("response_id", "y", (1 - F.col("H")).alias("CFI"), "H", "H_eg", "H_rp")


@query(f"""
WITH {_ALL_SCORES}, u AS (SELECT response_id, string_agg(entity, ',' ORDER BY entity) AS ungrounded FROM (SELECT * FROM ent WHERE kind = 'answer') a
  ANTI JOIN (SELECT response_id, entity FROM ent WHERE kind = 'context') c USING (response_id, entity) GROUP BY response_id)
SELECT response_id, coalesce(ungrounded, '') AS ungrounded FROM resp LEFT JOIN u USING (response_id)
""")
def audit_ungrounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances, g = _graphs(spark, sf_dir)
    audits = score.audit_records(instances, score.score(g.answers, g.sources), ALPHA, 0.5)
    return audits.select("response_id", F.array_join("ungrounded_entities", ",").alias("ungrounded"))


def _embedded(sql: str, thresholds: str) -> str:
    """``sc`` after the graphs of ``sql``, for each of the ``thresholds`` of
    similarity: names are single words and predicates all equal, so containment
    decides nothing, and the relations' threshold neither."""
    return f"""{sql},
vec AS (SELECT entity, list_transform(raw, lambda x: CAST(x / sqrt(list_sum(list_transform(raw, lambda z: z * z))) AS FLOAT)) AS v FROM (
  SELECT entity, list_transform(range(16), lambda j: CAST(CAST('0x' || substr(md5('0:' || entity), CAST(2 * j + 1 AS INTEGER), 2) AS INTEGER) AS DOUBLE) - CAST(127.5 AS DOUBLE)) AS raw FROM (SELECT DISTINCT entity FROM ent))),
sims AS (SELECT a.response_id, a.entity AS a, c.entity AS c, CASE WHEN a.entity = c.entity THEN 1 ELSE list_sum(list_transform(list_zip(x.v, z.v), lambda p: CAST(p[1] AS DOUBLE) * p[2])) END AS sim
  FROM ent a JOIN ent c ON c.response_id = a.response_id AND c.kind = 'context' JOIN vec x ON x.entity = a.entity JOIN vec z ON z.entity = c.entity WHERE a.kind = 'answer'),
tau AS (SELECT unnest({thresholds}) AS tau_e), near AS (SELECT tau_e, sims.* FROM sims JOIN tau ON sim >= tau_e OR a = c),
names AS (SELECT DISTINCT tau_e, response_id, a FROM near), pairs AS (SELECT DISTINCT n.tau_e, n.response_id, n.a AS s, m.a AS o FROM near n JOIN near m USING (tau_e, response_id) JOIN rel c ON c.response_id = n.response_id AND c.kind = 'context' AND c.s = n.c AND c.o = m.c),
eg AS (SELECT t.tau_e, e.response_id, count(*) AS "Va", CAST(count(n.a) AS DOUBLE) / count(*) AS "EG" FROM ent e CROSS JOIN tau t LEFT JOIN names n ON n.tau_e = t.tau_e AND n.response_id = e.response_id AND n.a = e.entity WHERE e.kind = 'answer' GROUP BY t.tau_e, e.response_id),
rp AS (SELECT t.tau_e, r.response_id, count(*) AS "Ea", CAST(count(p.s) AS DOUBLE) / count(*) AS "RP" FROM rel r CROSS JOIN tau t LEFT JOIN pairs p ON p.tau_e = t.tau_e AND p.response_id = r.response_id AND p.s = r.s AND p.o = r.o WHERE r.kind = 'answer' GROUP BY t.tau_e, r.response_id),
sc AS (SELECT t.tau_e, resp.*, coalesce("Va", 0) AS "Va", coalesce("Ea", 0) AS "Ea", "EG", "RP" FROM resp CROSS JOIN tau t LEFT JOIN eg ON eg.tau_e = t.tau_e AND eg.response_id = resp.response_id LEFT JOIN rp ON rp.tau_e = t.tau_e AND rp.response_id = resp.response_id)"""


@query(f'WITH {_embedded(_ALL_GRAPH, "[0.6]::DOUBLE[]")} SELECT response_id, "Va", "Ea", "EG", "RP" FROM sc')
def score_with_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cascade with vectors from digests of the names."""
    pairs = pipeline.paired_graphs(split_documents(spark, sf_dir, labelled=False))
    scored = score.score_pairs(pairs, MatchSettings(entity_threshold=0.6, relation_threshold=0.6), HashEmbedder())
    return scored.select("response_id", "Va", "Ea", "EG", "RP")


@query(f"""
WITH {_ALL_GRAPH}, c AS (SELECT response_id, w FROM words WHERE kind = 'context')
SELECT a.response_id, count(*) AS n, avg(CAST(coalesce(list_contains(w, s) AND list_contains(w, o), false) AS INTEGER)) AS "RP" FROM rel a LEFT JOIN c USING (response_id) WHERE a.kind = 'answer' GROUP BY a.response_id
""")
def text_supported_rp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations judged by the source's text, which has both ends as words or not."""
    instances, g = _graphs(spark, sf_dir)
    relations = graph.relations_of(g.answers.select(F.col("response_id").alias("owner"), "relations")).withColumnRenamed("owner", "response_id")
    said = instances.select("response_id", text.tokens(F.col("context")).alias("w"))
    held = F.array_contains("w", F.col("s")) & F.array_contains("w", F.col("o"))
    verdicts = relations.join(said, "response_id").select("response_id", "s", "p", "o", F.when(held, "entailed").otherwise("unsupported").alias("verdict"))
    return stats.supported_share(relations, verdicts, ["response_id", "s", "p", "o"])


_HISTOGRAM = "SELECT {by}, \"H\" AS h, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM {rows} WHERE \"H\" IS NOT NULL GROUP BY {by}, \"H\""


def _auc_sql(rows: str, by: str) -> str:
    return f"""(SELECT {by}, CAST(sum(pos) + sum(neg) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS n_pos, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg * CAST(0.5 AS DOUBLE))) END AS u,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg * CAST(0.5 AS DOUBLE))) / (sum(pos) * sum(neg)) END AS auc
  FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ({_HISTOGRAM.format(by=by, rows=rows)})) GROUP BY {by})"""


def _breakdown_sql(column: str) -> str:
    return f"""WITH {_SCORES}, t AS (SELECT * FROM ev WHERE split = 'test' AND NOT unscorable), two AS (SELECT {column} AS g, y, "H" FROM t UNION ALL SELECT 'OVERALL', y, "H" FROM t)
SELECT k.g AS {column}, coalesce(n, 0) AS n, coalesce(n_pos, 0) AS n_pos, auc AS "AUC" FROM (SELECT DISTINCT g FROM two) k LEFT JOIN {_auc_sql("two", "g")} a USING (g)"""


@query(_breakdown_sql("task"))
def auc_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.auc_breakdown(_test(spark, sf_dir), "task")


@query(_breakdown_sql("gen_model"))
def auc_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.auc_breakdown(_test(spark, sf_dir), "gen_model")


@query(f"""
WITH r AS (SELECT l_linestatus AS g, l_discount AS "H", CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem), two AS (SELECT * FROM r UNION ALL SELECT 'OVERALL', "H", y FROM r)
SELECT g AS l_linestatus, n, n_pos, auc AS "AUC" FROM {_auc_sql("two", "g")}
""")
def auc_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_discount").alias("H"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return stats.auc_breakdown(rows, "l_linestatus")


_PRF = """CASE WHEN n > 0 THEN coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) END AS "P", CASE WHEN n > 0 THEN coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) END AS "R",
CASE WHEN n > 0 THEN coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) END AS "F1" """


def _counts_sql(theta: str) -> str:
    h = '"H"'
    return f"count({h}) AS n, count(*) FILTER ({h} >= {theta} AND y = 1) AS tp, count(*) FILTER ({h} >= {theta} AND y <> 1) AS fp, count(*) FILTER ({h} < {theta} AND y = 1) AS fn"


@query(f"""
WITH {_SCORES}, t AS (SELECT * FROM ev WHERE split = 'test' AND NOT unscorable), two AS (SELECT task, y, "H" FROM t UNION ALL SELECT 'OVERALL', y, "H" FROM t)
SELECT task, n, {_PRF} FROM (SELECT task, {_counts_sql("CAST(0.8 AS DOUBLE)")} FROM two GROUP BY task)
""")
def prf_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.prf_breakdown(_test(spark, sf_dir), THETA, "task")


@query(f"""
WITH {_SCORES}, t AS (SELECT * FROM ev WHERE split = 'test' AND NOT unscorable),
s AS (SELECT 'EG-only' AS score, "H_eg" AS "H", y FROM t UNION ALL SELECT 'RP-only', "H_rp", y FROM t UNION ALL SELECT 'CFI (H)', "H", y FROM t)
SELECT k.score, coalesce(n, 0) AS n, auc AS "AUC" FROM (SELECT DISTINCT score FROM s) k LEFT JOIN {_auc_sql("s", "score")} a USING (score)
""")
def ablation_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ablation(_test(spark, sf_dir), {"EG-only": "H_eg", "RP-only": "H_rp", "CFI (H)": "H"})


@query(f"""
WITH {_SCORES}, edges(lo, hi) AS (VALUES (0, 1000), (1000, 2000), (2000, 4000), (4000, 8000), (8000, 16000), (16000, 1000000)),
b AS (SELECT '[' || lo || ',' || hi || ')' AS bucket, lo, ev.* FROM ev JOIN edges ON context_len >= lo AND context_len < hi WHERE split = 'test' AND NOT unscorable)
SELECT k.bucket, CAST(lo AS BIGINT) AS low, mean_len, coalesce(n, 0) AS n, coalesce(n_pos, 0) AS n_pos, auc AS "AUC"
FROM (SELECT bucket, lo, round(avg(context_len), 6) AS mean_len FROM b GROUP BY bucket, lo) k LEFT JOIN {_auc_sql("b", "bucket")} a USING (bucket)
""")
def auc_by_length_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.length_buckets(_test(spark, sf_dir), EvalSettings().length_edges)
    return found.withColumn("mean_len", F.round("mean_len", 6))


@query(f"""
WITH {_SCORES}, two AS (SELECT task, * EXCLUDE (task) FROM ev WHERE split = 'test' UNION ALL SELECT 'OVERALL', * EXCLUDE (task) FROM ev WHERE split = 'test')
SELECT task, count(*) AS n, round(avg("Vc"), 6) AS "mean_Vc", round(avg("Ec"), 6) AS "mean_Ec", round(avg("Va"), 6) AS "mean_Va", round(avg("Ea"), 6) AS "mean_Ea",
  round(avg(CAST("Ea" = 0 AS INTEGER)), 6) AS "frac_empty_Ea", round(avg(CAST(unscorable AS INTEGER)), 6) AS frac_unscorable FROM two GROUP BY task
""")
def graph_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.graph_stats(_rows(spark, sf_dir).filter("split = 'test'"))
    return found.select("task", "n", *(F.round(c, 6).alias(c) for c in found.columns[2:]))


@query(f"""
WITH {_SCORES}, t AS (SELECT * FROM ev WHERE split = 'test')
SELECT count(*) AS n_test, count(*) FILTER (unscorable) AS n_unscorable, count(*) FILTER (ref_empty) AS n_ref_empty, count(*) FILTER ("Ea" = 0) AS "n_empty_Ea" FROM t
""")
def degenerate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.degenerate_counts(_rows(spark, sf_dir).filter("split = 'test'"))


@query(f"""
WITH {_SCORES}, t AS (SELECT *, 1 AS one FROM ev WHERE split = 'test'), i AS (SELECT y, one, CASE WHEN unscorable THEN 0.5 ELSE "H" END AS "H" FROM t)
SELECT 'exclude' AS policy, n, n_pos, auc AS "AUC" FROM {_auc_sql("t", "one")} UNION ALL SELECT 'impute', n, n_pos, auc FROM {_auc_sql("i", "one")}
""")
def impute_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = _rows(spark, sf_dir).filter("split = 'test'")
    a, b = stats.auc(test), stats.auc(evaluate.imputed(test, 0.5))
    return a.select(F.lit("exclude").alias("policy"), "n", "n_pos", "AUC").unionByName(b.select(F.lit("impute").alias("policy"), "n", "n_pos", "AUC"))


@query(f"""
WITH {_SCORES}, t AS (SELECT *, 1 AS one FROM ev WHERE split = 'test' AND NOT unscorable)
SELECT n, n_pos, u AS "U", (SELECT median("H") FROM t WHERE y = 1) AS median_pos, (SELECT median("H") FROM t WHERE y <> 1) AS median_neg,
  (SELECT CAST(sum(c * c * c - c) AS DOUBLE) FROM (SELECT count(*) AS c FROM t GROUP BY "H")) AS ties FROM {_auc_sql("t", "one")}
""")
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rank_sum(_test(spark, sf_dir))


@query()
def mann_whitney_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the p-value, which needs functions that SQL does not have."""
    return stats.with_p(stats.rank_sum(_test(spark, sf_dir)))


@query(f"""
WITH {_SCORES}, t AS (SELECT task, y, "H" AS h FROM ev WHERE split = 'test' AND NOT unscorable AND "H" IS NOT NULL),
e AS (SELECT task, y, CASE WHEN min(h) = max(h) THEN min(h) - 0.5 ELSE min(h) END AS a, CASE WHEN min(h) = max(h) THEN max(h) + 0.5 ELSE max(h) END AS b, count(*) AS total FROM t GROUP BY task, y),
p AS (SELECT t.task, t.y, total, (b - a) / 20 AS width, CAST(least(floor((h - a) / ((b - a) / 20)), 19) AS INTEGER) AS bin FROM t JOIN e ON e.task = t.task AND e.y = t.y)
SELECT task, y, bin, count(*) AS n, round(count(*) / (total * width), 6) AS density FROM p GROUP BY task, y, bin, total, width
""")
def histogram_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.histogram(_test(spark, sf_dir), ["task", "y"])
    return found.select("task", "y", "bin", "n", F.round("density", 6).alias("density"))


# -- tuning -------------------------------------------------------------------

_THETA = """
c AS (SELECT "H" AS h, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg FROM ev WHERE split = 'train' AND "H" IS NOT NULL GROUP BY "H"),
w AS (SELECT coalesce((lag(h) OVER (ORDER BY h) + h) / 2, h - CAST(1e-9 AS DOUBLE)) AS theta, sum(pos) OVER (ORDER BY h DESC) AS tp, sum(neg) OVER (ORDER BY h DESC) AS fp, sum(pos) OVER () AS p FROM c),
th AS (SELECT theta, CAST(2 AS DOUBLE) * tp / (tp + fp + p) AS f1 FROM w ORDER BY f1 DESC, theta LIMIT 1)"""


@query(f'WITH {_SCORES}, {_THETA} SELECT theta, f1 AS "F1" FROM th')
def theta_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tune.theta(_scores(spark, sf_dir), ALPHA)


_GRID = f"""
tr AS (SELECT response_id, y, "EG", "RP", row_number() OVER (PARTITION BY y ORDER BY md5('42:' || response_id), response_id) - 1 AS r FROM sc WHERE split = 'train' AND NOT unscorable),
k AS (SELECT least(min(n), 5) AS folds FROM (SELECT count(*) AS n FROM tr GROUP BY y)),
g AS (SELECT CAST(unnest(generate_series(0, 10)) AS INTEGER) AS grid_pos, unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS alpha),
each AS (SELECT y, CASE WHEN folds >= 2 THEN r % folds ELSE 0 END AS fold, grid_pos, alpha, 1 - (CASE WHEN "RP" IS NULL THEN "EG" ELSE alpha * "EG" + (1 - alpha) * "RP" END) AS "H" FROM tr, k, g),
grid AS (SELECT grid_pos, alpha, count(auc) AS n_folds, round(avg(auc), 9) AS auc FROM {_auc_sql("each", "grid_pos, alpha, fold")} GROUP BY grid_pos, alpha)"""


@query(f'WITH {_SCORES}, {_GRID} SELECT grid_pos, alpha, n_folds, auc AS "AUC" FROM grid')
def alpha_grid_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tune.alpha_grid(_scores(spark, sf_dir)).withColumn("AUC", F.round("AUC", 9))


@query(f'WITH {_SCORES}, {_GRID} SELECT alpha, auc AS "AUC" FROM grid ORDER BY auc DESC, grid_pos LIMIT 1')
def alpha_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tune.best_alpha(tune.alpha_grid(_scores(spark, sf_dir)).withColumn("AUC", F.round("AUC", 9)))


@query("""
WITH r AS (SELECT CAST(d.doc_id AS VARCHAR) AS k, 1 - l.quality AS y FROM documents d JOIN labels l USING (doc_id))
SELECT k AS response_id, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42:' || k), k) - 1) % 5 AS INTEGER) AS fold FROM r
""")
def folds_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stratified_folds(split_documents(spark, sf_dir), "response_id", 5, 42).select("response_id", "fold")


@query("SELECT CAST(doc_id AS VARCHAR) AS response_id FROM documents JOIN labels USING (doc_id) ORDER BY md5('42:' || doc_id), CAST(doc_id AS VARCHAR) LIMIT 300")
def sample_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sample(split_documents(spark, sf_dir), "response_id", 300, 42).select("response_id")


@query(f"""
WITH {_embedded(_GRAPH, "[0.5, 0.7]::DOUBLE[]")}, ids AS (SELECT response_id FROM resp WHERE split = 'train' ORDER BY md5('42:' || response_id), response_id LIMIT 300),
h AS (SELECT tau_e, y, 1 - (CASE WHEN "RP" IS NULL THEN "EG" ELSE CAST(0.7 AS DOUBLE) * "EG" + (1 - CAST(0.7 AS DOUBLE)) * "RP" END) AS "H" FROM sc JOIN ids USING (response_id))
SELECT tau_e, tau_r, n, round(auc, 9) AS "AUC" FROM {_auc_sql("h", "tau_e")} CROSS JOIN (SELECT unnest([0.65, 0.85]::DOUBLE[]) AS tau_r)
""")
def tau_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances, g = _graphs(spark, sf_dir, labelled=True)
    settings = Settings(eval=EvalSettings(tau_e_sweep=(0.5, 0.7), tau_r_sweep=(0.65, 0.85)))
    return pipeline.sweep(instances, g, ALPHA, settings, HashEmbedder()).withColumn("AUC", F.round("AUC", 9))


def _bootstrap_sql(metric: str) -> str:
    """Counts of each score and class, drawn anew: ``s`` has (b, h, c, n, times)."""
    return f"""
WITH {_SCORES}, t AS (SELECT "H" AS h, CASE WHEN y = 1 THEN 'pos' ELSE 'neg' END AS c, count(*) AS n FROM ev WHERE split = 'test' AND NOT unscorable AND "H" IS NOT NULL GROUP BY ALL),
k AS (SELECT n, unnest(generate_series(0, CAST(n + 12 * sqrt(n) + 40 AS BIGINT))) AS k FROM (SELECT DISTINCT n FROM t)),
lim AS (SELECT n, list(x ORDER BY x) AS x FROM (SELECT n, CAST(round(4294967296 * sum(exp(k * ln(n) - n - lgamma(k + 1))) OVER (PARTITION BY n ORDER BY k)) AS BIGINT) AS x FROM k) GROUP BY n),
d AS (SELECT b, h, c, n, CAST('0x' || substr(md5('42:' || (b // 4) || ':' || c || ':' || printf('%.17g', h)), CAST(8 * (b % 4) + 1 AS INTEGER), 8) AS BIGINT) AS u FROM t, (SELECT unnest(generate_series(0, 999)) AS b)),
s AS (SELECT b, h, c, n, len(list_filter(x, lambda z: z <= u)) AS times FROM d JOIN lim USING (n)), m AS ({metric})
SELECT round(quantile_cont(v, 0.025), 9) AS lo, round(quantile_cont(v, 0.975), 9) AS hi FROM m"""


@query(_bootstrap_sql("""
SELECT u / (p * q) AS v FROM (SELECT b, sum(pos) AS p, sum(neg) AS q, sum(pos * (below + neg * CAST(0.5 AS DOUBLE))) AS u FROM (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY b ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT b, h, coalesce(sum(times) FILTER (c = 'pos'), 0) AS pos, coalesce(sum(times) FILTER (c = 'neg'), 0) AS neg FROM s GROUP BY b, h)) GROUP BY b) WHERE p > 0 AND q > 0"""))
def bootstrap_auc_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bootstrap_auc(_test(spark, sf_dir), 1000, 42).select(*(F.round(c, 9).alias(c) for c in ("lo", "hi")))


@query(_bootstrap_sql("""
SELECT coalesce(CAST(2 * tp AS DOUBLE) / nullif(tp + fp + p, 0), 0) AS v FROM (SELECT b, coalesce(sum(times) FILTER (c = 'pos'), 0) AS p, coalesce(sum(times) FILTER (c = 'neg'), 0) AS q,
  coalesce(sum(times) FILTER (c = 'pos' AND h >= CAST(0.8 AS DOUBLE)), 0) AS tp, coalesce(sum(times) FILTER (c = 'neg' AND h >= CAST(0.8 AS DOUBLE)), 0) AS fp FROM s GROUP BY b) WHERE p > 0 AND q > 0"""))
def bootstrap_f1_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bootstrap_f1(_test(spark, sf_dir), THETA, 1000, 42).select(*(F.round(c, 9).alias(c) for c in ("lo", "hi")))


# -- set comparisons and documented-only scores -------------------------------


@query(f"""
WITH {_ALL_GRAPH}, g AS (SELECT response_id, entity, 1 AS a FROM ent WHERE kind = 'context'), s AS (SELECT response_id, entity, 1 AS b FROM ent WHERE kind = 'answer'),
n AS (SELECT count(a) AS n_gold, count(b) AS n_said, count(*) FILTER (a = 1 AND b = 1) AS n_both FROM g FULL JOIN s USING (response_id, entity))
SELECT *, CAST(n_both AS DOUBLE) / n_said AS precision, CAST(n_both AS DOUBLE) / n_gold AS recall, CAST(2 * n_both AS DOUBLE) / (n_gold + n_said) AS "F1" FROM n
""")
def set_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph_entities(spark, sf_dir)
    return stats.set_metrics(rows.filter("kind = 'context'"), rows.filter("kind = 'answer'"), ["response_id", "entity"])


@query(f"""
WITH {_ALL_GRAPH}, g AS (SELECT DISTINCT response_id, s, o FROM rel WHERE kind = 'context'), a AS (SELECT DISTINCT response_id, s, o FROM rel WHERE kind = 'answer'),
k AS (SELECT * FROM a SEMI JOIN (SELECT DISTINCT response_id, s FROM g) USING (response_id, s))
SELECT count(*) AS n_pairs, count(g.o) AS n_agree, CAST(count(g.o) AS DOUBLE) / nullif(count(*), 0) AS agreement FROM k LEFT JOIN g USING (response_id, s, o)
""")
def conditional_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph_relations(spark, sf_dir)
    return stats.conditional_agreement(rows.filter("kind = 'context'"), rows.filter("kind = 'answer'"), ["response_id", "s"], "o")


@query(f"""
WITH {_ALL_SCORES}, c AS (SELECT a.response_id, CASE WHEN c.s IS NOT NULL THEN CAST(0 AS DOUBLE) ELSE 1 END AS w, row_number() OVER (PARTITION BY a.response_id ORDER BY (c.s IS NOT NULL)) AS r
  FROM rel a LEFT JOIN rel c ON c.response_id = a.response_id AND c.kind = 'context' AND c.s = a.s AND c.o = a.o WHERE a.kind = 'answer'),
k AS (SELECT response_id, avg(w) AS risk FROM c WHERE r <= 3 GROUP BY response_id)
SELECT response_id, round(CAST(0.5 AS DOUBLE) * (1 - "EG") + CAST(0.5 AS DOUBLE) * risk, 9) AS "H" FROM sc LEFT JOIN k USING (response_id)
""")
def claim_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims judged by alignment: documented by formula only, not a reproduction."""
    instances, g = _graphs(spark, sf_dir)
    scored = score.score(g.answers, g.sources)
    claims = scored.select("response_id", F.explode(F.concat(F.transform("supported_relations", lambda _: F.lit("entailed")), F.transform("unsupported_relations", lambda _: F.lit("unsupported")))).alias("verdict"))
    worst = stats.worst_claims(claims, {"entailed": 0.0, "unsupported": 1.0}, 3)
    return stats.critical_risk(scored, worst).select("response_id", F.round("H", 9).alias("H"))


@query(f"""
WITH {_ALL_GRAPH}, n AS (SELECT response_id || ':' || kind AS owner, row_number() OVER (ORDER BY sha256('{{"chunk_chars": 6000, "cluster": true, "model": "offline", "temperature": 0.0, "v": 1}}' || chr(0) || t), response_id || ':' || kind) AS cum_calls
  FROM (SELECT response_id, kind, regexp_replace(text, '^[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g') AS t FROM kinds) WHERE t <> '')
SELECT owner, cum_calls, CAST(0 AS BIGINT) AS cum_prompt_tokens FROM n
""")
def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    instances = split_documents(spark, sf_dir, labelled=False)
    texts = instances.select(F.explode(F.array(*(F.struct(F.concat(F.col("response_id"), F.lit(f":{k}")).alias("owner"), F.col(c).alias("text")) for k, c in (("context", "context"), ("answer", "response"))))).alias("x")).select("x.*")
    _, log = graph.extract(texts, graph.OfflineExtractor())
    return sinks.running_calls(log).select("owner", F.col("cum_calls").cast("long").alias("cum_calls"), "cum_prompt_tokens")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: answers scored against their sources, with what is not grounded."""
    return _scores(spark, sf_dir).select("response_id", "task", "gen_model", "split", "y", "Va", "Ea", "EG", "RP", text.risk(F.col("EG"), F.col("RP"), ALPHA).alias("H"), "ungrounded_entities")
