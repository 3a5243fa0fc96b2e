"""Splits, memorisation and scores over documents, with predictions made from hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..operators import labelseq as ls
from ..operators import metrics as m
from ..operators import splits as sp
from ..operators import tokens as tk
from .text_queries import TOKENS, labelled_lists
from .tree import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


SPLIT = """SELECT doc_id, CASE WHEN r <= least(9999, floor(n * 0.1::DOUBLE)) THEN 'eval' WHEN r <= 2 * least(9999, floor(n * 0.1::DOUBLE)) THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER () AS n FROM documents)"""
COIN = "CAST(concat('0x', substr(md5(concat(CAST(doc_id AS VARCHAR), '/{0}')), 1, 8)) AS BIGINT) < CAST({1} * 4294967296 AS BIGINT)"


@query(SPLIT)
def doc_split(spark, sf_dir):
    return sp.document_split(table(spark, sf_dir, "documents"))


@query(f"SELECT split, CAST(sum(CASE WHEN length(text) > 80 THEN 1 ELSE 0 END) AS BIGINT) AS saved, count(*) AS total, CAST(count(*) - sum(CASE WHEN length(text) > 80 THEN 1 ELSE 0 END) AS BIGINT) AS filtered FROM documents JOIN ({SPLIT}) USING (doc_id) GROUP BY split")
def split_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sp.split_counts(docs.select("doc_id", F.length("text").alias("n")).join(sp.document_split(docs), "doc_id"), F.col("n") > 80)


@query("SELECT doc_id FROM documents WHERE " + COIN.format("sample", 0.25))
def sample_bernoulli(spark, sf_dir):
    return sp.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.25)


PRED = TOKENS + """, pred AS (
  SELECT doc_id, pos, word, iob2, CASE WHEN h IN ('0', '1') THEN 'O' WHEN h = '2' THEN 'I-GENEPROD' ELSE iob2 END AS predicted FROM (SELECT *, substr(md5(concat(word, '/', CAST(pos AS VARCHAR))), 1, 1) AS h FROM gold)
)"""


def runs_sql(source: str, tag: str, name: str) -> str:
    return f""", {name}_rows AS (
  SELECT *, lag(kind) OVER w AS pk, lag(label) OVER w AS pl FROM (SELECT doc_id, pos, word, CASE WHEN {tag} = 'O' THEN 'O' ELSE substr({tag}, 1, 1) END AS kind, CASE WHEN {tag} <> 'O' THEN substr({tag}, 3) END AS label FROM {source}) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), {name}_isl AS (
  SELECT *, sum(CASE WHEN kind = 'I' AND coalesce(pk, 'O') <> 'O' AND pl = label THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS isl FROM {name}_rows
), {name} AS (
  SELECT doc_id, label, min(pos) AS first, max(pos) AS last, arg_min(kind, pos) AS head, string_agg(word, ' ' ORDER BY pos) AS text FROM {name}_isl WHERE kind <> 'O' GROUP BY doc_id, isl, label
)"""


BOTH = PRED + runs_sql("pred", "iob2", "truth") + runs_sql("pred", "predicted", "guess")
RATES = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp::DOUBLE / (tp + fp), {0}) END AS \"precision\", CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp::DOUBLE / (tp + fn), {0}) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE round(2 * tp::DOUBLE / (2 * tp + fp + fn), {0}) END AS f1"
MATCH = """SELECT {keys}, t.first IS NOT NULL AS in_truth, g.first IS NOT NULL AS in_predicted FROM {truth} t FULL JOIN {guess} g ON t.doc_id = g.doc_id AND t.label = g.label AND t.first = g.first AND t.last = g.last"""
COUNTS = "CAST(count(*) FILTER (in_truth AND in_predicted) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT in_truth AND in_predicted) AS BIGINT) AS fp, CAST(count(*) FILTER (in_truth AND NOT in_predicted) AS BIGINT) AS fn"


def predicted_lists(spark, sf_dir):
    """labelled_lists() with a predicted tag from a hash of the word and its place."""
    rows = labelled_lists(spark, sf_dir)
    h = rows.withColumn("_h", F.transform("tokens", lambda x: F.substring(F.md5(F.concat(x["word"], F.lit("/"), x["pos"].cast("string"))), 1, 1)))
    tag = lambda c, x: F.when(c.isin("0", "1"), "O").when(c == "2", "I-GENEPROD").otherwise(x["iob2"])
    return h.withColumn("tokens", tk.with_field("tokens", "predicted", lambda x, i: tag(F.get("_h", i), x))).drop("_h")


def predicted(spark, sf_dir):
    return tk.rows_of(predicted_lists(spark, sf_dir), "tokens", "doc_id")


def matched(spark, sf_dir, strict):
    return m.match_lists(predicted_lists(spark, sf_dir), "iob2", "predicted", strict=strict)


@query(BOTH + "SELECT doc_id, label, first, text FROM truth")
def entity_runs(spark, sf_dir):
    return entities(labelled_lists(spark, sf_dir))


ENT = BOTH + f", split AS ({SPLIT}), train_ent AS (SELECT DISTINCT label, text FROM truth JOIN split USING (doc_id) WHERE split = 'train'), test_ent AS (SELECT DISTINCT label, text FROM truth JOIN split USING (doc_id) WHERE split = 'test'), only_test AS (SELECT * FROM test_ent EXCEPT SELECT * FROM train_ent)"


def entities(rows, *keep):
    return tk.rows_of(ls.run_lists(rows, ["iob2"], word="word"), "runs", "doc_id", *keep).select("doc_id", *keep, "label", "first", "text")


def entities_by_split(spark, sf_dir, *wanted):
    """Entities of the documents of some splits; the split goes with the document, before it is tokens."""
    docs = table(spark, sf_dir, "documents")
    split = sp.document_split(docs).where(F.col("split").isin(*wanted))
    return entities(labelled_lists(spark, sf_dir, docs.select("doc_id", "text").join(split, "doc_id"), ["split"]), "split")


def only_in_test(spark, sf_dir):
    """label, text of entities that test documents have and training documents have not, from one grouping that is summed on the map side."""
    e = entities_by_split(spark, sf_dir, "test", "train").groupBy("label", "text").agg(F.bool_or(F.col("split") == "test").alias("tested"), F.bool_or(F.col("split") == "train").alias("trained"))
    return e.where("tested and not trained").select("label", "text")


@query(ENT + "SELECT label, text FROM only_test")
def test_only_entities(spark, sf_dir):
    return only_in_test(spark, sf_dir)


@query(ENT + "SELECT doc_id, first, label, text, (label, text) IN (SELECT (label, text) FROM only_test) AS only_in_test FROM truth JOIN split USING (doc_id) WHERE split = 'test'")
def only_in_test_mask(spark, sf_dir):
    fresh = only_in_test(spark, sf_dir).withColumn("only_in_test", F.lit(True))
    tested = entities_by_split(spark, sf_dir, "test")
    return tested.join(fresh, ["label", "text"], "left").select("doc_id", "first", "label", "text", F.coalesce("only_in_test", F.lit(False)).alias("only_in_test"))


@query(ENT + """, seen AS (SELECT coalesce(t.label, g.label) AS label, coalesce(t.text, g.text) AS text, t.first IS NOT NULL AS in_truth, g.first IS NOT NULL AS in_predicted, coalesce(t.doc_id, g.doc_id) AS doc_id
  FROM truth t FULL JOIN guess g ON t.doc_id = g.doc_id AND t.label = g.label AND t.first = g.first AND t.last = g.last)
, flagged AS (SELECT seen.*, train_ent.text IS NOT NULL AS in_training FROM seen JOIN split USING (doc_id) LEFT JOIN train_ent ON seen.label = train_ent.label AND seen.text = train_ent.text WHERE split = 'test')
SELECT in_training, label, tp, fp, fn, """ + RATES.format(9) + ", tp + fn AS support FROM (SELECT in_training, label, " + COUNTS + " FROM flagged GROUP BY in_training, label)")
def memorization_report(spark, sf_dir):
    split = sp.document_split(table(spark, sf_dir, "documents"))
    return m.memorisation(m.match_lists(predicted_lists(spark, sf_dir), "iob2", "predicted", word="word"), split)


@query(PRED + "SELECT round(avg(CASE WHEN iob2 = predicted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy, count(*) AS n FROM pred")
def token_accuracy(spark, sf_dir):
    return m.token_accuracy(predicted(spark, sf_dir), "iob2", "predicted").withColumn("accuracy", F.round("accuracy", 9))


def prf_sql(where: str) -> str:
    return BOTH + f", tr AS (SELECT * FROM truth {where}), gu AS (SELECT * FROM guess {where}) SELECT tp, fp, fn, {RATES.format(9)}, tp + fn AS support FROM (SELECT {COUNTS} FROM ({MATCH.format(keys='1 AS one', truth='tr', guess='gu')}))"


@query(prf_sql("WHERE head = 'B'"))
def entity_prf_strict(spark, sf_dir):
    return m.prf(matched(spark, sf_dir, True))


@query(prf_sql(""))
def entity_prf_lenient(spark, sf_dir):
    return m.prf(matched(spark, sf_dir, False))


@query(BOTH + f""", c AS (SELECT label, {COUNTS} FROM ({MATCH.format(keys='coalesce(t.label, g.label) AS label', truth='truth', guess='guess')}) GROUP BY label)
, r AS (SELECT label, {RATES.format(15)}, tp + fn AS support FROM c)
SELECT label, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM (
  SELECT * FROM r UNION ALL SELECT 'micro avg', {RATES.format(15)}, tp + fn FROM (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c)
  UNION ALL SELECT 'macro avg', avg("precision"), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM r
  UNION ALL SELECT 'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM r)""")
def class_report(spark, sf_dir):
    return m.class_report(matched(spark, sf_dir, False))


@query(PRED + "SELECT round(avg(CASE WHEN iob2 = predicted THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS recall, count(*) AS n FROM pred WHERE substr(md5(word), 2, 1) IN ('0', '1')")
def masked_recall(spark, sf_dir):
    t = predicted(spark, sf_dir)
    ids = {x: i for i, x in enumerate(["O", "B-GENEPROD", "I-GENEPROD", "B-SMALL_MOLECULE", "I-SMALL_MOLECULE", "B-TISSUE", "I-TISSUE"])}
    code = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    chosen = F.substring(F.md5("word"), 2, 1).isin("0", "1")
    t = t.select(F.when(chosen, code[F.col("iob2")]).otherwise(lb.IGNORE).alias("truth"), code[F.col("predicted")].alias("guess"))
    return m.masked_recall(t, "truth", "guess").withColumn("recall", F.round("recall", 9))


@query(BOTH + "SELECT coalesce(t.doc_id, g.doc_id) AS doc_id, coalesce(t.first, g.first) AS first, CASE WHEN t.first IS NOT NULL AND g.first IS NOT NULL THEN 'TP' WHEN t.first IS NOT NULL THEN 'FN' ELSE 'FP' END AS outcome FROM truth t FULL JOIN guess g ON t.doc_id = g.doc_id AND t.first = g.first")
def boundary_tp_fp_fn(spark, sf_dir):
    return m.outcomes(m.match_lists(predicted_lists(spark, sf_dir), "iob2", "predicted", on=("first",)), "doc_id", "first")
