"""Inference, seq2seq, collation and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as v
from ..operators import collate as co
from ..operators import inference as inf
from ..operators import labelseq as ls
from ..operators import latent as la
from ..operators import seq2seq as sq
from ..operators import splits as sp
from ..operators import tokens as tk
from .eval_queries import runs_sql
from .text_queries import TOKENS, labelled_lists, with_tokens
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


WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}]+|[^ \p{L}\p{N}]')"
CHUNKS = f"""WITH n AS (SELECT doc_id, CAST(len({WORDS}) AS BIGINT) AS n FROM documents),
k AS (SELECT doc_id, n, CAST(unnest(range(0, 1 + CASE WHEN n <= 510 THEN 0 ELSE CAST(ceil((n - 510) / 460.0) AS BIGINT) END)) AS INTEGER) AS chunk FROM n WHERE n > 0),
chunks AS (SELECT doc_id, chunk, CAST(chunk * 460 AS BIGINT) AS first, CAST(least(chunk * 460 + 510, n) AS BIGINT) AS last FROM k)
"""


def lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.words("text")).cast("long").alias("n"))


@query(CHUNKS + "SELECT * FROM chunks")
def window_chunks(spark, sf_dir):
    return inf.windows(lengths(spark, sf_dir), "doc_id", "n", 510, 50)


@query(CHUNKS + "SELECT doc_id, pos, min(chunk) AS chunk FROM (SELECT doc_id, chunk, unnest(range(first, last)) AS pos FROM chunks) GROUP BY doc_id, pos")
def stitch_chunks(spark, sf_dir):
    places = inf.in_windows(window_chunks(spark, sf_dir), "doc_id")
    return inf.stitch(places, "doc_id").select("doc_id", "pos", "chunk")


VEC = "CAST(embedding AS DOUBLE[])"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


@query(f"SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS class, round(1.0 / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 9) AS probability FROM (SELECT vec_id, {VEC} AS e FROM embeddings)")
def softmax_argmax(spark, sf_dir):
    top, p = inf.top_class(F.col("e"))
    return vectors(spark, sf_dir).select("vec_id", top.alias("class"), F.round(p, 9).alias("probability"))


SUBS = f"WITH subs AS (SELECT vec_id // 3 AS word_id, vec_id % 3 AS pos, {VEC}[1:8] AS s FROM embeddings)"
CLASS = "CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS class, round(list_max(s), 9) AS score"


def subwords(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 3).cast("long").alias("word_id"), (F.col("vec_id") % 3).alias("pos"), F.slice("e", 1, 8).alias("s"))


def shown(words):
    return words.withColumn("score", F.round("score", 9))


@query(SUBS + f" SELECT word_id, {CLASS} FROM (SELECT word_id, arg_min(s, pos) AS s FROM subs GROUP BY word_id)")
def word_agg_first(spark, sf_dir):
    return shown(inf.words_first(subwords(spark, sf_dir), ["word_id"], "pos", "s"))


@query(SUBS + f" SELECT word_id, {CLASS} FROM (SELECT word_id, s, row_number() OVER (PARTITION BY word_id ORDER BY list_max(s) DESC, pos) AS r FROM subs) WHERE r = 1")
def word_agg_max(spark, sf_dir):
    return shown(inf.words_max(subwords(spark, sf_dir), ["word_id"], "pos", "s"))


@query(SUBS + f" SELECT word_id, {CLASS} FROM (SELECT word_id, [{', '.join(f'avg(s[{i}])' for i in range(1, 9))}] AS s FROM subs GROUP BY word_id)")
def word_agg_average(spark, sf_dir):
    return shown(inf.words_average(subwords(spark, sf_dir), ["word_id"], "pos", "s", 8))


ISLANDS = TOKENS + """, tagged AS (SELECT doc_id, pos, "start", "end", iob2 AS tag, CAST(length(word) AS DOUBLE) AS score FROM gold)
, isl AS (SELECT *, sum(CASE WHEN lag_g = g AND NOT starts_with(tag, 'B-') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM
  (SELECT *, lag(g) OVER (PARTITION BY doc_id ORDER BY pos) AS lag_g FROM (SELECT *, CASE WHEN tag = 'O' THEN 'O' ELSE substr(tag, 3) END AS g FROM tagged)))
, groups AS (SELECT doc_id, g AS entity_group, min("start") AS "start", max("end") AS "end", avg(score) AS score FROM isl GROUP BY doc_id, k, g)
"""


@query(ISLANDS + 'SELECT doc_id, entity_group, "start", "end", round(score, 9) AS score FROM groups')
def entity_islands(spark, sf_dir):
    t = labelled_lists(spark, sf_dir).withColumn("tokens", tk.with_field("tokens", "length", lambda x, i: F.length(x["word"]).cast("double")))
    groups = tk.rows_of(inf.group_lists(t, "iob2", "length"), "groups", "doc_id")
    return groups.select("doc_id", "entity_group", "start", "end", F.round("score", 9).alias("score"))


PANELS = TOKENS + """, ptag AS (SELECT doc_id, pos, "start", "end", CASE WHEN substr(md5(word), 1, 2) = '0f' OR word = '|' THEN 'B-PANEL_START' ELSE 'O' END AS tag FROM tok)
, pk AS (SELECT *, sum(CASE WHEN tag <> 'O' OR lag_t IS NULL OR lag_t <> 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM (SELECT *, lag(tag) OVER (PARTITION BY doc_id ORDER BY pos) AS lag_t FROM ptag))
, pg AS (SELECT doc_id, k, tag, min("start") AS s, max("end") AS e FROM pk GROUP BY doc_id, k, tag)
, po AS (SELECT *, last_value(CASE WHEN tag <> 'O' THEN s END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opened, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS nth, lead(s) OVER (PARTITION BY doc_id ORDER BY k) AS nxt FROM pg)
, panels AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS panel, coalesce(opened, s) AS "start", e AS "end" FROM po WHERE (tag = 'O' OR nxt IS NULL) AND (opened IS NOT NULL OR nth = 1))
"""


def with_panels(rows):
    """Documents' token lists with a list of their panels."""
    mark = lambda w: F.when((F.substring(F.md5(w), 1, 2) == "0f") | (w == "|"), "B-PANEL_START").otherwise("O")
    tagged = rows.withColumn("_tagged", tk.with_field("tokens", "tag", lambda x, i: mark(x["word"])))
    return inf.panel_lists(inf.group_lists(tagged, "tag", items="_tagged", name="_groups").drop("_tagged"), "_groups").drop("_groups")


def panel_table(spark, sf_dir):
    return tk.rows_of(with_panels(tk.token_lists(table(spark, sf_dir, "documents"))), "panels", "doc_id")


@query(PANELS + "SELECT * FROM panels")
def panel_segments(spark, sf_dir):
    return panel_table(spark, sf_dir)


# DuckDB would compute these more than once.
ONCE = (", tok AS (", ", gold AS (", ", panels AS (", ", ent0 AS (")


def once(sql: str) -> str:
    for name in ONCE:
        sql = sql.replace(name, name.replace(" AS (", " AS MATERIALIZED ("))
    return sql


INSIDE = once(PANELS + runs_sql("gold", "iob2", "ent0")) + """, ent AS MATERIALIZED (SELECT e.doc_id, e.label AS type, a."start" AS "start", b."end" AS "end", e.text FROM ent0 e JOIN tok a ON e.doc_id = a.doc_id AND e.first = a.pos JOIN tok b ON e.doc_id = b.doc_id AND e.last = b.pos)
, inside AS (SELECT ent.*, panel FROM ent ASOF JOIN panels p ON ent.doc_id = p.doc_id AND ent."start" >= p."start" WHERE ent."start" < p."end" AND ent."end" <= p."end")
"""


def entity_table(spark, sf_dir):
    groups = tk.rows_of(inf.group_lists(labelled_lists(spark, sf_dir), "iob2", word="word", entities=True), "groups", "doc_id")
    return groups.select("doc_id", F.col("entity_group").alias("type"), "start", "end", "text")


@query(INSIDE + "SELECT doc_id, panel, type, \"start\", \"end\" FROM inside")
def entity_in_panel(spark, sf_dir):
    rows = inf.group_lists(with_panels(labelled_lists(spark, sf_dir)), "iob2", entities=True, name="entities").drop("tokens")
    inside = tk.rows_of(inf.inside_panels(rows), "entities", "doc_id")
    return inside.select("doc_id", "panel", F.col("entity_group").alias("type"), "start", "end")


@query(TOKENS + runs_sql("gold", "iob2", "ent0") + """, span AS (SELECT e.doc_id, a."start" AS s, b."end" AS e FROM ent0 e JOIN tok a ON e.doc_id = a.doc_id AND e.first = a.pos JOIN tok b ON e.doc_id = b.doc_id AND e.last = b.pos)
SELECT p.doc_id, string_agg(CASE WHEN s IS NULL THEN piece WHEN p.e - length(piece) = s THEN '[MASK]' ELSE '' END, '' ORDER BY i) AS masked FROM placed p LEFT JOIN span ON p.doc_id = span.doc_id AND p.e - length(piece) >= s AND p.e - length(piece) < span.e GROUP BY p.doc_id""")
def mask_sentence(spark, sf_dir):
    rows = labelled_lists(spark, sf_dir, keep=["text"])
    return inf.masked_lists(inf.group_lists(rows, "iob2", entities=True, name="spans"))


ROLE = "CASE substr(md5(text), 1, 1) WHEN '0' THEN 'intervention' WHEN '1' THEN 'intervention' WHEN '2' THEN 'assayed' WHEN '3' THEN 'assayed' END"


def role_of(text):
    """As ROLE has it."""
    h = F.substring(F.md5(text), 1, 1)
    return F.when(h.isin("0", "1"), "intervention").when(h.isin("2", "3"), "assayed")


@query(INSIDE + f'SELECT doc_id, type, "start", "end", {ROLE} AS role FROM ent')
def attach_roles(spark, sf_dir):
    e = entity_table(spark, sf_dir)
    found = e.select("doc_id", "start", "end", "type", F.expr(ROLE).alias("role")).where("role is not null")
    twice = F.explode(F.array(F.struct(F.lit(0).alias("nth"), F.lit("overwritten").alias("role")), F.struct(F.lit(1).alias("nth"), F.col("role").alias("role"))))
    found = found.select("doc_id", "start", "end", "type", twice.alias("x")).select("doc_id", "start", "end", "type", "x.*")
    return inf.attach_roles(e, found, "doc_id", "nth").select("doc_id", "type", "start", "end", "role")


@query(INSIDE + f""", held AS (SELECT doc_id, panel, list({{'start': "start", 'end': "end", 'text': text, 'type': type, 'role': {ROLE}}} ORDER BY "start") AS entities FROM inside GROUP BY doc_id, panel)
SELECT p.doc_id, CAST(to_json(list({{'panel': p.panel, 'start': p."start", 'end': p."end", 'entities': coalesce(h.entities, [])}} ORDER BY p.panel)) AS VARCHAR) AS tagged FROM panels p LEFT JOIN held h ON p.doc_id = h.doc_id AND p.panel = h.panel GROUP BY p.doc_id""")
def tagged_json(spark, sf_dir):
    rows = inf.group_lists(with_panels(labelled_lists(spark, sf_dir, with_tokens(spark, sf_dir))), "iob2", word="word", entities=True, name="entities")
    role = F.transform("entities", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["entity_group"].alias("type"), role_of(x["text"]).alias("role")))
    return inf.json_lists(rows.select("doc_id", "panels", role.alias("entities")), "doc_id")


LABELS = ("GENEPROD", "TISSUE")


@query(TOKENS + runs_sql("gold", "iob2", "ent") + """, once AS (SELECT doc_id, label, text, min(first) AS first FROM ent GROUP BY doc_id, label, text)
, listed AS (SELECT doc_id, string_agg(text, ', ' ORDER BY first) FILTER (label = 'GENEPROD') AS a, string_agg(text, ', ' ORDER BY first) FILTER (label = 'TISSUE') AS b FROM once GROUP BY doc_id)
SELECT documents.doc_id, concat('GENEPROD: ', a, ' ', chr(10), 'TISSUE: ', b, ' ', chr(10), ' [END]') AS output_text FROM documents LEFT JOIN listed USING (doc_id)""")
def entity_list_text(spark, sf_dir):
    return sq.listed(ls.run_lists(labelled_lists(spark, sf_dir), ["iob2"], word="word"), LABELS)


COPY = TOKENS + """, ins AS (SELECT *, CASE WHEN iob2 <> 'O' AND label IN ('GENEPROD', 'TISSUE') THEN label END AS inside FROM gold)
, moved AS (SELECT *, lag(inside) OVER w AS bef, lead(word) OVER w IS NULL AS fin FROM ins WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
, copied AS (SELECT doc_id, string_agg(concat(CASE WHEN bef IS NOT NULL AND NOT starts_with(iob2, 'I-') THEN concat('</', bef, '> ') ELSE '' END, CASE WHEN inside IS NOT NULL AND starts_with(iob2, 'B-') THEN concat('<', inside, '> ') ELSE '' END, word, ' ', CASE WHEN fin AND inside IS NOT NULL THEN concat('</', inside, '> ') ELSE '' END), '' ORDER BY pos) AS tagged FROM moved GROUP BY doc_id)
"""


@query(COPY + "SELECT doc_id, coalesce(tagged, '') AS tagged FROM documents LEFT JOIN copied USING (doc_id)")
def copy_and_tag(spark, sf_dir):
    return sq.copy_lists(labelled_lists(spark, sf_dir), LABELS)


@query(COPY + "SELECT doc_id, list_sort(list_distinct(regexp_extract_all(coalesce(tagged, ''), '<GENEPROD> (.*?) </GENEPROD>', 1))) AS geneprods FROM documents LEFT JOIN copied USING (doc_id)")
def separate_labels(spark, sf_dir):
    return copy_and_tag(spark, sf_dir).select("doc_id", F.array_sort(tx.between_tags("tagged", "GENEPROD")).alias("geneprods"))


PAIRS = "WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), pairs AS (SELECT conv_id, turn, text AS question, answer FROM t WHERE role = 'user' AND next_role = 'assistant')"


def pairs(spark, sf_dir):
    return sq.next_turns(table(spark, sf_dir, "conversations"))


@query(PAIRS + " SELECT conv_id, turn, concat(question, chr(10), chr(10), '###', chr(10), chr(10)) AS prompt, concat(' ', answer, ' [END]') AS completion FROM pairs")
def prompt_completion(spark, sf_dir):
    return sq.prompt_completion(pairs(spark, sf_dir))


@query("SELECT event_id, CASE WHEN s IN ('train', 'trainset') THEN 'train' WHEN s IN ('validation', 'eval') THEN 'validation' WHEN s IN ('test', 'testset') THEN 'test' END AS split FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'trainset' WHEN 'click' THEN 'eval' WHEN 'error' THEN 'testset' WHEN 'signup' THEN 'validation' ELSE event_type END AS s FROM events)")
def subset_normalize(spark, sf_dir):
    t = F.col("event_type")
    s = F.when(t == "view", "Trainset").when(t == "click", "eval ").when(t == "error", "testset").when(t == "signup", "validation").otherwise(t)
    return table(spark, sf_dir, "events").select("event_id", tx.split_name(s).alias("split"))


IDS = "list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+|[^ \\p{{L}}\\p{{N}}]'), lambda w: CAST(concat('0x', substr(md5(w), 1, 4)) AS INTEGER))"


def ids(text: str):
    return F.transform(tx.words(text), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int"))


def pair_query(name: str, mode: str, left: str, right: str):
    def f(spark, sf_dir):
        coin = sp.coin(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")), "task", 0.5)
        return sq.pair_rows(pairs(spark, sf_dir), ids("question"), ids("answer"), mode, coin)

    f.__name__ = name
    query(PAIRS + f", i AS (SELECT conv_id, turn, {IDS.format('question')} AS q, {IDS.format('answer')} AS a, CAST(concat('0x', substr(md5(concat(conv_id, '-', turn, '/task')), 1, 8)) AS BIGINT) < 2147483648 AS heads FROM pairs) SELECT conv_id, turn, {left} AS input_ids, {right} AS labels FROM i")(f)


pair_query("qanda", "QandA", "q", "a")
pair_query("aandq", "AandQ", "a", "q")
pair_query("next", "NEXT", "list_concat(q, a)", "list_concat(q, a)")
pair_query("multitask", "MULTITASK", "CASE WHEN heads THEN q ELSE a END", "CASE WHEN heads THEN a ELSE q END")

MASKED = f"WITH d AS (SELECT doc_id, {IDS.format('text')} AS ids, list_transform({WORDS}, lambda w: CASE WHEN substr(md5(w), 2, 1) IN ('0', '1', '2', '3') THEN 1 ELSE 0 END) AS m FROM documents)"


def draw_sql(salt: str) -> str:
    return f"CAST(concat('0x', substr(md5(concat(doc_id, '/', i - 1, '/{salt}')), 1, 8)) AS BIGINT)"


def id_rows(spark, sf_dir):
    mask = F.transform(tx.words("text"), lambda w: F.when(F.substring(F.md5(w), 2, 1).isin("0", "1", "2", "3"), 1).otherwise(0))
    return table(spark, sf_dir, "documents").select("doc_id", ids("text").alias("ids"), mask.alias("m"))


@query(MASKED + """, b AS (SELECT doc_id // 8 AS batch, CAST(ceil(max(len(ids)) / 8.0) * 8 AS INTEGER) AS n FROM d GROUP BY doc_id // 8)
SELECT doc_id, batch, list_concat(ids, list_transform(range(0, n - len(ids)), lambda _: 0)) AS ids, list_concat(m, list_transform(range(0, n - len(ids)), lambda _: -100)) AS labels, list_concat(list_transform(ids, lambda _: 1), list_transform(range(0, n - len(ids)), lambda _: 0)) AS attention_mask FROM d JOIN b ON d.doc_id // 8 = b.batch""")
def pad_batch(spark, sf_dir):
    rows = id_rows(spark, sf_dir).select("doc_id", F.floor(F.col("doc_id") / 8).cast("long").alias("batch"), "ids", F.col("m").alias("labels"))
    return co.pad_batches(rows, "batch", "ids", "labels").select("doc_id", "batch", "ids", "labels", "attention_mask")


@query(MASKED + f"SELECT doc_id, list_transform(list_zip(ids, m), lambda z, i: CASE WHEN z[2] > 0 AND {draw_sql('mask')} < 2147483648 THEN 4 ELSE z[1] END) AS masked_ids, list_transform(list_zip(ids, m), lambda z, i: CASE WHEN z[2] > 0 AND {draw_sql('mask')} < 2147483648 THEN z[1] ELSE -100 END) AS labels FROM d")
def targeted_masking(spark, sf_dir):
    return co.mask_targets(id_rows(spark, sf_dir), "doc_id", "ids", "m", 0.5, 4).select("doc_id", "masked_ids", "labels")


@query(MASKED + f"SELECT doc_id, list_transform(list_zip(ids, m), lambda z, i: CASE WHEN z[2] > 0 AND {draw_sql('mask')} < 2147483648 THEN 4 WHEN z[2] > 0 AND {draw_sql('replace')} < 1073741824 THEN CAST({draw_sql('random')} % 50265 AS INTEGER) ELSE z[1] END) AS masked_ids FROM d")
def random_replace(spark, sf_dir):
    return co.mask_or_replace(id_rows(spark, sf_dir), "doc_id", "ids", "m", "m", 0.5, 0.25, 4, 50265).select("doc_id", "masked_ids")


@query(f"""WITH v AS (SELECT vec_id, {VEC} AS e FROM embeddings), a AS (SELECT e FROM v WHERE vec_id % 2 = 0), b AS (SELECT e FROM v WHERE vec_id % 2 = 1),
k AS (SELECT 1.0 AS w, x.e AS x, y.e AS y, 1 AS g FROM a x, a y UNION ALL SELECT 1.0, x.e, y.e, 2 FROM b x, b y UNION ALL SELECT -2.0, x.e, y.e, 3 FROM a x, b y),
m AS (SELECT g, max(w) AS w, avg(exp(-(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(x)) / len(x))) AS k FROM k GROUP BY g)
SELECT CAST(round(sum(w * k), 6) AS DOUBLE) AS mmd FROM m""")
def mmd_rbf(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return la.mmd(rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1"), "e").select(F.round("mmd", 6).alias("mmd"))


@query(f"""WITH p AS (SELECT {VEC}[1:32] AS z1, {VEC}[33:64] AS z2 FROM embeddings), n AS (SELECT count(*) AS n FROM p),
a AS (SELECT unnest(z1) AS x, unnest(range(0, 32)) AS i, z2 FROM p), b AS (SELECT i, x, unnest(z2) AS y, unnest(range(0, 32)) AS j FROM a)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(x * y) / max(n), 6) AS c FROM b, n GROUP BY i, j""")
def twin_cross_correlation(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.slice("e", 1, 32).alias("z1"), F.slice("e", 33, 32).alias("z2"))
    return la.cross_correlation(rows, "z1", "z2").select("i", "j", F.round("c", 6).alias("c"))


@query(f"SELECT vec_id, round(-0.5 * list_sum(list_transform(list_zip({VEC}[1:32], {VEC}[33:64]), lambda z: 1 + z[2] - z[1] * z[1] - exp(z[2]))), 9) AS kl FROM embeddings")
def kl_loss(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.round(v.kl_loss(F.slice("e", 1, 32), F.slice("e", 33, 32)), 9).alias("kl"))


@query("SELECT event_id, round(1 - CASE WHEN max(value) OVER w = min(value) OVER w THEN 0.0 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 9) AS scaled FROM events WINDOW w AS (PARTITION BY user_id)")
def minmax_image(spark, sf_dir):
    return co.min_max(table(spark, sf_dir, "events"), "value", ["user_id"]).select("event_id", F.round("scaled", 9).alias("scaled"))


@query(f"SELECT round(sum(w * -ln(p)) / sum(w), 6) AS loss FROM (SELECT 1.0 / list_sum(list_transform(e, lambda x: exp(x - e[label + 1]))) AS p, 0.2 + 0.07 * label AS w FROM (SELECT {VEC} AS e, label FROM embeddings))")
def weighted_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("e"), "label")
    p = F.get(v.softmax(F.col("e")), F.col("label"))
    return co.weighted_cross_entropy(rows.withColumn("p", p), F.col("p"), F.lit(0.2) + F.lit(0.07) * F.col("label")).select(F.round("loss", 6).alias("loss"))


@query("SELECT avg(value) AS eval_value, avg(CAST(user_id AS DOUBLE)) AS eval_user_id FROM events".replace("avg(value)", "round(avg(value), 6)").replace("avg(CAST(user_id AS DOUBLE))", "round(avg(CAST(user_id AS DOUBLE)), 6)"))
def prefixed_means(spark, sf_dir):
    rows = co.prefixed_means(table(spark, sf_dir, "events").select("value", "user_id"), ["value", "user_id"], "eval")
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns])


@query(f"SELECT vec_id, list_concat([2.0::DOUBLE], {VEC}[1:len(embedding) - 1]) AS shifted FROM embeddings")
def shift_right(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", v.shift_right(F.col("e"), 2.0).alias("shifted"))
