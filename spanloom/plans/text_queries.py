"""Text, token and label queries over documents, pages, events and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx
from ..operators import labelseq as ls
from ..operators import splits
from ..operators import tokens as tk
from .tree import table

QUERIES: dict = {}
SQL: dict = {}

TOKENS = r"""WITH pieces AS (
  SELECT doc_id, unnest(p) AS piece, unnest(range(0, len(p))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]') AS p FROM documents)
), placed AS (
  SELECT doc_id, piece, i, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM pieces
), tok AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, CAST(e - length(piece) AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", piece AS word FROM placed WHERE piece <> ' '
), lab AS (
  SELECT *, CASE substr(md5(lower(word)), 1, 1) WHEN '0' THEN 'GENEPROD' WHEN '1' THEN 'SMALL_MOLECULE' WHEN '2' THEN 'TISSUE' ELSE 'O' END AS label FROM tok
), gold AS (
  SELECT *, CASE WHEN label = 'O' THEN 'O' WHEN lag(label) OVER w IS NULL OR lag(label) OVER w <> label THEN concat('B-', label) ELSE concat('I-', label) END AS iob2 FROM lab WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
)
"""


def query(sql: str | None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def word_label(word):
    """labelled_lists()'s label of a word."""
    at = F.instr(F.lit("012"), F.substring(F.md5(F.lower(word)), 1, 1))
    return F.coalesce(F.get(F.array(F.lit("GENEPROD"), F.lit("SMALL_MOLECULE"), F.lit("TISSUE")), at - 1), F.lit("O"))


def labelled_lists(spark, sf_dir, docs=None, keep=()):
    """Documents' tokens as lists, with a label from a hash of the word, as a lexicon would give, and its IOB2 tag."""
    t = tk.token_lists(table(spark, sf_dir, "documents") if docs is None else docs, keep=keep)
    h = t.withColumn("_h", F.transform("tokens", lambda x: F.substring(F.md5(F.lower(x["word"])), 1, 1)))
    label = lambda c: F.when(c == "0", "GENEPROD").when(c == "1", "SMALL_MOLECULE").when(c == "2", "TISSUE").otherwise("O")
    return ls.iob2_lists(h.withColumn("tokens", tk.with_field("tokens", "label", lambda x, i: label(F.get("_h", i)))).drop("_h"), "label")


def labelled(spark, sf_dir):
    """labelled_lists(), a row for each token."""
    return tk.rows_of(labelled_lists(spark, sf_dir), "tokens", "doc_id")


CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\r\n\t]', ' ', 'g'), ' +', ' ', 'g'), '[–—‐−]', '-', 'g'), '^[Aa]bstract', '')"


@query(f"SELECT doc_id, {CLEAN} AS clean FROM documents")
def doc_cleanup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.cleanup("text").alias("clean"))


@query(f"SELECT doc_id, {CLEAN} AS clean FROM documents WHERE length(text) > 80")
def doc_min_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(tx.long_enough("text")).select("doc_id", tx.cleanup("text").alias("clean"))


@query("SELECT page_id, translate(url, '/.', '_-') AS file_name FROM pages")
def url_to_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.file_name("url").alias("file_name"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS inner_text FROM pages")
def html_inner_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_html("html").alias("inner_text"))


@query("SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS links FROM pages")
def html_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)).alias("links"))


@query("SELECT page_id FROM pages WHERE regexp_matches(html, '<div class=\"ad\">') AND length(html) > 2000")
def html_exists_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.col("html").rlike('<div class="ad">') & (F.length("html") > 2000)).select("page_id")


@query(r"""SELECT page_id, concat(title, '###tt9HHSlkWoUM###', body) AS twin FROM (
  SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_replace(regexp_extract(html, '(?s)<p>(.*?)</p>', 1), '<[^>]*>', '', 'g'), '') AS body FROM pages
) WHERE length(title) > 20 AND length(body) > 80""")
def title_body_twins(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), F.nullif(tx.strip_html(F.regexp_extract("html", r"(?s)<p>(.*?)</p>", 1)), F.lit("")).alias("body"))
    return p.where(tx.long_enough("title", 20) & tx.long_enough("body", 80)).select("page_id", F.concat("title", F.lit(tx.DELIMITER), "body").alias("twin"))


MENDED = "c"
for pattern, new in (
    (r"(\([^\n]*?\))([\p{L}\p{N}_])", r"\1 \2"),
    (r"[\r\n]", ""),
    ("<br>", "<br/>"),
    ('(?s)<link href="(.*)">', r'<link href="\1"/>'),
    ('(?s)<link href="(.*)"/>(?:.*(.))?</link>', r'<link href="\1">\2</link>'),
    (r"(?s)<\?xml.*?\?>", ""),
):
    MENDED = f"regexp_replace({MENDED}, '{pattern}', '{new}', 'g')"
NESTED = "CASE WHEN starts_with(c, '<sd-panel>') AND ends_with(c, '</sd-panel>') AND length(c) > 20 THEN c ELSE concat('<sd-panel>', c, '</sd-panel>') END"
for pattern, new in (("<sd-panel> *(?:<p>)* *<sd-panel>", "<sd-panel>"), ("</sd-panel> *(?:</p>)* *</sd-panel>", "</sd-panel>"), ("<sd-panel/>", ""), ("</sd-panel>$", " </sd-panel>"), (" +", " ")):
    NESTED = f"regexp_replace({NESTED}, '{pattern}', '{new}', 'g')"
CAPTION = "concat(CASE WHEN page_id % 5 = 0 THEN '<sd-panel> <p><sd-panel>' ELSE '(A)x<br><sd-panel/>' END, regexp_extract(html, '(?s)<article>(.*?)</article>', 1), CASE WHEN page_id % 5 = 0 THEN '</sd-panel></p> </sd-panel>' WHEN page_id % 5 = 1 THEN '<link href=\"h\">ab</link>' ELSE '</sd-panel>' END)"


@query(f"SELECT page_id, {NESTED} AS caption FROM (SELECT page_id, {MENDED} AS c FROM (SELECT page_id, {CAPTION} AS c FROM pages))")
def caption_cleanup(spark, sf_dir):
    k = F.col("page_id") % 5
    before = F.when(k == 0, "<sd-panel> <p><sd-panel>").otherwise("(A)x<br><sd-panel/>")
    after = F.when(k == 0, "</sd-panel></p> </sd-panel>").when(k == 1, '<link href="h">ab</link>').otherwise("</sd-panel>")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(before, F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1), after).alias("c"))
    return p.select("page_id", tx.panel_caption("c").alias("caption"))


@query(r"""WITH p AS (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) ELSE '' END AS t, concat('(1) Figure ', page_id, ' ', regexp_extract(html, '(?s)<p>(.*?)</p>', 1)) AS c FROM pages
), plain AS (
  SELECT page_id, t, replace(replace(replace(replace(replace(replace(regexp_replace(c, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&') AS c FROM p
), cut AS (
  SELECT page_id, t, regexp_replace(c, '^[^\p{L}\p{N}_]+', '') AS c FROM plain
)
SELECT page_id, CASE WHEN t <> '' THEN t WHEN NOT regexp_matches(c, '[.\r\n]') THEN '' ELSE replace(concat(regexp_replace(split_part(regexp_replace(c, '[\r\n]', '.', 'g'), '.', 1), '(?i)fig[.\p{L}\p{N}_\s]+[0-9]', '', 'g'), '.'), '..', '.') END AS title FROM cut""")
def figure_title(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.regexp_extract("html", "<title>([^<]*)</title>", 1)).otherwise("").alias("t"), F.concat(F.lit("(1) Figure "), F.col("page_id").cast("string"), F.lit(" "), F.regexp_extract("html", r"(?s)<p>(.*?)</p>", 1)).alias("c"))
    return p.select("page_id", tx.figure_title("t", "c").alias("title"))


@query("""SELECT p_partkey, row_number() OVER (ORDER BY regexp_extract(p_brand, '^[^0-9]*'), CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT), CAST(p_size AS BIGINT), p_partkey) AS place FROM part""")
def natural_sort_key(spark, sf_dir):
    keyed = table(spark, sf_dir, "part").select("p_partkey", tx.natural_key(F.concat("p_brand", F.lit(" size "), F.col("p_size").cast("string"))).alias("k"))
    return splits.numbered(keyed, "k", "p_partkey", name="place").select("p_partkey", (F.col("place") + 1).alias("place"))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), '///') AS event_types FROM events GROUP BY user_id")
def multi_value_join(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(tx.joined(F.array_sort(F.collect_set("event_type"))).alias("event_types"))


@query("""SELECT event_id, concat('event=', event_type, ', k=', json_extract_string(props, '$.k')) AS shown FROM events""")
def map_to_string(spark, sf_dir):
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", tx.map_text(F.map_concat(F.create_map(F.lit("event"), "event_type"), props)).alias("shown"))


@query(r"SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS sentences FROM documents")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.sentences("text").alias("sentences"))


@query(r"SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^ \p{L}\p{N}]') AS words FROM documents")
def word_tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.words("text").alias("words"))


@query(r"SELECT doc_id, regexp_extract_all(regexp_replace(text, '[\p{L}\p{N}]+$', ''), '[\p{L}\p{N}]+|[^ \p{L}\p{N}]') AS words FROM documents")
def word_tokenize_parity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.words("text", drop_trailing_word=True).alias("words"))


@query(TOKENS + "SELECT * FROM tok")
def token_offsets(spark, sf_dir):
    return tk.tokens(table(spark, sf_dir, "documents"))


@query("SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS folded FROM documents")
def ascii_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.ascii_fold("text").alias("folded"))


# Ends of texts, quotes and references are put in, since documents have few of their own.
DIRTY = "concat(CASE WHEN doc_id % 7 = 0 THEN chr(9) ELSE '' END, text, CASE doc_id % 5 WHEN 0 THEN ' \"button\"' WHEN 1 THEN concat(' (a) &amp;nbsp;&gt;', chr(160), chr(8217), chr(160)) WHEN 2 THEN ' button &amp;amp; amp;' ELSE '' END)"
CLEANED = "regexp_replace(CASE WHEN contains(t, '\"button\"') THEN ' no caption ' ELSE t END, '^[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+|[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+$', '', 'g')"
for old, new in (("’", "''"), ("–", "-"), ("\xa0", " "), ("&amp;", "&"), ("&amp;amp;", "&"), ("&nbsp;", " "), ("\u2009", " "), ("&gt;", ">"), ("&lt;", "<"), ("amp;", ""), (") ", ")")):
    CLEANED = f"replace({CLEANED}, '{old}', '{new}')"


@query(f"SELECT doc_id, {CLEANED} AS cleaned FROM (SELECT doc_id, {DIRTY} AS t FROM documents)")
def cleaning_rules(spark, sf_dir):
    k = F.col("doc_id") % 5
    tail = F.when(k == 0, ' "button"').when(k == 1, " (a) &amp;nbsp;&gt;\xa0’\xa0").when(k == 2, " button &amp;amp; amp;").otherwise("")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 7 == 0, "\t").otherwise(""), F.coalesce("text", F.lit("")), tail).alias("t"))
    return docs.select("doc_id", tx.cleaning_rules("t", " no caption ").alias("cleaned"))


@query("""SELECT round(avg(n), 2) AS mean_length, min(n) AS min_length, max(n) AS max_length, (SELECT doc_id FROM documents ORDER BY length(text), doc_id LIMIT 1) AS shortest, (SELECT doc_id FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1) AS longest
FROM (SELECT length(text) AS n FROM documents)""")
def length_verification(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    return tk.length_report(rows, "n", "doc_id")


@query("SELECT doc_id, source, text FROM (SELECT *, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_dedupe(spark, sf_dir):
    return tk.exact_dedupe(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", "doc_id", "text")


ELEMENTS = """SELECT event_id, CASE WHEN event_type = 'view' THEN 'sd-panel' ELSE 'sd-tag' END AS tag,
  CASE event_type WHEN 'click' THEN 'gene' WHEN 'signup' THEN 'molecule' WHEN 'error' THEN 'tissue' END AS entity_type,
  CASE WHEN event_type = 'purchase' THEN 'assay' END AS category,
  CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 WHEN 0 THEN 'intervention' WHEN 1 THEN 'assayed' WHEN 2 THEN 'reporter' END AS role FROM events"""


def elements(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int") % 4
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(t == "view", "sd-panel").otherwise("sd-tag").alias("tag"), F.when(t == "click", "gene").when(t == "signup", "molecule").when(t == "error", "tissue").alias("entity_type"), F.when(t == "purchase", "assay").alias("category"), F.when(k == 0, "intervention").when(k == 1, "assayed").when(k == 2, "reporter").alias("role")
    )


@query(f"""SELECT event_id,
  CASE WHEN tag = 'sd-tag' AND entity_type = 'molecule' THEN 1 WHEN tag = 'sd-tag' AND entity_type = 'gene' THEN 2 WHEN tag = 'sd-tag' AND entity_type = 'tissue' THEN 5 WHEN tag = 'sd-tag' AND category = 'assay' THEN 7 END AS entity_types,
  CASE WHEN tag = 'sd-tag' AND entity_type = 'gene' AND role = 'intervention' THEN 1 WHEN tag = 'sd-tag' AND entity_type = 'gene' AND role = 'assayed' THEN 2 END AS geneprod_roles,
  CASE WHEN tag = 'sd-tag' AND entity_type = 'molecule' AND role = 'intervention' THEN 1 WHEN tag = 'sd-tag' AND entity_type = 'molecule' AND role = 'assayed' THEN 2 END AS small_mol_roles,
  CASE WHEN tag = 'sd-tag' AND role = 'reporter' THEN 1 END AS boring,
  CASE WHEN tag = 'sd-panel' THEN 1 END AS panel_start
FROM ({ELEMENTS})""")
def code_map_labels(spark, sf_dir):
    e = elements(spark, sf_dir)
    return e.select("event_id", *[m.code(F.col("tag"), F.col).alias(m.name) for m in lb.CODE_MAPS])


@query(TOKENS + "SELECT doc_id, pos, word, iob2 FROM gold")
def iob2_encode(spark, sf_dir):
    return labelled(spark, sf_dir).select("doc_id", "pos", "word", "iob2")


@query(TOKENS + """, spans AS (
  SELECT doc_id, CAST(i * 150 AS BIGINT) AS s, CAST(least((i + 1) * 150, n) AS BIGINT) AS e FROM (SELECT doc_id, length(text) AS n, unnest(range(0, CAST(ceil(length(text) / 150.0) AS BIGINT))) AS i FROM documents)
)
SELECT tok.doc_id, pos, word, CASE WHEN s IS NULL THEN 'O' ELSE 'B-PANEL_START' END AS panel_start FROM tok LEFT JOIN spans ON tok.doc_id = spans.doc_id AND s >= "start" AND s < "end" """)
def boundary_start(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = F.length("text")
    spans = docs.where(n > 0).select("doc_id", F.explode(F.sequence(F.lit(0), F.ceil(n / 150) - 1)).alias("i"), n.alias("n")).select("doc_id", (F.col("i") * 150).alias("start"), F.least((F.col("i") + 1) * 150, F.col("n")).alias("end"), F.lit("B-PANEL_START").alias("label"))
    return ls.span_labels(tk.tokens(docs), spans, whole=False).select("doc_id", "pos", "word", F.col("label").alias("panel_start"))


@query(TOKENS + """, spans AS (SELECT doc_id, "start" AS s, "end" AS e, label FROM lab WHERE label <> 'O' AND doc_id % 10 = 0 AND pos < 1000000)
, chars AS (SELECT doc_id, unnest(range(0, length(text))) AS i FROM documents WHERE doc_id % 10 = 0)
, charlab AS (SELECT c.doc_id, CAST(c.i AS INTEGER) AS i, coalesce(label, 'O') AS label FROM chars c LEFT JOIN spans ON c.doc_id = spans.doc_id AND c.i >= s AND c.i < e)
SELECT doc_id, i, CASE WHEN label = 'O' THEN 'O' WHEN lag(label) OVER w IS NULL OR lag(label) OVER w <> label THEN concat('B-', label) ELSE concat('I-', label) END AS iob2 FROM charlab WINDOW w AS (PARTITION BY doc_id ORDER BY i)""".replace(" AND doc_id % 10 = 0 AND pos < 1000000", "").replace(" WHERE doc_id % 10 = 0", ""))
def char_iob2(spark, sf_dir):
    rows = labelled_lists(spark, sf_dir, keep=["text"])
    return ls.char_lists(rows.select("doc_id", "text", F.filter("tokens", lambda x: x["label"] != "O").alias("spans")))


@query(f"SELECT label, count(*) AS n FROM (SELECT coalesce(entity_type, category, 'none') AS label FROM ({ELEMENTS})) GROUP BY label")
def label_histogram(spark, sf_dir):
    return ls.histogram(elements(spark, sf_dir).select(F.coalesce("entity_type", "category", F.lit("none")).alias("label")))


@query(f"""WITH h AS (SELECT label, count(*) AS n FROM (SELECT coalesce(entity_type, category, 'none') AS label FROM ({ELEMENTS})) GROUP BY label),
r AS (SELECT label, n, (max(n) OVER ()) / n AS ratio FROM h)
SELECT label, n, round((ratio - min(ratio) OVER ()) / (max(ratio) OVER () - min(ratio) OVER ()) * 0.7 + 0.2, 9) AS weight FROM r""")
def class_weights(spark, sf_dir):
    return ls.class_weights(label_histogram(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


LEXICON = {"DET": ("the", "a", "an", "la", "le", "les", "der", "die", "das", "el", "los", "un", "une"), "ADP": ("of", "in", "to", "by", "for", "with", "de", "en", "von", "zu", "mit", "par", "por"), "CCONJ": ("and", "or", "et", "und", "y"), "PRON": ("it", "he", "that", "que", "se"), "VERB": ("is", "are", "was", "be", "est", "ist")}
POS_SQL = "CASE " + " ".join(f"WHEN lower(w) IN ({', '.join(repr(x) for x in ws)}) THEN '{p}'" for p, ws in LEXICON.items()) + " ELSE 'NOUN' END"


def pos_tags(words):
    """Parts of speech from a closed-class lexicon; everything else counts as a noun."""

    def tag(w):
        out = None
        for p, ws in LEXICON.items():
            out = F.when(w.isin(*ws), p) if out is None else out.when(w.isin(*ws), p)
        return out.otherwise("NOUN")

    return F.transform(F.transform(words, lambda w: F.lower(w)), tag)


@query(rf"SELECT doc_id, list_transform(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^ \p{{L}}\p{{N}}]'), lambda w: {POS_SQL}), lambda p: CASE WHEN p IN ('DET', 'CCONJ', 'SCONJ', 'ADP', 'PRON') THEN 1 ELSE 0 END) AS tag_mask FROM documents")
def pos_mask_small(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", lb.mask(pos_tags(tx.words("text")), lb.POS_MASKS["SMALL"]).alias("tag_mask"))


@query(rf"SELECT doc_id, list_transform(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^ \p{{L}}\p{{N}}]'), lambda w: {POS_SQL}), lambda p: CASE WHEN p = 'DET' THEN 1 ELSE 0 END) AS tag_mask FROM documents")
def pos_mask_det(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", lb.mask(pos_tags(tx.words("text")), lb.POS_MASKS["DET"]).alias("tag_mask"))


def with_tokens(spark, sf_dir):
    """Documents that have a token: anything but spaces."""
    return table(spark, sf_dir, "documents").where(F.col("text").rlike("[^ ]"))


@query(TOKENS + "SELECT doc_id, list(CASE WHEN iob2 IN ('B-GENEPROD', 'I-GENEPROD') THEN 1 ELSE 0 END ORDER BY pos) AS tag_mask FROM gold GROUP BY doc_id")
def role_mask(spark, sf_dir):
    rows = labelled_lists(spark, sf_dir, with_tokens(spark, sf_dir))
    return rows.select("doc_id", lb.mask(F.col("tokens")["iob2"], ["B-GENEPROD", "I-GENEPROD"]).alias("tag_mask"))


IDS = "CASE iob2 WHEN 'B-SMALL_MOLECULE' THEN 1 WHEN 'I-SMALL_MOLECULE' THEN 2 WHEN 'B-GENEPROD' THEN 3 WHEN 'I-GENEPROD' THEN 4 WHEN 'B-TISSUE' THEN 9 WHEN 'I-TISSUE' THEN 10 ELSE 0 END"


def label_id(tag):
    """The id of a tag, as IDS has it."""
    out = F.when(tag == "B-SMALL_MOLECULE", 1)
    for name, k in (("I-SMALL_MOLECULE", 2), ("B-GENEPROD", 3), ("I-GENEPROD", 4), ("B-TISSUE", 9), ("I-TISSUE", 10)):
        out = out.when(tag == name, k)
    return out.otherwise(0)


@query(TOKENS + f"SELECT doc_id, list(CASE WHEN {IDS} > 0 THEN 1 ELSE 0 END ORDER BY pos) AS tag_mask FROM gold GROUP BY doc_id")
def tag_mask(spark, sf_dir):
    rows = labelled_lists(spark, sf_dir, with_tokens(spark, sf_dir))
    return rows.select("doc_id", F.transform(F.col("tokens")["iob2"], label_id).alias("ids")).select("doc_id", lb.nonzero_mask("ids").alias("tag_mask"))


@query(TOKENS + f"SELECT doc_id, list(CASE WHEN pos = 0 THEN -100 WHEN {IDS} = 3 THEN 1 WHEN {IDS} = 4 THEN 2 ELSE 0 END ORDER BY pos) AS labels FROM gold GROUP BY doc_id")
def label_subset(spark, sf_dir):
    rows = labelled_lists(spark, sf_dir, with_tokens(spark, sf_dir))
    ids = F.transform(F.col("tokens")["iob2"], lambda x, i: F.when(i == 0, lb.IGNORE).otherwise(label_id(x)))
    return rows.select("doc_id", ids.alias("ids")).select("doc_id", lb.subset("ids", {3: 1, 4: 2}).alias("labels"))


@query(TOKENS + f"""SELECT doc_id, pos AS word_id, CAST(k AS INTEGER) AS sub_pos, CASE WHEN k = 0 THEN id WHEN id > 0 AND id % 2 = 1 THEN id + 1 ELSE id END AS label FROM
(SELECT doc_id, pos, {IDS} AS id, unnest(range(0, CAST(ceil(length(word) / 4.0) AS BIGINT))) AS k FROM gold)""")
def subtoken_align(spark, sf_dir):
    words = labelled(spark, sf_dir).select("doc_id", F.col("pos").alias("word_id"), F.expr(IDS).alias("label"), "word")
    subs = words.select("doc_id", "word_id", F.explode(F.sequence(F.lit(0), (F.ceil(F.length("word") / 4) - 1).cast("int"))).alias("sub_pos"))
    return ls.align_subtokens(subs, words).select("doc_id", "word_id", "sub_pos", "label")


@query(TOKENS + f"SELECT doc_id, pos, CASE WHEN {IDS} > 0 AND {IDS} % 2 = 1 THEN {IDS} + 1 ELSE {IDS} END AS label FROM gold")
def shift_label(spark, sf_dir):
    return labelled(spark, sf_dir).select("doc_id", "pos", lb.shifted(F.expr(IDS)).alias("label"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'losses/main_loss' WHEN 'click' THEN 'losses/main_loss' WHEN 'error' THEN 'losses/eval_supp' WHEN 'signup' THEN concat('images/eval_supp_data_', user_id) ELSE concat('other_data/', event_type) END AS main_tag,
  CASE event_type WHEN 'view' THEN 'train' WHEN 'click' THEN 'eval' WHEN 'error' THEN CAST(user_id AS VARCHAR) WHEN 'signup' THEN NULL ELSE event_type END AS scalar_tag FROM events""")
def log_key_routing(spark, sf_dir):
    t, u = F.col("event_type"), F.col("user_id").cast("string")
    k = F.when(t == "view", "loss").when(t == "click", "eval_loss").when(t == "error", F.concat(F.lit("eval_supp_data_"), u)).when(t == "signup", F.concat(F.lit("eval_supp_data_img_"), u)).otherwise(t)
    rows = table(spark, sf_dir, "events").select("event_id", k.alias("k"))
    main, scalar = tx.log_route("k")
    return rows.select("event_id", main.alias("main_tag"), scalar.alias("scalar_tag"))


@query("SELECT event_id, CASE WHEN event_type IN ('gene', 'protein') THEN 'geneprod' ELSE event_type END AS entity_type FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'gene' WHEN 'click' THEN 'geneprod' WHEN 'error' THEN 'protein' ELSE 'molecule' END AS event_type FROM events)")
def geneprod_rewrite(spark, sf_dir):
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", tx.geneprod(F.when(t == "view", "gene").when(t == "click", "geneprod").when(t == "error", "protein").otherwise("molecule")).alias("entity_type"))
