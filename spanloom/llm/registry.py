"""The opN_ queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import convtrie, curveknn, decontaminate, langid, licences, linededup, merkle, neardup, ngramjoin, packing, secretscan, styletree, suffixdedup
from .workspace import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM bw WHERE len(w) > 0)
), starts AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (
  SELECT doc_id, n, i, item_id FROM starts JOIN windows USING (n, s)
), words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) END) AS s FROM w
), member AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), often AS (
  SELECT g FROM member GROUP BY g HAVING count(*) > 1
), m AS (
  SELECT doc_id, n, g FROM member JOIN often USING (g)
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM m a JOIN m b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
), comp AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN comp USING (doc_id)
"""


def op2_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styletree.extract(_table(spark, sf_dir, "pages"))


def op3_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(_table(spark, sf_dir, "documents"), secretscan.train())


def op4_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_line_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS ln, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), counted AS (
  SELECT *, len(regexp_extract_all(ln, '[^ 	-
]+')) AS nw FROM raw
), l AS (
  SELECT doc_id, pos, ln, nw, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, sum(nw) OVER (PARTITION BY doc_id ORDER BY pos) AS cum FROM counted WHERE nw > 0
), ends AS (
  -- From each start, all runs of 10 words or more that have less than 10 beyond the shortest one.
  SELECT doc_id, a, b FROM (SELECT a.doc_id, a.i AS a, b.i AS b, b.cum - min(b.cum) OVER (PARTITION BY a.doc_id, a.i) AS beyond
    FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.i < a.i + 20 AND b.cum >= a.cum - a.nw + 10) WHERE beyond < 10
), runs AS (
  SELECT e.doc_id, e.a, e.b, string_agg(l.ln, chr(10) ORDER BY l.i) AS s FROM ends e JOIN l ON l.doc_id = e.doc_id AND l.i BETWEEN e.a AND e.b GROUP BY e.doc_id, e.a, e.b
), later AS (
  SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, a) AS r FROM runs) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM later
), gone_pos AS (
  SELECT doc_id, pos FROM gone JOIN l USING (doc_id, i)
)
SELECT doc_id, CAST(count(*) FILTER (nw > 0) AS BIGINT) AS n_lines, CAST(count(g.pos) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(ln, chr(10) ORDER BY c.pos) FILTER (g.pos IS NULL), '')) AS kept_sha256
FROM counted c LEFT JOIN gone_pos g USING (doc_id, pos) GROUP BY doc_id
"""


def op7_licence_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents")).drop("spans")


OP9_SQL = """
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), parts AS (
  SELECT doc_id, k * 250 AS base, substr(x, 500 * k + 1, 698) AS x FROM (SELECT doc_id, x, unnest(range(0, (len(x) // 2 - 100) // 250 + 1)) AS k FROM h WHERE len(x) >= 200)
), w AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM (SELECT doc_id, base + j AS i, md5(substr(x, 2 * j + 1, 200)) AS g FROM (SELECT doc_id, base, x, unnest(range(0, len(x) // 2 - 99)) AS j FROM parts))
), later AS (
  SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS fresh FROM w WHERE r > 1
), s AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM later) GROUP BY doc_id, k
), seg AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM s
), cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS t FROM seg JOIN h USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(concat(t, substr(x, 2 * coalesce(last, 0) + 1)))) AS kept_sha256
FROM h LEFT JOIN cut USING (doc_id)
"""


def op8_shifted_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curveknn.nearest(_table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y)) AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS r FROM d) WHERE r <= 10
"""


def op9_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup_suffixes(_table(spark, sf_dir, "documents")).drop("span_starts", "span_ends")


def op5_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(_table(spark, sf_dir, "documents"))


#: The same sets as op1's, linked at another threshold.
OP11_SQL = OP1_SQL.replace("85 *", "90 *").replace(", doc_id = component_id AS kept", "")


def op12_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fields = {name: F.col(name) for name in merkle.FIELDS}
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.leaf_hash(fields | {"text": F.regexp_replace("text", "\n", "")}))
    made = merkle.manifest(docs, carry={"tampered": tampered})
    proofs = merkle.proofs(made)
    folded = merkle.folded(merkle.folded(F.coalesce("tampered", "leaf"), F.col("siblings"), F.col("depth")), F.col("above"), F.col("top_depth"))
    found = proofs.select("doc_id", "leaf", "subroot", F.lit(made.root).cast("string").alias("root"), merkle.proof_hash(F.col("siblings"), F.col("above")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC = """list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(ID AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"""
#: CRC-32 of an id's decimal digits, as a number from 0 to 2**32 - 1.
CRC_SQL = f"xor({_CRC}, 4294967295)"

OP12_SQL = f"""
WITH RECURSIVE coded AS (
  SELECT doc_id, source, {CRC_SQL.replace("ID", "doc_id")} % 2 = 0 AS spoilt,
    concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
    text, replace(text, chr(10), '') AS bare FROM documents
), leaves AS (
  SELECT doc_id, source, sha256(concat(head, coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
    CASE WHEN spoilt THEN sha256(concat(head, coalesce(strlen(bare) || ':' || bare, '-'))) END AS other,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS size FROM coded
), nodes AS (
  SELECT source, 0 AS level, place, size, leaf AS h FROM leaves
  UNION ALL
  SELECT source, level + 1, place // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM nodes WHERE size > 1 GROUP BY source, level, place // 3, size
), subroots AS (
  SELECT source, h AS subroot, level AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM nodes WHERE size = 1
), tops AS (
  SELECT 0 AS level, place, size, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY place)) FROM tops WHERE size > 1 GROUP BY level, place // 3, size
), steps AS (
  SELECT l.doc_id, n.level AS step, n.place, n.h, l.place // CAST(pow(3, n.level) AS BIGINT) AS mine
  FROM leaves l JOIN nodes n ON l.source IS NOT DISTINCT FROM n.source AND n.size > 1 AND n.place // 3 = l.place // CAST(pow(3, n.level + 1) AS BIGINT)
  UNION ALL
  SELECT l.doc_id, s.depth + t.level, t.place, t.h, s.place // CAST(pow(3, t.level) AS BIGINT)
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN tops t ON t.size > 1 AND t.place // 3 = s.place // CAST(pow(3, t.level + 1) AS BIGINT)
), sides AS (
  SELECT doc_id, step, coalesce(string_agg(h, '' ORDER BY place) FILTER (place < mine), '') AS l, coalesce(string_agg(h, '' ORDER BY place) FILTER (place > mine), '') AS r FROM steps GROUP BY doc_id, step
), ways AS (
  SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM sides GROUP BY doc_id
), folds AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS step, coalesce(other, leaf) AS h FROM leaves
  UNION ALL
  SELECT doc_id, f.step + 1, sha256(l || h || r) FROM folds f JOIN sides USING (doc_id, step)
), ends AS (
  SELECT doc_id, arg_max(h, step) AS folded_root FROM folds GROUP BY doc_id
)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots ON leaves.source IS NOT DISTINCT FROM subroots.source JOIN ends USING (doc_id) LEFT JOIN ways USING (doc_id), (SELECT h AS root FROM tops WHERE size = 1)
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, conv = Workspace(spark), F.col("conv_id")
    turns = convtrie.turns_in_order(_table(spark, sf_dir, "conversations"), work)
    lengths, built = convtrie.rebuilt(turns, conv - conv % 20, F.crc32(conv.cast("string")) % 4, 3, work)
    return convtrie.trie(lengths, built, work)


OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC_SQL.replace("ID", "conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), pieces AS (
  SELECT c.conv_id, 0 AS side, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND place < h
  UNION ALL
  SELECT c.conv_id, 1, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place >= h
), built AS (
  SELECT conv_id, row_number() OVER w AS depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS tokens,
    string_agg(md5(md5(role) || md5(text)), '') OVER w AS prefix FROM pieces WINDOW w AS (PARTITION BY conv_id ORDER BY side, place ROWS UNBOUNDED PRECEDING)
), seen AS (
  SELECT conv_id, depth, tokens, md5(prefix) AS k, coalesce(lag(md5(prefix)) OVER (PARTITION BY conv_id ORDER BY depth), '') AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM built
  UNION ALL
  SELECT conv_id, 0, 0, '', NULL, coalesce(n, 0) FROM convs LEFT JOIN (SELECT conv_id, count(*) AS n FROM built GROUP BY conv_id) USING (conv_id)
), nodes AS (
  SELECT depth, k, any_value(p) AS p, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = depth AS childless, (count(*) - 1) * any_value(tokens) AS saved, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth) AS ends
  FROM seen GROUP BY depth, k
), above AS (
  SELECT s.depth, s.k, count(*) FILTER (childless) AS n_leaves, sum(saved) AS saved_tokens FROM nodes v JOIN seen s ON s.conv_id = v.conv_id AND s.depth <= v.depth GROUP BY s.depth, s.k
), kids AS (
  SELECT depth - 1 AS depth, p AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY depth, p
)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM nodes v JOIN above a ON v.depth = a.depth AND v.k = a.k LEFT JOIN kids c ON v.depth = c.depth AND v.k = c.k LEFT JOIN nodes u ON u.depth = v.depth - 1 AND u.k = v.p
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_forest": op1_minhash_forest,
    "op2_style_tree": op2_style_tree,
    "op3_secret_forest": op3_secret_forest,
    "op4_ecoc_language": op4_ecoc_language,
    "op7_licence_automaton": op7_licence_automaton,
    "op6_line_suffixes": op6_line_suffixes,
    "op8_shifted_curves": op8_shifted_curves,
    "op9_two_stage_suffixes": op9_two_stage_suffixes,
    "op5_hilbert_packing": op5_hilbert_packing,
    "op10_winnowing": op10_winnowing,
    "op11_ngram_join": op11_ngram_join,
    "op12_merkle_proofs": op12_merkle_proofs,
    "op13_prefix_trie": op13_prefix_trie,
}
SQL: dict[str, str] = {"op1_minhash_forest": OP1_SQL, "op6_line_suffixes": OP6_SQL, "op8_shifted_curves": OP8_SQL, "op9_two_stage_suffixes": OP9_SQL, "op10_winnowing": OP10_SQL, "op11_ngram_join": OP11_SQL, "op12_merkle_proofs": OP12_SQL, "op13_prefix_trie": OP13_SQL}
