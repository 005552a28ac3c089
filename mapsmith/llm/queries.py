"""The registered query of each corpus operator, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapsmith.llm import ann, bitpack, decontaminate, htmltext, jaccard, line_dedup, packing, secrets, substring_dedup, toxicity
from mapsmith.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = bitpack.write_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 1)
    return bitpack.read_files(files).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) m FROM g GROUP BY g),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) p FROM g JOIN f USING (g) WHERE doc_id > m),
x AS (SELECT doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) p FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE h.p IS NULL) kept, count(*) n, count(h.p) r FROM x LEFT JOIN h ON x.doc_id = h.doc_id AND x.p = h.p GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n, 0) n_words, coalesce(r, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + k - 1), ' ') || '#' || k g FROM (SELECT doc_id, w, least(len(w), 5) k, unnest(range(1, len(w) - least(len(w), 5) + 2)) i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY x, y),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id x, doc_id y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, coalesce(c.m, d.doc_id) component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x doc_id, min(y) m FROM r GROUP BY x) c USING (doc_id)
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items = F.size("_items")
    return found.select(
        "doc_id", F.col("_n_words").cast("long").alias("n_words"), decontaminate.n_covered(F.col("_spans")).cast("long").alias("n_hit"), n_items.cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"),
    )


OP5_SQL = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bl AS (SELECT item, w, least(len(w), 8) n FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') g FROM (SELECT item, n, w, unnest(range(1, len(w) - n + 2)) i FROM bl)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
ln AS (SELECT DISTINCT n FROM bg),
dg AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') g FROM (SELECT doc_id, ln.n, w, unnest(range(1, len(w) - ln.n + 2)) i FROM d, ln WHERE len(w) >= ln.n)),
h AS (SELECT dg.doc_id, dg.n, dg.i, bg.item FROM dg JOIN bg USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) n_items, string_agg(DISTINCT item, ',' ORDER BY item) items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = toxicity.scorer(toxicity.train(docs, table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key FROM l),
f AS (SELECT key, min(doc_id) first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, pos, line, coalesce(k.doc_id > f.first_doc, false) gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) n_lines, count(*) FILTER (WHERE gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) kept_sha256 FROM m GROUP BY doc_id
"""

def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_bitpack": op2_bitpack,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_ann": op7_ann,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_secrets": op10_secrets,
}

ORACLES: dict[str, str] = {
    "op3_substring_dedup": OP3_SQL,
    "op4_jaccard_join": OP4_SQL,
    "op5_decontaminate": OP5_SQL,
    "op8_line_dedup": OP8_SQL,
}
