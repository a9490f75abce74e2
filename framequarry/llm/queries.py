"""One query ``opN_<name>`` for each training-data operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat
from .ann import nearest_neighbours
from .codes import compress
from .decontamination import find_contamination
from .language import identify_languages, train_languages
from .mixing import mix_sources
from .neardup import near_duplicates
from .ngramjoin import jaccard_join
from .quality import score_quality, train_quality
from .sampling import fold
from .sharding import shard_documents
from .toxicity import score_toxicity
from .trie import prefix_trie, sequences, swapped_start
from .warc import read_warc, write_warc
from .workspace import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    path = shared_dir(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), path)
    records = read_warc(spark, path).filter(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    response = F.col("record_type") == "response"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("http_headers")["content-length"].try_cast("long")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose id's checksum is not 0 modulo 5."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id")) == 0
    model = train_languages(docs.filter(~held))
    found = identify_languages(docs, model, keep=[F.col("doc_id"), held.alias("held_out")])
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, the benchmark items of which it holds a passage."""
    found = find_contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.array_sort(F.array_distinct(F.col("matches.item_id"))).alias("item_ids"), F.size("matches").alias("regions"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -7, as JSON of mixed layouts, mapped by fingerprint, written by the template and read back."""
    control = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(control)
    return chat.digests(chat.format_chat(chat.pack_json(chat.turn_records(rows))))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; those below 0.5 are rejected."""
    docs = _table(spark, sf_dir, "documents")
    model = train_quality(docs, _table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", "quality", "text_quality", "meta_quality", (F.col("quality") >= 0.5).alias("accepted"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; the shards' bytes are nearly equal."""
    found = shard_documents(_table(spark, sf_dir, "documents"), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by labels of those whose id's checksum is not 0 modulo 5."""
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components and links of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return jaccard_join(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector: four parts, 256 entries each, four rounds."""
    return compress(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix tree of all conversations, whose starts are taken from the conversation at the head of their five."""
    turns = sequences(_table(spark, sf_dir, "conversations"))
    c = F.col("id")
    return prefix_trie(swapped_start(turns, c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_warc, op2_nearest_neighbours, op3_language_id, op4_mixing, op5_decontamination, op6_chat_formatting, op7_near_duplicates, op8_quality_classifier,
        op9_sharding, op10_toxicity, op11_jaccard_join, op12_vector_codes, op13_prefix_trie,
    )
    return {f.__name__: f for f in found}


SQL: dict[str, str] = {}

SQL["op1_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
     w AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS winner FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN winner IS NOT NULL AND winner IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN winner IS NOT NULL AND winner IS DISTINCT FROM page_id THEN winner END AS refers_to
FROM w
"""

SQL["op4_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
b AS (SELECT *, length(bin(greatest(size, 1))) - 1 AS band FROM d),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
wt AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM src),
lv AS (SELECT *, row_number() OVER o AS pos,
         CAST((sum(source_size) OVER ()) - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
       FROM wt WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
tg AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), (SELECT arg_min(level, pos) FROM lv WHERE level * weight <= 3 * source_size) * weight) AS target FROM lv),
bw AS (SELECT source, band, sum(size) AS words, 16.0::DOUBLE / (16 + band) AS lean FROM b GROUP BY ALL),
fc AS (SELECT bw.*, tg.source_size, tg.target,
         (target - coalesce(sum(3 * words) OVER (PARTITION BY bw.source ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / nullif(sum(words * lean) OVER (PARTITION BY bw.source ORDER BY band ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS factor
       FROM bw JOIN tg ON bw.source IS NOT DISTINCT FROM tg.source),
fm AS (SELECT source, arg_min(factor, band) AS factor FROM fc WHERE factor * lean <= 3 AND target < 3 * source_size GROUP BY source),
ex AS (SELECT fc.source, band, words, target, source_size, coalesce(least(3.0::DOUBLE, fm.factor * lean), 3.0::DOUBLE) AS expected FROM fc LEFT JOIN fm ON fc.source IS NOT DISTINCT FROM fm.source),
pl AS (SELECT *, CAST(floor(expected) AS BIGINT) AS sure, expected - floor(expected) AS share, target - sum(words * floor(expected)) OVER (PARTITION BY source) AS rest FROM ex),
ky AS (SELECT b.doc_id, b.source, b.size, pl.source_size, pl.target, sure, share, rest, (CAST('0x' || substr(md5(b.doc_id || ':0'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE AS u
       FROM b JOIN pl ON b.source IS NOT DISTINCT FROM pl.source AND b.band = pl.band),
k2 AS (SELECT *, CASE WHEN share > 0 THEN u * (1 - share) / (u * (1 - share) + share * (1 - u)) END AS key FROM ky),
cm AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key RANGE UNBOUNDED PRECEDING) AS cum FROM k2 WHERE key IS NOT NULL),
sh AS (SELECT source, max(rest) - coalesce(max(CASE WHEN cum <= rest THEN cum END), 0) AS short FROM cm GROUP BY source),
cl AS (SELECT cm.source, arg_min(struct_pack(key := key, size := size, off := abs(short - size)), struct_pack(off := abs(short - size), key := key, size := size)) AS c, max(short) AS short
       FROM cm JOIN sh ON cm.source IS NOT DISTINCT FROM sh.source WHERE cum > rest GROUP BY cm.source)
SELECT k2.doc_id, k2.size, k2.source_size, k2.target,
       CAST(k2.size * (k2.sure + CASE WHEN cm.cum <= k2.rest OR (cl.c.off < cl.short AND cl.c.key = k2.key AND cl.c.size = k2.size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM k2 LEFT JOIN cm ON k2.doc_id = cm.doc_id LEFT JOIN cl ON k2.source IS NOT DISTINCT FROM cl.source
"""

SQL["op7_near_duplicates"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(s) AS v FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM e a JOIN e b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n_shingles + b.n_shingles - i)),
g AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, g.y FROM r JOIN g ON r.reached = g.x)
SELECT n.doc_id, n.n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT node, min(reached) AS component_id FROM r GROUP BY node) c ON n.doc_id = c.node
"""

SQL["op11_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(s) AS v FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM e a JOIN e b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n_shingles + b.n_shingles - i)),
g AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, g.y FROM r JOIN g ON r.reached = g.x)
SELECT n.doc_id, n.n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links
FROM n JOIN (SELECT node, min(reached) AS component_id FROM r GROUP BY node) c ON n.doc_id = c.node LEFT JOIN (SELECT x, count(*) AS n_links FROM g GROUP BY x) k ON k.x = n.doc_id
"""

SQL["op6_chat_formatting"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS etext,
         regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS erole
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|start|>' || erole || '<|text|>' || etext || '<|end|>')) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every part compared with every entry, in whole numbers below 2 ** 53."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""p AS MATERIALIZED (SELECT vec_id, label, part, list_slice(v, part * len(v) // {parts} + 1, (part + 1) * len(v) // {parts}) AS v FROM kept, (SELECT unnest(range({parts})) AS part))""",
        f"""b0 AS MATERIALIZED (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT vec_id, label, part, v, min(struct_pack(d := d, entry := entry)) AS m FROM (
                  SELECT p.vec_id, p.label, p.part, p.v, entry, list_dot_product(p.v, p.v) + list_dot_product(b{i}.v, b{i}.v) - 2 * list_dot_product(p.v, b{i}.v) AS d FROM p JOIN b{i} ON p.part = b{i}.part)
                GROUP BY vec_id, label, part, v)"""
        )
        if i < rounds:
            steps.append(
                f"""b{i + 1} AS MATERIALIZED (SELECT b{i}.part, coalesce(n.v, b{i}.v) AS v, b{i}.entry FROM b{i} LEFT JOIN (
                      SELECT part, entry, list(floor(s / n) ORDER BY j) AS v FROM (
                        SELECT part, m.entry AS entry, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, (SELECT max(len(v)) + 1 FROM p))) AS j) GROUP BY ALL)
                      GROUP BY part, entry) n ON n.part = b{i}.part AND n.entry = b{i}.entry)"""
            )
    return f"""WITH {", ".join(steps)},
    c AS (SELECT vec_id, label, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label),
    l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM c GROUP BY label),
    h AS (SELECT sha256(string_agg(array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) FOR x IN v], ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
    SELECT vec_id, code, error, label_error, codebooks_sha256 FROM c JOIN l ON c.label IS NOT DISTINCT FROM l.label, h"""


SQL["op12_vector_codes"] = _codes_sql()

SQL["op13_prefix_trie"] = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS head,
        xor(list_reduce(list_concat([4294967295::BIGINT], [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
          lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT FOR i IN range(8)]), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 9 AS h FROM t),
r AS (SELECT c.conv_id, 0 AS side, pos, role, text FROM c JOIN t ON t.conv_id = c.head AND pos <= h UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
s AS (SELECT c.conv_id, coalesce(list(sha256(length(role) || ':' || role || text) ORDER BY side, pos) FILTER (WHERE role IS NOT NULL), []) AS l, list(octet_length(encode(text)) ORDER BY side, pos) FILTER (WHERE role IS NOT NULL) AS b
      FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
m AS (SELECT conv_id, unnest(range(len(l) + 1)) AS d, l, b FROM s),
p AS (SELECT conv_id, d, array_to_string(l[1:d], '') AS path, array_to_string(l[1:d - 1], '') AS up, CASE WHEN d > 0 THEN b[d] ELSE 0 END AS bytes, len(l) = d AS ends FROM m),
n AS (SELECT path, any_value(CASE WHEN d > 0 THEN up END) AS up, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends FROM p GROUP BY path, d),
k AS (SELECT up, count(*) AS kids FROM n WHERE up IS NOT NULL GROUP BY up),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k ON k.up = n.path),
u AS (SELECT a.path, sum(CASE WHEN f.kids = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved FROM f a JOIN f ON starts_with(f.path, a.path) GROUP BY a.path)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.kids AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN u USING (path) LEFT JOIN f q ON q.path = f.up
"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
