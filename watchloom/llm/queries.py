"""The operators' queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.llm.common import documents


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watchloom.llm.line_dedup import dedup_lines

    out, gone, count = dedup_lines(documents(spark, sf_dir))
    lost = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone))
    return out.select("doc_id", F.col(count).alias("n_lines"), lost.alias("n_removed"), "text")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watchloom.llm.ngram_join import near_duplicates

    return near_duplicates(documents(spark, sf_dir)).select("doc.doc_id", "n_ngrams", "class_id", "n_links", "kept")


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watchloom.llm.licences import scan_licences

    return scan_licences(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watchloom.llm.pii import find_personal_data

    return find_personal_data(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watchloom.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watchloom.llm.language_id import identify

    return identify(documents(spark, sf_dir).select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watchloom.llm.media import media_columns

    return media_columns(documents(spark, sf_dir))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watchloom.llm.mixing import mix

    return mix(documents(spark, sf_dir))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watchloom.llm.pieces import encode_documents

    return encode_documents(documents(spark, sf_dir))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watchloom.llm.chat import repair_conversations

    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watchloom.llm.hard_negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", moved.alias("label"), "embedding"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watchloom.llm.resampling import resample

    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from watchloom.llm.passages import without_repeated_passages

    left = without_repeated_passages(documents(spark, sf_dir))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


# an exact join too, but by counts of shared words: rare words list the lines, and every pair listed is compared
OP1_SQL = r"""
WITH o AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(range(len(ls))) AS place, unnest(ls) AS line FROM o WHERE text IS NOT NULL),
l AS (SELECT doc_id, place, line FROM e WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT line, min((doc_id, place)) AS first, row_number() OVER (ORDER BY min((doc_id, place))) AS id FROM l GROUP BY line),
w AS (SELECT id, list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS ws FROM d),
t AS (SELECT id, len(ws) AS n, unnest(ws) AS word FROM w),
f AS (SELECT word, count(*) AS c FROM t GROUP BY word),
r AS (SELECT id, n, t.word, row_number() OVER (PARTITION BY id ORDER BY c, t.word) AS k FROM t JOIN f USING (word)),
p AS (SELECT id, n, word FROM r WHERE k <= n - ceil(0.8 * n - 1e-9) + 1),
c AS (SELECT DISTINCT a.id AS later, b.id AS earlier FROM p a JOIN p b ON a.word = b.word AND b.id < a.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
j AS (SELECT later, len(list_intersect(x.ws, y.ws)) AS common, len(x.ws) + len(y.ws) AS total FROM c JOIN w x ON x.id = later JOIN w y ON y.id = earlier),
s AS (SELECT DISTINCT later FROM j WHERE common >= 0.8 * (total - common) - 1e-9),
k AS (SELECT l.doc_id, l.place FROM l JOIN d USING (line) WHERE d.first <> (l.doc_id, l.place) OR d.id IN (SELECT later FROM s)),
g AS (SELECT e.doc_id, string_agg(CASE WHEN k.place IS NULL THEN e.line END, chr(10) ORDER BY e.place) AS text, count(k.place) AS n_removed
      FROM e LEFT JOIN k ON e.doc_id = k.doc_id AND e.place = k.place GROUP BY e.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT o.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed,
       CASE WHEN o.text IS NOT NULL THEN coalesce(g.text, '') END AS text
FROM o LEFT JOIN g ON o.doc_id = g.doc_id LEFT JOIN n ON o.doc_id = n.doc_id
"""

OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 5, 0) + 2)) AS k FROM w WHERE len(ws) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + least(5, len(ws)) - 1], ' ') AS gram FROM i),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id),
c AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY 1),
k AS (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT c.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_ngrams, class_id, coalesce(n_links, 0) AS n_links, class_id = c.doc_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id LEFT JOIN k ON k.doc_id = c.doc_id
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s0),
s2 AS (SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM s1),
s3 AS (SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
         sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_ FROM s2),
s4 AS (SELECT *, (1.5::DOUBLE * total::DOUBLE - full_::DOUBLE) / open_::DOUBLE AS level FROM s3),
s5 AS (SELECT *, (SELECT level FROM s4 WHERE level <= cap / weight ORDER BY full_, level LIMIT 1) AS water FROM s4),
s6 AS (SELECT source, place, source_size, least(cap::DOUBLE, coalesce(water * weight, cap::DOUBLE)) AS target FROM s5),
c AS (SELECT d.*, place, source_size, target,
        sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cum
      FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
e AS (SELECT doc_id, place, h, size, (cum + r * source_size)::DOUBLE / target AS finish FROM c, (VALUES (0), (1)) v(r) WHERE size > 0 AND target > 0),
f AS (SELECT *, sum(size) OVER (ORDER BY finish, place, h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM e),
t AS (SELECT doc_id, sum(size) AS taken FROM f WHERE run <= 1.5::DOUBLE * (SELECT sum(size) FROM d)::DOUBLE GROUP BY doc_id)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken FROM c LEFT JOIN t USING (doc_id)
"""

OP11_SQL = r"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM r WHERE vec_id % 50 = 0),
p AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score FROM a, r WHERE a.vec_id <> r.vec_id),
pos AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN p USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 3
"""

OP12_SQL = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i)) AS tb),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
e AS (SELECT doc_id, unnest(ws) AS w FROM d), f AS (SELECT unnest(ws) AS w FROM b),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM e UNION SELECT w FROM f)),
k AS (SELECT w, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
        lambda a, x: xor(a // 256, tb[(xor(a, x) % 256) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM v, tab),
s AS (SELECT bucket, count(*) AS s FROM e JOIN k USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM f JOIN k USING (w) GROUP BY 1),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t_all),
g AS (SELECT r.range AS bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (t_all + 10000)))) AS BIGINT) AS gain
      FROM range(10000) r LEFT JOIN s ON s.bucket = r.range LEFT JOIN t ON t.bucket = r.range, n),
m AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM e JOIN k USING (w) JOIN g USING (bucket) GROUP BY 1),
w AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
        CAST('0x' || substr(sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT)::DOUBLE AS h FROM d LEFT JOIN m ON m.doc_id = d.doc_id),
x AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM w),
y AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS may FROM x)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN n_features >= 20 AND place <= 10 * may // 100 THEN place END AS rank FROM y
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 18), lambda i: array_to_string(ws[i:i + 19], ' '))) AS words, unnest(range(1, len(ws) - 18)) AS p FROM d WHERE len(ws) >= 20),
x AS (SELECT doc_id, p, row_number() OVER (PARTITION BY words ORDER BY doc_id, p) AS k FROM i),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM x WHERE k > 1),
l AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY 1),
e AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
s AS (SELECT e.doc_id, string_agg(w, ' ' ORDER BY e.p) AS kept FROM e ANTI JOIN g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_licence_scan": op3_licence_scan,
    "op4_pii": op4_pii,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_media": op7_media,
    "op8_mix": op8_mix,
    "op9_pieces": op9_pieces,
    "op10_chat": op10_chat,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_resample": op12_resample,
    "op13_passages": op13_passages,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op2_ngram_join": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op8_mix": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op12_resample": OP12_SQL, "op13_passages": OP13_SQL}
