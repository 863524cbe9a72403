"""The queries over the given tables, one for each operator of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.quality import BOILERPLATE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.quality import clean

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return clean(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(*names)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.chat import digest, format_chats

    says = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return digest(format_chats(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.decontam import WINDOW, hits

    found = hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), distance=WINDOW)
    ids = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids, "contaminated", F.size("near_ids").cast("long").alias("n_near"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.tokens import digest, token_table

    return digest(token_table(_table(spark, sf_dir, "documents"), end_id=2))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.lm import scores

    return scores(_table(spark, sf_dir, "documents"))


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.license import licenses

    found = licenses(_table(spark, sf_dir, "documents"))
    return found.withColumn("licenses", F.array_join("licenses", ",")).withColumn("dice", F.round("dice", 6))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.packing import packed

    return packed(_table(spark, sf_dir, "documents"), digest=True)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.substrings import digest

    return digest(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.alignment import alignment

    return alignment(_table(spark, sf_dir, "documents"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weirflow.llm.jaccard import near_sets

    return near_sets(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_simhash, op3_chat, op4_decontamination, op5_token_ids, op6_lm, op7_license, op8_packing, op9_toxicity, op10_substrings, op11_collocations, op12_alignment, op13_jaccard)}


_BOILERPLATE = "|".join(BOILERPLATE)

OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
m AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM m) GROUP BY 1),
x AS (SELECT rid, x, list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS xw FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d)),
p AS (SELECT rid, sum(length(array_to_string(xw, ''))) AS n FROM x WHERE NOT (
    len(regexp_extract_all(x, '[#*$%&|<>]')) > length(x) * 0.1
    OR (len(regexp_extract_all(x, '\|')) >= 3 AND len(regexp_extract_all(x, '\|')) * 6 >= len(xw))
    OR (len(xw) >= 6 AND len(regexp_extract_all(x, '!')) * 2 >= len(xw))
    OR (len(xw) >= 8 AND len(list_distinct(xw)) < len(xw) * 0.3)
    OR regexp_matches(x, '(?i){_BOILERPLATE}')) GROUP BY 1),
c AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(p.n, 0) AS left_chars
FROM w LEFT JOIN r USING (rid) LEFT JOIN p USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND left_chars / CAST(word_chars AS double) >= 0.7 AS kept FROM b
"""

_SAYS = "\\### Assistant: </turn> ok"
OP3_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{_SAYS}'), (-7, 1, 'assistant', '{_SAYS}')) v(conv_id, turn, r, t)),
e AS (SELECT conv_id, bool_or(regexp_matches(t, '</?(turn|chat)')) AS escaped FROM c GROUP BY 1),
l AS (SELECT c.*, 15 + length(r) + len(regexp_extract_all(r, '[\\<>]')) + length(t) + CASE WHEN escaped THEN len(regexp_extract_all(t, '[\\<]')) ELSE 0 END AS n FROM c JOIN e USING (conv_id))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::bigint AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
(20 + sum(n))::bigint AS formatted_chars FROM l GROUP BY conv_id
"""

OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS j FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, n, array_to_string(w[j : j + n - 1], ' ') AS g FROM i),
s AS (SELECT DISTINCT n FROM k),
o AS (SELECT rid, n, j, array_to_string(w[j : j + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM d, s)),
h AS (SELECT rid, k.n, j, item_id FROM o JOIN k ON o.g = k.g AND o.n = k.n),
p AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(j, j + n)) AS q FROM h) GROUP BY 1),
t AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS varchar) AS id FROM h) GROUP BY 1),
u AS (SELECT item_id, row_number() OVER () AS bid, w FROM b WHERE len(w) > 0),
x AS (SELECT bid, q, w[q] AS term FROM (SELECT bid, w, unnest(range(1, len(w) + 1)) AS q FROM u)),
y AS (SELECT rid, q, w[q] AS term FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS q FROM d) WHERE w[q] IN (SELECT term FROM x)),
f AS (SELECT term, count(*) AS f FROM y GROUP BY 1),
r AS (SELECT v.bid, v.j, x.term, coalesce(f.f, 0) AS f, row_number() OVER (PARTITION BY v.bid, v.j ORDER BY coalesce(f.f, 0), x.q) AS k
FROM (SELECT bid, len(w) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS j FROM u) v JOIN x ON x.bid = v.bid AND x.q BETWEEN v.j AND v.j + 12 LEFT JOIN f USING (term)),
a AS (SELECT DISTINCT r1.bid, r1.term AS t1, coalesce(r2.term, r1.term) AS t2 FROM (SELECT * FROM r WHERE k = 1 AND f > 0) r1 LEFT JOIN (SELECT * FROM r WHERE k = 2) r2 ON r1.bid = r2.bid AND r1.j = r2.j),
m AS (SELECT rid, count(DISTINCT CAST(item_id AS varchar)) AS n_near FROM (SELECT DISTINCT y1.rid, a.bid FROM a JOIN y y1 ON y1.term = a.t1 JOIN y y2 ON y2.rid = y1.rid AND y2.term = a.t2 AND abs(y1.q - y2.q) <= 13) JOIN u USING (bid) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid) LEFT JOIN m USING (rid)
"""


#: Bytes as two hexadecimal digits each.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT rid, doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0), 500)) AS c FROM d WHERE doc_id IS NOT NULL),
p AS (SELECT rid, doc_id, c, substr(h, 2 * c + 1, 1098) AS h FROM q),
s AS (SELECT rid, doc_id, c + i AS j, substr(h, 2 * i + 1, 100) AS g FROM (SELECT *, unnest(range(0, length(h) // 2 - 49)) AS i FROM p)),
m AS (SELECT g, min(doc_id) AS least FROM s GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
k AS (SELECT rid, j, CASE WHEN j <= lag(j) OVER (PARTITION BY rid ORDER BY j) + 50 THEN 0 ELSE 1 END AS new FROM s JOIN m USING (g) WHERE least < doc_id),
r AS (SELECT rid, min(j) AS b, max(j) + 50 AS e FROM (SELECT rid, j, sum(new) OVER (PARTITION BY rid ORDER BY j ROWS UNBOUNDED PRECEDING) AS run FROM k) GROUP BY rid, run),
c AS (SELECT r.rid, b, e, substr(h, 2 * coalesce(lag(e) OVER w, 0) + 1, 2 * (b - coalesce(lag(e) OVER w, 0))) AS piece FROM r JOIN d USING (rid) WINDOW w AS (PARTITION BY r.rid ORDER BY b)),
t AS (SELECT rid, sum(e - b)::bigint AS n_removed, count(*) AS n_spans, max(e) AS e, string_agg(piece, '' ORDER BY b) AS pieces FROM c GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(pieces, '') || substr(h, 2 * coalesce(t.e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (rid)
"""


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, sum(len(w))::bigint AS n FROM w GROUP BY 1),
f AS (SELECT lang, k, g, count(*) AS f FROM (SELECT lang, k, w[i : i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) s(k))) GROUP BY ALL),
c AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= 10),
v AS (SELECT *, g[1 : cut] AS g1, g[cut + 1 : k] AS g2 FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT v.lang, v.k, v.g, v.a, cut, x.f AS l, y.f AS r, ((1000000::hugeint * v.a * v.a) // (x.f::hugeint * y.f))::bigint AS score
FROM v JOIN f x ON x.lang = v.lang AND x.g = v.g1 JOIN f y ON y.lang = v.lang AND y.g = v.g2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, k, g ORDER BY score, cut) AS o FROM s) WHERE o = 1),
d AS (SELECT DISTINCT x.lang, x.g FROM c x JOIN (SELECT lang, a, g[1 : 2] AS g FROM c WHERE k = 3 UNION ALL SELECT lang, a, g[2 : 3] FROM c WHERE k = 3) y ON x.k = 2 AND x.lang = y.lang AND x.g = y.g AND 100 * y.a >= 50 * x.a),
r AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.g, ' ')) AS rank, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM b ANTI JOIN d ON b.k = 2 AND b.lang = d.lang AND b.g = d.g)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN t USING (lang) WHERE rank <= 2000
"""


OP13_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT rid, rid AS q FROM d UNION SELECT r.rid, e.y FROM r JOIN e ON r.q = e.x),
c AS (SELECT r.rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.q GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are tested against plain versions and held-out rows."""
    return {"op1_quality": OP1_SQL, "op3_chat": OP3_SQL, "op4_decontamination": OP4_SQL, "op10_substrings": OP10_SQL, "op11_collocations": OP11_SQL, "op13_jaccard": OP13_SQL}
