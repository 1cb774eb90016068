"""Queries of the training-data operators: opN_<name> -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embedding_dedup, langid, licenses, mixing, packing, preference, quality, runs, simhash, substring_dedup, urls, variants
from .common import table


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


#: Word windows by list positions. Rows are taken apart by rowid, so that equal ids stay apart.
OP6_SQL = r"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT rid, s, array_to_string(list_slice(words, s, s + 34), ' ') AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 33)) AS s FROM docs)),
twice AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY w) AS c FROM windows) WHERE c > 1),
gone AS (SELECT DISTINCT rid, unnest(range(s, s + 35)) AS i FROM twice),
lost AS (SELECT rid, list(i) AS gone FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM docs LEFT JOIN lost USING (rid)
"""

def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _sainte_lague_sql(name: str, parties: str, group: str, party: str, weight: str, total: str, seats: str) -> str:
    part = f"PARTITION BY {group}" if group else ""
    keys = f"{group}, {party}" if group else party
    return f"""
{name}_p AS (SELECT *, greatest(0, CAST(floor({seats} * {weight} / {total} + 0.5) AS BIGINT) - d) AS low
             FROM (SELECT *, CAST(ceil(count(*) OVER ({part}) / 2 * {weight} / {total}) AS BIGINT) + 2 AS d FROM {parties} WHERE {weight} > 0 AND {seats} > 0)),
{name}_r AS (SELECT *, {seats} - sum(low) OVER ({part}) AS rest FROM {name}_p),
{name}_s AS (SELECT {keys}, rest, {weight} / (2 * (low + j) + 1) AS q, j FROM (SELECT *, unnest(range(0, 2 * d + 1)) AS j FROM {name}_r)),
{name}_w AS (SELECT {keys}, count(*) AS won FROM (SELECT *, row_number() OVER ({part} ORDER BY q DESC, {party}, j) AS place FROM {name}_s) WHERE place <= rest GROUP BY {keys}),
{name} AS (SELECT a.*, CAST(coalesce(r.low, 0) + coalesce(w.won, 0) AS BIGINT) AS quota FROM {parties} a LEFT JOIN {name}_r r USING ({keys}) LEFT JOIN {name}_w w USING ({keys}))"""


OP8_SQL = r"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(text) AS digest FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM per),
weighed AS (SELECT *, CAST(1 + (sid - 1) % 3 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM ranked),
leveled AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT *, least(cap, max(level) OVER () * w) AS target, CAST(floor(total / 16 + 0.5) AS BIGINT) AS seats FROM leveled),
""" + _sainte_lague_sql("bysource", "targets", "", "sid", "target", "total", "seats") + r""",
placed AS (SELECT s.*, b.sid, b.source_size, b.target, b.quota AS source_quota, md5(coalesce(CAST(s.doc_id AS VARCHAR), '') || '#' || coalesce(s.digest, '') || '#8') AS mark,
                  greatest(1, CAST(ceil(b.source_size / 1000000) AS BIGINT)) AS shards
           FROM sizes s JOIN bysource b ON s.source IS NOT DISTINCT FROM b.source),
dealt AS (SELECT *, CAST('0x' || substr(mark, 1, 8) AS BIGINT) % shards AS shard FROM placed),
shardsizes AS (SELECT sid, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(source_size) AS source_size, any_value(source_quota) AS source_quota FROM dealt GROUP BY sid, shard),
""" + _sainte_lague_sql("byshard", "shardsizes", "sid", "shard", "shard_size", "source_size", "source_quota") + r""",
takes AS (SELECT sid, shard, shard_size, CASE WHEN shard_size > 0 THEN least(quota * 16, shard_size * 3) // shard_size ELSE 0 END AS full_rounds,
                 CASE WHEN shard_size > 0 THEN least(quota * 16, shard_size * 3) % shard_size ELSE 0 END AS rest,
                 CAST('0x' || substr(md5(sid || '#' || shard || '#8'), 1, 8) AS BIGINT) % greatest(1, CAST(ceil(shard_size / 16) AS BIGINT)) * 16 AS off
          FROM byshard),
laid AS (SELECT *, CAST(sum(size) OVER (PARTITION BY sid, shard ORDER BY mark, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM dealt)
SELECT doc_id, size, source_size, target,
       CAST(full_rounds * size + greatest(0, least(stop, off + rest) - greatest(stop - size, off)) + greatest(0, least(stop, off + rest - shard_size) - (stop - size)) AS BIGINT) AS taken
FROM laid JOIN takes USING (sid, shard)
"""

def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.segments(preference.paired(table(spark, sf_dir, "conversations")))


OP4_SQL = """
WITH t AS (SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 = 0 AS chosen, coalesce(CAST(turn AS BIGINT), 9223372036854775807) AS turn,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT pair_id, turn, role, text, bool_or(chosen) AS c, bool_or(NOT chosen) AS j FROM t GROUP BY ALL),
e AS (SELECT pair_id, min(turn) AS stop FROM r WHERE NOT (c AND j) GROUP BY pair_id),
p AS (SELECT r.*, unnest(CASE WHEN stop IS NULL OR turn < stop THEN ['prompt'] WHEN c AND j THEN ['chosen', 'rejected'] WHEN c THEN ['chosen'] ELSE ['rejected'] END) AS part
      FROM r LEFT JOIN e USING (pair_id)),
m AS (SELECT *, part <> 'prompt' AND role = 'assistant' AS learns, length('<|im_start|>' || role || chr(10)) AS head FROM p)
SELECT pair_id, part, nullif(turn, 9223372036854775807) AS turn, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS segment,
       CAST(CASE WHEN learns THEN head ELSE 0 END AS INTEGER) AS mask_from, CAST(CASE WHEN learns THEN head + length(text) + 10 ELSE 0 END AS INTEGER) AS mask_to
FROM m
"""


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def _op10_sql() -> str:
    rows = licenses.template_rows()
    text = ", ".join(f"({n}, '{name}', '{anchor}', {place}, {size})" for n, name, anchor, place, size, _ in rows)
    sets = ", ".join(f"({n}, [{', '.join(repr(x) for x in bigrams)}])" for n, bigrams in {r[0]: r[5] for r in rows}.items())
    return f"""
WITH known(template, license, anchor, place, size) AS (VALUES {text}),
sets(template, bigrams) AS (VALUES {sets}),
d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM documents WHERE text IS NOT NULL),
p AS (SELECT rid, doc_id, words, i, words[i + 1] || ' ' || words[i + 2] AS pair FROM (SELECT *, unnest(range(0, len(words) - 1)) AS i FROM d)),
h AS (SELECT rid, doc_id, words, template, license, greatest(0, i - place) AS start, least(len(words), i - place + size) AS stop FROM p JOIN known ON pair = anchor),
u AS (SELECT DISTINCT rid, doc_id, template, license, start, stop - start AS n, words[start + 1:stop] AS unit FROM h),
b AS (SELECT rid, doc_id, template, license, start, n, bigrams, list_distinct(list_transform(range(1, n), lambda i: unit[i] || ' ' || unit[i + 1])) AS own FROM u JOIN sets USING (template)),
f AS (SELECT rid, doc_id, template, license, start, n, 2.0::DOUBLE * len(list_intersect(own, bigrams)) / (len(own) + len(bigrams)) AS dice FROM b),
g AS (SELECT * FROM f WHERE dice >= {licenses.THRESHOLD})
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(n AS BIGINT) AS words, license, dice FROM g a
WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.rid = a.rid AND a.start < b.start + b.n AND b.start < a.start + a.n
                  AND row(-b.dice, -b.n, b.license, b.template, b.start) < row(-a.dice, -a.n, a.license, a.template, a.start))
"""

#: crc32 of a string in DuckDB: the table of the polynomial, then a fold over the bytes of its UTF-8 form.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS steps)"


def _crc32_sql(text: str) -> str:
    number = "CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT)"
    return f"xor(list_reduce(list_transform(range(0, len(hx) // 2), lambda i: {number}), lambda c, b: xor(c // 256, steps[xor(c, b) % 256 + 1]), 4294967295), 4294967295)".replace("hx", f"hex(encode({text}))")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(runs.with_repeats(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.col("best")
    return found.withColumn("best", runs.longest_exponent(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Pairs of equal words a period apart, as islands: rows taken apart by rowid, every period's stretches, of which the smallest period of each stays.
OP11_SQL = r"""
WITH """ + CRC_TABLE + r""",
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, """ + _crc32_sql("CAST(doc_id AS VARCHAR)") + r""" AS h FROM documents, crc),
g AS (SELECT *, len(words) AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN words ELSE list_transform(range(0, n), lambda i: words[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS words FROM p),
w AS (SELECT rid, n, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM t),
e AS (SELECT x.rid, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
l AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM e) GROUP BY rid, q, island),
r AS (SELECT rid, start, length, min(q) AS period FROM l WHERE length >= greatest(24, 3 * q) GROUP BY rid, start, length),
s AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY rid),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM r) WHERE k = 1),
x AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
k AS (SELECT w.rid, string_agg(w.w, ' ' ORDER BY w.i) AS kept FROM w LEFT JOIN x ON w.rid = x.rid AND w.i = x.i WHERE x.i IS NULL GROUP BY w.rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN s USING (rid) LEFT JOIN b USING (rid) LEFT JOIN k USING (rid)
"""

#: Fixed values of the contract: the rules that the pages are judged by.
OP12_RULES = "('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')"


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {OP12_RULES} AS r(host, path, verdict)")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


OP12_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {OP12_RULES}),
c AS (SELECT page_id, row_number() OVER () AS rid, CASE WHEN contains(url, '://') THEN regexp_replace(substr(url, instr(url, '://') + 3), '[?#].*$', '', 's') ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, rid, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM c),
f AS (SELECT u.rid, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY u.rid ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC) AS k
      FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (rid)
"""


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.vocabulary(variants.with_typos(variants.occurrences(table(spark, sf_dir, "documents"))))
    return variants.forms(words)


#: Near words share what is left without a letter at one place (replaced), or one is what the other leaves (inserted).
OP13_SQL = r"""
WITH RECURSIVE """ + CRC_TABLE + r""",
o AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents) WHERE length(w) >= 5 GROUP BY ALL),
h AS (SELECT w, c, """ + _crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w") + r""" AS h FROM o, crc),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
b AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, n AS near_n, row_number() OVER (PARTITION BY word ORDER BY n DESC, encode(near)) AS k FROM p),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN (SELECT * FROM b WHERE k = 1) b ON v.word = b.word),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT w.word, f.form FROM walk w JOIN f ON f.word = w.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk w ON f.word = w.word JOIN f l ON l.word = w.at AND l.form IS NULL
"""


QUERIES = {
    "op1_packing": op1_packing,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_nearest": op3_nearest,
    "op4_preference": op4_preference,
    "op5_language_id": op5_language_id,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_licenses": op10_licenses,
    "op11_runs": op11_runs,
    "op12_urls": op12_urls,
    "op13_variants": op13_variants,
}
ORACLE_SQL = {"op4_preference": OP4_SQL, "op6_substring_dedup": OP6_SQL, "op8_mixing": OP8_SQL, "op10_licenses": _op10_sql(), "op11_runs": OP11_SQL, "op12_urls": OP12_SQL, "op13_variants": OP13_SQL}
