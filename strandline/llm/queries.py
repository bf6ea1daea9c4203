"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, decontaminate, html_text, jaccard_join, language, lm, mixing, neighbours, pii, prefix_trie, quality, repair, suffix_dedup
from .staging import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) with 0.8 or more of the item's 5-word shingles in the document."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(language.remainder("doc_id", 3) != 1))
    found = language.identify(docs.select("doc_id", "text"), model, "x")
    return found.select("doc_id", (language.remainder("doc_id", 3) == 1).alias("held_out"), "x.lang_pred", "x.score", "x.rejected")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and hash of the base spans, and all spans."""
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    counts = [pii.count_of("base", k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listing("base"), 256).alias("base_sha256"), pii.listing("spans").alias("spans"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document at a 3-word shingle similarity of 0.9."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix to target weights takes of every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(language.remainder("doc_id", 4) != 2))
    rows = docs.select("doc_id", (language.remainder("doc_id", 4) == 2).alias("held_out"), "text")
    return quality.scored(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_text.extract(table(spark, sf_dir, "pages"), "main_text")
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under the unigram and the maximum-entropy model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (language.remainder("doc_id", 7) == 2).alias("held_out"))
    return lm.scored(docs, "held_out")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings that also start earlier."""
    found = suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults planted by the crc32 of `conv_id:turn`; nulls are one space."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    known = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), of("role").alias("role"), of("text").alias("text"), F.crc32(F.concat_ws(":", of("conv_id"), of("turn"))).alias("crc"))
    known = known.withColumn("fault", F.col("crc") % 20)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return known.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest audit and hash of the repaired turns of every conversation after damage."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    after = repair.prepared(damaged(rows))
    found = staged(repair.audits(after, rows.select("conv_id")))
    hashes = repair.digests(repair.repaired(after, found)).withColumnRenamed("conv", "_conv")
    joined = found.join(hashes, F.col("conv").eqNullSafe(F.col("_conv")), "left")
    return joined.select(F.col("conv").alias("conv_id"), *repair.COUNTS, "audit", F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of words and repeats of every document, and whether the plain rules and the compression bands keep it."""
    found = compression.measured(table(spark, sf_dir, "documents").select("doc_id", "text"), "m").drop("text")
    columns = [f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    failed = compression.base_failed("m")
    return found.select("doc_id", *columns, failed.alias("base_failed"), (~failed & F.col("m.in_band")).alias("kept"), F.col("m.ratio").alias("ratio"), F.col("m.bad_share").alias("bad_share"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Turns of each conversation c: the first crc32(c) % 6 of conversation c - c % 100, then its own after as many. Placed turns in and out."""
    head = F.crc32(F.col("conv_id").cast("string")) % 6
    later = own.where(F.col("place") > head).select("conv_id", F.lit(1).alias("part"), "place", "digest", "chars")
    lead = own.where("place <= 5").select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    wanted = own.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), head.alias("head"))
    first = wanted.join(lead, "base").where("place <= head").select("conv_id", F.lit(0).alias("part"), "place", "digest", "chars")
    return first.unionByName(later).select("conv_id", F.struct("part", "place").alias("place"), "digest", "chars")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations."""
    own = prefix_trie.placed(prefix_trie.turn_keys(table(spark, sf_dir, "conversations")))
    return prefix_trie.nodes(rebuilt(own), own.select("conv_id"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_language_id, op3_pii, op4_jaccard_join, op5_mixing, op6_neighbours, op7_quality, op8_html_text, op9_lm_score, op10_suffix_dedup, op11_repair, op12_compression, op13_prefix_trie, pipeline)}

_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""


def _shingles(n: int) -> str:
    """DuckDB: the distinct n-word shingles of a word list w, or the whole sequence as one."""
    return f"""CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) END"""


#: DuckDB: the unsigned CRC-32 of an ASCII string, one letter and one bit at a time.
_CRC32 = """xor(list_reduce(list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT), lambda c, x:
  list_reduce([0::BIGINT, 1, 2, 3, 4, 5, 6, 7], lambda b, k: xor(b >> 1, 3988292384 * (b & 1)), xor(c, x)), 4294967295::BIGINT), 4294967295::BIGINT)"""
_SOLID = r"rtrim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

ORACLE = {
    "op1_decontaminate": f"""
WITH dw AS (SELECT doc_id, {_WORDS} w FROM documents WHERE text IS NOT NULL),
bw AS (SELECT item_id, {_WORDS} w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT doc_id, {_shingles(5)} s FROM dw), bs AS (SELECT item_id, {_shingles(5)} s FROM bw),
d AS (SELECT doc_id, unnest(s) g FROM ds), b AS (SELECT item_id, len(s) n, unnest(s) g FROM bs)
SELECT doc_id, item_id, CAST(n AS BIGINT) n_item, count(*) n_shared, count(*) / n AS containment
FROM d JOIN b USING (g) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n""",
    "op4_jaccard_join": f"""
WITH RECURSIVE dw AS (SELECT doc_id, {_WORDS} w FROM documents),
ds AS MATERIALIZED (SELECT doc_id, coalesce({_shingles(3)}, []) s FROM dw),
t AS MATERIALIZED (SELECT doc_id, len(s) n, unnest(s) g FROM ds),
links AS MATERIALIZED (SELECT a.doc_id x, b.doc_id y FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id
  AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM ds UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r)
SELECT ds.doc_id, CAST(len(s) AS BIGINT) n_shingles, min(r) component_id FROM ds JOIN reach ON ds.doc_id = reach.doc_id GROUP BY ds.doc_id, s""",
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) size, text, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE weight FROM s0),
s2 AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), ratio) * weight) AS target FROM s3),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size * 16777216), 33554432) ELSE 0 END::BIGINT AS each,
  ('0x' || substr(md5('mix:start:' || coalesce(source, 'null')), 1, 6))::BIGINT AS start FROM s),
p AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)), substr(bin(size), 1, 3), ('0x' || substr(k, 1, 4))::BIGINT % 64, size, doc_id NULLS FIRST, md5(coalesce(text, ''))) AS place FROM d)
SELECT doc_id, size, source_size, target, size * ((place::HUGEINT * each + start) // 16777216 - (place::HUGEINT * each + start - each) // 16777216)::BIGINT AS taken
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source""",
    "op11_repair": f"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') AS k,
  {_CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault FROM conversations),
dealt AS (SELECT k, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM given),
put AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || ':' || text), copy) AS i FROM dealt),
told AS (SELECT *, CASE WHEN role = '' THEN '' ELSE role[1] END AS c, {_SOLID.format("text")} AS solid, row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS again FROM put),
r AS MATERIALIZED (SELECT k, i, turn, role, text, c, CASE WHEN solid = '' THEN 'b' WHEN again THEN 'd' WHEN right(solid, 1) IN ('.', '!', '?') THEN '' ELSE 't' END AS flag,
  coalesce(lag(c) OVER w || c NOT IN ('su', 'ua', 'au'), false) AS odd FROM told WINDOW w AS (PARTITION BY k ORDER BY i)),
sums AS (SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (flag = 'b') AS blank, count(*) FILTER (flag = 'd') AS duplicate,
  count(*) FILTER (flag = 't') AS truncated, count(*) FILTER (odd) AS illegal FROM r GROUP BY k),
walk(k, i, st, best) AS (
  SELECT k, 0::BIGINT, '', {{'cost': 0::BIGINT, 'audit': ''}} FROM sums
  UNION ALL
  SELECT k, i, st, min(best) FROM (
    SELECT w.k, r.i, op.st, {{'cost': w.cost + op.price, 'audit': w.audit || op.name}} AS best
    FROM (SELECT k, i, st, best.cost AS cost, best.audit AS audit FROM walk
      UNION ALL SELECT k, i, CASE st WHEN 'u' THEN 'a' ELSE 'u' END, best.cost + 5, best.audit || 'I' FROM walk) w
    JOIN r ON r.k = w.k AND r.i = w.i + 1,
    LATERAL (SELECT * FROM (VALUES (w.st, 2::BIGINT, 'D', true),
      ('u', CASE WHEN r.c = 'u' THEN 0::BIGINT ELSE 1 END + CASE WHEN r.flag = 't' THEN 5 ELSE 0 END, CASE WHEN r.c = 'u' THEN 'K' ELSE 'R' END, w.st <> 'u' AND r.flag IN ('', 't')),
      ('a', CASE WHEN r.c = 'a' THEN 0::BIGINT ELSE 1 END + CASE WHEN r.flag = 't' THEN 5 ELSE 0 END, CASE WHEN r.c = 'a' THEN 'K' ELSE 'R' END, w.st = 'u' AND r.flag IN ('', 't')),
      ('s', CASE WHEN r.flag = 't' THEN 5::BIGINT ELSE 0 END, 'K', w.st = '' AND r.c = 's' AND r.flag IN ('', 't'))) o(st, price, name, able) WHERE able) op)
  GROUP BY k, i, st),
ends AS (SELECT k, min(best) AS best FROM (
  SELECT w.k, w.best FROM walk w JOIN sums USING (k) WHERE w.i = sums.n AND w.st IN ('', 'a')
  UNION ALL SELECT w.k, {{'cost': w.best.cost + 5, 'audit': w.best.audit || 'I'}} FROM walk w JOIN sums USING (k) WHERE w.i = sums.n AND w.st = 'u') GROUP BY k),
letters AS (SELECT k, p, best.audit[p] AS op, length(replace(best.audit, 'D', '')) % 2 AS odd, length(replace(left(best.audit, p), 'I', '')) AS i, length(replace(left(best.audit, p), 'D', '')) AS place
  FROM ends, LATERAL (SELECT unnest(range(1, length(best.audit) + 1)) AS p)),
lines AS (SELECT l.k, sha256(string_agg(CASE WHEN op = 'K' THEN r.role WHEN (place - l.odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY p)) AS sha
  FROM letters l LEFT JOIN r ON r.k = l.k AND r.i = l.i AND op <> 'I' WHERE op <> 'D' GROUP BY l.k),
ids AS (SELECT DISTINCT conv_id, k FROM given)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN sums USING (k) LEFT JOIN ends USING (k) LEFT JOIN lines USING (k)""",
    "op13_prefix_trie": f"""
WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS place,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS MATERIALIZED (SELECT conv_id, {_CRC32.format("conv_id::VARCHAR")} % 6 AS head FROM (SELECT DISTINCT conv_id FROM own)),
both_parts AS (SELECT i.conv_id, 0 AS part, place, role, text FROM ids i JOIN own o ON o.conv_id = i.conv_id - i.conv_id % 100 AND place <= head
  UNION ALL SELECT i.conv_id, 1, place, role, text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND place > head),
turns AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, string_agg(md5(length(role) || ':' || role || ':' || text), ' ') OVER w AS path FROM both_parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)),
m AS MATERIALIZED (SELECT conv_id, depth, chars, path, lag(path, 1, '') OVER w AS above, lead(path) OVER w IS NULL AS last FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
  UNION ALL SELECT conv_id, 0, 0, '', NULL, NOT EXISTS (SELECT 1 FROM turns t WHERE t.conv_id = ids.conv_id) FROM ids),
own_node AS MATERIALIZED (SELECT path, any_value(depth) AS depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM m GROUP BY path),
kids AS (SELECT above AS path, count(*) AS n_children FROM own_node WHERE above IS NOT NULL GROUP BY above),
v AS (SELECT o.*, coalesce(n_children, 0) AS n_children FROM own_node o LEFT JOIN kids USING (path)),
sums AS (SELECT m.path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * v.chars) AS saved FROM v JOIN m ON m.conv_id = v.conv_id AND m.depth <= v.depth GROUP BY m.path)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN sums USING (path) LEFT JOIN own_node p ON p.path = v.above""",
}
