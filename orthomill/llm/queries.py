"""The registered queries of this package: each maps the given tables to an operator and its rows back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthomill.llm import consensus, gam, hamming, line_dedup, line_frequency, manifest, mixing, packing, periodic, pseudonyms, repeats, simhash, warc
from orthomill.llm.tables import word_array, word_count

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its SQL."""
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def as_feedback(documents: DataFrame) -> DataFrame:
    """Documents under the names of the feedback record; all columns stay."""
    return documents.withColumnsRenamed({"doc_id": "tile_id", "text": "notes", "source": "source_file"})


def as_documents(feedback: DataFrame) -> DataFrame:
    """The reverse of ``as_feedback``."""
    return feedback.withColumnsRenamed({"tile_id": "doc_id", "notes": "text", "source_file": "source"})


def feedback_of(spark, sf) -> DataFrame:
    return as_feedback(spark.read.parquet(f"{sf}/documents.parquet"))


@query("op1_simhash_near_dedup")
def op1(spark, sf):
    found = simhash.near_duplicate_notes(feedback_of(spark, sf))
    return found.select(F.col("tile_id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def labels_of(spark, sf) -> DataFrame:
    """Quality labels under the names of the feedback record."""
    return spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("tile_id"), F.col("quality").alias("gt_label"))


@query("op9_gam_quality")
def op9(spark, sf):
    return gam.grade_notes(feedback_of(spark, sf), labels_of(spark, sf)).withColumnRenamed("tile_id", "doc_id")


@query("op3_line_frequency", r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
ln AS (
  SELECT rid, source, t, doc_id, i AS no, string_split(t, chr(10))[i] AS line
  FROM d, range(1, 1000000) r(i) WHERE i <= len(string_split(t, chr(10)))),
lw AS (
  SELECT rid, source, t, no, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM ln),
lx AS (SELECT *, lower(array_to_string(words, ' ')) AS norm FROM lw WHERE len(words) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, sum(len(words)) AS n_words FROM lx GROUP BY rid),
ws AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
wins AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS win FROM ws, range(1, 1000000) r(i) WHERE i <= len(w) - 7),
twice AS (SELECT *, count(*) OVER (PARTITION BY rid, win) AS n FROM wins),
hit AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice WHERE n > 1),
rep AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words FROM hit GROUP BY rid),
host AS (SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source),
freq AS (
  SELECT lx.source, norm FROM lx JOIN host ON lx.source IS NOT DISTINCT FROM host.source
  GROUP BY lx.source, norm HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) > 0.001e0 * any_value(texts)),
rem AS (
  SELECT rid, sum(len(words)) AS removed FROM lx JOIN freq ON lx.source IS NOT DISTINCT FROM freq.source AND lx.norm = freq.norm GROUP BY rid),
b AS (
  SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN rem USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (removed_words = 0 OR (n_words - removed_words >= 10 AND n_words - removed_words >= 0.2e0 * n_words)) AS kept,
       removed_words
FROM f""")
def op3(spark, sf):
    return line_frequency.judge_notes(feedback_of(spark, sf)).select(
        F.col("tile_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


@query("op10_mix_sources")
def op10(spark, sf):
    sized = feedback_of(spark, sf).select("tile_id", "source_file", word_count(F.col("notes")).alias("size"))
    return mixing.mix_records(sized).select(F.col("tile_id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op4_feistel_pseudonyms")
def op4(spark, sf):
    return pseudonyms.pseudonymise_notes(feedback_of(spark, sf).select("tile_id", "notes")).withColumnsRenamed({"tile_id": "doc_id", "notes": "text"})


def packed(documents: DataFrame) -> DataFrame:
    """The pieces of packed documents, with the ids' checksum in place of the ids."""
    import public_tokenizers
    pieces = packing.pack_notes(as_feedback(documents), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        F.col("tile_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("note_ids").alias("doc_tokens"),
        F.col("window_id").alias("sequence_id"), "offset")


@query("op6_sum_of_squares_packing")
def op6(spark, sf):
    return packed(spark.read.parquet(f"{sf}/documents.parquet"))


@query("op2_repeated_passages")
def op2(spark, sf):
    return repeats.repeated_spans(feedback_of(spark, sf)).select(
        F.col("tile_id").alias("doc_id"), "start", "length", "words", F.col("kept_tile_id").alias("kept_doc_id"))


@query("op5_multi_index_hashing", """
WITH q AS (SELECT vec_id AS doc_q, embedding AS a FROM embeddings WHERE vec_id % 100 = 0),
d AS (
  SELECT q.doc_q AS vec_id, e.vec_id AS neighbour_id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: CAST((q.a[i] > 0) <> (e.embedding[i] > 0) AS INTEGER))) AS INTEGER) AS distance
  FROM q, embeddings e),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM d)
SELECT vec_id, rank, neighbour_id, distance FROM r WHERE rank <= 10""")
def op5(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("tile_id"), F.col("embedding").alias("swin_features"))
    return hamming.nearest_tiles(vectors, vectors.filter("tile_id % 100 = 0")).withColumnRenamed("tile_id", "vec_id")


@query("op7_consensus_extraction")
def op7(spark, sf):
    return consensus.extract_pages(spark.read.parquet(f"{sf}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op8_warc_normaliser", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""")
def op8(spark, sf):
    return warc.archive_pages(spark, spark.read.parquet(f"{sf}/pages.parquet"))


@query("op13_line_dedup", """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS no FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
shared AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id""")
def op13(spark, sf):
    return line_dedup.without_shared_lines(feedback_of(spark, sf)).select(
        F.col("tile_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("notes", F.lit("")), 256).alias("kept_sha256"))


@query("op12_merkle_manifest", r"""
WITH RECURSIVE
b AS (
  SELECT *, list_reduce(list_transform(range(0, length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)) AS BIGINT)),
           lambda c, x: list_reduce(range(0, 8), lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END, xor(c, x)),
           CAST(4294967295 AS BIGINT)) AS register
  FROM documents),
e AS (
  SELECT doc_id, source,
         coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
           || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head,
         text, CASE WHEN xor(register, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS found
  FROM b),
l AS (
  SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(octet_length(encode(found)) || ':' || found, '-')) AS seen
  FROM e),
p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
lv(grp, lvl, idx, h) AS (
  SELECT grp, 0, pos, leaf FROM p
  UNION ALL
  SELECT grp, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS c FROM lv) WHERE c > 1
  GROUP BY grp, lvl, idx // 3),
sub AS (SELECT grp, lvl, h FROM lv QUALIFY lvl = max(lvl) OVER (PARTITION BY grp)),
tv(lvl, idx, h) AS (
  SELECT 0, grp, h FROM sub
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS c FROM tv) WHERE c > 1 GROUP BY lvl, idx // 3),
root AS (SELECT h AS root, lvl AS height FROM tv QUALIFY lvl = max(lvl) OVER ()),
node AS (SELECT lv.*, sub.lvl AS height FROM lv JOIN sub USING (grp) UNION ALL SELECT -1, tv.lvl, idx, h, height FROM tv, root),
sib AS (
  SELECT a.grp, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM node a JOIN node b ON a.grp = b.grp AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.lvl < a.height GROUP BY ALL),
up(grp, pos, lvl, idx, f, proof) AS (
  SELECT grp, pos, 0, pos, seen, '' FROM p
  UNION ALL
  SELECT up.grp, up.pos, up.lvl + 1, up.idx // 3, sha256(l || f || r), proof || l || r FROM up JOIN sib ON sib.grp = up.grp AND sib.lvl = up.lvl AND sib.idx = up.idx),
mid AS (SELECT up.* FROM up JOIN sub ON up.grp = sub.grp AND up.lvl = sub.lvl),
out(grp, pos, lvl, idx, f, proof) AS (
  SELECT grp, pos, 0, grp, f, proof FROM mid
  UNION ALL
  SELECT o.grp, o.pos, o.lvl + 1, o.idx // 3, sha256(l || f || r), proof || l || r FROM out o JOIN sib ON sib.grp = -1 AND sib.lvl = o.lvl AND sib.idx = o.idx)
SELECT p.doc_id, p.leaf, sub.h AS subroot, root.root, sha256(out.proof) AS proof_sha256, out.f AS folded_root, out.f = root.root AS verified
FROM p JOIN out ON out.grp = p.grp AND out.pos = p.pos JOIN sub ON sub.grp = p.grp JOIN root ON out.lvl = root.height""")
def op12(spark, sf):
    tampered = F.crc32(F.col("tile_id").cast("string")) % 2 == 0
    found = F.when(tampered, F.replace("notes", F.lit("\n"), F.lit(""))).otherwise(F.col("notes"))
    built = manifest.build(feedback_of(spark, sf), ("tile_id", "source_file", "lang", "n_chars", "notes"), {"notes": found})
    return manifest.audit(built).withColumnRenamed("tile_id", "doc_id")


def with_planted_runs(feedback: DataFrame) -> DataFrame:
    """The texts of the contract: where crc32 of the id ends in 0, the words from a on repeat those at a with period p."""
    words, n = F.col("words"), F.size("words").cast("long")
    planted = feedback.withColumns({"words": word_array(F.col("notes")), "h": F.crc32(F.col("tile_id").cast("string"))})
    planted = planted.withColumn("g", F.floor(F.col("h") / 10))
    planted = planted.withColumn("a", F.when((F.col("h") % 10 == 0) & (n > 0), F.col("g") % n))
    planted = planted.withColumn("p", F.floor((n - F.col("a")) / (F.col("g") % 8 + 3)) + 1)
    again = F.transform(words, lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get(words, (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return planted.select("tile_id", F.when(F.col("a").isNull(), F.col("notes")).otherwise(F.array_join(again, " ")).alias("notes"))


@query("op11_periodic_runs")
def op11(spark, sf):
    found = periodic.periodic_runs(with_planted_runs(feedback_of(spark, sf)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = found.withColumn("best", F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))))
    return best.select(
        F.col("tile_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"), F.floor(-F.col("best.less") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("notes", 256).alias("collapsed_sha256"))
