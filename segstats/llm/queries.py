"""One query per operator over its whole tables, with its SQL where DuckDB can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segstats.llm import decontaminate, dialogue, infill, jaccard, licenses, pieces, pii, quality, secrets, simhash, suffixes, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op9_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.token_digests(table(spark, sf, "documents"))


@query
def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.find_overlap(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query
def op7_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf, "documents"))
    count = lambda s: F.size(F.filter("found", lambda f: f["status"] == s)).cast("bigint")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secrets.said("found").alias("spans"),
        count("live").alias("n_live"), count("example").alias("n_example"),
    )


@query
def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.assess(table(spark, sf, "documents"))


@query
def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.write_archives(table(spark, sf, "pages"), folder)
    return warc.read_records(index, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SQL["op1_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT page_id, payload_bytes, d.payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND payload_bytes >= 1000
"""


@query
def op2_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.summarize(licenses.scan_licences(table(spark, sf, "documents")))


@query
def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = suffixes.remove_repeats(table(spark, sf, "documents"))
    length = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return cut.select(
        "doc_id", "n_bytes", length.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@query
def op6_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", secrets.said("found").alias("spans")
    )


@query
def op11_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf, "documents"))


@query
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    damaged = dialogue.damage(table(spark, sf, "conversations"))
    return dialogue.repair(damaged, present=F.col("present")).reports


SQL["op12_conversation_repair"] = r"""
WITH RECURSIVE keys AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), lots AS (
  -- CRC-32: each byte is put in, then eight bits are shifted out
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(key, '')])),
    lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) % 20 AS lot FROM keys
), after AS (
  SELECT conv_id, turn, CASE lot WHEN 4 THEN 'user' ELSE role END AS role,
    CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE lot WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM lots
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
    regexp_extract(text, '([^ \t\n\x0B\f\r])[ \t\n\x0B\f\r]*$', 1) AS last, substr(role, 1, 1) AS initial FROM after
), faults AS (
  SELECT *, CASE WHEN last = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM placed
), turns AS (
  SELECT *, fault IS NULL OR fault = 'truncated' AS stays, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS late FROM faults
), sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id
), back AS (
  SELECT conv_id, n + 1 AS pos, [0, 10, 5, 0] AS b FROM sums
  UNION ALL
  SELECT conv_id, pos, [least(a[1], 5 + a[3], 10 + a[4]), least(a[2], 5 + a[3], 10 + a[4]), least(a[3], 5 + a[4]), least(a[4], 5 + a[3])] FROM (
    SELECT t.conv_id, t.pos, [
      least(2 + b[1], CASE WHEN stays THEN least(1 + late + b[3], CASE initial WHEN 's' THEN late + b[2] WHEN 'u' THEN late + b[3] END) END),
      least(2 + b[2], CASE WHEN stays THEN least(1 + late + b[3], CASE initial WHEN 'u' THEN late + b[3] END) END),
      least(2 + b[3], CASE WHEN stays THEN least(1 + late + b[4], CASE initial WHEN 'a' THEN late + b[4] END) END),
      least(2 + b[4], CASE WHEN stays THEN least(1 + late + b[3], CASE initial WHEN 'u' THEN late + b[3] END) END)] AS a
    FROM back JOIN turns t ON t.conv_id IS NOT DISTINCT FROM back.conv_id AND t.pos = back.pos - 1)
), forth AS (
  SELECT conv_id, CAST(1 AS BIGINT) AS pos, 1 AS s, '' AS audit, 0 AS cost, CAST([] AS VARCHAR[]) AS said FROM sums
  UNION ALL
  SELECT conv_id, CASE op WHEN 'I' THEN pos ELSE pos + 1 END,
    CASE op WHEN 'D' THEN s WHEN 'K' THEN kept ELSE made END, audit || op,
    cost + CASE op WHEN 'D' THEN 2 WHEN 'I' THEN 5 WHEN 'K' THEN late ELSE 1 + late END,
    CASE op WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text)
      ELSE list_append(said, CASE s WHEN 3 THEN 'assistant' ELSE 'user' END || ':' || CASE op WHEN 'R' THEN text ELSE '' END) END
  FROM (
    SELECT *, CASE WHEN role IS NOT NULL AND 2 + nb[s] = cb[s] THEN 'D' WHEN 5 + cb[made] = cb[s] THEN 'I'
      WHEN stays AND late + nb[kept] = cb[s] THEN 'K' ELSE 'R' END AS op
    FROM (
      SELECT f.*, t.role, t.text, t.stays, t.late, c.b AS cb, x.b AS nb, CASE s WHEN 3 THEN 4 ELSE 3 END AS made,
        CASE WHEN s = 1 AND initial = 's' THEN 2 WHEN s <> 3 AND initial = 'u' THEN 3 WHEN s = 3 AND initial = 'a' THEN 4 END AS kept
      FROM forth f JOIN back c ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND c.pos = f.pos
      LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.pos = f.pos
      LEFT JOIN back x ON x.conv_id IS NOT DISTINCT FROM f.conv_id AND x.pos = f.pos + 1
      WHERE t.pos IS NOT NULL OR c.b[s] > 0))
), done AS (
  SELECT conv_id, audit, cost, sha256(array_to_string(said, chr(10))) AS repaired_sha256 FROM forth
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(audit) DESC) = 1
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query
def op13_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    cut = infill.restore(infill.fill_in_middle(table(spark, sf, "documents")))
    return cut.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("bigint").alias("prefix_chars"),
        F.char_length("middle").cast("bigint").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
        F.sha2("text", 256).alias("restored_sha256"),
    )


SQL["op13_fill_in_middle"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
    [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS d FROM t
), c AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, least(d[1] % (len(units) + 1), d[2] % (len(units) + 1)) AS a,
    greatest(d[1] % (len(units) + 1), d[2] % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 THEN 'plain'
      WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
    array_to_string(units[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
