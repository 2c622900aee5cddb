"""The registered query of each operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm import ann, bpe, embed_join, langid, license_scan, packing, secrets, simhash, sst, url_filter
from vectrail.runtime import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules of the contract, and names of hosts that the method lists (each with the numbers 0 to 19).
BLOCK, ALLOW = ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]
LISTED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "host", "spam-farm"]
LISTED = [f"{n}{k}.example.{t}" for n in LISTED_NAMES for k in range(20) for t in ("com", "net", "org")]


def op1_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), BLOCK, ALLOW, LISTED, ["page_id"])


OP1_SQL = f"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT *, (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') AS r1,
    (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') AS r2,
    (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') AS r3,
    (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') AS r4,
    nullif(regexp_extract(host, '(^|\\.)(({"|".join(LISTED_NAMES)})([0-9]|1[0-9])\\.example\\.(com|net|org))$', 2), '') AS listed
  FROM parts)
SELECT page_id, host, path,
  CASE WHEN r2 THEN 'example.net/en/' WHEN r3 THEN 'example.com/de/' WHEN r4 THEN 'org/fr/' WHEN r1 THEN 'net/' END AS rule,
  CASE WHEN r2 OR r4 THEN 'allow' WHEN r3 OR r1 THEN 'block' WHEN listed IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  listed
FROM fits
"""


def op2_sst_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as sorted-string-table shards and read back."""
    path = shared_path(spark, "shards")
    sst.write_table(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 1)
    return sst.read_table(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences named in each document."""
    return license_scan.scan(_table(spark, sf_dir, "documents"), ["doc_id"])


def _op3_sql() -> str:
    names = {p: f"at{k}" for k, p in enumerate(license_scan.PASSAGES)}

    def listed(values: list[str]) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"

    def stands(passages: list[str]) -> str:
        return " AND ".join(f"len({names[p]}) > 0" for p in passages)

    def labels(of: list[tuple[str, list[str]]]) -> str:
        each = ", ".join(f"CASE WHEN {stands(passages)} THEN '{label}' END" for label, passages in of)
        return f"array_to_string(list_sort(list_distinct([{each}])), ',')"

    starts = ",\n  ".join(
        f"list_filter(range(0, greatest(len(words) - {len(ws) - 1}, 0)), lambda i: words[i + 1] = '{ws[0]}' AND words[i + 1 : i + {len(ws)}] = {listed(ws)}) AS {names[p]}"
        for p in license_scan.PASSAGES for ws in [p.split()]
    )
    of = [sorted({w for p in passages for w in p.split()}) for _, passages in license_scan.TEMPLATES]
    shares = ", ".join(f"0.5 * len(list_intersect({listed(ws)}, words)) / {len(ws)}.0" for ws in of)
    base = " || ".join(names[p] for p in license_scan.BASE)
    some = " OR ".join(f"({stands(passages)})" for _, passages in license_scan.TEMPLATES)
    return f"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '{license_scan.WORD}') AS words FROM documents),
found AS (
  SELECT doc_id, words, {starts} FROM split)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len({base}) AS BIGINT) AS n_base,
  list_min({base}) AS first_word, list_max({base}) AS last_word,
  {labels(license_scan.TEMPLATES[: len(license_scan.BASE)])} AS base_labels, {labels(license_scan.TEMPLATES)} AS labels,
  CAST(CASE WHEN {some} THEN 1.0 ELSE greatest({shares}) END AS DOUBLE) AS score
FROM found
"""


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each text, and the bytes decoded from them."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary).select("doc_id", "ids", "decoded")
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces packed into sequences of 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, 1024)


def op6_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language by rank-order profiles."""
    docs = _table(spark, sf_dir, "documents")
    judged = langid.predict(docs, ["doc_id"], langid.learn(docs))
    return judged.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's links and component of near-duplicates of its label."""
    return embed_join.links(_table(spark, sf_dir, "embeddings"), 0.93)


def op8_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in each document."""
    def shown(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of("assign", "access", "hex")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    found = secrets.scan(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op9_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and component of near-duplicates."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return ann.search(_table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_url_cascade,
        op2_sst_token_shards,
        op3_license_index,
        op4_byte_bpe,
        op5_best_two_fit_packing,
        op6_rank_order_language,
        op7_epsilon_grid_join,
        op8_secret_spans,
        op9_simhash_gray_index,
        op10_adaptive_dimension_scan,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_cascade": OP1_SQL, "op3_license_index": _op3_sql()}
