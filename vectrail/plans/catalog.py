"""Registered queries over the reference capabilities, with SQL that states their results.

Scores are rounded to 6 digits, so that the two engines' orders of summation do not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.functions import sql as Q
from vectrail.functions import text as T
from vectrail.functions import vectors as V
from vectrail.functions.text import ChunkOptions
from vectrail.operators import search as S
from vectrail.operators.chunking import chunk
from vectrail.operators.embedding import EmbeddingService, HashProvider, hash_embedding
from vectrail.operators.store import DiskStore, VectorStore, live
from vectrail.runtime import shared_path
from vectrail.sources import vectorfile

DIMS = 64
#: Formats, and the token limit of each format's chunk query.
PRESETS = ("markdown", "plain", "csharp", "javascript", "html", "css", "python")
LIMITS = {"markdown": 50, "plain": 40, "csharp": 60, "javascript": 60, "html": 30, "css": 50, "python": 50}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as rows of a store; seq is vec_id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"), V.magnitude(F.col("embedding")).alias("magnitude"), F.col("vec_id").alias("seq"))


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One vector, for a literal of the plan."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def hits(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c != "score"], F.round("score", 6).alias("score"))


COSINE = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"


def topk_sql(where: str = "true", k: int = 10, q: int = 0) -> str:
    return f"SELECT e.vec_id AS id, round({COSINE}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = {q} AND {where} ORDER BY {COSINE} DESC, e.vec_id LIMIT {k}"


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS magnitude FROM embeddings")
def vector_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.magnitude(F.col("embedding")), 6).alias("magnitude"))


@query("SELECT e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS dot FROM embeddings e, embeddings q WHERE q.vec_id = 0")
def dot_product_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.literal(vector_of(spark, sf_dir, 0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.dot(q, F.col("embedding")), 6).alias("dot"))


@query(f"SELECT e.vec_id AS id, round({COSINE}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0")
def cosine_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(S.scored(store_rows(spark, sf_dir), vector_of(spark, sf_dir, 0)))


@query(topk_sql())
def search_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: exact cosine top-10 for the vector with vec_id 0."""
    return hits(S.top_k(store_rows(spark, sf_dir), vector_of(spark, sf_dir, 0), 10, DIMS))


@query(topk_sql(q=1))
def sql_search_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in SQL text; the query is a parameter."""
    Q.register(spark)
    statement = """
      SELECT vec_id AS id, round(exact, 6) AS score FROM (SELECT vec_id, vec_cosine(embedding, CAST(:q AS ARRAY<FLOAT>)) AS exact FROM {rows})
      ORDER BY exact DESC, vec_id LIMIT 10"""
    return spark.sql(statement, args={"q": V.literal(vector_of(spark, sf_dir, 1))}, rows=table(spark, sf_dir, "embeddings"))


@query(topk_sql("e.vec_id % 7 = 0"))
def search_id_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(S.top_k(store_rows(spark, sf_dir), vector_of(spark, sf_dir, 0), 10, DIMS, F.col("id") % 7 == 0))


@query(topk_sql("e.vec_id % 3 = 1"))
def search_callable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter is a Python callable on the id."""
    return hits(S.top_k(store_rows(spark, sf_dir), vector_of(spark, sf_dir, 0), 10, DIMS, lambda i: i % 3 == 1))


@query(topk_sql("e.vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def search_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only ids of labelled documents of good quality."""
    allowed = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return hits(S.top_k(store_rows(spark, sf_dir), vector_of(spark, sf_dir, 0), 10, DIMS, allowed))


@query(topk_sql("false"))
def search_filter_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(S.top_k(store_rows(spark, sf_dir), vector_of(spark, sf_dir, 0), 10, DIMS, F.col("id") < 0))


@query(topk_sql(k=1_000_000_000, q=3))
def search_k_exceeds_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(S.top_k(store_rows(spark, sf_dir), vector_of(spark, sf_dir, 3), 1_000_000_000, DIMS))


@query(topk_sql("false"))
def search_k_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(S.top_k(store_rows(spark, sf_dir), vector_of(spark, sf_dir, 0), 0, DIMS))


@query(topk_sql("false"))
def search_zero_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(S.top_k(store_rows(spark, sf_dir), [0.0] * DIMS, 10, DIMS))


@query(f"SELECT e.vec_id AS id, 0.0 AS score FROM embeddings e WHERE vec_id < 0 UNION ALL SELECT -1, 0.0 UNION ALL (SELECT * FROM ({topk_sql(k=1_000_000_000)}))")
def search_zero_vector_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored zero vector is a hit of score 0."""
    zero = spark.createDataFrame([(-1, [0.0] * DIMS, 0.0, -1)], "id bigint, values array<float>, magnitude double, seq bigint")
    return hits(S.top_k(store_rows(spark, sf_dir).unionByName(zero), vector_of(spark, sf_dir, 0), 1_000_000_000, DIMS))


@query(
    f"""SELECT e.vec_id AS id, 'store' || (e.label % 3) AS store_name, round({COSINE}, 6) AS score
FROM embeddings e, embeddings q WHERE q.vec_id = 5 ORDER BY {COSINE} DESC, store_name, e.vec_id LIMIT 15"""
)
def multi_store_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stores, one global top-15 with the store's name."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"), F.col("vec_id").alias("order"), "label")
    stores = [VectorStore.of(f"store{k}", DIMS, rows.where(F.col("label") % 3 == k)) for k in range(3)]
    return hits(S.search_stores(stores, vector_of(spark, sf_dir, 5), 15))


@query(
    f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {COSINE} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 10 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 5"""
)
def batch_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth vector as a query, against all rows."""
    rows = store_rows(spark, sf_dir)
    found = S.batch_top_k(rows, rows.where(F.col("id") % 10 == 0).select(F.col("id").alias("query_id"), "values"), 5)
    return hits(found.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"))


@query(
    f"""WITH e AS (SELECT 'v' || vec_id AS id, vec_id % 19 = 6 AS zero, embedding FROM embeddings WHERE vec_id % 11 <> 3 AND vec_id % 13 <> 5 AND vec_id % 17 <> 4),
s AS (SELECT 'q' || q.vec_id AS query_id, e.id, CASE WHEN e.zero THEN 0.0 ELSE {COSINE} END AS score FROM e, embeddings q WHERE q.vec_id % 10 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 300"""
)
def batch_top300_odd_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are strings; some rows are null, some hold NaN or infinity, some are zero."""
    e = table(spark, sf_dir, "embeddings")
    n = F.col("vec_id")
    bad = F.when(n % 13 == 5, F.lit("NaN")).otherwise(F.lit("Infinity")).cast("float")
    odd = F.when(n % 11 == 3, F.lit(None)).when((n % 13 == 5) | (n % 17 == 4), F.transform("embedding", lambda x, i: F.when(i == 7, bad).otherwise(x)))
    values = odd.when(n % 19 == 6, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding"))
    asked = e.where(n % 10 == 0).select(F.concat(F.lit("q"), n.cast("string")).alias("query_id"), F.col("embedding").alias("values"))
    found = S.batch_top_k(e.select(F.concat(F.lit("v"), n.cast("string")).alias("id"), values.alias("values")), asked, 300)
    return hits(found.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"))


@query(f"SELECT count(*) AS hits, round(max(score), 6) AS best, round(min(score), 6) AS worst FROM ({topk_sql(k=100)})")
def topk_heap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and extremes of a bounded top-100."""
    found = hits(S.top_k(store_rows(spark, sf_dir), vector_of(spark, sf_dir, 0), 100, DIMS))
    return found.agg(F.count("*").alias("hits"), F.max("score").alias("best"), F.min("score").alias("worst"))


def memory_store(spark: SparkSession, sf_dir: str) -> VectorStore:
    e = table(spark, sf_dir, "embeddings")
    return VectorStore.of("memory", DIMS, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"), F.col("vec_id").alias("order")))


def listed(df: DataFrame) -> DataFrame:
    return df.groupBy("id").agg(F.count("*").alias("copies"), F.round(F.sum("magnitude"), 4).alias("magnitudes"))


NORM = "sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))"


@query(f"SELECT vec_id AS id, count(*) AS copies, round(sum({NORM}), 4) AS magnitudes FROM (SELECT * FROM embeddings UNION ALL SELECT * FROM embeddings WHERE vec_id % 4 = 0) GROUP BY 1")
def store_add_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids added again stand beside the first ones."""
    store = memory_store(spark, sf_dir)
    again = table(spark, sf_dir, "embeddings").where("vec_id % 4 = 0")
    return listed(store.add(again.select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"), F.col("vec_id").alias("order"))).rows)


@query(f"SELECT vec_id AS id, count(*) AS copies, round(sum({NORM}), 4) AS magnitudes FROM (SELECT * FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT * FROM embeddings WHERE vec_id % 4 = 0) GROUP BY 1")
def store_remove_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ids added twice, the first row goes."""
    store = memory_store(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    twice = store.add(e.where("vec_id % 4 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"), F.col("vec_id").alias("order")))
    return listed(twice.remove_first(e.where("vec_id % 5 = 0").select("vec_id")).rows)


@query(topk_sql("e.vec_id % 3 <> 0"))
def store_tombstone_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key has a later tombstone are not found."""
    rows = store_rows(spark, sf_dir)
    gone = rows.where("id % 3 = 0").select("id", (F.col("seq") + 1_000_000_000).alias("seq"))
    return hits(S.top_k(live(rows, gone), vector_of(spark, sf_dir, 0), 10, DIMS))


@query("SELECT vec_id AS id, CAST(CASE WHEN vec_id % 3 = 0 AND vec_id % 2 = 0 THEN 1 ELSE 1 END AS BIGINT) AS copies FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 2 = 0")
def store_readd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys removed and then added again are seen once."""
    rows = store_rows(spark, sf_dir)
    late = 1_000_000_000
    gone = rows.where("id % 3 = 0").select("id", (F.col("seq") + late).alias("seq"))
    again = rows.where("id % 6 = 0").withColumn("seq", F.col("seq") + 2 * late)
    return live(rows.unionByName(again), gone).groupBy("id").agg(F.count("*").alias("copies"))


@query("SELECT count(*) AS rows, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings WHERE vec_id <> 7")
def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store on disk after a removal and a compaction."""
    store = DiskStore(spark, "disk", shared_path(spark, "store"), DIMS)
    e = table(spark, sf_dir, "embeddings")
    store.add(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"), F.col("vec_id").alias("order")))
    store.remove(7)
    store.compact()
    return store.rows.agg(F.count("*").alias("rows"), F.sum("id").alias("ids"))


@query("SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def store_roundtrip_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = DiskStore(spark, "disk", shared_path(spark, "store"), DIMS)
    e = table(spark, sf_dir, "embeddings")
    store.add(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"), F.col("vec_id").alias("order")))
    return DiskStore(spark, "again", store.path, DIMS).rows.select("id", F.round(summed("values"), 5).alias("total"))


def summed(column: str) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double"))


@query("SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 5) AS total, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS magnitude FROM embeddings")
def store_roundtrip_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in the binary format and read back."""
    vectorfile.register(spark)
    path = shared_path(spark, "vectors")
    memory_store(spark, sf_dir).save(path, "bigint")
    rows = VectorStore.load(spark, "again", DIMS, path, "bigint").rows
    return rows.select("id", F.round(summed("values"), 5).alias("total"), F.round(F.col("magnitude").cast("double"), 5).alias("magnitude"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS total FROM embeddings")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.l2_normalize(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT vec_id // 8 AS text_id, CAST(pos AS INTEGER) AS pos, round(avg(x), 6) AS mean FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings WHERE vec_id % 3 <> 0) GROUP BY 1, 2")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of eight token vectors each; the mean of those whose mask is 1."""
    e = table(spark, sf_dir, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    texts = e.groupBy(F.expr("vec_id div 8").alias("text_id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding", "mask"))).alias("t"))
    mean = V.masked_mean(F.transform("t", lambda t: t["embedding"].cast("array<double>")), F.transform("t", lambda t: t["mask"]))
    return texts.select("text_id", F.posexplode(mean).alias("pos", "x")).select("text_id", "pos", F.round("x", 6).alias("mean"))


def source_of(preset: str) -> tuple[str, str, str]:
    return ("pages", "page_id", "html") if preset == "html" else ("documents", "doc_id", "text")


def segments_sql(preset: str) -> str:
    name, key, column = source_of(preset)
    end, more = T.SEGMENT_ENDS[preset]
    return f"SELECT {key} AS key, regexp_extract_all({column}, '(?s:.*?{end}{more}|.+$)') AS segs FROM {name} WHERE {column} <> ''"


def _segments(preset: str) -> Callable:
    name, key, column = source_of(preset)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, name).select(F.col(key).alias("key"), F.posexplode(T.segments(F.col(column), preset)).alias("segment_index", "segment"))
        return rows.select("key", "segment_index", F.md5("segment").alias("segment_md5"), F.length("segment").alias("chars"))

    return run


def stop_sql(segment: str, preset: str) -> str:
    stops = T.STOP_SIGNALS[preset]
    return "(" + " OR ".join(f"starts_with(regexp_replace({segment}, '^\\s+', ''), '{s}')" for s in stops) + ")" if stops else "false"


def chunks_sql(preset: str, most: int, segs: str | None = None, count: str = "len(regexp_extract_all({}, '\\S+'))", stop: str | None = None, additive: bool | None = None) -> str:
    """Rows (key, chunk_index, chunk): of a preset, or of any segments (key, segs), count and stop condition (on x.cur)."""
    additive = preset in T.ADDITIVE if additive is None else additive
    total = f"acc.n + {count.format('x.cur')}" if additive else count.format("acc.cur || x.cur")
    fits = f"acc.n < {most} AND NOT {stop or stop_sql('x.cur', preset)} AND {total} <= {most}"
    return f"""WITH s AS ({segs or segments_sql(preset)}),
f AS (SELECT key, list_reduce(list_transform(segs, lambda g: {{'out': []::VARCHAR[], 'cur': g, 'n': {count.format('g')}}}),
  lambda acc, x: CASE WHEN {fits} THEN {{'out': acc.out, 'cur': acc.cur || x.cur, 'n': {total}}}
    ELSE {{'out': list_append(acc.out, acc.cur), 'cur': x.cur, 'n': x.n}} END) AS r FROM s),
c AS (SELECT key, list_append(r.out, r.cur) AS chunks FROM f)
SELECT key, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) - 1 AS chunk_index FROM c"""


def chunked(spark: SparkSession, sf_dir: str, preset: str, most: int) -> DataFrame:
    name, key, column = source_of(preset)
    rows = table(spark, sf_dir, name).select(F.col(key).alias("key"), F.col(column).alias("text"))
    return chunk(rows, ChunkOptions(most, preset, preset), keep=("key",))


def _chunks(preset: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = chunked(spark, sf_dir, preset, LIMITS[preset])
        return rows.select("key", "chunk_index", F.md5("chunk").alias("chunk_md5"), T.count_words(F.col("chunk")).cast("long").alias("tokens"))

    return run


for _preset in PRESETS:
    QUERIES[f"segments_{_preset}"] = _segments(_preset)
    SQL[f"segments_{_preset}"] = (
        f"WITH s AS ({segments_sql(_preset)}), u AS (SELECT key, unnest(segs) AS segment, generate_subscripts(segs, 1) - 1 AS i FROM s) "
        "SELECT key, CAST(i AS INTEGER) AS segment_index, md5(segment) AS segment_md5, CAST(length(segment) AS INTEGER) AS chars FROM u"
    )
    QUERIES[f"chunks_{_preset}"] = _chunks(_preset)
    SQL[f"chunks_{_preset}"] = (
        f"SELECT key, CAST(chunk_index AS INTEGER) AS chunk_index, md5(chunk) AS chunk_md5, CAST(len(regexp_extract_all(chunk, '\\S+')) AS BIGINT) AS tokens FROM ({chunks_sql(_preset, LIMITS[_preset])})"
    )


@query(f"SELECT key AS doc_id, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars, CAST(max(len(regexp_extract_all(chunk, '\\S+'))) AS BIGINT) AS most_tokens FROM ({chunks_sql('markdown', 300)}) GROUP BY 1")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each document by the default options."""
    rows = chunk(table(spark, sf_dir, "documents"), ChunkOptions())
    tokens = T.count_words(F.col("chunk")).cast("long")
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).cast("long").alias("chars"), F.max(tokens).alias("most_tokens"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text <> ''")
def chunk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks put together again are the text."""
    rows = chunk(table(spark, sf_dir, "documents"), ChunkOptions(25, "plain", "plain"))
    whole = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk"))).alias("parts"))
    return whole.select("doc_id", F.md5(F.array_join(F.transform("parts", lambda p: p["chunk"]), "")).alias("text_md5"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text <> ''")
def chunk_custom_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Break strings and a counter of one's own; chunks put together again are the text."""
    rows = chunk(table(spark, sf_dir, "documents"), ChunkOptions(120, ("e ", ", ", "\n"), ("The",)), counter=len)
    whole = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk"))).alias("parts"))
    return whole.select("doc_id", F.md5(F.array_join(F.transform("parts", lambda p: p["chunk"]), "")).alias("text_md5"))


CUSTOM_SEGMENTS = "SELECT doc_id AS key, regexp_extract_all(text, '(?s:.*?(?:e |, |\\n)\\n*|.+$)') AS segs FROM documents WHERE text <> ''"
CUSTOM_SQL = chunks_sql("", 120, CUSTOM_SEGMENTS, "length({})", "starts_with(regexp_replace(x.cur, '^\\s+', ''), 'The')", True)


@query(f"SELECT key AS doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, md5(chunk) AS chunk_md5, CAST(length(chunk) AS INTEGER) AS chars FROM ({CUSTOM_SQL})")
def chunks_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The borders of chunks by break strings, a stop signal and a counter of one's own."""
    rows = chunk(table(spark, sf_dir, "documents"), ChunkOptions(120, ("e ", ", ", "\n"), ("The",)), counter=len)
    return rows.select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"), F.length("chunk").alias("chars"))


@query(
    f"WITH s AS ({segments_sql('html')}), u AS (SELECT key AS page_id, unnest(segs) AS segment FROM s) "
    f"SELECT page_id, count(*) AS segments, count(*) FILTER (WHERE {stop_sql('segment', 'html')}) AS stops FROM u GROUP BY 1"
)
def stop_signal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each page that start with a heading."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(T.segments(F.col("html"), "html")).alias("segment"))
    stops = F.count_if(T.has_stop_signal(F.col("segment"), T.STOP_SIGNALS["html"]))
    return rows.groupBy("page_id").agg(F.count("*").alias("segments"), stops.alias("stops"))


@query(
    f"SELECT key.c AS conv_id, key.t AS turn, CAST(chunk_index AS INTEGER) AS chunk_index, md5(chunk) AS chunk_md5 FROM ({chunks_sql('plain', 20)})".replace(
        "SELECT doc_id AS key, regexp_extract_all(text", "SELECT {'c': conv_id, 't': turn} AS key, regexp_extract_all(text"
    ).replace("FROM documents", "FROM conversations")
)
def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk(table(spark, sf_dir, "conversations"), ChunkOptions(20, "plain", "plain"), keep=("conv_id", "turn"))
    return rows.select("conv_id", "turn", "chunk_index", F.md5("chunk").alias("chunk_md5"))


@query("SELECT doc_id, md5('search_document: ' || text) AS document_md5, md5('search_query: ' || text) AS query_md5 FROM documents")
def embed_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(T.task_prefix(F.col("text"), "document")).alias("document_md5"), F.md5(T.task_prefix(F.col("text"), "query")).alias("query_md5"))


def hash_sql(text: str, n: int) -> str:
    return f"list_transform(range(0, {n}), lambda i: ('0x' || substr(md5(i::VARCHAR || ':' || {text}), 1, 8))::BIGINT::DOUBLE / 2147483648.0 - 1)"


@query(f"SELECT doc_id, CAST(i AS INTEGER) AS pos, round(v, 6) AS value FROM (SELECT doc_id, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS i FROM (SELECT doc_id, {hash_sql('text', 8)} AS e FROM documents))")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic provider as an expression."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(hash_embedding(F.col("text"), 8)).alias("pos", "v")).select("doc_id", "pos", F.round("v", 6).alias("value"))


@query(f"SELECT item_id, CAST(i AS INTEGER) AS pos, round(v::FLOAT::DOUBLE, 5) AS value FROM (SELECT item_id, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS i FROM (SELECT item_id, {hash_sql('text', 8)} AS e FROM benchmark))")
def embedding_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic provider in Python workers."""
    with EmbeddingService(lambda: HashProvider(8)) as service:
        found = service.embed(table(spark, sf_dir, "benchmark"))
    return found.select("item_id", F.posexplode("embedding").alias("pos", "v")).select("item_id", "pos", F.round(F.col("v").cast("double"), 5).alias("value"))


RAG_SQL = f"""
WITH chunks AS ({chunks_sql('plain', 100)}),
v AS (SELECT key * 1048576 + chunk_index AS id, chunk, {hash_sql('chunk', 16)}::FLOAT[]::DOUBLE[] AS e FROM chunks),
q AS (SELECT item_id, {hash_sql('text', 16)}::FLOAT[]::DOUBLE[] AS e FROM benchmark),
s AS (SELECT item_id AS query_id, id, chunk, list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))) AS score FROM v, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
"""


@query(RAG_SQL + "SELECT query_id, CAST(rank AS INTEGER) AS rank, id, md5(chunk) AS chunk_md5, round(score, 5) AS score FROM r WHERE rank <= 3")
def rag_chunk_embed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk, embed, search in a batch, and fetch the chunks that were found."""
    chunks = chunked(spark, sf_dir, "plain", 100).withColumn("id", F.col("key") * 1048576 + F.col("chunk_index"))
    service = EmbeddingService(lambda: HashProvider(16))
    vectors = service.embed(chunks, "chunk", output="values")
    asked = service.embed(table(spark, sf_dir, "benchmark"), purpose="query", output="values").withColumnRenamed("item_id", "query_id")
    found = S.fetch_content(S.batch_top_k(vectors, asked, 3), chunks.select("id", "chunk"), "id")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "id", F.md5("chunk").alias("chunk_md5"), F.round("score", 5).alias("score"))


@query(f"SELECT h.id, h.score, d.lang, d.n_chars FROM ({topk_sql(k=20)}) h JOIN documents d ON d.doc_id = h.id")
def search_fetch_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits joined with the documents that they name."""
    found = hits(S.top_k(store_rows(spark, sf_dir), vector_of(spark, sf_dir, 0), 20, DIMS))
    return S.fetch_content(found, table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")


@query(topk_sql(k=10, q=2))
def build_save_open_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built in memory, saved in the binary format, opened and searched."""
    vectorfile.register(spark)
    path = shared_path(spark, "vectors")
    memory_store(spark, sf_dir).save(path, "bigint")
    return hits(VectorStore.load(spark, "opened", DIMS, path, "bigint").search(vector_of(spark, sf_dir, 2), 10))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
