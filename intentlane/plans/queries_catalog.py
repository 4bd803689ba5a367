"""Registered catalogue and retrieval jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentlane.operators import ann
from intentlane.operators import catalog as cat
from intentlane.operators import retrieval as ret
from intentlane.plans.registry import register
from intentlane.session import scratch_path
from intentlane.sources import sinks
from intentlane.sources.keyed_table import KeyedTable
from intentlane.sources import views as V
from intentlane.sources.tables import read_table

BASE_CREATED_US = 1701388800000000   # 2023-12-01 00:00:00 UTC
UPSERT_NOW_US = 1706745600000000     # 2024-02-01 00:00:00 UTC
KNN_K = 9


def _partkey() -> F.Column:
    return F.substring("sku_id", 5, 1 << 20).cast("bigint")


def upsert_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    prods = V.v_products(spark, sf)
    base = (prods.filter(_partkey() % 3 == 0)
            .select("sku_id", "name", "selling_points", "price", "stock",
                    F.lit(BASE_CREATED_US).alias("created_at_us"),
                    F.lit(BASE_CREATED_US).alias("updated_at_us")))
    first = prods.select(F.when(_partkey() % 10 == 7, F.lit(None)).otherwise(F.col("sku_id"))
                         .alias("sku_id"), "name", "selling_points", "price", "stock",
                         F.lit(1).alias("seq"))
    second = prods.filter(_partkey() % 2 == 0).select(
        "sku_id", F.concat("name", F.lit(" v2")).alias("name"), "selling_points",
        (F.col("price") + 1).alias("price"), (F.col("stock") + 1).alias("stock"),
        F.lit(2).alias("seq"))
    return base, first.unionByName(second)


@register("product_upsert")
def q_product_upsert(spark: SparkSession, sf: str) -> DataFrame:
    base, batch = upsert_inputs(spark, sf)
    return cat.product_upsert(base, batch, UPSERT_NOW_US)


@register("product_details")
def q_product_details(spark: SparkSession, sf: str) -> DataFrame:
    skus = V.v_behavior(spark, sf).select("sku_id").distinct()
    d = cat.product_details(skus, V.v_products(spark, sf))
    return d.withColumn("selling_points", F.array_join("selling_points", "|"))


@register("price_tier")
def q_price_tier(spark: SparkSession, sf: str) -> DataFrame:
    return cat.with_price_tier(V.v_products(spark, sf)).select("sku_id", "price", "price_tier")


def _flat_docs(docs: DataFrame) -> DataFrame:
    return docs.select("id", "document",
                       F.col("metadata.product_id").alias("m_product_id"),
                       F.col("metadata.name").alias("m_name"),
                       F.col("metadata.category").alias("m_category"),
                       F.col("metadata.price").alias("m_price"),
                       F.col("metadata.selling_points_str").alias("m_selling_points_str"))


@register("catalog_documents")
def q_catalog_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_docs(cat.catalog_documents(V.v_products(spark, sf)))


@register("catalog_sync")
def q_catalog_sync(spark: SparkSession, sf: str) -> DataFrame:
    """CAT-6: scan -> split -> documents -> embed -> upsert into a new index
    version under the shared folder -> summary read back from it."""
    docs = cat.catalog_for_index(V.v_products(spark, sf))
    vectors = ret.embed(docs, "document")
    path = sinks.upsert_vectors(vectors, scratch_path(spark, "product-index"))
    written = spark.read.parquet(path)
    return written.agg(
        F.when(F.count(F.lit(1)) > 0, F.lit("success")).otherwise(F.lit("skipped")).alias("status"),
        F.count_distinct("id").alias("n_products"),
        F.count("embedding").alias("n_vectors"),
        F.max(F.size("embedding")).alias("dim"))


def _numbered(products: DataFrame, seq: int) -> DataFrame:
    return products.withColumn("seq", F.lit(seq))


@register("catalog_upsert")
def q_catalog_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-4, CAT-6, CAT-7: the whole catalogue is indexed, then a batch of one
    product in a hundred (each of them twice) and a batch of new products are
    upserted; the index is read back."""
    prods = V.v_products(spark, sf).withColumn("_k", _partkey())
    index = KeyedTable(spark, scratch_path(spark, "catalog-index"))
    changed = prods.where("_k % 100 = 7").withColumn("price", F.col("price") + 5)
    twice = _numbered(changed, 1).unionByName(_numbered(changed.withColumn("name", F.concat("name", F.lit(" v2"))), 2))
    fresh = prods.where("_k % 50 = 3").withColumn("sku_id", F.concat("sku_id", F.lit("-b")))
    for n, batch in enumerate((_numbered(prods, 0), twice, _numbered(fresh, 0))):
        done = cat.sync_catalog(batch.drop("_k"), index, f"batch-{n}", seq=F.col("seq"))
        if done["status"] != "success":
            raise ValueError(done["message"])
    return _flat_docs(index.read()).join(index.read().select("id", F.size("embedding").alias("dim")), "id")


@register("script_ingest")
def q_script_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """CAT-8 whole: the library is ingested, then again with one text in five
    rewritten; both versions of a rewritten text stay, as their ids differ."""
    scripts = V.v_scripts(spark, sf)
    index = KeyedTable(spark, scratch_path(spark, "script-index"))
    cat.ingest_scripts(scripts, index, "first")
    again = scripts.withColumn("content", F.when(F.col("id") % 5 == 0, F.concat("content", F.lit(" (new)"))).otherwise(F.col("content")))
    cat.ingest_scripts(again, index, "second")
    return index.read().select("id", F.col("metadata.scenario").alias("scenario"), F.col("metadata.tags").alias("tags"),
                               F.col("document").alias("content"), F.size("embedding").alias("dim"))


@register("script_documents")
def q_script_documents(spark: SparkSession, sf: str) -> DataFrame:
    return cat.script_documents(V.v_scripts(spark, sf))


@register("batch_embedding")
def q_batch_embedding(spark: SparkSession, sf: str) -> DataFrame:
    docs = cat.catalog_for_index(V.v_products(spark, sf))
    vec = ret.embed(docs, "document")
    return vec.select("id", F.size("embedding").alias("dim"),
                      ret.rounded(F.sqrt(F.aggregate("embedding", F.lit(0.0),
                                                     lambda a, x: a + x * x)), 6).alias("norm"))


@register("vector_topk")
def q_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = ret.knn(V.v_queries(spark, sf), V.v_index(spark, sf), KNN_K)
    return hits.select("query_id", "rank", "id", ret.rounded("distance").alias("distance"))


ANN_ROWS_PER_CELL = 32      # small cells, as the given index has few rows


@register("vector_topk_approx")
def q_vector_topk_approx(spark: SparkSession, sf: str) -> DataFrame:
    """RET-2 by coarse cells; the probes follow from a recall of 0.9."""
    hits = ann.knn_approx(V.v_queries(spark, sf), V.v_index(spark, sf), KNN_K, rows_per_cell=ANN_ROWS_PER_CELL)
    return hits.select("query_id", "rank", "id", ret.rounded("distance").alias("distance"))


@register("vector_topk_recall")
def q_vector_topk_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The recall of the approximate search against the exact one, on all queries."""
    queries, index = V.v_queries(spark, sf), V.v_index(spark, sf)
    found = ann.knn_approx(queries, index, KNN_K, rows_per_cell=ANN_ROWS_PER_CELL)
    r = ann.recall_of(found, ret.knn(queries, index, KNN_K))
    return r.select("n_queries", (F.col("recall") >= ann.RECALL).alias("recall_reached"))


@register("script_search")
def q_script_search(spark: SparkSession, sf: str) -> DataFrame:
    hits = ret.script_search(V.v_queries(spark, sf), V.v_index(spark, sf))
    return hits.select("query_id", "rank", "id", "scenario",
                       ret.rounded("distance").alias("distance"))


@register("script_hits")
def q_script_hits(spark: SparkSession, sf: str) -> DataFrame:
    """RET-8 with RET-5: queries with their text (every third one without a
    scenario, blank texts find nothing), hits with scenario, tags and content.
    The library takes the given vectors: script ``item_id`` has vector ``vec_id``."""
    scripts = V.v_scripts(spark, sf).select("id", F.col("content").alias("document"), F.struct(
        F.coalesce("scenario", F.lit("none")).alias("scenario"), F.coalesce("tags", F.lit("")).alias("tags")).alias("metadata"))
    library = scripts.join(V.v_index(spark, sf).select("id", "embedding"), "id")
    queries = query_table(spark, sf).withColumn("scenario", F.when(F.col("id") % 3 == 0, F.lit(" ")).when(
        F.col("id") % 3 == 1, F.lit("cart_abandon")).otherwise(F.lit("price_drop")))
    queries = queries.withColumn("query_text", F.when(F.col("id") % 7 == 0, F.lit(" \t")).otherwise(F.col("query_text")))
    hits = ret.search_scripts(queries, library)
    return hits.select("query_id", "rank", "id", "scenario", "tags", "content", ret.rounded("distance").alias("distance"))


def query_table(spark: SparkSession, sf: str) -> DataFrame:
    """Queries with their text: the document whose doc_id equals the vector id."""
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    return (V.v_queries(spark, sf)
            .join(docs.withColumnRenamed("doc_id", "id"), "id", "left")
            .withColumnRenamed("text", "query_text"))


@register("rerank")
def q_rerank(spark: SparkSession, sf: str) -> DataFrame:
    q = query_table(spark, sf)
    hits = ret.knn(q.select("id", "embedding"), V.v_index(spark, sf), KNN_K)
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    # tokenise every text once, then join the token arrays to the candidates
    qtok = q.select(F.col("id").alias("query_id"),
                    F.when(F.col("query_text").isNotNull(), ret.tokens(F.col("query_text"))).alias("_qtok"))
    dtok = docs.select(F.col("doc_id").alias("id"),
                       F.when(F.col("text").isNotNull(), ret.tokens(F.col("text"))).alias("_dtok"))
    cands = hits.join(qtok, "query_id").join(dtok, "id", "left")
    out = ret.rerank(cands.withColumn("score", ret.token_overlap(F.col("_qtok"), F.col("_dtok"))))
    return out.select("query_id", "rank", "id", "recall_rank", "score",
                      ret.rounded("distance").alias("distance"))


def _product_search(spark: SparkSession, sf: str) -> DataFrame:
    catalog = cat.catalog_for_index(V.v_products(spark, sf))
    return ret.product_search(query_table(spark, sf), V.v_index(spark, sf), catalog,
                              hit_key=F.concat(F.lit("sku_"), F.col("id").cast("string")))


@register("product_search")
def q_product_search(spark: SparkSession, sf: str) -> DataFrame:
    r = _product_search(spark, sf)
    return r.select("query_id", "rank", "product_id", "name", "category", "price",
                    F.array_join("selling_points", "|").alias("selling_points"),
                    ret.rounded("distance").alias("distance"), "score")


@register("search_text")
def q_search_text(spark: SparkSession, sf: str) -> DataFrame:
    return ret.search_text(_product_search(spark, sf), query_table(spark, sf))
