"""CAT-1..8: product upsert, detail lookup, tiering, semantic documents,
catalogue -> index sync, script library ingest."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from intentlane import params as P
from intentlane.sources.keyed_table import KeyedTable, last_per_key
from intentlane.functions.text import (is_blank, java_double_str, merchandising_flags,
                                       price_tier, split_selling_points)


def _points_text(df: DataFrame, col: str) -> Column:
    """List selling points are joined with "; ", a string is kept as is."""
    if col not in df.columns:
        return F.lit(None).cast("string")
    if isinstance(df.schema[col].dataType, ArrayType):
        return F.array_join(F.col(col), "; ")
    return F.col(col).cast("string")


def product_upsert(existing: DataFrame, batch: DataFrame, now_us: int,
                   seq_col: str = "seq") -> DataFrame:
    """CAT-1: key = id else sku_id (rows without key dropped); price defaults
    0.0, stock 0; on conflict name, selling_points, price and stock are
    replaced; within the batch the highest ``seq`` of a key wins. Existing
    rows keep created_at; touched rows get updated_at = now.

    ``existing``: sku_id, name, selling_points, price, stock, created_at_us,
    updated_at_us. Returns the new table version (write it to a new
    directory, never over the one being read).

    Plan: the batch is reduced per key with ``max_by`` (partial aggregation,
    so a key repeated in a third of the batch is combined map-side) and
    full-outer-joined to the table on the key: one shuffle per side."""
    key = F.coalesce(F.col("id").cast("string"), F.col("sku_id")) if "id" in batch.columns \
        else F.col("sku_id")
    staged = batch.select(
        key.alias("sku_id"), F.col(seq_col).alias("_seq"),
        F.struct(
            F.col("name").cast("string").alias("name"),
            _points_text(batch, "selling_points").alias("selling_points"),
            F.coalesce(F.col("price").try_cast("double"), F.lit(0.0)).alias("price"),
            F.coalesce(F.col("stock").try_cast("int"), F.lit(0)).alias("stock"),
        ).alias("_v")).filter(F.col("sku_id").isNotNull())
    # rows of one key with the same seq: the largest by content, whatever their order
    latest = staged.groupBy("sku_id").agg(F.max_by("_v", F.struct("_seq", F.to_json("_v"))).alias("_v"))
    e = existing.alias("e")
    n = latest.alias("n")
    hit = F.col("n._v").isNotNull()
    now = F.lit(now_us).cast("long")
    return (e.join(n, F.col("e.sku_id") == F.col("n.sku_id"), "full_outer")
            .select(
                F.coalesce(F.col("n.sku_id"), F.col("e.sku_id")).alias("sku_id"),
                F.when(hit, F.col("n._v.name")).otherwise(F.col("e.name")).alias("name"),
                F.when(hit, F.col("n._v.selling_points")).otherwise(F.col("e.selling_points"))
                .alias("selling_points"),
                F.when(hit, F.col("n._v.price")).otherwise(F.col("e.price").try_cast("double"))
                .alias("price"),
                F.when(hit, F.col("n._v.stock")).otherwise(F.col("e.stock").try_cast("int"))
                .alias("stock"),
                F.coalesce(F.col("e.created_at_us"), now).alias("created_at_us"),
                F.when(hit, now).otherwise(F.col("e.updated_at_us")).alias("updated_at_us")))


def product_details(skus: DataFrame, products: DataFrame, sku_col: str = "sku_id") -> DataFrame:
    """CAT-2 for a table of SKUs: product_id, name, category (NULL, as the
    reference's lookup selects none), price, selling_points[]. Unknown SKUs
    produce no row."""
    prod = products.select(F.col("sku_id").alias(sku_col), "name", "price", "selling_points")
    return (skus.select(sku_col).join(prod, sku_col, "inner")
            .select(F.col(sku_col).alias("product_id"), "name",
                    F.lit(None).cast("string").alias("category"),
                    F.col("price").try_cast("double").alias("price"),
                    split_selling_points(F.col("selling_points")).alias("selling_points")))


def with_price_tier(products: DataFrame) -> DataFrame:
    """CAT-3."""
    return products.withColumn("price_tier", price_tier(F.col("price")))


def catalog_documents(products: DataFrame, points_col: str = "selling_points") -> DataFrame:
    """CAT-4 + CAT-5: (id, document, metadata struct).

    Selling points count only when given as a list (a plain string is
    ignored here, as in the reference's index path)."""
    if points_col in products.columns and isinstance(products.schema[points_col].dataType, ArrayType):
        points = F.array_join(F.col(points_col), "; ")
    else:
        points = F.lit("")
    ident = F.coalesce(F.col("id").cast("string"), F.col("sku_id")) if "id" in products.columns \
        else F.col("sku_id")
    category = F.coalesce(F.col("category"), F.lit("")) if "category" in products.columns \
        else F.lit("")
    desc = F.coalesce(F.col("description"), F.lit("")) if "description" in products.columns \
        else F.lit("")
    price = F.coalesce(F.col("price").try_cast("double"), F.lit(0.0))
    name = F.col("name").cast("string")
    doc = F.format_string(P.PRODUCT_DOC_TEMPLATE, category, F.coalesce(name, F.lit("null")),
                          price_tier(price), F.concat(points, merchandising_flags(desc)), desc)
    return products.select(
        ident.alias("id"), doc.alias("document"),
        F.struct(ident.alias("product_id"), name.alias("name"), category.alias("category"),
                 java_double_str(price).alias("price"),
                 points.alias("selling_points_str")).alias("metadata"))


def catalog_for_index(products: DataFrame) -> DataFrame:
    """CAT-6 input: split the stored selling points first, then CAT-3..5."""
    return catalog_documents(
        products.withColumn("selling_points", split_selling_points(F.col("selling_points"))))


def script_documents(scripts: DataFrame) -> DataFrame:
    """CAT-8: drop NULL/blank content; scenario defaults to 'general', tags
    to ''; text '场景: %s. 内容: %s'; id = SHA-256 of the text (stable, so a
    re-ingest upserts instead of appending duplicates)."""
    kept = scripts.filter(~is_blank(F.col("content")) & ~F.col("content").rlike(r"^\s*$"))
    scenario = F.coalesce(F.col("scenario"), F.lit(P.DEFAULT_SCRIPT_SCENARIO))
    tags = F.coalesce(F.col("tags"), F.lit(""))
    text = F.format_string(P.SCRIPT_DOC_TEMPLATE, scenario, F.col("content"))
    return kept.select(F.sha2(text, 256).alias("id"), scenario.alias("scenario"),
                       tags.alias("tags"), text.alias("text"))


def ingest_product_knowledge(existing: DataFrame, batch: DataFrame, now_us: int,
                             encoder=None) -> tuple[DataFrame, DataFrame]:
    """CAT-7: CAT-1 upsert of the batch into the table, then CAT-5 documents
    and RET-1 vectors of the same batch for the index (SNK-4). Returns (new
    table version, vectors to upsert); the reference reports the table count
    only, which is ``new_table.count()`` at the caller."""
    from intentlane.operators.retrieval import embed
    table = product_upsert(existing, batch, now_us)
    key = F.coalesce(F.col("id").cast("string"), F.col("sku_id")) if "id" in batch.columns \
        else F.col("sku_id")
    keyed = batch.withColumn("sku_id", key).filter(F.col("sku_id").isNotNull())
    docs = catalog_documents(keyed)
    return table, embed(docs, "document", encoder=encoder)


def sync_catalog(products: DataFrame, index: KeyedTable, batch_id: str, encoder=None, seq: Column | None = None) -> dict:
    """CAT-6 / CAT-7: documents and vectors of a batch of products, upserted
    into the index by id; only the index's touched buckets are rewritten. A
    product that stands twice in the batch leaves one row, the last by ``seq``.
    Returns status (``success``, ``skipped`` for an empty batch, ``error``),
    message, the products written and the buckets touched. The first batch
    makes the index, with buckets for its own number of rows."""
    from intentlane.operators.retrieval import embed
    try:
        keyed = products.withColumn("sku_id", F.coalesce(F.col("id").cast("string"), F.col("sku_id")) if "id" in products.columns
                                    else F.col("sku_id")).where(F.col("sku_id").isNotNull()).drop("id")
        once = last_per_key(keyed, "sku_id", seq)          # before embedding, which is the dear part
        count = once.count()
        if not count:
            return {"status": "skipped", "message": "no products", "n_products": 0, "buckets": 0}
        vectors = embed(catalog_for_index(once), "document", encoder=encoder)
        if not index.exists():
            index.create(vectors, count)
        touched = index.upsert(vectors, batch_id)
        return {"status": "success", "message": "", "n_products": count, "buckets": len(touched)}
    except PySparkException as failed:
        return {"status": "error", "message": str(failed).splitlines()[0][:500], "n_products": 0, "buckets": 0}


def script_vectors(scripts: DataFrame, encoder=None) -> DataFrame:
    """CAT-8: (id, document, metadata(scenario, tags), embedding), one row per distinct text."""
    from intentlane.operators.retrieval import embed
    docs = last_per_key(script_documents(scripts), "id")
    rows = docs.select("id", F.col("text").alias("document"), F.struct("scenario", "tags").alias("metadata"))
    return embed(rows, "document", encoder=encoder)


def ingest_scripts(scripts: DataFrame, index: KeyedTable, batch_id: str, encoder=None) -> int:
    """CAT-8 whole: drop blank scripts, write text and metadata, embed, upsert
    by id; returns the number of scripts ingested. The id is the hash of the
    text, so a library that is read again changes nothing."""
    vectors = script_vectors(scripts, encoder)
    count = vectors.count()
    if count:
        if not index.exists():
            index.create(vectors, count)
        index.upsert(vectors, batch_id)
    return count
