"""From the blocks of web pages to articles: sections, reference lists, cleaned runs of paragraphs, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from . import chunking as C


def sections(blocks: DataFrame) -> DataFrame:
    """blocks with section (the last heading that has a text, "Main" before any), part (headings so far) and in_refs (the last heading opens a reference list)."""
    w = Window.partitionBy("page_id").orderBy("pos")
    head = F.col("tag").isin(*H.HEADINGS)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    return blocks.withColumn("section", F.coalesce(last(F.when(head & (F.col("text") != ""), F.col("text"))), F.lit("Main"))).withColumn("part", F.sum(head.cast("int")).over(w)).withColumn("in_refs", F.coalesce(last(F.when(head, F.col("text").rlike(T.REFERENCE_HEADING))), F.lit(False)))


def references(blocks: DataFrame) -> DataFrame:
    """(page_id, references_text, references_count) of pages that have a reference list."""
    rows = sections(blocks).where(F.col("in_refs") & ~F.col("tag").isin(*H.HEADINGS) & (F.col("text") != ""))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return rows.groupBy("page_id").agg(F.array_join(ordered, "\n").alias("references_text"), F.count(F.lit(1)).cast("int").alias("references_count"))


def _clean(rows: DataFrame, column: str, min_words: int) -> DataFrame:
    """Rows whose text is no caption and no reference, without its bibliographic tail; each step is evaluated once."""
    c = F.col(column)
    rows = rows.where(~T.is_reference_block(c))
    return rows.withColumn(column, F.explode(F.array(T.without_bibliography(c, min_words)))).where(c != "")


def runs(blocks: DataFrame, min_words: int = 50) -> DataFrame:
    """(page_id, section, run, text, images): what stands between headings, a quotation by itself.

    Items lose their citations; captions, references and bibliographic tails go,
    and so do runs that look like references or have fewer than min_words words,
    with their images.
    """
    body = sections(blocks).where(~F.col("in_refs") & ~F.col("tag").isin(*H.HEADINGS, "error") & ~((F.col("tag") == "p") & F.col("quoted")))
    base = ["page_id", "part", "section", "pos", "tag", "images"]
    items = body.where("tag <> 'figure'").select(*base, F.posexplode("items").alias("i", "item"))
    items = items.withColumn("item", F.explode(F.array(T.without_citations(F.col("item"))))).where((F.col("item") != "") & ~T.is_caption(F.col("item")))
    items = _clean(items, "item", min_words)
    first = F.row_number().over(Window.partitionBy("page_id", "pos").orderBy("i")) == 1
    items = items.withColumn("images", F.when(first, F.col("images")).otherwise(F.slice("images", 1, 0)))
    figures = body.where("tag = 'figure'").select(*base, F.lit(0).alias("i"), F.lit("").alias("item"))
    rows = items.unionByName(figures)
    quote = (F.col("tag") == "blockquote").cast("int")
    before = F.sum(quote).over(Window.partitionBy("page_id").orderBy("pos", "i")) - quote
    rows = rows.withColumn("_q", 2 * before + quote)
    out = rows.groupBy("page_id", "part", "section", "_q").agg(F.array_sort(F.collect_list(F.struct("pos", "i", "item", "images"))).alias("_t"))
    text = F.array_join(F.filter(F.transform("_t", lambda x: x["item"]), lambda x: x != ""), " ")
    out = out.select("page_id", "section", F.struct("part", "_q").alias("run"), text.alias("text"), F.flatten(F.transform("_t", lambda x: x["images"])).alias("images"))
    out = out.withColumn("text", F.explode(F.array(T.repaired(F.col("text")))))
    return _clean(out, "text", min_words).where(T.word_count(F.col("text")) >= min_words)


# The meta properties of a page.
META = {"published": "article:published_time", "updated": "article:modified_time", "url": "og:url", "title_og": "og:title"}


def _named(pages: DataFrame) -> DataFrame:
    """(page_id, title, url, published, updated), the page's own properties first."""
    meta = {k: H.meta_property(F.col("html"), v) for k, v in META.items()}
    return pages.select("page_id", F.coalesce(meta["title_og"], H.page_title(F.col("html"))).alias("title"), F.coalesce(meta["url"], F.col("url")).alias("url"), meta["published"].alias("published"), meta["updated"].alias("updated"))


def articles(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, article_id, title, url, published, updated, references_text, references_count): one row for each page, the count 0 without a list."""
    rows = _named(pages).withColumn("article_id", F.sha2("url", 256)).select("page_id", "article_id", "title", "url", "published", "updated")
    return rows.join(references(blocks), "page_id", "left").withColumn("references_count", F.coalesce("references_count", F.lit(0)))


def page_chunks(pages: DataFrame, blocks: DataFrame, min_words: int = 50, cues=T.CAUSAL_CUES, cap: int = 512) -> DataFrame:
    """The chunks of all pages, with title and section as header and the images of their run."""
    rows = runs(blocks, min_words).join(_named(pages).select("page_id", "title", "url"), "page_id")
    return C.chunks(rows, "url", "text", "url", min_words, cues, cap, "title", "section", "run", "images")
