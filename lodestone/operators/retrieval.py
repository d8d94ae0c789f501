"""From nearest neighbours to a packed, cited context, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from . import vectors as V


def confidence(hits: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, retrieval_confidence): mean of 1 - dist over the k nearest raw hits."""
    return hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.round(F.avg(1 - F.col("dist")), 6).alias("retrieval_confidence"))


def biased(hits: DataFrame, lexicon: S.Lexicon = S.Lexicon()) -> DataFrame:
    """hits(query_id, question, rank, id, dist, source, section, text) with the biased distance and the new position."""
    d = F.round(S.biased_distance(F.col("dist"), F.col("question"), F.col("source"), F.col("text"), F.col("section"), lexicon), 6)
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "rank"))
    return hits.withColumn("dist", d).withColumn("pos", pos)


def pooled(items: DataFrame, per_source: int = 8, most: int = 50) -> DataFrame:
    """Groups by source in order of first appearance; the best per_source of each; the first `most` of all, as flat_pos."""
    by_query = Window.partitionBy("query_id")
    rows = items.withColumn("source", F.coalesce("source", F.lit(""))).withColumn("_first", F.min("pos").over(Window.partitionBy("query_id", "source")))
    rows = rows.withColumn("source_rank", F.dense_rank().over(by_query.orderBy("_first")))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("dist", "pos"))).where(F.col("_n") <= per_source)
    rows = rows.withColumn("flat_pos", F.row_number().over(by_query.orderBy("source_rank", "dist", "pos")))
    return rows.where(F.col("flat_pos") <= most).drop("_first", "_n")


def with_memory(items: DataFrame, memory: DataFrame) -> DataFrame:
    """Memory items before the corpus items, in one order of positions."""
    shift = memory.groupBy("query_id").agg(F.count(F.lit(1)).alias("_m"))
    moved = items.join(shift, "query_id", "left").withColumn("pos", F.col("pos") + F.coalesce("_m", F.lit(0))).drop("_m")
    return memory.unionByName(moved, allowMissingColumns=True)


def picked(items: DataFrame, sources: int = 4, per_source: int = 3, budget: int = 10_000, headroom: int = 150, lexicon: S.Lexicon = S.Lexicon()) -> DataFrame:
    """The context of each query, with pick_pos.

    Of the first `sources` sources, the section with the best distance plus bias;
    of it, by distance, up to per_source chunks. A chunk over the token budget is
    passed over and later ones may fit; the second of a source may exceed it by
    the headroom. Bounded by sources and pool, one query's items fold in order.
    """
    q = Window.partitionBy("query_id")
    rows = items.withColumn("_sec", F.coalesce(F.nullif(F.trim(F.coalesce("section", F.lit(""))), F.lit("")), F.lit("§")))
    rows = rows.withColumn("_src", F.dense_rank().over(q.orderBy("source_rank"))).where(F.col("_src") <= sources)
    rows = rows.withColumn("_score", F.round(F.min("dist").over(Window.partitionBy("query_id", "source", "_sec")) + S.section_bias(F.col("section"), lexicon), 6))
    rows = rows.withColumn("_sec_pos", F.min("flat_pos").over(Window.partitionBy("query_id", "source", "_sec")))
    best = F.first(F.col("_sec")).over(Window.partitionBy("query_id", "source").orderBy("_score", "_sec_pos", "flat_pos"))
    rows = rows.withColumn("_best", best).where("_sec = _best")
    rows = rows.withColumn("_tokens", F.coalesce(F.when(F.col("token_len") >= 0, F.col("token_len")), T.query_tokens(F.col("text"))))
    item = F.struct("_src", "dist", "flat_pos", "id", F.col("_tokens").cast("int").alias("t"))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("xs"))

    def step(a: Column, x: Column) -> Column:
        taken = F.when(a["src"] == x["_src"], a["taken"]).otherwise(0)
        fits = (taken < per_source) & (a["used"] + x["t"] <= budget + F.when(taken == 1, headroom).otherwise(0))
        return F.struct(F.when(fits, a["used"] + x["t"]).otherwise(a["used"]).alias("used"), F.when(fits, taken + 1).otherwise(taken).alias("taken"), x["_src"].alias("src"), F.when(fits, F.concat(a["ids"], F.array(x["id"]))).otherwise(a["ids"]).alias("ids"))

    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("taken"), F.lit(0).alias("src"), F.array().cast("array<bigint>").alias("ids"))
    chosen = lists.select("query_id", F.posexplode(F.aggregate("xs", start, step, lambda a: a["ids"])).alias("pick_pos", "id"))
    return items.join(chosen, ["query_id", "id"])


def citations(context: DataFrame) -> DataFrame:
    """(query_id, citations): distinct "source — section" in order of the picks, joined by new lines."""
    label = F.concat_ws(" — ", F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")), F.coalesce("section", F.lit("n/a")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pick_pos", label.alias("l")))), lambda x: x["l"])
    return context.groupBy("query_id").agg(F.array_join(F.array_distinct(ordered), "\n").alias("citations"))


def context_blocks(context: DataFrame) -> DataFrame:
    """(query_id, block, context_tokens): chunks under "[header]", by section priority and pick."""
    part = F.concat(F.lit("["), T.header(F.col("title") if "title" in context.columns else F.lit(""), F.col("section")), F.lit("]\n"), T.text_of(F.col("text")))
    item = F.struct(S.section_priority(F.col("section")).alias("p"), "pick_pos", part.alias("x"))
    tokens = F.coalesce("token_len", T.query_tokens(F.col("text")))
    return context.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["x"]), "\n\n").alias("block"), F.sum(tokens).cast("bigint").alias("context_tokens"))


CONCISE = "Answer in a few numbered steps and say why. If the context does not suffice, say so."
STRUCTURED = "Answer in Markdown with short sections. If the context does not suffice, say so."


def prompts(blocks: DataFrame) -> DataFrame:
    """blocks(query_id, question, block) with the prompt; questions about doing and timing get the concise form."""
    rule = F.when(T.is_simple_question(F.col("question")), CONCISE).otherwise(STRUCTURED)
    return blocks.withColumn("prompt", F.concat(F.lit("CONTEXT:\n---\n"), "block", F.lit("\n---\n\n"), rule, F.lit("\n\nQuestion: "), "question"))


def reranked(items: DataFrame, replies: DataFrame, top: int = 10) -> DataFrame:
    """items with distances from a scorer's reply(query_id, source, reply) for each source's items in order; unreadable replies leave them."""
    rows = items.withColumn("_i", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("flat_pos")))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("query_id", "source"))).join(replies, ["query_id", "source"], "left")
    scores = T.rerank_scores(F.col("reply"), F.col("_n").cast("int"))
    rows = rows.withColumn("dist", F.coalesce(1 - F.get(scores, (F.col("_i") - 1).cast("int")) / 10, "dist"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("dist", "_i")))
    return rows.where(F.col("_r") <= top).drop("_i", "_n", "_r", "reply")


def recent_turns(history: DataFrame, most: int = 10) -> DataFrame:
    """The last turns of each conversation, with i, their place in it from 0."""
    w = Window.partitionBy("conv_id")
    rows = history.withColumn("_back", F.row_number().over(w.orderBy(F.desc("turn")))).where(F.col("_back") <= most)
    return rows.withColumn("i", F.row_number().over(w.orderBy("turn")) - 1).drop("_back")


def ranked_memory(turns: DataFrame, similarity: Column, decay: float = 0.65, top: int = 2, scale: float = 0.30, penalty: float = 0.20) -> DataFrame:
    """The turns most alike the question, faded with age: (conv_id, memory_rank, turn, entry, weight, dist). Blank turns keep their place in the exponent."""
    rows = turns.where(F.trim(T.text_of(F.col("text"))) != "").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    weight = F.pow(F.lit(decay), F.col("_n") - 1 - F.col("i"))
    rows = rows.withColumn("weight", F.round(weight, 6)).withColumn("_s", F.round(similarity * weight * scale, 6))
    rows = rows.withColumn("memory_rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("_s"), "turn"))).where(F.col("memory_rank") <= top)
    return rows.select("conv_id", "memory_rank", "turn", F.concat(F.lit("["), F.upper("role"), F.lit("] "), "text").alias("entry"), "weight", F.round(1 - F.col("_s") + penalty, 6).alias("dist"))


def gated(memory: DataFrame, confidence: DataFrame, below: float = 0.55) -> DataFrame:
    """The memory of questions whose retrieval confidence is under the limit."""
    return memory.join(confidence.where(F.col("retrieval_confidence") < below).select("query_id"), "query_id", "left_semi")


def console(hits: DataFrame, texts: DataFrame, metadata: DataFrame, most: int = 800) -> DataFrame:
    """hits with similarity, source, a snippet and the metadata's columns, -1 where an article has none."""
    extra = [c for c in metadata.columns if c != "id"]
    rows = hits.join(texts, "id").join(metadata, "id", "left")
    return rows.select("query_id", "rank", "id", F.round(1 - F.col("dist"), 6).alias("similarity"), "source", *[F.coalesce(c, F.lit(-1)).alias(c) for c in extra], T.snippet(F.col("text"), most).alias("snippet"))


def traces(hits: DataFrame) -> DataFrame:
    """(query_id, trace): the ids of a query's hits in order, as JSON."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    return hits.groupBy("query_id").agg(ids.alias("hits")).select("query_id", F.to_json(F.struct("query_id", "hits")).alias("trace"))


def unbiased(hits: DataFrame) -> DataFrame:
    """hits in the order of their raw distances: the scores off."""
    return hits.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "rank")))


def history_similarity(turns: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """turns with similarity, the product of the unit vectors of a turn and of its conversation's question: vectors(conv_id, turn, vec), queries(conv_id, vec); 0 where one is missing."""
    unit = lambda df: df.withColumn("vec", V.normalized(F.col("vec")))
    rows = turns.join(unit(vectors).withColumnRenamed("vec", "_t"), ["conv_id", "turn"], "left").join(unit(queries).withColumnRenamed("vec", "_q"), "conv_id", "left")
    return rows.withColumn("similarity", F.coalesce(V.dot(F.col("_t"), F.col("_q")), F.lit(0.0))).drop("_t", "_q")


def citation_previews(labels: DataFrame, context: DataFrame, most: int = 200, default: str = "No preview available.") -> DataFrame:
    """labels(query_id, citation) with the start of the last picked text under that "source — section", or the default."""
    label = F.concat_ws(" — ", F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")), F.coalesce("section", F.lit("n/a")))
    last = context.groupBy("query_id", label.alias("citation")).agg(F.max(F.struct("pick_pos", "text")).alias("_l"))
    return labels.join(last, ["query_id", "citation"], "left").select("query_id", "citation", F.coalesce(F.substring("_l.text", 1, most), F.lit(default)).alias("preview"))
