"""From texts to bounded chunks: causal groups, sentence and token windows, overlap, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def causal_groups(sentences: Column, cues=T.CAUSAL_CUES, most_words: int = 350) -> Column:
    """Runs of sentences that a cue ties together: a sentence joins the open run if a cue is in it or in the run's last sentence and the run stays within most_words."""
    cue = r"(?i)\b(" + "|".join(cues) + r")\b"
    told = F.transform(sentences, lambda s: F.struct(s.alias("s"), T.word_count(s).alias("n"), s.rlike(cue).alias("cue")))  # once for each sentence
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(False).alias("cue"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        ties = (acc["n"] > 0) & (x["cue"] | acc["cue"]) & (acc["n"] + x["n"] <= most_words)
        closed = F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])
        return F.struct(
            F.when(ties, acc["done"]).otherwise(closed).alias("done"),
            F.when(ties, F.concat_ws(" ", acc["open"], x["s"])).otherwise(x["s"]).alias("open"),
            x["cue"].alias("cue"),
            F.when(ties, acc["n"] + x["n"]).otherwise(x["n"]).alias("n"),
        )

    return F.aggregate(told, empty, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def windows(items: Column, size: int = 6, overlap: int = 2) -> Column:
    """Joined runs of `size` items at steps of size - overlap; the last ones may be pure overlap."""
    step = max(1, size - overlap)

    def joined(xs: Column) -> Column:
        n = F.size(xs)
        starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(xs, i + 1, F.lit(size)), " "))

    return T.once(items, joined)


def token_windows(text: Column, size: int, overlap_ratio: float = 0.25) -> Column:
    return windows(T.words(text), size, size - max(1, int(size * (1 - overlap_ratio))))


def with_overlap(pieces: Column, threshold: int = 350) -> Column:
    """Each piece behind the last sentence of the one before, unless it has `threshold` tokens already."""

    told = F.transform(pieces, lambda x: F.struct(x.alias("x"), T.chunk_tokens(x).alias("n"), F.try_element_at(T.sentences(x), F.lit(-1)).alias("last")))  # once for each piece
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("last"))

    def step(acc: Column, p: Column) -> Column:
        text = F.when(p["n"] < threshold, F.concat_ws(" ", acc["last"], p["x"])).otherwise(p["x"])
        return F.struct(F.concat(acc["done"], F.array(text)).alias("done"), p["last"].alias("last"))

    return F.aggregate(told, empty, step, lambda acc: acc["done"])


def hard_capped(sentences: Column, cap: int | Column) -> Column:
    """Sentences packed in order into pieces of at most `cap` tokens: a longer sentence goes by clauses, a longer clause by runs of words.

    The counts of the parts are added up, so a piece may hold one token less than
    its own count says. Nothing is lost and the order stays.
    """
    cap = F.lit(cap) if isinstance(cap, int) else cap
    most = F.greatest(F.ceil((cap + 1) * F.lit(0.75)).cast("int") - 1, F.lit(1))  # words whose count is within the cap

    def runs(c: Column) -> Column:
        return T.once(T.words(c), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), most), lambda i: F.array_join(F.slice(w, i + 1, most), " ")))

    def parts(s: Column) -> Column:
        by_clause = F.flatten(F.transform(T.clauses(s), lambda c: F.when(T.chunk_tokens(c) <= cap, F.array(c)).otherwise(runs(c))))
        return F.when(T.chunk_tokens(s) <= cap, F.array(s)).otherwise(by_clause)

    def step(a: Column, u: Column) -> Column:
        n, s = u["n"], u["s"]
        fits = (a["open"] == "") | (a["n"] + n <= cap)
        return F.struct(
            F.when(fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))).alias("done"),
            F.when(fits & (a["open"] != ""), F.concat_ws(" ", a["open"], s)).otherwise(s).alias("open"),
            F.when(fits, a["n"] + n).otherwise(n).alias("n"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))
    units = F.filter(F.flatten(F.transform(sentences, parts)), lambda s: s != "")
    told = F.transform(units, lambda s: F.struct(s.alias("s"), T.chunk_tokens(s).alias("n")))  # once for each part
    return F.aggregate(told, start, step, lambda a: F.when(a["open"] != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))


def _counted(pieces: Column) -> Column:
    """Each piece with its number of words, which the later steps go by."""
    return F.transform(pieces, lambda x: F.struct(x.alias("x"), T.word_count(x).alias("n")))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column that is evaluated once, not at each use."""
    return rows.withColumn(name, F.explode(F.array(value)))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", min_words: int = 50, cues=T.CAUSAL_CUES, cap: int = 512, title_col: str | None = None, section_col: str | None = None, block_col: str | None = None, images_col: str | None = None) -> DataFrame:
    """(article_id, chunk_id, title, section, chunk_idx, article_seq, embed_text, body, text_with_images, images, source_relpath, token_len, word_len).

    Windows of causal groups; those over `cap` tokens are packed anew, each piece
    behind the last sentence of the one before. Pieces below max(50, 0.8 * min_words)
    words go, but the longest of a block stays if all would. The header, title and
    section, counts towards the cap. Rows with block_col are the blocks of one
    article in that order; without it every row is an article of its own.
    """
    least = max(50, int(min_words * 0.8))
    none = F.lit(None).cast("string")
    own = lambda name, other=none: F.col(name) if name else other
    empty = F.array().cast("array<string>")
    texts = F.array_distinct(F.filter(F.transform(F.col(images_col), lambda i: F.trim(i["image_text"])), lambda x: x != "")) if images_col else empty
    rows = docs.select(
        F.sha2(F.col(id_col).cast("string"), 256).alias("article_id"), F.col(source_col).alias("source_relpath"), own(title_col).alias("title"), own(section_col).alias("section"),
        own(block_col, F.lit(0)).alias("_block"), (F.to_json(images_col) if images_col else F.lit("[]")).alias("images"), texts.alias("_said"), F.col(text_col).alias("_text"),
    )
    rows = _once(rows, "_w", windows(causal_groups(T.sentences(F.col("_text")), cues))).drop("_text")
    none_left = F.array().cast("array<struct<x: string, n: int>>")
    resized = lambda room, cut: F.flatten(F.transform("_w", lambda p: F.when(T.tokens_of_words(p["n"]) <= room, F.array(p)).otherwise(_counted(cut(p["x"])))))
    rows = _once(rows, "_w", _counted(F.col("_w")))
    rows = _once(rows, "_w", resized(cap, lambda x: with_overlap(hard_capped(T.sentences(x), cap))))
    long = F.filter("_w", lambda p: p["n"] >= least)
    longest = F.reduce("_w", F.try_element_at("_w", F.lit(1)), lambda a, p: F.when(p["n"] > a["n"], p).otherwise(a))
    rows = rows.withColumn("_forced", F.size(long) == 0)
    rows = _once(rows, "_w", F.when(~F.col("_forced"), long).when(F.size("_w") > 0, F.array(longest)).otherwise(none_left))
    rows = _once(rows, "_w", resized(cap, lambda x: hard_capped(T.sentences(x), cap)))
    header = T.header(F.col("title"), F.col("section"))
    rows = rows.withColumn("_head", F.when((header != "") & (T.chunk_tokens(header) < cap), F.concat(header, F.lit("\n\n"))).otherwise(""))
    rows = _once(rows, "_nh", T.word_count(F.col("_head")))  # the header ends in white space: its words and the piece's add up
    allowed = F.greatest(F.lit(cap) - T.tokens_of_words(F.col("_nh")), F.lit(1))
    fits = lambda p: T.tokens_of_words(F.col("_nh") + p["n"]) <= cap
    rows = _once(rows, "_w", F.transform("_w", lambda p: F.when(fits(p), F.array(p)).otherwise(_counted(with_overlap(hard_capped(T.sentences(p["x"]), allowed))))))
    each = F.flatten(F.transform("_w", lambda ps, i: F.transform(ps, lambda p, j: F.struct(i.alias("i"), j.alias("j"), F.size(ps).alias("n"), p["x"].alias("x"), p["n"].alias("words")))))
    each = F.filter(each, lambda e: (e["x"] != "") & (F.col("_forced") | (e["words"] >= least)))
    rows = _once(rows, "_w", each).select("*", F.posexplode("_w").alias("_seq", "_e")).drop("_w").withColumns({"_i": F.col("_e.i"), "_j": F.col("_e.j"), "_n": F.col("_e.n"), "_words": F.col("_e.words"), "body": F.col("_e.x")})
    seq = F.row_number().over(Window.partitionBy("article_id").orderBy("_block", "_seq")) - 1 if block_col else F.col("_seq")
    embed = F.concat("_head", "body")
    place = F.concat_ws("_", F.col("_i").cast("string"), F.col("_j").cast("string"))
    return rows.select(
        "article_id", F.sha2(F.concat(F.col("article_id"), F.lit("|"), T.text_of(F.col("section")), F.lit("|"), place, F.lit("|"), F.substring("body", 1, 80)), 256).alias("chunk_id"), "title", "section",
        F.when(F.col("_n") == 1, F.col("_i").cast("string")).otherwise(F.concat_ws(".", F.col("_i").cast("string"), F.col("_j").cast("string"))).alias("chunk_idx"), seq.alias("article_seq"),
        embed.alias("embed_text"), "body", F.trim(F.concat_ws(" ", embed, F.when(F.size("_said") > 0, F.array_join("_said", " ")))).alias("text_with_images"), "images", "source_relpath",
        T.tokens_of_words(F.col("_nh") + F.col("_words")).alias("token_len"), F.col("_words").alias("word_len"),
    )


def dedup_near_exact(docs: DataFrame, text_col: str, order: list[str]) -> DataFrame:
    """The first row, by `order` and then by a hash of the row, of each normalised text, found by a combining aggregate: a text in many rows gathers nowhere.

    Null texts count as empty. Of rows equal in all columns one stays. Columns named _fp, _row or _first are not allowed.
    """
    columns = [F.col(c) for c in docs.columns]
    keyed = docs.withColumn("_fp", T.fingerprint(F.col(text_col))).withColumn("_row", F.struct(*[c.isNull() for c in (F.col(o) for o in order)], *order, F.xxhash64(*columns, *[c.isNull() for c in columns])))
    first = keyed.groupBy("_fp").agg(F.min("_row").alias("_first"))
    kept = keyed.join(first.select("_fp", F.col("_first").alias("_row")), ["_fp", "_row"], "left_semi")
    return kept.dropDuplicates(["_fp"]).select(*docs.columns)
