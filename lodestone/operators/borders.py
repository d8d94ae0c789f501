"""Sentence borders learned from a corpus: abbreviations and sentence starters by likelihood ratios over counts (Kiss and Strunk, 2006)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Scores from which a word with a full stop is an abbreviation, and a word begins sentences.
ABBREVIATION, STARTER = 0.3, 30.0
#: What stands around a word; a word of its own has a letter.
OPENING, CLOSING = r"""^["'(\[{«„“‚‘]+""", r"""["')\]}»”’,;:!?]+$"""
_OPENED, _CLOSED = OPENING[2:-2].replace("\\[", "["), CLOSING[1:-3].replace("\\]", "]")


def _ends(bare: Column) -> Column:
    """Whether a word ends in one full stop and has more than that."""
    return F.endswith(bare, F.lit(".")) & ~F.endswith(bare, F.lit("..")) & (bare != ".")


def _told(word: Column) -> Column:
    """(type: the word in lower case without a last full stop, stop: whether it has one) of a token; trims of the characters in OPENING and CLOSING, as patterns are slow."""
    bare = F.rtrim(F.ltrim(word, F.lit(_OPENED)), F.lit(_CLOSED))
    stop = _ends(bare)
    return F.struct(F.lower(F.when(stop, F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)).alias("type"), stop.alias("stop"))


def _tokens(docs: DataFrame, text_col: str, group: Column) -> DataFrame:
    """(grp, prev, type, stop, n) of tokens with the type of the one before in its text, where that has a full stop; else prev is null.

    Words are counted as they are, and only different ones are looked at by patterns. The
    one before is kept where it has a dot, so what is shuffled is a vocabulary and the
    pairs at stops, not every pair.
    """
    split = docs.select(group.alias("grp"), F.split(T.text_of(F.col(text_col)), T.SPACE).alias("w"))
    pairs = split.select("grp", F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), "w").alias("prev"), F.col("w").alias("word"))).alias("p"))
    dotted = F.when(F.contains("p.prev", F.lit(".")), F.col("p.prev"))
    counted = pairs.where("p.word <> ''").groupBy("grp", dotted.alias("prev"), F.col("p.word").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    told = counted.select("grp", _told(F.col("prev")).alias("prev"), _told(F.col("word")).alias("x"), "n")
    sure = lambda c, v: F.coalesce(c, F.lit(v))  # a join's keys aren't null; Spark would test that on every token
    return told.select("grp", F.when(F.col("prev.stop"), F.col("prev.type")).alias("prev"), sure(F.col("x.type"), "").alias("type"), sure(F.col("x.stop"), False).alias("stop"), "n")


def _log(k: Column, p: Column) -> Column:
    """k times the logarithm of p, 0 where k is."""
    return F.when(k == 0, 0.0).otherwise(k * F.ln(F.greatest(p, F.lit(1e-300))))


def _least(score: Column, bound: float) -> Column:
    """Whether a score rounded to six places reaches a bound; few are rounded, as that is slow."""
    return (score > bound - 0.001) & (F.round(score, 6) >= bound)


def abbreviation_score(with_stop: Column, without: Column, stops: Column, total: Column, kind: Column) -> Column:
    """How much more likely a type is one that always has a full stop than one that has it as often as any; short types and inner stops count more, occurrences without a stop less."""
    p, n = stops / total, with_stop + without
    ratio = 2 * (_log(with_stop, F.lit(0.99)) + _log(without, F.lit(0.01)) - _log(with_stop, p) - _log(without, 1 - p))
    inner = F.length(kind) - F.length(F.replace(kind, F.lit("."), F.lit("")))
    letters = F.length(kind) - inner
    return ratio * F.exp(-letters) * (inner + 1) * F.pow(F.greatest(letters, F.lit(1)).cast("double"), -without)


def collocation_score(a: Column, b: Column, both: Column, total: Column) -> Column:
    """Dunning's ratio for an event b times among `total`, a of which are of one kind and `both` are both."""
    p, p1, p2 = b / total, both / a, (b - both) / F.greatest(total - a, F.lit(1))
    return 2 * (_log(both, p1) + _log(a - both, 1 - p1) + _log(b - both, p2) + _log(total - a - b + both, 1 - p2) - _log(b, p) - _log(total - b, 1 - p))


def learned(docs: DataFrame, text_col: str = "text", group_col: str | None = None) -> DataFrame:
    """(grp, type, with_stop, without, abbreviation, starts, starter): every type that is an abbreviation or begins sentences, by group, such as a language.

    Tokens are words between white space; counts of them and of neighbours combine
    before the shuffle, and no text moves; two rows for each group are broadcast. A starter follows a full stop that is no
    abbreviation's more often than chance has it. Null texts have no tokens; a null
    group is one of its own.
    """
    group = F.coalesce(F.col(group_col).cast("string"), F.lit("")) if group_col else F.lit("")
    pairs = _tokens(docs, text_col, group)
    n = F.col("n")
    # No filter on a type or on prev alone: Spark would move it below the counts, and read and cut all texts anew for each.
    kinds = pairs.groupBy("type", "grp").agg(F.sum(F.when(F.col("stop"), n).otherwise(0)).alias("with_stop"), F.sum(F.when(~F.col("stop"), n).otherwise(0)).alias("without"))
    lettered = F.when(F.col("with_stop") + F.col("without") > 0, F.col("type").rlike(r"\p{L}"))
    totals = kinds.groupBy("grp").agg(F.sum("with_stop").alias("stops"), F.sum(F.col("with_stop") + F.col("without")).alias("total"))
    score = abbreviation_score(F.col("with_stop"), F.col("without"), F.col("stops"), F.col("total"), F.col("type"))
    scored = kinds.join(F.broadcast(totals), "grp").withColumn("abbreviation", (F.col("with_stop") > 0) & _least(score, ABBREVIATION) & lettered)
    short = scored.where("abbreviation").select("grp", F.col("type").alias("prev"))
    begins = pairs.where(F.when(F.col("prev").isNotNull(), n) > 0).join(short.hint("shuffle_hash"), ["prev", "grp"], "left_anti")
    starts = begins.groupBy("type", "grp").agg(F.sum("n").alias("starts"))
    breaks = starts.groupBy("grp").agg(F.sum("starts").alias("breaks"))
    told = scored.join(starts.hint("shuffle_hash"), ["type", "grp"], "left").join(F.broadcast(breaks), "grp", "left").fillna(0, ["starts", "breaks"])
    n = F.col("with_stop") + F.col("without")
    more = F.col("starts") * F.col("total") > n * F.col("breaks")
    starter = (F.col("starts") > 0) & more & _least(collocation_score(F.col("breaks"), n, F.col("starts"), F.col("total")), STARTER) & lettered
    out = told.withColumn("starter", starter & ~F.col("abbreviation"))
    return out.where("abbreviation or starter").select("grp", "type", "with_stop", "without", "abbreviation", "starts", "starter")


def sentences(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None) -> DataFrame:
    """(id, pos, sentence): texts cut at full stops, question and exclamation marks before a capital or a parenthesis, but not behind an abbreviation or a single letter unless a known starter follows.

    known is what `learned` gives; it is joined, so it may be as large as a
    vocabulary. Only the words around a border are joined; a text moves once, whole, to
    meet the numbers of its borders that don't hold, by a digest of it and its group. White
    space inside a joined sentence becomes one space; rows of a repeated or null id are
    texts of their own.
    """
    group = F.coalesce(F.col(group_col).cast("string"), F.lit("")) if group_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("_id"), group.alias("grp"), T.text_of(F.col(text_col)).alias("_text")).withColumn("_key", F.unhex(F.md5(F.concat(F.length("grp").cast("string"), F.lit(":"), "grp", "_text").cast("binary"))))
    cut = rows.select("_key", "grp", T.sentences(F.col("_text")).alias("_parts"))
    borders = cut.select("_key", "grp", F.posexplode(F.arrays_zip(F.col("_parts").alias("s"), F.slice("_parts", 2, F.size("_parts")).alias("next")))).where("col.next is not null")
    last, first = _told(F.regexp_replace("col.s", rf"\A(?s:.*){T.SPACE[:-1]}", "")), _told(F.regexp_extract("col.next", rf"\A[^{T.SPACE[1:]}", 0))
    borders = borders.where(_ends(F.rtrim(F.col("col.s"), F.lit(_CLOSED)))).select("_key", "grp", "pos", last.alias("last"), first["type"].alias("_first"))
    borders = borders.where("last.stop").select("_key", "grp", "pos", F.col("last.type").alias("_last"), "_first")
    # One list, dealt out once, for both joins; a filter on a flag in either would make two of it.
    flags = known.select("grp", "type", (F.col("abbreviation").cast("int") + 2 * F.col("starter").cast("int")).alias("_flags")).repartition("type", "grp")
    of = lambda c: flags.withColumnRenamed("type", c)
    held = borders.join(of("_last"), ["_last", "grp"], "left").where((F.coalesce("_flags", F.lit(0)).bitwiseAND(1) == 1) | F.col("_last").rlike(r"\A\p{L}\z")).drop("_flags")
    held = held.join(of("_first"), ["_first", "grp"], "left").where(F.coalesce("_flags", F.lit(0)).bitwiseAND(2) == 0)
    held = held.groupBy("_key").agg(F.collect_set(F.col("pos") + 1).alias("_held"))
    both = rows.where("_text <> ''").join(held, "_key", "left").select("_id", "_held", T.sentences(F.col("_text")).alias("s"))
    both = both.select("_id", "s", F.when(F.col("_held").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("s") - 1), "_held")).alias("_new"))
    stretch = lambda at, k: F.array_join(F.slice("s", at + 1, F.coalesce(F.get("_new", k + 1), F.size("s")) - at), " ")
    whole = both.select("_id", F.posexplode(F.when(F.col("_new").isNull(), F.col("s")).otherwise(F.transform("_new", stretch))).alias("pos", "sentence"))
    return whole.select(F.col("_id").alias(id_col), "pos", "sentence")
