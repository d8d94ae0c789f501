"""Secret scan: spans by pattern, told apart by how many owners hold the same value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored, with_values


@dataclass(frozen=True)
class Kind:
    """One kind of candidate: its pattern, the group that holds the value, the least length of that value, and whether every match is a finding."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# The base patterns of the contract, then well-known public token formats.
KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16, True),
    Kind("vendor", r"(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 0, 13),
    Kind("userinfo", r"[a-z]{2,12}://[A-Za-z0-9_.-]+:[^\x20/@\x09-\x0D]{8,}@", 0, 10),
)
#: A value that so many owners hold, in so many repositories, is an example that people copy.
WIDE_OWNERS, WIDE_REPOSITORIES = 3, 4
#: A live credential has so many different characters, and none of the words that stand in for one.
LIVE_CHARACTERS = 8
STAND_IN = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0000"
_BLOCK = 256
_SPANS = "array<struct<start:bigint,order:int,end:bigint,value:string>>"


def _once(value: Column, body) -> Column:
    """body of a value that is evaluated once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: Column, kind: Kind, order: int) -> Column:
    """The kind's spans in a text, in code points: array of (start, order, end, value). Leftmost, non-overlapping.

    The texts between the matches and the matches themselves come from the same
    pattern; their lengths add up to the places. They are added up in blocks, so
    that a text of many matches costs their number, not its square.
    """
    between, hits = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.filter(F.arrays_zip(between.alias("before"), hits.alias("hit")), lambda x: x["hit"].isNotNull())
    value = lambda h: F.regexp_extract(h, kind.pattern, kind.group) if kind.group else h
    sized = F.transform(pieces, lambda x: F.struct(F.length(x["before"]).alias("gap"), F.length(x["hit"]).alias("size"), value(x["hit"]).alias("value")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.struct(start.alias("start"), F.lit(order).alias("order"), (start + x["size"]).alias("end"), x["value"].alias("value"))
        return F.struct((start + x["size"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def placed(xs: Column) -> Column:
        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("out"))
        starts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(_BLOCK))
        return _once(F.transform(starts, lambda s: F.aggregate(F.slice(xs, s, F.lit(_BLOCK)), begin, add)), shifted)

    def shifted(blocks: Column) -> Column:
        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        bases = F.aggregate(blocks, begin, lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        moved = lambda s, base: F.struct((s["start"] + base).alias("start"), s["order"].alias("order"), (s["end"] + base).alias("end"), s["value"].alias("value"))
        return F.flatten(F.zip_with(blocks, bases, lambda b, base: F.transform(b["out"], lambda s: moved(s, base))))

    long = F.filter(_once(sized, placed), lambda s: F.length(s["value"]) >= kind.least)
    return F.when(text.rlike(kind.pattern), long).otherwise(F.array().cast(_SPANS))


def candidates(docs: DataFrame, id_col: str | None, text_col: str, repository: Column | None, owner: Column | None, kinds=KINDS, whole: bool = False) -> DataFrame:
    """(row_id, doc_id, repository, owner, spans) of every row, and with `whole` the row itself."""
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    owner = F.coalesce(F.col("source"), F.lit("")) if owner is None else owner
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spans = F.array_sort(F.concat(*[found(text, k, i) for i, k in enumerate(kinds)]))
    ident = [F.col(id_col).cast("bigint").alias("doc_id")] if id_col else []
    row = [F.struct(*docs.columns).alias("row")] if whole else []
    return docs.select(F.monotonically_increasing_id().alias("row_id"), *ident, repository.alias("repository"), owner.alias("owner"), spans.alias("spans"), *row)


def ownership(spans: DataFrame) -> DataFrame:
    """(value_hash, n_repositories, n_owners, n_places) of every candidate value; copies of a value inside one repository fold before the shuffle."""
    each = spans.select("repository", "owner", F.explode("spans").alias("s")).select("repository", "owner", F.sha2("s.value", 256).alias("value_hash"))
    pairs = each.groupBy("value_hash", "repository", "owner").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return owners.groupBy("value_hash").agg(F.sum("repositories").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_places"))


def looks_live(value: Column) -> Column:
    characters = F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("."), F.lit(0))))
    return (characters >= LIVE_CHARACTERS) & ~value.rlike(STAND_IN)


def _span_list(spans: Column, kinds) -> Column:
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


_FOUND = "array<struct<start:bigint,order:int,end:bigint,live:boolean,n_owners:bigint,n_repositories:bigint>>"


def _told(rows: DataFrame, wide_owners: int, wide_repositories: int, kinds) -> DataFrame:
    """(row_id, found) of the stored candidates that have findings."""
    some = rows.where(F.size("spans") > 0)
    owners = stored(ownership(some), "owners")
    each = some.select("row_id", F.posexplode("spans").alias("nth", "s")).withColumn("value_hash", F.sha2("s.value", 256))
    told = with_values(each, owners, "value_hash", "n_places", F.struct("row_id", "nth"))
    copied = (F.col("n_owners") >= wide_owners) & (F.col("n_repositories") >= wide_repositories)
    told = told.withColumn("live", ~copied & looks_live(F.col("s.value")))
    base = F.array(*[F.lit(k.base) for k in kinds])
    told = told.where(F.get(base, F.col("s.order")) | F.col("live"))
    return told.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.order", "s.end", "live", "n_owners", "n_repositories"))).alias("found"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None, wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES, kinds=KINDS) -> DataFrame:
    """(row_id, doc_id, found) of every row: found is its array of (start, order, end, live, n_owners, n_repositories), by start and kind.

    `order` is the place in kinds. A base kind's matches are all findings. Of
    the other kinds, a value is one if it is live. A value is a copied example
    if wide_owners owners or more hold it anywhere in the table, in
    wide_repositories repositories or more; it is live if it is not, has enough
    different characters and holds no word that stands in for a secret. Every
    finding says so, with the counts.

    By default a row's owner is its source, and its repository the source's part
    in one language. Null text is empty; null owners count as one. Each row is
    scanned by itself, so repeated rows don't mix. A text's work grows with its
    length and its matches. Empty table: empty result.
    """
    rows = stored(candidates(docs, id_col, text_col, repository, owner, kinds), "candidates")
    told = _told(rows, wide_owners, wide_repositories, kinds)
    return rows.select("row_id", "doc_id").join(told, "row_id", "left").select("row_id", "doc_id", F.coalesce("found", F.array().cast(_FOUND)).alias("found"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", repository: Column | None = None, owner: Column | None = None, wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES, kinds=KINDS) -> DataFrame:
    """docs with every finding of scan in the text replaced by a mark; other columns as they were.

    Overlapping findings are replaced once. Rows are written once with their
    candidates; only those that have some are joined with the findings.
    """
    rows = stored(candidates(docs, None, text_col, repository, owner, kinds, whole=True), "candidates")
    told = _told(rows.drop("row"), wide_owners, wide_repositories, kinds)
    t = F.col("row").getField(text_col)

    def cut(acc: Column, s: Column) -> Column:
        before = F.substring(t, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(before))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("at"))
    done = F.aggregate("found", start, cut, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(t, (acc["at"] + 1).cast("int"), F.lit(2147483647)))), mark))
    plain = rows.where(F.size("spans") == 0).select("row.*")
    joined = rows.where(F.size("spans") > 0).select("row_id", "row").join(told, "row_id", "left")
    new = F.when(F.col("found").isNotNull(), done).otherwise(t)
    return plain.unionByName(joined.select(*[new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]))


def query(spark, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda s: s["order"] < 3)
    count = lambda i: F.size(F.filter("found", lambda s: s["order"] == i)).cast("bigint")
    most = lambda c: F.coalesce(F.array_max(F.transform("found", lambda s: s[c])), F.lit(0)).cast("bigint")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_span_list(base, KINDS), 256).alias("base_sha256"), _span_list(F.col("found"), KINDS).alias("spans"), F.size(F.filter("found", lambda s: s["live"])).cast("bigint").alias("n_live"), most("n_owners").alias("most_owners"), most("n_repositories").alias("most_repositories"))


def oracle() -> str:
    """The query in DuckDB's SQL, from the same patterns."""
    parts = []
    for i, k in enumerate(KINDS):
        pattern = k.pattern.replace("'", "''")
        value = f"regexp_extract(h, '{pattern}', {k.group})" if k.group else "h"
        parts.append(
            f"SELECT doc_id, source, lang, {i} AS ord, '{k.name}' AS kind, s AS start, s + length(h) AS stop, {value} AS v FROM ("
            f"SELECT doc_id, source, lang, hs[i] AS h, coalesce(list_sum(list_transform(bs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hs[1:i - 1], lambda x: length(x))), 0) AS s FROM ("
            f"SELECT doc_id, source, lang, regexp_extract_all(coalesce(text, ''), '{pattern}') AS hs, string_split_regex(coalesce(text, ''), '{pattern}') AS bs FROM documents), unnest(generate_series(1, len(hs))) AS t(i)) WHERE length({value}) >= {k.least}"
        )
    union = " UNION ALL ".join(parts)
    return f"""
WITH c AS ({union}),
o AS (SELECT v, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT concat_ws('/', source, lang)) AS repositories FROM c GROUP BY v),
f0 AS (SELECT c.*, owners, repositories, NOT (owners >= {WIDE_OWNERS} AND repositories >= {WIDE_REPOSITORIES}) AND len(list_distinct(regexp_extract_all(c.v, '.'))) >= {LIVE_CHARACTERS} AND NOT regexp_matches(c.v, '{STAND_IN}') AS live FROM c JOIN o ON o.v = c.v),
f AS (SELECT * FROM f0 WHERE ord < 3 OR live),
g AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex, count(*) FILTER (live) AS n_live, max(owners) AS most_owners, max(repositories) AS most_repositories,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, ord) FILTER (ord < 3) AS base,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, ord) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(most_owners, 0) AS BIGINT) AS most_owners, CAST(coalesce(most_repositories, 0) AS BIGINT) AS most_repositories
FROM documents d LEFT JOIN g USING (doc_id)
"""


ORACLE = oracle()
