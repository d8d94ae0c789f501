"""Personal data: wide generators propose spans, boosted trees over their format and context select what to redact."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boosting
from .shared import stored


@dataclass(frozen=True)
class Generator:
    """A pattern for one kind of span; base: its valid matches are findings whatever a model says."""

    name: str
    pattern: str
    base: bool = False


_LOCAL = "[A-Za-z0-9._%+-]"
# The base patterns of the contract. A run of characters is entered at its start only, and possessively, so that long runs take one pass.
GENERATORS = (
    Generator("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True),
    Generator("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True),
    Generator("card", r"[0-9](?:[\x20-]?[0-9])++", True),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True),
    Generator("number", r"[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9])++"),
    Generator("address", rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?(?:@|[\[({{<]\x20?(?i:at|@)\x20?[\])}}>])\x20?[A-Za-z0-9-]{{1,63}}+(?:\x20?(?:\.|[\[({{<]\x20?(?i:dot|\.)\x20?[\])}}>])\x20?[A-Za-z0-9-]{{1,63}}+)++"),
    Generator("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
)
#: A number of the wide generator has so many digits, or the three dots of an address.
LEAST_DIGITS = 7
#: Characters before and after a span that its features see.
BEFORE, AFTER = 32, 8
#: Words near a span that speak for or against a kind.
CUES = (r"(?i)mail|contact|write to", r"(?i)phone|tel\b|tel[.:]|call|fax|mobile|whatsapp|anruf|appel|llam", r"(?i)card|visa|credit|karte|carte|tarjeta|iban|account|konto", r"(?i)\bip\b|host|server|addr|ping|login", r"(?i)version|\bv$|order|isbn|page|total|token|key|hash|sha|\bid\b|no\.$|#$")
#: A country code with what separates it from the number.
COUNTRY = r"^\+[0-9]{1,3}[\x20.-]{0,2}(?=[0-9(])"
ROUNDS, DEPTH, RATE = 10, 3, 0.5
#: Of the held-out candidates over a threshold so many are to be right, so many at least support it, and none is lower than the last.
PRECISION, SUPPORT, FLOOR = 0.95, 20, 0.9
#: A form of a number that is a date.
DATE = r"^(?:19|20)[0-9]{2}[.-][0-9]{2}[.-][0-9]{2}|^[0-9]{2}[.-][0-9]{2}[.-](?:19|20)[0-9]{2}"
_BLOCK = 256
_SPANS = "array<struct<start:bigint,order:int,end:bigint,value:string,before:string,after:string>>"


def _once(value: Column, body) -> Column:
    """body of a value that is evaluated once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def proposed(text: Column, generator: Generator, order: int) -> Column:
    """The generator's matches, leftmost and not overlapping, with places in code points and the text around them.

    Matches and what stands between them come from one pattern; lengths add up
    to places, in blocks, so that many matches cost their number only.
    """
    cut, hits = F.split(text, generator.pattern, -1), F.regexp_extract_all(text, F.lit(generator.pattern), F.lit(0))

    def pieces(between: Column) -> Column:
        return F.transform(hits, lambda h, i: F.struct(F.length(F.get(between, i)).alias("gap"), F.length(h).alias("size"), h.alias("value"), F.substring(F.get(between, i), -BEFORE, BEFORE).alias("before"), F.substring(F.get(between, i + 1), 1, AFTER).alias("after")))

    def ends(xs: Column) -> Column:
        """Where each piece ends, by running sums inside blocks and over them."""
        step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["gap"] + x["size"])).alias("out"))
        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(_BLOCK)), lambda s: F.aggregate(F.slice(xs, s, F.lit(_BLOCK)), begin, step))
        over = lambda bs: F.aggregate(bs, begin, lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return _once(blocks, lambda bs: F.flatten(F.zip_with(bs, over(bs), lambda b, base: F.transform(b["out"], lambda e: e + base))))

    def placed(xs: Column) -> Column:
        return F.zip_with(xs, ends(xs), lambda x, e: F.struct((e - x["size"]).alias("start"), F.lit(order).alias("order"), e.alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after")))

    return F.when(text.rlike(generator.pattern), _once(_once(cut, pieces), placed)).otherwise(F.array().cast(_SPANS))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """12 to 19 digits whose Luhn sum ends in 0."""
    d = F.reverse(_digits(v))

    def term(i: Column) -> Column:
        x = F.ascii(F.substring(d, i, F.lit(1))) - 48
        return F.when(i % 2 == 1, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))

    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + term(i))
    return F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(False)


def octets(v: Column) -> Column:
    """Four numbers of at most 255."""
    parts = F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0))
    small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255")
    return (F.size(parts) == 4) & F.forall(parts, small)


def checksum(v: Column) -> Column:
    """An account number whose remainder by 97 is 1."""
    plain = F.regexp_replace(v, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c <= 57, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.least(F.length(turned), F.lit(64))), F.lit(0), step) == 1


def _valid(s: Column) -> Column:
    """Whether a base match is a finding."""
    n = F.length(_digits(s["value"]))
    return F.when(s["order"] == 0, True).when(s["order"] == 1, octets(s["value"])).when(s["order"] == 2, luhn(s["value"])).otherwise(n.between(9, 15))


def proposals(docs: DataFrame, id_col: str | None, text_col: str, generators=GENERATORS, whole: bool = False) -> DataFrame:
    """(row_id, doc_id, base, wide) of every row: valid base findings, and what the wide generators propose; with `whole` the row itself."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = [F.filter(proposed(text, g, i), _valid) for i, g in enumerate(generators) if g.base]
    wide = [proposed(text, g, i) for i, g in enumerate(generators) if not g.base]
    enough = lambda s: (F.length(_digits(s["value"])) >= LEAST_DIGITS) | (F.length(F.regexp_replace(s["value"], r"[^.]", "")) == 3) | s["value"].rlike("[A-Za-z]")
    ident = [F.col(id_col).cast("bigint").alias("doc_id")] if id_col else []
    row = [F.struct(*docs.columns).alias("row")] if whole else []
    told = F.transform(F.array_sort(F.concat(*base)), lambda s: F.struct(s["start"], s["order"], s["end"]))
    return docs.select(F.monotonically_increasing_id().alias("row_id"), *ident, told.alias("base"), F.filter(F.concat(*wide), enough).alias("wide"), *row)


def _bin(x: Column, *edges: int) -> Column:
    """How many of the rising edges x reaches."""
    out = F.lit(0)
    for e in edges:
        out = out + (x >= e).cast("int")
    return out


def _class(c: Column) -> Column:
    """Space or none, letter, digit, quote or sign of assignment, other."""
    return F.when((c == "") | c.rlike(r"^[\x20\x09-\x0D]$"), 0).when(c.rlike(r"^\p{L}$"), 1).when(c.rlike("^[0-9]$"), 2).when(c.isin('"', "'", "=", ":"), 3).otherwise(4)


def features(value: Column, before: Column, after: Column, kind: Column) -> Column:
    """Format and context as small whole numbers. A leading country code, and how an address writes its sign, is left out: those mark the base forms."""
    whole, value = value, F.regexp_replace(value, COUNTRY, "")
    digits, groups = F.length(_digits(value)), F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
    count = lambda p: F.length(value) - F.length(F.regexp_replace(value, p, ""))
    of = lambda i: F.length(F.coalesce(F.get(groups, i), F.lit("")))
    parts = [kind, _bin(digits, 1, 4, 7, 8, 9, 10, 11, 12, 13, 15, 16, 17, 20), _bin(F.size(groups), 1, 2, 3, 4, 5, 6), _bin(of(F.lit(0)), 1, 2, 3, 4, 5, 9), _bin(of(F.size(groups) - 1), 1, 2, 3, 4, 5, 9)]
    parts += [_bin(F.array_max(F.concat(F.array(F.lit(0)), F.transform(groups, lambda g: F.length(g)))), 2, 3, 4, 5, 9), _bin(count(r"[()]"), 1, 2), _bin(count(r"\."), 1, 2, 3, 4), _bin(count("-"), 1, 2, 3), _bin(count(" "), 1, 2, 3, 4), _bin(count("[A-Za-z]"), 1, 4, 10, 20)]
    parts += [luhn(whole).cast("int"), octets(whole).cast("int"), F.when(whole.rlike("^[A-Z]{2}[0-9]{2}"), checksum(whole)).otherwise(False).cast("int"), _class(F.substring(before, -1, 1)), _class(F.substring(after, 1, 1))]
    parts += [before.rlike(c).cast("int") for c in CUES]
    return F.array(*[p.cast("int") for p in parts])


def _wrong(value: Column, before: Column, after: Column) -> Column:
    """Proposals that rules tell to be nothing personal: dates, what other words announce, parts of longer words, failing check sums, too many digits."""
    n, dots = F.length(_digits(value)), F.length(value) - F.length(F.regexp_replace(value, r"\.", ""))
    inside = _class(F.substring(before, -1, 1)).isin(1, 2) | _class(F.substring(after, 1, 1)).isin(1, 2)
    return before.rlike(CUES[-1]) | value.rlike(DATE) | inside | (~value.rlike("[A-Za-z(]") & n.between(12, 19) & ~luhn(value)) | (~value.rlike("[A-Za-z]") & (dots == 3) & ~octets(value)) | (n > 34)


def _candidates(rows: DataFrame, generators) -> DataFrame:
    """(row_id, start, order, end, bins, held_out, covered, told) of the wide proposals of stored rows; covered: a base finding overlaps it; told: 1 right, 0 wrong, null where no rule says."""
    empty = [F.lit("").alias(c) for c in ("value", "before", "after")]
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), *empty))
    each = rows.where(F.size("wide") > 0).select("row_id", F.explode(F.concat(base, F.col("wide"))).alias("s")).select("row_id", "s.*")
    is_base = F.get(F.array(*[F.lit(g.base) for g in generators]), F.col("order"))
    up = Window.partitionBy("row_id").orderBy("start", "order").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row_id").orderBy(F.desc("start"), F.desc("order")).rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(up)).withColumn("next", F.min(F.when(is_base, F.col("start"))).over(down))
    covered = (F.coalesce("reach", F.lit(-1)) > F.col("start")) | (F.coalesce("next", F.col("end")) < F.col("end"))
    names = [g.name for g in generators]
    kinds = F.col("order") - names.index(next(g.name for g in generators if not g.base))
    held_out = F.pmod(F.xxhash64("value"), F.lit(5)) == 0
    checked = F.when(F.col("value").rlike("^[A-Z]{2}[0-9]{2}"), checksum(F.col("value"))).otherwise(False)
    told = F.when(covered | checked, 1).when(_wrong(F.col("value"), F.col("before"), F.col("after")), 0)
    return each.where(~is_base).select("row_id", "start", "order", "end", features(F.col("value"), F.col("before"), F.col("after"), kinds).alias("bins"), held_out.alias("held_out"), covered.alias("covered"), told.alias("told"))


@dataclass(frozen=True)
class Model:
    """Trees, and for each generator the probability from which its proposals are redacted; a generator without one adds nothing."""

    trees: boosting.Boosted
    thresholds: dict[int, float] = field(default_factory=dict)


def train(candidates: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, precision: float = PRECISION, support: int = SUPPORT, floor: float = FLOOR) -> Model:
    """Trees from the candidates that rules tell: right ones, which a base finding covers or whose check number is right, against wrong ones (`_wrong`).

    Those that no rule tells, forms beyond the base patterns among them, take no
    part; the trees judge them by what they have in common with the told ones.
    Equal feature rows are counted before anything is sent on. A value's hash
    says whether it is held out; on those a generator's threshold is the least
    probability from which on `precision` of the candidates are right, if
    `support` of them are at least; it is never under `floor`.
    """
    known = candidates.where("told is not null")
    counted = stored(known.groupBy("order", "bins", "held_out").agg(F.sum(F.col("told").cast("bigint")).alias("positive"), F.sum(1 - F.col("told").cast("bigint")).alias("negative")), "candidate-counts")
    trees = boosting.fit(counted.where("not held_out"), rounds, depth, rate)
    score = F.floor(trees.probability(F.col("bins")) * 1000).cast("int")
    tally: dict[int, dict[int, list[int]]] = {}
    for r in counted.where("held_out").groupBy("order", score.alias("score")).agg(F.sum("positive"), F.sum("negative")).collect():  # at most 1001 rows a generator
        tally.setdefault(r[0], {})[r[1]] = [r[2], r[3]]
    thresholds = {}
    for order, by in tally.items():
        good = bad = 0
        for s in sorted(by, reverse=True):
            good, bad = good + by[s][0], bad + by[s][1]
            if good >= support and good >= precision * (good + bad):
                thresholds[order] = max(floor, s / 1000)
    return Model(trees, thresholds)


def _selected(candidates: DataFrame, model: Model) -> DataFrame:
    """(row_id, added) of rows with proposals over their threshold that no base finding covers."""
    least = F.lit(2.0)
    for order, t in sorted(model.thresholds.items()):
        least = F.when(F.col("order") == order, t).otherwise(least)
    some = candidates.where(~F.col("covered")).where(model.trees.probability(F.col("bins")) >= least)
    return some.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "order", "end"))).alias("added"))


_FOUND = "array<struct<start:bigint,order:int,end:bigint>>"


def _found(rows: DataFrame, generators, model: Model | None) -> DataFrame:
    """rows with `found`: base findings and what the model adds."""
    candidates = stored(_candidates(rows, generators), "pii-candidates")
    model = model or train(candidates)
    return rows.join(_selected(candidates, model), "row_id", "left").withColumn("found", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_FOUND)))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generators=GENERATORS, model: Model | None = None) -> DataFrame:
    """(row_id, doc_id, found) of every row: found is its array of (start, order, end), by start and kind.

    `order` is the place in generators. Valid matches of base generators are all
    findings. The wide generators propose numbers, addresses and account numbers,
    also ones that overlap each other; without a model, one is trained on the
    table's own proposals, as far as base findings and rules tell them
    (`train`). A proposal over its generator's threshold that overlaps no base
    finding is added.

    Null text is empty. Each row is scanned by itself, so repeated rows don't
    mix; null ids stay. Empty table, or no proposals: base findings only.
    """
    rows = stored(proposals(docs, id_col, text_col, generators), "pii-proposals")
    return _found(rows, generators, model).select("row_id", "doc_id", "found")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[personal]", generators=GENERATORS, model: Model | None = None) -> DataFrame:
    """docs with every finding of scan in the text replaced by a mark; overlapping ones once. Other columns as they were."""
    rows = stored(proposals(docs, None, text_col, generators, whole=True), "pii-proposals")
    found = _found(rows.drop("row"), generators, model).where(F.size("found") > 0).select("row_id", "found")
    t = F.col("row").getField(text_col)

    def cut(acc: Column, s: Column) -> Column:
        before = F.substring(t, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(before))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("at"))
    done = F.aggregate("found", start, cut, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(t, (acc["at"] + 1).cast("int"), F.lit(2147483647)))), mark))
    joined = rows.select("row_id", "row").join(found, "row_id", "left")
    new = F.when(F.col("found").isNotNull(), done).otherwise(t)
    return joined.select(*[new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def span_list(spans: Column, generators=GENERATORS) -> Column:
    names = F.array(*[F.lit(g.name) for g in generators])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda i: F.size(F.filter("found", lambda s: s["order"] == i)).cast("bigint")
    base = F.filter("found", lambda s: s["order"] < 4)
    return out.select("doc_id", *[count(i).alias(f"n_{GENERATORS[i].name}") for i in range(4)], F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("found")).alias("spans"), F.size(F.filter("found", lambda s: s["order"] >= 4)).cast("bigint").alias("n_added"))
