"""The registered queries of the retrieval engine, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charsets
from ..functions import html as H
from ..functions import scoring as S
from ..functions import text as T
from ..operators import articles as A
from ..operators import borders as B
from ..operators import chunking as C
from ..operators import gold as G
from ..operators import index as I
from ..operators import memo as M
from ..operators import positions as P
from ..operators import quality as Q
from ..operators import retrieval as R
from ..operators import token_chunks as K
from ..operators import vectors as V
from ..sources.tables import parquet, work_folder
from ..streaming.edit_log import EditLog

SECTIONS = ("Treatment", "Case report", "Conclusion", "In summary", "Exercise plan", "Biomechanics", "Symptoms and pain", "Resting position", "Other", "Assessment")
LEXICON = S.Lexicon(topics=(("the", "src1"), ("de", "src2"), ("re", "src3")), terms=("rest", "tion"))
CUES = ("the", "of", "and", "de", "la")

_found: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(sql: str | None = None):
    def add(f):
        _found[f.__name__] = (f, sql)
        return f

    return add


def _docs(spark, d):
    return parquet(spark, d, "documents")


SPLIT = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[ \t\n\r\f\x0B]+'), lambda x: x <> '')"
WORDS = "len(" + SPLIT + ")"
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
KNN = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
d0 AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_sum(list_transform(generate_series(1, len(c.v)), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i]))), 6) AS dist FROM e q, e c WHERE q.vec_id % 100 = 0),
k0 AS (SELECT query_id, id, dist, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS INT) AS rank FROM d0),
k AS (SELECT * FROM k0 WHERE rank <= 50)"""


def _hits(spark, d) -> DataFrame:
    e = parquet(spark, d, "embeddings")
    return V.knn(e.where("vec_id % 100 = 0"), e)


@register(f"WITH {KNN} SELECT query_id, rank, id, dist FROM k")
def knn_batch(spark, d):
    return _hits(spark, d)


@register(f"WITH {KNN} SELECT query_id, rank, id, dist FROM k")
def index_search(spark, d):
    e, path = parquet(spark, d, "embeddings"), work_folder(spark, "index")
    I.build(e, path)
    return I.Index(spark, path).search(e.where("vec_id % 100 = 0"))


@register("""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 1 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS v FROM embeddings WHERE vec_id % 7 <> 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_sum(list_transform(generate_series(1, len(c.v)), lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(c.v[i] AS DOUBLE)) * (CAST(q.embedding[i] AS DOUBLE) - CAST(c.v[i] AS DOUBLE)))), 6) AS dist FROM embeddings q, e c WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, id, dist FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS INT) AS rank FROM d) WHERE rank <= 10""")
def index_upserts(spark, d):
    e, path = parquet(spark, d, "embeddings"), work_folder(spark, "index")
    I.build(e, path)
    turned = e.where("vec_id % 7 = 1").withColumn("embedding", F.transform("embedding", lambda x: -x))
    return I.Index(spark, path).upsert(turned).remove(e.where("vec_id % 7 = 0")).search(e.where("vec_id % 100 = 0"), 10)


@register(f"WITH {KNN} SELECT query_id, round(avg(1 - dist), 6) AS retrieval_confidence FROM k WHERE rank <= 5 GROUP BY query_id")
def retrieval_confidence(spark, d):
    return R.confidence(_hits(spark, d))


def _section(label):
    return F.coalesce(F.get(F.array(*[F.lit(s) for s in SECTIONS]), label.cast("int")), F.lit("Other"))


def _items(spark, d) -> DataFrame:
    docs = _docs(spark, d)
    labels = parquet(spark, d, "embeddings").select(F.col("vec_id").alias("id"), _section(F.col("label")).alias("section"))
    hits = _hits(spark, d).join(labels, "id").join(docs.select(F.col("doc_id").alias("id"), "source", "text"), "id")
    hits = hits.join(docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("question")), "query_id")
    return R.biased(hits.withColumn("token_len", T.query_tokens(F.col("text"))), LEXICON)


def _sql_parts(parts, x):
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


def _sql_in(names):
    return "(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"


BIAS = (
    f"CASE WHEN section IN {_sql_in(S.GOOD)} THEN -0.50 WHEN section IN {_sql_in(S.NARRATIVE)} THEN 0.75 WHEN section IN {_sql_in(S.LOW)} THEN 0.20 "
    f"WHEN {_sql_parts(S.GOOD_PARTS, 'lower(section)')} THEN -0.35 WHEN {_sql_parts(S.NARRATIVE_PARTS, 'lower(section)')} THEN 0.50 ELSE 0.0 END"
)
STORY = rf"(regexp_matches(lower(text), '{T.PATIENT_AGE}') OR {_sql_parts(T.PATIENT_PHRASES, 'lower(text)')})"
ITEMS = (
    KNN
    + f""",
j AS (SELECT k.*, list_extract({list(SECTIONS)}, CAST(e.label AS INT) + 1) AS section, c.source, c.text, q.text AS question,
  CAST(round_even({WORDS.format('c.text')} * 1.33, 0) AS INT) AS token_len FROM k JOIN e ON e.vec_id = k.id JOIN documents c ON c.doc_id = k.id JOIN documents q ON q.doc_id = k.query_id),
b AS (SELECT * REPLACE (round(dist - CASE WHEN {" OR ".join(f"(contains(lower(question), '{a}') AND contains(lower(source), '{h}'))" for a, h in LEXICON.topics)} THEN 0.30 ELSE 0 END
  - CASE WHEN {_sql_parts(LEXICON.terms, 'lower(text)')} THEN 0.15 ELSE 0 END + {BIAS} + CASE WHEN {STORY} THEN 0.20 ELSE 0 END, 6) AS dist) FROM j),
i AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, rank) AS INT) AS pos FROM b)"""
)
POOL = (
    ITEMS
    + """,
p1 AS (SELECT *, min(pos) OVER (PARTITION BY query_id, source) AS f0 FROM i),
p2 AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY f0) AS INT) AS source_rank, row_number() OVER (PARTITION BY query_id, source ORDER BY dist, pos) AS n0 FROM p1),
p3 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY source_rank, dist, pos) AS INT) AS flat_pos FROM p2 WHERE n0 <= 8),
p AS (SELECT * FROM p3 WHERE flat_pos <= 50)"""
)


@register(f"WITH {ITEMS} SELECT query_id, id, rank, pos, dist FROM i")
def bias_scored(spark, d):
    return _items(spark, d).select("query_id", "id", "rank", "pos", "dist")


@register(f"WITH {POOL} SELECT query_id, id, source, source_rank, flat_pos, dist FROM p")
def per_source_pool(spark, d):
    return R.pooled(_items(spark, d)).select("query_id", "id", "source", "source_rank", "flat_pos", "dist")


def _pick_sql(budget: int) -> str:
    return (
        POOL
        + f""",
q1 AS (SELECT *, min(dist) OVER (PARTITION BY query_id, source, section) + {BIAS} AS s0, min(flat_pos) OVER (PARTITION BY query_id, source, section) AS sp FROM p WHERE source_rank <= 4),
q2 AS (SELECT *, first_value(section) OVER (PARTITION BY query_id, source ORDER BY round(s0, 6), sp, flat_pos) AS best FROM q1),
q3 AS (SELECT query_id, id, source_rank, token_len AS t, section, source, text, row_number() OVER (PARTITION BY query_id ORDER BY source_rank, dist, flat_pos) AS n FROM q2 WHERE section = best),
w(query_id, n, used, taken, src, picked) AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT), 0, 0, 0, false FROM q3
  UNION ALL SELECT w.query_id, x.n,
    CASE WHEN o.ok THEN w.used + x.t ELSE w.used END, CASE WHEN o.ok THEN o.tk + 1 ELSE o.tk END, x.source_rank, o.ok
  FROM w JOIN q3 x ON x.query_id = w.query_id AND x.n = w.n + 1,
    LATERAL (SELECT CASE WHEN w.src = x.source_rank THEN w.taken ELSE 0 END AS tk) a,
    LATERAL (SELECT a.tk AS tk, a.tk < 3 AND w.used + x.t <= {budget} + CASE WHEN a.tk = 1 THEN 150 ELSE 0 END AS ok) o),
c AS (SELECT q3.*, CAST(row_number() OVER (PARTITION BY w.query_id ORDER BY w.n) - 1 AS INT) AS pick_pos FROM w JOIN q3 ON q3.query_id = w.query_id AND q3.n = w.n WHERE w.picked)"""
    )


def _picked(spark, d, budget=10_000):
    return R.picked(R.pooled(_items(spark, d)), budget=budget, lexicon=LEXICON)


@register(f"WITH RECURSIVE {_pick_sql(10000)} SELECT query_id, id, pick_pos FROM c")
def pick_context(spark, d):
    return _picked(spark, d).select("query_id", "id", "pick_pos")


@register(f"WITH RECURSIVE {_pick_sql(900)} SELECT query_id, id, pick_pos FROM c")
def pick_context_tight_budget(spark, d):
    return _picked(spark, d, 900).select("query_id", "id", "pick_pos")


@register(f"WITH RECURSIVE {_pick_sql(10000)}, l AS (SELECT query_id, source || ' — ' || section AS l, min(pick_pos) AS f FROM c GROUP BY ALL) SELECT query_id, string_agg(l, chr(10) ORDER BY f) AS citations FROM l GROUP BY query_id")
def citations(spark, d):
    return R.citations(_picked(spark, d))


PRIORITY = "CASE " + " ".join(f"WHEN {_sql_parts(p, 'lower(section)')} THEN {i}" for i, p in enumerate((("rest",), ("movement",), ("biomech", "mechan"), ("compens",), ("symptom", "pain"), ("treat", "exercise"), ("concl", "summary")))) + " ELSE 7 END"


@register(f"WITH RECURSIVE {_pick_sql(10000)} SELECT query_id, string_agg('[' || section || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY {PRIORITY}, pick_pos) AS block, CAST(sum(t) AS BIGINT) AS context_tokens FROM c GROUP BY query_id")
def context_block(spark, d):
    return R.context_blocks(_picked(spark, d))


PROMPT = rf"""WITH RECURSIVE {_pick_sql(10000)}, bl AS (SELECT query_id, string_agg('[' || section || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY {PRIORITY}, pick_pos) AS block FROM c GROUP BY query_id)
SELECT query_id, 'CONTEXT:' || chr(10) || '---' || chr(10) || block || chr(10) || '---' || chr(10) || chr(10)
  || CASE WHEN regexp_matches(q.text, '(?i)\b(exercise|exercises|when to|how often|how long|frequency|reps?|sets?|timing|dose|doseing)\b') THEN 'Answer in a few numbered steps and say why. If the context does not suffice, say so.' ELSE 'Answer in Markdown with short sections. If the context does not suffice, say so.' END
  || chr(10) || chr(10) || 'Question: ' || q.text AS prompt FROM bl JOIN documents q ON q.doc_id = query_id"""


@register(PROMPT)
def build_prompt(spark, d):
    items = _picked(spark, d)
    return R.prompts(R.context_blocks(items).join(items.select("query_id", "question").distinct(), "query_id")).select("query_id", "prompt")


@register("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS i FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 3")
def history_tail(spark, d):
    return R.recent_turns(parquet(spark, d, "conversations"), 3).select("conv_id", "turn", "i")


HISTORY = """hv AS (SELECT c.conv_id, c.turn, coalesce(list_sum(list_transform(generate_series(1, len(a.v)), lambda i: a.v[i] * b.v[i])), 0.0) AS sim FROM conversations c
  LEFT JOIN (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / greatest(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12)) AS v FROM embeddings) a ON a.vec_id = c.conv_id * 5 + c.turn
  LEFT JOIN (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / greatest(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12)) AS v FROM embeddings) b ON b.vec_id = c.conv_id)"""


def _turns(spark, d) -> DataFrame:
    """The last turns with their similarity to the question of their conversation."""
    turns, e = R.recent_turns(parquet(spark, d, "conversations")), parquet(spark, d, "embeddings")
    of_turn = turns.select("conv_id", "turn", (F.col("conv_id") * 5 + F.col("turn")).alias("vec_id")).join(e, "vec_id").select("conv_id", "turn", F.col("embedding").alias("vec"))
    return R.history_similarity(turns, of_turn, e.select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("vec")))


@register("WITH " + HISTORY + """, t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 10),
w AS (SELECT *, pow(0.65, count(*) OVER (PARTITION BY conv_id) - 1 - i) AS weight FROM t WHERE trim(coalesce(text, '')) <> ''),
s AS (SELECT w.*, round(sim * weight * 0.30, 6) AS s FROM w JOIN hv ON hv.conv_id = w.conv_id AND hv.turn = w.turn),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, turn) AS INT) AS memory_rank FROM s)
SELECT conv_id, memory_rank, turn, '[' || upper(role) || '] ' || text AS entry, round(weight, 6) AS weight, round(1 - s + 0.20, 6) AS dist FROM r WHERE memory_rank <= 2""")
def history_ranked(spark, d):
    return R.ranked_memory(_turns(spark, d), F.col("similarity"))


@register(rf"SELECT doc_id, CAST(len({SENTENCES.format('text')}) AS INT) AS n_sentences, array_to_string({SENTENCES.format('text')}, '|') AS sentences FROM documents")
def sentences(spark, d):
    s = T.sentences(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(s).alias("n_sentences"), F.array_join(s, "|").alias("sentences"))


#: The counts of types, what they score, and the words that begin sentences, over one list of tokens.
LEARNED = rf"""tok AS (SELECT grp, doc_id, i, lower(CASE WHEN regexp_matches(bare, '[^.]\.$') THEN left(bare, -1) ELSE bare END) AS type, regexp_matches(bare, '[^.]\.$') AS stop
  FROM (SELECT coalesce(lang, '') AS grp, doc_id, i, regexp_replace(regexp_replace(w[i], '{B.OPENING.replace("'", "''")}', ''), '{B.CLOSING.replace("'", "''")}', '') AS bare FROM (SELECT doc_id, lang, {SPLIT.format('text')} AS w FROM documents), unnest(generate_series(1, len(w))) AS g(i))),
kinds AS (SELECT grp, type, count(*) FILTER (stop) AS with_stop, count(*) FILTER (NOT stop) AS without FROM tok GROUP BY ALL),
totals AS (SELECT grp, sum(with_stop) AS stops, sum(with_stop + without) AS total FROM kinds GROUP BY grp),
parts AS (SELECT *, length(type) - length(replace(type, '.', '')) AS dots, stops / total AS p FROM kinds JOIN totals USING (grp)),
scored AS (SELECT *, regexp_matches(type, '\pL') AND with_stop > 0 AND round(2 * (with_stop * ln(0.99) + without * ln(0.01) - CASE WHEN with_stop > 0 THEN with_stop * ln(p) ELSE 0 END - CASE WHEN without > 0 THEN without * ln(1 - p) ELSE 0 END)
  * exp(-(length(type) - dots)) * (dots + 1) * pow(greatest(length(type) - dots, 1), -without), 6) >= {B.ABBREVIATION} AS abbreviation FROM parts),
starts AS (SELECT b.grp, b.type, count(*) AS starts FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.i = a.i + 1 JOIN scored s ON s.grp = a.grp AND s.type = a.type WHERE a.stop AND NOT s.abbreviation GROUP BY ALL),
breaks AS (SELECT grp, sum(starts) AS breaks FROM starts GROUP BY grp),
told AS (SELECT s.*, coalesce(starts, 0) AS starts, coalesce(breaks, 0) AS breaks, with_stop + without AS n FROM scored s LEFT JOIN starts USING (grp, type) LEFT JOIN breaks USING (grp)),
ratios AS (SELECT *, n / total AS q, starts / nullif(breaks, 0) AS q1, (n - starts) / greatest(total - breaks, 1) AS q2 FROM told),
known AS (SELECT grp, type, with_stop, without, abbreviation, starts, coalesce(NOT abbreviation AND regexp_matches(type, '\pL') AND starts > 0 AND starts * total > n * breaks AND round(2 * (
  starts * ln(q1) + CASE WHEN breaks > starts THEN (breaks - starts) * ln(1 - q1) ELSE 0 END + CASE WHEN n > starts THEN (n - starts) * ln(q2) ELSE 0 END + CASE WHEN total - breaks - n + starts > 0 THEN (total - breaks - n + starts) * ln(1 - q2) ELSE 0 END
  - n * ln(q) - (total - n) * ln(1 - q)), 6) >= {B.STARTER}, false) AS starter FROM ratios)"""


@register(f"WITH {LEARNED} SELECT grp, type, with_stop, without, abbreviation, starts, starter FROM known WHERE abbreviation OR starter")
def learned_borders(spark, d):
    return B.learned(_docs(spark, d), group_col="lang")


def _bare_sql(word: str) -> str:
    opening, closing = (p.replace("'", "''") for p in (B.OPENING, B.CLOSING))
    return f"regexp_replace(regexp_replace({word}, '{opening}', ''), '{closing}', '')"


LAST_WORD, FIRST_WORD = (_bare_sql(rf"regexp_extract(s[i], '{p}')") for p in (r"[^ \t\n\r\f\x0B]+$", r"^[^ \t\n\r\f\x0B]+"))


@register(rf"""WITH {LEARNED},
s AS (SELECT doc_id, coalesce(lang, '') AS grp, {SENTENCES.format('text')} AS s FROM documents),
e AS (SELECT doc_id, grp, i, s[i] AS s, {LAST_WORD} AS last, {FIRST_WORD} AS first FROM s, unnest(generate_series(1, len(s))) AS g(i)),
f AS (SELECT doc_id, grp, i, s, CASE WHEN regexp_matches(last, '[^.]\.$') THEN lower(left(last, -1)) END AS last, lower(CASE WHEN regexp_matches(first, '[^.]\.$') THEN left(first, -1) ELSE first END) AS first FROM e),
j AS (SELECT f.*, coalesce(a.abbreviation, false) OR coalesce(regexp_matches(last, '^\pL$'), false) AS held, coalesce(b.starter, false) AS starts FROM f LEFT JOIN known a ON a.grp = f.grp AND a.type = f.last LEFT JOIN known b ON b.grp = f.grp AND b.type = f.first),
n AS (SELECT *, CASE WHEN starts OR NOT coalesce(lag(held) OVER (PARTITION BY doc_id ORDER BY i), false) THEN 1 ELSE 0 END AS new FROM j),
k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM n)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1 AS INT) AS pos, string_agg(s, ' ' ORDER BY i) AS sentence FROM k GROUP BY doc_id, nth""")
def learned_sentences(spark, d):
    docs = _docs(spark, d)
    return B.sentences(docs, B.learned(docs, group_col="lang"), group_col="lang")


@register()
def causal_groups(spark, d):
    g = C.causal_groups(T.sentences(F.col("text")), CUES)
    return _docs(spark, d).select("doc_id", F.posexplode(g).alias("pos", "grp"))


@register(rf"WITH s AS (SELECT doc_id, {SENTENCES.format('text')} AS s FROM documents) SELECT doc_id, CAST(i // 4 AS INT) AS pos, array_to_string(s[i + 1:i + 6], ' ') AS win FROM s, unnest(generate_series(0, len(s) - 1, 4)) AS t(i)")
def sentence_windows(spark, d):
    once = _docs(spark, d).select("doc_id", F.explode(F.array(T.sentences(F.col("text")))).alias("s"))  # evaluated once, not at each use
    return once.select("doc_id", F.posexplode(C.windows(F.col("s"))).alias("pos", "win"))


@register(rf"WITH s AS (SELECT doc_id, {SPLIT.format('text')} AS s FROM documents) SELECT doc_id, CAST(i // 96 AS INT) AS pos, array_to_string(s[i + 1:i + 128], ' ') AS win FROM s, unnest(generate_series(0, len(s) - 1, 96)) AS t(i)")
def token_windows(spark, d):
    once = _docs(spark, d).select("doc_id", F.explode(F.array(T.words(F.col("text")))).alias("s"))
    return once.select("doc_id", F.posexplode(C.windows(F.col("s"), 128, 32)).alias("pos", "win"))


@register()
def chunk_pipeline(spark, d):
    return K.chunks(_docs(spark, d), cues=CUES)


@register()
def token_chunk_pipeline(spark, d):
    import public_tokenizers

    return K.chunks(_docs(spark, d), cues=CUES, section_col="lang", tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


@register(f"SELECT doc_id, CAST({WORDS.format('text')} AS INT) AS n_words, CAST(floor({WORDS.format('text')} / 0.75) AS INT) AS chunk_tokens, CAST(round_even({WORDS.format('text')} * 1.33, 0) AS INT) AS query_tokens FROM documents")
def token_counts(spark, d):
    c = F.col("text")
    return _docs(spark, d).select("doc_id", T.word_count(c).alias("n_words"), T.chunk_tokens(c).alias("chunk_tokens"), T.query_tokens(c).alias("query_tokens"))


TOKENS = f"SELECT CAST(floor({WORDS.format('text')} / 0.75) AS INT) AS t FROM documents"


@register(f"WITH x AS ({TOKENS}) SELECT round(avg(t), 4) AS mean, CAST(min(t) AS BIGINT) AS min, CAST(max(t) AS BIGINT) AS max, round(median(t), 4) AS median, round(quantile_cont(t, 0.95), 4) AS p95, count(*) FILTER (t > 512) AS over_512, round(100.0 * count(*) FILTER (t > 512) / count(t), 4) AS percent_over_512 FROM x")
def token_stats(spark, d):
    return Q.length_stats(_docs(spark, d).select(T.chunk_tokens(F.col("text")).alias("t")), "t")


@register(f"WITH x AS ({TOKENS}), b AS (SELECT unnest([0, 128, 256, 512, 768, 1024, 2048]) AS low, unnest([128, 256, 512, 768, 1024, 2048, 4096]) AS high) SELECT CAST(low AS INT) AS low, CAST(high AS INT) AS high, count(t) AS n FROM b LEFT JOIN x ON t >= low AND (t < high OR (high = 4096 AND t = 4096)) GROUP BY ALL")
def token_histogram(spark, d):
    return Q.histogram(_docs(spark, d).select(T.chunk_tokens(F.col("text")).alias("t")), "t")


FINGERPRINT = r"sha256(trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g')))"


@register(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY {FINGERPRINT} ORDER BY source, doc_id) AS n FROM documents) WHERE n = 1")
def dedup_near_exact(spark, d):
    return C.dedup_near_exact(_docs(spark, d), "text", ["source", "doc_id"]).select("doc_id", "source")


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark, d):
    return Q.orphans(_docs(spark, d), parquet(spark, d, "labels"), "doc_id").select("doc_id")


@register("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return Q.duplicate_ids(parquet(spark, d, "events"), "user_id")


@register("""WITH b AS (SELECT count(*) AS rows, count(doc_id) - count(DISTINCT doc_id) AS surplus_ids, count(*) FILTER (regexp_matches(text, 'â|Â|�|‚Ä|√')) AS mojibake FROM documents), o AS (SELECT count(*) AS orphans FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT rows, surplus_ids, mojibake, orphans, CAST(1 AS BIGINT) AS missing_columns, true AS failed FROM b, o""")
def validation_report(spark, d):
    return Q.validation_report(_docs(spark, d), parquet(spark, d, "labels"), "doc_id", "text", ["doc_id", "text", "section"])


@register(rf"SELECT doc_id, length(trim(text)) < 50 OR regexp_matches(trim(text), '{T.INDEX_CAPTION}') AS bad, regexp_matches(text, '{T.CAPTION}') AS caption, regexp_matches(text, '{T.REFERENCE_BLOCK}') AS reference, regexp_matches(substr(trim(text), 1, 80), '{T.ODD_NUMBERS}') AS odd, {STORY} AS story FROM documents")
def block_rules(spark, d):
    c = F.col("text")
    return _docs(spark, d).select("doc_id", T.is_bad_chunk(c).alias("bad"), T.is_caption(c).alias("caption"), T.is_reference_block(c).alias("reference"), T.looks_odd(c).alias("odd"), T.is_patient_story(c).alias("story"))


@register()
def strip_citations(spark, d):
    once = _docs(spark, d).select("doc_id", F.explode(F.array(T.without_citations(F.col("text")))).alias("t"))  # evaluated once, not at each use
    return once.select("doc_id", T.without_bibliography(F.col("t")).alias("clean"))


@register()
def mojibake_repaired(spark, d):
    return _docs(spark, d).select("doc_id", T.repaired(F.col("text")).alias("text"))


@register("SELECT doc_id, text AS sound, text AS damaged FROM documents")
def texts_redecoded(spark, d):
    """Texts as they are, and after their UTF-8 was twice read as Latin-1."""
    twice = F.col("text")
    for _ in range(2):
        twice = F.decode(F.encode(twice, "UTF-8"), "ISO-8859-1")
    return _docs(spark, d).select("doc_id", charsets.redecoded_text(F.col("text")).alias("sound"), charsets.redecoded_text(twice).alias("damaged"))


@register("SELECT page_id, sha256(html) AS digest FROM pages")
def page_charsets(spark, d):
    """Pages written in several charsets and read again by a guess; those that Latin-1 doesn't hold go as UTF-8 there, and those that begin with a mark behind one more."""
    html = F.col("html")
    latin = F.decode(F.encode(html, "UTF-8"), "UTF-8").rlike("^[\\x00-\\x7e\\xa0-\\xff]*\\z")
    marked = F.when(F.startswith(html, F.lit("\ufeff")), F.concat(F.lit("\ufeff"), html)).otherwise(html)
    raw = F.when(F.col("page_id") % 4 == 0, F.encode(html, "UTF-16")).when(F.col("page_id") % 4 == 1, F.encode(marked, "UTF-16LE"))
    raw = raw.when((F.col("page_id") % 4 == 2) & latin, F.encode(F.when(latin, html), "ISO-8859-1")).otherwise(F.encode(marked, "UTF-8"))
    return parquet(spark, d, "pages").select("page_id", F.sha2(charsets.decoded(raw), 256).alias("digest"))


@register("SELECT doc_id, CASE WHEN lower(trim(coalesce(text, ''))) IN ('', 'none', 'nan', 'null', '[]', '{}') THEN '[EMPTY]' ELSE trim(text) END AS text FROM documents")
def sanitize_text(spark, d):
    return _docs(spark, d).select("doc_id", T.sanitized(F.col("text")).alias("text"))


@register(rf"SELECT CAST(doc_id AS VARCHAR) AS id, text AS document, lang, source FROM documents WHERE NOT (length(trim(text)) < 50 OR regexp_matches(trim(text), '{T.INDEX_CAPTION}'))")
def index_rows(spark, d):
    out = Q.index_rows(_docs(spark, d), "doc_id", "text")
    return out.select("id", "document", F.get_json_object("metadata", "$.lang").alias("lang"), F.get_json_object("metadata", "$.source").alias("source"))


@register("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return parquet(spark, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@register("WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS u, CAST(embedding AS DOUBLE[])[2:] || [CAST(embedding[1] AS DOUBLE)] AS v FROM embeddings), c AS (SELECT vec_id, list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))) AS c FROM a) SELECT vec_id, round(c, 6) AS cos_sim, round(sqrt(greatest(2 - 2 * c, 0)), 4) AS l2_dist FROM c")
def vector_diff(spark, d):
    e = parquet(spark, d, "embeddings")
    turned = e.select("vec_id", F.concat(F.slice("embedding", F.lit(2), F.size("embedding") - 1), F.slice("embedding", 1, 1)).alias("embedding"))
    return V.difference(e, turned, "vec_id")


@register("""WITH d AS (SELECT row_number() OVER () - 1 AS position, doc_id, lang FROM documents), e AS (SELECT row_number() OVER () - 1 AS position, vec_id, label FROM embeddings)
SELECT position, doc_id, lang, vec_id, label FROM d JOIN e USING (position)""")
def positional_join(spark, d):
    docs, vectors = (P.parquet_rows(spark, f"{d}/{t}.parquet") for t in ("documents", "embeddings"))
    return P.joined(docs.select("position", "doc_id", "lang"), vectors.select("position", "vec_id", "label"), policy="truncate")


@register("""WITH d AS (SELECT row_number() OVER () - 1 AS position, doc_id FROM documents), l AS (SELECT row_number() OVER () - 1 AS position, doc_id AS labelled FROM labels), b AS (SELECT * FROM d FULL JOIN l USING (position))
SELECT count(*) AS rows, count(*) FILTER (doc_id = labelled) AS matched, count(*) FILTER (labelled IS NULL) AS left_only, count(*) FILTER (doc_id IS NULL) AS right_only, min(position) FILTER (doc_id <> labelled) AS first_mismatch FROM b""")
def position_mismatches(spark, d):
    docs, labels = (P.parquet_rows(spark, f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return P.mismatches(docs, labels, "doc_id", "doc_id")


@register("SELECT count(*) FILTER (d.doc_id IS NOT NULL AND e.vec_id IS NOT NULL) AS matched, count(*) FILTER (e.vec_id IS NULL) AS rows_without_vector, count(*) FILTER (d.doc_id IS NULL) AS vectors_without_row FROM documents d FULL JOIN embeddings e ON e.vec_id = d.doc_id")
def alignment_check(spark, d):
    return V.alignment(_docs(spark, d), parquet(spark, d, "embeddings"), "doc_id", "vec_id")


@register("SELECT user_id AS id, event_type AS topic, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def edit_log_lww(spark, d):
    return G.last_edits(parquet(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select(F.col("user_id").alias("id"), F.col("event_type").alias("topic"), "event_id")


@register("SELECT id, topic, event_id FROM (SELECT user_id AS id, event_type AS topic, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND topic <> 'error'")
def edit_log_state(spark, d):
    rows = parquet(spark, d, "events").select(F.col("user_id").alias("id"), "ts", "event_id", F.col("event_type").alias("topic"), (F.col("event_type") == "error").alias("gone"))
    log = EditLog(spark, work_folder(spark, "edits"), "id long, ts timestamp, event_id long, topic string, gone boolean", order=("ts", "event_id"), deleted="gone", every=2)
    for n, part in enumerate((2, 0, 3, 1, 4)):  # in any order: many of a batch's records are late
        log.add(rows.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == part), n)
    return log.current().select("id", "topic", "event_id")


@register("SELECT b.item_id AS id, b.text AS question, coalesce(e.event_type, 'none') AS topic FROM benchmark b LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) e ON e.user_id = b.item_id AND e.n = 1")
def gold_merge(spark, d):
    gold = parquet(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.lit("none").alias("topic"))
    return G.merged(gold, edit_log_lww(spark, d).select("id", "topic"), ["topic"])


@register("SELECT item_id AS id FROM benchmark WHERE regexp_matches(text, '(?i)the|de')")
def gold_search(spark, d):
    gold = parquet(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    return G.searched(gold, "the|de").select("id")


@register("SELECT item_id AS id FROM benchmark ORDER BY item_id LIMIT 10 OFFSET 10")
def gold_page(spark, d):
    return G.page(parquet(spark, d, "benchmark").select(F.col("item_id").alias("id")), ["id"], 10, 2)


@register("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def facets(spark, d):
    return _docs(spark, d).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT DISTINCT * FROM (SELECT 'lang' AS facet, coalesce(lang, '') AS value FROM documents WHERE trim(coalesce(lang, '')) <> '' UNION ALL SELECT 'source', coalesce(source, '') FROM documents) ORDER BY ALL")
def facet_values(spark, d):
    return Q.facet_values(_docs(spark, d), ["lang", "source"], with_empty=("source",))


@register("SELECT count(*) AS rows, count(*) FILTER (lower(trim(coalesce(text, ''))) IN ('', 'none', 'nan', 'null', '[]', '{}')) AS empty FROM documents")
def empty_count(spark, d):
    return Q.empty_count(_docs(spark, d), "text")


@register(rf"SELECT doc_id, source, lang FROM documents WHERE regexp_matches(substr(trim(text), 1, 80), '{T.ODD_NUMBERS}') ORDER BY doc_id LIMIT 25")
def odd_head(spark, d):
    return Q.odd_head(_docs(spark, d), "text", ["doc_id"]).select("doc_id", "source", "lang")


@register("SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS name, unnest([CAST(doc_id AS VARCHAR), substr(text, 1, 120), lang, source, CAST(n_chars AS VARCHAR)]) AS value FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 1)")
def first_row(spark, d):
    return Q.preview(_docs(spark, d), ["doc_id"])


@register("SELECT doc_id, n_chars FROM documents WHERE source = 'src1' ORDER BY n_chars, doc_id")
def article_chunks(spark, d):
    return G.of_article(_docs(spark, d), "source", "src1", ["n_chars", "doc_id"]).select("doc_id", "n_chars")


@register("WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS u, CAST(embedding AS DOUBLE[])[2:] || [CAST(embedding[1] AS DOUBLE)] AS v FROM embeddings), c AS (SELECT vec_id, list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))) AS c FROM a) SELECT vec_id, round(c, 6) AS cos_sim, round(sqrt(greatest(2 - 2 * c, 0)), 4) AS l2_dist FROM c ORDER BY 2, 1")
def diff_sorted(spark, d):
    return vector_diff(spark, d).orderBy("cos_sim", "vec_id")


@register(r"SELECT page_id, NOT regexp_matches(url, '(?i)/(feed|wp-admin|wp-includes|wp-content)/') AS wanted, contains(lower(substr(html, 1, 1024)), '<html') OR contains(lower(substr(html, 1, 1024)), '<!doctype html') AS is_html FROM pages")
def page_discovery(spark, d):
    return parquet(spark, d, "pages").select("page_id", (~F.col("url").rlike(H.SKIPPED_PATHS)).alias("wanted"), H.sniffed(F.col("html")).alias("is_html"))


@register(r"SELECT page_id, sha256(url) AS article_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM pages")
def page_meta(spark, d):
    return parquet(spark, d, "pages").select("page_id", F.sha2("url", 256).alias("article_id"), H.page_title(F.col("html")).alias("title"))


@register()
def page_blocks(spark, d):
    return H.blocks(parquet(spark, d, "pages")).select("page_id", "pos", "tag", "text", F.size("images").alias("n_images"))


@register("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def metadata_lookup(spark, d):
    return _docs(spark, d).join(parquet(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


def _stand_in():
    """In a model's place: the length of a prompt and its last letter."""
    return lambda prompts: [f" {len(p)} {p[-1:]} " for p in prompts]


@register("SELECT doc_id, trim(length('About: ' || coalesce(text, '')) || ' ' || right('About: ' || coalesce(text, ''), 1)) AS reply FROM documents")
def replies_kept(spark, d):
    docs, path = _docs(spark, d), work_folder(spark, "replies")
    prompt = F.concat(F.lit("About: "), T.text_of(F.col("text")))
    for some in (docs.where("lang = 'en'"), docs):  # the second run asks for what the first one hasn't
        out = M.replies(some, prompt, M.Memo(spark, path, "stand-in"), _stand_in)
    return out.select("doc_id", "reply")


@register("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(avg(value), 8) AS mean FROM events GROUP BY ALL")
def session_log(spark, d):
    return parquet(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 8).alias("mean"))


@register()
def page_sections(spark, d):
    return A.sections(H.blocks(parquet(spark, d, "pages"))).select("page_id", "pos", "tag", "section", "part", "in_refs")


@register()
def page_runs(spark, d):
    return A.runs(H.blocks(parquet(spark, d, "pages")), 20).select("page_id", "section", "text", F.size("images").alias("n_images"))


@register()
def page_articles(spark, d):
    pages = parquet(spark, d, "pages")
    return A.articles(pages, H.blocks(pages))


@register()
def page_chunks(spark, d):
    pages = parquet(spark, d, "pages")
    return A.page_chunks(pages, H.blocks(pages), 20, CUES)


@register()
def hard_capped(spark, d):
    once = _docs(spark, d).select("doc_id", F.explode(F.array(T.sentences(F.col("text")))).alias("s"))
    return once.select("doc_id", F.posexplode(C.hard_capped(F.col("s"), 128)).alias("pos", "piece"))


CLAUSE = r"string_split(regexp_replace(regexp_replace({0}, '([:;,—)-])\s+', '\1' || chr(1), 'g'), '(\.)\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))"


@register(rf"WITH s AS (SELECT doc_id, unnest({SENTENCES.format('text')}) AS s, generate_subscripts({SENTENCES.format('text')}, 1) - 1 AS pos FROM documents) SELECT doc_id, CAST(pos AS INT) AS pos, array_to_string(list_filter(list_transform({CLAUSE.format('s')}, lambda x: trim(x)), lambda x: x <> ''), '|') AS clauses FROM s")
def clauses(spark, d):
    each = _docs(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    return each.select("doc_id", "pos", F.array_join(T.clauses(F.col("s")), "|").alias("clauses"))


@register(r"SELECT doc_id, trim(regexp_replace(coalesce(source, '') || ' · ' || coalesce(lang, ''), '^[ ·]+|[ ·]+$', '', 'g')) AS header, CASE WHEN length(text) > 800 THEN substr(text, 1, 800) || ' …' ELSE coalesce(text, '') END AS snippet, replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;') AS escaped FROM documents")
def display_fields(spark, d):
    return _docs(spark, d).select("doc_id", T.header(F.col("source"), F.col("lang")).alias("header"), T.snippet(F.col("text")).alias("snippet"), T.html_escaped(F.col("text")).alias("escaped"))


@register(f"WITH w AS (SELECT {WORDS.format('text')} AS w FROM documents) SELECT count(*) AS chunks, round(avg(w), 4) AS avg_words, CAST(min(w) AS INT) AS min_words, CAST(max(w) AS INT) AS max_words, round(avg(floor(w / 0.75)), 4) AS avg_tokens FROM w")
def length_summary(spark, d):
    rows = _docs(spark, d).select(T.word_count(F.col("text")).alias("w"), T.chunk_tokens(F.col("text")).alias("t"))
    return rows.agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("w"), 4).alias("avg_words"), F.min("w").alias("min_words"), F.max("w").alias("max_words"), F.round(F.avg("t"), 4).alias("avg_tokens"))


@register("SELECT vec_id, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) > 0 AS usable, round(list_aggregate(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / greatest(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-12)), 'max'), 6) AS largest FROM embeddings")
def normalized_vectors(spark, d):
    rows = parquet(spark, d, "embeddings").select("vec_id", F.explode(F.array(V.normalized(F.col("embedding")))).alias("v"), (V.norm(F.col("embedding")) > 0).alias("usable"))
    return rows.select("vec_id", "usable", F.round(F.array_max("v"), 6).alias("largest"))


@register(f"WITH {KNN} SELECT k.query_id, k.rank, k.id, round(1 - k.dist, 6) AS similarity, d.source, coalesce(l.quality, -1) AS quality, CASE WHEN length(d.text) > 120 THEN substr(d.text, 1, 120) || ' …' ELSE d.text END AS snippet FROM k JOIN documents d ON d.doc_id = k.id LEFT JOIN labels l ON l.doc_id = k.id WHERE k.rank <= 5")
def retrieval_console(spark, d):
    return R.console(_hits(spark, d).where("rank <= 5"), _docs(spark, d).select(F.col("doc_id").alias("id"), "source", "text"), parquet(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality"), most=120)


RERANK = POOL + """,
r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY flat_pos) AS i, count(*) OVER (PARTITION BY query_id, source) AS n FROM p),
r2 AS (SELECT query_id, source, max(CASE WHEN id % 13 = 5 THEN 1 ELSE 0 END) AS broken FROM p GROUP BY ALL),
r3 AS (SELECT r1.*, CASE WHEN broken = 1 THEN dist ELSE 1 - least(greatest(CAST(id % 12 AS DOUBLE), 0), 10) / 10 END AS d FROM r1 JOIN r2 USING (query_id, source))
SELECT query_id, id, round(d, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY d, i) AS m FROM r3) WHERE m <= 10"""


@register(f"WITH {RERANK}")
def reranked(spark, d):
    """Replies as a scorer would give them, from the candidates' ids; some can't be read."""
    items = R.pooled(_items(spark, d))
    score = F.when(F.col("id") % 13 == 5, F.lit("n/a")).otherwise((F.col("id") % 12).cast("string"))
    replies = items.groupBy("query_id", "source").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("flat_pos", score.alias("s")))), lambda x: x["s"]), ","), F.lit(",0")).alias("reply"))
    return R.reranked(items, replies).select("query_id", "id", F.round("dist", 6).alias("dist"))


LETTERS = {"T": "Treatment", "D": "Diagnosis", "B": "Background"}


@register("SELECT conv_id, turn, coalesce(nullif(substr(upper(trim(coalesce(text, ''))), 1, 1), ''), 'D') AS letter, CASE coalesce(nullif(substr(upper(trim(coalesce(text, ''))), 1, 1), ''), 'D') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LETTERS.items()) + " ELSE 'Unknown' END AS category FROM conversations")
def categories(spark, d):
    letter = T.category_letter(F.col("text"))
    return parquet(spark, d, "conversations").select("conv_id", "turn", letter.alias("letter"), T.category_name(letter, LETTERS).alias("category"))


@register("SELECT l_orderkey, l_linenumber, CASE WHEN regexp_full_match(x, '-?\\d+') THEN CAST(x AS INT) ELSE -1 END AS idx FROM (SELECT *, regexp_replace(CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE l_discount END AS VARCHAR), '\\.0$', '') AS x FROM lineitem)")
def chunk_index_cast(spark, d):
    value = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(F.col("l_discount"))
    return parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.plain_index(value).alias("idx"))


IDS = "i AS (SELECT c.conv_id AS key, c.turn AS pos, c.conv_id * 5 + c.turn AS id, e.label AS idx FROM conversations c LEFT JOIN (SELECT * FROM embeddings WHERE label < 7) e ON e.vec_id = c.conv_id * 5 + c.turn)"


@register(f"WITH {IDS} SELECT key, string_agg(CAST(id AS VARCHAR), ',' ORDER BY idx IS NULL, coalesce(idx, 0), pos) AS ids FROM i GROUP BY key")
def ids_by_index(spark, d):
    ids = parquet(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), (F.col("conv_id") * 5 + F.col("turn")).alias("id"))
    index = parquet(spark, d, "embeddings").where("label < 7").select(F.col("vec_id").alias("id"), F.col("label").alias("idx"))
    return G.ordered_by_index(ids, index).select("key", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


IDSETS = "s AS (SELECT conv_id AS key, list(turn ORDER BY turn) AS cur, list(turn ORDER BY turn) FILTER (role = 'user') AS pick, list(turn ORDER BY turn) FILTER (turn % 2 = 0) AS own FROM conversations GROUP BY conv_id)"


@register(f"WITH {IDSETS}, f AS (SELECT key, cur, own, coalesce(pick, []) AS pick FROM s) SELECT key, array_to_string(pick || list_filter(own, lambda x: NOT list_contains(pick, x)), ',') AS added, array_to_string(list_filter(cur, lambda x: NOT list_contains(pick, x)), ',') AS removed, array_to_string(pick || list_filter(cur, lambda x: NOT list_contains(own, x)), ',') AS saved FROM f")
def id_list_edits(spark, d):
    turns = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("turn"))))
    s = parquet(spark, d, "conversations").groupBy("conv_id").agg(turns(F.lit(True)).alias("cur"), turns(F.col("role") == "user").alias("pick"), turns(F.col("turn") % 2 == 0).alias("own"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    cur, pick, own = F.col("cur"), F.col("pick"), F.col("own")
    return s.select(F.col("conv_id").alias("key"), text(G.added(pick, own)).alias("added"), text(G.removed(cur, pick)).alias("removed"), text(G.saved(pick, cur, own)).alias("saved"))


MEMORY = HISTORY + """,
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 10),
w AS (SELECT *, pow(0.65, count(*) OVER (PARTITION BY conv_id) - 1 - i) AS weight FROM t WHERE trim(coalesce(text, '')) <> ''),
s AS (SELECT w.*, round(sim * weight * 0.30, 6) AS s FROM w JOIN hv ON hv.conv_id = w.conv_id AND hv.turn = w.turn),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, turn) AS INT) AS m FROM s),
g AS (SELECT query_id, avg(1 - dist) AS c FROM k WHERE rank <= 5 GROUP BY query_id),
mm AS (SELECT r.conv_id AS query_id, m AS pos, 'memory_' || m AS source, CAST(-1 AS BIGINT) AS id, round(1 - s + 0.20, 6) AS dist FROM r JOIN g ON g.query_id = r.conv_id WHERE m <= 2 AND c < 0.99)"""


@register(f"WITH {ITEMS}, {MEMORY} SELECT query_id, pos, source, id, dist FROM mm UNION ALL SELECT query_id, CAST(pos + coalesce((SELECT max(pos) FROM mm WHERE mm.query_id = i.query_id), 0) AS INT), source, id, dist FROM i")
def gated_memory(spark, d):
    """Memory before the corpus, for questions whose confidence is low."""
    ranked = R.ranked_memory(_turns(spark, d), F.col("similarity")).withColumnRenamed("conv_id", "query_id")
    memory = R.gated(ranked, R.confidence(_hits(spark, d)), 0.99).select("query_id", F.col("memory_rank").alias("pos"), F.concat(F.lit("memory_"), "memory_rank").alias("source"), "dist")
    return R.with_memory(_items(spark, d), memory).select("query_id", F.col("pos").cast("int").alias("pos"), "source", F.coalesce("id", F.lit(-1)).cast("bigint").alias("id"), "dist")


@register(f"WITH {KNN} SELECT query_id, '{{\"query_id\":' || query_id || ',\"hits\":[' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) || ']}}' AS trace FROM k GROUP BY query_id")
def trace_json(spark, d):
    return R.traces(_hits(spark, d))


@register("SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) AS BIGINT) AS number, trim(text) AS question, coalesce(CAST(d.first AS VARCHAR), '') AS first_id, coalesce(d.n, 0) AS n_ids FROM benchmark b LEFT JOIN (SELECT conv_id, min(turn) AS first, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id) d ON d.conv_id = b.item_id")
def question_table(spark, d):
    ids = parquet(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("ids"))
    gold = parquet(spark, d, "benchmark").join(ids, F.col("item_id") == F.col("conv_id"), "left")
    return G.question_table(gold, "item_id", "text", "ids")


@register("SELECT user_id, count(*) AS edits FROM events WHERE user_id IN (SELECT item_id FROM benchmark) GROUP BY user_id")
def known_edits(spark, d):
    known = parquet(spark, d, "benchmark").select(F.col("item_id").alias("user_id"))
    return parquet(spark, d, "events").join(known, "user_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("edits"))


@register("SELECT DISTINCT ON (k) k AS article_id, text FROM (SELECT coalesce(CAST(l.doc_id AS VARCHAR), d.source) AS k, d.text, d.doc_id AS line FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) ORDER BY k, line DESC")
def article_metadata(spark, d):
    rows = _docs(spark, d).join(parquet(spark, d, "labels").select("doc_id", F.col("doc_id").cast("string").alias("article_id")), "doc_id", "left")
    return Q.last_by_id(rows.withColumnRenamed("source", "id"), "doc_id").select("article_id", "text")


@register("SELECT doc_id FROM documents WHERE lower(trim(coalesce(text, ''))) IN ('', 'none', 'nan', 'null', '[]', '{}') OR doc_id % 7 = 0")
def empty_texts(spark, d):
    """Rows that an encoder sees as empty; every seventh text is made one of the spellings of nothing."""
    blank = F.element_at(F.array(F.lit(" None "), F.lit("[]"), F.lit("nan"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = _docs(spark, d).withColumn("text", F.when(F.col("doc_id") % 7 == 0, blank).otherwise(F.col("text")))
    return Q.empty_texts(rows, "text").select("doc_id")


@register(f"SELECT CAST(doc_id AS VARCHAR) AS chunk_id, coalesce(lang, '') AS section, coalesce(source, '') AS source, coalesce(text, '') AS text, CAST({WORDS.format('text')} AS INT) AS n_words, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS INT) ELSE -1 END AS idx FROM documents")
def chunk_view(spark, d):
    index = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(".0"))).otherwise(F.lit("x"))
    return Q.chunk_view(_docs(spark, d).withColumn("i", index), "doc_id", "lang", "source", "i")


def _gold(spark, d) -> DataFrame:
    rows = parquet(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.concat(F.lit("t"), (F.col("item_id") % 3).cast("string")).alias("topic"), F.concat(F.lit("b"), (F.col("item_id") % 4).cast("string")).alias("bucket"))
    return rows


@register("SELECT item_id AS id FROM benchmark WHERE item_id % 3 = 1 AND item_id % 4 IN (0, 2) AND regexp_matches(text, '(?i)A|e')")
def gold_filters(spark, d):
    return G.searched(_gold(spark, d), "a|E", "t1", ["b0", "b2"]).select("id")


@register("SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN coalesce(k.topic, '') ELSE 't' || item_id % 3 END AS topic, coalesce(k.bucket, '') AS bucket FROM benchmark LEFT JOIN (SELECT trim(text) AS q, min('auto' || item_id % 5) AS topic, min('bucket') AS bucket FROM benchmark WHERE item_id % 2 = 0 GROUP BY trim(text)) k ON k.q = trim(text)")
def auto_topics(spark, d):
    known = parquet(spark, d, "benchmark").where("item_id % 2 = 0").select(F.col("text").alias("question"), F.concat(F.lit("auto"), (F.col("item_id") % 5).cast("string")).alias("topic"), F.lit("bucket").alias("bucket"))
    gold = _gold(spark, d).withColumns({"topic": F.when(F.col("id") % 3 == 0, " ").otherwise(F.col("topic")), "bucket": F.lit(None).cast("string")})
    return G.with_topics(gold, known).select("id", "topic", "bucket")


@register("SELECT DISTINCT conv_id AS key, conv_id * 5 + turn AS id FROM conversations WHERE conv_id * 5 + turn NOT IN (SELECT vec_id FROM embeddings WHERE label < 7)")
def dangling_ids(spark, d):
    ids = parquet(spark, d, "conversations").select(F.col("conv_id").alias("key"), (F.col("conv_id") * 5 + F.col("turn")).alias("id"))
    return G.dangling(ids, parquet(spark, d, "embeddings").where("label < 7").select(F.col("vec_id").alias("id")))


@register("WITH i AS (SELECT c.conv_id AS key, c.conv_id * 5 + c.turn AS id, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS o, c.turn AS pos, e.label AS idx FROM conversations c LEFT JOIN (SELECT * FROM embeddings WHERE label < 7) e ON e.vec_id = c.conv_id * 5 + c.turn) SELECT key, string_agg(CAST(id AS VARCHAR), ',' ORDER BY idx IS NULL, coalesce(idx, 0), o, pos) AS ids FROM i GROUP BY key")
def ids_added_in_order(spark, d):
    ids = parquet(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), (F.col("conv_id") * 5 + F.col("turn")).alias("id"), "role")
    index = parquet(spark, d, "embeddings").where("label < 7").select(F.col("vec_id").alias("id"), F.col("label").alias("idx"))
    out = G.added_in_order(ids.where("role <> 'user' or role is null").drop("role"), ids.drop("role"), index)
    return out.select("key", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@register(f"WITH RECURSIVE {_pick_sql(10000)}, l AS (SELECT query_id, source || ' — ' || section AS citation, max_by(text, pick_pos) AS t FROM c GROUP BY ALL) SELECT query_id, citation, substr(t, 1, 200) AS preview FROM l UNION ALL SELECT DISTINCT query_id, 'nowhere' AS citation, 'No preview available.' AS preview FROM c")
def citation_previews(spark, d):
    context = _picked(spark, d)
    labels = R.citations(context).select("query_id", F.explode(F.concat(F.split("citations", "\n"), F.array(F.lit("nowhere")))).alias("citation"))
    return R.citation_previews(labels, context)


@register("SELECT doc_id, doc_id % 4 = 0 OR doc_id % 4 = 1 AS has_image, CASE WHEN doc_id % 4 = 0 THEN CAST(length(source) AS INT) ELSE 0 END AS caption_len FROM documents")
def image_flags(spark, d):
    as_json = F.to_json(F.array(F.struct(F.lit("x.png").alias("src"), F.col("source").alias("image_text"))))
    column = F.element_at(F.array(as_json, F.lit('[{"src": "y"}]'), F.lit("[]"), F.lit("no json")), (F.col("doc_id") % 4 + 1).cast("int"))
    return _docs(spark, d).select("doc_id", H.image_flags(column).alias("f")).select("doc_id", "f.has_image", "f.caption_len")


@register(f"SELECT doc_id, CAST(round_even({WORDS.format('text')} * 1.33, 0) AS INT) AS tokens, array_to_string(list_transform([lang, source], lambda x: coalesce(x, 'None')), ', ') AS value, CASE WHEN contains(text, chr(10)) THEN substr(string_split(text, chr(10))[1], 1, 120) || chr(10) || substr(string_split(text, chr(10))[2], 1, 120) ELSE substr(coalesce(text, ''), 1, 120) END AS lines FROM documents")
def display_values(spark, d):
    return _docs(spark, d).select("doc_id", T.words_to_tokens(T.word_count(F.col("text"))).alias("tokens"), T.metadata_value(F.array("lang", "source"), "array<string>").alias("value"), T.two_lines(F.col("text")).alias("lines"))


@register(f"WITH {KNN} SELECT query_id, id, rank, CAST(rank AS INT) AS pos, dist FROM k")
def unbiased(spark, d):
    return R.unbiased(_hits(spark, d)).select("query_id", "id", "rank", "pos", "dist")


@register("SELECT count(*) AS documents, count(DISTINCT source) AS sources, (SELECT count(*) FROM embeddings) AS vectors FROM documents")
def collection_counts(spark, d):
    n = parquet(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("vectors"))
    return _docs(spark, d).agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("source").alias("sources")).join(F.broadcast(n), F.lit(True))  # one row each


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _found.items() if s}
