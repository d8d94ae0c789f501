"""Quality rules: base counts of whole texts, and a linear-chain CRF that marks each line as content or boilerplate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SLICE_BYTES, _BYTES, _hash_block, _spans, ngrams, row_firsts, text_slices, words

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW, CONTENT_SHARE = 20, 30, 8, 0.5
#: Labelled rows of each label that the CRF learns from: whole texts, as many as have so many lines.
TRAIN_ROWS, TRAIN_LINES = 1500, 60_000
#: Lines in a run: longer texts are learned as several runs.
RUN = 64
N_FEATURES = 18

_ALL = np.arange(256)
_SYMBOL = np.isin(_ALL, list(b"#*$%&|<>"))
_UPPER = (_ALL >= 65) & (_ALL <= 90)
_LETTER = _UPPER | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128)
_DIGIT = (_ALL >= 48) & (_ALL <= 57)
_POINT = (_ALL & 0xC0) != 0x80
_SHOUT = _ALL == 33
_END = np.isin(_ALL, list(b".!?:\"'"))


def _line_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of lines, taken some lines at a time, so that a long text needs no large table of powers."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
        lo, hi = starts[at], ends[end - 1]
        out.append(_hash_block(buf[lo:hi], starts[at:end] - lo, ends[at:end] - lo, _BYTES))
        at = end
    return np.concatenate(out)


@dataclass
class Lines:
    """The lines with a word of some rows: row, number of words, features; and the rows' base counts."""

    row: np.ndarray
    n_words: np.ndarray
    features: np.ndarray
    base: np.ndarray  # rows x (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)


def lines_of(buf: np.ndarray, offsets: np.ndarray) -> Lines:
    n = len(offsets) - 1
    h, rows, starts, ends = words(buf, offsets, spans=True)
    firsts = row_firsts(rows, n)
    base = np.zeros((n, 5), np.int64)
    base[:, 0] = np.diff(firsts)
    total = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    points = total(_POINT[buf])
    chars = total(points[ends] - points[starts])
    base[:, 1] = chars[firsts[1:]] - chars[firsts[:-1]]
    symbols = total(_SYMBOL[buf])
    base[:, 2] = symbols[offsets[1:]] - symbols[offsets[:-1]]

    g, first = ngrams(h, rows, REPEAT_WINDOW)
    if len(g):
        of = rows[first]
        order = np.lexsort((g, of))
        same = (g[order][1:] == g[order][:-1]) & (of[order][1:] == of[order][:-1])
        twice = np.zeros(len(g), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, first[twice], 1)
        np.subtract.at(edge, first[twice] + REPEAT_WINDOW, 1)
        covered = total(np.cumsum(edge[:-1]) > 0)
        base[:, 4] = covered[firsts[1:]] - covered[firsts[:-1]]

    # lines: cut at \n and at the ends of rows
    cut = np.unique(np.concatenate([np.flatnonzero(buf == 10) + 1, offsets[:-1], [0]]))
    cut = cut[cut < len(buf)] if len(buf) else cut[:0]
    at = np.searchsorted(starts, cut)
    n_words = np.diff(np.append(at, len(starts)))
    stop = np.append(cut[1:], len(buf))
    stop = stop - ((stop > cut) & (buf[np.maximum(stop, 1) - 1] == 10)) if len(cut) else stop
    some = n_words > 0
    begin, stop, n_words, word = cut[some], stop[some], n_words[some], at[some]
    row = np.searchsorted(offsets, begin, "right") - 1
    digest = _line_hashes(buf, begin, stop) if len(begin) else np.zeros(0, np.uint64)
    order = np.lexsort((begin, digest, row))
    again = np.zeros(len(begin), bool)
    again[order[1:]] = (digest[order][1:] == digest[order][:-1]) & (row[order][1:] == row[order][:-1])
    np.add.at(base[:, 3], row[again], 1)

    def share(table: np.ndarray) -> np.ndarray:
        t = total(table[buf])
        return (t[stop] - t[begin]) / np.maximum(stop - begin, 1)

    sym, up, dig, letters, shout = (share(t) for t in (_SYMBOL, _UPPER, _DIGIT, _LETTER, _SHOUT))
    last = buf[ends[word + n_words - 1] - 1] if len(word) else np.zeros(0, np.uint8)
    # words equal to the one before, in the same line
    line_of_word = np.repeat(np.arange(len(word)), n_words)
    same_word = np.zeros(len(h), np.int64)
    if len(h):
        same_word[1:] = (h[1:] == h[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    repeats = total(same_word)
    repeat = (repeats[word + n_words] - repeats[word]) / np.maximum(n_words, 1) if len(word) else np.zeros(0)
    f = np.stack(
        [
            np.ones(len(begin)), n_words <= 2, (n_words > 2) & (n_words <= 5), (n_words > 5) & (n_words <= 15), n_words > 15,
            sym > 0.02, sym > 0.06, sym > 0.15, up > 0.2 * letters, up > 0.6 * letters, dig > 0.1, dig > 0.3, shout > 0.02,
            letters < 0.6, _END[last], again, repeat > 0.1, repeat > 0.4,
        ],
        axis=1,
    ).astype(np.float32)
    return Lines(row, n_words, f, base)


@dataclass(frozen=True)
class Chain:
    """Weights of a linear-chain CRF with labels 0 boilerplate and 1 content."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def viterbi(chain: Chain, features: np.ndarray) -> np.ndarray:
    """The likeliest labels of one text's lines."""
    score = (features @ chain.emit).tolist()
    (m00, m01), (m10, m11) = chain.move.tolist()
    a, b = chain.start[0] + score[0][0], chain.start[1] + score[0][1]
    back = []
    for e0, e1 in score[1:]:
        x, y = a + m00, b + m10
        u, v = a + m01, b + m11
        back.append((x < y, u < v))
        a, b = (y if x < y else x) + e0, (v if u < v else u) + e1
    label = int(b > a)
    out = np.empty(len(score), np.int8)
    out[-1] = label
    for i in range(len(back) - 1, -1, -1):
        label = int(back[i][label])
        out[i] = label
    return out


def fit_chain(texts: list[tuple[int, np.ndarray]], rounds: int = 2, steps: int = 60) -> Chain:
    """A chain from (label of the text, features of its lines).

    Lines of good texts are content. Lines of bad texts start as boilerplate;
    after each round those that the chain takes for content are left to it, as
    bad texts hold clean lines too. Texts of more than RUN lines are learned as
    runs of that many, all of them. Gradients by forward-backward over all runs
    at once, steps by Adam.
    """
    runs = [(i, at) for i, (_, f) in enumerate(texts) for at in range(0, len(f), RUN)]
    n, most, k = len(runs), min(RUN, max(len(f) for _, f in texts)), texts[0][1].shape[1]
    x, mask, y = np.zeros((n, most, k), np.float32), np.zeros((n, most), bool), np.zeros((n, most), np.int8)
    of_text: list[list[int]] = [[] for _ in texts]
    for j, (i, at) in enumerate(runs):
        label, f = texts[i]
        part = f[at : at + RUN]
        x[j, : len(part)], mask[j, : len(part)], y[j, : len(part)] = part, True, label
        of_text[i].append(j)
    bad = [i for i, (label, _) in enumerate(texts) if label == 0]
    theta = np.zeros(2 + 4 + 2 * k)
    lines = mask.sum()
    chain = None

    def unpack(t: np.ndarray) -> Chain:
        return Chain(t[:2], t[2:6].reshape(2, 2), t[6:].reshape(k, 2))

    for _ in range(rounds):
        hot = np.stack([y == 0, y == 1], axis=2) & mask[:, :, None]
        pairs = mask[:, 1:]
        seen_move = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], float)
        seen_start = hot[:, 0].sum(axis=0).astype(float)
        seen_emit = np.einsum("nlk,nls->ks", x, hot.astype(np.float32))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            c = unpack(theta)
            e = (x @ c.emit.astype(np.float32)).astype(np.float64)
            alpha, beta = np.zeros((n, most, 2)), np.zeros((n, most, 2))
            alpha[:, 0] = c.start + e[:, 0]
            for t in range(1, most):
                new = np.logaddexp(alpha[:, t - 1, :1] + c.move[0], alpha[:, t - 1, 1:] + c.move[1]) + e[:, t]
                alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
            z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            expect_move = np.zeros((2, 2))
            for t in range(most - 2, -1, -1):
                ahead = beta[:, t + 1] + e[:, t + 1]
                both = c.move[None] + ahead[:, None, :]
                beta[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(both[:, :, 0], both[:, :, 1]), beta[:, t + 1])
                p = np.exp(alpha[:, t, :, None] + both - z[:, None, None]) * mask[:, t + 1, None, None]
                expect_move += p.sum(axis=0)
            gamma = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
            grad = np.concatenate([gamma[:, 0].sum(axis=0) - seen_start, (expect_move - seen_move).ravel(), (np.einsum("nlk,nls->ks", x, gamma.astype(np.float32)) - seen_emit).ravel()])
            grad = grad / lines + 1e-4 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta = theta - 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        chain = unpack(theta)
        for i in bad:
            found = viterbi(chain, texts[i][1])
            found = found if not found.all() else np.zeros_like(found)
            for nth, j in enumerate(of_text[i]):
                y[j, mask[j]] = found[nth * RUN : nth * RUN + RUN]
    return chain


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, hashes = batch.column("label").to_pylist(), batch.column("h").to_pylist()
        out = []
        for row, end, buf, offsets in text_slices(batch.column("text")):
            found = lines_of(buf, offsets)
            at = row_firsts(found.row, end - row)
            out += [(labels[row + i], hashes[row + i], found.features[at[i] : at[i + 1]].astype(np.uint8).tobytes()) for i in range(end - row) if at[i + 1] > at[i]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 3, (pa.int32(), pa.int64(), pa.binary()))], names=["label", "h", "features"])


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, lines: int = TRAIN_LINES) -> Chain:
    """A chain from labelled(id, label 0/1): whole texts of at most `rows` rows of each label, in the order of a hash of the id, as long as they have `lines` lines together.

    The first text of a label counts whatever its length. Without rows of both labels every line is content. Of an id's different labels the least counts.
    """
    known = labelled.where(F.col("label").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.col("label").cast("int")).alias("label"))
    one = lambda y: known.where(F.col("label") == y).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    texts = docs.select(id_col, F.col(text_col).cast("string").alias("text")).join(F.broadcast(one(0).union(one(1))), id_col).select("label", F.xxhash64(id_col).alias("h"), "text")  # 2 * rows ids at most
    got, used = [], {0: 0, 1: 0}
    for y, _, f in sorted((r[0], r[1], bytes(r[2])) for r in texts.mapInArrow(_sample_rows, "label int, h bigint, features binary").toLocalIterator()):
        n = len(f) // N_FEATURES
        if not used[y] or used[y] + n <= lines:
            got.append((y, f))
            used[y] += n
    if not all(used.values()):
        return Chain(np.zeros(2), np.zeros((2, 2)), np.tile([0.0, 1.0], (N_FEATURES, 1)))
    return fit_chain([(y, np.frombuffer(f, np.uint8).reshape(-1, N_FEATURES).astype(np.float32)) for y, f in got])


_VERDICT = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, content_share double, base_failed boolean, kept boolean"


def _verdict_columns(chain: Chain, least_share: float, text: pa.Array) -> list[pa.Array]:
    base, n_lines, content = [], [], []
    for row, end, buf, offsets in text_slices(text):
        found = lines_of(buf, offsets)
        at = row_firsts(found.row, end - row)
        base.append(found.base)
        for i in range(end - row):
            lo, hi = at[i], at[i + 1]
            n_lines.append(hi - lo)
            content.append(float((viterbi(chain, found.features[lo:hi]) * found.n_words[lo:hi]).sum() / found.n_words[lo:hi].sum()) if hi > lo else 0.0)
    b = np.concatenate(base) if base else np.zeros((0, 5), np.int64)
    share = np.array(content, float)
    failed = (b[:, 0] < MIN_WORDS) | (100 * b[:, 4] > MAX_REPEAT_PERCENT * b[:, 0])
    return [*(pa.array(b[:, i]) for i in range(5)), pa.array(n_lines, pa.int64()), pa.array(share), pa.array(failed), pa.array(~failed & (share >= least_share))]


def judge(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", least_share: float = CONTENT_SHARE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, content_share, base_failed, kept) of every row.

    A text fails the base with fewer than MIN_WORDS words, or with more than
    MAX_REPEAT_PERCENT of its words in windows of REPEAT_WINDOW words that occur
    twice in it. Viterbi decoding marks its lines; content_share is the share of
    its words in content lines, 0 without words, and must reach least_share.

    Null text: no words. Null and repeated ids are kept, each row by itself.
    Other columns are ignored. Empty table: empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _VERDICT.split(", ")]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_verdict_columns(chain, least_share, batch.column("text"))], names=names)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _VERDICT)


def keep(docs: DataFrame, chain: Chain, text_col: str = "text", least_share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of docs that judge keeps, with all their columns."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(_verdict_columns(chain, least_share, batch.column(place))[-1])

    return docs.mapInArrow(run, docs.schema)


def labels_of(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, train(docs, labels_of(spark, sf_dir)))
