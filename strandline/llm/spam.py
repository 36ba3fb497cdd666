"""Keyword-stuffed pages, link lists and product tags among documents.

Every text is cut into stretches of about 300 characters. Of each stretch, features of density (marks, links), entropy,
repetition and function words are taken, all turned so that spam lies upward; no word, domain or phrase is built in. What the
function words of a language are is learnt: the short words that most documents tagged with it have. Per language, medians and
median deviations over all stretches centre and scale the features, and the spatial sign covariance gives their scatter; none
of the three is moved by a minority of spam. A stretch is an outlier if its robust Mahalanobis distance is large, and a spam
one if its offset also points toward spam: away from prose, and toward repetition, marks, links or the lack of sentences. A
document is spam if such stretches make up more than half of its characters. Nothing else decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import stretches as T
from strandline.session import written

FEATURES = T.FEATURES
#: A language's words are those that at least this part of its documents have: the most frequent ones, up to a number.
COMMON_PART, WORDS, FUNCTION_WORDS = 0.1, 400, 60
#: Documents that a tag needs, and part of all documents, to count as a language. Others are held against the nearest one.
LEAST_DOCUMENTS, LEAST_PART = 10, 0.0005
#: Least part of a text's words that are words of a language for it to be told by them and not by its tag.
TOLD = 0.15
#: Words that a stretch needs to take part in the statistics.
LEAST_WORDS = 20
#: Words (links: characters) of a typical stretch that are added to each, so that a short one can't lie far out by chance.
PRIOR = np.array([6.0] * 7 + [30.0])
#: Least scale of each feature, so that one that hardly varies can't explode.
FLOOR = np.array([0.08, 0.08, 0.03, 0.1, 0.03, 0.03, 0.03, 0.08])
#: Part of the identity mixed into the scatter.
SHRINK = 0.2
#: Distance beyond which a stretch is an outlier.
FAR = 5.0
#: How much each of the first four features says that a stretch isn't prose, how much of one counts, and the least offset that way.
AWAY, ENOUGH, LEAST_AWAY = np.array([1.0, 1.5, 1.0, 1.0]), 3.0, 0.0
#: Least offset toward repetition, sameness, marks or links, or toward the lack of sentences.
LEAST_TOWARD = 1.5

_TAG = re.compile(r"[a-z]{2,3}(?=$|[-_])")
# Tags that name no language.
_NONE = {"und", "mul", "mis", "zxx"}


def primary(tag: str | None) -> str:
    """The language that a tag names, or ``und``."""
    m = _TAG.match((tag or "").strip().lower())
    return m[0] if m and m[0] not in _NONE else "und"


class Languages(NamedTuple):
    names: list[str]
    documents: list[int]
    words: np.ndarray  # hashes, sorted
    known: np.ndarray  # of each language: which of these are its words (one more, never known, at the end)
    function: np.ndarray  # and which its function words


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of each tag each word stands; a null word counts the documents. Bounded tables are handed on."""
    tags: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    names = ["tag", "word", "short", "n"]

    def folded() -> pa.RecordBatch:
        t, h, s = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((h, t))
        t, h, s = t[order], h[order], s[order]
        new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])]))
        of = np.array(list(tags), object)[t[new]]
        return pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(h[new].view(np.int64)), pa.array(s[new]), pa.array(np.diff(np.append(new, len(t))).astype(np.int64))], names)

    for b in batches:
        tag = np.array([tags.setdefault(primary(x), len(tags)) for x in b.column(0).to_pylist()], np.int64)
        some = np.array([bool(n) for n in pc.utf8_length(b.column(1)).to_pylist()], bool)
        kinds, n = np.unique(tag[some], return_counts=True)
        of = np.array(list(tags), object)[kinds]
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.nulls(len(of), pa.int64()), pa.array(np.zeros(len(of), bool)), pa.array(n.astype(np.int64))], names)
        going, seen = -1, np.zeros(0, np.uint64)
        for block in T.blocks(b.column(1)):
            w = T.words(*block)
            part, h, short = T.per_text(w)
            row = w.rows[part]
            if w.rows[0] == going:  # a long text goes on: words met before don't count again
                fresh = (row != going) | ~np.isin(h, seen)
                row, h, short = row[fresh], h[fresh], short[fresh]
            mine = h[row == w.rows[-1]]
            going, seen = w.rows[-1], np.concatenate([seen, mine]) if w.rows[-1] == going else mine
            held.append((tag[row], h, short))
            if sum(len(x[1]) for x in held) > 2_000_000:
                yield folded()
                held.clear()
    if held:
        yield folded()


def languages(df: DataFrame, text: str, tag: str | None) -> Languages:
    """The languages that tags name, their words and their function words, from all documents.

    What comes to the driver is bounded: a document has a limited number of distinct words on average, and only words that a
    tenth of a language's documents have are taken.
    """
    lang = df[tag] if tag else F.lit(None).cast("string")
    counted = df.select(lang.alias("tag"), df[text].alias("text")).mapInArrow(_counter, "tag string, word bigint, short boolean, n bigint")
    counts = written(counted.groupBy("tag", "word").agg(F.max("short").alias("short"), F.sum("n").alias("n")), "words")
    documents = {r.tag: r.n for r in counts.where("word is null").collect()}
    least = max(LEAST_DOCUMENTS, LEAST_PART * sum(documents.values()))
    names = sorted((t for t, n in documents.items() if n >= least and t != "und"), key=lambda t: (-documents[t], t)) or [t for t in documents if t == "und" or len(documents) == 1]
    if not names:
        names = sorted(documents, key=lambda t: (-documents[t], t))[:1]
    bar = F.create_map(*[F.lit(x) for t in names for x in (t, float(max(2, COMMON_PART * documents[t])))]) if names else None
    rows = counts.where(F.col("word").isNotNull() & (F.col("n") >= bar[F.col("tag")])).collect() if names else []
    pools = [sorted((r for r in rows if r.tag == t), key=lambda r: (-r.n, r.word)) for t in names]
    kept = [p[:WORDS] for p in pools]
    function = [[r for r in p if r.short][:FUNCTION_WORDS] for p in pools]
    words = np.unique(np.array([r.word for p in (*kept, *function) for r in p], np.int64).view(np.uint64))
    tables = np.zeros((2, max(len(names), 1), len(words) + 1), bool)
    for k, lists in enumerate((kept, function)):
        for i, p in enumerate(lists):
            tables[k, i, np.searchsorted(words, np.array([r.word for r in p], np.int64).view(np.uint64))] = True
    return Languages(names or ["und"], [documents.get(t, 0) for t in names] or [0], words, tables[0], tables[1])


def _tell(la: Languages, w: T.Words, tagged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language of each part, and whether each word is a function word of it."""
    n = len(w.begin)
    at = np.searchsorted(la.words, w.hash)
    at[(at == len(la.words)) | (la.words[np.minimum(at, len(la.words) - 1)] != w.hash if len(la.words) else True)] = len(la.words)
    hit = at < len(la.words)
    part, word = w.part[hit], at[hit]
    cover = np.stack([np.bincount(part[k[word]], minlength=n) for k in la.known]) / np.maximum(np.bincount(w.part, minlength=n), 1)
    most = cover.max(0)
    language = np.where(most >= TOLD, (cover >= 0.9 * most).argmax(0), tagged)  # languages stand in order of size
    return language, la.function[language[w.part], at]


_RATES = ", ".join(f"{f} array<float>" for f in FEATURES)


def _measurer(la: Languages):
    names = ["key", "language", "n_words", "n_chars", *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {t: i for i, t in enumerate(la.names)}
        for b in batches:
            tagged = np.array([index.get(primary(x), 0) for x in b.column(1).to_pylist()], np.int64)
            rows, tables = [], []
            for block in T.blocks(b.column(2)):
                w = T.words(*block)
                language, common = _tell(la, w, tagged[w.rows])
                s = T.counted(w, common)
                rows.append(w.rows[s.part])
                tables.append(np.column_stack([language[s.part], s.n_words, s.n_chars, s.counts]).astype(np.float32))
            row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            table = np.concatenate(tables) if tables else np.zeros((0, 3 + len(FEATURES)), np.float32)
            offsets = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            columns = [pa.array(table[:, 0].astype(np.int32)), *[pa.array(np.ascontiguousarray(table[:, i])) for i in range(1, table.shape[1])]]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.ListArray.from_arrays(offsets, c) for c in columns]], names)

    return run


def measured(df: DataFrame, key: str, text: str, tag: str | None, la: Languages) -> DataFrame:
    """key and, of every stretch of its text, language, words, characters and counts. Null and empty texts have no stretches."""
    kind = df.select(key).schema[0].dataType.simpleString()
    lang = df[tag] if tag else F.lit(None).cast("string")
    return df.select(df[key].alias("key"), lang.alias("tag"), df[text].alias("text")).mapInArrow(_measurer(la), f"key {kind}, language array<int>, n_words array<float>, n_chars array<float>, {_RATES}")


def _table(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language, words, characters and counts of all stretches of a batch."""
    flat = [b[n].flatten().to_numpy(zero_copy_only=False) for n in ("language", "n_words", "n_chars", *FEATURES)]
    return flat[0], flat[1].astype(float), flat[2].astype(float), np.column_stack(flat[3:]).astype(float)


def _sizes(n_words: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    return np.column_stack([n_words] * (len(FEATURES) - 1) + [n_chars])


#: Steps of a rate in the tables of counts from which medians are read, and the greatest rate told apart.
STEP, MOST = 0.0005, 2.0


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many stretches of each language have which rate of each feature: a bounded table for each partition."""
    bins = int(MOST / STEP) + 1
    counts: dict[int, np.ndarray] = {}
    for b in batches:
        language, n, chars, c = _table(b)
        r = np.minimum(c / np.maximum(_sizes(n, chars), 1), MOST)
        for k in np.unique(language):
            at = (language == k) & (n >= LEAST_WORDS)
            counts.setdefault(int(k), np.zeros((len(FEATURES), bins), np.int64))
            for f in range(len(FEATURES)):
                counts[int(k)][f] += np.bincount((r[at, f] / STEP + 0.5).astype(np.int64), minlength=bins)
    for k, v in counts.items():
        f, at = np.nonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), k, np.int32)), pa.array(f.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(v[f, at])], ["language", "feature", "rate", "n"])


Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def _signs(centres: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Sums of the products of spatial signs: one row for each language and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            language, n, chars, c = _table(b)
            r = c / np.maximum(_sizes(n, chars), 1)
            for k, (centre, scale) in centres.items():
                z = (r[(language == k) & (n >= LEAST_WORDS)] - centre) / scale
                u = z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]
                sums[k] = sums.get(k, 0) + np.append((u.T @ u).ravel(), len(u))
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], ["language", "sums"])

    return run


def _middle(values: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    run = np.cumsum(n[order])
    return float(values[order][np.searchsorted(run, run[-1] / 2)])


def robust_models(features: DataFrame, n_languages: int) -> dict[int, Model]:
    """Centre, scale and inverse scatter of each language, from all stretches of enough words; -1 stands for all languages.

    Tables of counts, whose size is bounded by the number of languages, are all that comes to the driver.
    """
    # one row a language, feature and step of a rate, however many stretches there are
    rows = features.mapInArrow(_histogram, "language int, feature int, rate int, n bigint").groupBy("language", "feature", "rate").agg(F.sum("n").alias("n")).toArrow()
    if not rows.num_rows:
        return {}
    language, feature, rate, n = (rows[c].to_numpy() for c in ("language", "feature", "rate", "n"))
    found = {}
    for k in (-1, *range(n_languages)):
        mine = (language == k) | (k < 0)
        if n[mine & (feature == 0)].sum() < LEAST_DOCUMENTS and k >= 0:
            continue
        centre, scale = np.zeros(len(FEATURES)), np.zeros(len(FEATURES))
        for f in range(len(FEATURES)):
            at = mine & (feature == f)
            value = rate[at] * STEP
            centre[f] = _middle(value, n[at])
            scale[f] = max(1.4826 * _middle(np.abs(value - centre[f]), n[at]), FLOOR[f])
        found[k] = (centre, scale)
    sums = features.mapInArrow(_signs({k: v for k, v in found.items() if k >= 0}), "language int, sums array<double>").collect()
    models = {}
    for k, (centre, scale) in found.items():
        total = sum((np.array(r.sums) for r in sums if r.language == k or k < 0), np.zeros(len(FEATURES) ** 2 + 1))
        m = total[:-1].reshape(len(FEATURES), -1) / max(total[-1], 1) * len(FEATURES)
        models[k] = (centre, scale, np.linalg.inv((1 - SHRINK) * m + SHRINK * np.eye(len(FEATURES))))
    return models


def offsets(n_words: np.ndarray, n_chars: np.ndarray, counts: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Offset of each stretch in scales of its language, and its robust Mahalanobis distance."""
    centre, scale, inverse = model
    z = ((counts + PRIOR * centre) / (_sizes(n_words, n_chars) + PRIOR) - centre) / scale
    return z, np.sqrt(np.maximum(np.einsum("ni,ij,nj->n", z, inverse, z), 0))


def spamward(z: np.ndarray) -> np.ndarray:
    """Whether offsets point away from prose and toward repetition, sameness, marks, links or the lack of sentences."""
    away = np.minimum(z[:, :4], ENOUGH) @ AWAY / np.sqrt((AWAY**2).sum())
    return (away > LEAST_AWAY) & (np.maximum(z[:, 4:].max(1), z[:, 2]) > LEAST_TOWARD)


def _judge(models: dict[int, Model], far: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            language, n, chars, c = _table(b)
            distance, hit = np.zeros(len(n)), np.zeros(len(n), bool)
            for k in np.unique(language):
                at = language == k
                z, distance[at] = offsets(n[at], chars[at], c[at], models.get(int(k), models.get(-1)))
                hit[at] = (distance[at] > far) & spamward(z)
            size = pc.list_value_length(b["language"]).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), size)
            total = np.maximum(np.bincount(row, chars, b.num_rows), 1)
            share = np.bincount(row, chars * hit, b.num_rows) / total
            mean = np.bincount(row, chars * distance, b.num_rows) / total
            first = np.searchsorted(row, np.arange(b.num_rows))
            of = np.where(size > 0, language[np.minimum(first, max(len(language) - 1, 0))] if len(language) else 0, -1)
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(of.astype(np.int32)), pa.array(share), pa.array(mean)], ["key", "language", "share", "distance"])

    return run


def judged(df: DataFrame, key: str, text: str, tag: str | None = None, *, far: float = FAR) -> DataFrame:
    """key, language, share of characters in spam stretches, and mean distance of the stretches, of every row."""
    la = languages(df, text, tag)
    features = written(measured(df, key, text, tag, la), "spam")
    models = robust_models(features, len(la.names))
    kind = features.select("key").schema[0].dataType.simpleString()
    zero = (np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.eye(len(FEATURES)))
    out = features.mapInArrow(_judge(models or {-1: zero}, far if models else np.inf), f"key {kind}, language int, share double, distance double")
    names = F.array(*[F.lit(t) for t in la.names])
    return out.select("key", F.when(F.col("language") >= 0, F.get(names, F.col("language"))).alias("language"), "share", "distance")


def spam_pages(df: DataFrame, key: str, text: str, tag: str | None = None, *, share: float = 0.5, far: float = FAR) -> DataFrame:
    """Keys of the rows more than ``share`` of whose characters lie in stretches far out toward spam.

    ``tag`` names a column that tells the language; tags may be wrong, as a text's own words come first. Null, empty and blank
    texts are never found. Repeated rows each give their own; an empty table gives none. Whole texts are read, a text of more
    than a million characters in parts, and all statistics come from all rows.
    """
    return judged(df, key, text, tag, far=far).where(F.col("share") > share).select(F.col("key").alias(key))
