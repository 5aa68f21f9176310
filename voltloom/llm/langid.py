"""Language identification of words in code-switched text by a linear-chain conditional random field.

Features of a word: its hashed affixes and character n-grams (those of ^word$ of length 2 to 4), its hashed whole, and
the lexicon's: one for each language whose lexicon has it, one for a word that no lexicon has. The lexicons are the words
of every other training text; sequences to train on come from the rest, so that lexicon features are learned on words that
may be missing there. The weight of a label at a word is the sum of its features' weights;
transitions between labels are learned. Training maximises the likelihood of sequences in which runs
of words from documents of different languages alternate. Labels come from forward-backward: every word
gets the label of greatest posterior probability, over whole documents.

Training reads TRAIN_DOCS documents, shared equally among the table's languages, LEAST_DOCS of a language at least:
different texts, copies count once, those of LEAST_CHARS to TRAIN_CHARS characters first, of longer ones the first TRAIN_CHARS.
So every language that any text with a letter has is a label, however rare it is.

Defined results: a null, empty or wordless text has no words: null language and confidence, no runs.
Rows are labelled each on its own, repeated ones too. With no labelled rows to learn from (an empty
table, or no language given) languages, counts and runs are null. Ties go to the alphabetically first language.
Other columns, whatever their names, are left out. Texts of any length are labelled whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltloom.llm._shared import WordIds, documents, grams, only, pieces, slices

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
WORD = re.compile(r"[^\W\d_]+")
#: Labelled documents that training reads of all languages and of each at least, and how many characters they should have.
TRAIN_DOCS, LEAST_DOCS, LEAST_CHARS, TRAIN_CHARS = 600, 10, 50, 20_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def entries(words: list[str], lexicons: list[set[str]]) -> np.ndarray:
    """(word, language or none): whether the language's lexicon, or at last none, has the word."""
    there = np.array([[w in x for x in lexicons] for w in words], bool).reshape(len(words), len(lexicons))
    return np.concatenate([there, ~there.any(1, keepdims=True)], 1).astype(np.float32)


class Crf:
    """labels, feature weights (BUCKETS, then languages' lexicons and none; labels), transitions (from, to), lexicons."""

    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray, lexicons: list[set[str]]) -> None:
        self.labels, self.weights, self.trans, self.lexicons = labels, weights, trans, lexicons

    def scores(self, words: list[str]) -> np.ndarray:
        f, n = grams(words, SIZES, BUCKETS)
        if not len(n):
            return np.zeros((0, len(self.labels)), np.float32)
        return np.add.reduceat(self.weights[f], np.cumsum(n) - n, axis=0) + entries(words, self.lexicons) @ self.weights[BUCKETS:]


def train(rows: list[tuple[str, str]], seed: int = 7, steps: int = 60, length: int = 32, sequences: int = 1500) -> Crf | None:
    """rows: (text, language). Sequences of `length` words switch language after runs of 3 to 20 words."""
    rng = np.random.default_rng(seed)
    texts: dict[str, list[list[str]]] = {}
    for text, lang in rows:
        if own := words_of(text):
            texts.setdefault(lang, []).append(own)
    if not texts:
        return None
    labels = sorted(texts)
    k = len(labels)
    lexicons = [{w for own in texts[lang][1::2] for w in own} for lang in labels]
    by = {lang: [w for own in texts[lang][::2] for w in own] for lang in labels}
    if k == 1:
        return Crf(labels, np.zeros((BUCKETS + 2, 1), np.float32), np.zeros((1, 1)), lexicons)
    seq, gold = [], np.empty((sequences, length), np.int64)
    at = 0
    for s in range(sequences):
        own: list[str] = []
        while len(own) < length:
            if not own or rng.random() < 0.5:
                at = int(rng.integers(k))
            pool = by[labels[at]]
            n, a = int(rng.integers(3, 21)), int(rng.integers(len(pool)))
            run = pool[a : a + n][: length - len(own)]
            gold[s, len(own) : len(own) + len(run)] = at
            own += run
        seq += own
    vocab = {w: n for n, w in enumerate(dict.fromkeys(seq))}
    x = np.array([vocab[w] for w in seq]).reshape(sequences, length)
    f, n = grams(list(vocab), SIZES, BUCKETS)
    listed = entries(list(vocab), lexicons)
    begin = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(vocab)), n)
    order = np.argsort(f, kind="stable")
    used, first = np.unique(f[order], return_index=True)
    w, t, lex = np.zeros((len(used), k)), np.zeros((k, k)), np.zeros((k + 1, k))
    local = np.searchsorted(used, f)
    m = [np.zeros_like(x) for x in (w, w, t, t, lex, lex)]
    for step in range(1, steps + 1):
        e = (np.add.reduceat(w[local], begin, axis=0) + listed @ lex)[x]
        post, pair = marginals(e, t)
        post[np.arange(sequences)[:, None], np.arange(length), gold] -= 1
        gold_pairs = np.zeros((k, k))
        np.add.at(gold_pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        per_word = np.zeros((len(vocab), k))
        for j in range(k):
            per_word[:, j] = np.bincount(x.ravel(), post[:, :, j].ravel(), len(vocab))
        gw = np.add.reduceat(per_word[owner[order]], first, axis=0) / sequences + 1e-4 * w
        gt = (pair - gold_pairs) / sequences + 1e-4 * t
        gl = listed.T @ per_word / sequences + 1e-4 * lex
        for p, g, a, b, rate in ((w, gw, m[0], m[1], 0.15), (t, gt, m[2], m[3], 0.1), (lex, gl, m[4], m[5], 0.15)):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros((BUCKETS + k + 1, k), np.float32)
    weights[used] = w
    weights[BUCKETS:] = lex
    return Crf(labels, weights, t, lexicons)


def marginals(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (sequence, place, label) and summed pair posteriors, of equally long sequences."""
    s, n, k = e.shape
    p, q = np.exp(e - e.max(2, keepdims=True)), np.exp(t - t.max())
    a, b = np.empty_like(p), np.empty_like(p)
    a[:, 0] = p[:, 0] / p[:, 0].sum(1, keepdims=True)
    for i in range(1, n):
        v = (a[:, i - 1] @ q) * p[:, i]
        a[:, i] = v / v.sum(1, keepdims=True)
    b[:, -1] = 1
    pair = np.zeros((k, k))
    for i in range(n - 1, 0, -1):
        right = b[:, i] * p[:, i]
        v = right @ q.T
        z = 1 / (a[:, i - 1] * v).sum(1)
        pair += (a[:, i - 1] * z[:, None]).T @ right * q
        b[:, i - 1] = v / v.sum(1, keepdims=True)
    g = a * b
    return g / g.sum(2, keepdims=True), pair


def forward_backward(e: np.ndarray, lens: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Posteriors of every word of sequences of any lengths, laid end to end in e (words, labels).

    Sequences run side by side, longest first, so that those still going at a place are the first ones.
    """
    k = e.shape[1]
    if not len(e):
        return np.zeros((0, k))
    order = np.argsort(-lens, kind="stable")
    size = lens[order]
    going = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0])), side="right")
    offs = np.cumsum(going) - going
    rank = np.empty(len(lens), np.int64)
    rank[order] = np.arange(len(lens))
    place = np.arange(len(e)) - np.repeat(np.cumsum(lens) - lens, lens)
    at = offs[place] + np.repeat(rank, lens)  # time-major place of each word
    p = np.empty((k, len(e)))
    p[:, at] = np.exp(e - e.max(1, keepdims=True)).T
    q = np.exp(t - t.max())
    qt = np.ascontiguousarray(q.T)
    a = np.empty_like(p)
    a[:, : going[0]] = p[:, : going[0]]
    ends = offs + going
    for i in range(1, len(going)):
        n, o, o1 = going[i], offs[i], offs[i - 1]
        v = qt @ a[:, o1 : o1 + n]
        v *= p[:, o : ends[i]]
        if i & 7 == 0:
            v /= v.sum(0)
        a[:, o : ends[i]] = v
    b = np.ones((k, int(going[0])))
    for i in range(len(going) - 1, -1, -1):
        n, o = going[i], offs[i]
        own = p[:, o : ends[i]] * b[:, :n]
        a[:, o : ends[i]] *= b[:, :n]
        if i:
            v = q @ own
            if i & 7 == 0:
                v /= v.sum(0)
            b[:, :n] = v
            b[:, n : going[i - 1]] = 1
    g = a[:, at]
    return (g / g.sum(0)).T


def sample(docs: DataFrame, lang_col: str = "lang", most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> list[tuple[str, str]]:
    """Of each language an equal share of `most` different texts, those of least text hash: the same for the same rows."""
    lang = F.col(f"`{lang_col}`").alias("l")
    n = docs.select(lang).filter("l is not null").distinct().count()
    if not n:
        return []
    quota = max(LEAST_DOCS, most // n)
    rows = docs.select(F.col("text").alias("t"), lang).filter("t is not null and l is not null").withColumn("h", F.xxhash64("t"))
    slim = rows.filter(F.col("t").rlike(r"\p{L}")).select("l", "h", F.expr(f"length(t) not between {LEAST_CHARS} and {chars}").alias("odd")).distinct()
    ranked = slim.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("odd", "h"))).filter(F.col("r") <= quota)
    found = rows.join(F.broadcast(ranked.select("l", "h")), ["l", "h"]).groupBy("l", "h").agg(F.substring(F.min("t"), 1, chars).alias("t")).collect()  # quota rows a language
    return [(r.t, r.l) for r in sorted(found, key=lambda r: (r.l, r.h))]


def label(docs: DataFrame, crf: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, confidence, n_words, n_switches, runs): every word's label, as runs of equal labels."""
    source = only(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, confidence double, n_words long, n_switches long, runs array<struct<lang:string,n:int>>"
    if crf is None:
        return source.selectExpr("doc_id", "cast(null as string) lang_pred", "cast(null as double) confidence", "cast(null as long) n_words", "cast(null as long) n_switches", "cast(null as array<struct<lang:string,n:int>>) runs")
    memo = source.sparkSession.sparkContext.broadcast((crf.labels, crf.weights.astype(np.float16), crf.trans, crf.lexicons))  # of the size of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, weights, trans, lexicons = memo.value
        model = Crf(labels, weights.astype(np.float32), trans, lexicons)
        names, k = pa.array(labels), len(labels)
        ids, table = WordIds(), np.zeros((0, k), np.float32)
        for whole in batches:
            for part in slices(whole):
                found, lens = [], np.zeros(part.num_rows, np.int64)
                for j, text in enumerate(part.column("text").to_pylist()):
                    for piece in pieces(text or ""):
                        w = words_of(piece)
                        lens[j] += len(w)
                        found.append(np.fromiter(map(ids.__getitem__, w), np.int32, len(w)))
                table = np.concatenate([table, model.scores(ids.fresh)])
                x = np.concatenate(found) if found else np.zeros(0, np.int32)
                g = forward_backward(table[x], lens[lens > 0], trans)
                table = table[: ids.settle()]
                y = g.argmax(1)
                owner = np.repeat(np.arange(len(lens)), lens)
                new = np.append(True, (y[1:] != y[:-1]) | (owner[1:] != owner[:-1])) if len(y) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                runs = np.bincount(owner[first], minlength=len(lens)) if len(first) else np.zeros(len(lens), np.int64)
                mass = np.stack([np.bincount(owner, g[:, j], len(lens)) if len(y) else np.zeros(len(lens)) for j in range(k)], 1)
                top = mass.argmax(1)
                none = lens == 0
                items = pa.StructArray.from_arrays([names.take(pa.array(y[first])), pa.array(np.diff(np.append(first, len(y))).astype(np.int32))], ["lang", "n"])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        names.take(pa.array(top, mask=none)),
                        pa.array(mass[np.arange(len(lens)), top] / np.maximum(lens, 1), mask=none),
                        pa.array(lens),
                        pa.array(np.maximum(runs - 1, 0)),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(runs)).astype(np.int32)), items),
                    ],
                    names=["doc_id", "lang_pred", "confidence", "n_words", "n_switches", "runs"],
                )

    return source.mapInArrow(run, schema)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return label(docs, train(sample(docs)))
