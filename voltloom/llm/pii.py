"""Personal data by a linear-chain conditional random field over word shapes.

Words are runs of characters other than white space. One that could hold personal data (an @, four digits, two
colons) is split at the punctuation and the unspaced scripts (Chinese, Japanese, Thai and others) within it, as in
JSON, CSV, URLs and logs; each part is a word then, and findings don't reach across parts. Whole stay thousands,
dates, times and colon addresses. In parts of over LONG_PART characters, digits joined to letters by a hyphen, point,
underscore or plus part from them. A word's features are its shape (letters x and X, digits d,
runs collapsed), its shape with the lengths of digit runs, its number of digits, its kinds of characters, and the gist of
its shape, in which letters and digits that alternate are one m and what repeats stands once, so that words of any length
have known features; those of the words before and after it count too. Labels are O and, for each kind, B (first word) and I (further words).
The model is trained from LABELLED, a small table of made-up examples (none occurs in the test tables) whose digits
and letters are drawn afresh, among ordinary words and numbers. Decoding is Viterbi, in numpy batches.

Most words need no search: where a word's score for O exceeds every other label's, whatever its neighbours, by more
than any transitions can give back, the best path has O there. That cuts a text exactly into short stretches; the
result is that of Viterbi over the whole text (tests compare the two).

Defined results: null, empty and blank texts have no finding; repeated rows are searched each; equal scores go to
the label that comes first in LABELS. Places count characters from 0 and leave out punctuation at the edges.
`redact` keeps every row and column, whatever the names; null texts stay null. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from voltloom.llm._shared import WordIds, documents, only, pieces, slices
from voltloom.llm.langid import marginals

#: kind and example; digits and letters stand for any digits and letters of their case.
LABELLED = [
    *[("EMAIL", x) for x in ("ann.lee@mail.example.com", "bob@corp.example.org", "kim.42@mail7.example.com", "j_doe-9@uni.example.edu", "sales+eu@shop.example.co.uk", "x1y2@host3.net", "María.Pérez@correo.example.es", "ro.71@post3.example.com", "øy.08@post1.example.com", "USER@EXAMPLE.COM")],
    *[("PHONE", x) for x in ("+1 (212) 555-0142", "+1 (646) 555-0187", "(415) 555-2671", "415-555-2671", "415.555.2671", "+1-415-555-2671", "+14155552671", "+44 20 7946 0958", "+49 30 9018 2034", "+33 1 42 68 53 00", "+34 912 345 678", "4155552671", "+1 415 555 2671", "555-2671")],
    *[("CARD", x) for x in ("4556737586899855", "4111 1111 1111 1111", "5500-0000-0000-0004", "378282246310005", "6011000990139424", "4532 7153 3790 1241", "4222222222222")],
    *[("IP", x) for x in ("172.31.40.9", "10.0.0.7", "192.168.1.254", "9.120.44.203", "81.40.17.6", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1ff:fe23:4567:890a")],
    *[("SSN", x) for x in ("078-05-1120", "219-09-9999", "457-55-5462")],
    *[("IBAN", x) for x in ("DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "FR1420041010050500013M02606", "ES91 2100 0418 4502 0005 1332")],
]
#: What is no personal data although it has digits or signs.
ORDINARY = ("2024", "1998", "7", "42", "350", "12,500", "3.14", "99.9%", "$45.00", "€1,200", "10:30", "2024-05-17", "2024-05-17T10:30:00Z", "2024-05-17T10:30", "10:30:45", "17/05/2024", "05.11.2023", "v2.3.1", "2.10.4", "1st", "20th", "B12", "x86", "covid-19", "3x4", "(2019)", "[12]", "#17", "100km", "1/2", "5-6", "1234567", "A4", "10,000,000", "0.5", "1e-3", "chapter-3", "5d41402abc4b2a76b9719d911017c592", "2fd4e1c67a2d28fced849ee1bb76e7391b93eb12", "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709", "AF5570F5A1810B7AF78CAF4BC70A660F0D", "http://example.com/a1", "www.example.org", "item_12", "=", "-", "|", "&", "+", "and/or", "e.g.", "U.S.", "@home", "foo()", "key=value", "12.5", "1.2", "192.5")
PLAIN = "the of and in is that for it was on are as with be at by this the and der die und von mit la de que el en un le les des est pour Thing Anther Monday HELLO WORLD él año straße où ça état co-op mother-in-law l'eau don't end. stop, why? yes! (see) \"quoted\" 'so' (well), «oui» -- *** what?! end... BIG!! | token name: value;".split()
KINDS = tuple(dict.fromkeys(k for k, _ in LABELLED))
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
EDGE = ".,;:!?#$%&*|\"'<>[]{}=`~^"
CAP = 4.0
LONG_PART = 64
_SCRIPTS = "\u0e00-\u0e4f\u0e5a-\u0ecf\u0eda-\u0f1f\u0f34-\u103f\u1780-\u17df\u3000-\u9fff\uac00-\ud7af\uf900-\ufaff\uff01-\uff0a\uff0c\uff1a-\uff1f\uff3b-\uff40\uff5b-\uff9f\U0001f000-\U0001faff\U00020000-\U0003ffff"
_MARKS = r"\"<>{}\[\]|=&;?\\`#*^~!$"
_JOINT = re.compile(rf"[{_MARKS},:/'(){_SCRIPTS}]")
_PART = re.compile(
    rf"""\d{{4}}-\d\d-\d\d[T_]\d\d:[\d:.]+Z?(?!\w) | \d{{1,2}}/\d{{1,2}}/\d{{2,4}}(?![\d/]) | (?:[0-9A-Fa-f]{{0,4}}:){{2,7}}[0-9A-Fa-f]{{0,4}}(?![\w:]) | \d{{1,2}}:\d\d(?![\w.:-])
    | [{_SCRIPTS}]+
    | (?: [^{_MARKS},:/'(){_SCRIPTS}] | \(\d+\) | (?<=[^\W\d])'(?=[^\W\d])
        | (?:(?<=(?<![\d.-])\d)|(?<=(?<![\d.-])\d\d)|(?<=(?<![\d.-])\d\d\d)|(?<=,\d\d\d)),(?=\d{{3}}(?![\w-])(?!\.\d+\.)) )+""".replace("#", r"\#"),
    re.X,
)
_SEAM = re.compile(r"(?<=[^\W\d])[-_.+]+(?=[\d(])|(?<=\d)[-_.+]+(?=[^\W\d])")
_LOUD = re.compile(r"@|(?:\d\D*?){4}|:[^:]*:")
_RUN = re.compile(r"d+|x+|X+")
_MIXED = re.compile(r"[dxX]*(?:d[xX]|[xX]d)[dxX]*")
_AGAIN = re.compile(r"(.{1,3}?)\1+")


class _Shape(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        s = self[code] = "d" if c.isdigit() else "X" if c.isupper() or c.istitle() else "x" if c.isalpha() else c
        return s


_SHAPE = _Shape()


def parts(word: str) -> list[tuple[int, str]]:
    """(place, part) of a word that is split; empty for one that stays whole."""
    core = word.strip(EDGE)
    if not (len(core) > LONG_PART or _JOINT.search(core)) or not _LOUD.search(core):
        return []
    out = []
    first = word.index(core)
    for m in _PART.finditer(word, first, first + len(core)):
        at = m.start()
        if m.end() - at > LONG_PART and "@" not in m[0]:
            for seam in _SEAM.finditer(word, at, m.end()):
                out.append((at, word[at : seam.start()]))
                at = seam.end()
        out.append((at, word[at : m.end()]))
    return out if len(out) != 1 or len(out[0][1]) < len(core) else []


def shapes(word: str) -> tuple[str, str, str, str, str]:
    """Collapsed shape, shape with the lengths of digit runs, number of digits, kinds of characters, gist of the shape."""
    core = word.strip(EDGE)
    s = core.translate(_SHAPE)
    short = _RUN.sub(lambda m: m[0][0], s)
    long = _RUN.sub(lambda m: f"d{len(m[0])}" if m[0][0] == "d" else m[0][0], s)
    digits = s.count("d")
    kinds = ("d" * bool(digits)) + ("x" * ("x" in s)) + ("X" * ("X" in s)) + ("@" * ("@" in s)) + ("." * ("." in s)) + (":" * (s.count(":") > 1)) + ("-" * ("-" in s)) + ("+" * s.startswith("+")) + ("(" * s.startswith("("))
    gist = _AGAIN.sub(r"\1+", _MIXED.sub("m", short).replace("X", "x").replace("xx", "x"))
    return short, long, str(digits), kinds + ("=" * (digits == len(s) > 0)), gist


def quiet(shape: str) -> bool:
    """True for shapes without digits and the signs of addresses and numbers."""
    return not ("d" in shape or "@" in shape or "+" in shape or shape.count(":") > 1)


class Model:
    """Weights of features by place (own, before, after), and transitions."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, trans: np.ndarray) -> None:
        self.index, self.weights, self.trans = index, weights, trans
        k = len(LABELS)
        # what neighbours without digits and signs can at most take from O against each label
        self.context = np.zeros(k)
        for kind in ("P0=", "P1=", "N0=", "N1="):
            own = [i for f, i in index.items() if f.startswith(kind) and quiet(f[3:])]
            if own:
                self.context += np.minimum(0, (weights[own, :1] - weights[own]).min(0))
        t = trans
        gain = (t[:, :, None] + t[None, :, :]).transpose(1, 0, 2) - (t[:, 0][:, None] + t[0][None, :])[None]
        one_in = (t - t[:, :1]).max(0)
        one_out = (t - t[:1, :]).max(1)
        self.swing = np.maximum.reduce([gain.max((1, 2)), one_in, one_out, np.zeros(k)])

    def vectors(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Scores that each word gives its own place, the place after it and the place before it; whether it is quiet; whether it is O among quiet neighbours."""
        k = len(LABELS)
        out = [np.zeros((len(words), k), np.float32) for _ in range(3)]
        calm = np.zeros(len(words), bool)
        get, w = self.index.get, self.weights
        cache: dict[tuple, tuple] = {}
        for n, word in enumerate(words):
            s = shapes(word)
            v = cache.get(s)
            if v is None:
                own = [get(f"{p}{i}={x}") for p in "C" for i, x in enumerate(s)]
                v = cache[s] = (sum((w[i] for i in own if i is not None), w[0]), *(sum((w[i] for i in (get(f"{p}0={s[0]}"), get(f"{p}1={s[1]}")) if i is not None), np.zeros(k)) for p in "PN"))
            out[0][n], out[1][n], out[2][n] = v
            calm[n] = quiet(s[0])
        margin = out[0][:, :1] - out[0] + self.context - self.swing
        return (*out, calm, calm & (margin[:, 1:] > 1e-3).all(1))


def names(word: str) -> list[str]:
    s = shapes(word)
    return [f"C{i}={x}" for i, x in enumerate(s)] + [f"{p}{i}={s[i]}" for p in "PN" for i in (0, 1)]


def table(seed: int = 11, sequences: int = 1200, length: int = 16) -> tuple[list[list[str]], np.ndarray]:
    """Sequences of words and their labels, drawn from the labelled examples and from ordinary words."""
    rng = np.random.default_rng(seed)
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def vary(x: str, hexed: bool = False) -> str:
        return "".join(str(rng.integers(10)) if c.isdigit() else lower[rng.integers(26)] if c in lower and not hexed else upper[rng.integers(26)] if c in upper and not hexed else c for c in x)

    def address() -> str:
        """An e-mail address of random build: parts of letters, of digits, or of both; half of them of letters only."""
        made, plain = [], rng.random() < 0.5
        for marks, most in (("._-+", 8), (".", 6)):
            kinds = [0 if plain or marks == "." else rng.integers(4) for _ in range(rng.integers(1 + (marks == "."), most))]
            parts_ = ["".join(str(rng.integers(10)) if k == 1 or (k == 2 and n % 2) else lower[rng.integers(26)] for n in range(rng.integers(1, 13))) for k in kinds]
            made.append(parts_[0] + "".join(marks[rng.integers(len(marks))] + x for x in parts_[1:]))
        return "@".join(made)

    words, gold = [], np.zeros((sequences, length), np.int64)
    for s in range(sequences):
        own: list[str] = []
        y: list[int] = []
        while len(own) < length:
            r = rng.random()
            if r < 0.16:
                kind, x = LABELLED[rng.integers(len(LABELLED))]
                if kind == "IP" and "." in x:
                    x = ".".join(str(rng.integers(256)) for _ in range(4))
                elif kind == "EMAIL" and rng.random() < 0.8:
                    x = address()
                else:
                    x = vary(x, hexed=kind in ("IP", "IBAN"))
                got = x.split()
                if rng.random() < 0.3:
                    got[-1] += (".", ",", "!", "?", ";", ":")[rng.integers(6)]
                b = LABELS.index(f"B-{kind}")
                y += [b] + [b + 1] * (len(got) - 1)
                own += got
            elif r < 0.3:
                x = ORDINARY[rng.integers(len(ORDINARY))]
                own.append(vary(x, hexed=len(x) > 20 or x[10:11] == "T"))
                y.append(0)
            else:
                own.append(PLAIN[rng.integers(len(PLAIN))])
                y.append(0)
        words.append(own[:length])
        gold[s] = y[:length]
    return words, gold


_trained: dict[int, Model] = {}


def train(seed: int = 11, steps: int = 120) -> Model:
    if seed in _trained:
        return _trained[seed]
    seqs, gold = table(seed)
    s, length = gold.shape
    k = len(LABELS)
    vocab = {w: n for n, w in enumerate(dict.fromkeys(w for q in seqs for w in q))}
    index: dict[str, int] = {"bias": 0}
    feats = []
    for w in vocab:
        feats.append([0] + [index.setdefault(f, len(index)) for f in names(w)])
    own, before, after = (np.array([f[:6] for f in feats]), np.array([f[6:8] for f in feats]), np.array([f[8:10] for f in feats]))
    x = np.array([vocab[w] for q in seqs for w in q]).reshape(s, length)
    w, t = np.zeros((len(index), k)), np.zeros((k, k))
    m = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    pairs = np.zeros((k, k))
    np.add.at(pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    for step in range(1, steps + 1):
        e = w[own].sum(1)[x]
        e[:, 1:] += w[before].sum(1)[x[:, :-1]]
        e[:, :-1] += w[after].sum(1)[x[:, 1:]]
        post, pair = marginals(e, t)
        post[np.arange(s)[:, None], np.arange(length), gold] -= 1
        gw = np.zeros_like(w)
        for f, place, d in ((own, x, post), (before, x[:, :-1], post[:, 1:]), (after, x[:, 1:], post[:, :-1])):
            by = np.stack([np.bincount(place.ravel(), d[:, :, j].ravel(), len(vocab)) for j in range(k)], 1)
            for c in range(f.shape[1]):
                gw += np.stack([np.bincount(f[:, c], by[:, j], len(index)) for j in range(k)], 1)
        gw = gw / s + 2e-5 * w
        gt = (pair - pairs) / s + 2e-5 * t
        for p, g, a, b in ((w, gw, m[0], m[1]), (t, gt, m[2], m[3])):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p -= 0.12 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        np.clip(t, -CAP, CAP, out=t)
    _trained[seed] = Model(index, w, t)
    return _trained[seed]


def viterbi(e: np.ndarray, lens: np.ndarray, trans: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Best labels of sequences laid end to end in e (words, labels).

    left, right: whether the word before the first, and after the last, is there and labelled O. All
    sequences go side by side, longest first.
    """
    if not len(e):
        return np.zeros(0, np.int64)
    order = np.argsort(-lens, kind="stable")
    size, begin = lens[order], (np.cumsum(lens) - lens)[order]
    going = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0])), side="right")
    v = e[begin] + np.where(left[order, None], trans[0], 0)
    back = []
    for i in range(1, len(going)):
        n = going[i]
        c = v[:n, :, None] + trans
        best = c.argmax(1)
        back.append(best)
        v[:n] = np.take_along_axis(c, best[:, None], 1)[:, 0] + e[begin[:n] + i]
    v = v + np.where(right[order, None], trans[:, 0], 0)
    now = v.argmax(1)
    out = np.empty(len(e), np.int64)
    for i in range(len(going) - 1, -1, -1):
        n = going[i]
        out[begin[:n] + i] = now[:n]
        if i:
            now[:n] = back[i - 1][np.arange(n), now[:n]]
    return out


class Tagger:
    def __init__(self, model: Model) -> None:
        self.model, self.ids = model, WordIds()
        self.own, self.before, self.after = (np.zeros((0, len(LABELS)), np.float32) for _ in range(3))
        self.calm, self.sure = np.zeros(0, bool), np.zeros(0, bool)
        self.split: dict[int, list[str]] = {}  # by number, the words that are split

    def labels(self, texts: list[str | None], prune: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(Label of every word of every text, number of words of each text); a word that is split counts by its parts."""
        found, lens = [], np.zeros(len(texts), np.int64)
        for j, text in enumerate(texts):
            for piece in pieces(text or ""):
                w = piece.split()
                lens[j] += len(w)
                found.append(np.fromiter(map(self.ids.__getitem__, w), np.int32, len(w)))
        x = np.concatenate(found) if found else np.zeros(0, np.int32)
        for word in self.ids.fresh:
            if own := parts(word):
                self.split[self.ids[word]] = [w for _, w in own]
        if self.split:
            x, lens = self.apart(x, lens)
        fresh = self.model.vectors(self.ids.fresh)
        self.own, self.before, self.after, self.calm, self.sure = (np.concatenate([a, b]) for a, b in zip((self.own, self.before, self.after, self.calm, self.sure), fresh))
        y = np.zeros(len(x), np.int64)
        first = np.zeros(len(x) + 1, bool)  # of its text; one more place for the end
        first[np.append(0, np.cumsum(lens))] = True
        calm = np.concatenate([[True], self.calm[x], [True]])  # where texts meet, a neighbour that isn't there is at worst not calm
        open_ = np.flatnonzero(~(self.sure[x] & calm[:-2] & calm[2:])) if prune else np.arange(len(x))
        if len(open_):
            e = self.own[x[open_]].astype(np.float64)
            has = ~first[open_]
            e[has] += self.before[x[open_[has] - 1]]
            has = ~first[open_ + 1]
            e[has] += self.after[x[open_[has] + 1]]
            new = np.append(True, (np.diff(open_) > 1) | first[open_[1:]])
            start = np.flatnonzero(new)
            n = np.diff(np.append(start, len(open_)))
            begin, end = open_[start], open_[start + n - 1]
            y[open_] = viterbi(e, n, self.model.trans, ~first[begin], ~first[end + 1])
        stay = self.ids.settle()
        self.split = {n: w for n, w in self.split.items() if n < stay}
        self.own, self.before, self.after, self.calm, self.sure = self.own[:stay], self.before[:stay], self.after[:stay], self.calm[:stay], self.sure[:stay]
        return y, lens

    def apart(self, x: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of words, and how many each text has, with words that are split replaced by their parts."""
        where = np.flatnonzero(np.isin(x, np.fromiter(self.split, np.int32, len(self.split))))
        own = {n: np.array([self.ids[w] for w in self.split[n]], np.int32) for n in np.unique(x[where]).tolist()}
        size = np.ones(len(x), np.int64)
        size[where] = [len(own[n]) for n in x[where].tolist()]
        ends = np.append(0, np.cumsum(size))
        out = np.repeat(x, size)
        for k in where.tolist():
            out[ends[k] : ends[k + 1]] = own[int(x[k])]
        return out, np.diff(ends[np.append(0, np.cumsum(lens))])

    def spans(self, texts: list[str | None]) -> list[tuple[int, str, int, int]]:
        """(text, kind, start, end) of everything found."""
        y, lens = self.labels(texts)
        ends = np.cumsum(lens)
        out = []
        hits = np.flatnonzero(y)
        owner = np.searchsorted(ends, hits, side="right")
        for j in np.unique(owner):
            text, base = texts[j], ends[j] - lens[j]
            own = hits[owner == j] - base
            places = token_places(text, own)
            last = None
            for p in own.tolist():
                label = int(y[base + p]) - 1
                kind, a, b = label >> 1, *places[p]
                if last and label & 1 and last[0] == kind and last[3] == p - 1 and _SPACE.search(text, last[2], a):
                    last[2], last[3] = b, p
                else:
                    if last:
                        out.append((int(j), KINDS[last[0]], last[1], last[2]))
                    last = [kind, a, b, p]
            if last:
                out.append((int(j), KINDS[last[0]], last[1], last[2]))
        return out


def token_places(text: str, wanted: np.ndarray) -> dict[int, tuple[int, int]]:
    """Start and end, without punctuation at the edges, of the wanted words."""
    need, out = set(wanted.tolist()), {}
    n, most = 0, int(wanted[-1])
    for m in _TOKEN.finditer(text):
        for at, word in parts(m[0]) or [(0, m[0])]:
            if n in need:
                a = m.start() + at + len(word) - len(word.lstrip(EDGE))
                out[n] = (a, max(a, m.start() + at + len(word.rstrip(EDGE))))
            n += 1
        if n > most:
            break
    return out


#: What str.split() splits at, as a pattern.
_TOKEN = re.compile(r"[^\s\x1c-\x1f\x85\xa0]+")
_SPACE = re.compile(r"[\s\x1c-\x1f\x85\xa0]")


def findings(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start_at, end_at) of everything found."""
    model = model or train()
    memo = docs.sparkSession.sparkContext.broadcast((model.index, model.weights, model.trans))  # of the size of the examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(Model(*memo.value))
        for whole in batches:
            for part in slices(whole):
                cols = list(zip(*tagger.spans(part.column("text").to_pylist()))) or [()] * 4
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["doc_id", "kind", "start_at", "end_at"])

    source = only(docs, id_col, text_col)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, kind string, start_at long, end_at long")


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """docs with everything found replaced by its kind in brackets; all rows and columns stay."""
    model = model or train()
    memo = docs.sparkSession.sparkContext.broadcast((model.index, model.weights, model.trans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(Model(*memo.value))
        for whole in batches:
            for part in slices(whole, text_col):
                k = part.schema.get_field_index(text_col)
                texts = part.column(k).to_pylist()
                for j, kind, a, b in reversed(tagger.spans(texts)):
                    texts[j] = texts[j][:a] + f"[{kind}]" + texts[j][b:]
                yield pa.RecordBatch.from_arrays([pa.array(texts, part.schema.field(k).type) if i == k else part.column(i) for i in range(part.num_columns)], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(documents(spark, sf_dir))
