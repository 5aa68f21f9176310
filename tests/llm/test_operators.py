"""Every operator on odd rows and against a brute-force version or held-out rows."""

from __future__ import annotations

import itertools
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voltloom.llm import _shared, bpe, hostrules, langid, packing, pii, reshard, secrets, simhash, topk, zclass

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, a int, b int, n int, host string, rank int, text_ string, voltloom_rules string, voltloom_id int"
LONG = "The quick brown fox and the lazy dog of the house. " * 4000
SECRET = 'password = "hJ8#kd92LmQ1x"'


def frame(spark, rows):
    """rows of (doc_id, text, source); more columns with names that operators might use."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, 2, 3, "y", 4, "z", "r", 5) for i, t, s in rows], SCHEMA)


ODD = [(1, "plain words of a text that is here", "s1"), (2, None, "s1"), (3, "", None), (4, "   \n ", "s2"), (None, "a text without an id", "s2"), (5, "a repeated row of words", "s3"), (5, "a repeated row of words", "s3"), (6, LONG, "s1"), (7, "é中\U0001f600 \x00 end", None)]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def test_bpe_equals_the_public_tokenizer(spark, odd, none):
    tiktoken = pytest.importorskip("tiktoken")
    e = bpe.encoder()
    ranks = {t: n for t, n in e.v.ranks.items()}
    public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [t for _, t, _ in ODD if t is not None] + ["".join(rng.choice("abc é\n01'!") for _ in range(rng.randrange(900))) for _ in range(60)] + ["x" * 5000, "ab" * 700]
    tokens, per = e.batch(texts)
    ends = np.append(0, np.cumsum(per))
    for k, t in enumerate(texts):
        assert tokens[ends[k] : ends[k + 1]].tolist() == public.encode_ordinary(t)
    rows = bpe.encode(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r.round_trip for r in rows if r.n_tokens is not None)
    assert [r.n_tokens for r in rows if r.doc_id == 2] == [None] and [r.n_tokens for r in rows if r.doc_id == 3] == [0]
    back = sorted((r.doc_id or -1, r.text or "") for r in bpe.decode(bpe.encode(odd)).collect())
    assert back == sorted((i or -1, t or "") for i, t, _ in ODD)
    assert bpe.encode(none).count() == 0


def test_langid_on_held_out_rows(spark, small, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = docs.filter("doc_id % 2 = 0")
    out = langid.label(docs.filter("doc_id % 2 = 1"), langid.train(langid.sample(train))).join(docs.select("doc_id", "lang"), "doc_id").filter("n_words > 3")
    right, n = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 300 and right > 0.9
    crf = langid.train([("the house and the dog " * 20, "en"), ("das haus und der hund " * 20, "de")])
    rows = {(r.doc_id, k): r for k, r in enumerate(langid.label(odd, crf).collect())}
    assert len(rows) == len(ODD)
    assert all(r.lang_pred is None and r.runs == [] for (i, _), r in rows.items() if i in (2, 3, 4))
    assert sum(x.n for (i, _), r in rows.items() if i == 6 for x in r.runs) == len(langid.words_of(LONG))
    assert langid.label(none, crf).count() == 0 and langid.train(langid.sample(none)) is None
    assert {(r.lang_pred, r.n_words, r.runs) for r in langid.label(odd, None).collect()} == {(None, None, None)}


def test_langid_labels_words_of_code_switched_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    crf = langid.train(langid.sample(docs.filter("doc_id % 2 = 0")))
    held = {}
    for r in docs.filter("doc_id % 2 = 1 and n_chars > 200").select("lang", "text").collect():
        held.setdefault(r.lang, []).append(langid.words_of(r.text))
    rng = random.Random(12)
    rows, gold = [], []
    for k in range(120):
        words, langs = [], []
        for _ in range(rng.randrange(2, 7)):
            lang = rng.choice(sorted(held))
            own = rng.choice(held[lang])
            a = rng.randrange(len(own))
            own = own[a : a + rng.randrange(5, 25)]
            words += own
            langs += [lang] * len(own)
        rows.append((k, " ".join(words)))
        gold.append(langs)
    out = langid.label(spark.createDataFrame(rows, "doc_id long, text string"), crf).orderBy("doc_id").collect()
    got = [[x.lang for x in r.runs for _ in range(x.n)] for r in out]
    assert [len(g) for g in got] == [len(g) for g in gold]
    right = np.mean([a == b for g, h in zip(got, gold) for a, b in zip(g, h)])
    assert right > 0.93


def test_langid_training_raises_the_likelihood_of_its_sequences():
    rows = [("the house and the dog of this street " * 5, "en"), ("a river with that old tree " * 5, "en"), ("das haus und der hund " * 5, "de"), ("ein fluss mit dem alten baum " * 5, "de")]
    few, many = (langid.train(rows, steps=n) for n in (1, 60))
    assert few.lexicons == [{"ein", "fluss", "mit", "dem", "alten", "baum"}, {"a", "river", "with", "that", "old", "tree"}]
    words, gold = ["the", "house", "und", "der", "hund"], [1, 1, 0, 0, 0]

    def likelihood(crf):
        e = crf.scores(words).astype(float)
        path = lambda y: sum(e[i, k] for i, k in enumerate(y)) + sum(crf.trans[a, b] for a, b in zip(y, y[1:]))
        return path(gold) - np.log(sum(np.exp(path(y)) for y in itertools.product(range(2), repeat=len(words))))

    assert likelihood(many) > likelihood(few) and likelihood(many) > np.log(0.8)
    assert langid.train([("one tie", "b"), ("one tie", "a")]).labels == ["a", "b"]


def test_langid_learns_every_language_of_skewed_tables(spark):
    many = [(f"the house and the dog number {chr(97 + k % 26) * (k % 40 + 1)} of the street in the town", "en") for k in range(1500)]
    copies = [("das haus und der hund in der strasse und die stadt am fluss", "de")] * 1500
    rare = [("la casa y el perro de la calle en la ciudad grande del rio", "es"), ("ett hus", "sv"), ("le chien et la maison de la ville " * 900, "fr"), ("123 456", "xx"), (None, "yy")]
    docs = spark.createDataFrame([(k, t, l) for k, (t, l) in enumerate(many + copies + rare)], "doc_id long, text string, lang string")
    found = langid.sample(docs)
    assert len(found) == len(set(found)) and {l for _, l in found} == {"en", "de", "es", "sv", "fr"}
    assert sum(l == "de" for _, l in found) == 1 and max(len(t) for t, _ in found) == langid.TRAIN_CHARS
    assert sum(l == "en" for _, l in found) == langid.TRAIN_DOCS // 7
    crf = langid.train(found)
    assert langid.label(docs.filter("lang = 'es'"), crf).first().lang_pred == "es"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    t, lens = rng.normal(size=(3, 3)), np.array([1, 4, 2])
    e = rng.normal(size=(7, 3))
    got, at = langid.forward_backward(e, lens, t), 0
    for n in lens:
        mass = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(e[at + i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                mass[i, y] += w
        assert np.allclose(got[at : at + n], mass / mass.sum(1, keepdims=True))
        at += n


def brute_groups(sigs, most):
    """Components of all pairs at most `most` bits apart; sigs: list of (a, b)."""
    root = list(range(len(sigs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sigs)):
        for j in range(i):
            if sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(sigs[i], sigs[j])) <= most:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sigs))]


def test_simhash_groups(spark, odd, none):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(600)]
    rows, n = [], 0
    for g in range(30):
        words = [rng.choice(vocabulary) for _ in range(200)]
        for c in range(3 if g < 15 else 1):
            own = list(words)
            for _ in range(c * 3):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((n, " ".join(own), "s"))
            n += 1
    docs = frame(spark, rows)
    sigs = {r.doc_id: (r.a, r.b) for r in simhash.signatures(docs).collect()}
    brute = brute_groups([sigs[i] for i in range(n)], simhash.MOST)
    want = {(i, j) for i in range(n) for j in range(i) if brute[i] == brute[j]}
    got_rows = simhash.groups(docs).collect()
    by = {}
    for r in got_rows:
        by.setdefault(r.group_id, []).append(r.doc_id)
    got = {(i, j) for m in by.values() for i in m for j in m if i > j}
    assert got == want  # no link is lost
    apart = lambda i, j: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(sigs[i], sigs[j]))
    different = {s: i for i, s in sigs.items()}
    assert all(r.n_links == sum(0 < apart(r.doc_id, j) <= simhash.MOST for j in different.values()) for r in got_rows)
    planted = {(3 * g + i, 3 * g + j) for g in range(15) for i in range(3) for j in range(i)}
    assert len(got & planted) >= 0.95 * len(planted) and len(got - planted) <= 2
    assert sum(r.is_kept for r in got_rows) == len(by)
    rest = simhash.deduplicate(odd).collect()
    assert len(rest) == len(ODD) - 1 and sum(r.doc_id == 5 for r in rest) == 1
    assert simhash.groups(none).count() == 0 and simhash.deduplicate(none).count() == 0
    with pytest.raises(ValueError, match="13 bits"):
        simhash.groups(none, most=20)


@pytest.mark.parametrize("most", [500_000, 0])
def test_simhash_keeps_one_row_of_a_group(spark, most, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", most)
    text = "the copied text of seven other words"
    docs = frame(spark, [(7, text, "a"), (3, text, "b"), (3, text, "a"), (None, text, "c"), (None, "own text here", "c"), (8, "quite other words about some new matter", "d"), (9, "something else entirely different", None), (10, None, "e"), (10, None, "e")])
    found = []
    for source in (docs, docs.orderBy(F.desc("source"))):
        kept = simhash.deduplicate(source)
        assert kept.columns == docs.columns
        rows = kept.collect()
        found.append(sorted(map(str, rows)))
        assert sorted((r.doc_id or -1, r.text or "") for r in rows) == [(-1, "own text here"), (3, text), (8, "quite other words about some new matter"), (9, "something else entirely different"), (10, ""), (10, "")]
    assert found[0] == found[1]


def test_simhash_long_texts_vote_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    run = simhash.signatures(docs)  # what a worker runs, to be run here

    def signed(texts):
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "h": list(range(len(texts))), "text": texts})
        return [(r["a"], r["b"]) for out in run(iter([batch])) for r in out.to_pylist()]

    texts = [" ".join(f"Word{k % 2500:x} É{k}" for k in range(3000)), "!?; " * 9, " \n " * 9, None, "", "short"]
    want = signed(texts)
    assert want[2] == want[3] == want[4] == (None, None) != want[1]
    monkeypatch.setattr(simhash, "LONG", 10, raising=False)
    monkeypatch.setattr(simhash, "CHUNK", 700)
    assert signed(texts) == want
    monkeypatch.undo()
    text = " ".join(f"w{k:x}" for k in range(300_000))
    tracemalloc.start()
    try:
        signed([text])
        assert tracemalloc.get_traced_memory()[1] < 100e6  # 512 bytes for every different word were 154 MB, several times over
    finally:
        tracemalloc.stop()


def made_signatures(n):
    """Different signatures about one, near and far; and whether two of them are linked."""
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2, simhash.BITS).astype(bool)
    bits = np.array([base ^ (rng.random(simhash.BITS) < rng.choice([0.02, 0.06, 0.5])) for _ in range(n)])
    bits = np.unique(np.concatenate([bits, [base, base ^ (np.arange(simhash.BITS) % 10 == 0)]]), axis=0)
    return bits, np.packbits(bits, axis=1, bitorder="little").view(np.int64), (bits[:, None] != bits).sum(2) <= simhash.MOST


def check_links(found, sig, near):
    """found: rows (a, b, c, d, links). Links equal those of all pairs, edges are a forest in each run that connects what all pairs connect."""
    links = {}
    for x, y, _, _, k in found:
        if k:
            links[x, y] = links.get((x, y), 0) + k
    assert links == {tuple(s): int(k) - 1 for s, k in zip(sig.tolist(), near.sum(1)) if k > 1}
    place = {tuple(s): k for k, s in enumerate(sig.tolist())}
    edges = [(place[x, y], place[u, v]) for x, y, u, v, k in found if k == 0]
    assert all(near[i, j] for i, j in edges) and len(edges) <= near.sum() // 2
    want = brute_groups([tuple(s) for s in sig.tolist()], simhash.MOST)
    root = list(range(len(sig)))
    for i, j in edges:
        root = [root[i] if r == root[j] else r for r in root]
    assert len(set(zip(want, root))) == len(set(want)) == len(set(root))


@pytest.mark.parametrize("n", [30, 64, 65, 900])
def test_links_of_hot_runs_equal_brute_force(n):
    bits, sig, near = made_signatures(n)
    rows = []
    for w in range(simhash.BITS):
        s = np.searchsorted(simhash.EDGES, w, side="right") - 1
        lo, hi = simhash.EDGES[s : s + 2]
        own = bits[:, lo:hi] & (np.arange(lo, hi) != w)
        rows += [((w << 32) + int("".join(map(str, o.astype(int))), 2), a, b) for o, (a, b) in zip(own, sig.tolist())]
    key, a, b = (np.array(x, np.int64) for x in zip(*sorted(rows)))
    check_links(simhash.run_links(key, a, b, simhash.MOST).tolist(), sig, near)


@pytest.mark.parametrize("hot", [20_000, 70, 9])
def test_hot_runs_in_blocks_equal_brute_force(spark, hot):
    bits, sig, near = made_signatures(400)
    nodes = spark.createDataFrame(sig.tolist(), "a long, b long")
    check_links([tuple(r) for r in simhash.pairs(nodes, hot=hot).collect()], sig, near)


@pytest.mark.parametrize("most", [100_000, 0])
def test_host_rules(spark, odd, none, most, monkeypatch):
    monkeypatch.setattr(hostrules, "BROADCAST_HOSTS", most)
    rows = hostrules.verdicts(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r.no_words and not r.keep for r in rows if r.doc_id in (2, 3, 4))
    bad = [(i, "### $$$ %%% &&& word", "bad") for i in range(40)] + [(i, f"clean words of text {i} here", "bad") for i in (90, 91)] + [(i, f"good words of text {i}", "good") for i in range(100, 140)] + [(200, "AÉ " * 20, "good"), (201, "so so so so so so", "good")]
    out = {r.doc_id: r for r in hostrules.verdicts(frame(spark, bad)).collect()}
    assert out[0].symbols and out[200].capitals and out[201].repeats and out[90].host_rejected and not out[90].keep and out[100].keep
    rates = {"bad": 40 / 42, "good": 2 / 42}
    m, v = np.mean(list(rates.values())), np.var(list(rates.values()), ddof=1)
    s = min(1000, max(1, m * (1 - m) / v - 1))
    assert out[0].host_rate == pytest.approx((40 + s * m) / (42 + s), abs=1e-5)
    assert {r.doc_id for r in hostrules.keep(frame(spark, bad)).collect()} == set(range(100, 140))
    assert hostrules.keep(odd).columns == odd.columns and hostrules.verdicts(none).count() == 0 and hostrules.keep(none).count() == 0


def test_hosts_at_the_limit_stay(spark):
    docs = frame(spark, [(i, "words of a text" if i % 2 else "", "even") for i in range(8)])
    rows = hostrules.verdicts(docs).collect()
    assert {(r.host_rate, r.host_rejected) for r in rows} == {(0.5, False)} and hostrules.keep(docs).count() == 4


def test_languages_that_tie_go_to_the_first(spark):
    crf = langid.Crf(["de", "en"], np.zeros((langid.BUCKETS + 3, 2), np.float32), np.zeros((2, 2)), [set(), set()])
    out = langid.label(spark.createDataFrame([(1, "some words"), (1, "some words"), (2, None)], "doc_id long, text string"), crf).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.confidence, r.n_words) for r in out] == [("de", 0.5, 2), ("de", 0.5, 2), (None, None, 0)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (SECRET, 1),
        ("token: 'a8f5f167f44f4964e6c998dee827110c'", 1),
        ('k = "Zx81kd92LmQ1xPq"\napi_key = k', 1),
        ('a = "Zx81kd92"\nsecret = a + "LmQ1xPq7"', 2),
        ('{"client_secret": "q9Zk-72hHs81nAp0"}', 1),
        ("<password>gT5$wq81Lm</password>", 1),
        ('password = "changeme"', 0),
        ('password_hint = "the name of your dog"', 0),
        ('colour = "hJ8#kd92LmQ1x"', 0),
        ("the secret of it: nobody knows", 0),
        ("", 0),
        ("x = " * 5000, 0),
    ],
)
def test_secret_scan(text, found):
    got = secrets.scan(text)
    assert len(got) == found
    assert secrets.clean(text).count(secrets.MARK) == found


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('password = decrypt("hJ8#kd92LmQ1x", "utf-8")', ["hJ8#kd92LmQ1x"]),
        ('password = Secret("prod", "hJ8#kd92LmQ1x")', ["hJ8#kd92LmQ1x"]),
        ('password = wrap(read("hJ8#)kd92LmQ1x"), "utf-8")', ["hJ8#)kd92LmQ1x"]),
        ('secret = load(\n  "' + "aB3$xZ9q" * 700 + '",\n  "utf-8")\n' + LONG, ["aB3$xZ9q" * 700]),
        ('db = connect(host="h1.example", password="hJ8#kd92LmQ1x")', ["hJ8#kd92LmQ1x"]),
        ('a = decode("hJ8#kd92LmQ1x", "hex")\npassword = a', ["hJ8#kd92LmQ1x"]),
        ('db = connect({"password": "hJ8#kd92LmQ1x", "user": "ann"})', ["hJ8#kd92LmQ1x"]),
        ('password = os.getenv("APP_DB_PASSWORD", "hJ8#kd92LmQ1x")', ["hJ8#kd92LmQ1x"]),
        ('password = decrypt("hJ8#kd92LmQ1x", \n\n name = "kd92LmQ1xZZ"', ["hJ8#kd92LmQ1x"]),
        ("<password>" + "gT5$wq81" * 700 + " </password>", ["gT5$wq81" * 700]),
    ],
)
def test_secrets_in_calls(text, found):
    got = secrets.scan(text)
    assert [text[a:b] for _, a, b, _ in got] == found
    assert all(f not in secrets.clean(text) for f in found)


@pytest.mark.parametrize("name", [*secrets.WEAK, "secrets.stripe", "password.value", "--password", "-password", "-Dapi.key", "-Dpwd"])
def test_secrets_of_weak_and_dashed_names(name):
    literal = "3f9a1c7e5b2d8064af19c3e7"
    assert [a for _, a, _, _ in secrets.scan(f"{name}={literal}")] == [len(name) + 1]
    assert secrets.clean(f"run {name}={literal} now") == f"run {name}={secrets.MARK} now"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('secret.a.b.c.d = "3f9a1c7e5b2d8064af19c3e7"', ["3f9a1c7e5b2d8064af19c3e7"]),
        ("password: Annotated[Optional[dict], a.very.long.module.name.Of.Some.Type] = 'hJ8#kd92LmQ1x'", ["hJ8#kd92LmQ1x"]),
        ('password = "hJ8#kd92LmQ1x" + "Zx8"', ["hJ8#kd92LmQ1x", "Zx8"]),
        ('a = "q"\npassword = "" + a + "hJ8#kd92LmQ1x"', ["q", "hJ8#kd92LmQ1x"]),
        ('password = os.getenv(' + " " * 90 + '"APP_DB_PASSWORD", "hJ8#kd92LmQ1x")', ["hJ8#kd92LmQ1x"]),
    ],
)
def test_secrets_have_no_caps(text, found):
    assert [text[a:b] for _, a, b, _ in secrets.scan(text)] == found
    assert not any(f in secrets.clean(text).replace("password", "") for f in found if f not in ("q",))


def test_secrets_of_made_up_programs():
    """Planted pairs in many syntaxes, among lines that hold none: just the planted literals are found."""
    rng = random.Random(21)
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    names = ["password", "api_key", "clientSecret", "AUTH_TOKEN", "db.password", "aws-secret-key", "private_key", "user.credentials.passwd"]
    calm = ["colour", "title", "password_hint", "max_tokens", "token_count", "path", "host.name"]
    shapes = ["{n} = \"{v}\"", "{n}: '{v}'", '{{"{n}": "{v}"}}', "export {n}={v}", "{n} := `{v}`", "<{n}>{v}</{n}>", '{n} = decode("{v}", "hex")', "--{n}={v}", '{n} => "{v}",']
    for _ in range(60):
        lines, want = [], []
        for _ in range(rng.randrange(3, 12)):
            value = "".join(rng.choice(letters) for _ in range(rng.randrange(16, 40))) + "7Qx"
            kind = rng.random()
            if kind < 0.4:
                lines.append(rng.choice(shapes).format(n=rng.choice(names), v=value))
                want.append(value)
            elif kind < 0.5:
                k = rng.randrange(4, len(value) - 4)
                v = f"part{len(lines)}"
                lines += [f'{v} = "{value[:k]}"', f'{rng.choice(names)} = {v} + "{value[k:]}"']
                want += [value[:k], value[k:]]
            elif kind < 0.75:
                lines.append(rng.choice(shapes).format(n=rng.choice(calm), v=value))
            else:
                lines.append(rng.choice(["the secret is in the garden", "password = changeme", "if token == other:", "call me at 10:30 today", "token = None"]))
        text = "\n".join(lines) + "\n"
        assert sorted(text[a:b] for _, a, b, _ in secrets.scan(text)) == sorted(want), text
        assert not any(w in secrets.clean(text) for w in want)


def test_unclosed_calls_take_linear_time():
    began = time.process_time()
    secrets.scan("a = f(" * 30_000)
    secrets.scan('a = f("x' * 30_000)
    secrets.scan("note: a b c " * 60_000)
    secrets.scan("note: " + "word " * 100_000)
    assert time.process_time() - began < 10


def test_secrets_on_odd_rows(spark, odd, none):
    docs = odd.unionByName(frame(spark, [(9, LONG + SECRET, "s")]))
    rows = secrets.findings(docs).collect()
    assert [(r.doc_id, r.start_at) for r in rows] == [(9, len(LONG) + len('password = "'))]
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("doc_id = 9").first().text == LONG + 'password = "[SECRET]"'
    assert out.filter("text is null").count() == 1 and secrets.findings(none).count() == 0 and secrets.redact(none).count() == 0


def test_transfers_move_the_least():
    rng = random.Random(2)
    for _ in range(60):
        old = [rng.randrange(50) for _ in range(rng.randrange(1, 6))]
        new = [rng.randrange(60) for _ in range(rng.randrange(1, 6))]
        if sum(new) < sum(old):
            with pytest.raises(ValueError, match="hold"):
                reshard.transfers(old, new)
            continue
        plan = reshard.transfers(old, new)
        least = sum(o - min(o, new[i] if i < len(new) else 0) for i, o in enumerate(old))  # what can't stay has to move
        assert sum(b for i, j, b in plan if i != j) == least
        assert all(sum(b for i, _, b in plan if i == k) == o for k, o in enumerate(old))
        assert all(sum(b for _, j, b in plan if j == k) <= c for k, c in enumerate(new))


def brute_reshard(files, capacities):
    """Of each new shard its rows in order, by laying the planned bytes of every old file over its rows one by one; files: rows of (id, bytes)."""
    out = {}
    for i, j, size in reshard.transfers([sum(b for _, b in f) for f in files], capacities):
        out.setdefault(i, []).append([j, size])
    shards = {}
    for i, rows in enumerate(files):
        at, plan = 0, [(sum(s for _, s in out[i][:k]), j) for k, (j, _) in enumerate(out[i])]
        for name, size in rows:
            j = [j for begin, j in plan if begin <= at][-1]
            shards.setdefault(j, []).append((i, name))
            at += size
    return shards


@pytest.mark.parametrize(("most", "chunk"), [(200_000, 1 << 16), (0, 7)])
def test_reshard_rewrites_what_it_plans(spark, tmp_path, none, most, chunk, monkeypatch):
    monkeypatch.setattr(reshard, "BROADCAST_BLOCKS", most)
    monkeypatch.setattr(reshard, "CHUNK", chunk)
    rows = [(i, None if i % 9 == 0 else LONG[:9000] if i == 40 else "w" * (i % 40), "s") for i in range(300)] + [(5, "same", "s")] * 2
    path, to = str(tmp_path / "old"), str(tmp_path / "new")
    frame(spark, rows).repartition(3).write.parquet(path)
    made = reshard.plan(spark, path, capacities=[2000, 12_000, 3000, 6000])
    written = reshard.rewrite(spark, path, made, to)
    own, (file, row, size) = reshard.rows(spark, [path])
    files = [[(r[0], r[1]) for r in own.filter(F.col(file) == f).orderBy(row).select("doc_id", size).collect()] for f in made.files]
    want = brute_reshard(files, made.capacities)
    for j in written:
        got = spark.read.parquet(f"{to}/shard={j}")
        assert got.columns == frame(spark, []).columns and len(got.inputFiles()) == 1
        assert [r.doc_id for r in got.withColumn("k", F.col("_metadata.row_index")).orderBy("k").collect()] == [name for _, name in want[j]]
    assert {j for j in want if {i for i, _ in want[j]} != {j}} <= set(written)
    table, (old, new, size, row) = reshard.assigned(spark, [path], made.blocks)
    moved = {r[0]: r[1] for r in table.groupBy(new).agg(F.sum(size)).collect()}
    assert table.count() == len(rows) and all(moved[j] <= made.capacities[j] + 9100 for j in moved)
    empty = str(tmp_path / "none")
    none.write.parquet(empty)
    assert reshard.plan(spark, empty).blocks is None


def test_reshard_moves_text_once(spark, small, tmp_path, monkeypatch):
    made = reshard.plan(spark, f"{small}/documents.parquet", target_bytes=100_000)
    table, _ = reshard.assigned(spark, [f"{small}/documents.parquet"], made.blocks)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_classifier_on_held_out_rows(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = zclass.train(zclass.sample(docs, labels.filter("doc_id % 2 = 0")))
    held = zclass.score(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    good, bad = (held.filter(f"quality = {q}").agg(F.avg(F.col("keep").cast("double"))).first()[0] for q in (1, 0))
    assert good > 0.95 and bad < 0.15
    rows = zclass.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(r.score is None and not r.keep for r in rows if r.doc_id in (2, 3))
    assert zclass.keep(odd, model).columns == odd.columns and zclass.score(none, model).count() == 0
    assert zclass.train([("only one class " * 9, 1)] * 20) is None and zclass.keep(odd, None).count() == len(ODD)
    assert {(r.score, r.keep) for r in zclass.score(odd, None).collect()} == {(None, True)}


def test_measure_equals_compressing_each_piece_alone():
    zstandard = pytest.importorskip("zstandard")
    rng = random.Random(6)
    words = [["house", "street", "river", "people", "walk"], ["win", "pills", "cheap", "click"]]
    rows = [(" ".join(rng.choices(words[1 - q], k=40)), q) for q in (0, 1) for _ in range(20)]
    model = zclass.train(rows)
    for text in ["house by the river", "cheap pills " * 300, "é中\U0001f600" * 100, "x", "\ud800 lone"]:
        raw = text.encode("utf-8", "surrogatepass")
        size = [0, 0]
        for k, own in enumerate((model.good, model.bad)):
            for at in range(0, len(raw), zclass.PIECE):
                c = zstandard.ZstdCompressor(level=zclass.LEVEL, dict_data=zstandard.ZstdCompressionDict(own), write_content_size=False, write_checksum=False, write_dict_id=False)
                size[k] += len(c.compress(raw[at : at + zclass.PIECE]))
        assert zclass.measure(text, model.compressors()) == (size[1] - size[0]) / (size[1] + size[0])


def test_calibration_is_the_most_likely_curve():
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.8).astype(float)
    x = rng.normal(size=400) * 0.1 + 0.1 * y
    slope, offset = zclass.calibrate(x, y)
    each, scale = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())), x.std()

    def loss(a, b):
        return (each * np.logaddexp(0, -(2 * y - 1) * (a / scale * x + b))).sum() + 0.005 * (a * a + b * b)

    best = loss(slope * scale, offset)
    assert all(loss(slope * scale + da, offset + db) >= best for da in (-0.02, 0, 0.02) for db in (-0.02, 0, 0.02))


def test_scores_at_the_limit_are_kept(spark):
    model = zclass.Model(b"good words here and there", b"bad words of this kind", 0.0, 0.0)
    docs = spark.createDataFrame([(1, "some text"), (1, "some text"), (2, "other"), (3, ""), (4, None)], "doc_id long, text string")
    assert [(r.doc_id, r.score, r.keep) for r in zclass.score(docs, model).orderBy("doc_id").collect()] == [(1, 0.5, True), (1, 0.5, True), (2, 0.5, True), (3, None, False), (4, None, False)]
    assert zclass.keep(docs, model).count() == 3


def test_classifier_gathers_each_labelled_text_once(spark, monkeypatch):
    rows = [(1, "a good text about the old river"), *[(2, "buy cheap pills")] * 300, (3, "buy cheap pills"), *[(4, "another good text")] * 200, (4, "a text that shares its id")]
    docs, sizes = spark.createDataFrame(rows, "doc_id long, text string"), []
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, quality int")
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: sizes.append(len(got := collect(df))) or got)
    assert sorted(zclass.sample(docs, labels)) == sorted([("a good text about the old river", 1), ("buy cheap pills", 0), ("another good text", 1), ("a text that shares its id", 1)])
    assert max(sizes) == 4  # not one row for each copy


@pytest.mark.parametrize("bad", [["buy cheap pills now click here win money fast " * 3], ["click win buy pills " * 2000] * 40 + ["short"], ["x"]])
def test_classifier_learns_from_few_and_odd_rows(spark, bad):
    words = "the house and dog of a street in town near old river with many trees people walk there every day".split()
    rng = random.Random(4)
    good = [" ".join(rng.choices(words, k=60)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(good + bad + [None, ""])), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < len(good))) for k in range(len(good + bad) + 2)], "doc_id long, quality int")
    rows = zclass.sample(docs, labels)
    assert len(rows) == len(set(good)) + len(set(bad)) and max(len(t) for t, _ in rows) <= zclass.TRAIN_CHARS
    model = zclass.train(rows)
    got = {r.doc_id: r for r in zclass.score(docs, model).collect()}
    assert sum(got[k].keep for k in range(len(good))) >= 27 and not got[len(good)].keep
    assert not got[len(good + bad)].keep and not got[len(good + bad) + 1].keep


def test_pii(spark, odd, none):
    model = pii.train()
    texts = ["mail to kim.42@mail7.example.com today", "call +1 (212) 555-0142 now", "from 192.168.7.25 it came", "the year 2024 and 350 pages", None, "", LONG]
    found = pii.Tagger(model).spans(texts)
    assert [(j, k, texts[j][a:b]) for j, k, a, b in found] == [(0, "EMAIL", "kim.42@mail7.example.com"), (1, "PHONE", "+1 (212) 555-0142"), (2, "IP", "192.168.7.25")]
    seqs, gold = pii.table(seed=77, sequences=150)
    made = [" ".join(s) for s in seqs]
    y, _ = pii.Tagger(model).labels(made)
    whole, _ = pii.Tagger(model).labels(made, prune=False)
    assert (y == whole).all()
    assert ((y > 0) == (gold.ravel() > 0)).mean() > 0.97
    assert pii.findings(odd, model).count() == 0 and pii.findings(none, model).count() == 0
    out = pii.redact(odd.unionByName(frame(spark, [(9, texts[0], "s")])), model)
    assert out.filter("doc_id = 9").first().text == "mail to [EMAIL] today" and out.count() == len(ODD) + 1 and out.columns == odd.columns


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(2)
    t, lens = rng.normal(size=(3, 3)), np.array([1, 4, 2, 3])
    e = rng.normal(size=(10, 3))
    e[5:7] = 0  # of these two, and where transitions are equal too, ties go to the first label
    for trans in (t, np.zeros((3, 3))):
        for left, right in itertools.product((False, True), repeat=2):
            got, at = pii.viterbi(e, lens, trans, np.full(4, left), np.full(4, right)), 0
            for n in lens:
                paths = list(itertools.product(range(3), repeat=int(n)))
                score = [sum(e[at + i, y] for i, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) + left * trans[0, p[0]] + right * trans[p[-1], 0] for p in paths]
                own = tuple(got[at : at + n].tolist())
                assert score[paths.index(own)] == pytest.approx(max(score))
                if at == 5 and not trans.any():
                    assert own == (0, 0)
                at += n


def test_pii_training_rows_are_not_those_of_the_tables(spark):
    texts = "\n".join(r.text or "" for s in ("0.001", "0.01") for r in spark.read.parquet(f"/root/testdata/sf{s}/documents.parquet").select("text").collect())
    assert not [x for x in [x for _, x in pii.LABELLED] + [x for x in pii.ORDINARY if len(x) > 16] if x in texts]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("a" * 70 + ".b@mail.example.com", "EMAIL"),
        ("x" + "a1" * 40 + "@mail.example.com", "EMAIL"),
        ("first.of.many.dotted.parts.in.a.name@sub.of.some.host.example.org", "EMAIL"),
        ("ip=192.168.7.25;", "IP"),
        ("tel:+14155552671", "PHONE"),
        ("a" * 5000 + "@mail.example.com", "EMAIL"),
        ("0123456789abcdef" * 40, None),
        ("9f8" * 400, None),
        ("1.2.3.4.5.6.7.8", None),
    ],
)
def test_pii_in_words_of_any_length(text, found):
    got = [k for _, k, _, _ in pii.Tagger(pii.train()).spans([f"see {text} there"])]
    assert got == ([found] if found else [])


PAD = "a" * 30 + "-" + "b" * 40
JOINED = [
    ('{"note":"' + PAD + '","email":"kim.42@mail7.example.com","tel":"415-555-2671","card":"4785380592391139"}', ["kim.42@mail7.example.com", "415-555-2671", "4785380592391139"]),
    (PAD + ",kim.42@mail7.example.com,415-555-2671,152.143.123.131,12,500", ["kim.42@mail7.example.com", "415-555-2671", "152.143.123.131"]),
    ("https://www.example.org/" + PAD + "?mail=kim.42@mail7.example.com&tel=415-555-2671", ["kim.42@mail7.example.com", "415-555-2671"]),
    ("这是一个没有空格的很长的句子" * 6 + "请联系kim.42@mail7.example.com或者致电415-555-2671谢谢", ["kim.42@mail7.example.com", "415-555-2671"]),
    ("2024-05-17T10:30:00Z|host=" + PAD + "|ip=152.143.123.131|user:kim.42@mail7.example.com", ["152.143.123.131", "kim.42@mail7.example.com"]),
    (PAD + "-415-555-2671-" + PAD, ["415-555-2671"]),
    (PAD * 3 + " and 1,200.50 of 12,500,000 by 17/05/2024", []),
]


def test_pii_in_joined_and_long_words():
    model = pii.train()
    texts = [t for t, _ in JOINED] + ["x " * 50 + t + " call +1 (212) 555-0142" for t, _ in JOINED]
    found = [[texts[j][a:b] for i, _, a, b in pii.Tagger(model).spans(texts) if i == j] for j in range(len(texts))]
    assert found == [f for _, f in JOINED] + [f + ["+1 (212) 555-0142"] for _, f in JOINED]
    y, n = pii.Tagger(model).labels(texts)
    whole, m = pii.Tagger(model).labels(texts, prune=False)
    assert (y == whole).all() and (n == m).all() and len(y) == n.sum()
    assert not any(pii.parts(w) for seq in pii.table()[0] for w in seq)


def brute_topk(rows, k):
    out = []
    good = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) and abs(x) < 1e150 for x in v)]
    for n, i, q in good:
        own = sorted(((-float(q @ p), j is None, j or 0, m) for m, j, p in good if m != n and len(p) == len(q)))[:k]
        out += [(i, r + 1, None if none_ else j, -s) for r, (s, none_, j, _) in enumerate(own)]
    return sorted(out, key=str)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_topk_equals_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "LEAST", 8)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in (base[i % 6] + 0.3 * rng.normal(size=8)) * np.exp(spread * rng.normal())]) for i in range(220)]
    rows += [(300 + i, rows[0][1]) for i in range(15)] + [(400, None), (401, []), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] * 8), (None, rows[1][1]), (404, [0.0] * 8), (405, [1.0, 2.0]), (406, [3.0, 4.0]), (405, [1.0, 2.0]), (2**63 - 1, rows[2][1]), (-(2**63), rows[2][1]), (407, [1e200] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, dim int, pos int, norm string")
    by = lambda r: str(r[:3])
    got = sorted([(r.vec_id, r.rank, r.neighbor_id, r.score) for r in topk.search(df, 5).collect()], key=by)
    want = sorted(brute_topk(rows, 5), key=by)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-6)
    some = sorted([(r.vec_id, r.rank, r.neighbor_id, r.score) for r in topk.search(df, 5, asked="vec_id % 100 = 0").collect()], key=by)
    assert some == [g for g in got if g[0] is not None and g[0] % 100 == 0] and len(some) == 20
    assert topk.search(df.filter("vec_id = 0.5"), 5).count() == 0 and topk.search(df, 5, asked="vec_id = 12345").count() == 0


def test_packing(spark, odd, none):
    rng = random.Random(8)
    sizes = [(i, rng.choice([1, 5, 30, 64, 65, 100, 200, rng.randrange(1, 400)])) for i in range(3000)] + [(None, 7), (9999, 0)]
    df = spark.createDataFrame(sizes, "doc_id long, n long")
    rows = packing.pack(df, window=128, unit=8, group_rows=100).collect()
    assert sum(r.n_tokens for r in rows) == sum(n for _, n in sizes)
    windows = {}
    for r in rows:
        windows.setdefault(r.window_id, []).append((r.start, r.start + r.n_tokens))
    for own in windows.values():
        own.sort()
        assert own[-1][1] <= 128 and all(a[1] <= b[0] for a, b in zip(own, own[1:]))
    room = []  # brute force: first fit, longest first
    for u in sorted((-(-r.n_tokens // 8) for r in rows), reverse=True):
        k = next((k for k, left in enumerate(room) if left >= u), None)
        if k is None:
            room.append(16 - u)
        else:
            room[k] -= u
    assert len(windows) <= 1.01 * len(room)
    again = packing.pack(df, window=128, unit=8, group_rows=100).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    lengths = {r.doc_id: r.n for r in packing.lengths(odd).collect()}
    assert set(lengths) == {1, None, 5, 6, 7} and lengths[6] == len(LONG.split()) + 1
    assert packing.pack(packing.lengths(none)).count() == 0


def test_packing_of_many_rows_without_id(spark):
    df = spark.createDataFrame([(None, 30)] * 700 + [(i, 30) for i in range(50)] + [(None, 300)] * 3, "doc_id long, n long")
    rows = packing.pack(df, window=128, unit=8, group_rows=100).collect()
    assert len(rows) == 700 + 50 + 9 and sum(r.n_tokens for r in rows) == 750 * 30 + 900
    assert sum(r.doc_id is None for r in rows) == 709 and len({(r.window_id, r.start) for r in rows}) == len(rows)
    places = {(r.doc_id, r.window_id, r.start) for r in rows if r.doc_id is not None}
    again = packing.pack(df.repartition(3), window=128, unit=8, group_rows=100).collect()
    assert places == {(r.doc_id, r.window_id, r.start) for r in again if r.doc_id is not None}


def test_token_lengths_hold_in_windows(spark, odd):
    n = {r.doc_id: r.n for r in packing.token_lengths(odd).collect()}
    assert set(n) == {1, 4, None, 5, 6, 7} and n[6] == {r.doc_id: r.n_tokens for r in bpe.encode(odd).collect()}[6] + 1


def test_pieces_match_as_the_whole():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", " ", " ", "  ", "\n", "é", "中", "'s", "12", "@x.y", "-", ", "]) for _ in range(rng.randrange(120)))
        parts = list(_shared.pieces(text, 17))
        assert "".join(parts) == text
        for find in (bpe.encoder().find, langid.words_of, str.split):
            assert [w for p in parts for w in find(p)] == list(find(text))


def test_very_long_texts(spark):
    """A text of several pieces and slices is labelled, encoded, searched and packed as a whole."""
    text = "the house of the dog and a cat, " * 110_000 + "mail kim.42@mail7.example.com " + SECRET  # 3.5 million characters
    docs = frame(spark, [(1, text, "s"), (2, "x" * 1_200_000, "s"), (3, text, "t")])
    n = {r.doc_id: r for r in bpe.encode(docs).collect()}
    assert all(r.round_trip for r in n.values()) and n[1].n_tokens == n[3].n_tokens
    crf = langid.train([("the house and the dog " * 20, "en"), ("das haus und der hund " * 20, "de")])
    words = {r.doc_id: r.n_words for r in langid.label(docs, crf).collect()}
    assert words == {1: len(langid.words_of(text)), 2: 1, 3: len(langid.words_of(text))}
    assert [(r.doc_id, r.kind) for r in pii.findings(docs).orderBy("doc_id").collect()] == [(1, "EMAIL"), (3, "EMAIL")]
    assert [(r.doc_id, text[r.start_at : r.end_at]) for r in secrets.findings(docs).orderBy("doc_id").collect()] == [(1, "hJ8#kd92LmQ1x"), (3, "hJ8#kd92LmQ1x")]
    assert [(r.doc_id, r.group_size) for r in simhash.groups(docs).orderBy("doc_id").collect()] == [(1, 2), (3, 2)]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://there:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():
            return Context

        @staticmethod
        def isDefined():
            return False

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _shared.shared_dir(Session)


def test_nnls_is_no_worse_than_projected_gradient():
    rng = np.random.default_rng(0)
    a, b = rng.random((12, 20)), rng.random(12)
    x = packing.nnls(a, b)
    y = np.zeros(20)
    for _ in range(20_000):
        y = np.maximum(0, y - 0.01 * a.T @ (a @ y - b))
    assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-4
