"""The pipeline against a version in plain Python, and on odd and empty tables."""

from __future__ import annotations

import math
import re
import statistics

import pyarrow.parquet as pq
import pytest
import xxhash
import zstandard

import corpus_pipeline
from tests.llm.test_operators import ODD, frame
from voltloom.llm import packing, secrets, zclass


def fails(text):
    """The quality rules, character by character."""
    words = [w for w in re.split(r"[ \n\t\r]+", text) if w]
    symbols = sum(c in "#$%&*|!<>{}[]\\^~_" for c in text)
    capitals = [c for c in text if "A" <= c <= "Z" or "À" <= c <= "Ö" or "Ø" <= c <= "Þ"]
    letters = [c for c in text if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" and c not in "×÷"]
    again = sum(a == b for a, b in zip(words, words[1:]))
    return not words or symbols > 0.05 * len(text) or (len(letters) >= 20 and 10 * len(capitals) > 6 * len(letters)) or (len(words) >= 5 and 10 * again > 3 * len(words))


def signature(text, known={}):  # noqa: B006
    """128 signs of sums of votes, in whole numbers of Python."""
    low = (1 << 64) - 1
    sums = [0] * 128
    for word in set(re.findall(r"\w+", text.lower())) or {text.strip()}:
        if word not in known:
            votes = []
            for k in range(1, 65):
                x = (xxhash.xxh3_64_intdigest(word) + k * 0x9E3779B97F4A7C15) & low
                x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & low
                x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & low
                x ^= x >> 31
                for own in (x & 0xFFFFFFFF, x >> 32):
                    weight = int(max(((own >> 16) + 0.5) / 65536, 2.0**-13) ** -2.0)
                    votes.append(weight if own & 1 else -weight)
            known[word] = votes
        sums = [a + b for a, b in zip(sums, known[word])]
    return sum(1 << k for k, v in enumerate(sums) if v > 0)


def plain(spark, sf_dir):
    """{doc_id: tokens} of what the stages keep, in plain Python but for the classifier's dictionaries and the masks of secrets."""
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    hosts = {}
    for r in docs:
        r["fails"] = fails(r["text"] or "")
        hosts.setdefault(r["source"] or "", []).append(r["fails"])
    rate = {h: sum(f) / len(f) for h, f in hosts.items()}
    mean, var = statistics.mean(rate.values()), statistics.variance(rate.values())
    s = 1000.0 if var < 1e-12 else min(1000.0, max(1.0, mean * (1 - mean) / var - 1))
    bad = {h for h, f in hosts.items() if (sum(f) + s * mean) / (len(f) + s) > 0.5}
    rows = [r for r in docs if not r["fails"] and (r["source"] or "") not in bad]
    model = zclass.train(zclass.sample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))
    good, bad = (zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad))

    def score(text):
        raw = text.encode()
        pieces = [raw[k : k + 128] for k in range(0, len(raw), 128)]
        g, b = (sum(len(c.compress(p)) for p in pieces) for c in (good, bad))
        return 1 / (1 + math.exp(-(model.slope * (b - g) / (b + g) + model.offset)))

    rows = sorted((r for r in rows if score(r["text"]) >= 0.5), key=lambda r: r["doc_id"])
    sigs = [signature(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (sigs[i] ^ sigs[j]).bit_count() <= 13 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for r, g in zip(rows, group):
        first.setdefault(g, r)
    return {r["doc_id"]: len([w for w in re.split(r"[ \t\n\x0b\f\r]+", secrets.clean(r["text"])) if w]) + 1 for r in first.values()}


def test_pipeline_keeps_what_plain_python_keeps(spark, small):
    want = plain(spark, small)
    got, windows = {}, {}
    for r in corpus_pipeline.run(spark, small).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
        windows.setdefault(r.window_id, []).append((r.start, r.start + r.n_tokens))
    assert got == want and len(want) > 50
    assert all(max(b for _, b in own) <= packing.WINDOW and all(x[1] <= y[0] for x, y in zip(sorted(own), sorted(own)[1:])) for own in windows.values())


def test_stages_keep_columns_and_mask(spark, tmp_path):
    docs = frame(spark, [*ODD, (50, 'some words and a token = "cf1d64a9a4cd9723e1f4" in it', "s9")])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    text = now.filter("doc_id = 50").first()
    assert secrets.MARK in text.text and text.n_chars == len(text.text)
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() >= 4


def test_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stage_order(k):
    assert [n for n, _ in corpus_pipeline.STAGES][k] == ["quality_rules", "quality_classifier", "near_dedup", "secrets", "packing"][k]
    assert packing.WINDOW == 2048
