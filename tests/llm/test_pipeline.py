"""The corpus pipeline against brute force, stage by stage and as a whole."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_operators import DOCS, EXTRA, LONG, brute_quality, brute_secrets, words

import __spark_entry__
import corpus_pipeline
from treeloom.llm import mixing, quality, secrets, tokens

STAGES = dict(corpus_pipeline.STAGES)
KINDS = [r[0] for r in corpus_pipeline.STAGES]


def prose(seed, n=60):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 3000, n))


def table():
    secret = "3f9a1c77e0b24d558a6f0e1d2c3b4a59"
    texts = [prose(i) for i in range(40)]
    texts += [prose(3) + " end", prose(4), prose(4), None, "", "too few words", "buy now!! " * 30, "CLICK HERE NOW " * 20, LONG, LONG + " tail"]
    texts += [prose(50) + f" token = {secret}", "idiot scum " + prose(51), "\n".join(["the very same line of text"] * 9)]
    rows = [(i, t, "en", "s", len(t or "")) + EXTRA for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, prose(6), "en", "s", 1) + EXTRA, (None, prose(77), "en", "s", 1) + EXTRA]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), DOCS)


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"file://{folder}/documents.parquet")
    labels = [(i, 1, int(i == 51)) for i in range(0, 52)] + [(44, 0, 0), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}"


def passes(text):
    text = text or ""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = brute_quality(text)
    known = dict(
        n_words=n_words, word_chars=word_chars, n_symbols=n_symbols, n_dup_lines=n_dup_lines, n_repeat_words=n_repeat_words,
        n_lines=sum(bool(words(x)) for x in text.split("\n")), n_upper=len(re.findall("[A-Z]", text)), n_letters=len(re.findall("[A-Za-z]", text)),
        n_exclaims=sum("!!" in w for w in words(text)),
    )
    return not any(eval(rule.replace("AND", "and"), {}, known) for _, rule in quality.RULES)


def one_of_each(rows):
    sets = [frozenset(zip(*[words(r[1])[k:] for k in range(5)], strict=False)) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    groups = {}
    for r, x in zip(rows, label, strict=True):
        groups.setdefault(x, []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def same(found, want):
    assert Counter(map(str, map(tuple, found))) == Counter(map(str, want))


def test_names_and_order():
    assert KINDS == ["quality rules", "n-gram jaccard join", "secret scans", "mixing", "packing"]
    assert __spark_entry__.queries()["pipeline"].__wrapped__ is corpus_pipeline.run


def test_stages(spark, docs, sf_dir):
    now = docs.withColumn("n_chars", docs["n_chars"])
    rows = [r for r in table() if passes(r[1])]
    now = STAGES["quality rules"](spark, now, sf_dir)
    same(now.collect(), rows)
    rows = one_of_each(rows)
    now = STAGES["n-gram jaccard join"](spark, now, sf_dir)
    same(now.collect(), rows)
    known = secrets.learn(now)
    now = STAGES["secret scans"](spark, now, sf_dir)
    done = []
    for r in rows:
        spans = secrets.scan(r[1], known)
        assert [x for x in spans if x[0] != "novel"] == brute_secrets(r[1])
        text = r[1]
        for _, s, e in reversed(spans):  # none overlap here
            text = text[:s] + "[SECRET]" + text[e:]
        done.append((r[0], text, *r[2:4], len(text) if spans else r[4], *r[5:]))
    same(now.collect(), done)
    assert any("[SECRET]" in r[1] for r in done)
    mixer, measured = mixing.fitted(now, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    copies = Counter()
    for x in mixing.rated(measured, mixer).collect():
        copies[x["doc_id"]] += x["copies"]
    mixed = STAGES["mixing"](spark, now, sf_dir)
    found = mixed.collect()
    assert mixed.columns == docs.columns and Counter(r["doc_id"] for r in found) == Counter({k: n for k, n in copies.items() if n}) and set(map(str, map(tuple, found))) <= set(map(str, done))
    pieces = STAGES["packing"](spark, mixed, sf_dir).collect()
    lengths = Counter()
    for p in pieces:
        lengths[p["doc_id"]] += p["length"]
    want = Counter()
    tok = tokens.tokenizer(tokens.default_tokenizer())
    for r, ids in zip(found, tok.ids(pa.array([r["text"] for r in found], pa.string())), strict=True):
        want[r["doc_id"]] += len(ids) // 4
    assert lengths == want and {r["doc_id"] for r in found} >= {0, 1, 2}


def test_run(spark, docs, sf_dir, tmp_path):
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {p["doc_id"] for p in pieces}
    assert {0, 1, 2, 50} <= ids and not ids & {40, 42, 43, 44, 45, 46, 47, 52}
    docs.where("false").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
