"""Operators against brute force, exact round trips, other implementations and held-out labels."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import _text, ann, langid, licenses, media, minhash, pieces, queries, substring, toxicity


def near_copies(seed, groups=12, copies=9):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(3, 120))]
        for _ in range(copies):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            texts.append(" ".join(w.upper() if r.random() < 0.1 else w for w in own))
    r.shuffle(texts)
    return texts


def brute_components(texts, k, percent=80):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("seed", [1, 2])
def test_minhash_components(spark, seed):
    texts = near_copies(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 4).collect()}
    assert found == brute_components(texts, 4)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(3)
    a = r.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate((a[:600], r.integers(0, 2**63, 300).astype(np.uint64)))
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - 600 / 1200) < 0.12


def test_substring_on_runs_and_periods(spark):
    r = random.Random(5)
    texts = []
    for _ in range(120):
        period = r.choice(["a", "a b", "x y x", "q r s t"])
        texts.append(" ".join([" ".join(r.choice("pqr") for _ in range(r.randint(0, 9))), (period + " ") * r.randint(0, 30), "\t".join(r.choice("ab") for _ in range(r.randint(0, 80)))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for window in (3, 35):
        found = {r.doc_id: tuple(r)[1:] for r in substring.digest(substring.drop_repeats(docs, window)).collect()}
        assert found == dict(enumerate(substring.brute_force(texts, window)))


def test_interior_symbols_do_not_depend_on_what_surrounds_them():
    r = np.random.default_rng(1)
    shared = r.integers(1, 2**63, 60).astype(np.uint64)
    found = []
    for seed in (2, 3):
        around = np.random.default_rng(seed).integers(1, 2**63, 40).astype(np.uint64)
        tokens = np.concatenate((around[:17], shared, around[17:]))
        top = substring.recompress(tokens, np.zeros(len(tokens), np.int64))[-1]
        inside = (top.low >= 17) & (top.high <= 77)
        found.append(set(zip(top.name[inside], top.start[inside], strict=True)))
    assert found[0] == found[1] and len(found[0]) > 5


def test_pieces_equal_the_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    r = random.Random(1)
    alphabets = ["abcdefghijklmnop  \n-=*éß漢😀 0129.", "ab -=#", "the ing ed er  "]
    texts = ["".join(r.choice(r.choice(alphabets)) for _ in range(r.randint(0, 80))) for _ in range(1500)] + [" " * 50 + "x", "a" * 300, "responsibility " * 20, "\t", "▁x▁"]
    encoder = pieces.Encoder(pieces.load())
    for _ in range(2):
        ids = encoder.encode(pa.array(texts)).to_pylist()
        assert ids == [model.encode(t) for t in texts]
    back = pieces.decode(encoder.v, pa.array(ids, pa.list_(pa.int32()))).to_pylist()
    assert all(b == t for b, t in zip(back, texts, strict=True) if "▁" not in t)


def _unit(n, d, seed=4):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("n", [500, 2000, 9000])
def test_ann_recall_while_pruning(spark, n):
    """The worst case: vectors without any structure. Ranks and scores are those of brute force among what is found."""
    x = _unit(n, 64)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = range(0, n, max(20, n // 40))
    rows = ann.search(table, table.filter(F.col("vec_id").isin(list(asked)))).collect()
    hits = 0
    for q in asked:
        scores = (x * x[q]).sum(axis=1)
        scores[q] = -9
        own = sorted((row.rank, row.vec_id, row.score) for row in rows if row.query_id == q)
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in [v for _, v, _ in own]
        assert all(abs(s - scores[v]) < 1e-12 for _, v, s in own)
        assert [v for _, v, _ in own] == sorted((v for _, v, _ in own), key=lambda v: (-scores[v], v))
        hits += len(set(np.argsort(-scores)[:20].tolist()) & {v for _, v, _ in own})
    assert hits / (len(asked) * 20) >= 0.9
    # no index of a few cells that visits them all
    first, second = ann.kmeans(x[:, :32], ann.CENTROIDS, 1), ann.kmeans(x[:, 32:], ann.CENTROIDS, 2)
    cell = ann.cell_of(first, second, x)
    sizes = np.bincount(cell, minlength=len(first) * len(second))
    visited = ann.traverse(-(first @ x[0, :32]), -(second @ x[0, 32:]), sizes, ann.PROBE_SHARE * n)
    assert sizes[visited].sum() <= ann.PROBE_SHARE * n + sizes.max()


def test_ann_finds_all_where_structure_is(spark):
    """Groups of neighbours: a small share of the rows is enough. Every length of vectors has its own index."""
    r = np.random.default_rng(1)
    centres = _unit(60, 16, 2)
    x = np.repeat(centres, 40, axis=0) + 0.01 * r.normal(size=(2400, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000 + i, v.tolist()) for i, v in enumerate(_unit(30, 3, 5))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(table, table.filter("vec_id % 100 = 0"), share=0.05).collect()
    for q in range(0, 2400, 100):
        scores = (x * x[q]).sum(axis=1)
        scores[q] = -9
        assert [row.vec_id for row in sorted(found, key=lambda t: t.rank) if row.query_id == q] == np.lexsort((np.arange(2400), -scores))[:20].tolist()
    assert sorted(r.rank for r in found if r.query_id == 9000)[0] == 1 and all(r.vec_id >= 9000 for r in found if r.query_id == 9000)


def test_shards_hold_neighbouring_cells(monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 10)
    r = np.random.default_rng(0)
    for _ in range(50):
        sizes = r.choice([0, 1, 3, 9, 10, 11, 25, 70], 36)
        index = ann.layout(np.zeros((6, 1)), np.zeros((6, 1)), sizes)
        rows = {}
        for cell in range(36):
            for part in range(index.parts[cell]):
                shard = index.base[cell] + part
                assert index.low[shard] <= cell < max(index.low[shard] + 1, index.low[shard + 1])
                rows[shard] = rows.get(shard, 0) + -(-sizes[cell] // index.parts[cell])
        assert max(rows.values()) <= 10


def test_cells_are_visited_by_summed_distance():
    r = np.random.default_rng(2)
    first, second = r.random(7), r.random(5)
    order = ann.traverse(first, second, np.ones(35, int), 35)
    assert sorted(order) == list(range(35))
    sums = [first[c // 5] + second[c % 5] for c in order]
    assert sums == sorted(sums)


def test_language_held_out(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    held = langid.fold(F.col("doc_id"), 4) == 2
    found = langid.predict(docs.filter(held), langid.fit(docs.filter(~held)))
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9


def plain_bayes(rows, asked):
    """Language and posterior by the formula, a text at a time; rows: text and language."""
    counts, prior = {}, {}
    for text, lang in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        counts.setdefault(lang, np.full(langid.BUCKETS, langid.ALPHA))
        prior[lang] = prior.get(lang, 0) + 1
        np.add.at(counts[lang], langid.grams(raw, np.array([0, len(raw)]))[1], 1)
    out = []
    for text in asked:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        _, buckets, letters = langid.grams(raw, np.array([0, len(raw)]))
        if not letters[0]:
            out.append(("und", 0.0))
            continue
        scores = {c: np.log(prior[c] / len(rows)) + np.log(n[buckets] / n.sum()).sum() for c, n in sorted(counts.items())}
        best = max(scores, key=lambda c: scores[c])
        out.append((best, 1 / sum(np.exp(min(0, s - scores[best])) for s in scores.values())))
    return out


@pytest.mark.parametrize("languages", [3, 300])
def test_language_equals_plain_bayes(spark, languages):
    """Any number of labels: 300 are scored in two blocks."""
    r = random.Random(languages)
    syllables = ["".join(r.choice("bcdfglmnprstvàéñжю") for _ in range(2)) + r.choice("aeiou") for _ in range(400)]
    rows = [(i, " ".join(r.choice(syllables[i % languages : i % languages + 40]) for _ in range(r.randint(1, 30))), f"l{i % languages:03d}" if i % 7 else None) for i in range(900)] + [(900, None, "l001"), (901, "12 !", "l002"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    expected = plain_bayes([(t, c) for _, t, c in rows if c and t is not None], [t for _, t, _ in rows])
    found = {x.doc_id: x for x in langid.predict(docs, langid.fit(docs)).collect()}
    assert [found[i].lang_pred for i in range(903)] == [e[0] for e in expected]
    assert all(abs(found[i].score - e[1]) < 1e-9 for i, e in enumerate(expected))


def test_toxicity_held_out(spark):
    r = random.Random(8)
    usual, rude = ["kala", "mitu", "sorna", "velo", "pirta", "onde"], ["grubzk", "zgorx"]
    rows = []
    for i in range(600):
        toxic = i % 5 == 0
        rows.append((i, " ".join(r.choice(rude) if toxic and r.random() < 0.08 else r.choice(usual) + r.choice(usual) for _ in range(60)), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.score(table.select("doc_id", "text"), table.select("doc_id", "toxic"), lambda c: langid.fold(c, 3) != 1).collect()
    truth = {i: t for i, _, t in rows}
    held = [x for x in found if __import__("zlib").crc32(str(x.doc_id).encode()) % 3 == 1]
    assert np.mean([(x.score >= 0.7) == truth[x.doc_id] for x in held]) > 0.95


def plain_models(rows):
    """Both classes' distributions over the words of rows (text, label) and what neither has met (None), and the log ratio of each, by the formulas."""
    counts = [{}, {}]
    for text, label in rows:
        for w in set(re.findall(r"[^\W\d_]+", text.lower())):
            counts[label][w] = counts[label].get(w, 0) + 1
    every = sorted(set(counts[0]) | set(counts[1]))
    contexts = {w: (w in counts[0]) + (w in counts[1]) for w in every}
    shared = {w: (contexts.get(w, 0) + 1) / (sum(contexts.values()) + len(every) + 1) for w in [*every, None]}
    models = []
    for own in counts:
        of = [sum(n == k for n in own.values()) for k in range(5)]
        rate = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.75
        cut = lambda n, of=of, rate=rate: 0 if not n else (lambda k: min(k, max(0, k - (k + 1) * rate * of[k + 1] / of[k])) if of[k] else k / 2)(min(n, 3))
        total = sum(own.values())
        free = sum(cut(n) for n in own.values()) / total
        models.append({w: (own.get(w, 0) - cut(own.get(w, 0))) / total + free * shared[w] for w in [*every, None]})
    return models, {w: np.log(models[1][w] / models[0][w]) for w in [*every, None]}


def test_smoothed_models_are_distributions(spark):
    r = random.Random(4)
    usual, rude = [a + b for a in "bcdfgl" for b in ("ata", "eno", "iru", "oma")], ["zgo", "grub", "bata"]
    rows = [(" ".join([r.choice(usual) for _ in range(r.randint(0, 9))] + [r.choice(rude)] * (i % 4 == 0) + [f"only{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}"] * (i % 3 == 0)), int(i % 4 == 0)) for i in range(200)]
    models, ratios = plain_models(rows)
    assert all(abs(sum(m.values()) - 1) < 1e-12 for m in models)
    labelled = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, toxic int")
    counts = toxicity.fit(labelled)
    model = toxicity.estimate(counts)
    # the same sums over the table of counts
    sums = counts.select(*[F.sum(model.probability(c, F.col("n0"), F.col("n1"))).alias(f"p{c}") for c in range(2)]).first()
    assert all(abs(sums[f"p{c}"] + model.classes[c].free / model.contexts - 1) < 1e-9 for c in range(2))
    assert model.unseen == pytest.approx(ratios[None])
    key = {w: next(toxicity.words(pa.array([w])))[3][0] for w in ratios if w}
    found = {x.key: x.evidence for x in toxicity.evidence(counts, model).collect()}
    assert found == {key[w]: pytest.approx(x, abs=1e-5) for w, x in ratios.items() if w and x > ratios[None] + 1e-7}
    # and every document's strongest expression, whatever group it is in
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(999, None), (1000, ""), (1001, "nevermet zgo")], "doc_id long, text string")
    expected = {i: max([ratios[None], *[ratios[w] for w in t.split()]]) for i, (t, _) in enumerate(rows)} | {999: ratios[None], 1000: ratios[None], 1001: ratios["zgo"]}
    for parts in (1, 7):
        got = {x.doc_id: (x.strongest, x.words) for x in toxicity.strongest(docs.repartition(parts), toxicity.evidence(counts, model), model.unseen).collect()}
        assert {i: x[0] for i, x in got.items()} == {i: pytest.approx(x, abs=1e-5) for i, x in expected.items()}
        assert got[999][1] == got[1000][1] == 0 and got[1001][1] == 2 and all(got[i][1] == len(set(t.split())) for i, (t, _) in enumerate(rows))


def plain_pair_evidence(rows, ratios):
    """Evidence of pairs of words by the formulas, from rows (text, label) and the log ratios of words; those that exceed both words and an unseen one."""
    counts, known = [{}, {}], {}
    for text, label in rows:
        w = re.findall(r"[^\W\d_]+", text.lower())
        for x in w:
            known.setdefault(x, set()).add(label)
        for pair in set(zip(w, w[1:])):
            counts[label][pair] = counts[label].get(pair, 0) + 1
    every = set(counts[0]) | set(counts[1])
    cuts = []
    for own in counts:
        of = [sum(n == k for n in own.values()) for k in range(5)]
        rate = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.75
        cuts.append(lambda n, of=of, rate=rate: 0 if not n else (lambda k: min(k, max(0, k - (k + 1) * rate * of[k + 1] / of[k])) if of[k] else k / 2)(min(n, 3)))
    after, contexts = {}, sum(len(x) + 1 for x in known.values()) + 1
    for v, w in every:
        after.setdefault(v, []).append((v, w))
    know = lambda p: (p in counts[0]) + (p in counts[1])
    out = {}
    for v, w in counts[1]:
        shared = (know((v, w)) - 0.5 + 0.5 * len(after[v]) * (len(known[w]) + 1) / contexts) / sum(map(know, after[v]))
        n = [own.get((v, w), 0) for own in counts]
        beyond = [np.log1p((n[c] - cuts[c](n[c])) / max(0.5, sum(cuts[c](counts[c].get(p, 0)) for p in after[v])) / shared) if n[c] else 0 for c in range(2)]
        found = (ratios[v] + beyond[1] - beyond[0]) / 2
        if found > max(ratios[v], ratios[w], ratios[None]) + 1e-6:
            out[v, w] = found
    return out


def test_pairs_of_words_are_judged_given_the_first(spark):
    r = random.Random(6)
    usual = [a + b for a in "bcdfgl" for b in ("ata", "eno", "iru")]
    rows = [(" ".join([*(r.choice(usual) for _ in range(r.randint(0, 12))), *(["zet", "mog"] if i % 3 == 0 else ["mog", "bata", "zet"])]), int(i % 3 == 0)) for i in range(150)]
    _, ratios = plain_models(rows)
    expected = plain_pair_evidence(rows, ratios)
    labelled = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, toxic int")
    counts, pairs = toxicity.fit_both(labelled)
    assert {tuple(x) for x in counts.collect()} == {tuple(x) for x in toxicity.fit(labelled).collect()}
    model = toxicity.estimate(counts)
    found = toxicity.pair_evidence(pairs, counts, model)
    hashes = {w: next(toxicity.words(pa.array([w])))[3] for w in ratios if w}
    key = lambda v, w: int(toxicity.pair_keys(hashes[v], hashes[w])[0])
    assert ("zet", "mog") in expected and {x.key: x.evidence for x in found.collect()} == {key(*p): pytest.approx(x, abs=1e-5) for p, x in expected.items()}
    # and in the texts: neighbours in their order, none across texts
    docs = spark.createDataFrame([(0, "Zet, MOG"), (1, "mog zet"), (2, "zet"), (3, "mog"), (4, None)], "doc_id long, text string")
    for parts in (1, 5):
        got = {x.doc_id: x.strongest for x in toxicity.strongest(docs.repartition(parts), toxicity.evidence(counts, model), model.unseen, found).collect()}
        of = lambda *w: max(ratios[None], *(ratios[x] for x in w))
        expect = {0: expected["zet", "mog"], 1: max(of("zet", "mog"), expected.get(("mog", "zet"), -99)), 2: of("zet"), 3: of("mog"), 4: ratios[None]}
        assert got == {i: pytest.approx(x, abs=1e-5) for i, x in expect.items()}


def test_an_expression_of_two_ordinary_words_is_found(spark):
    """Both words are as frequent in either class; only their order is toxic."""
    r = random.Random(12)
    usual = [a + b + c for a in "bcdfgl" for b in ("ata", "eno", "iru") for c in ("", "s", "n")]
    rows = []
    for i in range(900):
        toxic, text = i % 5 == 0, [r.choice(usual) for _ in range(40)]
        at = r.randrange(38)
        text[at : at + 2] = ["zet", "mog"] if toxic else ["mog", "zet"]
        rows.append((i, " ".join(text), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.score(table.select("doc_id", "text"), table.select("doc_id", "toxic"), lambda c: langid.fold(c, 3) != 1).collect()
    held = [x for x in found if __import__("zlib").crc32(str(x.doc_id).encode()) % 3 == 1]
    assert np.mean([(x.score >= 0.7) == rows[x.doc_id][2] for x in held]) > 0.95


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_toxicity_ranks_held_out_documents(spark, sf):
    import zlib

    root = f"/root/testdata/{sf}"
    labels = {x.doc_id: x.toxic for x in spark.read.parquet(f"{root}/labels.parquet").collect() if x.toxic is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1}
    found = {x.doc_id: x for x in queries.op10_toxicity(spark, root).collect()}
    scores, truth = np.array([found[i].score for i in labels]), np.array(list(labels.values()))
    rude, clean = scores[truth == 1], scores[truth == 0]
    auc = ((rude[:, None] > clean[None]).mean() + (rude[:, None] >= clean[None]).mean()) / 2
    assert auc >= 0.9 and (clean >= 0.7).mean() < 0.02 and all(found[i].held_out for i in labels)


def test_licenses_in_longer_notices(spark):
    texts = [
        "x Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in strict compliance with the License. y",
        "under the MIT license or under the mit LICENSE", "CC-BY-NC cc by nc", "licensed under the GNU General Public License version 3", "the mit license under", "under the m\u0130t license", "WORKS \u212a UNDER THE MIT LICENSE",
    ]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (rows[0].base_labels, rows[0].labels, rows[0].first_word) == ("apache-2", "apache-2", 4)
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word) == (2, 0, 5)
    assert (rows[5].n_base, rows[5].n_words, rows[6].n_base, rows[6].n_words) == (0, 4, 1, 6)
    assert (rows[2].n_base, rows[3].labels, rows[3].base_labels, rows[4].labels) == (2, "gpl-3", "", "")
    assert all(s.share >= licenses.LEAST for r in rows.values() for s in r.spans)


def test_every_license_notice_finds_itself(spark):
    """In its own words, in another case and with other marks between them; short ones only whole, and no notice under another label that differs in a word of a short one."""
    texts = [f"some words before. {n.upper().replace(' ', ' - ')}; and after" for _, n in licenses.NOTICES]
    short = [(label, n) for label, n in licenses.NOTICES if len(n.split()) - licenses.GRAM + 1 < licenses.SHORT]
    broken = [" ".join(["so", *n.split()[:2], "other", *n.split()[3:]]) for _, n in short]
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts + broken)), "doc_id long, text string")).collect()}
    for i, (label, notice) in enumerate(licenses.NOTICES):
        assert label in rows[i].labels.split(",") and rows[i].score == 1.0
        assert any(s.label == label and (s.first, s.last) == (3, 2 + len(notice.split())) for s in rows[i].spans)
    for i, (label, n) in enumerate(short):
        assert all(s.label != label or s.last - s.first + 1 < len(n.split()) for s in rows[len(texts) + i].spans)
    assert rows[[l for l, _ in licenses.NOTICES].index("cc-by-nc-sa")].labels == "cc-by-nc-sa"


def test_media_sequences(spark):
    page = '<html><head><title>t</title></head><body><p>one &amp; <b>two</b> <i>three</i></p><script>var t="</p>";</script><figure><img src="media:aa" alt="x"><figcaption>cap</figcaption></figure>three<img src="http://e/x.png" alt="y"></body>'
    items = media.parse(page)
    assert [(i["kind"], i["text"], i["digest"], i["alt"], i["caption"]) for i in items] == [("text", "one & two three", None, None, None), ("img", None, "aa", "x", "cap"), ("text", "three", None, None, None), ("img", None, None, "y", "y")]
    assert [i["position"] for i in items] == [0, 1, 2, 3] and items[3]["source"] == "http://e/x.png"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    found = media.resolve(media.references(media.sequences(pages, "page_id", "html")), spark.createDataFrame([("aa", b"z")], "digest string, payload binary"), ["payload"])
    assert sorted((r.key, r.position, r.digest, bytes(r.payload or b"")) for r in found.collect() if r.digest) == [(1, 1, "aa", b"z")]


def _brief(page):
    return [i["text"] if i["kind"] == "text" else (i["digest"], i["caption"]) for i in media.parse(page)]


def test_pages_as_people_write_them():
    img = lambda d: f'<img src="media:{d}">'
    assert media.parse(None) == [] == media.parse("") == media.parse("<head><title>t</title>")
    assert _brief("<head><title>t</title><body><p>hello") == ["hello"]
    assert _brief("<head><title>t</title><p>hello</p><title>u</title>") == ["hello"]
    assert _brief("<head><meta x><template><p>no</p></template><style>p</style>shown") == ["shown"]
    assert _brief(f"<figure><figcaption>before</figcaption>{img('a')}</figure>") == [("a", "before")]
    assert _brief(f"<figure>{img('a')}<figcaption><p>cap</p><p>more</p></figcaption></figure><p>body</p>") == [("a", "cap more"), "body"]
    nested = f"<figure>{img('a')}<figure>{img('b')}<figcaption>in</figcaption></figure>{img('c')}<figcaption>out</figcaption></figure>"
    assert _brief(nested) == [("a", "out"), ("b", "in"), ("c", "out")]
    assert _brief(f"<figure>{img('a')}<figcaption>never closed") == [("a", "never closed")]
    assert _brief("<figcaption>alone</figcaption>") == ["alone"]
    assert _brief("<p>a<br>b <b>c</b> d</p>") == ["a", "b c d"]
    assert _brief(f"<noscript>{img('a')}</noscript>x{img('b')}y") == ["x", ("b", None), "y"]
    r = random.Random(2)
    parts = ["<", ">", "<!", "<![", "<![CDATA[", "<![if x]>", "<!--", "-->", "<?x", "</", "<p", "<img src=media:q ", "<script>", "</script", "&am", "&#x110000;", "text", '"', "<figure>", "</figure>", "<figcaption>", "<head>", "<title>", "\0", "]]>"]
    for _ in range(3000):
        items = media.parse("".join(r.choice(parts) for _ in range(r.randint(1, 12))))
        assert [i["position"] for i in items] == list(range(len(items)))


def test_media_columns_equal_plain_ones(spark):
    """All columns of the contract, each made anew here from the text, with the image read by hand."""
    import hashlib
    import struct
    import zlib

    r = random.Random(9)
    texts = [None, "", "a", "é😀" * 40, "x" * 64, "y" * 65, "a", *["".join(r.choice("abc \n") for _ in range(r.randint(0, 900))) for _ in range(40)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    store = {x.digest: bytes(x.media) for x in media.stored(docs).collect() if x.media is not None}
    found = {x.doc_id: x for x in media.text_media(docs.repartition(5)).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        data, x = (text or "").encode(), found[i]
        payload = data + bytes((-len(data)) % 64 or (0 if data else 64))
        image = store[hashlib.sha256(data).hexdigest()]
        at, body = 8, b""
        while at < len(image):
            (size,) = struct.unpack(">I", image[at : at + 4])
            body += image[at + 8 : at + 8 + size] if image[at + 4 : at + 8] == b"IDAT" else b""
            at += size + 12
        rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(-1, 65)
        assert rows[:, 1:].tobytes() == payload and not rows[:, 0].any()
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (x.media_bytes, x.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
        values = np.frombuffer(payload, np.uint8).astype(float)
        share = np.unique(values, return_counts=True)[1] / len(values)
        step = np.abs(values[64:] - values[:-64]).mean() if len(values) > 64 else 0
        assert x.feature == f"h={len(payload) // 64};mean={values.mean():.4f};sd={values.std():.4f};entropy={abs((share * np.log2(share)).sum()):.4f};step={step:.4f}"
        assert (x.position, x.caption) == (1, f"payload of document {i}")


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 5000])
def test_media_round_trip(size):
    data = random.Random(size).randbytes(size)
    payload = media.pad(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[:size] == data and not any(payload[size:])
    stored = media.encode(payload)
    assert media.decode(stored) == payload
    with pytest.raises(ValueError):
        media.decode(stored[:40] + bytes([stored[40] ^ 1]) + stored[41:])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, data, name):
    connection = duckdb.connect()
    for table in ("documents", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    relation = connection.sql(queries.oracle_sql()[name])
    names = sorted(relation.columns)
    expected = sorted(map(str, (tuple(r) for r in connection.sql(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()[name]})").fetchall())))
    found = sorted(map(str, (tuple(r[n] for n in names) for r in queries.queries()[name](spark, data).collect())))
    assert found == expected


WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_boilerplate(rows, ratio=0.05):
    """doc_id and text without the lines of their source that stand on more than a share of its distinct texts, and on more than one."""
    pages, counts = {}, {}
    for r in rows:
        if r.source is not None and r.text is not None:
            pages.setdefault(r.source, set()).add(r.text)
    for source, texts in pages.items():
        for text in texts:
            for line in set(text.split("\n")):
                counts[source, line] = counts.get((source, line), 0) + 1
    gone = {k for k, n in counts.items() if n > 1 and n > ratio * len(pages[k[0]])}
    return {r.doc_id: r.text if r.text is None else "\n".join(x for x in r.text.split("\n") if (r.source, x) not in gone) for r in rows}


def plain_mix(rows):
    """The texts of the mix, sorted, with their doc_id: targets by resharing, order by md5 of doc_id, whole epochs and a cut."""
    import hashlib

    size = {r.doc_id: len(WORD_RE.findall(r.text or "")) for r in rows}
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    order = sorted((x for x in by_source if x is not None)) + [None] * (None in by_source)
    weight, total = {x: (5, 2, 1)[i % 3] for i, x in enumerate(order)}, {x: sum(size[r.doc_id] for r in by_source[x]) for x in order}
    capped = {}
    while True:
        free = [x for x in order if x not in capped]
        left = 1.5 * sum(total.values()) - sum(capped.values())
        target = capped | {x: left * weight[x] / sum(weight[f] for f in free) for x in free}
        over = [x for x in free if target[x] > 2 * total[x]]
        if not over:
            break
        capped |= {x: 2.0 * total[x] for x in over}
    out = []
    for source in order:
        left = int(target[source] + 1e-9)
        rows_ = sorted(by_source[source], key=lambda r: (hashlib.md5(f"17-{r.doc_id}".encode()).hexdigest(), r.doc_id))
        while left > 0:
            for r in rows_:
                n = min(left, size[r.doc_id])
                left -= n
                if n == size[r.doc_id] and n:
                    out.append((r.doc_id, r.text))
                elif n:
                    out.append((r.doc_id, r.text[: list(WORD_RE.finditer(r.text))[n - 1].end()]))
    return sorted(out)


def test_pipeline_equals_plain_stages(spark, data):
    """Every stage on what the one before it kept, against a plain version of it."""
    import sentencepiece

    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept, stages = docs, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "line_dedup", "near_dedup", "mix_sources", "encode"]
    for name in list(stages)[:-1]:
        rows = kept.orderBy("doc_id").collect()
        out = corpus_pipeline.materialize(stages[name](spark, kept, data))
        assert out.columns == docs.columns
        found = out.collect()
        if name == "language":
            judged = plain_bayes([(r.text, r.lang) for r in rows if r.lang and r.text is not None], [r.text for r in rows])
            assert {r.doc_id for r in found} == {r.doc_id for r, (lang, score) in zip(rows, judged, strict=True) if lang != "und" and score >= 0.5}
            assert len(found) > 0.9 * len(rows)
        if name == "line_dedup":
            assert {r.doc_id: r.text for r in found} == plain_boilerplate(rows)
            assert any(r.text != o.text for r, o in zip(sorted(found, key=lambda r: r.doc_id), rows, strict=True))
        if name == "near_dedup":
            groups = brute_components([re.sub("[A-Z]", lambda m: m[0].lower(), r.text) for r in rows], 5)
            assert {r.doc_id for r in found} == {rows[root].doc_id for _, root in groups.values()} and len(found) < len(rows)
        if name == "mix_sources":
            assert sorted((r.doc_id, r.text) for r in found) == plain_mix(rows)
        kept = out
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    rows, final = kept.collect(), stages["encode"](spark, kept, data).collect()
    assert sorted((r.doc_id, r.pieces) for r in final) == sorted((r.doc_id, model.encode(r.text)) for r in rows)
    assert all(r.decoded_equal and r.n_pieces == len(r.pieces) for r in final)
    # and the whole as one query
    whole = queries.pipeline(spark, data).collect()
    assert sorted((r.doc_id, r.source, r.pieces) for r in whole) == sorted((r.doc_id, r.source, r.pieces) for r in final)


def test_rare_toxic_words_are_found_in_long_texts(spark):
    """Whole words tell what four-letter windows cannot: in any script, however long the text around them."""
    r = random.Random(3)
    usual = ["".join(r.choice("абвгдежзиклмноп") for _ in range(6)) for _ in range(300)] + ["的一", "是不", "了人"]
    rude = ["клопдаг", "зажибок"]
    rows = []
    for i in range(900):
        toxic = i % 6 == 0
        text = [r.choice(usual) for _ in range(400)]
        if toxic:
            text[r.randrange(400)] = r.choice(rude)
        rows.append((i, " ".join(text), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.score(table.select("doc_id", "text"), table.select("doc_id", "toxic"), lambda c: langid.fold(c, 3) != 1).collect()
    held = [x for x in found if __import__("zlib").crc32(str(x.doc_id).encode()) % 3 == 1]
    assert len(found) == 900 and np.mean([(x.score >= 0.7) == rows[x.doc_id][2] for x in held]) > 0.95


def test_every_word_of_every_document_is_counted(spark):
    rows = [(i, f"only{chr(97 + i % 26)}{chr(97 + i // 26)} shared shared" + (" bad" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(40)]
    counts = {x.key: (x.n0, x.n1) for x in toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int")).collect()}
    key = lambda w: next(toxicity.words(pa.array([w])))[3][0]
    assert len(counts) == 42 and counts[key("bad")] == (0, 10) and counts[key("shared")] == (30, 10) and counts[key("onlyba")] == (1, 0)


def thue_morse(n, first="a", second="b"):
    return "".join((first, second)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_sums_of_powers_confuse(spark, n):
    """Thue-Morse words and their complements have equal sums of powers modulo 2**64 for every base."""
    one, other = thue_morse(n), thue_morse(n, "b", "a")
    around = [f"w{i}" for i in range(40)]
    texts = [" ".join([*around[:20], word, *around[20:]]) for word in (one, other, one)] + [one, other, " ".join(one), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: tuple(r)[1:] for r in substring.digest(substring.drop_repeats(docs)).collect()}
    assert found == dict(enumerate(substring.brute_force(texts)))
    for k in (4, 5, 50):
        linked = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, k).collect()}
        assert linked == brute_components(texts, k)
    assert all(r.decoded_equal for r in pieces.encode_texts(docs).collect())
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    assert pieces.Encoder(pieces.load()).encode(pa.array(texts)).to_pylist() == [model.encode(t) for t in texts]


def test_hashes_tell_apart_what_differs():
    r = random.Random(6)
    words = list({"".join(r.choice("ab\0") for _ in range(r.randint(1, 70))) for _ in range(20_000)}) + [thue_morse(64, *p) for p in ("ab", "ba")]
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    for seed in (0, 1):
        assert len(np.unique(_text.span_hashes(raw, starts, ends, seed))) == len(set(words))
    tokens = _text.span_hashes(raw, starts, ends)[[int(c) for c in thue_morse(4096, "0", "1")]]
    first, last = np.array([0, 2048, 0, 1024]), np.array([2048, 4096, 1024, 2048])
    assert len(np.unique(_text.sequences(tokens, first, last))) == 4
    for k in (1, 2, 3, 5, 35, 64):
        assert (_text.rolling(tokens, k) == _text.sequences(tokens, np.arange(4097 - k), np.arange(k, 4097))).all()


@pytest.mark.parametrize("window", [1, 2, 64, 100])
def test_windows_of_any_length(spark, window):
    r = random.Random(window)
    base = [r.choice(["a", "b", "c"]) + str(r.randrange(9)) for _ in range(400)]
    texts = [" ".join(base[:250]), " ".join(["x", *base[100:]]), " ".join(base[r.randrange(200) :][:150]), "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: tuple(r)[1:] for r in substring.digest(substring.drop_repeats(docs, window)).collect()}
    assert found == dict(enumerate(substring.brute_force(texts, window)))


def test_texts_under_one_doc_id_are_documents_of_their_own(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(7, same, "a"), (7, "another text altogether that shares no words with it", "b"), (7, same + " ", "c"), (None, same, "d"), (None, "only here without an id", "e"), (3, "x y z", "f"), (3, None, "g"), (3, "", "h"), (9, same, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, which string")
    for parts in (1, 5):
        kept = minhash.keep_one(docs.repartition(parts))
        assert kept.columns == docs.columns
        found = sorted(r.which for r in kept.collect())
        assert found in (["a", "b", "e", "f", "g", "h"], ["b", "c", "e", "f", "g", "h"])
        assert parts == 1 or found == before
        before = found


@pytest.mark.parametrize("start", [False, True])
def test_links_are_computed_once(spark, start):
    seen = spark.sparkContext.accumulator(0)
    pairs = [(k, k + 1) for k in range(1, 9)] + [(20, 21), (30, 29)]

    def run(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    links = spark.createDataFrame(pairs, "a long, b long").mapInArrow(run, "a long, b long")
    labels = spark.createDataFrame([(5, 5), (20, 5), (40, 40), (41, 40)], "id long, component long") if start else None
    found = {r.id: r.component for r in minhash.components(links, labels).collect()}
    assert found == dict.fromkeys(range(1, 10), 1) | ({20: 1, 21: 1, 40: 40, 41: 40} if start else {20: 20, 21: 20}) | {29: 29, 30: 29}
    assert seen.value == len(pairs)


def test_columns_are_appended_a_part_of_a_batch_at_a_time(spark):
    texts = [None if k % 7 == 3 else chr(97 + k % 26) * (k * 9_001) for k in range(60)] + ["z" * (_text.PART_BYTES + 5), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)

    def sizes(column):
        held = int(_text.utf8(column)[1][-1])
        return [pa.array([None if v is None else len(v) for v in column.to_pylist()], pa.int64()), pa.array([held] * len(column), pa.int64())]

    rows = _text.append(docs, "text", "size long, held long", sizes).collect()
    assert [(r.id, r.text, r.size) for r in rows] == [(k, t, None if t is None else len(t)) for k, t in enumerate(texts)]
    assert max(r.held for r in rows) <= _text.PART_BYTES + 5


def test_links_of_buckets_are_pairs_of_components(spark):
    """What a group of near copies hands on does not grow with its pairs of sets, and few tables are written for it."""
    shingles = {k: np.sort(np.arange(100, dtype=np.uint64) + np.uint64(k % 3)) for k in range(12)} | {k: np.arange(100, dtype=np.uint64) + np.uint64(1000) for k in (20, 21)}
    component = {k: 0 if k < 6 else 6 for k in range(12)} | {20: 20, 21: 21}
    sets = spark.createDataFrame([(k, 100, bytearray(s.tobytes())) for k, s in shingles.items()], "id long, n long, shingles binary")
    placed = spark.createDataFrame([(band, k, c) for band in (1, 2) for k, c in component.items()], "band long, id long, component long")
    assert {tuple(r) for r in minhash._across(placed, sets, 80).collect()} == {(0, 6), (20, 21)}


def test_near_duplicates_writes_few_tables(spark, monkeypatch):
    written, write = [], minhash.materialize
    monkeypatch.setattr(minhash, "materialize", lambda df: written.append(df.columns) or write(df))
    words = [f"w{k}" for k in range(120)]
    texts = [" ".join([*words[:119], f"x{k}"]) for k in range(20)] + [" ".join(words[k:] + words[:k]) for k in (60, 61)] + ["alone", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 4).collect()}
    assert found == brute_components(["" if t is None else t for t in texts], 4)
    assert len(written) <= 18, written


def test_pairs_of_repeated_ids_are_verified_once(spark):
    """Rows that share a doc_id all come back from the join to their sets; a pair kept once for each of them would meet them all again."""
    sets = spark.createDataFrame([(k, 10, 0, 0, 0, 0) for k in (1, 2) for _ in range(5)], "id long, n long, s0 long, s1 long, s2 long, s3 long")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert [tuple(r) for r in minhash._possible(pairs, sets, 80).collect()] == [(1, 2)]
