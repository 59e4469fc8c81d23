"""Nulls in any column, empty and very long texts, repeated rows, empty tables, clashing extra columns: each has a defined result."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ridgeline.llm import ann, langid, licenses, lines, media, minhash, mixing, pieces, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["score", "key", "row", "size", "bucket", "lang_pred", "n_words", "taken", "id", "own", "packed", "site", "pieces", "component", "a.b", "_row", "target", "place", "w", "log_ratio", "_n", "_taken", "_cut", "_kept", "__hashes", "n_lines", "n_dropped"]
LONG = " ".join(random.Random(7).choice(["lorem", "ipsum", "dolor", "sit", "amet", "été"]) + str(i % 977) for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43), (2, "The quick brown fox jumps over the lazy dog", "en", "b", 43),
    (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \n\t ", "fr", "a", 4), (6, LONG, "la", "b", len(LONG)), (7, "one", None, "c", 3),
    (8, "12345 !!! 😀", "en", None, 12), (9, "Released under the MIT License.", "en", "c", 31), (9, "Released under the MIT License.", "en", "c", 31), (None, "le chat est sur la table", "fr", "a", 24),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in EXTRA:
        df = df.withColumn(name, F.lit(1))
    return df.cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_mixing(docs, nothing):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    sums = {}
    for r in rows:
        s = sums.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.taken
        s[1] += r["size"]
    assert all(taken == int(target) and size == source_size for taken, size, target, source_size in sums.values())
    assert {r.doc_id: r.taken for r in rows}[3] == 0
    assert mixing.mix(nothing).count() == 0 and mixing.mix_texts(nothing).count() == 0
    mixed = mixing.mix_texts(docs)
    assert mixed.columns == docs.columns
    part = max(r.taken for r in rows if r.doc_id is None)
    found = [r for r in mixed.collect() if r.doc_id is None]
    assert sum(len(r.text.split()) for r in found) == part and all(r["_cut"] == r["_taken"] == 1 for r in found)


def test_mixed_texts_hold_the_words_taken(spark):
    rows = [(i, " ".join(f"w{i}.{k}\n" for k in range(1 + i % 7)), "en", f"s{i % 3}", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    words = dict.fromkeys(taken, 0)
    for r in mixing.mix_texts(docs).collect():
        assert rows[r.doc_id][1].startswith(r.text)
        words[r.doc_id] += len(r.text.split())
    assert words == taken


def test_targets_by_resharing(spark):
    """The level is what resharing the excess again and again comes to."""
    sizes = {"a": 10, "b": 1000, "c": 70, "d": 5, "e": 0, None: 400}
    found = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted((s for s in sizes if s), key=str) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, capped = 1.5 * sum(sizes.values()), {}, {}
    while True:
        left = total - sum(capped.values())
        free = [s for s in order if s not in capped]
        target = capped | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            break
        capped |= {s: 2.0 * sizes[s] for s in over}
    assert found == pytest.approx(target)


def test_minhash(docs, nothing):
    rows = minhash.near_duplicates(docs, 4).collect()
    assert len(rows) == len(ROWS)
    found = {r.doc_id: r for r in rows}
    assert (found[1].component_id, found[2].component_id, found[2].kept) == (1, 1, False)
    assert found[3].n_shingles == found[4].n_shingles == found[5].n_shingles == 0
    assert found[3].kept and found[4].kept and found[5].kept
    assert found[7].n_shingles == 1 and found[None].component_id is None and found[None].kept
    assert minhash.near_duplicates(nothing).count() == 0
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8, 9]


def test_pieces(docs, nothing):
    rows = pieces.encode_texts(docs).collect()
    assert len(rows) == len(ROWS) and all(r.decoded_equal for r in rows)
    assert {r.doc_id: r.n_pieces for r in rows}[3] == 0
    assert pieces.encode_texts(nothing).count() == 0
    again = pieces.decode_pieces(pieces.encode_texts(docs).select("doc_id", "text", "pieces"))
    assert all((r.text or "") == r.decoded for r in again.collect())


def test_language(docs, nothing):
    model = langid.fit(docs)
    found = langid.predict(docs, model)
    assert set(docs.columns) | {"score"} == set(found.columns)
    rows = by_id(found)
    assert (rows[3].lang_pred, rows[3].score) == ("und", 0.0)
    assert all(rows[i].lang_pred == "und" for i in (3, 4, 5, 8))
    assert rows[None].lang_pred == "fr" and 0 <= rows[6].score <= 1
    empty = langid.fit(nothing)
    assert empty.languages == () and langid.predict(nothing, empty).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


def test_licenses(docs, nothing):
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(ROWS)
    found = {r.doc_id: r for r in rows}
    assert (found[9].n_base, found[9].first_word, found[9].last_word, found[9].base_labels, found[9].score) == (1, 1, 1, "mit", 1.0)
    assert (found[3].n_words, found[3].labels, found[3].first_word) == (0, "", None)
    assert licenses.scan(nothing).count() == 0


def test_media(docs, nothing):
    rows = media.text_media(docs).collect()
    assert len(rows) == len(ROWS)
    found = {r.doc_id: r for r in rows}
    assert found[3].payload_bytes == 64 and found[3].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest() == found[4].payload_sha256
    assert found[6].n_bytes == len(LONG.encode()) and found[6].payload_sha256 == hashlib.sha256(media.pad(LONG.encode())).hexdigest()
    assert media.text_media(nothing).count() == 0


def test_substring(docs, nothing):
    rows = substring.digest(substring.drop_repeats(docs, window=5)).collect()
    expected = substring.brute_force([r[1] for r in ROWS], 5)
    key = lambda x: (str(x[0]), *map(str, x[1:]))
    assert sorted(map(key, map(tuple, rows))) == sorted(map(key, ((r[0], *e) for r, e in zip(ROWS, expected, strict=True))))
    assert substring.drop_repeats(nothing).count() == 0


def test_lines(docs, nothing):
    text = "\n".join(["menu", "body {}", "menu"])
    pages = docs.sparkSession.createDataFrame([(i, "h" if i < 9 else None, text.format(i)) for i in range(12)] + [(12, "h", None), (13, "h", ""), (14, "other", "menu")], "page long, host string, text string")
    rows = {r.page: r for r in lines.drop_boilerplate(pages, "host", "text").collect()}
    assert rows[0].text == "body 0" and (rows[0].n_lines, rows[0].n_dropped) == (3, 2)
    assert rows[10].n_dropped == 0 and rows[12].text is None and rows[12].n_lines == 0 and rows[13].text == "" and rows[14].text == "menu"
    assert lines.drop_boilerplate(nothing, "source", "text").count() == 0
    assert lines.drop_boilerplate(docs, "source", "text").count() == len(ROWS)
    assert {(r["_kept"], r["__hashes"]) for r in lines.drop_boilerplate(docs, "source", "text").collect()} == {(1, 1)}


@pytest.mark.parametrize("pages", [1, 2, 3, 10, 100])
def test_the_ratio_alone_decides(spark, pages):
    """At any size of a site: more than a twentieth of the pages, and a line of one page is no repetition."""
    rows = [(i, "s", "\n".join(["everywhere", *(["half"] if i % 2 else []), *(["twice"] if i < 2 else []), f"own {i}"])) for i in range(pages)]
    found = {r.page: r.text.split("\n") for r in lines.drop_boilerplate(spark.createDataFrame(rows, "page long, site string, text string"), "site", "text").collect()}
    for line in ("everywhere", "half", "twice"):
        n = sum(line in r[2].split("\n") for r in rows)
        assert sum(line in t for t in found.values()) == (0 if n > 1 and n > lines.RATIO * pages else n)
    assert all(f"own {i}" in found[i] for i in range(pages))


def test_operators_leave_no_table_behind_that_their_result_does_not_read(docs):
    import glob
    import re

    from ridgeline.llm import _store
    from ridgeline.sources import scratch

    def there():
        return {re.search("ridgeline-[0-9a-f]{32}", x)[0] for x in glob.glob(f"{scratch.shared_dir(docs.sparkSession)}/ridgeline-*")}

    labels = docs.sparkSession.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    for operator in (minhash.near_duplicates, minhash.keep_one, substring.drop_repeats, media.text_media, lambda d: toxicity.score(d, labels)):
        before = there()
        out = operator(docs)
        assert there() - before == _store._tables(out) & (there() - before) and out.count() > 0
    assert not _store._scopes.made


def test_no_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from ridgeline.sources import scratch

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://a:7077", getConf=lambda: conf)))


def test_stages_keep_the_columns_of_documents(docs, nothing):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(docs.sparkSession, docs, "")
        assert out.columns == docs.columns, name
        assert {tuple(r[c] for c in EXTRA) for r in out.collect()} <= {(1,) * len(EXTRA)}, name
        assert stage(docs.sparkSession, nothing, "").count() == 0


def test_toxicity(docs, nothing):
    labels = docs.sparkSession.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 1), (7, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.score(nothing, labels).count() == 0


def test_ann(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(i, [float(i % 3), 1.0, float(i), 0.5]) for i in range(1, 30)] + [(40, None), (41, [0.0] * 4), (42, [nan, 1.0, 1.0, 1.0]), (43, [inf, 1.0, 1.0, 1.0]), (44, [None, 1.0, 1.0, 1.0]), (45, []), (46, [1.0]), (None, [1.0] * 4), (5, [2.0, 1.0, 5.0, 0.5]), (50, [2.0, 1.0, 29.0, 0.5])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    rows = ann.search(table, table.filter("vec_id IN (5, 41, 42)"), nearest_k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in rows] == [(5, 1, 29), (5, 2, 50), (5, 3, 28)]
    assert rows[0].score == rows[1].score
    assert ann.search(table.limit(0), table).count() == 0 and ann.search(table, table.limit(0)).count() == 0
    assert len(ann.search(table, table.filter("vec_id = 1"), nearest_k=100).collect()) == 29


def test_copies_do_not_make_their_own_lines_boilerplate(spark):
    copied = "first line of the copied page\nsecond line of it"
    rows = [(i, copied if i < 20 else f"menu\nbody number {i} {i * i}", "en", "s", None) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert len(found) == 60 and all(found[i] == (copied if i < 20 else f"body number {i} {i * i}") for i in found)
    kept = [r for r in corpus_pipeline.near_dedup(spark, corpus_pipeline.line_dedup(spark, docs, ""), "").collect() if r.doc_id < 20]
    assert [r.text for r in kept] == [copied]


def test_rows_without_doc_id_take_their_own_part(spark):
    rows = [(None, "one", "en", "a", 3), (None, "w " * 2000, "en", "b", None), *((None, f"x{i} y", "en", "b", 4) for i in range(9)), *((7, f"p{i} q r", "en", "c", 7) for i in range(9)), (8, "z", "en", "c", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken, words, most = {}, {}, {}
    for r in mixing.mix(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for r in mixing.mix_texts(docs).collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
        most[r.text] = most.get(r.text, 0) + 1
    assert words == {s: n for s, n in taken.items() if n} and most.get("one", 0) <= 2


def test_documents_without_any_label_stay(docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    out = corpus_pipeline.language(docs.sparkSession, bare, "")
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, (1, 2, 6, 7, 9, 9, None)))
