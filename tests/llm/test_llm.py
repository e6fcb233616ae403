"""The training-data operators against brute force, round trips and held-out accuracy; odd inputs."""

import hashlib
import itertools
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from eventloom.llm import common, covertree, licenses, linededup, merkle, packing, pseudolm, quality, queries, simhash, tokencounts, unigram
from eventloom.llm.common import connected_components

DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n\n", "en", "a", 4), (4, "same text here and more of it", None, None, None), (5, "same text here and more of it", "en", "a", 1), (5, "same text here and more of it", "en", "a", 1),
    (6, "x" * 50_000, "en", "a", 1), (7, "wide words " * 5_000, "en", "a", 1), (8, "Ünï ▁ <|endoftext|> 漢字 İΣ İ", "de", "a", 1), (None, "without an id", "en", "a", 1), (9, "MIT License\nReleased under the MIT license.", "en", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS).withColumns({c: F.lit(7) for c in ("sid", "line", "bucket", "node", "key", "part", "features", "length")}).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, tmp_path, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        db.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    queries.QUERIES[name](spark, DIR).write.parquet(f"{tmp_path}/out")
    ours, theirs = db.sql(f"select * from '{tmp_path}/out/*.parquet'").df(), db.sql(queries.ORACLES[name]).df()
    canon = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert sorted(ours.columns) == sorted(theirs.columns) and canon(ours) == canon(theirs)


# --- 1


def test_top_k_brute_force(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).round(1)
    v[50:60] = v[40]
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [1.0, 2.0]), (None, [1.0] * 8)]
    got = covertree.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 7, block_rows=64, query_rows=8)
    q = np.floor(64 * v).astype(int)
    want = []
    for i in range(0, 300, 20):
        s = q @ q[i]
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:7]
        want += [(i, k + 1, j, int(s[j])) for k, j in enumerate(order)]
    assert rows(got, "query_id", "rank") == want
    few = covertree.top_k(spark.createDataFrame(data[:4], "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 7)
    assert few.count() == 3
    assert covertree.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).count() == 0


def test_cover_tree_invariants():
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(k * 9, 1, (200, 3)) for k in range(4)] + [np.ones((90, 3))])
    t = covertree.CoverTree.build(np.arange(len(p)), p)
    assert sorted(t.ids.tolist()) == list(range(len(p)))
    for i in range(len(t.start)):
        d = np.sqrt(((t.points[t.start[i] : t.end[i]] - t.points[t.center[i]]) ** 2).sum(1))
        assert d.max() <= t.radius[i] + 1e-9
        kids = range(t.first[i], t.first[i] + t.count[i])
        assert not len(kids) or sum(t.end[k] - t.start[k] for k in kids) == t.end[i] - t.start[i]


def test_huge_components_are_exact(spark):
    big = float(2**24)
    data = [(0, [big, 1 / 64]), (1, [big, 3 / 64]), (2, [big, 4 / 64]), (3, [big, 5 / 64]), (4, [-big, 5 / 64])]
    got = covertree.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 3)
    assert [(r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(3, 2**60 + 5), (2, 2**60 + 4), (1, 2**60 + 3)]
    over = [(0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [-1e30, 1.0])]
    got = covertree.top_k(spark.createDataFrame(over, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 2)
    assert [(r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(1, 2**63 - 1), (2, 1 - 2**63)]


def test_top_k_leaves_out_block_pairs(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(12, 16)) * 20
    v = np.concatenate([c + rng.normal(size=(100, 16)) * 0.3 for c in centers])
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    pairs, never = covertree.block_pairs(frame, F.col("vec_id") % 20 == 0, 5, block_rows=64)
    assert pairs > 100 and never > 0.5 * pairs
    got = covertree.top_k(frame, F.col("vec_id") % 20 == 0, 5, block_rows=64)
    q = np.floor(64 * v).astype(int)
    want = []
    for i in range(0, len(v), 20):
        s = q @ q[i]
        order = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-s[j], j))[:5]
        want += [(i, n + 1, j, int(s[j])) for n, j in enumerate(order)]
    assert rows(got, "query_id", "rank") == want


# --- 2


def brute_lines(docs, t=0.8):
    """Removed (row, line) for docs [(order, text)], by comparing every line with every earlier one."""
    seen, gone = [], set()
    for key, text in sorted(docs, key=lambda d: d[0]):
        for i, line in enumerate((text if text is not None else "").split("\n") if text is not None else []):
            ws = frozenset(w for w in line.lower().replace("\t", " ").replace("\r", " ").split(" ") if w)
            if ws:
                if any(len(ws & o) >= t * len(ws | o) - 1e-9 for o in seen):
                    gone.add((key, i))
                seen.append(ws)
    return gone


@pytest.mark.parametrize("settings", [{}, {"_NEAR": 1}, {"_MARGIN": -1000}, {"_MARGIN": -1000, "_FEW": 0}])
def test_line_dedup_brute_force(spark, monkeypatch, settings):
    """Also where near copies are chained first, and where what is chained turns out not to be alike."""
    for k, v in settings.items():
        monkeypatch.setattr(linededup, k, v)
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    base = [rng.choice(words, 3 + k % 70).tolist() for k in range(40)]
    docs = []
    for d in range(60):
        out = []
        for _ in range(3):
            line = list(base[rng.integers(40)])
            for _ in range(rng.integers(0, 3)):
                line[rng.integers(len(line))] = str(rng.choice(words))
            out.append(" ".join(line))
        docs.append((d, "\n".join(out)))
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    gone = brute_lines(docs)
    for doc_id, text, n, removed in rows(got.select("doc_id", "text", "n_lines", "n_removed"), "doc_id"):
        lines = dict(docs)[doc_id].split("\n")
        left = [x for i, x in enumerate(lines) if (doc_id, i) not in gone]
        assert (text, n, removed) == ("\n".join(left), len(lines), len(lines) - len(left))


def test_line_dedup_odd(odd, none):
    got = linededup.dedup_lines(odd)
    assert got.count() == len(ODD) and linededup.dedup_lines(none).count() == 0
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["text"] is None and by[2]["text"] == "" and by[5]["text"] == "" and by[4]["n_removed"] == 0 and by[3]["text"] == " \t\n\n"


def test_line_dedup_sets_meet_by_size(spark):
    """Sets of every size share their rarest word and 80 % at most of the others: those whose sizes cannot match do not meet, and no pair is lost, however
    the words are dealt to parts."""
    sizes = list(range(5, 205))
    data = [(n, n, n, [7, *range(1000, 1000 + n // 5)], True) for n in sizes]
    sets = spark.createDataFrame(data, "sid long, n int, doc_order long, prefix array<int>, open boolean").withColumns({"bits": F.lit(0).cast("long"), "more": F.lit(None).cast("long")})
    larger, smaller = linededup._sides(sets, 0.8, 0, 1)
    at_seven = lambda df, s: df.where(F.col(f"before{s}") == -1)
    met = at_seven(larger, "_x").join(at_seven(smaller, "_y"), "key").count()
    want = {(x, y) for x in sizes for y in sizes if y < x and y >= 0.8 * x - 1e-9}
    assert len(want) < met < 0.35 * len(sizes) ** 2
    for parts in (1, 3):
        got = {tuple(r) for k in range(parts) for r in linededup.similar_pairs(sets, 0.8, k, parts).collect()}
        assert got == want


def test_line_dedup_compiles_the_words_of_lines(spark, documents):
    """Only the lines are exploded: within explode() Spark interprets what it does for each word."""
    plan = linededup._lines(documents.select("doc_id", "text"), 0.8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and plan.count("Generate ") == 1


# --- 3


def test_token_counts(spark, documents, texts, odd, none):
    enc = tokencounts.encoding(__import__("public_tokenizers").path(tokencounts.VOCABULARY))
    n = sorted(len(enc.encode_ordinary(t or "")) for t in texts.values())
    table = tokencounts.length_table(tokencounts.encoded_lengths(documents))
    got = rows(table, "length")
    assert [(r[0], r[1]) for r in got] == sorted(Counter(n).items())
    for r in got:
        assert r[3] == sum(x <= r[0] for x in n) and r[4] == sum(x for x in n if x <= r[0]) and r[5] == sum(x > r[0] for x in n) and r[6] == sum(min(x, r[0]) for x in n) and r[7] == len(n) and r[8] == sum(n)
    limits = [0, 1, 100, 512, 10**9]
    assert rows(tokencounts.truncated_totals(table, limits), "context_limit") == [(k, sum(x > k for x in n), sum(min(x, k) for x in n)) for k in limits]
    assert tokencounts.quantiles(table, [0.5, 1.0]) == [n[-(-len(n) // 2) - 1], n[-1]]
    assert tokencounts.length_table(tokencounts.encoded_lengths(odd)).agg(F.sum("n_docs")).first()[0] == len(ODD) and tokencounts.length_table(tokencounts.encoded_lengths(none)).count() == 0


# --- 4


def test_gradients():
    rng = np.random.default_rng(0)
    net = pseudolm.WindowNet.begin(rng.random(pseudolm.VOCABULARY) * 100)
    net = pseudolm.WindowNet(*[p.astype(float) for p in net.parts()])
    target, around = rng.integers(0, pseudolm.VOCABULARY, 40), rng.integers(0, pseudolm.VOCABULARY + 1, (40, 4))
    for p, g in zip(net.parts(), net.gradients(target, around), strict=True):
        at, e = np.unravel_index(np.argmax(np.abs(g)), g.shape), 1e-4
        was = p[at]
        p[at] = was + e
        up = -net.log_probability(target, around).mean()
        p[at] = was - e
        down = -net.log_probability(target, around).mean()
        p[at] = was
        assert np.isclose((up - down) / (2 * e), g[at], rtol=1e-3)


def test_probabilities_sum_to_one():
    net = pseudolm.WindowNet.begin(np.random.default_rng(0).random(pseudolm.VOCABULARY) * 100)
    every = np.arange(pseudolm.VOCABULARY)
    p = net.log_probability(every, np.tile([3, 4, 5, 6], (len(every), 1)))
    assert np.isclose(np.exp(p).sum(), 1, atol=1e-4)


def test_windows():
    t, a, of = pseudolm.windows([np.array([1, 2, 3], np.int32), np.array([], np.int32), np.array([4], np.int32)])
    o = pseudolm.VOCABULARY
    assert t.tolist() == [1, 2, 3, 4] and of.tolist() == [0, 0, 0, 2] and a.tolist() == [[o, o, 2, 3], [o, 1, 3, o], [1, 2, o, o], [o, o, o, o]]


def brute_likelihood(text, model):
    """The sum of log p of a text's words: a dense softmax over the whole vocabulary for each place, and each spelling cell by cell."""
    net, words = model.net, pseudolm.words_of(text)
    at = {w: i for i, w in enumerate(model.words)}
    ids = [at.get(w, pseudolm.VOCABULARY - pseudolm.BUCKETS + pseudolm.bucket_of(w)) for w in words]
    pad = [pseudolm.VOCABULARY]
    total = 0.0
    for k, (w, i) in enumerate(zip(words, ids, strict=True)):
        h = net.bias.astype(float)
        for gate, r in zip(net.gate, pseudolm.REACH, strict=True):
            h = h + net.embed[(ids[k + r : k + r + 1] or pad)[0] if k + r >= 0 else pad[0]] * gate
        h = np.tanh(h)
        z = h @ net.to_class + net.class_bias
        per = pseudolm.VOCABULARY // pseudolm.CLASSES
        y = h @ net.to_word[i // per] + net.word_bias[i // per]
        total += z[i // per] - np.log(np.exp(z).sum()) + y[i % per] - np.log(np.exp(y).sum())
        if w not in at:
            total += model.spelling.log_probability([w])[0]
    return total


def test_training_helps_and_odd(spark, documents, odd, none):
    model = pseudolm.train(documents)
    counted = {r["doc_id"]: r for r in pseudolm.score(documents, model).collect()}
    start = pseudolm.ScoringModel(model.words, model.spelling, pseudolm.fit_vocabulary(documents)[2])
    before = pseudolm.score(documents, start).agg(F.sum("log_likelihood")).first()[0]
    assert sum(r["log_likelihood"] for r in counted.values()) > before
    texts = dict(documents.select("doc_id", "text").collect())
    assert all(counted[d]["n_words"] == len(pseudolm.words_of(t)) for d, t in texts.items())
    for d in sorted(texts)[::20]:
        assert np.isclose(counted[d]["log_likelihood"], brute_likelihood(texts[d], model), rtol=1e-4)
    got = pseudolm.score(odd, model).collect()
    assert len(got) == len(ODD) and next(r for r in got if r["doc_id"] == 1)["mean_log_likelihood"] is None
    assert pseudolm.score(none, pseudolm.train(none)).count() == 0


def test_training_helps_unseen_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    unseen = documents.where("doc_id % 10 = 3")
    seen = documents.join(unseen.select(F.xxhash64("text").alias("k")), F.xxhash64("text") == F.col("k"), "left_anti")
    words, spelling, begin, total = pseudolm.fit_vocabulary(seen)
    net = pseudolm.fit_network(pseudolm.encoded(seen, words, spelling), begin, total)
    coded = pseudolm.encoded(unseen, words, spelling)
    mean = lambda n: pseudolm.score_encoded(coded, n).agg(F.sum("log_likelihood") / F.sum("n_words")).first()[0]
    assert mean(net) > mean(begin) + 0.02
    # words that are not words score below nearly all documents, also where they share an ending
    rng = np.random.default_rng(3)
    made = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    odd = [(1, " ".join(made(8) for _ in range(300))), (2, " ".join(made(6) + "ing" for _ in range(300)))]
    model = pseudolm.ScoringModel(words, spelling, net)
    scores = sorted(r["mean_log_likelihood"] for r in pseudolm.score(unseen.where("n_chars > 200"), model).collect())
    for r in pseudolm.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect():
        assert r["mean_log_likelihood"] < scores[len(scores) // 20]


def test_layout_does_not_matter(spark, documents, monkeypatch):
    monkeypatch.setattr(pseudolm, "TRAINER_WORDS", 10_000)
    got = [dict(rows(pseudolm.score(documents.repartition(n), pseudolm.train(documents.repartition(n))).select("doc_id", "mean_log_likelihood"), "doc_id")) for n in (1, 8, 64)]
    for d, v in got[0].items():
        assert all((v is None and g[d] is None) or abs(v - g[d]) < 1e-5 for g in got[1:])


def test_every_place_is_trained():
    net = pseudolm.WindowNet.begin(np.ones(pseudolm.VOCABULARY))
    ids = [np.arange(n, dtype=np.int16).tobytes() for n in (3, 0, 50, 7)]
    docs = pa.RecordBatch.from_arrays([pa.array([0, 0, 1, 1]), pa.array(ids, pa.binary())], ["trainer", "ids"])
    (got,) = pseudolm._train(net.flat(), net, 0.1)(iter([docs]))
    assert got.column(0).to_pylist() == [60]


def test_spelling_is_a_distribution():
    rng = np.random.default_rng(0)
    cells = np.unique(rng.integers(0, pseudolm._CONTEXTS * pseudolm._CHARACTERS, 5000))
    p = np.exp(pseudolm.Spelling.of(cells, rng.integers(1, 9, len(cells))).log_p.reshape(pseudolm._CONTEXTS, -1).astype(float))
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    words = ["a", "zebra", "ab\u0000c", "漢字", "x" * 500]
    assert np.isfinite(pseudolm.Spelling.of(cells, np.ones(len(cells))).log_probability(words)).all()


# --- 5


def test_packing(spark, documents, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for d, x in texts.items()}
    got = packing.pack(documents).toPandas()
    assert got["length"].sum() == sum(map(len, ids.values())) and (got["length"] > 0).all()
    for d, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        assert g["start"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and (g["doc_tokens"] == len(ids[d])).all()
        assert all(zlib.crc32(ids[d][s : s + n].tobytes()) == c for s, n, c in zip(g["start"], g["length"], g["ids_crc32"], strict=True))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 4096


def test_packing_odd(odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    got = packing.pack(odd).toPandas()
    assert got["length"].sum() == sum(len(t.encode(x[1] or "", add_special_tokens=False).ids) + 1 for x in ODD)
    assert packing.pack(none).count() == 0


def test_chunks_equal_whole_texts():
    enc = packing.ChunkEncoder(packing.vocabulary_path(packing.VOCABULARY), limit=5, extra=3)
    said = ["Don't STOP é é ﬁ", "a\x1cb c\x85d e", "x<|startoftext|>y <|endoftext|>", "İstanbul ΣΑΣ ß", "1234 !!?? $%", "漢字 kana かな", "naïve café"]
    want = [np.array(e.ids, "<u4").tobytes() for e in enc.whole.encode_batch(said, add_special_tokens=False)]
    assert list(enc.encode(said * 3)) == want * 3


def test_plain_words_need_no_pattern():
    path = packing.vocabulary_path(packing.VOCABULARY)
    enc, seen = packing.ChunkEncoder(path), []
    whole, pattern = enc.whole, enc.pattern
    enc.pattern = type("Pattern", (), {"findall": lambda self, c: seen.append(c) or pattern.findall(c)})()
    texts = ["Plain WORDS don't x2 s t re ve", "caf\u00e9 \u0130I words, <|x|> \u017ft \u00aa"]
    assert [np.frombuffer(b, np.uint32).tolist() for b in enc.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert seen and not any(c.isascii() and c.isalpha() for c in seen)


def test_first_fit_decreasing():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 60, 300).tolist()
    bins, offsets, held = packing.first_fit_decreasing(sizes, 100)
    room: list[int] = []
    for k in sorted(range(300), key=lambda i: -sizes[i]):
        b = next((i for i, r in enumerate(room) if r >= sizes[k]), None)
        if b is None:
            room.append(100)
            b = len(room) - 1
        assert (bins[k], offsets[k]) == (b, 100 - room[b])
        room[b] -= sizes[k]
    assert held == [100 - r for r in room]


# --- 6


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got["quality"] == 1]["score"].to_numpy(), got[got["quality"] == 0]["score"].to_numpy()
    assert ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2) > 0.9
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in quality.score_quality(docs, labels).select("doc_id", "held_out").limit(50).collect())


def test_quality_reads_no_held_out_label(spark, odd, none):
    docs = spark.createDataFrame([(i, ("bad !! " if i % 2 else "fine words. ") * (5 + i % 7)) for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows(quality.score_quality(docs, labels), "doc_id") == rows(quality.score_quality(docs, flipped), "doc_id")
    got = quality.score_quality(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_quality(none, labels).count() == 0 and quality.score_quality(odd, labels.where("false")).first()["score"] == 0.5
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_quality_chooses_the_smallest_hashes(spark):
    labels = spark.range(9000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    every = rows(labels.where(~quality.held_out()).select(F.xxhash64("doc_id").alias("h"), "doc_id"), "h")
    for most in (10, 700, 8000):
        assert sorted(r["doc_id"] for r in quality.chosen_labels(labels, most).collect()) == sorted(d for _, d in every[:most])


# --- 7


def test_license_places_brute_force(odd, none):
    got = {(r["doc_id"]): r for r in licenses.scan_licenses(odd).collect()}
    assert got[9]["n_words"] == 7 and got[9]["n_base"] == 2 and (got[9]["first_word"], got[9]["last_word"]) == (0, 5) and got[9]["base_labels"] == "mit" and got[9]["labels"] == "mit,mit-notice"
    assert got[1]["n_words"] == 0 and got[1]["labels"] == "" and got[1]["first_word"] is None and licenses.scan_licenses(odd).count() == len(ODD)
    assert licenses.scan_licenses(none).count() == 0


def test_license_templates_threshold(spark):
    t = {"a b c d e": "five", "x y": "two"}
    docs = spark.createDataFrame([(0, "a b c d q"), (1, "a b c q\nd e"), (2, "y x"), (3, "x"), (4, "e d c b a a a"), (5, "a b c 1 2 3 4 d e"), (6, "y z z x")], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(docs, licenses.PHRASES, t, 0.8).collect()}
    assert got == {0: ("five", 0.8), 1: ("five", 1.0), 2: ("two", 1.0), 3: ("", 0.0), 4: ("five", 1.0), 5: ("", 0.0), 6: ("", 0.0)}


def test_license_notices_over_lines(spark, odd):
    docs = spark.createDataFrame([(0, "x\n  Redistribution and use in source and binary forms, with or without\n# modification, are permitted"), (1, "You may not use this file\nexcept in compliance with\nthe License.")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs).collect()} == {0: "bsd-notice", 1: "apache-terms"}
    for phrases, templates in (({}, {}), (licenses.PHRASES, {}), ({}, {"...": "none"})):
        got = licenses.scan_licenses(odd, phrases, templates).collect()
        assert len(got) == len(ODD) and all(r["labels"] == r["base_labels"] for r in got)


def test_license_blocks_brute_force(spark):
    rng = np.random.default_rng(3)
    t = {"a b c d e a": "six", "b x y": "three", "c e f g h i j k": "eight"}
    texts = [" ".join(rng.choice(list("abcdefghijkxyz"), rng.integers(0, 60))) for _ in range(60)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), {}, t, 0.7).collect()}
    for i, text in enumerate(texts):
        ws, best = text.split(), {}
        for name, label in t.items():
            said = name.split()
            size, n = -(-len(said) * 10 // 7), len(set(said))
            most = max((len(set(ws[o : o + size]) & set(said)) for o in range(len(ws))), default=0)
            if most >= 0.7 * n - 1e-9:
                best[label] = most / n
        assert got[i]["labels"] == ",".join(sorted(best)) and got[i]["score"] == pytest.approx(max(best.values(), default=0))


# --- 8


def brute_segment(m, unit):
    pieces = {p.replace(unigram.MARK, " ").encode(): i for i, p in enumerate(m.pieces) if p and i not in m.byte_set}
    best = [(0.0, [])] + [None] * len(unit)
    for j in range(1, len(unit) + 1):
        for i in range(j):
            if best[i] is None:
                continue
            own = []
            if unit[i:j] in pieces:
                own.append((m.score[pieces[unit[i:j]]], [pieces[unit[i:j]]]))
            try:
                if len(unit[i:j].decode()) == 1:
                    own.append(((j - i) * m.byte_score, [m.byte_id[b] for b in unit[i:j]]))
            except UnicodeDecodeError:
                pass
            for s, ids in own:
                if best[j] is None or best[i][0] + s > best[j][0] + 1e-12:
                    best[j] = (best[i][0] + s, best[i][1] + ids)
    return best[-1]


def test_viterbi_brute_force():
    m = unigram.model(unigram._path(None))
    units = [" hello", " unbelievable", "漢字x", " Zürich", "\n", " ab\x01", "   q", " internationalization", " ▁"]
    many = m.viterbi_many([u.encode() for u in units])
    for u, (ids, s) in zip(units, many, strict=True):
        want = brute_segment(m, u.encode())
        assert np.isclose(s, want[0]) and m.viterbi(u.encode()) == (ids, s)


def test_sentencepiece_looks_up_new_units_only():
    m = unigram.Unigram(["", "a", "b", MARK := "\u2581", *(f"<{b}>" for b in range(256))], {b: 4 + b for b in range(256)})
    assert MARK == unigram.MARK

    def fastest():
        took = []
        for _ in range(9):
            began = time.perf_counter()
            m.encode(["a b ab"])
            took.append(time.perf_counter() - began)
        return min(took)

    first = m.encode(["a b ab"])
    small = fastest()
    m.table |= {f" {i}": (b"", 0.0) for i in range(500_000)}
    assert fastest() < 20 * small
    assert [(ids.tolist(), score) for ids, score in m.encode(["a b ab"])] == [(ids.tolist(), score) for ids, score in first]


def test_sentencepiece_round_trip(spark, documents, odd, none):
    coded = unigram.encode(documents)
    assert coded.where("not round_trip").count() == 0
    back = {r["doc_id"]: r["text"] for r in unigram.decode(coded).collect()}
    assert back == {r["doc_id"]: r["text"] for r in documents.collect()}
    got = unigram.encode(odd)
    assert got.count() == len(ODD) and got.where("not round_trip").count() == 0 and unigram.encode(none).count() == 0


# --- 9


def test_simhash_brute_force(spark, documents, texts):
    got = {r["doc_id"]: r for r in simhash.simhash_groups(documents).collect()}
    prints = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints[d] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0
    assert all(got[d]["fp0"] % 2**64 == p for d, p in prints.items())
    group = {d: d for d in prints}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for a, b in itertools.combinations(sorted(prints), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 2:
            x, y = sorted((root(a), root(b)))
            group[y] = x
    assert all(got[d]["component_id"] == root(d) for d in prints)


@pytest.mark.parametrize("distance,segments", [(0, 1), (1, 2), (2, 2), (3, 2), (3, 4), (5, 4)])
def test_hamming_links_are_all(spark, distance, segments):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 2**63, 12, dtype=np.int64)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(6):
            x = int(b)
            for k in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(k)
            prints.add(x - 2**64 if x >= 2**63 else x)
    want = {(a, b) for a, b in itertools.product(prints, prints) if a < b and bin((a ^ b) % 2**64).count("1") <= distance}
    got = rows(simhash.hamming_links(spark.createDataFrame([(p,) for p in prints], "fp long"), distance, segments), "a", "b")
    assert len(got) == len(set(got)) and set(got) == want


def test_simhash_odd(odd, none):
    got = {(r["doc_id"]): r for r in simhash.simhash_groups(odd).collect()}
    assert got[1]["fp0"] == 0 and got[3]["component_id"] == 1 and got[5]["component_id"] == 4 and got[None]["component_id"] is None
    assert simhash.simhash_groups(odd).count() == len(ODD) and simhash.simhash_groups(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 100), (7, 7), (300, 7)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "u long, v long")), "node"))
    assert all(got[i] == 0 for i in [*range(51), 300]) and got[100] == got[200] == 100
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def plans_run(spark, work):
    """The plans, as they ran in the end, of all that work() has run."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(60_000)
    runs = lambda: {(x := store.executionsList().apply(i)).executionId(): x.physicalPlanDescription() for i in range(store.executionsList().size())}
    before = set(runs())
    work()
    bus.waitUntilEmpty(60_000)
    return [plan for k, plan in runs().items() if k not in before]


def test_keep_one_broadcasts_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "_FEW", 0, raising=False)
    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine ten {i % 7} {'x ' * (i % 3)}") for i in range(60)], "doc_id long, text string")
    kept = plans_run(spark, lambda: simhash.keep_one_of_each_group(docs).collect())
    assert any("SortMergeJoin" in p for p in kept) and not any("BroadcastHashJoin" in p for p in kept)


def test_simhash_broadcasts_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "_FEW", 0, raising=False)
    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine ten {i % 7} {'x ' * (i % 3)}") for i in range(60)], "doc_id long, text string")
    found = plans_run(spark, lambda: simhash.simhash_groups(docs).collect())
    assert any("SortMergeJoin" in p for p in found) and not any("BroadcastHashJoin" in p for p in found)


def test_keep_one_of_each_group(spark, odd, none):
    rng = np.random.default_rng(9)
    base = [" ".join(f"{w}" for w in rng.integers(0, 5000, 120)) for _ in range(8)]
    near = [b.split() for b in base]
    for n in near:
        n[60] = "changed"
    docs = [(i, b) for i, b in enumerate(base)] + [(20 + i, " ".join(n)) for i, n in enumerate(near)] + [(40 + i, b) for i, b in enumerate(base)]
    got = simhash.keep_one_of_each_group(spark.createDataFrame(docs, "doc_id long, text string"))
    assert [r["doc_id"] for r in got.orderBy("doc_id").collect()] == list(range(8))
    kept = simhash.keep_one_of_each_group(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "4", "6", "7", "8", "9", "None"])
    assert simhash.keep_one_of_each_group(none).count() == 0


def test_keep_one_repeated_phrase(spark):
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    docs = []
    for i in range(10):
        base, slogan = words(300), words(12)
        docs += [(i, f"{base} {slogan}"), (20 + i, base + f" {slogan}" * 16)]
    got = simhash.keep_one_of_each_group(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(10))


def test_keep_one_brute_force(spark):
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    texts = []
    for i in range(80):
        n = int(rng.integers(5, 14)) if i % 2 else 200
        base = words(n)
        texts += [base, base[:-1]]
        if n == 200:
            for changed in (3, 4, 5):
                at = set((rng.choice(33, changed, False) * 6 + 3).tolist())
                texts.append([f"x{rng.integers(10**6)}" if k in at else w for k, w in enumerate(base)])
    texts += [["To"] * 60 + words(12) for _ in range(4)]
    texts += [t[:-1] for t in texts[-3:]]
    sets = [set(simhash.shingle_hashes(" ".join(t), 5).tolist()) for t in texts]
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) - 1e-9 and group[i] != group[j]:
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = [new if g == old else g for g in group]
    got = simhash.keep_one_of_each_group(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(group)) and len(set(group)) < len(texts)


@pytest.mark.parametrize("share", [0, 0.5])
def test_shingle_prefixes_meet(share):
    rng = np.random.default_rng(6)
    often = np.sort(rng.integers(0, 400, 200).astype(np.uint64)) if share else np.empty(0, np.uint64)
    for _ in range(2000):
        one = rng.choice(400, rng.integers(1, 60), False).astype(np.uint64)
        two = np.concatenate([one[int(len(one) * rng.random() * 0.25) :], rng.integers(1000, 2000, rng.integers(0, 12)).astype(np.uint64)])
        one, two = np.unique(one), np.unique(two)
        common = len(np.intersect1d(one, two))
        if common >= 0.8 * (len(one) + len(two) - common) - 1e-9:
            assert len(np.intersect1d(simhash.shingle_prefix(one, 0.8, often), simhash.shingle_prefix(two, 0.8, often)))


# --- 10


def leaves(t):
    return [(x.short, x.size) for s in t[1] for p in s.children for x in p.children]


def brute_near(a, b):
    """Bounds of the likeness: no more than any order of equal leaves allows, no less than the longest common start."""
    x, y = leaves(merkle.tree(a)), leaves(merkle.tree(b))
    size = len(a) + len(b)
    most = sum(k * n for (_, n), k in (Counter(x) & Counter(y)).items())
    start = 0
    for p, q in zip(x, y, strict=False):
        if p != q:
            break
        start += p[1]
    return (2 * start / size, 2 * most / size) if size else (1.0, 1.0)


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_merkle_brute_force(spark, documents, texts, buckets):
    ids = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in merkle.edit_fingerprints(documents, buckets).collect()}
    for i, d in enumerate(ids):
        t, nxt = texts[d] or "", texts[ids[(i + 1) % len(ids)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["fingerprint"] == merkle.fingerprint_string(merkle.tree(t))
        assert np.isclose(r["near_edited"], merkle.likeness(merkle.parse(r["fingerprint"]), merkle.parse(r["edited_fingerprint"])))
        assert (r["near_edited"] == 1) == (edited == t) and (r["near_next"] == 1) == (t == nxt)
        for near, other in ((r["near_edited"], edited), (r["near_next"], nxt)):
            low, high = brute_near(t, other)
            assert low - 1e-9 <= near <= high + 1e-9


def test_merkle_alignment_brute_force():
    """On one level, as many characters are matched as by a longest common subsequence where no line repeats."""
    rng = np.random.default_rng(8)
    for _ in range(30):
        lines = [f"line {k} {rng.integers(10**6)}." for k in range(25)]
        other = [x for x in lines if rng.random() > 0.2]
        other[5:5] = ["new line."]
        other = other[::-1] if rng.random() < 0.1 else other
        best = np.zeros((len(lines) + 1, len(other) + 1))
        size = lambda k: len(lines[k]) + (k + 1 < len(lines))
        for i in range(len(lines)):
            for j in range(len(other)):
                same = lines[i] == other[j] and (i + 1 < len(lines)) == (j + 1 < len(other))
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + 1 if same else 0)
        a, b = merkle.tree("\n".join(lines)), merkle.tree("\n".join(other))
        near, edits = merkle.compare(a, b)
        assert len(other) - len(edits) == best[-1, -1] and 0 <= near < 1


def test_merkle_tree_and_edits(odd, none):
    a = "Head.\n\nOne line. Two, three.\nLast line.\n\nEnd."
    assert "".join(p for s in merkle.sections(a) for p in s) == a
    b = a.replace("Last", "Lost")
    assert merkle.tree(a)[0] != merkle.tree(b)[0] and merkle.locate_edits(a, b) == [(1, 1)] and merkle.locate_edits(a, a) == []
    many = "\n".join(f"Paragraph {k}." for k in range(40))
    assert merkle.locate_edits(many, "New.\n" + many) == [(0, 0)]
    plain = " ".join(f"w{k}" for k in range(3000))
    assert "".join(merkle.phrases(plain)) == plain and len(merkle.phrases(plain)) > 100
    assert 0.9 < merkle.likeness(merkle.tree(plain), merkle.tree(plain.replace("w1500", "changed"))) < 1
    assert "".join(merkle.phrases("x" * 50_000)) == "x" * 50_000 and "".join(merkle.phrases(" " * 500)) == " " * 500
    assert merkle.edit_fingerprints(odd).count() == len(ODD) and merkle.edit_fingerprints(none).count() == 0
    assert merkle.edit_fingerprints(odd.where("doc_id = 9")).first()["near_next"] == 1.0


# --- pipeline


def test_pipeline(spark, documents):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "lines", "near_duplicates", "packing"]
    docs = documents
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == documents.columns and 0 < out.count() <= docs.count()
        docs = out
    assert p.run(spark, DIR).count() > 0


def test_pipeline_odd_rows(spark, documents, none):
    """Each stage on nulls, empty and long texts, repeated rows and clashing names: the rows that stay, as brute force has them."""
    import corpus_pipeline as p

    line = "one two three four five six seven eight"
    rows_ = [*ODD, (20, f"{line}\nquite another line of words here", "en", "a", 0), (21, f"{line} nine\n{line}", "en", "a", 0), (22, "quite another line of words here", "en", "a", 0)]
    clash = ("removed", "doc_order", "text_key", "n_lines", "n_removed", "left", "row", "line", "size", "node", "fp", "g", "k")
    docs = spark.createDataFrame(rows_, COLUMNS).withColumns({c: F.lit(77) for c in clash}).repartition(4)
    kept = p.quality(spark, docs, DIR)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    out = p.lines(spark, docs, DIR)
    assert out.columns == docs.columns and out.where(" and ".join(f"`{c}` = 77" for c in clash)).count() == len(rows_)
    last = (1 << 63) - 1
    order = {(last if r[0] is None else r[0], r[1]): r[1] for r in rows_}
    gone = brute_lines([((k[0], k[1] or ""), t) for k, t in order.items()])
    for r in out.collect():
        key = last if r["doc_id"] is None else r["doc_id"]
        texts = {t for (d, t) in order if d == key}
        (text,) = texts
        want = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if ((key, text), i) not in gone)
        assert r["text"] == want and r["n_chars"] == (None if want is None else len(want))
    one = p.near_duplicates(spark, docs, DIR)
    assert one.columns == docs.columns and one.where(" and ".join(f"`{c}` = 77" for c in clash)).count() == one.count()
    ids = [r["doc_id"] for r in one.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and 3 not in ids and 4 in ids and 5 not in ids
    assert p.packing(spark, docs, DIR).where("length > 0").count() >= len(rows_)
    for _, stage in p.STAGES:
        assert stage(spark, none, DIR).count() == 0


def test_quality_scores_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.1, 300) > 0.8).astype(float)
    m = quality.PairGam().fit(x, y)
    for row, got in zip(x[:40], m.score(x[:40]), strict=True):
        z = m.intercept + sum(t[sum(c < v for c in cuts)] for t, cuts, v in zip(m.tables, m.cuts, row, strict=True))
        z += sum(t[sum(c < row[f] for c in m.pair_cuts[f]), sum(c < row[e] for c in m.pair_cuts[e])] for t, (f, e) in zip(m.pair_tables, m.chosen, strict=True))
        assert np.isclose(got, 1 / (1 + np.exp(-z)))
