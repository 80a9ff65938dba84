"""Edge cases and brute-force versions of the training-data operators."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from compare import assert_same
from conftest import SF
from pyspark.sql import functions as F

from docpair.llm import bpe, line_dedup, media, mixing, near_dedup, quality, queries, sharding, suffix_dedup, topk, toxicity

DOCS = "doc_id long, text string, source string, lang string, n_lines int, score string"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, sources[i] if sources else f"s{i % 3}", "en", 7, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(rng.choices(words, k=80)) for _ in range(6)]
    texts = [None, "", " ", "é", "a\n\nb", "x" * 30_000, "same line of more than twenty\nz", "Same line of more than twenty \ny", "same line of more than twenty\nx"]
    texts += base + base[:2] + [b[:200] + " new tail " + b[260:] for b in base] + [f"head {k} " + base[0][20:180] for k in range(5)]
    texts += [base[1].replace("w1 ", "W1\t")] + ["tiny text"] * 4
    return texts


@pytest.mark.parametrize("name", queries.ORACLE)
def test_matches_sql(spark, name):
    assert_same(spark, SF, queries.QUERIES[name], queries.ORACLE[name])


def test_line_dedup(spark, odd):
    out = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(docs_of(spark, odd)).collect()}
    assert out[6]["text"] == "z" and out[7]["text"] == "y" and out[8]["text"] == "same line of more than twenty\nx"
    assert out[0]["text"] == "" and out[0]["n_lines"] == 1 and out[4]["n_dropped"] == 0
    assert line_dedup.drop_repeated_lines(docs_of(spark, odd).limit(0)).count() == 0
    assert line_dedup.drop_repeated_lines(docs_of(spark, odd)).columns == ["doc_id", "text", "source", "lang", "score", "n_lines", "n_dropped"]


@pytest.mark.parametrize("common", [4096, 1])
def test_line_dedup_against_plain_python(spark, monkeypatch, common):
    monkeypatch.setattr(line_dedup, "COMMON", common)
    rng = random.Random(8)
    lines = ["", "short", *(f"a line of words number {i}" for i in range(12)), "\tA Line of Words number 3  ", "ÀLL of the words are here now", "àll of the words are here now"]
    rows = [(rng.choice([None, *range(40)]), "\n".join(rng.choices(lines, k=rng.randint(1, 9)))) for _ in range(60)]
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held: dict = {}
    for i, t in rows:
        for x in t.split("\n"):
            held.setdefault(key(x), set()).add(i)
    last = {k: max(v, key=lambda i: -1 if i is None else i) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    want = [(i, "\n".join(x for x in t.split("\n") if last.get(key(x), i) == i), t.count("\n") + 1, sum(last.get(key(x), i) != i for x in t.split("\n"))) for i, t in rows]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    order = lambda r: (-1 if r[0] is None else r[0], *map(str, r[1:]))
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=9).tolist() for _ in range(130)]
    vectors[3] = vectors[4] = vectors[5]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [1.0]), (None, [1.0]), (204, [float("inf")])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 10 == 3).toPandas()
    x = {i: np.floor(256 * np.pad(np.array(v), (0, 9 - len(v)))).astype(int) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    want = [(q, r + 1, c, s) for q in x if q % 10 == 3 for r, (s, c) in enumerate(sorted(((int(x[q] @ x[c]), c) for c in x if c != q), key=lambda p: (-p[0], p[1]))[:5])]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 3).count() == 0
    big = spark.createDataFrame([(0, [1e12, 2.0]), (1, [1e12, -3.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(big, F.col("vec_id") == 0).orderBy("rank").first()["score"] == 2**63 - 1


def test_media_round_trip(spark, odd):
    payloads = [media.payload_of(t) for t in odd] + [bytes(192), b"\xff" * 384, bytes(range(192)), bytes(random.Random(1).randrange(256) for _ in range(192 * 50)) * 180]
    back = [b"".join(f["thumb"].tobytes() for f in frames) for frames in media.thumbnails(media.store(payloads))]
    assert back == payloads
    out = media.with_features(media.with_media(docs_of(spark, odd))).select("doc_id", "features.*").toPandas().set_index("doc_id")
    for i, t in enumerate(odd):
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert p == media.payload_of(t)
        assert (out.loc[i, "payload_bytes"], out.loc[i, "payload_sha256"], out.loc[i, "tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))


def test_media_reads_ac_coefficients_and_colour():
    """A 16 x 16 4:2:0 image of one unit, with AC coefficients, written by hand."""
    dc, ac = {2: (0, 3), 3: (4,)}, {1: (0,), 3: (0x01, 0xF0, 0x21)}
    code = lambda table, s: "{:0{}b}".format(*media._codes(table)[s])
    block = lambda diff, n: code(dc, n) + (f"{diff if diff > 0 else diff + (1 << n) - 1:0{n}b}" if n else "") + code(ac, 0x01) + "1" + code(ac, 0xF0) + code(ac, 0x21) + "0" + code(ac, 0)
    bits = block(5, 3) + block(-4, 3) + block(9, 4) + block(0, 0) + block(7, 3) + block(-7, 3)
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    frame = bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    head = b"\xff\xd8" + media._segment(0xDB, bytes([0] + [16] * 64)) + media._segment(0xC0, frame) + media._huffman(0, dc) + media._huffman(16, ac) + media._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    [[shot]] = media.thumbnails([head + data + b"\xff\xd9"])
    assert (shot["width"], shot["height"]) == (16, 16)
    assert shot["thumb"].tolist() == [[128 + 2 * 5, 128 + 2 * 1], [128 + 2 * 10, 128 + 2 * 10]]


def test_bpe_equals_the_library(spark, odd):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    library, own, decoder = Tokenizer.from_file(path), bpe.Bpe(path), bpe.Decoder(path)
    rng = random.Random(5)
    bits = ["a", "B", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "é", "1", "²", "!", "'s", "'re", "<|endoftext|>", "<|", "中", "😀", "́", "\r\n", "\x00"]
    texts = [t or "" for t in odd] + ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(400)] + ["a" * 3000, " " * 700]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids
        assert decoder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)
    docs = docs_of(spark, odd)
    whole = bpe.decode(bpe.encode(docs, path), path).toPandas()
    assert all(d == (t or "") for d, t in zip(whole["decoded"], whole["text"], strict=True))
    assert bpe.round_trip(docs.limit(0), path).count() == 0


def brute_near(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    low = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low[a] = min(low[a], low[b])
    return {i: (len(sets[i]), low[i], low[i] == i) for i in range(len(texts))}


def test_near_dedup(spark, odd):
    got = near_dedup.near_duplicates(docs_of(spark, odd)).toPandas()
    assert {r[0]: tuple(r[1:]) for r in got.itertuples(index=False, name=None)} == brute_near(odd)
    assert near_dedup.near_duplicates(docs_of(spark, odd).limit(0)).count() == 0


def test_sharding(spark, odd):
    got = sharding.shard_rows(docs_of(spark, odd), 4).toPandas()
    assert len(got) == len(odd)
    counts = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1 and (counts["min"] == 0).all() and (counts["nunique"] == counts["count"]).all()
    for n in (1, 2, 3, 17, 1000):
        assert sorted(sharding.permuted(np.arange(n), n, 1)) == list(range(n))
    raw = [(t or "").encode() for t in odd]
    order = sorted(range(len(odd)), key=lambda i: i)  # ids are told apart by themselves
    got = got.set_index("doc_id")
    for number, i in enumerate(order):
        left, right, half = None, number, max(1, ((len(odd) - 1).bit_length() + 1) // 2)
        keys = [int(k) for k in np.random.Generator(np.random.PCG64(17)).integers(0, 1 << 62, sharding.ROUNDS)]
        while left is None or number >= len(odd):
            left, right = number >> half, number & (1 << half) - 1
            for k in keys:
                x = (right + k) * 0x9E3779B97F4A7C15 % 2**64
                x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 % 2**64
                left, right = right, left ^ (x ^ x >> 32) & (1 << half) - 1
            number = left << half | right
        assert (got.loc[i, "shard"], got.loc[i, "slot"]) == (number % 4, number // 4)
        assert (got.loc[i, "size"], got.loc[i, "text_crc32"], got.loc[i, "law"]) == (len(raw[i]) + 16, zlib.crc32(raw[i]), "rows")
    twice = docs_of(spark, odd).union(docs_of(spark, odd))
    assert sharding.shard_rows(twice, 4).select("shard", "slot").distinct().count() == 2 * len(odd)
    assert sharding.shard_rows(twice.limit(0)).count() == 0


def test_lexicon_finds_misspelled_words():
    lexicon = toxicity.Lexicon([("trash", False, 2.0), ("worthless", False, 3.0), ("achlich", True, 1.5), ("scum", False, 1.0)])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(3000):
        word = list(rng.choice(["trash", "worthless", "scum", "other"]))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(1, len(word)) if len(word) > 1 else 0
            word[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "s"])
        word = "".join(word)
        want = max([w for t, w, e in (("trash", 2.0, 1), ("worthless", 3.0, 2), ("scum", 1.0, 0)) if word[:1] == t[0] and 0 < distance(word[1:], t[1:]) <= e], default=0.0)
        assert lexicon.match(word)[1] == want, word
    assert lexicon.match("achlichkeit") == (1.5, 0.0) and lexicon.match("scum")[0] == 1.0


def test_classifiers_hold_out(spark, odd):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("aeiourtnls", k=rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        words, bad = rng.choices(vocabulary, k=60), i % 5 == 0
        if bad:
            words[rng.randrange(60)] = rng.choice(["grumpf", "zornig", "grumpff"])
        elif i % 5 == 1:
            words[10:12] = ['"grumpf"', "said"]
        rows.append((i, " ".join(w.upper() + "!!" if i % 4 == 0 else w for w in words)))
        labels.append((i, int(i % 4 != 0), int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known = lab.where("doc_id < 400")
    for scored, column in ((toxicity.with_toxicity(docs, toxicity.learn(docs, known)), "toxic"), (quality.with_quality(docs, quality.learn(docs, known)), "quality")):
        got = scored.join(lab, "doc_id").where("doc_id >= 400").toPandas()
        assert (got["predicted"] == got[column]).mean() > 0.93
    strange = docs_of(spark, odd)
    for scored in (toxicity.with_toxicity(strange, toxicity.learn(docs, lab.limit(0))), quality.with_quality(strange, quality.learn(docs, lab.limit(0)))):
        assert scored.where("score between 0 and 1 and predicted in (0, 1)").count() == len(odd)


def test_mixing(spark, odd):
    sources = [None if i % 4 == 3 else f"s{i % 4}" for i in range(len(odd))]
    docs = docs_of(spark, odd, sources)
    plan = mixing.copies_by_document(docs).toPandas()
    assert len(plan) == len(odd) and plan["copies"].between(0, 3).all() and (plan["taken"] == plan["size"] * plan["copies"]).all()
    assert mixing.mix_sources(docs).count() == plan["copies"].sum()
    assert mixing.copies_by_document(docs.limit(0)).count() == 0
    lone = mixing.copies_by_document(docs_of(spark, ["a b"] * 6, ["a", "a", "a", "b", "b", None])).toPandas()
    assert lone.groupby(lone["source"].fillna("~")).target.first().tolist() == [2.0, 4.0, 6.0]


def test_mixing_balances_draws_by_size(spark, monkeypatch):
    rng = random.Random(6)
    docs = docs_of(spark, [" ".join(["w"] * rng.randint(1, 300)) for _ in range(400)], [f"s{rng.choice([0, 0, 0, 1, 2])}" for _ in range(400)])
    plan = mixing.copies_by_document(docs).toPandas().sort_values("doc_id")
    near = plan.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((near.taken - near.target).abs() < 0.02 * near.target).all()
    hashed = lambda key: int(hashlib.md5(f"mix-3:{key}".encode()).hexdigest()[:13], 16)
    for name, group in plan.groupby("source"):
        rate = min(group.target.iloc[0] / group.source_size.iloc[0], 3.0)
        whole, part = int(rate), int((rate - int(rate)) * 2**52)
        bins: dict = {}
        for doc, size in zip(group.doc_id, group["size"], strict=True):
            bins.setdefault((int(size).bit_length(), int(size) >> max(int(size).bit_length() - 3, 0)), []).append((hashed(doc), doc))
        at, more = hashed(f"source:{name}"), set()
        for _, found in sorted(bins.items()):
            k = (at + part * len(found)) // 2**52 - at // 2**52
            at += part * len(found)
            more |= {doc for _, doc in sorted(found)[:k]}
        assert [whole + (d in more) for d in group.doc_id] == group.copies.tolist(), name
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert mixing.copies_by_document(docs).toPandas().sort_values("doc_id").taken.tolist() == plan.taken.tolist()


def test_mixing_gives_each_document_the_stated_probability(spark):
    """300 sources of one document each: the share of copies is near the rate's fraction, whatever its side of a half."""
    docs = docs_of(spark, ["a b c d e f g h i"] * 300, [f"s{i:03}" for i in range(300)])
    plan = mixing.copies_by_document(docs, (4, 10, 13)).toPandas()
    for rate, group in plan.groupby((plan.target / plan.source_size).round(3)):
        share = (group.copies - int(rate)).mean()
        assert len(group) == 100 and abs(share - rate % 1) < 0.15, (rate, share)


def test_mixing_odd_tables(spark):
    rows = [(1, None, None, 5), (1, None, None, 5), (None, "a b", "s", 1), (None, "", "s", 2), (4, "word " * 40_000, "long", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(2)
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.where("source is null").count() == 0
    plan = mixing.copies_by_document(docs)
    assert plan.count() == 5 and mixed.count() == plan.agg(F.sum("copies")).first()[0]
    none = spark.createDataFrame([(1, None, "s"), (2, " ", None)], "doc_id long, text string, source string")
    assert mixing.copies_by_document(none).agg(F.sum("copies")).first()[0] == 0 and mixing.mix_sources(none).count() == 0


def brute_strings(texts, n=suffix_dedup.LENGTH):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - n + 1):
            if raw[p : p + n] in seen:
                gone[p : p + n] = True
        seen |= {raw[p : p + n] for p in range(len(raw) - n + 1)}
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[i] = (kept, len(raw), len(raw) - len(kept), int(np.diff(np.concatenate(([0], gone.astype(int)))).clip(0).sum()))
    return out


@pytest.mark.parametrize(("hot", "piece", "deal"), [(4096, 1 << 17, 1 << 23), (2, 1 << 17, 1 << 23), (4096, 100, 1 << 10)])
def test_suffix_dedup(spark, odd, hot, piece, deal, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "CHUNK", piece)
    monkeypatch.setattr(suffix_dedup, "DEAL", deal)
    got = suffix_dedup.drop_repeated_strings(docs_of(spark, odd)).collect()
    assert {r["doc_id"]: (bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got} == brute_strings(odd)
    assert suffix_dedup.drop_repeated_strings(docs_of(spark, odd).limit(0)).count() == 0


def test_suffix_dedup_of_ids_that_are_null_or_repeated(spark):
    long = "".join(f"word{i} " for i in range(40))
    rows = [(None, long[:80]), (3, long), (3, long[40:] + "tail"), (3, long), (7, "head " + long[:60]), (None, long[20:80])]
    got = suffix_dedup.drop_repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    removed = lambda i: sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got if r["doc_id"] == i)
    assert removed(None) == [(60, 0, 0), (80, 0, 0)]  # one document, smaller than any other
    assert removed(3) == sorted([(len(long), 80, 1)] * 2 + [(len(long) - 36, 0, 0)])
    assert removed(7) == [(65, 60, 1)]


def test_suffix_array_is_sorted():
    rng = random.Random(4)
    for text in ("banana" * 30, "a" * 100, "".join(rng.choices("ab", k=500)), "x"):
        data = np.frombuffer(text.encode() + bytes(64), np.uint8)
        order = suffix_dedup.suffix_array(data, len(text))
        assert sorted(order) == list(range(len(text)))
        got = [text[i : i + 50].encode() for i in order]
        assert got == sorted(got)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    out = corpus_pipeline.run(spark, SF)
    assert isinstance(out.toPandas(), pd.DataFrame) and out.count() > 0


def test_quality_is_a_plain_convolution(spark, odd):
    rng = np.random.default_rng(7)
    net = quality.Network(rng.normal(0, 0.3, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), rng.normal(0, 0.2, quality.FILTERS).astype(np.float32), rng.normal(0, 0.2, 2 * quality.FILTERS).astype(np.float32), -0.3)
    got = {r["doc_id"]: r["score"] for r in quality.with_quality(docs_of(spark, odd), net).collect()}
    seg, span, step = quality.SEGMENT, quality.SPAN, quality.STEP
    for i, t in enumerate(odd):
        raw = (t or "").encode()
        n = -(-(len(raw) + quality.WIDTH) // seg)
        padded = np.frombuffer(raw + bytes(n * seg + quality.WIDTH - len(raw)), np.uint8)
        response = np.array([sum(net.tables[j][padded[p + j]] for j in range(quality.WIDTH)) for p in range(n * seg)]) + net.bias
        starts = range(0, max(n - span, 0) + step, step) if n > span else [0]
        starts = [s for k, s in enumerate(starts) if k == 0 or starts[k - 1] + span < n]
        chunks = np.array([np.maximum(response[s * seg : min(s + span, n) * seg], 0).max(0) for s in starts])
        x = np.concatenate([chunks.max(0), chunks.mean(0)])
        assert abs(got[i] - 1 / (1 + np.exp(-(x @ net.out + net.base)))) < 1e-4, i


def test_empty_and_repeated_labels(spark, odd):
    docs = docs_of(spark, odd)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    repeated = spark.createDataFrame([(9, 1, 1), (9, 1, 1), (10, 0, 0), (None, 1, 1), (9999, 1, 1), (11, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, repeated):
        for scored in (toxicity.with_toxicity(docs, toxicity.learn(docs, labels)), quality.with_quality(docs, quality.learn(docs, labels))):
            assert scored.where("score between 0 and 1").count() == len(odd) and "lang" in scored.columns
    assert toxicity.with_toxicity(docs.limit(0), toxicity.learn(docs.limit(0), none)).count() == 0
    assert quality.with_quality(docs.limit(0), quality.learn(docs.limit(0), none)).count() == 0


def test_copies_of_whole_documents_are_not_listed(spark, monkeypatch):
    """A text that a smaller document has goes as a whole, and the passes over the texts skip it."""
    text = " ".join(f"stone {i * i} rivers" for i in range(40))
    rows = [(5, text), (3, text), (9, text), (None, "x" * 60), (7, "x" * 60), (3, text), (4, "Before it " + text[:200]), (8, "short"), (1, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.drop_repeated_strings(docs).collect()), key=str)
    n = len(text)
    want = [(5, n, n, 1), (3, n, 0, 0), (9, n, n, 1), (None, 60, 0, 0), (7, 60, 60, 1), (3, n, 0, 0), (4, 210, 200, 1), (8, 5, 0, 0), (1, 5, 0, 0)]
    assert got == sorted(want, key=str)
    long = docs.where(F.octet_length("text") >= 50).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), F.col("text").alias("t")).withColumn("print", F.xxhash64("t")).withColumn("own", F.xxhash64("doc", "print"))
    copies, asked = suffix_dedup.copies_of(long)
    assert sorted(r["doc"] for r in copies.collect()) == [5, 7, 9]
    assert set(suffix_dedup._asked(long.toPandas(), asked)["doc"]) == {3, 4, -(2**63)}
