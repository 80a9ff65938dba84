"""Thumbnail hashes of texts that fill several frames."""

from docpair.llm import media


def test_hashes_see_all_frames(spark):
    head, tail = "some words " * 150_000, 60_000
    texts = [head + "a" * tail, head + "z" * tail, head + "az" * (tail // 2), head[:90]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    out = {r["doc_id"]: r["features"] for r in media.with_features(media.with_media(docs)).collect()}
    assert [out[i]["frames"] for i in range(4)] == [2, 2, 2, 1]
    assert len({out[i]["feature"] for i in range(3)}) > 1 and len({out[i]["payload_sha256"] for i in range(3)}) == 3
    for i, t in enumerate(texts):
        [frames] = media.thumbnails(media.store([media.payload_of(t)]))
        whole = [v for f in frames for v in f["thumb"].tolist()]
        rows = [k * len(whole) // 8 for k in range(8)] + [len(whole)]
        means = []
        for a, b in zip(rows, [max(b, a + 1) for a, b in zip(rows, rows[1:])]):
            for c in range(8):
                part = [v for r in whole[a:b] for v in r[c * 24 : c * 24 + 24]]
                means.append(sum(part) // len(part))
        bits = "".join("1" if 64 * m >= sum(means) else "0" for m in means)
        assert out[i]["ahash"] == f"{int(bits, 2):016x}"
