"""MinHash near-dedup with sequential Bayesian verification.

Documents become sets of hashed word shingles. Equal sets are one node, so exact copies are never compared. Nodes get a
MinHash signature and meet in banded buckets. Candidates are compared a batch of hashes at a time: after m matches among
n hashes, a pair is dropped once the posterior probability that its similarity reaches the threshold is under `miss`
(uniform prior). Survivors are verified exactly on their full sets. Links are joined into components.

Pairs within a bucket are never all emitted. First every member meets its bucket's leader, the member that shares most
buckets, so a group around one text is joined by as many pairs as it has members. In a bucket that still holds several
components, members outside of its largest component are guests: they visit the blocks of all its members, while pairs
within the largest component are settled and never meet. A task holds the signatures and the sets (32 bits a shingle) of one block of
guests and one of members, and emits a link for each two components it joins. These links are verified on full sets; if
one of them fails, which takes colliding hashes, the blocks meet again with 64 bits a shingle, as full sets have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, cut, discarded, stored

SHINGLE, BANDS, ROWS, BATCH = 5, 32, 3, 16
HASHES = BANDS * ROWS
BLOCK, GROUP = 2048, 8192  # nodes in a block, rows in a task's group of block pairs
BLOCK_SHINGLES, GROUP_SHINGLES = 2**22, 2**22  # about so many shingles in them at most, at 4 or 8 bytes each
TURN = 64  # candidates of a guest that are compared on their sets at once
_RNG = np.random.default_rng(20240229)
A = (_RNG.integers(0, 2**31, HASHES, dtype=np.int64) * 2 + 1).astype(np.uint32)
B = _RNG.integers(0, 2**32, HASHES, dtype=np.int64).astype(np.uint32)
P, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingle_set(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; of all words together, if these are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(len(w), SHINGLE)
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * P + w[k : len(w) - n + 1 + k]
    h ^= h >> np.uint64(31)
    h *= MIX
    h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each of HASHES hash functions over the set."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(out, (x[at : at + 1024, None] * A + B).min(0), out=out)
    return out


def prune_below(threshold: float, miss: float) -> list[int]:
    """For 1, 2 ... batches of hashes: the matches below which a pair's posterior probability of reaching the threshold is under miss."""
    grid = (np.arange(4000) + 0.5) / 4000
    least = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            density = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(density - density.max())
            if density[grid >= threshold].sum() >= miss * density.sum():
                break
        least.append(m)
    return least


def _survive(left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs of signatures (rows of both) pass every batch."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, enough in enumerate(least):
        s = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (left[alive, s] == right[alive, s]).sum(1)
        keep = matches >= enough
        alive, matches = alive[keep], matches[keep]
    return alive


def _packed(bits: int):
    """Adds words (sorted, the high bits of each shingle) to nodes with texts and signatures."""
    kind = np.uint32 if bits == 32 else np.uint64

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for pdf in batches:
            words = [(shingle_set(t, hashes) >> np.uint64(64 - bits)).astype(kind).tobytes() for t in pdf["t"]]
            yield pd.DataFrame({"node": pdf["node"], "signature": pdf["signature"], "words": words})

    return work


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), np.uint32).reshape(-1, HASHES)


def _matches(one: np.ndarray, others: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which of others pass every batch against one signature, and their matches."""
    alive, matches = np.arange(len(others)), np.zeros(len(others), np.int64)
    for k, enough in enumerate(least):
        s = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (others[alive, s] == one[s]).sum(1)
        keep = matches >= enough
        alive, matches = alive[keep], matches[keep]
    return alive, matches


def _meeting(percent: int, least: list[int], bits: int):
    """links_of_blocks() for each bucket and pair of blocks in a task's group."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "i", "j"], ignore_index=True)
        keys = pdf[["bucket", "i", "j"]].to_numpy(np.int64)
        edges = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1), [True])))
        found = [link for s, e in zip(edges[:-1], edges[1:], strict=True) for link in links_of_blocks(pdf.iloc[s:e], percent, least, bits)]
        return pd.DataFrame(found, columns=["a", "b"])

    return meet


def links_of_blocks(pdf: pd.DataFrame, percent: int, least: list[int], bits: int) -> list[tuple[bytes, bytes]]:
    """Links between guests and members of one bucket that join different components.

    pdf: node, component, signature, words; band; visits (a row of a guest) and guest (whether a member's row is of a guest, too).
    A link is found by its estimate first and then by its sets; components are joined here as links are found.
    """
    names = pdf["node"].map(bytes).to_numpy()
    parts = pd.factorize(pdf["component"].map(bytes))[0]
    signatures = _signatures(pdf["signature"])
    words = [np.frombuffer(w, np.uint32 if bits == 32 else np.uint64) for w in pdf["words"]]
    sizes = np.array([len(w) for w in words])
    visits, guest = pdf["visits"].to_numpy(bool), pdf["guest"].to_numpy(bool)
    before = signatures[:, : ROWS * int(pdf["band"].iloc[0])].reshape(len(pdf), -1, ROWS)
    home, found, root = np.flatnonzero(~visits), [], np.arange(len(pdf))
    for at in np.flatnonzero(visits):
        fit = home[root[parts[home]] != root[parts[at]]]
        fit = fit[100 * np.minimum(sizes[fit], sizes[at]) >= percent * np.maximum(sizes[fit], sizes[at])]
        fit = fit[~guest[fit] | (names[fit] > names[at])]  # two guests meet once
        fit = fit[~(before[fit] == before[at]).all(2).any(1)]  # those of an earlier bucket meet there
        some, matches = _matches(signatures[at], signatures[fit], least)
        fit = fit[some[np.argsort(-matches, kind="stable")]]
        while len(fit):
            now, fit = fit[:TURN], fit[TURN:]
            all_words = np.concatenate([words[k] for k in now])
            same = words[at][np.searchsorted(words[at], all_words).clip(max=sizes[at] - 1)] == all_words
            shared = np.add.reduceat(same, np.concatenate(([0], np.cumsum(sizes[now])[:-1])), dtype=np.int64)
            for k in now[100 * shared >= percent * (sizes[at] + sizes[now] - shared)]:
                if root[parts[k]] != root[parts[at]]:
                    found.append((names[at], names[k]))
                    root[root == root[parts[k]]] = root[parts[at]]
            fit = fit[root[parts[fit]] != root[parts[at]]]
    return found


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, mark, t: ids, fingerprints of texts, texts. Rows that agree in doc and mark have equal texts."""
    t = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc"), F.unhex(F.md5(t)).alias("mark"), t.alias("t"))


def sets_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, mark (fingerprint of the text), n_shingles, node (fingerprint of the set, null if it is empty), signature."""
    kind = dict(docs.dtypes)[id_col]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for pdf in batches:
            sizes, nodes, signatures = [], [], []
            for t in pdf["t"]:
                s = shingle_set(t, hashes)
                sizes.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(signature(s).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc": pdf["doc"], "mark": pdf["mark"], "n_shingles": sizes, "node": nodes, "signature": signatures})

    return keyed(docs, id_col, text_col).mapInPandas(work, f"doc {kind}, mark binary, n_shingles long, node binary, signature binary")


def members_of_buckets(nodes: DataFrame) -> DataFrame:
    """bucket, node, n_shingles, fame: each node in each banded bucket with others; fame counts the others it meets in all buckets."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("signature", i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    rows = nodes.select("node", "n_shingles", F.posexplode(bands).alias("band", "bucket"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("others")).where("others > 1")
    met = cut(rows.join(counts, "bucket"))
    fame = met.groupBy("node").agg(F.sum("others").alias("fame"))
    return cut(met.join(fame, "node").select("bucket", "band", "node", "n_shingles", "fame", "others"))


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, least: list[int] | None) -> DataFrame:
    """Of pairs (a, b), those that survive the comparison of signatures (if least is given) and of full sets."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.iloc[_survive(_signatures(pdf["sa"]), _signatures(pdf["sb"]), least)][["a", "b"]] if len(pdf) else pdf[["a", "b"]]

    if least is not None:
        sig = nodes.select("node", "signature")
        both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")
        pairs = cut(both.mapInPandas(compare, "a binary, b binary"))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for pdf in batches:
            keep, last, held = [], None, None
            for ta, tb in zip(pdf["ta"], pdf["tb"], strict=True):
                if ta != last:
                    last, held = ta, shingle_set(ta, hashes)
                other = shingle_set(tb, hashes)
                shared = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * shared >= percent * (len(held) + len(other) - shared))
            yield pdf[np.array(keep, bool)][["a", "b"]]

    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return cut(both.mapInPandas(exact, "a binary, b binary"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that each node of the edges (a, b) can reach. Nodes without edges are left out."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        new = labels.join(near, "node").select("node", "component", F.least("component", "low").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("further"))
        new = cut(new.join(jump, "low", "left").select("node", F.coalesce(F.least("low", "further"), "low").alias("new"), "component"))
        if new.where(F.col("new") != F.col("component")).isEmpty():
            return labels
        labels = new.select("node", F.col("new").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 75, miss: float = 1e-4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_shingles, component_id, kept, a row for each document.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. Those without words, or null,
    have an empty set and stand alone. component_id is the smallest id of the component (null ids count for none, a
    component of null ids has a null id); kept tells whether it is the document's own. Repeated rows are linked like any
    equal texts; rows that repeat an id are told apart by their sets. Other columns are left out. An empty table stays so.
    """
    bounded_batches(docs.sparkSession)
    sets = cut(sets_of(docs, id_col, text_col))
    nodes = cut(sets.where("node is not null").groupBy("node").agg(F.min("doc").alias("low"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"), F.max(F.struct("doc", "mark")).alias("pick")))
    least = prune_below(percent / 100, miss)
    met = members_of_buckets(nodes)
    # the texts of nodes that meet others, one for each: what full sets are made of again. A node's text is told by id and
    # fingerprint, as ids may be null or shared by several texts; where a node has an id, `pick` does (null is the least)
    wanted = met.select("node").distinct().join(nodes.select("node", "pick.doc", "pick.mark"), "node").toDF("node", "__doc", "__mark")
    rows = keyed(docs, id_col, text_col)
    texts = rows.join(wanted, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("mark") == F.col("__mark")))
    texts, texts_path = stored(texts.groupBy("node").agg(F.first("t").alias("t")))

    leaders = met.groupBy("bucket").agg(F.max(F.struct("fame", "node")).alias("top")).select("bucket", F.col("top.node").alias("leader"))
    first = met.join(leaders, "bucket").where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    links = _verified(first.distinct(), nodes, texts, percent, least)
    joined = components(links)

    # what is left: in buckets of several components, members outside of the largest one visit the blocks of all
    placed = cut(met.join(joined, "node", "left").select("bucket", "band", "node", "n_shingles", F.coalesce("component", "node").alias("component")))
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component", "shingles")).alias("top"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles")).where("top.n < n")
    blocks = lambda n, shingles: F.ceil(F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    mixed = mixed.select("bucket", F.col("top.component").alias("largest"), blocks(F.col("n"), F.col("shingles")).alias("blocks"), blocks(F.col("n") - F.col("top.n"), F.col("shingles") - F.col("top.shingles")).alias("guest_blocks"))
    rest = cut(placed.join(mixed, "bucket").withColumn("guest", F.col("component") != F.col("largest")).drop("largest"))
    copies = F.col("guest_blocks") + F.when(F.col("guest"), F.col("blocks")).otherwise(0)
    spread_rows, spread_shingles = (x or 0 for x in rest.agg(F.sum(copies), F.sum(copies * F.col("n_shingles"))).first())
    groups = 1 + max(spread_rows // GROUP, spread_shingles // GROUP_SHINGLES)
    place, guest_place = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("guest_blocks")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    stays = F.transform(upto("guest_blocks"), lambda k: F.struct(k.alias("i"), place.alias("j"), F.lit(False).alias("visits")))
    goes = F.transform(upto("blocks"), lambda k: F.struct(guest_place.alias("i"), k.alias("j"), F.lit(True).alias("visits")))
    at = F.when(F.col("guest"), F.concat(stays, goes)).otherwise(stays)
    dealt = rest.withColumn("at", F.explode(at)).select("bucket", "band", "node", "component", "guest", "at.*")
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(groups)))
    left_over = rest.select("node").distinct()
    for bits in (32, 64):
        packed = texts.join(left_over, "node").join(nodes.select("node", "signature"), "node").mapInPandas(_packed(bits), "node binary, signature binary, words binary")

        second = cut(dealt.join(packed, "node").groupBy("group").applyInPandas(_meeting(percent, least, bits), "a binary, b binary").distinct())
        more = _verified(second, nodes, texts, percent, None)
        if bits == 64 or more.count() == second.count():
            break
    whole = components(links.union(more))
    discarded(docs.sparkSession, texts_path)
    names = nodes.select("node", "low").join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = names.join(names.groupBy("component").agg(F.min("low").alias("component_id")), "component").select(F.col("node").alias("__node"), "component_id")
    out = sets.select("doc", "n_shingles", "node").join(names, F.col("node") == F.col("__node"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("component_id"))
    return out.select(F.col("doc").alias(id_col), "n_shingles", component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept"))
