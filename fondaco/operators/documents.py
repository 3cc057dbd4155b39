"""Operators over texts: chunks, segments, mentions, TF-IDF similarity, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, forget, shuffled, spread

#: Vectors and terms of a block, groups of terms by which cosines are bounded, numbers that are spread out in memory at once; all of them only speed and memory.
BLOCK, BLOCK_TERMS, GROUPS, CELLS = 2_048, 400_000, 256, 500_000


def stride_chunks(df: DataFrame, key: str, text: str, size: int = 1_000, overlap: int = 100) -> DataFrame:
    """(key, chunk_index, char_start, char_end, chunk) of fixed windows that overlap; the last one ends with the text."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1)).cast("int")
    rows = df.filter(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    return rows.select(key, "chunk_index", start.alias("char_start"), F.least(start + size, F.length(text)).alias("char_end"), F.substr(text, start + 1, F.lit(size)).alias("chunk"))


def boundaries(text: str, size: int, overlap: int, least: float = 0.6) -> list[tuple[int, int, str]]:
    """(start, end, kind) of chunks that end at a paragraph, sentence or blank, no earlier than ``least`` of their size."""
    out, at, n = [], 0, len(text)
    while at < n:
        end, kind = min(at + size, n), "end"
        if end < n:
            floor = at + int(size * least)
            for kind, mark in (("paragraph", "\n\n"), ("sentence", ". "), ("blank", " ")):
                hit = text.rfind(mark, floor, end)
                if hit >= 0:
                    end = hit + len(mark)
                    break
            else:
                kind = "hard"
        out.append((at, end, kind))
        if end >= n:
            break
        at = max(end - overlap, at + 1)
    return out


def boundary_chunks(df: DataFrame, key: str, text: str, size: int = 4_500, overlap: int = 300) -> DataFrame:
    """(key, chunk_index, char_start, char_end, boundary, chunk) of chunks that respect the text's own boundaries."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, a, b, how, t[a:b]) for k, t in zip(pdf[key], pdf[text]) if t for i, (a, b, how) in enumerate(boundaries(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "char_start", "char_end", "boundary", "chunk"]).astype({key: pdf[key].dtype})

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, chunk_index int, char_start int, char_end int, boundary string, chunk string")


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, sentence): lines and sentences in order."""
    parts = F.split(F.regexp_replace(text, r"([.!?…]) +", "$1\n"), r"\n+")
    return df.select(key, F.posexplode(F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")).alias("pos", "sentence"))


def _named(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def mentions(df: DataFrame, key: str, text: str, rules: dict[str, str]) -> DataFrame:
    """(key, kind, value, n): matches of each rule's pattern (first group), counted per document; the text is read once for all rules."""
    hits = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), _named(kind)) for kind, p in rules.items()]
    return df.select(key, F.explode(F.concat(*hits)).alias("m")).groupBy(key, "m.kind", "m.value").agg(F.count(F.lit(1)).alias("n"))


def _idf() -> Column:
    """The factor of a term that df of nd texts hold."""
    return F.log((1 + F.col("nd")) / (1 + F.col("df"))) + 1


def tfidf(tokens: DataFrame, key: str) -> DataFrame:
    """(key, term, w) with w = tf x (ln((1+N)/(1+df)) + 1) from (key, term) occurrences."""
    tf = tokens.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = tf.select(key).distinct().agg(F.count(F.lit(1)).alias("nd"))  # one row
    return tf.join(df, "term").join(F.broadcast(n)).select(key, "term", "df", (F.col("tf") * _idf()).alias("w"))


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in the least bytes that hold them all: unsigned ones in 1, 2 or 4, any others in 8."""
    return x.astype("<f8" if x.dtype.kind == "f" else f"<u{np.min_scalar_type(x.max()).itemsize}").tobytes()


def _wide(x: pa.Scalar, n: int) -> np.ndarray:
    """The n numbers of :func:`_narrow`."""
    size = len(x.as_buffer()) // n
    return np.frombuffer(x.as_buffer(), "<f8" if size == 8 else f"<u{size}")


def _packed(vectors: DataFrame, key: str, least: int) -> DataFrame:
    """Blocks of vectors (key, t, w) of at least so many places as rows: block, keys, n (terms of each), c and w of all of them; terms, that c points to, and df, the block's vectors that hold each.

    A term that stands several times in t has the sum of its weights. Without w every place weighs 1, so that w counts.
    """
    kind, terms = (vectors.schema[c].dataType.simpleString() for c in (key, "t"))
    weighted = "w" in vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            b = b.filter(pc.greater_equal(pc.list_value_length(b.column("t")), max(1, least)))  # not in SQL, where it would go before any earlier step and make t once more
            n = pc.list_value_length(b.column("t")).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < len(n):
                size = max(1, min(BLOCK, int(np.searchsorted(np.cumsum(n[lo : lo + BLOCK]), BLOCK_TERMS, side="right"))))
                part, m = b.slice(lo, size), n[lo : lo + size]
                coded = part.column("t").flatten().dictionary_encode()
                v = len(coded.dictionary)
                at, place = np.unique(np.repeat(np.arange(size), m) * v + coded.indices.to_numpy(), return_inverse=True)
                w = np.bincount(place, part.column("w").flatten().to_numpy() if weighted else None, len(at))
                c = at % v
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))
                counts = [np.bincount(x, minlength=k).astype("int32") for x, k in ((at // v, size), (c, v))]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *map(one, (part.column(key), counts[0], coded.dictionary, counts[1])), *(pa.array([_narrow(x)]) for x in (c, w))], ["block", "keys", "n", "terms", "df", "c", "w"])
                block, lo = block + 1, lo + size

    return vectors.select(key, "t", *["w"] * weighted).mapInArrow(run, f"block long, keys array<{kind}>, n array<int>, terms {terms}, df array<int>, c binary, w binary")


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _ready(n: np.ndarray, c: np.ndarray, w: np.ndarray, ids: np.ndarray) -> tuple:
    """A block as :func:`_met` takes it: n, c, unit weights, ids, and norms of each vector's parts in GROUPS groups of terms.

    The product of two vectors' norms is a bound of their cosine (Cauchy and Schwarz, by group).
    """
    w = w / np.repeat(np.sqrt(np.add.reduceat(w * w, _starts(n))), n)
    at = np.repeat(np.arange(len(n)) * GROUPS, n) + (ids % GROUPS)[c]
    return n, c, w, ids, np.sqrt(np.bincount(at, w * w, len(n) * GROUPS)).astype("float32").reshape(len(n), GROUPS)


def _met(a: tuple, b: tuple, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    (na, ca, wa, ia, ga), (nb, cb, wb, ib, gb) = a, b
    # the bound's rounding is below 1e-5
    i, j = np.divmod(np.flatnonzero(ga @ gb.T >= threshold - 1e-4), len(nb))
    if same:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return
    _, both_a, both_b = np.intersect1d(ia, ib, assume_unique=True, return_indices=True)
    k = len(both_a)  # the column of all terms that only one block has; it stays zero
    ja, jb = np.full(len(ia), k), np.full(len(ib), k)
    ja[both_a] = jb[both_b] = np.arange(k)
    ca, cb, sa, sb = ja[ca], jb[cb], _starts(na), _starts(nb)
    lo, rows = 0, max(1, CELLS // (k + 1))  # rows of a that are spread out at once
    while lo < len(i):
        hi = min(int(np.searchsorted(i, i[lo] + rows)), lo + max(1, int(np.searchsorted(np.cumsum(nb[j[lo : lo + CELLS]]), CELLS, side="right"))))
        first, last = i[lo], i[hi - 1]
        dense = np.zeros((last - first + 1, k + 1))
        own = slice(sa[first], sa[last] + na[last])
        dense[np.repeat(np.arange(last - first + 1), na[first : last + 1]), ca[own]] = wa[own]
        dense[:, k] = 0
        m = nb[j[lo:hi]]
        start = _starts(m)
        flat = np.arange(m.sum()) + np.repeat(sb[j[lo:hi]] - start, m)
        cosine = np.add.reduceat(dense.ravel()[np.repeat((i[lo:hi] - first) * (k + 1), m) + cb[flat]] * wb[flat], start)
        ok = cosine >= threshold
        yield i[lo:hi][ok], j[lo:hi][ok], cosine[ok]
        lo = hi


def block_cosines(a: tuple, b: tuple, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in a, places in b, cosines) of the vectors of two blocks that reach the threshold; ``same``: a is b, and each pair comes once.

    a, b: (n, t, w), the terms of each vector and all terms with their weights.
    """
    of = lambda n, t, w, ids_c: _ready(n, ids_c[1], w, ids_c[0])
    yield from _met(*(of(*x, np.unique(x[1], return_inverse=True)) for x in (a, b)), threshold, same)


def _similar(vectors: DataFrame, key: str, threshold: float, least: int = 1) -> DataFrame:
    """(a, b, cosine), a < b, of all pairs of vectors (key, t, w) that reach the threshold; without w they are weighted as in :func:`tfidf`.

    Texts of one kind share their words, so pairs with a common rare word are nearly all pairs, and rows for them don't fit any disk. So
    vectors are packed in blocks, every two blocks meet once, streamed from the written table, and nothing is written for a pair that isn't a
    result: a product of norms by groups of terms bounds the cosine, and only pairs whose bound reaches the threshold are summed up over all
    terms. The work still grows with the square of the number of vectors.

    A term is a row once for each block that holds it, never for each vector: the vectors of a block share most of their terms. A block's
    vectors hold places in its own list of terms, so that two blocks compare only their lists.
    """
    bags = cut(_packed(vectors, key, least))
    listed = bags.select("block", F.posexplode(F.arrays_zip("terms", "df")).alias("p", "x")).select("block", "p", F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    terms, seed = cut(listed.groupBy("term").agg(F.sum("df").alias("df"))), 0
    while (n := terms.agg(F.count(F.lit(1)).alias("all"), F.count_distinct(F.xxhash64(F.lit(seed), "term")).alias("ids")).first())["all"] != n["ids"]:
        seed += 1  # two terms of one hash
    known, scale = terms, F.lit(1.0)
    if "w" not in vectors.columns:
        known = terms.join(F.broadcast(bags.agg(F.sum(F.size("keys")).alias("nd"))))  # one row
        scale = _idf()
    known = known.select("term", F.xxhash64(F.lit(seed), "term").alias("id"), scale.alias("s"))
    lists = shuffled(listed.select("block", "p", "term")).join(known, "term").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("p", "id", "s"))).alias("v"))  # as long as a block's list
    rows = spread(bags.select("block", "keys", "n", "c", "w"), "block").join(shuffled(spread(lists, "block")), "block")
    blocks = cut(rows.select("block", "keys", "n", "c", "w", F.col("v.id").alias("ids"), F.col("v.s").alias("s")))
    forget(bags, terms)
    side = lambda p: blocks.select(*[F.col(c).alias(f"{p}_{c}") for c in blocks.columns])
    met = side("a").hint("shuffle_replicate_nl").join(side("b"), F.col("a_block") <= F.col("b_block"))
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def vectors_of(row: dict, p: str) -> tuple:
            n, ids, s = (row[f"{p}_{x}"].values.to_numpy() for x in ("n", "ids", "s"))
            c, w = (_wide(row[f"{p}_{x}"], n.sum()) for x in "cw")
            return _ready(n, c, w * s[c], ids)

        at = a = None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                if row["a_block"] != at:  # the block of the rows before, most often
                    at, a = row["a_block"], vectors_of(row, "a")
                same = row["a_block"] == row["b_block"]
                for i, j, cosine in _met(a, a if same else vectors_of(row, "b"), threshold, same):
                    yield pa.RecordBatch.from_arrays([row["a_keys"].values.take(pa.array(i)), row["b_keys"].values.take(pa.array(j)), pa.array(cosine)], ["x", "y", "cosine"])

    found = met.mapInArrow(run, f"x {kind}, y {kind}, cosine double")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")


def cosine_pairs(weights: DataFrame, key: str, threshold: float) -> DataFrame:
    """(a, b, cosine), a < b, of all pairs that reach the threshold; exact. Weights (key, term, w) are not negative."""
    w = weights.select(key, "term", F.col("w").cast("double").alias("w")).filter("w > 0 and term is not null")
    vectors = spread(w, key).groupBy(key).agg(F.collect_list(F.struct("term", "w")).alias("v"))  # as long as one text
    return _similar(vectors.select(key, F.col("v.term").alias("t"), F.col("v.w").alias("w")), key, threshold)


def tfidf_pairs(texts: DataFrame, key: str, tokens: str, threshold: float, least: int = 1) -> DataFrame:
    """What :func:`cosine_pairs` gives for :func:`tfidf` of the tokens (an array without nulls) of texts with at least so many, one row a key.

    No row is written for a term of a text.
    """
    return _similar(texts.select(key, F.col(tokens).alias("t")), key, threshold, least)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node is linked to, by pointer jumping over written tables.

    Every round takes the least label of the neighbours and then that label's own label, so the number of rounds grows
    with the logarithm of the longest path.
    """
    e = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    label = cut(e.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("c")).withColumnRenamed("x", "node"))
    while True:
        near = e.join(label.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("c").alias("m")).withColumnRenamed("x", "node")
        step = label.join(near, "node").select("node", F.least("c", "m").alias("n"), "c")
        jump = step.join(label.select(F.col("node").alias("n"), F.col("c").alias("up")), "n").select("node", F.least("n", "up").alias("c"), (F.least("n", "up") < F.col("c")).alias("moved"))
        new = cut(jump)
        moved = not new.filter("moved").isEmpty()
        forget(label)
        label = new
        if not moved:
            forget(e)
            return label.select("node", F.col("c").alias("component"))


def box_overlap(a: Column, b: Column) -> Column:
    """Area that two boxes (x0, y0, x1, y1) share."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))
