"""N-gram Jaccard join by vertical partitioning (operator 5).

All n-grams have one global order: rare ones by hash, then the common ones by how often they occur. The order is cut into fragments,
so every document falls into segments, one a fragment. Two documents that are similar enough share an n-gram near the start of both
in that order; such pairs are candidates. For each candidate pair the overlap of the two segments is counted in every fragment
separately, and the partial counts are summed per pair.

Groups of copies do not become all their pairs. Equal sets are one representative. Each n-gram's documents are first compared with one
of them; what links is contracted to a component, and then only pairs across components are compared, until none is left, so that no
link between components goes unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenmill.llm.common import dropped, give_back, most_frequent, put_away, text_of, written
from lumenmill.llm.shingles import digest, shingle_sets

KEYS = "doc_id long, n int, digest binary, gram long, count long"
#: An n-gram is common if a chunk of CHUNK n-grams has LOCAL documents with it and all chunks together COMMON; at most MOST are put last.
#: This only shapes the order, and so the cost: any order that all documents share gives the same result.
CHUNK, LOCAL, COMMON, MOST = 1 << 22, 2, 8, 400_000
FRAGMENTS = 8
#: Bits of the filter that keeps most documents without candidates out of the shuffle: 16 or more for each id, up to 16 MB in all. Exact joins follow.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def _grams(texts: list[str], width: int) -> list[np.ndarray]:
    """Sets as ascending 48-bit hashes. They are made anew in each pass: text is smaller than they are, and hashing it is cheap."""
    return [np.unique(x >> np.uint64(16)).astype(np.int64) for x in shingle_sets(texts, width)]


def set_keys(texts: DataFrame, width: int) -> DataFrame:
    """A row for each text with the size and digest of its set; and rows of gram and count, n-grams that are common within a chunk."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put_away()
        held, n = [], 0

        def rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
            types = {"doc_id": pa.int64(), "n": pa.int32(), "digest": pa.binary(), "gram": pa.int64(), "count": pa.int64()}
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, t)) for c, t in types.items()], names=list(types))

        def counted() -> pa.RecordBatch:
            grams, count = np.unique(np.concatenate(held), return_counts=True)
            keep = count >= LOCAL
            return rows(int(keep.sum()), gram=pa.array(grams[keep]), count=pa.array(count[keep].astype(np.int64)))

        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                got = shingle_sets(part.column("text").to_pylist(), width)
                yield rows(len(got), doc_id=part.column("doc_id"), n=pa.array([len(g) for g in got], pa.int32()), digest=pa.array([digest(g) for g in got], pa.binary()))
                held += [(g >> np.uint64(16)).astype(np.int64) for g in got]
                n += sum(len(g) for g in got)
                if n >= CHUNK:
                    yield counted()
                    held, n = [], 0
        if held:
            yield counted()
        held = []
        give_back()

    return texts.mapInArrow(keys, KEYS)


def common_grams(keys: DataFrame) -> np.ndarray:
    """Common n-grams, the least common first."""
    top = keys.where("gram is not null").groupBy("gram").agg(F.sum("count").alias("count")).where(F.col("count") >= COMMON)
    return most_frequent(top, "count", MOST)["gram"].to_numpy(np.int64)[::-1]


def _lists(out: list[np.ndarray]) -> pa.ListArray:
    flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)), flat)


def _in_order(grams: np.ndarray, known: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's n-grams in the global order, and where each stands: its hash, or 2**48 and up for common ones."""
    if not len(known):
        return grams, grams
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    place = np.where(known[at] == grams, rank[at] + (1 << 48), grams)
    order = np.argsort(place, kind="stable")
    return grams[order], place[order]


def _least_overlap(n: Column, m: Column, num: int, den: int) -> Column:
    """The smallest overlap at which sets of n and m are similar: num / (num + den) of n + m, rounded up."""
    return F.ceil((n + m) * num / (num + den) - 1e-9)


def _near(a: str, b: str, num: int, den: int) -> Column:
    """Whether sizes allow the similarity, and the n-gram can be the first shared one: what follows it is enough."""
    n, m, i, j = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.pos"), F.col(f"{b}.pos")
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & (F.least(n - i, m - j) >= _least_overlap(n, m, num, den))


def prefixes(texts: DataFrame, width: int, keys: DataFrame, reps: DataFrame, common: np.ndarray, num: int, den: int) -> DataFrame:
    """(gram, doc, n, pos) for the start of every representative in the global order; of rare n-grams only those that two of them start with.

    A filter of bounded size over the ids that are no representatives shows for most documents that they are; only the starts of the
    others are joined with the representatives. However full the filter is, the result is the same. Common n-grams, which can have any
    number of documents, are not brought together here.
    """
    known, rank = np.sort(common), np.argsort(common, kind="stable")
    own = reps.select(F.col("rep").alias("doc"))
    every = keys.where("n > 0 and doc_id is not null").select(F.col("doc_id").alias("doc"))
    bits = _bits(every.count() - own.count())
    shared = texts.sparkSession.sparkContext.broadcast((known, rank, _filter(every.join(own, "doc", "left_anti"), bits)))

    def starts(inside: bool) -> DataFrame:
        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, rank, copies = shared.value
            for docs, got in _candidates(batches, copies, width, inside):
                out, rare = [], []
                for g in got:
                    in_order, place = _in_order(g, known, rank)
                    out.append(in_order[: len(g) - (num * len(g) + den - 1) // den + 1])
                    rare.append(int(np.searchsorted(place, 1 << 48)))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([len(g) for g in got], pa.int32()), pa.array(rare, pa.int32()), _lists(out)], names=["doc", "n", "rare", "start"])

        return texts.where("doc_id is not null").select("doc_id", _bit("doc_id", bits).alias("bit"), "text").mapInArrow(some, "doc long, n int, rare int, start array<long>")

    rows = starts(False).unionByName(starts(True).join(own, "doc", "left_semi")).select("doc", "n", "rare", F.posexplode("start").alias("pos", "gram"))
    common_here = F.col("pos") >= F.col("rare")
    shared_by = F.count("*").over(Window.partitionBy("gram", "apart"))
    return rows.withColumn("apart", F.when(common_here, F.col("doc"))).withColumn("docs", shared_by).where("docs > 1 or apart is not null").select("gram", "doc", "n", "pos")


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def star_pairs(starts: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Each n-gram's documents with one of them, written: at first the one that has it earliest, later one by the hash of its id.

    The one is found by an aggregate and joined as a table of its own, so that Spark is free to split an n-gram of very many documents.
    """
    own = ["doc", "n", "pos", *[c for c in starts.columns if c == "comp"]]
    first = F.struct((F.col("pos") if turn == 0 else F.xxhash64(F.lit(turn), "doc")).cast("long").alias("key"), *own)
    hubs = written(starts.groupBy("gram").agg(F.min(first).alias("r"), F.count("*").alias("docs")).where("docs > 1").select("gram", "r"))
    both = starts.select("gram", F.struct(*own).alias("l")).join(hubs, "gram")
    if "comp" in own:
        both = both.where("l.comp <> r.comp")
    pairs = written(_pairs(both.where(_near("l", "r", num, den)).select(F.col("l.doc").alias("x"), F.col("r.doc").alias("y"))))
    dropped(hubs)
    return pairs


def across(starts: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of n-grams whose documents still belong to several components, written, with comp and whether it is the n-gram's largest (main)."""
    rows = written(starts.join(labels, "doc", "left").withColumn("comp", F.coalesce("label", "doc")).drop("label"))
    sizes = rows.groupBy("gram", "comp").agg(F.count("*").alias("size"))
    tops = written(sizes.groupBy("gram").agg(F.max(F.struct("size", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("gram", F.col("top.comp").alias("top")))
    out = written(rows.join(tops, "gram").select("gram", "doc", "n", "pos", "comp", (F.col("comp") == F.col("top")).alias("main")))
    dropped(rows)
    dropped(tops)
    return out


def cross_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """All candidate pairs across components: one of the two is outside the n-gram's largest component."""
    l, r = rows.where("not main").alias("l"), rows.alias("r")
    met = l.join(r, (F.col("l.gram") == F.col("r.gram")) & (F.col("l.comp") != F.col("r.comp")) & (F.col("r.main") | (F.col("l.doc") < F.col("r.doc"))) & _near("l", "r", num, den))
    return _pairs(met.select(F.col("l.doc").alias("x"), F.col("r.doc").alias("y")))


def _bits(ids: int) -> int:
    return max(LEAST_BITS, min(MOST_BITS, 1 << (16 * max(ids, 1)).bit_length()))


def _bit(column: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits))


def _filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A filter of so many bits that lets every doc of ids through, and few others."""
    out = np.zeros(bits // 64, np.int64)
    at = f"pmod(xxhash64(doc), {bits})"
    words = ids.groupBy(F.expr(f"cast({at} div 64 AS int)").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast({at} % 64 AS int)))").alias("word")).toPandas()
    out[words["at"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64)
    return out


def _wanted(pairs: DataFrame) -> tuple[np.ndarray, int]:
    bits = _bits(2 * pairs.count())
    return _filter(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), bits), bits


def _candidates(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, width: int, inside: bool = True) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Ids and sets of the documents that the filter lets through, or with inside=False of those it does not; the others are not even hashed."""
    for batch in batches:
        bit = batch.column("bit").to_numpy().astype(np.int64)
        hit = (wanted[bit >> 6].view(np.uint64) >> (bit & 63).astype(np.uint64)) & np.uint64(1)
        some = batch.filter(pa.array(hit.astype(bool) == inside))
        for first in range(0, some.num_rows, 400):
            part = some.slice(first, 400)
            yield part.column("doc_id").to_pylist(), _grams(part.column("text").to_pylist(), width)
    give_back()


def bounded(texts: DataFrame, width: int, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose overlap can be large enough: n-grams are counted in 256 classes, and two sets share at most the smaller count of each.

    Only 256 bytes a document are joined for it. A count that does not fit a byte makes no bound, and the pair stays.
    """
    wanted, bits = _wanted(pairs)
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, sets in _candidates(batches, shared.value, width):
            counts = [np.minimum(np.bincount(g & 255, minlength=256), 255).astype(np.uint8).tobytes() for g in sets]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([len(g) for g in sets], pa.int32()), pa.array(counts, pa.binary())], names=["doc", "n", "counts"])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 256) for c in ("c_a", "c_b"))
            most = np.minimum(x, y).sum(1, dtype=np.int64)
            size = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            keep = ((num + den) * most >= num * size) | (x == 255).any(1) | (y == 255).any(1)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    vectors = texts.select("doc_id", _bit("doc_id", bits).alias("bit"), "text").mapInArrow(counted, "doc long, n int, counts binary")
    left, right = (vectors.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("counts").alias(f"c_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "c_a", "c_b").mapInArrow(possible, "a long, b long").distinct()


def verified(texts: DataFrame, width: int, pairs: DataFrame, common: np.ndarray, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are similar enough, written: partial overlaps by fragment, summed per pair of rows, as an id can have several."""
    pairs = written(bounded(texts, width, pairs, num, den))
    wanted, bits = _wanted(pairs)
    shared = texts.sparkSession.sparkContext.broadcast((np.sort(common), np.argsort(common, kind="stable"), wanted))
    # Hashes spread evenly, so equal ranges of them are even fragments; the common n-grams are the last.
    cuts = np.array([(1 << 48) * (i + 1) // (FRAGMENTS - 1) for i in range(FRAGMENTS - 1)], np.int64)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, wanted = shared.value
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for docs, sets in _candidates(batches, wanted, width):
            doc, of, n, fragment, out = [], [], [], [], []
            for d, grams in zip(docs, sets, strict=True):
                grams, place = _in_order(grams, known, rank)
                at = [0, *np.searchsorted(place, cuts).tolist(), len(grams)]
                full = [f for f in range(FRAGMENTS) if at[f] < at[f + 1]]
                doc += [d] * len(full)
                of += [row] * len(full)
                row += 1
                n += [len(grams)] * len(full)
                fragment += full
                out += [grams[at[f] : at[f + 1]] for f in full]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(of, pa.int64()), pa.array(n, pa.int32()), pa.array(fragment, pa.int32()), _lists(out)], names=["doc", "row", "n", "fragment", "segment"])

    cut = texts.select("doc_id", _bit("doc_id", bits).alias("bit"), "text").mapInArrow(segments, "doc long, row long, n int, fragment int, segment array<long>")
    left, right = (cut.select(F.col("doc").alias(x), F.col("row").alias(f"row_{x}"), F.col("n").alias(f"n_{x}"), "fragment", F.col("segment").alias(f"s_{x}")) for x in "ab")
    overlaps = pairs.join(left, "a").join(right, ["b", "fragment"])
    summed = overlaps.groupBy("a", "b", "row_a", "row_b", "n_a", "n_b").agg(F.sum(F.size(F.array_intersect("s_a", "s_b"))).alias("overlap"))
    # |A and B| * den >= num * |A or B|
    found = written(summed.where((num + den) * F.col("overlap") >= num * (F.col("n_a") + F.col("n_b"))).select("a", "b").distinct())
    dropped(pairs)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(doc, label) for every document in edges (a, b): the smallest id that it reaches. Each round points documents to the smallest neighbour and contracts."""
    left = written(edges.select("a", "b"))
    labels = None
    while True:
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("next"))
        jump = to.select(F.col("node").alias("next"), F.col("next").alias("then"))
        to = written(to.join(jump, "next", "left").select("node", F.coalesce("then", "next").alias("next")))
        if labels is None:
            found = to.select(F.col("node").alias("doc"), F.col("next").alias("label"))
        else:
            found = labels.join(to, labels["label"] == to["node"], "left").select("doc", F.coalesce("next", "label").alias("label"))
        new = written(found)
        a, b = (to.select(F.col("node").alias(x), F.col("next").alias(f"n_{x}")) for x in "ab")
        rest = written(left.join(a, "a").join(b, "b").select(F.col("n_a").alias("a"), F.col("n_b").alias("b")).where("a <> b").distinct())
        for old in (left, labels, to):
            if old is not None:
                dropped(old)
        left, labels = rest, new
        if not rest.limit(1).count():
            return labels


def ngram_components(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, stars: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id, n_shingles (size of its set) and component_id (the smallest id that links reach).

    Words lie between ASCII white space and A-Z count as a-z. Two documents link when den * intersection >= num * union of their sets
    of width-word shingles; a text with fewer words is one shingle, and null or empty text is the empty set, which links with nothing.
    Rows that repeat an id are one document in links. A row without an id gets the component of its equals, or null, and links through
    them only. An empty table gives an empty result; other columns are not read. In a round an n-gram's documents meet only one of them; the
    last round compares all that is left across components. It begins when that costs no more than 40 times the starts, or, after at
    least stars rounds, when a round has no longer lowered that cost by a fifth.
    """
    texts = _texts(docs, id_col, text_col)
    keys = written(set_keys(texts, width))
    reps = written(keys.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    common = common_grams(keys)
    starts = written(prefixes(texts, width, keys, reps, common, num, den))
    seen = edges = labels = rows = before = None
    left, total, turn, last = starts, starts.count(), 0, False
    while total and not last:
        if labels is not None:
            if rows is not None:
                dropped(rows)
            left = rows = across(starts, labels)
            counts = rows.groupBy("gram").agg(F.count("*").alias("all"), F.count_if(~F.col("main")).alias("some"))
            cost = counts.agg(F.sum(F.col("all") * F.col("some"))).first()[0] or 0
            last = cost <= 40 * total or turn > max(1, stars) and cost > 0.8 * before
            before = cost
        pairs = written(cross_pairs(left, num, den)) if last else star_pairs(left, turn, num, den)
        if seen is not None:
            every, pairs = pairs, written(pairs.join(seen, ["a", "b"], "left_anti"))
            dropped(every)
        found = verified(texts, width, pairs, common, num, den)
        seen = pairs if seen is None else seen.unionByName(pairs)
        edges = found if edges is None else edges.unionByName(found)
        if labels is not None:
            dropped(labels)
        labels = components(edges)
        turn += 1
    out = keys.where("digest is not null").select("doc_id", "n", "digest")
    if labels is not None:
        reps = written(reps.join(labels, reps["rep"] == labels["doc"], "left").select("digest", F.coalesce("label", "rep").alias("rep")))
        for spent in (starts, seen, edges, labels, *([rows] if rows is not None else [])):
            dropped(spent)
    reps = reps.withColumnRenamed("digest", "of")
    joined = out.join(reps, (F.col("digest") == F.col("of")) & (F.col("n") > 0), "left")
    return joined.select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("component_id"))
