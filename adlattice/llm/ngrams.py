"""N-gram Jaccard join by vertical partitioning: fragments of the global n-gram order, partial overlaps, one sum per pair.

The global order is (logarithm of the document frequency, hash), rare n-grams first.

1. Tasks turn texts into sets of 64-bit n-gram hashes, equal sets of a block once, and send each range of the hash space to
   its owner, sorted and Golomb-Rice coded.  Owners count, and return only n-grams that occur in more than one set.
2. A set that shares fewer n-grams than the threshold asks for can link with nothing and leaves.  The others are cut into
   fragments of the global order.
3. Candidates come from the prefix filter: linked sets share one of their first n-grams in the global order.  In rounds, the
   sets of a posting list meet one set of the list's largest component and one set outside of it, at most two pairs a row;
   sets then linked need no further pair, so large groups of near copies become one component without all their pairs.
   When a round joins next to nothing, what is left meets across components only, all of it, under a bound of the symmetric
   difference from parity bitmaps: those are pairs that no round has put together, whatever their number.
4. Each candidate pair's overlap is counted fragment by fragment and summed; the sum decides, exactly but for collisions of
   the n-grams' hashes (58 bits and the frequency class), which are not confirmed by text.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from adlattice.llm import codec
from adlattice.llm.graph import components
from adlattice.llm.rows import keep, place
from adlattice.session import materialise

HASH_BITS, ID_BITS, CLASS_MAX, PARITY_WORDS = 64, 58, 31, 32
FRAGMENT_SHIFT = ID_BITS - 2  # a fragment: one frequency class and a quarter of the hashes
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, memo: WordHash, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams; with fewer words than ``size``, of the whole sequence.

    ASCII letters are lowered and ASCII white space separates words: exactly what ``bytes.lower`` and ``bytes.split`` do.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(size, len(w))
    n = len(w) - k + 1
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h = (h + w[i:n + i] * MIX[i % 5]) * MIX[5] if i % 5 == 4 else h + w[i:n + i] * MIX[i % 5]
    h ^= h >> np.uint64(32)
    h *= MIX[6]
    h ^= h >> np.uint64(29)
    return np.unique(h)


def required(n, percent: int):
    """Least overlap of a set of ``n`` with any set it links to."""
    return -(-n * percent // 100)


def sketch(docs: DataFrame, key: str, text: str, size: int, percent: int, block_grams: int) -> DataFrame:
    """One row per document: key, block, n, sig; on one row of each (block, sig) that may link: prefix, fragments, parity, score.

    ``docs`` should read a table: a lost task that is run again must see its rows in the same order.
    """
    kind = docs.schema[key].dataType.simpleString()
    # four owners a shuffle partition: each holds a small range at a time
    owner_bits = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length() + 2
    low_bits = HASH_BITS - owner_bits
    columns = f"dest bigint, block bigint, n bigint, payload binary, key {kind}, sig binary, local int"

    def message(dest, block, n, payload, like):
        m = len(dest)
        return pa.RecordBatch.from_arrays(
            [pa.array(dest, pa.int64()), pa.array(block, pa.int64()), pa.array(n, pa.int64()), pa.array(payload, pa.binary()),
             pa.nulls(m, like), pa.nulls(m, pa.binary()), pa.array([-1] * m, pa.int32())], ["dest", "block", "n", "payload", "key", "sig", "local"])

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        memo = WordHash()
        base, number, sent = TaskContext.get().partitionId() << 24, 0, 0
        sets, seen, held = [], {}, 0

        def flush(like):
            grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            local = np.repeat(np.arange(len(sets), dtype=np.uint64), [len(s) for s in sets])
            order = np.argsort(grams, kind="stable")
            grams, local = grams[order], local[order]
            owners = (grams >> np.uint64(low_bits)).astype(np.int64)
            starts = np.flatnonzero(np.diff(owners, prepend=-1))
            ends = np.append(starts[1:], len(grams))
            width = max(1, len(sets).bit_length())
            low = grams & np.uint64((1 << low_bits) - 1)
            body = [width.to_bytes(1, "little") + codec.pack(local[a:b], width) + codec.encode(low[a:b]) for a, b in zip(starts, ends)]
            return message(owners[starts], [base + number] * len(starts), ends - starts, body, like)

        like = None
        for rb in rows:
            like = rb.column(0).type
            for at in range(0, rb.num_rows, 200):
                part = rb.slice(at, 200)
                out = []
                for t in part.column(1).to_pylist():
                    s = shingles(t, memo, size)
                    sig = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                    first = sig is not None and sig not in seen
                    if first:
                        seen[sig] = len(sets)
                        sets.append(s)
                        held += len(s)
                    out.append((len(s), sig, seen[sig] if first else -1))
                n, sig, local = zip(*out)
                m = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1 - base - ((sent & 0x3FFFF) << 44)] * m, pa.int64()), pa.array([base + number] * m, pa.int64()), pa.array(n, pa.int64()), pa.nulls(m, pa.binary()),
                     part.column(0), pa.array(sig, pa.binary()), pa.array(local, pa.int32())], ["dest", "block", "n", "payload", "key", "sig", "local"])
                sent += 1
                if held >= block_grams:
                    yield flush(like)
                    number += 1
                    sets, seen, held = [], {}, 0
        if sets:
            yield flush(like)
        pa.default_memory_pool().release_unused()

    def own(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        dest = key[0].as_py()
        if dest < 0:
            return group
        blocks, sizes, bodies = (group.column(c).to_pylist() for c in ("block", "n", "payload"))
        grams, local = [], []
        for n, body in zip(sizes, bodies):
            width = body[0]
            cut = 1 + codec.packed_size(n, width)
            local.append(codec.unpack(body[1:cut], n, width))
            grams.append(codec.decode(body[cut:], n))
        grams, local = np.concatenate(grams), np.concatenate(local)
        source = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(grams, kind="stable")
        grams = grams[order]
        heads = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        df = np.diff(np.append(heads, len(grams)))
        times = np.repeat(df, df)
        shared = times > 1
        order, grams, times = order[shared], grams[shared], times[shared]
        rank = np.minimum(np.frexp(times.astype(np.float64))[1] - 1, CLASS_MAX).astype(np.uint64)
        ids = (rank << np.uint64(ID_BITS)) | ((grams | (np.uint64(dest) << np.uint64(low_bits))) >> np.uint64(HASH_BITS - ID_BITS))
        source, local = source[order], local[order]
        by = np.lexsort((ids, source))
        source, local, ids = source[by], local[by], ids[by]
        starts = np.flatnonzero(np.diff(source, prepend=-1))
        ends = np.append(starts[1:], len(ids))
        body = []
        for a, b in zip(starts, ends):
            width = max(1, int(local[a:b].max()).bit_length())
            body.append(width.to_bytes(1, "little") + codec.pack(local[a:b], width) + codec.encode(ids[a:b]))
        return pa.Table.from_batches([message([0] * len(starts), [blocks[source[a]] for a in starts], ends - starts, body, group.schema.field("key").type)])

    def assemble(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        held = group.column("payload").is_valid().to_numpy()
        rows, back = group.filter(pa.array(~held)), group.filter(pa.array(held))
        ids, local = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for n, body in zip(back.column("n").to_pylist(), back.column("payload").to_pylist()):
            width = body[0]
            cut = 1 + codec.packed_size(n, width)
            local.append(codec.unpack(body[1:cut], n, width))
            ids.append(codec.decode(body[cut:], n))
        ids, local = np.concatenate(ids), np.concatenate(local).astype(np.int64)
        n, at = rows.column("n").to_numpy(), rows.column("local").to_numpy()
        count = np.bincount(local, minlength=int(at.max(initial=-1)) + 1)
        shared = np.where(at >= 0, count[np.maximum(at, 0)] if len(count) else 0, 0)
        need = required(n, percent)
        alive = (at >= 0) & (n > 0) & (shared >= need)
        order = np.lexsort((ids, local))
        ids = ids[order].astype(np.int64)
        first = np.append(0, np.cumsum(count))
        prefix, fragments, parity, score = [], [], [], []
        for live, i, s, q in zip(alive.tolist(), at.tolist(), shared.tolist(), need.tolist()):
            if not live:
                for c in (prefix, fragments, parity, score):
                    c.append(None)
                continue
            own = ids[first[i]:first[i + 1]]
            prefix.append(own[:s - q + 1])
            cuts = np.flatnonzero(np.diff(own >> FRAGMENT_SHIFT)) + 1
            fragments.append([{"fragment": int(f[0] >> FRAGMENT_SHIFT), "grams": f} for f in np.split(own, cuts)])
            bits = (np.bincount(own & (64 * PARITY_WORDS - 1), minlength=64 * PARITY_WORDS) & 1).astype(np.uint8)
            parity.append(np.packbits(bits).view("<i8"))
            score.append(float(np.exp2(own >> ID_BITS).sum() / len(own)))
        return pa.table([rows.column("key"), rows.column("block"), rows.column("n"), rows.column("sig"), pa.array(shared, pa.int64()),
                         pa.array(prefix, pa.list_(pa.int64())), pa.array(fragments, pa.list_(pa.struct([("fragment", pa.int32()), ("grams", pa.list_(pa.int64()))]))),
                         pa.array(parity, pa.list_(pa.int64())), pa.array(score, pa.float64())],
                        names=["key", "block", "n", "sig", "shared", "prefix", "fragments", "parity", "score"])

    sent = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(send, columns)
    counted = sent.groupBy("dest").applyInArrow(own, columns)
    return counted.groupBy("block").applyInArrow(
        assemble, f"key {kind}, block bigint, n bigint, sig binary, shared bigint, prefix array<bigint>, "
                  "fragments array<struct<fragment:int,grams:array<bigint>>>, parity array<bigint>, score double")


HOT, SLICES = 256, 16
#: Hub rounds end when one joins less than this share of the labels that all before have joined.
FEW = 0.01


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) of set numbers whose Jaccard similarity is at least ``percent``: partial overlaps, then their sum.

    A set that more than ``HOT`` pairs name as ``b`` lends its fragments to them in slices.
    """
    hot = pairs.groupBy("b").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("b", F.lit(SLICES).alias("many"))
    dealt = pairs.join(hot, "b", "left").select("a", "b", F.pmod("a", F.coalesce("many", F.lit(1))).cast("int").alias("slice"))
    cut = sets.select("node", F.explode("fragments").alias("f")).select("node", "f.fragment", "f.grams")
    left = cut.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("of_a"))
    lent = F.explode(F.sequence(F.lit(0), F.coalesce("many", F.lit(1)) - 1)).alias("slice")
    right = cut.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("of_b")).join(hot, "b", "left").select("b", "fragment", "of_b", lent)
    partial = dealt.join(left, "a").join(right, ["b", "fragment", "slice"]).select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("o"))
    whole = partial.groupBy("a", "b").agg(F.sum("o").alias("o"))
    size = sets.select("node", "n")
    return (whole.join(size.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(size.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
            .where(100 * F.col("o") >= percent * (F.col("n_a") + F.col("n_b") - F.col("o"))).select("a", "b"))


def similar_sizes(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def torn(wide: DataFrame) -> DataFrame:
    """Rows of the posting lists that still hold sets of several labels."""
    return wide.join(wide.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("gram"), "gram")


def hub_pairs(wide: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) to look at in one round: in each torn list, sets meet one set of the list's commonest label, and one of another
    label meets the sets that don't share its label.  At most two pairs a row, whatever a list's length.

    Rounds take turns between the most central sets and sets drawn by a hash.
    """
    rank = F.struct("score", "n", (-F.col("node")).alias("node")) if turn % 2 == 0 else F.struct(F.xxhash64("node", F.lit(turn)).alias("score"), "n", (-F.col("node")).alias("node"))
    by_label = wide.groupBy("gram", "label").agg(F.count("*").alias("c"), F.max(rank).alias("hub"))
    first = by_label.groupBy("gram").agg(F.max(F.struct("c", "hub", "label")).alias("top"))
    other = (by_label.join(first.select("gram", F.col("top.label").alias("main")), "gram").where(F.col("label") != F.col("main"))
             .groupBy("gram").agg(F.max(F.struct("hub", "label")).alias("out")))
    # a hot list is met in slices
    hubs = first.join(other, "gram").select(
        "gram", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"),
        F.array(*[F.struct((-F.col(f"{x}.hub.node")).alias("b"), F.col(f"{x}.hub.n").alias("n_b"), F.col(f"{x}.label").alias("label_b")) for x in ("top", "out")]).alias("hubs"))
    met = wide.withColumn("slice", F.pmod("node", F.lit(SLICES)).cast("int")).join(hubs, ["gram", "slice"]).select("node", "n", "label", F.inline("hubs"))
    return met.where((F.col("label") != F.col("label_b")) & similar_sizes("n", "n_b", percent)).select(F.col("node").alias("a"), "b").distinct()


def set_links(sets: DataFrame, percent: int) -> DataFrame:
    """(node, label): components of the sets, those in a shared posting list only."""
    posted = sets.select("node", "n", "score", F.col("node").alias("label"), F.explode("prefix").alias("gram"))
    wide = materialise(torn(posted))
    labels = wide.select("node", "label").distinct()
    turn = joined = 0
    while (merged := merge(labels, linked(materialise(hub_pairs(wide, percent, turn)), sets, percent))) is not None:
        labels = materialise(labels.join(merged, labels["label"] == merged["old"], "left").select("node", F.coalesce("new", "label").alias("label")))
        wide = materialise(torn(wide.drop("label").join(labels, "node")))
        turn, now = turn + 1, merged.count()
        joined += now
        if now < FEW * joined:
            break
    # what no round has linked meets across labels, under a bound of the symmetric difference from parity bitmaps; a list's
    # commonest label, which may hold nearly all of a long list, is only met by the others
    main = wide.groupBy("gram", "label").agg(F.count("*").alias("c")).groupBy("gram").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    # parity words are plain columns: read from arrays, the condition's code is too long to be compiled
    words = [F.coalesce(F.col("parity")[i], F.lit(0).cast("bigint")).alias(f"p{i}") for i in range(PARITY_WORDS)]
    rest = wide.join(sets.select("node", (F.col("n") - F.col("shared")).alias("alone"), *words), "node").drop("score")
    other = rest.select("gram", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "label", "alone", *[f"p{i}" for i in range(PARITY_WORDS)])])
    rest = materialise(rest.join(main, "gram").where("label <> main"))
    differ = F.col("alone") + F.col("alone_b")
    for i in range(PARITY_WORDS):
        differ = differ + F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"p{i}_b")))
    near = (100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("n_b"))
    apart = (F.col("label") < F.col("label_b")) | (F.col("label_b") == F.col("main"))
    meet = (rest.join(other, (rest["gram"] == other["gram"]) & apart & similar_sizes("n", "n_b", percent) & near)
            .select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct())
    merged = merge(labels, linked(materialise(meet), sets, percent))
    if merged is None:
        return labels
    return labels.join(merged, labels["label"] == merged["old"], "left").select("node", F.coalesce("new", "label").alias("label"))


def merge(labels: DataFrame, links: DataFrame) -> DataFrame | None:
    """(old, new) labels after the ``links`` of sets; None if these join no two labels."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("label_a")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("label_b")), "b")
    edges = materialise(ends.where("label_a <> label_b").select(F.greatest("label_a", "label_b").alias("a"), F.least("label_a", "label_b").alias("b")).distinct())
    if edges.isEmpty():
        return None
    return components(edges).select(F.col("node").alias("old"), F.col("label").alias("new"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, block_grams: int = 500_000) -> DataFrame:
    """One row per document: ``key``, n_shingles, component_id (the least key reachable by links, null if the component has none).

    Null, empty and white texts have no shingles and link with nothing: component_id is the document's own key.  Documents with
    equal sets are linked.  Rows may repeat; keys of any ordered type; an empty table gives no rows.
    """
    drawn = materialise(sketch(docs, key, text, size, percent, block_grams))
    sets = (drawn.where("prefix IS NOT NULL").groupBy("sig").agg(*[F.first(c).alias(c) for c in ("n", "shared", "prefix", "fragments", "parity", "score")])
            .withColumn("node", F.monotonically_increasing_id()))
    sets = materialise(sets)
    label = set_links(sets, percent)
    least = drawn.where("sig IS NOT NULL").groupBy("sig").agg(F.min("key").alias("least"))
    known = least.join(sets.select("sig", "node"), "sig", "left").join(label, "node", "left").select("sig", "least", "label")
    known = materialise(known)
    whole = known.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("of_label"))
    named = known.join(whole, "label", "left").select("sig", F.coalesce("of_label", "least").alias("component"))
    # answers go back once per block and set, so a set with a third of all rows meets no task whole
    answers = drawn.where("sig IS NOT NULL").select("block", "sig").distinct().join(named, "sig")
    out = drawn.select("key", "block", "n", "sig").join(answers, ["block", "sig"], "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"),
                      F.when(F.col("sig").isNull(), F.col("key")).otherwise(F.col("component")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """One document of each component, the first by place; all columns kept."""
    table = place(docs)
    at = F.shiftleft(F.col("part").cast("bigint"), 33).bitwiseOR(F.col("pos")).alias("at")
    found = jaccard_components(table.select(at, F.col(f"row.`{text}`").alias("text")), "at", "text", **options)
    rest = found.where("component_id <> at").select(F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("pos"))
    return keep(table, rest, marked=False).select("row.*")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END, ' ') AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id"""
