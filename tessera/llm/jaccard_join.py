"""N-gram Jaccard self-join by prefix filters under several global token orders.

A document's set holds its distinct k-word shingles (64-bit hashes). If J(x, y) >= t then x and y share
at least ceil(t*n) tokens of either one, so under ANY global order of all tokens their prefixes of
p = n - ceil(t*n) + 1 tokens share one. Several orders are used and a pair must pass all of them:

* order 1 puts a fixed hash class (a share CLASS*(1-t) of all tokens) first and sorts it by the number of blocks of
  documents that have a token, rarest first, over all documents; the rest follows by hash. Its prefixes are the
  join keys. Tokens of one document are counted and dropped before any document meets another.
* orders 2 and 3 are independent hash orders; their prefixes must overlap too before a pair is verified.
* order 4 is the exact frequency order among documents that meet in one task.

Documents with equal sets form one class (128-bit identity) and only classes are joined. A bucket (classes sharing a
prefix token) is never expanded into pairs: its most central class is verified against the others, components are
joined, and buckets that lie inside one component are finished. The classes of buckets that remain after HUB_ROUNDS
rounds meet in tasks, by the components of their shared prefix tokens (or by one token, where those hold more than
UNIT tokens). A task keeps the inverted lists of its classes' prefixes under all orders, looks each class up that is
not in the largest component, verifies what passes every order, and gives out only links that join components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, bound_batches, mix, shingle_hashes
from .components import components
from .exchange import ASKED, asked, batches, cells, codes_of, compared, edges, squeeze, unsqueeze

CLASS = 2.2
HUB_ROUNDS = 3
#: Tokens of the classes that one task compares.
UNIT = 8 << 20
#: Bytes of text in a block, and for each bucket of tokens.
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
ORDER_SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)

BLOCKS = "block long, members binary, meta binary, text binary"


def prefix_length(n, percent: int):
    """Prefix that must hold a shared token: n - ceil(percent * n / 100) + 1; 0 for an empty set."""
    return (n - (percent * n + 99) // 100 + 1) * (n > 0)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    values = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _class_id(s: np.ndarray) -> tuple[int, int]:
    """Identity of a shingle set: two independent 64-bit hashes of its tokens."""
    n = np.uint64(len(s))
    one, two = (mix((mix(s ^ np.uint64(seed)).sum(dtype=np.uint64) + n)[None]).view(np.int64)[0] for seed in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25))
    return int(one), int(two)


def _class_limit(percent: int) -> int:
    """Tokens whose top byte is below it are in the hash class of order 1."""
    return min(256, round(256 * CLASS * (1 - percent / 100)) + 1)


def _blocks(k: int):
    """Blocks of texts: members (doc, text key, class, place of the class's text, size; no doc: a flag), and each class once."""

    def rows(got: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        task, made = TaskContext.get().partitionId() << 20, 0
        members: list[tuple] = []
        own: dict[tuple[int, int], int] = {}
        texts: list[bytes] = []
        total = 0

        def block() -> tuple:
            sizes = np.array([len(t) for t in texts], "<i8")
            return task | made, squeeze(np.array(members, "<i8").tobytes()), squeeze(sizes.tobytes()), squeeze(b"".join(texts))

        for b in got:
            for doc, key, text in cells(b):
                s = shingle_hashes(text, k)
                c = _class_id(s)
                if c not in own:
                    own[c] = len(texts)
                    texts.append((text or "").encode("utf-8", "surrogatepass") if len(s) else b"")
                    total += len(texts[-1])
                members.append((doc or 0, key or 0, *c, own[c], len(s), doc is None))
                if total >= BLOCK_BYTES or len(members) >= 1 << 19:
                    yield block()
                    members, own, texts, total, made = [], {}, [], 0, made + 1
        if members:
            yield block()

    return lambda got: batches(rows(got), BLOCKS)


def _members(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in got:
        for block, members in cells(b):
            m = np.frombuffer(unsqueeze(members), "<i8").reshape(-1, 7)
            cols = [pa.array(m[:, 0], mask=m[:, 6].astype(bool)), *(pa.array(np.ascontiguousarray(m[:, i])) for i in (1, 2, 3, 5)), pa.array((block << 20) + m[:, 4])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "c1", "c2", "n", "at"])


def _texts(meta: bytes, text: bytes) -> list[str]:
    ends = np.cumsum(np.frombuffer(unsqueeze(meta), "<i8")).tolist()
    raw = unsqueeze(text)
    return [raw[a:e].decode("utf-8", "surrogatepass") for a, e in zip([0, *ends[:-1]], ends, strict=True)]


def _owned(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the texts of the classes that they own."""

    def rows() -> Iterator[tuple]:
        for b in got:
            for block, meta, text, own in cells(b):
                own = sorted(own)
                sizes = np.frombuffer(unsqueeze(meta), "<i8")
                ends = np.cumsum(sizes)
                raw = unsqueeze(text)
                at = [x & ((1 << 20) - 1) for x in own]
                yield block, squeeze(np.array(own, "<i8").tobytes()), squeeze(sizes[at].tobytes()), squeeze(b"".join(raw[ends[i] - sizes[i] : ends[i]] for i in at))

    return batches(rows(), BLOCKS)


def _first_tokens(text: str, k: int, percent: int) -> tuple[np.ndarray, int, int]:
    """Tokens that can be in a prefix of order 1, how many of them are in the hash class, and the size of the set."""
    s = shingle_hashes(text, k)
    limit = _class_limit(percent)
    c0 = int(np.searchsorted(s, np.uint64(limit << 56))) if limit < 256 else len(s)  # s is sorted: the class is its lower end
    return s[: max(c0, int(prefix_length(len(s), percent)))], c0, len(s)


def _ask(k: int, percent: int, buckets: int):
    def rows(got: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in got:
            for block, _, meta, text in cells(b):
                yield from asked(np.unique(np.concatenate([_first_tokens(t, k, percent)[0] for t in _texts(meta, text)])), block, buckets)

    return lambda got: batches(rows(got), ASKED)


def _log_code(num: np.ndarray) -> np.ndarray:
    """0 for a hash of one block, else rising with the number of blocks."""
    return np.where(num > 1, np.minimum(255, np.log2(num.clip(1)) * 6), 0).astype(np.uint8)


def _prefixes(k: int, percent: int, buckets: int):
    """Rows (class, size, tokens of its own, token) of the shared tokens in each class's prefix under order 1."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in got:
            for ids, meta, text, answers in cells(b):
                of = np.frombuffer(unsqueeze(ids), "<i8")
                found = [_first_tokens(t, k, percent) for t in _texts(meta, text)]
                token = np.concatenate([f[0] for f in found])
                c0, n = (np.array([f[i] for f in found]) for i in (1, 2))
                num = np.array([len(f[0]) for f in found])
                cls = np.repeat(np.arange(len(found)), num)
                late = np.arange(len(token)) - np.repeat(np.cumsum(num) - num, num) >= np.repeat(c0, num)
                known, back, here = np.unique(token, return_inverse=True, return_counts=True)
                code = codes_of(known, answers, buckets)
                shared = ((code > 0) | (here > 1))[back]
                lone = c0 - np.bincount(cls[shared & ~late], minlength=len(found))
                need = prefix_length(n, percent)
                cls, token, rank, late = cls[shared], token[shared], np.where(late, 0, code[back])[shared], late[shared]
                order = np.lexsort((token, rank, late, cls))
                cls, token = cls[order], token[order]
                first = edges(cls)
                place = np.arange(len(cls)) - np.repeat(first, np.diff(first, append=len(cls)))
                use = place < np.where(c0 >= need, np.maximum(need - lone, 0), len(token))[cls]
                cls, token = cls[use], token[use]
                yield pa.RecordBatch.from_arrays([pa.array(of[cls]), pa.array(n[cls]), pa.array(lone[cls]), pa.array(token.view(np.int64))], ["cid", "n", "lone", "token"])

    return run


def _orders(s: np.ndarray, percent: int) -> list[np.ndarray]:
    """Prefixes of a set under orders 2 and 3."""
    p = int(prefix_length(len(s), percent))
    hashes = [mix(s ^ np.uint64(seed)) for seed in ORDER_SEEDS]
    return [np.partition(h, p - 1)[:p] if p else h for h in hashes]


def _sets(k: int, percent: int):
    """Whole sets and the other orders' prefixes of the wanted classes of a block."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in got:
            for ids, meta, text, wanted in cells(b):
                of, want = np.frombuffer(unsqueeze(ids), "<i8").tolist(), set(wanted)
                mine = [(c, shingle_hashes(t, k)) for c, t in zip(of, _texts(meta, text), strict=True) if c in want]
                for a in range(0, len(mine), 500):
                    part = mine[a : a + 500]
                    orders = [_orders(s, percent) for _, s in part]
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in part], pa.int64()), _lists([s for _, s in part]), *(_lists([o[i] for o in orders]) for i in (0, 1))], ["cid", "tokens", "order2", "order3"])

    return run


def _verify(percent: int):
    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in got:
            keep = []
            cols = [b.column(i) for i in (2, 3)]
            flat = [c.values.to_numpy(zero_copy_only=False) for c in cols]
            off = [c.offsets.to_numpy() for c in cols]
            for i in range(b.num_rows):
                x, y = (f[o[i] : o[i + 1]] for f, o in zip(flat, off, strict=True))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Lists:
    """Inverted lists: which sets hold a token."""

    def __init__(self, sets: list[np.ndarray]):
        token = np.concatenate(sets)
        order = np.argsort(token, kind="stable")
        self.own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
        first = edges(token[order])
        self.token, self.cut = token[order][first], np.append(first, len(token))

    def of(self, tokens: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.token, tokens)
        return np.concatenate([self.own[a:e] for a, e in zip(self.cut[at].tolist(), self.cut[at + 1].tolist(), strict=True)])


def spanning_links(sets: list[np.ndarray], root: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links J >= percent/100 between sets (sorted distinct tokens) that join all that links can join, beyond equal roots.

    A pair is verified only if its prefixes overlap under every order: two hash orders and the frequency order here.
    """
    n = np.array([len(s) for s in sets])
    token = np.concatenate(sets)
    known, back, often = np.unique(token, return_inverse=True, return_counts=True)
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(known))
    ranks = np.split(rank[back], np.cumsum(n)[:-1])
    orders = [[np.partition(r, p - 1)[:p] for r, p in zip(ranks, prefix_length(n, percent).tolist(), strict=True)]]
    hashed = [_orders(s.view(np.uint64), percent) for s in sets]
    orders += [[h[i] for h in hashed] for i in range(len(ORDER_SEEDS))]
    lists = [_Lists(o) for o in orders]
    whole = _Lists(ranks)
    label = np.unique(root, return_inverse=True)[1]
    unseen = np.ones(len(sets), bool)
    out: list[tuple[int, int]] = []
    # whatever set is the largest at last, all outside of it have been looked up by then
    while len(todo := np.flatnonzero(unseen & (label != np.bincount(label).argmax()))):
        x = int(todo[0])
        unseen[x] = False
        fits = (label != label[x]) & (n * 100 >= n[x] * percent) & (n[x] * 100 >= n * percent)
        for o, index in zip(orders, lists, strict=True):
            if not fits.any():
                break
            met = np.zeros(len(sets), bool)
            met[index.of(o[x])] = True
            fits &= met
        some = np.flatnonzero(fits)
        if not len(some):
            continue
        both = np.bincount(whole.of(ranks[x]), minlength=len(sets))[some]
        linked = some[100 * both >= percent * (n[x] + n[some] - both)]
        for y in linked.tolist():
            if label[y] != label[x]:
                out.append((x, y))
                label[label == label[y]] = label[x]
    return out


def _meet(percent: int):
    """Rows (token, cluster, cid, root, tokens) sorted by the first two: links of each unit."""

    def run(got: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def links() -> pa.RecordBatch:
            found = spanning_links([h[2] for h in held], np.array([h[1] for h in held]), percent) if len(held) > 1 else []
            a, b = (np.array([held[p[i]][0] for p in found], np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for b in got:
            flat, off = b.column(4).values.to_numpy(zero_copy_only=False), b.column(4).offsets.to_numpy()
            for i, (token, cluster, cid, root) in enumerate(zip(*(b.column(j).to_pylist() for j in range(4)), strict=True)):
                if (token, cluster) != now:
                    if held:
                        yield links()
                    now, held = (token, cluster), []
                held.append((cid, root, flat[off[i] : off[i + 1]].copy()))
        if held:
            yield links()

    return run


def jaccard_components(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Components of the links J >= percent/100 over k-word shingle sets of docs(doc_id, text).

    Returns one row per input row: doc_id, text_key (hash that tells rows of one doc_id apart), n_shingles, component
    (number of its component, null without one), component_id (smallest doc_id reachable, itself included). Null, empty and blank texts have an empty set and
    link with nothing. Rows with a null doc_id keep their row; their component is null unless their set equals that
    of a row with an id. Repeated rows are equal sets and so fall together. Rows of one doc_id with other texts are
    sets of their own. Other columns are ignored. An empty table gives no rows.
    """
    bound_batches(spark)
    t = Tables(spark, "jaccard")
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    made = t.save(texts.mapInArrow(_blocks(k), BLOCKS), "blocks")
    sig = t.save(made.select("block", "members").mapInArrow(_members, "doc_id long, text_key long, c1 long, c2 long, n long, at long"), "signatures")
    classes = sig.filter("n > 0 and doc_id is not null").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.min("at").alias("cid"))
    classes = t.save(classes, "classes")
    own = classes.select("cid", F.shiftright("cid", 20).alias("block")).groupBy("block").agg(F.collect_list("cid").alias("own"))
    blocks = t.save(made.select("block", "meta", "text").join(own, "block").mapInArrow(_owned, BLOCKS), "owned")
    t.drop("blocks")

    # Prefix rows under order 1.
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    buckets = tasks
    asking = compared(blocks, _ask(k, percent, buckets), _log_code, tasks).select("members", "meta", "text", "answers")
    prefix = t.save(asking.mapInArrow(_prefixes(k, percent, buckets), "cid long, n long, lone long, token long"), "prefix")
    live = prefix.join(prefix.groupBy("token").count().filter("count > 1").select("token"), "token", "left_semi")
    live = t.save(live, "live-0")
    t.drop("prefix")

    # Whole sets and the other orders' prefixes of every class that has a bucket partner.
    wanted = live.select("cid").distinct().groupBy(F.shiftright("cid", 20).alias("block")).agg(F.collect_list("cid").alias("wanted"))
    sets = t.save(blocks.join(wanted, "block").select("members", "meta", "text", "wanted").mapInArrow(_sets(k, percent), "cid long, tokens array<long>, order2 array<long>, order3 array<long>"), "sets")
    t.drop("owned")
    t.release()

    links, roots = None, None
    fits = (F.col("nb") * 100 >= F.col("na") * percent) & (F.col("na") * 100 >= F.col("nb") * percent)

    def with_root(x: DataFrame) -> DataFrame:
        if roots is None:
            return x.withColumn("root", F.col("cid"))
        return x.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))

    def verified(pairs: DataFrame) -> DataFrame:
        """The linked ones of distinct pairs (a, b): other orders first, whole sets for what is left."""
        pre = [sets.select(F.col("cid").alias(c), F.col("order2").alias(f"{c}2"), F.col("order3").alias(f"{c}3")) for c in "ab"]
        some_left = pairs.join(pre[0], "a").join(pre[1], "b").filter(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")).select("a", "b")
        whole = [sets.select(F.col("cid").alias(c), F.col("tokens").alias(f"t{c}")) for c in "ab"]
        both = some_left.join(whole[1], "b").join(whole[0], "a").select("a", "b", "ta", "tb")
        return both.mapInArrow(_verify(percent), "a long, b long")

    def met(opened: DataFrame, step: int) -> DataFrame:
        """Links among the classes of open buckets, found in tasks."""
        lows = opened.groupBy("token").agg(F.min("cid").alias("a"))
        cluster = components(t, opened.select("token", F.col("cid").alias("b")).join(lows, "token").select("a", "b"), f"units-{step}")
        rows = opened.select("token", "cid", "n", "root").join(cluster.select(F.col("node").alias("cid"), F.col("root").alias("cluster")), "cid")
        large = rows.dropDuplicates(["cid"]).groupBy("cluster").agg(F.sum("n").alias("total")).filter(F.col("total") > UNIT).select("cluster", F.lit(True).alias("large"))
        rows = rows.join(large, "cluster", "left").select(F.when(F.col("large"), F.col("token")).alias("token"), "cluster", "cid", "root").distinct()
        units = rows.join(sets.select("cid", "tokens"), "cid").select("token", "cluster", "cid", "root", "tokens")
        return units.repartition(tasks, "token", "cluster").sortWithinPartitions("token", "cluster").mapInArrow(_meet(percent), "a long, b long")

    step = 0
    while True:
        rooted = with_root(live)
        by = rooted.groupBy("token").agg(F.count("*").alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.min(F.struct("lone", "n", "cid")).alias("hub"))
        by = by.filter("size > 1 and r0 <> r1").select("token", "hub")
        opened = t.save(rooted.join(by, "token"), f"open-{step}")
        t.drop(f"live-{step}")
        if opened.isEmpty():
            break
        if step == HUB_ROUNDS:
            new = met(opened, step)
        else:
            pairs = opened.select(F.col("hub.cid").alias("a"), F.col("hub.n").alias("na"), F.col("cid").alias("b"), F.col("n").alias("nb")).filter((F.col("a") != F.col("b")) & fits)
            new = verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        new = t.save(new, f"links-{step}")
        links = new if links is None else links.union(new)
        roots = components(t, links, f"cc-{step}")
        if step == HUB_ROUNDS:
            break
        step += 1
        live = t.save(opened.filter(F.col("cid") != F.col("hub.cid")).select("cid", "n", "lone", "token"), f"live-{step}")
        t.drop(f"open-{step - 1}")

    named = with_root(classes.select("cid", "c1", "c2", "rep"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = t.save(named.join(least, "root").select("c1", "c2", F.col("root").alias("component"), "component_id"), "named")
    for name in ("sets", *(f"{x}-{i}" for i in range(HUB_ROUNDS + 1) for x in ("open", "live", "links"))):
        t.drop(name)
    out = sig.join(named, ["c1", "c2"], "left")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
