"""N-gram Jaccard join by a token-group matrix.

Tokens are hashed 5-word shingles of the lower-cased text. Documents of the same
token set are one class. Classes are partitioned into groups of similar ones,
and a matrix holds each group's token union; a class is compared with a group's
members only if the overlap with that union can reach the threshold.

1. Every document gives its set's size and fingerprint, and every task the
   tokens that several of its sets have. Their counts, added up, sort tokens into
   a few levels, told by Bloom filters of a fixed size; tokens are ordered by
   level, then by hash. Any fixed order gives the same links; this one keeps
   tokens of common passages out of the prefixes.
2. Sets x and y with |x & y| >= 0.8 |x u y| share k tokens among the first
   |x| - ceil(0.8 |x|) + k of x and those of y; k is one and a twentieth of the
   smaller set. So a class that shares fewer prefix tokens with all others has no
   link, which holds for most texts, also for those with a common passage.
   The smaller set x even shares k tokens among its first |x| - ceil(8 |x| / 9) + k
   with that prefix of y, as |x & y| >= 8 |x| / 9: its early tokens.
   Classes that share enough are written once, with their tokens and with a bitmap of
   these of about eight bits a token. A bit of x that y lacks is a token of x
   outside y, so two bitmaps bound the overlap, at a tenth of the sets' size.
3. Groups: in each of a few rounds every prefix token names one leader, first the
   class with the most common tokens, then another one each time, and each group
   tries the leader that most of its prefix tokens name. Linked groups become one.
   Thousands of near copies meet this way with a few comparisons each.
4. Matrix: as k early tokens are shared, one of any but k - 1 of them is; those in
   the fewest classes are a class's probes. Edited copies of one text that are too far apart for
   a link hardly have any. Classes and other groups that share a probe of the
   smaller set are the pairs that may still link. A group's rows are the unions of its members' bitmaps,
   some members a row; only parts whose union lets the overlap reach the threshold
   are opened, and there a class meets the bitmaps of all members of fitting size.
5. Pairs that the bitmaps allow are compared token by token: first the likeliest
   one of each two groups, then all that are left between groups still apart.

So components are exact but for 64-bit hashes: no band, cap or sample decides.
Null, empty or white texts have the empty set and link with nothing. Documents
with a null id take part; a component's id is the smallest id that isn't null.
Repeated rows are one class; each row gets its result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MIX_1, MIX_2, Membership, discard, documents, id_text, mixed, stored, text_slices
from .components import relabelled
from .hashing import shingle_sets

WIDTH = 5
#: Tokens that a task compares at a time to see which are common.
AT_ONCE = 1 << 22
#: Classes and bytes of bitmaps that a part of a group's matrix has on average at most.
PART_ROWS, PART_BYTES = 32, 1 << 15
#: Common tokens that the filters of the order hold at most.
COMMON = 1 << 21


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit fingerprint of a set of tokens."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(mixed(tokens ^ MIX_1)) * MIX_2 + np.uint64(len(tokens))
    return int(np.array(mixed(np.array([total])), np.uint64).view(np.int64)[0])


def needed(n):
    """ceil(0.8 n): the tokens that a partner of a set of n tokens must share."""
    return (4 * n + 4) // 5


def profiles(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, key, n, cid), and rows of tokens that several
    different sets of a task have (ts, cs)."""
    kind = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("ts", pa.list_(pa.int64())), ("cs", pa.list_(pa.int32()))])

    def scan(batches):
        seen: set[int] = set()
        held, size = [], 0

        def common() -> pa.RecordBatch:
            t = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
            c = np.diff(np.append(at, len(t)))
            t, c = t[at[c > 1]], c[c > 1]
            ends = pa.array(np.array([0, len(t)], np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (t.view(np.int64), c.astype(np.int32))]
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + lists, schema=kind)

        for batch in batches:
            for a, b, raw, offsets in text_slices(batch.column(2)):
                tokens, begin = shingle_sets(raw, offsets, WIDTH)
                n = np.diff(begin)
                cid = [set_key(tokens[begin[k] : begin[k + 1]]) if n[k] else None for k in range(b - a)]
                for k, x in enumerate(cid):
                    if x is not None and x not in seen:
                        seen.add(x)
                        held.append(tokens[begin[k] : begin[k + 1]])
                        size += int(n[k])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n), pa.array(cid, pa.int64()), pa.nulls(b - a, kind.field(4).type), pa.nulls(b - a, kind.field(5).type)], schema=kind)
                if size > AT_ONCE:
                    yield common()
                    held, size = [], 0
                if len(seen) > 1_000_000:
                    seen.clear()
        yield common()

    return docs.select("doc_id", "key", "text").mapInArrow(scan, "doc_id long, key long, n long, cid long, ts array<long>, cs array<int>")


def common_levels(profile: DataFrame) -> list[Membership]:
    """Filters of the tokens that are common, more common and most common; the
    first holds no more than COMMON tokens, the counts of the others are eight
    times as large each."""
    counts = profile.where("ts is not null").select(F.explode(F.arrays_zip("ts", "cs")).alias("x")).groupBy(F.col("x.ts").alias("t")).agg(F.floor(F.log2(F.sum("x.cs"))).cast("int").alias("level"))
    counts = stored(counts)
    found = {r.level: r["count"] for r in counts.groupBy("level").count().collect()}
    least = next((h for h in range(1, 64) if sum(n for k, n in found.items() if k >= h) <= COMMON), 64)
    return [Membership.of(counts.where(F.col("level") >= h).select("t")) for h in (least, least + 3, least + 6) if any(k >= h for k in found)]


def levels_of(tokens: np.ndarray, levels: list[Membership]) -> np.ndarray:
    out, some = np.zeros(len(tokens), np.int8), np.arange(len(tokens))
    for level in levels:
        some = some[level.has(tokens[some])]
        out[some] += 1
    return out


def prefixes(docs: DataFrame, order, only=None) -> DataFrame:
    """t, cid for each prefix token t of each set; with a filter of tokens one row
    per class that has some of them: cid, n, ts, how many of these are in the
    prefix that does for partners of its size or more, tokens (ascending), bits."""
    schema = "cid long, n long, ts array<long>, first int, tokens binary, bits binary" if only else "t long, cid long"

    def scan(batches):
        rank, kept = order.value, only.value if only else None
        seen: set[int] = set()
        for batch in batches:
            for _, _, raw, offsets in text_slices(batch.column(0)):
                tokens, begin = shingle_sets(raw, offsets, WIDTH)
                freq = levels_of(tokens, rank)
                out, cids, sets, short = [], [], [], []
                for k in range(len(begin) - 1):
                    own = tokens[begin[k] : begin[k + 1]]
                    n = len(own)
                    if not n or (key := set_key(own)) in seen:
                        continue
                    seen.add(key)
                    p, f = n - needed(n) + extra(n), freq[begin[k] : begin[k + 1]]
                    # The p first by level, then by hash; own ascends, so a stable sort will do.
                    t = own[np.argsort(f, kind="stable")[:p]]
                    if kept is not None:
                        known = kept.has(t)
                        if known.sum() < extra(needed(n)):
                            continue
                        t = t[known]
                        short.append(int(known[: n - (8 * n + 8) // 9 + extra(n)].sum()))
                        sets.append(own)
                    out.append(t)
                    cids.append(key)
                if len(seen) > 1_000_000:
                    seen.clear()
                if not out:
                    continue
                size = np.fromiter(map(len, out), np.int64, len(out))
                ts = pa.array(np.concatenate(out).view(np.int64))
                if kept is None:
                    yield pa.RecordBatch.from_arrays([ts, pa.array(np.repeat(np.array(cids, np.int64), size))], ["t", "cid"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), ts)
                    bits = [bitmap(x, bitmap_bits(len(x))).tobytes() for x in sets]
                    yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), lists, pa.array(short, pa.int32()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(bits, pa.binary())], ["cid", "n", "ts", "first", "tokens", "bits"])

    return docs.select("text").mapInArrow(scan, schema)


def sets_of(ids: DataFrame, held: DataFrame) -> DataFrame:
    """cid, tokens of the classes with the given ids (one column)."""
    wanted = held.sparkSession.sparkContext.broadcast(Membership.of(ids))

    def scan(batches):
        filter_ = wanted.value
        for batch in batches:
            yield batch.filter(pa.array(filter_.has(batch.column(0).to_numpy()))) if batch.num_rows else batch

    return held.select("cid", "tokens").mapInArrow(scan, "cid long, tokens binary").groupBy("cid").agg(F.any_value("tokens").alias("tokens"))


def linked(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Of pairs (a, b, x, y) of classes and their groups, the groups (a, b) of those that link."""

    def compare(batches):
        for batch in batches:
            keep = []
            for s, t in zip(batch.column(2), batch.column(3)):
                s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                both = np.concatenate([s, t])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= 80 * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cid")), held)
    one = own.select(F.col("cid").alias("a"), F.col("tokens").alias("s"))
    two = own.select(F.col("cid").alias("b"), F.col("tokens").alias("t"))
    return pairs.join(one, "a").join(two, "b").select("x", "y", "s", "t").mapInArrow(compare, "a long, b long").distinct()


def allowed(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, x, y, n, m, p, q) with sizes and bitmaps, those whose
    overlap may reach the threshold, and by how many tokens: a, b, x, y, spare."""

    def scan(batches):
        for batch in batches:
            spare = []
            for n, m, p, q in zip(*(batch.column(k) for k in range(4, 8))):
                n, m = n.as_py(), m.as_py()
                p, q = np.frombuffer(p.as_buffer(), np.uint8), np.frombuffer(q.as_buffer(), np.uint8)
                size = 8 * min(len(p), len(q))
                p, q = folded(p, size), folded(q, size)
                most = min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum()))
                spare.append(9 * most - 4 * (n + m))  # 0 or more where the Jaccard similarity may be 0.8
            spare = pa.array(spare, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], spare], ["a", "b", "x", "y", "spare"]).filter(pa.array(spare.to_numpy() >= 0))

    return pairs.select("a", "b", "x", "y", "n", "m", "p", "q").mapInArrow(scan, "a long, b long, x long, y long, spare long")


def allowed_of(opened: DataFrame) -> DataFrame:
    """Of rows (cid, grp, n, bits, block), with the classes of a part of the group
    (cid, n, bits), the pairs that allowed() would give: a, b, y, spare."""

    def scan(batches):
        for batch in batches:
            out = []
            for a, y, n, own, block in zip(*(batch.column(k) for k in range(5))):
                a, y, n, own = a.as_py(), y.as_py(), n.as_py(), np.frombuffer(own.as_buffer(), np.uint8)
                for other in block.values:
                    b, m, bits = (other[k] for k in ("cid", "n", "bits"))
                    m = m.as_py()
                    if 5 * n < 4 * m or 5 * m < 4 * n:
                        continue
                    q = np.frombuffer(bits.as_buffer(), np.uint8)
                    size = 8 * min(len(own), len(q))
                    p, q = folded(own, size), folded(q, size)
                    spare = 9 * min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum())) - 4 * (n + m)
                    if spare >= 0:
                        out.append((a, b.as_py(), y, spare))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], ["a", "b", "y", "spare"])

    return opened.select("cid", "grp", "n", "bits", "block").mapInArrow(scan, "a long, b long, y long, spare long")


def extra(n):
    """The tokens that the prefix of a set of n tokens is longer than what it may lack."""
    return 1 + n // 20


def least_shared(n):
    """The prefix tokens that a set of n tokens shares with each partner, at least."""
    return F.lit(1) + F.floor(F.floor((4 * n + 4) / 5) / 20)


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, bool)
    out[(mixed(tokens) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out)


def bitmap_bits(n: int) -> int:
    """Eight bits or more a token, a power of two."""
    return max(256, 1 << (8 * n - 1).bit_length())


def folded(packed: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of fewer bits of the same tokens."""
    while len(packed) * 8 > bits:
        packed = packed[: len(packed) // 2] | packed[len(packed) // 2 :]
    return packed


def matrix_parts(members: DataFrame) -> DataFrame:
    """From (grp, part, n, bits) of classes: grp, part, low and high size, union bitmap, as one row per task and part of a group."""

    def scan(batches):
        rows: dict[tuple, list] = {}

        def out():
            r = [(*g, *v) for g, v in rows.items()]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in r], t) for k, t in enumerate((*[pa.int64()] * 4, pa.binary()))], ["grp", "part", "low", "high", "bitmap"])

        held = 0
        for batch in batches:
            for *at, n, own in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                grp = tuple(at)
                own = np.frombuffer(own.as_buffer(), np.uint8)
                low, high, old = rows.get(grp, (n, n, None))
                if old is not None:
                    old = np.frombuffer(old, np.uint8)
                    size = 8 * min(len(old), len(own))
                    own = folded(own, size) | folded(old, size)
                rows[grp] = (min(low, n), max(high, n), own.tobytes())
                held += len(own)
                if held > 32_000_000:
                    yield out()
                    rows, held = {}, 0
        yield out()

    return members.select("grp", "part", "n", "bits").mapInArrow(scan, "grp long, part long, low long, high long, bitmap binary")


def qualifying(queries: DataFrame) -> DataFrame:
    """Of rows (cid, grp, part, n, low, high, bits, bitmap) with a part of the group's
    matrix row, those where the overlap with the union can reach what n needs.
    Parts of a group are bounded one by one: each is the union of some members."""

    def scan(batches):
        for batch in batches:
            keep = []
            for n, low, high, own, union in zip(*(batch.column(k) for k in range(3, 8))):
                n, low, high = n.as_py(), low.as_py(), high.as_py()
                own, union = np.frombuffer(own.as_buffer(), np.uint8), np.frombuffer(union.as_buffer(), np.uint8)
                size = 8 * min(len(own), len(union))
                outside = int(np.bitwise_count(folded(own, size) & ~folded(union, size)).sum())
                keep.append(4 * low <= 5 * n and 4 * n <= 5 * high and n - outside >= needed(max(n, low)) and 9 * (n - outside) >= 4 * (n + low))
            yield pa.RecordBatch.from_arrays(batch.columns[:3], ["cid", "grp", "part"]).filter(pa.array(keep, pa.bool_()))

    return queries.select("cid", "grp", "part", "n", "low", "high", "bits", "bitmap").mapInArrow(scan, "cid long, grp long, part long").distinct()


def compatible(a: str, b: str):
    return (F.col(a) * 5 >= F.col(b) * 4) & (F.col(b) * 5 >= F.col(a) * 4)


def narrowed(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Of rows (t, cid, n, grp, early), with the groups that labels give, those that may
    still lead to another group: of tokens that several groups have, and of
    classes with enough of these; of: the rows of the token. The old table goes."""
    now = rows.drop("of")
    if labels is not None:
        now = now.drop("grp").join(labels.select(F.col("id").alias("cid"), F.col("label").alias("grp")), "cid")
        now = stored(now)
    several = now.groupBy("t").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count("*").alias("of")).where("lo <> hi").select("t", "of")
    part = stored(now.join(several, "t"))
    enough = part.groupBy("cid", "n").agg(F.count("*").alias("times")).where(F.col("times") >= least_shared(F.col("n"))).select("cid")
    out = stored(part.join(enough, "cid").select("t", "cid", "n", "grp", "early", "of"))
    discard(rows, part, *([now] if labels is not None else []))
    return out


def components(docs: DataFrame, leader_rounds: int = 6) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, key, text. Its rows as (doc_id, key, n, cid), and the label
    of the component of each class (cid, label) that may have links."""
    context = docs.sparkSession.sparkContext
    profile = stored(profiles(docs))
    order = context.broadcast(common_levels(profile))

    shared = stored(prefixes(docs, order).groupBy("t").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b").select("t"))
    alive = context.broadcast(Membership.of(shared))
    held = stored(prefixes(docs, order, alive))
    rows = stored(held.select("cid", "n", "first", F.posexplode("ts").alias("at", "t")).select("cid", "n", "t", (F.col("at") < F.col("first")).alias("early")).distinct().join(shared, "t").withColumn("grp", F.col("cid")))
    rows = narrowed(rows, None)
    bits = stored(held.groupBy("cid").agg(F.any_value("n").alias("n"), F.any_value("bits").alias("bits")).join(rows.select("cid").distinct(), "cid"))
    labels = stored(bits.select(F.col("cid").alias("id"), F.col("cid").alias("label")))

    def bounded(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, x, y) that the bitmaps allow."""
        one = bits.select(F.col("cid").alias("a"), "n", F.col("bits").alias("p"))
        two = bits.select(F.col("cid").alias("b"), F.col("n").alias("m"), F.col("bits").alias("q"))
        return stored(allowed(pairs.join(one, "a").join(two, "b")))

    for k in range(leader_rounds):
        # The first leader of a token is the class whose tokens most classes have, so
        # that edited copies of one text meet the one that was edited least.
        ranked = rows.withColumn("h", F.xxhash64("grp", F.lit(k)))
        if k == 0:
            central = rows.groupBy("cid").agg((-F.sum("of")).alias("h"))
            ranked = rows.join(central, "cid")
        leaders = ranked.groupBy("t").agg(F.min(F.struct("h", "grp", "cid", "n")).alias("l"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("t", F.col("l.grp").alias("y"), F.col("l.cid").alias("b"), F.col("l.n").alias("m"))
        named = rows.join(leaders, "t").where((F.col("grp") != F.col("y")) & compatible("n", "m")).groupBy(F.col("cid").alias("a"), "b", F.col("grp").alias("x"), "y").agg(F.count("*").alias("times"))
        pairs = named.groupBy("x").agg(F.max(F.struct("times", "a", "b", "y")).alias("p")).select("p.a", "p.b", "x", "p.y")
        near = bounded(pairs)
        edges = stored(linked(near, held))
        found = not edges.isEmpty()
        if found:
            labels = relabelled(labels, edges)
            rows = narrowed(rows, labels)
        discard(near, edges)
        if not found:
            break

    # The classes of the smaller group of two ask the larger one. The smaller of two
    # sets shares k of its early tokens with the other's prefix, so of any but k - 1 of
    # these one: those that the fewest classes have, its probes.
    sizes = labels.groupBy(F.col("label").alias("grp")).agg(F.count("*").alias("size"))
    order = Window.partitionBy("cid").orderBy(F.desc("early"), "of", "t")
    known = F.count_if("early").over(Window.partitionBy("cid"))
    ranked = rows.withColumns({"at": F.row_number().over(order), "known": known})
    asking = ranked.select("t", "cid", "n", "grp", (F.col("early") & (F.col("at") <= F.col("known") - F.floor(F.col("n") / 20))).alias("probe"))
    asking = stored(asking.join(sizes, "grp"))
    probe = F.when(F.col("probe"), F.col("n"))
    groups = asking.groupBy("t", F.col("grp").alias("g"), F.col("size").alias("of")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min(probe).alias("probe_low"), F.max(probe).alias("probe_high"))
    smaller = F.col("probe") & (F.col("n") <= F.col("high")) & (F.col("low") * 4 <= F.col("n") * 5)
    larger = (F.col("probe_low") < F.col("n")) & (F.col("n") * 4 <= F.col("probe_high") * 5)
    queries = asking.join(groups, "t").where((F.struct("of", "g") > F.struct("size", "grp")) & (smaller | larger))
    queries = stored(queries.select("cid", F.col("g").alias("grp")).distinct())
    members = labels.select(F.col("id").alias("cid"), F.col("label").alias("grp"))
    inside = members.join(queries.select("grp").distinct(), "grp").join(bits, "cid")
    parts = inside.groupBy("grp").agg(F.ceil(F.greatest(F.count("*") / PART_ROWS, F.sum(F.length("bits")) / PART_BYTES)).alias("parts"))
    inside = stored(inside.join(parts, "grp").withColumn("part", F.pmod(F.xxhash64("cid"), "parts")).drop("parts"))
    opened = stored(qualifying(queries.join(bits, "cid").join(matrix_parts(inside), "grp"))).join(bits, "cid")
    blocks = inside.groupBy("grp", "part").agg(F.collect_list(F.struct("cid", "n", "bits")).alias("block"))
    pairs = stored(allowed_of(opened.join(blocks, ["grp", "part"])))

    def apart() -> DataFrame:
        """Pairs whose classes are in different groups now."""
        one = labels.select(F.col("id").alias("a"), F.col("label").alias("x"))
        two = labels.select(F.col("id").alias("b"), F.col("label").alias("y"))
        return pairs.select("a", "b", "spare").join(one, "a").join(two, "b").where("x <> y")

    likeliest = apart().groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.max(F.struct("spare", "a", "b")).alias("p"))
    labels = relabelled(labels, linked(stored(likeliest.select("p.a", "p.b", "x", "y")), held))
    labels = relabelled(labels, linked(stored(apart().select("a", "b", "x", "y")), held))
    discard(shared, held, rows, asking, bits, queries, inside, pairs)
    return profile.where("n is not null").select("doc_id", "key", "n", "cid"), labels.select(F.col("id").alias("cid"), "label")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    rows, labels = components(id_text(docs, id_col, text_col).withColumn("key", F.lit(None).cast("long")), **options)
    found = rows.join(labels, "cid", "left").select("doc_id", "n", F.coalesce("label", "cid").alias("label"))
    smallest = found.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return found.join(smallest, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with
    the smallest id (null ids last, then by a 64-bit hash of the text), once.
    Rows without words all stay."""
    named = docs.select("*", F.col(id_col).cast("long").alias("__id"), F.xxhash64(F.col(text_col).cast("string")).alias("__key"))
    rows, labels = components(named.select(F.col("__id").alias("doc_id"), F.col("__key").alias("key"), F.col(text_col).cast("string").alias("text")), **options)
    found = rows.where("n > 0").join(labels, "cid", "left").select("doc_id", "key", F.coalesce("label", "cid").alias("label"))
    best = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    chosen = stored(best.select(F.col("best.doc_id").alias("i"), F.col("best.key").alias("k")).distinct())
    wordless = stored(rows.where("n = 0").select(F.col("key").alias("k")).distinct())
    kept = named.join(chosen, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__key") == F.col("k")), "left_semi").dropDuplicates(["__id", "__key"])
    return kept.unionByName(named.join(wordless, F.col("__key") == F.col("k"), "left_semi")).select(docs.columns)


def op5_token_group_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)"""
