"""N-gram Jaccard join by prefix filtering under several global token orders.

Two sets whose Jaccard similarity reaches t share, under any total order of the tokens, one of the
first |s| - ceil(t |s|) + 1 tokens of either. The orders here all start with tokens that only one
document has: those can't be shared, so a text is a candidate at all only if fewer tokens than its
prefix are its own. That needs exact document frequencies, which are counted without moving texts:

1. Tokenise (Arrow batches). Equal sets in a batch become one; tokens go, six bytes each, to buckets by hash. A token
   that HOT sets of one batch have already is sent once with its count, and its owners stay with the batch, so that
   a token of a third of all texts adds no more than HOT entries a batch to its bucket.
2. Each bucket counts its tokens and returns, to the batch, those of two sets or more.
3. Each batch finds its active sets: those with a shared token in a prefix. Equal active sets of all batches become one.
4. Families: components of active sets over shared prefix tokens of the first order (rarest first). Those of more than a
   block are split into components over the second order, and these by the third: linked sets share a prefix token
   under each, and within a block pairs are held to that anyway.
5. A family is worked on in blocks of bounded size by set size. Sets are linked inside blocks first, then one set of each
   component found so. What is left are pairs of different components: the sets outside a family's largest component
   meet all of its blocks that their sizes allow. So a family of very many copies of one text, which becomes one
   component early, is not compared block by block. Pairs must share prefix tokens under all three orders; what remains is verified on exact intersections (tokens that no other set has can't be in one),
   except inside what is linked already. Only a spanning forest of links is returned, never the pairs of a group.
6. Components of the links, joined back to every document.

Tokens are 48-bit hashes of shingles (a clash would have to fall into the same pair of texts to count), sets are told
apart by 128 bits, and sizes counted on 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import Union, connected_components
from .kernels import U, Words, distinct, mix, released, slices, starts
from .shared import collected, n_partitions, written

HOT = 255
#: Bytes of input, as Spark estimates them, for each bucket of tokens; and the most buckets.
BUCKET_BYTES = 4 << 20
MOST_BUCKETS = 1 << 16
BLOCK_SETS = 1024
BLOCK_TOKENS = 1_000_000

_SENT = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_SETS = pa.schema([("class", pa.binary()), ("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary()), ("prefix", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_LABELS = pa.schema([("node", pa.int64()), ("component", pa.int64())])


def with_percent(kernel: Callable[[pa.Table, int], pa.Table], percent: int) -> Callable[[pa.Table], pa.Table]:
    def bound(group: pa.Table) -> pa.Table:
        return kernel(group, percent)

    return bound


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {({pa.int32(): 'int', pa.int64(): 'long', pa.binary(): 'binary'})[f.type]}" for f in schema)


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n + (-percent * n) // 100 + 1


def _tokenise(batches: Iterator[pa.RecordBatch], k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for number, batch in enumerate(slices(batches, 1 << 20)):
        key = (part << 32) | number
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        doc, token = distinct(*Words(batch.column(1)).shingles(k))
        n = np.bincount(doc, minlength=len(ids))
        doc, token = distinct(doc, token >> U(16))
        sums = np.zeros((2, len(ids)), U)
        if len(doc):
            at = np.flatnonzero(np.bincount(doc, minlength=len(ids)))
            begin = starts(doc, len(ids))[at]
            for i in range(2):
                sums[i, at] = np.add.reduceat(mix(token, 11 + i), begin)
        sums[0] = mix(sums[0]) + n.astype(U)
        signs = np.ascontiguousarray(sums.T).view("V16").reshape(-1)
        # one of equal sets stays
        _, first, local = np.unique(signs.view("u8").reshape(-1, 2), axis=0, return_index=True, return_inverse=True)
        local = local.reshape(-1)
        keep = np.zeros(len(ids), bool)
        keep[first] = True
        mine = keep[doc]
        token, owner = token[mine], local[doc[mine]]
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
        size = np.diff(np.append(begin, len(token)))
        hot = np.repeat(size >= HOT, size)
        rows = [(int(key % buckets), key, 0, ids.tobytes(), n.astype(np.int64).tobytes(), signs.tobytes(), local.astype(np.uint16).tobytes())]
        rows.append((int(key % buckets), key, 3, _packed(token[hot]), owner[hot].astype(np.uint16).tobytes(), np.full(hot.sum(), HOT, np.uint8).tobytes(), b""))
        for kind, t, x in ((1, token[~hot], owner[~hot].astype(np.uint16)), (2, token[begin[size >= HOT]], size[size >= HOT].astype(np.uint16))):
            to = (t % U(buckets)).astype(np.int64)
            order = np.lexsort((x, to)) if kind == 1 else np.argsort(to, kind="stable")
            t, x, to = t[order], x[order], to[order]
            cut = starts(to, buckets)
            for b in np.flatnonzero(np.diff(cut)):
                s = slice(cut[b], cut[b + 1])
                rows.append((int(b), key, kind, _packed(t[s]), x[s].tobytes(), b"", b""))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT)], schema=_SENT)


def _packed(token: np.ndarray) -> bytes:
    """48-bit numbers, six bytes each."""
    return (token & U(0xFFFFFFFF)).astype(np.uint32).tobytes() + (token >> U(32)).astype(np.uint16).tobytes()


def _wide(packed: bytes) -> np.ndarray:
    n = len(packed) // 6
    return np.frombuffer(packed, np.uint32, n).astype(U) | (np.frombuffer(packed, np.uint16, n, 4 * n).astype(U) << U(32))


def _count(group: pa.Table) -> pa.Table:
    """Tokens of two sets or more, by batch; what isn't a bucket's own passes."""
    rows = group.to_pylist()
    own = [r for r in rows if r["kind"] in (1, 2)]
    out = [tuple(r.values()) for r in rows if r["kind"] in (0, 3)]
    if own:
        tokens = [_wide(r["a"]) for r in own]
        every = np.concatenate(tokens)
        weight = np.concatenate([np.frombuffer(r["b"], np.uint16) if r["kind"] == 2 else np.ones(len(t), np.uint16) for r, t in zip(own, tokens)])
        order = np.argsort(every, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
        total = np.add.reduceat(weight[order].astype(np.int64), begin)
        count = np.empty(len(every), np.uint8)
        count[order] = np.repeat(np.minimum(total, HOT), np.diff(np.append(begin, len(every)))).astype(np.uint8)
        at = 0
        for r, t in zip(own, tokens):
            c = count[at : at + len(t)]
            at += len(t)
            if r["kind"] == 1 and (more := c > 1).any():
                out.append((r["bucket"], r["batch"], 3, _packed(t[more]), np.frombuffer(r["b"], np.uint16)[more].tobytes(), c[more].tobytes(), b""))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SENT)] if out else [pa.array([], f.type) for f in _SENT], schema=_SENT)


def _active(group: pa.Table, percent: int) -> pa.Table:
    """The sets of one batch that share a token in their prefix, with all tokens that they share."""
    rows = group.to_pylist()
    head = next(r for r in rows if r["kind"] == 0)
    ids, n, local = np.frombuffer(head["a"], np.int64), np.frombuffer(head["b"], np.int64), np.frombuffer(head["d"], np.uint16).astype(np.int64)
    signs = np.frombuffer(head["c"], "V16")
    shared = [r for r in rows if r["kind"] == 3]
    token = np.concatenate([np.zeros(0, U), *(_wide(r["a"]) for r in shared)])
    owner = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(r["b"], np.uint16) for r in shared)]).astype(np.int64)
    count = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(r["c"], np.uint8) for r in shared)])
    order = np.lexsort((token, owner))
    token, owner, count = token[order], owner[order], count[order]
    classes = int(local.max()) + 1
    node = np.full(classes, np.iinfo(np.int64).max)
    np.minimum.at(node, local, ids)
    first = np.zeros(classes, np.int64)
    first[local] = np.arange(len(local))
    size = n[first]
    cut = starts(owner, classes)
    prefix = _prefix(size, percent) - (size - np.diff(cut))
    out = [(signs[first[c]].tobytes(), int(node[c]), int(size[c]), _packed(token[cut[c] : cut[c + 1]]), count[cut[c] : cut[c + 1]].tobytes(), int(prefix[c])) for c in np.flatnonzero((prefix > 0) & (np.diff(cut) > 0) & (size > 0))]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SETS)] if out else [pa.array([], f.type) for f in _SETS], schema=_SETS)


def _keys(token: np.ndarray, count: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Three global orders of shared tokens, as sort keys: by count, by hash alone, by magnitude of the count with another hash."""
    return [(mix(token, 1), count), (mix(token, 2), np.zeros(len(token), np.int64)), (mix(token, 3), np.log2(np.maximum(count, 1)).astype(np.int64))]


def _prefix_tokens(batches: Iterator[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
    """(token, node) of the prefixes under an order."""
    for batch in batches:
        found, node = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for r in batch.to_pylist():
            token, count = _wide(r["tokens"]), np.frombuffer(r["counts"], np.uint8)
            order = np.lexsort(_keys(token, count)[number])[: r["prefix"]]
            found.append(token[order])
            node.append(np.full(len(order), r["node"]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(node))], names=["token", "node"])


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["a"], np.int64)), pa.array(np.frombuffer(r["b"], np.int64)), pa.array([x.tobytes() for x in np.frombuffer(r["c"], "V16")], pa.binary())], names=["id", "n_shingles", "class"])


def _linked(group: pa.Table, percent: int) -> tuple[list[dict], Union]:
    """The sets of a group and what links join: all with all, or, if there are two sides, one with the other; sets of one
    component are joined already."""
    rows = group.to_pylist()
    rows.sort(key=lambda r: (r["n"], r["node"]))
    size = np.array([r["n"] for r in rows])
    second = np.array([r["side"] for r in rows])
    tokens = [_wide(r["tokens"]) for r in rows]
    every, count = np.concatenate(tokens), np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(t) for t in tokens])
    cut = starts(owner, len(rows))
    _, token_id = np.unique(every, return_inverse=True)
    allowed = np.triu(100 * np.minimum.outer(size, size) >= percent * np.maximum.outer(size, size), 1)
    if second.any():
        allowed &= second[:, None] != second[None, :]
    component = np.array([r["component"] for r in rows])
    allowed &= component[:, None] != component[None, :]
    limit = np.array([r["prefix"] for r in rows])
    for key in _keys(every, count):
        order = np.lexsort((*key, owner))
        rank = np.arange(len(order)) - cut[owner[order]]
        chosen = order[rank < limit[owner[order]]]
        by = np.lexsort((owner[chosen], token_id[chosen]))
        t, o = token_id[chosen][by], owner[chosen][by]
        edges = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]])) if len(t) else np.zeros(1, int)
        share = np.zeros_like(allowed)
        for s, e in zip(edges[:-1], edges[1:]):
            if e - s > 1:
                share[np.ix_(o[s:e], o[s:e])] = True
        allowed &= share
    union = Union(len(rows))
    _, head, member = np.unique(component, return_index=True, return_inverse=True)
    for i, j in enumerate(head[member].tolist()):
        union.join(i, j)
    mark = np.zeros(token_id.max() + 1, np.int32) if len(token_id) else np.zeros(1, np.int32)
    for i in np.flatnonzero(allowed.any(axis=1)):
        root = union.find(i)
        others = [j for j in np.flatnonzero(allowed[i]).tolist() if union.find(j) != root]
        if not others:
            continue
        mine = token_id[cut[i] : cut[i + 1]]
        mark[mine] = 1
        spans = [token_id[cut[j] : cut[j + 1]] for j in others]
        same = np.add.reduceat(mark[np.concatenate(spans)], np.cumsum([0, *map(len, spans[:-1])]))
        mark[mine] = 0
        whole = size[i] + size[others] - same
        for j in np.asarray(others)[100 * same >= percent * whole].tolist():
            union.join(i, j)
    return rows, union


def _labels(group: pa.Table, percent: int) -> pa.Table:
    """(node, smallest node of its component in this group)."""
    rows, union = _linked(group, percent)
    least: dict[int, int] = {}
    roots = [union.find(i) for i in range(len(rows))]
    for r, root in zip(rows, roots):
        least[root] = min(r["node"], least.get(root, r["node"]))
    return pa.Table.from_arrays([pa.array([r["node"] for r in rows], pa.int64()), pa.array([least[x] for x in roots], pa.int64())], schema=_LABELS)


def _links(group: pa.Table, percent: int) -> pa.Table:
    """Pairs of components that links of this group join."""
    rows, union = _linked(group, percent)
    pairs = {(r["component"], rows[union.find(i)]["component"]) for i, r in enumerate(rows)}
    pairs = [p for p in pairs if p[0] != p[1]]
    return pa.Table.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=_LINKS)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Classes of texts linked by a Jaccard similarity of at least percent / 100 between their sets of k-word shingles.

    Words are runs of anything but ASCII white space, A-Z folded; a text of fewer than k words has its whole sequence as
    its only shingle. Returns one row per row of docs: id long, n_shingles long (size of the set), component_id long (the
    smallest id reachable by links, its own included). Null, empty and blank texts have an empty set and no link; very long
    texts are tokenised whole, alone; repeated rows count as equal texts; rows whose id is null are not documents and are
    left out; other columns, whatever their names, are ignored; an empty table gives an empty result. percent is an integer from 1 to 100.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    buckets = _buckets(texts)
    sent = texts.mapInArrow(lambda batches: released(_tokenise(batches, k, buckets)), _ddl(_SENT))
    back = written(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_count, _ddl(_SENT)))
    collected(docs.sparkSession)
    rows = back.where("kind = 0").select("a", "b", "c").mapInArrow(_headers, "id long, n_shingles long, class binary")
    active = back.groupBy("batch").applyInArrow(with_percent(_active, percent), _ddl(_SETS))
    sets = written(active.groupBy("class").agg(F.min("node").alias("node"), *(F.max(c).alias(c) for c in ("n", "tokens", "counts", "prefix"))))
    collected(docs.sparkSession)

    placed = _placed(sets, _families(sets))
    collected(docs.sparkSession)
    joined = _components(placed, percent)
    classes = rows.groupBy("class").agg(F.min("id").alias("node"))
    classes = classes.join(joined, "node", "left").select("class", F.coalesce("component", "node").alias("component"))
    # the empty set links with nothing, not even itself
    return rows.join(classes, "class").select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def _buckets(texts: DataFrame) -> int:
    """As many buckets as the input's bytes need, estimated if Spark knows the size of its files; their number changes no result."""
    estimate = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate > 1 << 50:  # unknown
        estimate = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(n_partitions(texts.sparkSession), min(MOST_BUCKETS, estimate // BUCKET_BYTES))


def _split(sets: DataFrame, families: DataFrame, number: int) -> DataFrame:
    """(node, family): components within families over shared prefix tokens of an order."""
    owned = sets.select("tokens", "counts", "prefix", "node").mapInArrow(partial(_prefix_tokens, number=number), "token long, node long").join(families, "node")
    least = owned.groupBy("family", "token").agg(F.min("node").alias("low"), F.count("*").alias("c")).where("c > 1").select("family", "token", "low")
    edges = owned.join(least, ["family", "token"]).where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    return written(connected_components(edges).withColumnRenamed("component", "family"))


def _families(sets: DataFrame) -> DataFrame:
    """(node, family) of sets that share prefix tokens, directly or not; families of more than a block under every order."""
    owned = sets.select("tokens", "counts", "prefix", "node").mapInArrow(partial(_prefix_tokens, number=0), "token long, node long")
    least = owned.groupBy("token").agg(F.min("node").alias("low"), F.count("*").alias("c")).where("c > 1").select("token", "low")
    edges = owned.join(least, "token").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    families = written(connected_components(edges).withColumnRenamed("component", "family"))
    load = sets.select("node", F.octet_length("tokens").alias("bytes")).join(families, "node").groupBy("family").agg(F.count("*").alias("sets"), F.sum("bytes").alias("bytes"))
    wide = written(load.where(f"sets > {BLOCK_SETS} or bytes > {6 * BLOCK_TOKENS}").select("family"))
    if wide.isEmpty():
        return families
    mine = families.join(wide, "family", "left_semi")
    inside = written(sets.join(mine.select("node"), "node", "left_semi"))
    for number in (1, 2):
        mine = _split(inside, mine, number)
    return families.join(wide, "family", "left_anti").select("node", "family").union(mine.select("node", "family"))


def _placed(sets: DataFrame, families: DataFrame) -> DataFrame:
    """sets of families, with family, block and component (itself). Blocks are dealt by set size: running loads are summed
    over the distinct sizes of a family, and sets of one size share its blocks by a hash."""
    sized = sets.select("node", "n", F.octet_length("tokens").alias("bytes")).join(families, "node")
    load = F.greatest(F.count("*") / BLOCK_SETS, F.sum("bytes") / (6.0 * BLOCK_TOKENS))
    running = W.partitionBy("family").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    per = sized.groupBy("family", "n").agg(load.alias("load")).withColumn("upto", F.sum("load").over(running))
    per = per.select("family", "n", F.floor(F.col("upto") - F.col("load")).alias("first"), F.greatest(F.ceil("upto") - F.floor(F.col("upto") - F.col("load")), F.lit(1)).alias("blocks"))
    block = F.col("first") + F.pmod(F.xxhash64("node"), F.col("blocks"))
    where = sized.join(per, ["family", "n"]).select("node", "family", block.alias("block"))
    return written(sets.select("node", "n", "tokens", "counts", "prefix", F.col("node").alias("component")).join(where, "node"))


def _components(placed: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets of families; component is the smallest node that links reach."""
    label = with_percent(_labels, percent)
    inside = written(placed.withColumn("side", F.lit(0)).groupBy("family", "block").applyInArrow(label, _ddl(_LABELS)))
    spans = placed.groupBy("family", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    wide = written(spans.groupBy("family").agg(F.count("*").alias("blocks")).where("blocks > 1"))  # families of several blocks
    if wide.isEmpty():
        return inside
    rest = placed.join(wide.select("family"), "family", "left_semi").drop("component")

    # one set of each component of a family, in lots of a block's size
    heads = rest.join(inside.where("node = component"), "node").withColumn("side", F.lit(0))
    lots = heads.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum(F.octet_length("tokens")) / (6.0 * BLOCK_TOKENS))).alias("lots"))
    dealt = heads.join(lots, "family").withColumn("lot", F.pmod(F.xxhash64("node"), F.col("lots")))
    between = dealt.groupBy("family", "lot").applyInArrow(label, _ddl(_LABELS)).toDF("component", "whole")
    joined = written(inside.join(between, "component", "left").select("node", F.coalesce("whole", "component").alias("component")))

    parted = joined.join(rest.select("node", "family"), "node")
    largest = parted.groupBy("family", "component").agg(F.count("*").alias("c")).groupBy("family").agg(F.max_by("component", F.struct("c", "component")).alias("largest"))
    minor = written(parted.join(largest, "family").where("component <> largest").select("node", "family"))
    if minor.isEmpty():
        return joined
    few = _placed(rest.drop("family", "block").join(minor.select("node"), "node", "left_semi"), minor).drop("component").withColumnRenamed("block", "lot")
    lots = few.groupBy("family", "lot").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    meet = lots.join(spans, "family").where(f"100 * least(high, hi) >= {percent} * greatest(low, lo)").select("family", "lot", "block")
    columns = ["family", "lot", "block", "node", "n", "tokens", "counts", "prefix", "component"]
    every = rest.join(joined, "node").join(meet, ["family", "block"]).select(*columns, F.lit(0).alias("side"))
    others = few.join(joined, "node").join(meet, ["family", "lot"]).select(*columns, F.lit(1).alias("side"))
    links = written(every.union(others).groupBy("family", "lot", "block").applyInArrow(with_percent(_links, percent), _ddl(_LINKS)))
    if links.isEmpty():
        return joined
    last = connected_components(links).toDF("component", "whole")
    return joined.join(last, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
