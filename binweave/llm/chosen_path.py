"""N-gram Jaccard self-join by chosen paths: all links of similarity 0.8 or more between texts' sets of five-word shingles.

Recursion: a set goes to a bucket for each of its tokens that a hash shared by all sets chooses with probability 1/(0.8 * set size); a bucket
of more than LIMIT sets splits again by further chosen tokens, down to DEPTH tokens; smaller ones are compared by brute force. Two sets
of similarity 0.8 choose at least one common token in expectation at every level (just one where one set holds the other), so each run
keeps them together with a known probability or a higher one, and as many runs are made as bring their recall to TARGET. Every comparison is an exact set intersection.

Texts with equal sets are one class, which takes part once. Buckets with the same members count as one. A pair is counted in the least
of the buckets it shares, so that counts need no list of pairs. A bucket that is still large at the last level (one group of near
copies) is dealt out in pairs of blocks, each within a task's memory; no bucket, candidate or partner is capped.

Results carry each row's id; ids may repeat or be null (a null id is never a class's). Null texts and texts without a word have no
tokens, are alike to nothing, and keep their own id as class. A text of fewer than five words is one shingle of all its words. Ties for
a class's id go to the smallest id. Repeated rows are copies. Tokens are 32-bit hashes of
shingles. Extra columns of docs, whatever their names, are not read by join() and all kept by deduplicate(); an empty table gives no rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binweave.llm._common import bound_batches, delete, free_name, row_key, shared_dir, slices, stored, utf8, without
from binweave.llm.words import distinct, mix, shingles, words

#: Similarity, shingle words, recall of a pair just at the similarity, tokens of a path at most, bucket size that is compared outright,
#: and sets, and bytes of tokens, in a block of a bucket that no further token splits.
SIMILARITY, WIDTH, TARGET, DEPTH, LIMIT, BLOCK, BLOCK_BYTES = 0.8, 5, 0.999, 3, 64, 1024, 8 << 20


def runs(similarity: float = SIMILARITY, target: float = TARGET, depth: int = DEPTH, nested: bool = False) -> int:
    """Runs for the target recall: a pair's chance to share a path of depth tokens, as a branching process, is repeated. nested: for
    pairs of which one set holds the other, which share the fewest tokens for their larger set; else for sets of equal size."""
    mean = 1.0 if nested else 2 / (1 + similarity)  # common tokens by the chance 1 / (similarity * larger size)
    stay = 1.0
    for _ in range(depth):
        stay = 1 - math.exp(-mean * stay)
    return math.ceil(math.log(1 - target) / math.log(1 - stay))


def _children(key: np.ndarray, token: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of sets are chosen below a path, and the keys of those paths; arrays of one length."""
    x = mix(token.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ key)
    chosen = np.flatnonzero((x >> np.uint64(11)).astype(np.float64) * (similarity * size) < 2.0**53)
    return chosen, mix(x[chosen] + key[chosen] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


def sets(docs: DataFrame, key: str, text: str, width: int = WIDTH, similarity: float = SIMILARITY, count: int | None = None) -> DataFrame:
    """(row, id, sig, tokens, keys): each row's token set (sorted 32-bit), its 64-bit signature (null if empty), and the keys of its paths of one token."""
    seeds = mix(np.arange(1, (count or runs(similarity, nested=True)) + 1, dtype=np.uint64))
    id_type = docs.schema[key].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", id_type), T.StructField("sig", T.LongType()), T.StructField("tokens", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = utf8(part.column("text"))
                n = len(off) - 1
                code, doc = shingles(words(data, off), width)
                token, _, first = distinct((code >> np.uint64(32)).astype(np.uint32), doc, n)
                size = np.diff(first)
                owner = np.repeat(np.arange(n), size)
                found = [_children(np.full(len(token), s), token, size[owner], similarity) for s in seeds]
                at = np.concatenate([owner[f[0]] for f in found])
                keys, _, place = distinct(np.concatenate([f[1] for f in found]), at, n)
                raw = [token[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                sig = pa.array([np.uint64(xxhash.xxh3_64_intdigest(r)).astype(np.int64) if r else None for r in raw], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), sig, pa.array(raw, pa.binary()), pa.ListArray.from_arrays(pa.array(place, pa.int32()), pa.array(keys.view(np.int64)))], names=schema.names)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def _shared(members: DataFrame, path: str) -> DataFrame:
    """(key, sig, size, n, bytes, same): members (key, sig, size) of buckets of two sets or more, with the bucket's sets, their bytes, and a checksum
    of them."""
    each = members.groupBy("key", "sig").agg(F.min("size").alias("size"))
    sizes = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("sig")).alias("same")).where("n > 1")
    return stored(each.join(sizes, "key"), path)


def _split(big: DataFrame, table: DataFrame, rep: DataFrame, similarity: float) -> DataFrame:
    """(key, sig, size): members of the buckets below those of big (key, sig)."""
    todo = big.groupBy("sig").agg(F.collect_list("key").alias("keys")).join(rep.select("sig", "row"), "sig")
    rows = table.select("row", "tokens").join(todo, "row").select("sig", "tokens", "keys")

    def run(batches):
        for batch in batches:
            out_key, out_sig, out_size = [], [], []
            for sig, raw, keys in zip(batch.column("sig").to_pylist(), batch.column("tokens").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                token = np.frombuffer(raw, np.uint32)
                for k in keys:
                    _, child = _children(np.full(len(token), np.int64(k)).view(np.uint64), token, np.full(len(token), len(token)), similarity)
                    out_key.append(child.view(np.int64))
                    out_sig += [sig] * len(child)
                    out_size += [len(raw)] * len(child)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_key) if out_key else [], pa.int64()), pa.array(out_sig, pa.int64()), pa.array(out_size, pa.int32())], names=["key", "sig", "size"])

    return rows.mapInArrow(run, "key long, sig long, size int")


def _overlaps(tokens: list[np.ndarray], width: int = 1024) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, width tokens at a time; tokens that only one of them has are left out first."""
    n = len(tokens)
    everything = np.concatenate(tokens)
    if not len(everything):
        return np.zeros((n, n), np.float32)
    owner = np.repeat(np.arange(n), [len(t) for t in tokens])
    order = np.argsort(everything, kind="stable")
    everything, owner = everything[order], owner[order]
    new = np.flatnonzero(np.append(True, everything[1:] != everything[:-1]))
    count = np.diff(np.append(new, len(everything)))
    common = np.repeat(count > 1, count)
    column = np.repeat(np.cumsum(count > 1) - 1, count)[common]
    owner = owner[common]
    total = np.zeros((n, n), np.float32)
    if not len(column):
        return total
    for start in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, (start, start + width))
        m = np.zeros((n, int(column[b - 1]) - start + 1), np.float32)
        m[owner[a:b], column[a:b] - start] = 1
        total += m @ m.T
    return total


def compare(key: int, sig: np.ndarray, tokens: list[np.ndarray], block: np.ndarray, across: bool, mine: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a bucket (across: between two blocks only), and those for which it is the least of the pair's buckets."""
    size = np.array([len(t) for t in tokens], np.float64)
    linked = _overlaps(tokens)
    linked = np.concatenate([linked[r].astype(np.float64) * (1 + similarity) >= similarity * (size[r, None] + size[None, :]) - 1e-6 for r in _strips(len(sig))])
    linked &= sig[:, None] != sig[None, :]
    if across:
        linked &= block[:, None] != block[None, :]
    if not linked.any():
        return linked, linked
    return linked, linked & (_overlaps([m[m < key] for m in mine]) == 0)


def _strips(n: int, rows: int = 256) -> list[slice]:
    return [slice(a, a + rows) for a in range(0, n, rows)]


def _components(linked: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """The least signature that each member reaches by links."""
    label = sig.copy()
    while True:
        new = np.concatenate([np.where(linked[r], label[None, :], np.iinfo(np.int64).max).min(1) for r in _strips(len(sig))])
        new = np.minimum(label, new)
        if (new == label).all():
            return label
        label = new


def _bucket_rows(shared: DataFrame, table: DataFrame, rep: DataFrame, folder: str, block: int) -> DataFrame:
    """(key, i, j, block, sig, tokens, mine): members of each bucket, or of each pair of blocks of a large one, grouped and sorted."""
    kept = shared.groupBy("n", "same").agg(F.min("key").alias("key")).select("key")
    mine = shared.join(kept, "key").groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("key", "n", "bytes"))).alias("mine")).join(rep.select("sig", "row"), "sig")
    rows = table.select("row", "tokens").join(stored(mine, f"{folder}/mine"), "row").select("sig", "tokens", F.col("mine.key").alias("mine"), F.explode("mine").alias("b"))
    blocks = F.ceil(F.greatest(F.col("b.n") / F.lit(block), F.col("b.bytes") / F.lit(BLOCK_BYTES))).cast("int")
    own = F.pmod(F.xxhash64("sig", F.col("b.key")), blocks).cast("int")
    rows = rows.select(F.col("b.key").alias("key"), "sig", "tokens", "mine", blocks.alias("blocks"), own.alias("block"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sig", "tokens", "mine")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Runs of rows with the same key, i and j."""
    held, now = [], None
    for batch in batches:
        key, i, j = (np.asarray(batch.column(c)) for c in ("key", "i", "j"))
        if not len(key):
            continue
        new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(key)], strict=True):
            this = (int(key[a]), int(i[a]), int(j[a]))
            if now is not None and this != now:
                yield now, held
                held = []
            now = this
            part = batch.slice(a, b - a)
            held += list(zip(part.column("block").to_pylist(), part.column("sig").to_pylist(), part.column("tokens").to_pylist(), part.column("mine").to_pylist(), strict=True))
    if held:
        yield now, held


def _compared(rows: DataFrame, similarity: float, pairs: bool) -> DataFrame:
    schema = "a long, b long, similarity double" if pairs else "sig long, root long, links long"

    def run(batches):
        out: list[list] = [[], [], []]

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64() if pairs else pa.int64()), strict=True)], names=["a", "b", "similarity"] if pairs else ["sig", "root", "links"])
            for c in out:
                c.clear()
            return made

        for (key, i, j), held in _groups(batches):
            if len(held) < 2:
                continue
            sig = np.array([h[1] for h in held], np.int64)
            tokens = [np.frombuffer(h[2], np.uint32) for h in held]
            linked, first = compare(key, sig, tokens, np.array([h[0] for h in held]), i != j, [np.array(h[3], np.int64) for h in held], similarity)
            if pairs:
                a, b = np.nonzero(first & (sig[:, None] < sig[None, :]))
                if len(a):
                    both = _overlaps(tokens)[a, b].astype(np.float64)
                    size = np.array([len(t) for t in tokens], np.float64)
                    for c, v in zip(out, (sig[a], sig[b], both / (size[a] + size[b] - both)), strict=True):
                        c.append(v)
            elif linked.any():
                own = np.flatnonzero(linked.any(1))
                for c, v in zip(out, (sig[own], _components(linked, sig)[own], first.sum(1)[own]), strict=True):
                    c.append(v.astype(np.int64))
            if sum(map(len, out[0])) > 50_000:
                yield batch()
        yield batch()

    return rows.mapInArrow(run, schema)


def components(stars: DataFrame, folder: str) -> DataFrame:
    """(sig, label): the least sig that each sig of stars (sig, root) reaches. Labels go to the roots and back, then to the label's own
    label, round by round until none changes; each round is stored."""
    edges = stored(stars.select("sig", "root").union(stars.select(F.col("root").alias("sig"), "root")).distinct(), f"{folder}/stars")
    label = stored(edges.groupBy("sig").agg(F.min("root").alias("label")), f"{folder}/label0")
    for k in range(1, 200):
        root = edges.join(label, "sig").groupBy("root").agg(F.min("label").alias("low"))
        near = edges.join(root, "root").groupBy("sig").agg(F.min("low").alias("near"))
        beyond = label.select(F.col("sig").alias("near"), F.col("label").alias("beyond"))
        step = near.join(beyond, "near", "left").select("sig", F.least("near", F.coalesce("beyond", "near")).alias("label"))
        new = stored(step, f"{folder}/label{k}")
        changed = new.select("sig", F.col("label").alias("new")).join(label, "sig").where("new <> label").isEmpty()
        label = new
        if changed:
            return label
    raise RuntimeError("labels still change")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = WIDTH, folder: str | None = None, pairs: bool = False, limit: int = LIMIT, block: int = BLOCK, depth: int = DEPTH, target: float = TARGET) -> DataFrame:
    """One row for each row of docs: its id, class_id (the least id of all that links connect it with), copy_id (the least id with the
    same set), n_copies (rows with the same set), n_links (classes of other sets linked with its own). With pairs: the links themselves
    between classes as (a, b, similarity), by copy_id."""
    spark = docs.sparkSession
    bound_batches(spark)
    folder = folder or shared_dir(spark, "chosen-path")
    work = f"{folder}/work"
    table = stored(sets(docs, key, text, width, similarity, runs(similarity, target, depth, nested=True)), f"{work}/sets")
    rep = stored(table.where("sig is not null").groupBy("sig").agg(F.min("row").alias("row"), F.min("id").alias("copy_id"), F.count(F.lit(1)).alias("n_copies")), f"{work}/classes")
    level = _shared(table.where("sig is not null").select(F.explode("keys").alias("key"), "sig", F.octet_length("tokens").alias("size")), f"{work}/level1")
    found = level
    for d in range(2, depth + 1):
        big = level.where(F.col("n") > limit)
        if big.isEmpty():
            break
        level = _shared(_split(big.select("key", "sig"), table, rep, similarity), f"{work}/level{d}")
        found = found.where(F.col("n") <= limit).unionByName(level)
    rows = _bucket_rows(found, table, rep, work, block)
    if pairs:
        out = _compared(rows, similarity, True)
        a, b = (rep.select(F.col("sig").alias(s), F.col("copy_id").alias(f"{s}_id")) for s in ("a", "b"))
        return out.join(a, "a").join(b, "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "similarity")
    links = stored(_compared(rows, similarity, False), f"{work}/links")
    label = components(links, work)
    ids = rep.select("sig", "copy_id", "n_copies")
    group = label.join(ids, "sig").groupBy("label").agg(F.min("copy_id").alias("class_id"))
    linked = label.join(group, "label").join(links.groupBy("sig").agg(F.sum("links").alias("n_links")), "sig").select("sig", "class_id", "n_links")
    known = stored(ids.join(linked, "sig", "left").where("n_copies > 1 or class_id is not null"), f"{folder}/known")
    narrow = stored(table.select("id", "sig"), f"{folder}/narrow")
    delete(spark, work)
    out = narrow.join(known, "sig", "left")
    copy = F.coalesce("copy_id", "id")
    return out.select(F.col("id").alias(key), F.coalesce("class_id", copy).alias("class_id"), copy.alias("copy_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """docs with one row of each class: that of the least id (a null id is the least). Of rows with the same id and text one stays, that
    with the least hash of all its columns."""
    folder = folder or shared_dir(docs.sparkSession, "deduplicate")
    keyed = docs.select(row_key(key, text).alias("key"), F.col(f"`{text}`").alias("text"))
    found = stored(join(keyed, "key", "text", folder=f"{folder}/join").select("key", "class_id"), f"{folder}/classes")
    kept = without(docs, stored(found.where("key <> class_id").select("key").distinct(), f"{folder}/dropped"), key, text)
    again = stored(found.where("key = class_id").groupBy("key").count().where("count > 1").select("key"), f"{folder}/again")
    if again.isEmpty():
        return kept
    name, order = free_name(kept, "_again"), free_name(kept, "_order")
    once = kept.withColumn(name, row_key(key, text)).withColumn(order, F.xxhash64(*[f"`{c}`" for c in docs.columns]))
    repeated = once.join(again.select(F.col("key").alias(name)), name, "left_semi").groupBy(name).agg(F.min_by(F.struct(*[f"`{c}`" for c in docs.columns]), order).alias("row")).select("row.*")
    return without(kept, again, key, text).unionByName(repeated)


_CAPITALS = "".join(map(chr, [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
#: DuckDB SQL for join() of `documents`, by comparing all sets that share a shingle: for small tables.
ORACLE_SQL = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '(?:[a-z0-9]|[^\\x00-\\x7F])+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
       ELSE list_sort(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS t FROM w),
k AS MATERIALIZED (SELECT row_number() OVER () AS g, t, min(doc_id) AS copy_id, count(*) AS n FROM s WHERE len(t) > 0 GROUP BY t),
u AS MATERIALIZED (SELECT g, unnest(t) AS x, len(t) AS n FROM k),
l AS MATERIALIZED (SELECT a.g AS a, b.g AS b FROM u a JOIN u b ON a.x = b.x AND a.g <> b.g GROUP BY a.g, b.g HAVING 9 * count(*) >= 4 * (min(a.n) + min(b.n))),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS g, min(k.copy_id) AS class_id FROM r JOIN k ON k.g = r.b GROUP BY r.a),
d AS (SELECT a AS g, count(*) AS n_links FROM l GROUP BY a)
SELECT s.doc_id, coalesce(least(c.class_id, k.copy_id), k.copy_id, s.doc_id) AS class_id, coalesce(k.copy_id, s.doc_id) AS copy_id, CAST(coalesce(k.n, 1) AS BIGINT) AS n_copies, CAST(coalesce(d.n_links, 0) AS BIGINT) AS n_links
FROM s LEFT JOIN k ON s.t = k.t LEFT JOIN c ON c.g = k.g LEFT JOIN d ON d.g = k.g
"""
