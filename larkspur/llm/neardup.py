"""MinHash near-duplicates with HyperMinHash registers.

Every shingle hash falls into one of 128 buckets by its leading bits; a bucket
keeps its smallest remaining value as a 16-bit register of the count of leading
zeros (6 bits) and the mantissa bits after the leading one (10 bits).  Bands of
four registers propose pairs, the share of equal registers corrected for chance
collisions estimates their Jaccard similarity, and full shingle sets confirm.

The plan, none of whose steps gathers an unbounded group in one task:

1. one pass over the texts gives each document a set key and its registers;
   documents with equal sets form a class (a partially aggregated ``min``), and
   only the smallest document of a class goes on;
2. classes meet in band buckets.  Each class is first verified against one
   partner only, the smallest member of the buckets they share most often.  As
   this partner is always smaller, confirmed links are a forest, whose roots
   pointer jumping finds;
3. what is still apart in some bucket is compared there, a pair only in the first
   band that it shares.  Buckets of up to 32 classes send registers alone and
   return the pairs whose estimate allows a link, to be verified.  In larger ones
   members are dealt into blocks, those outside the bucket's largest component
   meet every block once, and again registers alone are sent.  Two blocks return
   their promising pairs if these are fewer than half of their members, else only
   word that they are dense: then the members' sets are sent, each once, and a
   union-find keeps the confirmed links to a spanning forest.  So no more sets are
   read than there are promising pairs, and a group of n near copies yields O(n)
   rows, never n^2;
4. large-star/small-star rounds join the components.

Without words or text a document has an empty set and is linked with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.bytewise import SPACED_WORDS, Words, give_back, shingle_sets, slices, text_buffers
from larkspur.llm.frames import cut, shuffle_width, small_batches

BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
BAND_ROWS = 4
BANDS = BUCKETS // BAND_ROWS
#: Members of a bucket that are compared in one block at most.
BLOCK = 512
#: Classes in a bucket up to which pairs are returned one by one (at most 15.5 a row).
SMALL = 32
#: Standard deviations of the estimate that a pair may fall short before its sets are left unread.
SLACK = 6.0
#: Sets smaller than this fill too few buckets for an estimate; they are always compared in full.
LEAST_FOR_ESTIMATE = 64
_EMPTY = np.uint16(0xFFFF)


def _probe_order() -> np.ndarray:
    rng = np.random.default_rng(20240501)
    return np.stack([rng.permutation(BUCKETS) for _ in range(BUCKETS)])


_PROBES = _probe_order()


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 128 registers per set of sorted distinct hashes; empty sets give empty registers.

    An empty bucket takes the register of the first filled bucket in its own
    fixed random order, so equal registers keep the probability of the Jaccard
    similarity for small sets too.
    """
    out = np.full((len(sets), BUCKETS), _EMPTY, np.uint16)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    bucket = (every >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    cell = owner * BUCKETS + bucket
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])  # sorted sets: the least of each bucket
    width = 64 - BUCKET_BITS
    rest = every[first] & np.uint64((1 << width) - 1)
    length = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    lead = (rest << (64 - length).astype(np.uint64) % np.uint64(64)) << np.uint64(1)
    code = ((width - length) << MANTISSA_BITS) | (lead >> np.uint64(64 - MANTISSA_BITS)).astype(np.int64)
    out.reshape(-1)[cell[first]] = code.astype(np.uint16)
    filled = out != _EMPTY
    open_rows = np.flatnonzero(filled.any(axis=1) & ~filled.all(axis=1))
    for step in range(BUCKETS):
        if not len(open_rows):
            break
        source = _PROBES[:, step]
        part, known = out[open_rows], filled[open_rows]
        take = (part == _EMPTY) & known[:, source]
        part = np.where(take, part[:, source] if step == 0 else out[open_rows][:, source], part)
        out[open_rows] = part
        open_rows = open_rows[(part == _EMPTY).any(axis=1)]
    return out


def estimate(equal_share: np.ndarray | float) -> np.ndarray | float:
    """Jaccard similarity from the share of equal registers, without chance collisions.

    Two unrelated registers agree when their leading-zero counts and mantissas
    agree: the sum over counts of 4^-count, divided by the mantissa's values.
    """
    chance = (1.0 / 3.0) / (1 << MANTISSA_BITS)
    return (equal_share - chance) / (1.0 - chance)


def _promising(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose sizes allow the similarity and whose estimate is not far below it."""
    t = percent / 100.0
    few, many = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    filled = np.maximum(1.0, BUCKETS * -np.expm1(-few / BUCKETS))
    least = t - SLACK * np.sqrt(t * (1 - t) / filled)
    return (100 * few >= percent * many) & ((few < LEAST_FOR_ESTIMATE) | (estimate(equal / BUCKETS) >= least))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, shingle: int, with_sets: bool = False) -> DataFrame:
    """doc_id, n_shingles, set_key, registers (both null for empty sets), and the sets if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                sets = shingle_sets(Words(raw, offsets[a : b + 1], SPACED_WORDS), shingle)
                regs = registers(sets)
                out = {
                    "doc_id": batch.column(0).slice(a, b - a),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "set_key": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    "registers": pa.array([r.tobytes() if len(s) else None for s, r in zip(sets, regs)], pa.binary()),
                }
                if with_sets:
                    out["shingles"] = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_pydict(out)
        give_back()

    schema = "doc_id long, n_shingles long, set_key binary, registers binary" + ", shingles binary" * with_sets
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _verify(pairs: DataFrame, percent: int) -> DataFrame:
    """Of rows (doc_id, partner to name, and both sides' registers and sets) the confirmed links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            keep = []
            for i, (ra, rb, sa, sb) in enumerate(zip(d["registers"], d["p_registers"], d["shingles"], d["p_shingles"])):
                equal = np.count_nonzero(np.frombuffer(ra, np.uint16) == np.frombuffer(rb, np.uint16))
                a, b = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                if _promising(equal, len(a), len(b), percent) and _similar(a, b, percent):
                    keep.append(i)
            yield pa.RecordBatch.from_pydict({k: pa.array([d[k][i] for i in keep], pa.int64()) for k in ("doc_id", "partner")})

    return pairs.mapInArrow(run, "doc_id long, partner long")


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = x = self.up.get(self.up[x], self.up[x])
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _unseen(rows: list[tuple], i: int, comps: np.ndarray, sides: np.ndarray, regs: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Later rows of other components that share no earlier band with row i and may be similar to it."""
    rest, band = slice(i + 1, None), rows[0][0]
    at = np.flatnonzero((comps[rest] != comps[i]) & ((sides[rest] != sides[i]) | (sides[i] == 2))) + i + 1
    if not len(at):
        return at
    same = regs[at] == regs[i]
    if band:
        earlier = same[:, : band * BAND_ROWS].reshape(len(at), band, BAND_ROWS).all(axis=2).any(axis=1)
        at, same = at[~earlier], same[~earlier]
    return at[_promising(same.sum(axis=1), sizes[at], np.full(len(at), sizes[i]), percent)]


def _links(rows: list[tuple], percent: int, verify: bool, most: float = np.inf) -> list[tuple] | None:
    """Of the rows (band, side, comp, doc_id, n_shingles, registers, set) of one or two blocks:

    links between components as a spanning forest, or without ``verify`` all
    pairs to verify with their components, None if these are more than ``most``.
    Sides 0 and 1 tell two blocks apart; within 2 all pairs count.
    """
    comps, sides, sizes = (np.array([r[k] for r in rows]) for k in (2, 1, 4))
    regs = np.stack([np.frombuffer(r[5], np.uint16) for r in rows])
    forest, out = _Forest(), []
    for i in range(len(rows) - 1):
        for j in _unseen(rows, i, comps, sides, regs, sizes, percent).tolist():
            a, b = int(comps[i]), int(comps[j])
            if not verify:
                out.append((rows[i][3], rows[j][3], a, b))
                if len(out) > most:
                    return None
            elif forest.find(a) != forest.find(b) and _similar(np.frombuffer(rows[i][6], np.uint64), np.frombuffer(rows[j][6], np.uint64), percent):
                forest.join(a, b)
                out.append((a, b))
    return out


_PAIR = ["left", "right", "doc_id", "partner", "bucket", "first", "second", "band"]


def _compare_blocks(members: DataFrame, percent: int, verify: bool, dense: bool = False) -> DataFrame:
    """members come sorted by (bucket, first, second, band); a group has at most two blocks.

    With ``verify`` confirmed links (doc_id, partner); else pairs (left, right and
    their components) and, if ``dense`` is allowed, a row with the block's keys
    alone where there are more pairs than half of the members.
    """
    names = ["doc_id", "partner"] if verify else _PAIR
    keys = ("bucket", "first", "second", "band", "side", "comp", "doc_id", "n_shingles", "registers") + ("shingles",) * verify

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def found_in() -> list[tuple]:
            if len(rows) < 2:
                return []
            links = _links(rows, percent, verify, len(rows) / 2 if dense else np.inf)
            if verify:
                return links
            return [(None,) * 4 + key] if links is None else [x + (None,) * 4 for x in links]

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names)

        for batch in batches:
            d = batch.to_pydict()
            found: list[tuple] = []
            for row in zip(*[d[k] for k in keys]):
                if row[:4] != key:
                    found += found_in()
                    key, rows = row[:4], []
                rows.append(row[3:])
            if found:
                yield out(found)
        if found := found_in():
            yield out(found)
        give_back()

    return members.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def forest_roots(parents: DataFrame) -> DataFrame:
    """(doc_id, root) from (doc_id, partner) with one smaller partner each, by pointer jumping."""
    at = cut(parents.select("doc_id", F.col("partner").alias("root")))
    while True:
        up = at.select(F.col("doc_id").alias("root"), F.col("root").alias("above"))
        nxt = cut(at.join(up, "root", "left").select("doc_id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        at = nxt.select("doc_id", "root")
        if nxt.filter("moved").isEmpty():
            return at


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, root): the smallest id that each id of an edge (doc_id, partner) can reach.

    Alternating large-star and small-star rounds; ids without edges are not returned.
    Each round aggregates and joins the edges by id, and is cut in the shared folder.
    """

    def mins(sym: DataFrame) -> DataFrame:
        return sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = cut(edges.select(F.greatest("doc_id", "partner").alias("u"), F.least("doc_id", "partner").alias("v")).filter("u <> v").distinct())
    before = digest(e)
    if not before[0]:
        return e.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))
    while True:
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = sym.join(mins(sym), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        e = cut(e)
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        e = cut(e)
        after = digest(e)
        if after == before:
            return e.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))
        before = after


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text, ...).

    Documents with ``100 * |A & B| >= percent * |A | B|`` over distinct word
    shingles are linked; component_id is the smallest reachable doc_id.  Null and
    empty texts have no shingles and stand alone; rows that repeat a doc_id are
    returned as often as they come; a null doc_id keeps a null component and is
    not kept.  Further columns of ``docs`` are ignored.  An empty table gives an
    empty result.
    """
    width = shuffle_width(docs.sparkSession)
    signed = cut(signatures(docs, shingle))
    classes = signed.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "registers")).alias("least"))
    classes = cut(classes.select("set_key", "least.*"))

    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("registers"), b * (2 * BAND_ROWS) + 1, 2 * BAND_ROWS))))
    bands = classes.select("doc_id", band.alias("band", "bucket"))
    shared = bands.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("pivot")).filter("members > 1")
    joint = cut(bands.join(shared.hint("merge"), ["band", "bucket"]))

    tried = joint.filter("pivot < doc_id").groupBy("doc_id", "pivot").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("pivot")).alias("p"))).alias("best")).select("doc_id", (-F.col("best.p")).alias("partner"))
    tried = cut(tried)
    wanted = joint.select("doc_id").distinct()
    needed = docs.select(F.col("doc_id").cast("long"), "text").join(wanted.hint("merge"), "doc_id", "left_semi")
    full = cut(signatures(needed, shingle, with_sets=True).select("doc_id", "n_shingles", "set_key", "registers", "shingles").join(classes.select("set_key", "doc_id"), ["set_key", "doc_id"], "left_semi").dropDuplicates(["doc_id"]).drop("set_key"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Links (doc_id, partner) of those pairs (left, right, doc_id, partner) whose left and right are similar."""
        one = full.select(F.col("doc_id").alias("left"), "registers", "shingles")
        other = full.select(F.col("doc_id").alias("right"), F.col("registers").alias("p_registers"), F.col("shingles").alias("p_shingles"))
        return _verify(pairs.join(one, "left").join(other, "right").select("doc_id", "partner", "registers", "p_registers", "shingles", "p_shingles"), percent)

    roots = forest_roots(verified(tried.select(F.col("doc_id").alias("left"), F.col("partner").alias("right"), "doc_id", "partner")))

    # What is still apart in a bucket; a bucket of two that the first round has compared is done.
    placed = joint.join(roots, "doc_id", "left").join(tried.withColumnRenamed("partner", "tried"), "doc_id", "left")
    placed = placed.select("band", "bucket", "members", "doc_id", F.coalesce("root", "doc_id").alias("comp"), ((F.col("members") == 2) & (F.col("tried") == F.col("pivot"))).alias("done"))
    placed = cut(placed)
    sizes = placed.groupBy("band", "bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("done", F.lit(False))).alias("done"))
    sizes = sizes.groupBy("band", "bucket").agg(F.sum("n").alias("members"), F.max(F.struct("n", "comp")).alias("most"), F.max("done").alias("done"), F.count(F.lit(1)).alias("comps"))
    sizes = sizes.filter("comps > 1 and not done").select("band", "bucket", (F.col("members") <= SMALL).alias("small"), F.col("most.comp").alias("major"), F.ceil(F.col("most.n") / BLOCK).cast("int").alias("major_blocks"), F.ceil((F.col("members") - F.col("most.n")) / BLOCK).cast("int").alias("minor_blocks"))
    apart = cut(placed.select("band", "bucket", "doc_id", "comp").join(sizes.hint("merge"), ["band", "bucket"]))

    def sorted_by_block(rows: DataFrame) -> DataFrame:
        return rows.repartition(width, "bucket", "band", "first", "second").sortWithinPartitions("bucket", "first", "second", "band")

    few = apart.filter("small").select("band", "bucket", "doc_id", "comp", F.lit(0).alias("first"), F.lit(0).alias("second"), F.lit(2).alias("side"))
    few = sorted_by_block(few.join(classes.select("doc_id", "n_shingles", "registers"), "doc_id"))
    small_links = verified(cut(_compare_blocks(few, percent, verify=False)))

    apart = apart.filter("not small")
    minor = F.col("comp") != F.col("major")
    own = F.pmod(F.xxhash64("doc_id"), F.when(minor, F.col("minor_blocks")).otherwise(F.col("major_blocks"))).cast("int")
    apart = apart.select("band", "bucket", "doc_id", "comp", minor.alias("minor"), own.alias("own"), "minor_blocks", "major_blocks")

    def task(first_block, second_block, side):
        return F.struct(first_block.cast("int").alias("first"), second_block.cast("int").alias("second"), side.cast("int").alias("side"))

    mine = F.col("own")
    with_minor = F.transform(F.sequence(F.lit(0), F.col("minor_blocks") - 1), lambda i: task(F.least(i, mine), F.greatest(i, mine), F.when(i == mine, 2).when(i < mine, 1).otherwise(0)))
    with_major = F.transform(F.sequence(F.lit(0), F.col("major_blocks") - 1), lambda i: task(mine, -1 - i, F.lit(0)))
    from_major = F.transform(F.sequence(F.lit(0), F.col("minor_blocks") - 1), lambda i: task(i, -1 - mine, F.lit(1)))
    dealt = apart.select("band", "bucket", "doc_id", "comp", F.explode(F.when(F.col("minor"), F.concat(with_minor, with_major)).otherwise(from_major)).alias("t")).select("band", "bucket", "doc_id", "comp", "t.*")
    dealt = cut(dealt)
    told = cut(_compare_blocks(sorted_by_block(dealt.join(classes.select("doc_id", "n_shingles", "registers"), "doc_id")), percent, verify=False, dense=True))
    dense = told.filter("left is null").select("bucket", "first", "second", "band")
    crowded = dealt.join(dense, ["bucket", "first", "second", "band"], "left_semi")
    large_links = verified(told.filter("left is not null")).union(_compare_blocks(sorted_by_block(crowded.join(full, "doc_id")), percent, verify=True))

    merged = components(small_links.union(large_links)).withColumnRenamed("doc_id", "comp").withColumnRenamed("root", "least")
    rooted = roots.select("doc_id", F.col("root").alias("comp"))
    reach = classes.select("set_key", "doc_id").join(rooted, "doc_id", "left").select("set_key", F.coalesce("comp", "doc_id").alias("comp"))
    reach = reach.join(merged, "comp", "left").select("set_key", F.coalesce("least", "comp").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(reach.hint("merge"), "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def near_duplicates_sql(shingle: int, percent: int) -> str:
    """DuckDB SQL for ``near_duplicates`` of the table documents, by all pairs that share a shingle."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {shingle} + 2), lambda i: array_to_string(w[i:i + {shingle - 1}], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= {percent} * (na + nb - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS near FROM sets UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.near),
parts AS (SELECT doc_id, min(near) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, coalesce(s.doc_id = component_id, false) AS kept FROM sets s LEFT JOIN parts p ON p.doc_id = s.doc_id
"""
