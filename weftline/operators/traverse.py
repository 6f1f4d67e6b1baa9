"""Graph traversal: ranked neighbours for many requests at once, reachability, label propagation.

Each level is one join of the frontier with the edges in both directions; rises and fresh nodes
are written between levels. First-in-first-out order is kept by a number (rank of the front node, then of the edge);
ranks come from range sorts, so no task sees all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..staging import numbered, released, staged

DECAY = 0.7


#: A place in the queue is a number: the front node's rank, one bit for the edge's direction, then the edge's rank.
_EDGE_BITS = 32


def incident(nodes: DataFrame, edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """node, other, file (of other), weight, code, turn of both directions of edges: nodes (node_id, file_path, id, file) by their
    numbers, ``code`` for direction and kind (twice its place in ``kinds``, a row, plus one for incoming edges), ``turn`` in the
    order in which a node's edges are taken."""
    end = lambda name: nodes.select(F.col("node_id").alias(f"{name}_id"), F.col("id").alias(name), F.col("file").alias(f"{name}_file"))
    known = edges.join(end("source"), "source_id").join(end("target"), "target_id").join(F.broadcast(kinds), F.lit(True))  # kinds: one row
    code = (F.array_position("kinds", F.col("kind")) - 1).cast("int") * 2
    known = staged(known.select("source", "target", "source_file", "target_file", code.alias("code"), "weight", "edge_ord"), "known-edges")  # a range sort reads its input twice
    rows, known = known, numbered(known, "turn", "edge_ord", "source", "target", "code")
    released(rows)
    out = known.select(F.col("source").alias("node"), F.col("target").alias("other"), F.col("target_file").alias("file"), "weight", "code", "turn")
    back = known.select(F.col("target").alias("node"), F.col("source").alias("other"), F.col("source_file").alias("file"), "weight", (F.col("code") + 1).alias("code"), F.col("turn") + F.lit(1 << _EDGE_BITS))
    return out.union(back)


#: Requests go through the graph in blocks of this many; one has a slot in its block.
_BLOCK = 64
_MESSAGES = "blk int, file long, kind int, node long, code int, turn long, weight double, slots array<tinyint>, ats array<long>, scores array<double>"
_LEVEL = "blk int, file long, rises array<struct<slot: tinyint, key: long, score: double, code: int>>, fresh array<struct<node: long, slot: tinyint, key: long, score: double>>"
_BEST, _SEEN, _SENT = 0, 1, 2  # kinds of rows


class _Group(NamedTuple):
    """A file at hand whose rows go on in the next batch: its best scores before the level by slot, visited (node, slot), rises and
    fresh nodes so far. Neither grows with the rows: one list has a rise a slot and score at most, the other a row a slot and node."""

    at: tuple
    best: np.ndarray
    seen: tuple
    rises: tuple
    fresh: tuple
    sent: bool


def _fold_level(decay: float, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Folds rows of ``_MESSAGES``, those of a file and block together and what is known first, into rows of ``_LEVEL``.

    Known are best scores (``_BEST``) and visited nodes (``_SEEN``, in ``ats``). Other rows are edges with the front node's
    slots, places and scores. Rises are candidates above the best score and above all candidates before them; a node that a slot
    has not visited is fresh, with the score of its first candidate (none are told at the last level).
    """
    arrow = to_arrow_schema(StructType.fromDDL(_LEVEL))
    flat = lambda c: (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).flatten().to_numpy(zero_copy_only=False)

    def told(ats: list[tuple], sent: np.ndarray, rises: tuple, fresh: tuple) -> pa.RecordBatch:
        """A row for each group that candidates came to; rises and fresh nodes (group, ...) are in the order of groups."""
        keep = np.flatnonzero(sent)

        def lists(kind: pa.DataType, values: tuple) -> pa.Array:
            ends = np.concatenate([[0], np.cumsum(np.bincount(values[0], minlength=len(sent)))])
            offsets = pa.array(np.concatenate([ends[:1], ends[1:][keep]]).astype(np.int32))  # groups left out have none
            fields = list(kind.value_type)
            return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(v).cast(f.type) for f, v in zip(fields, values[1:], strict=True)], fields=fields), type=kind)

        blk, file = (pa.array([ats[i][k] for i in keep], arrow.field(k).type) for k in (0, 1))
        return pa.RecordBatch.from_arrays([blk, file, lists(arrow.field(2).type, rises), lists(arrow.field(3).type, fresh)], schema=arrow)

    def firsts(*by: np.ndarray) -> np.ndarray:
        """Whether a row differs from the one before it."""
        return np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in by])])[: len(by[0])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Group | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            blk, file, kind, node, code, turn, weight = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            slots, ats, scores = flat(batch.column(7)).astype(np.int64), flat(batch.column(8)), flat(batch.column(9))
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(7).offsets.to_numpy()))
            new = firsts(blk, file)
            group = np.cumsum(new) - 1
            ids = list(zip(blk[new].tolist(), file[new].tolist(), strict=True))
            if held is not None and held.at != ids[0]:
                if held.sent:
                    yield told([held.at], np.array([True]), held.rises, held.fresh)
                held = None
            best, of = np.full((len(ids), _BLOCK), -1.0), kind[row]
            sent = np.bincount(group[kind == _SENT], minlength=len(ids)) > 0
            if held is not None:
                best[0], sent[0] = held.best, sent[0] or held.sent
            known = of == _BEST
            np.maximum.at(best, (group[row[known]], slots[known]), scores[known])
            known = of == _SEEN
            seen = group[row[known]], ats[known], slots[known]
            if held is not None:
                seen = tuple(map(np.concatenate, zip(held.seen, seen, strict=True)))
            cand = of == _SENT
            row, slots = row[cand], slots[cand]
            score, key, where = scores[cand] * decay * weight[row], (ats[cand] << (_EDGE_BITS + 1)) + turn[row], group[row]

            up = score > best[where, slots]
            rises = where[up], slots[up], key[up], score[up], code[row[up]].astype(np.int64)
            if held is not None:
                rises = tuple(map(np.concatenate, zip(held.rises, rises, strict=True)))
            order = np.lexsort((rises[2], rises[0] * _BLOCK + rises[1]))
            rises = tuple(x[order] for x in rises)
            values, rank = np.unique(rises[3], return_inverse=True)
            high = np.cumsum(firsts(rises[0], rises[1])) * max(len(values), 1) + rank
            above = firsts(np.maximum.accumulate(high)) if len(high) else np.zeros(0, bool)
            rises = tuple(x[above] for x in rises)

            fresh = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.float64))
            if not last:
                pairs, pair = np.unique((group[kind == _SENT] << 40) | node[kind == _SENT], return_inverse=True)
                of_row = np.zeros(batch.num_rows, np.int64)
                of_row[kind == _SENT] = pair
                been, told_of = np.zeros((len(pairs), _BLOCK), bool), (seen[0] << 40) | seen[1]
                at = np.searchsorted(pairs, told_of)
                hit = at < len(pairs)
                hit[hit] = pairs[at[hit]] == told_of[hit]
                been[at[hit], seen[2][hit]] = True
                open_ = ~been[of_row[row], slots]
                fresh = where[open_], node[row[open_]], slots[open_], key[open_], score[open_]
                if held is not None:
                    fresh = tuple(map(np.concatenate, zip(held.fresh, fresh, strict=True)))
                order = np.lexsort((fresh[3], fresh[1] * _BLOCK + fresh[2], fresh[0]))
                fresh = tuple(x[order] for x in fresh)
                one = firsts(*fresh[:3])
                fresh = tuple(x[one] for x in fresh)

            end = len(ids) - 1  # may go on in the next batch
            if end:
                yield told(ids[:end], sent[:end], tuple(x[rises[0] < end] for x in rises), tuple(x[fresh[0] < end] for x in fresh))
            first = lambda rows: (np.zeros(int((rows[0] == end).sum()), np.int64), *(x[rows[0] == end] for x in rows[1:]))
            held = _Group(ids[end], best[end], first(seen), first(rises), first(fresh), bool(sent[end]))
        if held is not None and held.sent:
            yield told([held.at], np.array([True]), held.rises, held.fresh)

    return run


def ranked_neighbors(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int = 4, include_dynamic: bool = True, decay: float = DECAY) -> DataFrame:
    """request_id, path, score, depth, reasons for seeds (request_id, path).

    A file's score is raised whenever a strictly better one turns up; each rise adds a reason. Nodes, files and places in
    the queue are numbers, and requests go together: an edge is sent once a level and block, with the places and scores of
    the requests that have its node in front, to the task of its other end's file, which knows the file's scores and visited nodes.
    Only rises and fresh nodes are written. Ranks of front nodes stay below 2^30 and those of edges below 2^32.
    """
    first = nodes = numbered(nodes.select("node_id", "file_path").distinct(), "id", "file_path", "node_id")
    files = nodes.groupBy(F.col("file_path").alias("path")).agg(F.min("id").alias("file"))
    files = staged(files, "files-by-number")
    nodes = staged(nodes.join(files.select(F.col("path").alias("file_path"), "file"), "file_path"), "nodes-by-number")
    released(first)
    asked = numbered(seeds.select("request_id").distinct(), "n", "request_id")
    asked = staged(asked.select("request_id", F.floor(F.col("n") / _BLOCK).cast("int").alias("blk"), (F.col("n") % _BLOCK).cast("tinyint").alias("slot")), "asked")
    seeds = staged(seeds.select("request_id", "path").distinct().join(files, "path").join(asked, "request_id"), "seeds")
    edges = edges if include_dynamic else edges.where("kind <> 'dynamic_import'")
    kinds = edges.agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    both = incident(nodes, edges, kinds)
    inc = staged(both, "incident")  # every level reads it
    released(both)
    front = seeds.withColumn("node_id", F.concat("path", F.lit("::__module__"))).join(nodes.select("node_id", F.col("id").alias("node")), "node_id")
    front = staged(numbered(front.select("blk", "slot", "file", "node", F.lit(1.0).alias("score"), F.xxhash64("path").alias("key")), "at", "key", "node"), "front-0")
    rises = [seeds.select("blk", "slot", "file", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("key"), F.lit(1.0).alias("score"), F.lit(-1).alias("code"))]

    def known(rows: DataFrame, kind: int, slots, ats, scores) -> DataFrame:
        row = {"kind": F.lit(kind), "node": F.lit(0), "code": F.lit(0), "turn": F.lit(0), "weight": F.lit(0.0), "slots": slots, "ats": ats, "scores": scores}
        return rows.select("blk", "file", *(c.alias(n) for n, c in row.items()))

    one, none = lambda c: F.array(F.col(c)), lambda c: F.transform(c, lambda x: F.lit(0))
    best = [known(seeds, _BEST, one("slot"), F.array(F.lit(0)), F.array(F.lit(1.0)))]
    seen = [known(front, _SEEN, one("slot"), one("node"), F.array(F.lit(0.0)))]
    for level in range(1, max_depth + 1):
        packed = front.groupBy("blk", "node").agg(F.collect_list(F.struct("slot", "at", "score")).alias("x")).select("blk", "node", F.col("x.slot").alias("slots"), F.col("x.at").alias("ats"), F.col("x.score").alias("scores"))
        sent = packed.join(inc, "node").select("blk", "file", F.lit(_SENT).alias("kind"), F.col("other").alias("node"), "code", "turn", "weight", "slots", "ats", "scores")
        last = level == max_depth
        rows = reduce(DataFrame.unionByName, [*best, *([] if last else seen), sent])
        kinds_of = [F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(_MESSAGES)]
        rows = rows.select(*kinds_of).repartition("blk", "file").sortWithinPartitions("file", "blk", "kind")
        cand = staged(rows.mapInArrow(_fold_level(decay, last), _LEVEL), f"level-{level}")
        if level > 1:
            released(front)
        up = cand.select("blk", "file", F.explode("rises").alias("x"))
        rises.append(staged(up.select("blk", "x.slot", "file", F.lit(level).alias("depth"), "x.key", "x.score", "x.code"), f"rises-{level}"))
        if last:
            break
        best.append(known(cand.where(F.size("rises") > 0), _BEST, F.col("rises.slot"), none("rises"), F.col("rises.score")))
        seen.append(known(cand.where(F.size("fresh") > 0), _SEEN, F.col("fresh.slot"), F.col("fresh.node"), none("fresh")))
        fresh = cand.select("blk", F.explode("fresh").alias("x")).select("blk", "x.slot", "x.node", "x.key", "x.score")
        front = numbered(fresh, "at", "key", "blk", "slot", "node")
        if not fresh.limit(1).count():
            break
    last = reduce(DataFrame.unionByName, rises).groupBy("blk", "slot", "file")
    best = last.agg(F.max("score").alias("score"), F.max("depth").alias("depth"), F.sort_array(F.collect_list(F.struct("depth", "key", "code"))).alias("rises"))

    def told(x):
        side = F.when(x["code"] % 2 == 0, "depends_on").otherwise("caller")
        via = F.get("kinds", F.floor(x["code"] / 2).cast("int"))
        return F.when(x["code"] < 0, "directly changed").otherwise(F.concat(side, F.lit(" via "), via, F.lit(" (depth "), x["depth"].cast("string"), F.lit(")")))

    best = best.join(F.broadcast(kinds), F.lit(True)).join(asked, ["blk", "slot"])  # kinds: one row
    return best.join(files, "file").select("request_id", "path", "score", "depth", F.transform("rises", told).alias("reasons"))


class Reach(NamedTuple):
    """What entries reach: sets (id, block, bits, depth: the entries that reach a node first at this depth, 64 a block),
    places (entry, block, bit) and ids (node_id, id)."""

    sets: DataFrame
    places: DataFrame
    ids: DataFrame


def reach_sets(edges: DataFrame, entries: DataFrame, max_depth: int = 15) -> Reach:
    """The nodes that entries (entry) reach over edges. Entries go together, as bits of a number, so a level's
    rows are nodes and not pairs of an entry and a node."""
    pairs = edges.select("source_id", "target_id").distinct()
    entries = entries.select("entry").distinct()
    names = pairs.select(F.col("source_id").alias("node_id")).union(pairs.select("target_id")).union(entries).distinct()
    ids = staged(numbered(names, "id", "node_id"), "reach-ids")
    end = lambda column, name: ids.select(F.col("node_id").alias(column), F.col("id").alias(name))
    out = staged(pairs.join(end("source_id", "id"), "source_id").join(end("target_id", "to"), "target_id").select("id", "to"), "reach-edges")
    leading = entries.join(end("entry", "id"), "entry").join(out.select("id").distinct().withColumn("leads", F.lit(True)), "id", "left")
    at = numbered(leading, "n", F.col("leads").isNull(), "id")  # entries without edges fill no block of the others
    places = staged(at.select("entry", "id", F.floor(F.col("n") / 64).alias("block"), (F.col("n") % 64).cast("int").alias("bit")), "reach-places")
    seen = [staged(places.select("id", "block", F.expr("shiftleft(1L, bit)").alias("bits"), F.lit(0).alias("depth")), "reach-0")]
    for level in range(1, max_depth + 1):
        step = seen[-1].join(out, "id").select(F.col("to").alias("id"), "block", F.lit(0).cast("long").alias("old"), F.col("bits").alias("new"))
        known = reduce(DataFrame.unionByName, seen).select("id", "block", F.col("bits").alias("old"), F.lit(0).cast("long").alias("new"))
        both = step.unionByName(known).groupBy("id", "block").agg(F.bit_or("old").alias("old"), F.bit_or("new").alias("new"))
        fresh = both.select("id", "block", F.expr("new & ~old").alias("bits"), F.lit(level).alias("depth")).where("bits <> 0")
        front = staged(fresh, f"reach-{level}")
        if not front.limit(1).count():
            break
        seen.append(front)
    return Reach(reduce(DataFrame.unionByName, seen), places.drop("id"), ids)


def reached(reach: Reach, entries: DataFrame | None = None) -> DataFrame:
    """entry, node_id, depth: a row per entry (of ``entries``, if given) and node."""
    places = reach.places if entries is None else reach.places.join(entries.select("entry"), "entry", "left_semi")
    held = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("bits", k) == 1)
    if entries is not None:
        wanted = places.groupBy("block").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
        sets = reach.sets.join(wanted, "block").withColumn("bits", F.col("bits").bitwiseAND(F.col("mask"))).where("bits <> 0").drop("mask")
    else:
        sets = reach.sets
    rows = sets.select("id", "block", "depth", F.explode(held).alias("bit")).join(places, ["block", "bit"])
    return rows.join(reach.ids, "id").select("entry", "node_id", "depth")


def count_by_entry(sets: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """entry, ``name``: how many rows of sets (block, bits) hold an entry."""
    sums = sets.groupBy("block").agg(F.array(*(F.sum(F.expr(f"shiftright(bits, {k}) & 1")) for k in range(64))).alias("n"))
    return places.join(sums.select("block", F.posexplode("n").alias("bit", name)), ["block", "bit"]).select("entry", name)


def reachable(edges: DataFrame, entries: DataFrame, max_depth: int = 15) -> DataFrame:
    """entry, node_id, depth: nodes that entries (entry) reach over edges, nearest first."""
    return reached(reach_sets(edges, entries, max_depth))


def propagate_labels(links: DataFrame, rounds: int = 10) -> DataFrame:
    """node, label after label propagation over links (a, b); ties go to the smallest label.

    A node takes the most frequent label among its neighbours and itself. In each round nodes of
    one half (by the first digit of the MD5 of their name) move first and the others see it, so
    pairs and stars settle instead of trading labels; rounds end early when no label changes.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    # Numbers in the order of names stand for them, so the smallest label stays the smallest.
    names = staged(numbered(both.select(F.col("a").alias("node")).distinct(), "id", "node"), "names").withColumn("half", F.substring(F.md5("node"), 1, 1).isin(*"13579bdf").cast("int"))
    ends = both.join(names.select(F.col("node").alias("a"), F.col("id").alias("i"), "half"), "a").join(names.select(F.col("node").alias("b"), F.col("id").alias("j")), "b")
    pairs = staged(ends.select("i", "j", "half"), "links")
    labels = staged(names.select(F.col("id").alias("i"), "half", F.col("id").alias("label"), F.lit(False).alias("moved")), "labels")
    for _ in range(rounds):
        still = True
        for half in (0, 1):
            near = pairs.where(F.col("half") == half).join(labels.select(F.col("i").alias("j"), "label"), "j").select("i", "label")
            votes = near.unionByName(labels.where(F.col("half") == half).select("i", "label")).groupBy("i", "label").count()
            # The largest count, then the smallest label (below 2^33), as one number.
            new = votes.groupBy("i").agg(F.min_by("label", F.col("label") - F.shiftleft("count", 33)).alias("new"))
            labels = staged(labels.join(new, "i", "left").select("i", "half", F.coalesce("new", "label").alias("label"), F.coalesce(F.col("new") != F.col("label"), F.lit(False)).alias("moved")), "labels")
            still = still and not labels.where("moved").limit(1).count()
        if still:
            break
    told = names.select("node", "id")
    return labels.join(told.withColumnRenamed("id", "i"), "i").select("node", F.col("label").alias("id")).join(told.withColumnRenamed("node", "label"), "id").select("node", "label")


def sweep_labels(links: DataFrame, order: DataFrame, rounds: int = 10) -> DataFrame:
    """node, label after label propagation in file order, as one node after the other would do it.

    ``order`` (node, pos) has every node's place; a label is a place. In a round each node takes
    the most frequent label among its neighbours (a link to itself counts), ties going to the label
    of the neighbour that comes first. Neighbours before it have moved already, those after it have
    not, which makes the round's result the only solution of

        new(i) = most frequent of new(j) for j < i and old(j) for j >= i.

    It is found by repetition: starting from the old labels, nodes behind a neighbour whose label has
    just changed are computed again, until none is. A wave of changes passes over all nodes at
    once, so a round takes as many joins as its longest ascending chain of changes, not nodes.
    Nodes without links keep their own label and are left out.
    """
    at = order.select("node", F.col("pos").cast("long").alias("pos"))
    ends = links.select("a", "b").distinct().join(at.select(F.col("node").alias("a"), F.col("pos").alias("i")), "a").join(at.select(F.col("node").alias("b"), F.col("pos").alias("j")), "b").select("i", "j")
    near = staged(ends.unionByName(ends.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct(), "near")
    labels = staged(near.select("i").distinct().withColumn("label", F.col("i")), "labels")
    for _ in range(rounds):
        old, new, active = labels, labels, None
        while True:
            now = old.withColumnRenamed("label", "before").join(new.withColumnRenamed("label", "after"), "i").select(F.col("i").alias("j"), "before", "after")
            rows = near if active is None else near.join(active, "i", "left_semi")
            votes = rows.join(now, "j").select("i", "j", F.when(F.col("j") < F.col("i"), F.col("after")).otherwise(F.col("before")).alias("label"))
            votes = votes.groupBy("i", "label").agg(F.count("*").alias("n"), F.min("j").alias("first"))
            best = votes.groupBy("i").agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("best"))
            moved = staged(new.join(best, "i").where("best <> label").select("i", F.col("best").alias("label")), "moved")
            if not moved.limit(1).count():
                break
            new = staged(new.join(moved, "i", "left_anti").unionByName(moved), "labels")
            active = staged(near.where("j < i").join(moved.select(F.col("i").alias("j")), "j", "left_semi").select("i").distinct(), "active")
            if not active.limit(1).count():
                break
        if new is old:
            break
        labels = new
    return labels.join(at.withColumnRenamed("pos", "i"), "i").select("node", "label")


def running_rank(df: DataFrame, by: str, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
