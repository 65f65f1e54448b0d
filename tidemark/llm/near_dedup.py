"""Near-duplicate linking: fast similarity sketching, banding, exact verification.

1. One pass makes each document's set of five-word shingles, a fingerprint of
   the set and a sketch of 176 bins (see `shingles`). Documents with equal sets
   form a class; only its smallest id goes on.
2. The sketch is cut into 44 bands of 4 bins. Classes that agree in a band share
   its bucket. At a similarity of 0.80 the chance that two sets share no bucket
   is below 1e-10. The numbers here hold for a `percent` of 80 or more.
3. A bucket is not expanded into pairs. All its members are compared with one of
   them, its centre, by their sketches: those that agree in `NEAR` bins or more
   are put into its cluster. A member `x` that agrees less can only be linked to
   members that agree with the centre at most `RING` bins more (Jaccard distance
   is a metric); these go into further rounds with another centre. Rows of one
   bucket that a few rounds leave in different clusters are compared in blocks: all
   but those of the bucket's largest cluster, with all rows. Clusters therefore hold
   every pair that may be linked; rows are dealt in proportion to the buckets'
   members but for those that the rounds leave apart.
4. Each cluster is verified on full sets. Its centre, the member that agrees best
   with those it was compared with, is held against every member; members that no
   centre is linked with give the next centre, for `VERIFIED` rounds. Members that
   these links tie together need no more comparison. All but the largest such group
   of a cluster are held against all members in cells of bounded bytes, each
   counting its intersections at once as a product of incidence matrices; members
   whose distances to the first centre differ by more than a link allows are not
   put into one cell. So a template with any number of variants costs a comparison
   each, not all pairs.
5. Components of those links are the result.

Two sets are linked when 100 * intersection >= percent * union; sets hold 64-bit
hashes of their shingles, and `n_shingles` counts these.

Defined results: a text that is null or has no word has an empty set and is linked
with nothing; equal texts of fewer than five words are linked, their word sequence
being the one shingle; rows that repeat an id count as one document with the links
of all its rows; a row with a null id is linked with nothing, has a null
component and is kept; an empty table gives an empty result; other columns are not
read by `link` and pass through `representatives` under any name. `representatives`
links rows, whatever their ids: rows without an id, or with one that repeats, are
near duplicates of each other and of other rows by their texts alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components, shared, shingles

BINS, ROWS = 176, 4
#: Bins that must agree to be clustered with a centre; what a link may differ by; what a link has at least (chances below 1e-9 at a similarity of 0.80).
NEAR, RING, LINK = 72, 70, 106
ROUNDS, BLOCK = 2, 256
#: Rounds of centres in verification; bytes of sets on one side of a cell.
VERIFIED, CELL_BYTES = 3, 4 << 20
#: What names a comparison with a centre.
TOLD = ["cluster", "doc_id", "print", "centre", "centre_print"]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shared.serves("near")
    for batch in shared.bounded(batches, "text"):
        members, begins = shingles.sets(batch.column("text"))
        sketch = shingles.sketches(members, begins, BINS)
        n = batch.num_rows
        prints = [shingles.fingerprint(members[begins[i] : begins[i + 1]]) for i in range(n)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(begins)), pa.array(prints, pa.binary()), pa.array([row.tobytes() for row in sketch], pa.binary())],
            names=["doc_id", "n_shingles", "print", "sketch"],
        )


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, c, sketches of both) to (x, c, bins that agree)."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BINS) for k in ("sx", "sc"))
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("c"), pa.array((a == b).sum(axis=1).astype(np.int32))], names=["x", "c", "agree"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, BINS // ROWS)
        n, bands = sketch.shape
        band = np.tile(np.arange(bands), n).astype(np.uint64)
        # The band's number is mixed into its key, so one number names the bucket.
        key = shingles.mix(sketch.ravel() + shingles.mix(band + np.uint64(1)))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(batch.column("rep").to_numpy(), bands))], names=["bucket", "x"])


def _spread(x: str, k: int):
    return F.xxhash64(F.col(x), F.lit(k))


def _pairs_agree(pairs: DataFrame, reps: DataFrame, name: str) -> DataFrame:
    left = reps.select(F.col("rep").alias("x"), F.col("sketch").alias("sx"))
    right = reps.select(F.col("rep").alias("c"), F.col("sketch").alias("sc"))
    return shared.staged(shared.through(pairs.join(left, "x").join(right, "c").select("x", "c", "sx", "sc"), _agreeing, "x long, c long, agree int"), name)


def _cell_edges(table: pa.Table) -> pa.Table:
    """Sketch links between the left and the right rows of one cell of a bucket, as a spanning forest."""
    ids, left = table.column("x").to_numpy(), np.flatnonzero(table.column("left").to_numpy())
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, BINS)
    linked = np.zeros((len(ids), len(ids)), bool)
    for i in left.tolist():
        linked[i] = (sketch == sketch[i]).sum(axis=1) >= LINK
    return _forest(ids, linked | linked.T)


def _forest(ids: np.ndarray, linked: np.ndarray) -> pa.Table:
    sets, found = components.Union(len(ids)), []
    for a, b in np.argwhere(np.triu(linked, 1)).tolist():
        if ids[a] != ids[b] and sets.join(a, b):
            found.append((a, b))
    a, b = (np.array([p[k] for p in found], np.int64) for k in (0, 1))
    return pa.table({"u": pa.array(ids[a], pa.int64()), "v": pa.array(ids[b], pa.int64())})


def _clusters(reps: DataFrame) -> DataFrame:
    """Edges (u, v) whose components hold every pair that may be linked, and the bins that agree (null where not counted)."""
    banded = shared.through(reps.select("rep", "sketch"), _banded, "bucket long, x long")
    buckets = shared.staged(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select(F.col("bucket").alias("b")), "buckets")
    rows = shared.staged(banded.join(buckets, F.col("bucket") == F.col("b"), "left_semi"), "bucket-rows").withColumn("old", F.lit(False))
    edges = None
    for k in range(ROUNDS):
        # `old` rows have a cluster already and are here for the others' sake only: they make no centre.
        centres = shared.staged(
            rows.groupBy("bucket").agg(F.min_by(F.when(~F.col("old"), F.col("x")), F.when(~F.col("old"), F.struct(_spread("x", k), F.col("x")))).alias("c"), F.count("*").alias("n")).where("n > 1 AND c IS NOT NULL").select(F.col("bucket").alias("b"), "c"),
            f"centres-{k}",
        )
        held = shared.staged(rows.join(centres, F.col("bucket") == F.col("b")).where("x <> c").select("bucket", "x", "c", "old"), f"held-{k}")
        agree = _pairs_agree(held.select("x", "c").distinct(), reps, f"agree-{k}").withColumnsRenamed({"x": "ax", "c": "ac"})
        near = agree.where(F.col("agree") >= NEAR).select(F.col("ax").alias("u"), F.col("ac").alias("v"), "agree")
        edges = near if edges is None else edges.union(near)
        rows = shared.staged(
            held.join(agree, (F.col("x") == F.col("ax")) & (F.col("c") == F.col("ac"))).where(F.col("agree") < NEAR + RING).select("bucket", "x", (F.col("old") | (F.col("agree") >= NEAR)).alias("old")),
            f"rest-{k}",
        )
        # After the first round a bucket's old rows share its one centre; later ones may have unlike centres.
        if k == 0 and rows.where("NOT old").isEmpty():
            return edges
    # What is left: rows of one bucket that are in different clusters by now (a row without edges is its own). Those of the
    # bucket's largest cluster need no comparison with each other, so the number of rows dealt grows with the bucket, and with
    # the square of those outside that cluster.
    known = components.components(edges, "near")
    rows = shared.staged(rows.join(known, F.col("x") == F.col("node"), "left").select("bucket", "x", F.coalesce("root", "x").alias("root")), "rest-roots")
    largest = F.max_by("root", F.struct("n", -F.col("root"))).alias("most")
    sizes = shared.staged(
        rows.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.max("n").alias("top"), largest).where("top < n").select(F.col("bucket").alias("b"), "most", F.ceil((F.col("n") - F.col("top")) / BLOCK).cast("int").alias("lefts"), F.ceil(F.col("n") / BLOCK).cast("int").alias("rights")),
        "rest-sizes",
    )
    last = rows.join(sizes, F.col("bucket") == F.col("b")).join(reps.select("rep", "sketch"), F.col("x") == F.col("rep"))
    own = F.pmod(_spread("x", 7), F.when(F.col("left"), F.col("lefts")).otherwise(F.col("rights"))).cast("int")
    sides = last.withColumn("left", F.explode(F.when(F.col("root") == F.col("most"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))).withColumn("own", own)
    cells = sides.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("left"), F.col("rights")).otherwise(F.col("lefts")) - 1)))
    dealt = cells.select("bucket", F.when(F.col("left"), F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("left"), F.col("other")).otherwise(F.col("own")).alias("j"), "x", "sketch", "left")
    more = dealt.groupBy("bucket", "i", "j").applyInArrow(_cell_edges, "u long, v long")
    return edges.union(shared.staged(more, "rest-edges").withColumn("agree", F.lit(None).cast("int")))


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of members; a row of a member's id with another text is none of the member's."""
    shared.serves("near")
    for batch in shared.bounded(batches, "text"):
        members, begins = shingles.sets(batch.column("text"))
        own = [members[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]
        mine = np.flatnonzero([shingles.fingerprint(s) == p for s, p in zip(own, batch.column("print").to_pylist(), strict=True)])
        rows = batch.select(["cluster", "doc_id", "print"]).take(pa.array(mine, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([own[i].tobytes() for i in mine.tolist()], pa.binary())], names=["cluster", "doc_id", "print", "members"])


def _with_centre(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Whether each member is linked with its cluster's centre, and its Jaccard distance from it."""
    for batch in batches:
        pairs = zip(batch.column("members").to_pylist(), batch.column("centre_members").to_pylist(), strict=True)
        told = [shingles.overlap(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in pairs]
        both, union = np.array(told, np.int64).reshape(-1, 2).T
        found, apart = 100 * both >= percent * union, 1 - both / union
        yield pa.RecordBatch.from_arrays([*batch.select(TOLD).columns, pa.array(found), pa.array(apart)], names=[*TOLD, "linked", "apart"])


def _verified(table: pa.Table, percent: int) -> pa.Table:
    """Exact links between the left and the right rows of one cell, as a spanning forest."""
    ids, left = table.column("doc_id").to_numpy(), np.flatnonzero(table.column("left").to_numpy())
    own = [np.frombuffer(b, np.uint64) for b in table.column("members").to_pylist()]
    n, sizes = len(ids), np.array([len(s) for s in own], np.int64)
    values, which, often = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    at = np.repeat(np.arange(n), sizes)
    shared_by_some = often[which] > 1
    number = np.cumsum(often > 1) - 1
    at, which = at[shared_by_some], number[which[shared_by_some]]
    order = np.argsort(which, kind="stable")
    at, which = at[order], which[order]
    both = np.zeros((len(left), n))
    width = 4096
    for start in range(0, int(which[-1]) + 1 if len(which) else 0, width):
        lo, hi = np.searchsorted(which, (start, start + width))
        part = np.zeros((n, width), np.float32)
        part[at[lo:hi], which[lo:hi] - start] = 1
        both += part[left] @ part.T
    union = sizes[left][:, None] + sizes[None, :] - both
    linked = np.zeros((n, n), bool)
    linked[left] = (100 * both >= percent * union) & (union > 0)
    return _forest(ids, linked | linked.T)


def _cells(rows: DataFrame, opened: DataFrame) -> DataFrame:
    """cluster, i, j, left, doc_id, members: every pair of an open member and another member of its cluster in one cell.

    Open members have the first blocks of their cluster, the others the blocks after them; the cells are those of an open
    block with itself and each later one. A block has about `BLOCK` sets or `CELL_BYTES` bytes at most; a larger set is
    alone with a few others.
    """
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(F.coalesce(size, F.lit(0)) / CELL_BYTES)).cast("int")
    known = opened.select(F.col("cluster").alias("oc"), F.col("member").alias("om"))
    marked = rows.join(known, (F.col("cluster") == F.col("oc")) & (F.col("doc_id") == F.col("om")), "left").withColumn("open", F.col("om").isNotNull()).drop("oc", "om")
    marked = shared.staged(marked, "cluster-open")
    size, is_open = F.octet_length("members").cast("long"), F.col("open")
    told = marked.groupBy("cluster").agg(F.count_if(is_open).alias("on"), F.sum(F.when(is_open, size)).alias("os"), F.count_if(~is_open).alias("cn"), F.sum(F.when(~is_open, size)).alias("cs"))
    sizes = shared.staged(told.where("on > 0").select(F.col("cluster").alias("c"), blocks(F.col("on"), F.col("os")).alias("firsts"), blocks(F.col("cn"), F.col("cs")).alias("others")), "cluster-sizes")
    spread = F.when(is_open, F.pmod(_spread("doc_id", 7), F.col("firsts"))).otherwise(F.col("firsts") + F.pmod(_spread("doc_id", 7), F.greatest(F.col("others"), F.lit(1))))
    dealt = marked.join(sizes, F.col("cluster") == F.col("c")).withColumn("own", spread.cast("int"))
    before = "transform(sequence(0, least(own, firsts) - 1), i -> struct(i AS i, own AS j, false AS left))"
    after = "transform(sequence(own, firsts + others - 1), j -> struct(own AS i, j AS j, true AS left))"
    cells = F.expr(f"concat(IF(own > 0, {before}, array()), IF(open, {after}, array()))")
    return dealt.withColumn("cell", F.explode(cells)).select("cluster", "cell.i", "cell.j", "cell.left", "doc_id", "members")


def _zones(told: DataFrame, opened: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sets that meet in cells (zone, id, own) and the open members (cluster, member) of each zone.

    Sets are banded by their distance from the first centre. By the triangle inequality, linked ones are in one band or
    in neighbouring ones. A zone has the open members of its band, and as others the rest of the band, its neighbours'
    members, and of the next band the open ones too: they meet those of the band before them there.
    """
    zone = lambda band: F.concat_ws(":", "cluster", band)
    # A centre whose id is repeated has several sets: the distance is that from one of them.
    first = told.groupBy("cluster", "doc_id", "print").agg(F.min_by("apart", "centre_print").alias("apart"))
    known = opened.select(F.col("cluster").alias("oc"), F.col("member").alias("om"))
    placed = first.join(known, (F.col("cluster") == F.col("oc")) & (F.col("doc_id") == F.col("om")), "left")
    band = F.floor(F.col("apart") / (1 - percent / 100 + 1e-6)).cast("int").alias("band")
    placed = shared.staged(placed.select("cluster", "doc_id", "print", F.col("om").isNotNull().alias("open"), band), "bands")
    left = shared.staged(placed.where("open").select(zone("band").alias("cluster"), F.col("doc_id").alias("member")).distinct(), "zones-open")
    near = F.expr("explode(IF(open, array(band - 1, band), array(band - 1, band, band + 1)))").alias("near")
    spots = placed.select("cluster", "doc_id", "print", near).select(zone("near").alias("zone"), F.col("doc_id").alias("id"), F.col("print").alias("own"))
    return spots.join(left.select(F.col("cluster").alias("z")).distinct(), F.col("zone") == F.col("z"), "left_semi"), left


def _linked(docs: DataFrame, full: DataFrame, reps: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) that tie together what is linked inside the clusters."""
    clusters = components.components(edges, "clusters")
    ends = edges.select(F.explode(F.array("u", "v")).alias("n"), "agree").groupBy("n").agg(F.avg("agree").alias("score"))
    both = clusters.select(F.col("node").alias("member"), F.col("root").alias("cluster")).union(clusters.select(F.col("root").alias("member"), F.col("root").alias("cluster")).distinct())
    members = shared.staged(both.join(ends, F.col("member") == F.col("n"), "left").select("cluster", "member", F.coalesce("score", F.lit(0.0)).alias("score")), "cluster-members")
    known = shared.staged(members.join(reps.select("rep", "print"), F.col("member") == F.col("rep")).select("cluster", "member", "print"), "cluster-prints")
    # Merged at every size: a broadcast while members are few would only hide what the join costs when they are many.
    rows = docs.join(known.hint("merge"), F.col("doc_id") == F.col("member")).select("cluster", "doc_id", "print", "text")
    sets = shared.staged(shared.through(rows, _with_sets, "cluster long, doc_id long, print binary, members binary"), "cluster-sets")
    if not full.groupBy("doc_id", "print").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        sets = shared.staged(sets.dropDuplicates(["cluster", "doc_id", "print"]), "cluster-sets")
    opened, found, first = members, None, None
    for k in range(VERIFIED):
        best = F.max_by("member", F.struct("score", -F.col("member"))).alias("centre")
        centres = shared.staged(opened.groupBy("cluster").agg(best).withColumnRenamed("cluster", "c"), f"verified-centres-{k}")
        own = shared.staged(sets.join(centres, (F.col("cluster") == F.col("c")) & (F.col("doc_id") == F.col("centre"))).select("c", "centre", F.col("print").alias("centre_print"), F.col("members").alias("centre_members")), f"centre-sets-{k}")
        pairs = sets.join(own, F.col("cluster") == F.col("c")).select(*TOLD, "members", "centre_members")
        told = shared.staged(shared.through(pairs, lambda it: _with_centre(it, percent), "cluster long, doc_id long, print binary, centre long, centre_print binary, linked boolean, apart double"), f"verified-{k}")
        first = told if first is None else first
        linked = told.where("linked AND doc_id <> centre").select(F.col("doc_id").alias("u"), F.col("centre").alias("v"))
        found = linked if found is None else found.union(linked)
        settled = linked.select("u").union(centres.select("centre")).distinct()
        opened = shared.staged(opened.join(settled, F.col("member") == F.col("u"), "left_anti"), f"open-{k}")
        if opened.isEmpty():
            break
    # Members that were linked with unlike centres may be linked with each other, so a member is settled only if these links
    # tie it to the largest group of its cluster; one without links is a group of its own.
    groups = components.components(found, "groups")
    groups = shared.staged(members.join(groups, F.col("member") == F.col("node"), "left").select("cluster", "member", F.coalesce("root", "member").alias("root")), "cluster-groups")
    largest = F.max_by("root", F.struct("n", -F.col("root"))).alias("most")
    most = groups.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster").agg(largest).select(F.col("cluster").alias("c"), "most")
    opened = shared.staged(groups.join(most, F.col("cluster") == F.col("c")).where("root <> most").select("cluster", "member"), "open")
    if opened.isEmpty():
        return found
    spots, opened = _zones(first, opened, percent)
    rows = sets.join(spots, (F.col("doc_id") == F.col("id")) & (F.col("print") == F.col("own"))).select(F.col("zone").alias("cluster"), "doc_id", "members")
    cells = _cells(rows, opened)
    return found.union(cells.groupBy("cluster", "i", "j").applyInArrow(lambda t: _verified(t, percent), "u long, v long"))


def link(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = docs.select(shared.named(id_col).cast("long").alias("doc_id"), F.coalesce(shared.named(text_col), F.lit("")).alias("text"))
    signed = shared.staged(shared.through(rows, _signed, "doc_id long, n_shingles long, print binary, sketch binary"), "signed")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = shared.staged(full.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "classes")
    links = shared.staged(_linked(rows, full, reps, _clusters(reps), percent), "links")
    # A row of a repeated id ties the classes of that id together: it stands in every one of them under its class's smallest id.
    found = components.components(links.union(_same_id(full, reps)), "linked")
    classes = shared.staged(reps.select("print", "rep").join(found, F.col("rep") == F.col("node"), "left").select(F.col("print").alias("p"), F.coalesce("root", "rep").alias("component")), "class-components")
    told = signed.join(classes, (F.col("print") == F.col("p")) & F.col("doc_id").isNotNull(), "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return told.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _same_id(full: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges between the classes of rows that repeat an id; none where ids are unique."""
    many = shared.staged(full.groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("b")).where("a <> b").select(F.col("doc_id").alias("d")), "repeated-ids")
    rows = full.join(many, F.col("doc_id") == F.col("d"), "left_semi").select("doc_id", "print")
    own = rows.join(reps.select(F.col("print").alias("p"), "rep"), F.col("print") == F.col("p"))
    return own.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))


def representatives(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one of each group (the smallest id, null last), with the columns of the input."""
    own = shared.named(id_col).cast("long")
    if not docs.select(own.alias("d")).groupBy("d").agg(F.count("*").alias("n")).where("d IS NULL OR n > 1").isEmpty():
        return _one_row_each(docs, percent, own, text_col)
    gone = link(docs, percent, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_td_gone"))
    gone = shared.staged(gone.distinct(), "near-gone")
    return docs.join(gone, docs[f"`{id_col}`"].cast("long") == gone["_td_gone"], "left_anti")


def _one_row_each(docs: DataFrame, percent: int, own: Column, text_col: str) -> DataFrame:
    """One row of each group where ids do not tell rows apart: a copy of the table has numbers of its own."""
    row = "_td_row"
    while row in map(str.lower, docs.columns):
        row += "_"
    numbered = shared.staged(docs.withColumn(row, F.monotonically_increasing_id()), "near-numbered")
    linked = link(numbered, percent, row, text_col).select(F.col("doc_id").alias("node"), F.col("component_id").alias("component"))
    # Rows of one id are told apart by their texts, those of one text by their numbers.
    order = F.struct(own.isNull().alias("without"), own.alias("id"), F.sha2(F.coalesce(shared.named(text_col), F.lit("")), 256).alias("text"), F.col(row).alias("row"))
    least = numbered.select(F.col(row).alias("k"), order.alias("first")).join(linked, F.col("k") == F.col("node")).groupBy("component").agg(F.min("first").alias("first"))
    stay = shared.staged(least.select(F.col("first.row").alias("stays")), "near-stay")
    return numbered.join(stay, numbered[row] == stay["stays"], "left_semi").drop(row)
