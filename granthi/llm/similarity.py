"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Rows of the incidence matrix are the distinct shingle sets (documents with the same set are one row);
its columns are shingles. Columns are counted block by block (``exchange``), and every row's columns get one
order, rarest first. By the size bound two sets that reach the similarity share a column among the
first ``n - ceil(t n) + 1`` of each, so only those columns, and of them only such as another row has too, decide
which rows can be linked: rows that share one, and whose sizes the bound allows, fall into one candidate group.

A row links only within its group, so the matrix is block-diagonal and each group is one block of the product:
its rows' whole sets are multiplied inside a task, overlaps are accumulated over the columns (dense columns by
matrix products, sparse ones by their pairs of rows), and entries below the size-derived bound are discarded. What
leaves a task are links to the smallest member, never pairs; many small groups share a task.

A group too large for a block, as that of thousands of near copies, is reduced first: each row is compared with
its neighbour in its columns' orders of sizes, and linked rows are contracted. Columns whose rows are all in one
component are done. Those that stay open form groups again; what is still too large is multiplied column by
column, in pairs of blocks of bounded size, for the rows alone to which the bounds leave a partner. No step joins
rows by a shingle: columns are read as runs of a sort, which spreads a common one over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from .common import collect_garbage, look_up, materialize, read_table, release, to_partitions
from .components import components, local_roots
from .ngrams import U, mix, shingle_sets

WORDS, NUMERATOR, DENOMINATOR = 3, 90, 100
#: Rows and set members of a block, and columns that the product takes at once.
BLOCK_ROWS, BLOCK_MEMBERS, COLUMNS = 1500, 1_000_000, 2048
#: Members of the groups that share a task.
TASK_MEMBERS = 4_000_000


def _signatures(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: equal sets, equal pairs."""
    out = []
    for salt in (0x51, 0xA7):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(grams ^ mix(np.array([salt], U))), dtype=U)])
        out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]


SETS = "row long, doc_id long, n long, s1 long, s2 long"


def _set_rows(words: int):
    """Each row's set by its size and signature."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in X.rows_of(batches):
            grams, at = shingle_sets(X.block_texts(row), words)
            columns = [pa.array(row["rows"], pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(np.diff(at)), *map(pa.array, _signatures(grams, at))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SETS.split(", ")])

    return rows


def _own_sets(row: dict, words: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct sets of a block that have ``least`` shingles: their first rows, the sets and their offsets."""
    grams, at = shingle_sets(X.block_texts(row), words)
    n = np.diff(at)
    s1, s2 = _signatures(grams, at)
    rows = np.array(row["rows"], np.int64)
    order = np.lexsort((rows, s2, s1, n))
    new = np.ones(len(n), bool)
    new[1:] = (n[order][1:] != n[order][:-1]) | (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1])
    keep = order[new & (n[order] >= least)]
    parts = [grams[at[k] : at[k + 1]] for k in keep]
    return rows[keep], np.concatenate(parts) if parts else np.empty(0, U), np.concatenate([[0], np.cumsum(n[keep])]).astype(np.int64)


def _reply(which: np.ndarray, counts: np.ndarray, kinds: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """How many sets hold each column: 0 for one, then a step for each half octave."""
    total = np.bincount(which, weights=counts)
    return [np.rint(2 * np.log2(total)).clip(0, 255)[which]], []


ENTRIES = "gram long, row long, n long, position long, members binary"


def _entries(words: int, least: int, num: int, den: int):
    """A block's entries of the product, and the whole sets (gram null) of the rows that have any."""

    def use(block: dict, got: list[dict[int, bytes]]) -> pa.Table:
        replies = got[0]
        ids, grams, at = _own_sets(block, words, least)
        keys = np.unique(grams)
        codes = np.concatenate([np.zeros(0, np.uint8), *(X.unpack(replies[s], ("u1",))[0] for s in sorted(replies))])
        code = codes[np.searchsorted(keys, grams)]
        out, sets = [], []
        for doc, a, b in zip(ids, at[:-1], at[1:], strict=True):
            n = b - a
            first = n + (-num * n // den) + 1
            order = np.argsort(code[a:b].astype(np.int64), kind="stable")[:first]  # the grams are sorted: equal counts go by hash
            shared = np.flatnonzero(code[a:b][order] > 0)
            if len(shared):
                out.append((grams[a:b][order[shared]].view(np.int64), np.full(len(shared), doc), np.full(len(shared), n), shared))
                sets.append((doc, n, X.put_keys(grams[a:b])))
        flat = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
        m = len(flat[0])
        return pa.table(
            {
                "gram": pa.array([*flat[0].tolist(), *[None] * len(sets)], pa.int64()),
                "row": pa.array(np.concatenate([flat[1], np.array([s[0] for s in sets], np.int64)])),
                "n": pa.array(np.concatenate([flat[2], np.array([s[1] for s in sets], np.int64)])),
                "position": pa.array(np.concatenate([flat[3], np.zeros(len(sets), np.int64)])),
                "members": pa.array([*[None] * m, *(s[2] for s in sets)], pa.binary()),
            }
        )

    return use


RUNS = "gram long, row long, n long, position long, label long, state int"
MIXED, UNSURE, ENDS = 0, 1, 2  # a row of a run of several labels; one of a run that another task may go on with; such a run's labels


def _sorted(entries: DataFrame) -> DataFrame:
    return entries.repartitionByRange("gram", "n", "row").sortWithinPartitions("gram", "n", "row")


def _whole_runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted rows, in pieces that end where a run of one gram ends."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in names]
        if not batch.num_rows:
            continue
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        if last or (held and held[-1][0][-1] != columns[0][0]):
            whole = [*held, [c[:last] for c in columns]]
            held = []
            yield [np.concatenate(c) for c in zip(*whole, strict=True)]
        held.append([c[last:] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _stars(num: int, den: int):
    """In rows sorted by (gram, n, row): each row's link to the first of its run, as far as sizes allow links along the run.

    A task's first and last runs may go on in other tasks: for each of them comes a row of its gram and its first document.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge: list[tuple[int, int]] = []
        for gram, doc, n in _whole_runs(batches, ["gram", "row", "n"]):
            if not len(gram):
                continue
            new = np.ones(len(gram), bool)
            new[1:] = gram[1:] != gram[:-1]
            starts = np.flatnonzero(new)
            if not edge:
                edge.append((int(gram[0]), int(doc[0])))
            edge = [edge[0], (int(gram[-1]), int(doc[starts[-1]]))]
            # a task's first and last runs are kept whole: whether sizes allow a link is then seen for all their tasks' rows
            new[1:] |= (den * n[:-1] < num * n[1:]) & (gram[1:] != edge[0][0]) & (gram[1:] != gram[-1])
            first = np.flatnonzero(new)
            head = doc[first][np.cumsum(new) - 1]
            keep = head != doc
            child, parent = local_roots(doc[keep], head[keep])
            yield _star_batch(child, parent, np.full(len(child), None))
        for gram, doc in edge:
            yield _star_batch([doc], [doc], [gram])

    return task


STARS = "child long, parent long, gram long"


def _star_batch(child, parent, gram) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (child, parent, gram)], names=["child", "parent", "gram"])


def _groups(entries: DataFrame, num: int, den: int) -> DataFrame:
    """(child, parent): the candidate groups' members and their smallest; members of entries that share no column are left out."""
    found = materialize(_sorted(entries.select("gram", "row", "n")).mapInArrow(_stars(num, den), STARS), "stars")
    ends = found.where("gram is not null").groupBy("gram").agg(F.collect_set("child").alias("docs")).where(F.size("docs") > 1)  # two runs a task
    across = ends.select(F.explode("docs").alias("child"), F.array_min("docs").alias("parent"))
    out = components(found.where("gram is null").drop("gram").unionByName(across))
    release(found)
    return out


def _sized(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """(row, root, m, members) of all members of groups, roots included; ``sizes``: (row, n)."""
    below = groups.select(F.col("child").alias("row"), F.col("parent").alias("root"))
    roots = groups.select(F.col("parent").alias("row"), F.col("parent").alias("root")).distinct()
    rows = materialize(below.unionByName(roots).join(sizes, "row"), "grouped")
    size = materialize(rows.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("members")).withColumn("weight", F.col("m")), "sizes")
    return materialize(look_up(rows.drop("n"), size, ["root"], "weight", rows.count()), "grouped")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The numbers of common members of all pairs of sorted sets, as a matrix product over the columns that two sets or more have."""
    m = len(sets)
    keys = np.concatenate(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(keys, kind="stable")
    keys, row = keys[order], row[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    count = np.diff(np.append(starts, len(keys)))
    out = np.zeros((m, m), np.float32)
    dense = (count > 1) & (count * 10 > m)
    for begin in range(0, int(dense.sum()), COLUMNS):
        own = np.flatnonzero(dense)[begin : begin + COLUMNS]
        part = np.zeros((m, len(own)), np.float32)
        size = count[own]
        at = np.repeat(starts[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
        part[row[at], np.repeat(np.arange(len(own)), size)] = 1
        out += part @ part.T
    cells, held = [], 0
    for c in np.unique(count[(count > 1) & ~dense]):  # sparse columns of c rows each: their pairs of rows
        rows = row[starts[(count == c) & ~dense][:, None] + np.arange(c)]
        for i in range(1, int(c)):
            cells.append((rows[:, i:] * m + rows[:, :-i]).ravel())
            held += len(cells[-1])
            if held > 4_000_000:
                _add_pairs(out, cells)
                cells, held = [], 0
    _add_pairs(out, cells)
    return out


def _add_pairs(out: np.ndarray, cells: list[np.ndarray]) -> None:
    if cells:
        both = np.bincount(np.concatenate(cells), minlength=out.size).reshape(out.shape)
        out += both + both.T


def _blocks(num: int, den: int):
    """Of a task's groups, rows (root, row, n, members), what the product links: (document, smallest document it reaches)."""

    def task(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("root")
        root, doc, n = (table.column(c).to_numpy() for c in ("root", "row", "n"))
        members = table.column("members")
        ends = np.append(np.flatnonzero(np.diff(root)) + 1, len(root))
        children, parents = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
            both = overlaps([X.get_keys(members[int(k)].as_py()) for k in range(a, b)])
            total = n[a:b][:, None] + n[a:b][None, :]
            i, j = np.nonzero((num + den) * both.astype(np.float64) >= num * total)  # the overlap that the sizes ask for
            child, parent = local_roots(doc[a:b][i], doc[a:b][j])
            children.append(child)
            parents.append(parent)
        return pa.table({"child": pa.array(np.concatenate(children)), "parent": pa.array(np.concatenate(parents))})

    return task


def _multiplied(rows: DataFrame, made: DataFrame, num: int, den: int) -> DataFrame:
    """Links within groups (row, root, m, members) of bounded size."""
    total = rows.agg(F.coalesce(F.sum(F.col("members") / F.col("m")), F.lit(0)).alias("n")).first()["n"]  # a group's members, once for each group
    own = rows.select("row", "root").join(_members(made), "row")
    return own.groupBy(F.pmod(F.xxhash64("root"), F.lit(to_partitions(TASK_MEMBERS, total)))).applyInArrow(_blocks(num, den), "child long, parent long")


def _members(made: DataFrame) -> DataFrame:
    """(row, n, members): the whole sets."""
    return made.where("gram is null").select("row", "n", "members")


def _open(entries: DataFrame) -> DataFrame:
    """Of rows with labels those in columns of more than one label."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "row", "n", "position", "label"]
        edge = None  # the last run, and whether it is the task's first
        begun = False

        def out(columns: list[np.ndarray], state: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(np.full(len(columns[0]), state), pa.int32())], names=[*names, "state"])

        def ends(columns: list[np.ndarray]) -> pa.RecordBatch:
            gram, label = columns[0], columns[4]
            return out([gram[:1], label.min(keepdims=True), gram[:1], gram[:1], label.max(keepdims=True)], ENDS)

        def inner(columns: list[np.ndarray]) -> pa.RecordBatch | None:
            gram, label = columns[0], columns[4]
            if not len(gram):
                return None
            starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            mixed = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
            keep = np.repeat(mixed, np.diff(np.append(starts, len(gram))))
            return out([c[keep] for c in columns], MIXED)

        for columns in _whole_runs(batches, names):
            if edge is not None:
                columns = [np.concatenate(c) for c in zip(edge, columns, strict=True)]
            gram = columns[0]
            a, b = int(np.searchsorted(gram, gram[0], "right")), int(np.searchsorted(gram, gram[-1]))
            if not begun:
                begun = True
                yield out([c[:a] for c in columns], UNSURE)
                yield ends([c[:a] for c in columns])
                columns, b = [c[a:] for c in columns], max(b - a, 0)
            if len(columns[0]):
                yield inner([c[:b] for c in columns]) or out([c[:0] for c in columns], MIXED)
                edge = [c[b:] for c in columns]
        if edge is not None and len(edge[0]):
            yield out(edge, UNSURE)
            yield ends(edge)

    found = materialize(_sorted(entries.select("gram", "row", "n", "position", "label")).mapInArrow(task, RUNS), "open")
    both = found.where(F.col("state") == ENDS).groupBy("gram").agg(F.min("row").alias("x"), F.max("label").alias("y")).where("x <> y").select("gram")
    unsure = found.where(F.col("state") == UNSURE).join(F.broadcast(both), "gram", "left_semi")  # two grams a task
    return materialize(found.where(F.col("state") == MIXED).unionByName(unsure).drop("state"), "open")


def _neighbours(num: int, den: int):
    """In rows sorted by (gram, n, row): each row with the one before it, where the bounds allow the pair."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            gram, doc, n, position = (batch.column(k).to_numpy() for k in range(4))
            if last is not None:
                gram, doc, n, position = (np.concatenate([[x], y]) for x, y in zip(last, (gram, doc, n, position), strict=True))
            if len(gram):
                last = gram[-1], doc[-1], n[-1], position[-1]
            room = np.minimum(n[1:] - position[1:], n[:-1] - position[:-1])
            good = (gram[1:] == gram[:-1]) & (doc[1:] != doc[:-1]) & ((num + den) * room >= num * (n[1:] + n[:-1]))
            a, b = doc[:-1][good], doc[1:][good]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return task


def _linked(num: int, den: int):
    """Of rows (a, b, set of a, set of b) those whose overlap reaches the similarity."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for x, y, p, q in zip(*(batch.column(k) for k in range(4)), strict=True):
                p, q = X.get_keys(p.as_py()), X.get_keys(q.as_py())
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                overlap = int((both[1:] == both[:-1]).sum())
                if den * overlap >= num * (len(both) - overlap):
                    a.append(x.as_py())
                    b.append(y.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(a, pa.int64())], names=["child", "parent"])

    return task


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    one = pairs.join(sets.select(F.col("row").alias("a"), F.col("members").alias("of_a")), "a")
    two = one.join(sets.select(F.col("row").alias("b"), F.col("members").alias("of_b")), "b")
    return two.select("a", "b", "of_a", "of_b").mapInArrow(_linked(num, den), "child long, parent long")


def _product(num: int, den: int):
    """Labels that a block of the product links: rows (gram, x, y, block, row, label, n, members) of one (gram, x, y).

    Overlaps of all rows are accumulated over blocks of columns; pairs of one label, and pairs whose sizes
    are too far apart, are discarded. What is linked comes back as (label, smallest label it reaches).
    """

    def group(table: pa.Table) -> pa.Table:
        label, n, block = (table.column(c).to_numpy() for c in ("label", "n", "block"))
        sets = [X.get_keys(x.as_py()) for x in table.column("members")]
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        empty = pa.table({"child": pa.array([], pa.int64()), "parent": pa.array([], pa.int64())})
        if len({*label[left].tolist(), *label[right].tolist()}) < 2:
            return empty
        columns, at = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        overlap = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        for begin in range(0, len(columns), COLUMNS):
            a, b = np.searchsorted(at, [begin, begin + COLUMNS])
            part = np.zeros((len(sets), min(COLUMNS, len(columns) - begin)), np.float32)
            part[row[a:b], at[a:b] - begin] = 1
            overlap += part[left] @ part[right].T
        total = n[left][:, None] + n[right][None, :]
        i, j = np.nonzero((den * overlap >= num * (total - overlap)) & (label[left][:, None] != label[right][None, :]))
        if not len(i):
            return empty
        child, parent = local_roots(label[left][i], label[right][j])
        return pa.table({"child": pa.array(child), "parent": pa.array(parent)})

    return group


def _eligible(num: int, den: int):
    """Of a block pair's rows (gram, x, y, block, row, label, n, position) those that the bounds allow a pair of two labels."""

    def group(table: pa.Table) -> pa.Table:
        label, n, position, block = (table.column(c).to_numpy() for c in ("label", "n", "position", "block"))
        left, right = (np.flatnonzero(block == table.column(c)[0].as_py()) for c in ("x", "y"))
        room = np.minimum((n - position)[left][:, None], (n - position)[right][None, :])
        good = ((num + den) * room >= num * (n[left][:, None] + n[right][None, :])) & (label[left][:, None] != label[right][None, :])
        keep = np.zeros(len(n), bool)
        keep[left[good.any(axis=1)]] = True
        keep[right[good.any(axis=0)]] = True
        return table.filter(pa.array(keep)).select([x.split()[0] for x in DEALT.split(", ")])

    return group


DEALT = "gram long, x int, y int, block int, row long, label long, n long"


def _across(entries: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """Links between labels within columns (child, parent).

    A column's rows are dealt into blocks of bounded size, and each pair of blocks is one product, so a
    column of any size is spread over tasks. Only rows that the bounds leave a partner get their sets.
    """
    blocks = entries.groupBy("gram").agg(F.count("*").alias("m"), F.sum("n").alias("members"))
    blocks = materialize(blocks.select("gram", "m", F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("members") / BLOCK_MEMBERS)).cast("int").alias("blocks")), "blocks")
    rows = look_up(entries, blocks, ["gram"], "m", entries.count()).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("other", other).select("gram", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "row", "label", "n", "position")
    allowed = dealt.groupBy("gram", "x", "y").applyInArrow(_eligible(num, den), DEALT)
    return allowed.join(members.drop("n"), "row").groupBy("gram", "x", "y").applyInArrow(_product(num, den), "child long, parent long")


def _reduced(entries: DataFrame, made: DataFrame, num: int, den: int) -> DataFrame:
    """Links (child, parent) of entries whose groups are too large for a block."""
    members = _members(made)
    pairs = materialize(_sorted(entries).mapInArrow(_neighbours(num, den), "a long, b long").distinct(), "pairs")
    near = materialize(_verified(pairs, members, num, den), "links")
    joined = components(near)
    label = joined.select(F.col("child").alias("row"), F.col("parent").alias("label"))
    open_ = _open(entries.join(label, "row", "left").withColumn("label", F.coalesce("label", "row")))
    rows = _sized(_groups(open_, num, den), open_.select("row", "n").distinct())
    fits = (F.col("m") <= BLOCK_ROWS) & (F.col("members") <= BLOCK_MEMBERS)
    within = _multiplied(rows.where(fits), made, num, den)
    large = materialize(open_.join(rows.where(~fits).select("row"), "row", "left_semi"), "large")
    return near.unionByName(within).unionByName(_across(large, members, num, den))


def jaccard_components(docs: DataFrame, words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Rows link when ``den * intersection >= num * union`` of their sets of ``words``-word shingles, whatever their
    ids; rows with equal, non-empty sets are linked. A component is named by its smallest doc_id, null if it has
    null ones alone. A row without words has size 0 and its own id. Repeated rows repeat. Null texts are empty.
    Empty tables give empty results; other columns are ignored.
    """
    blocks = X.pack_blocks(docs)
    sets = materialize(blocks.mapInArrow(_set_rows(words), SETS), "sets")
    classes = materialize(
        sets.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("lowest"), F.count("*").alias("copies")), "classes"
    )
    # the smallest set that can link with another set: below it one shingle more or less is too much
    least = next(n for n in range(1, den + 2) if den * (n - 1) >= num * n or den * n >= num * (n + 1))
    size = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n"), F.count("*").alias("b"), F.coalesce(F.sum(F.size("rows")), F.lit(0)).alias("d")).first()

    def find(block: dict) -> X.Found:
        return [np.unique(_own_sets(block, words, least)[1], return_counts=True)]

    ask = X.Exchange([to_partitions(6 * X.SHARD_KEYS, size["n"])], _reply, ("u1",))
    replies, _ = ask.answers(ask.asked(blocks, find), size["b"])
    made = materialize(X.with_answers(blocks, [replies], _entries(words, least, num, den), ENTRIES), "entries")
    release(blocks, replies)
    reps = classes.where(F.col("n") >= least).select(F.col("rep").alias("row"))
    entries = materialize(made.where("gram is not null").drop("members").join(reps, "row", "left_semi"), "columns")

    rows = _sized(_groups(entries, num, den), classes.select(F.col("rep").alias("row"), "n"))
    fits = (F.col("m") <= BLOCK_ROWS) & (F.col("members") <= BLOCK_MEMBERS)
    links = _multiplied(rows.where(fits), made, num, den)
    if not rows.where(~fits).isEmpty():
        large = materialize(entries.join(rows.where(~fits).select("row"), "row", "left_semi"), "large")
        links = links.unionByName(_reduced(large, made, num, den))
    links = materialize(links, "products")  # else a task would keep a Python worker for its product and one more for contracting its links
    final = components(links)
    release(made, entries, rows, links)
    collect_garbage(docs.sparkSession)

    best = classes.join(final.select(F.col("child").alias("rep"), F.col("parent").alias("root")), "rep", "left")
    best = materialize(best.select("n", "s1", "s2", "copies", "lowest", F.coalesce("root", "rep").alias("root")), "best")
    names = materialize(best.groupBy("root").agg(F.min("lowest").alias("component_id"), F.count("*").alias("m")), "names")
    named = materialize(look_up(best.drop("lowest"), names, ["root"], "m", best.count()).drop("root"), "named")
    out = look_up(sets.where("n > 0").select("doc_id", "n", "s1", "s2"), named, ["n", "s1", "s2"], "copies", size["d"])
    empty = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))
