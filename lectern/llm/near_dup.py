"""Near duplicates by a chosen-path set similarity join on word shingles, with exact confirmation.

A document's set is its distinct shingles of five words, hashed. Equal sets are one class first, by a digest of the set;
from there on only one document of each class takes part. A class has an embedding of minwise tokens: for each of
``POSITIONS`` hash functions the least hash of its set; sets of similarity J agree in a position with probability J.

The join recurses over trees. At the root of each tree documents branch by a chosen position, so those that agree there
meet in a node. Nodes of at most ``SMALL`` documents are compared exhaustively on their embeddings. In larger nodes
documents are linked with the node's leaders, on full sets, and then branch again, by positions that the node's path
chooses, unless such confirmed links join them all by now. What is still too large after ``LEVELS`` is compared
exhaustively too, in pairs of blocks, so no task holds more than a small node. Two documents of similarity 0.75 miss each
other in all of the trees with probability 0.25 ** ROOTS, about 6e-8.

Pairs that agree in enough positions are candidate links. They make groups; every group is confirmed on full sets, each
set being sent once. Groups too large for one task are confirmed node by node instead. Comparing within a node or group
is a search from document to document over those not reached yet: all links between different components are tried,
links inside a component are not needed, so large groups of near copies take few passes and no pairs are written out.
Links become components by alternating star contractions.

Defined cases: null, empty and blank texts have an empty set, are linked with nothing and are their own component; texts
of fewer words than a shingle have one shingle, all their words; very long texts keep all shingles; rows that repeat a
doc_id stay, each with the set and component of its own text; a row without doc_id is compared by equal sets only, names
no component (it has that of the other rows of its set, or null) and is kept only where it has null; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import aside, bounded, discard, written

#: Words of a shingle; least similarity in percent.
WORDS, PERCENT = 5, 75
#: Positions of the embedding; those at which trees branch at their roots; positions by which a node branches on.
POSITIONS, ROOTS, BRANCHES = 64, 12, 3
#: Positions that must agree for a pair to be confirmed: at similarity 0.75 fewer agree with probability 2.5e-8.
AGREE = 28
#: Documents of a node that is compared exhaustively, and levels of branching; documents of a group confirmed in one task.
SMALL, LEVELS, GROUP = 4096, 8, 4096
#: Bytes up to which leaders' sets are broadcast.
SENT_BYTES = 16 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64)."""
    x = x + _MIX
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    k = mixed(np.arange(2 * POSITIONS, dtype=np.uint64))
    return k[:POSITIONS], k[POSITIONS:] | np.uint64(1)


class Words(dict):
    """Word -> 64-bit hash, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        n = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = n
        return n


@functools.cache
def _words() -> Words:
    return Words()


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text. Words end at ASCII blanks; only A-Z are lowered."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = _words()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mixed(out ^ h[k : k + n]) * np.uint64(2 * k + 3)
    return np.unique(mixed(out))


def embedding(hashes: np.ndarray) -> np.ndarray:
    """The least hash of the set at each position."""
    a, b = _seeds()
    out = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):
        np.minimum(out, ((hashes[k : k + 2048, None] ^ a) * b).min(0), out=out)
    return out


def signature_of(least: np.ndarray) -> bytes:
    """A byte of the hash at each position."""
    return (mixed(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set1, set2 (digest of the set), signature (a byte of each position), roots (nodes at the roots)."""

    def run(batches):
        places = mixed(np.arange(ROOTS, dtype=np.uint64))
        for batch in batches:
            sizes, digests, signatures, roots = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text or "")
                least = embedding(s)
                sizes.append(len(s))
                digests.append(digest_of(s))
                signatures.append(signature_of(least))
                roots.append(mixed(least[:ROOTS] ^ places).view(np.int64))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            flat = pa.array(np.concatenate(roots)) if roots else pa.array([], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, ROOTS * len(roots) + 1, ROOTS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(signatures, pa.binary()), lists], names=["doc_id", "n_shingles", "set1", "set2", "signature", "roots"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set1 long, set2 long, signature binary, roots array<long>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, POSITIONS)


def _alike(signatures: np.ndarray, sizes: np.ndarray, one: np.ndarray, n: int) -> np.ndarray:
    """Which rows may be similar enough to one document."""
    ok = (signatures == one).sum(1) >= AGREE
    return ok & (100 * np.minimum(sizes, n) >= PERCENT * np.maximum(sizes, n))


def reach(sizes: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray] | None = None) -> np.ndarray:
    """For each row the first row of its component, links being candidates or, with ``sets``, confirmed.

    From each row, those not reached yet are looked at once; what a row reaches is looked at from there."""
    m = len(sizes)
    root = np.arange(m)
    left = np.arange(1, m)
    if sets is not None:
        known, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([len(x) for x in sets])
        marks = np.zeros(len(known), bool)
    now, queue = 0, [0]
    while len(left):
        p = queue.pop()
        found = np.flatnonzero(_alike(signatures[left], sizes[left], signatures[p], sizes[p]))
        if sets is not None and len(found):
            mine = flat[ends[p] - sizes[p] : ends[p]]
            marks[mine] = True
            both = np.array([np.count_nonzero(marks[flat[ends[k] - sizes[k] : ends[k]]]) for k in left[found]])
            marks[mine] = False
            found = found[100 * both >= PERCENT * (sizes[left[found]] + sizes[p] - both)]
        if len(found):
            reached = left[found]
            root[reached] = now
            queue += reached.tolist()
            left = np.delete(left, found)
        if not queue and len(left):
            now, left = int(left[0]), left[1:]
            queue = [now]
    return root


def _star_links(exact: bool):
    """Rows (group, rep, n, signature and, with ``exact``, hashes), sorted by group and rep -> links (a, b) from the first of a
    component to its others."""

    def run(batches):
        held: list = []

        def links(columns, last):
            group, ids, sizes, signatures, *more = columns
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            ends = np.concatenate([starts[1:], [len(group)]])
            keep = len(group) if last else int(starts[-1])
            done = ends <= keep
            starts, ends = starts[done], ends[done]
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            many = np.ones(len(starts), bool)
            if not exact:  # most nodes are pairs, which are compared all at once
                two = starts[ends - starts == 2]
                many = ends - starts > 2
                ok = (signatures[two] == signatures[two + 1]).sum(1) >= AGREE
                ok &= 100 * np.minimum(sizes[two], sizes[two + 1]) >= PERCENT * np.maximum(sizes[two], sizes[two + 1])
                a.append(ids[two[ok]])
                b.append(ids[two[ok] + 1])
            for s, e in zip(starts[many].tolist(), ends[many].tolist()):
                if e - s > 1:
                    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in more[0][s:e]] if exact else None
                    root = reach(sizes[s:e], signatures[s:e], sets)
                    other = np.flatnonzero(root != np.arange(e - s))
                    a.append(ids[s:e][root[other]])
                    b.append(ids[s:e][other])
            return np.concatenate(a), np.concatenate(b), [c[keep:] for c in columns]

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(3))]
            if exact:
                columns.append(list(batch.column(4)))
            if held:
                columns = [x + y if isinstance(x, list) else np.concatenate([x, y]) for x, y in zip(held, columns)]
            a, b, held = links(columns, False)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if held and len(held[0]):
            a, b, _ = links(held, True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _grouped_links(rows: DataFrame, group: str, exact: bool) -> DataFrame:
    """rows (group, rep, n, signature and, with ``exact``, hashes) -> links (a, b) that join each component of a group."""
    columns = [F.col(group).alias("group"), "rep", "n", "signature"] + ["hashes"] * exact
    return rows.select(*columns).repartition("group").sortWithinPartitions("group", "rep").mapInArrow(_star_links(exact), "a long, b long")


def _leader_links(batches):
    """Each document of a large node (a) with the leaders of the node (b) that it may be similar to."""
    for batch in batches:
        if not batch.num_rows:
            continue
        get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
        ids, sizes, signatures = get("rep").to_numpy(), get("n").to_numpy(), _matrix(get("signature"))
        out_a, out_b = [], []
        for k in ("1", "2"):
            other, other_n, other_s = get("rep" + k).to_numpy(), get("n" + k).to_numpy(), _matrix(get("signature" + k))
            ok = (signatures == other_s).sum(1) >= AGREE
            ok &= (100 * np.minimum(sizes, other_n) >= PERCENT * np.maximum(sizes, other_n)) & (ids != other)
            out_a.append(ids[ok])
            out_b.append(other[ok])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])


def _similar(batches):
    """Rows (a, b, hashes, others) -> those (a, b) whose full sets are similar enough."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, repeats: bool, spare: list[str]) -> DataFrame:
    """Those of the links (a, b) from documents to leaders that hold on full sets. A leader that many documents share is not
    gathered with them: leaders' sets are sent where few bytes, else the join may split them."""
    ends = written(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "ends", spare)
    wanted = classes.select("rep", "first_doc", "set1", "set2").join(bounded(ends), "rep", "left_semi")
    full = written(full_sets(written(wanted, "wanted", spare), docs, repeats), "sets", spare)
    heads = written(pairs.select(F.col("b").alias("rep")).distinct(), "heads", spare)
    heads = written(full.join(bounded(heads), "rep", "left_semi").select(F.col("rep").alias("b"), F.col("hashes").alias("others")), "heads", spare)
    size = heads.agg(F.sum(F.octet_length("others"))).first()[0] or 0
    rows = pairs.join(full.select(F.col("rep").alias("a"), "hashes"), "a").join(F.broadcast(heads) if size <= SENT_BYTES else heads, "b")
    return rows.select("a", "b", "hashes", "others").mapInArrow(_similar, "a long, b long").distinct()


def digest_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def full_sets(wanted: DataFrame, docs: DataFrame, repeats: bool) -> DataFrame:
    """wanted (rep, first_doc, set1, set2, ..numbers) -> rep, ..numbers, n, signature, hashes: the full set of each class, from
    the text of its first document. Only ids and digests are sent to the texts. With ``repeats`` (some doc_id stands in
    several rows) a class may be found several times and is then reduced to one row."""
    more = [c for c in wanted.columns if c not in ("first_doc", "set1", "set2")]

    def sets(batches):
        for batch in batches:
            found, good = [], []
            for text, one, two in zip(*(batch.column(c).to_pylist() for c in ("text", "set1", "set2"))):
                found.append(shingles(text or ""))
                # Of rows that share a doc_id, those of this class.
                good.append(np.frombuffer(digest_of(found[-1]), "<i8").tolist() == [one, two])
            signatures = [signature_of(embedding(x)) if ok else b"" for x, ok in zip(found, good)]
            columns = [pa.array([len(x) for x in found], pa.int64()), pa.array(signatures, pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in more), *columns], names=[*more, "n", "signature", "hashes"]).filter(pa.array(good, pa.bool_()))

    rows = docs.join(bounded(wanted), docs["doc_id"] == wanted["first_doc"]).select("text", "set1", "set2", *more)
    out = rows.mapInArrow(sets, ", ".join(f"{c} long" for c in more) + ", n long, signature binary, hashes binary")
    return out.dropDuplicates(more) if repeats else out


def components(links: DataFrame, spare: list[str]) -> DataFrame:
    """(rep, part) for every id in links (a, b): part is the least id reachable. Alternating large and small stars; a hub is
    joined with its least neighbour, its neighbours are never gathered."""
    old: list[str] = []
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars", old)
    state = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        new_paths: list[str] = []
        now = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars", new_paths)
        discard(links.sparkSession, old)
        old += new_paths
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum("v")).first()
        if new == state or not new[0]:
            break
        state = new
    out = written(now.select(F.col("u").alias("rep"), F.col("v").alias("part")).union(now.select("v", "v").distinct()), "parts", spare)
    discard(links.sparkSession, old)
    return out


def _children(batches):
    """Rows of large nodes -> rows of their children, at positions that the node chooses."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node, signatures = batch.column(0).to_numpy().view(np.uint64), _matrix(batch.column(3))
        for k in range(BRANCHES):
            pick = mixed(node ^ mixed(np.full(1, k + 1, np.uint64)))
            at = (pick % np.uint64(POSITIONS)).astype(np.int64)
            token = signatures[np.arange(len(node)), at].astype(np.uint64)
            child = mixed(pick ^ mixed(token + np.uint64(k << 16)))
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *(batch.column(c) for c in (1, 2, 3))], names=["node", "rep", "n", "signature"])


def _block_pairs(large: DataFrame) -> DataFrame:
    """Nodes that are still too large, as nodes of two blocks each: every pair of a node's documents meets in one of them."""
    blocks = F.expr(f"cast(ceil(2 * size / {SMALL}) as int)")
    rows = large.withColumn("blocks", blocks).withColumn("mine", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return rows.select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), "rep", "n", "signature")


def _found(docs: DataFrame, spare: list[str]) -> tuple[DataFrame, bool]:
    """For each row of docs (doc_id, text): doc_id, n_shingles, set1, set2, component_id, first_doc (of its class) and wins
    (its class is the one that stays of its component), from written tables; and whether some doc_id stands in several rows."""
    sketch = written(sketches(docs), "sketches")
    repeats = not sketch.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty()
    first = [F.min("doc_id").alias("first_doc"), *(F.first(c).alias(c) for c in ("n_shingles", "signature", "roots"))]
    classes = sketch.where("n_shingles > 0").groupBy("set1", "set2").agg(*first).where("first_doc is not null")
    # Classes are numbered, as an id may have several texts.
    classes = written(classes.select(F.monotonically_increasing_id().alias("rep"), "set1", "set2", "first_doc", F.col("n_shingles").alias("n"), "signature", "roots"), "classes", spare)
    parts = _linked(classes, docs, repeats, spare)
    names = classes.select("set1", "set2", "rep", "first_doc")
    if parts is None:
        names = names.select("set1", "set2", "first_doc", F.col("first_doc").alias("component"), F.lit(True).alias("wins"))
    else:
        heads = parts.join(classes.select("rep", "first_doc"), "rep").groupBy("part").agg(F.min(F.struct("first_doc", "rep")).alias("head"))
        heads = written(heads.select("part", F.col("head.first_doc").alias("component"), F.col("head.rep").alias("winner")), "heads", spare)
        linked = written(parts.join(bounded(heads), "part").select("rep", "component", "winner"), "linked", spare)
        names = names.join(bounded(linked), "rep", "left")
        names = names.select("set1", "set2", "first_doc", F.coalesce("component", "first_doc").alias("component"), F.coalesce(F.col("winner") == F.col("rep"), F.lit(True)).alias("wins"))
    names = written(names.withColumnsRenamed({"set1": "s1", "set2": "s2"}), "names")
    hit = (sketch["set1"] == F.col("s1")) & (sketch["set2"] == F.col("s2")) & (sketch["n_shingles"] > 0)
    out = sketch.select("doc_id", "n_shingles", "set1", "set2").join(bounded(names), hit, "left")
    return out.select("doc_id", "n_shingles", "set1", "set2", F.coalesce("component", "doc_id").alias("component_id"), "first_doc", "wins"), repeats


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_shingles, component_id, kept, one row per document."""
    spare: list[str] = []
    found, _ = _found(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), spare)
    discard(docs.sparkSession, spare)
    return found.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def _linked(classes: DataFrame, docs: DataFrame, repeats: bool, spare: list[str]) -> DataFrame | None:
    """(rep, part) of all classes that are linked with another."""
    rows = classes.select(F.explode("roots").alias("node"), "rep", "n", "signature")
    candidates, solved, confirmed, parts = [], [], [], None

    def compare(small: DataFrame) -> None:
        solved.append(small.select("node", "rep"))
        candidates.append(written(_grouped_links(small, "node", False).distinct(), "candidates", spare))

    for level in range(1, LEVELS + 1):
        nodes = written(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "nodes", spare)
        sized = written(rows.join(bounded(nodes), "node").select("node", "rep", "n", "signature", "size"), "open", spare)
        compare(sized.where(F.col("size") <= SMALL))
        large = sized.where(F.col("size") > SMALL)
        if large.isEmpty():
            break
        tried = _by_leaders(large, spare)
        if parts is not None:
            for end in ("a", "b"):
                tried = tried.join(bounded(parts.select(F.col("rep").alias(end), F.col("part").alias("part_" + end))), end, "left")
            tried = tried.where("coalesce(part_a, a) <> coalesce(part_b, b)").select("a", "b")
        tried = written(tried, "tried", spare)
        if not tried.isEmpty():
            confirmed.append(written(_confirmed(tried, classes, docs, repeats, spare), "confirmed", spare))
            known = functools.reduce(DataFrame.union, confirmed)
            parts = None if known.isEmpty() else components(known, spare)
        # A node whose documents are all joined by confirmed links gives nothing new; candidate links may still fall.
        if parts is not None:
            large = large.join(bounded(parts), "rep", "left").withColumn("part", F.coalesce("part", "rep"))
            mixed_nodes = written(large.groupBy("node").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("node"), "mixed", spare)
            large = large.join(bounded(mixed_nodes), "node", "left_semi")
        if level == LEVELS:
            compare(written(_block_pairs(large), "blocks", spare))
        else:
            rows = written(large.select("node", "rep", "n", "signature").mapInArrow(_children, "node long, rep long, n long, signature binary").dropDuplicates(["node", "rep"]), "children", spare)
    known = functools.reduce(DataFrame.union, candidates)
    if not known.isEmpty():
        confirmed.append(written(_by_groups(components(known, spare), classes, solved, docs, repeats, spare), "links", spare))
    if not confirmed:
        return None
    links = functools.reduce(DataFrame.union, confirmed)
    return None if links.isEmpty() else components(links, spare)


def _by_groups(groups: DataFrame, classes: DataFrame, solved: list[DataFrame], docs: DataFrame, repeats: bool, spare: list[str]) -> DataFrame:
    """Links confirmed on full sets within candidate groups (rep, part)."""
    sizes = written(groups.groupBy("part").agg(F.count(F.lit(1)).alias("members")), "groups", spare)
    members = written(groups.join(bounded(sizes), "part"), "members", spare)
    grouped = written(classes.select("rep", "first_doc", "set1", "set2").join(bounded(members), "rep"), "grouped", spare)
    full = written(full_sets(grouped, docs, repeats), "sets", spare)
    links = _grouped_links(full.where(F.col("members") <= GROUP), "part", True)
    huge = full.where(F.col("members") > GROUP)
    if not huge.isEmpty():
        # Every candidate link was found in a solved node; there a group of any size is confirmed in bounded pieces.
        links = links.union(_grouped_links(huge.join(functools.reduce(DataFrame.union, solved), "rep"), "node", True))
    return links


def _by_leaders(rows: DataFrame, spare: list[str]) -> DataFrame:
    """Links of documents of large nodes with two leaders of the node. Leaders come first in an order that all nodes share, so
    a group that meets in many nodes has few leaders; what they leave open is taken up in the nodes below."""
    member = F.struct("rep", "n", "signature")
    leaders = rows.groupBy("node").agg(F.min_by(member, F.xxhash64("rep")).alias("x"), F.min_by(member, F.xxhash64("rep", F.lit(1))).alias("y"))
    flat = [F.col(f"{s}.{c}").alias(f"{c}{k}") for k, s in (("1", "x"), ("2", "y")) for c in ("rep", "n", "signature")]
    leaders = written(leaders.select("node", *flat), "leaders", spare)
    # Two signatures make a row 128 bytes longer than its numbers.
    return rows.join(bounded(leaders, 4 << 20), "node").mapInArrow(_leader_links, "a long, b long").distinct()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component one row stays, of its least doc_id. Rows without words
    all stay. Where a doc_id stands in several rows, each row is judged by its own text."""
    docs, back = aside(docs, id_col, text_col)
    spare: list[str] = []
    doc = F.col(id_col).cast("long")
    found, repeats = _found(docs.select(doc.alias("doc_id"), F.col(text_col).alias("text")), spare)
    stays = (F.col("n_shingles") == 0) | (F.coalesce("wins", F.lit(True)) & F.col("doc_id").eqNullSafe(F.col("first_doc")))
    found = written(found.select("doc_id", "set1", "set2", F.col("n_shingles").alias("n"), stays.alias("stays")), "stays")
    discard(docs.sparkSession, spare)
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("stays").alias("stays"))
    left = docs.join(bounded(written(ids.where("rows > 1 or not stays").select(F.col("doc_id").alias("__id")), "dropped")), F.col("__id") == doc, "left_anti").where(doc.isNotNull())
    several = written(ids.where("rows > 1").select(F.col("doc_id").alias("__id")), "several") if repeats else None
    unnamed = docs.where(doc.isNull())
    if several is None and found.where("doc_id is null").isEmpty():
        return back(left)
    if several is not None:
        unnamed = unnamed.unionByName(docs.join(bounded(several), F.col("__id") == doc, "left_semi"))
    found = found.where("stays").select(F.col("doc_id").alias("__id"), F.col("set1").alias("__s1"), F.col("set2").alias("__s2")).distinct()
    judged = _with_digests(unnamed, text_col).join(found, doc.eqNullSafe(F.col("__id")) & (F.col("__set1") == F.col("__s1")) & (F.col("__set2") == F.col("__s2")), "left_semi")
    one = judged.where("__n > 0").dropDuplicates([id_col, "__set1", "__set2"]).unionByName(judged.where("__n = 0"))
    return back(left.unionByName(one.select(*docs.columns)))


def _with_digests(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the number of shingles and the digest of the set of each row."""

    def run(batches):
        for batch in batches:
            found = [shingles(t or "") for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            halves = np.frombuffer(b"".join(map(digest_of, found)), "<i8").reshape(-1, 2)
            more = [pa.array([len(x) for x in found], pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "__n", "__set1", "__set2"])

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + [T.StructField(c, T.LongType()) for c in ("__n", "__set1", "__set2")]))
